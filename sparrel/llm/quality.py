"""Quality rules: decision lists learned by sequential covering, emitted as ordered Spark conditional expressions.

Statistics of a text, all of them column expressions: words, code points in words, symbols, lines that equal an earlier
one, words in repeated windows of three words, capitals and exclamation marks. Rules are conjunctions of thresholds on
their ratios. Each is grown on two thirds of the labelled rows that are left, one condition at a time by the gain in
log precision, then pruned from its end on the other third; rules that are precise enough on both are kept, the rows
that a rule covers go, and the next one is sought. The verdict is a chain of ``when``: the first rule that fits rejects.

The learner runs on the driver over the statistics of at most ``SAMPLE`` labelled rows, the least by a hash of their
key; it is the one bounded sample here. Of documents that repeat a labelled key, the one of least ratios speaks. No
Python runs on the executors. Two windows of three words count as equal if their 64-bit hashes are.

Null texts have no words and fail the base rule. Rows are independent: keys may be null or repeat, and the columns that
a frame has beside its text do not matter unless they bear a statistic's name, when the statistic replaces them in
``with_statistics`` and in nothing else. Without labels of both kinds no rule is learned and the base rule decides. Empty
tables give empty results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import sample

#: Labelled rows that the learner sees at most.
SAMPLE = 6_000
#: Share of its own that a rule must reject rightly, on growing and on pruning rows, and rows that it must cover.
PRECISION, COVERED, RULES, CONDITIONS = 0.97, 5, 12, 3
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_marks")


_WORDS, _WINDOWS, _PLACES = "_quality_words", "_quality_windows", "_quality_places"


def _with_repeated(df: DataFrame) -> DataFrame:
    """Adds the count of repeated words: each step is a column of its own, so that it is evaluated once for a row."""
    words, windows, places = F.col(_WORDS), F.col(_WINDOWS), F.col(_PLACES)
    made = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    df = df.withColumn(_WINDOWS, F.when(F.size(words) >= 4, F.sort_array(made)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    twice = F.transform(windows, lambda x, k: F.when((x["h"] == F.get(windows, k + 1)["h"]) | (x["h"] == F.get(windows, k - 1)["h"]), x["i"]))
    df = df.withColumn(_PLACES, F.sort_array(F.array_compact(twice)))
    # a window covers three words, or as many as there are up to the next repeated window
    covered = F.transform(places, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1), x + 3) - x))
    return df.withColumn("_quality_repeats", F.aggregate(covered, F.lit(0), lambda s, x: s + x).cast("long"))


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """The frame with the counts of its texts, all long."""
    said = F.coalesce(F.col(text), F.lit(""))
    count = lambda pattern: F.regexp_count("_quality_said", F.lit(pattern))
    lines = F.filter(F.split(said, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    others = [c for c in df.columns if c not in COUNTS]
    df = df.select(*others, F.array_remove(F.split(said, r"[\x20\x09-\x0D]+"), "").alias(_WORDS), lines.alias("_quality_lines"), said.alias("_quality_said"))
    said = F.col("_quality_said")
    found = {
        "n_words": F.size(_WORDS),
        "word_chars": F.length(said) - count(r"[\x20\x09-\x0D]"),
        "n_symbols": count(r"[#*$%&|<>]"),
        "n_dup_lines": F.size("_quality_lines") - F.size(F.array_distinct("_quality_lines")),
        "n_repeat_words": F.col("_quality_repeats"),
        "n_capitals": count("[A-Z]"),
        "n_marks": count("!"),
    }
    # the counts come out of a generator of one row, as filters on them would else be pushed down and evaluated many times
    return _with_repeated(df).select(*others, F.inline(F.array(F.struct(*(c.cast("long").alias(n) for n, c in found.items())))))


#: Ratios that rules speak of: name to (count, what it is divided by).
RATIOS = {
    "symbols_per_char": ("n_symbols", "word_chars"),
    "chars_per_word": ("word_chars", "n_words"),
    "dup_lines_per_word": ("n_dup_lines", "n_words"),
    "repeats_per_word": ("n_repeat_words", "n_words"),
    "capitals_per_char": ("n_capitals", "word_chars"),
    "marks_per_char": ("n_marks", "word_chars"),
}


@dataclass(frozen=True)
class Condition:
    ratio: str
    above: bool
    bound: float

    def fits(self, row: dict[str, float]) -> bool:
        return row[self.ratio] > self.bound if self.above else row[self.ratio] <= self.bound

    def column(self) -> Column:
        over, under = RATIOS[self.ratio]
        value = F.col(over) / F.greatest(F.col(under), F.lit(1))
        return value > self.bound if self.above else value <= self.bound

    def __str__(self) -> str:
        return f"{self.ratio} {'>' if self.above else '<='} {self.bound:.6g}"


Rule = tuple[Condition, ...]


def _precision(rule: Rule, rows: list[dict]) -> tuple[float, int]:
    """Share of bad rows among those covered, by Laplace's rule, and how many are covered."""
    covered = [r["bad"] for r in rows if all(c.fits(r) for c in rule)]
    return (sum(covered) + 1) / (len(covered) + 2), len(covered)


def _grown(rows: list[dict]) -> Rule:
    rule: Rule = ()
    while len(rule) < CONDITIONS:
        bad = sum(r["bad"] for r in rows)
        if not bad or bad == len(rows):
            break
        start, best, gain = math.log(bad / len(rows)), None, 1e-9
        for ratio in RATIOS:
            order = sorted(rows, key=lambda r, k=ratio: r[k])
            total, seen, hit = len(order), 0, 0
            for one, two in zip(order, order[1:], strict=False):
                seen, hit = seen + 1, hit + one["bad"]
                if one[ratio] == two[ratio]:
                    continue
                bound = (one[ratio] + two[ratio]) / 2
                for above, n, p in ((False, seen, hit), (True, total - seen, bad - hit)):
                    if p and (g := p * (math.log((p + 0.5) / (n + 1)) - start)) > gain:
                        best, gain = Condition(ratio, above, bound), g
        if best is None:
            break
        rule = (*rule, best)
        rows = [r for r in rows if best.fits(r)]
    return rule


def _pruned(rule: Rule, rows: list[dict]) -> Rule:
    """The shortest start of a rule that is as good on rows it was not grown on."""
    return max((rule[:n] for n in range(1, len(rule) + 1)), key=lambda r: (round(_precision(r, rows)[0], 3), -len(r)), default=())


def learn(rows: list[dict]) -> list[Rule]:
    """An ordered list of rejecting rules from rows with the ratios and ``bad`` (0 or 1), in a fixed order."""
    rules: list[Rule] = []
    left = list(rows)
    while len(rules) < RULES:
        grow, prune = [r for k, r in enumerate(left) if k % 3], left[::3]
        rule = _pruned(_grown(grow), prune)
        (p, n), (q, m) = _precision(rule, grow), _precision(rule, prune)
        right = (p * (n + 2) + q * (m + 2) - 2) / max(1, n + m)
        if not rule or n + m < COVERED or right < PRECISION:
            break
        rules.append(rule)
        left = [r for r in left if not all(c.fits(r) for c in rule)]
    return rules


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> list[Rule]:
    """Rules for ``label`` = 0, from the labelled documents that pass the base rule."""
    known: dict = {}
    for r in sample(labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(label).alias("label")), "id", SAMPLE).collect():
        known[r.id] = min(r.label, known.get(r.id, r.label))
    if len(set(known.values())) < 2:
        return []
    # at most SAMPLE keys: their bound is proven
    wanted = docs.sparkSession.createDataFrame([(i,) for i in known], f"id {labels.schema[key].dataType.simpleString()}")
    rows = with_statistics(docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(wanted), "id"), "text")
    ratios = [(F.col(a) / F.greatest(F.col(b), F.lit(1))).alias(name) for name, (a, b) in RATIOS.items()]
    # one row for each key, the least, so rows that repeat a key are never gathered
    found = rows.where(~base_failed()).groupBy("id").agg(F.min(F.struct(*ratios)).alias("ratios")).collect()
    return learn([{**r.ratios.asDict(), "bad": int(known[r.id] == 0)} for r in sorted(found, key=lambda r: r.id)])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """(kept, number of the rule that rejects, 0 for the base rule, null if none), of a frame with the statistics."""
    number = F.when(base_failed(), F.lit(0))
    for k, rule in enumerate(rules, 1):
        fits = F.lit(True)
        for condition in rule:
            fits = fits & condition.column()
        number = number.when(fits, F.lit(k))
    return number.isNull(), number


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The documents with the statistics, base_failed, kept and rule."""
    kept, number = verdict(rules)
    return with_statistics(docs, text).withColumns({"base_failed": base_failed(), "kept": kept, "rule": number})


def keep(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The documents that no rule rejects, with the columns that they came with."""
    kept, _ = verdict(rules)
    held = docs.select(F.struct(*docs.columns).alias("_quality_row"), F.col(text).alias("_quality_text"))
    return with_statistics(held, "_quality_text").where(kept).select("_quality_row.*")
