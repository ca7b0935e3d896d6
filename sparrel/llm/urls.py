"""URL filters: rules of host and path, and logistic regression on hashed character n-grams for the rest.

The host runs from the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z in lower case; the path from there to ``?``,
``#`` or the end. A rule fits its host and all subdomains if the path starts with the rule's; of several the longest wins,
of equally long ones a blocking one, then the first in order. Other urls are blocked if the regression says so.

The features of a url are the buckets of the 3- and 4-grams of its host and path, which stand between marks. Splitting,
hashing and the sum of weights are column expressions; the weights are one constant array of ``BUCKETS`` numbers. The
regression is fitted on the driver from at most ``SAMPLE`` rows of a small labelled table, the least by a hash.

Null urls and urls without ``://`` have an empty host and path; like other rows they are judged alone, so keys may be
null or repeat. The columns beside the url are kept, but columns named host, path, rule or verdict are replaced. Without
labels of both kinds every url without a rule gets the only label there is, or is allowed. Empty tables give empty results.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import sample

BUCKETS, GRAMS, SAMPLE = 4096, (3, 4), 4_000
STEPS, RATE, DECAY = 300, 1.0, 1e-4


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rules(lines: str) -> list[Rule]:
    """Rules from lines like ``block net/de/``."""
    found = (line.split() for line in lines.splitlines() if line.strip())
    return [Rule(v, name.partition("/")[0], "/" + name.partition("/")[2]) for v, name in found]


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def ruled(held: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(name, verdict) of the rule that wins, null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    first = sorted(held, key=lambda r: (-len(r.name), r.verdict != "block", r.name))
    for rule in reversed(first):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


_SIGNS, _FOUND = "_url_signs", "_url_found"


def with_buckets(df: DataFrame, host: Column, path: Column) -> DataFrame:
    """Adds the distinct buckets of a url's n-grams. The signs are a column of their own, so that they are split once."""
    df = df.withColumn(_SIGNS, F.split(F.concat(F.lit("^"), host, F.lit("\x01"), path, F.lit("$")), ""))
    signs = F.col(_SIGNS)

    def grams(n: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(signs) - n, F.lit(0))), lambda i: F.pmod(F.xxhash64(*(F.get(signs, i + k) for k in range(n))), F.lit(BUCKETS)).cast("int"))

    return df.withColumn(_FOUND, F.array_distinct(F.concat(*map(grams, GRAMS)))).drop(_SIGNS)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, found: Column) -> Column:
        """The log odds of blocking."""
        held = F.from_json(F.lit(json.dumps([round(float(w), 9) for w in self.weights])), "array<double>")
        total = F.aggregate(found, F.lit(0.0), lambda s, b: s + F.get(held, b))
        return total / F.sqrt(F.greatest(F.size(found), F.lit(1)).cast("double")) + F.lit(float(self.bias))


def fit(labelled: DataFrame, url: str = "url", label: str = "label") -> Model:
    """From rows (url, 0 or 1, 1 being blocked): full gradient steps over the bounded sample."""
    rows = labelled.where(F.col(label).isNotNull()).select(F.col(url).alias("url"), F.col(label).cast("int").alias("label"))
    split = sample(rows, "url", SAMPLE).select(host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "label")
    rows = with_buckets(split, F.col("host"), F.col("path")).select(F.col(_FOUND).alias("b"), "label").collect()
    wanted = np.array([r.label for r in rows], dtype=np.float64)
    weights, bias = np.zeros(BUCKETS), 0.0
    if not len(rows) or len(set(wanted.tolist())) < 2:
        return Model(weights, 0.0 if not len(rows) else 30.0 * (2 * wanted[0] - 1))
    owner = np.repeat(np.arange(len(rows)), [len(r.b) for r in rows])
    which = np.array([b for r in rows for b in r.b])
    share = np.repeat([len(r.b) ** -0.5 for r in rows], [len(r.b) for r in rows])
    # both labels weigh the same
    mass = np.where(wanted == 1, 0.5 / wanted.sum(), 0.5 / (1 - wanted).sum())
    total, total_bias = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(STEPS):
        odds = np.bincount(owner, weights[which] * share, len(rows)) + bias
        gap = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - wanted) * mass
        slope = np.bincount(which, gap[owner] * share, BUCKETS) + DECAY * weights / BUCKETS
        total, total_bias = total + slope**2, total_bias + gap.sum() ** 2
        weights -= RATE * slope / np.sqrt(total)
        bias -= RATE * gap.sum() / total_bias**0.5
    return Model(weights, bias)


def judge(pages: DataFrame, held: list[Rule], model: Model, url: str = "url") -> DataFrame:
    """The pages with host, path, rule and verdict."""
    made = ("host", "path", "rule", "verdict")
    others = [F.col(c) for c in pages.columns if c not in made]
    split = pages.select(*others, host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    name, verdict = ruled(held, F.col("host"), F.col("path"))
    guess = F.when(model.score(F.col(_FOUND)) > 0, "block").otherwise("allow")
    found = with_buckets(split, F.col("host"), F.col("path"))
    # out of a generator of one row, as a filter on the verdict would else be pushed down and evaluated many times
    return found.select(*others, F.inline(F.array(F.struct("host", "path", name.alias("rule"), F.coalesce(verdict, guess).alias("verdict")))))


def labelled_by(pages: DataFrame, held: list[Rule], url: str = "url") -> DataFrame:
    """A labelled table (url, label) from the urls that a rule decides."""
    split = pages.select(F.col(url).alias("url"))
    _, verdict = ruled(held, host(F.col("url")), path(F.col("url")))
    return split.withColumn("label", (verdict == "block").cast("int")).where("label IS NOT NULL")
