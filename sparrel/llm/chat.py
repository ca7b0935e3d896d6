"""Chat formatting in budgeted windows, by column expressions alone.

A turn is written ``<s>[role]`` line feed, its text, ``</s>``. In texts and roles ``~``, ``<``, ``[`` and ``]`` become ``~0``,
``~1``, ``~2`` and ``~3``, so no text can hold a control string, and reading back is exact.

A conversation is cut into windows of whole turns. Prefix sums of the turns' tokens choose each span: it goes on while
the system turn, the repeated turns before it and the span itself stay within ``budget``. Every window but the first
starts with the system turn, if the conversation opens with one, and with the last turns before the span: as many as fit
beside its first turn, up to ``history``. So a window exceeds the budget only if a single turn does, alone or with the
system turn; it then holds nothing else. What is repeated is context only: the loss mask holds the texts of assistant turns
of the span itself, so each of them is a target once. Tokens are words and single other signs, or what the caller counts.

Turns are in order of turn, then role, then text; nulls come first, null texts and roles are empty. A null conversation id is
an id like others. Repeated rows are turns of their own. Columns beside the four are not read. An empty table gives an
empty result. One conversation is one row, as its windows and digests depend on all that goes before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What stands for each sign that control strings begin or end with, in the order of escaping.
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"), ("]", "~3"))
BUDGET, HISTORY = 512, 2
TURNS = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    for sign, name in ESCAPES:
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def unescape(text: Column) -> Column:
    for sign, name in reversed(ESCAPES):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def _opening(role: Column) -> Column:
    return F.concat(F.lit("<s>["), escape(role), F.lit("]\n"))


def _spans(sums: Column, head: Column, firsts: Column, budget: int) -> Column:
    """First turns of the spans. sums: tokens before each turn and in all; head: of the system turn; firsts: of the repeated turns."""
    last = F.size(sums) - 2
    begin = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(0).alias("start"))

    def step(s: Column, i: Column) -> Column:
        used = F.when(s["start"] > 0, head).otherwise(0) + F.get(sums, i + 1) - F.get(sums, F.get(firsts, s["start"]))
        return F.when(used <= budget, s).otherwise(F.struct(F.concat(s["starts"], F.array(i)).alias("starts"), i.alias("start")))

    return F.when(last >= 1, F.aggregate(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), begin, step)["starts"]).otherwise(F.array(F.lit(0)))


def count_tokens(text: Column) -> Column:
    """Words and single other signs."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: str | None = None) -> DataFrame:
    """(conv_id, windows): formatted text of each window, how many of its turns only repeat, and its loss spans.

    A loss span is (start, size) in code points of the formatted text, from 0. ``tokens`` names a column that holds the
    tokens of each turn, such as an encoder's counts; else they are counted by ``count_tokens``.
    """
    said = F.coalesce("text", F.lit(""))
    cost = F.coalesce(F.col(tokens), F.lit(0)) if tokens else count_tokens(said)
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), said.alias("text"), cost.cast("long").alias("tokens"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text", "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum("tokens").over(order))
    df = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "tokens", "upto"))).alias("turns"))
    df = df.withColumn("sums", F.concat(F.array(F.lit(0).cast("long")), F.transform("turns", lambda t: t["upto"])))
    df = df.withColumn("system", (F.get("turns", F.lit(0))["role"] == "system").cast("int"))
    head = F.col("system") * F.get("sums", F.lit(1))

    def first(i: Column) -> Column:
        """The first turn that is repeated before a span that starts with turn i; i itself if none fits."""
        options = (F.greatest(i - back, F.col("system")) for back in range(history, 0, -1))
        fits = [F.when(head + F.get("sums", i + 1) - F.get("sums", f) <= budget, f) for f in options]
        return F.when(i > F.col("system"), F.coalesce(*fits, i)).otherwise(i)

    df = df.withColumn("firsts", F.transform("turns", lambda _, i: first(i)))
    df = df.withColumn("starts", _spans(F.col("sums"), head, F.col("firsts"), budget))

    def window(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.size("turns"))
        since = F.get("firsts", start)
        lead = F.when(start > 0, F.slice("turns", 1, F.col("system"))).otherwise(F.slice("turns", 1, 0))
        parts = F.concat(lead, F.slice("turns", since + 1, end - since))
        return F.struct(parts.alias("parts"), (F.size(lead) + start - since).alias("repeated"))

    df = df.select("conv_id", F.transform("starts", window).alias("cut"))

    def written(w: Column) -> Column:
        pieces = F.transform(w["parts"], lambda t: F.struct(_opening(t["role"]).alias("open"), escape(t["text"]).alias("body"), t["role"].alias("role")))
        return F.struct(pieces.alias("pieces"), w["repeated"].alias("repeated"))

    df = df.select("conv_id", F.transform("cut", written).alias("cut"))

    def done(w: Column) -> Column:
        text = F.array_join(F.transform(w["pieces"], lambda p: F.concat(p["open"], p["body"], F.lit("</s>"))), "")
        empty = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast("array<struct<start:int,size:int>>").alias("spans"))

        def step(s: Column, p: Column) -> Column:
            start, size = s["at"] + F.length(p["open"]), F.length(p["body"])
            target = (s["i"] >= w["repeated"]) & (p["role"] == "assistant")
            spans = F.when(target, F.concat(s["spans"], F.array(F.struct(start.alias("start"), size.alias("size"))))).otherwise(s["spans"])
            return F.struct((start + size + 4).alias("at"), (s["i"] + 1).alias("i"), spans.alias("spans"))

        return F.struct(text.alias("text"), w["repeated"].alias("repeated"), F.aggregate(w["pieces"], empty, step)["spans"].alias("loss"))

    return df.select("conv_id", F.transform("cut", done).alias("windows"))


def turns_of(window: Column) -> Column:
    """The turns that a formatted text holds."""
    found = F.regexp_extract_all(window, F.lit(r"<s>(\[[^\]]*\]\n[^<]*)</s>"), F.lit(1))
    return F.transform(found, lambda x: F.struct(unescape(F.regexp_extract(x, r"^\[([^\]]*)\]", 1)).alias("role"), unescape(F.regexp_replace(x, r"^\[[^\]]*\]\n", "")).alias("text")))


def read_back(df: DataFrame) -> DataFrame:
    """(conv_id, turns, loss, formatted_chars) from windows alone: each turn once, and the texts under the mask in order."""
    own = F.flatten(F.transform("windows", lambda w: F.slice(turns_of(w["text"]), w["repeated"] + 1, F.greatest(F.size(turns_of(w["text"])) - w["repeated"], F.lit(0)))))
    loss = F.flatten(F.transform("windows", lambda w: F.transform(w["loss"], lambda s: unescape(F.substring(w["text"], s["start"] + 1, s["size"])))))
    chars = F.aggregate("windows", F.lit(0).cast("long"), lambda s, w: s + F.length(w["text"]))
    return df.select("conv_id", own.alias("turns"), loss.alias("loss"), chars.alias("formatted_chars"))
