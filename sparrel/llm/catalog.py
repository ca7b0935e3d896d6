"""The queries of this subpackage, each over a whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, lm, neardup, pii, quality, shards, substrings, urls
from .tables import bounded_batches, scratch_dir

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of each document without the passages that an earlier one has."""
    out = substrings.dedup(_table(spark, sf_dir, "documents"), width=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of each document and of the bytes decoded from them."""
    out = bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each document."""
    return neardup.classes(_table(spark, sf_dir, "documents"), least=0.8)


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of each document under unigram counts and under the model."""
    return lm.score(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of each document."""
    docs = _table(spark, sf_dir, "documents")
    rules = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.judge(docs.select("doc_id", "text"), rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark, with its item."""
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


URL_RULES = """
block com/en/
allow example.com/en/7
allow net/de/
block example.net/de/8
block org/es/
"""


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on each page's url."""
    pages, held = _table(spark, sf_dir, "pages").select("page_id", "url"), urls.rules(URL_RULES)
    return urls.judge(pages, held, urls.fit(urls.labelled_by(pages, held))).select("page_id", "host", "path", "rule", "verdict")


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot of each sequence of token ids, in the order of slots, with a digest of its record in the written shards."""
    folder = f"{scratch_dir(spark)}/shards-{uuid.uuid4().hex}"
    return shards.materialised(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, folder)


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of base spans of each document, and all spans."""
    found = pii.find(_table(spark, sf_dir, "documents"))
    order = F.array(*map(F.lit, pii.KINDS))

    def said(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    every = F.transform(F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(F.array_position(order, s["kind"]).alias("k"), s["start"].alias("start"), s.alias("s")))), lambda x: x["s"])
    counts = [F.size(F.filter("base", _is(kind))).cast("long").alias(f"n_{kind}") for kind in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(every).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each conversation as read back from its formatted windows."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat.read_back(chat.windows(rows))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


_ALL = (op1_substring_dedup, op2_byte_bpe, op3_near_dedup, op4_lm_scores, op5_quality_rules, op6_decontamination, op7_url_filter, op8_training_order, op9_personal_data, op10_chat_format)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

#: Only substring dedup is within SQL's reach on whole tables: the others learn, tokenise, template or fold.
SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS words FROM documents),
windows AS (SELECT doc_id, i, sha256(array_to_string(words[i:i + 49], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)),
firsts AS (SELECT h, min(doc_id) AS owner FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN firsts USING (h) WHERE owner < doc_id),
said AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
kept AS (SELECT said.doc_id, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY said.p) FILTER (WHERE gone.p IS NULL) AS text FROM said LEFT JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
""",
}
