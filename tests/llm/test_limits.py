"""Very long texts, empty tables and nulls in any column, through every operator and the pipeline."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparrel.llm import bpe, chat, decontam, lm, neardup, pii, quality, shards, substrings, urls

from . import brute
from .test_corpus import ITEM
from .test_texts import PATH, P

WORDS = " ".join(f"w{k * 7919 % 100_003}" for k in range(120_000))
LOOP = "again and " * 60_000
SOLID = "x1" * 300_000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, WORDS, "a"), (2, WORDS + f" {ITEM}", None), (3, LOOP, "a"), (4, SOLID, "b"), (6, "same " * 120_000, "a"), (7, "same " * 120_000 + "end", "b"), (5, "+1" * 50_000 + "a@" * 50_000 + "1." * 50_000, "b"), (None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).cache()


def test_long_texts_in_substring_dedup(docs):
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.dedup(docs).select("doc_id", "n_words", "n_removed").collect()}
    assert got[1] == (120_000, 0) and got[2][1] == 120_000 and got[3] == (120_000, 0) and got[4] == (1, 0) and got[None] == (0, 0) and got[6][1] == 0 and got[7] == (120_001, 120_000)


def test_long_texts_in_near_dedup(docs):
    assert {r.doc_id: r.class_id for r in neardup.classes(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, None: None}


def test_long_texts_in_statistics(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.with_statistics(docs).drop("text").collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.quality(texts[r.doc_id])


def test_long_texts_elsewhere(spark, docs):
    assert lm.score(docs).count() == 8
    assert {r.doc_id for r in decontam.contaminated(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).collect()} == {2}
    assert {r.doc_id: len(r.base) for r in pii.find(docs).collect() if r.doc_id != 5} == {1: 0, 2: 0, 3: 0, 4: 0, 6: 0, 7: 0, None: 0}
    assert {r.doc_id: bytes(r.decoded).decode() for r in bpe.round_trip(docs, PATH, P.PATTERN).collect()} == {r.doc_id: r.text or "" for r in docs.collect()}
    assert shards.ordered(docs.where("doc_id < 4"), PATH, P.PATTERN).agg(F.countDistinct("slot") == F.count("*")).first()[0]
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), "text")
    assert {r.conv_id: r.loss[0] for r in chat.read_back(chat.windows(turns)).collect()} == {r.doc_id: r.text or "" for r in docs.collect()}
    links = docs.select("doc_id", F.concat(F.lit("http://h.org/"), "text").alias("url"))
    assert urls.judge(links, urls.rules("block org/w0"), urls.Model(urls.np.zeros(urls.BUCKETS), -1.0)).where("verdict = 'block'").count() == 2


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, None, None, None, None), (1, "", "", "", 0), (2, " ".join(f"w{k}" for k in range(80)), "en", None, 9), (2, " ".join(f"w{k}" for k in range(80)), "en", None, 9), (None, " ".join(f"v{k}" for k in range(80)), None, None, None)]])
def test_pipeline_of_odd_tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in out) == ([(False, 2), (True, None)] if rows else [])


def test_clashing_columns_in_every_stage(spark, tmp_path):
    names = ["id", "class_id", "node", "n_words", "kept", "rule", "item", "item_id", "anchor", "component", "ids", "copy"]
    df = spark.createDataFrame([(2, " ".join(f"w{k}" for k in range(80)), *range(len(names)))], ", ".join(["doc_id long, text string", *(f"{n} int" for n in names)]))
    spark.createDataFrame([(2, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert [tuple(r) for r in out.collect()] == [tuple(r) for r in df.collect()], name
    assert corpus_pipeline.STAGES[-1][1](spark, out, str(tmp_path)).count() == 1
