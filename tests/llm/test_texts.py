"""Substring dedup, byte-level BPE and training order."""

import glob
import hashlib
import os
import random
import time

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from sparrel.llm import bpe, catalog, shards, substrings, tables

from tests import oracle

from . import brute

PATH = P.path(catalog.VOCABULARY)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def official():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def _passages(seed: int, n: int = 60) -> list[tuple[int | None, str | None]]:
    """Texts that share passages, with copies, ties, runs of one word, nulls and blanks."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    shared = [" ".join(rng.choice(words) for _ in range(rng.randint(8, 40))) for _ in range(6)]
    rows: list[tuple[int | None, str | None]] = []
    for i in range(n):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))]
        rows.append((i, rng.choice([" ", "\n", "\t"]).join(parts)))
    rows += [(n, rows[3][1]), (n + 1, rows[3][1]), (n + 1, rows[3][1]), (n + 2, None), (n + 3, ""), (n + 4, " \n\t "), (None, rows[3][1]), (n + 5, "same " * 60), (n + 6, "x " + "same " * 35 + "y"), (n + 7, "ab cd " * 30), (5, rows[8][1]), (n + 8, "é\x00ü  " * 20)]
    return rows


def _by_text(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("width", [2, 10, 11])
def test_substring_dedup_equals_brute_force(spark, width):
    rows = _passages(width)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, passage string, owner int")
    got = [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in substrings.dedup(df, width).collect()]
    want = brute.substring_dedup(rows, width)
    assert sum(w[2] for w in want) > 100
    assert _by_text(got) == _by_text(want)


def test_repeated_words_cost_no_more_than_others():
    """Passages and documents of one repeated word, or of a few: all hits of equal surroundings are one."""
    rng = random.Random(4)
    for period in (1, 2, 7, 30):
        words = [b"w%d" % rng.randrange(9) for _ in range(period)]
        for n, m, lead in ((60, 55, 0), (400, 130, 3), (51, 49, 0), (50, 700, 1)):
            passage, doc = (words * 700)[:n], [b"x"] * lead + (words * 700)[3 : 3 + m] + [b"y"]
            got = substrings.Automaton([(1, b" ".join(passage)), (1, b" ".join(passage))], 50).covered(2, doc)
            held = {tuple(passage[k : k + 50]) for k in range(n - 49)}
            want = np.zeros(len(doc), dtype=bool)
            for k in range(len(doc) - 49):
                if tuple(doc[k : k + 50]) in held:
                    want[k : k + 50] = True
            assert got.tolist() == want.tolist()
    start = time.perf_counter()
    long = [b"same"] * 120_000
    assert substrings.Automaton([(1, b" ".join(long))], 50).covered(2, long).all()
    assert time.perf_counter() - start < 30


def test_substring_dedup_of_an_empty_table(spark):
    assert substrings.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_op1_on_the_driver_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in catalog.op1_substring_dedup(spark, SF).collect()}
    want = {i: (n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in brute.substring_dedup(docs, 50)}
    assert got == want


def test_sql_of_op1(spark):
    assert oracle.differences(catalog.op1_substring_dedup(spark, SF), oracle.connect(SF), catalog.SQL["op1_substring_dedup"]) == ""


def test_merges_equal_the_reference_library(official):
    rng = random.Random(1)
    ranks = bpe.read_ranks(PATH)
    signs = "ab éß漢字🙂\n\t'0\x00the"
    for n in [0, 1, 2, 3, 7, 50, 400, 3000]:
        for _ in range(6):
            text = "".join(rng.choice(signs) for _ in range(n))
            codec = bpe.Codec(PATH, P.PATTERN)
            ids = np.frombuffer(codec.encode(text), "<u4").tolist()
            assert ids == official.encode_ordinary(text)
            assert codec.decode(np.array(ids, "<u4").tobytes()) == text.encode()
    long = "a" * 20_000 + "b" * 7
    assert bpe.merge(long.encode(), ranks) == official.encode_ordinary(long)


def test_bpe_rows(spark, official):
    texts = [(1, None), (1, ""), (None, "tie tie"), (2, "tie tie"), (2, "tie tie"), (3, "x" * 5000)]
    df = spark.createDataFrame([(i, t, 7) for i, t in texts], "doc_id long, text string, ids int")
    out = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded).decode()) for r in bpe.round_trip(df, PATH, P.PATTERN).collect()]
    assert _by_text(out) == _by_text((i, official.encode_ordinary(t or ""), t or "") for i, t in texts)
    coded = bpe.encode(df, PATH, P.PATTERN)
    back = bpe.decode(coded, PATH, P.PATTERN)
    assert sorted(bytes(r.decoded).decode() for r in back.collect()) == sorted(t or "" for _, t in texts)
    assert bpe.encode(df.limit(0), PATH, P.PATTERN).count() == 0


def test_op2_on_the_driver_table(spark, official):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in catalog.op2_byte_bpe(spark, SF).collect():
        ids = official.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_feistel_is_a_permutation(n):
    one, two = shards.feistel(np.arange(n), n, 1), shards.feistel(np.arange(n), n, 2)
    assert sorted(one) == sorted(two) == list(range(n))
    assert n < 64 or (one != two).mean() > 0.9 and (one != np.arange(n)).mean() > 0.9


def test_training_order_and_shards(spark, official, tmp_path):
    docs = [(1, "one two three " * 40), (None, None), (2, ""), (2, "tie"), (2, "tie")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, slot int").repartition(3)
    out = shards.ordered(df, PATH, P.PATTERN, length=16, per_shard=4).cache()
    rows = out.collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert all(r.shard == r.slot // 4 and r.byte_offset == r.slot % 4 * 33 for r in rows)
    held = {}
    for r in rows:
        held.setdefault((r.doc_id, r.n_tokens if r.part else 0), []).append(r)
    one = sorted((r for r in rows if r.doc_id == 1), key=lambda r: r.part)
    ids = np.concatenate([np.frombuffer(r.ids, "<u2")[: r.n_tokens] for r in one]).tolist()
    assert ids == [*official.encode_ordinary(docs[0][1]), 50_256]
    folder = str(tmp_path / "shards")
    shards.write(out, folder)
    read = {r.slot: bytes(r.ids) for r in shards.read(spark, folder, 16, 4).collect()}
    assert read == {r.slot: bytes(r.ids) for r in rows}
    assert sorted(r.slot for r in shards.read(spark, folder, 16, 4, first=5).collect()) == list(range(5, len(rows)))
    assert shards.ordered(df.where("false"), PATH, P.PATTERN).count() == 0


def test_slots_do_not_depend_on_partitions(spark):
    rows = [(k % 40 if k % 7 else None, None if k % 11 == 0 else f"text {k % 50} " * (k % 30)) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (sorted((r.slot, r.doc_id, r.part, r.n_tokens, bytes(r.ids)) for r in shards.ordered(df.repartition(n), PATH, P.PATTERN, 16, 8).collect()) for n in (3, 17))
    assert one == two


def test_ids_must_fit(spark, tmp_path):
    df = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    with pytest.raises(ValueError):
        shards.ordered(df, PATH, P.PATTERN, end=70_000)
    with pytest.raises(ValueError):
        shards.ordered(df.withColumnRenamed("doc_id", "part"), PATH, P.PATTERN, key="part")
    row = shards.materialised(df, PATH, P.PATTERN, str(tmp_path / "w"), 4, 2, end=70_000, id_bytes=4).first()
    back = shards.read(spark, str(tmp_path / "w"), 4, 2, id_bytes=4).first()
    assert np.frombuffer(back.ids, "<u4")[row.n_tokens - 1] == 70_000 and hashlib.sha256(back.ids).hexdigest() == row.ids_sha256


def test_op8_gives_every_slot_once(spark):
    df = catalog.op8_training_order(spark, SF)
    n, lo, hi, kinds = df.agg(F.count("*"), F.min("slot"), F.max("slot"), F.countDistinct("slot")).first()
    assert (lo, hi, kinds) == (0, n - 1, n)


def test_op8_writes_shards_and_digests_what_it_reads_back(spark):
    folder = tables.scratch_dir(spark).removeprefix("file://")
    before = set(glob.glob(f"{folder}/shards-*"))
    rows = catalog.op8_training_order(spark, SF).collect()
    (made,) = set(glob.glob(f"{folder}/shards-*")) - before
    files = {int(f.split("shard=")[1].split("/")[0]): f for f in glob.glob(f"{made}/shard=*/part-*")}
    assert sum(os.path.getsize(f) for f in files.values()) == len(rows) * 1025
    for r in rows:
        with open(files[r.shard], "rb") as f:
            f.seek(r.byte_offset)
            assert hashlib.sha256(f.read(1024)).hexdigest() == r.ids_sha256
    assert [r.slot for r in rows] == sorted(r.slot for r in rows)


def test_shards_written_in_waves(spark, tmp_path):
    df = spark.createDataFrame([(i, "some words here " * (i % 9)) for i in range(60)], "doc_id long, text string").repartition(3)
    rows = shards.materialised(df, PATH, P.PATTERN, str(tmp_path / "s"), 16, 4).collect()
    assert len({r.shard for r in rows}) > shards.WAVES and [r.slot for r in rows] == list(range(len(rows)))
    back = {r.slot: hashlib.sha256(bytes(r.ids)).hexdigest() for r in shards.read(spark, str(tmp_path / "s"), 16, 4).collect()}
    assert back == {r.slot: r.ids_sha256 for r in rows}
    assert shards.materialised(df.where("false"), PATH, P.PATTERN, str(tmp_path / "e")).count() == 0
