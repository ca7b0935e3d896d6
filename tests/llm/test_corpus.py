"""Near-dedup, language-model scores, decontamination, and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparrel.llm import catalog, decontam, lm, neardup, pii, quality, tables

from . import brute

SF = "/root/testdata/sf0.001"


def _copies(seed: int) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    rows: list[tuple[int | None, str | None]] = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 7)):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    n = len(rows)
    loop = "a b c d e f " * 30
    return [*rows, (n, rows[0][1]), (n + 1, rows[0][1].replace(" ", "\n")), (n + 2, None), (n + 3, ""), (n + 4, "one two"), (n + 5, "one  two"), (n + 6, "one three"), (None, rows[0][1]), (3, rows[20][1]), (n + 7, loop), (n + 8, loop + "a b"), (n + 9, "a b c d e f a b c d e")]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_classes_equal_brute_force(spark, seed):
    rows = _copies(seed)
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, node int")
    got = sorted(map(repr, ((r.doc_id, r.class_id) for r in neardup.classes(df).collect())))
    want = brute.near_classes(rows, 0.8)
    assert len(set(want)) < len(rows) - 10
    assert got == sorted(map(repr, ((i, c) for (i, _), c in zip(rows, want, strict=True))))


def test_parts_of_a_group_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PART_BYTES", 300)
    rows = _copies(3)
    got = {(r.doc_id, r.class_id) for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == set(zip((i for i, _ in rows), brute.near_classes(rows, 0.8), strict=True))


def test_registers_agree_as_often_as_bags_are_similar():
    rng = np.random.default_rng(3)
    runs = rng.integers(0, 2**63, 60, dtype=np.uint64)
    runs.sort()
    a, b = (runs[:50], rng.integers(1, 9, 50)), (runs[10:], rng.integers(1, 9, 50))
    wanted = brute.similarity(dict(zip(*map(list, a), strict=True)), dict(zip(*map(list, b), strict=True)))
    one, two = neardup.signatures([a, b], 4000)
    assert abs((one == two).mean() - wanted) < 4 * math.sqrt(wanted * (1 - wanted) / 4000)
    assert np.isinf(neardup.signatures([(runs[:0], a[1][:0])])).all()


def test_near_dedup_keeps_one_of_each_class(spark):
    rows = _copies(4)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, class_id string")
    kept = neardup.dedup(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for c in brute.near_classes(rows, 0.8) if c is not None})
    assert ids.count(None) == 1
    assert neardup.classes(df.where("false")).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.component for r in tables.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}


def _said() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    kinds = ["the cat sat on the mat".split(), "der hund lief durch den wald".split()]
    rows = [(i, " ".join(rng.choice(kinds[i % 2]) for _ in range(rng.randint(5, 60)))) for i in range(150)]
    return [*rows, (150, None), (151, ""), (None, "The THE unseen"), (7, "tie"), (7, "tie"), (9, "rare " * 3)]


def test_counts_and_base_scores(spark):
    rows = _said()
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    got = sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm.score(df).collect())
    split = [(i, [*"".join(c.lower() if c < "\x80" else c for c in t or "").split(), ""]) for i, t in rows]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, words in split if not out(i) for w in words)
    n, v = sum(c.values()), len(c)
    want = sorted((repr(i), out(i), len(words), sum(c[w] > 0 for w in words), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words), 6)) for i, words in split)
    assert got == want


def test_model_beats_the_base_on_held_out_texts(spark):
    rows = catalog.op4_lm_scores(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert (rows.s - rows.b) / rows.n > 0.02


def test_training_is_not_cut_to_a_budget():
    assert (lm.BATCH, lm.NOISE, lm.RATE) == (2048, 96, 0.08)
    share = np.log(np.full(8, 1 / 8))
    assert np.allclose(lm.Trainer(lm.Model.fresh(share), share).offset, np.log(96 / 8))


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "PART_TOKENS", 900)
    df = spark.createDataFrame(_said(), "doc_id long, text string")
    one, two = (sorted((repr(r.doc_id), r.n_tokens, round(r.score, 6)) for r in lm.score(df.repartition(n), n_frequent=40, n_rare=8).collect()) for n in (3, 17))
    assert one == two and len(one) == len(_said())


def test_probabilities_add_up():
    share = np.log(np.full(lm.FREQUENT + lm.RARE, 1 / (lm.FREQUENT + lm.RARE)))
    model = lm.Model.fresh(share)
    assert np.allclose(lm.Model.unpack(model.pack()).target, model.target)
    n = len(share)
    p = np.exp(lm.Scorer(model)(np.full(n, 3), np.full(n, 5), np.arange(n)))
    assert abs(p.sum() - 1) < 1e-4


def test_rows_without_training_texts(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r.train_tokens, r.n_known, r.n_tokens, r.base_score) == (0, 0, 3, 0.0) and math.isfinite(r.score)
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


ITEM = "A train leaves Paris at 9 with 120 people and travels 300 km before it stops in Lyon where half of the people get off"


def test_reparameterised_questions(spark):
    changed = ITEM.replace("120", "77").replace("300 km", "450 miles").replace("Lyon", "Nice").replace("Paris", "Rome")
    twisted = "in front of Rome 5 people and Rome 5 people went to Nice, said nobody at all, while others were at home for lunch"
    rows = [(1, f"Some text before. {ITEM}. And after."), (2, f"intro words, {changed} more"), (3, twisted), (4, None), (5, ""), (6, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18"), (None, ITEM), (1, ITEM), (7, ITEM[: len(ITEM) // 4])]
    items = [(10, ITEM), (11, None), (12, "too short"), (None, ITEM), (13, "exactly nine plain words stand in this one here"), (10, ITEM)]
    docs = spark.createDataFrame([*[(i, t, 0) for i, t in rows], (8, "before that exactly nine plain words stand in this one here you see", 0)], "doc_id long, text string, item int")
    found = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(found) == {(1, 10), (2, 10), (8, 13)}
    assert not found[1, 10].changed_slots and found[2, 10].changed_slots
    assert found[1, 10].matched_words == found[1, 10].item_words
    kept = decontam.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 3, 4, 5, 6, 7]


def test_words_are_found_whatever_they_are(spark):
    """Items that are short, of numbers, in title case or in capitals; names of other lengths, and at the start of a sentence."""
    items = ["3 1 4 1 5 9 2 6 5 3 5 8", "who wrote it first", "The Old Man And The Sea Was Written By A Man From Oak Park Illinois", "Alice Smith has 5 apples and gives 2 of them to her friend before they walk home again", "der Hund lief mit dem Ball durch den Wald bis an den See und schlief im Gras"]
    rows = [f"so {items[0]} then", f"say {items[1]}?", items[2].lower(), items[2].upper(), f"Well. {items[3].replace('Alice Smith', 'Bob').replace('5', '7')}", items[4].lower(), "nothing of the kind stands in this text at all, which has words of its own only", "3 1 4 1 5 9 2 6 5 3 5 9", "who wrote her first"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = decontam.contaminated(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(0, 0), (1, 1), (2, 2), (3, 2), (4, 3), (5, 4)}
    assert {r.doc_id for r in found if r.changed_slots} == {4}
    with pytest.raises(TypeError):
        decontam.contaminated(spark.createDataFrame([("x", "y")], "doc_id string, text string"), docs.withColumnRenamed("doc_id", "item_id"))


def _consistent_by_trial(item: list[bytes], doc: list[bytes], slots: list[bool]) -> set[tuple[int, int]]:
    def fits(a, b):
        pairs = {(item[k], doc[k]) for k in range(a, b) if slots[k]}
        return len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs})

    n = len(item)
    good = {(a, b) for a in range(n) for b in range(a + 1, n + 1) if fits(a, b)}
    return {(a, b) for a, b in good if (a - 1, b) not in good and (a, b + 1) not in good}


def test_slots_must_stand_one_for_one():
    item = b"x gives 5 apples to y and then 5 pears to z before 7 plums go to w again"
    good, bad = item.replace(b"5", b"8"), item.replace(b"5 apples", b"8 apples")
    assert decontam.aligned(good, item)[0] == len(item.split())
    assert decontam.aligned(bad, item) == (16, 19, False)
    rng = random.Random(8)
    for _ in range(300):
        n = rng.randint(1, 12)
        item, doc = ([rng.choice([b"1", b"2", b"3"]) for _ in range(n)] for _ in range(2))
        slots = [rng.random() < 0.7 for _ in range(n)]
        assert set(decontam._consistent(item, doc, np.array(slots))) >= _consistent_by_trial(item, doc, slots)


def test_a_document_is_read_once_for_all_items():
    """Items that share a passage with one document: each gets what it would get alone."""
    rng = random.Random(5)
    lead = " ".join(f"w{k}" for k in range(14))
    items = [f"{lead} Anna has {rng.randrange(99)} apples and gives {k} of them to Bob before the end of day".encode() for k in range(40)] + [b"", b"same " * 20, lead.encode()]
    doc = (f"x {lead} Emma has 7 apples and gives 3 of them to Carl before the end of day " + "same " * 300).encode()
    read = decontam.Read(doc)
    got = [decontam.aligned(read, x) for x in items]
    assert got == [decontam.aligned(doc, x) for x in items]
    assert all(m == n for m, n, _ in got[-2:]) and got[-3] == (0, 0, False) and all(m >= 14 for m, *_ in got[:40]) and any(c for *_, c in got)
    assert decontam.aligned(b"", items[0])[0] == 0


def test_empty_sides(spark):
    docs, items = spark.createDataFrame([(1, ITEM)], "doc_id long, text string"), spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert decontam.contaminated(docs.where("false"), items).count() == decontam.contaminated(docs, items.where("false")).count() == 0


def test_op6_equals_a_search_for_whole_items(spark):
    clean = lambda t: [w.strip("""!"'()*+,-./:;<=>?[]^_`{|}~""").lower() for w in (t or "").split()]
    items = {r.item_id: " ".join(clean(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        text = f" {' '.join(clean(r.text))} "
        want |= {(r.doc_id, i) for i, t in items.items() if f" {t} " in text}
    assert {(r.doc_id, r.item_id) for r in catalog.op6_decontamination(spark, SF).collect()} == want


def test_pipeline_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rules = quality.fit(df, spark.read.parquet(f"{SF}/labels.parquet"))
    first = {r.doc_id for r in quality.judge(df, rules).where("kept").collect()}
    rows = [(i, docs[i]) for i in sorted(first)]
    second = {c for c in brute.near_classes(rows, 0.8)}
    leaks = {r.doc_id for r in catalog.op6_decontamination(spark, SF).collect()}
    third = second - leaks
    trees = pii.fit(df.where(F.col("doc_id").isin(list(third))))
    want = {i: pii.redacted(docs[i], sum(pii.all_spans(docs[i], trees), [])) for i in third}
    out = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.columns == df.columns, name
    assert {r.doc_id: r.text for r in out.collect()} == want
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SF).collect()}
    assert got.keys() == want.keys() and all(n > 0 for n in got.values())
