"""Quality rules, url filter, personal data and chat format."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrel.llm import catalog, chat, pii, quality, tables, urls

from . import brute

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x x x x", "x x x x x y", "l\nl\n\nl\r\nl", "# * $ % & | < >", "é\x0bü\x0cß", "a\x00b a\x00b", "tie tie tie tie", "A! B! C!", "a b c d a b c e b c d"]


def test_statistics_equal_brute_force(spark):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("ab \n#É") for _ in range(rng.randint(0, 300))) for _ in range(60)] + ["one two three " * 2000]
    df = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)], "doc_id long, text string, n_words int")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = {r.doc_id: tuple(r[n] for n in names) for r in quality.with_statistics(df).collect()}
    assert got == {k: brute.quality(t) for k, t in enumerate(texts)}


def test_rules_find_what_is_planted():
    rng = random.Random(3)
    rows = []
    for _ in range(900):
        r = dict.fromkeys(quality.RATIOS, 0.0) | {"chars_per_word": rng.uniform(3, 7), "capitals_per_char": rng.uniform(0, 0.2), "bad": 0}
        if rng.random() < 0.2:
            r |= {"symbols_per_char": rng.uniform(0.2, 0.6), "bad": 1} if rng.random() < 0.5 else {"capitals_per_char": rng.uniform(0.8, 1), "bad": 1}
        rows.append(r)
    rules = quality.learn(rows)
    verdicts = [any(all(c.fits(r) for c in rule) for rule in rules) for r in rows]
    assert [int(v) for v in verdicts] == [r["bad"] for r in rows]
    assert quality.learn([]) == quality.learn([r for r in rows if not r["bad"]]) == []
    assert "symbols_per_char" in " ".join(str(c) for rule in rules for c in rule)


def test_verdicts_and_kept_columns(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, long, 9), (2, None, 9), (3, "a b c " * 40, 9), (None, long, 9), (1, long, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    assert sorted((r.doc_id or 0, r.kept) for r in quality.judge(df, []).collect()) == [(0, True), (1, True), (1, True), (2, False), (3, False)]
    assert quality.keep(df, []).columns == df.columns and sorted(r.n_words for r in quality.keep(df, []).collect()) == [9, 9, 9]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(df, labels) == [] and quality.keep(df.where("false"), []).count() == 0


def test_op5_on_the_driver_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = catalog.op5_quality_rules(spark, "/root/testdata/sf0.01").collect()
    for r in rows:
        n, chars, symbols, lines, repeated = brute.quality(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeated)
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n) and (not r.kept or not r.base_failed)
    judged = [(labels[r.doc_id], r.kept) for r in rows if r.doc_id in labels and not r.base_failed]
    assert sum(q == 1 and not k for q, k in judged) <= 0.02 * len(judged)


URLS = [None, "", "no scheme", "http://", "http://A.Com/en/1", "https://x.com/en", "x://com/en/9?q#f", "http://example.com/en/7", "http://a.example.com/en/78", "http://example.com/en/8", "ftp://notexample.com/en/1", "http://b.net/de/3", "http://example.net/de/80?x", "http://org/es/", "http://net?de/", "http://h#/en/", "a://b://c/d", "http://ünï.org/es/ß\n2", "http://" + "x" * 5000 + ".org/fr/"]


def test_hosts_paths_and_rules(spark):
    held = urls.rules(catalog.URL_RULES)
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(URLS)], "page_id long, url string, host string")
    out = {r.page_id: r for r in urls.judge(pages, held, urls.fit(urls.labelled_by(pages, held))).collect()}
    for k, u in enumerate(URLS):
        h, p = brute.url(u)
        fits = [r for r in held if (h == r.host or h.endswith("." + r.host)) and p.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        assert (out[k].host, out[k].path, out[k].rule) == (h, p, best.name if best else None)
        assert out[k].verdict == best.verdict if best else out[k].verdict in ("block", "allow")
    none = urls.fit(urls.labelled_by(pages.where("false"), held))
    assert {r.verdict for r in urls.judge(pages, [], none).collect()} == {"allow"}


def test_regression_learns_from_n_grams(spark):
    rng = random.Random(4)
    make = lambda bad: f"http://{'casino' if bad else 'library'}{rng.randint(1, 99)}.example.org/{rng.choice(['a', 'b', 'c'])}/{rng.randint(1, 999)}"
    rows = [(make(k % 2), k % 2) for k in range(600)]
    train, test = rows[:400], rows[400:]
    model = urls.fit(spark.createDataFrame(train, "url string, label int"))
    out = urls.judge(spark.createDataFrame(test, "url string, label int"), [], model)
    assert out.where((F.col("verdict") == "block") == (F.col("label") == 1)).count() >= 195
    assert urls.judge(out, [], model).where("verdict = 'block'").count() <= len(test)


def test_base_spans_equal_the_expressions():
    rng = random.Random(6)
    texts = ["", "a@b.c", "a@b@c.de.f", "@x.y", "x@.y", "1.2.3.4.5.6.7.8", "256.1.1.1 01.002.0003.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+12", "+1 234 5678 90123456", "a.b@c-d.e-f.g@h.i"]
    for signs in ("a@.-1 ", "0123456789. ", "0123456789 -", "+0123456789 ().-", "ab1@.+-% \n"):
        texts += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 120))) for _ in range(400)]
    for t in texts:
        assert sorted(pii.base_spans(t)) == sorted(brute.pii(t)), t


def test_trees_tell_templated_rows_apart():
    rng, trees = random.Random(99), pii.trained()
    rows = [pii._row(rng) for _ in range(2000)]
    found = [any(a[0] == s[0] and a[1] < s[2] and s[1] < a[2] for a in pii.all_spans(t, trees)[1]) for t, s, _ in rows]
    hit = sum(f and g for f, (*_, g) in zip(found, rows, strict=True))
    wrong = sum(f and not g for f, (*_, g) in zip(found, rows, strict=True))
    assert hit >= 0.8 * sum(g for *_, g in rows) and wrong <= 0.03 * hit


def test_candidates_have_no_longest_length():
    for n in (15, 200, 201, 5000):
        key = ("k3Yx" * n)[:n]
        assert ("secret", 9, 9 + n) in pii.candidates("password=" + key)
    assert ("secret", 10, 17) in pii.candidates("password: hunter!") and ("secret", 0, 20) in pii.candidates("ABCDEFGHIJabcdefghij")
    assert ("email", 3, 23) in pii.candidates("to somebody at host.org now")
    name = "n" * 60
    assert ("email", 0, 60 + 14) in pii.candidates(f"{name} (at) host.com")
    assert pii.candidates("we met at noon. Then we left") == []
    text = "x1@y.org, " * 3000 + "password=" + "a9Bc" * 9
    base, added = pii.all_spans(text, pii.trained())
    assert len(base) == 3000 and added == [("secret", len(text) - 36, len(text))]


def test_trees_are_fitted_on_the_documents(spark):
    """Held-out candidates of the documents that base spans or cues label: what is added is right, and little is missed."""
    x, y = pii.sampled(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    third = len(y) // 3
    trees, held, wanted = pii.trained(x[third:], y[third:]), x[:third], y[:third]
    least = np.array([trees.least.get(pii.KINDS[int(k)], np.inf) for k in held[:, 0]])
    found, cued = trees.odds(held) >= least, held[:, pii.CUES].any(axis=1)
    print("rows", len(y), "precision", (wanted[found] == 1).mean(), "recall with cues", found[cued & (wanted == 1)].mean(), "without", found[~cued & (wanted == 1)].mean())
    assert third > 100 and (wanted[found] == 1).mean() >= 0.95 and found[cued & (wanted == 1)].mean() >= 0.9
    assert pii.fit(spark.createDataFrame([(1, None)], "doc_id long, text string")).least == pii.trained().least


def test_copies_take_no_place_in_the_sample(spark, monkeypatch):
    """Ten texts, one of them ten thousand times: the bound is on distinct texts, so all ten are read."""
    monkeypatch.setattr(pii, "SAMPLE_DOCS", 20)
    texts = [f'token = "{hashlib.sha256(str(k).encode()).hexdigest()}" here' for k in range(10)]
    some = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    many = some.union(spark.range(10_000).select(F.col("id") + 10, F.lit(texts[0])))
    (x, y), (x2, y2) = pii.sampled(some), pii.sampled(many)
    assert len(y) == 20 and np.array_equal(x, x2) and np.array_equal(y, y2)
    monkeypatch.setattr(pii, "SAMPLE_DOCS", 4)
    assert len(pii.sampled(some)[1]) <= 8


def test_find_and_redact(spark):
    rows = [(1, "mail bob@x.org or +1 (988) 555-2485 now"), (None, None), (2, ""), (2, "é 10.0.0.1 é"), (3, "plain words only"), (3, "plain words only")]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, kind string")
    found = {(r.doc_id, tuple(tuple(s) for s in r.base)) for r in pii.find(df).collect()}
    assert found == {(1, (("email", 5, 14), ("phone", 18, 35))), (None, ()), (2, ()), (2, (("ip", 2, 10),)), (3, ())}
    out = pii.redact(df)
    assert out.columns == df.columns
    assert sorted(str(r.text) for r in out.collect()) == sorted(["mail [EMAIL] or [PHONE] now", "None", "", "é [IP] é", "plain words only", "plain words only"])
    assert pii.find(df.where("false")).count() == 0


def test_op9_on_the_driver_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in catalog.op9_personal_data(spark, SF).collect():
        base = brute.pii(docs[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.BASE_KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))


TURNS = [
    (1, 0, "system", "Be <brief> [ok] ~1"), (1, 1, "user", "one two three"), (1, 2, "assistant", "</s>[INST] ~0 four"), (1, 3, "user", "five " * 9), (1, 4, "assistant", "six " * 30), (1, 5, "user", ""), (1, 6, "assistant", None),
    (2, 0, "user", "hi"), (2, 0, "user", "hi"), (2, None, "assistant", "null first"), (None, 1, None, "no id"), (3, 0, "assistant", "word " * 200), (4, 0, "us]er\n~", "<s>[x]\ny</s>"),
]


@pytest.mark.parametrize(("budget", "history"), [(1, 0), (12, 1), (20, 2), (45, 3), (10_000, 2)])
def test_windows_read_back(spark, budget, history):
    df = spark.createDataFrame([(*t, 1) for t in TURNS], "conv_id long, turn long, role string, text string, turns int")
    cut = {r.conv_id: r.windows for r in chat.windows(df, budget, history).collect()}
    back = {r.conv_id: r for r in chat.read_back(chat.windows(df, budget, history)).collect()}
    count = lambda t: len(__import__("regex").findall(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]", t))
    for conv in {t[0] for t in TURNS}:
        own = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in TURNS if t[0] == conv))
        assert [tuple(t) for t in back[conv].turns] == [(r, x) for *_, r, x in own]
        assert list(back[conv].loss) == [x for *_, r, x in own if r == "assistant"]
        assert back[conv].formatted_chars == sum(len(w.text) for w in cut[conv])
        for k, w in enumerate(cut[conv]):
            parts = w.text.split("</s>")[:-1]
            fresh = len(parts) - w.repeated
            assert fresh >= 1 and (k > 0 or w.repeated == 0) and w.repeated <= history + 1
            if k and own[0][2] == "system":
                assert parts[0].startswith("<s>[system]")
            texts = [p.split("]\n", 1)[1].replace("~3", "]").replace("~2", "[").replace("~1", "<").replace("~0", "~") for p in parts]
            alone = len(parts) == 1 + (k > 0 and own[0][2] == "system")
            assert sum(map(count, texts)) <= budget or alone


def test_windows_keep_the_budget(spark):
    """Long turns shrink the history; counts of the caller's own are used."""
    rows = [(1, k, "user" if k % 2 else "assistant", "word " * 400, 4) for k in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost int")
    cut = chat.windows(df, 512, 2).first().windows
    assert [w.text.count("word") for w in cut] == [400] * 6 and [w.repeated for w in cut] == [0] * 6
    assert [w.repeated for w in chat.windows(df, 900, 2).first().windows] == [0, 1, 1, 1, 1]
    assert [w.text.count("word") for w in chat.windows(df, 12, 2, tokens="cost").first().windows] == [1200] * 4
    many = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("some words").alias("text"))
    assert chat.read_back(chat.windows(many, 100)).select(F.size("turns")).first()[0] == 20_000


def test_an_empty_table_of_turns(spark):
    assert chat.read_back(chat.windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_op10_on_the_driver_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    want = {}
    for conv in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == conv)
        loss = "".join(t or "" for _, r, t in own if r == "assistant")
        want[conv] = (len(own), hashlib.sha256("".join(f"{r}\n{t or ''}\n" for _, r, t in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in catalog.op10_chat_format(spark, SF).collect()}
    assert got == want


def test_samples_keep_the_keys_of_repeated_rows(spark):
    df = spark.range(40_000).select((F.col("id") % 50).alias("k"), (F.col("id") % 2).alias("label"))
    assert {r.k for r in tables.sample(df, "k", 100).collect()} == set(range(50))
    many = tables.sample(spark.range(5000).unionAll(spark.range(5000)), "id", 200).collect()
    assert len(many) == len({r.id for r in many}) == 200


def test_repeated_labels_and_urls_give_the_model_of_distinct_ones(spark):
    """Each row a thousand times: the bound is on distinct rows, so none is lost."""
    rng = random.Random(7)
    texts = [(k, " ".join(f"w{rng.randrange(10**6)}" + "###" * (k % 2) for _ in range(60))) for k in range(60)]
    docs, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(k, 1 - k % 2) for k in range(60)], "doc_id long, quality int")
    many = labels.crossJoin(spark.range(1000).select(F.lit(1).alias("one"))).drop("one")
    rules = quality.fit(docs, labels)
    assert rules and quality.fit(docs, many) == rules
    assert quality.fit(docs.union(docs).union(docs.where("doc_id = 1")), labels) == rules
    named = [df.withColumn("doc_id", F.format_string("k%02d", "doc_id")) for df in (docs, labels)]
    assert quality.fit(*named)
    urls_ = spark.createDataFrame([(f"http://{'bad' if k % 2 else 'good'}{k}.org/{k}", k % 2) for k in range(300)], "url string, label int")
    one, two = urls.fit(urls_), urls.fit(urls_.crossJoin(spark.range(1000).select(F.lit(1).alias("one"))).drop("one"))
    assert one.bias == two.bias and np.array_equal(one.weights, two.weights) and np.abs(one.weights).max() > 0
