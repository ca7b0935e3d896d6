"""LM scoring: a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

Tokens are words with A-Z in lower case, and one end for each text. Counts cover every training text: workers count,
Spark adds up. The model predicts classes: each of the most frequent tokens is one, every other token belongs to one of
``RARE`` classes by its last two bytes, and shares its class's probability by its own count plus one, where all unknown
tokens of a class count as one more type. Hence the probabilities of all tokens, known and unknown, sum to one. How many
tokens and classes there are is a parameter of ``score``; the counts within classes grow with the corpus.

The score of a class after two others is the product of its vector with a linear map of theirs, plus a bias that starts
at the log of its share, so the untrained model is the unigram model. Training texts are dealt in parts of about
``PART_TOKENS`` tokens by a hash of key and text, so parts don't depend on files or the cluster. In each of ``ROUNDS`` rounds
every part trains from the same start on its share of texts with NCE, noise shared within a batch, and the parameters are
averaged by trained tokens in a tree of bounded groups and start the next round: every training text takes part once, and
the driver gets one set of parameters however many texts there are.
Scores are normalised exactly: log normalisers of pairs of classes are kept in a table.

Counts of the ``KNOWN`` most frequent tokens, a bounded table, go to the workers. Other tokens are joined with their
counts; none of them can be hot, as so many tokens are more frequent. Rows are told apart by a number given when
partial scores are stored, so repeated rows and keys are scored one by one. Null texts count as empty and have the
end only; a null key counts as the empty text in the choice of training rows. Without training tokens all counts are
0 and the scores still defined; an empty table gives an empty result. Columns beside key and text are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import chunks, forget, stored, utf8

#: The end of a text; no word is empty.
END = b""
FREQUENT, RARE, KNOWN = 896, 128, 65_536
#: Longer tokens are never in the table of known ones, which bounds its bytes.
KNOWN_BYTES = 64
DIM, BATCH, NOISE, RATE, SEED = 24, 2048, 96, 0.08, 7
#: Tokens that a worker counts before it passes them on; sets of parameters that are averaged at once.
COUNTED, AVERAGED = 300_000, 64
#: Tokens of a part, rounds of averaging, and tokens of texts that are shuffled together within a part.
PART_TOKENS, ROUNDS, SHUFFLED = 1 << 21, 2, 1 << 16


def tokens(raw: bytes) -> list[bytes]:
    return [*raw.lower().split(), END]


def held_out(key: str = "id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 7 == 2, F.lit(False))


def count(docs: DataFrame) -> DataFrame:
    """(token, c) of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["token", "c"])

        seen: Counter[bytes] = Counter()
        for batch in chunks(batches):
            for raw in utf8(batch, "text"):
                seen.update(tokens(raw))
            if len(seen) > COUNTED:
                yield made()
                seen.clear()
        yield made()

    return docs.select("text").mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """Parameters: vectors of classes as context and as target, a map for each place of the context, biases."""

    context: np.ndarray
    maps: np.ndarray
    target: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, log_share: np.ndarray) -> Model:
        rng, n = np.random.default_rng(SEED), len(log_share)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        return cls(small(n, DIM), np.stack([np.eye(DIM, dtype=np.float32)] * 2), small(n, DIM), log_share.astype(np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.maps, self.target, self.bias]

    def pack(self) -> bytes:
        return np.concatenate([x.ravel() for x in self.parts()]).astype("<f4").tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> Model:
        flat = np.frombuffer(raw, dtype="<f4").copy()
        n = (len(flat) - 2 * DIM * DIM) // (2 * DIM + 1)
        a, b, c = n * DIM, n * DIM + 2 * DIM * DIM, 2 * n * DIM + 2 * DIM * DIM
        return cls(flat[:a].reshape(n, DIM), flat[a:b].reshape(2, DIM, DIM), flat[b:c].reshape(n, DIM), flat[c:])


def _gathered(rows: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows that have the same index."""
    order = np.argsort(index.astype(np.int16), kind="stable")  # there are fewer classes than 2**15; two bytes sort by radix
    found, first = np.unique(index[order], return_index=True)
    out = np.zeros((n, rows.shape[1]), dtype=np.float32)
    out[found] = np.add.reduceat(rows[order], first, axis=0)
    return out


class Trainer:
    """NCE by AdaGrad over batches of (second last, last, next) classes."""

    def __init__(self, model: Model, log_share: np.ndarray) -> None:
        self.model, self.rng = model, np.random.default_rng(SEED)
        self.offset = (log_share + np.log(NOISE)).astype(np.float32)
        self.ends = np.cumsum(np.exp(log_share))
        self.sums = [np.full(x.shape, 0.1, dtype=np.float32) for x in model.parts()]

    def step(self, last2: np.ndarray, last: np.ndarray, word: np.ndarray) -> None:
        m, n = self.model, len(self.model.bias)
        noise = np.minimum(np.searchsorted(self.ends, self.rng.random(NOISE) * self.ends[-1]), n - 1)
        r2, r1 = m.context[last2], m.context[last]
        hidden = r2 @ m.maps[0] + r1 @ m.maps[1]
        q, qn = m.target[word], m.target[noise]
        up = lambda s: 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        g = up(np.einsum("ij,ij->i", hidden, q) + m.bias[word] - self.offset[word]) - 1
        gn = up(hidden @ qn.T + (m.bias[noise] - self.offset[noise]))
        dh = g[:, None] * q + gn @ qn
        d_target = _gathered(np.concatenate([g[:, None] * hidden, gn.T @ hidden]), np.concatenate([word, noise]), n)
        d_bias = np.bincount(word, g, n) + np.bincount(noise, gn.sum(axis=0), n)
        d_maps = np.stack([r2.T @ dh, r1.T @ dh])
        d_context = _gathered(np.concatenate([dh @ m.maps[0].T, dh @ m.maps[1].T]), np.concatenate([last2, last]), n)
        for x, d, total, damp in zip(m.parts(), (d_context, d_maps, d_target, d_bias), self.sums, (1.0, 0.05, 1.0, 1.0), strict=True):
            d = (d / len(word) * 16).astype(np.float32)
            total += d * d
            x -= RATE * damp * d / np.sqrt(total)


class Tails(dict):
    """Last two bytes of a rare token to -1 - its class; there are 65,793 of them at most."""

    def __init__(self, frequent: int, rare: int) -> None:
        super().__init__()
        self.frequent, self.rare = frequent, rare

    def __missing__(self, tail: bytes) -> int:
        self[tail] = code = -1 - self.frequent - zlib.crc32(tail) % self.rare
        return code


def _places(known: dict[bytes, int], tails: Tails, words: list[bytes]) -> np.ndarray:
    """The places of known tokens, and -1 - their class for others."""
    return np.array([known[w] if w in known else tails[w[-2:]] for w in words], dtype=np.int64)


def _classes(frequent: dict[bytes, int], tails: Tails, words: list[bytes]) -> np.ndarray:
    at = _places(frequent, tails, words)
    return np.where(at < 0, -1 - at, at)


def _average(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("part")
    weights = np.array(rows["seen"].to_pylist(), dtype=np.float64)
    total = sum(w * np.frombuffer(x, dtype="<f4").astype(np.float64) for w, x in zip(weights, rows["packed"].to_pylist(), strict=True))
    packed = (total / weights.sum()).astype("<f4").tobytes()
    return pa.table({"part": pa.array([min(rows["part"].to_pylist())], pa.int64()), "seen": pa.array([int(weights.sum())], pa.int64()), "packed": pa.array([packed], pa.binary())})


def train(docs: DataFrame, frequent: dict[bytes, int], tails: Tails, log_share: np.ndarray, n_tokens: int) -> Model:
    """From texts (id, text) of so many tokens; the same for any partitioning of them."""
    end, parts, schema = frequent[END], max(1, -(-n_tokens // PART_TOKENS)), "part long, seen long, packed binary"
    n_frequent, n_rare = tails.frequent, tails.rare
    h = F.xxhash64("id", "text")

    def trained(start: bytes):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trainer, seen, own, lines, held, part = Trainer(Model.unpack(start), log_share), 0, Tails(n_frequent, n_rare), [], 0, 0

            def learn() -> None:
                lasts2, lasts, nexts = (np.concatenate([x[k : len(x) - 2 + k] for x in lines]) for k in range(3))
                order = trainer.rng.permutation(len(nexts))
                for at in range(0, len(order), BATCH):
                    some = order[at : at + BATCH]
                    trainer.step(lasts2[some], lasts[some], nexts[some])

            for batch in chunks(batches):
                part = batch.column("part")[0].as_py()
                for raw in utf8(batch, "text"):
                    lines.append(np.concatenate([[end, end], _classes(frequent, own, tokens(raw))]))
                    held += len(lines[-1]) - 2
                    if held >= SHUFFLED:
                        learn()
                        seen, lines, held = seen + held, [], 0
            if lines:
                learn()
                seen += held
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seen], pa.int64()), pa.array([trainer.model.pack()], pa.binary())], names=["part", "seen", "packed"])

        return run

    model = Model.fresh(log_share)
    for turn in range(ROUNDS):
        some = docs.select("text", h.alias("h")).where(F.pmod("h", F.lit(ROUNDS)) == turn)
        some = some.select("text", "h", F.pmod(F.shiftrightunsigned("h", 8), F.lit(parts)).cast("int").alias("part"))
        dealt = some.repartitionById(parts, "part").sortWithinPartitions("h", "text").select("text", "part")
        sets = stored(dealt.mapInArrow(trained(model.pack()), schema), "parameters")
        while (n := sets.count()) > 1:
            fewer = stored(sets.groupBy(F.pmod(F.xxhash64("part"), F.lit(-(-n // AVERAGED)))).applyInArrow(_average, schema), "parameters")
            forget(sets)
            sets = fewer
        got = sets.collect()
        forget(sets)
        model = Model.unpack(bytes(got[0].packed)) if got else model
    return model


class Scorer:
    """Natural log probabilities of classes; normalisers of pairs of classes are made when first wanted.

    The score is linear in either place of the context, so it is the sum of two table entries and the bias.
    """

    def __init__(self, model: Model) -> None:
        self.bias, self.n = model.bias, len(model.bias)
        self.second, self.first = ((model.context @ m) @ model.target.T for m in model.maps)
        self.norms = np.full(self.n * self.n, np.nan, dtype=np.float32)

    def __call__(self, last2: np.ndarray, last: np.ndarray, word: np.ndarray) -> np.ndarray:
        pair = last2 * self.n + last
        norms = self.norms[pair]
        if len(new := np.unique(pair[np.isnan(norms)])):
            for at in range(0, len(new), 256):
                some = new[at : at + 256]
                scores = self.second[some // self.n] + self.first[some % self.n] + self.bias
                top = scores.max(axis=1)
                self.norms[some] = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
            norms = self.norms[pair]
        return (self.second[last2, word] + self.first[last, word] + self.bias[word] - norms).astype(np.float64)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", n_frequent: int = FREQUENT, n_rare: int = RARE) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row; scores are log10 probabilities.

    ``n_frequent`` tokens are classes of their own, all others share ``n_rare`` classes; time and memory of a worker grow with
    the square of their sum, which is 32,767 at most.
    """
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).withColumn("held_out", held_out())
    learning = docs.where("NOT held_out")
    counts = stored(count(learning), "counts")
    n_all, n_kinds = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    short = counts.where(F.length("token") <= KNOWN_BYTES)
    # counts fall in steps of a sixteenth of a doubling; of the top steps as many are known as KNOWN tokens hold
    step = F.floor(16 * F.log2("c")).cast("int")
    sizes = sorted(((r.k, r.n) for r in short.groupBy(step.alias("k")).agg(F.count("*").alias("n")).collect()), reverse=True)
    lowest = min((k for (k, _), n in zip(sizes, np.cumsum([n for _, n in sizes]), strict=True) if n <= KNOWN), default=None)
    known = {bytes(r.token): r.c for r in short.where(step >= lowest).collect()} if lowest is not None else {}
    known[END] = (counts.where(F.col("token") == F.lit(bytearray(END))).agg(F.sum("c")).first()[0]) or 0
    ranked = sorted(known, key=lambda w: (w != END, -known[w], w))[:n_frequent]
    frequent = {w: i for i, w in enumerate(ranked)}
    of_rare = {r.k: (r.n, r.v) for r in counts.where(~F.col("token").isin([bytearray(w) for w in ranked])).groupBy((F.crc32(F.substring("token", -2, 2)) % n_rare).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    rare = np.array([of_rare.get(k, (0, 0)) for k in range(n_rare)], dtype=np.float64)
    mass = np.concatenate([[known[w] for w in ranked], [0] * (n_frequent - len(ranked)), rare[:, 0]]) + 1.0
    log_share = np.log(mass / mass.sum())

    spark = docs.sparkSession
    model = train(learning, frequent, Tails(n_frequent, n_rare), log_share, n_all)
    words = list(known)
    shared = spark.sparkContext.broadcast((model.pack(), words, np.array([known[w] for w in words]), frequent))
    # log10 of what a token's count plus one is divided by within its class; a frequent token is alone in its class
    below = np.concatenate([np.zeros(n_frequent), np.log10(rare.sum(axis=1) + 1)])
    base_below = float(np.log10(n_all + n_kinds + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, words, c, frequent = shared.value
        place = {w: i for i, w in enumerate(words)}
        tails = Tails(n_frequent, n_rare)
        classes, logs, end = _classes(frequent, tails, words), np.log10(c + 1.0), frequent[END]
        scorer = Scorer(Model.unpack(packed))
        row = TaskContext.get().partitionId() << 40
        for batch in chunks(batches):
            out: dict[str, list] = {k: [] for k in ("row", "n_tokens", "n_known", "base", "own", "others")}
            for raw in utf8(batch, "text"):
                said = tokens(raw)
                at = _places(place, tails, said)
                other = np.flatnonzero(at < 0)
                line = np.empty(len(at) + 2, dtype=np.int64)
                line[:2] = end
                rare_at = -1 - at[other]
                at[other] = 0
                line[2:] = classes[at]
                line[2 + other] = rare_at
                log_c = logs[at]
                log_c[other] = 0
                word = line[2:]
                within = np.where(word < n_frequent, 0, log_c) - below[word]
                out["row"].append(row)
                out["n_tokens"].append(len(said))
                out["n_known"].append(int((c[at] > 0).sum() - (c[at[other]] > 0).sum()))
                out["base"].append(float(log_c.sum()) - base_below * len(said))
                out["own"].append(float(scorer(line[:-2], line[1:-1], word).sum()) / np.log(10) + float(within.sum()))
                out["others"].append(list(Counter(said[k] for k in other.tolist()).items()))
                row += 1
            kinds = {"row": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "own": pa.float64()}
            columns = [pa.array(out[k], t) for k, t in kinds.items()]
            pairs = [{"token": w, "times": t} for x in out["others"] for w, t in x]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in out["others"]])])
            held = pa.array(pairs, pa.struct([("token", pa.binary()), ("times", pa.int64())]))
            columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), held))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), *columns], names=["id", "held_out", *out])

    schema = f"id {docs.schema['id'].dataType.simpleString()}, held_out boolean, row long, n_tokens long, n_known long, base double, own double, others array<struct<token: binary, times: long>>"
    partial = stored(docs.mapInArrow(run, schema), "scored")
    others = partial.select("row", F.explode("others").alias("o")).select("row", "o.token", "o.times")
    added = others.join(counts, "token", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("met"))
    more, met = F.coalesce("more", F.lit(0.0)), F.coalesce("met", F.lit(0))
    return partial.join(added, "row", "left").select(
        F.col("id").alias(key), "held_out", "n_tokens", (F.col("n_known") + met).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("own") + more).alias("score")
    )
