"""MinHash near-dedup by BagMinHash: weighted-Jaccard signatures, bands, and exact overlaps of multisets.

A document is the multiset of its runs of five words. The similarity of two is sum(min) / sum(max) of their counts.
Documents of one to four words are one run of all their words; documents without words are like no other.

Signatures. Each run owns Poisson processes over its weight axis, cut at the powers of two: [0,1), [1,2), [2,4), ...
A process has the rate of its interval's width and makes points in rising order, each with a register and a place
within its interval; a point counts if its place is below the run's count. That is the hierarchy: whole intervals are
one process each, and only the last one is thinned. The register of a document keeps its least point, and processes
stop at the largest register, so the work is O(runs + m log m), not O(runs * m). Two documents agree in a register with
exactly the probability of their weighted similarity.

Links. Copies of one text are one node. Two nodes are candidates if they agree in a band of registers: two of similarity
s do so but for (1 - s**ROWS)**BANDS, 3e-6 at 0.8. Nodes that share a band are a bucket, and all pairs of a bucket count:

1. Stars. The centre of a bucket is the node with the most company in all its bands, which a text that others were
   copied from is. Each node is compared with the most central of its buckets' centres: one comparison for a node.
   Components of the links that are found are labels, and most near copies have one label now.
2. The rest. Buckets whose nodes have several labels are compared in full, but for pairs within their main label; equal
   buckets are compared once. The nodes of other labels meet all nodes of the bucket.

Both are dealt in tasks of two parts of bounded bytes each, by the multisets themselves, so no group is too large for a
task and none is compared by sampling. Only the second step is quadratic, in nodes of one bucket that no star has joined.
A task returns only links that join what it has not joined yet. Components of all links are the classes.

Null texts count as empty. Keys must be integers, else TypeError. Rows without a key have no class. Rows that repeat a key share a class. Columns beside key
and text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import chunks, components, forget, integer_key, stored, utf8
from .words import mix, window_hashes, word_hashes

WIDTH = 5
ROWS, BANDS = 5, 32
REGISTERS = ROWS * BANDS
#: Bytes of text of a part of a group, on average; a task holds two parts.
PART_BYTES = 1 << 20
#: Documents whose signatures are made together.
TOGETHER = 256


def bag(raw: bytes, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of a text, as 64-bit hashes in rising order, and their counts."""
    words = word_hashes(raw)
    return np.unique(window_hashes(words, max(1, min(width, len(words)))), return_counts=True)


def _uniform(bits: np.ndarray) -> np.ndarray:
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """The registers of each bag, one row each: the least point of the accepted ones; infinite for an empty bag."""
    out = np.full(len(bags) * registers, np.inf)
    runs = np.concatenate([np.zeros(0, np.uint64), *(b[0] for b in bags)])
    counts = np.concatenate([np.zeros(0, np.int64), *(b[1] for b in bags)])
    docs = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    seeds, owner, start, limit = [], [], [], []
    level, left = 0, np.arange(len(runs))
    while len(left):  # level 0 is [0, 1), level k is [2**(k-1), 2**k)
        low = 0 if level == 0 else 1 << (level - 1)
        left = left[counts[left] > low]
        seeds.append(mix(runs[left] + np.uint64((level * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1))))
        owner.append(docs[left])
        start.append(np.full(len(left), max(1, low), dtype=np.float64))  # the interval's width and rate
        limit.append((counts[left] - low) / max(1, low))  # accepted places, as a share of the interval
        level += 1
    if not seeds:
        return out.reshape(len(bags), registers)
    seed, doc, rate, share = (np.concatenate(x) for x in (seeds, owner, start, limit))
    at = np.zeros(len(seed))
    turn = 0
    while len(seed):
        turn += 1
        bits = mix(seed + np.uint64((turn * 0xD1B54A32D192ED03) & (2**64 - 1)))
        at = at - np.log(_uniform(bits)) / rate
        other = mix(bits ^ np.uint64(0xA0761D6478BD642F))
        register = (other >> np.uint64(32)).astype(np.int64) * registers >> 32
        place = (other & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32
        good = place < share
        np.minimum.at(out, doc[good] * registers + register[good], at[good])
        highest = out.reshape(len(bags), registers).max(axis=1)
        going = at < highest[doc]
        seed, doc, rate, share, at = (x[going] for x in (seed, doc, rate, share, at))
    return out.reshape(len(bags), registers)


def bands(signs: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash of each run of ``rows`` registers and its number, one row for each document."""
    parts = mix(signs.view(np.uint64).reshape(len(signs), -1, rows))
    total = np.zeros(parts.shape[:2], dtype=np.uint64)
    for k in range(rows):
        total = mix(total + parts[:, :, k])
    return mix(total + np.arange(parts.shape[1], dtype=np.uint64))


def _sketches(docs: DataFrame) -> DataFrame:
    """(id, copy, size, bands): a key for equal word sequences, the text's bytes, and its band hashes; empty without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = utf8(batch, "text")
            made: list[list[int]] = []
            for at in range(0, len(texts), TOGETHER):
                bags = [bag(x) for x in texts[at : at + TOGETHER]]
                made += [b if len(x[0]) else [] for b, x in zip(bands(signatures(bags)).view(np.int64).tolist(), bags, strict=True)]
            sizes = [len(x) for x in texts]
            copies = [sha256(b" ".join(x.split())).digest() for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(copies, pa.binary()), pa.array(sizes, pa.int64()), pa.array(made, pa.list_(pa.int64()))], names=["id", "copy", "size", "bands"])

    return docs.where("id IS NOT NULL").mapInArrow(run, "id long, copy binary, size long, bands array<long>")


class _Sets:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def verified(left: list[tuple[np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray]] | None, least: float) -> list[tuple[int, int]]:
    """Pairs (place on the left, place on the right) of at least that similarity which span all that such pairs connect.

    Without a right side, the pairs within the left one. Each bag on the left meets all others in one pass over them.
    """
    others = left if right is None else right
    sizes = np.array([len(b[0]) for b in others])
    runs, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *(b[0] for b in others)]), return_inverse=True)
    counts = np.concatenate([np.zeros(0, np.int64), *(b[1] for b in others)])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    totals = np.array([b[1].sum() for b in others])
    held = np.zeros(len(runs), dtype=np.int64)
    sets, found = _Sets(len(left) + len(others)), []
    base = 0 if right is None else len(left)
    for i, (own, own_counts) in enumerate(left):
        first = i + 1 if right is None else 0
        if first >= len(others):
            break
        place = np.searchsorted(runs, own)
        known = place < len(runs)
        known[known] = runs[place[known]] == own[known]
        held[place[known]] = own_counts[known]
        shared = np.minimum(held[at[ends[first] :]], counts[ends[first] :])
        both = np.add.reduceat(shared, ends[first:-1] - ends[first]) if len(shared) else np.zeros(0)
        held[place[known]] = 0
        near = np.flatnonzero(both >= least * (own_counts.sum() + totals[first:] - both) - 1e-9) + first
        found += [(i, int(j)) for j in near if sets.join(i, base + int(j))]
    return found


def _compared(cast: DataFrame, bodies: DataFrame, least: float) -> DataFrame:
    """Links (a, b) from ``cast`` (bucket, node, label, part, low, high): a node of a part meets those of parts low to high.

    A pair of parts is a task; within one part, all its pairs. A task whose nodes all have one label has no rows.
    ``bodies`` (node, text) has the texts of all nodes.
    """

    def verify(key: tuple, rows: pa.Table) -> pa.Table:
        _, p, q = (x.as_py() for x in key)
        ids, labels, part = rows["node"].to_pylist(), rows["label"].to_pylist(), rows["part"].to_pylist()
        one, two = ([k for k in range(len(ids)) if part[k] == w] for w in (p, q))
        pairs = []
        if len(set(labels)) > 1 and one and two:
            bags = [bag(x or b"") for x in rows["text"].cast(pa.binary()).to_pylist()]
            pairs = verified([bags[k] for k in one], None if p == q else [bags[k] for k in two], least)
        found = [(ids[one[i]], ids[(one if p == q else two)[j]]) for i, j in pairs]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    met = cast.join(bodies.hint("merge"), "node").select("bucket", "node", "label", "part", "text", F.explode(F.sequence("low", "high")).alias("other"))
    met = met.select("bucket", "node", "label", "part", "text", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
    return met.groupBy("bucket", "p", "q").applyInArrow(verify, "a long, b long")


def _dealt(parts: str, first: int | str = 0) -> Column:
    """The part of a node, of so many from the first on."""
    first = F.col(first) if isinstance(first, str) else F.lit(first)
    return (first + F.pmod(F.xxhash64("node"), F.col(parts))).cast("int")


def _parts(size: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(size / PART_BYTES)).cast("int")


def _stars(shared: DataFrame) -> DataFrame:
    """``cast`` of step 1 from (band, node, size, n): part 0 is the centre, the others hold the nodes that go to it."""
    central = shared.groupBy("node").agg(F.sum("n").alias("company"))
    ranked = shared.join(central, "node")
    centres = ranked.groupBy("band").agg(F.max(F.struct("company", "node")).alias("c")).select("band", "c")
    own = ranked.join(centres, "band").groupBy("node").agg(F.max("c").alias("c"), F.max("size").alias("size"))
    own = stored(own.select("node", "size", F.col("c.node").alias("bucket")).where("node <> bucket"), "stars")
    groups = own.groupBy("bucket").agg(_parts(F.sum("size")).alias("parts"))
    ends = own.join(groups, "bucket").select("bucket", "node", F.col("node").alias("label"), _dealt("parts", 1).alias("part"), F.lit(0).alias("low"), F.lit(0).alias("high"))
    return ends.unionByName(groups.select("bucket", F.col("bucket").alias("node"), F.col("bucket").alias("label"), F.lit(0).alias("part"), F.lit(1).alias("low"), F.col("parts").alias("high")))


def _rest(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """``cast`` of step 2: the first parts hold the nodes beside the bucket's main label, and meet all; the others hold its own."""
    tagged = shared.join(labels.toDF("node", "component"), "node", "left").select("band", "node", "size", F.coalesce("component", "node").alias("label"))
    mark = lambda salt: F.bit_xor(F.xxhash64("node", F.lit(salt)))
    several = tagged.groupBy("band").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n"), mark(1).alias("m1"), mark(2).alias("m2")).where("least < most")
    once = several.groupBy("n", "m1", "m2").agg(F.min("band").alias("band")).select("band")
    still = stored(tagged.join(once, "band"), "open")
    by_label = still.groupBy("band", "label").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    sides = by_label.groupBy("band").agg(F.max(F.struct("n", "label", "bytes")).alias("main"), F.sum("bytes").alias("bytes"))
    sides = sides.select("band", F.col("main.label").alias("main"), _parts(F.col("bytes") - F.col("main.bytes")).alias("others"), _parts(F.col("main.bytes")).alias("own"))
    met = still.join(sides, "band").withColumn("is_main", F.col("label") == F.col("main"))
    part = F.when(F.col("is_main"), _dealt("own", "others")).otherwise(_dealt("others"))
    high = F.when(F.col("is_main"), F.col("others") - 1).otherwise(F.col("others") + F.col("own") - 1)
    return met.select(F.col("band").alias("bucket"), "node", "label", part.alias("part"), F.lit(0).alias("low"), high.alias("high"))


def links(docs: DataFrame, least: float = 0.8, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The sketches' membership (id, node) and the links (a, b) between nodes; a node is the least id of its copies."""
    docs = docs.select(integer_key(docs, key).alias("id"), F.col(text).alias("text"))
    sketches = stored(_sketches(docs), "sketches")
    worded = sketches.where(F.size("bands") > 0)
    nodes = stored(worded.groupBy("copy").agg(F.min("id").alias("node"), F.max("size").alias("size"), F.first("bands").alias("bands")), "nodes")
    members = stored(sketches.join(nodes.select("copy", "node"), "copy", "left").select("id", F.coalesce("node", "id").alias("node")), "members")
    forget(sketches)

    banded = nodes.select("node", "size", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(banded.join(buckets, "band"), "shared")
    # all texts are shuffled once, at any size; both steps read those of nodes that share a band, and no others
    wanted = shared.select(F.col("node").alias("id")).distinct()
    bodies = stored(docs.join(wanted.hint("merge"), "id").select(F.col("id").alias("node"), "text"), "bodies")
    stars = stored(_compared(_stars(shared), bodies, least), "links")
    rest = stored(_compared(_rest(shared, components(stars)), bodies, least), "links")
    forget(shared, nodes, bodies)
    return members, stars.union(rest)


def classes(docs: DataFrame, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id) for each row: the least key of the documents that a chain of links connects; null without a key."""
    members, found = links(docs, least, key, text)
    of_node = members.where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b"))
    repeated = members.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("a", "b")
    joined = components(found.union(repeated))
    nodes = of_node.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("node"))
    ids = docs.select(integer_key(docs, key).alias("id"))
    own = ids.join(nodes, "id", "left").select("id", F.coalesce("node", "id").alias("node"))
    return own.join(joined, "node", "left").select(F.col("id").alias(key), F.coalesce("component", "node").alias("class_id"))


def dedup(docs: DataFrame, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The first document of each class with all its columns; of rows that repeat a key, one stays. Rows without a key stay."""
    kept = classes(docs, least, key, text).where(f"`{key}` = class_id").select(key).distinct()
    return docs.join(kept, key, "left_semi").dropDuplicates([key]).unionByName(docs.where(F.col(key).isNull())).select(docs.columns)
