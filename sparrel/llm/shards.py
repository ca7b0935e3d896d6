"""Training-order output: every sequence of token ids gets a global slot, and shards are slots in order.

Texts become ids of a byte-level vocabulary, an end id is added, and the ids are cut into sequences of ``length``; the
last one of a text is padded with the end id. Before that, rows are range-partitioned and sorted by key, then a hash of the
text, so that sequences are numbered in an order that neither files nor the cluster decide: a count for each partition,
added up, and a place within it. Rows that repeat a key and a text may change places, which nothing shows. A keyed Feistel
network permutes the numbers 0 to n-1: a value that falls outside walks on along its cycle until it is inside, so the slots
are exactly 0 to n-1. The same rows and keys give the same slots, so a run that was lost can be made again from any slot on.

Range partitions by slot then hold neighbouring slots: shard ``slot // per_shard``, at the byte offset
``slot % per_shard * (id_bytes * length + 1)``, as records end with a line feed. Record k of a shard needs no index, so a
reader can go on from any slot.

Null texts count as empty and make one sequence, the end alone. Keys may be null or repeat; each row has its own
sequences. Columns beside key and text are not read; a key named like another column of the result is a ValueError. Ids
that ``id_bytes`` bytes can't hold are a ValueError before anything is read. An empty table makes no sequence and no shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import read_ranks
from .tables import chunks, shuffles_end, stored
from .words import mix

ROUNDS = 6
#: Ranges that slots are dealt in at most; beyond it a range has several shards.
MOST_TASKS = 20_000
#: Parts in which all shards are written one after the other.
WAVES = 4
_MADE = ("part", "partition", "place", "slot", "shard", "byte_offset", "n_tokens", "ids", "ids_sha256", "before")


def feistel(values: np.ndarray, n: int, key: int) -> np.ndarray:
    """The place of each of 0..n-1 in a permutation of them that the key chooses."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    low, bits = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(key & (2**64 - 1)))

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> bits, x & low
        for k in keys:
            a, b = b, a ^ (mix(b + k) & low)
        return a << bits | b

    out = once(values.astype(np.uint64))
    outside = np.flatnonzero(out >= np.uint64(n))
    while len(outside):
        out[outside] = once(out[outside])
        outside = outside[out[outside] >= np.uint64(n)]
    return out.astype(np.int64)


def sequences(docs: DataFrame, path: str, pattern: str, length: int, end: int, key: str = "doc_id", text: str = "text", id_bytes: int = 2) -> DataFrame:
    """(key, part, partition, place, n_tokens, ids): ids are ``length`` little-endian unsigned integers of ``id_bytes`` bytes.

    By partition and place, the rows are in the order of key and hash of the text.
    """
    if key in _MADE:
        raise ValueError(f"a key can't be named {key}")
    if max(end, *read_ranks(path).values()) >= 1 << 8 * id_bytes:
        raise ValueError(f"the vocabulary has ids that {id_bytes} bytes can't hold")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={}).encode_ordinary
        partition, place = TaskContext.get().partitionId(), 0
        for batch in chunks(batches):
            rows, parts, sizes, packed = [], [], [], []
            for k, words in enumerate(batch.column(1).to_pylist()):
                ids = [*encode(words), end]
                full = np.full(-(-len(ids) // length) * length, end, dtype=f"<u{id_bytes}")
                full[: len(ids)] = ids
                for part in range(len(full) // length):
                    rows.append(k)
                    parts.append(part)
                    sizes.append(min(length, len(ids) - part * length))
                    packed.append(full[part * length : (part + 1) * length].tobytes())
            places = np.arange(place, place + len(rows))
            place += len(rows)
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(parts, pa.int64()), pa.array([partition] * len(rows), pa.int64()), pa.array(places), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "part", "partition", "place", "n_tokens", "ids"])

    held = docs.select(F.col(key).alias("_key"), F.coalesce(text, F.lit("")).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    # the last column only parts rows that are equal, so that very many of them don't meet in one range
    held = held.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange("_key", "_hash", "_row").sortWithinPartitions("_key", "_hash")
    return held.select("_key", "_text").mapInArrow(run, f"`{key}` {kind}, part long, partition long, place long, n_tokens long, ids binary")


def _numbered(docs: DataFrame, path: str, pattern: str, length: int, end: int, key: str, text: str, id_bytes: int) -> tuple[DataFrame, int]:
    """The stored sequences, with the number of those that earlier partitions have, and how many there are."""
    made = stored(sequences(docs, path, pattern, length, end, key, text, id_bytes), "sequences", "zstd")
    sizes = made.groupBy("partition").agg(F.count("*").alias("n"))
    # two numbers for each partition that was read: their running sum fits in a task, and in a broadcast
    before = sizes.select("partition", (F.sum("n").over(Window.orderBy("partition")) - F.col("n")).alias("before"))
    return made.join(F.broadcast(before), "partition"), made.count()


def _placed(numbered: DataFrame, total: int, stride: int, per_shard: int, order_key: int, columns: list[str]) -> DataFrame:
    """``columns`` of the sequences with their slot, shard and byte_offset."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("before").to_numpy() + batch.column("place").to_numpy()
            slot = pa.array(feistel(number, total, order_key))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(columns))), slot], names=[*columns, "slot"])

    schema = ", ".join(f"`{c}` {numbered.schema[c].dataType.simpleString()}" for c in columns)
    placed = numbered.select(*columns, "place", "before").mapInArrow(slots, f"{schema}, slot long")
    return placed.withColumns({"shard": (F.col("slot") / per_shard).cast("long"), "byte_offset": F.col("slot") % per_shard * stride})


def _dealt(placed: DataFrame, first: int, shards: int) -> DataFrame:
    """Range-partitioned and sorted by slot; the shards are so many from ``first`` on, each within one partition."""
    # ranges of equally many shards: slots are dense, so their bounds are known and nothing is sampled
    tasks = min(shards, MOST_TASKS)
    return placed.repartitionById(tasks, F.floor((F.col("shard") - first) * tasks / shards).cast("int")).sortWithinPartitions("shard", "slot")


def ordered(docs: DataFrame, path: str, pattern: str, length: int = 512, per_shard: int = 4096, end: int = 50_256, order_key: int = 20_240_601, key: str = "doc_id", text: str = "text", id_bytes: int = 2) -> DataFrame:
    """(key, part, slot, shard, byte_offset, n_tokens, ids), range-partitioned and sorted by slot, a shard within one partition."""
    numbered, total = _numbered(docs, path, pattern, length, end, key, text, id_bytes)
    stride = id_bytes * length + 1
    placed = _placed(numbered, total, stride, per_shard, order_key, [key, "part", "n_tokens", "ids"])
    return _dealt(placed, 0, max(1, -(-total // per_shard))).select(key, "part", "slot", "shard", "byte_offset", "n_tokens", "ids")


def materialised(docs: DataFrame, path: str, pattern: str, folder: str, length: int = 512, per_shard: int = 4096, end: int = 50_256, order_key: int = 20_240_601, key: str = "doc_id", text: str = "text", id_bytes: int = 2) -> DataFrame:
    """Writes all shards to ``folder`` and gives (key, part, slot, shard, byte_offset, n_tokens, ids_sha256) in the order of slots.

    The digests are of the records as read back. Shards are written in ``WAVES``, so only a part of the sequences lies in
    shuffle files beside the stored sequences and the shards. An empty table writes no shard.
    """
    spark = docs.sparkSession
    numbered, total = _numbered(docs, path, pattern, length, end, key, text, id_bytes)
    stride = id_bytes * length + 1
    shards = -(-total // per_shard)
    waves = min(WAVES, shards)
    for wave in range(waves):
        low, high = shards * wave // waves, shards * (wave + 1) // waves
        part = _placed(numbered, total, stride, per_shard, order_key, ["ids"]).where(F.col("shard").between(low, high - 1))
        with shuffles_end(spark):
            _dealt(part, low, high - low).select(F.col("ids").cast("string").alias("value"), "shard").write.mode("append").partitionBy("shard").text(folder)
    placed = _placed(numbered, total, stride, per_shard, order_key, [key, "part", "n_tokens"])
    empty = spark.createDataFrame([], "slot long, ids binary")
    back = (read(spark, folder, length, per_shard, id_bytes=id_bytes) if shards else empty).select("slot", F.sha2("ids", 256).alias("ids_sha256"))
    return _dealt(placed.join(back.hint("merge"), "slot", "left"), 0, max(1, shards)).select(key, "part", "slot", "shard", "byte_offset", "n_tokens", "ids_sha256")


def write(frame: DataFrame, folder: str) -> None:
    """Raw shards ``folder/shard=<n>/part-*``: a record for each slot, its ids and nothing else but a line feed at the end.

    Spark's own writer of text commits the files, so they reach any file system that Spark does and a lost task leaves none.
    """
    rows = frame.select("slot", "shard", F.col("ids").cast("string").alias("value"))
    rows = rows.repartitionByRange(F.col("shard")).sortWithinPartitions("shard", "slot").select("value", "shard")
    rows.write.partitionBy("shard").text(folder)


def read(spark: SparkSession, folder: str, length: int, per_shard: int, first: int = 0, id_bytes: int = 2) -> DataFrame:
    """(slot, ids) of written shards from slot ``first`` on; only the shards that hold them are opened."""
    stride = id_bytes * length + 1
    files = spark.read.format("binaryFile").load(folder).where(F.col("shard") >= first // per_shard)
    records = files.select(F.col("shard").cast("long").alias("shard"), "content", F.explode(F.sequence(F.lit(0), (F.length("content") / stride).cast("int") - 1)).alias("k"))
    return records.select((F.col("shard") * per_shard + F.col("k")).alias("slot"), F.substring("content", F.col("k") * stride + 1, F.lit(id_bytes * length)).alias("ids")).where(F.col("slot") >= first)
