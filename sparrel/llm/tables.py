"""Helpers that the operators of this subpackage share: scratch tables, blocks of rows and graph components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a block on average; a block is what one call of a grouped function holds in memory.
BLOCK_ROWS = 128


#: Rows of a batch that Spark hands to Python at most; texts are long, and both sides hold whole batches.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's rows to a batch to ``BATCH_ROWS``, if they are more."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "0")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``. Only a local master may do without one and gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="sparrel-")
        spark.sparkContext.setCheckpointDir(named)
    return named


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is executed meanwhile go as soon as it is done; the session's own setting comes back."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write a frame to the shared folder and read it again: its lineage ends there, and a lost executor loses nothing.

    The table stays until ``forget`` or the owner of the folder removes it.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with shuffles_end(spark):
        df.write.parquet(path, compression=codec)
    return spark.read.schema(schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Removes what ``stored`` has written for the frames, once nothing reads them any more."""
    for df in frames:
        root = scratch_dir(df.sparkSession).rstrip("/").split(":")[-1].lstrip("/")
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if f"/{root}/" in folder:
                path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def block_count(rows: int) -> int:
    """How many blocks hold so many rows: it grows with the rows, so a block does not."""
    return max(1, -(-rows // BLOCK_ROWS))


def block_of(key: Column, blocks: int) -> Column:
    """The block of a row, by a hash of its key; rows without a key share block 0."""
    return F.when(key.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(key), F.lit(blocks))).cast("long")


def integer_key(df: DataFrame, key: str) -> Column:
    """The key as a long; keys that aren't integers are an error at once, as ids are compared by their order."""
    if (kind := df.schema[key].dataType.simpleString()) not in ("bigint", "int", "smallint", "tinyint", "void"):
        raise TypeError(f"{key} must be an integer, not {kind}")
    return F.col(key).cast("long")


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The texts of a column as UTF-8, nulls as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that none holds much more than ``most`` bytes, but always a row."""
    for batch in batches:
        if batch.nbytes <= most or batch.num_rows < 2:
            yield batch
            continue
        step = max(1, batch.num_rows * most // batch.nbytes)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most so many of the distinct rows, the least by a hash of their key; all of them if they are no more.

    A filter on the hash comes first, so each task passes on a few rows and the driver never gets ``most`` from each. It
    passes all keys if they are at most twice as many, however often their rows are repeated.
    """
    h = F.xxhash64(key)
    share = min(1.0, 2 * most / max(1, df.select(h.alias("h")).distinct().count()))
    few = df.where(F.pmod(h, F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).distinct()
    return few.orderBy(h, *few.columns).limit(most)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b: long): rows (node, component), component being the least node.

    Nodes without an edge do not appear; null ends and loops are ignored. Each round gives every node the least label
    among its own and its neighbours', then lets it jump to the label of that label, so the rounds grow with the
    logarithm of a component's width. Labels are joined by a key that is unique on one side, hence a hub with very many
    edges makes as many rows as it has edges and no more. Tables of former rounds are removed.
    """
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = stored(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    for _ in range(rounds):
        offered = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("offer"))
        lower = labels.join(offered, "node").select("node", F.col("label").alias("old"), F.least("label", "offer").alias("label"))
        onward = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = stored(lower.join(onward, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        forget(labels)
        if after.where("old <> label").isEmpty():
            forget(both)
            return after.select("node", F.col("label").alias("component"))
        labels = after.select("node", "label")
    raise RuntimeError(f"components have not settled in {rounds} rounds")
