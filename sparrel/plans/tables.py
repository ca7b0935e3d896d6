"""The driver's tables as matrices. Keys are dense from 0, so a table's count is a dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frames import Dense, Sparse

FLAGS = ("A", "N", "R")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _entries(df: DataFrame, row: str, col: str, val: str | Column, batch: Column | None = None) -> DataFrame:
    return df.select((F.lit(0) if batch is None else batch).cast("long").alias("batch"), F.col(row).alias("row"), F.col(col).alias("col"), (F.col(val) if isinstance(val, str) else val).alias("val"))


def quantities(spark: SparkSession, sf_dir: str) -> Sparse:
    """Orders x parts, quantities; lines of one order and part are entries of their own."""
    return Sparse.of(_entries(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", "l_quantity"), table(spark, sf_dir, "orders").count(), table(spark, sf_dir, "part").count())


def quantities_by_flag(spark: SparkSession, sf_dir: str) -> Sparse:
    """The same for each return flag."""
    flag = F.array_position(F.array(*map(F.lit, FLAGS)), F.col("l_returnflag")) - 1
    return Sparse.of(_entries(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", "l_quantity", flag), table(spark, sf_dir, "orders").count(), table(spark, sf_dir, "part").count(), len(FLAGS))


def discounts(spark: SparkSession, sf_dir: str) -> Sparse:
    """Suppliers x parts, discounts added up."""
    return Sparse.of(_entries(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", "l_discount"), table(spark, sf_dir, "supplier").count(), table(spark, sf_dir, "part").count()).coalesced()


def discounts_by_flag(spark: SparkSession, sf_dir: str) -> Sparse:
    flag = F.array_position(F.array(*map(F.lit, FLAGS)), F.col("l_returnflag")) - 1
    return Sparse.of(_entries(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", "l_discount", flag), table(spark, sf_dir, "supplier").count(), table(spark, sf_dir, "part").count(), len(FLAGS)).coalesced()


def part_features(spark: SparkSession, sf_dir: str) -> Dense:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row"), F.col("p_size").cast("double").alias("a"), (F.col("p_retailprice") / 1000).alias("b"))
    return Dense.from_columns(part, ["a", "b"], table(spark, sf_dir, "part").count())


def supplier_features(spark: SparkSession, sf_dir: str) -> Dense:
    held = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row"), (F.col("s_acctbal") / 1000).alias("a"), F.col("s_nationkey").cast("double").alias("b"))
    return Dense.from_columns(held, ["a", "b"], table(spark, sf_dir, "supplier").count())


def order_features(spark: SparkSession, sf_dir: str) -> Dense:
    held = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"), (F.col("o_totalprice") / 100000).alias("a"))
    return Dense.from_columns(held, ["a"], table(spark, sf_dir, "orders").count())


def customers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Customer numbers as ``row``, and how many there are."""
    held = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row"))
    return held, held.count()


def lower(spark: SparkSession, sf_dir: str, n_batch: int = 1, unit: bool = False) -> Sparse:
    """Lower triangular: 2 + i % 5 + batch on the diagonal, 0.5 + (i % 3) / 4 below it, -0.25 seven further."""
    held, n = customers(spark, sf_dir)
    i = F.col("row")
    cells = [F.struct((i - 1).alias("col"), (0.5 + i % 3 / 4).alias("val")), F.struct((i - 7).alias("col"), F.lit(-0.25).alias("val"))]
    if not unit:
        cells.append(F.struct(i.alias("col"), (2.0 + i % 5 + F.col("batch")).alias("val")))
    batches = spark.range(n_batch).select(F.col("id").alias("batch"))
    df = held.crossJoin(F.broadcast(batches)).select("batch", "row", F.inline(F.array(*cells))).where("col >= 0")
    return Sparse.of(df, n, n, n_batch)


def tridiagonal(spark: SparkSession, sf_dir: str, down: float = -1.0, up: float = -1.0) -> Sparse:
    """4 on the diagonal, ``down`` below and ``up`` above it."""
    held, n = customers(spark, sf_dir)
    i = F.col("row")
    cells = [F.struct(i.alias("col"), F.lit(4.0).alias("val")), F.struct((i - 1).alias("col"), F.lit(down).alias("val")), F.struct((i + 1).alias("col"), F.lit(up).alias("val"))]
    return Sparse.of(held.select("row", F.inline(F.array(*cells))).where(f"col >= 0 AND col < {n}"), n, n)


def solution(spark: SparkSession, sf_dir: str, width: int = 2, n_batch: int = 1, salt: int = 0) -> Dense:
    """A known right answer: (7 i + 3 k + 5 batch + salt) % 11 - 5."""
    held, n = customers(spark, sf_dir)
    batches = spark.range(n_batch).select(F.col("id").alias("batch"))
    vec = F.array(*(((7 * F.col("row") + 3 * k + 5 * F.col("batch") + salt) % 11 - 5).cast("double") for k in range(width)))
    return Dense.of(held.crossJoin(F.broadcast(batches)).withColumn("vec", vec), n, width, n_batch)


def stream_of(df: DataFrame) -> DataFrame:
    """The events table's columns as a stream of entries."""
    return df.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("row"), F.col("value").alias("val"))
