"""Matrices as relations: the stored entries of a matrix with its declared shape.

An absent coordinate is a structural zero, which is not the same as a stored 0.0. The shape can't be learned from the
entries, as trailing rows may be empty, so it stays beside the frame. Unbatched matrices are batch 0 of one.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("batch", "row", "col")


def _typed(df: DataFrame, ints: tuple[str, ...]) -> list[Column]:
    return [(F.col(c) if c in df.columns else F.lit(0)).cast("long").alias(c) for c in ints]


def index(spark: SparkSession, n: int, name: str) -> DataFrame:
    """0..n-1 as a column; Spark deals the range in as many parts as it has cores."""
    return spark.range(n).select(F.col("id").alias(name))


def grid(spark: SparkSession, **sizes: int) -> DataFrame:
    """Every combination of numbers below the sizes: one range and its quotients, so nothing is joined or broadcast."""
    if not min(sizes.values()):
        return spark.range(0).select(*(F.col("id").alias(name) for name in sizes))
    columns, step = [], 1
    for name, n in reversed(sizes.items()):
        columns.append((F.expr(f"id div {step}") % n).alias(name))
        step *= n
    return spark.range(step).select(*reversed(columns))


@dataclass(frozen=True)
class Sparse:
    """Entries (batch, row, col, val) of ``n_batch`` matrices of n_rows x n_cols; keys may repeat and then add up."""

    df: DataFrame
    n_rows: int
    n_cols: int
    n_batch: int = 1

    @classmethod
    def of(cls, df: DataFrame, n_rows: int, n_cols: int, n_batch: int = 1) -> Sparse:
        """From a frame with row, col, val and perhaps batch. Shapes must be positive; nulls are the checker's business."""
        if min(n_rows, n_cols, n_batch) < 1:
            raise ValueError(f"a shape must be positive: {(n_batch, n_rows, n_cols)}")
        missing = {"row", "col", "val"} - set(df.columns)
        if missing:
            raise TypeError(f"not entries of a matrix, as these columns are missing: {sorted(missing)}")
        return cls(df.select(*_typed(df, KEYS), F.col("val").cast("double").alias("val")), n_rows, n_cols, n_batch)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.n_batch, self.n_rows, self.n_cols

    def with_df(self, df: DataFrame) -> Sparse:
        return replace(self, df=df.select(*KEYS, "val"))

    @property
    def t(self) -> Sparse:
        """The transpose: two columns swap names."""
        return Sparse(self.df.select("batch", F.col("col").alias("row"), F.col("row").alias("col"), "val"), self.n_cols, self.n_rows, self.n_batch)

    def coalesced(self) -> Sparse:
        """Entries with one key added up."""
        return self.with_df(self.df.groupBy(*KEYS).agg(F.sum("val").alias("val")))

    def checked(self) -> Sparse:
        """Raises if an entry is null or outside the shape; one pass over the entries."""
        outside = ~(F.col("row").between(0, self.n_rows - 1) & F.col("col").between(0, self.n_cols - 1) & F.col("batch").between(0, self.n_batch - 1))
        if not self.df.where(outside | F.col("val").isNull() | F.col("row").isNull() | F.col("col").isNull()).isEmpty():
            raise ValueError(f"entries that are null or outside the shape {self.shape}")
        return self


@dataclass(frozen=True)
class Dense:
    """Rows (batch, row, vec) of ``n_batch`` matrices of n_rows x width; rows that are absent are zero."""

    df: DataFrame
    n_rows: int
    width: int
    n_batch: int = 1

    @classmethod
    def of(cls, df: DataFrame, n_rows: int, width: int, n_batch: int = 1) -> Dense:
        if min(n_rows, width, n_batch) < 1:
            raise ValueError(f"a shape must be positive: {(n_batch, n_rows, width)}")
        if missing := {"row", "vec"} - set(df.columns):
            raise TypeError(f"not rows of a matrix, as these columns are missing: {sorted(missing)}")
        return cls(df.select(*_typed(df, ("batch", "row")), F.col("vec").cast("array<double>").alias("vec")), n_rows, width, n_batch)

    @classmethod
    def from_columns(cls, df: DataFrame, columns: list[str], n_rows: int, n_batch: int = 1) -> Dense:
        return cls.of(df.withColumn("vec", F.array(*(F.col(c).cast("double") for c in columns))), n_rows, len(columns), n_batch)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.n_batch, self.n_rows, self.width

    def with_df(self, df: DataFrame) -> Dense:
        return replace(self, df=df.select("batch", "row", "vec"))

    def columns(self, prefix: str = "c") -> DataFrame:
        """(batch, row, c0, c1, ...)."""
        return self.df.select("batch", "row", *(F.get("vec", F.lit(k)).alias(f"{prefix}{k}") for k in range(self.width)))

    def filled(self) -> Dense:
        """With a row for every index; those that were absent are zero."""
        every = grid(self.spark, batch=self.n_batch, row=self.n_rows)
        zero = F.array_repeat(F.lit(0.0), self.width)
        return self.with_df(every.join(self.df, ["batch", "row"], "left").withColumn("vec", F.coalesce("vec", zero)))


def same_batches(*matrices: Sparse | Dense) -> None:
    if len({m.n_batch for m in matrices}) > 1:
        raise ValueError(f"the numbers of batches differ: {[m.n_batch for m in matrices]}")
