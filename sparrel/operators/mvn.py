"""Sparse multivariate normals by a triangular factor of the covariance or of the precision.

The noise is a frame of its own, so draws can be repeated and compared: (batch, row, vec) with one place for each sample.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frames import Dense, Sparse, grid
from .product import dot, sddmm, spmm
from .solve import triangular_solve, triangular_solve_vjp


def noise(spark: SparkSession, n: int, samples: int, n_batch: int = 1, seed: int = 0) -> Dense:
    """Standard normal numbers, each from a hash of its own place, so they don't depend on partitions (Box and Muller).

    The hash is MD5 of ``batch:row:sample:1 or 2:seed``; its first 13 hexadecimal digits are 52 bits of a uniform number.
    """
    cells = grid(spark, batch=n_batch, row=n)
    unit = lambda k, salt: (F.conv(F.substring(F.md5(F.concat_ws(":", F.col("batch").cast("string"), F.col("row").cast("string"), k.cast("string"), F.lit(str(salt)), F.lit(str(seed)))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    vec = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: F.sqrt(-2 * F.log(unit(k, 1))) * F.cos(2 * math.pi * unit(k, 2)))
    return Dense(cells.select("batch", "row", vec.alias("vec")), n, samples, n_batch)


def _plus(d: Dense, other: DataFrame, column: str) -> Dense:
    return d.with_df(d.df.join(other, ["batch", "row"]).withColumn("vec", F.transform("vec", lambda x: x + F.col(column))))


def _scaled(d: Dense, by: DataFrame, column: str, inverse: bool) -> Dense:
    root = F.sqrt(F.col(column))
    return d.with_df(d.df.join(by, ["batch", "row"]).withColumn("vec", F.transform("vec", lambda x: x / root if inverse else x * root)))


@dataclass(frozen=True)
class SparseMVN:
    """loc: (batch, row, loc). Exactly one lower factor; with a diagonal (batch, row, d) it is strictly lower, of unit diagonal."""

    loc: DataFrame
    scale_tril: Sparse | None = None
    precision_tril: Sparse | None = None
    diagonal: DataFrame | None = None

    def __post_init__(self) -> None:
        if (self.scale_tril is None) == (self.precision_tril is None):
            raise ValueError("give exactly one of scale_tril and precision_tril")
        if self.factor.n_rows != self.factor.n_cols:
            raise ValueError("the factor is square")

    @property
    def factor(self) -> Sparse:
        return self.scale_tril or self.precision_tril

    @property
    def is_ldlt(self) -> bool:
        return self.diagonal is not None

    @property
    def mean(self) -> DataFrame:
        return self.loc

    mode = mean

    def rsample(self, eps: Dense) -> Dense:
        """A draw for each place of the noise's rows."""
        return _plus(self._spread(eps), self.loc, "loc")

    def _spread(self, eps: Dense) -> Dense:
        if self.scale_tril is not None:
            if not self.is_ldlt:
                return spmm(self.scale_tril, eps)
            eta = _scaled(eps, self.diagonal, "d", inverse=False)
            own = eta.df.withColumnRenamed("vec", "_e")
            out = spmm(self.scale_tril, eta)
            return out.with_df(out.df.join(own, ["batch", "row"]).withColumn("vec", F.zip_with("vec", "_e", lambda x, e: x + e)))
        side = _scaled(eps, self.diagonal, "d", inverse=True) if self.is_ldlt else eps
        return triangular_solve(self.precision_tril, side, upper=False, unitriangular=self.is_ldlt, transpose=True)

    def rsample_vjp(self, eps: Dense, g: Dense) -> tuple[DataFrame, Sparse]:
        """Gradients in loc (batch, row, g) and in the factor, on its stored entries."""
        of_loc = g.df.select("batch", "row", F.aggregate("vec", F.lit(0.0), lambda s, x: s + x).alias("g"))
        if self.scale_tril is not None:
            return of_loc, sddmm(self.scale_tril, g, _scaled(eps, self.diagonal, "d", inverse=False) if self.is_ldlt else eps)
        return of_loc, triangular_solve_vjp(self.precision_tril, self._spread(eps), g, upper=False, unitriangular=self.is_ldlt, transpose=True)[0]

    def diagonal_vjp(self, eps: Dense, g: Dense) -> DataFrame:
        """(batch, row, g): the gradient in the diagonal, for a factor with one.

        A draw depends on it by sqrt(d)·eps before the covariance's factor, and by eps/sqrt(d) before the precision's solve.
        """
        if not self.is_ldlt:
            raise ValueError("this distribution has no diagonal")
        if self.scale_tril is not None:
            through = spmm(self.scale_tril.t, g).df.withColumnRenamed("vec", "_t")
            moved = g.filled().df.join(through, ["batch", "row"]).select("batch", "row", F.zip_with("vec", "_t", lambda x, y: x + y).alias("_m"))
            rate = 0.5 / F.sqrt("d")
        else:
            moved = triangular_solve(self.precision_tril, g, upper=False, unitriangular=True).df.withColumnRenamed("vec", "_m")
            rate = -0.5 / F.pow("d", F.lit(1.5))
        met = moved.join(eps.df.withColumnRenamed("vec", "_e"), ["batch", "row"]).join(self.diagonal, ["batch", "row"])
        return met.select("batch", "row", (rate * dot(F.col("_m"), F.col("_e"))).alias("g"))

    def _plain(self) -> Sparse:
        if self.scale_tril is None or self.is_ldlt:
            raise NotImplementedError("for a covariance factor without a diagonal only")
        return self.scale_tril

    def covariance(self) -> Sparse:
        """L·Lᵀ as entries: a join of the factor with itself by column, never dense."""
        factor = self._plain()
        other = factor.df.select("batch", F.col("row").alias("_r"), "col", F.col("val").alias("_v"))
        out = factor.df.join(other, ["batch", "col"]).groupBy("batch", "row", "_r").agg(F.sum(F.col("val") * F.col("_v")).alias("val"))
        return factor.with_df(out.withColumnRenamed("_r", "col"))

    def variance(self) -> DataFrame:
        """(batch, row, variance)."""
        return self._plain().df.groupBy("batch", "row").agg(F.sum(F.col("val") * F.col("val")).alias("variance"))

    def log_prob(self, value: DataFrame) -> DataFrame:
        """(batch, log_prob) of values (batch, row, val)."""
        factor = self._plain()
        gap = value.join(self.loc, ["batch", "row"]).select("batch", "row", F.array(F.col("val") - F.col("loc")).alias("vec"))
        white = triangular_solve(factor, Dense(gap, factor.n_rows, 1, factor.n_batch), upper=False)
        squares = white.df.groupBy("batch").agg(F.sum(F.get("vec", F.lit(0)) * F.get("vec", F.lit(0))).alias("q"))
        logs = factor.df.where("row = col").groupBy("batch").agg(F.sum(F.log("val")).alias("l"))
        return squares.join(logs, "batch").select("batch", (-0.5 * (factor.n_rows * math.log(2 * math.pi) + F.col("q")) - F.col("l")).alias("log_prob"))
