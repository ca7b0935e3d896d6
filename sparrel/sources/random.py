"""Seeded random sparse matrices: exact numbers of entries, places without repeats, values from hashes of their places.

Places are the images of 0..nnz-1 under a keyed permutation of the cells (a Feistel network that walks on from values
outside), so there is no sort, no shuffle and nothing to reject, and the same seed gives the same matrix in any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frames import Sparse, grid

WALKS, PASSES, ROUNDS = 24, 8, 4


def _mixed(x: Column, seed: int, salt: int) -> Column:
    return F.xxhash64(x, F.lit(seed), F.lit(salt))


def unit(seed: int, *keys: str | Column) -> Column:
    """A number in [0, 1) that depends on the keys only."""
    return F.pmod(F.xxhash64(*(F.col(k) if isinstance(k, str) else k for k in keys), F.lit(seed)), F.lit(1 << 53)).cast("double") / float(1 << 53)


def permuted(df: DataFrame, column: str, cells: int, seed: int, batch: str = "batch") -> DataFrame:
    """Replaces 0 <= column < cells by its image under the permutation of that batch.

    The network's domain is at most four times the cells, so of 24 walks one in 1000 values stays outside, and of all the
    ``PASSES`` one in 1e24; such a value is an error, never an entry outside.
    """
    half = max(1, (max(cells - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def once(x: Column) -> Column:
        pair = F.struct(F.shiftright(x, half).alias("a"), x.bitwiseAND(F.lit(mask)).alias("b"))
        out = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), pair, lambda p, k: F.struct(p["b"].alias("a"), p["a"].bitwiseXOR(F.xxhash64(p["b"], k, F.col(batch), F.lit(seed)).bitwiseAND(F.lit(mask))).alias("b")))
        return F.shiftleft(out["a"], half) + out["b"]

    def walk(x: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), x, lambda v, _: F.when(v < cells, v).otherwise(once(v)))

    first = df.withColumn(column, once(F.col(column).cast("long")))
    for _ in range(PASSES):
        first = first.withColumn(column, walk(F.col(column)))
    return first.withColumn(column, F.when(F.col(column) < cells, F.col(column)).otherwise(F.raise_error(F.lit("a place has not come inside")).cast("long")))


def _check(nnz: int, least: int, most: int) -> None:
    if not least <= nnz <= most:
        raise ValueError(f"between {least} and {most} entries fit, not {nnz}")


def rand_sparse(spark: SparkSession, n_rows: int, n_cols: int, nnz: int, n_batch: int = 1, seed: int = 0, well_conditioned: bool = False, min_diag: float = 1.0) -> Sparse:
    """Exactly nnz entries for each batch, with values in [0, 1). Well conditioned: entries on the diagonal are raised by min_diag."""
    _check(nnz, 0, n_rows * n_cols)
    places = grid(spark, batch=n_batch, p=nnz)
    at = permuted(places, "p", n_rows * n_cols, seed).select("batch", F.floor(F.col("p") / n_cols).cast("long").alias("row"), (F.col("p") % n_cols).alias("col"))
    value = unit(seed + 1, "batch", "row", "col")
    if well_conditioned:
        value = value + F.when(F.col("row") == F.col("col"), F.lit(min_diag)).otherwise(0.0)
    return Sparse(at.withColumn("val", value), n_rows, n_cols, n_batch)


def rand_sparse_tri(spark: SparkSession, n: int, nnz: int, n_batch: int = 1, upper: bool = True, strict: bool = False, seed: int = 0, value_range: tuple[float, float] = (0.0, 1.0), well_conditioned: bool = False, min_diag: float = 1.0) -> Sparse:
    """Triangular; unless ``strict`` the whole diagonal is stored and counts. Cell p of the strict part is row r, column c < r with p = r(r-1)/2 + c."""
    inside = n * (n - 1) // 2
    _check(nnz, 0 if strict else n, inside + (0 if strict else n))
    places = grid(spark, batch=n_batch, p=nnz - (0 if strict else n))
    at = permuted(places, "p", max(inside, 1), seed)
    guess = F.floor((1 + F.sqrt(1 + 8 * F.col("p").cast("double"))) / 2).cast("long")
    before = lambda r: F.shiftright(r * (r - 1), 1)
    row = F.when(before(guess) > F.col("p"), guess - 1).when(before(guess + 1) <= F.col("p"), guess + 1).otherwise(guess)
    low = at.select("batch", row.alias("row"), "p").select("batch", "row", (F.col("p") - before(F.col("row"))).alias("col"))
    one, other = ("col", "row") if upper else ("row", "col")
    cells = low.select("batch", F.col(one).alias("row"), F.col(other).alias("col"))
    if not strict:
        cells = cells.unionByName(grid(spark, batch=n_batch, row=n).select("batch", "row", F.col("row").alias("col")))
    least, most = value_range
    value = least + (most - least) * unit(seed + 1, "batch", "row", "col")
    if well_conditioned:
        value = F.when(F.col("row") == F.col("col"), F.abs(value) + min_diag).otherwise(value)
    return Sparse(cells.withColumn("val", value), n, n, n_batch)


def make_spd(spark: SparkSession, n: int, density: float = 0.5, seed: int = 0, n_batch: int = 1) -> Sparse:
    """Symmetric positive definite by diagonal dominance: pairs below the diagonal, mirrored, and row sums of sizes plus one."""
    inside = n * (n - 1) // 2
    off = rand_sparse_tri(spark, n, round(density * inside), n_batch, upper=False, strict=True, seed=seed, value_range=(-1.0, 1.0)).df
    both = off.unionByName(off.select("batch", F.col("col").alias("row"), F.col("row").alias("col"), "val"))
    sums = both.groupBy("batch", "row").agg(F.sum(F.abs("val")).alias("s"))
    diagonal = grid(spark, batch=n_batch, row=n).join(sums, ["batch", "row"], "left")
    return Sparse(both.unionByName(diagonal.select("batch", "row", F.col("row").alias("col"), (F.coalesce("s", F.lit(0.0)) + 1.0).alias("val"))), n, n, n_batch)
