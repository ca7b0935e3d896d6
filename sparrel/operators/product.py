"""Products: sparse by dense, sampled dense by dense, and rows by a bank of matrices, each with its gradients.

All are equi-joins and partial aggregations. Dense rows are arrays, and sums over arrays are one aggregate for each
place up to ``WIDE`` places, so that one pass adds them all up before the shuffle; wider rows go by places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import Dense, Sparse, same_batches
from .layout import before

WIDE = 128


def summed(df: DataFrame, keys: list[str], vec: Column, width: int) -> DataFrame:
    """(keys, vec): the sums of arrays of one width."""
    if width <= WIDE:
        df = df.select(*keys, vec.alias("_v"))
        sums = df.groupBy(*keys).agg(*(F.sum(F.get("_v", F.lit(k))).alias(f"_{k}") for k in range(width)))
        return sums.select(*keys, F.array(*(F.col(f"_{k}") for k in range(width))).alias("vec"))
    places = df.select(*keys, F.posexplode(vec).alias("_k", "_x")).groupBy(*keys, "_k").agg(F.sum("_x").alias("_x"))
    return places.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_x"))), lambda s: s["_x"]).alias("vec"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def spmm(a: Sparse, b: Dense, every_row: bool = True) -> Dense:
    """A·B for each batch. Entries with one key add up. ``every_row``: rows of A without entries appear, as zeros."""
    same_batches(a, b)
    if a.n_cols != b.n_rows:
        raise ValueError(f"A has {a.n_cols} columns and B {b.n_rows} rows")
    right = b.df.select("batch", F.col("row").alias("col"), "vec")
    met = a.df.join(right, ["batch", "col"])
    out = Dense(summed(met, ["batch", "row"], F.transform("vec", lambda x: x * F.col("val")), b.width), a.n_rows, b.width, a.n_batch)
    return out.filled() if every_row else out


def spmv(a: Sparse, x: DataFrame) -> DataFrame:
    """(batch, row, val) of A·x for x (batch, row, val); rows without entries don't appear."""
    right = x.select("batch", F.col("row").alias("col"), F.col("val").alias("x"))
    return a.df.join(right, ["batch", "col"]).groupBy("batch", "row").agg(F.sum(F.col("val") * F.col("x")).alias("val"))


def sddmm(a: Sparse, g: Dense, b: Dense) -> Sparse:
    """G·Bᵀ at the stored entries of A only: the gradient of A·B in A. Every stored entry keeps its row, equal keys too."""
    same_batches(a, g, b)
    if (a.n_rows, a.n_cols, g.width) != (g.n_rows, b.n_rows, b.width):
        raise ValueError(f"the shapes don't fit: A {a.shape}, G {g.shape}, B {b.shape}")
    left, right = g.df.select("batch", "row", F.col("vec").alias("_g")), b.df.select("batch", F.col("row").alias("col"), F.col("vec").alias("_b"))
    met = a.df.join(left, ["batch", "row"], "left").join(right, ["batch", "col"], "left")
    return a.with_df(met.withColumn("val", F.coalesce(dot(F.col("_g"), F.col("_b")), F.lit(0.0))))


def spmm_vjp(a: Sparse, b: Dense, g: Dense, of_a: bool = True, of_b: bool = True) -> tuple[Sparse | None, Dense | None]:
    """Gradients of A·B: in A on its stored entries, in B dense. What isn't wanted isn't planned."""
    return sddmm(a, g, b) if of_a else None, spmm(a.t, g) if of_b else None


def transform_closure(a: Sparse):
    """x ↦ A·x, for solvers that take an operator."""
    return lambda x: spmv(a, x)


def gather_mm(rows: DataFrame, bank: DataFrame, width: int, d_in: int) -> DataFrame:
    """(i, vec): each row's vector times the matrix of the bank that its idx names.

    rows: (i, idx, vec); bank: (r, i, k, val), as entries of an R x d_in x width stack. Matrices become arrays of columns
    once, by their own key, so a row meets one row of the bank.
    """
    return rows.join(_matrices(bank, width, d_in), F.col("idx") == F.col("r")).select("i", _times(F.col("vec"), F.col("m")).alias("vec"))


def _matrices(bank: DataFrame, width: int, d_in: int) -> DataFrame:
    """(r, m): the columns of each matrix as arrays; entries that are absent are zero."""
    cells = bank.groupBy("r").agg(F.map_from_entries(F.collect_list(F.struct((F.col("k") * d_in + F.col("i")).cast("long"), F.col("val")))).alias("_c"))
    column = lambda k: F.transform(F.sequence(F.lit(0), F.lit(d_in - 1)), lambda i: F.coalesce(F.try_element_at("_c", (k * d_in + i).cast("long")), F.lit(0.0)))
    return cells.select("r", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), column).alias("m"))


def _times(vec: Column, m: Column) -> Column:
    return F.transform(m, lambda c: dot(vec, c))


#: Rows of a stretch by which rows and segments meet.
STRETCH = 256


def segments(lengths: DataFrame) -> DataFrame:
    """(s, start, stop) of consecutive segments from (s, n): running sums by blocks; segments may be empty."""
    return before(lengths.select("s", "n"), [], "s").select("s", F.col("before").alias("start"), (F.col("before") + F.col("n")).alias("stop"))


def segment_mm(rows: DataFrame, lengths: DataFrame, bank: DataFrame, width: int, d_in: int) -> DataFrame:
    """(i, vec): consecutive segments of rows (i, vec) by the bank's matrices in order. The lengths must add up to the rows.

    A segment meets its rows by stretches of ``STRETCH`` numbers, so a long one is many rows and a short one is one.
    """
    n, total = rows.count(), lengths.agg(F.sum("n")).first()[0] or 0
    if n != total:
        raise ValueError(f"the segments hold {total} rows, but there are {n}")
    held = segments(lengths).where("stop > start")
    first, last = (F.floor(F.col(c) / STRETCH).cast("long") for c in ("start", "last"))
    wide = held.withColumn("last", F.col("stop") - 1).select(F.col("s").alias("idx"), "start", "stop", first.alias("_a"), last.alias("_b"))
    # two steps, so that no array grows with a segment by more than its square root's order
    wide = wide.select("idx", "start", "stop", "_b", F.explode(F.sequence("_a", "_b", F.lit(4096).cast("long"))).alias("_c"))
    wide = wide.select("idx", "start", "stop", F.explode(F.sequence("_c", F.least("_b", F.col("_c") + 4095))).alias("_stretch"))
    named = rows.select("i", "vec", F.floor(F.col("i") / STRETCH).cast("long").alias("_stretch")).join(wide, "_stretch").where("i >= start AND i < stop")
    return gather_mm(named.select("i", "idx", "vec"), bank, width, d_in)


def gather_mm_vjp(rows: DataFrame, bank: DataFrame, g: DataFrame, width: int, d_in: int) -> tuple[DataFrame, DataFrame]:
    """Gradients of gather_mm: (i, vec) of the rows, and (r, i, k, val) of the matrices that rows name."""
    met = rows.join(g.select("i", F.col("vec").alias("_g")), "i")
    turned = bank.select("r", F.col("k").alias("i"), F.col("i").alias("k"), "val")
    of_rows = gather_mm(met.select("i", "idx", F.col("_g").alias("vec")), turned, d_in, width)
    outer = met.select("idx", F.posexplode("vec").alias("_i", "_x"), "_g").select("idx", "_i", "_x", F.posexplode("_g").alias("_k", "_y"))
    of_bank = outer.groupBy(F.col("idx").alias("r"), F.col("_i").cast("long").alias("i"), F.col("_k").cast("long").alias("k")).agg(F.sum(F.col("_x") * F.col("_y")).alias("val"))
    return of_rows, of_bank


def batch_mv(op, matrix: Sparse, vectors: DataFrame) -> DataFrame:
    """``op`` for samples of vectors (batch, row, sample, val): the samples are columns of one dense side.

    With or without batches and samples it is one plan; frames without those columns have one batch and one sample.
    """
    named = vectors.withColumns({c: F.lit(0).cast("long") for c in ("batch", "sample") if c not in vectors.columns})
    if extra := set(named.columns) - {"batch", "row", "sample", "val"}:
        raise ValueError(f"vectors have batch, row, sample and val, not {sorted(extra)}")
    samples = sorted(r[0] for r in named.select("sample").distinct().collect())
    wide = named.groupBy("batch", "row").agg(F.map_from_entries(F.collect_list(F.struct("sample", "val"))).alias("_m"))
    vec = F.array(*(F.coalesce(F.try_element_at("_m", F.lit(s).cast("long")), F.lit(0.0)) for s in samples))
    out = op(matrix, Dense(wide.select("batch", "row", vec.alias("vec")), matrix.n_cols, len(samples), matrix.n_batch))
    return out.df.select("batch", "row", F.posexplode("vec").alias("_p", "val")).select("batch", "row", F.element_at(F.array(*(F.lit(s).cast("long") for s in samples)), F.col("_p") + 1).alias("sample"), "val")
