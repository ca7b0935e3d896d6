"""Stable log-sum-exp over rows, columns, both at once or all, with gradients on the stored entries.

With ``include_zeros`` each absent cell adds exp(0), so results equal those of the dense matrix; without, a group without
entries is minus infinity. Infinite entries give infinity and never NaN; NaN stays NaN.

One scan and no join: values fall in buckets of ``STEP``, and a partial aggregate adds up exponentials relative to the
bucket's middle, which neither overflow nor vanish. Of a group only the greatest bucket and the one below it can matter,
as all others are smaller by exp(-STEP) at least; one of the two is even and the other odd, so the greatest even and the
greatest odd bucket are the state of a second aggregate, which also takes in the numbers of cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..frames import Sparse, grid

ROW, COL = "row", "col"
#: Width of a bucket of values; exp(STEP / 2) times any number of rows is finite.
STEP = 512.0
#: Results for each batch, at most, that are broadcast to the entries.
FEW = 100_000


def _inf(sign: str = "") -> Column:
    return F.lit(f"{sign}Infinity").cast("double")


def _axes(a: Sparse, dim: int | list[int] | tuple[int, ...]) -> set[str]:
    """The axes to reduce by the numbers of an unbatched matrix, or of a batched one whose axis 0 is the batch."""
    dims = [dim] if isinstance(dim, int) else list(dim)
    batched = a.n_batch > 1
    names = ["batch", ROW, COL] if batched else [ROW, COL]
    if not dims:
        raise RuntimeError("no dimension to reduce")
    if any(not -len(names) <= d < len(names) for d in dims):
        raise IndexError(f"dimensions {dims} of a matrix that has {len(names)}")
    found = [names[d] for d in dims]
    if len(set(found)) < len(found):
        raise RuntimeError(f"a dimension occurs twice in {dims}")
    if "batch" in found:
        raise NotImplementedError("the batch axis can't be reduced")
    return set(found)


def bucket(val: Column) -> Column:
    """The number of a value's bucket, as a double; infinite for infinite values."""
    return F.rint(val / STEP)


def term(val: Column) -> Column:
    """A value's exponential relative to its bucket's middle."""
    return F.when(val == _inf(), val).when(val == _inf("-"), F.lit(0.0)).otherwise(F.exp(val - bucket(val) * STEP))


def merged(even: Column, odd: Column) -> Column:
    """The log-sum-exp from the greatest buckets of either parity, structs (b, s) or null."""
    top, low = F.greatest(even, odd), F.when(even.isNotNull() & odd.isNotNull(), F.least(even, odd))
    total = top["s"] + F.coalesce(low["s"] * F.exp((low["b"] - top["b"]) * STEP), F.lit(0.0))
    return F.when(total.isNull() | (total == 0), _inf("-")).otherwise(top["b"] * STEP + F.log(total))


def _parity(odd: bool) -> Column:
    pair = F.struct("b", "s")
    return F.max(F.when((F.col("b") % 2 != 0) if odd else (F.col("b") % 2 == 0), pair))


def _grouped(entries: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lse) for each of ``groups`` (keys, cells): cells is how many there are, or null where absent ones don't count."""
    val = F.col("val")
    sums = entries.select(*keys, bucket(val).alias("b"), term(val).alias("t")).groupBy(*keys, "b").agg(F.sum("t").alias("s"), F.count("*").alias("n"))
    none = F.lit(None)
    every = sums.select(*keys, "b", "s", "n", none.cast("long").alias("cells"), F.lit(False).alias("known"))
    every = every.unionByName(groups.select(*keys, none.cast("double").alias("b"), none.cast("double").alias("s"), F.lit(0).cast("long").alias("n"), "cells", F.lit(True).alias("known")))
    held = every.groupBy(*keys).agg(_parity(False).alias("even"), _parity(True).alias("odd"), F.sum("n").alias("n"), F.max("cells").alias("cells"), F.max("known").alias("known")).where("known")
    zeros = F.greatest(F.coalesce(F.col("cells") - F.col("n"), F.lit(0)), F.lit(0)).cast("double")
    held = held.select(*keys, merged(F.col("even"), F.col("odd")).alias("l"), F.when(zeros > 0, F.log(zeros)).otherwise(_inf("-")).alias("z"))
    own, absent = F.col("l"), F.col("z")
    top = F.greatest(own, absent)
    both = top + F.log(F.exp(own - top) + F.exp(absent - top))
    return held.select(*keys, F.when((absent == _inf("-")) | (own == _inf()) | F.isnan(own), own).when(own == _inf("-"), absent).otherwise(both).alias("lse"))


def logsumexp(a: Sparse, dim: int | list[int] | tuple[int, ...], include_zeros: bool = True, keepdim: bool = False) -> DataFrame:
    """(batch, kept axis, lse): the axis that is kept is row or col, or neither. ``keepdim``: reduced axes stay as index 0."""
    gone = _axes(a, dim)
    kept = [c for c in (ROW, COL) if c not in gone]
    size = {ROW: a.n_rows, COL: a.n_cols}
    cells = 1
    for axis in gone:
        cells *= size[axis]
    groups = grid(a.spark, batch=a.n_batch, **{axis: size[axis] for axis in kept})
    groups = groups.withColumn("cells", F.lit(cells if include_zeros else None).cast("long"))
    out = _grouped(a.df.select("batch", *kept, "val"), groups, ["batch", *kept])
    return out.withColumns({c: F.lit(0).cast("long") for c in gone}).select("batch", ROW, COL, "lse") if keepdim else out


def bidir_logsumexp(a: Sparse, include_zeros: bool = True, layout: str = "tuple", keepdim: bool = False):
    """Column and row results in one scan, columns first. Layouts: ``tuple`` (two frames), ``padded`` and ``nested``.

    The frames of a tuple are read from one table in the shared folder, so the entries are scanned once for both.
    ``padded`` is (axis, batch, idx, lse) with max(rows, cols) indices on each axis, minus infinity where there is none;
    ``nested`` is (axis, batch, lses) with an array for each axis. Axis 0 is columns.
    """
    if layout not in ("tuple", "padded", "nested"):
        raise ValueError(f"no layout {layout!r}")
    if keepdim and layout != "tuple":
        raise ValueError("keepdim is for tuples only")
    both = a.df.select("batch", "val", F.inline(F.array(F.struct(F.lit(0).alias("axis"), F.col(COL).alias("idx")), F.struct(F.lit(1).alias("axis"), F.col(ROW).alias("idx")))))
    spark = a.spark
    sides = [(0, a.n_cols, a.n_rows), (1, a.n_rows, a.n_cols)]
    parts = [grid(spark, batch=a.n_batch, idx=n).select("batch", F.lit(axis).alias("axis"), "idx", F.lit(cells if include_zeros else None).cast("long").alias("cells")) for axis, n, cells in sides]
    out = _grouped(both, parts[0].union(parts[1]), ["batch", "axis", "idx"])
    if layout == "tuple":
        out = scratch.cut(out, "bidir")
        cols, rows = (out.where(F.col("axis") == k).select("batch", F.col("idx").alias(name), "lse") for k, name in ((0, COL), (1, ROW)))
        if keepdim:
            return cols.select("batch", F.lit(0).cast("long").alias(ROW), COL, "lse"), rows.select("batch", ROW, F.lit(0).cast("long").alias(COL), "lse")
        return cols, rows
    if layout == "padded":
        every = grid(spark, axis=2, batch=a.n_batch, idx=max(a.n_rows, a.n_cols)).withColumn("axis", F.col("axis").cast("int"))
        return every.join(out, ["batch", "axis", "idx"], "left").select("axis", "batch", "idx", F.coalesce("lse", _inf("-")).alias("lse"))
    return out.groupBy("axis", "batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "lse"))), lambda s: s["lse"]).alias("lses"))


def logsumexp_vjp(a: Sparse, dim: int | list[int] | tuple[int, ...], g: DataFrame, include_zeros: bool = True) -> Sparse:
    """The gradient on the stored entries: g of the entry's group times exp(value - lse). g is (batch, kept axis, g)."""
    kept = [c for c in (ROW, COL) if c not in _axes(a, dim)]
    lse = logsumexp(a, dim, include_zeros).join(g.select("batch", *kept, "g"), ["batch", *kept])
    # one row for each batch: a small side whose size is known
    met = a.df.join(F.broadcast(lse) if not kept and a.n_batch <= FEW else lse, ["batch", *kept])
    return a.with_df(met.withColumn("val", F.col("g") * F.exp(F.col("val") - F.col("lse"))))


def bidir_logsumexp_vjp(a: Sparse, g_cols: DataFrame, g_rows: DataFrame, include_zeros: bool = True) -> Sparse:
    """The sum of both axes' gradients."""
    cols, rows = bidir_logsumexp(a, include_zeros)
    c = cols.join(g_cols.select("batch", COL, F.col("g").alias("_gc")), ["batch", COL]).withColumnRenamed("lse", "_lc")
    r = rows.join(g_rows.select("batch", ROW, F.col("g").alias("_gr")), ["batch", ROW]).withColumnRenamed("lse", "_lr")
    met = a.df.join(c, ["batch", COL]).join(r, ["batch", ROW])
    return a.with_df(met.withColumn("val", F.col("_gc") * F.exp(F.col("val") - F.col("_lc")) + F.col("_gr") * F.exp(F.col("val") - F.col("_lr"))))


def nnz(a: Sparse, axis: str = ROW) -> DataFrame:
    """(batch, axis, n): stored entries of each group, 0 for empty ones."""
    size = {ROW: a.n_rows, COL: a.n_cols}[axis]
    every = grid(a.spark, batch=a.n_batch, **{axis: size})
    counts = a.df.groupBy("batch", axis).agg(F.count("*").alias("n"))
    return every.join(counts, ["batch", axis], "left").select("batch", axis, F.coalesce("n", F.lit(0)).alias("n"))
