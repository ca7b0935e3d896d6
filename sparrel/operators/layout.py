"""Layouts and structure: compressed rows, pointers, stacks, block diagonals, identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..frames import KEYS, Dense, Sparse, grid


def to_csr(a: Sparse) -> DataFrame:
    """(batch, row, cols, vals) with a row for every index, columns in order; entries with one key add up first."""
    held = a.coalesced().df.groupBy("batch", "row").agg(F.array_sort(F.collect_list(F.struct("col", "val"))).alias("e"))
    every = grid(a.spark, batch=a.n_batch, row=a.n_rows)
    e = F.coalesce("e", F.array().cast("array<struct<col:bigint,val:double>>"))
    return every.join(held, ["batch", "row"], "left").select("batch", "row", F.transform(e, lambda x: x["col"]).alias("cols"), F.transform(e, lambda x: x["val"]).alias("vals"))


def to_csc(a: Sparse) -> DataFrame:
    """(batch, col, rows, vals) with a row for every column."""
    return to_csr(a.t).select("batch", F.col("row").alias("col"), F.col("cols").alias("rows"), "vals")


def from_csr(csr: DataFrame, n_rows: int, n_cols: int, n_batch: int = 1) -> Sparse:
    pairs = csr.select("batch", "row", F.inline(F.arrays_zip("cols", "vals")))
    return Sparse.of(pairs.select("batch", "row", F.col("cols").alias("col"), F.col("vals").alias("val")), n_rows, n_cols, n_batch)


def order(a: Sparse) -> DataFrame:
    """(batch, row, col, place) in lexicographic order: the permutation that compressing applies, by batch."""
    rows = before(a.df.groupBy("batch", "row").agg(F.count("*").alias("n")), ["batch"], "row")
    within = F.row_number().over(Window.partitionBy("batch", "row").orderBy("col")) - 1
    return a.df.withColumn("_w", within).join(rows, ["batch", "row"]).select(*KEYS, (F.col("before") + F.col("_w")).alias("place"))


def before(counts: DataFrame, keys: list[str], by: str, block: int = 1 << 16) -> DataFrame:
    """Adds ``before``, the sum of n over smaller ``by``: sums within blocks, then over blocks, so no task takes all."""
    held = counts.withColumn("_block", F.floor(F.col(by) / block).cast("long"))
    totals = held.groupBy(*keys, "_block").agg(F.sum("n").alias("_t"))
    over = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*keys, "_block", F.coalesce(F.sum("_t").over(over), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_block").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    summed = held.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return summed.join(bases, [*keys, "_block"]).withColumn("before", F.col("_base") + F.col("_in")).drop("_block", "_in", "_base")


def compress(rows: DataFrame, n_rows: int, n_batch: int = 1) -> DataFrame:
    """(batch, i, crow) with n_rows + 1 pointers for each batch from row numbers (batch, row)."""
    if n_rows < 1:
        raise ValueError("a matrix has a row at least")
    spark = rows.sparkSession
    rows = rows if "batch" in rows.columns else rows.withColumn("batch", F.lit(0).cast("long"))
    counts = rows.groupBy("batch", F.col("row").alias("i")).agg(F.count("*").alias("n"))
    full = grid(spark, batch=n_batch, i=n_rows + 1).join(counts, ["batch", "i"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return before(full, ["batch"], "i").select("batch", "i", F.col("before").alias("crow"))


def decompress(pointers: DataFrame) -> DataFrame:
    """(batch, row) for each entry, from pointers (batch, i, crow): the inverse of ``compress``."""
    following = pointers.select("batch", (F.col("i") - 1).alias("i"), F.col("crow").alias("stop"))
    met = pointers.join(following, ["batch", "i"]).where("stop > crow")
    # two steps, so that a row with very many entries isn't one array
    pieces = met.select("batch", "i", "stop", F.explode(F.sequence("crow", F.col("stop") - 1, F.lit(4096).cast("long"))).alias("_c"))
    return pieces.select("batch", F.col("i").alias("row"), F.explode(F.sequence("_c", F.least(F.col("stop") - 1, F.col("_c") + 4095))).alias("_p")).select("batch", "row")


def stack(*matrices: Sparse) -> Sparse:
    """A batch of equally shaped matrices, their batches in order."""
    if not matrices:
        raise ValueError("nothing to stack")
    if len({(m.n_rows, m.n_cols) for m in matrices}) > 1:
        raise ValueError("stacked matrices have one shape")
    out, base = None, 0
    for m in matrices:
        df = m.df.withColumn("batch", F.col("batch") + base)
        out, base = df if out is None else out.unionByName(df), base + m.n_batch
    return Sparse(out, matrices[0].n_rows, matrices[0].n_cols, base)


def block_diag(*matrices: Sparse) -> Sparse:
    """One matrix with the given ones along its diagonal; a batch counts as its matrices in order. One matrix is itself."""
    if not matrices:
        raise ValueError("nothing to put on the diagonal")
    if len(matrices) == 1 and matrices[0].n_batch == 1:
        return matrices[0]
    out, rows, cols = None, 0, 0
    for m in matrices:
        df = m.df.select(F.lit(0).cast("long").alias("batch"), (F.col("row") + F.col("batch") * m.n_rows + rows).alias("row"), (F.col("col") + F.col("batch") * m.n_cols + cols).alias("col"), "val")
        out = df if out is None else out.unionByName(df)
        rows, cols = rows + m.n_rows * m.n_batch, cols + m.n_cols * m.n_batch
    return Sparse(out, rows, cols)


def block_diag_split(a: Sparse, *shapes: tuple[int, int]) -> list[Sparse]:
    """The blocks on the diagonal; entries outside of all blocks are dropped. The shapes must add up to the matrix's."""
    if a.n_batch != 1:
        raise ValueError("only an unbatched matrix can be split")
    if (sum(r for r, _ in shapes), sum(c for _, c in shapes)) != (a.n_rows, a.n_cols):
        raise ValueError(f"the blocks {shapes} don't add up to {(a.n_rows, a.n_cols)}")
    out, row, col = [], 0, 0
    for r, c in shapes:
        own = a.df.where(F.col("row").between(row, row + r - 1) & F.col("col").between(col, col + c - 1))
        out.append(Sparse(own.select("batch", (F.col("row") - row).alias("row"), (F.col("col") - col).alias("col"), "val"), r, c))
        row, col = row + r, col + c
    return out


def eye(spark: SparkSession, n: int, n_batch: int = 1) -> Sparse:
    cells = grid(spark, batch=n_batch, row=n)
    return Sparse(cells.select("batch", "row", F.col("row").alias("col"), F.lit(1.0).alias("val")), n, n, n_batch)


def densify(a: Sparse) -> Dense:
    """Every cell; for small matrices only, as the result has rows x columns numbers."""
    csr = to_csr(a).select("batch", "row", F.map_from_arrays("cols", "vals").alias("m"))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(a.n_cols - 1).cast("long")), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(0.0)))
    return Dense(csr.select("batch", "row", cells.alias("vec")), a.n_rows, a.n_cols, a.n_batch)


def sparsify(d: Dense) -> Sparse:
    """The cells that aren't zero."""
    cells = d.df.select("batch", "row", F.posexplode("vec").alias("col", "val")).where("val <> 0")
    return Sparse.of(cells, d.n_rows, d.width, d.n_batch)


def triangle(a: Sparse, upper: bool = True, strict: bool = False) -> Sparse:
    """The entries on one side of the diagonal, and on it unless ``strict``."""
    one, other = (F.col("row"), F.col("col")) if upper else (F.col("col"), F.col("row"))
    return a.with_df(a.df.where(one < other if strict else one <= other))


def select_rows(d: Dense, wanted: DataFrame) -> DataFrame:
    """(i, batch, vec): rows by number, from (i, row); a number may be wanted many times."""
    return wanted.join(d.df, "row").select("i", "batch", "vec")
