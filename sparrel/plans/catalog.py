"""Every query of the library but those of the training-data subpackage, and its SQL.

Sums of floating-point numbers depend on the order of adding, so results are rounded on both sides.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api, scratch
from ..frames import Dense, Sparse, grid, index
from ..functions import sql as sql_functions
from ..operators import encode, krylov, layout, product, reduce, solve, stats
from ..operators.mvn import SparseMVN, noise
from ..sources import matrix_market as market
from ..sources import random
from ..streaming import incremental
from . import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function as the query of its name, and the SQL for it."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded; adding 0.0 makes a negative zero a plain one."""
    return df.select(*(((F.round(F.col(n), digits) + F.lit(0.0)).alias(n) if kind == "double" else F.col(n)) for n, kind in df.dtypes))


def _out(d: Dense, prefix: str = "c", digits: int = 4) -> DataFrame:
    return _rounded(d.columns(prefix), digits)


def _entries(a: Sparse, digits: int = 4) -> DataFrame:
    return _rounded(a.df.select("batch", "row", "col", "val"), digits)


_A = "a AS (SELECT l_orderkey AS row, l_partkey AS col, l_quantity AS val FROM lineitem)"
_D = "d AS (SELECT l_suppkey AS row, l_partkey AS col, sum(l_discount) AS val FROM lineitem GROUP BY 1, 2)"
_FLAG = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END::BIGINT"
_F = "f AS (SELECT p_partkey AS id, p_size::DOUBLE AS f0, p_retailprice / 1000 AS f1 FROM part)"
_S = "s AS (SELECT s_suppkey AS id, s_acctbal / 1000 AS g0, s_nationkey::DOUBLE AS g1 FROM supplier)"
_Z = "0::BIGINT AS batch"

# Products


@query(f"WITH {_A}, {_F} SELECT {_Z}, o_orderkey AS row, round(coalesce(sum(val * f0), 0), 4) AS c0, round(coalesce(sum(val * f1), 0), 4) AS c1 FROM orders LEFT JOIN a ON row = o_orderkey LEFT JOIN f ON id = col GROUP BY 2")
def spmm_order_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(product.spmm(t.quantities(spark, sf_dir), t.part_features(spark, sf_dir)))


@query(f"WITH a AS (SELECT {_FLAG} AS batch, l_orderkey AS row, l_partkey AS col, l_quantity AS val FROM lineitem), {_F} SELECT batch, row, round(sum(val * f0), 4) AS c0, round(sum(val * f1), 4) AS c1 FROM a JOIN f ON id = col GROUP BY 1, 2")
def spmm_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = t.part_features(spark, sf_dir)
    b = Dense(b.df.drop("batch").crossJoin(F.broadcast(index(spark, 3, "batch"))).select("batch", "row", "vec"), b.n_rows, b.width, 3)
    return _out(product.spmm(t.quantities_by_flag(spark, sf_dir), b, every_row=False))


@query(f"WITH {_A} SELECT {_Z}, col AS row, round(sum(val * o_totalprice / 100000), 4) AS c0 FROM a JOIN orders ON row = o_orderkey GROUP BY 2")
def spmm_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(product.spmm(t.quantities(spark, sf_dir).t, t.order_features(spark, sf_dir), every_row=False))


@query(f"WITH {_D}, {_F}, {_S} SELECT {_Z}, row, col, round(g0 * f0 + g1 * f1, 6) AS val FROM d JOIN s ON s.id = row JOIN f ON f.id = col")
def sddmm_grad_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(product.spmm_vjp(t.discounts(spark, sf_dir), t.part_features(spark, sf_dir), t.supplier_features(spark, sf_dir), of_b=False)[0], 6)


@query(f"WITH {_D}, {_S} SELECT {_Z}, p_partkey AS row, round(coalesce(sum(val * g0), 0), 4) AS c0, round(coalesce(sum(val * g1), 0), 4) AS c1 FROM part LEFT JOIN d ON col = p_partkey LEFT JOIN s ON s.id = row GROUP BY 2")
def spmm_grad_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(product.spmm_vjp(t.discounts(spark, sf_dir), t.part_features(spark, sf_dir), t.supplier_features(spark, sf_dir), of_a=False)[1])


@query(f"WITH {_A} SELECT row, round(sum(val * p_size), 4) AS val, {_Z} FROM a JOIN part ON p_partkey = col GROUP BY 1")
def spmv_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = t.table(spark, sf_dir, "part").select(F.lit(0).cast("long").alias("batch"), F.col("p_partkey").alias("row"), F.col("p_size").cast("double").alias("val"))
    return _rounded(product.transform_closure(t.quantities(spark, sf_dir))(x))


_BANK = "((r * 31 + i * 7 + k * 3) % 17) / 17.0"
_VEC = "SELECT vec_id AS i, label AS idx, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings"


def _bank(spark: SparkSession, width: int = 3, d_in: int = 64, n: int = 10) -> DataFrame:
    r, i, k = F.col("r"), F.col("i"), F.col("k")
    cells = index(spark, n, "r").crossJoin(F.broadcast(index(spark, d_in, "i"))).crossJoin(F.broadcast(index(spark, width, "k")))
    return cells.withColumn("val", (r * 31 + i * 7 + k * 3) % 17 / 17.0)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.col("label").cast("long").alias("idx"), F.col("embedding").cast("array<double>").alias("vec"))


def _places(df: DataFrame, key: str, width: int) -> DataFrame:
    return _rounded(df.select(key, *(F.get("vec", F.lit(k)).alias(f"c{k}") for k in range(width))), 7)


def _gathered(idx: str) -> str:
    sums = ", ".join(f"round(sum(x * (({idx} * 31 + j * 7 + {k} * 3) % 17) / 17.0), 7) AS c{k}" for k in range(3))
    return f"WITH v AS ({_VEC}) SELECT v.i, {sums} FROM v"


@query(f"{_gathered('v.idx')} GROUP BY 1")
def gather_mm_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(product.gather_mm(_vectors(spark, sf_dir), _bank(spark), 3, 64), "i", 3)


@query(f"WITH v AS ({_VEC}) SELECT idx AS r, j::BIGINT AS i, k::BIGINT AS k, round(sum(x * (i % 5 + k)), 4) AS val FROM (SELECT idx::BIGINT AS idx, j, x, v.i AS i, k FROM v, range(3) s(k)) GROUP BY 1, 2, 3")
def gather_mm_grad_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _vectors(spark, sf_dir).select("i", F.array(*((F.col("i") % 5 + k).cast("double") for k in range(3))).alias("vec"))
    return _rounded(product.gather_mm_vjp(_vectors(spark, sf_dir), _bank(spark), g, 3, 64)[1])


@query("SELECT vec_id AS i, " + ", ".join(f"round(sum((vec_id % 5 + k) * ((label * 31 + {j} * 7 + k * 3) % 17) / 17.0), 7) AS c{j}" for j in range(64)) + " FROM embeddings, range(3) s(k) GROUP BY 1")
def gather_mm_grad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _vectors(spark, sf_dir).select("i", F.array(*((F.col("i") % 5 + k).cast("double") for k in range(3))).alias("vec"))
    return _places(product.gather_mm_vjp(_vectors(spark, sf_dir), _bank(spark), g, 3, 64)[0], "i", 64)


_LENGTHS = "n AS (SELECT label AS s, count(*) AS n FROM embeddings GROUP BY 1), e AS (SELECT s, sum(n) OVER (ORDER BY s) - n AS start, sum(n) OVER (ORDER BY s) AS stop FROM n)"


@query(f"WITH {_LENGTHS}, v AS ({_VEC}) SELECT v.i, " + ", ".join(f"round(sum(x * ((s * 31 + j * 7 + {k} * 3) % 17) / 17.0), 7) AS c{k}" for k in range(3)) + " FROM v JOIN e ON v.i >= start AND v.i < stop GROUP BY 1")
def segment_mm_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    lengths = vectors.groupBy(F.col("idx").alias("s")).agg(F.count("*").alias("n"))
    return _places(product.segment_mm(vectors.select("i", "vec"), lengths, _bank(spark), 3, 64), "i", 3)


@query(f"WITH {_A} SELECT {_Z}, row, k::BIGINT AS sample, round(sum(val * ((col * 3 + k) % 7)), 4) AS val FROM a, range(3) s(k) GROUP BY 2, 3")
def batch_matrix_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = t.quantities(spark, sf_dir)
    x = index(spark, a.n_cols, "row").crossJoin(F.broadcast(index(spark, 3, "sample"))).withColumn("val", ((F.col("row") * 3 + F.col("sample")) % 7).cast("double"))
    return _rounded(product.batch_mv(lambda m, v: product.spmm(m, v, every_row=False), a, x))


# Reductions

_NP, _NS = "(SELECT count(*) FROM part)", "(SELECT count(*) FROM supplier)"


@query(f"WITH {_D} SELECT {_Z}, s_suppkey AS row, round(ln(coalesce(sum(exp(val)), 0) + {_NP} - count(val)), 4) AS lse FROM supplier LEFT JOIN d ON row = s_suppkey GROUP BY 2")
def lse_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reduce.logsumexp(t.discounts(spark, sf_dir), 1))


@query(f"WITH {_D} SELECT {_Z}, p_partkey AS col, round(ln(coalesce(sum(exp(val)), 0) + {_NS} - count(val)), 4) AS lse FROM part LEFT JOIN d ON col = p_partkey GROUP BY 2")
def lse_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reduce.logsumexp(t.discounts(spark, sf_dir), 0))


@query(f"WITH {_D} SELECT {_Z}, round(ln(sum(exp(val)) + {_NP} * {_NS} - count(*)), 4) AS lse FROM d")
def lse_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reduce.logsumexp(t.discounts(spark, sf_dir), [0, 1]))


@query(f"WITH {_A} SELECT {_Z}, o_orderkey AS row, CASE WHEN count(val) = 0 THEN '-Infinity'::DOUBLE ELSE round(ln(sum(exp(val))), 4) END AS lse FROM orders LEFT JOIN a ON row = o_orderkey GROUP BY 2")
def lse_row_stored_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reduce.logsumexp(t.quantities(spark, sf_dir), 1, include_zeros=False))


@query(f"WITH d AS (SELECT {_FLAG} AS batch, l_suppkey AS row, l_partkey AS col, sum(l_discount) AS val FROM lineitem GROUP BY 1, 2, 3) SELECT b::BIGINT AS batch, s_suppkey AS row, round(ln(coalesce(sum(exp(val)), 0) + {_NP} - count(val)), 4) AS lse FROM supplier CROSS JOIN range(3) r(b) LEFT JOIN d ON row = s_suppkey AND batch = b GROUP BY 1, 2")
def lse_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reduce.logsumexp(t.discounts_by_flag(spark, sf_dir), 2))


_BIDIR = f"{_D}, g AS (SELECT 0 AS axis, p_partkey AS idx, {_NS} AS cells FROM part UNION ALL SELECT 1, s_suppkey, {_NP} FROM supplier), e AS (SELECT 0 AS axis, col AS idx, val FROM d UNION ALL SELECT 1, row, val FROM d), l AS (SELECT axis, idx, ln(coalesce(sum(exp(val)), 0) + any_value(cells) - count(val)) AS lse FROM g LEFT JOIN e USING (axis, idx) GROUP BY 1, 2)"


@query(f"WITH {_BIDIR} SELECT axis::INTEGER AS axis, idx, round(lse, 4) AS lse FROM l")
def lse_bidir(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols, rows = reduce.bidir_logsumexp(t.discounts(spark, sf_dir))
    return _rounded(cols.select(F.lit(0).alias("axis"), F.col("col").alias("idx"), "lse").union(rows.select(F.lit(1).alias("axis"), F.col("row").alias("idx"), "lse")))


@query(f"WITH {_BIDIR} SELECT a::INTEGER AS axis, {_Z}, i::BIGINT AS idx, coalesce(round(lse, 4), '-Infinity'::DOUBLE) AS lse FROM (SELECT a, unnest(range(greatest({_NP}, {_NS}))) AS i FROM range(2) r(a)) LEFT JOIN l ON axis = a AND idx = i")
def lse_bidir_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reduce.bidir_logsumexp(t.discounts(spark, sf_dir), layout="padded"))


@query(f"WITH {_D}, n AS (SELECT row, ln(sum(exp(val)) + {_NP} - count(*)) AS lse FROM d GROUP BY 1) SELECT {_Z}, row, col, round((row % 4 + 1) * 100 * exp(val - lse), 4) AS val FROM d JOIN n USING (row)")
def lse_grad(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = t.discounts(spark, sf_dir)
    g = index(spark, a.n_rows, "row").select(F.lit(0).cast("long").alias("batch"), "row", ((F.col("row") % 4 + 1) * 100).cast("double").alias("g"))
    return _entries(reduce.logsumexp_vjp(a, 1, g))


@query(f"WITH {_BIDIR} SELECT {_Z}, d.row, d.col, round(100 * (exp(val - r.lse) + (col % 3 + 1) * exp(val - c.lse)), 4) AS val FROM d JOIN l r ON r.axis = 1 AND r.idx = d.row JOIN l c ON c.axis = 0 AND c.idx = d.col")
def lse_bidir_grad(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, zero = t.discounts(spark, sf_dir), F.lit(0).cast("long").alias("batch")
    g_cols = index(spark, a.n_cols, "col").select(zero, "col", ((F.col("col") % 3 + 1) * 100).cast("double").alias("g"))
    g_rows = index(spark, a.n_rows, "row").select(zero, "row", F.lit(100.0).alias("g"))
    return _entries(reduce.bidir_logsumexp_vjp(a, g_cols, g_rows))


@query(f"WITH {_A} SELECT {_Z}, o_orderkey AS row, count(val) AS n FROM orders LEFT JOIN a ON row = o_orderkey GROUP BY 2")
def row_nnz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.nnz(t.quantities(spark, sf_dir))


# Layouts


@query(f"WITH {_A} SELECT {_Z}, row, col, round(sum(val), 4) AS val FROM a GROUP BY 2, 3")
def coalesce_coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(t.quantities(spark, sf_dir).coalesced())


_AC = "a AS (SELECT l_orderkey AS row, l_partkey AS col, sum(l_quantity) AS val FROM lineitem GROUP BY 1, 2)"


def _joined(column: str, digits: int | None = None) -> Column:
    return F.array_join(F.transform(column, lambda x: (F.round(x, digits).cast("decimal(18,2)") if digits else x).cast("string")), ",")


@query(f"WITH {_AC} SELECT {_Z}, o_orderkey AS row, coalesce(string_agg(col::VARCHAR, ',' ORDER BY col), '') AS cols, coalesce(string_agg(round(val, 2)::DECIMAL(18, 2)::VARCHAR, ',' ORDER BY col), '') AS vals FROM orders LEFT JOIN a ON row = o_orderkey GROUP BY 2")
def coo_to_csr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.to_csr(t.quantities(spark, sf_dir)).select("batch", "row", _joined("cols").alias("cols"), _joined("vals", 2).alias("vals"))


@query(f"WITH {_AC} SELECT {_Z}, p_partkey AS col, coalesce(string_agg(row::VARCHAR, ',' ORDER BY row), '') AS rows FROM part LEFT JOIN a ON col = p_partkey GROUP BY 2")
def coo_to_csc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.to_csc(t.quantities(spark, sf_dir)).select("batch", "col", _joined("rows").alias("rows"))


@query(f"WITH {_AC} SELECT {_Z}, row, col, round(val, 4) AS val FROM a")
def csr_to_coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = t.quantities(spark, sf_dir)
    return _entries(layout.from_csr(layout.to_csr(a), a.n_rows, a.n_cols))


_NO = "(SELECT count(*) FROM orders)"


@query(f"WITH c AS (SELECT i, count(l_orderkey) AS n FROM (SELECT unnest(range({_NO} + 1)) AS i) LEFT JOIN lineitem ON l_orderkey = i GROUP BY 1) SELECT {_Z}, i::BIGINT AS i, (sum(n) OVER (ORDER BY i) - n)::BIGINT AS crow FROM c")
def csr_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = t.quantities(spark, sf_dir)
    return layout.compress(a.df.select("batch", "row"), a.n_rows)


@query(f"SELECT {_Z}, l_orderkey AS row, count(*) AS n FROM lineitem GROUP BY 2")
def csr_decompress(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = t.quantities(spark, sf_dir)
    return layout.decompress(layout.compress(a.df.select("batch", "row"), a.n_rows)).groupBy("batch", "row").agg(F.count("*").alias("n"))


@query(f"WITH {_D} SELECT {_Z}, row, col, row_number() OVER (ORDER BY row, col) - 1 AS place FROM d")
def coo_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.order(t.discounts(spark, sf_dir))


@query(f"WITH {_D} SELECT b::BIGINT AS batch, row, col, round(val * (b + 1), 4) AS val FROM d, range(2) r(b)")
def stack_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = t.discounts(spark, sf_dir)
    return _entries(layout.stack(a, a.with_df(a.df.withColumn("val", F.col("val") * 2))))


@query(f"WITH {_D} SELECT {_Z}, row + b * {_NS} AS row, col + b * {_NP} AS col, round(val * (b + 1), 4) AS val FROM d, range(2) r(b)")
def block_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = t.discounts(spark, sf_dir)
    return _entries(layout.block_diag(a, a.with_df(a.df.withColumn("val", F.col("val") * 2))))


@query(f"WITH {_D} SELECT CASE WHEN row < 40 THEN 0 ELSE 1 END AS block, CASE WHEN row < 40 THEN row ELSE row - 40 END AS row, CASE WHEN row < 40 THEN col ELSE col - 60 END AS col, round(val, 4) AS val FROM d WHERE row < 40 AND col < 60 OR row >= 40 AND col >= 60")
def block_diagonal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = t.discounts(spark, sf_dir)
    first, second = layout.block_diag_split(a, (40, 60), (a.n_rows - 40, a.n_cols - 60))
    parts = [m.df.select(F.lit(k).alias("block"), "row", "col", "val") for k, m in enumerate((first, second))]
    return _rounded(parts[0].union(parts[1]))


@query("SELECT b::BIGINT AS batch, c_custkey AS row, c_custkey AS col, 1.0::DOUBLE AS val FROM customer, range(2) r(b)")
def eye_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.eye(spark, t.table(spark, sf_dir, "customer").count(), 2).df


@query(f"WITH {_D} SELECT {_Z}, col AS row, row AS col, round(val, 4) AS val FROM d")
def transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(t.discounts(spark, sf_dir).t)


_E = "e AS (SELECT user_id AS row, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS col, sum(value) / 1000 AS val FROM events GROUP BY 1, 2)"


def _events(spark: SparkSession, sf_dir: str) -> Sparse:
    held = t.table(spark, sf_dir, "events")
    kind = F.array_position(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))), F.col("event_type")) - 1
    return Sparse.of(held.select(F.col("user_id").alias("row"), kind.alias("col"), (F.col("value") / 1000).alias("val")), (t.table(spark, sf_dir, "events").agg(F.max("user_id")).first()[0]) + 1, 5).coalesced()


@query(f"WITH {_E} SELECT {_Z}, u AS row, " + ", ".join(f"round(coalesce(sum(val) FILTER (col = {k}), 0), 6) AS c{k}" for k in range(5)) + " FROM (SELECT DISTINCT user_id AS u FROM events) LEFT JOIN e ON row = u GROUP BY 2")
def densify_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(layout.densify(_events(spark, sf_dir)), digits=6)


@query(f"WITH {_E} SELECT {_Z}, row, col::BIGINT AS col, round(val, 6) AS val FROM e WHERE val <> 0")
def sparsify_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(layout.sparsify(layout.densify(_events(spark, sf_dir))), 6)


@query(f"WITH {_D} SELECT {_Z}, row, col, round(val, 4) AS val FROM d WHERE row >= col")
def lower_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(layout.triangle(t.discounts(spark, sf_dir), upper=False))


@query(f"WITH {_F} SELECT o_orderkey AS i, {_Z}, round(f0, 4) AS c0, round(f1, 4) AS c1 FROM orders JOIN f ON id = o_orderkey % {_NP}")
def select_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = t.part_features(spark, sf_dir)
    wanted = t.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), (F.col("o_orderkey") % parts.n_rows).alias("row"))
    return _rounded(layout.select_rows(parts, wanted).select("i", "batch", *(F.get("vec", F.lit(k)).alias(f"c{k}") for k in range(2))))


# Solvers: a right-hand side is made from a known solution, which SQL gives


def _known(width: int = 2, batches: int = 1, salt: int = 0, more: str = "") -> str:
    cells = ", ".join(f"((7 * c_custkey + {3 * k} + 5 * b + {salt}) % 11 - 5)::DOUBLE AS c{k}" for k in range(width))
    return f"SELECT b::BIGINT AS batch, c_custkey AS row, {cells}{more} FROM customer, range({batches}) r(b)"


def _triangular(spark: SparkSession, sf_dir: str, upper: bool = False, unit: bool = False, transpose: bool = False, n_batch: int = 1, tier: str = "local") -> DataFrame:
    a = t.lower(spark, sf_dir, n_batch, unit)
    a = a.t if upper else a
    x = t.solution(spark, sf_dir, 2, n_batch)
    op = a.t if transpose else a
    if unit:
        op = op.with_df(op.df.unionByName(layout.eye(spark, a.n_rows, n_batch).df))
    return _out(solve.triangular_solve(a, product.spmm(op, x), upper, unit, transpose, tier))


@query(_known())
def triangular_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _triangular(spark, sf_dir)


@query(_known())
def triangular_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _triangular(spark, sf_dir, upper=True)


@query(_known())
def triangular_transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _triangular(spark, sf_dir, transpose=True)


@query(_known(batches=3))
def triangular_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _triangular(spark, sf_dir, n_batch=3)


def _unit(spark: SparkSession, sf_dir: str) -> Sparse:
    """Strictly lower, over all customers; entries are small, so that substitution doesn't let errors grow."""
    a = t.lower(spark, sf_dir, unit=True)
    return a.with_df(a.df.withColumn("val", F.col("val") / 4))


def _whole(a: Sparse) -> Sparse:
    return a.with_df(a.df.unionByName(layout.eye(a.spark, a.n_rows).df))


@query(_known())
def triangular_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _unit(spark, sf_dir)
    return _out(solve.triangular_solve(a, product.spmm(_whole(a), t.solution(spark, sf_dir)), upper=False, unitriangular=True))


@query(_known())
def triangular_unit_transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _unit(spark, sf_dir)
    return _out(solve.triangular_solve(a, product.spmm(_whole(a).t, t.solution(spark, sf_dir)), upper=False, unitriangular=True, transpose=True))


@query(_known())
def triangular_by_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As deep as the table is long, in the tier that has no limit of size or depth."""
    a = t.lower(spark, sf_dir)
    return _out(solve.triangular_solve(a, product.spmm(a, t.solution(spark, sf_dir)), upper=False, tier="blocks"))


@query("SELECT 0::BIGINT AS batch, c_custkey AS row, ((7 * c_custkey) % 11 - 5)::DOUBLE AS c0 FROM customer")
def triangular_by_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shallow system: each row waits for the one at half its number."""
    held, n = t.customers(spark, sf_dir)
    i = F.col("row")
    cells = F.array(F.struct(i.alias("col"), F.lit(2.0).alias("val")), F.struct(F.floor(i / 8).alias("col"), F.lit(-0.5).alias("val")))
    a = Sparse.of(held.select("row", F.inline(cells)).where("row <> col OR val > 0"), n, n)
    return _out(solve.triangular_solve(a, product.spmm(a, t.solution(spark, sf_dir, 1)), upper=False, tier="levels"))


_TRI = "i AS (SELECT c_custkey AS i, {n} AS n FROM customer), a AS (SELECT i AS row, i AS col FROM i UNION ALL SELECT i, i - 1 FROM i WHERE i > 0 {up})".replace("{n}", "(SELECT count(*) FROM customer)")


@query(f"WITH {_TRI.format(up='UNION ALL SELECT i, i - 7 FROM i WHERE i > 6')} SELECT {_Z}, row, col, (-((7 * row + 4) % 11 - 5) * ((7 * col) % 11 - 5) - ((7 * row + 7) % 11 - 5) * ((7 * col + 3) % 11 - 5))::DOUBLE AS val FROM a")
def triangular_grad_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upstream gradient is Aᵀy, so the right-hand side's is y, which is known."""
    a, x, y = t.lower(spark, sf_dir), t.solution(spark, sf_dir), t.solution(spark, sf_dir, salt=4)
    return _entries(solve.triangular_solve_vjp(a, x, product.spmm(a.t, y), upper=False)[0])


@query(_known(salt=4))
def triangular_grad_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, x, y = t.lower(spark, sf_dir), t.solution(spark, sf_dir), t.solution(spark, sf_dir, salt=4)
    return _out(solve.triangular_solve_vjp(a, x, product.spmm(a.t, y), upper=False)[1])


_PLACES_UNIT = "SELECT i AS row, i - 1 AS col FROM i WHERE i > 0 UNION ALL SELECT i, i - 7 FROM i WHERE i > 6"


@query(f"WITH i AS (SELECT c_custkey AS i FROM customer), a AS ({_PLACES_UNIT}) SELECT {_Z}, row, col, (-((7 * col + 4) % 11 - 5) * ((7 * row) % 11 - 5) - ((7 * col + 7) % 11 - 5) * ((7 * row + 3) % 11 - 5))::DOUBLE AS val FROM a")
def triangular_grad_a_unit_transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For (I + A)ᵀ X = B the upstream gradient is (I + A) y, so that of B is y."""
    a, x, y = _unit(spark, sf_dir), t.solution(spark, sf_dir), t.solution(spark, sf_dir, salt=4)
    return _entries(solve.triangular_solve_vjp(a, x, product.spmm(_whole(a), y), upper=False, unitriangular=True, transpose=True)[0])


def _generic(spark: SparkSession, sf_dir: str, solver, down: float = -1.0, up: float = -1.0, **options) -> DataFrame:
    a = t.tridiagonal(spark, sf_dir, down, up)
    return _out(solve.generic_solve(a, product.spmm(a, t.solution(spark, sf_dir)), solver, **options))


@query(_known())
def solve_cg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _generic(spark, sf_dir, "cg")


@query(_known())
def solve_minres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _generic(spark, sf_dir, "minres")


def _shifted(times, b):
    return krylov.minres(times, b, shifts=[0.0, 1.5], value=-1.0)[1]


@query(_known())
def solve_minres_shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(-A + 1.5 I) x = b, one of two shifts that share a basis."""
    a, x = t.tridiagonal(spark, sf_dir), t.solution(spark, sf_dir)
    moved = a.with_df(a.df.withColumn("val", -F.col("val") + F.when(F.col("row") == F.col("col"), 1.5).otherwise(0.0)))
    return _out(solve.generic_solve(a, product.spmm(moved, x), _shifted))


@query(_known())
def solve_bicgstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _generic(spark, sf_dir, "bicgstab", -0.5, 1.0)


@query(_known())
def solve_cgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _generic(spark, sf_dir, "cgs", -0.5, 1.0)


@query(_known())
def solve_gmres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _generic(spark, sf_dir, "gmres", -0.5, 1.0)


@query(_known())
def solve_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse factorisation."""
    return _generic(spark, sf_dir, "direct", -0.5, 1.0)


@query(f"WITH x AS ({_known(salt=0)}), y AS ({_known(salt=4)}) SELECT 0 AS side, * FROM x UNION ALL SELECT 1, * FROM y")
def solve_direct_grad_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The solution and the gradient in B from one factorisation."""
    a, x, y = t.tridiagonal(spark, sf_dir, -0.5, 1.0), t.solution(spark, sf_dir), t.solution(spark, sf_dir, salt=4)
    found, _, db = solve.direct_solve_vjp(a, product.spmm(a, x), product.spmm(a.t, y))
    parts = [_out(d).select(F.lit(k).alias("side"), "*") for k, d in enumerate((found, db))]
    return parts[0].unionByName(parts[1])


@query(_known())
def solve_minres_preconditioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a diagonal that isn't the matrix's own."""

    def solver(times, b):
        return krylov.minres(times, b, precondition=lambda r: r / (1.0 + np.arange(len(r)) % 3)[:, None])

    return _generic(spark, sf_dir, solver)


@query(_known())
def solve_from_a_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a start and the tolerances of other libraries' names."""

    def solver(times, b):
        return krylov.bicgstab(times, b, start=np.ones_like(b), **solve.solver_options("bicgstab", {"tol": 1e-12, "maxiter": 500}))

    return _generic(spark, sf_dir, solver, -0.5, 1.0)


@query(_known())
def solve_bicgstab_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = t.tridiagonal(spark, sf_dir, -0.5, 1.0)
    return _out(solve.generic_solve(a, product.spmm(a, t.solution(spark, sf_dir)), "bicgstab", tier="distributed", tol=1e-8))


@query(_known(salt=4))
def solve_grad_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transposed system has a solver of its own."""
    a, x, y = t.tridiagonal(spark, sf_dir, -0.5, 1.0), t.solution(spark, sf_dir), t.solution(spark, sf_dir, salt=4)
    return _out(solve.generic_solve_vjp(a, x, product.spmm(a.t, y), "bicgstab", transpose_solver="gmres")[1])


@query(_known())
def solve_cg_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = t.tridiagonal(spark, sf_dir)
    return _out(solve.generic_solve(a, product.spmm(a, t.solution(spark, sf_dir)), "cg", tier="distributed", tolerance=1e-7))


@query("SELECT 0::BIGINT AS batch, c_custkey AS row, ((7 * c_custkey) % 11 - 5)::DOUBLE AS c0 FROM customer")
def least_squares_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice as many rows as columns, as in the local tier."""
    a = _tall(spark, sf_dir)
    return _out(solve.lstsq_distributed(a, product.spmm(a, t.solution(spark, sf_dir, 1)), tolerance=1e-6))


@query(f"WITH {_TRI.format(up='UNION ALL SELECT i, i + 1 FROM i WHERE i + 1 < n')} SELECT {_Z}, row, col, (-((7 * row + 4) % 11 - 5) * ((7 * col) % 11 - 5) - ((7 * row + 7) % 11 - 5) * ((7 * col + 3) % 11 - 5))::DOUBLE AS val FROM a")
def solve_grad_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For a matrix that isn't symmetric: the transposed relation is solved."""
    a, x, y = t.tridiagonal(spark, sf_dir, -0.5, 1.0), t.solution(spark, sf_dir), t.solution(spark, sf_dir, salt=4)
    return _entries(solve.generic_solve_vjp(a, x, product.spmm(a.t, y), "bicgstab")[0])


def _tall(spark: SparkSession, sf_dir: str) -> Sparse:
    """Twice as many rows as columns: a tridiagonal matrix over an identity."""
    a = t.tridiagonal(spark, sf_dir, -0.5, 1.0)
    low = layout.eye(spark, a.n_rows).df.withColumn("row", F.col("row") + a.n_rows)
    return Sparse.of(a.df.unionByName(low), 2 * a.n_rows, a.n_cols)


@query(_known())
def least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _tall(spark, sf_dir)
    return _out(solve.lstsq(a, product.spmm(a, t.solution(spark, sf_dir))))


@query("SELECT 0::BIGINT AS batch, c_custkey AS row, round(2 * ((7 * c_custkey) % 11 - 5) / 4.25, 4) AS c0 FROM customer")
def least_squares_damped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """min |2 x - b|² + 0.25 |x|² is 2 b / 4.25."""
    held, n = t.customers(spark, sf_dir)
    a = Sparse.of(held.select("row", F.col("row").alias("col"), F.lit(2.0).alias("val")), n, n)
    return _out(solve.lstsq(a, t.solution(spark, sf_dir, 1), krylov.LsmrSettings(damp=0.5)))


@query("SELECT 0::BIGINT AS batch, row, col, (-((7 * col + 4) % 11 - 5) * ((7 * col) % 11 - 5) / (4.0 * 1.0))::DOUBLE AS val FROM (SELECT c_custkey AS row, c_custkey AS col FROM customer)")
def least_squares_grad_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For A = 2 I and B = A x the rest is zero, so dA = -dB xᵀ with dB = g / 2, here for g = y / 2."""
    held, n = t.customers(spark, sf_dir)
    a = Sparse.of(held.select("row", F.col("row").alias("col"), F.lit(2.0).alias("val")), n, n)
    x, y = t.solution(spark, sf_dir, 1), t.solution(spark, sf_dir, 1, salt=4)
    g = y.with_df(y.df.withColumn("vec", F.transform("vec", lambda v: v / 2)))
    return _entries(solve.lstsq_vjp(a, product.spmm(a, x), x, g)[0])


_REST = "x AS (SELECT c_custkey AS i, ((7 * c_custkey) % 11 - 5)::DOUBLE AS x, ((7 * c_custkey + 4) % 11 - 5)::DOUBLE AS y FROM customer)"


def _stacked(spark: SparkSession, sf_dir: str) -> tuple[Sparse, Dense, Dense, Dense]:
    """A = [I; I], a side [x + 1; x - 1] whose solution x leaves a rest of [1; -1], and an upstream gradient y."""
    held, n = t.customers(spark, sf_dir)
    rows = held.select("row", F.col("row").alias("col"), F.lit(1.0).alias("val"))
    a = Sparse.of(rows.unionByName(rows.withColumn("row", F.col("row") + n)), 2 * n, n)
    x, y = t.solution(spark, sf_dir, 1), t.solution(spark, sf_dir, 1, salt=4)
    moved = [x.df.withColumns({"row": F.col("row") + k * n, "vec": F.array(F.get("vec", F.lit(0)) + d)}) for k, d in ((0, 1.0), (1, -1.0))]
    return a, Dense.of(moved[0].unionByName(moved[1]), 2 * n, 1), x, y


@query(f"WITH {_REST} SELECT {_Z}, i + k * (SELECT count(*) FROM x) AS row, i AS col, round(-x * y / 2 + (1 - 2 * k) * y / 2, 4) AS val FROM x, range(2) r(k)")
def least_squares_grad_a_with_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dB = y / 2 on both halves, (AᵀA)⁻¹y = y / 2, and the rest is 1 above and -1 below."""
    a, b, x, y = _stacked(spark, sf_dir)
    return _entries(solve.lstsq_vjp(a, b, x, y)[0])


@query(f"WITH {_REST} SELECT {_Z}, i + k * (SELECT count(*) FROM x) AS row, round(y / 2, 4) AS c0 FROM x, range(2) r(k)")
def least_squares_grad_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, x, y = _stacked(spark, sf_dir)
    return _out(solve.lstsq_vjp(a, b, x, y, solver=lambda m, side: solve.lstsq(m, side))[1])


# Encoding

_SHAPE = (3, 4, 5, 6)
_DIRS = "SELECT c, z, y, x FROM range(0, 3) a(c), range(-1, 2) b(z), range(-1, 2) d(y), range(-1, 2) e(x) WHERE (z * z + y * y + x * x <= 1) AND NOT (c = 0 AND z = 0 AND y = 0 AND x = 0)"
_LOWER = "(c > 0 OR z > 0 OR (z = 0 AND (y > 0 OR (y = 0 AND x > 0))))"
_KEY = "100 * c * c + z * z + y * y + x * x, abs(c), abs(z), abs(y), abs(x), c >= 0, z >= 0, y >= 0, x >= 0"


@query(f"SELECT row_number() OVER (ORDER BY {_KEY}) - 1 AS offset_id, c || ',' || z || ',' || y || ',' || x AS spot FROM ({_DIRS}) WHERE {_LOWER}")
def encoder_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = encode.offsets(1, 3, upper=False, channels=3, relation="inter")
    return spark.createDataFrame([(k, ",".join(map(str, o))) for k, o in enumerate(held)], "offset_id long, spot string")


_PAIRS = f"o AS (SELECT row_number() OVER (ORDER BY {_KEY}) - 1 AS offset_id, * FROM ({_DIRS}) WHERE {_LOWER}), v AS (SELECT vc * 120 + vz * 30 + vy * 6 + vx AS row, * FROM range(3) a(vc), range(4) b(vz), range(5) d(vy), range(6) e(vx)), p AS (SELECT offset_id, row, row - (c * 120 + z * 30 + y * 6 + x) AS col FROM v, o WHERE vc - c BETWEEN 0 AND 2 AND vz - z BETWEEN 0 AND 3 AND vy - y BETWEEN 0 AND 4 AND vx - x BETWEEN 0 AND 5)"


def _encoder() -> encode.PairwiseEncoder:
    return encode.PairwiseEncoder(1, _SHAPE, upper=False, relation="inter")


@query(f"WITH {_PAIRS} SELECT offset_id::INTEGER AS offset_id, row, col FROM p")
def encoder_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoder().structure(spark).select("offset_id", "row", "col")


@query(f"WITH {_PAIRS} SELECT {_Z}, row, col, ((offset_id * 13 + row * 7) % 10)::DOUBLE AS val FROM p")
def encoder_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _encoder()
    every = index(spark, e.size, "row").crossJoin(F.broadcast(index(spark, len(e.offsets), "offset_id")))
    return e.encode(every.select(F.col("offset_id").cast("int").alias("offset_id"), "row", ((F.col("offset_id") * 13 + F.col("row") * 7) % 10).cast("double").alias("val"))).df


@query(f"WITH {_PAIRS} SELECT {_Z}, o.offset_id::INTEGER AS offset_id, v.row, coalesce((p.row * 3 + p.col) % 11, 0)::DOUBLE AS val FROM v CROSS JOIN o LEFT JOIN p ON p.offset_id = o.offset_id AND p.row = v.row")
def encoder_grad(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _encoder()
    g = e.structure(spark).select("row", "col", ((F.col("row") * 3 + F.col("col")) % 11).cast("double").alias("val"))
    return e.encode_vjp(Sparse.of(g, e.size, e.size))


# Distributions: the noise is a formula, so that SQL can follow


def _loc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.customers(spark, sf_dir)[0].select(F.lit(0).cast("long").alias("batch"), "row", (F.col("row") % 10).cast("double").alias("loc"))


def _diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.customers(spark, sf_dir)[0].select(F.lit(0).cast("long").alias("batch"), "row", F.pow((F.col("row") % 3 + 1).cast("double"), F.lit(2)).alias("d"))


def _eps(k: int, at: str = "c_custkey") -> str:
    return f"((7 * ({at}) + {3 * k}) % 11 - 5)"


def _drawn(k: int) -> str:
    low = f"CASE WHEN c_custkey >= 1 THEN (0.5 + c_custkey % 3 / 4.0) * {_eps(k, 'c_custkey - 1')} ELSE 0 END"
    far = f"CASE WHEN c_custkey >= 7 THEN -0.25 * {_eps(k, 'c_custkey - 7')} ELSE 0 END"
    return f"round(c_custkey % 10 + (2.0 + c_custkey % 5) * {_eps(k)} + {low} + {far}, 4) AS c{k}"


@query(f"SELECT {_Z}, c_custkey AS row, {_drawn(0)}, {_drawn(1)} FROM customer")
def mvn_covariance_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(SparseMVN(_loc(spark, sf_dir), scale_tril=t.lower(spark, sf_dir)).rsample(t.solution(spark, sf_dir)))


def _spread(at: str, k: int) -> str:
    return f"(({at}) % 3 + 1) * {_eps(k, at)}"


def _drawn_ldlt(k: int) -> str:
    low = f"CASE WHEN c_custkey >= 1 THEN (0.5 + c_custkey % 3 / 4.0) * {_spread('c_custkey - 1', k)} ELSE 0 END"
    far = f"CASE WHEN c_custkey >= 7 THEN -0.25 * {_spread('c_custkey - 7', k)} ELSE 0 END"
    return f"round(c_custkey % 10 + {_spread('c_custkey', k)} + {low} + {far}, 4) AS c{k}"


@query(f"SELECT {_Z}, c_custkey AS row, {_drawn_ldlt(0)}, {_drawn_ldlt(1)} FROM customer")
def mvn_covariance_ldlt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(SparseMVN(_loc(spark, sf_dir), scale_tril=t.lower(spark, sf_dir, unit=True), diagonal=_diagonal(spark, sf_dir)).rsample(t.solution(spark, sf_dir)))


_SHIFTED = ", ".join(f"(c_custkey % 10 + {_eps(k)})::DOUBLE AS c{k}" for k in range(2))


@query(f"SELECT {_Z}, c_custkey AS row, {_SHIFTED} FROM customer")
def mvn_precision_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The noise is Lᵀx for a known x, so the draw is the mean plus x."""
    a, x = t.lower(spark, sf_dir), t.solution(spark, sf_dir)
    return _out(SparseMVN(_loc(spark, sf_dir), precision_tril=a).rsample(product.spmm(a.t, x)))


@query(f"SELECT {_Z}, c_custkey AS row, {_SHIFTED} FROM customer")
def mvn_precision_ldlt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The noise is sqrt(d) times (I + L)ᵀx for a known x."""
    a = _unit(spark, sf_dir)
    eta = product.spmm(_whole(a).t, t.solution(spark, sf_dir))
    eps = eta.with_df(eta.df.withColumn("vec", F.transform("vec", lambda v: v * (F.col("row") % 3 + 1))))
    return _out(SparseMVN(_loc(spark, sf_dir), precision_tril=a, diagonal=_diagonal(spark, sf_dir)).rsample(eps))


_D_GRAD = " + ".join(f"({_eps(k)} * {_eps(k, 'c_custkey + 1')})" for k in range(2))


@query(f"SELECT {_Z}, c_custkey AS row, round(-0.5 / power(c_custkey % 3 + 1, 3) * ({_D_GRAD}), 6) AS g FROM customer")
def mvn_precision_grad_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upstream gradient is (I + L) y, so that of the scaled noise is y."""
    a = _unit(spark, sf_dir)
    held = SparseMVN(_loc(spark, sf_dir), precision_tril=a, diagonal=_diagonal(spark, sf_dir))
    return _rounded(held.diagonal_vjp(t.solution(spark, sf_dir), product.spmm(_whole(a), t.solution(spark, sf_dir, salt=7))), 6)


def _through(k: int) -> str:
    up = "CASE WHEN c_custkey + 1 < n THEN (0.5 + (c_custkey + 1) % 3 / 4.0) * " + _eps(k, "c_custkey + 2") + " ELSE 0 END"
    far = "CASE WHEN c_custkey + 7 < n THEN -0.25 * " + _eps(k, "c_custkey + 8") + " ELSE 0 END"
    return f"{_eps(k)} * ({_eps(k, 'c_custkey + 1')} + {up} + {far})"


@query(f"SELECT {_Z}, c_custkey AS row, round(0.5 / (c_custkey % 3 + 1) * ({_through(0)} + {_through(1)}), 6) AS g FROM customer, (SELECT count(*) AS n FROM customer)")
def mvn_covariance_grad_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = SparseMVN(_loc(spark, sf_dir), scale_tril=t.lower(spark, sf_dir, unit=True), diagonal=_diagonal(spark, sf_dir))
    return _rounded(held.diagonal_vjp(t.solution(spark, sf_dir), t.solution(spark, sf_dir, salt=7)), 6)


@query(f"SELECT {_Z}, c_custkey AS row, (c_custkey % 10)::DOUBLE AS loc, true AS plain FROM customer")
def mvn_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = api.SparseMultivariateNormalNative(_loc(spark, sf_dir), t.lower(spark, sf_dir))
    return held.mean.select("batch", "row", "loc", F.lit(not held.is_ldlt and held.factor.n_rows == held.scale_tril.n_rows).alias("plain"))


_L = "i AS (SELECT c_custkey AS i FROM customer), l AS (SELECT i AS row, i AS col, 2.0 + i % 5 AS val FROM i UNION ALL SELECT i, i - 1, 0.5 + i % 3 / 4.0 FROM i WHERE i > 0 UNION ALL SELECT i, i - 7, -0.25 FROM i WHERE i > 6)"


@query(f"WITH {_L} SELECT {_Z}, a.row, b.row AS col, round(sum(a.val * b.val), 4)::DOUBLE AS val FROM l a JOIN l b ON a.col = b.col GROUP BY 2, 3")
def mvn_covariance_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(SparseMVN(_loc(spark, sf_dir), scale_tril=t.lower(spark, sf_dir)).covariance())


@query(f"WITH {_L} SELECT {_Z}, row, round(sum(val * val), 4)::DOUBLE AS variance FROM l GROUP BY 2")
def mvn_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(SparseMVN(_loc(spark, sf_dir), scale_tril=t.lower(spark, sf_dir)).variance())


@query(f"SELECT {_Z}, round(-0.5 * (count(*) * ln(2 * pi()) + sum({_eps(0)} * {_eps(0)})) - sum(ln(2.0 + c_custkey % 5)), 3) AS log_prob FROM customer")
def mvn_log_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value is the mean plus L x for a known x."""
    a, loc = t.lower(spark, sf_dir), _loc(spark, sf_dir)
    held = SparseMVN(loc, scale_tril=a)
    value = held.rsample(t.solution(spark, sf_dir, 1)).df.select("batch", "row", F.get("vec", F.lit(0)).alias("val"))
    return _rounded(held.log_prob(value), 3)


@query(f"WITH {_L} SELECT {_Z}, row, col, ({_eps(0, 'row + 1')} * {_eps(0, 'col')} + {_eps(1, 'row + 1')} * {_eps(1, 'col')})::DOUBLE AS val FROM l")
def mvn_grad_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = SparseMVN(_loc(spark, sf_dir), scale_tril=t.lower(spark, sf_dir))
    return _entries(held.rsample_vjp(t.solution(spark, sf_dir), t.solution(spark, sf_dir, salt=7))[1])


def _uniform(k: int, salt: int) -> str:
    return f"((('0x' || substr(md5('0:' || c_custkey || ':{k}:{salt}:3'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"


@query(f"SELECT {_Z}, c_custkey AS row, " + ", ".join(f"round(sqrt(-2 * ln({_uniform(k, 1)})) * cos(2 * pi() * {_uniform(k, 2)}), 4) AS c{k}" for k in range(4)) + " FROM customer")
def mvn_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(noise(spark, t.table(spark, sf_dir, "customer").count(), 4, seed=3))


# Statistical checks, on all coordinates of the embeddings

_WIDE = 64


def _samples(spark: SparkSession, sf_dir: str) -> Dense:
    held = t.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.col("embedding").cast("array<double>").alias("vec"))
    return Dense.of(held, held.count(), _WIDE)


_COV = "v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), c AS (SELECT a.i, b.i AS j, count(*) AS n, avg(a.x) AS mean, covar_samp(a.x, b.x) AS cov FROM v a JOIN v b USING (vec_id) GROUP BY 1, 2)"


@query(f"WITH {_COV} SELECT {_Z}, n, i::INTEGER AS i, j::INTEGER AS j, round(mean, 6) AS mean, round(cov, 6) AS cov FROM c")
def sample_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = stats.moments(_samples(spark, sf_dir)).select("batch", "n", "mean", F.posexplode("cov").alias("i", "r"))
    return _rounded(held.select("batch", "n", "i", F.posexplode("r").alias("j", "cov"), "mean").select("batch", "n", "i", "j", F.get("mean", F.col("i")).alias("mean"), "cov"), 6)


@query()
def hotelling_t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inverse of 64 x 64 numbers, which SQL has no function for; the tests compare it with numpy."""
    held = _samples(spark, sf_dir)
    df = stats.moments(held).withColumn("true_mean", F.array_repeat(F.lit(0.0), _WIDE))
    return _rounded(stats.hotelling_t2(df, held.n_rows, p=_WIDE))


_PAIR = "m AS (SELECT count(*) AS n, avg(embedding[1]::DOUBLE) AS m0, avg(embedding[2]::DOUBLE) AS m1, var_samp(embedding[1]::DOUBLE) AS s00, covar_samp(embedding[1]::DOUBLE, embedding[2]::DOUBLE) AS s01, var_samp(embedding[2]::DOUBLE) AS s11 FROM embeddings)"


@query(f"WITH {_PAIR}, t AS (SELECT *, n * (s11 * m0 * m0 - 2 * s01 * m0 * m1 + s00 * m1 * m1) / (s00 * s11 - s01 * s01) AS s, (n - 1) * (power(0.05, -2.0 / (n - 2)) - 1) AS t FROM m) SELECT {_Z}, s <= t AS accepted, round(s, 4) AS statistic, round(t, 4) AS threshold FROM t")
def hotelling_t2_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the first two coordinates beside each other, where SQL can follow: F with 2 and n - 2 degrees has a closed form."""
    held = _samples(spark, sf_dir)
    pair = Dense.of(held.df.withColumn("vec", F.slice("vec", 1, 2)), held.n_rows, 2)
    df = stats.moments(pair).withColumn("true_mean", F.array(F.lit(0.0), F.lit(0.0)))
    return _rounded(stats.hotelling_t2(df, held.n_rows, p=2))


#: 95 % quantile of chi-squared with 64 * 65 / 2 degrees, a fixed value.
_CHI2 = 2187.2147


@query(f"WITH {_COV}, s AS (SELECT any_value(n) / 2.0 * sum(power(cov - CASE WHEN i = j THEN 1 ELSE 0 END, 2)) AS s FROM c) SELECT {_Z}, s <= {_CHI2} AS accepted, round(s, 3) AS statistic, round({_CHI2}, 1) AS threshold FROM s")
def nagao_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _samples(spark, sf_dir)
    one = F.array(*(F.array(*(F.lit(float(i == j)) for j in range(_WIDE))) for i in range(_WIDE)))
    out = stats.nagao(stats.moments(held).withColumn("true_cov", one), held.n_rows, p=_WIDE)
    return out.select("batch", "accepted", F.round("statistic", 3).alias("statistic"), F.round("threshold", 1).alias("threshold"))


# Sources, SQL and streams


@query("SELECT 5000::BIGINT AS n, 5000::BIGINT AS places, true AS inside")
def random_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = random.rand_sparse(spark, 300, 200, 5000, seed=4)
    return a.df.agg(F.count("*").alias("n"), F.countDistinct("row", "col").alias("places"), F.bool_and((F.col("val") >= 0) & (F.col("val") < 1) & F.col("row").between(0, 299) & F.col("col").between(0, 199)).alias("inside"))


@query("SELECT b::BIGINT AS batch, 900::BIGINT AS n, 900::BIGINT AS places, 80::BIGINT AS diagonal, true AS inside FROM range(2) r(b)")
def random_sparse_triangular(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = random.rand_sparse_tri(spark, 80, 900, n_batch=2, upper=False, seed=4)
    return a.df.groupBy("batch").agg(F.count("*").alias("n"), F.countDistinct("row", "col").alias("places"), F.count_if(F.col("row") == F.col("col")).alias("diagonal"), F.bool_and(F.col("row") >= F.col("col")).alias("inside"))


@query("SELECT b::BIGINT AS batch, 60::BIGINT AS rows, true AS dominant, true AS symmetric FROM range(2) r(b)")
def random_spd(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = random.make_spd(spark, 60, 0.3, seed=4, n_batch=2).df
    size = F.when(F.col("row") == F.col("col"), F.col("val")).otherwise(-F.abs("val"))
    rows = df.groupBy("batch", "row").agg(F.sum(size).alias("gap")).groupBy("batch").agg(F.count("*").alias("rows"), F.bool_and(F.col("gap") > 0.5).alias("dominant"))
    other = df.select("batch", F.col("col").alias("row"), F.col("row").alias("col"), F.col("val").alias("v"))
    same = df.join(other, ["batch", "row", "col"], "left").groupBy("batch").agg(F.bool_and(F.coalesce(F.col("val") == F.col("v"), F.lit(False))).alias("symmetric"))
    return rows.join(same, "batch")


_SHAPES = "SELECT u::BOOLEAN AS upper, s::BOOLEAN AS strict, 500::BIGINT AS n, CASE WHEN s = 1 THEN 0 ELSE 80 END::BIGINT AS diagonal, true AS inside FROM range(2) a(u), range(2) b(s)"


@query(_SHAPES)
def random_triangular_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict and not, upper and lower, by way of the compressed layout and back."""
    out = None
    for upper in (False, True):
        for strict in (False, True):
            csr = api.rand_sparse_tri(spark, 80, 500, layout="csr", upper=upper, strict=strict, seed=4)
            df = layout.from_csr(csr, 80, 80).df
            within = F.col("row") <= F.col("col") if upper else F.col("row") >= F.col("col")
            part = df.agg(F.count("*").alias("n"), F.count_if(F.col("row") == F.col("col")).alias("diagonal"), F.bool_and(within).alias("inside"))
            part = part.select(F.lit(upper).alias("upper"), F.lit(strict).alias("strict"), "n", "diagonal", "inside")
            out = part if out is None else out.unionByName(part)
    return out


@query("SELECT i::BIGINT AS row, 25::BIGINT AS n FROM range(40) r(i) WHERE false UNION ALL SELECT -1, 1000")
def random_csr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries that the compressed layout of a random matrix holds."""
    csr = api.rand_sparse(spark, 40, 50, 1000, layout="csr", seed=5)
    return csr.agg(F.lit(-1).cast("long").alias("row"), F.sum(F.size("cols")).cast("long").alias("n"))


@query(f"WITH {_BIDIR} SELECT axis::INTEGER AS axis, {_Z}, string_agg(round(lse, 3)::DECIMAL(18, 3)::VARCHAR, ',' ORDER BY idx) AS lses FROM l GROUP BY 1")
def lse_bidir_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reduce.bidir_logsumexp(t.discounts(spark, sf_dir), layout="nested")
    return out.select("axis", "batch", F.array_join(F.transform("lses", lambda x: F.round(x, 3).cast("decimal(18,3)").cast("string")), ",").alias("lses"))


_VOLUME = "v AS (SELECT vc * 12 + vy * 4 + vx AS row, * FROM range(2) a(vc), range(3) d(vy), range(4) e(vx))"
_NEAR = "o AS (SELECT * FROM (VALUES (0, 0, 0), (0, -1, 0), (0, 0, -1)) t(c, y, x))"


@query(f"WITH {_VOLUME}, {_NEAR}, k AS (SELECT row_number() OVER (ORDER BY NOT (c = 0 AND y = 0 AND x = 0), 100 * c * c + y * y + x * x, abs(c), abs(y), abs(x), c >= 0, y >= 0, x >= 0) - 1 AS id, * FROM o) SELECT b::BIGINT AS batch, row, row - (c * 12 + y * 4 + x) AS col, ((id * 13 + row * 7 + b) % 10)::DOUBLE AS val FROM v, k, range(2) r(b) WHERE vc - c BETWEEN 0 AND 1 AND vy - y BETWEEN 0 AND 2 AND vx - x BETWEEN 0 AND 3")
def encoder_batched_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, the diagonal and the upper side, channels among themselves; by the deprecated name."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", DeprecationWarning)
        e = api.PairwiseVoxelEncoder(1, (2, 3, 4), diag=True, upper=True, relation="intra")
    cells = grid(spark, batch=2, offset_id=len(e.offsets), row=e.size)
    val = ((F.col("offset_id") * 13 + F.col("row") * 7 + F.col("batch")) % 10).cast("double")
    return e.encode(cells.select("batch", F.col("offset_id").cast("int").alias("offset_id"), "row", val.alias("val")), 2).df


@query(f"WITH {_D} SELECT {_Z}, row, col, round(val, 4) AS val FROM d")
def matrix_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as a Matrix Market file and read again."""
    path = scratch.fresh(spark, "market")
    market.write(t.discounts(spark, sf_dir), path)
    return _entries(market.read(spark, path))


@query(f"WITH {_D} SELECT row, round(ln(sum(exp(val))), 4) AS lse FROM d GROUP BY 1")
def sql_logsumexp(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql_functions.register(spark)
    name = f"discounts_{uuid.uuid4().hex}"
    sql_functions.view(t.discounts(spark, sf_dir), name)
    return _rounded(spark.sql(f"SELECT row, lse_merge(collect_list(struct(b, s))) AS lse FROM (SELECT row, lse_bucket(val) AS b, sum(lse_term(val)) AS s FROM {name} GROUP BY ALL) GROUP BY row"))


@query("SELECT i::BIGINT AS row, i::BIGINT AS col, 1.0::DOUBLE AS val FROM range(50) r(i)")
def sql_eye(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql_functions.register(spark)
    return spark.sql("SELECT * FROM sparse_eye(50)")


@query("SELECT date_trunc('day', ts) AS day, user_id AS row, round(max(value) + ln(sum(exp(value - top))), 4) AS lse, count(*) AS n FROM (SELECT *, max(value) OVER (PARTITION BY date_trunc('day', ts), user_id) AS top FROM events) GROUP BY 1, 2")
def stream_logsumexp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, taken in until nothing is left; windows of a day, each as its last update has it."""
    schema = t.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    out = incremental.windowed_logsumexp(t.stream_of(events), "1 day", "400 days")
    path = scratch.fresh(spark, "updates")
    write = lambda batch, number: batch.withColumn("number", F.lit(number)).write.mode("append").parquet(path)
    run = out.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", scratch.fresh(spark, "stream")).trigger(availableNow=True).start()
    run.awaitTermination()
    last = F.max(F.struct("number", "lse", "n")).alias("s")
    return _rounded(spark.read.parquet(path).groupBy(F.col("start").alias("day"), "row").agg(last).select("day", "row", "s.lse", "s.n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse by dense over orders and parts."""
    return spmm_order_part(spark, sf_dir)
