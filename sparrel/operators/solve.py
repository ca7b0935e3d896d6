"""Solvers: triangular, generic and least squares, with gradients on the stored entries.

Two tiers, which ``auto`` chooses by size and which never change the method. Local: a system is one group, gathered with its
right-hand side in one task and solved in numpy; batches are solved side by side. It is for systems of at most
``LOCAL_ENTRIES`` entries and ``LOCAL_CELLS`` numbers in a side, which is checked. Distributed: triangular systems by blocks of
rows that a task can solve, or by levels; conjugate gradients and stabilised biconjugate gradients over frames, each step
joins and sums; least squares by conjugate gradients on the normal equations. Methods that have no distributed form say so,
and iterations that don't reach their tolerance are an error.

Gradients follow one rule: with X = A⁻¹B, dB = A⁻ᵀG, and dA = -dB·Xᵀ at the stored entries of A. The transposed system is
solved with the transposed relation, so the rule holds for any A, and as the gradients are solves and products
themselves, they can be differentiated again by composing them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..frames import Dense, Sparse, same_batches
from . import krylov
from .product import sddmm, spmm

#: Entries of one system that a task may gather.
LOCAL_ENTRIES = 4_000_000
#: Numbers that a system's right-hand sides, or solutions, may have in a task.
LOCAL_CELLS = 32_000_000
#: Systems whose scalars, a few numbers each, are broadcast to the vectors.
FEW_SYSTEMS = 100_000
_ENTRIES = "_batch long, row long, col long, val double"

#: (rows, cols, vals, shape, right-hand sides) to solutions
Local = Callable[[np.ndarray, np.ndarray, np.ndarray, tuple[int, int], np.ndarray], np.ndarray]


def matvec(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, n: int) -> krylov.MatVec:
    """x ↦ A·x for columns x, by sums over sorted entries."""
    order = np.argsort(rows, kind="stable")
    rows, cols, vals = rows[order], cols[order], vals[order]
    found, first = np.unique(rows, return_index=True)

    def times(x: np.ndarray) -> np.ndarray:
        out = np.zeros((n, x.shape[1]), dtype=np.result_type(x, vals))
        if len(found):
            out[found] = np.add.reduceat(vals[:, None] * x[cols], first, axis=0)
        return out

    return times


def _most_entries(a: Sparse) -> int:
    return a.df.groupBy("batch").count().agg(F.max("count")).first()[0] or 0


def _fits(a: Sparse, width: int) -> bool:
    return max(a.n_rows, a.n_cols) * width <= LOCAL_CELLS and _most_entries(a) <= LOCAL_ENTRIES


def _solved(a: Sparse, b: Dense, solve: Local, n_out: int, fits: bool | None = None) -> Dense:
    """``solve`` applied to each batch as a group; ``fits`` if it is known that a system fits in a task."""
    same_batches(a, b)
    if a.n_rows != b.n_rows:
        raise ValueError(f"A has {a.n_rows} rows and B {b.n_rows}")
    if not (_fits(a, b.width) if fits is None else fits):
        raise ValueError(f"a system is too large for a task, which holds {LOCAL_ENTRIES} entries and {LOCAL_CELLS} numbers of a side; use the distributed tier")
    shape, width = (a.n_rows, a.n_cols), b.width

    def run(entries: pa.Table, side: pa.Table) -> pa.Table:
        if not side.num_rows:
            return pa.table({"batch": pa.array([], pa.int64()), "row": pa.array([], pa.int64()), "vec": pa.array([], pa.list_(pa.float64()))})
        rhs = np.zeros((shape[0], width))
        rhs[side["row"].to_numpy()] = np.array(side["vec"].to_pylist(), dtype=np.float64).reshape(-1, width)
        x = solve(entries["row"].to_numpy(), entries["col"].to_numpy(), entries["val"].to_numpy(), shape, rhs)
        return pa.table({"batch": pa.array([side["batch"][0].as_py()] * n_out, pa.int64()), "row": pa.array(np.arange(n_out)), "vec": pa.array(x.tolist(), pa.list_(pa.float64()))})

    entries = a.coalesced().df.toDF("_batch", "row", "col", "val")
    out = entries.groupBy("_batch").cogroup(b.df.groupBy("batch")).applyInArrow(run, "batch long, row long, vec array<double>")
    return Dense(out, n_out, width, a.n_batch)


def _substitute(rows, cols, vals, shape, b, upper: bool, unit: bool, transpose: bool) -> np.ndarray:
    if transpose:
        rows, cols, upper = cols, rows, not upper
    kept = rows < cols if upper else rows > cols
    diagonal = np.ones(shape[0])
    if not unit:
        diagonal = np.zeros(shape[0])
        on = rows == cols
        diagonal[rows[on]] = vals[on]
        if (diagonal == 0).any():
            raise ZeroDivisionError("a diagonal entry is zero or missing")
    rows, cols, vals = rows[kept], cols[kept], vals[kept]
    order = np.argsort(rows, kind="stable")
    rows, cols, vals = rows[order], cols[order], vals[order]
    ends = np.searchsorted(rows, np.arange(shape[0] + 1))
    x = np.array(b, dtype=np.float64)
    for i in range(shape[0] - 1, -1, -1) if upper else range(shape[0]):
        part = slice(ends[i], ends[i + 1])
        x[i] = (x[i] - vals[part] @ x[cols[part]]) / diagonal[i]
    return x


def triangular_solve(a: Sparse, b: Dense, upper: bool = True, unitriangular: bool = False, transpose: bool = False, tier: str = "auto") -> Dense:
    """X with op(A)·X = B. ``upper`` names the stored triangle, with ``transpose`` too; entries on its other side are ignored.

    With ``unitriangular`` the diagonal is one and must not be stored. Tiers: ``local``, ``blocks``, which is for systems of any
    size and depth, and ``levels``, which solves all rows whose dependencies are solved at once and is for shallow ones.
    """
    if a.n_rows != a.n_cols:
        raise ValueError("a triangular matrix is square")
    if tier not in ("auto", "local", "blocks", "levels"):
        raise ValueError(f"no tier {tier!r}")
    if unitriangular and not a.df.where("row = col").isEmpty():
        raise ValueError("with unitriangular=True the diagonal must not be stored")
    fits = None if tier != "auto" else _fits(a, b.width)
    if tier == "levels":
        return _by_levels(a, b, upper, unitriangular, transpose)
    if tier == "blocks" or fits is False:
        return _by_blocks(a, b, upper, unitriangular, transpose)
    return _solved(a, b, partial(_substitute, upper=upper, unit=unitriangular, transpose=transpose), a.n_rows, fits)


def _by_blocks(a: Sparse, b: Dense, upper: bool, unit: bool, transpose: bool, size: int | None = None) -> Dense:
    """Block substitution: the rows of a block are solved in one task for each batch, then subtracted from all that follow.

    Entries are written by the block of their column, so each is read once, and there are as many rounds as blocks. Without
    a size, blocks are halved until the densest one fits in a task.
    """
    same_batches(a, b)
    op = (a.t if transpose else a).coalesced()
    lower = upper == transpose
    held = scratch.cut(op.df.where("row >= col" if lower else "row <= col"))
    if size is None:
        size = max(1, min(a.n_rows, LOCAL_CELLS // b.width))
        near = lambda n: held.where(F.expr(f"row div {n} = col div {n}")).groupBy("batch", F.expr(f"row div {n}")).count().agg(F.max("count")).first()[0] or 0
        while size > 1 and near(size) > LOCAL_ENTRIES:
            size = -(-size // 2)
    path, solved = scratch.fresh(a.spark, "blocks"), scratch.fresh(a.spark, "solved")
    held.withColumn("_cb", F.expr(f"col div {size}")).write.partitionBy("_cb").parquet(path)
    blocked = a.spark.read.schema(f"{_ENTRIES.replace('_batch', 'batch')}, _cb long").parquet(path)
    side = scratch.cut(b.filled().df)
    count = -(-a.n_rows // size)
    for k in range(count) if lower else range(count - 1, -1, -1):
        low, high = k * size, min(a.n_rows, (k + 1) * size)
        own, within = blocked.where(F.col("_cb") == k), F.col("row").between(low, high - 1)
        moved = Sparse(own.where(within).select("batch", (F.col("row") - low).alias("row"), (F.col("col") - low).alias("col"), "val"), high - low, high - low, a.n_batch)
        rhs = Dense(side.where(within).select("batch", (F.col("row") - low).alias("row"), "vec"), high - low, b.width, b.n_batch)
        x = _solved(moved, rhs, partial(_substitute, upper=not lower, unit=unit, transpose=False), high - low, fits=True)
        x = scratch.cut(x.df.select("batch", (F.col("row") + low).alias("row"), "vec"))
        x.write.mode("append").parquet(solved)
        passed = spmm(Sparse(own.where(~within).select("batch", "row", "col", "val"), a.n_rows, a.n_cols, a.n_batch), Dense(x, b.n_rows, b.width, b.n_batch), every_row=False).df.withColumnRenamed("vec", "_p")
        rest = side.where(F.col("row") >= high if lower else F.col("row") < low).join(passed, ["batch", "row"], "left")
        side = scratch.cut(rest.select("batch", "row", F.when(F.col("_p").isNull(), F.col("vec")).otherwise(F.zip_with("vec", "_p", lambda v, p: v - p)).alias("vec")))
    return b.with_df(a.spark.read.schema(b.df.schema).parquet(solved))


def _by_levels(a: Sparse, b: Dense, upper: bool, unit: bool, transpose: bool, most: int = 200) -> Dense:
    """Level scheduling: each round solves the rows that wait for none, and subtracts them from those that wait for them.

    Dependencies that are deeper than ``most`` levels go to block substitution instead.
    """
    given = a
    a = (a.t if transpose else a).coalesced()
    below = F.col("row") > F.col("col") if upper == transpose else F.col("row") < F.col("col")
    off = scratch.cut(a.df.where(below))
    diagonal = a.df.where("row = col").select("batch", "row", F.col("val").alias("d"))
    side = b.filled().df
    side = side.withColumn("d", F.lit(1.0)) if unit else side.join(diagonal, ["batch", "row"], "left")
    open_, solved = scratch.cut(side), None
    for _ in range(most):
        waiting = off.join(open_.select("batch", F.col("row").alias("col")), ["batch", "col"], "left_semi").select("batch", "row").distinct()
        ready = scratch.cut(open_.join(waiting, ["batch", "row"], "left_anti").select("batch", "row", F.transform("vec", lambda x: x / F.col("d")).alias("vec")))
        solved = ready if solved is None else solved.unionByName(ready)
        passed = spmm(Sparse(off, a.n_rows, a.n_cols, a.n_batch), Dense(ready, b.n_rows, b.width, b.n_batch), every_row=False).df.withColumnRenamed("vec", "_p")
        rest = open_.join(ready.select("batch", "row"), ["batch", "row"], "left_anti").join(passed, ["batch", "row"], "left")
        open_ = scratch.cut(rest.select("batch", "row", F.when(F.col("_p").isNull(), F.col("vec")).otherwise(F.zip_with("vec", "_p", lambda x, p: x - p)).alias("vec"), "d"))
        if open_.isEmpty():
            return b.with_df(solved)
    return _by_blocks(given, b, upper, unit, transpose)


def _minus(d: Dense) -> Dense:
    return d.with_df(d.df.withColumn("vec", F.transform("vec", lambda x: -x)))


def triangular_solve_vjp(a: Sparse, x: Dense, g: Dense, upper: bool = True, unitriangular: bool = False, transpose: bool = False) -> tuple[Sparse, Dense]:
    """Gradients in A, on its stored entries, and in B, from the solution and its upstream gradient."""
    db = triangular_solve(a, g, upper, unitriangular, not transpose)
    return (sddmm(a, x, _minus(db)) if transpose else sddmm(a, _minus(db), x)), db


#: Other libraries' names of options, and ours.
_FOREIGN = {"tol": "tolerance", "rtol": "tolerance", "maxiter": "max_iter", "x0": "start", "M": "precondition"}
_SETTINGS = {"cg": krylov.CGSettings, "minres": krylov.MinresSettings, "bicgstab": krylov.BicgstabSettings, "cgs": krylov.BicgstabSettings}


def solver_options(name: str, options: dict) -> dict:
    """Options of a solver by name, foreign names too: tolerances and step counts go to its settings."""
    given = {_FOREIGN.get(k, k): v for k, v in options.items()}
    if name == "gmres":
        return {{"max_iter": "cycles"}.get(k, k): v for k, v in given.items() if k != "atol"}
    kind = _SETTINGS.get(name)
    if kind is krylov.BicgstabSettings:
        given = {{"tolerance": "reltol", "atol": "abstol"}.get(k, k): v for k, v in given.items()}
        if "max_iter" in given:
            given["matvecs"] = 2 * given.pop("max_iter")
    else:
        given.pop("atol", None)
    fields = {k: given.pop(k) for k in [*given] if kind and k in kind.__dataclass_fields__}
    return given | {"settings": replace(given.get("settings", kind()), **fields)} if fields else given


def _named(name: str | Callable, **options) -> Local:
    """A local solver by name, or one that takes (matvec, right-hand sides)."""

    def run(rows, cols, vals, shape, b):
        if name in ("direct", "spsolve"):
            return krylov.SparseLU(rows, cols, vals, shape[0]).solve(b)
        times = matvec(rows, cols, vals, shape[0])
        if callable(name):
            return name(times, b, **options)
        solver = {"cg": krylov.cg, "minres": krylov.minres, "bicgstab": krylov.bicgstab, "cgs": krylov.cgs, "gmres": krylov.gmres}[name]
        return solver(times, b, **solver_options(name, options))

    return run


SOLVERS = ("cg", "minres", "bicgstab", "cgs", "gmres", "direct", "spsolve")


def tier_of(a: Sparse, tier: str, width: int = 1) -> str:
    """``auto`` is local if a task can hold every system, else distributed."""
    if tier not in ("auto", "local", "distributed"):
        raise ValueError(f"no tier {tier!r}")
    return ("local" if _fits(a, width) else "distributed") if tier == "auto" else tier


def generic_solve(a: Sparse, b: Dense, solver: str | Callable = "minres", tier: str = "auto", **options) -> Dense:
    """X with A·X = B by a named solver or a callable (matvec, sides) to solutions; options go to the solver.

    ``minres`` needs a symmetric A, ``cg`` a positive definite one, the others a regular one. Over frames there are ``cg`` and
    ``bicgstab``, with options tolerance and max_iter; for any other solver, a system that exceeds a task is an error.
    """
    if a.n_rows != a.n_cols:
        raise ValueError("A must be square")
    if not callable(solver) and solver not in SOLVERS:
        raise ValueError(f"no solver {solver!r}; there are {SOLVERS}")
    chosen = tier_of(a, tier, b.width)
    if chosen == "distributed":
        if solver not in ("cg", "bicgstab"):
            raise ValueError(f"{solver} has no form over frames; cg and bicgstab have")
        return (cg_distributed if solver == "cg" else bicgstab_distributed)(a, b, **{_FOREIGN.get(k, k): v for k, v in options.items()})
    return _solved(a, b, _named(solver, **options), a.n_rows, True if tier == "auto" else None)


def generic_solve_vjp(a: Sparse, x: Dense, g: Dense, solver: str | Callable = "minres", transpose_solver: str | Callable | None = None, **options) -> tuple[Sparse, Dense]:
    """Gradients in A, on its stored entries, and in B; the transposed system may have a solver of its own."""
    db = generic_solve(a.t, g, transpose_solver or solver, **options)
    return sddmm(a, _minus(db), x), db


def direct_solve_vjp(a: Sparse, b: Dense, g: Dense) -> tuple[Dense, Sparse, Dense]:
    """(X, gradient in A, gradient in B) with one factorisation for the system and the transposed one."""
    same_batches(a, b, g)
    both = b.filled().df.join(g.filled().df.withColumnRenamed("vec", "_g"), ["batch", "row"]).select("batch", "row", F.concat("vec", "_g").alias("vec"))
    width = b.width

    def solve(rows, cols, vals, shape, sides):
        factors = krylov.SparseLU(rows, cols, vals, shape[0])
        return np.concatenate([factors.solve(sides[:, :width]), factors.solve_transposed(sides[:, width:])], axis=1)

    out = scratch.cut(_solved(a, Dense(both, b.n_rows, 2 * width, b.n_batch), solve, a.n_rows).df)
    x, db = (b.with_df(out.withColumn("vec", F.slice("vec", 1 + k * width, width))) for k in (0, 1))
    return x, sddmm(a, _minus(db), x), db


def _least_squares(rows, cols, vals, shape, b, settings: krylov.LsmrSettings) -> np.ndarray:
    return krylov.lsmr(matvec(rows, cols, vals, shape[0]), matvec(cols, rows, vals, shape[1]), b, shape[1], settings)[0]


def lstsq(a: Sparse, b: Dense, settings: krylov.LsmrSettings = krylov.LsmrSettings(), tier: str = "auto") -> Dense:
    """X that minimises the length of A·X - B, by LSMR column by column; damped, in the local tier, if the settings say so."""
    if tier_of(a, tier, b.width) == "distributed":
        if settings.damp:
            raise ValueError("damping is for the local tier")
        return lstsq_distributed(a, b)
    return _solved(a, b, partial(_least_squares, settings=settings), a.n_cols, True if tier == "auto" else None)


Solver = Callable[[Sparse, Dense], Dense]


def lstsq_vjp(a: Sparse, b: Dense, x: Dense, g: Dense, settings: krylov.LsmrSettings = krylov.LsmrSettings(), solver: Solver | None = None, transpose_solver: Solver | None = None) -> tuple[Sparse, Dense]:
    """For tall A of full rank: dB = (Aᵀ)⁺G, dA = -dB·Xᵀ + (B - A·X)·(A⁺dB)ᵀ at the stored entries.

    The solvers are least squares for A and for its transpose, by ``lstsq`` if they aren't given.
    """
    solver = solver or (lambda m, side: lstsq(m, side, settings))
    transpose_solver = transpose_solver or (lambda m, side: lstsq(m, side, settings))
    if a.n_rows < a.n_cols:
        raise ValueError("gradients are for matrices with as many rows as columns at least")
    db = transpose_solver(a.t, g)
    fit = spmm(a, x).df.withColumnRenamed("vec", "_f")
    rest = b.with_df(b.filled().df.join(fit, ["batch", "row"]).withColumn("vec", F.zip_with("vec", "_f", lambda p, q: p - q)))
    one, two = sddmm(a, _minus(db), x), sddmm(a, rest, solver(a, db))
    total = one.df.union(two.df).groupBy("batch", "row", "col").agg(F.sum("val").alias("val"))
    return a.with_df(total), db


def _columns(b: Dense) -> DataFrame:
    """(batch, k, row, val): a right-hand side by columns."""
    return b.df.select("batch", "row", F.posexplode("vec").alias("k", "val")).select("batch", "k", "row", "val")


def _gathered(x: DataFrame, like: Dense, n_rows: int) -> Dense:
    """The inverse of ``_columns``; what is absent is zero."""
    held = x.groupBy("batch", "row").agg(F.map_from_entries(F.collect_list(F.struct("k", "val"))).alias("m"))
    vec = F.array(*(F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0.0)) for k in range(like.width)))
    return Dense(held.select("batch", "row", vec.alias("vec")), n_rows, like.width, like.n_batch)


_SYSTEM = ["batch", "k"]


def _times(entries: DataFrame, x: DataFrame, column: str, out: str) -> DataFrame:
    """(batch, k, row, out): the matrix times a column of x (batch, k, row, ...)."""
    met = entries.join(x.select("batch", "k", F.col("row").alias("col"), F.col(column).alias("_x")), ["batch", "col"])
    return met.groupBy("batch", "k", "row").agg(F.sum(F.col("val") * F.col("_x")).alias(out))


def _squares(v: DataFrame, column: str, name: str) -> DataFrame:
    return v.groupBy(*_SYSTEM).agg(F.sum(F.col(column) * F.col(column)).alias(name))


def _ratio(a: str, b: str) -> Column:
    return F.when(F.abs(F.col(b)) > 1e-300, F.col(a) / F.col(b)).otherwise(0.0)


def _few(scalars: DataFrame, like: Dense) -> DataFrame:
    """A row for each system, for a join with the vectors: broadcast, as there are n_batch x width of them, if those are few."""
    return F.broadcast(scalars) if like.n_batch * like.width <= FEW_SYSTEMS else scalars


def _settled(now: DataFrame, first: DataFrame, tolerance: float) -> bool:
    """Whether every system's square is small beside its first one; one row for each system is compared in Spark."""
    met = now.toDF(*_SYSTEM, "_now").join(first.toDF(*_SYSTEM, "_first"), _SYSTEM)
    return met.where(F.col("_now") > tolerance**2 * F.greatest(F.col("_first"), F.lit(1e-300))).isEmpty()


def _ran_out(max_iter: int, tolerance: float) -> RuntimeError:
    return RuntimeError(f"{max_iter} steps have not reached a residual of {tolerance:g}")


def cg_distributed(a: Sparse, b: Dense, tolerance: float = 1e-10, max_iter: int = 200) -> Dense:
    """A·X = B for symmetric positive definite A whose systems don't fit in a task, every column at once.

    A step is one join of the entries with the directions, and two sums for each system; the vectors are written to the shared
    folder, so the plan doesn't grow and a lost executor costs one step. Too few steps are a RuntimeError.
    """
    same_batches(a, b)
    entries = scratch.cut(a.df)
    v = scratch.cut(_columns(b.filled()).select("batch", "k", "row", F.lit(0.0).alias("x"), F.col("val").alias("r"), F.col("val").alias("p")))
    first = rr = scratch.cut(_squares(v, "r", "rr"))
    for turn in range(max_iter + 1):
        if _settled(rr, first, tolerance):
            break
        if turn == max_iter:
            raise _ran_out(max_iter, tolerance)
        v = scratch.cut(v.join(_times(entries, v, "p", "q"), ["batch", "k", "row"], "left").withColumn("q", F.coalesce("q", F.lit(0.0))))
        along = v.groupBy(*_SYSTEM).agg(F.sum(F.col("p") * F.col("q")).alias("pq")).join(rr, _SYSTEM).select(*_SYSTEM, _ratio("rr", "pq").alias("step"), F.col("rr").alias("old"))
        v = scratch.cut(v.join(_few(along, b), _SYSTEM).select("batch", "k", "row", (F.col("x") + F.col("step") * F.col("p")).alias("x"), (F.col("r") - F.col("step") * F.col("q")).alias("r"), "p", "old"))
        rr = scratch.cut(_squares(v, "r", "rr"))
        v = scratch.cut(v.join(_few(rr, b), _SYSTEM).select("batch", "k", "row", "x", "r", (F.col("r") + _ratio("rr", "old") * F.col("p")).alias("p")))
    return _gathered(v.select("batch", "k", "row", F.col("x").alias("val")), b, a.n_rows)


def bicgstab_distributed(a: Sparse, b: Dense, tolerance: float = 1e-10, max_iter: int = 200) -> Dense:
    """A·X = B for regular A whose systems don't fit in a task, by stabilised biconjugate gradients over frames.

    A step is two joins of the entries with vectors and three rounds of sums. Too few steps, or a breakdown, are a RuntimeError.
    """
    same_batches(a, b)
    entries, at = scratch.cut(a.df), ["batch", "k", "row"]
    dots = lambda v, **pairs: scratch.cut(v.groupBy(*_SYSTEM).agg(*(F.sum(F.col(p) * F.col(q)).alias(n) for n, (p, q) in pairs.items())))
    zero, side = F.lit(0.0), F.col("val")
    v = scratch.cut(_columns(b.filled()).select(*at, zero.alias("x"), side.alias("r"), side.alias("s"), zero.alias("p"), zero.alias("v")))
    now = dots(v, rr=("r", "r"), rho=("s", "r"))
    first = now.select(*_SYSTEM, "rr")
    former = now.select(*_SYSTEM, F.lit(1.0).alias("old"), F.lit(1.0).alias("alpha"), F.lit(1.0).alias("omega"))
    for turn in range(max_iter + 1):
        if _settled(now.select(*_SYSTEM, "rr"), first, tolerance):
            return _gathered(v.select(*at, F.col("x").alias("val")), b, a.n_rows)
        if turn == max_iter:
            break
        scalars = now.join(former, _SYSTEM).select(*_SYSTEM, "rho", "omega", (_ratio("rho", "old") * _ratio("alpha", "omega")).alias("beta"))
        p = F.col("r") + F.col("beta") * (F.col("p") - F.col("omega") * F.col("v"))
        v = scratch.cut(v.join(_few(scalars, b), _SYSTEM).select(*at, "x", "r", "s", p.alias("p")))
        v = scratch.cut(v.join(_times(entries, v, "p", "v"), at, "left").withColumn("v", F.coalesce("v", zero)))
        alpha = dots(v, sv=("s", "v")).join(now, _SYSTEM).select(*_SYSTEM, _ratio("rho", "sv").alias("alpha"))
        v = scratch.cut(v.join(_few(alpha, b), _SYSTEM).withColumn("h", F.col("r") - F.col("alpha") * F.col("v")))
        v = scratch.cut(v.join(_times(entries, v, "h", "t"), at, "left").withColumn("t", F.coalesce("t", zero)))
        omega = dots(v, th=("t", "h"), tt=("t", "t")).select(*_SYSTEM, _ratio("th", "tt").alias("omega"))
        moved = v.join(_few(omega, b), _SYSTEM)
        x, r = F.col("x") + F.col("alpha") * F.col("p") + F.col("omega") * F.col("h"), F.col("h") - F.col("omega") * F.col("t")
        v = scratch.cut(moved.select(*at, x.alias("x"), r.alias("r"), "s", "p", "v"))
        former = scratch.cut(now.join(alpha, _SYSTEM).join(omega, _SYSTEM).select(*_SYSTEM, F.col("rho").alias("old"), "alpha", "omega"))
        now = dots(v, rr=("r", "r"), rho=("s", "r"))
    raise _ran_out(max_iter, tolerance)


def lstsq_distributed(a: Sparse, b: Dense, tolerance: float = 1e-10, max_iter: int = 400) -> Dense:
    """Least squares by conjugate gradients on the normal equations, without forming them. Too few steps are a RuntimeError."""
    same_batches(a, b)
    entries, turned = scratch.cut(a.df), scratch.cut(a.t.df)
    r = scratch.cut(_columns(b.filled()).withColumnRenamed("val", "r"))
    s = _times(turned, r, "r", "s")
    v = scratch.cut(s.select("batch", "k", "row", F.lit(0.0).alias("x"), F.col("s").alias("p"), "s"))
    first = ss = scratch.cut(_squares(v, "s", "ss"))
    for turn in range(max_iter + 1):
        if _settled(ss, first, tolerance):
            break
        if turn == max_iter:
            raise _ran_out(max_iter, tolerance)
        q = scratch.cut(_times(entries, v, "p", "q"))
        along = scratch.cut(_squares(q, "q", "qq").join(ss, _SYSTEM).withColumn("step", _ratio("ss", "qq")).select(*_SYSTEM, "step", F.col("ss").alias("old")))
        moved = q.join(_few(along, b), _SYSTEM).select("batch", "k", "row", (F.col("step") * F.col("q")).alias("_m"))
        r = scratch.cut(r.join(moved, ["batch", "k", "row"], "left").select("batch", "k", "row", (F.col("r") - F.coalesce("_m", F.lit(0.0))).alias("r")))
        s = _times(turned, r, "r", "s")
        v = scratch.cut(v.drop("s").join(s, ["batch", "k", "row"]).join(_few(along, b), _SYSTEM).withColumn("x", F.col("x") + F.col("step") * F.col("p")).drop("step"))
        ss = scratch.cut(_squares(v, "s", "ss"))
        v = v.join(_few(ss, b), _SYSTEM).select("batch", "k", "row", "x", (F.col("s") + _ratio("ss", "old") * F.col("p")).alias("p"), "s")
    return _gathered(v.select("batch", "k", "row", F.col("x").alias("val")), b, a.n_cols)
