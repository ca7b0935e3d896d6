"""Solvers against numpy: the algorithms on arrays, then the operators on frames, with gradients by differences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrel.frames import Sparse
from sparrel.operators import krylov, product, solve
from sparrel.sources import arrays

from .test_products import dense, full, keys, matrix


def spd(n, seed=0):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, n))
    return m @ m.T / n + 0.5 * np.eye(n)


def from_full(spark, x):
    x = x if x.ndim == 3 else x[None]
    rows = [(b, i, j, float(x[b, i, j])) for b, i, j in zip(*np.nonzero(x), strict=True)]
    return Sparse.of(spark.createDataFrame([tuple(map(lambda v: v if isinstance(v, float) else int(v), r)) for r in rows], "batch long, row long, col long, val double"), *x.shape[1:], len(x))


@pytest.mark.parametrize("solver", [krylov.cg, krylov.minres, krylov.bicgstab, krylov.cgs, krylov.gmres])
@pytest.mark.parametrize("p", [None, 1, 6])
def test_algorithms_on_definite_systems(solver, p):
    a = spd(40)
    b = np.random.default_rng(1).normal(size=40 if p is None else (40, p))
    x = solver(lambda v: a @ v, b)
    assert x.shape == b.shape and np.allclose(a @ x, b, atol=1e-6)
    assert not solver(lambda v: a @ v, np.zeros_like(b)).any()


@pytest.mark.parametrize("solver", [krylov.bicgstab, krylov.cgs, krylov.gmres])
def test_algorithms_on_other_systems(solver):
    rng = np.random.default_rng(2)
    a = 4 * np.eye(30) + np.diag(rng.normal(size=29), 1) + 0.5 * np.diag(rng.normal(size=29), -1)
    b = rng.normal(size=(30, 3))
    assert np.allclose(a @ solver(lambda v: a @ v, b), b, atol=1e-6)


def test_a_start_is_subtracted():
    a, b = spd(20), np.ones(20)
    start = np.random.default_rng(0).normal(size=20)
    for solver in (krylov.cg, krylov.bicgstab):
        assert np.allclose(a @ solver(lambda v: a @ v, b, start=start), b, atol=1e-6)


def test_preconditioners():
    a = spd(30) + np.diag(np.linspace(1, 100, 30))
    d = np.diag(a)[:, None]
    for solver in (krylov.cg, krylov.bicgstab):
        assert np.allclose(a @ solver(lambda v: a @ v, np.ones((30, 2)), precondition=lambda r: r / d), 1, atol=1e-6)


def test_lanczos_eigenvalues():
    a = spd(10, 3)
    b = np.random.default_rng(0).normal(size=(10, 4))
    _, t = krylov.cg(lambda v: a @ v, b, krylov.CGSettings(tridiagonal_steps=10, least_iter=10), tridiagonal=True)
    for k in range(4):
        assert np.allclose(np.linalg.eigvalsh(t[k]), np.linalg.eigvalsh(a), atol=1e-4)
    with pytest.raises(RuntimeError):
        krylov.cg(lambda v: a @ v, b, krylov.CGSettings(tridiagonal_steps=20, max_iter=5), tridiagonal=True)


def test_warnings_and_bad_numbers():
    a = spd(30)
    with pytest.warns(UserWarning):
        krylov.cg(lambda v: a @ v, np.ones(30), krylov.CGSettings(max_iter=2))
    with pytest.raises(RuntimeError):
        krylov.cg(lambda v: v * np.nan, np.ones(3))


@pytest.mark.parametrize("shape", [(20,), (20, 5)])
def test_shifted_minres(shape):
    a = spd(20, 5)
    a = a - 0.9 * np.eye(20)  # indefinite
    b, shifts = np.random.default_rng(0).normal(size=shape), [0.0, 1.0, 2.0]
    out = krylov.minres(lambda v: a @ v, b, shifts=shifts, value=-1.0)
    assert out.shape == (3, *shape)
    for s, x in zip(shifts, out, strict=True):
        assert np.allclose((-a + s * np.eye(20)) @ x, b, atol=1e-5)


def test_lsmr():
    rng = np.random.default_rng(4)
    for m, n in ((35, 35), (30, 12), (12, 30)):
        a = rng.normal(size=(m, n))
        b = rng.normal(size=(m, 2))
        x, steps = krylov.lsmr(lambda v: a @ v, lambda v: a.T @ v, b, n)
        assert np.allclose(x, np.linalg.lstsq(a, b, rcond=None)[0], atol=1e-5) and len(steps) == 2
    a = rng.normal(size=(20, 8))
    x, _ = krylov.lsmr(lambda v: a @ v, lambda v: a.T @ v, np.ones(20), 8, krylov.LsmrSettings(damp=0.7))
    assert np.allclose(x, np.linalg.solve(a.T @ a + 0.49 * np.eye(8), a.T @ np.ones(20)), atol=1e-6)
    assert krylov.lsmr(lambda v: a @ v, lambda v: a.T @ v, np.zeros(20), 8)[1] == [0]
    c = rng.normal(size=(12, 5)) + 1j * rng.normal(size=(12, 5))
    b = rng.normal(size=12) + 1j * rng.normal(size=12)
    x, _ = krylov.lsmr(lambda v: c @ v, lambda v: c.conj().T @ v, b, 5)
    assert np.allclose(x, np.linalg.lstsq(c, b, rcond=None)[0], atol=1e-6)


@pytest.mark.parametrize("upper", [True, False])
@pytest.mark.parametrize("unit", [True, False])
@pytest.mark.parametrize("transpose", [True, False])
def test_triangular(spark, upper, unit, transpose):
    rng = np.random.default_rng(6)
    x = np.stack([np.triu(rng.normal(size=(12, 12)) * (rng.random((12, 12)) < 0.4), 1) for _ in range(4)])
    if not unit:
        x += np.stack([np.diag(rng.uniform(1, 2, 12))] * 4)
    x = x if upper else x.transpose(0, 2, 1)
    a = from_full(spark, x)
    op = x + unit * np.eye(12)
    op = op.transpose(0, 2, 1) if transpose else op
    b, y = dense(spark, (4, 12, 3))
    out = solve.triangular_solve(a, b, upper, unit, transpose)
    want = np.linalg.solve(op, y)
    assert np.allclose(arrays.to_dense(out), want)
    g, z = dense(spark, (4, 12, 3), seed=8)
    of_a, of_b = solve.triangular_solve_vjp(a, out, g, upper, unit, transpose)
    db = np.linalg.solve(op.transpose(0, 2, 1), z)
    assert np.allclose(arrays.to_dense(of_b), db) and keys(of_a) == keys(a)
    da = -db @ want.transpose(0, 2, 1)
    da = da.transpose(0, 2, 1) if transpose else da
    assert all(abs(r.val - da[r.batch, r.row, r.col]) < 1e-8 for r in of_a.df.collect())


@pytest.mark.parametrize(("upper", "transpose"), [(False, False), (True, False), (False, True)])
def test_triangular_by_levels(spark, upper, transpose):
    x = np.eye(6) * 2 + np.diag([1.0, 0, 1, 0, 1], -1)
    x = x.T if upper else x
    b, y = dense(spark, (1, 6, 2))
    out = solve.triangular_solve(from_full(spark, x), b, upper, transpose=transpose, tier="levels")
    assert np.allclose(arrays.to_dense(out)[0], np.linalg.solve(x.T if transpose else x, y[0]))


def test_triangular_guards(spark):
    a, b = from_full(spark, np.eye(3)), dense(spark, (1, 3, 1))[0]
    with pytest.raises(ValueError):
        solve.triangular_solve(a, b, unitriangular=True)
    with pytest.raises(ValueError):
        solve.triangular_solve(matrix(spark, (3, 4), 2)[0], b)
    with pytest.raises(Exception, match="diagonal entry"):
        solve.triangular_solve(from_full(spark, np.diag([1.0, 0, 1])), b).df.collect()


def test_systems_that_are_too_large_for_a_task(spark, monkeypatch):
    monkeypatch.setattr(solve, "LOCAL_ENTRIES", 5)
    with pytest.raises(ValueError, match="distributed"):
        solve.generic_solve(from_full(spark, spd(4)), dense(spark, (1, 4, 1))[0], tier="local")
    with pytest.raises(ValueError, match="no form over frames"):
        solve.generic_solve(from_full(spark, spd(4)), dense(spark, (1, 4, 1))[0], "minres")
    monkeypatch.setattr(solve, "LOCAL_ENTRIES", 5_000)
    monkeypatch.setattr(solve, "LOCAL_CELLS", 3)
    with pytest.raises(ValueError, match="numbers of a side"):
        solve.generic_solve(from_full(spark, spd(4)), dense(spark, (1, 4, 1))[0], tier="local")


@pytest.mark.parametrize(("upper", "transpose", "unit"), [(False, False, False), (True, False, True), (False, True, True), (True, True, False)])
def test_triangular_by_blocks(spark, monkeypatch, upper, transpose, unit):
    rng = np.random.default_rng(3)
    x = np.tril(rng.normal(size=(2, 11, 11)) * (rng.random((2, 11, 11)) < 0.5), -1) * 0.3 + (0 if unit else np.eye(11) * 2)
    x = x.transpose(0, 2, 1) if upper else x
    b, y = dense(spark, (2, 11, 2))
    whole = x + np.eye(11) if unit else x
    monkeypatch.setattr(solve, "LOCAL_ENTRIES", 6)
    out = solve.triangular_solve(from_full(spark, x), b, upper, unit, transpose)
    assert np.allclose(arrays.to_dense(out), np.linalg.solve(whole.transpose(0, 2, 1) if transpose else whole, y))


def test_deep_levels_go_to_blocks(spark):
    x = np.eye(6) * 2 + np.diag([1.0] * 5, -1)
    b, y = dense(spark, (1, 6, 2))
    out = solve._by_levels(from_full(spark, x), b, False, False, False, most=2)
    assert np.allclose(arrays.to_dense(out)[0], np.linalg.solve(x, y[0]))


def test_sparse_factors_serve_both_systems(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 30):
        x = rng.normal(size=(n, n)) * (rng.random((n, n)) < 0.3) + np.diag(rng.normal(size=n))[rng.permutation(n)] + np.eye(n) * 0.1
        i, j = np.nonzero(x)
        held, b = krylov.SparseLU(i, j, x[i, j], n), rng.normal(size=(n, 3))
        assert np.allclose(held.solve(b), np.linalg.solve(x, b)) and np.allclose(held.solve_transposed(b), np.linalg.solve(x.T, b))
    with pytest.raises(np.linalg.LinAlgError):
        krylov.SparseLU(np.array([0, 1]), np.array([0, 0]), np.ones(2), 2)
    x, (b, y), (g, z) = np.stack([spd(8, 1), spd(8, 2) + np.triu(np.ones((8, 8)), 3)]), dense(spark, (2, 8, 2)), dense(spark, (2, 8, 2))
    found, da, db = solve.direct_solve_vjp(from_full(spark, x), b, g)
    want, of_b = np.linalg.solve(x, y), np.linalg.solve(x.transpose(0, 2, 1), z)
    assert np.allclose(arrays.to_dense(found), want) and np.allclose(arrays.to_dense(db), of_b)
    assert np.allclose(full(da), -of_b @ want.transpose(0, 2, 1) * (x != 0))


def test_preconditioned_minres():
    x = spd(30) - 0.8 * np.eye(30)
    b, m = np.random.default_rng(1).normal(size=(30, 2)), np.linspace(1, 5, 30)[:, None]
    assert np.allclose(krylov.minres(lambda v: x @ v, b, precondition=lambda r: r / m), np.linalg.solve(x, b), atol=1e-6)
    out = krylov.minres(lambda v: x @ v, b, shifts=[3.0], value=2.0, precondition=lambda r: r / m)
    assert np.allclose(out[0], np.linalg.solve(2 * x + 3 * np.eye(30), b), atol=1e-6)
    with pytest.raises(ValueError):
        krylov.minres(lambda v: x @ v, b, shifts=[0.0, 1.0], precondition=lambda r: r)


def test_lsmr_from_a_start():
    rng = np.random.default_rng(5)
    x, b, start = rng.normal(size=(12, 5)), rng.normal(size=(12, 2)), rng.normal(size=(5, 2))
    assert np.allclose(krylov.lsmr(lambda v: x @ v, lambda v: x.T @ v, b, 5, start=start)[0], np.linalg.lstsq(x, b, rcond=None)[0])
    wide = x.T
    out = krylov.lsmr(lambda v: wide @ v, lambda v: wide.T @ v, b[:5, 0], 12, start=np.ones(12))[0]
    assert np.allclose(out - 1, np.linalg.pinv(wide) @ (b[:5, 0] - wide @ np.ones(12)))


def test_options_of_other_names():
    assert solve.solver_options("cg", {"tol": 1e-3, "maxiter": 7, "atol": 0})["settings"] == krylov.CGSettings(tolerance=1e-3, max_iter=7)
    assert solve.solver_options("bicgstab", {"rtol": 1e-3, "maxiter": 7, "atol": 1e-9})["settings"] == krylov.BicgstabSettings(matvecs=14, abstol=1e-9, reltol=1e-3)
    assert solve.solver_options("gmres", {"tol": 1e-3, "maxiter": 7}) == {"tolerance": 1e-3, "cycles": 7}


def test_steps_that_run_out(spark):
    x = spd(12)
    x[0, 5] += 0.3
    a, (b, y) = from_full(spark, x), dense(spark, (1, 12, 2))
    assert np.allclose(arrays.to_dense(solve.bicgstab_distributed(a, b, 1e-10))[0], np.linalg.solve(x, y[0]), atol=1e-6)
    for way in (solve.cg_distributed, solve.bicgstab_distributed, solve.lstsq_distributed):
        with pytest.raises(RuntimeError, match="steps have not reached"):
            way(a, b, 1e-12, 1)


@pytest.mark.parametrize("solver", solve.SOLVERS)
def test_generic_solvers(spark, solver):
    x = np.stack([spd(12, k) for k in range(2)])
    b, y = dense(spark, (2, 12, 3))
    assert np.allclose(arrays.to_dense(solve.generic_solve(from_full(spark, x), b, solver)), np.linalg.solve(x, y), atol=1e-6)
    with pytest.raises(ValueError):
        solve.generic_solve(from_full(spark, x), b, "other")


def test_distributed_gradients_of_solves(spark):
    rng = np.random.default_rng(9)
    x = 4 * np.eye(8) + np.diag(rng.normal(size=7), 1) + np.diag(rng.normal(size=7), -1)
    a, (b, y), (g, z) = from_full(spark, x), dense(spark, (1, 8, 2)), dense(spark, (1, 8, 2), seed=3)
    out = solve.generic_solve(a, b, "bicgstab")
    of_a, of_b = solve.generic_solve_vjp(a, out, g, "bicgstab")
    f = lambda m: np.sum(np.linalg.solve(m, y[0]) * z[0])
    for r in of_a.df.collect():
        m = x.copy()
        m[r.row, r.col] += 1e-6
        assert abs(r.val - (f(m) - f(x)) / 1e-6) < 1e-4
    assert np.allclose(arrays.to_dense(of_b)[0], np.linalg.solve(x.T, z[0]), atol=1e-7)


def test_second_order_by_composition(spark):
    """The gradient of sum(dB) in B's upstream is a solve again: A⁻¹ of ones."""
    x = spd(6, 2)
    a, (g, _) = from_full(spark, x), dense(spark, (1, 6, 1))
    ones = arrays.from_dense(spark, np.ones((6, 1)))
    again = solve.generic_solve_vjp(a.t, solve.generic_solve(a.t, g, "cg"), ones, "cg")[1]
    assert np.allclose(arrays.to_dense(again)[0], np.linalg.solve(x, np.ones((6, 1))), atol=1e-6)


@pytest.mark.parametrize("p", [1, 3])
def test_least_squares_and_gradients(spark, p):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(7, 4))
    a, (b, y), (g, z) = from_full(spark, x), dense(spark, (1, 7, p)), dense(spark, (1, 4, p), seed=5)
    out = solve.lstsq(a, b)
    assert np.allclose(arrays.to_dense(out)[0], np.linalg.lstsq(x, y[0], rcond=None)[0], atol=1e-6)
    of_a, of_b = solve.lstsq_vjp(a, b, out, g)
    f = lambda m, s: np.sum(np.linalg.lstsq(m, s, rcond=None)[0] * z[0])
    assert keys(of_a) == keys(a)
    for r in of_a.df.collect():
        m = x.copy()
        m[r.row, r.col] += 1e-6
        assert abs(r.val - (f(m, y[0]) - f(x, y[0])) / 1e-6) < 1e-3
    assert np.allclose(arrays.to_dense(of_b)[0], np.linalg.pinv(x).T @ z[0], atol=1e-6)
    with pytest.raises(ValueError):
        solve.lstsq_vjp(a.t, b, out, g)


def test_distributed_tier(spark, monkeypatch):
    x = np.stack([spd(9, k) for k in range(2)])
    b, y = dense(spark, (2, 9, 2))
    a = from_full(spark, x)
    assert np.allclose(arrays.to_dense(solve.generic_solve(a, b, "cg", tier="distributed", tolerance=1e-9)), np.linalg.solve(x, y), atol=1e-6)
    tall = np.random.default_rng(3).normal(size=(9, 4)) + np.eye(9, 4)
    monkeypatch.setattr(solve, "LOCAL_ENTRIES", 10)
    side, z = dense(spark, (1, 9, 2), seed=5)
    assert np.allclose(arrays.to_dense(solve.lstsq(from_full(spark, tall), side, tier="auto"))[0], np.linalg.lstsq(tall, z[0], rcond=None)[0], atol=1e-6)
    with pytest.raises(ValueError):
        solve.generic_solve(a, b, tier="other")


def test_repeated_entries_add_up_before_a_solve(spark):
    x = spd(5)
    a = from_full(spark, x)
    halves = a.with_df(a.df.withColumn("val", F.col("val") / 2).union(a.df.withColumn("val", F.col("val") / 2)))
    b, y = dense(spark, (1, 5, 1))
    assert np.allclose(full(halves)[0], x)
    assert np.allclose(arrays.to_dense(solve.generic_solve(halves, b, "cg"))[0], np.linalg.solve(x, y[0]), atol=1e-7)
    assert product.spmm(halves, b).df.count() == 5
