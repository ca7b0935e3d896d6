"""Products, reductions and layouts against numpy, with the odd cases of their contracts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrel.frames import Dense, Sparse
from sparrel.operators import layout, product, reduce
from sparrel.sources import arrays


def matrix(spark, shape, nnz, seed=0, batches=1, repeats=0):
    """(Sparse, numpy array (batch, rows, cols)), with some equal keys."""
    rng = np.random.default_rng(seed)
    full, rows = np.zeros((batches, *shape)), []
    for b in range(batches):
        for p in [*rng.choice(shape[0] * shape[1], nnz, replace=False), *rng.integers(0, shape[0] * shape[1], repeats)]:
            i, j, v = int(p // shape[1]), int(p % shape[1]), float(np.round(rng.normal(), 3))
            rows.append((b, i, j, v))
            full[b, i, j] += v
    return Sparse.of(spark.createDataFrame(rows, "batch long, row long, col long, val double"), *shape, batches), full


def dense(spark, shape, seed=1):
    x = np.random.default_rng(seed).normal(size=shape)
    return arrays.from_dense(spark, x), x


def full(a: Sparse) -> np.ndarray:
    out = np.zeros(a.shape)
    for r in a.df.collect():
        out[r.batch, r.row, r.col] += r.val
    return out


def keys(a: Sparse):
    return sorted((r.batch, r.row, r.col) for r in a.df.collect())


@pytest.mark.parametrize(("batches", "shape", "nnz", "width"), [(1, (4, 6), 8, 2), (1, (8, 16), 32, 10), (4, (8, 16), 20, 3), (1, (7, 4), 14, 9)])
def test_spmm_and_gradients(spark, batches, shape, nnz, width):
    a, x = matrix(spark, shape, nnz, batches=batches, repeats=3)
    b, y = dense(spark, (batches, shape[1], width))
    g, z = dense(spark, (batches, shape[0], width), seed=2)
    assert np.allclose(arrays.to_dense(product.spmm(a, b)), x @ y)
    of_a, of_b = product.spmm_vjp(a, b, g)
    assert np.allclose(arrays.to_dense(of_b), x.transpose(0, 2, 1) @ z)
    assert keys(of_a) == keys(a)
    outer = z @ y.transpose(0, 2, 1)
    assert all(abs(r.val - outer[r.batch, r.row, r.col]) < 1e-9 for r in of_a.df.collect())
    assert product.spmm_vjp(a, b, g, of_b=False)[1] is None


def test_wide_rows_go_by_places(spark, monkeypatch):
    a, x = matrix(spark, (5, 6), 12)
    b, y = dense(spark, (1, 6, 5))
    monkeypatch.setattr(product, "WIDE", 3)
    assert np.allclose(arrays.to_dense(product.spmm(a, b)), x @ y)


def test_shapes_are_checked(spark):
    a, _ = matrix(spark, (4, 6), 8)
    b, _ = dense(spark, (1, 5, 2))
    with pytest.raises(ValueError):
        product.spmm(a, b)
    with pytest.raises(ValueError):
        product.spmm(matrix(spark, (4, 5), 8, batches=2)[0], b)
    with pytest.raises(TypeError):
        Sparse.of(spark.range(3).toDF("row"), 3, 3)
    with pytest.raises(ValueError):
        Sparse.of(a.df, 4, 0)
    with pytest.raises(ValueError):
        Sparse.of(a.df, 2, 6).checked()
    with pytest.raises(ValueError):
        Sparse.of(a.df.union(spark.createDataFrame([(0, 1, 1, None)], a.df.schema)), 4, 6).checked()
    assert a.checked() is a


def test_an_empty_matrix_is_zero(spark):
    a, _ = matrix(spark, (4, 6), 0)
    a = Sparse.of(spark.createDataFrame([], "row long, col long, val double"), 4, 6)
    b, _ = dense(spark, (1, 6, 2))
    assert np.array_equal(arrays.to_dense(product.spmm(a, b)), np.zeros((1, 4, 2))) and product.spmm(a, b).df.count() == 4


def test_gather_and_segment(spark):
    rng = np.random.default_rng(0)
    n, r, d1, d2 = 30, 5, 7, 4
    x, bank, idx = rng.normal(size=(n, d1)), rng.normal(size=(r, d1, d2)), rng.integers(0, r, n)
    frame = spark.createDataFrame([(i, int(idx[i]), x[i].tolist()) for i in range(n)], "i long, idx long, vec array<double>")
    cells = spark.createDataFrame([(a, b, c, float(bank[a, b, c])) for a in range(r) for b in range(d1) for c in range(d2)], "r long, i long, k long, val double")
    out = {q.i: q.vec for q in product.gather_mm(frame, cells, d2, d1).collect()}
    assert all(np.allclose(out[i], x[i] @ bank[idx[i]]) for i in range(n))
    lengths = [10, 0, 5, 15, 0]
    table = spark.createDataFrame(list(enumerate(lengths)), "s long, n long")
    out = {q.i: q.vec for q in product.segment_mm(frame, table, cells, d2, d1).collect()}
    at = np.repeat(np.arange(r), lengths)
    assert all(np.allclose(out[i], x[i] @ bank[at[i]]) for i in range(n))
    with pytest.raises(ValueError):
        product.segment_mm(frame, table.where("s < 3"), cells, d2, d1)
    g = rng.normal(size=(n, d2))
    grads = product.gather_mm_vjp(frame, cells, spark.createDataFrame([(i, g[i].tolist()) for i in range(n)], "i long, vec array<double>"), d2, d1)
    assert all(np.allclose(q.vec, bank[idx[q.i]] @ g[q.i]) for q in grads[0].collect())
    want = sum(np.eye(r)[idx[i]][:, None, None] * np.outer(x[i], g[i]) for i in range(n))
    assert all(abs(q.val - want[q.r, q.i, q.k]) < 1e-9 for q in grads[1].collect())


@pytest.mark.parametrize(("batched", "sampled"), [(False, False), (False, True), (True, False), (True, True)])
def test_batch_mv(spark, batched, sampled):
    a, x = matrix(spark, (4, 5), 9, batches=3 if batched else 1)
    rng, rows = np.random.default_rng(4), []
    v = rng.normal(size=(3 if batched else 1, 2 if sampled else 1, 5))
    for b, s, r in np.ndindex(v.shape):
        rows.append((*([b] if batched else []), *([s] if sampled else []), r, float(v[b, s, r])))
    names = ["batch long"] * batched + ["sample long"] * sampled + ["row long", "val double"]
    for q in product.batch_mv(product.spmm, a, spark.createDataFrame(rows, ", ".join(names))).collect():
        assert abs(q.val - (x[q.batch] @ v[q.batch, q.sample])[q.row]) < 1e-9
    with pytest.raises(ValueError):
        product.batch_mv(product.spmm, a, spark.createDataFrame([(1, 2, 3.0)], "row long, other long, val double"))


def lse(x, axis=None):
    top = np.where(np.isfinite(m := x.max(axis=axis, keepdims=True)), m, 0)
    with np.errstate(divide="ignore"):
        return np.squeeze(top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True)), axis=axis)


def values(df, key):
    return np.array([r[1] for r in sorted((tuple(r) for r in df.select(*key, "lse").collect()))]) if len(key) == 1 else df.first().lse


def test_published_example(spark):
    a = Sparse.of(spark.createDataFrame([(0, 1, 1.0), (1, 0, 2.0), (1, 2, 3.0)], "row long, col long, val double"), 3, 3)
    assert np.allclose(values(reduce.logsumexp(a, 1), ["row"]), [1.5514, 3.3490, 1.0986], atol=1e-4)
    assert np.allclose(values(reduce.logsumexp(a, -1, include_zeros=False), ["row"]), [1, 3.3133, -np.inf], atol=1e-4)
    assert np.allclose(values(reduce.logsumexp(a, 0), ["col"]), [2.2395, 1.5514, 3.0949], atol=1e-4)


@pytest.mark.parametrize("rows", [[(0, 0, -1000.0), (0, 1, -5.0), (1, 0, -3.0), (1, 1, -900.0), (1, 2, -2.0)], [(0, 0, np.inf), (0, 2, 1.0), (1, 0, -2.0), (1, 1, 3.0)], [(0, 0, -1000.0)], []])
@pytest.mark.parametrize("zeros", [True, False])
def test_stability(spark, rows, zeros):
    a = Sparse.of(spark.createDataFrame(rows, "row long, col long, val double"), 3, 3)
    x = np.full((3, 3), 0.0 if zeros else -np.inf)
    for i, j, v in rows:
        x[i, j] = v
    for dim, axis, key in ((1, 1, ["row"]), (0, 0, ["col"]), ([0, 1], None, [])):
        got = values(reduce.logsumexp(a, dim, include_zeros=zeros), key)
        assert not np.isnan(got).any() and np.allclose(got, lse(x, axis))


def test_batched_and_bidirectional(spark):
    a, x = matrix(spark, (5, 4), 7, batches=3, seed=5)
    stored = np.where(full(a.with_df(a.df.withColumn("val", F.lit(1.0)))) > 0, x, -np.inf)
    for zeros, z in ((True, x), (False, stored)):
        for r in reduce.logsumexp(a, 2, include_zeros=zeros).collect():
            assert np.isclose(r.lse, lse(z, 2)[r.batch, r.row])
        for r in reduce.logsumexp(a, [1, 2], include_zeros=zeros).collect():
            assert np.isclose(r.lse, lse(z[r.batch]))
        cols, rows = reduce.bidir_logsumexp(a, zeros)
        assert all(np.isclose(r.lse, lse(z, 1)[r.batch, r.col]) for r in cols.collect())
        assert all(np.isclose(r.lse, lse(z, 2)[r.batch, r.row]) for r in rows.collect())
    padded = reduce.bidir_logsumexp(a, layout="padded").collect()
    assert len(padded) == 2 * 3 * 5 and all(r.lse == -np.inf for r in padded if r.axis == 0 and r.idx == 4)
    nested = reduce.bidir_logsumexp(a, layout="nested").collect()
    assert {(r.axis, len(r.lses)) for r in nested} == {(0, 4), (1, 5)}
    assert reduce.logsumexp(a, 2, keepdim=True).columns == ["batch", "row", "col", "lse"]


def test_values_far_apart_and_infinite(spark):
    rows = [(0, 0, 800.0), (0, 1, 799.0), (0, 2, -900.0), (1, 0, 255.0), (1, 1, 257.0), (1, 2, -257.0), (2, 0, float("inf")), (2, 1, 3.0), (3, 0, float("-inf")), (4, 0, float("-inf")), (4, 1, 1e300), (5, 0, -400.0), (6, 0, float("nan"))]
    a = Sparse.of(spark.createDataFrame(rows, "row long, col long, val double"), 8, 3)
    stored = {r.row: r.lse for r in reduce.logsumexp(a, 1, include_zeros=False).collect()}
    assert abs(stored[0] - (800 + np.log1p(np.exp(-1)))) < 1e-9 and abs(stored[1] - (257 + np.log1p(np.exp(-2)))) < 1e-9
    assert stored[2] == np.inf and stored[3] == -np.inf and stored[4] == 1e300 and stored[5] == -400 and np.isnan(stored[6]) and stored[7] == -np.inf
    dense = {r.row: r.lse for r in reduce.logsumexp(a, 1).collect()}
    assert abs(dense[3] - np.log(2)) < 1e-12 and abs(dense[5] - np.log(2)) < 1e-12 and abs(dense[7] - np.log(3)) < 1e-12 and dense[2] == np.inf


def test_reductions_scan_once_and_join_nothing(spark, capsys, tmp_path):
    spark.range(100).selectExpr("id % 7 AS row", "id AS col", "id / 10 AS val").write.parquet(str(tmp_path / "a"))
    a = Sparse.of(spark.read.parquet(str(tmp_path / "a")), 7, 100)
    for dim in (0, 1, [0, 1]):
        reduce.logsumexp(a, dim).explain()
        plan = capsys.readouterr().out
        assert plan.count("FileScan") == 1 and "Join" not in plan and "Cartesian" not in plan


def test_dimensions_are_checked(spark):
    a, _ = matrix(spark, (3, 3), 4, batches=2)
    for dim, error in (([], RuntimeError), ([1, 1], RuntimeError), (3, IndexError), (0, NotImplementedError), ([1, -2], RuntimeError)):
        with pytest.raises(error):
            reduce.logsumexp(a, dim)
    with pytest.raises(ValueError):
        reduce.bidir_logsumexp(a, layout="padded", keepdim=True)
    with pytest.raises(ValueError):
        reduce.bidir_logsumexp(a, layout="other")


def test_gradients_of_reductions_by_differences(spark):
    a, x = matrix(spark, (4, 5), 9, seed=6)
    w = np.array([1.0, -2.0, 0.5, 3.0])
    g = spark.createDataFrame([(0, k, float(w[k])) for k in range(4)], "batch long, row long, g double")
    grad = reduce.logsumexp_vjp(a, 1, g)
    assert keys(grad) == keys(a)
    for r in grad.df.collect():
        y = x[0].copy()
        y[r.row, r.col] += 1e-6
        assert abs(r.val - (w @ lse(y, 1) - w @ lse(x[0], 1)) / 1e-6) < 1e-4
    both = reduce.bidir_logsumexp_vjp(a, spark.createDataFrame([(0, k, 1.0) for k in range(5)], "batch long, col long, g double"), g)
    for r in both.df.collect():
        y = x[0].copy()
        y[r.row, r.col] += 1e-6
        assert abs(r.val - (w @ lse(y, 1) + lse(y, 0).sum() - w @ lse(x[0], 1) - lse(x[0], 0).sum()) / 1e-6) < 1e-4


def test_layouts(spark):
    a, x = matrix(spark, (6, 5), 12, seed=7, repeats=4)
    crow, cols, vals = arrays.to_csr_arrays(a)
    assert np.allclose(full(arrays.from_csr(spark, crow, cols, vals, (6, 5))), x)
    with pytest.warns(UserWarning):
        rows, cols, vals = arrays.to_coo(a)
    assert np.allclose(full(arrays.from_coo(spark, rows, cols, vals, (6, 5))), x) and (np.diff(rows * 5 + cols) > 0).all()
    assert np.allclose(full(layout.from_csr(layout.to_csr(a), 6, 5)), x)
    assert layout.to_csc(a).count() == 5
    assert [r.crow for r in layout.compress(spark.createDataFrame([(0,), (0,), (2,), (2,)], "row long"), 3).orderBy("i").collect()] == [0, 2, 2, 4]
    places = [r.place for r in layout.order(a.coalesced()).orderBy("row", "col").collect()]
    assert places == list(range(len(places)))
    assert np.allclose(arrays.to_dense(layout.densify(a)), x) and np.allclose(full(layout.sparsify(layout.densify(a))), x)
    assert np.allclose(full(a.t), x.transpose(0, 2, 1))
    assert np.allclose(full(layout.triangle(a, upper=True, strict=True)), np.triu(x, 1))
    assert np.allclose(full(layout.eye(spark, 4, 2)), np.stack([np.eye(4)] * 2))


def test_pointers_over_many_blocks(spark):
    rows = spark.range(500).select((F.col("id") * 400).alias("row"))
    out = layout.compress(rows, 200_001)
    assert layout.decompress(out).count() == 500 and out.where("i = 200001").first().crow == 500


def test_stack_and_blocks(spark):
    a, x = matrix(spark, (4, 3), 6, seed=8)
    b, y = matrix(spark, (4, 3), 5, seed=9, batches=2)
    c, z = matrix(spark, (2, 5), 4, seed=10)
    assert np.allclose(full(layout.stack(a, b)), np.concatenate([x, y]))
    joined = layout.block_diag(a, b, c)
    want = np.zeros((14, 14))
    at = np.zeros(2, dtype=int)
    for m in (*x, *y, *z):
        want[at[0] : at[0] + m.shape[0], at[1] : at[1] + m.shape[1]] = m
        at += m.shape
    assert np.allclose(full(joined)[0], want) and layout.block_diag(a) is a
    parts = layout.block_diag_split(joined, (4, 3), (4, 3), (4, 3), (2, 5))
    assert all(np.allclose(full(p)[0], m) for p, m in zip(parts, (*x, *y, *z), strict=True))
    for bad in (lambda: layout.stack(a, c), lambda: layout.block_diag_split(joined, (4, 3)), lambda: layout.stack(), lambda: layout.block_diag()):
        with pytest.raises(ValueError):
            bad()


def test_plans_broadcast_nothing_large_and_push_columns(spark):
    a = Sparse.of(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").selectExpr("l_orderkey AS row", "l_partkey AS col", "l_quantity AS val"), 1500, 200)
    plan = product.spmm(a, Dense.of(spark.createDataFrame([(0, [1.0])], "row long, vec array<double>"), 200, 1), every_row=False).df._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in plan
