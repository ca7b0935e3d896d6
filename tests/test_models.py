"""Encoding, normals, checks, random sources, files, SQL and streams."""

import math
from itertools import product as grid

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrel.functions import special
from sparrel.functions import sql as sql_functions
from sparrel.operators import encode, mvn, stats
from sparrel.sources import arrays, matrix_market, random
from sparrel.streaming import incremental

from .test_products import dense, full, matrix
from .test_solvers import from_full


@pytest.mark.parametrize(("radius", "n"), [(1, 6), (1.5, 18), (2, 32)])
def test_lattice(radius, n):
    assert len(encode.lattice(radius, 3)) == n


def test_order_of_offsets():
    assert encode.offsets(1, 3) == [(0, 0, 0, -1), (0, 0, 0, 1), (0, 0, -1, 0), (0, 0, 1, 0), (0, -1, 0, 0), (0, 1, 0, 0)]
    lower = encode.offsets(1, 3, upper=False, channels=2, relation="inter")
    assert lower == [(0, 0, 0, 1), (0, 0, 1, 0), (0, 1, 0, 0), (1, 0, 0, 0), (1, 0, 0, -1), (1, 0, 0, 1), (1, 0, -1, 0), (1, 0, 1, 0), (1, -1, 0, 0), (1, 1, 0, 0)]
    assert encode.offsets(1, 3, diag=True)[0] == (0, 0, 0, 0)
    for bad in ({"radius": 0.5, "dims": 3}, {"radius": 1, "dims": 3, "relation": "other"}, {"radius": 1, "dims": 3, "relation": "intra"}):
        with pytest.raises(ValueError):
            encode.offsets(**bad)
    with pytest.raises(ValueError):
        encode.PairwiseEncoder(1, (3,))


def test_pairs_of_a_small_volume(spark):
    """3 x 2 x 2 x 2: rows by offset, columns at a fixed distance."""
    e = encode.PairwiseEncoder(1.5, (3, 2, 2, 2), upper=False, relation="inter")
    held: dict[tuple, list] = {}
    for r in e.structure(spark).orderBy("row").collect():
        held.setdefault(tuple(r.offset), []).append((r.row, r.col))
    want = {(0, 0, 0, 1): (list(range(1, 24, 2)), 1), (0, 0, 1, 0): ([2, 3, 6, 7, 10, 11, 14, 15, 18, 19, 22, 23], 2), (0, 1, 0, 0): ([4, 5, 6, 7, 12, 13, 14, 15, 20, 21, 22, 23], 4), (1, 0, 0, 0): (list(range(8, 24)), 8), (2, 0, 0, 0): (list(range(16, 24)), 16), (0, 0, 1, -1): ([2, 6, 10, 14, 18, 22], 1), (1, -1, 0, 0): ([8, 9, 10, 11, 16, 17, 18, 19], 4)}
    for offset, (rows, gap) in want.items():
        assert held[offset] == [(r, r - gap) for r in rows]


@pytest.mark.parametrize(("shape", "radius", "relation", "upper", "diag", "batches"), [((1, 4, 5), 1, "indep", None, True, 1), ((2, 3, 3, 2), 1.5, "intra", False, False, 2), ((3, 2, 3, 2), 1, "inter", None, True, 1), ((2, 3, 4), 2, "inter", True, False, 1)])
def test_encoder_and_its_gradient(spark, shape, radius, relation, upper, diag, batches):
    e = encode.PairwiseEncoder(radius, shape, diag, upper, relation)
    v = np.random.default_rng(0).normal(size=(batches, len(e.offsets), *shape))
    spots = list(grid(*map(range, shape)))
    rows = [(b, o, *s, float(v[(b, o, *s)])) for b in range(batches) for o in range(len(e.offsets)) for s in spots]
    names = ", ".join(["batch long", "offset_id long", "c long", *(f"s{k} long" for k in range(1, len(shape))), "val double"])
    a = e.encode(encode.voxel_values(spark.createDataFrame(rows, names), shape), batches)
    want, grad = np.zeros((batches, e.size, e.size)), {}
    for b, (o, offset), s in grid(range(batches), enumerate(e.offsets), spots):
        other = tuple(x - k for x, k in zip(s, offset, strict=True))
        if all(0 <= x < n for x, n in zip(other, shape, strict=True)):
            i, j = np.ravel_multi_index(s, shape), np.ravel_multi_index(other, shape)
            want[b, i, j] = v[(b, o, *s)]
            grad[b, o, int(i)] = float(i * 100 + j)
    assert np.allclose(full(a), want)
    g = a.with_df(a.df.withColumn("val", (F.col("row") * 100 + F.col("col")).cast("double")))
    back = e.encode_vjp(g).collect()
    assert len(back) == batches * len(e.offsets) * e.size
    assert all(r.val == grad.get((r.batch, r.offset_id, r.row), 0.0) for r in back)


def _factor(seed, n=5, strict=False):
    rng = np.random.default_rng(seed)
    low = np.tril(rng.normal(size=(n, n)), -1) * 0.5
    return low if strict else low + np.diag(rng.uniform(1, 2, n))


def _vector(spark, x, name):
    return spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], f"batch long, row long, {name} double")


def test_draws_have_the_wanted_moments(spark):
    n, samples, mu, d = 5, 20_000, np.arange(5.0), np.array([0.5, 1, 2, 1, 0.7])
    eps = mvn.noise(spark, n, samples, seed=5)
    loc, plain, strict = _vector(spark, mu, "loc"), _factor(1), _factor(2, strict=True)
    unit = strict + np.eye(n)
    cases = [
        (mvn.SparseMVN(loc, scale_tril=from_full(spark, plain)), plain @ plain.T),
        (mvn.SparseMVN(loc, scale_tril=from_full(spark, strict), diagonal=_vector(spark, d, "d")), unit @ np.diag(d) @ unit.T),
        (mvn.SparseMVN(loc, precision_tril=from_full(spark, plain)), np.linalg.inv(plain @ plain.T)),
        (mvn.SparseMVN(loc, precision_tril=from_full(spark, strict), diagonal=_vector(spark, d, "d")), np.linalg.inv(unit @ np.diag(d) @ unit.T)),
    ]
    for held, cov in cases:
        x = arrays.to_dense(held.rsample(eps))[0]
        df = spark.createDataFrame([(0, x.mean(axis=1).tolist(), mu.tolist(), np.cov(x).tolist(), cov.tolist())], "batch long, mean array<double>, true_mean array<double>, cov array<array<double>>, true_cov array<array<double>>")
        assert stats.hotelling_t2(df, samples, 0.999).first().accepted
        assert stats.nagao(df, samples, 0.999).first().accepted
        wrong = df.withColumn("true_mean", F.transform("true_mean", lambda v: v + 1)).withColumn("true_cov", F.transform("true_cov", lambda r: F.transform(r, lambda v: v * 2)))
        assert not stats.hotelling_t2(wrong, samples).first().accepted and not stats.nagao(wrong, samples).first().accepted
    assert cases[0][0].mean is loc and cases[0][0].mode is loc and cases[1][0].is_ldlt


def test_density_variance_and_guards(spark):
    low, mu, v = _factor(3), np.arange(5.0), np.random.default_rng(1).normal(size=5)
    held = mvn.SparseMVN(_vector(spark, mu, "loc"), scale_tril=from_full(spark, low))
    cov = low @ low.T
    want = -0.5 * ((v - mu) @ np.linalg.solve(cov, v - mu) + 5 * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1])
    assert abs(held.log_prob(_vector(spark, v, "val")).first().log_prob - want) < 1e-9
    assert np.allclose(full(held.covariance())[0], cov)
    assert np.allclose([r.variance for r in held.variance().orderBy("row").collect()], np.diag(cov))
    with pytest.raises(ValueError):
        mvn.SparseMVN(held.loc)
    with pytest.raises(NotImplementedError):
        mvn.SparseMVN(held.loc, precision_tril=held.scale_tril).covariance()


@pytest.mark.parametrize("precision", [False, True])
def test_gradients_of_draws(spark, precision):
    low = _factor(4)
    (eps, e), (g, z) = dense(spark, (1, 5, 3)), dense(spark, (1, 5, 3), seed=2)
    f = from_full(spark, low)
    held = mvn.SparseMVN(_vector(spark, np.zeros(5), "loc"), **{"precision_tril" if precision else "scale_tril": f})
    of_loc, of_factor = held.rsample_vjp(eps, g)
    assert np.allclose([r.g for r in of_loc.orderBy("row").collect()], z[0].sum(axis=1))
    draw = lambda m: np.sum((np.linalg.solve(m.T, e[0]) if precision else m @ e[0]) * z[0])
    for r in of_factor.df.collect():
        m = low.copy()
        m[r.row, r.col] += 1e-6
        assert abs(r.val - (draw(m) - draw(low)) / 1e-6) < 1e-4


def test_quantiles():
    assert abs(special.f_quantile(0.95, 2, 998) - 3.00474) < 1e-4
    assert abs(special.chi2_quantile(0.95, 3) - 7.81473) < 1e-5
    assert abs(special.chi2_quantile(0.5, 2) - 2 * math.log(2)) < 1e-9
    assert special.chi2_quantile(0.9, 4) < special.chi2_quantile(0.99, 4)
    with pytest.raises(ValueError):
        special.chi2_quantile(1.5, 2)


@pytest.mark.parametrize(("n", "m", "nnz", "batches"), [(4, 4, 16, 1), (7, 3, 9, 3), (1, 1, 1, 1), (5, 5, 0, 1), (40, 60, 1000, 2)])
def test_random_matrices(spark, n, m, nnz, batches):
    a = random.rand_sparse(spark, n, m, nnz, batches, seed=3)
    rows = a.df.collect()
    assert len(rows) == len({(r.batch, r.row, r.col) for r in rows}) == nnz * batches
    assert all(0 <= r.row < n and 0 <= r.col < m and 0 <= r.val < 1 for r in rows)
    assert sorted(random.rand_sparse(spark, n, m, nnz, batches, seed=3).df.collect()) == sorted(rows)
    with pytest.raises(ValueError):
        random.rand_sparse(spark, n, m, n * m + 1)


@pytest.mark.parametrize("upper", [True, False])
@pytest.mark.parametrize("strict", [True, False])
def test_random_triangles(spark, upper, strict):
    for nnz in (8, 20, 28 if strict else 36):
        rows = random.rand_sparse_tri(spark, 8, nnz, 2, upper, strict, seed=1, value_range=(2, 3), well_conditioned=True, min_diag=5).df.collect()
        assert len({(r.batch, r.row, r.col) for r in rows}) == len(rows) == 2 * nnz
        side = [(r.col - r.row) if upper else (r.row - r.col) for r in rows]
        assert min(side) >= int(strict) and (strict or side.count(0) == 16)
        assert all(2 <= r.val < 3 if r.row != r.col else r.val >= 7 for r in rows)
    with pytest.raises(ValueError):
        random.rand_sparse_tri(spark, 8, 7, strict=False)


def test_definite_matrices(spark):
    x = full(random.make_spd(spark, 20, 0.4, seed=2))[0]
    assert np.allclose(x, x.T) and np.linalg.eigvalsh(x).min() > 0.5


@pytest.mark.parametrize(("kind", "body", "want"), [("real general", "3 2 2\n1 1 1.5\n3 2 -2e1\n", [[1.5, 0], [0, 0], [0, -20]]), ("integer symmetric", "% note\n\n2 2 2\n1 1 3\n2 1 4\n", [[3, 4], [4, 0]]), ("pattern general", "2 2 1\n  2   1\n", [[0, 0], [1, 0]]), ("real skew-symmetric", "2 2 1\n2 1 5\n", [[0, -5], [5, 0]])])
def test_matrix_market(spark, tmp_path, kind, body, want):
    path = tmp_path / "m.mtx"
    path.write_text(f"%%MatrixMarket matrix coordinate {kind}\n{body}")
    assert np.allclose(full(matrix_market.read(spark, str(path)))[0], want)
    path.write_text("no header\n")
    with pytest.raises(ValueError):
        matrix_market.read(spark, str(path))


def test_matrix_market_round_trip(spark, tmp_path):
    a, x = matrix(spark, (30, 20), 100)
    matrix_market.write(a, str(tmp_path / "m"))
    assert np.allclose(full(matrix_market.read(spark, str(tmp_path / "m"))), x)


def test_sql_functions(spark):
    sql_functions.register(spark)
    a, x = matrix(spark, (3, 4), 7)
    sql_functions.view(a, "some_matrix")
    rows = spark.sql("SELECT row, lse_merge(collect_list(struct(b, s))) AS lse FROM (SELECT row, lse_bucket(val) AS b, sum(lse_term(val)) AS s FROM some_matrix GROUP BY ALL) GROUP BY row").collect()
    for r in rows:
        v = x[0, r.row][x[0, r.row] != 0]
        assert abs(r.lse - np.log(np.exp(v).sum())) < 1e-9
    assert spark.sql("SELECT count(*) FROM sparse_eye(7)").first()[0] == 7 and spark.sql("SELECT * FROM sparse_eye(0)").count() == 0
    assert spark.sql("SELECT sum(val), max(row) FROM sparse_eye(200000) WHERE row = col").first() == (200_000, 199_999)
    held = spark.sql("SELECT k, lse_merge(collect_list(struct(b, s))) AS l FROM (SELECT k, lse_bucket(x) AS b, sum(lse_term(x)) AS s FROM VALUES (1, -900D), (1, 700D), (2, double('Infinity')), (2, 1D), (3, -double('Infinity')) AS t(k, x) GROUP BY ALL) GROUP BY k ORDER BY k").collect()
    assert [r.l for r in held] == [700, math.inf, -math.inf]
    assert [tuple(r.offset) for r in spark.sql("SELECT * FROM encoder_offsets(1.0D, 3, 1, 'indep') ORDER BY offset_id").collect()] == encode.offsets(1, 3)


def test_streams_give_what_batches_give(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", m % 3, m % 2, float(m % 7)) for m in range(50)]
    df = spark.createDataFrame(rows, "ts string, row long, col long, val double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    vector = spark.createDataFrame([(0, 2.0), (1, 3.0)], "col long, x double")

    def taken(out, name, mode="complete"):
        run = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        run.awaitTermination()
        return spark.table(name)

    for k, slide in enumerate((None, "5 minutes")):
        got = {(r.start, r.row): (r.lse, r.n) for r in taken(incremental.windowed_logsumexp(stream(), "10 minutes", "1 minute", slide), f"lse{k}", "update").collect()}
        each = df.select(F.window("ts", "10 minutes", slide or "10 minutes").start.alias("start"), "row", "val").groupBy("start", "row").agg(F.log(F.sum(F.exp("val"))).alias("lse"), F.count("*").alias("n"))
        batch = {(r.start, r.row): (r.lse, r.n) for r in each.collect()}
        assert got.keys() == batch.keys() and all(np.allclose(got[k], batch[k]) for k in got)
    by_window = lambda rows: {(r.window.start, r.row): (r.val,) for r in rows.collect()}
    got = by_window(taken(incremental.windowed_spmv(stream(), vector, "10 minutes", "1 minute"), "spmv"))
    want = by_window(incremental.windowed_spmv(df, vector, "10 minutes", "1 minute"))
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in got)
    sessions = incremental.session_logsumexp(df, "2 minutes", "1 minute")
    assert sessions.agg(F.sum("n")).first()[0] == 50 and sessions.where("lse IS NULL").count() == 0


def test_streamed_values_of_any_size(spark, tmp_path):
    values = [-400.0, 900.0, 899.0, -1e300, 1200.0]
    state = (-math.inf, 0.0, 0)
    for v in values[:1]:
        state = incremental.added(state, np.array([v]))
    assert state == (-400.0, 1.0, 1)
    state = incremental.added(incremental.added(state, np.array(values[1:3])), np.array(values[3:]))
    assert state[0] == 1200 and state[1] == 1.0 and state[2] == 5
    assert incremental.added(state, np.array([math.inf]))[0] == math.inf and incremental.added((-math.inf, 0.0, 0), np.array([-math.inf]))[0] == -math.inf
