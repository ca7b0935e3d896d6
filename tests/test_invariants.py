"""Invariants on random relations, and the encoder feeding the normal."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparrel.frames import Dense, Sparse
from sparrel.operators import encode, layout, mvn, product, reduce
from sparrel.sources import arrays

from .test_products import full, keys

few = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
entry = st.tuples(st.integers(0, 1), st.integers(0, 4), st.integers(0, 3), st.floats(-5, 5).map(lambda x: round(x, 3)))
entries = st.lists(entry, max_size=12)


def made(spark, rows) -> Sparse:
    return Sparse.of(spark.createDataFrame(rows, "batch long, row long, col long, val double"), 5, 4, 2)


@few
@given(entries)
def test_layouts_go_round(spark, rows):
    a = made(spark, rows)
    x = full(a)
    assert np.allclose(full(layout.from_csr(layout.to_csr(a), 5, 4, 2)), x)
    assert np.allclose(full(a.t.t), x) and np.allclose(full(a.coalesced()), x)
    blocks = layout.block_diag_split(layout.block_diag(a), (5, 4), (5, 4))
    assert all(np.allclose(full(b)[0], x[k]) for k, b in enumerate(blocks))
    back = layout.decompress(layout.compress(a.df.select("batch", "row"), 5, 2))
    assert sorted(map(tuple, back.collect())) == sorted((r.batch, r.row) for r in a.df.collect())


@few
@given(entries)
def test_gradients_keep_the_stored_keys(spark, rows):
    a = made(spark, rows)
    b, g = (arrays.from_dense(spark, np.random.default_rng(k).normal(size=(2, n, 2))) for k, n in ((1, 4), (2, 5)))
    assert keys(product.sddmm(a, g, b)) == keys(a)
    ones = spark.range(5).selectExpr("id AS row").crossJoin(spark.range(2).selectExpr("id AS batch")).withColumn("g", F.lit(1.0))
    assert keys(reduce.logsumexp_vjp(a, 2, ones)) == keys(a)


@few
@given(entries, st.booleans())
def test_both_ways_equal_two_calls(spark, rows, zeros):
    a = made(spark, rows).coalesced()
    cols, rows_ = reduce.bidir_logsumexp(a, zeros)
    for one, two, key in ((cols, reduce.logsumexp(a, 1, zeros), "col"), (rows_, reduce.logsumexp(a, 2, zeros), "row")):
        left, right = ({(r.batch, r[key]): r.lse for r in df.collect()} for df in (one, two))
        assert left.keys() == right.keys()
        assert all(np.isclose(left[k], right[k]) or left[k] == right[k] for k in left)


def test_encoder_feeds_the_normal(spark):
    """Neighbour values become a strictly lower factor; draws through it have its covariance."""
    e = encode.PairwiseEncoder(1.5, (2, 4, 4), upper=False, relation="intra")
    cells = spark.range(e.size).selectExpr("id AS row").crossJoin(spark.range(len(e.offsets)).selectExpr("CAST(id AS int) AS offset_id"))
    factor = e.encode(cells.withColumn("val", (F.col("row") * 3 + F.col("offset_id")) % 7 / 20.0))
    assert all(r > c for _, r, c in keys(factor))
    zero = F.lit(0).cast("long").alias("batch")
    index = spark.range(e.size).select(zero, F.col("id").alias("row"))
    held = mvn.SparseMVN(index.withColumn("loc", F.lit(1.0)), scale_tril=factor, diagonal=index.withColumn("d", F.lit(0.5)))
    x = arrays.to_dense(held.rsample(mvn.noise(spark, e.size, 4000, seed=1)))[0]
    low = full(factor)[0] + np.eye(e.size)
    want = 0.5 * low @ low.T
    assert np.abs(np.cov(x) - want).max() < 0.15 * want.max() and np.abs(x.mean(axis=1) - 1).max() < 0.1 * np.sqrt(want.max()) + 0.05
    g = Dense(index.withColumn("vec", F.array_repeat(F.lit(1.0), 3)), e.size, 3)
    of_loc, of_factor = held.rsample_vjp(mvn.noise(spark, e.size, 3, seed=2), g)
    assert keys(of_factor) == keys(factor) and {r.g for r in of_loc.collect()} == {3.0}
    back = e.encode_vjp(of_factor)
    assert back.count() == e.size * len(e.offsets) and back.where("val <> 0").count() <= factor.df.count()
