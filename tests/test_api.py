"""The familiar names: each is there and does what its operator does."""

import numpy as np
import pytest

from sparrel import api
from sparrel.sources import arrays

from .test_models import _factor, _vector
from .test_products import dense, full, matrix
from .test_solvers import from_full, spd


def test_every_name_is_there():
    names = """sparse_mm gather_mm segment_mm sparse_triangular_solve sparse_generic_solve sparse_generic_lstsq sparse_logsumexp sparse_bidir_logsumexp
    linear_cg minres bicgstab lsmr LinearCGSettings MINRESSettings BICGSTABSettings convert_coo_to_csr_indices_values convert_coo_to_csr
    sparse_block_diag sparse_block_diag_split stack_csr sparse_eye rand_sparse rand_sparse_tri make_spd_sparse PairwiseEncoder calc_pairwise_coo_indices_nd
    SparseMultivariateNormal SparseMultivariateNormalNative mean_hotelling_t2_test cov_nagao_test""".split()
    assert all(callable(getattr(api, n)) for n in names)


def test_compressing_gives_pointers_and_a_permutation(spark):
    a, x = matrix(spark, (6, 5), 11, batches=2, seed=3, repeats=3)
    pointers, entries = api.convert_coo_to_csr_indices_values(a)
    for b in range(2):
        crow = [r.crow for r in pointers.where(f"batch = {b}").orderBy("i").collect()]
        held = entries.where(f"batch = {b}").orderBy("place").collect()
        assert [r.place for r in held] == list(range(crow[-1]))
        out = np.zeros((6, 5))
        for i in range(6):
            for r in held[crow[i] : crow[i + 1]]:
                out[i, r.col] = r.val
        assert np.allclose(out, x[b])


def test_stacked_rows(spark):
    a, _ = matrix(spark, (4, 3), 6)
    out = api.stack_csr(api.convert_coo_to_csr(a), api.convert_coo_to_csr(a))
    assert out.count() == 8 and out.select("batch").distinct().count() == 2
    with pytest.raises(ValueError):
        api.stack_csr()


def test_layouts_of_random_matrices(spark):
    assert full(api.rand_sparse(spark, 5, 4, 9, seed=2)).astype(bool).sum() == 9
    csr = api.rand_sparse_tri(spark, 5, 9, layout="csr", upper=False)
    assert csr.count() == 5 and all(max(r.cols) == r.row for r in csr.collect())
    with pytest.raises(ValueError):
        api.rand_sparse(spark, 5, 4, 9, layout="other")


@pytest.mark.parametrize("solver", [None, "cg", "cgs", "minres", "gmres", "spsolve"])
def test_named_solvers(spark, solver):
    x = spd(10)
    b, y = dense(spark, (1, 10, 2))
    assert np.allclose(arrays.to_dense(api.sparse_named_solve(from_full(spark, x), b, solver))[0], np.linalg.solve(x, y[0]), atol=1e-6)
    assert np.allclose(arrays.to_dense(api.sparse_bicgstab_solve(from_full(spark, x), b))[0], np.linalg.solve(x, y[0]), atol=1e-6)


def test_loose_settings_stop_early():
    a, steps = spd(200), []
    api.linear_cg(lambda v: steps.append(1) or a @ v, np.ones(200), api.LOOSE_CG)
    assert 10 <= len(steps) <= 12


def test_old_names_warn(spark):
    with pytest.warns(DeprecationWarning):
        assert api.PairwiseVoxelEncoder(1, (1, 2, 2, 2)).size == 8
    with pytest.warns(DeprecationWarning):
        assert api.calc_pairwise_coo_indices(spark, 1, (1, 2, 2, 2)).count() == 24


def test_native_normal(spark, tmp_path):
    low = _factor(3)
    held = api.SparseMultivariateNormalNative(_vector(spark, np.zeros(5), "loc"), from_full(spark, low))
    assert np.allclose(full(held.covariance())[0], low @ low.T)
    with pytest.raises(ValueError):
        api.SparseMultivariateNormalNative(held.loc, api.sparse_eye(spark, 5, 2))
    api.write_csv(held.variance(), str(tmp_path / "v"))
    assert spark.read.option("header", True).csv(str(tmp_path / "v")).count() == 5
