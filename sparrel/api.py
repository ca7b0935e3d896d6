"""The operators under the names that users of sparse tensor libraries know, on relations.

Matrices are ``Sparse`` and ``Dense``; vectors are dense matrices of one column. Layout names are ``coo`` and ``csr``: the
first is the relation of entries itself, the second the frame of ``layout.to_csr``. Gradients are the ``*_vjp`` functions of
``sparrel.operators``, as frames have no tape.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import Dense, Sparse
from .operators import encode, krylov, layout, product, reduce, solve, stats
from .operators.mvn import SparseMVN
from .sources import arrays, matrix_market, random

# Products

sparse_mm = product.spmm
sparse_mm_vjp = product.spmm_vjp
gather_mm = product.gather_mm
segment_mm = product.segment_mm
batch_sparse_mv = product.batch_mv

# Solvers

LinearCGSettings, MINRESSettings, BICGSTABSettings, LSMRSettings = krylov.CGSettings, krylov.MinresSettings, krylov.BicgstabSettings, krylov.LsmrSettings
linear_cg, minres, bicgstab, lsmr = krylov.cg, krylov.minres, krylov.bicgstab, krylov.lsmr
#: Stops when the mean residual of unit-length columns is under 1, as a loose default does; ours is tight.
LOOSE_CG = krylov.CGSettings(tolerance=1.0)
sparse_triangular_solve = solve.triangular_solve
sparse_generic_solve = solve.generic_solve
sparse_generic_lstsq = solve.lstsq


def sparse_named_solve(a: Sparse, b: Dense, solver: str | Callable | None = None, **options) -> Dense:
    """By name (cg, cgs, minres, gmres, spsolve, bicgstab) or callable; without one, a dense factorisation.

    An iterative solver by name takes any number of right-hand sides, unlike where each column needs a call of its own.
    """
    return solve.generic_solve(a, b, "spsolve" if solver is None else solver, **options)


def sparse_bicgstab_solve(a: Sparse, b: Dense, solver: str | Callable = "bicgstab", **options) -> Dense:
    return solve.generic_solve(a, b, solver, **options)


# Reductions

sparse_logsumexp = reduce.logsumexp
sparse_bidir_logsumexp = reduce.bidir_logsumexp

# Layouts and structure

convert_coo_to_csr = layout.to_csr
sparse_block_diag = layout.block_diag
sparse_block_diag_split = layout.block_diag_split
sparse_eye = layout.eye


def convert_coo_to_csr_indices_values(a: Sparse) -> tuple[DataFrame, DataFrame]:
    """Pointers (batch, i, crow), and entries (batch, place, col, val) in their order; the place is the permutation."""
    held = a.coalesced()
    places = layout.order(held).join(held.df, ["batch", "row", "col"]).select("batch", "place", "col", "val")
    return layout.compress(held.df.select("batch", "row"), a.n_rows, a.n_batch), places


def stack_csr(*frames: DataFrame) -> DataFrame:
    """Frames of ``layout.to_csr`` as one batch, in order; they must have equally many batches of their own: one each."""
    if not frames:
        raise ValueError("nothing to stack")
    out = None
    for k, df in enumerate(frames):
        df = df.withColumn("batch", F.lit(k).cast("long"))
        out = df if out is None else out.unionByName(df)
    return out


def _laid_out(a: Sparse, name: str) -> Sparse | DataFrame:
    if name not in ("coo", "csr"):
        raise ValueError(f"no layout {name!r}")
    return a if name == "coo" else layout.to_csr(a)


# Random sources


def rand_sparse(spark: SparkSession, n_rows: int, n_cols: int, nnz: int, layout: str = "coo", **options):
    return _laid_out(random.rand_sparse(spark, n_rows, n_cols, nnz, **options), layout)


def rand_sparse_tri(spark: SparkSession, n: int, nnz: int, layout: str = "coo", **options):
    return _laid_out(random.rand_sparse_tri(spark, n, nnz, **options), layout)


make_spd_sparse = random.make_spd

# Encoding

PairwiseEncoder = encode.PairwiseEncoder


def calc_pairwise_coo_indices_nd(spark: SparkSession, radius: float, shape: tuple[int, ...], diag: bool = False, upper: bool | None = None, relation: str = "indep") -> DataFrame:
    """(offset_id, offset, row, col) of every entry, row-major."""
    return encode.PairwiseEncoder(radius, shape, diag, upper, relation).structure(spark)


def _deprecated(new: Callable, old: str) -> Callable:
    def call(*args, **options):
        warnings.warn(f"{old} is deprecated; use {new.__name__}", DeprecationWarning, stacklevel=2)
        return new(*args, **options)

    return call


calc_pairwise_coo_indices = _deprecated(calc_pairwise_coo_indices_nd, "calc_pairwise_coo_indices")
PairwiseVoxelEncoder = _deprecated(encode.PairwiseEncoder, "PairwiseVoxelEncoder")

# Distributions and checks

SparseMultivariateNormal = SparseMVN


class SparseMultivariateNormalNative(SparseMVN):
    """Only by a lower factor of the covariance, of one distribution; with its covariance, variance and density."""

    def __init__(self, loc: DataFrame, scale_tril: Sparse) -> None:
        if scale_tril.n_batch != 1:
            raise ValueError("one distribution, please")
        super().__init__(loc, scale_tril=scale_tril)


mean_hotelling_t2_test = stats.hotelling_t2
cov_nagao_test = stats.nagao

# Exchange and files

from_coo, to_coo, from_csr, to_csr, from_dense, to_dense = arrays.from_coo, arrays.to_coo, arrays.from_csr, arrays.to_csr_arrays, arrays.from_dense, arrays.to_dense
read_matrix_market, write_matrix_market = matrix_market.read, matrix_market.write


def write_csv(df: DataFrame, path: str) -> None:
    """Results as CSV with a header, a file for each partition."""
    df.write.option("header", True).csv(path)
