"""Exchange with arrays: triplets, compressed rows and dense arrays of numpy, by way of Arrow."""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from ..frames import Dense, Sparse
from ..operators.layout import to_csr


def from_coo(spark: SparkSession, rows, cols, vals, shape: tuple[int, int], coalesce: bool = False) -> Sparse:
    table = pa.table({"row": pa.array(np.asarray(rows, dtype=np.int64)), "col": pa.array(np.asarray(cols, dtype=np.int64)), "val": pa.array(np.asarray(vals, dtype=np.float64))})
    out = Sparse.of(spark.createDataFrame(table), *shape)
    return out.coalesced() if coalesce else out


def to_coo(a: Sparse) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, cols, vals) in order of rows, then columns. Equal keys are added up, with a warning. For matrices that fit in memory."""
    if a.n_batch != 1:
        raise ValueError("an unbatched matrix, please")
    held = a.coalesced().df.orderBy("row", "col").toArrow()
    if held.num_rows < a.df.count():
        warnings.warn("entries with equal keys were added up", stacklevel=2)
    return tuple(held[c].to_numpy() for c in ("row", "col", "val"))


def from_csr(spark: SparkSession, crow, cols, vals, shape: tuple[int, int]) -> Sparse:
    crow = np.asarray(crow, dtype=np.int64)
    if len(crow) != shape[0] + 1:
        raise ValueError(f"{shape[0]} rows need {shape[0] + 1} pointers, not {len(crow)}")
    return from_coo(spark, np.repeat(np.arange(shape[0]), np.diff(crow)), cols, vals, shape)


def to_csr_arrays(a: Sparse) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = to_csr(a).orderBy("row").select("cols", "vals").collect()
    crow = np.concatenate([[0], np.cumsum([len(r.cols) for r in rows])]).astype(np.int64)
    return crow, np.array([c for r in rows for c in r.cols], dtype=np.int64), np.array([v for r in rows for v in r.vals], dtype=np.float64)


def from_dense(spark: SparkSession, x) -> Dense:
    x = np.asarray(x, dtype=np.float64)
    x = x.reshape(1, *x.shape) if x.ndim == 2 else x
    b, n, p = x.shape
    table = pa.table({"batch": pa.array(np.repeat(np.arange(b), n)), "row": pa.array(np.tile(np.arange(n), b)), "vec": pa.array(list(x.reshape(-1, p)), pa.list_(pa.float64()))})
    return Dense.of(spark.createDataFrame(table), n, p, b)


def to_dense(d: Dense) -> np.ndarray:
    """(n_batch, n_rows, width); absent rows are zero."""
    out = np.zeros((d.n_batch, d.n_rows, d.width))
    for r in d.df.toArrow().to_pylist():
        out[r["batch"], r["row"]] = r["vec"]
    return out
