"""Checks of a sample's mean and covariance: Hotelling's T² and Nagao's test, for each batch; and the samples' moments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import Dense
from ..functions.special import chi2_quantile, f_quantile
from .product import summed

_RESULT = "batch long, accepted boolean, statistic double, threshold double"


def moments(samples: Dense) -> DataFrame:
    """(batch, n, mean, cov) of samples (batch, row = sample, vec): sums about the mean, cov as an array of rows.

    Means come first. Then each task adds up the products of its samples' distances to them, a row for each coordinate, and
    Spark adds up those: p rows of p numbers from each task, however many samples there are.
    """
    p = samples.width
    means = samples.df.groupBy("batch").agg(*(F.avg(F.get("vec", F.lit(i))).alias(f"m{i}") for i in range(p)), F.count("*").alias("n"))
    means = means.select("batch", "n", F.array(*(F.col(f"m{i}") for i in range(p))).alias("mean"))

    def products(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            keys = batch.column("batch").to_numpy()
            gaps = batch.column("gap").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            for k in np.unique(keys):
                own = gaps[keys == k]
                held[int(k)] = held.get(int(k), 0.0) + own.T @ own
        for k, m in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * p, pa.int64()), pa.array(np.arange(p)), pa.array(m.tolist(), pa.list_(pa.float64()))], names=["batch", "i", "part"])

    gaps = samples.df.join(means.select("batch", "mean"), "batch").select("batch", F.zip_with("vec", "mean", lambda x, m: x - m).alias("gap"))
    sums = summed(gaps.mapInArrow(products, "batch long, i long, part array<double>"), ["batch", "i"], F.col("part"), p)
    rows = sums.groupBy("batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "vec"))), lambda r: r["vec"]).alias("cov"))
    scaled = F.transform("cov", lambda r: F.transform(r, lambda x: F.when(F.col("n") > 1, x / (F.col("n") - 1))))
    return means.join(rows, "batch").select("batch", "n", "mean", scaled.alias("cov"))


def _each(df: DataFrame, test) -> DataFrame:
    """A test for each row, which holds one batch's moments."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            found = [test({k: np.array(v, dtype=np.float64) if isinstance(v, list) else v for k, v in r.items()}) for r in rows]
            columns = [pa.array([r["batch"] for r in rows], pa.int64()), pa.array([bool(s <= t) for s, t in found]), *(pa.array([float(x[k]) for x in found], pa.float64()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=["batch", "accepted", "statistic", "threshold"])

    return df.mapInArrow(run, _RESULT)


def hotelling_t2(df: DataFrame, n: int, confidence: float = 0.95, p: int | None = None) -> DataFrame:
    """(batch, accepted, statistic, threshold) from (batch, mean, true_mean, cov): n·dᵀS⁻¹d against p(n-1)/(n-p)·F.

    Without ``p``, the dimension is read from the first row, which runs the input's plan once more.
    """
    p = p or len(df.select("mean").first()[0])
    if n <= p:
        raise ValueError("more samples than dimensions are needed")
    threshold = p * (n - 1) / (n - p) * f_quantile(confidence, p, n - p)

    def test(r: dict) -> tuple[float, float]:
        d = r["mean"] - r["true_mean"]
        return n * d @ np.linalg.solve(r["cov"], d), threshold

    return _each(df.select("batch", "mean", "true_mean", "cov"), test)


def nagao(df: DataFrame, n: int, confidence: float = 0.95, p: int | None = None) -> DataFrame:
    """(batch, accepted, statistic, threshold) from (batch, cov, true_cov): n/2·|L⁻¹SL⁻ᵀ - I|² against chi-squared; p as above."""
    p = p or len(df.select("cov").first()[0])
    threshold = chi2_quantile(confidence, p * (p + 1) / 2)

    def test(r: dict) -> tuple[float, float]:
        low = np.linalg.cholesky(r["true_cov"])
        white = np.linalg.solve(low, np.linalg.solve(low, r["cov"]).T)
        return n / 2 * np.sum((white - np.eye(p)) ** 2), threshold

    return _each(df.select("batch", "cov", "true_cov"), test)
