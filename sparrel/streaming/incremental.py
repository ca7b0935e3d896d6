"""Entries that arrive as a stream: log-sum-exp by event-time window, and products with a fixed vector.

Windows close when the watermark passes them; entries that come later than it allows are dropped by Spark. The state of a
window and row is its greatest value, the sum of exponentials relative to it, and a count: three numbers that can be added
up in any order without overflow, whatever the values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..frames import Sparse


def added(state: tuple[float, float, int], values: np.ndarray) -> tuple[float, float, int]:
    """(top, sum of exp(value - top), n) of what a state holds and of further values."""
    top, total, n = state
    high = max(top, float(values.max(initial=-np.inf)))
    if np.isinf(high):
        return high, total + float((values == high).sum()), n + len(values)
    return high, total * float(np.exp(top - high)) + float(np.exp(values - high).sum()), n + len(values)


def _take(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    window, row = key
    if state.hasTimedOut:
        state.remove()
        return
    held = tuple(state.get) if state.exists else (-np.inf, 0.0, 0)
    for frame in frames:
        held = added(held, frame["val"].dropna().to_numpy(dtype=np.float64))
    state.update(held)
    end = pd.Timestamp(window["end"] if isinstance(window, dict) else window[1])
    state.setTimeoutTimestamp(max(int(end.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
    top, total, n = held
    yield pd.DataFrame({"start": [window["start"] if isinstance(window, dict) else window[0]], "row": [row], "lse": [top if np.isinf(top) else top + float(np.log(total))], "n": [n]})


def windowed_logsumexp(entries: DataFrame, duration: str, late: str, slide: str | None = None) -> DataFrame:
    """(start, row, lse, n) from a stream of (ts, row, val), by tumbling or sliding windows, in update mode.

    Each micro-batch gives a row, as it then stands, for every window and row that got entries. Rows without entries in a
    window don't appear. State goes when the watermark passes the window's end. For frames that aren't streams there is
    ``reduce.logsumexp``.
    """
    held = entries.withWatermark("ts", late).select(F.window("ts", duration, slide or duration).alias("window"), "row", "val")
    return held.groupBy("window", "row").applyInPandasWithState(_take, "start timestamp, row long, lse double, n long", "top double, total double, n long", "update", GroupStateTimeout.EventTimeTimeout)


def session_logsumexp(entries: DataFrame, gap: str, late: str) -> DataFrame:
    """(window, row, lse, n) by sessions; the state of a session is its values, as Spark merges sessions by lists."""
    sums = entries.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("window"), "row").agg(F.max("val").alias("top"), F.collect_list("val").alias("vals"), F.count("*").alias("n"))
    total = F.aggregate("vals", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    return sums.select("window", "row", F.when(F.abs("top") == float("inf"), F.col("top")).otherwise(F.col("top") + F.log(total)).alias("lse"), "n")


def windowed_spmv(entries: DataFrame, vector: DataFrame, duration: str, late: str, slide: str | None = None) -> DataFrame:
    """(window, row, val): the product of each window's entries (ts, row, col, val) with a fixed vector (col, x)."""
    met = entries.withWatermark("ts", late).join(vector, "col")
    return met.groupBy(F.window("ts", duration, slide or duration).alias("window"), "row").agg(F.sum(F.col("val") * F.col("x")).alias("val"))


def as_sparse(entries: DataFrame, n_rows: int, n_cols: int) -> Sparse:
    """What has arrived so far, as a matrix."""
    return Sparse.of(entries, n_rows, n_cols)
