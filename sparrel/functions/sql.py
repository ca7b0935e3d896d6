"""What SQL can call: log-sum-exp in two native aggregates, and table functions for identities and encoder offsets.

``SELECT k, lse_merge(collect_list(struct(b, s))) FROM (SELECT k, lse_bucket(x) AS b, sum(lse_term(x)) AS s FROM t GROUP BY
ALL) GROUP BY k`` adds up before each shuffle and has a pair for each bucket of ``reduce.STEP`` that a group's values fall in.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..frames import Dense, Sparse
from ..operators.encode import offsets
from ..operators.reduce import STEP

_BUCKET = f"rint(x / {STEP}D)"
_INF = "double('Infinity')"
FUNCTIONS = (
    f"lse_bucket(x DOUBLE) RETURNS DOUBLE RETURN {_BUCKET}",
    f"lse_term(x DOUBLE) RETURNS DOUBLE RETURN CASE WHEN x = {_INF} THEN x WHEN x = -{_INF} THEN 0D ELSE exp(x - {STEP}D * {_BUCKET}) END",
    f"lse_merge(parts ARRAY<STRUCT<b: DOUBLE, s: DOUBLE>>) RETURNS DOUBLE RETURN CASE WHEN coalesce(array_max(parts).s, 0D) = 0D THEN -{_INF} WHEN abs(array_max(parts).b) = {_INF} THEN array_max(parts).b "
    f"ELSE {STEP}D * array_max(parts).b + ln(aggregate(parts, 0D, (t, p) -> t + p.s * exp({STEP}D * (p.b - array_max(parts).b)))) END",
    "sparse_eye(n BIGINT) RETURNS TABLE (row BIGINT, col BIGINT, val DOUBLE) RETURN SELECT i, i, 1D FROM (SELECT explode(sequence(0L, (n - 1) DIV 65536)) AS k WHERE n > 0) LATERAL VIEW explode(sequence(k * 65536, least(n - 1, k * 65536 + 65535))) AS i",
)


class Offsets:
    """(offset_id, offset) of an encoder."""

    def eval(self, radius: float, dims: int, channels: int, relation: str):
        for k, o in enumerate(offsets(radius, dims, None, channels, relation)):
            yield k, list(o)


def register(spark: SparkSession) -> None:
    """Makes lse_bucket, lse_term, lse_merge, sparse_eye and encoder_offsets known to a session's SQL."""
    for text in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
    spark.udtf.register("encoder_offsets", F.udtf(Offsets, returnType="offset_id int, offset array<int>"))


def view(matrix: Sparse | Dense, name: str) -> None:
    """A matrix's relation under a name."""
    matrix.df.createOrReplaceTempView(name)
