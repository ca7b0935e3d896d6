"""Matrix Market coordinate files, read and written as text by Spark, so in parts and from any file system."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..frames import Sparse


def read(spark: SparkSession, path: str) -> Sparse:
    """A real, integer or pattern matrix, general, symmetric or skew-symmetric; the other half is filled in.

    The header and the sizes are read first; the entries are one map over the lines.
    """
    # lines are numbered before any filter, so that every reading of them numbers them alike
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    header = lines.where(F.col("value").startswith("%%MatrixMarket")).first()
    if header is None:
        raise ValueError(f"no Matrix Market header in {path}")
    words = header.value.lower().split()
    if words[1:3] != ["matrix", "coordinate"] or words[3] not in ("real", "integer", "pattern") or words[4] not in ("general", "symmetric", "skew-symmetric"):
        raise ValueError(f"can't read {header.value!r}")
    bare = lines.where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    pattern = words[3] == "pattern"
    # the sizes are the first line that isn't a comment in the header's file
    sizes = bare.where(F.col("_file") == header["_file"]).agg(F.min_by("value", "_at").alias("sizes"), F.min("_at").alias("at")).first()
    n_rows, n_cols, _ = (int(x) for x in sizes.sizes.split())
    entries = bare.where(F.col("_at") != sizes["at"]).select(F.split(F.trim("value"), r"\s+").alias("p"))
    value = F.lit(1.0) if pattern else F.get("p", F.lit(2)).cast("double")
    df = entries.select((F.get("p", F.lit(0)).cast("long") - 1).alias("row"), (F.get("p", F.lit(1)).cast("long") - 1).alias("col"), value.alias("val"))
    if words[4] != "general":
        sign = -1.0 if words[4] == "skew-symmetric" else 1.0
        df = df.unionByName(df.where("row <> col").select(F.col("col").alias("row"), F.col("row").alias("col"), (F.col("val") * sign).alias("val")))
    return Sparse.of(df, n_rows, n_cols)


def write(a: Sparse, path: str) -> None:
    """A folder of text, one file of which begins with the header; ``read`` takes the folder."""
    n = a.df.count()
    head = a.spark.createDataFrame([(f"%%MatrixMarket matrix coordinate real general\n{a.n_rows} {a.n_cols} {n}",)], "value string")
    lines = a.df.select(F.concat_ws(" ", F.col("row") + 1, F.col("col") + 1, F.col("val")).alias("value"))
    head.coalesce(1).write.text(path)
    lines.write.mode("append").text(path)
