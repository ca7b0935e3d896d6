"""Spatial pairwise encoding: a volume's neighbour values as a sparse matrix.

Voxels of a volume (C, *S) are numbered row-major. For an offset o the entry at (voxel, voxel - o) is values[o, voxel],
where both voxels lie inside. Offsets are few and known to the driver; the voxels are a range, and the bounds are a
condition on their coordinates, so the structure is one map over range x offsets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frames import Sparse, grid, index

RELATIONS = ("indep", "intra", "inter")


def lattice(radius: float, dims: int) -> list[tuple[int, ...]]:
    """Integer points within the radius, without the origin, in order."""
    span = range(-math.floor(radius), math.floor(radius) + 1)
    return [p for p in product(span, repeat=dims) if any(p) and sum(x * x for x in p) <= radius * radius + 1e-12]


def _sign(offset: tuple[int, ...]) -> int:
    first = next((x for x in offset if x), 0)
    return (first > 0) - (first < 0)


def offsets(radius: float, dims: int, upper: bool | None = None, channels: int = 1, relation: str = "indep", diag: bool = False) -> list[tuple[int, ...]]:
    """Offsets (c, *s) in order. ``upper`` False keeps those whose first part is positive, so rows exceed columns; True the others.

    Channels meet at one voxel with ``intra``, and at neighbours too with ``inter``; their offset is positive always, so
    they only couple below the diagonal.
    """
    if radius < 1:
        raise ValueError("the radius is 1 at least")
    if relation not in RELATIONS:
        raise ValueError(f"no relation {relation!r}; there are {RELATIONS}")
    if channels == 1 and relation != "indep":
        raise ValueError("one channel has no relation to others")
    near = lattice(radius, dims)
    found = [(0, *p) for p in near]
    if relation != "indep":
        at = [(0,) * dims] + (near if relation == "inter" else [])
        found += [(c, *p) for c in range(1, channels) for p in at]
    if upper is not None:
        found = [o for o in found if (_sign(o) < 0) == upper]
    found.sort(key=lambda o: (100 * o[0] * o[0] + sum(x * x for x in o[1:]), tuple(map(abs, o)), tuple(x >= 0 for x in o)))
    return ([(0,) * (dims + 1)] if diag else []) + found


def trim(offset: Column, coordinate: Column, size: Column) -> Column:
    """Whether a coordinate stays inside after going back by the offset: k > 0 drops the first k, k < 0 the last ones."""
    return (coordinate - offset >= 0) & (coordinate - offset < size)


@dataclass(frozen=True)
class PairwiseEncoder:
    """The structure for one volume shape (C, *S), and matrices from values on it."""

    radius: float
    shape: tuple[int, ...]
    diag: bool = False
    upper: bool | None = None
    relation: str = "indep"

    def __post_init__(self) -> None:
        if len(self.shape) < 2 or min(self.shape) < 1:
            raise ValueError(f"a volume has channels and a dimension at least, not {self.shape}")
        self.offsets  # noqa: B018  raises if the other values don't fit

    @property
    def offsets(self) -> list[tuple[int, ...]]:
        return offsets(self.radius, len(self.shape) - 1, self.upper, self.shape[0], self.relation, self.diag)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    def structure(self, spark: SparkSession) -> DataFrame:
        """(offset_id, offset, row, col) of every entry."""
        strides = [math.prod(self.shape[k + 1 :]) for k in range(len(self.shape))]
        held = [(k, list(o), sum(x * s for x, s in zip(o, strides, strict=True))) for k, o in enumerate(self.offsets)]
        every = F.array(*(F.struct(F.lit(k).alias("offset_id"), F.array(*map(F.lit, o)).alias("offset"), F.lit(step).cast("long").alias("step")) for k, o, step in held))
        voxels = index(spark, self.size, "row")
        spot = [F.floor(F.col("row") / s).cast("long") % n for s, n in zip(strides, self.shape, strict=True)]
        met = voxels.select("row", *(c.alias(f"_{k}") for k, c in enumerate(spot)), F.inline(every))
        inside = F.lit(True)
        for k, n in enumerate(self.shape):
            inside = inside & trim(F.get("offset", F.lit(k)), F.col(f"_{k}"), F.lit(n))
        return met.where(inside).select("offset_id", "offset", "row", (F.col("row") - F.col("step")).alias("col"))

    def encode(self, values: DataFrame, n_batch: int = 1) -> Sparse:
        """The matrix from (batch, offset_id, row, val), row being the voxel's number; values outside are dropped."""
        values = values if "batch" in values.columns else values.withColumn("batch", F.lit(0).cast("long"))
        met = self.structure(values.sparkSession).join(values, ["offset_id", "row"])
        return Sparse.of(met.select("batch", "row", "col", "val"), self.size, self.size, n_batch)

    def encode_vjp(self, g: Sparse) -> DataFrame:
        """(batch, offset_id, row, val): the gradient of every value; 0 for those outside of the volume."""
        spark = g.spark
        every = grid(spark, batch=g.n_batch, offset_id=len(self.offsets), row=self.size).withColumn("offset_id", F.col("offset_id").cast("int"))
        met = self.structure(spark).join(g.df, ["row", "col"]).select("batch", "offset_id", "row", "val")
        return every.join(met, ["batch", "offset_id", "row"], "left").select("batch", "offset_id", "row", F.coalesce("val", F.lit(0.0)).alias("val"))


def voxel_values(volume: DataFrame, shape: tuple[int, ...]) -> DataFrame:
    """(batch, offset_id, row, val) from a long volume (batch, offset_id, c, s1, ..., val)."""
    strides = [math.prod(shape[k + 1 :]) for k in range(len(shape))]
    names = ["c", *(f"s{k}" for k in range(1, len(shape)))]
    row = sum((F.col(n) * s for n, s in zip(names, strides, strict=True)), F.lit(0))
    return volume.select("batch", F.col("offset_id").cast("int").alias("offset_id"), row.cast("long").alias("row"), "val")
