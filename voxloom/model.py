"""The column model: long voxels, packed series, image metadata, points, graphs, tracks.

Long: (img_id, x, y, z, t, v). Packed: (img_id, x, y, z, ts array<double>), the form for
series work, since a voxel's series is one row and needs no shuffle. Metadata is one row an
image and small, so it is joined by broadcast or folded into expressions on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AXES = ("x", "y", "z", "t")

#: Pixel types and the Spark type that holds every value of each.
PIXEL_TYPES = {
    "UINT8": "smallint", "INT8": "tinyint", "UINT16": "int", "INT16": "smallint", "UINT32": "bigint", "INT32": "int",
    "UINT64": "decimal(20,0)", "INT64": "bigint", "FLOAT32": "float", "FLOAT64": "double", "FLOAT128": "double",
    "COMPLEX64": "struct<re:double,im:double>", "COMPLEX128": "struct<re:double,im:double>", "COMPLEX256": "struct<re:double,im:double>",
    "RGB24": "struct<r:smallint,g:smallint,b:smallint>", "RGBA32": "struct<r:smallint,g:smallint,b:smallint,a:smallint>",
}

VOXELS = T.StructType([T.StructField("img_id", T.StringType()), *[T.StructField(a, T.IntegerType()) for a in AXES], T.StructField("v", T.DoubleType())])
META = T.StructType(
    [
        T.StructField("img_id", T.StringType()),
        T.StructField("ndim", T.IntegerType()),
        T.StructField("dims", T.ArrayType(T.IntegerType())),
        T.StructField("ptype", T.StringType()),
        T.StructField("spacing", T.ArrayType(T.DoubleType())),
        T.StructField("origin", T.ArrayType(T.DoubleType())),
        T.StructField("direction", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("units", T.ArrayType(T.StringType())),
        T.StructField("slice_order", T.StringType()),
        T.StructField("slice_duration", T.DoubleType()),
    ]
)


@dataclass
class Geometry:
    """Dimensions and placement of an image; expressions over it fold into the plan."""

    dims: tuple[int, ...]
    spacing: np.ndarray = None
    origin: np.ndarray = None
    direction: np.ndarray = None
    ptype: str = "FLOAT64"
    units: tuple[str, ...] = field(default=())
    slice_order: str = "UNKNOWN"
    slice_duration: float = 0.0

    def __post_init__(self):
        n = len(self.dims)
        self.spacing = np.ones(n) if self.spacing is None else np.asarray(self.spacing, float)
        self.origin = np.zeros(n) if self.origin is None else np.asarray(self.origin, float)
        self.direction = np.eye(n) if self.direction is None else np.asarray(self.direction, float)

    @property
    def ndim(self) -> int:
        return len(self.dims)

    def to_point(self, index: Sequence[Column]) -> list[Column]:
        """Physical point of an index: origin + direction · (spacing ∘ index)."""
        n = len(index)
        return [self.orient([index[k] * F.lit(float(self.spacing[k])) for k in range(n)])[r] + F.lit(float(self.origin[r])) for r in range(n)]

    def to_index(self, point: Sequence[Column]) -> list[Column]:
        n = len(point)
        shifted = [point[k] - F.lit(float(self.origin[k])) for k in range(n)]
        return [c / F.lit(float(self.spacing[k])) for k, c in enumerate(self.disorient(shifted))]

    def _apply(self, m: np.ndarray, v: Sequence[Column]) -> list[Column]:
        return [sum((v[c] * F.lit(float(m[r, c])) for c in range(1, len(v))), v[0] * F.lit(float(m[r, 0]))) for r in range(len(v))]

    def orient(self, vector: Sequence[Column]) -> list[Column]:
        return self._apply(self.direction, vector)

    def disorient(self, vector: Sequence[Column]) -> list[Column]:
        n = len(vector)
        return self._apply(np.linalg.inv(self.direction[:n, :n]), vector)

    def index_inside(self, index: Sequence[Column]) -> Column:
        inside = F.lit(True)
        for k, c in enumerate(index):
            inside = inside & (c >= F.lit(-0.5)) & (c <= F.lit(self.dims[k] - 0.5))
        return inside

    def point_inside(self, point: Sequence[Column]) -> Column:
        return self.index_inside(self.to_index(point))

    def matches(self, other: "Geometry", check_dim: bool = True, check_size: bool = False, tolerance: float = 0.01) -> bool:
        """Same orientation: squared differences of spacing, origin and direction within tolerance."""
        if check_dim and self.ndim != other.ndim or check_size and self.dims != other.dims:
            return False
        n = min(self.ndim, other.ndim)
        parts = (self.spacing[:n] - other.spacing[:n], self.origin[:n] - other.origin[:n], self.direction[:n, :n] - other.direction[:n, :n])
        return all(float((d**2).sum()) <= tolerance for d in parts)

    def is_isotropic(self, only_3d: bool = True, tolerance: float = 0.01) -> bool:
        s = self.spacing[:3] if only_3d else self.spacing
        return float(s.max() - s.min()) <= tolerance

    def slice_times(self, start: int, end: int) -> dict[int, float]:
        """Acquisition time of each slice by the named order."""
        n = end - start + 1
        order = list(range(start, end + 1))
        named = {"SEQ": order, "RSEQ": order[::-1], "ALT": order[::2] + order[1::2], "RALT": order[::-1][::2] + order[::-1][1::2], "ALT_SHFT": order[1::2] + order[::2], "RALT_SHFT": order[::-1][1::2] + order[::-1][::2]}
        return {s: k * self.slice_duration for k, s in enumerate(named.get(self.slice_order, order))} if n > 0 else {}

    def row(self, img_id: str) -> tuple:
        return (img_id, self.ndim, list(map(int, self.dims)), self.ptype, self.spacing.tolist(), self.origin.tolist(), self.direction.tolist(), list(self.units), self.slice_order, self.slice_duration)

    @classmethod
    def from_row(cls, row) -> "Geometry":
        return cls(tuple(row.dims), row.spacing, row.origin, np.array(row.direction), row.ptype, tuple(row.units or ()), row.slice_order, row.slice_duration)


def grid(spark: SparkSession, dims: Sequence[int], img_id: str = "img") -> DataFrame:
    """All voxels of a shape, last dimension fastest, with flat position ``pos``; no value yet."""
    dims = list(dims) + [1] * (4 - len(dims))
    out = spark.range(int(np.prod(dims))).withColumnRenamed("id", "pos")
    stride = 1
    columns = {}
    for axis, n in list(zip(AXES, dims, strict=True))[::-1]:
        columns[axis] = F.pmod(F.floor(F.col("pos") / F.lit(stride)), F.lit(n)).cast("int")
        stride *= n
    return out.select(F.lit(img_id).alias("img_id"), *[columns[a].alias(a) for a in AXES], "pos")


#: Voxels that may be gathered on the driver (1 GB as doubles).
MOST_VOXELS = 1 << 27


def from_numpy(spark: SparkSession, array: np.ndarray, img_id: str = "img") -> DataFrame:
    """A small array as long voxels (fixtures and results of driver-side steps)."""
    import pandas as pd

    a = np.asarray(array, float)
    index = np.indices(a.shape).reshape(a.ndim, -1)
    data = {"img_id": img_id, **{ax: (index[k] if k < a.ndim else 0) for k, ax in enumerate(AXES)}, "v": a.ravel()}
    return spark.createDataFrame(pd.DataFrame(data, columns=VOXELS.names), VOXELS)


def to_numpy(voxels: DataFrame, dims: Sequence[int], value: str = "v") -> np.ndarray:
    """A small image back as an array (tests, driver-side steps); an error beyond MOST_VOXELS."""
    if np.prod(dims, dtype=float) > MOST_VOXELS:
        raise ValueError(f"an image of {tuple(dims)} is too large for the driver")
    out = np.zeros(dims)
    rows = voxels.select(*AXES[: len(dims)], value).toPandas()
    out[tuple(rows[a].to_numpy() for a in AXES[: len(dims)])] = rows[value].to_numpy(float)
    return out


def pack(voxels: DataFrame, value: str = "v") -> DataFrame:
    """Long to packed: one row a voxel, the series in order of t."""
    series = F.transform(F.sort_array(F.collect_list(F.struct("t", F.col(value).alias("v")))), lambda s: s["v"])
    return voxels.groupBy("img_id", "x", "y", "z").agg(series.alias("ts"))


def unpack(packed: DataFrame) -> DataFrame:
    return packed.select("img_id", "x", "y", "z", F.posexplode("ts").alias("t", "v"))
