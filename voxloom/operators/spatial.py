"""Distance, nearest and interval joins, interpolation and resampling.

Point joins in up to three dimensions use a grid: cells as wide as the radius, an equi-join on
cells, then the exact distance. Points are exploded to the neighbouring cells on one side only.
Where a cell is hot, AQE splits the join's partitions. In more dimensions, and for the nearest
point, a partitioned tree is searched (``operators/tree.py``).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tree
from .blocks import sample

#: Coordinates that are cut into cells at most: more of them multiply the neighbouring cells.
CELL_AXES = 3


def squared_distance(a: Column, b: Column) -> Column:
    """Sum of squared differences of two coordinate arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, d: s + d)


def _cells(p: Column, width: float, axes: int) -> list[Column]:
    return [F.floor(F.get(p, F.lit(k)).cast("double") / F.lit(width)).cast("long") for k in range(axes)]


def within_distance(left: DataFrame, right: DataFrame, radius: float, dims: int, left_p: str = "p", right_p: str = "p", left_id: str = "id", right_id: str = "id") -> DataFrame:
    """(left_id, right_id, dist2) of all pairs with squared distance below radius squared: cells up to CELL_AXES coordinates, a tree beyond."""
    if dims > CELL_AXES:
        return tree.within(tree.build(right, right_id, right_p), left, radius, left_id, left_p)
    a = left.select(F.col(left_id).alias("left_id"), F.col(left_p).alias("lp"), *[c.alias(f"c{k}") for k, c in enumerate(_cells(F.col(left_p), radius, dims))])
    b = right.select(F.col(right_id).alias("right_id"), F.col(right_p).alias("rp"), *[c.alias(f"c{k}") for k, c in enumerate(_cells(F.col(right_p), radius, dims))])
    for k in range(dims):
        b = b.withColumn(f"c{k}", F.explode(F.array(*[F.col(f"c{k}") + d for d in (-1, 0, 1)])))
    met = a.join(b, [f"c{k}" for k in range(dims)])
    return met.select("left_id", "right_id", squared_distance(F.col("lp"), F.col("rp")).alias("dist2")).filter(F.col("dist2") < radius * radius)


def nearest(queries: DataFrame, points: DataFrame, limit: float | None = None, q_id: str = "id", p_id: str = "id", p: str = "p", others_only: bool = False, leaf_points: int = tree.LEAF_POINTS) -> DataFrame:
    """(id, nearest_id, dist2): the nearest point of each query (within ``limit``), smallest id of several."""
    same = others_only and queries is points and q_id == p_id
    return tree.nearest(tree.build(points, p_id, p, leaf_points), queries, q_id, p, others_only, limit=limit, same=same).select("id", "nearest_id", "dist2")


def within_blocked(points: DataFrame, radius: float, p_id: str = "id", p: str = "p", rows: int = tree.LEAF_POINTS) -> DataFrame:
    """(left_id, right_id, dist2) of all pairs left_id < right_id below the radius, over all coordinates; leaves of some ``rows`` points."""
    return tree.within(tree.build(points, p_id, p, rows), points, radius, p_id, p, upwards=True, same=True)


def paint_events(times: DataFrame, events: DataFrame, time: str = "t", onset: str = "onset", duration: str = "duration", value: str = "value", order: str = "row", bucket: float = 60.0) -> DataFrame:
    """times with the value of the last listed event whose closed interval holds the time, else 0.

    An interval is posted under each time bucket that it touches, so the range join is an
    equi-join on buckets. Events longer than many buckets want a wider bucket.
    """
    b = lambda c: F.floor(c / F.lit(bucket)).cast("long")
    spans = events.select(onset, (F.col(onset) + F.col(duration)).alias("_off"), F.col(value).alias("_v"), F.col(order).alias("_o"))
    spans = spans.withColumn("_b", F.explode(F.sequence(b(F.col(onset)), b(F.col("_off")))))
    met = times.withColumn("_b", b(F.col(time))).join(spans.withColumnRenamed(onset, "_on"), "_b", "left").withColumn("_hit", (F.col(time) >= F.col("_on")) & (F.col(time) <= F.col("_off")))
    keys = times.columns
    return met.groupBy(*keys).agg(F.coalesce(F.max_by("_v", F.when(F.col("_hit"), F.col("_o"))), F.lit(0.0)).alias("painted"))


# ---- interpolation -----------------------------------------------------------------


def _lanczos_weight(d: np.ndarray) -> np.ndarray:
    return np.where(np.abs(d) < 2, np.sinc(d) * np.sinc(d / 2), 0.0)


def cubic_spline(d: np.ndarray) -> np.ndarray:
    """Cubic B-spline: two pieces that meet at distance 1 and end at 2."""
    d = np.abs(d)
    return np.where(d < 1, 2 / 3 - d * d + d**3 / 2, np.clip(2 - d, 0, None) ** 3 / 6)


def cubic_slope(d: np.ndarray) -> np.ndarray:
    a = np.abs(d)
    return np.sign(d) * np.where(a < 1, 1.5 * a * a - 2 * a, -(np.clip(2 - a, 0, None) ** 2) / 2)


#: Voxels read along an axis, from which place on, with which weight of the distance.
_KINDS = {
    "nearest": ([0], lambda u: np.floor(u + 0.5), None),
    "linear": ([0, 1], np.floor, lambda d: np.clip(1 - np.abs(d), 0, None)),
    "lanczos": ([-2, -1, 0, 1, 2], lambda u: np.floor(u + 0.5), _lanczos_weight),
    "bspline": ([-1, 0, 1, 2], np.floor, cubic_spline),
}


def interpolate(samples: DataFrame, image: DataFrame, at: dict[str, Column], dims: dict[str, int], keys: list[str], kind: str = "linear", boundary: str = "clamp", value: str = "v", slope: str | None = None) -> DataFrame:
    """Image values at continuous index columns of samples (named by keys).

    nearest rounds; linear weighs 2^n corners; lanczos weighs (2r+1)^n with r = 2, not
    renormalised; bspline takes the image as the knots of cubic B-splines and weighs 4^n of them.
    With slope, an axis, bspline gives the derivative along it. Places beyond the image: "clamp"
    reads the border, "wrap" the other side, "zero" nothing.
    """
    if slope and kind != "bspline":
        raise ValueError("only bspline has a derivative")
    steps, place, weight = _KINDS[kind]
    return sample(samples, image, at, dims, keys, steps, place, [cubic_slope if a == slope else weight for a in at], boundary, value)


def resample_to(image: DataFrame, source, target, kind: str = "linear", boundary: str = "zero") -> DataFrame:
    """An image (x, y, z) on another geometry's grid, through physical space."""
    from ..model import grid

    axes = ["x", "y", "z"][: target.ndim]
    cells = grid(image.sparkSession, target.dims).select(*axes)
    index = source.to_index(target.to_point([F.col(a).cast("double") for a in axes]))
    return interpolate(cells, image, dict(zip(axes, index, strict=True)), dict(zip(axes, source.dims, strict=False)), axes, kind, boundary)


def fill_linear(image: DataFrame, axes: list[str], dims: list[int], value: str = "v") -> DataFrame:
    """The image with each voxel's flat place, the last axis running fastest."""
    flat = reduce(lambda f, p: f * F.lit(p[1]) + F.col(p[0]).cast("long"), zip(axes, dims, strict=True), F.lit(0).cast("long"))
    return image.withColumn(value, flat.cast("double"))


def fill_zero(image: DataFrame, value: str = "v") -> DataFrame:
    return image.withColumn(value, F.lit(0.0))


def label_points(labels: DataFrame, geo, value: str = "v") -> DataFrame:
    """(label, p) of each labelled voxel in physical space, ready for ``within_distance``."""
    axes = ["x", "y", "z"][: geo.ndim]
    at = geo.to_point([F.col(a).cast("double") for a in axes])
    return labels.filter(F.col(value) != 0).select(F.col(value).cast("long").alias("label"), F.array(*at).alias("p"))


def self_pairs(sets: DataFrame, by: str, item: str) -> DataFrame:
    """Unordered pairs (l1 <= l2) of the distinct items of each group, with the number of groups.

    A group's items are few labels (regions that one track touches), not rows of the input.
    """
    own = sets.select(by, item).distinct()
    a, b = own.select(by, F.col(item).alias("l1")), own.select(by, F.col(item).alias("l2"))
    return a.join(b, by).filter("l1 <= l2").groupBy("l1", "l2").agg(F.count("*").alias("n"))


def overlap_ratio(spark, a, b) -> float:
    """Share of voxel centres of geometry a that lie inside the field of view of b."""
    from ..model import grid

    axes = ["x", "y", "z"][: a.ndim]
    inside = b.point_inside(a.to_point([F.col(c).cast("double") for c in axes]))
    return grid(spark, a.dims).agg(F.avg(inside.cast("double"))).first()[0]


# ---- sets --------------------------------------------------------------------------


def concat(images: list[DataFrame], axis: str, sizes: list[int]) -> DataFrame:
    """Images one behind the other along an existing axis."""
    parts, at = [], 0
    for image, size in zip(images, sizes, strict=True):
        parts.append(image.withColumn(axis, F.col(axis) + F.lit(at)))
        at += size
    return reduce(DataFrame.unionByName, parts)


def stack(images: list[DataFrame], axis: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [image.withColumn(axis, F.lit(k)) for k, image in enumerate(images)])


def mask_intersect(a: DataFrame, b: DataFrame, axes: list[str], value: str = "v") -> DataFrame:
    """Coordinates where both are non-zero."""
    return a.filter(F.col(value) != 0).select(*axes).intersect(b.filter(F.col(value) != 0).select(*axes))


def select_volumes(df: DataFrame, names: DataFrame, pattern: str, on: str = "t", name: str = "name") -> DataFrame:
    """Volumes whose name matches the pattern whole, renumbered from 0 in order.

    names has one row a volume; it's as long as the list of volumes.
    """
    kept = names.filter(F.col(name).rlike(f"^(?:{pattern})$")).select(on, (F.row_number().over(Window.orderBy(on)) - 1).alias("_new"))
    return df.join(kept, on).drop(on).withColumnRenamed("_new", on)


def copy_region(df: DataFrame, start: dict[str, int], size: dict[str, int], to: dict[str, int] | None = None) -> DataFrame:
    """The box at start, moved to ``to`` (the origin by default); the filter reaches the scan."""
    inside = reduce(lambda x, y: x & y, [F.col(a).between(start[a], start[a] + size[a] - 1) for a in start])
    out = df.filter(inside)
    for a in start:
        out = out.withColumn(a, F.col(a) - F.lit(start[a] - (to or {}).get(a, 0)))
    return out
