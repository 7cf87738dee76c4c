"""Images stored as tiles along a space-filling order, so that a box reads few pages.

Voxels are sorted by the Morton number of their tile (the bits of the tile's coordinates, interleaved) and
written as Parquet with pages of about a tile. Tiles that are close in space are close in the files, so
the bounds that Parquet keeps of x, y and z for each page and row group leave most of them out when a box
is asked for: the filters reach the scan, and nothing else is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Voxels along an edge of a tile, and tiles of a row group.
EDGE, GROUP = 16, 64


def _spread(c: Column, axes: int) -> Column:
    """The low bits of a number, axes - 1 zeros between them."""
    bits = 63 // axes
    return reduce(lambda out, k: out.bitwiseOR(F.shiftleft(F.shiftright(c, k).bitwiseAND(F.lit(1).cast("long")), k * axes)), range(1, bits), c.bitwiseAND(F.lit(1).cast("long")))


def morton(places: list[Column]) -> Column:
    """Place on the space-filling order of whole coordinates below 2 ** (63 // number of axes)."""
    parts = [F.shiftleft(_spread(p.cast("long"), len(places)), k) for k, p in enumerate(places)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def write_tiles(voxels: DataFrame, path: str, axes: list[str], edge: int = EDGE, mode: str = "error") -> None:
    """Store an image, all its columns, in the order of its tiles; one shuffle by ranges of tiles."""
    tile = morton([F.floor(F.col(a) / edge) for a in axes])
    size = edge ** len(axes)
    rows = voxels.withColumn("_tile", tile).repartitionByRange(F.col("_tile")).sortWithinPartitions("_tile", *axes)
    writer = rows.drop("_tile").write.mode(mode).option("parquet.page.row.count.limit", str(size)).option("parquet.block.row.count.limit", str(size * GROUP))
    writer.parquet(path)


def read_box(spark: SparkSession, path: str, box: dict[str, tuple[int, int]]) -> DataFrame:
    """The voxels whose coordinates lie within the box (first and last of each axis)."""
    inside = [F.col(a).between(low, high) for a, (low, high) in box.items()]
    return spark.read.parquet(path).filter(reduce(lambda a, b: a & b, inside))
