"""Driver-contract queries of readers and writers: whole tables written in a format and read back.

Files go to a new folder below the shared checkpoint folder; their SQL says what was written.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Geometry
from ..session import shared_path
from ..sources import files, graphs, ndimage, textual, tiles, tracks
from .image_queries import dims, image
from .registry import query, rounded, table

_VOXELS = "SELECT vec_id AS x, (t.k - 1) // 8 AS y, (t.k - 1) % 8 AS z, CAST(0 AS BIGINT) AS t, round(CAST(embedding[t.k] AS DOUBLE), 6) + 0.0 AS v FROM embeddings, range(1, 65) t(k)"
_AXES = ["x", "y", "z", "t"]


def _series(spark, sf) -> DataFrame:
    return image(spark, sf).select(F.lit("img").alias("img_id"), "x", "y", "z", F.array("v").alias("ts"))


def _geometry(spark, sf) -> Geometry:
    return Geometry((*dims(spark, sf), 1), np.array([2.0, 1.5, 3.0, 1.0]), ptype="FLOAT64")


#: Bytes of pixels of a task: small ones, so that the small tables too are written and read by several.
_SLICE = 1 << 16


def _image_folder(spark, sf, version: int, suffix: str) -> str:
    folder = shared_path(spark)
    ndimage.write_images(_series(spark, sf), {"img": _geometry(spark, sf)}, folder, version, suffix, _SLICE)
    return folder


def _written(contents: DataFrame, spark) -> str:
    folder = shared_path(spark)
    files.save(contents, folder).collect()  # a row a file
    return folder


def _voxels(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(a).cast("long").alias(a) for a in _AXES], rounded("v").alias("v"))


@query(_VOXELS)
def nifti1_round_trip(spark, sf):
    return _voxels(ndimage.images(spark, _image_folder(spark, sf, 1, ".nii.gz"), slicebytes=_SLICE))


@query(_VOXELS)
def nifti2_round_trip(spark, sf):
    return _voxels(ndimage.images(spark, _image_folder(spark, sf, 2, ".nii"), slicebytes=_SLICE))


@query("SELECT max(vec_id) + 1 AS nx, CAST(8 AS BIGINT) AS ny, CAST(8 AS BIGINT) AS nz, 2.0::DOUBLE AS sx, 1.5::DOUBLE AS sy, 3.0::DOUBLE AS sz FROM embeddings")
def nifti_header(spark, sf):
    meta = ndimage.images(spark, _image_folder(spark, sf, 1, ".nii.gz"), "header")
    return meta.select(*[F.get("dims", F.lit(k)).cast("long").alias(f"n{a}") for k, a in enumerate("xyz")], *[F.get("spacing", F.lit(k)).alias(f"s{a}") for k, a in enumerate("xyz")])


@query(_VOXELS)
def json_round_trip(spark, sf):
    voxels = image(spark, sf).select(F.lit("img").alias("img_id"), "x", "y", "z", F.lit(0).alias("t"), "v")
    folder = shared_path(spark)
    textual.write_json_images(voxels, {"img": _geometry(spark, sf)}, folder)
    return _voxels(textual.read_json_images(spark, folder, _SLICE))


_BOX = {"x": "10:199", "y": "2:5", "z": "6:6"}


@query(f"SELECT * FROM ({_VOXELS}) WHERE x BETWEEN 10 AND 199 AND y BETWEEN 2 AND 5 AND z = 6")
def nifti_box(spark, sf):
    """A box of an image: only the slabs that hold a part of it are read."""
    return _voxels(ndimage.images(spark, _image_folder(spark, sf, 2, ".nii"), slicebytes=1 << 12, **_BOX))


@query(f"SELECT * EXCLUDE (t) FROM ({_VOXELS}) WHERE x BETWEEN 100 AND 139 AND y BETWEEN 0 AND 5 AND z BETWEEN 3 AND 7")
def tile_box(spark, sf):
    """A box of an image stored as tiles on a space-filling order."""
    path = shared_path(spark)
    tiles.write_tiles(image(spark, sf), path, ["x", "y", "z"], 8)
    out = tiles.read_box(spark, path, {"x": (100, 139), "y": (0, 5), "z": (3, 7)})
    return out.select(*[F.col(a).cast("long").alias(a) for a in "xyz"], rounded("v").alias("v"))


@query("SELECT vec_id AS x, CAST(t.k - 1 AS BIGINT) AS y, round(CAST(embedding[t.k] AS DOUBLE), 6) + 0.0 AS v FROM embeddings, range(1, 65) t(k)")
def text_image_round_trip(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.array_join(F.transform("embedding", lambda v: v.cast("double").cast("string")), ",").alias("value"))
    folder = shared_path(spark)
    rows.repartitionByRange("vec_id").sortWithinPartitions("vec_id").select("value").write.text(folder)  # files in order of their names hold lines in order
    return textual.read_text_image(spark, folder).select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), rounded("v").alias("v"))


@query("SELECT CAST(p_partkey AS DOUBLE) AS id, CAST(p_size AS DOUBLE) AS size, round(p_retailprice, 4) AS price FROM part")
def number_table_round_trip(spark, sf):
    rows = table(spark, sf, "part").select(F.concat_ws("; ", F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice")).alias("value"))
    folder = shared_path(spark)
    rows.write.text(folder, compression="gzip")
    read = textual.read_numbers(spark, folder)
    return read.select(F.get("values", F.lit(0)).alias("id"), F.get("values", F.lit(1)).alias("size"), rounded(F.get("values", F.lit(2)), 4).alias("price"))


_TRACKS = "SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS pt_idx, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 4) + 0.0 AS x, CAST(event_id % 100 AS DOUBLE) AS y, CAST(event_id % 7 AS DOUBLE) AS z FROM events"


def _tracks(spark, sf, encode, suffix: str) -> DataFrame:
    """A file a user, with one track of the user's events; files are encoded where their rows are."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        points = rows.sort_values("event_id")[["x", "y", "z"]].to_numpy()
        return pd.DataFrame({"name": [f"user-{key[0]}{suffix}"], "content": [encode([points])]})

    rows = table(spark, sf, "events").select("user_id", "event_id", F.col("value").cast("double").alias("x"), (F.col("event_id") % 100).cast("double").alias("y"), (F.col("event_id") % 7).cast("double").alias("z"))
    folder = _written(rows.groupBy("user_id").applyInPandas(run, "name string, content binary"), spark)
    return tracks.read_tracks(spark, folder, Geometry((1, 1, 1)))


@query(f"SELECT pt_idx, x, y, z FROM ({_TRACKS})")
def trackvis_round_trip(spark, sf):
    return _tracks(spark, sf, tracks.encode_trackvis, ".trk").select(F.col("pt_idx").cast("long").alias("pt_idx"), *[rounded(F.col(a).cast("double"), 4).alias(a) for a in "xyz"])


@query(f"SELECT pt_idx, x, y, z FROM ({_TRACKS})")
def dft_round_trip(spark, sf):
    return _tracks(spark, sf, tracks.encode_dft, ".dft").select(F.col("pt_idx").cast("long").alias("pt_idx"), *[rounded(F.col(a).cast("double"), 4).alias(a) for a in "xyz"])


_NATIONS = "SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, round(sum(c_acctbal), 2) AS w FROM customer JOIN supplier ON c_nationkey % 5 = s_nationkey % 5 GROUP BY 1, 2"


def _nations(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("long").alias("src")).agg(F.sum("c_acctbal").alias("a"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("dst")).agg(F.count("*").alias("n"))
    return c.join(s, F.col("src") % 5 == F.col("dst") % 5).select("src", "dst", F.round(F.col("a") * F.col("n"), 2).alias("w"))


@query(_NATIONS)
def edge_list_round_trip(spark, sf):
    folder = shared_path(spark)
    graphs.write_edge_list(_nations(spark, sf), folder)
    return graphs.read_edge_list(spark, folder).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), rounded("w", 2).alias("w"))


def _binary_graph(spark, sf, dense: bool) -> DataFrame:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"name": ["nations.graph"], "content": [graphs.encode_binary(rows[["src", "dst", "w"]].to_numpy(float), [f"nation{k}" for k in range(25)], dense)]})

    folder = _written(_nations(spark, sf).withColumn("g", F.lit(0)).groupBy("g").applyInPandas(run, "name string, content binary"), spark)  # at most 25 x 25 edges
    return graphs.read_graphs(spark, folder).filter("w <> 0").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), rounded("w", 2).alias("w"))


@query(_NATIONS)
def binary_graph_round_trip(spark, sf):
    return _binary_graph(spark, sf, False)


@query(_NATIONS)
def dense_graph_round_trip(spark, sf):
    return _binary_graph(spark, sf, True)
