"""Composed procedures on small simulated data, and the streaming forms."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from voxloom.model import Geometry, from_numpy
from voxloom.operators import neighborhood
from voxloom.plans import pipelines
from voxloom.streaming import series


def test_clean_series(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(128, 2))
    wave = np.sin(2 * np.pi * 5 * np.arange(128) / 128)
    y = wave + 3 * x[:, 0] - x[:, 1]
    packed = spark.createDataFrame([("i", 0, 0, 0, y.tolist())], "img_id string, x int, y int, z int, ts array<double>")
    out = np.array(pipelines.clean_series(packed, x, 1.0, 0.01, 0.2).first().ts)
    assert np.corrcoef(out, wave)[0, 1] > 0.95


def test_group_ica(spark):
    rng = np.random.default_rng(1)
    courses = np.column_stack([np.sign(np.sin(np.arange(60) / 3)), rng.laplace(size=60)])
    maps = np.zeros((2, 200))
    maps[0, :60], maps[1, 90:170] = 1, 1
    y = (courses @ maps + 0.05 * rng.normal(size=(60, 200))).T
    packed = spark.createDataFrame([("r", k, 0, 0, v.tolist()) for k, v in enumerate(y)], "img_id string, x int, y int, z int, ts array<double>")
    found, w = pipelines.group_ica(packed, None, 60, 2)
    rows = found.orderBy("x").collect()
    got = np.array([r["values"] for r in rows])
    match = np.abs(np.corrcoef(got.T, maps)[:2, 2:])
    assert match.max(0).min() > 0.8
    maps_t, found_courses, share = pipelines.group_ica(packed, None, 60, 2, spatial_maps=False)
    assert np.abs(np.corrcoef(found_courses.T, courses.T)[:2, 2:]).max(0).min() > 0.8 and share[0] >= share[1] and maps_t.count() == 200


def test_fibres(spark):
    line = [(0, k, float(k), 2.0, 2.0) for k in range(12)] + [(1, k, 2.0, float(k), 2.0) for k in range(4)]
    tracks = spark.createDataFrame(line, "track_id long, pt_idx int, x double, y double, z double")
    labels = spark.createDataFrame([(1, 2, 2, 7), (10, 2, 2, 9), (5, 8, 2, 4)], "x int, y int, z int, label int")
    geo = Geometry((12, 12, 5))
    out = {(r.l1, r.l2): (r.n, r.length) for r in pipelines.fibre_graph(tracks, labels, geo, 1.5).collect()}
    assert out[7, 9] == (1, 11.0) and (4, 7) not in out and out[7, 7][0] == 2
    mask = spark.createDataFrame([(x, 2, 2, 1.0) for x in range(3, 9)], "x int, y int, z int, v double")
    kept = pipelines.crop_tracks(tracks, mask, geo, 2.0)
    assert sorted(r.pt_idx for r in kept.collect()) == [3, 4, 5, 6, 7, 8]


def test_strip_and_simulate(spark):
    dims = (8, 8, 8)
    ball = pipelines.sphere(spark, dims, (3.5, 3.5, 3.5), 3.0).withColumn("v", F.col("v") * 100.0 + F.pmod(F.xxhash64("x", "y", "z"), F.lit(5)))
    kept = pipelines.skull_strip(ball, dims, 1)
    i, j, k = np.indices(dims) - 3.5
    assert kept.count() == (i * i + j * j + k * k < 9).sum()
    regions = spark.createDataFrame([(0, 0, 0, 1), (1, 0, 0, 2)], "x int, y int, z int, label int")
    wave = pipelines.simulate_series(regions, 20, 1.0, 0.2)
    image = pipelines.paint_regions(regions, wave).collect()
    assert len(image) == 2 and all(len(r.ts) == 20 and np.isfinite(r.ts).all() for r in image)


def test_density_segment(spark):
    a = np.zeros((6, 6, 2))
    a[:3] = 100
    out = pipelines.density_segment(from_numpy(spark, a).select("x", "y", "z", "v"), 20.0, 2.5, 3.0)
    assert out.count() == 72


def test_streams(spark, tmp_path):
    t0 = pd.Timestamp("2024-01-01")
    rows = pd.DataFrame({"ts": [t0 + pd.Timedelta(minutes=10 * k) for k in range(24)], "user": [k % 2 for k in range(24)], "value": np.arange(24.0)})
    df = spark.createDataFrame(rows)
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = series.windowed_reduce(stream, "ts", "user", "value").writeStream.format("memory").queryName("reduced").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.user, r.start): r["sum"] for r in spark.table("reduced").collect()}
    want = {(r.user, r.start): r["sum"] for r in series.windowed_reduce(df, "ts", "user", "value").collect()}
    assert got == want and len(got) == 8
    assert series.sessions(df, "ts", "user", "value", "15 minutes").count() == 24


def test_balloon_stream_equals_batch(spark, tmp_path):
    u = [(0, k, 1.0 if k < 5 else 0.0) for k in range(40)]
    df = spark.createDataFrame(u, "region long, t long, u double")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = series.balloon_stream(stream, 0.1).writeStream.format("memory").queryName("bold").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [r.y for r in spark.table("bold").orderBy("t").collect()]
    one = spark.createDataFrame([([v[2] for v in u],)], "ts array<double>")
    want = one.select(neighborhood.balloon_response(F.col("ts"), 0.1).alias("y")).first().y
    assert np.allclose(got, want)
