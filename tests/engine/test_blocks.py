"""Operators on blocks with a halo against numpy on the whole array, with blocks far smaller than the image."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.model import Geometry, from_numpy, to_numpy
from voxloom.operators import blocks, geometry, neighborhood, spatial, spectral

AXES = ["x", "y", "z"]
DIMS = (7, 5, 4)


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_VOXELS", 27)
    monkeypatch.setattr(blocks, "BLOCK_SAMPLES", 4)


@pytest.fixture(scope="module")
def array():
    return np.random.default_rng(5).normal(size=DIMS)


def cubes(a, r=1):
    p = np.pad(a, r, mode="edge")
    return np.stack([p[tuple(slice(r + k, r + k + n) for k, n in zip(o, a.shape, strict=True))] for o in itertools.product(range(-r, r + 1), repeat=3)])


def test_median_and_erosion(spark, array):
    df = from_numpy(spark, array)
    assert np.array_equal(to_numpy(neighborhood.median_filter_nd(df, AXES, list(DIMS)), DIMS), np.sort(cubes(array), 0)[13])
    mask = (array > -1.2).astype(float)
    eroded = to_numpy(neighborhood.erode(from_numpy(spark, mask), AXES, list(DIMS), 2, block=True), DIMS)
    assert np.array_equal(eroded, cubes(mask, 2).min(0))


def test_missing_and_null_voxels_count_as_zero(spark, array):
    df = from_numpy(spark, np.abs(array) + 1)
    gaps = df.filter("not (x = 3 and y = 2 and z = 1)").withColumn("v", F.when(F.expr("not (x = 0 and y = 0 and z = 0)"), F.col("v")))
    full = np.abs(array) + 1
    full[3, 2, 1] = full[0, 0, 0] = 0
    rows = neighborhood.erode(gaps, AXES, list(DIMS), 1, block=True)
    assert rows.count() == array.size - 1
    want = np.where(cubes(full).min(0) > 0, full, 0)
    assert all(np.isclose(r.v, want[r.x, r.y, r.z]) for r in rows.collect())


def test_each_keep_value_is_an_image(spark, array):
    both = from_numpy(spark, array).withColumn("t", F.lit(0)).unionByName(from_numpy(spark, -array).withColumn("t", F.lit(1)))
    out = neighborhood.median_filter_nd(both, AXES, list(DIMS), keep=["t"])
    want = np.sort(cubes(array), 0)[13]
    assert np.array_equal(to_numpy(out.filter("t = 0"), DIMS), want)
    assert np.array_equal(to_numpy(out.filter("t = 1"), DIMS), -want)


def brute(a, at, boundary, steps, place, weight):
    total = 0.0
    for o in itertools.product(steps, repeat=3):
        p = [int(place(u)) + k for u, k in zip(at, o, strict=True)]
        w = np.prod([weight(u - k) for u, k in zip(at, p, strict=True)])
        if boundary == "wrap":
            total += w * a[tuple(k % n for k, n in zip(p, a.shape, strict=True))]
        elif boundary == "clamp":
            total += w * a[tuple(min(max(k, 0), n - 1) for k, n in zip(p, a.shape, strict=True))]
        elif all(0 <= k < n for k, n in zip(p, a.shape, strict=True)):
            total += w * a[tuple(p)]
    return total


def cubic(d):
    d = abs(d)
    return 2 / 3 - d * d + d**3 / 2 if d < 1 else max(2 - d, 0) ** 3 / 6


@pytest.mark.parametrize("boundary", ["clamp", "wrap", "zero"])
def test_splines_and_hot_blocks(spark, array, boundary):
    at = np.random.default_rng(6).uniform(-3, 9, (40, 3))
    at[20:] = [1.25, 2.5, 0.75]  # half the samples read one place
    rows = [(k, *map(float, u)) for k, u in enumerate(at)] + [(40, None, 1.0, 1.0), (41, float("nan"), 1.0, 1.0), (42, float("inf"), 1.0, 1.0)]
    samples = spark.createDataFrame(rows, "n int, a double, b double, c double")
    out = spatial.interpolate(samples, from_numpy(spark, array), dict(zip(AXES, map(F.col, "abc"), strict=True)), dict(zip(AXES, DIMS, strict=True)), ["n"], "bspline", boundary)
    got = {r.n: r.v for r in out.collect()}
    assert set(got) == set(range(40))
    for k, u in enumerate(at):
        assert got[k] == pytest.approx(brute(array, u, boundary, range(-1, 3), np.floor, cubic), abs=1e-9)


def test_spline_of_knots_is_a_partition_of_one(spark):
    knots = spark.createDataFrame([(i, j, 2.0) for i in range(-1, 6) for j in range(-1, 5)], "x int, y int, c double")
    cells = spark.createDataFrame([(i, j) for i in range(9) for j in range(7)], "x int, y int")
    assert [r.v for r in geometry.spline_reconstruct(knots, cells, 2.5, ["x", "y"]).collect()] == pytest.approx([2.0] * 63)
    assert geometry.spline_reconstruct(knots.limit(0), cells, 2.5, ["x", "y"]).agg(F.sum("v")).first()[0] == 0


def test_empty(spark, array):
    none = from_numpy(spark, array).limit(0)
    assert neighborhood.median_filter_nd(none, AXES, list(DIMS)).count() == 0
    samples = spark.createDataFrame([(1, 0.5)], "n int, a double")
    at = {"x": F.col("a"), "y": F.lit(1.0), "z": F.lit(1.0)}
    assert [tuple(r) for r in spatial.interpolate(samples, none, at, dict(zip(AXES, DIMS, strict=True)), ["n"]).collect()] == [(1, 0.0)]
    assert spatial.interpolate(samples.limit(0), from_numpy(spark, array), at, dict(zip(AXES, DIMS, strict=True)), ["n"]).count() == 0


def test_bias_inputs(spark):
    image = np.full((8, 8, 8), 3.0)
    mask = np.zeros((8, 8, 8))
    mask[2:6, 2:6, 2:6] = 1
    down, inside = geometry.bias_inputs(from_numpy(spark, image), from_numpy(spark, mask), Geometry((8, 8, 8)), 2.0)
    assert np.abs(to_numpy(down, (4, 4, 4))).max() < 1e-9  # an even image is 0 after the logarithm
    assert np.array_equal(to_numpy(inside, (4, 4, 4)), mask[::2, ::2, ::2])


def test_scale_band(spark, array):
    df = from_numpy(spark, array)
    spacing = dict.fromkeys(AXES, 1.0)
    band = to_numpy(spectral.scale_band(df, spacing, 0.5, 1.5, 1.0), DIMS)
    fine, coarse = (to_numpy(spectral.smooth_downsample(df, spacing, s, 1.0), DIMS) for s in (0.5, 1.5))
    assert np.allclose(band, fine - coarse)
    even = spectral.scale_band(from_numpy(spark, np.full(DIMS, 4.0)), spacing, 0.5, 1.5, 1.0)
    assert np.abs(to_numpy(even, DIMS)).max() < 1e-9
