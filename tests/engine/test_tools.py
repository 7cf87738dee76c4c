"""Image tools and plots."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.functions.plot import Plot, ticks
from voxloom.model import Geometry, from_numpy, to_numpy
from voxloom.operators import geometry
from voxloom.plans import tools
from voxloom.sources import nifti

AXES = ["x", "y", "z"]


def test_convert_and_read(spark, tmp_path):
    a = np.random.default_rng(0).integers(0, 50, (3, 4, 2)).astype(float)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.nii").write_bytes(nifti.write_bytes(a, Geometry(a.shape, [2, 2, 3], ptype="INT16")))
    tools.convert(spark, f"{tmp_path}/in", f"{tmp_path}/out", 2, ".nii.gz", "FLOAT32").collect()
    head = nifti.read_header(gzip.decompress((tmp_path / "out/a.nii.gz").read_bytes()))
    assert head["version"] == 2 and nifti.geometry(head).ptype == "FLOAT32"
    assert np.array_equal(to_numpy(tools.read_any(spark, f"{tmp_path}/out/a.nii.gz"), a.shape), a)
    with pytest.raises(ValueError):
        tools.read_any(spark, "x.png")


def test_compare_math_and_noise(spark):
    a = np.random.default_rng(1).normal(size=(8, 8, 8))
    df = from_numpy(spark, a).select(*AXES, "v")
    one = tools.compare(df, df.withColumn("v", F.col("v") * 2 + 1)).first()
    assert abs(one.corr - 1) < 1e-9 and one.mi > 1
    geo = Geometry(a.shape)
    out = to_numpy(tools.math_images({"a": df, "b": df}, {"a": geo, "b": geo}, "a * 2 - b"), a.shape)
    assert np.allclose(out, a)
    noisy = to_numpy(tools.add_gaussian(df, snr=10.0), a.shape)
    assert 0 < (noisy - a).std() < 0.3


def test_smooth_and_resample(spark):
    a = np.zeros((9, 9, 9))
    a[4, 4, 4] = 1
    df = from_numpy(spark, a).select(*AXES, "v")
    s = to_numpy(tools.smooth(df, Geometry(a.shape), 2.0), a.shape)
    assert abs(s.sum() - 1) < 0.02 and s.argmax() == a.argmax() and np.allclose(s, s[::-1])
    wave = np.cos(2 * np.pi * np.arange(8) / 8)[:, None, None] * np.ones((8, 4, 4))
    big, geo = tools.resample(from_numpy(spark, wave).select(*AXES, "v"), Geometry(wave.shape), (0.5, 1.0, 1.0))
    assert geo.dims == (16, 4, 4)
    assert np.allclose(to_numpy(big, geo.dims), np.cos(2 * np.pi * np.arange(16) / 16)[:, None, None] * np.ones((16, 4, 4)))


def test_orientation():
    a, b = Geometry((4, 4, 4), [2, 2, 2], [1, 0, 0]), Geometry((4, 4, 4), [1, 1, 1])
    m = tools.orientation_transform(a, b)
    assert np.allclose(m @ [1, 1, 1, 1], [3, 2, 2, 1])
    assert tools.copy_orientation(b, a).matches(a)


def test_distortion_improves_the_match():
    i, j, k = np.indices((12, 14, 10))
    fixed = np.exp(-((i - 6) ** 2 / 8 + (j - 7) ** 2 / 10 + (k - 5) ** 2 / 6)) * 100
    cells = np.indices(fixed.shape).reshape(3, -1).T.astype(float)
    cells[:, 1] -= 1.0
    moving = geometry.sample(fixed, cells).reshape(fixed.shape)
    _, out = geometry.correct_distortion(fixed, moving, 1, 4, geometry.correlation_metric, rounds=12)
    assert np.corrcoef(fixed.ravel(), out.ravel())[0, 1] > np.corrcoef(fixed.ravel(), moving.ravel())[0, 1]


def test_plots(tmp_path):
    p = Plot().add([1, 3, 2]).add([0, 1], [0, 2]).add_function(np.sin)
    assert p.svg().count("<polyline") == 3
    assert len(p.tga(50, 40)) == 18 + 50 * 40 * 3
    p.write(f"{tmp_path}/a.svg")
    assert ticks(0, 10) == [0, 2, 4, 6, 8, 10] and ticks(1, 1) == [1]
    with pytest.raises(ValueError):
        p.write("a.png")
