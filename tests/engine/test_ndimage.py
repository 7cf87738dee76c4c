"""The image data source: ranges, columns, filters, slabs and the commit of what was written."""

import gzip
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.model import Geometry
from voxloom.sources import ndimage, nifti


def written(tmp_path, name, array, geo, version=1):
    data = nifti.write_bytes(array, geo, version)
    path = tmp_path / name
    path.write_bytes(gzip.compress(data) if name.endswith(".gz") else data)
    return str(path)


@pytest.fixture(scope="module")
def array():
    return np.random.default_rng(3).integers(-900, 900, (7, 5, 6, 4)).astype(float)


def as_array(rows, shape):
    out = np.full(shape, np.nan)
    for r in rows:
        out[r.x, r.y, r.z, r.t] = r.v
    return out


@pytest.mark.parametrize(("name", "ptype", "version"), [("a.nii", "INT16", 1), ("a.nii.gz", "FLOAT32", 1), ("a.nii", "FLOAT64", 2), ("a.nii", "COMPLEX64", 2)])
def test_many_ranges_are_one_image(spark, tmp_path, array, name, ptype, version):
    path = written(tmp_path, name, array, Geometry(array.shape, ptype=ptype), version)
    one, many = ndimage.images(spark, path), ndimage.images(spark, path, slicebytes=300)
    assert one.rdd.getNumPartitions() == 1
    assert many.rdd.getNumPartitions() > (3 if name.endswith(".nii") else 0)
    for df in (one, many):
        assert np.array_equal(as_array(df.collect(), array.shape), array)
    series = {(r.x, r.y, r.z): r.ts for r in ndimage.images(spark, path, "series", slicebytes=900).collect()}
    assert len(series) == 7 * 5 * 6 and all(np.array_equal(ts, array[k]) for k, ts in series.items())
    old = {(r.x, r.y, r.z): r.ts for r in nifti.read_packed(spark, path).collect()}
    assert old == series


def test_headers_without_pixels(spark, tmp_path, array):
    geo = Geometry(array.shape, spacing=[2, 1.5, 3, 1], origin=[1, 2, 3, 0], ptype="INT16")
    whole = written(tmp_path, "a.nii", array, geo)
    cut = tmp_path / "cut.nii"
    cut.write_bytes(open(whole, "rb").read()[:400])  # pixels are missing: a header is read all the same
    rows = {r.img_id: r for r in ndimage.images(spark, str(tmp_path), "header").collect()}
    assert set(rows) == {"a.nii", "cut.nii"} and rows["cut.nii"].dims == [7, 5, 6, 4] and rows["a.nii"].spacing == [2, 1.5, 3, 1]
    assert ndimage.images(spark, str(tmp_path), "header", "img_id string, ndim int").columns == ["img_id", "ndim"]
    with pytest.raises(Exception, match="bytes of pixels expected"):
        ndimage.images(spark, str(cut)).count()
    # columns that aren't asked for aren't made: no pixel is read
    assert ndimage.images(spark, str(cut), columns="img_id string, x int").count() == array.size


def test_boxes_leave_slabs_out(spark, tmp_path, array):
    path = written(tmp_path, "a.nii", array[..., 0], Geometry(array.shape[:3], ptype="INT16"))
    whole, box = ndimage.images(spark, path, slicebytes=70), ndimage.images(spark, path, slicebytes=70, z="2:2", y="1:2")
    assert {(r.x, r.y, r.z): r.v for r in box.collect()} == {(x, y, 2): array[x, y, 2, 0] for x in range(7) for y in (1, 2)}
    assert whole.rdd.getNumPartitions() == 6 and box.rdd.getNumPartitions() == 1
    assert ndimage.images(spark, path, z="6:9").count() == 0 and ndimage.images(spark, path, z="4:9", x="-3:0").count() == 10
    # a filter on a frame leaves the frame as it was
    assert whole.filter("z = 2").count() == 35 and whole.count() == 210


@pytest.mark.parametrize("suffix", [".nii", ".nii.gz"])
def test_written_by_slabs(spark, tmp_path, array, suffix):
    shapes = {"a": array.shape, "b": (9, 4), "empty": (3, 2, 2), "five": (2, 2, 2, 2, 3)}
    geometries = {k: Geometry(s, np.arange(1, len(s) + 1), ptype="FLOAT64" if k == "a" else "FLOAT32") for k, s in shapes.items()}
    whole = {k: np.zeros(s) if k == "empty" else array if k == "a" else np.arange(np.prod(s), dtype=float).reshape(s) for k, s in shapes.items()}
    rows = []
    for k, a in whole.items():
        if k != "empty":
            space = (*a.shape[:3], 1, 1, 1)[:3]
            rows += [(k, *map(int, i), a.reshape(*space, -1)[i].tolist()) for i in np.ndindex(space)]
    df = spark.createDataFrame(rows, ndimage.SERIES).repartition(7)
    done = ndimage.write_images(df, geometries, str(tmp_path / "out"), 2, suffix, slice_bytes=400)
    names = {r.uri.rpartition("/")[2] for r in done.collect()}
    assert names == {k + suffix for k in shapes} == set(os.listdir(tmp_path / "out"))
    for k, a in whole.items():
        path = str(tmp_path / "out" / (k + suffix))
        expected = nifti.write_bytes(a, geometries[k], 2)
        data = open(path, "rb").read()
        assert (gzip.decompress(data) if suffix.endswith("gz") else data) == expected
    # a read after a write, by ranges
    read = ndimage.images(spark, str(tmp_path / "out" / f"a{suffix}"), slicebytes=500)
    assert np.array_equal(as_array(read.collect(), array.shape), array)


def test_failed_writes_leave_nothing(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, 0, 0, [1.0]), ("a", 9, 0, 0, [1.0])], ndimage.SERIES)
    with pytest.raises(Exception, match="outside of image"):
        ndimage.write_images(df, {"a": Geometry((2, 2, 2))}, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or not os.listdir(tmp_path / "out")


def test_slabs_of_lost_attempts_do_not_count(tmp_path):
    writer = ndimage.SlabWriter({"path": f"file://{tmp_path}/s", "images": "{}"})
    os.makedirs(tmp_path / "s" / "a")
    for name in ("00000000.1", "00000000.2", "00000001.3"):
        (tmp_path / "s" / "a" / name).write_bytes(b"x")
    writer.commit([ndimage.Written(["a/00000000.2"]), None, ndimage.Written(["a/00000001.3"])])
    assert sorted(os.listdir(tmp_path / "s" / "a")) == ["00000000.2", "00000001.3"]
    writer.abort([])
    assert not (tmp_path / "s").exists()
