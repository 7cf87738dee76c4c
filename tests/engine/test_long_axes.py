"""Images whose first axis is longer than a 16-bit dimension."""

import numpy as np
import pytest

from voxloom.model import Geometry
from voxloom.sources import ndimage, nifti


def test_nifti1_header_of_a_long_axis():
    geo = Geometry((102_564, 8, 8, 1), np.array([2.0, 1.5, 3.0, 1.0]), ptype="FLOAT64")
    head = nifti.read_header(nifti.header_bytes(geo, 1))
    assert nifti.geometry(head).dims == geo.dims
    assert head["dim"][1] == -1 and head["glmin"] == 102_564
    short = nifti.read_header(nifti.header_bytes(Geometry((32_767, 2)), 1))
    assert short["dim"][1] == 32_767 and short["glmin"] == 0
    with pytest.raises(ValueError):
        nifti.header_bytes(Geometry((2, 40_000)), 1)


@pytest.mark.parametrize("suffix", [".nii", ".nii.gz"])
def test_nifti1_image_of_a_long_axis(spark, tmp_path, suffix):
    n = 40_000
    geo = Geometry((n, 2, 2, 1), np.array([2.0, 1.5, 3.0, 1.0]), ptype="FLOAT64")
    cells = [(0, 0, 0), (32_767, 1, 0), (32_768, 0, 1), (n - 1, 1, 1)]
    rows = spark.createDataFrame([("img", *c, [k + 1.5]) for k, c in enumerate(cells)], "img_id string, x int, y int, z int, ts array<double>")
    ndimage.write_images(rows, {"img": geo}, str(tmp_path), 1, suffix, 1 << 16)
    read = ndimage.images(spark, str(tmp_path), slicebytes=1 << 16)
    assert read.count() == 4 * n
    assert {(r.x, r.y, r.z): r.v for r in read.filter("v <> 0").collect()} == {c: k + 1.5 for k, c in enumerate(cells)}
    assert ndimage.images(spark, str(tmp_path), "header").first().dims == [n, 2, 2, 1]


def test_images_are_not_compressed_at_the_slowest_level(spark, tmp_path):
    rows = spark.createDataFrame([("img", 0, 0, 0, [1.0])], "img_id string, x int, y int, z int, ts array<double>")
    geo = Geometry((4, 2, 2, 1), np.array([2.0, 1.5, 3.0, 1.0]), ptype="FLOAT64")
    ndimage.write_images(rows, {"img": geo}, str(tmp_path), 1, ".nii.gz")
    told = (tmp_path / "img.nii.gz").read_bytes()
    assert told[:2] == b"\x1f\x8b" and told[8] != 2  # 2: level 9
    assert ndimage.images(spark, str(tmp_path), "header").first().dims == [4, 2, 2, 1]
