"""Lines and JSON images by ranges of their files."""

import gzip
import json
import os

import numpy as np
import pytest

from voxloom.model import Geometry
from voxloom.sources import files, textual


def test_lines_are_numbered_over_ranges(spark, tmp_path):
    (tmp_path / "in").mkdir()
    want = [f"line {k} " + "x" * (k % 50) for k in range(3000)]
    for n, (a, b) in enumerate([(0, 10), (10, 2500), (2500, 2500), (2500, 3000)]):
        (tmp_path / "in" / f"part-{n}.txt").write_text("".join(x + "\n" for x in want[a:b]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "4k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = files.lines(spark, f"{tmp_path}/in")
            assert {r.nth: r.value for r in got.collect()} == dict(enumerate(want))
        kept = files.lines(spark, f"{tmp_path}/in", textual.F.col("value").endswith("7 " + "x" * 7))
        assert sorted(r.nth for r in kept.collect()) == list(range(kept.count()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_text_images_skip_comments(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# head\n1 2 3\n\n4 5 6\n# between\n7 8 9\n")
    assert {(r.x, r.y): r.v for r in textual.read_text_image(spark, f"{tmp_path}/a.txt").collect()} == {(i, j): 3.0 * i + j + 1 for i in range(3) for j in range(3)}


@pytest.mark.parametrize("shape", [(7,), (4, 5), (3, 4, 5), (2, 3, 2, 4), (1, 1, 6)])
def test_json_by_lines_and_ranges(spark, tmp_path, shape):
    rng = np.random.default_rng(len(shape))
    images = {"one": rng.normal(size=shape) * 10.0 ** rng.integers(-12, 12, shape), "two": np.arange(np.prod(shape), dtype=float).reshape(shape)}
    images["one"].flat[0] = np.nan
    rows = [(k, *(list(map(int, i)) + [0] * (4 - len(shape))), float(a[i])) for k, a in images.items() for i in np.ndindex(shape) if k == "one" or a[i]]  # a voxel of 0 has no row
    df = spark.createDataFrame(rows, "img_id string, x int, y int, z int, t int, v double").repartition(5)
    geos = {k: Geometry(shape, np.arange(1, len(shape) + 1)) for k in images}
    done = textual.write_json_images(df, geos, str(tmp_path / "out")).collect()
    assert len(done) == 2 and sorted(os.listdir(tmp_path / "out")) == ["one.json", "two.json"]
    for k, a in images.items():
        doc = json.loads((tmp_path / "out" / f"{k}.json").read_text())
        assert np.array_equal(np.array(doc["values"]), a, equal_nan=True) and textual.json_geometry(doc).dims == shape
    for size in (textual.RANGE_BYTES, 23, 7):
        got = {(r.img_id, *[r[c] for c in "xyzt"[: len(shape)]]): r.v for r in textual.read_json_images(spark, str(tmp_path / "out"), size).collect()}
        assert len(got) == 2 * np.prod(shape)
        for k, a in images.items():
            assert all(np.array_equal(got[(f"{k}.json", *i)], a[i], equal_nan=True) for i in np.ndindex(shape))


def test_json_of_others(spark, tmp_path):
    doc = {"values": [[1, -2.5e-3], [3, 4]], "version": 1, "size": [2, 2], "spacing": [1.5, 2]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "b.json.gz").write_bytes(gzip.compress(json.dumps(doc).encode()))
    for size in (5, 1 << 20):
        got = sorted((r.img_id, r.x, r.y, r.v) for r in textual.read_json_images(spark, str(tmp_path), size).collect())
        assert got == [(n, i, j, doc["values"][i][j]) for n in ("a.json", "b.json") for i in range(2) for j in range(2)]
    (tmp_path / "c.json").write_text('{"size": [1]}')
    with pytest.raises(ValueError, match="no values"):
        textual.read_json_images(spark, str(tmp_path / "c.json"))
