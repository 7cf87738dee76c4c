"""Readers and writers: exact round trips."""

import gzip

import numpy as np
import pytest

from voxloom.model import Geometry, from_numpy, to_numpy
from voxloom.operators.geometry import rotation
from voxloom.sources import files, graphs, nifti, textual, tracks


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("ptype", ["INT16", "UINT8", "FLOAT32", "FLOAT64", "INT64"])
def test_nifti_round_trip(version, ptype):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 100, (4, 3, 5, 2)).astype(float)
    d = np.eye(4)
    d[:3, :3] = rotation(0.3, -0.2, 0.4)
    geo = Geometry(a.shape, [1.5, 2, 2.5, 0.8], [3, -4, 5, 0], d, ptype, ("mm", "mm", "mm", "s"))
    data = nifti.write_bytes(a, geo, version)
    head = nifti.read_header(data)
    back = nifti.geometry(head)
    assert back.dims == a.shape and back.ptype == ptype and back.matches(geo, tolerance=1e-6) and back.units == geo.units
    assert np.array_equal(nifti.pixels(data, head, back), a)


def test_nifti_rows(spark, tmp_path):
    a = np.random.default_rng(1).normal(size=(3, 4, 2, 6))
    geo = Geometry(a.shape, ptype="FLOAT64")
    (tmp_path / "in").mkdir()
    with gzip.open(tmp_path / "in/a.nii.gz", "wb") as f:
        f.write(nifti.write_bytes(a, geo))
    packed = nifti.read_packed(spark, f"{tmp_path}/in")
    assert packed.count() == 24 and np.allclose(to_numpy(nifti.read_voxels(spark, f"{tmp_path}/in"), a.shape), a)
    meta = nifti.read_meta(spark, f"{tmp_path}/in").first()
    assert meta.img_id == "a.nii" and meta.dims == list(a.shape)
    done = files.save(nifti.encode(packed, {"a.nii": geo}, 2, ".nii.gz"), f"{tmp_path}/out").collect()
    assert len(done) == 1 and np.allclose(to_numpy(nifti.read_voxels(spark, f"{tmp_path}/out"), a.shape), a)


def test_json_round_trip(spark, tmp_path):
    a = np.arange(24.0).reshape(2, 1, 4, 3)
    geo = Geometry(a.shape, [1, 2, 3, 4])
    files.save(textual.encode_json(from_numpy(spark, a, "j"), {"j": geo}), str(tmp_path)).collect()
    assert np.array_equal(to_numpy(textual.read_json_images(spark, f"{tmp_path}/*.json"), a.shape), a)
    assert textual.flatten_numbers("[[1, [2]], 3]") == [1, 2, 3]


def test_text_images(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# c\n1 2 3\n\n4 0x10 6\n")
    out = textual.read_text_image(spark, f"{tmp_path}/t.txt")
    assert np.array_equal(to_numpy(out.withColumnRenamed("y", "y"), (2, 3)), [[1, 2, 3], [4, 16, 6]])
    assert textual.infer_type(textual.read_table(spark, f"{tmp_path}/t.txt")) == "UINT32"
    (tmp_path / "f.txt").write_text("1.5,2\n-3,x\n")
    assert [r["values"] for r in textual.read_numbers(spark, f"{tmp_path}/f.txt").orderBy("row").collect()] == [[1.5, 2], [-3, 0]]


@pytest.mark.parametrize("dense", [False, True])
def test_graph_round_trip(spark, tmp_path, dense):
    e = np.array([[i, j, i * 100 + j] for i in range(13) for j in range(13) if i * 100 + j])
    names = [f"n{i}" for i in range(13)]
    (tmp_path / "g").write_bytes(graphs.encode_binary(e, names, dense))
    back_names, back = graphs.decode_binary((tmp_path / "g").read_bytes())
    assert back_names == names and np.array_equal(back, e)
    df = graphs.read_graphs(spark, f"{tmp_path}/g")
    assert df.count() == len(e)
    graphs.write_edge_list(df, f"{tmp_path}/csv")
    assert graphs.read_edge_list(spark, f"{tmp_path}/csv").count() == len(e)


def test_matrix_blocks(spark, tmp_path):
    m = np.arange(12.0).reshape(3, 4)
    assert np.array_equal(graphs.decode_matrix_map(graphs.encode_matrix_map(m)), m)
    df = spark.createDataFrame([(c, m[:, c].tolist()) for c in range(4)], "col long, values array<double>")
    graphs.write_blocks(df, f"{tmp_path}/m", 2)
    assert graphs.check_blocks(graphs.read_blocks(spark, f"{tmp_path}/m"), 3).count() == 0
    assert graphs.check_blocks(graphs.read_blocks(spark, f"{tmp_path}/m"), 4).count() == 2


def test_tracks(spark, tmp_path):
    lines = [np.arange(12.0).reshape(4, 3), np.ones((2, 3))]
    (tmp_path / "a.trk").write_bytes(tracks.encode_trackvis(lines))
    (tmp_path / "b.dft").write_bytes(tracks.encode_dft(lines, ">"))
    rows = tracks.read_tracks(spark, str(tmp_path)).orderBy("file", "track_id", "pt_idx").collect()
    want = np.concatenate(lines)
    for name in ("a.trk", "b.dft"):
        assert np.allclose([(r.x, r.y, r.z) for r in rows if r.file == name], want)
