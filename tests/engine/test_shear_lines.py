"""Lines of an image are moved together."""

import numpy as np

from voxloom.operators import spectral


def test_lines_move_together_as_they_move_alone():
    rng = np.random.default_rng(4)
    y, d = rng.normal(size=(30, 8)), rng.uniform(-4, 4, 30)
    d[:3] = 0, 2, -9
    for move in (spectral.shift_line, lambda a, b: spectral.shift_line_kernel(a, b, 5)):
        assert np.abs(move(y, d) - np.array([move(a, b) for a, b in zip(y, d, strict=True)])).max() < 1e-12


def test_shear_calls_no_work_for_each_line(spark, monkeypatch):
    monkeypatch.setattr(spectral, "along_axis", None)
    v = np.random.default_rng(5).normal(size=(6, 5, 4))
    rows = spark.createDataFrame([(*map(int, at), float(x)) for at, x in np.ndenumerate(v) for at in [at]], "x int, y int, z int, v double")
    got = spectral.shear(rows, "y", {"z": 0.3, "x": 0.0}, {"x": 2.5, "z": 1.5}, ["x", "z"]).collect()
    want = np.array([[spectral.shift_line_kernel(v[x, :, z], 0.3 * (z - 1.5), 5) for z in range(4)] for x in range(6)])
    assert len(got) == v.size and all(abs(r.v - want[r.x, r.z, r.y]) < 1e-12 for r in got)
