"""Rows of a tall matrix come to numpy without an object for each row."""

import numpy as np
import pytest

from voxloom.operators import decomposition


def test_rows_are_not_stacked_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(decomposition, "_stack", None)
    rng = np.random.default_rng(7)
    a, m = rng.uniform(size=(400, 3)), np.array([[1.0, 0.4, -0.3], [0.2, 1.0, 0.5], [-0.4, 0.3, 1.0]])
    rows = spark.createDataFrame([(k, (m @ v).tolist()) for k, v in enumerate(a)], "id long, values array<double>").repartition(3)
    b = a @ m.T
    assert np.abs(decomposition.cross_product(rows, 3) - b.T @ b).max() < 1e-9
    got = {r.id: r["values"] for r in decomposition.right_multiply(rows, m[:, :2]).collect()}
    assert all(np.abs(got[k] - b[k] @ m[:, :2]).max() < 1e-12 for k in range(400))
    found, unmix, mean, done = decomposition.independent_components(rows, 3)
    assert done and all(np.abs((b[r.id] - mean) @ unmix - r["values"]).max() < 1e-9 for r in found.collect())


def test_rows_of_other_lengths_are_an_error(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [4.0])], "id long, values array<double>").coalesce(1)
    with pytest.raises(Exception, match="one length"):
        decomposition.cross_product(rows, 2)
