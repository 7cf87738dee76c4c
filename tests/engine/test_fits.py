"""Mixtures, centres, components and inverses: convergence, empty tables, strong fields."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import cluster, decomposition, geometry

AXES = ["x", "y", "z"]


def points_of(spark, p):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(p)], "id long, p array<double>")


def test_lloyd_says_whether_it_converged(spark):
    rng = np.random.default_rng(1)
    p = np.vstack([rng.normal(size=(80, 3)) + c for c in (0, 6, 12)])
    rows = points_of(spark, p).select("p")
    centers, rounds, done = cluster.lloyd(rows, p[[0, 100, 200]].copy())
    assert done and 1 < rounds < 50 and np.allclose(sorted(centers[:, 0]), sorted(p[k : k + 80, 0].mean() for k in (0, 80, 160)))
    moved, once, done = cluster.lloyd(rows, p[[0, 1, 2]].copy(), rounds=1)
    assert not done and once == 1
    d = ((p[:, None] - p[[0, 1, 2]]) ** 2).sum(-1).argmin(1)
    assert np.allclose(moved, [p[d == k].mean(0) for k in range(3)])
    with pytest.warns(UserWarning, match="still move"):
        cluster.kmeans(points_of(spark, p), 3, rounds=1, centers=p[[0, 1, 2]])


def test_empty_tables_give_empty_results(spark):
    none = points_of(spark, np.zeros((0, 2)))
    for df in (none, none.repartition(3), spark.createDataFrame([(1, None)], none.schema)):
        assert cluster.kmeans(df, 3)[1].count() == 0
        model, found = cluster.gaussian_mixture(df, 2)
        assert found.count() == 0 and len(model["weight"]) == 0
    rows = none.select("id", F.col("p").alias("values"))
    assert decomposition.pca(rows, 2)[2].count() == 0
    found, w, mean, done = decomposition.independent_components(rows, 2)
    assert found.count() == 0 and w.shape == (2, 0) and done


def test_em_goes_on_from_a_start(spark):
    rng = np.random.default_rng(2)
    p = np.vstack([rng.normal(size=(150, 2)), rng.normal(size=(150, 2)) * 0.5 + 4])
    start = ([[0.5, 0.5], [3.0, 3.0]], [np.eye(2), np.eye(2)], [0.5, 0.5])
    one, _ = cluster.gaussian_mixture(points_of(spark, p), 2, rounds=1, start=start)
    log = np.stack([-0.5 * ((p - m) ** 2).sum(1) for m in np.array(start[0])], 1)
    r = np.exp(log) / np.exp(log).sum(1, keepdims=True)
    assert np.allclose(one["weight"], r.mean(0)) and np.allclose(one["mean"], (r.T @ p) / r.sum(0)[:, None])
    assert not one["converged"]
    last, _ = cluster.gaussian_mixture(points_of(spark, p), 2, start=start)
    assert last["converged"] and np.abs(last["mean"] - [[0, 0], [4, 4]]).max() < 0.3


@pytest.mark.parametrize("symmetric", [True, False])
def test_independent_components_over_rows(spark, symmetric):
    rng = np.random.default_rng(3)
    source = np.column_stack([rng.uniform(-1, 1, 1500), rng.laplace(size=1500), np.sign(rng.normal(size=1500)) + rng.normal(size=1500) * 0.1])
    mixed = source @ np.array([[1, 0.5, 0.2], [-0.3, 1, 0.6], [0.4, -0.2, 1]]) + [5, -3, 1]
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(mixed)], "id long, values array<double>").repartition(5)
    found, w, mean, done = decomposition.independent_components(rows, 3, symmetric=symmetric)
    s = np.array([r["values"] for r in found.orderBy("id").collect()])
    assert done and np.allclose(s, (mixed - mean) @ w) and np.allclose(s.T @ s / len(s), np.eye(3), atol=1e-8)
    assert np.allclose(s @ np.linalg.inv(w) + mean, mixed)
    r = np.abs(np.corrcoef(s.T, source.T)[:3, 3:])
    assert (r.max(0) > 0.98).all() and len(set(r.argmax(0))) == 3
    kept, few, _, _ = decomposition.independent_components(rows, 3, most=2, symmetric=symmetric)
    assert few.shape == (3, 2) and len(kept.first()["values"]) == 2


def test_a_strong_field_is_inverted(spark):
    dims = (9, 8, 10)
    x, y, z = np.indices(dims).astype(float)
    d = np.stack([0.8 * np.sin(y / 1.5), 1.4 * (y - 3.5), -0.6 * (z - 4.5) + 0.3 * np.cos(x)], -1)
    rows = spark.createDataFrame([(*map(int, k), *map(float, d[k])) for k in np.ndindex(dims)], "x int, y int, z int, dx double, dy double, dz double")
    got = geometry.invert_deformation(rows, dims).collect()
    assert len(got) == np.prod(dims)
    fine = 0
    for r in got:
        p = np.array([r.x + r.dx, r.y + r.dy, r.z + r.dz])
        at = np.clip(p, 0, np.array(dims) - 1)
        there = p + [geometry.sample(d[..., k], at[None])[0] for k in range(3)]
        miss = np.linalg.norm(there - [r.x, r.y, r.z])
        assert abs(miss - r.residual) < 1e-6
        fine += r.residual <= 1e-3
    # slopes of 2.4 along y and 0.4 along z: every voxel has a place where it comes from
    assert fine == len(got)


def test_a_fold_is_told(spark):
    dims = (8, 3, 3)
    rows = spark.createDataFrame([(i, j, k, float(0 if i < 4 else 6), 0.0, 0.0) for i in range(8) for j in range(3) for k in range(3)], "x int, y int, z int, dx double, dy double, dz double")
    far = spark.createDataFrame([(i, j, k, 20.0, 0.0, 0.0) for i in range(8) for j in range(3) for k in range(3)], rows.schema)
    assert all(r.residual <= 1e-3 for r in geometry.invert_deformation(rows, dims).collect())
    out = geometry.invert_deformation(far.withColumn("dx", F.lit(20.0) - F.col("x")), dims, rounds=4).collect()  # all of it comes to lie in one plane
    assert len(out) == 72 and all(r.residual > 1 for r in out)
