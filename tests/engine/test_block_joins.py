"""Joins of blocks whose voxels look small to the planner, and the groups that a query of a tree looks at."""

import re

import numpy as np
from pyspark.sql import functions as F

from voxloom.operators import geometry, spatial, tree
from voxloom.operators.blocks import sample
from voxloom.session import settled

AXES = ["x", "y", "z"]


def test_voxels_are_never_broadcast(spark):
    """A regular field is a few KB as parquet and many MB as rows: it was broadcast once the samples took more room."""
    n = 1 << 16
    image = settled(spark.range(n).select((F.col("id") / 64).cast("int").alias("x"), (F.col("id") / 8 % 8).cast("int").alias("y"), (F.col("id") % 8).cast("int").alias("z"), F.lit(1.5).alias("v")))
    samples = settled(spark.range(n).select("id", *[F.rand(k).alias(f"u{k}") for k in range(8)]))
    at = {"x": F.col("u0") * 1000, "y": F.col("u1") * 7, "z": F.col("u2") * 7}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "400k")
        got = sample(samples, image, at, {"x": n // 64, "y": 8, "z": 8}, ["id"], [0, 1], np.floor, [lambda d: 1 - abs(d)] * 3, "clamp")
        lines = got._jdf.queryExecution().executedPlan().toString().splitlines()
        assert got.count() == n and got.filter("abs(v - 1.5) > 1e-9").isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    depth = lambda line: re.search(r"[A-Za-z]", line).start()
    lines = [line for line in lines if re.search(r"[A-Za-z]", line)]
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            own = []
            for below in lines[k + 1 :]:
                if depth(below) <= depth(line):
                    break
                own.append(below)
            assert not any("_v0" in below for below in own)


def test_far_groups_are_left_out_together():
    """Queries that move together measure a few of many boxes, and find the same nearest ones."""
    rng = np.random.default_rng(3)
    low = rng.uniform(0, 1000, (500, 3))
    boxes = tree.Tree(np.array([-1]), np.zeros(1), np.zeros((1, 2), int), low=low, high=low + 5)
    x = rng.uniform(100, 110, (64, 3))
    every = np.arange(500)
    for k in (1, 3, 8):
        own = boxes.close(x, k=k)
        assert len(own) < 100
        whole, some = (np.argsort(boxes.far(x, b), axis=1, kind="stable")[:, :k] for b in (every, own))
        assert (own[some] == whole).all()
    allowed = np.arange(500) % 2 == 0
    own = boxes.close(x, k=3, allowed=allowed)
    far = boxes.far(x, every)
    far[:, ~allowed] = np.inf
    assert np.isin(np.argsort(far, axis=1, kind="stable")[:, :3], own).all()
    assert (boxes.far(x, every) < 200.0**2).any(0).sum() == (boxes.far(x, boxes.close(x, 200.0**2)) < 200.0**2).any(0).sum()


def test_few_coordinates_are_split_within_a_group():
    rng = np.random.default_rng(4)
    y = np.vstack([rng.normal(size=(3000, 3)), np.zeros((500, 3))])
    order, edges = tree._small(y)
    assert sorted(order) == list(range(3500))
    sizes = np.diff(edges)
    assert np.sort(sizes)[:-1].max() <= tree.SMALL and sizes.max() <= 500 + tree.SMALL


def test_nearest_of_few_coordinates(spark):
    rng = np.random.default_rng(5)
    y, x = np.round(rng.normal(size=(6000, 3)), 1), np.round(rng.normal(size=(2000, 3)), 2)
    points = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(y)], "id long, p array<double>")
    queries = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(x)], "id long, p array<double>")
    got = {r.id: (r.nearest_id, r.dist2) for r in spatial.nearest(queries, points, leaf_points=256).collect()}
    for k, p in enumerate(x):
        d = ((y - p) ** 2).sum(1)
        assert got[k] == (int(d.argmin()), d.min())


def test_inverse_of_a_strong_field(spark):
    size = (40, 8, 8)
    cells = np.argwhere(np.ones(size))
    d = np.stack([0.25 * cells[:, 1], -0.5 * (cells[:, 1] - 3.5), 1.5 * (cells[:, 2] - 3.5)], 1)
    rows = spark.createDataFrame([(*map(int, c), *map(float, v)) for c, v in zip(cells, d, strict=True)], "x int, y int, z int, dx double, dy double, dz double")
    out = geometry.invert_deformation(rows, size).filter("residual <= 1e-3").collect()
    assert len(out) > 500
    met = 0
    for r in out:
        w = (r.y - 3.5) / 0.5 + 3.5
        if 0 <= w <= 7 and 0 <= r.x - 0.25 * w <= size[0] - 1:
            assert np.allclose([r.dx, r.dy, r.dz], [-0.25 * w, w - r.y, (r.z - 3.5) / 2.5 - (r.z - 3.5)], atol=3e-3)
            met += 1
    assert met > 500


def test_a_cell_is_not_tried_by_leaves_again_at_once(monkeypatch):
    """Where leaves rule nothing out, most blocks of queries skip their boxes; what is found stays the same."""
    rng = np.random.default_rng(6)
    y = rng.normal(size=(2000, 16))
    cell = tree._Cell(np.arange(2000), np.zeros(2000, np.int64), np.repeat(np.arange(20), 100), y)
    tried, far = [], tree._Cell.far
    monkeypatch.setattr(tree._Cell, "far", lambda self, x: tried.append(len(x)) or far(self, x))
    for lo in range(0, 2000, 100):
        found = {(lo + a, b) for i, j, _ in tree._near(cell, y[lo : lo + 100], 5.0) for a, b in zip(i, j, strict=True)}
        d = ((y[lo : lo + 100, None] - y) ** 2).sum(2)
        assert found == {(lo + a, b) for a, b in np.argwhere(d < 25.0)}
    assert 0 < len(tried) < 5
