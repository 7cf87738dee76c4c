"""Tiles: the order, boxes, and how much of the image a box's scan gives."""

import numpy as np
from pyspark.sql import functions as F

from voxloom.model import grid
from voxloom.operators.spatial import copy_region
from voxloom.sources import tiles

AXES = ["x", "y", "z"]


def scanned(df):
    """Rows that the scans of an executed plan gave on."""
    df.collect()
    todo, rows = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if "Scan" in node.nodeName():
            rows += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return rows


def test_order_interleaves_bits(spark):
    rng = np.random.default_rng(1)
    p = [tuple(int(v) for v in rng.integers(0, 1 << 20, 3)) for _ in range(50)]
    got = spark.createDataFrame(p, "x long, y long, z long").select(*AXES, tiles.morton([F.col(a) for a in AXES]).alias("m")).collect()
    for r in got:
        assert r.m == sum(((r[a] >> bit) & 1) << (3 * bit + k) for bit in range(20) for k, a in enumerate(AXES))


def test_a_box_reads_few_rows(spark, tmp_path):
    n = 64
    image = grid(spark, (n, n, n)).select(*AXES, F.sin(F.col("pos")).alias("v"))
    tiles.write_tiles(image, f"{tmp_path}/image", AXES, 8)
    stored = spark.read.parquet(f"{tmp_path}/image")
    assert stored.count() == n**3 and stored.agg(F.sum("v")).first()[0] is not None
    box = {"x": (17, 30), "y": (40, 47), "z": (3, 20)}
    out = tiles.read_box(spark, f"{tmp_path}/image", box)
    assert scanned(out) < n**3 / 10
    start, size = {a: lo for a, (lo, _) in box.items()}, {a: hi - lo + 1 for a, (lo, hi) in box.items()}
    want = {(r.x, r.y, r.z): r.v for r in copy_region(image, start, size, start).collect()}
    assert {(r.x, r.y, r.z): r.v for r in out.collect()} == want and len(want) == 14 * 8 * 18
    assert tiles.read_box(spark, f"{tmp_path}/image", {"x": (70, 80)}).count() == 0
