"""Queries without SQL, or whose SQL takes a part, over whole small tables against brute force."""

import datetime as dt

import numpy as np

from voxloom.operators import spatial
from voxloom.operators.spectral import butterworth
from voxloom.plans.queries import QUERIES


def test_series_of_every_user(spark, tmp_path):
    start, rng = dt.datetime(2023, 12, 20, 7), np.random.default_rng(4)
    rows = [(k, start + dt.timedelta(hours=float(rng.uniform(0, 50 * 24))), int(u), float(rng.uniform(0, 9))) for k, u in enumerate(rng.choice([1, 51, 101, 7_000_000_000], 600))]
    rows += [(600, start, 51, 2.0), (601, start + dt.timedelta(days=50), 1, 3.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    at = lambda ts: int((ts - dt.datetime(1970, 1, 1)).total_seconds() // 21600)
    lo, n = at(start), at(start + dt.timedelta(days=50)) - at(start) + 1
    assert n > 120
    held: dict = {}
    for _, ts, user, v in rows:
        held.setdefault((user, at(ts) - lo), []).append(v)
    users = sorted({r[2] for r in rows})
    y = np.array([[np.mean(held.get((u, t), [0.0])) for t in range(n)] for u in users])

    got = {(r.x, r.t): r.v for r in QUERIES["series_band_pass"](spark, str(tmp_path)).collect()}
    want = np.fft.irfft(np.fft.rfft(y, 256) * butterworth(np.fft.rfftfreq(256, 1.0), 0.02, 0.2), 256)[:, :n]
    assert len(got) == len(users) * n
    assert all(abs(got[u, t] - want[k, t]) < 2e-6 for k, u in enumerate(users) for t in range(n))

    day = 2 * np.pi * (lo + np.arange(n)) / 4
    x = np.column_stack([np.sin(day), np.cos(day), np.ones(n)])
    found = {r.x: r for r in QUERIES["series_glm"](spark, str(tmp_path)).collect()}
    assert sorted(found) == users
    for k, u in enumerate(users):
        b = np.linalg.lstsq(x, y[k], rcond=None)[0]
        r2 = 1 - ((y[k] - x @ b) ** 2).sum() / ((y[k] - y[k].mean()) ** 2).sum()
        assert np.allclose([found[u].b0, found[u].b1, found[u].b2, found[u].rsqr], [*b, r2], atol=2e-6)


def test_components_of_all_orders(spark, tmp_path):
    lines = [(1, 5), (1, 3), (1, 9), (2, 9), (2, 12), (3, 20), (3, 21), (3, 22), (3, 21), (4, 30), (5, 40), (5, 40), (6, 22), (6, 50), (6, 51), (6, 52)]
    lines += [(100 + k // 4, 1000 + (k * k * 7) % 97) for k in range(60)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    label = {p: p for _, p in lines}
    orders = [{p for o, p in lines if o == k} for k in {o for o, _ in lines}]
    for _ in lines:
        for parts in orders:
            low = min(label[p] for p in parts)
            label |= dict.fromkeys(parts, low)
    met = {p for parts in orders if len(parts) > 1 for p in parts}
    got = QUERIES["component_labels"](spark, str(tmp_path)).collect()
    assert len(got) == len(met)
    assert {r.id: r.component for r in got} == {p: label[p] for p in met}


def test_concat_has_every_line(spark):
    sf = "/root/testdata/sf0.001"
    want = [(r.l_orderkey + 1_000_000, r.l_linenumber, r.l_extendedprice) for r in spark.read.parquet(f"{sf}/lineitem.parquet").collect()]
    assert len({line for _, line, _ in want}) > 1
    assert sorted((r.id, r.line, r.v) for r in QUERIES["concat_lines"](spark, sf).filter("part = 'b'").collect()) == sorted(want)


def test_trade_graph_of_all_lines(spark, tmp_path):
    lines = [(1, 3, "R", 10.0), (1, 2, "N", 1.0), (2, 3, "A", 1.0), (2, 3, "R", 0.5)]  # customer = order = nation, supplier = nation
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_returnflag string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    for table, key, other in (("orders", "o_orderkey long", "o_custkey long"), ("customer", "c_custkey long", "c_nationkey int"), ("supplier", "s_suppkey long", "s_nationkey int")):
        spark.createDataFrame([(k, k) for k in (1, 2, 3)], f"{key}, {other}").write.parquet(f"{tmp_path}/{table}.parquet")
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    assert {r.id: r.visits for r in run("betweenness")} == {1: 0, 2: 1, 3: 0}
    assert {r.id: (r.out_strength, r.in_strength) for r in run("strengths_all")} == {1: (11.0, 0.0), 2: (1.5, 1.0), 3: (0.0, 11.5)}
    assert {(r.src, r.dst): r.dist for r in run("all_pairs_shortest_all")} == {(1, 2): 1.0, (2, 3): 1.5, (1, 3): 2.5}


def test_flagship_sums_all_lines(spark):
    import __spark_entry__

    total = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").agg({"l_quantity": "sum"}).first()[0]
    assert abs(sum(r.out_strength for r in __spark_entry__.entry(spark).collect()) - total) < 1e-6 * total


def test_matrices_and_distances_of_all_coordinates(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, p = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    for name, want in (("cov_matrix_64", np.cov(p.T)), ("gram_matrix_64", p.T @ p)):
        got = {(r.i, r.j): r.value for r in QUERIES[name](spark, sf).collect()}
        assert len(got) == 64 * 64 and all(abs(got[i, j] - want[i, j]) < 2e-6 for i in range(64) for j in range(64))

    points = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, p, strict=True)], "id long, p array<double>")
    d2 = ((p[:, None] - p) ** 2).sum(2)
    want = {(ids[i], ids[j]): d2[i, j] for i in range(len(ids)) for j in range(i + 1, len(ids)) if d2[i, j] < 1.1 * 1.1}
    assert want
    for size in (2048, 70):
        found = spatial.within_blocked(points, 1.1, rows=size).collect()
        assert len(found) == len(want) and all(abs(want[r.left_id, r.right_id] - r.dist2) < 1e-9 for r in found)
