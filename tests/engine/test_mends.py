"""Formulas held against plain loops: the balloon model, assortativity, responses, pseudo-polar lines, components, block products."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.functions import kernels as K
from voxloom.model import from_numpy, to_numpy
from voxloom.operators import blocks, decomposition, geometry, graph, neighborhood, spectral
from voxloom.plans import pipelines

AXES = ["x", "y", "z"]


def bold(u, dt, learn):
    v = q = f = 1.0
    s = mean = 0.0
    out = []
    for x in u:
        mean = learn * x + (1 - learn) * mean
        x = 0.0 if x < mean else x
        dv = (f - v ** (1 / 0.33)) / 0.98
        dq = (f / 0.34 * (1 - 0.66 ** (1 / f)) - q / v ** (1 - 1 / 0.33)) / 0.98
        ds, df = 0.7 * x - s / 1.54 - (f - 1) / 2.46, s
        v, q, s, f = v + dv * dt, q + dq * dt, s + ds * dt, f + df * dt
        out.append(0.33 * (7 * 0.34 * (1 - q) + 2 * (1 - q / v) + (2 * 0.34 - 0.2) * (1 - v)))
    return np.array(out)


@pytest.mark.parametrize("learn", [0.0, 0.1, 1.0])
def test_balloon_model(spark, learn):
    u = np.random.default_rng(2).random(60)
    want = bold(u, 0.1, learn)
    row = spark.createDataFrame([(u.tolist(),)], "ts array<double>").select(neighborhood.balloon_response(F.col("ts"), 0.1, learn).alias("y")).first()
    assert np.allclose(row.y, want) and np.allclose(neighborhood.balloon_steps(u, 0.1, learn)[0], want)
    # in two parts, from the state between them
    first, state = neighborhood.balloon_steps(u[:25], 0.1, learn)
    assert np.allclose(np.append(first, neighborhood.balloon_steps(u[25:], 0.1, learn, state)[0]), want)
    if learn == 1.0:
        assert np.allclose(want, bold(u, 0.1, 0.0))  # the whole weight on the present: no habituation


def test_events_ahead_of_the_first_sample_count():
    times = np.array([-14.0, -3.0, -3.0, 2.5, 400.0])
    got = pipelines.sample_response(times, 20, 1.0, 0.01)
    u = np.zeros(3500)
    for t in times:
        i = round((t + 15) / 0.01)
        if i < len(u):
            u[i] += 100
    wave = bold(u, 0.01, 0.0)
    assert np.allclose(got, [wave[round((k + 15) / 0.01)] for k in range(20)]) and got[0] != 0


def test_response_scales_by_one_over_the_dispersion(spark):
    def gamma(x, k, theta):
        return x ** (k - 1) * math.exp(-x / theta) / (math.gamma(k) * theta**k)

    t = [0.5, 2.0, 7.0, 20.0, 31.0]
    rows = spark.createDataFrame([(x,) for x in t], "t double").select(K.canonical_hrf(F.col("t"), 5.0, 14.0, 0.7, 1.4, 5.0).alias("h")).collect()
    assert np.allclose([r.h for r in rows], [gamma(x, 5 / 0.7, 1 / 0.7) - gamma(x, 14 / 1.4, 1 / 1.4) / 5 for x in t])


@pytest.mark.parametrize("weighted", [False, True])
def test_assortativity(spark, weighted):
    rng = np.random.default_rng(6)
    m = np.where(rng.random((9, 9)) < 0.4, rng.random((9, 9)) + 0.1, 0.0)
    g = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(9) for j in range(9) if m[i, j]], "src long, dst long, w double")
    a = m if weighted else (m > 0).astype(float)
    leaves, enters = a.sum(1), a.sum(0)
    i, j = np.nonzero(m)
    one, two, own = (leaves[i] * enters[j]).mean(), ((leaves[i] + enters[j]).sum() / (2 * len(i))) ** 2, (leaves[i] ** 2 + enters[i] ** 2).sum() / (2 * len(i))
    assert abs(graph.assortativity(g, weighted).first().assortativity - abs((one - two) / (own - two))) < 1e-9


def test_pseudo_polar_lines(spark):
    a = np.random.default_rng(4).normal(size=(4, 3, 5))
    got = spectral.pseudo_polar(from_numpy(spark, a).select(*AXES, "v"), AXES, list(a.shape), "y")
    size = [2 * n for n in a.shape]
    spectrum = to_numpy(got, size, "re") + 1j * to_numpy(got, size, "im")
    n = size[1]
    want = np.zeros(size, complex)
    for k in range(n):
        slope = 2 * k / (n - 1) - 1
        for p in range(size[0]):
            for r in range(size[2]):
                for x, y, z in np.ndindex(a.shape):
                    turns = y * (k - n / 2) / n + slope * (x * (p - size[0] / 2) / size[0] + z * (r - size[2] / 2) / size[2])
                    want[p, k, r] += a[x, y, z] * np.exp(-2j * np.pi * turns)
    assert np.allclose(spectrum, want)


def components(a, inside):
    label, n = -np.ones(a.shape, int), 0
    for at in np.ndindex(a.shape):
        if inside[at] and label[at] < 0:
            first, todo = np.ravel_multi_index(at, a.shape), [at]
            label[at] = first
            while todo:
                here = todo.pop()
                for axis in range(a.ndim):
                    for step in (-1, 1):
                        there = tuple(h + step * (k == axis) for k, h in enumerate(here))
                        if all(0 <= t < m for t, m in zip(there, a.shape)) and inside[there] and label[there] < 0 and a[there] == a[here]:
                            label[there] = first
                            todo.append(there)
            n += 1
    return label


@pytest.mark.parametrize("voxels", [8, 64, 32_768])
def test_components_over_blocks(spark, monkeypatch, voxels):
    monkeypatch.setattr(blocks, "BLOCK_VOXELS", voxels)
    rng = np.random.default_rng(voxels)
    a = (rng.random((9, 7, 6)) < 0.45).astype(float)
    inside = rng.random(a.shape) < 0.9
    rows = from_numpy(spark, a).select(*AXES, "v").join(spark.createDataFrame([tuple(map(int, k)) for k in np.argwhere(inside)], "x int, y int, z int"), AXES)
    got = neighborhood.relabel_connected(rows, AXES, list(a.shape)).collect()
    want = components(a, inside)
    assert len(got) == inside.sum() and all(want[r.x, r.y, r.z] == r.label and r.v == a[r.x, r.y, r.z] for r in got)


def test_rounds_hold_faces_only(spark, monkeypatch):
    n = 24
    held = []
    found = neighborhood.connected_components
    monkeypatch.setattr(neighborhood, "connected_components", lambda edges, nodes=None: held.append(edges.count()) or found(edges, nodes))
    monkeypatch.setattr(blocks, "BLOCK_VOXELS", 512)
    one = from_numpy(spark, np.ones((n, n, n))).select(*AXES, "v")
    assert neighborhood.relabel_connected(one, AXES, [n] * 3).agg(F.max("label")).first()[0] == 0
    assert held[0] == 3 * 2 * 3 * 3  # a pair for each face between blocks, none for the voxels inside


def test_memory_of_a_block_does_not_grow_with_the_axis(spark):
    far = 10**9
    df = spark.createDataFrame([(k, float(k % 3)) for k in (0, 1, 2, far - 2, far - 1)], "x long, v double")
    rows = neighborhood.median_filter_nd(df, ["x"], [far])
    assert {r.x: r.v for r in rows.collect()} == {0: 0.0, 1: 1.0, 2: 1.0, far - 2: 1.0 * ((far - 2) % 3 and min((far - 2) % 3, (far - 1) % 3)), far - 1: float((far - 1) % 3)}


@pytest.mark.parametrize("edge", ["clamp", "zero"])
def test_gaussian_over_blocks(spark, monkeypatch, edge):
    monkeypatch.setattr(blocks, "BLOCK_VOXELS", 27)
    a, sds = np.random.default_rng(1).normal(size=(7, 6, 5)), [0.9, 1.4, 0.6]
    want = a.copy()
    for axis, sd in enumerate(sds):
        radius = int(3 * sd) if edge == "zero" else int(2 * sd + 0.5)
        w = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sd * sd))
        pad = [(radius, radius) if k == axis else (0, 0) for k in range(3)]
        wide = np.pad(want, pad, mode="edge" if edge == "clamp" else "constant")
        want = sum(x / w.sum() * wide.take(np.arange(k, k + a.shape[axis]), axis) for k, x in enumerate(w))
    got = to_numpy(neighborhood.gaussian_smooth_nd(from_numpy(spark, a).select(*AXES, "v"), AXES, list(a.shape), sds, edge=edge), a.shape)
    assert np.allclose(got, want)


def test_block_products(spark):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(37, 23)), rng.normal(size=(23, 11))
    a[5:20, 3:9] = 0
    entries = lambda m: spark.createDataFrame([(i, j, float(m[i, j])) for i, j in np.argwhere(m != 0).tolist()], "i long, j long, v double")
    for size in (4, 64):
        out = decomposition.block_multiply(decomposition.blocks(entries(a), size), decomposition.blocks(entries(b), size), size)
        got = {(r.i, r.j): r.v for r in decomposition.block_entries(out, 37, 11, size).collect()}
        assert len(got) == 37 * 11 and all(abs(got[i, j] - (a @ b)[i, j]) < 1e-9 for i, j in got)
    none = entries(np.zeros((2, 2)))
    assert decomposition.block_multiply(decomposition.blocks(none), decomposition.blocks(entries(b))).count() == 0


@pytest.mark.parametrize("angles", [(10, 0, 0), (0, 20, 0), (0, 0, 30), (10, -15, 20), (25, 10, -5)])
def test_shears_of_every_order_make_the_rotation(angles):
    r = geometry.rotation(*np.radians(angles))
    single = sum(a != 0 for a in angles) == 1
    held = 0
    for n in (3, 4):
        for order in itertools.product(range(3), repeat=n):
            if all(a != b for a, b in zip(order, order[1:])):
                found = geometry.shear_decompose(r, orders=[order])
                if found is not None:
                    held += 1
                    assert len(found) == n and np.abs(np.linalg.multi_dot(found) - r).max() < 1e-4
                    assert all(np.count_nonzero(np.abs(m - np.eye(3)).sum(1) > 1e-12) <= 1 for m in found)
                elif single and n == 3:
                    around = [abs(a) > 0 for a in angles].index(True)
                    assert around in order  # only chains that turn about another axis fail
    assert held
