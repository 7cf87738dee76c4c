"""Registration over blocks against the local form, and distortion correction weighted by class probabilities."""

import numpy as np
import pytest

from voxloom.model import from_numpy
from voxloom.operators import blocks, geometry

AXES = ["x", "y", "z"]


def volume(shape, seed=0):
    i, j, k = (np.arange(n) for n in shape)
    rng = np.random.default_rng(seed)
    out = np.zeros(shape)
    for _ in range(6):
        c, w = rng.uniform(2, np.array(shape) - 3), rng.uniform(1.5, 3)
        out += rng.uniform(0.5, 2) * np.exp(-((i[:, None, None] - c[0]) ** 2 + (j[:, None] - c[1]) ** 2 + (k - c[2]) ** 2) / (2 * w * w))
    return out


def rows_of(spark, a):
    return from_numpy(spark, a).select(*AXES, "v")


@pytest.mark.parametrize("metric", [geometry.correlation_metric, geometry.information_metric("mi", 16), geometry.information_metric("nmi", 12), geometry.information_metric("vi", 12)])
def test_cost_and_slopes_over_blocks(spark, monkeypatch, metric):
    monkeypatch.setattr(blocks, "BLOCK_VOXELS", 216)
    shape = (11, 9, 10)
    a, b = volume(shape, 1), volume(shape, 2)
    center = (np.array(shape) - 1) / 2
    v = np.array([0.05, -0.03, 0.08, 0.7, -0.4, 0.3])
    cells = np.indices(shape).reshape(3, -1).T.astype(float)
    want, slope = geometry.rigid_cost(metric, b, cells, a.ravel(), center, v)
    spans = ((a.min(), a.max()), geometry._span(b))
    got, found = geometry.rigid_cost_over(metric, rows_of(spark, a), rows_of(spark, b), shape, center, v, spans)
    assert abs(got - want) < 1e-9 and np.allclose(found, slope, atol=1e-9)

    def cost(u):
        at = geometry.sample(b, geometry.Rigid(u[:3], u[3:], center).apply(cells))
        return metric.slope(a.ravel(), at, spans[1])[0]

    assert np.allclose(geometry.numeric_gradient(cost, v, np.full(6, 1e-6)), slope, atol=1e-4)


def test_same_motion_as_on_one_machine(spark):
    shape = (16, 15, 14)
    a = volume(shape, 3)
    true = geometry.Rigid(np.array([0.04, -0.06, 0.05]), np.array([0.8, -0.6, 0.5]), (np.array(shape) - 1) / 2)
    cells = np.indices(shape).reshape(3, -1).T.astype(float)
    b = geometry.sample(a, true.inverse().apply(cells)).reshape(shape)
    local = geometry.register_rigid(a, b, sigmas=(1,))
    over = geometry.register_images(rows_of(spark, a), rows_of(spark, b), shape, sigmas=(1,))
    assert np.allclose(over.matrix, local.matrix, atol=2e-3) and np.allclose(over.shift, local.shift, atol=2e-2)
    assert np.allclose(local.inverse().shift, true.shift, atol=0.2)


@pytest.mark.parametrize("kind", ["mi", "nmi", "vi"])
def test_class_information_slopes(kind):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=60), rng.random((60, 3))
    metric = geometry.ClassInformation(kind, 10)
    value, slope = metric.slope(a, b)
    for i, c in [(0, 0), (7, 2), (31, 1), (59, 2)]:
        sides = []
        for sign in (1, -1):
            moved = b.copy()
            moved[i, c] += sign * 1e-6
            sides.append(metric.slope(a, moved)[0])
        assert abs((sides[0] - sides[1]) / 2e-6 - slope[i, c]) < 1e-6
    assert np.isfinite(value) and metric.slope(a, np.zeros((60, 3)))[0] == 0.0


@pytest.mark.parametrize("seed", [5, 6])
def test_known_stretch_from_class_probabilities(seed):
    shape = (12, 30, 10)
    i = np.indices(shape)[1]
    fixed = volume(shape, seed) + 0.3 * np.sin(i / 1.7)
    cells = np.indices(shape).reshape(3, -1).T.astype(float)
    true = 1.3 * np.sin(i / 5)
    cells[:, 1] -= true.ravel()
    seen = geometry.sample(fixed, cells).reshape(shape)
    levels = np.quantile(seen, [0.1, 0.5, 0.9])  # three classes by intensity, as probabilities
    soft = np.exp(-((seen[..., None] - levels) ** 2) / (2 * 0.2**2)) + 1e-6
    field, out = geometry.correct_distortion(fixed, soft / soft.sum(3, keepdims=True), 1, 5, rounds=60, sigmas=(1, 0))
    inner = (slice(1, -1), slice(5, -5), slice(1, -1))
    assert out.shape == (*shape, 3) and np.corrcoef(field[inner].ravel(), true[inner].ravel())[0, 1] > 0.95
    assert np.abs(field - true)[inner].mean() < np.abs(true)[inner].mean() / 3
