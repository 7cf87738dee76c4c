"""Rotations, shears, deformations, bias fields and registration.

Matrices and optimisers are small and run on the driver; images stay distributed: a metric is
one aggregate over voxels, a resampling one join.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Geometry, grid
from ..session import settled
from . import tree
from .blocks import around
from .blocks import sample as sample_blocks
from .neighborhood import gaussian_smooth_nd
from .spatial import cubic_slope, cubic_spline, interpolate
from .sums import summed

AXES = ["x", "y", "z"]


def rotation(rx: float, ry: float, rz: float) -> np.ndarray:
    """Rotation about x, then y, then z (radians)."""
    cx, sx, cy, sy, cz, sz = math.cos(rx), math.sin(rx), math.cos(ry), math.sin(ry), math.cos(rz), math.sin(rz)
    return np.array([[1, 0, 0], [0, cx, -sx], [0, sx, cx]]) @ np.array([[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]]) @ np.array([[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]])


@dataclass
class Rigid:
    """out = R (p − center) + center + shift."""

    angles: np.ndarray = field(default_factory=lambda: np.zeros(3))
    shift: np.ndarray = field(default_factory=lambda: np.zeros(3))
    center: np.ndarray = field(default_factory=lambda: np.zeros(3))
    matrix_: np.ndarray | None = None

    @property
    def matrix(self) -> np.ndarray:
        return rotation(*self.angles) if self.matrix_ is None else self.matrix_

    def inverse(self) -> "Rigid":
        m = self.matrix.T
        return Rigid(center=self.center, shift=-m @ self.shift, matrix_=m)

    def apply(self, p: np.ndarray) -> np.ndarray:
        return (np.asarray(p) - self.center) @ self.matrix.T + self.center + self.shift

    def columns(self, p: list[Column]) -> list[Column]:
        m, c, s = self.matrix, self.center, self.shift
        d = [p[k] - F.lit(float(c[k])) for k in range(3)]
        return [sum((d[k] * F.lit(float(m[r, k])) for k in (1, 2)), d[0] * F.lit(float(m[r, 0]))) + F.lit(float(c[r] + s[r])) for r in range(3)]

    def to_physical(self, geo: Geometry) -> "Rigid":
        """The same motion, given on indices, in physical space (isotropic spacing)."""
        d, s = geo.direction[:3, :3], np.diag(geo.spacing[:3])
        a = d @ s
        m = a @ self.matrix @ np.linalg.inv(a)
        return Rigid(center=a @ self.center + geo.origin[:3], shift=a @ self.shift, matrix_=m)

    def to_index(self, geo: Geometry) -> "Rigid":
        a = geo.direction[:3, :3] @ np.diag(geo.spacing[:3])
        b = np.linalg.inv(a)
        return Rigid(center=b @ (self.center - geo.origin[:3]), shift=b @ self.shift, matrix_=b @ self.matrix @ a)


def rigid_transform(image: DataFrame, dims: tuple[int, int, int], motion: Rigid, kind: str = "linear") -> DataFrame:
    """The image moved by an index-space motion: each target voxel looks up where it came from."""
    cells = grid(image.sparkSession, dims).select(*AXES)
    at = motion.inverse().columns([F.col(a).cast("double") for a in AXES])
    return interpolate(cells, image, dict(zip(AXES, at, strict=True)), dict(zip(AXES, dims, strict=True)), AXES, kind, "zero")


# ---- shears ------------------------------------------------------------------------


def shear_matrix(axis: int, a: float, b: float) -> np.ndarray:
    """Identity but for two entries in the row of the axis."""
    m = np.eye(3)
    m[axis, [k for k in range(3) if k != axis]] = a, b
    return m


def shear_decompose(r: np.ndarray, limit: float = 1.0, tolerance: float = 1e-4, orders: list[tuple[int, ...]] | None = None) -> list[np.ndarray] | None:
    """Four (or three) axis shears whose product is the rotation, with the smallest largest shear.

    For each order of axes the shears solve polynomial equations; Newton steps from zero find
    them for the moderate angles at which shears are of use. orders: the orders of axes to try.
    """
    best, least = None, math.inf
    for order in orders or [o for n in (3, 4) for o in itertools.product(range(3), repeat=n) if all(a != b for a, b in zip(o, o[1:], strict=False)) and len(set(o)) > 1]:
        x = np.zeros(2 * len(order))

        def product(v: np.ndarray, order=order) -> np.ndarray:
            m = np.eye(3)
            for k, axis in enumerate(order):
                m = m @ shear_matrix(axis, *v[2 * k : 2 * k + 2])
            return m

        for _ in range(40):
            miss = (product(x) - r).ravel()
            if np.abs(miss).max() < 1e-10:
                break
            jac = np.column_stack([(product(x + 1e-6 * e) - product(x - 1e-6 * e)).ravel() / 2e-6 for e in np.eye(len(x))])
            x = x - np.linalg.lstsq(jac, miss, rcond=1e-10)[0]
            if np.abs(x).max() > 10:
                break
        if np.abs(product(x) - r).max() < tolerance and np.abs(x).max() < min(least, limit + 1e-9):
            best, least = [shear_matrix(axis, *x[2 * k : 2 * k + 2]) for k, axis in enumerate(order)], np.abs(x).max()
    return best


def rotate_by_shears(image: DataFrame, dims: tuple[int, int, int], rx: float, ry: float, rz: float, kernel: bool = True, orders: list[tuple[int, ...]] | None = None) -> DataFrame:
    """Rotation about the centre as a chain of shears; angles up to 45 degrees."""
    from .spectral import shear

    if max(abs(rx), abs(ry), abs(rz)) > math.pi / 4:
        raise ValueError("an angle is larger than 45 degrees")
    shears = shear_decompose(rotation(rx, ry, rz), orders=orders)
    if shears is None:
        raise ValueError("no chain of small shears makes this rotation")
    centers = {a: (n - 1) / 2 for a, n in zip(AXES, dims, strict=True)}
    for m in reversed(shears):
        axis = int(np.argmax(np.abs(m - np.eye(3)).sum(1)))
        others = [a for k, a in enumerate(AXES) if k != axis]
        slopes = {a: float(m[axis, AXES.index(a)]) for a in others}
        if any(slopes.values()):
            image = shear(image, AXES[axis], slopes, centers, others, kernel)
    return image


# ---- optimiser ---------------------------------------------------------------------


def lbfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 100, memory: int = 8, stop_gradient: float = 1e-6, stop_x: float = 1e-8, first_step: float = 1.0) -> np.ndarray:
    """Minimise by limited-memory BFGS with backtracking."""
    value, g = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.linalg.norm(g) < stop_gradient:
            break
        q, alphas = g.copy(), []
        for s, y in reversed(pairs):
            a = s @ q / (s @ y)
            alphas.append(a)
            q -= a * y
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q *= first_step / max(np.linalg.norm(q), 1e-12)
        for (s, y), a in zip(pairs, reversed(alphas), strict=True):
            q += s * (a - y @ q / (s @ y))
        direction = -q
        if direction @ g >= 0:
            direction, pairs = -g * first_step / max(np.linalg.norm(g), 1e-12), []
        step = 1.0
        while True:
            new = x + step * direction
            new_value, new_g = f(new)
            if new_value <= value + 1e-4 * step * (direction @ g):
                break
            step /= 2
            if step * np.linalg.norm(direction) < stop_x:
                return x
        s, y = new - x, new_g - g
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        done = np.linalg.norm(s) < stop_x
        x, value, g = new, new_value, new_g
        if done:
            break
    return x


def numeric_gradient(f: Callable[[np.ndarray], float], x: np.ndarray, steps: np.ndarray) -> np.ndarray:
    return np.array([(f(x + h * e) - f(x - h * e)) / (2 * h) for h, e in zip(steps, np.eye(len(x)), strict=True)])


# ---- registration ------------------------------------------------------------------

#: Called with two arrays of equal length it gives a cost. A metric that also has
#: slope(a, b, span) → (cost, its derivative by each b) spares the finite differences.
Metric = Callable[[np.ndarray, np.ndarray], float]
Span = tuple[float, float]


class Correlation:
    """Negated absolute correlation."""

    def __call__(self, a: np.ndarray, b: np.ndarray) -> float:
        return self.slope(a, b)[0]

    def slope(self, a: np.ndarray, b: np.ndarray, span: Span | None = None) -> tuple[float, np.ndarray]:
        a, b = a - a.mean(), b - b.mean()
        d = math.sqrt((a @ a) * (b @ b))
        if not d:
            return 0.0, np.zeros(len(b))
        r = float(a @ b) / d
        return -abs(r), -np.sign(r) * (a / d - r * b / (b @ b))


@dataclass
class Information:
    """Negated mutual (or normalised) information, or variation of information, with Parzen windows.

    The bins of b cover ``span`` where it is given (it must hold all of b), else b's own range,
    which the derivative takes as fixed.
    """

    kind: str = "mi"
    bins: int = 32
    radius: int = 2

    def __call__(self, a: np.ndarray, b: np.ndarray) -> float:
        return self.slope(a, b)[0]

    def _spread(self, v: np.ndarray, span: Span | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bins that each value counts in, its weights there and their derivatives by the value."""
        lo, hi = span or (v.min(), v.max())
        width = (hi - lo) / (self.bins - 2 * self.radius - 1) or 1.0
        u = (v - lo) / width + self.radius
        at = np.floor(u).astype(int)[:, None] + np.arange(-self.radius, self.radius + 1)
        d = at - u[:, None]
        return at.clip(0, self.bins - 1), cubic_spline(d), -cubic_slope(d) / width

    def of_joint(self, p: np.ndarray) -> tuple[float, np.ndarray]:
        """Cost of a joint distribution and its derivative by each cell."""
        log = lambda q: np.log(np.where(q > 0, q, 1.0))
        h = lambda q: -float((q * log(q)).sum())
        ha, hb, hj = h(p.sum(1)), h(p.sum(0)), h(p)
        # derivatives of the three entropies by a cell of the joint histogram
        da, db, dj = -log(p.sum(1))[:, None] - 1, -log(p.sum(0))[None, :] - 1, -log(p) - 1
        if self.kind == "mi":
            return hj - ha - hb, dj - da - db
        if self.kind == "nmi":
            return (-(ha + hb) / hj, ((ha + hb) * dj / hj - da - db) / hj) if hj else (0.0, np.zeros_like(p))
        return 2 * hj - ha - hb, 2 * dj - da - db

    def slope(self, a: np.ndarray, b: np.ndarray, span: Span | None = None) -> tuple[float, np.ndarray]:
        (ia, wa, _), (ib, wb, db) = self._spread(a, None), self._spread(b, span)
        cell = ia[:, :, None] * self.bins + ib[:, None, :]
        joint = np.bincount(cell.ravel(), (wa[:, :, None] * wb[:, None, :]).ravel(), self.bins**2)
        whole = joint.sum()
        cost, by_cell = self.of_joint(joint.reshape(self.bins, self.bins) / whole)
        return cost, (by_cell.ravel()[cell] * wa[:, :, None] * db[:, None, :]).sum((1, 2)) / whole


@dataclass
class ClassInformation(Information):
    """Information between a value and class probabilities: b has a column for each class, and a voxel
    counts in every class with its probability there; what a probability loses beyond the image isn't made up for."""

    def slope(self, a: np.ndarray, b: np.ndarray, span: Span | None = None) -> tuple[float, np.ndarray]:
        ia, wa, _ = self._spread(a, span)
        own = np.zeros((len(a), self.bins))
        np.add.at(own, (np.arange(len(a))[:, None], ia), wa)
        joint = own.T @ b
        whole = joint.sum()
        if whole <= 0:
            return 0.0, np.zeros_like(b)
        p = joint / whole
        cost, by_cell = self.of_joint(p)
        return cost, own @ ((by_cell - (by_cell * p).sum()) / whole)


correlation_metric = Correlation()


def information_metric(kind: str = "mi", bins: int = 32, radius: int = 2) -> Information:
    return Information(kind, bins, radius)


def _smooth(a: np.ndarray, sigma: float) -> np.ndarray:
    if sigma <= 0:
        return a
    r = max(1, int(3 * sigma))
    k = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sigma * sigma))
    k /= k.sum()
    for axis in range(3):
        a = np.apply_along_axis(lambda v: np.convolve(np.pad(v, r, mode="edge"), k, "valid"), axis, a)
    return a


def sample_slope(a: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linear interpolation of a volume at points (n, 3), zero outside, and its gradient by the point."""
    base = np.floor(p).astype(int)
    out, slope = np.zeros(len(p)), np.zeros((len(p), 3))
    for c in itertools.product((0, 1), repeat=3):
        at = base + c
        near = 1 - np.abs(p - at)
        ok = ((at >= 0) & (at < a.shape)).all(1)
        value = np.where(ok, a[tuple(at.clip(0, np.array(a.shape) - 1).T)], 0.0)
        out += near.prod(1) * value
        for k in range(3):
            slope[:, k] += (1 if c[k] else -1) * np.delete(near, k, 1).prod(1) * value
    return out, slope


def sample(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    return sample_slope(a, p)[0]


def _span(a: np.ndarray) -> Span:
    """Values that a sample of a may take, zero outside included."""
    return min(float(a.min()), 0.0), max(float(a.max()), 0.0)


#: Turns by an infinitesimal angle round each axis.
_TURNS = [np.array(m, float) for m in ([[0, 0, 0], [0, 0, -1], [0, 1, 0]], [[0, 0, 1], [0, 0, 0], [-1, 0, 0]], [[0, -1, 0], [1, 0, 0], [0, 0, 0]])]


def rigid_cost(metric: Metric, moving: np.ndarray, points: np.ndarray, values: np.ndarray, center: np.ndarray, v: np.ndarray) -> tuple[float, np.ndarray]:
    """Cost of a motion (three angles, three shifts) and its gradient: one look at the volume for all six."""
    x, y, z = v[:3]
    at, by_place = sample_slope(moving, Rigid(v[:3], v[3:], center).apply(points))
    cost, by_value = metric.slope(values, at, _span(moving))
    pull = by_value[:, None] * by_place
    turned = [rotation(x, 0, 0) @ _TURNS[0] @ rotation(0, y, z), rotation(x, y, 0) @ _TURNS[1] @ rotation(0, 0, z), rotation(x, y, z) @ _TURNS[2]]
    moment = pull.T @ (points - center)  # sum over points of pull_r (p − center)_c
    return cost, np.array([*[(t * moment).sum() for t in turned], *pull.sum(0)])


def register_rigid(fixed: np.ndarray, moving: np.ndarray, metric: Metric = correlation_metric, sigmas: tuple[float, ...] = (3, 1, 0), start: Rigid | None = None) -> Rigid:
    """Motion that carries moving onto fixed, coarse to fine; volumes fit one machine (see register_series).

    The gradient is analytic where the metric has a slope, else by finite differences.
    """
    center = (np.array(fixed.shape) - 1) / 2
    x = np.zeros(6) if start is None else np.concatenate([start.angles, start.shift])
    cells = np.indices(fixed.shape).reshape(3, -1).T.astype(float)
    scale = np.array([0.01] * 3 + [1.0] * 3)
    for sigma in sigmas:
        step = max(1, int(sigma))
        a, b = _smooth(fixed, sigma), _smooth(moving, sigma)
        some = (cells % step == 0).all(1)
        points, values = cells[some], a[tuple(cells[some].astype(int).T)]

        def cost(u: np.ndarray, b=b, points=points, values=values) -> float:
            v = u * scale
            return metric(values, sample(b, Rigid(v[:3], v[3:], center).apply(points)))

        def descent(u: np.ndarray, b=b, points=points, values=values, cost=cost) -> tuple[float, np.ndarray]:
            if not hasattr(metric, "slope"):
                return cost(u), numeric_gradient(cost, u, np.full(6, 0.02))
            value, slope = rigid_cost(metric, b, points, values, center, u * scale)
            return value, slope * scale

        x = lbfgs(descent, x / scale, 40, stop_gradient=1e-7, stop_x=1e-4, first_step=0.5) * scale
    return Rigid(x[:3], x[3:], center).inverse()


# ---- registration of images that no machine holds ----------------------------------

_UP = lambda d: np.clip(1 - np.abs(d), 0, None)
_RISE = lambda d: np.where(d >= 0, -1.0, 1.0)  # noqa: E731  (by the place, of the voxel below and above it)
#: Weights of a linear sample and of its slope along each axis.
_LOOK = {"b": [_UP, _UP, _UP], **{f"g{a}": [_RISE if k == j else _UP for j in range(3)] for k, a in enumerate(AXES)}}


def moved_samples(fixed: DataFrame, moving: DataFrame, dims: tuple[int, int, int], center: np.ndarray, v: np.ndarray) -> DataFrame:
    """(a, b, q0 … q5): each voxel of fixed (x, y, z, v), what moving has at its moved place (0 outside), and
    the derivatives of that by the three angles and three shifts; one look over blocks with a halo."""
    x, y, z = v[:3]
    names = [f"o{a}" for a in AXES]  # of their own: fixed and moving may come of one frame
    p = [F.col(a).cast("double") for a in names]
    moved = Rigid(v[:3], v[3:], center).columns(p)
    points = fixed.select(*[F.col(a).alias(n) for a, n in zip(AXES, names, strict=True)], F.col("v").cast("double").alias("a"))
    seen = sample_blocks(points, moving, dict(zip(AXES, moved, strict=True)), dict(zip(AXES, dims, strict=True)), [*names, "a"], [0, 1], np.floor, _LOOK, "zero")
    turned = [rotation(x, 0, 0) @ _TURNS[0] @ rotation(0, y, z), rotation(x, y, 0) @ _TURNS[1] @ rotation(0, 0, z), rotation(x, y, z) @ _TURNS[2]]
    d = [p[k] - F.lit(float(center[k])) for k in range(3)]
    by_angle = [sum((F.col(f"g{AXES[r]}") * (d[0] * float(t[r, 0]) + d[1] * float(t[r, 1]) + d[2] * float(t[r, 2])) for r in range(3)), F.lit(0.0)) for t in turned]
    return seen.select("a", "b", *[q.alias(f"q{k}") for k, q in enumerate([*by_angle, *[F.col(f"g{a}") for a in AXES]])])


def rigid_cost_over(metric: Metric, fixed: DataFrame, moving: DataFrame, dims: tuple[int, int, int], center: np.ndarray, v: np.ndarray, spans: tuple[Span, Span] | None = None) -> tuple[float, np.ndarray]:
    """rigid_cost over images of any size: the correlation and its slopes are one aggregate; an
    information takes two over samples that are stored in between, the joint histogram and then its chain rule.

    spans: the ranges of fixed's values and of moving's samples, for an information.
    """
    rows = moved_samples(fixed, moving, dims, center, v)
    if isinstance(metric, Correlation):
        a, b = F.col("a"), F.col("b")
        parts = [F.count("*"), F.sum(a), F.sum(b), F.sum(a * a), F.sum(b * b), F.sum(a * b)]
        parts += [F.sum(f(F.col(f"q{k}"))) for f in (lambda q: q, lambda q: a * q, lambda q: b * q) for k in range(6)]
        s = np.array(rows.agg(*[c.cast("double") for c in parts]).first(), float)
        n, sa, sb = s[:3]
        saa, sbb, sab = s[3] - sa * sa / n, s[4] - sb * sb / n, s[5] - sa * sb / n
        q, aq, bq = s[6:12], s[12:18] - sa / n * s[6:12], s[18:24] - sb / n * s[6:12]
        d = math.sqrt(max(saa * sbb, 0.0))
        if not d:
            return 0.0, np.zeros_like(q)
        r = sab / d
        return -abs(r), -np.sign(r) * (aq / d - r * bq / sbb)
    rows, (of_a, of_b) = settled(rows), spans
    m = Information(metric.kind, metric.bins, metric.radius)

    def joint(batches):
        total = np.zeros((m.bins, m.bins))
        for batch in batches:
            (ia, wa, _), (ib, wb, _) = m._spread(batch["a"].to_numpy(), of_a), m._spread(batch["b"].to_numpy(), of_b)
            cell = ia[:, :, None] * m.bins + ib[:, None, :]
            total += np.bincount(cell.ravel(), (wa[:, :, None] * wb[:, None, :]).ravel(), m.bins**2).reshape(m.bins, m.bins)
        yield pd.DataFrame({"i": np.arange(m.bins), "sums": list(total)})

    table = summed(rows.mapInPandas(joint, "i int, sums array<double>"), m.bins)
    whole = table.sum()
    cost, by_cell = m.of_joint(table / whole)

    def chain(batches):
        total = np.zeros(6)
        for batch in batches:
            (ia, wa, _), (ib, _, db) = m._spread(batch["a"].to_numpy(), of_a), m._spread(batch["b"].to_numpy(), of_b)
            by_value = (by_cell[ia[:, :, None], ib[:, None, :]] * wa[:, :, None] * db[:, None, :]).sum((1, 2)) / whole
            total += by_value @ batch[[f"q{k}" for k in range(6)]].to_numpy()
        yield pd.DataFrame({"i": [0], "sums": [total]})

    slope = summed(rows.mapInPandas(chain, "i int, sums array<double>"), 6)
    return cost, slope[0]


def register_images(fixed: DataFrame, moving: DataFrame, dims: tuple[int, int, int], metric: Metric = correlation_metric, sigmas: tuple[float, ...] = (3, 1, 0), start: Rigid | None = None, rounds: int = 40) -> Rigid:
    """register_rigid for images (x, y, z, v) of any size: every step of the descent is an aggregate over blocks."""
    center = (np.array(dims) - 1) / 2
    x = np.zeros(6) if start is None else np.concatenate([start.angles, start.shift])
    scale = np.array([0.01] * 3 + [1.0] * 3)
    for sigma in sigmas:
        a, b = fixed.select(*AXES, "v"), moving.select(*AXES, "v")
        if sigma > 0:
            a, b = (gaussian_smooth_nd(i, AXES, list(dims), sigma, reach=max(1, int(3 * sigma))) for i in (a, b))
        step = max(1, int(sigma))
        b = settled(b)
        a = settled(a.filter(" and ".join(f"{c} % {step} = 0" for c in AXES)))
        ends = [i.agg(F.min("v"), F.max("v")).first() for i in (a, b)]
        spans = (tuple(ends[0]), (min(ends[1][0], 0.0), max(ends[1][1], 0.0)))

        def descent(u: np.ndarray, a=a, b=b, spans=spans) -> tuple[float, np.ndarray]:
            value, slope = rigid_cost_over(metric, a, b, dims, center, u * scale, spans)
            return value, slope * scale

        x = lbfgs(descent, x / scale, rounds, stop_gradient=1e-7, stop_x=1e-4, first_step=0.5) * scale
    return Rigid(x[:3], x[3:], center).inverse()


def register_series(volumes: DataFrame, reference: DataFrame, dims: tuple[int, int, int], metric: Metric = correlation_metric, sigmas: tuple[float, ...] = (3, 1)) -> DataFrame:
    """(t, rx, ry, rz, sx, sy, sz): each volume of a 4-D image to a reference volume; a volume is one task."""
    from ..model import to_numpy

    fixed = to_numpy(reference, dims)  # one volume

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        moving = np.zeros(dims)
        moving[rows["x"], rows["y"], rows["z"]] = rows["v"]
        m = register_rigid(fixed, moving, metric, sigmas).inverse()
        r = m.matrix
        angles = (math.atan2(-r[1, 2], r[2, 2]), math.asin(max(-1.0, min(1.0, r[0, 2]))), math.atan2(-r[0, 1], r[0, 0]))
        return pd.DataFrame([(key[0], *angles, *m.shift)], columns=["t", "rx", "ry", "rz", "sx", "sy", "sz"])

    return volumes.groupBy("t").applyInPandas(run, "t int, rx double, ry double, rz double, sx double, sy double, sz double")


def spline_matrix(n: int, knots: int) -> np.ndarray:
    """Cubic B-spline weights of n places on equally spaced knots over their extent."""
    gap = (n - 1) / (knots - 3) if knots > 3 else float(n)
    u = np.arange(n)[:, None] / gap - (np.arange(knots)[None, :] - 1)
    return cubic_spline(u)


def correct_distortion(fixed: np.ndarray, moving: np.ndarray, axis: int = 1, knots: int = 6, metric: Metric | None = None, jacobian: float = 1e-4, bending: float = 1e-4, rounds: int = 60, sigmas: tuple[float, ...] = (2, 0)) -> tuple[np.ndarray, np.ndarray]:
    """Displacement along one axis as a B-spline field that matches moving to fixed; (field, corrected).

    Intensities are scaled by the Jacobian of the displacement; bending and Jacobian penalties
    keep the field smooth. All knots descend together, from smoothed volumes to plain ones, at most
    ``rounds`` steps each. The volumes fit one machine.

    moving may have a fourth dimension, the probabilities of classes (of tissues, say): then the joint
    histogram of fixed and classes is weighted by them, and they aren't scaled.
    """
    classed = moving.ndim == 4
    metric = metric or (ClassInformation("mi") if classed else information_metric("mi"))
    w = [spline_matrix(n, knots) for n in fixed.shape]
    slopes = [np.gradient(m, axis=0) if k == axis else m for k, m in enumerate(w)]
    cells = np.indices(fixed.shape).reshape(3, -1).T.astype(float)
    second = np.diff(np.eye(knots), 2, axis=0)

    def field_of(c: np.ndarray, by: list[np.ndarray] = w) -> np.ndarray:
        return np.einsum("ai,bj,ck,ijk->abc", *by, c.reshape((knots,) * 3), optimize=True)

    def to_knots(v: np.ndarray, by: list[np.ndarray] = w) -> np.ndarray:
        return np.einsum("ai,bj,ck,abc->ijk", *by, v, optimize=True).ravel()

    def corrected(c: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The stretched image, the plain one, its slope along the axis, and the stretch; a last axis of classes."""
        at = cells.copy()
        at[:, axis] += field_of(c).ravel()
        seen = [sample_slope(image[..., k], at) for k in range(image.shape[3])]
        plain = np.stack([v for v, _ in seen], 1).reshape(*fixed.shape, -1)
        slope = np.stack([g[:, axis] for _, g in seen], 1).reshape(*fixed.shape, -1)
        stretch = 1 + field_of(c, slopes)
        return plain if classed else plain * stretch[..., None], plain, slope, stretch

    def flat(made: np.ndarray) -> np.ndarray:
        return made.reshape(-1, made.shape[3]) if classed else made.ravel()

    def penalty(c: np.ndarray, stretch: np.ndarray) -> tuple[float, np.ndarray]:
        k = c.reshape((knots,) * 3)
        cost, by_knot = jacobian * float(((stretch - 1) ** 2).mean()), to_knots(2 * jacobian * (stretch - 1) / stretch.size, slopes)
        for a in range(3):
            bend = np.tensordot(second, k, (1, a))  # second differences, that axis first
            if bend.size:
                cost += bending * float((bend**2).mean())
                by_knot = by_knot + np.moveaxis(np.tensordot(second.T, 2 * bending * bend / bend.size, (1, 0)), 0, a).ravel()
        return cost, by_knot

    c, planes = np.zeros(knots**3), moving if classed else moving[..., None]
    for sigma in sigmas:
        target, image = _smooth(fixed, sigma).ravel(), np.stack([_smooth(planes[..., k], sigma) for k in range(planes.shape[3])], 3)

        def cost(c: np.ndarray, target=target, image=image) -> float:
            made, _, _, stretch = corrected(c, image)
            return metric(target, flat(made)) + penalty(c, stretch)[0]

        def descent(c: np.ndarray, target=target, image=image, cost=cost) -> tuple[float, np.ndarray]:
            if not hasattr(metric, "slope"):
                return cost(c), numeric_gradient(cost, c, np.full(len(c), 0.02))
            made, plain, slope, stretch = corrected(c, image)
            value, by_value = metric.slope(target, flat(made))
            by_value = by_value.reshape(made.shape)
            more, by_knot = penalty(c, stretch)
            moved = (by_value * slope).sum(3)
            if classed:
                return value + more, to_knots(moved) + by_knot
            return value + more, to_knots(moved * stretch) + to_knots((by_value * plain).sum(3), slopes) + by_knot

        # at a field of 0 every sample is a voxel, where an information of interpolated classes has a low of its
        # own: the first descent starts a little to either side, and the better one counts
        starts = [c + s for s in (0.3, -0.3)] if classed and not c.any() else [c]
        c = min((lbfgs(descent, s, rounds, stop_gradient=1e-7, stop_x=1e-3) for s in starts), key=cost)
    out = corrected(c, planes)[0]
    return field_of(c), out if classed else out[..., 0]


# ---- deformations ------------------------------------------------------------------


def index_map_to_offsets(field_: DataFrame, one_based: bool = False) -> DataFrame:
    """(x, y, z, dx, dy, dz) from absolute indices (ix, iy, iz)."""
    shift = 1 if one_based else 0
    return field_.select(*AXES, *[(F.col(f"i{a}") - shift - F.col(a)).alias(f"d{a}") for a in AXES])


def reorient_vectors(field_: DataFrame, geo: Geometry) -> DataFrame:
    moved = geo.orient([F.col(f"d{a}") for a in AXES])
    return field_.select(*AXES, *[c.alias(f"d{a}") for a, c in zip(AXES, moved, strict=True)])


def jacobian(field_: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """(x, y, z, det): determinant of identity plus the finite differences of the offsets, one-sided at the border."""

    def work(*views, first: tuple[int, ...]):
        m = np.empty((*views[0]((0, 0, 0)).shape, 3, 3))
        for c in range(3):
            step = tuple(int(k == c) for k in range(3))
            back = tuple(-k for k in step)
            at = first[c] + np.arange(m.shape[c])
            n = ((at > 0).astype(int) + (at < dims[c] - 1)).reshape([-1 if k == c else 1 for k in range(3)])
            for r, see in enumerate(views):
                m[..., r, c] = (see(step) - see(back)) / np.maximum(n, 1) + (r == c)
        return [np.linalg.det(m)]

    rows = field_.select(*AXES, *[F.col(f"d{a}").cast("double").alias(f"d{a}") for a in AXES])
    return around(rows, list(AXES), list(dims), 1, "det double", work, [f"d{a}" for a in AXES])


def apply_deformation(image: DataFrame, field_: DataFrame, dims: tuple[int, int, int], kind: str = "lanczos", absolute: bool = False) -> DataFrame:
    """Each voxel takes the image's value at its index plus offset (or at the stored index)."""
    at = {a: (F.col(f"i{a}") if absolute else F.col(a) + F.col(f"d{a}")) for a in AXES}
    keys = field_.select(*[F.col(a).alias(f"o{a}") for a in AXES], *[at[a].alias(f"u{a}") for a in AXES])
    out = interpolate(keys, image, {a: F.col(f"u{a}") for a in AXES}, dict(zip(AXES, dims, strict=True)), [f"o{a}" for a in AXES], kind, "zero")
    return out.select(*[F.col(f"o{a}").alias(a) for a in AXES], "v")


def invert_deformation(field_: DataFrame, dims: tuple[int, int, int], rounds: int = 30, tolerance: float = 1e-3) -> DataFrame:
    """(x, y, z, dx, dy, dz, residual): offsets of the inverse, and how far forward of them misses the voxel.

    The displaced voxels are indexed by a tree; each voxel starts at the one that comes to lie nearest to
    it and goes on by Newton steps of the interpolated field, halved where they lead away. Only what
    isn't within the tolerance goes into the next round. A residual above it says that no place was
    found: none comes to lie there, or the field folds.
    """
    index = sum((F.col(a).cast("long") * int(np.prod(dims[k + 1 :])) for k, a in enumerate(AXES)), F.lit(0).cast("long"))
    field_ = settled(field_.select(*AXES, *[F.col(f"d{a}").cast("double").alias(f"d{a}") for a in AXES]))
    moved = field_.select(index.alias("id"), F.array(*[F.col(a) + F.col(f"d{a}") for a in AXES]).alias("p"))
    targets = field_.select(index.alias("id"), F.array(*[F.col(a).cast("double") for a in AXES]).alias("p"))
    near = tree.nearest(tree.build(moved), targets)
    at = lambda c, k: F.pmod(F.floor(F.col(c) / int(np.prod(dims[k + 1 :]))), F.lit(dims[k])).cast("double")
    zero = F.lit(0.0)
    state = near.select(*[at("id", k).alias(f"o{a}") for k, a in enumerate(AXES)], *[at("nearest_id", k).alias(f"u{a}") for k, a in enumerate(AXES)], *[at("nearest_id", k).alias(f"b{a}") for k, a in enumerate(AXES)], *[zero.alias(f"s{a}") for a in AXES], F.lit(math.inf).alias("residual"))
    names = state.columns
    look = {f"f{a}": (f"d{a}", [_UP] * 3) for a in AXES} | {f"f{a}{b}": (f"d{a}", [_RISE if k == j else _UP for j in range(3)]) for a in AXES for k, b in enumerate(AXES)}

    def step(batches):
        for b in batches:
            o, u, best, last = (b[[f"{c}{a}" for a in AXES]].to_numpy() for c in "oubs")
            miss = u + b[[f"f{a}" for a in AXES]].to_numpy() - o
            far, held = np.sqrt((miss * miss).sum(1)), b["residual"].to_numpy()
            slope = np.eye(3) + b[[f"f{r}{c}" for r in AXES for c in AXES]].to_numpy().reshape(-1, 3, 3)
            flat = np.abs(np.linalg.det(slope)) < 1e-6
            slope[flat] = np.eye(3)
            newton = -np.linalg.solve(slope, miss[..., None])[..., 0]
            newton /= np.maximum(np.sqrt((newton * newton).sum(1, keepdims=True)) / 2, 1.0)  # two voxels at most
            better = (far < held)[:, None]
            best, last = np.where(better, u, best), np.where(better, newton, last / 2)
            found = np.hstack([o, best + last, best, last, np.minimum(far, held)[:, None]])
            yield pd.DataFrame(found, columns=names)

    kinds, done, sizes = ", ".join(f"{n} double" for n in names), [], dict(zip(AXES, dims, strict=True))
    state = settled(state)
    for turn in range(rounds):
        seen = sample_blocks(state, field_, {a: F.col(f"u{a}") for a in AXES}, sizes, names, [0, 1], np.floor, look, "clamp")
        now = settled(seen.mapInPandas(step, kinds))
        late = turn + 1 == rounds
        done.append(now if late else now.filter(F.col("residual") <= tolerance))
        state = now.filter(F.col("residual") > tolerance)
        if late or state.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(*[F.col(f"o{a}").cast("int").alias(a) for a in AXES], *[(F.col(f"b{a}") - F.col(f"o{a}")).alias(f"d{a}") for a in AXES], "residual")


# ---- bias fields -------------------------------------------------------------------


def bias_field(image: DataFrame, dims: tuple[int, int, int], knots: int = 4, ridge: float = 1e-3, weight: Column | None = None) -> tuple[np.ndarray, DataFrame]:
    """Smooth field of log intensity by weighted least squares on B-spline knots; (knots, x y z bias).

    Each voxel touches 4³ knots; the normal equations of the separable basis are summed in
    tasks and solved on the driver (knots³ unknowns).
    """
    from collections.abc import Iterator

    import pandas as pd

    w = [spline_matrix(n, knots) for n in dims]
    size = knots**3

    def basis(x, y, z) -> np.ndarray:
        return np.einsum("ni,nj,nk->nijk", w[0][x], w[1][y], w[2][z]).reshape(len(x), size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size + 1))
        for b in batches:
            for lo in range(0, len(b), 20_000):
                p = b.iloc[lo : lo + 20_000]
                a = basis(*(p[c].to_numpy() for c in AXES))
                total += (a * p["w"].to_numpy()[:, None]).T @ np.column_stack([a, p["log"].to_numpy()])
        yield pd.DataFrame({"i": np.arange(size), "sums": list(total)})

    rows = image.filter("v > 0").select(*AXES, F.log("v").alias("log"), (weight if weight is not None else F.lit(1.0)).cast("double").alias("w"))
    mean = rows.agg(F.sum(F.col("log") * F.col("w")) / F.sum("w")).first()[0]
    m = summed(rows.withColumn("log", F.col("log") - mean).mapInPandas(run, "i int, sums array<double>"), size + 1)
    c = np.linalg.solve(m[:, :size] + ridge * np.trace(m[:, :size]) / size * np.eye(size), m[:, size])

    def rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b[AXES].assign(bias=np.exp(basis(*(b[a].to_numpy() for a in AXES)) @ c))

    return c.reshape((knots,) * 3), image.select(*AXES).mapInPandas(rebuild, "x int, y int, z int, bias double")


def log_normalized(image: DataFrame, mask: DataFrame, axes: list[str] | None = None) -> DataFrame:
    """log(v / mean of v inside the mask), 0 outside the mask (above one half is inside) and where v is not positive."""
    axes = axes or AXES
    both = image.select(*axes, "v").join(mask.select(*axes, (F.col("v") > 0.5).alias("_in")), axes, "left")
    mean = both.agg(F.avg(F.when(F.col("_in"), F.col("v"))).alias("_mean"))  # one row
    ratio = F.col("v") / F.col("_mean")
    return both.crossJoin(F.broadcast(mean)).select(*axes, F.when(F.col("_in") & (ratio > 0), F.log(ratio)).otherwise(F.lit(0.0)).alias("v"))


def bias_inputs(image: DataFrame, mask: DataFrame, geo: Geometry, spacing: float) -> tuple[DataFrame, DataFrame]:
    """What a bias field is fitted to: the log-normalised image and its mask (0 or 1) on a coarser isotropic grid."""
    from .spectral import resample

    ratios = {a: float(s) / spacing for a, s in zip(AXES, geo.spacing, strict=False)}
    down = resample(log_normalized(image, mask), ratios)
    at = {a: F.col(a) / F.lit(r) for a, r in ratios.items()}
    inside = interpolate(down.select(*AXES), mask, at, dict(zip(AXES, geo.dims, strict=False)), AXES, "linear", "zero")
    return down, inside.withColumn("v", (F.col("v") > 0.5).cast("double"))


def correct_bias(image: DataFrame, dims: tuple[int, int, int], knots: int = 4, ridge: float = 1e-3) -> DataFrame:
    _, field_ = bias_field(image, dims, knots, ridge)
    return image.join(field_, AXES).withColumn("v", F.col("v") / F.col("bias")).drop("bias")


def spline_reconstruct(knots: DataFrame, cells: DataFrame, spacing: float, axes: list[str]) -> DataFrame:
    """Cubic B-spline values of cells from knots (axes, c), missing knots as 0: cells meet blocks of knots."""
    ends = knots.agg(*[F.min(a) for a in axes], *[F.max(a) for a in axes]).first()
    if ends[0] is None:
        return cells.select(*axes, F.lit(0.0).alias("v"))
    first = dict(zip(axes, ends[: len(axes)], strict=True))
    sizes = {a: last - first[a] + 1 for a, last in zip(axes, ends[len(axes) :], strict=True)}
    placed = knots.select(*[(F.col(a) - first[a]).alias(a) for a in axes], F.col("c").alias("v"))
    return interpolate(cells, placed, {a: F.col(a) / F.lit(spacing) - first[a] for a in axes}, sizes, axes, "bspline", "zero")
