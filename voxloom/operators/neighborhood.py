"""Neighbourhood operators: derivatives, smoothing, rank filters, morphology, z-scores, components.

Along one axis these are window frames. In N dimensions they work on blocks of voxels with a
halo: one shuffle of little more than the image, no self-join. ``edge`` decides what stands
outside: "clamp" repeats the border, "zero" leaves it out.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled
from .blocks import around, block_edge


# ---- along one axis ----------------------------------------------------------------


def derivative(df: DataFrame, value: str, order: list[str], by: list[str] | None = None, out: str = "derivative") -> DataFrame:
    """Central difference, one-sided at the ends; differences below 1e-11 count as 0."""
    w = Window.partitionBy(*(by or [])).orderBy(*order)
    prev, nxt = F.lag(value).over(w), F.lead(value).over(w)
    dy = F.coalesce(nxt, F.col(value)) - F.coalesce(prev, F.col(value))
    dx = nxt.isNotNull().cast("int") + prev.isNotNull().cast("int")
    return df.withColumn(out, F.when((dx == 0) | (F.abs(dy) < 1e-11), F.lit(0.0)).otherwise(dy / F.greatest(dx, F.lit(1))))


def gaussian_weights(sd: float, radius: int) -> list[float]:
    w = [math.exp(-(k * k) / (2 * sd * sd)) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def gaussian_smooth(df: DataFrame, value: str, order: list[str], sd: float, by: list[str] | None = None, edge: str = "zero", out: str = "smooth", radius: int | None = None) -> DataFrame:
    """Gaussian along an order. zero: radius 3 sd, the edge attenuates; clamp: radius 2 sd rounded."""
    radius = radius if radius is not None else (int(3 * sd) if edge == "zero" else int(2 * sd + 0.5))
    w = Window.partitionBy(*(by or [])).orderBy(*order)
    total = F.lit(0.0)
    for k, weight in zip(range(-radius, radius + 1), gaussian_weights(sd, radius), strict=True):
        seen = F.lead(value, k).over(w) if k > 0 else F.lag(value, -k).over(w) if k < 0 else F.col(value)
        if edge == "clamp":
            whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            seen = F.coalesce(seen, (F.last(value) if k > 0 else F.first(value)).over(whole))
        total = total + F.coalesce(seen, F.lit(0.0)) * F.lit(weight)
    return df.withColumn(out, total)


def median_filter(df: DataFrame, value: str, order: list[str], by: list[str] | None = None, radius: int = 1, out: str = "median") -> DataFrame:
    """Middle of the sorted 2r+1 values, the border repeated."""
    w = Window.partitionBy(*(by or [])).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = [F.coalesce(F.lead(value, k).over(w), F.last(value).over(whole)) if k > 0 else F.coalesce(F.lag(value, -k).over(w), F.first(value).over(whole)) if k < 0 else F.col(value) for k in range(-radius, radius + 1)]
    return df.withColumn(out, F.element_at(F.sort_array(F.array(*seen)), radius + 1))


def erode_1d(df: DataFrame, mask: str, order: list[str], by: list[str] | None = None, radius: int = 1, out: str = "eroded") -> DataFrame:
    w = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(-radius, radius)
    return df.withColumn(out, F.when(F.min((F.col(mask) != 0).cast("int")).over(w) == 1, F.col(mask)).otherwise(F.lit(0)))


def dilate_1d(df: DataFrame, mask: str, order: list[str], by: list[str] | None = None, radius: int = 1, out: str = "dilated") -> DataFrame:
    """The first non-zero value of the frame where the value itself is 0."""
    w = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(-radius, radius)
    first = F.first(F.when(F.col(mask) != 0, F.col(mask)), ignorenulls=True).over(w)
    return df.withColumn(out, F.when(F.col(mask) != 0, F.col(mask)).otherwise(F.coalesce(first, F.lit(0))))


def connected_runs(df: DataFrame, value: str, order: list[str], by: list[str] | None = None, out: str = "run") -> DataFrame:
    """Number of the maximal run of equal values, from 1 within each group."""
    w = Window.partitionBy(*(by or [])).orderBy(*order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_change", change).withColumn(out, F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_change")


def longest_run(df: DataFrame, inside: str, order: list[str], by: list[str]) -> DataFrame:
    """Length and first place (from 1) of each group's longest run of a true condition, the first of several."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = df.select(*by, F.col(inside).alias("_in"), F.row_number().over(w).alias("_i"), (F.row_number().over(w) - F.row_number().over(Window.partitionBy(*by, inside).orderBy(*order))).alias("_island"))
    runs = marked.filter("_in").groupBy(*by, "_island").agg(F.count("*").alias("length"), F.min("_i").alias("start"))
    return runs.groupBy(*by).agg(F.max("length").alias("length"), F.min_by("start", F.struct((-F.col("length")).alias("l"), "start")).alias("start"))


def standardize(df: DataFrame, value: str, out: str = "z") -> DataFrame:
    """z-score over the whole table: one row of moments, joined by broadcast."""
    one = df.agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return df.join(F.broadcast(one)).withColumn(out, F.try_divide(F.col(value) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def normalize_series(df: DataFrame, value: str, by: list[str], out: str = "z") -> DataFrame:
    """z-score of each series, 0 for a constant one. Moments are aggregated before they meet the rows."""
    one = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    z = F.when(F.coalesce(F.col("_s"), F.lit(0.0)) <= 2.220446049250313e-16, F.lit(0.0)).otherwise(F.try_divide(F.col(value) - F.col("_m"), F.col("_s")))
    return df.join(one, by).withColumn(out, z).drop("_m", "_s")


# ---- in N dimensions ---------------------------------------------------------------


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _offsets(radius: int, axes: list[str], ball: float | None = None) -> list[tuple[int, ...]]:
    cube = itertools.product(range(-radius, radius + 1), repeat=len(axes))
    return [o for o in cube if ball is None or sum(k * k for k in o) < ball * ball or not any(o)]


def median_filter_nd(df: DataFrame, axes: list[str], dims: list[int], value: str = "v", keep: list[str] | None = None) -> DataFrame:
    """Median of the 3^n voxels around each."""
    offsets = _offsets(1, axes)
    half = len(offsets) // 2
    return around(df, axes, dims, 1, f"{value} {_kind(df, value)}", lambda see: [np.partition(np.stack([see(o) for o in offsets]), half, axis=0)[half]], value, keep)


def sobel(df: DataFrame, axes: list[str], dims: list[int], value: str = "v", keep: list[str] | None = None) -> DataFrame:
    """Derivative along each axis, averaged over the others: columns d_<axis>."""
    slope, mean = {-1: -0.5, 0: 0.0, 1: 0.5}, {-1: 0.25, 0: 0.5, 1: 0.25}

    def work(see):
        sums = [0.0] * len(axes)
        for off in _offsets(1, axes):
            seen = see(off)
            for j in range(len(axes)):
                if off[j]:
                    sums[j] = sums[j] + seen * math.prod(slope[o] if i == j else mean[o] for i, o in enumerate(off))
        return sums

    return around(df, axes, dims, 1, ", ".join(f"d_{a} double" for a in axes), work, value, keep)


def erode(df: DataFrame, axes: list[str], dims: list[int], radius: int, value: str = "v", block: bool = False, keep: list[str] | None = None) -> DataFrame:
    """0 where any neighbour within the ball (or box) is 0, else the value."""
    offsets = _offsets(radius, axes, None if block else radius)

    def work(see):
        whole = np.logical_and.reduce([see(o) != 0 for o in offsets])
        return [see((0,) * len(axes)) * whole]

    return around(df, axes, dims, radius, f"{value} {_kind(df, value)}", work, value, keep)


def dilate(df: DataFrame, axes: list[str], dims: list[int], radius: int, value: str = "v", block: bool = False, keep: list[str] | None = None) -> DataFrame:
    """The first (box: last) non-zero neighbour in kernel order; 0 if there is none."""
    offsets = _offsets(radius, axes, None if block else radius)

    def work(see):
        out = np.zeros_like(see((0,) * len(axes)))
        for off in offsets[::-1] if block else offsets:
            out = np.where(out == 0, see(off), out)
        return [out]

    return around(df, axes, dims, radius, f"{value} {_kind(df, value)}", work, value, keep)


def gaussian_smooth_nd(df: DataFrame, axes: list[str], dims: list[int], sd: float | list[float], value: str = "v", edge: str = "clamp", keep: list[str] | None = None, reach: int | None = None) -> DataFrame:
    """Separable Gaussian, of one width or one for each axis; the radius (reach) is 2 sd rounded, or 3 sd where nothing is outside (edge="zero")."""
    widths = [float(sd)] * len(axes) if isinstance(sd, int | float) else [float(x) for x in sd]
    radii = [reach if reach is not None else int(3 * w) if edge == "zero" else int(2 * w + 0.5) for w in widths]
    weights, most = [gaussian_weights(w, r) for w, r in zip(widths, radii, strict=True)], max(radii)

    def work(see):
        out = see.padded.astype(float)
        for axis, (radius, own) in enumerate(zip(radii, weights, strict=True)):
            n = out.shape[axis] - 2 * most
            out = sum(w * out.take(np.arange(most - radius + k, most - radius + k + n), axis) for k, w in enumerate(own))
        return [out]

    return around(df.select(*(keep or []), *axes, F.col(value).cast("double").alias(value)), axes, dims, most, f"{value} double", work, value, keep, edge)


# ---- components --------------------------------------------------------------------


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component): smallest id reachable over edges (a, b).

    Rounds on stored tables until every component is a star round its smallest node. The smallest
    neighbours are stored before they are joined, so adaptive execution may broadcast them
    or split a hub's rows.
    """
    current = settled(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u < v").distinct())
    while True:
        ways = current.unionByName(current.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = settled(ways.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"), F.count_if(F.col("u") < F.col("v")).alias("below"), F.count_if(F.col("u") > F.col("v")).alias("above")))
        if low.filter("below > 1 or below > 0 and above > 0").isEmpty():
            found = low.select(F.col("v").alias("id"), F.col("m").alias("component"))
            break
        large = settled(ways.filter("u > v").join(low.filter("above > 0").select("v", "m"), "v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("u < v").distinct())
        least = settled(large.groupBy("v").agg(F.min("u").alias("m")))
        small = large.join(least, "v").select("m", F.explode(F.array("u", "v")).alias("v"))
        current = settled(small.select("v", F.col("m").alias("u")).filter("u < v").distinct())
    if nodes is None:
        return found
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _block_roots(same: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """The smallest place linked to each of n places: hooking of roots and pointer jumping."""
    root = np.arange(n)
    a = np.concatenate([x for x, _ in same])
    b = np.concatenate([y for _, y in same])
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]


def relabel_connected(df: DataFrame, axes: list[str], dims: list[int], value: str = "v") -> DataFrame:
    """Face-connected components of equal value among the rows, numbered by their first voxel (column label).

    Each block links its own voxels; only pairs of voxels on both sides of a block's face go on to
    the rounds, as pairs of the blocks' components, so their rows grow with the faces. A null
    value counts as 0.
    """
    stride = [int(np.prod(dims[k + 1 :], dtype=np.int64)) for k in range(len(dims))]
    kind = _kind(df, value)

    def work(see, here, first: tuple[int, ...]):
        core = (0,) * len(axes)
        v, inside = see(core), here(core) > 0
        place = np.arange(v.size).reshape(v.shape)
        flat = sum(np.arange(n).reshape([-1 if k == i else 1 for k in range(v.ndim)]) * s for i, (n, s) in enumerate(zip(v.shape, stride, strict=True))) + sum(f * s for f, s in zip(first, stride, strict=True))
        flat = np.broadcast_to(flat, v.shape)
        same, across = [(np.zeros(0, np.int64),) * 2], np.empty(v.shape, object)
        found: dict[int, list[int]] = {}
        for i in range(v.ndim):
            step = tuple(int(k == i) for k in range(v.ndim))
            linked = inside & (here(step) > 0) & (v == see(step))
            within = tuple(slice(0, -1) if k == i else slice(None) for k in range(v.ndim))
            behind = tuple(slice(1, None) if k == i else slice(None) for k in range(v.ndim))
            same.append((place[within][linked[within]], place[behind][linked[within]]))
            last = tuple(slice(-1, None) if k == i else slice(None) for k in range(v.ndim))
            if first[i] + v.shape[i] < dims[i]:  # not the image's end, where the border repeats itself
                for k in place[last][linked[last]].tolist():
                    found.setdefault(k, []).append(int(flat.flat[k]) + stride[i])
        for k, ids in found.items():
            across.flat[k] = ids
        roots = flat.ravel()[_block_roots(same, v.size)].reshape(v.shape)
        return [v, flat, roots, across]

    rows = df.select(*axes, value).withColumn("_here", F.lit(1))
    cells = settled(around(rows, axes, dims, 1, f"{value} {kind}, _id long, _root long, _across array<long>", work, [value, "_here"]))
    edge = block_edge(len(axes))
    on_face = reduce(lambda x, y: x | y, [F.pmod(F.col(a), F.lit(edge)) == 0 for a in axes])
    faces = cells.filter(on_face).select(F.col("_id").alias("_other"), F.col("_root").alias("b"))
    links = cells.filter("_across is not null").select(F.col("_root").alias("a"), F.explode("_across").alias("_other"))
    joined = connected_components(links.join(faces, "_other").select("a", "b").distinct())
    label = F.coalesce("component", "_root").alias("label")
    return cells.join(joined.withColumnRenamed("id", "_root"), "_root", "left").select(*axes, value, label)


# ---- responses ---------------------------------------------------------------------


def causal_convolve(ts: Column, kernel: list[float]) -> Column:
    """Causal convolution of a packed series: out[i] = sum over j of in[i-j] kernel[j]."""
    taps = F.array(*[F.lit(float(k)) for k in kernel])
    return F.transform(ts, lambda _, i: F.aggregate(F.sequence(F.lit(0), F.least(i, F.lit(len(kernel) - 1))), F.lit(0.0), lambda a, j: a + F.get(ts, i - j) * F.get(taps, j)))


#: Constants of the balloon model: time constants of signal, feedback and transit, stiffness, resting
#: extraction, gain of the input, scale of the output. Flow and volume are kept above TINY, where their powers end.
TAU_S, TAU_F, TAU_0, ALPHA, E_0, GAIN, SCALE, TINY = 1.54, 2.46, 0.98, 0.33, 0.34, 0.7, 0.33, 1e-9


def balloon_response(ts: Column, dt: float, learn: float = 0.0) -> Column:
    """Haemodynamic response of a packed input: Euler steps of the balloon model, one fold.

    State: signal s, inflow f, volume v, deoxygenation q, and the running mean of the input, in which
    the present input weighs ``learn``. An input below its running mean counts as none, so with
    learn = 1 there is no habituation, nor with 0 for inputs that aren't negative.
    """
    one = F.lit(1.0)
    start = F.struct(F.lit(0.0).alias("s"), one.alias("f"), one.alias("v"), one.alias("q"), F.lit(0.0).alias("mean"), F.array().cast("array<double>").alias("out"))

    def step(a: Column, u: Column) -> Column:
        mean = learn * u + (1 - learn) * a["mean"]
        drive = GAIN * F.when(u < mean, F.lit(0.0)).otherwise(u)
        f, v = F.greatest(a["f"], F.lit(TINY)), F.greatest(a["v"], F.lit(TINY))
        out_flow = F.pow(v, F.lit(1 / ALPHA))
        taken = f / E_0 * (1 - F.pow(F.lit(1 - E_0), 1 / f))
        new_v, new_q = a["v"] + dt * (f - out_flow) / TAU_0, a["q"] + dt * (taken - a["q"] * out_flow / v) / TAU_0
        s = a["s"] + dt * (drive - a["s"] / TAU_S - (a["f"] - 1) / TAU_F)
        y = SCALE * (7 * E_0 * (1 - new_q) + 2 * (1 - new_q / new_v) + (2 * E_0 - 0.2) * (1 - new_v))
        return F.struct(s.alias("s"), (a["f"] + dt * a["s"]).alias("f"), new_v.alias("v"), new_q.alias("q"), mean.alias("mean"), F.concat(a["out"], F.array(y)).alias("out"))

    return F.aggregate(ts, start, step, lambda a: a["out"])


def balloon_steps(u: np.ndarray, dt: float, learn: float = 0.0, state: tuple = (0.0, 1.0, 1.0, 1.0, 0.0)) -> tuple[np.ndarray, tuple]:
    """balloon_response of an array from a state (s, f, v, q, mean), and the state behind it."""
    s, f, v, q, mean = state
    out = np.empty(len(u))
    for i, x in enumerate(np.asarray(u, float).tolist()):
        mean = learn * x + (1 - learn) * mean
        drive = GAIN * (0.0 if x < mean else x)
        held, volume = max(f, TINY), max(v, TINY)
        flow = volume ** (1 / ALPHA)
        ds = drive - s / TAU_S - (f - 1) / TAU_F
        dq = (held / E_0 * (1 - (1 - E_0) ** (1 / held)) - q * flow / volume) / TAU_0
        v, q, f, s = v + dt * (held - flow) / TAU_0, q + dt * dq, f + dt * s, s + dt * ds
        out[i] = SCALE * (7 * E_0 * (1 - q) + 2 * (1 - q / v) + (2 * E_0 - 0.2) * (1 - v))
    return out, (s, f, v, q, mean)
