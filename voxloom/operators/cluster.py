"""Clustering and mixtures: k-means, Gaussian mixtures, 1-D mixtures, density peaks.

Centres and mixture parameters are small: they are literals of the plan or constants of the
shipped code, never a join side that grows. Each round is one aggregate over the points.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled
from . import tree
from .spatial import squared_distance
from .sums import summed


def center_literal(center) -> Column:
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in center) + ")")


def assign(points: DataFrame, centers: np.ndarray, p: str = "p", out: str = "cluster") -> DataFrame:
    """points with the number of the nearest centre (the first of several) and its squared distance."""
    scored = F.array(*[F.struct(squared_distance(F.col(p), center_literal(c)).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centers)])
    best = F.array_min(scored)
    return points.withColumn("_best", best).withColumn(out, F.col("_best.k")).withColumn("dist2", F.col("_best.d")).drop("_best")


def update_centers(assigned: DataFrame, dims: int, p: str = "p", cluster: str = "cluster") -> DataFrame:
    return assigned.groupBy(cluster).agg(F.count("*").alias("n"), F.array(*[F.avg(F.get(p, F.lit(k)).cast("double")) for k in range(dims)]).alias("center"))


def seed_centers(points: DataFrame, k: int, p: str = "p", sample: int = 2000, seed: int = 7) -> np.ndarray:
    """k-means++ picks over a bounded sample (the rows with the smallest hashes)."""
    rows = points.select(F.col(p).cast("array<double>").alias("p")).orderBy(F.xxhash64(F.lit(seed), "p")).limit(sample).collect()
    x, rng = np.array([r.p for r in rows]), np.random.default_rng(seed)
    found = [x[rng.integers(len(x))]]
    while len(found) < k:
        d = np.min([((x - c) ** 2).sum(1) for c in found], axis=0)
        found.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
    return np.array(found)


def lloyd(rows: DataFrame, centers: np.ndarray, p: str = "p", rounds: int = 50) -> tuple[np.ndarray, int, bool]:
    """Lloyd rounds over stored rows: the centres, how many rounds there were, and whether no centre moved in the last."""
    for turn in range(rounds):
        fixed = centers.copy()

        def nearest(x: np.ndarray, fixed=fixed) -> tuple[np.ndarray, float]:
            d = (x * x).sum(1)[:, None] - 2 * x @ fixed.T + (fixed * fixed).sum(1)
            return np.eye(len(fixed))[d.argmin(1)], 0.0

        n, sums, _, _ = _moments(rows, p, nearest, len(centers), centers.shape[1], second=False)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], fixed)
        if np.abs(centers - fixed).max() < 1e-9:
            return centers, turn + 1, True
    return centers, rounds, False


def kmeans(points: DataFrame, k: int, p: str = "p", rounds: int = 50, centers: np.ndarray | None = None, seed: int = 7) -> tuple[np.ndarray, DataFrame]:
    """Lloyd rounds until no centre moves, with a warning if some still do after the last; an empty class keeps its centre.

    No point: no centre and no row.
    """
    rows = settled(points.select(F.col(p).cast("array<double>").alias(p)).filter(F.col(p).isNotNull()))  # every round reads it
    if rows.isEmpty():
        return np.zeros((0, 0)), points.limit(0).withColumns({"cluster": F.lit(0), "dist2": F.lit(0.0)})
    centers, _, done = lloyd(rows, np.array(centers if centers is not None else seed_centers(rows, k, p, seed=seed), float), p, rounds)
    if not done:
        warnings.warn(f"centres still move after {rounds} rounds", stacklevel=2)
    return centers, assign(points, centers, p)


def gaussian_mixture(points: DataFrame, k: int, p: str = "p", rounds: int = 100, tolerance: float = 1e-4, seed: int = 7, start: tuple | None = None) -> tuple[dict, DataFrame]:
    """EM with full covariances; moments are summed in each task. Returns parameters and points with ``cluster``.

    start: (means, covariances, weights) to begin with, else centres of ten Lloyd rounds, the whole
    covariance and equal weights. The parameters say under ``converged`` whether the likelihood came to
    rest. No point: empty parameters and no row.
    """
    rows = settled(points.select(F.col(p).cast("array<double>").alias(p)).filter(F.col(p).isNotNull()))  # every round reads it
    if rows.isEmpty():
        return {"mean": np.zeros((0, 0)), "cov": np.zeros((0, 0, 0)), "weight": np.zeros(0), "converged": True}, points.limit(0).withColumn("cluster", F.lit(0))
    if start:
        mean, cov, weight = (np.array(x, float) for x in start)
        d = mean.shape[1]
    else:
        mean, _, _ = lloyd(rows, seed_centers(rows, k, p, seed=seed), p, 10)
        d = mean.shape[1]
        first = _moments(rows, p, lambda x: (np.ones((len(x), 1)), 0.0), 1, d)
        n, m = first[0][0], first[1][0] / first[0][0]
        cov = np.stack([first[2][0] / n - np.outer(m, m) + 1e-6 * np.eye(d)] * k)
        weight = np.full(k, 1 / k)
    last, done = -math.inf, False

    def densities(x: np.ndarray, mean, cov, weight) -> np.ndarray:
        out = np.empty((len(x), k))
        for j in range(k):
            chol = np.linalg.cholesky(cov[j])
            z = np.linalg.solve(chol, (x - mean[j]).T)
            out[:, j] = np.log(max(weight[j], 1e-300)) - 0.5 * (z * z).sum(0) - np.log(np.diag(chol)).sum() - d / 2 * math.log(2 * math.pi)
        return out

    for _ in range(rounds):
        state = (mean.copy(), cov.copy(), weight.copy())

        def expect(x: np.ndarray, state=state) -> tuple[np.ndarray, float]:
            log = densities(x, *state)
            top = log.max(1, keepdims=True)
            total = top + np.log(np.exp(log - top).sum(1, keepdims=True))
            return np.exp(log - total), float(total.sum())

        tau, s1, s2, ll = _moments(rows, p, expect, k, d)
        weight = tau / tau.sum()
        mean = s1 / tau[:, None]
        cov = np.stack([s2[j] / tau[j] - np.outer(mean[j], mean[j]) + 1e-6 * np.eye(d) for j in range(k)])
        done = abs(ll - last) <= tolerance * max(1.0, abs(ll))
        if done:
            break
        last = ll
    fixed = (mean, cov, weight)

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(cluster=densities(np.stack(b[p].to_numpy()).astype(float), *fixed).argmax(1).astype(np.int32))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
    return {"mean": mean, "cov": cov, "weight": weight, "converged": done}, points.mapInPandas(classify, f"{schema}, cluster int")


def _moments(points: DataFrame, p: str, expect: Callable, k: int, d: int, second: bool = True):
    """Weights, first and second moments of k classes and the summed likelihood: partial sums in each task."""
    width = 2 + d + (d * d if second else 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, width))
        for b in batches:
            if len(b):
                x = np.stack(b[p].to_numpy()).astype(float)
                tau, ll = expect(x)
                total[:, 0] += tau.sum(0)
                total[0, 1] += ll
                total[:, 2 : 2 + d] += tau.T @ x
                for j in range(k if second else 0):
                    total[j, 2 + d :] += ((x * tau[:, j : j + 1]).T @ x).ravel()
        yield pd.DataFrame({"i": np.arange(k), "sums": list(total)})

    t = summed(points.select(p).mapInPandas(run, "i int, sums array<double>"), width)
    return t[:, 0], t[:, 2 : 2 + d], t[:, 2 + d :].reshape(k, d, d) if second else None, t[0, 1]


Density = Callable[[float, float, Column], Column]


def mixture_1d(df: DataFrame, value: str, densities: list[Density], mean: list[float], sd: list[float], prior: list[float], rounds: int = 300, clamp: Callable | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM for a mixture of given densities of (mean, sd); stops when means move by under 1 % of sd."""
    mu, sigma, pi = (np.array(a, float) for a in (mean, sd, prior))
    x = F.col(value).cast("double")
    rows = settled(df.filter(x.isNotNull()).select(x.alias("x")))
    for _ in range(rounds):
        parts = [F.coalesce(d(float(mu[j]), float(sigma[j]), F.col("x")), F.lit(0.0)) * float(pi[j]) for j, d in enumerate(densities)]
        scored = rows.select("x", *[p.alias(f"p{j}") for j, p in enumerate(parts)])
        total = sum((F.col(f"p{j}") for j in range(1, len(parts))), F.col("p0"))
        scored = scored.select("x", *[F.coalesce(F.try_divide(F.col(f"p{j}"), total), F.lit(0.0)).alias(f"r{j}") for j in range(len(parts))])
        r = scored.agg(*[e for j in range(len(parts)) for e in (F.sum(f"r{j}"), F.sum(F.col(f"r{j}") * F.col("x")), F.sum(F.col(f"r{j}") * F.col("x") * F.col("x")))]).first()
        s = np.array(r, float).reshape(-1, 3)
        tau = np.maximum(s[:, 0], 1e-12)
        new = s[:, 1] / tau
        spread = np.sqrt(np.maximum(s[:, 2] / tau - new * new, 1e-12))
        if clamp:
            new, spread = clamp(new, spread)
        moved = np.abs(new - mu).max() / spread.min()
        mu, sigma, pi = new, spread, tau / tau.sum()
        if moved < 1e-3:
            break
    return mu, sigma, pi


def gauss_gamma_mixture(df: DataFrame, value: str, mean=(-9.0, 0.0, 9.0), sd=(3.0, 2.0, 3.0), prior=(1 / 3, 1 / 3, 1 / 3), rounds: int = 300):
    """Negative gamma, Gaussian, positive gamma; gammas keep shape >= 3."""
    from ..functions.kernels import gamma_pdf_ms, gaussian_pdf

    def clamp(mu: np.ndarray, sigma: np.ndarray):
        mu[0], mu[2] = min(mu[0], -1e-3), max(mu[2], 1e-3)
        for j in (0, 2):  # shape (mu/sd)^2 of at least 3
            sigma[j] = min(sigma[j], abs(mu[j]) / math.sqrt(3))
        return mu, sigma

    return mixture_1d(df, value, [gamma_pdf_ms, gaussian_pdf, gamma_pdf_ms], list(mean), list(sd), list(prior), rounds, clamp)


# ---- density peaks -----------------------------------------------------------------


def density_peaks(points: DataFrame, radius: float, p: str = "p", leaf_points: int = tree.LEAF_POINTS) -> DataFrame:
    """(id, rho, delta, parent): neighbours within the radius, squared distance to the nearest point of
    higher (rho, id), and that point; the densest point has neither.

    Both come from one tree. Its leaves carry their largest (rho, id): the search for a denser point
    goes by distance and leaves out the leaves that hold none.
    """
    found = tree.build(points, "id", p, leaf_points)
    n = tree.count_within(found, points, radius, "id", p, same=True)
    rows = points.filter(F.col(p).isNotNull()).select("id", p).join(n, "id", "left")
    rho = settled(rows.select("id", p, F.coalesce("n", F.lit(0)).alias("rho")))
    up = tree.nearest(found.over(rho, "id", p, "rho"), rho, "id", p, weight="rho")
    return rho.select("id", "rho").join(up.select("id", F.col("dist2").alias("delta"), F.col("nearest_id").alias("parent")), "id", "left")


def peak_classes(peaks: DataFrame, threshold: float) -> DataFrame:
    """(id, peak): follow parents until delta stands out (mean + threshold · sd) or there is none.

    Pointer jumping: the number of rounds is the logarithm of the longest chain.
    """
    m, s = peaks.agg(F.avg(F.sqrt("delta")), F.stddev_samp(F.sqrt("delta"))).first()
    own = F.col("parent").isNull() | (F.sqrt("delta") >= F.lit((m or 0.0) + threshold * (s or 0.0)))
    hop = settled(peaks.select("id", F.when(own, F.col("id")).otherwise(F.col("parent")).alias("peak")))
    while True:
        nxt = settled(hop.join(hop.select(F.col("id").alias("peak"), F.col("peak").alias("next")), "peak").select("id", F.col("next").alias("peak")))
        if nxt.join(hop, ["id", "peak"], "left_anti").isEmpty():
            return nxt
        hop = nxt


def segment(features: DataFrame, k: int, dims: int, standardize: bool = True, mixture: bool = False) -> DataFrame:
    """Voxel features (id, p) to classes: optional scaling by population deviation, then k-means or a mixture."""
    if standardize:
        row = features.agg(*[f(F.get("p", F.lit(j)).cast("double")) for j in range(dims) for f in (F.avg, F.stddev_pop)]).first()
        scaled = F.array(*[F.coalesce(F.try_divide(F.get("p", F.lit(j)).cast("double") - row[2 * j], F.lit(row[2 * j + 1])), F.lit(0.0)) for j in range(dims)])
        features = features.withColumn("p", scaled)
    return gaussian_mixture(features, k)[1] if mixture else kmeans(features, k)[1]
