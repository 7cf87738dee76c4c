"""Student's t, least squares, residuals, LASSO.

A design matrix is small and lives on the driver; its pseudo-inverse goes to the tasks with
the code. Packed series are regressed where they lie (Arrow batches, one matrix product a
batch). Regression of columns uses one aggregate of the cross products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class StudentT:
    """Tabulated t distribution: density on a grid, cumulative by Simpson, both interpolated."""

    dof: float
    step: float = 0.05
    top: float = 20.0

    def __post_init__(self):
        n = int(self.top / self.step) + 1
        self.t = np.arange(n) * self.step
        scale = math.exp(math.lgamma((self.dof + 1) / 2) - math.lgamma(self.dof / 2)) / math.sqrt(math.pi * self.dof)
        density = lambda t: scale * (1 + t * t / self.dof) ** (-(self.dof + 1) / 2)
        self.pdf = density(self.t)
        mid = density(self.t[:-1] + self.step / 2)
        area = (self.pdf[:-1] + 4 * mid + self.pdf[1:]) * self.step / 6
        self.cdf = 0.5 + np.append(0, np.cumsum(area))

    def density(self, t: np.ndarray | float) -> np.ndarray:
        return np.interp(np.abs(t), self.t, self.pdf)

    def cumulative(self, t: np.ndarray | float) -> np.ndarray:
        t = np.asarray(t, float)
        half = np.interp(np.abs(t), self.t, self.cdf)
        return np.where(t < 0, 1 - half, half)

    def icdf(self, p: np.ndarray | float) -> np.ndarray:
        p = np.asarray(p, float)
        return np.where(p < 0.5, -np.interp(1 - p, self.cdf, self.t), np.interp(p, self.cdf, self.t))


def student_table(spark, dof: float, step: float = 0.05, top: float = 20.0) -> DataFrame:
    """(t, pdf, cdf) as a small table to join against."""
    s = StudentT(dof, step, top)
    return spark.createDataFrame(pd.DataFrame({"t": s.t, "pdf": s.pdf, "cdf": s.cdf}))


def pseudo_inverse(x: np.ndarray, least: float = 1e-6) -> np.ndarray:
    u, s, v = np.linalg.svd(x, full_matrices=False)
    keep = s > least
    return (v[keep].T / s[keep]) @ u[:, keep].T


REGRESSION = "bhat array<double>, std_err array<double>, t array<double>, p array<double>, ssres double, sigmahat double, rsqr double, adj_rsqr double, dof double"


def regress(y: np.ndarray, x: np.ndarray, dof: float | None = None) -> dict[str, np.ndarray]:
    """OLS of each row of y (series) on the columns of x.

    sigmahat is the residual variance SSres / (n - p); dof defaults to n - p.
    """
    n, p = x.shape
    y = np.atleast_2d(y)
    inverse = pseudo_inverse(x)
    spread = np.diag(np.linalg.pinv(x.T @ x)).clip(0)
    b = y @ inverse.T
    ssres = ((y - b @ x.T) ** 2).sum(1)
    sstot = ((y - y.mean(1, keepdims=True)) ** 2).sum(1)
    dof = float(n - p if dof is None else dof)
    sigma = ssres / max(n - p, 1)
    err = np.sqrt(sigma[:, None] * spread)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = b / err
        r2 = 1 - ssres / sstot
    tail = StudentT(dof).cumulative(np.abs(np.nan_to_num(t)))
    return {"bhat": b, "std_err": err, "t": t, "p": 2 * (1 - tail), "ssres": ssres, "sigmahat": sigma, "rsqr": r2, "adj_rsqr": r2 - (1 - r2) * (p - 1) / max(n - p - 1, 1), "dof": np.full(len(y), dof)}


def _series(batch: pd.DataFrame, column: str) -> np.ndarray:
    return np.stack(batch[column].to_numpy()).astype(float) if len(batch) else np.zeros((0, 0))


def glm(packed: DataFrame, x: np.ndarray, keys: list[str], column: str = "ts", dof: float | None = None) -> DataFrame:
    """keys and the regression of each packed series; no shuffle."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packed.schema if f.name in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                out = regress(_series(batch, column), x, dof)
                yield pd.concat([batch[keys].reset_index(drop=True), pd.DataFrame({k: list(v) for k, v in out.items()})], axis=1)

    return packed.select(*keys, column).mapInPandas(run, f"{kinds}, {REGRESSION}")


def regress_out(packed: DataFrame, x: np.ndarray, column: str = "ts") -> DataFrame:
    """packed with the residual of each series; a constant series becomes 0."""
    inverse, schema = pseudo_inverse(x), packed.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                y = _series(batch, column)
                rest = y - (y @ inverse.T) @ x.T
                rest[y.std(1) == 0] = 0
                yield batch.assign(**{column: list(rest)})

    return packed.mapInPandas(run, schema)


def gram(df: DataFrame, columns: list[str], intercept: bool = True):
    """(n, X'X) of columns by one aggregate, the intercept last."""
    cols = [F.col(c).cast("double") for c in columns] + ([F.lit(1.0)] if intercept else [])
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = df.agg(F.count("*"), *[F.sum(cols[i] * cols[j]) for i, j in pairs]).first()
    m = np.zeros((len(cols),) * 2)
    for (i, j), v in zip(pairs, row[1:], strict=True):
        m[i, j] = m[j, i] = v or 0.0
    return row[0], m


def ols_columns(df: DataFrame, y: str, xs: list[str]) -> dict[str, np.ndarray | float]:
    """OLS of a column on columns and an intercept (last), from one pass over the data."""
    n, m = gram(df, [y, *xs])
    xx, xy, yy = m[1:, 1:], m[1:, 0], m[0, 0]
    p = len(xs) + 1
    b = np.linalg.pinv(xx) @ xy
    ssres = yy - b @ xy
    sstot = yy - m[0, -1] ** 2 / n
    sigma = ssres / (n - p)
    err = np.sqrt(np.diag(np.linalg.pinv(xx)) * sigma)
    t = b / err
    return {"bhat": b, "std_err": err, "t": t, "p": 2 * (1 - StudentT(n - p).cumulative(np.abs(t))), "ssres": ssres, "sigmahat": sigma, "rsqr": 1 - ssres / sstot, "adj_rsqr": 1 - (ssres / sstot) * (n - 1) / (n - p), "dof": n - p}


def ols_by_group(df: DataFrame, y: str, x: str, by: list[str]) -> DataFrame:
    """Slope, intercept, r2, t of the slope for each group: built-in partial aggregates."""
    a = df.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("rsqr"))
    return a.withColumn("t", F.signum("slope") * F.sqrt(F.try_divide(F.col("rsqr") * (F.col("n") - 2), 1 - F.col("rsqr"))))


def residualize(df: DataFrame, y: str, x: str, by: list[str], out: str = "residual") -> DataFrame:
    """df with y less its fitted line in x within each group."""
    fit = df.groupBy(*by).agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"))
    return df.join(fit, by).withColumn(out, F.col(y) - (F.col("_a") + F.col("_b") * F.col(x))).drop("_a", "_b")


def lasso_from_gram(xx: np.ndarray, xy: np.ndarray, penalty: float, tolerance: float = 1e-8, rounds: int = 10_000, active_set: bool = False) -> np.ndarray:
    """Coordinate descent for ½‖y−Xb‖² + penalty‖b‖₁ on cross products."""
    b = np.linalg.pinv(xx) @ xy if not active_set else np.zeros(len(xy))
    diagonal = np.diag(xx)
    active = np.arange(len(b))
    for _ in range(rounds):
        moved = 0.0
        for j in active:
            if diagonal[j] <= 0:
                continue
            rho = xy[j] - xx[j] @ b + diagonal[j] * b[j]
            new = math.copysign(max(abs(rho) - penalty, 0.0), rho) / diagonal[j]
            moved += abs(new - b[j])
            b[j] = new
        if moved <= tolerance:
            if not active_set or len(active) == len(b):
                break
            active = np.arange(len(b))
        elif active_set:
            active = np.flatnonzero(b) if b.any() else active
    return b


def lasso(df: DataFrame, y: str, xs: list[str], penalty: float, active_set: bool = False) -> np.ndarray:
    _, m = gram(df, [y, *xs], intercept=False)
    return lasso_from_gram(m[1:, 1:], m[1:, 0], penalty, active_set=active_set)


def partial_correlation(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Correlation of each pair given all other columns."""
    n, m = gram(df, columns)
    cov = (m[:-1, :-1] - np.outer(m[:-1, -1], m[:-1, -1]) / n) / (n - 1)
    p = np.linalg.pinv(cov)
    d = np.sqrt(np.diag(p))
    out = -p / np.outer(d, d)
    np.fill_diagonal(out, 1.0)
    return out


# ---- event designs -----------------------------------------------------------------


def canonical_response(times: np.ndarray) -> np.ndarray:
    """Double-gamma response at times in seconds."""
    t = np.asarray(times, float)

    def gamma(k: float) -> np.ndarray:
        return np.where(t > 0, np.exp((k - 1) * np.log(np.where(t > 0, t, 1.0)) - t - math.lgamma(k)), 0.0)

    return np.where((t < 0) | (t > 32), 0.0, gamma(6.0) - gamma(16.0) / 6)


def regressor(events: list[list[float]], tr: float, n: int, t0: float = 0.0, over: int = 200) -> np.ndarray:
    """Events (onset, duration, value) or (onset) painted on a fine grid, convolved, decimated."""
    dt = tr / over
    fine = np.zeros(n * over)
    t = t0 + np.arange(n * over) * dt
    for e in events:
        if len(e) == 1:
            k = int(round((e[0] - t0) / dt))
            if 0 <= k < len(fine):
                fine[k] = 1 / dt
        else:
            fine[(t >= e[0]) & (t <= e[0] + e[1])] = e[2]
    kernel = canonical_response(np.arange(0, 32, dt)) * dt
    size = 1 << (len(fine) + len(kernel)).bit_length()
    out = np.fft.irfft(np.fft.rfft(fine, size) * np.fft.rfft(kernel, size), size)[: len(fine)]
    return out[::over]
