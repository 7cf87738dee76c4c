"""Aggregations: moments, information, histograms, reductions over time.

Every operator is partial aggregation first; what is shuffled after the first aggregate is
as large as the number of bins or groups, never as the input. Ranges are one-row
aggregates that are joined by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _with_one(df: DataFrame, one: DataFrame) -> DataFrame:
    """df with the columns of a one-row aggregate."""
    return df.join(F.broadcast(one))


def sample_variance(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.count(value).alias("n"), F.var_samp(value).alias("variance"))


def pearson(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.corr(a, b).alias("r"))


def variance_from_sums(n: Column, s: Column, ss: Column) -> Column:
    return (ss - s * s / n) / (n - 1)


def corr_from_sums(n: Column, s1: Column, s2: Column, ss1: Column, ss2: Column, s12: Column) -> Column:
    return (n * s12 - s1 * s2) / F.sqrt((n * ss1 - s1 * s1) * (n * ss2 - s2 * s2))


def _bin(value: Column, low: Column, width: Column) -> Column:
    return F.coalesce(F.floor(F.try_divide(value - low, width)), F.lit(0)).cast("long")


def joint_histogram(df: DataFrame, a: str, b: str, bins: int) -> DataFrame:
    """(bi, bj, n): counts over equal-width bins, width = range / (bins - 1)."""
    rows = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).filter("a is not null and b is not null")
    ends = rows.agg(*[f(c).alias(f"{c}_{n}") for c in ("a", "b") for f, n in ((F.min, "lo"), (F.max, "hi"))])
    width = lambda c: (F.col(f"{c}_hi") - F.col(f"{c}_lo")) / (bins - 1)
    placed = _with_one(rows, ends).select(_bin(F.col("a"), F.col("a_lo"), width("a")).alias("bi"), _bin(F.col("b"), F.col("b_lo"), width("b")).alias("bj"))
    return placed.groupBy("bi", "bj").agg(F.count("*").alias("n"))


def mutual_information(df: DataFrame, a: str, b: str, bins: int = 16) -> DataFrame:
    """One row ``mi``: sum of p ln(p / (pa pb)) over a binned joint distribution."""
    joint = joint_histogram(df, a, b, bins)
    pa, pb = F.sum("n").over(Window.partitionBy("bi")), F.sum("n").over(Window.partitionBy("bj"))
    marked = joint.withColumn("pa", pa).withColumn("pb", pb)
    total = joint.agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return _with_one(marked, total).agg(F.sum(p * F.log(F.col("n") * F.col("total") / (F.col("pa") * F.col("pb")))).alias("mi"))


#: What information() can report, from the entropies of the sides and of the pair.
METRICS = ("mi", "vi", "nmi", "redundancy", "nmi_metric", "dual_correlation")


def information(df: DataFrame, a: str, b: str, bins: int = 32, radius: int = 2, mask: Column | None = None) -> DataFrame:
    """One row of METRICS from a Parzen joint histogram with cubic B-spline weights.

    Every value adds to (2r+1)^2 bins; the explosion is aggregated in the task that makes it.
    """
    from ..functions.kernels import b3

    rows = df.filter(mask) if mask is not None else df
    rows = rows.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).filter("a is not null and b is not null")
    ends = rows.agg(*[f(c).alias(f"{c}_{n}") for c in ("a", "b") for f, n in ((F.min, "lo"), (F.max, "hi"))])
    rows = _with_one(rows, ends)
    for c in ("a", "b"):
        width = (F.col(f"{c}_hi") - F.col(f"{c}_lo")) / (bins - 2 * radius - 1)
        rows = rows.withColumn(f"u{c}", F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}_lo"), width), F.lit(0.0)) + radius)
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    spread = rows.select("ua", "ub", F.explode(steps).alias("i")).select("ua", "ub", "i", F.explode(steps).alias("j"))
    bi, bj = F.floor(F.col("ua")) + F.col("i"), F.floor(F.col("ub")) + F.col("j")
    placed = spread.select(bi.alias("bi"), bj.alias("bj"), (b3(bi - F.col("ua"), radius) * b3(bj - F.col("ub"), radius)).alias("w")).filter(f"w > 0 and bi >= 0 and bj >= 0 and bi < {bins} and bj < {bins}")
    joint = placed.groupBy("bi", "bj").agg(F.sum("w").alias("w"))
    side = lambda k: joint.groupBy(k).agg(F.sum("w").alias("w"))
    entropy = lambda h, n: _with_one(h, joint.agg(F.sum("w").alias("total"))).agg((-F.sum(F.col("w") / F.col("total") * F.log(F.col("w") / F.col("total")))).alias(n))
    h = entropy(joint, "hj").join(F.broadcast(entropy(side("bi"), "ha"))).join(F.broadcast(entropy(side("bj"), "hb")))
    mi = F.col("ha") + F.col("hb") - F.col("hj")
    return h.select(
        mi.alias("mi"), (2 * F.col("hj") - F.col("ha") - F.col("hb")).alias("vi"), F.try_divide(F.col("ha") + F.col("hb"), F.col("hj")).alias("nmi"),
        F.try_divide(mi, F.col("ha") + F.col("hb")).alias("redundancy"), (1 - F.try_divide(mi, F.col("hj"))).alias("nmi_metric"), F.try_divide(mi, F.col("hj")).alias("dual_correlation"),
    )


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n, low, width): equal-width counts, width = range / (bins - 1)."""
    rows = df.select(F.col(value).cast("double").alias("v")).filter("v is not null")
    ends = rows.agg(F.min("v").alias("low"), ((F.max("v") - F.min("v")) / (bins - 1)).alias("width"))
    return _with_one(rows, ends).groupBy(_bin(F.col("v"), F.col("low"), F.col("width")).alias("bin"), "low", "width").agg(F.count("*").alias("n"))


def histogram_mode(df: DataFrame, value: str, bins: int = 64) -> DataFrame:
    """Centre of the fullest bin, the lowest of several."""
    best = histogram(df, value, bins).agg(F.max_by(F.struct("bin", "low", "width", "n"), F.struct("n", (-F.col("bin")).alias("b"))).alias("m"))
    return best.select((F.col("m.low") + (F.col("m.bin") + 0.5) * F.col("m.width")).alias("mode"), F.col("m.n").alias("n"))


def root_bins(df: DataFrame, value: str) -> int:
    return max(2, int(df.filter(F.col(value).isNotNull()).count() ** 0.5))


def otsu_threshold(df: DataFrame, value: str, bins: int | None = None) -> DataFrame:
    """The bin edge with the largest between-class variance, the lowest of several."""
    h = histogram(df, value, bins or root_bins(df, value))
    order = Window.orderBy("bin")  # over the bins: at most the root of the number of rows
    upto, every = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = h.select("bin", "low", "width", "n", F.sum("n").over(upto).alias("n0"), F.sum("n").over(every).alias("nn"), F.sum(F.col("n") * F.col("bin")).over(upto).alias("s0"), F.sum(F.col("n") * F.col("bin")).over(every).alias("ss"))
    n1 = F.col("nn") - F.col("n0")
    gap = F.col("s0") / F.col("n0") - F.try_divide(F.col("ss") - F.col("s0"), n1)
    between = x.filter(n1 > 0).withColumn("between", F.col("n0").cast("double") * n1 * gap * gap)
    best = between.agg(F.max_by(F.struct("bin", "low", "width"), F.struct("between", (-F.col("bin")).alias("b"))).alias("m"))
    return best.select((F.col("m.low") + (F.col("m.bin") + 1) * F.col("m.width")).alias("threshold"))


def hist_equalize(df: DataFrame, value: str, bins: int | None = None, out: str = "equalized") -> DataFrame:
    """df with the value mapped through its cumulative distribution, linear within a bin."""
    bins = bins or root_bins(df, value)
    h = histogram(df, value, bins)
    order = Window.orderBy("bin")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cdf = h.select("bin", "low", "width", "n", before.alias("before"), F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    ends = h.agg(F.first("low").alias("_low"), F.first("width").alias("_width"))
    placed = _with_one(df, ends).withColumn("_bin", _bin(F.col(value).cast("double"), F.col("_low"), F.col("_width")))
    met = placed.join(cdf, F.col("_bin") == F.col("bin"), "left")
    part = F.coalesce(F.try_divide(F.col(value).cast("double") - (F.col("low") + F.col("bin") * F.col("width")), F.col("width")), F.lit(0.0))
    return met.withColumn(out, (F.col("before") + F.col("n") * part) / F.col("total")).drop("_low", "_width", "_bin", "bin", "low", "width", "n", "before", "total")


# ---- pairs of images ---------------------------------------------------------------


def paired(a: DataFrame, b: DataFrame, keys: list[str], value: str = "v", mask: DataFrame | None = None) -> DataFrame:
    """(keys, a, b) of two images on their coordinates, where the mask is positive."""
    out = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys)
    return out.join(mask.filter(F.col(value) > 0).select(*keys), keys, "left_semi") if mask is not None else out


def compare(pairs: DataFrame) -> DataFrame:
    """mse, corr, agreement (share of equal labels) and overlap of labels over columns a, b; one pass."""
    both = F.sum(F.when((F.col("a") != 0) & (F.col("a") == F.col("b")), 1).otherwise(0))
    sizes = F.sum(F.when(F.col("a") != 0, 1).otherwise(0)) + F.sum(F.when(F.col("b") != 0, 1).otherwise(0))
    return pairs.agg(F.count("*").alias("n"), F.avg((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("mse"), F.corr("a", "b").alias("corr"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("agreement"), F.try_divide(2 * both, sizes).alias("overlap"))


# ---- reductions --------------------------------------------------------------------


def collapse_sum(df: DataFrame, keep: list[str], value: str = "v", absolute: bool = False) -> DataFrame:
    v = F.abs(F.col(value)) if absolute else F.col(value)
    return df.groupBy(*keep).agg(F.sum(v).alias(value))


def temporal_reduce(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """sum, avg, var, min, max and upper median of each series.

    The median comes from counts of distinct values, which tasks sum up before the shuffle: no
    series is gathered as a list.
    """
    upper = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY CAST(`{value}` AS DOUBLE) DESC)")
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("sum"), F.avg(value).alias("avg"), F.var_samp(value).alias("var"), F.min(value).alias("min"), F.max(value).alias("max"), upper.alias("median"))


def packed_reduce(packed: DataFrame) -> DataFrame:
    """temporal_reduce of packed series: no shuffle at all."""
    n = F.size("ts")
    total = F.aggregate("ts", F.lit(0.0), lambda a, x: a + x)
    mean = total / n
    squares = F.aggregate("ts", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return packed.select("img_id", "x", "y", "z", total.alias("sum"), mean.alias("avg"), F.try_divide(squares, n - 1).alias("var"), F.array_min("ts").alias("min"), F.array_max("ts").alias("max"), F.element_at(F.sort_array("ts"), (F.floor(n / 2) + 1).cast("int")).alias("median"))


def center_of_mass(df: DataFrame, axes: list[str], value: str) -> DataFrame:
    return df.agg(*[(F.sum(F.col(value) * F.col(a)) / F.sum(value)).alias(f"center_{a}") for a in axes])


def principal_axes(df: DataFrame, axes: list[str], value: str):
    """Eigenvalues and vectors of the mass-weighted covariance: one aggregate, a small matrix on the driver."""
    import numpy as np

    w = F.col(value).cast("double")
    pairs = [(i, j) for i in range(len(axes)) for j in range(i, len(axes))]
    row = df.agg(F.sum(w), *[F.sum(w * F.col(a)) for a in axes], *[F.sum(w * F.col(axes[i]) * F.col(axes[j])) for i, j in pairs]).first()
    total, first = row[0], np.array(row[1 : 1 + len(axes)]) / row[0]
    cov = np.zeros((len(axes),) * 2)
    for (i, j), s in zip(pairs, row[1 + len(axes) :], strict=True):
        cov[i, j] = cov[j, i] = s / total - first[i] * first[j]
    values, vectors = np.linalg.eigh(cov)
    return first, values[::-1], vectors[:, ::-1]


def distinct_labels(df: DataFrame, value: str) -> DataFrame:
    return df.select(F.col(value).cast("long").alias("label")).distinct()


def label_average(values: DataFrame, labels: DataFrame, keys: list[str], value: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Mean of the values under each label (and further keys)."""
    return values.join(labels.select(*keys, label), keys).groupBy(label, *(by or [])).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def polyline_means(tracks: DataFrame, scalar: str) -> DataFrame:
    """Length and length-weighted mean of a scalar along each track (trapezoids)."""
    w = Window.partitionBy("track_id").orderBy("pt_idx")
    step = F.sqrt(sum(((F.col(a) - F.lag(a).over(w)) * (F.col(a) - F.lag(a).over(w)) for a in ("y", "z")), (F.col("x") - F.lag("x").over(w)) * (F.col("x") - F.lag("x").over(w))))
    mid = (F.col(scalar) + F.lag(scalar).over(w)) / 2
    return tracks.select("track_id", step.alias("d"), mid.alias("m")).groupBy("track_id").agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("length"), F.try_divide(F.sum(F.col("d") * F.col("m")), F.sum("d")).alias("mean"))
