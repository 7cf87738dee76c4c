"""Whole procedures composed of operators: cleaning, group ICA, fibre counting, segmentation, simulation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Geometry, grid, pack
from ..operators import aggregate, decomposition, geometry, neighborhood, regression, spatial, spectral
from ..session import settled


def clean_series(packed: DataFrame, design: np.ndarray | None, tr: float, cuton: float | None = None, cutoff: float | None = None, derivatives: bool = False, labels: DataFrame | None = None, region_parts: int = 0) -> DataFrame:
    """Regress designs (and region averages or components) out of every series, then band-pass it.

    Both steps are Arrow batches over packed rows: no shuffle after the regions are read.
    """
    n = packed.select(F.size("ts").alias("n")).first().n
    columns = [] if design is None else [np.asarray(design, float)]
    if derivatives and columns:
        columns.append(np.vstack([np.zeros((1, columns[0].shape[1])), np.diff(columns[0], axis=0)]))
    if labels is not None:
        columns.append(region_series(packed, labels, n, region_parts))
    x = np.column_stack([*columns, np.ones(n)])
    out = regression.regress_out(packed, x)
    return spectral.band_pass(out, tr, cuton, cutoff) if cuton or cutoff else out


def region_series(packed: DataFrame, labels: DataFrame, n: int, parts: int = 0, independent: bool = False) -> np.ndarray:
    """Time courses of labelled voxels: the mean of each label, or leading components of all of them."""
    met = packed.join(labels.filter("label <> 0").select("x", "y", "z", "label"), ["x", "y", "z"])
    if not parts:
        rows = met.groupBy("label").agg(F.array(*[F.avg(F.get("ts", F.lit(k))) for k in range(n)]).alias("m")).orderBy("label").collect()  # one row a label
        return np.array([r.m for r in rows]).T.reshape(n, -1)
    matrix = decomposition.reorganize(met.select("img_id", "x", "y", "z", "ts"))
    s, v = decomposition.reduce_randomized(matrix, n, parts, total_share=1.0)
    return decomposition.symmetric_ica(v * s)[0] if independent else v


def group_ica(runs: DataFrame, mask: DataFrame | None, width: int, rank: int, spatial_maps: bool = True, randomized: bool = True):
    """Three stages with stored tables between them: reorganise, reduce, separate."""
    matrix = decomposition.reorganize(runs, mask)
    s, v = decomposition.reduce_randomized(matrix, width, rank) if randomized else decomposition.reduce_full(matrix, width, 1.0, rank)
    if spatial_maps:
        return decomposition.spatial_components(matrix, s, v)
    courses, maps, share = decomposition.temporal_components(matrix, s, v)
    return maps, courses, share


def recreate_subjects(mixing: DataFrame, maps: DataFrame, rows_each: int) -> DataFrame:
    """(subject, t, voxel, v): each subject's rows of the mixing matrix times the component maps."""
    split = mixing.select(F.floor(F.col("i") / rows_each).cast("int").alias("subject"), (F.col("i") % rows_each).alias("t"), F.col("j").alias("comp"), "v")
    met = split.join(maps.select("comp", "voxel", F.col("v").alias("m")), "comp")
    return met.groupBy("subject", "t", "voxel").agg(F.sum(F.col("v") * F.col("m")).alias("v"))


def crop_tracks(tracks: DataFrame, mask: DataFrame, geo: Geometry, least_length: float) -> DataFrame:
    """The longest stretch of each track inside the mask, if it is longer than least_length."""
    index = geo.to_index([F.col(a).cast("double") for a in ("x", "y", "z")])
    placed = tracks.select("track_id", "pt_idx", "x", "y", "z", *[F.floor(c + 0.5).cast("int").alias(f"i{a}") for a, c in zip("xyz", index, strict=True)])
    inside = mask.filter("v > 0").select(*[F.col(a).alias(f"i{a}") for a in "xyz"], F.lit(True).alias("in"))
    marked = placed.join(inside, ["ix", "iy", "iz"], "left").withColumn("in", F.coalesce("in", F.lit(False)))
    w = Window.partitionBy("track_id").orderBy("pt_idx")
    run = neighborhood.connected_runs(marked, "in", ["pt_idx"], ["track_id"]).filter("in")
    w = Window.partitionBy("track_id", "run").orderBy("pt_idx")
    step = F.sqrt(sum(((F.col(a) - F.lag(a).over(w)) ** 2 for a in "yz"), (F.col("x") - F.lag("x").over(w)) ** 2))
    lengths = run.withColumn("d", F.coalesce(step, F.lit(0.0))).groupBy("track_id", "run").agg(F.sum("d").alias("length"))
    best = lengths.groupBy("track_id").agg(F.max("length").alias("length"), F.max_by("run", F.struct("length", -F.col("run"))).alias("run")).filter(F.col("length") > least_length)
    return run.join(best.select("track_id", "run"), ["track_id", "run"]).select("track_id", "pt_idx", "x", "y", "z")


def sample_path(tracks: DataFrame, step: float = 1.0) -> DataFrame:
    """Points of each track at least ``step`` of path apart, the first one included."""
    w = Window.partitionBy("track_id").orderBy("pt_idx")
    d = F.sqrt(sum(((F.col(a) - F.lag(a).over(w)) ** 2 for a in "yz"), (F.col("x") - F.lag("x").over(w)) ** 2))
    run = tracks.withColumn("d", F.coalesce(d, F.lit(0.0))).withColumn("at", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    slot = F.floor(F.col("at") / step)
    return run.withColumn("slot", slot).withColumn("keep", F.coalesce(F.lag("slot").over(w) < F.col("slot"), F.lit(True))).filter("keep").select("track_id", "pt_idx", "x", "y", "z")


def fibre_graph(tracks: DataFrame, labels: DataFrame, geo: Geometry, radius: float, scalars: DataFrame | None = None) -> DataFrame:
    """(l1, l2, n, length, scalar): tracks that come near two labels, their mean length and scalar.

    Labels are few, so the pairs of a track's labels are few; the radius search is a grid join.
    """
    point = geo.to_point([F.col(a).cast("double") for a in "xyz"])
    nodes = labels.filter("label <> 0").select(F.struct("x", "y", "z").alias("id"), F.col("label").cast("long").alias("label"), F.array(*point).alias("p"))
    nodes = nodes.withColumn("id", F.xxhash64("id.x", "id.y", "id.z"))
    seen = sample_path(tracks).select(F.xxhash64("track_id", "pt_idx").alias("id"), "track_id", F.array(*[F.col(a).cast("double") for a in "xyz"]).alias("p"))
    near = spatial.within_distance(seen, nodes, radius, 3)
    touched = near.join(seen.select(F.col("id").alias("left_id"), "track_id"), "left_id").join(nodes.select(F.col("id").alias("right_id"), "label"), "right_id").select("track_id", "label").distinct()
    lines = aggregate.polyline_means(tracks.withColumn("_s", F.lit(0.0)) if scalars is None else tracks.join(scalars, ["track_id", "pt_idx"]).withColumn("_s", F.col("scalar")), "_s")
    a, b = touched.select("track_id", F.col("label").alias("l1")), touched.select("track_id", F.col("label").alias("l2"))
    pairs = a.join(b, "track_id").filter("l1 <= l2").join(lines, "track_id")
    return pairs.groupBy("l1", "l2").agg(F.count("*").alias("n"), F.avg("length").alias("length"), F.avg("mean").alias("scalar"))


def bias_correct(image: DataFrame, dims: tuple[int, int, int], knots: int = 5, rounds: int = 1) -> DataFrame:
    for _ in range(rounds):
        image = settled(geometry.correct_bias(image, dims, knots))
    return image


def skull_strip(image: DataFrame, dims: tuple[int, int, int], bridge: int = 2) -> DataFrame:
    """Bright tissue above the Otsu threshold, thin bridges cut, the largest component kept; (x, y, z, v)."""
    cut = aggregate.otsu_threshold(image, "v").first().threshold
    mask = image.select("x", "y", "z", F.when(F.col("v") < cut, 0.0).otherwise(1.0).alias("v"))
    axes = ["x", "y", "z"]
    opened = settled(neighborhood.dilate(neighborhood.erode(mask, axes, list(dims), bridge), axes, list(dims), bridge))
    opened = opened.join(mask.filter("v > 0").select(*axes), axes, "left_semi")
    labels = neighborhood.relabel_connected(opened.filter("v > 0"), axes, list(dims))
    main = labels.groupBy("label").agg(F.count("*").alias("n")).agg(F.max_by("label", F.struct("n", "label")).alias("label"))
    return labels.join(F.broadcast(main), "label").select(*axes, F.lit(1.0).alias("v"))


def motion_correct(voxels: DataFrame, dims: tuple[int, int, int], reference_time: int = 0) -> DataFrame:
    """Motion of each volume against a reference volume: volumes are independent tasks."""
    return geometry.register_series(voxels, voxels.filter(F.col("t") == reference_time), dims)


def sphere(spark: SparkSession, dims: tuple[int, int, int], center: tuple[float, float, float], radius: float, label: int = 1) -> DataFrame:
    d = sum(((F.col(a) - c) ** 2 for a, c in zip("yz", center[1:], strict=True)), (F.col("x") - center[0]) ** 2)
    return grid(spark, dims).select("x", "y", "z", F.when(d < radius * radius, label).otherwise(0).alias("v"))


def add_noise(image: DataFrame, mean: float, sd: float, seed: int = 0) -> DataFrame:
    return image.withColumn("v", F.col("v") + mean + sd * F.randn(seed))


def random_labels(image: DataFrame, dims: tuple[int, int, int], n: int, sd: float, seed: int = 0) -> DataFrame:
    """The largest of n smoothed random fields at each voxel, 0 where none is positive."""
    axes = ["x", "y", "z"]
    fields = image.select(*axes, F.explode(F.sequence(F.lit(0), F.lit(n))).alias("label")).withColumn("v", F.randn(seed))
    smooth = neighborhood.gaussian_smooth_nd(settled(fields), axes, list(dims), sd, keep=["label"])
    return smooth.groupBy(*axes).agg(F.max_by("label", "v").alias("label"), F.max("v").alias("v")).select(*axes, F.when(F.col("v") > 0, F.col("label")).otherwise(0).alias("v"))


#: Seconds that a simulation runs ahead of its first sample, so that it doesn't start at rest.
LEAD_IN = 15.0


def sample_response(times: np.ndarray, n: int, tr: float, step: float, learn: float = 0.0) -> np.ndarray:
    """n samples, every tr seconds, of the response to unit events at these times (from -LEAD_IN on), simulated in steps."""
    drive = np.zeros(int((n * tr + LEAD_IN) / step))
    at = np.rint((np.asarray(times, float) + LEAD_IN) / step).astype(int)
    np.add.at(drive, at[(at >= 0) & (at < len(drive))], 1 / step)
    wave, _ = neighborhood.balloon_steps(drive, step, learn)
    read = np.rint((np.arange(n) * tr + LEAD_IN) / step).astype(int)
    return np.where(read < len(wave), wave[np.minimum(read, len(wave) - 1)], 0.0)


def simulate_series(regions: DataFrame, n: int, tr: float, rate: float, learn: float = 0.0, step: float = 0.01, noise: float = 0.0, seed: int = 0, event_step: float = 1e-4) -> DataFrame:
    """(label, ts): random unit events of each region, rate a second, through the balloon response, sampled every tr.

    Events are drawn in steps of event_step seconds, over the lead-in too; each region is a row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            series = []
            for label in b["label"]:
                rng = np.random.default_rng([seed & 0xFFFFFFFF, int(label) & 0xFFFFFFFF])
                times = np.flatnonzero(rng.random(int((n * tr + LEAD_IN) / event_step)) < rate * event_step) * event_step - LEAD_IN
                series.append(sample_response(times, n, tr, step, learn) + noise * rng.normal(size=n))
            yield b.assign(ts=series)

    kind = regions.schema["label"].dataType.simpleString()
    return regions.select("label").distinct().mapInPandas(run, f"label {kind}, ts array<double>")


def paint_regions(labels: DataFrame, series: DataFrame) -> DataFrame:
    """A packed 4-D image whose labelled voxels carry their region's series."""
    return labels.filter("label <> 0").join(series, "label").select(F.lit("sim").alias("img_id"), "x", "y", "z", "ts")


def density_segment(image: DataFrame, weight: float, radius: float, threshold: float) -> DataFrame:
    """Voxels by density peaks of scaled intensity and place; (x, y, z, peak)."""
    from ..operators.cluster import density_peaks, peak_classes

    low, high = image.agg(F.min("v"), F.max("v")).first()
    p = F.array(((F.col("v") - low) / ((high - low) or 1.0) * weight), *[F.col(a).cast("double") for a in "xyz"])
    points = settled(image.select("x", "y", "z", F.xxhash64("x", "y", "z").alias("id"), p.alias("p")))
    classes = peak_classes(density_peaks(points, radius), threshold)
    return points.join(classes, "id").select("x", "y", "z", "peak")


def select_and_pack(voxels: DataFrame, names: DataFrame, pattern: str) -> DataFrame:
    return pack(spatial.select_volumes(voxels, names, pattern))
