"""Image tools as functions: each is a thin composition that a command line would call."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.expression import evaluate
from ..model import Geometry
from ..operators import aggregate, cluster, geometry, neighborhood, spatial, spectral
from ..sources import files, ndimage, textual
from . import pipelines

AXES = ["x", "y", "z"]


def header(spark: SparkSession, path: str) -> DataFrame:
    return ndimage.images(spark, path, "header")


def convert(spark: SparkSession, path: str, folder: str, version: int = 1, suffix: str = ".nii.gz", ptype: str | None = None) -> DataFrame:
    """Read images and write them again, in another version, compression or pixel type."""
    geometries = {r.img_id: Geometry.from_row(r) for r in header(spark, path).collect()}  # a row an image
    if ptype:
        geometries = {k: replace(g, ptype=ptype) for k, g in geometries.items()}
    return ndimage.write_images(ndimage.images(spark, path, "series"), geometries, folder, version, suffix)


def write_complex(image: DataFrame, folder: str, geo: Geometry, polar: bool = True) -> DataFrame:
    """Two files from (x, y, z, re, im): magnitude and phase, or real and imaginary part."""
    c = F.struct(F.col("re"), F.col("im"))
    pair = {"abs": kernels.complex_abs(c), "phase": kernels.complex_phase(c)} if polar else {"re": F.col("re"), "im": F.col("im")}
    rows = image.select(*AXES, F.explode(F.array(*[F.struct(F.lit(n).alias("img_id"), v.alias("v")) for n, v in pair.items()])).alias("s"))
    packed = rows.select("s.img_id", *AXES, F.array("s.v").alias("ts"))
    return ndimage.write_images(packed, dict.fromkeys(pair, geo), folder)


def math_images(images: dict[str, DataFrame], geometries: dict[str, Geometry], expression: str, kind: str = "linear") -> DataFrame:
    """An expression over images; those placed otherwise than the first are resampled onto it."""
    first = next(iter(images))
    placed = {n: image if geometries[n].matches(geometries[first], check_size=True) else spatial.resample_to(image, geometries[n], geometries[first], kind) for n, image in images.items()}
    return evaluate(placed, expression, tuple(AXES[: geometries[first].ndim]))


#: What compare() can report for two images.
COMPARISONS = ("mse", "corr", "zcorr", "agreement", "overlap", *aggregate.METRICS)


def compare(a: DataFrame, b: DataFrame, mask: DataFrame | None = None, bins: int = 32) -> DataFrame:
    """All comparisons of two images on the same grid, one row."""
    pairs = aggregate.paired(a, b, AXES, mask=mask)
    one = aggregate.compare(pairs).withColumn("zcorr", F.when(F.abs("corr") < 1, F.atanh("corr")))
    return one.join(F.broadcast(aggregate.information(pairs, "a", "b", bins)))


def reduce_time(packed: DataFrame, what: str) -> DataFrame:
    """One of sum, avg, var, min, max, median of each voxel's series."""
    return aggregate.packed_reduce(packed).select("img_id", *AXES, F.col(what).alias("v"))


def smooth(image: DataFrame, geo: Geometry, fwhm: float) -> DataFrame:
    """Gaussian of a physical width along each axis."""
    axes = AXES[: geo.ndim]
    return neighborhood.gaussian_smooth_nd(image, axes, list(geo.dims[: len(axes)]), [kernels.fwhm_to_sd(fwhm) / float(s) for s in geo.spacing[: len(axes)]])


def diff_of_gauss(image: DataFrame, geo: Geometry, fwhm1: float, fwhm2: float) -> DataFrame:
    return evaluate({"a": smooth(image, geo, fwhm1), "b": smooth(image, geo, fwhm2)}, "a - b", tuple(AXES[: geo.ndim]))


def resample(image: DataFrame, geo: Geometry, spacing: tuple[float, ...], kind: str = "fft") -> tuple[DataFrame, Geometry]:
    """Another spacing: through the spectrum, or by interpolation."""
    ratios = geo.spacing[: geo.ndim] / np.array(spacing)
    target = replace(geo, dims=tuple(math.ceil(n * r) for n, r in zip(geo.dims, ratios, strict=True)), spacing=np.array(spacing, float))
    if kind == "fft":
        return spectral.resample(image.select(*AXES[: geo.ndim], "v"), dict(zip(AXES, ratios.tolist(), strict=False))), target
    return spatial.resample_to(image, geo, target, kind), target


def add_gaussian(image: DataFrame, mean: float = 0.0, sd: float | None = None, snr: float | None = None, seed: int = 0) -> DataFrame:
    """Noise of a deviation, or of the image's deviation divided by the signal-to-noise ratio."""
    if snr is not None:
        sd = image.agg(F.stddev_samp("v")).first()[0] / snr
    return pipelines.add_noise(image, mean, sd or 0.0, seed)


def copy_orientation(geo: Geometry, other: Geometry) -> Geometry:
    return replace(geo, spacing=other.spacing, origin=other.origin, direction=other.direction, units=other.units)


def guess_orientation(image: DataFrame, geo: Geometry) -> Geometry:
    """Directions from the principal axes of the brightness, origin at its centre."""
    center, _, vectors = aggregate.principal_axes(image, AXES, "v")
    d = vectors * np.sign(vectors[np.abs(vectors).argmax(0), range(3)])
    if np.linalg.det(d) < 0:
        d[:, 2] = -d[:, 2]
    return replace(geo, direction=d.T, origin=-(d.T @ (center * geo.spacing[:3])))


def orientation_transform(a: Geometry, b: Geometry) -> np.ndarray:
    """4 x 4 matrix from indices of a to indices of b."""

    def affine(g: Geometry) -> np.ndarray:
        m = np.eye(4)
        m[:3, :3], m[:3, 3] = g.direction[:3, :3] * g.spacing[:3], g.origin[:3]
        return m

    return np.linalg.inv(affine(b)) @ affine(a)


def register(fixed: np.ndarray, moving: np.ndarray, metric: str = "cor", sigmas: tuple[float, ...] = (3, 1, 0), bins: int = 32, radius: int = 2) -> geometry.Rigid:
    return geometry.register_rigid(fixed, moving, geometry.correlation_metric if metric == "cor" else geometry.information_metric(metric, bins, radius), sigmas)


def segment(image: DataFrame, k: int, mixture: bool = False) -> DataFrame:
    """Voxels to classes by intensity and place."""
    features = image.select(*AXES, F.xxhash64(*AXES).alias("id"), F.array(F.col("v").cast("double"), *[F.col(a).cast("double") for a in AXES]).alias("p"))
    return cluster.segment(features, k, 4, True, mixture).select(*AXES, "cluster")


def functional_pipeline(series: DataFrame, anatomy: np.ndarray, dims: tuple[int, int, int], distort_axis: int = 1) -> tuple[geometry.Rigid, np.ndarray]:
    """Bias correction of the mean volume, rigid registration to the anatomy, distortion along one axis."""
    from ..model import to_numpy

    mean = series.groupBy(*AXES).agg(F.avg("v").alias("v"))
    flat = to_numpy(pipelines.bias_correct(mean, dims), dims)
    motion = register(anatomy, flat, "mi", (3, 1))
    cells = np.indices(dims).reshape(3, -1).T.astype(float)
    placed = geometry.sample(flat, motion.inverse().apply(cells)).reshape(dims)
    return motion, geometry.correct_distortion(anatomy, placed, distort_axis, rounds=10)[1]


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """(img_id, x, y, z, t, v) by suffix: NIfTI, JSON, or text."""
    name = path.removesuffix(".gz")
    if name.endswith(".nii"):
        return ndimage.images(spark, path)
    if name.endswith(".json"):
        return textual.read_json_images(spark, path)
    if name.endswith((".txt", ".csv")):
        return textual.read_text_image(spark, path).select(F.lit(files.base_name(path)).alias("img_id"), "x", "y", F.lit(0).alias("z"), F.lit(0).alias("t"), "v")
    raise ValueError(f"no reader for {path}")
