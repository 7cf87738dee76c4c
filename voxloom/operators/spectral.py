"""Spectral operators on packed series and grids of moderate size.

A series is one row, so filters run in Arrow batches without a shuffle. For images an axis at
a time is packed (all lines along the axis are independent), and batches of lines transformed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import lanczos


def power_of_two(n: int) -> int:
    return 1 << max(n - 1, 0).bit_length()


def butterworth(f: np.ndarray, cuton: float | None, cutoff: float | None, order: int = 2) -> np.ndarray:
    """Gain at frequencies f; an absent cut is no cut; cutoff below cuton is a band stop."""
    low = lambda c: 1 / (1 + (f / c) ** (2 * order))
    on = cuton if cuton and cuton > 0 and not math.isnan(cuton) else None
    off = cutoff if cutoff and cutoff > 0 and not math.isnan(cutoff) else None
    if on and off:
        gain = low(off) + (1 - low(on))
        return gain - 1 if off >= on else gain
    return low(off) if off else 1 - low(on) if on else np.ones_like(f)


def band_pass(packed: DataFrame, tr: float, cuton: float | None, cutoff: float | None, column: str = "ts") -> DataFrame:
    """Each series filtered in the frequency domain, padded to a power of two."""
    schema = packed.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                y = np.stack(batch[column].to_numpy()).astype(float)
                n = power_of_two(y.shape[1])
                gain = butterworth(np.fft.rfftfreq(n, tr), cuton, cutoff)
                yield batch.assign(**{column: list(np.fft.irfft(np.fft.rfft(y, n) * gain, n)[:, : y.shape[1]])})

    return packed.mapInPandas(run, schema)


def _lines(voxels: DataFrame, axis: str, others: list[str], values: list[str]) -> DataFrame:
    """One row a line along the axis: its other coordinates and its values in order, packed by one shuffle."""
    line = F.sort_array(F.collect_list(F.struct(axis, *[F.col(v).cast("double").alias(v) for v in values])))
    return voxels.groupBy(*others).agg(line.alias("_l")).select(*others, *[F.col(f"_l.{v}").alias(v) for v in values])


def along_axis(voxels: DataFrame, axis: str, work: Callable[[np.ndarray, dict], np.ndarray], others: list[str], value: str = "v") -> DataFrame:
    """Apply work(line, its other coordinates) to every line along an axis; the length may change."""
    kinds = {f.name: f.dataType.simpleString() for f in voxels.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            places = batch[others].to_dict("records")
            yield batch[others].assign(**{value: [work(np.asarray(line, float), at) for line, at in zip(batch[value], places, strict=True)]})

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in others), f"{value} array<double>"])
    out = _lines(voxels, axis, others, [value]).mapInPandas(run, schema).select(*others, F.posexplode(value).alias(axis, value))
    return out.select(*others, F.col(axis).cast(kinds[axis]).alias(axis), value)


#: Values of lines that are moved together.
LINE_VALUES = 1 << 18


def along_lines(voxels: DataFrame, axis: str, work: Callable[[np.ndarray, dict[str, np.ndarray]], np.ndarray], others: list[str], value: str = "v") -> DataFrame:
    """Like ``along_axis``, for work(lines of one length as rows, their other coordinates as columns): no call for each line."""
    kinds = {f.name: f.dataType.simpleString() for f in voxels.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, length = batch.column(len(others)), batch.column(len(others)).value_lengths().to_numpy()
            for n in np.unique(length):
                row, step = np.flatnonzero(length == n), max(1, LINE_VALUES // max(int(n), 1))
                for lo in range(0, len(row), step):
                    part = pa.array(row[lo : lo + step])
                    y = lines.take(part).flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                    places = [batch.column(k).take(part) for k in range(len(others))]
                    out = work(y, {a: c.to_numpy() for a, c in zip(others, places, strict=True)})
                    ends = pa.array(np.arange(len(part) + 1) * out.shape[1], pa.int32())
                    yield pa.RecordBatch.from_arrays([*places, pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], [*others, value])

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in others), f"{value} array<double>"])
    out = _lines(voxels, axis, others, [value]).mapInArrow(run, schema).select(*others, F.posexplode(value).alias(axis, value))
    return out.select(*others, F.col(axis).cast(kinds[axis]).alias(axis), value)


def fft_axis(voxels: DataFrame, axis: str, others: list[str], inverse: bool = False, size: int | None = None) -> DataFrame:
    """One axis of an N-dimensional transform of (re, im); axes follow one another."""
    kinds = {f.name: f.dataType.simpleString() for f in voxels.schema}
    parts = ["re", "im"] if "im" in voxels.columns else ["re"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, same in batch.groupby(batch["re"].map(len), sort=False):  # lines of one length are transformed together
                z = np.stack(same["re"].to_numpy()).astype(complex)
                if len(parts) == 2:
                    z += 1j * np.stack(same["im"].to_numpy())
                out = (np.fft.ifft if inverse else np.fft.fft)(z, size or z.shape[1], axis=1)
                yield same[others].assign(re=list(out.real), im=list(out.imag))

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in others), "re array<double>", "im array<double>"])
    out = _lines(voxels, axis, others, parts).mapInPandas(run, schema).select(*others, F.posexplode(F.arrays_zip("re", "im")).alias(axis, "_c"))
    return out.select(*others, F.col(axis).cast(kinds[axis]).alias(axis), "_c.re", "_c.im")


def fft(voxels: DataFrame, axes: list[str], inverse: bool = False, keep: list[str] | None = None) -> DataFrame:
    for axis in axes:
        voxels = fft_axis(voxels, axis, [*(keep or []), *[a for a in axes if a != axis]], inverse)
    return voxels


Window1D = Callable[[np.ndarray, float], np.ndarray]


def hann(f: np.ndarray, a: float) -> np.ndarray:
    return np.where(np.abs(f) < a, 0.5 + 0.5 * np.cos(np.pi * f / a), 0.0)


def flat(f: np.ndarray, a: float) -> np.ndarray:
    return (np.abs(f) <= a).astype(float)


def shift_line(y: np.ndarray, distance: float | np.ndarray, window: Window1D = flat) -> np.ndarray:
    """A line (or each row of lines by its own distance) moved by a real distance: zero-padded transform, phase ramp, window."""
    n = power_of_two(2 * y.shape[-1])
    f = np.fft.fftfreq(n)
    return np.fft.ifft(np.fft.fft(y, n) * window(f, 0.5) * np.exp(-2j * np.pi * np.asarray(distance)[..., None] * f)).real[..., : y.shape[-1]]


def lanczos_weights(x: np.ndarray, a: float) -> np.ndarray:
    return np.where(np.abs(x) < a, np.sinc(x) * np.sinc(x / a), 0.0)


def shift_line_kernel(y: np.ndarray, distance: float | np.ndarray, radius: int = 3) -> np.ndarray:
    """A line (or each row of lines by its own distance) moved by a real distance: windowed sinc weights."""
    n = y.shape[-1]
    out = np.zeros(y.shape)
    at = np.arange(n) - np.asarray(distance)[..., None]
    base = np.floor(at).astype(int)
    for k in range(-radius + 1, radius + 1):
        place = base + k
        ok = (place >= 0) & (place < n)
        seen = np.take_along_axis(y, np.clip(place, 0, n - 1), -1)
        out += np.where(ok, seen * lanczos_weights(at - place, radius), 0.0)
    return out


def shift(voxels: DataFrame, axis: str, distance: float, others: list[str], kernel: bool = False, value: str = "v") -> DataFrame:
    move = shift_line_kernel if kernel else shift_line
    return along_axis(voxels, axis, lambda y, _: move(y, distance), others, value)


def shear(voxels: DataFrame, axis: str, slopes: dict[str, float], centers: dict[str, float], others: list[str], kernel: bool = True, value: str = "v") -> DataFrame:
    """Each line moved by the sum of slope · (coordinate − centre) over the other axes."""
    move = (lambda y, d: shift_line_kernel(y, d, 5)) if kernel else shift_line
    return along_lines(voxels, axis, lambda y, at: move(y, sum(s * (at[a] - centers[a]) for a, s in slopes.items())), others, value)


def resample_line(y: np.ndarray, ratio: float, window: Window1D = flat) -> np.ndarray:
    """A line with ceil(n · ratio) samples: the spectrum is cut or padded."""
    n = len(y)
    m = max(1, math.ceil(n * ratio))
    spectrum = np.fft.fft(y)
    out = np.zeros(m, complex)
    half = min(n, m) // 2
    f = np.fft.fftfreq(n)
    spectrum = spectrum * window(f, 0.5 * min(1.0, m / n) + 1e-12)
    out[: half + 1][: min(half + 1, m)] = spectrum[: min(half + 1, m)]
    if half:
        out[-half:] = spectrum[-half:]
    if min(n, m) % 2 == 0 and m > n:  # the middle frequency stands for both signs
        out[half], out[m - half] = spectrum[half] / 2, spectrum[half] / 2
    return np.fft.ifft(out).real * (m / n)


def resample(voxels: DataFrame, ratios: dict[str, float], keep: list[str] | None = None, window: Window1D = flat, value: str = "v") -> DataFrame:
    axes = list(ratios)
    for axis in axes:
        voxels = along_axis(voxels, axis, lambda y, _, r=ratios[axis]: resample_line(y, r, window), [*(keep or []), *[a for a in axes if a != axis]], value)
    return voxels


def smooth_downsample(voxels: DataFrame, spacing: dict[str, float], sigma: float, new_spacing: float, keep: list[str] | None = None, value: str = "v") -> DataFrame:
    """Gaussian in the frequency domain, then an isotropic grid."""
    axes = list(spacing)
    for axis in axes:

        def work(y: np.ndarray, _: dict, s=spacing[axis]) -> np.ndarray:
            n = power_of_two(2 * len(y))
            f = np.fft.rfftfreq(n, s)
            pad = np.pad(y, (0, n - len(y)), mode="edge")
            pad[len(y) + (n - len(y)) // 2 :] = y[0]
            smooth = np.fft.irfft(np.fft.rfft(pad) * np.exp(-2 * (np.pi * f * sigma) ** 2), n)[: len(y)]
            return resample_line(smooth, s / new_spacing)

        voxels = along_axis(voxels, axis, work, [*(keep or []), *[a for a in axes if a != axis]], value)
    return voxels


def scale_band(voxels: DataFrame, spacing: dict[str, float], fine: float, coarse: float, new_spacing: float, keep: list[str] | None = None, value: str = "v") -> DataFrame:
    """What smoothing at the fine width keeps and smoothing at the coarse width removes, on the new grid."""
    on = [*(keep or []), *spacing]
    low = smooth_downsample(voxels, spacing, coarse, new_spacing, keep, value).withColumnRenamed(value, "_low")
    return smooth_downsample(voxels, spacing, fine, new_spacing, keep, value).join(low, on).select(*on, (F.col(value) - F.col("_low")).alias(value))


def zoom(ts: Column, a: float, radius: int = 4) -> Column:
    """A packed line read at a·(i − n/2) + n/2 through a Lanczos window; places beyond the line count nothing."""
    if not -1 <= a <= 1:
        raise ValueError("the zoom must lie between -1 and 1")
    n = F.size(ts)

    def read(_: Column, i: Column) -> Column:
        at = (i - n / 2) * F.lit(float(a)) + n / 2
        middle = F.round(at).cast("int")
        first, last = F.greatest(middle - radius, F.lit(0)), F.least(middle + radius, n - 1)
        near = F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(near, F.lit(0.0), lambda s, j: s + F.get(ts, j) * lanczos(j - at, float(radius)))

    return F.transform(ts, read)


def chirp_z_direct(x: np.ndarray, alpha: float) -> np.ndarray:
    """sum over j of x[j] exp(-2 pi i alpha j (k - N/2) / N), j from 0; O(N²)."""
    n = len(x)
    return np.exp(-2j * np.pi * alpha * np.outer(np.arange(n) - n / 2, np.arange(n)) / n) @ x


def _chirp_sum(x: np.ndarray, k: np.ndarray, rate: float, out: np.ndarray | None = None) -> np.ndarray:
    """sum over l of x[l] exp(-2 pi i rate out[m] k[l]) for evenly spaced k, and out with the same step (k itself by default), O(N log N).

    Twice a product is two squares less the square of the difference: a chirp before, a
    convolution with a chirp by FFT, a chirp after.
    """
    n, out = len(x), k if out is None else out
    if n < 2:
        return x * np.exp(-2j * np.pi * rate * k * out)
    before, after = np.exp(-1j * np.pi * rate * k * k), np.exp(-1j * np.pi * rate * out * out)
    apart = np.arange(1 - n, n) * (k[1] - k[0]) + (out[0] - k[0])
    size = power_of_two(3 * n)
    conv = np.fft.ifft(np.fft.fft(x * before, size) * np.fft.fft(np.exp(1j * np.pi * rate * apart * apart), size))
    return after * conv[n - 1 : 2 * n - 1]


def chirp_z(x: np.ndarray, alpha: float) -> np.ndarray:
    """chirp_z_direct in O(N log N)."""
    n = len(x)
    return _chirp_sum(np.asarray(x), np.arange(n, dtype=float), alpha / n, np.arange(n) - n / 2) if n else np.zeros(0, complex)


def _read_lanczos(y: np.ndarray, at: np.ndarray, radius: int) -> np.ndarray:
    """A line at any places through a Lanczos window, zero beyond its ends."""
    j = np.floor(at).astype(int)[:, None] + np.arange(1 - radius, radius + 1)
    d = at[:, None] - j
    w = np.where(np.abs(d) < radius, np.sinc(d) * np.sinc(d / radius), 0.0)
    return (np.where((j >= 0) & (j < len(y)), w, 0.0) * y[j.clip(0, len(y) - 1)]).sum(1)


def chirplet(x: np.ndarray, alpha: float, ratio: int = 2, radius: int = 5) -> np.ndarray:
    """Chirplet transform: the line on a grid some ``ratio`` times as fine, whose chirps then hold
    frequencies up to that ratio, its chirp sum of rate alpha there, and that sum on the line's own grid.
    """
    n = len(x)
    if not n:
        return np.zeros(0, complex)
    m = ratio * n + 1 - ratio * n % 2  # odd: one place is the middle
    fine = m / n
    k = (np.arange(m) - m // 2) / fine
    there = _chirp_sum(_read_lanczos(np.asarray(x), k + n // 2, radius), k, alpha / n)
    return _read_lanczos(there, (np.arange(n) - n // 2) * fine + m // 2, radius)


def _complex_rows(packed: DataFrame, transform: Callable[[np.ndarray], np.ndarray], column: str) -> DataFrame:
    """(…, re, im) transform of each packed series; no shuffle."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packed.schema if f.name != column)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                z = [transform(np.asarray(y, float)) for y in b[column]]
                yield b.drop(columns=[column]).assign(re=[v.real for v in z], im=[v.imag for v in z])

    return packed.mapInPandas(run, f"{kinds}, re array<double>, im array<double>")


def chirp_z_rows(packed: DataFrame, alpha: float, column: str = "ts") -> DataFrame:
    return _complex_rows(packed, lambda y: chirp_z(y, alpha), column)


def chirplet_rows(packed: DataFrame, alpha: float, ratio: int = 2, radius: int = 5, column: str = "ts") -> DataFrame:
    return _complex_rows(packed, lambda y: chirplet(y, alpha, ratio, radius), column)


def fractional_fourier_rows(packed: DataFrame, order: float, column: str = "ts") -> DataFrame:
    return _complex_rows(packed, lambda y: fractional_fourier(y, order), column)


def fractional_fourier(x: np.ndarray, a: float) -> np.ndarray:
    """Fractional Fourier transform of order a (1 is the centred unitary transform), by chirps.

    The order is reduced to [0.5, 1.5) with plain transforms.
    """
    n = len(x)
    center = lambda v: np.fft.fftshift(np.fft.fft(np.fft.ifftshift(v))) / math.sqrt(n)
    a = a % 4
    if a == 0:
        return x.astype(complex)
    if a == 2:
        return np.roll(x[::-1], 1 - n % 2).astype(complex)
    if a < 0.5 or a >= 3.5 or 1.5 <= a < 2.5:
        return fractional_fourier(center(x), a - 1)
    if a >= 2.5:
        return fractional_fourier(fractional_fourier(x, 2), a - 2)
    phi = a * math.pi / 2
    k = (np.arange(n) - n // 2) / math.sqrt(n)
    cot, csc = 1 / math.tan(phi), 1 / math.sin(phi)
    scale = np.exp(-1j * (math.pi * np.sign(math.sin(phi)) / 4 - phi / 2)) / math.sqrt(abs(math.sin(phi)))
    bend = np.exp(1j * np.pi * cot * k * k)
    return scale * bend * _chirp_sum(bend * x, k, csc) / math.sqrt(n)


def pseudo_polar(voxels: DataFrame, axes: list[str], dims: list[int], radial: str, keep: list[str] | None = None) -> DataFrame:
    """Spectrum (keep, axes, re, im) on pseudo-polar lines: one doubled, zero-padded transform along the radial axis, then
    along each other axis, doubled too, a chirp-z transform whose rate is the line's slope, from -1 at the first
    radial place to 1 at the last.

    The lines of an axis are packed by one shuffle and transformed where they are.
    """
    size = {a: 2 * n for a, n in zip(axes, dims, strict=True)}
    others = lambda axis: [*(keep or []), *[a for a in axes if a != axis]]
    out = fft_axis(voxels.select(*(keep or []), *axes, F.col("v").alias("re")), radial, others(radial), size=size[radial])
    n = size[radial]
    shifted = F.pmod(F.col(radial) + n // 2, F.lit(n)).cast("int")  # the middle frequency stands in the middle
    out = out.withColumn(radial, shifted)
    for axis in axes:
        if axis != radial:
            out = _chirp_axis(out, axis, others(axis), radial, n, size[axis])
    return out


def _chirp_axis(voxels: DataFrame, axis: str, others: list[str], radial: str, n: int, size: int) -> DataFrame:
    """The chirp-z transform of each line along the axis, padded to size, with the slope of its radial place."""
    kinds = {f.name: f.dataType.simpleString() for f in voxels.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for re, im, k in zip(batch["re"], batch["im"], batch[radial], strict=True):
                line = np.zeros(size, complex)
                line[: len(re)] = np.asarray(re) + 1j * np.asarray(im)
                found.append(chirp_z(line, 2 * k / (n - 1) - 1))
            yield batch[others].assign(re=[z.real for z in found], im=[z.imag for z in found])

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in others), "re array<double>", "im array<double>"])
    out = _lines(voxels, axis, others, ["re", "im"]).mapInPandas(run, schema).select(*others, F.posexplode(F.arrays_zip("re", "im")).alias(axis, "_c"))
    return out.select(*others, axis, "_c.re", "_c.im")
