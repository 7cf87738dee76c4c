"""Scalar kernels as column expressions: windows, interpolation kernels, distributions.

Everything stays in generated JVM code; constants are folded on the driver. Functions
take and return Columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi


def _d(x: Column | float) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def clamp(low: Column | float, high: Column | float, v: Column) -> Column:
    return F.least(_d(high), F.greatest(_d(low), _d(v)))


def wrap(low: Column, high: Column, v: Column) -> Column:
    """Cyclic index in [low, high]."""
    return F.pmod(v - low, high - low + 1) + low


def cot(x: Column) -> Column:
    return F.cot(_d(x))


def csc(x: Column) -> Column:
    return F.csc(_d(x))


def sec(x: Column) -> Column:
    return F.sec(_d(x))


def radians(degrees: Column) -> Column:
    return F.radians(_d(degrees))


def degrees(radians: Column) -> Column:
    return F.degrees(_d(radians))


def _within(x: Column, a: float, inside: Column) -> Column:
    return F.when(F.abs(x) < a, inside).otherwise(F.lit(0.0))


def rect_window(x: Column, a: float) -> Column:
    return _within(_d(x), a, F.lit(1.0))


def sinc(x: Column) -> Column:
    return F.when(x == 0, F.lit(1.0)).otherwise(F.sin(PI * x) / F.when(x == 0, F.lit(1.0)).otherwise(PI * x))


def sinc_window(x: Column, a: float) -> Column:
    return _within(_d(x), a, sinc(_d(x) / a))


def hamming_window(x: Column, a: float) -> Column:
    return _within(_d(x), a, 0.54 + 0.46 * F.cos(PI * _d(x) / a))


def hann_window(x: Column, a: float) -> Column:
    return _within(_d(x), a, 0.5 + 0.5 * F.cos(PI * _d(x) / a))


def welch_window(x: Column, a: float) -> Column:
    return _within(_d(x), a, 1 - (_d(x) / a) * (_d(x) / a))


def freq_gaussian(x: Column, sd: float) -> Column:
    return F.exp(-2 * PI * PI * sd * sd * _d(x) * _d(x))


def lanczos(x: Column, a: float) -> Column:
    x = _d(x)
    safe = F.when(x == 0, F.lit(1.0)).otherwise(x)
    return F.when(x == 0, F.lit(1.0)).otherwise(_within(x, a, a * F.sin(PI * safe) * F.sin(PI * safe / a) / (PI * PI * safe * safe)))


def d_lanczos(x: Column, a: float) -> Column:
    x = _d(x)
    s = F.when(x == 0, F.lit(1.0)).otherwise(x)
    first = PI * s * F.cos(PI * s / a) * F.sin(PI * s)
    second = a * F.sin(PI * s / a) * (PI * s * F.cos(PI * s) - 2 * F.sin(PI * s))
    return F.when(x == 0, F.lit(0.0)).otherwise(_within(x, a, (first + second) / (PI * PI * s * s * s)))


def linear_kernel(x: Column, a: float) -> Column:
    return _within(_d(x), a, (1 - F.abs(_d(x) / a)) / a)


def d_linear_kernel(x: Column, a: float) -> Column:
    x = _d(x)
    return F.when((x < a) & (x > 0), F.lit(-1 / (a * a))).when((x > -a) & (x < 0), F.lit(1 / (a * a))).otherwise(F.lit(0.0))


def b3(x: Column, radius: float = 2.0) -> Column:
    """Cubic B-spline of support (-2, 2), scaled to the radius."""
    u = F.abs(_d(x)) * (2 / radius)
    near = 2.0 / 3 - u * u + u * u * u / 2
    far = (2 - u) * (2 - u) * (2 - u) / 6
    return F.when(u < 1, near).when(u < 2, far).otherwise(F.lit(0.0)) * (2 / radius)


def d_b3(x: Column, radius: float = 2.0) -> Column:
    s = 2 / radius
    v = _d(x) * s
    u = F.abs(v)
    slope = F.when(u < 1, -2 * u + 1.5 * u * u).when(u < 2, -(2 - u) * (2 - u) / 2).otherwise(F.lit(0.0))
    return F.signum(v) * slope * s * s


def dd_b3(x: Column, radius: float = 2.0) -> Column:
    s = 2 / radius
    u = F.abs(_d(x)) * s
    return F.when(u < 1, 3 * u - 2).when(u < 2, 2 - u).otherwise(F.lit(0.0)) * (s * s * s)


def highest_bit(x: Column) -> Column:
    """Value of the highest set bit; 0 for 0."""
    n = x.cast("long")
    return F.when(n <= 0, F.lit(0)).otherwise(F.pow(F.lit(2.0), F.length(F.bin(n)) - 1).cast("long")).cast("long")


def next_power_of_two(x: Column) -> Column:
    n = x.cast("long")
    return F.when(n <= 1, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.length(F.bin(n - 1))).cast("long")).cast("long")


def prime_factors(x: Column) -> Column:
    """Ascending prime factors with repetition of a number below 2**31."""
    candidates = F.filter(F.sequence(F.lit(2), F.greatest(F.floor(F.sqrt(x.cast("double"))).cast("int"), F.lit(2))), lambda c: x % c == 0)
    start = F.struct(x.cast("long").alias("left"), F.array().cast("array<bigint>").alias("found"))

    def divide(acc: Column, c: Column) -> Column:
        def once(a: Column, _: Column) -> Column:
            fits = (a["left"] % c == 0) & (a["left"] > 1)
            return F.struct(F.when(fits, (a["left"] / c).cast("long")).otherwise(a["left"]).alias("left"), F.when(fits, F.concat(a["found"], F.array(c.cast("long")))).otherwise(a["found"]).alias("found"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(31)), acc, once)

    done = F.aggregate(candidates, start, divide)
    return F.when(done["left"] > 1, F.concat(done["found"], F.array(done["left"]))).otherwise(done["found"])


def next_odd_smooth(n: int) -> int:
    """The next odd number above n with no prime factor beyond 7 (driver-side: plans a size)."""
    n += 1 if n % 2 == 0 else 2
    while True:
        rest = n
        for p in (3, 5, 7):
            while rest % p == 0:
                rest //= p
        if rest == 1:
            return n
        n += 2


def gaussian_pdf(mean: float | Column, sd: float | Column, x: Column) -> Column:
    z = (_d(x) - _d(mean)) / _d(sd)
    return F.exp(-z * z / 2) / (_d(sd) * math.sqrt(2 * PI))


def erf(x: Column) -> Column:
    """Error function from its Maclaurin series and a continued fraction, in column expressions."""
    x = _d(x)
    u = F.least(F.abs(x), F.lit(6.0))
    terms = [(-1) ** k / (math.factorial(k) * (2 * k + 1)) for k in range(40)]
    series = F.lit(terms[-1])
    for c in terms[-2::-1]:
        series = series * u * u + F.lit(c)
    series = series * u * (2 / math.sqrt(PI))
    w = F.greatest(u, F.lit(1.0))
    fraction = w
    for k in range(30, 0, -1):
        fraction = w + F.lit(k / 2) / fraction
    tail = 1 - F.exp(-w * w) / (fraction * math.sqrt(PI))
    return F.signum(x) * F.when(u < 2.5, series).otherwise(tail)


def gaussian_cdf(mean: float, sd: float, x: Column) -> Column:
    return 0.5 * (1 + erf((_d(x) - mean) / (sd * math.sqrt(2))))


def gamma_pdf(x: Column, k: float, theta: float) -> Column:
    """Gamma density; the normaliser is a constant of the plan."""
    x = _d(x)
    safe = F.when(x > 0, x).otherwise(F.lit(1.0))
    return F.when(x > 0, F.exp((k - 1) * F.log(safe) - safe / theta - math.lgamma(k) - k * math.log(theta))).otherwise(F.lit(0.0))


def gamma_pdf_ms(mean: float, sd: float, x: Column) -> Column:
    """Gamma density by mean and deviation, mirrored for a negative mean."""
    theta = sd * sd / abs(mean)
    return gamma_pdf(_d(x) if mean >= 0 else -_d(x), abs(mean) / theta, theta)


def canonical_hrf(t: Column, rise: float = 6.0, under: float = 16.0, rise_sd: float = 1.0, under_sd: float = 1.0, ratio: float = 6.0, onset: float = 0.0, total: float = 32.0) -> Column:
    """Double-gamma response on [onset, total]."""
    u = _d(t) - onset
    value = gamma_pdf(u, rise / rise_sd, 1 / rise_sd) - gamma_pdf(u, under / under_sd, 1 / under_sd) / ratio
    return F.when((_d(t) < 0) | (_d(t) > total), F.lit(0.0)).otherwise(value)


def fwhm_to_sd(fwhm: float) -> float:
    return fwhm / (2 * math.sqrt(2 * math.log(2)))


def sd_to_fwhm(sd: float) -> float:
    return sd * 2 * math.sqrt(2 * math.log(2))


def low_pass(f: Column, cutoff: float, order: int = 2) -> Column:
    return 1 / (1 + F.pow(_d(f) / cutoff, F.lit(2.0 * order)))


def high_pass(f: Column, cuton: float, order: int = 2) -> Column:
    return 1 - low_pass(f, cuton, order)


def band_pass(f: Column, cutoff: float, cuton: float, order: int = 2) -> Column:
    return low_pass(f, cutoff, order) + high_pass(f, cuton, order) - 1


def band_stop(f: Column, cutoff: float, cuton: float, order: int = 2) -> Column:
    return low_pass(f, cutoff, order) + high_pass(f, cuton, order)


# ---- complex and colour values -----------------------------------------------------


def complex_of(re: Column, im: Column) -> Column:
    return F.struct(_d(re).alias("re"), _d(im).alias("im"))


def complex_abs(c: Column) -> Column:
    return F.sqrt(c["re"] * c["re"] + c["im"] * c["im"])


def complex_phase(c: Column) -> Column:
    return F.atan2(c["im"], c["re"])


def complex_mul(a: Column, b: Column) -> Column:
    return F.struct((a["re"] * b["re"] - a["im"] * b["im"]).alias("re"), (a["re"] * b["im"] + a["im"] * b["re"]).alias("im"))


def rgba(r: Column, g: Column, b: Column, a: Column | None = None) -> Column:
    """Colour with channels clamped to 0..255."""
    part = lambda c: F.least(F.lit(255), F.greatest(F.lit(0), c.cast("int"))).cast("smallint")
    fields = [part(r).alias("r"), part(g).alias("g"), part(b).alias("b")]
    return F.struct(*fields, *([part(a).alias("a")] if a is not None else []))
