"""Driver-contract queries of the image operators, over an image made of the embeddings table.

The image has a row of 8 x 8 voxels for each vector: x is vec_id, y and z are the place of a
coordinate. As a packed series a vector is 64 points in time.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..model import Geometry
from ..operators import geometry as M
from ..operators import neighborhood as N
from ..operators import regression as R
from ..operators import spatial as S
from ..operators import spectral as P
from . import tools
from .registry import query, rounded, table

AXES = ["x", "y", "z"]

_IMG = "img AS (SELECT vec_id AS x, (t.k - 1) // 8 AS y, (t.k - 1) % 8 AS z, CAST(embedding[t.k] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(k)), n AS (SELECT max(x) AS m FROM img)"


def image(spark, sf: str, value=None) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").cast("int").alias("x"), F.posexplode(F.col("embedding").cast("array<double>")).alias("k", "v"))
    return rows.select("x", F.floor(F.col("k") / 8).cast("int").alias("y"), (F.col("k") % 8).alias("z"), (value if value is not None else F.col("v")).alias("v"))


def dims(spark, sf: str) -> tuple[int, int, int]:
    return (table(spark, sf, "embeddings").agg(F.max("vec_id")).first()[0] or 0) + 1, 8, 8


def packed(spark, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.lit("img").alias("img_id"), F.col("vec_id").cast("int").alias("x"), F.lit(0).alias("y"), F.lit(0).alias("z"), F.col("embedding").cast("array<double>").alias("ts"))


def told(df: DataFrame, *values: str, digits: int = 6) -> DataFrame:
    """Coordinates as longs and rounded values."""
    return df.select(*[F.col(a).cast("long").alias(a) for a in AXES], *[rounded(F.col(v).cast("double"), digits).alias(v) for v in values])


def _complex(rows: DataFrame) -> DataFrame:
    """A row for each place of each line."""
    out = rows.select("x", F.posexplode(F.arrays_zip("re", "im")).alias("t", "c"))
    return out.select(F.col("x").cast("long").alias("x"), F.col("t").cast("long").alias("t"), rounded("c.re").alias("re"), rounded("c.im").alias("im"))


def _seen(offsets: str, img: str = "img") -> str:
    """seen: what each voxel sees at offsets (a, b, c) with number k, the border repeated."""
    return f"""o AS ({offsets}), seen AS (SELECT i.x, i.y, i.z, o.*, j.v FROM {img} i CROSS JOIN o CROSS JOIN n
    JOIN {img} j ON j.x = greatest(0, least(n.m, i.x + o.a)) AND j.y = greatest(0, least(7, i.y + o.b)) AND j.z = greatest(0, least(7, i.z + o.c)))"""


_CUBE = "SELECT ra.i AS a, rb.i AS b, rc.i AS c, (ra.i + 1) * 9 + (rb.i + 1) * 3 + rc.i + 1 AS k FROM range(-1, 2) ra(i), range(-1, 2) rb(i), range(-1, 2) rc(i)"
_LABEL = "lab AS (SELECT x, y, z, CASE WHEN v > 0.1 THEN 1 + x % 3 ELSE 0 END AS v FROM img)"
_MASK = "msk AS (SELECT x, y, z, CASE WHEN v > -0.2 THEN 1 + x % 3 ELSE 0 END AS v FROM img)"


def _labels(spark, sf, least: float = 0.1) -> DataFrame:
    return image(spark, sf, F.when(F.col("v") > least, 1 + F.col("x") % 3).otherwise(0))


# ---- neighbourhoods ----------------------------------------------------------------


@query(f"WITH {_IMG}, {_seen(_CUBE)} SELECT x, y, z, round(list_sort(list(v))[14], 6) + 0.0 AS v FROM seen GROUP BY x, y, z")
def median_filter_nd(spark, sf):
    return told(N.median_filter_nd(image(spark, sf), AXES, list(dims(spark, sf))), "v")


@query(f"""WITH {_IMG}, {_seen(_CUBE)}, w AS (SELECT *, 0.5 / (1 + abs(a)) AS wa, 0.5 / (1 + abs(b)) AS wb, 0.5 / (1 + abs(c)) AS wc FROM seen)
SELECT x, y, z, round(sum(v * a * 0.5 * wb * wc), 6) + 0.0 AS d_x, round(sum(v * b * 0.5 * wa * wc), 6) + 0.0 AS d_y, round(sum(v * c * 0.5 * wa * wb), 6) + 0.0 AS d_z FROM w GROUP BY x, y, z""")
def sobel_nd(spark, sf):
    return told(N.sobel(image(spark, sf), AXES, list(dims(spark, sf))), "d_x", "d_y", "d_z")


@query(f"WITH {_IMG}, {_MASK}, {_seen(_CUBE, 'msk')} SELECT x, y, z, CAST(CASE WHEN min(CASE WHEN v <> 0 THEN 1 ELSE 0 END) = 1 THEN max(v) FILTER (k = 13) ELSE 0 END AS DOUBLE) AS v FROM seen GROUP BY x, y, z")
def erode_ball(spark, sf):
    return told(N.erode(_labels(spark, sf, -0.2), AXES, list(dims(spark, sf)), 2), "v")


@query(f"WITH {_IMG}, {_MASK}, {_seen(_CUBE, 'msk')} SELECT x, y, z, CAST(CASE WHEN min(CASE WHEN v <> 0 THEN 1 ELSE 0 END) = 1 THEN max(v) FILTER (k = 13) ELSE 0 END AS DOUBLE) AS v FROM seen GROUP BY x, y, z")
def erode_block(spark, sf):
    return told(N.erode(_labels(spark, sf, -0.2), AXES, list(dims(spark, sf)), 1, block=True), "v")


@query(f"WITH {_IMG}, {_LABEL}, {_seen(_CUBE, 'lab')} SELECT x, y, z, CAST(coalesce(arg_min(v, k) FILTER (v <> 0), 0) AS DOUBLE) AS v FROM seen GROUP BY x, y, z")
def dilate_ball(spark, sf):
    return told(N.dilate(_labels(spark, sf), AXES, list(dims(spark, sf)), 2), "v")


@query(f"WITH {_IMG}, {_LABEL}, {_seen(_CUBE, 'lab')} SELECT x, y, z, CAST(coalesce(arg_max(v, k) FILTER (v <> 0), 0) AS DOUBLE) AS v FROM seen GROUP BY x, y, z")
def dilate_block(spark, sf):
    return told(N.dilate(_labels(spark, sf), AXES, list(dims(spark, sf)), 1, block=True), "v")


_BALL = "SELECT ra.i AS a, rb.i AS b, rc.i AS c, (ra.i + 2) * 25 + (rb.i + 2) * 5 + rc.i + 2 AS k FROM range(-2, 3) ra(i), range(-2, 3) rb(i), range(-2, 3) rc(i) WHERE ra.i * ra.i + rb.i * rb.i + rc.i * rc.i < 9"


@query(f"WITH {_IMG}, {_MASK}, {_seen(_BALL, 'msk')} SELECT x, y, z, CAST(CASE WHEN min(CASE WHEN v <> 0 THEN 1 ELSE 0 END) = 1 THEN max(v) FILTER (k = 62) ELSE 0 END AS DOUBLE) AS v FROM seen GROUP BY x, y, z")
def erode_ball_3(spark, sf):
    """A radius whose ball is no cube: 81 of 125 voxels."""
    return told(N.erode(_labels(spark, sf, -0.2), AXES, list(dims(spark, sf)), 3), "v")


@query(f"WITH {_IMG}, {_LABEL}, {_seen(_BALL, 'lab')} SELECT x, y, z, CAST(coalesce(arg_min(v, k) FILTER (v <> 0), 0) AS DOUBLE) AS v FROM seen GROUP BY x, y, z")
def dilate_ball_3(spark, sf):
    return told(N.dilate(_labels(spark, sf), AXES, list(dims(spark, sf)), 3), "v")


@query(f"""WITH RECURSIVE {_IMG}, lab AS (SELECT x, y, z, x * 64 + y * 8 + z AS id, CASE WHEN v > 0.03 THEN 1 ELSE 0 END AS v FROM img),
e AS (SELECT a.id AS a, b.id AS b FROM lab a JOIN lab b ON a.v = b.v AND ((b.x = a.x + 1 AND b.y = a.y AND b.z = a.z) OR (b.x = a.x AND b.y = a.y + 1 AND b.z = a.z) OR (b.x = a.x AND b.y = a.y AND b.z = a.z + 1))),
w AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
-- only voxels without a smaller neighbour can be the first of a component
r AS (SELECT a AS id, a AS c FROM w GROUP BY a HAVING min(b) > a UNION SELECT w.b, r.c FROM r JOIN w ON w.a = r.id WHERE w.b > r.c),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT x, y, z, CAST(v AS DOUBLE) AS v, CAST(coalesce(m.c, lab.id) AS DOUBLE) AS label FROM lab LEFT JOIN m USING (id)""")
def relabel_connected(spark, sf):
    rows = image(spark, sf, F.when(F.col("v") > 0.03, 1).otherwise(0))
    return told(N.relabel_connected(rows, AXES, list(dims(spark, sf))), "v", "label")


def _gauss_sql(sd: float, radius: int, name: str) -> str:
    """One axis after the other, the border repeated."""
    w = ", ".join(f"({k}, {x!r})" for k, x in zip(range(-radius, radius + 1), N.gaussian_weights(sd, radius), strict=True))
    out, last = [f"{name}_w(o, w) AS (VALUES {w})"], "img"
    for axis, end in (("x", "n.m"), ("y", "7"), ("z", "7")):
        same = " AND ".join(f"j.{a} = i.{a}" for a in AXES if a != axis)
        out.append(f"{name}_{axis} AS (SELECT i.x, i.y, i.z, sum(j.v * w) AS v FROM {last} i CROSS JOIN {name}_w CROSS JOIN n JOIN {last} j ON {same} AND j.{axis} = greatest(0, least({end}, i.{axis} + o)) GROUP BY i.x, i.y, i.z)")
        last = f"{name}_{axis}"
    return ", ".join(out)


@query(f"WITH {_IMG}, {_gauss_sql(1.0, 2, 'g')} SELECT x, y, z, round(v, 6) + 0.0 AS v FROM g_z")
def gaussian_smooth_nd(spark, sf):
    return told(N.gaussian_smooth_nd(image(spark, sf), AXES, list(dims(spark, sf)), 1.0), "v")


_WIDTHS = (2.4, 3.6)
_SDS = [K.fwhm_to_sd(w) for w in _WIDTHS]


@query(f"WITH {_IMG}, {_gauss_sql(_SDS[0], int(2 * _SDS[0] + 0.5), 'g')}, {_gauss_sql(_SDS[1], int(2 * _SDS[1] + 0.5), 'h')} SELECT x, y, z, round(g_z.v - h_z.v, 6) + 0.0 AS v FROM g_z JOIN h_z USING (x, y, z)")
def diff_of_gauss(spark, sf):
    return told(tools.diff_of_gauss(image(spark, sf), Geometry(dims(spark, sf)), *_WIDTHS), "v")


_KERNEL = [1.0, 0.5, 0.25, -0.1]


@query(f"""WITH {_IMG}, s AS (SELECT x, y * 8 + z AS t, v FROM img), k(j, w) AS (VALUES {', '.join(f'({j}, {w!r})' for j, w in enumerate(_KERNEL))})
SELECT a.x, a.t, round(sum(b.v * w), 6) + 0.0 AS v FROM s a CROSS JOIN k JOIN s b ON a.x = b.x AND b.t = a.t - j GROUP BY a.x, a.t""")
def causal_convolve(spark, sf):
    out = packed(spark, sf).select("x", F.posexplode(N.causal_convolve(F.col("ts"), _KERNEL)).alias("t", "v"))
    return out.select(F.col("x").cast("long").alias("x"), F.col("t").cast("long").alias("t"), rounded("v").alias("v"))


@query(f"""WITH RECURSIVE {_IMG}, u AS (SELECT x, y * 8 + z AS t, abs(v) AS u FROM img),
r AS (SELECT x, CAST(-1 AS BIGINT) AS t, 0.0::DOUBLE AS st, 1.0::DOUBLE AS ft, 1.0::DOUBLE AS vt, 1.0::DOUBLE AS qt, 0.0::DOUBLE AS ma, 0.0::DOUBLE AS y FROM (SELECT DISTINCT x FROM img)
UNION ALL SELECT x, t, st, ft, vt, qt, ma, 0.33 * (7 * 0.34 * (1 - qt) + 2 * (1 - qt / vt) + (2 * 0.34 - 0.2) * (1 - vt)) FROM (
SELECT r.x, r.t + 1 AS t, 0.05 * u + (1 - 0.05) * ma AS ma,
st + 0.1 * (0.7 * (CASE WHEN u < 0.05 * u + (1 - 0.05) * ma THEN 0 ELSE u END) - st / 1.54 - (ft - 1) / 2.46) AS st, ft + 0.1 * st AS ft,
vt + 0.1 * ((ft - pow(vt, 1 / 0.33)) / 0.98) AS vt, qt + 0.1 * ((ft / 0.34) * (1 - pow(1 - 0.34, 1 / ft)) - qt / pow(vt, 1 - 1 / 0.33)) / 0.98 AS qt FROM r JOIN u ON u.x = r.x AND u.t = r.t + 1))
SELECT x, t, round(y, 8) + 0.0 AS v FROM r WHERE t >= 0""")
def balloon_response(spark, sf):
    ts = F.transform("ts", lambda v: F.abs(v))
    out = packed(spark, sf).select("x", F.posexplode(N.balloon_response(ts, 0.1, 0.05)).alias("t", "v"))
    return out.select(F.col("x").cast("long").alias("x"), F.col("t").cast("long").alias("t"), rounded("v", 8).alias("v"))


# ---- interpolation and motion ------------------------------------------------------

_AT = {"x": (0.97, 0.3), "y": (0.9, 0.25), "z": (1.1, -0.2)}


def _samples(spark, sf) -> tuple[DataFrame, dict]:
    rows = image(spark, sf).select(*[F.col(a).alias(f"o{a}") for a in AXES])
    return rows, {a: F.col(f"o{a}") * m + s for a, (m, s) in _AT.items()}


def _interpolated(spark, sf, kind: str) -> DataFrame:
    rows, at = _samples(spark, sf)
    out = S.interpolate(rows, image(spark, sf), at, dict(zip(AXES, dims(spark, sf), strict=True)), [f"o{a}" for a in AXES], kind, "clamp")
    return told(out.select(*[F.col(f"o{a}").alias(a) for a in AXES], "v"), "v")


def _interpolate_sql(steps: range, base: str, weight: str, source: str = "spot", limits: tuple = ("greatest(0, least(n.m, {}))", "greatest(0, least(7, {}))", "greatest(0, least(7, {}))")) -> str:
    """Sum of weighted voxels around (ux, uy, uz) of ``source``."""
    lo, hi = steps.start, steps.stop
    places = ", ".join(f"CAST({base.format('u' + a)} AS BIGINT) + r{a}.i AS p{a}" for a in AXES)
    weights = " * ".join(weight.format(f"(u{a} - p{a})") for a in AXES)
    on = " AND ".join(f"j.{a} = " + limit.format(f"p{a}") for a, limit in zip(AXES, limits, strict=True))
    return f"""c AS (SELECT *, {places} FROM {source} CROSS JOIN range({lo}, {hi}) rx(i) CROSS JOIN range({lo}, {hi}) ry(i) CROSS JOIN range({lo}, {hi}) rz(i)),
w AS (SELECT *, {weights} AS w FROM c),
s AS (SELECT c.x, c.y, c.z, coalesce(sum(c.w * j.v), 0) AS v FROM w c CROSS JOIN n LEFT JOIN img j ON {on} GROUP BY c.x, c.y, c.z)
SELECT x, y, z, round(v, 6) + 0.0 AS v FROM s"""


_AT_SQL = "spot AS (SELECT x, y, z, " + ", ".join(f"{a} * {m}::DOUBLE + {s}::DOUBLE AS u{a}" for a, (m, s) in _AT.items()) + " FROM img)"
_LINEAR = "greatest(0, 1 - abs({0}))"
_LANCZOS = "(CASE WHEN {0} = 0 THEN 1 WHEN abs({0}) < 2 THEN 2 * sin(pi() * {0}) * sin(pi() * {0} / 2) / (pi() * pi() * {0} * {0}) ELSE 0 END)"


@query(f"WITH {_IMG}, {_AT_SQL}, {_interpolate_sql(range(0, 1), 'floor({} + 0.5)', '(1 + 0 * {0})')}")
def interpolate_nearest(spark, sf):
    return _interpolated(spark, sf, "nearest")


@query(f"WITH {_IMG}, {_AT_SQL}, {_interpolate_sql(range(0, 2), 'floor({})', _LINEAR)}")
def interpolate_linear(spark, sf):
    return _interpolated(spark, sf, "linear")


@query(f"WITH {_IMG}, {_AT_SQL}, {_interpolate_sql(range(-2, 3), 'floor({} + 0.5)', _LANCZOS)}")
def interpolate_lanczos(spark, sf):
    return _interpolated(spark, sf, "lanczos")


_CUBIC = "(CASE WHEN abs({0}) < 1 THEN 2 / 3::DOUBLE - {0} * {0} + pow(abs({0}), 3) / 2 WHEN abs({0}) < 2 THEN pow(2 - abs({0}), 3) / 6 ELSE 0 END)"
_CUBIC_SLOPE = "(sign({0}) * CASE WHEN abs({0}) < 1 THEN 1.5 * {0} * {0} - 2 * abs({0}) WHEN abs({0}) < 2 THEN pow(2 - abs({0}), 2) / -2 ELSE 0 END)"
_WRAPPED = tuple(f"((({{}}) % {n} + {n}) % {n})" for n in ("(n.m + 1)", "8", "8"))


@query(f"WITH {_IMG}, {_AT_SQL}, {_interpolate_sql(range(-1, 3), 'floor({})', _CUBIC)}")
def interpolate_bspline(spark, sf):
    return _interpolated(spark, sf, "bspline")


def _around(spark, sf, kind: str, boundary: str, slope: str | None = None):
    rows, at = _samples(spark, sf)
    out = S.interpolate(rows, image(spark, sf), at, dict(zip(AXES, dims(spark, sf), strict=True)), [f"o{a}" for a in AXES], kind, boundary, slope=slope)
    return told(out.select(*[F.col(f"o{a}").alias(a) for a in AXES], "v"), "v")


@query(f"WITH {_IMG}, {_AT_SQL}, {_interpolate_sql(range(-1, 3), 'floor({})', _CUBIC, limits=_WRAPPED)}")
def interpolate_bspline_wrapped(spark, sf):
    return _around(spark, sf, "bspline", "wrap")


@query(f"WITH {_IMG}, {_AT_SQL}, {_interpolate_sql(range(-1, 3), 'floor({})', _CUBIC, limits=('{}',) * 3)}")
def interpolate_bspline_zero(spark, sf):
    return _around(spark, sf, "bspline", "zero")


@query(f"WITH {_IMG}, {_AT_SQL}, {_interpolate_sql(range(-1, 3), 'floor({})', _CUBIC).replace(_CUBIC.format('(uy - py)'), _CUBIC_SLOPE.format('(uy - py)'))}")
def bspline_slope(spark, sf):
    return _around(spark, sf, "bspline", "clamp", "y")


@query(f"WITH {_IMG}, {_AT_SQL}, {_interpolate_sql(range(0, 2), 'floor({})', _LINEAR, limits=_WRAPPED)}")
def interpolate_linear_wrapped(spark, sf):
    return _around(spark, sf, "linear", "wrap")


@query(f"WITH {_IMG} SELECT x, y, z, (x * 64 + y * 8 + z)::DOUBLE AS v FROM img")
def fill_linear(spark, sf):
    return told(S.fill_linear(image(spark, sf), AXES, list(dims(spark, sf))), "v")


@query(f"WITH {_IMG} SELECT x, y, z, 0.0::DOUBLE AS v FROM img")
def fill_zero(spark, sf):
    return told(S.fill_zero(image(spark, sf)), "v")


@query(f"WITH {_IMG}, {_LABEL}, {_MASK.replace('msk', 'm2')}, u AS (SELECT avg(img.v + 1.5) AS u FROM img JOIN m2 USING (x, y, z) WHERE m2.v > 0.5) SELECT x, y, z, round(CASE WHEN m2.v > 0.5 AND img.v + 1.5 > 0 THEN ln((img.v + 1.5) / u) ELSE 0 END, 6) + 0.0 AS v FROM img JOIN m2 USING (x, y, z) CROSS JOIN u")
def log_normalized(spark, sf):
    return told(M.log_normalized(image(spark, sf, F.col("v") + 1.5), _labels(spark, sf, -0.2)), "v")


_ZOOMED = 0.6


@query(f"""WITH p AS (SELECT vec_id AS x, o.i AS t, embedding AS e, (o.i - 32) * {_ZOOMED}::DOUBLE + 32 AS u FROM embeddings, range(64) o(i)), q AS (SELECT x, t, u, j.i AS j, e[j.i + 1]::DOUBLE AS v FROM p JOIN range(64) j(i) ON j.i BETWEEN round(u) - 4 AND round(u) + 4)
SELECT x, t, round(sum(v * CASE WHEN j = u THEN 1 WHEN abs(j - u) <= 4 THEN 4 * sin(pi() * (j - u)) * sin(pi() * (j - u) / 4) / (pi() * pi() * (j - u) * (j - u)) ELSE 0 END), 6) + 0.0 AS v FROM q GROUP BY x, t""")
def zoom_rows(spark, sf):
    rows = packed(spark, sf).select(F.col("x").cast("long").alias("x"), F.posexplode(P.zoom(F.col("ts"), _ZOOMED)).alias("t", "v"))
    return rows.select("x", F.col("t").cast("long").alias("t"), rounded("v").alias("v"))


_MOTION = M.Rigid(np.array([0.1, -0.05, 0.02]), np.array([0.4, -0.3, 0.2]), np.array([3.5, 3.5, 3.5]))


def _affine_sql(m: M.Rigid) -> str:
    c, s = m.center, m.shift
    return "spot AS (SELECT x, y, z, " + ", ".join(" + ".join(f"(({a} - {float(c[k])!r}::DOUBLE) * {float(m.matrix[r, k])!r}::DOUBLE)" for k, a in enumerate(AXES)) + f" + {float(c[r] + s[r])!r}::DOUBLE AS u{AXES[r]}" for r in range(3)) + " FROM img)"


@query(f"WITH {_IMG}, {_affine_sql(_MOTION.inverse())}, {_interpolate_sql(range(0, 2), 'floor({})', _LINEAR, limits=('{}',) * 3)}")
def rigid_transform(spark, sf):
    return told(M.rigid_transform(image(spark, sf), dims(spark, sf), _MOTION), "v")


_FIELD = {"x": "6e-1 * sin(x / 3e0) + 1e-1 * y", "y": "4e-1 * cos(x / 5e0) - 5e-2 * z", "z": "3e-1 * sin((x + y) / 4e0)"}  # exponents make doubles in both dialects


def _field(spark, sf) -> DataFrame:
    return image(spark, sf).select(*AXES, *[F.expr(e).cast("double").alias(f"d{a}") for a, e in _FIELD.items()])


_FIELD_SQL = "f AS (SELECT x, y, z, " + ", ".join(f"CAST({e} AS DOUBLE) AS d{a}" for a, e in _FIELD.items()) + " FROM img)"


@query(f"WITH {_IMG}, {_FIELD_SQL}, spot AS (SELECT x, y, z, x + dx AS ux, y + dy AS uy, z + dz AS uz FROM f), {_interpolate_sql(range(0, 2), 'floor({})', _LINEAR, limits=('{}',) * 3)}")
def apply_deformation(spark, sf):
    return told(M.apply_deformation(image(spark, sf), _field(spark, sf), dims(spark, sf), "linear"), "v")


#: A motion: three angles and three shifts; its cost and the six slopes of the cost.
_STEP = np.array([0.01, -0.02, 0.015, 0.3, -0.4, 0.25])
_MOVING = "0.8 * v + 0.05 * ((x + 2 * y + 3 * z) % 5)"


def _motion_sql() -> str:
    from math import cos, sin

    turn = {
        "x": lambda t: np.array([[1, 0, 0], [0, cos(t), -sin(t)], [0, sin(t), cos(t)]]), "y": lambda t: np.array([[cos(t), 0, sin(t)], [0, 1, 0], [-sin(t), 0, cos(t)]]),
        "z": lambda t: np.array([[cos(t), -sin(t), 0], [sin(t), cos(t), 0], [0, 0, 1]]),
    }
    slope = {"x": lambda t: np.array([[0, 0, 0], [0, -sin(t), -cos(t)], [0, cos(t), -sin(t)]]), "y": lambda t: np.array([[-sin(t), 0, cos(t)], [0, 0, 0], [-cos(t), 0, -sin(t)]]), "z": lambda t: np.array([[-sin(t), -cos(t), 0], [cos(t), -sin(t), 0], [0, 0, 0]])}
    angle = dict(zip("xyz", _STEP[:3].tolist(), strict=True))

    def product(by: str | None) -> np.ndarray:
        m = np.eye(3)
        for axis in "xyz":
            m = m @ (slope if axis == by else turn)[axis](angle[axis])
        return m

    def row(m: np.ndarray, r: int) -> str:
        return " + ".join(f"({float(m[r, k])!r}) * d{a}" for k, a in enumerate("xyz"))

    m = product(None)
    half = {"x": "n.m / 2e0", "y": "3.5", "z": "3.5"}
    place = ", ".join(f"{row(m, r)} + {half[a]} + ({float(_STEP[3 + r])!r}) AS p{a}" for r, a in enumerate("xyz"))
    weight = {a: f"(CASE {c} WHEN 1 THEN p{a} - floor(p{a}) ELSE 1 - (p{a} - floor(p{a})) END)" for a, c in zip("xyz", "ijk", strict=True)}
    look = " * ".join(weight.values())
    rise = {a: " * ".join([f"(2 * {c} - 1)", *[w for b, w in weight.items() if b != a]]) for a, c in zip("xyz", "ijk", strict=True)}
    turned = [" + ".join(f"g{'xyz'[r]} * ({row(product(by), r)})" for r in range(3)) for by in "xyz"]
    qs = [f"({t})" for t in turned] + [f"g{a}" for a in "xyz"]
    each = ", ".join(f"avg(q{k}) AS m{k}, avg(a * q{k}) AS a{k}, avg(b * q{k}) AS b{k}" for k in range(6))
    grad = ", ".join(f"-sign(r) * (((a{k} - ma * m{k}) / sqrt(vaa * vbb)) - r * (b{k} - mb * m{k}) / vbb) AS s{k}" for k in range(6))
    return f"""WITH {_IMG}, mov AS (SELECT x, y, z, {_MOVING} AS v FROM img),
c AS (SELECT x, y, z, v AS a, x - n.m / 2e0 AS dx, y - 3.5 AS dy, z - 3.5 AS dz FROM img, n), p AS (SELECT c.*, {place} FROM c, n),
l AS (SELECT p.x, p.y, p.z, any_value(a) AS a, any_value(dx) AS dx, any_value(dy) AS dy, any_value(dz) AS dz, coalesce(sum(mov.v * {look}), 0) AS b, {", ".join(f"coalesce(sum(mov.v * {w}), 0) AS g{a}" for a, w in rise.items())}
FROM p CROSS JOIN range(2) ri(i) CROSS JOIN range(2) rj(j) CROSS JOIN range(2) rk(k) LEFT JOIN mov ON mov.x = floor(px) + i AND mov.y = floor(py) + j AND mov.z = floor(pz) + k GROUP BY p.x, p.y, p.z),
q AS (SELECT a, b, {", ".join(f"{e} AS q{k}" for k, e in enumerate(qs))} FROM l),
s AS (SELECT avg(a) AS ma, avg(b) AS mb, var_pop(a) AS vaa, var_pop(b) AS vbb, corr(a, b) AS r, {each} FROM q),
t AS (SELECT -abs(r) AS cost, {grad} FROM s) SELECT round(cost, 6) + 0.0 AS cost, {", ".join(f"round(s{k}, 6) + 0.0 AS s{k}" for k in range(6))} FROM t"""


@query(_motion_sql())
def rigid_cost_slopes(spark, sf):
    fixed = image(spark, sf)
    moving = fixed.withColumn("v", F.expr(_MOVING))
    size = dims(spark, sf)
    cost, slope = M.rigid_cost_over(M.correlation_metric, fixed, moving, size, (np.array(size) - 1) / 2, _STEP)
    names = ["cost", *[f"s{k}" for k in range(6)]]
    row = spark.createDataFrame([(float(cost), *map(float, slope))], ", ".join(f"{n} double" for n in names))  # the result itself: seven numbers
    return row.select(*[rounded(n).alias(n) for n in names])


def _slope_sql(value: str, axis: str) -> str:
    others = ", ".join(a for a in AXES if a != axis)
    w = f"OVER (PARTITION BY {others} ORDER BY {axis})"
    return f"coalesce((coalesce(lead({value}) {w}, {value}) - coalesce(lag({value}) {w}, {value})) / nullif(CAST(lead({value}) {w} IS NOT NULL AS INT) + CAST(lag({value}) {w} IS NOT NULL AS INT), 0), 0)"


_J = "j AS (SELECT x, y, z, " + ", ".join(f"{_slope_sql('d' + r, c)} + {int(r == c)} AS m{r}{c}" for r in AXES for c in AXES) + " FROM f)"


@query(f"WITH {_IMG}, {_FIELD_SQL}, {_J} SELECT x, y, z, round(mxx * (myy * mzz - myz * mzy) - mxy * (myx * mzz - myz * mzx) + mxz * (myx * mzy - myy * mzx), 6) + 0.0 AS det FROM j")
def jacobian(spark, sf):
    return told(M.jacobian(_field(spark, sf), dims(spark, sf)), "det")


#: A field that no fixed-point step inverts: along z it rises by 1.5 a voxel, along y it falls by half, x is shifted by y.
_STRONG = {"x": "0.25 * y", "y": "-0.5 * (y - 3.5)", "z": "1.5 * (z - 3.5)"}


@query(f"""WITH {_IMG} SELECT x, y, z, round(-0.25 * w, 3) + 0.0 AS dx, round(w - y, 3) + 0.0 AS dy, round((z - 3.5e0) / 2.5e0 - (z - 3.5e0), 3) + 0.0 AS dz FROM (SELECT *, (y - 3.5e0) / 0.5e0 + 3.5e0 AS w FROM img)
WHERE w BETWEEN 0 AND 7 AND x - 0.25 * w BETWEEN 0 AND (SELECT m FROM n)""")
def inverted_field(spark, sf):
    """The inverse of a strong field, at the voxels that it reaches from inside of the image."""
    field = image(spark, sf).select(*AXES, *[F.expr(e).cast("double").alias(f"d{a}") for a, e in _STRONG.items()])
    size = dims(spark, sf)
    out = M.invert_deformation(field, size)
    inside = [(F.col(a) + F.col(f"d{a}")).between(-1e-6, n - 1 + 1e-6) for a, n in zip(AXES, size, strict=True)]
    return told(out.filter(inside[0] & inside[1] & inside[2] & (F.col("residual") < 1e-3)), "dx", "dy", "dz", digits=3)


@query(f"WITH {_IMG}, {_FIELD_SQL} SELECT x, y, z, " + ", ".join(f"round({a} + d{a} - 1 - {a}, 6) + 0.0 AS d{a}" for a in AXES) + " FROM f")
def index_map_offsets(spark, sf):
    absolute = _field(spark, sf).select(*AXES, *[(F.col(a) + F.col(f"d{a}")).alias(f"i{a}") for a in AXES])
    return told(M.index_map_to_offsets(absolute, one_based=True), "dx", "dy", "dz")


_TURN = M.rotation(0.1, 0.2, 0.3)
_PLACED = Geometry((8, 8, 8), np.array([2.0, 1.5, 3.0]), np.array([-10.0, 5.0, 1.0]), _TURN)


def _turned(m: np.ndarray, names: list[str]) -> list[str]:
    return [" + ".join(f"{n} * {float(m[r, k])!r}" for k, n in enumerate(names)) for r in range(3)]


@query(f"WITH {_IMG}, {_FIELD_SQL} SELECT x, y, z, " + ", ".join(f"round({e}, 6) + 0.0 AS d{a}" for a, e in zip(AXES, _turned(_TURN, ["dx", "dy", "dz"]), strict=True)) + " FROM f")
def reorient_vectors(spark, sf):
    return told(M.reorient_vectors(_field(spark, sf), _PLACED), "dx", "dy", "dz")


_POINT = _turned(_TURN, [f"({a} * {float(s)!r})" for a, s in zip(AXES, _PLACED.spacing, strict=True)])
_POINT_SQL = "p AS (SELECT x, y, z, " + ", ".join(f"{e} + {float(o)!r} AS p{a}" for a, e, o in zip(AXES, _POINT, _PLACED.origin, strict=True)) + " FROM img)"


@query(f"WITH {_IMG}, {_POINT_SQL} SELECT x, y, z, " + ", ".join(f"round(p{a}, 6) + 0.0 AS p{a}" for a in AXES) + " FROM p")
def index_to_point(spark, sf):
    point = _PLACED.to_point([F.col(a).cast("double") for a in AXES])
    return told(image(spark, sf).select(*AXES, *[c.alias(f"p{a}") for a, c in zip(AXES, point, strict=True)]), "px", "py", "pz")


_BACK = _turned(np.linalg.inv(_TURN), [f"({a} - {float(o)!r})" for a, o in zip(AXES, _PLACED.origin, strict=True)])


@query(f"WITH {_IMG}, q AS (SELECT x, y, z, " + ", ".join(f"({e}) / {float(s)!r} AS u{a}" for a, e, s in zip(AXES, _BACK, _PLACED.spacing, strict=True)) + " FROM img) SELECT x, y, z, " + ", ".join(f"round(u{a}, 6) + 0.0 AS u{a}" for a in AXES) + ", CASE WHEN " + " AND ".join(f"u{a} >= -0.5 AND u{a} <= 7.5" for a in AXES) + " THEN 1.0 ELSE 0.0 END::DOUBLE AS inside FROM q")
def point_to_index(spark, sf):
    point = [F.col(a).cast("double") for a in AXES]
    index = _PLACED.to_index(point)
    return told(image(spark, sf).select(*AXES, *[c.alias(f"u{a}") for a, c in zip(AXES, index, strict=True)], _PLACED.point_inside(point).cast("double").alias("inside")), "ux", "uy", "uz", "inside")


@query(f"WITH {_IMG} SELECT x - 10 AS x, y - 2 AS y, z + 3 AS z, round(v, 6) + 0.0 AS v FROM img WHERE x BETWEEN 10 AND 109 AND y BETWEEN 2 AND 5 AND z BETWEEN 1 AND 6")
def copy_region(spark, sf):
    return told(S.copy_region(image(spark, sf), {"x": 10, "y": 2, "z": 1}, {"x": 100, "y": 4, "z": 6}, {"x": 0, "y": 0, "z": 4}), "v")


@query(f"WITH {_IMG} SELECT x, y, z, round(v, 6) + 0.0 AS v, CAST(0 AS BIGINT) AS t FROM img UNION ALL SELECT x, y, z, round(-v, 6) + 0.0, CAST(1 AS BIGINT) FROM img")
def stack_images(spark, sf):
    both = S.stack([image(spark, sf), image(spark, sf, -F.col("v"))], "t")
    return both.select(*[F.col(a).cast("long").alias(a) for a in AXES], rounded("v").alias("v"), F.col("t").cast("long").alias("t"))


# ---- spectra -----------------------------------------------------------------------


@query(f"""WITH {_IMG} SELECT a.x, f.i AS y, g.i AS z, round(sum(v * cos(2 * pi() * (f.i * a.y + g.i * a.z) / 8)), 6) + 0.0 AS re, round(-sum(v * sin(2 * pi() * (f.i * a.y + g.i * a.z) / 8)), 6) + 0.0 AS im
FROM img a CROSS JOIN range(8) f(i) CROSS JOIN range(8) g(i) GROUP BY a.x, f.i, g.i""")
def fft_forward(spark, sf):
    return told(P.fft(image(spark, sf).withColumnRenamed("v", "re"), ["y", "z"], keep=["x"]), "re", "im")


@query(f"WITH {_IMG} SELECT x, y, z, round(v, 6) + 0.0 AS re, 0.0::DOUBLE AS im FROM img")
def fft_backward(spark, sf):
    there = P.fft(image(spark, sf).withColumnRenamed("v", "re"), ["y", "z"], keep=["x"])
    return told(P.fft(there, ["y", "z"], inverse=True, keep=["x"]), "re", "im")


_RISE = "(1 + 2 * (cos(2 * pi() * {t} / 8) + cos(4 * pi() * {t} / 8) + cos(6 * pi() * {t} / 8)) + cos(pi() * {t})) / 8"


@query(f"WITH {_IMG} SELECT x, y, m.i AS z, round(sum(v * {_RISE.format(t='(m.i / 2.0 - z)')}), 6) + 0.0 AS v FROM img CROSS JOIN range(16) m(i) GROUP BY x, y, m.i")
def resample_spectrum(spark, sf):
    return told(P.resample(image(spark, sf), {"z": 2.0}, keep=["x", "y"]), "v")


def _ramp(distance: str) -> str:
    terms = " + ".join(f"cos(2 * pi() * {k} * (m.i - z - {distance}) / 16)" for k in range(-8, 8))
    return f"WITH {_IMG} SELECT x, y, m.i AS z, round(sum(v * ({terms}) / 16), 6) + 0.0 AS v FROM img CROSS JOIN range(8) m(i) GROUP BY x, y, m.i"


@query(_ramp("1.3"))
def shift_spectrum(spark, sf):
    return told(P.shift(image(spark, sf), "z", 1.3, ["x", "y"]), "v")


@query(_ramp("(0.15 * (y - 3.5))"))
def shear_spectrum(spark, sf):
    return told(P.shear(image(spark, sf), "z", {"y": 0.15}, {"y": 3.5}, ["x", "y"], kernel=False), "v")


def _kernel_shift(distance: str, radius: int) -> str:
    u = "(u - j.z)"
    w = f"CASE WHEN {u} = 0 THEN 1 WHEN abs({u}) < {radius} THEN {radius} * sin(pi() * {u}) * sin(pi() * {u} / {radius}) / (pi() * pi() * {u} * {u}) ELSE 0 END"
    return f"""WITH {_IMG}, a AS (SELECT x, y, z, CAST(z AS DOUBLE) - {distance} AS u FROM img)
SELECT a.x, a.y, a.z, round(coalesce(sum(j.v * {w}), 0), 6) + 0.0 AS v FROM a LEFT JOIN img j ON j.x = a.x AND j.y = a.y AND j.z BETWEEN floor(u) - {radius - 1} AND floor(u) + {radius} GROUP BY a.x, a.y, a.z"""


@query(_kernel_shift("1.3", 3))
def shift_kernel(spark, sf):
    return told(P.shift(image(spark, sf), "z", 1.3, ["x", "y"], kernel=True), "v")


@query(_kernel_shift("(0.15 * (y - 3.5))", 5))
def shear_kernel(spark, sf):
    return told(P.shear(image(spark, sf), "z", {"y": 0.15}, {"y": 3.5}, ["x", "y"]), "v")


@query(f"""WITH {_IMG}, s AS (SELECT x, y * 8 + z AS t, v FROM img) SELECT x, k.i AS t, round(sum(v * cos(2 * pi() * 0.7 * t * (k.i - 32e0) / 64)), 6) + 0.0 AS re, round(-sum(v * sin(2 * pi() * 0.7 * t * (k.i - 32e0) / 64)), 6) + 0.0 AS im
FROM s CROSS JOIN range(64) k(i) GROUP BY x, k.i""")
def chirp_z_rows(spark, sf):
    return _complex(P.chirp_z_rows(packed(spark, sf), 0.7))


_DEGREES = (10, 20, 30)


def _shear_rotation_sql() -> str:
    """Rotation about x: y, z and again y sheared by the tangent of half the angle and its sine."""
    parts, out = [], []
    for angle in _DEGREES:
        last, t = "img", f"radians({angle}e0)"
        for k, (axis, other, slope) in enumerate([("y", "z", f"(-tan({t} / 2))"), ("z", "y", f"sin({t})"), ("y", "z", f"(-tan({t} / 2))")]):
            name, same = f"r{angle}_{k}", " AND ".join(f"j.{a} = i.{a}" for a in AXES if a != axis)
            d = f"({axis}_at - j.{axis})"
            w = f"CASE WHEN {d} = 0 THEN 1 WHEN abs({d}) < 5 THEN 5 * sin(pi() * {d}) * sin(pi() * {d} / 5) / (pi() * pi() * {d} * {d}) ELSE 0 END"
            parts.append(f"{name} AS (SELECT i.x, i.y, i.z, coalesce(sum(j.v * {w}), 0) AS v FROM (SELECT x, y, z, {axis} - {slope} * ({other} - 3.5e0) AS {axis}_at FROM {last}) i LEFT JOIN {last} j ON {same} AND j.{axis} BETWEEN floor({axis}_at) - 4 AND floor({axis}_at) + 5 GROUP BY i.x, i.y, i.z)")
            last = name
        out.append(f"SELECT {angle} AS degrees, x, y, z, round(v, 6) + 0.0 AS v FROM {last}")
    return f"WITH {_IMG}, {', '.join(parts)} " + " UNION ALL ".join(out)


@query(_shear_rotation_sql())
def rotate_by_shears(spark, sf):
    rows, size = image(spark, sf), dims(spark, sf)
    turned = [M.rotate_by_shears(rows, size, float(np.radians(angle)), 0.0, 0.0, orders=[(1, 2, 1)]).select(F.lit(angle).alias("degrees"), *AXES, "v") for angle in _DEGREES]
    out = turned[0].unionByName(turned[1]).unionByName(turned[2])
    return out.select("degrees", *[F.col(a).cast("long").alias(a) for a in AXES], rounded("v").alias("v"))


#: Each plane of the image (one x) is a 2-d image of 8 x 8: z is the radial axis, with 16 places; y is chirped, to 16 places.
@query(f"""WITH {_IMG}, r AS (SELECT x, y, k.i AS z, sum(v * cos(2 * pi() * img.z * (k.i - 8e0) / 16)) AS re, -sum(v * sin(2 * pi() * img.z * (k.i - 8e0) / 16)) AS im FROM img CROSS JOIN range(16) k(i) GROUP BY x, y, k.i),
c AS (SELECT x, m.i AS y, z, re, im, 2 * pi() * (2e0 * z / 15 - 1) * y * (m.i - 8e0) / 16 AS a FROM r CROSS JOIN range(16) m(i))
SELECT x, y, z, round(sum(re * cos(a) + im * sin(a)), 6) + 0.0 AS re, round(sum(im * cos(a) - re * sin(a)), 6) + 0.0 AS im FROM c GROUP BY x, y, z""")
def pseudo_polar(spark, sf):
    out = P.pseudo_polar(image(spark, sf), ["y", "z"], [8, 8], "z", keep=["x"])
    return told(out, "re", "im")


#: Order 0.75 of the fractional transform: its phase is 3 pi / 8, the scale's phase pi / 16.
_TURN = "pi() * ((k * k + l * l) / tan(3 * pi() / 8) - 2 * k * l / sin(3 * pi() / 8)) + pi() * (3e0 / 16 - 1e0 / 4)"


@query(f"""WITH {_IMG}, s AS (SELECT x, (y * 8 + z - 32) / 8e0 AS l, v FROM img), g AS (SELECT i AS t, (i - 32) / 8e0 AS k FROM range(64) r(i))
SELECT x, t, round(sum(v * cos({_TURN})) / 8 / sqrt(sin(3 * pi() / 8)), 6) + 0.0 AS re, round(sum(v * sin({_TURN})) / 8 / sqrt(sin(3 * pi() / 8)), 6) + 0.0 AS im FROM s CROSS JOIN g GROUP BY x, t""")
def fractional_fourier_rows(spark, sf):
    return _complex(P.fractional_fourier_rows(packed(spark, sf), 0.75))


def _window(d: str) -> str:
    return f"CASE WHEN {d} = 0 THEN 1e0 WHEN abs({d}) < 5 THEN 5 * sin(pi() * {d}) * sin(pi() * {d} / 5) / (pi() * pi() * {d} * {d}) ELSE 0e0 END"


@query(f"""WITH {_IMG}, s AS (SELECT x, y * 8 + z AS t, v FROM img), g AS (SELECT i AS j, (i - 64) * 64e0 / 129 AS k FROM range(129) r(i)),
a AS (SELECT j, k, i AS t, {_window("(k + 32 - i)")} AS w FROM g CROSS JOIN range(64) r(i)),
b AS (SELECT g.j, a.t, sum(w * cos(2 * pi() * 0.4 * g.k * a.k / 64)) AS re, -sum(w * sin(2 * pi() * 0.4 * g.k * a.k / 64)) AS im FROM g CROSS JOIN a GROUP BY g.j, a.t),
c AS (SELECT i AS o, t, sum(re * {_window("((i - 32) * 129e0 / 64 + 64 - j)")}) AS re, sum(im * {_window("((i - 32) * 129e0 / 64 + 64 - j)")}) AS im FROM b CROSS JOIN range(64) r(i) GROUP BY i, t)
SELECT x, o AS t, round(sum(v * re), 6) + 0.0 AS re, round(sum(v * im), 6) + 0.0 AS im FROM s JOIN c USING (t) GROUP BY x, o""")
def chirplet_rows(spark, sf):
    return _complex(P.chirplet_rows(packed(spark, sf), 0.4))


# ---- series ------------------------------------------------------------------------


@query(f"""WITH {_IMG}, s AS (SELECT x, y * 8 + z AS t, v FROM img), f AS (SELECT x, regr_slope(v, t) AS b, regr_intercept(v, t) AS a FROM s GROUP BY x)
SELECT x, t, round(v - a - b * t, 6) + 0.0 AS v FROM s JOIN f USING (x)""")
def series_residual(spark, sf):
    design = np.column_stack([np.arange(64.0), np.ones(64)])
    out = R.regress_out(packed(spark, sf), design).select("x", F.posexplode("ts").alias("t", "v"))
    return out.select(F.col("x").cast("long").alias("x"), F.col("t").cast("long").alias("t"), rounded("v").alias("v"))


@query(f"WITH {_IMG} SELECT x, round(sum(v), 6) + 0.0 AS sum, round(avg(v), 6) + 0.0 AS avg, round(var_samp(v), 6) + 0.0 AS var, round(min(v), 6) + 0.0 AS min, round(max(v), 6) + 0.0 AS max, round(list_sort(list(v))[33], 6) + 0.0 AS median FROM img GROUP BY x")
def packed_reduce(spark, sf):
    from ..operators import aggregate as A

    return A.packed_reduce(packed(spark, sf)).select(F.col("x").cast("long").alias("x"), *[rounded(c).alias(c) for c in ("sum", "avg", "var", "min", "max", "median")])


_SPHERE = (20, 8, 8)


@query(f"""SELECT x.i AS x, y.i AS y, z.i AS z, CASE WHEN (x.i - 9.5) * (x.i - 9.5) + (y.i - 3.5) * (y.i - 3.5) + (z.i - 3.5) * (z.i - 3.5) < 9 THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM range({_SPHERE[0]}) x(i), range({_SPHERE[1]}) y(i), range({_SPHERE[2]}) z(i)""")
def fill_sphere(spark, sf):
    from .pipelines import sphere

    return told(sphere(spark, _SPHERE, (9.5, 3.5, 3.5), 3.0), "v")


_OTHER = Geometry((10, 6, 9), np.array([1.5, 2.0, 2.5]), np.array([-8.0, 6.0, 0.0]), M.rotation(0.0, 0.1, 0.2))


def _overlap_sql() -> str:
    a = _turned(_OTHER.direction, [f"(x.i * {float(_OTHER.spacing[0])!r})", f"(y.i * {float(_OTHER.spacing[1])!r})", f"(z.i * {float(_OTHER.spacing[2])!r})"])
    points = ", ".join(f"{e} + {float(o)!r} AS {n}" for e, o, n in zip(a, _OTHER.origin, AXES, strict=True))
    index = ", ".join(f"({e}) / {float(s)!r} AS u{n}" for e, s, n in zip(_BACK, _PLACED.spacing, AXES, strict=True))
    inside = " AND ".join(f"u{n} >= -0.5 AND u{n} <= 7.5" for n in AXES)
    return f"WITH p AS (SELECT {points} FROM range(10) x(i), range(6) y(i), range(9) z(i)), q AS (SELECT {index} FROM p) SELECT round(avg(CASE WHEN {inside} THEN 1.0 ELSE 0.0 END), 6) AS ratio FROM q"


@query(_overlap_sql())
def overlap_ratio(spark, sf):
    return spark.createDataFrame([(S.overlap_ratio(spark, _OTHER, _PLACED),)], "ratio double").select(rounded("ratio").alias("ratio"))


def _label_points_sql() -> str:
    turned = _turned(_PLACED.direction, [f"(x * {float(_PLACED.spacing[0])!r})", f"(y * {float(_PLACED.spacing[1])!r})", f"(z * {float(_PLACED.spacing[2])!r})"])
    at = ", ".join(f"round({e} + {float(o)!r}, 6) + 0.0 AS p{n}" for e, o, n in zip(turned, _PLACED.origin, AXES, strict=True))
    return f"WITH {_IMG}, {_LABEL} SELECT CAST(v AS BIGINT) AS label, {at} FROM lab WHERE v <> 0"


@query(_label_points_sql())
def label_points(spark, sf):
    points = S.label_points(_labels(spark, sf), _PLACED)
    return points.select("label", *[rounded(F.get("p", F.lit(k))).alias(f"p{a}") for k, a in enumerate(AXES)])


_TIMES = Geometry((8, 8, 7), slice_order="ALT", slice_duration=0.25)


@query("SELECT CAST(s AS BIGINT) AS slice, (CASE WHEN s % 2 = 0 THEN s // 2 ELSE 4 + s // 2 END) * 0.25::DOUBLE AS time FROM range(7) t(s)")
def slice_times(spark, sf):
    return spark.createDataFrame(sorted(_TIMES.slice_times(0, 6).items()), "slice long, time double")


def _odd_smooth_sql() -> str:
    made = sorted({3**a * 5**b * 7**c for a, b, c in itertools.product(range(6), range(4), range(4))})
    return "WITH s(v) AS (VALUES " + ", ".join(f"({v})" for v in made if v <= 2 * max(made) ** 0.5 + 1000) + ") SELECT p_size AS n, CAST(min(v) AS INT) AS size FROM (SELECT DISTINCT CAST(p_size AS INT) AS p_size FROM part) JOIN s ON v > p_size GROUP BY p_size"


@query(_odd_smooth_sql())
def next_odd_smooth(spark, sf):
    sizes = table(spark, sf, "part").select(F.col("p_size").cast("int").alias("n")).distinct()

    def run(batches):
        for b in batches:
            yield b.assign(size=[K.next_odd_smooth(int(n)) for n in b["n"]])

    return sizes.mapInPandas(run, "n int, size int")
