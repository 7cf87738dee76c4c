"""Driver-contract queries of scalar kernels, statistics, series and graphs, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import aggregate as A
from ..operators import decomposition as D
from ..operators import graph as G
from ..operators import regression as R
from .registry import query, rounded, table

# ---- scalar kernels ----------------------------------------------------------------

_X = "(p_size - 25) / 10e0"
_PX = "pi() * x"


@query(f"""WITH a AS (SELECT p_partkey, {_X} AS x FROM part) SELECT p_partkey,
CASE WHEN abs(x) < 1.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS rect,
round(CASE WHEN abs(x) >= 2 THEN 0 WHEN x = 0 THEN 1 ELSE sin({_PX} / 2) / ({_PX} / 2) END, 9) + 0.0 AS sinc,
round(exp(-2 * pi() * pi() * 0.09 * x * x), 9) AS freq_gaussian,
round(CASE WHEN x = 0 OR abs(x) >= 2 THEN 0 ELSE ({_PX} * cos({_PX} / 2) * sin({_PX}) + 2 * sin({_PX} / 2) * ({_PX} * cos({_PX}) - 2 * sin({_PX}))) / (pi() * pi() * x * x * x) END, 9) + 0.0 AS d_lanczos,
round(CASE WHEN abs(x) < 1.5 THEN (1 - abs(x / 1.5)) / 1.5 ELSE 0 END, 9) + 0.0 AS lin,
round(CASE WHEN x < 1.5 AND x > 0 THEN -1 / 2.25 WHEN x > -1.5 AND x < 0 THEN 1 / 2.25 ELSE 0 END, 9) + 0.0 AS d_lin,
round(sign(x) * CASE WHEN abs(x) < 1 THEN -2 * abs(x) + 1.5 * x * x WHEN abs(x) < 2 THEN -(2 - abs(x)) * (2 - abs(x)) / 2 ELSE 0 END, 9) + 0.0 AS d_b3,
round(CASE WHEN abs(x) < 1 THEN 3 * abs(x) - 2 WHEN abs(x) < 2 THEN 2 - abs(x) ELSE 0 END, 9) + 0.0 AS dd_b3,
greatest(-1.0, least(1.0, x))::DOUBLE AS clamped FROM a""")
def window_kernels(spark, sf):
    x = (F.col("p_size") - 25) / F.lit(10.0)
    named = {"rect": K.rect_window(x, 1.5), "sinc": K.sinc_window(x, 2.0), "freq_gaussian": K.freq_gaussian(x, 0.3), "d_lanczos": K.d_lanczos(x, 2.0), "lin": K.linear_kernel(x, 1.5), "d_lin": K.d_linear_kernel(x, 1.5), "d_b3": K.d_b3(x), "dd_b3": K.dd_b3(x)}
    return table(spark, sf, "part").select("p_partkey", *[rounded(c, 9).alias(n) for n, c in named.items()], K.clamp(-1.0, 1.0, x).alias("clamped"))


def _low(f: str, c: float) -> str:
    return f"(1 / (1 + pow({f} / {c}, 4)))"


@query(f"""WITH a AS (SELECT p_partkey, p_size / 10e0 AS f FROM part) SELECT p_partkey, round(1 - {_low('f', 1.5)}, 9) + 0.0 AS high, round({_low('f', 3.0)} - {_low('f', 0.7)}, 9) + 0.0 AS band, round({_low('f', 0.7)} + 1 - {_low('f', 3.0)}, 9) + 0.0 AS stop,
round(exp(1.5 * ln(f) - f / 0.7 - lgamma(2.5) - 2.5 * ln(0.7)), 9) AS gamma,
round(exp((2.25 - 1) * ln(f) - f / (0.64 / 1.2) - lgamma(2.25) - 2.25 * ln(0.64 / 1.2)), 9) AS gamma_ms,
round(exp(5 * ln(f) - f - lgamma(6)) - exp(15 * ln(f) - f - lgamma(16)) / 6, 9) + 0.0 AS hrf,
CASE WHEN f <= 4 THEN CASE WHEN f < 0.5 THEN 0 ELSE round(CASE WHEN f > 0.5 THEN exp((6 / 0.8 - 1) * ln(f - 0.5) - (f - 0.5) * 0.8 - lgamma(6 / 0.8) + 6 / 0.8 * ln(0.8)) - exp((16 / 1.3 - 1) * ln(f - 0.5) - (f - 0.5) * 1.3 - lgamma(16 / 1.3) + 16 / 1.3 * ln(1.3)) / 4 ELSE 0 END, 9) END ELSE 0 END + 0.0 AS hrf_spread FROM a""")
def response_kernels(spark, sf):
    f = F.col("p_size") / F.lit(10.0)
    named = {"high": K.high_pass(f, 1.5), "band": K.band_pass(f, 3.0, 0.7), "stop": K.band_stop(f, 0.7, 3.0), "gamma": K.gamma_pdf(f, 2.5, 0.7), "gamma_ms": K.gamma_pdf_ms(1.2, 0.8, f), "hrf": K.canonical_hrf(f), "hrf_spread": K.canonical_hrf(f, 6.0, 16.0, 0.8, 1.3, 4.0, 0.5, 4.0)}
    return table(spark, sf, "part").select("p_partkey", *[rounded(c, 9).alias(n) for n, c in named.items()])


@query("""WITH a AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS n, p_size / 17e0 AS x FROM part) SELECT p_partkey, ((n - 3) % 7 + 7) % 7 + 3 AS wrapped,
CAST(pow(2, floor(log2(n))) AS BIGINT) AS highest_bit, CAST(CASE WHEN n <= 1 THEN 1 ELSE pow(2, ceil(log2(n))) END AS BIGINT) AS power_of_two,
round(1 / tan(x), 6) + 0.0 AS cot, round(1 / sin(x), 6) + 0.0 AS csc, round(1 / cos(x), 6) + 0.0 AS sec, round(radians(x), 9) AS radians, round(degrees(x), 6) AS degrees FROM a""")
def integer_kernels(spark, sf):
    n, x = F.col("p_size").cast("long"), F.col("p_size") / F.lit(17.0)
    return table(spark, sf, "part").select(
        "p_partkey", K.wrap(F.lit(3), F.lit(9), n).cast("long").alias("wrapped"), K.highest_bit(n).alias("highest_bit"), K.next_power_of_two(n).alias("power_of_two"),
        rounded(K.cot(x)).alias("cot"), rounded(K.csc(x)).alias("csc"), rounded(K.sec(x)).alias("sec"), rounded(K.radians(x), 9).alias("radians"), rounded(K.degrees(x)).alias("degrees"),
    )


@query("""WITH RECURSIVE f(n, rest, p, k) AS (SELECT DISTINCT CAST(p_size AS BIGINT), CAST(p_size AS BIGINT), CAST(2 AS BIGINT), CAST(0 AS BIGINT) FROM part
UNION ALL SELECT n, CASE WHEN rest % p = 0 THEN rest // p ELSE rest END, CASE WHEN rest % p = 0 THEN p ELSE p + 1 END, CASE WHEN rest % p = 0 THEN p ELSE 0 END FROM f WHERE rest > 1)
SELECT n, k AS factor, count(*) AS times FROM f WHERE k > 0 GROUP BY n, k""")
def prime_factors(spark, sf):
    n = table(spark, sf, "part").select(F.col("p_size").cast("long").alias("n")).distinct()
    return n.select("n", F.explode(K.prime_factors(F.col("n"))).alias("factor")).groupBy("n", "factor").agg(F.count("*").alias("times"))


@query("""WITH a AS (SELECT p_partkey, p_size / 10e0 AS a, (p_size - 30) / 7e0 AS b FROM part) SELECT p_partkey, round(sqrt(a * a + b * b), 9) AS size, round(atan2(b, a), 9) + 0.0 AS phase, round(a * b - b * a, 9) + 0.0 AS re, round(a * a + b * b, 9) AS im,
greatest(0, least(255, CAST(trunc(a * 100 - 50) AS INT))) AS r, greatest(0, least(255, CAST(trunc(b * 100) AS INT))) AS g FROM a""")
def complex_and_colour(spark, sf):
    a, b = F.col("p_size") / F.lit(10.0), (F.col("p_size") - 30) / F.lit(7.0)
    z, w = K.complex_of(a, b), K.complex_of(b, a)
    product, colour = K.complex_mul(z, w), K.rgba(a * 100 - 50, b * 100, a)
    return table(spark, sf, "part").select("p_partkey", rounded(K.complex_abs(z), 9).alias("size"), rounded(K.complex_phase(z), 9).alias("phase"), rounded(product["re"], 9).alias("re"), rounded(product["im"], 9).alias("im"), colour["r"].cast("int").alias("r"), colour["g"].cast("int").alias("g"))


# ---- statistics --------------------------------------------------------------------

_T = f"exp(lgamma(5.5) - lgamma(5)) / sqrt({math.pi * 10!r}) * pow(1 + {{0}} * {{0}} / 10, -5.5)"


@query(f"""WITH g AS (SELECT i * 0.05e0 AS t FROM range(401) r(i)), a AS (SELECT t, {_T.format('t')} AS pdf, ({_T.format('t')} + 4 * {_T.format('(t + 0.025e0)')} + {_T.format('(t + 0.05e0)')}) * 0.05 / 6 AS area FROM g)
SELECT round(t, 6) AS t, round(pdf, 9) AS pdf, round(0.5 + coalesce(sum(area) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 9) AS cdf FROM a""")
def student_t_density(spark, sf):
    return R.student_table(spark, 10).select(rounded("t").alias("t"), rounded("pdf", 9).alias("pdf"), rounded("cdf", 9).alias("cdf"))


_MOMENTS = "SELECT avg(a) ma, avg(b) mb, avg(c) mc, avg(a * a) - avg(a) * avg(a) aa, avg(b * b) - avg(b) * avg(b) bb, avg(c * c) - avg(c) * avg(c) cc, avg(a * b) - avg(a) * avg(b) ab, avg(a * c) - avg(a) * avg(c) ac, avg(b * c) - avg(b) * avg(c) bc FROM (SELECT l_extendedprice / 1e4 AS a, l_quantity / 1e1 AS b, l_discount * 1e1 AS c FROM lineitem)"


def _scaled(spark, sf):
    return table(spark, sf, "lineitem").select((F.col("l_extendedprice") / 1e4).alias("a"), (F.col("l_quantity") / 1e1).alias("b"), (F.col("l_discount") * 1e1).alias("c"))


@query(f"WITH m AS ({_MOMENTS}), s AS (SELECT *, (ab * cc - ac * bc) / (bb * cc - bc * bc) AS b1, (ac * bb - ab * bc) / (bb * cc - bc * bc) AS b2 FROM m) SELECT round(b1, 6) + 0.0 AS b1, round(b2, 6) + 0.0 AS b2, round(ma - b1 * mb - b2 * mc, 6) + 0.0 AS intercept, round((b1 * ab + b2 * ac) / aa, 6) + 0.0 AS rsqr FROM s")
def ols_two(spark, sf):
    o = R.ols_columns(_scaled(spark, sf), "a", ["b", "c"])
    return spark.createDataFrame([tuple(float(x) for x in (*o["bhat"], o["rsqr"]))], "b1 double, b2 double, intercept double, rsqr double").select(*[rounded(c).alias(c) for c in ("b1", "b2", "intercept", "rsqr")])


@query(f"""WITH m AS ({_MOMENTS}), c AS (SELECT ab / sqrt(aa * bb) AS p, ac / sqrt(aa * cc) AS q, bc / sqrt(bb * cc) AS r FROM m)
SELECT round((p - q * r) / sqrt((1 - q * q) * (1 - r * r)), 6) + 0.0 AS ab, round((q - p * r) / sqrt((1 - p * p) * (1 - r * r)), 6) + 0.0 AS ac, round((r - p * q) / sqrt((1 - p * p) * (1 - q * q)), 6) + 0.0 AS bc FROM c""")
def partial_correlation(spark, sf):
    p = R.partial_correlation(_scaled(spark, sf), ["a", "b", "c"])
    return spark.createDataFrame([(float(p[0, 1]), float(p[0, 2]), float(p[1, 2]))], "ab double, ac double, bc double").select(*[rounded(c).alias(c) for c in ("ab", "ac", "bc")])


@query("WITH s AS (SELECT sum(a * b) / count(*) AS xy, sum(b * b) / count(*) AS xx FROM (SELECT l_extendedprice / 1e4 AS a, l_quantity / 1e1 AS b FROM lineitem)) SELECT round(sign(xy) * greatest(abs(xy) - 0.5, 0) / xx, 6) + 0.0 AS shooting, round(sign(xy) * greatest(abs(xy) - 0.5, 0) / xx, 6) + 0.0 AS active FROM s")
def lasso_single(spark, sf):
    rows = _scaled(spark, sf)
    n = rows.count()
    fits = [float(R.lasso(rows, "a", ["b"], 0.5 * n, active)[0]) for active in (False, True)]
    return spark.createDataFrame([tuple(fits)], "shooting double, active double").select(rounded("shooting").alias("shooting"), rounded("active").alias("active"))


_E = "SELECT vec_id AS id, CAST(t.k - 1 AS BIGINT) AS k, round(CAST(embedding[t.k] AS DOUBLE), 6) + 0.0 AS v FROM embeddings, range(1, 65) t(k)"


def _rows(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("values"))


def _long(rows):
    return rows.select("id", F.posexplode("values").alias("k", "v")).select("id", F.col("k").cast("long").alias("k"), rounded("v").alias("v"))


@query(_E)
def pca_reconstruction(spark, sf):
    """All components' scores times their vectors give the rows back."""
    _, v, scores = D.pca(_rows(spark, sf), 64)
    return _long(D.right_multiply(scores, v.T))


@query(_E)
def randomized_svd_reconstruction(spark, sf):
    rows = _rows(spark, sf)
    _, v = D.randomized_svd(rows, 64, 64)
    return _long(D.right_multiply(D.right_multiply(rows, v), v.T))


@query("WITH r AS (SELECT min(l_quantity) al, (max(l_quantity) - min(l_quantity)) / 27 aw, min(l_extendedprice) bl, (max(l_extendedprice) - min(l_extendedprice)) / 27 bw FROM lineitem), u AS (SELECT (l_quantity - al) / aw + 2 AS a, (l_extendedprice - bl) / bw + 2 AS b FROM lineitem, r), "
"s AS (SELECT floor(a) + i.i AS i, floor(b) + j.i AS j, abs(floor(a) + i.i - a) AS p, abs(floor(b) + j.i - b) AS q FROM u, range(-2, 3) i(i), range(-2, 3) j(i)), "
"w AS (SELECT i, j, (CASE WHEN p < 1 THEN 2e0 / 3 - p * p + p * p * p / 2 WHEN p < 2 THEN (2 - p) * (2 - p) * (2 - p) / 6 ELSE 0 END) * (CASE WHEN q < 1 THEN 2e0 / 3 - q * q + q * q * q / 2 WHEN q < 2 THEN (2 - q) * (2 - q) * (2 - q) / 6 ELSE 0 END) AS w FROM s WHERE i BETWEEN 0 AND 31 AND j BETWEEN 0 AND 31), "
"jj AS (SELECT i, j, sum(w) AS w FROM w WHERE w > 0 GROUP BY i, j), t AS (SELECT sum(w) AS t FROM jj), ha AS (SELECT -sum(w / t * ln(w / t)) AS h FROM (SELECT i, sum(w) AS w FROM jj GROUP BY i), t), hb AS (SELECT -sum(w / t * ln(w / t)) AS h FROM (SELECT j, sum(w) AS w FROM jj GROUP BY j), t), hj AS (SELECT -sum(w / t * ln(w / t)) AS h FROM jj, t) "
"SELECT round(ha.h + hb.h - hj.h, 6) AS mi, round(2 * hj.h - ha.h - hb.h, 6) AS vi, round((ha.h + hb.h) / hj.h, 6) AS nmi, round((ha.h + hb.h - hj.h) / (ha.h + hb.h), 6) AS redundancy, round(1 - (ha.h + hb.h - hj.h) / hj.h, 6) AS nmi_metric, round((ha.h + hb.h - hj.h) / hj.h, 6) AS dual_correlation FROM ha, hb, hj")
def parzen_information(spark, sf):
    return A.information(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").select(*[rounded(c).alias(c) for c in A.METRICS])


@query("""WITH p AS (SELECT user_id, event_id, value AS x, event_id % 7 AS y, event_id % 5 AS z, lag(value) OVER w AS px, lag(event_id % 7) OVER w AS py, lag(event_id % 5) OVER w AS pz FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
d AS (SELECT user_id, sqrt((x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz)) AS d, (x + px) / 2 AS m FROM p)
SELECT user_id AS track_id, round(coalesce(sum(d), 0), 4) AS length, round(sum(d * m) / sum(d), 4) AS mean FROM d GROUP BY user_id""")
def polyline_means(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("track_id"), F.col("event_id").alias("pt_idx"), F.col("value").alias("x"), (F.col("event_id") % 7).alias("y"), (F.col("event_id") % 5).alias("z"), F.col("value").alias("s"))
    return A.polyline_means(rows, "s").select("track_id", rounded("length", 4).alias("length"), rounded("mean", 4).alias("mean"))


@query("SELECT label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, label) AS rank FROM embeddings GROUP BY label")
def label_rank(spark, sf):
    sizes = table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    ranked = D.rank_components(sizes.withColumn("score", F.col("n") * 1_000_000 - F.col("label")), "score")
    return ranked.select("label", "n", F.col("rank").cast("long").alias("rank"))


# ---- series ------------------------------------------------------------------------

_SERIES = """b AS (SELECT user_id AS x, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS t, value FROM events), r AS (SELECT min(t) AS lo, max(t) AS hi FROM b), m AS (SELECT x, t, avg(value) AS v FROM b GROUP BY x, t),
s AS (SELECT u.x, g.i AS t, coalesce(m.v, 0) AS v FROM (SELECT DISTINCT x FROM b) u CROSS JOIN r JOIN range(0, 20000) g(i) ON g.i <= hi - lo LEFT JOIN m ON m.x = u.x AND m.t = lo + g.i)"""


@query(f"""WITH {_SERIES}, n AS (SELECT CAST(pow(2, ceil(log2(hi - lo + 1))) AS BIGINT) AS n FROM r), h AS (SELECT d.i AS d, sum((1 / (1 + pow(abs(k.i) / n / 0.2, 4)) - 1 / (1 + pow(abs(k.i) / n / 0.02, 4))) * cos(2 * pi() * k.i * d.i / n)) / any_value(n) AS h FROM n JOIN range(0, 20000) d(i) ON d.i < n JOIN range(-20000, 20000) k(i) ON k.i >= -n / 2 AND k.i < n / 2 GROUP BY d.i)
SELECT CAST(a.x AS BIGINT) AS x, CAST(a.t AS BIGINT) AS t, round(sum(b.v * h), 6) + 0.0 AS v FROM s a JOIN s b USING (x) CROSS JOIN n JOIN h ON h.d = ((a.t - b.t) % n + n) % n GROUP BY a.x, a.t""")
def band_passed_series(spark, sf):
    from .queries import series_band_pass

    return series_band_pass(spark, sf).select("x", F.col("t").cast("long").alias("t"), F.col("v"))


_DET = "(({0}) * (({4}) * ({8}) - ({5}) * ({7})) - ({1}) * (({3}) * ({8}) - ({5}) * ({6})) + ({2}) * (({3}) * ({7}) - ({4}) * ({6})))"


@query(f"""WITH {_SERIES}, d AS (SELECT x, t, v, sin(pi() / 2 * (lo % 4 + t)) AS a, cos(pi() / 2 * (lo % 4 + t)) AS b FROM s, r),
q AS (SELECT x, sum(a * a) aa, sum(a * b) ab, sum(a) a1, sum(b * b) bb, sum(b) b1, count(*) n, sum(a * v) av, sum(b * v) bv, sum(v) v1 FROM d GROUP BY x),
f AS (SELECT x, {_DET.format('av', 'ab', 'a1', 'bv', 'bb', 'b1', 'v1', 'b1', 'n')} / {_DET.format('aa', 'ab', 'a1', 'ab', 'bb', 'b1', 'a1', 'b1', 'n')} AS b0, {_DET.format('aa', 'av', 'a1', 'ab', 'bv', 'b1', 'a1', 'v1', 'n')} / {_DET.format('aa', 'ab', 'a1', 'ab', 'bb', 'b1', 'a1', 'b1', 'n')} AS b1, {_DET.format('aa', 'ab', 'av', 'ab', 'bb', 'bv', 'a1', 'b1', 'v1')} / {_DET.format('aa', 'ab', 'a1', 'ab', 'bb', 'b1', 'a1', 'b1', 'n')} AS b2 FROM q)
SELECT x, round(any_value(b0), 9) + 0.0 AS b0, round(any_value(f.b1), 9) + 0.0 AS b1, round(any_value(b2), 9) + 0.0 AS b2, round(1 - sum((v - b0 * a - f.b1 * b - b2) * (v - b0 * a - f.b1 * b - b2)) / (var_pop(v) * count(*)), 6) + 0.0 AS rsqr FROM d JOIN f USING (x) GROUP BY x""")
def fitted_series(spark, sf):
    from .queries import series_glm

    return series_glm(spark, sf)


# ---- graphs ------------------------------------------------------------------------

_COXETER = "half AS (SELECT k.i AS src, 7 * s.i + k.i AS dst FROM range(7) k(i), range(1, 4) s(i) UNION ALL SELECT 7 * s.i + k.i, 7 * s.i + (k.i + s.i) % 7 FROM range(7) k(i), range(1, 4) s(i)), e AS (SELECT src, dst FROM half UNION ALL SELECT dst, src FROM half)"


@query(f"WITH {_COXETER} SELECT src AS id, count(*) AS out_degree, count(*) AS in_degree, 2 * count(*) AS degree FROM e GROUP BY src")
def coxeter_degrees(spark, sf):
    return G.degrees(G.coxeter(spark)).select("id", "out_degree", "in_degree", "degree")


@query(f"WITH RECURSIVE {_COXETER}, r AS (SELECT src, dst, 1 AS d FROM e UNION SELECT r.src, e.dst, r.d + 1 FROM r JOIN e ON r.dst = e.src WHERE r.d < 5) SELECT src, dst, CAST(min(d) AS DOUBLE) AS dist FROM r WHERE src <> dst GROUP BY src, dst")
def coxeter_paths(spark, sf):
    return G.shortest_paths(G.coxeter(spark)).select("src", "dst", "dist")


@query(f"WITH {_COXETER} SELECT count(*) AS degree, CAST(count(*) AS DOUBLE) AS strength, 1.0::DOUBLE AS assortativity FROM e")
def coxeter_totals(spark, sf):
    """A regular graph: its assortativity is 0 / 0, which counts as 1."""
    edges = G.coxeter(spark)
    return G.total(edges).join(F.broadcast(G.assortativity(edges)))


_PARTS = "e AS (SELECT src, dst, round(sum(w), 2) AS w FROM (SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, l_quantity AS w FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey) GROUP BY src, dst)"


@query(f"""WITH {_PARTS}, h AS (SELECT * FROM e WHERE src <> dst), o AS (SELECT src AS id, CAST(count(*) AS DOUBLE) AS o FROM h WHERE w > (SELECT avg(w) FROM e) OR src % 3 = 0 GROUP BY src), g AS (SELECT * FROM h WHERE w > (SELECT avg(w) FROM e) OR src % 3 = 0),
i AS (SELECT dst AS id, CAST(count(*) AS DOUBLE) AS i FROM g GROUP BY dst), m AS (SELECT avg(a.o * b.i) AS num1, pow(avg(a.o + b.i) / 2, 2) AS num2, avg(a.o * a.o + coalesce(c.i, 0) * coalesce(c.i, 0)) / 2 AS den1 FROM g JOIN o a ON a.id = src JOIN i b ON b.id = dst LEFT JOIN i c ON c.id = src)
SELECT round(abs((num1 - num2) / (den1 - num2)), 6) AS assortativity FROM m""")
def assortativity_degree(spark, sf):
    """Of the trade graph between different nations: all links of one nation in three, of the others those above the mean weight (a whole graph has equal degrees)."""
    from .queries import trade_edges

    edges = trade_edges(spark, sf).select("src", "dst", F.round("w", 2).alias("w"))
    low = edges.join(F.broadcast(edges.agg(F.avg("w").alias("m")))).filter("src <> dst and (w > m or src % 3 = 0)").drop("m")
    return G.assortativity(low).select(rounded("assortativity").alias("assortativity"))


@query(f"WITH {_PARTS} SELECT sum(CASE WHEN w <> 0 THEN 1 ELSE 0 END)::BIGINT AS degree, round(sum(w), 2) AS strength FROM e")
def graph_total(spark, sf):
    from .queries import trade_edges

    return G.total(trade_edges(spark, sf)).select("degree", F.round("strength", 2).alias("strength"))


@query(f"WITH {_PARTS} SELECT src, dst, w FROM e WHERE src % 3 = 0 AND dst % 3 = 0")
def filtered_matrix(spark, sf):
    from .queries import trade_edges

    keep = table(spark, sf, "nation").filter("n_nationkey % 3 = 0").select(F.col("n_nationkey").cast("long").alias("id"))
    return G.filter_matrix(trade_edges(spark, sf), keep).select("src", "dst", F.round("w", 2).alias("w"))
