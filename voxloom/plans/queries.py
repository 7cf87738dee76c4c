"""Driver-contract queries over the tables, each with its SQL where SQL can say it.

Doubles are rounded on both sides, so that the order of summation doesn't show.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.expression import evaluate
from ..functions.text import parse_line, to_number
from ..operators import aggregate as A
from ..operators import cluster as C
from ..operators import decomposition as D
from ..operators import graph as G
from ..operators import neighborhood as N
from ..operators import regression as R
from ..operators import spatial as S
from ..session import settled
from .registry import ORACLES, QUERIES, query
from .registry import rounded as _r
from .registry import table as _t

# ---- aggregations ------------------------------------------------------------------

_BINS = 16


@query(f"""
WITH r AS (SELECT min(l_quantity) alo, (max(l_quantity) - min(l_quantity)) / {_BINS - 1} aw, min(l_extendedprice) blo, (max(l_extendedprice) - min(l_extendedprice)) / {_BINS - 1} bw FROM lineitem),
b AS (SELECT floor((l_quantity - alo) / aw) i, floor((l_extendedprice - blo) / bw) j FROM lineitem, r),
jj AS (SELECT i, j, count(*) n FROM b GROUP BY i, j), pa AS (SELECT i, sum(n) n FROM jj GROUP BY i), pb AS (SELECT j, sum(n) n FROM jj GROUP BY j), t AS (SELECT sum(n) n FROM jj)
SELECT round(sum(jj.n / t.n * ln(jj.n * t.n / (pa.n * pb.n))), 6) AS mi FROM jj JOIN pa USING (i) JOIN pb USING (j), t""")
def mutual_information(spark, sf):
    return A.mutual_information(_t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", _BINS).select(_r("mi").alias("mi"))


@query("SELECT l_returnflag, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY l_returnflag")
def pearson_by_group(spark, sf):
    return A.pearson(_t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]).withColumn("r", _r("r"))


@query("SELECT l_linestatus, count(l_extendedprice) AS n, round(var_samp(l_extendedprice), 2) AS variance FROM lineitem GROUP BY l_linestatus")
def sample_variance(spark, sf):
    return A.sample_variance(_t(spark, sf, "lineitem"), "l_extendedprice", ["l_linestatus"]).withColumn("variance", _r("variance", 2))


@query("""SELECT user_id, count(value) AS n, round(sum(value), 4) AS sum, round(avg(value), 6) AS avg, round(var_samp(value), 4) AS var, min(value) AS min, max(value) AS max,
list_sort(list(value))[count(value) // 2 + 1] AS median FROM events GROUP BY user_id""")
def temporal_reduce(spark, sf):
    return A.temporal_reduce(_t(spark, sf, "events"), ["user_id"], "value").withColumns({"sum": _r("sum", 4), "avg": _r("avg"), "var": _r("var", 4)})


_PAIR_SQL = "SELECT {what} FROM (SELECT o_totalprice AS a, s AS b FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) s FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey)"


def _order_pairs(spark, sf):
    lines = _t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_extendedprice").alias("v"))
    return A.paired(_t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v")), lines, ["id"])


@query(_PAIR_SQL.format(what="count(*) AS n, round(avg((a - b) * (a - b)) / 1e6, 4) AS mse"))
def mse_pairs(spark, sf):
    return A.compare(_order_pairs(spark, sf)).select("n", _r(F.col("mse") / 1e6, 4).alias("mse"))


@query(_PAIR_SQL.format(what="count(*) AS n, round(corr(a, b), 6) AS corr"))
def corr_pairs(spark, sf):
    return A.compare(_order_pairs(spark, sf)).select("n", _r("corr").alias("corr"))


@query("""SELECT count(*) AS n, round(avg(CAST(quality = toxic AS INT)), 6) AS agreement,
round(2.0 * sum(CASE WHEN quality <> 0 AND quality = toxic THEN 1 ELSE 0 END) / (sum(CASE WHEN quality <> 0 THEN 1 ELSE 0 END) + sum(CASE WHEN toxic <> 0 THEN 1 ELSE 0 END)), 6) AS overlap
FROM documents JOIN labels USING (doc_id)""")
def label_agreement(spark, sf):
    both = _t(spark, sf, "documents").select("doc_id").join(_t(spark, sf, "labels"), "doc_id").select(F.col("quality").alias("a"), F.col("toxic").alias("b"))
    return A.compare(both).select("n", _r("agreement").alias("agreement"), _r("overlap").alias("overlap"))


_HIST = "WITH r AS (SELECT min({v}) lo, (max({v}) - min({v})) / ({k} - 1) w FROM {t}), h AS (SELECT CAST(floor(({v} - lo) / w) AS BIGINT) bin, lo, w, count(*) n FROM {t}, r GROUP BY 1, 2, 3)"
_ROOT = "floor(sqrt((SELECT count(*) FROM part)))"


@query(
    _HIST.format(v="p_retailprice", t="part", k=_ROOT)
    + """, c AS (SELECT *, sum(n) OVER (ORDER BY bin) n0, sum(n) OVER () nn, sum(n * bin) OVER (ORDER BY bin) s0, sum(n * bin) OVER () ss FROM h),
b AS (SELECT *, CAST(n0 AS DOUBLE) * (nn - n0) * (s0 / n0 - (ss - s0) / (nn - n0)) * (s0 / n0 - (ss - s0) / (nn - n0)) AS bt FROM c WHERE nn > n0)
SELECT round(lo + (bin + 1) * w, 6) AS threshold FROM b ORDER BY bt DESC, bin LIMIT 1"""
)
def otsu_threshold(spark, sf):
    return A.otsu_threshold(_t(spark, sf, "part"), "p_retailprice").select(_r("threshold").alias("threshold"))


@query(
    _HIST.format(v="p_retailprice", t="part", k=_ROOT)
    + """, c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b0, sum(n) OVER () nn FROM h)
SELECT p_partkey, round((b0 + n * ((p_retailprice - (lo + bin * w)) / w)) / nn, 6) AS equalized FROM part JOIN c ON CAST(floor((p_retailprice - lo) / w) AS BIGINT) = bin"""
)
def hist_equalize(spark, sf):
    return A.hist_equalize(_t(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice").select("p_partkey", _r("equalized").alias("equalized"))


@query(_HIST.format(v="o_totalprice", t="orders", k=64) + " SELECT round(lo + (bin + 0.5) * w, 4) AS mode, n FROM h ORDER BY n DESC, bin LIMIT 1")
def hist_mode(spark, sf):
    return A.histogram_mode(_t(spark, sf, "orders"), "o_totalprice", 64).select(_r("mode", 4).alias("mode"), "n")


@query("SELECT DISTINCT CAST(label AS BIGINT) AS label FROM embeddings")
def distinct_labels(spark, sf):
    return A.distinct_labels(_t(spark, sf, "embeddings"), "label")


@query("SELECT round(sum(l_extendedprice * l_quantity) / sum(l_extendedprice), 6) AS center_l_quantity, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice), 8) AS center_l_discount FROM lineitem")
def center_of_mass(spark, sf):
    return A.center_of_mass(_t(spark, sf, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice").select(_r("center_l_quantity").alias("center_l_quantity"), _r("center_l_discount", 8).alias("center_l_discount"))


@query("SELECT l_returnflag, round(sum(abs(l_discount - 0.05)), 4) AS v FROM lineitem GROUP BY l_returnflag")
def collapse_sum(spark, sf):
    return A.collapse_sum(_t(spark, sf, "lineitem").select("l_returnflag", (F.col("l_discount") - 0.05).alias("v")), ["l_returnflag"], absolute=True).withColumn("v", _r("v", 4))


@query("SELECT quality, lang, count(*) AS n, round(avg(n_chars), 4) AS mean FROM documents JOIN labels USING (doc_id) GROUP BY quality, lang")
def label_average(spark, sf):
    return A.label_average(_t(spark, sf, "documents"), _t(spark, sf, "labels"), ["doc_id"], "n_chars", "quality", ["lang"]).withColumn("mean", _r("mean", 4))


# ---- predicates and expressions ----------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 25 THEN 0 ELSE 1 END AS v FROM lineitem")
def binarize(spark, sf):
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") < 25, 0).otherwise(1).alias("v"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 25 THEN 0.0 ELSE l_quantity END::DOUBLE AS v FROM lineitem")
def threshold(spark, sf):
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") < 25, 0.0).otherwise(F.col("l_quantity")).alias("v"))


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) + (CASE WHEN l_quantity > 30 AND l_tax >= 0.02 THEN 1 ELSE 0 END) * exp(-l_quantity / 10) - floor(l_quantity / 7), 6) AS v FROM lineitem""")
def expr_eval(spark, sf):
    rows = _t(spark, sf, "lineitem")
    from ..functions.expression import compile_expression

    names = {"a": F.col("l_extendedprice"), "b": F.col("l_discount"), "c": F.col("l_quantity"), "d": F.col("l_tax")}
    v = compile_expression("a * (1 - b) + (c > 30 and d >= 0.02) * exp(-c / 10) - floor(c / 7)", names)
    return rows.select("l_orderkey", "l_linenumber", _r(v).alias("v"))


@query("SELECT o_orderkey AS id, round(o_totalprice - 2 * s, 4) AS v FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def expr_join(spark, sf):
    lines = _t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_extendedprice").alias("v"))
    orders = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    return evaluate({"a": orders, "b": lines}, "a - 2 * b", ("id",)).withColumn("v", _r("v", 4))


@query(
    r"""WITH f AS (SELECT event_id, list_filter(list_transform(string_split_regex(props, '[,: ]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM events)
SELECT event_id, CAST(len(p) AS INT) AS n_fields, p[1] AS first_field, coalesce(TRY_CAST(regexp_extract(p[len(p)], '^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)', 1) AS DOUBLE), 0) AS last_number FROM f"""
)
def csv_sniff_parse(spark, sf):
    rows = _t(spark, sf, "events").select("event_id", parse_line(F.col("props"), ",: ").alias("p"))
    return rows.select("event_id", F.size("p").alias("n_fields"), F.get("p", F.lit(0)).alias("first_field"), to_number(F.get("p", F.size("p") - 1)).alias("last_number"))


@query("""WITH t AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS k FROM (SELECT DISTINCT event_type FROM events WHERE regexp_full_match(event_type, '[a-p].*')))
SELECT event_id, k AS t FROM events JOIN t USING (event_type)""")
def select_volumes(spark, sf):
    events = _t(spark, sf, "events").select("event_id", F.col("event_type").alias("t"))
    names = events.select("t").distinct().withColumn("name", F.col("t"))
    return S.select_volumes(events, names, "[a-p].*").withColumn("t", F.col("t").cast("long"))


_KERNEL_SQL = "abs(l_quantity - 25) / 10"


@query(f"""SELECT l_orderkey, l_linenumber,
round(CASE WHEN u < 1 THEN 2.0 / 3 - u * u + u * u * u / 2 WHEN u < 2 THEN (2 - u) * (2 - u) * (2 - u) / 6 ELSE 0 END, 9) AS b3,
round(CASE WHEN u = 0 THEN 1 WHEN u < 2 THEN 2 * sin(pi() * u) * sin(pi() * u / 2) / (pi() * pi() * u * u) ELSE 0 END, 9) AS lanczos,
round(CASE WHEN u < 2 THEN 0.5 + 0.5 * cos(pi() * u / 2) ELSE 0 END, 9) AS hann,
round(CASE WHEN u < 2 THEN 0.54 + 0.46 * cos(pi() * u / 2) ELSE 0 END, 9) AS hamming,
round(CASE WHEN u < 2 THEN 1 - u * u / 4 ELSE 0 END, 9) AS welch,
round(exp(-u * u / 2) / sqrt(2 * pi()), 9) AS gauss,
round(1 / (1 + pow(u / 1.5, 4)), 9) AS low_pass
FROM (SELECT l_orderkey, l_linenumber, {_KERNEL_SQL} AS u FROM lineitem)""")
def scalar_kernels(spark, sf):
    u = F.abs(F.col("l_quantity") - 25) / 10
    named = {"b3": K.b3(u), "lanczos": K.lanczos(u, 2.0), "hann": K.hann_window(u, 2.0), "hamming": K.hamming_window(u, 2.0), "welch": K.welch_window(u, 2.0), "gauss": K.gaussian_pdf(0, 1, u), "low_pass": K.low_pass(u, 1.5)}
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[_r(c, 9).alias(n) for n, c in named.items()])


# ---- windows -----------------------------------------------------------------------


def _events(spark, sf):
    return _t(spark, sf, "events").select("event_id", "user_id", "ts", "value", "event_type")


_ORDER = ["ts", "event_id"]
_OVER = "PARTITION BY user_id ORDER BY ts, event_id"


@query("SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_samp(value) FROM events), 6) AS z FROM events")
def standardize(spark, sf):
    return N.standardize(_events(spark, sf), "value").select("event_id", _r("z").alias("z"))


@query("SELECT event_id, round(coalesce((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 0), 6) AS z FROM events WINDOW w AS (PARTITION BY user_id)")
def normalize_ts(spark, sf):
    return N.normalize_series(_events(spark, sf), "value", ["user_id"]).select("event_id", _r("z").alias("z"))


@query(f"""SELECT event_id, round(CASE WHEN nx = 0 OR abs(dy) < 1e-11 THEN 0 ELSE dy / nx END, 6) AS derivative FROM (
SELECT event_id, coalesce(lead(value) OVER w, value) - coalesce(lag(value) OVER w, value) AS dy, CAST(lead(value) OVER w IS NOT NULL AS INT) + CAST(lag(value) OVER w IS NOT NULL AS INT) AS nx FROM events WINDOW w AS ({_OVER}))""")
def central_derivative(spark, sf):
    return N.derivative(_events(spark, sf), "value", _ORDER, ["user_id"]).select("event_id", _r("derivative").alias("derivative"))


_G = N.gaussian_weights(1.5, 4)


@query(
    "SELECT event_id, round("
    + " + ".join(f"coalesce({'value' if k == 0 else f'lead(value, {k}) OVER w' if k > 0 else f'lag(value, {-k}) OVER w'}, 0) * {w!r}" for k, w in zip(range(-4, 5), _G, strict=True))
    + f", 6) AS smooth FROM events WINDOW w AS ({_OVER})"
)
def gaussian_smooth_1d(spark, sf):
    return N.gaussian_smooth(_events(spark, sf), "value", _ORDER, 1.5, ["user_id"]).select("event_id", _r("smooth").alias("smooth"))


@query(f"SELECT event_id, list_sort([coalesce(lag(value) OVER w, value), value, coalesce(lead(value) OVER w, value)])[2] AS median FROM events WINDOW w AS ({_OVER})")
def median_filter_1d(spark, sf):
    return N.median_filter(_events(spark, sf), "value", _ORDER, ["user_id"]).select("event_id", "median")


@query(f"""SELECT event_id, CASE WHEN min(m) OVER w = 1 THEN m ELSE 0 END AS eroded, max(m) OVER w AS dilated FROM (SELECT *, CASE WHEN value > 50 THEN 1 ELSE 0 END AS m FROM events)
WINDOW w AS ({_OVER} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def erode_dilate_1d(spark, sf):
    rows = _events(spark, sf).withColumn("m", F.when(F.col("value") > 50, 1).otherwise(0))
    return N.dilate_1d(N.erode_1d(rows, "m", _ORDER, ["user_id"]), "m", _ORDER, ["user_id"]).select("event_id", "eroded", "dilated")


@query(f"""SELECT event_id, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run FROM (SELECT *, CASE WHEN lag(m) OVER w = m THEN 0 ELSE 1 END AS c FROM (SELECT *, value > 50 AS m FROM events) WINDOW w AS ({_OVER}))""")
def connected_runs(spark, sf):
    return N.connected_runs(_events(spark, sf).withColumn("m", F.col("value") > 50), "m", _ORDER, ["user_id"]).select("event_id", "run")


@query(f"""WITH m AS (SELECT user_id, value > 20 AS m, row_number() OVER ({_OVER}) i, row_number() OVER ({_OVER}) - row_number() OVER (PARTITION BY user_id, value > 20 ORDER BY ts, event_id) g FROM events),
r AS (SELECT user_id, g, count(*) AS length, min(i) AS start FROM m WHERE m GROUP BY user_id, g)
SELECT user_id, max(length) AS length, arg_min(start, -length * 1000000 + start) AS start FROM r GROUP BY user_id""")
def longest_masked_run(spark, sf):
    return N.longest_run(_events(spark, sf).withColumn("m", F.col("value") > 20), "m", _ORDER, ["user_id"]).withColumn("start", F.col("start").cast("long"))


# ---- joins -------------------------------------------------------------------------


def _points(spark, sf, dims: int | None = None):
    p = F.col("embedding").cast("array<double>")
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (F.slice(p, 1, dims) if dims else p).alias("p"), "label")


_D2 = "list_sum(list_transform(list_zip(a.p, b.p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_P = "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS p, label FROM embeddings"


@query(f"WITH p AS ({_P}), d AS (SELECT a.id, b.id AS nearest_id, {_D2} AS d2 FROM p a JOIN p b ON a.id <> b.id) SELECT id, arg_min(nearest_id, {{'d': d2, 'i': nearest_id}}) AS nearest_id, round(min(d2), 6) AS dist2 FROM d GROUP BY id")
def nearest_neighbor(spark, sf):
    p = _points(spark, sf)
    return S.nearest(p, p, others_only=True, leaf_points=_LEAF).withColumn("dist2", _r("dist2"))


#: Points of a leaf: small ones, so that the small tables too make a tree.
_LEAF = 256
#: A radius for unit vectors of 64 coordinates: random ones are 1.41 apart, the nearest of 2,000 about 0.9.
_NEAR = 1.1


@query(f"WITH p AS ({_P}) SELECT a.id AS left_id, b.id AS right_id, round({_D2}, 6) AS dist2 FROM p a JOIN p b ON a.id < b.id WHERE {_D2} < {_NEAR} * {_NEAR}")
def within_distance(spark, sf):
    """All pairs nearer than the radius, over all coordinates."""
    return S.within_blocked(_points(spark, sf), _NEAR, rows=_LEAF).withColumn("dist2", _r("dist2"))


#: The same query under its name of round 1.
QUERIES["within_distance_64"], ORACLES["within_distance_64"] = within_distance, ORACLES["within_distance"]


@query("""WITH s AS (SELECT epoch(ts) AS onset, 600.0 AS d, value, event_id FROM events WHERE event_type = 'purchase'),
g AS (SELECT 1800.0 * unnest(range(CAST(floor(epoch(min(ts)) / 1800) AS BIGINT), CAST(floor(epoch(max(ts)) / 1800) AS BIGINT) + 1)) AS t FROM events)
SELECT CAST(t AS DOUBLE) AS t, coalesce((SELECT arg_max(value, event_id) FROM s WHERE t >= onset AND t <= onset + d), 0) AS painted FROM g""")
def event_paint(spark, sf):
    """Half hours of the table's own span, painted by the purchases that last ten minutes."""
    events = _t(spark, sf, "events").select(F.col("ts").cast("timestamp").cast("double").alias("onset"), "event_type", "value", F.col("event_id").alias("row"))
    spec = events.filter("event_type = 'purchase'").select("onset", F.lit(600.0).alias("duration"), "value", "row")
    ends = events.agg(F.floor(F.min("onset") / 1800).alias("low"), F.floor(F.max("onset") / 1800).alias("high")).filter("low is not null")  # one row
    times = ends.select(F.explode(F.sequence("low", "high")).alias("t")).repartition("t").select((F.col("t").cast("double") * 1800).alias("t"))
    return S.paint_events(times, spec, bucket=1800.0)


@query("SELECT id, line, 'a' AS part, v FROM (SELECT o_orderkey AS id, 0 AS line, o_totalprice AS v FROM orders) UNION ALL SELECT id + 1000000, line, 'b', v FROM (SELECT l_orderkey AS id, l_linenumber AS line, l_extendedprice AS v FROM lineitem)")
def concat(spark, sf):
    """Orders and, behind them, every line of an order, told apart by line."""
    a = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit(0).alias("line"), F.lit("a").alias("part"), F.col("o_totalprice").alias("v"))
    b = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.lit("b").alias("part"), F.col("l_extendedprice").alias("v"))
    return S.concat([a, b], "id", [1_000_000, 0])


#: The same query under its name of round 1.
QUERIES["concat_lines"], ORACLES["concat_lines"] = concat, ORACLES["concat"]


@query("SELECT o_custkey AS x FROM orders WHERE o_totalprice > 200000 INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def mask_intersect(spark, sf):
    a = _t(spark, sf, "orders").select(F.col("o_custkey").alias("x"), (F.col("o_totalprice") > 200000).cast("int").alias("v"))
    b = _t(spark, sf, "customer").select(F.col("c_custkey").alias("x"), (F.col("c_acctbal") > 0).cast("int").alias("v"))
    return S.mask_intersect(a, b, ["x"])


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS g, l_linenumber + 10 * CAST(l_returnflag = 'R' AS INT) AS l FROM lineitem)
SELECT a.l AS l1, b.l AS l2, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.l <= b.l GROUP BY 1, 2""")
def edge_label_pairs(spark, sf):
    rows = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("g"), (F.col("l_linenumber") + 10 * (F.col("l_returnflag") == "R").cast("int")).alias("l"))
    return S.self_pairs(rows, "g", "l")


# ---- clustering --------------------------------------------------------------------

_CENTERS = np.array([[math.cos(k + j) * 0.1 for j in range(64)] for k in range(5)])
_CSQL = "(VALUES " + ", ".join(f"({k}, CAST({[float(x) for x in c]} AS DOUBLE[]))" for k, c in enumerate(_CENTERS)) + ") AS b(k, p)"


@query(f"WITH a AS ({_P}), d AS (SELECT a.id, b.k, {_D2} AS d2 FROM a, {_CSQL}) SELECT id, arg_min(k, {{'d': d2, 'k': k}}) AS cluster, round(min(d2), 6) AS dist2 FROM d GROUP BY id")
def kmeans_assign(spark, sf):
    return C.assign(_points(spark, sf), _CENTERS).select("id", "cluster", _r("dist2").alias("dist2"))


@query(f"""WITH a AS ({_P}), d AS (SELECT a.id, b.k, {_D2} AS d2 FROM a, {_CSQL}), m AS (SELECT id, arg_min(k, {{'d': d2, 'k': k}}) AS cluster FROM d GROUP BY id)
SELECT cluster, count(*) AS n, {", ".join(f"round(avg(p[{k + 1}]), 6) AS c{k}" for k in range(64))} FROM m JOIN a USING (id) GROUP BY cluster""")
def kmeans_update(spark, sf):
    u = C.update_centers(C.assign(_points(spark, sf), _CENTERS), 64)
    return u.select("cluster", "n", *[_r(F.get("center", F.lit(k))).alias(f"c{k}") for k in range(64)])


@query(f"""WITH p AS ({_P}), r AS (SELECT a.id, count(b.id) AS rho, any_value(a.p) AS p FROM p a LEFT JOIN p b ON a.id <> b.id AND {_D2} < {_NEAR} * {_NEAR} GROUP BY a.id),
d AS (SELECT a.id, b.id AS o, {_D2} AS d2 FROM r a JOIN r b ON b.rho > a.rho OR (b.rho = a.rho AND b.id > a.id))
SELECT r.id, r.rho, round(min(d2), 6) AS delta FROM r LEFT JOIN d USING (id) GROUP BY r.id, r.rho""")
def density_rho_delta(spark, sf):
    return C.density_peaks(_points(spark, sf), _NEAR, leaf_points=_LEAF).select("id", "rho", _r("delta").alias("delta"))


# ---- regression and matrices -------------------------------------------------------


@query("""SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS rsqr,
round(sqrt(regr_r2(l_extendedprice, l_quantity) * (count(*) - 2) / (1 - regr_r2(l_extendedprice, l_quantity))), 3) AS t FROM lineitem""")
def ols_single(spark, sf):
    o = R.ols_columns(_t(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"])
    return spark.createDataFrame([tuple(float(x) for x in (o["bhat"][0], o["bhat"][1], o["rsqr"], o["t"][0]))], "slope double, intercept double, rsqr double, t double").select(_r("slope").alias("slope"), _r("intercept", 4).alias("intercept"), _r("rsqr").alias("rsqr"), _r(F.abs("t"), 3).alias("t"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS rsqr FROM lineitem GROUP BY 1, 2")
def ols_by_group(spark, sf):
    o = R.ols_by_group(_t(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag", "l_linestatus"])
    return o.select("l_returnflag", "l_linestatus", "n", _r("slope").alias("slope"), _r("intercept", 4).alias("intercept"), _r("rsqr", 8).alias("rsqr"))


@query("""WITH f AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) b, regr_intercept(l_extendedprice, l_quantity) a FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, round(l_extendedprice - (a + b * l_quantity), 4) AS residual FROM lineitem JOIN f USING (l_returnflag)""")
def residualize(spark, sf):
    return R.residualize(_t(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"]).select("l_orderkey", "l_linenumber", _r("residual", 4).alias("residual"))


def _matrix(spark, m: np.ndarray) -> DataFrame:
    m = np.round(m, 6)  # keeps the sign of what becomes zero, as SQL does
    return spark.createDataFrame([(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], "i int, j int, value double")


@query(f"WITH p AS ({_P}), e AS (SELECT id, unnest(p) AS x, generate_subscripts(p, 1) - 1 AS i FROM p) SELECT CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, round(covar_samp(a.x, b.x), 6) AS value FROM e a JOIN e b USING (id) GROUP BY 1, 2")
def cov_matrix(spark, sf):
    return _matrix(spark, D.covariance(_points(spark, sf), "p", 64))


@query(f"WITH p AS ({_P}), e AS (SELECT id, unnest(p) AS x, generate_subscripts(p, 1) - 1 AS i FROM p) SELECT CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, round(sum(a.x * b.x), 6) AS value FROM e a JOIN e b USING (id) GROUP BY 1, 2")
def gram_matrix(spark, sf):
    return _matrix(spark, D.covariance(_points(spark, sf), "p", 64, centered=False))


#: The same queries under their names of round 1.
QUERIES |= {"cov_matrix_64": cov_matrix, "gram_matrix_64": gram_matrix}
ORACLES |= {"cov_matrix_64": ORACLES["cov_matrix"], "gram_matrix_64": ORACLES["gram_matrix"]}


@query(f"""WITH p AS ({_P}), e AS (SELECT id AS i, unnest(p) AS v, generate_subscripts(p, 1) - 1 AS k FROM p), b AS (SELECT k.range AS k, j.range AS j, cos(k.range + 2 * j.range) AS v FROM range(64) k, range(4) j)
SELECT e.i, b.j, round(sum(e.v * b.v), 6) AS v FROM e JOIN b USING (k) GROUP BY 1, 2""")
def block_matmul(spark, sf):
    a = _points(spark, sf).select(F.col("id").alias("i"), F.posexplode("p").alias("j", "v"))
    b = spark.range(64 * 4).select(F.floor(F.col("id") / 4).alias("i"), (F.col("id") % 4).alias("j")).withColumn("v", F.cos(F.col("i") + 2 * F.col("j")))
    n = (a.agg(F.max("i")).first()[0] or 0) + 1
    out = D.block_entries(D.block_multiply(D.blocks(a, 16), D.blocks(b, 16), 16), n, 4, 16)
    return out.join(a.select("i").distinct(), "i", "left_semi").select("i", "j", _r("v").alias("v"))


# ---- graphs ------------------------------------------------------------------------

_EDGES = """WITH e AS (SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, sum(l_quantity) AS w FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
GROUP BY 1, 2)"""


def trade_edges(spark, sf) -> DataFrame:
    """Quantities that customers of a nation order from suppliers of another, over all of lineitem; small sides join by AQE."""
    lines = _t(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customers = _t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("src"))
    suppliers = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("dst"))
    met = lines.join(suppliers, "l_suppkey").join(orders, "l_orderkey").join(customers, "o_custkey")
    return met.groupBy("src", "dst").agg(F.sum("l_quantity").alias("w"))


@query(f"{_EDGES}, b AS (SELECT src AS id, 1 AS o FROM e WHERE w <> 0 UNION ALL SELECT dst, 0 FROM e WHERE w <> 0) SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(1 - o) AS BIGINT) AS in_degree, count(*) AS degree FROM b GROUP BY id")
def degrees(spark, sf):
    return G.degrees(trade_edges(spark, sf)).select("id", "out_degree", "in_degree", "degree")


@query(f"{_EDGES}, b AS (SELECT src AS id, w, 0.0 AS v FROM e UNION ALL SELECT dst, 0.0, w FROM e) SELECT id, round(CAST(sum(w) AS DOUBLE), 4) AS out_strength, round(CAST(sum(v) AS DOUBLE), 4) AS in_strength, round(CAST(sum(w + v) AS DOUBLE), 4) AS strength FROM b GROUP BY id")
def strengths(spark, sf):
    return G.degrees(trade_edges(spark, sf)).select("id", *[_r(c, 4).alias(c) for c in ("out_strength", "in_strength", "strength")])


@query(f"""{_EDGES}, o AS (SELECT src AS id, sum(w) AS o FROM e GROUP BY src), i AS (SELECT dst AS id, sum(w) AS i FROM e GROUP BY dst), m AS (SELECT avg(a.o * b.i) AS num1, pow(sum(a.o + b.i) / (2 * count(*)), 2) AS num2,
sum(a.o * a.o + coalesce(c.i, 0) * coalesce(c.i, 0)) / (2 * count(*)) AS den1 FROM e JOIN o a ON a.id = src JOIN i b ON b.id = dst LEFT JOIN i c ON c.id = src WHERE w <> 0) SELECT round(abs((num1 - num2) / (den1 - num2)), 6) AS assortativity FROM m""")
def assortativity(spark, sf):
    return G.assortativity(trade_edges(spark, sf), weighted=True).select(_r("assortativity").alias("assortativity"))


@query(f"{_EDGES} SELECT src, dst, round(w / (SELECT sum(w) FROM e), 9) AS w FROM e")
def edge_normalize(spark, sf):
    return G.normalize(trade_edges(spark, sf)).select("src", "dst", _r("w", 9).alias("w"))


@query(
    f"""{_EDGES.replace('WITH e', 'WITH RECURSIVE e')}, s AS (SELECT src, dst, min(abs(w)) AS d FROM e WHERE src <> dst GROUP BY 1, 2),
r AS (SELECT src, dst, d, 1 AS n FROM s UNION ALL SELECT src, dst, d, n FROM (SELECT r.src, s.dst, min(r.d + s.d) AS d, r.n + 1 AS n FROM r JOIN s ON r.dst = s.src WHERE r.src <> s.dst AND r.n < 24 GROUP BY r.src, s.dst, r.n))
SELECT src, dst, round(min(d), 4) AS dist FROM r GROUP BY 1, 2"""
)
def all_pairs_shortest(spark, sf):
    return G.shortest_paths(trade_edges(spark, sf)).select("src", "dst", _r("dist", 4).alias("dist"))


#: The same queries under their names of round 1.
for _f in (degrees, strengths, assortativity, edge_normalize, all_pairs_shortest):
    QUERIES[f"{_f.__name__}_all"], ORACLES[f"{_f.__name__}_all"] = _f, ORACLES[_f.__name__]


@query()
def betweenness(spark, sf):
    return G.betweenness(G.shortest_paths(trade_edges(spark, sf)))


# ---- without SQL -------------------------------------------------------------------


@query()
def student_t_table(spark, sf):
    return R.student_table(spark, 10)


@query()
def information_metrics(spark, sf):
    return A.information(_t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").select(*[_r(c).alias(c) for c in A.METRICS])


#: Seconds of a bin of the users' series.
_BIN = 21600


def _series(spark, sf) -> tuple[DataFrame, int, int]:
    """Six-hour means of each user's events as packed series, 0 where a bin has none; the first bin and the number of bins of the whole table."""
    bins = _t(spark, sf, "events").select(F.col("user_id").cast("long").alias("x"), F.floor(F.col("ts").cast("timestamp").cast("double") / _BIN).cast("int").alias("t"), "value").filter("x is not null and t is not null")
    lo, hi = (int(v or 0) for v in bins.agg(F.min("t"), F.max("t")).first())
    n = hi - lo + 1
    long = bins.groupBy("x", (F.col("t") - lo).alias("t")).agg(F.avg("value").alias("v"))
    cells = long.select("x").distinct().select("x", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("t"))
    full = cells.join(long, ["x", "t"], "left").select(F.lit("events").alias("img_id"), "x", F.lit(0).alias("y"), F.lit(0).alias("z"), "t", F.coalesce("v", F.lit(0.0)).alias("v"))
    from ..model import pack

    return pack(full), lo, n


@query()
def series_band_pass(spark, sf):
    from ..operators.spectral import band_pass

    return band_pass(_series(spark, sf)[0], 1.0, 0.02, 0.2).select("x", F.posexplode("ts").alias("t", "v")).withColumn("v", _r("v"))


@query()
def series_glm(spark, sf):
    series, lo, n = _series(spark, sf)
    # means of cents often end on a 5 in the seventh place, where rounding is a toss: nine places are told
    t = lo % 4 + np.arange(n)  # a day is four bins: the same hours have the same phase on any table
    x = np.column_stack([np.sin(2 * np.pi * t / 4), np.cos(2 * np.pi * t / 4), np.ones(n)])
    return R.glm(series, x, ["x"]).select("x", *[_r(F.get("bhat", F.lit(k)), 9).alias(f"b{k}") for k in range(3)], _r("rsqr").alias("rsqr"))


#: Classes and rounds of the fit; it starts from the vectors with the smallest ids.
_CLASSES, _ROUNDS = 10, 20
_CLOSEST = f"list_position(ds, list_min(ds)) FROM (SELECT r.n, r.c, p.id, p.label, p.p, list_transform(r.c, lambda m: list_sum(list_transform(list_zip(p.p, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS ds FROM {{r}} r, p)"


@query(f"""WITH RECURSIVE p AS ({_P}), r(n, c) AS (SELECT 0, list(p ORDER BY id) FROM (SELECT * FROM p ORDER BY id LIMIT {_CLASSES}) UNION ALL
SELECT n + 1, list(m ORDER BY k) FROM (SELECT n, k, list(v ORDER BY j) AS m FROM (SELECT n, k, j, avg(q[j]) AS v FROM (SELECT n, p AS q, {_CLOSEST.format(r='r').replace(' FROM (SELECT', ' AS k FROM (SELECT', 1)}), range(1, 65) t(j) GROUP BY n, k, j) GROUP BY n, k) WHERE n < {_ROUNDS} GROUP BY n),
last AS (SELECT * FROM r WHERE n = {_ROUNDS})
SELECT CAST(k - 1 AS INT) AS cluster, label, count(*) AS n FROM (SELECT label, {_CLOSEST.format(r='last').replace(' FROM (SELECT', ' AS k FROM (SELECT', 1)}) GROUP BY 1, 2""")
def kmeans_fit(spark, sf):
    points = _points(spark, sf)
    starts = np.array([r.p for r in points.orderBy("id").limit(_CLASSES).collect()])
    centers, _, _ = C.lloyd(settled(points.select("p")), starts, "p", _ROUNDS)
    return C.assign(points, centers).groupBy("cluster", "label").agg(F.count("*").alias("n"))


_STARTS = ([100_000.0, 250_000.0], [60_000.0, 80_000.0], [0.4, 0.6])


@query(f"""WITH d AS (SELECT o_totalprice AS x, {", ".join(f"{w!r} * exp(-(o_totalprice - {m!r}) * (o_totalprice - {m!r}) / (2 * {s!r} * {s!r})) / {s!r} AS p{j}" for j, (m, s, w) in enumerate(zip(*_STARTS, strict=True)))} FROM orders),
r AS (SELECT x, unnest([0, 1]) AS j, unnest([p0, p1]) / (p0 + p1) AS r FROM d)
SELECT CAST(j AS INT) AS j, round(sum(r * x) / sum(r), 3) AS mean, round(sqrt(sum(r * x * x) / sum(r) - pow(sum(r * x) / sum(r), 2)), 3) AS sd, round(sum(r) / (SELECT count(*) FROM orders), 9) AS prior FROM r GROUP BY j""")
def mixture_1d_step(spark, sf):
    """One EM step of two Gaussians from fixed starts."""
    mean, sd, prior = C.mixture_1d(_t(spark, sf, "orders"), "o_totalprice", [K.gaussian_pdf] * 2, *_STARTS, rounds=1)
    rows = spark.createDataFrame([(j, *map(float, x)) for j, x in enumerate(zip(mean, sd, prior, strict=True))], "j int, mean double, sd double, prior double")
    return rows.select("j", _r("mean", 3).alias("mean"), _r("sd", 3).alias("sd"), _r("prior", 9).alias("prior"))


_GAMMA = "exp((({m}) * ({m}) / ({s} * {s}) - 1) * ln(abs(x)) - abs(x) / ({s} * {s} / abs({m})) - lgamma(({m}) * ({m}) / ({s} * {s})) - (({m}) * ({m}) / ({s} * {s})) * ln({s} * {s} / abs({m})))"


@query(f"""WITH v AS (SELECT l_quantity - 25.5 AS x FROM lineitem),
d AS (SELECT x, CASE WHEN x < 0 THEN {_GAMMA.format(m='-9e0', s='3e0')} ELSE 0 END AS p0, exp(-x * x / 8) / (2 * sqrt(2 * pi())) AS p1, CASE WHEN x > 0 THEN {_GAMMA.format(m='9e0', s='3e0')} ELSE 0 END AS p2 FROM v),
r AS (SELECT x, unnest([0, 1, 2]) AS j, unnest([p0, p1, p2]) / (p0 + p1 + p2) AS r FROM d WHERE p0 + p1 + p2 > 0),
m AS (SELECT j, sum(r) AS n, sum(r * x) / sum(r) AS mu, sqrt(sum(r * x * x) / sum(r) - pow(sum(r * x) / sum(r), 2)) AS sd FROM r GROUP BY j)
SELECT CAST(j AS INT) AS j, round(mu, 6) AS mean, round(CASE WHEN j = 1 THEN sd ELSE least(sd, abs(mu) / sqrt(3)) END, 6) AS sd, round(n / (SELECT sum(n) FROM m), 9) AS prior FROM m""")
def gauss_gamma_step(spark, sf):
    """One EM step of a negative gamma, a Gaussian and a gamma."""
    rows = _t(spark, sf, "lineitem").select((F.col("l_quantity") - 25.5).alias("x"))
    found = C.gauss_gamma_mixture(rows, "x", rounds=1)
    out = spark.createDataFrame([(j, *map(float, x)) for j, x in enumerate(zip(*found, strict=True))], "j int, mean double, sd double, prior double")
    return out.select("j", _r("mean").alias("mean"), _r("sd").alias("sd"), _r("prior", 9).alias("prior"))


#: Means, covariances and weights from which a step over quantities and discounts (in per cent) starts.
_EM = ([[15.0, 3.0], [35.0, 7.0]], [[[120.0, 5.0], [5.0, 8.0]], [[90.0, -4.0], [-4.0, 6.0]]], [0.45, 0.55])


def _gauss_2d(j: int) -> str:
    (m0, m1), ((a, b), (_, d)), w = (x[j] for x in _EM)
    det = a * d - b * b
    return f"{w!r} / sqrt({det!r}) * exp(-0.5 * ({d!r} * (x - {m0!r}) * (x - {m0!r}) - 2 * ({b!r}) * (x - {m0!r}) * (y - {m1!r}) + {a!r} * (y - {m1!r}) * (y - {m1!r})) / {det!r})"


@query(f"""WITH v AS (SELECT l_quantity AS x, l_discount * 100 AS y FROM lineitem), d AS (SELECT x, y, {_gauss_2d(0)} AS p0, {_gauss_2d(1)} AS p1 FROM v),
r AS (SELECT x, y, unnest([0, 1]) AS j, unnest([p0, p1]) / (p0 + p1) AS r FROM d),
m AS (SELECT j, sum(r) AS n, sum(r * x) / sum(r) AS m0, sum(r * y) / sum(r) AS m1, sum(r * x * x) / sum(r) AS xx, sum(r * x * y) / sum(r) AS xy, sum(r * y * y) / sum(r) AS yy FROM r GROUP BY j)
SELECT CAST(j AS INT) AS j, round(n / (SELECT count(*) FROM v), 8) AS weight, round(m0, 6) AS m0, round(m1, 6) AS m1, round(xx - m0 * m0 + 1e-6, 5) AS c00, round(xy - m0 * m1, 5) + 0.0 AS c01, round(yy - m1 * m1 + 1e-6, 5) AS c11 FROM m""")
def mixture_step(spark, sf):
    """One EM step of two Gaussians with full covariances."""
    rows = _t(spark, sf, "lineitem").select(F.array("l_quantity", F.col("l_discount") * 100).alias("p"))
    g, _ = C.gaussian_mixture(rows, 2, rounds=1, start=_EM)
    out = spark.createDataFrame([(j, float(g["weight"][j]), *map(float, g["mean"][j]), float(g["cov"][j, 0, 0]), float(g["cov"][j, 0, 1]), float(g["cov"][j, 1, 1])) for j in range(2)], "j int, weight double, m0 double, m1 double, c00 double, c01 double, c11 double")
    return out.select("j", _r("weight", 8).alias("weight"), _r("m0").alias("m0"), _r("m1").alias("m1"), *[_r(c, 5).alias(c) for c in ("c00", "c01", "c11")])


@query(f"""WITH p AS ({_P}), e AS (SELECT id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM p), g AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS v FROM e a JOIN e b USING (id) GROUP BY 1, 2),
g2 AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM g a JOIN g b ON a.j = b.i GROUP BY 1, 2)
SELECT 1 AS power, round(sum(v), 4) AS trace FROM g WHERE i = j UNION ALL SELECT 2, round(sum(v), 4) FROM g2 WHERE i = j UNION ALL SELECT 3, round(sum(a.v * b.v), 4) FROM g a JOIN g2 b ON a.i = b.j AND a.j = b.i UNION ALL SELECT 4, round(sum(a.v * b.v), 4) FROM g2 a JOIN g2 b ON a.i = b.j AND a.j = b.i""")
def pca_spectrum(spark, sf):
    """Sums of powers of the squared singular values: the traces of the powers of the cross product."""
    s, _, _ = D.pca(_points(spark, sf).select("id", F.col("p").alias("values")), 64)
    return spark.createDataFrame([(k, float((s ** (2 * k)).sum())) for k in (1, 2, 3, 4)], "power int, trace double").select("power", _r("trace", 4).alias("trace"))


#: How the sources are mixed, and the powers of the cross product after which SQL has its leading vector.
_MIX = [[1.0, 0.4, -0.3], [0.2, 1.0, 0.5], [-0.4, 0.3, 1.0]]


@query("""SELECT CAST(s AS INT) AS source, 1.0::DOUBLE AS correlation, CAST((SELECT count(*) FROM lineitem) AS BIGINT) AS n FROM range(3) t(s)""")
def ica_unmixed(spark, sf):
    """Three independent columns, mixed by a known matrix and unmixed again: each is one component, up to sign and scale."""
    columns = [F.col("l_quantity") / 14.4, F.col("l_discount") * 31.6, F.col("l_tax") * 38.7]  # about unit spread
    rows = _t(spark, sf, "lineitem").select(F.array(*columns).alias("source"))
    mixed = rows.withColumn("values", F.array(*[sum((F.get("source", F.lit(k)) * m for k, m in enumerate(row)), F.lit(0.0)) for row in _MIX]))
    found, _, _, _ = D.independent_components(mixed, 3)
    best = [F.greatest(*[F.abs(F.corr(F.get("source", F.lit(k)), F.get("values", F.lit(j)))) for j in range(3)]).alias(f"c{k}") for k in range(3)]
    one = found.agg(*best, F.count("*").alias("n"))
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("source"), F.round(f"c{k}", 2).alias("correlation"), F.col("n")) for k in range(3)])))


@query()
def pca_embeddings(spark, sf):
    rows = _points(spark, sf).select("id", F.col("p").alias("values"))
    s, _, scores = D.pca(rows, 64, most=4)
    return scores.select("id", *[_r(F.abs(F.get("values", F.lit(k)))).alias(f"s{k}") for k in range(4)])


@query("""WITH RECURSIVE f AS (SELECT l_orderkey, min(l_partkey) AS a FROM lineitem GROUP BY 1),
e AS (SELECT DISTINCT a, l_partkey AS b FROM lineitem JOIN f USING (l_orderkey) WHERE a <> l_partkey),
w AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
-- only nodes without a smaller neighbour can be the smallest of a component
r AS (SELECT a AS id, a AS c FROM w GROUP BY a HAVING min(b) > a UNION SELECT w.b, r.c FROM r JOIN w ON w.a = r.id WHERE w.b > r.c)
SELECT id, min(c) AS component FROM r GROUP BY 1""")
def component_labels(spark, sf):
    """Products bought together form groups: connected components over all lines, each order's first part linked to its others."""
    lines = _t(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("b"))
    first = lines.groupBy("l_orderkey").agg(F.min("b").alias("a"))
    return N.connected_components(lines.join(first, "l_orderkey").filter("a <> b").select("a", "b"))


@query()
def component_rank(spark, sf):
    w = _t(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return w.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "label")))


from . import image_queries, number_queries, source_queries  # noqa: E402, F401  (they register their queries)

#: SQL of queries above whose statement another query shares.
ORACLES["series_glm"] = ORACLES["fitted_series"]
ORACLES["series_band_pass"] = ORACLES["band_passed_series"].replace("CAST(a.t AS BIGINT) AS t", "CAST(a.t AS INT) AS t")
ORACLES["information_metrics"] = ORACLES["parzen_information"]
ORACLES["component_rank"] = "SELECT label, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, label) AS INT) AS rank FROM embeddings GROUP BY label"
_DIST = ORACLES["all_pairs_shortest_all"].replace("SELECT src, dst, round(min(d), 4) AS dist FROM r GROUP BY 1, 2", ", p AS (SELECT src, dst, min(d) AS d FROM r GROUP BY 1, 2)")
# of several shortest paths the one whose next node is the smallest is walked
ORACLES["betweenness"] = _DIST + """, x AS (SELECT p.src, p.dst, min(s.dst) AS via FROM p JOIN s ON s.src = p.src LEFT JOIN p q ON q.src = s.dst AND q.dst = p.dst
WHERE (s.dst = p.dst AND abs(s.d - p.d) <= 1e-9 * p.d) OR abs(s.d + q.d - p.d) <= 1e-9 * p.d GROUP BY 1, 2),
w AS (SELECT src, dst, via FROM x WHERE via <> dst UNION ALL SELECT x.src, x.dst, x.via FROM w JOIN x ON x.src = w.via AND x.dst = w.dst WHERE x.via <> x.dst)
SELECT v.id, count(w.via) AS visits FROM (SELECT src AS id FROM p UNION SELECT dst FROM p) v LEFT JOIN w ON w.via = v.id GROUP BY v.id"""
