"""Statistics, decomposition, clustering, graphs and spectra against numpy and known numbers."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxloom.functions import kernels as K
from voxloom.functions.expression import ExpressionError, compile_expression
from voxloom.functions.text import parse_line, sniff_delimiter, to_integer, to_number
from voxloom.model import Geometry, from_numpy, grid, pack, to_numpy, unpack
from voxloom.operators import aggregate, cluster, decomposition, geometry, graph, neighborhood, regression, spatial, spectral

AXES = ["x", "y", "z"]

#: Published quantiles of Student's t at p = .9, .95, .99 for 1, 10, 20 and 30 degrees.
QUANTILES = {1: (3.078, 6.314), 10: (1.372, 1.812, 2.764), 20: (1.325, 1.725, 2.528), 30: (1.310, 1.697, 2.457)}


def test_student_quantiles():
    for dof, values in QUANTILES.items():
        s = regression.StudentT(dof, 0.01, 40)
        for p, t in zip((0.9, 0.95, 0.99), values, strict=False):
            assert abs(s.icdf(p) - t) < 0.01 and abs(s.cumulative(t) - p) < 1e-3
            assert abs(s.cumulative(-t) - (1 - p)) < 1e-3 and s.density(-t) == s.density(t)


def packed_of(spark, y):
    return spark.createDataFrame([("i", k, 0, 0, row.tolist()) for k, row in enumerate(y)], "img_id string, x int, y int, z int, ts array<double>")


def test_glm_and_residuals(spark):
    rng = np.random.default_rng(0)
    x = np.column_stack([rng.normal(size=(200, 3)), np.ones(200)])
    beta = rng.normal(size=(30, 4)) * 3
    y = beta @ x.T + rng.normal(size=(30, 200))
    out = {r.x: r for r in regression.glm(packed_of(spark, y), x, ["x"]).collect()}
    miss = [abs(out[k].bhat[j] - beta[k, j]) > 2 * out[k].std_err[j] for k in range(30) for j in range(4)]
    assert np.mean(miss) < 0.12
    want, *_ = np.linalg.lstsq(x, y.T, rcond=None)
    assert np.allclose([out[k].bhat for k in range(30)], want.T)
    rest = regression.regress_out(packed_of(spark, np.vstack([y, np.ones((1, 200))])), x).orderBy("x").collect()
    assert np.allclose(np.array([r.ts for r in rest[:30]]), y - (x @ want).T) and not any(rest[30].ts)


def test_ols_columns_and_lasso(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = x @ [2.0, 0.0, -1.0] + 0.5 + rng.normal(size=400) * 0.3
    df = spark.createDataFrame(pd.DataFrame(np.column_stack([y, x]), columns=["y", "a", "b", "c"]))
    o = regression.ols_columns(df, "y", ["a", "b", "c"])
    assert np.allclose(o["bhat"], [2, 0, -1, 0.5], atol=0.1) and 0.9 < o["adj_rsqr"] <= o["rsqr"]
    for active in (False, True):
        b = regression.lasso(df, "y", ["a", "b", "c"], 30.0, active)
        assert abs(b[1]) < 0.05 and b[0] > 1.5 and b[2] < -0.5
    r = regression.partial_correlation(df, ["y", "a", "b", "c"])
    p = np.linalg.inv(np.cov(np.column_stack([y, x]).T))
    assert np.allclose(r[0, 1], -p[0, 1] / math.sqrt(p[0, 0] * p[1, 1]))


def rows_of(spark, x):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "row_id long, values array<double>")


def test_pca_and_randomized(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3)) @ rng.normal(size=(3, 12)) + 1e-3 * rng.normal(size=(300, 12))
    want = np.linalg.svd(x, compute_uv=False)
    s, v, scores = decomposition.pca(rows_of(spark, x), 12, most=3)
    assert np.allclose(s, want[:3]) and np.allclose(v.T @ v, np.eye(3))
    got = np.array([r["values"] for r in scores.orderBy("row_id").collect()])
    assert np.allclose(got, x @ v)
    s, _ = decomposition.randomized_svd(rows_of(spark, x), 12, 3)
    assert np.allclose(s, want[:3], rtol=1e-4)


def matched(a, b):
    """Largest absolute correlation of each true source with a found one."""
    return np.abs(np.corrcoef(a.T, b.T)[: a.shape[1], a.shape[1] :]).max(1)


def test_independent_components(spark):
    t = np.linspace(0, 40, 1500)
    sources = np.column_stack([np.sign(np.sin(2 * t)), np.mod(t, 3) - 1.5, np.random.default_rng(3).laplace(size=1500)])
    x = sources @ np.array([[1, 0.5, 0.2], [0.3, 1, 0.6], [0.4, 0.1, 1]])
    for ica in (decomposition.symmetric_ica, decomposition.deflation_ica):
        assert matched(sources, ica(x)[0]).min() > 0.95
    centered = x - x.mean(0)
    s2, v = np.linalg.eigh(centered.T @ centered)
    maps, _ = decomposition.spatial_components(rows_of(spark, centered), np.sqrt(s2), v)
    got = np.array([r["values"] for r in maps.orderBy("row_id").collect()])
    assert matched(sources, got).min() > 0.95


def points_of(spark, p):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(p)], "id long, p array<double>")


def test_distance_joins(spark):
    rng = np.random.default_rng(4)
    p, q = rng.random((400, 4)) * 10, rng.random((200, 4)) * 10
    d = ((q[:, None] - p[None]) ** 2).sum(-1)
    pairs = {(r.left_id, r.right_id) for r in spatial.within_distance(points_of(spark, q), points_of(spark, p), 2.0, 4).collect()}
    assert pairs == {(i, j) for i, j in zip(*np.nonzero(d < 4), strict=True)}
    near = {r.id: r.nearest_id for r in spatial.nearest(points_of(spark, q), points_of(spark, p), 64.0).collect()}
    assert near == dict(enumerate(d.argmin(1).tolist()))
    far = spatial.nearest(points_of(spark, q + 1000), points_of(spark, p), 8.0)
    assert far.count() == 0


def test_clusters(spark):
    rng = np.random.default_rng(5)
    true = np.array([[0, 0], [6, 0], [0, 6], [6, 6.0]])
    p = np.vstack([c + rng.normal(size=(150, 2)) * 0.5 for c in true])
    centers, found = cluster.kmeans(points_of(spark, p), 4, seed=3)
    assert all(np.abs(centers - t).sum(1).min() < 0.3 for t in true) and found.select("cluster").distinct().count() == 4
    model, _ = cluster.gaussian_mixture(points_of(spark, p), 4, seed=3)
    assert all(np.abs(model["mean"] - t).sum(1).min() < 0.3 for t in true) and np.allclose(model["weight"], 0.25, atol=0.05)
    peaks = cluster.density_peaks(points_of(spark, p), 0.5, leaf_points=50)
    n = (((p[:, None] - p[None]) ** 2).sum(-1) < 0.25).sum(1) - 1
    rows = {r.id: r for r in peaks.collect()}
    assert all(rows[k].rho == n[k] for k in range(len(p)))
    d = ((p[:, None] - p[None]) ** 2).sum(-1)
    for k in range(0, len(p), 37):
        higher = [j for j in range(len(p)) if (n[j], j) > (n[k], k)]
        assert not higher and rows[k].parent is None or abs(rows[k].delta - d[k, higher].min()) < 1e-9
    classes = cluster.peak_classes(peaks, 6)
    sizes = [r["count"] for r in classes.groupBy("peak").count().collect()]
    assert sum(sizes) == 600 and sum(s > 100 for s in sizes) == 4


def test_mixture_1d(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([-rng.gamma(9, 3, 400), rng.normal(0.5, 4, 2000), rng.gamma(10, 2, 400)])
    mu, sd, prior = cluster.gauss_gamma_mixture(spark.createDataFrame(pd.DataFrame({"v": x})), "v")
    assert abs(mu[1] - 0.5) < 2 and mu[0] < -15 and mu[2] > 12 and prior[1] > 0.5


def test_graph_metrics(spark):
    g = graph.coxeter(spark)
    d = graph.degrees(g).collect()
    assert len(d) == 28 and {(r.in_degree, r.out_degree, r.degree) for r in d} == {(3, 3, 6)}
    assert graph.total(g).first().degree == 84 and graph.assortativity(g).first().assortativity == 1
    rng = np.random.default_rng(7)
    m = rng.random((9, 9)) * (rng.random((9, 9)) < 0.4)
    np.fill_diagonal(m, 0)
    edges = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(9) for j in range(9) if m[i, j]], "src long, dst long, w double")
    dist = np.where(m > 0, m, np.inf)
    np.fill_diagonal(dist, 0)
    for k in range(9):
        dist = np.minimum(dist, dist[:, k : k + 1] + dist[k])
    paths = graph.shortest_paths(edges)
    got = {(r.src, r.dst): r.dist for r in paths.collect()}
    assert all(abs(got.get((i, j), np.inf) - dist[i, j]) < 1e-9 or math.isinf(dist[i, j]) and (i, j) not in got for i in range(9) for j in range(9) if i != j)
    via = {(r.src, r.dst): r.via for r in paths.collect()}
    visits = np.zeros(9, int)
    for i, j in via:
        at = via[i, j]
        while at != j:
            visits[at] += 1
            at = via[at, j]
    assert {r.id: r.visits for r in graph.betweenness(paths).collect()} == {k: v for k, v in enumerate(visits.tolist()) if (m[k] > 0).any() or (m[:, k] > 0).any()}


def test_spectra(spark):
    t = np.arange(256)
    slow, fast = np.sin(2 * np.pi * 4 * t / 256), np.sin(2 * np.pi * 60 * t / 256)
    out = np.array(spectral.band_pass(packed_of(spark, np.array([slow + fast])), 1.0, None, 0.08).first().ts)
    assert np.corrcoef(out, slow)[0, 1] > 0.99
    x = np.random.default_rng(8).normal(size=37)
    for alpha in (0.3, 1.0, -0.7):
        assert np.allclose(spectral.chirp_z(x, alpha), spectral.chirp_z_direct(x, alpha))
    rows = spectral.chirp_z_rows(packed_of(spark, x[None]), 0.3).first()
    assert np.allclose(np.array(rows.re) + 1j * np.array(rows.im), spectral.chirp_z_direct(x, 0.3))
    y = np.exp(-((np.arange(64) - 30) ** 2) / 20)
    want = np.exp(-((np.arange(64) - 33.5) ** 2) / 20)
    assert np.abs(spectral.shift_line(y, 3.5) - want).max() < 1e-3 and np.abs(spectral.shift_line_kernel(y, 3.5) - want).max() < 0.02
    assert np.allclose(spectral.resample_line(np.cos(2 * np.pi * np.arange(32) / 32), 2), np.cos(2 * np.pi * np.arange(64) / 64))
    a = np.random.default_rng(9).normal(size=(6, 5))
    f = spectral.fft(from_numpy(spark, a).select("x", "y", F.col("v").alias("re")), ["x", "y"]).collect()
    want = np.fft.fftn(a)
    assert all(abs(r.re + 1j * r.im - want[r.x, r.y]) < 1e-9 for r in f)
    g = np.exp(-np.linspace(-3, 3, 65) ** 2)
    twice = spectral.fractional_fourier(spectral.fractional_fourier(g, 0.6), 0.4)
    once = spectral.fractional_fourier(g, 1.0)
    assert np.corrcoef(np.abs(twice), np.abs(once))[0, 1] > 0.99


def test_fractional_and_chirplet_sums_by_their_kernels():
    rng = np.random.default_rng(12)
    for n in (1, 2, 9, 40):
        x = rng.normal(size=n)
        k = (np.arange(n) - n // 2) / math.sqrt(n)
        for order in (0.5, 0.8, 1.3):
            phi = order * math.pi / 2
            kernel = np.exp(1j * np.pi * ((k[:, None] ** 2 + k**2) / math.tan(phi) - 2 * np.outer(k, k) / math.sin(phi)))
            want = np.exp(1j * (phi / 2 - math.pi / 4)) / math.sqrt(math.sin(phi)) * kernel @ x / math.sqrt(n)
            assert np.allclose(spectral.fractional_fourier(x, order), want)
        fine = 2 * n + 1
        at = (np.arange(fine) - n) * n / fine
        window = lambda d: np.where(np.abs(d) < 5, np.sinc(d) * np.sinc(d / 5), 0)
        up = window(at[:, None] + n // 2 - np.arange(n)) @ x
        there = np.exp(-2j * np.pi * 0.4 * np.outer(at, at) / n) @ up
        want = window(((np.arange(n) - n // 2) * fine / n + n)[:, None] - np.arange(fine)) @ there
        assert np.allclose(spectral.chirplet(x, 0.4), want)
    assert len(spectral.chirplet(np.zeros(0), 0.4)) == 0


def test_windows_in_space(spark):
    rng = np.random.default_rng(10)
    a = rng.integers(0, 3, (5, 4, 3)).astype(float)
    df = from_numpy(spark, a).select(*AXES, "v")
    pad = np.pad(a, 1, mode="edge")
    cubes = np.stack([pad[i : i + 5, j : j + 4, k : k + 3] for i in range(3) for j in range(3) for k in range(3)])
    assert np.array_equal(to_numpy(neighborhood.median_filter_nd(df, AXES, [5, 4, 3]), (5, 4, 3)), np.sort(cubes, 0)[13])
    assert np.array_equal(to_numpy(neighborhood.erode(df, AXES, [5, 4, 3], 1, block=True), (5, 4, 3)), np.where((cubes != 0).all(0), a, 0))
    grown = to_numpy(neighborhood.dilate(df, AXES, [5, 4, 3], 1, block=True), (5, 4, 3))
    assert np.array_equal(grown != 0, (cubes != 0).any(0))
    s = neighborhood.sobel(df, AXES, [5, 4, 3])
    w, m = np.array([-0.5, 0, 0.5]), np.array([0.25, 0.5, 0.25])
    kernel = np.einsum("i,j,k->ijk", w, m, m).reshape(27, 1, 1, 1)
    assert np.allclose(to_numpy(s, (5, 4, 3), "d_x"), (cubes * kernel).sum(0))
    labels = to_numpy(neighborhood.relabel_connected(df, AXES, [5, 4, 3]), (5, 4, 3), "label")
    flat = np.arange(60).reshape(5, 4, 3)
    want, old = flat.copy(), None
    while not np.array_equal(old, want):
        old = want.copy()
        for i in np.ndindex(a.shape):
            for axis in range(3):
                j = tuple(v + (k == axis) for k, v in enumerate(i))
                if j[axis] < a.shape[axis] and a[i] == a[j]:
                    want[i] = want[j] = min(want[i], want[j])
    assert np.array_equal(labels, want)


def test_interpolation_and_motion(spark):
    i, j, k = np.indices((8, 9, 7))
    a = 2.0 * i - j + 0.5 * k
    df = from_numpy(spark, a).select(*AXES, "v")
    at = [(0, 2.3, 4.1, 3.7), (1, 6.9, 0.0, 5.5), (2, 3.0, 3.0, 3.0)]
    samples = spark.createDataFrame(at, "n int, a double, b double, c double")
    out = spatial.interpolate(samples, df, dict(zip(AXES, map(F.col, "abc"), strict=True)), dict(zip(AXES, a.shape, strict=True)), ["n"])
    assert all(abs(r.v - (2 * at[r.n][1] - at[r.n][2] + 0.5 * at[r.n][3])) < 1e-9 for r in out.collect())
    near = spatial.interpolate(samples, df, dict(zip(AXES, map(F.col, "abc"), strict=True)), dict(zip(AXES, a.shape, strict=True)), ["n"], "nearest")
    assert {r.n: r.v for r in near.collect()}[0] == a[2, 4, 4]
    geo = Geometry((8, 9, 7), [2, 2, 2], [1, 2, 3])
    assert geo.matches(geo) and geo.is_isotropic() and not geo.matches(Geometry((8, 9, 7)))
    same = to_numpy(spatial.resample_to(df, geo, geo), a.shape)
    assert np.allclose(same, a)
    ball = np.exp(-((i - 3) ** 2 + (j - 4) ** 2 + (k - 3) ** 2) / 4.0)
    m = geometry.Rigid(np.zeros(3), np.array([1.0, 0, 0]), np.array([3.5, 4, 3]))
    moved = to_numpy(geometry.rigid_transform(from_numpy(spark, ball).select(*AXES, "v"), ball.shape, m), ball.shape)
    assert np.allclose(moved[1:], ball[:-1], atol=1e-9)


def test_registration_recovers_a_motion():
    i, j, k = np.indices((20, 20, 20))
    a = np.exp(-((i - 9) ** 2 / 30 + (j - 10) ** 2 / 12 + (k - 9) ** 2 / 50))
    center = np.full(3, 9.5)
    true = geometry.Rigid(np.array([0.05, -0.08, 0.1]), np.array([1.0, -0.7, 0.5]), center)
    cells = np.indices(a.shape).reshape(3, -1).T.astype(float)
    b = geometry.sample(a, true.inverse().apply(cells)).reshape(a.shape)  # a carried by the motion
    for metric in (geometry.correlation_metric, geometry.information_metric("mi")):
        back = geometry.register_rigid(a, b, metric, (2, 0))
        assert np.abs(back.apply(true.apply(cells)) - cells)[(cells > 5).all(1) & (cells < 14).all(1)].max() < 0.3


@pytest.mark.parametrize("metric", [geometry.correlation_metric, *[geometry.information_metric(kind, 16) for kind in ("mi", "nmi", "vi")]])
def test_metric_slopes_by_differences(metric):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=60), rng.uniform(0.2, 0.8, 60)
    _, slope = metric.slope(a, b, (0.0, 1.0))
    got = geometry.numeric_gradient(lambda v: metric.slope(a, v, (0.0, 1.0))[0], b, np.full(60, 1e-5))
    assert np.abs(slope - got).max() < 1e-6
    assert metric(a, b) == metric.slope(a, b)[0]
    moving = rng.uniform(0, 5, (7, 8, 6))
    points = rng.uniform(1.5, 4.5, (50, 3))
    at = np.array([0.02, -0.03, 0.05, 0.11, -0.2, 0.07])
    center = np.array([3.0, 3.5, 2.5])
    _, slope = geometry.rigid_cost(metric, moving, points, a[:50], center, at)
    got = geometry.numeric_gradient(lambda v: geometry.rigid_cost(metric, moving, points, a[:50], center, v)[0], at, np.full(6, 1e-7))
    assert np.abs(slope - got).max() < 1e-3 * max(1.0, np.abs(got).max())


def test_a_metric_without_slope_registers_too():
    i, j, k = np.indices((9, 9, 9))
    a = np.exp(-((i - 4) ** 2 / 9 + (j - 4) ** 2 / 5 + (k - 4) ** 2 / 7))
    m = geometry.register_rigid(a, a, lambda x, y: float(((x - y) ** 2).mean()), (0,))
    assert np.abs(m.shift).max() < 0.05 and np.abs(m.matrix - np.eye(3)).max() < 0.02


def test_distortion_that_varies_across_the_other_axes():
    i, j, k = np.indices((16, 20, 12))
    fixed = np.exp(-((j - 9.5) ** 2) / 12) * (50 + 10 * np.cos(i / 3) + 5 * np.cos(k / 2))  # fades out before the ends
    cells = np.indices(fixed.shape).reshape(3, -1).T.astype(float)
    cells[:, 1] -= (1.2 * np.sin(i / 5)).ravel()
    moving = geometry.sample(fixed, cells).reshape(fixed.shape)
    inner = np.s_[:, 5:-5, :]  # where the image has slopes
    before = np.corrcoef(fixed[inner].ravel(), moving[inner].ravel())[0, 1]
    field, out = geometry.correct_distortion(fixed, moving, 1, 5, geometry.correlation_metric, rounds=40)
    after = np.corrcoef(fixed[inner].ravel(), out[inner].ravel())[0, 1]
    assert 1 - after < (1 - before) / 5
    assert np.corrcoef(field[inner].ravel(), (1.2 * np.sin(i / 5))[inner].ravel())[0, 1] > 0.9


def test_deformations(spark):
    dims = (6, 6, 6)
    cells = grid(spark, dims).select(*AXES)
    still = cells.select("*", F.lit(0.5).alias("dx"), F.lit(0.0).alias("dy"), (F.col("z") * 0.1).alias("dz"))
    assert all(abs(r.det - 1.1) < 1e-9 for r in geometry.jacobian(still, dims).collect())
    back = geometry.invert_deformation(still, dims).filter("x between 2 and 4 and z between 1 and 4").collect()
    assert all(abs(r.dx + 0.5) < 1e-2 and abs(r.dz + r.z * 0.1 / 1.1) < 1e-2 for r in back)


def test_shears_and_bias(spark):
    r = geometry.rotation(0.2, -0.1, 0.15)
    parts = geometry.shear_decompose(r)
    product = np.linalg.multi_dot(parts)
    assert np.abs(product - r).max() < 1e-4
    i, j, k = np.indices((10, 10, 6))
    field = np.exp(0.3 * np.sin(i / 4) + 0.02 * j)
    _, found = geometry.bias_field(from_numpy(spark, 50 * field).select(*AXES, "v"), field.shape, 4)
    got = to_numpy(found, field.shape, "bias")
    assert np.corrcoef(got.ravel(), field.ravel())[0, 1] > 0.99


def test_expressions(spark):
    df = spark.createDataFrame([(2.0, 3.0), (-1.0, 0.0)], "a double, b double")
    for text, want in {"a + b * 2": (8, -1), "-(a - b) ^ 2": (-1, -1), "a > 0 and b >= 3 or 0": (1, 0), "round(a / b)": (1, -math.inf), "neg(floor(a / 4))": (0, 1), "exp(log(4)) - 4 <= 0.0001": (1, 1)}.items():
        out = df.select(compile_expression(text, {"a": F.col("a"), "b": F.col("b")}).alias("v")).collect()
        assert tuple(round(r.v, 9) if math.isfinite(r.v) else r.v for r in out) == want
    for bad in ("a +", "(a", "a b", "q", "a $ b"):
        with pytest.raises(ExpressionError):
            compile_expression(bad, {"a": F.col("a"), "b": F.col("b")})


def test_text_fields(spark):
    lines = spark.createDataFrame([("# note",), (" 1; 2 ;3",), ("",), ("4;5;;6",)], "value string")
    assert sniff_delimiter(lines) == ";"
    assert lines.filter("value like '4%'").select(parse_line(F.col("value"), ";").alias("f")).first().f == ["4", "5", "6"]
    t = spark.createDataFrame([("12abc",), ("x",), ("-1.5e2 z",), ("0x1F",), ("017",)], "t string")
    assert [r.v for r in t.select(to_number(F.col("t")).alias("v")).collect()] == [12, 0, -150, 0, 17]
    assert [r.v for r in t.select(to_integer(F.col("t")).alias("v")).collect()] == [None, None, None, 31, 15]


def test_kernels(spark):
    x = spark.createDataFrame([(v,) for v in np.linspace(-2.6, 2.6, 53).tolist()], "x double")
    rows = x.select("x", K.erf(F.col("x")).alias("erf"), K.b3(F.col("x")).alias("b"), K.d_b3(F.col("x")).alias("db"), K.gamma_pdf(F.col("x"), 3, 0.5).alias("g"), K.canonical_hrf(F.col("x") + 5).alias("h")).collect()
    assert all(abs(r.erf - math.erf(r.x)) < 1e-10 for r in rows)
    assert np.allclose([r.h for r in rows], regression.canonical_response(np.array([r.x + 5 for r in rows])))
    b = np.array([r.b for r in rows])
    assert np.allclose(np.gradient(b, 0.1)[2:-2], [r.db for r in rows][2:-2], atol=0.02)
    n = spark.createDataFrame([(1,), (6,), (64,), (97,), (360,)], "n long").select("n", K.highest_bit(F.col("n")).alias("h"), K.next_power_of_two(F.col("n")).alias("p"), K.prime_factors(F.col("n")).alias("f")).collect()
    assert [(r.h, r.p) for r in n] == [(1, 1), (4, 8), (64, 64), (64, 128), (256, 512)]
    assert [r.f for r in n] == [[], [2, 3], [2] * 6, [97], [2, 2, 2, 3, 3, 5]]
    assert [K.next_odd_smooth(v) for v in (1, 9, 10, 27)] == [3, 15, 15, 35]


def test_packed_forms(spark):
    a = np.random.default_rng(11).normal(size=(3, 2, 2, 7))
    long = from_numpy(spark, a)
    packed = pack(long)
    assert np.allclose(to_numpy(unpack(packed), a.shape), a)
    r = aggregate.packed_reduce(packed).filter("x = 1 and y = 1 and z = 0").first()
    v = a[1, 1, 0]
    assert np.allclose([r["sum"], r.avg, r["var"], r["min"], r["max"], r.median], [v.sum(), v.mean(), v.var(ddof=1), v.min(), v.max(), np.sort(v)[3]])


def test_information(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=2000)
    df = spark.createDataFrame(pd.DataFrame({"a": x, "b": x + 0.1 * rng.normal(size=2000), "c": rng.normal(size=2000)}))
    close, apart = aggregate.information(df, "a", "b").first(), aggregate.information(df, "a", "c").first()
    assert close.mi > apart.mi + 0.5 and close.vi < apart.vi and close.nmi > apart.nmi >= 1
