"""Golden values, identities and the SQL of every registered query."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pixelloom.functions.cdf import chi2_cdf
from pixelloom.functions import cdf
from pixelloom.operators import change, classify, cluster, fits, focal, learn, local, metrics, moments, radar, ranks, regress, sampling, series, transforms
from pixelloom.plans import registry
from pixelloom.sources import files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def ordered(columns, data):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(r[i] for i in at) for r in data]
    rough = lambda v: (v is not None, float(v) if isinstance(v, (int, float)) else str(v)) if v is not None else (False, 0)
    return sorted(out, key=lambda r: ([str(rough(v)) for v in r if not isinstance(v, float)], [rough(v) for v in r if isinstance(v, float)]))


def same(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)) or isinstance(b, float) and isinstance(a, (int, float)):
        return math.isclose(a, b, rel_tol=1e-5, abs_tol=2e-5) or a != a and b != b
    return str(a) == str(b)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rel = duck.sql(registry.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got, want = ordered(df.columns, df.collect()), ordered(rel.columns, rel.fetchall())
    assert len(got) == len(want)
    assert [(a, b) for a, b in zip(got, want) if not all(map(same, a, b))] == []


def test_chi2(spark):
    r = spark.range(1).select(chi2_cdf(F.lit(7.5), 4).alias("a"), chi2_cdf(F.lit(7.5), 3).alias("b"), chi2_cdf(F.lit(0.0), 1).alias("c")).first()
    assert abs(r["a"] - 0.888291) < 1e-6 and abs(r["b"] - 0.942442) < 1e-6 and r["c"] == 0


def test_peaks(spark):
    x = [6, 2, 2, 1, 3, 4, 1, 3, 1, 1, 1, 6, 2, 2, 7, 1]
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "s string, d int, v double")
    p = focal.peaks_window(df, "s", "d", "v", 3).filter("is_peak")
    assert sorted(r["d"] for r in p.collect()) == [0, 5, 7, 11, 14]
    assert sorted(r["d"] for r in focal.peaks_distance(p, "s", "d", "v", 3).collect()) == [0, 5, 11, 14]


def test_series_paths(spark):
    a = [0, 0, 0, 0, 1, 1, 2, 2, 3, 2, 1, 1, 0, 0, 0, 0]
    b = [0, 0, 1, 1, 2, 2, 3, 3, 3, 3, 2, 2, 1, 1, 0, 0]
    df = spark.createDataFrame([(0, [float(v) for v in a], [float(v) for v in b]), (1, [0.0, 1.0, 2.0, 1.0, 3.0, 0.0, 1.0], [1.0, 3.0, 2.0, 0.0, 1.0, 0.0]), (2, [], [1.0]), (3, None, None)], "i int, a array<double>, b array<double>")
    r = {x["i"]: x for x in df.select("i", series.warp()("a", "b").alias("w"), series.common()("a", "b").alias("c"), series.warp(free=True)("a", "b").alias("f")).collect()}
    assert r[0]["w"]["cost"] == 0 and r[0]["w"]["path_x"][0] == 0 and r[0]["w"]["path_y"][-1] == 15
    assert r[1]["c"]["length"] == 4 and [df.collect()[1]["a"][i] for i in r[1]["c"]["path_x"]] == [df.collect()[1]["b"][i] for i in r[1]["c"]["path_y"]]
    assert r[2]["c"]["length"] == 0 and r[3]["w"]["path_x"] == [] and r[1]["f"]["cost"] <= r[1]["w"]["cost"]
    x, y = np.random.default_rng(0).normal(size=(2, 12))
    d = np.abs(x[:, None] - y)
    c = np.full((13, 13), np.inf)
    c[0, 0] = 0
    for i in range(12):
        for j in range(12):
            c[i + 1, j + 1] = d[i, j] + min(c[i, j], c[i, j + 1], c[i + 1, j])
    cost, px, py = series._warp(x, y, False, False)
    assert math.isclose(cost, c[12, 12]) and math.isclose(cost, d[px, py].sum())


def test_neighbour_mean_of_a_lone_cell(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (1, 0, 3.0), (9, 9, 5.0)], "x long, y long, v double")
    assert sorted(map(tuple, focal.neighbour_mean(df, "v").collect())) == [(0, 0, 3.0), (1, 0, 1.0)]


def test_binary_metrics_and_auc(spark):
    t, p = [1, 1, 1, -1, 1, -1, -1, -1], [2.3, -0.4, 1.6, 0.6, 3.2, -4.9, 1.3, -0.3]
    df = spark.createDataFrame(list(zip(t, p)), "t int, p double")
    r = metrics.binary_metrics(df, F.col("t") == 1, F.col("p") > 0).first()
    assert (r["error_p"], r["error_n"], r["sensitivity"], r["specificity"], r["ppv"]) == (0.25, 0.5, 0.75, 0.5, 0.6)
    assert abs(r["mcc"] - 0.2581988897) < 1e-9
    assert metrics.auc(df, F.col("t") == 1, F.col("p")).first()["auc"] == 0.8125


def test_binary_metrics_of_many_rows_and_of_none(spark):
    df = spark.range(400_000).select((F.col("id") % 2 == 0).alias("t"), (F.col("id") % 4 < 3).alias("p"))
    r = metrics.binary_metrics(df, F.col("t"), F.col("p")).first()
    assert (r["error"], r["sensitivity"], r["specificity"]) == (0.25, 1.0, 0.5) and math.isclose(r["mcc"], 1 / math.sqrt(3))
    r = metrics.binary_metrics(df.limit(0), F.col("t"), F.col("p")).first()
    assert r["error"] == r["accuracy"] == r["ppv"] == r["mcc"] == 0


def test_ranked_lists(spark):
    lists = [[2, 4, 1, 3, 0], [3, 4, 1, 2, 0], [2, 4, 3, 0, 1]]
    df = spark.createDataFrame([(i, p, v) for i, l in enumerate(lists) for p, v in enumerate(l)], "list_id int, pos int, id int")
    assert [r["id"] for r in metrics.borda(df, 3).orderBy("rank").collect()][0] == 4
    places = spark.createDataFrame([(i, p - 0, k) for i, l in enumerate(lists) for k, p in enumerate(l)], "list_id int, pos int, id int")
    assert abs(metrics.canberra_stability(places, 3, 5).first()["stability"] - 0.74862979571) < 1e-6


def test_imad_finds_planted_block(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(2000, 2))
    c = a @ np.array([[1.5, 0.2], [0.1, 0.8]]) + rng.normal(size=(2000, 2)) * 0.1
    c[:200] = rng.normal(size=(200, 2)) * 2 + 3
    df = spark.createDataFrame([(i, *map(float, a[i]), *map(float, c[i])) for i in range(2000)], "id int, a1 double, a2 double, c1 double, c2 double")
    out, rho = change.imad(df, ["a1", "a2"], ["c1", "c2"], iterations=8)
    r = out.select(F.avg(F.when(F.col("id") < 200, F.col("p_nochange"))).alias("x"), F.avg(F.when(F.col("id") >= 200, F.col("p_nochange"))).alias("y")).first()
    # Reweighting narrows the variance, so no-change pixels do not keep a mean of one half.
    assert r["x"] < 0.02 < 0.15 < r["y"] and rho[0] > 0.95


@pytest.mark.parametrize("name, first, second", [("imad_two_band", ["a1", "a3"], ["c1", "c3"])])  # four bands collapse on 200 pixels
def test_imad_runs_to_convergence(spark, name, first, second):
    got = {r["id"]: r["chi2"] for r in registry.QUERIES[name](spark, SF).collect()}
    data = registry.A.pair(spark, SF).select("id", *first, *second).collect()
    x, n = np.array([r[1:] for r in data], float), len(first)
    w, old = np.ones(len(x)), np.zeros(n)
    for _ in range(50):
        m = (w[:, None] * x).sum(0) / w.sum()
        s = ((x - m).T * w) @ (x - m) / (w.sum() - 1)
        l1, l2 = np.linalg.inv(np.linalg.cholesky(s[:n, :n])), np.linalg.inv(np.linalg.cholesky(s[n:, n:]))
        u, rho, vt = np.linalg.svd(l1 @ s[:n, n:] @ l2.T)
        d = (x[:, :n] - m[:n]) @ l1.T @ u - (x[:, n:] - m[n:]) @ l2.T @ vt.T
        chi2 = (d * d / (2 * (1 - rho))).sum(1)
        w = np.exp(-chi2 / 2) * (1 if n == 2 else 1 + chi2 / 2)
        if np.max(np.abs(rho - old)) <= 1e-3:
            break
        old = rho
    assert len(got) == len(x)
    assert np.allclose([got[r["id"]] for r in data], chi2, rtol=1e-3, atol=1e-3)


def test_pca_trace_and_weighted_moments(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3)) + 100
    w = rng.random(500)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, w)], "b1 double, b2 double, b3 double, w double")
    _, values, _ = classify.pca(df, ["b1", "b2", "b3"])
    assert abs(values.sum() - np.trace(np.cov(x.T))) < 1e-9
    mean, cov = moments.matrices(moments.weighted_moments(df, ["b1", "b2", "b3"], F.col("w")).first(), ["b1", "b2", "b3"])
    m = (w[:, None] * x).sum(0) / w.sum()
    want = ((x - m).T * w) @ (x - m) / (w.sum() - 1)
    assert np.allclose(mean, m) and np.allclose(cov, want)


def test_determinant_of_hermitian(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(3, 5)) + 1j * rng.normal(size=(3, 5))
    c = z @ z.conj().T
    v = [c[0, 0].real, c[0, 1].real, c[0, 1].imag, c[0, 2].real, c[0, 2].imag, c[1, 1].real, c[1, 2].real, c[1, 2].imag, c[2, 2].real]
    d = spark.range(1).select(local.determinant([F.lit(float(x)) for x in v]).alias("d")).first()["d"]
    assert math.isclose(d, np.linalg.det(c).real, rel_tol=1e-6)


# ------------------------------------------------------------- plain inputs that have no spread


def test_constant_empty_and_one_class(spark):
    one = spark.createDataFrame([(i, 3.0, 3.0, "A", 1, 1) for i in range(5)], "id long, a double, b double, cls string, p int, l int")
    for df, n in ((one, 5), (one.limit(0), 0)):
        grid = df.select(F.col("id").alias("x"), F.lit(0).alias("y"), "a", "b")
        assert [r["byte"] for r in local.byte_stretch(grid, "a").collect()] == [0] * n
        assert [r["stretched"] for r in local.stretch_2pc(grid, "a").collect()] == [0] * n
        assert [r["enhanced"] for r in local.log_enhance(grid, "a").collect()] == [0.0] * n
        assert [r["s_a"] for r in local.minmax_scale(grid, ["a"]).collect()] == [-1.0] * n
        assert [(r["mad"], r["chi2"]) for r in change.mad_single_band(df, "a", "b").collect()] == [(0.0, 0.0)] * n
        assert [r["rx"] for r in classify.rx_anomaly(df, ["a", "b"]).collect()] == [0.0] * n
        assert moments.orthogonal_regression(df, "a", "b").first()["r"] is None
        assert metrics.kappa(df, "p", "l").collect() is not None
        assert metrics.auc(df, F.col("l") == 1, F.col("a")).first()["auc"] is None
        assert metrics.regression_metrics(df, "a", "b").first()["r2"] is None
        assert metrics.misclassification(df, "p", "l").first()["rate"] == (0.0 if n else None)
        assert local.percentiles(df, "a").first()["p2"] == (3.0 if n else None)
        assert metrics.stratified_folds(df, "id", "cls", 3).count() == n
        assert change.imad(df.limit(0), ["a"], ["b"])[0].count() == 0
        assert [r["z_a"] for r in regress.standardized(df, ["a"]).collect()] == [0.0] * n


def test_distributions(spark):
    for k in (1, 3, 5, 9, 13):
        for x in (0.01, 0.7, 3.0, 25.0, 90.0):
            got = spark.range(1).select(F.lit(x).alias("x")).select(chi2_cdf(F.col("x"), k).alias("c")).first()["c"]
            assert abs(got - cdf.gamma_p(k / 2, x / 2)) < 1e-13
    assert abs(cdf.f_cdf(2.5, 5, 10) - 0.8979977) < 1e-6 and abs(cdf.t_cdf(2.0, 10) - 0.9633060) < 1e-6
    assert abs(cdf.chi2_quantile(0.95, 3) - 7.814728) < 1e-5 and abs(cdf.normal_quantile(0.975) - 1.959964) < 1e-6


def test_orders_do_not_depend_on_ranges(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=3000), 2)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    monkeypatch.setattr(ranks, "FEW", 20)
    assert np.allclose(ranks.quantiles(df, "v", (0.02, 0.5, 0.98, 1.0)), np.quantile(x, (0.02, 0.5, 0.98, 1.0)))
    counts = df.groupBy("v").agg(F.count("*").alias("c"))
    got = {r["v"]: r["b"] for r in ranks.before(counts, "v", {"b": "c"}).collect()}
    assert got == {float(v): int((x < v).sum()) for v in set(x)}


# ------------------------------------------------------------- models against numpy


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (80, 3)), rng.normal(4, 1, (70, 3)) * [1, 2, 1]])
    data = [(i, *map(float, r), "a" if i < 80 else "b") for i, r in enumerate(x)]
    return x, spark.createDataFrame(data, "id long, b1 double, b2 double, b3 double, cls string")


def test_transforms(spark, cloud):
    x, df = cloud
    bands = ["b1", "b2", "b3"]
    rec = np.array([[r[f"rec_{b}"] for b in bands] for r in classify.pca_reconstruction(df, bands, 2).orderBy("id").collect()])
    values = classify.components(df, bands)[1]
    assert np.allclose(np.cov((x - x.mean(0) - rec).T).trace(), values[2])
    white = np.array([[r[f"pc{i}"] for i in (1, 2, 3)] for r in classify.pca(df, bands, whiten=True)[0].collect()])
    assert np.allclose(np.cov(white.T), np.eye(3))
    a, b = np.cov(x[:50].T), np.cov(x.T)
    lam, v = transforms.generalized_eigen(a, b)
    assert np.allclose(a @ v, b @ v * lam) and np.allclose(v.T @ b @ v, np.eye(3))
    grid = spark.createDataFrame([(i % 15, i // 15, *map(float, r)) for i, r in enumerate(x)], "x int, y int, b1 double, b2 double, b3 double")
    out, lam, snr = transforms.noise_fraction(grid, bands, 15, 10)
    cube = x.reshape(10, 15, 3)
    d = (cube - (np.roll(cube, 1, 0) + np.roll(cube, 1, 1)) / 2).reshape(-1, 3)
    want = np.linalg.eigvals(np.linalg.solve(np.cov(x.T), d.T @ d / (2 * 149)))
    assert np.allclose(sorted(lam), sorted(want.real)) and np.allclose(snr, 1 / lam - 1)
    mnf = np.array([[r[f"mnf{i}"] for i in (1, 2, 3)] for r in out.collect()])
    assert np.allclose(np.cov(mnf.T), np.eye(3))


def test_kernels(spark, cloud):
    x, df = cloud
    bands = ["b1", "b2", "b3"]
    g = transforms.kernel(np.array([[5.0, 1, 3, 1], [7, 1, 11, 4], [0, 4, 2, 9]]), np.array([[5.0, 1, 3, 1], [7, 1, 11, 4], [0, 4, 2, 9]]), "gaussian", sigma=10)
    assert np.allclose(g[0], [1, 0.68045064, 0.60957091]) and np.allclose(transforms.centred(g, g)[0], [0.19119746, -0.07197215, -0.11922531])
    out, values = transforms.kernel_pca(df, df.orderBy("id"), bands, 2)
    p = np.array([[r["kpc1"], r["kpc2"]] for r in out.orderBy("id").collect()])
    assert np.allclose((p * p).sum(0), values[:2])
    assert transforms.kernel_rx(df, df, bands).filter("krx >= 0").count() == 150
    labels = [r["cluster"] for r in transforms.kernel_kmeans(df, df.orderBy("id"), bands, 2, 2.0).orderBy("id").collect()]
    assert sum(labels[i] == labels[0] for i in range(80)) > 70 and sum(labels[i] != labels[0] for i in range(80, 150)) > 60


def test_regressions(spark, cloud):
    x, df = cloud
    y = 1 + x @ np.array([2.0, -1.0, 0.5])
    df = spark.createDataFrame([(*map(float, r), float(v), float(r[0])) for r, v in zip(x, y)], "b1 double, b2 double, b3 double, y double, copy double")
    beta = lambda d: {r["name"]: r["beta"] for r in d.collect()}
    got = beta(regress.least_squares(df, ["b1", "b2", "b3"], "y"))
    assert np.allclose([got["b1"], got["b2"], got["b3"], got["intercept"]], [2, -1, 0.5, 1])
    twice, _, rank = moments.multiple_regression(df, ["b1", "copy", "b2", "b3"], "y")
    assert rank == 3 and np.allclose(twice, [1, 1, -1, 0.5])
    # Conditions of the elastic net's optimum on the standardized scale.
    net = beta(regress.elastic_net(df, ["b1", "b2", "b3"], "y", 0.4, 0.1))
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    w = np.array([net["b1"], net["b2"], net["b3"]]) * x.std(0, ddof=1)
    g = z.T @ (y - y.mean() - z @ w) / len(x) - 0.1 * w
    assert np.allclose(g[w != 0], 0.4 * np.sign(w[w != 0]), atol=1e-6) and (np.abs(g[w == 0]) <= 0.4 + 1e-6).all()
    path = regress.least_angles(df, ["b1", "b2", "b3"], "y").filter("step = 3").collect()
    unit = (x - x.mean(0)) / np.linalg.norm(x - x.mean(0), axis=0)
    assert np.allclose([r["beta"] for r in path], np.linalg.lstsq(unit, y - y.mean(), rcond=None)[0])
    pls = beta(regress.partial_least_squares(df, ["b1", "b2", "b3"], "y", 3))
    assert np.allclose([pls["b1"], pls["b2"], pls["b3"]], [2, -1, 0.5])
    q = regress.gram_schmidt(np.array([[1.0, 1, 2], [0, 1, 0], [1, 0, 2]]))
    assert np.allclose(q.T @ q, np.diag(np.diag(q.T @ q))) and np.allclose(q[:, 2], 0)


def test_discriminants_and_separability(spark, cloud):
    x, df = cloud
    axes, share = regress.discriminant_axes(df, ["b1", "b2", "b3"], "cls")
    z = (x @ axes)[:, 0]
    assert axes.shape == (3, 1) and 0.7 < share[0] < 1 and (z[:80].max() < z[80:].min() + 2 or z[:80].min() > z[80:].max() - 2)
    assert 1.5 < moments.separability(df, ["b1", "b2", "b3"], "cls").first()["jm"] <= 2


def test_learners(spark, cloud):
    x, df = cloud
    bands = ["b1", "b2", "b3"]
    right = lambda d: d.filter("pred = cls").count()
    train = df.withColumn("p", F.col("cls") == "a")
    assert right(learn.class_tree(df, bands, "cls")) == 150
    assert right(learn.boosted_trees(df, bands, "cls", 10)[0]) >= 148
    assert right(learn.neural_network(df, df, bands, "cls", 5, 100)) >= 147
    assert learn.parzen(df, train, bands, "p", 2.0).filter("pred = (cls = 'a')").count() >= 145
    assert learn.kernel_adatron(df, train, bands, "p", 2.0).filter("pred = (cls = 'a')").count() >= 148
    out, w, bias, turns = learn.perceptron(df, bands, F.col("cls") == "a", 0.5, 0.02, 2000)
    assert out.filter("pred = (cls = 'a')").count() >= 0.98 * 150 or turns == 2000


def test_clusterings(spark, cloud):
    x, df = cloud
    start = cluster.farthest_first(df, ["b1", "b2", "b3"], 2, "id")
    out, centres, turns = cluster.kmeans(df, ["b1", "b2", "b3"], start)
    for _ in range(turns):
        d = ((x[:, None] - np.array(start)) ** 2).sum(2).argmin(1)
        start = [x[d == k].mean(0) for k in range(2)]
    assert np.allclose(centres, start) and out.count() == 150
    px = df.select("b1", "b2")
    u = df.select("b1", "b2", F.when(F.col("cls") == "a", 0.9).otherwise(0.1).alias("u1")).withColumn("u2", 1 - F.col("u1"))
    mixed, model, turns = cluster.gaussian_mixture(px, ["b1", "b2"], u, 2)
    assert turns >= 10 and abs(sum(w for w, _, _ in model) - 1) < 1e-9 and abs(model[0][1][0]) < 0.5
    for method in ("ward", "single", "complete", "average", "weighted", "centroid", "median"):
        labels = cluster.cut(cluster.linkage(x[[0, 1, 2, 90, 91, 92]], method), 2)
        assert labels.tolist() == [1, 1, 1, 2, 2, 2], method
    heights = cluster.linkage(np.array([[0.0], [1.0], [5.0]]), "ward")[:, 2]
    assert np.allclose(heights, [1.0, math.sqrt(2 * 2 * 1 / 3 * 4.5**2)])


def test_annealed_and_spatial_mixture(spark):
    rng = np.random.default_rng(5)
    data = [(i, i % 12, i // 12, float(rng.normal(0 if i % 12 < 6 else 5, 1))) for i in range(144)]
    df = spark.createDataFrame(data, "id long, x int, y int, b double")
    u = F.when(F.col("b") < 2.5, 0.8).otherwise(0.2)
    out, _, _ = cluster.gaussian_mixture(df, ["b"], df.withColumn("u1", u).withColumn("u2", 1 - u), 2, "id", temperature=0.5, beta=1.0, rounds=12)
    got = cluster.hardened(out.select("id", "x", "u1", "u2"), 2).collect()
    assert sum((r["cluster"] == 1) == (r["x"] < 6) for r in got) >= 140 and all(0 <= r["b1"] <= 255 for r in got)


def test_polarimetric_filters_and_looks(spark):
    rng = np.random.default_rng(6)
    looks = 5
    z = (rng.normal(size=(400, looks, 2)) + 1j * rng.normal(size=(400, looks, 2))) / math.sqrt(2)
    c = np.einsum("nla,nlb->nab", z, z.conj()) / looks
    data = [(i % 20, i // 20, float(m[0, 0].real), float(m[0, 1].real), float(m[0, 1].imag), float(m[1, 1].real)) for i, m in enumerate(c)]
    grid = spark.createDataFrame(data, "x long, y long, c1 double, c2 double, c3 double, c4 double")
    bands = ["c1", "c2", "c3", "c4"]
    enl = [r["enl"] for r in radar.equivalent_looks(grid, bands).collect()]
    assert len(enl) == 14 * 14 and 4 < np.median(enl) < 6.5
    for out in (radar.mmse(grid, bands, looks), radar.gamma_map(grid, ["c1", "c4"], looks)):
        rows = {(r["x"], r["y"]): r for r in out.collect()}
        assert len(rows) == 400 and rows[0, 0]["c1"] == data[0][2]
        inner = [rows[x, y]["c1"] for x in range(3, 17) for y in range(3, 17)]
        assert np.std(inner) < 0.8 * np.std([d[2] for d in data])


def test_omnibus_of_nine_bands(spark):
    rng = np.random.default_rng(7)
    n = 6.0

    def looks(scale):
        z = (rng.normal(size=(int(n), 3)) + 1j * rng.normal(size=(int(n), 3))) / math.sqrt(2) * scale
        return z.T @ z.conj() / n

    names = [f"v{i}" for i in range(9)]
    data = []
    for pix in range(60):
        for t in range(1, 4):
            m = looks(3.0 if t == 3 and pix < 30 else 1.0)
            data.append((pix, t, *map(float, (m[0, 0].real, m[0, 1].real, m[0, 1].imag, m[0, 2].real, m[0, 2].imag, m[1, 1].real, m[1, 2].real, m[1, 2].imag, m[2, 2].real))))
    arrays = change.series_arrays(spark.createDataFrame(data, "pix int, t int, " + ", ".join(f"{b} double" for b in names)), 3, value=names)
    tests = change.with_q(change.omnibus(arrays, 3, n, bands=names), 3, n, 9)
    maps = {r["pix"]: r for r in change.change_maps(tests, 0.01, k=3).collect()}
    assert sum(maps[p]["cmap"] == 2 and maps[p]["bmap"] == [0, 255] for p in range(30)) >= 28
    assert sum(maps[p]["fmap"] == 0 for p in range(30, 60)) >= 27


def test_intervals_and_tests(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(10, 2, 200)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, v double")
    r = sampling.mean_interval(df, "v").first()
    assert r["low"] < x.mean() < r["high"] and r["var_low"] < x.var(ddof=1) < r["var_high"]
    assert abs(r["var_low"] - 199 * x.var(ddof=1) / 239.9597) < 0.01
    t = sampling.variance_test(df, "v", F.col("id") < 100).first()
    assert t["f"] >= 1 and 0 < t["p"] <= 1
    b = sampling.bootstrap_mean(df, "id", "v", 400).first()
    assert abs(b["low"] - r["low"]) < 0.1 and abs(b["high"] - r["high"]) < 0.1
    fits = spark.createDataFrame([("a", 0.5, 1.2, 100)], "band string, t double, f double, n_test long")
    p_t, p_f = change.normalization_p_values(fits)["a"]
    assert abs(p_t - 0.6176) < 1e-3 and 0.15 < p_f < 0.2


# ------------------------------------------------------------- files


def test_files(spark, tmp_path):
    import struct

    header = files.parse_header("ENVI\nsamples = 3\nlines = 2\nbands = 2\ndata type = 2\ninterleave = bil\nband names = {\n red, near\n infrared}\nsigma = {1, 2}\n")
    assert header["band names"] == ["red", "near\n infrared"] and header["fwhm"] == ["1", "2"]
    assert files.parse_header(files.header_text(header))["samples"] == "3"
    cube = np.arange(12, dtype="<i2").reshape(2, 2, 3)  # lines, bands, samples
    (tmp_path / "image").write_bytes(cube.tobytes())
    got = {(r["x"], r["y"]): (r["b1"], r["b2"]) for r in files.read_raster(spark, str(tmp_path / "image"), header).collect()}
    assert got == {(x, y): (float(cube[y, 0, x]), float(cube[y, 1, x])) for x in range(3) for y in range(2)}
    df = spark.createDataFrame([(x, y, float(x + 10 * y), 1.0) for x in range(5) for y in range(7)], "x long, y long, b1 double, b2 double")
    head = files.write_raster(df, str(tmp_path / "out"), ["b1", "b2"], 5, 7, rows=3)
    assert sorted(files.read_strips(spark, str(tmp_path / "out"), head, 3).collect()) == sorted(df.collect())

    (tmp_path / "points").write_text("; a comment\n1 2 3 4\n\n5.5 6 7 8\n")
    assert [tuple(r) for r in files.read_control_points(spark, str(tmp_path / "points")).collect()] == [(1, 2, 3, 4), (5.5, 6, 7, 8)]
    rows = spark.createDataFrame([(1, 2), (3, 3)], "pred int, label int")
    lines = [r["value"] for r in files.prediction_text(rows, "test", 3).orderBy("i").collect()]
    (tmp_path / "list").write_text("\n".join(lines) + "\n")
    assert sorted(map(tuple, files.read_predictions(spark, str(tmp_path / "list")).collect())) == [(1, 2), (3, 3)]

    ring = [(0.0, 0.0), (0.0, 100.0), (100.0, 100.0), (100.0, 0.0), (0.0, 0.0)]
    hole = [(20.0, 20.0), (80.0, 20.0), (80.0, 80.0), (20.0, 80.0), (20.0, 20.0)]
    body = struct.pack("<i4d2i2i", 5, 0, 0, 100, 100, 2, 10, 0, 5) + b"".join(struct.pack("<2d", *p) for p in ring + hole)
    (tmp_path / "a.shp").write_bytes(bytes(100) + struct.pack(">2i", 1, len(body) // 2) + body)
    fields = b"".join(n.ljust(11, b"\0") + b"C" + bytes(4) + bytes([w]) + bytes(15) for n, w in ((b"CLASS_ID", 4), (b"CLASS_NAME", 8)))
    (tmp_path / "a.dbf").write_bytes(struct.pack("<4BIHH", 3, 0, 0, 0, 1, 32 + len(fields) + 1, 13) + bytes(20) + fields + b"\r" + b" 2   water   ")
    shapes = files.read_polygons(spark, str(tmp_path / "a.shp"), str(tmp_path / "a.dbf"))
    pixels = spark.createDataFrame([(float(x), float(y)) for x in range(-5, 106, 5) for y in range(-5, 106, 5)], "x double, y double")
    inside = {(r["x"], r["y"]) for r in files.pixels_in_polygons(pixels, shapes).collect()}
    want = {(x, y) for x in range(-5, 106, 5) for y in range(-5, 106, 5) if 0 <= x < 100 and 0 <= y < 100 and not (20 <= x < 80 and 20 <= y < 80)}
    assert inside == want and shapes.first()["class_id"] == 2 and shapes.first()["class_name"] == "water"


@pytest.mark.parametrize("name", ["image_algebra", "rgb_to_hsv"])
def test_means_in_the_order_of_the_files(spark, tmp_path, name):
    """Means of 0.05 in truth, whose last digits hang on the order of the sum."""
    rng = np.random.default_rng(8)
    rows = []
    for x in range(200):
        half = rng.integers(0, 6, 8)
        hundredths = np.concatenate([half, 10 - half])
        rows += [(i, x, 25.0, float(d) / 100, float(t) / 100) for i, (d, t) in enumerate(zip(rng.permutation(hundredths), rng.permutation(hundredths)))]
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute("CREATE TABLE t (i INT, x BIGINT, q DOUBLE, d DOUBLE, t DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", rows)
    (tmp_path / "lineitem.parquet").mkdir()
    for part, where in enumerate(("i < 2", "i BETWEEN 2 AND 7", "i BETWEEN 8 AND 10", "i > 10")):
        con.execute(f"COPY (SELECT x AS l_suppkey, TIMESTAMP '1996-02-03' AS l_shipdate, q AS l_quantity, q AS l_extendedprice, d AS l_discount, t AS l_tax FROM t WHERE {where} ORDER BY x, i) TO '{tmp_path}/lineitem.parquet/part-{part}.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    rel = con.sql(registry.SQL[name])
    got, want = registry.QUERIES[name](spark, str(tmp_path)).select(*rel.columns).collect(), rel.fetchall()
    assert len(got) == len(want) == 200
    assert [(tuple(a), b) for a, b in zip(sorted(got), sorted(want)) if not all(map(same, a, b))] == []


@pytest.mark.parametrize("name, f, places", [("gamma_map_filter", radar.gamma_map, 4), ("mmse_filter", radar.mmse, 6)])
def test_filters_of_equal_edges_and_even_windows(spark, name, f, places):
    cells = np.random.default_rng(5).integers(1, 4, (50, 50)) / 3
    cells[:20] = np.repeat(np.arange(1, 6), 10) / 7
    rows = [(x + 20, y + 10, float(cells[y, x])) for x in range(50) for y in range(50)]
    con = duckdb.connect()
    con.execute("CREATE TABLE grid (x BIGINT, y BIGINT, b1 DOUBLE)")
    con.executemany("INSERT INTO grid VALUES (?, ?, ?)", rows)
    want = con.sql(registry.SQL[name].replace(registry.A.GRID + ", ", "")).fetchall()
    image = spark.createDataFrame([(x, y, v + 1) for x, y, v in rows], "x long, y long, v double")
    got = registry.rnd(f(image, ["v"], 4.0), places).collect()
    assert len(got) == len(want) == 2500
    assert [(tuple(g), w) for g, w in zip(sorted(got), sorted(want)) if not math.isclose(g[2], w[2], abs_tol=2e-4)] == []


def test_mmse_filter_to_the_last_digit(spark, tmp_path):
    """Means with seven decimals that end in 5, and equal edges whose sums' last digits hang on
    the order of the rows."""
    con = duckdb.connect()
    con.execute("SET threads = 1")
    (tmp_path / "lineitem.parquet").mkdir()
    rng = np.random.default_rng(12)
    x, y = (a.ravel() for a in np.meshgrid(np.arange(20, 70), np.arange(10, 60)))
    scale = rng.choice([1.0, 1.0, 1.0, 1000.0], x.size)
    for part, rows in enumerate((3, 8, 1, 20)):
        cell = rng.permutation(np.repeat(np.arange(x.size), rows))
        lines = pd.DataFrame({"x": x[cell], "y": y[cell], "q": rng.integers(0, 11, cell.size) / 100 * scale[cell]})  # noqa: F841 - read by name
        con.execute(f"COPY (SELECT x AS l_suppkey, TIMESTAMP '1995-01-15' + to_months(y::INTEGER) AS l_shipdate, q AS l_quantity, 1.0::DOUBLE AS l_extendedprice, 0.0::DOUBLE AS l_discount, 0.0::DOUBLE AS l_tax FROM lines) TO '{tmp_path}/lineitem.parquet/part-{part}.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(registry.SQL["mmse_filter"]).fetchall()
    got = registry.QUERIES["mmse_filter"](spark, str(tmp_path)).select("x", "y", "v").collect()
    assert len(got) == len(want) == 2500
    assert [(tuple(a), b) for a, b in zip(sorted(got), sorted(want)) if tuple(a) != b] == []


def test_wavelet_of_a_pure_tone(spark):
    x = np.sin(2 * np.pi * np.arange(128) / 8)
    power = np.abs(series.cwt(x, 1.0, np.array([2.0, 8.0 / 1.033, 30.0])))[:, 40:90].mean(1)
    assert power.argmax() == 1 and all(np.isfinite(series.cwt(x, 1.0, np.array([4.0]), w, p)).all() for w, p in (("paul", 4), ("dog", 2)))
    df = spark.createDataFrame([([float(v) for v in x[:16]],)], "v array<double>")
    d = series.idwt(series.dwt(df, "v", "w", series.D4, 3), "w", "back", series.D4, 3)
    assert np.allclose(d.first()["back"], x[:16])


def test_fits_on_samples(spark, cloud):
    x, df = cloud
    bands = ["b1", "b2", "b3"]
    vectors, variances = fits.leading_component(df, bands, 2)
    values, want = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(variances, values[::-1][:2]) and np.allclose(np.abs((vectors * want[:, ::-1][:, :2]).sum(0)), 1)
    train = df.withColumn("p", F.col("cls") == "a").withColumn("y", F.col("b1") + 2 * F.col("b2"))
    assert fits.kernel_fisher(df, train, bands, "p", 0.1, 3.0).filter("pred = (cls = 'a')").count() >= 147
    fit = fits.kernel_ridge(train, train, bands, "y", 1e-3, 5.0)
    assert fit.agg(F.avg(F.abs(F.col("fit") - F.col("y")))).first()[0] < 0.2
    axis = fits.spectral_regression(df, bands, "cls")[:, 0]
    fisher = regress.discriminant_axes(df, bands, "cls")[0][:, 0]
    assert abs(axis @ fisher) / np.linalg.norm(axis) / np.linalg.norm(fisher) > 0.999
    noisy = df.withColumn("noise", F.pmod(F.col("id") * 7919, F.lit(101)) / 25.0)
    weights = fits.relief_weights(noisy, ["b1", "noise"], "cls")
    assert weights["b1"] > 0.9 > weights["noise"] and fits.eliminate_bands(noisy, ["b1", "noise", "b3"], "cls")[0] == "noise"
    cells = fits.organizing_map(df, df, bands, 2, 500)
    assert cells.groupBy("cell").agg(F.countDistinct("cls").alias("k")).agg(F.avg("k")).first()[0] < 1.5
    out, angle = fits.iterated_pca(spark.createDataFrame([(float(v), float(v + (5 if i % 10 == 0 else 0))) for i, v in enumerate(np.random.default_rng(4).normal(0, 3, 400))], "a double, b double"), "a", "b")
    assert abs(angle - 45) < 4
