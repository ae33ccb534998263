"""Distribution functions, golden values and invariances of the methods."""

from __future__ import annotations

import itertools
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from canvass import model_queries
from canvass.codebook import Codebook, CodebookError, Design, Group, Variable, score, with_orders
from canvass.functions import dist, expr
from canvass.operators import cluster, conjoint, distribution, efa, factorial, inference, mining, multiresponse, regression, summaries, survey, transform
from canvass.plans.primitives import complete, gram

SF = "/root/testdata/sf0.001"


# --- distribution functions


def test_tails_have_their_closed_forms():
    for x in (0.1, 1.0, 7.5, 40.0):
        assert dist.chi2_sf(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-12)
        assert dist.chi2_sf(x, 4) == pytest.approx(math.exp(-x / 2) * (1 + x / 2), rel=1e-12)
        assert dist.chi2_sf(x, 1) == pytest.approx(2 * dist.norm_sf(math.sqrt(x)), rel=1e-11)
        assert dist.t_sf2(x, 1) == pytest.approx(1 - 2 / math.pi * math.atan(x), rel=1e-9)
        assert dist.f_sf(x, 2, 6) == pytest.approx((1 + 2 * x / 6) ** -3, rel=1e-11)
    for p in (1e-9, 0.01, 0.3, 0.975):
        assert dist.norm_cdf(dist.norm_ppf(p)) == pytest.approx(p, rel=1e-12)
        assert dist.t_sf2(dist.t_ppf(0.9, 7), 7) == pytest.approx(0.2, rel=1e-9)
    for rho in (-0.7, 0.0, 0.5):
        assert dist.bvn_cdf(0, 0, rho) == pytest.approx(0.25 + math.asin(rho) / (2 * math.pi), abs=1e-12)


def test_fisher_adds_up_hypergeometric_terms():
    for t in ([[3, 1], [1, 3]], [[0, 5], [5, 0]], [[8, 2], [1, 5]]):
        (a, b), (c, d) = t
        n, k, m = a + b + c + d, a + b, a + c
        p = lambda i: math.comb(k, i) * math.comb(n - k, m - i) / math.comb(n, m)  # noqa: B023, E731
        want = sum(p(i) for i in range(max(0, m - n + k), min(k, m) + 1) if p(i) <= p(a) * (1 + 1e-7))
        assert dist.fisher_exact(np.array(t)) == pytest.approx(want)


def test_adjusted_p_values():
    assert dist.benjamini_hochberg(np.array([0.01, 0.04, 0.002, 0.5, 0.0, 1.0])).tolist() == pytest.approx([0.02, 0.06, 0.006, 0.6, 0.0, 1.0])


# --- golden values


def test_tests_are_found_by_what_they_declare(spark):
    named = lambda *a: inference.test_for(*a).name
    assert [named("groups", s) for s in ("nominal", "ordinal", "interval", "ratio")] == ["chi_square", "mann_whitney", "welch_t", "welch_t"]
    assert [named("groups", s, 4) for s in ("nominal", "ordinal", "ratio")] == ["chi_square", "kruskal", "welch_anova"]
    assert [named("pair", s) for s in ("nominal", "ordinal", "interval")] == ["chi_square", "kendall_tau_b", "pearson"]
    for bad in (("trio", "ordinal"), ("groups", "text"), ("groups", "ordinal", 1)):
        with pytest.raises(CodebookError):
            inference.test_for(*bad)
    rows = [(i, "abc"[i % 3], "uv"[i % 2], float(i * 7 % 11)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, g string, h string, v double")
    two, more = inference.run_test(df, "h", "v", "ordinal"), inference.run_test(df, "g", "v", "ordinal")
    assert (two["method"], more["method"], more["groups"]) == ("mann_whitney", "kruskal", 3)
    assert two["u"] == inference.mann_whitney(df, "h", "v", "u", "v")["u"] and more["df"] == 2
    for x, y, scale, compares in (("h", "v", "ratio", "groups"), ("g", "v", "ratio", "groups"), ("g", "h", "nominal", "groups"), ("id", "v", "ordinal", "pair"), ("id", "v", "ratio", "pair")):
        found = inference.run_test(df, x, y, scale, compares)
        assert found["method"] == inference.test_for(compares, scale, found["groups"]).name and len(found) > 2


def test_permuted_labels_keep_their_numbers(spark):
    rng = np.random.default_rng(3)
    counts = np.array([5, 0, 30, 65])
    drawn = np.array([inference.drawn_without_return(counts, 40, rng) for _ in range(4000)])
    assert (drawn.sum(axis=1) == 40).all() and (drawn <= counts).all()
    assert drawn.mean(axis=0) == pytest.approx(counts * 0.4, abs=0.15)
    assert drawn[:, 3].var() == pytest.approx(40 * 0.65 * 0.35 * 60 / 99, rel=0.1)
    many = inference.drawn_without_return(counts * 10**9, 40 * 10**9, rng)
    assert many.sum() == 40 * 10**9 and many / 10**9 == pytest.approx(counts * 0.4, rel=1e-3)
    rows = [(i % 3, (i % 3) if i < 60 else (i * 5 % 3), i < 60) for i in range(120)]
    found = inference.tau_permutation(spark.createDataFrame(rows, "x int, y int, m boolean"), "x", "y", "m")
    assert found["difference"] > 0.5 and found["p"] < 0.05


def test_correspondence_of_a_two_by_two_table():
    found = factorial.correspondence(np.array([[30.0, 10.0], [10.0, 30.0]]))
    assert found["inertia"] == pytest.approx(0.25)
    assert np.abs(found["rows"]).ravel().tolist() == pytest.approx([0.5, 0.5])


def test_welch_anova_golden():
    groups = [np.arange(1, 6.0), np.arange(4, 9.0), np.arange(0, 70.0, 10)]
    moments = [{"n": len(g), "mean": g.mean(), "var": g.var(ddof=1)} for g in groups]
    r = inference.welch_anova(moments)
    assert (r["f"], r["df1"], r["df2"], r["p"]) == pytest.approx((8.723254, 2, 9.152499, 0.00758064), rel=1e-6)


def test_moments_keep_a_small_spread_of_large_values(spark):
    rows = [("a", 1e9 + i % 2, 1.0 + i % 3) for i in range(40)] + [("b", float(i), 2.0) for i in range(9)] + [("c", 5.0, 1.0), ("c", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, w double")
    plain, weighted = inference.moments_by(df, "g", "x"), inference.moments_by(df, "g", "x", "w")
    for g in "ab":
        x = np.array([r[1] for r in rows if r[0] == g])
        w = np.array([r[2] for r in rows if r[0] == g])
        assert abs(plain[g]["var"] - (x - x[0]).var(ddof=1)) < 1e-7
        d = x - x[0]
        mean = (w * d).sum() / w.sum()
        assert abs(weighted[g]["var"] - (w * (d - mean) ** 2).sum() / (w.sum() - (w * w).sum() / w.sum())) < 1e-6
    assert plain["c"]["n"] == 1 and plain["c"]["var"] is None


def test_conditional_logit_of_large_utilities_and_broken_tasks(spark):
    rng = np.random.default_rng(4)
    rows = [(r, t, 1000.0 + a + rng.random() * 3, False) for r in range(30) for t in range(4) for a in range(3)]
    rows = [(r, t, x, i % 3 == (r + t) % 3) for i, (r, t, x, _) in enumerate(rows)]
    near = spark.createDataFrame([(r, t, x - 1000, c) for r, t, x, c in rows], "respondent int, task int, x double, chosen boolean")
    far = spark.createDataFrame([(r, t, x * 1.0 + 1e5, c) for r, t, x, c in rows], "respondent int, task int, x double, chosen boolean")
    how = ("respondent", "task", "choice", "chosen")
    a, b = (conjoint.conditional_logit(df, {"x": F.col("x")}, *how) for df in (near, far))
    assert np.allclose(a.beta, b.beta, atol=1e-6) and abs(a.nll - b.nll) < 1e-6 and a.n_sets == 120
    holed = near.withColumn("x", F.when((F.col("respondent") == 3) & (F.col("task") == 1) & ~F.col("chosen") & (F.col("x") < 2), None).otherwise(F.col("x")))
    gone = near.where("NOT (respondent = 3 AND task = 1)")
    c, d = (conjoint.conditional_logit(df, {"x": F.col("x")}, *how) for df in (holed, gone))
    assert c.n_sets == 119 and np.allclose(c.beta, d.beta)


def test_conditional_logit_of_one_attribute(spark):
    rows = [(r, 1, a, int((a == "A") == (r != 4))) for r in (1, 2, 3, 4) for a in ("A", "B")]
    df = spark.createDataFrame(rows, "respondent int, task int, brand string, chosen int")
    f = conjoint.conditional_logit(df, conjoint.effect_columns(df, {"brand": ("A", "B")}), "respondent", "task", "choice", "chosen")
    assert (f.beta[0], f.nll, f.hessian[0, 0]) == pytest.approx((math.log(3) / 2, 2.249341, 3.0), rel=1e-6)
    assert (f.model_covariance[0, 0], f.cluster_covariance[0, 0]) == pytest.approx((1 / 3, 4 / 9))


def test_axis_orders_of_a_known_structure():
    r = np.array([[1, 0.9, 0.1], [0.9, 1, 0.2], [0.1, 0.2, 1]])
    names = ["a", "b", "c"]
    best = min(itertools.permutations(range(3)), key=lambda p: (round(sum(1 - abs(r[i, j]) for i, j in zip(p, p[1:], strict=False)), 12), p))
    assert factorial.seriation(r, names) == [names[i] for i in best]
    assert sorted(factorial.axis_order(r, names)) == names


# --- models against plain algebra


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    n = 300
    x = rng.normal(size=(n, 2)) @ np.array([[1, 0.4], [0, 1]])
    y = 1 + x @ [2, -1] + rng.normal(size=n)
    w = rng.integers(1, 5, n)
    z = (y > 1).astype(int)
    rows = [(i, float(x[i, 0]), float(x[i, 1]), float(y[i]), float(w[i]), int(z[i]), "ab"[i % 2], f"p{i % 12}") for i in range(n)]
    return x, y, w, z, spark.createDataFrame(rows, "id long, a double, b double, y double, w double, z int, h string, psu string")


def design(x):
    return np.column_stack([np.ones(len(x)), x])


def test_least_squares_and_hc3(data):
    x, y, w, _, df = data
    m = design(x)
    cols = {"a": F.col("a"), "b": F.col("b")}
    fit = regression.linear_regression(df, "y", cols)
    beta = np.linalg.lstsq(m, y, rcond=None)[0]
    assert fit.beta == pytest.approx(beta, rel=1e-9)
    e = y - m @ beta
    bread = np.linalg.inv(m.T @ m)
    assert fit.covariance == pytest.approx(bread * (e @ e) / (len(y) - 3), rel=1e-8)
    h = np.einsum("ij,jk,ik->i", m, bread, m)
    hc3 = regression.linear_regression(df, "y", cols, covariance="hc3")
    assert hc3.covariance == pytest.approx(bread @ (m * (e / (1 - h))[:, None] ** 2).T @ m @ bread, rel=1e-8)
    got = {r["leverage"] for r in fit.diagnostics().collect()}
    assert sorted(got) == pytest.approx(sorted(h), rel=1e-8)


def test_frequencies_are_repeated_rows(data):
    x, y, w, _, df = data
    cols = {"a": F.col("a"), "b": F.col("b")}
    one = regression.linear_regression(df, "y", cols, "w", "frequency")
    many = regression.linear_regression(df.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("w").cast("int")))), "y", cols)
    assert one.beta == pytest.approx(many.beta) and one.covariance == pytest.approx(many.covariance)


def test_logistic_solves_its_score_equations(data):
    x, _, _, z, df = data
    fit = regression.logistic_regression(df, F.col("z"), {"a": F.col("a"), "b": F.col("b")})
    m = design(x)
    assert m.T @ (z - 1 / (1 + np.exp(-m @ fit.beta))) == pytest.approx(np.zeros(3), abs=1e-6)
    with pytest.raises(CodebookError):
        regression.logistic_regression(df, F.col("z"), {"s": F.col("z") * 2.0})


def test_gram_correlation_and_components(data):
    x, y, _, _, df = data
    m = np.column_stack([x, y])
    g = gram(complete(df, {c: F.col(c) for c in "aby"}), list("aby"))
    assert g.correlation() == pytest.approx(np.corrcoef(m, rowvar=False), rel=1e-9)
    p = factorial.pca(df, list("aby"))
    assert p.eigenvalues == pytest.approx(np.linalg.eigvalsh(np.corrcoef(m, rowvar=False))[::-1], rel=1e-9)
    scores = np.array([list(r) for r in p.scores(df, 3).orderBy("id").select("pc1", "pc2", "pc3").collect()])
    assert np.cov(scores, rowvar=False) == pytest.approx(np.diag(p.eigenvalues), abs=1e-9)


def test_key_driver_shares_add_up(data):
    *_, df = data
    out = regression.key_drivers(df, "y", ["a", "b"])
    assert sum(r["importance"] for r in out) == pytest.approx(out[0]["r2"])


def test_survey_weights_have_no_scale(data):
    *_, df = data
    design_ = Design(weight="w", strata="h", psu="psu")
    results = []
    for k in (1.0, 1000.0):
        scaled = df.withColumn("w", F.col("w") * k)
        frame = survey.design_frame(scaled.withColumn("r", F.col("z").cast("string")).withColumn("c", (F.col("a") > 0).cast("string")), design_, "id")
        results.append((*survey.rao_scott(frame, "r", "c").values(), *survey.mean_covariance(frame, ["y"])[1].ravel()))
    assert results[0] == pytest.approx(results[1], rel=1e-9)
    assert frame.df == 10


def test_factor_model_is_recovered():
    loadings = np.array([[0.8, 0], [0.7, 0], [0.6, 0.1], [0, 0.8], [0.1, 0.7], [0, 0.65]])
    r = loadings @ loadings.T
    np.fill_diagonal(r, 1.0)
    for method in ("uls", "ml"):
        f = efa.extract(r, 2, method)
        assert f.objective == pytest.approx(0, abs=1e-8)
        assert f.uniqueness == pytest.approx(1 - (loadings**2).sum(axis=1), abs=1e-3)
        assert efa.congruence(efa.varimax(f).loadings, loadings)[1] == pytest.approx([1, 1], abs=0.02)
    assert 0.5 < efa.kmo(r) < 1 and efa.bartlett(r, 100)["df"] == 15
    p = efa.promax(f)
    assert p.loadings @ p.phi @ p.loadings.T + np.diag(p.uniqueness) == pytest.approx(r, abs=1e-4)


def test_assignments_are_the_best_of_all():
    rng = np.random.default_rng(11)
    for q in range(1, 7):
        for _ in range(20):
            gain = rng.random((q, q)).round(1)
            best = max(sum(gain[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(q)))
            found = efa.assigned(gain)
            assert sorted(found) == list(range(q)) and sum(gain[i, j] for i, j in enumerate(found)) == pytest.approx(best)
    assert sorted(efa.assigned(rng.random((60, 60)))) == list(range(60))


def test_solutions_are_aligned_and_judged():
    loadings = np.array([[0.8, 0.05], [0.7, 0.0], [0.65, 0.1], [0.0, 0.8], [0.1, 0.7], [0.05, 0.6]])
    r = loadings @ loadings.T
    np.fill_diagonal(r, 1.0)
    a = efa.Factors(loadings, np.array([[1.0, 0.2], [0.2, 1.0]]), 1 - (loadings**2).sum(axis=1), 0.0, "admissible")
    turned = efa.Factors(loadings[:, ::-1] * [-1, 1], np.array([[1.0, -0.2], [-0.2, 1.0]]), a.uniqueness, 0.0, "admissible")
    found = efa.align(a, turned)
    assert found.order == [1, 0] and found.signs.tolist() == [1.0, -1.0] and found.clear
    assert found.loadings == pytest.approx(loadings) and found.phi == pytest.approx(a.phi) and found.gap > 1
    assert efa.sensitivity(r, a, r, turned, (2, 2))["verdict"] == "small"
    assert efa.sensitivity(r, a, r, turned, (2, 3))["verdict"] == "method_sensitive"
    moved = loadings.copy()
    moved[2] = [0.1, 0.65]
    other = efa.Factors(moved, a.phi, a.uniqueness, 0.0, "admissible")
    assert efa.sensitivity(r, a, r, other)["changed"] == [2] and efa.sensitivity(r, a, r, other)["verdict"] == "method_sensitive"
    near = efa.Factors(np.array([[0.6, 0.55]] * 6), np.eye(2), a.uniqueness, 0.0, "admissible")
    assert not efa.align(a, near).clear and efa.sensitivity(r, a, r, near)["verdict"] == "indeterminate"
    single = efa.Factors(loadings[:, :1], np.eye(1), a.uniqueness, 0.0, "admissible")
    assert efa.sensitivity(r, a, r, single)["verdict"] == "method_sensitive" and efa.align(single, single).gap is None
    assert efa.definite(np.array([[0.5, 0.45], [0.5, 0.2], [0.3, 0.1]])) == [None, 0, None]


def test_polychoric_of_a_normal_table():
    rho, cuts = 0.5, [-math.inf, -0.3, 0.8, math.inf]
    c = np.array([[dist.bvn_cdf(a, b, rho) for b in cuts] for a in cuts])
    assert efa.polychoric((c[1:, 1:] - c[:-1, 1:] - c[1:, :-1] + c[:-1, :-1]) * 10_000) == pytest.approx(rho, abs=1e-3)


def test_ranks_and_tests_match_plain_counts(data):
    x, y, _, z, df = data
    r = inference.mann_whitney(df, "h", "y", "a", "b")
    a, b = y[::2], y[1::2]
    assert r["u"] == sum((i > j) + 0.5 * (i == j) for i in a for j in b)
    t = df.withColumn("k", F.round("a")).withColumn("m", F.round("b"))
    got = inference.kendall_tau_b(t, "k", "m").first()
    k, m = np.round(x[:, 0]), np.round(x[:, 1])
    s = np.sign(k[:, None] - k) * np.sign(m[:, None] - m)
    assert (got["c"], got["d"]) == ((s > 0).sum() / 2, (s < 0).sum() / 2)


def test_medoids(spark):
    points = [(i, float(c * 10 + (i % 5) * 0.1), float(c * 7)) for c in range(3) for i in range(c * 10, c * 10 + 10)]
    df = spark.createDataFrame(points, "id long, x double, y double").withColumn("true", (F.col("id") / 10).cast("int"))
    assert cluster.same_partition(cluster.kmedoids(df, ["x", "y"], 3, "id"), "cluster", "true")
    assert min(r["silhouette"] for r in cluster.silhouette(df, ["x", "y"], "true", "id").collect()) > 0.9


@pytest.mark.parametrize("metric, block", [("euclidean", 4096), ("cityblock", 23)])
def test_medoids_are_those_of_all_rows(spark, metric, block):
    rng = np.random.default_rng(5)
    p, k = rng.normal(size=(70, 2)).round(3), 3
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "id long, x double, y double")
    d = np.abs(p[:, None] - p[None]).sum(axis=2) if metric == "cityblock" else np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    medoids: list[int] = []
    for _ in range(k):
        medoids.append(min(range(70), key=lambda c: d[:, [*medoids, c]].min(axis=1).sum()))
    while True:
        options = [[c if j == i else m for j, m in enumerate(medoids)] for i in range(k) for c in range(70)]
        best = min(options, key=lambda o: d[:, o].min(axis=1).sum())
        if d[:, best].min(axis=1).sum() >= d[:, medoids].min(axis=1).sum() - 1e-9:
            break
        medoids = best
    got = {r["id"]: r["cluster"] for r in cluster.kmedoids(df, ["x", "y"], k, "id", metric, block=block).collect()}
    assert got == dict(enumerate(d[:, medoids].argmin(axis=1).tolist()))
    few = {r["id"]: r["cluster"] for r in cluster.kmedoids(df, ["x", "y"], k, "id", metric, candidates=10, block=block).collect()}
    assert len(few) == 70 and set(few.values()) <= {0, 1, 2}
    assert cluster.kmedoids(df.where("id < 2"), ["x", "y"], k, "id").count() == 2
    assert cluster.kmedoids(df.limit(0), ["x", "y"], k, "id").count() == 0


@pytest.mark.parametrize("block", [9, 4096])
def test_outlier_factors_do_not_depend_on_blocks(spark, block):
    rng = np.random.default_rng(8)
    points = np.vstack([rng.normal(size=(45, 2)).round(1), [[9.0, 9.0]], np.zeros((4, 2))])  # one far away, four alike
    n, k = len(points), 5
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    near = [sorted((j for j in range(n) if j != i), key=lambda j: (d[i, j], j))[:k] for i in range(n)]
    density = [1 / (np.mean([max(d[i, j], d[j, near[j][-1]]) for j in near[i]]) + 1e-10) for i in range(n)]
    want = {i: np.mean([density[j] for j in near[i]]) / density[i] for i in range(n)}
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "id long, x double, y double")
    got = {r["id"]: r for r in cluster.local_outlier_factor(df, ["x", "y"], "id", k=k, block=block).collect()}
    assert {i: r["lof"] for i, r in got.items()} == pytest.approx(want)
    cut = np.quantile(list(want.values()), 0.95)
    assert {i for i, r in got.items() if r["outlier"]} == {i for i, v in want.items() if v > cut}
    assert 45 in {i for i, r in got.items() if r["outlier"]}
    if block == 9:
        assert [r["lof"] for r in cluster.local_outlier_factor(df.limit(1), ["x", "y"], "id").collect()] == [1.0]
        assert cluster.local_outlier_factor(df.limit(0), ["x", "y"], "id").collect() == []


def test_silhouettes_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(60, 2)).round(1)
    which = [9 if i == 0 else i % 3 for i in range(60)]  # one cluster has a single row
    df = spark.createDataFrame([(i, float(a), float(b), which[i]) for i, (a, b) in enumerate(points)] + [(60, 0.0, 0.0, None)], "id long, x double, y double, c int")
    want = {}
    for i in range(60):
        far = {c: [float(np.hypot(*(points[i] - points[j]))) for j in range(60) if which[j] == c and j != i] for c in set(which)}
        if not far[which[i]]:
            want[i] = 0.0
            continue
        a, b = np.mean(far[which[i]]), min(np.mean(v) for c, v in far.items() if c != which[i])
        want[i] = (b - a) / max(a, b)
    for block in (7, 4096):
        got = {r["id"]: r["silhouette"] for r in cluster.silhouette(df, ["x", "y"], "c", "id", block=block).collect()}
        assert got == pytest.approx(want)
    assert cluster.silhouette(df.limit(0), ["x", "y"], "c", "id").collect() == []
    assert {r["silhouette"] for r in cluster.silhouette(df.where("c = 1"), ["x", "y"], "c", "id").collect()} == {0.0}


# --- codebook, expressions, several answers


def test_codebook_round_trip_and_rules(spark):
    book = Codebook((Variable("q", "ordinal", order=("1", "2", "3"), missing_codes=("9",), is_reversed=True),), (Group("g", ("a", "b")),)).validate()
    assert Codebook.from_json(book.to_json()) == book
    df = spark.createDataFrame([(1.0,), (3.0,), (9.0,), (None,), (float("nan"),)], "q double")
    assert [r[0] for r in df.select(score(df, book["q"])).collect()] == [3.0, 1.0, None, None, None]
    open_ = with_orders(df, Codebook((Variable("q", "ordinal", missing_codes=("9",)),)))
    assert open_["q"].order == ("1", "3")
    with pytest.raises(CodebookError):
        Codebook((Variable("x", "interval", is_reversed=True),)).validate()
    with pytest.raises(CodebookError):
        score(df, Variable("q", "ordinal"))


@pytest.mark.parametrize("a, b, want", [(1, 0, "valid"), (0, 0, "valid"), (98, 98, "notApplicable"), (99, 99, "missing"), (1, 99, "partial"), (98, 99, "invalid"), (98, 1, "invalid"), (2, 0, "invalid"), (None, 1, "partial")])
def test_states_of_several_answers(spark, a, b, want):
    g = Group("g", ("a", "b"), not_applicable=("98",), missing=("99",))
    df = spark.createDataFrame([(a, b)], "a int, b int")
    assert multiresponse.classified(df, g).first()["status"] == want


def test_expressions_follow_python_and_refuse_the_rest(spark):
    values = [(-7.0, 2.0), (7.0, -3.0), (5.5, 2.0)]
    df = spark.createDataFrame(values, "x double, y double")
    for text in ("x // y", "x % y", "x ** 2 - y", "x if x > 0 else y", "1 < x <= 6", "abs(x) + clip(y, 0, 1)", "not (x > 0 and y > 0)"):
        got = [r[0] for r in df.select(expr.compiled(df, text)).collect()]
        names = {"abs": abs, "clip": lambda v, a, b: min(max(v, a), b)}
        assert got == pytest.approx([eval(text, names, {"x": x, "y": y}) for x, y in values])  # noqa: S307
    assert df.select(expr.compiled(df, "x / 0")).first()[0] is None
    for bad in ("__import__('os')", "x.real", "z + 1", "[x]", "lambda: 1", "x +", "sin(x, y, 1)", "open('f')"):
        with pytest.raises(expr.ExpressionError):
            expr.compiled(df, bad)


def test_shapiro_of_normal_scores(spark):
    rows = [(dist.norm_ppf((i - 0.5) / 50),) for i in range(1, 51)]
    w, p = distribution.shapiro_wilk(spark.createDataFrame(rows, "v double"), "v")
    assert w > 0.98 and p > 0.5
    w, p = distribution.shapiro_wilk(spark.createDataFrame([(math.exp(3 * v),) for (v,) in rows], "v double"), "v")
    assert w < 0.6 and p < 1e-6


def test_summaries_of_empty_and_constant_columns(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None)], "a double, b double")
    a, b = summaries.numeric_summary(df, ["a", "b"]).collect()
    assert (a["n"], a["std"], b["n"], b["mean"]) == (2, 0.0, 0, None)
    assert summaries.correlation_pairs(df.withColumn("c", F.lit(2.0)), ["a", "c"]).first()["r"] is None


def test_rules_are_found_and_verified(spark):
    rows = [(i, "ab"[i % 2], "xyz"[i % 3], float(i % 7) + (20 if i % 6 == 1 else 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, g string, h string, y double")
    best = mining.discover(df, F.col("y"), ["g", "h"])[0]
    assert {c[2] for c in best["rule"]} == {"b", "y"}
    found = mining.verify(df, F.col("y"), {best["rule"]: (F.col("g") == "b") & (F.col("h") == "y")}, F.col("id") % 2 == F.col("id") % 2).collect()
    assert found[0]["status"] == "replicated" and found[0]["effect"] == pytest.approx(best["effect"])


def test_knn_imputation_takes_the_nearest_of_all_donors(spark):
    n, step = 9000, 10
    rng = np.random.default_rng(3)
    x, u = rng.normal(size=n), np.round(rng.normal(size=n), 1)
    y = np.sin(3 * x) + u
    rows = [(i, None if i % step == 0 else float(y[i]), float(x[i]), None if i % 97 == 0 else float(u[i])) for i in range(n)]
    df = spark.createDataFrame([*rows, rows[0]], "id long, y double, x double, u double")
    all_rows = [*rows, rows[0]]
    cols = [np.array([np.nan if r[j] is None else r[j] for r in all_rows]) for j in (2, 3)]
    z = np.column_stack([np.nan_to_num((c - np.nanmean(c)) / np.nanstd(c)) for c in cols])
    has = np.array([r[1] is not None for r in all_rows])
    given = np.array([r[1] for r in all_rows if r[1] is not None])
    want = []
    for r, at in zip(all_rows, z, strict=True):
        if r[1] is None:
            d = np.sqrt(((z[has] - at) ** 2).sum(axis=1))
            near = np.argsort(d, kind="stable")[:5]
            w = 1 / (d[near] + 1e-9)
            want.append((r[0], float((w * given[near]).sum() / w.sum())))
    for blocks in ({}, {"donor_block": 700, "query_block": 300}):
        out = transform.fill_knn(df, "y", ["x", "u"], "id", **blocks).collect()
        assert len(out) == len(all_rows)
        got = sorted((r["id"], r["y"]) for r in out if r["id"] % step == 0)
        assert [i for i, _ in got] == sorted(i for i, _ in want)
        assert [v for _, v in got] == pytest.approx([v for _, v in sorted(want)], rel=1e-6)


def test_parallel_analysis_permutes_all_rows(spark):
    n, p = 6000, 3
    x = np.random.default_rng(8).normal(size=(n, p))
    names = [f"c{i}" for i in range(p)]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, c0 double, c1 double, c2 double")
    for block in (700, 100_000):
        got = efa.permuted(df, names, "id", range(3, 5), 42, n, block).toPandas()
        for _, g in got.groupby("r"):
            assert sorted(g["at"]) == list(range(1, n + 1))
            assert all(np.array_equal(np.sort(g[c]), np.sort(x[:, i])) for i, c in enumerate(names))
            assert abs(np.corrcoef(g.sort_values("at")["c0"], x[:, 0])[0, 1]) < 0.06
    rng = np.random.default_rng(1)
    want = np.quantile([np.linalg.eigvalsh(np.corrcoef(rng.permuted(x, axis=0), rowvar=False))[::-1] for _ in range(500)], 0.95, axis=0)
    observed, reference, _ = efa.parallel(df, names, "id", replicates=100, job_rows=1_000_000)
    assert observed == pytest.approx(np.linalg.eigvalsh(np.corrcoef(x, rowvar=False))[::-1])
    assert reference[0] - 1 == pytest.approx(want[0] - 1, rel=0.2)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
def test_queries_verify_all_rules_and_draw_all_permutations(spark):
    segments = spark.read.parquet(f"{SF}/customer.parquet").select("c_mktsegment").distinct().count()
    assert model_queries.rule_verification(spark, SF).select("rule").distinct().count() == segments > 3
    (r,) = model_queries.tau_permutation(spark, SF).collect()
    assert r["p"] * 201 == pytest.approx(round(r["p"] * 201), abs=1e-9)
