"""Queries for selections, inference, models, clusters, mining and conjoint; registered beside those of ``queries``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.codebook import Codebook, Design, Variable
from canvass.functions.columns import signed_noise, wilson
from canvass.operators import (
    categories,
    cluster,
    concepts,
    conjoint,
    discriminant,
    draws,
    efa,
    factorial,
    hierarchy,
    inference,
    mining,
    ranking,
    regression,
    relations,
    selection,
    smoothing,
    survey,
    trees,
)

from canvass.plans.storage import stored
from canvass.queries import _RESPONDENTS, BOOK, query, read, respondents, rounded
from canvass.sources import readers, writers


def small(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A table of results of a model: one row a term, factor or component."""
    return spark.createDataFrame(rows, schema)


# --- selection


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def column_match(spark, sf_dir):
    return selection.column_match(read(spark, sf_dir, "orders"), "o_orderstatus", "P").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (1, 2, 3, 5, 7)")
def scope_filter(spark, sf_dir):
    from canvass.plans.context import scope_rows

    ids = read(spark, sf_dir, "orders").where(F.col("o_orderkey").isin(1, 2, 3, 5, 7)).select("o_orderkey")
    return scope_rows(read(spark, sf_dir, "orders"), ids, "o_orderkey").select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_returnflag = 'R' AND l_discount > 0.05")
def rule_filter(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem")
    rule = (("l_quantity", "between", (10, 20)), ("l_returnflag", "==", "R"), ("l_discount", ">", 0.05))
    return items.where(selection.rule(items, rule)).select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 100")
def range_select(spark, sf_dir):
    return selection.range_of(read(spark, sf_dir, "customer"), "c_custkey", 100, 150).select("c_custkey")


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE contains(lower(c_mktsegment), 'build') ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 5")
def table_view(spark, sf_dir):
    return selection.page(read(spark, sf_dir, "customer"), ["c_mktsegment", "c_acctbal"], "BUILD", "c_acctbal", True, "c_custkey", 5, 20)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 5 AND 15 AND l_tax BETWEEN 0.02 AND 0.04")
def rectangle_hit(spark, sf_dir):
    hit = selection.in_rectangle("l_quantity", "l_tax", 15, 5, 0.02, 0.04)
    return read(spark, sf_dir, "lineitem").where(hit).select("l_orderkey", "l_linenumber")


@query("""
WITH m AS (SELECT *, l_quantity / 50 AS a, l_discount / 0.1 AS b FROM lineitem)
SELECT l_orderkey, l_linenumber FROM m WHERE least(a + (b - a) * 0.25, a + (b - a) * 0.75) <= 0.2 AND greatest(a + (b - a) * 0.25, a + (b - a) * 0.75) >= 0.1
""")
def polyline_hit(spark, sf_dir):
    hit = selection.polyline_crosses(F.col("l_quantity") / 50, F.col("l_discount") / 0.1, 0.25, 0.75, 0.1, 0.2)
    return read(spark, sf_dir, "lineitem").where(hit).select("l_orderkey", "l_linenumber")


@query("""
WITH m AS (SELECT c_custkey, c_nationkey / 24 AS a, (c_acctbal + 1000) / 11000 AS b FROM customer),
t AS (SELECT *, least(greatest((0.4 + (0.5 - a) * (b - a)) / (1 + (b - a) ** 2), 0), 1) AS t FROM m)
SELECT c_custkey, round(sqrt((t - 0.4) ** 2 + (a + (b - a) * t - 0.5) ** 2), 9) AS distance FROM t ORDER BY distance, c_custkey LIMIT 1
""")
def nearest_row(spark, sf_dir):
    axes = [F.col("c_nationkey") / 24, (F.col("c_acctbal") + 1000) / 11000]
    return rounded(selection.nearest_polyline(read(spark, sf_dir, "customer"), axes, 0, 0.4, 0.5, "c_custkey", 1.0), 9, "distance")


@query("SELECT c_custkey FROM customer WHERE (c_nationkey < 5) <> (c_mktsegment = 'BUILDING')")
def selection_toggle(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return selection.combine(c.where("c_nationkey < 5"), c.where("c_mktsegment = 'BUILDING'"), "toggle", "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 2) AND c_mktsegment = 'BUILDING'")
def category_selector(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    pairs = F.array(F.struct(F.lit("nation").alias("variable"), F.col("c_nationkey").cast("string").alias("category")), F.struct(F.lit("segment").alias("variable"), F.col("c_mktsegment").alias("category")))
    members = c.select("c_custkey", F.explode(pairs).alias("m")).select("c_custkey", "m.*")
    return selection.by_categories(members, {"nation": ["1", "2"], "segment": ["BUILDING"]}, True, "c_custkey")


@query("""
WITH s AS (SELECT count(*) FILTER (c_nationkey < 5) AS n_a, count(*) FILTER (c_mktsegment = 'BUILDING') AS n_b, count(*) FILTER (c_nationkey < 5 AND c_mktsegment = 'BUILDING') AS n_both FROM customer)
SELECT *, n_both / (n_a + n_b - n_both) AS jaccard, n_both / least(n_a, n_b) AS overlap FROM s
""")
def set_jaccard(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return selection.jaccard(c.where("c_nationkey < 5"), c.where("c_mktsegment = 'BUILDING'"), "c_custkey")


@query("SELECT CAST(100 AS BIGINT) AS n, CAST(100 AS BIGINT) AS distinct_n")
def sample_exact(spark, sf_dir):
    return selection.sample_exact(read(spark, sf_dir, "customer"), "c_custkey", 100, 3).agg(F.count("*").alias("n"), F.count_distinct("c_custkey").alias("distinct_n"))


@query("SELECT part, CAST(n AS BIGINT) AS n FROM (SELECT 'test' AS part, round(count(*) * 0.3) AS n FROM customer UNION ALL SELECT 'train', count(*) - round(count(*) * 0.3) FROM customer)")
def holdout_split(spark, sf_dir):
    return selection.holdout(read(spark, sf_dir, "customer"), "c_custkey", 0.3).groupBy("part").agg(F.count("*").alias("n"))


@query("SELECT CAST(i AS INTEGER) AS fold, CAST((n - i + 4) // 5 AS BIGINT) AS n FROM (SELECT count(*) AS n FROM customer) CROSS JOIN range(0, 5) r(i)")
def kfold_split(spark, sf_dir):
    return selection.folds(read(spark, sf_dir, "customer"), "c_custkey", 5).groupBy("fold").agg(F.count("*").alias("n"))


# --- survey and inference


@query("""
SELECT count(*) AS n, sum(l_quantity) AS sum_w, round(sum(l_quantity) ** 2 / sum(l_quantity ** 2), 6) AS n_eff, round(stddev_samp(l_quantity) / avg(l_quantity), 6) AS cv,
  round(count(*) * sum(l_quantity ** 2) / sum(l_quantity) ** 2, 6) AS deff FROM lineitem
""")
def weight_diagnostics(spark, sf_dir):
    return rounded(survey.weight_diagnostics(read(spark, sf_dir, "lineitem"), "l_quantity"), 6, "n_eff", "cv", "deff")


DESIGN = Design(strata="c_mktsegment", psu="c_nationkey")


@query(f"""
WITH r AS (SELECT * FROM {_RESPONDENTS}), m AS (SELECT avg(o_totalprice) AS m, count(*) AS n FROM r),
p AS (SELECT c_mktsegment AS h, c_nationkey, sum((o_totalprice - m) / n) AS t FROM r CROSS JOIN m GROUP BY ALL),
k AS (SELECT h, count(*) AS k, var_samp(t) * count(*) AS v FROM p GROUP BY h)
SELECT round((SELECT m FROM m), 2) AS mean, round(sum(v), 2) AS variance, CAST(sum(k - 1) AS BIGINT) AS df FROM k
""")
def taylor_mean_covariance(spark, sf_dir):
    frame = survey.design_frame(respondents(spark, sf_dir), DESIGN, "o_orderkey")
    mean, v = survey.mean_covariance(frame, ["o_totalprice"])
    return small(spark, [(round(float(mean[0]), 2), round(float(v[0, 0]), 2), frame.df)], "mean double, variance double, df long")


@query()
def rao_scott(spark, sf_dir):
    r = survey.rao_scott(survey.design_frame(respondents(spark, sf_dir), DESIGN, "o_orderkey"), "o_orderstatus", "o_orderpriority")
    return small(spark, [(r["f"], r["df1"], r["df2"], r["p"])], "f double, df1 double, df2 double, p double")


@query("""
WITH g AS (SELECT c_mktsegment AS s, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1),
x AS (SELECT a.m - b.m AS d, a.v / a.n AS p, b.v / b.n AS q, a.n AS n, b.n AS k, ((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) AS w FROM g a JOIN g b ON a.s = 'BUILDING' AND b.s = 'MACHINERY')
SELECT round(d, 4) AS difference, round(d / sqrt(p + q), 6) AS t, round((p + q) ** 2 / (p * p / (n - 1) + q * q / (k - 1)), 4) AS df, round(d / sqrt(w), 6) AS cohens_d FROM x
""")
def welch_t(spark, sf_dir):
    g = inference.moments_by(read(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal")
    t = inference.welch_t(g["BUILDING"], g["MACHINERY"])
    d = inference.cohens_d(g["BUILDING"], g["MACHINERY"])
    return small(spark, [(round(t["difference"], 4), round(t["t"], 6), round(t["df"], 4), round(d, 6))], "difference double, t double, df double, cohens_d double")


@query("""
WITH g AS (SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS m, count(*) / var_samp(c_acctbal) AS w FROM customer GROUP BY 1),
t AS (SELECT *, sum(w) OVER () AS s, sum(w * m) OVER () / sum(w) OVER () AS u, count(*) OVER () AS k FROM g),
a AS (SELECT max(k) AS k, sum(w * (m - u) ** 2) / (max(k) - 1) AS f, sum((1 - w / s) ** 2 / (n - 1)) AS l FROM t)
SELECT round(f / (1 + 2 * (k - 2) / (k * k - 1) * l), 6) AS f, CAST(k - 1 AS BIGINT) AS df1, round((k * k - 1) / (3 * l), 4) AS df2 FROM a
""")
def welch_anova(spark, sf_dir):
    a = inference.welch_anova(list(inference.moments_by(read(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal").values()))
    return small(spark, [(round(a["f"], 6), a["df1"], round(a["df2"], 4))], "f double, df1 long, df2 double")


_MARKED = """
WITH x AS (SELECT toxic AS g, n_chars AS v FROM documents JOIN labels USING (doc_id)),
r AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS r FROM x),
s AS (SELECT g, count(*) AS n, sum(r) AS r FROM r GROUP BY g)
"""


def _marked(spark, sf_dir):
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")


@query(_MARKED + """
SELECT a.r - a.n * (a.n + 1) / 2 AS u, round(2 * (a.r - a.n * (a.n + 1) / 2) / (a.n * b.n) - 1, 9) AS cliffs_delta FROM s a JOIN s b ON a.g = 0 AND b.g = 1
""")
def mann_whitney(spark, sf_dir):
    r = inference.mann_whitney(_marked(spark, sf_dir), "toxic", "n_chars", 0, 1)
    return small(spark, [(r["u"], round(r["cliffs_delta"], 9))], "u double, cliffs_delta double")


@query("""
WITH x AS (SELECT c_mktsegment AS g, c_nationkey AS v FROM customer), r AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS r FROM x),
s AS (SELECT g, count(*) AS n, sum(r) AS r FROM r GROUP BY g), t AS (SELECT sum(c ** 3 - c) AS t FROM (SELECT count(*) AS c FROM x GROUP BY v)), n AS (SELECT count(*) AS n FROM x),
h AS (SELECT (12 / (max(n.n) * (max(n.n) + 1)) * sum(r * r / s.n) - 3 * (max(n.n) + 1)) / (1 - max(t) / (max(n.n) ** 3 - max(n.n))) AS h, count(*) - 1 AS df, max(n.n) AS n FROM s CROSS JOIN t CROSS JOIN n)
SELECT round(h, 6) AS h, df, round(h / (n - 1), 9) AS epsilon_squared FROM h
""")
def kruskal_wallis(spark, sf_dir):
    return rounded(rounded(inference.kruskal(read(spark, sf_dir, "customer"), "c_mktsegment", "c_nationkey"), 6, "h"), 9, "epsilon_squared")


@query("""
WITH k AS (SELECT quality AS x, toxic AS y, count(*) AS n FROM labels GROUP BY ALL),
p AS (SELECT sum(CASE WHEN a.y < b.y THEN a.n * b.n ELSE 0 END) AS c, sum(CASE WHEN a.y > b.y THEN a.n * b.n ELSE 0 END) AS d FROM k a JOIN k b ON a.x < b.x),
t AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM k GROUP BY x)) AS tx, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM k GROUP BY y)) AS ty, (SELECT sum(n) * (sum(n) - 1) / 2 FROM k) AS a)
SELECT CAST(c AS BIGINT) AS c, CAST(d AS BIGINT) AS d, round((c - d) / sqrt((a - tx) * (a - ty)), 9) AS tau_b FROM p CROSS JOIN t
""")
def kendall_tau_b(spark, sf_dir):
    return rounded(inference.kendall_tau_b(read(spark, sf_dir, "labels"), "quality", "toxic"), 9, "tau_b")


@query("""
WITH t(test, p) AS (VALUES ('a', 0.01), ('b', 0.04), ('c', 0.002), ('d', 0.5), ('e', 0.03)), r AS (SELECT *, CAST(p AS DOUBLE) * count(*) OVER () / row_number() OVER (ORDER BY p) AS s FROM t)
SELECT test, CAST(p AS DOUBLE) AS p, round(least(min(s) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING), 1), 9) AS q FROM r
""")
def bh_fdr(spark, sf_dir):
    tests = small(spark, [("a", 0.01), ("b", 0.04), ("c", 0.002), ("d", 0.5), ("e", 0.03)], "test string, p double")
    return rounded(inference.benjamini_hochberg(tests), 9, "q")


@query("""
WITH s AS (SELECT c_mktsegment, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS k FROM customer GROUP BY 1), p AS (SELECT *, k / n AS p, 1.96 * 1.96 AS z FROM s)
SELECT c_mktsegment, n, k AS hits, round((p + z / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n), 6) AS low,
  round((p + z / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n), 6) AS high FROM p
""")
def wilson_interval(spark, sf_dir):
    c = read(spark, sf_dir, "customer").withColumn("hit", F.col("c_acctbal") < 0)
    low, high = wilson(F.col("hits"), F.col("n"))
    return inference.proportion_difference(c, "c_mktsegment", "hit").select("c_mktsegment", "n", "hits", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("""
WITH g AS (SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS m, count(*) / var_samp(c_acctbal) AS w FROM customer GROUP BY 1),
t AS (SELECT *, sum(w) OVER () AS s, sum(w * m) OVER () / sum(w) OVER () AS u, count(*) OVER () AS k FROM g),
a AS (SELECT max(k) AS k, sum(w * (m - u) ** 2) / (max(k) - 1) AS f, sum((1 - w / s) ** 2 / (n - 1)) AS l FROM t)
SELECT 'welch_anova' AS method, CAST(k AS INTEGER) AS groups, round(f / (1 + 2 * (k - 2) / (k * k - 1) * l), 6) AS statistic FROM a
UNION ALL SELECT 'pearson', 2, round(corr(c_acctbal, c_nationkey), 6) FROM customer
""")
def chosen_tests(spark, sf_dir):
    """The tests that fit the scales and the number of groups, and what they find."""
    c = read(spark, sf_dir, "customer")
    a, b = inference.run_test(c, "c_mktsegment", "c_acctbal", "ratio"), inference.run_test(c, "c_acctbal", "c_nationkey", "ratio", "pair")
    return small(spark, [(a["method"], a["groups"], round(a["f"], 6)), (b["method"], b["groups"], round(b["r"], 6))], "method string, groups int, statistic double")


@query()
def tau_permutation(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").withColumn("mask", F.col("doc_id") % 2 == 0)
    r = inference.tau_permutation(labels, "quality", "toxic", "mask")
    return small(spark, [(r["difference"], r["p"])], "difference double, p double")


# --- outliers and clusters


@query("""
WITH q AS (SELECT quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.75) AS b FROM part)
SELECT p_partkey FROM part CROSS JOIN q WHERE p_retailprice < a - 0.4 * (b - a) OR p_retailprice > b + 0.4 * (b - a)
""")
def iqr_outliers(spark, sf_dir):
    return cluster.iqr_outliers(read(spark, sf_dir, "part"), ["p_retailprice"], 0.4).where("outlier").select("p_partkey")


@query("""
WITH m AS (SELECT median(c_acctbal) AS m FROM customer), d AS (SELECT median(abs(c_acctbal - m)) AS d FROM customer CROSS JOIN m)
SELECT c_custkey, round(abs(c_acctbal - m) / (1.4826 * d), 6) AS robust_z FROM customer CROSS JOIN m CROSS JOIN d
""")
def robust_z_outliers(spark, sf_dir):
    return rounded(cluster.robust_z_outliers(read(spark, sf_dir, "customer"), ["c_acctbal"]), 6, "robust_z").select("c_custkey", "robust_z")


@query("""SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS cluster FROM customer""")
def class_variable(spark, sf_dir):
    return cluster.class_variable(read(spark, sf_dir, "customer"), "c_mktsegment").select("c_custkey", "cluster")


def _points(spark, sf_dir, k: int = 8) -> tuple[DataFrame, list[str]]:
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(k)))
    return cluster.prepared(e, [f"e{i}" for i in range(k)], "zscore")


@query()
def kmeans(spark, sf_dir):
    rows, _ = cluster.kmeans(*_points(spark, sf_dir), k=10)
    return rows.select("vec_id", "cluster")


@query()
def gaussian_mixture(spark, sf_dir):
    rows, _ = cluster.gaussian_mixture(*_points(spark, sf_dir, 4), k=3)
    return rows.select("vec_id", "cluster")


@query()
def divisive(spark, sf_dir):
    return cluster.divisive(*_points(spark, sf_dir), k=6).select("vec_id", "cluster")


@query()
def kmedoids(spark, sf_dir):
    rows, x = _points(spark, sf_dir)
    return cluster.kmedoids(rows, x, 5, "vec_id").select("vec_id", "cluster")


def _points_sql(k: int) -> str:
    """Standardised points and their distances, as _points has them."""
    return f"""WITH RECURSIVE e AS (SELECT vec_id, label, {", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(k))} FROM embeddings),
m AS (SELECT {", ".join(f"avg(e{i}) AS m{i}, stddev_samp(e{i}) AS s{i}" for i in range(k))} FROM e),
z AS (SELECT vec_id, label, {", ".join(f"(e{i} - m{i}) / s{i} AS z{i}" for i in range(k))} FROM e, m),
d AS (SELECT a.vec_id AS i, b.vec_id AS j, a.label AS c, b.label AS o,
  sqrt({" + ".join(f"(a.z{i} - b.z{i}) ** 2" for i in range(k))}) AS d FROM z AS a, z AS b)"""


_POINTS_SQL = _points_sql(8)


@query()
def agglomerative(spark, sf_dir):
    rows, x = _points(spark, sf_dir, 64)
    return hierarchy.agglomerative(rows, x, "vec_id", 5)[0].select("vec_id", "cluster")


@query(
    f"""{_points_sql(64)},
r AS (SELECT i, i AS j FROM d WHERE i = j UNION SELECT r.i, d.j FROM r JOIN d ON d.i = r.j WHERE d.d <= 9.2)
SELECT i AS vec_id, CAST(dense_rank() OVER (ORDER BY min(j)) - 1 AS INTEGER) AS cluster FROM r GROUP BY i"""
)
def single_linkage_cut(spark, sf_dir):
    rows, x = _points(spark, sf_dir, 64)
    return hierarchy.agglomerative(rows, x, "vec_id", linkage="single", height=9.2)[0].select("vec_id", "cluster")


@query(
    f"""{_POINTS_SQL},
t AS (SELECT i AS vec_id, c, o, count(*) AS n, sum(d) AS s FROM d GROUP BY ALL),
g AS (SELECT vec_id, c, max(CASE WHEN o = c THEN n END) AS own, max(CASE WHEN o = c AND n > 1 THEN s / (n - 1) END) AS a,
  min(CASE WHEN o <> c THEN s / n END) AS b FROM t GROUP BY vec_id, c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster,
  round(CASE WHEN own > 1 AND b IS NOT NULL AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END, 6) AS silhouette FROM g"""
)
def silhouette(spark, sf_dir):
    rows, x = _points(spark, sf_dir)
    return cluster.silhouette(rows, x, "label", "vec_id").withColumn("silhouette", F.round("silhouette", 6))


@query()
def isolation_forest(spark, sf_dir):
    rows, x = _points(spark, sf_dir)
    return cluster.isolation_scores(rows, x, "vec_id").select("vec_id", "isolation", "outlier")


@query(
    f"""{_POINTS_SQL},
n AS (SELECT i, j, d FROM d WHERE i <> j QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 20),
k AS (SELECT i, max(d) AS reach FROM n GROUP BY i),
p AS (SELECT n.i, 1 / (avg(greatest(n.d, k.reach)) + 1e-10) AS p FROM n JOIN k ON k.i = n.j GROUP BY n.i),
f AS (SELECT n.i, avg(q.p) / any_value(p.p) AS lof FROM n JOIN p AS q ON q.i = n.j JOIN p ON p.i = n.i GROUP BY n.i)
SELECT i AS vec_id, round(lof, 6) AS lof, lof > (SELECT quantile_cont(lof, 0.95) FROM f) AS outlier FROM f"""
)
def local_outlier_factor(spark, sf_dir):
    rows, x = _points(spark, sf_dir)
    return cluster.local_outlier_factor(rows, x, "vec_id").withColumn("lof", F.round("lof", 6))


@query()
def disc_clusters(spark, sf_dir):
    return categories.disc(read(spark, sf_dir, "customer"), ["c_acctbal"], ["c_mktsegment", "c_nationkey"], 3, "c_custkey")[0]


@query(
    """
WITH r AS (SELECT o_orderstatus AS a, o_orderpriority AS b FROM orders),
n AS (SELECT a, b, count(*) AS n FROM r GROUP BY a, b),
p AS (SELECT a, b, n / sum(n) OVER (PARTITION BY a) AS s FROM n),
g AS (SELECT x.a, y.a AS b, z.b AS c FROM (SELECT DISTINCT a FROM r) AS x, (SELECT DISTINCT a FROM r) AS y, (SELECT DISTINCT b FROM r) AS z)
SELECT g.a, g.b, round(0.5 * sum(abs(coalesce(p.s, 0) - coalesce(q.s, 0))), 9) AS distance
FROM g LEFT JOIN p ON p.a = g.a AND p.b = g.c LEFT JOIN p AS q ON q.a = g.b AND q.b = g.c GROUP BY g.a, g.b
"""
)
def disc_level_distances(spark, sf_dir):
    """Learned distances of categories before any cluster has rows of its own."""
    orders = read(spark, sf_dir, "orders")
    _, model = categories.disc(orders, [], ["o_orderstatus", "o_orderpriority"], 1, "o_orderkey", rounds=0)
    return rounded(model.table(orders).where("column = 'o_orderstatus'").select("a", "b", "distance"), 9, "distance")


@query()
def cobweb_clusters(spark, sf_dir):
    rows, x = _points(spark, sf_dir, 64)
    return concepts.concept_tree(rows, x, "vec_id", 3, acuity=0.5)[0]


@query("SELECT count(*) AS n FROM customer")
def concept_tree_root(spark, sf_dir):
    """The root concept of numbers and categories has every row."""
    c, x = cluster.prepared(read(spark, sf_dir, "customer"), ["c_acctbal"], "zscore")
    _, tree = concepts.concept_tree(c, x, "c_custkey", 3, ["c_mktsegment"])
    return tree.table(c).where("parent IS NULL").select("n")


# --- regression


@query("""
SELECT round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
  round(regr_r2(l_extendedprice, l_quantity), 9) AS r2, count(*) AS n FROM lineitem
""")
def ols_simple(spark, sf_dir):
    f = regression.linear_regression(read(spark, sf_dir, "lineitem"), "l_extendedprice", {"l_quantity": F.col("l_quantity")})
    return small(spark, [(round(float(f.beta[0]), 4), round(float(f.beta[1]), 4), round(f.r2, 9), f.n)], "intercept double, slope double, r2 double, n long")


@query("""
WITH m AS (SELECT avg(l_extendedprice) AS y, avg(l_quantity) AS a, avg(l_discount) AS b FROM lineitem),
s AS (SELECT sum((l_quantity - a) ** 2) AS aa, sum((l_discount - b) ** 2) AS bb, sum((l_quantity - a) * (l_discount - b)) AS ab,
  sum((l_quantity - a) * (l_extendedprice - y)) AS ay, sum((l_discount - b) * (l_extendedprice - y)) AS yb FROM lineitem CROSS JOIN m)
SELECT round((ay * bb - yb * ab) / (aa * bb - ab * ab), 4) AS quantity, round((yb * aa - ay * ab) / (aa * bb - ab * ab), 2) AS discount FROM s
""")
def ols_two_predictors(spark, sf_dir):
    f = regression.linear_regression(read(spark, sf_dir, "lineitem"), "l_extendedprice", {c: F.col(c) for c in ("l_quantity", "l_discount")})
    return small(spark, [(round(float(f.beta[1]), 4), round(float(f.beta[2]), 2))], "quantity double, discount double")


@query("""
WITH m AS (SELECT sum(l_quantity * l_extendedprice) / sum(l_quantity) AS y, sum(l_quantity * l_discount) / sum(l_quantity) AS a FROM lineitem),
b AS (SELECT sum(l_quantity * (l_discount - a) * (l_extendedprice - y)) / sum(l_quantity * (l_discount - a) ** 2) AS b, any_value(a) AS a, any_value(y) AS y, sum(l_quantity * (l_discount - a) ** 2) AS s, sum(l_quantity) AS w FROM lineitem CROSS JOIN m),
h AS (SELECT sum(l_quantity * ((l_extendedprice - y - b * (l_discount - a)) / (1 - 1 / w - (l_discount - a) ** 2 / s)) ** 2 * (l_discount - a) ** 2) / max(s) ** 2 AS v FROM lineitem CROSS JOIN b)
SELECT round(b, 2) AS slope, round(sqrt(v), 2) AS hc3_se FROM b CROSS JOIN h
""")
def ols_weighted_hc3(spark, sf_dir):
    f = regression.linear_regression(read(spark, sf_dir, "lineitem"), "l_extendedprice", {"l_discount": F.col("l_discount")}, "l_quantity", "frequency", covariance="hc3")
    return small(spark, [(round(float(f.beta[1]), 2), round(float(f.covariance[1, 1] ** 0.5), 2))], "slope double, hc3_se double")


@query()
def ols_diagnostics(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    x = regression.design_columns(c, ["c_nationkey"], {"c_mktsegment": "BUILDING"})
    f = regression.linear_regression(c, "c_acctbal", x, keep=["c_custkey"])
    return f.diagnostics().select("c_custkey", "fitted", "residual", "leverage", "studentised", "cook")


@query()
def logistic(spark, sf_dir):
    d = _marked(spark, sf_dir)
    f = regression.logistic_regression(d, F.col("quality").cast("double"), {"chars": F.log1p(F.col("n_chars")), "toxic": F.col("toxic")})
    se = np.sqrt(np.diag(f.covariance))
    return small(spark, [(n, float(b), float(s)) for n, b, s in zip(f.names, f.beta, se, strict=True)], "term string, beta double, se double")


@query()
def lda(spark, sf_dir):
    e = _points(spark, sf_dir, 4)[0]
    m = discriminant.class_moments(e, "label", ["x0", "x1", "x2", "x3"])
    return discriminant.posterior(e, m).select("vec_id", "label", "predicted")


@query()
def qda(spark, sf_dir):
    e = _points(spark, sf_dir, 4)[0]
    return discriminant.posterior(e, discriminant.class_moments(e, "label", ["x0", "x1", "x2", "x3"]), True).select("vec_id", "label", "predicted")


@query()
def stepwise(spark, sf_dir):
    e, x = _points(spark, sf_dir)
    m = discriminant.class_moments(e, "label", x)
    return small(spark, [(i, c) for i, c in enumerate(discriminant.stepwise(m, 0.9))], "step int, column string")


@query("""
WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_discount, l_extendedprice) AS b, corr(l_quantity, l_discount) AS c FROM lineitem),
s AS (SELECT a * a AS r1, b * b AS r2, (a * a + b * b - 2 * a * b * c) / (1 - c * c) AS r12 FROM r)
SELECT d AS driver, round(CASE WHEN d = 'l_quantity' THEN (r1 + r12 - r2) / 2 ELSE (r2 + r12 - r1) / 2 END, 6) AS importance FROM s CROSS JOIN (VALUES ('l_quantity'), ('l_discount')) v(d)
""")
def key_drivers(spark, sf_dir):
    out = regression.key_drivers(read(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    return small(spark, [(r["driver"], round(r["importance"], 6)) for r in out], "driver string, importance double")


@query("""
WITH z AS (SELECT (l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_samp(l_extendedprice) OVER () AS z, l_quantity AS q FROM lineitem),
m AS (SELECT avg(z) FILTER (q <= 16) AS low, avg(z) FILTER (q >= 34) AS high, avg(z) FILTER (q > 16 AND q < 34) AS mid FROM z)
SELECT 'l_quantity' AS attribute, round(low - mid, 6) AS penalty, round(high - mid, 6) AS reward FROM m
""")
def penalty_reward(spark, sf_dir):
    r = regression.penalty_reward(read(spark, sf_dir, "lineitem"), "l_extendedprice", {"l_quantity": (16, 34)})[0]
    return small(spark, [(r["attribute"], round(r["penalty"], 6), round(r["reward"], 6))], "attribute string, penalty double, reward double")


@query(
    """
WITH p AS (SELECT CAST(p_size AS DOUBLE) AS x, CAST(p_retailprice AS DOUBLE) AS y FROM part),
e AS (SELECT min(x) AS a, max(x) AS b, CAST(greatest(3, ceil(0.5 * count(*))) AS BIGINT) AS k FROM p),
g AS (SELECT i, a + (b - a) * i / 19 AS g FROM e, range(20) AS t(i)),
d AS (SELECT i, g, x, y, x - g AS d, row_number() OVER (PARTITION BY i ORDER BY abs(x - g)) AS r FROM g, p),
h AS (SELECT i, max(abs(d)) AS h FROM d, e WHERE r <= k GROUP BY i),
w AS (SELECT i, g, d, y, (1 - abs(d / h) ** 3) ** 3 AS w FROM d JOIN h USING (i) WHERE abs(d) < h),
s AS (SELECT i, any_value(g) AS x, count(*) AS n, sum(w) AS s0, sum(w * d) AS s1, sum(w * d * d) AS s2, sum(w * y) AS t0, sum(w * d * y) AS t1 FROM w GROUP BY i)
SELECT round(x, 6) AS x, round((s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1), 4) AS fit, n FROM s
"""
)
def loess(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    curve = smoothing.loess(part, "p_size", "p_retailprice", points=20).curve(part)
    return curve.select(F.round("x", 6).alias("x"), F.round("fit", 4).alias("fit"), "n")


@query()
def loess_points(spark, sf_dir):
    return smoothing.loess(read(spark, sf_dir, "part"), "p_size", "p_retailprice", points=20, keep=["p_partkey"]).points()


@query()
def impute_draws(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    gone = lambda c, k: F.when(F.pmod(F.xxhash64("o_orderkey", F.lit(k)), F.lit(10)) > 0, F.col(c))
    holed = orders.withColumns({"o_orderpriority": gone("o_orderpriority", 1), "o_totalprice": gone("o_totalprice", 2)})
    return draws.fill_draws(holed, ["o_totalprice", "o_orderpriority"], "o_orderkey", ["o_orderstatus"], steps=2)


@query()
def decision_tree(spark, sf_dir):
    e, x = _points(spark, sf_dir, 64)
    return trees.fit_trees(e, "label", x).predictions().select("vec_id", "label", "predicted", "leaf")


@query("SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def tree_leaves(spark, sf_dir):
    """A regression of a nominal column's code on its indicators has each code in a leaf of its own."""
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"), F.col("c_nationkey").cast("double").alias("number"))
    nodes = trees.fit_trees(c, "number", [], ["nation"], "regression", depth=25).nodes()
    return nodes.where("leaf IS NOT NULL AND n > 0").select(F.col("mean").cast("long").alias("c_nationkey"), "n")


@query()
def representative_tree(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    forest = trees.fit_trees(part, "p_retailprice", ["p_size"], ["p_brand"], trees=10, depth=4)
    return forest.nodes(forest.representative()).select("node", "parent", "depth", "feature", "threshold", "leaf", "prediction", "n", "mean")


@query()
def random_forest(spark, sf_dir):
    e, x = _points(spark, sf_dir)
    return trees.fit_trees(e, "label", x, trees=20).predictions().select("vec_id", "label", "predicted")


@query()
def feature_ranking(spark, sf_dir):
    e, x = _points(spark, sf_dir, 64)
    return ranking.rank_features(e.withColumn("label", F.col("label").cast("string")), x, "vec_id", "label", trees=30, repeats=1).table(spark)


@query(
    """
WITH c AS (SELECT c_custkey, c_acctbal, c_nationkey, c_mktsegment FROM customer),
m AS (SELECT avg(c_acctbal) AS m, count(*) AS n, count(DISTINCT c_mktsegment) AS k FROM c),
g AS (SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS a, sum((c_acctbal - (SELECT avg(i.c_acctbal) FROM c AS i WHERE i.c_mktsegment = c.c_mktsegment)) ** 2) AS w FROM c GROUP BY ALL)
SELECT 'c_acctbal' AS feature, 'f' AS method, round(sum(g.n * (g.a - m.m) ** 2) / any_value(m.k - 1) / (sum(g.w) / any_value(m.n - m.k)), 6) AS score FROM g CROSS JOIN m
"""
)
def feature_f_ratio(spark, sf_dir):
    found = ranking.rank_features(read(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"], "c_custkey", "c_mktsegment", ["f"])
    return rounded(found.detail(spark).where("feature = 'c_acctbal'").select("feature", "method", "score"), 6, "score")


@query()
def feature_ranking_regression(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    return ranking.rank_features(part, [c for c in part.columns if c not in ("p_partkey", "p_name", "p_comment")], "p_partkey", "p_retailprice").detail(spark)


# --- factorial methods


@query("""
WITH r AS (SELECT corr(p_size, p_retailprice) AS r FROM part) SELECT CAST(i AS INTEGER) AS component, round(CASE WHEN i = 1 THEN 1 + abs(r) ELSE 1 - abs(r) END, 9) AS eigenvalue FROM r CROSS JOIN range(1, 3) t(i)
""")
def pca_two_columns(spark, sf_dir):
    p = factorial.pca(read(spark, sf_dir, "part"), ["p_size", "p_retailprice"])
    return small(spark, [(i + 1, round(float(v), 9)) for i, v in enumerate(p.eigenvalues)], "component int, eigenvalue double")


@query()
def pca_scores(spark, sf_dir):
    e, x = _points(spark, sf_dir)
    return factorial.pca(e, x).scores(e, 2).select("vec_id", "pc1", "pc2")


@query("""
WITH k AS (SELECT o_orderstatus AS r, o_orderpriority AS c, count(*) AS n FROM orders GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY r) AS a, sum(n) OVER (PARTITION BY c) AS b, sum(n) OVER () AS t FROM k)
SELECT round(sum((n - a * b / t) ** 2 / (a * b / t)) / max(t), 12) AS inertia FROM t
""")
def ca_inertia(spark, sf_dir):
    from canvass.operators import crosstab

    _, _, m = crosstab.table(crosstab.cells(read(spark, sf_dir, "orders"), BOOK["o_orderstatus"], BOOK["o_orderpriority"]), "n")
    return small(spark, [(round(factorial.correspondence(m)["inertia"], 12),)], "inertia double")


@query("SELECT round((count(DISTINCT o_orderstatus) + count(DISTINCT o_orderpriority) + count(DISTINCT c_mktsegment)) / 3 - 1, 9) AS total_inertia FROM " + _RESPONDENTS)
def mca_total_inertia(spark, sf_dir):
    m = factorial.mca(respondents(spark, sf_dir), {c: None for c in ("o_orderstatus", "o_orderpriority", "c_mktsegment")})
    return small(spark, [(round(m["total_inertia"], 9),)], "total_inertia double")


@query("SELECT CAST(2 + (count(DISTINCT o_orderstatus) - 1) + (count(DISTINCT c_mktsegment) - 1) AS DOUBLE) AS total_inertia FROM " + _RESPONDENTS)
def famd_total_inertia(spark, sf_dir):
    m = factorial.famd(respondents(spark, sf_dir), ["o_totalprice", "c_acctbal"], {c: None for c in ("o_orderstatus", "c_mktsegment")})
    return small(spark, [(round(m["total_inertia"], 6),)], "total_inertia double")


@query(f"""
WITH r AS (SELECT o_orderstatus AS a, o_orderpriority AS b, c_mktsegment AS c FROM {_RESPONDENTS}),
x AS (SELECT 1 AS v, a AS p, b AS q FROM r UNION ALL SELECT 2, a, c FROM r UNION ALL SELECT 3, b, c FROM r),
n AS (SELECT v, p, q, count(*) AS n FROM x GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY v, p) AS np, sum(n) OVER (PARTITION BY v, q) AS nq FROM n),
phi AS (SELECT sum(n * n / (np * nq)) - 3 AS phi FROM t)
SELECT round((2 * phi + (SELECT count(DISTINCT a) + count(DISTINCT b) + count(DISTINCT c) - 3 FROM r)) / 9, 6) AS squared_inertia FROM phi
""")
def mca_squared_inertia(spark, sf_dir):
    """Squares of the eigenvalues add up to the squared associations of all pairs of variables."""
    m = factorial.mca(respondents(spark, sf_dir), {c: None for c in ("o_orderstatus", "o_orderpriority", "c_mktsegment")})
    return small(spark, [(round(float((m["eigenvalues"] ** 2).sum()), 6),)], "squared_inertia double")


@query(f"""
WITH r AS (SELECT o_totalprice AS x, c_acctbal AS y, o_orderstatus AS a, c_mktsegment AS b FROM {_RESPONDENTS}),
v AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, corr(x, y) AS c, count(DISTINCT a) + count(DISTINCT b) - 2 AS k FROM r),
e AS (SELECT count(*) * pow(avg(x) - any_value(mx), 2) / any_value(n * vx) + count(*) * pow(avg(y) - any_value(my), 2) / any_value(n * vy) AS e FROM r, v GROUP BY a
  UNION ALL SELECT count(*) * pow(avg(x) - any_value(mx), 2) / any_value(n * vx) + count(*) * pow(avg(y) - any_value(my), 2) / any_value(n * vy) FROM r, v GROUP BY b),
g AS (SELECT a, b, count(*) AS n FROM r GROUP BY a, b), t AS (SELECT n, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb FROM g)
SELECT round(2 + 2 * c * c + k + 2 * (SELECT sum(e) FROM e) + 2 * (SELECT sum(n * n / (na * nb)) - 1 FROM t), 6) AS squared_inertia FROM v
""")
def famd_squared_inertia(spark, sf_dir):
    """Squares of the eigenvalues add up to squared correlations, correlation ratios and associations."""
    m = factorial.famd(respondents(spark, sf_dir), ["o_totalprice", "c_acctbal"], {c: None for c in ("o_orderstatus", "c_mktsegment")})
    return small(spark, [(round(float((m["eigenvalues"] ** 2).sum()), 6),)], "squared_inertia double")


@query()
def famd_scores(spark, sf_dir):
    r = respondents(spark, sf_dir)
    found = factorial.famd(r, ["o_totalprice", "c_acctbal"], {c: None for c in ("o_orderstatus", "c_mktsegment")})
    return factorial.famd_scores(r, found).select("o_orderkey", *(f"{c}{j}" for j in (1, 2) for c in ("dim", "contribution", "cos2_")))


@query()
def famd_variables(spark, sf_dir):
    """Contributions of variables to the first axes, and eta2 of the nominal ones."""
    found = factorial.famd(respondents(spark, sf_dir), ["o_totalprice", "c_acctbal"], {c: None for c in ("o_orderstatus", "c_mktsegment")})
    rows = []
    for i, v in enumerate(found["variables"]):
        eta = found["eta2"][i - 2] if i >= 2 else (None, None)
        rows += [(v, j + 1, float(found["variable_contributions"][i, j]), None if eta[j] is None else float(eta[j])) for j in (0, 1)]
    return small(spark, rows, "variable string, axis int, contribution double, eta2 double")


@query()
def mca_scores(spark, sf_dir):
    r = respondents(spark, sf_dir)
    return factorial.mca_scores(r, factorial.mca(r, {c: None for c in ("o_orderstatus", "c_mktsegment")})).select("o_orderkey", "dim1", "dim2")


@query()
def axis_orderings(spark, sf_dir):
    items, names = read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    r, _ = efa.pearson_matrix(items, names)
    found = {
        "database": names,
        "component": factorial.axis_order(r, names),
        "seriation": factorial.seriation(r, names),
        "permute": factorial.permute_order(factorial.adjacency(items, names), names),
    }
    return small(spark, [(k, i, c) for k, v in found.items() for i, c in enumerate(v)], "method string, place int, column string")


@query()
def factor_analysis(spark, sf_dir):
    e, x = _points(spark, sf_dir)
    r, n = efa.pearson_matrix(e, x)
    f = efa.promax(efa.extract(r, 2, "ml", n))
    return small(spark, [(c, float(a), float(b), float(u)) for c, (a, b), u in zip(x, f.loadings, f.uniqueness, strict=True)], "item string, factor1 double, factor2 double, uniqueness double")


@query()
def parallel_analysis(spark, sf_dir):
    e, x = _points(spark, sf_dir)
    observed, reference, k = efa.parallel(e, x, "vec_id")
    return small(spark, [(i + 1, float(a), float(b), i < k) for i, (a, b) in enumerate(zip(observed, reference, strict=True))], "factor int, observed double, reference double, kept boolean")


@query()
def polychoric(spark, sf_dir):
    size = Variable("s", scale="ordinal", order=("0", "1", "2"))
    cut = read(spark, sf_dir, "labels").withColumn("s", (F.col("quality") + F.col("toxic")).cast("string")).withColumn("q", F.col("quality").cast("string"))
    r, _ = efa.polychoric_matrix(cut, [Variable("q", scale="ordinal", order=("0", "1")), size])
    return small(spark, [(float(r[0, 1]),)], "rho double")


@query()
def factor_sensitivity(spark, sf_dir):
    """Pearson against polychoric solutions of ordinal items."""
    items = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    cut = [F.least(F.greatest(F.round(F.col(c) * k), F.lit(0)), F.lit(4)).cast("int").alias(c) for c, k in zip(items, (0.08, 40, 40, 0.6), strict=True)]
    tally = stored(read(spark, sf_dir, "lineitem").groupBy(*cut).agg(F.count("*").alias("n")), "tally")  # 5 ** 4 combinations at most, and nulls
    order = tuple(map(str, range(5)))
    pearson, n = efa.pearson_matrix(tally.select(*(F.col(c).cast("double").alias(c) for c in items), "n"), items, "n")
    poly, _ = efa.polychoric_matrix(tally.select(*(F.col(c).cast("string").alias(c) for c in items), "n"), [Variable(c, scale="ordinal", order=order) for c in items], "n")
    found = efa.sensitivity(pearson, efa.extract(pearson, 1, "uls", n), poly, efa.extract(poly, 1, "uls", n))
    return small(spark, [(k, float(v)) for k, v in found.items() if k.endswith(("_max", "_median"))], "measure string, value double")


# --- mining and robustness


@query(f"""
WITH l AS (SELECT 'c_mktsegment' AS attribute, c_mktsegment AS level, o_totalprice AS v FROM {_RESPONDENTS} UNION ALL SELECT 'o_orderpriority', o_orderpriority, o_totalprice FROM {_RESPONDENTS}),
g AS (SELECT attribute, level, count(*) AS n, avg(v) AS mean, sum(v) AS s FROM l GROUP BY ALL), t AS (SELECT *, sum(n) OVER w AS tn, sum(s) OVER w AS ts FROM g WINDOW w AS (PARTITION BY attribute))
SELECT attribute, level, 'o_totalprice' AS question, n, round(mean, 2) AS mean, round((ts - s) / (tn - n), 2) AS rest_mean FROM t
""")
def subgroup_numeric(spark, sf_dir):
    out = mining.numeric_subgroups(respondents(spark, sf_dir), ["c_mktsegment", "o_orderpriority"], ["o_totalprice"])
    return rounded(out, 2, "mean", "rest_mean").select("attribute", "level", "question", "n", "mean", "rest_mean")


@query(
    """
WITH c AS (SELECT c_acctbal AS x, c_nationkey AS y FROM customer WHERE c_acctbal IS NOT NULL AND c_nationkey IS NOT NULL),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS b, x, y FROM c),
k AS (SELECT sum(sign(p.x - q.x) * sign(p.y - q.y)) AS s, sum(abs(sign(p.x - q.x))) AS u, sum(abs(sign(p.y - q.y))) AS v FROM c AS p, c AS q)
SELECT 'c_acctbal' AS x, 'c_nationkey' AS y, round(corr(a, b), 6) AS spearman, round(any_value(s / sqrt(u * v)), 6) AS tau_b, round(corr(x, y), 6) AS pearson FROM r, k
"""
)
def rank_relations(spark, sf_dir):
    found, _ = relations.relations(read(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey", "c_mktsegment"])
    return rounded(found.where("pearson IS NOT NULL").select("x", "y", "spearman", "tau_b", "pearson"), 6, "spearman", "tau_b", "pearson")


@query(
    """
WITH g AS (SELECT c_mktsegment AS s, count(*) AS n, avg(c_acctbal) AS m FROM customer GROUP BY 1), t AS (SELECT avg(c_acctbal) AS m, var_pop(c_acctbal) * count(*) AS v FROM customer)
SELECT 'c_mktsegment' AS y, round(sqrt(sum(g.n * (g.m - t.m) ** 2) / any_value(t.v)), 6) AS eta FROM g, t
"""
)
def eta_relation(spark, sf_dir):
    found, _ = relations.relations(read(spark, sf_dir, "customer"), ["c_acctbal", "c_mktsegment"])
    return rounded(found.select("y", "eta"), 6, "eta")


@query(f"""
WITH g AS (SELECT c_mktsegment AS level, o_orderpriority AS value, count(*) AS n FROM {_RESPONDENTS} GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY level) AS a, sum(n) OVER (PARTITION BY value) AS b, sum(n) OVER () AS t FROM g)
SELECT 'c_mktsegment' AS attribute, level, 'o_orderpriority' AS question, value, n, round((n - a * b / t) / sqrt(a * b / t * (1 - a / t) * (1 - b / t)), 6) AS residual FROM t
""")
def subgroup_categorical(spark, sf_dir):
    return rounded(mining.categorical_subgroups(respondents(spark, sf_dir), ["c_mktsegment"], ["o_orderpriority"]), 6, "residual")


@query()
def subgroup_findings(spark, sf_dir):
    found = mining.mine_numeric(respondents(spark, sf_dir), ["c_mktsegment", "o_orderpriority", "o_orderstatus"], ["o_totalprice", "c_acctbal"])
    return small(spark, [(f.attribute, f.question, f.effect, f.p, f.q, f.score) for f in found], "attribute string, question string, effect double, p double, q double, score double")


@query(f"""
WITH g AS (SELECT c_mktsegment AS s, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM {_RESPONDENTS} GROUP BY 1)
SELECT a.s AS first, b.s AS second, round(a.m - b.m, 4) AS difference FROM g AS a JOIN g AS b ON a.s < b.s
""")
def subgroup_posthoc(spark, sf_dir):
    """Pairs of levels of a finding; a test holds their adjusted p-values against plain Welch tests."""
    found = mining.mine_numeric(respondents(spark, sf_dir), ["c_mktsegment"], ["o_totalprice"])
    return small(spark, [(a, b, round(d, 4)) for f in found for a, b, d, _ in f.posthoc], "first string, second string, difference double")


@query(f"""
WITH r AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END AS y, c_mktsegment AS s FROM {_RESPONDENTS}), t AS (SELECT count(*) AS n, sum(y) AS s FROM r), g AS (SELECT s, count(*) AS n, avg(y) AS m, sum(y) AS u FROM r GROUP BY s)
SELECT g.s AS level, g.n, round(m - (t.s - u) / (t.n - g.n), 6) AS effect, round(sqrt(g.n * (t.n - g.n) / t.n) * abs(m - (t.s - u) / (t.n - g.n)), 6) AS score FROM g CROSS JOIN t
""")
def modern_rules_category(spark, sf_dir):
    found = mining.discover(respondents(spark, sf_dir), F.col("o_orderstatus"), ["c_mktsegment"], depth=1, top=100, overlap=1.0, category="F")
    return small(spark, [(r["rule"][0][2], r["n"], round(r["effect"], 6), round(r["score"], 6)) for r in found], "level string, n long, effect double, score double")


@query(f"""
WITH r AS (SELECT o_totalprice AS y, c_mktsegment AS s FROM {_RESPONDENTS}), t AS (SELECT count(*) AS n, sum(y) AS s, stddev_samp(y) AS sd FROM r), g AS (SELECT s, count(*) AS n, avg(y) AS m, sum(y) AS u FROM r GROUP BY s)
SELECT g.s AS level, g.n, round(sqrt(g.n * (t.n - g.n) / t.n) * abs(m - (t.s - u) / (t.n - g.n)) / sd, 4) AS score FROM g CROSS JOIN t
""")
def modern_rules_depth1(spark, sf_dir):
    found = mining.discover(respondents(spark, sf_dir), F.col("o_totalprice"), ["c_mktsegment"], depth=1, top=100, overlap=1.0)
    return small(spark, [(r["rule"][0][2], r["n"], round(r["score"], 4)) for r in found], "level string, n long, score double")


@query()
def modern_rules_depth2(spark, sf_dir):
    found = mining.discover(respondents(spark, sf_dir), F.col("o_totalprice"), ["c_mktsegment", "o_orderpriority", "c_acctbal"])
    return small(spark, [(str(r["rule"]), r["n"], r["effect"], r["score"]) for r in found], "rule string, n long, effect double, score double")


@query()
def rule_verification(spark, sf_dir):
    r = respondents(spark, sf_dir)
    rules = mining.descriptors(r, ["c_mktsegment"])
    return mining.verify(r, F.col("o_totalprice"), rules, F.pmod(F.xxhash64("o_orderkey"), F.lit(2)))


@query()
def surprise_pairs(spark, sf_dir):
    return mining.surprise(respondents(spark, sf_dir), ["o_orderstatus", "o_orderpriority", "c_mktsegment", "o_totalprice"])


@query("""
WITH r AS (SELECT *, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS p, count(*) OVER () AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')), f(f) AS (VALUES (0.0), (0.05), (0.1), (0.2))
SELECT CAST(f AS DOUBLE) AS fraction, round(avg(c_nationkey) FILTER (c_mktsegment = 'BUILDING') - avg(c_nationkey) FILTER (c_mktsegment = 'MACHINERY'), 6) AS difference FROM r CROSS JOIN f WHERE p >= floor(CAST(f AS DOUBLE) * n) GROUP BY f
""")
def robust_sweep(spark, sf_dir):
    out = mining.removal_sweep(read(spark, sf_dir, "customer"), "c_acctbal", "c_mktsegment", "c_nationkey", "BUILDING", "MACHINERY", "c_custkey")
    return rounded(out, 6, "difference")


@query("""
WITH r AS (SELECT *, count(*) OVER w AS n, avg(c_acctbal) OVER w AS m FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') WINDOW w AS (PARTITION BY c_mktsegment)),
i AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE -1 END * (m - c_acctbal) / (n - 1) AS x FROM r)
SELECT c_custkey, round(x, 6) AS influence FROM i ORDER BY abs(x) DESC, c_custkey LIMIT 10
""")
def jackknife_top(spark, sf_dir):
    return rounded(mining.jackknife(read(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal", "BUILDING", "MACHINERY", "c_custkey"), 6, "influence")


@query("""
WITH z AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders), r AS (SELECT o_orderstatus AS g, o_totalprice AS v, abs((o_totalprice - m) / s) <= 1.5 AS i FROM orders CROSS JOIN z)
SELECT round(avg(v) FILTER (g = 'F') - avg(v) FILTER (g = 'O'), 2) AS baseline, round(avg(v) FILTER (g = 'F' AND i) - avg(v) FILTER (g = 'O' AND i), 2) AS trimmed FROM r
""")
def sensitivity_effect(spark, sf_dir):
    s = mining.sensitivity(read(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice", "F", "O", 1.5)
    return small(spark, [(round(s["baseline"], 2), round(s["trimmed"], 2))], "baseline double, trimmed double")


@query()
def bootstrap_ci(spark, sf_dir):
    b = mining.bootstrap(read(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal", "BUILDING", "MACHINERY", "c_custkey")
    return small(spark, [(b["low"], b["high"], b["flip_rate"], b["grade"])], "low double, high double, flip_rate double, grade string")


@query(f"""
WITH r AS (SELECT o_totalprice AS y, 6 - CAST(left(o_orderpriority, 1) AS INTEGER) AS x FROM {_RESPONDENTS})
SELECT 'o_orderpriority' AS term, round(regr_slope(y, x), 4) AS beta, count(*) AS n FROM r
""")
def questionnaire_regression(spark, sf_dir):
    """Price on the reversed rank of the priority, under a codebook."""
    price = Variable("o_totalprice", scale="ratio")
    book = Codebook((price, Variable("o_orderpriority", scale="ordinal", order=BOOK["o_orderpriority"].order, is_reversed=True)))
    f = regression.questionnaire_regression(respondents(spark, sf_dir), book, "o_totalprice", ["o_orderpriority"], ordinal_as_rank=["o_orderpriority"])
    return small(spark, [(n, round(float(b), 4), f.n) for n, b in zip(f.names, f.beta, strict=True) if n != "(intercept)"], "term string, beta double, n long")


@query("""
WITH h AS (SELECT c_custkey, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split('42|' || c_custkey || '|x', ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, b: (xor(h, b) * 16777619) & 4294967295) AS h FROM customer),
a AS (SELECT c_custkey, xor(h, (h << 13) & 4294967295) AS a FROM h), b AS (SELECT c_custkey, xor(a, a >> 17) AS b FROM a), c AS (SELECT c_custkey, xor(b, (b << 5) & 4294967295) AS c FROM b)
SELECT c_custkey, round(c / 4294967295.0 * 2 - 1, 9) AS jitter FROM c
""")
def row_jitter(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", F.round(signed_noise(F.col("c_custkey"), 42, "x"), 9).alias("jitter"))


# --- conjoint: orders are tasks, their lines alternatives


_FLAG = {"l_returnflag": ("A", "N", "R")}


@query("""
WITH x AS (SELECT l_extendedprice AS y, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END AS a, CASE l_returnflag WHEN 'N' THEN 1 WHEN 'R' THEN -1 ELSE 0 END AS b FROM lineitem),
g AS (SELECT a, b, avg(y) AS m FROM x GROUP BY ALL), t AS (SELECT avg(m) AS t FROM g)
SELECT CASE WHEN a = 1 THEN 'l_returnflag=A' ELSE 'l_returnflag=N' END AS term, round(m - t, 2) AS beta FROM g CROSS JOIN t WHERE a = 1 OR b = 1
""")
def conjoint_ratings_pooled(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem")
    f = conjoint.ratings(items, "l_extendedprice", conjoint.effect_columns(items, _FLAG))
    return small(spark, [(n, round(float(b), 2)) for n, b in zip(f.names, f.beta, strict=True) if n != "(intercept)"], "term string, beta double")


@query("""
WITH d AS (SELECT l_extendedprice - avg(l_extendedprice) OVER w AS y, l_quantity - avg(l_quantity) OVER w AS x FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))
SELECT 'l_quantity' AS term, round(sum(x * y) / sum(x * x), 4) AS beta FROM d
""")
def conjoint_ratings_fixed(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem")
    f = conjoint.ratings(items, "l_extendedprice", conjoint.effect_columns(items, {}, ["l_quantity"]), "l_orderkey")
    return small(spark, [(n, round(float(b), 4)) for n, b in zip(f.names, f.beta, strict=True)], "term string, beta double")


def _tasks(spark, sf_dir) -> DataFrame:
    """Lines of an order as alternatives; the dearest is chosen and the price gives their ranks."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber"))
    items = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return items.withColumn("rank", place).withColumn("chosen", (F.col("rank") == 1).cast("int"))


@query()
def conjoint_choice(spark, sf_dir):
    t = _tasks(spark, sf_dir)
    f = conjoint.conditional_logit(t, conjoint.effect_columns(t, _FLAG, ["l_quantity"]), "o_custkey", "l_orderkey", "choice", "chosen")
    return small(spark, [(r["term"], r["beta"], r["se"], r["p"]) for r in f.table()], "term string, beta double, se double, p double")


@query()
def conjoint_ranking(spark, sf_dir):
    t = _tasks(spark, sf_dir)
    f = conjoint.conditional_logit(t, conjoint.effect_columns(t, _FLAG, ["l_discount"]), "o_custkey", "l_orderkey", "ranking", "rank")
    return small(spark, [(r["term"], r["beta"], r["se"], r["p"]) for r in f.table()], "term string, beta double, se double, p double")


@query()
def conjoint_simulation(spark, sf_dir):
    t = _tasks(spark, sf_dir)
    f = conjoint.conditional_logit(t, conjoint.effect_columns(t, _FLAG, ["l_quantity"]), "o_custkey", "l_orderkey", "choice", "chosen")
    beta = dict(zip(f.names, f.beta.tolist(), strict=True))
    code = {"A": (1, 0), "N": (0, 1), "R": (-1, -1)}
    profiles = [{"l_returnflag=A": a, "l_returnflag=N": b, "l_quantity": 10.0} for a, b in code.values()]
    return small(spark, list(zip(code, conjoint.simulate(beta, profiles), strict=True)), "profile string, share double")


def _offers(spark, sf_dir) -> DataFrame:
    """Tasks with what surveys hold: lines not offered, lines that opt out, missing discounts and customers' weights."""
    t = _tasks(spark, sf_dir).join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return t.select(
        "o_custkey", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "chosen", "c_nationkey", "c_mktsegment",
        (F.col("l_suppkey") % 6 != 0).alias("offered"), (F.col("l_partkey") % 5 == 0).alias("none"),
        F.when(F.col("l_discount") != 0.07, F.col("l_discount")).alias("discount"),
        F.when(F.col("c_nationkey") != 3, F.col("c_nationkey") % 5).cast("double").alias("weight"),
    )


@query("""
WITH i AS (SELECT l_orderkey, o_custkey, CASE WHEN row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) = 1 THEN 1 ELSE 0 END AS chosen,
  l_suppkey % 6 <> 0 AS offered, l_partkey % 5 = 0 AS none, CASE WHEN l_discount <> 0.07 THEN l_discount END AS discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT i.*, CASE WHEN c_nationkey <> 3 THEN c_nationkey % 5 END AS weight FROM i JOIN customer ON o_custkey = c_custkey),
t AS (SELECT *, count(*) FILTER (WHERE offered) OVER w AS n, count(*) FILTER (WHERE NOT offered AND chosen = 1) OVER w AS hidden, count(*) FILTER (WHERE offered AND none) OVER w AS outs,
  count(*) FILTER (WHERE offered AND discount IS NULL AND NOT none) OVER w AS holes FROM r WINDOW w AS (PARTITION BY o_custkey, l_orderkey))
SELECT CASE WHEN weight IS NULL THEN 'missing_weight' WHEN weight = 0 THEN 'zero_weight' WHEN NOT offered THEN 'unavailable' WHEN hidden > 0 THEN 'unavailable_answered'
  WHEN outs > 1 THEN 'several_opt_outs' WHEN n < 2 THEN 'too_few_alternatives' WHEN holes > 0 THEN 'missing' ELSE 'used' END AS reason, count(*) AS n FROM t GROUP BY 1
""")
def conjoint_task_reasons(spark, sf_dir):
    found = conjoint.task_reasons(_offers(spark, sf_dir), "o_custkey", "l_orderkey", "choice", "chosen", ["discount"], "offered", "none", "weight")
    return found.groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 7)")
def conjoint_whole_tasks(spark, sf_dir):
    t = _tasks(spark, sf_dir)
    return conjoint.whole_tasks(t, t.where("l_quantity = 7"), "o_custkey", "l_orderkey").select("l_orderkey", "l_linenumber")


@query()
def conjoint_survey_choice(spark, sf_dir):
    """Offered lines with a constant for opting out; customers are respondents, in strata by market segment."""
    t = _offers(spark, sf_dir)
    x = conjoint.effect_columns(t, _FLAG, ["l_quantity"])
    f = conjoint.conditional_logit(
        t, x, "o_custkey", "l_orderkey", "choice", "chosen", available="offered", opt_out="none", design=Design(weight="weight", strata="c_mktsegment")
    )
    return small(spark, [(r["term"], r["beta"], r["se"], r["p_t"]) for r in f.table()], "term string, beta double, se double, p double")


@query()
def conjoint_worth(spark, sf_dir):
    """Utilities of levels, the importance of their attribute and what a level is worth in units of quantity."""
    t = _tasks(spark, sf_dir)
    f = conjoint.conditional_logit(t, conjoint.effect_columns(t, _FLAG, ["l_quantity"]), "o_custkey", "l_orderkey", "choice", "chosen")
    levels = conjoint.level_utilities(_FLAG, f.names, f.beta)
    share = conjoint.importance(levels)
    worth = conjoint.willingness_to_pay(f.names, f.beta, f.cluster_covariance, "l_quantity")
    none = {"wtp": None, "low": None, "high": None}
    rows = [(a, x, u, share[a], *worth.get(f"{a}={x}", none).values()) for a, own in levels.items() for x, u in own.items()]
    return small(spark, rows, "attribute string, level string, utility double, importance double, worth double, low double, high double")


# --- sources


@query("""
SELECT 'c_custkey' AS "column", 'long' AS type, CAST(0 AS BIGINT) AS n_missing, count(DISTINCT c_custkey) AS n_distinct, CAST(min(c_custkey) AS DOUBLE) AS min, CAST(max(c_custkey) AS DOUBLE) AS max, false AS constant, true AS unique_id FROM customer
UNION ALL SELECT 'c_mktsegment', 'string', 0, count(DISTINCT c_mktsegment), NULL, NULL, false, false FROM customer
""")
def schema_probe(spark, sf_dir):
    return readers.schema_probe(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"))


@query("SELECT printf('ROW-%06d', row_number() OVER (ORDER BY c_custkey)) AS __rowId__, c_custkey FROM customer")
def row_identity(spark, sf_dir):
    return readers.with_row_ids(read(spark, sf_dir, "customer").select("c_custkey"), order="c_custkey")


@query()
def table_fingerprint(spark, sf_dir):
    return writers.fingerprint(read(spark, sf_dir, "nation"))


@query("""SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type AS code, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def windowed_counts(spark, sf_dir):
    from canvass.streaming.summaries import windowed_counts as counts

    return rounded(counts(read(spark, sf_dir, "events"), "event_type", "ts", "1 day"), 4, "total").drop("end")


