"""Queries over the test tables, one or more for each operator, and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.codebook import Codebook, Design, Group, Variable
from canvass.functions import expr
from canvass.operators import crosstab, distribution, inference, multiresponse, summaries, transform

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
BOOK = Codebook(
    variables=(
        Variable("l_returnflag", order=("A", "N", "R")),
        Variable("l_linestatus", order=("F", "O")),
        Variable("o_orderpriority", scale="ordinal", order=PRIORITIES),
        Variable("o_orderstatus", order=("F", "O", "P")),
        Variable(
            "p_size", scale="ordinal", order=tuple(map(str, range(1, 49))), missing_codes=("49", "50"),
            missing_reasons={"49": "not_applicable", "50": "refused"},
        ),
        Variable("c_mktsegment", order=("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")),
    ),
    groups=(Group("events", ("click", "purchase", "signup", "view", "logout")),),
    design=Design(weight="l_quantity", weight_type="frequency"),
)
REVERSED = Variable("o_orderpriority", scale="ordinal", order=PRIORITIES, is_reversed=True)


def respondents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order with its customer's segment, balance and nation: the survey table of the star schema."""
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))


_RESPONDENTS = "(SELECT * FROM orders JOIN customer ON o_custkey = c_custkey)"


# --- summaries


@query("""
SELECT c AS "column", n, missing, min, max, round(mean, 6) AS mean, median, round(std, 6) AS std, q1, q3, iqr FROM (
  SELECT 'l_quantity' AS c, count(l_quantity) AS n, count(*) - count(l_quantity) AS missing, min(l_quantity) AS min, max(l_quantity) AS max,
    avg(l_quantity) AS mean, quantile_cont(l_quantity, 0.5) AS median, stddev_samp(l_quantity) AS std,
    quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.75) AS q3,
    quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS iqr FROM lineitem
  UNION ALL
  SELECT 'l_discount', count(l_discount), count(*) - count(l_discount), min(l_discount), max(l_discount), avg(l_discount),
    quantile_cont(l_discount, 0.5), stddev_samp(l_discount), quantile_cont(l_discount, 0.25), quantile_cont(l_discount, 0.75),
    quantile_cont(l_discount, 0.75) - quantile_cont(l_discount, 0.25) FROM lineitem)
""")
def numeric_summary(spark, sf_dir):
    out = summaries.numeric_summary(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"])
    return rounded(out, 6, "mean", "std")


@query("""
WITH l AS (SELECT 'c_mktsegment' AS "column", c_mktsegment AS code FROM customer UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer),
g AS (SELECT "column", code, count(*) AS n FROM l GROUP BY ALL)
SELECT "column", code, n, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, code) AS place,
  CAST(sum(n) OVER (PARTITION BY "column") AS BIGINT) AS n_valid, CAST(0 AS BIGINT) AS n_null, count(*) OVER (PARTITION BY "column") AS n_distinct FROM g
""")
def categorical_summary(spark, sf_dir):
    return summaries.categorical_summary(read(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"])


@query("""
SELECT count(*) AS total, count(*) FILTER (p_size = 49) AS not_applicable, count(*) FILTER (p_size = 50) AS missing,
  count(*) FILTER (p_size <> 49) AS target, CAST(0 AS BIGINT) AS invalid, count(*) FILTER (p_size < 49) AS valid FROM part
""")
def question_states(spark, sf_dir):
    return summaries.question_states(read(spark, sf_dir, "part"), BOOK["p_size"])


@query("""
WITH t AS (SELECT count(*) FILTER (p_size < 49) AS v, count(*) FILTER (p_size <> 49) AS g FROM part),
l AS (SELECT i FROM range(1, 49) r(i)), c AS (SELECT p_size AS i, count(*) AS n FROM part WHERE p_size < 49 GROUP BY p_size)
SELECT CAST(l.i - 1 AS INTEGER) AS place, CAST(l.i AS VARCHAR) AS code, CAST(l.i AS VARCHAR) AS label, coalesce(n, 0) AS n, CAST(coalesce(n, 0) AS DOUBLE) AS weighted_n,
  round_even(100.0 * CAST(coalesce(n, 0) AS DOUBLE) / v, 1) AS pct_valid, round_even(100.0 * CAST(coalesce(n, 0) AS DOUBLE) / g, 1) AS pct_target
FROM l LEFT JOIN c USING (i) CROSS JOIN t
""")
def question_summary(spark, sf_dir):
    return summaries.question_summary(read(spark, sf_dir, "part"), BOOK["p_size"])


@query("""
WITH s AS (SELECT 6 - CAST(left(o_orderpriority, 1) AS DOUBLE) AS x FROM orders)
SELECT count(*) AS n, round(avg(x), 6) AS mean, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3,
  round_even(100.0 * count(*) FILTER (x >= 4) / count(*), 1) AS top2, round_even(100.0 * count(*) FILTER (x <= 2) / count(*), 1) AS bottom2 FROM s
""")
def question_summary_reversed(spark, sf_dir):
    return rounded(summaries.question_scores(read(spark, sf_dir, "orders"), REVERSED), 6, "mean")


@query("""
WITH g AS (SELECT l_returnflag AS code, count(*) AS n, sum(l_quantity) AS w FROM lineitem GROUP BY 1), t AS (SELECT sum(w) AS w FROM g)
SELECT CAST(row_number() OVER (ORDER BY code) - 1 AS INTEGER) AS place, code, code AS label, n, g.w AS weighted_n,
  round_even(100 * g.w / t.w, 4) AS pct_valid, round_even(100 * g.w / t.w, 4) AS pct_target FROM g CROSS JOIN t
""")
def weighted_question_summary(spark, sf_dir):
    return summaries.question_summary(read(spark, sf_dir, "lineitem"), BOOK["l_returnflag"], F.col("l_quantity"))


@query("""
WITH s AS (SELECT CAST(left(o_orderpriority, 1) AS INTEGER) - 1 AS p FROM orders)
SELECT 'o_orderpriority' AS item, count(*) AS n, round(100.0 * count(*) FILTER (p < 2) / count(*), 6) AS negative,
  round(100.0 * count(*) FILTER (p = 2) / count(*), 6) AS neutral, round(100.0 * count(*) FILTER (p > 2) / count(*), 6) AS positive,
  round(100.0 * count(*) FILTER (p >= 3) / count(*), 6) AS top2 FROM s
""")
def likert_rows(spark, sf_dir):
    out = summaries.likert_rows(read(spark, sf_dir, "orders"), [BOOK["o_orderpriority"]])
    return rounded(out, 6, "negative", "neutral", "positive", "top2")


@query("""
SELECT l_returnflag AS code, count(*) AS n, count(*) FILTER (l_quantity > 25) AS n_inside FROM lineitem GROUP BY 1
""")
def subset_counts(spark, sf_dir):
    return summaries.subset_counts(read(spark, sf_dir, "lineitem"), "l_returnflag", F.col("l_quantity") > 25)


@query("""SELECT 'c_mktsegment' AS "column", c_mktsegment AS code, count(*) AS n FROM customer GROUP BY 2""")
def colour_domains(spark, sf_dir):
    return summaries.colour_domains(read(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"])


@query("""
SELECT x, y, n, round_even(r, 4) AS r FROM (
  SELECT 'l_quantity' AS x, 'l_extendedprice' AS y, count(*) AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem
  UNION ALL SELECT 'l_quantity', 'l_discount', count(*), corr(l_quantity, l_discount) FROM lineitem
  UNION ALL SELECT 'l_extendedprice', 'l_discount', count(*), corr(l_extendedprice, l_discount) FROM lineitem)
""")
def correlation_matrix(spark, sf_dir):
    return summaries.correlation_pairs(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query("""SELECT p_partkey AS key, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL""")
def focus_pair(spark, sf_dir):
    return summaries.focus_pair(read(spark, sf_dir, "part"), "p_size", "p_retailprice", "p_partkey")


@query("""
WITH m AS (SELECT sum(l_quantity) AS w, sum(l_quantity * l_extendedprice) / sum(l_quantity) AS a, sum(l_quantity * l_discount) / sum(l_quantity) AS b FROM lineitem)
SELECT 'l_extendedprice' AS x, 'l_discount' AS y, count(*) AS n, round_even(sum(l_quantity * (l_extendedprice - a) * (l_discount - b)) /
  sqrt(sum(l_quantity * (l_extendedprice - a) ** 2) * sum(l_quantity * (l_discount - b) ** 2)), 4) AS r FROM lineitem CROSS JOIN m
""")
def correlation_weighted(spark, sf_dir):
    return summaries.correlation_pairs(read(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_discount"], F.col("l_quantity"))


@query("""
WITH r AS (SELECT corr(l_quantity, l_discount) AS a, corr(l_quantity, l_tax) AS b, corr(l_discount, l_tax) AS c,
  covar_samp(l_quantity, l_discount) AS s, count(*) AS n FROM lineitem)
SELECT n, round(s, 6) AS covariance, round(a, 6) AS correlation, round((a - b * c) / sqrt((1 - b * b) * (1 - c * c)), 6) AS partial FROM r
""")
def covariance_suite(spark, sf_dir):
    s = summaries.covariance_suite(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    row = (s["n"], *(round(float(s[k][0, 1]), d) for k, d in (("covariance", 6), ("correlation", 6), ("partial", 6))))
    return spark.createDataFrame([row], "n long, covariance double, correlation double, partial double")


# --- tables


_CELLS = "SELECT l_returnflag AS r, l_linestatus AS c, count(*) AS n, sum(l_quantity) AS w FROM lineitem GROUP BY ALL"
_TABLE = f"""
WITH f AS ({_CELLS}), g AS (SELECT r, c FROM (VALUES ('A'), ('N'), ('R')) a(r) CROSS JOIN (VALUES ('F'), ('O')) b(c)),
k AS (SELECT r, c, coalesce(n, 0) AS n, coalesce(w, 0) AS w FROM g LEFT JOIN f USING (r, c)),
t AS (SELECT *, sum(w) OVER (PARTITION BY r) AS a, sum(w) OVER (PARTITION BY c) AS b, sum(w) OVER () AS t FROM k),
e AS (SELECT *, a * b / t AS expected, (w - a * b / t) / sqrt(a * b / t * (1 - a / t) * (1 - b / t)) AS z FROM t)
"""


@query(_TABLE + """
SELECT r, c, n, w, round_even(100 * w / a, 2) AS row_pct, round_even(100 * w / b, 2) AS col_pct, round_even(100 * w / t, 2) AS total_pct,
  round(expected, 4) AS expected, round(z, 6) AS adjusted_residual,
  CASE WHEN abs(z) >= 3.29 THEN '***' WHEN abs(z) >= 2.58 THEN '**' WHEN abs(z) >= 1.96 THEN '*' ELSE '' END AS stars,
  expected < 5 AS small_expected FROM e
""")
def crosstab_returnflag_linestatus(spark, sf_dir):
    out = crosstab.crosstab(read(spark, sf_dir, "lineitem"), BOOK["l_returnflag"], BOOK["l_linestatus"], F.col("l_quantity"))
    return rounded(rounded(out, 6, "adjusted_residual"), 4, "expected")


@query(_TABLE + """
, s AS (SELECT sum(w * w / (a * b)) * max(t) - max(t) AS chi2, max(t) AS t FROM e)
SELECT round(chi2, 4) AS chi2, CAST(2 AS BIGINT) AS df, round(sqrt(chi2 / t), 6) AS cramers_v, round(exp(-chi2 / 2), 6) AS p FROM s
""")
def chi2_cramers_v(spark, sf_dir):
    found = crosstab.cells(read(spark, sf_dir, "lineitem"), BOOK["l_returnflag"], BOOK["l_linestatus"], F.col("l_quantity"))
    out = crosstab.association(found).withColumn("p", F.round(F.exp(-F.col("chi2") / 2), 6))  # two degrees of freedom
    return rounded(rounded(out, 4, "chi2"), 6, "cramers_v")


@query(f"""
WITH k AS (SELECT o_orderstatus AS r, o_orderpriority AS c, count(*) AS n FROM orders GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY r) AS a, sum(n) OVER (PARTITION BY c) AS b, sum(n) OVER () AS t FROM k),
s AS (SELECT sum((n - a * b / t) ** 2 / (a * b / t)) AS x FROM t)
SELECT round(x, 6) AS chi2, CAST(8 AS BIGINT) AS df, round(exp(-x / 2) * (1 + x / 2 + (x / 2) ** 2 / 2 + (x / 2) ** 3 / 6), 6) AS p FROM s
""")
def chi2_p_even_df(spark, sf_dir):
    found = crosstab.cells(read(spark, sf_dir, "orders"), BOOK["o_orderstatus"], BOOK["o_orderpriority"])
    t = inference.table_test(found, inference.resolve("auto", None))
    return spark.createDataFrame([(round(t["chi2"], 6), t["df"], round(t["p"], 6))], "chi2 double, df long, p double")


@query("""
SELECT CASE WHEN p_size = 49 THEN '__not_applicable__' WHEN p_size = 50 THEN '__missing__' ELSE CAST(p_size AS VARCHAR) END AS r,
  p_brand AS c, count(*) AS n, CAST(count(*) AS DOUBLE) AS w FROM part GROUP BY ALL
""")
def crosstab_missing_policies(spark, sf_dir):
    return crosstab.cells(read(spark, sf_dir, "part"), BOOK["p_size"], BOOK["p_brand"], policy="separate_not_applicable")


@query("""
SELECT o_orderstatus AS r, o_orderpriority AS c, count(*) AS n_all, least(count(*), 50) AS n_listed, CAST(list_sum(list_sort(list(o_orderkey))[1:50]) AS BIGINT) AS id_sum
FROM orders GROUP BY ALL
""")
def crosstab_row_ids(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    ids = crosstab.cell_row_ids(orders, BOOK["o_orderstatus"], BOOK["o_orderpriority"], "o_orderkey", most=50)
    found = crosstab.cells(orders, BOOK["o_orderstatus"], BOOK["o_orderpriority"]).join(ids, ["r", "c"])
    total = F.aggregate("row_ids", F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("r", "c", F.col("n").alias("n_all"), F.size("row_ids").cast("long").alias("n_listed"), total.alias("id_sum"))


def _margin(kind: str) -> Query:
    def f(spark, sf_dir):
        return crosstab.margins(read(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], F.round(F.sum("o_totalprice"), 2), kind)

    return f


for _name, _kind, _by in (
    ("cube_margins", "cube", "CUBE (o_orderstatus, o_orderpriority)"),
    ("rollup_margins", "rollup", "ROLLUP (o_orderstatus, o_orderpriority)"),
    ("grouping_sets_margins", "sets", "GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), (o_orderpriority), ())"),
):
    QUERIES[_name] = _margin(_kind)
    ORACLE_SQL[_name] = f"""SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total,
      CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS level FROM orders GROUP BY {_by}"""


@query(f"""
WITH b AS (SELECT * FROM {_RESPONDENTS}), g AS (SELECT DISTINCT c_mktsegment, s AS o_orderstatus FROM customer CROSS JOIN (VALUES ('F'), ('O'), ('P')) v(s)),
k AS (SELECT c_mktsegment, o_orderstatus, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS u, count(*) FILTER (o_orderpriority = '5-LOW') AS l FROM b GROUP BY ALL)
SELECT g.c_mktsegment, g.o_orderstatus, coalesce(n, 0) AS n, coalesce(u, 0) AS n_urgent, coalesce(l, 0) AS n_low, round(coalesce(n, 0) / (SELECT count(*) FROM b), 6) AS share
FROM g LEFT JOIN k USING (c_mktsegment, o_orderstatus)
""")
def mosaic(spark, sf_dir):
    out = crosstab.mosaic(respondents(spark, sf_dir), [BOOK["c_mktsegment"], BOOK["o_orderstatus"]], BOOK["o_orderpriority"])
    return rounded(out.select("c_mktsegment", "o_orderstatus", "n", F.col("`n_1-URGENT`").alias("n_urgent"), F.col("`n_5-LOW`").alias("n_low"), "share"), 6, "share")


# --- answers to several options: a user's events by type


def event_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a user: 1, 0 or 99 (missing) for each event type, and the user's number of events.

    A type is missing for users whose id is divisible by 17 and for the first type of those divisible by 13.
    """
    events = read(spark, sf_dir, "events")
    types = sorted(r["event_type"] for r in events.select("event_type").distinct().collect())
    wide = events.groupBy("user_id").agg(
        F.count("*").cast("double").alias("w"), *(F.max((F.col("event_type") == t).cast("int")).alias(t) for t in types)
    )
    gap = lambda i: (F.col("user_id") % 17 == 0) | ((F.col("user_id") % 13 == 0) & F.lit(i == 0))
    return wide.withColumns({t: F.when(gap(i), 99).otherwise(F.when((F.col("user_id") + i) % 3 == 0, 0).otherwise(F.col(t))) for i, t in enumerate(types)})


def _events_group(spark, sf_dir) -> tuple[DataFrame, Group]:
    flags = event_flags(spark, sf_dir)
    return flags, Group("event", tuple(c for c in flags.columns if c not in ("user_id", "w")), missing=("99",))


_FLAGS = """
WITH ty AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS i FROM (SELECT DISTINCT event_type FROM events)),
us AS (SELECT user_id, count(*) AS w FROM events GROUP BY 1),
f AS (SELECT us.user_id, w, event_type AS o, i, CASE WHEN us.user_id % 17 = 0 OR (us.user_id % 13 = 0 AND i = 0) THEN 'M'
  WHEN (us.user_id + i) % 3 = 0 THEN 'U' ELSE (CASE WHEN EXISTS (SELECT 1 FROM events e WHERE e.user_id = us.user_id AND e.event_type = ty.event_type) THEN 'S' ELSE 'U' END) END AS s FROM us CROSS JOIN ty),
st AS (SELECT user_id, any_value(w) AS w, CASE WHEN count(*) FILTER (s = 'M') = count(*) THEN 'missing' WHEN count(*) FILTER (s = 'M') > 0 THEN 'partial' ELSE 'valid' END AS status,
  count(*) FILTER (s = 'S') AS k FROM f GROUP BY 1),
v AS (SELECT * FROM f JOIN st USING (user_id) WHERE status = 'valid')
"""


@query(_FLAGS + "SELECT status, count(*) AS n FROM st GROUP BY 1")
def mr_statuses(spark, sf_dir):
    return multiresponse.statuses(*_events_group(spark, sf_dir))


@query(_FLAGS + """
, b AS (SELECT count(*) AS n, sum(w) AS w, count(*) FILTER (k = 0) AS z, sum(k) AS k, sum(k * w) AS kw FROM st WHERE status = 'valid')
SELECT CAST(i AS INTEGER) AS place, o AS "option", count(*) FILTER (s = 'S') AS n, CAST(coalesce(sum(v.w) FILTER (s = 'S'), 0) AS DOUBLE) AS weighted_n, max(b.n) AS n_valid, max(b.z) AS n_none,
  round(100.0 * count(*) FILTER (s = 'S') / max(b.n), 6) AS pct_respondents, round(100.0 * count(*) FILTER (s = 'S') / max(b.k), 6) AS pct_responses,
  round(100.0 * coalesce(sum(v.w) FILTER (s = 'S'), 0) / max(b.w), 6) AS weighted_pct_respondents, round(100.0 * coalesce(sum(v.w) FILTER (s = 'S'), 0) / max(b.kw), 6) AS weighted_pct_responses
FROM v CROSS JOIN b GROUP BY i, o
""")
def mr_weighted_summary(spark, sf_dir):
    flags, g = _events_group(spark, sf_dir)
    out = multiresponse.summary(flags, g, F.col("w"))
    return rounded(out, 6, *(c for c in out.columns if "pct" in c))


@query(_FLAGS + """
, b AS (SELECT user_id % 4 AS a, count(*) AS n FROM st WHERE status = 'valid' GROUP BY 1)
SELECT b.a AS part, o AS "option", count(*) FILTER (s = 'S') AS n, max(b.n) AS n_valid FROM v JOIN b ON v.user_id % 4 = b.a GROUP BY ALL
""")
def mr_by_attribute(spark, sf_dir):
    flags, g = _events_group(spark, sf_dir)
    out = multiresponse.summary(flags.withColumn("part", F.col("user_id") % 4), g, by=["part"])
    return out.select("part", "option", "n", "n_valid")


def _mr_match(mode: str, having: str) -> None:
    def f(spark, sf_dir):
        flags, g = _events_group(spark, sf_dir)
        return multiresponse.matching(flags, g, g.options[:2], mode).select("user_id")

    QUERIES[f"mr_match_{mode}"] = f
    ORACLE_SQL[f"mr_match_{mode}"] = _FLAGS + f"SELECT user_id FROM v WHERE i < 2 GROUP BY 1 HAVING count(*) FILTER (s = 'S') {having}"


_mr_match("any", ">= 1")
_mr_match("all", "= 2")
_mr_match("unselected", "= 0")


@query(_FLAGS + "SELECT user_id FROM st WHERE status = 'partial'")
def mr_match_status(spark, sf_dir):
    flags, g = _events_group(spark, sf_dir)
    return multiresponse.matching(flags, g, (), "status", "partial").select("user_id")


@query(_FLAGS + """
SELECT st.user_id, CASE WHEN status = 'valid' THEN CAST(k AS INTEGER) END AS n_selected,
  max(CASE WHEN status = 'valid' THEN CAST(s = 'S' AS INTEGER) END) FILTER (i = 0) AS first FROM st JOIN f USING (user_id) GROUP BY ALL
""")
def ma_axis_projection(spark, sf_dir):
    flags, g = _events_group(spark, sf_dir)
    return multiresponse.axes(flags, g).select("user_id", "n_selected", F.col(f"event_{g.options[0]}").alias("first"))


# --- distributions


@query("""
WITH c AS (SELECT l_discount AS value, count(*) AS ties FROM lineitem GROUP BY 1),
r AS (SELECT value, ties, (sum(ties) OVER (ORDER BY value) - ties + (ties + 1) / 2 - 0.5) / sum(ties) OVER () AS p FROM c)
SELECT value, ties, round(p, 9) AS p, round(1 - 2 * abs(p - 0.5), 9) AS folded FROM r
""")
def folded_edf(spark, sf_dir):
    return rounded(distribution.folded_edf(read(spark, sf_dir, "lineitem"), "l_discount"), 9, "p", "folded")


@query(f"""SELECT unnest([i / 20 FOR i IN range(0, 21)]) AS p, unnest(quantile_cont(c_acctbal, [{", ".join(str(i / 20) for i in range(21))}])) AS value FROM customer""")
def quantile_curve(spark, sf_dir):
    return distribution.quantile_curve(read(spark, sf_dir, "customer"), "c_acctbal", 20)


@query("""
WITH m AS (SELECT avg(l_quantity) AS m, count(*) AS n, median(l_quantity) AS d FROM lineitem),
k AS (SELECT avg((l_quantity - m) ** 2) AS m2, avg((l_quantity - m) ** 3) AS m3, avg((l_quantity - m) ** 4) AS m4 FROM lineitem CROSS JOIN m)
SELECT 'l_quantity' AS "column", n, round(m, 6) AS mean, round(sqrt(m2), 6) AS std, d AS median, round(m3 / m2 ** 1.5, 6) AS skewness, round(m4 / m2 ** 2 - 3, 6) AS kurtosis FROM m CROSS JOIN k
""")
def moment_profile(spark, sf_dir):
    return rounded(distribution.profile(read(spark, sf_dir, "lineitem"), ["l_quantity"]), 6, "mean", "std", "skewness", "kurtosis")


@query("""
WITH c AS (SELECT c_acctbal AS value, count(*) AS ties FROM customer GROUP BY 1)
SELECT value, ties, round((sum(ties) OVER (ORDER BY value) - ties + (ties + 1) / 2 - 0.375) / (sum(ties) OVER () + 0.25), 9) AS p FROM c
""")
def qq_points(spark, sf_dir):
    return rounded(distribution.qq_points(read(spark, sf_dir, "customer"), "c_acctbal"), 9, "p").drop("theoretical")


@query("""
WITH m AS (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer),
g AS (SELECT CAST(least(9, floor((c_acctbal - a) / (b - a) * 10)) AS INTEGER) AS bin, count(*) AS n FROM customer CROSS JOIN m GROUP BY 1)
SELECT bin, round(a + bin * (b - a) / 10, 4) AS low, round(a + (bin + 1) * (b - a) / 10, 4) AS high, n FROM g CROSS JOIN m
""")
def histogram(spark, sf_dir):
    return rounded(distribution.histogram(read(spark, sf_dir, "customer"), "c_acctbal"), 4, "low", "high")


@query("""
WITH m AS (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer)
SELECT c_mktsegment, CAST(least(4, floor((c_acctbal - a) / (b - a) * 5)) AS INTEGER) AS bin, count(*) AS n FROM customer CROSS JOIN m GROUP BY ALL
""")
def grouped_histogram(spark, sf_dir):
    return distribution.histogram(read(spark, sf_dir, "customer"), "c_acctbal", 5, ["c_mktsegment"]).drop("low", "high")


@query("""
WITH q AS (SELECT c_mktsegment, count(*) AS n, quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.5) AS median, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer GROUP BY 1),
f AS (SELECT *, q1 - 0.5 * (q3 - q1) AS lo, q3 + 0.5 * (q3 - q1) AS hi FROM q)
SELECT c_mktsegment, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(lo, 6) AS low_fence, round(hi, 6) AS high_fence,
  min(c_acctbal) FILTER (c_acctbal BETWEEN lo AND hi) AS low_whisker, max(c_acctbal) FILTER (c_acctbal BETWEEN lo AND hi) AS high_whisker,
  count(*) FILTER (c_acctbal NOT BETWEEN lo AND hi) AS n_outside FROM customer JOIN f USING (c_mktsegment) GROUP BY ALL
""")
def box_stats(spark, sf_dir):
    out = distribution.box_stats(read(spark, sf_dir, "customer"), "c_acctbal", ["c_mktsegment"], 0.5)
    return rounded(out, 6, "q1", "median", "q3", "low_fence", "high_fence")


@query("""
WITH g AS (SELECT l_discount AS value, sum(l_quantity) AS w FROM lineitem GROUP BY 1)
SELECT value, w, round((sum(w) OVER (ORDER BY value) - w + w / 2) / sum(w) OVER (), 9) AS p FROM g
""")
def weighted_mid_cdf(spark, sf_dir):
    return rounded(distribution.weighted_positions(read(spark, sf_dir, "lineitem"), "l_discount", "l_quantity"), 9, "p")


@query("""
WITH t AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 7)
SELECT CASE WHEN p_brand IN (SELECT p_brand FROM t) THEN p_brand ELSE 'other' END AS p_brand, count(*) AS n FROM part GROUP BY 1
""")
def level_capping(spark, sf_dir):
    return distribution.top_levels(read(spark, sf_dir, "part"), "p_brand", 8).groupBy("p_brand").agg(F.count("*").alias("n"))


# --- derived columns


@query("""
SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge, CAST(floor(-l_quantity / 7) AS DOUBLE) AS div, -l_quantity - 7 * floor(-l_quantity / 7) AS mod FROM lineitem
""")
def expr_arithmetic(spark, sf_dir):
    out = read(spark, sf_dir, "lineitem")
    for name, text in (("charge", "l_extendedprice * (1 - l_discount) * (1 + l_tax)"), ("div", "-l_quantity // 7"), ("mod", "-l_quantity % 7")):
        out = expr.derive(out, text, name)
    return out.select("l_orderkey", "l_linenumber", F.round("charge", 6).alias("charge"), F.col("div").cast("double").alias("div"), "mod")


@query("""
SELECT l_orderkey, l_linenumber, round(ln(greatest(l_discount, 1e-12)), 6) AS a, round(1 / (1 + exp(-l_tax)), 9) AS b, round(sqrt(l_quantity) + abs(-l_tax), 6) AS c,
  CASE WHEN l_quantity > 10 AND l_quantity <= 30 THEN 1.0 ELSE 0.0 END AS d FROM lineitem
""")
def expr_math(spark, sf_dir):
    out = read(spark, sf_dir, "lineitem")
    for name, text in (("a", "log(l_discount)"), ("b", "sigmoid(l_tax)"), ("c", "sqrt(l_quantity) + abs(-l_tax)"), ("d", "1 if 10 < l_quantity <= 30 else 0")):
        out = expr.derive(out, text, name)
    return out.select("l_orderkey", "l_linenumber", F.round("a", 6).alias("a"), F.round("b", 9).alias("b"), F.round("c", 6).alias("c"), "d")


@query("""
SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS z,
  round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS m,
  round(CASE WHEN c_acctbal >= 0 THEN (sqrt(c_acctbal + 1) - 1) / 0.5 ELSE -((1 - c_acctbal) ** 1.5 - 1) / 1.5 END, 6) AS yj FROM customer
""")
def expr_column_functions(spark, sf_dir):
    out = read(spark, sf_dir, "customer")
    for name, text in (("z", "zscore(c_acctbal)"), ("m", "minmax(c_acctbal)"), ("yj", "yeojohnson(c_acctbal)")):
        out = expr.derive(out, text, name)
    return rounded(out.select("c_custkey", "z", "m", "yj"), 6, "z", "m", "yj")


@query("""
WITH m AS (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b FROM part)
SELECT CAST(least(3, floor((p_retailprice - a) / (b - a) * 4)) AS INTEGER) AS bin, count(*) AS n FROM part CROSS JOIN m GROUP BY 1
""")
def bin_equal_width(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    edges = transform.bin_edges(part, "p_retailprice")
    return part.groupBy(transform.bin_index(F.col("p_retailprice"), edges).alias("bin")).agg(F.count("*").alias("n"))


@query("""
WITH q AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.5) AS b, quantile_cont(c_acctbal, 0.75) AS c FROM customer)
SELECT CASE WHEN c_acctbal < a THEN 'Bin 1' WHEN c_acctbal < b THEN 'Bin 2' WHEN c_acctbal < c THEN 'Bin 3' ELSE 'Bin 4' END AS bin, count(*) AS n FROM customer CROSS JOIN q GROUP BY 1
""")
def bin_quantile(spark, sf_dir):
    customer = read(spark, sf_dir, "customer")
    out = transform.binned(customer, "c_acctbal", transform.bin_edges(customer, "c_acctbal", "quantile"), "bin", "number")
    return out.groupBy("bin").agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN p_size < 10 THEN '[1.00, 10.00)' WHEN p_size < 30 THEN '[10.00, 30.00)' ELSE '[30.00, 50.00]' END AS p_size_bin, count(*) AS n FROM part GROUP BY 1""")
def bin_custom(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    return transform.binned(part, "p_size", transform.bin_edges(part, "p_size", "custom", cuts=[10, 30])).groupBy("p_size_bin").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CAST(o_orderstatus = 'O' AS INTEGER) AS o_orderstatus_O, CAST(o_orderstatus = 'P' AS INTEGER) AS o_orderstatus_P FROM orders""")
def one_hot(spark, sf_dir):
    return transform.one_hot(read(spark, sf_dir, "orders"), "o_orderstatus", drop_first=True).select("o_orderkey", "o_orderstatus_O", "o_orderstatus_P")


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts without the price of each seventh and the size of each eleventh."""
    key = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        "p_partkey", F.when(key % 7 != 0, F.col("p_retailprice")).alias("price"), F.when(key % 11 != 0, F.col("p_size").cast("double")).alias("size")
    )


_GAPPY = "(SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS price, CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_size AS DOUBLE) END AS size FROM part)"


def _fill(strategy: str, sql: str) -> None:
    def f(spark, sf_dir):
        out = transform.fill(gappy(spark, sf_dir), ["price", "size"], strategy, 0.0)
        return rounded(out, 6, "price", "size")

    QUERIES[f"impute_{strategy}"] = f
    ORACLE_SQL[f"impute_{strategy}"] = f"""SELECT p_partkey, round(coalesce(price, (SELECT {sql.format("price")} FROM {_GAPPY})), 6) AS price,
      round(coalesce(size, (SELECT {sql.format("size")} FROM {_GAPPY})), 6) AS size FROM {_GAPPY}"""


_fill("mean", "avg({})")
_fill("median", "median({})")
_fill("constant", "CAST(any_value(0.0) AS DOUBLE)")
QUERIES["impute_mode"] = lambda spark, sf_dir: transform.fill(gappy(spark, sf_dir), ["size"], "mode").select("p_partkey", "size")
ORACLE_SQL["impute_mode"] = f"""WITH m AS (SELECT size FROM {_GAPPY} WHERE size IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, size LIMIT 1)
  SELECT p_partkey, coalesce(g.size, m.size) AS size FROM {_GAPPY} g CROSS JOIN m"""


@query()
def impute_knn(spark, sf_dir):
    return transform.fill_knn(gappy(spark, sf_dir), "price", ["size"], "p_partkey")


@query()
def impute_gaussian(spark, sf_dir):
    return transform.fill_gaussian(gappy(spark, sf_dir), "price", ["size"], "p_partkey")


@query("""SELECT p_partkey, unnest(list_filter([CASE WHEN p_partkey % 7 = 0 THEN 'price' END, CASE WHEN p_partkey % 11 = 0 THEN 'size' END], lambda x: x IS NOT NULL)) AS "column" FROM part""")
def imputation_mask(spark, sf_dir):
    before = gappy(spark, sf_dir)
    return transform.imputed_cells(before, transform.fill(before, ["price", "size"], "mean"), ["price", "size"], "p_partkey")
