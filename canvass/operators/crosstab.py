"""Two-way tables with margins, residuals and inference; mosaics of several variables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canvass.codebook import CodebookError, Variable, codes, state
from canvass.functions import dist
from canvass.functions.columns import finite, half_even, ratio

POLICIES = ("exclude", "include_missing", "separate_not_applicable")
MAX_ROW_IDS = 10_000


def _level(df: DataFrame, v: Variable, policy: str) -> Column:
    """The category that a row falls into under a missing policy; null leaves the row out."""
    if policy not in POLICIES:
        raise CodebookError(f"unknown missing policy {policy}")
    s, c = state(df, v), codes(df, v.name)
    inside = F.when(s.isin("valid", "invalid"), c)  # undeclared codes are categories of a table
    if policy == "exclude":
        return inside
    if policy == "include_missing":
        return F.coalesce(inside, F.lit("__missing__"))
    return F.coalesce(inside, F.when(s == "not_applicable", "__not_applicable__").otherwise("__missing__"))


def cells(
    df: DataFrame, row: Variable, col: Variable, weight: Column | None = None, policy: str = "exclude", row_id: str | None = None
) -> DataFrame:
    """Counts and weights of each cell that occurs: r, c, n, w (a null weight counts in n and adds nothing to w)."""
    w = F.lit(1.0) if weight is None else F.coalesce(finite(weight), F.lit(0.0))
    base = df.select(_level(df, row, policy).alias("r"), _level(df, col, policy).alias("c"), w.alias("w"), *([row_id] if row_id else []))
    return base.where("r IS NOT NULL AND c IS NOT NULL").groupBy("r", "c").agg(F.count("*").alias("n"), F.sum("w").alias("w"))


def _stars(z: Column) -> Column:
    a = F.abs(z)
    return F.when(a >= 3.29, "***").when(a >= 2.58, "**").when(a >= 1.96, "*").otherwise("")


def crosstab(
    df: DataFrame, row: Variable, col: Variable, weight: Column | None = None, policy: str = "exclude"
) -> DataFrame:
    """Each cell, those of declared categories that nobody is in too, with percentages, expectation and residual."""
    found = cells(df, row, col, weight, policy)
    spark = df.sparkSession
    if row.domain and col.domain:
        extra = lambda v: list(v.domain)
        grid = spark.createDataFrame([(a, b) for a in extra(row) for b in extra(col)], "r string, c string")
        found = found.join(grid, ["r", "c"], "full").na.fill({"n": 0, "w": 0.0})
    over = lambda *by: F.sum("w").over(Window.partitionBy(*by))  # noqa: E731  of a table of levels
    t = found.select("*", over("r").alias("row_w"), over("c").alias("col_w"), F.sum("w").over(Window.partitionBy()).alias("all_w"))
    expected = ratio(F.col("row_w") * F.col("col_w"), F.col("all_w"))
    spread = expected * (1 - ratio(F.col("row_w"), F.col("all_w"))) * (1 - ratio(F.col("col_w"), F.col("all_w")))
    z = F.when(spread > 0, (F.col("w") - expected) / F.sqrt(F.when(spread > 0, spread)))
    pct = lambda of: half_even(100 * ratio(F.col("w"), F.col(of)), 2)
    return t.select(
        "r", "c", "n", "w",
        pct("row_w").alias("row_pct"), pct("col_w").alias("col_pct"), pct("all_w").alias("total_pct"),
        expected.alias("expected"), z.alias("adjusted_residual"), F.coalesce(_stars(z), F.lit("")).alias("stars"),
        (expected < 5).alias("small_expected"),
    )


def margins(df: DataFrame, columns: Sequence[str], measure: Column, kind: str = "cube") -> DataFrame:
    """A table with all its margins in one aggregation: kind is cube, rollup or grouping sets of all columns and none."""
    if kind == "sets":
        out = df.groupingSets([tuple(columns), *((c,) for c in columns), ()], *columns)
    else:
        out = df.cube(*columns) if kind == "cube" else df.rollup(*columns)
    return out.agg(F.count("*").alias("n"), measure.alias("total"), F.grouping_id().alias("level"))


def table(found: DataFrame, measure: str = "w") -> tuple[list[str], list[str], np.ndarray]:
    """A cells table as a matrix without empty margins; its size is that of the code lists."""
    rows = found.collect()
    rs, cs = sorted({x["r"] for x in rows}), sorted({x["c"] for x in rows})
    m = np.zeros((len(rs), len(cs)))
    for x in rows:
        m[rs.index(x["r"]), cs.index(x["c"])] = x[measure]
    i, j = m.sum(axis=1) > 0, m.sum(axis=0) > 0
    return [r for r, k in zip(rs, i, strict=True) if k], [c for c, k in zip(cs, j, strict=True) if k], m[i][:, j]


def pearson(m: np.ndarray) -> dict[str, float | None]:
    """Uncorrected chi-square of a table with positive margins; unavailable below two rows or columns."""
    if min(m.shape, default=0) < 2:
        return {"chi2": None, "df": None, "p": None, "v": None}
    n = m.sum()
    expected = np.outer(m.sum(axis=1), m.sum(axis=0)) / n
    chi2 = float(((m - expected) ** 2 / expected).sum())
    df = (m.shape[0] - 1) * (m.shape[1] - 1)
    return {"chi2": chi2, "df": df, "p": dist.chi2_sf(chi2, df), "v": float(np.sqrt(chi2 / (n * (min(m.shape) - 1))))}


def association(found: DataFrame) -> DataFrame:
    """Chi-square and Cramer's V of a cells table, as one row and without leaving Spark."""
    over = lambda *by: F.sum("w").over(Window.partitionBy(*by))
    t = found.where("w > 0").select("*", over("r").alias("a"), over("c").alias("b"), F.sum("w").over(Window.partitionBy()).alias("t"))
    # sum of (O - E)^2 / E over all cells is N * (sum of O^2 / (row * column) - 1)
    s = t.agg(
        F.sum(F.col("w") * F.col("w") / (F.col("a") * F.col("b"))).alias("s"),
        F.max("t").alias("total"),
        F.count_distinct("r").alias("rows"),
        F.count_distinct("c").alias("cols"),
    )
    chi2 = F.col("total") * (F.col("s") - 1)
    small = F.least("rows", "cols") - 1
    return s.select(
        F.when(small > 0, chi2).alias("chi2"),
        F.when(small > 0, (F.col("rows") - 1) * (F.col("cols") - 1)).alias("df"),
        F.when(small > 0, F.sqrt(F.greatest(F.try_divide(chi2, F.col("total") * small), F.lit(0.0)))).alias("cramers_v"),
    )


def cell_row_ids(df: DataFrame, row: Variable, col: Variable, row_id: str, most: int = MAX_ROW_IDS) -> DataFrame:
    """Ids of each cell, the smallest ``most`` of them; the whole list is a filter away (``cell_rows``)."""
    base = df.select(_level(df, row, "exclude").alias("r"), _level(df, col, "exclude").alias("c"), row_id)
    place = F.row_number().over(Window.partitionBy("r", "c").orderBy(row_id))
    return (
        base.where("r IS NOT NULL AND c IS NOT NULL")
        .withColumn("place", place)
        .where(F.col("place") <= most)
        .groupBy("r", "c")
        .agg(F.sort_array(F.collect_list(row_id)).alias("row_ids"))
    )


def cell_rows(df: DataFrame, row: Variable, col: Variable, r: str, c: str) -> DataFrame:
    """All rows of one cell."""
    return df.where((_level(df, row, "exclude") == r) & (_level(df, col, "exclude") == c))


def mosaic(df: DataFrame, variables: Sequence[Variable], target: Variable | None = None) -> DataFrame:
    """Every combination of declared levels with its count, and with target the count of each of its levels."""
    base = df.select(*(_level(df, v, "exclude").alias(v.name) for v in variables), *([_level(df, target, "exclude").alias("__t")] if target else []))
    names = [v.name for v in variables]
    for name in names:
        base = base.where(F.col(name).isNotNull())
    grouped = base.groupBy(*names)
    counts = [F.count("*").alias("n")]
    if target:
        counts += [F.count_if(F.col("__t") == x).alias(f"n_{x}") for x in target.domain]
    found = grouped.agg(*counts)
    grid = df.sparkSession.range(1).select(*(F.array(*map(F.lit, v.domain)).alias(v.name) for v in variables))
    for v in variables:
        grid = grid.withColumn(v.name, F.explode(v.name))
    out = grid.join(found, names, "left").na.fill(0)
    return out.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy())))
