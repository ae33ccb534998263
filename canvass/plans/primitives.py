"""The aggregates that nearly every method reduces to."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canvass.functions.columns import finite

#: Expressions of one aggregation; more are spread over several, each below the size of a generated method.
WIDE = 400
RANK_BUCKETS = 256


@dataclass(frozen=True)
class Gram:
    """Weighted moments of columns over their complete rows."""

    names: tuple[str, ...]
    n: int
    weight: float
    weight_sq: float
    mean: np.ndarray
    cross: np.ndarray  # sums of weighted products of deviations from the mean

    def covariance(self, ddof: int = 1) -> np.ndarray:
        return self.cross / (self.weight - ddof)

    def correlation(self) -> np.ndarray:
        d = np.sqrt(np.diag(self.cross))
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(np.outer(d, d) > 0, self.cross / np.outer(d, d), np.nan)


def complete(df: DataFrame, columns: dict[str, Column], weight: Column | None = None, keep: Sequence[Column | str] = ()) -> DataFrame:
    """Columns as finite doubles and a weight __w; rows with a null in any of them, or without positive weight, go."""
    w = F.lit(1.0) if weight is None else finite(weight)
    out = df.select(*keep, *(finite(c).alias(k) for k, c in columns.items()), w.alias("__w"))
    ok = (F.col("__w") > 0) & F.col("__w").isNotNull()
    for k in columns:
        ok = ok & F.col(k).isNotNull()
    return out.where(ok)


def wide_agg(df: DataFrame, exprs: list[Column]) -> list:
    """The values of many aggregates, WIDE at a time."""
    out: list = []
    for i in range(0, len(exprs), WIDE):
        out += list(df.agg(*(e.alias(f"e{j}") for j, e in enumerate(exprs[i : i + WIDE]))).first())
    return out


def gram(df: DataFrame, names: Sequence[str], weight: str = "__w") -> Gram:
    """Moments of a table from ``complete``: means first, then products of deviations, so that nothing cancels."""
    w = F.col(weight)
    first = wide_agg(df, [F.count("*"), F.sum(w), F.sum(w * w), *(F.sum(w * F.col(x)) for x in names)])
    n, total, squares = first[0], float(first[1] or 0), float(first[2] or 0)
    mean = np.array([float(x or 0) for x in first[3:]]) / (total or 1.0)
    p = len(names)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    dev = [F.col(x) - F.lit(float(m)) for x, m in zip(names, mean, strict=True)]
    cross = np.zeros((p, p))
    for (i, j), v in zip(pairs, wide_agg(df, [F.sum(w * dev[i] * dev[j]) for i, j in pairs]), strict=True):
        cross[i, j] = cross[j, i] = float(v or 0)
    return Gram(tuple(names), int(n), total, squares, mean, cross)


def linear(coefficients: Sequence[float], columns: Sequence[Column | str], intercept: float = 0.0) -> Column:
    """intercept + sum of coefficient * column, as one expression."""
    out = F.lit(float(intercept))
    for b, c in zip(coefficients, columns, strict=True):
        out = out + F.lit(float(b)) * (F.col(c) if isinstance(c, str) else c)
    return out


def quadratic(matrix: np.ndarray, columns: Sequence[Column]) -> Column:
    """x' M x, as one expression."""
    p = len(columns)
    out = F.lit(0.0)
    for i in range(p):
        for j in range(i, p):
            out = out + F.lit(float(matrix[i, j] * (1 if i == j else 2))) * columns[i] * columns[j]
    return out


def bucketed(df: DataFrame, key: str, buckets: int = RANK_BUCKETS) -> DataFrame:
    """Add __bucket: ranges of key of about equal numbers of rows, in the order of key."""
    cuts = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(key, cuts, 20_000)).first()[0] or []
    bounds = sorted(set(found))
    if not bounds:
        return df.withColumn("__bucket", F.lit(0))
    return df.withColumn("__bucket", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(key))))


def running_sum(df: DataFrame, key: str, value: str, by: Sequence[str] = (), to: str = "before", then: Sequence[str] = ()) -> DataFrame:
    """Add the sum of value over all rows with a smaller (key, *then), which must be distinct within by.

    Sums run within ranges of the key and over the ranges' totals: no window spans the table.
    """
    ranged = bucketed(df, key)
    inner = Window.partitionBy(*by, "__bucket").orderBy(key, *then).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*by, "__bucket").agg(F.sum(value).alias("__t"))  # at most RANK_BUCKETS rows a group
    totals = totals.withColumn("__o", F.coalesce(F.sum("__t").over(outer), F.lit(0))).drop("__t")
    return (
        ranged.withColumn("__i", F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .join(totals, [*by, "__bucket"])
        .withColumn(to, F.col("__i") + F.col("__o"))
        .drop("__i", "__o", "__bucket")
    )


def value_ranks(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values with their count and average rank (from 1) within by."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("ties"))
    return running_sum(counts, column, "ties", by).withColumn("avg_rank", F.col("before") + (F.col("ties") + 1) / 2)


def group_moments(df: DataFrame, by: Sequence[str], x: str, weight: str | None = None) -> DataFrame:
    """Count, weight sums, mean and (reliability-weighted) variance of x in each group.

    Squares are taken around the group's mean, so that large values with a small spread keep their variance.
    """
    v = F.col(x)
    if weight is None:
        ok = df.where(v.isNotNull()).groupBy(*by)
        n = F.count("*")
        return ok.agg(n.alias("n"), n.cast("double").alias("w"), n.cast("double").alias("w2"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"))
    w = F.col(weight)
    ok = df.where(v.isNotNull() & (w > 0))
    means = ok.groupBy(*by).agg((F.sum(w * v) / F.sum(w)).alias("__mean")).select(*(F.col(c).alias(f"__by_{c}") for c in by), "__mean")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by))
    sums = ok.join(means, same).groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum(w).alias("w"),
        F.sum(w * w).alias("w2"),
        F.first("__mean").alias("mean"),
        F.sum(w * (v - F.col("__mean")) * (v - F.col("__mean"))).alias("wxx"),
    )
    return sums.withColumn("var", F.try_divide("wxx", F.col("w") - F.col("w2") / F.col("w"))).drop("wxx")
