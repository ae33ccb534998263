"""Shapes of distributions: folded empirical distributions, Q-Q points, histograms, boxes."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canvass.functions import dist
from canvass.functions.columns import finite
from canvass.plans.quantiles import exact_quantiles
from canvass.plans.primitives import value_ranks

SHAPIRO_ROWS = 5000


def folded_edf(df: DataFrame, column: str) -> DataFrame:
    """Distinct values with p = (average rank - 0.5) / n and its fold 1 - 2 |p - 0.5|."""
    ranks = value_ranks(df.select(finite(column).alias("value")), "value")
    n = ranks.agg(F.sum("ties").alias("n"))
    p = (F.col("avg_rank") - 0.5) / F.col("n")
    return ranks.join(F.broadcast(n)).select("value", "ties", p.alias("p"), (1 - 2 * F.abs(p - 0.5)).alias("folded"))


def quantile_curve(df: DataFrame, column: str, grid: int = 100) -> DataFrame:
    """The quantile function at grid + 1 even points."""
    at = [i / grid for i in range(grid + 1)]
    found = exact_quantiles(df, {column: finite(column)}, at)[column]
    return df.sparkSession.createDataFrame([(p, v) for p, v in zip(at, found, strict=True) if v is not None], "p double, value double")


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, population deviation, median, skewness and excess kurtosis (population moments) of each column."""
    rows, middle = [], exact_quantiles(df, {c: finite(c) for c in columns}, [0.5])
    for c in columns:
        v = finite(c)
        rows.append(
            F.struct(
                F.lit(c).alias("column"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
                F.lit(middle[c][0]).cast("double").alias("median"), F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"),
            )
        )
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def normal_quantile(p: Column) -> Column:
    """Quantile of the normal distribution as an expression (Hastings' rational form, error below 4.5e-4)."""
    t = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    x = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    return F.when(p > 0.5, x).otherwise(-x)


def qq_points(df: DataFrame, column: str, position: str = "blom") -> DataFrame:
    """Each distinct value with the plotting position of its average rank and the normal quantile there."""
    ranks = value_ranks(df.select(finite(column).alias("value")), "value")
    n = F.broadcast(ranks.agg(F.sum("ties").alias("n")))
    p = (F.col("avg_rank") - 0.375) / (F.col("n") + 0.25) if position == "blom" else (F.col("avg_rank") - 0.5) / F.col("n")
    return ranks.join(n).select("value", "ties", p.alias("p"), normal_quantile(p).alias("theoretical"))


def qq_line(df: DataFrame, column: str) -> tuple[float, float]:
    """Slope and intercept of the line through the quartiles."""
    q1, q3 = exact_quantiles(df, {column: finite(column)}, [0.25, 0.75])[column]
    z = dist.norm_ppf(0.75)
    slope = (q3 - q1) / (2 * z)
    return slope, (q1 + q3) / 2


def shapiro_wilk(df: DataFrame, column: str) -> tuple[float, float] | None:
    """W and p by Royston's approximation for 4 to SHAPIRO_ROWS values (a bounded number); None beyond."""
    rows = df.select(finite(column).alias("v")).where("v IS NOT NULL").limit(SHAPIRO_ROWS + 1).collect()
    n = len(rows)
    x = np.sort([r["v"] for r in rows])
    if not 4 <= n <= SHAPIRO_ROWS or x[0] == x[-1]:
        return None
    m = np.array([dist.norm_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    c = m / np.sqrt(m @ m)
    u = 1 / math.sqrt(n)
    last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, c[-1]], u)
    a = np.zeros(n)
    if n > 5:
        prior = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, c[-2]], u)
        phi = (m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * prior**2)
        a[2:-2] = m[2:-2] / math.sqrt(phi)
        a[1], a[-2] = -prior, prior
    else:
        phi = (m @ m - 2 * m[-1] ** 2) / (1 - 2 * last**2)
        a[1:-1] = m[1:-1] / math.sqrt(phi)
    a[0], a[-1] = -last, last
    w = float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum())
    if n <= 11:
        g = -2.273 + 0.459 * n
        mu = 0.5440 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3
        sd = math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
        z = (-math.log(g - math.log1p(-w)) - mu) / sd
    else:
        k = math.log(n)
        mu, sd = -1.5861 - 0.31082 * k - 0.083751 * k**2 + 0.0038915 * k**3, math.exp(-0.4803 - 0.082676 * k + 0.0030302 * k**2)
        z = (math.log1p(-w) - mu) / sd
    return w, dist.norm_sf(z)


def histogram(df: DataFrame, column: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Counts in even bins between the column's ends; the last bin is closed."""
    v = finite(column)
    low, high = df.agg(F.min(v), F.max(v)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    span = (high - low) or 1.0
    place = F.least(F.lit(bins - 1), F.floor((v - low) / span * bins)).cast("int")
    return (
        df.where(v.isNotNull())
        .groupBy(*by, place.alias("bin"))
        .agg(F.count("*").alias("n"))
        .select(*by, "bin", (low + F.col("bin") * span / bins).alias("low"), (low + (F.col("bin") + 1) * span / bins).alias("high"), "n")
    )


def box_stats(df: DataFrame, column: str, by: Sequence[str] = (), factor: float = 1.5) -> DataFrame:
    """Quartiles, fences, whiskers (the last values inside the fences) and the number of values outside."""
    base = df.select(*by, finite(column).alias("v")).where("v IS NOT NULL")
    q = base.groupBy(*by).agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count("*").alias("n"))
    q = q.select(*by, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    reach = factor * (F.col("q3") - F.col("q1"))
    q = q.withColumn("low_fence", F.col("q1") - reach).withColumn("high_fence", F.col("q3") + reach)
    joined = base.join(F.broadcast(q), list(by)) if by else base.join(F.broadcast(q))
    inside = F.col("v").between(F.col("low_fence"), F.col("high_fence"))
    return joined.groupBy(*by, "n", "q1", "median", "q3", "low_fence", "high_fence").agg(
        F.min(F.when(inside, F.col("v"))).alias("low_whisker"),
        F.max(F.when(inside, F.col("v"))).alias("high_whisker"),
        F.count_if(~inside).alias("n_outside"),
    )


def weighted_positions(df: DataFrame, value: str, weight: str) -> DataFrame:
    """Weighted plotting positions: (weight below + half of the own weight) / all weight, for each distinct value."""
    from canvass.plans.primitives import running_sum

    v = df.select(finite(value).alias("value"), finite(weight).alias("w")).where("value IS NOT NULL AND w > 0")
    sums = running_sum(v.groupBy("value").agg(F.sum("w").alias("w")), "value", "w")
    total = F.broadcast(sums.agg(F.sum("w").alias("all")))
    return sums.join(total).select("value", "w", ((F.col("before") + F.col("w") / 2) / F.col("all")).alias("p"))


def top_levels(df: DataFrame, column: str, levels: int) -> DataFrame:
    """Keep the levels - 1 most frequent codes of a column (ties by code) and merge the rest into ``other``."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n"))
    top = counts.orderBy(F.desc("__n"), column).limit(levels - 1).select(column, F.lit(True).alias("__top"))
    return (
        df.join(F.broadcast(top), column, "left")
        .withColumn(column, F.when(F.col(column).isNull() | F.col("__top"), F.col(column)).otherwise("other"))
        .drop("__top")
    )


def cumulative_share(df: DataFrame, order: str, value: str) -> DataFrame:
    """Running share of a small table's column, largest first."""
    w = Window.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cumulative", F.sum(value).over(w) / F.sum(value).over(Window.partitionBy()))
