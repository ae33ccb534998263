"""Rows by predicates, ranges, regions, samples and splits; sets of rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canvass.codebook import CodebookError, codes
from canvass.functions.columns import finite
from canvass.plans.primitives import running_sum

MAX_RANGE, MAX_PAGE = 100_000, 200


def column_match(df: DataFrame, column: str, wanted: str | None) -> DataFrame:
    """Rows whose code is the wanted one; None finds missing codes."""
    return df.where(codes(df, column).eqNullSafe(F.lit(wanted)))


def condition(df: DataFrame, column: str, op: str, value) -> Column:
    """One condition of a rule: <, <=, >, >=, between [low, high), == (as number or text)."""
    number = finite(F.col(column).try_cast("double"))
    if op == "between":
        return (number >= value[0]) & (number < value[1])
    if op == "==":
        return codes(df, column) == str(value)
    ops = {"<": number < value, "<=": number <= value, ">": number > value, ">=": number >= value}
    if op not in ops:
        raise CodebookError(f"unknown operator {op}")
    return ops[op]


def rule(df: DataFrame, conditions: Sequence[tuple[str, str, object]]) -> Column:
    """All conditions of a rule; a null meets none."""
    return reduce(lambda a, b: a & b, (F.coalesce(condition(df, *c), F.lit(False)) for c in conditions), F.lit(True))


def positions(df: DataFrame, key: str, to: str = "position", then: Sequence[str] = ()) -> DataFrame:
    """Number rows from 0 by a key, and rows of equal keys by further columns, which together are unique."""
    return running_sum(df.withColumn("__one", F.lit(1)), key, "__one", to=to, then=then).drop("__one")


def range_of(df: DataFrame, key: str, start: int, stop: int) -> DataFrame:
    """Rows at positions [start, stop) in the order of a key."""
    if stop - start > MAX_RANGE:
        raise CodebookError(f"more than {MAX_RANGE} rows")
    return df.orderBy(key).offset(max(start, 0)).limit(max(0, stop - max(start, 0)))


def page(df: DataFrame, columns: Sequence[str], search: str | None = None, sort: str | None = None, descending: bool = False, key: str = "__rowId__", offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of a table: case-blind search over the columns' text, order by a column (nulls last), then by key."""
    if not 0 < limit <= MAX_PAGE:
        raise CodebookError(f"a page has 1 to {MAX_PAGE} rows")
    rows = df if not search else df.where(reduce(lambda a, b: a | b, (F.contains(F.lower(codes(df, c)), F.lit(search.lower())) for c in columns)))
    order = [] if sort is None else [F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort)]
    return rows.orderBy(*order, key).offset(offset).limit(limit).select(key, *columns)


def in_band(column: str, low: float, high: float) -> Column:
    return finite(column).between(low, high)


def in_rectangle(x: str, y: str, x0: float, x1: float, y0: float, y1: float) -> Column:
    return in_band(x, min(x0, x1), max(x0, x1)) & in_band(y, min(y0, y1), max(y0, y1))


def polyline_crosses(left: Column, right: Column, x0: float, x1: float, y0: float, y1: float) -> Column:
    """Whether the segment from (0, left) to (1, right) meets the rectangle [x0, x1] x [y0, y1]."""
    x0, x1 = max(0.0, min(x0, x1)), min(1.0, max(x0, x1))
    if x0 > x1:
        return F.lit(False)
    at = lambda x: left + (right - left) * x  # noqa: E731  the segment within the band of x is an interval of y
    a, b = at(x0), at(x1)
    return (F.least(a, b) <= max(y0, y1)) & (F.greatest(a, b) >= min(y0, y1))


def nearest_polyline(df: DataFrame, axes: Sequence[Column], at: int, x: float, y: float, key: str, within: float) -> DataFrame:
    """The row whose line between axes at and at + 1 passes closest to a point, if within a distance."""
    a, b = axes[at], axes[at + 1]
    slope = b - a
    t = F.least(F.greatest((x + (y - a) * slope) / (1 + slope * slope), F.lit(0.0)), F.lit(1.0))
    d = F.sqrt((t - x) * (t - x) + (a + slope * t - y) * (a + slope * t - y))
    return df.select(key, d.alias("distance")).where(F.col("distance") <= within).orderBy("distance", key).limit(1)


def combine(current: DataFrame, new: DataFrame, how: str, key: str) -> DataFrame:
    """Selections as sets of ids: replace, add, subtract, toggle, intersect."""
    a, b = current.select(key).distinct(), new.select(key).distinct()
    ways = {
        "replace": lambda: b,
        "add": lambda: a.union(b).distinct(),
        "subtract": lambda: a.join(b, key, "left_anti"),
        "toggle": lambda: a.union(b).groupBy(key).agg(F.count("*").alias("__n")).where("__n = 1").select(key),
        "intersect": lambda: a.join(b, key, "left_semi"),
    }
    if how not in ways:
        raise CodebookError(f"unknown operation {how}")
    return ways[how]()


def by_categories(members: DataFrame, wanted: dict[str, Sequence[str]], every: bool, key: str) -> DataFrame:
    """Ids with a wanted category, of any of the variables or of every one; members has key, variable, category."""
    hit = reduce(lambda a, b: a | b, ((F.col("variable") == v) & F.col("category").isin(*cs) for v, cs in wanted.items()))
    found = members.where(hit).groupBy(key).agg(F.count_distinct("variable").alias("__n"))
    return found.where(F.col("__n") >= (len(wanted) if every else 1)).select(key)


def sample_exact(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, the same for the same seed whatever the partitioning."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def shuffled_positions(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Each id with its place, from 0, in an order drawn from the seed."""
    drawn = df.select(key, F.xxhash64(key, F.lit(seed)).alias("__h"))
    return positions(drawn, "__h", then=[key]).select(key, "position")


def holdout(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """Add part: test for max(1, round(n * share)) rows, else train."""
    n = df.count()
    placed = shuffled_positions(df, key, seed)
    return df.join(placed, key).withColumn("part", F.when(F.col("position") < max(1, round(n * share)), "test").otherwise("train")).drop("position")


def folds(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """Add fold, 0 to k - 1, of sizes that differ by one at most."""
    return df.join(shuffled_positions(df, key, seed), key).withColumn("fold", (F.col("position") % k).cast("int")).drop("position")


def jaccard(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Jaccard and overlap coefficients of two sets of ids."""
    both = a.select(key, F.lit(1).alias("a")).join(b.select(key, F.lit(1).alias("b")), key, "full")
    s = both.agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"))
    return s.select("n_a", "n_b", "n_both", F.try_divide(F.col("n_both"), F.col("n_a") + F.col("n_b") - F.col("n_both")).alias("jaccard"), F.try_divide(F.col("n_both"), F.least("n_a", "n_b")).alias("overlap"))


def borda(scores: DataFrame, item: str, method: str, value: str) -> DataFrame:
    """Rank aggregation over a table of methods' scores: sum of (p - average rank + 1), p items a method."""
    w = Window.partitionBy(method)
    avg_rank = F.rank().over(w.orderBy(F.desc(value))) + (F.count("*").over(Window.partitionBy(method, value)) - 1) / 2
    ranked = scores.withColumn("__r", avg_rank).withColumn("__p", F.count("*").over(w))
    return ranked.groupBy(item).agg(F.sum(F.col("__p") - F.col("__r") + 1).alias("borda"), F.avg("__r").alias("mean_rank"))
