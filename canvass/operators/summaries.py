"""Numeric, categorical and question summaries, correlations and covariances."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.codebook import Codebook, CodebookError, Variable, codes, label, position, score, state
from canvass.functions.columns import finite, half_even, ratio
from canvass.plans.primitives import Gram, complete, gram
from canvass.plans.quantiles import exact_quantiles


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row a column: count, missing, min, max, mean, median, std (0 for one value), q1, q3, iqr."""
    aggs, found = [], exact_quantiles(df, {c: finite(c) for c in columns}, [0.25, 0.5, 0.75])
    for c in columns:
        v = finite(c)
        quartiles = [F.lit(q).cast("double") for q in found[c]]
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(v).alias("n"),
                (F.count("*") - F.count(v)).alias("missing"),
                F.min(v).alias("min"),
                F.max(v).alias("max"),
                F.avg(v).alias("mean"),
                quartiles[1].alias("median"),
                F.when(F.count(v) > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0))).alias("std"),
                quartiles[0].alias("q1"),
                quartiles[2].alias("q3"),
                (quartiles[2] - quartiles[0]).alias("iqr"),
            )
        )
    return df.agg(F.array(*aggs).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def _long(df: DataFrame, columns: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """(column, code) rows of several columns."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), codes(df, c).alias("code")) for c in columns))
    return df.select(F.explode(pairs).alias("p"), *extra).select("p.*", *(F.col("__w"),) if extra else ())


def categorical_summary(df: DataFrame, columns: Sequence[str], limit: int | None = None) -> DataFrame:
    """Counts of each code of each column, and the column's totals, most frequent first by ``place``."""
    from pyspark.sql import Window

    counts = _long(df, columns).groupBy("column", "code").agg(F.count("*").alias("n"))
    of = Window.partitionBy("column")
    out = counts.select(
        "*",
        F.row_number().over(of.orderBy(F.col("code").isNull(), F.desc("n"), "code")).alias("place"),
        F.sum(F.when(F.col("code").isNotNull(), F.col("n"))).over(of).alias("n_valid"),
        F.coalesce(F.sum(F.when(F.col("code").isNull(), F.col("n"))).over(of), F.lit(0)).alias("n_null"),
        F.count("code").over(of).alias("n_distinct"),
    ).where("code IS NOT NULL")
    return out if limit is None else out.where(F.col("place") <= limit)


def question_states(df: DataFrame, v: Variable) -> DataFrame:
    """The denominators of a question: total, not applicable, missing, target, invalid, valid."""
    s = state(df, v)
    n = lambda k: F.count_if(s == k)
    return df.agg(
        F.count("*").alias("total"),
        n("not_applicable").alias("not_applicable"),
        n("missing").alias("missing"),
        (F.count("*") - n("not_applicable")).alias("target"),
        n("invalid").alias("invalid"),
        n("valid").alias("valid"),
    )


def question_summary(df: DataFrame, v: Variable, weight: Column | None = None) -> DataFrame:
    """Distribution of a question in declared order, with rows for codes nobody chose.

    Percentages of the valid and of the target rows have one digit, weighted ones four; weights that are null or not
    positive do not count.
    """
    if not v.domain:
        raise CodebookError(f"{v.name}: no codes are declared")
    s, c = state(df, v), codes(df, v.name)
    w = F.lit(1.0) if weight is None else F.when(finite(weight) > 0, finite(weight))
    digits = 1 if weight is None else 4
    counted = (
        df.select(s.alias("s"), c.alias("code"), w.alias("w"))
        .groupBy("s", "code")
        .agg(F.count("*").alias("n"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"))
    )
    levels = df.sparkSession.createDataFrame(
        [(i, x, v.value_labels.get(x, x)) for i, x in enumerate(v.domain)], "place int, code string, label string"
    )
    sums = counted.agg(
        F.sum(F.when(F.col("s") == "valid", F.col("w"))).alias("valid"),
        F.sum(F.when(F.col("s") != "not_applicable", F.col("w"))).alias("target"),
    )
    valid = counted.where("s = 'valid'").select("code", "n", "w")
    out = levels.join(valid, "code", "left").join(F.broadcast(sums))  # sums is one row
    share = lambda of: half_even(100 * ratio(F.coalesce("w", F.lit(0.0)), F.col(of)), digits)
    return out.select(
        "place",
        "code",
        "label",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("w", F.lit(0.0)).alias("weighted_n"),
        share("valid").alias("pct_valid"),
        share("target").alias("pct_target"),
    )


def question_scores(df: DataFrame, v: Variable, weight: Column | None = None) -> DataFrame:
    """Mean, median and quartiles of a question's scores, and its top-2 and bottom-2 boxes in percent of valid rows."""
    x = score(df, v)
    w = F.lit(1.0) if weight is None else F.when(finite(weight) > 0, finite(weight))
    k = len(v.domain)
    q = [F.lit(v).cast("double") for v in exact_quantiles(df, {"x": x.cast("double")}, [0.25, 0.5, 0.75])["x"]]
    has = F.when(x.isNotNull(), w)
    box = lambda cond: half_even(100 * ratio(F.sum(F.when(cond, w)), F.sum(has)), 1)
    return df.agg(
        F.count(x).alias("n"),
        ratio(F.sum(x * w), F.sum(has)).alias("mean"),
        q[0].alias("q1"),
        q[1].alias("median"),
        q[2].alias("q3"),
        *((box(x >= k - 1).alias("top2"), box(x <= 2).alias("bottom2")) if v.scale == "ordinal" and k >= 4 else ()),
    )


def likert_rows(df: DataFrame, items: Sequence[Variable]) -> DataFrame:
    """For each item: percent below, at and above the middle of its scale (the middle is neutral if k is odd)."""
    rows = []
    for v in items:
        place, k = position(v, codes(df, v.name)), len(v.domain)
        n = F.count(place)
        share = lambda cond, n=n: ratio(100 * F.count_if(cond), n)
        rows.append(
            F.struct(
                F.lit(v.name).alias("item"),
                n.alias("n"),
                share(2 * place < k - 1).alias("negative"),
                share(2 * place == k - 1).alias("neutral"),
                share(2 * place > k - 1).alias("positive"),
                share(place >= k - 2).alias("top2"),
            )
        )
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def subset_counts(df: DataFrame, column: str, inside: Column) -> DataFrame:
    """Counts of each code, and of each code among the rows for which inside holds."""
    return df.groupBy(codes(df, column).alias("code")).agg(F.count("*").alias("n"), F.count_if(inside).alias("n_inside"))


def colour_domains(df: DataFrame, columns: Sequence[str], most: int = 20) -> DataFrame:
    """Codes and counts of the columns that have at most ``most`` codes."""
    return categorical_summary(df, columns).where(F.col("n_distinct") <= most).select("column", "code", "n")


def correlation_pairs(df: DataFrame, columns: Sequence[str], weight: Column | None = None, digits: int = 4) -> DataFrame:
    """Pairwise-complete Pearson correlations; null for a constant side."""
    w = F.lit(1.0) if weight is None else finite(weight)
    shift = df.agg(*(F.avg(finite(c)).alias(c) for c in columns)).first()
    # moments about a rounded mean of all values, so that large offsets do not cancel
    out = []
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            x, y = finite(a) - F.lit(shift[a] or 0.0), finite(b) - F.lit(shift[b] or 0.0)
            both = F.when(x.isNotNull() & y.isNotNull() & (w > 0), w)
            s = lambda e, both=both: F.sum(both * e)
            n = F.sum(both)
            cov = s(x * y) - ratio(s(x) * s(y), n)
            vx, vy = s(x * x) - ratio(s(x) * s(x), n), s(y * y) - ratio(s(y) * s(y), n)
            r = F.when((vx > 1e-12) & (vy > 1e-12), half_even(cov / F.sqrt(F.abs(vx * vy)), digits))
            out.append(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.count(both).alias("n"), r.alias("r")))
    return df.agg(F.array(*out).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def focus_pair(df: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """Rows of a pair of columns that have both as finite numbers: key, x, y."""
    pair = df.select(F.col(key).alias("key"), finite(x).alias("x"), finite(y).alias("y"))
    return pair.where(F.col("x").isNotNull() & F.col("y").isNotNull())


def covariance_suite(df: DataFrame, columns: Sequence[str]) -> dict[str, np.ndarray | float | int]:
    """Listwise covariance, correlation, precision and partial correlations; an error if singular (condition > 1e12)."""
    g: Gram = gram(complete(df, {c: F.col(c) for c in columns}), columns)
    if g.n < 2:
        raise CodebookError("fewer than two complete rows")
    sigma = g.covariance()
    condition = float(np.linalg.cond(sigma))
    if not condition <= 1e12:
        raise CodebookError("the covariance matrix is singular")
    precision = np.linalg.inv(sigma)
    d = np.sqrt(np.diag(precision))
    partial = -precision / np.outer(d, d)
    np.fill_diagonal(partial, 1.0)
    return {
        "n": g.n,
        "mean": g.mean,
        "covariance": sigma,
        "correlation": g.correlation(),
        "precision": precision,
        "partial": partial,
        "determinant": float(np.linalg.det(sigma)),
        "trace": float(np.trace(sigma)),
        "condition": condition,
    }


def labelled(df: DataFrame, book: Codebook, columns: Sequence[str]) -> DataFrame:
    """Codes replaced by their labels."""
    return df.withColumns({c: label(df, book[c]) for c in columns})
