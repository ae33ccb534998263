"""Survey designs: weights, linearised variances and design-based tests."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canvass.codebook import CodebookError, Design
from canvass.functions import dist
from canvass.functions.columns import finite, ratio


def weight_diagnostics(df: DataFrame, weight: Column | str) -> DataFrame:
    """Sum, Kish's effective size, coefficient of variation and design effect of positive weights; one pass."""
    w = finite(weight)
    w = F.when(w > 0, w)
    n, s, q = F.count(w), F.sum(w), F.sum(w * w)
    effective = ratio(s * s, q)
    return df.agg(
        n.alias("n"), s.alias("sum_w"), effective.alias("n_eff"), ratio(F.stddev_samp(w), F.avg(w)).alias("cv"), ratio(n, effective).alias("deff")
    )


@dataclass(frozen=True)
class Frame:
    """Rows with __w, __stratum, __psu and __fpc, and what their design allows."""

    rows: DataFrame
    df: int
    lonely: int
    n: int


def design_frame(df: DataFrame, design: Design, row_id: str) -> Frame:
    """Rows of positive weight under a design; PSUs are nested in strata, and without PSU each row is its own.

    A missing stratum, PSU or population size, or one smaller than the sample, is an error.
    """
    w = F.lit(1.0) if design.weight is None else finite(design.weight)
    pick = lambda c: F.lit("") if c is None else F.col(c).cast("string")
    rows = df.select(
        "*",
        w.alias("__w"),
        pick(design.strata).alias("__stratum"),
        (F.col(row_id) if design.psu is None else F.col(design.psu)).cast("string").alias("__psu"),
        (F.lit(None) if design.fpc is None else finite(design.fpc)).cast("double").alias("__fpc"),
    ).where("__w > 0")
    strata = rows.groupBy("__stratum").agg(
        F.count_distinct("__psu").alias("psus"),
        F.count("*").alias("n"),
        F.count_if(F.col("__stratum").isNull() | F.col("__psu").isNull()).alias("missing"),
        F.count_if(F.col("__fpc").isNull()).alias("no_fpc"),
        F.min("__fpc").alias("low"),
        F.max("__fpc").alias("high"),
    )
    s = strata.agg(
        F.sum(F.col("psus") - 1).alias("df"),
        F.count_if(F.col("psus") == 1).alias("lonely"),
        F.sum("n").alias("n"),
        F.sum("missing").alias("missing"),
        F.sum("no_fpc").alias("no_fpc"),
        F.count_if((F.col("low") < F.col("psus")) | (F.col("low") != F.col("high"))).alias("bad_fpc"),
    ).first()
    if not s["n"]:
        raise CodebookError("no row has a positive weight")
    if s["missing"] or (design.fpc is not None and (s["no_fpc"] or s["bad_fpc"])):
        raise CodebookError("the design has missing or impossible values")
    return Frame(rows, int(s["df"]), int(s["lonely"]), int(s["n"]))


def total_covariance(frame: Frame, scores: Sequence[str]) -> np.ndarray:
    """Linearised covariance of the totals of score columns: PSU totals about their stratum means."""
    if frame.lonely:
        raise CodebookError("a stratum has a single PSU")
    psu = frame.rows.groupBy("__stratum", "__psu").agg(*(F.sum(c).alias(c) for c in scores), F.first("__fpc").alias("__fpc"))
    of = Window.partitionBy("__stratum")
    n = F.count("*").over(of)
    scale = n / (n - 1) * (1 - F.coalesce(n / F.col("__fpc"), F.lit(0.0)))
    dev = psu.select(scale.alias("k"), *((F.col(c) - F.avg(c).over(of)).alias(c) for c in scores))
    p = len(scores)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    found = dev.agg(*(F.sum(F.col("k") * F.col(scores[i]) * F.col(scores[j])).alias(f"e{i}_{j}") for i, j in pairs)).first()
    v = np.zeros((p, p))
    for (i, j), x in zip(pairs, found, strict=True):
        v[i, j] = v[j, i] = x or 0.0
    return v


def mean_covariance(frame: Frame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Weighted means and their linearised covariance."""
    total = F.sum("__w")
    found = frame.rows.agg(total, *(F.sum(F.col("__w") * finite(c)) for c in columns)).first()
    w, mean = found[0], np.array([x / found[0] for x in found[1:]])
    names = [f"__u{i}" for i in range(len(columns))]
    rows = frame.rows.withColumns({u: F.col("__w") * (finite(c) - F.lit(float(m))) / w for u, c, m in zip(names, columns, mean, strict=True)})
    return mean, total_covariance(Frame(rows, frame.df, frame.lonely, frame.n), names)


def rao_scott(frame: Frame, row: str, col: str) -> dict[str, float]:
    """Second-order Rao-Scott test of independence of two code columns of a design frame."""
    t = frame.rows.where(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(row, col).agg(F.sum("__w").alias("w"), F.count("*").alias("n")).collect()
    rs, cs = sorted({x[row] for x in t}), sorted({x[col] for x in t})
    if min(len(rs), len(cs)) < 2:
        raise CodebookError("fewer than two rows or columns")
    cells = [(a, b) for a in rs for b in cs]
    w = {(x[row], x[col]): x["w"] for x in t}
    total, n = sum(w.values()), sum(x["n"] for x in t)
    p = np.array([w.get(c, 0.0) / total for c in cells])
    names = [f"__u{i}" for i in range(len(cells))]
    inside = F.col(row).isNotNull() & F.col(col).isNotNull()
    hit = lambda c: F.when((F.col(row) == c[0]) & (F.col(col) == c[1]), 1.0).otherwise(0.0)
    rows = frame.rows.withColumns(
        {u: F.when(inside, F.col("__w") * (hit(c) - F.lit(float(q))) / total).otherwise(0.0) for u, c, q in zip(names, cells, p, strict=True)}
    )
    v = total_covariance(Frame(rows, frame.df, frame.lonely, frame.n), names)
    k, m = len(rs), len(cs)
    table = p.reshape(k, m)
    expected = np.outer(table.sum(axis=1), table.sum(axis=0))
    x2 = n * float(((table - expected) ** 2 / expected).sum())
    # contrasts of the interaction, made orthogonal to the main effects under the fitted cell probabilities
    e_row, e_col = np.eye(k)[:, 1:], np.eye(m)[:, 1:]
    main = np.column_stack([np.ones(k * m), np.kron(e_row, np.ones((m, 1))), np.kron(np.ones((k, 1)), e_col)])
    inter = np.kron(e_row, e_col)
    d = np.diag(expected.ravel())
    c = inter - main @ np.linalg.solve(main.T @ d @ main, main.T @ d @ inter)
    a, b = c.T @ d @ c / n, c.T @ v @ c
    delta = np.linalg.solve(a, b)
    trace, square = float(np.trace(delta)), float(np.trace(delta @ delta))
    f, d1 = x2 / trace, trace**2 / square
    d2 = d1 * frame.df
    return {"f": f, "df1": d1, "df2": d2, "p": dist.f_sf(f, d1, d2), "design_df": frame.df, "x2": x2}


def model_covariance(frame: Frame, scores: Sequence[str], bread: np.ndarray) -> np.ndarray:
    """Taylor covariance of regression coefficients: bread * (design covariance of the scores) * bread."""
    return bread @ total_covariance(frame, scores) @ bread
