"""Discriminant analysis."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.codebook import CodebookError, codes
from canvass.functions import dist
from canvass.functions.columns import finite
from canvass.plans.primitives import linear, quadratic, wide_agg


@dataclass(frozen=True)
class ClassMoments:
    classes: tuple[str, ...]
    names: tuple[str, ...]
    n: np.ndarray
    mean: np.ndarray
    scatter: np.ndarray  # within each class

    @property
    def within(self) -> np.ndarray:
        return self.scatter.sum(axis=0)

    @property
    def between(self) -> np.ndarray:
        d = self.mean - self.n @ self.mean / self.n.sum()
        return (self.n[:, None] * d).T @ d


def class_moments(df: DataFrame, target: str, columns: Sequence[str]) -> ClassMoments:
    """Counts, means and scatter of complete rows by class: two aggregations."""
    rows = df.select(codes(df, target).alias("__y"), *(finite(c).alias(c) for c in columns)).dropna()
    overall = wide_agg(rows, [F.avg(c) for c in columns])
    dev = [F.col(c) - F.lit(m) for c, m in zip(columns, overall, strict=True)]
    p = len(columns)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    found = rows.groupBy("__y").agg(
        F.count("*").alias("n"), *(F.sum(d).alias(f"s{i}") for i, d in enumerate(dev)), *(F.sum(dev[i] * dev[j]).alias(f"q{i}_{j}") for i, j in pairs)
    )
    found = sorted(found.collect(), key=lambda r: r["__y"])
    if len(found) < 2:
        raise CodebookError("one class only")
    n = np.array([r["n"] for r in found], dtype=float)
    s = np.array([[r[f"s{i}"] for i in range(p)] for r in found])
    q = np.zeros((len(found), p, p))
    for g, r in enumerate(found):
        for i, j in pairs:
            q[g, i, j] = q[g, j, i] = r[f"q{i}_{j}"] - s[g, i] * s[g, j] / n[g]
    return ClassMoments(tuple(r["__y"] for r in found), tuple(columns), n, s / n[:, None] + np.array(overall), q)


def wilks(m: ClassMoments, columns: Sequence[int] | None = None) -> float:
    at = np.ix_(columns, columns) if columns is not None else np.ix_(range(len(m.names)), range(len(m.names)))
    return float(np.linalg.det(m.within[at]) / np.linalg.det((m.within + m.between)[at]))


def rao_f(lam: float, p: int, groups: int, n: float) -> dict[str, float]:
    """Rao's F of Wilks' lambda."""
    d = groups - 1
    s = math.sqrt((p * p * d * d - 4) / (p * p + d * d - 5)) if p * p + d * d > 5 else 1.0
    df1, df2 = p * d, s * (n - 1 - (p + groups) / 2) - (p * d - 2) / 2
    root = lam ** (1 / s)
    f = (1 - root) / root * df2 / df1
    return {"lambda": lam, "f": f, "df1": df1, "df2": df2, "p": dist.f_sf(f, df1, df2)}


def stepwise(m: ClassMoments, enter: float = 0.05) -> list[str]:
    """Forward selection by the partial F of Wilks' lambda."""
    chosen: list[int] = []
    n, g = m.n.sum(), len(m.classes)
    while len(chosen) < len(m.names):
        now = wilks(m, chosen) if chosen else 1.0
        options = []
        for j in set(range(len(m.names))) - set(chosen):
            part = wilks(m, [*chosen, j]) / now
            df2 = n - g - len(chosen)
            f = (1 - part) / part * df2 / (g - 1)
            options.append((f, -j, dist.f_sf(f, g - 1, df2)))
        f, j, p = max(options)
        if p > enter:
            break
        chosen.append(-j)
    return [m.names[j] for j in chosen]


def canonical_axes(m: ClassMoments) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and axes of the between scatter against the within scatter."""
    from canvass.operators.factorial import fixed_signs

    root = np.linalg.cholesky(m.within / (m.n.sum() - len(m.classes)))
    inner = np.linalg.inv(root)
    values, vectors = np.linalg.eigh(inner @ m.between @ inner.T / (m.n.sum() - len(m.classes)))
    k = min(len(m.classes) - 1, len(m.names))
    return values[::-1][:k], fixed_signs((inner.T @ vectors)[:, ::-1][:, :k])


def posterior(df: DataFrame, m: ClassMoments, quadratic_form: bool = False, equal_priors: bool = False) -> DataFrame:
    """Add p_<class> and predicted, as expressions of the columns (linear, or quadratic with own covariances)."""
    g, n = len(m.classes), m.n.sum()
    prior = np.full(g, 1 / g) if equal_priors else m.n / n
    x = [finite(c) for c in m.names]
    scores = []
    for i in range(g):
        s = m.scatter[i] / (m.n[i] - 1) if quadratic_form else m.within / (n - g)
        inv, mu = np.linalg.inv(s), m.mean[i]
        d = linear(inv @ mu, x, math.log(prior[i]) - mu @ inv @ mu / 2)
        scores.append(d - quadratic(inv, x) / 2 - math.log(np.linalg.det(s)) / 2 if quadratic_form else d)
    named = df.withColumns({f"__s{i}": c for i, c in enumerate(scores)})
    best = F.greatest(*(F.col(f"__s{i}") for i in range(g)))
    e = named.withColumns({f"__s{i}": F.exp(F.col(f"__s{i}") - best) for i in range(g)})
    total = sum((F.col(f"__s{i}") for i in range(1, g)), F.col("__s0"))
    out = e.withColumns({f"p_{c}": F.col(f"__s{i}") / total for i, c in enumerate(m.classes)}).drop(*(f"__s{i}" for i in range(g)))
    top = F.greatest(*(F.struct(F.col(f"p_{c}").alias("p"), F.lit(c).alias("c")) for c in m.classes))
    return out.withColumn("predicted", top["c"])
