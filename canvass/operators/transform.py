"""Derived columns: indicators, bins; and missing values filled in."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.codebook import Codebook, CodebookError, codes
from canvass.functions.columns import finite
from canvass.plans.neighbours import CELL, QUERY_CHUNK, nearest, vector
from canvass.plans.quantiles import exact_quantiles
from canvass.plans.primitives import complete, gram

MAX_CATEGORIES = 30


def one_hot(df: DataFrame, column: str, drop_first: bool = False, prefix: str | None = None, nulls: str = "as_missing") -> DataFrame:
    """An integer 0/1 column for each code; null rows stay null, or get a category of their own (as_category)."""
    c = codes(df, column)
    levels = sorted(r["c"] for r in df.select(c.alias("c")).where("c IS NOT NULL").distinct().limit(MAX_CATEGORIES + 1).collect())
    if len(levels) > MAX_CATEGORIES:
        raise CodebookError(f"{column}: more than {MAX_CATEGORIES} categories")
    wanted = levels[1:] if drop_first else levels
    taken, out = set(df.columns), {}
    for level in [*wanted, *(["missing"] if nulls == "as_category" else [])]:
        name = base = f"{prefix or column}_{level}"
        k = 1
        while name in taken:
            k += 1
            name = f"{base}_{k}"
        taken.add(name)
        own = c.isNull() if nulls == "as_category" and level == "missing" and level not in levels else c == level
        indicator = F.when(own, 1).otherwise(0)
        out[name] = F.coalesce(indicator, F.lit(0)) if nulls == "as_category" else F.when(c.isNotNull(), indicator)
    return df.withColumns(out)


def bin_edges(df: DataFrame, column: str, method: str = "equal_width", bins: int = 4, cuts: Sequence[float] | None = None) -> list[float]:
    """Edges of bins: equal_width, quantile (equal ones once) or custom cuts within the column's ends."""
    v = finite(column)
    if method == "quantile":
        edges = sorted({q for q in exact_quantiles(df, {column: v}, [i / bins for i in range(bins + 1)])[column] if q is not None})
    else:
        low, high = df.agg(F.min(v), F.max(v)).first()
        if low is None:
            raise CodebookError(f"{column}: no values")
        if method == "equal_width":
            edges = [low + (high - low) * i / bins for i in range(bins)] + [high] if high > low else [low]
        elif method == "custom":
            edges = sorted({low, high, *(c for c in cuts or () if low < c < high)})
        else:
            raise CodebookError(f"unknown method {method}")
    return edges if len(edges) > 1 else [edges[0] - 0.5, edges[0] + 0.5]


def bin_index(column: Column, edges: Sequence[float]) -> Column:
    """Half-open bins from 0, the last one closed; null outside."""
    out = F.when(column < edges[0], None)
    for i, high in enumerate(edges[1:]):
        out = out.when(column < high, i)
    return out.when(column == edges[-1], len(edges) - 2)


def binned(df: DataFrame, column: str, edges: Sequence[float], name: str | None = None, labels: str = "range") -> DataFrame:
    """Add a column of bin labels: ``[a, b)`` with two digits, or ``Bin k``."""
    i = bin_index(finite(column), edges)
    last = len(edges) - 2
    text = [
        f"[{a:.2f}, {b:.2f}{']' if k == last else ')'}" if labels == "range" else f"Bin {k + 1}"
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))
    ]
    return df.withColumn(name or f"{column}_bin", F.when(i.isNotNull(), F.array(*map(F.lit, text))[F.coalesce(i, F.lit(0))]))


def fill(df: DataFrame, columns: Sequence[str], strategy: str, constant: float | str | None = None) -> DataFrame:
    """Nulls replaced by the column's mean, median, mode (ties: smallest) or a constant."""
    if strategy == "constant":
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(constant)) for c in columns})
    of = {"mean": lambda c: F.avg(finite(c)), "mode": lambda c: F.mode(F.col(c), True)}
    if strategy == "median":
        found = {c: q[0] for c, q in exact_quantiles(df, {c: finite(c) for c in columns}, [0.5]).items()}
    elif strategy in of:
        found = df.agg(*(of[strategy](c).alias(c) for c in columns)).first()
    else:
        raise CodebookError(f"unknown strategy {strategy}")
    if any(found[c] is None for c in columns):
        raise CodebookError("a column has no value to fill in")
    clean = lambda c: F.col(c) if strategy == "mode" else finite(c)
    return df.withColumns({c: F.coalesce(clean(c), F.lit(found[c])) for c in columns})


def fill_knn(df: DataFrame, target: str, features: Sequence[str], key: str, k: int = 5, donor_block: int = CELL, query_block: int = QUERY_CHUNK) -> DataFrame:
    """Missing targets from the k nearest donors (standardised Euclidean, inverse-distance weights).

    Donors are all rows with a target; of equally near ones those with the smallest hash of their key.  Distinct
    feature rows with a missing target visit cells of about ``donor_block`` donors, ``query_block`` rows a task, as far as
    the cells may hold one of their k nearest.  Missing features count as their mean.
    """
    stats = df.agg(*(F.avg(finite(c)).alias(f"m{i}") for i, c in enumerate(features)), *(F.stddev_pop(finite(c)).alias(f"s{i}") for i, c in enumerate(features)), F.count(finite(target)).alias("n")).first()
    if not stats["n"]:
        raise CodebookError(f"{target}: no donor")
    z = [F.coalesce((finite(c) - F.lit(stats[f"m{i}"] or 0.0)) / F.lit(stats[f"s{i}"] or 1.0), F.lit(0.0)) for i, c in enumerate(features)]
    at = vector(*z).alias("__at")
    known, missing = df.where(finite(target).isNotNull()), df.where(finite(target).isNull())
    donors = known.select(at, F.xxhash64(key).alias("__h"), finite(target).alias("__y"))
    near = nearest(donors, ["__h", "__y"], k, len(features), missing.select(at), cell=donor_block, query_chunk=query_block)
    w = lambda s: 1 / (s["__dist"] + F.lit(1e-9))
    total = lambda of: F.aggregate("__near", F.lit(0.0), lambda t, s: t + of(s))
    filled = near.select("__at", (total(lambda s: w(s) * s["__y"]) / total(w)).alias("__filled"))
    open_ = missing.select("*", at).join(filled, "__at").withColumn(target, F.col("__filled"))
    return known.withColumn(target, finite(target)).unionByName(open_.select(*df.columns))


def fill_gaussian(df: DataFrame, target: str, features: Sequence[str], key: str, seed: int = 42, temperature: float = 1.0) -> DataFrame:
    """Missing targets drawn from their normal distribution given the features; the draw depends on key and seed alone."""
    names = [target, *features]
    g = gram(complete(df, {c: F.col(c) for c in names}), names)
    s = g.covariance()
    inner = np.linalg.pinv(s[1:, 1:])
    slope = s[0, 1:] @ inner
    spread = float(np.sqrt(max(s[0, 0] - slope @ s[1:, 0], 0.0))) * temperature
    mean = F.lit(float(g.mean[0]))
    for b, m, c in zip(slope, g.mean[1:], features, strict=True):
        mean = mean + F.lit(float(b)) * F.coalesce(finite(c) - F.lit(float(m)), F.lit(0.0))
    unit = lambda k: (F.pmod(F.xxhash64(key, F.lit(seed), F.lit(k)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    normal = F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * np.pi * unit(2))
    return df.withColumn(target, F.coalesce(finite(target), mean + spread * normal))


def plan_hash(**parts: object) -> str:
    """Digest of an imputation plan: preview and apply must agree on it."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def default_predictors(df: DataFrame, book: Codebook, targets: Sequence[str]) -> list[str]:
    """Numeric columns that are neither targets, ids nor weights."""
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "long", "integer", "short", "byte")}
    return [c for c in df.columns if c in numeric and c not in targets and book[c].role not in ("id", "weight") and book[c].scale != "id"]


def imputed_cells(before: DataFrame, after: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """(row, column) of each cell that was null before and is not after."""
    a = before.select(key, *(F.col(c).isNull().alias(f"__{c}") for c in columns))
    cells = F.array(*(F.when(F.col(f"__{c}") & F.col(c).isNotNull(), F.lit(c)) for c in columns))
    return after.join(a, key).select(key, F.explode(F.array_compact(cells)).alias("column"))


def project_axes(df: DataFrame, columns: Sequence[str], frame: np.ndarray) -> DataFrame:
    """Coordinates of each row on an orthonormal plane (columns x 2), as a grand tour shows it."""
    from canvass.plans.primitives import linear

    return df.withColumns({f"axis{j}": linear(frame[:, j], [finite(c) for c in columns]) for j in range(frame.shape[1])})
