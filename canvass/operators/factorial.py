"""Principal components, correspondence analyses and mixed data, each from one small matrix of moments."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.codebook import CodebookError, codes
from canvass.functions.columns import finite
from canvass.plans.primitives import complete, gram, linear


def fixed_signs(v: np.ndarray) -> np.ndarray:
    """Columns turned so that the entry of largest size is positive."""
    at = np.abs(v).argmax(axis=0)
    return v * np.where(v[at, np.arange(v.shape[1])] < 0, -1.0, 1.0)


@dataclass(frozen=True)
class Components:
    names: tuple[str, ...]
    eigenvalues: np.ndarray
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    n: int

    @property
    def ratios(self) -> np.ndarray:
        return self.eigenvalues / self.eigenvalues.sum()

    @property
    def loadings(self) -> np.ndarray:
        return self.vectors * np.sqrt(np.maximum(self.eigenvalues, 0))

    @property
    def kaiser(self) -> int:
        return int((self.eigenvalues > self.eigenvalues.mean() + 1e-12).sum())

    def scores(self, df: DataFrame, k: int) -> DataFrame:
        """Add the first k coordinates of each row."""
        z = [(finite(c) - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(self.names, self.centre, self.scale, strict=True)]
        return df.withColumns({f"pc{j + 1}": linear(self.vectors[:, j], z) for j in range(k)})


def pca(df: DataFrame, columns: Sequence[str], correlation: bool = True) -> Components:
    """Components of the correlation or covariance matrix of the complete rows."""
    g = gram(complete(df, {c: F.col(c) for c in columns}), columns)
    s = g.covariance()
    sd = np.sqrt(np.diag(s)) if correlation else np.ones(len(columns))
    if (sd == 0).any():
        raise CodebookError("a column is constant")
    values, vectors = np.linalg.eigh(s / np.outer(sd, sd))
    return Components(tuple(columns), np.maximum(values[::-1], 0), fixed_signs(vectors[:, ::-1]), g.mean, sd, g.n)


def correspondence(m: np.ndarray) -> dict[str, np.ndarray | float]:
    """Coordinates, contributions and squared cosines of a table with positive margins."""
    p = m / m.sum()
    r, c = p.sum(axis=1), p.sum(axis=0)
    s = (p - np.outer(r, c)) / np.sqrt(np.outer(r, c))
    u, d, vt = np.linalg.svd(s, full_matrices=False)
    keep = d > max(1e-12, np.finfo(float).eps * max(s.shape) * (d[0] if len(d) else 0))
    u, d, v = u[:, keep], d[keep], vt.T[:, keep]
    turned = fixed_signs(v)
    u = u * np.sign((turned * v).sum(axis=0))
    f, g = u * d / np.sqrt(r)[:, None], turned * d / np.sqrt(c)[:, None]
    of_row, of_col = (f**2).sum(axis=1), (g**2).sum(axis=1)
    safe = lambda a, b: np.divide(a, b[:, None], out=np.zeros_like(a), where=b[:, None] > 0)
    return {
        "inertia": float((d**2).sum()), "eigenvalues": d**2, "rows": f, "columns": g,
        "row_contributions": u**2, "column_contributions": turned**2,
        "row_cos2": safe(f**2, of_row), "column_cos2": safe(g**2, of_col), "row_mass": r, "column_mass": c,
    }


@dataclass(frozen=True)
class Indicator:
    names: tuple[str, ...]
    columns: dict[str, Column]
    blocks: tuple[int, ...]


def indicators(df: DataFrame, variables: dict[str, Sequence[str] | None]) -> Indicator:
    """0/1 columns of all levels of nominal variables, null where the variable is."""
    names, columns, blocks = [], {}, []
    for v, levels in variables.items():
        c = codes(df, v)
        levels = levels or sorted(r["c"] for r in df.select(c.alias("c")).where("c IS NOT NULL").distinct().collect())
        blocks.append(len(levels))
        for x in levels:
            names.append(f"{v}={x}")
            columns[f"{v}={x}"] = F.when(c.isNotNull(), F.when(c == x, 1.0).otherwise(0.0))
    return Indicator(tuple(names), columns, tuple(blocks))


def mca(df: DataFrame, variables: dict[str, Sequence[str] | None], weight: str | None = None) -> dict[str, object]:
    """Multiple correspondence analysis from the Burt matrix: category coordinates and eigenvalues, with Benzecri's adjustment."""
    z = indicators(df, variables)
    rows = complete(df, z.columns, None if weight is None else F.col(weight))
    g = gram(rows, z.names)
    m = len(z.blocks)
    burt = (g.cross + g.weight * np.outer(g.mean, g.mean)) / (g.weight * m * m)
    c = burt.sum(axis=1)
    if (c <= 0).any():
        raise CodebookError("a level has no rows")
    s = (burt - np.outer(c, c)) / np.sqrt(np.outer(c, c))
    values, vectors = np.linalg.eigh(s)
    order = values.argsort()[::-1]
    values, vectors = np.maximum(values[order], 0), fixed_signs(vectors[:, order])
    keep = values > 1e-10
    values, vectors = values[keep], vectors[:, keep]
    adjusted = np.where(values > 1 / m, (m / (m - 1) * (values - 1 / m)) ** 2, 0.0) if m > 1 else values
    standard = vectors / np.sqrt(c)[:, None]
    return {
        "names": z.names, "columns": z.columns, "eigenvalues": values, "total_inertia": float(values.sum()), "adjusted": adjusted,
        "coordinates": standard * np.sqrt(values), "standard": standard, "masses": c, "variables": m, "n": g.n,
    }


def mca_scores(df: DataFrame, found: dict[str, object], k: int = 2) -> DataFrame:
    """Row coordinates: the mean of a row's standard category coordinates."""
    z = list(found["columns"].values())
    return df.withColumns({f"dim{j + 1}": linear(found["standard"][:, j] / found["variables"], z) for j in range(k)})


def famd(df: DataFrame, numeric: Sequence[str], nominal: dict[str, Sequence[str] | None], weight: str | None = None) -> dict[str, object]:
    """Mixed data: components of z-scores and of indicators scaled by the root of their share.

    Beside eigenvalues and vectors: correlations of the numbers; barycentres of the levels (their rows' mean scores);
    contributions of columns and of whole variables, which add up to 1 on each axis; and eta2, the share of an axis's
    variance that lies between the levels of a nominal variable.  All of it follows from one matrix of moments.
    """
    z = indicators(df, nominal)
    names = [*numeric, *z.names]
    columns = {**{c: F.col(c) for c in numeric}, **z.columns}
    g = gram(complete(df, columns, None if weight is None else F.col(weight)), names)
    s = g.cross / g.weight
    p = len(numeric)
    scale = np.concatenate([np.sqrt(np.diag(s)[:p]), np.sqrt(g.mean[p:])])
    if (scale <= 0).any():
        raise CodebookError("a column is constant or a level has no rows")
    values, vectors = np.linalg.eigh(s / np.outer(scale, scale))
    values, vectors = np.maximum(values[::-1], 0), fixed_signs(vectors[:, ::-1])
    keep = values > 1e-10
    values, vectors, total = values[keep], vectors[:, keep], float(values.sum())
    square = vectors**2
    ends = p + np.cumsum([0, *z.blocks])
    blocks = np.array([square[a:b].sum(axis=0) for a, b in zip(ends, ends[1:], strict=False)]).reshape(len(z.blocks), len(values))
    return {
        "names": tuple(names), "variables": (*numeric, *nominal), "columns": columns, "eigenvalues": values, "total_inertia": total, "vectors": vectors,
        "correlations": (vectors * np.sqrt(values))[:p], "barycentres": vectors[p:] * values / scale[p:, None], "contributions": square,
        "variable_contributions": np.vstack([square[:p], blocks]), "eta2": blocks * values, "centre": g.mean, "scale": scale, "n": g.n, "weight": g.weight,
    }


def famd_scores(df: DataFrame, found: dict[str, object], k: int = 2, weight: str | None = None) -> DataFrame:
    """Add dim1, dim2, ..., each with the row's contribution to the axis and its share of the row's squared distance (cos2).

    Null where a variable is; a row in the centre has cos2 0 on all axes.
    """
    z = [(c - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(found["columns"].values(), found["centre"], found["scale"], strict=True)]
    w = F.lit(1.0) if weight is None else F.col(weight)
    whole = reduce(lambda a, b: a + b, (v * v for v in z))
    out = df.withColumns({"__whole": whole, **{f"dim{j + 1}": linear(found["vectors"][:, j], z) for j in range(k)}})
    for j in range(k):
        square = F.col(f"dim{j + 1}") * F.col(f"dim{j + 1}")
        share = F.when(F.col("__whole") > 0, square / F.col("__whole")).when(F.col("__whole") == 0, 0.0)
        out = out.withColumns({f"contribution{j + 1}": w * square / F.lit(float(found["weight"] * found["eigenvalues"][j])), f"cos2_{j + 1}": share})
    return out.drop("__whole")


def axis_order(r: np.ndarray, names: Sequence[str], double: bool = True) -> list[str]:
    """Component ordering: take the variable with the largest loading on the first eigenvector, remove it, repeat."""
    names, out = list(names), []
    r = np.nan_to_num(np.asarray(r, dtype=float))
    np.fill_diagonal(r, 1.0)
    while names:
        m = np.nan_to_num(np.corrcoef(r)) if double and len(names) > 1 else r
        i = int(np.abs(np.linalg.eigh(m)[1][:, -1]).round(12).argmax())
        out.append(names.pop(i))
        r = np.delete(np.delete(r, i, 0), i, 1)
    return out


def seriation(r: np.ndarray, names: Sequence[str]) -> list[str]:
    """The order of least sum of 1 - |r| between neighbours, by dynamic programming over subsets."""
    d = 1 - np.abs(np.nan_to_num(r))
    n = len(names)
    best: dict[tuple[int, int], tuple[float, tuple[int, ...]]] = {(1 << i, i): (0.0, (i,)) for i in range(n)}
    for _ in range(n - 1):
        step: dict[tuple[int, int], tuple[float, tuple[int, ...]]] = {}
        for (used, last), (cost, path) in best.items():
            for j in range(n):
                if not used >> j & 1:
                    key, new = (used | 1 << j, j), (round(cost + d[last, j], 12), (*path, j))
                    if key not in step or new < step[key]:
                        step[key] = new
        best = step
    return [names[i] for i in min(best.values())[1]]


def adjacency(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Euclidean distances between min-max scaled columns, from one aggregation."""
    ends = df.agg(*(f(finite(c)) for c in columns for f in (F.min, F.max))).first()
    z = [F.try_divide(finite(c) - ends[2 * i], F.lit(ends[2 * i + 1] - ends[2 * i])) for i, c in enumerate(columns)]
    p = len(columns)
    found = df.agg(*(F.sum((z[i] - z[j]) * (z[i] - z[j])).alias(f"e{i}_{j}") for i in range(p) for j in range(p))).first()
    return np.sqrt(np.array([x or 0.0 for x in found]).reshape(p, p))


def permute_order(d: np.ndarray, names: Sequence[str]) -> list[str]:
    """The best of ceil(p / 2) zig-zag permutations that together put every pair side by side."""
    p = len(names)
    zigzag = [0]
    for k in range(1, p):
        zigzag.append((zigzag[-1] + (k if k % 2 else -k)) % p)
    best, cost = None, np.inf
    for shift in range(-(-p // 2)):
        path = [(i + shift) % p for i in zigzag]
        total = sum(d[a, b] for a, b in zip(path, path[1:], strict=False))
        if total < cost:
            best, cost = path, total
    return [names[i] for i in best]
