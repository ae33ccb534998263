"""Measures of association of all pairs of columns, and how surprising they are together.

Rows are taken pair by pair (those with both values), as cells of equal values with their counts.  Ranks come from running
sums over each pair's values, so that Spearman's coefficient is one aggregation over cells.  Kendall's needs the signs of
all pairs of cells: cells in different ranges of both ranks are counted from a grid of ranges, cells that share a
range are compared within it.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.codebook import CodebookError, codes
from canvass.functions.columns import finite
from canvass.operators import mining
from canvass.plans.primitives import group_moments, running_sum

#: Cells that a range of ranks should have, and ranges at most.
RANGE_CELLS, MAX_RANGES = 20_000, 256
_DIRECT = 48
_NUMBERS = {"double", "float", "long", "integer", "short", "byte", "decimal"}


def _sign_sum(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Sum of sign(dx) * sign(dy) * n * n' over all pairs of cells, which are sorted by x."""
    if len(x) <= _DIRECT:
        return float((np.sign(x[:, None] - x) * np.sign(y[:, None] - y) * np.outer(n, n)).sum() / 2)
    middle = x[len(x) // 2]
    cut = int(np.searchsorted(x, middle))
    if cut == 0:
        cut = int(np.searchsorted(x, middle, side="right"))
        if cut == len(x):  # all have one x
            return 0.0
    order = np.argsort(y[cut:], kind="stable")
    right, mass = y[cut:][order], np.concatenate(([0.0], np.cumsum(n[cut:][order])))
    above = mass[-1] - mass[np.searchsorted(right, y[:cut], side="right")]
    below = mass[np.searchsorted(right, y[:cut])]
    return float((n[:cut] * (above - below)).sum()) + _sign_sum(x[:cut], y[:cut], n[:cut]) + _sign_sum(x[cut:], y[cut:], n[cut:])


def _grid_sum(table: np.ndarray) -> float:
    """The same over cells of a grid that differ in both places."""
    later = np.zeros((table.shape[0] + 1, table.shape[1] + 1))
    later[:-1, :-1] = np.cumsum(np.cumsum(table[::-1, ::-1], axis=0), axis=1)[::-1, ::-1]
    earlier = np.zeros((table.shape[0] + 1, table.shape[1] + 1))
    earlier[:-1, 1:] = np.cumsum(np.cumsum(table[::-1], axis=0), axis=1)[::-1]
    return float((table * (later[1:, 1:] - earlier[1:, :-1])).sum())


def ranked_cells(cells: DataFrame) -> DataFrame:
    """Cells (pair, x, y, n) with rx and ry, the average ranks of their values within the pair, and nx and ny, rows of the value."""
    for c in "xy":
        values = cells.groupBy("pair", c).agg(F.sum("n").alias(f"n{c}"))
        ranks = running_sum(values, c, f"n{c}", ["pair"]).select("pair", c, f"n{c}", (F.col("before") + (F.col(f"n{c}") + 1) / 2).alias(f"r{c}"))
        cells = cells.join(ranks, ["pair", c])
    return cells


def rank_correlations(cells: DataFrame, range_cells: int = RANGE_CELLS) -> dict[int, dict[str, float]]:
    """By pair: n, spearman, tau_b, and concordant and discordant pairs of rows (c, d), from its cells (pair, x, y, n).

    None where a side is constant.  The driver sees sums and a grid of at most MAX_RANGES ** 2 counts a pair.
    """
    ranked = ranked_cells(cells).cache()
    sizes = {r["pair"]: r for r in ranked.groupBy("pair").agg(F.sum("n").alias("n"), F.count("*").alias("cells"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("both")).collect()}
    if not sizes:
        return {}
    most = max(r["cells"] for r in sizes.values())
    ranges = int(min(max(-(-most // range_cells), 1), MAX_RANGES))
    rows = cells.sparkSession.createDataFrame([(p, r["n"]) for p, r in sizes.items()], "pair int, total long")
    placed = ranked.join(F.broadcast(rows), "pair")  # of as many rows as there are pairs
    place = lambda c: F.least(F.floor((F.col(c) - 0.5) * ranges / F.col("total")), F.lit(ranges - 1)).cast("int")
    placed = placed.withColumns({"bx": place("rx"), "by": place("ry")})
    dx, dy = (F.col(c) - (F.col("total") + 1) / 2 for c in ("rx", "ry"))
    moments = placed.groupBy("pair").agg(F.sum(F.col("n") * dx * dy).alias("xy"), F.sum(F.col("n") * dx * dx).alias("xx"), F.sum(F.col("n") * dy * dy).alias("yy"))
    found = {r["pair"]: r for r in moments.collect()}
    ties = {}
    for c in "xy":
        for r in ranked.select("pair", c, f"n{c}").distinct().groupBy("pair").agg(F.sum(F.col(f"n{c}") * (F.col(f"n{c}") - 1) / 2).alias("t")).collect():
            ties[r["pair"], c] = float(r["t"])
    signs = dict.fromkeys(sizes, 0.0)

    def within(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rx", "ry"])
        v = _sign_sum(*(rows[c].to_numpy(dtype=float) for c in ("rx", "ry", "n")))
        return pd.DataFrame({"pair": rows["pair"].iloc[:1], "v": [v]})

    for by, sign in ((["pair", "bx"], 1), (["pair", "by"], 1), (["pair", "bx", "by"], -1)):
        near = placed.select("pair", "bx", "by", "rx", "ry", "n").groupBy(*by).applyInPandas(within, "pair int, v double")
        for r in near.groupBy("pair").agg(F.sum("v").alias("v")).collect():
            signs[r["pair"]] += sign * r["v"]
    grids: dict[int, np.ndarray] = {p: np.zeros((ranges, ranges)) for p in sizes}
    for r in placed.groupBy("pair", "bx", "by").agg(F.sum("n").alias("n")).toLocalIterator():
        grids[r["pair"]][r["bx"], r["by"]] = r["n"]
    out = {}
    for p, r in sizes.items():
        s = signs[p] + _grid_sum(grids[p])
        all_ = r["n"] * (r["n"] - 1) / 2
        free = all_ - ties[p, "x"] - ties[p, "y"] + r["both"]  # pairs of rows that differ in both
        under = (all_ - ties[p, "x"]) * (all_ - ties[p, "y"])
        m = found[p]
        out[p] = {
            "n": r["n"],
            "c": (free + s) / 2,
            "d": (free - s) / 2,
            "tau_b": s / float(np.sqrt(under)) if under > 0 else None,
            "spearman": float(m["xy"] / np.sqrt(m["xx"] * m["yy"])) if m["xx"] > 0 and m["yy"] > 0 else None,
        }
    ranked.unpersist()
    return out


def pair_cells(df: DataFrame, pairs: Sequence[tuple[str, str]], place: dict[str, Column] | None = None) -> DataFrame:
    """Cells (pair, x, y, n) of pairs of numbers; a pair is known by its place."""
    of = lambda c: (place or {}).get(c, finite(c))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("pair"), of(a).alias("x"), of(b).alias("y")) for i, (a, b) in enumerate(pairs))))
    rows = df.select(each.alias("p")).select("p.*").where("x IS NOT NULL AND y IS NOT NULL")
    return rows.groupBy("pair", "x", "y").agg(F.count("*").alias("n"))


def correlation_ratios(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> dict[int, float | None]:
    """Eta of (category, number) pairs: the root of the share of variance between categories."""
    if not pairs:
        return {}
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("pair"), codes(df, a).alias("g"), finite(b).alias("v")) for i, (a, b) in enumerate(pairs))))
    rows = df.select(each.alias("p")).select("p.*").where("g IS NOT NULL AND v IS NOT NULL")
    inner = group_moments(rows, ["pair", "g"], "v").groupBy("pair").agg(
        F.sum(F.col("var") * (F.col("n") - 1)).alias("within"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("s")
    )
    whole = group_moments(rows, ["pair"], "v").select("pair", (F.col("var") * (F.col("n") - 1)).alias("total"))
    out: dict[int, float | None] = {}
    for r in inner.join(whole, "pair").collect():  # as many rows as pairs
        total = r["total"] or 0.0
        out[r["pair"]] = float(np.sqrt(max(1 - (r["within"] or 0.0) / total, 0.0))) if total > 0 else None
    return out


def average_order(strength: np.ndarray) -> list[int]:
    """Order of variables along the average-linkage tree of 1 - |strength|."""
    groups: list[list[int]] = [[i] for i in range(len(strength))]
    far = np.clip(1 - np.abs(strength), 0, 1)
    while len(groups) > 1:
        a, b = min(itertools.combinations(range(len(groups)), 2), key=lambda p: (far[np.ix_(groups[p[0]], groups[p[1]])].mean(), p))
        groups[a] = groups[a] + groups[b]
        del groups[b]
    return groups[0] if groups else []


def relations(
    df: DataFrame, columns: Sequence[str], bins: int = 5, cap: float = 5.0, min_n: int = 5, unexpected: str = "combined", weights: tuple[float, float] = (0.5, 0.5), ordinal: Sequence[str] = ()
) -> tuple[DataFrame, list[str]]:
    """One row a pair of columns, the most surprising first, and the order of the columns by average linkage.

    Columns: x, y, n, cramers_v, strength (V less half its noise), pearson, spearman and tau_b of two numbers (tau_b of two
    ordinal columns by their codes' order too), eta of a number and a category, signed (strength with the sign of
    Spearman's), z (of the strength among all pairs), unexpectedness by z / 3, by lift, or the larger (combined), and
    surprise, the weighted sum of strength and unexpectedness.  Pairs with fewer than min_n rows, or a constant side, are left out.
    """
    if unexpected not in ("empirical", "lift", "combined"):
        raise CodebookError(f"unknown mode {unexpected}")
    kinds = {f.name: f.dataType.typeName() in _NUMBERS for f in df.schema.fields}
    base = {(r["x"], r["y"]): r.asDict() for r in mining.surprise(df, columns, bins, cap, min_n).collect()}  # a row a pair
    known = list(base)
    both = [(a, b) for a, b in known if kinds[a] and kinds[b]]
    ranked = [(a, b) for a, b in known if a in ordinal and b in ordinal and not (kinds[a] and kinds[b])]
    place: dict = {}
    for c in {c for p in ranked for c in p if not kinds[c]}:
        levels = [r["c"] for r in df.select(codes(df, c).alias("c")).where("c IS NOT NULL").distinct().orderBy("c").limit(1001).collect()]
        if len(levels) > 1000:
            raise CodebookError(f"{c}: an ordinal column has at most 1000 codes")
        place[c] = F.array_position(F.array(*map(F.lit, levels)), codes(df, c)).cast("double")
    found = rank_correlations(pair_cells(df, [*both, *ranked], place)) if both or ranked else {}
    mixed = [(a, b) if not kinds[a] else (b, a) for a, b in known if kinds[a] != kinds[b]]
    eta = correlation_ratios(df, mixed)
    of_mixed = {frozenset(p): eta.get(i) for i, p in enumerate(mixed)}
    cells = [F.struct(F.lit(i).alias("pair"), F.corr(F.when(finite(b).isNotNull(), finite(a)), F.when(finite(a).isNotNull(), finite(b))).alias("r")) for i, (a, b) in enumerate(both)]
    pearson = {r["pair"]: r["r"] for r in df.agg(F.array(*cells).alias("p")).first()["p"]} if both else {}
    strengths = np.array([base[p]["strength"] for p in known])
    mean, sd = (float(strengths.mean()), float(strengths.std())) if known else (0.0, 0.0)
    rows, at = [], {c: i for i, c in enumerate(columns)}
    matrix = np.eye(len(columns))
    for p in known:
        r, i = base[p], both.index(p) if p in both else None
        j = i if i is not None else len(both) + ranked.index(p) if p in ranked else None
        rho = found[j]["spearman"] if i is not None and j in found else None
        signed = r["strength"] * (-1.0 if rho is not None and rho < 0 else 1.0)
        matrix[at[p[0]], at[p[1]]] = matrix[at[p[1]], at[p[0]]] = signed
        z = (r["strength"] - mean) / sd if sd > 1e-6 else 0.5
        by_z = min(max(z / 3, 0.0), 1.0)
        odd = {"empirical": by_z, "lift": r["unexpectedness"], "combined": max(by_z, r["unexpectedness"])}[unexpected]
        rows.append((*p, r["n"], r["cramers_v"], r["strength"], pearson.get(i) if i is not None else None, rho, found[j]["tau_b"] if j is not None and j in found else None, of_mixed.get(frozenset(p)), signed, z, odd, weights[0] * r["strength"] + weights[1] * odd))
    rows.sort(key=lambda r: (-r[-1], r[0], r[1]))
    schema = "x string, y string, n long, cramers_v double, strength double, pearson double, spearman double, tau_b double, eta double, signed double, z double, unexpectedness double, surprise double"
    return df.sparkSession.createDataFrame(rows, schema), [columns[i] for i in average_order(matrix)]
