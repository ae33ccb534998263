"""Exact quantiles of whole columns, whatever their number of values.

A sketch brackets each wanted rank, the rows of the bracket are counted value by value, and where those are more than
``VALUES`` another sketch narrows what lies in it.  No task and no driver holds more than a sketch and ``VALUES``
values a bracket; columns with no more rows than that need no sketch.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.plans.primitives import wide_agg

ACCURACY, VALUES = 5_000, 20_000


def _values_at(df: DataFrame, columns: dict[str, Column], ranks: dict[str, list[int]], sizes: dict[str, int], values: int, accuracy: int) -> dict[tuple[str, int], float]:
    """The value at each wanted rank (from 0) of each column."""
    out: dict[tuple[str, int], float] = {}
    # a bracket: column, ranks wanted, bounds (None: open) that are not in it, rows below it, rows within
    open_ = [(c, rs, None, None, 0, sizes[c]) for c, rs in ranks.items() if rs]
    while open_:
        inside = []
        for c, _, lo, hi, _, _ in open_:
            fits = F.lit(True) if lo is None else columns[c] > lo
            inside.append(F.when(fits if hi is None else fits & (columns[c] < hi), columns[c]))
        large = [i for i, b in enumerate(open_) if b[5] > values]
        asked = []
        for i in large:
            _, rs, _, _, below, n = open_[i]
            shares = [min(max((r - below) / (n - 1) + s, 0.0), 1.0) for r in rs for s in (-2.0 / accuracy, 2.0 / accuracy)]
            asked.append(F.percentile_approx(inside[i], F.array(*map(F.lit, shares)), accuracy))
        pairs: list[list[float]] = [[] for _ in open_]
        for i, found in zip(large, wide_agg(df, asked) if asked else [], strict=True):
            pairs[i] = found
        cuts = [sorted(set(p)) for p in pairs]
        # 2 k + 1 is the k-th cut itself, 2 k what lies before it; values count one by one between the cuts of a wanted rank
        within = [{0} if i not in large else {2 * k for lo, hi in zip(p[::2], p[1::2], strict=True) for k in range(cut.index(lo) + 1, cut.index(hi) + 1)} for i, (p, cut) in enumerate(zip(pairs, cuts, strict=True))]
        parts = F.array(*(F.struct(F.lit(i).alias("i"), v.alias("v"), _stretch(v, cut).alias("s")) for i, (v, cut) in enumerate(zip(inside, cuts, strict=True))))
        rows = df.select(F.explode(parts).alias("p")).select("p.*").where("v IS NOT NULL")
        listed = F.lit(False)
        for i, some in enumerate(within):
            if some:
                listed = listed | ((F.col("i") == i) & F.col("s").isin(*some))
        most = sum(values + 2 * len(c) + 1 for c in cuts)
        found = rows.groupBy("i", "s", F.when(listed, F.col("v")).alias("v")).agg(F.count("*").alias("n")).limit(most + 1).collect()
        whole = len(found) <= most
        if not whole:  # too many values: stretches alone, and another round within them
            found = rows.groupBy("i", "s").agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("v")).collect()
        groups: dict[int, list] = {}
        for r in found:
            groups.setdefault(r["i"], []).append(r)
        again = []
        for i, (c, rs, lo, hi, below, _) in enumerate(open_):
            at = below
            for r in sorted(groups.get(i, []), key=lambda r: (r["s"], -np.inf if r["v"] is None else r["v"])):
                mine, k = [x for x in rs if at <= x < at + r["n"]], r["s"] // 2
                if mine and r["s"] % 2:
                    out |= {(c, x): float(cuts[i][k]) for x in mine}
                elif mine and r["v"] is not None:
                    out |= {(c, x): float(r["v"]) for x in mine}
                elif mine:
                    again.append((c, mine, cuts[i][k - 1] if k else lo, cuts[i][k] if k < len(cuts[i]) else hi, at, r["n"]))
                at += r["n"]
        open_ = again
    return out


def _stretch(v: Column, cuts: Sequence[float]) -> Column:
    if not cuts:
        return F.lit(0)
    table = F.array(*map(F.lit, cuts))
    return F.size(F.filter(table, lambda c: c < v)) * 2 + F.array_contains(table, v).cast("int")


def exact_quantiles(df: DataFrame, columns: dict[str, Column], shares: Sequence[float], values: int = VALUES, accuracy: int = ACCURACY) -> dict[str, list[float | None]]:
    """Interpolated quantiles (as ``percentile`` gives them) of finite double columns; None for columns without a value."""
    sizes = dict(zip(columns, map(int, wide_agg(df, [F.count(c) for c in columns.values()])), strict=True))
    places = {c: [s * (n - 1) for s in shares] for c, n in sizes.items() if n}
    ranks = {c: sorted({int(np.floor(p)) for p in at} | {int(np.ceil(p)) for p in at}) for c, at in places.items()}
    found = _values_at(df, columns, ranks, sizes, values, accuracy)
    out: dict[str, list[float | None]] = {c: [None] * len(shares) for c in columns}
    for c, at in places.items():
        out[c] = []
        for p in at:
            low, high = found[c, int(np.floor(p))], found[c, int(np.ceil(p))]
            out[c].append(low if low == high else (np.ceil(p) - p) * low + (p - np.floor(p)) * high)
    return {c: [None if x is None else float(x) for x in v] for c, v in out.items()}
