"""Clusters of rows with categories under learned distances of categories.

Two categories of a column are as far apart as the categories of the other columns that they come with differ: half the
sum of absolute differences of their shares.  Every cluster learns such distances from its own rows, blended with those
of all rows, and rows go to the cluster whose prototype (commonest categories, means of numbers) is nearest.  A round is
one pass over the rows that assigns and counts at once; the driver sees counts of pairs of levels, whose number
``MAX_LEVELS`` bounds.  Starts are chosen among the commonest patterns of categories, each far from those before it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.codebook import CodebookError, codes
from canvass.functions.columns import finite
from canvass.operators.transform import bin_index
from canvass.plans.primitives import wide_agg
from canvass.plans.quantiles import exact_quantiles
from canvass.plans.storage import dropped, stored

#: Levels of all columns together, and patterns that starts are chosen from.
MAX_LEVELS, PATTERNS = 500, 1000
MISSING = "__missing__"


@dataclass
class Model:
    """Prototypes (a level for each column), means of numbers, and the distances of levels by cluster."""

    columns: list[str]
    levels: list[list[str]]
    begin: np.ndarray
    distances: np.ndarray  # cluster, level, level
    prototypes: np.ndarray  # cluster, column: place among all levels
    means: np.ndarray  # cluster, number
    weight: float
    sizes: np.ndarray
    rounds: int = 0
    converged: bool = False

    def gaps(self, at: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Distance of rows (places of their levels, numbers) to each cluster."""
        out = np.zeros((len(at), len(self.prototypes)))
        for c, proto in enumerate(self.prototypes):
            for j in range(at.shape[1]):
                out[:, c] += self.distances[c, at[:, j], proto[j]]
            for i in range(z.shape[1]):
                out[:, c] += self.weight * (z[:, i] - self.means[c, i]) ** 2
        return out

    def table(self, df: DataFrame) -> DataFrame:
        """Distances of each two levels of a column in each cluster."""
        rows = []
        for c in range(len(self.prototypes)):
            for j, name in enumerate(self.columns):
                a = int(self.begin[j])
                for i, x in enumerate(self.levels[j]):
                    rows += [(c, name, x, y, float(self.distances[c, a + i, a + k])) for k, y in enumerate(self.levels[j])]
        return df.sparkSession.createDataFrame(rows, "cluster int, column string, a string, b string, distance double")


def contexts(pairs: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of other columns' levels beside each level, from counts of pairs of levels; and which levels occur."""
    out = pairs.astype(float)
    for a, b in zip(begin, begin[1:], strict=False):
        out[a:b, a:b] = 0
    total = out.sum(axis=1)
    return out / np.where(total > 0, total, 1)[:, None], np.diag(pairs) > 0


def level_distances(shares: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Distances of levels of the same column; 0 for levels of different ones, which never meet.

    With one column nothing is beside its levels, and different ones are 1 apart."""
    out = np.zeros((len(shares), len(shares)))
    for a, b in zip(begin, begin[1:], strict=False):
        out[a:b, a:b] = 0.5 * np.abs(shares[a:b, None] - shares[None, a:b]).sum(axis=2) if len(begin) > 2 else 1 - np.eye(b - a)
    return out


def _encoded(df: DataFrame, numeric: Sequence[str], nominal: Sequence[str], key: str, bins: int) -> tuple[DataFrame, list[str], list[list[str]], list[str]]:
    """Key, c (places of levels among those of their column) and z (standardised numbers, nulls as means)."""
    columns: dict = {c: codes(df, c) for c in nominal}
    if not nominal:  # numbers alone become categories
        edges = exact_quantiles(df, {c: finite(c) for c in numeric}, [i / bins for i in range(bins + 1)])
        for c in numeric:
            cut = sorted({e for e in edges[c] if e is not None})
            columns[c] = bin_index(finite(c), cut if len(cut) > 1 else [cut[0] - 0.5, cut[0] + 0.5]).cast("string") if cut else F.lit(None).cast("string")
    levels = []
    for v in columns.values():
        found = df.select(F.coalesce(v, F.lit(MISSING)).alias("c")).distinct().orderBy("c").limit(MAX_LEVELS + 1).collect()
        levels.append([r["c"] for r in found])
    if sum(map(len, levels)) > MAX_LEVELS:
        raise CodebookError(f"columns have more than {MAX_LEVELS} levels")
    numbers = list(numeric) if nominal else []
    stats = wide_agg(df, [f(finite(c)) for c in numbers for f in (F.avg, F.stddev_pop)]) if numbers else []
    z = [F.coalesce((finite(c) - F.lit(m or 0.0)) / F.lit(s or 1.0), F.lit(0.0)) for c, m, s in zip(numbers, stats[::2], stats[1::2], strict=True)]
    place = lambda v, names: (F.array_position(F.array(*map(F.lit, names)), F.coalesce(v, F.lit(MISSING))) - 1).cast("int") if names else F.lit(0)
    rows = df.select(
        F.col(key).alias("__key"),
        F.array(*(place(v, names) for v, names in zip(columns.values(), levels, strict=True))).alias("c"),
        F.array(*z).cast("array<double>").alias("z"),
    )
    return rows, list(columns), levels, numbers


def _rows(batch: pa.RecordBatch, begin: np.ndarray, numbers: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.asarray(batch.column("c").flatten()).reshape(batch.num_rows, -1) + begin[:-1]
    return at, np.asarray(batch.column("z").flatten(), dtype=float).reshape(batch.num_rows, numbers)


def _counted(rows: DataFrame, begin: np.ndarray, numbers: int, model: Model | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each cluster (of all rows without a model): counts of pairs of levels, sums of numbers, rows."""
    n, p = int(begin[-1]), len(begin) - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, sums = np.zeros((k, n * n)), np.zeros((k, numbers + 1))
        for batch in batches:
            at, z = _rows(batch, begin, numbers)
            to = model.gaps(at, z).argmin(axis=1) if model else np.zeros(len(at), dtype=np.int64)
            for c in range(k):
                mine = at[to == c]
                for i in range(p):
                    for j in range(p):
                        pairs[c] += np.bincount(mine[:, i] * n + mine[:, j], minlength=n * n)
                sums[c] += np.append(z[to == c].sum(axis=0), len(mine))
        c, at = np.nonzero(pairs)
        d, which = np.nonzero(sums)
        cells = [np.concatenate(v) for v in ((c, d), (at, n * n + which), (pairs[c, at], sums[d, which]))]
        yield pa.RecordBatch.from_arrays([pa.array(cells[0]), pa.array(cells[1]), pa.array(cells[2])], names=["cluster", "cell", "v"])

    found = rows.mapInArrow(count, "cluster long, cell long, v double").groupBy("cluster", "cell").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((k, n * n + numbers + 1))
    for r in found:
        out[r["cluster"], r["cell"]] = r["v"]
    return out[:, : n * n].reshape(k, n, n), out[:, n * n : -1], out[:, -1]


def _starts(rows: DataFrame, distance: np.ndarray, begin: np.ndarray, numbers: int, k: int, weight: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Patterns of levels, with the means of their rows' numbers: the commonest, then by count times distance from those chosen."""
    means = [F.avg(F.col("z")[i]).alias(f"m{i}") for i in range(numbers)]
    found = rows.groupBy("c").agg(F.count("*").alias("n"), *means).orderBy(F.desc("n"), "c").limit(PATTERNS).collect()
    at = np.array([r["c"] for r in found]).reshape(len(found), len(begin) - 1) + begin[:-1]
    z = np.array([[r[f"m{i}"] for i in range(numbers)] for r in found]).reshape(len(found), numbers)
    n, chosen = np.array([r["n"] for r in found], dtype=float), [0] if found else []
    apart = lambda i: distance[at, at[i]].sum(axis=1) + weight * ((z - z[i]) ** 2).sum(axis=1)
    least = apart(0) if found else np.zeros(0)
    while len(chosen) < min(k, len(found)):
        best = int((n * least).argmax())
        if least[best] <= 0:
            break
        chosen.append(best)
        least = np.minimum(least, apart(best))
    return [(at[i], z[i]) for i in chosen]


def disc(df: DataFrame, numeric: Sequence[str], nominal: Sequence[str], k: int, key: str, rounds: int = 50, bins: int = 5, smooth: float = 0.6, weight: float = 1.0) -> tuple[DataFrame, Model]:
    """Keys with cluster, and the model.

    With nominal columns numbers count by their squared standardised distances (times weight); without any they are cut
    at quantiles.  Nulls are a level of their own, or the mean.  There are fewer clusters than k where there are fewer
    patterns; a cluster that loses all rows keeps its prototype.  An empty table gives no rows.
    """
    if not numeric and not nominal:
        raise CodebookError("clusters need a column")
    encoded, columns, levels, numbers = _encoded(df, numeric, nominal, key, bins)
    begin, q = np.cumsum([0, *map(len, levels)]), len(numbers)
    rows = stored(encoded, "levels")
    pairs, _, _ = _counted(rows, begin, q, None, 1)
    whole, _ = contexts(pairs[0], begin)
    base = level_distances(whole, begin)
    starts = _starts(rows, base, begin, q, k, weight)
    k = max(len(starts), 1)
    protos = np.array([s[0] for s in starts], dtype=np.int64).reshape(len(starts), len(columns))
    model = Model(columns, levels, begin, np.tile(base, (k, 1, 1)), protos, np.array([s[1] for s in starts]).reshape(len(starts), q), weight, np.zeros(k))
    before = None
    for turn in range(rounds if starts else 0):
        pairs, sums, sizes = _counted(rows, begin, q, model, k)
        state = (pairs.tobytes(), sizes.tobytes())
        model.sizes, model.rounds = sizes, turn + 1
        if state == before:
            model.converged = True
            break
        before = state
        means, protos, distances = model.means.copy(), model.prototypes.copy(), model.distances.copy()
        for c in np.flatnonzero(sizes):
            means[c] = sums[c] / sizes[c]
            counts = np.diag(pairs[c])
            protos[c] = [a + counts[a:b].argmax() for a, b in zip(begin, begin[1:], strict=False)]
            if sizes[c] > 1:
                own, seen = contexts(pairs[c], begin)
                distances[c] = level_distances(np.where(seen[:, None], smooth * own + (1 - smooth) * whole, whole), begin)
        model.means, model.prototypes, model.distances = means, protos, distances

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = model.gaps(*_rows(batch, begin, q)).argmin(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("__key"), pa.array(to)], names=["__key", "cluster"])

    schema = rows.select("__key").withColumn("cluster", F.lit(0)).schema
    found = stored(rows.mapInArrow(label, schema), "labels")
    dropped(rows)
    return found.withColumnRenamed("__key", key), model
