"""Feature ranking: several scores of each feature for a target, or without one, and their ranks together.

Methods: ``relief`` (nearest rows of the same and of other classes), ``mutual_information`` (of quintiles and codes),
``forest`` (impurity decrease), ``f`` (ratio of variances) and ``pca`` (loadings on three components).
Without a target, or with one that does not vary, relief gives variances and mutual information the mean |r|.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canvass.codebook import CodebookError, codes
from canvass.functions.columns import finite
from canvass.operators.selection import shuffled_positions
from canvass.plans.primitives import group_moments, wide_agg
from canvass.plans.quantiles import exact_quantiles

METHODS = ("relief", "mutual_information", "forest", "f", "pca")
#: Levels of a nominal feature or of a target.
MAX_LEVELS = 1000
CHUNK = 1024
_NUMBERS = {"double", "float", "long", "integer", "short", "byte", "decimal"}


@dataclass
class Ranking:
    """Raw scores by method and feature (None where a method has none), and what follows from them."""

    task: str
    features: list[str]
    scores: dict[str, list[float | None]]
    redundancy: np.ndarray
    permutation: list[tuple[float, float]] | None = None

    def normalised(self, method: str) -> list[float | None]:
        known = [v for v in self.scores[method] if v is not None]
        width = max(known) - min(known) if known else 0.0
        return [None if v is None else (v - min(known)) / (width if width > 1e-12 else 1.0) for v in self.scores[method]]

    def ranks(self, method: str) -> list[float | None]:
        """1 for the largest score; equal ones share their mean rank."""
        known = [v for v in self.scores[method] if v is not None]
        return [None if v is None else sum(o > v for o in known) + (sum(o == v for o in known) + 1) / 2 for v in self.scores[method]]

    def borda(self) -> list[float]:
        out = [0.0] * len(self.features)
        for m in self.scores:
            ranks = self.ranks(m)
            some = sum(r is not None for r in ranks)
            out = [b + (some - r + 1 if r is not None else 0.0) for b, r in zip(out, ranks, strict=True)]
        return out

    def order(self) -> list[int]:
        """Features from the best: by Borda count, then by mean normalised score."""
        borda, norms = self.borda(), [self.normalised(m) for m in self.scores]
        mean = [float(np.mean([n[i] for n in norms if n[i] is not None] or [0.0])) for i in range(len(self.features))]
        return sorted(range(len(self.features)), key=lambda i: (-borda[i], -mean[i]))

    @property
    def suggested(self) -> int:
        return min(len(self.features), max(2, len(self.features) // 2))

    def table(self, spark: SparkSession) -> DataFrame:
        p, borda, place = len(self.features), self.borda(), {f: i + 1 for i, f in enumerate(self.order())}
        rest = np.where(np.eye(p, dtype=bool), 0.0, self.redundancy).sum(axis=1) / p
        tier = lambda r: "high" if r <= max(1, int(p * 0.35)) else "medium" if r <= max(2, int(p * 0.7)) else "low"
        rows = [(f, place[i], borda[i], tier(place[i]), float(rest[i]), place[i] <= self.suggested, *(self.permutation[i] if self.permutation else (None, None))) for i, f in enumerate(self.features)]
        return spark.createDataFrame(rows, "feature string, rank int, borda double, tier string, redundancy double, suggested boolean, permutation double, permutation_sd double")

    def detail(self, spark: SparkSession) -> DataFrame:
        rows = [
            (f, m, v, n, r)
            for m in self.scores for f, v, n, r in zip(self.features, self.scores[m], self.normalised(m), self.ranks(m), strict=True)
        ]
        return spark.createDataFrame(rows, "feature string, method string, score double, normalised double, rank double")


def infer_task(df: DataFrame, target: str | None) -> str:
    """classification for texts, truth values and at most ten whole numbers, else regression; unsupervised without a target."""
    if target is None:
        return "unsupervised"
    if df.schema[target].dataType.typeName() not in _NUMBERS:
        return "classification"
    v = finite(target)
    few = df.select(v.alias("v")).where("v IS NOT NULL").distinct().limit(11).collect()
    return "classification" if few and len(few) <= 10 and all(r["v"] == int(r["v"]) for r in few) else "regression"


def _levels(df: DataFrame, c: str) -> list[str]:
    found = df.select(F.coalesce(codes(df, c), F.lit("")).alias("c")).distinct().orderBy("c").limit(MAX_LEVELS + 1).collect()
    if len(found) > MAX_LEVELS:
        raise CodebookError(f"{c} has more than {MAX_LEVELS} levels")
    return [r["c"] for r in found]


def _encoded(df: DataFrame, c: str, levels: Sequence[str]) -> Column:
    return (F.array_position(F.array(*map(F.lit, levels)), F.coalesce(codes(df, c), F.lit(""))) - 1).cast("double")


def prepared_features(df: DataFrame, features: Sequence[str], target: str | None, key: str, task: str) -> tuple[DataFrame, list[str], list[int]]:
    """Key, y and x0, x1, ...: nulls of numbers are medians, categories the places of their codes (null is a level); with
    the levels of y, and which features are numbers."""
    numeric = [i for i, f in enumerate(features) if df.schema[f].dataType.typeName() in _NUMBERS]
    wanted = {features[i]: finite(features[i]) for i in numeric} | ({target: finite(target)} if task == "regression" else {})
    middle = {c: v[0] or 0.0 for c, v in exact_quantiles(df, wanted, [0.5]).items()} if wanted else {}
    filled = lambda c: F.coalesce(finite(c), F.lit(middle[c]))
    x = [filled(f) if i in numeric else _encoded(df, f, _levels(df, f)) for i, f in enumerate(features)]
    classes = _levels(df, target) if task == "classification" else []
    y = _encoded(df, target, classes) if task == "classification" else filled(target) if task == "regression" else F.lit(0.0)
    return df.select(F.col(key).alias("key"), y.alias("y"), *(v.alias(f"x{i}") for i, v in enumerate(x))), classes, numeric


def relief(rows: DataFrame, p: int, task: str, k: int = 10, sample: int = 500, seed: int = 42) -> list[float]:
    """ReliefF weights of x0 ... by ``sample`` rows (those of the smallest hashes) against all rows.

    Every task keeps the k nearest rows of each class for each of the sampled rows; one ranking merges these.
    Distances are sums of absolute differences of columns scaled to 0 ... 1, ties go to the smaller hash of the key.
    """
    names = [f"x{i}" for i in range(p)]
    ends = wide_agg(rows, [f(c) for c in names for f in (F.min, F.max)])
    width = [(b - a) or 1.0 for a, b in zip(ends[::2], ends[1::2], strict=True)] if ends[0] is not None else [1.0] * p
    scaled = rows.select("key", F.xxhash64("key", F.lit(seed)).alias("h"), "y", F.array(*((F.col(c) - F.lit(a)) / F.lit(w) for c, a, w in zip(names, ends[::2], width, strict=True))).alias("z"))
    asked = scaled.orderBy("h", "key").limit(sample).collect()
    n = rows.count()
    if len(asked) < 2:
        return [0.0] * p
    points, own = np.array([r["z"] for r in asked]), {r["key"]: i for i, r in enumerate(asked)}
    by_class = task == "classification"

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[float, tuple] = {}
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                some = batch.slice(a, CHUNK)
                z = np.asarray(some.column("z").flatten()).reshape(some.num_rows, p)
                h, y = np.asarray(some.column("h")), np.asarray(some.column("y"))
                d = sum(np.abs(points[:, j, None] - z[None, :, j]) for j in range(p))
                for at, key in enumerate(some.column("key").to_pylist()):
                    if key in own:
                        d[own[key], at] = np.inf
                for c in np.unique(y) if by_class else (0.0,):
                    mine = np.flatnonzero(y == c) if by_class else np.arange(len(y))
                    found = [d[:, mine], np.broadcast_to(h[mine], (len(points), len(mine))), np.broadcast_to(y[mine], (len(points), len(mine))), np.broadcast_to(z[mine], (len(points), len(mine), p))]
                    if c in best:
                        found = [np.concatenate(v, axis=1) for v in zip(best[c], found, strict=True)]
                    order = np.lexsort((found[1], found[0]), axis=1)[:, :k]
                    best[c] = tuple(np.take_along_axis(v, order if v.ndim == 2 else order[..., None], axis=1) for v in found)
        for c, (d, h, y, z) in best.items():
            who, at = np.nonzero(np.isfinite(d))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(who) + 1) * p, type=pa.int32()), pa.array(z[who, at].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(np.full(len(who), c)), pa.array(d[who, at]), pa.array(h[who, at]), pa.array(y[who, at]), lists], names=["q", "c", "d", "h", "y", "z"])

    near = scaled.mapInArrow(nearest, "q long, c double, d double, h long, y double, z array<double>")
    rank = F.row_number().over(Window.partitionBy("q", "c").orderBy("d", "h"))
    near = near.withColumn("r", rank).where(F.col("r") <= k)
    queries = rows.sparkSession.createDataFrame([(i, r["y"], list(r["z"])) for i, r in enumerate(asked)], "q long, qy double, qz array<double>")
    met = near.join(F.broadcast(queries), "q")  # of ``sample`` rows at most
    apart = [F.abs(F.col("z")[j] - F.col("qz")[j]) for j in range(p)]
    if by_class:
        each = met.groupBy("q", "qy", "c").agg(*(F.avg(v).alias(f"d{j}") for j, v in enumerate(apart)))
        share = {r["y"]: r["n"] / n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
        table = rows.sparkSession.createDataFrame(list(share.items()), "y double, share double")
        each = each.join(F.broadcast(table.toDF("c", "pc")), "c").join(F.broadcast(table.toDF("qy", "pq")), "qy")
        weight = F.when(F.col("c") == F.col("qy"), -1.0).otherwise(F.col("pc") / (1 - F.col("pq")))
        sums = wide_agg(each, [F.sum(weight * F.col(f"d{j}")) for j in range(p)])
        return [float(s or 0.0) / len(asked) for s in sums]
    low, high = rows.agg(F.min("y"), F.max("y")).first()
    gap = F.abs(F.col("y") - F.col("qy")) / F.lit((high - low) or 1.0)
    return [float(s or 0.0) / (len(asked) * min(k, n - 1)) for s in wide_agg(met, [F.sum(gap * v) for v in apart])]


def mutual_information(rows: DataFrame, p: int, numeric: Sequence[int], task: str, bins: int = 5) -> list[float]:
    """Of quintiles (or codes) with quintiles (or codes) of the target; all features by one aggregation."""
    cut = [f"x{i}" for i in numeric] + (["y"] if task == "regression" else [])
    edges = exact_quantiles(rows, {c: F.col(c) for c in cut}, [i / bins for i in range(bins + 1)])

    def binned(c: str) -> Column:
        inner = sorted(set(edges[c]))[1:-1] if c in edges else []
        return F.size(F.filter(F.array(*map(F.lit, inner)), lambda e: e <= F.col(c))).cast("double") if c in edges and inner else F.lit(0.0) if c in edges else F.col(c)

    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), binned(f"x{i}").alias("b"), binned("y").alias("y")) for i in range(p))))
    cells = rows.select(pairs.alias("c")).select("c.*").groupBy("f", "b", "y").agg(F.count("*").alias("n"))
    over = lambda *by: F.sum("n").over(Window.partitionBy("f", *by))
    share = F.col("n") / F.col("t")
    each = cells.select("f", "n", over("b").alias("a"), over("y").alias("c"), over().alias("t")).groupBy("f").agg(F.sum(share * F.log(F.col("n") * F.col("t") / (F.col("a") * F.col("c")))).alias("mi"))
    found = {r["f"]: float(r["mi"]) for r in each.collect()}
    return [found.get(i, 0.0) for i in range(p)]


def f_ratios(rows: DataFrame, p: int, numeric: Sequence[int], task: str, r_target: np.ndarray, n: int) -> list[float | None]:
    """Between over within variance for classes, of the regression for numbers; categories have none."""
    out: list[float | None] = [None] * p
    if task == "regression":
        for i in numeric:
            r2 = min(r_target[i] ** 2, 1.0)
            out[i] = float(r2 / (1 - r2) * (n - 2)) if r2 < 1 else float("inf")
        return out
    if not numeric:
        return out
    long = rows.select("y", F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(f"x{i}").alias("v")) for i in numeric))).alias("p")).select("y", "p.*")
    groups: dict[int, list] = {}
    for r in group_moments(long, ["f", "y"], "v").collect():  # features times classes
        groups.setdefault(r["f"], []).append(r)
    for i, g in groups.items():
        total = sum(r["n"] for r in g)
        grand = sum(r["n"] * r["mean"] for r in g) / total
        between = sum(r["n"] * (r["mean"] - grand) ** 2 for r in g) / max(len(g) - 1, 1)
        within = sum((r["n"] - 1) * (r["var"] or 0.0) for r in g) / max(total - len(g), 1)
        out[i] = between / within if within else 0.0
    return out


def pca_dispersion(correlation: np.ndarray, p: int, numeric: Sequence[int]) -> list[float | None]:
    """Squared loadings on the first three components by their shares of variance."""
    out: list[float | None] = [None] * p
    if len(numeric) < 2:
        return out
    values, vectors = np.linalg.eigh(np.nan_to_num(correlation[np.ix_(numeric, numeric)]))
    order = np.argsort(values)[::-1]
    share = np.maximum(values[order], 0) / (np.maximum(values, 0).sum() or 1.0)
    for j, i in enumerate(numeric):
        out[i] = float(sum(share[c] * vectors[j, order[c]] ** 2 for c in range(min(3, len(numeric)))))
    return out


def forest(rows: DataFrame, p: int, task: str, trees: int = 100, seed: int = 42):
    """A fitted random forest (depth 6) over the columns."""
    make = RandomForestClassifier if task == "classification" else RandomForestRegressor
    v = rows.select("y", array_to_vector(F.array(*(f"x{i}" for i in range(p)))).alias("v"))
    return make(featuresCol="v", labelCol="y", numTrees=trees, maxDepth=6, seed=seed).fit(v)


def permutation_importance(model, rows: DataFrame, p: int, task: str, repeats: int = 5, seed: int = 42) -> list[tuple[float, float]]:
    """Mean and spread over repeats of what the score (accuracy, or R squared) loses when a column is permuted.

    A repeat gives every row the values of another row (rows in the order of two hashes are laid side by side); each
    column in turn is taken from there, and all variants are scored in one pass.
    """
    x = F.array(*(f"x{i}" for i in range(p)))
    base = rows.select("key", "y", x.alias("x"))
    placed = shuffled_positions(rows.select("key"), "key", seed)
    one = base.join(placed.select("key", "position"), "key")
    centre, spread = rows.agg(F.avg("y"), F.var_pop("y")).first()
    losses = []
    for r in range(repeats):
        other = base.select("key", F.col("x").alias("o")).join(shuffled_positions(rows.select("key"), "key", seed + 1 + r).select("key", "position"), "key").select("position", "o")
        met = one.join(other, "position")
        taken = F.transform("x", lambda v, i: F.when(i == F.col("j"), F.element_at("o", i + 1)).otherwise(v))
        variants = met.select("y", "x", "o", F.explode(F.sequence(F.lit(-1), F.lit(p - 1))).alias("j"))  # -1: as it is
        scored = model.transform(variants.select("y", "j", array_to_vector(taken).alias("v")))
        score = F.avg((F.col("prediction") == F.col("y")).cast("double")) if task == "classification" else 1 - F.avg((F.col("y") - F.col("prediction")) ** 2) / F.lit(spread or 1.0)
        got = {s["j"]: s["score"] for s in scored.groupBy("j").agg(score.alias("score")).collect()}
        losses.append([got[-1] - got[j] for j in range(p)])
    return [(float(m), float(s)) for m, s in zip(np.mean(losses, axis=0), np.std(losses, axis=0), strict=True)]


def rank_features(
    df: DataFrame, features: Sequence[str], key: str, target: str | None = None, methods: Sequence[str] = METHODS, k: int = 10, sample: int = 500, trees: int = 100, repeats: int = 0, seed: int = 42
) -> Ranking:
    """Scores of all rows; the key is a row's own, rows without a target count as a class (or as the median).

    ``repeats`` asks for permutation importance too, for a forest and 10 rows or more.
    """
    features = [f for f in features if f != target]
    if not features or not set(methods) <= set(METHODS):
        raise CodebookError(f"a ranking needs features, and methods of {METHODS}")
    task = infer_task(df, target)
    rows, classes, numeric = prepared_features(df, features, target, key, task)
    rows, p = rows.cache(), len(features)
    n = rows.count()
    if not n:
        raise CodebookError("no rows to rank by")
    if task == "classification" and len(classes) < 2 or task == "regression" and rows.agg(F.min("y") == F.max("y")).first()[0]:
        task = "unsupervised"
    names = [f"x{i}" for i in range(p)]
    every = [*names, "y"]
    moments = wide_agg(rows, [f(c) for c in every for f in (F.avg, F.var_pop)])
    centred = array_to_vector(F.array(*(F.col(c) - F.lit(m) for c, m in zip(every, moments[::2], strict=True))))  # so that nothing cancels
    correlation = np.nan_to_num(Correlation.corr(rows.select(centred.alias("v")), "v").head()[0].toArray())
    redundancy = np.abs(correlation[:p, :p])
    supervised, scores, importance = task != "unsupervised", {}, None
    if "relief" in methods:
        scores["relief"] = relief(rows, p, task, k, sample, seed) if supervised else [float(v) for v in moments[1 : 2 * p : 2]]
    if "mutual_information" in methods and (supervised or p > 1):
        others = np.where(np.eye(p, dtype=bool), 0.0, redundancy).sum(axis=1) / p
        scores["mutual_information"] = mutual_information(rows, p, numeric, task) if supervised else [float(v) for v in others]
    if "forest" in methods and supervised:
        model = forest(rows, p, task, trees, seed)
        scores["forest"] = [float(v) for v in model.featureImportances.toArray()]
        if repeats and n >= 10:
            importance = permutation_importance(model, rows, p, task, repeats, seed)
    if "f" in methods and supervised:
        scores["f"] = f_ratios(rows, p, numeric, task, correlation[p, :p], n)
    if "pca" in methods or not supervised:
        scores["pca"] = pca_dispersion(correlation, p, numeric)
    rows.unpersist()
    return Ranking(task, list(features), scores, redundancy, importance)
