"""Clusterings and their quality; outliers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.codebook import CodebookError, codes
from canvass.functions.columns import finite
from canvass.plans.neighbours import CELL, nearest, vector
from canvass.plans.pairs import Squares, met, packed, whole_blocks
from canvass.plans.primitives import running_sum
from canvass.plans.quantiles import exact_quantiles
from canvass.plans.storage import dropped, stored

#: Rows of a block where all pairs meet block by block.
PAIR_BLOCK = 4096


def prepared(df: DataFrame, columns: Sequence[str], scaling: str = "none") -> tuple[DataFrame, list[str]]:
    """Columns x0, x1, ... with nulls as means, scaled by none, zscore or minmax; empty and constant columns go."""
    stats = df.agg(*(f(finite(c)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_samp), ("a", F.min), ("b", F.max)))).first()
    kept = [i for i in range(len(columns)) if stats[f"n{i}"] and stats[f"a{i}"] < stats[f"b{i}"]]
    if not kept:
        raise CodebookError("no column varies")
    out = {}
    for j, i in enumerate(kept):
        v = F.coalesce(finite(columns[i]), F.lit(stats[f"m{i}"]))
        if scaling == "zscore":
            v = (v - F.lit(stats[f"m{i}"])) / F.lit(stats[f"s{i}"] or 1.0)
        elif scaling == "minmax":
            v = (v - F.lit(stats[f"a{i}"])) / F.lit(stats[f"b{i}"] - stats[f"a{i}"])
        out[f"x{j}"] = v
    return df.withColumns(out), list(out)


def _vectors(df: DataFrame, x: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(x), outputCol="__v").transform(df)


#: Rows that first centres are drawn from.
SEED_ROWS = 4000


def _first_centres(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Points drawn one after the other by their squared distance from those drawn before."""
    chosen = [int(rng.integers(len(points)))]
    least = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        total = least.sum()
        chosen.append(int(rng.choice(len(points), p=least / total)) if total > 0 else int(rng.integers(len(points))))
        least = np.minimum(least, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def _assigned_sums(rows: DataFrame, centres: np.ndarray) -> np.ndarray:
    """By start and cluster: rows, sums of coordinates, and squared distances."""
    starts, k, d = centres.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((starts, k, d + 2))
        for batch in batches:
            x = np.asarray(batch.column("v").flatten(), dtype=float).reshape(batch.num_rows, d)
            for s in range(starts):
                gap = distances(x, centres[s]) ** 2
                to = gap.argmin(axis=1)
                member = np.eye(k)[to]
                out[s, :, 0] += member.sum(axis=0)
                out[s, :, 1:-1] += member.T @ x
                out[s, :, -1] += np.bincount(to, weights=gap[np.arange(len(to)), to], minlength=k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size)), pa.array(out.ravel())], names=["cell", "v"])

    found = rows.mapInArrow(sums, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(centres.size + 2 * starts * k)
    for r in found:
        out[r["cell"]] = r["v"]
    return out.reshape(starts, k, d + 2)


def kmeans(df: DataFrame, x: Sequence[str], k: int, seed: int = 42, starts: int = 10, rounds: int = 300, tol: float = 1e-4) -> tuple[DataFrame, float]:
    """Rows with cluster, and the inertia of the best of several starts.

    All starts that still move go through the rows together: a round is one pass and one small aggregation.  First
    centres come from SEED_ROWS rows (those of the smallest hashes); a cluster without rows keeps its centre.
    """
    rows = df.select(F.array(*(F.col(c).cast("double") for c in x)).alias("v")).cache()
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("v", F.lit(seed)), "v").limit(SEED_ROWS).collect()]).reshape(-1, len(x))
    if not len(sample):
        rows.unpersist()
        return df.withColumn("cluster", F.lit(0)), 0.0
    centres = np.stack([_first_centres(sample, k, np.random.default_rng(seed + s)) for s in range(starts)])
    limit = tol * float(sample.var(axis=0).mean())
    moving, inertia = list(range(starts)), np.full(starts, np.inf)
    for _ in range(rounds):
        sums = _assigned_sums(rows, centres[moving])
        still = []
        for s, found in zip(moving, sums, strict=True):
            inertia[s] = found[:, -1].sum()
            new = np.where(found[:, :1] > 0, found[:, 1:-1] / np.maximum(found[:, :1], 1), centres[s])
            if ((new - centres[s]) ** 2).sum() > limit:
                still.append(s)
            centres[s] = new
        moving = still
        if not moving:
            break
    inertia = _assigned_sums(rows, centres)[:, :, -1].sum(axis=1)
    best = int(inertia.argmin())
    rows.unpersist()
    return df.withColumn("cluster", _nearest_of(centres[best], [F.col(c).cast("double") for c in x])), float(inertia[best])


def _nearest_of(centres: np.ndarray, x: Sequence[Column]) -> Column:
    """The place of the nearest centre, the first of equals."""
    far = [F.struct(reduce(lambda a, b: a + b, (F.pow(v - F.lit(float(m)), 2) for v, m in zip(x, centre, strict=True))).alias("d"), F.lit(i).alias("i")) for i, centre in enumerate(centres)]
    return F.least(*far)["i"] if len(far) > 1 else F.lit(0)


def divisive(df: DataFrame, x: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """Bisecting 2-means of the largest cluster until there are k."""
    v = _vectors(df, x)
    return BisectingKMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(v).transform(v).drop("__v")


def gaussian_mixture(df: DataFrame, x: Sequence[str], k: int, seed: int = 42) -> tuple[DataFrame, dict[str, float]]:
    v = _vectors(df, x)
    m = GaussianMixture(k=k, seed=seed, featuresCol="__v", predictionCol="cluster", maxIter=200).fit(v)
    p, n, loglik = len(x), v.count(), m.summary.logLikelihood
    free = k * (p + p * (p + 1) / 2) + k - 1
    return m.transform(v).drop("__v", "probability"), {"loglik": loglik, "aic": 2 * free - 2 * loglik, "bic": np.log(n) * free - 2 * loglik}


def class_variable(df: DataFrame, column: str) -> DataFrame:
    """Clusters numbered by the sorted codes of a column."""
    c = codes(df, column)
    levels = df.select(c.alias("__c")).where("__c IS NOT NULL").distinct().withColumn("cluster", F.dense_rank().over(Window.orderBy("__c")) - 1)
    return df.withColumn("__c", c).join(F.broadcast(levels), "__c", "left").drop("__c")


def distances(a: np.ndarray, b: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    if metric == "cityblock":
        return np.abs(a[:, None] - b[None]).sum(axis=2)
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def _swap_costs(blocks: DataFrame, block: int, medoids: np.ndarray, width: int, metric: str, first: int, building: bool) -> tuple[float, int, int] | None:
    """Cheapest of all candidates: its cost over all rows, the medoid that it replaces (or joins, when building), its number.

    Candidates are the rows of the first blocks.  A pair of blocks gives each candidate its cost where no medoid goes and,
    for each medoid, what its rows cost more when they fall back on their second nearest one; a task adds these up.
    """
    k = 1 if building else len(medoids)

    def costs(pairs):
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        rests: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def rest(i: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Distances to the nearest and the second nearest medoid, and whose rows they are."""
            if i not in rests:
                if not len(medoids):
                    rests[i] = np.full(len(x), np.inf), np.full(len(x), np.inf), np.zeros((len(x), 0))
                else:
                    to = distances(x, medoids, metric)
                    own = to.argmin(axis=1)
                    near = to[np.arange(len(x)), own]
                    to[np.arange(len(x)), own] = np.inf
                    rests[i] = near, to.min(axis=1), np.eye(len(medoids))[own]
            return rests[i]

        def add(i: int, who: np.ndarray, at: slice, d: np.ndarray, near: np.ndarray, second: np.ndarray, member: np.ndarray, axis: int) -> None:
            """Rows along an axis meet the candidates ``at`` along the other one."""
            kept = np.minimum(d, near, out=spare[0][: len(d), : d.shape[1]])
            found = sums.setdefault(i, (who, np.zeros((len(who), k))))[1]
            found[at] += kept.sum(axis=axis)[:, None]
            if not building:
                more = np.minimum(d, second, out=spare[1][: len(d), : d.shape[1]])
                more -= kept
                found[at] += more @ member if axis else (member.T @ more).T

        spare = np.empty((2, 64, block))  # as much as a core's cache holds
        for (i, who, p), (j, other, q) in pairs:
            d2 = Squares(p, q) if metric == "euclidean" else None
            for s in range(0, len(p), 64):
                if d2:
                    d = d2[s : s + 64]
                    np.sqrt(np.maximum(d, 0, out=d), out=d)
                else:
                    d = distances(p[s : s + 64], q, metric)
                add(i, who, slice(s, s + 64), d, *rest(j, q), 1)
                if i != j and j < first:
                    near, second, member = (v[s : s + 64] for v in rest(i, p))
                    add(j, other, slice(None), d, near[:, None], second[:, None], member, 0)
        for who, found in sums.values():
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.FixedSizeListArray.from_arrays(found.ravel(), k).cast(pa.list_(pa.float64()))], names=["number", "s"])

    with whole_blocks(blocks.sparkSession, width, block):
        total = met(blocks, costs, "number long, s array<double>", first).select("number", *(F.col("s")[i].alias(f"s{i}") for i in range(k)))
        total = total.groupBy("number").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(k)))
        best = total.agg(*(F.min(F.struct(F.col(f"s{i}").alias("cost"), F.lit(i).alias("i"), "number")).alias(f"b{i}") for i in range(k))).first()
    found = [tuple(r) for r in best if r is not None]
    return min(found) if found else None


def kmedoids(
    df: DataFrame, x: Sequence[str], k: int, key: str, metric: str = "euclidean", candidates: int | None = None, swaps: int = 100, block: int = PAIR_BLOCK
) -> DataFrame:
    """Partition around medoids: greedy building, then the best swap while there is one; adds cluster, the nearest medoid.

    Costs are those of all rows.  Every row may become a medoid, which takes all pairs of rows block by block;
    ``candidates`` bounds them to so many rows by the hash of their key, and the work is then in proportion to the table.
    One copy of the rows is written.  The key is a row's own, of an ordered type.  Values are not null.  With fewer rows
    than k some clusters are empty.
    """
    width = len(x)
    vectors = df.select(F.col(key).alias("__key"), F.array(*(F.col(c).cast("double") for c in x)).alias("at")).withColumn("one", F.lit(1))
    rows = stored(running_sum(vectors, "__key", "one", to="number").select("__key", F.col("number").cast("long").alias("number"), "at"), "numbered")
    n = rows.count()
    ahead = np.arange(0)  # numbers of candidates, where they are bounded
    if candidates is not None:
        ahead = np.sort([r[0] for r in rows.orderBy(F.xxhash64("__key"), "__key").limit(candidates).select("number").collect()]).astype(np.int64)
    first = -(-(n if candidates is None else len(ahead)) // block)

    def own(number: np.ndarray) -> np.ndarray:
        if candidates is None:
            return number // block
        at = np.searchsorted(ahead, number)
        chosen = ahead[np.minimum(at, len(ahead) - 1)] == number if len(ahead) else np.zeros(len(number), dtype=bool)
        return np.where(chosen, at // block, first + (number - at) // block)

    blocks = packed(rows, own, n // block + 1, width)
    medoids, cost = np.empty((0, width)), np.inf
    place = lambda number: rows.where(F.col("number") == int(number)).select("at").first()[0]
    for _ in range(k):
        best = _swap_costs(blocks, block, medoids, width, metric, first, True)
        if best is None:
            break
        medoids, cost = np.vstack([medoids, place(best[2])]), best[0]
    for _ in range(swaps if len(medoids) else 0):
        best = _swap_costs(blocks, block, medoids, width, metric, first, False)
        if best[0] >= cost - 1e-9 * max(cost, 1.0):
            break
        medoids[best[1]], cost = place(best[2]), best[0]
    dropped(blocks)
    dropped(rows)
    gap = lambda m, c: F.abs(F.col(c) - F.lit(float(m))) if metric == "cityblock" else F.pow(F.col(c) - F.lit(float(m)), 2)
    far = [F.struct(reduce(lambda a, b: a + b, (gap(v, c) for v, c in zip(m, x, strict=True))).alias("d"), F.lit(i).alias("i")) for i, m in enumerate(medoids)]
    return df.withColumn("cluster", F.least(*far)["i"] if len(far) > 1 else F.lit(0))


def _block_pairs(rows: DataFrame, key: str, block: int) -> tuple[DataFrame, DataFrame]:
    """Each row with one block of rows for every other, on both sides: what meets is two blocks of a bounded size."""
    n = rows.count() // block + 1
    own, each = F.pmod(F.xxhash64(key), F.lit(n)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return rows.withColumn("__q", own).withColumn("__d", each), rows.withColumn("__d", own).withColumn("__q", each)


def silhouette(df: DataFrame, x: Sequence[str], cluster: str, key: str, block: int = PAIR_BLOCK) -> DataFrame:
    """Exact silhouette of every row: key, cluster, silhouette; 0 for fewer than two clusters or single rows.

    Rows meet in pairs of blocks that give each row its sum of distances to each cluster; an aggregation adds these up.
    The key is a row's own.  Rows without a cluster are left out; an empty table gives no rows.
    """
    names = [f"__x{i}" for i in range(len(x))]
    rows = df.where(F.col(cluster).isNotNull()).select(F.col(key).alias("__key"), F.col(cluster).cast("int").alias("__c"), *(F.col(c).cast("double").alias(n) for c, n in zip(x, names, strict=True)))

    def sums(queries: pa.Table, others: pa.Table) -> pa.Table:
        which, at = np.unique(others.column("__c").to_numpy(), return_inverse=True)
        q, o = (np.column_stack([t.column(c).to_numpy() for c in names]) for t in (queries, others))
        member = np.eye(len(which))[at] if len(which) else np.zeros((0, 0))
        found = np.zeros((len(q), len(which)))
        for a in range(0, len(q), 64):
            d = np.zeros((len(q[a : a + 64]), len(o)))
            for i in range(q.shape[1]):
                d += (q[a : a + 64, i, None] - o[:, i]) ** 2
            found[a : a + 64] = np.sqrt(d) @ member
        who = pa.array(np.repeat(np.arange(len(q)), len(which)))
        out = queries.select(["__key", "__c"]).take(who)
        out = out.append_column("__other", pa.array(np.tile(which, len(q)).astype(np.int32))).append_column("__sum", pa.array(found.ravel()))
        return out.append_column("__n", pa.array(np.tile(member.sum(axis=0).astype(np.int64), len(q))))

    schema = T.StructType([*rows.select("__key", "__c").schema, *(T.StructField(n, t) for n, t in (("__other", T.IntegerType()), ("__sum", T.DoubleType()), ("__n", T.LongType())))])
    queries, others = _block_pairs(rows, "__key", block)
    met = queries.groupBy("__q", "__d").cogroup(others.groupBy("__q", "__d")).applyInArrow(sums, schema)
    total = met.groupBy("__key", "__c", "__other").agg(F.sum("__sum").alias("s"), F.sum("__n").alias("n"))
    own = F.col("__other") == F.col("__c")
    each = total.groupBy("__key", "__c").agg(
        F.max(F.when(own, F.try_divide(F.col("s"), F.col("n") - 1))).alias("a"),
        F.min(F.when(~own, F.col("s") / F.col("n"))).alias("b"),
        F.max(F.when(own, F.col("n"))).alias("own"),
    )
    good = (F.col("own") > 1) & F.col("b").isNotNull() & (F.greatest("a", "b") > 0)
    value = F.when(good, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    return each.select(F.col("__key").alias(key), F.col("__c").alias("cluster"), value.alias("silhouette"))


def same_partition(df: DataFrame, a: str, b: str) -> bool:
    """Whether two labels group rows alike, whatever their names."""
    pairs = df.select(a, b).distinct()
    r = pairs.agg(F.count("*"), F.count_distinct(a), F.count_distinct(b)).first()
    return r[0] == r[1] == r[2]


# --- outliers


def iqr_outliers(df: DataFrame, columns: Sequence[str], factor: float = 1.5) -> DataFrame:
    """Add outlier: outside the fences of any column."""
    q = exact_quantiles(df, {c: finite(c) for c in columns}, [0.25, 0.75])
    out = F.lit(False)
    for c, (a, b) in q.items():
        if a is None:
            continue
        out = out | F.coalesce((finite(c) < a - factor * (b - a)) | (finite(c) > b + factor * (b - a)), F.lit(False))
    return df.withColumn("outlier", out)


def robust_z_outliers(df: DataFrame, columns: Sequence[str], threshold: float = 3.5) -> DataFrame:
    """Add robust_z, the largest |x - median| / (1.4826 MAD) (deviation where MAD is 0), and outlier."""
    centre = [q[0] for q in exact_quantiles(df, {c: finite(c) for c in columns}, [0.5]).values()]
    spread = [q[0] or 0.0 for q in exact_quantiles(df, {c: F.abs(finite(c) - F.lit(m)) for c, m in zip(columns, centre, strict=True)}, [0.5]).values()]
    spread += list(df.agg(*(F.stddev_samp(finite(c)) for c in columns)).first())
    k = len(columns)
    z = [
        F.abs(finite(c) - F.lit(centre[i])) / F.lit(1.4826 * spread[i] or spread[k + i] or 1.0)
        for i, c in enumerate(columns)
    ]
    worst = F.greatest(*z) if k > 1 else z[0]
    return df.withColumn("robust_z", worst).withColumn("outlier", F.coalesce(worst > threshold, F.lit(False)))


def isolation_scores(df: DataFrame, x: Sequence[str], key: str, trees: int = 100, subsample: int = 256, contamination: float = 0.05, seed: int = 42) -> DataFrame:
    """Add isolation (mean depth of random splits, turned into a score) and outlier, the top share of it.

    Trees grow on ``trees * subsample`` rows at most, taken by hash, and go to every task; rows are scored in batches.
    """
    rows = df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(trees * subsample).select(*x).collect()
    points = np.array([list(r) for r in rows], dtype=float)
    rng = np.random.default_rng(seed)
    size = min(subsample, len(points))
    depth = max(1, int(np.ceil(np.log2(max(size, 2)))))

    def norm(n: float) -> float:
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def grow(p: np.ndarray, level: int):
        spread = np.flatnonzero(p.max(axis=0) > p.min(axis=0)) if len(p) > 1 else []
        if level == depth or not len(spread):
            return level + norm(len(p))
        f = int(rng.choice(spread))
        cut = rng.uniform(p[:, f].min(), p[:, f].max())
        return f, cut, grow(p[p[:, f] <= cut], level + 1), grow(p[p[:, f] > cut], level + 1)

    forest = df.sparkSession.sparkContext.broadcast([grow(points[rng.choice(len(points), size, replace=False)], 0) for _ in range(trees)])

    def lengths(tree, p: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
        if not isinstance(tree, tuple):
            out[at] += tree
        elif len(at):
            f, cut, left, right = tree
            below = p[at, f] <= cut
            lengths(left, p, at[below], out)
            lengths(right, p, at[~below], out)

    @F.pandas_udf("double")
    def isolation(*columns: pd.Series) -> pd.Series:
        p = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        out = np.zeros(len(p))
        for tree in forest.value:
            lengths(tree, p, np.arange(len(p)), out)
        return pd.Series(2.0 ** (-out / trees / max(norm(size), 1e-9)))

    scored = stored(df.withColumn("isolation", isolation(*x)), "isolation")
    limit = scored.agg(F.percentile_approx("isolation", 1 - contamination, 10_000)).first()[0]
    return scored.withColumn("outlier", F.col("isolation") > F.lit(limit))


def local_outlier_factor(df: DataFrame, x: Sequence[str], key: str, k: int = 20, contamination: float = 0.05, block: int = CELL) -> DataFrame:
    """Exact factors of every row: key, lof, outlier (above the quantile that leaves the top share).

    The k nearest of each distinct point come from cells of about ``block`` rows (of equally near ones those with the
    smallest keys), and two joins by key look up distances and densities.  The key is a row's own and of an ordered type;
    values are not null.  One row alone has factor 1; an empty table gives no rows.  The links (k a row) are written to
    the shared folder.
    """
    rows = df.select(F.col(key).alias("__key"), vector(*(F.col(c) for c in x)).alias("__at"))
    near = nearest(rows, ["__key"], k + 1, len(x), cell=block)  # a row is among its own, unless k + 1 others are alike
    others = F.slice(F.filter("__near", lambda f: f["__key"] != F.col("__own")), 1, k)
    links = rows.withColumnRenamed("__key", "__own").join(near, "__at").select("__own", F.explode(others).alias("__f"))
    links = links.select(F.col("__own").alias("__key"), F.col("__f.__key").alias("__near"), F.col("__f.__dist").alias("__dist"))
    links = stored(links, "links")
    limit = links.groupBy("__key").agg(F.max("__dist").alias("__limit")).withColumnRenamed("__key", "__near")
    reach = F.greatest("__dist", "__limit")
    density = links.join(limit, "__near").groupBy("__key").agg((1 / (F.avg(reach) + 1e-10)).alias("__density"))
    around = links.join(density.select(F.col("__key").alias("__near"), F.col("__density").alias("__other")), "__near").groupBy("__key").agg(F.avg("__other").alias("__around"))
    factors = density.join(around, "__key").select("__key", (F.col("__around") / F.col("__density")).alias("__lof"))
    scored = rows.select("__key").join(factors, "__key", "left").select(F.col("__key").alias(key), F.coalesce("__lof", F.lit(1.0)).alias("lof"))
    scored = stored(scored, "lof")
    cut = exact_quantiles(scored, {"lof": F.col("lof")}, [1 - contamination])["lof"][0]
    return scored.withColumn("outlier", F.col("lof") > F.lit(cut))
