"""Linkage trees, concept trees, feature ranking and exact quantiles against plain Python."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from canvass.codebook import CodebookError
from canvass.operators import cluster, concepts, hierarchy, ranking
from canvass.plans import graph
from canvass.plans.quantiles import exact_quantiles


# --- linkage


def plain_merges(points, linkage, metric):
    """Greedy joining of the nearest pair: heights in order, and the partition before each of the last joins."""
    d = hierarchy.gaps(points, points, metric)
    groups = [[i] for i in range(len(points))]
    take = {"single": np.min, "complete": np.max, "average": np.mean}[linkage]
    heights, partitions = [], [list(map(tuple, groups))]
    while len(groups) > 1:
        h, a, b = min((take(d[np.ix_(p, q)]), i, j) for (i, p), (j, q) in itertools.combinations(enumerate(groups), 2))
        heights.append(h)
        groups = [g for i, g in enumerate(groups) if i not in (a, b)] + [groups[a] + groups[b]]
        partitions.append([tuple(sorted(g)) for g in groups])
    return heights, partitions


def groups_of(rows, n):
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r["cluster"], []).append(r["id"])
    assert sorted(out) == list(range(len(out)))
    assert sum(map(len, out.values())) == n
    assert [min(out[c]) for c in sorted(out)] == sorted(min(g) for g in out.values())  # numbered by first rows
    return {tuple(sorted(g)) for g in out.values()}


@pytest.mark.parametrize("linkage,metric", [("single", "euclidean"), ("complete", "cityblock"), ("average", "euclidean")])
def test_trees_are_those_of_greedy_joining(spark, linkage, metric):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(70, 3)).round(6)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id long, x double, y double, z double").repartition(3)
    heights, partitions = plain_merges(points, linkage, metric)
    tree = hierarchy.linkage_tree(df, ["x", "y", "z"], "id", linkage, metric, block=16)
    table = tree.top(1000)
    assert table[:, 2] == pytest.approx(heights) and table[-1, 3] == 70
    for k in (1, 4, 70, 90):
        assert groups_of(tree.cut(k).collect(), 70) == {tuple(g) for g in partitions[max(70 - k, 0)]}
    for at in (20, 60):
        assert groups_of(tree.cut(height=(heights[at] + heights[at - 1]) / 2).collect(), 70) == {tuple(g) for g in partitions[at]}
    upper = tree.top(3)
    assert upper[:, 2] == pytest.approx(heights[-3:]) and upper[:, 3].tolist() == table[-3:, 3].tolist()


def test_trees_with_ties_and_copies(spark):
    rows = [(i, float(i // 4 % 3)) for i in range(24)]
    df = spark.createDataFrame(rows, "id long, x double")
    for linkage in hierarchy.LINKAGES:
        found, tree = hierarchy.agglomerative(df, ["x"], "id", 3, linkage, block=5)
        assert groups_of(found.collect(), 24) == {tuple(i for i, x in rows if x == v) for v in (0.0, 1.0, 2.0)}
        assert sorted(tree.top()[:, 2])[:21] == [0.0] * 21
        assert groups_of(tree.cut(height=0.0).collect(), 24) == groups_of(found.collect(), 24)


def test_trees_of_little(spark):
    df = spark.createDataFrame([(1, 2.0)], "id long, x double")
    for some, n in ((df, 1), (df.limit(0), 0)):
        for linkage in ("single", "average"):
            found, tree = hierarchy.agglomerative(some, ["x"], "id", 2, linkage)
            assert found.count() == n and len(tree.top()) == 0
    with pytest.raises(CodebookError):
        hierarchy.linkage_tree(df, ["x"], "id", "ward")
    with pytest.raises(CodebookError):
        tree.cut()


def test_large_graphs_and_small_ones_have_the_same_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)]
    df = spark.createDataFrame(links, "a long, b long")
    one, other = ({tuple(r) for r in graph.connected_components(df, small).collect()} for small in (0, 1000))
    assert one == other and one


def test_k_means_is_the_best_of_its_starts(spark):
    rng = np.random.default_rng(6)
    points = np.vstack([rng.normal(c, 0.4, (30, 2)) for c in ([0, 0], [6, 0], [0, 6], [6, 6])])
    df = spark.createDataFrame([(i, *map(float, p), i // 30) for i, p in enumerate(points)], "id long, x double, y double, true int").repartition(3)
    found, inertia = cluster.kmeans(df, ["x", "y"], 4)
    assert cluster.same_partition(found, "cluster", "true")
    assert inertia == pytest.approx(sum(((points[i : i + 30] - points[i : i + 30].mean(axis=0)) ** 2).sum() for i in range(0, 120, 30)))
    again, _ = cluster.kmeans(df.repartition(1), ["x", "y"], 4)
    assert {(r["id"], r["cluster"]) for r in again.collect()} == {(r["id"], r["cluster"]) for r in found.collect()}
    assert cluster.kmeans(df.limit(0), ["x"], 3)[0].collect() == [] and cluster.kmeans(df.limit(2), ["x"], 5)[1] == pytest.approx(0)


# --- concepts


def test_concepts_of_numbers_and_of_categories(spark):
    rng = np.random.default_rng(42)
    data = np.vstack([rng.normal(c, 0.2, (20, 2)) for c in ([0, 0], [5, 5], [0, 6])])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(data)], "id long, x double, y double").withColumn("true", (F.col("id") / 20).cast("int"))
    found, tree = concepts.concept_tree(df, ["x", "y"], "id", 3)
    assert found.count() == 60
    assert cluster.same_partition(df.join(found, "id"), "cluster", "true")
    table = tree.table(df).collect()
    root = next(r for r in table if r["parent"] is None)
    assert root["n"] == 60 and sum(r["n"] for r in table if r["parent"] == root["concept"]) == 60
    for r in table:
        kids = [c["n"] for c in table if c["parent"] == r["concept"]]
        assert not kids or sum(kids) == r["n"]
    assert root["means"]["x"] == pytest.approx(data[:, 0].mean())
    animals = [["cat", "red"], ["cat", "red"], ["cat", "pink"]] * 10 + [["dog", "blue"], ["dog", "blue"], ["dog", "navy"]] * 10
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(animals)], "id long, a string, b string")
    found, tree = concepts.concept_tree(df, [], "id", 2, ["a", "b"])
    assert cluster.same_partition(df.join(found, "id"), "cluster", "a")
    assert next(r for r in tree.table(df).collect() if r["parent"] is None)["n"] == 60


def test_concepts_do_not_depend_on_partitions_and_merge_over_groups(spark, monkeypatch):
    monkeypatch.setattr(concepts, "GROUP_ROWS", 40)
    monkeypatch.setattr(concepts, "FAN", 3)
    rng = np.random.default_rng(7)
    rows = [(i, float(rng.normal(8 * (i % 4), 0.5)) if i % 17 else None, "uvw"[i % 3] if i % 5 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, x double, c string")
    one, tree = concepts.concept_tree(df.repartition(5), ["x"], "id", 4, ["c"], acuity=0.5)
    other, _ = concepts.concept_tree(df.repartition(2), ["x"], "id", 4, ["c"], acuity=0.5)
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in other.collect()}
    assert tree.tree.root.sums[0] == 600
    plain, _ = concepts.concept_tree(df.where("x IS NOT NULL"), ["x"], "id", 4, acuity=0.5)
    tight = Counter((r["id"] % 4, r["cluster"]) for r in plain.collect())
    assert sum(max(n for (g, _), n in tight.items() if g == k) for k in range(4)) > 0.95 * plain.count()


def test_utility_is_that_of_counting():
    space = concepts.Space(np.zeros(1), [["a", "b"]], acuity=0.1)
    s = space.items(np.array([[1.0], [3.0], [math.nan]]), np.array([[0], [0], [-1]]))
    assert space.score(s).tolist() == pytest.approx([concepts._DENSITY / 0.1 + 1, concepts._DENSITY / 0.1 + 1, 0])
    assert float(space.score(s.sum(axis=0))) == pytest.approx(3 * concepts._DENSITY / 1.0 + 4 / 3)


def test_concepts_of_nothing(spark):
    df = spark.createDataFrame([], "id long, x double")
    found, tree = concepts.concept_tree(df, ["x"], "id")
    assert found.collect() == [] and tree.table(df).count() == 1
    one, _ = concepts.concept_tree(spark.createDataFrame([(1, None)], "id long, x double"), ["x"], "id")
    assert one.collect() == [(1, 0)]
    with pytest.raises(CodebookError):
        concepts.concept_tree(df, [], "id")


# --- quantiles


def test_quantiles_are_exact_whatever_the_values(spark):
    rng = np.random.default_rng(5)
    columns = {"a": rng.normal(size=3000), "b": rng.integers(0, 4, 3000).astype(float), "c": np.where(rng.random(3000) < 0.4, 7.0, rng.normal(size=3000) * 1e9)}
    rows = [(i, *(float(v[i]) if i % 11 or c == "a" else None for c, v in columns.items())) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(3)
    shares = [0.0, 0.013, 0.25, 0.5, 0.75, 0.9999, 1.0]
    for values, accuracy in ((20_000, 5_000), (40, 50)):
        got = exact_quantiles(df, {c: F.col(c) for c in columns}, shares, values, accuracy)
        for j, c in enumerate(columns):
            kept = [r[j + 1] for r in rows if r[j + 1] is not None]
            assert got[c] == pytest.approx(list(np.quantile(kept, shares)))
    empty = exact_quantiles(df.limit(0), {"a": F.col("a")}, [0.5])
    assert empty == {"a": [None]}


# --- ranking


def plain_relief(x, y, asked, k, by_class):
    z = (x - x.min(axis=0)) / np.where(np.ptp(x, axis=0) > 0, np.ptp(x, axis=0), 1)
    out, n = np.zeros(x.shape[1]), len(x)
    for i in asked:
        d = np.abs(z - z[i]).sum(axis=1)
        if by_class:
            for c in np.unique(y):
                some = [j for j in np.argsort(d, kind="stable") if y[j] == c and j != i][:k]
                if some:
                    mean = np.abs(z[some] - z[i]).mean(axis=0)
                    out += (-mean if c == y[i] else (y == c).mean() / (1 - (y == y[i]).mean()) * mean) / len(asked)
        else:
            for j in [j for j in np.argsort(d, kind="stable") if j != i][:k]:
                out += abs(y[i] - y[j]) / np.ptp(y) * np.abs(z[j] - z[i]) / (len(asked) * min(k, n - 1))
    return out


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(240, 3))
    rows = [(i, *map(float, x[i]), "north" if x[i, 0] > 0.3 else None, "A" if 2.5 * x[i, 0] + 2 * x[i, 1] > 0 else "B", float(3 * x[i, 0] - x[i, 1])) for i in range(240)]
    return x, spark.createDataFrame(rows, "id long, x1 double, x2 double, noise double, area string, class string, value double").repartition(3)


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_relief_weights_are_those_of_plain_search(spark, features, task):
    x, df = features
    target = "class" if task == "classification" else "value"
    rows, _, _ = ranking.prepared_features(df, ["x1", "x2", "noise"], target, "id", task)
    table = rows.orderBy("key").collect()
    y = np.array([r["y"] for r in table])
    asked = [r["key"] for r in df.select(F.col("id").alias("key"), F.xxhash64("id", F.lit(42)).alias("h")).orderBy("h").limit(50).collect()]
    assert ranking.relief(rows, 3, task, 7, 50) == pytest.approx(plain_relief(x, y, asked, 7, task == "classification"))


def test_noise_ranks_last_for_a_class(spark, features):
    x, df = features
    found = ranking.rank_features(df, ["x1", "x2", "noise"], "id", "class", trees=20, repeats=2)
    assert found.task == "classification" and set(found.scores) == set(ranking.METHODS)
    table = {r["feature"]: r for r in found.table(spark).collect()}
    assert table["noise"]["rank"] == 3 and table["noise"]["tier"] == "low" and {table[c]["rank"] for c in ("x1", "x2")} == {1, 2}
    assert table["noise"]["permutation"] < 0.05 < table["x1"]["permutation"]
    assert found.suggested == 2 and [r["suggested"] for r in table.values()].count(True) == 2
    assert found.redundancy == pytest.approx(np.abs(np.corrcoef(x, rowvar=False)), abs=1e-9)
    y = np.array([r["class"] for r in df.orderBy("id").collect()])
    for j, f in enumerate(found.scores["f"]):
        a, b = x[y == "A", j], x[y == "B", j]
        within = (((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()) / (len(x) - 2)
        assert f == pytest.approx((len(a) * (a.mean() - x[:, j].mean()) ** 2 + len(b) * (b.mean() - x[:, j].mean()) ** 2) / within)
    values, vectors = np.linalg.eigh(np.corrcoef(x, rowvar=False))
    assert found.scores["pca"] == pytest.approx(list((vectors**2) @ (values / values.sum())))
    edges = [np.quantile(x[:, j], [0.2, 0.4, 0.6, 0.8]) for j in range(3)]
    for j, mi in enumerate(found.scores["mutual_information"]):
        cells = Counter(zip(np.searchsorted(edges[j], x[:, j], side="right"), y))
        a, b, n = Counter(), Counter(), len(y)
        for (i, c), m in cells.items():
            a[i], b[c] = a[i] + m, b[c] + m
        assert mi == pytest.approx(sum(m / n * math.log(m * n / (a[i] * b[c])) for (i, c), m in cells.items()))


def test_ranking_of_numbers_of_categories_and_of_nothing(spark, features):
    x, df = features
    found = ranking.rank_features(df, ["x1", "noise", "area", "value"], "id", "value", trees=20)
    assert found.task == "regression" and found.features == ["x1", "noise", "area"]
    assert found.scores["f"][2] is None and found.scores["pca"][2] is None and found.ranks("f")[2] is None
    r = np.corrcoef(x[:, 0], 3 * x[:, 0] - x[:, 1])[0, 1] ** 2
    assert found.scores["f"][0] == pytest.approx(r / (1 - r) * 238)
    assert found.order()[0] == 0
    wide = df.select("id", (F.col("x1") * 10).alias("v1"), F.col("x2").alias("v2"), (F.col("noise") * 5).alias("v3"))
    alone = ranking.rank_features(wide, ["v1", "v2", "v3"], "id")
    assert alone.task == "unsupervised" and set(alone.scores) == {"relief", "mutual_information", "pca"}
    assert alone.scores["relief"] == pytest.approx([100 * x[:, 0].var(), x[:, 1].var(), 25 * x[:, 2].var()])
    twins = ranking.rank_features(df.withColumn("copy", F.col("x1")), ["x1", "copy"], "id", "class", ["f", "relief"])
    assert twins.ranks("f") == [1.5, 1.5]
    assert ranking.infer_task(df.withColumn("w", F.lit(3)), "w") == "classification"
    with pytest.raises(CodebookError):
        ranking.rank_features(df.limit(0), ["x1"], "id", "class")
    with pytest.raises(CodebookError):
        ranking.rank_features(df, ["class"], "id", "class")
