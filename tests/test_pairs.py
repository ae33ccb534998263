"""Meetings of all pairs of rows: results against plain numpy, and what they write and shuffle."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from canvass.operators import cluster, hierarchy
from canvass.plans.pairs import Squares, gaps, united


def table(spark, points):
    names = [f"x{i}" for i in range(points.shape[1])]
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], ["id", *names]).repartition(3), names


def plain_cut(points, height):
    """First rows of the components of links up to a height."""
    a, b = np.nonzero(gaps(points, points, "euclidean") <= height)
    return united(np.arange(len(points)), a, b)


def labels(found):
    return [r["cluster"] for r in sorted(found.collect(), key=lambda r: r["id"])]


def plain_joins(points, linkage):
    """Heights of joining the nearest pair first, and labels by first rows when five clusters are left."""
    d = gaps(points, points, "euclidean")
    np.fill_diagonal(d, np.inf)
    sizes, of, heights, five = np.ones(len(d)), np.arange(len(d)), [], None
    for left in range(len(d), 1, -1):
        if left == 5:
            five = of.copy()
        a, b = sorted(np.unravel_index(d.argmin(), d.shape))
        heights.append(d[a, b])
        row = (d[a] * sizes[a] + d[b] * sizes[b]) / (sizes[a] + sizes[b]) if linkage == "average" else np.maximum(d[a], d[b])
        d[a] = d[:, a] = row
        d[a, a] = d[b] = d[:, b] = np.inf
        sizes[a] += sizes[b]
        of[of == b] = a
    return heights, np.unique(five, return_inverse=True)[1].tolist()


def test_components_up_to_a_height_need_no_tree(spark, monkeypatch):
    rng = np.random.default_rng(2)
    points = np.vstack([rng.normal(size=(150, 6)), rng.normal(6, 0.3, size=(40, 6)), np.zeros((5, 6)), np.eye(6)[:1] * 2.5 + 20, np.eye(6)[:1] * 0 + 20])
    df, names = table(spark, points)

    def no_tree(*_):
        raise AssertionError("a cut at a height has asked for the tree")

    monkeypatch.setattr(hierarchy, "spanning_tree", no_tree)
    for height in (-1.0, 0.0, 1.3, 2.0, 2.5):  # 2.5 is the distance of the last two rows
        found, _ = hierarchy.agglomerative(df, names, "id", linkage="single", height=height, block=32)
        assert labels(found) == np.unique(plain_cut(points, height), return_inverse=True)[1].tolist()


@pytest.mark.parametrize("metric", ["euclidean", "chebyshev"])
def test_rows_are_not_sent_to_all_blocks(spark, metric, monkeypatch):
    rng = np.random.default_rng(3)
    points = np.vstack([rng.normal(size=(120, 7)), np.zeros((30, 7))])
    df, names = table(spark, points)
    plans = []
    kept = hierarchy.met
    monkeypatch.setattr(hierarchy, "met", lambda *a, **k: plans.append(kept(*a, **k)) or plans[-1])
    tree = hierarchy.linkage_tree(df, names, "id", "single", metric, block=16)
    d = gaps(points, points, metric)
    for k in (3, 60):
        cut = labels(tree.cut(k))
        apart = max(tree.links["height"][np.argsort(tree.links["height"])[: 150 - k]])
        a, b = np.nonzero(d <= apart)
        assert cut == np.unique(united(np.arange(150), a, b), return_inverse=True)[1].tolist()
    assert plans and all("Exchange" not in p._jdf.queryExecution().executedPlan().toString() for p in plans)


@pytest.mark.parametrize("linkage", ["average", "complete"])
def test_linkage_keeps_no_distances_of_all_pairs(spark, linkage, monkeypatch):
    rng = np.random.default_rng(4)
    points = np.vstack([rng.normal(size=(60, 6)), rng.normal(9, 0.5, size=(50, 6)), np.full((20, 6), 4.0)])  # clusters larger than a block, and copies
    df, names = table(spark, points)
    written = []
    kept = hierarchy.packed
    monkeypatch.setattr(hierarchy, "packed", lambda *a: written.append(kept(*a)) or written[-1])
    tree = hierarchy.linkage_tree(df, names, "id", linkage, block=16)
    heights, five = plain_joins(points, linkage)
    assert tree.top(1000)[:, 2] == pytest.approx(heights, abs=1e-9)
    assert labels(tree.cut(5)) == five
    assert len(written) > 3  # several rounds, each of which packs the rows and no distances
    assert all(w.columns == ["block", "number", "at"] for w in written)


def test_squares_are_within_their_error():
    rng = np.random.default_rng(5)
    a, b = rng.normal(3, 1, size=(50, 64)), rng.normal(size=(70, 64))
    b[:50] = a + 1e-9
    s = Squares(a, b)
    assert np.abs(s[0:50] - gaps(a, b, "euclidean") ** 2).max() <= s.error < 1e-9


def test_medoids_send_no_row_to_all_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    points = rng.normal(size=(90, 3)).round(2)
    df, names = table(spark, points)
    plans = []
    kept = cluster.met
    monkeypatch.setattr(cluster, "met", lambda *a: plans.append(kept(*a)) or plans[-1])
    whole = labels(cluster.kmedoids(df, names, 4, "id", block=4096))
    assert labels(cluster.kmedoids(df, names, 4, "id", block=16)) == whole  # sums over pairs of blocks, each met once
    assert labels(cluster.kmedoids(df, names, 4, "id", candidates=90, block=16)) == whole
    ahead = [r["id"] for r in df.orderBy(F.xxhash64("id"), "id").limit(20).collect()]
    d = gaps(points, points[ahead], "euclidean")
    first = ahead[int(d.sum(axis=0).argmin())]
    found = cluster.kmedoids(df, names, 1, "id", candidates=20, block=16)
    assert set(labels(found)) == {0}
    two = labels(cluster.kmedoids(df, names, 2, "id", candidates=20, swaps=0, block=16))
    second = ahead[int(np.minimum(d, gaps(points, points[[first]], "euclidean")).sum(axis=0).argmin())]
    assert two == gaps(points, points[[first, second]], "euclidean").argmin(axis=1).tolist()
    assert plans and all("Exchange" not in p._jdf.queryExecution().executedPlan().toString() for p in plans)
