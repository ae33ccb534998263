"""Nearest rows by cells against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from canvass.plans.neighbours import nearest


def wanted(q, rows, k):
    """All pairs in plain numpy; ties by key."""
    keys, points = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    out = {}
    for at in sorted(set(map(tuple, q))):
        d = np.sqrt(sum((points[:, i] - at[i]) ** 2 for i in range(points.shape[1])))
        best = np.lexsort((keys, d))[:k]
        out[at] = [(float(d[i]), int(keys[i])) for i in best]
    return out


def got(df):
    return {tuple(r["__at"]): [(f["__dist"], f["key"]) for f in r["__near"]] for r in df.collect()}


@pytest.mark.parametrize("cell, chunk, query_chunk", [(20, 8192, 16384), (30, 12, 9), (10_000, 25, 40), (10_000, 8192, 16384)])
def test_cells_find_the_nearest_rows(spark, cell, chunk, query_chunk):
    rng = np.random.default_rng(4)
    points = [*rng.normal(size=(150, 2)).round(1), *(rng.normal(size=(150, 2)) * 0.05 + 6).round(2), *np.zeros((60, 2)), [1e6, -1e6]]
    rows = [(i * 7 % 1009, [float(v) + 0.0 for v in p]) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "key long, __at array<double>").repartition(5)
    how = {"cell": cell, "chunk": chunk, "query_chunk": query_chunk}
    assert got(nearest(df, ["key"], 6, 2, **how)) == wanted([p for _, p in rows], rows, 6)
    asked = [[float(a), float(b)] for a, b in [*rng.normal(size=(40, 2)) * 4, [0.0, 0.0], [0.0, 0.0], [9e5, 0.0]]]
    queries = spark.createDataFrame([(a,) for a in asked], "__at array<double>")
    assert got(nearest(df, ["key"], 3, 2, queries, **how)) == wanted(asked, rows, 3)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [3.0])], "key long, __at array<double>")
    queries = spark.createDataFrame([([1.0],)], "__at array<double>")
    assert got(nearest(df, ["key"], 5, 1, queries, cell=1)) == {(1.0,): [(1.0, 1), (2.0, 2)]}
    assert got(nearest(df.limit(0), ["key"], 5, 1, queries)) == {(1.0,): []}
    assert nearest(df, ["key"], 5, 1, queries.limit(0)).collect() == []
    assert nearest(df.limit(0), ["key"], 5, 1).collect() == []


def test_visits_are_few_in_few_dimensions(spark):
    n, cell = 6000, 100
    df = spark.range(n).select(F.col("id").alias("key"), F.array(F.rand(3), F.rand(4)).alias("__at"))
    found = nearest(df, ["key"], 5, 2, cell=cell)
    assert found.count() == n
    start = next(f for f in found.inputFiles() if "nearest" in f).rpartition("/")[0]
    visits = spark.read.parquet(start).agg(F.sum(F.size("__targets"))).first()[0]
    assert visits < 0.1 * n * n / cell
