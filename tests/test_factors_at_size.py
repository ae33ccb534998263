"""Factor methods that must not handle a row for each pair of items or for each replicate."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from canvass.codebook import Variable
from canvass.operators import efa


def test_pair_tables_count_rows_that_stand_for_several(spark):
    rng = np.random.default_rng(1)
    levels = (3, 2, 5, 4, 70, 3)
    x = np.column_stack([rng.integers(0, k, 400) for k in levels])
    names = [f"i{k}" for k in range(len(levels))]
    items = [Variable(c, scale="ordinal", order=tuple(map(str, range(k)))) for c, k in zip(names, levels, strict=True)]
    df = spark.createDataFrame([tuple(map(str, r)) for r in x.tolist()] + [(None, *["1"] * 5)], ", ".join(f"{c} string" for c in names))
    for rows, count in ((df, None), (df.groupBy(*names).agg(F.count("*").alias("times")), "times")):
        tables, n = efa.pair_tables(rows, items, count)
        assert n == 400 and set(tables) == set(itertools.combinations(range(6), 2))
        for (a, b), t in tables.items():
            want = np.zeros((levels[a], levels[b]))
            np.add.at(want, (x[:, a], x[:, b]), 1)
            assert np.array_equal(t, want)
    few = [Variable(c, scale="ordinal", order=("0", "1", "2")) for c in ("i0", "i1", "i5")]
    assert efa._shelves(few) == [[0, 1, 2]]  # one count of rows gives all of their tables
    pearson, n = efa.pearson_matrix(df.groupBy("i0", "i2").agg(F.count("*").alias("times")), ["i0", "i2"], "times")
    assert n == 400 and pearson[0, 1] == pytest.approx(np.corrcoef(x[:, 0], x[:, 2])[0, 1])


def test_parallel_analysis_shuffles_no_replicates(spark, monkeypatch):
    x = np.random.default_rng(8).normal(size=(900, 3)).round(1)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, c0 double, c1 double, c2 double")
    names = ["c0", "c1", "c2"]
    _, sorted_by_hash, _ = efa.parallel(df, names, "id", replicates=60, held=0)

    def no_rows(*_):
        raise AssertionError("values of all replicates went through Spark")

    monkeypatch.setattr(efa, "permuted", no_rows)
    observed, reference, _ = efa.parallel(df.repartition(5), names, "id", replicates=60)
    again = efa.parallel(df.coalesce(1), names, "id", replicates=60)[1]
    assert reference == pytest.approx(again, rel=1e-12)
    assert reference - 1 == pytest.approx(sorted_by_hash - 1, abs=0.03)
    r = efa.permuted_correlations(df.select("id", *((F.col(c) - float(x[:, i].mean())) / float(x[:, i].std(ddof=1)) for i, c in enumerate(names))).toDF("id", *names), names, "id", 200, 7, 900)
    off = r[:, [0, 0, 1], [1, 2, 2]]
    assert off.std(axis=0) == pytest.approx(1 / np.sqrt(899), rel=0.2) and np.abs(off.mean(axis=0)).max() < 0.01
    assert len(np.unique(off[:, 2])) == 200
