"""Codebooks as files, what a regression under one refuses, and jitter."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from canvass.codebook import Codebook, CodebookError, Design, Group, Variable
from canvass.functions.columns import signed_noise
from canvass.operators import regression

BOOK = Codebook(
    (
        Variable("y", "ratio", label="Amount, total", missing_codes=("99",), missing_reasons={"99": "refused"}),
        Variable("q", "ordinal", order=("lo", "mid", "hi"), is_reversed=True),
        Variable("h", order=("a|b", "c"), value_labels={"a|b": 'A "or" B', "c": "C"}),
        Variable("w", "ratio", role="weight"),
        Variable("o1"),
        Variable("o2"),
    ),
    (Group("o", ("o1", "o2")),),
    Design(weight="w"),
)


def test_codebooks_survive_files():
    blank = Codebook(tuple(Variable(v.name) for v in BOOK.variables), BOOK.groups, BOOK.design)
    assert blank.patched(BOOK.to_csv()) == BOOK
    assert blank.patched("﻿" + BOOK.to_csv()) == BOOK
    assert Codebook(blank.variables).patched(BOOK.to_json()) == BOOK
    assert Codebook.from_json(BOOK.to_json()) == BOOK


def test_patches_change_what_they_say():
    out = BOOK.patched("name,label,scale,order,extra\nq,Quality,,lo|hi,1\nunknown,x,ratio,,\n")
    assert out["q"] == Variable("q", "ordinal", label="Quality", order=("lo", "hi"), is_reversed=True)
    assert [v for v in out.variables if v.name != "q"] == [v for v in BOOK.variables if v.name != "q"]
    assert BOOK.patched("") == BOOK and BOOK.patched("{}") == BOOK
    for bad in ("name,scale\nq,odd\n", "name,value_labels\nh,[1]\n", "name,value_labels\nh,{\n", "{", "name,is_reversed\nq,maybe\n", '{"variables": [{"name": "q", "odd": 1}]}'):
        with pytest.raises(CodebookError):
            BOOK.patched(bad)


def test_regression_under_a_codebook(spark):
    rng = np.random.default_rng(2)
    ranks, h = rng.integers(1, 4, 80), rng.integers(0, 2, 80)
    y = (3 + 2.0 * ranks - h + rng.normal(size=80)).round(3)
    rows = [(float(y[i]), ("hi", "mid", "lo")[ranks[i] - 1], ("a|b", "c")[h[i]], 1.0, 1, 0) for i in range(80)]
    df = spark.createDataFrame([*rows, (99.0, "lo", "c", 1.0, 1, 0), (5.0, None, "c", 1.0, 1, 0), (5.0, "lo", "z", 1.0, 1, 0)], "y double, q string, h string, w double, o1 int, o2 int")
    f = regression.questionnaire_regression(df, BOOK, "y", ["q"], ["h"], ordinal_as_rank=["q"], covariance="classical")
    want = np.linalg.lstsq(np.column_stack([np.ones(80), ranks, h]), y, rcond=None)[0]
    assert f.names == ("(intercept)", "q", "h=c") and f.beta == pytest.approx(want) and f.n == 80
    refused = [("q", ["y"], []), ("y", ["q"], []), ("y", ["o1"], []), ("y", [], ["o2"]), ("y", ["w"], []), ("y", ["h"], []), ("y", ["y"], []), ("y", [], ["h", "h"]), ("y", [], [])]
    for target, numeric, categorical in refused:
        with pytest.raises(CodebookError):
            regression.questionnaire_regression(df, BOOK, target, numeric, categorical)


def test_jitter_is_that_of_the_hash(spark):
    def plain(text):
        h = 2166136261
        for b in text.encode():
            h = (h ^ b) * 16777619 % 2**32
        h = h or 1
        h ^= h << 13 & 0xFFFFFFFF
        h ^= h >> 17
        h ^= h << 5 & 0xFFFFFFFF
        return h / (2**32 - 1) * 2 - 1

    keys = ["", "a", "行", "ROW-000001", "x" * 5000, None]
    df = spark.createDataFrame([(k,) for k in keys], "k string").withColumn("n", signed_noise(F.col("k"), 7, "y"))
    got = [r["n"] for r in df.collect()]
    assert got[-1] is None and got[:-1] == pytest.approx([plain(f"7|{k}|y") for k in keys[:-1]], abs=1e-12)
    assert all(-1 <= v <= 1 for v in got[:-1])
