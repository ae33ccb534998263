"""Mixed data, pairs of levels after a finding, and rules for a category, against plain numpy."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from canvass.functions import dist
from canvass.operators import factorial, mining


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(6)
    n = 240
    h = rng.integers(0, 3, n)
    return [(i, float(v), float(u), "abc"[h[i]], "xy"[int(u > 0.3)]) for i, (v, u) in enumerate(zip(rng.normal(size=n) + h, rng.normal(size=n), strict=True))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, v double, u double, h string, g string")


def test_mixed_data_has_barycentres_contributions_and_eta2(spark, table):
    df = frame(spark, table)
    found = factorial.famd(df, ["v", "u"], {"h": None, "g": None})
    z = np.column_stack([(x - x.mean()) / x.std() for x in (np.array([r[1] for r in table]), np.array([r[2] for r in table]))])
    for c, levels in ((3, "abc"), (4, "xy")):
        for level in levels:
            one = np.array([float(r[c] == level) for r in table])
            z = np.column_stack([z, (one - one.mean()) / math.sqrt(one.mean())])
    values, vectors = np.linalg.eigh(z.T @ z / len(z))
    keep = values[::-1] > 1e-10
    assert found["eigenvalues"] == pytest.approx(values[::-1][keep])
    scores = z @ found["vectors"]
    assert found["variable_contributions"].sum(axis=0) == pytest.approx(np.ones(keep.sum()))
    for j, (name, at) in enumerate([("h", 3), ("g", 4)]):
        between = 0.0
        for level in sorted({r[at] for r in table}):
            own = np.array([r[at] == level for r in table])
            centre = scores[own].mean(axis=0)
            assert found["barycentres"][list(found["names"]).index(f"{name}={level}") - 2] == pytest.approx(centre)
            between = between + own.mean() * centre**2
        assert found["eta2"][j] == pytest.approx(between / found["eigenvalues"])
    got = sorted(factorial.famd_scores(df, found, 3).collect(), key=lambda r: r["id"])
    for j in range(3):
        f = np.array([r[f"dim{j + 1}"] for r in got])
        assert f == pytest.approx(scores[:, j])
        assert [r[f"contribution{j + 1}"] for r in got] == pytest.approx(list(f**2 / len(f) / found["eigenvalues"][j]))
        assert [r[f"cos2_{j + 1}"] for r in got] == pytest.approx(list(f**2 / (z**2).sum(axis=1)))


def test_weights_count_as_copies_and_holes_give_no_scores(spark, table):
    df = frame(spark, table)
    weighted = df.withColumn("w", 1.0 + F.col("id") % 3)
    a = factorial.famd(weighted, ["v"], {"h": None}, "w")
    b = factorial.famd(weighted.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("w").cast("int")))), ["v"], {"h": None})
    assert a["eigenvalues"] == pytest.approx(b["eigenvalues"]) and a["eta2"] == pytest.approx(b["eta2"])
    total = factorial.famd_scores(weighted, a, 2, "w").agg(F.sum("contribution1"), F.sum("contribution2")).first()
    assert tuple(total) == pytest.approx((1.0, 1.0))
    holed = factorial.famd_scores(df.withColumn("h", F.when(F.col("id") > 0, F.col("h"))), a, 1).where("dim1 IS NULL").collect()
    assert [(r["id"], r["cos2_1"]) for r in holed] == [(0, None)]


def test_findings_have_pairs_and_bounds(spark, table):
    findings = mining.mine_numeric(frame(spark, table), ["h", "g"], ["v", "u"], min_group=5)
    assert len(findings) == 4
    for f in findings:
        at, of = {"h": 3, "g": 4}[f.attribute], {"v": 1, "u": 2}[f.question]
        groups = {x: np.array([r[of] for r in table if r[at] == x]) for x in sorted({r[at] for r in table})}
        want = []
        for a, b in itertools.combinations(groups, 2):
            x, y = groups[a], groups[b]
            s, t = x.var(ddof=1) / len(x), y.var(ddof=1) / len(y)
            df = (s + t) ** 2 / (s * s / (len(x) - 1) + t * t / (len(y) - 1))
            want.append((a, b, x.mean() - y.mean(), dist.t_sf2((x.mean() - y.mean()) / math.sqrt(s + t), df)))
        adjusted = dist.benjamini_hochberg(np.array([w[3] for w in want]))
        assert [p[:2] for p in f.posthoc] == [w[:2] for w in want]
        assert [p[2] for p in f.posthoc] == pytest.approx([w[2] for w in want])
        assert [p[3] for p in f.posthoc] == pytest.approx(list(adjusted))
        assert (f.fdr, f.bonferroni) == (f.q <= 0.05, f.p <= 0.05 / 4)
    assert any(f.bonferroni for f in findings)


def test_rules_for_a_category_compare_shares(spark, table):
    df = frame(spark, table)
    found = mining.discover(df, F.col("g"), ["h"], depth=1, top=10, min_group=5, overlap=1.0, category="y")
    for r in found:
        own = np.array([t[3] == r["rule"][0][2] for t in table])
        y = np.array([t[4] == "y" for t in table])
        gap = y[own].mean() - y[~own].mean()
        assert r["effect"] == pytest.approx(gap) and r["score"] == pytest.approx(math.sqrt(own.sum() * (~own).sum() / len(y)) * abs(gap))
    assert len(found) == 3
    some = mining.discover(df, F.col("g"), ["h"], depth=1, top=10, min_group=5, overlap=1.0, category="y", min_effect=sorted(abs(r["effect"]) for r in found)[1])
    assert len(some) == 2
