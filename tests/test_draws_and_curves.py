"""Category distances, local regression and conditional draws against plain Python."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from canvass.codebook import CodebookError
from canvass.operators import categories, cluster, draws, smoothing

# --- clusters of categories


def plain_distances(rows, j):
    """Half the absolute differences of other columns' shares beside each two categories of column j."""
    shares = {}
    for a in sorted({r[j] for r in rows}):
        mine = [r for r in rows if r[j] == a]
        total = len(mine) * (len(rows[0]) - 1)
        shares[a] = Counter()
        for i in range(len(rows[0])):
            if i != j:
                for r in mine:
                    shares[a][i, r[i]] += 1 / total
    return {(a, b): 0.5 * sum(abs(shares[a][c] - shares[b][c]) for c in {*shares[a], *shares[b]}) for a in shares for b in shares}


def test_distances_of_categories_are_learned_from_their_company(spark):
    rng = np.random.default_rng(123)
    rows = [(str(rng.choice(["A", "B"])), str(rng.choice(["X", "X1"])), "s") for _ in range(40)] + [(str(rng.choice(["C", "D"])), str(rng.choice(["Y", "Y1"])), "t") for _ in range(40)]
    df = spark.createDataFrame([(i, *r, i // 40) for i, r in enumerate(rows)], "id long, a string, b string, c string, true int").repartition(3)
    _, model = categories.disc(df, [], ["a", "b", "c"], 2, "id", rounds=0)
    for j, name in enumerate("abc"):
        got = {(r["a"], r["b"]): r["distance"] for r in model.table(df).where(F.col("column") == name).where("cluster = 0").collect()}
        assert got == pytest.approx(plain_distances(rows, j))
    found, model = categories.disc(df, [], ["a", "b", "c"], 2, "id")
    assert found.count() == 80 and model.converged and sorted(model.sizes) == [40, 40]
    assert cluster.same_partition(df.join(found, "id"), "cluster", "true")
    again, _ = categories.disc(df.repartition(1), [], ["a", "b", "c"], 2, "id")
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in found.collect()}
    own = [r for r, t in zip(rows, (i // 40 for i in range(80)), strict=True) if t == 0]
    c = dict(found.where("id = 0").collect())[0]
    blended = 0.6 * plain_distances(own, 0)["A", "B"]
    got = {(r["a"], r["b"]): r["distance"] for r in model.table(df).where("column = 'a'").where(F.col("cluster") == c).collect()}
    assert got["A", "B"] <= blended + 0.4 * plain_distances(rows, 0)["A", "B"] + 1e-9 < got["A", "C"]


def test_numbers_alone_are_cut_and_beside_categories_are_standardised(spark):
    rng = np.random.default_rng(42)
    data = np.vstack([rng.normal(1, 0.2, (25, 2)), rng.normal(8, 0.2, (25, 2))])
    df = spark.createDataFrame([(i, *map(float, r), None if i % 7 == 0 else "uv"[i // 25], i // 25) for i, r in enumerate(data)], "id long, x double, y double, c string, true int")
    found, _ = categories.disc(df, ["x", "y"], ["c"], 2, "id")
    assert cluster.same_partition(df.join(found, "id"), "cluster", "true")
    cut, _ = categories.disc(df, ["x", "y"], [], 2, "id")  # the middle bin has rows of both
    sides = Counter((r["true"], r["cluster"]) for r in df.join(cut, "id").collect())
    assert max(sides[0, 0] + sides[1, 1], sides[0, 1] + sides[1, 0]) >= 40
    one, model = categories.disc(df, [], ["c"], 5, "id")
    assert one.count() == 50 and len(model.prototypes) == 3  # no more clusters than patterns


def test_clusters_of_nothing(spark, monkeypatch):
    df = spark.createDataFrame([], "id long, c string, x double")
    assert categories.disc(df, ["x"], ["c"], 2, "id")[0].collect() == []
    monkeypatch.setattr(categories, "MAX_LEVELS", 3)
    with pytest.raises(CodebookError):
        categories.disc(spark.createDataFrame([(i, str(i)) for i in range(5)], "id long, c string"), [], ["c"], 2, "id")
    with pytest.raises(CodebookError):
        categories.disc(df, [], [], 2, "id")


# --- local regression


def plain_fit(x, y, g, k, degree):
    """Fit, slope and smoother row at g."""
    h = np.sort(np.abs(x - g))[k - 1]
    h = h if h > 1e-12 else 1.0
    w = np.maximum(1 - np.minimum(np.abs(x - g) / h, 1) ** 3, 0) ** 3
    m = np.vander((x - g) / h, degree + 1, increasing=True)
    smooth = np.linalg.pinv(m.T @ (w[:, None] * m)) @ (m * w[:, None]).T
    return smooth[0] @ y, smooth[1] @ y / h, smooth[0]


@pytest.mark.parametrize("degree,span", [(1, 0.5), (2, 0.4)])
def test_curves_are_those_of_local_fits(spark, degree, span):
    rng = np.random.default_rng(9)
    x = np.sort(rng.uniform(0, 10, 120)).round(3)
    y = np.sin(x) + rng.normal(0, 0.1, 120)
    y[60] += 3
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))] + [(900, None, 1.0), (901, 1.0, float("nan"))]
    df = spark.createDataFrame(rows, "id long, x double, y double").repartition(3)
    found = smoothing.loess(df, "x", "y", span, degree, 60, keep=["id"])
    k = int(np.ceil(span * 120))
    plain = [plain_fit(x, y, g, k, degree) for g in found.grid]
    assert found.fit == pytest.approx([p[0] for p in plain]) and found.slope == pytest.approx([p[1] for p in plain], abs=1e-8)
    assert found.norm == pytest.approx([(p[2] ** 2).sum() for p in plain])
    rows_ = [plain_fit(x, y, g, k, degree) for g in x]
    assert found.trace == pytest.approx(sum(r[2][i] for i, r in enumerate(rows_)), rel=0.03)
    points = {r["id"]: r for r in found.points().collect()}
    assert len(points) == 120 and found.n == 120
    assert [points[i]["fitted"] for i in range(120)] == pytest.approx([r[0] for r in rows_], abs=0.03)
    assert points[60]["outlier"] and sum(p["outlier"] for p in points.values()) < 4
    residual = np.array([points[i]["residual"] for i in range(120)])
    assert found.rss == pytest.approx((residual**2).sum()) and found.deviation == pytest.approx(residual.std())
    assert found.r2 == pytest.approx(1 - found.rss / ((y - y.mean()) ** 2).sum())
    for r in found.curve(df).collect():
        assert r["lower"] < r["fit"] < r["upper"] and r["se"] == pytest.approx((r["upper"] - r["lower"]) / 2 / 1.959963984540054)


def test_curves_of_ties_and_of_little(spark):
    df = spark.createDataFrame([(i, 2.0, float(i)) for i in range(6)], "id long, x double, y double")
    found = smoothing.loess(df, "x", "y")
    assert len(found.grid) == 1 and found.fit[0] == pytest.approx(2.5) and found.r2 == pytest.approx(0, abs=1e-9)
    with pytest.raises(CodebookError):
        smoothing.loess(df.limit(4), "x", "y")


# --- draws


@pytest.fixture(scope="module")
def holes(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(1500):
        x = float(rng.uniform(0, 10))
        rows.append((i, x, 2 * x + float(rng.normal(0, 0.5)) if i % 5 else None, ("low" if x < 5 else "high") if i % 4 else None, "ab"[i % 2], "k" if i % 3 else None))
    return rows, spark.createDataFrame(rows, "id long, x double, y double, level string, g string, other string").repartition(4)


def test_draws_follow_the_conditions_and_keep_what_is_there(spark, holes):
    rows, df = holes
    out = {r["id"]: r for r in draws.fill_draws(df, ["y", "level"], "id", ["x", "g"]).collect()}
    assert len(out) == 1500
    for i, x, y, level, _, other in rows:
        assert (y is None or out[i]["y"] == y) and (level is None or out[i]["level"] == level) and out[i]["other"] == other
    drawn = [(r[1], out[r[0]]["y"]) for r in rows if r[2] is None]
    off = np.array([y - 2 * x for x, y in drawn])
    assert abs(off.mean()) < 0.15 and 0.35 < off.std() < 0.65
    levels = [(r[1], out[r[0]]["level"]) for r in rows if r[3] is None]
    assert {v for _, v in levels} == {"low", "high"}
    assert np.mean([(v == "low") == (x < 5) for x, v in levels]) > 0.9
    again = {r["id"]: r for r in draws.fill_draws(df.repartition(2), ["y", "level"], "id", ["x", "g"]).collect()}
    assert all(again[i]["level"] == out[i]["level"] and again[i]["y"] == pytest.approx(out[i]["y"]) for i in out)
    other = {r["id"]: r["y"] for r in draws.fill_draws(df, ["y"], "id", ["x"], seed=7).collect()}
    assert any(other[r[0]] != out[r[0]]["y"] for r in rows if r[2] is None)


def test_categories_back_off_to_fewer_conditions(spark):
    rows = [(i, "p", "q", "A") for i in range(40)] + [(i, "p", "r", "B") for i in range(40, 43)] + [(i, "s", "t", "C") for i in range(43, 60)]
    rows += [(100, "p", "q", None), (101, "p", "r", None), (102, "p", "new", None), (103, "s", None, None), (104, "none", "none", None)]
    df = spark.createDataFrame(rows, "id long, a string, b string, v string")
    given = {"a": F.col("a"), "b": F.col("b")}
    seen = {i: Counter() for i in range(100, 105)}
    for seed in range(12):
        for r in draws.draw_category(df, "v", given, "id", F.col("v").isNull(), (seed,)).where("id >= 100").collect():
            seen[r["id"]][r["v"]] += 1
    assert set(seen[100]) == {"A"} and set(seen[103]) == {"C"}
    assert set(seen[101]) <= {"A", "B"} and set(seen[102]) <= {"A", "B"}  # three rows are too few, so those of p alone
    assert seen[101]["A"] > 6 and set(seen[104]) <= {"A", "B", "C"}
    sharp = draws.draw_category(df, "v", {}, "id", F.col("v").isNull(), (1,), spread=0.01).where("id >= 100").collect()
    assert {r["v"] for r in sharp} == {"A"}


def test_shares_of_draws_are_those_of_the_known(spark):
    rows = [(i, "A" if i % 10 < 7 else "B") if i < 1000 else (i, None) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, v string")
    got = Counter(r["v"] for r in draws.fill_draws(df, ["v"], "id", steps=1).where("id >= 1000").collect())
    assert abs(got["A"] / 2000 - 0.7) < 0.035


def test_draws_of_nothing(spark):
    df = spark.createDataFrame([], "id long, x double, v string")
    assert draws.fill_draws(df, ["x", "v"], "id").collect() == []
    with pytest.raises(CodebookError):
        draws.fill_draws(spark.createDataFrame([(1, None, "a")], "id long, x double, v string"), ["x", "v"], "id")
