"""Trees as tables of nodes, and measures of association, against plain Python."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from canvass.codebook import CodebookError
from canvass.operators import inference, relations, trees

# --- trees


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        x, y, g = float(rng.normal()), float(rng.normal()), "uvw"[i % 3]
        rows.append((i, x, y if i % 50 else None, g, "p" if x + (g == "u") > 0.3 else "q", 2 * x - (3 if g == "w" else 0) + float(rng.normal(0, 0.1))))
    return rows, spark.createDataFrame(rows, "id long, x double, y double, g string, class string, value double").repartition(3)


def walked(nodes, row):
    """The leaf of a row by the table of nodes."""
    at = next(n for n in nodes if n["parent"] is None)
    while at["leaf"] is None:
        kids = sorted((n for n in nodes if n["parent"] == at["node"]), key=lambda n: n["node"])
        value = row[at["feature"]] if at["feature"] in row else float(row["g"] == at["feature"].split(" = ")[1])
        at = kids[0] if value <= at["threshold"] else kids[1]
    return at


@pytest.mark.parametrize("target", ["class", "value"])
def test_nodes_lead_each_row_to_its_prediction(table, target):
    rows, df = table
    found = trees.fit_trees(df, target, ["x", "y"], ["g"], depth=4)
    assert found.task == ("classification" if target == "class" else "regression")
    assert found.names == ["x", "y", "g = u", "g = v", "g = w"] and sum(found.importances.values()) == pytest.approx(1)
    nodes = [r.asDict() for r in found.nodes().collect()]
    predicted = {r["id"]: r for r in found.predictions().collect()}
    whole = [dict(zip(("id", "x", "y", "g", "class", "value"), r, strict=True)) for r in rows if r[2] is not None]
    assert set(predicted) == {r["id"] for r in whole}
    members = Counter()
    for r in whole:
        leaf = walked(nodes, r)
        members[leaf["node"]] += 1
        assert leaf["leaf"] == predicted[r["id"]]["leaf"]
        assert leaf["prediction"] == (predicted[r["id"]]["predicted"] if target == "class" else repr(predicted[r["id"]]["predicted"]))
    for n in nodes:
        kids = [k["n"] for k in nodes if k["parent"] == n["node"]]
        assert n["n"] == (sum(kids) if kids else members[n["node"]])
        assert n["classes"] is None if target == "value" else sum(n["classes"].values()) == n["n"]
    if target == "value":
        root = next(n for n in nodes if n["parent"] is None)
        assert root["mean"] == pytest.approx(np.mean([r["value"] for r in whole]))


@pytest.mark.parametrize("target", ["class", "value"])
def test_representative_tree_agrees_most_with_its_forest(table, target):
    rows, df = table
    found = trees.fit_trees(df, target, ["x", "y"], ["g"], depth=3, trees=5)
    forest = {r["id"]: r["predicted"] for r in found.predictions().collect()}
    assert "leaf" not in found.predictions().columns
    whole = [dict(zip(("id", "x", "y", "g"), r[:4], strict=True)) for r in rows if r[2] is not None]
    expected = []
    for t in range(5):
        nodes = [r.asDict() for r in found.nodes(t).collect()]
        own = [walked(nodes, r)["prediction"] for r in whole]
        if target == "class":
            expected.append(np.mean([o == forest[r["id"]] for o, r in zip(own, whole, strict=True)]))
        else:
            whole_forest = np.array([forest[r["id"]] for r in whole])
            expected.append(1 - ((np.array(own, dtype=float) - whole_forest) ** 2).mean() / whole_forest.var())
    assert found.agreement() == pytest.approx(expected)
    assert found.representative() == int(np.argmax(expected))


def test_trees_of_nothing(spark, table):
    _, df = table
    for bad in (lambda: trees.fit_trees(df.limit(0), "class", ["x"]), lambda: trees.fit_trees(df, "class", []), lambda: trees.fit_trees(df, "class", ["x"], task="none")):
        with pytest.raises(CodebookError):
            bad()


# --- relations


def plain_tau(x, y):
    s = np.sign(x[:, None] - x) * np.sign(y[:, None] - y)
    c, d = (s > 0).sum() / 2, (s < 0).sum() / 2
    n0, pairs = len(x) * (len(x) - 1) / 2, lambda v: sum(k * (k - 1) / 2 for k in Counter(v.tolist()).values())
    return c, d, (c - d) / np.sqrt((n0 - pairs(x)) * (n0 - pairs(y)))


def ranks(v):
    return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])


@pytest.mark.parametrize("cells", [7, 60, 20_000])
def test_rank_correlations_are_those_of_all_pairs(spark, cells):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=260).round(2), rng.integers(0, 6, 260).astype(float)
    z = (x + rng.normal(size=260)).round(1)
    rows = [(float(a), float(b), float(c) if i % 9 else None) for i, (a, b, c) in enumerate(zip(x, y, z, strict=True))]
    df = spark.createDataFrame(rows, "x double, y double, z double").repartition(3)
    found = relations.rank_correlations(relations.pair_cells(df, [("x", "y"), ("x", "z"), ("y", "y")]), cells)
    some = np.arange(260) % 9 > 0
    for i, (a, b) in enumerate(((x, y), (x[some], z[some]), (y, y))):
        c, d, tau = plain_tau(a, b)
        assert (found[i]["c"], found[i]["d"], found[i]["n"]) == (c, d, len(a)) and found[i]["tau_b"] == pytest.approx(tau)
        assert found[i]["spearman"] == pytest.approx(np.corrcoef(ranks(a), ranks(b))[0, 1])
    got = inference.kendall_tau_b(df, "x", "z").first()
    assert (got["c"], got["d"]) == plain_tau(x[some], z[some])[:2]


def test_relations_of_all_kinds(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=400)
    rows = [(float(a), float(-a + rng.normal(0, 0.3)), "low" if a < 0 else "high", "abc"[i % 3], "012"[int(min(max(a + 1, 0), 2))]) for i, a in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, side string, other string, level string")
    found, order = relations.relations(df, ["a", "b", "side", "other", "level"], ordinal=["level", "side"])
    got = {(r["x"], r["y"]): r for r in found.collect()}
    assert len(got) == 10 and sorted(order) == ["a", "b", "level", "other", "side"]
    ab = got["a", "b"]
    b = np.array([r[1] for r in rows])
    assert ab["pearson"] == pytest.approx(np.corrcoef(x, b)[0, 1]) and ab["spearman"] == pytest.approx(np.corrcoef(ranks(x), ranks(b))[0, 1])
    assert ab["tau_b"] == pytest.approx(plain_tau(x, b)[2]) and ab["signed"] == -ab["strength"] and ab["eta"] is None
    side = np.array([r[2] for r in rows])
    total = ((x - x.mean()) ** 2).sum()
    assert got["a", "side"]["eta"] == pytest.approx(np.sqrt(sum((side == s).sum() * (x[side == s].mean() - x.mean()) ** 2 for s in ("low", "high")) / total))
    assert got["a", "side"]["tau_b"] is None and got["side", "level"]["tau_b"] is not None
    strength = np.array([r["strength"] for r in got.values()])
    assert ab["z"] == pytest.approx((ab["strength"] - strength.mean()) / strength.std())
    assert abs(order.index("a") - order.index("b")) == 1 or abs(order.index("a") - order.index("side")) == 1
    scores = [r["surprise"] for r in found.collect()]
    assert scores == sorted(scores, reverse=True)
    for mode in ("empirical", "lift"):
        assert relations.relations(df, ["a", "b"], unexpected=mode)[0].count() == 1
    with pytest.raises(CodebookError):
        relations.relations(df, ["a", "b"], unexpected="other")
    none, order = relations.relations(df.limit(0), ["side", "other"])
    assert none.count() == 0 and order == ["side", "other"]
