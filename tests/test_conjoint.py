"""Choice tasks: their rules, scopes, weights and covariances against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from canvass.codebook import CodebookError, Design
from canvass.operators import conjoint

SCHEMA = "id int, r int, t int, x double, brand string, chosen int, offered boolean, none boolean, w double, h string"


@pytest.fixture(scope="module")
def tasks():
    rng = np.random.default_rng(12)
    rows = []
    for r in range(60):
        for t in range(3):
            n = int(rng.integers(3, 6))
            x = rng.normal(size=n).round(2)
            none = [i == n - 1 for i in range(n)]
            u = np.where(none, 0.4, 0.9 * x) + rng.gumbel(size=n)
            offered = [True] * n
            offered[0] = bool(rng.integers(2))
            best = int(np.argmax(np.where(offered, u, -np.inf)))
            for i in range(n):
                rows.append((len(rows), r, t, None if none[i] else float(x[i]), "ab"[i % 2], int(i == best), offered[i], none[i], float(1 + r % 4), f"s{r % 3}"))
    return rows


def fitted(rows, weight=lambda r: 1.0):
    """beta, inverse information and a score a respondent by plain Newton steps."""
    sets = {}
    for r in rows:
        if r[6]:
            sets.setdefault((r[1], r[2]), []).append(r)
    x = {k: np.array([[0.0 if a[7] else a[3], float(a[7])] for a in v]) for k, v in sets.items()}
    y = {k: [a[5] for a in v].index(1) for k, v in sets.items()}
    beta = np.zeros(2)
    for _ in range(40):
        h, total, score = np.zeros((2, 2)), np.zeros(2), {}
        for k, v in x.items():
            p = np.exp(v @ beta)
            p /= p.sum()
            m = p @ v
            score[k[0]] = score.get(k[0], 0) + v[y[k]] - m
            total += weight(k[0]) * (v[y[k]] - m)
            h += weight(k[0]) * ((v * p[:, None]).T @ v - np.outer(m, m))
        beta = beta + np.linalg.solve(h, total)
    return beta, np.linalg.inv(h), score


HOW = ("r", "t", "choice", "chosen")
FLAGS = {"available": "offered", "opt_out": "none"}


def test_weights_opt_outs_and_covariances(spark, tasks):
    df = spark.createDataFrame(tasks, SCHEMA)
    x = {"x": F.col("x")}
    beta, inverse, score = fitted(tasks)
    f = conjoint.conditional_logit(df, x, *HOW, **FLAGS)
    assert f.names == ("x", "opt_out") and np.allclose(f.beta, beta) and f.n_sets == 180 and f.reference_df == 59
    meat = sum(np.outer(s, s) for s in score.values())
    assert np.allclose(f.cluster_covariance, inverse @ meat @ inverse * 60 / 59)
    # frequencies: as if each respondent were there so many times
    w = lambda r: 1.0 + r % 4
    beta, inverse, score = fitted(tasks, w)
    f = conjoint.conditional_logit(df, x, *HOW, **FLAGS, design=Design(weight="w", weight_type="frequency"))
    g = sum(map(w, score))
    meat = sum(w(r) * np.outer(s, s) for r, s in score.items())
    assert np.allclose(f.beta, beta) and np.allclose(f.cluster_covariance, inverse @ meat @ inverse * g / (g - 1)) and f.reference_df == g - 1
    # a survey: respondents' totals about the means of their strata
    f = conjoint.conditional_logit(df, x, *HOW, **FLAGS, design=Design(weight="w", strata="h"))
    meat = np.zeros((2, 2))
    for h in range(3):
        e = np.array([w(r) * s for r, s in score.items() if r % 3 == h])
        e = e - e.mean(axis=0)
        meat += len(e) / (len(e) - 1) * e.T @ e
    assert np.allclose(f.beta, beta) and np.allclose(f.cluster_covariance, inverse @ meat @ inverse) and f.reference_df == 57
    # a scope: those outside stay in the frame with a score of 0
    inside = [r for r in tasks if r[1] < 30]
    beta, inverse, score = fitted(inside, w)
    f = conjoint.conditional_logit(df, x, *HOW, **FLAGS, design=Design(weight="w", strata="h"), scope=F.col("r") < 30)
    meat = np.zeros((2, 2))
    for h in range(3):
        e = np.array([w(r) * score.get(r, np.zeros(2)) for r in range(60) if r % 3 == h])
        e = e - e.mean(axis=0)
        meat += len(e) / (len(e) - 1) * e.T @ e
    assert np.allclose(f.cluster_covariance, inverse @ meat @ inverse) and f.reference_df == 57


def test_scopes_are_widened_to_whole_tasks(spark, tasks):
    df = spark.createDataFrame(tasks, SCHEMA)
    some = df.where("id IN (0, 1, 40)")
    touched = {(r[1], r[2]) for r in tasks if r[0] in (0, 1, 40)}
    wide = conjoint.whole_tasks(df, some, "r", "t")
    assert {r["id"] for r in wide.collect()} == {r[0] for r in tasks if (r[1], r[2]) in touched}
    with pytest.raises(CodebookError, match="parts of tasks"):
        conjoint.conditional_logit(df, {"x": F.col("x")}, *HOW, **FLAGS, scope=F.col("id") > 0)
    assert conjoint.whole_tasks(df, df.limit(0), "r", "t").count() == 0


def test_every_rule_has_its_reason(spark):
    a = lambda task, chosen, x=1.0, offered=True, none=False, r=1, w=1.0: (0, r, task, x, "a", chosen, offered, none, w, "s")
    rows = {
        "used": [a(1, 1), a(1, 0), a(1, 0, None, True, True)],
        "unavailable_answered": [a(2, 0), a(2, 0)],
        "several_opt_outs": [a(3, 1), a(3, 0, None, True, True), a(3, 0, None, True, True)],
        "too_few_alternatives": [a(4, 1)],
        "missing": [a(5, 1), a(5, 0, None), a(6, 1), a(6, None)],
        "invalid_answer": [a(7, 0), a(7, 0), a(8, 1), a(8, 1)],
        "no_id": [a(None, 1), a(1, 0, r=None)],
        "zero_weight": [a(1, 1, r=2, w=0.0), a(1, 0, r=2, w=0.0)],
        "missing_weight": [a(1, 1, r=3, w=None), a(1, 0, r=3, w=None)],
        "unavailable": [a(2, 1, offered=False), a(4, 0, offered=False)],
    }
    df = spark.createDataFrame([r for v in rows.values() for r in v], SCHEMA)
    how = {"attributes": ["x"], "available": "offered", "opt_out": "none", "weight": "w"}
    got = {r["reason"]: r["count"] for r in conjoint.task_reasons(df, *HOW, **how).groupBy("reason").count().collect()}
    assert got == {k: len(v) for k, v in rows.items()}
    assert conjoint.task_reasons(df.limit(0), *HOW, **how).collect() == []
    ranks = spark.createDataFrame(
        [(1, i, k if k is None else float(k)) for i, ks in enumerate([(1, 2, 3), (1, 3), (2, 1), (1, 1), (1, None), (1.5, 1)]) for k in ks], "r int, t int, rank double"
    )
    got = {r["t"]: r["reason"] for r in conjoint.task_reasons(ranks, "r", "t", "ranking", "rank").collect()}
    assert got == {0: "used", 1: "invalid_answer", 2: "used", 3: "invalid_answer", 4: "missing", 5: "invalid_answer"}
    with pytest.raises(CodebookError, match="breaks a rule"):
        conjoint.conditional_logit(df, {"x": F.col("x")}, *HOW, **FLAGS, strict=True)


def test_respondents_have_one_weight_and_design(spark, tasks):
    df = spark.createDataFrame(tasks, SCHEMA)
    design = Design(weight="w", strata="h")
    assert conjoint.respondent_table(df, "r", design).count() == 60
    part = df.withColumn("w", F.when(F.col("id") > 0, F.col("w")))
    assert [r["r"] for r in conjoint.respondent_table(part, "r", design).where("__weight IS NULL").collect()] == [0]
    for bad in (df.withColumn("w", F.col("w") + (F.col("id") == 0).cast("int")), df.withColumn("h", F.when(F.col("id") == 0, "other").otherwise(F.col("h")))):
        with pytest.raises(CodebookError, match="different"):
            conjoint.respondent_table(bad, "r", design)
