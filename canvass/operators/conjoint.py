"""Conjoint analysis: ratings, choices and rankings of profiles."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.codebook import CodebookError, Design, codes
from canvass.functions import dist
from canvass.functions.columns import finite
from canvass.operators.regression import LinearFit, linear_regression, within
from canvass.operators.survey import design_frame, total_covariance
from canvass.plans.context import weight_column


def effect_columns(df: DataFrame, attributes: dict[str, Sequence[str]], numeric: Sequence[str] = ()) -> dict[str, Column]:
    """Effect coding: +1 for the level, -1 for the last one, which is the reference; null outside the levels."""
    out: dict[str, Column] = {}
    for a, levels in attributes.items():
        c, last = codes(df, a), levels[-1]
        for x in levels[:-1]:
            out[f"{a}={x}"] = F.when(c == x, 1.0).when(c == last, -1.0).when(c.isin(*levels), 0.0)
    return out | {c: finite(c) for c in numeric}


def level_utilities(attributes: dict[str, Sequence[str]], names: Sequence[str], beta: np.ndarray) -> dict[str, dict[str, float]]:
    """Utility of each level; those of an attribute add up to 0."""
    at = dict(zip(names, beta.tolist(), strict=True))
    out = {}
    for a, levels in attributes.items():
        own = {x: at[f"{a}={x}"] for x in levels[:-1]}
        out[a] = own | {levels[-1]: -sum(own.values())}
    return out


def ratings(df: DataFrame, rating: str, x: dict[str, Column], respondent: str | None = None, weight: str | None = None) -> LinearFit:
    """Pooled least squares, or within respondents when one is given."""
    if respondent is None:
        return linear_regression(df, rating, x, weight, covariance="classical")
    flat = df.select(respondent, finite(rating).alias("__r"), *(c.alias(k) for k, c in x.items()), *([weight] if weight else []))
    flat = flat.dropna(subset=["__r", *x])
    moved = flat.withColumns({k: within(flat, f"`{k}`", respondent) for k in ("__r", *x)})
    return linear_regression(moved, "__r", {k: F.col(f"`{k}`") for k in x}, weight, intercept=False, covariance="classical")


#: Reasons of ``task_reasons`` that say a task contradicts itself; the others are values or weights that are missing.
BROKEN = ("unavailable_answered", "several_opt_outs", "too_few_alternatives", "invalid_answer")


def whole_tasks(df: DataFrame, scope: DataFrame, respondent: str, task: str) -> DataFrame:
    """All rows of the tasks that a scope touches: a semi-join on (respondent, task).  Rows without either id are in no task."""
    return df.join(scope.select(respondent, task).distinct(), [respondent, task], "left_semi")


def respondent_table(df: DataFrame, respondent: str, design: Design) -> DataFrame:
    """One row a respondent with the weight and design columns, which must be the same in all rows of one.

    A weight that is missing in some rows is missing for the respondent.  Different weights, strata, PSUs or population
    sizes of one respondent are an error.  Rows without a respondent are left out.
    """
    known = df.where(F.col(respondent).isNotNull())
    fixed = [c for c in (design.strata, design.psu, design.fpc) if c is not None]
    weight = weight_column(df, design)
    aggs = [F.min(weight).alias("__low"), F.max(weight).alias("__high"), F.count(weight).alias("__n"), F.count("*").alias("__all")]
    for c in fixed:
        aggs += [F.min(c).alias(f"__a_{c}"), F.max(c).alias(f"__b_{c}")]
    each = known.groupBy(respondent).agg(*aggs)
    differ = reduce(lambda a, b: a | b, (F.col(f"__a_{c}") != F.col(f"__b_{c}") for c in fixed), F.col("__low") != F.col("__high"))
    if not each.where(differ).isEmpty():
        raise CodebookError("a respondent has different weights or design values")
    weighted = F.when(F.col("__n") == F.col("__all"), F.col("__low")).alias("__weight")
    return each.select(respondent, weighted, *(F.col(f"__a_{c}").alias(c) for c in fixed))


def task_reasons(
    df: DataFrame, respondent: str, task: str, mode: str, answer: str, attributes: Sequence[str] = (), available: str | None = None, opt_out: str | None = None, weight: str | None = None
) -> DataFrame:
    """Add reason: why a row is not used, or ``used``.

    In this order: no_id; missing_weight, zero_weight (of the respondent, see ``respondent_table``); unavailable (not
    offered, so not part of the task); and for all other rows of a task: unavailable_answered (one that was not offered
    is chosen or ranked), several_opt_outs, too_few_alternatives (fewer than two offered), missing (an offered one lacks
    an attribute or its answer; an opt-out needs no attributes), invalid_answer (not one choice, or not the ranks 1 to J).
    A missing availability counts as offered, a missing opt-out flag as none.
    """
    if mode not in ("choice", "ranking"):
        raise CodebookError(f"unknown mode {mode}")
    value = F.col(answer).cast("double")
    offered = F.lit(True) if available is None else F.coalesce(F.col(available).cast("boolean"), F.lit(True))
    out = F.lit(False) if opt_out is None else F.coalesce(F.col(opt_out).cast("boolean"), F.lit(False))
    kinds = dict(df.dtypes)
    hole = lambda c: F.col(f"`{c}`").isNull() | (F.isnan(f"`{c}`") if kinds[c] in ("double", "float") else F.lit(False))
    lacks = value.isNull() | F.isnan(value) | reduce(lambda a, b: a | b, ((hole(c) & ~out) for c in attributes), F.lit(False))
    answered = (value == 1) if mode == "choice" else value.isNotNull()
    w = Window.partitionBy(respondent, task)  # of a task's few alternatives
    over = lambda c: F.count_if(offered & c).over(w)
    n = over(F.lit(True))
    if mode == "choice":
        good = over(answered) == 1
    else:
        mine = F.when(offered, value)
        good = (F.min(mine).over(w) == 1) & (F.max(mine).over(w) == n) & (F.size(F.collect_set(mine).over(w)) == n) & (over(value != F.floor(value)) == 0)
    no_id = F.col(respondent).isNull() | F.col(task).isNull()
    reason = F.when(~offered, "unavailable")
    for name, c in (
        ("unavailable_answered", F.count_if(~offered & F.coalesce(answered, F.lit(False))).over(w) > 0),
        ("several_opt_outs", over(out) > 1),
        ("too_few_alternatives", n < 2),
        ("missing", over(lacks) > 0),
        ("invalid_answer", ~F.coalesce(good, F.lit(False))),
    ):
        reason = reason.when(c, name)
    # rows without ids are no task: they stay out of the windows
    inside = df.where(~no_id).withColumn("reason", reason.otherwise("used"))
    if weight is not None:
        of = F.col("reason")
        zero = F.when(F.col(weight).isNull(), "missing_weight").when(F.col(weight) == 0, "zero_weight")
        inside = inside.withColumn("reason", F.coalesce(zero, of))
    return inside.unionByName(df.where(no_id).withColumn("reason", F.lit("no_id")))


def stages(df: DataFrame, respondent: str, task: str, mode: str, answer: str) -> DataFrame:
    """Choice sets with __stage and __chosen: the task itself, or for ranks the sets left after each better one."""
    if mode == "choice":
        return df.withColumn("__stage", F.lit(1)).withColumn("__chosen", (F.col(answer).cast("double") == 1).cast("int"))
    last = F.max(answer).over(Window.partitionBy(respondent, task))
    rows = df.withColumn("__last", last).withColumn("__stage", F.explode(F.sequence(F.lit(1), F.least(F.col(answer), F.col("__last") - 1).cast("int"))))
    return rows.withColumn("__chosen", (F.col(answer) == F.col("__stage")).cast("int")).drop("__last")


@dataclass(frozen=True)
class ChoiceFit:
    names: tuple[str, ...]
    beta: np.ndarray
    hessian: np.ndarray
    nll: float
    n_sets: int
    model_covariance: np.ndarray
    cluster_covariance: np.ndarray
    reference_df: float = math.inf

    def table(self) -> list[dict[str, float | str]]:
        """Terms with normal p-values; p_t takes the reference distribution with the design's or respondents' degrees."""
        se = np.sqrt(np.diag(self.cluster_covariance))
        tail = lambda z: 2 * dist.norm_sf(z) if math.isinf(self.reference_df) else dist.t_sf2(z, self.reference_df)
        return [
            {"term": n, "beta": float(b), "se": float(s), "z": float(b / s), "p": 2 * dist.norm_sf(abs(b / s)), "p_t": float(tail(abs(b / s)))}
            for n, b, s in zip(self.names, self.beta, se, strict=True)
        ]


def _choice_sets(rows: DataFrame, x: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """A row a choice set: weight and the attributes of its alternatives in one array, the chosen one's first."""
    one = F.struct((-F.col("__chosen")).alias("o"), F.array(*(F.col(f"`{c}`").cast("double") for c in x)).alias("x"))
    each = rows.groupBy(*keys).agg(F.first("__w").alias("__w"), F.array_sort(F.collect_list(one)).alias("__a"))
    return each.select(keys[0], "__w", F.flatten(F.transform("__a", lambda a: a["x"])).alias("__x"))


def _moments(batch: pa.RecordBatch, beta: np.ndarray) -> tuple[np.ndarray, ...]:
    """Weights, log-likelihoods and scores of a batch of choice sets, and their information."""
    k = len(beta)
    col = batch.column("__x")
    x = col.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
    size = col.value_lengths().to_numpy(zero_copy_only=False) // k
    first = np.cumsum(size) - size
    w = batch.column("__w").to_numpy(zero_copy_only=False)
    v = x @ beta
    v = v - np.repeat(v[first], size)  # utilities beside that of the chosen one
    top = np.maximum.reduceat(v, first)
    u = np.exp(v - np.repeat(top, size))
    total = np.add.reduceat(u, first)
    p = u / np.repeat(total, size)
    base = x[first]
    x = x - np.repeat(base, size, axis=0)  # differences keep their digits however far away the values are
    mean = np.add.reduceat(p[:, None] * x, first)
    x = x - np.repeat(mean, size, axis=0)
    return w, -top - np.log(total), -mean, (x * (p * np.repeat(w, size))[:, None]).T @ x


def conditional_logit(
    df: DataFrame, x: dict[str, Column], respondent: str, task: str, mode: str, answer: str, iterations: int = 50,
    available: str | None = None, opt_out: str | None = None, design: Design | None = None, scope: Column | None = None, strict: bool = False,
) -> ChoiceFit:
    """Newton steps over choice sets, each of which is one row of arrays: a step is one pass that shuffles nothing.

    Rows that ``task_reasons`` does not call used stay out; with ``strict`` a task that contradicts itself is an error.
    ``opt_out`` flags alternatives without attributes: these count 0 and the term ``opt_out`` has their constant.
    ``scope`` says which rows are analysed; a task must lie in it whole (``whole_tasks`` widens a scope).
    The covariance that counts is clustered by respondent: with the correction G / (G - 1), where G adds up frequencies
    if the design's weight is one; or, with survey weights, strata or PSUs, the design covariance of respondents' score
    totals, whose frame is all respondents of ``df`` whether they are in the scope or not.
    """
    design = design or Design()
    survey = (design.weight is not None and design.weight_type != "frequency") or any(c is not None for c in (design.strata, design.psu, design.fpc))
    flag = F.lit(False) if opt_out is None else F.coalesce(F.col(opt_out).cast("boolean"), F.lit(False))
    cols = {n: F.when(flag, 0.0).otherwise(c) if opt_out is not None else c for n, c in x.items()} | ({"opt_out": flag.cast("double")} if opt_out is not None else {})
    flags = [F.lit(True).alias("__offered") if available is None else F.col(available).alias("__offered"), flag.alias("__out")]
    rows = df.select(F.col(respondent).alias("__r"), F.col(task).alias("__t"), F.col(answer).alias("__answer"), *flags, *(c.alias(n) for n, c in cols.items()),
                     (F.lit(True) if scope is None else F.coalesce(scope, F.lit(False))).alias("__in"))
    if scope is not None:
        cut = rows.where("__r IS NOT NULL AND __t IS NOT NULL").groupBy("__r", "__t").agg(F.count_if("__in").alias("i"), F.count("*").alias("n"))
        if not cut.where("i > 0 AND i < n").isEmpty():
            raise CodebookError("the scope holds parts of tasks")
    rows = rows.where("__in")
    people = respondent_table(df, respondent, design)
    weighted = rows.withColumn("__w", F.lit(1.0))
    if design.weight is not None:
        weighted = rows.join(people.select(F.col(respondent).alias("__r"), F.col("__weight").alias("__w")), "__r", "left")
    reasons = task_reasons(weighted, "__r", "__t", mode, "__answer", list(cols), "__offered", "__out", "__w")
    if strict and (bad := reasons.where(F.col("reason").isin(*BROKEN)).select("reason").first()):
        raise CodebookError(f"a task breaks a rule: {bad[0]}")
    used = stages(reasons.where("reason = 'used'"), "__r", "__t", mode, "__answer")
    names, k = list(cols), len(cols)
    sets = _choice_sets(used, names, ["__r", "__t", "__stage"]).persist(StorageLevel.DISK_ONLY)

    def step(beta: np.ndarray) -> tuple[int, float, np.ndarray, np.ndarray]:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 + k + k * k)
            for b in batches:
                if b.num_rows:
                    w, ll, score, h = _moments(b, beta)
                    total += np.concatenate([[b.num_rows, w @ ll], w @ score, h.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([total])], names=["s"])

        s = sets.mapInArrow(add, "s array<double>")
        r = np.array(s.agg(*(F.sum(F.col("s")[i]) for i in range(2 + k + k * k))).first(), dtype=float)
        return int(r[0]), r[1], r[2 : 2 + k], r[2 + k :].reshape(k, k)

    beta = np.zeros(k)
    for _ in range(iterations):
        n, ll, score, h = step(beta)
        if not n:
            raise CodebookError("no choice set can be used")
        if np.linalg.eigvalsh(h)[0] < 1e-10 * max(1.0, np.trace(h)) or np.abs(beta).max() > 50:
            raise CodebookError("choices are separated or the design is not of full rank")
        move = np.linalg.solve(h, score)
        beta = beta + move
        if np.abs(move).max() < 1e-10:
            break
    n, ll, score, h = step(beta)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = _moments(b, beta)[2]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column("__w"), *(pa.array(c) for c in np.ascontiguousarray(found.T))], names=out_names)

    out_names = ["__r", "__w", *(f"s{i}" for i in range(k))]
    schema = T.StructType([sets.schema["__r"], *(T.StructField(c, T.DoubleType()) for c in out_names[1:])])
    by = sets.mapInArrow(scores, schema).groupBy("__r").agg(F.first("__w").alias("__w"), *(F.sum(c).alias(c) for c in out_names[2:]))
    inverse = np.linalg.inv(h)
    if survey:
        frame = people.join(by.drop("__w").withColumnRenamed("__r", respondent), respondent, "left")
        frame = frame.withColumns({c: F.coalesce(c, F.lit(0.0)) * F.col("__weight") for c in out_names[2:]})
        own = design_frame(frame, replace(design, weight="__weight"), respondent)
        covariance, degrees = inverse @ total_covariance(own, out_names[2:]) @ inverse, float(own.df)
    else:
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        r = by.agg(F.sum("__w"), *(F.sum(F.col("__w") * F.col(f"s{i}") * F.col(f"s{j}")) for i, j in pairs)).first()
        meat = np.zeros((k, k))
        for (i, j), v in zip(pairs, r[1:], strict=True):
            meat[i, j] = meat[j, i] = v
        g = r[0]
        covariance, degrees = inverse @ meat @ inverse * g / max(g - 1, 1), float(max(g - 1, 1))
    sets.unpersist()
    return ChoiceFit(tuple(names), beta, h, -ll, n, inverse, covariance, degrees)


def simulate(beta: dict[str, float], profiles: Sequence[dict[str, float]], intercept: float = 0.0) -> list[float]:
    """Logit shares of profiles given by their effect-coded columns."""
    u = np.array([intercept + sum(beta[k] * v for k, v in p.items()) for p in profiles])
    e = np.exp(u - u.max())
    return (e / e.sum()).tolist()


def importance(utilities: dict[str, dict[str, float]]) -> dict[str, float]:
    """Ranges of the attributes' utilities in percent of their sum."""
    ranges = {a: max(u.values()) - min(u.values()) for a, u in utilities.items()}
    total = sum(ranges.values())
    return {a: 100 * r / total if total else 0.0 for a, r in ranges.items()}


def willingness_to_pay(names: Sequence[str], beta: np.ndarray, covariance: np.ndarray, price: str, confidence: float = 0.95) -> dict[str, dict[str, float]]:
    """- utility / price slope, with intervals by the delta method."""
    z, j = dist.norm_ppf(0.5 + confidence / 2), list(names).index(price)
    out = {}
    for i, n in enumerate(names):
        if i != j:
            value = -beta[i] / beta[j]
            grad = np.zeros(len(names))
            grad[i], grad[j] = -1 / beta[j], beta[i] / beta[j] ** 2
            se = math.sqrt(grad @ covariance @ grad)
            out[n] = {"wtp": float(value), "low": float(value - z * se), "high": float(value + z * se)}
    return out
