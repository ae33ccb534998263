"""Tests and effect sizes from group moments, ranks and contingency tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canvass.codebook import CodebookError
from canvass.functions import dist
from canvass.functions.columns import finite, ratio
from canvass.operators.crosstab import association, pearson, table
from canvass.operators.summaries import correlation_pairs
from canvass.plans.primitives import group_moments, value_ranks

METHODS = ("auto", "pearson", "fisher", "frequency", "rao_scott", "none")


def resolve(requested: str, weight_type: str | None) -> str:
    """The test of a table under its weight; a test that does not fit the weight is an error, never replaced."""
    if requested not in METHODS:
        raise CodebookError(f"unknown method {requested}")
    if requested == "auto":
        return {None: "pearson", "frequency": "frequency", "survey": "none"}[weight_type]
    fits = {"pearson": None, "fisher": None, "frequency": "frequency", "rao_scott": "survey", "none": weight_type}
    if fits[requested] != weight_type:
        raise CodebookError(f"{requested} does not fit the weight")
    return requested


@dataclass(frozen=True)
class Test:
    """A test, what it compares and on which scales: each test below declares itself with ``serves``."""

    name: str
    compares: str  # groups, or a pair of variables
    least: int  # groups it needs
    most: float
    scales: frozenset[str]
    run: Callable[[DataFrame, str, str], dict]


_TESTS: list[Test] = []


def serves(compares: str, *scales: str, least: int = 2, most: float = math.inf):
    """Declare what a function of (df, group or first variable, second variable) is a test for."""

    def declare(run: Callable[[DataFrame, str, str], dict]):
        _TESTS.append(Test(run.__name__.removeprefix("run_"), compares, least, most, frozenset(scales), run))
        return run

    return declare


def test_for(compares: str, scale: str, groups: int = 2) -> Test:
    """The declared test of a variable of a scale between so many groups, or of a pair of variables."""
    fits = [t for t in _TESTS if t.compares == compares and scale in t.scales and (compares == "pair" or t.least <= groups <= t.most)]
    if not fits:
        raise CodebookError(f"no test of a {scale} variable for {compares}")
    return fits[0]


def run_test(df: DataFrame, x: str, y: str, scale: str, compares: str = "groups", most: int = 1000) -> dict:
    """Run the test that fits: of y between the groups of x, or of x with y; the result has its name as ``method``."""
    groups = 2
    if compares == "groups":
        groups = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x).distinct().limit(most + 1).count()
        if groups > most:
            raise CodebookError(f"{x} has more than {most} groups")
    test = test_for(compares, scale, groups)
    return {"method": test.name, "groups": groups} | test.run(df, x, y)


def table_test(found: DataFrame, method: str) -> dict[str, float | None]:
    """Pearson or frequency chi-square, or Fisher's test, of a cells table; unavailable values are None."""
    _, _, m = table(found, "n" if method in ("pearson", "fisher") else "w")
    if method == "fisher":
        if m.shape != (2, 2):
            raise CodebookError("Fisher's test takes a table of two by two")
        return {"p": dist.fisher_exact(m)}
    return pearson(m)


def two_by_two(m: np.ndarray) -> dict[str, float | str]:
    """Difference of proportions, with Fisher's test if an expected count is below 5 and chi-square otherwise."""
    m = np.asarray(m, dtype=float)
    expected = np.outer(m.sum(axis=1), m.sum(axis=0)) / m.sum()
    small = bool((expected < 5).any())
    p = dist.fisher_exact(m) if small else pearson(m)["p"]
    return {"difference": m[0, 0] / m[0].sum() - m[1, 0] / m[1].sum(), "method": "fisher" if small else "chi2", "p": p}


def moments_by(df: DataFrame, group: str, value: str, weight: str | None = None) -> dict[str, dict[str, float]]:
    """Moments of each group; groups are levels of a variable, so few."""
    rows = group_moments(df.where(F.col(group).isNotNull()), [group], value, weight).collect()
    return {r[group]: r.asDict() for r in sorted(rows, key=lambda r: str(r[group]))}


def welch_t(a: dict, b: dict, confidence: float = 0.95) -> dict[str, float]:
    """Welch's test of two groups' moments; weighted groups count with their effective sizes."""
    size = lambda g: g["w"] ** 2 / g["w2"]
    va, vb = a["var"] / size(a), b["var"] / size(b)
    difference, se = a["mean"] - b["mean"], math.sqrt(va + vb)
    df = (va + vb) ** 2 / (va**2 / (size(a) - 1) + vb**2 / (size(b) - 1))
    reach = dist.t_ppf(0.5 + confidence / 2, df) * se
    return {"difference": difference, "t": difference / se, "df": df, "p": dist.t_sf2(difference / se, df), "low": difference - reach, "high": difference + reach}


def cohens_d(a: dict, b: dict) -> float:
    pooled = ((a["n"] - 1) * a["var"] + (b["n"] - 1) * b["var"]) / (a["n"] + b["n"] - 2)
    return (a["mean"] - b["mean"]) / math.sqrt(pooled)


def welch_anova(groups: Sequence[dict]) -> dict[str, float]:
    """Welch's analysis of variance from the moments of k groups."""
    k = len(groups)
    w = np.array([g["n"] / g["var"] for g in groups])
    mean = np.array([g["mean"] for g in groups])
    n = np.array([g["n"] for g in groups])
    grand = (w * mean).sum() / w.sum()
    spread = ((1 - w / w.sum()) ** 2 / (n - 1)).sum()
    f = (w * (mean - grand) ** 2).sum() / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1) * spread)
    df2 = (k * k - 1) / (3 * spread)
    return {"f": float(f), "df1": k - 1, "df2": float(df2), "p": dist.f_sf(float(f), k - 1, float(df2))}


def rank_sums(df: DataFrame, group: str, value: str) -> DataFrame:
    """For each group: n and sum of average ranks over all groups; with the tie term and n of all rows."""
    rows = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(group, F.col(value).alias("__v"))
    counts = rows.groupBy("__v", group).agg(F.count("*").alias("__n"))
    ranks = value_ranks(rows, "__v").select("__v", "ties", "avg_rank")
    whole = F.broadcast(ranks.agg(F.sum("ties").alias("n_all"), F.sum(F.pow(F.col("ties"), 3.0) - F.col("ties")).alias("tie_term")))
    return (
        counts.join(ranks, "__v")
        .groupBy(group)
        .agg(F.sum("__n").alias("n"), F.sum(F.col("__n") * F.col("avg_rank")).alias("rank_sum"))
        .join(whole)
    )


def mann_whitney(df: DataFrame, group: str, value: str, first: str, second: str) -> dict[str, float]:
    """U of the first group, two-sided p (normal, corrected for ties and continuity) and Cliff's delta."""
    rows = {r[group]: r for r in rank_sums(df.where(F.col(group).isin(first, second)), group, value).collect()}
    a, b = rows[first], rows[second]
    n, m = a["n"], b["n"]
    u = a["rank_sum"] - n * (n + 1) / 2
    total = n + m
    sd = math.sqrt(n * m / 12 * (total + 1 - a["tie_term"] / (total * (total - 1))))
    z = (abs(u - n * m / 2) - 0.5) / sd if sd else 0.0
    return {"u": u, "z": max(z, 0.0), "p": min(1.0, 2 * dist.norm_sf(max(z, 0.0))), "cliffs_delta": 2 * u / (n * m) - 1}


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """H corrected for ties, degrees of freedom and epsilon squared, as one row."""
    r = rank_sums(df, group, value)
    n = F.max("n_all")
    h = 12 / (n * (n + 1)) * F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")) - 3 * (n + 1)
    h = F.try_divide(h, 1 - F.max("tie_term") / (F.pow(n, F.lit(3.0)) - n))
    return r.agg(h.alias("h"), (F.count("*") - 1).alias("df"), F.try_divide(h, n - 1).alias("epsilon_squared"))


def kendall_tau_b(df: DataFrame, x: str, y: str) -> DataFrame:
    """Concordant and discordant pairs of rows of two ordered columns and tau-b, as one row, whatever their values."""
    from canvass.operators.relations import pair_cells, rank_correlations

    found = rank_correlations(pair_cells(df, [(x, y)], {c: _ordered(df, c) for c in (x, y)})).get(0, {"c": 0.0, "d": 0.0, "tau_b": None})
    return df.sparkSession.createDataFrame([(int(round(found["c"])), int(round(found["d"])), found["tau_b"])], "c long, d long, tau_b double")


def _ordered(df: DataFrame, c: str) -> Column:
    """A number as it is, a text by its place among the (few) codes of the column."""
    if df.schema[c].dataType.typeName() not in ("string", "boolean"):
        return finite(c)
    levels = [r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).limit(1001).collect()]
    if len(levels) > 1000:
        raise CodebookError(f"{c}: an ordinal column has at most 1000 codes")
    return F.array_position(F.array(*map(F.lit, levels)), F.col(c)).cast("double") if levels else F.lit(None).cast("double")


def benjamini_hochberg(tests: DataFrame, p: str = "p") -> DataFrame:
    """Add q: adjusted p-values of a table of tests (one row a test, so a small table)."""
    every = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(p))
    stepped = tests.withColumn("__s", F.col(p) * F.count("*").over(every) / place)
    q = F.min("__s").over(Window.orderBy(F.desc(p), F.desc("__s")).rowsBetween(Window.unboundedPreceding, 0))
    return stepped.withColumn("q", F.least(q, F.lit(1.0))).drop("__s")


def _pair_tables(df: DataFrame, x: str, y: str, mask: str, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Counts of (x, y) inside and outside a mask; ordinal variables have few values."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y"))
    inside = F.coalesce(F.col(mask), F.lit(False))
    cells = rows.agg(F.count_if(inside).alias("a"), F.count_if(~inside).alias("b")).limit(most + 1).collect()
    if len(cells) > most:
        raise CodebookError(f"{x} and {y} have more than {most} pairs of values")
    xs, ys = ({v: i for i, v in enumerate(sorted({c[k] for c in cells}))} for k in ("x", "y"))
    out = np.zeros((2, len(xs), len(ys)), dtype=np.int64)
    for c in cells:
        out[:, xs[c["x"]], ys[c["y"]]] = c["a"], c["b"]
    return out[0], out[1]


def drawn_without_return(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of n rows drawn without return are in each cell, one conditional draw a cell after the other.

    That is the table of permuted labels, without touching the rows.  Counts from a billion on, beyond the generator's
    range, are drawn from the normal distribution of the same mean and variance."""
    out, left = np.zeros(len(counts), dtype=np.int64), int(counts.sum())
    for i, c in enumerate(counts.tolist()):
        rest = left - c
        if n == 0 or left == 0:
            break
        if left < 1_000_000_000:
            k = int(rng.hypergeometric(c, rest, n)) if c else 0
        else:
            share = c / left
            sd = math.sqrt(max(n * share * (1 - share) * (left - n) / max(left - 1, 1), 0.0))
            k = int(min(max(round(rng.normal(n * share, sd)), n - rest, 0), c, n))
        out[i], n, left = k, n - k, rest
    return out


def tau_permutation(df: DataFrame, x: str, y: str, mask: str, permutations: int = 200, seed: int = 42) -> dict[str, float]:
    """Difference of tau-b inside and outside a mask, with a permutation p-value.

    Permuting the mask over the rows draws, without return, the rows inside from the table of (x, y): each replicate is
    such a draw, so the numbers of rows inside and outside stay and the work does not grow with the table.
    """
    inside, outside = _pair_tables(df, x, y, mask)
    both, n, rng = inside + outside, int(inside.sum()), np.random.default_rng(seed)
    observed = tau_of_table(inside) - tau_of_table(outside)
    beyond = 0
    for _ in range(permutations):
        drawn = drawn_without_return(both.ravel(), n, rng).reshape(both.shape)
        beyond += abs(tau_of_table(drawn) - tau_of_table(both - drawn)) >= abs(observed)
    return {"difference": float(observed), "p": (int(beyond) + 1) / (permutations + 1)}


def tau_of_table(t: np.ndarray) -> float:
    below = np.cumsum(np.cumsum(t[::-1, ::-1], axis=0), axis=1)[::-1, ::-1]
    above = np.cumsum(np.cumsum(t[::-1], axis=0), axis=1)[::-1]
    c = (t[:-1, :-1] * below[1:, 1:]).sum() if min(t.shape) > 1 else 0.0
    d = (t[:-1, 1:] * above[1:, :-1]).sum() if min(t.shape) > 1 else 0.0
    n = t.sum()
    pairs = lambda v: (v * (v - 1) / 2).sum()
    rest = (n * (n - 1) / 2 - pairs(t.sum(axis=1))) * (n * (n - 1) / 2 - pairs(t.sum(axis=0)))
    return float((c - d) / math.sqrt(rest)) if rest > 0 else math.nan


def proportion_difference(df: DataFrame, group: str, hit: str) -> DataFrame:
    """Rows and hits of each group."""
    return df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col(hit)).alias("hits")).withColumn("share", ratio(F.col("hits"), F.col("n")))


# --- what each test is for


@serves("groups", "interval", "ratio", most=2)
def run_welch_t(df: DataFrame, group: str, value: str) -> dict:
    a, b = moments_by(df, group, value).values()
    return welch_t(a, b) | {"cohens_d": cohens_d(a, b)}


@serves("groups", "interval", "ratio", least=3)
def run_welch_anova(df: DataFrame, group: str, value: str) -> dict:
    return welch_anova(list(moments_by(df, group, value).values()))


@serves("groups", "ordinal", most=2)
def run_mann_whitney(df: DataFrame, group: str, value: str) -> dict:
    first, second = sorted(r[0] for r in df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(group).distinct().limit(3).collect())
    return mann_whitney(df, group, value, first, second)


@serves("groups", "ordinal", least=3)
def run_kruskal(df: DataFrame, group: str, value: str) -> dict:
    r = kruskal(df, group, value).first().asDict()
    return r | {"p": dist.chi2_sf(r["h"], r["df"])}


@serves("groups", "nominal")
@serves("pair", "nominal")
def run_chi_square(df: DataFrame, x: str, y: str) -> dict:
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    found = rows.groupBy(F.col(x).alias("r"), F.col(y).alias("c")).agg(F.count("*").cast("double").alias("w"))
    r = association(found).first().asDict()
    return r


@serves("pair", "ordinal")
def run_kendall_tau_b(df: DataFrame, x: str, y: str) -> dict:
    return kendall_tau_b(df, x, y).first().asDict()


@serves("pair", "interval", "ratio")
def run_pearson(df: DataFrame, x: str, y: str) -> dict:
    r = correlation_pairs(df, [x, y], digits=12).first()
    return {"r": r["r"], "n": r["n"]}
