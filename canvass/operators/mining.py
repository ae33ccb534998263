"""Subgroups, surprising associations, feature rankings and the robustness of findings."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canvass.codebook import CodebookError, codes
from canvass.functions import dist
from canvass.functions.columns import finite
from canvass.operators.inference import tau_of_table, welch_anova, welch_t
from canvass.plans.primitives import wide_agg
from canvass.plans.quantiles import exact_quantiles

MAX_LEVELS, MIN_GROUP = 8, 30


def long_pairs(df: DataFrame, attributes: Sequence[str], questions: Sequence[str], numeric: bool) -> DataFrame:
    """(attribute, level, question, value) for each attribute and question of a row."""
    a = F.array(*(F.struct(F.lit(x).alias("attribute"), codes(df, x).alias("level")) for x in attributes))
    q = F.array(*(F.struct(F.lit(x).alias("question"), (finite(x) if numeric else codes(df, x)).alias("value")) for x in questions))
    rows = df.select(F.explode(a).alias("a"), q.alias("q")).where("a.level IS NOT NULL").select("a.*", F.explode("q").alias("q"))
    return rows.select("attribute", "level", "q.*").where("value IS NOT NULL AND attribute <> question")


def numeric_subgroups(df: DataFrame, attributes: Sequence[str], questions: Sequence[str]) -> DataFrame:
    """Moments of every question in every level of every attribute, with the rest's mean and the difference; one pass."""
    g = (
        long_pairs(df, attributes, questions, numeric=True)
        .groupBy("attribute", "level", "question")
        .agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("var"), F.sum("value").alias("s"))
    )
    w = Window.partitionBy("attribute", "question")  # of at most the attribute's levels
    rest_n = F.sum("n").over(w) - F.col("n")
    return g.select(
        "attribute", "level", "question", "n", "mean", "var",
        F.try_divide(F.sum("s").over(w) - F.col("s"), rest_n).alias("rest_mean"),
        (F.col("mean") - F.try_divide(F.sum("s").over(w) - F.col("s"), rest_n)).alias("difference"),
    )


def categorical_subgroups(df: DataFrame, attributes: Sequence[str], questions: Sequence[str]) -> DataFrame:
    """Counts of every attribute by question table, with adjusted residuals."""
    g = long_pairs(df, attributes, questions, numeric=False).groupBy("attribute", "level", "question", "value").agg(F.count("*").alias("n"))
    over = lambda *by: F.sum("n").over(Window.partitionBy("attribute", "question", *by))
    t = g.select("*", over("level").alias("a"), over("value").alias("b"), over().alias("t"))
    e = F.col("a") * F.col("b") / F.col("t")
    spread = e * (1 - F.col("a") / F.col("t")) * (1 - F.col("b") / F.col("t"))
    return t.select("attribute", "level", "question", "value", "n", F.try_divide(F.col("n") - e, F.sqrt(F.greatest(spread, F.lit(0.0)))).alias("residual"))


@dataclass(frozen=True)
class Finding:
    attribute: str
    question: str
    effect: float
    p: float
    q: float
    n: int
    score: float
    top_level: str
    fdr: bool = False
    bonferroni: bool = False
    #: (level, level, difference, adjusted p) of each pair of levels; p-values are adjusted within the finding.
    posthoc: tuple[tuple[str, str, float, float], ...] = ()


#: Groups whose moments the driver tests; an error beyond.
MAX_GROUPS = 100_000


def posthoc(groups: Sequence[dict]) -> tuple[tuple[str, str, float, float], ...]:
    """Welch's test of every pair of levels from their moments, with p-values adjusted over the pairs."""
    moments = [g | {"w": g["n"], "w2": g["n"]} for g in sorted(groups, key=lambda g: g["level"])]
    pairs = [(a, b, welch_t(a, b)) for a, b in itertools.combinations(moments, 2)]
    adjusted = dist.benjamini_hochberg(np.array([t["p"] for *_, t in pairs])) if pairs else []
    return tuple((a["level"], b["level"], float(t["difference"]), float(q)) for (a, b, t), q in zip(pairs, adjusted, strict=True))


def mine_numeric(
    df: DataFrame, attributes: Sequence[str], questions: Sequence[str], min_group: int = MIN_GROUP, surprise: dict[tuple[str, str], float] | None = None, alpha: float = 0.05
) -> list[Finding]:
    """Welch tests of every attribute and question with adjusted p-values, ranked by a composite of effect, evidence,
    coverage and surprise (weights .35, .30, .20, .15).

    Each says whether it holds at ``alpha`` by false discovery rate and by Bonferroni's bound, and has its pairs of levels."""
    groups: dict[tuple[str, str], list[dict]] = {}
    found = numeric_subgroups(df, attributes, questions).where((F.col("n") >= min_group) & (F.col("var") > 0)).limit(MAX_GROUPS + 1).collect()
    if len(found) > MAX_GROUPS:
        raise CodebookError(f"more than {MAX_GROUPS} groups")
    for r in found:
        groups.setdefault((r["attribute"], r["question"]), []).append(r.asDict())
    found = []
    total = max(1, df.count())
    for (a, q), g in sorted(groups.items()):
        if len(g) < 2:
            continue
        test = welch_anova(g)
        n = sum(x["n"] for x in g)
        grand = sum(x["n"] * x["mean"] for x in g) / n
        between = sum(x["n"] * (x["mean"] - grand) ** 2 for x in g)
        eta2 = between / (between + sum((x["n"] - 1) * x["var"] for x in g))
        top = max(g, key=lambda x: (abs(x["difference"] or 0), x["level"]))
        found.append((a, q, math.sqrt(eta2), test["p"], n, top["level"]))
    adjusted = dist.benjamini_hochberg(np.array([f[3] for f in found])) if found else []
    out = []
    for (a, q, effect, p, n, level), adj in zip(found, adjusted, strict=True):
        evidence = min(-math.log10(max(p, 1e-12)) / 12, 1.0)
        score = 0.35 * min(effect / 0.5, 1) + 0.30 * evidence + 0.20 * n / total + 0.15 * (surprise or {}).get((a, q), 0.0)
        out.append(Finding(a, q, effect, p, float(adj), n, score, level, bool(adj <= alpha), bool(p <= alpha / len(found)), posthoc(groups[(a, q)])))
    return sorted(out, key=lambda f: (-f.score, f.attribute, f.question))


Rule = tuple[tuple[str, str, object], ...]


def descriptors(df: DataFrame, attributes: Sequence[str], max_levels: int = MAX_LEVELS) -> dict[Rule, Column]:
    """Single conditions: codes of attributes with few of them, quartile ranges of numbers with many."""
    out: dict[Rule, Column] = {}
    counts = df.agg(*(F.approx_count_distinct(codes(df, a)).alias(a) for a in attributes)).first()
    wide = [a for a in attributes if counts[a] > max_levels]
    quartiles = exact_quantiles(df, {a: finite(F.col(a).try_cast("double")) for a in wide}, [0.25, 0.5, 0.75]) if wide else {}
    for a in attributes:
        if a in wide:
            if quartiles[a][0] is None:
                continue
            v = finite(F.col(a).try_cast("double"))
            q1, q2, q3 = quartiles[a]
            for op, value, c in (("<", q1, v < q1), (">=", q3, v >= q3), ("between", (q1, q3), (v >= q1) & (v < q3)), (">=", q2, v >= q2)):
                out[((a, op, value),)] = F.coalesce(c, F.lit(False))
        else:
            for r in df.select(codes(df, a).alias("c")).where("c IS NOT NULL").distinct().orderBy("c").collect():
                out[((a, "==", r["c"]),)] = F.coalesce(codes(df, a) == r["c"], F.lit(False))
    return out


def _rule_scores(df: DataFrame, y: Column, rules: dict[Rule, Column], penalty: float, cap: float, min_group: int, shares: bool = False) -> list[dict]:
    """Score of each rule: sqrt(n m / N) |difference| / deviation, less a price for each further condition.

    Differences of shares of a category are taken as they are."""
    base = df.select(y.alias("y"), *(c.alias(f"r{i}") for i, c in enumerate(rules.values()))).where("y IS NOT NULL")
    aggs = [F.count("*"), F.avg("y"), F.stddev_samp("y")]
    for i in range(len(rules)):
        inside = F.col(f"r{i}")
        aggs += [F.count_if(inside), F.avg(F.when(inside, F.col("y"))), F.avg(F.when(~inside, F.col("y")))]
    got = wide_agg(base, aggs)
    total, _, sd = got[:3]
    if shares:
        sd = 1.0
    out = []
    for i, rule in enumerate(rules):
        n, inside, outside = got[3 + 3 * i : 6 + 3 * i]
        if n < min_group or total - n < min_group or not sd:
            continue
        score = min(math.sqrt(n * (total - n) / total) * abs(inside - outside) / sd, cap) - penalty * (len(rule) - 1)
        out.append({"rule": rule, "n": n, "mean": inside, "rest_mean": outside, "effect": (inside - outside) / sd, "score": score})
    return sorted(out, key=lambda r: (-r["score"], str(r["rule"])))


def discover(
    df: DataFrame, target: Column, attributes: Sequence[str], depth: int = 2, beam: int = 30, top: int = 10, min_group: int = MIN_GROUP, penalty: float = 0.05,
    cap: float = 50.0, overlap: float = 0.5, category: object = None, min_effect: float = 0.0,
) -> list[dict]:
    """Rules by beam search: all single conditions in one aggregation, then conjunctions of the best in another.

    With a ``category`` the target is whether it has this value, and rules are scored by the difference of its shares.
    The result keeps rules with an effect of at least ``min_effect`` whose rows differ enough from those kept before
    (Jaccard at most ``overlap``).
    """
    shares = category is not None
    if shares:
        target = (target == F.lit(category)).cast("double")
    single = descriptors(df, attributes)
    rules, frontier = dict(single), single
    found = _rule_scores(df, target, single, penalty, cap, min_group, shares)
    for _ in range(depth - 1):
        best = [r["rule"] for r in found if r["rule"] in frontier][:beam]
        frontier = {}
        for a, b in itertools.product(best, single):
            if b[0][0] not in {c[0] for c in a}:
                rule = tuple(sorted((*a, *b), key=str))
                frontier.setdefault(rule, rules[a] & single[b])
        rules |= frontier
        found = sorted(found + _rule_scores(df, target, frontier, penalty, cap, min_group, shares), key=lambda r: (-r["score"], str(r["rule"])))
    pool = [r for r in found if abs(r["effect"]) >= min_effect][: 4 * top]
    flags = df.select(*(rules[r["rule"]].alias(f"r{i}") for i, r in enumerate(pool)))
    pairs = list(itertools.combinations(range(len(pool)), 2))
    both = dict(zip(pairs, wide_agg(flags, [F.count_if(F.col(f"r{i}") & F.col(f"r{j}")) for i, j in pairs]), strict=True)) if pairs else {}
    sizes = wide_agg(flags, [F.count_if(F.col(f"r{i}")) for i in range(len(pool))]) if pool else []
    kept: list[int] = []
    for i in range(len(pool)):
        if all(both[(j, i)] / (sizes[i] + sizes[j] - both[(j, i)]) <= overlap for j in kept):
            kept.append(i)
    return [pool[i] for i in kept[:top]]


def tau_rule(df: DataFrame, x: str, y: str, inside: Column) -> dict[str, float]:
    """Kendall's tau-b inside and outside a rule, from one table of three columns."""
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(inside.alias("inside"), x, y).agg(F.count("*").alias("n")).collect()
    xs, ys = sorted({c[x] for c in cells}), sorted({c[y] for c in cells})
    t = np.zeros((2, len(xs), len(ys)))
    for c in cells:
        t[int(c["inside"]), xs.index(c[x]), ys.index(c[y])] = c["n"]
    return {"inside": tau_of_table(t[1]), "outside": tau_of_table(t[0]), "difference": tau_of_table(t[1]) - tau_of_table(t[0])}


def pinned(candidates: Sequence[dict], **context: object) -> str:
    """Digest of a set of candidates with the revision and parameters they were found under."""
    text = json.dumps({"candidates": sorted(map(str, candidates)), **context}, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()


def verify(df: DataFrame, target: Column, rules: dict[Rule, Column], part: Column) -> DataFrame:
    """The pinned rules' effects in each part (hold-out or fold): only they are computed again."""
    base = df.select(part.alias("part"), target.alias("y"), *(c.alias(f"r{i}") for i, c in enumerate(rules.values()))).where("y IS NOT NULL")
    each = F.array(*(F.struct(F.lit(str(r)).alias("rule"), F.col(f"r{i}").alias("inside")) for i, r in enumerate(rules)))
    g = base.select("part", "y", F.explode(each).alias("r")).groupBy("part", "r.rule").agg(
        F.count_if("r.inside").alias("n"), F.avg(F.when(F.col("r.inside"), F.col("y"))).alias("mean"),
        F.avg(F.when(~F.col("r.inside"), F.col("y"))).alias("rest_mean"), F.stddev_samp("y").alias("sd"),
    )
    effect = F.try_divide(F.col("mean") - F.col("rest_mean"), F.col("sd"))
    w = Window.partitionBy("rule")
    steady = F.abs(F.sum(F.signum(effect)).over(w)) == F.count("*").over(w)
    return g.select("rule", "part", "n", "mean", "rest_mean", effect.alias("effect"), F.when(steady, "replicated").otherwise("reversed").alias("status"))


def surprise(df: DataFrame, columns: Sequence[str], bins: int = 5, cap: float = 5.0, min_n: int = 5) -> DataFrame:
    """Every pair of columns: Cramer's V less half its noise, the largest cell lift (3 rows or more), and their mean.

    Numbers are cut at quantiles.  All pairs' tables come from one aggregation over (pair, code, code).
    """
    from canvass.operators.transform import bin_edges, bin_index

    numeric = {"double", "float", "long", "integer"}
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    cut = {c: bin_index(finite(c), bin_edges(df, c, "quantile", bins)).cast("string") if kinds[c] in numeric else codes(df, c) for c in columns}
    pairs = F.array(
        *(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(a).alias("i"), F.col(b).alias("j")) for a, b in itertools.combinations(columns, 2))
    )
    cells = df.select(*(v.alias(c) for c, v in cut.items())).select(F.explode(pairs).alias("p")).select("p.*").where("i IS NOT NULL AND j IS NOT NULL")
    g = cells.groupBy("x", "y", "i", "j").agg(F.count("*").alias("n"))
    over = lambda *by: F.sum("n").over(Window.partitionBy("x", "y", *by))
    t = g.select("*", over("i").alias("a"), over("j").alias("b"), over().alias("t"))
    lift = F.when(F.col("n") >= 3, F.col("n") * F.col("t") / (F.col("a") * F.col("b")))
    s = t.groupBy("x", "y", "t").agg(
        F.sum(F.col("n") * F.col("n") / (F.col("a") * F.col("b"))).alias("s"), F.count_distinct("i").alias("r"), F.count_distinct("j").alias("c"), F.max(lift).alias("lift")
    )
    least = F.least("r", "c") - 1
    v = F.sqrt(F.greatest(F.try_divide(F.col("s") - 1, least), F.lit(0.0)))
    noise = F.sqrt(F.try_divide((F.col("r") - 1) * (F.col("c") - 1), F.col("t") * least))
    strength = F.greatest(v - noise / 2, F.lit(0.0))
    odd = F.least(F.greatest(F.coalesce(F.log2("lift"), F.lit(0.0)), F.lit(0.0)), F.lit(cap)) / cap
    return s.where((F.col("t") >= min_n) & (least > 0)).select("x", "y", F.col("t").alias("n"), v.alias("cramers_v"), strength.alias("strength"), odd.alias("unexpectedness"), ((strength + odd) / 2).alias("surprise"))


# --- robustness


def removal_sweep(df: DataFrame, quality: str, group: str, value: str, a: str, b: str, key: str, fractions: Sequence[float] = (0.0, 0.05, 0.1, 0.2)) -> DataFrame:
    """Difference of two groups' means after the rows of least quality are removed, for each fraction; one pass after
    the ranks."""
    from canvass.operators.selection import positions

    rows = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull() & F.col(quality).isNotNull())
    rows = positions(rows, quality, then=[key])
    n = rows.count()
    mean = lambda g, f: F.avg(F.when((F.col("position") >= math.floor(f * n)) & (F.col(group) == g), F.col(value)))
    found = [F.struct(F.lit(float(f)).alias("fraction"), (mean(a, f) - mean(b, f)).alias("difference")) for f in fractions]
    return rows.agg(F.array(*found).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def jackknife(df: DataFrame, group: str, value: str, a: str, b: str, key: str, top: int = 10) -> DataFrame:
    """The rows whose removal changes the difference of means most."""
    rows = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull())
    g = F.broadcast(rows.groupBy(group).agg(F.count("*").alias("__n"), F.avg(value).alias("__m")))
    sign = F.when(F.col(group) == a, 1.0).otherwise(-1.0)
    change = sign * F.try_divide(F.col("__m") - F.col(value), F.col("__n") - 1)
    return rows.join(g, group).select(key, change.alias("influence")).orderBy(F.desc(F.abs("influence")), key).limit(top)


def bootstrap(df: DataFrame, group: str, value: str, a: str, b: str, key: str, replicates: int = 100, seed: int = 42, confidence: float = 0.95) -> dict[str, float]:
    """Percentile interval of the difference of means; each row has a Poisson(1) weight in each replicate, drawn from
    its key, so that replicates are one aggregation."""
    rows = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).select(group, F.col(value).alias("v"), key)
    unit = F.pmod(F.xxhash64(key, F.lit(seed), F.col("r")), F.lit(1 << 40)) / float(1 << 40)
    p, cuts = 0.0, []
    for k in range(8):
        p += math.exp(-1) / math.factorial(k)
        cuts.append(p)
    weight = F.lit(8)
    for k in reversed(range(8)):
        weight = F.when(F.col("u") < cuts[k], k).otherwise(weight)
    each = rows.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("u", unit).withColumn("w", weight)
    means = each.groupBy("r", group).agg(F.try_divide(F.sum(F.col("w") * F.col("v")), F.sum("w")).alias("m")).groupBy("r").agg(
        F.max(F.when(F.col(group) == a, F.col("m"))).alias("ma"), F.max(F.when(F.col(group) == b, F.col("m"))).alias("mb")
    )
    d = np.array([r["ma"] - r["mb"] for r in means.where("ma IS NOT NULL AND mb IS NOT NULL").collect()])
    low, high = np.quantile(d, [(1 - confidence) / 2, (1 + confidence) / 2])
    flips = float((np.sign(d) != np.sign(np.median(d))).mean())
    grade = "A" if flips < 0.01 else "B" if flips < 0.05 else "C" if flips < 0.2 else "D"
    return {"low": float(low), "high": float(high), "flip_rate": flips, "grade": grade}


def sensitivity(df: DataFrame, group: str, value: str, a: str, b: str, threshold: float = 3.0) -> dict[str, float | bool]:
    """Difference of means with and without rows whose |z| is above the threshold; robust if both tell the same."""
    m, s = df.agg(F.avg(value), F.stddev_samp(value)).first()
    if not s:
        raise CodebookError("the value is constant")
    inside = F.abs((F.col(value) - F.lit(m)) / F.lit(s)) <= threshold
    out = {}
    for name, cond in (("baseline", F.lit(True)), ("trimmed", inside)):
        g = {r[group]: r for r in df.where(F.col(group).isin(a, b) & cond).groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")).collect()}
        x, y = g[a], g[b]
        se = math.sqrt(x["v"] / x["n"] + y["v"] / y["n"])
        df_ = se**4 / ((x["v"] / x["n"]) ** 2 / (x["n"] - 1) + (y["v"] / y["n"]) ** 2 / (y["n"] - 1))
        t = dist.t_ppf(0.975, df_)
        out[name], out[f"{name}_low"], out[f"{name}_high"] = x["m"] - y["m"], x["m"] - y["m"] - t * se, x["m"] - y["m"] + t * se
    crosses = lambda k: out[f"{k}_low"] <= 0 <= out[f"{k}_high"]
    change = abs(out["trimmed"] - out["baseline"]) / max(abs(out["baseline"]), 1e-12)
    out["robust"] = out["trimmed"] * out["baseline"] > 0 and change <= 0.20 and crosses("baseline") == crosses("trimmed")
    return out
