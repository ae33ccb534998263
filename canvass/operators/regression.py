"""Linear and logistic regression, key drivers, penalty-reward and local regression."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canvass.codebook import Codebook, CodebookError, codes, score, valid_code
from canvass.functions import dist
from canvass.functions.columns import finite
from canvass.plans.primitives import complete, gram, linear, quadratic, wide_agg

MAX_EXACT_DRIVERS = 12


def design_columns(
    df: DataFrame, numeric: Sequence[str] = (), nominal: dict[str, str] | None = None, levels: dict[str, Sequence[str]] | None = None, interactions: Sequence[tuple[str, str]] = ()
) -> dict[str, Column]:
    """Named design columns: numbers, treatment-coded categories (reference left out), products of pairs of terms."""
    terms: dict[str, dict[str, Column]] = {c: {c: finite(c)} for c in numeric}
    for name, reference in (nominal or {}).items():
        c = codes(df, name)
        found = (levels or {}).get(name) or sorted(r["c"] for r in df.select(c.alias("c")).where("c IS NOT NULL").distinct().collect())
        if reference not in found:
            raise CodebookError(f"{name}: no level {reference}")
        terms[name] = {f"{name}[{x}]": F.when(c.isNotNull(), F.when(c == x, 1.0).otherwise(0.0)) for x in found if x != reference}
    out = {k: v for t in terms.values() for k, v in t.items()}
    for a, b in interactions:
        out |= {f"{x}:{y}": terms[a][x] * terms[b][y] for x in terms[a] for y in terms[b]}
    return out


@dataclass(frozen=True)
class LinearFit:
    names: tuple[str, ...]
    beta: np.ndarray
    covariance: np.ndarray
    bread: np.ndarray
    n: int
    weight: float
    sse: float
    sst: float
    residual_df: float
    kind: str
    rows: DataFrame  # design columns, __y and __w of the rows that were fitted

    @property
    def r2(self) -> float:
        return 1 - self.sse / self.sst

    def table(self, confidence: float = 0.95) -> list[dict[str, float | str]]:
        """Coefficients with t tests and intervals."""
        se = np.sqrt(np.diag(self.covariance))
        t = dist.t_ppf(0.5 + confidence / 2, self.residual_df)
        return [
            {"term": n, "beta": float(b), "se": float(s), "t": float(b / s), "p": dist.t_sf2(float(b / s), self.residual_df), "low": float(b - t * s), "high": float(b + t * s)}
            for n, b, s in zip(self.names, self.beta, se, strict=True)
        ]

    def information(self) -> dict[str, float]:
        """R2, adjusted R2, RMSE, Gaussian log-likelihood, AIC and BIC (with the variance as a parameter)."""
        n, p = (self.weight if self.kind == "frequency" else self.n), len(self.names)
        loglik = -n / 2 * (math.log(2 * math.pi * self.sse / n) + 1)
        return {
            "r2": self.r2,
            "adj_r2": 1 - (1 - self.r2) * (n - 1) / self.residual_df,
            "rmse": math.sqrt(self.sse / self.weight),
            "loglik": loglik,
            "aic": 2 * (p + 1) - 2 * loglik,
            "bic": math.log(n) * (p + 1) - 2 * loglik,
        }

    def wald(self, terms: Sequence[str]) -> dict[str, float]:
        """Joint F test that the terms' coefficients are 0."""
        at = [self.names.index(t) for t in terms]
        b = self.beta[at]
        f = float(b @ np.linalg.solve(self.covariance[np.ix_(at, at)], b)) / len(at)
        return {"f": f, "df1": len(at), "df2": self.residual_df, "p": dist.f_sf(f, len(at), self.residual_df)}

    def _x(self) -> list[Column]:
        return [F.lit(1.0) if n == "(intercept)" else F.col(f"`{n}`") for n in self.names]

    def fitted(self) -> Column:
        return linear(self.beta, self._x())

    def diagnostics(self) -> DataFrame:
        """Fit, residual, leverage, studentised residual and Cook's distance of each row, as expressions."""
        p = len(self.names)
        sigma2 = self.sse / self.residual_df
        h = F.col("__w") * quadratic(self.bread, self._x())
        rows = self.rows.withColumn("fitted", self.fitted()).withColumn("residual", F.col("__y") - F.col("fitted")).withColumn("leverage", h)
        s = F.col("residual") * F.sqrt("__w") / F.sqrt(F.lit(sigma2) * (1 - F.col("leverage")))
        return rows.withColumn("studentised", s).withColumn("cook", s * s * F.col("leverage") / ((1 - F.col("leverage")) * p))

    def predicted(self, df: DataFrame, confidence: float = 0.95, individual: bool = False) -> DataFrame:
        """Mean prediction and its interval for rows that have the design columns."""
        t = dist.t_ppf(0.5 + confidence / 2, self.residual_df)
        spread = quadratic(self.covariance, self._x()) + (self.sse / self.residual_df if individual else 0.0)
        half = t * F.sqrt(F.greatest(spread, F.lit(0.0)))
        return df.withColumn("predicted", self.fitted()).withColumn("low", F.col("predicted") - half).withColumn("high", F.col("predicted") + half)


def linear_regression(
    df: DataFrame, y: str, x: dict[str, Column], weight: str | None = None, weight_type: str | None = None, intercept: bool = True, covariance: str = "auto", keep: Sequence[str] = ()
) -> LinearFit:
    """Weighted least squares from one Gram matrix; classical or HC3 covariance (HC3 by one more pass)."""
    rows = complete(df, {**x, "__y": finite(y)}, None if weight is None else F.col(weight), keep)
    names = [*x, "__y"]
    g = gram(rows, names)
    p = len(x)
    if g.n <= p + intercept:
        raise CodebookError("fewer rows than coefficients")
    if intercept:
        sxx, sxy, sst = g.cross[:p, :p], g.cross[:p, p], g.cross[p, p]
    else:
        raw = g.cross + g.weight * np.outer(g.mean, g.mean)
        sxx, sxy, sst = raw[:p, :p], raw[:p, p], raw[p, p]
    scale = np.sqrt(np.maximum(np.diag(sxx), 0))
    if p and ((scale == 0).any() or np.linalg.eigvalsh(sxx / np.outer(scale, scale))[0] < 1e-10):
        raise CodebookError("the design is not of full rank")
    inner = np.linalg.inv(sxx) if p else np.zeros((0, 0))
    slope = inner @ sxy
    sse = float(sst - slope @ sxy)
    if intercept:
        m = g.mean[:p]
        bread = np.zeros((p + 1, p + 1))
        bread[1:, 1:] = inner
        bread[0, 1:] = bread[1:, 0] = -inner @ m
        bread[0, 0] = 1 / g.weight + m @ inner @ m
        beta = np.concatenate(([g.mean[p] - slope @ m], slope))
        terms = ("(intercept)", *x)
    else:
        bread, beta, terms = inner, slope, tuple(x)
    n_stat = g.weight if weight_type == "frequency" else g.n
    df_res = n_stat - len(terms)
    kind = covariance if covariance != "auto" else ("hc3" if weight is not None and weight_type != "frequency" else "classical")
    fit = LinearFit(terms, beta, bread * sse / df_res, bread, g.n, g.weight, sse, float(sst), df_res, "frequency" if weight_type == "frequency" else kind, rows)
    if kind != "hc3":
        return fit
    h = quadratic(bread, fit._x()) * (F.lit(1.0) if weight_type == "frequency" else F.col("__w"))
    e = (F.col("__y") - fit.fitted()) / (1 - h)
    w2 = F.col("__w") if weight_type == "frequency" else F.col("__w") * F.col("__w")
    cols = fit._x()
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    meat = np.zeros((len(cols), len(cols)))
    for (i, j), v in zip(pairs, wide_agg(rows, [F.sum(w2 * e * e * cols[i] * cols[j]) for i, j in pairs]), strict=True):
        meat[i, j] = meat[j, i] = v
    return LinearFit(terms, beta, bread @ meat @ bread, bread, g.n, g.weight, sse, float(sst), df_res, fit.kind, rows)



def questionnaire_regression(
    df: DataFrame, book: Codebook, target: str, numeric: Sequence[str] = (), categorical: Sequence[str] = (), ordinal_as_rank: Sequence[str] = (), weight: str | None = None, covariance: str = "auto"
) -> LinearFit:
    """Linear regression under the codebook's rules.

    The target is an interval or ratio item.  Only questions and attributes take part, none of them an option of a group
    of answers.  An ordinal item is a number only if ``ordinal_as_rank`` names it: it then counts by its rank, k + 1 - rank
    if it is reversed.  Missing codes are missing; categories need declared codes, the first of which is the base.
    """
    options = {o for g in book.groups for o in g.options}
    for c in (target, *numeric, *categorical):
        v = book[c]
        if c in options or v.group:
            raise CodebookError(f"{c}: an option of several answers cannot be used")
        if v.role not in ("question", "attribute"):
            raise CodebookError(f"{c}: neither a question nor an attribute")
    if book[target].scale not in ("interval", "ratio"):
        raise CodebookError(f"{target}: the target must be an interval or ratio item")
    x: dict[str, Column] = {}
    for c in numeric:
        scale = book[c].scale
        if scale == "ordinal" and c not in ordinal_as_rank:
            raise CodebookError(f"{c}: an ordinal item counts as a number only if that is asked for")
        if scale not in ("interval", "ratio", "ordinal"):
            raise CodebookError(f"{c}: not a number")
        x[c] = score(df, book[c])
    for c in categorical:
        if len(levels := book[c].domain) < 2:
            raise CodebookError(f"{c}: categories need two declared codes")
        known = F.when(valid_code(df, book[c]).isin(*levels), valid_code(df, book[c]))
        x |= {f"{c}={level}": (known == level).cast("double") for level in levels[1:]}
    if target in x or len(set(numeric) | set(categorical)) < len(numeric) + len(categorical) or not x:
        raise CodebookError("predictors must differ from each other and from the target")
    return linear_regression(df.withColumn(target, score(df, book[target])), target, x, weight, covariance=covariance)


def vif(df: DataFrame, x: dict[str, Column], weight: str | None = None) -> dict[str, float]:
    """Variance inflation: the diagonal of the inverse correlation matrix."""
    r = gram(complete(df, x, None if weight is None else F.col(weight)), list(x)).correlation()
    return dict(zip(x, np.diag(np.linalg.inv(r)).tolist(), strict=True))


def standardized_effects(fit: LinearFit) -> dict[str, float]:
    """Slopes in standard deviations of y per standard deviation of x (weighted, population)."""
    names = [n for n in fit.names if n != "(intercept)"]
    g = gram(fit.rows, [*names, "__y"])
    sd = np.sqrt(np.diag(g.cross) / g.weight)
    return {n: float(fit.beta[fit.names.index(n)] * s / sd[-1]) for n, s in zip(names, sd, strict=False)}


@dataclass(frozen=True)
class LogisticFit:
    names: tuple[str, ...]
    beta: np.ndarray
    covariance: np.ndarray | None
    loglik: float
    null_loglik: float
    n: int
    iterations: int

    def probability(self) -> Column:
        x = [F.lit(1.0) if n == "(intercept)" else F.col(f"`{n}`") for n in self.names]
        return 1 / (1 + F.exp(-linear(self.beta, x)))

    def measures(self) -> dict[str, float]:
        k = len(self.names)
        return {"aic": 2 * k - 2 * self.loglik, "bic": k * math.log(self.n) - 2 * self.loglik, "mcfadden": 1 - self.loglik / self.null_loglik}


def logistic_regression(df: DataFrame, y: Column, x: dict[str, Column], penalty: str = "none", c: float = 1.0, iterations: int = 50) -> LogisticFit:
    """Newton steps, each one aggregation; l2 and l1 penalise every coefficient, the intercept too, by 1 / c.

    With l1 each step's quadratic model is minimised by coordinate descent.  Coefficients that run off mean separated
    classes, which is an error without a penalty.
    """
    rows = complete(df, {**x, "__y": y}).cache()
    names = ("(intercept)", *x)
    cols = [F.lit(1.0), *(F.col(f"`{k}`") for k in x)]
    k = len(cols)
    beta = np.zeros(k)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def step(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, int, float]:
        eta = F.least(F.greatest(linear(b, cols), F.lit(-35.0)), F.lit(35.0))
        m = 1 / (1 + F.exp(-eta))
        found = wide_agg(
            rows,
            [F.count("*"), F.sum("__y"), F.sum(F.col("__y") * eta - F.log1p(F.exp(eta)))]
            + [F.sum((F.col("__y") - m) * z) for z in cols]
            + [F.sum(m * (1 - m) * cols[i] * cols[j]) for i, j in pairs],
        )
        h = np.zeros((k, k))
        for (i, j), v in zip(pairs, found[3 + k :], strict=True):
            h[i, j] = h[j, i] = v
        return np.array(found[3 : 3 + k]), h, found[2], found[0], found[1]

    for it in range(1, iterations + 1):
        score, h, loglik, n, ones = step(beta)
        if not 0 < ones < n:
            raise CodebookError("one class only")
        if penalty == "l2":
            move = np.linalg.solve(h + np.eye(k) / c, score - beta / c)
        elif penalty == "l1":
            target, move = h @ beta + score, beta.copy()
            for _ in range(500):
                before = move.copy()
                for j in range(k):
                    r = target[j] - h[j] @ move + h[j, j] * move[j]
                    move[j] = math.copysign(max(abs(r) - 1 / c, 0.0), r) / h[j, j]
                if np.abs(move - before).max() < 1e-10:
                    break
            move = move - beta
        else:
            if np.linalg.eigvalsh(h)[0] < 1e-10 * max(1.0, np.trace(h)) or np.abs(beta).max() > 1e3:
                raise CodebookError("the classes are separated or the design is not of full rank")
            move = np.linalg.solve(h, score)
        beta = beta + move
        if np.abs(move).max() < 1e-9:
            break
    _, h, loglik, n, ones = step(beta)
    rows.unpersist()
    p = ones / n
    return LogisticFit(names, beta, np.linalg.inv(h) if penalty == "none" else None, loglik, n * (p * math.log(p) + (1 - p) * math.log(1 - p)), n, it)


def confusion(df: DataFrame, y: Column, probability: Column, cutoffs: Sequence[float] = (0.5,)) -> DataFrame:
    """True and false positives and negatives at each cutoff: one pass gives a whole ROC curve."""
    base = df.select(y.alias("y"), probability.alias("p")).where("y IS NOT NULL AND p IS NOT NULL")
    rows = [
        F.struct(
            F.lit(float(t)).alias("cutoff"),
            F.count_if((F.col("y") == 1) & (F.col("p") >= t)).alias("tp"), F.count_if((F.col("y") == 0) & (F.col("p") >= t)).alias("fp"),
            F.count_if((F.col("y") == 1) & (F.col("p") < t)).alias("fn"), F.count_if((F.col("y") == 0) & (F.col("p") < t)).alias("tn"),
        )
        for t in cutoffs
    ]
    return base.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def _subset_r2(r: np.ndarray, subset: Sequence[int]) -> float:
    if not subset:
        return 0.0
    at = list(subset)
    return float(r[at, -1] @ np.linalg.lstsq(r[np.ix_(at, at)], r[at, -1], rcond=None)[0])


def key_drivers(df: DataFrame, outcome: str, drivers: Sequence[str], permutations: int = 500, seed: int = 42) -> list[dict[str, float | str]]:
    """Standardised slopes, VIF and the Shapley share of R2 of each driver, all from one correlation matrix."""
    names = [*drivers, outcome]
    g = gram(complete(df, {c: F.col(c) for c in names}), names)
    r, p = g.correlation(), len(drivers)
    known: dict[tuple[int, ...], float] = {}
    r2 = lambda s: known.setdefault(tuple(sorted(s)), _subset_r2(r, sorted(s)))
    share = np.zeros(p)
    if p <= MAX_EXACT_DRIVERS:
        for j in range(p):
            rest = [i for i in range(p) if i != j]
            for k in range(p):
                weight = math.factorial(k) * math.factorial(p - k - 1) / math.factorial(p)
                share[j] += weight * sum(r2((*s, j)) - r2(s) for s in itertools.combinations(rest, k))
    else:
        rng = np.random.default_rng(seed)
        for _ in range(permutations):
            order = rng.permutation(p).tolist()
            for i, j in enumerate(order):
                share[j] += (r2(order[: i + 1]) - r2(order[:i])) / permutations
    inverse = np.linalg.inv(r[:p, :p])
    beta = inverse @ r[:p, -1]
    return [
        {"driver": d, "beta": float(b), "correlation": float(c), "vif": float(v), "importance": float(s), "n": g.n, "r2": r2(range(p))}
        for d, b, c, v, s in zip(drivers, beta, r[:p, -1], np.diag(inverse), share, strict=True)
    ]


def penalty_reward(df: DataFrame, outcome: str, attributes: dict[str, tuple[float, float]], alpha: float = 0.05) -> list[dict[str, float | str]]:
    """For each attribute the cost of a low and the gain of a high score, on the standardised outcome, and its class.

    ``attributes`` gives the highest low and the lowest high score.  Basic: only the penalty counts; excitement: only
    the reward; performance: both, alike; one of them larger by a Wald test otherwise.
    """
    ok = complete(df, {**{a: finite(a) for a in attributes}, "__out": finite(outcome)})
    m, s = ok.agg(F.avg("__out"), F.stddev_samp("__out")).first()
    z = ok.withColumn("__z", (F.col("__out") - F.lit(m)) / F.lit(s))
    x = {}
    for a, (low, high) in attributes.items():
        x[f"{a}:low"] = F.when(F.col(a) <= low, 1.0).otherwise(0.0)
        x[f"{a}:high"] = F.when(F.col(a) >= high, 1.0).otherwise(0.0)
    fit = linear_regression(z, "__z", x)
    at = {n: i for i, n in enumerate(fit.names)}
    out = []
    for a in attributes:
        i, j = at[f"{a}:low"], at[f"{a}:high"]
        test = lambda b, v: 2 * dist.norm_sf(abs(b) / math.sqrt(v))
        low, high, c = fit.beta[i], fit.beta[j], fit.covariance
        p_low, p_high = test(low, c[i, i]), test(high, c[j, j])
        p_same = test(low + high, c[i, i] + c[j, j] + 2 * c[i, j])
        if p_low < alpha and p_high >= alpha:
            kind = "basic"
        elif p_high < alpha and p_low >= alpha:
            kind = "excitement"
        elif p_low >= alpha and p_high >= alpha:
            kind = "indifferent"
        else:
            kind = "performance" if p_same >= alpha else ("basic" if abs(low) > abs(high) else "excitement")
        out.append({"attribute": a, "penalty": float(low), "reward": float(high), "p_penalty": p_low, "p_reward": p_high, "p_asymmetry": p_same, "class": kind})
    return out


def within(df: DataFrame, column: str, by: str) -> Column:
    """Deviation from the group's mean, for fixed effects."""
    return finite(column) - F.avg(finite(column)).over(Window.partitionBy(by))


def taylor_fit(fit: LinearFit, book: Codebook, row_id: str, data: DataFrame):
    """Survey covariance of a weighted fit under the design of the codebook.

    The frame is all rows of data, of which those that were not fitted (missing values, a scope) score 0.
    """
    from canvass.operators.survey import design_frame, model_covariance

    names = [f"__s{i}" for i in range(len(fit.names))]
    fitted = fit.rows.withColumn("__e", F.col("__y") - fit.fitted())
    scores = fitted.select(row_id, *((F.col("__e") * c).alias(n) for n, c in zip(names, fit._x(), strict=True)))
    whole = data.join(scores, row_id, "left")
    frame = design_frame(whole, book.design, row_id)
    scored = frame.rows.withColumns({n: F.col("__w") * F.coalesce(n, F.lit(0.0)) for n in names})
    covariance = model_covariance(type(frame)(scored, frame.df, frame.lonely, frame.n), names, fit.bread)
    return covariance, frame.df - (len(fit.names) - 1)
