"""Exploratory factor analysis: correlations from Spark, extraction and rotation of the small matrix."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canvass.codebook import CodebookError, Variable, position, valid_code
from canvass.functions import dist
from canvass.functions.columns import finite
from canvass.plans.pairs import whole_blocks
from canvass.plans.primitives import WIDE, complete, gram, linear
from canvass.plans.storage import dropped, stored

LOWER, BOUNDARY = 0.005, 1e-6
#: Values that one task ranks, and values that one job permutes, in parallel analysis.
PERMUTED_BLOCK, JOB_ROWS = 100_000, 20_000_000
#: Values of all rows and columns that one task may hold to permute them at once.
HELD = 1 << 23


def pearson_matrix(df: DataFrame, columns: Sequence[str], count: str | None = None) -> tuple[np.ndarray, int]:
    """Correlations and rows; a row stands for ``count`` of them (an integer column)."""
    g = gram(complete(df, {c: finite(c) for c in columns}, None if count is None else F.col(count)), columns)
    r = g.correlation()
    if np.isnan(r).any():
        raise CodebookError("an item is constant")
    return r, g.n if count is None else round(g.weight)


def _shelves(items: Sequence[Variable], cells: int = 64) -> list[list[int]]:
    """Items one after the other in groups of at most so many combinations of levels."""
    out: list[list[int]] = []
    room = 0
    for i, v in enumerate(items):
        if not out or len(v.domain) > room:
            out.append([])
            room = cells
        out[-1].append(i)
        room //= max(len(v.domain), 1)
    return out


def pair_tables(df: DataFrame, items: Sequence[Variable], count: str | None = None) -> tuple[dict[tuple[int, int], np.ndarray], int]:
    """The contingency table of each pair of ordinal items over rows where all are valid; one aggregation.

    Rows are counted by the levels of a group of items and of another group at once, which gives the tables of all
    pairs among them.  A row stands for ``count`` rows (an integer column).
    """
    place = [position(v, valid_code(df, v)).alias(f"i{k}") for k, v in enumerate(items)]
    rows = df.select(*place, (F.lit(1) if count is None else F.col(count)).cast("long").alias("n")).dropna()
    shelves, levels = _shelves(items), [len(v.domain) for v in items]
    both = [[*x, *y] for x, y in itertools.combinations(shelves, 2)] or shelves
    cells = [reduce(lambda a, k: a * levels[k] + F.col(f"i{k}"), of, F.lit(0).cast("long")) for of in both]
    coded = rows.select(F.lit(0).alias("g"), cells[0].alias("cell"), "n") if len(both) == 1 else rows.select(F.posexplode(F.array(*cells)).alias("g", "cell"), "n")
    tables = {p: np.zeros((levels[p[0]], levels[p[1]])) for p in itertools.combinations(range(len(items)), 2)}
    held: list[list[tuple[int, int]]] = [[] for _ in both]  # the pairs of each; several groups hold a pair of one shelf
    for p in tables:
        held[next(g for g, of in enumerate(both) if p[0] in of and p[1] in of)].append(p)
    for r in coded.groupBy("g", "cell").agg(F.sum("n").alias("n")).collect():
        at = dict(zip(both[r["g"]], np.unravel_index(r["cell"], [levels[k] for k in both[r["g"]]]), strict=True))
        for a, b in held[r["g"]]:
            tables[(a, b)][at[a], at[b]] += r["n"]
    return tables, int(next(iter(tables.values())).sum())


def _thresholds(counts: np.ndarray) -> np.ndarray:
    shares = np.cumsum(counts)[:-1] / counts.sum()
    return np.array([-math.inf, *(dist.norm_ppf(p) if 0 < p < 1 else math.copysign(math.inf, p - 0.5) for p in shares), math.inf])


def polychoric(table: np.ndarray) -> float:
    """Two-step estimate: thresholds of the margins, then the likeliest correlation by golden sections."""
    a, b = _thresholds(table.sum(axis=1)), _thresholds(table.sum(axis=0))

    def loss(rho: float) -> float:
        c = np.array([[dist.bvn_cdf(x, y, rho) for y in b] for x in a])
        p = c[1:, 1:] - c[:-1, 1:] - c[1:, :-1] + c[:-1, :-1]
        return -float((table * np.log(np.maximum(p, 1e-300))).sum())

    return _golden(loss, -0.999, 0.999)


def _golden(f: Callable[[float], float], low: float, high: float) -> float:
    g = (math.sqrt(5) - 1) / 2
    x, y = high - g * (high - low), low + g * (high - low)
    fx, fy = f(x), f(y)
    while high - low > 1e-7:
        if fx < fy:
            high, y, fy = y, x, fx
            x = high - g * (high - low)
            fx = f(x)
        else:
            low, x, fx = x, y, fy
            y = low + g * (high - low)
            fy = f(y)
    return (low + high) / 2


def polychoric_matrix(df: DataFrame, items: Sequence[Variable], count: str | None = None) -> tuple[np.ndarray, int]:
    tables, n = pair_tables(df, items, count)
    r = np.eye(len(items))
    for (a, b), t in tables.items():
        r[a, b] = r[b, a] = polychoric(t)
    if np.linalg.eigvalsh(r)[0] <= 0:
        raise CodebookError("the polychoric matrix is not positive definite")
    return r, n


def kmo(r: np.ndarray) -> float:
    inv = np.linalg.inv(r)
    partial = -inv / np.sqrt(np.outer(np.diag(inv), np.diag(inv)))
    off = ~np.eye(len(r), dtype=bool)
    return float((r[off] ** 2).sum() / ((r[off] ** 2).sum() + (partial[off] ** 2).sum()))


def bartlett(r: np.ndarray, n: int) -> dict[str, float]:
    p = len(r)
    chi2 = -((n - 1) - (2 * p + 5) / 6) * float(np.linalg.slogdet(r)[1])
    return {"chi2": chi2, "df": p * (p - 1) / 2, "p": dist.chi2_sf(chi2, p * (p - 1) / 2)}


@dataclass(frozen=True)
class Factors:
    loadings: np.ndarray
    phi: np.ndarray
    uniqueness: np.ndarray
    objective: float
    status: str


def _profile(r: np.ndarray, q: int, method: str) -> tuple[Callable[[np.ndarray], tuple[float, np.ndarray]], Callable[[np.ndarray], np.ndarray]]:
    """Objective with gradient over uniquenesses, and loadings at them, for uls (minres) or ml."""

    def loadings(psi: np.ndarray) -> np.ndarray:
        scale = np.sqrt(psi) if method == "ml" else np.ones(len(psi))
        m = r / np.outer(scale, scale) if method == "ml" else r - np.diag(psi)
        values, vectors = np.linalg.eigh(m)
        values, vectors = values[::-1][:q], vectors[:, ::-1][:, :q]
        return scale[:, None] * vectors * np.sqrt(np.maximum(values - (method == "ml"), 0))

    def objective(psi: np.ndarray) -> tuple[float, np.ndarray]:
        w = loadings(psi)
        sigma = w @ w.T + np.diag(psi)
        if method == "uls":
            e = r - sigma
            return float((e**2).sum() / 2), -np.diag(e)
        inv = np.linalg.inv(sigma)
        f = float(np.linalg.slogdet(sigma)[1] + np.trace(inv @ r) - np.linalg.slogdet(r)[1] - len(r))
        return f, np.diag(inv @ (sigma - r) @ inv)

    return objective, loadings


def extract(r: np.ndarray, q: int, method: str = "uls", n: int | None = None) -> Factors:
    """Uniquenesses by projected quasi-Newton steps within [LOWER, 1] from several starts."""
    p = len(r)
    if (p - q) ** 2 - p - q < 0 or (n is not None and n <= p):
        raise CodebookError("too many factors for the items or rows")
    objective, loadings = _profile(r, q, method)
    smc = 1 / np.diag(np.linalg.inv(r))
    starts = [np.clip(s, LOWER, 1.0) for s in (smc, smc / 2, np.full(p, 0.5), np.minimum(1.5 * smc, 0.95), np.full(p, 0.3))]
    best = min((_minimise(objective, s) for s in starts), key=lambda x: x[0])
    psi = best[1]
    w = loadings(psi)
    status = "boundary" if (psi <= LOWER + BOUNDARY).any() else "admissible"
    return Factors(_ordered(w), np.eye(q), psi, best[0], status)


def _minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray) -> tuple[float, np.ndarray]:
    h = np.eye(len(x))
    value, g = f(x)
    for _ in range(500):
        free = ~(((x <= LOWER) & (g > 0)) | ((x >= 1) & (g < 0)))
        if not free.any() or np.abs(g[free]).max() < 1e-9:
            break
        d = np.zeros_like(x)
        d[free] = -h[np.ix_(free, free)] @ g[free]
        if d @ g >= 0:
            h = np.eye(len(x))
            d = np.where(free, -g, 0.0)
        t = 1.0
        while True:
            new = np.clip(x + t * d, LOWER, 1.0)
            v, ng = f(new)
            if v <= value + 1e-4 * g @ (new - x) or t < 1e-12:
                break
            t /= 2
        s, y = new - x, ng - g
        if s @ y > 1e-14:
            k = 1 / (s @ y)
            a = np.eye(len(x)) - k * np.outer(s, y)
            h = a @ h @ a.T + k * np.outer(s, s)
        if np.abs(s).max() < 1e-13:
            break
        x, value, g = new, v, ng
    return value, x


def _ordered(w: np.ndarray) -> np.ndarray:
    from canvass.operators.factorial import fixed_signs

    return fixed_signs(w[:, np.argsort(-(w**2).sum(axis=0), kind="stable")])


def varimax(f: Factors) -> Factors:
    """Kaiser-normalised varimax."""
    h = np.sqrt((f.loadings**2).sum(axis=1))
    a = f.loadings / h[:, None]
    p, q = a.shape
    t, last = np.eye(q), 0.0
    for _ in range(1000):
        b = a @ t
        u, s, vt = np.linalg.svd(a.T @ (b**3 - b * (b**2).sum(axis=0) / p))
        t = u @ vt
        if s.sum() - last < 1e-12:
            break
        last = s.sum()
    return Factors(_ordered(a @ t * h[:, None]), np.eye(q), f.uniqueness, f.objective, f.status)


def promax(f: Factors, power: float = 4.0) -> Factors:
    """Oblique rotation of varimax loadings to their signed powers."""
    from canvass.operators.factorial import fixed_signs

    v = varimax(f)
    target = np.sign(v.loadings) * np.abs(v.loadings) ** power
    u = np.linalg.lstsq(v.loadings, target, rcond=None)[0]
    u = u * np.sqrt(np.diag(np.linalg.inv(u.T @ u)))
    inv = np.linalg.inv(u)
    pattern, phi = v.loadings @ u, inv @ inv.T
    order = np.argsort(-(pattern**2).sum(axis=0), kind="stable")
    pattern, phi = pattern[:, order], phi[np.ix_(order, order)]
    sign = np.sign((fixed_signs(pattern) * pattern).sum(axis=0))
    return Factors(pattern * sign, phi * np.outer(sign, sign), f.uniqueness, f.objective, f.status)


def fit_measures(f: Factors, r: np.ndarray, n: int) -> dict[str, float | None]:
    """Off-diagonal root mean square residual, and for interior maximum-likelihood solutions the chi-square test."""
    p, q = f.loadings.shape
    e = r - f.loadings @ f.phi @ f.loadings.T
    off = ~np.eye(p, dtype=bool)
    df = ((p - q) ** 2 - p - q) / 2
    chi2 = (n - 1 - (2 * p + 5) / 6 - 2 * q / 3) * f.objective
    test = f.status == "admissible" and df > 0
    return {"rmsr": float(np.sqrt((e[off] ** 2).mean())), "df": df, "chi2": chi2 if test else None, "p": dist.chi2_sf(chi2, df) if test else None}


def score_columns(f: Factors, r: np.ndarray, df: DataFrame, columns: Sequence[str], method: str = "regression") -> DataFrame:
    """Add factor scores of standardised items as expressions."""
    if f.status != "admissible":
        raise CodebookError("scores need an admissible solution")
    if method == "regression":
        w = np.linalg.solve(r, f.loadings @ f.phi)
    else:
        inv = np.diag(1 / f.uniqueness)
        w = inv @ f.loadings @ np.linalg.inv(f.loadings.T @ inv @ f.loadings)
    s = df.agg(*(x for c in columns for x in (F.avg(finite(c)), F.stddev_samp(finite(c))))).first()
    z: list[Column] = [(finite(c) - F.lit(s[2 * i])) / F.lit(s[2 * i + 1]) for i, c in enumerate(columns)]
    return df.withColumns({f"factor{j + 1}": linear(w[:, j], z) for j in range(w.shape[1])})


def permuted(rows: DataFrame, columns: Sequence[str], key: str, replicates: range, seed: int, n: int, block: int = PERMUTED_BLOCK) -> DataFrame:
    """Each column of the n rows permuted on its own, once a replicate r; values of one place ``at`` are one row.

    A value's place is the rank of a hash of its row, column and replicate, taken within and over ranges of about
    ``block`` values: no window spans a table.
    """
    cut = n // block + 1
    drawn = F.explode(F.sequence(F.lit(replicates.start), F.lit(replicates.stop - 1)))
    long = rows.select(F.xxhash64(key, *columns).alias("k"), drawn.alias("r"), *columns).select("r", "k", F.posexplode(F.array(*columns)).alias("j", "v"))
    long = long.withColumn("h", F.xxhash64("k", F.lit(seed), "r", "j")).withColumn("b", F.pmod("h", F.lit(cut)))
    placed = long.withColumn("at", F.row_number().over(Window.partitionBy("r", "j", "b").orderBy("h", "v")))
    if cut > 1:
        before = Window.partitionBy("r", "j").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
        sizes = long.groupBy("r", "j", "b").agg(F.count("*").alias("n"))
        starts = sizes.select("r", "j", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
        placed = placed.join(starts, ["r", "j", "b"]).withColumn("at", F.col("at") + F.col("start"))
    return placed.groupBy("r", "at").agg(*(F.max(F.when(F.col("j") == i, F.col("v"))).alias(c) for i, c in enumerate(columns)))


def permuted_correlations(rows: DataFrame, columns: Sequence[str], key: str, replicates: int, seed: int, n: int) -> np.ndarray:
    """Correlations of standardised columns, each permuted on its own but the first, once a replicate.

    A task holds all n rows and makes several replicates; nothing is shuffled.  Rows are taken by the hashes of their
    keys (of their values where keys are alike), so that draws do not depend on the partitioning.
    """
    spark, p = rows.sparkSession, len(columns)
    lots = max(1, min(replicates, 2 * spark.sparkContext.defaultParallelism))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.column_stack([c.to_numpy(zero_copy_only=False).astype(t) for c in cs]).tobytes()], pa.binary()) for cs, t in ((b.columns[:1], np.int64), (b.columns[1:], float))], names=["k", "v"])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, parts = 0, []
        for b in batches:
            for r in range(b.num_rows):
                lot = b.column("lot")[r].as_py()
                parts.append([np.frombuffer(b.column(c)[r].as_buffer(), dtype=t).copy() for c, t in (("k", np.int64), ("v", float))])
        if not parts:
            return
        k, x = np.concatenate([k for k, _ in parts]), np.concatenate([v for _, v in parts]).reshape(-1, p)
        x = np.ascontiguousarray(x[np.lexsort((*x.T[::-1], k))].T)
        drawn, found = x.copy(), []
        mine = range(lot, replicates, lots)
        for r in mine:
            for j in range(1, p):
                drawn[j] = x[j]
                np.random.default_rng((seed, r, j)).shuffle(drawn[j])
            found.append((drawn @ drawn.T / (n - 1)).ravel())
        yield pa.RecordBatch.from_arrays([pa.array(mine), pa.array([f.tolist() for f in found], pa.list_(pa.float64()))], names=["r", "v"])

    packed = stored(rows.select(F.xxhash64(key).alias("k"), *columns).mapInArrow(pack, "k binary, v binary"), "columns")
    out = np.tile(np.eye(p), (replicates, 1, 1))
    with whole_blocks(spark, p, 10_000):
        tasks = spark.range(0, lots, 1, lots).select(F.col("id").alias("lot"))
        for r in tasks.hint("shuffle_replicate_nl").crossJoin(packed.coalesce(1)).mapInArrow(draw, "r long, v array<double>").collect():
            out[r["r"]] = np.reshape(r["v"], (p, p))
    dropped(packed)
    out[:, range(p), range(p)] = 1.0
    return out


def parallel(df: DataFrame, columns: Sequence[str], key: str, replicates: int = 500, quantile: float = 0.95, seed: int = 42, job_rows: int = JOB_ROWS, held: int = HELD) -> tuple[np.ndarray, np.ndarray, int]:
    """Observed eigenvalues, the quantile of those under independent permutation of each column, and how many lead.

    Both are those of all complete rows.  Up to ``held`` values, a task permutes whole columns.  Beyond, values are sorted by
    hashes: a job permutes as many replicates as have about ``job_rows`` values, one at least.
    """
    r, _ = pearson_matrix(df, columns)
    observed = np.linalg.eigvalsh(r)[::-1]
    p = len(columns)
    rows = df.select(key, *(finite(c).alias(f"__c{i}") for i, c in enumerate(columns))).dropna(subset=[f"__c{i}" for i in range(p)])
    n, *s = rows.agg(F.count("*"), *(f(f"__c{i}") for i in range(p) for f in (F.avg, F.stddev_samp))).first()
    names = [f"z{i}" for i in range(p)]
    z = rows.select(F.col(key).alias("key"), *(((F.col(f"__c{i}") - F.lit(s[2 * i])) / F.lit(s[2 * i + 1])).alias(c) for i, c in enumerate(names)))
    pairs = list(itertools.combinations(range(p), 2))
    batch = max(1, job_rows // max(n * p, 1))
    null = permuted_correlations(z, names, "key", replicates, seed, n) if n * p <= held else np.tile(np.eye(p), (replicates, 1, 1))
    for first in range(0, 0 if n * p <= held else replicates, batch):
        lot = permuted(z, names, "key", range(first, min(first + batch, replicates)), seed, n)
        for a in range(0, len(pairs), WIDE):
            some = pairs[a : a + WIDE]
            for found in lot.groupBy("r").agg(*((F.sum(F.col(names[i]) * F.col(names[j])) / (n - 1)).alias(f"s{i}_{j}") for i, j in some)).collect():
                for i, j in some:
                    null[found["r"], i, j] = null[found["r"], j, i] = found[f"s{i}_{j}"]
    reference = np.quantile(np.linalg.eigvalsh(null)[:, ::-1], quantile, axis=0)
    above = observed > reference
    return observed, reference, int(len(above) if above.all() else above.argmin())


def assigned(gain: np.ndarray) -> list[int]:
    """The column of each row in the one-to-one assignment of a square table with the largest sum.

    Rows enter one after the other along shortest augmenting paths over reduced costs, q ** 3 steps in all."""
    q = len(gain)
    cost = gain.max(initial=0.0) - gain
    row_price, column_price, row_of = np.zeros(q), np.zeros(q), np.full(q, -1)
    for start in range(q):
        reach, came, done, row, last = np.full(q, np.inf), np.full(q, -1), np.zeros(q, dtype=bool), start, -1
        while True:
            slack = cost[row] - row_price[row] - column_price
            base = 0.0 if last < 0 else reach[last]
            shorter = ~done & (base + slack < reach)
            reach[shorter], came[shorter] = base + slack[shorter], last
            last = int(np.where(done, np.inf, reach).argmin())
            done[last] = True
            if row_of[last] < 0:
                break
            row = row_of[last]
        end = reach[last]
        for c in np.flatnonzero(done):
            if c != last:
                row_price[row_of[c]] += end - reach[c]
                column_price[c] -= end - reach[c]
        row_price[start] += end
        while last >= 0:
            before = came[last]
            row_of[last] = start if before < 0 else row_of[before]
            last = before
    out = [0] * q
    for c, r in enumerate(row_of.tolist()):
        out[r] = c
    return out


@dataclass
class Alignment:
    """Factors of one solution in the order and with the signs of another's."""

    order: list[int]
    signs: np.ndarray
    congruence: list[float]
    gap: float | None  # to the second best assignment; None with one factor
    clear: bool
    loadings: np.ndarray
    phi: np.ndarray


def congruences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of all pairs of factors; 0 for factors without loadings."""
    norms = np.outer(np.sqrt((a**2).sum(axis=0)), np.sqrt((b**2).sum(axis=0)))
    return np.where(norms > 0, a.T @ b / np.where(norms > 0, norms, 1), 0.0)


def congruence(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[float]]:
    """The matching of factors of two solutions with the largest congruence, and its coefficients (b may be turned)."""
    c = np.abs(congruences(a, b))
    best = assigned(c)
    return best, [float(c[i, j]) for i, j in enumerate(best)]


def align(a: Factors, b: Factors, least: float = 0.85, tie: float = 1e-6) -> Alignment:
    """b in a's order; not clear where a factor is empty, another assignment is as good, or a congruence is below least."""
    c = congruences(a.loadings, b.loadings)
    size, q = np.abs(c), len(c)
    order = assigned(size)
    total = sum(size[i, j] for i, j in enumerate(order))
    others = []
    for i, j in enumerate(order):  # the best assignment without this pair
        barred = size.copy()
        barred[i, j] = -float(q)
        other = assigned(barred)
        others.append(sum(size[r, k] for r, k in enumerate(other)))
    signs = np.array([1.0 if c[i, j] >= 0 else -1.0 for i, j in enumerate(order)])
    values, gap = [float(size[i, j]) for i, j in enumerate(order)], float(total - max(others)) if q > 1 else None
    full = bool((np.abs(a.loadings).sum(axis=0) > 0).all()) and np.linalg.matrix_rank(b.loadings) == q
    clear = full and min(values) >= least and (gap is None or gap > tie)
    return Alignment(order, signs, values, gap, clear, b.loadings[:, order] * signs, b.phi[np.ix_(order, order)] * np.outer(signs, signs))


def definite(loadings: np.ndarray, least: float = 0.4, margin: float = 0.1) -> list[int | None]:
    """The factor that each item belongs to: a loading of least, and margin above its second."""
    out: list[int | None] = []
    for row in np.abs(loadings):
        top = int(row.argmax())
        second = float(np.delete(row, top).max(initial=0.0))
        out.append(top if row[top] >= least and (len(row) == 1 or row[top] - second >= margin) else None)
    return out


def sensitivity(
    r_a: np.ndarray, a: Factors, r_b: np.ndarray, b: Factors, kept: tuple[int | None, int | None] = (None, None), guides: dict[str, float] | None = None
) -> dict[str, object]:
    """How far two solutions (of Pearson and of polychoric correlations) differ, and a verdict.

    ``kept`` are the numbers of factors that parallel analyses keep.  The verdict is indeterminate where a solution is not
    admissible or factors cannot be aligned, method_sensitive where kept numbers differ, a largest difference is beyond
    its guide or an item changes its factor, indeterminate again where an item is close to two factors, else small.
    """
    guides = {"correlation": 0.1, "loading": 0.1, "communality": 0.1, "factor_correlation": 0.1} | (guides or {})
    out: dict[str, object] = {"same_count": a.loadings.shape[1] == b.loadings.shape[1]}
    upper = np.triu_indices(len(r_a), 1)
    gaps = {"correlation": np.abs(r_a[upper] - r_b[upper])}
    aligned, changed, close = None, [], []
    if out["same_count"]:
        aligned = align(a, b)
        pairs = np.triu_indices(len(a.phi), 1)
        gaps |= {
            "loading": np.abs(a.loadings - aligned.loadings).ravel(),
            "communality": np.abs(a.uniqueness - b.uniqueness),
            "factor_correlation": np.abs(a.phi[pairs] - aligned.phi[pairs]),
        }
        one, other = definite(a.loadings), definite(aligned.loadings)
        changed = [i for i, (x, y) in enumerate(zip(one, other, strict=True)) if x is not None and y is not None and x != y]
        strong = lambda m, i: np.abs(m[i]).max() >= 0.4
        close = [i for i in range(len(one)) if (one[i] is None and strong(a.loadings, i)) or (other[i] is None and strong(aligned.loadings, i))]
    out |= {f"{k}_{name}": float(f(v)) if len(v) else 0.0 for k, v in gaps.items() for name, f in (("max", np.max), ("median", np.median))}
    out |= {"alignment": aligned, "changed": changed, "close": close}
    beyond = any(len(v) and v.max() > guides[k] for k, v in gaps.items())
    if a.status != "admissible" or b.status != "admissible" or (aligned is not None and not aligned.clear):
        verdict = "indeterminate"
    elif not out["same_count"] or kept[0] != kept[1] or beyond or changed:
        verdict = "method_sensitive"
    else:
        verdict = "indeterminate" if close else "small"
    return out | {"verdict": verdict}


def procrustes(a: np.ndarray, b: np.ndarray) -> float:
    """Root mean square distance of b, turned to fit, from a."""
    u, _, vt = np.linalg.svd(b.T @ a)
    return float(np.sqrt(((b @ u @ vt - a) ** 2).mean()))
