"""Local regression (LOESS) with standard errors, intervals and outliers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.codebook import CodebookError
from canvass.functions.columns import finite
from canvass.plans.quantiles import exact_quantiles

#: Residuals beyond so many standard deviations are outliers.
OUTLYING, Z95 = 2.5, 1.959963984540054


@dataclass
class Loess:
    """Fits on an even grid; between its points a row's fit follows the fits and slopes of its two neighbours (cubic)."""

    rows: DataFrame  # __x, __y and the columns kept
    grid: np.ndarray
    fit: np.ndarray
    slope: np.ndarray
    hat: np.ndarray  # weight of a row just there in its own fit
    norm: np.ndarray  # sum of squared weights of all rows in the fit
    counts: np.ndarray
    n: int
    rss: float
    deviation: float  # standard deviation of residuals
    trace: float
    r2: float

    @property
    def sigma(self) -> float:
        """Residual spread over the degrees of freedom that the smoother leaves."""
        return float(np.sqrt(self.rss / max(self.n - self.trace, 1e-9)))

    def curve(self, df: DataFrame) -> DataFrame:
        """Grid with fit, standard error and the ends of the 95 % interval, and the rows of the neighbourhood."""
        se = self.sigma * np.sqrt(self.norm)
        rows = [(float(x), float(f), float(s), float(f - Z95 * s), float(f + Z95 * s), int(n)) for x, f, s, n in zip(self.grid, self.fit, se, self.counts, strict=True)]
        return df.sparkSession.createDataFrame(rows, "x double, fit double, se double, lower double, upper double, n long")

    def points(self) -> DataFrame:
        """The rows with fitted, residual and outlier."""
        fitted = self._at(F.col("__x"), self.fit, self.slope)
        residual = F.col("__y") - fitted
        return self.rows.withColumns({"fitted": fitted, "residual": residual, "outlier": F.abs(residual) > F.lit(OUTLYING * (self.deviation or 1e-6))}).drop("__x", "__y")

    def _at(self, x: Column, value: np.ndarray, slope: np.ndarray | None = None) -> Column:
        return between(x, self.grid, value, slope)


def between(x: Column, grid: np.ndarray, value: np.ndarray, slope: np.ndarray | None = None) -> Column:
    """Cubic interpolation by values and slopes on an even grid (straight without slopes)."""
    if len(grid) == 1:
        return F.lit(float(value[0]))
    step = float(grid[1] - grid[0])
    at = lambda v, i: F.element_at(F.array(*map(F.lit, map(float, v))), i)
    i = F.greatest(F.lit(1), F.least(F.floor((x - F.lit(float(grid[0]))) / F.lit(step)).cast("int") + 1, F.lit(len(grid) - 1)))
    t = (x - at(grid, i)) / F.lit(step)
    a, b = at(value, i), at(value, i + 1)
    if slope is None:
        return a + t * (b - a)
    u, v = at(slope, i) * F.lit(step), at(slope, i + 1) * F.lit(step)
    return a + t * u + t * t * (3 * (b - a) - 2 * u - v) + t * t * t * (2 * (a - b) + u + v)


def loess(df: DataFrame, x: str, y: str, span: float = 0.5, degree: int = 1, points: int = 100, keep: Sequence[str] = ()) -> Loess:
    """Local polynomials (degree 1 or 2) with tricube weights over the nearest span * n rows (3 at least).

    A grid point's bandwidth is the exact distance of the last of these.  Weighted moments of all grid points come from
    one aggregation over rows times the (fixed) grid; with the sums of squared weights they give the smoother's norms
    and, by interpolation, the trace of its hat matrix.
    """
    base = df.select(*(F.col(c) for c in keep), finite(x).alias("__x"), finite(y).alias("__y")).where("__x IS NOT NULL AND __y IS NOT NULL")
    low, high, n = base.agg(F.min("__x"), F.max("__x"), F.count("*")).first()
    if n < 5:
        raise CodebookError("LOESS needs at least 5 rows with both values")
    span, degree = min(max(span, 0.05), 1.0), 2 if degree >= 2 else 1
    k = min(n, int(max(3, np.ceil(span * n))))
    grid = np.linspace(low, high, points) if high > low and points > 1 else np.array([low])
    away = lambda g: F.abs(F.col("__x") - F.lit(float(g)))
    reach = [v[0] for v in exact_quantiles(base, {str(i): away(g) for i, g in enumerate(grid)}, [(k - 1) / (n - 1)]).values()]
    reach = [h if h > 1e-12 else 1.0 for h in reach]
    table = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(g)).alias("g"), F.lit(float(h)).alias("h")) for i, (g, h) in enumerate(zip(grid, reach, strict=True))))
    near = base.select("__x", "__y", F.explode(F.filter(table, lambda t: F.abs(F.col("__x") - t["g"]) < t["h"])).alias("t"))
    u = F.abs(F.col("__x") - F.col("t.g")) / F.col("t.h")
    near = near.select(F.col("t.i").alias("i"), ((F.col("__x") - F.col("t.g")) / F.col("t.h")).alias("d"), F.col("__y").alias("y"), F.pow(1 - u * u * u, 3).alias("w"))
    w, power = F.col("w"), lambda j: F.pow("d", F.lit(float(j)))
    sums = [F.sum(w * power(j)).alias(f"s{j}") for j in range(2 * degree + 1)] + [F.sum(w * w * power(j)).alias(f"v{j}") for j in range(2 * degree + 1)]
    sums += [F.sum(w * power(j) * F.col("y")).alias(f"t{j}") for j in range(degree + 1)]
    found = {r["i"]: r for r in near.groupBy("i").agg(*sums, F.count("*").alias("n")).collect()}  # one row a grid point
    fit, slope, hat, norm, counts = (np.zeros(len(grid)) for _ in range(5))
    for i, h in enumerate(reach):
        r, p = found[i], range(degree + 1)
        inverse = np.linalg.pinv(np.array([[r[f"s{a + b}"] for b in p] for a in p]))  # of distances in bandwidths
        beta = inverse @ [r[f"t{a}"] for a in p]
        fit[i], slope[i], hat[i], counts[i] = beta[0], beta[1] / h, inverse[0, 0], r["n"]
        norm[i] = inverse[0] @ np.array([[r[f"v{a + b}"] for b in p] for a in p]) @ inverse[0]
    residual = F.col("__y") - between(F.col("__x"), grid, fit, slope)
    stats = base.agg(F.sum(residual * residual), F.stddev_pop(residual), F.sum(between(F.col("__x"), grid, hat)), F.var_pop("__y") * n).first()
    rss, deviation, trace, total = (float(v or 0.0) for v in stats)
    return Loess(base, grid, fit, slope, hat, norm, counts, n, rss, deviation, trace, max(0.0, 1 - rss / total) if total > 0 else 0.0)
