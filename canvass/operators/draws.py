"""Missing numbers and categories drawn from their conditional distributions, step by step.

A number is drawn from its normal distribution given the other columns, a category from its shares among the rows with
the same conditions: the finest set of conditions that has enough rows, found by joins on ever fewer of them.  In each
step every target is drawn anew given the present values of the others, first with wider and at last with the wanted
spread.  Draws are functions of a row's key, the seed, the step and the column, whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canvass.codebook import CodebookError, codes
from canvass.functions.columns import finite
from canvass.operators.transform import bin_index
from canvass.plans.primitives import complete, gram, linear
from canvass.plans.quantiles import exact_quantiles
from canvass.plans.storage import dropped, stored

#: Rows that a set of conditions must have, and bins of a number that is a condition.
LEAST, BINS = 5, 4
NONE = "__none__"


def uniform(key: str, *parts: int | str) -> Column:
    """A number above 0 and below 1 that depends on the key and the parts."""
    return (F.pmod(F.xxhash64(key, *map(F.lit, parts)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def draw_number(df: DataFrame, target: str, given: Sequence[str], key: str, missing: Column, salt: Sequence[int | str], spread: float = 1.0) -> DataFrame:
    """Target replaced where missing: a draw given the other numbers (those that are null count as their mean)."""
    names = [target, *given]
    g = gram(complete(df.where(~missing), {c: F.col(c) for c in names}), names)
    if not g.n:
        raise CodebookError(f"{target}: no complete row to draw from")
    s = g.covariance() if g.n > 1 else np.zeros((len(names),) * 2)
    slope = s[0, 1:] @ np.linalg.pinv(s[1:, 1:])
    deviation = float(np.sqrt(max(s[0, 0] - slope @ s[1:, 0], 0.0))) * spread
    around = linear(slope, [F.coalesce(finite(c) - F.lit(float(m)), F.lit(0.0)) for m, c in zip(g.mean[1:], given, strict=True)], float(g.mean[0]))
    normal = F.sqrt(-2 * F.log(uniform(key, target, *salt, 1))) * F.cos(2 * np.pi * uniform(key, target, *salt, 2))
    return df.withColumn(target, F.when(missing, around + deviation * normal).otherwise(finite(target)))


def draw_category(df: DataFrame, target: str, given: dict[str, Column], key: str, missing: Column, salt: Sequence[int | str], spread: float = 1.0, least: int = LEAST) -> DataFrame:
    """Target replaced where missing: a category by its share (to the power 1 / spread) among rows with the same conditions.

    The conditions are those of ``given``, in order; the last one goes first where fewer than ``least`` rows have all.
    """
    value = codes(df, target)
    marked = df.withColumns({f"__g{i}": F.coalesce(c, F.lit(NONE)) for i, c in enumerate(given.values())}).withColumn("__u", uniform(key, target, *salt))
    marked = marked.withColumn("__open", missing)
    known = marked.where(~F.col("__open") & value.isNotNull()).select(*(f"__g{i}" for i in range(len(given))), value.alias("__v"))
    counts = known.groupBy(*known.columns).agg(F.count("*").alias("__n"))
    out, found = marked, []
    for m in range(len(given), -1, -1):
        on = [f"__g{i}" for i in range(m)]
        cells = counts.groupBy(*on, "__v").agg(F.sum("__n").alias("__n"))
        cells = cells.withColumn("__all", F.sum("__n").over(Window.partitionBy(*on)))
        cells = cells.where(F.col("__all") >= (least if m else 1)).withColumn("__w", F.pow("__n", F.lit(1 / spread)))
        order = Window.partitionBy(*on).orderBy("__v")
        upto = F.sum("__w").over(order) / F.sum("__w").over(Window.partitionBy(*on))
        # a set of conditions has at most as many categories as the target
        shares = cells.select(*on, F.struct(upto.alias("upto"), F.col("__v").alias("v")).alias("s")).groupBy(*on).agg(F.array_sort(F.collect_list("s")).alias(f"__s{m}"))
        out = out.join(shares, on, "left") if on else out.join(F.broadcast(shares), how="left")  # one row
        found.append(F.col(f"__s{m}"))
    table = F.coalesce(*found)
    drawn = F.coalesce(F.filter(table, lambda s: s["upto"] >= F.col("__u"))[0]["v"], F.element_at(table, -1)["v"])
    return out.withColumn(target, F.when(F.col("__open"), drawn).otherwise(value)).select(*df.columns)


def conditions(df: DataFrame, columns: Sequence[str], nominal: set[str]) -> dict[str, Column]:
    """Codes of nominal columns, and the quantile bins of numbers."""
    numbers = [c for c in columns if c not in nominal]
    edges = exact_quantiles(df, {c: finite(c) for c in numbers}, [i / BINS for i in range(BINS + 1)]) if numbers else {}
    out = {}
    for c in columns:
        cut = sorted({e for e in edges.get(c, ()) if e is not None})
        out[c] = codes(df, c) if c in nominal else bin_index(finite(c), cut).cast("string") if len(cut) > 1 else F.lit(NONE)
    return out


def fill_draws(
    df: DataFrame, targets: Sequence[str], key: str, predictors: Sequence[str] = (), steps: int = 3, temperature: float = 1.0, seed: int = 42, least: int = LEAST
) -> DataFrame:
    """All missing values of the targets drawn; columns of texts and truth values are categories, others numbers.

    Predictors are conditions and stay as they are.  The spread falls evenly from twice the temperature to it over the
    steps.  A target without a value is an error; an empty table stays empty.
    """
    if steps < 1 or temperature <= 0:
        raise CodebookError("draws need a step and a temperature above 0")
    columns = [*targets, *(p for p in predictors if p not in targets)]
    nominal = {c for c in columns if df.schema[c].dataType.typeName() in ("string", "boolean")}
    empty = {c: (F.col(c).isNull() if c in nominal else finite(c).isNull()) for c in targets}
    kinds = {c: df.schema[c].dataType for c in targets}
    now = stored(df.withColumns({f"__missing_{i}": empty[c] for i, c in enumerate(targets)}), "draws")
    known = now.agg(*(F.count_if(~F.col(f"__missing_{i}")).alias(c) for i, c in enumerate(targets)), F.count("*").alias("__all")).first()
    if known["__all"] and any(not known[c] for c in targets):
        raise CodebookError("a target has no value to draw from")
    for step in range(steps if known["__all"] else 0):
        spread = temperature * (1 + (steps - 1 - step) / max(steps - 1, 1)) if steps > 1 else temperature
        before = now
        for i, c in enumerate(targets):
            others = [o for o in columns if o != c]
            if c in nominal:
                now = draw_category(now, c, conditions(now, others, nominal), key, F.col(f"__missing_{i}"), (seed, step), spread, least)
            else:
                now = draw_number(now, c, [o for o in others if o not in nominal], key, F.col(f"__missing_{i}"), (seed, step), spread)
        now = stored(now, "draws")
        dropped(before)
    back = {c: F.col(c).cast(kinds[c]) for c in targets if c in nominal}
    return now.withColumns(back).select(*df.columns)
