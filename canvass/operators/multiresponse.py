"""Questions with several answers: one binary column for each option."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.codebook import CodebookError, Group, codes
from canvass.functions.columns import finite, ratio


def classified(df: DataFrame, g: Group) -> DataFrame:
    """Add ``status`` and ``selected`` (array of options; null unless valid).

    Members are selected, unselected, missing, not applicable or invalid.  Any invalid member, not-applicable beside
    something else, or more selections than allowed make a row invalid; all not applicable: notApplicable; all missing:
    missing; some missing: partial; otherwise valid.  With ``all_unselected`` = "missing" nothing selected is missing.
    """
    def member(name: str) -> Column:
        c = codes(df, name)
        return (
            F.when(c.isNull(), "M")
            .when(c.isin(*g.selected), "S")
            .when(c.isin(*g.unselected), "U")
            .when(c.isin(*g.not_applicable) if g.not_applicable else F.lit(False), "N")
            .when(c.isin(*g.missing) if g.missing else F.lit(False), "M")
            .otherwise("X")
        )

    states = F.array(*map(member, g.options))
    k = len(g.options)
    n = lambda s: F.size(F.filter("__s", lambda x: x == s))
    too_many = n("S") > g.max_selections if g.max_selections is not None else F.lit(False)
    status = (
        F.when((n("X") > 0) | ((n("N") > 0) & (n("N") < k)) | too_many, "invalid")
        .when(n("N") == k, "notApplicable")
        .when(n("M") == k, "missing")
        .when(n("M") > 0, "partial")
        .when((n("S") == 0) & F.lit(g.all_unselected == "missing"), "missing")
        .otherwise("valid")
    )
    out = df.withColumn("__s", states).withColumn("status", status)
    pairs = F.arrays_zip(F.col("__s"), F.array(*map(F.lit, g.options)).alias("o"))
    chosen = F.transform(F.filter(pairs, lambda p: p["__s"] == "S"), lambda p: p["o"])
    return out.withColumn("selected", F.when(F.col("status") == "valid", chosen)).drop("__s")


def summary(df: DataFrame, g: Group, weight: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """For each option: selections, percent of valid respondents and of all selections, weighted and not."""
    w = F.lit(1.0) if weight is None else F.coalesce(finite(weight), F.lit(0.0))
    valid = classified(df, g).where("status = 'valid'").select(*by, "selected", w.alias("__w"))
    base = valid.groupBy(*by).agg(
        F.count("*").alias("n_valid"),
        F.sum("__w").alias("w_valid"),
        F.count_if(F.size("selected") == 0).alias("n_none"),
        F.sum(F.size("selected")).alias("n_responses"),
        F.sum(F.size("selected") * F.col("__w")).alias("w_responses"),
    )
    picked = (
        valid.select(*by, F.explode("selected").alias("option"), "__w")
        .groupBy(*by, "option")
        .agg(F.count("*").alias("n"), F.sum("__w").alias("w"))
    )
    options = F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(o).alias("option")) for i, o in enumerate(g.options))))
    grid = base.withColumn("o", options).select("*", "o.*").drop("o")
    return grid.join(picked, [*by, "option"], "left").select(
        *by,
        "place",
        "option",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("w", F.lit(0.0)).alias("weighted_n"),
        "n_valid",
        "n_none",
        ratio(100 * F.coalesce("n", F.lit(0)), F.col("n_valid")).alias("pct_respondents"),
        ratio(100 * F.coalesce("n", F.lit(0)), F.col("n_responses")).alias("pct_responses"),
        ratio(100 * F.coalesce("w", F.lit(0.0)), F.col("w_valid")).alias("weighted_pct_respondents"),
        ratio(100 * F.coalesce("w", F.lit(0.0)), F.col("w_responses")).alias("weighted_pct_responses"),
    )


def statuses(df: DataFrame, g: Group) -> DataFrame:
    return classified(df, g).groupBy("status").agg(F.count("*").alias("n"))


def matching(df: DataFrame, g: Group, options: Sequence[str], mode: str, status: str | None = None) -> DataFrame:
    """Rows by their answers: any or all of the options selected, unselected (none of them), or a status."""
    rows = classified(df, g)
    if mode == "status":
        return rows.where(F.col("status") == status)
    if not options or not set(options) <= set(g.options):
        raise CodebookError("options must be those of the group")
    wanted = F.array(*map(F.lit, options))
    hit = {
        "any": F.arrays_overlap("selected", wanted),
        "all": F.size(F.array_except(wanted, "selected")) == 0,
        "unselected": ~F.arrays_overlap("selected", wanted),
    }
    if mode not in hit:
        raise CodebookError(f"unknown mode {mode}")
    return rows.where((F.col("status") == "valid") & hit[mode])


def axes(df: DataFrame, g: Group) -> DataFrame:
    """Add an integer 0/1 column for each option and ``n_selected``; null unless the row is valid."""
    rows = classified(df, g)
    return rows.withColumns(
        {f"{g.name}_{o}": F.array_contains("selected", o).cast("int") for o in g.options}
        | {"n_selected": F.when(F.col("selected").isNotNull(), F.size("selected"))}
    )
