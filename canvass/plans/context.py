"""Row scopes, weights and exclusions: what goes into an analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.codebook import CodebookError, Design
from canvass.functions.columns import finite

#: Ids up to this number are sent with the plan; more come as a table.
SHORT_LIST = 1000


def scope_rows(df: DataFrame, ids: Sequence | DataFrame | None, key: str = "__rowId__") -> DataFrame:
    """Rows of a scope: all for None, those listed otherwise; an empty list is no row, an unknown id an error."""
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        listed = ids.select(key).distinct()
        if not listed.join(df.select(key), key, "left_anti").isEmpty():
            raise CodebookError("the scope names rows that do not exist")
        return df.join(listed, key, "left_semi")
    wanted = list(dict.fromkeys(ids))
    if len(wanted) <= SHORT_LIST:
        rows = df.where(F.col(key).isin(*wanted)) if wanted else df.where(F.lit(False))
    else:
        rows = df.join(df.sparkSession.createDataFrame([(x,) for x in wanted], [key]), key, "left_semi")
    if rows.select(key).distinct().count() != len(wanted):
        raise CodebookError("the scope names rows that do not exist")
    return rows


def scope_hash(df: DataFrame, key: str = "__rowId__") -> Column:
    """An order-free digest of the ids of a table, to be used in an aggregation."""
    return F.concat_ws(":", F.count(key), F.hex(F.bit_xor(F.xxhash64(key))))


def weight_column(df: DataFrame, design: Design) -> Column:
    """The design's weight as a double, after its values have been checked; null where it is missing."""
    if design.weight is None:
        return F.lit(1.0)
    raw = F.col(design.weight)
    w = raw.try_cast("double")
    bad = df.agg(
        F.count_if(raw.isNotNull() & w.isNull()).alias("text"),
        F.count_if((w < 0) | F.isnan(w) | (F.abs(w) == float("inf"))).alias("range"),
        F.count_if(F.abs(w - F.round(w)) > 1e-9).alias("fraction"),
    ).first()
    if bad["text"] or bad["range"]:
        raise CodebookError(f"{design.weight}: a weight must be a number that is not negative")
    if design.weight_type == "frequency" and bad["fraction"]:
        raise CodebookError(f"{design.weight}: a frequency must be a whole number")
    return finite(w)


def exclusions(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """Rows by the first reason that holds for them, in the order given; ``included`` where none does."""
    first = F.coalesce(*(F.when(c, F.lit(k)) for k, c in reasons.items()), F.lit("included"))
    return df.groupBy(first.alias("reason")).agg(F.count("*").alias("n"))
