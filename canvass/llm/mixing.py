"""Temperature mixing of sources, with DataFrame functions only.

A source with token share p gets weight p**a / sum(p**a).  The exponent a lies
between 0 (all sources alike) and 1 (as they come) and is found by bisection to
2**-40, five halvings a job (one aggregation answers for every midpoint that the next
five can ask for): either the least a at which no source
is repeated more than ``max_repetition`` times within the budget, or the largest
at which the entropy of the weights is ``entropy_share`` of its maximum.

Weights are realised by blocks.  A source's documents are dealt by hash into
blocks of about ``block_tokens``; each epoch runs through the blocks, and each
block through its documents, in an order drawn from hashes of epoch and seed.
Whole epochs are taken while the source's quota lasts, of the last one the prefix
that still fits.  Running sums are taken over blocks and within blocks, never
over all documents of a source, so a source with a third of all rows is as many
small groups as it has blocks.

Defined results: a null source is a source; a null or empty text has 0 tokens and
goes with its block; rows repeated with one id, source and text are one unit
taken together; with no tokens at all every document is taken once; an empty
table gives no rows; further columns pass through ``mixed_documents``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canvass.llm.storage import documents, stored

BLOCK_TOKENS, SEED = 1 << 20, 11
MAX_REPETITION = 1.25
_HALVINGS, _JOBS = 5, 8


@dataclass(frozen=True)
class Target:
    """What to meet: a repetition limit, or with entropy_share a share of the largest entropy."""

    budget_share: float = 1.0
    max_repetition: float = MAX_REPETITION
    entropy_share: float | None = None


def n_tokens(text: Column) -> Column:
    """Words of a text, as a measure of its tokens."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def units(docs: DataFrame) -> DataFrame:
    """One row for each id, source and text: its hash, rows and tokens over all rows."""
    return (
        docs.select("doc_id", "source", F.xxhash64("text").alias("h"), n_tokens(F.col("text")).alias("n"))
        .groupBy("doc_id", "source", "h")
        .agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_tokens"))
    )


def exponent(shares: DataFrame, target: Target) -> float:
    """The exponent that meets the target; shares has one positive p for each source."""
    def meets(r) -> bool:
        if target.entropy_share is None:
            return r["repetition"] <= target.max_repetition
        return r["entropy"] >= target.entropy_share * r["most"] - 1e-12

    low, width = 0.0, 1.0
    upward = target.entropy_share is None  # repetition falls as the exponent grows, entropy falls too
    steps = 2**_HALVINGS
    for job in range(_JOBS):
        grid = [low + width * i / steps for i in range(steps + 1)]
        powers = (
            shares.select("p", F.explode(F.array(*map(F.lit, grid))).alias("a"))
            .groupBy("a")
            .agg(
                F.sum(F.pow("p", "a")).alias("z"),
                F.sum(F.pow("p", "a") * F.log("p")).alias("zl"),
                F.max(F.pow("p", F.col("a") - 1)).alias("top"),
                F.count("*").alias("n"),
            )
            .select(
                "a",
                (F.col("top") / F.col("z") * target.budget_share).alias("repetition"),
                (F.log("z") - F.col("a") * F.col("zl") / F.col("z")).alias("entropy"),
                F.log("n").alias("most"),
            )
            .collect()
        )
        if not powers:
            return 1.0
        good = [meets(r) for r in sorted(powers, key=lambda r: r["a"])]
        if job == 0 and good[0] == good[-1]:  # every exponent meets the target, or none does
            return 0.0 if good[0] == upward else 1.0
        below, above = 0, steps
        while above - below > 1:
            middle = (below + above) // 2
            below, above = (below, middle) if good[middle] == upward else (middle, above)
        low, width = grid[below], width / steps
    return low + width if upward else low


def source_quotas(all_units: DataFrame, target: Target) -> DataFrame:
    """One row for each source: tokens t, share p, weight w, quota q, whole epochs and the tokens of the last one."""
    sources = stored(all_units.groupBy("source").agg(F.sum("n_tokens").alias("t")), "sources")
    total = sources.agg(F.sum("t")).first()[0] or 0
    shares = sources.where("t > 0").select("source", "t", (F.col("t") / F.lit(max(total, 1))).alias("p"))
    a = exponent(shares, target)
    z = shares.agg(F.sum(F.pow("p", F.lit(a)))).first()[0] or 1.0
    # no budget is larger than the one at which every source meets the repetition limit at exponent 1
    budget = min(target.budget_share, target.max_repetition if target.entropy_share is None else target.budget_share) * total
    w = F.when(F.col("t") > 0, F.pow(F.col("t") / F.lit(max(total, 1)), F.lit(a)) / z).otherwise(0.0)
    q = F.floor(F.col("w") * budget).cast("long")
    return (
        sources.withColumn("w", w)
        .withColumn("q", q)
        .withColumn("whole", F.when(F.col("t") > 0, F.expr("q div greatest(t, 1)")).otherwise(1).cast("int"))
        .withColumn("rest", F.when(F.col("t") > 0, F.expr("q % greatest(t, 1)")).otherwise(0).cast("long"))
        .withColumn("exponent", F.lit(a))
    )


def mix(all_units: DataFrame, target: Target = Target(), block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """One row for each unit and epoch taken, with its place in the stream; give the units from a stored table."""
    quotas = stored(source_quotas(all_units, target), "quotas")
    n_blocks = F.expr(f"t div {block_tokens} + 1")
    dealt = all_units.join(quotas, all_units["source"].eqNullSafe(quotas["source"])).drop(quotas["source"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "h"), n_blocks))
    of_source = Window.partitionBy("source", "epoch").orderBy(F.xxhash64(F.lit(seed), "epoch", "block"), "block")
    blocks = (
        dealt.groupBy("source", "block", "t", "w", "q", "whole", "rest", "exponent")
        .agg(F.sum("n_tokens").alias("n"))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole"))))
        .withColumn("block_at", F.sum("n").over(of_source.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
        .where((F.col("epoch") < F.col("whole")) | (F.col("block_at") < F.col("rest")))
        .drop("n")
    )
    mine = dealt.select("doc_id", F.col("source").alias("s"), "h", "n_rows", "n_tokens", F.col("block").alias("b"))
    in_block = Window.partitionBy("source", "block", "epoch").orderBy(
        F.xxhash64(F.lit(seed), "epoch", "doc_id", "h"), "doc_id", "h"
    )
    placed = mine.join(blocks, F.col("s").eqNullSafe(F.col("source")) & (F.col("b") == F.col("block"))).withColumn(
        "at",
        F.col("block_at")
        + F.sum("n_tokens").over(in_block.rowsBetween(Window.unboundedPreceding, 0))
        - F.col("n_tokens"),
    )
    taken = placed.where((F.col("epoch") < F.col("whole")) | (F.col("at") + F.col("n_tokens") <= F.col("rest")))
    return taken.select(
        "doc_id",
        "source",
        "h",
        "n_rows",
        "n_tokens",
        "epoch",
        "block",
        F.try_divide(F.col("epoch") * F.col("t") + F.col("at"), F.col("q")).alias("mix_position"),
        F.col("w").alias("source_weight"),
        "exponent",
    )


def mixed_documents(docs: DataFrame, target: Target = Target()) -> DataFrame:
    """The rows of docs as often as the mix takes them, with the columns of docs."""
    chosen = (
        mix(stored(units(docs), "units"), target)
        .groupBy(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("h").alias("__h"))
        .agg(F.count("*").cast("int").alias("__copies"))
    )
    same = (
        (F.xxhash64("text") == F.col("__h"))
        & F.col("doc_id").eqNullSafe(F.col("__d"))
        & F.col("source").eqNullSafe(F.col("__s"))
    )
    return (
        docs.join(chosen, same)
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
        .select(*docs.columns)
    )


def op1_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(stored(units(documents(spark, sf_dir)), "units")).drop("h")
