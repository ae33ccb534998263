"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.plans.storage import stored


#: Links that the driver may join by itself.
SMALL = 50_000


def _joined(links: list) -> list[tuple]:
    """Node and component of each node but the components' smallest ones."""
    above: dict = {}

    def root(v):
        while v in above:
            if above[v] in above:
                above[v] = above[above[v]]
            v = above[v]
        return v

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            above[max(a, b)] = min(a, b)
    return [(v, root(v)) for v in list(above)]


def connected_components(links: DataFrame, small: int = SMALL) -> DataFrame:
    """Label each node of links (a, b), but the smallest of each component, with the smallest node it reaches: node, component.

    No more than ``small`` links are joined by the driver, with the same result.

    Large-star and small-star steps by turns: each hangs a node's neighbours below the smallest one.  A hub's links are
    reduced by a partial minimum before they are shuffled, and the join that follows can be split by its skew.  The
    number of rounds grows with the logarithm of the longest path; each round is written to the shared folder.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        ways = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            ways = ways.union(ways.select("v", "u"))
        else:
            ways = ways.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = ways.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("w"), F.least("least", "u").alias("m"))
        met = ways.join(least, F.col("u") == F.col("w"))
        if large:
            out = met.where("v > u").select("v", "m")
        else:
            out = met.select("v", "m").union(least.select("w", "m"))
        return out.where("v <> m").toDF("a", "b").distinct()

    edges = stored(links.where("a <> b").select("a", "b").distinct(), "links")
    few = edges.limit(small + 1).collect() if small else None
    if few is not None and len(few) <= small:
        kind = edges.schema["a"].dataType.simpleString()
        return edges.sparkSession.createDataFrame(_joined(few), f"node {kind}, component {kind}")
    before = None
    while True:
        edges = stored(star(stored(star(edges, large=True), "star"), large=False), "star")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state
