"""Connected components of documents: links and components stay in Spark, whatever their number."""

from __future__ import annotations

from pyspark.sql import DataFrame

from canvass.plans import graph


def connected_components(links: DataFrame) -> DataFrame:
    """Label each node of links (a, b) with the smallest node it reaches: columns node, component."""
    return graph.connected_components(links, small=0)
