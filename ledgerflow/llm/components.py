"""Connected components of a graph given as links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.sources.readers import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node in links (a, b): component is the smallest node reachable.

    Large-star and small-star rounds: every node's larger neighbours are tied to its smallest
    one, then the smaller ones too, until the links no longer change. A round keeps at most as
    many links as it had; its result is a table in the shared folder, so lineage stays short.
    The driver reads a count and a checksum per round.
    """
    edges = links.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    edges = materialise(edges)
    state = _state(edges)
    while state[0]:
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(edges.select("hi", "lo"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        under = large.groupBy("hi").agg(F.min("lo").alias("m"))
        tied = large.join(under, "hi")
        small = tied.select(F.col("m").alias("lo"), F.col("lo").alias("hi")).union(under.select(F.col("m").alias("lo"), "hi"))
        edges = materialise(small.filter(F.col("lo") != F.col("hi")).distinct())
        new = _state(edges)
        if new == state:
            break
        state = new
    roots = edges.select(F.col("lo").alias("node")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    ).groupBy("node").agg(F.min("component").alias("component"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())
