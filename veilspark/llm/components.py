"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.storage import written


def _to_least(edges: DataFrame, least: DataFrame, onto: DataFrame) -> DataFrame:
    return onto.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link; the component is its smallest node.

    Each round hangs the larger neighbours of every node, then its smaller ones, on the smallest of
    them. Minima are combined before they are shuffled, and no node's neighbours are gathered. Rounds
    are written to the shared folder; they grow with the logarithm of the longest chain.
    """
    # Edges (u, v) with u > v: each node points to smaller ones.
    edges = written(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _to_least(edges, least, both.where("v > u"))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _to_least(large, down, large).union(down.select("u", F.col("m").alias("v"))).where("u <> v")
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        after = written(small, "edges")
        # Done when every node points to one node and that one points nowhere.
        roots = after.select(F.col("v").alias("u")).distinct()
        open_roots = after.join(roots, "u", "left_semi").select("u").limit(1)
        several = after.groupBy("u").count().where("count > 1").select("u").limit(1)
        edges = after
        if open_roots.union(several).isEmpty():
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
