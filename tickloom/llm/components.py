"""Connected components of a graph of links, in rounds of large-star and small-star steps.

Each step joins the links with the smallest neighbour of each node. Both sides are read from stored tables,
so the join shuffles both and Spark's skew join splits a node that has very many links; the smallest
neighbours themselves are pre-aggregated before the shuffle. The number of rounds grows with the logarithm
of the longest chain. Nothing is collected but one row of counts per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """(u, v) links with u > v -> links of the next step, again u > v."""
    seen = links.select("u", "v")
    if large:
        seen = seen.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "stars")
    joined = seen.join(least, "u")
    if large:  # neighbours above the node link to its smallest neighbour
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # neighbours below the node, and the node, link to the smallest of them
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return stored(out.where("u <> v").distinct(), "links")


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is the smallest node reachable."""
    links = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while (state := _state(links)) != before:
        before = state
        if not state[0]:
            break
        links = _star(_star(links, True), False)
    roots = links.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.union(roots.select("root", "root").distinct())
