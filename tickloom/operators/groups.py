"""Groups of items that hang together by shared keys.

Every item starts as the head of its own group. A round hooks each group to the smallest
head among the groups it shares a key with, then every item takes the head of its head.
Chains of heads halve with each round, so the rounds grow with the logarithm of the
longest chain. A key holds a group once, however many of its items have it, and the joins are
plain, so that Spark splits a skewed key. Two narrow tables are written per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import written


def connected_groups(rows: DataFrame, item: str, key: str) -> DataFrame:
    """(item, head) for every item of the (item, key) rows; the head is the smallest item reachable."""
    links = written(rows.select(F.col(item).alias("_item"), F.col(key).alias("_key")).distinct(), "links")
    heads = links.select("_item", F.col("_item").alias("_head")).distinct()
    while True:
        placed = links.join(heads, "_item").select("_key", "_head").distinct()
        least = placed.groupBy("_key").agg(F.min("_head").alias("_least"))
        hooks = written(placed.join(least, "_key").groupBy("_head").agg(F.min("_least").alias("_hook")), "hooks")  # a row per group
        hooked = heads.join(hooks, "_head")
        # The hook of a group is an item: take the hook of its group too, so that chains of hooks halve.
        ahead = hooked.select(F.col("_item").alias("_hook"), F.col("_hook").alias("_next"))
        steps = hooks.join(ahead, "_hook").select("_head", F.least("_hook", "_next").alias("_to"))
        moved = written(heads.join(steps, "_head").select("_item", F.col("_to").alias("_head"), (F.col("_to") < F.col("_head")).alias("_moved")), "heads")
        heads = moved.select("_item", "_head")
        if moved.where("_moved").isEmpty():
            return heads.select(F.col("_item").alias(item), F.col("_head").alias("head"))
