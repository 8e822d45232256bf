"""Minimum-cost-flow resharding.

Documents lie in old shards, each cut into blocks by a hash of the document. Bytes and rows of the blocks are
summed in Spark; the manifest (shards x blocks per shard rows, a parameter) goes to the driver. There a
minimum-cost flow from old sizes to new capacities decides how many bytes each shard sends to each other, at
the given cost per byte (nothing for bytes that stay), and blocks are chosen for the flows, large ones first.
The plan goes back as a table of blocks and is joined on the block. A slot is the number of rows in the
blocks before plus the row's number in its block: no task numbers a whole shard.

Defined cases: a null text has size 1 and CRC 0; a null doc_id or source hashes like a value; repeated rows
lie in one block with consecutive slots; an empty table gives an empty result; other columns are kept by
``place`` and clash with none of its own, which come last under the given names.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 16
BLOCKS_PER_SHARD = 1024
ROWS_PER_BLOCK = 2_000_000


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Flow from each supply to each capacity with the least total cost, by successive shortest paths.

    The capacities must hold the supply.
    """
    m, n = len(supply), len(capacity)
    if sum(capacity) < sum(supply):
        raise ValueError("the new capacities are smaller than the data")
    flow = [[0] * n for _ in range(m)]
    left, room = list(supply), list(capacity)
    far = 1 << 62
    while any(left):
        # distances from every supply with bytes left, over edges i -> j and back over edges that carry flow
        down = [0 if left[i] else far for i in range(m)]
        across, back, origin = [far] * n, [-1] * n, [-1] * m
        changed = True
        while changed:
            changed = False
            for i in range(m):
                for j in range(n):
                    if down[i] + cost[i][j] < across[j] and down[i] < far:
                        across[j], back[j], changed = down[i] + cost[i][j], i, True
            for j in range(n):
                for i in range(m):
                    if flow[i][j] and across[j] - cost[i][j] < down[i]:
                        down[i], origin[i], changed = across[j] - cost[i][j], j, True
        j = min((j for j in range(n) if room[j]), key=lambda j: (across[j], j))
        path, amount, end = [], room[j], j
        while True:
            i = back[end]
            path.append((i, end, 1))
            if origin[i] < 0:
                amount = min(amount, left[i])
                break
            end = origin[i]
            path.append((i, end, -1))
            amount = min(amount, flow[i][end])
        for i, end, sign in path:
            flow[i][end] += sign * amount
        left[path[-1][0]] -= amount
        room[j] -= amount
    return flow


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def plan_blocks(blocks: list[tuple[int, int, int, int]], flow: list[list[int]]) -> list[tuple[int, int, int]]:
    """(block, shard, first slot) for blocks (block, old shard, bytes, rows).

    Large blocks go first, each to the flow of its shard with the most bytes still to fill.
    """
    rest = [list(x) for x in flow]
    target: dict[int, int] = {}
    for block, old, size, _ in sorted(blocks, key=lambda b: (-b[2], b[0])):
        j = max(range(len(rest[old])), key=lambda j: (rest[old][j], j == old, -j))
        rest[old][j] -= size
        target[block] = j
    first: dict[int, int] = defaultdict(int)
    out = []
    for block, _, _, rows in sorted(blocks):
        out.append((block, target[block], first[target[block]]))
        first[target[block]] += rows
    return out


def _blocked(docs: DataFrame, old_shard: Column, blocks: int) -> DataFrame:
    crc = F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long") + 1
    return docs.withColumns({"_size": size, "_crc": crc, "_old": old_shard.cast("int")}).withColumn(
        "_block", F.col("_old").cast("long") * blocks + F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.col("_crc")), F.lit(blocks))
    )


def place(docs: DataFrame, old_shard: Column, shards: int = SHARDS, capacities: list[int] | None = None, cost: list[list[int]] | None = None) -> DataFrame:
    """``docs`` with _size, _crc, _old, _shard and _slot: near-equal bytes in each shard, fewest bytes moved.

    ``old_shard`` gives shard numbers from 0 to ``shards`` - 1. ``capacities`` are bytes, equal by default.
    """
    blocks = max(BLOCKS_PER_SHARD, docs.count() // (shards * ROWS_PER_BLOCK) + 1)
    slim = _blocked(docs.select("doc_id", "text", old_shard.alias("_from")), F.col("_from"), blocks)
    manifest = [tuple(r) for r in slim.groupBy("_block", "_old").agg(F.sum("_size"), F.count("*")).collect()]
    supply = [0] * shards
    for _, old, size, _ in manifest:
        supply[old] += size
    flow = min_cost_flow(supply, capacities or even_capacities(sum(supply), shards), cost or [[int(i != j) for j in range(shards)] for i in range(shards)])
    plan = docs.sparkSession.createDataFrame(plan_blocks(manifest, flow), "_block long, _shard int, _first long")
    order = Window.partitionBy("_block").orderBy("doc_id", "_crc", "_size")
    numbered = _blocked(docs, old_shard, blocks).withColumn("_row", F.row_number().over(order))
    return numbered.join(plan, "_block").withColumn("_slot", F.col("_first") + F.col("_row") - 1).drop("_block", "_first", "_row")


def rewrite(placed: DataFrame, root: str) -> None:
    """Writes the shards that lose or gain documents under ``root``/shard=N and leaves the files of all others as they are."""
    changed = placed.where("_old <> _shard").select(F.explode(F.array("_old", "_shard")).alias("shard")).distinct()
    affected = [r[0] for r in changed.collect()]  # at most one row per shard
    if affected:
        rows = placed.where(F.col("_shard").isin(affected)).repartition(F.col("_shard"), F.pmod("_slot", F.lit(64)))
        rows = rows.withColumnRenamed("_shard", "shard").drop("_size", "_crc", "_old", "_slot")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(root)


def by_source(shards: int = SHARDS) -> Column:
    """Old shards that keep each source together."""
    return F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(shards)).cast("int")


def assignment(docs: DataFrame, old_shard: Column, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the old shard of every document."""
    slim = docs.select("doc_id", "text", old_shard.alias("old_shard"))
    placed = place(slim, F.col("old_shard"), shards)
    return placed.select(
        F.col("doc_id").cast("long"), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"), F.col("_slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("_old").alias("old_shard"),
    )
