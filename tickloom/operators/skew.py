"""Joins and reductions that survive hot keys.

Rules used across the package:

* one row per key is chosen with ``min_by``/``max_by`` aggregates, which combine on the
  map side, never with a window over the whole key;
* a table with unique keys is looked up by a plain join, where Spark broadcasts a side it has
  measured and splits skewed partitions, or by a salted join that spreads the hot keys it was told of.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
SALTS = 16


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on equal keys, where a missing key equals a missing key; the keys of the left side stay."""
    rest = [F.col(f"`{c}`") for c in right.columns if c not in keys]
    named = right.select(*[F.col(f"`{k}`").alias(f"_key_{i}") for i, k in enumerate(keys)], *rest)
    same = reduce(and_, [F.col(f"`{k}`").eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)])
    return left.join(named, same, how).drop(*[f"_key_{i}" for i in range(len(keys))])


def salted_lookup(
    left: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left", rows: str | None = None, salts: int = SALTS, null_safe: bool = False,
    spread_by: Sequence[str] = (),
) -> DataFrame:
    """Join a table that may have hot keys to one with a single row per key.

    ``rows`` names a column of the lookup with the number of left rows per key; then only
    keys above ``HOT_ROWS`` are spread (there are at most total / HOT_ROWS of them, so
    their list is broadcast). Without it the lookup is taken as small and spread whole.
    ``null_safe`` lets a missing key find a missing key. The rows of a hot key are told
    apart by the columns ``spread_by``, which then travel, or else by all columns.
    """
    cells = F.array(*[F.lit(i) for i in range(salts)])
    seed = F.xxhash64(*[F.col(f"`{c}`") for c in spread_by or left.columns])
    salt = F.pmod(seed, F.lit(salts)).cast("int")
    if rows is None:
        salted, spread = left.withColumn("_salt", salt), lookup.withColumn("_salt", F.explode(cells))
    else:
        is_hot = F.col(rows) > HOT_ROWS
        hot = F.broadcast(lookup.where(is_hot).select(*keys, F.lit(True).alias("_hot")))
        marked = null_safe_join(left, hot, keys) if null_safe else left.join(hot, list(keys), "left")
        salted = marked.withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(0)).drop("_hot")
        spread = lookup.withColumn("_salt", F.explode(F.when(is_hot, cells).otherwise(F.array(F.lit(0))))).drop(rows)
    joined = null_safe_join(salted, spread, [*keys, "_salt"], how) if null_safe else salted.join(spread, [*keys, "_salt"], how)
    return joined.drop("_salt")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], last: bool = False) -> DataFrame:
    """The first (or last) row of every key in the given order; partial aggregation on the map side."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    value = F.struct(*[F.col(f"`{c}`") for c in rest])
    rank = F.struct(*order)
    best = df.groupBy(*keys).agg(pick(value, rank).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest]).select(*df.columns)
