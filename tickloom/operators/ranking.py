"""Ranks inside a group and over a whole table without a single-task window.

A plain window puts one group into one task. That is right as long as a group is known
to be small; past ``ROWS_PER_TASK`` the table is range-partitioned by (group, order),
written to reliable storage, ranked inside each slice and shifted by the number of rows
in the slices before it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.operators.skew import null_safe_join, salted_lookup
from tickloom.session import cut_lineage, written

ROWS_PER_TASK = 5_000_000


def ordinal_rank(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str, group_rows: int | None = None
) -> DataFrame:
    """1, 2, 3 ... inside each group.

    ``group_rows`` is a proven upper bound of the rows in one group (for example the row
    count of the table). Without a bound, or with one that is too large for a task, the
    sliced form is used.
    """
    if group_rows is not None and group_rows <= ROWS_PER_TASK and group:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    sliced, before = _slices(df, group, order, F.count(F.lit(1)))
    keys = [*group, "_slice"]
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    joined = null_safe_join(sliced, before, keys)
    return joined.withColumn(name, (local + F.col("_before")).cast("long")).drop("_slice", "_before")


def ordinal_ranks(df: DataFrame, groups: Mapping[str, Sequence[str]], order: Sequence[Column]) -> DataFrame:
    """1, 2, 3 ... inside the groups of several groupings, whose rows have one order: a column for each name.

    The table is sorted into slices and written once, whatever the number of groupings; a row's rank in a group is its
    place among the group's rows in its slice, shifted by those in the slices before. Groups are few beside the rows:
    their counts per slice are broadcast.
    """
    ranged = df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id())
    sliced = written(ranged, "slices")
    out = sliced.repartition("_slice")  # all windows below stay inside a slice
    for name, group in groups.items():
        local = F.row_number().over(Window.partitionBy("_slice", *group).orderBy(*order))
        out = out.withColumn(name, local)
    for name, group in groups.items():
        sums = sliced.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_total"))
        w = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row per slice
        before = sums.select(*group, "_slice", F.coalesce(F.sum("_total").over(w), F.lit(0)).alias("_before"))
        out = null_safe_join(out, F.broadcast(before), [*group, "_slice"])
        out = out.withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_before")
    return out.drop("_slice")


def running_total(
    df: DataFrame, order: Sequence[Column], value: str, name: str, group: Sequence[str] = ()
) -> DataFrame:
    """Cumulative sum of ``value`` over the whole table (or per group), in slices."""
    sliced, before = _slices(df, group, order, F.sum(value), lambda ranged: written(ranged, "slices"))
    keys = [*group, "_slice"]
    local = F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = null_safe_join(sliced, before if group else F.broadcast(before), keys)  # without groups a row per slice
    return joined.withColumn(name, local + F.col("_before")).drop("_slice", "_before")


def _slices(df: DataFrame, group: Sequence[str], order: Sequence[Column], total: Column, store: Callable[[DataFrame], DataFrame] | None = None):
    ranged = df.repartitionByRange(*[F.col(g) for g in group], *order)
    sliced = (store or cut_lineage)(ranged.withColumn("_slice", F.spark_partition_id()))
    sums = sliced.groupBy(*group, "_slice").agg(total.alias("_total"))
    # At most one row per slice of the shuffle, so this window is always tiny.
    w = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*group, "_slice", F.coalesce(F.sum("_total").over(w), F.lit(0)).alias("_before"))
    return sliced, before


def dense_rank(
    df: DataFrame, group: Sequence[str], value: str, name: str, descending: bool = True, group_rows: int | None = None
) -> DataFrame:
    """Dense rank of a value inside each group: ranks of the distinct values, looked up."""
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    if group_rows is not None and group_rows <= ROWS_PER_TASK:
        w = Window.partitionBy(*group).orderBy(order)
        return df.withColumn(name, F.when(F.col(value).isNotNull(), F.dense_rank().over(w)))
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = ordinal_rank(counts, group, [order], name)
    return salted_lookup(df, ranked, [*group, value], rows="_n", null_safe=True)


def percentile_rank(df: DataFrame, value: str, name: str, spread_by: Sequence[str] = ()) -> DataFrame:
    """Average-rank percentile of ``value`` over the whole table.

    All missing gives 0, a single distinct value gives 0.5 everywhere, a missing value
    among others gives 0.5. The rows of a frequent value are told apart by ``spread_by``
    (all columns if it is empty); columns that no later step reads then don't travel.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_total(counts, [F.col(value).asc()], "_n", "_upto")
    # Two numbers from a table that is already materialised.
    rows, distinct = ranked.agg(F.sum("_n"), F.count(F.lit(1))).first()
    if not distinct:
        return df.withColumn(name, F.lit(0.0))
    if distinct == 1:
        return df.withColumn(name, F.lit(0.5))
    average_rank = F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2.0
    lookup = ranked.select(value, "_n", (average_rank / F.lit(float(rows))).alias(name))
    return salted_lookup(df, lookup, [value], rows="_n", spread_by=spread_by).withColumn(name, F.coalesce(F.col(name), F.lit(0.5)))


def average_rank(
    df: DataFrame, group: Sequence[str], value: str, name: str, group_rows: int | None = None
) -> DataFrame:
    """Ascending rank inside each group, ties sharing their mean rank, missing stays missing."""
    if group_rows is not None and group_rows <= ROWS_PER_TASK:
        w = Window.partitionBy(*group).orderBy(F.col(value).asc_nulls_last())
        ties = F.count(F.lit(1)).over(w.rangeBetween(0, 0))  # the peers of a row: no second sort
        return df.withColumn(name, F.when(F.col(value).isNotNull(), F.rank().over(w) + (ties - 1) / 2.0))
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_total(counts, [F.col(value).asc()], "_n", "_upto", group)
    lookup = ranked.select(*group, value, "_n", (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2.0).alias(name))
    return salted_lookup(df, lookup, [*group, value], rows="_n", null_safe=True)


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, name: str = "pos") -> DataFrame:
    """First k rows of each group. The rank filter is pushed below the shuffle by Spark's
    window group limit, so every task sends at most k rows of a hot group."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col(name) <= k)
