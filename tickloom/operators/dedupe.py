"""Deduplication of news, disclosures and context events.

"First per key" is a map-side combined ``min_by``; a key that holds a third of all rows
costs one partial row per task. The greedy any-key rule is solved in one round of joins
and, for what hangs together in chains, group by group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.text import title_key, url_key
from tickloom.operators.groups import connected_groups
from tickloom.operators.skew import first_per_key, salted_lookup
from tickloom.session import written


GROUP_ROWS = 50_000  # items that a task walks through in order


def news_keys(title: str, original_url: str, url: str) -> Column:
    """Title key and the keys of both links; an empty link gives no key."""

    def link(c: str) -> Column:
        return F.when(F.col(c) != "", F.concat(F.lit("url:"), url_key(c)))

    return F.array_distinct(
        F.array_compact(F.array(F.concat(F.lit("title:"), title_key(title)), link(original_url), link(url)))
    )


def _round(state: DataFrame) -> DataFrame:
    """(item, keys, kept) after one round: true or false where it is decided, else null.

    An item that comes first on all its keys is kept; one that shares a key with such an
    item is dropped.
    """
    rows = state.select("_item", F.explode("_keys").alias("_key"))
    first = rows.groupBy("_key").agg(F.min("_item").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    met = salted_lookup(rows, first, ["_key"], rows="_rows")
    winners = met.groupBy("_item").agg(F.bool_and(F.col("_item") == F.col("_first")).alias("_wins"))
    heads = first.select(F.col("_first").alias("_item"), "_key", "_rows").join(winners, "_item")
    taken = heads.where("_wins").select("_key", "_rows", F.lit(True).alias("_taken"))
    marked = salted_lookup(met, taken, ["_key"], rows="_rows")
    own = F.bool_and(F.col("_item") == F.col("_first"))
    out = marked.groupBy("_item").agg(own.alias("_wins"), F.bool_or(F.coalesce("_taken", F.lit(False))).alias("_hit"), F.collect_set("_key").alias("_keys"))
    return out.select("_item", "_keys", F.when(F.col("_wins"), True).when(F.col("_hit"), False).alias("_kept"))


def _in_order(table: pa.Table) -> pa.Table:
    """The sequential rule over whole groups: an item is kept unless one of its keys was seen on a kept one."""
    items, keys = table["_item"].to_pylist(), table["_keys"].to_pylist()
    seen: set[str] = set()
    kept = []
    for i in sorted(range(len(items)), key=items.__getitem__):
        if seen.isdisjoint(keys[i]):
            seen.update(keys[i])
            kept.append(items[i])
    return pa.table({"_item": pa.array(kept, table.schema.field("_item").type)})


def greedy_any_key(items: DataFrame, keys: Column, order: str) -> DataFrame:
    """Keep an item unless one of its keys was seen on an earlier kept item.

    ``order`` must be unique; an item without keys is kept. A first round decides all items but those in chains
    of shared keys. What is left falls into groups that share no key, so each follows the
    rule on its own: groups of at most ``GROUP_ROWS`` are dealt to tasks and walked through
    in order, and rounds go on only inside larger ones. Each round writes one table.
    """
    keyed = items.select(F.col(order).alias("_item"), F.array_distinct(F.array_compact(keys)).alias("_keys"))
    state = written(_round(keyed.where(F.size("_keys") > 0)), "decided")
    parts = [keyed.where(F.coalesce(F.size("_keys"), F.lit(0)) <= 0).select("_item"), state.where("_kept").select("_item")]
    rest = state.where("_kept IS NULL").select("_item", "_keys")
    if not rest.isEmpty():
        grouped = rest.join(connected_groups(rest.select("_item", F.explode("_keys").alias("_key")), "_item", "_key"), "_item")
        sizes = grouped.groupBy("head").agg(F.count(F.lit(1)).alias("_rows"))
        sized = written(salted_lookup(grouped, sizes.withColumn("_n", F.col("_rows")), ["head"], rows="_rows"), "groups")
        few = sized.where(F.col("_n") <= GROUP_ROWS)
        tasks = 1 + few.count() // GROUP_ROWS
        dealt = few.withColumn("_task", F.pmod(F.xxhash64("head"), F.lit(tasks)))
        kind = items.schema[order].dataType.simpleString()
        parts.append(dealt.groupBy("_task").applyInArrow(_in_order, f"_item {kind}"))
        state = sized.where(F.col("_n") > GROUP_ROWS).select("_item", "_keys")
        while not state.isEmpty():
            after = written(_round(state), "decided")
            parts.append(after.where("_kept").select("_item"))
            state = after.where("_kept IS NULL").select("_item", "_keys")
    winners = reduce(DataFrame.unionByName, parts)
    return items.join(winners.withColumnRenamed("_item", order), order, "left_semi")


def dedupe_news(news: DataFrame, order: str, title="title", original_url="original_url", url="url") -> DataFrame:
    return greedy_any_key(news, news_keys(title, original_url, url), order)


def dedupe_disclosures(disclosures: DataFrame, order: str, receipt: str = "receipt_no") -> DataFrame:
    return first_per_key(disclosures, [receipt], [F.col(order)])


def dedupe_context(events: DataFrame, order: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """First row per (Date, Symbol, source_type, title, raw_id) inside the date range."""
    rows = events
    if start is not None:
        rows = rows.where(F.col("Date") >= start)
    if end is not None:
        rows = rows.where(F.col("Date") <= end)
    return first_per_key(rows, ["Date", "Symbol", "source_type", "title", "raw_id"], [F.col(order)])


def merge_result_news(news: DataFrame, disclosures: DataFrame, order: str) -> DataFrame:
    """Both files as one, the first row per (Date, Symbol, source_type, title); news come first."""
    both = news.withColumn("_file", F.lit(0)).unionByName(disclosures.withColumn("_file", F.lit(1)), allowMissingColumns=True)
    keys = ["Date", "Symbol", "source_type", "title"]
    return first_per_key(both, keys, [F.col("_file"), F.col(order)]).drop("_file")


def dedupe_search_results(items: DataFrame, order: Sequence[str], url="url", title: str | None = "title") -> DataFrame:
    """First hit per (link, title), or per link across queries when ``title`` is None."""
    keys = [url] if title is None else [url, title]
    return first_per_key(items, keys, [F.col(c) for c in order])


def sequential_cluster_ids(kept: DataFrame, order: str, name: str = "cluster_id") -> DataFrame:
    """cluster-news-001 ... in kept order. Prefer ``news_cluster_id``; the running number
    needs a global order and is computed in slices."""
    from tickloom.operators.ranking import ordinal_rank

    numbered = ordinal_rank(kept, [], [F.col(order)], "_n")
    text = F.when(F.col("_n") < 1000, F.lpad(F.col("_n").cast("string"), 3, "0")).otherwise(F.col("_n").cast("string"))
    return numbered.withColumn(name, F.concat(F.lit("cluster-news-"), text)).drop("_n")


def without_flags(flags: Column, removed: Sequence[str]) -> Column:
    """Order-preserving distinct flags without the named ones."""
    return F.filter(F.array_distinct(flags), lambda f: ~f.isin(*removed))
