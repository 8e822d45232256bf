"""Logical inputs of the library derived from the warehouse tables.

Bars come from line items, investor flows and context events from the event log, news
text from documents, strata from suppliers. Nothing is collected; each function is a
lazy plan over the parquet tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def row_bound(spark: SparkSession, sf: str, name: str = "lineitem") -> int:
    """Row count from the parquet footers: an upper bound of any group in the table."""
    return table(spark, sf, name).count()


def rows_per_date(spark: SparkSession, sf: str) -> int:
    """The most line items of one date: an upper bound of the bars of any date, which grows with the symbols and not
    with the length of the history. One column is read, and a row per calendar day is left of each task."""
    days = table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").cast("date")).count()
    return days.agg(F.max("count")).first()[0] or 0


def daily_bars(spark: SparkSession, sf: str) -> DataFrame:
    """One bar per (Symbol, Date). Prices are folded into a narrow band so that returns
    look like daily returns; open and close follow the order of the line items."""
    li = table(spark, sf, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("Symbol"),
        F.col("l_shipdate").cast("date").alias("Date"),
        (100.0 + (F.col("l_extendedprice") / F.col("l_quantity")) % 20.0).alias("p"),
        F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), F.col("l_partkey").alias("k")).alias("o"),
        "l_discount",
        "l_tax",
        "l_quantity",
    )
    return li.groupBy("Symbol", "Date").agg(
        F.min_by("p", "o").alias("Open"),
        F.max(F.col("p") * (1 + F.col("l_discount"))).alias("High"),
        F.min(F.col("p") * (1 - F.col("l_tax"))).alias("Low"),
        F.max_by("p", "o").alias("Close"),
        F.sum("l_quantity").alias("Volume"),
    )


def trade_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Unaggregated, partly invalid bars with duplicates: input of the cleaning operators."""
    li = table(spark, sf, "lineitem")
    p = F.col("l_extendedprice") / F.col("l_quantity")
    return li.select(
        F.col("l_shipdate").cast("date").cast("string").alias("Date"),
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("Symbol"),
        p.cast("string").alias("Open"),
        (p * (1 + F.col("l_discount"))).alias("High"),
        (p * (1 - F.col("l_tax"))).alias("Low"),
        (p * (1 + F.col("l_discount") - F.col("l_tax"))).alias("Close"),
        F.when(F.col("l_linenumber") == 7, 0.0).otherwise(F.col("l_quantity")).alias("Volume"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ingest_seq"),
        "l_partkey",
    )


def calendar(bars: DataFrame) -> DataFrame:
    """Trading dates with their position. At most one row per calendar day."""
    from pyspark.sql.window import Window

    days = bars.select("Date").distinct()
    return days.withColumn("day_no", F.row_number().over(Window.orderBy("Date")) - 1)


def flows(spark: SparkSession, sf: str) -> DataFrame:
    """Net buying per (Date, Symbol): events signed by type, dated on the n-th trading day."""
    ev = table(spark, sf, "events").select(
        F.concat(F.lit("S"), F.col("user_id")).alias("Symbol"),
        F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("day_no"),
        "event_type",
        "value",
    )
    sign = F.when(F.col("event_type").isin("purchase", "click"), 1.0).otherwise(-1.0)
    foreign = F.when(F.col("event_type") != "view", F.col("value") * sign * 1e9).otherwise(0.0)
    institution = F.when(F.col("event_type") == "view", F.col("value") * 1e9).otherwise(F.col("value") * sign * -1e8)
    daily = ev.groupBy("Symbol", "day_no").agg(
        F.sum(F.round(foreign).cast("long")).cast("double").alias("foreign_net_buy"),
        F.sum(F.round(institution).cast("long")).cast("double").alias("institution_net_buy"),
    )
    days = calendar(daily_bars(spark, sf))
    return daily.join(F.broadcast(days), "day_no").select("Date", "Symbol", "foreign_net_buy", "institution_net_buy")


def context_events(spark: SparkSession, sf: str) -> DataFrame:
    """Raw news and disclosure rows from the event log."""
    ev = table(spark, sf, "events")
    kind = F.when(F.col("event_type").isin("purchase", "error"), "disclosure").otherwise("news")
    return ev.select(
        F.col("ts").cast("date").alias("Date"),
        F.concat(F.lit("S"), F.col("user_id")).alias("Symbol"),
        kind.alias("source_type"),
        F.concat(F.col("event_type"), F.lit(" "), F.col("props")).alias("title"),
        F.lit("").alias("body"),
        F.col("ts").alias("published_at"),
        F.col("event_type").alias("provider"),
        F.concat(F.lit("https://example.com/"), F.col("event_id") % 997).alias("url"),
        (F.col("event_id") % 997).cast("string").alias("raw_id"),
        "event_id",
    )


def news_rows(spark: SparkSession, sf: str) -> DataFrame:
    """News items from documents: first line as title, whole text as body."""
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id",
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("body"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.substring(F.md5("text"), 1, 12), F.lit("/")).alias("url"),
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("https://Origin.example.com/"), F.col("doc_id") % 400)).alias("original_url"),
        "lang",
        "source",
    )


def strata(spark: SparkSession, sf: str) -> DataFrame:
    """Symbol, market type (nation) and sector (region)."""
    s = table(spark, sf, "supplier")
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(  # 25 nations
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("Symbol"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("M"), F.col("s_nationkey") % 3).alias("market_type"),
        F.concat(F.lit("R"), F.col("n_regionkey")).alias("sector"),
    )
