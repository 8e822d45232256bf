"""Features across the symbols of one date.

Sums and leaders per date are reduced with map-side aggregation to one row per calendar
day and broadcast back (the calendar bounds their size). Full ranks go through
``ordinal_rank``, which splits a date that is too large for a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.numeric import flag, iflag, number
from tickloom.operators import ranking
from tickloom.operators.ranking import dense_rank, ordinal_rank, top_per_group
from tickloom.params import CriteriaParams


def turnover_rank(df: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Rank of traded value on the date; ties in symbol order."""
    order = [F.col("value_traded").desc_nulls_last(), F.col("Symbol")]
    out = ordinal_rank(df, ["Date"], order, "turnover_rank_daily", group_rows)
    rank = F.col("turnover_rank_daily")
    return out.withColumns({"is_top_turnover_3": flag(rank <= 3), "is_top_turnover_10": flag(rank <= 10)})


def dense_turnover_rank(df: DataFrame, group_rows: int | None = None) -> DataFrame:
    """The rank used when a frame brings traded value but no rank."""
    if "turnover_rank_daily" in df.columns:
        return df.withColumn("turnover_rank_daily", F.coalesce(number("turnover_rank_daily"), F.lit(999.0)))
    filled = df.withColumn("value_traded", F.coalesce(number("value_traded"), F.lit(0.0)))
    return dense_rank(filled, ["Date"], "value_traded", "turnover_rank_daily", group_rows=group_rows)


def leader_by_rank(df: DataFrame) -> DataFrame:
    """The first name of the date is confirmed when it and the whole top three rise."""
    rising = F.when((F.col("turnover_rank_daily") <= 3) & (F.col("daily_return") > 0), 1).otherwise(0)
    per_date = df.groupBy("Date").agg(F.sum(rising).alias("_rising"))
    confirmed = (F.col("turnover_rank_daily") == 1) & (F.col("daily_return") > 0) & (F.col("_rising") >= 3)
    return (
        df.join(F.broadcast(per_date), "Date", "left")  # one row per calendar day
        .withColumn("leader_confirmation_flag", flag(confirmed))
        .drop("_rising")
    )


def leader_returns(df: DataFrame, params: CriteriaParams = CriteriaParams()) -> DataFrame:
    """Returns of the leading names of each date on every row, and the co-mover rule."""
    top_n = max(2, params.leader_top_n)
    slim = df.select(
        "Date",
        "Symbol",
        F.coalesce(number("daily_return"), F.lit(0.0)).alias("_ret"),
        F.coalesce(number("turnover_rank_daily"), F.lit(999.0)).alias("_rank"),
    )
    top = top_per_group(slim, ["Date"], [F.col("_rank"), F.col("_ret").desc(), F.col("Symbol")], top_n)
    per_date = top.groupBy("Date").agg(
        *[F.coalesce(F.max(F.when(F.col("pos") == k, F.col("_ret"))), F.lit(0.0)).alias(f"leader_{k}_return") for k in (1, 2, 3)],
        F.sum(F.when(F.col("_ret") > params.leader_min_return, 1).otherwise(0)).alias("_movers"),
    )
    per_date = per_date.withColumn(
        "leader_confirmation_flag",
        iflag(
            (F.col("leader_1_return") > params.leader_min_return)
            & (F.col("_movers") >= max(1, params.leader_min_co_movers))
        ),
    ).drop("_movers")
    return df.drop("leader_confirmation_flag").join(F.broadcast(per_date), "Date", "left")  # calendar-bounded


def cross_section_ranks(df: DataFrame, score: str = "signal_score", group_rows: int | None = None) -> DataFrame:
    """Rank, percentile and universe size on the date, higher score first."""
    order = [number(score).desc_nulls_last(), F.col("Symbol")]
    ranked = ordinal_rank(df, ["Date"], order, "cross_section_rank", group_rows)
    size = F.count(F.lit(1))
    if group_rows is not None and group_rows <= ranking.ROWS_PER_TASK:  # counted where the date is ranked, not in a second run of the plan
        out = ranked.where(F.col("Date").isNotNull()).withColumn("rank_universe_size", size.over(Window.partitionBy("Date")))
    else:
        out = ranked.join(F.broadcast(df.groupBy("Date").agg(size.alias("rank_universe_size"))), "Date")  # calendar-bounded
    n = F.col("rank_universe_size")
    return out.withColumn("rank_percentile", (n - F.col("cross_section_rank") + 1.0) / n)
