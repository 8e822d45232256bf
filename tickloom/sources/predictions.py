"""A deterministic prediction table over the bars, for policy, metric and portfolio work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import crosssection, indicators
from tickloom.sources import tables as t


def head_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Reversal forecast of every labelled bar with at least 20 bars of history."""
    df = indicators.price_returns(t.daily_bars(spark, sf))
    df = indicators.lagged_returns(df, (5,))
    df = indicators.volume_ratio(indicators.rolling_volatility(indicators.moving_averages(df, (20,)), (20,)))
    df = indicators.next_day_target(indicators.year_high(df))
    df = df.where(F.col("vol_20").isNotNull() & F.col("target_log_return").isNotNull())
    # Looked up where the rows still lie by symbol, so that they don't travel for it; a list, as a symbol listed twice gives
    # two rows, which share a rank.
    strata = t.strata(spark, sf).groupBy("Symbol").agg(F.collect_list(F.struct("market_type", "sector")).alias("_strata"))
    df = df.join(strata, "Symbol", "left")
    # Before the rows travel to their date: a flag is smaller than the ratio it comes from.
    df = df.withColumn("near_52w_high_flag", F.when(F.col("close_to_52w_high") >= 0.97, 1).otherwise(0))
    df = crosssection.turnover_rank(df, t.rows_per_date(spark, sf))
    forecast = F.col("ret_5d") * -0.1
    df = df.withColumns(
        {
            "predicted_log_return": forecast,
            "up_probability": 1.0 / (1.0 + F.exp(forecast * -20.0)),
            "quantile_low": forecast - F.col("vol_20"),
            "quantile_mid": forecast,
            "quantile_high": forecast + F.col("vol_20"),
            "rsi_14": 50.0 + F.col("ret_5d") * 150.0,
            "foreign_net_buy": F.col("ret_5d") * 1.5e12,
            "institution_net_buy": F.col("daily_return") * 1.5e12,
            "nq_f_ret_1d": F.col("gap_return") / 4.0,
        }
    )
    return df.select(*[c for c in df.columns if c != "_strata"], F.inline_outer("_strata"))
