"""Bar cleaning: validity, duplicate resolution, quality flags, universe filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import by_symbol, number, pct_change
from tickloom.operators.skew import first_per_key
from tickloom.params import FeatureParams

PRICES = ["Open", "High", "Low", "Close"]
REQUIRED = ["Date", *PRICES, "Volume"]


def require_columns(df: DataFrame, columns: list[str], what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing required columns {missing}")


def valid_bars(df: DataFrame) -> DataFrame:
    """Numbers that parse, positive prices, High and Low that bound the bar."""
    require_columns(df, REQUIRED, "bars")
    typed = df.withColumns(
        {"Date": F.col("Date").try_cast("date"), **{c: number(c) for c in [*PRICES, "Volume"]}}
    )
    if "Symbol" not in df.columns:
        typed = typed.withColumn("Symbol", F.lit("UNKNOWN"))
    return typed.where(
        F.col("Date").isNotNull()
        & F.col("Symbol").isNotNull()
        & (F.col("Volume") >= 0)
        & (F.least(*PRICES) > 0)
        & F.col("Open").isNotNull()
        & F.col("Close").isNotNull()
        & (F.col("High") >= F.greatest("Open", "Close", "Low"))
        & (F.col("Low") <= F.least("Open", "Close", "High"))
    )


def resolve_duplicates(df: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """One bar per (Date, Symbol): the highest volume, then the last ingested."""
    return first_per_key(df, ["Date", "Symbol"], [F.col("Volume"), F.col(order)], last=True)


def quality_flags(df: DataFrame, params: FeatureParams = FeatureParams()) -> DataFrame:
    """Flag zero volume and extreme moves. A symbol has one row per day, so the window is
    as long as the trading calendar at most."""
    move = F.abs(pct_change("Close", 1, by_symbol()))
    return df.withColumns(
        {
            "is_zero_volume": F.col("Volume") == 0,
            "is_extreme_return": F.coalesce(move > params.extreme_return, F.lit(False)),
        }
    )


def drop_flagged(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce("is_zero_volume", F.lit(False)) & ~F.coalesce("is_extreme_return", F.lit(False)))


def clean_bars(df: DataFrame, params: FeatureParams = FeatureParams()) -> DataFrame:
    """Valid bars, one per (Date, Symbol), with quality flags. Without ``ingest_seq`` equal bars are told
    apart by their content, which is the same at any partitioning."""
    if "ingest_seq" not in df.columns:
        df = df.withColumn("ingest_seq", F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]))
    return quality_flags(resolve_duplicates(valid_bars(df)), params)


def in_universe(df: DataFrame, universe: DataFrame) -> DataFrame:
    """Keep the symbols of a universe table (one column ``Symbol``)."""
    return df.join(universe.select("Symbol"), "Symbol", "left_semi")
