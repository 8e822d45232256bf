"""Point-in-time joins of context onto the bar panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.numeric import full, number, pct_change
from tickloom.operators.skew import first_per_key

# Short column names of external market series, substitutes per series,
# and the series known on the same date (all others are known one row later).
SERIES_NAMES = {
    "^SOX": "sox", "^VIX": "vix", "^KS11": "ks11", "^KQ11": "kq11", "^IXIC": "ixic",
    "NQ=F": "nq_f", "^GSPC": "gspc", "KRW=X": "krw_x", "^TNX": "tnx",
}
SERIES_SUBSTITUTES = {
    "^SOX": ("SOXX",), "^VIX": ("VIXY",), "^KS11": ("EWY",), "^KQ11": ("KORU",), "^IXIC": ("QQQ",),
    "NQ=F": ("QQQ",), "^GSPC": ("SPY",), "KRW=X": ("USDKRW=X",), "^TNX": ("IEF",),
}
SAME_DATE_SERIES = ("^KS11", "^KQ11")
CONTEXT_COLUMNS = [
    "foreign_net_buy", "institution_net_buy", "disclosure_score", "news_sentiment",
    "news_relevance_score", "news_impact_score", "news_article_count",
]


def series_prefix(series: str) -> str:
    plain = series.replace("^", "").replace("=", "_").replace("-", "_").lower()
    return SERIES_NAMES.get(series, plain)


def external_returns(series: DataFrame) -> DataFrame:
    """1- and 5-row returns and 20-row volatility of each series (one row per series and date)."""
    w = Window.partitionBy("series").orderBy("Date")
    out = series.withColumns({"ret_1d": pct_change("close", 1, w), "ret_5d": pct_change("close", 5, w)})
    return out.withColumn("vol_20", full(F.stddev_samp, "ret_1d", 20, w))


def fallback_chains(spark: SparkSession, names: Sequence[str], substitutes: Mapping[str, Sequence[str]] = SERIES_SUBSTITUTES) -> DataFrame:
    """(series, used, step): for every named series itself at step 0, then its substitutes in order."""
    rows = [(s, used, step) for s in dict.fromkeys(names) for step, used in enumerate((s, *substitutes.get(s, ())))]
    return spark.createDataFrame(rows, "series string, used string, step int")


def choose_series(landed: DataFrame, chains: DataFrame) -> DataFrame:
    """(series, used, step): the first of each chain that has a value in ``landed``; null where none has."""
    present = landed.where(F.col("close").isNotNull()).select(F.col("series").alias("used")).distinct()
    first = chains.join(present, "used").groupBy("series").agg(F.min(F.struct("step", "used")).alias("_first"))
    asked = chains.select("series").distinct()
    return asked.join(first, "series", "left").select("series", F.col("_first.used").alias("used"), F.col("_first.step").alias("step"))


def external_matrix(
    series: DataFrame, dates: DataFrame, names: list[str], same_date: tuple[str, ...] = SAME_DATE_SERIES,
    substitutes: Mapping[str, Sequence[str]] = SERIES_SUBSTITUTES,
) -> DataFrame:
    """One row per trading date with the columns of every named series.

    A series without a value in the span of the trading dates is read from the first of
    its substitutes that has one, under its own name. Series are lagged by one of their
    own rows unless the one that is read is known on the same date, matched to
    trading dates exactly, then filled forward. The result has one row per trading day,
    so the single-task window of the forward fill is bounded by the calendar.
    """
    span = dates.agg(F.min("Date").alias("_from"), F.max("Date").alias("_to"))
    inside = series.join(F.broadcast(span), F.col("Date").between(F.col("_from"), F.col("_to"))).drop("_from", "_to")  # one row
    chosen = choose_series(inside, fallback_chains(series.sparkSession, names, substitutes)).where("used IS NOT NULL")
    last = first_per_key(inside, ["series", "Date"], [F.col("close")], last=True)
    values = external_returns(last)
    w = Window.partitionBy("series").orderBy("Date")
    measures = ["close", "ret_1d", "ret_5d", "vol_20"]
    known = F.col("series").isin(*same_date)
    lagged = values.withColumns({m: F.when(known, F.col(m)).otherwise(F.lag(m, 1).over(w)) for m in measures})
    # A handful of names, and one substitute may stand for several.
    read = lagged.withColumnRenamed("series", "used").join(F.broadcast(chosen.select("series", "used")), "used")
    wide = read.groupBy("Date").pivot("series", names).agg(*[F.max(m).alias(m) for m in measures])
    spine = dates.select("Date").distinct().join(F.broadcast(wide), "Date", "left")  # calendar-bounded
    filled = Window.orderBy("Date").rowsBetween(Window.unboundedPreceding, 0)
    return spine.select(
        "Date",
        *[
            F.last(f"`{s}_{m}`", ignorenulls=True).over(filled).alias(f"{series_prefix(s)}_{m}")
            for s in names
            for m in measures
        ],
    )


def add_external(
    bars: DataFrame, series: DataFrame, names: list[str], same_date=SAME_DATE_SERIES, substitutes: Mapping[str, Sequence[str]] = SERIES_SUBSTITUTES
) -> DataFrame:
    return bars.join(F.broadcast(external_matrix(series, bars, names, same_date, substitutes)), "Date", "left")  # calendar-bounded


def source_coverage(chosen: DataFrame) -> DataFrame:
    """Requested, successful and failed series and how many were read from a substitute, of ``choose_series``' rows.
    ``ratio`` is the share of successful ones, 1.0 when none was requested."""
    counted = chosen.agg(
        F.count(F.lit(1)).alias("requested"),
        F.count("used").alias("successful"),
        F.count(F.when(F.col("used").isNull(), 1)).alias("failed"),
        F.count(F.when(F.col("step") > 0, 1)).alias("substituted"),
    )
    return counted.withColumn("ratio", F.coalesce(F.try_divide("successful", "requested"), F.lit(1.0)))


def add_flows(bars: DataFrame, flows: DataFrame) -> DataFrame:
    """Fetched flows win over values already in the frame. Both sides are unique per key."""
    columns = ["foreign_net_buy", "institution_net_buy"]
    fetched = flows.select("Date", "Symbol", *[F.col(c).alias(f"_{c}") for c in columns])
    joined = bars.join(fetched, ["Date", "Symbol"], "left")
    present = {c: number(c) if c in bars.columns else F.lit(None).cast("double") for c in columns}
    merged = {c: F.coalesce(F.col(f"_{c}"), present[c], F.lit(0.0)) for c in columns}
    return joined.withColumns(merged).drop(*[f"_{c}" for c in columns])


def add_disclosure_scores(bars: DataFrame, scores: DataFrame) -> DataFrame:
    """Daily disclosure score, 0 where there was none. A score already in the frame is a fallback."""
    fetched = scores.select("Date", "Symbol", F.col("disclosure_score").alias("_score"))
    present = number("disclosure_score") if "disclosure_score" in bars.columns else F.lit(None).cast("double")
    joined = bars.join(fetched, ["Date", "Symbol"], "left")
    return joined.withColumn("disclosure_score", F.coalesce("_score", present, F.lit(0.0))).drop("_score")


def fill_context(bars: DataFrame) -> DataFrame:
    return bars.withColumns(
        {c: F.coalesce(number(c), F.lit(0.0)) if c in bars.columns else F.lit(0.0) for c in CONTEXT_COLUMNS}
    )


# Words that raise a disclosure's score, base score and raise.
DISCLOSURE_WORDS = ("수주", "계약", "증가", "실적", "합병", "approval", "contract", "growth")
DISCLOSURE_BASE, DISCLOSURE_RAISE = 0.2, 0.3


def disclosure_daily_scores(items: DataFrame, title: str = "title") -> DataFrame:
    """Sum of item scores per (Date, Symbol), bounded to 0..1. Sums combine on the map side."""
    raised = F.lit(False)
    for word in DISCLOSURE_WORDS:
        raised = raised | F.contains(F.col(title), F.lit(word))
    # Counted, then weighted: the sum does not depend on the order of the rows.
    per_day = items.groupBy("Date", "Symbol").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.when(raised, 1).otherwise(0)).alias("_raised")
    )
    total = F.col("_n") * DISCLOSURE_BASE + F.col("_raised") * DISCLOSURE_RAISE
    return per_day.select("Date", "Symbol", F.least(total, F.lit(1.0)).alias("disclosure_score"))
