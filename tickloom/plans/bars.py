"""Queries over bars: cleaning, quality, universe, features per date."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.numeric import number, number_or
from tickloom.functions.selection import display_columns, feature_columns
from tickloom.operators import clean, crosssection, features, indicators
from tickloom.operators.ranking import top_per_group
from tickloom.params import FeatureParams
from tickloom.plans.registry import query
from tickloom.plans.sqltext import BARS, CALENDAR, FLOWS, RETURNS, W, d, fl, full, il, r
from tickloom.sources import tables as t

RAW = """
raw AS (
  SELECT CAST(l_shipdate AS DATE) AS "Date", 'S' || l_suppkey AS "Symbol", p AS "Open", p * (1 + l_discount) AS "High",
         p * (1 - l_tax) AS "Low", p * (1 + l_discount - l_tax) AS "Close",
         CASE WHEN l_linenumber = 7 THEN 0.0 ELSE l_quantity END AS "Volume",
         l_orderkey * 10 + l_linenumber AS ingest_seq, l_partkey
  FROM (SELECT *, l_extendedprice / l_quantity AS p FROM lineitem)),
valid AS (
  SELECT * FROM raw WHERE least("Open", "High", "Low", "Close") > 0 AND "Volume" >= 0
   AND "High" >= greatest("Open", "Close", "Low") AND "Low" <= least("Open", "Close", "High")),
uniq AS (
  SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY "Date", "Symbol" ORDER BY "Volume" DESC, ingest_seq DESC, l_partkey DESC) = 1),
flagged AS (
  SELECT *, "Volume" = 0 AS is_zero_volume,
         coalesce(abs("Close" / lag("Close") OVER (PARTITION BY "Symbol" ORDER BY "Date") - 1) > 0.40, false) AS is_extreme_return
  FROM uniq)"""


@query(
    "flagship_momentum_top10",
    f"""WITH {RETURNS}, m AS (
      SELECT *, "Close" / lag("Close", 5) OVER w - 1 AS ret_5d, {full("avg", '"Close"', 20)} AS ma_20,
             {full("stddev_samp", "log_return", 20)} AS vol_20
      FROM ret WINDOW w AS ({W})),
    k AS (SELECT *, row_number() OVER (PARTITION BY "Date" ORDER BY value_traded DESC, "Symbol") AS turnover_rank_daily,
             row_number() OVER (PARTITION BY "Date" ORDER BY ret_5d DESC, "Symbol") AS pos
          FROM m WHERE ret_5d IS NOT NULL)
    SELECT {d()}, "Symbol", pos, turnover_rank_daily, {r('"Close"', "Close")}, {r("ret_5d")}, {r("ma_20")}, {r("vol_20")}
    FROM k WHERE pos <= 10""",
)
def flagship(spark, sf):
    """Clean bars, rolling features, turnover rank, ten best names per date."""
    bars = clean.drop_flagged(clean.clean_bars(t.daily_bars(spark, sf).withColumn("ingest_seq", F.lit(0))))
    df = indicators.price_returns(bars)
    df = indicators.rolling_volatility(indicators.moving_averages(indicators.lagged_returns(df, (5,)), (20,)), (20,))
    df = df.where(F.col("ret_5d").isNotNull())
    df = crosssection.turnover_rank(df, t.rows_per_date(spark, sf))
    top = top_per_group(df, ["Date"], [F.col("ret_5d").desc(), F.col("Symbol")], 10)
    return top.select("Date", "Symbol", "pos", "turnover_rank_daily", "Close", "ret_5d", "ma_20", "vol_20")


@query(
    "pf01_valid_bars",
    f"""WITH {RAW} SELECT {d()}, "Symbol", ingest_seq, l_partkey, {r('"Open"', "Open")}, {r('"High"', "High")},
    {r('"Low"', "Low")}, {r('"Close"', "Close")}, {r('"Volume"', "Volume")} FROM valid""",
)
def valid_bars(spark, sf):
    return clean.valid_bars(t.trade_rows(spark, sf))


@query(
    "ag01_duplicate_bars",
    f"""WITH {RAW} SELECT {d()}, "Symbol", ingest_seq, {r('"Close"', "Close")}, {r('"Volume"', "Volume")} FROM uniq""",
)
def duplicate_bars(spark, sf):
    rows = clean.valid_bars(t.trade_rows(spark, sf)).withColumn("_order", F.struct("ingest_seq", "l_partkey"))
    return clean.resolve_duplicates(rows, "_order").select("Date", "Symbol", "ingest_seq", "Close", "Volume")


@query(
    "pf02_quality_flags",
    f"""WITH {RAW} SELECT {d()}, "Symbol", CAST(is_zero_volume AS INT) AS is_zero_volume,
    CAST(is_extreme_return AS INT) AS is_extreme_return FROM flagged""",
)
def quality_flags(spark, sf):
    rows = clean.valid_bars(t.trade_rows(spark, sf)).withColumn("_order", F.struct("ingest_seq", "l_partkey"))
    bars = clean.quality_flags(clean.resolve_duplicates(rows, "_order"))
    return bars.select("Date", "Symbol", "is_zero_volume", "is_extreme_return")


@query(
    "pf03_drop_flagged",
    f"""WITH {RAW} SELECT {d()}, "Symbol", {r('"Close"', "Close")} FROM flagged WHERE NOT is_zero_volume AND NOT is_extreme_return""",
)
def drop_flagged(spark, sf):
    rows = clean.valid_bars(t.trade_rows(spark, sf)).withColumn("_order", F.struct("ingest_seq", "l_partkey"))
    bars = clean.quality_flags(clean.resolve_duplicates(rows, "_order"))
    return clean.drop_flagged(bars).select("Date", "Symbol", "Close")


@query(
    "pf04_numeric_alias",
    """SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS foreign_net_buy,
    0.0::DOUBLE AS institution_net_buy, coalesce(TRY_CAST(event_type AS DOUBLE), 0.0) AS news_sentiment FROM events""",
)
def numeric_alias(spark, sf):
    ev = t.table(spark, sf, "events").select(
        "event_id",
        F.get_json_object("props", "$.k").alias("ForeignNetBuy"),
        F.col("event_type").alias("뉴스점수"),
    )
    out = features.resolve_context(ev)
    return out.select("event_id", "foreign_net_buy", "institution_net_buy", "news_sentiment")


@query(
    "pf05_drop_sources",
    f"""WITH {BARS} SELECT {d()}, "Symbol", {r('"Close"', "Close")} FROM bars""",
)
def drop_sources(spark, sf):
    bars = t.daily_bars(spark, sf).select(
        "Date", "Symbol", "Close", F.col("Open").alias("PBR"), F.col("High").alias("거래소"), F.col("Low").alias("HaltFlag")
    )
    return features.drop_sources(bars)


@query(
    "pf06_feature_selector",
    f"""WITH {RETURNS}, f AS (SELECT *, daily_return AS ret_1d FROM ret)
    SELECT "Symbol", {d()}, {r("daily_return")}, {r("ret_1d")}, {r("value_traded")} FROM f""",
)
def feature_selector(spark, sf):
    df = indicators.lagged_returns(indicators.price_returns(t.daily_bars(spark, sf)), (1,)).select(
        "Date", "Symbol", "daily_return", "ret_1d", "value_traded",
        F.lit(1.0).alias("news_sentiment"), F.lit(0.5).alias("ret_news_x"), F.lit(2.0).alias("disclosure_score"),
    )
    picked = feature_columns(df.columns)
    assert not set(picked) & set(display_columns(df.columns))
    return df.select("Date", "Symbol", *picked)


@query(
    "pf07_price_limits",
    f"""WITH {RETURNS}, l AS (SELECT *, CASE WHEN "Date" < DATE '1998-06-15' THEN 0.15 ELSE 0.30 END - 0.005 AS th FROM ret)
    SELECT {d()}, "Symbol", {fl("daily_return >= th", "limit_hit_up_flag")},
     {fl("daily_return <= -th", "limit_hit_down_flag")},
     {fl("daily_return >= th OR daily_return <= -th", "limit_event_flag")} FROM l""",
)
def price_limits(spark, sf):
    from datetime import date

    df = indicators.price_returns(t.daily_bars(spark, sf))
    out = features.limit_hits(df, FeatureParams(price_limit_cutover=date(1998, 6, 15)))
    return out.select("Date", "Symbol", "limit_hit_up_flag", "limit_hit_down_flag", "limit_event_flag")


@query(
    "pf08_missing_and_neutral",
    f"""WITH {RETURNS}, m AS (SELECT *, {full("avg", '"Close"', 120)} AS ma_120, {full("stddev_samp", "log_return", 60)} AS vol_60,
      {full("min", '"Low"', 14)} AS ll, {full("max", '"High"', 14)} AS hh FROM ret)
    SELECT {d()}, "Symbol", {fl("ma_120 IS NULL", "ma_120_missing")},
      {fl("vol_60 IS NULL", "vol_60_missing")},
      {r('coalesce(100.0 * ("Close" - ll) / (hh - ll + 1e-9), 50.0)', "stoch_k")} FROM m""",
)
def missing_and_neutral(spark, sf):
    df = indicators.price_returns(t.daily_bars(spark, sf))
    df = indicators.stochastic(indicators.rolling_volatility(indicators.moving_averages(df, (120,)), (60,)))
    return features.finish_features(df).select("Date", "Symbol", "ma_120_missing", "vol_60_missing", "stoch_k")


def bars_with_flows(spark, sf):
    return t.daily_bars(spark, sf).join(t.flows(spark, sf), ["Date", "Symbol"], "left")


FLOW_BARS = f"""{RETURNS}, {CALENDAR}, {FLOWS},
fb AS (SELECT ret.*, coalesce(foreign_net_buy, 0.0) AS foreign_net_buy, coalesce(institution_net_buy, 0.0) AS institution_net_buy
       FROM ret LEFT JOIN flows USING ("Date", "Symbol"))"""


@query(
    "pf09_flow_ratios",
    f"""WITH {FLOW_BARS} SELECT {d()}, "Symbol", {fl("foreign_net_buy > 0", "foreign_buy_signal")},
     {fl("institution_net_buy > 0", "institution_buy_signal")},
     {fl("foreign_net_buy + institution_net_buy > 0", "smart_money_buy_signal")},
     {r("coalesce(foreign_net_buy / nullif(value_traded, 0), 0)", "foreign_buy_ratio")},
     {r("coalesce(institution_net_buy / nullif(value_traded, 0), 0)", "institution_buy_ratio")},
     {r("coalesce((foreign_net_buy + institution_net_buy) / nullif(value_traded, 0), 0)", "smart_money_strength")} FROM fb""",
)
def flow_ratios(spark, sf):
    df = features.flow_ratios(indicators.price_returns(features.resolve_context(bars_with_flows(spark, sf))))
    return df.select(
        "Date", "Symbol", "foreign_buy_signal", "institution_buy_signal", "smart_money_buy_signal",
        "foreign_buy_ratio", "institution_buy_ratio", "smart_money_strength",
    )


def event_scores(spark, sf):
    """Per (Date, Symbol) context scores from the event log, dated on trading days."""
    ev = t.table(spark, sf, "events").select(
        F.concat(F.lit("S"), F.col("user_id")).alias("Symbol"),
        F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("day_no"),
        (F.get_json_object("props", "$.k").cast("long") % 100).alias("k"),
    )
    daily = ev.groupBy("Symbol", "day_no").agg(
        (F.sum("k") / F.count("k") / 100.0).alias("news_sentiment"),
        (F.max("k") / 100.0).alias("news_relevance_score"),
        (F.min("k") / 100.0).alias("disclosure_score"),
        F.count("k").cast("double").alias("news_article_count"),
    )
    return daily.join(F.broadcast(t.calendar(t.daily_bars(spark, sf))), "day_no").drop("day_no")


EVENT_SCORES = """
scores AS (
  SELECT c."Date", e.* EXCLUDE (day_no) FROM (
    SELECT 'S' || user_id AS "Symbol", CAST(ts AS DATE) - DATE '2024-01-01' AS day_no,
           sum(k)::DOUBLE / count(k) / 100.0::DOUBLE AS news_sentiment, max(k)::DOUBLE / 100.0::DOUBLE AS news_relevance_score,
           min(k)::DOUBLE / 100.0::DOUBLE AS disclosure_score, count(k)::DOUBLE AS news_article_count
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) % 100 AS k FROM events) GROUP BY 1, 2) e
  JOIN cal c USING (day_no))"""


@query(
    "pf10_news_signals",
    f"""WITH {FLOW_BARS}, {EVENT_SCORES}, j AS (
      SELECT fb.*, coalesce(news_sentiment, 0) AS s, coalesce(news_relevance_score, 0) AS rel, coalesce(disclosure_score, 0) AS dis,
        CASE WHEN row_number() OVER (PARTITION BY fb."Date" ORDER BY value_traded DESC, fb."Symbol") <= 10 THEN 1.0 ELSE 0.0 END AS top10
      FROM fb LEFT JOIN scores USING ("Date", "Symbol"))
    SELECT {d()}, "Symbol", {r("rel * greatest(s - 0.5, 0.0) * 2.0", "news_positive_signal")},
      {r("rel * greatest(0.5 - s, 0.0) * 2.0", "news_negative_signal")},
      {r("0.35 * top10 + 0.20 * dis + 0.20 * (rel * greatest(s - 0.5, 0.0) * 2.0) + 0.25 * CASE WHEN foreign_net_buy + institution_net_buy > 0 THEN 1.0 ELSE 0.0 END", "investor_event_score")} FROM j""",
)
def news_signals(spark, sf):
    bars = bars_with_flows(spark, sf).join(event_scores(spark, sf), ["Date", "Symbol"], "left")
    df = features.flow_ratios(indicators.price_returns(features.resolve_context(bars)))
    df = crosssection.turnover_rank(features.news_signals(df), t.rows_per_date(spark, sf))
    df = features.investor_event_score(df)
    return df.select("Date", "Symbol", "news_positive_signal", "news_negative_signal", "investor_event_score")


YEAR_HIGH = """
yh AS (SELECT *, "Close" / CASE WHEN count("Close") OVER a >= 20 THEN max("Close") OVER a END AS close_to_52w_high,
              CASE WHEN count("Close") OVER b >= 20 THEN max("Close") OVER b END AS prev_high
       FROM {src}
       WINDOW a AS (PARTITION BY "Symbol" ORDER BY "Date" ROWS BETWEEN 251 PRECEDING AND CURRENT ROW),
              b AS (PARTITION BY "Symbol" ORDER BY "Date" ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING))"""


@query(
    "pf11_signal_flags",
    f"""WITH {FLOW_BARS}, {YEAR_HIGH.format(src="fb")}, k AS (
      SELECT *, row_number() OVER (PARTITION BY "Date" ORDER BY value_traded DESC, "Symbol") AS rk,
             greatest(1.0 - coalesce(close_to_52w_high, 0.0), 0.0) AS dist FROM yh)
    SELECT {d()}, "Symbol", CASE WHEN rk <= 15 THEN 1 ELSE 0 END AS is_top_turnover_15,
      CASE WHEN foreign_net_buy >= 1e11 THEN 1 ELSE 0 END AS foreign_high_conviction_buy_flag,
      CASE WHEN institution_net_buy >= 1e11 THEN 1 ELSE 0 END AS institution_high_conviction_buy_flag,
      CASE WHEN foreign_net_buy >= 1e11 AND institution_net_buy >= 1e11 THEN 1 ELSE 0 END AS dual_high_conviction_buy_flag,
      {r("dist", "distance_to_52w_high")}, CASE WHEN dist <= 0.03 THEN 1 ELSE 0 END AS near_52w_high_flag,
      CASE WHEN coalesce(close_to_52w_high, 0.0) >= 1.0 THEN 1 ELSE 0 END AS breakout_52w_flag FROM k""",
)
def signal_flags(spark, sf):
    df = indicators.year_high(indicators.price_returns(features.resolve_context(bars_with_flows(spark, sf))))
    df = features.signal_flags(crosssection.turnover_rank(df, t.rows_per_date(spark, sf)))
    return df.select(
        "Date", "Symbol", "is_top_turnover_15", "foreign_high_conviction_buy_flag", "institution_high_conviction_buy_flag",
        "dual_high_conviction_buy_flag", "distance_to_52w_high", "near_52w_high_flag", "breakout_52w_flag",
    )


@query(
    "pf29_universe_filter",
    f"""WITH {BARS} SELECT {d()}, "Symbol", {r('"Close"', "Close")} FROM bars
    WHERE "Symbol" IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_acctbal > 5000)""",
)
def universe_filter(spark, sf):
    rich = t.table(spark, sf, "supplier").where(F.col("s_acctbal") > 5000)
    universe = rich.select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("Symbol"))
    return clean.in_universe(t.daily_bars(spark, sf), universe).select("Date", "Symbol", "Close")
