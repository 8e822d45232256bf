"""Queries over per-symbol windows and per-date ranks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.numeric import full as full_window
from tickloom.functions.numeric import pct_change
from tickloom.operators import crosssection, features, indicators
from tickloom.operators.ranking import percentile_rank
from tickloom.plans.bars import FLOW_BARS, YEAR_HIGH, bars_with_flows
from tickloom.plans.registry import query
from tickloom.plans.sqltext import BARS, RETURNS, W, d, fl, full, il, r
from tickloom.sources import tables as t

RANKED = """
rk AS (SELECT *, row_number() OVER (PARTITION BY "Date" ORDER BY value_traded DESC, "Symbol") AS turnover_rank_daily FROM ret)"""


def returns(spark, sf):
    return indicators.price_returns(t.daily_bars(spark, sf))


@query(
    "wn01_price_returns",
    f"""WITH {RETURNS} SELECT {d()}, "Symbol", {r("log_return")}, {r("daily_return")}, {r('"Open" / prev - 1', "gap_return")},
    {r('"Close" / "Open" - 1', "intraday_return")}, {r('("High" - "Low") / "Close"', "range_pct")} FROM ret""",
)
def price_returns(spark, sf):
    return returns(spark, sf).select("Date", "Symbol", "log_return", "daily_return", "gap_return", "intraday_return", "range_pct")


@query(
    "wn02_kday_returns",
    f"""WITH {BARS} SELECT {d()}, "Symbol", """
    + ", ".join(r(f'"Close" / lag("Close", {k}) OVER w - 1', f"ret_{k}d") for k in (1, 2, 3, 5, 10, 20, 60))
    + f" FROM bars WINDOW w AS ({W})",
)
def kday_returns(spark, sf):
    lags = (1, 2, 3, 5, 10, 20, 60)
    return indicators.lagged_returns(t.daily_bars(spark, sf), lags).select("Date", "Symbol", *[f"ret_{k}d" for k in lags])


@query(
    "wn03_moving_averages",
    f"""WITH {BARS}, m AS (SELECT *, """
    + ", ".join(f"""{full("avg", '"Close"', n)} AS ma_{n}""" for n in (5, 10, 20, 60, 120))
    + f""" FROM bars) SELECT {d()}, "Symbol", """
    + ", ".join(r(f"ma_{n}") + ", " + r(f'"Close" / ma_{n} - 1', f"close_to_ma_{n}") for n in (5, 10, 20, 60, 120))
    + " FROM m",
)
def moving_averages(spark, sf):
    ns = (5, 10, 20, 60, 120)
    cols = [c for n in ns for c in (f"ma_{n}", f"close_to_ma_{n}")]
    return indicators.moving_averages(t.daily_bars(spark, sf), ns).select("Date", "Symbol", *cols)


@query(
    "wn04_rolling_volatility",
    f"""WITH {RETURNS} SELECT {d()}, "Symbol", """
    + ", ".join(r(full("stddev_samp", "log_return", n), f"vol_{n}") for n in (5, 20, 60))
    + " FROM ret",
)
def rolling_volatility(spark, sf):
    return indicators.rolling_volatility(returns(spark, sf)).select("Date", "Symbol", "vol_5", "vol_20", "vol_60")


@query(
    "wn05_volume_ratio",
    f"""WITH {BARS} SELECT {d()}, "Symbol", {r('"Volume" / (' + full("avg", '"Volume"', 20) + ")", "vol_ratio_20")} FROM bars""",
)
def volume_ratio(spark, sf):
    return indicators.volume_ratio(t.daily_bars(spark, sf)).select("Date", "Symbol", "vol_ratio_20")


EWM_SQL = f"""WITH RECURSIVE {RETURNS},
src AS (SELECT *, greatest("Close" - prev, 0) AS gain, greatest(prev - "Close", 0) AS loss FROM ret),
walk AS (
  SELECT "Symbol", bar_no, "Close" AS fast, "Close" AS slow, CAST(NULL AS DOUBLE) AS up, CAST(NULL AS DOUBLE) AS down, CAST(0 AS DOUBLE) AS sig
  FROM src WHERE bar_no = 0
  UNION ALL
  SELECT s."Symbol", s.bar_no, f, l, coalesce(w.up * (13.0/14)::DOUBLE + s.gain * (1.0/14)::DOUBLE, s.gain),
         coalesce(w.down * (13.0/14)::DOUBLE + s.loss * (1.0/14)::DOUBLE, s.loss), w.sig * 0.8::DOUBLE + (f - l) * 0.2::DOUBLE
  FROM walk w JOIN (SELECT * FROM src) s ON s."Symbol" = w."Symbol" AND s.bar_no = w.bar_no + 1,
  LATERAL (SELECT w.fast * (11.0/13)::DOUBLE + s."Close" * (2.0/13)::DOUBLE AS f, w.slow * (25.0/27)::DOUBLE + s."Close" * (2.0/27)::DOUBLE AS l))
"""


@query(
    "wn06_rsi",
    EWM_SQL
    + f"""SELECT {d('s."Date"')}, s."Symbol", {r("coalesce(100.0 - 100.0 / (1.0 + up / nullif(down, 0)), 50.0)", "rsi_14")},
    {fl("coalesce(100.0 - 100.0 / (1.0 + up / nullif(down, 0)), 50.0) BETWEEN 30 AND 35", "rsi_pullback_buy_flag")}
    FROM walk JOIN src s USING ("Symbol", bar_no)""",
)
def rsi(spark, sf):
    df = features.rsi_flags(indicators.rsi_macd(indicators.number_bars(t.daily_bars(spark, sf))))
    return df.select("Date", "Symbol", "rsi_14", "rsi_pullback_buy_flag")


@query(
    "wn07_ewm",
    EWM_SQL
    + f"""SELECT {d('s."Date"')}, s."Symbol", {r("fast", "ewm_12")}, {r("up", "ewm_gain_14")} FROM walk JOIN src s USING ("Symbol", bar_no)""",
)
def ewm(spark, sf):
    df = indicators.number_bars(t.daily_bars(spark, sf))
    gain = F.greatest(F.col("Close") - F.lag("Close", 1).over(Window.partitionBy("Symbol").orderBy("Date")), F.lit(0.0))
    df = df.withColumn("gain", gain)
    out = indicators.ewm(df, {"ewm_12": ("Close", 2.0 / 13.0, 0), "ewm_gain_14": ("gain", 1.0 / 14.0, 1)})
    return out.select("Date", "Symbol", "ewm_12", "ewm_gain_14")


@query(
    "wn08_macd",
    EWM_SQL
    + f"""SELECT {d('s."Date"')}, s."Symbol", {r("fast - slow", "macd")}, {r("sig", "macd_signal")}, {r("fast - slow - sig", "macd_hist")}
    FROM walk JOIN src s USING ("Symbol", bar_no)""",
)
def macd(spark, sf):
    df = indicators.rsi_macd(indicators.number_bars(t.daily_bars(spark, sf)))
    return df.select("Date", "Symbol", "macd", "macd_signal", "macd_hist")


@query(
    "wn09_atr",
    f"""WITH {RETURNS}, tr AS (SELECT *, greatest("High" - "Low", abs("High" - prev), abs("Low" - prev)) AS v FROM ret)
    SELECT {d()}, "Symbol", {r(full("avg", "v", 14), "atr_14")} FROM tr""",
)
def atr(spark, sf):
    return indicators.average_true_range(t.daily_bars(spark, sf)).select("Date", "Symbol", "atr_14")


STOCH = f"""WITH {BARS}, k AS (
  SELECT *, 100.0 * ("Close" - ({full("min", '"Low"', 14)})) / (({full("max", '"High"', 14)}) - ({full("min", '"Low"', 14)}) + 1e-9) AS stoch_k FROM bars)"""


@query(
    "wn10_stochastic",
    STOCH + f""" SELECT {d()}, "Symbol", {r("stoch_k")}, {r(full("avg", "stoch_k", 3), "stoch_d")} FROM k""",
)
def stochastic(spark, sf):
    return indicators.stochastic(t.daily_bars(spark, sf)).select("Date", "Symbol", "stoch_k", "stoch_d")


@query(
    "wn11_cci",
    f"""WITH {BARS}, tp AS (SELECT *, ("High" + "Low" + "Close") / 3.0 AS v FROM bars),
    m AS (SELECT *, {full("avg", "v", 20)} AS mean, list(v) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS vs FROM tp)
    SELECT {d()}, "Symbol", {r("(v - mean) / nullif(0.015::DOUBLE * (list_sum(list_transform(vs, lambda x: abs(x - mean))) / 20), 0)", "cci_20")} FROM m""",
)
def cci(spark, sf):
    return indicators.commodity_channel(t.daily_bars(spark, sf)).select("Date", "Symbol", "cci_20")


@query(
    "wn12_obv",
    f"""WITH {RETURNS}, o AS (SELECT *, sum(sign(coalesce("Close" - prev, 0)) * "Volume") OVER ({W} ROWS UNBOUNDED PRECEDING) AS obv FROM ret)
    SELECT {d()}, "Symbol", {r("obv")}, {r('obv / nullif(lag(obv, 5) OVER (' + W + "), 0) - 1", "obv_change_5d")} FROM o""",
)
def obv(spark, sf):
    return indicators.on_balance_volume(t.daily_bars(spark, sf)).select("Date", "Symbol", "obv", "obv_change_5d")


@query(
    "wn13_indicator_block",
    EWM_SQL.rstrip()
    + f""", ind AS (SELECT s.*, up, down, fast - slow AS macd, fast - slow - sig AS hist, greatest("High" - "Low", abs("High" - prev), abs("Low" - prev)) AS tr
      FROM walk JOIN src s USING ("Symbol", bar_no))
    SELECT {d()}, "Symbol", {r("coalesce(100.0 - 100.0 / (1.0 + up / nullif(down, 0)), 50.0)", "rsi_14")}, {r("macd")},
    {r("hist", "macd_hist")}, {r(full("avg", "tr", 14), "atr_14")} FROM ind""",
)
def indicator_block(spark, sf):
    df = indicators.technical_block(t.daily_bars(spark, sf))
    return df.select("Date", "Symbol", "rsi_14", "macd", "macd_hist", "atr_14")


@query(
    "wn14_rolling_zscore",
    f"""WITH {FLOW_BARS} SELECT {d()}, "Symbol", {r("coalesce((foreign_net_buy - (" + full("avg", "foreign_net_buy", 20) + ")) / nullif(" + full("stddev_samp", "foreign_net_buy", 20) + ", 0), 0)", "foreign_net_buy_z20")} FROM fb""",
)
def rolling_zscore(spark, sf):
    df = features.resolve_context(bars_with_flows(spark, sf))
    return indicators.rolling_zscore(df, "foreign_net_buy", "foreign_net_buy_z20").select("Date", "Symbol", "foreign_net_buy_z20")


@query(
    "wn15_flow_sums",
    f"""WITH {FLOW_BARS} SELECT {d()}, "Symbol", """
    + ", ".join(
        r(f"coalesce({full('sum', c, n)}, 0)", f"{c}_{n}d") for c in ("foreign_net_buy", "institution_net_buy") for n in (3, 5)
    )
    + " FROM fb",
)
def flow_sums(spark, sf):
    df = features.resolve_context(bars_with_flows(spark, sf))
    for c in ("foreign_net_buy", "institution_net_buy"):
        df = indicators.flow_sums(df, c)
    return df.select("Date", "Symbol", *[f"{c}_{n}d" for c in ("foreign_net_buy", "institution_net_buy") for n in (3, 5)])


@query(
    "wn16_year_high",
    f"""WITH {BARS}, {YEAR_HIGH.format(src="bars")} SELECT {d()}, "Symbol", {r("close_to_52w_high")},
    {fl('"Close" >= prev_high', "breakout_52w_flag")} FROM yh""",
)
def year_high(spark, sf):
    return indicators.year_high(t.daily_bars(spark, sf)).select("Date", "Symbol", "close_to_52w_high", "breakout_52w_flag")


@query(
    "wn17_turnover_rank",
    f"""WITH {RETURNS}, {RANKED} SELECT {d()}, "Symbol", turnover_rank_daily, {fl("turnover_rank_daily <= 3", "is_top_turnover_3")},
    {fl("turnover_rank_daily <= 10", "is_top_turnover_10")} FROM rk""",
)
def turnover_rank(spark, sf):
    df = crosssection.turnover_rank(returns(spark, sf), t.rows_per_date(spark, sf))
    return df.select("Date", "Symbol", "turnover_rank_daily", "is_top_turnover_3", "is_top_turnover_10")


@query(
    "wn17b_turnover_rank_sliced",
    f"""WITH {RETURNS}, {RANKED} SELECT {d()}, "Symbol", turnover_rank_daily FROM rk""",
)
def turnover_rank_sliced(spark, sf):
    """The same rank in the form used when a date is too large for one task."""
    df = crosssection.turnover_rank(returns(spark, sf), None)
    return df.select("Date", "Symbol", "turnover_rank_daily")


@query(
    "wn18_dense_turnover_rank",
    f"""WITH {RETURNS} SELECT {d()}, "Symbol", dense_rank() OVER (PARTITION BY "Date" ORDER BY round(value_traded / 1000) DESC) AS turnover_rank_daily FROM ret""",
)
def dense_turnover_rank(spark, sf):
    df = returns(spark, sf).select("Date", "Symbol", F.round(F.col("value_traded") / 1000).alias("value_traded"))
    return crosssection.dense_turnover_rank(df, t.rows_per_date(spark, sf)).select("Date", "Symbol", "turnover_rank_daily")


@query(
    "wn19_leader_by_rank",
    f"""WITH {RETURNS}, {RANKED}, s AS (SELECT *, sum(CASE WHEN turnover_rank_daily <= 3 AND daily_return > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY "Date") AS n FROM rk)
    SELECT {d()}, "Symbol", {fl("turnover_rank_daily = 1 AND daily_return > 0 AND n >= 3", "leader_confirmation_flag")} FROM s""",
)
def leader_by_rank(spark, sf):
    df = crosssection.turnover_rank(returns(spark, sf), t.rows_per_date(spark, sf))
    return crosssection.leader_by_rank(df).select("Date", "Symbol", "leader_confirmation_flag")


LEADERS = f"""{RETURNS.replace("ret AS (", "ret AS MATERIALIZED (", 1)}, {RANKED.replace("rk AS (", "rk AS MATERIALIZED (", 1)},
top AS (SELECT *, coalesce(daily_return, 0) AS rt, row_number() OVER (PARTITION BY "Date" ORDER BY turnover_rank_daily, coalesce(daily_return, 0) DESC, "Symbol") AS pos FROM rk QUALIFY pos <= 3),
lead AS (SELECT "Date", coalesce(max(CASE WHEN pos = 1 THEN rt END), 0) AS l1, coalesce(max(CASE WHEN pos = 2 THEN rt END), 0) AS l2,
         coalesce(max(CASE WHEN pos = 3 THEN rt END), 0) AS l3, sum(CASE WHEN rt > 0 THEN 1 ELSE 0 END) AS movers FROM top GROUP BY 1)"""


@query(
    "wn20_leader_returns",
    f"""WITH {LEADERS} SELECT {d()}, "Symbol", {r("l1", "leader_1_return")}, {r("l2", "leader_2_return")}, {r("l3", "leader_3_return")},
    {il("l1 > 0 AND movers >= 2", "leader_confirmation_flag")} FROM rk JOIN lead USING ("Date")""",
)
def leader_returns(spark, sf):
    df = crosssection.leader_returns(crosssection.turnover_rank(returns(spark, sf), t.rows_per_date(spark, sf)))
    return df.select("Date", "Symbol", "leader_1_return", "leader_2_return", "leader_3_return", "leader_confirmation_flag")


@query(
    "wn21_next_day_target",
    f"""WITH {RETURNS}, y AS (SELECT *, ln(lead("Close") OVER ({W}) / "Close") AS target_log_return FROM ret)
    SELECT {d()}, "Symbol", {r("target_log_return")}, {il("target_log_return > 0", "target_up")},
    {r('"Close" * exp(target_log_return)', "target_close")} FROM y""",
)
def next_day_target(spark, sf):
    df = indicators.next_day_target(t.daily_bars(spark, sf))
    return df.select("Date", "Symbol", "target_log_return", "target_up", "target_close")


REGIME = f"""
reg AS (SELECT *, coalesce("Close" / ({full("avg", '"Close"', 20)}) - 1, 0) AS trend, coalesce({full("stddev_samp", "log_return", 20)}, 0) AS vol FROM ret),
regime AS (SELECT *, CASE WHEN trend > 0.01 THEN 'uptrend' WHEN trend < -0.01 THEN 'downtrend' ELSE 'sideways' END || '_' ||
  CASE WHEN vol > quantile_cont(vol, 0.75) OVER ({W} ROWS UNBOUNDED PRECEDING) THEN 'high_vol' ELSE 'low_vol' END AS market_regime FROM reg)"""


@query(
    "wn22_market_regime",
    f"""WITH {RETURNS}, {REGIME} SELECT {d()}, "Symbol", market_regime FROM regime""",
)
def market_regime(spark, sf):
    df = indicators.rolling_volatility(indicators.moving_averages(returns(spark, sf), (20,)), (20,))
    return indicators.market_regime(df).select("Date", "Symbol", "market_regime")


@query(
    "wn23_external_returns",
    f"""WITH {BARS}, ext AS (SELECT 'R' || n_regionkey AS series, "Date", floor(sum("Close") / count(*) * 1e6 + 0.5) / 1e6 AS close FROM bars
      JOIN supplier ON "Symbol" = 'S' || s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2),
    x AS (SELECT *, close / lag(close) OVER w - 1 AS ret_1d, close / lag(close, 5) OVER w - 1 AS ret_5d FROM ext WINDOW w AS (PARTITION BY series ORDER BY "Date"))
    SELECT series, {d()}, {r("close")}, {r("ret_1d")}, {r("ret_5d")}, {r(full("stddev_samp", "ret_1d", 20, 'PARTITION BY series ORDER BY "Date"'), "vol_20")} FROM x""",
)
def external_returns(spark, sf):
    from tickloom.operators.context import external_returns as returns_of
    from tickloom.plans.joins import region_series

    return returns_of(region_series(spark, sf))


@query(
    "wn24_cross_section_rank",
    f"""WITH {RETURNS} SELECT {d()}, "Symbol", row_number() OVER w AS cross_section_rank, count(*) OVER (PARTITION BY "Date") AS rank_universe_size,
    {r('(count(*) OVER (PARTITION BY "Date") - row_number() OVER w + 1.0) / count(*) OVER (PARTITION BY "Date")', "rank_percentile")}
    FROM ret WINDOW w AS (PARTITION BY "Date" ORDER BY daily_return DESC NULLS LAST, "Symbol")""",
)
def cross_section_rank(spark, sf):
    df = crosssection.cross_section_ranks(returns(spark, sf), "daily_return", t.rows_per_date(spark, sf))
    return df.select("Date", "Symbol", "cross_section_rank", "rank_universe_size", "rank_percentile")


@query(
    "wn25_percentile_score",
    f"""WITH {RETURNS}, v AS (SELECT *, floor(daily_return * 1e3) / 1e3 AS x FROM ret),
    k AS (SELECT *, rank() OVER (ORDER BY x NULLS LAST) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rk, count(x) OVER () AS n FROM v)
    SELECT {d()}, "Symbol", {r("CASE WHEN x IS NULL THEN 0.5 ELSE rk / n END", "score")} FROM k""",
)
def percentile_score(spark, sf):
    df = returns(spark, sf).select("Date", "Symbol", (F.floor(F.col("daily_return") * 1e3) / 1e3).alias("x"))
    return percentile_rank(df, "x", "score").select("Date", "Symbol", "score")


@query(
    "wn26_latest_rows",
    f"""WITH {BARS} SELECT {d()}, "Symbol", {r('"Close"', "Close")} FROM bars QUALIFY row_number() OVER (PARTITION BY "Symbol" ORDER BY "Date" DESC) = 1""",
)
def latest_rows(spark, sf):
    from tickloom.operators.skew import first_per_key

    return first_per_key(t.daily_bars(spark, sf).select("Date", "Symbol", "Close"), ["Symbol"], [F.col("Date")], last=True)


@query(
    "pf12_rsi_flags",
    EWM_SQL.rstrip()
    + f""", rs AS (SELECT s.*, coalesce(100.0 - 100.0 / (1.0 + up / nullif(down, 0)), 50.0) AS rsi FROM walk JOIN src s USING ("Symbol", bar_no))
    SELECT {d()}, "Symbol", {fl("rsi BETWEEN 30 AND 35", "rsi_pullback_buy_flag")}, {fl("rsi >= 70", "rsi_overbought_sell_flag")} FROM rs""",
)
def rsi_flags(spark, sf):
    df = features.rsi_flags(indicators.rsi_macd(indicators.number_bars(t.daily_bars(spark, sf))))
    return df.select("Date", "Symbol", "rsi_pullback_buy_flag", "rsi_overbought_sell_flag")


MATRIX = f"""{LEADERS}, {REGIME.strip()},
hi AS (SELECT "Date", "Symbol", "Close" / CASE WHEN count("Close") OVER a >= 20 THEN max("Close") OVER a END AS to_high,
   "Close" / lag("Close", 20) OVER w - 1 AS ret_20d, {full("avg", '"Close"', 60)} AS ma_60, {full("stddev_samp", "log_return", 20)} AS vol_20,
   "Volume" / ({full("avg", '"Volume"', 20)}) AS vol_ratio_20, ln(lead("Close") OVER w / "Close") AS target FROM ret
   WINDOW w AS ({W}), a AS ({W} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))"""


@query(
    "feature_matrix",
    f"""WITH {MATRIX} SELECT {d('hi."Date"')}, hi."Symbol", {r("ret_20d")}, {r("ma_60")}, {r("vol_20")}, {r("vol_ratio_20")}, {r("to_high", "close_to_52w_high")}, {r("target", "target_log_return")},
    turnover_rank_daily, {r("l1", "leader_1_return")}, {il("l1 > 0 AND movers >= 2", "leader_confirmation_flag")}, {il("coalesce(to_high, 0) >= 1.0", "breakout_52w_flag")}, market_regime
    FROM hi JOIN rk ON rk."Date" = hi."Date" AND rk."Symbol" = hi."Symbol" JOIN lead ON lead."Date" = hi."Date" JOIN regime ON regime."Date" = hi."Date" AND regime."Symbol" = hi."Symbol" WHERE target IS NOT NULL""",
)
def feature_matrix(spark, sf):
    """All feature layers in one plan, labelled rows only."""
    bars = t.daily_bars(spark, sf)
    out = features.feature_matrix(bars, group_rows=t.rows_per_date(spark, sf))
    return out.select(
        "Date", "Symbol", "ret_20d", "ma_60", "vol_20", "vol_ratio_20", "close_to_52w_high", "target_log_return", "turnover_rank_daily",
        "leader_1_return", "leader_confirmation_flag", "breakout_52w_flag", "market_regime",
    )
