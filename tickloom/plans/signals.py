"""Queries over score back-tests, market clock, safety and proxies."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from tickloom.functions import clock
from tickloom.operators import signal_tests
from tickloom.params import GateParams
from tickloom.plans.joins import EXT, region_series
from tickloom.plans.registry import query
from tickloom.plans.sqltext import BARS, d, il, r
from tickloom.sources import sinks
from tickloom.sources import tables as t

HOLIDAYS = (date(2024, 1, 1), date(2024, 1, 2), date(2024, 1, 15))


CAL = """
cl0 AS (SELECT CAST(unnest(generate_series(DATE '2023-12-25', DATE '2024-03-01', INTERVAL 1 DAY)) AS DATE) AS day),
cl1 AS (SELECT day, isodow(day) < 6 AND day NOT IN (DATE '2024-01-01', DATE '2024-01-02', DATE '2024-01-15') AS is_open FROM cl0),
cl AS (SELECT day, is_open, min(CASE WHEN is_open THEN day END) OVER (ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM cl1),
sess AS (SELECT event_id, user_id, value, event_type, ts + INTERVAL 9 HOUR AS k, day, nxt, CASE WHEN NOT is_open THEN 'holiday' WHEN CAST(ts + INTERVAL 9 HOUR AS TIME) < TIME '09:00:00' THEN 'pre_market'
   WHEN CAST(ts + INTERVAL 9 HOUR AS TIME) <= TIME '15:30:00' THEN 'regular' ELSE 'after_market' END AS market_session FROM events JOIN cl ON day = CAST(ts + INTERVAL 9 HOUR AS DATE))"""


def sessions(spark, sf):
    ev = t.table(spark, sf, "events").withColumnRenamed("ts", "signal_at")
    return clock.add_session(ev, HOLIDAYS)


@query("pf31_market_session", f"""WITH {CAL} SELECT event_id, market_session FROM sess""")
def market_session(spark, sf):
    return sessions(spark, sf).select("event_id", "market_session")


@query(
    "pf32_effective_trading_day",
    f"""WITH {CAL} SELECT event_id, {d("CASE WHEN market_session IN ('after_market', 'holiday') THEN nxt ELSE day END", "effective_trading_day")} FROM sess""",
)
def effective_trading_day(spark, sf):
    return sessions(spark, sf).select("event_id", "effective_trading_day")


@query(
    "pf33_next_business_day",
    f"""WITH {CAL} SELECT event_id, {d("nxt", "next_trading_day")}, CASE WHEN day > DATE '2024-01-25' THEN 'expired' WHEN DATE '2024-01-25' - day <= 60 THEN 'near_expiry' ELSE 'ok' END AS coverage FROM sess""",
)
def next_business_day(spark, sf):
    ev = t.table(spark, sf, "events").select("event_id", clock.local_time("ts").cast("date").alias("day"))
    out = ev.withColumn("next_trading_day", clock.next_trading_day(F.col("day"), HOLIDAYS))
    return out.select("event_id", "next_trading_day", clock.calendar_coverage(F.col("day"), date(2024, 1, 25)).alias("coverage"))


@query(
    "pf33_next_business_day_of_orders",
    f"""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders),
    c AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM o), (SELECT max(day) FROM o) + 30, INTERVAL 1 DAY)) AS DATE) AS c_day),
    n AS (SELECT c_day, isodow(c_day) < 6 AND NOT (c_day BETWEEN DATE '1995-04-28' AND DATE '1995-05-05') AND c_day <> DATE '1997-12-25' AS is_open FROM c),
    x AS (SELECT c_day, is_open, min(CASE WHEN is_open THEN c_day END) OVER (ORDER BY c_day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM n)
    SELECT o_orderkey, CAST(is_open AS INTEGER) AS is_open, {d("nxt", "next_trading_day")} FROM o JOIN x ON c_day = day""",
)
def next_business_day_of_orders(spark, sf):
    """Seven years of dates, with a week of holidays between two weekends."""
    closed = [*(date(1995, 4, 28) + timedelta(days=i) for i in range(8)), date(1997, 12, 25)]
    day = F.col("o_orderdate").cast("date")
    return t.table(spark, sf, "orders").select("o_orderkey", clock.is_trading_day(day, closed).alias("is_open"), clock.next_trading_day(day, closed).alias("next_trading_day"))


@query(
    "pf28_context_date_policy",
    """SELECT o_orderkey, CASE WHEN gap IS NULL THEN 'missing_context_date' WHEN gap > 3 THEN 'context_date_gap_exceeded' END AS reason, CASE WHEN gap <= 3 THEN 1 ELSE 0 END AS allowed FROM (
      SELECT o_orderkey, abs(CAST(o_orderdate AS DATE) + CAST(o_custkey % 9 - 4 AS INT) - CAST(o_orderdate AS DATE)) + CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE 0 END AS gap FROM orders)""",
)
def context_date_policy(spark, sf):
    o = t.table(spark, sf, "orders")
    day = F.col("o_orderdate").cast("date")
    context = F.when(F.col("o_custkey") % 11 != 0, F.date_add(day, (F.col("o_custkey") % 9 - 4).cast("int")))
    policy = clock.context_policy(day, context)
    return o.select("o_orderkey", policy["reason"].alias("reason"), policy["allowed"].alias("allowed"))


@query("pf38_stale_predictions", """SELECT o_orderkey, CASE WHEN DATE '2000-06-30' - CAST(o_orderdate AS DATE) > 30 THEN 1 ELSE 0 END AS stale FROM orders""")
def stale_predictions(spark, sf):
    o = t.table(spark, sf, "orders")
    return o.select("o_orderkey", clock.is_stale(F.col("o_orderdate").cast("date"), F.lit(date(2000, 6, 30))).alias("stale"))


def safety_input(spark, sf):
    e = F.col("event_id")
    bits = dict(zip(signal_tests.SAFETY_FLAGS, (97, 11, 13, 17, 19, 23, 29, 31)))
    return t.table(spark, sf, "events").select(
        "event_id", *[(e % n == 0).alias(c) for c, n in bits.items()],
        F.when(e % 7 != 0, F.col("value") * 5e7).alias("avg_trading_value_20d"),
        F.when(e % 37 == 0, F.array(F.lit("limit_up"), F.lit("thin"))).otherwise(F.array().cast("array<string>")).alias("risk_flags"),
    )


@query(
    "pf30_safety_filter",
    """SELECT event_id, status AS tradeability_status, CASE WHEN status = 'unknown' THEN concat_ws(';', nullif(flags, ''), 'tradeability_unknown') ELSE flags END AS risk_flags FROM (
     SELECT event_id, flags, CASE WHEN contains(flags, 'trading_halt') THEN 'halted' WHEN contains(flags, 'limit_up') OR contains(flags, 'limit_down') THEN 'limit_locked'
      WHEN regexp_matches(flags, 'management_issue|delisting_risk|investment_warning|volatility_interruption|wide_spread_risk|low_liquidity') THEN 'caution' WHEN v IS NULL THEN 'unknown' ELSE 'tradable' END AS status FROM (
      SELECT event_id, v, concat_ws(';', CASE WHEN event_id % 37 = 0 THEN 'limit_up;thin' END, CASE WHEN event_id % 97 = 0 THEN 'trading_halt' END, CASE WHEN event_id % 11 = 0 THEN 'management_issue' END, CASE WHEN event_id % 13 = 0 THEN 'delisting_risk' END,
       CASE WHEN event_id % 17 = 0 THEN 'investment_warning' END, CASE WHEN event_id % 19 = 0 AND event_id % 37 <> 0 THEN 'limit_up' END, CASE WHEN event_id % 23 = 0 THEN 'limit_down' END, CASE WHEN event_id % 29 = 0 THEN 'volatility_interruption' END,
       CASE WHEN event_id % 31 = 0 THEN 'wide_spread_risk' END, CASE WHEN v < 1e8 THEN 'very_low_liquidity' WHEN v < 1e9 THEN 'low_liquidity' END) AS flags FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value * 5e7 END AS v FROM events)))""",
)
def safety_filter(spark, sf):
    return signal_tests.safety_filter(safety_input(spark, sf)).select("event_id", "tradeability_status", "risk_flags")


# ---------------------------------------------------------------- signals against bars


def signals(spark, sf):
    """One signal per order line: the ordered name on its shipping date."""
    li = t.table(spark, sf, "lineitem")
    day = F.col("l_shipdate").cast("date")
    n = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return li.select(
        n.alias("seq"), "l_partkey", F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker"), ((n * 31 % 199 - 99) / 2.0).alias("score"), day.alias("signal_day"),
        F.when(n % 3 == 0, F.date_add(day, 1)).otherwise(day).alias("effective_trading_day"),
        F.when(n % 6 == 0, "after_market").when(n % 3 == 0, "holiday").otherwise("regular").alias("market_session"),
        F.when(n % 10 == 0, "halted").when(n % 10 == 1, "limit_locked").otherwise("tradable").alias("tradeability_status"),
        F.concat(F.lit("sec"), n % 5).alias("sector"), F.concat(F.lit("cap"), n % 3).alias("market_cap_bucket"),
    )


def prices(spark, sf):
    bars = t.daily_bars(spark, sf)
    return bars.select(
        F.col("Symbol").alias("ticker"), F.col("Date").alias("trading_day"), F.col("Open").alias("open"), F.col("Close").alias("close"),
        F.lit(0.001).alias("market_return"), F.lit(0.002).alias("sector_return"), F.lit(0).alias("row_no"),
    )


SIG = f"""{BARS}, sg AS (SELECT n AS seq, l_partkey AS pk, 'S' || l_suppkey AS ticker, (n * 31 % 199 - 99) / 2.0::DOUBLE AS score, CAST(l_shipdate AS DATE) AS signal_day, CAST(l_shipdate AS DATE) + CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END AS eday,
   CASE WHEN n % 6 = 0 THEN 'after_market' WHEN n % 3 = 0 THEN 'holiday' ELSE 'regular' END AS ms, n % 10 AS st, 'sec' || n % 5 AS sector, 'cap' || n % 3 AS cap, n % 4 AS variant FROM (SELECT *, l_orderkey * 10 + l_linenumber AS n FROM lineitem)),
ob AS (SELECT sg.*, coalesce(round_even((b."Close" / b."Open" - 1) * 1e6, 0) / 1e6, 0) AS raw_return, coalesce(round_even((b."Close" / b."Open" - 1 - 0.0026::DOUBLE) * 1e6, 0) / 1e6, 0) AS ret, b."Close" IS NULL AS missing,
   concat_ws(';', CASE WHEN n3 AND ms = 'after_market' THEN 'after_market_shifted' END, CASE WHEN n3 AND ms = 'holiday' THEN 'holiday_shifted' END, CASE WHEN b."Close" IS NULL THEN 'missing_intraday_price' END) AS flags
   FROM (SELECT *, eday <> signal_day AS n3 FROM sg WHERE st > 1) sg LEFT JOIN bars b ON b."Symbol" = sg.ticker AND b."Date" = sg.eday)"""


@query("jn05_signal_returns", f"""WITH {SIG} SELECT seq, ticker, {d("eday", "entry_day")}, {r("raw_return")}, {r("ret", "after_cost_return")}, flags AS quality_flags FROM ob""")
def signal_returns(spark, sf):
    out = signal_tests.match_returns(signals(spark, sf), prices(spark, sf), "row_no", include_missing=True)
    return out.select("seq", "ticker", "entry_day", "raw_return", "after_cost_return", "quality_flags")


def observations(spark, sf):
    out = signal_tests.match_returns(signals(spark, sf), prices(spark, sf), "row_no")
    return out.withColumns({"seq": F.struct("seq", "ticker", "l_partkey"), "variant": (F.col("seq") % 4).cast("string")})


def block_sql(src: str, by: str, basket: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"""(SELECT {by + ", " if by else ""}count(*) AS n, round_even(coalesce(covar_pop(score, ret) / nullif(stddev_pop(score) * stddev_pop(ret), 0), 0) * 1e6, 0) / 1e6 AS ic,
      round_even(coalesce(covar_pop(sr, rr) / nullif(stddev_pop(sr) * stddev_pop(rr), 0), 0) * 1e6, 0) / 1e6 AS rank_ic,
      round_even(avg(CASE WHEN (score > 0 AND ret > 0) OR (score < 0 AND ret < 0) OR score = 0 THEN 1.0 ELSE 0 END::DOUBLE) * 1e6, 0) / 1e6 AS hit,
      round_even((avg(ret) FILTER (ft <= {basket}) - avg(ret) FILTER (ft > m - {basket})) * 1e6, 0) / 1e6 AS spread
      FROM (SELECT *, row_number() OVER ({part}ORDER BY score, seq, ticker, pk) AS sr, row_number() OVER ({part}ORDER BY ret, seq, ticker, pk) AS rr, row_number() OVER ({part}ORDER BY score DESC, seq, ticker, pk) AS ft, count(*) OVER ({part}) AS m FROM {src}) {"GROUP BY " + by if by else ""})"""


OBS = f"{SIG}, us AS (SELECT * FROM ob WHERE NOT missing)"
SETS = f"""{OBS}, st AS (SELECT *, 'overall' AS "set", 'all' AS key, 5 AS bk FROM us UNION ALL SELECT *, 'by_day', CAST(eday AS VARCHAR), 1 FROM us UNION ALL SELECT *, 'by_sector', sector, 1 FROM us UNION ALL SELECT *, 'by_market_cap', cap, 1 FROM us),
bl AS {block_sql("st", '"set", key', "bk")}"""


@query(
    "ag17_information_coefficient",
    f"""WITH {OBS} SELECT n AS sample_size, {r("ic")}, {r("rank_ic")}, {r("hit", "hit_ratio")}, {r("spread", "top_bottom_spread")} FROM {block_sql("us", "", "5")}""",
)
def information_coefficient(spark, sf):
    return signal_tests.coefficient_block(observations(spark, sf), [], "seq", 5)


@query(
    "ag18_bucket_summaries",
    f"""WITH {SETS} SELECT "set", key, n AS sample_size, {r("ic")}, {r("rank_ic")}, {r("hit", "hit_ratio")}, {r("spread", "top_bottom_spread")} FROM bl""",
)
def bucket_summaries(spark, sf):
    return signal_tests.validation_sets(observations(spark, sf), "seq", 5)


@query(
    "ag19_variant_comparison",
    f"""WITH {OBS}, v AS {block_sql("us", "variant", "5")}, b AS (SELECT * FROM v WHERE variant = 0)
    SELECT CAST(v.variant AS VARCHAR) AS variant, v.n AS sample_size, {r("v.ic", "ic")}, {r("v.rank_ic", "rank_ic")}, {r("v.spread", "top_bottom_spread")}, {r("round_even((v.ic - b.ic) * 1e6, 0) / 1e6", "ic_delta")},
    {r("round_even((v.rank_ic - b.rank_ic) * 1e6, 0) / 1e6", "rank_ic_delta")}, {r("round_even((v.spread - b.spread) * 1e6, 0) / 1e6", "top_bottom_spread_delta")} FROM v, b WHERE v.variant <> 0""",
)
def variant_comparison(spark, sf):
    return signal_tests.compare_variants(observations(spark, sf), "variant", "0", "seq", t.row_bound(spark, sf))


@query(
    "ag20_performance_gate",
    f"""WITH {SETS} SELECT DISTINCT unnest(list_filter([CASE WHEN "set" = 'overall' AND n < 250 THEN 'insufficient_overall_samples' END, CASE WHEN "set" = 'overall' AND rank_ic <= 0.9 THEN 'rank_ic_below_threshold' END,
     CASE WHEN "set" = 'overall' AND spread <= 0.9 THEN 'top_bottom_spread_below_threshold' END, CASE WHEN "set" <> 'overall' AND n < 12 THEN 'bucket_' || key || '_insufficient_samples' END], lambda x: x IS NOT NULL)) AS failed_check FROM bl""",
)
def performance_gate(spark, sf):
    blocks = signal_tests.validation_sets(observations(spark, sf), "seq", 5)
    return signal_tests.failed_checks(blocks, GateParams(min_bucket_samples=12, min_rank_ic=0.9, min_spread=0.9))


def variants(spark, sf):
    """Weight variants with the metrics of a slice of the observations each."""
    obs = observations(spark, sf)
    blocks = signal_tests.coefficient_block(obs.withColumn("variant", F.concat("variant", "sector")), ["variant"], "seq", 5, t.row_bound(spark, sf))
    size = F.col("sample_size") % 10
    return blocks.select(
        F.col("variant").alias("variant_id"), (size / 10.0 - 0.1).alias("min_weight"), (size / 10.0 + 0.5).alias("max_weight"),
        F.col("rank_ic").alias("test_rank_ic"), F.col("top_bottom_spread").alias("test_spread"), F.col("ic").alias("min_bucket_rank_ic"),
    )


VARIANTS = f"""{OBS}, vs AS (SELECT *, CAST(variant AS VARCHAR) || sector AS vid FROM us), vb AS {block_sql("vs", "vid", "5")},
vr AS (SELECT vid AS variant_id, rank_ic, spread, ic, CASE WHEN (n % 10) / 10.0 - 0.1 < 0 OR (n % 10) / 10.0 + 0.5 > 1.2 THEN 'weight_outside_policy_range' WHEN rank_ic <= -0.01 THEN 'no_out_of_sample_rank_ic_improvement'
   WHEN spread < -0.05 THEN 'worse_out_of_sample_spread' WHEN ic < 0 THEN 'unstable_bucket_rank_ic' END AS why FROM vb)"""


def selected(spark, sf):
    return signal_tests.select_variant(variants(spark, sf), F.lit(-0.01), F.lit(-0.05))


@query(
    "ag21_variant_selection",
    f"""WITH {VARIANTS} SELECT variant_id, why AS rejection_reason, CASE WHEN variant_id = (SELECT variant_id FROM vr WHERE why IS NULL ORDER BY rank_ic DESC, variant_id LIMIT 1) THEN 1 ELSE 0 END AS selected FROM vr""",
)
def variant_selection(spark, sf):
    return selected(spark, sf).select("variant_id", "rejection_reason", "selected")


@query(
    "sk06_tuning_result",
    f"""WITH {VARIANTS}, w AS (SELECT (SELECT variant_id FROM vr WHERE why IS NULL ORDER BY rank_ic DESC, variant_id LIMIT 1) AS s) SELECT s AS selected_variant_id, CASE WHEN s IS NULL THEN 'rejected_all' ELSE 'accepted' END AS adoption_status,
    'scoring.v1' AS baseline_scoring_version, (SELECT string_agg(variant_id || '=' || why, ';' ORDER BY variant_id || '=' || why) FROM vr WHERE why IS NOT NULL) AS rejection_reasons FROM w""",
)
def tuning_result(spark, sf):
    return sinks.tuning_result(selected(spark, sf), "scoring.v1")


# ---------------------------------------------------------------- proxies


def proxy_prices(spark, sf):
    s = region_series(spark, sf)
    at = F.to_timestamp(F.col("Date")) + F.make_dt_interval(hours=F.dayofmonth("Date") % 3 * 12)
    return s.select(F.col("series").alias("proxy_symbol"), F.col("Date").alias("price_date"), "close", at.alias("collected_at"))


DAY, CUTOFF = date(2000, 1, 4), "2000-01-04 06:00:00"
PROXY = f"""{BARS}, {EXT}, px AS (SELECT series AS proxy_symbol, "Date" AS price_date, close, CAST("Date" AS TIMESTAMP) + INTERVAL 12 HOUR * (day("Date") % 3) AS cat FROM ext),
pr AS (SELECT proxy_symbol, max(close) FILTER (cat <= TIMESTAMP '{{cut}}' AND price_date = DATE '2000-01-04') AS now, arg_max(close, price_date) FILTER (cat <= TIMESTAMP '{{cut}}' AND price_date < DATE '2000-01-04') AS prev,
   max(CASE WHEN cat > TIMESTAMP '{{cut}}' AND price_date = DATE '2000-01-04' THEN 1 ELSE 0 END) AS late FROM px GROUP BY 1),
pv AS (SELECT proxy_symbol, round_even((now - prev) / prev * 1e10, 0) / 1e10 AS proxy_return, CASE WHEN now IS NULL THEN 'missing_global_proxy_price' WHEN prev IS NULL THEN 'missing_previous_global_proxy_price' END AS flag, late FROM pr)"""


@query("jn12_proxy_returns", f"""WITH {PROXY.format(cut=CUTOFF)} SELECT proxy_symbol, {r("proxy_return")}, flag AS quality_flag, late AS leakage_blocked FROM pv""")
def proxy_returns(spark, sf):
    return signal_tests.proxy_returns(proxy_prices(spark, sf), F.lit(DAY), F.to_timestamp(F.lit(CUTOFF)))


LATER = "2000-01-06 06:00:00"


@query("jn12_proxy_returns_late_cutoff", f"""WITH {PROXY.format(cut=LATER)} SELECT proxy_symbol, {r("proxy_return")}, flag AS quality_flag, late AS leakage_blocked FROM pv""")
def proxy_returns_late_cutoff(spark, sf):
    return signal_tests.proxy_returns(proxy_prices(spark, sf), F.lit(DAY), F.to_timestamp(F.lit(LATER)))


def proxies(spark, sf):
    n = t.table(spark, sf, "nation")
    return n.select(
        F.concat(F.lit("sector"), F.col("n_nationkey") % 6).alias("korean_sector"), F.concat(F.lit("R"), F.col("n_nationkey") % 7).alias("proxy_symbol"),
        (F.col("n_nationkey") % 5 / 4.0).alias("weight"), F.when(F.col("n_nationkey") % 3 == 0, "inverse").otherwise("normal").alias("direction_transform"),
        (F.col("n_nationkey") % 4 * 1.0 + 0.5).alias("max_adjustment_abs"),
    )


@query(
    "jn13_proxy_adjustment",
    f"""WITH {PROXY.format(cut=LATER)}, pt AS (SELECT 'sector' || n_nationkey % 6 AS korean_sector, 'R' || n_nationkey % 7 AS proxy_symbol, n_nationkey % 5 / 4.0 AS w, CASE WHEN n_nationkey % 3 = 0 THEN -1 ELSE 1 END AS sg, n_nationkey % 4 + 0.5 AS mx FROM nation),
    pa AS (SELECT korean_sector, greatest(-mx, least(proxy_return * w * sg * 100, mx)) * CASE WHEN proxy_return IS NULL THEN NULL ELSE 1 END AS a FROM pt LEFT JOIN pv USING (proxy_symbol))
    SELECT korean_sector, {r("round_even(greatest(least(coalesce(sum(a), 0), 15), -15) * 1e6, 0) / 1e6", "global_proxy_adjustment")}, count(*) AS proxy_count,
    concat_ws(';', CASE WHEN bool_or(a IS NULL) THEN 'missing_global_proxy_price' END, CASE WHEN max(a) > 0 AND min(a) < 0 THEN 'conflicting_global_proxy_signals' END) AS quality_flags FROM pa GROUP BY 1""",
)
def proxy_adjustment(spark, sf):
    returns = signal_tests.proxy_returns(proxy_prices(spark, sf), F.lit(DAY), F.to_timestamp(F.lit(LATER)))
    return signal_tests.proxy_adjustment(proxies(spark, sf), returns)
