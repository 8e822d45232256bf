"""Queries over predictions: policy labels, scores, result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import policy
from tickloom.functions.numeric import amount_text, percent_text, points_text, price_text
from tickloom.operators import crosssection, scoring
from tickloom.plans.bars import YEAR_HIGH
from tickloom.plans.registry import query
from tickloom.plans.sqltext import RETURNS, STRATA, W, d, fl, full, il, r
from tickloom.sources import tables as t
from tickloom.sources.predictions import head_predictions

HEADS = f"""{RETURNS}, {STRATA}, {YEAR_HIGH.format(src="ret")},
h0 AS (SELECT *, "Close" / lag("Close", 5) OVER w - 1 AS ret_5d, {full("stddev_samp", "log_return", 20)} AS vol_20,
         "Volume" / ({full("avg", '"Volume"', 20)}) AS vol_ratio_20, ln(lead("Close") OVER w / "Close") AS target_log_return,
         CASE WHEN "Close" >= prev_high THEN 1 ELSE 0 END AS breakout_52w_flag, "Open" / prev - 1 AS gap_return
       FROM yh WINDOW w AS ({W})),
heads AS (SELECT h0.*, row_number() OVER (PARTITION BY "Date" ORDER BY value_traded DESC, h0."Symbol") AS turnover_rank_daily,
         ret_5d * -0.1::DOUBLE AS predicted_log_return, 1.0 / (1.0 + exp(ret_5d * -0.1::DOUBLE * -20.0::DOUBLE)) AS up_probability,
         ret_5d * -0.1::DOUBLE - vol_20 AS quantile_low, ret_5d * -0.1::DOUBLE + vol_20 AS quantile_high, 50.0::DOUBLE + ret_5d * 150.0::DOUBLE AS rsi_14,
         ret_5d * 1.5e12 AS foreign_net_buy, daily_return * 1.5e12 AS institution_net_buy, gap_return / 4.0::DOUBLE AS nq_f_ret_1d,
         CASE WHEN close_to_52w_high >= 0.97 THEN 1 ELSE 0 END AS near_52w_high_flag, market_type, sector
       FROM h0 LEFT JOIN strata ON h0."Symbol" = strata."Symbol" WHERE vol_20 IS NOT NULL AND target_log_return IS NOT NULL)"""

TURN = 'turnover_rank_daily'
BOOST_SQL = """round_even(
  CASE WHEN turnover_rank_daily <= 3 THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN turnover_rank_daily <= 15 THEN 0.04::DOUBLE ELSE 0 END
  + CASE WHEN foreign_net_buy > 0 AND institution_net_buy > 0 THEN 0.04::DOUBLE ELSE 0 END
  + CASE WHEN foreign_net_buy >= 1e11 AND institution_net_buy >= 1e11 THEN 0.06::DOUBLE ELSE 0 END
  + CASE WHEN turnover_rank_daily <= 15 AND foreign_net_buy >= 1e11 AND institution_net_buy >= 1e11 THEN 0.08::DOUBLE ELSE 0 END
  + CASE WHEN near_52w_high_flag > 0 OR breakout_52w_flag > 0 THEN 0.03::DOUBLE ELSE 0 END
  + CASE WHEN rsi_14 BETWEEN 30 AND 35 THEN 0.02::DOUBLE ELSE 0 END - CASE WHEN rsi_14 >= 70 THEN 0.08::DOUBLE ELSE 0 END
  + CASE WHEN nq_f_ret_1d > 0 THEN 0.03::DOUBLE ELSE 0 END + CASE WHEN nq_f_ret_1d >= 0.01 THEN 0.06::DOUBLE ELSE 0 END
  - CASE WHEN nq_f_ret_1d <= -0.01 THEN 0.12::DOUBLE ELSE 0 END, 6)"""

PCT_RANK = """({c} IS NULL, 0.5, (rank() OVER (ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / count({c}) OVER ())"""


def pct(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 0.5 ELSE (rank() OVER (ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / count({c}) OVER () END"


FRAME = f"""{HEADS},
f0 AS (SELECT *, (exp(predicted_log_return) - 1) * 100.0 AS predicted_return, "Close" * exp(predicted_log_return) AS predicted_close,
         round(greatest(quantile_high - quantile_low, 0), 12) AS uncertainty_width, {BOOST_SQL} AS boost FROM heads),
f1 AS (SELECT *, {pct("uncertainty_width")} AS uncertainty_score, {pct("predicted_log_return")} AS norm_return FROM f0),
frame AS (SELECT *, 0.65::DOUBLE * norm_return + 0.35::DOUBLE * up_probability - 0.25::DOUBLE * uncertainty_score AS base_score FROM f1),
scored AS (SELECT *, base_score + boost AS signal_score, CASE WHEN nq_f_ret_1d < -0.01 THEN -1.0 ELSE 0.0 END::DOUBLE AS market_headwind_score,
         0.8::DOUBLE AS external_coverage_ratio, 0.5::DOUBLE AS investor_coverage_ratio, 3e6::DOUBLE AS min_liquidity_threshold,
         1 - uncertainty_score AS confidence_score FROM frame)"""


def heads(spark, sf):
    """Widths rounded to 12 digits so that equal widths tie in any engine."""
    return head_predictions(spark, sf).withColumns(
        {"quantile_low": F.col("quantile_low"), "market_regime": F.lit("sideways_low_vol")}
    )


def policy_input(spark, sf):
    """Prediction columns as the policy sees them, without the percentile ranks."""
    df = head_predictions(spark, sf)
    return df.withColumns(
        {
            "predicted_return": F.expm1("predicted_log_return") * 100.0 * 4.0 + 0.0,
            "confidence_score": F.col("up_probability"),
            "uncertainty_score": F.least(F.col("vol_20") * 10.0, F.lit(1.0)),
            "history_direction_accuracy": F.when(F.col("turnover_rank_daily") % 4 != 0, F.col("turnover_rank_daily") / 20.0),
            "coverage_gate_status": F.when(F.col("turnover_rank_daily") == 7, "HALT").otherwise("normal"),
            "external_coverage_ratio": F.col("turnover_rank_daily") / 20.0,
            "investor_coverage_ratio": F.col("vol_ratio_20") / 2.0,
            "min_liquidity_threshold": F.lit(2000.0),
            "market_headwind_score": policy.headwind_score(df),
            "leader_1_return": F.col("daily_return"),
            "leader_2_return": F.col("gap_return"),
            "leader_3_return": F.col("intraday_return"),
            "signal_score": F.col("up_probability"),
            "leader_confirmation_flag": F.when(F.col("turnover_rank_daily") == 1, 1).otherwise(0),
        }
    )


PIN = f"""{HEADS},
pin AS (SELECT * REPLACE (), (exp(predicted_log_return) - 1) * 100.0 * 4.0 AS predicted_return, up_probability AS confidence_score,
  least(vol_20 * 10.0, 1.0) AS uncertainty_score, CASE WHEN {TURN} % 4 <> 0 THEN {TURN} / 20.0 END AS history_direction_accuracy,
  {TURN} = 7 AS halted, {TURN} / 20.0 AS external_coverage_ratio, vol_ratio_20 / 2.0 AS investor_coverage_ratio,
  CASE WHEN nq_f_ret_1d < -0.01 THEN -1 ELSE 0 END AS market_headwind_score, "Close" / "Open" - 1 AS intraday_return FROM heads)""".replace("* REPLACE (), ", "*, ")

LABELS = f"""{PIN}, risk AS (SELECT *, coalesce(nullif(concat_ws('|', CASE WHEN halted THEN 'COVERAGE_HALT' END,
    CASE WHEN uncertainty_score >= 0.75 THEN 'HIGH_UNCERTAINTY' END, CASE WHEN up_probability < 0.5 THEN 'LOW_UP_PROB' END,
    CASE WHEN history_direction_accuracy < 0.45 THEN 'LOW_HISTORY_ACC' END, CASE WHEN value_traded < 2000 THEN 'LOW_LIQUIDITY' END,
    CASE WHEN external_coverage_ratio < 0.6 THEN 'EXTERNAL_FEATURE_MISSING' END, CASE WHEN investor_coverage_ratio < 0.34 THEN 'DATA_COVERAGE_LOW' END,
    CASE WHEN market_headwind_score <= -1 THEN 'MARKET_HEADWIND' END), ''), 'NORMAL') AS risk_flag,
    CASE WHEN predicted_return > 2 THEN '매수' WHEN predicted_return <= -2 THEN '매도' ELSE '관망' END AS recommendation FROM pin),
 sized AS (SELECT *, CASE WHEN risk_flag LIKE '%DATA_COVERAGE_LOW%' OR risk_flag LIKE '%LOW_LIQUIDITY%' THEN '관망'
    WHEN risk_flag LIKE '%HIGH_UNCERTAINTY%' OR risk_flag LIKE '%MARKET_HEADWIND%' THEN '소액'
    WHEN confidence_score >= 0.8 THEN '중간' WHEN confidence_score >= 0.6 THEN '소액' ELSE '관망' END AS position_size_hint FROM risk),
 acted AS (SELECT *, CASE WHEN halted THEN '거래보류' WHEN recommendation = '매수' AND position_size_hint = '중간' THEN '신규매수'
    WHEN recommendation = '매수' THEN '관심관찰' WHEN recommendation = '매도' THEN '비중축소' ELSE '관망' END AS portfolio_action,
    CASE WHEN risk_flag LIKE '%COVERAGE_HALT%' THEN '거래중단' WHEN risk_flag LIKE '%MARKET_HEADWIND%' OR risk_flag LIKE '%DATA_COVERAGE_LOW%' THEN '보수모드'
    WHEN risk_flag LIKE '%LOW_LIQUIDITY%' THEN '체결주의' ELSE '정상' END AS trading_gate FROM sized)"""

PIN_BOOST = BOOST_SQL.replace("+ CASE WHEN near_52w", "+ CASE WHEN turnover_rank_daily = 1 THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN near_52w")


@query("pf13_event_boost", f"""WITH {PIN} SELECT {d()}, "Symbol", {r(PIN_BOOST, "event_boost_score")}, {r(f"up_probability + ({PIN_BOOST})", "signal_score")} FROM pin""")
def event_boost(spark, sf):
    once = policy.with_event_boost(policy_input(spark, sf))
    twice = policy.with_event_boost(once)  # applying it again must not change the score
    return twice.select("Date", "Symbol", "event_boost_score", "signal_score")


@query("pf14_recommendation", f"""WITH {LABELS} SELECT {d()}, "Symbol", recommendation FROM acted""")
def recommendation(spark, sf):
    df = policy_input(spark, sf)
    return df.select("Date", "Symbol", policy.recommendation(df).alias("recommendation"))


@query(
    "pf15_confidence_label",
    f"""WITH {PIN} SELECT {d()}, "Symbol", CASE WHEN confidence_score >= 0.8 THEN '신뢰도 매우 높음' WHEN confidence_score >= 0.67 THEN '신뢰도 높음'
    WHEN confidence_score >= 0.34 THEN '신뢰도 보통' ELSE '신뢰도 낮음' END AS confidence_label FROM pin""",
)
def confidence_label(spark, sf):
    df = policy_input(spark, sf)
    return df.select("Date", "Symbol", policy.confidence_label(df).alias("confidence_label"))


@query("pf16_risk_flags", f"""WITH {LABELS} SELECT {d()}, "Symbol", risk_flag FROM acted""")
def risk_flags(spark, sf):
    df = policy_input(spark, sf)
    return df.select("Date", "Symbol", policy.risk_flag(df).alias("risk_flag"))


@query("pf17_position_size", f"""WITH {LABELS} SELECT {d()}, "Symbol", position_size_hint FROM acted""")
def position_size(spark, sf):
    df = policy_input(spark, sf)
    return df.select("Date", "Symbol", policy.position_size(df, policy.risk_flag(df)).alias("position_size_hint"))


@query("pf18_action_and_gate", f"""WITH {LABELS} SELECT {d()}, "Symbol", portfolio_action, trading_gate FROM acted""")
def action_and_gate(spark, sf):
    df = policy_input(spark, sf)
    # Columns of their own: an expression that is used many times would be computed as often.
    df = df.withColumns({"_risk": policy.risk_flag(df), "_call": policy.recommendation(df)})
    df = df.withColumn("_size", policy.position_size(df, F.col("_risk")))
    action = policy.portfolio_action(df, F.col("_call"), F.col("_size"))
    return df.select("Date", "Symbol", action.alias("portfolio_action"), policy.trading_gate(F.col("_risk")).alias("trading_gate"))


REASON_SQL = """concat_ws(' / ', CASE WHEN turnover_rank_daily <= 15 THEN '종배수급: 거래대금 상위권, 거래대금 상위 15위 종목입니다' END,
  CASE WHEN foreign_net_buy >= 1e11 AND institution_net_buy >= 1e11 THEN '수급조건: 외국인 ' || format('{:,}', round_even(foreign_net_buy / 1e8, 0)::BIGINT) || '억, 기관 '
    || format('{:,}', round_even(institution_net_buy / 1e8, 0)::BIGINT) || '억로 각각 1,000억 이상 순매수입니다' END,
  CASE WHEN daily_return > 0 AND gap_return > 0 AND intraday_return > 0 THEN '주도주확인: 1등주 상승과 함께 2·3등주 동반 상승이 확인됩니다' END,
  CASE WHEN breakout_52w_flag > 0 THEN '추세조건: 52주 신고가 종목입니다' END,
  CASE WHEN nq_f_ret_1d >= 0.01 THEN '해외조건: 나스닥 선물 +1% 이상으로 종배 우호 환경입니다' END,
  CASE WHEN nq_f_ret_1d <= -0.01 THEN '해외조건: 나스닥 선물 -1% 이하로 리스크 회피(매도) 구간입니다' END,
  CASE WHEN rsi_14 BETWEEN 30 AND 35 THEN '중장기조건: RSI 30~35 구간으로 분할매수 관찰 구간입니다' END,
  CASE WHEN rsi_14 >= 70 THEN '중장기조건: RSI 70 이상으로 이익실현/매도 우선 구간입니다' END)"""


@query("pf19_prediction_reason", f"""WITH {PIN} SELECT {d()}, "Symbol", {REASON_SQL} AS prediction_reason FROM pin""")
def prediction_reason(spark, sf):
    df = policy_input(spark, sf)
    return df.select("Date", "Symbol", policy.prediction_reason(df).alias("prediction_reason"))


BET_SQL = """round_even(CASE WHEN turnover_rank_daily <= 15 THEN 0.30::DOUBLE ELSE 0 END + CASE WHEN foreign_net_buy >= 1e11 THEN 0.15::DOUBLE ELSE 0 END
  + CASE WHEN institution_net_buy >= 1e11 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN breakout_52w_flag > 0 OR near_52w_high_flag > 0 THEN 0.15::DOUBLE ELSE 0 END
  + CASE WHEN nq_f_ret_1d >= 0.01 THEN 0.20::DOUBLE ELSE 0 END - CASE WHEN nq_f_ret_1d <= -0.01 THEN 0.35::DOUBLE ELSE 0 END
  + CASE WHEN turnover_rank_daily = 1 THEN 0.15::DOUBLE ELSE 0 END, 4)"""


@query(
    "pf20_close_bet_score",
    f"""WITH {PIN}, b AS (SELECT *, {BET_SQL} AS s FROM pin) SELECT {d()}, "Symbol", {r("s", "jongbae_score")},
    CASE WHEN s >= 0.45 THEN '관심' WHEN s < 0 THEN '경계' ELSE '중립' END AS jongbae_signal FROM b""",
)
def close_bet_score(spark, sf):
    df = policy_input(spark, sf)
    out = df.withColumn("jongbae_score", policy.close_bet_score(df))
    return out.select("Date", "Symbol", "jongbae_score", policy.close_bet_label(F.col("jongbae_score")).alias("jongbae_signal"))


@query(
    "pf21_policy_frame",
    f"""WITH {LABELS} SELECT {d()}, "Symbol", recommendation, risk_flag, position_size_hint, portfolio_action, trading_gate,
    {r(PIN_BOOST, "event_boost_score")}, {r(BET_SQL, "jongbae_score")} FROM acted""",
)
def policy_frame(spark, sf):
    out = policy.policy_frame(policy_input(spark, sf))
    return out.select(
        "Date", "Symbol", "recommendation", "risk_flag", "position_size_hint", "portfolio_action", "trading_gate",
        "event_boost_score", "jongbae_score",
    )


@query(
    "pf22_signal_label",
    f"""WITH {PIN} SELECT {d()}, "Symbol", CASE WHEN up_probability <= 0.25 THEN 'strong_negative' WHEN up_probability <= 0.45 THEN 'weak_negative'
    WHEN up_probability <= 0.55 THEN 'neutral' WHEN up_probability <= 0.75 THEN 'weak_positive' ELSE 'strong_positive' END AS signal_label FROM pin""",
)
def signal_label(spark, sf):
    df = policy_input(spark, sf)
    return df.select("Date", "Symbol", policy.signal_label("signal_score").alias("signal_label"))


# The columns a prediction frame needs, and what boost, headwind and the policy read beside them.
FRAME_COLUMNS = ["Date", "Symbol", "Close", "target_log_return", "market_regime", "predicted_log_return", "up_probability", "quantile_low", "quantile_mid", "quantile_high"]
POLICY_COLUMNS = ["turnover_rank_daily", "foreign_net_buy", "institution_net_buy", "nq_f_ret_1d", "rsi_14", "near_52w_high_flag", "breakout_52w_flag", "value_traded"]


def rounded_heads(spark, sf, extra=()):
    """Quantiles built around 0 so that widths tie exactly where they are equal. The frame is written
    before it is ranked, so it carries only the columns that are asked for."""
    df = head_predictions(spark, sf).withColumn("market_regime", F.lit("sideways_low_vol"))
    width = F.round(F.col("quantile_high") - F.col("quantile_low"), 12)
    return df.withColumns({"quantile_low": F.lit(0.0), "quantile_high": width}).select(*FRAME_COLUMNS, *extra)


@query(
    "pf23_prediction_frame",
    f"""WITH {FRAME} SELECT {d()}, "Symbol", {r("predicted_return")}, {r("predicted_close")}, {r("uncertainty_width")}, {r("uncertainty_score")},
    {r("norm_return")}, {r("base_score", "signal_score")} FROM frame""",
)
def prediction_frame(spark, sf):
    out = scoring.prediction_frame(rounded_heads(spark, sf))
    return out.select(
        "Date", "Symbol", "predicted_return", "predicted_close", "uncertainty_width", "uncertainty_score", "norm_return", "signal_score"
    )


def scored(spark, sf):
    return scoring.scored_frame(rounded_heads(spark, sf, POLICY_COLUMNS), 0.8, 0.5, 3e6, group_rows=t.rows_per_date(spark, sf))


@query(
    "pf24_scored_frame",
    f"""WITH {FRAME} SELECT {d()}, "Symbol", {r("signal_score")}, {r("market_headwind_score")}, {r("external_coverage_ratio")},
    row_number() OVER (PARTITION BY "Date" ORDER BY floor(signal_score * 1e9) DESC, "Symbol") AS cross_section_rank FROM scored""",
)
def scored_frame(spark, sf):
    out = scored(spark, sf).drop("cross_section_rank", "rank_percentile", "rank_universe_size")
    out = out.withColumn("_key", F.floor(F.col("signal_score") * 1e9))  # scores equal up to rounding noise tie
    out = crosssection.cross_section_ranks(out, "_key", t.rows_per_date(spark, sf))
    return out.select("Date", "Symbol", "signal_score", "market_headwind_score", "external_coverage_ratio", "cross_section_rank")


def names(spark, sf):
    s = t.table(spark, sf, "supplier")
    return s.where(F.col("s_suppkey") % 3 != 0).select(
        F.lpad(F.concat(F.lit("S"), F.col("s_suppkey")), 6, "0").alias("Ticker"),
        F.concat(F.lit("S"), F.col("s_suppkey"), F.when(F.col("s_suppkey") % 2 == 0, "").otherwise(".KS")).alias("Symbol"),
        F.col("s_name").alias("Name"),
    )


@query(
    "pf25_finalize_latest",
    f"""WITH {FRAME} SELECT {d()}, "Symbol", {r("confidence_score")},
    CASE WHEN CAST(substr("Symbol", 2) AS INT) % 3 <> 0 THEN 'Supplier#' || lpad(substr("Symbol", 2), 9, '0') ELSE "Symbol" END AS symbol_name,
    CASE WHEN predicted_return > 2 THEN '매수' WHEN predicted_return <= -2 THEN '매도' ELSE '관망' END AS recommendation FROM scored""",
)
def finalize_latest(spark, sf):
    out = scoring.finalize_latest(scored(spark, sf), names(spark, sf))
    return out.select("Date", "Symbol", "confidence_score", "symbol_name", "recommendation")


@query(
    "pf26_coverage_gate",
    f"""WITH {PIN}, c AS (SELECT "Date", avg(external_coverage_ratio) AS e, avg(investor_coverage_ratio) AS i FROM pin GROUP BY 1)
    SELECT {d()}, CASE WHEN i < 0.5 THEN 'halt' WHEN e < 0.7 OR i < 0.7 THEN 'caution' ELSE 'normal' END AS gate FROM c""",
)
def coverage_gate(spark, sf):
    per_date = policy_input(spark, sf).groupBy("Date").agg(
        F.avg("external_coverage_ratio").alias("e"), F.avg("investor_coverage_ratio").alias("i")
    )
    return per_date.select("Date", policy.coverage_gate(F.col("e"), F.col("i")).alias("gate"))


@query(
    "pf34_simple_result",
    f"""WITH {PIN}, k AS (SELECT *, row_number() OVER (PARTITION BY "Date" ORDER BY up_probability DESC, "Symbol") AS rk, count(*) OVER (PARTITION BY "Date") AS n FROM pin)
    SELECT "Symbol" AS "종목코드", "Symbol" AS "종목명", CASE WHEN predicted_return > 2 THEN '매수' WHEN predicted_return <= -2 THEN '매도' ELSE '관망' END AS "권고",
    printf('%.0f', "Close") || '원' AS "내일 예상 종가", printf('%.3f', predicted_return) || '%' AS "내일 예상 수익률(%)", printf('%.1f', up_probability * 100) || '%' AS "상승확률(%)",
    printf('%.1f', (confidence_score * 0.5 + coalesce(history_direction_accuracy, 0.5) * 0.5) * 100) || '%' AS "예측 신뢰도",
    rk || '/' || n AS "횡단면 순위", {d(name="d")} FROM k""",
)
def simple_result(spark, sf):
    df = policy_input(spark, sf)
    df = df.withColumns({"symbol_name": F.col("Symbol"), "recommendation": policy.recommendation(df), "predicted_close": F.col("Close")})
    df = crosssection.cross_section_ranks(df, "up_probability", t.rows_per_date(spark, sf)).drop("rank_percentile")
    df = df.withColumn("공시 요약", F.col("Date"))
    out = scoring.simple_result(df).drop("_confidence", "_return")
    assert not scoring.missing_simple_columns(out.columns)
    return out.withColumnRenamed("공시 요약", "d")


@query(
    "pf35_detail_result",
    f"""WITH {PIN} SELECT {d()}, "Symbol", {r('round_even("Close" * 1e3, 0) / 1e3', "Close")}, {r("round_even(up_probability * 1e3, 0) / 1e3", "up_probability")},
    printf('%.1f', round_even(up_probability, 3) * 100) || '%' AS up_probability_display FROM pin""",
)
def detail_result(spark, sf):
    df = policy_input(spark, sf)
    latest = df.select("Date", "Symbol", "Close")
    preds = df.select("Date", "Symbol", "Close", "up_probability", "predicted_return", F.col("Close").alias("predicted_close"))
    out = scoring.detail_result(latest, preds)
    return out.select("Date", "Symbol", "Close", "up_probability", "up_probability_display")


@query("pf36_drop_empty_columns", f"""WITH {PIN} SELECT {d()}, "Symbol", {il("turnover_rank_daily = 1", "leader_confirmation_flag")} FROM pin""")
def drop_empty_columns(spark, sf):
    df = policy_input(spark, sf).select("Date", "Symbol", "leader_confirmation_flag")
    df = df.withColumns({"news_sentiment": F.lit(None).cast("double"), "target_up": F.lit("-")})
    return scoring.drop_empty_columns(df)


@query("pf44_digest_snapshot", f"""WITH {PIN} SELECT DISTINCT "Symbol", "Symbol" AS symbol_name, '-' AS "오늘 종목 이슈 한줄 요약", '-' AS "공시 요약", '-' AS "뉴스 요약", '-' AS "종합 판단", '-' AS "주의사항" FROM pin""")
def digest_snapshot(spark, sf):
    return scoring.digest_snapshot(policy_input(spark, sf)).distinct()


@query(
    "fn18_number_display",
    f"""WITH {PIN} SELECT {d()}, "Symbol", printf('%.1f', up_probability * 100) || '%' AS pct, format('{{:,.0f}}', foreign_net_buy / 1e8) || '억' AS amount,
    printf('%+.1f', predicted_return + 0.001) || '점' AS points, format('{{:,.0f}}', value_traded) || '원' AS price FROM pin""",
)
def number_display(spark, sf):
    return policy_input(spark, sf).select(
        "Date", "Symbol", percent_text("up_probability", 1, True).alias("pct"), amount_text("foreign_net_buy").alias("amount"),
        points_text(F.col("predicted_return") + 0.001).alias("points"), price_text("value_traded").alias("price"),
    )


@query(
    "ag03_history_accuracy",
    f"""WITH {HEADS} SELECT "Symbol", {r("avg(CASE WHEN (target_log_return > 0) = (predicted_log_return > 0) THEN 1.0 ELSE 0.0 END::DOUBLE)", "history_direction_accuracy")}
    FROM heads GROUP BY "Symbol" """,
)
def history_accuracy(spark, sf):
    return scoring.history_accuracy(head_predictions(spark, sf))


@query(
    "jn04_history_accuracy_join",
    f"""WITH {HEADS}, a AS (SELECT "Symbol", avg(CASE WHEN (target_log_return > 0) = (predicted_log_return > 0) THEN 1.0 ELSE 0.0 END::DOUBLE) AS v
      FROM heads WHERE sector = 'R1' GROUP BY 1) SELECT {d()}, heads."Symbol", {r("coalesce(v, 0.5)", "history_direction_accuracy")} FROM heads LEFT JOIN a USING ("Symbol")""",
)
def history_accuracy_join(spark, sf):
    df = head_predictions(spark, sf)
    accuracy = scoring.history_accuracy(df.where(F.col("sector") == "R1"))
    return scoring.add_history_accuracy(df, accuracy).select("Date", "Symbol", "history_direction_accuracy")


@query(
    "jn14_symbol_names",
    """SELECT 'S' || s_suppkey AS "Symbol", CASE WHEN s_suppkey % 3 <> 0 THEN s_name ELSE 'S' || s_suppkey END AS symbol_name FROM supplier""",
)
def symbol_names(spark, sf):
    symbols = t.strata(spark, sf).select("Symbol")
    return scoring.resolve_names(symbols, names(spark, sf)).select("Symbol", "symbol_name")


@query(
    "jn17_summary_merge",
    f"""WITH {PIN} SELECT {d()}, pin."Symbol", {r("confidence_score")}, s.name AS summary FROM pin LEFT JOIN strata s ON s."Symbol" = pin."Symbol" AND s.sector <> 'R2'""",
)
def summary_merge(spark, sf):
    df = policy_input(spark, sf).select("Date", "Symbol", "confidence_score")
    summary = t.strata(spark, sf).where(F.col("sector") != "R2")
    summary = summary.select("Symbol", F.col("name").alias("summary"), F.lit(0.0).alias("confidence_score"))
    return scoring.merge_summary(df, summary)
