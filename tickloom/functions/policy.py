"""Signal policy as column expressions over a prediction frame.

Only the predicted return decides the recommendation. A column that the frame does not
have falls back to its neutral default; a missing value fails every comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import amount_text, flag, np_round, number, number_or
from tickloom.params import CriteriaParams, PortfolioParams, SignalParams

C, S = CriteriaParams(), SignalParams()

# Labels, flag names, event weights and phrases of the policy.
BUY, SELL, HOLD = "매수", "매도", "관망"
CONFIDENCE_LABELS = ((0.80, "신뢰도 매우 높음"), (0.67, "신뢰도 높음"), (0.34, "신뢰도 보통"))
CONFIDENCE_LOW, CONFIDENCE_UNKNOWN = "신뢰도 낮음", "신뢰도 보통"
SIZE_MEDIUM, SIZE_SMALL, SIZE_NONE = "중간", "소액", "관망"
ACTION_HALT, ACTION_NEW, ACTION_WATCH, ACTION_CUT, ACTION_HOLD = "거래보류", "신규매수", "관심관찰", "비중축소", "관망"
GATE_STOP, GATE_DEFENSIVE, GATE_CAREFUL, GATE_NORMAL = "거래중단", "보수모드", "체결주의", "정상"
CLOSE_BET_LABELS = ("관심", "경계", "중립")
SIGNAL_LABELS = (
    (0.25, "strong_negative"),
    (0.45, "weak_negative"),
    (0.55, "neutral"),
    (0.75, "weak_positive"),
)
SIGNAL_TOP = "strong_positive"
EVENT_WEIGHTS = {
    "top3_turnover": 0.05,
    "top_turnover": 0.04,
    "dual_buy": 0.04,
    "strong_dual_buy": 0.06,
    "turnover_and_strong_dual_buy": 0.08,
    "leader_confirmed": 0.05,
    "year_high": 0.03,
    "rsi_pullback": 0.02,
    "rsi_overbought": -0.08,
    "overnight_up": 0.03,
    "overnight_strong": 0.06,
    "overnight_weak": -0.12,
}


def kept(df: DataFrame, name: str, default: float | None) -> Column:
    """The column as a number with missing values kept; the default only when the column is absent."""
    return number(name) if name in df.columns else F.lit(default).cast("double")


def coverage_halted(df: DataFrame) -> Column:
    if "coverage_gate_status" not in df.columns:
        return F.lit(False)
    return F.lower(F.coalesce(F.col("coverage_gate_status"), F.lit(""))) == "halt"


def event_boost(df: DataFrame, c: CriteriaParams = C) -> Column:
    rank = number_or(df, ["turnover_rank_daily"], 999.0)
    foreign, institution = number_or(df, ["foreign_net_buy"], 0.0), number_or(df, ["institution_net_buy"], 0.0)
    overnight, rsi = number_or(df, ["nq_f_ret_1d"], 0.0), number_or(df, ["rsi_14"], 50.0)
    top = rank <= c.top_turnover_rank
    strong = (foreign >= c.high_conviction_net_buy) & (institution >= c.high_conviction_net_buy)
    near, broke = number_or(df, ["near_52w_high_flag"], 0.0), number_or(df, ["breakout_52w_flag"], 0.0)
    events = {
        "top3_turnover": rank <= 3,
        "top_turnover": top,
        "dual_buy": (foreign > 0) & (institution > 0),
        "strong_dual_buy": strong,
        "turnover_and_strong_dual_buy": top & strong,
        "leader_confirmed": number_or(df, ["leader_confirmation_flag"], 0.0) > 0,
        "year_high": (near > 0) | (broke > 0),
        "rsi_pullback": rsi.between(c.rsi_watch_low, c.rsi_watch_high),
        "rsi_overbought": rsi >= c.rsi_overbought,
        "overnight_up": overnight > 0,
        "overnight_strong": overnight >= c.tailwind,
        "overnight_weak": overnight <= c.headwind,
    }
    total = F.lit(0.0)
    for name, happened in events.items():
        total = total + flag(happened) * EVENT_WEIGHTS[name]
    return np_round(total, 6)


def with_event_boost(df: DataFrame, c: CriteriaParams = C, boost: Column | None = None) -> DataFrame:
    """Add the boost to the score; a boost already inside the score is taken out first.
    ``boost`` is given where it has been worked out from the columns before."""
    boost = event_boost(df, c) if boost is None else boost
    if "signal_score" not in df.columns:
        return df.withColumn("event_boost_score", boost)
    earlier = number_or(df, ["event_boost_score"], 0.0)
    base = F.coalesce(number("signal_score"), F.lit(0.0))
    return df.withColumns({"signal_score": base - earlier + boost, "event_boost_score": boost})


def recommendation(df: DataFrame, s: SignalParams = S) -> Column:
    expected = kept(df, "predicted_return", None)
    return F.when(expected > s.buy_above_pct, BUY).when(expected <= s.sell_at_or_below_pct, SELL).otherwise(HOLD)


def confidence_label(df: DataFrame) -> Column:
    value = kept(df, "confidence_score", None)
    label = F.when(value.isNull(), CONFIDENCE_UNKNOWN)
    for bound, text in CONFIDENCE_LABELS:
        label = label.when(value >= bound, text)
    return label.otherwise(CONFIDENCE_LOW)


def risk_conditions(df: DataFrame, default_liquidity: float = PortfolioParams().min_value_traded) -> dict[str, Column]:
    stated = number_or(df, ["min_liquidity_threshold"], 0.0)
    needed = F.when(stated <= 0, default_liquidity).otherwise(stated)
    return {
        "COVERAGE_HALT": coverage_halted(df),
        "HIGH_UNCERTAINTY": kept(df, "uncertainty_score", 0.0) >= 0.75,
        "LOW_UP_PROB": kept(df, "up_probability", 0.0) < 0.5,
        "LOW_HISTORY_ACC": kept(df, "history_direction_accuracy", 0.5) < 0.45,
        "LOW_LIQUIDITY": kept(df, "value_traded", 0.0) < needed,
        "EXTERNAL_FEATURE_MISSING": kept(df, "external_coverage_ratio", 1.0) < 0.6,
        "DATA_COVERAGE_LOW": kept(df, "investor_coverage_ratio", 1.0) < 0.34,
        "MARKET_HEADWIND": kept(df, "market_headwind_score", 0.0) <= -1,
    }


def risk_flag(df: DataFrame) -> Column:
    joined = F.concat_ws("|", *[F.when(cond, name) for name, cond in risk_conditions(df).items()])
    return F.when(joined == "", "NORMAL").otherwise(joined)


def position_size(df: DataFrame, risk: Column) -> Column:
    value = F.coalesce(kept(df, "confidence_score", None), F.lit(0.5))
    blocked = risk.contains("DATA_COVERAGE_LOW") | risk.contains("LOW_LIQUIDITY")
    careful = risk.contains("HIGH_UNCERTAINTY") | risk.contains("MARKET_HEADWIND")
    return (
        F.when(blocked, SIZE_NONE)
        .when(careful, SIZE_SMALL)
        .when(value >= 0.80, SIZE_MEDIUM)
        .when(value >= 0.6, SIZE_SMALL)
        .otherwise(SIZE_NONE)
    )


def portfolio_action(df: DataFrame, action: Column, size: Column) -> Column:
    return (
        F.when(coverage_halted(df), ACTION_HALT)
        .when((action == BUY) & (size == SIZE_MEDIUM), ACTION_NEW)
        .when(action == BUY, ACTION_WATCH)
        .when(action == SELL, ACTION_CUT)
        .otherwise(ACTION_HOLD)
    )


def trading_gate(risk: Column) -> Column:
    return (
        F.when(risk.contains("COVERAGE_HALT"), GATE_STOP)
        .when(risk.contains("MARKET_HEADWIND") | risk.contains("DATA_COVERAGE_LOW"), GATE_DEFENSIVE)
        .when(risk.contains("LOW_LIQUIDITY"), GATE_CAREFUL)
        .otherwise(GATE_NORMAL)
    )


def prediction_reason(df: DataFrame, c: CriteriaParams = C) -> Column:
    rank = kept(df, "turnover_rank_daily", 999.0)
    foreign, institution = kept(df, "foreign_net_buy", 0.0), kept(df, "institution_net_buy", 0.0)
    overnight, rsi = kept(df, "nq_f_ret_1d", 0.0), kept(df, "rsi_14", None)
    leaders = [kept(df, f"leader_{k}_return", None) for k in (1, 2, 3)]
    strong = (foreign >= c.high_conviction_net_buy) & (institution >= c.high_conviction_net_buy)
    # The phrases of a prediction reason, in display order.
    phrases = [
        (rank <= c.top_turnover_rank, F.lit(f"종배수급: 거래대금 상위권, 거래대금 상위 {c.top_turnover_rank}위 종목입니다")),
        (
            strong,
            F.concat(
                F.lit("수급조건: 외국인 "), amount_text(foreign), F.lit(", 기관 "), amount_text(institution),
                F.lit("로 각각 1,000억 이상 순매수입니다"),
            ),
        ),
        (
            (leaders[0] > 0) & (leaders[1] > 0) & (leaders[2] > 0),
            F.lit("주도주확인: 1등주 상승과 함께 2·3등주 동반 상승이 확인됩니다"),
        ),
        (kept(df, "breakout_52w_flag", 0.0) > 0, F.lit("추세조건: 52주 신고가 종목입니다")),
        (overnight >= c.tailwind, F.lit("해외조건: 나스닥 선물 +1% 이상으로 종배 우호 환경입니다")),
        (overnight <= c.headwind, F.lit("해외조건: 나스닥 선물 -1% 이하로 리스크 회피(매도) 구간입니다")),
        (rsi.between(c.rsi_watch_low, c.rsi_watch_high), F.lit("중장기조건: RSI 30~35 구간으로 분할매수 관찰 구간입니다")),
        (rsi >= c.rsi_overbought, F.lit("중장기조건: RSI 70 이상으로 이익실현/매도 우선 구간입니다")),
    ]
    return F.concat_ws(" / ", *[F.when(cond, text) for cond, text in phrases])


def close_bet_score(df: DataFrame, c: CriteriaParams = C) -> Column:
    foreign, institution = kept(df, "foreign_net_buy", None), kept(df, "institution_net_buy", None)
    both_known = foreign.isNotNull() & institution.isNotNull()
    overnight = kept(df, "nq_f_ret_1d", None)
    high = (kept(df, "breakout_52w_flag", 0.0) > 0) | (kept(df, "near_52w_high_flag", 0.0) > 0)
    # Weights of the close-betting score.
    parts = [
        (kept(df, "turnover_rank_daily", None) <= c.top_turnover_rank, 0.30),
        (both_known & (foreign >= c.high_conviction_net_buy), 0.15),
        (both_known & (institution >= c.high_conviction_net_buy), 0.15),
        (high, 0.15),
        (overnight >= c.tailwind, 0.20),
        (overnight <= c.headwind, -0.35),
        (kept(df, "leader_confirmation_flag", 0.0) > 0, 0.15),
    ]
    total = F.lit(0.0)
    for happened, weight in parts:
        total = total + flag(happened) * weight
    return np_round(total, 4)


def close_bet_label(score: Column) -> Column:
    good, bad, neutral = CLOSE_BET_LABELS
    return F.when(score >= 0.45, good).when(score < 0, bad).otherwise(neutral)


def policy_frame(df: DataFrame, c: CriteriaParams = C, s: SignalParams = S) -> DataFrame:
    """Boost, labels, flags, sizes, actions, gate, close-bet score and reason."""
    out = with_event_boost(df, c)
    out = out.withColumns({"recommendation": recommendation(out, s), "risk_flag": risk_flag(out)})
    out = out.withColumns(
        {"position_size_hint": position_size(out, F.col("risk_flag")), "confidence_label": confidence_label(out)}
    )
    out = out.withColumns(
        {
            "portfolio_action": portfolio_action(out, F.col("recommendation"), F.col("position_size_hint")),
            "trading_gate": trading_gate(F.col("risk_flag")),
            "jongbae_score": close_bet_score(out, c),
            "prediction_reason": prediction_reason(out, c),
        }
    )
    return out.withColumn("jongbae_signal", close_bet_label(F.col("jongbae_score")))


def signal_label(score: str | Column = "signal_score") -> Column:
    """Right-closed bins."""
    value = F.col(score) if isinstance(score, str) else score
    label = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, text in SIGNAL_LABELS:
        label = label.when(value <= bound, text)
    return label.otherwise(SIGNAL_TOP)


def headwind_score(df: DataFrame) -> Column:
    return F.when(number_or(df, ["nq_f_ret_1d"], 0.0) < -0.01, -1.0).otherwise(0.0)


def coverage_gate(external: Column, investor: Column, p: PortfolioParams = PortfolioParams()) -> Column:
    halted = F.lit(False)
    if p.min_external_coverage > 0:
        halted = halted | (external < p.min_external_coverage)
    if p.min_investor_coverage > 0:
        halted = halted | (investor < p.min_investor_coverage)
    thin = (external < max(0.7, p.min_external_coverage)) | (investor < max(0.7, p.min_investor_coverage))
    return F.when(halted, "halt").when(thin, "caution").otherwise("normal")
