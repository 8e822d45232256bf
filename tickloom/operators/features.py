"""Investor, event and flag features, and the whole feature matrix in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import flag, iflag, number, number_or, ratio
from tickloom.operators import crosssection as cs
from tickloom.operators import indicators as ind
from tickloom.params import CriteriaParams, FeatureParams

# Column aliases, source columns dropped after use, neutral fills and
# the columns that get a missing indicator.
CONTEXT_ALIASES = {
    "foreign_net_buy": ["foreign_net_buy", "외국인순매수", "ForeignNetBuy"],
    "institution_net_buy": ["institution_net_buy", "기관순매수", "InstitutionNetBuy"],
    "disclosure_score": ["disclosure_score", "공시점수", "DisclosureScore"],
    "news_sentiment": ["news_sentiment", "뉴스점수", "NewsSentiment"],
    "news_relevance_score": ["news_relevance_score", "뉴스관련도", "NewsRelevanceScore"],
    "news_impact_score": ["news_impact_score", "뉴스영향점수", "NewsImpactScore"],
    "news_article_count": ["news_article_count", "뉴스건수", "NewsArticleCount"],
}
DROPPED_SOURCES = [
    "개인순매수", "PersonalNetBuy", "외국인보유비중", "ForeignOwnershipRatio", "프로그램순매수",
    "ProgramTradingFlow", "시장구분", "MarketType", "거래소", "Venue", "세션", "Session", "상장일",
    "ListingDate", "상장후일수", "DaysSinceListing", "투자경보단계", "WarningLevel", "시장경보", "거래정지",
    "HaltFlag", "VI발동", "VIFlag", "VI횟수", "VICount", "단기과열종목", "ShortTermOverheatFlag", "공매도가능",
    "ShortSellFlag", "공매도잔고", "ShortSellBalance", "공매도비중", "ShortSellRatio", "공매도과열종목",
    "ShortSellOverheatFlag", "PBR", "PER", "ROE", "배당수익률", "DividendYield", "자사주취득", "BuybackFlag",
    "자사주소각", "ShareCancellationFlag", "밸류업공시", "ValueUpDisclosureFlag",
]
NEUTRAL_FILLS = {"rsi_14": 50.0, "stoch_k": 50.0, "stoch_d": 50.0, "macd": 0.0, "macd_signal": 0.0, "macd_hist": 0.0}
MISSING_INDICATORS = ["ma_120", "vol_60", "atr_14", "cci_20", "obv_change_5d"]


def resolve_context(df: DataFrame) -> DataFrame:
    """Canonical context columns from whichever alias the frame has, 0 where missing."""
    return df.withColumns({name: number_or(df, aliases, 0.0) for name, aliases in CONTEXT_ALIASES.items()})


def drop_sources(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in DROPPED_SOURCES if c in df.columns])


def rsi_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "rsi_pullback_buy_flag": flag(F.col("rsi_14").between(30.0, 35.0)),
            "rsi_overbought_sell_flag": flag(F.col("rsi_14") >= 70.0),
        }
    )


def flow_ratios(df: DataFrame) -> DataFrame:
    foreign, institution = F.col("foreign_net_buy"), F.col("institution_net_buy")
    both = foreign + institution
    return df.withColumns(
        {
            "foreign_buy_signal": flag(foreign > 0),
            "institution_buy_signal": flag(institution > 0),
            "smart_money_buy_signal": flag(both > 0),
            "foreign_buy_ratio": F.coalesce(ratio(foreign, "value_traded"), F.lit(0.0)),
            "institution_buy_ratio": F.coalesce(ratio(institution, "value_traded"), F.lit(0.0)),
            "smart_money_strength": F.coalesce(ratio(both, "value_traded"), F.lit(0.0)),
        }
    )


def news_signals(df: DataFrame) -> DataFrame:
    """Display-only: never a model feature."""
    relevance, sentiment = F.col("news_relevance_score"), F.col("news_sentiment")
    return df.withColumns(
        {
            "news_positive_signal": relevance * F.greatest(sentiment - 0.5, F.lit(0.0)) * 2.0,
            "news_negative_signal": relevance * F.greatest(0.5 - sentiment, F.lit(0.0)) * 2.0,
        }
    )


def investor_event_score(df: DataFrame) -> DataFrame:
    """Display-only composite of turnover, disclosure, news and flow."""
    return df.withColumn(
        "investor_event_score",
        0.35 * F.col("is_top_turnover_10")
        + 0.20 * F.col("disclosure_score")
        + 0.20 * F.col("news_positive_signal")
        + 0.25 * F.col("smart_money_buy_signal"),
    )


def price_limit(df: DataFrame, params: FeatureParams = FeatureParams()) -> Column:
    default = F.when(F.col("Date") < F.lit(params.price_limit_cutover), params.price_limit_before).otherwise(
        params.price_limit_after
    )
    for name in ("price_limit_pct", "PriceLimitPct"):
        if name in df.columns:
            return F.coalesce(number(name), default)
    return default


def limit_hits(df: DataFrame, params: FeatureParams = FeatureParams()) -> DataFrame:
    threshold = price_limit(df, params) - params.price_limit_slack
    up, down = F.col("daily_return") >= threshold, F.col("daily_return") <= -threshold
    return df.withColumns(
        {"limit_hit_up_flag": flag(up), "limit_hit_down_flag": flag(down), "limit_event_flag": flag(up | down)}
    )


def finish_features(df: DataFrame) -> DataFrame:
    """Missing indicators first, then neutral fills."""
    marked = df.withColumns(
        {f"{c}_missing": flag(F.col(c).isNull()) for c in MISSING_INDICATORS if c in df.columns}
    )
    return marked.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v)) for c, v in NEUTRAL_FILLS.items() if c in df.columns}
    )


def signal_flags(df: DataFrame, params: CriteriaParams = CriteriaParams()) -> DataFrame:
    """Threshold flags for close betting and medium-term judgement."""
    foreign = number_or(df, ["foreign_net_buy"], 0.0)
    institution = number_or(df, ["institution_net_buy"], 0.0)
    to_high = number_or(df, ["close_to_52w_high"], 0.0)
    overnight = number_or(df, ["nq_f_ret_1d"], 0.0)
    rsi = number_or(df, ["rsi_14"], 50.0)
    strong = params.high_conviction_net_buy
    distance = F.greatest(1.0 - to_high, F.lit(0.0))
    return df.withColumns(
        {
            "is_top_turnover_15": iflag(number_or(df, ["turnover_rank_daily"], 999.0) <= params.top_turnover_rank),
            "foreign_high_conviction_buy_flag": iflag(foreign >= strong),
            "institution_high_conviction_buy_flag": iflag(institution >= strong),
            "dual_high_conviction_buy_flag": iflag((foreign >= strong) & (institution >= strong)),
            "distance_to_52w_high": distance,
            "near_52w_high_flag": iflag(distance <= params.near_high_distance),
            "breakout_52w_flag": iflag(to_high >= 1.0),
            "nasdaq_tailwind_flag": iflag(overnight >= params.tailwind),
            "nasdaq_headwind_flag": iflag(overnight <= params.headwind),
            "rsi_buy_watch_flag": iflag(rsi.between(params.rsi_watch_low, params.rsi_watch_high)),
            "rsi_overbought_sell_flag": iflag(rsi >= params.rsi_overbought),
            "news_same_day_signal": iflag(number_or(df, ["news_article_count"], 0.0) > 0),
            "disclosure_same_day_signal": iflag(number_or(df, ["disclosure_score"], 0.0) > 0),
        }
    )


def build_features(
    bars: DataFrame,
    params: FeatureParams = FeatureParams(),
    group_rows: int | None = None,
) -> DataFrame:
    """All price, flow and event features of cleaned bars.

    What a date needs of its symbols is the bar itself and its return, so the turnover rank
    is taken while rows are narrow: a shuffle by Symbol for the returns, one by Date for the
    rank, and one back by Symbol under which every rolling column is computed. Per-date
    sums come back as broadcasts and prune to the narrow part.
    """
    df = ind.price_returns(resolve_context(bars))
    df = cs.leader_by_rank(cs.turnover_rank(df, group_rows))
    df = ind.number_bars(df)
    df = ind.lagged_returns(df, params.return_lags)
    df = ind.moving_averages(df, params.mean_windows)
    df = ind.rolling_volatility(df, params.vol_windows)
    df = ind.volume_ratio(df)
    df = ind.technical_block(df, params)
    df = ind.year_high(df)
    for flow in ("foreign_net_buy", "institution_net_buy"):
        df = ind.flow_sums(ind.rolling_zscore(df, flow, f"{flow}_z20"), flow)
    df = ind.next_day_target(df)
    df = rsi_flags(flow_ratios(news_signals(df)))
    df = investor_event_score(limit_hits(df, params))
    return finish_features(drop_sources(df)).drop("bar_no")


def signal_features(df: DataFrame, params: CriteriaParams = CriteriaParams(), group_rows: int | None = None) -> DataFrame:
    """Later signal layer: rank (kept or computed densely), flags and leader returns."""
    return cs.leader_returns(signal_flags(cs.dense_turnover_rank(df, group_rows), params), params)


def feature_matrix(
    bars: DataFrame,
    feature: FeatureParams = FeatureParams(),
    criteria: CriteriaParams = CriteriaParams(),
    group_rows: int | None = None,
    include_unlabeled: bool = False,
) -> DataFrame:
    """Features, regime and signals; the unlabeled last bar is dropped unless asked for."""
    df = ind.market_regime(build_features(bars, feature, group_rows))
    df = signal_features(df, criteria, group_rows)
    return df if include_unlabeled else df.where(F.col("target_log_return").isNotNull())
