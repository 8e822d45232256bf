"""From head predictions to scored, ranked and labelled prediction frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import policy
from tickloom.functions.numeric import clip, np_round, number, percent_text, price_text
from tickloom.operators.crosssection import cross_section_ranks
from tickloom.operators.ranking import percentile_rank
from tickloom.params import CriteriaParams, SignalParams
from tickloom.session import written

# Columns carried from features to predictions, and the public result columns.
CARRIED = [
    "target_log_return", "vol_ratio_20", "value_traded", "turnover_rank_daily", "foreign_net_buy",
    "institution_net_buy", "nq_f_ret_1d", "rsi_14", "near_52w_high_flag", "breakout_52w_flag",
    "leader_confirmation_flag", "is_top_turnover_15", "dual_high_conviction_buy_flag",
    "distance_to_52w_high", "nasdaq_tailwind_flag", "nasdaq_headwind_flag", "rsi_buy_watch_flag",
    "news_same_day_signal", "disclosure_same_day_signal", "ks11_ret_1d", "market_type",
]
SIMPLE_REQUIRED = ["종목코드", "종목명", "권고", "내일 예상 종가", "내일 예상 수익률(%)", "상승확률(%)", "예측 신뢰도"]
SIMPLE_RANKS = ["횡단면 순위", "랭킹 백분위"]
SIMPLE_OPTIONAL = ["공시 요약", "뉴스 요약"]
SIMPLE_IMPACT = ["뉴스/공시 영향 점수", "뉴스/공시 영향 요약", "뉴스/공시 영향 참고"]
DIGEST_COLUMNS = ["Symbol", "symbol_name", "오늘 종목 이슈 한줄 요약", "공시 요약", "뉴스 요약", "종합 판단", "주의사항"]
PRUNABLE = [
    "foreign_net_buy", "institution_net_buy", "disclosure_score", "news_sentiment", "news_relevance_score",
    "news_impact_score", "news_article_count", "rsi_pullback_buy_flag", "rsi_overbought_sell_flag",
    "foreign_buy_signal", "institution_buy_signal", "smart_money_buy_signal", "foreign_buy_ratio",
    "institution_buy_ratio", "smart_money_strength", "foreign_net_buy_z20", "institution_net_buy_z20",
    "foreign_net_buy_3d", "foreign_net_buy_5d", "institution_net_buy_3d", "institution_net_buy_5d",
    "news_positive_signal", "news_negative_signal", "near_52w_high_flag", "breakout_52w_flag",
    "leader_confirmation_flag", "investor_event_score", "target_up",
]
EMPTY_TEXTS = ["", "-", "nan", "NaN", "None", "<NA>", "NA", "null"]


def weighted_score(return_weight, prob_weight, penalty) -> Column:
    return (
        F.col("norm_return") * return_weight
        + F.col("up_probability") * prob_weight
        - F.col("uncertainty_score") * penalty
    )


def _measured(heads: DataFrame) -> DataFrame:
    # Ranked twice and returned: written once instead of computed three times, by column, so that a rank reads its own.
    return written(heads, "heads").withColumns(
        {
            "predicted_return": F.expm1("predicted_log_return") * 100.0,
            "predicted_close": F.col("Close") * F.exp("predicted_log_return"),
            "uncertainty_width": F.greatest(F.col("quantile_high") - F.col("quantile_low"), F.lit(0.0)),
            "uncertainty_band": F.format_string("%.3f ~ %.3f", F.col("quantile_low"), F.col("quantile_high")),
            "event_boost_score": F.lit(0.0),
        }
    )


def _ranked(df: DataFrame, s: SignalParams) -> DataFrame:
    out = percentile_rank(df, "uncertainty_width", "uncertainty_score", ("Date", "Symbol"))
    out = percentile_rank(out, "predicted_log_return", "norm_return", ("Date", "Symbol"))
    out = out.withColumn("signal_score", weighted_score(s.return_weight, s.up_prob_weight, s.uncertainty_penalty))
    return out.withColumn("signal_label", policy.signal_label())


def prediction_frame(heads: DataFrame, s: SignalParams = SignalParams()) -> DataFrame:
    """``heads`` carries Date, Symbol, Close, market_regime, predicted_log_return,
    up_probability and the three quantiles. Percentile scores rank the whole frame."""
    return _ranked(_measured(heads), s)


def scored_frame(
    heads: DataFrame,
    external_coverage: float = 1.0,
    investor_coverage: float = 1.0,
    min_liquidity: float = 0.0,
    s: SignalParams = SignalParams(),
    c: CriteriaParams = CriteriaParams(),
    group_rows: int | None = None,
) -> DataFrame:
    """Prediction frame with carried columns, coverage constants, boost, label and ranks."""
    out = _measured(heads)
    # Before the rows travel to their ranks: two numbers are smaller than the columns they come from.
    out = out.withColumns({"_boost": policy.event_boost(out, c), "_headwind": policy.headwind_score(heads)})
    out = _ranked(out, s).withColumns(
        {
            "external_coverage_ratio": F.lit(float(external_coverage)),
            "investor_coverage_ratio": F.lit(float(investor_coverage)),
            "min_liquidity_threshold": F.lit(float(min_liquidity)),
            "market_headwind_score": F.col("_headwind"),
        }
    )
    out = policy.with_event_boost(out, c, F.col("_boost")).withColumn("signal_label", policy.signal_label()).drop("_boost", "_headwind")
    return cross_section_ranks(out, "signal_score", group_rows)


def rescore(df: DataFrame, weights: tuple[float, float, float], gate: str, group_rows: int | None = None) -> DataFrame:
    """Apply tuned weights: score, label, gate status and ranks again."""
    out = df.drop("cross_section_rank", "rank_percentile", "rank_universe_size").withColumn(
        "signal_score", weighted_score(*weights) + F.coalesce("event_boost_score", F.lit(0.0))
    )
    out = out.withColumns({"signal_label": policy.signal_label(), "coverage_gate_status": F.lit(gate)})
    return cross_section_ranks(out, "signal_score", group_rows)


def history_accuracy(oof: DataFrame) -> DataFrame:
    hit = (F.coalesce(F.col("target_log_return") > 0, F.lit(False))) == (
        F.coalesce(F.col("predicted_log_return") > 0, F.lit(False))
    )
    return oof.groupBy("Symbol").agg(F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("history_direction_accuracy"))


def add_history_accuracy(df: DataFrame, accuracy: DataFrame) -> DataFrame:
    out = df.join(accuracy, "Symbol", "left")
    return out.withColumn("history_direction_accuracy", F.coalesce("history_direction_accuracy", F.lit(0.5)))


def ticker_of(symbol: str | Column) -> Column:
    c = F.col(symbol) if isinstance(symbol, str) else symbol
    return F.lpad(F.split_part(c.cast("string"), F.lit("."), F.lit(1)), 6, "0")


def resolve_names(df: DataFrame, names: DataFrame, symbol: str = "Symbol", name: str = "symbol_name") -> DataFrame:
    """Name by symbol, then by six-digit ticker, else the symbol itself. ``names`` has
    Ticker, Symbol and Name with one row per ticker."""
    by_symbol = names.groupBy("Symbol").agg(F.max_by("Name", "Ticker").alias("_a")).withColumnRenamed("Symbol", symbol)
    by_ticker = names.groupBy("Ticker").agg(F.min_by("Name", "Symbol").alias("_b")).withColumnRenamed("Ticker", "_ticker")
    out = df.withColumn("_ticker", ticker_of(symbol))
    out = out.join(by_symbol, symbol, "left").join(by_ticker, "_ticker", "left")
    named = F.coalesce(F.nullif("_a", F.lit("")), F.nullif("_b", F.lit("")), F.col(symbol).cast("string"))
    return out.withColumn(name, named).drop("_a", "_b", "_ticker")


def finalize_latest(df: DataFrame, names: DataFrame, c=CriteriaParams(), s=SignalParams()) -> DataFrame:
    out = resolve_names(df, names)
    doubt = F.coalesce("uncertainty_score", F.lit(1.0))
    out = out.withColumn("confidence_score", clip(1.0 - doubt, 0.0, 1.0))
    return policy.policy_frame(out, c, s)


def simple_result(df: DataFrame) -> DataFrame:
    """Public result table. Row order is a property of the written file: sort by
    ``_confidence`` and ``_return`` descending before export (see ``export_simple``)."""
    confidence = F.coalesce(number("confidence_score"), F.lit(0.5)) * 0.5 + F.coalesce(
        number("history_direction_accuracy"), F.lit(0.5)
    ) * 0.5
    columns = {
        "종목코드": F.regexp_replace("Symbol", r"\..*$", ""),
        "종목명": F.col("symbol_name"),
        "권고": F.col("recommendation"),
        "내일 예상 종가": price_text("predicted_close"),
        "내일 예상 수익률(%)": percent_text("predicted_return", 3),
        "상승확률(%)": percent_text("up_probability", 1, True) if "up_probability" in df.columns else F.lit("50.0%"),
        "예측 신뢰도": percent_text(confidence, 1, True),
    }
    if "cross_section_rank" in df.columns:
        rank = F.col("cross_section_rank").cast("long").cast("string")
        size = F.col("rank_universe_size").cast("long") if "rank_universe_size" in df.columns else F.lit(None).cast("long")
        text = F.when(size > 0, F.concat_ws("/", rank, size.cast("string"))).otherwise(rank)
        columns["횡단면 순위"] = F.when(rank.isNotNull(), text).otherwise("-")
    if "rank_percentile" in df.columns:
        columns["랭킹 백분위"] = percent_text("rank_percentile", 1, True)
    for name in (*SIMPLE_OPTIONAL, *SIMPLE_IMPACT):
        if name in df.columns:
            columns[name] = F.col(name)
    return df.select(
        *[c.alias(name) for name, c in columns.items()],
        number("confidence_score").alias("_confidence"),
        number("predicted_return").alias("_return"),
    )


def export_simple(df: DataFrame) -> DataFrame:
    ordered = simple_result(df).orderBy(F.col("_confidence").desc_nulls_last(), F.col("_return").desc_nulls_last())
    return ordered.drop("_confidence", "_return")


def missing_simple_columns(columns: list[str]) -> list[str]:
    return [c for c in SIMPLE_REQUIRED if c not in columns]


def detail_result(latest: DataFrame, predictions: DataFrame) -> DataFrame:
    """Latest feature rows with the prediction columns they lack, rounded, plus display text."""
    keys = ["Date", "Symbol"]
    extra = [c for c in predictions.columns if c not in latest.columns and c != "Close"]
    joined = latest.join(predictions.select(*keys, *extra), keys, "left")
    doubles = [f.name for f in joined.schema.fields if f.dataType.typeName() in ("double", "float")]
    rounded = joined.withColumns({c: np_round(c, 3) for c in doubles})
    display = {"내일 예상 종가": price_text("predicted_close"), "상승확률(%)": percent_text("up_probability", 1, True)}
    for name, digits, unit in (
        ("predicted_return", 3, False),
        ("up_probability", 1, True),
        ("confidence_score", 1, True),
        ("history_direction_accuracy", 1, True),
    ):
        if name in rounded.columns:
            display[f"{name}_display"] = percent_text(name, digits, unit)
    return rounded.withColumns(display)


def drop_empty_columns(df: DataFrame, candidates: list[str] = PRUNABLE) -> DataFrame:
    """Drop optional columns without a single value; one aggregation pass decides."""
    present = [c for c in candidates if c in df.columns]
    if not present:
        return df
    kinds = dict(df.dtypes)

    def filled(c: str) -> Column:
        if kinds[c] == "string":
            return F.count(F.when(~F.trim(F.col(c)).isin(*EMPTY_TEXTS), 1))
        return F.count(F.col(c))

    counts = df.agg(*[filled(c).alias(c) for c in present]).first().asDict()
    return df.drop(*[c for c, n in counts.items() if n == 0])


def digest_snapshot(df: DataFrame) -> DataFrame:
    def pick(c: str) -> Column:
        if c in df.columns:
            return F.col(f"`{c}`")
        return F.col("Symbol").alias(c) if c == "symbol_name" else F.lit("-").alias(c)

    return df.select(*[pick(c) for c in DIGEST_COLUMNS])


def merge_summary(df: DataFrame, summary: DataFrame) -> DataFrame:
    """Add the columns of a per-symbol summary that the frame does not have."""
    extra = [c for c in summary.columns if c not in df.columns]
    return df.join(summary.select("Symbol", *extra), "Symbol", "left")  # one row per symbol: Spark splits a skewed left side
