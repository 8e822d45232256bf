"""Close-near-high screener: ranks by traded value, indicators, points, candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.numeric import number, ratio
from tickloom.operators.ranking import top_per_group
from tickloom.operators.skew import first_per_key
from tickloom.params import ScreenerParams

P = ScreenerParams()

# Grades and their cut-offs, points and reasons of the score.
GRADES = ((100, "강력 후보"), (80, "후보"), (60, "관찰"))
GRADE_EXCLUDED = "추천 제외"
RANK_POINTS = ((5, 30), (10, 20), (20, 10))
POINTS = {
    "52w_high": (100, "52주 종가 기준 신고가"),
    "near_52w_high": (70, "52주 종가 기준 근접 신고가"),
    "20d_high": (40, "20일 종가 기준 신고가"),
    "near_20d_high": (25, "20일 종가 기준 근접 신고가"),
    "above_ma5": (10, "5일선 위"),
    "above_ma20": (10, "20일선 위"),
    "volume_spike": (20, "거래량 급증"),
    "long_bearish": (-30, "장대음봉 패널티"),
}
FORCED_FLOOR = 100
RENAMES = {"Date": "date", "Symbol": "symbol_raw", "Open": "open", "High": "high", "Low": "low", "Close": "close", "Volume": "volume"}


def standardize(bars: DataFrame, symbols: DataFrame) -> DataFrame:
    """Lower-case columns, six-digit symbol, name, positive prices, one row per day.
    ``symbols`` has Symbol and Name."""
    raw = bars.withColumnsRenamed(RENAMES)
    code = F.upper(F.trim("symbol_raw"))
    typed = raw.withColumns(
        {"symbol_raw": code, "date": F.col("date").try_cast("date"), **{c: number(c) for c in ("open", "high", "low", "close", "volume")}}
    )
    # Symbols that are no six-digit codes keep their full text.
    short = F.split_part("symbol_raw", F.lit("."), F.lit(1))
    typed = typed.withColumn("symbol", F.when(F.length(short) < 6, F.lpad(short, 6, "0")).otherwise(short))
    valid = typed.where(
        F.col("date").isNotNull() & (F.least("open", "high", "low", "close") > 0) & (F.col("volume") >= 0)
        & F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull()
    )
    names = symbols.select(F.upper(F.trim("Symbol")).alias("symbol_raw"), F.trim("Name").alias("_name")).dropDuplicates(["symbol_raw"])
    named = valid.join(names, "symbol_raw", "left").withColumn("name", F.coalesce("_name", "symbol")).drop("_name")
    out = named.withColumn("trade_value", F.col("close") * F.col("volume"))
    return first_per_key(out, ["symbol", "date"], [F.col("symbol_raw")])


def trade_value_rank(df: DataFrame) -> DataFrame:
    """Rank of traded value on the latest date, put on every row of the symbol."""
    value = F.coalesce(number("trade_value"), F.col("close") * F.col("volume")) if "trade_value" in df.columns else F.col("close") * F.col("volume")
    out = df.withColumn("trade_value", value)
    last = out.agg(F.max("date").alias("date"))
    latest = out.join(F.broadcast(last), "date", "left_semi").select("symbol", "trade_value")  # one row
    from tickloom.operators.ranking import ordinal_rank

    ranked = ordinal_rank(latest, [], [F.col("trade_value").desc_nulls_last(), F.col("symbol")], "trade_value_rank")
    return out.join(ranked.select("symbol", "trade_value_rank"), "symbol", "left")


def top_by_trade_value(df: DataFrame, n: int = P.top_value_count) -> DataFrame:
    """Rows of the n symbols with the highest traded value on the latest date. Only those
    symbols enter the windows that follow."""
    last = df.agg(F.max("date").alias("date"))
    latest = df.join(F.broadcast(last), "date", "left_semi").select("symbol", "trade_value")  # one row
    best = latest.orderBy(F.col("trade_value").desc(), F.col("symbol")).limit(n)
    ranked = best.withColumn(
        "trade_value_rank", F.row_number().over(Window.orderBy(F.col("trade_value").desc(), F.col("symbol")))  # n rows
    )
    return df.join(F.broadcast(ranked.select("symbol", "trade_value_rank")), "symbol")


def screener_indicators(df: DataFrame, p: ScreenerParams = P) -> DataFrame:
    """History length, averages, highs, volume change and candle shape per symbol."""
    w = Window.partitionBy("symbol").orderBy("date")
    back = lambda n: w.rowsBetween(-(n - 1), 0)
    out = df.withColumns(
        {
            "history_days": F.row_number().over(w),
            **{f"ma{n}": F.avg("close").over(back(n)) for n in p.mean_windows},
            "close_20d_high": F.max("close").over(back(p.short_high)),
            "close_52w_high": F.max("close").over(back(p.long_high)),
            "_volume": F.avg("volume").over(w.rowsBetween(-20, -1)),
        }
    )
    c, body = F.col("close"), (F.col("open") - F.col("close")) / F.col("open")
    out = out.withColumn("volume_change_rate", F.coalesce(ratio("volume", "_volume"), F.lit(0.0)))
    return out.withColumns(
        {
            "is_history_sufficient": F.col("history_days") >= p.min_history,
            "is_20d_high": c >= F.col("close_20d_high"),
            "is_52w_high": c >= F.col("close_52w_high"),
            "is_near_20d_high": c >= F.col("close_20d_high") * p.near_high,
            "is_near_52w_high": c >= F.col("close_52w_high") * p.near_high,
            "is_volume_spike": F.col("volume_change_rate") >= p.volume_spike,
            "is_bullish": c > F.col("open"),
            "is_long_bearish": (c < F.col("open")) & (body >= 0.03),
            "is_close_near_high": c >= F.col("high") - (F.col("high") - F.col("low")) * 0.25,
        }
    ).drop("_volume")


def latest_rows(df: DataFrame) -> DataFrame:
    return first_per_key(df, ["symbol"], [F.col("date")], last=True)


def grade(score: Column) -> Column:
    label = F.when(score >= GRADES[0][0], GRADES[0][1])
    for bound, text in GRADES[1:]:
        label = label.when(score >= bound, text)
    return label.otherwise(GRADE_EXCLUDED)


def score_candidates(df: DataFrame, theme_score: int = 0, p: ScreenerParams = P) -> DataFrame:
    """Points by name, reasons, final score and grade of each latest row."""
    rank = F.col("trade_value_rank")
    rank_points = F.lit(0)
    for bound, points in reversed(RANK_POINTS):
        rank_points = F.when((rank >= 1) & (rank <= bound), points).otherwise(rank_points)
    high, near = F.col("is_52w_high"), F.col("is_near_52w_high")
    holds = {
        "52w_high": high,
        "near_52w_high": ~high & near,
        "20d_high": F.col("is_20d_high"),
        "near_20d_high": ~F.col("is_20d_high") & F.col("is_near_20d_high"),
        "above_ma5": F.col("close") > F.col("ma5"),
        "above_ma20": F.col("close") > F.col("ma20"),
        "volume_spike": F.col("is_volume_spike"),
        "long_bearish": F.col("is_long_bearish"),
    }

    def entry(name: Column | str, points: Column, reason: Column) -> Column:
        key = F.lit(name) if isinstance(name, str) else name
        return F.struct(key.alias("name"), points.cast("int").alias("points"), reason.alias("reason"))

    ranked = F.when(rank_points > 0, entry("trade_value_rank", rank_points, F.concat(F.lit("거래대금 "), rank, F.lit("위"))))
    parts = [F.when(holds[n], entry(n, F.lit(points), F.lit(reason))) for n, (points, reason) in POINTS.items()]
    out = df.withColumn("_parts", F.array_compact(F.array(ranked, *parts)))
    technical = F.aggregate("_parts", F.lit(0), lambda acc, x: acc + x["points"])
    out = out.withColumns(
        {
            "score_breakdown": F.map_from_arrays(F.transform("_parts", lambda x: x["name"]), F.transform("_parts", lambda x: x["points"])),
            "reasons": F.transform("_parts", lambda x: x["reason"]),
            "technical_score": technical,
            "theme_score": F.lit(theme_score),
            "is_forced_candidate": F.coalesce(F.col("is_history_sufficient") & (rank <= p.top_value_count) & (high | near), F.lit(False)),
        }
    ).drop("_parts")
    total = F.col("technical_score") + F.col("theme_score")
    out = out.withColumn("final_score", F.when(F.col("is_forced_candidate"), F.greatest(total, F.lit(FORCED_FLOOR))).otherwise(total))
    return out.withColumn(
        "recommendation_grade", F.when(F.col("is_history_sufficient"), grade(F.col("final_score"))).otherwise(GRADE_EXCLUDED)
    )


def select_candidates(scored: DataFrame, min_score: int | None = None, p: ScreenerParams = P) -> DataFrame:
    """The best n candidates at or near a 52-week high."""
    rows = scored.where(F.col("recommendation_grade") != GRADE_EXCLUDED)
    if min_score is not None:
        rows = rows.where(F.col("final_score") >= min_score)
    rows = rows.where(F.col("is_52w_high") | F.col("is_near_52w_high"))
    order = [F.col("final_score").desc(), F.col("trade_value_rank").asc_nulls_last(), F.col("volume_change_rate").desc(), F.col("symbol")]
    best = rows.orderBy(*order).limit(p.top_n)
    return best.withColumns(
        {
            "recommendation_rank": F.row_number().over(Window.orderBy(*order)),  # n rows
            "first_buy_ratio": F.lit(p.first_buy_ratio),
            "key_reasons": F.slice("reasons", 1, 3),
        }
    )


def recommendations(candidates: DataFrame) -> DataFrame:
    code = F.split_part("symbol", F.lit("."), F.lit(1))
    return candidates.select(
        F.col("recommendation_rank").alias("rank"), F.when(F.length(code) < 6, F.lpad(code, 6, "0")).otherwise(code).alias("symbol"),
        "name", F.col("recommendation_grade").alias("grade"), "final_score", "first_buy_ratio", F.col("key_reasons").alias("reasons"),
    )


def screen(bars: DataFrame, symbols: DataFrame, min_score: int | None = None, p: ScreenerParams = P) -> DataFrame:
    """The whole screen: standardise, keep the most traded symbols, score, select."""
    top = top_by_trade_value(standardize(bars, symbols), p.top_value_count)
    scored = score_candidates(latest_rows(screener_indicators(top, p)), p=p)
    return recommendations(select_candidates(scored, min_score, p))


def default_symbols(table: DataFrame, order: str, limit: int = 200) -> DataFrame:
    """First n main-board symbols in file order."""
    rows = table.where(F.upper("Market") == "KOSPI") if "Market" in table.columns else table
    return rows.orderBy(order).limit(limit)


def article_cap(news: DataFrame, order: str, cap: int = 100) -> DataFrame:
    """First articles of each symbol in collection order."""
    return top_per_group(news, ["Symbol"], [F.col(order)], cap, "_pos").drop("_pos")
