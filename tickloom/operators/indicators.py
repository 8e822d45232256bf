"""Per-symbol rolling features.

Every function takes bars with one row per (Symbol, Date) and adds columns through
windows partitioned by Symbol, so a chain of them needs a single shuffle. The longest
possible group is the trading calendar.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.numeric import by_symbol, flag, full, pct_change, ratio
from tickloom.params import FeatureParams

P = FeatureParams()
EWM_BLOCK = 512
DIGITS = 32  # base of the positions in dominance counting
LONGEST_HISTORY = DIGITS**3  # bars of one symbol: 130 years of days


def price_returns(df: DataFrame) -> DataFrame:
    w = by_symbol()
    previous = F.lag("Close", 1).over(w)
    return df.withColumns(
        {
            "log_return": F.log(ratio("Close", previous)),
            "daily_return": pct_change("Close", 1, w),
            "gap_return": ratio("Open", previous) - 1,
            "intraday_return": ratio("Close", "Open") - 1,
            "range_pct": ratio(F.col("High") - F.col("Low"), "Close"),
            "value_traded": F.col("Close") * F.col("Volume"),
        }
    )


def lagged_returns(df: DataFrame, lags: tuple[int, ...] = P.return_lags) -> DataFrame:
    w = by_symbol()
    return df.withColumns({f"ret_{k}d": pct_change("Close", k, w) for k in lags})


def moving_averages(df: DataFrame, windows: tuple[int, ...] = P.mean_windows) -> DataFrame:
    w = by_symbol()
    out = df.withColumns({f"ma_{n}": full(F.avg, "Close", n, w) for n in windows})
    return out.withColumns({f"close_to_ma_{n}": ratio("Close", f"ma_{n}") - 1 for n in windows})


def rolling_volatility(df: DataFrame, windows: tuple[int, ...] = P.vol_windows) -> DataFrame:
    w = by_symbol()
    return df.withColumns({f"vol_{n}": full(F.stddev_samp, "log_return", n, w) for n in windows})


def volume_ratio(df: DataFrame, n: int = 20) -> DataFrame:
    return df.withColumn(f"vol_ratio_{n}", ratio("Volume", full(F.avg, "Volume", n, by_symbol())))


def number_bars(df: DataFrame) -> DataFrame:
    """0-based position of each bar in its symbol."""
    return df.withColumn("bar_no", F.row_number().over(by_symbol()) - 1)


def ewm(df: DataFrame, specs: Mapping[str, tuple[str | Column, float, int]], block: int = EWM_BLOCK) -> DataFrame:
    """Exponentially weighted mean y_t = (1-a) y_(t-1) + a x_t started at the first value.

    ``specs`` maps an output column to (input, a, first bar that has a value). The
    recursion is a prefix sum of x_j (1-a)^-j. It is rebased every ``block`` bars so that
    the powers stay in range; one earlier block is carried over, beyond which weights are
    below double precision. Needs ``bar_no``.
    """
    blk = F.floor(F.col("bar_no") / block)
    off = (F.col("bar_no") % block).cast("double")
    work = df.withColumns({"_blk": blk, "_off": off})
    inside = Window.partitionBy("Symbol", "_blk").orderBy("bar_no").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("Symbol").orderBy("_blk").rangeBetween(-1, -1)
    sums: dict[str, Column] = {}
    for name, (source, alpha, start) in specs.items():
        x = F.col(source) if isinstance(source, str) else source
        keep = 1.0 - alpha
        term = F.when(F.col("bar_no") == start, x).when(F.col("bar_no") > start, x * alpha).otherwise(0.0)
        sums[f"_p_{name}"] = F.sum(term * F.pow(F.lit(keep), -F.col("_off"))).over(inside)
        sums[f"_t_{name}"] = F.sum(term * F.pow(F.lit(keep), (block - 1) - F.col("_off"))).over(before)
    work = work.withColumns(sums)
    result: dict[str, Column] = {}
    for name, (_, alpha, start) in specs.items():
        keep = F.lit(1.0 - alpha)
        value = F.col(f"_p_{name}") * F.pow(keep, F.col("_off")) + F.coalesce(
            F.col(f"_t_{name}"), F.lit(0.0)
        ) * F.pow(keep, F.col("_off") + 1)
        result[name] = F.when(F.col("bar_no") >= start, value)
    return work.withColumns(result).drop("_blk", "_off", *sums)


def rsi_macd(df: DataFrame, period: int = P.rsi_period) -> DataFrame:
    """RSI (Wilder averages) and MACD 12/26 with a 9-bar signal line. Needs ``bar_no``."""
    diff = F.col("Close") - F.lag("Close", 1).over(by_symbol())
    out = df.withColumns(
        {"_gain": F.greatest(diff, F.lit(0.0)), "_loss": F.greatest(-diff, F.lit(0.0))}
    )
    out = ewm(
        out,
        {
            "_up": ("_gain", 1.0 / period, 1),
            "_down": ("_loss", 1.0 / period, 1),
            "_fast": ("Close", 2.0 / 13.0, 0),
            "_slow": ("Close", 2.0 / 27.0, 0),
        },
    )
    strength = ratio("_up", "_down")
    out = out.withColumns(
        {
            f"rsi_{period}": F.coalesce(100.0 - 100.0 / (1.0 + strength), F.lit(50.0)),
            "macd": F.col("_fast") - F.col("_slow"),
        }
    )
    out = ewm(out, {"macd_signal": ("macd", 0.2, 0)})
    return out.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop(
        "_gain", "_loss", "_up", "_down", "_fast", "_slow"
    )


def average_true_range(df: DataFrame, n: int = 14) -> DataFrame:
    w = by_symbol()
    previous = F.lag("Close", 1).over(w)
    true_range = F.greatest(  # greatest skips the missing previous close of the first bar
        F.col("High") - F.col("Low"), F.abs(F.col("High") - previous), F.abs(F.col("Low") - previous)
    )
    return df.withColumn("_tr", true_range).withColumn(f"atr_{n}", full(F.avg, "_tr", n, w)).drop("_tr")


def stochastic(df: DataFrame, n: int = P.stochastic_period) -> DataFrame:
    w = by_symbol()
    low, high = full(F.min, "Low", n, w), full(F.max, "High", n, w)
    out = df.withColumn("stoch_k", 100.0 * (F.col("Close") - low) / (high - low + 1e-9))
    return out.withColumn("stoch_d", full(F.avg, "stoch_k", 3, w))


def commodity_channel(df: DataFrame, n: int = P.cci_period) -> DataFrame:
    """Typical price against its mean in units of the window's own mean absolute deviation."""
    w = by_symbol()
    out = df.withColumn("_tp", (F.col("High") + F.col("Low") + F.col("Close")) / 3.0)
    out = out.withColumns(
        {"_mean": full(F.avg, "_tp", n, w), "_values": F.collect_list("_tp").over(w.rowsBetween(-(n - 1), 0))}
    )
    deviation = F.aggregate("_values", F.lit(0.0), lambda acc, v: acc + F.abs(v - F.col("_mean"))) / n
    return out.withColumn(f"cci_{n}", ratio(F.col("_tp") - F.col("_mean"), 0.015 * deviation)).drop(
        "_tp", "_mean", "_values"
    )


def on_balance_volume(df: DataFrame) -> DataFrame:
    w = by_symbol()
    change = F.coalesce(F.col("Close") - F.lag("Close", 1).over(w), F.lit(0.0))
    out = df.withColumn("_signed", F.signum(change) * F.coalesce(F.col("Volume"), F.lit(0.0)))
    out = out.withColumn("obv", F.sum("_signed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_signed")
    return out.withColumn("obv_change_5d", pct_change("obv", 5, w))


def rolling_zscore(df: DataFrame, source: str, name: str, n: int = 20) -> DataFrame:
    w = by_symbol()
    mean, spread = full(F.avg, source, n, w), full(F.stddev_samp, source, n, w)
    return df.withColumn(name, F.coalesce(ratio(F.col(source) - mean, spread), F.lit(0.0)))


def flow_sums(df: DataFrame, source: str, windows: tuple[int, ...] = (3, 5)) -> DataFrame:
    w = by_symbol()
    return df.withColumns({f"{source}_{n}d": F.coalesce(full(F.sum, source, n, w), F.lit(0.0)) for n in windows})


def rolling_max(df: DataFrame, c: str, n: int, name: str) -> DataFrame:
    """The largest of the last ``n`` values, or of those there are. The reach doubles with each pass, so a row costs
    log n comparisons instead of n; all passes share one sort."""
    out, span = df.withColumn(name, F.col(c)), 1
    while span < n:
        step = min(span, n - span)
        out = out.withColumn(name, F.greatest(F.col(name), F.lag(name, step).over(by_symbol())))
        span += step
    return out


def year_high(df: DataFrame, n: int = 252, need: int = 20) -> DataFrame:
    """Close against the 252-bar high, and a break above the previous 252-bar high."""
    w = by_symbol()
    out = df.withColumn("_seen", F.count("Close").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = rolling_max(out, "Close", n, "_high")
    seen = F.col("_seen") - F.lag("_seen", n, 0).over(w)
    out = out.withColumn("_high", F.when(seen >= need, F.col("_high")))
    previous_high = F.lag("_high", 1).over(w)  # the 252 bars up to the one before
    out = out.withColumns(
        {"close_to_52w_high": ratio("Close", "_high"), "breakout_52w_flag": flag(F.col("Close") >= previous_high)}
    )
    return out.drop("_seen", "_high")


def next_day_target(df: DataFrame) -> DataFrame:
    target = F.log(ratio(F.lead("Close", 1).over(by_symbol()), "Close"))
    out = df.withColumn("target_log_return", target)
    return out.withColumns(
        {
            "target_up": F.when(F.col("target_log_return") > 0, 1).otherwise(0),
            "target_close": F.col("Close") * F.exp("target_log_return"),
        }
    )


def smaller_before(df: DataFrame, value: str, name: str, position: str = "bar_no", longest: int = LONGEST_HISTORY) -> DataFrame:
    """How many earlier bars of the symbol have a smaller value (no value is missing).

    Offline dominance counting. Positions are numbers to the base ``DIGITS``. For each
    digit, bars that agree in the higher digits meet in one window in the order of their
    values; a bar there counts what came before it by value with a smaller digit, and every
    earlier bar is counted in exactly one such window, that of the highest digit in which
    the two positions differ. A pass is one sort inside the partitioning by symbol, and the
    number of passes grows with the logarithm of the longest history.
    """
    passes = max(1, math.ceil(math.log(longest, DIGITS) - 1e-9))
    out, counts = df, []
    for level in range(passes):
        digit = F.floor(F.col(position) / DIGITS**level) % DIGITS
        out = out.withColumns({"_digit": digit, "_group": F.floor(F.col(position) / DIGITS ** (level + 1))})
        # Of equal values the later bars come first, so that none counts as smaller.
        w = Window.partitionBy("Symbol", "_group").orderBy(value, F.col("_digit").desc()).rowsBetween(Window.unboundedPreceding, -1)
        seen = [F.count(F.when(F.col("_digit") == k, 1)).over(w) for k in range(DIGITS - 1)]
        lower = F.aggregate(F.slice("_seen", 1, F.col("_digit").cast("int")), F.lit(0).cast("long"), lambda acc, n: acc + n)
        out = out.withColumn("_seen", F.array(*seen)).withColumn(f"_count_{level}", lower).drop("_digit", "_group", "_seen")
        counts.append(f"_count_{level}")
    total = reduce(add, [F.col(c) for c in counts])
    checked = F.when(F.col(position) < DIGITS**passes, total).otherwise(F.raise_error(F.lit(f"a symbol has more than {DIGITS**passes} bars: raise longest")).cast("long"))
    return out.withColumn(name, checked).drop(*counts)


def market_regime(df: DataFrame, longest: int = LONGEST_HISTORY) -> DataFrame:
    """Trend and volatility state. A bar is high-volatility when it exceeds the 0.75
    quantile of the symbol's own history so far (missing counts as 0).

    The quantile itself is not needed: it lies between the values of rank k and k + 1 with
    k = floor(0.75 (n - 1)), so a bar exceeds it when more than k earlier bars are below.
    """
    out = df if "bar_no" in df.columns else number_bars(df)
    out = out.withColumns({"_trend": F.coalesce("close_to_ma_20", F.lit(0.0)), "_vol": F.coalesce("vol_20", F.lit(0.0))})
    out = smaller_before(out, "_vol", "_below", longest=longest)
    trend = F.when(F.col("_trend") > 0.01, "uptrend").when(F.col("_trend") < -0.01, "downtrend").otherwise("sideways")
    vol = F.when(F.col("_below") > F.floor(0.75 * F.col("bar_no")), "high_vol").otherwise("low_vol")
    out = out.withColumn("market_regime", F.concat_ws("_", trend, vol)).drop("_trend", "_vol", "_below")
    return out if "bar_no" in df.columns else out.drop("bar_no")


def technical_block(df: DataFrame, params: FeatureParams = P) -> DataFrame:
    """RSI, MACD, ATR, stochastic, CCI and OBV on one partitioning by symbol."""
    out = df if "bar_no" in df.columns else number_bars(df)
    out = rsi_macd(out, params.rsi_period)
    out = average_true_range(out)
    out = stochastic(out, params.stochastic_period)
    out = commodity_channel(out, params.cci_period)
    return on_balance_volume(out)
