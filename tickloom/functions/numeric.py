"""Column helpers for null-safe arithmetic, rolling windows and display text.

Missing values are always null, never NaN: Spark orders NaN above every number and
lets it poison ``avg`` and ``max``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: str | Column) -> Column:
    """To double; text that is no number, NaN and infinity become null."""
    v = col(c).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def number_or(df: DataFrame, aliases: list[str], default: float) -> Column:
    """First alias present in the frame as a number, ``default`` where missing."""
    for name in aliases:
        if name in df.columns:
            return F.coalesce(number(F.col(f"`{name}`")), F.lit(float(default)))
    return F.lit(float(default))


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null where b is 0 or either side is missing."""
    return F.try_divide(col(a), F.nullif(col(b), F.lit(0.0)))


def clip(c: str | Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value; missing stays missing (greatest/least alone would skip nulls)."""
    v = col(c)
    bounded = v
    if low is not None:
        bounded = F.greatest(bounded, F.lit(float(low)))
    if high is not None:
        bounded = F.least(bounded, F.lit(float(high)))
    return F.when(v.isNotNull(), bounded)


def flag(condition: Column) -> Column:
    """1.0 where true, 0.0 where false or unknown."""
    return F.when(condition, 1.0).otherwise(0.0)


def iflag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def by_symbol(order: str | Column = "Date", key: str = "Symbol") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def full(agg: Callable[[Column], Column], c: str | Column, n: int, w: WindowSpec) -> Column:
    """Rolling aggregate over n rows that is missing until all n values are there."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(col(c)).over(frame) == n, agg(col(c)).over(frame))


def pct_change(c: str | Column, n: int, w: WindowSpec) -> Column:
    return ratio(c, F.lag(col(c), n).over(w)) - 1


def r6(c: str | Column) -> Column:
    """Six decimals, halves up, by plain IEEE arithmetic so that other engines agree."""
    return F.floor(col(c) * 1e6 + 0.5) / F.lit(1e6)


def np_round(c: str | Column, digits: int) -> Column:
    """Round like array libraries do: scale, round half to even, scale back."""
    return F.rint(col(c) * 10.0**digits) / F.lit(10.0**digits)


def percent_text(c: str | Column, digits: int = 1, unit_interval: bool = False) -> Column:
    v = col(c) * 100.0 if unit_interval else col(c)
    return F.when(v.isNotNull(), F.format_string(f"%.{digits}f%%", np_round(v, digits))).otherwise("-")


def amount_text(c: str | Column) -> Column:
    """Amount in units of 1e8 with thousands separators."""
    return F.when(col(c).isNotNull(), F.format_string("%,.0f억", F.rint(col(c) / 100_000_000.0))).otherwise("-")


def price_text(c: str | Column) -> Column:
    return F.when(col(c).isNotNull(), F.format_string("%,.0f원", F.rint(col(c)))).otherwise("-")


def points_text(c: str | Column) -> Column:
    return F.when(col(c).isNotNull(), F.format_string("%+.1f점", np_round(c, 1))).otherwise("-")
