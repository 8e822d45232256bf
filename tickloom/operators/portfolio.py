"""Capacity- and cost-aware top-k portfolio evaluation.

Every stage works per date. Only the turnover limit needs the day before: it runs on the
few candidates each date was reduced to, one ordered fold per strategy.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.numeric import clip, number, number_or
from tickloom.operators.ranking import top_per_group
from tickloom.params import PortfolioParams
from tickloom.session import cut_lineage

P = PortfolioParams()
KEY = ["strategy", "Date"]
INPUTS = [
    "Date", "Symbol", "signal_score", "predicted_return", "up_probability", "target_log_return", "uncertainty_score",
    "value_traded", "external_coverage_ratio", "investor_coverage_ratio", "vol_ratio_20", "ks11_ret_1d",
    "coverage_gate_status", "market_type",
]


def with_strategy(df: DataFrame) -> DataFrame:
    return df if "strategy" in df.columns else df.withColumn("strategy", F.lit("base"))


def coverage_halts(df: DataFrame, p: PortfolioParams = P) -> DataFrame:
    """One row per strategy and date: halted or not, and the benchmark return."""
    df = with_strategy(df)
    external, investor = number_or(df, ["external_coverage_ratio"], 1.0), number_or(df, ["investor_coverage_ratio"], 1.0)
    stopped = F.lit(False)
    if "coverage_gate_status" in df.columns:
        stopped = F.coalesce(F.lower("coverage_gate_status").contains("halt"), F.lit(False))
    market = number("ks11_ret_1d") if "ks11_ret_1d" in df.columns else F.lit(None).cast("double")
    per_date = df.groupBy(*KEY).agg(
        F.avg(external).alias("_ext"),
        F.avg(investor).alias("_inv"),
        F.bool_or(stopped).alias("_stop"),
        F.coalesce(F.avg(market), F.lit(0.0)).alias("benchmark_return"),
    )
    halted = F.col("_stop")
    if p.min_external_coverage > 0:
        halted = halted | (F.col("_ext") < p.min_external_coverage)
    if p.min_investor_coverage > 0:
        halted = halted | (F.col("_inv") < p.min_investor_coverage)
    return per_date.select(*KEY, halted.alias("halted"), "benchmark_return")


def eligible(df: DataFrame, p: PortfolioParams = P) -> DataFrame:
    """Probability, liquidity and capacity filters."""
    out = with_strategy(df).where(F.coalesce(number("up_probability"), F.lit(0.0)) >= p.min_up_probability)
    if "value_traded" not in out.columns:
        return out
    out = out.withColumn("value_traded", F.coalesce(number("value_traded"), F.lit(0.0)))
    out = out.withColumn("max_capacity_notional", F.col("value_traded") * p.max_participation)
    return out.where(
        (F.col("value_traded") >= p.min_value_traded)
        & (F.col("max_capacity_notional") >= p.portfolio_value / max(1, p.top_k))
    )


def _order() -> list[Column]:
    return [F.col("predicted_return").desc_nulls_last(), F.col("signal_score").desc_nulls_last(), F.col("Symbol")]


def candidates(df: DataFrame, p: PortfolioParams = P) -> DataFrame:
    """The 3k best eligible names of each date, numbered from 1."""
    return top_per_group(eligible(df, p), KEY, _order(), max(p.top_k * 3, p.top_k), "pos")


def cap_market_types(cands: DataFrame, p: PortfolioParams = P) -> DataFrame:
    """At most c names per market type, then at most k names. Works on the few candidates of a date."""
    if "market_type" not in cands.columns or p.max_per_market_type <= 0:
        return cands
    kind = F.coalesce(F.nullif("market_type", F.lit("")), F.lit("unknown"))
    typed = cands.withColumn("_kind", kind)
    within = F.row_number().over(Window.partitionBy(*KEY, "_kind").orderBy("pos"))
    kept = typed.withColumn("_in_kind", within).where(F.col("_in_kind") <= p.max_per_market_type)
    overall = F.row_number().over(Window.partitionBy(*KEY).orderBy("pos"))
    return kept.withColumn("_rank", overall).where(F.col("_rank") <= p.top_k).drop("_kind", "_in_kind", "_rank")


def limit_turnover(cands: DataFrame, halts: DataFrame, p: PortfolioParams = P) -> DataFrame:
    """Names held per date when only m = round(k * limit) new names may enter.

    Halted dates and dates without candidates empty the book. A strategy's group holds at
    most 3k rows per trading day.
    """
    top_k, entering = p.top_k, round(p.top_k * max(0.0, p.turnover_limit))

    def hold(pdf: pd.DataFrame) -> pd.DataFrame:
        held: set[str] = set()
        rows = []
        for day, part in pdf.sort_values(["Date", "pos"]).groupby("Date", sort=True):
            names = part["Symbol"].dropna().tolist()
            if held and names:
                stay = [s for s in names if s in held][: top_k - entering]
                enter = [s for s in names if s not in held][:entering]
                picked = set(stay + enter)
                names = [s for s in names if s in picked]
            names = names[:top_k]
            rows.extend((part["strategy"].iloc[0], day, s) for s in names)
            held = set(names)
        return pd.DataFrame(rows, columns=["strategy", "Date", "Symbol"])

    days = halts.where(~F.col("halted")).select(*KEY)
    slim = cands.select(*KEY, "Symbol", "pos").join(days, KEY, "left_semi")
    every_day = halts.select(*KEY, F.lit(None).cast("string").alias("Symbol"), F.lit(0).alias("pos"))
    schema = f"strategy string, Date {dict(cands.dtypes)['Date']}, Symbol string"
    return slim.unionByName(every_day).groupBy("strategy").applyInPandas(hold, schema)


def select_portfolio(df: DataFrame, p: PortfolioParams = P) -> DataFrame:
    """Selected names of every date with their candidate columns."""
    df = with_strategy(df)
    halts = coverage_halts(df, p)
    cands = cap_market_types(candidates(df, p), p)
    if p.turnover_limit < 1.0:
        return cands.join(limit_turnover(cands, halts, p), [*KEY, "Symbol"], "left_semi")
    open_days = halts.where(~F.col("halted")).select(*KEY)
    open_cands = cands.join(open_days, KEY, "left_semi")
    return top_per_group(open_cands, KEY, [F.col("pos")], p.top_k, "_k").drop("_k")


def capacity_weights(selected: DataFrame, p: PortfolioParams = P) -> DataFrame:
    """Equal weights under per-name caps: unsaturated names share one level.

    With caps in ascending order the level that would result after saturating the first
    names rises until the true level and falls after it, so the level is the maximum.
    """
    per_date = Window.partitionBy(*KEY)
    n = F.count(F.lit(1)).over(per_date)
    if "max_capacity_notional" not in selected.columns or p.portfolio_value <= 0:
        return selected.withColumn("weight", 1.0 / n)
    cap = F.coalesce(clip(number("max_capacity_notional") / p.portfolio_value, 0.0, 1.0), F.lit(0.0))
    ordered = per_date.orderBy("_cap", "Symbol")
    before = F.coalesce(F.sum("_cap").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    out = selected.withColumn("_cap", cap)
    out = out.withColumn("_level", (1.0 - before) / (n - F.row_number().over(ordered) + 1))
    out = out.withColumn("_level", F.max("_level").over(per_date))
    return out.withColumn("weight", F.least("_cap", F.greatest("_level", F.lit(0.0)))).drop("_cap", "_level")


def daily_gross(weighted: DataFrame) -> DataFrame:
    """Return, invested weight, cost drivers and holdings per date."""
    simple = F.expm1(F.coalesce(number("target_log_return"), F.lit(0.0)))
    penalty = F.lit(0.0)
    if "uncertainty_score" in weighted.columns:
        penalty = penalty + F.avg(F.coalesce(number("uncertainty_score"), F.lit(0.0)))
    if "vol_ratio_20" in weighted.columns:
        excess = F.greatest(F.coalesce(number("vol_ratio_20"), F.lit(1.0)) - 1.0, F.lit(0.0))
        penalty = penalty + F.avg(excess)
    kinds = F.count_distinct("market_type") if "market_type" in weighted.columns else F.lit(0)
    return weighted.groupBy(*KEY).agg(
        F.sum(simple * F.col("weight")).alias("gross_return"),
        F.sum("weight").alias("invested_weight"),
        penalty.alias("dyn_penalty"),
        F.count(F.lit(1)).alias("selected_count"),
        kinds.alias("market_type_count"),
        F.sort_array(F.collect_set("Symbol")).alias("holdings"),
    )


def turnover_between(previous: Column, current: Column) -> Column:
    """Names that changed over names involved."""
    changed = F.size(F.array_except(previous, current)) + F.size(F.array_except(current, previous))
    return changed / F.greatest(F.size(F.array_union(previous, current)), F.lit(1))


def daily_series(df: DataFrame, p: PortfolioParams = P) -> DataFrame:
    """Per-date returns, costs, equity and drawdown of each strategy. Windows run over the
    dates of a strategy."""
    df = with_strategy(df)
    used = [c for c in INPUTS if c in df.columns]
    df = cut_lineage(df.select("strategy", *used))  # feeds halts, candidates and holdings
    halts = coverage_halts(df, p)
    gross = daily_gross(capacity_weights(select_portfolio(df, p), p))
    days = halts.join(gross, KEY, "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("gross_return", "invested_weight", "dyn_penalty")}
    counts = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("selected_count", "market_type_count")}
    empty = F.array().cast("array<string>")
    days = days.withColumns({**zero, **counts, "holdings": F.coalesce("holdings", empty)})
    w = Window.partitionBy("strategy").orderBy("Date")
    previous = F.lag("holdings", 1).over(w)
    changed = turnover_between(previous, F.col("holdings"))
    days = days.withColumns(
        {
            "liquidity_blocked": ~F.col("halted") & (F.col("selected_count") == 0),
            # Reported turnover counts an empty day before; the cost does not.
            "turnover": F.when(previous.isNull(), 0.0).otherwise(changed),
            "cost_turnover": F.when(
                previous.isNull() | (F.size(previous) == 0) | (F.size("holdings") == 0), 0.0
            ).otherwise(changed),
        }
    )
    static = (p.fee_bps + p.slippage_bps) / 10000.0
    dynamic = p.dynamic_slippage_bps * (F.col("cost_turnover") + F.col("dyn_penalty")) / 10000.0
    days = days.withColumn("daily_return", F.col("gross_return") - (static + dynamic) * F.col("invested_weight"))
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumns(
        {
            "equity": F.product(1.0 + F.col("daily_return")).over(past),
            "benchmark_equity": F.product(1.0 + F.col("benchmark_return")).over(past),
        }
    )
    return days.withColumn("drawdown", F.col("equity") / F.max("equity").over(past) - 1.0)


def scenario_results(series: DataFrame, p: PortfolioParams = P) -> DataFrame:
    """Cumulative return of each strategy under each slippage scenario."""
    scenarios = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(m).alias("m")) for n, m in p.scenario_multipliers])
    rows = series.withColumn("_s", F.explode(scenarios)).select("*", "_s.*")
    bps = p.fee_bps + p.slippage_bps * F.col("m") + p.dynamic_slippage_bps * (
        F.col("m") * F.col("dyn_penalty") + F.col("cost_turnover")
    )
    net = F.col("gross_return") - bps / 10000.0 * F.col("invested_weight")
    return rows.groupBy("strategy", "scenario").agg((F.product(1.0 + net) - 1.0).alias("cum_return"))


def summary(series: DataFrame) -> DataFrame:
    spread = F.stddev_samp("daily_return")
    sharpe = F.when(spread > 0, F.sqrt(F.lit(252.0)) * F.avg("daily_return") / spread).otherwise(0.0)
    cum, bench = F.max_by("equity", "Date") - 1.0, F.max_by("benchmark_equity", "Date") - 1.0
    return series.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("days"),
        cum.alias("cum_return"),
        F.avg("daily_return").alias("avg_daily_return"),
        sharpe.alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg("turnover").alias("avg_turnover"),
        F.avg("selected_count").alias("avg_selected_count"),
        bench.alias("benchmark_cum_return"),
        (cum - bench).alias("excess_cum_return"),
        F.sum(F.col("halted").cast("int")).alias("halted_days"),
        F.sum(F.col("liquidity_blocked").cast("int")).alias("liquidity_blocked_days"),
        F.avg("market_type_count").alias("avg_market_type_count"),
    )


def validity(summary_row: DataFrame, tradable: Column) -> DataFrame:
    """Reasons why an evaluation carries no information."""
    days, halted = F.coalesce("days", F.lit(0)), F.coalesce("halted_days", F.lit(0))
    reasons = F.array_compact(
        F.array(
            F.when(tradable <= 0, "tradable_prediction_count_zero"),
            F.when(days <= 0, "no_evaluation_days"),
            F.when((days > 0) & (halted >= days), "all_days_halted"),
            F.when(F.coalesce("avg_selected_count", F.lit(0.0)) <= 0, "avg_selected_count_zero"),
        )
    )
    return summary_row.withColumns({"blocking_reasons": reasons, "backtest_valid": F.size(reasons) == 0})
