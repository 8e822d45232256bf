"""Back-testing of impact scores: signal returns, information coefficients, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import clip
from tickloom.operators.metrics import pearson
from tickloom.operators.ranking import ordinal_rank, ordinal_ranks, top_per_group
from tickloom.operators.skew import first_per_key
from tickloom.params import GateParams
from tickloom.session import cut_lineage, written

UNTRADABLE = ("halted", "limit_locked")


def match_returns(
    signals: DataFrame, prices: DataFrame, order: str, cost_bps: float = 26.0, include_missing: bool = False
) -> DataFrame:
    """Join signals to the bar of their entry day. Of duplicate bars the last one counts.
    ``order`` numbers the price rows."""
    bars = first_per_key(prices, ["ticker", "trading_day"], [F.col(order)], last=True)
    bars = bars.select("ticker", F.col("trading_day").alias("entry_day"), "open", "close", "market_return", "sector_return", F.lit(True).alias("_hit"))
    kept = signals.where(~F.col("tradeability_status").isin(*UNTRADABLE)).withColumn("entry_day", F.col("effective_trading_day"))
    joined = kept.join(bars, ["ticker", "entry_day"], "left" if include_missing else "inner")
    raw = F.col("close") / F.col("open") - 1
    shifted = F.col("effective_trading_day") != F.col("signal_day")

    def value(c: Column) -> Column:
        return F.coalesce(F.bround(c, 6), F.lit(0.0))

    flags = F.array_compact(
        F.array(
            F.when((F.col("market_session") == "after_market") & shifted, "after_market_shifted"),
            F.when((F.col("market_session") == "holiday") & shifted, "holiday_shifted"),
            F.when(F.col("_hit").isNull(), "missing_intraday_price"),
        )
    )
    return joined.withColumns(
        {
            "raw_return": value(raw),
            "after_cost_return": value(raw - cost_bps / 10_000.0),
            "market_excess_return": value(raw - F.col("market_return")),
            "sector_excess_return": value(raw - F.col("sector_return")),
            "quality_flags": flags,
        }
    ).drop("open", "close", "market_return", "sector_return", "_hit")


def coefficient_block(
    obs: DataFrame, by: list[str], order: str, basket: Column | int = 5, group_rows: int | None = None, extra=()
) -> DataFrame:
    """Sample size, IC, ordinal rank IC, hit ratio and top-bottom spread per group."""
    usable = obs.where(~F.array_contains("quality_flags", "missing_intraday_price"))
    keep = dict.fromkeys([*by, order, "score", "after_cost_return", *extra])
    usable = cut_lineage(usable.select(*keep))  # feeds the sizes and three ranks
    score, ret = F.col("score"), F.col("after_cost_return")
    sizes = usable.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    rows = ordinal_rank(usable, by, [score.asc(), F.col(order).asc()], "_score_rank", group_rows)
    rows = ordinal_rank(rows, by, [ret.asc(), F.col(order).asc()], "_return_rank", group_rows)
    rows = ordinal_rank(rows, by, [score.desc(), F.col(order).asc()], "_from_top", group_rows)
    rows = rows.join(sizes, by) if by else rows.withColumn("_n", F.lit(sizes.first()[0]))
    k = F.lit(basket) if isinstance(basket, int) else basket
    top = F.avg(F.when(F.col("_from_top") <= k, ret))
    bottom = F.avg(F.when(F.col("_from_top") > F.col("_n") - k, ret))
    return rows.groupBy(*by).agg(*_measures(score, ret), F.bround(top - bottom, 6).alias("top_bottom_spread"))


def _measures(score: Column, ret: Column) -> list[Column]:
    """What a group's rows with ``_score_rank`` and ``_return_rank`` add up to."""
    hit = ((score > 0) & (ret > 0)) | ((score < 0) & (ret < 0)) | (score == 0)
    return [
        F.count(F.lit(1)).alias("sample_size"),
        F.bround(pearson(score, ret), 6).alias("ic"),
        F.bround(pearson(F.col("_score_rank"), F.col("_return_rank")), 6).alias("rank_ic"),
        F.bround(F.avg(F.when(hit, 1.0).otherwise(0.0)), 6).alias("hit_ratio"),
    ]


def validation_sets(obs: DataFrame, order: str, basket: int = 5) -> DataFrame:
    """The same block overall, by entry day, sector and size bucket.

    A row takes part in all four sets, but travels once for each of the two ranks: the sets share an order, so one sort
    of the table ranks them all. Rows are only repeated where they are added up or cut to a few per group before the shuffle.
    A group without a key is left out.
    """
    sets = {"overall": [], "by_day": ["entry_day"], "by_sector": ["sector"], "by_market_cap": ["market_cap_bucket"]}
    score, ret = F.col("score"), F.col("after_cost_return")
    usable = obs.where(~F.array_contains("quality_flags", "missing_intraday_price"))
    usable = written(usable.select(*dict.fromkeys([order, "score", "after_cost_return", *sum(sets.values(), [])])), "observations")
    ranked = ordinal_ranks(usable, {f"_score_{s}": group for s, group in sets.items()}, [score.asc(), F.col(order).asc()])
    ranked = ordinal_ranks(ranked, {f"_return_{s}": group for s, group in sets.items()}, [ret.asc(), F.col(order).asc()])

    def repeated(df: DataFrame, columns: list[str], ranks: bool) -> DataFrame:
        """Every row once for each of its sets."""
        def one(s: str, group: list[str]) -> Column:
            key = F.col(group[0]).cast("string") if group else F.lit("all")
            own = [F.col(f"_score_{s}").alias("_score_rank"), F.col(f"_return_{s}").alias("_return_rank")] if ranks else []
            return F.struct(F.lit(s).alias("set"), key.alias("key"), F.lit(1 if group else basket).alias("_basket"), *own)

        rows = df.select(*columns, F.explode(F.array(*[one(s, group) for s, group in sets.items()])).alias("_s"))
        return rows.select(*columns, "_s.*").where(F.col("key").isNotNull())

    def best(by: list[Column], name: str) -> DataFrame:
        """The mean return of each group's first rows."""
        rows = repeated(usable, list(dict.fromkeys([order, "score", "after_cost_return"])), False)
        first = top_per_group(rows, ["set", "key"], by, max(basket, 1)).where(F.col("pos") <= F.col("_basket"))
        return first.groupBy("set", "key").agg(F.avg(ret).alias(name))

    blocks = repeated(ranked, ["score", "after_cost_return"], True).groupBy("set", "key").agg(*_measures(score, ret))
    blocks = blocks.join(best([score.desc(), F.col(order).asc()], "_top"), ["set", "key"], "left")
    blocks = blocks.join(best([score.asc(), F.col(order).desc()], "_bottom"), ["set", "key"], "left")
    return blocks.withColumn("top_bottom_spread", F.bround(F.col("_top") - F.col("_bottom"), 6)).drop("_top", "_bottom")


def compare_variants(obs: DataFrame, variant: str, baseline: str, order: str, group_rows: int | None = None) -> DataFrame:
    """Deltas of every variant against the baseline variant."""
    blocks = coefficient_block(obs, [variant], order, group_rows=group_rows)
    measures = ["ic", "rank_ic", "top_bottom_spread"]
    base = blocks.where(F.col(variant) == baseline).select(*[F.col(m).alias(f"_{m}") for m in measures], F.lit(1).alias("_one"))
    out = blocks.where(F.col(variant) != baseline).withColumn("_one", F.lit(1)).join(F.broadcast(base), "_one")  # one row
    return out.select(variant, "sample_size", *measures, *[F.bround(F.col(m) - F.col(f"_{m}"), 6).alias(f"{m}_delta") for m in measures])


def failed_checks(blocks: DataFrame, p: GateParams = GateParams()) -> DataFrame:
    """One row per failed performance check of a ``validation_sets`` table."""
    overall = F.col("set") == "overall"
    checks = F.array_compact(
        F.array(
            F.when(overall & (F.col("sample_size") < p.min_samples), "insufficient_overall_samples"),
            F.when(overall & (F.col("rank_ic") <= p.min_rank_ic), "rank_ic_below_threshold"),
            F.when(overall & (F.col("top_bottom_spread") <= p.min_spread), "top_bottom_spread_below_threshold"),
            F.when(
                ~overall & (F.col("sample_size") < p.min_bucket_samples),
                F.concat(F.lit("bucket_"), F.col("key"), F.lit("_insufficient_samples")),
            ),
        )
    )
    return blocks.select(F.explode(checks).alias("failed_check")).distinct()


def select_variant(candidates: DataFrame, base_rank_ic: Column, base_spread: Column, max_weight: float = 1.2, min_bucket_ic: float = 0.0) -> DataFrame:
    """Rejection reason of every weight variant and the selected one.

    ``candidates``: variant_id, min_weight, max_weight, test_rank_ic, test_spread,
    min_bucket_rank_ic.
    """
    reason = (
        F.when((F.col("min_weight") < 0) | (F.col("max_weight") > max_weight), "weight_outside_policy_range")
        .when(F.col("test_rank_ic") <= base_rank_ic, "no_out_of_sample_rank_ic_improvement")
        .when(F.col("test_spread") < base_spread, "worse_out_of_sample_spread")
        .when(F.col("min_bucket_rank_ic") < min_bucket_ic, "unstable_bucket_rank_ic")
    )
    marked = candidates.withColumn("rejection_reason", reason)
    # Of equal candidates the first id wins.
    best = marked.agg(
        F.min_by("variant_id", F.when(F.col("rejection_reason").isNull(), F.struct(-F.col("test_rank_ic"), "variant_id"))).alias("_best")
    ).withColumn("_one", F.lit(1))
    out = marked.withColumn("_one", F.lit(1)).join(F.broadcast(best), "_one").drop("_one")  # one row
    return out.withColumn("selected", F.coalesce(F.col("variant_id") == F.col("_best"), F.lit(False))).drop("_best")


def proxy_returns(prices: DataFrame, day: Column, cutoff: Column | None = None) -> DataFrame:
    """Return of each proxy on a day against its last earlier price, using only prices
    collected by the cutoff; one row per proxy with the reason when there is none."""
    usable = F.lit(True) if cutoff is None else F.col("collected_at") <= cutoff
    on_day = usable & (F.col("price_date") == day)
    earlier = usable & (F.col("price_date") < day)
    rows = prices.groupBy("proxy_symbol").agg(
        F.max(F.when(on_day, F.col("close"))).alias("_now"),
        F.max_by("close", F.when(earlier, F.col("price_date"))).alias("_before"),
        F.count(F.when(usable, 1)).alias("_usable"),
        F.max(F.when(~usable & (F.col("price_date") == day), 1).otherwise(0)).alias("late_rows"),
    )
    flag = (
        F.when(F.col("_usable") == 0, F.lit(None).cast("string"))
        .when(F.col("_now").isNull(), "missing_global_proxy_price")
        .when(F.col("_before").isNull(), "missing_previous_global_proxy_price")
        .when(F.col("_before") == 0, "invalid_previous_global_proxy_price")
    )
    change = F.bround(F.try_divide(F.col("_now") - F.col("_before"), F.nullif("_before", F.lit(0.0))), 10)
    out = rows.select("proxy_symbol", change.alias("proxy_return"), flag.alias("quality_flag"), "late_rows")
    return out.withColumn("leakage_blocked", F.col("late_rows") > 0).drop("late_rows")


def proxy_adjustment(proxies: DataFrame, returns: DataFrame, sensitivity: float = 1.0, lag: float = 1.0, cap: float = 15.0) -> DataFrame:
    """Score adjustment per sector from its proxies' returns."""
    known = returns.where(F.col("proxy_return").isNotNull()).select("proxy_symbol", "proxy_return")
    rows = proxies.join(known, "proxy_symbol", "left")
    sign = F.when(F.col("direction_transform") == "inverse", -1.0).otherwise(1.0)
    raw = F.col("proxy_return") * F.col("weight") * sensitivity * lag * sign * 100.0
    bound = F.col("max_adjustment_abs")
    part = F.when(raw.isNotNull(), F.greatest(-bound, F.least(raw, bound)))
    grouped = rows.withColumn("_a", part).groupBy("korean_sector").agg(
        F.coalesce(F.sum("_a"), F.lit(0.0)).alias("_sum"),
        F.count(F.lit(1)).alias("proxy_count"),
        F.bool_or(F.col("_a").isNull()).alias("_missing"),
        (F.coalesce(F.max("_a"), F.lit(0.0)) > 0).alias("_up"),
        (F.coalesce(F.min("_a"), F.lit(0.0)) < 0).alias("_down"),
    )
    flags = F.array_compact(
        F.array(
            F.when(F.col("_missing"), "missing_global_proxy_price"),
            F.when(F.col("_up") & F.col("_down"), "conflicting_global_proxy_signals"),
        )
    )
    return grouped.select(
        "korean_sector", F.bround(clip("_sum", -cap, cap), 6).alias("global_proxy_adjustment"), "proxy_count", flags.alias("quality_flags")
    )


# Safety switches and the flag each one raises, liquidity tiers.
SAFETY_FLAGS = {
    "trading_halt": "trading_halt",
    "management_issue": "management_issue",
    "delisting_risk": "delisting_risk",
    "investment_warning": "investment_warning",
    "limit_up": "limit_up",
    "limit_down": "limit_down",
    "volatility_interruption": "volatility_interruption",
    "wide_spread": "wide_spread_risk",
}
CAUTION_FLAGS = (
    "management_issue", "delisting_risk", "investment_warning", "volatility_interruption", "wide_spread_risk",
    "very_low_liquidity", "low_liquidity",
)
VERY_LOW_LIQUIDITY, LOW_LIQUIDITY = 100_000_000, 1_000_000_000


def safety_filter(df: DataFrame) -> DataFrame:
    """Status and flags from eight switches and the average traded value; existing
    ``risk_flags`` are kept in front."""
    value = F.col("avg_trading_value_20d")
    raised = [F.when(F.col(c), name) for c, name in SAFETY_FLAGS.items()]
    thin = F.when(value < VERY_LOW_LIQUIDITY, "very_low_liquidity").when(value < LOW_LIQUIDITY, "low_liquidity")
    own = F.col("risk_flags") if "risk_flags" in df.columns else F.array().cast("array<string>")
    out = df.withColumn("risk_flags", F.array_distinct(F.concat(own, F.array_compact(F.array(*raised, thin)))))
    caution = F.arrays_overlap("risk_flags", F.array(*[F.lit(c) for c in CAUTION_FLAGS]))
    locked = F.array_contains("risk_flags", "limit_up") | F.array_contains("risk_flags", "limit_down")
    status = (
        F.when(F.array_contains("risk_flags", "trading_halt"), "halted")
        .when(locked, "limit_locked")
        .when(caution, "caution")
        .when(value.isNull(), "unknown")
        .otherwise("tradable")
    )
    out = out.withColumn("tradeability_status", status)
    unknown = F.array(F.lit("tradeability_unknown"))
    return out.withColumns(
        {
            "risk_flags": F.when(F.col("tradeability_status") == "unknown", F.array_union("risk_flags", unknown)).otherwise(F.col("risk_flags")),
            "review_checklist": F.array(F.lit("not_investment_advice"), F.lit("verify_tradeability_status")),
        }
    )
