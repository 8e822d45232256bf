"""The three end-to-end jobs composed from the operators.

Each returns lazy tables; stages that feed several others are written to reliable storage.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import policy, text
from tickloom.functions.selection import feature_columns
from tickloom.operators import clean, context, dedupe, features, impact, learning, mapping, metrics, portfolio, scoring, validation
from tickloom.operators.skew import first_per_key
from tickloom.params import Params
from tickloom.session import cut_lineage


@dataclass(frozen=True)
class Evaluation:
    matrix: DataFrame
    features: list[str]
    folds: DataFrame
    oof: DataFrame
    calibrator: learning.Calibrator
    scored: DataFrame
    weights: tuple[float, float, float]
    fold_metrics: DataFrame
    series: DataFrame
    summary: DataFrame
    coverage: dict[str, float]
    gate: str


def add_context(
    bars: DataFrame, series: DataFrame | None = None, series_names: list[str] | None = None,
    flows: DataFrame | None = None, disclosures: DataFrame | None = None,
) -> tuple[DataFrame, dict[str, float], list[str]]:
    """Bars with landed flows and daily disclosure scores, what share of the requested sources landed, and which series did.

    External series are joined later, to the features; a substitute counts as landed, and a
    series without one gets no columns. What was not requested has a share of 1.
    """
    spark, coverage, found = bars.sparkSession, {"external": 1.0, "investor": 1.0}, []
    if series is not None and series_names:
        span = bars.agg(F.min("Date").alias("_from"), F.max("Date").alias("_to"))
        inside = series.join(F.broadcast(span), F.col("Date").between(F.col("_from"), F.col("_to")))  # one row
        chosen = cut_lineage(context.choose_series(inside, context.fallback_chains(spark, series_names)))
        usable = {r["series"] for r in chosen.where("used IS NOT NULL").collect()}  # of the few that were asked for
        found = [s for s in series_names if s in usable]
        coverage["external"] = float(context.source_coverage(chosen).first()["ratio"])
    if flows is not None:
        asked = bars.select(F.col("Symbol").alias("series")).distinct().withColumns({"used": F.col("series"), "step": F.lit(0)})
        landed = flows.select(F.col("Symbol").alias("series"), F.coalesce("foreign_net_buy", "institution_net_buy").alias("close"))
        coverage["investor"] = float(context.source_coverage(context.choose_series(landed, asked)).first()["ratio"])
        bars = context.add_flows(bars, flows)
    if disclosures is not None:
        bars = context.add_disclosure_scores(bars, context.disclosure_daily_scores(disclosures))
    return bars, coverage, found


def evaluate(
    bars: DataFrame,
    params: Params = Params(),
    series: DataFrame | None = None,
    series_names: list[str] | None = None,
    group_rows: int | None = None,
    trees: int = learning.TREES,
    gate: str | None = None,
    flows: DataFrame | None = None,
    disclosures: DataFrame | None = None,
) -> Evaluation:
    """Clean bars, add context, build features, predict out of fold, calibrate, tune and evaluate a portfolio.

    The gate follows the coverage of the requested sources unless one is given.
    """
    cleaned = clean.drop_flagged(clean.clean_bars(bars, params.feature))
    cleaned, coverage, found = add_context(cleaned, series, series_names, flows, disclosures)
    if gate is None:
        shares = (F.lit(coverage["external"]), F.lit(coverage["investor"]))
        gate = bars.sparkSession.range(1).select(policy.coverage_gate(*shares, params.portfolio)).first()[0]
    df = features.build_features(cleaned, params.feature, group_rows)
    if found:
        df = context.add_external(df, series, found)
    df = features.signal_features(features.ind.market_regime(df), params.criteria, group_rows)
    matrix = cut_lineage(df.where(F.col("target_log_return").isNotNull()))
    names = feature_columns(matrix.columns)
    folds = validation.fold_windows(matrix, params.folds)
    fold_params = params.folds
    if folds.count() < params.folds.min_folds:
        n_dates = matrix.select("Date").distinct().count()
        fold_params = validation.adaptive_params(params.folds, n_dates)
        folds = validation.fold_windows(matrix, fold_params)
    folds = cut_lineage(folds)
    carry = [c for c in ("Close", "market_regime", *scoring.CARRIED) if c in matrix.columns and c not in validation.TARGETS]
    raw = learning.walk_forward(matrix, folds, names, carry, fold_params, trees)
    fold_metrics = metrics.fold_metric_means(raw, "target_log_return", "predicted_return", "target_up", "up_probability")
    oof = cut_lineage(validation.temporal_split(validation.consolidate_oof(raw)))
    calibrator = learning.fit_calibrator(oof.where(F.col("split") == "tune"))
    heads = calibrator.transform(oof).withColumnRenamed("predicted_return", "predicted_log_return")
    tune, held_out = (
        cut_lineage(
            scoring.scored_frame(
                heads.where(F.col("split") == part), min_liquidity=params.portfolio.min_value_traded,
                s=params.signal, c=params.criteria, group_rows=group_rows,
            )
        )
        for part in ("tune", "eval")
    )
    best = validation.tune_weights(tune, params.tuning).first()
    weights = (best["w_ret"], best["w_prob"], best["w_pen"])
    scored = scoring.rescore(tune.unionByName(held_out), weights, gate, group_rows)
    scored = cut_lineage(scored)
    daily = cut_lineage(portfolio.daily_series(scored.where(F.col("split") == "eval"), params.portfolio))
    return Evaluation(matrix, names, folds, oof, calibrator, scored, weights, fold_metrics, daily, portfolio.summary(daily), coverage, gate)


def predict_latest(run: Evaluation, names: DataFrame, params: Params = Params(), lookback: int = 756, trees: int = learning.TREES) -> DataFrame:
    """Final fit on the last dates, then the latest row of every symbol with policy labels."""
    train = validation.last_dates(run.matrix.dropna(subset=run.features), lookback)
    models = learning.fit_heads(train, run.features, params.folds, trees)
    latest = first_per_key(run.matrix, ["Symbol"], [F.col("Date")], last=True)
    heads = run.calibrator.transform(learning.predict_heads(models, latest))
    heads = heads.withColumnRenamed("predicted_return", "predicted_log_return")
    signal = replace(params.signal, return_weight=run.weights[0], up_prob_weight=run.weights[1], uncertainty_penalty=run.weights[2])
    frame = scoring.scored_frame(heads, min_liquidity=params.portfolio.min_value_traded, s=signal, c=params.criteria)
    frame = frame.withColumn("coverage_gate_status", F.lit(run.gate))
    frame = scoring.add_history_accuracy(frame, scoring.history_accuracy(run.scored))
    return scoring.finalize_latest(frame, names, params.criteria, signal)


def judgement_targets(news: DataFrame, watchlist: DataFrame, companies: DataFrame, order: str) -> DataFrame:
    """Deduplicated news with cluster ids, one row per company to judge them for."""
    kept = cut_lineage(dedupe.dedupe_news(news, order))
    kept = kept.withColumns({"cluster_id": text.news_cluster_id("title"), "_text": F.concat_ws(" ", "title", "raw_text", "summary")})
    targets = mapping.target_tickers(kept, order, "ticker", "_text", watchlist, companies)
    return kept.drop("ticker", "_text").join(targets, order)


def impact_report(targets: DataFrame, judgements: DataFrame, companies: DataFrame, run_date: str, run_id: str, order: str) -> DataFrame:
    """Ranked per-company report from landed judgements.

    ``judgements``: ``order``, ticker, payload. A target without a usable judgement counts
    as failed.
    """
    flags = F.coalesce("quality_flags", F.array().cast("array<string>")) if "quality_flags" in targets.columns else F.array().cast("array<string>")
    urls = F.array_compact(F.array(F.nullif("original_url", F.lit("")), F.nullif("url", F.lit(""))))
    rows = targets.select(order, "ticker", "cluster_id", flags.alias("candidate_flags"), urls.alias("evidence_urls"), F.lit(1.0).alias("candidate_confidence"))
    joined = rows.join(judgements.select(order, "ticker", "payload"), [order, "ticker"], "left")
    judged = cut_lineage(impact.judged_events(joined.withColumn("payload", F.coalesce("payload", F.lit("{}")))))
    good = judged.where(F.col("reject_reason").isNull())
    failed = judged.where(F.col("reject_reason").isNotNull()).count()  # one number
    events = good.withColumns(
        {
            "event_id": F.concat_ws("-", F.lit("news"), F.col(order).cast("string"), F.col("ticker")),
            "company": F.lit(""), "sector": F.lit(""), "already_reflected_price_move": F.lit(0.0),
        }
    )
    return impact.rank_report(impact.report_rows(events, companies, run_date, run_id, failed))
