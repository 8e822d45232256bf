"""Queries over out-of-fold predictions: metrics, folds, tuning, portfolio."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import metrics, portfolio, scoring, validation
from tickloom.operators.ranking import top_per_group
from tickloom.params import FoldParams, PortfolioParams
from tickloom.plans.policy import FRAME, HEADS, rounded_heads, scored
from tickloom.plans.registry import query
from tickloom.plans.sqltext import BARS, RETURNS, W, d, fl, full, il, r
from tickloom.sources import tables as t
from tickloom.sources.predictions import head_predictions

P = PortfolioParams(
    top_k=5, portfolio_value=2000.0, max_participation=0.3, min_value_traded=1000.0, max_per_market_type=2, turnover_limit=1.0
)

PEARSON = "coalesce(covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0), 0)"


def pear(x: str, y: str) -> str:
    return PEARSON.format(x=x, y=y)


def auc(label: str, score: str, src: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    part2 = f"PARTITION BY {by}, {score}" if by else f"PARTITION BY {score}"
    sel, grp = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""(SELECT {sel}coalesce((sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0), 0.5) AS roc_auc
      FROM (SELECT {sel}CAST({label} AS DOUBLE) AS y, rank() OVER ({part}ORDER BY {score}) + (count(*) OVER ({part2}) - 1) / 2.0 AS rk FROM {src}) {grp})"""


@query(
    "ag04_missing_rates",
    f"""WITH {RETURNS}, m AS (SELECT *, {full("avg", '"Close"', 120)} AS ma_120, {full("stddev_samp", "log_return", 60)} AS vol_60 FROM ret)
    SELECT 'ma_120' AS feature, {r("avg(CASE WHEN ma_120 IS NULL THEN 1 ELSE 0 END)", "missing_rate")} FROM m
    UNION ALL SELECT 'vol_60', {r("avg(CASE WHEN vol_60 IS NULL THEN 1 ELSE 0 END)", "missing_rate")} FROM m""",
)
def missing_rates(spark, sf):
    from tickloom.operators import indicators

    df = indicators.price_returns(t.daily_bars(spark, sf))
    df = indicators.rolling_volatility(indicators.moving_averages(df, (120,)), (60,))
    return metrics.missing_rates(df, ["ma_120", "vol_60", "absent"])


def raw_oof(spark, sf):
    """Three overlapping folds over the prediction table: each year belongs to two or three."""
    df = head_predictions(spark, sf).select(
        "Date", "Symbol", "Close", "target_log_return", "target_up", F.col("predicted_log_return").alias("predicted_return"),
        "up_probability", "quantile_low", "quantile_mid", "quantile_high", "market_type",
    )
    fold = F.explode(F.sequence(F.lit(0), F.year("Date") % 3)).alias("fold_id")
    rows = df.select("*", fold)
    start = F.make_date(F.lit(1990) + F.col("fold_id"), F.lit(1), F.lit(1))
    return rows.withColumns(
        {
            "up_probability": F.col("up_probability") - F.col("fold_id") / 100.0,
            "market_type": F.when((F.col("fold_id") == 1) & (F.dayofmonth("Date") == 1), "moved").otherwise(F.col("market_type")),
            "train_start": F.make_date(F.lit(1990), F.lit(1), F.lit(1)),
            "train_end": start,
            "valid_start": F.date_add(start, 2),
            "valid_end": F.date_add(start, 200),
        }
    )


RAW_OOF = f"""{HEADS}, raw AS (SELECT "Date", "Symbol", "Close", target_log_return, CASE WHEN target_log_return > 0 THEN 1 ELSE 0 END AS target_up,
    predicted_log_return AS predicted_return, up_probability - fold_id / 100.0::DOUBLE AS up_probability, fold_id,
    CASE WHEN fold_id = 1 AND day("Date") = 1 THEN 'moved' ELSE market_type END AS market_type, make_date(1990 + fold_id, 1, 1) AS train_end
  FROM heads, LATERAL (SELECT unnest(range(0, year("Date") % 3 + 1)) AS fold_id))"""


@query(
    "ag05_consolidate_oof",
    f"""WITH {RAW_OOF} SELECT {d()}, "Symbol", {r("avg(up_probability)", "up_probability")}, count(*) AS oof_prediction_count,
    string_agg(fold_id, ';' ORDER BY fold_id) AS fold_ids, string_agg(train_end, ';' ORDER BY train_end) AS train_end_values,
    arg_min(market_type, fold_id) AS market_type FROM raw GROUP BY "Date", "Symbol" """,
)
def consolidate_oof(spark, sf):
    out = validation.consolidate_oof(raw_oof(spark, sf))
    return out.select("Date", "Symbol", "up_probability", "oof_prediction_count", "fold_ids", "train_end_values", "market_type")


@query(
    "ag06_oof_conflicts",
    f"""WITH {RAW_OOF}, k AS (SELECT count(*) AS n, CASE WHEN count(DISTINCT market_type) > 1 THEN 1 ELSE 0 END AS c FROM raw GROUP BY "Date", "Symbol")
    SELECT sum(n) AS raw_row_count, count(*) AS unique_row_count, sum(n) - count(*) AS duplicate_row_count, {r("(sum(n) - count(*)) / sum(n)", "duplicate_ratio")},
    0 AS conflicts_target_log_return, 0 AS conflicts_target_up, sum(c) AS conflicts_market_type FROM k""",
)
def oof_conflicts(spark, sf):
    return validation.oof_conflicts(validation.require_stable_targets(raw_oof(spark, sf)), ["market_type"])


@query(
    "ag07_regression_metrics",
    f"""WITH {HEADS} SELECT market_type, {r("avg(abs(target_log_return - predicted_log_return))", "mae")}, {r("sqrt(avg(pow(target_log_return - predicted_log_return, 2)))", "rmse")},
    {r(pear("target_log_return", "predicted_log_return"), "corr")} FROM heads GROUP BY 1""",
)
def regression_metrics(spark, sf):
    return metrics.regression_metrics(head_predictions(spark, sf), "target_log_return", "predicted_log_return", ["market_type"])


@query(
    "ag08_classification_metrics",
    f"""WITH {HEADS}, c AS (SELECT *, CASE WHEN target_log_return > 0 THEN 1 ELSE 0 END AS target_up, round(up_probability, 3) AS p FROM heads),
    a AS (SELECT market_type, avg(CASE WHEN CAST(p >= 0.5 AS INT) = target_up THEN 1 ELSE 0 END) AS accuracy FROM c GROUP BY 1)
    SELECT market_type, {r("accuracy")}, {r("roc_auc")} FROM a JOIN {auc("target_up", "p", "c", "market_type")} USING (market_type)""",
)
def classification_metrics(spark, sf):
    df = head_predictions(spark, sf).withColumn("p", F.round("up_probability", 3))
    return metrics.classification_metrics(df, "target_up", "p", ["market_type"])


CAL = f"""{HEADS}, cal0 AS (SELECT *, CASE WHEN target_log_return > 0 THEN 1 ELSE 0 END AS y, least(greatest(up_probability * 3 - 1, 0), 1) AS p FROM heads),
bins AS (SELECT (p >= 0.1)::INT + (p >= 0.2)::INT + (p >= 0.1::DOUBLE * 3)::INT + (p >= 0.4)::INT + (p >= 0.5)::INT + (p >= 0.1::DOUBLE * 6)::INT + (p >= 0.1::DOUBLE * 7)::INT
   + (p >= 0.8)::INT + (p >= 0.9)::INT AS bin, count(*) AS n, avg(p) AS conf, avg(y) AS acc, sum((p - y) * (p - y)) AS sq FROM cal0 GROUP BY 1)"""


@query(
    "ag09_calibration_bins",
    f"""WITH {CAL} SELECT bin, n AS count, {r("conf", "confidence")}, {r("acc", "accuracy")} FROM bins""",
)
def calibration_bins(spark, sf):
    df = head_predictions(spark, sf).withColumn("p", F.col("up_probability") * 3 - 1)
    return metrics.calibration_bins(df, "target_up", "p").drop("_sq")


@query(
    "ag09_calibration_metrics",
    f"""WITH {CAL} SELECT sum(n) AS sample_count, 1 AS valid, {r("sum(sq) / sum(n)", "brier")}, {r("sum(n * abs(acc - conf)) / sum(n)", "ece")} FROM bins""",
)
def calibration_metrics(spark, sf):
    df = head_predictions(spark, sf).withColumn("p", F.col("up_probability") * 3 - 1)
    return metrics.calibration_metrics(df, "target_up", "p")


@query(
    "ag10_baselines",
    f"""WITH {RETURNS}, y AS (SELECT *, ln(lead("Close") OVER ({W}) / "Close") AS tgt FROM ret),
    b AS (SELECT 'baseline_zero' AS model, tgt, CASE WHEN tgt > 0 THEN 1 ELSE 0 END AS up, 0.0::DOUBLE AS pred, 0.5::DOUBLE AS prob FROM y WHERE tgt IS NOT NULL
      UNION ALL SELECT 'baseline_prev_return', tgt, CASE WHEN tgt > 0 THEN 1 ELSE 0 END, coalesce(log_return, 0), CASE WHEN log_return > 0 THEN 1 ELSE 0 END FROM y WHERE tgt IS NOT NULL),
    m AS (SELECT model, avg(abs(tgt - pred)) AS mae, sqrt(avg(pow(tgt - pred, 2))) AS rmse, {pear("tgt", "pred")} AS corr, avg(CASE WHEN CAST(prob >= 0.5 AS INT) = up THEN 1 ELSE 0 END) AS accuracy FROM b GROUP BY 1)
    SELECT model, {r("mae")}, {r("rmse")}, {r("corr")}, {r("accuracy")}, {r("roc_auc")} FROM m JOIN {auc("up", "prob", "b", "model")} USING (model)""",
)
def baselines(spark, sf):
    from tickloom.operators import indicators

    df = indicators.next_day_target(indicators.price_returns(t.daily_bars(spark, sf)))
    return metrics.baselines(df.where(F.col("target_log_return").isNotNull()))


@query(
    "ag11_fold_metric_means",
    f"""WITH {RAW_OOF}, q AS (SELECT *, round(up_probability, 6) AS p FROM raw), m AS (SELECT fold_id, avg(abs(target_log_return - predicted_return)) AS mae, sqrt(avg(pow(target_log_return - predicted_return, 2))) AS rmse,
      {pear("target_log_return", "predicted_return")} AS corr, avg(CASE WHEN CAST(p >= 0.5 AS INT) = target_up THEN 1 ELSE 0 END) AS accuracy FROM q GROUP BY 1)
    SELECT {r("avg(mae)", "mae")}, {r("avg(rmse)", "rmse")}, {r("avg(corr)", "corr")}, {r("avg(accuracy)", "accuracy")}, {r("avg(roc_auc)", "roc_auc")}
    FROM m JOIN {auc("target_up", "p", "q", "fold_id")} USING (fold_id)""",
)
def fold_metric_means(spark, sf):
    df = raw_oof(spark, sf).withColumn("p", F.round("up_probability", 6))
    return metrics.fold_metric_means(df, "target_log_return", "predicted_return", "target_up", "p")


@query(
    "ag12_oof_diagnostics",
    f"""WITH {FRAME}, e AS (SELECT *, abs(predicted_log_return - target_log_return) AS err, target_log_return > 0 AS up FROM scored)
    SELECT {r("avg(CASE WHEN (predicted_log_return > 0) = up THEN 1 ELSE 0 END)", "direction_predicted")}, {r("avg(CASE WHEN (norm_return > 0.5) = up THEN 1 ELSE 0 END)", "direction_norm")},
    {r(pear("uncertainty_width", "err"), "corr_width_error")}, {r(pear("uncertainty_score", "err"), "corr_score_error")},
    {r("avg(CASE WHEN uncertainty_score = 0 THEN 1 ELSE 0 END)", "zero_ratio")}, {r("avg(uncertainty_score)", "mean_uncertainty")} FROM e""",
)
def oof_diagnostics(spark, sf):
    return metrics.oof_diagnostics(scoring.prediction_frame(rounded_heads(spark, sf)))


FP = FoldParams(min_train=756, test=252, step=126, purge=1, embargo=2, lookback=500)
FOLDS = f"""{BARS}, days AS (SELECT "Date", row_number() OVER (ORDER BY "Date") - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT "Date" FROM bars)),
st AS (SELECT DISTINCT n, unnest(range(756, n - 252 + 1, 126)) AS s FROM days),
fw AS (SELECT row_number() OVER (ORDER BY s) - 1 AS fold_id, greatest(s - 2 - 499, 0) AS a, s - 2 AS b, s + 2 AS v, least(s + 253, n - 1) AS e FROM st WHERE s + 2 < n),
folds AS (SELECT fold_id, a."Date" AS train_start, b."Date" AS train_end, v."Date" AS valid_start, e."Date" AS valid_end
  FROM fw JOIN days a ON a.pos = fw.a JOIN days b ON b.pos = fw.b JOIN days v ON v.pos = fw.v JOIN days e ON e.pos = fw.e)"""


@query(
    "va01_fold_windows",
    f"""WITH {FOLDS} SELECT fold_id, {d("train_start", "train_start")}, {d("train_end", "train_end")}, {d("valid_start", "valid_start")}, {d("valid_end", "valid_end")} FROM folds""",
)
def fold_windows(spark, sf):
    return validation.fold_windows(t.daily_bars(spark, sf), FP)


@query(
    "va02_fold_slices",
    f"""WITH {FOLDS} SELECT {d('bars."Date"')}, bars."Symbol", fold_id, CASE WHEN bars."Date" <= train_end THEN 'train' ELSE 'valid' END AS role
    FROM bars JOIN folds ON bars."Date" BETWEEN train_start AND train_end OR bars."Date" BETWEEN valid_start AND valid_end""",
)
def fold_slices(spark, sf):
    bars = t.daily_bars(spark, sf).select("Date", "Symbol")
    return validation.fold_slices(bars, validation.fold_windows(bars, FP)).select("Date", "Symbol", "fold_id", "role")


@query(
    "jn18_fold_range_join",
    f"""WITH {FOLDS} SELECT fold_id, sum(CASE WHEN bars."Date" <= train_end THEN 1 ELSE 0 END) AS train_rows, sum(CASE WHEN bars."Date" > train_end THEN 1 ELSE 0 END) AS valid_rows
    FROM bars JOIN folds ON bars."Date" BETWEEN train_start AND train_end OR bars."Date" BETWEEN valid_start AND valid_end GROUP BY 1""",
)
def fold_range_join(spark, sf):
    bars = t.daily_bars(spark, sf).select("Date", "Symbol")
    rows = validation.fold_slices(bars, validation.fold_windows(bars, FP))
    count = lambda role: F.sum(F.when(F.col("role") == role, 1).otherwise(0)).alias(f"{role}_rows")
    return rows.groupBy("fold_id").agg(count("train"), count("valid"))


@query(
    "va03_adaptive_windows",
    f"""WITH {BARS}, n AS (SELECT count(DISTINCT "Date") AS n FROM bars),
    p AS (SELECT n, least(5000, greatest(60, CAST(floor(n * 0.6) AS INT))) AS a, least(1000, greatest(20, CAST(floor(n * 0.2) AS INT))) AS t FROM n)
    SELECT count(*) AS folds, min(s) AS first_start, max(s) AS last_start FROM (SELECT unnest(range(a, n - t + 1, least(500, greatest(20, t // 2)))) AS s FROM p)""",
)
def adaptive_windows(spark, sf):
    """Windows that do not fit the history are shrunk and the folds drawn again."""
    bars = t.daily_bars(spark, sf).select("Date", "Symbol")
    wanted = FoldParams(min_train=5000, test=1000, step=500)
    folds = validation.fold_windows(bars, wanted)
    if folds.count() < wanted.min_folds:
        n = bars.select("Date").distinct().count()
        folds = validation.fold_windows(bars, validation.adaptive_params(wanted, n))
    days = validation.date_positions(bars).withColumnRenamed("Date", "valid_start")
    return folds.join(F.broadcast(days), "valid_start").agg(
        F.count(F.lit(1)).alias("folds"), F.min("pos").alias("first_start"), F.max("pos").alias("last_start")
    )


@query(
    "tk07_last_trading_dates",
    f"""WITH {BARS} SELECT {d()}, "Symbol" FROM bars WHERE "Date" IN (SELECT DISTINCT "Date" FROM bars ORDER BY 1 DESC LIMIT 60)""",
)
def last_trading_dates(spark, sf):
    return validation.last_dates(t.daily_bars(spark, sf).select("Date", "Symbol"), 60)


IMPUTE_SRC = f"""{HEADS}, src AS (SELECT "Date", "Symbol", CASE WHEN daily_return > 0 THEN ret_5d END AS a, CASE WHEN day("Date") > 3 THEN rsi_14 END AS rsi_14 FROM heads)"""


@query(
    "va04_imputer",
    f"""WITH {IMPUTE_SRC}, m AS (SELECT median(a) AS med FROM src) SELECT {d()}, "Symbol", {r("coalesce(a, med)", "a")}, {r("coalesce(rsi_14, 50)", "rsi_14")}, 0.0::DOUBLE AS empty FROM src, m""",
)
def imputer(spark, sf):
    df = head_predictions(spark, sf).select(
        "Date", "Symbol",
        F.when(F.col("daily_return") > 0, F.col("ret_5d")).alias("a"),
        F.when(F.dayofmonth("Date") > 3, F.col("rsi_14")).alias("rsi_14"),
        F.lit(None).cast("double").alias("empty"),
    )
    names = ["a", "rsi_14", "empty"]
    values = validation.imputer_values(df, names, {"rsi_14": 50.0}).first().asDict()
    return validation.impute(df, names, values)


@query(
    "va05_trainable_rows",
    f"""WITH {IMPUTE_SRC} SELECT {d()}, "Symbol" FROM src WHERE a IS NOT NULL OR rsi_14 IS NOT NULL""",
)
def trainable_rows(spark, sf):
    df = head_predictions(spark, sf).withColumns(
        {"a": F.when(F.col("daily_return") > 0, F.col("ret_5d")), "rsi_14": F.when(F.dayofmonth("Date") > 3, F.col("rsi_14"))}
    )
    return validation.trainable_rows(df, ["a", "rsi_14"]).select("Date", "Symbol")


SPLIT = f"""{HEADS}, dd AS (SELECT "Date", row_number() OVER (ORDER BY "Date") AS k, count(*) OVER () AS n FROM (SELECT DISTINCT "Date" FROM heads)),
sp AS (SELECT heads.*, CASE WHEN k <= floor(n * 0.7) THEN 'tune' ELSE 'eval' END AS split FROM heads JOIN dd USING ("Date"))"""


@query("va10_temporal_split", f"""WITH {SPLIT} SELECT {d()}, "Symbol", split FROM sp""")
def temporal_split(spark, sf):
    return validation.temporal_split(head_predictions(spark, sf)).select("Date", "Symbol", "split")


@query(
    "va12_split_calibration",
    f"""WITH {SPLIT}, b AS (SELECT split, least(floor(up_probability * 10), 9) AS bin, count(*) AS n, avg(up_probability) AS conf, avg(CASE WHEN target_log_return > 0 THEN 1 ELSE 0 END) AS acc,
      sum(pow(up_probability - CASE WHEN target_log_return > 0 THEN 1 ELSE 0 END, 2)) AS sq FROM sp GROUP BY 1, 2)
    SELECT split, sum(n) AS sample_count, 1 AS valid, {r("sum(sq) / sum(n)", "brier")}, {r("sum(n * abs(acc - conf)) / sum(n)", "ece")} FROM b GROUP BY 1""",
)
def split_calibration(spark, sf):
    return validation.split_calibration(validation.temporal_split(head_predictions(spark, sf)))


GRID = f"""{FRAME}, td AS (SELECT "Date", row_number() OVER (ORDER BY "Date") AS k, count(*) OVER () AS n FROM (SELECT DISTINCT "Date" FROM scored)),
tb AS (SELECT scored.*, CASE WHEN k <= floor(n * 0.7) THEN 'train' ELSE 'valid' END AS part FROM scored JOIN td USING ("Date")),
tr AS (SELECT *, rank() OVER (PARTITION BY part ORDER BY target_log_return) + (count(*) OVER (PARTITION BY part, target_log_return) - 1) / 2.0 AS trk, count(*) OVER (PARTITION BY part) AS m FROM tb),
g AS (SELECT a.v AS w_ret, b.v AS w_prob, c.v AS w_pen, (a.i * 3 + b.i) * 3 + c.i AS candidate FROM
   (VALUES (0, 0.3::DOUBLE), (1, 0.45), (2, 0.6), (3, 0.65)) a(i, v), (VALUES (0, 0.2::DOUBLE), (1, 0.35), (2, 0.5)) b(i, v), (VALUES (0, 0.15::DOUBLE), (1, 0.25), (2, 0.35)) c(i, v)
   UNION ALL SELECT 0.65, 0.35, 0.25, 36),
sc AS (SELECT tr.*, g.*, round(norm_return * w_ret + up_probability * w_prob - uncertainty_score * w_pen, 12) AS score FROM tr, g),
rk AS (SELECT *, row_number() OVER (PARTITION BY candidate, part ORDER BY score DESC, "Date", "Symbol") AS pos,
   rank() OVER (PARTITION BY candidate, part ORDER BY score) + (count(*) OVER (PARTITION BY candidate, part, score) - 1) / 2.0 AS srk FROM sc),
perf AS (SELECT candidate, part, w_ret, w_prob, w_pen, avg(target_log_return) FILTER (pos <= greatest(1, floor(m * 0.1))) AS top_return, {pear("srk", "trk")} AS rank_ic,
   coalesce(-avg(target_log_return) FILTER (pos <= greatest(1, floor(m * 0.1)) AND target_log_return < 0), 0) AS downside FROM rk GROUP BY ALL),
obj AS (SELECT *, top_return + 0.10 * rank_ic - 0.25 * downside AS objective FROM perf)"""


@query(
    "va13_tuning_grid",
    f"""WITH {GRID} SELECT candidate, part, {r("w_ret")}, {r("w_prob")}, {r("w_pen")}, {r("top_return")}, {r("rank_ic")}, {r("downside")}, {r("objective")} FROM obj""",
)
def tuning_grid(spark, sf):
    return validation.tuning_grid(scoring.prediction_frame(rounded_heads(spark, sf)))


@query(
    "tk03_top_decile",
    f"""WITH {GRID} SELECT part, {r("top_return")}, {r("downside")} FROM obj WHERE candidate = 36""",
)
def top_decile(spark, sf):
    frame = scoring.prediction_frame(rounded_heads(spark, sf))
    return validation.tuning_grid(frame, only=[36]).select("part", "top_return", "downside")


@query(
    "va13_tuned_weights",
    f"""WITH {GRID}, w AS (SELECT candidate, w_ret, w_prob, w_pen, max(objective) FILTER (part = 'train') AS tobj, max(objective) FILTER (part = 'valid') AS vobj,
      max(top_return) FILTER (part = 'train') AS ttop, max(top_return) FILTER (part = 'valid') AS vtop FROM obj GROUP BY ALL),
    best AS (SELECT * FROM w WHERE candidate < 36 ORDER BY round(vobj, 12) DESC, round(vtop, 12) DESC, round(abs(w_ret - 0.65) + abs(w_prob - 0.35) + abs(w_pen - 0.25), 9), round(w_ret + w_prob + w_pen, 9), candidate LIMIT 1),
    base AS (SELECT * FROM w WHERE candidate = 36),
    pick AS (SELECT best.tobj - best.vobj > 0.15 AND base.vobj >= best.vobj - 0.02 AS fb FROM best, base),
    f AS (SELECT fb, x.* FROM pick, (SELECT *, false AS k FROM best UNION ALL SELECT *, true FROM base) x WHERE x.k = fb)
    SELECT {r("w_ret")}, {r("w_prob")}, {r("w_pen")}, {r("tobj", "train_objective")}, {r("vobj", "valid_objective")}, {r("vtop", "valid_top_return")}, CAST(fb AS INT) AS overfit_fallback_applied FROM f""",
)
def tuned_weights(spark, sf):
    out = validation.tune_weights(scoring.prediction_frame(rounded_heads(spark, sf)))
    return out.select("w_ret", "w_prob", "w_pen", "train_objective", "valid_objective", "valid_top_return", "overfit_fallback_applied")


@query(
    "va14_rescore",
    f"""WITH {FRAME}, z AS (SELECT *, 0.3::DOUBLE * norm_return + 0.5::DOUBLE * up_probability - 0.15::DOUBLE * uncertainty_score + boost AS s FROM scored)
    SELECT {d()}, "Symbol", {r("s", "signal_score")}, count(*) OVER (PARTITION BY "Date") AS rank_universe_size, CASE WHEN s <= 0.25 THEN 'strong_negative' WHEN s <= 0.45 THEN 'weak_negative'
    WHEN s <= 0.55 THEN 'neutral' WHEN s <= 0.75 THEN 'weak_positive' ELSE 'strong_positive' END AS signal_label FROM z""",
)
def rescore(spark, sf):
    out = scoring.rescore(scored(spark, sf), (0.3, 0.5, 0.15), "normal", t.rows_per_date(spark, sf))
    return out.select("Date", "Symbol", "signal_score", "rank_universe_size", "signal_label")


def book(spark, sf):
    """Portfolio input: forecasts with liquidity, market type and a halted name now and then."""
    df = head_predictions(spark, sf)
    return df.select(
        "Date", "Symbol", "value_traded", "vol_ratio_20", "market_type", "up_probability",
        (F.col("target_log_return") * 0.02).alias("target_log_return"), F.col("predicted_log_return").alias("predicted_return"), F.col("up_probability").alias("signal_score"),
        F.least(F.col("vol_20") * 10.0, F.lit(1.0)).alias("uncertainty_score"), (F.col("daily_return") * 0.02).alias("ks11_ret_1d"),
        F.when(F.col("turnover_rank_daily") == 30, "HALT").otherwise("ok").alias("coverage_gate_status"),
        (F.col("turnover_rank_daily") / 10.0).alias("investor_coverage_ratio"),
    )


BOOK = f"""{HEADS}, book AS (SELECT "Date", "Symbol", target_log_return * 0.02::DOUBLE AS target_log_return, value_traded, vol_ratio_20, market_type, up_probability, predicted_log_return AS predicted_return,
  least(vol_20 * 10.0, 1.0) AS uncertainty_score, daily_return * 0.02::DOUBLE AS mkt, turnover_rank_daily = 30 AS stop, turnover_rank_daily / 10.0::DOUBLE AS inv FROM heads),
halts AS (SELECT "Date", bool_or(stop) OR avg(inv) < 0.5 AS halted, coalesce(avg(mkt), 0) AS benchmark_return FROM book GROUP BY 1),
elig AS (SELECT *, value_traded * 0.3::DOUBLE AS cap_notional FROM book WHERE up_probability >= 0.5 AND value_traded >= 1000 AND value_traded * 0.3::DOUBLE >= 400),
cand AS (SELECT *, row_number() OVER (PARTITION BY "Date" ORDER BY predicted_return DESC, up_probability DESC, "Symbol") AS pos FROM elig QUALIFY pos <= 15),
kept AS (SELECT *, row_number() OVER (PARTITION BY "Date" ORDER BY pos) AS k FROM (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY "Date", market_type ORDER BY pos) <= 2) QUALIFY k <= 5),
sel AS (SELECT kept.* FROM kept JOIN halts USING ("Date") WHERE NOT halted)"""


@query("pt01_coverage_halts", f"""WITH {BOOK} SELECT {d()}, CAST(halted AS INT) AS halted, {r("benchmark_return")} FROM halts""")
def coverage_halts(spark, sf):
    return portfolio.coverage_halts(book(spark, sf), P).drop("strategy")


@query("pt06_benchmark", f"""WITH {BOOK} SELECT {d()}, {r("benchmark_return")} FROM halts""")
def benchmark(spark, sf):
    return portfolio.coverage_halts(book(spark, sf), P).select("Date", "benchmark_return")


@query("pf27_liquidity_capacity", f"""WITH {BOOK} SELECT {d()}, "Symbol", {r("cap_notional", "max_capacity_notional")} FROM elig""")
def liquidity_capacity(spark, sf):
    return portfolio.eligible(book(spark, sf), P).select("Date", "Symbol", "max_capacity_notional")


@query("tk01_candidates", f"""WITH {BOOK} SELECT {d()}, "Symbol", pos FROM cand""")
def candidates(spark, sf):
    return portfolio.candidates(book(spark, sf), P).select("Date", "Symbol", "pos")


@query("tk02_market_type_caps", f"""WITH {BOOK} SELECT {d()}, "Symbol", pos FROM kept""")
def market_type_caps(spark, sf):
    return portfolio.cap_market_types(portfolio.candidates(book(spark, sf), P), P).select("Date", "Symbol", "pos")


PT2 = f"""WITH RECURSIVE {BOOK},
dl AS (SELECT "Date", halted, row_number() OVER (ORDER BY "Date") AS n FROM halts),
cl AS (SELECT dl.n, dl."Date", CASE WHEN halted THEN []::VARCHAR[] ELSE coalesce(syms, []::VARCHAR[]) END AS syms
       FROM dl LEFT JOIN (SELECT "Date", list("Symbol" ORDER BY pos) AS syms FROM kept GROUP BY 1) USING ("Date")),
walk AS (SELECT 0::BIGINT AS n, []::VARCHAR[] AS held UNION ALL
  SELECT c.n, CASE WHEN len(w.held) > 0 AND len(c.syms) > 0 THEN list_concat(list_filter(c.syms, lambda s: list_contains(w.held, s))[:5 - 2], list_filter(c.syms, lambda s: NOT list_contains(w.held, s))[:2]) ELSE c.syms[:5] END
  FROM walk w JOIN cl c ON c.n = w.n + 1)"""


@query("pt02_turnover_limit", PT2 + f""" SELECT {d('cl."Date"')}, unnest(held) AS "Symbol" FROM walk JOIN cl USING (n)""")
def turnover_limit(spark, sf):
    from dataclasses import replace

    return portfolio.select_portfolio(book(spark, sf), replace(P, turnover_limit=0.5)).select("Date", "Symbol")


WEIGHTS = f"""{BOOK}, c0 AS (SELECT *, least(greatest(cap_notional / 2000.0, 0), 1) AS cap FROM sel),
c1 AS (SELECT *, (1.0 - coalesce(sum(cap) OVER (PARTITION BY "Date" ORDER BY cap, "Symbol" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / (count(*) OVER (PARTITION BY "Date") - row_number() OVER (PARTITION BY "Date" ORDER BY cap, "Symbol") + 1) AS lv FROM c0),
wt AS (SELECT *, least(cap, max(lv) OVER (PARTITION BY "Date")) AS weight FROM c1),
gross AS (SELECT "Date", sum((exp(target_log_return) - 1) * weight) AS gross_return, sum(weight) AS invested_weight,
   avg(uncertainty_score) + avg(greatest(vol_ratio_20 - 1, 0)) AS dyn_penalty, count(*) AS selected_count, count(DISTINCT market_type) AS market_type_count, list("Symbol" ORDER BY "Symbol") AS hold FROM wt GROUP BY 1),
dy AS (SELECT h."Date", halted, benchmark_return, coalesce(gross_return, 0) AS gross_return, coalesce(invested_weight, 0) AS invested_weight, coalesce(dyn_penalty, 0) AS dyn_penalty,
   coalesce(selected_count, 0) AS selected_count, coalesce(market_type_count, 0) AS market_type_count, coalesce(hold, []::VARCHAR[]) AS hold FROM halts h LEFT JOIN gross USING ("Date")),
dz AS (SELECT *, lag(hold) OVER (ORDER BY "Date") AS ph FROM dy),
dt AS (SELECT *, CASE WHEN ph IS NULL THEN 0 ELSE (len(list_filter(ph, lambda x: NOT list_contains(hold, x))) + len(list_filter(hold, lambda x: NOT list_contains(ph, x))))::DOUBLE / greatest(len(list_distinct(list_concat(ph, hold))), 1) END AS turnover FROM dz),
du AS (SELECT *, CASE WHEN ph IS NULL OR len(ph) = 0 OR len(hold) = 0 THEN 0 ELSE turnover END AS ct FROM dt),
ser AS (SELECT *, gross_return - (15.0 / 10000 + 10.0 * (ct + dyn_penalty) / 10000.0) * invested_weight AS daily_return FROM du),
eq AS (SELECT *, product(1 + daily_return) OVER w AS equity, product(1 + benchmark_return) OVER w AS beq FROM ser WINDOW w AS (ORDER BY "Date" ROWS UNBOUNDED PRECEDING)),
ddn AS (SELECT *, equity / max(equity) OVER (ORDER BY "Date" ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM eq)"""


@query("pt03_capacity_weights", f"""WITH {WEIGHTS} SELECT {d()}, "Symbol", {r("weight")} FROM wt""")
def capacity_weights(spark, sf):
    return portfolio.capacity_weights(portfolio.select_portfolio(book(spark, sf), P), P).select("Date", "Symbol", "weight")


@query("pt04_weighted_return", f"""WITH {WEIGHTS} SELECT {d()}, {r("gross_return")}, {r("invested_weight")} FROM gross""")
def weighted_return(spark, sf):
    picked = portfolio.capacity_weights(portfolio.select_portfolio(book(spark, sf), P), P)
    return portfolio.daily_gross(picked).select("Date", "gross_return", "invested_weight")


@query("pt05_costs", f"""WITH {WEIGHTS} SELECT {d()}, {r("dyn_penalty")}, {r("ct", "cost_turnover")}, {r("daily_return")} FROM ser""")
def costs(spark, sf):
    return portfolio.daily_series(book(spark, sf), P).select("Date", "dyn_penalty", "cost_turnover", "daily_return")


@query("st07_holding_changes", f"""WITH {WEIGHTS} SELECT {d()}, selected_count, {r("turnover")} FROM ser""")
def holding_changes(spark, sf):
    return portfolio.daily_series(book(spark, sf), P).select("Date", "selected_count", "turnover")


@query("wn29_equity_drawdown", f"""WITH {WEIGHTS} SELECT {d()}, {r("equity")}, {r("drawdown")} FROM ddn""")
def equity_drawdown(spark, sf):
    return portfolio.daily_series(book(spark, sf), P).select("Date", "equity", "drawdown")


@query(
    "pt07_cost_scenarios",
    f"""WITH {WEIGHTS} SELECT scenario, {r("product(1 + gross_return - (10.0 + 5.0 * m + 10.0 * (m * dyn_penalty + ct)) / 10000.0 * invested_weight) - 1", "cum_return")}
    FROM ser, (VALUES ('conservative', 1.5::DOUBLE), ('neutral', 1.0), ('aggressive', 0.75)) s(scenario, m) GROUP BY 1""",
)
def cost_scenarios(spark, sf):
    return portfolio.scenario_results(portfolio.daily_series(book(spark, sf), P), P).drop("strategy")


SUMMARY_SQL = f"""SELECT count(*) AS days, {r('arg_max(equity, "Date") - 1', "cum_return")}, {r("avg(daily_return)", "avg_daily_return")},
  {r("coalesce(sqrt(252.0) * avg(daily_return) / nullif(stddev_samp(daily_return), 0), 0)", "sharpe")}, {r("min(drawdown)", "max_drawdown")}, {r("avg(turnover)", "avg_turnover")},
  {r("avg(selected_count)", "avg_selected_count")}, {r('arg_max(beq, "Date") - 1', "benchmark_cum_return")}, {r('arg_max(equity, "Date") - arg_max(beq, "Date")', "excess_cum_return")},
  sum(halted::INT) AS halted_days, sum((NOT halted AND selected_count = 0)::INT) AS liquidity_blocked_days, {r("avg(market_type_count)", "avg_market_type_count")} FROM ddn"""


@query("pt08_portfolio_summary", f"""WITH {WEIGHTS} {SUMMARY_SQL}""")
def portfolio_summary(spark, sf):
    return portfolio.summary(portfolio.daily_series(book(spark, sf), P)).drop("strategy")


@query(
    "ag26_result_validity",
    f"""WITH {WEIGHTS}, s AS (SELECT count(*) AS days, sum(halted::INT) AS h, avg(selected_count) AS c FROM ddn)
    SELECT days, concat_ws(';', 'tradable_prediction_count_zero', CASE WHEN h >= days THEN 'all_days_halted' END, CASE WHEN c <= 0 THEN 'avg_selected_count_zero' END) AS blocking_reasons, 0 AS backtest_valid FROM s""",
)
def result_validity(spark, sf):
    summary = portfolio.summary(portfolio.daily_series(book(spark, sf), P))
    return portfolio.validity(summary, F.lit(0)).select("days", "blocking_reasons", "backtest_valid")
