"""Evaluation metrics as aggregations. Every function takes optional group columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import clip, flag, number
from tickloom.operators.ranking import running_total


def pearson(x: Column, y: Column) -> Column:
    """Correlation of the pairs without gaps; 0 when either side does not vary."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.coalesce(F.try_divide(F.covar_pop(a, b), F.nullif(spread, F.lit(0.0))), F.lit(0.0))


def missing_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of missing values per column in one pass, one row per column."""
    present = [c for c in columns if c in df.columns]
    wide = df.agg(*[F.avg(F.when(F.col(c).isNull(), 1.0).otherwise(0.0)).alias(c) for c in present])
    return wide.unpivot([], present, "feature", "missing_rate")


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    error = F.col(actual) - F.col(predicted)
    return df.groupBy(*by).agg(
        F.coalesce(F.avg(F.abs(error)), F.lit(0.0)).alias("mae"),
        F.coalesce(F.sqrt(F.avg(error * error)), F.lit(0.0)).alias("rmse"),
        pearson(F.col(actual), F.col(predicted)).alias("corr"),
    )


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the curve from average ranks; 0.5 with a single class.

    Rows are reduced to one per distinct score before the ordered sum, which runs in
    slices over the whole table.
    """
    counts = df.groupBy(*by, score).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("_pos"), F.count(F.lit(1)).alias("_n")
    )
    ranked = running_total(counts, [F.col(score).asc()], "_n", "_upto", by)
    mean_rank = F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2.0
    sums = ranked.groupBy(*by).agg(
        F.sum(F.col("_pos") * mean_rank).alias("_ranks"), F.sum("_pos").alias("_p"), F.sum("_n").alias("_all")
    )
    p, q = F.col("_p").cast("double"), (F.col("_all") - F.col("_p")).cast("double")
    area = F.try_divide(F.col("_ranks") - p * (p + 1) / 2.0, F.nullif(p * q, F.lit(0.0)))
    return sums.select(*by, F.coalesce(area, F.lit(0.5)).alias("roc_auc"))


def accuracy(df: DataFrame, label: str, score: str, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    hit = (F.col(score) >= threshold).cast("int") == F.col(label)
    return df.groupBy(*by).agg(F.coalesce(F.avg(flag(hit)), F.lit(0.0)).alias("accuracy"))


def classification_metrics(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    acc, auc = accuracy(df, label, score, by=by), roc_auc(df, label, score, by)
    if by:
        return acc.join(auc, list(by))
    return acc.withColumn("_k", F.lit(1)).join(auc.withColumn("_k", F.lit(1)), "_k").drop("_k")  # one row each


def fold_metric_means(df: DataFrame, actual: str, predicted: str, label: str, score: str, fold: str = "fold_id") -> DataFrame:
    """Mean over folds of each fold's metrics."""
    per_fold = regression_metrics(df, actual, predicted, [fold]).join(classification_metrics(df, label, score, [fold]), fold)
    return per_fold.agg(*[F.avg(c).alias(c) for c in ("mae", "rmse", "corr", "accuracy", "roc_auc")])


def calibration_bins(df: DataFrame, label: str, prob: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width reliability bins, the last one closed on the right."""
    p = clip(prob, 0.0, 1.0)
    edges = [i * (1.0 / bins) for i in range(1, bins)]
    index = reduce(lambda acc, e: acc + F.when(p >= e, 1).otherwise(0), edges, F.lit(0))
    work = df.where(F.col(prob).isNotNull()).select(*by, p.alias("_p"), F.col(label).cast("double").alias("_y"), index.alias("bin"))
    return work.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("_p").alias("confidence"),
        F.avg("_y").alias("accuracy"),
        F.sum((F.col("_p") - F.col("_y")) * (F.col("_p") - F.col("_y"))).alias("_sq"),
    )


def calibration_metrics(
    df: DataFrame, label: str, prob: str, bins: int = 10, min_samples: int = 20, by: Sequence[str] = ()
) -> DataFrame:
    """Brier score and expected calibration error; both missing below ``min_samples``."""
    table = calibration_bins(df, label, prob, bins, by)
    n = F.sum("count")
    gap = F.sum(F.col("count") * F.abs(F.col("accuracy") - F.col("confidence")))
    enough = n >= min_samples
    return table.groupBy(*by).agg(
        F.coalesce(n, F.lit(0)).alias("sample_count"),
        F.coalesce(enough, F.lit(False)).alias("valid"),
        F.when(enough, F.sum("_sq") / n).alias("brier"),
        F.when(enough, gap / n).alias("ece"),
    )


def baselines(df: DataFrame) -> DataFrame:
    """Metrics of the zero forecast and of repeating the previous return, one row each."""
    previous = F.coalesce(F.col("log_return"), F.lit(0.0))
    stacked = df.select(
        "target_log_return",
        "target_up",
        F.explode(
            F.array(
                F.struct(F.lit("baseline_zero").alias("model"), F.lit(0.0).alias("pred"), F.lit(0.5).alias("prob")),
                F.struct(F.lit("baseline_prev_return").alias("model"), previous.alias("pred"), flag(previous > 0).alias("prob")),
            )
        ).alias("b"),
    ).select("target_log_return", "target_up", "b.*")
    reg = regression_metrics(stacked, "target_log_return", "pred", ["model"])
    return reg.join(classification_metrics(stacked, "target_up", "prob", ["model"]), "model")


def oof_diagnostics(df: DataFrame) -> DataFrame:
    needed = ["target_log_return", "norm_return", "predicted_log_return", "uncertainty_score", "uncertainty_width"]
    rows = df.select(*[number(c).alias(c) for c in needed]).dropna()
    up = F.col("target_log_return") > 0
    error = F.abs(F.col("predicted_log_return") - F.col("target_log_return"))
    return rows.agg(
        F.avg(flag((F.col("predicted_log_return") > 0) == up)).alias("direction_predicted"),
        F.avg(flag((F.col("norm_return") > 0.5) == up)).alias("direction_norm"),
        pearson(F.col("uncertainty_width"), error).alias("corr_width_error"),
        pearson(F.col("uncertainty_score"), error).alias("corr_score_error"),
        F.avg(flag(F.col("uncertainty_score") == 0)).alias("zero_ratio"),
        F.avg("uncertainty_score").alias("mean_uncertainty"),
    )
