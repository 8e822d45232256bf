"""Walk-forward folds, out-of-fold consolidation, temporal splits and weight tuning."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.operators.metrics import calibration_metrics
from tickloom.operators.quantiles import exact_quantiles
from tickloom.operators.ranking import average_rank, ordinal_rank
from tickloom.operators.weight_grid import INPUTS, blended, rank_sums
from tickloom.params import FoldParams, TuningParams
from tickloom.session import written

PREDICTIONS = ["predicted_return", "up_probability", "quantile_low", "quantile_mid", "quantile_high"]
TARGETS = ["target_log_return", "target_up"]
WINDOW_BOUNDS = ["train_start", "train_end", "valid_start", "valid_end"]


def date_positions(df: DataFrame) -> DataFrame:
    """Distinct trading dates and their 0-based position. At most one row per calendar
    day, so the ordered window over them is small by nature."""
    days = df.where(F.col("Date").isNotNull()).select("Date").distinct()
    return days.withColumn("pos", F.row_number().over(Window.orderBy("Date")) - 1)


def fold_windows(df: DataFrame, p: FoldParams = FoldParams()) -> DataFrame:
    """One row per feasible fold with the dates of its train and validation windows."""
    days = date_positions(df)
    start = F.col("start")
    # The inclusive end of the sequence is n - test; an empty range has no folds.
    starts = days.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") - p.test >= p.min_train).select(
        "n", F.explode(F.sequence(F.lit(p.min_train), F.col("n").cast("int") - p.test, F.lit(p.step))).alias("start")
    )
    bounds = starts.select(
        (start - 1 - p.purge).alias("train_end_pos"),
        (start + p.embargo).alias("valid_start_pos"),
        F.least(start + p.embargo + p.test - 1, F.col("n") - 1).cast("int").alias("valid_end_pos"),
        "n",
    ).where((F.col("train_end_pos") >= 0) & (F.col("valid_start_pos") < F.col("n")))
    first = F.greatest(F.col("train_end_pos") - (p.lookback - 1), F.lit(0)) if p.lookback > 0 else F.lit(0)
    out = bounds.drop("n").withColumn("train_start_pos", first)
    out = out.withColumn("fold_id", F.row_number().over(Window.orderBy("valid_start_pos")) - 1)  # a few folds
    for name in WINDOW_BOUNDS:
        lookup = days.select(F.col("pos").alias(f"{name}_pos"), F.col("Date").alias(name))
        out = out.join(F.broadcast(lookup), f"{name}_pos")  # calendar-bounded
    return out.select("fold_id", *WINDOW_BOUNDS)


def fold_slices(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows of every fold with their role. Folds are few; rows outside both windows drop out."""
    windows = folds.select(F.collect_list(F.struct("fold_id", *WINDOW_BOUNDS)).alias("_folds"))
    attached = df.withColumn("_one", F.lit(1)).join(F.broadcast(windows.withColumn("_one", F.lit(1))), "_one").drop("_one")

    def inside(f, lo: str, hi: str):
        return F.col("Date").between(f[lo], f[hi])

    hit = F.filter("_folds", lambda f: inside(f, "train_start", "train_end") | inside(f, "valid_start", "valid_end"))
    rows = attached.withColumn("_fold", F.explode(hit)).drop("_folds")
    role = F.when(F.col("Date") <= F.col("_fold.train_end"), "train").otherwise("valid")
    return rows.withColumn("role", role).select(*df.columns, "role", "_fold.*")


def adaptive_params(p: FoldParams, n_dates: int) -> FoldParams:
    """Smaller windows for short histories."""
    test = min(p.test, max(20, int(n_dates * 0.2)))
    return replace(
        p, min_train=min(p.min_train, max(60, int(n_dates * 0.6))), test=test, step=min(p.step, max(20, test // 2))
    )


def last_dates(df: DataFrame, n: int) -> DataFrame:
    """Rows of the last n trading dates."""
    days = df.select("Date").distinct()
    keep = days.orderBy(F.col("Date").desc()).limit(n)
    return df.join(F.broadcast(keep), "Date", "left_semi")  # n rows


def consolidate_oof(raw: DataFrame) -> DataFrame:
    """One row per (Date, Symbol): mean predictions, stable values of the earliest fold,
    the number of predictions and the windows they came from. Folds bound the arrays."""
    predictions = [c for c in PREDICTIONS if c in raw.columns]
    bounds = [c for c in WINDOW_BOUNDS if c in raw.columns]
    stable = [c for c in raw.columns if c not in {"Date", "Symbol", "fold_id", *predictions, *bounds}]
    return raw.groupBy("Date", "Symbol").agg(
        *[F.min_by(c, "fold_id").alias(c) for c in stable],
        *[F.avg(c).alias(c) for c in predictions],
        F.count(F.lit(1)).alias("oof_prediction_count"),
        F.sort_array(F.collect_set(F.col("fold_id").cast("int"))).alias("fold_ids"),
        *[F.sort_array(F.collect_set(c)).alias(f"{c}_values") for c in bounds],
    )


def oof_conflicts(raw: DataFrame, stable: Sequence[str]) -> DataFrame:
    """Row counts, duplicate ratio and the number of keys whose values disagree, per column."""
    names = [*TARGETS, *[c for c in stable if c not in TARGETS]]
    present = [c for c in names if c in raw.columns]

    def differs(c: str):
        some = (F.count(c) > 0) & (F.count(c) < F.count(F.lit(1)))
        return F.when((F.min(c) != F.max(c)) | some, 1).otherwise(0).alias(c)

    keys = raw.groupBy("Date", "Symbol").agg(F.count(F.lit(1)).alias("_n"), *[differs(c) for c in present])
    rows, unique = F.sum("_n"), F.count(F.lit(1))
    return keys.agg(
        rows.alias("raw_row_count"),
        unique.alias("unique_row_count"),
        (rows - unique).alias("duplicate_row_count"),
        F.try_divide((rows - unique).cast("double"), rows.cast("double")).alias("duplicate_ratio"),
        *[F.sum(c).alias(f"conflicts_{c}") for c in present],
    )


def require_stable_targets(raw: DataFrame) -> DataFrame:
    """Raise when any (Date, Symbol) carries two different targets."""
    found = oof_conflicts(raw, []).first().asDict()
    bad = [c for c in TARGETS if found.get(f"conflicts_{c}")]
    if bad:
        raise ValueError(f"conflicting targets for the same date and symbol: {bad}")
    return raw


def temporal_split(df: DataFrame, ratio: float = 0.7, min_tune: int = 5, min_eval: int = 5) -> DataFrame:
    """Add ``split``: 'tune' for the first dates, 'eval' for the rest. Too few dates leave
    only tune rows and drop the others."""
    days = date_positions(df)
    n = days.count()  # one number
    if n < min_tune + min_eval:
        cut = min(n, min_tune)
        marked = days.where(F.col("pos") < cut).withColumn("split", F.lit("tune"))
    else:
        cut = max(min_tune, min(n - min_eval, int(n * ratio)))
        marked = days.withColumn("split", F.when(F.col("pos") < cut, "tune").otherwise("eval"))
    return df.join(F.broadcast(marked.select("Date", "split")), "Date")  # calendar-bounded


def split_calibration(df: DataFrame, prob: str = "up_probability") -> DataFrame:
    labelled = df.withColumn("_label", F.when(F.col("target_log_return") > 0, 1).otherwise(0))
    return calibration_metrics(labelled, "_label", prob, by=["split"])


def imputer_values(df: DataFrame, features: Sequence[str], neutral: dict[str, float], stored: bool = False) -> DataFrame:
    """One row of fill values: a neutral constant or the exact median, 0 when all are missing."""
    medians = exact_quantiles(df, [c for c in features if c not in neutral], stored=stored)
    fills = [float(neutral[c]) if c in neutral else medians[c] or 0.0 for c in features]
    return df.sparkSession.createDataFrame([tuple(fills)], ", ".join(f"`{c}` double" for c in features))


def impute(df: DataFrame, features: Sequence[str], values: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(values.get(c, 0.0)))) for c in features})


def trainable_rows(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Both targets present and at least one feature present."""
    known = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(True)) for c in features]).isNotNull()
    return df.where(F.col("target_log_return").isNotNull() & F.col("target_up").isNotNull() & known)


def inner_split(df: DataFrame, ratio: float) -> DataFrame:
    """Train / valid parts of the tuning rows by date; a frame of one date is both."""
    days = date_positions(df)
    n = days.count()  # one number
    if n <= 1:
        both = F.explode(F.array(F.lit("train"), F.lit("valid")))
        return df.withColumn("part", both)
    cut = min(max(1, int(n * ratio)), max(1, n - 1))
    marked = days.select("Date", F.when(F.col("pos") < cut, "train").otherwise("valid").alias("part"))
    return df.join(F.broadcast(marked), "Date")  # calendar-bounded


def _blend(w_ret: Column, w_prob: Column, w_pen: Column) -> Column:
    """The score of a row in units of 1e-12: scores that differ only by rounding noise tie."""
    return F.rint(blended([F.col(c) for c in INPUTS], w_ret, w_prob, w_pen) * 1e12)


def tuning_grid(df: DataFrame, p: TuningParams = TuningParams(), only: Sequence[int] | None = None) -> DataFrame:
    """Performance of every weight candidate on both parts, one row per candidate and part.

    ``only`` names candidates by number; the default weights have the last one. Every
    candidate's scores are ranked exactly, by ``rank_sums``, which gives the rank
    correlations and the last score of the top. One more scan of the rows sums the targets
    above that score. Of the rows that share it, the first by (Date, Symbol) fill the top:
    only they are looked at one by one.
    """
    listed = [(a, b, c) for a in p.return_weights for b in p.prob_weights for c in p.penalties] + [p.default]
    chosen = [(i, *map(float, w)) for i, w in enumerate(listed) if only is None or i in only]
    slim = written(df.select("Date", "Symbol", "norm_return", "up_probability", "uncertainty_score", "target_log_return"), "predictions")
    base = written(average_rank(inner_split(slim, p.train_ratio), ["part"], "target_log_return", "target_rank"), "ranked-targets")
    totals = rank_sums(base, chosen, p.top_share)  # a row per candidate and part

    key = ["candidate", "part"]
    # The fan-out is the fixed candidate list; what is left of it is combined before it is shuffled.
    fan = base.join(F.broadcast(totals.select(*key, "w_ret", "w_prob", "w_pen", "_cut", "_need")), "part")
    fan = fan.withColumn("score", _blend(F.col("w_ret"), F.col("w_prob"), F.col("w_pen")))
    score, cut, target = F.col("score"), F.col("_cut"), F.col("target_log_return")
    picked = {"_gain": F.sum(target), "_gains": F.count(target), "_loss": F.sum(F.when(target < 0, target)), "_losses": F.count(F.when(target < 0, 1))}
    above = fan.where((score > cut) | (cut.isNull() & score.isNotNull())).groupBy(*key).agg(*[v.alias(f"w{n}") for n, v in picked.items()])
    tied = fan.where(score.eqNullSafe(cut)).select(*key, "Date", "Symbol", "_need", "target_log_return")
    tied = ordinal_rank(tied, key, [F.col("Date"), F.col("Symbol")], "_pos")
    filled = tied.where(F.col("_pos") <= F.col("_need")).groupBy(*key).agg(*[v.alias(f"t{n}") for n, v in picked.items()])
    both = totals.join(above, key, "left").join(filled, key, "left")
    both = both.withColumns({c: F.coalesce(F.col(f"w{c}"), F.lit(0.0)) + F.coalesce(F.col(f"t{c}"), F.lit(0.0)) for c in picked})
    k = F.col("k")
    spread = F.sqrt(F.col("rr") / k - (F.col("r") / k) ** 2) * F.sqrt(F.col("tt") / k - (F.col("t") / k) ** 2)
    ic = F.try_divide(F.col("rt") / k - F.col("r") / k * F.col("t") / k, F.nullif(spread, F.lit(0.0)))
    mean = lambda total, n: F.try_divide(F.col(total), F.nullif(F.col(n).cast("double"), F.lit(0.0)))
    return both.select(
        *key, "w_ret", "w_prob", "w_pen", mean("_gain", "_gains").alias("top_return"),
        F.when(k > 0, F.coalesce(ic, F.lit(0.0))).otherwise(0.0).alias("rank_ic"), F.coalesce(-mean("_loss", "_losses"), F.lit(0.0)).alias("downside"),
    ).withColumn("objective", F.col("top_return") + p.rank_ic_weight * F.col("rank_ic") - p.downside_weight * F.col("downside"))


def tune_weights(df: DataFrame, p: TuningParams = TuningParams()) -> DataFrame:
    """One row: the chosen weights, their performance, and whether the default was kept
    because the best candidate looked overfit."""
    scores = tuning_grid(df, p)
    default_id = len(p.return_weights) * len(p.prob_weights) * len(p.penalties)
    measures = ["top_return", "rank_ic", "objective"]
    wide = scores.groupBy("candidate", "w_ret", "w_prob", "w_pen").agg(
        *[F.max(F.when(F.col("part") == part, F.col(m))).alias(f"{part}_{m}") for part in ("train", "valid") for m in measures]
    )
    a, b, c = p.default
    distance = F.abs(F.col("w_ret") - a) + F.abs(F.col("w_prob") - b) + F.abs(F.col("w_pen") - c)
    total = F.col("w_ret") + F.col("w_prob") + F.col("w_pen")
    order = F.struct(
        F.round("valid_objective", 12), F.round("valid_top_return", 12), -F.round(distance, 9), -F.round(total, 9), -F.col("candidate")
    )
    row = F.struct("w_ret", "w_prob", "w_pen", *[f"{part}_{m}" for part in ("train", "valid") for m in measures])
    is_default = F.col("candidate") == default_id
    both = wide.agg(
        F.max_by(row, F.when(~is_default, order)).alias("best"),  # candidates without an order are skipped
        F.max_by(row, F.when(is_default, F.lit(1))).alias("base"),
    )
    gap = F.col("best.train_objective") - F.col("best.valid_objective")
    keep_default = (gap > p.overfit_gap) & (
        F.col("base.valid_objective") >= F.col("best.valid_objective") - p.default_tolerance
    )
    final = F.when(keep_default, F.col("base")).otherwise(F.col("best"))
    return both.select(final.alias("f"), keep_default.alias("overfit_fallback_applied")).select(
        "f.*",
        "overfit_fallback_applied",
        (F.col("f.train_top_return") - F.col("f.valid_top_return")).alias("top_decile_generalization_gap"),
        (F.col("f.train_objective") - F.col("f.valid_objective")).alias("objective_generalization_gap"),
    )
