"""Written tables: artifacts with a manifest, publishing, merge refresh, reports."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.operators.skew import first_per_key

SCHEMA_VERSION = "1.0"
# Required fields of the portfolio report.
REPORT_FIELDS = (
    "schema_version", "run_id", "environment", "data_mode", "generated_at", "input_as_of_date", "prediction_for_date",
    "context_as_of_date", "git_commit", "config_hash", "status", "blocking_reasons", "coverage_gate", "pm_summary",
    "risk_flag_counts", "horizon_summary", "top_buy_candidates",
)


@dataclass(frozen=True)
class Written:
    """What a write put down: counted while it ran, columns as the files have them."""

    path: str
    rows: int
    columns: tuple[str, ...]
    nulls: dict[str, int]

    def missing(self, required: Sequence[str]) -> list[str]:
        return [c for c in required if c not in self.columns]


def write_artifact(df: DataFrame, path: str, csv: bool = False, required: Sequence[str] = ()) -> Written:
    """Parquet by default; ``csv`` adds a header and a byte-order mark for spreadsheet tools.
    The CSV stays split by partition: a single file would pull everything into one task.

    Rows, and nulls of the ``required`` columns, are counted by the write itself.
    """
    seen = Observation(f"written-{uuid.uuid4().hex}")
    checked = [c for c in required if c in df.columns]
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"nulls_{i}") for i, c in enumerate(checked)])
    if csv:
        first, *rest = df.columns
        marked = counted.select(F.col(f"`{first}`").alias("\ufeff" + first), *[F.col(f"`{c}`") for c in rest])
        marked.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)
        columns = [c.removeprefix("\ufeff") for c in df.sparkSession.read.option("header", True).csv(path).columns] or df.columns
    else:
        counted.write.mode("overwrite").parquet(path)
        columns = df.sparkSession.read.parquet(path).columns
    found = seen.get
    return Written(path, found.get("rows") or 0, tuple(columns), {c: found.get(f"nulls_{i}") or 0 for i, c in enumerate(checked)})


def manifest(spark: SparkSession, written: Mapping[str, Written], version: str = SCHEMA_VERSION) -> DataFrame:
    """One row per artifact with its row count and columns, without reading a row again."""
    rows = [(name, w.rows, list(w.columns), version) for name, w in written.items()]
    return spark.createDataFrame(rows, "relative_path string, row_count long, columns array<string>, schema_version string")


def contract_report(spark: SparkSession, written: Mapping[str, Written], required: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per artifact and required field: is it there, and in how many rows it is null."""
    rows = [(name, field, field in w.columns, w.nulls.get(field), w.rows) for name, w in written.items() for field in required.get(name, ())]
    return spark.createDataFrame(rows, "relative_path string, field string, present boolean, null_count long, row_count long")


def require_fields(written: Mapping[str, Written], required: Mapping[str, Sequence[str]]) -> None:
    """Raise with all missing fields of all artifacts."""
    missing = {name: gone for name, w in written.items() if (gone := w.missing(required.get(name, ())))}
    if missing:
        raise ValueError(f"required fields are missing: {missing}")


PUBLISH_LOG = "sequence long, version string, trading_date string, generated_at string, source_run_id string, mode string, symbol_count long"


def _publish_log(spark: SparkSession, root: str) -> DataFrame:
    try:
        spark.read.parquet(f"{root}/log")
    except AnalysisException as missing:  # nothing was published yet, or the first publish never ended
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], PUBLISH_LOG)
    return spark.read.schema(PUBLISH_LOG).parquet(f"{root}/log")


def publish_snapshot(
    artifacts: Mapping[str, DataFrame], root: str, trading_date: str, source_run_id: str, generated_at: str, symbol_count: int,
    mode: str = "rule_based", required: Mapping[str, Sequence[str]] | None = None,
) -> str:
    """Write a run's tables as one version; the row in the log that makes it the latest comes last.

    Readers follow the log, so they see the whole version or the one before. A publish
    that fails, because a required artifact or field is missing or a write breaks, leaves
    no row: its folder is never read. One writer at a time.
    """
    required = required or {}
    absent = [name for name in required if name not in artifacts]
    if absent:
        raise ValueError(f"artifacts to publish are missing: {absent}")
    spark = next(iter(artifacts.values())).sparkSession
    version = f"{trading_date}-{uuid.uuid4().hex}"
    written = {name: write_artifact(df, f"{root}/versions/{version}/{name}", required=required.get(name, ())) for name, df in artifacts.items()}
    require_fields(written, required)
    last = _publish_log(spark, root).agg(F.max("sequence")).first()[0]
    row = ((last or 0) + 1, version, trading_date, generated_at, source_run_id, mode, symbol_count)
    spark.createDataFrame([row], PUBLISH_LOG).coalesce(1).write.mode("append").parquet(f"{root}/log")
    return version


def published_index(spark: SparkSession, root: str) -> DataFrame:
    """The newest publish of every trading date with its metadata; ``is_latest`` marks the newest date."""
    return publish_index(_publish_log(spark, root), "sequence")


def read_published(spark: SparkSession, root: str, artifact: str, trading_date: str | None = None) -> DataFrame:
    """An artifact of the publish that was made last, or made last for a trading date."""
    log = _publish_log(spark, root)
    chosen = log if trading_date is None else log.where(F.col("trading_date") == trading_date)
    row = chosen.orderBy(F.col("sequence").desc()).limit(1).collect()  # one row
    if not row:
        raise ValueError(f"nothing is published in {root}" + (f" for {trading_date}" if trading_date else ""))
    return spark.read.parquet(f"{root}/versions/{row[0]['version']}/{artifact}")


def publish(df: DataFrame, root: str, trading_date: str = "trading_date") -> None:
    """Replace only the published dates that are in the frame. Rows go by ranges, so a date has few files and a hot one several tasks."""
    rest = [c for c in df.columns if c != trading_date]
    df.repartitionByRange(trading_date, *rest[:1]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(trading_date).parquet(root)


def publish_index(entries: DataFrame, order: str) -> DataFrame:
    """Newest entry per trading date; ``is_latest`` marks the newest date."""
    unique = first_per_key(entries, ["trading_date"], [F.col(order)], last=True)
    newest = unique.agg(F.max("trading_date").alias("_d"))
    marked = unique.join(F.broadcast(newest), F.col("trading_date") == F.col("_d"), "left")  # one row
    return marked.withColumn("is_latest", F.col("_d").isNotNull()).drop("_d")


def keep_extras(fresh: DataFrame, base: DataFrame, order: Column, core=("Date", "Symbol", "Open", "High", "Low", "Close", "Volume")) -> DataFrame:
    """Carry optional columns of the base table over to refreshed bars; of a repeated key, those of the last row in ``order``."""
    extra = [c for c in base.columns if c not in core and c not in fresh.columns]
    if not extra:
        return fresh
    last = first_per_key(base, ["Date", "Symbol"], [order], last=True).select("Date", "Symbol", *extra)
    return fresh.join(last, ["Date", "Symbol"], "left")


def merge_bars(base: DataFrame, fresh: DataFrame, order: Column) -> DataFrame:
    """Union of both; a fresh bar replaces the base bar of the same (Date, Symbol), and of equals the last in ``order`` stays."""
    rows = keep_extras(fresh, base, order).withColumn("_batch", F.lit(1))
    both = base.withColumn("_batch", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    rank = [F.col("_batch"), order]
    return first_per_key(both, ["Date", "Symbol"], rank, last=True).drop("_batch")


def next_fetch_date(bars: DataFrame, requested: str) -> DataFrame:
    """One row: the day after the last bar, not before the requested start."""
    following = F.date_add(F.max(F.col("Date").try_cast("date")), 1).cast("string")
    return bars.agg(F.greatest(F.lit(requested), following).alias("fetch_start"))


def report_json(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Report rows as JSON lines; lists are joined with semicolons."""
    kinds = dict(rows.dtypes)
    flat = [F.array_join(c, ";").alias(c) if kinds[c].startswith("array") else F.col(c) for c in columns]
    return rows.select(F.to_json(F.struct(*flat), {"ignoreNullFields": "false"}).alias("value"))


def tuning_result(marked: DataFrame, baseline_version: str) -> DataFrame:
    """One-row outcome of a weight selection: chosen variant, rejected ones, status."""
    chosen = F.max(F.when(F.col("selected"), F.col("variant_id")))
    rejected = F.sort_array(F.collect_list(F.when(F.col("rejection_reason").isNotNull(), F.concat_ws("=", "variant_id", "rejection_reason"))))
    out = marked.agg(chosen.alias("selected_variant_id"), rejected.alias("rejection_reasons"))
    return out.withColumns(
        {
            "adoption_status": F.when(F.col("selected_variant_id").isNull(), "rejected_all").otherwise("accepted"),
            "baseline_scoring_version": F.lit(baseline_version),
        }
    )


def portfolio_counts(predictions: DataFrame) -> DataFrame:
    """Counts of portfolio actions and risk flags."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("portfolio_action", "risk_flag")])
    return predictions.select(F.explode(pairs).alias("p")).select("p.*").groupBy("field", "value").agg(F.count(F.lit(1)).alias("count"))


def horizon_summary(predictions: DataFrame) -> DataFrame:
    value = F.coalesce(F.col("predicted_return"), F.lit(0.0))
    return predictions.agg(
        F.avg(value).alias("avg_predicted_return_pct"),
        F.sum(F.when(value > 0, 1).otherwise(0)).alias("positive_signal_count"),
        F.avg(F.coalesce("up_probability", F.lit(0.5))).alias("avg_up_probability"),
    )


def top_buys(predictions: DataFrame, buy_label: str, n: int = 10) -> DataFrame:
    bought = predictions.where(F.col("recommendation") == buy_label)
    return bought.orderBy(F.col("predicted_return").desc(), F.col("confidence_score").desc(), F.col("Symbol")).limit(n)


def missing_report_fields(columns: list[str]) -> list[str]:
    return [c for c in REPORT_FIELDS if c not in columns]


def overlay_session(session: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """Session rows replace the baseline rows of the same code."""
    return session.unionByName(baseline.join(session.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def latest_prediction_dates(detail: DataFrame, codes: DataFrame, code: str = "code") -> DataFrame:
    """Last prediction date per requested code, whatever suffix either side carries."""
    from tickloom.functions.text import code_of

    dates = detail.where(F.col("Date").isNotNull()).groupBy(code_of(F.col("Symbol")).alias("_code")).agg(F.max("Date").alias("Date"))
    asked = codes.withColumn("_code", code_of(F.col(code)))
    return asked.join(dates, "_code", "left").drop("_code")


def classify_export(events: DataFrame, snapshot: DataFrame, source_type: str, as_of: str, reason: str = "no_accepted_context", error: str = "") -> DataFrame:
    """Context export as event rows, else summary rows, else one explaining row."""
    shape = ["Date", "Symbol", "source_type", "title", "record_type", "collection_status", "no_data_reason", "collection_error"]

    def typed(df: DataFrame, record: str, status: str, why: str, failed: str) -> DataFrame:
        return df.withColumns(
            {"record_type": F.lit(record), "collection_status": F.lit(status), "no_data_reason": F.lit(why), "collection_error": F.lit(failed)}
        )

    if not events.isEmpty():
        return typed(events, "event", "completed", "", "").select(*shape)
    if not snapshot.isEmpty():
        column = "뉴스 요약" if source_type == "news" else "공시 요약"
        rows = snapshot.select(
            F.lit(as_of).alias("Date"), "Symbol", F.lit(f"{source_type}_summary").alias("source_type"),
            F.coalesce(F.col(column), F.lit("-")).alias("title"),
        )
        return typed(rows, "summary", "completed", "", "").select(*shape)
    status = "failed" if error else ("excluded" if reason == "context_date_gap_exceeded" else "empty")
    one = events.sparkSession.range(1).select(
        F.lit(as_of).alias("Date"), F.lit("").alias("Symbol"), F.lit(source_type).alias("source_type"), F.lit("").alias("title")
    )
    return typed(one, "no_data", status, reason, error).select(*shape)
