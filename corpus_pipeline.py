"""The training-data pipeline: five stages over documents, each written before the next reads it.

1. Quality classifier: documents above the perplexity limit of their language go.
2. SimHash near-dedup: of each class, the document with the smallest doc_id stays.
3. Benchmark decontamination: documents with a benchmark passage go.
4. Mixing: each document is kept, dropped or repeated as the target weights ask.
5. Sharding: every row gets a shard of near-equal bytes and a slot in it, with the fewest bytes moved from shards by source.

All stages but the last return the columns of documents; the last adds shard and slot, in place of earlier columns of these names. Other columns may have any name. Nulls, empty texts,
repeated rows and empty tables are handled as each operator's docstring says; a table without rows passes
through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontamination, mixing, quality, sharding, simhash
from tickloom.llm.common import plain_columns, read_table
from tickloom.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, mixing.default_mix())


def resharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def placed(plain: DataFrame) -> DataFrame:
        rows = sharding.place(plain, sharding.by_source())
        return rows.select(*plain.columns, F.col("_shard").alias("shard"), F.col("_slot").cast("long").alias("slot"))

    return plain_columns(docs.drop("shard", "slot"), placed)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("source mixing", source_mixing),
    ("resharding", resharding),
]
#: The language model, the fingerprints and the flow can't be stated in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
