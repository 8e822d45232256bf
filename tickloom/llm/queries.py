"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontamination, fingerprints, hard_negatives, lexical_search, mixing, quality, secret_scan, sharding, simhash, substring_dedup, suffix_dedup, token_counts, token_files
from tickloom.llm.common import read_table
from tickloom.llm.sql import SQL
from tickloom.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = dict(SQL)


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left after every repeated window of 50 words was removed from the later documents."""
    found = substring_dedup.repeated_windows(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), token_counts.read_vocabulary())


@query
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a benchmark passage, and where."""
    found = decontamination.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.drop("key")


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under trusted text, the limit of its language, and the verdict."""
    judged = quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return judged.drop("key")


@query
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents")).drop("key")


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot after shards by source were evened out with the fewest bytes moved."""
    return sharding.assignment(read_table(spark, sf_dir, "documents"), sharding.by_source())


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in documents that the forest believes, without their values."""
    found = secret_scan.scan_secrets(read_table(spark, sf_dir, "documents"))
    return found.withColumn("value_sha256", F.sha2("value", 256)).drop("value")


@query
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often every document is in the mix of its source."""
    mixed = mixing.apply(read_table(spark, sf_dir, "documents"), mixing.default_mix())
    return mixed.select("doc_id", F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.col("_copies").alias("copies"))


@query
def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.edit_report(read_table(spark, sf_dir, "documents"))


@query
def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left after every repeated string of 50 bytes was removed from the later documents."""
    found = suffix_dedup.repeated_bytes(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of the five positives of every anchor."""
    return hard_negatives.mine(read_table(spark, sf_dir, "embeddings"))


@query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from the written files."""
    folder = scratch_path(spark, "tokens")
    token_files.write_tokens(read_table(spark, sf_dir, "documents"), folder)
    return token_files.digests(spark, folder)
