"""Search queries per company from names, aliases and sector keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.text import collapse
from tickloom.operators.ranking import top_per_group
from tickloom.operators.skew import first_per_key

HANGUL = "[가-힣]"
LOCALES = ("en", "ko")


def _key(c: str) -> Column:
    return F.lower(collapse(F.coalesce(F.col(c), F.lit(""))))


def sector_keyword_index(rows: DataFrame, order: str) -> DataFrame:
    """Valid keywords; of equal (sector, keyword) the highest weight, then the first row."""
    clean = rows.withColumns(
        {c: collapse(F.coalesce(F.col(c), F.lit(""))) for c in ("sector", "keyword", "locale")}
        | {"weight": F.col("weight").try_cast("double")}
    )
    clean = clean.withColumn("reject_reason", keyword_reject_reason())
    valid = clean.where(F.col("reject_reason").isNull()).drop("reject_reason")
    keyed = valid.withColumns({"_s": _key("sector"), "_k": _key("keyword")})
    return first_per_key(keyed, ["_s", "_k"], [-F.col("weight"), F.col(order)]).drop("_s", "_k")


def keyword_reject_reason() -> Column:
    bad_weight = F.col("weight").isNull() | F.isnan("weight") | (F.col("weight") < 0) | (F.col("weight") > 1)
    return (
        F.when(F.col("sector") == "", "sector must not be empty")
        .when(F.col("keyword") == "", "keyword must not be empty")
        .when(bad_weight, "weight must be between 0.0 and 1.0")
        .when(~F.col("locale").isin(*LOCALES), "locale must be one of: en, ko")
    )


def company_queries(
    companies: DataFrame, aliases: DataFrame, keywords: DataFrame, locale: str = "ko", max_keywords: int | None = None
) -> DataFrame:
    """Distinct queries per company in order: name, aliases, then the heaviest keywords of
    its sector. ``aliases`` has ticker, alias, seq."""

    def fits(c: str) -> Column:
        if locale == "all":
            return F.lit(True)
        has_hangul = F.col(c).rlike(HANGUL)
        return has_hangul if locale == "ko" else ~has_hangul

    own = companies.select("ticker", F.col("company").alias("query"), F.lit(0).alias("_step"), F.lit(0).cast("double").alias("_at"), F.lit("").alias("_tie"))
    nick = aliases.select("ticker", F.col("alias").alias("query"), F.lit(1), F.col("seq").cast("double"), F.lit(""))
    kw = keywords if locale == "all" else keywords.where(F.col("locale") == locale)
    kw = kw.withColumn("_sector", _key("sector"))
    if max_keywords is not None:
        kw = top_per_group(kw, ["_sector"], [F.col("weight").desc(), F.col("keyword").desc()], max_keywords)
    by_sector = companies.select("ticker", _key("sector").alias("_sector")).join(kw, "_sector")
    heavy = by_sector.select("ticker", F.col("keyword").alias("query"), F.lit(2), -F.col("weight"), F.col("keyword"))
    named = own.union(nick).where(F.col("query").isNotNull() & fits("query"))
    everything = named.union(heavy).withColumn("query", collapse(F.col("query"))).where(F.col("query") != "")
    # Keyword ties are ordered by keyword descending: rank them inside their company first.
    w = Window.partitionBy("ticker").orderBy("_step", "_at", F.col("_tie").desc(), "query")  # a company's few queries
    placed = everything.withColumn("_pos", F.row_number().over(w)).withColumn("_low", F.lower("query"))
    unique = first_per_key(placed.select("ticker", "_low", "query", "_pos"), ["ticker", "_low"], [F.col("_pos")])
    again = Window.partitionBy("ticker").orderBy("_pos")
    return unique.select("ticker", "query", F.row_number().over(again).alias("pos"))


def matched_keywords(news: DataFrame, doc_id: str, title: str, keywords: DataFrame) -> DataFrame:
    """(doc_id, keyword) pairs: ASCII keywords as whole words, others as substrings."""
    from tickloom.operators.mapping import phrase_hits

    texts = news.select(doc_id, F.lower(collapse(F.col(title))).alias("_t"))
    low = keywords.select(F.lower(collapse(F.col("keyword"))).alias("_k")).where(F.col("_k") != "").distinct()
    hits = phrase_hits(texts, doc_id, "_t", low, "_k").join(texts, doc_id)
    ascii_word = F.col("_k").rlike("[a-z0-9]") & F.col("_k").rlike(r"^[\x00-\x7F]+$")
    whole = F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.col("_k"), F.lit(r"\E(?![a-z0-9])"))
    standing = F.regexp_like("_t", whole)
    return hits.where(~ascii_word | standing).select(doc_id, F.col("_k").alias("keyword"))
