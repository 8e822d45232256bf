"""Text helpers: normalised keys, stable ids, symbols and suspicious-text flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that mark text trying to steer a reader, and the text limit of one judgement.
INJECTION_PHRASES = (
    "ignore previous instructions", "forget previous instructions", "system prompt", "recommend buying",
    "recommend selling", "buy this stock", "sell this stock", "이전 지시를 무시", "앞선 지시를 무시", "시스템 프롬프트",
    "매수를 추천", "매도 추천", "이 종목 매수", "이 종목 매도",
)
MAX_ARTICLE_CHARS = 1500


def collapse(c: Column) -> Column:
    """Single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def title_key(c: str | Column) -> Column:
    """Lower case, punctuation to spaces, single spaces."""
    v = F.col(c) if isinstance(c, str) else c
    return collapse(F.regexp_replace(F.lower(v), r"(?U)[^\p{L}\p{N}_\s가-힣]", " "))


def title_cluster_key(c: str | Column) -> Column:
    """Like ``title_key`` but punctuation is removed instead of spaced."""
    v = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(collapse(v)), r"(?U)[^\p{L}\p{N}_\s가-힣]", "")


def url_key(c: str | Column) -> Column:
    v = F.col(c) if isinstance(c, str) else c
    return F.rtrim(F.lower(F.trim(v)), F.lit("/"))


def plain_text(c: str | Column) -> Column:
    """Lower case and single spaces, the form phrases are matched in."""
    v = F.col(c) if isinstance(c, str) else c
    return collapse(F.lower(v))


def stable_id(*parts: Column | str, length: int = 16) -> Column:
    cols = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha1(F.concat_ws("|", *cols)), 1, length)


def news_cluster_id(title: str | Column) -> Column:
    return F.concat(F.lit("cluster-"), F.substring(F.sha1(F.concat(F.lit("news:"), title_key(title))), 1, 12))


def disclosure_cluster_id(receipt: str | Column) -> Column:
    v = F.col(receipt) if isinstance(receipt, str) else receipt
    return F.concat(F.lit("cluster-"), F.substring(F.sha1(F.concat(F.lit("disclosure:"), v)), 1, 12))


def contains_any(c: Column, words) -> Column:
    """True when any of a short, fixed list of words occurs."""
    found = F.lit(False)
    for word in words:
        found = found | F.contains(c, F.lit(word))
    return found


def injection_flag(c: str | Column) -> Column:
    v = F.col(c) if isinstance(c, str) else c
    return F.when(contains_any(F.lower(v), INJECTION_PHRASES), "prompt_injection_risk")


def flags(*items: Column) -> Column:
    """Distinct flags in order; missing ones drop out."""
    return F.array_distinct(F.array_compact(F.array(*items)))


def article_input(raw: Column, summary: Column, base_flags: Column) -> tuple[Column, Column, Column]:
    """Text to judge, its flags, and whether there is a usable text."""
    has_raw = F.coalesce(raw, F.lit("")) != ""
    text = F.when(has_raw, raw).otherwise(F.coalesce(summary, F.lit("")))
    extra = F.when(has_raw, F.array(injection_flag(raw))).otherwise(
        F.array(F.lit("summary_only_no_full_text"), F.lit("needs_full_text_review"))
    )
    cut = F.array(F.when(F.length(text) > MAX_ARTICLE_CHARS, "article_truncated"))
    all_flags = F.array_distinct(F.array_compact(F.concat(base_flags, extra, cut)))
    return F.substring(text, 1, MAX_ARTICLE_CHARS), all_flags, has_raw


def ticker(symbol: str | Column) -> Column:
    """Six-digit ticker of a symbol, missing when it has none."""
    head = F.split_part(F.trim(F.col(symbol) if isinstance(symbol, str) else symbol), F.lit("."), F.lit(1))
    return F.when(head.rlike(r"^\d{6}$"), head)


def market(symbol: str | Column) -> Column:
    v = F.upper(F.col(symbol) if isinstance(symbol, str) else symbol)
    return F.when(v.endswith(".KQ"), "KOSDAQ").otherwise("KOSPI")


def provider_symbol(code: Column, known: Column | None = None) -> Column:
    """Trimmed upper-case symbol; a six-digit code gets its known symbol or the main-board suffix."""
    s = F.upper(F.trim(code))
    mapped = F.concat(s, F.lit(".KS")) if known is None else F.coalesce(known, F.concat(s, F.lit(".KS")))
    return F.when(s.rlike(r"^\d{6}$"), mapped).otherwise(s)


def code_of(symbol: Column) -> Column:
    """Display code: digits of a symbol with or without market suffix, padded to six."""
    bare = F.regexp_replace(F.upper(F.trim(symbol)), r"\.(KS|KQ)$", "")
    return F.lpad(F.regexp_extract(bare, r"(\d{1,6})", 1), 6, "0")
