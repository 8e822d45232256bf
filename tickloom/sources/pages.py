"""Article text from HTML pages, in column expressions."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.text import contains_any

# Elements without visible text, shortest article, markers of a blocked page, character references.
HIDDEN = ("script", "style", "noscript", "svg")
MIN_CHARS = 200
PAYWALL_MARKERS = ("subscribe to continue", "sign in to continue", "구독 후", "로그인 후", "paywall")
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
#: Patterns that turn a page into its text, in order; Java and RE2 read them alike. A hidden element without an end hides the rest.
CUTS = (r"(?s)<!--.*?(-->|$)", *[rf"(?is)<{tag}\b.*?(</{tag}\s*>|$)" for tag in HIDDEN], r"(?s)<[a-zA-Z/!?][^>]*(>|$)")
SPACES = r"[\s\x{00A0}]+"
# ``REFERENCES`` and ``SPACES`` serve the SQL; the operator takes every reference and white space that Python knows.
ALL_SPACES = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: Names that count without a semicolon too, the longest first.
OPEN_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)
#: Numbers that HTML reads as a Windows-1252 character or otherwise changes; U+FEFF would be taken for a byte order mark.
NUMBERS = {0: "\ufffd", 0x0D: "\r", 0xFEFF: "\ufeff"} | {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}


def _literal_map(table: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def _numbered(number: Column) -> Column:
    """The character of a code point (a long, null above all code points)."""
    plane_end = number % 65536 >= 65534
    dropped = number.between(1, 8) | number.between(14, 31) | (number == 11) | (number == 127) | number.between(0xFDD0, 0xFDEF) | plane_end
    lost = number.isNull() | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    changed = F.try_element_at(_literal_map({str(n): c for n, c in NUMBERS.items()}), number.cast("string"))
    return F.when(lost, "\ufffd").when(changed.isNotNull(), changed).when(dropped, "").otherwise(char)


def _resolved(piece: Column) -> Column:
    """What follows an ampersand, with its reference resolved as ``html.unescape`` does."""
    rest = lambda found: F.substring(piece, F.length(found) + 1, F.length(piece))
    ten, sixteen = r"^#0*([0-9]*);?", r"^#[xX]0*([0-9a-fA-F]*);?"
    decimal, hexadecimal = F.regexp_extract(piece, ten, 1), F.regexp_extract(piece, sixteen, 1)
    number = lambda digits, base: F.when(F.length(digits) <= 7, F.conv(F.concat(F.lit("0"), digits), base, 10).cast("long"))
    name = F.regexp_extract(piece, r"^[^\t\n\f <&#;]{1,32};?", 0)
    whole = F.try_element_at(_literal_map(dict(html5)), name)
    short = F.regexp_extract(piece, f"^(?:{'|'.join(OPEN_NAMES)})", 0)
    return (
        F.when(piece.rlike("^#[0-9]"), F.concat(_numbered(number(decimal, 10)), rest(F.regexp_extract(piece, ten, 0))))
        .when(piece.rlike("^#[xX][0-9a-fA-F]"), F.concat(_numbered(number(hexadecimal, 16)), rest(F.regexp_extract(piece, sixteen, 0))))
        .when(whole.isNotNull(), F.concat(whole, rest(name)))
        .when(short != "", F.concat(F.try_element_at(_literal_map({n: html5[n] for n in OPEN_NAMES}), short), rest(short)))
        .otherwise(F.concat(F.lit("&"), piece))
    )


def unescape(text: Column) -> Column:
    """Every decimal, hexadecimal and named character reference resolved once."""
    return F.array_join(F.transform(F.split(text, "&"), lambda piece, i: F.when(i == 0, piece).otherwise(_resolved(piece))), "")


def visible_text(html: Column) -> Column:
    """Text outside tags, comments and hidden elements, with single spaces. References are resolved twice, as pages often escape twice."""
    out = F.coalesce(html, F.lit(""))
    for pattern in CUTS:
        out = F.regexp_replace(out, pattern, " ")
    return F.trim(F.regexp_replace(unescape(unescape(out)), ALL_SPACES, " "))


def extract_articles(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, text, ok, error and risk_flags of every page; the text of a rejected page is empty."""

    rows = pages.select(key, visible_text(F.col(html)).alias("text"))
    short = F.length("text") < MIN_CHARS
    blocked = contains_any(F.lower("text"), PAYWALL_MARKERS)
    error = F.when(short, "article text too short").when(blocked, "article appears paywalled or blocked")
    first = F.when(short, "article_text_too_short").otherwise("article_fetch_failed")
    flags = F.when(error.isNotNull(), F.array(first, F.lit("needs_full_text_review"))).otherwise(F.array().cast("array<string>"))
    out = rows.withColumns({"error": error, "risk_flags": flags})
    return out.withColumns({"ok": F.col("error").isNull(), "text": F.when(F.col("error").isNull(), F.col("text")).otherwise("")})


def count_flags(articles: DataFrame) -> DataFrame:
    return articles.select(F.explode("risk_flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("count"))
