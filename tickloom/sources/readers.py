"""Readers of landed files and payloads.

Schemas are stated, never inferred: tickers are zero-padded text. Rows that break a rule
are kept with a ``reject_reason`` so that a caller can split valid from rejected rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.clock import add_session
from tickloom.functions.numeric import number
from tickloom.functions.text import contains_any
from tickloom.operators.clean import REQUIRED, require_columns
from tickloom.operators.skew import first_per_key

# Enumerations of the landed formats.
MARKET_SESSIONS = ("pre_market", "regular", "after_market", "holiday")
STORAGE_POLICIES = ("metadata_only", "summary_allowed", "raw_allowed")
DOMAIN_SOURCES = ("originallink", "link", "manual")
TIMESTAMP_SOURCES = ("naver_pubDate", "article_meta", "manual", "unknown")
PRICE_SOURCES = ("krx", "data.go.kr", "fixture")
ADJUSTMENTS = ("raw", "split_adjusted", "corporate_action_adjusted")
PROXY_TYPES = ("index", "etf", "stock", "commodity", "fx")
RELATION_TYPES = ("sector_proxy", "customer", "competitor", "input_cost", "macro", "adr")
LAG_POLICIES = ("overnight", "same_day", "previous_close")
DIRECTIONS = ("normal", "inverse")
CURRENCIES = ("USD", "KRW", "JPY", "CNY", "EUR", "none")
CORRECTION_WORDS = ("정정", "Correction", "correction")
FOREIGN_HEADERS = ("외국인합계", "외국인")
INSTITUTION_HEADERS = ("기관합계", "기관")
DISCLOSURE_URL = "https://dart.fss.or.kr/dsaf001/main.do?rcpNo="
PRICE_TAG, SIGNAL_TAG, CANDIDATE_TAG = ".price-bars.v1", ".backtest-signals.v1", ".weight-candidates.v1"


def csv_text(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, every column as text. The reader skips a byte-order mark."""
    return spark.read.option("header", True).option("inferSchema", False).option("encoding", "UTF-8").csv(path)


def read_bars(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Bars CSV. Duplicates stay for ``clean_bars``; ``ingest_seq`` follows the file order."""
    raw = csv_text(spark, path)
    require_columns(raw, REQUIRED, path)
    out = raw.withColumn("Date", F.to_date("Date"))
    if "Symbol" not in raw.columns:
        out = out.withColumn("Symbol", F.lit(symbol or "UNKNOWN"))
    # Unique and increasing inside a file: the same order a reader would see.
    return out.withColumn("ingest_seq", F.monotonically_increasing_id())


def read_universe(raw: DataFrame, order: str | None = None) -> DataFrame:
    """Distinct, trimmed, non-blank symbols with the place of their first appearance."""
    require_columns(raw, ["Symbol"], "universe")
    place = F.col(order) if order else F.monotonically_increasing_id()
    rows = raw.select(F.trim("Symbol").alias("Symbol"), place.alias("seq")).where(F.col("Symbol") != "")
    out = rows.groupBy("Symbol").agg(F.min("seq").alias("seq"))
    if out.isEmpty():
        raise ValueError("the universe has no symbols")
    return out


def symbol_names(primary: DataFrame, fallback: DataFrame | None = None, order: str = "seq") -> DataFrame:
    """Ticker, Symbol, Name, Market with one row per ticker; the primary file wins."""
    parts = [primary.withColumn("_file", F.lit(0))]
    if fallback is not None:
        parts.append(fallback.withColumn("_file", F.lit(1)))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    require_columns(rows, ["Ticker", "Symbol", "Name", "Market"], "symbol names")
    padded = F.when(F.length("Ticker") < 6, F.lpad("Ticker", 6, "0")).otherwise(F.col("Ticker"))
    clean = rows.select(padded.alias("Ticker"), *[F.trim(c).alias(c) for c in ("Symbol", "Name", "Market")], "_file", order)
    clean = clean.where((F.col("Ticker") != "") & (F.col("Symbol") != "") & (F.col("Name") != ""))
    return first_per_key(clean, ["Ticker"], [F.col("_file"), F.col(order)]).drop("_file", order)


PRICE_SCHEMA = """schema string, provider string, source string, adjustment string, rows array<struct<
  ticker: string, trading_day: string, open: double, close: double, market_return: double, sector_return: double>>"""
SIGNAL_SCHEMA = """schema string, scoring_version string, rows array<struct<
  ticker: string, score: double, signal_day: string, effective_trading_day: string, market_session: string,
  tradeability_status: string, sector: string, market_cap_bucket: string, event_type: string>>"""


def _reasons(*pairs: tuple[Column, str]) -> Column:
    joined = F.concat_ws("; ", *[F.when(cond, text) for cond, text in pairs])
    return F.when(joined != "", joined)


def price_snapshots(landed: DataFrame, payload: str = "payload") -> DataFrame:
    """Price-bar snapshot documents (one JSON text per row) as bars."""
    p = F.from_json(payload, PRICE_SCHEMA)
    docs = landed.select(p.alias("p")).select("p.*")
    bad = _reasons(
        (~F.coalesce(F.col("schema").endswith(PRICE_TAG), F.lit(False)), "schema"),
        (F.coalesce("provider", F.lit("")) == "", "provider"),
        (~F.coalesce(F.col("source").isin(*PRICE_SOURCES), F.lit(False)), "source"),
        (~F.coalesce(F.col("adjustment").isin(*ADJUSTMENTS), F.lit(False)), "adjustment"),
    )
    rows = docs.select(bad.alias("reject_reason"), F.posexplode("rows").alias("pos", "r"))
    return rows.select(
        "reject_reason", "pos", "r.ticker", F.to_date("r.trading_day").alias("trading_day"), "r.open", "r.close",
        F.coalesce("r.market_return", F.lit(0.0)).alias("market_return"),
        F.coalesce("r.sector_return", F.lit(0.0)).alias("sector_return"),
    )


def signal_snapshots(landed: DataFrame, payload: str = "payload") -> DataFrame:
    """Signal snapshot documents as signals, with defaults for optional fields."""
    docs = landed.select(F.from_json(payload, SIGNAL_SCHEMA).alias("p")).select("p.*")
    bad = _reasons(
        (~F.coalesce(F.col("schema").endswith(SIGNAL_TAG), F.lit(False)), "schema"),
        (F.coalesce("scoring_version", F.lit("")) == "", "scoring_version"),
    )
    rows = docs.select(bad.alias("reject_reason"), F.posexplode("rows").alias("pos", "r"))
    # Defaults of optional signal fields.
    defaults = {
        "market_session": "regular", "tradeability_status": "tradable", "sector": "unknown",
        "market_cap_bucket": "unknown", "event_type": "unknown",
    }
    return rows.select(
        "reject_reason", "pos", "r.ticker", "r.score", F.to_date("r.signal_day").alias("signal_day"),
        F.to_date("r.effective_trading_day").alias("effective_trading_day"),
        *[F.coalesce(F.col(f"r.{c}"), F.lit(v)).alias(c) for c, v in defaults.items()],
    )


NEWS_SCHEMA = """source string, title string, summary string, url string, original_url string, publisher_domain string,
  publisher_domain_source string, publisher_confidence double, published_at string, timestamp_source string,
  collected_at string, signal_at string, market_session string, raw_text string, storage_policy string,
  quality_flags array<string>, ticker string"""
DISCLOSURE_SCHEMA = """source string, receipt_no string, corp_code string, ticker string, disclosure_title string,
  disclosure_at string, collected_at string, signal_at string, is_correction boolean, original_receipt_no string,
  url string, quality_flags array<string>"""
ZONE = r"(Z|[+-]\d{2}:?\d{2})$"


def _aware(c: str) -> Column:
    return F.coalesce(F.col(c).rlike(ZONE), F.lit(False))


def _outside(c: str, allowed) -> Column:
    return ~F.coalesce(F.col(c).isin(*allowed), F.lit(False))


def news_items(landed: DataFrame, payload: str = "payload") -> DataFrame:
    """News fixture rows (one JSON text each) with typed times and the rules they break."""
    rows = landed.withColumn("_n", F.from_json(payload, NEWS_SCHEMA)).select(*[c for c in landed.columns if c != payload], "_n.*")
    times = ("published_at", "collected_at", "signal_at")
    typed = rows.withColumns({f"_{c}": F.try_to_timestamp(F.col(c)) for c in times})
    confidence = F.col("publisher_confidence")
    bad = _reasons(
        (~(_aware("published_at") & _aware("collected_at") & _aware("signal_at")), "time zone"),
        (_outside("market_session", MARKET_SESSIONS), "market_session"),
        (_outside("storage_policy", STORAGE_POLICIES), "storage_policy"),
        (_outside("timestamp_source", TIMESTAMP_SOURCES), "timestamp_source"),
        (F.col("publisher_domain_source").isNotNull() & _outside("publisher_domain_source", DOMAIN_SOURCES), "publisher_domain_source"),
        (~F.coalesce(confidence.between(0.0, 1.0), F.lit(False)), "publisher_confidence"),
        (~F.coalesce(F.col("_signal_at") == F.greatest("_published_at", "_collected_at"), F.lit(False)), "signal_at"),
        (F.col("ticker").isNotNull() & (F.length("ticker") != 6), "ticker"),
    )
    typed = typed.withColumn("reject_reason", bad)
    return typed.withColumns({c: F.col(f"_{c}") for c in times}).drop(*[f"_{c}" for c in times])


def disclosure_items(landed: DataFrame, payload: str = "payload") -> DataFrame:
    rows = landed.withColumn("_d", F.from_json(payload, DISCLOSURE_SCHEMA)).select(*[c for c in landed.columns if c != payload], "_d.*")
    times = ("disclosure_at", "collected_at", "signal_at")
    typed = rows.withColumns({f"_{c}": F.try_to_timestamp(F.col(c)) for c in times})
    bad = _reasons(
        (~(_aware("disclosure_at") & _aware("collected_at") & _aware("signal_at")), "time zone"),
        (~F.coalesce(F.col("_signal_at") == F.greatest("_disclosure_at", "_collected_at"), F.lit(False)), "signal_at"),
        (~F.coalesce(F.length("ticker") == 6, F.lit(False)), "ticker"),
    )
    typed = typed.withColumn("reject_reason", bad)
    return typed.withColumns({c: F.col(f"_{c}") for c in times}).drop(*[f"_{c}" for c in times])


# Entities that occur in search titles.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescaped(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def search_payload_news(landed: DataFrame, holidays: Iterable[date], payload: str = "payload", collected: str = "collected_at") -> DataFrame:
    """Landed news-search responses as news rows. Times are UTC instants."""
    schema = "items array<struct<title: string, description: string, link: string, originallink: string, pubDate: string>>"
    items = landed.select(
        *[c for c in landed.columns if c != payload], F.posexplode(F.from_json(payload, schema)["items"]).alias("pos", "i")
    )
    bare = F.regexp_replace("i.pubDate", r"^[A-Za-z]{3},\s*", "")  # weekday names cannot be parsed
    published = F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z"))
    origin = F.nullif("i.originallink", F.lit(""))
    host = F.lower(F.try_parse_url(F.coalesce(origin, F.nullif("i.link", F.lit(""))), F.lit("HOST")))
    text = lambda c: unescaped(F.regexp_replace(c, r"</?b>", ""))
    out = items.select(
        *[c for c in landed.columns if c != payload], "pos", F.lit("naver_news").alias("source"), text("i.title").alias("title"),
        text("i.description").alias("summary"), F.col("i.link").alias("url"), origin.alias("original_url"),
        host.alias("publisher_domain"), F.when(origin.isNotNull(), "originallink").otherwise("link").alias("publisher_domain_source"),
        F.when(origin.isNotNull(), 0.7).otherwise(0.4).alias("publisher_confidence"), published.alias("published_at"),
        F.lit("naver_pubDate").alias("timestamp_source"), F.lit("metadata_only").alias("storage_policy"),
        F.array(F.lit("timestamp_source_ambiguous"), F.lit("publisher_derived_from_domain")).alias("quality_flags"),
    )
    required = _reasons(
        (F.coalesce("title", F.lit("")) == "", "title"), (F.coalesce("summary", F.lit("")) == "", "description"),
        (F.coalesce("url", F.lit("")) == "", "link"), (F.col("published_at").isNull(), "pubDate"),
    )
    out = out.withColumns({"reject_reason": required, "signal_at": F.greatest("published_at", F.col(collected))})
    return add_session(out, holidays, "signal_at").drop("day")


def korean_news(news: DataFrame) -> DataFrame:
    return news.where(F.concat_ws(" ", "title", "summary").rlike("[가-힣]"))


def news_in_range(news: DataFrame, start: Column, end: Column, name: str | None = None, utc: str = "published_at") -> DataFrame:
    """News of local dates start..end that name the company in title or summary."""
    from tickloom.functions.clock import local_time

    out = news.withColumn("Date", local_time(utc).cast("date")).where(F.col("Date").between(start, end))
    if name is None:
        return out
    named = (F.col(name) == "") | F.contains(F.concat_ws(" ", "title", "summary"), F.col(name))
    return out.where(F.coalesce(named, F.lit(True)))


def is_correction(title: str | Column) -> Column:
    return contains_any(F.col(title) if isinstance(title, str) else title, CORRECTION_WORDS)


def disclosure_payload(landed: DataFrame, payload: str = "payload", collected: str = "collected_at") -> DataFrame:
    """Landed disclosure lists (JSON with status and list) as disclosure rows. A status
    other than empty, '000' or '013' marks the rows rejected."""
    schema = """status string, message string, list array<struct<rcept_no: string, rcept_dt: string, corp_code: string,
      stock_code: string, report_nm: string>>"""
    body = F.from_json(payload, schema)
    rows = landed.select(*[c for c in landed.columns if c != payload], body["status"].alias("_status"), F.explode(body["list"]).alias("i"))
    failed = F.col("_status").isNotNull() & ~F.col("_status").isin("000", "013")
    # Midnight local time as a UTC instant.
    filed = F.try_to_timestamp("i.rcept_dt", F.lit("yyyyMMdd")) - F.make_dt_interval(hours=F.lit(9))
    out = rows.where(~F.coalesce(F.col("_status") == "013", F.lit(False))).select(
        *[c for c in landed.columns if c not in (payload, "ticker")], F.lit("opendart").alias("source"),
        F.col("i.rcept_no").alias("receipt_no"), F.col("i.corp_code").alias("corp_code"),
        F.coalesce(F.nullif("i.stock_code", F.lit("")), F.col("ticker") if "ticker" in landed.columns else F.lit(None).cast("string")).alias("ticker"),
        F.col("i.report_nm").alias("disclosure_title"), filed.alias("disclosure_at"),
        is_correction(F.col("i.report_nm")).alias("is_correction"),
        F.concat(F.lit(DISCLOSURE_URL), F.col("i.rcept_no")).alias("url"), F.array(F.lit("missing_disclosure_time")).alias("quality_flags"),
        F.when(failed, F.concat(F.lit("status "), F.col("_status"))).when(filed.isNull(), "rcept_dt").alias("reject_reason"),
    )
    return out.withColumn("signal_at", F.greatest("disclosure_at", F.col(collected)))


def split_list(c: str, sep: str = ";") -> Column:
    return F.filter(F.split(F.coalesce(F.col(c), F.lit("")), sep), lambda x: x != "")


def report_rows(raw: DataFrame) -> DataFrame:
    """Written report rows with their joined lists back as arrays."""
    lists = [c for c in ("risk_flags", "review_checklist") if c in raw.columns]
    return raw.withColumns({c: split_list(c) for c in lists if dict(raw.dtypes)[c] == "string"})


def proxy_table(raw: DataFrame) -> DataFrame:
    """Sector proxies with the rule each bad row breaks."""
    typed = raw.withColumns({c: number(c) for c in ("weight", "max_adjustment_abs")})
    bad = _reasons(
        (F.coalesce("korean_sector", F.lit("")) == "", "korean_sector must not be empty"),
        (F.coalesce("proxy_symbol", F.lit("")) == "", "proxy_symbol must not be empty"),
        (_outside("proxy_type", PROXY_TYPES), "proxy_type"),
        (_outside("relation_type", RELATION_TYPES), "relation_type"),
        (_outside("lag_policy", LAG_POLICIES), "lag_policy"),
        (_outside("direction_transform", DIRECTIONS), "direction_transform"),
        (_outside("proxy_currency", CURRENCIES), "proxy_currency"),
        (F.coalesce("proxy_timezone", F.lit("")) == "", "proxy_timezone must not be empty"),
        (~F.coalesce(F.col("weight").between(0.0, 1.2), F.lit(False)), "weight must be between 0.0 and 1.2"),
        (~F.coalesce(F.col("max_adjustment_abs").between(0.0, 15.0), F.lit(False)), "max_adjustment_abs must be between 0.0 and 15.0"),
    )
    return typed.withColumn("reject_reason", bad)


def corp_codes(raw: DataFrame) -> DataFrame:
    """Corp code by full symbol and by six-digit ticker."""
    digits = F.regexp_extract("Symbol", r"^(\d{6})", 1)
    keys = F.array_distinct(F.array_compact(F.array(F.col("Symbol"), F.nullif(digits, F.lit("")))))
    return raw.select(F.explode(keys).alias("key"), F.col("corp_code").cast("string").alias("corp_code"))


def pick_header(columns: list[str], wanted: tuple[str, ...]) -> str:
    for part in wanted:
        for c in columns:
            if part in c:
                return c
    raise ValueError(f"none of {wanted} in {columns}")


def investor_flows(raw: DataFrame, date: str = "Date") -> DataFrame:
    """Foreign and institution net buying from a wide investor table, headers by priority."""
    foreign = pick_header(raw.columns, FOREIGN_HEADERS)
    institution = pick_header(raw.columns, INSTITUTION_HEADERS)
    keep = [c for c in ("Symbol",) if c in raw.columns]
    fill = lambda c: F.coalesce(number(F.col(f"`{c}`")), F.lit(0.0))
    return raw.select(F.to_date(date).alias("Date"), *keep, fill(foreign).alias("foreign_net_buy"), fill(institution).alias("institution_net_buy"))


def weight_candidates(landed: DataFrame, payload: str = "payload") -> DataFrame:
    """Weight-candidate documents as one row per candidate with its period rules checked."""
    period = "struct<start: string, end: string>"
    schema = f"""schema string, candidates array<struct<variant_id: string, description: string, scoring_version: string,
      weights: map<string, double>, train_period: {period}, test_period: {period}>>"""
    docs = landed.select(F.from_json(payload, schema).alias("d")).select("d.schema", F.explode("d.candidates").alias("c"))
    out = docs.select("schema", "c.*")
    day = lambda c: F.col(c).try_cast("date")
    bad = _reasons(
        (~F.coalesce(F.col("schema").endswith(CANDIDATE_TAG), F.lit(False)), "schema"),
        (F.coalesce("variant_id", F.lit("")) == "", "variant_id"),
        (F.coalesce("scoring_version", F.lit("")) == "", "scoring_version"),
        (~F.coalesce(day("train_period.start") <= day("train_period.end"), F.lit(False)), "train_period"),
        (~F.coalesce(day("test_period.start") <= day("test_period.end"), F.lit(False)), "test_period"),
        (~F.coalesce(day("test_period.start") > day("train_period.end"), F.lit(False)), "test_period must start after train_period"),
    )
    return out.withColumn("reject_reason", bad)


def context_to_items(context: DataFrame, run_date: str, order: str) -> DataFrame:
    """Context rows as news and disclosure records, told apart by ``source_type``. A row
    without a time counts as 09:00 local time of the run date; times are UTC instants."""
    from tickloom.functions.text import market, ticker

    at = F.coalesce(F.col("published_at").cast("timestamp"), F.to_timestamp(F.lit(f"{run_date} 00:00:00")))
    title = F.trim(F.coalesce("title", F.lit("")))
    code = ticker("Symbol")
    out = context.withColumns({"title": title, "ticker": code}).where((F.col("title") != "") & F.col("ticker").isNotNull())
    out = out.where(F.col("source_type").isin("news", "disclosure"))
    news = F.col("source_type") == "news"
    return out.select(
        "source_type", order, "ticker", market("Symbol").alias("market"), "title",
        F.coalesce(F.nullif("provider", F.lit("")), F.when(news, "naver").otherwise("dart")).alias("source"),
        F.coalesce("url", F.lit("")).alias("url"), at.alias("published_at"), at.alias("signal_at"),
        F.when(news, F.when(F.col("published_at").isNotNull(), "naver_pubDate").otherwise("manual")).alias("timestamp_source"),
        F.when(~news, F.coalesce(F.nullif("raw_id", F.lit("")), F.concat_ws("-", F.lit("synthetic"), F.col("ticker"), F.col(order).cast("string")))).alias("receipt_no"),
        F.when(~news, F.contains(title, F.lit("정정"))).alias("is_correction"),
        F.when(news, F.array(F.lit("title_only"))).otherwise(F.array().cast("array<string>")).alias("quality_flags"),
    )
