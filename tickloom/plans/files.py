"""Queries over landed files and written tables, fed from the warehouse tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tickloom.functions import clock, policy
from tickloom.operators import impact, screener
from tickloom.params import ScreenerParams
from tickloom.plans.news import EVENTS, REPORT_SQL, TITLES, company_table, scored_events, titles
from tickloom.plans.policy import LABELS, policy_input
from tickloom.plans.registry import query
from tickloom.plans.signals import CAL, HOLIDAYS
from tickloom.plans.sqltext import BARS, CONTEXT, RETURNS, W, d, il, r
from tickloom.session import scratch_path
from tickloom.sources import readers, sinks
from tickloom.sources import tables as t

# ---------------------------------------------------------------- scans


@query("sc01_bars_csv", f"""WITH {BARS} SELECT {d()}, "Symbol", {r('CAST("Close" AS DOUBLE)', "Close")}, {r('"Volume"', "Volume")} FROM bars""")
def bars_csv(spark, sf):
    """Bars written as CSV and read back with a stated schema."""
    path = scratch_path(spark, "bars")
    sinks.write_artifact(t.daily_bars(spark, sf).select("Date", "Symbol", "Open", "High", "Low", "Close", "Volume"), path, csv=True)
    out = readers.read_bars(spark, path)
    return out.select("Date", "Symbol", F.col("Close").cast("double").alias("Close"), F.col("Volume").cast("double").alias("Volume"))


@query("sc02_universe", """SELECT 'S' || l_suppkey AS "Symbol", min(l_orderkey * 10 + l_linenumber) AS seq FROM lineitem WHERE l_suppkey % 4 <> 0 GROUP BY 1""")
def universe(spark, sf):
    li = t.table(spark, sf, "lineitem")
    name = F.when(F.col("l_suppkey") % 4 == 0, "  ").otherwise(F.concat(F.lit(" S"), F.col("l_suppkey"), F.lit(" ")))
    return readers.read_universe(li.select(name.alias("Symbol"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n")), "n")


def name_file(spark, sf, shift: int, market: str):
    s = t.table(spark, sf, "supplier")
    k = (F.col("s_suppkey") / 2).cast("int") + shift
    return s.select(
        k.cast("string").alias("Ticker"), F.concat(F.lit(" S"), k).alias("Symbol"), F.concat(F.lit(market + " "), F.col("s_name"), F.lit(" ")).alias("Name"),
        F.lit(market).alias("Market"), F.col("s_suppkey").alias("seq"),
    )


@query(
    "sc03_symbol_names",
    """WITH u AS (SELECT 0 AS f, s_suppkey // 2 AS k, 'MAIN ' || s_name AS nm, 'MAIN' AS "Market", s_suppkey AS seq FROM supplier UNION ALL SELECT 1, s_suppkey // 2 + 20, 'NEXT ' || s_name, 'NEXT', s_suppkey FROM supplier)
    SELECT lpad(CAST(k AS VARCHAR), 6, '0') AS "Ticker", 'S' || k AS "Symbol", nm AS "Name", "Market" FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY f, seq) = 1""",
)
def symbol_names(spark, sf):
    return readers.symbol_names(name_file(spark, sf, 0, "MAIN"), name_file(spark, sf, 20, "NEXT"))


def price_documents(spark, sf):
    """One snapshot document per symbol and month."""
    bars = t.daily_bars(spark, sf)
    row = F.struct(
        F.col("Symbol").alias("ticker"), F.col("Date").cast("string").alias("trading_day"), F.col("Open").alias("open"), F.col("Close").alias("close"),
        F.when(F.dayofmonth("Date") % 2 == 0, 0.001).alias("market_return"),
    )
    docs = bars.groupBy("Symbol", F.date_format("Date", "yyyyMM").alias("m")).agg(F.collect_list(row).alias("rows"))  # days of a month
    tag = F.when(F.col("m").endswith("12"), "other").otherwise("prices.price-bars.v1")
    return docs.select(F.to_json(F.struct(tag.alias("schema"), F.lit("p").alias("provider"), F.lit("krx").alias("source"), F.lit("raw").alias("adjustment"), "rows")).alias("payload"))


@query(
    "sc04_price_snapshots",
    f"""WITH {BARS} SELECT "Symbol" AS ticker, {d(name="trading_day")}, {r('"Close"', "close")}, CASE WHEN day("Date") % 2 = 0 THEN 0.001 ELSE 0.0 END::DOUBLE AS market_return, CASE WHEN month("Date") = 12 THEN 'schema' END AS reject_reason FROM bars""",
)
def price_snapshots(spark, sf):
    out = readers.price_snapshots(price_documents(spark, sf))
    return out.select("ticker", "trading_day", "close", "market_return", "reject_reason")


@query(
    "sc04_signal_snapshots",
    """SELECT o_orderkey AS n, 'S' || o_custkey AS ticker, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS signal_day, CASE WHEN o_orderkey % 2 = 0 THEN 'halted' ELSE 'tradable' END AS tradeability_status, 'regular' AS market_session, 'unknown' AS sector FROM orders""",
)
def signal_snapshots(spark, sf):
    o = t.table(spark, sf, "orders")
    day = F.col("o_orderdate").cast("date").cast("string")
    row = F.struct(
        F.concat(F.lit("S"), F.col("o_custkey")).alias("ticker"), F.col("o_orderkey").cast("double").alias("score"), day.alias("signal_day"),
        day.alias("effective_trading_day"), F.when(F.col("o_orderkey") % 2 == 0, "halted").alias("tradeability_status"),
    )
    landed = o.select(F.to_json(F.struct(F.lit("x.backtest-signals.v1").alias("schema"), F.lit("v1").alias("scoring_version"), F.array(row).alias("rows"))).alias("payload"))
    out = readers.signal_snapshots(landed)
    return out.select(F.col("score").cast("long").alias("n"), "ticker", "signal_day", "tradeability_status", "market_session", "sector")


def news_documents(spark, sf):
    e = F.col("event_id")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(e % 10 == 0, "").otherwise("+09:00"))
    item = F.struct(
        F.lit("fixture").alias("source"), F.col("event_type").alias("title"), F.lit("").alias("summary"), F.lit("u").alias("url"),
        (e % 13 / 10.0).alias("publisher_confidence"), stamp.alias("published_at"), F.when(e % 4 == 0, "bad").otherwise("manual").alias("timestamp_source"),
        stamp.alias("collected_at"), F.when(e % 6 == 0, F.lit("2020-01-01T00:00:00+09:00")).otherwise(stamp).alias("signal_at"), F.lit("regular").alias("market_session"),
        F.lit("metadata_only").alias("storage_policy"), F.array(F.lit("q")).alias("quality_flags"), F.lpad((F.col("user_id") % 90).cast("string"), 6, "0").alias("ticker"),
    )
    return t.table(spark, sf, "events").select("event_id", F.to_json(item).alias("payload"))


@query(
    "sc05_news_fixture",
    """SELECT event_id, lpad(CAST(user_id % 90 AS VARCHAR), 6, '0') AS ticker, nullif(concat_ws('; ', CASE WHEN event_id % 10 = 0 THEN 'time zone' END, CASE WHEN event_id % 4 = 0 THEN 'timestamp_source' END,
    CASE WHEN event_id % 13 / 10.0 > 1 THEN 'publisher_confidence' END, CASE WHEN event_id % 6 = 0 THEN 'signal_at' END), '') AS reject_reason FROM events""",
)
def news_fixture(spark, sf):
    return readers.news_items(news_documents(spark, sf)).select("event_id", "ticker", "reject_reason")


@query(
    "sc05_disclosure_fixture",
    """SELECT event_id, CAST(event_id AS VARCHAR) AS receipt_no, CASE WHEN event_id % 5 = 0 THEN 'ticker' END AS reject_reason FROM events""",
)
def disclosure_fixture(spark, sf):
    e = F.col("event_id")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    item = F.struct(
        F.lit("dart").alias("source"), e.cast("string").alias("receipt_no"), F.lit("").alias("corp_code"), F.when(e % 5 == 0, "12").otherwise("005930").alias("ticker"),
        F.lit("t").alias("disclosure_title"), stamp.alias("disclosure_at"), stamp.alias("collected_at"), stamp.alias("signal_at"),
    )
    landed = t.table(spark, sf, "events").select("event_id", F.to_json(item).alias("payload"))
    return readers.disclosure_items(landed).select("event_id", "receipt_no", "reject_reason")


def search_responses(spark, sf):
    """Four hits per landed response."""
    e = F.col("event_id")
    hit = F.struct(
        F.concat(F.lit("<b>A&amp;B</b> "), F.col("event_type")).alias("title"), F.when(e % 2 == 0, "한글 요약").otherwise("plain &quot;text&quot;").alias("description"),
        F.concat(F.lit("https://n.example.com/"), e).alias("link"), F.when(e % 3 == 0, "").otherwise(F.concat(F.lit("https://Press"), e % 5, F.lit(".Example.com/a"))).alias("originallink"),
        F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000")).alias("pubDate"),
    )
    ev = t.table(spark, sf, "events").withColumn("hit", hit)
    grouped = ev.groupBy((e / 4).cast("long").alias("batch")).agg(F.sort_array(F.collect_list(F.struct("event_id", "hit"))).alias("h"))  # four rows
    items = F.transform("h", lambda x: x["hit"])
    return grouped.select("batch", F.to_json(F.struct(items.alias("items"))).alias("payload"), F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("collected_at"))


SEARCH = f"""{CAL}, sp AS (SELECT event_id, event_id // 4 AS batch, event_id % 4 AS pos, 'A&B ' || event_type AS title, CASE WHEN event_id % 2 = 0 THEN '한글 요약' ELSE 'plain "text"' END AS summary,
  CASE WHEN event_id % 3 = 0 THEN 'n.example.com' ELSE 'press' || event_id % 5 || '.example.com' END AS publisher_domain, CASE WHEN event_id % 3 = 0 THEN 0.4 ELSE 0.7 END::DOUBLE AS publisher_confidence,
  date_trunc('second', ts) AS ts FROM events),
sq AS (SELECT sp.*, CASE WHEN NOT is_open THEN 'holiday' WHEN CAST(ts + INTERVAL 9 HOUR AS TIME) < TIME '09:00:00' THEN 'pre_market' WHEN CAST(ts + INTERVAL 9 HOUR AS TIME) <= TIME '15:30:00' THEN 'regular' ELSE 'after_market' END AS market_session
  FROM sp JOIN cl ON day = CAST(ts + INTERVAL 9 HOUR AS DATE))"""


def search_news(spark, sf):
    return readers.search_payload_news(search_responses(spark, sf), HOLIDAYS)


@query(
    "sc06_search_payload",
    f"""WITH {SEARCH} SELECT batch, pos, title, summary, publisher_domain, publisher_confidence FROM sq""",
)
def search_payload(spark, sf):
    return search_news(spark, sf).select("batch", "pos", "title", "summary", "publisher_domain", "publisher_confidence")


@query(
    "pf42_news_filters",
    f"""WITH {SEARCH} SELECT batch, pos, {d("CAST(ts + INTERVAL 9 HOUR AS DATE)")} FROM sq WHERE event_id % 2 = 0 AND CAST(ts + INTERVAL 9 HOUR AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' AND title LIKE '%click%'""",
)
def news_filters(spark, sf):
    """Local-date range, name in title or summary, Korean text only."""
    e = t.table(spark, sf, "events")
    rows = e.select(
        (F.col("event_id") / 4).cast("long").alias("batch"), (F.col("event_id") % 4).alias("pos"), F.date_trunc("second", "ts").alias("published_at"),
        F.concat(F.lit("A&B "), F.col("event_type")).alias("title"), F.when(F.col("event_id") % 2 == 0, "한글 요약").otherwise("plain").alias("summary"),
        F.lit("click").alias("company"),
    )
    out = readers.news_in_range(readers.korean_news(rows), F.lit(date(2024, 1, 10)), F.lit(date(2024, 1, 12)), "company")
    return out.select("batch", "pos", "Date")


@query(
    "sc07_disclosure_payload",
    """SELECT CAST(o_orderkey AS VARCHAR) AS receipt_no, CASE WHEN o_orderkey % 3 = 0 THEN '123456' ELSE 'fallbk' END AS ticker, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS is_correction,
    'https://dart.fss.or.kr/dsaf001/main.do?rcpNo=' || o_orderkey AS url, CASE WHEN o_orderkey % 7 = 1 THEN 'status 020' END AS reject_reason FROM orders WHERE o_orderkey % 7 <> 0""",
)
def disclosure_payload(spark, sf):
    o = t.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    item = F.struct(
        k.cast("string").alias("rcept_no"), F.date_format("o_orderdate", "yyyyMMdd").alias("rcept_dt"), F.lit("c").alias("corp_code"),
        F.when(k % 3 == 0, "123456").otherwise("").alias("stock_code"), F.when(k % 4 == 0, "[정정]보고서").otherwise("보고서").alias("report_nm"),
    )
    status = F.when(k % 7 == 0, "013").when(k % 7 == 1, "020").otherwise("000")
    landed = o.select(
        F.to_json(F.struct(status.alias("status"), F.array(item).alias("list"))).alias("payload"), F.lit("fallbk").alias("ticker"),
        F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("collected_at"),
    )
    return readers.disclosure_payload(landed).select("receipt_no", "ticker", "is_correction", "url", "reject_reason")


@query(
    "sc08_report_scan",
    f"""WITH {REPORT_SQL} SELECT ticker, {r("score", "news_disclosure_score")}, len(string_split(risk_flags, ';')) AS n_flags, 3 AS n_checks FROM rep""",
)
def report_scan(spark, sf):
    """A report written as JSON lines and read back."""
    rows = impact.report_rows(scored_events(spark, sf), company_table(spark, sf), "2024-01-31", "run-1")
    path = scratch_path(spark, "report")
    sinks.report_json(rows, impact.REPORT_COLUMNS).write.mode("overwrite").text(path)
    schema = "ticker string, news_disclosure_score double, risk_flags string, review_checklist string"
    back = readers.report_rows(spark.read.schema(schema).json(path))
    return back.select("ticker", "news_disclosure_score", F.size("risk_flags").alias("n_flags"), F.size("review_checklist").alias("n_checks"))


@query(
    "sc09_proxy_table",
    """SELECT n_nationkey AS k, concat_ws('; ', CASE WHEN n_nationkey % 8 = 0 THEN 'proxy_symbol must not be empty' END, CASE WHEN n_nationkey % 5 = 0 THEN 'proxy_type' END, CASE WHEN n_nationkey / 15.0 > 1.2 THEN 'weight must be between 0.0 and 1.2' END,
    CASE WHEN n_nationkey > 15 THEN 'max_adjustment_abs must be between 0.0 and 15.0' END) AS reject_reason FROM nation""",
)
def proxy_table(spark, sf):
    n = t.table(spark, sf, "nation")
    k = F.col("n_nationkey")
    raw = n.select(
        k.alias("k"), F.lit("auto").alias("korean_sector"), F.when(k % 8 == 0, "").otherwise("P").alias("proxy_symbol"), F.when(k % 5 == 0, "bond").otherwise("etf").alias("proxy_type"),
        F.lit("macro").alias("relation_type"), (k / 15.0).cast("string").alias("weight"), F.lit("overnight").alias("lag_policy"), F.lit("normal").alias("direction_transform"),
        F.lit("USD").alias("proxy_currency"), F.lit("UTC").alias("proxy_timezone"), k.cast("string").alias("max_adjustment_abs"),
    )
    return readers.proxy_table(raw).select("k", F.coalesce("reject_reason", F.lit("")).alias("reject_reason"))


@query(
    "sc11_corp_codes",
    """WITH c AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '.KS' ELSE 'X' || c_custkey END AS s, 'corp' || c_custkey AS corp_code FROM customer)
    SELECT s AS key, corp_code FROM c UNION ALL SELECT substr(s, 1, 6), corp_code FROM c WHERE s LIKE '%.KS'""",
)
def corp_codes(spark, sf):
    c = t.table(spark, sf, "customer")
    k = F.col("c_custkey")
    symbol = F.when(k % 2 == 0, F.concat(F.lpad(k.cast("string"), 6, "0"), F.lit(".KS"))).otherwise(F.concat(F.lit("X"), k))
    return readers.corp_codes(c.select(symbol.alias("Symbol"), F.concat(F.lit("corp"), k).alias("corp_code")))


@query(
    "sc12_investor_table",
    """SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS "Date", CAST(o_custkey AS VARCHAR) AS "Symbol", floor(coalesce(o_totalprice, 0) * 1e6 + 0.5) / 1e6 AS foreign_net_buy, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_custkey END::DOUBLE AS institution_net_buy FROM orders""",
)
def investor_table(spark, sf):
    o = t.table(spark, sf, "orders")
    raw = o.select(
        F.col("o_orderdate").cast("date").alias("Date"), F.col("o_custkey").cast("string").alias("Symbol"), F.lit(1.0).alias("개인"), F.lit(2.0).alias("외국인"),
        F.col("o_totalprice").alias("외국인합계"), F.when(F.col("o_orderkey") % 5 == 0, "-").otherwise(F.col("o_custkey").cast("string")).alias("기관합계"), F.lit(3.0).alias("전체"),
    )
    return readers.investor_flows(raw)


@query(
    "sc13_weight_candidates",
    """SELECT 'v' || c_custkey AS variant_id, c_custkey % 10 / 10.0::DOUBLE AS w, CASE WHEN c_custkey % 3 = 0 THEN 'test_period must start after train_period' END AS reject_reason FROM customer""",
)
def weight_candidates(spark, sf):
    c = t.table(spark, sf, "customer")
    k = F.col("c_custkey")
    period = lambda a, b, n: F.struct(a.alias("start"), b.alias("end")).alias(n)
    cand = F.struct(
        F.concat(F.lit("v"), k).alias("variant_id"), F.lit("d").alias("description"), F.lit("s1").alias("scoring_version"), F.create_map(F.lit("a"), k % 10 / 10.0).alias("weights"),
        period(F.lit("2023-01-01"), F.lit("2023-06-30"), "train_period"),
        period(F.when(k % 3 == 0, "2023-06-30").otherwise("2023-07-01"), F.lit("2023-12-31"), "test_period"),
    )
    landed = c.select(F.to_json(F.struct(F.lit("x.weight-candidates.v1").alias("schema"), F.array(cand).alias("candidates"))).alias("payload"))
    return readers.weight_candidates(landed).select("variant_id", F.col("weights")["a"].alias("w"), "reject_reason")


# ---------------------------------------------------------------- written tables


@query("sk01_written_detail", f"""WITH {BARS} SELECT {d()}, "Symbol", {r('"Close"', "Close")} FROM bars""")
def written_detail(spark, sf):
    path = scratch_path(spark, "detail")
    sinks.write_artifact(t.daily_bars(spark, sf).select("Date", "Symbol", "Close"), path)
    return spark.read.schema("Date date, Symbol string, Close double").parquet(path)


@query(
    "sk02_manifest",
    """SELECT 'orders' AS relative_path, (SELECT count(*) FROM orders) AS row_count, 'o_orderkey;o_custkey' AS columns, '1.0' AS schema_version UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), 'c_custkey', '1.0'""",
)
def manifest(spark, sf):
    """Two tables are written; their rows are counted by the writes."""
    tables = {"orders": t.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "customer": t.table(spark, sf, "customer").select("c_custkey")}
    root = scratch_path(spark, "run")
    return sinks.manifest(spark, {name: sinks.write_artifact(df, f"{root}/{name}") for name, df in tables.items()})


@query(
    "sk03_publish_latest",
    f"""WITH {BARS}, m AS (SELECT max("Date") AS last FROM bars) SELECT {d()}, "Symbol", {r('"Close" + 1', "Close")}, 'run-3' AS source_run_id, 2 AS dates FROM bars, m WHERE "Date" >= last - 10""",
)
def publish_latest(spark, sf):
    """Three publishes over two dates, then one that fails for a missing field: the third stays the latest."""
    bars = t.daily_bars(spark, sf).select("Date", "Symbol", "Close")
    last = bars.agg(F.max("Date").alias("last"))
    recent = bars.join(F.broadcast(last), F.col("Date") >= F.date_sub("last", 10)).drop("last")  # one row
    root, fields = scratch_path(spark, "published"), {"detail": ["Date", "Symbol", "Close"]}
    put = lambda df, day, run: sinks.publish_snapshot({"detail": df}, root, day, run, f"{day}T16:00:00+09:00", 0, required=fields)
    put(bars, "2001-01-02", "run-1")
    put(recent, "2001-01-03", "run-2")
    put(recent.withColumn("Close", F.col("Close") + 1), "2001-01-03", "run-3")
    try:
        put(recent.drop("Close"), "2001-01-04", "run-4")
    except ValueError as refused:
        if "required fields" not in str(refused):
            raise
    index = sinks.published_index(spark, root)
    run, dates = index.agg(F.max(F.when(F.col("is_latest"), F.col("source_run_id"))), F.count(F.lit(1))).first()
    return sinks.read_published(spark, root, "detail").withColumns({"source_run_id": F.lit(run), "dates": F.lit(dates)})


@query(
    "sk03_publish_dates",
    f"""WITH {BARS} SELECT CAST(CAST(date_trunc('month', "Date") AS DATE) AS VARCHAR) AS trading_date, count(*) AS n, sum(CASE WHEN "Date" >= DATE '2001-01-01' THEN 2 ELSE 1 END) AS version_sum FROM bars GROUP BY 1""",
)
def publish_dates(spark, sf):
    """Publish the bars of every month under its first day, republish the newer ones: only those are replaced."""
    root = scratch_path(spark, "published")
    bars = t.daily_bars(spark, sf)
    rows = bars.select(F.trunc("Date", "month").alias("trading_date"), "Symbol", F.lit(1).alias("version"))
    sinks.publish(rows, root)
    sinks.publish(rows.where(F.col("trading_date") >= F.lit(date(2001, 1, 1))).withColumn("version", F.lit(2)), root)
    back = spark.read.schema("Symbol string, version int, trading_date date").parquet(root)
    return back.groupBy("trading_date").agg(F.count(F.lit(1)).alias("n"), F.sum("version").alias("version_sum"))


@query(
    "sk03_publish_index",
    """SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS trading_date, max(o_orderkey) AS source_run_id, CASE WHEN CAST(o_orderdate AS DATE) = (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) THEN 1 ELSE 0 END AS is_latest FROM orders GROUP BY CAST(o_orderdate AS DATE)""",
)
def publish_index(spark, sf):
    o = t.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("trading_date"), F.col("o_orderkey").alias("source_run_id"))
    return sinks.publish_index(o, "source_run_id")


@query(
    "sk04_merge_bars",
    f"""WITH {BARS}, b AS (SELECT * FROM bars WHERE "Date" < DATE '2001-01-01'), f AS (SELECT *, "Close" + 1 AS c2 FROM bars WHERE "Date" >= DATE '2000-06-01')
    SELECT CAST(coalesce(b."Date", f."Date") AS VARCHAR) AS "Date", coalesce(b."Symbol", f."Symbol") AS "Symbol", {r('coalesce(c2, b."Close")', "Close")}, CASE WHEN b."Date" IS NOT NULL THEN 'x' || b."Symbol" END AS tag FROM b FULL JOIN f ON b."Date" = f."Date" AND b."Symbol" = f."Symbol" """,
)
def merge_bars(spark, sf):
    bars = t.daily_bars(spark, sf)
    base = bars.where(F.col("Date") < F.lit(date(2001, 1, 1))).withColumn("tag", F.concat(F.lit("x"), F.col("Symbol")))
    fresh = bars.where(F.col("Date") >= F.lit(date(2000, 6, 1))).withColumn("Close", F.col("Close") + 1)
    return sinks.merge_bars(base, fresh, F.col("Close")).select("Date", "Symbol", "Close", "tag")


@query("sk05_incremental_start", f"""WITH {BARS} SELECT CAST(greatest(DATE '1999-01-01', max("Date") + 1) AS VARCHAR) AS fetch_start FROM bars""")
def incremental_start(spark, sf):
    return sinks.next_fetch_date(t.daily_bars(spark, sf), "1999-01-01")


@query(
    "sk06_report_json",
    f"""WITH {REPORT_SQL} SELECT ticker, {r("score", "news_disclosure_score")}, risk_flags, 'not_investment_advice;verify_evidence;check_tradeability' AS review_checklist FROM rep""",
)
def report_json(spark, sf):
    rows = impact.report_rows(scored_events(spark, sf), company_table(spark, sf), "2024-01-31", "run-1")
    lines = sinks.report_json(rows, impact.REPORT_COLUMNS)
    field = lambda c: F.get_json_object("value", f"$.{c}").alias(c)
    return lines.select(field("ticker"), field("news_disclosure_score").cast("double").alias("news_disclosure_score"), field("risk_flags"), field("review_checklist"))


@query(
    "ag22_portfolio_counts",
    f"""WITH {LABELS} SELECT 'portfolio_action' AS field, portfolio_action AS value, count(*) AS count FROM acted GROUP BY 2 UNION ALL SELECT 'risk_flag', risk_flag, count(*) FROM acted GROUP BY 2""",
)
def portfolio_counts(spark, sf):
    return sinks.portfolio_counts(policy.policy_frame(policy_input(spark, sf)))


@query(
    "ag22_horizon_summary",
    f"""WITH {LABELS} SELECT {r("avg(predicted_return)", "avg_predicted_return_pct")}, sum(CASE WHEN predicted_return > 0 THEN 1 ELSE 0 END) AS positive_signal_count, {r("avg(up_probability)", "avg_up_probability")} FROM acted""",
)
def horizon_summary(spark, sf):
    return sinks.horizon_summary(policy_input(spark, sf))


@query(
    "ag22_top_buys",
    f"""WITH {LABELS} SELECT {d()}, "Symbol", {r("predicted_return")}, portfolio_action FROM acted WHERE recommendation = '매수' ORDER BY acted.predicted_return DESC, confidence_score DESC, "Symbol" LIMIT 10""",
)
def top_buys(spark, sf):
    out = sinks.top_buys(policy.policy_frame(policy_input(spark, sf)), policy.BUY)
    return out.select("Date", "Symbol", "predicted_return", "portfolio_action")


CONTRACTS = {"orders": ["o_orderkey", "priority", "shipped_at", "o_totalprice"], "customer": ["c_custkey", "phone"], "supplier": ["s_suppkey", "s_comment_hash"]}


@query(
    "pf43_schema_contract",
    """WITH o AS (SELECT count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS a FROM orders), c AS (SELECT count(*) AS n, count(*) FILTER (c_acctbal < 0) AS a FROM customer), s AS (SELECT count(*) AS n FROM supplier)
    SELECT 'orders' AS relative_path, 'o_orderkey' AS field, 1 AS present, 0 AS null_count, n AS row_count FROM o UNION ALL SELECT 'orders', 'priority', 1, a, n FROM o UNION ALL SELECT 'orders', 'shipped_at', 0, NULL, n FROM o
    UNION ALL SELECT 'orders', 'o_totalprice', 1, 0, n FROM o UNION ALL SELECT 'customer', 'c_custkey', 1, 0, n FROM c UNION ALL SELECT 'customer', 'phone', 1, a, n FROM c
    UNION ALL SELECT 'supplier', 's_suppkey', 1, 0, n FROM s UNION ALL SELECT 'supplier', 's_comment_hash', 0, NULL, n FROM s""",
)
def schema_contract(spark, sf):
    """Required fields of three written tables: which are there, and how many rows lack a value."""
    tables = {
        "orders": t.table(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("priority"), "o_totalprice"),
        "customer": t.table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.lit("known")).alias("phone")),
        "supplier": t.table(spark, sf, "supplier").select("s_suppkey"),
    }
    root = scratch_path(spark, "contract")
    written = {name: sinks.write_artifact(df, f"{root}/{name}", required=CONTRACTS[name]) for name, df in tables.items()}
    return sinks.contract_report(spark, written, CONTRACTS)


@query(
    "pf37_context_export",
    f"""WITH {TITLES} SELECT {d()}, "Symbol", source_type, title, 'event' AS record_type, 'completed' AS collection_status FROM tt WHERE source_type = 'news'""",
)
def context_export(spark, sf):
    rows = titles(spark, sf).where(F.col("source_type") == "news")
    out = sinks.classify_export(rows, rows.select("Symbol"), "news", "2024-01-31")
    return out.select("Date", "Symbol", "source_type", "title", "record_type", "collection_status")


@query(
    "pf37_context_export_summary",
    f"""WITH {TITLES} SELECT '2024-01-31' AS "Date", "Symbol", 'disclosure_summary' AS source_type, max(title) AS title, 'summary' AS record_type FROM tt GROUP BY 2""",
)
def context_export_summary(spark, sf):
    rows = titles(spark, sf)
    snapshot = rows.groupBy("Symbol").agg(F.max("title").alias("공시 요약"))
    out = sinks.classify_export(rows.where(F.lit(False)), snapshot, "disclosure", "2024-01-31")
    return out.select("Date", "Symbol", "source_type", "title", "record_type")


@query("jn16_session_overlay", """SELECT c_custkey AS code, CASE WHEN c_custkey % 3 = 0 THEN 'session' ELSE 'baseline' END AS origin, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name FROM customer""")
def session_overlay(spark, sf):
    c = t.table(spark, sf, "customer")
    baseline = c.select(F.col("c_custkey").alias("code"), F.lit("baseline").alias("origin"), F.col("c_name").alias("name"))
    session = c.where(F.col("c_custkey") % 3 == 0).select(F.col("c_custkey").alias("code"), F.lit("session").alias("origin"))
    return sinks.overlay_session(session, baseline, "code")


@query(
    "jn19_latest_prediction_dates",
    """WITH o AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS k, max(CAST(o_orderdate AS DATE)) AS m FROM orders GROUP BY 1) SELECT CAST(c_custkey AS VARCHAR) AS code, CAST(m AS VARCHAR) AS "Date" FROM customer LEFT JOIN o ON k = lpad(CAST(c_custkey AS VARCHAR), 6, '0')""",
)
def latest_prediction_dates(spark, sf):
    o = t.table(spark, sf, "orders")
    suffix = F.when(F.col("o_orderkey") % 3 == 0, ".KS").when(F.col("o_orderkey") % 3 == 1, ".kq").otherwise("")
    detail = o.select(F.concat(F.lpad(F.col("o_custkey").cast("string"), 6, "0"), suffix).alias("Symbol"), F.col("o_orderdate").cast("date").alias("Date"))
    codes = t.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("code"))
    return sinks.latest_prediction_dates(detail, codes)


# ---------------------------------------------------------------- screener


def named(spark, sf):
    s = t.table(spark, sf, "supplier")
    return s.where(F.col("s_suppkey") % 2 == 0).select(F.concat(F.lit("s"), F.col("s_suppkey"), F.lit(" ")).alias("Symbol"), F.col("s_name").alias("Name"))


SCREEN = f"""{BARS}, sb AS (SELECT lpad("Symbol", 6, '0') AS symbol, coalesce(s_name, lpad("Symbol", 6, '0')) AS name, "Date" AS dt, "Open" AS op, "High" AS hi, "Low" AS lo, "Close" AS cl, "Volume" AS vo, "Close" * "Volume" AS trade_value
  FROM bars LEFT JOIN supplier ON 'S' || s_suppkey = "Symbol" AND s_suppkey % 2 = 0),
lt AS (SELECT symbol, row_number() OVER (ORDER BY trade_value DESC, symbol) AS trade_value_rank FROM sb WHERE dt = (SELECT max(dt) FROM sb)),
ti AS (SELECT sb.*, lt.trade_value_rank, row_number() OVER w AS hist, avg(cl) OVER (w ROWS 4 PRECEDING) AS ma5, avg(cl) OVER (w ROWS 19 PRECEDING) AS ma20, max(cl) OVER (w ROWS 19 PRECEDING) AS h20, max(cl) OVER (w ROWS 251 PRECEDING) AS h252,
   coalesce(vo / nullif(avg(vo) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0), 0) AS vcr FROM sb LEFT JOIN lt USING (symbol) WINDOW w AS (PARTITION BY symbol ORDER BY dt)),
la AS (SELECT * FROM ti QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) = 1),
sc AS (SELECT *, CASE WHEN trade_value_rank <= 5 THEN 30 WHEN trade_value_rank <= 10 THEN 20 WHEN trade_value_rank <= 20 THEN 10 ELSE 0 END + CASE WHEN cl >= h252 THEN 100 WHEN cl >= h252 * 0.98 THEN 70 ELSE 0 END
   + CASE WHEN cl >= h20 THEN 40 WHEN cl >= h20 * 0.98 THEN 25 ELSE 0 END + CASE WHEN cl > ma5 THEN 10 ELSE 0 END + CASE WHEN cl > ma20 THEN 10 ELSE 0 END + CASE WHEN vcr >= 1.5 THEN 20 ELSE 0 END
   + CASE WHEN cl < op AND (op - cl) / op >= 0.03 THEN -30 ELSE 0 END AS tech FROM la),
sd AS (SELECT *, coalesce(hist >= 252 AND trade_value_rank <= 20 AND cl >= h252 * 0.98, false) AS forced, CASE WHEN coalesce(hist >= 252 AND trade_value_rank <= 20 AND cl >= h252 * 0.98, false) THEN greatest(tech, 100) ELSE tech END AS final FROM sc),
sg AS (SELECT *, CASE WHEN hist < 252 THEN '추천 제외' WHEN final >= 100 THEN '강력 후보' WHEN final >= 80 THEN '후보' WHEN final >= 60 THEN '관찰' ELSE '추천 제외' END AS grade FROM sd)"""


def standard(spark, sf):
    return screener.standardize(t.daily_bars(spark, sf), named(spark, sf))


@query("pf39_standard_bars", f"""WITH {SCREEN} SELECT symbol, name, {d("dt", "date")}, {r("trade_value")} FROM sb""")
def standard_bars(spark, sf):
    return standard(spark, sf).select("symbol", "name", "date", "trade_value")


@query("wn28_trade_value_rank", f"""WITH {SCREEN} SELECT symbol, {d("dt", "date")}, coalesce(trade_value_rank, -1) AS trade_value_rank FROM ti""")
def trade_value_rank(spark, sf):
    out = screener.trade_value_rank(standard(spark, sf))
    return out.select("symbol", "date", F.coalesce("trade_value_rank", F.lit(-1)).alias("trade_value_rank"))


@query(
    "wn27_screener_indicators",
    f"""WITH {SCREEN} SELECT symbol, {d("dt", "date")}, hist AS history_days, {r("ma5")}, {r("ma20")}, {r("h20", "close_20d_high")}, {r("h252", "close_52w_high")}, {r("vcr", "volume_change_rate")}, {il("vcr >= 1.5", "is_volume_spike")} FROM ti""",
)
def screener_indicators(spark, sf):
    out = screener.screener_indicators(standard(spark, sf))
    return out.select("symbol", "date", "history_days", "ma5", "ma20", "close_20d_high", "close_52w_high", "volume_change_rate", "is_volume_spike")


@query(
    "pf40_candle_shape",
    f"""WITH {SCREEN} SELECT symbol, {d("dt", "date")}, {il("cl > op", "is_bullish")}, {il("cl < op AND (op - cl) / op >= 0.03", "is_long_bearish")}, {il("cl >= hi - (hi - lo) * 0.25", "is_close_near_high")} FROM sb""",
)
def candle_shape(spark, sf):
    out = screener.screener_indicators(standard(spark, sf))
    return out.select("symbol", "date", "is_bullish", "is_long_bearish", "is_close_near_high")


@query(
    "pf41_candidate_score",
    f"""WITH {SCREEN} SELECT symbol, tech AS technical_score, final AS final_score, grade AS recommendation_grade, CAST(forced AS INT) AS is_forced_candidate FROM sg""",
)
def candidate_score(spark, sf):
    ranked = screener.trade_value_rank(standard(spark, sf))
    out = screener.score_candidates(screener.latest_rows(screener.screener_indicators(ranked)))
    return out.select("symbol", "technical_score", "final_score", "recommendation_grade", "is_forced_candidate")


@query(
    "tk05_screener_candidates",
    f"""WITH {SCREEN} SELECT symbol, final AS final_score, row_number() OVER (ORDER BY final DESC, trade_value_rank, vcr DESC, symbol) AS recommendation_rank FROM sg WHERE grade <> '추천 제외' AND cl >= h252 * 0.98 QUALIFY recommendation_rank <= 8""",
)
def screener_candidates(spark, sf):
    ranked = screener.trade_value_rank(standard(spark, sf))
    scored = screener.score_candidates(screener.latest_rows(screener.screener_indicators(ranked)))
    out = screener.select_candidates(scored, p=ScreenerParams(top_n=8))
    return out.select("symbol", "final_score", "recommendation_rank")


@query(
    "tk10_recommendations",
    f"""WITH {SCREEN} SELECT row_number() OVER (ORDER BY final DESC, trade_value_rank, vcr DESC, symbol) AS rank, symbol, name, grade, final AS final_score, 0.6::DOUBLE AS first_buy_ratio FROM sg
    WHERE trade_value_rank <= 20 AND grade <> '추천 제외' AND cl >= h252 * 0.98 QUALIFY rank <= 3""",
)
def recommendations(spark, sf):
    """The whole screen; only the most traded symbols reach the windows."""
    out = screener.screen(t.daily_bars(spark, sf), named(spark, sf))
    return out.select("rank", "symbol", "name", "grade", "final_score", "first_buy_ratio")


@query("tk09_article_cap", f"""WITH {CONTEXT} SELECT event_id, "Symbol" FROM ctx WHERE source_type = 'news' QUALIFY row_number() OVER (PARTITION BY "Symbol" ORDER BY event_id) <= 20""")
def article_cap(spark, sf):
    news = t.context_events(spark, sf).where(F.col("source_type") == "news")
    return screener.article_cap(news, "event_id", 20).select("event_id", "Symbol")


@query("tk09_default_symbols", """SELECT 'S' || s_suppkey AS "Symbol" FROM supplier WHERE s_suppkey % 3 <> 0 ORDER BY s_suppkey LIMIT 30""")
def default_symbols(spark, sf):
    s = t.table(spark, sf, "supplier")
    rows = s.select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("Symbol"), F.when(F.col("s_suppkey") % 3 == 0, "KOSDAQ").otherwise("Kospi").alias("Market"), F.col("s_suppkey").alias("seq"))
    return screener.default_symbols(rows, "seq", 30).select("Symbol")
