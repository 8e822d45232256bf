"""SQL fragments shared by the oracle statements."""

from __future__ import annotations


def r(expr: str, name: str | None = None) -> str:
    """Six decimals in SQL, the same arithmetic as ``r6``."""
    text = f"floor(({expr}) * 1e6 + 0.5) / 1e6"
    return f'{text} AS "{name or expr}"' if name or expr.isidentifier() else text


def fl(cond: str, name: str) -> str:
    """1.0 where true, else 0.0, as a double."""
    return f'CAST(CASE WHEN {cond} THEN 1 ELSE 0 END AS DOUBLE) AS "{name}"'


def il(cond: str, name: str) -> str:
    return f'CASE WHEN {cond} THEN 1 ELSE 0 END AS "{name}"'


def d(expr: str = '"Date"', name: str = "Date") -> str:
    return f'CAST({expr} AS VARCHAR) AS "{name}"'


BARS = """
bars AS (
  SELECT 'S' || l_suppkey AS "Symbol", CAST(l_shipdate AS DATE) AS "Date",
         arg_min(p, o) AS "Open", max(p * (1 + l_discount)) AS "High",
         min(p * (1 - l_tax)) AS "Low", arg_max(p, o) AS "Close", sum(l_quantity) AS "Volume"
  FROM (SELECT *, 100.0::DOUBLE + (l_extendedprice / l_quantity) % 20.0::DOUBLE AS p,
               l_orderkey * 10 + l_linenumber AS o FROM lineitem)
  GROUP BY 1, 2)"""

RETURNS = (
    BARS
    + """,
ret AS (
  SELECT *, row_number() OVER w - 1 AS bar_no, lag("Close") OVER w AS prev,
         "Close" * "Volume" AS value_traded,
         ln("Close" / lag("Close") OVER w) AS log_return,
         "Close" / lag("Close") OVER w - 1 AS daily_return
  FROM bars WINDOW w AS (PARTITION BY "Symbol" ORDER BY "Date"))"""
)

CALENDAR = """
cal AS (SELECT "Date", row_number() OVER (ORDER BY "Date") - 1 AS day_no FROM (SELECT DISTINCT "Date" FROM bars))"""

FLOWS = """
flows AS (
  SELECT c."Date", e."Symbol", e.foreign_net_buy, e.institution_net_buy FROM (
    SELECT 'S' || user_id AS "Symbol", CAST(ts AS DATE) - DATE '2024-01-01' AS day_no,
           sum(CASE WHEN event_type <> 'view' THEN round(value * s * 1e9) ELSE 0 END)::DOUBLE AS foreign_net_buy,
           sum(CASE WHEN event_type = 'view' THEN round(value * 1e9) ELSE round(value * s * -1e8) END)::DOUBLE AS institution_net_buy
    FROM (SELECT *, CASE WHEN event_type IN ('purchase', 'click') THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s FROM events)
    GROUP BY 1, 2) e JOIN cal c USING (day_no))"""

STRATA = """
strata AS (
  SELECT 'S' || s_suppkey AS "Symbol", s_name AS name, 'M' || (s_nationkey % 3) AS market_type, 'R' || n_regionkey AS sector
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

CONTEXT = """
ctx AS (
  SELECT CAST(ts AS DATE) AS "Date", 'S' || user_id AS "Symbol",
         CASE WHEN event_type IN ('purchase', 'error') THEN 'disclosure' ELSE 'news' END AS source_type,
         event_type || ' ' || props AS title, '' AS body, ts AS published_at, event_type AS provider,
         'https://example.com/' || (event_id % 997) AS url, CAST(event_id % 997 AS VARCHAR) AS raw_id, event_id
  FROM events)"""

NEWS = """
news AS (
  SELECT doc_id, split_part(text, chr(10), 1) AS title, text AS body,
         'https://' || source || '.example.com/' || substr(md5(text), 1, 12) || '/' AS url,
         CASE WHEN doc_id % 3 <> 0 THEN 'https://Origin.example.com/' || (doc_id % 400) END AS original_url, lang, source
  FROM documents)"""

W = 'PARTITION BY "Symbol" ORDER BY "Date"'


def full(agg: str, col: str, n: int, w: str = W) -> str:
    frame = f"OVER ({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({col}) {frame} = {n} THEN {agg}({col}) {frame} END"
