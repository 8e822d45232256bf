"""Queries over point-in-time joins and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import context
from tickloom.plans.registry import query
from tickloom.plans.sqltext import BARS, CALENDAR, CONTEXT, FLOWS, RETURNS, W, d, full, r
from tickloom.sources import tables as t


def region_series(spark, sf):
    """External series: daily mean close per region."""
    strata = t.strata(spark, sf).select("Symbol", F.col("sector").alias("series"))
    bars = t.daily_bars(spark, sf).join(strata, "Symbol")
    close = F.floor(F.sum("Close") / F.count(F.lit(1)) * 1e6 + 0.5) / 1e6
    return bars.groupBy("series", "Date").agg(close.alias("close"))


EXT = """
ext AS (SELECT 'R' || n_regionkey AS series, "Date", floor(sum("Close") / count(*) * 1e6 + 0.5) / 1e6 AS close FROM bars
  JOIN supplier ON "Symbol" = 'S' || s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2),
extr AS (SELECT *, close / lag(close) OVER w - 1 AS ret_1d FROM ext WINDOW w AS (PARTITION BY series ORDER BY "Date")),
lagged AS (SELECT series, "Date", CASE WHEN series = 'R0' THEN close ELSE lag(close) OVER w END AS close,
  CASE WHEN series = 'R0' THEN ret_1d ELSE lag(ret_1d) OVER w END AS ret_1d FROM extr WINDOW w AS (PARTITION BY series ORDER BY "Date")),
spine AS (SELECT c."Date", max(close) FILTER (series = 'R0') AS r0_close, max(ret_1d) FILTER (series = 'R0') AS r0_ret_1d,
  max(close) FILTER (series = 'R1') AS r1_close, max(ret_1d) FILTER (series = 'R1') AS r1_ret_1d
  FROM (SELECT DISTINCT "Date" FROM bars) c LEFT JOIN lagged USING ("Date") GROUP BY 1),
filled AS (SELECT "Date", last_value(r0_close IGNORE NULLS) OVER w AS r0_close, last_value(r0_ret_1d IGNORE NULLS) OVER w AS r0_ret_1d,
  last_value(r1_close IGNORE NULLS) OVER w AS r1_close, last_value(r1_ret_1d IGNORE NULLS) OVER w AS r1_ret_1d
  FROM spine WINDOW w AS (ORDER BY "Date" ROWS UNBOUNDED PRECEDING))"""


@query(
    "jn01_external_series",
    f"""WITH {BARS}, {EXT} SELECT {d()}, "Symbol", {r("r0_close")}, {r("r0_ret_1d")}, {r("r1_close")}, {r("r1_ret_1d")} FROM bars JOIN filled USING ("Date")""",
)
def external_series(spark, sf):
    out = context.add_external(t.daily_bars(spark, sf), region_series(spark, sf), ["R0", "R1"], same_date=("R0",))
    return out.select("Date", "Symbol", "r0_close", "r0_ret_1d", "r1_close", "r1_ret_1d")


SUBSTITUTES = """
named AS (SELECT 'R' || n_regionkey AS region, "Date", floor(sum("Close") / count(*) * 1e6 + 0.5) / 1e6 AS close FROM bars
  JOIN supplier ON "Symbol" = 'S' || s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2),
landed AS (SELECT used, "Date", close FROM named JOIN (VALUES ('R0', 'SOXX'), ('R1', '^VIX'), ('R1', 'VIXY'), ('R2', 'QQQ'), ('R3', 'EWY'), ('R4', '^KQ11')) v(region, used) USING (region)),
seen AS (SELECT used, "Date", close, close / lag(close) OVER w - 1 AS ret FROM landed WINDOW w AS (PARTITION BY used ORDER BY "Date")),
lagd AS (SELECT used, "Date", CASE WHEN used = '^KQ11' THEN close ELSE lag(close) OVER w END AS close, CASE WHEN used = '^KQ11' THEN ret ELSE lag(ret) OVER w END AS ret
  FROM seen WINDOW w AS (PARTITION BY used ORDER BY "Date")),
wide AS (SELECT c."Date", max(close) FILTER (used = 'SOXX') AS sox, max(close) FILTER (used = '^VIX') AS vix, max(close) FILTER (used = 'QQQ') AS qqq, max(ret) FILTER (used = 'QQQ') AS qret,
  max(close) FILTER (used = 'EWY') AS ewy, max(close) FILTER (used = '^KQ11') AS kq FROM (SELECT DISTINCT "Date" FROM bars) c LEFT JOIN lagd USING ("Date") GROUP BY 1)"""
SUBSTITUTED = {"sox_close": "sox", "vix_close": "vix", "ixic_close": "qqq", "nq_f_close": "qqq", "nq_f_ret_1d": "qret", "ks11_close": "ewy", "kq11_close": "kq"}


@query(
    "jn01b_series_substitutes",
    f"""WITH {BARS}, {SUBSTITUTES} SELECT {d()}, {", ".join(r(f'last_value({c} IGNORE NULLS) OVER w', n) for n, c in SUBSTITUTED.items())}, CAST(NULL AS DOUBLE) AS tnx_close
    FROM wide WINDOW w AS (ORDER BY "Date" ROWS UNBOUNDED PRECEDING)""",
)
def series_substitutes(spark, sf):
    """Series that did not land are read from their substitutes: lagged as the substitute is, one of them under two names."""
    places = F.create_map(*[F.lit(x) for x in ("R0", "SOXX", "R1", "^VIX", "R2", "QQQ", "R3", "EWY", "R4", "^KQ11")])
    named = region_series(spark, sf).withColumn("series", places[F.col("series")])
    landed = named.unionByName(named.where(F.col("series") == "^VIX").withColumn("series", F.lit("VIXY")))
    names = ["^SOX", "^VIX", "^IXIC", "NQ=F", "^KS11", "^KQ11", "^TNX"]
    return context.external_matrix(landed, t.daily_bars(spark, sf), names).select("Date", *SUBSTITUTED, "tnx_close")


@query(
    "jn02_investor_flows",
    f"""WITH {BARS}, {CALENDAR}, {FLOWS} SELECT {d()}, "Symbol", {r("coalesce(foreign_net_buy, \"Volume\")", "foreign_net_buy")},
    {r("coalesce(institution_net_buy, 0)", "institution_net_buy")} FROM bars LEFT JOIN flows USING ("Date", "Symbol")""",
)
def investor_flows(spark, sf):
    bars = t.daily_bars(spark, sf).withColumn("foreign_net_buy", F.col("Volume"))
    return context.add_flows(bars, t.flows(spark, sf)).select("Date", "Symbol", "foreign_net_buy", "institution_net_buy")


def disclosure_items(spark, sf):
    ev = t.context_events(spark, sf).where(F.col("source_type") == "disclosure")
    title = F.regexp_replace(F.regexp_replace("title", "purchase", "contract"), "error", "notice")
    return ev.select("Date", "Symbol", title.alias("title"))


SCORES = f"""{CONTEXT}, dscore AS (
  SELECT "Date", "Symbol", least(count(*) * 0.2::DOUBLE + sum(CASE WHEN provider = 'purchase' THEN 1 ELSE 0 END) * 0.3::DOUBLE, 1.0) AS disclosure_score
  FROM ctx WHERE source_type = 'disclosure' GROUP BY 1, 2)"""


@query("ag02_disclosure_daily_score", f"""WITH {SCORES} SELECT {d()}, "Symbol", {r("disclosure_score")} FROM dscore""")
def disclosure_daily_score(spark, sf):
    return context.disclosure_daily_scores(disclosure_items(spark, sf))


@query(
    "jn03_disclosure_join",
    f"""WITH {BARS}, {CALENDAR}, {SCORES}, moved AS (SELECT cal."Date", s."Symbol", disclosure_score FROM dscore s JOIN cal ON cal.day_no = s."Date" - DATE '2024-01-01')
    SELECT {d()}, "Symbol", {r("coalesce(disclosure_score, 0)", "disclosure_score")} FROM bars LEFT JOIN moved USING ("Date", "Symbol")""",
)
def disclosure_join(spark, sf):
    bars = t.daily_bars(spark, sf)
    scores = context.disclosure_daily_scores(disclosure_items(spark, sf))
    scores = scores.withColumn("day_no", F.datediff("Date", F.lit("2024-01-01").cast("date"))).drop("Date")
    moved = scores.join(F.broadcast(t.calendar(bars)), "day_no")
    return context.add_disclosure_scores(bars, moved).select("Date", "Symbol", "disclosure_score")


@query(
    "ag23_coverage_ratios",
    f"""WITH u AS (SELECT DISTINCT user_id AS k FROM events), c AS (SELECT s_suppkey, CASE WHEN s_suppkey IN (SELECT k FROM u) THEN 0 WHEN s_suppkey + 7 IN (SELECT k FROM u) THEN 1 WHEN s_suppkey * 2 IN (SELECT k FROM u) THEN 2 END AS step FROM supplier)
    SELECT count(*) AS requested, count(step) AS successful, count(*) - count(step) AS failed, count(*) FILTER (step > 0) AS substituted, {r("count(step) / count(*)", "ratio")} FROM c""",
)
def coverage_ratios(spark, sf):
    """Every supplier's series, with two substitutes each."""
    k = F.col("s_suppkey")
    listed = F.posexplode(F.array(k, k + 7, k * 2)).alias("step", "number")
    chains = t.table(spark, sf, "supplier").select(k, listed).select(
        F.concat(F.lit("S"), k).alias("series"), F.concat(F.lit("S"), F.col("number")).alias("used"), "step"
    )
    landed = t.table(spark, sf, "events").select(F.concat(F.lit("S"), F.col("user_id")).alias("series"), F.col("value").alias("close"))
    return context.source_coverage(context.choose_series(landed, chains))
