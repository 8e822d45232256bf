"""Queries over news text: keys, dedupe, mapping, tagging, scoring, reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tickloom.functions import clock, factors, taxonomy, text
from tickloom.operators import dedupe, impact, mapping, queries
from tickloom.operators.phrases import phrase_hits
from tickloom.operators.ranking import top_per_group
from tickloom.plans.registry import query
from tickloom.plans.sqltext import CONTEXT, NEWS, d, il, r
from tickloom.sources import pages, readers
from tickloom.session import cut_lineage
from tickloom.sources import tables as t

# ---------------------------------------------------------------- titles with taxonomy words

WORDS = sorted(
    {w for ws in factors.FACTOR_WORDS.values() for w in ws}
    | set(factors.POSITIVE_WORDS) | set(factors.NEGATIVE_WORDS) | set(factors.SELLING_WORDS) | set(factors.OIL_EASING)
    | set(factors.FX_SHOCK) | set(factors.IMPLIED_CREDIT) | set(factors.KOSDAQ_WORDS) | set(impact.BAD_WORDS)
    | {w for ws, *_ in taxonomy.DISCLOSURE_RULES for w in ws} | {w for ws, _ in taxonomy.CATEGORY_RULES for w in ws}
    | {w for _, ws in taxonomy.IMPACT_LABELS for w in ws} | set(text.INJECTION_PHRASES)
)


def titles(spark, sf):
    """Event rows whose titles and bodies carry taxonomy words."""
    words = F.array(*[F.lit(w) for w in WORDS])
    n = len(WORDS)
    pick = lambda k: F.get(words, (F.col("event_id") * k % n).cast("int"))
    ev = t.table(spark, sf, "events")
    return ev.select(
        "event_id", F.col("ts").cast("date").alias("Date"),
        F.concat(F.lpad((F.col("user_id") % 60).cast("string"), 6, "0"), F.when(F.col("user_id") % 5 == 0, ".KQ").otherwise(".KS")).alias("Symbol"),
        F.when(F.col("event_type").isin("purchase", "error"), "disclosure").otherwise("news").alias("source_type"),
        F.concat_ws(" ", pick(1), F.col("event_type"), pick(7)).alias("title"),
        F.when(F.col("event_id") % 4 == 0, pick(13)).otherwise("").alias("body"),
        F.concat(F.lit("https://example.com/"), F.col("event_id") % 97).alias("url"),
    )


def lit(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


WORD_SQL = "[" + ", ".join(lit(w) for w in WORDS) + "]"
N = len(WORDS)
TITLES = f"""
tt AS (SELECT event_id, CAST(ts AS DATE) AS "Date", lpad(CAST(user_id % 60 AS VARCHAR), 6, '0') || CASE WHEN user_id % 5 = 0 THEN '.KQ' ELSE '.KS' END AS "Symbol",
  CASE WHEN event_type IN ('purchase', 'error') THEN 'disclosure' ELSE 'news' END AS source_type,
  w[event_id % {N} + 1] || ' ' || event_type || ' ' || w[event_id * 7 % {N} + 1] AS title,
  CASE WHEN event_id % 4 = 0 THEN w[event_id * 13 % {N} + 1] ELSE '' END AS body, 'https://example.com/' || (event_id % 97) AS url
  FROM events, (SELECT {WORD_SQL} AS w))"""


def any_sql(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {lit(w)})" for w in words) + ")"


def low_any(words) -> str:
    return any_sql("low", [w.lower() for w in words])


FACTOR_SQL = (
    TITLES
    + ", fa AS (SELECT *, lower(title) AS low FROM tt), fb AS (SELECT *, "
    + ", ".join(f"{low_any(ws)} AS f_{c.lower()}" for c, ws in factors.FACTOR_WORDS.items())
    + " FROM fa), fc AS (SELECT * REPLACE (f_bok_credit OR (f_geo_oil AND "
    + any_sql("title", factors.IMPLIED_CREDIT)
    + ") AS f_bok_credit, f_governance OR (f_access AND contains(title, 'MSCI') AND "
    + any_sql("title", factors.IMPLIED_GOVERNANCE)
    + ") AS f_governance) FROM fb), fd AS (SELECT *, ("
    + " + ".join(f"f_{c.lower()}::INT" for c in factors.FACTOR_WORDS)
    + ") AS nf, ("
    + " OR ".join(f"(f_{c.lower()} AND {low_any(ws)})" for c, ws in factors.POSITIVE_BY_FACTOR.items())
    + f" OR ({low_any(factors.POSITIVE_WORDS)} AND NOT {low_any(factors.POSITIVE_BLOCKERS)})) AS pos, ("
    + " OR ".join(f"(f_{c.lower()} AND {low_any(ws)})" for c, ws in factors.NEGATIVE_BY_FACTOR.items())
    + f" OR {low_any(factors.NEGATIVE_WORDS)}) AS neg FROM fc), fe AS (SELECT *, CASE WHEN {low_any(factors.SELLING_WORDS)} THEN 'negative'"
    + f" WHEN f_geo_oil AND {low_any(factors.OIL_WORDS)} THEN CASE WHEN {low_any(factors.OIL_EASING)} THEN 'positive' ELSE 'mixed' END"
    + f" WHEN f_fx_krw AND {low_any(factors.FX_SHOCK)} THEN 'negative' WHEN pos AND neg THEN 'mixed' WHEN {low_any(factors.MIXED_WORDS)} THEN 'mixed'"
    + " WHEN pos THEN 'positive' WHEN neg THEN 'negative' WHEN nf > 0 THEN 'neutral' ELSE 'unknown' END AS direction FROM fd)"
)
FACTOR_LIST = "concat_ws(';', " + ", ".join(f"CASE WHEN f_{c.lower()} THEN '{c}' END" for c in factors.FACTOR_WORDS) + ")"


@query("fn06_factor_tags", f"""WITH {FACTOR_SQL} SELECT event_id, {FACTOR_LIST} AS factors FROM fe""")
def factor_tags(spark, sf):
    return factors.analyze(titles(spark, sf), "title").select("event_id", "factors")


@query("fn07_direction", f"""WITH {FACTOR_SQL} SELECT event_id, direction FROM fe""")
def direction(spark, sf):
    return factors.analyze(titles(spark, sf), "title").select("event_id", "direction")


HORIZON_SQL = """concat_ws(';', """ + ", ".join(
    [
        f"CASE WHEN {low_any(ws)} THEN '{h}' END" for h, ws in factors.HORIZON_WORDS.items()
    ]
) + ")"


@query(
    "fn08_factor_analysis",
    f"""WITH {FACTOR_SQL} SELECT event_id, CASE WHEN nf = 0 OR direction = 'unknown' THEN 'low' ELSE 'medium' END AS confidence,
    concat_ws(';', CASE WHEN f_us_risk OR f_us_rate OR f_semi OR f_export OR f_china OR f_bok_credit OR f_governance OR f_access OR f_geo_oil THEN 'KOSPI' END, CASE WHEN {any_sql("title", factors.KOSDAQ_WORDS)} THEN 'KOSDAQ' END,
      CASE WHEN f_fx_krw OR f_bok_credit OR f_geo_oil THEN 'KRW' END, CASE WHEN f_semi OR f_export OR f_china OR f_governance OR f_access OR f_geo_oil THEN 'sector' END, CASE WHEN f_flow THEN 'foreign_flow' END) AS affected_markets,
    concat_ws(';', CASE WHEN f_semi THEN 'semiconductor:' || CASE WHEN direction IN ('positive', 'mixed') THEN 'positive' ELSE direction END END, CASE WHEN f_fx_krw AND contains(title, '원화 약세') THEN 'auto:mixed' END,
      CASE WHEN f_geo_oil THEN 'manufacturing:negative;defense:mixed' END, CASE WHEN f_governance THEN 'bank:positive' END, CASE WHEN f_china THEN 'battery:negative' END) AS sectors,
    concat_ws(';', {", ".join(f"CASE WHEN {low_any(ws)} THEN {lit(label)} END" for label, ws in factors.FRESH_ITEMS)}) AS freshness_items,
    concat_ws(';', '투자 조언 아님', '확정되지 않은 전망을 사실처럼 단정하지 말 것', CASE WHEN {low_any(factors.FRESH_WORDS)} OR {" OR ".join(low_any(ws) for _, ws in factors.FRESH_ITEMS)} THEN {lit(factors.CAUTION_FRESH)} END,
      CASE WHEN f_geo_oil OR {any_sql("title", factors.CAUTION_OIL_WORDS)} THEN {lit(factors.CAUTION_OIL)} END, CASE WHEN f_access AND contains(title, 'MSCI') THEN {lit(factors.CAUTION_ACCESS)} END,
      CASE WHEN f_flow THEN {lit(factors.CAUTION_FLOW)} END, CASE WHEN f_semi THEN {lit(factors.CAUTION_SEMI)} END) AS cautions,
    concat_ws(';', {", ".join(f"CASE WHEN f_{c.lower()} THEN {lit(v)} END" for c, v in factors.IMPACT_PATH.items())}, CASE WHEN direction = 'unknown' THEN {lit(factors.IMPACT_PATH_UNKNOWN)} END) AS impact_path FROM fe""",
)
def factor_analysis(spark, sf):
    out = factors.analyze(titles(spark, sf), "title")
    sectors = F.transform("sector_impacts", lambda s: F.concat(s["sector"], F.lit(":"), s["direction"]))
    return out.select("event_id", "confidence", "affected_markets", sectors.alias("sectors"), "freshness_items", "cautions", "impact_path")


@query(
    "fn03_disclosure_taxonomy",
    f"""WITH {TITLES}, c AS (SELECT event_id, replace(replace(title, 'ㆍ', ''), ' ', '') AS s FROM tt)
    SELECT event_id, CASE WHEN {any_sql("s", taxonomy.DISCLOSURE_RULES[0][0])} THEN 'large_contract' WHEN {any_sql("s", taxonomy.DISCLOSURE_RULES[1][0])} THEN 'contract_cancel'
      WHEN {any_sql("s", taxonomy.DISCLOSURE_RULES[2][0])} THEN 'capital_raise' WHEN {any_sql("s", taxonomy.DISCLOSURE_RULES[3][0])} THEN 'litigation'
      WHEN {any_sql("s", taxonomy.DISCLOSURE_RULES[4][0])} THEN 'trading_halt' ELSE 'other' END AS detail,
      CASE WHEN {any_sql("s", taxonomy.DISCLOSURE_RULES[0][0])} THEN 0.9 WHEN {any_sql("s", taxonomy.DISCLOSURE_RULES[1][0])} THEN 0.9 WHEN {any_sql("s", taxonomy.DISCLOSURE_RULES[2][0])} THEN 1.0
      WHEN {any_sql("s", taxonomy.DISCLOSURE_RULES[3][0])} OR {any_sql("s", taxonomy.DISCLOSURE_RULES[4][0])} THEN 1.2 ELSE 0.3 END::DOUBLE AS importance FROM c""",
)
def disclosure_taxonomy(spark, sf):
    event = taxonomy.disclosure_event("title")
    return titles(spark, sf).select("event_id", event["detail_event_type"].alias("detail"), event["base_importance"].alias("importance"))


@query(
    "fn04_disclosure_category",
    f"""WITH {TITLES} SELECT event_id, CASE {" ".join(f"WHEN {any_sql('title', ws)} THEN '{label}'" for ws, label in taxonomy.CATEGORY_RULES)} ELSE 'general_disclosure' END AS category FROM tt""",
)
def disclosure_category(spark, sf):
    return titles(spark, sf).select("event_id", taxonomy.disclosure_category("title").alias("category"))


SECTOR_KEYWORDS = ["반도체", "AI", "HBM", "order", "click", "배당"]


@query(
    "fn05_impact_keywords",
    f"""WITH {TITLES}, k AS (SELECT unnest({"[" + ", ".join(lit(w.lower()) for w in SECTOR_KEYWORDS) + "]"}) AS kw),
    s AS (SELECT event_id, string_agg(kw, ';' ORDER BY kw) AS sector_keywords FROM tt, k WHERE CASE WHEN regexp_full_match(kw, '[a-z0-9]+') THEN regexp_matches(lower(title), '(^|[^a-z0-9])' || kw || '($|[^a-z0-9])') ELSE contains(lower(title), kw) END GROUP BY 1),
    l AS (SELECT event_id, concat_ws(';', {", ".join(f"CASE WHEN {any_sql('lower(title)', ws)} THEN '{label}' END" for label, ws in taxonomy.IMPACT_LABELS)}) AS labels FROM tt)
    SELECT event_id, labels, coalesce(sector_keywords, '') AS sector_keywords FROM l LEFT JOIN s USING (event_id) WHERE labels <> '' OR sector_keywords IS NOT NULL""",
)
def impact_keywords(spark, sf):
    """Rows with an impact label or a sector keyword; others are filtered out."""
    news = titles(spark, sf)
    keywords = spark.createDataFrame([(k,) for k in SECTOR_KEYWORDS], "keyword string")
    hits = queries.matched_keywords(news, "event_id", "title", keywords)
    found = hits.groupBy("event_id").agg(F.sort_array(F.collect_set("keyword")).alias("sector_keywords"))
    out = news.select("event_id", taxonomy.impact_labels("title").alias("labels")).join(found, "event_id", "left")
    empty = F.array().cast("array<string>")
    out = out.withColumn("sector_keywords", F.coalesce("sector_keywords", empty))
    return out.where((F.size("labels") > 0) | (F.size("sector_keywords") > 0))


RULE_SQL = (
    FACTOR_SQL.replace("lower(title) AS low", "lower(trim(title || ' ' || body)) AS low, trim(title || ' ' || body) AS full_text")
    .replace("contains(title,", "contains(full_text,")
    + f""", rs AS (SELECT *, substr("Symbol", 1, 6) AS ticker, {any_sql("low", impact.GOOD_WORDS)} AS good, {any_sql("low", impact.BAD_WORDS)} AS bad FROM fe),
rt AS (SELECT *, round_even(CASE WHEN source_type = 'disclosure' THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN direction = 'positive' THEN 30 WHEN direction = 'negative' THEN -30 WHEN good AND NOT bad THEN 25 WHEN bad AND NOT good THEN -25
   WHEN good AND bad THEN 0 WHEN source_type = 'disclosure' THEN 10 ELSE 5 END, 6) AS impact_score,
   CASE {" ".join(f"WHEN {any_sql('low', ws)} THEN '{label}'" for ws, label in impact.EVENT_WORDS)} WHEN source_type <> 'disclosure' AND {any_sql("low", impact.SECTOR_WORDS)} THEN 'sector' ELSE 'other' END AS event_type,
   CASE WHEN f_semi THEN 'semiconductor' WHEN f_export THEN 'export' WHEN f_governance THEN 'governance' ELSE '' END AS sector,
   round_even(CASE WHEN nf = 0 OR direction = 'unknown' THEN 0.45::DOUBLE ELSE 0.65::DOUBLE END + CASE WHEN source_type = 'disclosure' THEN 0.1::DOUBLE ELSE 0 END, 6) AS confidence,
   {low_any(factors.FRESH_WORDS)} OR {" OR ".join(low_any(ws) for _, ws in factors.FRESH_ITEMS)} AS fresh FROM rs),
ru AS (SELECT *, concat_ws(';', 'heuristic_display_only', CASE WHEN source_type = 'news' AND body = '' THEN 'news_title_only' END, CASE WHEN fresh THEN 'freshness_review_required' END) AS flags,
   substr(sha1('cluster|' || ticker || '|' || source_type || '|' || title), 1, 16) AS cluster_id, substr(sha1('event|' || ticker || '|' || source_type || '|' || title || '|' || url), 1, 16) AS eid FROM rt)"""
)


@query("fn09_heuristic_score", f"""WITH {RULE_SQL} SELECT event_id, {r("impact_score")} FROM ru""")
def heuristic_score(spark, sf):
    out = impact.rule_events(titles(spark, sf), "event_id")
    return out.select(F.col("_order").alias("event_id"), "impact_score")


@query(
    "fn10_rule_events",
    f"""WITH {RULE_SQL} SELECT event_id AS seq, ticker, eid AS event_id, cluster_id, sector, event_type, CASE WHEN impact_score > 0 THEN 'positive' WHEN impact_score < 0 THEN 'negative' ELSE 'neutral' END AS impact_direction,
    {r("abs(impact_score) / 100.0", "impact_strength")}, {r("confidence")}, flags AS risk_flags FROM ru""",
)
def rule_events(spark, sf):
    out = impact.rule_events(titles(spark, sf), "event_id")
    return out.select(
        F.col("_order").alias("seq"), "ticker", "event_id", "cluster_id", "sector", "event_type", "impact_direction",
        "impact_strength", "confidence", "risk_flags",
    )


RULE_ROWS = f"""{RULE_SQL}, cs AS (SELECT "Date", "Symbol", cluster_id, max(CASE WHEN impact_score > 0 THEN impact_score END) AS p, sum(CASE WHEN impact_score > 0 THEN impact_score END) AS ps,
   min(CASE WHEN impact_score < 0 THEN impact_score END) AS n, sum(CASE WHEN impact_score < 0 THEN impact_score END) AS ns, count(*) AS c FROM ru GROUP BY ALL),
ag AS (SELECT "Date", "Symbol", greatest(least(coalesce(sum(round_even(p + 0.2::DOUBLE * (ps - p), 6)), 0), 100), 0) AS pos, least(greatest(coalesce(sum(round_even(n + 0.2::DOUBLE * (ns - n), 6)), 0), -100), 0) AS neg, sum(c) AS event_count FROM cs GROUP BY 1, 2),
tp AS (SELECT "Date", "Symbol", arg_max(event_type, 'x' || lpad(CAST(round(abs(impact_score) * 100)::BIGINT AS VARCHAR), 8, '0') || lpad(CAST(10000000 - event_id AS VARCHAR), 9, '0')) AS top_event_type, avg(confidence) AS conf, arg_min(url, event_id) AS url FROM ru GROUP BY 1, 2),
fl0 AS (SELECT "Date", "Symbol", f, min(event_id * 10 + i) AS k FROM (SELECT "Date", "Symbol", event_id, unnest(string_split(flags, ';')) AS f, generate_subscripts(string_split(flags, ';'), 1) AS i FROM ru) GROUP BY 1, 2, 3),
fl1 AS (SELECT "Date", "Symbol", string_agg(f, ';' ORDER BY k) AS risk_flags FROM fl0 GROUP BY 1, 2),
rr AS (SELECT *, greatest(least(pos + neg, 100), -100) AS final_score, CASE WHEN pos > 0 AND neg < 0 THEN 15.0 ELSE 0.0 END AS unc FROM ag JOIN tp USING ("Date", "Symbol") JOIN fl1 USING ("Date", "Symbol"))"""


@query(
    "ag15_rule_summary",
    f"""WITH {RULE_ROWS} SELECT {d()}, "Symbol", {r("final_score")}, {r("pos", "positive_score")}, {r("neg", "negative_score")}, {r("unc", "uncertainty_score")}, {r("round_even(conf, 3)", "confidence")},
    event_count, top_event_type, risk_flags, url AS top_evidence_url FROM rr""",
)
def rule_summary(spark, sf):
    out = impact.rule_summary(impact.rule_events(titles(spark, sf), "event_id"))
    return out.select(
        "Date", "Symbol", "final_score", "positive_score", "negative_score", "uncertainty_score", "confidence", "event_count",
        "top_event_type", "risk_flags", "top_evidence_url",
    )


def predicted_keys(spark, sf):
    return titles(spark, sf).where(F.col("event_id") % 3 == 0).select("Date", "Symbol").distinct()


@query("jn06_events_of_predictions", f"""WITH {TITLES} SELECT event_id FROM tt WHERE ("Date", "Symbol") IN (SELECT ("Date", "Symbol") FROM tt WHERE event_id % 3 = 0)""")
def events_of_predictions(spark, sf):
    return impact.restrict_to_predictions(titles(spark, sf), predicted_keys(spark, sf)).select("event_id")


@query(
    "jn07_impact_on_predictions",
    f"""WITH {RULE_ROWS}, lastr AS (SELECT "Date" AS rd, substr("Symbol", 1, 6) AS rk, arg_max(final_score, "Symbol") AS final_score, arg_max(event_count, "Symbol") AS event_count FROM rr GROUP BY 1, 2),
    pk AS (SELECT DISTINCT "Date" AS pd, substr("Symbol", 1, 6) AS tk FROM tt)
    SELECT {d("pd")}, tk || '.KS' AS "Symbol", {r("final_score", "news_impact_final_score")}, event_count AS news_impact_event_count,
    coalesce(printf('%+.1f', final_score) || '점', '-') AS points, CASE WHEN final_score IS NULL THEN '-' ELSE '참고용·예측값 미반영' END AS note
    FROM pk LEFT JOIN lastr ON rd = pd AND rk = tk""",
)
def impact_on_predictions(spark, sf):
    predictions = titles(spark, sf).select("Date", F.concat(F.substring("Symbol", 1, 6), F.lit(".KS")).alias("Symbol")).distinct()
    rows = impact.rule_summary(impact.rule_events(titles(spark, sf), "event_id"))
    out = impact.append_impact(predictions, rows, "Symbol")
    return out.select(
        "Date", "Symbol", "news_impact_final_score", "news_impact_event_count", F.col("뉴스/공시 영향 점수").alias("points"),
        F.col("뉴스/공시 영향 참고").alias("note"),
    )


@query(
    "jn07b_impact_fallback",
    f"""WITH {RULE_ROWS}, pk AS (SELECT DISTINCT "Date" AS pd, "Symbol" AS ps, substr("Symbol", 1, 6) AS tk FROM tt WHERE event_id % 3 = 0),
    lastr AS (SELECT "Date" AS rd, substr("Symbol", 1, 6) AS rk, arg_max(final_score, "Symbol") AS final_score, arg_max(event_count, "Symbol") AS event_count FROM rr
      WHERE ("Date", "Symbol") IN (SELECT (pd, ps) FROM pk) GROUP BY 1, 2)
    SELECT {d("pd")}, ps AS "Symbol", {r("final_score", "news_impact_final_score")}, event_count AS news_impact_event_count, 'rule_based' AS actual_mode, 'no_landed_row_matches' AS fallback_reason
    FROM pk LEFT JOIN lastr ON rd = pd AND rk = tk""",
)
def impact_fallback(spark, sf):
    """The landed report is of another day: the rows come from the rules, restricted to what was predicted."""
    landed = impact.report_rows(scored_events(spark, sf), company_table(spark, sf), "1990-01-01", "run-0")
    out, mode = impact.impact_with_fallback(predicted_keys(spark, sf), landed, titles(spark, sf), "event_id")
    said = {c: F.lit(mode[c]) for c in ("actual_mode", "fallback_reason")}
    return out.select("Date", "Symbol", "news_impact_final_score", "news_impact_event_count").withColumns(said)


# ---------------------------------------------------------------- impact events from the log


def scored_events(spark, sf):
    e = F.col("event_id")
    flags = F.array_compact(
        F.array(
            F.when(e % 3 == 0, "thin_source"), F.when(e % 5 == 0, "semantic_cluster_failed"),
            F.when(e % 10 == 0, "semantic_cluster_failed:low_confidence"), F.when(e % 15 == 5, "semantic_cluster_failed:llm_error"),
        )
    )
    return t.table(spark, sf, "events").select(
        "event_id", F.lpad((F.col("user_id") % 50).cast("string"), 6, "0").alias("ticker"),
        F.concat(F.lit("c"), e % 700).alias("cluster_id"), ((e * 37 % 201 - 100) / F.when(e % 41 == 0, 4.0).otherwise(4000.0)).alias("impact_score"),
        (e * 13 % 101 / 100.0).alias("impact_strength"), (e * 7 % 101 / 100.0).alias("confidence"), F.col("event_type"),
        F.col("props").alias("reason"), F.lit("w").alias("why_may_be_wrong"), F.lit(0.0).alias("already_reflected_price_move"),
        F.array_compact(F.array(F.when(e % 2 == 0, F.concat(F.lit("https://e.com/"), e)))).alias("evidence_urls"),
        F.lit("unlisted").alias("company"), F.lit("none").alias("sector"), flags.alias("risk_flags"),
    )


EVENTS = """
se AS (SELECT event_id, lpad(CAST(user_id % 50 AS VARCHAR), 6, '0') AS ticker, 'c' || (event_id % 700) AS cluster_id, (event_id * 37 % 201 - 100) / CASE WHEN event_id % 41 = 0 THEN 4.0::DOUBLE ELSE 4000.0::DOUBLE END AS impact_score,
  (event_id * 13 % 101) / 100.0::DOUBLE AS impact_strength, (event_id * 7 % 101) / 100.0::DOUBLE AS confidence, event_type, props AS reason,
  list_filter([CASE WHEN event_id % 3 = 0 THEN 'thin_source' END, CASE WHEN event_id % 5 = 0 THEN 'semantic_cluster_failed' END, CASE WHEN event_id % 10 = 0 THEN 'semantic_cluster_failed:low_confidence' END,
    CASE WHEN event_id % 15 = 5 THEN 'semantic_cluster_failed:llm_error' END], lambda x: x IS NOT NULL) AS flags FROM events),
ecs AS (SELECT ticker, cluster_id, max(CASE WHEN impact_score > 0 THEN impact_score END) AS p, sum(CASE WHEN impact_score > 0 THEN impact_score END) AS ps,
   min(CASE WHEN impact_score < 0 THEN impact_score END) AS n, sum(CASE WHEN impact_score < 0 THEN impact_score END) AS ns, count(*) AS c FROM se GROUP BY ALL),
eag AS (SELECT ticker, greatest(least(coalesce(sum(round_even(p + 0.2::DOUBLE * (ps - p), 6)), 0), 100), 0) AS pos, least(greatest(coalesce(sum(round_even(n + 0.2::DOUBLE * (ns - n), 6)), 0), -100), 0) AS neg, sum(c) AS event_count FROM ecs GROUP BY 1)"""


@query(
    "ag13_cluster_scores",
    f"""WITH {EVENTS} SELECT ticker, cluster_id, {r("round_even(p + 0.2::DOUBLE * (ps - p), 6)", "positive")}, {r("round_even(n + 0.2::DOUBLE * (ns - n), 6)", "negative")} FROM ecs""",
)
def cluster_scores(spark, sf):
    return impact.cluster_scores(scored_events(spark, sf), ["ticker"]).drop("_events")


@query(
    "ag13_aggregate_scores",
    f"""WITH {EVENTS} SELECT ticker, {r("pos", "positive_score")}, {r("neg", "negative_score")}, {r("greatest(least(pos + neg, 100), -100)", "news_disclosure_score")},
    {r("least(100, CASE WHEN pos > 0 AND neg < 0 THEN 15.0 ELSE 0 END + 20)", "uncertainty_score")}, event_count FROM eag""",
)
def aggregate_scores(spark, sf):
    return impact.aggregate_scores(scored_events(spark, sf), ["ticker"], failed=2).drop("llm_failed_count")


def company_table(spark, sf):
    s = t.table(spark, sf, "supplier")
    return s.where(F.col("s_suppkey") % 2 == 0).select(
        F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("ticker"), F.col("s_name").alias("company"), F.lit("KOSPI").alias("market"),
        F.concat(F.lit("N"), F.col("s_nationkey")).alias("sector"),
    )


REPORT_SQL = f"""{EVENTS}, rp AS (SELECT ticker, arg_max(event_type, CAST(round(impact_strength * confidence * 10000)::BIGINT AS BIGINT) * 10000000 + event_id) AS top_event_type, max(confidence) AS confidence FROM se GROUP BY 1),
rf AS (SELECT ticker, string_agg(f, ';' ORDER BY f) AS risk_flags FROM (SELECT DISTINCT ticker, unnest(flags) AS f FROM se) GROUP BY 1),
rep AS (SELECT eag.ticker, coalesce(s_name, 'unlisted') AS company, coalesce('N' || s_nationkey, 'none') AS sector, pos, neg, greatest(least(pos + neg, 100), -100) AS score, confidence, event_count, top_event_type, risk_flags,
   CASE WHEN pos > 0 AND neg < 0 THEN 15.0 ELSE 0 END AS unc FROM eag JOIN rp USING (ticker) JOIN rf USING (ticker) LEFT JOIN supplier ON lpad(CAST(s_suppkey AS VARCHAR), 6, '0') = eag.ticker AND s_suppkey % 2 = 0)"""


@query(
    "ag14_report_rows",
    f"""WITH {REPORT_SQL} SELECT ticker, company, sector, {r("score", "news_disclosure_score")}, {r("confidence")}, event_count, top_event_type, risk_flags FROM rep""",
)
def report_rows(spark, sf):
    rows = impact.report_rows(scored_events(spark, sf), company_table(spark, sf), "2024-01-31", "run-1")
    return rows.select("ticker", "company", "sector", "news_disclosure_score", "confidence", "event_count", "top_event_type", "risk_flags")


@query(
    "tk04_report_ranking",
    f"""WITH {REPORT_SQL} SELECT ticker, {r("score", "news_disclosure_score")}, CAST(row_number() OVER (ORDER BY score DESC, confidence DESC, unc, ticker DESC) AS INTEGER) AS rank FROM rep""",
)
def report_ranking(spark, sf):
    rows = impact.report_rows(scored_events(spark, sf), company_table(spark, sf), "2024-01-31", "run-1")
    return impact.rank_report(rows, include_untradable=False).select("ticker", "news_disclosure_score", "rank")


@query("fn14_sector_neutral", f"""WITH {EVENTS} SELECT event_id, {r("greatest(least(impact_score * 4 - 0.5::DOUBLE * confidence * 100, 100), -100)", "sector_neutral_score")} FROM se""")
def sector_neutral(spark, sf):
    score = impact.sector_neutral(F.col("impact_score") * 4, F.col("confidence") * 100, beta=0.5)
    return scored_events(spark, sf).select("event_id", score.alias("sector_neutral_score"))


@query(
    "ag24_failure_causes",
    f"""WITH {EVENTS} SELECT substr(f, 25) AS cause, count(*) AS count FROM (SELECT unnest(flags) AS f FROM se) WHERE starts_with(f, 'semantic_cluster_failed:') GROUP BY 1""",
)
def failure_causes(spark, sf):
    return impact.failure_causes(scored_events(spark, sf))


@query(
    "ag24_failure_summary",
    f"""WITH {EVENTS}, s AS (SELECT count(*) AS n, sum(list_contains(flags, 'semantic_cluster_failed')::INT) AS f FROM se) SELECT n AS events, f AS failed_count, {r("f / n", "failure_rate")},
    concat_ws(';', CASE WHEN f > 0 THEN 'semantic_cluster_failed' END, CASE WHEN f > 0 AND f / n >= 0.2 THEN 'semantic_clustering_degraded' END) AS audit_flags FROM s""",
)
def failure_summary(spark, sf):
    return impact.failure_summary(scored_events(spark, sf))


@query(
    "st08_flag_lists",
    f"""WITH {EVENTS} SELECT event_id, array_to_string(list_filter(flags, lambda x: x <> 'thin_source'), ';') AS risk_flags FROM se""",
)
def flag_lists(spark, sf):
    doubled = F.concat("risk_flags", "risk_flags")
    return scored_events(spark, sf).select("event_id", dedupe.without_flags(doubled, ["thin_source"]).alias("risk_flags"))


def judgements(spark, sf):
    ev = scored_events(spark, sf)
    full = F.to_json(
        F.struct(
            F.when(F.col("event_id") % 4 == 0, "supply_chain").when(F.col("event_id") % 4 == 1, "earnings").otherwise(F.col("event_type")).alias("event_type"),
            F.lit("positive").alias("direction"), "impact_score", "impact_strength", "confidence", F.lit("next_day").alias("time_horizon"),
            "reason", "why_may_be_wrong", "risk_flags",
        )
    )
    cut = F.to_json(F.struct(F.lit("legal").alias("event_type"), "impact_score"))
    return ev.select(
        F.col("event_id").alias("doc_id"), "ticker", F.when(F.col("event_id") % 9 == 0, cut).otherwise(full).alias("payload"),
        F.lit(0.5).alias("candidate_confidence"), F.array(F.lit("weak_relation"), F.lit("thin_source")).alias("candidate_flags"),
    )


@query(
    "fn11_judgement_events",
    f"""WITH {EVENTS} SELECT event_id AS doc_id, CASE WHEN event_id % 9 = 0 THEN 'legal' WHEN event_id % 4 = 0 THEN 'sector' WHEN event_id % 4 = 1 THEN 'earnings' ELSE 'other' END AS event_type,
    CASE WHEN event_id % 9 <> 0 THEN {r("confidence * 0.5")} END AS confidence, CASE WHEN event_id % 9 = 0 THEN 'missing:direction,impact_strength,confidence,time_horizon,reason,why_may_be_wrong,risk_flags' END AS reject_reason,
    array_to_string(CASE WHEN event_id % 9 = 0 THEN ['weak_relation', 'thin_source'] ELSE list_concat(flags, list_filter(['weak_relation', 'thin_source'], lambda x: NOT list_contains(flags, x))) END, ';') AS risk_flags FROM se""",
)
def judgement_events(spark, sf):
    out = impact.judged_events(judgements(spark, sf))
    return out.select("doc_id", "event_type", "confidence", "reject_reason", "risk_flags")


def semantic_input(spark, sf):
    e = F.col("event_id")
    key = F.to_json(
        F.struct(
            F.concat(F.lit(" Subject "), e % 40).alias("event_subject"), F.col("event_type"),
            F.when(e % 12 == 0, "unknown").when(e % 3 == 0, "N/A").otherwise(F.concat(F.lit("Party-"), e % 7)).alias("counterparty"),
            F.concat(F.lit("Widget "), e % 4, F.lit("gb")).alias("product_or_asset"), F.when(e % 2 == 0, "unknown").otherwise("Deal!").alias("event_action"),
            F.lit("none").alias("event_date"), F.when(e % 11 == 0, "soon").when(e % 5 == 0, "0.4").otherwise("0.9").alias("cluster_confidence"),
        )
    )
    short = F.to_json(F.struct(F.lit("x").alias("event_subject")))
    return scored_events(spark, sf).withColumns(
        {"risk_flags": F.array(F.lit("old")), "semantic_key": F.when(e % 13 == 0, None).when(e % 17 == 0, short).otherwise(key)}
    )


@query(
    "fn13_semantic_clusters",
    f"""WITH {EVENTS}, k AS (SELECT *, CASE WHEN event_id % 13 = 0 THEN 'llm_error' WHEN event_id % 17 = 0 THEN 'missing_required_keys' WHEN event_id % 11 = 0 THEN 'invalid_confidence' WHEN event_id % 5 = 0 THEN 'low_confidence'
      WHEN event_id % 12 = 0 THEN 'insufficient_key_fields' END AS why, CASE WHEN event_id % 3 = 0 THEN 'n a' ELSE 'party-' || event_id % 7 END AS party FROM se)
    SELECT event_id, CASE WHEN why IS NULL THEN 'cluster-semantic-' || substr(sha1(concat_ws(':', ticker, 'subject ' || event_id % 40, event_type, party, 'widget', CASE WHEN event_id % 2 = 0 THEN 'unknown' ELSE 'deal' END, 'none')), 1, 12) ELSE cluster_id END AS cluster_id,
    concat_ws(';', 'old', CASE WHEN why IS NOT NULL THEN 'semantic_cluster_failed;semantic_cluster_failed:' || why END) AS risk_flags
    FROM k""",
)
def semantic_clusters(spark, sf):
    return impact.semantic_clusters(semantic_input(spark, sf)).select("event_id", "cluster_id", "risk_flags")


# ---------------------------------------------------------------- documents as news


NK = """
nk AS (SELECT doc_id, regexp_replace(trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}_\\s가-힣]', ' ', 'g')), '\\s+', ' ', 'g') AS tk,
  'url:' || rtrim(lower(original_url), '/') AS k2, 'url:' || rtrim(lower(url), '/') AS k3, * EXCLUDE (doc_id) FROM news)"""


@query(
    "fn01_title_and_url_keys",
    f"""WITH {NEWS}, {NK} SELECT doc_id, trim(tk) AS title_key, substr(k3, 5) AS url_key FROM nk""",
)
def title_and_url_keys(spark, sf):
    return t.news_rows(spark, sf).select("doc_id", text.title_key("title").alias("title_key"), text.url_key("url").alias("url_key"))


@query(
    "fn02_stable_ids",
    f"""WITH {NEWS}, {NK} SELECT doc_id, 'cluster-' || substr(sha1('news:' || trim(tk)), 1, 12) AS cluster_id, substr(sha1(lang || '|' || source || '|' || doc_id), 1, 16) AS stable_id, sha256(body) AS digest FROM nk""",
)
def stable_ids(spark, sf):
    return t.news_rows(spark, sf).select(
        "doc_id", text.news_cluster_id("title").alias("cluster_id"), text.stable_id("lang", "source", "doc_id").alias("stable_id"),
        F.sha2("body", 256).alias("digest"),
    )


GREEDY = f"""WITH RECURSIVE {NEWS}, {NK}, o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n, list_filter(['title:' || trim(tk), k2, k3], lambda x: x IS NOT NULL) AS ks FROM nk),
walk AS (SELECT 0::BIGINT AS n, []::VARCHAR[] AS seen, false AS keep UNION ALL
  SELECT o.n, CASE WHEN list_has_any(walk.seen, o.ks) THEN walk.seen ELSE list_concat(walk.seen, o.ks) END, NOT list_has_any(walk.seen, o.ks) FROM walk JOIN o ON o.n = walk.n + 1)"""


@query("st04_greedy_news_dedupe", GREEDY + " SELECT doc_id FROM walk JOIN o USING (n) WHERE keep")
def greedy_news_dedupe(spark, sf):
    return dedupe.dedupe_news(t.news_rows(spark, sf), "doc_id").select("doc_id")


@query(
    "fn02_sequential_cluster_ids",
    GREEDY + " SELECT doc_id, 'cluster-news-' || CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END AS cluster_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM walk JOIN o USING (n) WHERE keep)",
)
def sequential_cluster_ids(spark, sf):
    kept = dedupe.dedupe_news(t.news_rows(spark, sf), "doc_id").select("doc_id")
    return dedupe.sequential_cluster_ids(kept, "doc_id")


@query("st05_disclosure_dedupe", f"""WITH {CONTEXT} SELECT raw_id, min(event_id) AS event_id FROM ctx WHERE source_type = 'disclosure' GROUP BY 1""")
def disclosure_dedupe(spark, sf):
    rows = t.context_events(spark, sf).where(F.col("source_type") == "disclosure")
    return dedupe.dedupe_disclosures(rows, "event_id", "raw_id").select("raw_id", "event_id")


@query("st06_search_dedupe", f"""WITH {CONTEXT} SELECT min(event_id) AS event_id, url, title FROM ctx GROUP BY url, title""")
def search_dedupe(spark, sf):
    return dedupe.dedupe_search_results(t.context_events(spark, sf), ["event_id"]).select("event_id", "url", "title")


@query(
    "st02_context_dedupe",
    f"""WITH {CONTEXT} SELECT {d()}, "Symbol", source_type, title, raw_id, min(event_id) AS event_id FROM ctx WHERE "Date" BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY "Date", "Symbol", source_type, title, raw_id""",
)
def context_dedupe(spark, sf):
    rows = dedupe.dedupe_context(t.context_events(spark, sf), "event_id", F.lit(date(2024, 1, 5)), F.lit(date(2024, 1, 20)))
    return rows.select("Date", "Symbol", "source_type", "title", "raw_id", "event_id")


@query(
    "st03_result_news_union",
    f"""WITH {CONTEXT}, u AS (SELECT 0 AS f, * FROM ctx WHERE source_type = 'news' UNION ALL SELECT 1, * FROM ctx WHERE event_id % 2 = 0)
    SELECT {d()}, "Symbol", source_type, title, event_id FROM u QUALIFY row_number() OVER (PARTITION BY "Date", "Symbol", source_type, title ORDER BY f, event_id) = 1""",
)
def result_news_union(spark, sf):
    ctx = t.context_events(spark, sf)
    out = dedupe.merge_result_news(ctx.where(F.col("source_type") == "news").drop("provider"), ctx.where(F.col("event_id") % 2 == 0), "event_id")
    return out.select("Date", "Symbol", "source_type", "title", "event_id")


@query("st01_panel_union", f"""WITH {CONTEXT} SELECT event_id, source_type, CASE WHEN source_type = 'news' THEN provider END AS provider FROM ctx""")
def panel_union(spark, sf):
    ctx = t.context_events(spark, sf)
    news = ctx.where(F.col("source_type") == "news").select("event_id", "source_type", "provider")
    filed = ctx.where(F.col("source_type") == "disclosure").select("source_type", "event_id")
    return news.unionByName(filed, allowMissingColumns=True)


@query(
    "ag16_title_clusters",
    f"""WITH {TITLES}, k AS (SELECT *, regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}_\\s가-힣]', '', 'g') AS cluster_key FROM tt WHERE source_type = 'news'),
    g AS (SELECT "Symbol", cluster_key, count(*) AS article_count, arg_min(title, event_id) AS representative_title FROM k GROUP BY 1, 2)
    SELECT "Symbol", cluster_key, article_count, representative_title, {r("round_even(1000.0 / article_count, 0) / 1000", "novelty_score")} FROM g QUALIFY row_number() OVER (PARTITION BY "Symbol" ORDER BY article_count DESC, cluster_key) <= 12""",
)
def title_clusters(spark, sf):
    news = titles(spark, sf).where(F.col("source_type") == "news")
    out = impact.title_clusters(news, ["Symbol"], "event_id")
    return out.select("Symbol", "cluster_key", "article_count", "representative_title", "novelty_score")


@query(
    "ag27_event_digest",
    f"""WITH {TITLES}, k AS (SELECT * FROM tt QUALIFY row_number() OVER (PARTITION BY "Symbol", source_type ORDER BY event_id) <= 4),
    g AS (SELECT "Symbol", count(*) FILTER (source_type = 'disclosure') AS nd, count(*) FILTER (source_type = 'news') AS nn, string_agg('- ' || title, chr(10) ORDER BY event_id) FILTER (source_type = 'news') AS nt FROM k GROUP BY 1)
    SELECT "Symbol", "Symbol" || ' 기준 당일 공시 ' || nd || '건, 뉴스 ' || nn || '건을 정리했습니다.' AS one_line_summary, '[뉴스 요약]' || chr(10) || coalesce(nt, '- 확인된 핵심 뉴스 내용 없음') AS news_summary, nd + nn AS source_count FROM g""",
)
def event_digest(spark, sf):
    return impact.event_digest(titles(spark, sf), "event_id").select("Symbol", "one_line_summary", "news_summary", "source_count")


@query(
    "fn12_injection_and_text_flags",
    f"""WITH {TITLES}, a AS (SELECT *, CASE WHEN body = '' THEN '' ELSE body || repeat('x', CAST(event_id % 3000 AS INT)) END AS raw_text FROM tt)
    SELECT event_id, length(CASE WHEN raw_text <> '' THEN raw_text[:1500] ELSE title END) AS n_chars, CAST(raw_text <> '' AS INT) AS usable,
    concat_ws(';', 'base', CASE WHEN raw_text <> '' AND {any_sql("lower(raw_text)", text.INJECTION_PHRASES)} THEN 'prompt_injection_risk' END, CASE WHEN raw_text = '' THEN 'summary_only_no_full_text;needs_full_text_review' END, CASE WHEN length(raw_text) > 1500 THEN 'article_truncated' END) AS flags FROM a""",
)
def injection_and_text_flags(spark, sf):
    raw = F.when(F.col("body") == "", "").otherwise(F.concat("body", F.repeat(F.lit("x"), (F.col("event_id") % 3000).cast("int"))))
    judged, flags, usable = text.article_input(raw, F.col("title"), F.array(F.lit("base")))
    return titles(spark, sf).select("event_id", F.length(judged).alias("n_chars"), usable.alias("usable"), flags.alias("flags"))


@query(
    "fn16_issue_tone",
    f"""WITH {EVENTS} SELECT event_id, CASE WHEN event_id % 4 = 0 AND confidence <= 0 THEN '중립' WHEN confidence * 0.55 + (impact_score / 25 + 1) / 2 * 0.45 >= 0.66 THEN '호재' WHEN confidence * 0.55 + (impact_score / 25 + 1) / 2 * 0.45 <= 0.4 THEN '악재' ELSE '중립' END AS tone,
    CASE WHEN event_id % 4 = 0 THEN '수집된 뉴스가 없어 뉴스 기반 해석 정보가 제한적입니다.' ELSE '뉴스 ' || (event_id % 4) || '건 기준으로 관련도 ' || printf('%.2f', impact_strength) || ', 단기 톤은 ' || CASE WHEN impact_score / 25 < -0.15 THEN '부정' WHEN abs(impact_score / 25) <= 0.15 THEN '중립' ELSE '긍정' END || '으로 해석됩니다.' END AS news FROM se""",
)
def issue_tone(spark, sf):
    rows = scored_events(spark, sf).withColumns(
        {
            "disclosure_score": F.col("confidence"), "news_impact_score": F.col("impact_score") / 25,
            "news_relevance_score": F.col("impact_strength"), "news_article_count": F.col("event_id") % 4,
        }
    )
    return impact.issue_texts(rows).select("event_id", F.col("종합 판단").alias("tone"), F.col("뉴스 요약").alias("news"))


@query(
    "fn17_symbol_parsing",
    """SELECT DISTINCT s AS symbol, CASE WHEN regexp_full_match(split_part(s, '.', 1), '\\d{6}') THEN split_part(s, '.', 1) END AS ticker, CASE WHEN upper(s) LIKE '%.KQ' THEN 'KOSDAQ' ELSE 'KOSPI' END AS market FROM (
      SELECT CASE WHEN regexp_full_match(u, '\\d{6}') THEN u || '.KS' ELSE u END AS s FROM (SELECT upper(trim(unnest(string_split(lpad(CAST(user_id AS VARCHAR), 6, '0') || ', s' || user_id || ',' || lpad(CAST(user_id % 7 AS VARCHAR), 6, '0') || '.kq,', ',')))) AS u FROM events) WHERE u <> '')""",
)
def symbol_parsing(spark, sf):
    ev = t.table(spark, sf, "events")
    code = F.lpad(F.col("user_id").cast("string"), 6, "0")
    typed = F.concat(code, F.lit(", s"), F.col("user_id"), F.lit(","), F.lpad((F.col("user_id") % 7).cast("string"), 6, "0"), F.lit(".kq,"))
    parts = ev.select(F.explode(F.split(typed, ",")).alias("part")).where(F.trim("part") != "")
    out = parts.select(text.provider_symbol(F.col("part")).alias("symbol")).distinct()
    return out.select("symbol", text.ticker("symbol").alias("ticker"), text.market("symbol").alias("market"))


@query(
    "fn20_context_to_items",
    f"""WITH {TITLES} SELECT event_id, substr("Symbol", 1, 6) AS ticker, source_type, CASE WHEN "Symbol" LIKE '%.KQ' THEN 'KOSDAQ' ELSE 'KOSPI' END AS market, CASE WHEN source_type = 'news' THEN 'manual' END AS timestamp_source,
    CASE WHEN source_type = 'disclosure' THEN 'synthetic-' || substr("Symbol", 1, 6) || '-' || event_id END AS receipt_no FROM tt""",
)
def context_to_items(spark, sf):
    rows = titles(spark, sf).withColumns({"published_at": F.lit(None).cast("timestamp"), "provider": F.lit(""), "raw_id": F.lit("")})
    out = readers.context_to_items(rows, "2024-01-31", "event_id")
    return out.select("event_id", "ticker", "source_type", "market", "timestamp_source", "receipt_no")


def page_text_sql() -> str:
    """The text of ``html`` in SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    out = "coalesce(html, '')"
    for pattern in pages.CUTS:
        out = f"regexp_replace({out}, {quoted(pattern)}, ' ', 'g')"
    for name, char in pages.REFERENCES * 2:
        out = f"replace({out}, {quoted(name)}, {quoted(char)})"
    return f"trim(regexp_replace({out}, {quoted(pages.SPACES)}, ' ', 'g'))"


@query(
    "fn15_article_extraction",
    f"""WITH p AS (SELECT page_id, {page_text_sql()} AS t FROM pages), j AS (SELECT *, length(t) < {pages.MIN_CHARS} AS short,
      {" OR ".join(f"contains(lower(t), '{m}')" for m in pages.PAYWALL_MARKERS)} AS blocked FROM p)
    SELECT page_id, CAST(NOT (short OR blocked) AS INTEGER) AS ok, CASE WHEN short THEN 'article text too short' WHEN blocked THEN 'article appears paywalled or blocked' END AS error,
      CASE WHEN short THEN 'article_text_too_short;needs_full_text_review' WHEN blocked THEN 'article_fetch_failed;needs_full_text_review' ELSE '' END AS risk_flags,
      CASE WHEN short OR blocked THEN 0 ELSE length(t) END AS n_chars, md5(CASE WHEN short OR blocked THEN '' ELSE t END) AS text_md5 FROM j""",
)
def article_extraction(spark, sf):
    """Visible text of every page."""
    out = pages.extract_articles(t.table(spark, sf, "pages"))
    return out.select("page_id", "ok", "error", "risk_flags", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


# ---------------------------------------------------------------- company dictionary from frequent words


def frequent_words(spark, sf):
    """The 18 most frequent words of 4, 5, 6 and 8 letters: 72 rows, written once."""
    words = t.table(spark, sf, "documents").select(F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("w"))
    counted = words.where(F.col("w").rlike("^[a-z]{4,8}$")).groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    sized = counted.withColumn("n", F.length("w")).where(F.col("n").isin(4, 5, 6, 8))
    return cut_lineage(top_per_group(sized, ["n"], [F.col("c").desc(), F.col("w")], 18))


def pick_words(words, n: int, limit: int, name: str):
    return words.where((F.col("n") == n) & (F.col("pos") <= limit)).select(F.col("w").alias(name), (F.col("pos") - 1).alias("seq"))


def companies(words):
    a, b, c = (pick_words(words, n, 12, p) for n, p in ((6, "ticker"), (8, "corp_code"), (5, "company")))
    return a.join(b, "seq").join(c, "seq")


def aliases(words):
    names = pick_words(words, 4, 18, "alias").withColumn("_own", F.col("seq") % 12)
    firms = companies(words).select(F.col("seq").alias("_own"), "ticker")
    one = names.join(firms, "_own").select("ticker", "alias", "seq", (0.95 - F.col("seq") * 0.01).alias("confidence"))
    two = names.where(F.col("seq") % 5 == 0).withColumn("_own", (F.col("seq") + 1) % 12).join(firms, "_own")
    return one.unionByName(two.select("ticker", "alias", (F.col("seq") + 100).alias("seq"), F.lit(0.9).alias("confidence")))


def freq_sql(n: int, limit: int, name: str) -> str:
    return f"""(SELECT w AS {name}, row_number() OVER (ORDER BY c DESC, w) - 1 AS seq FROM (SELECT w, count(*) AS c FROM (SELECT DISTINCT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents) WHERE regexp_full_match(w, '[a-z]{{{n}}}') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {limit}))"""


DICTIONARY = f"""
co AS (SELECT a.seq, ticker, corp_code, company FROM {freq_sql(6, 12, "ticker")} a JOIN {freq_sql(8, 12, "corp_code")} b USING (seq) JOIN {freq_sql(5, 12, "company")} c USING (seq)),
nick AS (SELECT alias, seq FROM {freq_sql(4, 18, "alias")}),
al AS (SELECT co.ticker, alias, nick.seq, 0.95::DOUBLE - nick.seq * 0.01::DOUBLE AS confidence FROM nick JOIN co ON co.seq = nick.seq % 12
       UNION ALL SELECT co.ticker, alias, nick.seq + 100, 0.9 FROM nick JOIN co ON co.seq = (nick.seq + 1) % 12 WHERE nick.seq % 5 = 0),
sh AS (SELECT alias, count(DISTINCT ticker) > 1 AS shared FROM al GROUP BY 1),
tx AS (SELECT doc_id, lower(regexp_replace(trim(text, ' ' || chr(10) || chr(9)), '\\s+', ' ', 'g')) AS s FROM documents),
wd AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(s, '[^\\p{{L}}\\p{{N}}_]+')) AS w FROM tx),
ca AS (SELECT doc_id, ticker, 1.0::DOUBLE AS confidence, 'ticker' AS evidence, 3 AS pr, '' AS flags, 0 AS step, seq FROM wd JOIN co ON w = ticker
  UNION ALL SELECT doc_id, ticker, 1.0, 'corp_code', 3, '', 1, seq FROM wd JOIN co ON w = corp_code
  UNION ALL SELECT doc_id, ticker, 1.0, 'company:' || company, 2, '', 2, seq FROM tx JOIN co ON contains(s, company)
  UNION ALL SELECT doc_id, al.ticker, CASE WHEN shared THEN least(confidence, 0.6) ELSE confidence END, 'alias:' || alias, 1, CASE WHEN shared THEN 'ambiguous_mapping' ELSE '' END, 3, al.seq FROM tx JOIN al ON contains(s, alias) JOIN sh USING (alias)),
best AS (SELECT * FROM ca QUALIFY row_number() OVER (PARTITION BY doc_id, ticker ORDER BY confidence DESC, pr DESC, step, seq) = 1)"""


def mapped(spark, sf, words=None):
    words = frequent_words(spark, sf) if words is None else words
    docs = t.table(spark, sf, "documents").select("doc_id", "text")
    return mapping.company_candidates(docs, "doc_id", "text", companies(words), aliases(words))


@query("jn08_company_mapping", f"""WITH {DICTIONARY} SELECT doc_id, ticker, {r("confidence")}, evidence, flags AS risk_flags FROM best""")
def company_mapping(spark, sf):
    return mapped(spark, sf).select("doc_id", "ticker", "confidence", "evidence", "risk_flags")


@query("jn09_ambiguous_aliases", f"""WITH {DICTIONARY} SELECT doc_id, ticker, {r("confidence")}, evidence FROM best WHERE flags = 'ambiguous_mapping'""")
def ambiguous_aliases(spark, sf):
    out = mapped(spark, sf).where(F.array_contains("risk_flags", "ambiguous_mapping"))
    return out.select("doc_id", "ticker", "confidence", "evidence")


@query(
    "jn08b_phrase_dictionary",
    """WITH tx AS (SELECT doc_id, lower(text) AS s, list_filter(string_split(lower(text), ' '), lambda w: w <> '') AS w FROM documents),
    ph AS (SELECT DISTINCT p FROM (SELECT w[1] || ' ' || w[2] AS p FROM tx WHERE len(w) > 1 UNION ALL SELECT w[len(w)] FROM tx UNION ALL SELECT substr(w[3], 2, 6) FROM tx WHERE len(w) > 2) WHERE length(p) > 5)
    SELECT doc_id, md5(p) AS phrase_md5 FROM tx JOIN ph ON contains(s, p)""",
)
def phrase_dictionary(spark, sf):
    """A dictionary of thousands: every document's first two words, its last word and a piece of its third."""
    tx = t.table(spark, sf, "documents").select("doc_id", F.lower("text").alias("s"))
    words = tx.select(F.filter(F.split("s", " "), lambda w: w != "").alias("w"))
    pair = F.when(F.size("w") > 1, F.concat(F.get("w", F.lit(0)), F.lit(" "), F.get("w", F.lit(1))))
    piece = F.when(F.size("w") > 2, F.substring(F.get("w", F.lit(2)), 2, 6))
    listed = words.select(F.explode(F.array(pair, F.try_element_at("w", F.lit(-1)), piece)).alias("p")).where(F.length("p") > 5)
    return phrase_hits(tx, "doc_id", "s", listed, "p").select("doc_id", F.md5("p").alias("phrase_md5"))


ORDERED = f"""{DICTIONARY}, od AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, CASE WHEN evidence = 'ticker' THEN 1 ELSE 0 END DESC, ticker DESC) AS pos FROM best)"""


@query("tk06_candidate_order", f"""WITH {ORDERED} SELECT doc_id, ticker, pos FROM od""")
def candidate_order(spark, sf):
    return mapping.order_candidates(mapped(spark, sf), "doc_id").select("doc_id", "ticker", "pos")


def relationships(firms):
    a = firms.select("seq", "ticker")
    b = firms.select(((F.col("seq") + 11) % 12).alias("seq"), F.col("ticker").alias("related_ticker"))
    return a.join(b, "seq").select("seq", "ticker", "related_ticker", F.lit("supplier").alias("relation_type"), (F.col("seq") / 20.0).alias("relation_strength"))


@query(
    "jn10_relationship_expansion",
    f"""WITH {ORDERED}, rl AS (SELECT a.seq, a.ticker, b.ticker AS related, a.seq / 20.0 AS strength FROM co a JOIN co b ON b.seq = (a.seq + 1) % 12),
    hop AS (SELECT od.doc_id, related, 'relationship:' || od.ticker AS evidence, least(confidence, 0.7) AS confidence FROM od JOIN rl USING (ticker) WHERE NOT EXISTS (SELECT 1 FROM od o2 WHERE o2.doc_id = od.doc_id AND o2.ticker = related)
      QUALIFY row_number() OVER (PARTITION BY od.doc_id, related ORDER BY pos, rl.seq) = 1)
    SELECT doc_id, ticker, {r("confidence")}, evidence FROM od UNION ALL SELECT doc_id, related, {r("confidence")}, evidence FROM hop""",
)
def relationship_expansion(spark, sf):
    words = frequent_words(spark, sf)
    firms = companies(words)
    out = mapping.expand_relationships(mapped(spark, sf, words), "doc_id", relationships(firms), firms)
    return out.select("doc_id", "ticker", "confidence", "evidence")


@query(
    "jn11_target_tickers",
    f"""WITH {DICTIONARY}, wl AS (SELECT ticker, company FROM co WHERE seq >= 4), dd AS (SELECT doc_id, text, CASE WHEN doc_id % 7 = 0 THEN c.ticker END AS own FROM documents LEFT JOIN co c ON c.seq = doc_id % 12),
    a AS (SELECT doc_id, own AS ticker, 'own' AS rule FROM dd WHERE own IN (SELECT ticker FROM wl)),
    b AS (SELECT doc_id, ticker, 'named' AS rule FROM dd JOIN wl ON contains(text, company) WHERE doc_id NOT IN (SELECT doc_id FROM a)),
    c AS (SELECT doc_id, ticker, 'watchlist' AS rule FROM dd, wl WHERE doc_id NOT IN (SELECT doc_id FROM a) AND doc_id NOT IN (SELECT doc_id FROM b))
    SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""",
)
def target_tickers(spark, sf):
    firms = companies(frequent_words(spark, sf))
    docs = t.table(spark, sf, "documents").select("doc_id", "text", (F.col("doc_id") % 12).alias("seq"))
    docs = docs.join(F.broadcast(firms.select("seq", "ticker")), "seq", "left")  # twelve rows
    docs = docs.select("doc_id", "text", F.when(F.col("doc_id") % 7 == 0, F.col("ticker")).alias("own"))
    watched = firms.where(F.col("seq") >= 4)
    return mapping.target_tickers(docs, "doc_id", "own", "text", watched.select("ticker"), watched)


KEYWORDS = """
kw AS (SELECT * FROM (SELECT 'R' || n_regionkey AS sector, n_name AS keyword, (n_nationkey % 4) / 4.0 AS weight, CASE WHEN n_nationkey % 6 = 0 THEN 'xx' ELSE 'en' END AS locale, n_nationkey AS seq FROM nation
  UNION ALL SELECT 'r' || n_regionkey, lower(n_name) || ' ', 0.6, 'en', n_nationkey + 100 FROM nation) WHERE locale IN ('en', 'ko')
  QUALIFY row_number() OVER (PARTITION BY lower(sector), lower(trim(keyword)) ORDER BY weight DESC, seq) = 1)"""


def sector_keywords(spark, sf):
    n = t.table(spark, sf, "nation")
    one = n.select(
        F.concat(F.lit("R"), F.col("n_regionkey")).alias("sector"), F.col("n_name").alias("keyword"), (F.col("n_nationkey") % 4 / 4.0).alias("weight"),
        F.when(F.col("n_nationkey") % 6 == 0, "xx").otherwise("en").alias("locale"), F.col("n_nationkey").alias("seq"),
    )
    two = n.select(
        F.concat(F.lit("r"), F.col("n_regionkey")).alias("sector"), F.concat(F.lower("n_name"), F.lit(" ")).alias("keyword"), F.lit(0.6).alias("weight"),
        F.lit("en").alias("locale"), (F.col("n_nationkey") + 100).alias("seq"),
    )
    return queries.sector_keyword_index(one.unionByName(two), "seq")


@query("sc10_sector_keywords", f"""WITH {KEYWORDS} SELECT sector, trim(keyword) AS keyword, {r("weight")}, locale FROM kw""")
def sector_keyword_index(spark, sf):
    return sector_keywords(spark, sf).select("sector", "keyword", "weight", "locale")


@query(
    "tk08_search_queries",
    f"""WITH {KEYWORDS}, firm AS (SELECT s_suppkey, s_name, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    top AS (SELECT *, row_number() OVER (PARTITION BY lower(sector) ORDER BY weight DESC, trim(keyword) DESC) AS k FROM kw QUALIFY k <= 3),
    q AS (SELECT s_suppkey, s_name AS q, 0 AS step, 0.0 AS a, '' AS tie FROM firm UNION ALL SELECT s_suppkey, 'alias ' || s_suppkey % 5, 1, 1, '' FROM firm UNION ALL SELECT s_suppkey, upper(s_name), 1, 2, '' FROM firm
      UNION ALL SELECT s_suppkey, trim(keyword), 2, -weight, trim(keyword) FROM firm JOIN top ON lower(sector) = 'r' || n_regionkey),
    p AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY step, a, tie DESC, q) AS pos FROM q), u AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY s_suppkey, lower(q) ORDER BY pos) = 1)
    SELECT CAST(s_suppkey AS VARCHAR) AS ticker, q AS query, row_number() OVER (PARTITION BY s_suppkey ORDER BY pos) AS pos FROM u""",
)
def search_queries(spark, sf):
    s = t.table(spark, sf, "supplier").join(F.broadcast(t.table(spark, sf, "nation").select("n_nationkey", "n_regionkey")), F.col("s_nationkey") == F.col("n_nationkey"))
    firms = s.select(F.col("s_suppkey").cast("string").alias("ticker"), F.col("s_name").alias("company"), F.concat(F.lit("R"), F.col("n_regionkey")).alias("sector"))
    nick = firms.select("ticker", F.concat(F.lit("alias "), F.col("ticker").cast("int") % 5).alias("alias"), F.lit(1).alias("seq")).unionByName(
        firms.select("ticker", F.upper("company").alias("alias"), F.lit(2).alias("seq"))
    )
    return queries.company_queries(firms, nick, sector_keywords(spark, sf), "en", max_keywords=3)


@query("jn15_similar_names")
def similar_names(spark, sf):
    """Supplier names asked with a changed digit, a space or a cut; checked by brute force in the tests."""
    s = t.table(spark, sf, "supplier")
    names = s.select(
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("Symbol"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("Ticker"),
        F.concat(F.col("s_name"), F.lit(" "), F.col("s_nationkey")).alias("Name"), F.lit("KOSPI").alias("Market"),
    )
    asked = s.where(F.col("s_acctbal") > 9000).select(F.expr("substr(s_name, 1, length(s_name) - 1)").alias("q"))
    return mapping.similar_names(asked, "q", names)
