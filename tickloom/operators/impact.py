"""Impact events: scoring, clustering, per-ticker reports and context on predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import factors
from tickloom.functions.numeric import clip, number, points_text
from tickloom.functions.text import contains_any, flags, market, stable_id, ticker, title_cluster_key
from tickloom.operators.ranking import ordinal_rank, top_per_group
from tickloom.operators.skew import first_per_key
from tickloom.session import cut_lineage

# Columns of a written report, joined report columns, rule phrases, words of a text, event and sector
# words, display texts, and the types and keys of a judgement.
REPORT_COLUMNS = [
    "date", "run_id", "ticker", "company", "market", "sector", "news_disclosure_score", "global_proxy_adjustment",
    "sector_neutral_score", "positive_score", "negative_score", "uncertainty_score", "confidence", "event_count",
    "llm_failed_count", "top_event_type", "top_reason", "why_may_be_wrong", "risk_flags", "already_reflected_price_move",
    "price_change_since_news", "volume_change", "tradeability_status", "review_checklist", "top_evidence_url",
]
JOINED_REPORT = {
    "run_id": "news_impact_run_id",
    "final_score": "news_impact_final_score",
    "news_disclosure_score": "news_impact_final_score",
    "sector_neutral_score": "news_impact_sector_neutral_score",
    "positive_score": "news_impact_positive_score",
    "negative_score": "news_impact_negative_score",
    "uncertainty_score": "news_impact_uncertainty_score",
    "confidence": "news_impact_confidence",
    "event_count": "news_impact_event_count",
    "top_event_type": "news_impact_top_event_type",
    "top_reason": "news_impact_top_reason",
    "why_may_be_wrong": "news_impact_why_may_be_wrong",
    "risk_flags": "news_impact_risk_flags",
    "tradeability_status": "news_impact_tradeability_status",
    "review_checklist": "news_impact_review_checklist",
    "top_evidence_url": "news_impact_top_evidence_url",
}
GOOD_WORDS = ("수주", "계약", "공급계약", "증가", "개선", "호조", "상향", "흑자", "자사주", "배당", "승인", "hbm", "수요")
BAD_WORDS = ("소송", "제재", "적자", "감소", "악화", "하락", "급락", "유상증자", "전환사채", "불성실", "횡령", "배임")
EVENT_WORDS = (
    (("실적", "영업이익", "매출", "순이익"), "earnings"),
    (("계약", "수주", "공급계약"), "contract"),
    (("유상증자", "전환사채", "cb", "bw"), "capital_raise"),
    (("소송", "제재", "횡령", "배임"), "legal"),
    (("정책", "규제", "정부"), "policy"),
)
SECTOR_WORDS = ("반도체", "hbm", "수출", "업황")
SECTOR_OF_FACTOR = (("SEMI", "semiconductor"), ("EXPORT", "export"), ("GOVERNANCE", "governance"))
WRONG_BECAUSE = "원문 제목·요약 기반 휴리스틱 점수라 실제 재무 영향과 다를 수 있습니다."
DISPLAY_NOTE = "참고용·예측값 미반영"
REVIEW_ONLY, REVIEW_CHECKLIST = "review_only", "원문 확인;예측값 미반영 확인"
JUDGEMENT_TYPES = ("earnings", "contract", "capital_raise", "legal", "policy", "macro", "product", "partnership")
JUDGEMENT_KEYS = (
    "event_type", "direction", "impact_score", "impact_strength", "confidence", "time_horizon", "reason",
    "why_may_be_wrong", "risk_flags",
)


def cluster_scores(events: DataFrame, by: list[str], cluster="cluster_id", score="impact_score") -> DataFrame:
    """Per cluster and sign: the strongest score plus a fifth of the rest."""
    s = F.bround(F.col(score), 6)
    pos, neg = F.when(s > 0, s), F.when(s < 0, s)
    grouped = events.groupBy(*by, cluster).agg(
        F.max(pos).alias("_p"), F.sum(pos).alias("_ps"), F.min(neg).alias("_n"), F.sum(neg).alias("_ns"),
        F.count(F.lit(1)).alias("_events"),
    )
    rest = lambda total, top: F.bround(F.col(top) + 0.2 * (F.col(total) - F.col(top)), 6)
    return grouped.select(
        *by, cluster, rest("_ps", "_p").alias("positive"), rest("_ns", "_n").alias("negative"), "_events"
    )


def aggregate_scores(events: DataFrame, by: list[str], failed: Column | int = 0) -> DataFrame:
    """Clamped positive, negative and net score, and uncertainty, per group."""
    failed_count = F.lit(failed) if isinstance(failed, int) else failed
    sums = cluster_scores(events, by).groupBy(*by).agg(
        F.coalesce(F.sum("positive"), F.lit(0.0)).alias("_p"),
        F.coalesce(F.sum("negative"), F.lit(0.0)).alias("_n"),
        F.sum("_events").alias("event_count"),
    )
    out = sums.withColumns(
        {"positive_score": F.bround(clip("_p", 0, 100), 6), "negative_score": F.bround(clip("_n", -100, 0), 6)}
    )
    conflict = F.when((F.col("positive_score") > 0) & (F.col("negative_score") < 0), 1).otherwise(0)
    net = F.col("positive_score") + F.col("negative_score")
    return out.withColumns(
        {
            "news_disclosure_score": F.bround(clip(net, -100, 100), 6),
            "uncertainty_score": F.least(F.lit(100.0), conflict * 15.0 + failed_count * 10.0),
            "llm_failed_count": failed_count,
        }
    ).drop("_p", "_n")


def sector_neutral(score: Column, market_effect: Column, beta: float = 1.0) -> Column:
    return F.bround(clip(score - beta * market_effect, -100.0, 100.0), 6)


def report_rows(events: DataFrame, companies: DataFrame, run_date: str, run_id: str, failed: int = 0, fixed_flags=()) -> DataFrame:
    """One report row per ticker. Flags are exploded and collected as a set, so a group
    never holds more than the vocabulary of flags."""
    scores = aggregate_scores(events, ["ticker"], failed)
    strength = F.struct(F.col("impact_strength") * F.col("confidence"), F.col("event_id"))
    top = events.groupBy("ticker").agg(
        F.max_by(
            F.struct("event_type", "reason", "why_may_be_wrong", "already_reflected_price_move", "evidence_urls", "company", "sector"),
            strength,
        ).alias("t"),
        F.max("confidence").alias("confidence"),
    )
    always = [*fixed_flags, *(["llm_judgment_failed"] if failed else [])]
    seen = events.select("ticker", F.explode_outer("risk_flags").alias("flag")).groupBy("ticker").agg(
        F.collect_set("flag").alias("_flags")
    )
    stated = F.array(*[F.lit(f) for f in always]).cast("array<string>")
    known = companies.select("ticker", F.col("company").alias("_company"), F.col("market").alias("_market"), F.col("sector").alias("_sector"))
    rows = scores.join(top, "ticker").join(seen, "ticker").join(known, "ticker", "left")
    urls = F.col("t.evidence_urls")
    return rows.select(
        F.lit(run_date).alias("date"), F.lit(run_id).alias("run_id"), "ticker",
        F.coalesce("_company", "t.company").alias("company"), F.coalesce("_market", F.lit("")).alias("market"),
        F.coalesce("_sector", "t.sector").alias("sector"), "news_disclosure_score",
        F.lit(0.0).alias("global_proxy_adjustment"), F.col("news_disclosure_score").alias("sector_neutral_score"),
        "positive_score", "negative_score", "uncertainty_score", "confidence", "event_count", "llm_failed_count",
        F.col("t.event_type").alias("top_event_type"), F.col("t.reason").alias("top_reason"),
        F.col("t.why_may_be_wrong").alias("why_may_be_wrong"),
        F.sort_array(F.array_distinct(F.concat("_flags", stated))).alias("risk_flags"),
        F.col("t.already_reflected_price_move").alias("already_reflected_price_move"),
        F.lit(0.0).alias("price_change_since_news"), F.lit(0.0).alias("volume_change"),
        F.lit("unknown").alias("tradeability_status"),
        F.array(F.lit("not_investment_advice"), F.lit("verify_evidence"), F.lit("check_tradeability")).alias("review_checklist"),
        F.when(F.size(urls) > 0, F.get(urls, F.lit(0))).otherwise("").alias("top_evidence_url"),
    )


def rank_report(rows: DataFrame, include_untradable: bool = True) -> DataFrame:
    kept = rows if include_untradable else rows.where(~F.col("tradeability_status").isin("halted", "limit_locked"))
    order = [F.col("news_disclosure_score").desc(), F.col("confidence").desc(), F.col("uncertainty_score").asc(), F.col("ticker").desc()]
    return ordinal_rank(kept, [], order, "rank").orderBy("rank")


def heuristic_score(low: Column, source_type: Column, way: Column) -> Column:
    """Display-only score of a text from its direction and words."""
    good, bad = contains_any(low, GOOD_WORDS), contains_any(low, BAD_WORDS)
    disclosed = source_type == "disclosure"
    base = (
        F.when(way == "positive", 30.0)
        .when(way == "negative", -30.0)
        .when(good & ~bad, 25.0)
        .when(bad & ~good, -25.0)
        .when(good & bad, 0.0)
        .when(disclosed, 10.0)
        .otherwise(5.0)
    )
    return F.bround(clip(F.when(disclosed, base * 1.25).otherwise(base), -100.0, 100.0), 6)


def event_type(low: Column, source_type: Column) -> Column:
    words, label = EVENT_WORDS[0]
    chain = F.when(contains_any(low, words), label)
    for words, label in EVENT_WORDS[1:]:
        chain = chain.when(contains_any(low, words), label)
    sector = (source_type != "disclosure") & contains_any(low, SECTOR_WORDS)
    return chain.when(sector, "sector").otherwise("other")


def rule_events(context: DataFrame, order: str) -> DataFrame:
    """Raw context rows (Date, Symbol, source_type, title, body, url) as impact events."""
    title, body = F.trim(F.coalesce("title", F.lit(""))), F.trim(F.coalesce("body", F.lit("")))
    text = F.trim(F.concat_ws(" ", title, body))
    kind = F.lower(F.trim(F.coalesce("source_type", F.lit(""))))
    base = context.withColumns(
        {"_order": F.col(order), "_title": title, "_body": body, "_text": text, "_kind": kind, "_ticker": ticker("Symbol"), "_url": F.trim(F.coalesce("url", F.lit("")))}
    ).where((F.col("_text") != "") & F.col("_ticker").isNotNull())
    out = factors.analyze(base, "_text")
    low = F.lower("_text")
    sector = F.lit("")
    for code, name in reversed(SECTOR_OF_FACTOR):
        sector = F.when(F.array_contains("factors", code), name).otherwise(sector)
    known = F.when(F.col("confidence") == "medium", 0.65).otherwise(0.45)
    out = out.withColumns(
        {
            "impact_score": heuristic_score(low, F.col("_kind"), F.col("direction")),
            "event_type": event_type(low, F.col("_kind")),
            "sector": sector,
            "confidence": F.bround(F.when(F.col("_kind") == "disclosure", known + 0.1).otherwise(known), 6),
            "event_id": stable_id(F.lit("event"), "_ticker", "_kind", "_title", "_url"),
            "cluster_id": stable_id(F.lit("cluster"), "_ticker", "_kind", "_title"),
            "reason": F.when(F.col("_title") != "", F.concat(F.col("_title"), F.lit(" ("), F.col("summary"), F.lit(")"))).otherwise(F.col("summary")),
            "risk_flags": flags(
                F.lit("heuristic_display_only"),
                F.when((F.col("_kind") == "news") & (F.col("_body") == ""), "news_title_only"),
                F.when(F.col("freshness_required"), "freshness_review_required"),
            ),
        }
    )
    strength = F.bround(F.least(F.abs("impact_score") / 100.0, F.lit(1.0)), 6)
    way = F.when(F.col("impact_score") > 0, "positive").when(F.col("impact_score") < 0, "negative").otherwise("neutral")
    return out.select(
        "Date", "Symbol", "_order", F.col("_ticker").alias("ticker"), "event_id", "cluster_id", "sector",
        "event_type", way.alias("impact_direction"), strength.alias("impact_strength"), "impact_score", "confidence",
        "reason", F.lit(WRONG_BECAUSE).alias("why_may_be_wrong"), "risk_flags", F.col("_url").alias("evidence_url"),
    )


def rule_summary(events: DataFrame) -> DataFrame:
    """One generated report row per (Date, Symbol) from rule events.

    The events feed three aggregations, so their text analysis is written once.
    """
    key = ["Date", "Symbol"]
    events = cut_lineage(events)
    scores = aggregate_scores(events, key)
    top = events.groupBy(*key).agg(
        F.max_by(F.struct("event_type", "reason", "why_may_be_wrong", "sector"), F.struct(F.abs("impact_score"), -F.col("_order"))).alias("t"),
        F.avg("confidence").alias("_confidence"),
        F.min_by("evidence_url", F.when(F.col("evidence_url") != "", F.col("_order"))).alias("_url"),
        F.first("ticker").alias("ticker"),
    )
    # Earliest position of each flag, then the flags in that order: bounded by the vocabulary.
    placed = events.select(*key, "_order", F.posexplode("risk_flags").alias("_i", "flag"))
    placed = placed.groupBy(*key, "flag").agg(F.min(F.struct("_order", "_i")).alias("_at"))
    joined = placed.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_at", "flag"))).alias("_f"))
    rows = scores.join(top, key).join(joined, key)
    return rows.select(
        "Date", "Symbol",
        F.concat(F.lit("generated-"), stable_id(F.col("Date"), "Symbol", "event_count")).alias("run_id"),
        "ticker", market("Symbol").alias("market"), F.col("t.sector").alias("sector"),
        F.col("news_disclosure_score").alias("final_score"), "news_disclosure_score",
        F.col("news_disclosure_score").alias("sector_neutral_score"), "positive_score", "negative_score", "uncertainty_score",
        F.bround("_confidence", 3).alias("confidence"), "event_count", F.col("t.event_type").alias("top_event_type"),
        F.col("t.reason").alias("top_reason"), F.col("t.why_may_be_wrong").alias("why_may_be_wrong"),
        F.array_join(F.transform("_f", lambda f: f["flag"]), ";").alias("risk_flags"),
        F.lit(REVIEW_ONLY).alias("tradeability_status"), F.lit(REVIEW_CHECKLIST).alias("review_checklist"),
        F.coalesce("_url", F.lit("")).alias("top_evidence_url"),
    )


def restrict_to_predictions(events: DataFrame, predictions: DataFrame) -> DataFrame:
    """Events of the (Date, Symbol) pairs that were predicted."""
    return events.join(predictions.select("Date", "Symbol").distinct(), ["Date", "Symbol"], "left_semi")


def append_impact(predictions: DataFrame, rows: DataFrame, order: str | None = None) -> DataFrame:
    """Last report row per (Date, ticker) on the predictions under display-only names."""
    renamed = {target: F.col(source) for source, target in JOINED_REPORT.items() if source in rows.columns}
    wanted = rows.select(
        F.to_date("date").alias("Date"),
        ticker(F.col("ticker")).alias("_ticker"),
        F.col(order).alias("_o") if order else F.lit(0).alias("_o"),
        *[c.alias(name) for name, c in renamed.items()],
    ).where(F.col("Date").isNotNull() & F.col("_ticker").isNotNull())
    last = first_per_key(wanted, ["Date", "_ticker"], [F.col("_o")], last=True).drop("_o")
    # Joining on the ticker instead of a guessed market suffix reaches both boards.
    out = predictions.withColumn("_ticker", ticker("Symbol")).join(last, ["Date", "_ticker"], "left").drop("_ticker")
    return display_columns(out)


def display_columns(df: DataFrame) -> DataFrame:
    if "news_impact_final_score" not in df.columns:
        return df
    score = number("news_impact_final_score")
    reason = F.trim(F.coalesce("news_impact_top_reason", F.lit(""))) if "news_impact_top_reason" in df.columns else F.lit("")
    return df.withColumns(
        {
            "뉴스/공시 영향 점수": points_text(score),
            "뉴스/공시 영향 요약": F.when(reason == "", "-").otherwise(reason),
            "뉴스/공시 영향 참고": F.when(score.isNull(), "-").otherwise(DISPLAY_NOTE),
        }
    )


def impact_with_fallback(predictions: DataFrame, landed: DataFrame | None, context: DataFrame, order: str) -> tuple[DataFrame, dict]:
    """Landed report rows when any match a prediction's date and ticker, else the rule-based rows and the reason."""
    if landed is None:
        requested, reason = "rule", None
    else:
        wanted = predictions.select(F.col("Date").alias("_d"), ticker("Symbol").alias("_t")).distinct()
        hit = (F.to_date("date") == F.col("_d")) & (ticker(F.col("ticker")) == F.col("_t"))
        if not landed.join(wanted, hit, "left_semi").isEmpty():
            return append_impact(predictions, landed), {"requested_mode": "landed", "actual_mode": "landed", "fallback_used": False, "fallback_reason": None}
        requested, reason = "landed", "landed_report_empty" if landed.isEmpty() else "no_landed_row_matches"
    rows = rule_summary(rule_events(restrict_to_predictions(context, predictions), order))
    return append_impact(predictions, rows, "Symbol"), {
        "requested_mode": requested, "actual_mode": "rule_based", "fallback_used": landed is not None, "fallback_reason": reason,
    }


def judged_events(judgements: DataFrame) -> DataFrame:
    """Landed judgement JSON (column ``payload``) with doc, ticker and candidate confidence as
    impact events; rows without the required keys are marked in ``reject_reason``."""
    schema = (
        "event_type string, direction string, impact_score double, impact_strength double, confidence double, "
        "time_horizon string, reason string, why_may_be_wrong string, risk_flags array<string>"
    )
    keys = F.json_object_keys("payload")
    wanted = F.array(*[F.lit(k) for k in JUDGEMENT_KEYS])
    absent = F.array_except(wanted, F.coalesce(keys, F.array().cast("array<string>")))
    out = judgements.withColumns({"_j": F.from_json("payload", schema), "_absent": absent})
    named = F.col("_j.event_type")
    kind = (
        F.when(named.isin(*JUDGEMENT_TYPES), named).when(named.isin("sector", "supply_chain"), "sector").otherwise("other")
    )
    out = out.withColumn(
        "reject_reason", F.when(F.size("_absent") > 0, F.concat(F.lit("missing:"), F.array_join("_absent", ",")))
    )
    return out.withColumns(
        {
            "event_type": kind,
            "impact_direction": F.col("_j.direction"),
            "impact_score": F.col("_j.impact_score"),
            "impact_strength": F.col("_j.impact_strength"),
            "time_horizon": F.col("_j.time_horizon"),
            "confidence": F.bround(F.col("_j.confidence") * F.col("candidate_confidence"), 6),
            "reason": F.col("_j.reason"),
            "why_may_be_wrong": F.col("_j.why_may_be_wrong"),
            "risk_flags": F.array_distinct(F.coalesce(F.concat("_j.risk_flags", "candidate_flags"), F.col("candidate_flags"))),
        }
    ).drop("_j", "_absent", "payload")


# Required fields of a semantic key, markers of an empty field.
SEMANTIC_FIELDS = ("event_subject", "event_type", "counterparty", "product_or_asset", "event_action", "event_date")
EMPTY_FIELDS = ("", "unknown", "none", "n/a")


def semantic_clusters(events: DataFrame, key: str = "semantic_key") -> DataFrame:
    """Cluster ids from landed semantic keys (JSON). A key that is missing, unsure or too
    empty keeps the old id and adds flags."""

    def field(name: str) -> Column:
        text = F.lower(F.trim(F.coalesce(F.get_json_object(key, f"$.{name}"), F.lit(""))))
        clean = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)[^\p{L}\p{N}_\s-]", " "), r"(?U)\s+", " "))
        return F.when(clean == "", "unknown").otherwise(clean)

    product = field("product_or_asset")
    base_product = F.trim(F.regexp_replace(product, r"\d+[a-z]*$", ""))
    parts = {n: field(n) for n in SEMANTIC_FIELDS}
    parts["product_or_asset"] = F.when(base_product == "", product).otherwise(base_product)
    meaningful = sum(
        (F.when(parts[n].isin(*EMPTY_FIELDS), 0).otherwise(1) for n in ("counterparty", "product_or_asset", "event_action", "event_date")),
        F.lit(0),
    )
    keys = F.coalesce(F.json_object_keys(key), F.array().cast("array<string>"))
    absent = F.array_except(F.array(*[F.lit(n) for n in (*SEMANTIC_FIELDS, "cluster_confidence")]), keys)
    raw_confidence = F.get_json_object(key, "$.cluster_confidence")
    confidence = F.when(~raw_confidence.isin("true", "false"), raw_confidence.try_cast("double"))
    reason = (
        F.when(F.col(key).isNull(), "llm_error")
        .when(F.size(absent) > 0, "missing_required_keys")
        .when(confidence.isNull(), "invalid_confidence")
        .when(confidence < 0.5, "low_confidence")
        .when(meaningful < 2, "insufficient_key_fields")
    )
    digest = F.substring(F.sha1(F.concat_ws(":", F.col("ticker"), *[parts[n] for n in SEMANTIC_FIELDS])), 1, 12)
    failed = F.array(F.lit("semantic_cluster_failed"), F.concat(F.lit("semantic_cluster_failed:"), F.col("_reason")))
    out = events.withColumns({"_reason": reason, "_digest": digest})
    bad = F.col("_reason").isNotNull()
    return out.withColumns(
        {
            "cluster_id": F.when(bad, F.col("cluster_id")).otherwise(F.concat(F.lit("cluster-semantic-"), F.col("_digest"))),
            "risk_flags": F.when(bad, F.array_union("risk_flags", failed)).otherwise(F.col("risk_flags")),
        }
    ).drop("_reason", "_digest")


def failure_causes(events: DataFrame, prefix: str = "semantic_cluster_failed:") -> DataFrame:
    """Counts per failure cause read from prefixed flags."""
    flag_rows = events.select(F.explode("risk_flags").alias("flag")).where(F.col("flag").startswith(prefix))
    return flag_rows.groupBy(F.expr(f"substring(flag, {len(prefix) + 1})").alias("cause")).agg(F.count(F.lit(1)).alias("count"))


def failure_summary(events: DataFrame, flag: str = "semantic_cluster_failed", degraded_at: float = 0.2) -> DataFrame:
    failed = F.sum(F.when(F.array_contains("risk_flags", flag), 1).otherwise(0))
    rate = F.bround(F.coalesce(F.try_divide(failed.cast("double"), F.count(F.lit(1)).cast("double")), F.lit(0.0)), 6)
    out = events.agg(F.count(F.lit(1)).alias("events"), F.coalesce(failed, F.lit(0)).alias("failed_count"), rate.alias("failure_rate"))
    audit = flags(
        F.when(F.col("events") == 0, "missing_impact_events"),
        F.when(F.col("failed_count") > 0, "semantic_cluster_failed"),
        F.when((F.col("failed_count") > 0) & (F.col("failure_rate") >= degraded_at), "semantic_clustering_degraded"),
    )
    return out.withColumn("audit_flags", audit)


def title_clusters(news: DataFrame, by: list[str], order: str, top: int = 12, keep: int = 3) -> DataFrame:
    """News grouped by normalised title: count, first title, up to three distinct titles
    and novelty; the largest clusters of each group."""
    rows = news.withColumns({"title": F.trim("title"), "cluster_key": title_cluster_key("title")}).where(F.trim("title") != "")
    firsts = rows.groupBy(*by, "cluster_key", "title").agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    sizes = firsts.groupBy(*by, "cluster_key").agg(
        F.sum("_n").alias("article_count"), F.min_by("title", "_first").alias("representative_title"), F.min("_first").alias("_at")
    )
    best = top_per_group(sizes, by, [F.col("article_count").desc(), F.col("cluster_key")], top)
    titles = top_per_group(firsts, [*by, "cluster_key"], [F.col("_first")], keep, "_k")
    listed = titles.groupBy(*by, "cluster_key").agg(F.sort_array(F.collect_list(F.struct("_k", "title"))).alias("_t"))
    out = best.join(listed, [*by, "cluster_key"])
    return out.select(
        *by, "cluster_key", "article_count", "representative_title",
        F.transform("_t", lambda x: x["title"]).alias("representative_titles"),
        F.bround(1.0 / F.greatest("article_count", F.lit(1)), 3).alias("novelty_score"), "pos",
    )


def event_digest(context: DataFrame, order: str, keep: int = 4) -> DataFrame:
    """First titles per symbol and source, with the texts of a rule-based digest."""
    rows = context.where(F.col("title").isNotNull() & F.col("source_type").isin("news", "disclosure"))
    top = top_per_group(rows.select("Symbol", "source_type", "title", order), ["Symbol", "source_type"], [F.col(order)], keep)

    def titles(kind: str) -> Column:
        listed = F.sort_array(F.collect_list(F.when(F.col("source_type") == kind, F.struct("pos", "title"))))
        return F.transform(listed, lambda x: x["title"])

    out = top.groupBy("Symbol").agg(titles("disclosure").alias("_d"), titles("news").alias("_n"))

    def block(name: str, head: str, empty: str) -> Column:
        lines = F.array_join(F.transform(name, lambda x: F.concat(F.lit("- "), x)), "\n")
        return F.concat(F.lit(head + "\n"), F.when(F.size(name) > 0, lines).otherwise(empty))

    d, n = F.size("_d"), F.size("_n")
    # Digest phrases.
    return out.select(
        "Symbol",
        F.concat(F.col("Symbol"), F.lit(" 기준 당일 공시 "), d, F.lit("건, 뉴스 "), n, F.lit("건을 정리했습니다.")).alias("one_line_summary"),
        block("_d", "[공시 요약]", "- 확인된 핵심 공시 내용 없음").alias("disclosure_summary"),
        block("_n", "[뉴스 요약]", "- 확인된 핵심 뉴스 내용 없음").alias("news_summary"),
        (d + n).alias("source_count"),
        F.array_compact(F.array(F.when(d > 0, "disclosure"), F.when(n > 0, "news"))).alias("key_sources"),
    )


def tone(disclosure: Column, impact: Column, articles: Column) -> Column:
    """Overall tone from disclosure strength and news impact."""
    blend = disclosure * 0.55 + (impact + 1.0) / 2.0 * 0.45
    # Tone labels.
    return (
        F.when((articles <= 0) & (disclosure <= 0), "중립").when(blend >= 0.66, "호재").when(blend <= 0.4, "악재").otherwise("중립")
    )


def issue_texts(df: DataFrame) -> DataFrame:
    """Tone and the tiered sentences of a score-based issue summary."""
    v = {c: F.coalesce(number(c), F.lit(0.0)) for c in ("disclosure_score", "news_impact_score", "news_relevance_score")}
    n = F.coalesce(number("news_article_count"), F.lit(0.0)).cast("int")
    d, impact = v["disclosure_score"], v["news_impact_score"]
    mood = F.when(impact < -0.15, "부정").when(F.abs(impact) <= 0.15, "중립").otherwise("긍정")
    overall = tone(d, impact, n)
    # Issue summary sentences.
    return df.withColumns(
        {
            "종합 판단": overall,
            "공시 요약": F.when(d >= 0.7, "공시 강도가 높은 편으로 단기 투자심리에 의미 있는 변수로 해석됩니다.")
            .when(d >= 0.35, "공시가 존재하지만 강도는 중간 수준으로, 단독 재료로 보기엔 제한적입니다.")
            .otherwise("유의미한 공시 신호가 약해 공시 단독 영향은 제한적으로 보입니다."),
            "뉴스 요약": F.when(n <= 0, "수집된 뉴스가 없어 뉴스 기반 해석 정보가 제한적입니다.").otherwise(
                F.format_string("뉴스 %d건 기준으로 관련도 %.2f, 단기 톤은 %s으로 해석됩니다.", n, v["news_relevance_score"], mood)
            ),
            "오늘 종목 이슈 한줄 요약": F.format_string(
                "오늘 이슈 요약: 공시 강도 %.2f, 뉴스 %d건을 종합하면 단기 해석은 '%s'입니다.", d, n, overall
            ),
        }
    )
