"""The composed jobs on small inputs."""

import json
from dataclasses import replace

from pyspark.sql import functions as F

from tests.test_operators import bars_frame
from tickloom import workflows
from tickloom.operators import impact
from tickloom.params import FoldParams, Params, PortfolioParams


def test_evaluate_and_predict_latest(spark):
    bars = bars_frame(spark, 320)
    params = replace(
        Params(), folds=FoldParams(min_train=150, test=60, step=60, min_folds=1),
        portfolio=PortfolioParams(top_k=1, min_value_traded=0.0, min_investor_coverage=0.0, turnover_limit=1.0),
    )
    day = bars.agg({"Date": "max"}).first()[0]
    flows = spark.createDataFrame([(day, "AAA", 5.0, 1.0)], "Date date, Symbol string, foreign_net_buy double, institution_net_buy double")
    filed = spark.createDataFrame([(day, "BBB", "new contract")], "Date date, Symbol string, title string")
    series = bars.where("Symbol = 'AAA'").selectExpr("Date", "'VIXY' AS series", "High AS close")
    run = workflows.evaluate(bars, params, series, ["^VIX", "^SOX"], group_rows=10_000, trees=1, flows=flows, disclosures=filed)
    assert run.coverage == {"external": 0.5, "investor": 0.5} and run.gate == "caution"
    assert {"disclosure_score", "vix_close"} <= set(run.matrix.columns) and "sox_close" not in run.matrix.columns
    assert run.folds.count() >= 1 and not any(c.startswith(("news_", "disclosure_")) for c in run.features)
    row = run.summary.first()
    assert row.days > 0 and row.max_drawdown <= 0
    assert run.oof.groupBy("Date", "Symbol").count().where("count > 1").isEmpty()
    names = spark.createDataFrame([("000AAA", "AAA", "First", "KOSPI")], "Ticker string, Symbol string, Name string, Market string")
    out = {r.Symbol: r for r in workflows.predict_latest(run, names, params, trees=1).collect()}
    assert out["AAA"].symbol_name == "First" and out["BBB"].symbol_name == "BBB"
    assert all(r.recommendation in ("매수", "매도", "관망") for r in out.values())


def test_impact_falls_back_to_the_rules(spark):
    predictions = spark.createDataFrame([("2024-01-05", "000001.KS"), ("2024-01-05", "000002.KQ")], "Date string, Symbol string").withColumn("Date", F.to_date("Date"))
    landed = spark.createDataFrame([("2024-01-05", "000001", 7.0, 2)], "date string, ticker string, news_disclosure_score double, event_count long").withColumn("final_score", F.col("news_disclosure_score"))
    news = spark.createDataFrame(
        [("2024-01-05", "000002.KQ", "news", "contract award growth", "", "http://a/1", 1), ("2024-01-06", "000001.KS", "news", "lawsuit loss", "", "http://a/2", 2)],
        "Date string, Symbol string, source_type string, title string, body string, url string, seq long",
    ).withColumn("Date", F.to_date("Date"))
    out, mode = impact.impact_with_fallback(predictions, landed, news, "seq")
    assert mode["actual_mode"] == "landed" and not mode["fallback_used"]
    assert {r.Symbol: r.news_impact_event_count for r in out.collect()} == {"000001.KS": 2, "000002.KQ": None}
    for rows, why in ((landed.withColumn("date", F.lit("2023-01-05")), "no_landed_row_matches"), (landed.where("false"), "landed_report_empty"), (None, None)):
        out, mode = impact.impact_with_fallback(predictions, rows, news, "seq")
        assert (mode["actual_mode"], mode["fallback_reason"], mode["fallback_used"]) == ("rule_based", why, rows is not None)
        assert {r.Symbol: r.news_impact_event_count for r in out.collect()} == {"000001.KS": None, "000002.KQ": 1}


def test_impact_report_from_landed_judgements(spark):
    news = spark.createDataFrame(
        [(1, "Alpha wins", "", "", "http://a/1", None, "000001"), (2, "alpha  WINS!", "", "", "http://a/2", None, "000001"), (3, "Other Beta", "", "", "http://a/3", None, None)],
        "seq int, title string, summary string, raw_text string, url string, original_url string, ticker string",
    )
    companies = spark.createDataFrame([("000001", "Alpha", "KOSPI", "x"), ("000002", "Beta", "KOSDAQ", "y")], "ticker string, company string, market string, sector string")
    targets = workflows.judgement_targets(news, companies.select("ticker"), companies, "seq")
    assert {(r.seq, r.ticker, r.rule) for r in targets.collect()} == {(1, "000001", "own"), (3, "000002", "named")}
    verdict = {"event_type": "contract", "direction": "positive", "impact_score": 40.0, "impact_strength": 0.4, "confidence": 0.5, "time_horizon": "next_day",
               "reason": "r", "why_may_be_wrong": "w", "risk_flags": ["f"]}
    judged = spark.createDataFrame([(1, "000001", json.dumps(verdict)), (3, "000002", "{}")], "seq int, ticker string, payload string")
    rows = workflows.impact_report(targets, judged, companies, "2024-01-31", "run", "seq").collect()
    assert len(rows) == 1 and rows[0].ticker == "000001" and rows[0].news_disclosure_score == 40.0
    assert rows[0].llm_failed_count == 1 and "llm_judgment_failed" in rows[0].risk_flags and rows[0].top_evidence_url == "http://a/1"
