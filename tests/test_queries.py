"""Every registered query runs against its SQL statement on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.check_oracles import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# One query per area by default; TICKLOOM_ALL=1 runs them all.
SAMPLE = [
    "flagship_momentum_top10", "feature_matrix", "ag01_duplicate_bars", "wn08_macd", "wn17b_turnover_rank_sliced", "wn25_percentile_score",
    "pf19_prediction_reason", "jn01_external_series", "ag08_classification_metrics", "pt02_turnover_limit", "pt08_portfolio_summary",
    "st04_greedy_news_dedupe", "jn08_company_mapping", "fn08_factor_analysis", "ag15_rule_summary", "ag18_bucket_summaries",
    "jn12_proxy_returns", "sc06_search_payload", "sk04_merge_bars", "tk10_recommendations", "ss01_stream_dedupe", "ss03_stream_bar_upsert",
]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 200


@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("TICKLOOM_ALL") else SAMPLE)
def test_query_matches_sql(spark, sf, name):
    ok, text = compare(spark, connect(sf), sf, name, QUERIES[name], ORACLES.get(name))
    # The smallest tables may leave a result empty; it must be empty on both sides.
    assert ok or text.endswith("EMPTY"), text
