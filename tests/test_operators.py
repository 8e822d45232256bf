"""Hand-made value tests and brute-force comparisons on small frames."""

import difflib
import html
import html.entities
import math
import random
import re
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import policy, text
from tickloom.functions.selection import display_columns, feature_columns
from tickloom.operators import clean, context, dedupe, groups, impact, indicators, learning, mapping, metrics, phrases, portfolio, quantiles, validation
from tickloom.operators.phrases import phrase_hits
from tickloom.operators.ranking import average_rank, dense_rank, ordinal_rank, percentile_rank
from tickloom.operators.skew import first_per_key, salted_lookup
from tickloom.params import FoldParams, PortfolioParams, TuningParams
from tickloom.sources import pages, readers, sinks
from tickloom.streaming import jobs


def bars_frame(spark, n=700, symbols=("AAA", "BBB"), seed=42):
    rng = np.random.default_rng(seed)
    days = pd.bdate_range("2018-01-01", periods=n)
    parts = []
    for s in symbols:
        close = 100 * np.exp(np.cumsum(rng.normal(0.0005, 0.02, n)))
        parts.append(
            pd.DataFrame(
                {"Date": days.date, "Symbol": s, "Open": close * 0.999, "High": close * 1.01, "Low": close * 0.99, "Close": close,
                 "Volume": rng.integers(100_000, 500_000, n).astype(float)}
            )
        )
    return spark.createDataFrame(pd.concat(parts), "Date date, Symbol string, Open double, High double, Low double, Close double, Volume double")


def test_clean_bars_keeps_highest_volume_then_last(spark):
    rows = [("2024-01-02", "A", 10.0, 11.0, 9.0, 10.0, 5.0, 0), ("2024-01-02", "A", 10.0, 11.0, 9.0, 10.5, 9.0, 1),
            ("2024-01-02", "A", 10.0, 11.0, 9.0, 10.6, 9.0, 2), ("2024-01-03", "A", 10.0, 16.0, 9.0, 15.0, 0.0, 3),
            ("2024-01-03", "B", 10.0, 9.0, 9.0, 10.0, 5.0, 4), ("bad", "A", 10.0, 11.0, 9.0, 10.0, 5.0, 5)]
    df = spark.createDataFrame(rows, "Date string, Symbol string, Open double, High double, Low double, Close double, Volume double, ingest_seq int")
    out = {str(r.Date): r for r in clean.clean_bars(df).collect()}
    assert out["2024-01-02"].Close == 10.6 and len(out) == 2
    assert out["2024-01-03"].is_zero_volume and out["2024-01-03"].is_extreme_return


def test_indicators_match_pandas(spark):
    df = bars_frame(spark, 1200, ("AAA",))
    got = indicators.technical_block(indicators.price_returns(df)).orderBy("Date").toPandas()
    close = got["Close"]
    delta = close.diff()
    up = delta.clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean()
    down = (-delta.clip(upper=0)).ewm(alpha=1 / 14, adjust=False).mean()
    np.testing.assert_allclose(got["rsi_14"], (100 - 100 / (1 + up / down.replace(0, np.nan))).fillna(50), rtol=1e-9)
    macd = close.ewm(span=12, adjust=False).mean() - close.ewm(span=26, adjust=False).mean()
    np.testing.assert_allclose(got["macd"], macd, atol=1e-9)
    np.testing.assert_allclose(got["macd_signal"], macd.ewm(span=9, adjust=False).mean(), atol=1e-9)
    tp = (got["High"] + got["Low"] + close) / 3
    mad = tp.rolling(20).apply(lambda x: np.mean(np.abs(x - np.mean(x))), raw=True)
    np.testing.assert_allclose(got["cci_20"].dropna(), ((tp - tp.rolling(20).mean()) / (0.015 * mad)).dropna(), rtol=1e-7)


def test_regime_matches_expanding_quantile(spark):
    df = bars_frame(spark, 200, ("AAA",))
    df = indicators.rolling_volatility(indicators.moving_averages(indicators.price_returns(df), (20,)), (20,))
    got = indicators.market_regime(df).orderBy("Date").toPandas()
    vol = got["vol_20"].fillna(0)
    high = vol > vol.expanding(min_periods=1).quantile(0.75)
    assert (got["market_regime"].str.endswith("high_vol") == high).all()


@pytest.mark.parametrize("bound", [1000, None])
def test_ranks_in_both_forms_with_a_hot_group(spark, bound):
    rng = random.Random(7)
    rows = [("hot" if i % 3 else f"g{i % 5}", i, float(rng.randint(0, 9)) if i % 11 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, id int, v double")
    pdf = pd.DataFrame(rows, columns=["g", "id", "v"])
    got = ordinal_rank(df, ["g"], [F.col("v").desc_nulls_last(), F.col("id")], "r", bound).toPandas().set_index("id")["r"]
    want = pdf.sort_values(["g", "v", "id"], ascending=[True, False, True], na_position="last").groupby("g").cumcount() + 1
    assert (got.sort_index() == want.sort_index().set_axis(pdf.loc[want.sort_index().index, "id"])).all()
    avg = average_rank(df, ["g"], "v", "r", bound).toPandas().set_index("id")["r"].sort_index()
    np.testing.assert_allclose(avg, pdf.groupby("g")["v"].rank(method="average"))
    dense = dense_rank(df, ["g"], "v", "r", group_rows=bound).toPandas().set_index("id")["r"].sort_index()
    np.testing.assert_allclose(dense.astype(float), pdf.groupby("g")["v"].rank(method="dense", ascending=False))


def test_percentile_rank_cases(spark):
    values = [1.0, 2.0, 2.0, None, 5.0] + [3.0] * 50
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double")
    got = percentile_rank(df, "v", "p").orderBy("id").toPandas()["p"]
    np.testing.assert_allclose(got, pd.Series(values).rank(method="average", pct=True).fillna(0.5))
    one = spark.createDataFrame([(1, 4.0), (2, 4.0), (3, None)], "id int, v double")
    assert {r.p for r in percentile_rank(one, "v", "p").collect()} == {0.5}
    none = spark.createDataFrame([(1, None)], "id int, v double")
    assert percentile_rank(none, "v", "p").first().p == 0.0


def test_salted_lookup_and_first_per_key_keep_every_row(spark, monkeypatch):
    left = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i}") for i in range(300)], "id int, k string")
    right = spark.createDataFrame([("hot", 1.0), ("k1", 2.0)], "k string, x double")
    out = salted_lookup(left, right, ["k"])
    assert out.count() == 300 and out.where("x = 1.0").count() == 100
    monkeypatch.setattr("tickloom.operators.skew.HOT_ROWS", 50)
    sized = right.withColumn("n", F.when(F.col("k") == "hot", 100).otherwise(1))
    spread = salted_lookup(left, sized, ["k"], rows="n")
    assert spread.columns == ["id", "k", "x"] or set(spread.columns) == {"id", "k", "x"}
    assert spread.count() == 300 and spread.where("x = 1.0").count() == 100 and spread.where("x = 2.0").count() == 1
    first = first_per_key(left, ["k"], [F.col("id")]).where("k = 'hot'").first()
    assert first.id == 0


@pytest.mark.parametrize("hot_rows", [5, 1_000_000])
def test_greedy_dedupe_equals_the_sequential_rule(spark, monkeypatch, hot_rows):
    monkeypatch.setattr("tickloom.operators.skew.HOT_ROWS", hot_rows)
    rng = random.Random(3)
    items = [(i, [f"k{rng.randint(0, 25) if rng.random() > 0.3 else 0}" for _ in range(rng.randint(1, 3))]) for i in range(150)]
    seen, want = set(), []
    for i, keys in items:
        if not seen & set(keys):
            seen |= set(keys)
            want.append(i)
    df = spark.createDataFrame(items, "id int, keys array<string>")
    got = dedupe.greedy_any_key(df, F.array_distinct("keys"), "id")
    assert sorted(r.id for r in got.collect()) == want


def test_greedy_dedupe_of_a_long_chain_and_of_large_groups(spark, monkeypatch):
    def sequential(items):
        seen, kept = set(), []
        for i, keys in items:
            if not seen & set(keys):
                seen |= set(keys)
                kept.append(i)
        return kept

    chain = [(i, [f"k{i}", f"k{i + 1}"]) for i in range(10_000)]
    rounds = []
    whole = dedupe._round
    monkeypatch.setattr(dedupe, "_round", lambda state: rounds.append(1) or whole(state))
    got = dedupe.greedy_any_key(spark.createDataFrame(chain, "id int, keys array<string>"), F.col("keys"), "id")
    assert sorted(r.id for r in got.collect()) == sequential(chain) and len(rounds) == 1
    rng = random.Random(11)
    items = [(i, [f"g{i % 3}-{rng.randint(0, 30)}" for _ in range(rng.randint(0, 3))]) for i in range(200)]
    monkeypatch.setattr(dedupe, "GROUP_ROWS", 20)
    got = dedupe.greedy_any_key(spark.createDataFrame(items, "id int, keys array<string>"), F.col("keys"), "id")
    assert sorted(r.id for r in got.collect()) == sequential(items)


def test_connected_groups_take_few_rounds(spark, monkeypatch):
    rng = random.Random(2)
    order = list(range(600))
    rng.shuffle(order)
    rows = [(order[i], f"a{i // 2}") for i in range(300)] + [(order[i], f"b{(i + 1) // 2}") for i in range(300)]  # one shuffled chain
    rows += [(order[i], f"c{i % 40}") for i in range(300, 600)]
    parent = {i: i for i in order}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_key = {}
    for i, k in rows:
        a, b = find(i), find(by_key.setdefault(k, i))
        parent[max(a, b)] = min(a, b)
    tables = []
    keep = groups.written
    monkeypatch.setattr(groups, "written", lambda df, name: tables.append(name) or keep(df, name))
    got = groups.connected_groups(spark.createDataFrame(rows, "id int, k string"), "id", "k").collect()
    assert {r.id: r.head for r in got} == {i: find(i) for i, _ in rows}
    assert len(tables) <= 1 + 2 * 8  # rounds, not links of the chain


def test_news_keys_ignore_case_punctuation_and_slash(spark):
    df = spark.createDataFrame([("Big, Deal!", "HTTPS://A.com/x/ "), ("big deal", "https://a.com/x")], "t string, u string")
    rows = df.select(text.title_key("t").alias("a"), text.url_key("u").alias("b")).collect()
    assert rows[0] == rows[1]


def test_phrase_hits_equal_brute_force(spark):
    rng = random.Random(9)
    bodies = ["samsungs a", "삼성전자 실적", "", None, "xab", "b 😀q", "a  b c", " lead", "tail ", "line\nbreak ab", "삼성 전자", "ab" * 40]
    bodies += [" ".join(rng.choice(["ab", "abc", "bca", "삼성전자", "c", "cab\t"]) for _ in range(rng.randint(1, 9))) for _ in range(40)]
    words = ["samsung", "삼성", "실적", "ab", "b", "none", "😀q", "a b", "a  b", " b", "ab ", "b c", "성전", "k\nb", "삼성 전자", "c ab", "ab abc", "bab", "", None, "ab"]
    words += [b[i : i + 9] for b in bodies if b for i in (0, 3)]
    docs = spark.createDataFrame(list(enumerate(bodies)) + [(0, bodies[0])], "id int, body string")
    want = {(i, w) for i, b in enumerate(bodies) for w in words if w and w.strip(" ") and b and w in b}
    got = phrase_hits(docs, "id", "body", spark.createDataFrame([(w,) for w in words], "p string"), "p").collect()
    assert len(got) == len(want) and {(r.id, r.p) for r in got} == want


def test_a_text_with_the_words_of_a_phrase_apart_is_no_candidate(spark):
    words = ["alpha", "beta", "gamma", "delta"]
    texts = [f"{a} and {b}" for a in words for b in words] + ["an alpha betas day"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, body string").select(F.col("id").alias("_doc"), F.split("body", " ").alias("_words"))
    keys = spark.createDataFrame([(f"{a} {b}", f"{a} {b}", True) for a in words for b in words], "_phrase string, _two string, _sure boolean")
    assert [tuple(r) for r in phrases._by_neighbours(docs, keys).collect()] == [(16, "alpha beta", True)]  # not 16 texts x 7 phrases


def test_phrases_of_many_parts_are_searched_whole(spark):
    texts = ["one two three four", "one two four three", "xone two threex", "one  two three", "two three one two"]
    asked = ["one two three", " two three", "two  three", "one  two", "three ", "two three one"]
    docs = spark.createDataFrame([(7, texts[0]), *enumerate(texts)], "id int, body string")
    want = {(i, w) for i, b in [(7, texts[0]), *enumerate(texts)] for w in asked if w in b}
    got = phrase_hits(docs, "id", "body", spark.createDataFrame([(w,) for w in asked], "p string"), "p").collect()
    assert len(got) == len(want) and {(r.id, r.p) for r in got} == want
    assert phrase_hits(docs, "id", "body", spark.createDataFrame([(" ",), (None,)], "p string"), "p").count() == 0


def test_similar_names_equal_brute_force(spark):
    names = [("005930.KS", "005930", "삼성전자", "KOSPI"), ("000660.KS", "000660", "SK하이닉스", "KOSPI"), ("035420.KS", "035420", "네이버", "KOSPI"), ("1.KS", "000001", "하이닉 스", "KOSPI")]
    queries = ["삼성", "삼성전기", "하이닉스", "sk 하이", "네이", "zzz"]
    key = lambda v: "".join(v.strip().lower().split())
    want = {}
    for q in queries:
        for s, tick, n, _ in names:
            a, b = key(q), key(n)
            score = 1.0 if a == b else 0.9 if a in b else difflib.SequenceMatcher(None, a, b).ratio()
            if score >= 0.45:
                want[(q, tick)] = round(score, 9)
    df = mapping.similar_names(spark.createDataFrame([(q,) for q in queries], "q string"), "q", spark.createDataFrame(names, "Symbol string, Ticker string, Name string, Market string"))
    assert {(r.query, r.Ticker): round(r.score, 9) for r in df.collect()} == want


def test_ratios_of_many_pairs_equal_difflib(monkeypatch):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("ab0한🙂") for _ in range(rng.choice([0, 1, 2, 5, 9, 17, 30])))
    pairs = [(word(), word()) for _ in range(3000)] + [("ab" * 150, "ba" * 120), ("a", "b" * 250), ("abc", "abc")]
    monkeypatch.setattr(mapping, "PAIRS_AT_ONCE", 700)
    got = mapping.sequence_ratios([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_similar_names_compare_each_pair_once_in_many_tasks(spark, monkeypatch, capsys):
    """Names that all resemble every query: no row for each common character, and tasks by the number of pairs."""
    monkeypatch.setattr(mapping, "PAIRS_PER_TASK", 100)
    names = spark.range(60).select(*[F.concat(F.lit(p), F.col("id")).alias(c) for c, p in (("Symbol", "S"), ("Ticker", "T"), ("Name", "Supplier#0000"), ("Market", "M"))])
    asked = spark.range(20).select(F.concat(F.lit("supplier#000"), F.col("id")).alias("q"))
    got = mapping.similar_names(asked, "q", names)
    got.explain()
    plan = capsys.readouterr().out
    assert got.count() == 1200 and plan.count("ArrowEvalPython") == 1 and "RoundRobinPartitioning(12)" in plan and "posexplode" not in plan


def test_capacity_weights_equal_water_filling(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for day in range(60):
        caps = [rng.choice([0.0, rng.random() * 0.4, rng.random()]) for _ in range(rng.randint(1, 6))]
        left, open_names, w = 1.0, set(range(len(caps))), [0.0] * len(caps)
        while open_names and left > 1e-12:
            share = left / len(open_names)
            full = {i for i in open_names if caps[i] - w[i] <= share}
            for i in full or set(open_names):
                step = caps[i] - w[i] if full else share
                w[i] += step
                left -= step
            open_names = open_names - full if full else set()
        for i, c in enumerate(caps):
            rows.append(("base", date.fromordinal(730000 + day), f"s{i}", c * 1000.0))
            want[(day, f"s{i}")] = w[i]
    df = spark.createDataFrame(rows, "strategy string, Date date, Symbol string, max_capacity_notional double")
    got = portfolio.capacity_weights(df, PortfolioParams(portfolio_value=1000.0)).collect()
    for r in got:
        assert r.weight == pytest.approx(want[(r.Date.toordinal() - 730000, r.Symbol)], abs=1e-9)


def test_costs_of_a_single_name(spark):
    df = spark.createDataFrame([(date(2024, 1, 2), "A", 0.5, 0.5, 0.9, 0.30)], "Date date, Symbol string, predicted_return double, signal_score double, up_probability double, target_log_return double")
    row = portfolio.daily_series(df, PortfolioParams(top_k=1, min_investor_coverage=0.0)).first()
    assert row.daily_return == pytest.approx(math.expm1(0.30) - 0.0015)


def test_ranking_ignores_news_columns_and_selection_refuses_them(spark):
    names = ["ret_1d", "ma_120_missing", "news_sentiment", "vol_news_x", "disclosure_score", "rsi_14", "investor_event_score", "Date"]
    assert feature_columns(names) == ["ret_1d", "ma_120_missing", "rsi_14"]
    assert set(display_columns(names)) == {"news_sentiment", "vol_news_x", "disclosure_score", "investor_event_score"}
    with pytest.raises(ValueError, match="display-only"):
        learning.fit_heads(spark.range(1), ["news_sentiment"])


def test_recommendation_thresholds(spark):
    df = spark.createDataFrame([(2.0,), (2.1,), (-2.0,), (-1.9,), (None,)], "predicted_return double")
    got = [r[0] for r in df.select(policy.recommendation(df)).collect()]
    assert got == [policy.HOLD, policy.BUY, policy.SELL, policy.HOLD, policy.HOLD]


def test_fold_windows_purge_and_no_leakage(spark):
    days = spark.createDataFrame([(d.date(),) for d in pd.bdate_range("2020-01-01", periods=600)], "Date date")
    folds = validation.fold_windows(days, FoldParams(min_train=252, test=60, step=60, purge=1)).orderBy("fold_id").collect()
    assert len(folds) == len(range(252, 600 - 60 + 1, 60))
    order = [r.Date for r in days.orderBy("Date").collect()]
    for f in folds:
        assert order.index(f.valid_start) - order.index(f.train_end) == 2
        assert f.train_end < f.valid_start <= f.valid_end
    assert validation.fold_windows(days, FoldParams(min_train=590, test=60, step=60)).count() == 0


def test_oof_consolidation_and_conflicts(spark):
    rows = [(date(2024, 1, 2), "A", 0.1, 1, 0.01, 0.6, 0), (date(2024, 1, 2), "A", 0.1, 1, 0.03, 0.8, 1)]
    schema = "Date date, Symbol string, target_log_return double, target_up int, predicted_return double, up_probability double, fold_id int"
    raw = spark.createDataFrame(rows, schema)
    out = validation.consolidate_oof(raw).first()
    assert (out.predicted_return, out.up_probability, out.oof_prediction_count, out.fold_ids) == (pytest.approx(0.02), pytest.approx(0.7), 2, [0, 1])
    assert validation.oof_conflicts(raw, []).first().duplicate_ratio == 0.5
    bad = spark.createDataFrame([rows[0], (*rows[1][:2], 0.2, *rows[1][3:])], schema)
    with pytest.raises(ValueError, match="conflicting"):
        validation.require_stable_targets(bad)


def test_calibration_needs_samples_and_isotonic_is_monotone(spark):
    one = spark.createDataFrame([(1, 0.5)], "y int, p double")
    row = metrics.calibration_metrics(one, "y", "p").first()
    assert not row.valid and row.brier is None
    rng = np.random.default_rng(1)
    p = rng.random(400).round(2)
    y = np.where(rng.random(400) < p, 0.01, -0.01)
    tune = spark.createDataFrame(pd.DataFrame({"up_probability": p, "target_log_return": y}))
    cal = learning.fit_calibrator(tune)
    grid = spark.createDataFrame([(i / 20,) for i in range(21)], "up_probability double")
    out = cal.transform(grid, name="c").orderBy("up_probability").toPandas()
    inside = out[(out["up_probability"] >= cal.low) & (out["up_probability"] <= cal.high)]
    assert inside["c"].is_monotonic_increasing and out["c"].between(0, 1).all()
    # Pool-adjacent-violators on the distinct points.
    pts = pd.DataFrame({"x": p, "y": (y > 0) * 1.0}).groupby("x")["y"].agg(["mean", "size"]).reset_index()
    blocks = []
    for x, m, n in pts.itertuples(index=False):
        blocks.append([m, n, [x]])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, n2, x2 = blocks.pop()
            m1, n1, x1 = blocks.pop()
            blocks.append([(m1 * n1 + m2 * n2) / (n1 + n2), n1 + n2, x1 + x2])
    want = {x: b[0] for b in blocks for x in b[2]}
    same = spark.createDataFrame([(float(x),) for x in want], "up_probability double")
    for r in cal.transform(same, name="c").collect():
        assert r.c == pytest.approx(want[r.up_probability], abs=1e-9)
    few = spark.createDataFrame([(0.5, 0.1), (0.6, -0.1)], "up_probability double, target_log_return double")
    assert learning.fit_calibrator(few).status == "identity"


def test_heads_predict_ordered_quantiles(spark):
    df = indicators.next_day_target(indicators.lagged_returns(indicators.price_returns(bars_frame(spark, 250)), (1, 5)))
    models = learning.fit_heads(df, ["ret_1d", "ret_5d", "daily_return"], trees=2)
    out = learning.predict_heads(models, df).toPandas()
    assert len(out) == 500 and out["up_probability"].between(0, 1).all()
    assert ((out["quantile_low"] <= out["quantile_mid"]) & (out["quantile_mid"] <= out["quantile_high"])).all()
    shares = learning.feature_importance(models, spark).groupBy("head").agg(F.sum("importance").alias("s")).collect()
    assert len(shares) == 5 and all(r.s == pytest.approx(1.0) for r in shares)


def noisy_frame(spark, n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = 0.02 * x[:, 0] + 0.01 * (1 + np.abs(x[:, 1])) * rng.normal(size=n)
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "target_log_return": y, "target_up": (y > 0).astype(int)})
    pdf.loc[::17, "c"] = None
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double, target_log_return double, target_up int")


def test_five_heads_cover_their_levels_on_held_out_rows(spark):
    train, held = noisy_frame(spark, 6000, 1), noisy_frame(spark, 6000, 2)
    models = learning.fit_heads(train, ["a", "b", "c"], trees=3)
    assert [h.level for h in models.quantiles] == [0.1, 0.5, 0.9] and all(len(h.trees) == learning.QUANTILE_TREES for h in models.quantiles)
    out = learning.predict_heads(models, held).toPandas()
    for level, name in zip((0.1, 0.5, 0.9), ("quantile_low", "quantile_mid", "quantile_high")):
        assert (out["target_log_return"] <= out[name]).mean() == pytest.approx(level, abs=0.02)
    assert ((out["quantile_low"] <= out["quantile_mid"]) & (out["quantile_mid"] <= out["quantile_high"])).all()
    # The spread follows the noise, which a shift of the mean prediction could not do.
    spread, wide = out["quantile_high"] - out["quantile_low"], out["b"].abs() > 1.5
    assert spread[wide].mean() > 1.4 * spread[~wide].mean()
    loss = lambda q, f: np.where(out["target_log_return"] > f, q, q - 1) * (out["target_log_return"] - f)
    for level, name in ((0.1, "quantile_low"), (0.9, "quantile_high")):
        assert loss(level, out[name]).mean() < 0.95 * loss(level, out["target_log_return"].quantile(level)).mean()
    shares = learning.feature_importance(models, spark).groupBy("head").agg(F.sum("importance").alias("s")).collect()
    assert len(shares) == 5 and all(r.s == pytest.approx(1.0) for r in shares)


def test_heads_run_the_plan_of_their_rows_once_and_wait_for_each_other_when_rows_are_many(spark, monkeypatch):
    seen, threads, cached = spark.sparkContext.accumulator(0), [], spark.sparkContext._jsc.getPersistentRDDs().size()

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    df = noisy_frame(spark, 600, 3)
    whole = learning.side_by_side
    monkeypatch.setattr(learning, "side_by_side", lambda session, jobs, n: threads.append(n) or whole(session, jobs, n))
    monkeypatch.setattr(learning, "ROWS_AT_ONCE", 1500)
    some = learning.fit_heads(df.mapInPandas(counted, df.schema), ["a", "b", "c"], trees=1, quantile_trees=2)
    assert seen.value == 600 and threads == [2]
    monkeypatch.setattr(learning, "ROWS_AT_ONCE", 10**6)
    assert learning.feature_importance(some, spark).collect() == learning.feature_importance(learning.fit_heads(df, ["a", "b", "c"], trees=1, quantile_trees=2), spark).collect()
    assert threads == [2, 5] and spark.sparkContext._jsc.getPersistentRDDs().size() <= cached


def test_folds_side_by_side_equal_folds_one_by_one_and_restart(spark, tmp_path, monkeypatch):
    df = indicators.next_day_target(indicators.lagged_returns(indicators.price_returns(bars_frame(spark, 260, ("AAA", "BBB"))), (1, 5)))
    p = FoldParams(min_train=120, test=40, step=40)
    names = ["ret_1d", "ret_5d", "daily_return"]
    windows = validation.fold_windows(df, p)
    run = lambda folder, threads: learning.walk_forward(df, windows, names, ["Close"], p, 2, str(tmp_path / folder), threads, 2)
    many = sorted(run("many", 3).collect(), key=str)
    assert len({r.fold_id for r in many}) == 3 and many == sorted(run("one", 1).collect(), key=str)
    fitted = []
    whole = learning.fit_heads
    monkeypatch.setattr(learning, "fit_heads", lambda *a, **k: fitted.append(1) or whole(*a, **k))
    assert sorted(run("many", 3).collect(), key=str) == many and not fitted  # all folds were committed
    for fold in (0, 2):
        spark.createDataFrame([(True,)], "ok boolean").write.parquet(str(tmp_path / "broken" / "done" / f"fold_id={fold}"))
        spark.read.parquet(str(tmp_path / "many" / f"fold-{fold}")).write.parquet(str(tmp_path / "broken" / f"fold-{fold}"))
    assert sorted(run("broken", 3).collect(), key=str) == many and len(fitted) == 1  # only the missing fold was fitted


def test_exact_quantiles_of_many_columns(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FINISH_ROWS", 20)
    rng = random.Random(4)
    n = 4001
    columns = {
        "spread": [rng.gauss(0, 1) * 10 ** rng.randint(-9, 9) for _ in range(n)], "ties": [float(rng.choice([1, 1, 1, 2, 7])) for _ in range(n)],
        "ends": [rng.random() if rng.random() < 0.02 else rng.choice([0.0, 1.0]) for _ in range(n)], "one": [3.5] * n, "gaps": [rng.random() if rng.random() < 0.3 else None for _ in range(n)],
        "none": [None] * n, "single": [None] * (n - 1) + [4.0], "two": [None] * (n - 2) + [1.0, 4.0], "signs": [-(2.0**k) for k in range(n // 4)] + [2.0 ** -(k % 999) for k in range(n - n // 4)],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).repartition(7)
    for level in (0.5, 0.75, 0.0, 1.0):
        got = quantiles.exact_quantiles(df, list(columns), level)
        for c, values in columns.items():
            known = [v for v in values if v is not None]
            assert (got[c] is None) == (not known), c
            if known:
                assert got[c] == pytest.approx(float(np.quantile(known, level)), rel=1e-12), (c, level)
    assert quantiles.exact_quantiles(df.where("false"), ["ties"]) == {"ties": None} and quantiles.exact_quantiles(df, []) == {}
    small = df.limit(10)
    assert quantiles.exact_quantiles(small, ["ties"])["ties"] is not None


def test_weight_grid_equals_ranking_every_row(spark):
    rng = random.Random(6)
    day = lambda i: date.fromordinal(738000 + i)
    rows = [(day(i % 30), f"s{i}", round(rng.random(), 1), round(rng.random(), 1), round(rng.random(), 1), None if rng.random() < 0.05 else round(rng.gauss(0, 0.02), 3)) for i in range(900)]
    rows += [(day(i % 30), f"t{i}", 0.5, 0.5, 0.5, rng.gauss(0, 0.02)) for i in range(500)] + [(day(3), "u", None, 0.5, 0.5, 0.1)]  # a third of all rows share a score
    df = spark.createDataFrame(rows, "Date date, Symbol string, norm_return double, up_probability double, uncertainty_score double, target_log_return double")
    p = TuningParams(return_weights=(0.3, 0.65), prob_weights=(0.2, 0.5), penalties=(0.15,))
    pdf = pd.DataFrame(rows, columns=df.columns)
    pdf["part"] = np.where(pdf["Date"] < day(21), "train", "valid")
    got = {(r.candidate, r.part): r for r in validation.tuning_grid(df, p).collect()}
    weights = [(a, b, c) for a in p.return_weights for b in p.prob_weights for c in p.penalties] + [p.default]
    assert set(got) == {(i, part) for i in range(len(weights)) for part in ("train", "valid")}
    for (i, part), r in got.items():
        a, b, c = weights[i]
        x = pdf[pdf["part"] == part].copy()
        x["score"] = np.rint((x["norm_return"] * a + x["up_probability"] * b - x["uncertainty_score"] * c) * 1e12)
        top = x.sort_values(["score", "Date", "Symbol"], ascending=[False, True, True], na_position="last").head(max(1, int(len(x) * p.top_share)))["target_log_return"].dropna()
        ranks = pd.DataFrame({"s": x["score"].rank(), "t": x["target_log_return"].rank()}).dropna()
        assert (r.w_ret, r.w_prob, r.w_pen) == (a, b, c)
        assert r.top_return == pytest.approx(top.mean(), abs=1e-12)
        assert r.rank_ic == pytest.approx(np.corrcoef(ranks["s"], ranks["t"])[0, 1], abs=1e-9)
        assert r.downside == pytest.approx(-top[top < 0].mean() if (top < 0).any() else 0.0, abs=1e-12)
    only = validation.tuning_grid(df, p, only=[len(weights) - 1]).collect()
    assert {(r.candidate, r.part) for r in only} == {(len(weights) - 1, "train"), (len(weights) - 1, "valid")}


def test_smaller_before_counts_every_earlier_bar_once(spark):
    rng = random.Random(8)
    rows = [(s, i, float(rng.randint(0, 40))) for s, n in (("A", 1500), ("B", 33), ("C", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "Symbol string, bar_no int, v double")
    got = {(r.Symbol, r.bar_no): r.n for r in indicators.smaller_before(df, "v", "n", longest=2000).collect()}
    for s in "ABC":
        values = [v for name, _, v in rows if name == s]
        assert [got[s, i] for i in range(len(values))] == [sum(w < v for w in values[:i]) for i, v in enumerate(values)]
    with pytest.raises(Exception, match="raise longest"):
        indicators.smaller_before(df, "v", "n", longest=900).collect()


def test_external_series_is_lagged_and_filled(spark):
    days = [date(2024, 1, d) for d in (2, 3, 4, 5)]
    bars = spark.createDataFrame([(d, "A") for d in days], "Date date, Symbol string")
    series = spark.createDataFrame([("^VIX", days[0], 100.0), ("^VIX", days[1], 110.0), ("^KS11", days[0], 7.0)], "series string, Date date, close double")
    out = context.external_matrix(series, bars, ["^VIX", "^KS11"]).orderBy("Date").collect()
    assert [r.vix_close for r in out] == [None, 100.0, 100.0, 100.0]
    assert [r.ks11_close for r in out] == [7.0, 7.0, 7.0, 7.0]


def test_series_fall_back_to_substitutes(spark):
    days = [date(2024, 1, d) for d in (2, 3, 4)]
    bars = spark.createDataFrame([(d, "A") for d in days], "Date date, Symbol string")
    rows = [("EWY", days[0], 5.0), ("EWY", days[1], 6.0), ("QQQ", days[0], 1.0), ("^VIX", days[0], None), ("VIXY", days[0], 9.0), ("SOXX", date(2023, 1, 2), 3.0), ("^GSPC", days[0], 2.0), ("SPY", days[0], 7.0)]
    series = spark.createDataFrame(rows, "series string, Date date, close double")
    names = ["^KS11", "^IXIC", "NQ=F", "^VIX", "^SOX", "^GSPC"]
    out = context.external_matrix(series, bars, names).orderBy("Date").collect()
    assert [r.ks11_close for r in out] == [None, 5.0, 5.0]  # the substitute trades elsewhere: a row late
    assert [r.ixic_close for r in out] == [r.nq_f_close for r in out]
    assert {r.sox_close for r in out} == {None}  # landed only outside the span
    chosen = context.choose_series(series, context.fallback_chains(spark, names))
    assert {(r.series, r.used) for r in chosen.collect()} == {("^KS11", "EWY"), ("^IXIC", "QQQ"), ("NQ=F", "QQQ"), ("^VIX", "VIXY"), ("^SOX", "SOXX"), ("^GSPC", "^GSPC")}
    row = context.source_coverage(chosen).first()
    assert (row.requested, row.successful, row.failed, row.substituted, row.ratio) == (6, 6, 0, 5, 1.0)
    assert context.source_coverage(chosen.where("false")).first().ratio == 1.0


def test_writes_count_rows_and_nulls_and_check_fields(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, None)], "k int, v string")
    for csv in (False, True):
        got = sinks.write_artifact(df, str(tmp_path / f"out-{csv}"), csv, required=["v", "k", "gone"])
        assert (got.rows, got.columns, got.nulls, got.missing(["k", "gone"])) == (3, ("k", "v"), {"v": 2, "k": 0}, ["gone"])
    none = sinks.write_artifact(df.where("k > 9"), str(tmp_path / "none"), required=["v"])
    assert (none.rows, none.nulls) == (0, {"v": 0})
    report = sinks.contract_report(spark, {"a": got}, {"a": ["v", "gone"]}).collect()
    assert [(r.field, r.present, r.null_count, r.row_count) for r in report] == [("v", True, 2, 3), ("gone", False, None, 3)]
    with pytest.raises(ValueError, match="gone"):
        sinks.require_fields({"a": got}, {"a": ["gone"]})
    lines = sinks.manifest(spark, {"a": got, "none": none}).collect()
    assert [(r.relative_path, r.row_count, r.columns) for r in lines] == [("a", 3, ["k", "v"]), ("none", 0, ["k", "v"])]


def test_a_failed_publish_leaves_the_latest_one(spark, tmp_path):
    root, df = str(tmp_path / "pub"), spark.createDataFrame([(1, 2.0)], "k int, v double")
    put = lambda frame, day, run, **kw: sinks.publish_snapshot({"simple": frame, "detail": frame}, root, day, run, "now", 1, **kw)
    with pytest.raises(ValueError, match="nothing is published"):
        sinks.read_published(spark, root, "detail")
    put(df, "2024-01-03", "one")
    put(df.withColumn("v", F.lit(3.0)), "2024-01-02", "two")
    with pytest.raises(ValueError, match="artifacts to publish"):
        sinks.publish_snapshot({"simple": df}, root, "2024-01-05", "three", "now", 1, required={"detail": []})
    with pytest.raises(ValueError, match="required fields"):
        put(df, "2024-01-05", "four", required={"detail": ["w"]})
    broken = df.withColumn("v", F.when(F.col("k") == 1, F.raise_error(F.lit("broken write")).cast("double")))
    with pytest.raises(Exception, match="broken write"):
        put(broken, "2024-01-05", "five")
    assert sinks.read_published(spark, root, "detail").first().v == 3.0  # published last, though for an earlier date
    assert sinks.read_published(spark, root, "detail", "2024-01-03").first().v == 2.0
    put(df.withColumn("v", F.lit(4.0)), "2024-01-03", "six")
    assert sinks.read_published(spark, root, "simple", "2024-01-03").first().v == 4.0
    index = {r.trading_date: (r.source_run_id, r.is_latest) for r in sinks.published_index(spark, root).collect()}
    assert index == {"2024-01-03": ("six", True), "2024-01-02": ("two", False)}


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    table = str(tmp_path / "counts")
    frame = lambda rows: spark.createDataFrame(rows, "Date date, Symbol string, source_type string, event_count long, disclosure_score double")
    first = frame([(date(2024, 1, 31), "A", "news", 3, 0.0), (date(2024, 2, 1), "A", "news", 1, 0.0)])
    second = frame([(date(2024, 2, 1), "A", "news", 4, 0.0), (date(2024, 2, 1), "B", "disclosure", 1, 0.2)])
    seen = lambda: sorted(tuple(r)[:5] for r in spark.read.parquet(table).select("Date", "Symbol", "source_type", "event_count", "batch_id").collect())
    jobs.merge_counts(first, 0, table, str(tmp_path / "s0"))
    jobs.merge_counts(second, 1, table, str(tmp_path / "s1"))
    want = [(date(2024, 1, 31), "A", "news", 3, 0), (date(2024, 2, 1), "A", "news", 4, 1), (date(2024, 2, 1), "B", "disclosure", 1, 1)]
    assert seen() == want
    jobs.merge_counts(second, 1, table, str(tmp_path / "s1"))
    jobs.merge_counts(first, 0, table, str(tmp_path / "s0"))
    assert seen() == want


def test_article_text_skips_hidden_elements(spark):
    body = "<p>Fact &amp; figure</p><script>x</script><svg><p>no</p></svg> " + "word " * 60
    html = [(1, body), (2, "<p>short</p>"), (3, "<p>Subscribe to continue</p>" + "text " * 60)]
    got = {r.page_id: r for r in pages.extract_articles(spark.createDataFrame(html, "page_id int, html string")).collect()}
    plain = re.sub(r"\s+", " ", "Fact & figure " + "word " * 60).strip()
    assert got[1].ok and got[1].text == plain
    assert got[2].risk_flags[0] == "article_text_too_short" and got[3].risk_flags[0] == "article_fetch_failed" and got[3].text == ""


def test_all_character_references_are_resolved(spark):
    names = "".join(f"a&{n}b " for n in html.entities.html5)
    numbers = [*range(0x250), 0x2028, 0xD7FF, 0xD800, 0xDFFF, 0xFDD0, 0xFEFF, 0xFFFD, 0xFFFE, 0x1F600, 0x1FFFF, 0x10FFFF, 0x110000, 10**9, 2**70]
    texts = [names, *(f"x&#{n};y&#x{n:x} z&#X00{n:X};&#{n}" for n in numbers), "&ndash;&eacute;&#8217;&#54620;&hellip;&notit;&notin;&nosuch;&;& &#;&#x;&#xg &&amp;lt; a&b=1&copy=2 &", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.u for r in rows.select("i", pages.unescape(F.col("t")).alias("u")).collect()}
    assert got == {i: t if t is None else html.unescape(t) for i, t in enumerate(texts)}
    body = "caf&eacute; &amp;ndash; &#54620;&emsp;&#x2003;&hellip; " + "word " * 60 + "&#44396;&#46021; &#54980;"
    page = pages.extract_articles(spark.createDataFrame([(1, body), (2, body[:-25])], "page_id int, html string")).orderBy("page_id").collect()
    assert page[0].risk_flags[0] == "article_fetch_failed" and page[1].text.startswith("café – 한 … word")


def test_files_round_trip(spark, tmp_path):
    path = tmp_path / "bars.csv"
    path.write_text("﻿Date,Symbol,Open,High,Low,Close,Volume\n2024-01-02,005930,1,2,1,2,10\n2024-01-02,005930,1,2,1,2,30\n", encoding="utf-8")
    bars = readers.read_bars(spark, str(path))
    assert bars.count() == 2 and bars.first().Symbol == "005930"
    assert clean.clean_bars(bars).first().Volume == 30.0
    bare = tmp_path / "bare.csv"
    bare.write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,1,2,10\n")
    assert readers.read_bars(spark, str(bare)).first().Symbol == "UNKNOWN"
    broken = tmp_path / "broken.csv"
    broken.write_text("Date,Open\n2024-01-02,1\n")
    with pytest.raises(ValueError, match="missing required columns"):
        readers.read_bars(spark, str(broken))
    base = bars.drop("ingest_seq").withColumn("tag", F.lit("x"))
    merged = sinks.merge_bars(base, bars.drop("ingest_seq").where("Volume = 10").withColumn("Close", F.lit("9")), F.col("Close")).collect()
    assert len(merged) == 1 and merged[0].Close == "9" and merged[0].tag == "x"


def test_ranks_of_a_missing_group_are_the_same_on_both_plans(spark):
    rows = [(None, "a", 1.0), (None, "b", 2.0), (None, "c", 2.0), ("d", "e", 1.0), ("d", "f", None)]
    df = spark.createDataFrame(rows, "g string, s string, v double")
    plans = {
        "ordinal": lambda bound: ordinal_rank(df, ["g"], [F.col("v").desc(), F.col("s")], "r", bound),
        "dense": lambda bound: dense_rank(df, ["g"], "v", "r", group_rows=bound),
        "average": lambda bound: average_rank(df, ["g"], "v", "r", group_rows=bound),
    }
    for name, plan in plans.items():
        small, sliced = ({x.s: x.r for x in plan(bound).collect()} for bound in (100, None))
        assert small == sliced, name
        assert small["a"] is not None and small["c"] is not None


def test_impact_scores_of_two_clusters(spark):
    rows = [("A", "c1", 30.0), ("A", "c1", 20.0), ("A", "c2", -10.0), ("A", "c2", -5.0), ("A", "c1", -1.0)]
    out = impact.aggregate_scores(spark.createDataFrame(rows, "ticker string, cluster_id string, impact_score double"), ["ticker"]).first()
    assert out.positive_score == pytest.approx(34.0) and out.negative_score == pytest.approx(-12.0)
    assert out.news_disclosure_score == pytest.approx(22.0) and out.uncertainty_score == 15.0 and out.event_count == 5
