"""What is read, ranked and written for large tables, on rows made here."""

import random
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom import session
from tickloom.operators import crosssection, indicators, ranking, scoring, signal_tests, validation, weight_grid
from tickloom.params import TuningParams
from tickloom.plans import evaluation, learning, policy
from tickloom.sources import tables
from tickloom.sources.predictions import head_predictions

DAYS, SYMBOLS = 40, 5


@pytest.fixture
def history(spark, tmp_path):
    """A long history of few symbols: 200 line items, at most 5 of one date."""
    start = datetime(1995, 1, 1)
    items = [
        (d * SYMBOLS + s, s * 7 + d, s, 1, 1.0 + (d + s) % 3, 100.0 + (d * 37 + s * 11) % 50, 0.01, 0.02, start + timedelta(days=d))
        for d in range(DAYS) for s in range(SYMBOLS)
    ]
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp"
    spark.createDataFrame(items, columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    suppliers = [(s, f"Supplier#{s}", s % 3, 1.0) for s in range(SYMBOLS)]
    spark.createDataFrame(suppliers, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(n, n % 2) for n in range(3)], "n_nationkey int, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    return str(tmp_path)


def test_a_long_history_is_ranked_by_date_without_slices(spark, history, monkeypatch):
    """The bound of a date is that of its own rows: a table with more rows than a task takes isn't written to be ranked."""
    plain = {(r.Date, r.Symbol): r.turnover_rank_daily for r in head_predictions(spark, history).collect()}
    monkeypatch.setattr(ranking, "ROWS_PER_TASK", 20)
    monkeypatch.setattr(ranking, "cut_lineage", lambda df: pytest.fail("sliced"))
    assert tables.rows_per_date(spark, history) == SYMBOLS and tables.row_bound(spark, history) == DAYS * SYMBOLS
    assert {(r.Date, r.Symbol): r.turnover_rank_daily for r in head_predictions(spark, history).collect()} == plain
    assert len(plain) == (DAYS - 21) * SYMBOLS and set(plain.values()) == set(range(1, SYMBOLS + 1))
    monkeypatch.undo()
    monkeypatch.setattr(ranking, "ROWS_PER_TASK", SYMBOLS - 1)  # a date too large for a task still goes in slices
    assert {(r.Date, r.Symbol): r.turnover_rank_daily for r in head_predictions(spark, history).collect()} == plain


def test_a_prediction_frame_writes_only_what_it_carries(spark, history, monkeypatch):
    """Features that no later step reads are not computed and written."""
    kept, write = [], scoring.written
    monkeypatch.setattr(scoring, "written", lambda df, name: kept.append(df.columns) or write(df, name))
    assert policy.prediction_frame(spark, history).count() == (DAYS - 21) * SYMBOLS
    assert evaluation.oof_diagnostics(spark, history).count() == 1
    assert policy.scored_frame(spark, history).count() == (DAYS - 21) * SYMBOLS
    assert len(kept) == 3 and all(not {"ma_20", "High", "intraday_return", "sector"} & set(c) for c in kept)
    assert [len(c) for c in kept] == [10, 10, 18]


def test_sets_of_observations_are_ranked_without_repeating_rows(spark, monkeypatch):
    """Each set equals the block of its own rows, with ties and missing keys; no table written has more rows than came in."""
    rng = random.Random(3)
    rows = [
        (i % 190, rng.choice([None, -1.5, -0.5, 0.0, 0.5, 2.0]), rng.randint(-4, 4) / 100, date(2024, 1, 1 + rng.randint(0, 6)),
         rng.choice(["a", "b", None]), f"cap{rng.randint(0, 2)}", ["missing_intraday_price"] if i % 17 == 0 else [])
        for i in range(200)
    ]
    obs = spark.createDataFrame(rows, "seq int, score double, after_cost_return double, entry_day date, sector string, market_cap_bucket string, quality_flags array<string>")
    obs = obs.where("seq >= 10")  # no order twice
    sizes = []
    for module in (ranking, signal_tests):
        for name in ("written", "cut_lineage"):
            if keep := getattr(module, name, None):
                monkeypatch.setattr(module, name, lambda df, *a, keep=keep: sizes.append(df.count()) or keep(df, *a))
    got = {(r.set, r.key): r for r in signal_tests.validation_sets(obs, "seq", 3).collect()}
    assert sizes and max(sizes) <= obs.count()
    monkeypatch.undo()
    want = {}
    for name, column in (("overall", F.lit("all")), ("by_day", F.col("entry_day")), ("by_sector", F.col("sector")), ("by_market_cap", F.col("market_cap_bucket"))):
        k = 3 if name == "overall" else 1
        block = signal_tests.coefficient_block(obs.withColumn("key", column.cast("string")), ["key"], "seq", k, 1000)
        want.update({(name, r.key): r for r in block.collect()})
    assert set(got) == set(want) and len(got) == 1 + 7 + 2 + 3
    for key, r in want.items():
        for c in ("sample_size", "ic", "rank_ic", "hit_ratio", "top_bottom_spread"):
            assert got[key][c] == pytest.approx(r[c], abs=2e-6), (key, c)


def test_the_universe_of_a_date_is_counted_where_it_is_ranked(spark, history, monkeypatch):
    """The line items are read once for a rank with its size; a missing date has no rank, in slices as well."""
    leaves = policy.simple_result(spark, history)._jdf.queryExecution().optimizedPlan().collectLeaves().toString()
    assert leaves.count("l_shipdate") == 1
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 1, None), ("c", 1, 3.0), ("a", 2, 1.0), ("b", None, 1.0)], "Symbol string, Date int, s double")
    found = lambda out: sorted((r.Date, r.Symbol, r.cross_section_rank, r.rank_universe_size, round(r.rank_percentile, 6)) for r in out.collect())
    plain = found(crosssection.cross_section_ranks(df, "s", 10))
    assert plain == [(1, "a", 2, 3, 0.666667), (1, "b", 3, 3, 0.333333), (1, "c", 1, 3, 1.0), (2, "a", 1, 1, 1.0)]
    monkeypatch.setattr(ranking, "ROWS_PER_TASK", 1)
    assert found(crosssection.cross_section_ranks(df, "s", 10)) == plain


def test_year_high_equals_brute_force_without_a_long_frame(spark):
    """Missing closes count as bars but not as values; no row goes through its 252 bars."""
    rng = random.Random(6)
    closes = {s: [rng.choice([None, *(float(rng.randint(1, 40)) for _ in range(4))]) for _ in range(n)] for s, n in (("a", 600), ("b", 30), ("c", 5))}
    bars = spark.createDataFrame([(s, i, c) for s, all_ in closes.items() for i, c in enumerate(all_)], "Symbol string, Date int, Close double")
    for n, need in ((252, 20), (7, 3), (1, 1)):
        df = indicators.year_high(bars, n, need)
        assert f"RowFrame, -{n - 1}, currentrow$" not in df._jdf.queryExecution().optimizedPlan().toString()
        for r in df.collect():
            def high(last):
                seen = [v for v in closes[r.Symbol][max(0, last - n + 1) : last + 1] if v is not None]
                return max(seen) if last >= 0 and len(seen) >= need else None
            own, now, before = closes[r.Symbol][r.Date], high(r.Date), high(r.Date - 1)
            assert r.close_to_52w_high == (None if own is None or now is None else own / now)
            assert r.breakout_52w_flag == float(own is not None and before is not None and own >= before)


def test_calibrated_probabilities_read_the_bars_once(spark, history):
    """The calendar, the fit and the map read four written columns; the forecast isn't computed again for each."""
    out = learning.calibrated_probability(spark, history)
    assert out.inputFiles() and not [f for f in out.inputFiles() if "lineitem" in f]
    assert out.count() == (DAYS - 21) * SYMBOLS


def test_a_risk_text_is_built_once_per_row(spark, history):
    """Action and gate look at the text many times; the plan does not hold it for each look."""
    plan = policy.action_and_gate(spark, history)._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("THEN HIGH_UNCERTAINTY") <= 2  # a null-if looks at its value twice


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getPath() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    """What was shuffled for a table that is stored goes with the step; the session's setting is as it was."""
    before, setting = shuffle_files(spark), spark.conf.get(session.SHUFFLE_CLEANUP, None)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert session.written(df, "kept").count() == 7 and session.cut_lineage(df).where("k < 3").toPandas().shape == (3, 2)
    with session.shuffles_dropped(spark):
        assert session.written(df, "kept").count() == 7
        assert spark.conf.get(session.SHUFFLE_CLEANUP) == "true"
    assert spark.conf.get(session.SHUFFLE_CLEANUP, None) == setting
    stored = {f for f in shuffle_files(spark) - before if not f.endswith(".checksum")}
    session.written(df, "kept")
    assert not {f for f in shuffle_files(spark) - before if not f.endswith(".checksum")} - stored  # counts above are steps of their own


def test_rows_travel_narrow_to_their_percentiles(spark, history):
    """Boost is worked out before the rows travel; no column goes with them only to spread a frequent value."""
    for query in (policy.scored_frame, policy.finalize_latest, evaluation.rescore):
        plan = query(spark, history)._jdf.queryExecution().optimizedPlan().toString()
        assert "format_string" not in plan  # the band, which none of them returns
        assert "_boost" in plan or query is not policy.scored_frame


def test_weightings_are_ranked_in_buckets_without_moving_rows(spark, monkeypatch):
    """Many chunks, buckets and rounds, frequent, missing and unordered scores: sums equal those of ranked rows, and few bytes a row travel, fewer in long buckets."""
    rng = random.Random(9)
    cell = lambda: rng.choice([0.5, rng.random(), rng.random(), rng.random()])
    rows = [(rng.choice(["train", "valid"]), cell(), cell(), cell(), float(rng.randint(1, 900)) / 2 if rng.random() < 0.9 else None) for _ in range(6000)]
    rows += [("train", 0.5, 0.5, 0.5, 7.0)] * 500 + [("train", None, 0.1, 0.2, 3.0), ("valid", float("nan"), 0.1, 0.2, 3.0), ("valid", float("nan"), 0.3, 0.2, 4.0), ("valid", 1e9, 0.1, 0.2, 5.0), ("none", None, 0.5, 0.5, 1.0)]
    base = spark.createDataFrame(rows, "part string, norm_return double, up_probability double, uncertainty_score double, target_rank double").repartition(3)
    weights = [(0, 0.3, 0.5, 0.15), (4, 0.65, 0.35, 0.25), (7, 0.0, 0.0, 0.0)]
    moved = []
    for name, value in (("CHUNK_ROWS", 400), ("BUCKET_ROWS", 250), ("ROWS_AT_ONCE", 7000)):
        monkeypatch.setattr(weight_grid, name, value)
    cuts, count = [], weight_grid._counted
    monkeypatch.setattr(weight_grid, "_counted", lambda *a: cuts.extend(len(x) for x in a[2].values()) or count(*a))
    pack = weight_grid._packed
    monkeypatch.setattr(weight_grid, "_packed", lambda *a: moved.append(pack(*a).selectExpr("sum(length(scores) + length(counts) + length(known) + length(ranks))").first()[0]) or pack(*a))
    got = {(r.candidate, r.part): r for r in weight_grid.rank_sums(base, weights, 0.1).collect()}
    assert set(got) == {(i, part) for i, *_ in weights for part in ("train", "valid", "none")}
    assert max(cuts) > 5 and len(moved) == len(weights) and sum(moved) < 24 * len(rows) * len(weights)
    for (i, part), r in got.items():
        w = next(w for j, *w in weights if j == i)
        own = pd.DataFrame([x for x in rows if x[0] == part], columns=["part", "a", "b", "c", "t"])
        own["score"] = [None if pd.isna(x.a) and part != "valid" else np.rint((x.a * w[0] + x.b * w[1] - x.c * w[2]) * 1e12) for x in own.itertuples()]
        own["order"] = own["score"].astype(float).fillna(np.inf) if part == "valid" else own["score"].astype(float)
        if i == 7 and part == "valid":
            own["order"] = own["order"].where(~own["a"].isna(), np.inf)
        ranks, middle = own["order"].rank(), (len(own) + 1) / 2
        both = ranks.notna() & own["t"].notna()
        x, t = ranks[both] - middle, own["t"][both] - middle
        assert (r._n, r.k) == (len(own), both.sum())
        if both.any():
            assert [r.r, r.rr, r.t, r.tt, r.rt] == pytest.approx([x.sum(), (x * x).sum(), t.sum(), (t * t).sum(), (x * t).sum()], rel=1e-9, abs=1e-6)
        top = max(1, int(len(own) * 0.1))
        best = own["order"].sort_values(ascending=False, na_position="last").to_numpy()
        cut = best[top - 1]
        assert r._top == top and r._need == top - (np.sum(best > cut) if not np.isnan(cut) else np.sum(~np.isnan(best)))
        assert r._cut is None if np.isnan(cut) else (np.isnan(r._cut) if np.isinf(cut) else r._cut == cut)


def test_a_grid_shuffles_no_row_for_each_candidate(spark, history, monkeypatch):
    """The only rows that are looked at one by one are those that share the last score of the top."""
    ranked, rank = [], validation.ordinal_rank
    monkeypatch.setattr(validation, "ordinal_rank", lambda df, *a: ranked.append(df.count()) or rank(df, *a))
    rng = random.Random(4)
    rows = [(date(2024, 1, 1 + i % 20), f"s{i}", rng.random(), rng.random(), rng.random(), rng.gauss(0, 0.02)) for i in range(2000)]
    df = spark.createDataFrame(rows, "Date date, Symbol string, norm_return double, up_probability double, uncertainty_score double, target_log_return double")
    grid = validation.tuning_grid(df, TuningParams())
    assert grid.count() == 74 and ranked == [74]


def test_strata_are_found_where_rows_lie_by_symbol(spark, history, monkeypatch):
    """With strata too large to be sent to all, rows travel to their symbol, then to their date; a symbol listed twice gives two rows of one rank."""
    monkeypatch.setattr(tables, "strata", lambda spark, sf, strata=tables.strata: strata(spark, sf).unionByName(strata(spark, sf).where("Symbol = 'S1'").withColumn("sector", F.lit("other"))))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = head_predictions(spark, history)
        plan = df._jdf.queryExecution().executedPlan().toString()
        rows = df.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert df.columns[-2:] == ["market_type", "sector"]
    assert len([line for line in plan.splitlines() if "Exchange hashpartitioning(Symbol#" in line and "Date#" not in line]) == 2  # of bars and strata, not of ranked rows
    twice = [(r.Date, r.turnover_rank_daily, r.market_type, r.sector) for r in rows if r.Symbol == "S1"]
    assert len(twice) == 2 * (DAYS - 21) and len({x[:2] for x in twice}) == DAYS - 21 and {x[2:] for x in twice} == {("M1", "R1"), ("M1", "other")}
    assert max(r.turnover_rank_daily for r in rows) == SYMBOLS
