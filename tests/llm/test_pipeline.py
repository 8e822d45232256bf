"""The pipeline's stages keep the columns of documents and do what their operators say; the queries match their SQL."""

import pytest

import corpus_pipeline
from tests.check_oracles import compare, connect
from tickloom.llm import simhash
from tickloom.llm.queries import ORACLES, QUERIES


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "simhash near-dedup", "benchmark decontamination", "source mixing", "resharding"]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf).cache()
        counts.append(docs.count())
        assert docs.columns == columns + (["shard", "slot"] if number == 4 else [])
        if number == 1:
            classes = simhash.near_duplicates(docs)
            assert classes.select("component_id").distinct().count() == counts[-1]
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] < counts[2] and counts[4] == counts[5]


def test_stages_with_clashing_columns_nulls_repeats_and_empty_tables(spark, sf):
    rows = [(1, "plain words here", "en", "s1"), (1, "plain words here", "en", "s1"), (2, None, None, None), (3, "", "en", "s2"), (None, "no id", "de", "s1"), (4, "plain words here", "en", "s2")]
    names = ["_id", "_key", "_size", "_domain", "_copies", "_shard", "shard", "slot", "key", "n", "component_id", "_block", "a.b"]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` long" for n in names))
    plain = docs.select("doc_id", "text", "lang", "source")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out, same = stage(spark, docs, sf), stage(spark, plain, sf)
        want = [c for c in docs.columns if c not in ("shard", "slot")] + ["shard", "slot"] if number == 4 else docs.columns
        assert out.columns == want
        kept = lambda df: sorted((str(r["doc_id"]), str(r["text"])) for r in df.collect())
        assert kept(out) == kept(same) and all(r["a.b"] == len(names) - 1 and r["_id"] == 0 for r in out.collect())
        assert stage(spark, docs.where("false"), sf).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_sql(spark, sf, name):
    ok, text = compare(spark, connect(sf), sf, name, QUERIES[name], ORACLES[name])
    assert ok, text


@pytest.mark.parametrize("number", range(1, 14))
def test_each_operator_has_a_query(number):
    assert sum(q.startswith(f"op{number}_") for q in QUERIES) == 1
