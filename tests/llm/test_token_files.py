"""Token files: an exact round trip against the tokenizers library, and single documents by their index."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tickloom.llm import token_files
from tickloom.session import scratch_path

SCHEMA = "doc_id long, text string, part int, start long, frames string"
ROWS = [
    (5, "Plain words, with  two spaces and a tab\there."), (2, None), (9, ""), (3, " \n\t "), (None, "no id"), (None, None), (3, "a repeated id"), (3, "a repeated id"),
    (8, "ñandú ÉTÉ 日本語 😀 " * 40), (11, "don't it's <|endoftext|> x <|endoftext|>y " * 20), (12, "word " * 60_000), (13, "x" * 5000 + " end"), (1, "\x00 \x85 \x1c a b c"),
    (7, "line one\nline two \n\n three  \n"), (-4, "below zero id"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, 1, 2, "z") for d, t in ROWS], SCHEMA).repartition(5)


def expected(rows, tokenizer):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    return order, [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t in order]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_round_trip(spark, docs, name):
    path = token_files.tokenizer_path(name)
    folder = scratch_path(spark, "tokens")
    token_files.write_tokens(docs, folder, path, pack_ids=300)
    back = token_files.read_tokens(spark, folder).orderBy("start").collect()
    order, ids = expected(ROWS, Tokenizer.from_file(path))
    assert [r["doc_id"] for r in back] == [d for d, _ in order]
    assert [r["start"] for r in back] == [0, *np.cumsum([r["n_tokens"] for r in back]).tolist()[:-1]]
    assert all(r["n_tokens"] == len(r["ids"]) for r in back)
    by_id = lambda pairs: sorted((str(d), list(map(int, i))) for d, i in pairs)
    assert by_id((r["doc_id"], r["ids"]) for r in back) == by_id((d, i) for (d, _), i in zip(order, ids))
    crcs = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in token_files.digests(spark, folder).collect())
    assert crcs == sorted((str(d), len(i), zlib.crc32(i.tobytes())) for (d, _), i in zip(order, ids))
    few = token_files.read_documents(spark, folder, [3, 12, 99]).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in few) == sorted((d, len(i)) for (d, _), i in zip(order, ids) if d in (3, 12))
    assert token_files.read_documents(spark, folder, []).count() == 0


def test_pieces_give_the_ids_of_whole_texts(spark, sf):
    encoder = token_files.Encoder(token_files.tokenizer_path())
    assert encoder.cuts
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + [t or "" for _, t in ROWS]
    for _ in range(2):  # with an empty memo and a full one
        assert encoder.many(texts) == [encoder.whole(t) for t in texts]
    odd = ["a b", "a b", "　 a", "é b\nñ c", "a\n\n b", "a\n b", "\na", "a\n", " a", "a ", "a\u2003 b", "×\n÷", "a\x85 b", "日 本\n日", "😀 😀\n😀x", "it's \n's", "", "\n", " "]
    assert encoder.many(odd) == [encoder.whole(t) for t in odd]


def test_dictionary_is_shared_hashed_and_helps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    folder = scratch_path(spark, "tokens")
    token_files.write_tokens(docs, folder)
    held = spark.read.parquet(f"{folder}/dictionary").collect()
    packs = spark.read.parquet(f"{folder}/packs").collect()
    assert len(held) == 1 and held[0]["dictionary"] and {p["dictionary_sha256"] for p in packs} == {held[0]["dictionary_sha256"]}
    path, size = token_files.tokenizer_path(), sum(len(p["frames"]) for p in packs)
    alone = token_files.encode_packs(docs, path, b"").collect()
    assert size < sum(len(p["frames"]) for p in alone)
    with pytest.raises(ValueError, match="needs dictionary"):
        token_files.Reader(b"", 2).check(packs[0]["dictionary_sha256"])


def test_empty_table(spark, docs):
    folder = scratch_path(spark, "tokens")
    token_files.write_tokens(docs.where("false"), folder)
    assert token_files.read_tokens(spark, folder).count() == 0 and token_files.digests(spark, folder).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
