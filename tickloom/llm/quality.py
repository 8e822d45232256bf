"""Quality by the perplexity of an interpolated modified Kneser-Ney model of trusted text.

The model is of order four over characters (16-bit symbols, so that a gram is one long; code points above the
basic plane fold into the private area), one model per language, trained on the documents that the labels
call good and not toxic, but for one fold in five, by a hash of doc_id, which sets the limits. Each chunk of documents
sends its distinct grams, with the counts of those in training text, as sorted runs by bucket of a uniform hash;
a gram is there once per chunk, whatever its frequency. The buckets sum the counts of distinct grams into one table;
continuation counts, context totals, discounts and probabilities follow level by level, both models side by side, each
level written before the next. A bucket then answers every run with the logarithms of its grams, and the chunks sum them
for each document.

A document is rejected if its perplexity is above the limit of its language: a high quantile of the
perplexities of the trusted documents held out plus ``slack`` times the distance from the median to that quantile. A short text
counts ``PRIOR`` characters of its language's median besides its own, as few characters say little.

Perplexity is a mean, in which the few words that make a good text toxic are lost. So a second model of the same
kind is trained on the documents labelled toxic, each of which counts a gram once. A word's gain is the logarithm
of its probability under this model over that under the trusted one, summed over the grams that toxic documents
have; a document is also rejected if its largest gain is above ``TOXIC_SLACK`` times the high quantile of the
trusted documents held out.

Defined cases: a null or empty text has no perplexity and is kept; so is a text of a language without trusted
text, and without toxic text no word has a gain; languages that aren't two or three letters, and null, are one language "other"; a null doc_id is never
trusted; a doc_id with conflicting labels is neither trusted nor toxic; repeated rows are scored each; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import repeats as R
from tickloom.llm.common import chunk_table, plain_columns, scan_chunks, scan_with_notes, stored, text_bytes

ORDER = 4
START = 2
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 24 << 20  # text bytes for each bucket of grams
PRIOR = 200
QUANTILE = 0.99
SLACK = 1.0
TOXIC_SLACK = 2.0
FOLDS = 5


def grams_of(text: str) -> np.ndarray:
    """The packed gram that ends at each character."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    codes = np.where(codes < 0x10000, codes, np.uint64(0xE000) + codes % np.uint64(6400))
    padded = np.r_[np.full(ORDER - 1, START, np.uint64), codes]
    out = np.zeros(len(codes), np.uint64)
    for i in range(ORDER):
        out = (out << np.uint64(16)) | padded[i : i + len(codes)]
    return out


def _language(name: str | None) -> str:
    return name if name and 2 <= len(name) <= 3 and name.isascii() and name.isalpha() and name.islower() else "other"


def _by_language(table: pa.Table) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for row, name in enumerate(table["lang"].to_pylist()):
        out.setdefault(_language(name), []).append(row)
    return out


def _labelled(labels: DataFrame) -> DataFrame:
    """doc_id, toxic and fold of the documents that train the two models or set their limits."""
    one = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    one = one.agg(F.min("quality").alias("q"), F.min("toxic").alias("least"), F.max("toxic").alias("t"))
    kinds = one.where("least = 1 OR (q = 1 AND t = 0)")
    return kinds.select("doc_id", (F.col("t") == 1).alias("toxic"), F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).alias("fold"))


def _bucketed(grams: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of grams, ranges of a uniform hash, and the order by bucket that keeps the order inside each."""
    bucket = ((R.mix(grams) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    return bucket, np.argsort(bucket, kind="stable")


def _distinct(texts: list[str]) -> np.ndarray:
    return R.sorted_distinct(np.concatenate([grams_of(t) for t in texts])) if texts else np.zeros(0, np.uint64)


def _count(chunk: int, table: pa.Table, notes: pa.Table, buckets: int) -> pa.Table:
    """A chunk's distinct grams as a sorted run for each language and bucket, with the places and counts of those in training text."""
    texts = table["text"].to_pylist()
    kind = dict(zip(notes["row"].to_pylist(), notes["toxic"].to_pylist()))
    out: list[tuple] = []
    for name, rows in _by_language(table).items():
        values = _distinct([texts[r] for r in rows if texts[r]])
        if not len(values):
            continue
        count = np.zeros((len(values), 2), np.int64)
        for column, toxic in enumerate((False, True)):
            used = [grams_of(texts[r]) for r in rows if texts[r] and kind.get(r) is toxic]
            if used:
                seen, n = np.unique(np.concatenate([R.sorted_distinct(g) for g in used] if toxic else used), return_counts=True)
                count[np.searchsorted(values, seen), column] = n
        bucket, order = _bucketed(values, buckets)
        values, count, bucket = values[order], count[order], bucket[order]
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        for a, z in zip(first.tolist(), [*first[1:].tolist(), len(values)]):
            at = np.flatnonzero(count[a:z].any(axis=1))
            out.append((name, int(bucket[a]), chunk, R.pack_sorted(values[a:z]), at.astype("<i4").tobytes(), count[a:z][at].astype("<i8").tobytes()))
    kinds = (("lang", pa.string()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("run", pa.binary()), ("places", pa.binary()), ("counts", pa.binary()))
    return pa.table({n: pa.array([r[i] for r in out], k) for i, (n, k) in enumerate(kinds)})


def _sum_counts(table: pa.Table) -> pa.Table:
    """The counts of a bucket's distinct grams over all chunks."""
    parts = [R.unpack_sorted(b) for b in table["run"].to_pylist()]
    starts = np.cumsum([0, *map(len, parts)])
    values, back = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.zeros((len(values), 2), np.int64)
    for start, places, counts in zip(starts.tolist(), table["places"].to_pylist(), table["counts"].to_pylist()):
        np.add.at(total, back[start + np.frombuffer(places, "<i4")], np.frombuffer(counts, "<i8").reshape(-1, 2))
    n = len(values)
    return pa.table({"lang": pa.array([table["lang"][0].as_py()] * n, pa.string()), "bucket": pa.array(np.full(n, table["bucket"][0].as_py(), np.int32)),
                     "gram": pa.array(values.view(np.int64)), "c1": pa.array(total[:, 0]), "c2": pa.array(total[:, 1])})


MODELS = (1, 2)  # of trusted and of toxic text, side by side in one table


def _discounts(level: DataFrame) -> DataFrame:
    """Per language and model, the discounts of grams seen once, twice and more, from the counts of counts."""
    kinds = level.groupBy("lang").agg(*[F.sum((F.col(f"c{m}") == i).cast("long")).cast("double").alias(f"n{m}{i}") for m in MODELS for i in (1, 2, 3, 4)])
    out = []
    for m in MODELS:
        n = [F.col(f"n{m}{i}") for i in (1, 2, 3, 4)]
        y = F.try_divide(n[0], n[0] + 2 * n[1])
        for i in (1, 2, 3):
            d = F.least(F.lit(float(i)), F.greatest(F.lit(0.05), i - (i + 1) * y * F.try_divide(n[i], n[i - 1])))
            out.append(F.when(F.least(*n) > 0, d).otherwise(F.lit(0.5 + 0.25 * (i - 1))).alias(f"d{m}{i}"))
    return kinds.select("lang", *out)


def _interpolate(level: DataFrame, lower: DataFrame | None, width: int) -> DataFrame:
    """``level``, the counts c1 and c2 of grams of ``width`` symbols, with their probabilities p1 and p2, from those of ``width - 1``.

    A model without any count in a language has no probabilities there.
    """
    prefix = F.shiftrightunsigned("gram", 16)
    sums = [F.sum(f"c{m}").alias(f"total{m}") for m in MODELS]
    sums += [F.sum(test.cast("long")).alias(f"k{m}{i}") for m in MODELS for i, test in enumerate((F.col(f"c{m}") == 1, F.col(f"c{m}") == 2, F.col(f"c{m}") >= 3), 1)]
    context = level.groupBy("lang", prefix.alias("prefix")).agg(*sums)
    joined = level.withColumn("prefix", prefix).join(context, ["lang", "prefix"]).join(F.broadcast(_discounts(level)), "lang")  # a row per language code of up to three letters
    if lower is not None:
        below = lower.select(F.col("lang"), F.col("gram").alias("suffix"), *[F.col(f"p{m}").alias(f"below{m}") for m in MODELS])
        joined = joined.withColumn("suffix", _suffix(width - 1)).join(below, ["lang", "suffix"])
    found = {}
    for m in MODELS:
        c, total, (k1, k2, k3), (d1, d2, d3) = F.col(f"c{m}"), F.col(f"total{m}"), (F.col(f"k{m}{i}") for i in (1, 2, 3)), (F.col(f"d{m}{i}") for i in (1, 2, 3))
        off = F.when(c == 1, d1).when(c == 2, d2).otherwise(d3)
        own = F.when(c > 0, F.try_divide(F.greatest(c - off, F.lit(0.0)), total)).otherwise(0.0)
        gamma = F.try_divide(d1 * k1 + d2 * k2 + d3 * k3, total.cast("double"))
        # The context of single symbols is empty: what is left is spread over all symbols and one unseen.
        rest = gamma / (k1 + k2 + k3 + 1) if lower is None else gamma * F.col(f"below{m}")
        found[f"p{m}"] = F.when(total > 0, own + rest) if lower is None else F.when(total > 0, own + rest).otherwise(F.col(f"below{m}"))
    return joined.select(*level.columns, *[p.alias(n) for n, p in found.items()])


def _suffix(width: int):
    return F.col("gram").bitwiseAND(F.lit((1 << 16 * width) - 1))


def gram_probabilities(counted: DataFrame) -> DataFrame:
    """``counted`` (lang, gram, c1, c2 for distinct grams, more columns may follow) with p1 and p2.

    Each level is written before the next reads it, so no plan holds more than a level's own few joins.
    """
    levels = [counted]
    for width in range(ORDER - 1, 0, -1):  # continuation counts: how many symbols come before
        above = levels[-1]
        fewer = above.groupBy("lang", _suffix(width).alias("gram")).agg(*[F.sum((F.col(f"c{m}") > 0).cast("long")).alias(f"c{m}") for m in MODELS])
        levels.append(stored(fewer, "gram-level"))
    p = None
    for width, level in enumerate(reversed(levels), 1):
        p = stored(_interpolate(level, p, width), "gram-probabilities")
    return p


def _reply(runs: pa.Table, known: pa.Table) -> pa.Table:
    """For each run of a bucket its logarithms and gains, in its own order."""
    gram = known["gram"].to_numpy().view(np.uint64)
    order = np.argsort(gram)
    gram, logp, gain = gram[order], *(known[c].to_numpy(zero_copy_only=False).astype(np.float32)[order] for c in ("logp", "gain"))
    at = [np.searchsorted(gram, R.unpack_sorted(b)) for b in runs["run"].to_pylist()]
    return pa.table({"chunk": runs["chunk"], "lang": runs["lang"], "bucket": runs["bucket"], "logs": pa.array([logp[i].tobytes() for i in at], pa.binary()), "gains": pa.array([gain[i].tobytes() for i in at], pa.binary())})


def _largest_word(gains: np.ndarray, text: str) -> float:
    """The largest sum of gains over a word and the white space after it."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    after = np.flatnonzero((codes[:-1] == 32) | ((codes[:-1] >= 9) & (codes[:-1] <= 13))) + 1
    return float(np.add.reduceat(gains, np.r_[0, after]).max())


def perplexities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, key (hash of the text), n_chars, nll (sum of negative logarithms; null without a model) and gain (a word's largest) of every row."""
    slim = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"), F.xxhash64("text").alias("key"))
    size = text_bytes(slim)
    buckets = max(1, size // BUCKET_BYTES)
    chunks = chunk_table(slim, ["doc_id", "lang", "text", "key"], size, CHUNK_BYTES)

    def places(chunk: int, table: pa.Table) -> pa.Table:
        n = table.num_rows
        return pa.table({"doc_id": table["doc_id"], "chunk": pa.array(np.full(n, chunk, np.int64)), "row": pa.array(np.arange(n, dtype=np.int32))})

    good = scan_chunks(chunks, places, "doc_id long, chunk long, row int").join(_labelled(labels).where("fold > 0"), "doc_id").select("chunk", "row", "toxic")
    counting = lambda chunk, table, notes: _count(chunk, table, notes, buckets)
    runs = stored(scan_with_notes(chunks, good, counting, "lang string, bucket int, chunk long, run binary, places binary, counts binary"), "gram-runs")
    counted = stored(runs.groupBy("lang", "bucket").applyInArrow(_sum_counts, "lang string, bucket int, gram long, c1 long, c2 long"), "gram-counts")
    gain = F.when(F.col("c2") > 0, F.coalesce(F.log("p2") - F.log("p1"), F.lit(0.0))).otherwise(0.0)
    known = gram_probabilities(counted).select("lang", "bucket", "gram", F.log("p1").cast("float").alias("logp"), gain.cast("float").alias("gain"))
    replies = runs.select("lang", "bucket", "chunk", "run").groupBy("lang", "bucket").cogroup(known.groupBy("lang", "bucket"))
    replies = replies.applyInArrow(_reply, "chunk long, lang string, bucket int, logs binary, gains binary")

    def score(chunk: int, table: pa.Table, notes: pa.Table) -> pa.Table:
        texts = table["text"].to_pylist()
        nll: list[float | None] = [None] * len(texts)
        largest: list[float | None] = [None] * len(texts)
        given: dict[str, list[tuple]] = {}
        for row in zip(*(notes[c].to_pylist() for c in ("lang", "bucket", "logs", "gains"))):
            given.setdefault(row[0], []).append(row[1:])
        for name, rows in _by_language(table).items():
            values = _distinct([texts[r] for r in rows if texts[r]])
            if not len(values):
                continue
            _, order = _bucketed(values, buckets)
            logp, gain = np.zeros(len(values)), np.zeros(len(values))
            for target, column in ((logp, 1), (gain, 2)):
                target[order] = np.concatenate([np.frombuffer(r[column], np.float32) for r in sorted(given[name], key=lambda r: r[0])])
            if np.isnan(logp).all():
                continue
            for r in rows:
                if texts[r]:
                    at = np.searchsorted(values, grams_of(texts[r]))
                    nll[r] = float(-logp[at].sum())
                    largest[r] = _largest_word(gain[at], texts[r])
        return pa.table({
            "doc_id": table["doc_id"], "lang": pa.array([_language(x) for x in table["lang"].to_pylist()], pa.string()), "key": table["key"],
            "n_chars": pa.array([len(t or "") for t in texts], pa.int64()), "nll": pa.array(nll, pa.float64()), "gain": pa.array(largest, pa.float64()),
        })

    return scan_with_notes(chunks, replies, score, "doc_id long, lang string, key long, n_chars long, nll double, gain double")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, toxic_slack: float = TOXIC_SLACK) -> DataFrame:
    """doc_id, lang, key, n_chars, perplexity, limit, toxic_gain, toxic_limit and rejected (boolean) of every row."""
    scores = stored(perplexities(docs, labels), "perplexities")
    trusted = scores.join(_labelled(labels).where("fold = 0 AND NOT toxic"), "doc_id", "left_semi").where("nll IS NOT NULL")
    mean = F.col("nll") / F.col("n_chars")
    middle = trusted.groupBy("lang").agg(F.percentile_approx(mean, 0.5, 100_000).alias("middle"))
    shrunk = (F.col("nll") + PRIOR * F.col("middle")) / (F.col("n_chars") + PRIOR)
    middle = F.broadcast(middle)  # a row per language code of up to three letters
    high = trusted.join(middle, "lang").groupBy("lang").agg(F.percentile_approx(shrunk, quantile, 100_000).alias("high"), F.percentile_approx("gain", quantile, 100_000).alias("high_gain"))
    judged = scores.join(middle, "lang", "left").join(F.broadcast(high), "lang", "left")
    limit = F.col("high") + slack * (F.col("high") - F.col("middle"))
    toxic_limit = F.col("high_gain") * toxic_slack
    return judged.select(
        "doc_id", "lang", "key", "n_chars", F.exp(shrunk).alias("perplexity"), F.exp(limit).alias("limit"), F.col("gain").alias("toxic_gain"), toxic_limit.alias("toxic_limit"),
        (F.coalesce(shrunk > limit, F.lit(False)) | F.coalesce(F.col("gain") > toxic_limit, F.lit(False))).alias("rejected"),
    )


def _keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    bad = classify(docs, labels).where("rejected").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    hit = docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & F.xxhash64(docs["text"]).eqNullSafe(F.col("_key"))
    return docs.join(bad, hit, "left_anti")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rejected rows."""
    return plain_columns(docs, lambda plain: _keep_good(plain, labels))
