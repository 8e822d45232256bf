"""Each operator against brute force, on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tickloom.llm import common, components, decontamination, fingerprints, mixing, quality, repeats, secret_scan, sharding, simhash, substring_dedup, suffix_dedup, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, size string, block string, copies string"


def words(n, seed):
    rng = random.Random(seed)
    return [rng.choice(["alpha", "beta", "the", "of", "gamma", "delta"]) + str(rng.randrange(400)) for _ in range(n)]


PASSAGE = " ".join(words(70, 1))
ROWS = [
    (1, PASSAGE), (2, "intro " + PASSAGE + " end"), (3, PASSAGE), (3, PASSAGE), (4, None), (5, ""), (6, " \n\t "), (7, "one two"),
    (8, " ".join(words(3000, 2))), (9, "lead " + " ".join(words(3000, 2)[400:900]) + " tail"), (None, PASSAGE), (None, None),
    (10, "ñandú ÉTÉ 日本語 😀 " * 30), (11, "ñandú ÉTÉ 日本語 😀 " * 30), (12, "\0" * 120), (13, "a b " * 100), (14, "a b " * 90), (3, "other text of a repeated id"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en" if d and d % 2 else None, f"src{(d or 0) % 3}" if d != 7 else None, len(t or ""), 5, "x", "y", "z") for d, t in ROWS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


@pytest.fixture(autouse=True)
def small_pieces(monkeypatch):
    """Many chunks, buckets and tasks even on small tables."""
    monkeypatch.setattr(common.pack_chunks, "__defaults__", (4000,))
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 5000)
    monkeypatch.setattr(simhash, "VARIANTS_PER_TASK", 20_000)
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 3000)


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def removed(symbols, doc_ids, window):
    """Flags of removed symbols for each document, window by window."""
    first = {}
    for s, d in zip(symbols, doc_ids):
        if d is not None:
            for i in range(len(s) - window + 1):
                key = tuple(s[i : i + window])
                first[key] = min(first.get(key, d), d)
    out = []
    for s, d in zip(symbols, doc_ids):
        gone = [False] * len(s)
        if d is not None:
            for i in range(len(s) - window + 1):
                if first[tuple(s[i : i + window])] < d:
                    gone[i : i + window] = [True] * window
        out.append(gone)
    return out


def test_substring_dedup(docs, nothing):
    split = [re.findall(r"[^ \t-\r]+", t or "") for _, t in ROWS]
    gone = removed(split, [d for d, _ in ROWS], 50)
    want = [(d, len(s), sum(g), hashlib.sha256(" ".join(w for w, x in zip(s, g) if not x).encode()).hexdigest()) for (d, _), s, g in zip(ROWS, split, gone)]
    found = substring_dedup.repeated_windows(docs)
    assert tuples(found, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=str)
    assert sum(w[2] for w in want) > 600
    assert substring_dedup.repeated_windows(nothing).count() == 0


@pytest.mark.parametrize("hot", [20_000, 2])
def test_suffix_dedup(docs, nothing, hot):
    data = [(t or "").encode() for _, t in ROWS]
    gone = removed(data, [d for d, _ in ROWS], 50)
    want = []
    for (d, _), s, g in zip(ROWS, data, gone):
        want.append((d, len(s), sum(g), sum(k for k, _ in itertools.groupby(g)), hashlib.sha256(bytes(b for b, x in zip(s, g) if not x)).hexdigest()))
    found = suffix_dedup.repeated_bytes(docs, hot_chunks=hot)
    assert tuples(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=str)
    assert suffix_dedup.repeated_bytes(nothing).count() == 0


def test_loser_tree_merges_with_shared_lengths():
    rng = random.Random(3)
    keys = [sorted(bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(rng.randrange(9))) for _ in range(5)]
    shared = [suffix_dedup._shared(np.frombuffer(b"".join(k), np.uint8).reshape(-1, 12)).tolist() for k in keys]
    at, out, last = [0] * 5, [], b""
    for run, same in suffix_dedup.LoserTree(keys, shared).merge():
        key = keys[run][at[run]]
        at[run] += 1
        if out:
            assert same == next((i for i in range(12) if key[i] != last[i]), 12)
        out.append(key)
        last = key
    assert out == sorted(itertools.chain(*keys))


def test_token_counts(docs, nothing):
    from tokenizers import Tokenizer, models, normalizers
    import sentencepiece

    vocabulary = token_counts.read_vocabulary()
    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.PIECES)
    exact = Tokenizer(models.Unigram([(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], unk_id=0, byte_fallback=True))
    exact.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    count = lambda t: len(exact.encode(t, add_special_tokens=False).ids) if t else 0
    assert tuples(token_counts.token_counts(docs, vocabulary), "doc_id", "n_tokens") == sorted(((d, count(t)) for d, t in ROWS), key=str)
    whole = token_counts.Counter(vocabulary)
    whole.cut = None
    for text in ("", "  a  b", "\n\n x\ty", "<0x41> </s>", " " * 40 + "x", "▁a"):
        assert whole.count(text) == token_counts.Counter(vocabulary).count(text) and whole.count(text)[0] == count(text)
    assert token_counts.token_counts(nothing, vocabulary).count() == 0


def test_simhash_components(docs, nothing, spark):
    def fingerprint(text):
        w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    prints = [fingerprint(t) for _, t in ROWS]
    root = list(range(len(ROWS)))
    for _ in ROWS:
        for i, j in itertools.combinations(range(len(ROWS)), 2):
            same = ROWS[i][0] is not None and ROWS[i][0] == ROWS[j][0]
            if (prints[i] ^ prints[j]).bit_count() <= 4 or same:
                root[i] = root[j] = min(root[i], root[j])
    least = {r: min((d for (d, _), x in zip(ROWS, root) if x == r and d is not None), default=None) for r in root}
    want = [(d, f"{p:016x}", least[r]) for (d, _), p, r in zip(ROWS, prints, root)]
    assert tuples(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == sorted(want, key=str)
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == sorted({c for _, _, c in want if c is not None})


def test_ball_hashing_finds_all_links(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(6))) for b in base for _ in range(8)}
    nodes = dict(enumerate(sorted(prints)))
    df = spark.createDataFrame([(i, common.sixty_four(p)) for i, p in nodes.items()], "node long, fp long")
    got = {tuple(r) for r in components.components(simhash.links(df)).collect()}
    label = {i: i for i in nodes}
    changed = True
    near = [(i, j) for i, j in itertools.combinations(nodes, 2) if (nodes[i] ^ nodes[j]).bit_count() <= 4]
    while changed:
        changed = False
        for i, j in near:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    assert got == {(i, label[i]) for pair in near for i in pair}


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(20, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 20 for i in range(20, 61)}, **{i: 100 for i in range(100, 150)}}


def test_min_cost_flow_is_least(spark):
    cost = [[int(i != j) * (1 + (i * j) % 3) for j in range(3)] for i in range(3)]
    supply, capacity = [7, 0, 3], [2, 5, 4]
    flow = sharding.min_cost_flow(supply, capacity, cost)
    assert [sum(r) for r in flow] == supply and all(sum(c) <= k for c, k in zip(zip(*flow), capacity))
    price = lambda f: sum(cost[i][j] * f[i][j] for i in range(3) for j in range(3))
    splits = lambda n: [(a, b, n - a - b) for a in range(n + 1) for b in range(n + 1 - a)]
    best = min(price(f) for f in itertools.product(*(splits(s) for s in supply)) if all(sum(c) <= k for c, k in zip(zip(*f), capacity)))
    assert price(flow) == best
    with pytest.raises(ValueError):
        sharding.min_cost_flow([5], [4], [[0]])


def test_sharding(docs, nothing, tmp_path, spark):
    rows = sharding.assignment(docs, sharding.by_source()).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in ROWS)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and {r.law for r in rows} == {"bytes"} and all(0 <= r.shard < 16 for r in rows)
    assert sharding.assignment(nothing, sharding.by_source()).count() == 0
    even = spark.range(3000).selectExpr("id AS doc_id", "repeat('x', cast(id % 50 AS int)) AS text", "if(id % 3 = 0, 'hot', cast(id % 40 AS string)) AS source")
    placed = sharding.place(even, sharding.by_source())
    sizes = [r[1] for r in placed.groupBy("_shard").agg({"_size": "sum"}).collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 0.02 * sum(sizes) / 16 + 51
    root = str(tmp_path / "shards")
    even.withColumn("shard", sharding.by_source()).write.partitionBy("shard").parquet(root)
    sharding.rewrite(placed, root)
    again = spark.read.parquet(root)
    assert Counter(r.shard for r in again.collect()) == Counter(r._shard for r in placed.collect())


def test_mixing(docs, nothing):
    mix = mixing.default_mix()
    out = mixing.apply(docs, mix)
    plan = mixing.plan(docs, mix).collect()
    tokens = sum(len(re.findall(r"[^ \t-\r]+", t or "")) for _, t in ROWS)
    assert sum(p.tokens for p in plan) == tokens and sum(p.budget for p in plan) <= tokens and all(p.budget <= 2 * p.tokens for p in plan)
    taken = Counter()
    for r in out.collect():
        taken[r._domain, r._lang, r._source] += r._copies * len(re.findall(r"[^ \t-\r]+", r.text or ""))
    assert all(taken[p.domain, p.lang, p.source] <= p.budget for p in plan)
    assert set(docs.columns) <= set(out.columns) and out.count() == len(ROWS)
    assert mixing.mixed(docs, mix).columns == docs.columns
    assert mixing.mixed(nothing, mix).count() == 0


def test_shortages_go_to_siblings_first(spark):
    from pyspark.sql import functions as F

    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 500), ("a", "y", "3", 500), ("b", "x", "4", 1000)], "domain string, lang string, source string, tokens long")
    one = F.lit(1).cast("long")
    mix = mixing.Mix(F.lit(""), one, one, one, (2, 5), 1)
    got = {r.source: r.budget for r in mixing.leaf_budgets(leaves, mix).collect()}
    assert got == {"1": 10, "2": 191, "3": 201, "4": 402}  # 804 of 2010: what source 1 lacks goes to source 2 alone


def test_document_fingerprints(docs, nothing, spark):
    order = sorted(((d, t or "") for d, t in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for i, (d, t) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        new = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        a, b, c = (fingerprints.fingerprint(x) for x in (t, new, following))
        want.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), fingerprints.to_hex(a), fingerprints.to_hex(b), fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
    got = fingerprints.edit_report(docs)
    assert tuples(got, *got.columns) == sorted(want, key=str)
    assert fingerprints.edit_report(nothing).count() == 0
    assert fingerprints.document_fingerprints(nothing).count() == 0


def test_fingerprints_are_multiset_homomorphisms():
    a = fingerprints.fingerprint("one\ntwo\ntwo\n\nthree")
    assert a == fingerprints.fingerprint("three\ntwo\none\ntwo") != fingerprints.fingerprint("one\ntwo\nthree")
    assert fingerprints.delete(a, ["two"]) == fingerprints.fingerprint("one\ntwo\nthree") and fingerprints.insert(fingerprints.fingerprint(""), ["one", "two", "two", "three"]) == a
    assert fingerprints.likeness(a, a) == 1.0 and 0 < fingerprints.likeness(a, fingerprints.insert(a, ["four"])) < 1


def test_decontamination(spark, nothing, sf):
    items = [(1, PASSAGE[:300]), (2, None), (3, ""), (4, " ".join(words(40, 9)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    changed = words(40, 9)
    changed[3:9] = ["swapped"] * 6
    rows = [(1, "x " + PASSAGE), (2, " ".join(words(800, 11)) + " " + " ".join(changed) + " " + " ".join(words(50, 12))), (3, " ".join(words(500, 13))), (4, None), (5, ""), (None, PASSAGE)]
    rare = [(100 + i, " ".join(w + "x" for w in words(60, 100 + i))) for i in range(60)]
    got = decontamination.leaks(spark.createDataFrame(rows + rare, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 4), (None, 1)}
    assert decontamination.leaks(nothing, bench).count() == 0
    kept = decontamination.keep_clean(spark.createDataFrame(rows + rare, "doc_id long, text string"), bench)
    assert {r.doc_id for r in kept.collect()} == {3, 4, 5, *(i for i, _ in rare)}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    plain = lambda t: " ".join(re.split(r"[\s.,;:!?\"'()\[\]*|]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))).strip()
    texts = {r.doc_id: f" {plain(r.text)} " for r in docs.collect()}
    want = {(d, r.item_id) for r in bench.collect() for d, t in texts.items() if f" {plain(r.text)} " in t}
    assert want and {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()} == want


def test_passages_of_common_words_beside_rare_ones(spark):
    draw = random.Random(8)
    common_words = [f"w{i}" for i in range(100)]
    items = [(i, " ".join(draw.choices(common_words, k=40))) for i in range(30)]
    items += [(100 + i, " ".join(f"rare{draw.randrange(10**6)}" for _ in range(40))) for i in range(30)]
    rows = []
    for i, text in items[:30]:
        alien = [f"alien{draw.randrange(10**6)}" for _ in range(60)]
        of_index = draw.choice(items[30:])[1].split()[:15]  # rare words that another passage has, too few for a leak
        rows += [(i, " ".join([*alien[:30], text, *alien[30:]])), (50 + i, " ".join([*of_index, text, *of_index]))]
    rows += [(1000 + i, " ".join(draw.choices(common_words, k=300))) for i in range(200)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()}
    assert found == {(d, i) for d, t in rows for i, x in items if f" {x} " in f" {t} "}


def test_the_decomposition_leaves_directions_out_but_no_passage():
    rng = np.random.default_rng(4)
    rows = decontamination._unit(np.abs(rng.standard_normal((120, 12)) @ rng.standard_normal((12, 400)) + 0.6 * rng.standard_normal((120, 400))).astype(np.float32))
    vectors = decontamination.directions(rows)
    assert vectors.shape[1] < 100 and np.linalg.matrix_rank(rows) == 120
    assert np.allclose(vectors.T @ vectors, np.eye(vectors.shape[1]), atol=1e-3)
    assert ((rows @ vectors) ** 2).sum(axis=1).min() >= decontamination.FAITHFUL - 1e-3
    alone = np.eye(40, dtype=np.float32)  # passages without a common word: some directions go, their passages get them back
    assert ((alone @ decontamination.directions(alone)) ** 2).sum(axis=1).min() >= decontamination.FAITHFUL - 1e-3


def test_paraphrases_with_their_answers_are_found_whatever_was_left_out(spark):
    draw = random.Random(12)
    shared = [f"s{i}" for i in range(60)]
    items, rows = [], []
    for i in range(80):
        words = [draw.choice(shared) if draw.random() < 0.5 else f"own{i}x{k}" for k in range(30)]
        items.append((i, " ".join(words) + f". The answer is number{i} here"))
        swapped = [w if draw.random() < 0.7 else draw.choice(shared) for w in words]
        rows.append((i, " ".join([*draw.choices(shared, k=20), *swapped]) + f". The answer is number{i} here"))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()}
    assert found >= {(i, i) for i in range(80)}


def test_all_exact_passages_of_a_larger_table(spark, sf):
    folder = sf.replace("sf0.001", "sf0.1")
    docs, bench = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    plain = lambda t: " " + " ".join(re.split(r"[\s.,;:!?\"'()\[\]*|]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))).strip() + " "
    items = [(r.item_id, plain(r.text)) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for t in [plain(r.text)] for i, x in items if x in t}
    assert want and want <= {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()}


def test_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        best = max(n for n in range(len(a) + 1) for pick in itertools.combinations(a, n) if _is_subsequence(pick, b))
        assert decontamination.common_words(a, b) == best


def _is_subsequence(part, whole):
    rest = iter(whole)
    return all(x in rest for x in part)


def brute_kneser_ney(counts):
    """p of every order-4 gram (a tuple) by the textbook recursion; counts: gram -> occurrences in training text."""
    levels = [{g: c for g, c in counts.items() if c}]
    for _ in range(quality.ORDER - 1):
        below = Counter(g[1:] for g in levels[-1])
        levels.append(dict(below))
    tables = []
    for level in reversed(levels):
        n = [sum(c == i for c in level.values()) for i in (1, 2, 3, 4)]
        if min(n) > 0:
            y = n[0] / (n[0] + 2 * n[1])
            d = [min(float(i), max(0.05, i - (i + 1) * y * n[i] / n[i - 1])) for i in (1, 2, 3)]
        else:
            d = [0.5, 0.75, 1.0]
        total, kinds = Counter(), defaultdict(lambda: [0, 0, 0])
        for g, c in level.items():
            total[g[:-1]] += c
            kinds[g[:-1]][min(c, 3) - 1] += 1
        tables.append((level, d, total, kinds))

    def p(gram, width=quality.ORDER):
        level, d, total, kinds = tables[width - 1]
        gram, context = gram[-width:], gram[-width:-1]
        if width == 1:
            rest = sum(x * k for x, k in zip(d, kinds[()])) / total[()] / (sum(kinds[()]) + 1)
        else:
            rest = p(gram, width - 1)
            if not total[context]:
                return rest
            rest *= sum(x * k for x, k in zip(d, kinds[context])) / total[context]
        c = level.get(gram, 0)
        return (max(c - d[min(c, 3) - 1], 0) / total[context] if c else 0.0) + rest

    return p


def grams(text):
    padded = chr(quality.START) * (quality.ORDER - 1) + text
    return [tuple(padded[i : i + quality.ORDER]) for i in range(len(text))]


def test_perplexities_and_limits_match_a_brute_force_model(spark, monkeypatch):
    monkeypatch.setattr(quality, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(quality, "CHUNK_BYTES", 1500)
    rng = random.Random(12)
    draw = lambda lang: " ".join("".join(rng.choices("abcdeéß😀" if lang == "de" else "abcxyz", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 25)))
    rows = [(i, lang, draw(lang)) for i, lang in enumerate(rng.choice(["en", "de", "XX", None, "fr"]) for _ in range(150))]
    rows += [(200, "en", ""), (201, "de", None), (None, "en", "abc"), (3, "en", "a repeated id")]
    kinds = {i: (rng.choice([0, 1, 1]), rng.choice([0, 0, 1])) for i in range(0, 150, 2) if rows[i][1] != "fr"}  # French has no training text
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, lang string, text string, gram int")
    labels = spark.createDataFrame([(i, *k) for i, k in kinds.items()], "doc_id long, quality int, toxic int")
    folds = {r[0]: r[1] for r in labels.selectExpr("doc_id", f"pmod(xxhash64(doc_id), {quality.FOLDS}) AS fold").collect()}
    code = lambda lang: lang if lang in ("en", "de", "fr") else "other"
    good, bad = defaultdict(Counter), defaultdict(Counter)
    for i, lang, text in rows:
        if i in kinds and folds[i] > 0:
            if kinds[i][1]:
                bad[code(lang)].update(set(grams(text)))
            elif kinds[i][0]:
                good[code(lang)].update(grams(text))
    fold = lambda g: tuple(chr(ord(c) if ord(c) < 0x10000 else 0xE000 + ord(c) % 6400) for c in g)
    models = {lang: brute_kneser_ney(Counter({fold(g): n for g, n in c.items()})) for lang, c in good.items()}
    toxic = {lang: (brute_kneser_ney(Counter({fold(g): n for g, n in c.items()})), {fold(g) for g in c}) for lang, c in bad.items()}
    got = defaultdict(list)
    for r in quality.perplexities(docs, labels).collect():
        got[r.doc_id, r.n_chars].append(r)
    for i, lang, text in rows:
        r = got[i, len(text or "")].pop()
        assert r.lang == code(lang)
        if not text or code(lang) not in models:
            assert r.nll is None
            continue
        p = [models[code(lang)](fold(g)) for g in grams(text)]
        assert r.nll == pytest.approx(-sum(map(math.log, p)), rel=1e-5)
        gains = [math.log(toxic[code(lang)][0](fold(g)) / x) if fold(g) in toxic[code(lang)][1] else 0.0 for g, x in zip(grams(text), p)]
        assert r.gain == pytest.approx(quality._largest_word(np.array(gains), text), abs=1e-4)
    judged = [r for r in quality.classify(docs, labels).collect() if r.lang == "en" and r.perplexity is not None]
    held = [math.log(r.perplexity) for r in judged if r.doc_id in kinds and kinds[r.doc_id] == (1, 0) and folds[r.doc_id] == 0]
    limits = {r.limit for r in judged}
    assert len(limits) == 1 and math.log(limits.pop()) >= max(held) - 1e-9  # a high quantile of the few held out, and some more


def test_probabilities_of_a_context_sum_to_one(spark):
    text = "abracadabra abra cadabra"
    values = quality.grams_of(text)
    seen = Counter(values.tolist())
    every = [int(g) for g in values] + [(int(values[9]) >> 16 << 16 | ord(c)) & (1 << 64) - 1 for c in set(text) | {"z"}]
    rows = [("en", common.sixty_four(g), seen.get(g, 0), 0) for g in set(every)]
    found = quality.gram_probabilities(spark.createDataFrame(rows, "lang string, gram long, c1 long, c2 long")).collect()
    context = int(values[9]) >> 16
    assert abs(sum(r.p1 for r in found if (r.gram & (1 << 64) - 1) >> 16 == context) - 1) < 1e-9  # all symbols and one unseen
    assert all(r.p2 is None for r in found)


def test_quality_classifier(spark, docs, nothing, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged = quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels).collect()
    kind = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    junk = [r.rejected for r in judged if kind.get(r.doc_id, (1, 0))[0] == 0]
    clean = [r.rejected for r in judged if kind.get(r.doc_id) == (1, 0)]
    assert sum(junk) >= 0.9 * len(junk) and sum(clean) <= 0.05 * len(clean)
    odd = quality.classify(docs, labels).collect()
    assert len(odd) == len(ROWS) and not any(r.rejected for r in odd if r.n_chars == 0)
    assert quality.classify(nothing, labels).count() == 0
    assert quality.keep_good(docs, labels.where("false")).count() == len(ROWS)  # no trusted text: all stay


def test_few_toxic_words_in_good_text_are_enough(spark, sf):
    draw = random.Random(5)
    syllables = ["the", "an", "ing", "er", "ou", "re", "st", "on", "ha", "ti"]
    rows, kinds = [], []
    for i in range(400):
        words = ["".join(draw.choices(syllables, k=draw.randint(1, 3))) for _ in range(draw.randint(30, 300))]
        toxic = i % 4 == 0
        for _ in range(2 if toxic else 0):
            words.insert(draw.randrange(len(words)), draw.choice(["zugblim", "kwoffle"]))
        rows.append((i, "en", " ".join(words)))
        if i < 300:  # the others are judged without a label
            kinds.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame(kinds, "doc_id long, quality int, toxic int")
    judged = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert all(judged[i].rejected for i in range(0, 400, 4))
    assert sum(judged[i].rejected for i in range(400) if i % 4) <= 6
    assert not any(r.toxic_gain > r.toxic_limit for r in quality.classify(docs, labels.where("toxic = 0")).collect())  # no toxic text
    both = labels.union(spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 4)], labels.schema))
    assert not any(r.toxic_gain > r.toxic_limit for r in quality.classify(docs, both).collect())  # conflicting labels train nothing


def test_largest_word_matches_brute_force():
    draw = random.Random(6)
    for _ in range(200):
        text = "".join(draw.choices("ab \t\n", k=draw.randint(1, 30)))
        gains = np.array([draw.randint(-9, 9) for _ in text], float)
        sums, at = [0.0], 0
        for i, c in enumerate(text):
            sums[at] += gains[i]
            if c in " \t\n" and i + 1 < len(text):
                sums.append(0.0)
                at += 1
        assert quality._largest_word(gains, text) == max(sums)


def test_secret_scan(spark, docs, nothing, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet".replace("sf0.001", "sf0.01"))
    found = {(r.doc_id, r.start, r.stop) for r in secret_scan.scan_secrets(table).collect()}
    known = re.compile(r"AKIA[0-9A-Z]{16}|(?<=token = \")[0-9a-f]{40}|(?<=password=)[0-9a-f]{18}")
    want = {(r.doc_id, m.start(), m.end()) for r in table.collect() for m in known.finditer(r.text)}
    assert want and len(found & want) >= 0.9 * len(want) and len(found - want) <= 0.1 * len(want)
    assert secret_scan.scan_secrets(nothing).count() == 0
    assert all(r.probability is None for r in secret_scan.scan_secrets(docs).collect())


def test_forest_on_held_out_findings(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet".replace("sf0.001", "sf0.01"))
    cut = table.selectExpr("doc_id % 2 AS half", "doc_id", "text", "source")
    findings = secret_scan.candidates(cut, "source", *secret_scan.corpus_tables(cut)).where("label IS NOT NULL").select("doc_id", "start", "label").collect()
    train = spark.createDataFrame([(r.doc_id, r.start, r.label) for r in findings if r.doc_id % 2], "doc_id long, start int, is_secret int")
    kept = {(r.doc_id, r.start) for r in secret_scan.scan_secrets(cut, labels=train).collect()}
    held = [r for r in findings if not r.doc_id % 2]
    right = sum(((r.doc_id, r.start) in kept) == bool(r.label) for r in held)
    assert right >= 0.98 * len(held)
