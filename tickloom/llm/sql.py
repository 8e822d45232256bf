"""DuckDB statements of the queries that SQL can express."""

from __future__ import annotations

SQL = {
    "op1_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 49)) AS i, w FROM d WHERE len(w) >= 50
), h AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS k FROM s
), f AS (
  SELECT k, min(doc_id) AS first_doc FROM h GROUP BY k
), c AS (
  SELECT DISTINCT h.doc_id, j FROM h JOIN f USING (k), unnest(generate_series(i, i + 49)) AS u(j) WHERE first_doc < h.doc_id
), p AS (
  SELECT d.doc_id, j, w[j] AS word FROM d, unnest(generate_series(1, len(w))) AS u(j)
), k AS (
  SELECT p.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY j) AS kept
  FROM p ANTI JOIN c ON p.doc_id = c.doc_id AND p.j = c.j GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
""",
    "op8_source_mixing": r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    'domain' || (coalesce(try_cast(nullif(regexp_extract(source, '([0-9]{1,9})', 1), '') AS BIGINT), 0) % 4) AS domain,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n
  FROM documents
), leaf AS (
  SELECT domain, lang, source, CAST(sum(n) AS BIGINT) AS tokens, CAST(2 * sum(n) AS BIGINT) AS capacity FROM d GROUP BY ALL
), d1 AS (
  SELECT domain, CAST(sum(capacity) AS BIGINT) AS capacity, CAST(substr(domain, 7, 1) AS BIGINT) + 1 AS weight,
    (SELECT CAST(least(sum(tokens), sum(capacity)) AS BIGINT) FROM leaf) AS budget
  FROM leaf GROUP BY domain
), d2 AS (
  SELECT *, CAST(coalesce(sum(capacity) OVER o, 0) AS BIGINT) AS c, CAST(coalesce(sum(weight) OVER o, 0) AS BIGINT) AS w, CAST(sum(weight) OVER () AS BIGINT) AS a FROM d1
  WINDOW o AS (ORDER BY capacity / weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), d3 AS (SELECT *, (budget - c) * weight >= capacity * (a - w) AS full_ FROM d2
), d4 AS (
  SELECT *, CAST(coalesce(sum(capacity) FILTER (full_) OVER (), 0) AS BIGINT) AS fc, CAST(coalesce(sum(weight) FILTER (full_) OVER (), 0) AS BIGINT) AS fw FROM d3
), domains AS (SELECT domain, CASE WHEN full_ THEN capacity ELSE (weight * (budget - fc)) // (a - fw) END AS budget FROM d4
), l1 AS (
  SELECT domain, lang, CAST(sum(capacity) AS BIGINT) AS capacity, CAST(CASE WHEN lang = 'en' THEN 5 WHEN lang IN ('de', 'fr') THEN 2 ELSE 1 END AS BIGINT) AS weight
  FROM leaf GROUP BY domain, lang
), l2 AS (
  SELECT l1.*, budget, CAST(coalesce(sum(capacity) OVER o, 0) AS BIGINT) AS c, CAST(coalesce(sum(weight) OVER o, 0) AS BIGINT) AS w,
    CAST(sum(weight) OVER (PARTITION BY domain) AS BIGINT) AS a FROM l1 JOIN domains USING (domain)
  WINDOW o AS (PARTITION BY domain ORDER BY capacity / weight, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l3 AS (SELECT *, (budget - c) * weight >= capacity * (a - w) AS full_ FROM l2
), l4 AS (
  SELECT *, CAST(coalesce(sum(capacity) FILTER (full_) OVER p, 0) AS BIGINT) AS fc, CAST(coalesce(sum(weight) FILTER (full_) OVER p, 0) AS BIGINT) AS fw FROM l3
  WINDOW p AS (PARTITION BY domain)
), langs AS (SELECT domain, lang, CASE WHEN full_ THEN capacity ELSE (weight * (budget - fc)) // (a - fw) END AS budget FROM l4
), s2 AS (
  SELECT leaf.*, CAST(1 AS BIGINT) AS weight, budget, CAST(coalesce(sum(capacity) OVER o, 0) AS BIGINT) AS c, CAST(coalesce(count(*) OVER o, 0) AS BIGINT) AS w,
    CAST(count(*) OVER (PARTITION BY domain, lang) AS BIGINT) AS a FROM leaf JOIN langs USING (domain, lang)
  WINDOW o AS (PARTITION BY domain, lang ORDER BY capacity, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s3 AS (SELECT *, (budget - c) * weight >= capacity * (a - w) AS full_ FROM s2
), s4 AS (
  SELECT *, CAST(coalesce(sum(capacity) FILTER (full_) OVER p, 0) AS BIGINT) AS fc, CAST(coalesce(count(*) FILTER (full_) OVER p, 0) AS BIGINT) AS fw FROM s3
  WINDOW p AS (PARTITION BY domain, lang)
), b AS (
  SELECT domain, lang, source, tokens, CASE WHEN full_ THEN capacity ELSE (weight * (budget - fc)) // (a - fw) END AS budget FROM s4
), e AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs FROM b
), k AS (
  SELECT d.*, epochs, budget - epochs * tokens AS rest, md5('17:' || (epochs + 1) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM d JOIN e USING (domain, lang, source)
), r AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY key) AS sofar FROM k)
SELECT doc_id, domain, lang, source, CAST(epochs + CASE WHEN sofar <= rest THEN 1 ELSE 0 END AS INTEGER) AS copies FROM r
""",
    "op12_lexical_search": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
), n AS (SELECT doc_id, t, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0
), g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), u AS (SELECT doc_id, n, unnest(t) AS term FROM n
), p AS (SELECT doc_id, n, term, count(*) AS tf FROM u WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term, docs
), s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // terms))))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), g GROUP BY item_id, doc_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
""",
    "op11_hard_negatives": r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e AS a JOIN e AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3
""",
}
