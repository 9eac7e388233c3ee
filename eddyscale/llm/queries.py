"""The registered queries of this subpackage and the SQL of those that SQL can express.

Sharding by checksum and curve, tokenising, trained models, eigenvectors and HTML parsing have no
SQL; their tests compare with brute force, a round trip or held-out rows.
"""

from __future__ import annotations

from . import chat, concatenation, decontamination, html_extraction, jaccard_join, language_id, line_dedup, nearest, packing, quality, resampling, sharding, whitening
from .common import table

QUERIES = {
    "op1_benchmark_decontamination": lambda s, d: decontamination.report(table(s, d, "documents"), table(s, d, "benchmark")),
    "op2_line_dedup": lambda s, d: line_dedup.report(table(s, d, "documents")),
    "op3_chat_perspectives": lambda s, d: chat.report(table(s, d, "conversations")),
    "op4_hilbert_sharding": lambda s, d: sharding.report(table(s, d, "documents")),
    "op5_one_bit_neighbours": lambda s, d: nearest.report(table(s, d, "embeddings")),
    "op6_best_fit_packing": lambda s, d: packing.report(table(s, d, "documents")),
    "op7_language_id": lambda s, d: language_id.report(table(s, d, "pages"), table(s, d, "documents")),
    "op8_ngram_jaccard_join": lambda s, d: jaccard_join.report(table(s, d, "documents")),
    "op9_quality_classifier": lambda s, d: quality.report(table(s, d, "documents"), table(s, d, "labels")),
    "op10_html_extraction": lambda s, d: html_extraction.report(table(s, d, "pages")),
    "op11_concatenate_and_cut": lambda s, d: concatenation.report(table(s, d, "documents")),
    "op12_embedding_whitening": lambda s, d: whitening.report(table(s, d, "embeddings")),
    "op13_importance_resampling": lambda s, d: resampling.report(table(s, d, "documents"), table(s, d, "benchmark")),
}

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BLANK_WORDS = rf"regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL: dict[str, str] = {
    "op1_benchmark_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, w[s : s + n - 1] AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM i)),
dw AS (SELECT rid, n, s, w[s : s + n - 1] AS g
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT rid, s, n, item_id FROM dw JOIN iw USING (n, g)),
p AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS pos FROM h) GROUP BY rid),
f AS (SELECT rid, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN f USING (rid)
""",
    "op2_line_dedup": f"""
WITH l AS (
  SELECT rid, doc_id, line, pos, {_LOW.format(f"trim(line, {_BLANKS})")} AS key
  FROM (SELECT rid, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos
        FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
o AS (SELECT key, min(doc_id) AS owner FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT l.*, o.owner IS NOT NULL AND l.doc_id <> o.owner AS gone FROM l LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
""",
    "op3_chat_perspectives": chat.ORACLE,
    # sums in order of the components, as the operator takes them; small tables are searched whole
    "op5_one_bit_neighbours": """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
d AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i]), lambda x, y: x + y) AS qv,
         list_reduce(list_transform(q.e, lambda x: x * x), lambda x, y: x + y) AS qq, list_reduce(list_transform(v.e, lambda x: x * x), lambda x, y: x + y) AS vv
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
s AS (SELECT query_id, vec_id, qv / (sqrt(qq) * sqrt(vv)) AS score FROM d),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
""",
    "op8_ngram_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_BLANK_WORDS} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
v AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a, b FROM v UNION SELECT r.a, v.b FROM r JOIN v ON r.b = v.a)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(t.low, d.doc_id)) AS component_id
FROM d LEFT JOIN z USING (doc_id) LEFT JOIN (SELECT a, min(b) AS low FROM r GROUP BY a) t ON t.a = d.doc_id
""",
    # checksums by a table of 256 registers, over the bytes of each distinct feature
    "op13_importance_resampling": f"""
WITH z AS (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, x)) AS t),
w AS (SELECT row_number() OVER () AS rid, 'd' AS side, doc_id, {_WORDS} AS w FROM documents UNION ALL SELECT -row_number() OVER (), 'b', NULL, {_WORDS} FROM benchmark),
f AS (SELECT side, rid, array_to_string(w[s : s + k - 1], ' ') AS g FROM (SELECT side, rid, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM w, (VALUES (1), (2), (3)) q(k) WHERE len(w) >= k)),
b AS (SELECT g, xor(list_reduce(list_transform(range(1, 2 * strlen(g), 2), lambda i: CAST('0x' || substr(hex(encode(g)), i, 2) AS BIGINT)), lambda c, y: xor(t[(xor(c, y) & 255) + 1], c >> 8), 4294967295), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT g FROM f), z),
n AS (SELECT side, rid, bucket, count(*) AS n FROM f JOIN b USING (g) GROUP BY ALL),
c AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 'd'), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 'b'), 0) AS t FROM n GROUP BY bucket),
a AS (SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * ((SELECT sum(s) FROM c) + 10000.0::DOUBLE) / ((s + 1.0::DOUBLE) * ((SELECT sum(t) FROM c) + 10000.0::DOUBLE)))) AS BIGINT) AS gain FROM c),
d AS (SELECT w.rid, doc_id, len(w) AS n_words, CAST(coalesce(x.n, 0) AS BIGINT) AS n_features, CAST(coalesce(x.weight, 0) AS BIGINT) AS weight
      FROM w LEFT JOIN (SELECT rid, sum(n) AS n, sum(n * gain) AS weight FROM n JOIN a USING (bucket) WHERE side = 'd' GROUP BY rid) x USING (rid) WHERE side = 'd'),
e AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d),
r AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST, rid) END AS place FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 5 * count(*) // 100 FROM d WHERE n_words >= 20) THEN place END AS rank FROM r
""",
}
