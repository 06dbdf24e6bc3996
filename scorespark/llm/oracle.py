"""DuckDB equivalents of the corpus queries that SQL can express."""

# CRC-32 (polynomial 0xEDB88320, reflected) over the bytes of a text, table made by its rule
OP3 = """
WITH RECURSIVE steps(n, k, v) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL
  SELECT n, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8
), crc AS (SELECT list(v ORDER BY n) AS tab FROM steps WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (
  SELECT doc_id, strlen(t) + 8 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(0, strlen(t)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
      lambda acc, x: xor(acc >> 8, tab[(xor(acc, x) & 255) + 1])), 4294967295) AS text_crc32
  FROM d, crc
), p AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS b,
    sum(size) OVER () AS total FROM s
), q AS (SELECT *, (b * 24 // total)::INT AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot,
  CAST(NULL AS INT) AS grown_shard
FROM q
"""

# shingles by list slices; links from shared shingles; the smallest id reachable by a recursive walk
OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)
), walk AS (
  SELECT doc_id AS r, doc_id AS d FROM documents
  UNION
  SELECT r, b FROM walk JOIN links ON a = d WHERE b > r
), low AS (
  SELECT d, min(r) AS r FROM walk GROUP BY 1
), walk2 AS (
  SELECT d, r FROM low
  UNION
  SELECT b, r FROM walk2 JOIN links ON a = d
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT d, min(r) AS component_id FROM walk2 GROUP BY 1) c ON c.d = w.doc_id
"""

# hexadecimal texts: byte i is characters 2i+1 and 2i+2
OP4 = """
WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY md5_number(substr(h, 2 * i + 1, 200)) ORDER BY doc_id, i) > 1 AS again
  FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)
), gone AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM win WHERE again
), runs AS (
  SELECT doc_id, min(i) AS s, max(i) + 100 AS e FROM (
    SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM gone
  ) GROUP BY doc_id, g
), cut AS (
  SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS b FROM runs
), left_over AS (
  SELECT doc_id, string_agg(substr(h, 2 * b + 1, 2 * (s - b)), '' ORDER BY s) AS k, sum(e - s)::BIGINT AS gone, count(*) AS spans, max(e) AS e
  FROM cut JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(coalesce(k || substr(h, 2 * e + 1), h))) AS kept_sha256
FROM d LEFT JOIN left_over USING (doc_id)
"""

OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
r AS (SELECT page_id, t, CASE WHEN strlen(t) >= 1000 THEN max(page_id) OVER (PARTITION BY t) ELSE page_id END AS last FROM p)
SELECT page_id, strlen(t) AS payload_bytes, sha1(t) AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to
FROM r
"""

OP9 = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) > 1 AS again
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), rep AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM win WHERE again) GROUP BY 1
), dup AS (
  SELECT doc_id, sum(c - 1)::BIGINT AS n FROM (
    SELECT doc_id, l, count(*) AS c FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
    WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1, 2) GROUP BY 1
), m AS (
  SELECT w.doc_id, source, len(ws) AS n_words, len(array_to_string(ws, '')) AS word_chars,
    len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)
), rules AS (
  SELECT source, r, count(*) AS docs, sum(f::INT) AS fails FROM (
    SELECT source, unnest(['a', 'b', 'c', 'd', 'e']) AS r, unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words,
      10 * n_symbols > n_words, 20 * n_dup_lines > n_words, word_chars < 2 * n_words OR word_chars > 20 * n_words]) AS f
    FROM m WHERE source IS NOT NULL) GROUP BY 1, 2
), moments AS (
  SELECT r, sum(docs) AS n, count(*) AS k, sum(fails) / sum(docs) AS mean, sum(docs) - sum(docs * docs) / sum(docs) AS scale,
    sum(fails::DOUBLE * fails / docs) AS q FROM rules GROUP BY 1
), prior AS (
  SELECT *, (q - n * mean * mean - (k - 1) * mean * (1 - mean)) / (scale - (k - 1)) AS v FROM moments
), verdict AS (
  SELECT source, bool_or(coalesce((fails + mean * s) / (docs + s), mean) > 0.5) AS host_failed FROM (
    SELECT rules.*, mean, CASE WHEN k > 1 AND scale > k - 1 AND v > 0 THEN greatest(mean * (1 - mean) / v - 1, 0) END AS s
    FROM rules JOIN prior USING (r)) GROUP BY 1
), f AS (
  SELECT m.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(host_failed, false) AS host_failed
  FROM m LEFT JOIN verdict USING (source)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_failed,
  NOT base_failed AND NOT host_failed AS kept FROM f
"""

OP7 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_words,
    coalesce('s:' || source, 'null') AS s, ('0x' || substr(md5('0|block|' || doc_id), 1, 15))::BIGINT % 1024 AS b,
    ('0x' || substr(md5('0|key|' || doc_id), 1, 15))::BIGINT AS k FROM documents
), o AS (SELECT *, ('0x' || substr(md5('0|order|' || s || '|' || b), 1, 15))::BIGINT AS o FROM d),
t AS (SELECT s, sum(n_words)::BIGINT AS t FROM o GROUP BY 1),
a AS (SELECT greatest(0, round(1 - ln(2.0) / ln(max(t)::DOUBLE / min(t)), 6)) AS a, max(t) AS top FROM t WHERE t > 0),
q AS (SELECT s, t, CASE WHEN t > 0 THEN floor(top * pow(t::DOUBLE / top, a) + 1e-6)::BIGINT ELSE 0 END AS q FROM t, a),
p AS (SELECT s, CASE WHEN t > 0 THEN q // t ELSE 1 END AS passes, CASE WHEN t > 0 THEN q % t ELSE 0 END AS rest FROM q),
c AS (
  SELECT doc_id, sum(n_words) OVER (PARTITION BY s ORDER BY o, k RANGE UNBOUNDED PRECEDING) AS e, s FROM o
)
SELECT o.doc_id, source, n_words, (passes + CASE WHEN e <= rest AND rest > 0 THEN 1 ELSE 0 END)::BIGINT AS copies
FROM o JOIN c USING (doc_id) JOIN p ON p.s = o.s
"""

OP10 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93
), walk AS (
  SELECT vec_id AS d, vec_id AS r FROM embeddings
  UNION
  SELECT b, r FROM walk JOIN links ON a = d WHERE r < b
)
SELECT e.vec_id, coalesce(n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY 1) ON a = e.vec_id
JOIN (
  WITH RECURSIVE w2 AS (
    SELECT d, min(r) AS r FROM walk GROUP BY 1 UNION SELECT b, r FROM w2 JOIN links ON a = d
  ) SELECT d, min(r) AS component_id FROM w2 GROUP BY 1
) c ON c.d = e.vec_id
"""

# vectors as whole numbers; inner products of whole doubles are exact here
OP11 = """
WITH v AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, d.r, d.vec_id, a.label = d.label AS same, list_inner_product(a.e, d.e)::BIGINT AS score
  FROM v a JOIN v d ON a.r <> d.r AND len(a.e) = len(d.e) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id NULLS LAST, r) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER w AS rank, s.vec_id AS negative_id,
  p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
WINDOW w AS (PARTITION BY p.ar, p.r ORDER BY s.score DESC, s.vec_id NULLS LAST, s.r)
QUALIFY row_number() OVER w <= 5
"""

OP12 = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents
), w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS ws FROM p),
spots AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, ws, i, unnest(range(1, least(len(ws) - i + 1, 5) + 1)) AS m FROM spots),
f AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY 1, 2, 3),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY 1),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= 100),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:], ' ') AS rp
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c)
), scored AS (
  SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = lp JOIN f y ON y.lang = cuts.lang AND y.phrase = rp JOIN n ON n.lang = cuts.lang
), low AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_ AS (
  SELECT lang, a, array_to_string(ws[s:s + q - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, m - q + 2)) AS s FROM (SELECT *, unnest(range(2, m)) AS q FROM c))
), covered AS (SELECT lang, phrase, max(a) AS longer FROM inner_ GROUP BY 1, 2)
SELECT low.lang, row_number() OVER w AS rank, low.phrase, a, l, r, n, score
FROM low LEFT JOIN covered ON covered.lang = low.lang AND covered.phrase = low.phrase
WHERE longer IS NULL OR 100 * longer < 100 * a
WINDOW w AS (PARTITION BY low.lang ORDER BY score DESC, a DESC, low.phrase)
QUALIFY row_number() OVER w <= 2000
"""

OP13 = """
WITH v AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r AS qr, q.vec_id AS query_id, d.vec_id, d.r, list_inner_product(q.e, d.e)::BIGINT AS score
  FROM v q JOIN v d ON q.r <> d.r AND len(q.e) = len(d.e) WHERE q.vec_id % 100 = 0
)
SELECT query_id, row_number() OVER w AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY qr ORDER BY score DESC, vec_id NULLS LAST, r) QUALIFY row_number() OVER w <= 10
"""

ORACLE = {
    "op7_temperature_mixing": OP7,
    "op10_collision_counting": OP10,
    "op8_splittable_warc": OP8,
    "op9_host_quality": OP9,
    "op1_tensored_minhash": OP1,
    "op4_cover_suffix_dedup": OP4,
    "op3_prefix_sum_shards": OP3,
    "op11_norm_bounded_negatives": OP11,
    "op12_burst_trie_phrases": OP12,
    "op13_block_top_k": OP13,
}
