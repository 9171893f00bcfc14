"""The registered queries in DuckDB's SQL, from common parts."""

from __future__ import annotations

#: The English words that are no search terms, stated here apart from the engine's own list.
_STOP = (
    "['a','an','the','and','or','not','of','to','in','on','for','with','at','by','from','is','are','was','were','be','been','being','as','that','this','those','these',"
    "'it','its','they','them','he','she','we','you','your','our','their','i']"
)
_CJK = r"\p{Han}\p{Katakana}\p{Hiragana}\p{Hangul}"

#: Search terms of column text.
TERMS = (
    rf"flatten(list_transform(regexp_extract_all(lower(coalesce(text, '')), '[{_CJK}]+|[\p{{L}}\p{{N}}]+'), lambda r: "
    rf"CASE WHEN regexp_matches(r, '^[{_CJK}]') THEN list_concat(list_transform(range(1, length(r) + 1), lambda k: substr(r, k, 1)), list_transform(range(1, length(r)), lambda k: substr(r, k, 2))) "
    rf"WHEN (length(r) >= 2 OR regexp_matches(r, '^\p{{Nd}}$')) AND NOT list_contains({_STOP}, r) THEN [r] ELSE [] END))"
)

#: points: the documents as points; stats and terms: their statistics.
POINTS = f"""points AS (SELECT 'docling_' || source AS collection, doc_id AS point_id, {TERMS} AS tokens FROM documents),
tf AS (SELECT collection, point_id, term, count(*) AS tf FROM (SELECT collection, point_id, unnest(tokens) AS term FROM points) GROUP BY ALL),
stats AS (SELECT collection, count(*) AS n, CAST(sum(len(tokens)) AS BIGINT) AS total_dl, sum(len(tokens)) / greatest(count(*), 1) AS avgdl FROM points GROUP BY collection),
terms AS (SELECT collection, term, count(*) AS df FROM tf GROUP BY ALL)"""

ALL_POINTS = POINTS.replace("'docling_' || source AS collection", "'all' AS collection")

POSTINGS = """postings AS (SELECT tf.collection, tf.point_id, tf.term, tf.tf, len(p.tokens) AS dl,
  tf.tf * 2.2 / greatest(1e-9, tf.tf + 1.2 * (0.25 + 0.75 * len(p.tokens) / greatest(1.0, s.avgdl))) AS weight
  FROM tf JOIN points p ON p.point_id = tf.point_id AND p.collection = tf.collection JOIN stats s ON s.collection = tf.collection)"""

QUERIES = f"""q AS (SELECT 'all' AS collection, item_id AS query_id, {TERMS} AS tokens FROM benchmark),
qw AS (SELECT x.collection, query_id, x.term, x.tf, x.tf * ln((s.n + 1.0) / (coalesce(t.df, 0) + 0.5)) AS weight
  FROM (SELECT collection, query_id, term, count(*) AS tf FROM (SELECT collection, query_id, unnest(tokens) AS term FROM q) GROUP BY ALL) x
  JOIN stats s ON s.collection = x.collection LEFT JOIN terms t ON t.collection = x.collection AND t.term = x.term)"""

SPARSE = """sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT query_id, point_id AS id, round(sum(p.weight * qw.weight), 9) AS score FROM postings p JOIN qw ON qw.collection = p.collection AND qw.term = p.term GROUP BY ALL)) WHERE rank <= 20)"""


def _dense(chosen: str) -> str:
    return f"""vq AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE {chosen}),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT query_id, vec_id AS id, list_sum(list_transform(list_zip(embedding, v), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) AS score FROM embeddings, vq)) WHERE rank <= 20)"""


#: Query vectors: those whose id 100 divides; or, for searches that fuse, one for each item of the benchmark.
DENSE = _dense("vec_id % 100 = 0")
ITEM_DENSE = _dense("vec_id IN (SELECT item_id FROM benchmark)")


def fused(w_dense: str, w_sparse: str) -> str:
    return f"""fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 12) DESC, first.list, first.rank) AS position FROM (
  SELECT query_id, id, arg_min(score, list) AS score, sum(CASE list WHEN 0 THEN {w_dense} ELSE {w_sparse} END / (60 + rank)) AS rrf_score, min({{'list': list, 'rank': rank}}) AS first
  FROM (SELECT query_id, id, score, rank, 0 AS list FROM dense UNION ALL SELECT query_id, id, score, rank, 1 AS list FROM sparse) GROUP BY query_id, id))"""


#: Files of ten documents each, every document under a heading, its lines in three paragraphs and a fence.
FILES = """files AS (SELECT doc_id // 10 AS file, string_agg('# Doc ' || doc_id || chr(10) || chr(10) || regexp_replace(text, '\\. ', '.' || chr(10) || chr(10), 'g')
  || chr(10) || '```' || chr(10) || '# code' || chr(10) || chr(10) || 'x' || chr(10) || '```' || chr(10) || '## ' || source, chr(10) ORDER BY doc_id) AS md FROM documents GROUP BY ALL)"""

LINES = r"""ln AS (SELECT file, unnest(range(0, len(a))) AS pos, unnest(a) AS line FROM (SELECT file, string_split(md, chr(10)) AS a FROM files)),
b AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS bare, starts_with(regexp_replace(line, '^\s+|\s+$', '', 'g'), '```') AS is_fence FROM ln),
f AS (SELECT *, sum(CAST(is_fence AS INT)) OVER (PARTITION BY file ORDER BY pos) % 2 = 1 AS inside FROM b),
h AS (SELECT *, NOT inside AND NOT is_fence AND regexp_matches(line, '^#{1,6}\s+.*$') AS is_head, NOT inside AND NOT is_fence AND bare = '' AS is_blank FROM f),
g AS (SELECT *, NOT is_head AND NOT is_blank AS content, sum(CAST(is_head AS INT)) OVER (PARTITION BY file ORDER BY pos) AS sec, sum(CAST(is_head OR is_blank AS INT)) OVER (PARTITION BY file ORDER BY pos) AS grp FROM h),
m AS (SELECT *, sec - 1 + max(CASE WHEN sec = 0 AND content THEN 1 ELSE 0 END) OVER (PARTITION BY file) AS section_idx FROM g),
secs AS (SELECT file, CAST(section_idx AS BIGINT) AS section_idx, nullif(regexp_replace(regexp_extract(line, '^(#{1,6})\s+(.*)$', 2), '^\s+|\s+$', '', 'g'), '') AS title, length(regexp_extract(line, '^(#{1,6})\s+(.*)$', 1)) AS level FROM m WHERE is_head
  UNION ALL SELECT DISTINCT file, CAST(section_idx AS BIGINT), NULL, 1 FROM m WHERE sec = 0 AND content),
pg AS (SELECT file, CAST(section_idx AS BIGINT) AS section_idx, grp, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^\s+|\s+$', '', 'g') AS text FROM m WHERE content GROUP BY ALL),
paras AS (SELECT file, section_idx, row_number() OVER (PARTITION BY file, section_idx ORDER BY grp) - 1 AS para_idx, text FROM pg WHERE text <> ''),
pt AS (SELECT file, section_idx, string_agg(text, chr(10) || chr(10) ORDER BY para_idx) AS parent_text FROM paras GROUP BY ALL)"""
