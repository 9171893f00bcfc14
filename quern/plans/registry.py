"""The queries of the retrieval engine over the test tables, and their SQL, by name.

Documents stand in for chunks: a document's collection is that of its source, its file doc_<id>. Each
query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import ids, scoring, text
from quern.operators import chunking, collections, enrich, headers, ingest, markdown, search, stats, views
from quern.plans import sql
from quern.sources import blobs, readers
from quern.sources.shipping import ship
from quern.streaming.folders import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if oracle:
            ORACLE_SQL[fn.__name__] = oracle
        return fn

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.table(spark, sf_dir, "documents")


def points(spark: SparkSession, sf_dir: str, one: bool = False) -> DataFrame:
    """(collection, point_id, tokens) of the documents, in one collection or by source."""
    name = F.lit("all") if one else F.concat(F.lit("docling_"), F.col("source"))
    return docs(spark, sf_dir).select(name.alias("collection"), F.col("doc_id").alias("point_id"), text.terms(F.col("text")).alias("tokens"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored points with metadata."""
    d = docs(spark, sf_dir)
    title = F.nullif(F.element_at(F.split("text", "\n"), 1), F.lit(""))
    return d.select(
        F.concat(F.lit("docling_"), F.col("source")).alias("collection"),
        F.col("doc_id").alias("id"),
        F.concat(F.lit("doc_"), (F.col("doc_id") % 400).cast("string")).alias("filename"),
        F.when(F.col("doc_id") % 3 != 0, F.substring(title, 1, 40)).alias("title"),
        F.concat(F.lit("u/"), F.col("doc_id").cast("string")).alias("url"),
        F.when(F.col("doc_id") % 2 == 0, F.array((F.lit(1000) - F.col("doc_id") % 7).cast("int"), F.lit(900))).alias("page_numbers"),
        F.concat(F.lit("SF-"), F.col("doc_id").cast("string")).alias("index"),
        F.col("text"),
    )


RECORDS = """r AS (SELECT 'docling_' || source AS collection, doc_id AS id, 'doc_' || (doc_id % 400) AS filename, CASE WHEN doc_id % 3 <> 0 THEN substr(nullif(string_split(text, chr(10))[1], ''), 1, 40) END AS title,
  'u/' || doc_id AS url, CASE WHEN doc_id % 2 = 0 THEN [CAST(1000 - doc_id % 7 AS INT), 900] END AS page_numbers, 'SF-' || doc_id AS index, text FROM documents)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown files of ten documents each."""
    body = F.concat(
        F.lit("# Doc "), F.col("doc_id").cast("string"), F.lit("\n\n"), F.regexp_replace("text", r"\. ", ".\n\n"), F.lit("\n```\n# code\n\nx\n```\n## "), F.col("source")
    )
    rows = docs(spark, sf_dir).groupBy(F.floor(F.col("doc_id") / 10).alias("file")).agg(F.array_sort(F.collect_list(F.struct("doc_id", body.alias("md")))).alias("x"))
    return rows.select("file", F.array_join(F.transform("x", lambda r: r["md"]), "\n").alias("md"))


def item_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = readers.table(spark, sf_dir, "benchmark")
    return b.select(F.lit("all").alias("collection"), F.col("item_id").alias("query_id"), text.terms(F.col("text")).alias("tokens"))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all documents; written, as statistics and postings both read it."""
    return written(stats.indexed(points(spark, sf_dir, one=True)))


def weighted(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    queries = item_queries(spark, sf_dir)
    return stats.query_weights(queries, stats.corpus_stats(rows), stats.term_stats(rows, queries))


def sparse(spark: SparkSession, sf_dir: str, depth: int = 20) -> DataFrame:
    rows = index(spark, sf_dir)
    return search.sparse_topk(stats.postings(rows, stats.corpus_stats(rows)), weighted(spark, sf_dir, rows), depth)


def dense_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("dense"))


def dense(spark: SparkSession, sf_dir: str, depth: int = 20) -> DataFrame:
    """Every vector whose id 100 divides is a query, against all vectors."""
    e = dense_points(spark, sf_dir)
    return search.dense_topk(e, e.filter("id % 100 = 0").select(F.col("id").cast("long").alias("query_id"), F.col("dense").alias("v")), depth)


def full_queries(spark: SparkSession, sf_dir: str, take: int | None = None) -> DataFrame:
    """(collection, query_id, tokens, v): every item of the benchmark, its vector that with the same id."""
    v = dense_points(spark, sf_dir).select(F.col("id").cast("long").alias("query_id"), F.col("dense").alias("v"))
    return item_queries(spark, sf_dir).join(v, "query_id").select("collection", "query_id", "tokens", "v")


W6 = lambda c: F.round(c, 6)


@query(f"WITH {sql.POINTS} SELECT point_id AS doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens, md5(array_to_string(tokens, ' ')) AS digest FROM points")
def tokenize_docs(spark, sf_dir):
    return points(spark, sf_dir).select(F.col("point_id").alias("doc_id"), F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@query(
    f"SELECT lang, CAST(sum(len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))) AS BIGINT) AS n_raw, CAST(sum(len({sql.TERMS})) AS BIGINT) AS n_kept FROM documents GROUP BY lang"
)
def token_filter_stats(spark, sf_dir):
    d = docs(spark, sf_dir).select("lang", F.size(text.runs(F.col("text"))).alias("raw"), F.size(text.terms(F.col("text"))).alias("kept"))
    return d.groupBy("lang").agg(F.sum("raw").alias("n_raw"), F.sum("kept").alias("n_kept"))


@query(f"WITH {sql.POINTS} SELECT collection, point_id, term, tf FROM tf")
def term_freq(spark, sf_dir):
    return stats.term_frequencies(points(spark, sf_dir))


@query(f"WITH {sql.POINTS} SELECT collection, term, df FROM terms")
def doc_freq(spark, sf_dir):
    return stats.term_stats(points(spark, sf_dir))


@query(f"WITH {sql.POINTS} SELECT collection, n, total_dl, round(avgdl, 6) AS avgdl FROM stats")
def corpus_stats(spark, sf_dir):
    return stats.corpus_stats(points(spark, sf_dir)).withColumn("avgdl", W6(F.col("avgdl")))


@query(f"WITH {sql.POINTS} SELECT t.collection, term, round(ln((n + 1.0) / (df + 0.5)), 6) AS idf FROM terms t JOIN stats s ON s.collection = t.collection")
def idf(spark, sf_dir):
    p = written(stats.indexed(points(spark, sf_dir)))
    rows = stats.term_stats(p).join(F.broadcast(stats.corpus_stats(p).limit(100_000)), "collection")
    return rows.select("collection", "term", W6(scoring.idf(F.col("n"), F.col("df"))).alias("idf"))


@query(f"WITH {sql.POINTS}, {sql.POSTINGS} SELECT collection, point_id, term, tf, dl, round(weight, 6) AS weight FROM postings")
def tf_norm_postings(spark, sf_dir):
    p = written(stats.indexed(points(spark, sf_dir)))
    return stats.postings(p, stats.corpus_stats(p)).select("collection", "point_id", "term", "tf", F.col("dl").cast("long").alias("dl"), W6(F.col("weight")).alias("weight"))


@query(f"WITH {sql.ALL_POINTS}, {sql.QUERIES} SELECT query_id, term, tf, round(weight, 6) AS weight FROM qw")
def query_weights(spark, sf_dir):
    return weighted(spark, sf_dir, index(spark, sf_dir)).select("query_id", "term", "tf", W6(F.col("weight")).alias("weight"))


@query(f"WITH {sql.ALL_POINTS} SELECT term, CAST(('0x' || substr(sha1(term), 1, 8))::UBIGINT AS BIGINT) AS idx FROM terms")
def stable_hash(spark, sf_dir):
    return stats.term_stats(points(spark, sf_dir, one=True)).select("term", ids.term_index(F.col("term")).alias("idx"))


@query("SELECT doc_id, CAST(('0x' || substr(sha256(source || '::doc_' || doc_id || '::0'), 1, 16))::UBIGINT % 9223372036854775808 AS BIGINT) AS point_id FROM documents")
def point_ids(spark, sf_dir):
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    return docs(spark, sf_dir).select("doc_id", ids.point_id(F.col("source"), name, F.lit(0)).alias("point_id"))


@query("SELECT doc_id, substr(md5(CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END || ':' || text), 1, 16) AS parent_id FROM documents")
def parent_ids(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", ids.parent_id(F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.col("text")).alias("parent_id"))


@query(
    "SELECT c_custkey, 'docling_' || c_name || CASE WHEN c_nationkey % 3 = 0 THEN '' WHEN c_nationkey % 3 = 1 THEN '_sheets_' || c_nationkey ELSE '_sheets' END AS documents, "
    "'sendable_files_' || c_name AS sendables FROM customer"
)
def collection_names(spark, sf_dir):
    kind = F.col("c_nationkey") % 3
    source, agent = F.when(kind == 0, "general").otherwise("sheets"), F.when(kind == 1, F.col("c_nationkey").cast("string"))
    c = readers.table(spark, sf_dir, "customer")
    return c.select("c_custkey", ids.document_collection(F.col("c_name"), source, agent).alias("documents"), ids.sendable_collection(F.col("c_name")).alias("sendables"))


@query(f"WITH {sql.ALL_POINTS}, {sql.POSTINGS}, {sql.QUERIES}, {sql.SPARSE} SELECT query_id, id, round(score, 6) AS score, rank FROM sparse")
def bm25_topk(spark, sf_dir):
    return sparse(spark, sf_dir).select("query_id", "id", W6(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {sql.DENSE} SELECT query_id, id, round(score, 6) AS score, rank FROM dense")
def dense_topk(spark, sf_dir):
    return dense(spark, sf_dir).select("query_id", "id", W6(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))


def _fused(spark, sf_dir, weights=None):
    queries = full_queries(spark, sf_dir)
    return search.fuse(search.dense_topk(dense_points(spark, sf_dir), queries.select("query_id", "v"), 20), sparse(spark, sf_dir), weights)


def _fused_columns(df):
    return df.select("query_id", "id", W6(F.col("score")).alias("score"), W6(F.col("rrf_score")).alias("rrf_score"), F.col("position").cast("long").alias("position"))


_HYBRID = f"WITH {sql.ALL_POINTS}, {sql.POSTINGS}, {sql.QUERIES}, {sql.SPARSE}, {sql.ITEM_DENSE}, "
_FUSED_OUT = " SELECT query_id, id, round(score, 6) AS score, round(rrf_score, 6) AS rrf_score, position FROM fused"


@query(_HYBRID + sql.fused("1.0", "1.0") + _FUSED_OUT)
def rrf_unweighted(spark, sf_dir):
    return _fused_columns(_fused(spark, sf_dir))


def _weights(spark, sf_dir, taken):
    w_dense, w_sparse = scoring.hybrid_weights(taken(F.col("tokens")))
    return item_queries(spark, sf_dir).select("query_id", w_dense.alias("w_dense"), w_sparse.alias("w_sparse"))


@query(_HYBRID + sql.fused("CASE WHEN query_id % 2 = 0 THEN 1.0 ELSE 0.8 END", "CASE WHEN query_id % 2 = 0 THEN 1.0 ELSE 1.2 END") + _FUSED_OUT)
def hybrid_rrf(spark, sf_dir):
    """Every second query is weighted as if it had three terms only."""
    return _fused_columns(_fused(spark, sf_dir, _weights(spark, sf_dir, lambda t: F.when(F.col("query_id") % 2 == 0, t).otherwise(F.slice(t, 1, 3)))))


@query(_HYBRID + sql.fused("0.8", "1.2") + _FUSED_OUT)
def hybrid_rrf_short_query(spark, sf_dir):
    return _fused_columns(_fused(spark, sf_dir, _weights(spark, sf_dir, lambda t: F.slice(t, 1, 3))))


def _parents(spark, sf_dir):
    """Documents as chunks of seven parents, every fifth without one, with the vectors of the same ids."""
    parent = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("p"), (F.col("doc_id") % 7).cast("string")))
    d = docs(spark, sf_dir).select(
        F.col("doc_id").alias("id"), "text", parent.alias("parent_id"), F.coalesce(F.concat(F.lit("parent of "), parent), F.lit("no parent")).alias("parent_text"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("filename"), F.format_string("[%d, 9]", F.col("doc_id") % 50).alias("page_numbers"), F.col("lang").alias("title"), F.concat(F.lit("u/"), F.col("doc_id").cast("string")).alias("url"),
    )
    return d.join(dense_points(spark, sf_dir), "id", "full")


def _searched(spark, sf_dir, reranker=None, settings=None, limit=20):
    return search.search_documents(_parents(spark, sf_dir), index(spark, sf_dir), full_queries(spark, sf_dir), limit, settings, reranker)


_CHUNKS = """c AS (SELECT coalesce(doc_id, vec_id) AS id, coalesce(text, '') AS text, CASE WHEN doc_id % 5 <> 0 THEN 'p' || (doc_id % 7) END AS parent_id, 'doc_' || doc_id AS filename, CAST(doc_id % 50 AS INT) AS first_page, lang AS title FROM documents FULL JOIN embeddings ON vec_id = doc_id)"""
_WEIGHTED = sql.fused("CASE WHEN len(q.tokens) <= 3 THEN 0.8 ELSE 1.0 END", "CASE WHEN len(q.tokens) <= 3 THEN 1.2 ELSE 1.0 END").replace("FROM (SELECT query_id, id, score, rank, 0", "FROM (SELECT query_id AS of, tokens FROM q) q JOIN (SELECT query_id, id, score, rank, 0").replace("FROM sparse) GROUP BY", "FROM sparse) ON of = query_id GROUP BY")
_HITS = _HYBRID + _WEIGHTED + f", {_CHUNKS}, " + """hits AS (SELECT query_id, c.id, score, position, parent_id, text, filename, first_page, title FROM fused JOIN c ON c.id = fused.id WHERE position <= 20),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent_id, CASE WHEN parent_id IS NULL THEN id END ORDER BY position) AS nth FROM hits)"""


@query(_HITS + """ SELECT query_id, CAST(id AS VARCHAR) AS id, round(score, 6) AS score, position, parent_id, md5(CASE WHEN parent_id IS NULL THEN text ELSE 'parent of ' || parent_id END) AS text_md5, filename, first_page, title FROM k WHERE nth = 1""")
def search_documents(spark, sf_dir):
    out = _searched(spark, sf_dir).rows
    return out.select("query_id", "id", W6(F.col("score")).alias("score"), F.col("position").cast("long").alias("position"), "parent_id", F.md5("text").alias("text_md5"), "filename", F.get("page_numbers", F.lit(0)).alias("first_page"), "title")


@query(_HITS + """ SELECT query_id, count(*) AS children_count, count_if(nth = 1) AS parents_count, len(any_value(q.tokens)) > 0 AS hybrid, false AS reranked FROM k JOIN (SELECT query_id, tokens FROM q) q USING (query_id) GROUP BY query_id""")
def search_envelope(spark, sf_dir):
    return _searched(spark, sf_dir).envelope


def _fixed_reranker(shown: DataFrame) -> DataFrame:
    """Names every hit at an odd place, the last first, with a relevance that falls in another order."""
    odd = shown.filter("position % 2 = 1")
    return odd.select("query_id", (F.lit(100) - F.col("position")).alias("given"), (F.col("position") - 1).alias("index"), (F.lit(1.0) / (F.col("position") % 4 + 1)).alias("relevance"), F.lit("fixed").alias("reason"))


@query(
    _HITS + """, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position DESC) AS place FROM hits WHERE position % 2 = 1),
    p AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent_id, CASE WHEN parent_id IS NULL THEN id END ORDER BY place) AS first FROM o WHERE place <= 5)
    SELECT query_id, CAST(id AS VARCHAR) AS id, round(1.0 / (position % 4 + 1), 6) AS score, round(score, 6) AS vector_score, place AS position FROM p WHERE first = 1"""
)
def search_documents_reranked(spark, sf_dir):
    out = _searched(spark, sf_dir, _fixed_reranker, readers.Settings(use_reranker=True), 5).rows
    return out.select("query_id", "id", W6(F.col("score")).alias("score"), W6(F.col("vector_score")).alias("vector_score"), F.col("position").cast("long").alias("position"))


def _described(spark, sf_dir):
    d = docs(spark, sf_dir)
    kind = F.when(F.col("doc_id") % 3 == 0, "image/png").when(F.col("doc_id") % 3 == 1, "application/pdf")
    return d.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".png").otherwise(".pdf")).alias("file"), F.col("text").alias("description"), kind.alias("content_type"), F.concat(F.lit("u/"), F.col("doc_id").cast("string")).alias("url"), "doc_id", "lang")


@query(
    _HYBRID.replace("rank <= 20", "rank <= 10") + _WEIGHTED + f", {_CHUNKS}" + """ SELECT query_id, CAST(fused.id AS VARCHAR) AS id, 'SF-' || doc_id AS index, 'doc_' || doc_id AS filename, md5(text) AS text_md5, CASE WHEN doc_id % 3 = 0 THEN 'png' WHEN doc_id IS NOT NULL THEN 'pdf' END AS file_type, CASE WHEN doc_id % 3 = 0 THEN 'u/' || doc_id END AS asset_url,
    round(score, 6) AS score, round(rrf_score, 6) AS rrf_score FROM fused LEFT JOIN documents ON doc_id = fused.id WHERE position <= 5"""
)
def search_sendables(spark, sf_dir):
    name = F.col("doc_id").cast("string")
    d = docs(spark, sf_dir).select(
        F.col("doc_id").alias("id"), "text", F.concat(F.lit("SF-"), name).alias("index"), F.concat(F.lit("doc_"), name).alias("filename"), F.col("lang").alias("title"), F.concat(F.lit("u/"), name).alias("url"),
        F.when(F.col("doc_id") % 3 == 0, "png").otherwise("pdf").alias("file_type"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("u/"), name)).alias("asset_url"),
    )
    out = search.search_sendables(d.join(dense_points(spark, sf_dir), "id", "full"), index(spark, sf_dir), full_queries(spark, sf_dir), 5)
    return out.select("query_id", "id", "index", "filename", F.md5("text").alias("text_md5"), "file_type", "asset_url", W6(F.col("score")).alias("score"), W6(F.col("rrf_score")).alias("rrf_score"))


@query(
    """WITH r AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'png' ELSE 'pdf' END AS ext FROM documents)
    SELECT 'sendable_files_' || lang AS collection, CAST(('0x' || substr(sha256(lang || '::sendable::doc_' || doc_id || '.' || ext), 1, 16))::UBIGINT % 9223372036854775808 AS BIGINT) AS id, 'doc_' || doc_id || '.' || ext AS filename, ext AS file_type, CASE WHEN doc_id % 3 = 0 THEN 'u/' || doc_id END AS asset_url FROM r"""
)
def described_files(spark, sf_dir):
    return ingest.described_files(_described(spark, sf_dir), F.col("lang")).select("collection", "id", "filename", "file_type", "asset_url")


@query(f"WITH {RECORDS} SELECT id, index, filename, url FROM r WHERE index = 'SF-42'")
def sendable_by_index(spark, sf_dir):
    return records(spark, sf_dir).filter(F.col("index") == "SF-42").select("id", "index", "filename", "url")


@query(f"WITH {RECORDS} SELECT 'SF-' || (coalesce(max(TRY_CAST(string_split(index, '-')[2] AS INT)), 0) + 1) AS next_index FROM r WHERE starts_with(index, 'SF-')")
def next_sendable_index(spark, sf_dir):
    return collections.next_index(records(spark, sf_dir))


@query(f"WITH {RECORDS} SELECT id, index, filename, url, length(text) AS n_chars FROM r WHERE filename <> ''")
def list_sendables(spark, sf_dir):
    return records(spark, sf_dir).filter("filename <> ''").select("id", "index", "filename", "url", F.length("text").cast("long").alias("n_chars"))


@query(f"WITH {RECORDS} SELECT filename, arg_min(coalesce(title, chr(0)), id) AS t0, nullif(t0, chr(0)) AS title, arg_min(url, id) AS url FROM r GROUP BY filename".replace("arg_min(coalesce(title, chr(0)), id) AS t0, nullif(t0, chr(0)) AS title", "nullif(arg_min(coalesce(title, chr(1)), id), chr(1)) AS title"))
def document_list(spark, sf_dir):
    return views.document_list(records(spark, sf_dir))


@query(
    f"""WITH {RECORDS}, f AS (SELECT filename, nullif(arg_min(coalesce(title, chr(1)), id), chr(1)) AS title, arg_min(url, id) AS url, arg_min(page_numbers IS NOT NULL, id) AS paged FROM r GROUP BY filename),
    o AS (SELECT r.*, f.paged, CASE WHEN f.paged THEN coalesce(list_min(page_numbers), 2147483647) ELSE 0 END AS page FROM r JOIN f ON f.filename = r.filename),
    c AS (SELECT filename, string_agg(text, ' ' ORDER BY page, id) AS content FROM o GROUP BY filename),
    t AS (SELECT filename, list(title ORDER BY page, id) AS titles FROM (SELECT filename, title, page, id, row_number() OVER (PARTITION BY filename, title ORDER BY page, id) AS nth FROM o WHERE title <> '') WHERE nth = 1 GROUP BY filename)
    SELECT f.filename, f.title, f.url, coalesce(array_to_string(t.titles, '|'), '') AS section_titles, md5(content) AS content_md5, CAST(length(content) AS BIGINT) AS n_chars FROM f JOIN c ON c.filename = f.filename LEFT JOIN t ON t.filename = f.filename"""
)
def document_content(spark, sf_dir):
    out = views.document_content(records(spark, sf_dir))
    return out.select("filename", "title", "url", F.array_join("section_titles", "|").alias("section_titles"), F.md5("content").alias("content_md5"), F.length("content").cast("long").alias("n_chars"))


@query(f"WITH {sql.FILES}, {sql.LINES} SELECT file, section_idx, title, CAST(level AS BIGINT) AS level FROM secs")
def sections(spark, sf_dir):
    return markdown.sections(files(spark, sf_dir)).select("file", F.col("section_idx").cast("long").alias("section_idx"), "title", F.col("level").cast("long").alias("level"))


@query(f"WITH {sql.FILES}, {sql.LINES} SELECT file, section_idx, para_idx, md5(text) AS text_md5 FROM paras")
def paragraphs(spark, sf_dir):
    return markdown.paragraphs(files(spark, sf_dir)).select("file", F.col("section_idx").cast("long").alias("section_idx"), F.col("para_idx").cast("long").alias("para_idx"), F.md5("text").alias("text_md5"))


@query()
def semantic_chunks(spark, sf_dir):
    out = chunking.semantic_chunks(files(spark, sf_dir), 700)
    return out.select("file", "section_idx", "chunk_idx", "section_title", "parent_id", "text")


@query(
    f"""WITH {sql.FILES}, {sql.LINES} SELECT pt.file, pt.section_idx, s.title, substr(md5(coalesce(s.title, '') || ':' || parent_text), 1, 16) AS parent_id, CAST(greatest(1, length(parent_text) // 4) AS INT) AS n_tokens
    FROM pt JOIN secs s ON s.file = pt.file AND s.section_idx = pt.section_idx"""
)
def parent_chunks(spark, sf_dir):
    p = markdown.parents(files(spark, sf_dir))
    return p.select("file", F.col("section_idx").cast("long").alias("section_idx"), "title", ids.parent_id(F.col("title"), F.col("parent_text")).alias("parent_id"), text.token_count(F.col("parent_text")).alias("n_tokens"))


@query()
def natural_chunks(spark, sf_dir):
    return chunking.natural_chunks(markdown.paragraphs(files(spark, sf_dir)))


@query()
def safe_windows(spark, sf_dir):
    return chunking.file_windows(files(spark, sf_dir))


@query(
    f"WITH {sql.FILES}, f AS (SELECT file, len(string_split(md, chr(10))) AS n FROM files WHERE len(string_split(md, chr(10))) >= 5), k AS (SELECT file, n, unnest(range(0, greatest(0, CAST(ceil((n - 500) / 490.0) AS INT)) + 1)) AS i FROM f) "
    "SELECT file, CAST(i * 490 AS BIGINT) AS start, CAST(least(i * 490 + 500, n) AS BIGINT) AS \"end\" FROM k"
)
def llm_windows(spark, sf_dir):
    f = files(spark, sf_dir).select("file", F.size(F.split("md", "\n")).alias("n_lines"))
    return chunking.line_windows(f).select("file", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(
    r"""SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, list_filter(list_transform(
    string_split(regexp_replace(text, '([.!?])\s+([A-ZА-ЯЁ0-9(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents)"""
)
def sentences(spark, sf_dir):
    s = text.sentences(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.md5(F.array_join(s, "|")).alias("digest"))


@query("SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INT) AS n_tokens FROM documents")
def token_counts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.token_count(F.col("text")).alias("n_tokens"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(doc_id % 50 AS INT) END AS first_page, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(least(doc_id % 50, 9) AS INT) END AS least_page FROM documents")
def page_numbers_parse(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 3 == 0, F.lit("not json")).otherwise(F.format_string("[%d, 9]", F.col("doc_id") % 50))
    pages = text.page_numbers(raw)
    return docs(spark, sf_dir).select("doc_id", F.try_element_at(pages, F.lit(1)).alias("first_page"), F.array_min(pages).alias("least_page"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'caf' || chr(233) || ' ' || page_id || '+.pdf' ELSE url_decode(url) END AS name FROM pages")
def decode_filename(spark, sf_dir):
    """Every third name is UTF-8 that was read as Latin-1, quoted."""
    broken = F.concat(F.lit("caf%C3%83%C2%A9%20"), F.col("page_id").cast("string"), F.lit("+.pdf"))
    return readers.table(spark, sf_dir, "pages").select("page_id", text.decoded_filename(F.when(F.col("page_id") % 3 == 0, broken).otherwise(F.col("url"))).alias("name"))


@query(f"WITH {RECORDS} SELECT collection, filename, id FROM r WHERE (collection, filename) NOT IN (SELECT (collection, filename) FROM r WHERE id % 2 = 0)")
def dedup_guard(spark, sf_dir):
    r = records(spark, sf_dir)
    return collections.guarded(r, r.filter("id % 2 = 0")).select("collection", "filename", "id")


@query(f"WITH {RECORDS} SELECT collection, id, CASE WHEN id % 10 = 0 THEN 'new ' || id ELSE text END AS text FROM r UNION ALL SELECT 'docling_new', -1, 'added'")
def upsert_points(spark, sf_dir):
    r = records(spark, sf_dir).select("collection", "id", "text")
    new = r.filter("id % 10 = 0").withColumn("text", F.concat(F.lit("new "), F.col("id").cast("string")))
    more = spark.range(1).select(F.lit("docling_new").alias("collection"), F.lit(-1).cast("long").alias("id"), F.lit("added").alias("text"))
    return collections.upsert(r, new.unionByName(more))


@query(f"WITH {RECORDS} SELECT collection, id, filename FROM r WHERE filename <> 'doc_7'")
def delete_by_filename(spark, sf_dir):
    kept, _ = collections.delete(records(spark, sf_dir), F.col("filename") == "doc_7")
    return kept.select("collection", "id", "filename")


@query(f"WITH {RECORDS} SELECT count(*) AS deleted FROM r WHERE filename = 'doc_7'")
def delete_count(spark, sf_dir):
    return collections.delete(records(spark, sf_dir), F.col("filename") == "doc_7")[1]


def _signed(spark, sf_dir):
    """All points added, and every fourth taken again, in one scan."""
    signs = F.when(F.col("point_id") % 4 == 0, F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(1)))
    return points(spark, sf_dir).withColumn("sign", F.explode(signs))


@query(f"WITH {sql.POINTS.replace('FROM documents', 'FROM documents WHERE doc_id % 4 <> 0')} SELECT collection, term, df FROM terms")
def stats_after_delete(spark, sf_dir):
    return stats.net_terms(stats.term_deltas(_signed(spark, sf_dir), F.col("sign")))


@query(f"WITH {sql.POINTS.replace('FROM documents', 'FROM documents WHERE doc_id % 4 <> 0')} SELECT c.collection, greatest(coalesce(n, 0), 1) AS n, greatest(coalesce(total_dl, 0), 0) AS total_dl FROM (SELECT DISTINCT 'docling_' || source AS collection FROM documents) c LEFT JOIN stats ON stats.collection = c.collection")
def corpus_stats_after_delete(spark, sf_dir):
    return stats.net_corpus(stats.corpus_deltas(_signed(spark, sf_dir), F.col("sign")))


def _split_points(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.select(F.floor(F.col("doc_id") / 10).alias("file"), (F.col("doc_id") % 10 * F.col("doc_id") % 23 + 1).cast("int").alias("line"), F.lit(0.9).alias("confidence"), F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"))


@query()
def split_point_dedup(spark, sf_dir):
    return enrich.dedup_points(_split_points(spark, sf_dir))


@query(
    """WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), l AS (SELECT doc_id, unnest(range(0, len(a))) AS pos, unnest(a) AS line FROM p)
    SELECT doc_id AS file, md5(string_agg(CASE WHEN pos = 0 THEN chr(10) || '## T' || doc_id || chr(10) || chr(10) || line ELSE line END, chr(10) ORDER BY pos)) AS md FROM l GROUP BY doc_id"""
)
def stitch_headers(spark, sf_dir):
    d = docs(spark, sf_dir)
    p = d.select(F.col("doc_id").alias("file"), F.lit(1).alias("line"), F.lit(0.9).alias("confidence"), F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"))
    return enrich.stitch(d.select(F.col("doc_id").alias("file"), F.col("text").alias("md")), p).select("file", F.md5("md").alias("md"))


@query()
def fuzzy_line_match(spark, sf_dir):
    d = docs(spark, sf_dir)
    s = d.select(F.col("doc_id").alias("file"), F.lit(0).alias("snippet_id"), F.lit(0).alias("start"), F.reverse(F.split("text", "\n")).getItem(0).alias("snippet"))
    return enrich.match_lines(d.select(F.col("doc_id").alias("file"), F.col("text").alias("md")), s)


@query(
    f"""WITH {sql.DENSE}, h AS (SELECT query_id, id, score, rank AS position FROM dense), w AS (SELECT h.*, CASE WHEN position % 5 <> 0 THEN 1.0 / (30 - position) END AS rel FROM h),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position % 3, position) AS place FROM w WHERE position % 2 = 1)
    SELECT query_id, id, round(coalesce(rel, 0), 6) AS score, round(coalesce(rel, 0), 6) AS rerank_score, round(score, 6) AS vector_score, place FROM o WHERE place <= 5"""
)
def rerank_apply(spark, sf_dir):
    hits = dense(spark, sf_dir).withColumnRenamed("rank", "position")
    place = (F.col("position") % 3 * 100 + F.col("position")).alias("given")  # the provider's order, which isn't that of relevance
    given = hits.filter("position % 2 = 1").select("query_id", place, (F.col("position") - 1).alias("index"), F.when(F.col("position") % 5 != 0, F.lit(1.0) / (30 - F.col("position"))).alias("relevance"), F.lit("fixed").alias("reason"))
    beyond = hits.select("query_id", F.lit(0).alias("given"), F.lit(99).alias("index"), F.lit(2.0).alias("relevance"), F.lit("beyond").alias("reason")).distinct()
    out = search.apply_rankings(hits, given.unionByName(beyond), 5)
    return out.select("query_id", "id", W6(F.col("score")).alias("score"), W6(F.col("rerank_score")).alias("rerank_score"), W6(F.col("vector_score")).alias("vector_score"), F.col("place").cast("long").alias("place"))


def _vectors(spark, sf_dir):
    kind = F.when(F.col("label") % 3 == 0, "docling_").when(F.col("label") % 3 == 1, "sendable_files_").otherwise("other_")
    e = readers.table(spark, sf_dir, "embeddings")
    return e.select(F.concat(kind, F.col("label").cast("string")).alias("collection"), F.col("vec_id").alias("id"), F.when(F.col("label") % 2 == 0, F.col("embedding")).alias("dense"))


@query(
    """WITH v AS (SELECT CASE label % 3 WHEN 0 THEN 'docling_' WHEN 1 THEN 'sendable_files_' ELSE 'other_' END || label AS collection, CASE WHEN label % 2 = 0 THEN len(embedding) END AS d FROM embeddings)
    SELECT collection, count(*) AS points, CAST(max(d) AS INT) AS dims, CASE WHEN max(d) IS NULL THEN 'unknown' WHEN max(d) = 64 THEN 'ok' ELSE 'mismatch' END AS status FROM v WHERE NOT starts_with(collection, 'other_') GROUP BY collection"""
)
def collection_check(spark, sf_dir):
    return collections.check(_vectors(spark, sf_dir), 64)


_CHECKED = """v AS (SELECT CASE label % 3 WHEN 0 THEN 'docling_' WHEN 1 THEN 'sendable_files_' ELSE 'other_' END || label AS collection, CASE WHEN label % 2 = 0 THEN len(embedding) END AS d FROM embeddings),
    ch AS (SELECT collection, max(d) AS dims FROM v WHERE NOT starts_with(collection, 'other_') GROUP BY collection)"""


@query(f"WITH {_CHECKED} SELECT count(*) AS collections, count_if(dims = 64) AS ok, count_if(dims <> 64) AS mismatched, count_if(dims IS NULL) AS unknown FROM ch")
def check_totals(spark, sf_dir):
    return collections.totals(collections.check(_vectors(spark, sf_dir), 64))


@query(f"WITH {_CHECKED} SELECT collection FROM ch WHERE dims IS DISTINCT FROM 64")
def mismatched_collections(spark, sf_dir):
    return collections.mismatched(_vectors(spark, sf_dir), 64)


@query("SELECT CASE label % 3 WHEN 0 THEN 'docling_' WHEN 1 THEN 'sendable_files_' ELSE 'other_' END || label AS collection, vec_id AS id FROM embeddings")
def reindex_backup(spark, sf_dir):
    return collections.backup(_vectors(spark, sf_dir))


@query("SELECT page_id, unnest([url || '#a', url || '#b']) AS url FROM (SELECT page_id, 'http://x/' || page_id AS url FROM pages) WHERE page_id % 5 <> 0 UNION ALL SELECT page_id, 'http://x/' || page_id FROM pages WHERE page_id % 5 = 0")
def sitemap_urls(spark, sf_dir):
    base = F.concat(F.lit("http://x/"), F.col("page_id").cast("string"))
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>'), base, F.lit("#a</loc></url><url><loc>"), base, F.lit("#b</loc></url></urlset>"))
    maps = readers.table(spark, sf_dir, "pages").select("page_id", F.concat(base, F.lit("/")).alias("base"), F.when(F.col("page_id") % 5 != 0, xml).alias("xml"))
    keyed = readers.sitemap_urls(maps)
    return keyed.select(F.regexp_extract("base", r"/(\d+)/$", 1).cast("long").alias("page_id"), "url")


@query()
def html_markdown(spark, sf_dir):
    return readers.table(spark, sf_dir, "pages").select("page_id", markdown.html_to_markdown(F.col("html")).alias("md"))


@query("SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN true ELSE turn % 5 < 2 END AS flag, greatest(1, length(text) // 4) <= 20 AS short FROM conversations")
def bool_settings(spark, sf_dir):
    c = readers.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", text.truthy(F.get(F.array(*map(F.lit, (" Yes ", "ON", "off", "2", None))), (F.col("turn") % 5).cast("int")), True).alias("flag"), (text.token_count(F.col("text")) <= 20).alias("short"))


@query("SELECT conv_id, turn, 'event: ' || role || chr(10) || 'data: {\"turn\":' || turn || '}' || chr(10) || chr(10) AS frame FROM conversations")
def progress_frames(spark, sf_dir):
    c = readers.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", text.event_frame(F.col("role"), F.struct("turn")).alias("frame"))


@query("SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN 'Title: ' || lang || chr(10) || chr(10) || text ELSE text END) AS dense, md5(CASE WHEN doc_id % 2 = 0 THEN lang || '. ' || text ELSE text END) AS sparse FROM documents")
def model_inputs(spark, sf_dir):
    title = F.when(F.col("doc_id") % 2 == 0, F.col("lang"))
    return docs(spark, sf_dir).select("doc_id", F.md5(text.dense_input(title, F.col("text"))).alias("dense"), F.md5(text.sparse_input(title, F.col("text"))).alias("sparse"))


@query(f"WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents) SELECT doc_id, CAST(len(list_filter(w, lambda x: length(x) >= 2 OR regexp_matches(x, '^\\p{{Nd}}$'))) AS BIGINT) AS n, md5(array_to_string(list_filter(w, lambda x: length(x) >= 2 OR regexp_matches(x, '^\\p{{Nd}}$')), ' ')) AS digest FROM d")
def legacy_tokens(spark, sf_dir):
    found = text.legacy_terms(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(found).cast("long").alias("n"), F.md5(F.array_join(found, " ")).alias("digest"))


@query(r"""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+'), lambda x: length(x) >= 2 OR regexp_matches(x, '^\p{Nd}$'))) AS term FROM documents)
    SELECT doc_id, CAST(('0x' || substr(sha1(term), 1, 8))::UBIGINT AS BIGINT) AS idx, count(*) AS value FROM t GROUP BY doc_id, term""")
def legacy_vector(spark, sf_dir):
    """Raw term frequencies by term index."""
    rows = docs(spark, sf_dir).select("doc_id", F.inline(text.counted(text.legacy_terms(F.col("text")))))
    return rows.select("doc_id", ids.term_index(F.col("term")).alias("idx"), F.col("tf").cast("long").alias("value"))


@query("SELECT doc_id, CAST(len(string_split(text, ' ')) AS INT) AS n FROM documents")
def tokenizer_seam(spark, sf_dir):
    """Token counts by a tokenizer that is passed in."""
    count = text.tokenizer(lambda: lambda t: t.count(" ") + 1)
    return docs(spark, sf_dir).select("doc_id", text.token_count(F.col("text"), count).alias("n"))


@query(f"WITH {sql.DENSE} SELECT query_id, md5(string_agg((rank - 1) || ':' || substr(text, 1, 300), '|' ORDER BY rank)) AS entries FROM dense JOIN documents ON doc_id = id GROUP BY query_id")
def rerank_chat_inputs(spark, sf_dir):
    hits = dense(spark, sf_dir).withColumnRenamed("rank", "position").join(docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), "id")
    # Places count from the query's list, so hits without a text leave gaps in them.
    out = search.chat_inputs(hits).select("query_id", F.transform("entries", lambda e: F.concat_ws(":", e["index"], e["preview"])).alias("x"))
    return out.select("query_id", F.md5(F.array_join("x", "|")).alias("entries"))


@query(f"WITH {sql.DENSE} SELECT query_id, md5(string_agg('Title: ' || lang || chr(10) || chr(10) || text, '|' ORDER BY rank)) AS documents, CAST(least(7, count(*)) AS INT) AS top_n FROM dense JOIN documents ON doc_id = id GROUP BY query_id")
def rerank_api_inputs(spark, sf_dir):
    hits = dense(spark, sf_dir).withColumnRenamed("rank", "position").join(docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("title")), "id")
    return search.api_inputs(hits, 7).select("query_id", F.md5(F.array_join("documents", "|")).alias("documents"), "top_n")


@query(
    """SELECT conv_id * 1000 + turn AS query_id, given, CAST(turn % 9 + given AS INT) AS index, CASE given WHEN 0 THEN 0.5 WHEN 1 THEN 0.25 END AS relevance
    FROM conversations, (SELECT unnest([0, 1, 2]) AS given) WHERE turn % 4 <> 3"""
)
def rankings_of_answers(spark, sf_dir):
    """Answers with relevance_score, with score, and with neither; every fourth can't be read."""
    good = F.format_string('{"rankings": [{"index": %d, "relevance_score": 0.5, "score": 0.9}, {"index": %d, "score": 0.25}, {"index": %d}, {"score": 1.0}]}', F.col("turn") % 9, F.col("turn") % 9 + 1, F.col("turn") % 9 + 2)
    c = readers.table(spark, sf_dir, "conversations")
    answers = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.when(F.col("turn") % 4 == 3, F.lit("sorry")).otherwise(good).alias("answer"))
    return search.rankings_of(answers).select("query_id", "given", "index", "relevance")


_WINDOWS = f"""{sql.FILES}, f AS (SELECT file, string_split(md, chr(10)) AS a FROM files WHERE len(string_split(md, chr(10))) >= 5),
    w AS (SELECT file, a, unnest(range(0, greatest(0, CAST(ceil((len(a) - 500) / 490.0) AS INT)) + 1)) * 490 AS start FROM f)"""


@query(f"WITH {_WINDOWS} SELECT file, start, least(start + 500, len(a)) AS \"end\", md5(array_to_string(a[start + 1 : start + 500], chr(10))) AS text_md5 FROM w")
def header_windows(spark, sf_dir):
    out = headers.windows(files(spark, sf_dir))
    return out.select("file", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.md5("text").alias("text_md5"))


def _third_line(asked: DataFrame) -> DataFrame:
    """Proposes each window's third line, which is the snippet."""
    line = F.get(F.split("text", "\n"), F.lit(2))
    return asked.select("file", "start", (F.col("start") + 3).cast("int").alias("line"), line.alias("snippet"), F.concat(F.lit("T"), F.col("start").cast("string")).alias("title"), F.lit(0.9).alias("confidence"))


@query(
    f"""WITH {_WINDOWS}, p AS (SELECT file, start + 2 AS pos, start FROM w),
    l AS (SELECT file, unnest(range(0, len(a))) AS pos, unnest(a) AS line FROM (SELECT file, string_split(md, chr(10)) AS a FROM files)),
    o AS (SELECT l.*, start FROM l LEFT JOIN p USING (file, pos))
    SELECT file, md5(string_agg(CASE WHEN start IS NOT NULL AND regexp_matches(line, '\\S') AND NOT starts_with(trim(line), '#') THEN chr(10) || '## T' || start || chr(10) || chr(10) || line ELSE line END, chr(10) ORDER BY pos)) AS md FROM o GROUP BY file"""
)
def inject_headers(spark, sf_dir):
    """Every window's third line gets a header, unless it is blank or a heading."""
    return headers.inject_headers(files(spark, sf_dir), _third_line).select("file", F.md5("md").alias("md"))


@query(
    f"""WITH {sql.FILES}, {sql.LINES}, n AS (SELECT pt.file, pt.section_idx, title, parent_text, row_number() OVER (PARTITION BY pt.file ORDER BY pt.section_idx) AS nth FROM pt JOIN secs s ON s.file = pt.file AND s.section_idx = pt.section_idx)
    SELECT file, section_idx, title, CASE WHEN section_idx % 4 <> 1 THEN md5(parent_text) END AS insight FROM n WHERE nth <= 12"""
)
def section_insights(spark, sf_dir):
    answer = lambda asked: asked.filter("section_idx % 4 <> 1").select("file", "section_idx", F.md5("text").alias("insight"))
    out = headers.section_insights(markdown.parents(files(spark, sf_dir)), answer, 12)
    return out.select("file", F.col("section_idx").cast("long").alias("section_idx"), "title", "insight")


@query(
    f"""WITH {sql.FILES}, {sql.LINES}, c AS (SELECT pt.file, row_number() OVER (PARTITION BY pt.file ORDER BY pt.section_idx) - 1 AS chunk_idx, title, parent_text FROM pt JOIN secs s ON s.file = pt.file AND s.section_idx = pt.section_idx)
    SELECT 'docling_acme' AS collection, CAST(('0x' || substr(sha256('acme::' || file || '::' || chunk_idx), 1, 16))::UBIGINT % 9223372036854775808 AS BIGINT) AS id, CAST(file AS VARCHAR) AS filename, title,
    substr(md5(coalesce(title, '') || ':' || parent_text), 1, 16) AS parent_id, md5(parent_text) AS text_md5, CAST(len({sql.TERMS.replace("coalesce(text, '')", "CASE WHEN title <> '' THEN title || '. ' || parent_text ELSE parent_text END")}) AS BIGINT) AS n_tokens FROM c"""
)
def ingest_points(spark, sf_dir):
    """Files of which no section is too long, so every section is one chunk."""
    chunks = ingest.smart_chunks(files(spark, sf_dir), 10_000_000)
    p = ingest.points_of(chunks, F.lit("docling_acme"), F.lit("acme"))
    return p.select("collection", "id", "filename", "title", "parent_id", F.md5("text").alias("text_md5"), F.size("tokens").cast("long").alias("n_tokens"))


def _put(spark, sf_dir, allow):
    r = records(spark, sf_dir).select("collection", "id", "filename", "text")
    new = r.filter("id % 6 = 0").withColumn("id", F.col("id") + 1_000_000).withColumn("text", F.lit("new"))
    more = r.filter("id % 50 = 7").select("collection", (F.col("id") + 2_000_000).alias("id"), F.concat(F.lit("more_"), F.col("filename")).alias("filename"), "text")
    return collections.put_files(r, new.unionByName(more), allow)


_PUT = f"""{RECORDS}, n AS (SELECT collection, id + 1000000 AS id, filename, 'new' AS text FROM r WHERE id % 6 = 0), m AS (SELECT collection, id + 2000000 AS id, 'more_' || filename AS filename, text FROM r WHERE id % 50 = 7)"""


@query(f"WITH {_PUT} SELECT collection, id, filename, md5(text) AS text_md5 FROM r WHERE (collection, filename) NOT IN (SELECT (collection, filename) FROM n) UNION ALL SELECT collection, id, filename, md5(text) FROM n UNION ALL SELECT collection, id, filename, md5(text) FROM m")
def put_files_update(spark, sf_dir):
    return _put(spark, sf_dir, True).points.select("collection", "id", "filename", F.md5("text").alias("text_md5"))


@query(f"WITH {_PUT} SELECT collection, id, sign FROM (SELECT collection, id, -1 AS sign FROM r WHERE (collection, filename) IN (SELECT (collection, filename) FROM n) UNION ALL SELECT collection, id, 1 FROM n UNION ALL SELECT collection, id, 1 FROM m)")
def put_files_signs(spark, sf_dir):
    return _put(spark, sf_dir, True).signed.select("collection", "id", "sign")


@query(f"WITH {_PUT} SELECT DISTINCT collection, filename FROM n")
def put_files_rejected(spark, sf_dir):
    return _put(spark, sf_dir, False).rejected


@query(f"WITH {RECORDS} SELECT collection, id, CASE WHEN id % 10 = 0 THEN 'third' ELSE md5(text) END AS text FROM r")
def upsert_last_wins(spark, sf_dir):
    r = records(spark, sf_dir).select("collection", "id", F.md5("text").alias("text"), F.lit(0).alias("seq"))
    new = r.filter("id % 10 = 0").withColumn("x", F.explode(F.array(F.struct(F.lit(2).alias("seq"), F.lit("second").alias("text")), F.struct(F.lit(3).alias("seq"), F.lit("third").alias("text")))))
    return collections.upsert(r, new.select("collection", "id", "x.text", "x.seq"), F.col("seq")).drop("seq")


@query(f"WITH {RECORDS} SELECT collection, id FROM r WHERE index <> 'SF-7'")
def delete_one_record(spark, sf_dir):
    return collections.delete_one(records(spark, sf_dir), index="SF-7").select("collection", "id")


@query("SELECT doc_id AS id, CASE doc_id WHEN 7 THEN 'described anew' ELSE md5(text) END AS text FROM documents")
def update_one_description(spark, sf_dir):
    r = records(spark, sf_dir).withColumn("filename", F.concat(F.lit("f"), F.col("id").cast("string"))).withColumn("text", F.md5("text"))
    return collections.update_description(r, "f7", "described anew").select("id", "text")


@query("SELECT vec_id AS id FROM embeddings")
def validate_collection(spark, sf_dir):
    return collections.validate(dense_points(spark, sf_dir).withColumn("collection", F.lit("c")), 64).select("id")


@query(f"WITH {RECORDS} SELECT collection, id FROM r WHERE collection <> 'docling_web'")
def recreate_collection(spark, sf_dir):
    return collections.recreate(records(spark, sf_dir), "docling_web").select("collection", "id")


@query(f"WITH {sql.POINTS} SELECT stats.collection, n, CAST(count(*) AS BIGINT) AS n_terms FROM stats JOIN terms ON terms.collection = stats.collection WHERE stats.collection <> 'docling_web' GROUP BY stats.collection, n")
def stats_reset(spark, sf_dir):
    p = written(stats.indexed(points(spark, sf_dir)))
    corpus, terms = stats.reset(stats.corpus_stats(p), stats.term_stats(p), "docling_web")
    return corpus.join(terms.groupBy("collection").agg(F.count(F.lit(1)).alias("n_terms")), "collection").select("collection", "n", "n_terms")


def _reindexed(spark, sf_dir):
    one = docs(spark, sf_dir).select(F.lit("c").alias("collection"), F.col("doc_id").alias("id"), "text", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("title"), F.array(F.lit(1.0)).alias("dense"))
    other = one.limit(1).withColumn("collection", F.lit("d"))
    return collections.reindex_collection(one.unionByName(other), "c", 2, lambda batch: [[float(len(t)), float(t.startswith("Title: "))] for t in batch])


@query("SELECT doc_id AS id, CAST(length(text) + CASE WHEN doc_id % 2 = 0 THEN 9 + length(lang) ELSE 0 END AS DOUBLE) AS x, CASE WHEN doc_id % 2 = 0 OR starts_with(text, 'Title: ') THEN 1.0 ELSE 0.0 END::DOUBLE AS y FROM documents")
def reindex_job(spark, sf_dir):
    """A collection whose vectors have one dimension gets vectors of two, in batches of 50."""
    return _reindexed(spark, sf_dir).points.filter("collection = 'c'").select("id", F.get("dense", F.lit(0)).alias("x"), F.get("dense", F.lit(1)).alias("y"))


@query(f"WITH d AS (SELECT CASE WHEN doc_id % 2 = 0 THEN lang || '. ' || text ELSE text END AS text FROM documents) SELECT 'c' AS collection, count(*) AS n, CAST(sum(len({sql.TERMS})) AS BIGINT) AS total_dl FROM d")
def reindex_stats(spark, sf_dir):
    return _reindexed(spark, sf_dir).corpus.select("collection", "n", "total_dl")


def _first_rung(name, content, options):
    if int(name) % 3:
        raise OSError("busy")
    return f"first {options.formulas} {len(content)}"


def _second_rung(name, content, options):
    if int(name) % 3 == 2:
        raise ValueError("not this one")
    return f"second {options.formulas} {len(content)}"


@query("SELECT CAST(page_id AS VARCHAR) AS filename, CASE page_id % 3 WHEN 0 THEN 'first True ' || octet_length(encode(html)) WHEN 1 THEN 'second False ' || octet_length(encode(html)) END AS md, CASE page_id % 3 WHEN 2 THEN 'ValueError: not this one' END AS error FROM pages")
def converter_ladder(spark, sf_dir):
    """Three tries of one converter, one of another that is asked without formulas; what neither converts is an error row."""
    f = readers.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("filename"), F.col("html").cast("binary").alias("content"))
    return readers.converted_by(f, readers.ladder(_first_rung, _second_rung, wait=0.0, pause=0.0))


_PADS = ["".join(f"\\x{b ^ n:02X}" for b in b"a key".ljust(64, b"\0")) for n in (0x36, 0x5C)]


@query(
    f"""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN 'uploads/acme/documents/doc_' || doc_id END AS path, CAST(900 + doc_id AS VARCHAR) AS t FROM documents)
    SELECT doc_id, 'https://files/' || path || '?expires=' || t || '&signature=' || sha256('{_PADS[1]}'::BLOB || unhex(sha256('{_PADS[0]}'::BLOB || encode(path || chr(10) || t)))) AS url FROM p"""
)
def signed_urls(spark, sf_dir):
    name = F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("doc_"), F.col("doc_id").cast("string")))
    path = F.when(name.isNotNull(), blobs.blob_path(F.lit("acme"), "documents", name))
    return docs(spark, sf_dir).select("doc_id", blobs.signed_url("https://files/", path, "a key", F.col("doc_id")).alias("url"))


@query("SELECT 'uploads/acme/pages/' || page_id AS path, CAST(octet_length(encode(html)) AS BIGINT) AS size, CAST(NULL AS VARCHAR) AS error FROM pages")
def uploaded_blobs(spark, sf_dir):
    from quern.streaming.folders import scratch

    f = readers.table(spark, sf_dir, "pages").select(blobs.blob_path(F.lit("acme"), "pages", F.col("page_id").cast("string")).alias("path"), F.col("html").cast("binary").alias("content"))
    return blobs.upload(f, scratch(spark))


@query("SELECT page_id, page_id % 3 = 0 AS image FROM pages")
def image_rule(spark, sf_dir):
    kind = F.get(F.array(F.lit("image/png"), F.lit("text/html"), F.lit(None)), (F.col("page_id") % 3).cast("int"))
    return readers.table(spark, sf_dir, "pages").select("page_id", text.is_image(kind).alias("image"))


@query(f"WITH {sql.POINTS} SELECT collection, greatest(n, 1) AS n, total_dl FROM stats")
def stream_stats_equals_batch(spark, sf_dir):
    from quern.streaming import ingest
    from quern.streaming.folders import scratch

    folder = scratch(spark)
    ingest.ingest(readers.streamed_table(spark, sf_dir, "documents"), f"{folder}/deltas", f"{folder}/checkpoint").awaitTermination()
    return ingest.net(spark, f"{folder}/deltas")[0]
