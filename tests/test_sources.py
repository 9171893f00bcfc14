"""Sources, conversion, settings, files and streaming."""

import hashlib
import hmac

import duckdb
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quern.operators import markdown
from quern.plans import registry
from quern.sources import blobs, readers
from quern.streaming import ingest


def test_html(spark):
    html = "<head><title>x</title></head><nav>menu</nav><h1>A &amp; B</h1><p>one<br>two</p><ul><li>i</li></ul><!-- c --><script>1</script>"
    df = spark.createDataFrame([(html,), (None,)], "h string").select(markdown.html_to_markdown(F.col("h")).alias("md"))
    assert [r.md for r in df.collect()] == ["# A & B\n\none\n\ntwo\n\n- i", ""]


def test_uploads(spark, tmp_path):
    (tmp_path / "a.html").write_text("<h2>T</h2><p>x</p>")
    (tmp_path / "b.md").write_text("# T\nx <p>")
    out = {r.filename: r.md for r in readers.converted(readers.uploaded_files(spark, str(tmp_path))).collect()}
    assert out == {"a.html": "## T\n\nx", "b.md": "# T\nx <p>"}


def test_sitemap(spark):
    xml = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>http://a/1</loc></url><url><loc>http://a/2</loc></url></urlset>'
    df = spark.createDataFrame([("http://a/", xml), ("http://b//", None)], "base string, xml string")
    assert sorted(r.url for r in readers.sitemap_urls(df).collect()) == ["http://a/1", "http://a/2", "http://b"]


def test_settings():
    s = readers.Settings.of({"DIMS": "64", "USE_RERANKER": " Yes "})
    assert (s.dims, s.use_reranker, s.depth(5), s.depth(5, 7), readers.Settings().depth(5)) == (64, True, 20, 7, 5)


def test_stream_adds_and_retracts(spark, tmp_path):
    schema = "doc_id long, source string, text string"
    spark.createDataFrame([(1, "s", "aa bb bb"), (2, "s", "aa cc")], schema).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(1, "s", "aa bb bb")], schema).write.parquet(str(tmp_path / "gone"))
    for k, (folder, sign) in enumerate((("in", 1), ("gone", -1))):
        source = spark.readStream.schema(schema).parquet(str(tmp_path / folder))
        ingest.ingest(source, str(tmp_path / f"deltas{k}"), str(tmp_path / f"check{k}"), sign).awaitTermination()
    read = lambda name: spark.read.parquet(str(tmp_path / f"deltas0/{name}")).union(spark.read.parquet(str(tmp_path / f"deltas1/{name}")))
    corpus, terms = read("corpus"), read("terms")
    from quern.operators import stats

    assert [tuple(r) for r in stats.net_corpus(corpus).collect()] == [("docling_s", 1, 2)]
    assert sorted((r.term, r.df) for r in stats.net_terms(terms).collect()) == [("aa", 1), ("cc", 1)]


@pytest.mark.parametrize("layout", ["file", "folder", "partitions"])
def test_stream_reads_a_table_in_any_layout(spark, tmp_path, layout):
    """Documents as one file, as a folder of part files, and below a folder for each language; another table lies beside them."""
    made = tmp_path / "made 1%"
    rows = [(k, f"aa b{k} b{k}" if k % 5 else None, "en" if k % 2 else "de", ("s", "t", "", None)[k % 4]) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.limit(3).write.parquet(str(made / "pages.parquet"))
    if layout == "file":
        docs.coalesce(1).write.parquet(str(tmp_path / "one"))
        next((tmp_path / "one").glob("part-*.parquet")).rename(made / "documents.parquet")
    else:
        docs.repartition(3).write.partitionBy(*["lang"] * (layout == "partitions")).parquet(str(made / "documents.parquet"))
    files = str(made / "documents.parquet") + {"file": "", "folder": "/*.parquet", "partitions": "/*/*.parquet"}[layout]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{files}', hive_partitioning = true)")
    want = con.sql(registry.ORACLE_SQL["stream_stats_equals_batch"]).fetchall()
    got = registry.QUERIES["stream_stats_equals_batch"](spark, str(made))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(want) == 4
    batches = spark.read.parquet(str(made / "documents.parquet"))
    stream = readers.streamed_table(spark, str(made), "documents")
    assert stream.isStreaming and stream.schema == batches.schema
    seen = []
    stream.writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(seen, key=str) == sorted(batches.collect(), key=str)


def test_stream_of_a_table_without_rows_and_of_none(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "empty/documents.parquet"))
    assert registry.QUERIES["stream_stats_equals_batch"](spark, str(tmp_path / "empty")).collect() == []
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        registry.QUERIES["stream_stats_equals_batch"](spark, str(tmp_path / "none"))


def test_blobs(spark, tmp_path):
    root = tmp_path.as_uri()
    files = spark.createDataFrame([("a/b.txt", b"abc"), ("c.txt", b"")], "path string, content binary")
    assert sorted(tuple(r) for r in blobs.upload(files, root).collect()) == [("a/b.txt", 3, None), ("c.txt", 0, None)]
    assert (tmp_path / "a/b.txt").read_bytes() == b"abc"
    gone = spark.createDataFrame([("a/b.txt",), ("none",)], "path string")
    assert {r.path: r.deleted for r in blobs.remove(gone, root).collect()} == {"a/b.txt": True, "none": False}
    assert not (tmp_path / "a/b.txt").exists()


def test_signatures(spark):
    df = spark.createDataFrame([("é/x",), (None,)], "path string").withColumn("s", blobs.signature("kéy", F.col("path")))
    assert [r.s for r in df.collect()] == [hmac.new("kéy".encode(), "é/x".encode(), hashlib.sha256).hexdigest(), None]
    made = df.select("path", blobs.signed_url("http://f", F.col("path"), "k", F.lit(100)).alias("u"))
    parts = made.select("path", F.regexp_extract("u", r"expires=(\d+)", 1).cast("long").alias("t"), F.regexp_extract("u", "signature=(.*)", 1).alias("s")).filter("path IS NOT NULL")
    for now, path, want in ((1000, F.col("path"), True), (1001, F.col("path"), False), (1000, F.lit("y"), False)):
        assert parts.select(blobs.is_valid(path, F.col("t"), F.col("s"), "k", F.lit(now)).alias("ok")).first().ok is want
