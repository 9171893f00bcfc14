"""The retrieval operators on small fixtures."""

import pytest
from pyspark.sql import functions as F

from quern.operators import collections, enrich, markdown, search, stats, views


def test_sections(spark):
    mds = {
        1: ("pre\n# A\np1\n\np2", [(None, ["pre"]), ("A", ["p1", "p2"])]),
        2: ("# A\n```\n# not a heading\n\nx\n```\ntail", [("A", ["```\n# not a heading\n\nx\n```\ntail"])]),
        3: ("# A\n```\n# B\ntext", [("A", ["```\n# B\ntext"])]),
        4: ("# A\n# B\nt", [("A", []), ("B", ["t"])]),
        5: ("#nohash\n####### seven\n  # indented", [(None, ["#nohash\n####### seven\n  # indented"])]),
        6: ("", []),
    }
    df = spark.createDataFrame([(k, md) for k, (md, _) in mds.items()], "file int, md string")
    found = {k: {} for k in mds}
    for r in markdown.sections(df).collect():
        found[r.file][r.section_idx] = (r.title, [])
    for r in markdown.paragraphs(df).orderBy("para_idx").collect():
        found[r.file][r.section_idx][1].append(r.text)
    assert {k: [v[i] for i in sorted(v)] for k, v in found.items()} == {k: e for k, (_, e) in mds.items()}


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, id string, score double, rank int")


@pytest.mark.parametrize(
    ("weights", "expected"),
    [((1.0, 1.0), [("b", 0.032522), ("a", 0.016393), ("c", 0.016129)]), ((0.8, 1.2), [("b", 0.032575), ("c", 0.019355), ("a", 0.013115)])],
)
def test_fuse(spark, weights, expected):
    dense, sparse = hits(spark, [(1, "a", 0.9, 1), (1, "b", 0.8, 2)]), hits(spark, [(1, "b", 7.0, 1), (1, "c", 6.0, 2)])
    w = spark.createDataFrame([(1, *weights)], "query_id long, w_dense double, w_sparse double")
    rows = search.fuse(dense, sparse, w).orderBy("position").collect()
    assert [(r.id, round(r.rrf_score, 6)) for r in rows] == expected
    assert {r.id: r.score for r in rows}["b"] == 0.8


def test_dedup_parents(spark):
    rows = [(1, i, p, f"t{i}", f"parent {p}" if p else None, i) for i, p in ((1, "P"), (2, "Q"), (3, "P"), (4, None), (5, None))]
    df = spark.createDataFrame(rows, "query_id long, id long, parent_id string, text string, parent_text string, position int")
    df = df.withColumn("parent_text", F.coalesce("parent_text", F.lit("of nobody")))  # a hit without a parent keeps its text
    out = search.dedup_parents(df, 4).orderBy("position").collect()
    assert [(r.id, r.text) for r in out] == [(1, "parent P"), (2, "parent Q"), (4, "t4")]


def test_rankings_fail_open(spark):
    h = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2)], "query_id long, id long, score double, position int")
    kind = "query_id long, given int, index int, relevance double, reason string"
    none = spark.createDataFrame([], kind)
    assert [r.id for r in search.apply_rankings(h, none, 2).orderBy("place").collect()] == [10, 11]
    given = spark.createDataFrame([(1, 0, 1, 0.7, "x"), (1, 1, 5, 0.9, "beyond")], kind)
    assert [(r.id, r.vector_score) for r in search.apply_rankings(h, given, 2).collect()] == [(11, 0.8)]
    # The provider's order counts, not that of relevance; none given counts as 0; the first of two counts.
    given = spark.createDataFrame([(1, 0, 1, None, "x"), (1, 1, 0, 0.9, "y"), (1, 2, 1, 0.99, "z")], kind)
    assert [(r.id, r.score) for r in search.apply_rankings(h, given, 2).orderBy("place").collect()] == [(11, 0.0), (10, 0.9)]


@pytest.mark.parametrize(
    ("values", "expected"), [([], "SF-1"), (["SF-1", "SF-3"], "SF-4"), (["SF-12-3", "SF-x", None], "SF-13")]
)
def test_next_index(spark, values, expected):
    df = spark.createDataFrame([(v,) for v in values], "index string")
    assert collections.next_index(df).first().next_index == expected


def points(spark, rows):
    return spark.createDataFrame(rows, "collection string, point_id long, tokens array<string>")


def test_retraction(spark):
    p = points(spark, [("c", 1, ["a", "b", "b"]), ("c", 2, ["a", "a"])])
    gone = points(spark, [("c", 1, ["a", "b", "b"])])
    more = points(spark, [("c", 2, ["a", "a"])])
    deltas = stats.corpus_deltas(p).union(stats.corpus_deltas(gone, -1))
    terms = stats.term_deltas(p).union(stats.term_deltas(gone, -1))
    assert [tuple(r) for r in stats.net_corpus(deltas).collect()] == [("c", 1, 2)]
    assert [tuple(r) for r in stats.net_terms(terms).collect()] == [("c", "a", 1)]
    assert [tuple(r) for r in stats.net_corpus(deltas.union(stats.corpus_deltas(more, -1))).collect()] == [("c", 1, 0)]
    assert stats.net_terms(terms.union(stats.term_deltas(more, -1))).count() == 0


def test_split_points(spark):
    df = spark.createDataFrame([("f", n, 0.9, f"T{n}") for n in (6, 1, 5, 3)], "file string, line int, confidence double, title string")
    assert sorted(r.line for r in enrich.dedup_points(df).collect()) == [1, 5]
    surer = df.union(spark.createDataFrame([("f", 2, 0.95, "S")], df.schema))
    assert sorted((r.line, r.title) for r in enrich.dedup_points(surer).collect()) == [(2, "S"), (6, "T6")]


def test_stitch_and_match(spark):
    f = spark.createDataFrame([("f", "one line\n# two\nthree words here")], "file string, md string")
    p = spark.createDataFrame([("f", 1, 0.9, "H"), ("f", 6, 0.9, "none")], "file string, line int, confidence double, title string")
    assert enrich.stitch(f, p).first().md == "\n## H\n\none line\n# two\nthree words here"
    s = spark.createDataFrame([("f", 0, 0, "Three  words"), ("f", 1, 0, "zzzz")], "file string, snippet_id int, start int, snippet string")
    assert [tuple(r) for r in enrich.match_lines(f, s).collect()] == [("f", 0, 2, 0.95)]


def store_rows(spark):
    return spark.createDataFrame(
        [("c", 1, "f1", "x", [1.0, 0.0]), ("c", 2, "f2", "y", [0.0, 1.0])], "collection string, id long, filename string, text string, dense array<double>"
    )


def test_store(spark, tmp_path):
    store = collections.Store(spark, str(tmp_path / "points"))
    assert store.read() is None
    p = store_rows(spark)
    store.write(p)
    store.write(collections.upsert(store.read(), p.filter("id = 2").withColumn("text", F.lit("z"))))
    assert {r.id: r.text for r in store.read().collect()} == {1: "x", 2: "z"}
    kept, n = collections.delete(store.read(), F.col("filename") == "f1")
    assert n.first().deleted == 1 and kept.count() == 1


def test_guards(spark):
    p = store_rows(spark)
    with pytest.raises(ValueError):
        collections.delete_one(p)
    with pytest.raises(LookupError):
        collections.delete_one(p, filename="none")
    with pytest.raises(collections.SchemaMismatch):
        collections.validate(p, 3)
    out = collections.update_description(p, "f1", "new")
    assert {r.id: r.text for r in out.collect()} == {1: "new", 2: "y"}
    assert collections.backup(p).columns == ["collection", "id", "filename", "text"]


def test_content_by_page(spark):
    rows = [(1, "f", "A", "u", [3], "last"), (2, "f", "B", "u", [1, 9], "first"), (3, "f", "A", "u", None, "none"), (4, "", "x", "u", None, "skip")]
    df = spark.createDataFrame(rows, "id long, filename string, title string, url string, page_numbers array<int>, text string")
    out = views.document_content(df).collect()
    assert [(r.content, r.section_titles) for r in out] == [("first last none", ["B", "A"])]
    assert [tuple(r) for r in views.document_list(df).collect()] == [("f", "A", "u")]


def test_dense_topk_in_blocks(spark):
    vectors = [[float(i % 7), float(i % 5), float(i % 3)] for i in range(60)]
    points = spark.createDataFrame(list(enumerate(vectors)), "id long, dense array<double>")
    queries = points.filter("id % 2 = 0").select(F.col("id").alias("query_id"), F.col("dense").alias("v"))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    want = {q: sorted(range(60), key=lambda i: (-dot(vectors[i], vectors[q]), i))[:4] for q in range(0, 60, 2)}
    for block in (1, 7, 64):
        got = {}
        for r in search.dense_topk(points, queries, 4, block).orderBy("rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        assert got == want
