"""Chunks, headers, ingestion, reindexing and converters against brute force and by their properties."""

import difflib
import math
import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F
from quern.functions import text
from quern.operators import chunking, collections, enrich, headers, ingest, markdown, search, stats
from quern.sources import readers


def words(r, n):
    return " ".join("".join(r.choices("abcdé", k=r.randint(1, 9))) for _ in range(n))


def prose(r, paras):
    return [" ".join(words(r, r.randint(1, 9)).capitalize() + r.choice(".!?,") for _ in range(r.randint(0, 7))) for _ in range(paras)]


# -- chunks


def test_split_text_keeps_the_limit_and_the_text():
    r = random.Random(2)
    for _ in range(600):
        given, limit = "\n\n".join(prose(r, r.randint(0, 6))).replace(", ", r.choice([", ", "\n"])), r.randint(1, 40)
        pieces = chunking.split_text(given, limit)
        assert "".join("".join(pieces).split()) == "".join(given.split())
        for p in pieces:  # only what can't be split is too long
            assert chunking.count(p) <= limit or not any(cut in p for cut, _ in chunking.SEPARATORS)
        if "\n\n" in given and all(chunking.count(p) <= limit for p in given.split("\n\n")):
            for a, b in zip(pieces, pieces[1:], strict=False):  # no two paragraphs stand apart that fit together
                joined = f"{a}\n\n{b}"
                assert joined not in given or chunking.count(joined) > limit


def test_split_text_counts_by_the_tokenizer():
    by_word = lambda t: len(t.split())
    assert chunking.split_text("a b c\n\nd e\n\nf", 3, by_word) == ["a b c", "d e\n\nf"]
    assert chunking.safe(lambda t: 1 // 0)("abcdefgh") == 2


def test_packed_sentences():
    r = random.Random(3)
    for _ in range(800):
        paras = prose(r, r.randint(0, 7))
        soft = r.randint(1, 40)
        hard = soft + r.randint(0, 40)
        chunks = chunking.pack_sentences(paras, soft, hard)
        every = [s for p in paras for s in chunking.sentences(p)]
        assert "".join("".join(c[0] for c in chunks).split()) == "".join("".join(every).split())
        assert [c[3] for c in chunks] == [0, *(c[4] + 1 for c in chunks)][: len(chunks)]
        if chunks:
            assert chunks[-1][4] == len(every) - 1
        for body, first, last, a, b in chunks:
            assert first <= last and "".join(body.split()) == "".join("".join(every[a : b + 1]).split())
            parts = body.split("\n\n")
            assert sum(map(chunking.count, parts)) <= hard or len(parts) == 1


def test_paragraph_windows():
    r = random.Random(4)
    for _ in range(600):
        given, size = "".join(r.choice(["\n\n", "\n", "ab ", "c"]) for _ in range(r.randint(0, 60))), r.randint(2, 30)
        windows = chunking.paragraph_windows(given, size)
        assert "".join("".join(windows).split()) == "".join(given.split())
        at = 0
        for k, w in enumerate(windows):  # in order, with line ends between them at most, and no longer than two sizes
            found = given.index(w, at)
            assert set(given[at:found]) <= {"\n"}
            at = found + len(w)
            assert len(w) <= 2 * size and (at % size == 0 or given[at : at + 2] == "\n\n" or k == len(windows) - 1)


def brute_sections(md):
    out, open_, code = [], None, False
    for line in md.splitlines():
        head = re.match(r"^(#{1,6})\s+(.*)$", line)
        fence = line.strip().startswith("```")
        code ^= fence
        if not code and not fence and (head or not line.strip()):
            if head:
                out.append((head[2].strip() or None, len(head[1]), []))
            open_ = None
            continue
        if not out:
            out.append((None, 1, []))
        if open_ is None:
            open_ = []
            out[-1][2].append(open_)
        open_.append(line)
    return [(t, n, [x for x in ("\n".join(p).strip() for p in ps) if x]) for t, n, ps in out]


def test_parse_against_a_line_walk():
    r = random.Random(5)
    lines = ["# A", "## ", "#x", "####### s", "```", "  ```py", "", "  ", "text", "more  ", "  # in", "```a```"]
    for _ in range(1500):
        md = "\n".join(r.choices(lines, k=r.randint(0, 14)))
        assert [(s["title"], s["level"], s["paras"]) for s in markdown.parse(md)] == brute_sections(md), md


def test_plain_chunks(spark):
    pages = [(3, "a" * 40), (1, "b" * 40), (None, " "), (1, "c" * 400), (2, "d")]
    df = spark.createDataFrame([("f", pages)], "file string, pages array<struct<page: int, text: string>>")
    rows = ingest.plain_chunks(df, 25).orderBy("chunk_idx").collect()
    assert [(r.text, r.page_numbers) for r in rows] == [("a" * 40 + "\n\n" + "b" * 40, [1, 3]), ("c" * 400, [1]), ("d", [2])]
    assert [r.parent_id for r in rows] == ["docling_0", "docling_1", "docling_2"] and all(r.text == r.parent_text for r in rows)


# -- text


def test_steady_characters_are_left_alone_by_nfkc(spark):
    steady = re.compile(f"[{re.sub(r'\\x\{([0-9A-F]+)\}', lambda m: '\\U' + m[1].zfill(8), text.STEADY)}]")
    for n in range(0x110000):
        if not 0xD800 <= n < 0xE000 and steady.match(chr(n)):
            for before in ("", "e", "か", "ᄀ", "가", "ا"):
                given = before + chr(n)
                assert unicodedata.normalize("NFKC", given) == before + unicodedata.normalize("NFKC", chr(n)) == unicodedata.normalize("NFKC", before) + chr(n), hex(n)
    given = ["plain", "ﬁne ①", "é", "é", "漢字 ｶﾞ", None]
    rows = spark.createDataFrame([(t,) for t in given], "t string").select(text.nfkc(F.col("t")).alias("t")).collect()
    assert [r.t for r in rows] == [t and unicodedata.normalize("NFKC", t) for t in given]


def test_counted(spark):
    r = random.Random(6)
    given = [[], ["b"], *([r.choice(["a", "b", "é", "cc"]) for _ in range(n)] for n in (2, 9, 200))]
    rows = spark.createDataFrame([(g,) for g in given], "t array<string>").select(text.counted(F.col("t")).alias("c")).collect()
    assert [[tuple(x) for x in r.c] for r in rows] == [sorted(Counter(g).items()) for g in given]


def test_an_index_and_asked_terms_give_the_same_search(spark):
    p = spark.createDataFrame([("c", 1, ["a", "b", "b"]), ("c", 2, ["z"]), ("c", 3, []), ("d", 4, ["a"])], "collection string, point_id long, tokens array<string>")
    q = spark.createDataFrame([("c", 1, ["b", "a", "q"]), ("c", 2, [])], "collection string, query_id long, tokens array<string>")
    assert sorted((r.point_id, r.dl, [tuple(t) for t in r.terms]) for r in stats.indexed(p).collect()) == [(1, 3, [("a", 1), ("b", 2)]), (2, 1, [("z", 1)]), (3, 0, []), (4, 1, [("a", 1)])]
    assert sorted(map(tuple, stats.term_stats(p, q).collect())) == [("c", "a", 1), ("c", "b", 1)]
    scores = []
    for rows in (p, stats.indexed(p)):
        corpus = stats.corpus_stats(rows)
        for terms in (stats.term_stats(rows), stats.term_stats(rows, q)):
            got = search.sparse_topk(stats.postings(rows, corpus), stats.query_weights(q, corpus, terms), 5).collect()
            scores.append([tuple(r) for r in got])
    idf, norm = math.log(4 / 1.5), lambda f: f * 2.2 / (f + 1.2 * (0.25 + 0.75 * 3 / (4 / 3)))
    assert all(s == scores[0] for s in scores) and scores[0][0][:2] == (1, 1) and math.isclose(scores[0][0][2], idf * (norm(1) + norm(2)), abs_tol=1e-6)


# -- headers


def brute_match(md, start, snippet):
    flat = lambda t: " ".join(t.lower().split())
    best = (0.6, None)
    for k, line in enumerate(md.split("\n")[start : start + 100], start):
        x, y = flat(snippet), flat(line)
        if y and x:
            score = 0.95 if x in y or y in x else difflib.SequenceMatcher(None, x[:100], y[:100]).ratio()
            if score > best[0]:
                best = (score, k)
    return best[1]


def test_fuzzy_matches_against_brute_force(spark):
    r = random.Random(7)
    files, asked, want = [], [], {}
    for f in range(12):
        rows = [words(r, r.randint(0, 6)) for _ in range(130)]
        md = "\n".join(rows)
        files.append((f, md))
        for s in range(6):
            start, at = r.randint(0, 40), r.randrange(130)
            snippet = rows[at][: r.randint(0, 30)] + r.choice(["", "zz", "  "])
            asked.append((f, s, start, snippet))
            if snippet and (k := brute_match(md, start, snippet)) is not None:
                want[f, s] = k
    got = enrich.match_lines(spark.createDataFrame(files, "file int, md string"), spark.createDataFrame(asked, "file int, snippet_id int, start int, snippet string"))
    assert {(x.file, x.snippet_id): x.line for x in got.collect() if asked[x.file * 6 + x.snippet_id][3].strip()} == {k: v for k, v in want.items() if asked[k[0] * 6 + k[1]][3].strip()}


def test_split_points_against_brute_force(spark):
    r = random.Random(8)
    rows = [(f, r.randint(1, 40), r.choice([0.9, 0.95]), f"T{k}") for f in range(20) for k in range(8)]
    want = []
    for f in range(20):
        kept = []
        for line, sure, title in sorted((x[1:] for x in rows if x[0] == f)):
            if not kept or line - kept[-1][0] > 3:
                kept.append((line, sure, title))
            elif sure > kept[-1][1]:
                kept[-1] = (line, sure, title)
        want += [(f, *k) for k in kept]
    got = enrich.dedup_points(spark.createDataFrame(rows, "file int, line int, confidence double, title string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_inject_headers(spark):
    md = "\n".join(["first line of it", "", "a second paragraph here", "and more", "", "the third thing", "tail"])
    files = spark.createDataFrame([("f", md), ("short", "a\nb")], "file string, md string")
    answers = [("f", 0, 1, "first line of", "One"), ("f", 0, 4, "the third thing", "Three"), ("f", 0, 2, "qqqq wwww", "Lost")]

    def provider(asked):
        assert [tuple(r) for r in asked.select("file", "start", "end").collect()] == [("f", 0, 7)]
        return spark.createDataFrame([(*a, 0.9) for a in answers], "file string, start int, line int, snippet string, title string, confidence double")

    got = {r.file: r.md for r in headers.inject_headers(files, provider).collect()}
    assert got["short"] == "a\nb"
    assert got["f"] == md.replace("first line", "\n## One\n\nfirst line").replace("the third", "\n## Three\n\nthe third")
    assert headers.inject_headers(files, None).count() == 2


# -- ingestion


def test_ingest_guards_replaces_and_takes_back_statistics(spark):
    def run(files, points, **more):
        df = spark.createDataFrame(files, "file string, md string")
        return ingest.ingest(df, points, F.lit("c"), F.lit("acme"), embed=lambda ts: [[float(len(t))] for t in ts], **more)

    none = ingest.points_of(ingest.smart_chunks(spark.createDataFrame([], "file string, md string")), F.lit("c"), F.lit("acme"))
    one = run([("f", "# T\nalpha beta\n\n# U\nbeta"), ("g", "plain words")], none)
    assert sorted((r.filename, r.title, r.text, r.dense) for r in one.points.collect()) == [("f", "T", "alpha beta", [20.0]), ("f", "U", "beta", [14.0]), ("g", None, "plain words", [11.0])]
    two = run([("f", "# T\ngamma")], one.points)
    assert [tuple(r) for r in two.rejected.collect()] == [("c", "f")] and two.points.count() == 3 and two.term_deltas.count() == 0
    three = run([("f", "# T\ngamma")], one.points, allow_update=True)
    assert three.points.count() == 2 and three.rejected.count() == 0
    net = stats.net_terms(one.term_deltas.unionByName(three.term_deltas))
    assert sorted((r.term, r.df) for r in net.collect()) == sorted((r.term, r.df) for r in stats.term_stats(three.points.select("collection", F.col("id").alias("point_id"), "tokens")).collect())
    assert [tuple(r) for r in stats.net_corpus(one.corpus_deltas.unionByName(three.corpus_deltas)).select("n").collect()] == [(2,)]


def test_smart_chunks_by_sentences(spark):
    files = spark.createDataFrame([("f", "# T\nOne here. Two there.\n\nThree."), ("g", " \n"), ("h", "# only a heading")], "file string, md string")
    rows = ingest.smart_chunks(files, 3, natural=True, soft=2).orderBy("chunk_idx").collect()
    assert [(r.file, r.text, r.section_title) for r in rows if r.file == "f"] == [("f", "One here.", "T"), ("f", "Two there.", "T"), ("f", "Three.", "T")]
    assert [(r.file, r.text, r.parent_id) for r in rows if r.file != "f"] == [("h", "# only a heading", "docling_0")]


def test_embedding_failures(spark):
    rows = spark.range(0, 120, 1, 1).select("id", F.format_string("t%d", "id").alias("text"))
    seen = []

    def embed(texts):
        if "t60" in texts:
            raise OSError("down")
        return [[float(t[1:])] for t in texts]

    out = collections.embedded(rows, embed, F.col("text")).collect()
    seen = {r.id: (r.dense, r.failed) for r in out}
    assert all(seen[i] == ((None, True) if 50 <= i < 100 else ([float(i)], False)) for i in range(120))
    with pytest.raises(Exception, match="down"):
        collections.embedded(rows, embed, F.col("text"), strict=True).collect()


def test_store_writers(spark, tmp_path):
    store = collections.Store(spark, str(tmp_path / "points"))
    p = spark.createDataFrame([("c", 1, "x")], "collection string, id long, text string")
    first = store.write(p)
    second = store.write(p.withColumn("text", F.lit("y")), after=first)
    with pytest.raises(collections.Conflict):
        store.write(p, after=first)
    assert store.versions()[-1] == (2, second) and store.read().first().text == "y"


def test_converter_ladder():
    calls = []

    def rung(name, fails):
        def convert(file, content, options):
            calls.append((name, options.formulas))
            if fails:
                raise OSError(name)
            return name

        return convert

    ladder = readers.ladder(rung("a", True), rung("b", True), rung("c", False), wait=0, pause=0)
    assert ladder("f", b"", readers.ConverterOptions()) == "c"
    assert calls == [("a", True)] * 3 + [("b", False), ("c", False)]
    with pytest.raises(OSError, match="b"):
        readers.ladder(rung("a", True), rung("b", True), wait=0, pause=0)("f", b"", readers.ConverterOptions())


def test_saved_markdown(spark, tmp_path):
    readers.save_markdown(spark.createDataFrame([("a.pdf", "# T\nx")], "filename string, md string"), str(tmp_path / "out"))
    assert {r.file for r in spark.read.text(str(tmp_path / "out")).select("file").collect()} == {"a_output.md"}


def test_query_vectors_are_kept():
    made = []
    v = ingest.QueryVectors(lambda ts: [made.append(ts[0]) or [float(len(ts[0]))] for _ in ts], size=2)
    assert v.get("  ") == [] and v.get(" ab ") == [2.0] and v.get("ab") == [2.0] and made == ["ab"]
    v.get("b"), v.get("ab"), v.get("c"), v.get("ab")
    assert made == ["ab", "b", "c"]
    v.get("b")
    assert made == ["ab", "b", "c", "b"]


def test_snapshot(spark):
    calls = []
    s = ingest.StatsSnapshot(lambda: calls.append(1) or spark.range(1))
    s.of("a"), s.of("a")
    assert len(calls) == 1 and s.of("b").count() == 1 and len(calls) == 2


def test_reranker_choice_and_fail_open(spark):
    on = readers.Settings.of({"USE_OPENAI_RERANK": "no", "USE_JINA_RERANK": "1", "JINA_KEY": "k"})
    assert search.choose_provider(on) == "jina" and search.choose_provider(on, "openai") is None and search.choose_provider(readers.Settings()) is None
    h = spark.createDataFrame([(1, "a", 0.9, 1, "t"), (1, "b", 0.8, 2, "u"), (2, "c", 0.7, 1, "v")], "query_id long, id string, score double, position int, text string")

    def sorry(shown):
        assert {r.query_id for r in shown.collect()} == {1}
        return search.rankings_of(shown.select("query_id", F.lit("no json").alias("answer")).distinct())

    for provider in (None, sorry):
        assert [(r.query_id, r.id, r.place) for r in search.rerank(h, provider, 2).orderBy("query_id", "place").collect()] == [(1, "a", 1), (1, "b", 2), (2, "c", 1)]
