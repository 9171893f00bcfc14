"""Hand-computed values of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from quern.functions import ids, scoring, text
from quern.operators.chunking import line_windows, pack_sentences, paragraph_windows, split_text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("漢字abc", ["漢", "字", "漢字", "abc"]),
        ("abc漢字", ["abc漢字"]),
        ("The cat I 7 x", ["cat", "7"]),
        ("ＡＢＣ", ["abc"]),
        ("and the of", []),
        ("", []),
        (None, []),
    ],
)
def test_terms(spark, given, expected):
    df = spark.createDataFrame([(given,)], "t string").select(text.terms(F.col("t")).alias("x"))
    assert df.first().x == expected


def test_ids(spark):
    point = lambda *p: one(spark, ids.point_id(*(F.lit(x) for x in p)))
    assert point("c1", "a", 0) == 2211789108994924111
    assert point("c1", "sendable", "a.png") == 1492123512531278800
    assert point("c1", "файл.pdf", 3) == 3400286870886117363
    assert one(spark, ids.term_index(F.lit("abc"))) == 2845392438
    assert one(spark, ids.term_index(F.lit("поиск"))) == 315284641
    assert one(spark, ids.parent_id(F.lit("Intro"), F.lit("hello"))) == "cf5918da60eb4d40"
    assert one(spark, ids.parent_id(F.lit(None).cast("string"), F.lit("hello"))) == "2d46ec65b7761c56"


@pytest.mark.parametrize(("n", "df", "expected"), [(1, 0, 1.386294), (10, 2, 1.481605), (10, 10, 0.046520), (10, 12, -0.127833)])
def test_idf(spark, n, df, expected):
    assert one(spark, scoring.idf(F.lit(n), F.lit(df))) == pytest.approx(expected, abs=1e-6)


@pytest.mark.parametrize(("tf", "dl", "avg", "expected"), [(1, 200, 200, 1.0), (2, 200, 200, 1.375), (1, 10, 200, 1.635688), (1, 5, 0, 0.379310)])
def test_tf_norm(spark, tf, dl, avg, expected):
    assert one(spark, scoring.tf_norm(F.lit(tf), F.lit(dl), F.lit(float(avg)))) == pytest.approx(expected, abs=1e-6)


def test_small_text_functions(spark):
    assert one(spark, text.sentences(F.lit("One. Two? three! Four"))) == ["One.", "Two? three!", "Four"]
    assert one(spark, text.header(F.lit("A"))) == "## A"
    assert one(spark, text.header(F.lit("# A"))) == "# A"
    assert one(spark, text.truthy(F.lit(" Yes "), False)) is True
    assert one(spark, text.truthy(F.lit(None).cast("string"), True)) is True
    assert one(spark, text.page_numbers(F.lit("[3, 1]"))) == [3, 1]
    assert one(spark, text.page_numbers(F.lit("no"))) is None
    assert one(spark, text.token_count(F.lit("abc"))) == 1
    assert one(spark, text.decoded_filename(F.lit("a%20b+c.pdf"))) == "a b+c.pdf"
    assert one(spark, text.decoded_filename(F.lit("Ã©.pdf"))) == "é.pdf"


def test_split_text():
    assert split_text("aaaa bbbb cccc dddd.\n\neeee ffff", 5) == ["aaaa bbbb cccc dddd.", "eeee ffff"]
    assert split_text("One two three four. Five six seven eight. Nine", 5) == ["One two three four.", "Five six seven eight.", "Nine"]
    assert split_text("x" * 40, 5) == ["x" * 40]


def test_pack_sentences_keeps_every_sentence():
    paras = ["One is here. Two is here too. Three.", "Four stands alone and is rather long, longer than most. Five."]
    made = pack_sentences(paras, 5, 8)
    assert " ".join(c[0].replace("\n\n", " ") for c in made) == " ".join(paras)
    assert [c[3] for c in made][0] == 0
    assert made[-1][4] == 4


def test_paragraph_windows():
    assert paragraph_windows("") == []
    assert paragraph_windows("aaa\n\nbbb\n\nccc", 6) == ["aaa", "bbb", "ccc"]


@pytest.mark.parametrize(
    ("n", "expected"),
    [(1000, [(0, 500), (490, 990), (980, 1000)]), (510, [(0, 500), (490, 510)]), (990, [(0, 500), (490, 990)]), (500, [(0, 500)]), (4, [])],
)
def test_line_windows(spark, n, expected):
    rows = line_windows(spark.createDataFrame([("f", n)], "file string, n_lines int")).orderBy("start").collect()
    assert [(r.start, r.end) for r in rows] == expected
