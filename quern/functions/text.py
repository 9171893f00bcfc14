"""Text functions as Column expressions; Arrow UDFs only where Spark has no builtin."""

from __future__ import annotations

import difflib
import unicodedata
import urllib.parse
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The English words that are no search terms.
STOP_WORDS = (
    "a an the and or not of to in on for with at by from is are was were be been being as that this those these "
    "it its it they them he she we you your our their i"
).split()

CJK = r"\p{IsHan}\p{IsKatakana}\p{IsHiragana}\p{IsHangul}"
#: Characters that NFKC leaves as they are and that combine with nothing before them.
STEADY = (
    r"\x{0}-\x{9F}\x{A1}-\x{A7}\x{A9}\x{AB}-\x{AE}\x{B0}\x{B1}\x{B6}\x{B7}\x{BB}\x{BF}-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}"
    r"\x{391}-\x{3A1}\x{3A3}-\x{3CE}\x{400}-\x{482}\x{48A}-\x{52F}\x{2013}-\x{2016}\x{2018}-\x{2022}\x{20AC}\x{3001}-\x{3003}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}"
)


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Unicode normal form NFKC. Only texts that have another than a steady character are sent through Python."""
    return F.coalesce(_nfkc(F.when(text.rlike(f"[^{STEADY}]"), text)), text)


def runs(text: Column) -> Column:
    """Runs of CJK characters, and of letters and digits that start with none."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[{CJK}]+|[\p{{L}}\p{{N}}]+"), F.lit(0))


def run_terms(run: Column) -> Column:
    """A CJK run's characters, then its pairs; another run itself if it is long enough or a digit, and no stop word."""
    chars = F.split(run, "")
    pairs = F.when(F.length(run) > 1, F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda k: F.substring(run, k, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    kept = ((F.length(run) >= 2) | run.rlike(r"^\p{Nd}$")) & ~run.isin(STOP_WORDS)
    return F.when(run.rlike(rf"^[{CJK}]"), F.concat(chars, pairs)).when(kept, F.array(run)).otherwise(F.array().cast("array<string>"))


def _words(text: Column) -> Column:
    kept = lambda run: ((F.length(run) >= 2) | run.rlike(r"^\p{Nd}$")) & ~run.isin(STOP_WORDS)
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), kept)


def terms(text: Column, normalize: bool = True) -> Column:
    """Search terms of a text. Without ``normalize`` the text must be in NFKC already."""
    source = nfkc(F.coalesce(text, F.lit(""))) if normalize else F.coalesce(text, F.lit(""))
    # Texts without a character from where CJK characters are need no second look at their runs.
    return F.when(source.rlike(r"[\x{1100}-\x{11FF}\x{2E80}-\x{10FFFF}]"), F.flatten(F.transform(runs(source), run_terms))).otherwise(_words(source))


def legacy_terms(text: Column) -> Column:
    """Terms as older vectors have them: lower-case runs of two characters or more, or one digit; no normal form, no stop words."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda r: (F.length(r) >= 2) | r.rlike(r"^\p{Nd}$"))


def counted(tokens: Column) -> Column:
    """array<struct<term, tf>> of an array of terms, sorted by term; linear after the sort, and within the row."""
    kind = "array<struct<term: string, tf: int>>"
    ordered = F.sort_array(tokens)  # without a comparator, which would be a lambda
    # Terms and the places where the next one starts; the places are differences of term frequencies.
    starts = lambda s: F.filter(F.sequence(F.lit(1), F.size(s)), lambda k: (k == 1) | (s[k - 1] != s[k - 2]))
    sizes = lambda s, at: F.transform(at, lambda a, j: F.struct(s[a - 1].alias("term"), (F.coalesce(F.get(at, j + 1), F.size(s) + 1) - a).cast("int").alias("tf")))
    once = lambda x, fn: F.transform(F.array(x), fn)[0]  # noqa: E731  binds x, which would else be computed for each element
    return F.when(F.size(tokens) > 0, once(ordered, lambda s: once(starts(s), lambda at: sizes(s, at)))).otherwise(F.array().cast(kind))


def token_count(text: Column, tokens: Callable[[Column], Column] | None = None) -> Column:
    """Tokens of a text by ``tokens``, or where there is none or it gives null a quarter of its length, 1 at least."""
    fallback = F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))
    return F.coalesce(tokens(text).cast("int"), fallback) if tokens else fallback


def tokenizer(load: Callable[[], Callable[[str], int]]) -> Callable[[Column], Column]:
    """A tokenizer's count as a Column function; ``load`` makes it once a worker, texts it raises on get null."""

    @F.pandas_udf(T.IntegerType())
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = load()

        def one(text: str | None) -> int | None:
            try:
                return None if text is None else count(text)
            except Exception:  # the fallback counts it
                return None

        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype="Int32")

    return counts


def preview(text: Column, n: int) -> Column:
    """The first ``n`` characters, empty for null."""
    return F.substring(F.coalesce(text, F.lit("")), 1, n)


def is_image(content_type: Column) -> Column:
    return F.coalesce(content_type.startswith("image/"), F.lit(False))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """Sentences, cut after . ! ? before an upper-case letter, a digit or a bracket; stripped, none empty."""
    parts = F.split(text, r"(?<=[.!?])\s+(?=[A-ZА-ЯЁ0-9(])")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def squeezed(text: Column) -> Column:
    """Lower case, stripped, white space to single spaces."""
    return F.regexp_replace(F.lower(strip(text)), r"\s+", " ")


def header(title: Column) -> Column:
    """A title as a second-level heading, unless it is empty or one already."""
    return F.when((title != "") & ~title.startswith("#"), F.concat(F.lit("## "), title)).otherwise(title)


def truthy(value: Column, default: bool) -> Column:
    return F.when(value.isNull(), F.lit(default)).otherwise(F.lower(strip(value)).isin("1", "true", "yes", "y", "on"))


def dense_input(title: Column, text: Column) -> Column:
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("Title: "), title, F.lit("\n\n"), text)).otherwise(text)


def sparse_input(title: Column, text: Column) -> Column:
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(title, F.lit(". "), text)).otherwise(text)


def page_numbers(value: Column) -> Column:
    """Page numbers written as a JSON list; null where they can't be read."""
    return F.from_json(value, "array<int>")


@F.pandas_udf(T.StringType())
def decoded_filename(names: pd.Series) -> pd.Series:
    """URL-decoded, and UTF-8 that was read as Latin-1 repaired where it can be."""

    def one(name: str | None) -> str | None:
        if name is None:
            return None
        plain = urllib.parse.unquote(name)
        try:
            return plain.encode("latin1").decode("utf-8")
        except UnicodeError:
            return plain

    return names.map(one)


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """0.95 where one normalised text holds the other, else the matching ratio of their first 100 characters."""
    return pd.Series([0.95 if x in y or y in x else difflib.SequenceMatcher(None, x[:100], y[:100]).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def event_frame(event: Column, data: Column) -> Column:
    """A server-sent event with ``data``, a struct, as JSON."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), F.to_json(data), F.lit("\n\n"))
