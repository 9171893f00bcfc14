"""Chunkers: token-bounded splits, sentence packing, and windows.

Where a chunk may end is known from sums of lengths, so each chunk's end is searched for among the
possible ones. They run row by row in Arrow UDFs; rows are sections or files, and no group is
gathered for them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.ids import parent_id
from quern.operators.markdown import parents

_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-ZА-ЯЁ0-9(])")
#: What a text is split at, from coarse to fine, and what joins the parts again.
SEPARATORS = (("\n\n", "\n\n"), ("\n", "\n"), (". ", " "))

Counter = Callable[[str], int]


def count(text: str) -> int:
    """Tokens of a text where no tokenizer is at hand."""
    return max(1, len(text) // 4)


def safe(tokens: Counter | None) -> Counter:
    """``tokens``, with :func:`count` for what it raises on."""
    if tokens is None:
        return count

    def counted(text: str) -> int:
        try:
            return tokens(text)
        except Exception:  # whatever a tokenizer has against a text, a chunk needs a size
            return count(text)

    return counted


def split_text(text: str, limit: int, tokens: Counter = count) -> list[str]:
    """Pieces of at most ``limit`` tokens: by blank lines, else lines, else sentences; what has none of them stays whole.

    As many neighbours as the limit allows are one piece again; it is the joined text that is counted.
    """
    found = next(((cut, glue) for cut, glue in SEPARATORS if cut in text), None)
    if found is None or tokens(text) <= limit:
        return [text]
    cut, glue = found
    parts = text.split(cut)
    if cut == ". ":
        parts = [f"{p}." for p in parts[:-1]] + parts[-1:]
    out, at = [], 0
    while at < len(parts):
        if not parts[at]:  # a piece starts with what isn't empty
            at += 1
            continue
        joined = lambda end, at=at: tokens(glue.join(parts[at:end]))
        end = at + bisect_right(range(at + 1, len(parts) + 1), limit, key=joined)
        if end > at:
            out.append(glue.join(parts[at:end]))
        else:  # not even one fits
            out += split_text(parts[at], limit, tokens)
        at = max(end, at + 1)
    return out


def semantic_chunks(files: DataFrame, limit: int = 512, tokens: Counter | None = None) -> DataFrame:
    """(file, section_idx, chunk_idx, section_title, parent_id, text, parent_text): sections, split where over ``limit`` tokens."""
    counter = safe(tokens)

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [p for p in split_text(t, limit, counter) if p.strip()])

    df = parents(files).withColumn("pid", parent_id(F.col("title"), F.col("parent_text"))).withColumn("pieces", split("parent_text"))
    return df.select("file", "section_idx", F.posexplode("pieces").alias("chunk_idx", "text"), F.col("title").alias("section_title"), F.col("pid").alias("parent_id"), "parent_text")


def sentences(text: str) -> list[str]:
    return [s for s in map(str.strip, _SENTENCE.split(text)) if s]


def pack_sentences(paras: list[str], soft: int, hard: int, tokens: Counter = count) -> list[tuple[str, int, int, int, int]]:
    """Chunks (text, first and last paragraph, first and last sentence) that never cut a sentence.

    A paragraph of at most ``soft`` tokens joins whole if the chunk then keeps ``hard``. Of others the
    chunk takes the sentences up to the first that makes it ``soft`` or more, but none that makes it
    more than ``hard`` unless it is empty; the next chunk goes on by sentence. Blank paragraphs count as
    places only.
    """
    split = [sentences(p) for p in paras]
    sizes = [tokens(p) for p in paras]
    sums = [list(accumulate(map(tokens, s), initial=0)) for s in split]
    before = list(accumulate(map(len, split), initial=0))

    def chunk(para: int, sent: int, begun: bool) -> tuple[list[str], int, int, int]:
        """What starts at a sentence (of a paragraph that is ``begun`` or not): its texts, where it ends, and the paragraph it ends in."""
        held, size = [], 0
        while para < len(paras):
            n = len(split[para])
            if n and not begun and sizes[para] <= soft and size + sizes[para] <= hard:
                held.append(paras[para])
                size += sizes[para]
            elif n:
                passed = sums[para]
                reach = lambda most: bisect_right(passed, passed[sent] + most - size, sent + 1) - 1  # noqa: B023, E731
                full = min(bisect_right(passed, passed[sent] + soft - size - 1, sent + 1), n)  # the sentence that makes it soft, or the last
                end = min(full, max(reach(hard), sent if held else sent + 1))
                held += split[para][sent:end]
                size += passed[end] - passed[sent]
                if end < n or size >= soft:
                    return held, *((para, end) if end < n else (para + 1, 0)), para
            para, sent, begun = para + 1, 0, False
        return held, para, 0, len(paras) - 1

    out, at, sent, last = [], 0, 0, -1
    while at < len(paras):
        if not split[at]:
            at += 1
            continue
        first, first_sent = at, before[at] + sent
        held, at, sent, last = chunk(at, sent, last == at)
        ended = before[at] + sent
        out.append(("\n\n".join(held), first, last, first_sent, ended - 1))
    return out


def natural_chunks(paras: DataFrame, soft: int = 350, hard: int = 700, tokens: Counter | None = None) -> DataFrame:
    """(file, section_idx, chunk_idx, text, para_from, para_to, sent_from, sent_to) of (file, section_idx, para_idx, text); para_idx is dense from 0."""
    counter = safe(tokens)

    @F.pandas_udf("array<struct<text: string, para_from: int, para_to: int, sent_from: int, sent_to: int>>")
    def pack(x: pd.Series) -> pd.Series:
        names = ("text", "para_from", "para_to", "sent_from", "sent_to")
        return x.map(lambda ps: [dict(zip(names, c, strict=True)) for c in pack_sentences(list(ps), soft, hard, counter)])

    rows = paras.groupBy("file", "section_idx").agg(F.array_sort(F.collect_list(F.struct("para_idx", "text"))).alias("x"))
    out = rows.select("file", "section_idx", F.posexplode(pack(F.transform("x", lambda r: r["text"]))).alias("chunk_idx", "c"))
    return out.select("file", "section_idx", "chunk_idx", "c.*")


def window_cuts(text: str, size: int) -> Iterator[tuple[int, int]]:
    """Where each window starts and ends: the last blank line ahead of every ``size`` characters, else there."""
    blank = [m.start() for m in re.finditer(r"(?=\n\n)", text)]
    start = 0
    for grid in range(size, len(text), size):
        k = bisect_right(blank, grid - 2) - 1
        cut = blank[k] if k >= 0 and blank[k] > start else grid
        yield start, cut
        start = cut if cut == grid else cut + len(text[cut:grid]) - len(text[cut:grid].lstrip("\n"))
    yield start, len(text)


def paragraph_windows(text: str, size: int = 3000) -> list[str]:
    """Windows of about ``size`` characters, each cut at its last blank line; a blank last one is left out."""
    *cuts, last = [text[a:b] for a, b in window_cuts(text, size)]
    return [*cuts, last] if last.strip() else cuts


def file_windows(files: DataFrame, size: int = 3000) -> DataFrame:
    """(file, window, text) of :func:`paragraph_windows` over (file, md)."""

    @F.pandas_udf("array<string>")
    def cut(x: pd.Series) -> pd.Series:
        return x.map(lambda t: paragraph_windows(t or "", size))

    return files.select("file", F.posexplode(cut("md")).alias("window", "text"))


def line_starts(n_lines: Column, size: int = 500, overlap: int = 10) -> Column:
    """Starts of windows over so many lines; the first window that reaches the end is the last."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((n_lines - size) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: k * step)


def line_windows(files: DataFrame, size: int = 500, overlap: int = 10, least: int = 5) -> DataFrame:
    """(file, start, end) of windows over the lines of (file, n_lines); files of fewer than ``least`` lines have none."""
    n = F.col("n_lines")
    starts = files.filter(n >= least).select("file", F.explode(line_starts(n, size, overlap)).alias("start"), n.alias("n"))
    return starts.select("file", "start", F.least(F.col("start") + size, "n").alias("end"))
