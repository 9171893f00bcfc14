"""Markdown to sections and paragraphs, and HTML to markdown."""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import strip


_HEAD = re.compile(r"^(#{1,6})\s+(.*)$")


def lines(files: DataFrame) -> DataFrame:
    """(file, pos, line) of (file, md)."""
    return files.select("file", F.posexplode(F.split(F.coalesce("md", F.lit("")), "\n")).alias("pos", "line"))


def parse(md: str) -> list[dict]:
    """Sections (section_idx, title, level, paras) of a markdown text.

    A line that starts a fence turns code on or off and is content; in code all lines are. Elsewhere a
    heading opens a section and a blank line ends a paragraph. Content ahead of any heading is an untitled section.
    """
    rows = md.splitlines()
    bare = [x.strip() for x in rows]
    fence = np.array([x.startswith("```") for x in bare], bool)
    free = (np.cumsum(fence) % 2 == 0) & ~fence
    heads = {k: m for k in np.flatnonzero(free & np.array([x.startswith("#") for x in rows], bool)).tolist() if (m := _HEAD.match(rows[k]))}
    ends = np.flatnonzero(free & np.array([not x for x in bare], bool)).tolist()  # blank lines
    opened = [-1, *heads]
    out = []
    for at, stop in zip(opened, [*heads, len(rows)], strict=True):
        cuts = [at, *ends[bisect_right(ends, at) : bisect_right(ends, stop - 1)], stop]
        blocks = ("\n".join(rows[a + 1 : b]).strip() for a, b in zip(cuts, cuts[1:], strict=False))
        found = {"section_idx": len(out), "title": None, "level": 1, "paras": [x for x in blocks if x]}
        if at >= 0:
            found |= {"title": heads[at][2].strip() or None, "level": len(heads[at][1])}
        elif stop == 0 or not any(bare[:stop]):
            continue  # nothing ahead of the first heading
        out.append(found)
    return out


def parsed(files: DataFrame) -> DataFrame:
    """(file, section_idx, title, level, paras) of (file, md); a file is parsed in its row, so nothing is shuffled."""

    @F.pandas_udf("array<struct<section_idx: int, title: string, level: int, paras: array<string>>>")
    def found(mds: pd.Series) -> pd.Series:
        return mds.map(lambda md: parse(md or ""))

    return files.select("file", F.inline(found("md")))


def sections(files: DataFrame) -> DataFrame:
    """(file, section_idx, title, level) of every section, those without text too; title null if empty."""
    return parsed(files).drop("paras")


def paragraphs(files: DataFrame) -> DataFrame:
    """(file, section_idx, para_idx, text): lines joined, stripped, none empty."""
    return parsed(files).select("file", "section_idx", F.posexplode("paras").alias("para_idx", "text"))


def parents(files: DataFrame) -> DataFrame:
    """(file, section_idx, title, parent_text): a section's paragraphs joined by blank lines; sections without any have no row."""
    return parsed(files).filter(F.size("paras") > 0).select("file", "section_idx", "title", F.array_join("paras", "\n\n").alias("parent_text"))


HTML_RULES = (
    (r"(?is)<(script|style|nav|head)\b.*?</\1>", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<h1[^>]*>(.*?)</h1>", "\n\n# $1\n\n"),
    (r"(?is)<h2[^>]*>(.*?)</h2>", "\n\n## $1\n\n"),
    (r"(?is)<h3[^>]*>(.*?)</h3>", "\n\n### $1\n\n"),
    (r"(?is)<li[^>]*>", "\n- "),
    (r"(?is)</?(p|div|br|ul|ol|table|tr|article|section)\b[^>]*>", "\n\n"),
    (r"(?s)<[^>]+>", ""),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", '"'),
    (r"&nbsp;", " "),
    (r"&amp;", "&"),
    (r"[ \t]+", " "),
    (r" ?\n ?", "\n"),
    (r"\n{3,}", "\n\n"),
)


def html_to_markdown(html):
    """The offline converter: headings, list items and paragraphs of HTML as markdown."""
    out = F.coalesce(html, F.lit(""))
    for pattern, to in HTML_RULES:
        out = F.regexp_replace(out, pattern, to)
    return strip(out)
