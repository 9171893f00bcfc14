"""Header injection: a provider proposes split points in windows of lines; they are verified, collapsed and stitched in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.text import preview, similarity, squeezed
from quern.operators import enrich
from quern.operators.chunking import line_windows
from quern.operators.markdown import lines

#: Characters compared, the score that accepts a proposed line, that which another line must pass, and how far it is looked for.
COMPARED, ACCEPT, PASS, REACH = 50, 0.5, 0.6, 100

#: Answers (file, start, line, snippet, title, confidence) to windows (file, start, end, text); line is the number from 1 in the file.
Provider = Callable[[DataFrame], DataFrame]


def windows(files: DataFrame, size: int = 500, overlap: int = 10, least: int = 5) -> DataFrame:
    """(file, start, end, text): what a provider is asked about; files of fewer than ``least`` lines aren't."""
    rows = files.select("file", F.split(F.coalesce("md", F.lit("")), "\n").alias("rows"))
    cut = line_windows(rows.select("file", F.size("rows").alias("n_lines")), size, overlap, least)
    return cut.join(rows, "file").select("file", "start", "end", F.array_join(F.slice("rows", F.col("start") + 1, F.col("end") - F.col("start")), "\n").alias("text"))


def short(text: Column) -> Column:
    return preview(squeezed(F.coalesce(text, F.lit(""))), COMPARED)


def verified(files: DataFrame, proposed: DataFrame) -> DataFrame:
    """(file, line, confidence, title) of proposals (file, start, line, snippet, title, confidence), lines from 1.

    A proposal stands if the first characters of its line are like its snippet; else it goes to the
    line of the next hundred from its window's start that is most like it; else it is dropped.
    """
    asked = proposed.withColumn("snippet_id", F.row_number().over(W.partitionBy("file").orderBy("start", "line", "snippet", "title")))
    texts = lines(files).select("file", (F.col("pos") + 1).alias("line"), F.col("line").alias("found"))
    seen = asked.join(texts, ["file", "line"], "left").withColumn("like", F.when(F.col("found").rlike(r"\S") & F.col("snippet").rlike(r"\S"), similarity(short(F.col("snippet")), short(F.col("found")))))
    good = F.coalesce(F.col("like") >= ACCEPT, F.lit(False))
    stay = seen.filter(good).select("file", "line", "confidence", "title")
    lost = seen.filter(~good).filter(F.col("snippet").rlike(r"\S")).drop("found", "like", "line")
    moved = enrich.match_lines(files, lost.select("file", "snippet_id", "start", "snippet"), REACH, PASS).select("file", "snippet_id", (F.col("line") + 1).cast("int").alias("line"))
    return stay.unionByName(lost.join(moved, ["file", "snippet_id"]).select("file", "line", "confidence", "title"))


def inject_headers(files: DataFrame, provider: Provider | None, size: int = 500, overlap: int = 10, least: int = 5) -> DataFrame:
    """(file, md) with headings at the lines that ``provider`` proposes and that are verified; files too short for a window stay as they are."""
    if provider is None:
        return files.select("file", "md")
    return enrich.stitch(files, verified(files, provider(windows(files, size, overlap, least))))


#: Answers (file, section_idx, insight) to sections (file, section_idx, title, text).
Insights = Callable[[DataFrame], DataFrame]


def section_insights(parents: DataFrame, provider: Insights, most: int = 50) -> DataFrame:
    """(file, section_idx, title, insight) of the first ``most`` sections with text of each file; insight is null where there is no answer."""
    nth = F.row_number().over(W.partitionBy("file").orderBy("section_idx"))
    asked = parents.filter(F.col("parent_text").rlike(r"\S")).withColumn("_nth", nth).filter(F.col("_nth") <= most)
    asked = asked.select("file", "section_idx", "title", F.col("parent_text").alias("text"))
    return asked.join(provider(asked), ["file", "section_idx"], "left").select("file", "section_idx", "title", "insight")
