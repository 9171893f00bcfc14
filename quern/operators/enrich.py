"""Finding and inserting headers: split points, fuzzy line matches, stitching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.text import header, similarity, squeezed, strip
from quern.operators.markdown import lines


def collapse_points(points: Column, tolerance: int = 3) -> Column:
    """Split points (line, confidence, title) without those at most ``tolerance`` lines after the last kept one.

    A strictly surer one replaces the last kept.
    """
    kind = "array<struct<line: int, confidence: double, title: string>>"

    def step(kept: Column, p: Column) -> Column:
        last = F.element_at(kept, -1)
        near = (F.size(kept) > 0) & (p["line"] - last["line"] <= tolerance)
        swapped = F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(p))
        return F.when(F.size(kept) == 0, F.array(p)).when(near & (p["confidence"] > last["confidence"]), swapped).when(near, kept).otherwise(F.concat(kept, F.array(p)))

    return F.aggregate(F.array_sort(points).cast(kind), F.array().cast(kind), step)


def dedup_points(points: DataFrame, tolerance: int = 3) -> DataFrame:
    """(file, line, confidence, title), collapsed in each file."""
    rows = points.groupBy("file").agg(F.collect_list(F.struct("line", F.col("confidence").cast("double").alias("confidence"), "title")).alias("x"))
    return rows.select("file", F.explode(collapse_points(F.col("x"), tolerance)).alias("p")).select("file", "p.*")


def stitch(files: DataFrame, points: DataFrame) -> DataFrame:
    """(file, md) with a point's title, as a heading, and blank lines ahead of its line, unless the line is a heading."""
    heads = dedup_points(points).select("file", (F.col("line") - 1).alias("pos"), header(F.col("title")).alias("head"))
    rows = lines(files).join(heads, ["file", "pos"], "left")
    add = F.col("head").isNotNull() & ~strip(F.col("line")).startswith("#")
    rows = rows.withColumn("out", F.when(add, F.concat(F.lit("\n"), "head", F.lit("\n\n"), "line")).otherwise(F.col("line")))
    whole = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("pos", "out"))).alias("x"))
    return whole.select("file", F.array_join(F.transform("x", lambda r: r["out"]), "\n").alias("md"))


def match_lines(files: DataFrame, snippets: DataFrame, window: int = 100, least: float = 0.6) -> DataFrame:
    """(file, snippet_id, line, score): the best line from a snippet's start on, within ``window`` lines.

    Snippets are (file, snippet_id, start, snippet). The first of equal scores wins; scores must pass ``least``.
    """
    rows = lines(files).filter(F.col("line").rlike(r"\S")).join(snippets.filter("snippet <> ''"), "file")
    rows = rows.filter((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + window))
    rows = rows.withColumn("score", similarity(squeezed(F.col("snippet")), squeezed(F.col("line")))).filter(F.col("score") > least)
    nth = F.row_number().over(W.partitionBy("file", "snippet_id").orderBy(F.desc("score"), "pos"))
    return rows.withColumn("_nth", nth).filter("_nth = 1").select("file", "snippet_id", F.col("pos").alias("line"), F.round("score", 6).alias("score"))
