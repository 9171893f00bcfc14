"""Listings and reassembly of stored documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def document_list(points: DataFrame) -> DataFrame:
    """(filename, title, url) by filename; title and url of the point with the least id."""
    rows = points.filter("filename <> ''").groupBy("filename").agg(F.min_by(F.struct("title", "url"), "id").alias("x"))
    return rows.select("filename", "x.title", "x.url")


def document_content(points: DataFrame) -> DataFrame:
    """(filename, title, url, section_titles, content) by filename.

    Chunks follow by id; if the first has pages, by their least page, those without last.
    """
    page = F.coalesce(F.array_min("page_numbers"), F.lit(2147483647))
    rows = points.filter("filename <> ''").groupBy("filename").agg(
        F.array_sort(F.collect_list(F.struct("id", page.alias("page"), "text", "title", "url", (F.size("page_numbers") > 0).alias("paged")))).alias("by_id")
    )
    by_page = F.array_sort(F.transform("by_id", lambda c: F.struct(c["page"].alias("page"), c["id"].alias("id"), c["text"].alias("text"), c["title"].alias("title"))))
    plain = F.transform("by_id", lambda c: F.struct(F.lit(0).alias("page"), c["id"].alias("id"), c["text"].alias("text"), c["title"].alias("title")))
    first = F.element_at("by_id", 1)
    rows = rows.select("filename", first["title"].alias("title"), first["url"].alias("url"), F.when(F.coalesce(first["paged"], F.lit(False)), by_page).otherwise(plain).alias("x"))
    titles = F.array_distinct(F.filter(F.transform("x", lambda c: c["title"]), lambda t: t != ""))
    return rows.select("filename", "title", "url", titles.alias("section_titles"), F.array_join(F.transform("x", lambda c: c["text"]), " ").alias("content"))
