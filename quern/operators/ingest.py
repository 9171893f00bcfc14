"""From files to points: chunks, inputs of models, identifiers, vectors, terms, statistics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import ids, text
from quern.operators import chunking, collections, headers, stats
from quern.operators.markdown import paragraphs


def smart_chunks(files: DataFrame, limit: int = 700, provider: headers.Provider | None = None, natural: bool = False, soft: int = 350) -> DataFrame:
    """(file, chunk_idx, section_title, parent_id, text, parent_text) of (file, md): headers, sections, then chunks.

    ``natural`` packs whole sentences, from ``soft`` to ``limit`` tokens, instead of splitting sections. A
    file of which no section comes has the chunks of :func:`plain_chunks`.
    """
    titled = headers.inject_headers(files, provider)
    if natural:
        packed = chunking.natural_chunks(paragraphs(titled), soft, limit)
        parents = chunking.parents(titled).withColumn("parent_id", ids.parent_id(F.col("title"), F.col("parent_text")))
        made = packed.join(parents, ["file", "section_idx"]).withColumnRenamed("title", "section_title")
    else:
        made = chunking.semantic_chunks(titled, limit)
    place = F.struct("section_idx", "chunk_idx")
    made = made.groupBy("file").agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), "section_title", "parent_id", "text", "parent_text"))).alias("x"))
    rows = made.select("file", F.posexplode("x").alias("chunk_idx", "c")).select("file", "chunk_idx", "c.section_title", "c.parent_id", "c.text", "c.parent_text")
    none = files.filter(F.col("md").rlike(r"\S")).join(made.select("file"), "file", "left_anti")
    return rows.unionByName(plain_chunks(none.select("file", F.array(F.struct(F.lit(None).cast("int").alias("page"), F.col("md").alias("text"))).alias("pages"))).drop("page_numbers"))


def plain_chunks(files: DataFrame, limit: int = 512) -> DataFrame:
    """Chunks of (file, pages: array<struct<page, text>>) where there are no sections: neighbours joined up to ``limit`` tokens.

    (file, chunk_idx, section_title, parent_id, text, parent_text, page_numbers): a chunk is its own parent, docling_{i}
    of its place, and page_numbers has its pages, each once, sorted.
    """
    kind = "array<struct<text: string, pages: array<int>>>"

    def joined(open_: Column, p: Column) -> Column:
        return F.struct(F.concat(open_["text"], F.lit("\n\n"), p["text"]).alias("text"), F.concat(open_["pages"], F.array(p["page"])).alias("pages"))

    def step(done: Column, p: Column) -> Column:
        last = F.element_at(done, -1)
        fits = text.token_count(F.concat(last["text"], F.lit("\n\n"), p["text"])) <= limit
        alone = F.struct(p["text"].alias("text"), F.array(p["page"]).alias("pages"))
        return F.when((F.size(done) > 0) & fits, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined(last, p)))).otherwise(F.concat(done, F.array(alone))).cast(kind)

    some = F.filter("pages", lambda p: p["text"].rlike(r"\S"))
    rows = files.select("file", F.posexplode(F.aggregate(some, F.array().cast(kind), step)).alias("chunk_idx", "c"))
    numbers = F.array_sort(F.array_distinct(F.filter("c.pages", lambda n: n.isNotNull())))
    title = F.lit(None).cast("string").alias("section_title")
    return rows.select("file", "chunk_idx", title, F.concat(F.lit("docling_"), F.col("chunk_idx").cast("string")).alias("parent_id"), "c.text", F.col("c.text").alias("parent_text"), numbers.alias("page_numbers"))


def points_of(chunks: DataFrame, collection: Column, company: Column, embed: collections.Embedder | None = None) -> DataFrame:
    """Points (collection, id, filename, title, text, parent_id, parent_text, tokens, dense) of chunks (file, chunk_idx, ...).

    The vector is of the text under its title, the terms of the title and the text. Without ``embed`` vectors are null.
    """
    title, body = F.col("section_title"), F.col("text")
    rows = chunks.select(
        collection.alias("collection"),
        ids.point_id(company, F.col("file"), F.col("chunk_idx")).alias("id"),
        F.col("file").cast("string").alias("filename"),
        title.alias("title"),
        "text",
        "parent_id",
        "parent_text",
        text.terms(text.sparse_input(title, body)).alias("tokens"),
    )
    if embed is None:
        return rows.withColumn("dense", F.lit(None).cast("array<double>"))
    return collections.embedded(rows, embed, text.dense_input(F.col("title"), F.col("text")), strict=True).drop("failed")


@dataclass(frozen=True)
class Ingested:
    """The points after it, the deltas of both statistics, and the files that were there already."""

    points: DataFrame
    corpus_deltas: DataFrame
    term_deltas: DataFrame
    rejected: DataFrame


def ingest(files: DataFrame, points: DataFrame, collection: Column, company: Column, allow_update: bool = False, limit: int = 700, provider: headers.Provider | None = None, embed: collections.Embedder | None = None) -> Ingested:
    """Adds files (file, md) to ``points``: chunks, vectors and terms, guarded against files that are there already.

    With ``allow_update`` those are replaced and their statistics taken back in the same deltas.
    """
    new = points_of(smart_chunks(files, limit, provider), collection, company, embed)
    change = collections.put_files(points, new, allow_update)
    signed = change.signed.select("collection", F.col("id").alias("point_id"), "tokens", "sign")
    return Ingested(change.points, stats.corpus_deltas(signed, F.col("sign")), stats.term_deltas(signed, F.col("sign")), change.rejected)


def described_files(files: DataFrame, company: Column, embed: collections.Embedder | None = None) -> DataFrame:
    """One point a described file (file, description, content_type, url): images have their asset's url, other files none."""
    rows = files.select(
        ids.sendable_collection(company).alias("collection"),
        ids.point_id(company, F.lit("sendable"), F.col("file")).alias("id"),
        F.col("file").alias("filename"),
        F.col("description").alias("text"),
        F.element_at(F.split("file", r"\."), -1).alias("file_type"),
        "url",
        F.when(text.is_image(F.col("content_type")), F.col("url")).alias("asset_url"),
        text.terms(F.col("description")).alias("tokens"),
    )
    if embed is None:
        return rows.withColumn("dense", F.lit(None).cast("array<double>"))
    return collections.embedded(rows, embed, F.col("text"), strict=True).drop("failed")


class QueryVectors:
    """Vectors of query texts, the last ``size`` of them kept; the key is the stripped text, and an empty one has no vector."""

    def __init__(self, embed: Callable[[list[str]], list[list[float]]], size: int = 500):
        self.embed, self.size, self.kept, self.asked = embed, size, {}, 0

    def get(self, query: str) -> list[float]:
        key = query.strip()
        if not key:
            return []
        if key not in self.kept:
            self.asked += 1
            made = self.embed([key])[0]
            if len(self.kept) >= self.size:
                self.kept.pop(next(iter(self.kept)))  # the one asked for longest ago
        else:
            made = self.kept.pop(key)
        self.kept[key] = made
        return made


class StatsSnapshot:
    """Collections' sizes and mean lengths as they were when a snapshot was taken, until another one is asked for by its name."""

    def __init__(self, read: Callable[[], DataFrame]):
        self.read, self.name, self.rows = read, None, None

    def of(self, name: str) -> DataFrame:
        if name != self.name:
            if self.rows is not None:
                self.rows.unpersist()
            self.name, self.rows = name, self.read().persist()
        return self.rows
