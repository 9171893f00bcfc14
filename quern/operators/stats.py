"""Corpus term statistics: built, added to, retracted from, and turned into postings.

Points are (collection, point_id, tokens), or (collection, point_id, dl, terms) as :func:`indexed` makes
them of these: terms with their frequencies, counted within the row. Statistics are two tables:
(collection, n, total_dl) and (collection, term, df). Changes are signed deltas that add up in any
order; floors apply on reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import scoring
from quern.functions.ids import term_index
from quern.functions.text import counted

#: What an unknown collection counts as.
DEFAULT_N, DEFAULT_LENGTH = 1, 200.0


def indexed(points: DataFrame) -> DataFrame:
    """(collection, point_id, dl, terms) of points; no shuffle, as a point is one row. Index rows pass as they are."""
    if "terms" in points.columns:
        return points
    return points.select("collection", "point_id", F.size("tokens").alias("dl"), counted(F.col("tokens")).alias("terms"))


def term_frequencies(points: DataFrame) -> DataFrame:
    """(collection, point_id, term, tf)."""
    return indexed(points).select("collection", "point_id", F.inline("terms")).withColumn("tf", F.col("tf").cast("long"))


def corpus_deltas(points: DataFrame, sign: int | Column = 1) -> DataFrame:
    """(collection, n, total_dl) of points that are added, taken (``sign`` -1), or either by a column."""
    sign = sign if isinstance(sign, Column) else F.lit(sign)
    length = F.col("dl") if "terms" in points.columns else F.size("tokens")
    return points.groupBy("collection").agg(F.sum(sign).cast("long").alias("n"), F.sum(length * sign).cast("long").alias("total_dl"))


def term_deltas(points: DataFrame, sign: int | Column = 1) -> DataFrame:
    """(collection, term, df) of points that are added, taken, or either."""
    sign = (sign if isinstance(sign, Column) else F.lit(sign)).alias("sign")
    # Distinct within a row already, so document frequency is a plain sum, combined map-side.
    terms = F.transform("terms", lambda t: t["term"]) if "terms" in points.columns else F.array_distinct("tokens")
    rows = points.select("collection", sign, F.explode(terms).alias("term"))
    return rows.groupBy("collection", "term").agg(F.sum("sign").cast("long").alias("df"))


def reset(corpus: DataFrame, terms: DataFrame, collection: str) -> tuple[DataFrame, DataFrame]:
    """Both statistics without those of one collection."""
    other = F.col("collection") != collection
    return corpus.filter(other), terms.filter(other)


def net_corpus(deltas: DataFrame) -> DataFrame:
    """Statistics from deltas: n is 1 at least, total_dl 0."""
    out = deltas.groupBy("collection").agg(F.sum("n").alias("n"), F.sum("total_dl").alias("total_dl"))
    return out.select("collection", F.greatest("n", F.lit(1)).cast("long").alias("n"), F.greatest("total_dl", F.lit(0)).cast("long").alias("total_dl"))


def net_terms(deltas: DataFrame) -> DataFrame:
    """Document frequencies from deltas; terms without any are gone."""
    return deltas.groupBy("collection", "term").agg(F.sum("df").cast("long").alias("df")).filter("df > 0")


def corpus_stats(points: DataFrame) -> DataFrame:
    """(collection, n, total_dl, avgdl)."""
    out = net_corpus(corpus_deltas(points))
    return out.withColumn("avgdl", F.col("total_dl") / F.greatest("n", F.lit(1)))


def term_stats(points: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(collection, term, df) of all terms, or of those that some of ``queries`` (collection, tokens) has.

    The terms asked for are broadcast if a count proves them few, and only they are counted.
    """
    if queries is None:
        return net_terms(term_deltas(points))
    asked = few(queries.select("collection", F.explode("tokens").alias("term")).distinct(), 500_000)
    rows = indexed(points).select("collection", F.explode(F.transform("terms", lambda t: t["term"])).alias("term")).join(asked, ["collection", "term"], "left_semi")
    return rows.groupBy("collection", "term").agg(F.count(F.lit(1)).alias("df"))


def postings(points: DataFrame, stats: DataFrame, average: float | None = None) -> DataFrame:
    """(collection, point_id, term, idx, tf, dl, weight): term frequencies normalised by length.

    Statistics have a row a collection and are broadcast if a count proves them few. With ``average`` the
    weights are frozen at that mean length.
    """
    rows = indexed(points)
    if average is None:
        rows = rows.join(few(stats.select("collection", "avgdl")), "collection", "left")
        mean = F.coalesce("avgdl", F.lit(DEFAULT_LENGTH))
    else:
        mean = F.lit(float(average))
    rows = rows.select("collection", "point_id", "dl", mean.alias("mean"), F.inline("terms"))
    weight = scoring.tf_norm(F.col("tf"), F.col("dl"), F.col("mean"))
    return rows.select("collection", "point_id", "term", term_index(F.col("term")).alias("idx"), F.col("tf").cast("long").alias("tf"), "dl", weight.alias("weight"))


def few(rows: DataFrame, limit: int = 100_000) -> DataFrame:
    """``rows``, narrow ones, to be broadcast if a count proves them at most ``limit``; else the planner joins as it can."""
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows


def query_weights(queries: DataFrame, stats: DataFrame, terms: DataFrame) -> DataFrame:
    """(collection, query_id, term, tf, weight) of (collection, query_id, tokens): tf times idf."""
    rows = queries.select("collection", "query_id", F.inline(counted(F.col("tokens"))))
    rows = rows.join(few(stats.select("collection", "n")), "collection", "left").join(terms, ["collection", "term"], "left")
    weight = F.col("tf") * scoring.idf(F.coalesce("n", F.lit(DEFAULT_N)), F.coalesce("df", F.lit(0)))
    return rows.select("collection", "query_id", "term", F.col("tf").cast("long").alias("tf"), weight.alias("weight"))
