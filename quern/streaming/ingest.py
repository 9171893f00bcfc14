"""Ingestion as a stream: files arrive, statistics follow as signed deltas of each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.functions.text import terms
from quern.operators import stats


def points_of(docs: DataFrame, normalize: bool = True) -> DataFrame:
    """(collection, point_id, tokens) of (doc_id, source, text)."""
    return docs.select(F.concat(F.lit("docling_"), F.col("source")).alias("collection"), F.col("doc_id").alias("point_id"), terms(F.col("text"), normalize).alias("tokens"))


def ingest(source: DataFrame, folder: str, checkpoint: str, sign: int = 1) -> StreamingQuery:
    """Writes each batch's deltas below ``folder``, in a folder named by the batch, until all input is read.

    A batch that is repeated overwrites its own deltas, so a restart counts nothing twice.
    """

    def batch(df: DataFrame, number: int) -> None:
        points = points_of(df).persist()
        stats.corpus_deltas(points, sign).coalesce(1).write.mode("overwrite").parquet(f"{folder}/corpus/batch={number}")
        stats.term_deltas(points, sign).write.mode("overwrite").parquet(f"{folder}/terms/batch={number}")
        points.unpersist()

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def net(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Corpus and term statistics of all batches below ``folder``."""
    return stats.net_corpus(spark.read.parquet(f"{folder}/corpus")), stats.net_terms(spark.read.parquet(f"{folder}/terms"))
