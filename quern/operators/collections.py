"""Collections as versioned Parquet folders: guards, upserts, deletes, checks and reindexing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import text
from quern.operators import stats


class SchemaMismatch(ValueError):
    """A collection's vectors don't have the dimensions asked for."""


def duplicates(new: DataFrame, points: DataFrame) -> DataFrame:
    """Rows of ``new`` whose collection and filename are there already."""
    return new.join(points.select("collection", "filename").distinct(), ["collection", "filename"], "left_semi")


def guarded(new: DataFrame, points: DataFrame) -> DataFrame:
    """Rows of ``new`` whose collection and filename are not there yet."""
    return new.join(points.select("collection", "filename").distinct(), ["collection", "filename"], "left_anti")


def latest(new: DataFrame, order: Column | None = None) -> DataFrame:
    """One row of each collection and id: the last by ``order``, or by its place in ``new``."""
    last = W.partitionBy("collection", "id").orderBy((F.monotonically_increasing_id() if order is None else order).desc())
    return new.withColumn("_nth", F.row_number().over(last)).filter("_nth = 1").drop("_nth")


def upsert(points: DataFrame, new: DataFrame, order: Column | None = None) -> DataFrame:
    """``points`` with the rows of ``new`` in place of those of the same collection and id; of rows of one id in ``new`` the last counts."""
    chosen = latest(new, order)
    return points.join(chosen.select("collection", "id"), ["collection", "id"], "left_anti").select(points.columns).unionByName(chosen.select(points.columns))


@dataclass(frozen=True)
class Change:
    """What writing files into a collection does: rows taken and added, with signs, rejected files, and the points after it."""

    signed: DataFrame
    rejected: DataFrame
    points: DataFrame


def put_files(points: DataFrame, new: DataFrame, allow_update: bool = False) -> Change:
    """Adds the points of files. A file that is there already is rejected, or with ``allow_update`` replaced.

    ``signed`` has the points that come with sign 1 and those that go with -1, from which statistics follow.
    """
    there = points.select("collection", "filename").distinct()
    known = new.join(there, ["collection", "filename"], "left_semi")
    fresh = latest(new if allow_update else new.join(there, ["collection", "filename"], "left_anti"))
    gone = points.join(new.select("collection", "filename").distinct(), ["collection", "filename"], "left_semi") if allow_update else points.limit(0)
    rejected = known.select("collection", "filename").distinct().filter(F.lit(not allow_update))
    signed = fresh.select(points.columns).withColumn("sign", F.lit(1)).unionByName(gone.select(points.columns).withColumn("sign", F.lit(-1)))
    kept = points.join(new.select("collection", "filename").distinct(), ["collection", "filename"], "left_anti") if allow_update else points
    return Change(signed, rejected, upsert(kept.select(points.columns), fresh))


def delete(points: DataFrame, condition) -> tuple[DataFrame, DataFrame]:
    """What stays, and how many rows go (a one-row table); nothing to delete is no error."""
    gone = F.coalesce(condition, F.lit(False))
    return points.filter(~gone), points.filter(gone).agg(F.count(F.lit(1)).alias("deleted"))


def delete_one(points: DataFrame, filename: str | None = None, index: str | None = None) -> DataFrame:
    """What stays without the records of one filename or one index; exactly one is given, and some record must match."""
    if (filename is None) == (index is None):
        raise ValueError("give either filename or index")
    match = F.col("filename") == filename if filename is not None else F.col("index") == index
    if not points.filter(match).limit(1).count():
        raise LookupError("no such record")
    return points.filter(~F.coalesce(match, F.lit(False)))


def update_description(points: DataFrame, filename: str, description: str, embed: Callable[[object], object] | None = None) -> DataFrame:
    """One record's text, and its vector if ``embed`` gives one; id and metadata stay. Exactly one record must match."""
    found = points.filter(F.col("filename") == filename).limit(2).count()
    if found != 1:
        raise LookupError("no such record" if not found else "more than one record")
    match = F.coalesce(F.col("filename") == filename, F.lit(False))
    out = points.withColumn("text", F.when(match, F.lit(description)).otherwise(F.col("text")))
    return out.withColumn("dense", F.when(match, embed(F.lit(description))).otherwise(F.col("dense"))) if embed else out


def next_index(records: DataFrame) -> DataFrame:
    """The next sequential index, SF-1 if there is none; numbers that aren't numbers don't count."""
    n = F.split(F.col("index"), "-").getItem(1).try_cast("int")
    return records.filter(F.col("index").startswith("SF-")).agg(F.concat(F.lit("SF-"), (F.coalesce(F.max(n), F.lit(0)) + 1).cast("string")).alias("next_index"))


def catalog(points: DataFrame) -> DataFrame:
    """(collection, points, dims); dims null where no point has a vector."""
    return points.groupBy("collection").agg(F.count(F.lit(1)).alias("points"), F.max(F.when(F.col("dense").isNotNull(), F.size("dense"))).alias("dims"))


def check(points: DataFrame, expected: int, kinds: tuple[str, ...] = ("docling_", "sendable_files_")) -> DataFrame:
    """(collection, points, dims, status) of the collections of these kinds: ok, mismatch or unknown."""
    of_kind = F.lit(False)
    for kind in kinds:
        of_kind = of_kind | F.col("collection").startswith(kind)
    status = F.when(F.col("dims").isNull(), "unknown").when(F.col("dims") == expected, "ok").otherwise("mismatch")
    return catalog(points).filter(of_kind).withColumn("status", status)


def totals(report: DataFrame) -> DataFrame:
    """(collections, ok, mismatched, unknown) of :func:`check`'s rows."""
    of = lambda status: F.count_if(F.col("status") == status).alias
    return report.agg(F.count(F.lit(1)).alias("collections"), of("ok")("ok"), of("mismatch")("mismatched"), of("unknown")("unknown"))


def mismatched(points: DataFrame, expected: int, kinds: tuple[str, ...] = ("docling_", "sendable_files_")) -> DataFrame:
    """The collections of these kinds that a reindex is due for, in order of their names."""
    return check(points, expected, kinds).filter("status <> 'ok'").select("collection").orderBy("collection")


def backup(points: DataFrame) -> DataFrame:
    """What a reindex needs: everything but the vectors."""
    return points.drop("dense")


def reindex(saved: DataFrame, embed: Callable[[object], object]) -> DataFrame:
    """Points with new vectors of their texts; parents and metadata stay."""
    return saved.withColumn("dense", embed(F.col("text")))


#: Makes vectors of a batch of texts, or raises.
Embedder = Callable[[list[str]], list[list[float]]]


def embedded(points: DataFrame, embed: Embedder, text: Column, batch: int = 50, strict: bool = False) -> DataFrame:
    """``points`` with new ``dense`` vectors of ``text``, asked for in batches of ``batch``, and ``failed``.

    The rows of a batch that fails have no vector and failed = true, so nothing is lost; with ``strict``
    the failure is raised. A vector for each text is asked of ``embed``, in order.
    """
    rows = points.drop("dense", "failed").withColumn("_input", text)
    schema = T.StructType([*points.drop("dense", "failed").schema.fields]).add("dense", T.ArrayType(T.DoubleType())).add("failed", T.BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), batch):
                part = whole.slice(i, batch)
                try:
                    made = embed(part.column("_input").to_pylist())
                    if len(made) != len(part):
                        raise ValueError("not a vector for each text")
                except Exception:
                    if strict:
                        raise
                    made = [None] * len(part)
                out = part.drop_columns("_input").append_column("dense", pa.array(made, pa.list_(pa.float64())))
                yield out.append_column("failed", pa.array([x is None for x in made]))

    return rows.mapInArrow(run, schema)


@dataclass(frozen=True)
class Reindexed:
    """A reindexed collection's points (all collections', with new vectors in this one), how many failed, and its statistics."""

    points: DataFrame
    failed: DataFrame
    corpus: DataFrame
    terms: DataFrame


def reindex_collection(points: DataFrame, collection: str, dims: int, embed: Embedder, batch: int = 50) -> Reindexed:
    """Makes a collection's vectors anew with ``dims`` dimensions and its statistics from its texts.

    ``points`` has (collection, id, text, title, dense, ...). All rows stay, with parents and metadata; rows of a
    batch that fails, or whose vector has other dimensions, are without a vector until a next run.
    """
    mine = F.col("collection") == collection
    made = embedded(backup(points.filter(mine)), embed, text.dense_input(F.col("title"), F.col("text")), batch)
    fits = F.coalesce(F.size("dense") == dims, F.lit(False))
    made = made.withColumn("failed", ~fits).withColumn("dense", F.when(fits, F.col("dense")))
    tokens = points.filter(mine).select("collection", F.col("id").alias("point_id"), text.terms(text.sparse_input(F.col("title"), F.col("text"))).alias("tokens"))
    kept = points.filter(~F.coalesce(mine, F.lit(False))).withColumn("dense", F.col("dense").cast("array<double>"))
    return Reindexed(kept.unionByName(made.drop("failed").select(kept.columns)), made.agg(F.count_if("failed").alias("failed")), stats.corpus_stats(tokens), stats.term_stats(tokens))


def validate(points: DataFrame, dims: int) -> DataFrame:
    """``points``, if their vectors have ``dims`` dimensions; else SchemaMismatch. Nothing is dropped or made anew."""
    if bad := points.filter(F.col("dense").isNotNull() & (F.size("dense") != dims)).limit(1).collect():
        raise SchemaMismatch(f"{bad[0].collection}: {len(bad[0].dense)} dimensions, not {dims}")
    return points


def recreate(points: DataFrame, collection: str) -> DataFrame:
    """``points`` without one collection's, which is then made anew with other dimensions; the others stay."""
    return points.filter(~F.coalesce(F.col("collection") == collection, F.lit(False)))


class Conflict(RuntimeError):
    """Another writer has written since the store was read."""


class Store:
    """Points below one folder: each write is a new version folder, partitioned by collection, and a new pointer file.

    Pointers are numbered and never changed, so a reader always finds the newest whole version.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[tuple[int, str]]:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/pointers")
        store = folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not store.exists(folder):
            return []
        names = [f.getPath().getName() for f in store.listStatus(folder)]
        return sorted((int(n), version) for n, _, version in (x.partition("-") for x in names) if n.isdigit())

    def read(self) -> DataFrame | None:
        found = self.versions()
        return self.spark.read.parquet(f"{self.path}/{found[-1][1]}") if found else None

    def write(self, points: DataFrame, after: str | None = None) -> str:
        """Writes a version and points to it. Raises Conflict if ``after`` is given and is no longer the newest, or two write at once."""
        found = self.versions()
        if after is not None and (not found or found[-1][1] != after):
            raise Conflict(f"{after} is not the newest version")
        version, number = f"v-{uuid.uuid4().hex}", found[-1][0] + 1 if found else 1
        points.write.partitionBy("collection").parquet(f"{self.path}/{version}")
        jvm = self.spark._jvm
        pointer = jvm.org.apache.hadoop.fs.Path(f"{self.path}/pointers/{number:012d}-{version}")
        store = pointer.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        store.create(pointer, False).close()
        rivals = [v for n, v in self.versions() if n == number]
        if version != max(rivals):  # all rivals see the same order, so one of them wins
            store.delete(pointer, False)
            raise Conflict(f"{max(rivals)} was written at the same time")
        return version
