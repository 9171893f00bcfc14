"""Exact deduplication by content-defined chunk recipes.

A text, without its ASCII white space, is cut where a rolling hash of the last 16 bytes meets a
mask, so equal content is cut alike wherever it stands. Each chunk is named by a digest. The
names are verified: chunks move once, sorted by name, and the bytes of equal names are compared;
if two different chunks share a name, a wider digest replaces it for the whole corpus. A text is
then its recipe, the ordered list of names, and texts are equal exactly if their recipes are. Only
recipes are grouped, so a long document's bytes are never moved to be compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ASCII_SPACE, RID, join_groups, map_arrow, map_batches, materialize, numbered, shuffle_parts, text_bytes, without_rows

#: Chunks have about MASK + 1 bytes more than MIN_CHUNK, and no more than MAX_CHUNK.
MASK, MIN_CHUNK, MAX_CHUNK, WINDOW = 2047, 512, 16384, 16
_GEAR = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint32)

#: Digests in the order tried; a later one only if an earlier one gave different chunks one name.
DIGESTS: tuple[Callable[[bytes], bytes], ...] = (
    lambda b: hashlib.blake2b(b, digest_size=16).digest(),
    lambda b: hashlib.sha256(b).digest(),
    lambda b: hashlib.sha3_512(b).digest(),
)


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``; the last is its length. No chunk for no data."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n] if n else []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    width = 1
    while width < WINDOW:  # doubles the window the hash covers
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    ends, last = [], 0
    for at in (np.flatnonzero((h & np.uint32(MASK << 5)) == 0) + 1).tolist():
        while at - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if at - last >= MIN_CHUNK:
            ends.append(at)
            last = at
    while n - last > MAX_CHUNK:
        last += MAX_CHUNK
        ends.append(last)
    return ends if last == n else [*ends, n]


def chunks(data: bytes) -> list[bytes]:
    ends = cut_points(data)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def normalized(text: bytes) -> bytes:
    return text.translate(None, ASCII_SPACE)


def _recipes(df: DataFrame, digest: Callable[[bytes], bytes]) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = text_bytes(batch.column("text"))
        bare = [normalized(x) for x in data]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(RID),
                batch.column("doc_id"),
                pa.array([len(x.decode()) for x in data], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in bare]),
                pa.array([b"".join(map(digest, chunks(x))) for x in bare], pa.binary()),
            ],
            [RID, "doc_id", "n_points", "text_sha256", "recipe"],
        )

    return map_batches(df, run, f"{RID} long, doc_id long, n_points long, text_sha256 string, recipe binary")


def _clashes(df: DataFrame, digest: Callable[[bytes], bytes], remembered: int = 16 << 20) -> DataFrame:
    """Names that stand for more than one chunk.

    A task doesn't send again a chunk that is among the last ``remembered`` bytes of chunks it sent.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[bytes, bytes] = {}
        held = 0
        for batch in batches:
            names, bodies, size = [], [], 0
            for text in text_bytes(batch.column("text")):
                for chunk in chunks(normalized(text)):
                    name = digest(chunk)
                    if met.get(name) == chunk:
                        continue
                    if held >= remembered:
                        met.clear()
                        held = 0
                    met[name] = chunk
                    held += len(chunk) + 150  # with what Python adds
                    names.append(name)
                    bodies.append(chunk)
                    size += len(chunk)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(bodies, pa.binary())], ["name", "body"])
                    names, bodies, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(bodies, pa.binary())], ["name", "body"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = body = None
        for batch in batches:
            bad = []
            for a, b in zip(batch.column("name").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if a != name:
                    name, body = a, b
                elif b != body:
                    bad.append(a)
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.binary())], ["name"])

    sent = map_arrow(df.select("text"), emit, "name binary, body binary")
    return map_arrow(sent.repartition(shuffle_parts(df.sparkSession), "name").sortWithinPartitions("name"), compare, "name binary")


def recipes(rows: DataFrame, digests: Sequence[Callable[[bytes], bytes]] = DIGESTS) -> DataFrame:
    """One row for each of the numbered ``rows``: its number, doc_id, n_points, text_sha256 and its verified recipe."""
    df = rows.select(RID, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for digest in digests:
        if not _clashes(df, digest).limit(1).collect():
            return materialize(_recipes(df, digest), "recipes")
    raise ValueError("every digest gave different chunks one name")


def _decided(rows: DataFrame, digests: Sequence[Callable[[bytes], bytes]]) -> DataFrame:
    """:func:`exact_duplicates` of numbered rows, with their numbers."""
    table = recipes(rows, digests)
    best: Column = F.max(F.struct("n_points", (-F.col("doc_id")).alias("neg_id"), (-F.col(RID)).alias("neg_rid")))
    groups = table.groupBy("recipe").agg(best.alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = materialize(groups.select("recipe", "n", (-F.col("best.neg_id")).alias("first_id"), (-F.col("best.neg_rid")).alias("first_rid")), "repeated")
    single = F.col("n").isNull()
    return join_groups(table, groups, "recipe", "n").select(
        RID,
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col(RID) == F.col("first_rid"))).alias("kept"),
        "text_sha256",
    )


def exact_duplicates(docs: DataFrame, digests: Sequence[Callable[[bytes], bytes]] = DIGESTS) -> DataFrame:
    """Groups documents whose texts are identical without ASCII white space.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256. Of a group the row
    with the most code points in its original text stays, then the smallest doc_id (null last), then
    the first of repeated rows. Null texts count as empty; empty texts are one group. Other columns
    are ignored. An empty table gives an empty result. Large groups are joined by a broadcast of
    bounded size and small ones by a shuffle of recipes, so a group of copies meets in no task.
    """
    return _decided(numbered(docs.select("doc_id", "text")), digests).drop(RID)


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group left, the one :func:`exact_duplicates` keeps; all columns stay.

    Rows go by their numbers, not by doc_id, so null and repeated doc_ids do no harm, and texts aren't moved.
    """
    rows = numbered(docs)
    table = materialize(_decided(rows, DIGESTS).select(RID, "kept"), "decided")
    return without_rows(rows, table.filter("NOT kept"), table)
