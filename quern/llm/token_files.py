"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

An id is stored as its rank by corpus frequency, so the 256 most frequent ids take one byte. The
control codes stand apart from the data bytes: two bits a value say how many bytes it takes, four
values share a control byte. A file is

    magic "QTOK1\\0\\0\\0" | uint32 number of documents | uint64 number of ids | uint64 first id's place in the corpus
    int64 doc_id for each document | uint8 null flag for each document | uint32 number of ids for each document
    control bytes of all documents | data bytes of all documents

with little-endian numbers; each document starts a new control byte. Decoding looks every control
byte up in a table of lengths, sums them to offsets, and gathers the bytes of all values at once.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import delete, map_arrow, materialize, new_path, read_range, release, shuffle_parts, write_file
from quern.llm.encoding import encoder

MAGIC = b"QTOK1\0\0\0"
#: For each control byte the lengths of its four values.
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
_HEAD = "<8sIQQ"
_LEAST = -(1 << 63)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    return encode_many(values, np.array([len(values)]))[0]


def encode_many(values: np.ndarray, counts: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Control and data bytes of each document; ``values`` has all documents' numbers one after another."""
    v = np.ascontiguousarray(values, "<u4")
    code = (v > 0xFF).view(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    ends, quads = np.cumsum(counts), -(-counts // 4)
    quad_ends = np.cumsum(quads)
    slots = np.zeros(int(quads.sum()) * 4, np.uint8)
    slots[np.arange(len(v)) + np.repeat((quad_ends - quads) * 4 - (ends - counts), counts)] = code
    quad = slots.reshape(-1, 4)
    control = (quad[:, 0] | quad[:, 1] << 2 | quad[:, 2] << 4 | quad[:, 3] << 6).tobytes()
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) <= code[:, None]].tobytes()
    data_ends = np.concatenate([[0], np.cumsum(code, dtype=np.int64) + np.arange(1, len(v) + 1)])
    cut = zip((quad_ends - quads).tolist(), quad_ends.tolist(), data_ends[ends - counts].tolist(), data_ends[ends].tolist(), strict=True)
    return [(control[a:b], data[c:d]) for a, b, c, d in cut]


def decode_values(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all documents one after another; ``counts`` has how many each document has."""
    quads = -(-counts // 4)
    total = int(counts.sum())
    starts = np.concatenate([[0], np.cumsum(quads * 4)])[:-1]
    slots = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)])[:-1], counts) + np.arange(total)
    lengths = LENGTHS[control].ravel()[slots].astype(np.int64)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    out = np.zeros(total, np.uint32)
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    for k in range(4):
        has = lengths > k
        if not has.any():
            break
        out[has] |= padded[begins[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


_SPOOL = "path string, n_docs long, counts binary"


def encode_ids(docs: DataFrame, path: str, kind: str, end_id: int, spool_ids: int = 2_000_000) -> DataFrame:
    """Encodes every text, the end id last, into spool files of about ``spool_ids`` ids; a null text is empty.

    The written table has a row for each file: path, n_docs, and counts, how often each id is in it (a
    compressed array of int64). A name belongs to one attempt of a task; files of other attempts are in no row.
    """
    folder = new_path(docs.sparkSession, "spool")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path, kind), np.array([end_id], "<u4")
        held, ids, size = [], [], 0

        def flush() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            width = np.dtype("<u2") if flat.max() < 1 << 16 else np.dtype("<u4")
            sizes = np.array([len(x) for x in ids], np.int64).reshape(-1, 2).sum(axis=1)
            known = np.array([x is not None for x in held], np.uint8)
            head = struct.pack("<QQ", len(held), width.itemsize) + np.array([x or 0 for x in held], "<i8").tobytes() + known.tobytes() + sizes.astype("<u4").tobytes()
            name = f"{folder}/{uuid.uuid4().hex}.ids"
            write_file(name, zstandard.ZstdCompressor(level=1).compress(head + flat.astype(width).tobytes()))
            counts = zstandard.ZstdCompressor(level=1).compress(np.bincount(flat).astype("<i8").tobytes())
            return pa.RecordBatch.from_pylist([{"path": name, "n_docs": len(held), "counts": counts}])

        for batch in batches:
            for i in range(0, len(batch), 1000):
                part = batch.slice(i, 1000)
                for doc, found in zip(part.column("doc_id").to_pylist(), enc.encode(part.column("text")), strict=True):
                    held.append(doc)
                    ids += (found, end)
                    size += len(found) + 1
                    if size >= spool_ids:
                        yield flush()
                        held, ids, size = [], [], 0
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(map_arrow(rows, run, _SPOOL), "spool")


def read_spool(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, which of them are null, how many ids each document has, and all ids one after another."""
    raw = zstandard.ZstdDecompressor().decompress(read_range(path))
    n, width = struct.unpack_from("<QQ", raw)
    doc, known = np.frombuffer(raw, "<i8", n, 16), np.frombuffer(raw, np.uint8, n, 16 + 8 * n)
    sizes = np.frombuffer(raw, "<u4", n, 16 + 9 * n).astype(np.int64)
    return doc, known == 0, sizes, np.frombuffer(raw, f"<u{width}", offset=16 + 13 * n)


def id_counts(spool: DataFrame) -> DataFrame:
    """How often each id occurs in the whole corpus; added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for packed in batch.column("counts").to_pylist():
                more = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), "<i8").copy()
                if len(more) < len(total):
                    more, total = total, more
                more[: len(total)] += total
                total = more
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "n"])

    return map_arrow(spool.select("counts"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def frequency_order(spool: DataFrame) -> tuple[np.ndarray, int]:
    """Ids by falling frequency, then rising id, and the number of all ids. At most the tokenizer's vocabulary is collected."""
    rows = id_counts(spool).toPandas()
    ids, n = rows["id"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    return ids[np.lexsort((ids, -n))].astype(np.uint32), int(n.sum())


def _bounds(docs: DataFrame, buckets: int) -> np.ndarray:
    """Bounds of about even ranges of doc_id, null as the least: approximate quantiles, for which only doc_id is read."""
    key = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("doc_id"))
    found = key.approxQuantile("doc_id", [k / buckets for k in range(1, buckets)], 0.2 / buckets) if buckets > 1 else []
    return np.array(found, np.float64).astype(np.int64)


def _buckets(doc: np.ndarray, bounds: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """The bucket of each doc_id; a doc_id that fills several buckets is spread over them, as equal ones have no order."""
    first, last = np.searchsorted(bounds, doc, "left"), np.searchsorted(bounds, doc, "right")
    return first + salt % (last - first + 1)


def write_token_files(docs: DataFrame, spool: DataFrame, folder: str, order: np.ndarray, n_ids: int, file_ids: int = 4_000_000, part_ids: int = 16_000_000) -> DataFrame:
    """Writes the ids in ascending doc_id order (null first); returns the manifest.

    ``spool`` has the ids of ``docs``. They go by ranges of doc_id as coded bytes, about ``part_ids`` ids
    a part, and each range is written to files of about ``file_ids`` ids. The manifest has a row for
    each file: path, part and number (its place in the order), n_docs, n_ids, and start, the ids before
    it. A name belongs to one attempt of a task; only the files of the attempts that count are in it.
    """
    spark = spool.sparkSession
    ranks = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    ranks[order] = np.arange(len(order), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(ranks)
    parts = max(shuffle_parts(spark), -(-n_ids // part_ids))
    bounds = _bounds(docs, 4 * parts)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        for batch in batches:
            for path in batch.column("path").to_pylist():
                doc, null, sizes, ids = read_spool(path)
                ends = np.cumsum(sizes)
                bucket = _buckets(np.where(null, _LEAST, doc), bounds, sizes)
                for a in range(0, len(doc), 1000):
                    b = min(a + 1000, len(doc))
                    pairs = encode_many(rank[ids[ends[a] - sizes[a] : ends[b - 1]]], sizes[a:b])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc[a:b], pa.int64(), mask=null[a:b]), pa.array(bucket[a:b]), pa.array(sizes[a:b]), pa.array([c for c, _ in pairs], pa.binary()), pa.array([d for _, d in pairs], pa.binary())],
                        ["doc_id", "bucket", "n", "control", "data"],
                    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = -1, 0, [], 0

        def flush() -> pa.RecordBatch:
            path = f"{folder}/{part:06d}-{number:06d}-{uuid.uuid4().hex}.qtok"
            doc, n, control, data = zip(*held, strict=True)
            ids = np.array([x or 0 for x in doc], "<i8").tobytes() + np.array([x is None for x in doc], np.uint8).tobytes()
            head = struct.pack(_HEAD, MAGIC, len(held), size, 0)
            write_file(path, b"".join([head, ids, np.array(n, "<u4").tobytes(), *control, *data]))
            return pa.RecordBatch.from_pylist([{"path": path, "part": part, "number": number, "n_docs": len(held), "n_ids": size}])

        for batch in batches:
            for bucket, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "n", "control", "data")), strict=True):
                if bucket != part:
                    if held:
                        yield flush()
                    part, number, held, size = bucket, 0, [], 0
                held.append(row)
                size += row[1]
                if size >= file_ids:
                    yield flush()
                    number, held, size = number + 1, [], 0
        if held:
            yield flush()

    order_by = ["bucket", F.col("doc_id").asc_nulls_first(), "n", "control", "data"]
    coded = map_arrow(spool.select("path").repartition(parts, "path"), code, "doc_id long, bucket long, n long, control binary, data binary")
    ranged = coded.repartition(parts, "bucket").sortWithinPartitions(*order_by)
    files = materialize(map_arrow(ranged, write, "path string, part long, number long, n_docs long, n_ids long"), "files")
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("of_part")).withColumn("before", F.sum("of_part").over(W.orderBy("part")) - F.col("of_part"))
    inside = F.sum("n_ids").over(W.partitionBy("part").orderBy("number")) - F.col("n_ids")
    return files.withColumn("inside", inside).join(parts, "part").select("path", "part", "number", "n_docs", "n_ids", (F.col("before") + F.col("inside")).alias("start"))


def _documents(manifest: DataFrame, order: np.ndarray, made: Callable[[np.ndarray, np.ndarray], pa.Array], name: str, kind: str) -> DataFrame:
    """Decodes the files: doc_id, start (ids of all documents before it), n_tokens, and what ``made`` gives of 1,000 documents' ids and their ends."""
    spark = manifest.sparkSession
    shared = spark.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = shared.value.astype("<u4")
        for batch in batches:
            for row in batch.to_pylist():
                raw = read_range(row["path"])
                magic, n, total, _ = struct.unpack_from(_HEAD, raw)
                if magic != MAGIC or n != row["n_docs"] or total != row["n_ids"]:
                    raise ValueError(f"{row['path']} is not the file that was written")
                at = struct.calcsize(_HEAD)
                doc = np.frombuffer(raw, "<i8", n, at)
                null = np.frombuffer(raw, np.uint8, n, at + 8 * n).astype(bool)
                counts = np.frombuffer(raw, "<u4", n, at + 9 * n).astype(np.int64)
                at += 13 * n
                n_control = int((-(-counts // 4)).sum())
                control = np.frombuffer(raw, np.uint8, n_control, at)
                ids = ids_of[decode_values(control, np.frombuffer(raw, np.uint8, offset=at + n_control), counts)]
                ends = np.cumsum(counts)
                for i in range(0, n, 1000):
                    k = slice(i, i + 1000)
                    first = int(ends[i] - counts[i])
                    columns = [pa.array(doc[k], pa.int64(), mask=null[k]), pa.array((ends - counts)[k] + row["start"], pa.int64()), pa.array(counts[k])]
                    yield pa.RecordBatch.from_arrays([*columns, made(ids[first : int(ends[k][-1])], ends[k] - first)], ["doc_id", "start", "n_tokens", name])

    return map_arrow(manifest.repartition(shuffle_parts(spark), "path"), run, f"doc_id long, start long, n_tokens long, {name} {kind}")


def _parts(ids: np.ndarray, ends: np.ndarray) -> Iterator[memoryview]:
    raw, begin = memoryview(ids).cast("B"), 0
    for end in (4 * ends).tolist():
        yield raw[begin:end]
        begin = end


def read_token_files(manifest: DataFrame, order: np.ndarray) -> DataFrame:
    """Decodes the files: doc_id, start (ids of all documents before it), n_tokens and ids (little-endian uint32)."""
    return _documents(manifest, order, lambda ids, ends: pa.array([x.tobytes() for x in _parts(ids, ends)], pa.binary()), "ids", "binary")


def digest_token_files(manifest: DataFrame, order: np.ndarray) -> DataFrame:
    """Decodes the files: doc_id, start, n_tokens and the CRC-32 of the ids, which stay in the task that reads them."""
    return _documents(manifest, order, lambda ids, ends: pa.array([zlib.crc32(x) for x in _parts(ids, ends)], pa.int64()), "ids_crc32", "long")


def make_token_files(docs: DataFrame, path: str, kind: str = "byte", end_id: int = 2) -> tuple[DataFrame, np.ndarray]:
    """Encodes every text and writes the files; their manifest, and the ids by rank.

    Null texts are empty and get only the end id; null doc_ids come first; repeated rows are each
    written, equal doc_ids in any order. Other columns are ignored. An empty table writes no file.
    """
    spark: SparkSession = docs.sparkSession
    spool = encode_ids(docs, path, kind, end_id)
    order, n_ids = frequency_order(spool)
    manifest = materialize(write_token_files(docs, spool, new_path(spark, "tokens"), order, n_ids), "manifest")
    for folder in spool.select(F.regexp_extract("path", "^(.*)/", 1).alias("folder")).distinct().collect():  # the one folder of the spool
        delete(spark, folder.folder)
    release(spool)
    return manifest, order


def token_file_round_trip(docs: DataFrame, path: str, kind: str = "byte", end_id: int = 2) -> DataFrame:
    """Encodes every text, writes the files, reads them back: doc_id, start, n_tokens, ids. See :func:`make_token_files`."""
    return read_token_files(*make_token_files(docs, path, kind, end_id))
