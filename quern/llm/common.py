"""Helpers that every operator of this subpackage shares.

Intermediate results are written as Parquet below ``spark.checkpoint.dir``, the folder the
cluster shares, so a lost executor costs a re-read and never a recomputed lineage. Files in the
operators' own formats go there too, each under a name no other attempt uses.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of an Arrow batch, of which a worker holds a few at once.
BATCH_BYTES = 4 << 20
#: The bytes \x20 and \x09-\x0D, fixed by the operators' contracts.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as a URI; only on one machine, as in tests, a temporary one where none is configured."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", base)
    # A path without a scheme is of the cluster's default file system, for Spark and for files written by workers alike.
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    return path.getFileSystem(_hadoop(spark)).makeQualified(path).toString().rstrip("/")


def _hadoop(spark: SparkSession):
    return spark._jsparkSession.sessionState().newHadoopConf()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(_hadoop(spark)).delete(target, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns the written table, which cuts the lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables written by :func:`materialize` that nothing returned still reads."""
    for df in tables:
        if path := getattr(df, "_quern_path", None):
            delete(df.sparkSession, path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without_column(df: DataFrame, name: str) -> DataFrame:
    """``df`` without the columns called ``name``, in any case."""
    return df.select(*(c for c in df.columns if c.lower() != name.lower()))


def reclaim(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more, which it does on collection only."""
    gc.collect()
    spark._jvm.System.gc()


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def _trim() -> None:
    """Gives memory that the worker no longer uses back to the system, as workers are used again by later tasks."""
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow, on batches of at most BATCH_BYTES (or one longer row), by workers that give back their memory when a task ends."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            _trim()

    return df.mapInArrow(bounded, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str) -> DataFrame:
    """Runs ``fn`` on each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return map_arrow(df, run, schema)


#: A column of row numbers: the partition of the scan times 2**33, and the row's place in it.
RID = "_quern_rid"
PART_BITS = 33


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with its rows numbered in a column RID, which no column of ``docs`` may be called.

    Numbers are the same whenever the result is read. They follow the scan of a table; what isn't a
    plain scan is written first.
    """
    spark = docs.sparkSession
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):  # else files are cut by the cores at hand, which may change
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    plan = docs._jdf.queryExecution().executedPlan().toString()
    if re.search(r"Exchange|InArrow|InPandas|EvalPython|Limit|Sample|Union|Join|Generate|InMemory(Table|Rel)|\brand", plan):
        docs = materialize(docs, "numbered")
    return docs.withColumn(RID, F.monotonically_increasing_id())


def write_marks(marks: DataFrame, rows: DataFrame) -> str:
    """Writes what ``marks`` says of rows to one file for each partition of their scan, and returns the folder.

    ``marks`` has RID and other columns, any number of rows for a RID; ``rows`` has the RID of every
    row. The file of a partition has the same name and content in every attempt. So a later scan finds
    its rows' marks without a shuffle of the rows. The file has the partition's number of rows, too,
    so a scan that is cut in another way is an error and never a wrong result.
    """
    spark = marks.sparkSession
    folder = new_path(spark, "marks")
    part = lambda c: F.shiftright(c, PART_BITS).alias("part")
    every = rows.groupBy(part(F.col(RID))).agg(F.count(F.lit(1)).alias("of_part"))
    marked = marks.select(part(F.col(RID)), *marks.columns).withColumn("some", F.lit(True))
    both = every.unionByName(marked, allowMissingColumns=True)
    schema = pa.schema([(f.name, _arrow(f.dataType)) for f in marks.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = None, [], 0

        def flush() -> None:
            if at is not None:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, schema.with_metadata({"rows": str(size)}), options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_table(pa.Table.from_batches(held, schema).replace_schema_metadata({"rows": str(size)}).combine_chunks())
                write_file(f"{folder}/{at}.marks", sink.getvalue().to_pybytes())

        for batch in batches:
            parts = batch.column("part").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]])).tolist() if len(parts) else []
            for a, b in zip(cuts, [*cuts[1:], len(parts)], strict=True):
                if parts[a] != at:
                    flush()
                    at, held, size = int(parts[a]), [], 0
                some = batch.slice(a, b - a)
                size += pc.sum(some.column("of_part")).as_py() or 0
                some = some.filter(some.column("some").fill_null(False))
                held.append(pa.RecordBatch.from_arrays([some.column(c).cast(schema.field(c).type) for c in schema.names], schema=schema))
        flush()
        yield pa.RecordBatch.from_pylist([{"done": 1}])

    dealt = both.repartition(shuffle_parts(spark), "part").sortWithinPartitions("part", RID)
    map_arrow(dealt, run, "done long").agg(F.sum("done")).collect()
    return folder


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def marked(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[tuple[pa.RecordBatch, pa.Table, np.ndarray]]:
    """In a task over numbered rows: each batch, the marks of its rows, and for each mark the row of the batch it is of."""
    part = marks = numbers = None
    met = 0
    for batch in batches:
        if not len(batch):
            continue
        met += len(batch)
        rid = batch.column(RID).to_numpy()
        if part is None:
            part = int(rid[0] >> PART_BITS)
            marks = pa.ipc.open_stream(pa.py_buffer(read_range(f"{folder}/{part}.marks"))).read_all()
            numbers = marks.column(RID).to_numpy()
        a, b = np.searchsorted(numbers, rid[0]), np.searchsorted(numbers, rid[-1], "right")
        yield batch, marks.slice(int(a), int(b - a)), np.searchsorted(rid, numbers[a:b])
    if part is not None and met != int(marks.schema.metadata[b"rows"]):
        raise ValueError(f"partition {part} has {met} rows, not those that were marked")


def without_rows(docs: DataFrame, gone: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs``, numbered, without the rows whose RID is in ``gone``; its columns but RID. ``rows`` has the RID of every row."""
    columns = [c for c in docs.columns if c != RID]
    folder = write_marks(gone.select(RID).distinct(), rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, at in marked(batches, folder):
            keep = np.ones(len(batch), bool)
            keep[at] = False
            yield batch.filter(pa.array(keep)).select(columns)

    return map_arrow(docs, run, docs.select(columns).schema)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, most: int = 20_000) -> DataFrame:
    """``rows`` left-joined with ``groups`` (one row a key, ``size`` rows of ``rows`` have it) by a key without nulls.

    A group with more than a ``most``-th of all rows is large, so there are fewer than ``most`` large
    groups, whatever the input: these are broadcast, and no key that many rows have is shuffled. The
    others are joined by a shuffle. ``rows`` should be narrow, as it is read twice.
    """
    least = max(100, rows.count() // most)
    large = F.broadcast(groups.filter(F.col(size) > least))
    rest = rows.join(large.select(key), key, "left_anti").join(groups.filter(F.col(size) <= least), key, "left")
    return rows.join(large, key).unionByName(rest)


class WordHashes(dict):
    """64-bit hashes of words, kept for the words met so far; emptied when it has grown to ``limit``."""

    def __init__(self, limit: int = 400_000):
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def write_file(path: str, data: bytes) -> None:
    """Writes one file of the shared folder, whole or not at all."""
    if path.startswith("file:"):
        local = path.removeprefix("file://").removeprefix("file:")
        os.makedirs(os.path.dirname(local), exist_ok=True)
        part = f"{local}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, local)
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(inner), recursive=True)
    with store.open_output_stream(inner) as f:
        f.write(data)


def read_range(path: str, start: int = 0, length: int | None = None) -> bytes:
    """Bytes of a file of the shared folder, from ``start``; fewer where the file ends."""
    if path.startswith("file:"):
        with open(path.removeprefix("file://").removeprefix("file:"), "rb") as f:
            f.seek(start)
            return f.read() if length is None else f.read(length)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_file(inner) as f:
        f.seek(start)
        return f.read() if length is None else f.read(length)
