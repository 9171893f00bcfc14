"""Best-fit packing with large-item matching.

Only lengths decide how pieces are packed, and there are at most ``capacity`` of them. So the plan
is made on the driver from the histogram of lengths, whatever the number of documents: runs of
equal sequences are treated at once. Pieces above one third of the capacity go at most two to a
sequence and are matched greedily, the longest with the longest that still fits; smaller pieces,
longest first, go to the smallest gap that takes them. A plan is a list of steps "pieces of length
L with ranks from a to b go to sequences from s on, at offset o"; each piece finds its step by its
rank among the pieces of its length, which is counted by task and summed.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import map_arrow, materialize
from quern.llm.encoding import encoder


def pack_plan(histogram: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length its steps (first rank, pieces, first sequence, offset), by first rank.

    The number of steps depends on the number of distinct lengths, not of pieces: a step uses up
    either a length or a run of equal sequences, and each step adds at most one run.
    """
    steps: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    left = {n: c for n, c in histogram.items() if c > 0}
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: runs (first sequence, sequences)
    sizes: list[int] = []  # gaps that have runs, rising
    made = 0

    def put(length: int, run: tuple[int, int], offset: int) -> None:
        steps[length].append((used[length], run[1], run[0], offset))
        used[length] += run[1]
        left[length] -= run[1]

    def free(gap: int, run: tuple[int, int]) -> None:
        if gap > 0:
            if not gaps[gap]:
                insort(sizes, gap)
            gaps[gap].append(run)

    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):
        while left[n] > 0:
            fit = bisect_left(large, capacity - n + 1) - 1  # the longest that fits beside n
            while fit >= 0 and (left[large[fit]] <= 0 or large[fit] > n):
                fit -= 1
            mate = large[fit] if fit >= 0 else None
            if mate == n:
                pairs = left[n] // 2
                if pairs:
                    put(n, (made, pairs), 0)
                    put(n, (made, pairs), n)
                    free(capacity - 2 * n, (made, pairs))
                    made += pairs
                    continue
                fit -= 1
                while fit >= 0 and left[large[fit]] <= 0:
                    fit -= 1
                mate = large[fit] if fit >= 0 else None
            count = left[n] if mate is None else min(left[n], left[mate])
            put(n, (made, count), 0)
            if mate is not None:
                put(mate, (made, count), n)
            free(capacity - n - (mate or 0), (made, count))
            made += count
    for n in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[n] > 0:
            k = bisect_left(sizes, n)
            if k == len(sizes):  # new sequences, filled with this length
                each = capacity // n
                if full := left[n] // each:
                    for i in range(each):
                        put(n, (made, full), i * n)
                    free(capacity - each * n, (made, full))
                    made += full
                else:
                    free(capacity, (made, 1))
                    made += 1
                continue
            gap = sizes[k]
            first, count = gaps[gap].pop()
            if not gaps[gap]:
                sizes.pop(k)
            take = min(count, left[n])
            put(n, (first, take), capacity - gap)
            if take < count:
                free(gap, (first + take, count - take))
            free(gap - n, (first, take))
    return dict(steps)


def cut_pieces(docs: DataFrame, path: str, kind: str, end_id: int, capacity: int) -> DataFrame:
    """The written table of pieces: doc_id, piece, start, length, ids_crc32, and task and rank.

    rank numbers the pieces of one length within the task that cut them; the table is the only
    source of both, so a repeated task does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, enc, seen = TaskContext.get().partitionId(), encoder(path, kind), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                rows = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), enc.encode(part.column("text")), strict=True):
                    raw = ids.tobytes() + end
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        piece = raw[at : at + 4 * capacity]
                        n = len(piece) // 4
                        rows.append((doc, k, at // 4, n, zlib.crc32(piece), task, int(seen[n])))
                        seen[n] += 1
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]
                kinds = [pa.int32() if x == "piece" else pa.int64() for x in names]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(map_arrow(rows, run, "doc_id long, piece int, start long, length long, ids_crc32 long, task long, rank long"), "pieces")


def pack(docs: DataFrame, path: str, kind: str = "word", end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Packs every text into sequences of at most ``capacity`` tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A document
    is its ids and the end id; longer ones are cut into pieces of ``capacity``, the last may be
    shorter. Pieces lie without gaps from offset 0. Null and empty texts are one piece with the end
    id; null doc_ids and repeated rows are packed like any; other columns are ignored; an empty
    table gives no row.
    """
    spark = docs.sparkSession
    pieces = cut_pieces(docs, path, kind, end_id, capacity)
    counts = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    base = counts.withColumn("base", F.sum("n").over(W.partitionBy("length").orderBy("task")) - F.col("n")).drop("n")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    plan = {n: tuple(np.array(x, np.int64) for x in zip(*steps, strict=True)) for n, steps in pack_plan(histogram, capacity).items()}
    shared = spark.sparkContext.broadcast(plan)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            rank = rank + batch.column("base").to_numpy()
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for n in np.unique(length).tolist():
                ranks, _, first, at = steps[n]
                mine = np.flatnonzero(length == n)
                k = np.searchsorted(ranks, rank[mine], "right") - 1
                sequence[mine] = first[k] + rank[mine] - ranks[k]
                offset[mine] = at[k]
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(base, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", "rank", "base")
    return map_arrow(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
