"""Benchmark decontamination by suffix arrays.

The documents of an Arrow batch are one shard. A shard's words become numbers of the benchmark's
vocabulary, and its suffix array holds, in order, the word suffixes that start with a word pair of
the benchmark (no other suffix can match two words of it). Every benchmark suffix is looked up by
binary search, all at once; the range found gives every verbatim occurrence and its place, and each
occurrence is extended to its full length. Shards are independent, so the corpus is read once and
nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import free_name, map_arrow, new_path, read_range, text_bytes, without_column, write_file

#: Words in a window; fixed by the contract of the contamination rule.
WINDOW = 13
#: Lower-cases A-Z and turns \x00-\x2F, \x3A-\x60 and \x7B-\x7F into spaces, after lower-casing.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

SCHEMA = (
    "n_words long, n_hit long, item_ids array<string>, "
    "matches array<struct<item_id: string, doc_start: long, item_start: long, n_words: long>>, contaminated boolean"
)


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Benchmark:
    """The benchmark as arrays: all items' words as numbers from 1, 0 between items."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window, self.ids = window, [i for i, _ in items]
        split = [words((t or "").encode()) for _, t in items]
        self.vocabulary: dict[bytes, int] = {}
        number = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        flat: list[int] = []
        starts, lengths, owner, at = [], [], [], []
        for k, ws in enumerate(split):
            base = len(flat)
            flat += [number(w) for w in ws] + [0] * window
            n = min(window, len(ws))
            for i in range(len(ws) - n + 1 if ws else 0):
                starts.append(base + i)
                lengths.append(n)
                owner.append(k)
                at.append(i)
        self.flat = np.array(flat, np.int64)
        self.starts, self.lengths, self.owner, self.at = (np.array(x, np.int64) for x in (starts, lengths, owner, at))
        self.shortest = int(self.lengths.min()) if len(starts) else 0
        self.base = len(self.vocabulary) + 1
        self.width = np.dtype(">u2") if self.base < 1 << 16 else np.dtype(">u4")
        depth = self.flat[self.starts[:, None] + np.arange(window)] if len(starts) else np.zeros((0, window), np.int64)
        mask = np.arange(window) < self.lengths[:, None]
        top = np.iinfo(self.width).max
        self.low = self.packed(np.where(mask, depth, 0))
        self.high = self.packed(np.where(mask, depth, top))
        pairs = self.flat[:-1] * self.base + self.flat[1:]
        self.pairs = np.unique(pairs[(self.flat[:-1] > 0) & (self.flat[1:] > 0)])

    def packed(self, rows: np.ndarray) -> np.ndarray:
        """Rows of word numbers as byte strings that sort the same way."""
        return np.ascontiguousarray(rows.astype(self.width)).view(f"S{self.window * self.width.itemsize}").ravel()

    def numbers(self, ws: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in ws), np.int64, len(ws))

    def suffix_array(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the suffixes that can match, in the order of their first ``window`` words, and these words."""
        if self.shortest >= 2:
            pair = flat[:-1] * self.base + flat[1:]
            near = np.searchsorted(self.pairs, pair)
            near[near == len(self.pairs)] = 0
            places = np.flatnonzero((self.pairs[near] == pair) & (flat[:-1] > 0) & (flat[1:] > 0))
        else:
            places = np.flatnonzero(flat > 0)
        keys = self.packed(flat[places[:, None] + np.arange(self.window)])
        order = np.argsort(keys, kind="stable")
        return places[order], keys[order]

    def search(self, texts: list[bytes]) -> list[dict]:
        """For each text of a shard its words, hit words, items found and longest matches."""
        split = [words(t) for t in texts]
        ends = np.cumsum([len(w) + self.window for w in split])
        begins = ends - [len(w) + self.window for w in split]
        flat = np.zeros(int(ends[-1]) + 1 if len(texts) else 1, np.int64)
        for b, ws in zip(begins.tolist(), split, strict=True):
            flat[b : b + len(ws)] = self.numbers(ws)
        out = [{"n_words": len(w), "n_hit": 0, "item_ids": set(), "matches": []} for w in split]
        if not len(self.starts) or not len(texts):
            return out
        places, keys = self.suffix_array(flat)
        first, last = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        sizes = last - first
        which = np.repeat(np.arange(len(sizes)), sizes)
        where = places[np.repeat(first, sizes) + np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
        marks = np.zeros(len(flat) + 1, np.int64)
        np.add.at(marks, where, 1)
        np.add.at(marks, where + self.lengths[which], -1)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(marks[:-1]) > 0)])
        doc = np.searchsorted(ends, where, "right")
        for k in np.unique(doc).tolist():
            out[k]["n_hit"] = int(covered[ends[k]] - covered[begins[k]])
        for k, item in np.unique(np.stack([doc, self.owner[which]], 1), axis=0).tolist():
            if self.ids[item] is not None:
                out[k]["item_ids"].add(self.ids[item])
        # A run of windows, each one word on in both texts, is one longest match.
        order = np.lexsort((where, where - self.starts[which]))
        w, s, d = where[order], which[order], doc[order]
        shift = w - self.starts[s]
        head = np.ones(len(w), bool)
        head[1:] = (np.diff(w) != 1) | (np.diff(shift) != 0) | (np.diff(self.owner[s]) != 0) | (np.diff(d) != 0)
        at = np.flatnonzero(head)
        stop = np.append(at[1:], len(w)) - 1
        for a, b in zip(at.tolist(), stop[: len(at)].tolist(), strict=True):
            k = int(d[a])
            out[k]["matches"].append(
                {
                    "item_id": self.ids[self.owner[s[a]]],
                    "doc_start": int(w[a] - begins[k]),
                    "item_start": int(self.at[s[a]]),
                    "n_words": int(w[b] - w[a] + self.lengths[s[b]]),
                }
            )
        return out


def _covered(matches: list[dict]) -> int:
    total = end = 0
    for a, b in sorted((m["doc_start"], m["doc_start"] + m["n_words"]) for m in matches):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def load_benchmark(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = 2 << 20) -> Iterator[Benchmark]:
    """The items in blocks of at most ``block_bytes`` of text (or one longer item), read one after another."""
    items, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    for row in rows.toLocalIterator():
        more = len((row.text or "").encode())
        if items and size + more > block_bytes:
            yield Benchmark(items, window)
            items, size = [], 0
        items.append((row.item_id, row.text))
        size += more
    yield Benchmark(items, window)


def find_benchmark_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = 6 << 20, column: str = "passages", block_bytes: int = 2 << 20) -> DataFrame:
    """Adds to each row of ``docs`` its n_words, n_hit, item_ids, matches and whether it is contaminated.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one
    window. n_hit counts the words inside any occurrence of a window, item_ids has the items with
    occurring windows (each once, sorted; null ids mark words but are not listed), matches the longest
    verbatim matches with their places. A row is contaminated if n_hit > 0 and 20 * n_hit >= n_words.
    Null and empty texts have no words and are clean; equal rows get equal results. The added columns
    stand in one struct, ``column``, which takes the place of a column of ``docs`` with that name.

    The first ``block_bytes`` of the benchmark's text, about 40 MB of arrays, are broadcast. A larger one is
    cut into blocks of that size, one at a time on the driver, which stand in the shared folder; each
    shard reads one after another and merges the matches.
    """
    spark, docs = docs.sparkSession, without_column(docs, column)
    folder, paths, first = new_path(spark, "benchmark"), [], None
    for k, block in enumerate(load_benchmark(benchmark, window, block_bytes)):
        if k == 0:
            first = spark.sparkContext.broadcast(block)
        else:
            paths.append(f"{folder}/{k}.pickle")
            write_file(paths[-1], pickle.dumps(block))

    def found(texts: list[bytes]) -> list[dict]:
        out = first.value.search(texts)
        for path in paths:
            for mine, other in zip(out, pickle.loads(read_range(path)).search(texts), strict=True):
                mine["item_ids"] |= other["item_ids"]
                mine["matches"] += other["matches"]
                mine["n_hit"] = _covered(mine["matches"])
        for x in out:
            x["item_ids"] = sorted(x["item_ids"])
            x["contaminated"] = x["n_hit"] > 0 and 20 * x["n_hit"] >= x["n_words"]
        return out

    kind = pa.struct(
        [
            ("n_words", pa.int64()),
            ("n_hit", pa.int64()),
            ("item_ids", pa.list_(pa.string())),
            ("matches", pa.list_(pa.struct([("item_id", pa.string()), ("doc_start", pa.int64()), ("item_start", pa.int64()), ("n_words", pa.int64())]))),
            ("contaminated", pa.bool_()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            begin = size = 0
            for k, text in enumerate(texts):
                size += len(text)
                if size >= shard_bytes or k == len(texts) - 1:
                    part = batch.slice(begin, k + 1 - begin)
                    yield part.append_column(column, pa.array(found(texts[begin : k + 1]), kind))
                    begin, size = k + 1, 0

    return map_arrow(docs, run, T.StructType([*docs.schema.fields]).add(column, T.StructType.fromDDL(SCHEMA)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the contaminated rows."""
    name = free_name(docs, "passages")
    return find_benchmark_passages(docs, benchmark, window, column=name).filter(~F.col(name).contaminated).select(docs.columns)


def item_digest(item_ids: list[str]) -> str:
    return hashlib.sha256(",".join(item_ids).encode()).hexdigest()
