"""Katz backoff bigram model with Good-Turing discounts and exactly normalised backoff weights.

Texts are read once into blocks: a written table of the words' hashes and the tokens as numbers into
them. A block asks each part of the word table for its words' counts, then each part of the bigram
table for its bigrams, sending every distinct one once with its count in the block's training texts;
the part adds these up to the corpus's counts and answers in the order asked. So no table is ever
held whole by a task, hot words weigh one entry a block, and what is exchanged grows with the corpus.
Bigrams go by their history, so its sums are made where they are; those of histories with a fixed
share of all tokens go by history and follower, and their sums, few by that share, are added up.
The model's tables stay as Parquet files by part. Each token is scored recursively: the discounted
bigram if it was seen, else the history's backoff weight times the discounted word, and for a word
never seen the mass that the words' discounts left.

Words are known by 64-bit hashes, the follower of a history by 48 bits of them.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import WordHashes, map_arrow, materialize, mix, new_path, read_range, reclaim, shuffle_parts, text_bytes, write_file

#: Counts above this are not discounted; tokens in a block.
MOST, BLOCK_TOKENS = 5, 2_500_000
#: Tokens for which there is one part at least, of words or bigrams.
PART_TOKENS = 4_000_000
#: The end of a text, counted as a token, and the place before its first; no word has these hashes.
END, START = 1, 0
_LOW48 = np.uint64((1 << 48) - 1)


def packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def planes(x: np.ndarray) -> np.ndarray:
    """Unsigned 32-bit numbers by byte: all first bytes, then all second ones, and so on."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)


def unplaned(data: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(data.reshape(4, -1).T).view("<u4").ravel()


def training(doc_id: str = "doc_id"):
    """Rows learned from: crc32 of the doc_id as text, modulo 5, is not 1. A null doc_id is one of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 1, F.lit(True))


def discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """d[r] for r of 0 to MOST + 1 (the last for all larger counts): Good-Turing as Katz has it.

    Where the counts of counts give no number between 0 and 1, r loses a fixed amount instead.
    """
    n = np.concatenate([[0], counts_of_counts]).astype(float)  # n[r] for r up to MOST + 1
    lost = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    d = np.ones(MOST + 2)
    top = (MOST + 1) * n[MOST + 1] / n[1] if n[1] else 1.0
    for r in range(1, MOST + 1):
        star = (r + 1) * n[r + 1] / n[r] / r if n[r] else 0.0
        value = (star - top) / (1 - top) if top < 1 else 0.0
        d[r] = value if 0 < value < 1 else (r - lost) / r
    return d


@dataclass
class Words:
    """The word level: tokens and distinct words in training, and discounts."""

    tokens: int
    distinct: int
    of_counts: np.ndarray

    def __post_init__(self):
        self.d = discounts(self.of_counts)
        r = np.arange(1, MOST + 1)
        left = float((self.of_counts[:MOST] * r * (1 - self.d[1 : MOST + 1])).sum()) / max(1, self.tokens)
        self.unseen = max(left, 1 / (self.tokens + 1))
        self.scale = (1 - self.unseen) / (1 - left) if left < 1 else 0.0

    def p(self, c: np.ndarray) -> np.ndarray:
        """The probability of words with counts ``c``; a count of 0 is the one unseen word."""
        seen = self.scale * self.d[np.minimum(c, MOST + 1)] * c / max(1, self.tokens)
        return np.where(c > 0, seen, self.unseen)


_BLOCKS = "block long, docs binary, nulls binary, train binary, sizes binary, words binary, tokens binary"


def _blocks(docs: DataFrame) -> DataFrame:
    names = [x.split()[0] for x in _BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, hashes = TaskContext.get().partitionId(), 0, WordHashes()
        docs, train, parts, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            flat = np.concatenate(parts)
            words, tokens, n = np.unique(flat, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")  # frequent words get small numbers, which pack well
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            words, tokens = words[order], place[tokens]
            columns = [
                packed(np.array([x or 0 for x in docs], np.int64)),
                packed(np.array([x is None for x in docs], np.uint8)),
                packed(np.array(train, np.uint8)),
                packed(np.array([len(x) for x in parts], np.uint32)),
                packed(words),
                packed(planes(tokens)),
            ]
            return pa.RecordBatch.from_arrays([pa.array([task << 20 | number]), *(pa.array([c], pa.binary()) for c in columns)], names)

        for batch in batches:
            for doc, use, text in zip(batch.column("doc_id").to_pylist(), batch.column("train").to_pylist(), text_bytes(batch.column("text")), strict=True):
                words = text.lower().split()
                docs.append(doc)
                train.append(use)
                parts.append(np.append(hashes.of(words), np.uint64(END)))
                size += len(words) + 1
                if size >= BLOCK_TOKENS:
                    yield flush()
                    number, docs, train, parts, size = number + 1, [], [], [], 0
        if parts:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), training().alias("train"), F.col("text").cast("string").alias("text"))
    return materialize(map_arrow(rows, run, _BLOCKS), "blocks")


class _Block:
    """A row of the blocks' table, with its distinct bigrams."""

    def __init__(self, row: dict):
        self.id, self.words, self.tokens = row["block"], unpacked(row["words"], "<u8"), unplaned(unpacked(row["tokens"], "u1")).astype(np.int64)
        self.sizes, self.train = unpacked(row["sizes"], "<u4").astype(np.int64), unpacked(row["train"], "u1").astype(bool)
        self.docs = [None if n else d for d, n in zip(unpacked(row["docs"], "<i8").tolist(), unpacked(row["nulls"], "u1").tolist(), strict=True)]
        self.learned = np.repeat(self.train, self.sizes)

    def word_parts(self, parts: int) -> np.ndarray:
        return (mix(self.words) % np.uint64(parts)).astype(np.int64)

    def bigrams(self, parts: int, counts: np.ndarray, tokens: int) -> tuple[np.ndarray, ...]:
        """History and word of each distinct bigram (len(words) is the start), its part, each token's bigram, the histories' names, and which are spread.

        ``counts`` has the words' counts in the corpus. Spread are the start and the histories with more than
        tokens / (4 * parts), so fewer than 4 * parts + 1.
        """
        before = np.concatenate([[len(self.words)], self.tokens[:-1]])
        before[np.cumsum(self.sizes)[:-1]] = len(self.words)
        base = len(self.words) + 1
        pair, at = np.unique(before * base + self.tokens, return_inverse=True)
        h, w = pair // base, pair % base
        names = np.append(self.words, np.uint64(START))
        spread = np.append(counts * 4 * parts > tokens, True)
        key = np.where(spread[h], mix(names[h] + np.uint64(77)) ^ mix(self.words[w] + np.uint64(5)), names[h] + np.uint64(77))
        return h, w, (mix(key) % np.uint64(parts)).astype(np.int64), at, names, spread


def _ask_words(blocks: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row)
                counts = np.bincount(b.tokens[b.learned], minlength=len(b.words)).astype(np.uint32)
                part = b.word_parts(parts)
                for p in np.unique(part).tolist():
                    mine = part == p
                    yield pa.RecordBatch.from_pylist([{"p": p, "block": b.id, "words": packed(b.words[mine]), "counts": packed(counts[mine])}])

    return map_arrow(blocks, run, "p long, block long, words binary, counts binary")


_ANSWERS = "block long, p long, answer binary, sums array<long>, path string, spread binary"
_KIND = pa.schema([("block", pa.int64()), ("p", pa.int64()), ("answer", pa.binary()), ("sums", pa.list_(pa.int64())), ("path", pa.string()), ("spread", pa.binary())])


def _of_counts(c: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(c, MOST + 2), minlength=MOST + 3)[1 : MOST + 2].tolist()


def _save(folder: str, p: int, table: pa.Table) -> str:
    sink = io.BytesIO()
    pq.write_table(table, sink, compression="zstd")
    path = f"{folder}/part={p}/{uuid.uuid4().hex}.parquet"
    write_file(path, sink.getvalue())
    return path


def _answer_words(asked: DataFrame, folder: str) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        p = int(t.column("p")[0].as_py())
        words = [unpacked(x, "<u8") for x in t.column("words").to_pylist()]
        counts = np.concatenate([unpacked(x, "<u4") for x in t.column("counts").to_pylist()]).astype(np.int64)
        known, at = np.unique(np.concatenate(words), return_inverse=True)
        c = np.bincount(at, counts, len(known)).astype(np.int64)
        path = _save(folder, p, pa.table({"word": known[c > 0], "n": c[c > 0]}))
        rows, begin = [], 0
        for block, w in zip(t.column("block").to_pylist(), words, strict=True):
            rows.append({"block": block, "p": p, "answer": packed(c[at[begin : begin + len(w)]].astype(np.uint32)), "sums": None, "path": None, "spread": None})
            begin += len(w)
        rows.append({"block": -1, "p": p, "answer": None, "sums": [int(c.sum()), int((c > 0).sum()), *_of_counts(c)], "path": path, "spread": None})
        return pa.Table.from_pylist(rows, _KIND)

    return asked.groupBy("p").applyInArrow(run, _ANSWERS)


def _filed(answers: DataFrame, folder: str) -> DataFrame:
    """One file of answers for each block, and the rows of sums: block, path, sums."""
    spark = answers.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def flush() -> list[dict]:
            if at is None:
                return []
            sink = pa.BufferOutputStream()
            made = pa.Table.from_pylist(held, pa.schema([("p", pa.int64()), ("answer", pa.binary())]))
            with pa.ipc.new_stream(sink, made.schema) as w:
                w.write_table(made)
            path = f"{folder}/{at}-{uuid.uuid4().hex}.arrow"
            write_file(path, sink.getvalue().to_pybytes())
            return [{"block": at, "path": path, "sums": None, "spread": None}]

        kind = pa.schema([("block", pa.int64()), ("path", pa.string()), ("sums", pa.list_(pa.int64())), ("spread", pa.binary())])
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["block"] < 0:
                    rows.append({"block": r["block"], "path": r["path"], "sums": r["sums"], "spread": r["spread"]})
                    continue
                if r["block"] != at:
                    rows += flush()
                    at, held = r["block"], []
                held.append({"p": r["p"], "answer": r["answer"]})
            yield pa.RecordBatch.from_pylist(rows, kind)
        yield pa.RecordBatch.from_pylist(flush(), kind)

    salted = answers.withColumn("salt", F.when(F.col("block") < 0, F.col("p")))
    dealt = salted.repartition(shuffle_parts(spark), "block", "salt").sortWithinPartitions("block", "p")
    return materialize(map_arrow(dealt.select("block", "p", "answer", "sums", "path", "spread"), run, "block long, path string, sums array<long>, spread binary"), "answers")


def _sums(filed: DataFrame, n: int) -> list[int]:
    one = filed.filter("block < 0").agg(*(F.coalesce(F.sum(F.element_at("sums", k + 1)), F.lit(0)).alias(f"s{k}") for k in range(n))).collect()[0]
    return [int(x) for x in one]


def _spread(filed: DataFrame) -> dict[int, np.ndarray]:
    """For each spread history its tokens, mass and followers by count; parts times a bounded number of histories come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed_sums in batch.column("spread").to_pylist():
                x = unpacked(packed_sums, "<f8").reshape(MOST + 3, -1)
                yield pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), *(pa.array(v) for v in x[1:])], ["name", *sums])

    sums = [f"s{k}" for k in range(MOST + 2)]
    rows = map_arrow(filed.filter("spread IS NOT NULL").select("spread"), run, ", ".join(["name long", *(f"{c} double" for c in sums)]))
    # Rounded, as the order of adding doubles must not show.
    return {r[0] % (1 << 64): np.array(r[1:]) for r in rows.groupBy("name").agg(*(F.round(F.sum(c), 12).alias(c) for c in sums)).collect()}


def _read(path: str) -> dict[int, bytes]:
    table = pa.ipc.open_stream(pa.py_buffer(read_range(path))).read_all()
    return dict(zip(table.column("p").to_pylist(), table.column("answer").to_pylist(), strict=True))


def _word_counts(b: _Block, path: str, parts: int) -> np.ndarray:
    part, answers, c = b.word_parts(parts), _read(path), np.zeros(len(b.words), np.int64)
    for p, x in answers.items():
        c[part == p] = unpacked(x, "<u4")
    return c


def _ask_bigrams(blocks: DataFrame, words: Words, parts: int) -> DataFrame:
    """``blocks`` with the path of their words' answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row)
                c = _word_counts(b, row["words_path"], parts)
                h, w, part, at, names, spread = b.bigrams(parts, c, words.tokens)
                n = np.bincount(at[b.learned], minlength=len(h)).astype(np.uint32)
                order = np.argsort(part, kind="stable")
                ends = np.cumsum(np.bincount(part, minlength=parts))
                begin = 0
                for p, end in enumerate(ends.tolist()):
                    if end > begin:
                        k = order[begin:end]
                        heads = np.flatnonzero(np.concatenate([[True], h[k][1:] != h[k][:-1]]))
                        low = np.ascontiguousarray((b.words[w[k]] & _LOW48).astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]
                        yield pa.RecordBatch.from_pylist(
                            [
                                {
                                    "p": p,
                                    "block": b.id,
                                    "histories": packed(names[h[k][heads]]),
                                    "spread": packed(spread[h[k][heads]].view(np.uint8)),
                                    "followers": packed(np.diff(np.append(heads, len(k))).astype(np.uint32)),
                                    "words": np.ascontiguousarray(low).tobytes(),
                                    "counts": packed(planes(n[k])),
                                    "alone": packed(planes(np.where(n[k] > 0, c[w[k]], 0))),
                                }
                            ]
                        )
                    begin = end

    return map_arrow(blocks, run, "p long, block long, histories binary, spread binary, followers binary, words binary, counts binary, alone binary")


def _answer_bigrams(asked: DataFrame, words: Words, folder: str) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        p = int(t.column("p")[0].as_py())
        rows = t.to_pylist()
        sizes, hs, ws, ns, cs, heads, wide_heads = [], [], [], [], [], [], []
        for r in rows:
            h, f = unpacked(r["histories"], "<u8"), unpacked(r["followers"], "<u4").astype(np.int64)
            raw = np.frombuffer(r["words"], np.uint8).reshape(-1, 6)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, :6] = raw
            hs.append(np.repeat(h, f))
            heads.append(h)
            wide_heads.append(h[unpacked(r["spread"], "u1").astype(bool)])
            ws.append(wide.view("<u8").ravel())
            ns.append(unplaned(unpacked(r["counts"], "u1")))
            cs.append(unplaned(unpacked(r["alone"], "u1")))
            sizes.append(len(raw))
        known, hi = np.unique(np.concatenate(hs), return_inverse=True)
        word, n, alone = np.concatenate(ws), np.concatenate(ns).astype(np.int64), np.concatenate(cs).astype(np.int64)
        order = np.lexsort((word, hi))
        first = np.concatenate([[True], (hi[order][1:] != hi[order][:-1]) | (word[order][1:] != word[order][:-1])])
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(first) - 1
        count = np.bincount(entry, n, int(first.sum())).astype(np.int64)
        eh, ew, ec = hi[order][first], word[order][first], np.maximum.reduceat(alone[order], np.flatnonzero(first))
        seen = count > 0
        total = np.bincount(eh[seen], count[seen], len(known)).astype(np.int64)
        mass = np.bincount(eh[seen], words.p(ec[seen]), len(known))
        by_count = np.stack([np.bincount(eh[count == r], minlength=len(known)) for r in range(1, MOST + 1)])
        path = _save(folder, p, pa.table({"history": known[eh[seen]], "word48": ew[seen], "n": count[seen], "history_n": total[eh[seen]], "history_mass": mass[eh[seen]]}))
        out, begin = [], 0
        for r, size, h in zip(rows, sizes, heads, strict=True):
            k = np.searchsorted(known, h)
            mine = count[entry[begin : begin + size]]
            # Only a history that a word not seen after it follows here needs the seen words' mass.
            heads_at = np.concatenate([[0], np.flatnonzero(np.diff(hi[begin : begin + size])) + 1])
            short = np.minimum.reduceat(mine, heads_at) == 0
            made = [packed(planes(mine)), packed(total[k].astype(np.uint64).view(np.uint8).reshape(-1, 8).T), packed(np.where(short, mass[k], 0.0)), packed(planes(by_count[:, k].ravel()))]
            out.append({"block": r["block"], "p": p, "answer": b"".join(len(x).to_bytes(8, "little") + x for x in made), "sums": None, "path": None, "spread": None})
            begin += size
        at = np.searchsorted(known, np.unique(np.concatenate(wide_heads)))
        spread = np.concatenate([known[at].view(np.float64), total[at], mass[at], by_count[:, at].ravel()])  # a name's bits, then its sums
        out.append({"block": -1, "p": p, "answer": None, "sums": _of_counts(count), "path": path, "spread": packed(spread)})
        return pa.Table.from_pylist(out, _KIND)

    return asked.groupBy("p").applyInArrow(run, _ANSWERS)


def _unframed(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def backoff(total: np.ndarray, by_count: np.ndarray, mass: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For histories: what scales their discounted bigrams, and the backoff weight.

    by_count has, for r up to MOST, how many followers were seen r times. The mass left is what the
    discounts take; a history that they take nothing from leaves 1 / (total + 1) instead. The weight
    shares it among the words not seen after the history, so the probabilities sum to exactly 1.
    """
    taken = sum(by_count[r - 1] * r * (1 - d[r]) for r in range(1, MOST + 1)) / np.maximum(total, 1)
    left = np.where(total > 0, np.maximum(taken, 1 / (total + 1)), 1.0)
    scale = np.where(taken < 1, (1 - left) / np.maximum(1 - taken, 1e-300), 0.0)
    return scale, left / np.maximum(1 - mass, 1e-300)


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(blocks: DataFrame, words: Words, d2: np.ndarray, parts: int, spread_sums: dict[int, np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row)
                c = _word_counts(b, row["words_path"], parts)
                h, w, part, at, names, spread = b.bigrams(parts, c, words.tokens)
                order = np.argsort(part, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])
                p = np.zeros(len(h))
                for q, data in _read(row["bigrams_path"]).items():
                    k = order[ends[q] : ends[q + 1]]
                    n, total, mass, by_count = (unpacked(x, t) for x, t in zip(_unframed(data), ("u1", "u1", "<f8", "u1"), strict=True))
                    n, total = unplaned(n), np.ascontiguousarray(total.reshape(8, -1).T).view("<u8").ravel().astype(np.float64)
                    by_count, mass = unplaned(by_count).reshape(MOST, -1).astype(np.float64), mass.copy()
                    new = np.concatenate([[True], h[k][1:] != h[k][:-1]])
                    of, heads = np.cumsum(new) - 1, h[k][new]
                    for i in np.flatnonzero(spread[heads]).tolist():
                        total[i], mass[i], *by_count[:, i] = spread_sums[int(names[heads[i]])]
                    scale, weight = backoff(total, by_count, mass, d2)
                    n = n.astype(np.int64)
                    direct = scale[of] * d2[np.minimum(n, MOST + 1)] * n / np.maximum(total[of], 1)
                    p[k] = np.where(n > 0, direct, weight[of] * words.p(c[w[k]]))
                tokens = np.log10(p)[at]
                base = np.log10((c + 0.5) / (words.tokens + 0.5 * (words.distinct + 1)))[b.tokens]
                starts = np.cumsum(b.sizes) - b.sizes
                columns = [
                    pa.array(b.docs, pa.int64()),
                    pa.array(~b.train),
                    pa.array(b.sizes),
                    pa.array(np.add.reduceat((c > 0)[b.tokens].astype(np.int64), starts)),
                    pa.array(np.full(len(starts), words.tokens, np.int64)),
                    pa.array(np.add.reduceat(base, starts)),
                    pa.array(np.add.reduceat(tokens, starts)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _SCORES.split(", ")])

    return map_arrow(blocks, run, _SCORES)


@dataclass
class Model:
    """What a corpus gave: the word level, bigram discounts, the folders of both tables and their files that count."""

    words: Words
    bigram_discounts: np.ndarray
    word_folder: str
    bigram_folder: str
    files: DataFrame


def score_corpus(docs: DataFrame, parts: int | None = None) -> tuple[DataFrame, Model]:
    """Learns from the training rows of ``docs`` and scores every row; the scores and the model.

    A row per document: doc_id, held_out, n_tokens (words between ASCII white space, A-Z lower-cased,
    and an end), n_known, train_tokens, base_score, score (log10 of the model's probability). Null and
    empty texts are an end only. A null doc_id is a training row. Repeated rows count each time; other
    columns are ignored; an empty table gives no row. With no training row the word level knows only
    the unseen word.
    """
    spark = docs.sparkSession
    word_folder, bigram_folder, answers = (new_path(spark, x) for x in ("katz-words", "katz-bigrams", "katz-answers"))
    blocks = _blocks(docs)
    parts = parts or max(2 * shuffle_parts(spark), blocks.count() * BLOCK_TOKENS // PART_TOKENS)
    word_answers = _filed(_answer_words(_ask_words(blocks, parts), word_folder), f"{answers}/words")
    tokens, distinct, *of_counts = _sums(word_answers, MOST + 3)
    reclaim(spark)
    words = Words(tokens, distinct, np.array(of_counts))
    path = lambda filed, name: filed.filter("block >= 0").select("block", F.col("path").alias(name))
    blocks_words = blocks.join(_paths(path(word_answers, "words_path")), "block")
    bigram_answers = _filed(_answer_bigrams(_ask_bigrams(blocks_words, words, parts), words, bigram_folder), f"{answers}/bigrams")
    d2 = discounts(np.array(_sums(bigram_answers, MOST + 1)))
    spread = _spread(bigram_answers)
    both = blocks_words.join(_paths(path(bigram_answers, "bigrams_path")), "block")
    files = word_answers.union(bigram_answers).filter("block < 0").select("path")
    return _scores(both, words, d2, parts, spread), Model(words, d2, word_folder, bigram_folder, files)


def _paths(of_blocks: DataFrame, rows: int = 200_000) -> DataFrame:
    """Paths by block, broadcast if a count proves them few; else the blocks are shuffled to them."""
    return F.broadcast(of_blocks) if of_blocks.limit(rows + 1).count() <= rows else of_blocks

