"""Exact Jaccard join of word shingles by parity sketches.

Each shingle of a document flips one bit of a very wide bit sketch, so the Hamming distance of two
sketches never exceeds the symmetric difference of their shingle sets. Documents are joined per size
band: for sizes up to r, sets with Jaccard similarity of at least 0.8 differ in at most k = 2r/9
shingles, so of k + 1 segments of the sketch at least one is equal (pigeonhole). A segment is kept
as the XOR of its bits' hashes, which names its set of flipped bits. There are some segments more,
so that as long as a document has no more empty segments than these, a pair also has an equal one
that isn't empty, and empty segments need no entry; a document with more of them enters them, too.

Segments of a block of documents are sent as packed arrays. Documents with equal sets are one class
and enter once per block. Where few documents share a segment, all their pairs are candidates; where
many do, each pairs with the first of them, and after the links found are merged, what is still
apart in such a group is compared in blocks by a 1024-bit sketch, and what that allows by one with
two bits a shingle. No group's pairs are written out,
and no link between components is lost. Candidates that sizes and sketches allow are verified on the
shingles of their texts, the pairs that join most first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import RID, WordHashes, join_groups, map_arrow, marked, materialize, mix, numbered, release, shuffle_parts, text_bytes, without_rows, write_marks
from quern.llm.components import components

#: Words in a shingle, the least similarity in percent, and bits of the smallest and the largest sketch compared whole.
WORDS, PERCENT, BITS, MOST_BITS = 5, 80, 1024, 1 << 16
#: Up to so many documents that share a segment are paired with each other; entries packed at once.
FEW, BLOCK_ENTRIES, BLOCK_COMPARED = 8, 2_000_000, 2048
#: Entries that a worker looks for equal segments in at once.
PART_ENTRIES = 2_000_000


def shingles(text: bytes, hashes: WordHashes) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles; none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.of(words)
    n = min(WORDS, len(h))
    out = np.full(len(h) - n + 1, np.uint64(n))
    for k in range(n):
        out = mix(out) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)]
    return np.unique(mix(out))


def level_of(n: int) -> tuple[int, int, int]:
    """The size band of n: its number, and its first and last size."""
    number, low = 0, 1
    while True:
        high = low * 100 // PERCENT
        if n <= high:
            return number, low, high
        number, low = number + 1, high + 1


def segments(high: int) -> tuple[int, int]:
    """Segments of the band with sizes up to ``high``, and how many may be empty without an entry."""
    k = 2 * high * (100 - PERCENT) // (100 + PERCENT)
    spare = (k + 9) // 10 + 1 if k else 0
    return k + 1 + spare, spare


def segment_keys(h: np.ndarray, number: int, high: int) -> np.ndarray:
    """Names of a set's segments in a band, with band and place in them."""
    parts, spare = segments(high)
    at = (mix(h + np.uint64(0xA5A5A5A5)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    place = at[order]
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    value = np.bitwise_xor.reduceat(h[order], starts)
    used = place[starts]
    if parts - len(used) > spare:
        full = np.zeros(parts, np.uint64)
        full[used] = value
        value, used = full, np.arange(parts)
    return mix(value + mix(np.uint64(number + 1) << np.uint64(32) | used.astype(np.uint64)))


def sketch(h: np.ndarray) -> bytes:
    """The parities of BITS to MOST_BITS bits, twice as many as shingles or more if that allows it."""
    bits = min(MOST_BITS, max(BITS, 1 << (2 * len(h) - 1).bit_length()))
    flips = np.bincount((mix(h ^ np.uint64(0x5BD1E995)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def folded(rows: np.ndarray, size: int) -> np.ndarray:
    """Sketches (rows of bytes) as sketches of ``size`` bytes: the parities of bits that fall together."""
    return np.bitwise_xor.reduce(rows.reshape(len(rows), -1, size), axis=1)


def distances(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Hamming distances of pairs of sketches, at the size of the smaller one."""
    out = np.zeros(len(a), np.int64)
    sizes = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    for m, n in np.unique(sizes, axis=0).tolist():
        at = np.flatnonzero((sizes[:, 0] == m) & (sizes[:, 1] == n))
        x, y = (np.frombuffer(b"".join([s[i] for i in at]), np.uint8).reshape(len(at), -1) for s in (a, b))
        out[at] = np.bitwise_count(folded(x, min(m, n)) ^ folded(y, min(m, n))).sum(axis=1, dtype=np.int64)
    return out


_SKETCHES = f"p int, node long, {RID} long, doc_id long, n long, set_id binary, sketch binary, small binary, emits boolean, keys binary, refs binary"


def _sketches(docs: DataFrame, parts: int) -> DataFrame:
    """Rows of documents (p is null) and packed segment entries (p is the part they go to)."""
    names = [x.split()[0] for x in _SKETCHES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, block, hashes = TaskContext.get().partitionId(), 0, WordHashes()
        levels: dict[int, tuple] = {}

        def bands(n: int) -> list[tuple[int, int]]:
            if n not in levels:
                number, _, high = level_of(n)
                levels[n] = [(number, high), (number + 1, (high + 1) * 100 // PERCENT)]
            return levels[n]

        keys, owners, size, met, count = [], [], 0, set(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not keys:
                return
            key, owner = np.concatenate(keys), np.repeat(np.array([o for o, _ in owners], np.uint64), [n for _, n in owners])
            part = (key >> np.uint64(32)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            ends = np.cumsum(np.bincount(part.astype(np.int64), minlength=parts))
            low = key.astype(np.uint32)[order]
            idx = (owner & np.uint64((1 << 20) - 1)).astype(np.uint32)[order]
            base = int(owners[0][0]) >> 20 << 20
            begin = 0
            for p, end in enumerate(ends.tolist()):
                if end > begin:
                    row = [p, base, None, None, None, None, None, None, None, low[begin:end].tobytes(), idx[begin:end].tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)
                begin = end

        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.bool_(), pa.binary(), pa.binary()]
        for batch in batches:
            for i in range(0, len(batch), 1000):
                part = batch.slice(i, 1000)
                rows = []
                for rid, doc, text in zip(part.column(RID).to_pylist(), part.column("doc_id").to_pylist(), text_bytes(part.column("text")), strict=True):
                    h = shingles(text, hashes)
                    if not len(h):
                        rows.append((None, 0, rid, doc, 0, None, None, None, False, None, None))
                        continue
                    if size >= BLOCK_ENTRIES or count >= 1 << 20:
                        yield from flush()
                        block, keys, owners, size, met, count = block + 1, [], [], 0, set(), 0
                    node = task << 36 | block << 20 | count
                    count += 1
                    set_id = hashlib.blake2b(h.tobytes(), digest_size=16).digest()
                    emits = set_id not in met
                    if emits:
                        met.add(set_id)
                        made = np.concatenate([segment_keys(h, number, high) for number, high in bands(len(h))])
                        keys.append(made)
                        owners.append((node, len(made)))
                        size += len(made)
                    whole = sketch(h) if emits else None
                    small = folded(np.frombuffer(whole, np.uint8)[None], BITS // 8).tobytes() if emits else None
                    rows.append((None, node, rid, doc, len(h), set_id, whole, small, emits, None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        yield from flush()

    return materialize(map_arrow(docs, run, _SKETCHES), "sketches")


def _dealt(entries: DataFrame, cuts: int) -> DataFrame:
    """Packed entries by part and cut of a part, as a segment's key has it."""
    if cuts == 1:
        return entries.withColumn("cut", F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, refs = np.frombuffer(row["keys"], np.uint32), np.frombuffer(row["refs"], np.uint32)
                cut = mix(keys.astype(np.uint64)) % np.uint64(cuts)
                rows = [row | {"cut": c, "keys": keys[cut == c].tobytes(), "refs": refs[cut == c].tobytes()} for c in np.unique(cut).tolist()]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("p", pa.int32()), ("node", pa.int64()), ("keys", pa.binary()), ("refs", pa.binary()), ("cut", pa.int32())]))

    return map_arrow(entries, run, "p int, node long, keys binary, refs binary, cut int")


def _shared(entries: DataFrame, parts: int) -> DataFrame:
    """Candidates (a, b) of equal segments, and the members (grp, a) of segments that more than FEW share.

    A worker has one cut of a part at once, about PART_ENTRIES entries, so its memory doesn't grow with the corpus.
    """
    total = entries.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    entries = _dealt(entries, -(-total // (4 * parts * PART_ENTRIES)) or 1)

    def run(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("keys")]
        refs = [np.frombuffer(x.as_py(), np.uint32).astype(np.int64) + base for x, base in zip(table.column("refs"), table.column("node").to_pylist(), strict=True)]
        key, ref = np.concatenate(keys), np.concatenate(refs)
        order = np.lexsort((ref, key))
        key, ref = key[order], ref[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        pairs = []
        for g in range(2, FEW + 1):
            rows = ref[starts[sizes == g][:, None] + np.arange(g)]
            for i in range(g - 1):
                for j in range(i + 1, g):
                    pairs.append(np.stack([rows[:, i], rows[:, j]], 1))
        many = np.flatnonzero(sizes > FEW)
        member = np.repeat(starts[many], sizes[many])
        inside = member + np.arange(len(member)) - np.repeat(np.cumsum(sizes[many]) - sizes[many], sizes[many]) if len(many) else member
        pairs.append(np.stack([ref[member], ref[inside]], 1)[member != inside])
        # Pairs found before any of the many segments that two copies share need no second row.
        pair = np.unique(np.concatenate(pairs), axis=0)
        p = int(table.column("p")[0].as_py())
        grp = (np.int64(p) << 32) + key[member].astype(np.int64)
        n = len(pair)
        return pa.table(
            {
                "grp": pa.array(np.concatenate([np.zeros(n, np.int64), grp]), mask=np.arange(n + len(grp)) < n),
                "a": np.concatenate([pair[:, 0], ref[inside]]),
                "b": pa.array(np.concatenate([pair[:, 1], np.zeros(len(grp), np.int64)]), mask=np.arange(n + len(grp)) >= n),
            }
        )

    return materialize(entries.groupBy("p", "cut").applyInArrow(run, "grp long, a long, b long"), "shared")


def _alike(na: np.ndarray, nb: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Whether sizes and a sketch distance allow a link."""
    low, high = np.minimum(na, nb), np.maximum(na, nb)
    return (100 * low >= PERCENT * high) & ((100 + PERCENT) * apart <= (100 - PERCENT) * (na + nb))


def _numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def _allowed(pairs: DataFrame, nodes: DataFrame, by: str, sketches: str) -> DataFrame:
    """Pairs (a, b) of nodes or classes (``by``) as pairs of classes, a < b, that sizes and sketches allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = _alike(t.column("na").to_numpy(), t.column("nb").to_numpy(), distances(t.column("sa").to_pylist(), t.column("sb").to_pylist()))
            a, b = t.column("ca").to_numpy()[keep], t.column("cb").to_numpy()[keep]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    known = nodes.withColumn("key", F.col(by)).dropDuplicates(["key"])
    side = lambda x: known.select(F.col("key").alias(x), F.col("class").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col(sketches).alias(f"s{x}"))
    wide = pairs.join(side("a"), "a").join(side("b"), "b").filter("ca <> cb").select("ca", "cb", "na", "nb", "sa", "sb")
    return map_arrow(wide, run, "a long, b long").distinct()


def _verify(pairs: DataFrame, docs: DataFrame, every: DataFrame, members: int = 200) -> DataFrame:
    """The pairs (a, b) of row numbers whose texts' shingle sets are similar enough. ``every`` has all row numbers.

    The text of b goes to a; only texts in pairs are moved. An a with many partners is copied, so that
    each copy meets about ``members``.
    """
    salted = pairs.join(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / members).alias("copies")), "a")
    salted = salted.select("a", "b", F.pmod(F.xxhash64("b"), "copies").alias("salt"))
    sent = salted.select(F.col("b").alias(RID), "a", "salt", F.lit(1).alias("role"))
    folder = write_marks(sent.union(salted.select(F.col("a").alias(RID), "a", "salt", F.lit(0).alias("role")).distinct()), every)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, marks, at in marked(batches, folder):
            for i in range(0, len(at), 500):  # a text may go to many
                k = slice(i, i + 500)
                part = marks.slice(i, 500).combine_chunks()
                columns = [part.column(c).combine_chunks() if part.num_rows else pa.array([], part.schema.field(c).type) for c in ("a", "salt", "role", RID)]
                yield pa.RecordBatch.from_arrays([*columns, batch.column("text").take(pa.array(at[k]))], ["a", "salt", "role", "b", "text"])

    rows = map_arrow(docs.select(RID, "text"), send, "a long, salt long, role int, b long, text string")
    rows = rows.repartition(shuffle_parts(docs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", "role", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, at, mine = WordHashes(), None, np.zeros(0, np.uint64)
        for t in batches:
            found = []
            for a, salt, role, b, text in zip(*(t.column(c).to_pylist() for c in ("a", "salt", "role", "b")), text_bytes(t.column("text")), strict=True):
                h = shingles(text, hashes)
                if role == 0:
                    if at != (a, salt):
                        at, mine = (a, salt), h
                    continue
                both = len(np.intersect1d(mine, h, assume_unique=True))
                if 100 * both >= PERCENT * (len(mine) + len(h) - both):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return map_arrow(rows, run, "a long, b long").distinct()


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    side = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"_{x}"))
    wide = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return wide.filter(~F.coalesce("_a", "a").eqNullSafe(F.coalesce("_b", "b"))).select("a", "b")


def _still_apart(groups: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs in different components that share one of the large segments and that sizes and sketches allow."""
    known = nodes.select(F.col("node").alias("a"), "class", "n", "small").join(labels.withColumnRenamed("node", "class"), "class", "left")
    rows = groups.join(known.select("a", "class", "n", "small", F.coalesce("component", "class").alias("component")), "a")
    split = rows.groupBy("grp").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo <> hi")
    rows = rows.join(split.select("grp", F.ceil(F.col("size") / BLOCK_COMPARED).cast("int").alias("blocks")), "grp").dropDuplicates(["grp", "class"])
    mine = F.pmod(F.xxhash64("class"), "blocks").cast("int")
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("x", F.least("mine", "other")).withColumn("y", F.greatest("mine", "other"))

    def run(t: pa.Table) -> pa.Table:
        mine, x, y = (t.column(c).to_numpy() for c in ("mine", "x", "y"))
        node, n, comp, bits = t.column("class").to_numpy(), t.column("n").to_numpy(), t.column("component").to_numpy(), _numbers(t.column("small"))
        left, right = np.flatnonzero(mine == x), np.flatnonzero(mine == y)
        found = []
        for i in left.tolist():
            j = right[(comp[right] != comp[i]) & ((x[0] != y[0]) | (node[right] > node[i]))]
            j = j[_alike(np.full(len(j), n[i]), n[j], np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64))]
            found.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], 1))
        pair = np.concatenate([np.zeros((0, 2), np.int64), *found])
        return pa.table({"a": pair[:, 0], "b": pair[:, 1]})

    cells = rows.select("grp", "x", "y", "mine", "class", "n", "component", "small")
    return cells.groupBy("grp", "x", "y").applyInArrow(run, "a long, b long").distinct()


def _linked(rows: DataFrame, parts: int | None) -> tuple[DataFrame, DataFrame]:
    """For numbered rows: (RID, doc_id, n, set_id, linked), linked the number of a row of its component, null without shingles; and their components."""
    spark = rows.sparkSession
    texts = rows.select(RID, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = parts or 2 * shuffle_parts(spark)
    table = _sketches(texts, parts)
    of_rows = table.filter("p IS NULL")
    sets = of_rows.filter("set_id IS NOT NULL")
    classes = materialize(sets.groupBy("set_id").agg(F.min(RID).alias("class"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("members")), "classes")
    nodes = materialize(sets.filter("emits").join(classes, "set_id").select("node", "class", "n", "sketch", "small"), "nodes")
    shared = _shared(table.filter("p IS NOT NULL").select("p", "node", "keys", "refs"), parts)
    near = _allowed(shared.filter("grp IS NULL").select("a", "b").distinct(), nodes, "node", "small")
    left = materialize(_allowed(near, nodes, "class", "sketch"), "candidates")
    links = labels = None
    held = [left]
    for turn in ("nearest", "rest", "apart"):
        if turn == "nearest":  # a spanning part first: each joins the smallest it may be linked with
            todo = left.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        elif turn == "rest":
            todo = _across(left.join(todo, ["a", "b"], "left_anti"), labels)
        else:
            near = _still_apart(shared.filter("grp IS NOT NULL").select("grp", "a"), nodes, labels).join(left, ["a", "b"], "left_anti")
            todo = _allowed(near, nodes, "class", "sketch")
        todo = materialize(todo, "todo")
        held.append(todo)
        if turn != "nearest" and not todo.limit(1).count():
            continue
        found = materialize(_verify(todo, texts, of_rows), "links")
        held.append(found)
        links = found if links is None else links.union(found)
        labels = components(links)
        held.append(labels)
    of_set = classes.join(labels.withColumnRenamed("node", "class"), "class", "left").select("set_id", "least", "members", F.coalesce("component", "class").alias("linked"))
    of_set = materialize(of_set, "sets")
    release(shared, nodes, classes, *held)
    wide = join_groups(of_rows.select(RID, "doc_id", "n", "set_id").filter("set_id IS NOT NULL"), of_set.select("set_id", "linked", "members"), "set_id", "members")
    none = of_rows.filter("set_id IS NULL").select(RID, "doc_id", "n", "set_id", F.lit(None).cast("long").alias("linked"))
    of_component = of_set.groupBy("linked").agg(F.min("least").alias("least"), F.sum("members").cast("long").alias("members"))
    return wide.select(RID, "doc_id", "n", "set_id", "linked").unionByName(none), materialize(of_component, "components")


def similar_components(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row.

    Links join rows whose sets of distinct 5-word shingles (ASCII letters lower-cased, words between
    ASCII white space) have a Jaccard similarity of at least 0.8. With fewer words the whole sequence
    is the one shingle; null or empty texts have none, are linked with nothing and are their own
    component. Rows are told apart by their number: a null doc_id links like any other, and its
    component_id is null only if no doc_id is reachable; rows that repeat a doc_id each get a row, with
    the same text or another. Other columns are ignored; an empty table gives none.

    ``parts`` is the number of parts that segment entries are dealt to, a few times the shuffle
    partitions unless given; parts of more than some million entries are cut.
    """
    rows, found = _linked(numbered(docs.select("doc_id", "text")), parts)
    linked = join_groups(rows.filter("linked IS NOT NULL"), found, "linked", "members").select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
    return linked.unionByName(rows.filter("linked IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def drop_similar(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component left, that with the smallest doc_id, null last, then the first; all columns stay.

    Rows without shingles all stay. Rows go by their numbers, so null and repeated doc_ids do no harm.
    """
    rows = numbered(docs)
    linked = materialize(_linked(rows, None)[0].select(RID, "doc_id", "linked"), "linked")
    kept = linked.filter("linked IS NOT NULL").groupBy("linked").agg(F.max(F.struct((-F.col("doc_id")).alias("neg_id"), (-F.col(RID)).alias("neg_rid"))).alias("best"))
    kept = kept.select((-F.col("best.neg_rid")).alias(RID))
    return without_rows(rows, linked.filter("linked IS NOT NULL").join(kept, RID, "left_anti"), linked)
