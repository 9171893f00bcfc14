"""WARC archives, written and read back by splits with boundary-chain verification.

A split of a file can start anywhere, and a payload may hold what looks like a record. So the tasks
first look for every place in their split that could start a record and work out where the record
after it would start. Places of one split are followed to the place where their chain leaves the
split; from the start of the file, pointer jumping over these leaps then finds the one place in each
split that is reached. Only records on the chain from there are read, and a chain must end exactly
at the end of its file.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import RID, join_groups, map_arrow, marked, materialize, new_path, numbered, read_range, release, shuffle_parts, write_file, write_marks

MAGIC = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes read at first for a header; a longer one is read on until it ends, as the WARC standard sets no limit.
MAX_HEADER = 1 << 16
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record. ``refers_to`` makes it a revisit, which has the HTTP header and no payload."""
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    if url is not None:  # last, as it may be of any length
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    return MAGIC + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_header(data: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """Fields of the header at ``at`` and where its block starts; None if no whole header is there."""
    if not data.startswith(MAGIC, at):
        return None
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    fields = {}
    for line in data[at + len(MAGIC) : end].split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[key.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = fields.get("content-length", "")
    # More digits than a 64-bit number has are no length of a block, so this is no header.
    return (fields, end + 4) if length.isascii() and length.isdigit() and len(length) <= 18 else None


def read_on(path: str, data: bytes, start: int, at: int, size: int) -> bytes:
    """``data``, the bytes of a file from ``start``, with as many more as the header at ``at`` needs to end, or the file."""
    looked = at
    while data.find(b"\r\n\r\n", looked) < 0 and start + len(data) < size:
        looked = max(at, len(data) - 3)
        more = read_range(path, start + len(data), max(len(data) - at, MAX_HEADER))
        if not more:
            break
        data += more
    return data


def write_archives(pages: DataFrame, folder: str, min_revisit: int = 0, file_bytes: int = 16 << 20) -> DataFrame:
    """Writes a record per row of ``pages`` and returns the files: path, size.

    Of rows whose html is equal and at least ``min_revisit`` bytes long, the one with the largest
    page_id is a response and the others revisit it; a null html is empty, and rows without a page_id
    are all responses if no row of their payload has one. Payloads are compared by their SHA-256 and row
    numbers, so the html is read twice and never shuffled.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = numbered(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")))
    payloads = materialize(rows.select(RID, "page_id", F.sha2(F.col("html").cast("binary"), 256).alias("key"), F.octet_length("html").alias("size")), "payloads")
    groups = payloads.filter(F.col("size") >= min_revisit).groupBy("key").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = join_groups(payloads, materialize(groups, "repeated"), "key", "n").filter("first IS NOT NULL AND (page_id IS NULL OR page_id <> first)")
    marks = write_marks(again.select(RID, F.col("first").alias("refers_to")), payloads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            path = f"{folder}/{uuid.uuid4().hex}.warc"
            write_file(path, b"".join(held))
            return pa.RecordBatch.from_pylist([{"path": path, "size": size}])

        for batch, found, at in marked(batches, marks):
            refers = dict(zip(at.tolist(), found.column("refers_to").to_pylist(), strict=True))
            for k, (page, url, body) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True)):
                data = record(page, url, body.encode(), refers.get(k))
                held.append(data)
                size += len(data)
                if size >= file_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return materialize(map_arrow(rows, run, "path string, size long"), "archives")


def _leaps(files: DataFrame, split_bytes: int) -> DataFrame:
    """(path, at, leap): every place that may start a record, and where the chain from it leaves the split."""
    splits = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("begin"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for split in batch.to_pylist():
                begin, end = split["begin"], min(split["begin"] + split_bytes, split["size"])
                # A record starts the file or follows the blank line after another, so no header holds a second place.
                start = max(begin - 4, 0)
                data = read_range(split["path"], start, end - start + MAX_HEADER)
                after: dict[int, int] = {}
                at = data.find(MAGIC, begin - start)
                while 0 <= at < end - start:
                    if start + at == 0 or data[max(at - 4, 0) : at] == b"\r\n\r\n":
                        data = read_on(split["path"], data, start, at, split["size"])
                        if found := parse_header(data, at):
                            after[start + at] = start + found[1] + int(found[0]["content-length"]) + 4
                    at = data.find(MAGIC, at + 1)
                leap: dict[int, int] = {}
                for place in sorted(after, reverse=True):  # a successor is always further on
                    to = after[place]
                    if to >= end:
                        leap[place] = to
                    elif to in leap:
                        leap[place] = leap[to]
                rows = [{"path": split["path"], "at": a, "leap": b} for a, b in leap.items() if b <= split["size"]]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("at", pa.int64()), ("leap", pa.int64())]))

    return map_arrow(splits.repartition(shuffle_parts(files.sparkSession), "path", "begin"), run, "path string, at long, leap long")


def reachable(files: DataFrame, split_bytes: int) -> DataFrame:
    """(path, at): for each split the chain from the file's start enters, the record it enters at.

    Each round doubles the number of leaps a pointer stands for, so there are as many rounds as the
    logarithm of a file's splits. Raises ValueError where a chain doesn't end at its file's end.
    """
    leaps = materialize(_leaps(files, split_bytes), "leaps")
    targets = leaps.select("path", F.col("leap").alias("at")).union(files.select("path", F.lit(0).cast("long").alias("at"))).distinct()
    jump = materialize(leaps.join(targets, ["path", "at"], "left_semi"), "jumps")
    reached = materialize(files.filter("size > 0").select("path", F.lit(0).cast("long").alias("at")), "reached")
    while True:
        more = reached.join(jump, ["path", "at"]).select("path", F.col("leap").alias("at"))
        grown = materialize(reached.union(more).distinct(), "reached")
        further = jump.join(jump.select("path", F.col("at").alias("leap"), F.col("leap").alias("beyond")), ["path", "leap"], "left")
        done = grown.count() == reached.count()
        release(reached)
        reached = grown
        if done:
            break
        longer = materialize(further.select("path", "at", F.coalesce("beyond", "leap").alias("leap")), "jumps")
        release(jump)
        jump = longer
    ends = reached.join(files, "path").filter("at = size").select("path").distinct()
    if lost := files.filter("size > 0").join(ends, "path", "left_anti").limit(1).collect():
        raise ValueError(f"the records of {lost[0].path} don't end with the file")
    release(jump, leaps)
    return reached


def read_archives(files: DataFrame, split_bytes: int = 4 << 20) -> DataFrame:
    """The records of the files: page_id, record_type, target_uri, payload_bytes, payload_digest, refers_to, payload.

    payload is null for revisits; its digest is verified for responses. An empty table of files gives no row.
    """
    entries = reachable(files, split_bytes).join(files, "path").filter("at < size")

    def number(name: str) -> int | None:
        inner = name.removeprefix("<urn:page:").removesuffix(">")
        return None if inner in ("", "null") else int(inner)

    kinds = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entry in batch.to_pylist():
                path, at = entry["path"], entry["at"]
                end = min((at // split_bytes + 1) * split_bytes, entry["size"])
                start, data = at, read_range(path, at, end - at + MAX_HEADER)
                rows = []
                while at < end:
                    data = read_on(path, data, start, at - start, entry["size"])
                    fields, block = parse_header(data, at - start)
                    length = int(fields["content-length"])
                    body = data[block : block + length]
                    if len(body) < length:
                        body += read_range(path, start + block + len(body), length - len(body))
                    http, _, payload = body.partition(b"\r\n\r\n")
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    revisit = fields["warc-type"] == "revisit"
                    if not revisit and payload_digest(payload) != digest:
                        raise ValueError(f"{path} at {at}: the payload isn't what was written")
                    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    refers = number(fields["warc-refers-to"]) if revisit else None
                    rows.append((number(fields["warc-record-id"]), fields["warc-type"], fields.get("warc-target-uri"), size, digest, refers, None if revisit else payload))
                    at = start + block + length + 4
                    if at < end and at - start + MAX_HEADER > len(data) and start + len(data) < entry["size"]:
                        start, data = at, read_range(path, at, max(end - at, 0) + MAX_HEADER)
                for i in range(0, len(rows), 500):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 500], strict=True), kinds, strict=True)], schema=kinds)

    wide = entries.select("path", "at", "size").repartition(shuffle_parts(files.sparkSession), "path", "at")
    return map_arrow(wide, run, "page_id long, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to archives and reads them back.

    A null html is an empty payload, a null url no target, a null page_id null again. Rows that repeat
    a page_id that is the largest of its payload are all responses. Other columns are ignored.
    """
    return read_archives(write_archives(pages, new_path(pages.sparkSession, "warc")))
