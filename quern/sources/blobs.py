"""Files kept beside the points: written, deleted as far as that goes, and lent by signed addresses."""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Minutes that a signed address holds.
MINUTES = 15


def blob_path(company: Column, folder: str, filename: Column) -> Column:
    return F.concat_ws("/", F.lit("uploads"), company, F.lit(folder), filename)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        raise ValueError(f"{path} has no scheme, so executors may not mean the same folder by it")
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def upload(files: DataFrame, root: str) -> DataFrame:
    """Writes (path, content) below ``root``, a URI; (path, size, error), where a file that can't be written is an error row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    target = posixpath.join(base, path)
                    store.create_dir(os.path.dirname(target), recursive=True)
                    with store.open_output_stream(target) as out:
                        out.write(content)
                    rows.append((path, len(content), None))
                except Exception as e:  # one file must not stop the others
                    rows.append((path, None, type(e).__name__))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["path", "size", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, size long, error string")


def remove(paths: DataFrame, root: str) -> DataFrame:
    """Deletes (path) below ``root``; (path, deleted), false for files that aren't there or can't be deleted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)
        for batch in batches:
            done = []
            for path in batch.column("path").to_pylist():
                try:
                    store.delete_file(posixpath.join(base, path))
                    done.append(True)
                except Exception:  # cleaning up is not worth a failure
                    done.append(False)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(done)], ["path", "deleted"])

    return paths.select("path").mapInArrow(run, "path string, deleted boolean")


def signature(key: str, message: Column) -> Column:
    """HMAC-SHA256 of a text, as lower-case hex, by Spark's own functions."""
    secret = key.encode().ljust(64, b"\0")
    if len(secret) > 64:
        raise ValueError("the key has more than 64 bytes")
    pad = lambda n: F.unhex(F.lit(bytes(b ^ n for b in secret).hex()))
    inner = F.sha2(F.concat(pad(0x36), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


def signed_url(base: str, path: Column, key: str, issued: Column, minutes: int = MINUTES) -> Column:
    """An address of a file that holds for some minutes from ``issued`` (Unix seconds); null without a path."""
    expires = (issued + 60 * minutes).cast("long").cast("string")
    return F.concat(F.lit(f"{base.rstrip('/')}/"), path, F.lit("?expires="), expires, F.lit("&signature="), signature(key, F.concat(path, F.lit("\n"), expires)))


def is_valid(path: Column, expires: Column, given: Column, key: str, now: Column) -> Column:
    """Whether a signature is that of the path and the time, and the time hasn't passed."""
    return F.coalesce((signature(key, F.concat(path, F.lit("\n"), expires.cast("string"))) == given) & (expires >= now), F.lit(False))
