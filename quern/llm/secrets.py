"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

A candidate is a run of 20 or more characters that keys are written with. For each character class a
window slides over every maximal run of the class's characters in it, and the Shannon entropy of the
window is kept by adding the character that enters and taking off the one that leaves. Windows above a
class's threshold merge, with those of other classes, to a span of kind "entropy". Allow-listed runs
(known-harmless shapes, and words without digits) are suppressed, as are spans that a base match
covers. Base spans always stay.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import map_arrow, texts

#: The base patterns, fixed by the contract; kinds in the order in which they sort.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Character classes: name, pattern of a whole window's characters, window, least entropy in bits.
CLASSES = (
    ("hex", frozenset("0123456789abcdefABCDEF"), 20, 3.0),
    ("alnum", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), 20, 3.7),
    ("base64", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 24, 4.1),
)
#: By class: its runs that are no shorter than its window, which are maximal as the match is greedy, window and least entropy.
RUNS = tuple((re.compile(f"[{re.escape(''.join(sorted(letters)))}]{{{width},}}"), width, least) for _, letters, width, least in CLASSES)
#: Runs that look random and are not secret: UUIDs, paths and slugs of words, decimal numbers, one case without a digit.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(r"[+/_=-]*[A-Za-z]*[a-z]([+/_=-][A-Za-z+/_=-]*)?"),
    re.compile(r"[0-9+/_=-]+"),
    re.compile(r"[A-Z+/_=-]+"),
)


def entropy_windows(s: str, width: int, least: float) -> list[tuple[int, int]]:
    """Merged windows of ``width`` characters of ``s`` whose entropy is at least ``least`` bits a character."""
    if len(s) < width:
        return []
    term = [0.0, *(n * math.log2(n) for n in range(1, width + 2))]  # a character enters before one leaves
    counts: dict[str, int] = {}
    total = 0.0  # the sum of n log2 n
    spans: list[tuple[int, int]] = []
    bits = math.log2(width)
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        total += term[n + 1] - term[n]
        counts[c] = n + 1
        if i >= width:
            old = s[i - width]
            n = counts[old]
            total += term[n - 1] - term[n]
            counts[old] = n - 1
        if i >= width - 1 and bits - total / width >= least - 1e-9:
            a = i + 1 - width
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((a, i + 1))
    return spans


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The matches of the fixed patterns, sorted by start, then kind as listed."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    # A run of 32 hex digits lies in a candidate, as its characters are among a candidate's.
    for c in CANDIDATE.finditer(text):
        if c.end() - c.start() >= 32:
            found += [("hex", *m.span()) for m in HEX.finditer(text, c.start(), c.end())]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def entropy_spans(text: str, allowed: Sequence[re.Pattern] = ALLOWED) -> list[tuple[str, int, int]]:
    found: list[tuple[str, int, int]] = []
    for c in CANDIDATE.finditer(text):
        windows = []
        for runs, width, least in RUNS:
            for run in runs.finditer(text, c.start(), c.end()):
                if not any(p.fullmatch(run.group()) for p in allowed):
                    windows += [(run.start() + a, run.start() + b) for a, b in entropy_windows(run.group(), width, least)]
        first = len(found)
        for a, b in sorted(windows):
            if len(found) > first and a <= found[-1][2]:
                found[-1] = ("entropy", found[-1][1], max(b, found[-1][2]))
            else:
                found.append(("entropy", a, b))
    return found


def all_spans(text: str, allowed: Sequence[re.Pattern] = ALLOWED) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and base with added spans; an added span inside a base one is left out."""
    base = base_spans(text)
    starts, reach = [b for _, b, _ in base], list(accumulate((e for _, _, e in base), max))  # the furthest end of those that start no later
    added = [x for x in entropy_spans(text, allowed) if not (k := bisect_right(starts, x[1])) or reach[k - 1] < x[2]]
    return base, sorted([*base, *added], key=lambda x: (x[1], KINDS.index(x[0])))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long, secrets array<string>"


def scan_secrets(docs: DataFrame, allowed: Sequence[re.Pattern] = ALLOWED) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of the base spans, all spans and their texts.

    Spans are code points, end exclusive. Null and empty texts have no spans; repeated rows each get
    a row; a null doc_id stays null; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), strict=True):
                base, spans = all_spans(text, allowed)
                count = [sum(k == kind for k, _, _ in spans) for kind in KINDS]
                rows.append((doc, *count[:3], hashlib.sha256(written(base).encode()).hexdigest(), written(spans), count[3], [text[a:b] for _, a, b in spans]))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string())]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, SCHEMA)
