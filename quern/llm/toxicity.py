"""Toxicity by a weighted lexicon.

Texts are folded first: lower case, compatible forms, look-alike letters of other scripts, digits and signs that
stand for letters, separators to one space. A lexicon of folded words and beginnings of words, each
with a weight, is learned from labelled rows: they are taken greedily by how many toxic texts they
cover that the lexicon doesn't yet, among those far commoner in toxic texts. Where a word of the lexicon stands in
a phrase that only clean texts have, the phrase is an exception and its words don't count. One
Aho-Corasick automaton finds words and exceptions; the weights found, normalised by length, and a
logistic curve give the score.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import free_name, map_arrow, texts, without_column

#: Letters of other scripts by the Latin letter they look like.
HOMOGLYPHS = {
    "a": "аɑαāăąàáâãäå",
    "b": "вьƅ",
    "c": "сϲçćč",
    "d": "ԁɗď",
    "e": "еёєεēęèéêëě",
    "f": "ƒϝꞙẝḟ",
    "g": "ɡց",
    "h": "һнħ",
    "i": "іїιıìíîïī",
    "j": "јϳ",
    "k": "кκķ",
    "l": "ӏłĺľ",
    "m": "мʍ",
    "n": "ոηñńň",
    "o": "оοσօòóôõöøō",
    "p": "рρ",
    "q": "ԛգ",
    "r": "гŕř",
    "s": "ѕꜱśšş",
    "t": "тτţť",
    "u": "υսùúûüūů",
    "v": "ѵν",
    "w": "ԝա",
    "x": "хχ",
    "y": "уүýÿ",
    "z": "ᴢźżž",
}
#: Digits and signs by the letter they stand for within a word. i and l fold together, as 1 is both.
DIGITS = {"0": "o", "1": "l", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "8": "b", "9": "g", "i": "l"}


def _fold_table() -> dict[int, str]:
    table = {ord(c): letter for letter, alike in HOMOGLYPHS.items() for c in alike}
    table = {c: DIGITS.get(x, x) for c, x in table.items()} | {ord(c): x for c, x in DIGITS.items()}
    return table | {c: " " for c in range(128) if not chr(c).isalnum() and chr(c) not in DIGITS}


class _Folding(dict):
    """The table, and for other characters: none for marks and characters without a width, a space for signs, themselves for letters."""

    def __missing__(self, code: int) -> str:
        kind = unicodedata.category(chr(code))
        self[code] = "" if kind in ("Mn", "Me", "Cf") else chr(code) if kind[0] in "LN" or kind == "Mc" else " "
        return self[code]


_FOLD = _Folding(_fold_table())
_ALIKE = {ord(c): letter for letter, alike in HOMOGLYPHS.items() for c in alike}


def fold(text: str) -> str:
    if not text.isascii():  # look-alikes first, as some of them are compatible with a letter that isn't alike
        text = unicodedata.normalize("NFKC", text.lower().translate(_ALIKE))
    return f" {' '.join(text.lower().translate(_FOLD).split())} "


def fold_word(word: str) -> str:
    return fold(word).strip()


@dataclass
class Lexicon:
    """Weights of folded words (a star ends the beginning of words), exception phrases, and the curve from (log density, log weight) to a score."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-3.0, 0.0, 0.0)
    prior: float = 0.02

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for word, weight in self.weights.items():
            pattern = f" {word[:-1]}" if word.endswith("*") else f" {word} "
            found.add_word(pattern, (len(pattern) - 2, weight))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase), 0.0))
        if len(found):
            found.make_automaton()
        return found

    def features(self, folded: str, automaton) -> tuple[float, int]:
        """The sum of the weights outside exceptions, and the number of words."""
        total, spans, free = 0.0, [], []
        if len(automaton):
            for end, (n, weight) in automaton.iter(folded):
                (spans if weight == 0.0 else free).append((end - n, end, weight))
        spans.sort()
        reach = list(accumulate((y for _, y, _ in spans), max))  # the furthest end of the exceptions that start no later
        for a, b, weight in free:
            k = bisect_right(spans, (a, math.inf))
            if not k or reach[k - 1] < b:
                total += weight
        return total, folded.count(" ") - 1

    def score(self, total: float, n_words: int) -> float:
        x = inputs(total, n_words, self.prior)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(self.curve, x))))))


def inputs(total: float, n_words: int, prior: float) -> tuple[float, float, float]:
    return 1.0, math.log((total / max(1, n_words) + prior) / prior), math.log1p(total)


def _features(folded: str, stems: tuple[int, ...]) -> set[str]:
    """A text's words, and their beginnings of ``stems`` letters marked with a star."""
    ws = set(folded.split())
    return ws | {f"{w[:n]}*" for w in ws for n in stems if len(w) > n}


def learn(rows: Iterable[tuple[str, int]], max_words: int = 2000, min_share: float = 0.01, min_odds: float = 2.0, stems: tuple[int, ...] = (4, 5, 6)) -> Lexicon:
    """A lexicon from (text, label) rows.

    Entries are words, or beginnings of words, whose log-odds for toxic texts are at least ``min_odds``
    and that at least max(3, min_share of the toxic texts) hold. One enters if that many toxic texts hold
    it that have fewer than three entries so far, the one that covers most first. So words that only go
    along with toxic ones stay out. The lexicon ends at ``max_words`` entries, if it gets that far.
    """
    folded = [(fold(t), int(y)) for t, y in rows]
    n = [sum(y == k for _, y in folded) for k in (0, 1)]
    if not n[0] or not n[1]:
        return Lexicon()
    df = (Counter(), Counter())
    for t, y in folded:
        if y:
            df[1].update(_features(t, stems))
    least = max(3, math.ceil(min_share * n[1]))
    able = {w for w, c in df[1].items() if c >= least}
    for t, y in folded:
        if not y:
            df[0].update(_features(t, stems) & able)
    odds = lambda w: math.log((df[1][w] + 0.5) / (n[1] + 1)) - math.log((df[0][w] + 0.5) / (n[0] + 1))
    able = {w for w in able if odds(w) >= min_odds}
    holders: dict[str, list[int]] = {w: [] for w in able}
    for k, (t, y) in enumerate(folded):
        if y:
            for w in _features(t, stems) & able:
                holders[w].append(k)
    cover, weights = Counter(), {}
    while able and len(weights) < max_words:
        gain = {w: sum(cover[k] < 3 for k in holders[w]) for w in able}
        best = max(able, key=lambda w: (gain[w] * odds(w), not w.endswith("*"), w))
        if gain[best] < least:
            break
        weights[best] = odds(best)
        cover.update(holders[best])
        able.discard(best)
    phrases = (Counter(), Counter())
    for t, y in folded:
        ws = t.split()
        listed = [w in weights or any(f"{w[:n]}*" in weights for n in stems if len(w) > n) for w in ws]
        near = {" ".join(ws[k : k + 2]) for k in range(len(ws) - 1) if listed[k] or listed[k + 1]}
        phrases[y].update(near)
    exceptions = tuple(sorted(p for p, c in phrases[0].items() if c >= least and not phrases[1][p]))
    made = Lexicon(weights, exceptions)
    automaton = made.automaton()
    x = np.array([inputs(*made.features(t, automaton), made.prior) for t, _ in folded])
    made.curve = _logistic(x, np.array([y for _, y in folded], float))
    return made


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> tuple[float, float, float]:
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([0.0] + [1.0] * (x.shape[1] - 1)) + 1e-6 * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def held_out(doc_id: str = "doc_id"):
    """Rows no label of which is learned: crc32 of the doc_id as text, modulo 4, is 2. A null doc_id is not one."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 8_000) -> Lexicon:
    """Learns from at most ``sample_rows`` labelled rows, whole texts, those least in a hash of their doc_id.

    Rows without a label, and held-out rows, are not learned from; of rows that share a doc_id one is, that
    with the least text, with the larger label. Where no row of either label is left, the lexicon is empty and every score low.
    """
    marked = labels.filter("toxic IN (0, 1)").filter(~held_out()).groupBy(F.col("doc_id").alias("labelled")).agg(F.max("toxic").alias("toxic"))
    # The rows are chosen by their labels alone and are at most sample_rows, so the texts stay where they are.
    chosen = F.broadcast(marked.orderBy(F.xxhash64("labelled"), "labelled").limit(sample_rows))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter(~held_out())
    found = rows.join(chosen, F.col("doc_id") == F.col("labelled")).groupBy("labelled").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    return learn(sorted((r.text, r.toxic) for r in found))


def score_toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3, column: str = "toxicity") -> DataFrame:
    """Adds to each row of ``docs`` one struct, ``column``, of score and predicted (score >= threshold).

    Null texts count as empty; empty texts get the score of no hit. Equal texts get equal scores, whatever
    their doc_id, which may be null or repeated; a text of any length is scored whole. The
    struct takes the place of a column of ``docs`` with that name.
    """
    docs = without_column(docs, column)
    kind = pa.struct([("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            scores = [lexicon.score(*lexicon.features(fold(t), automaton)) for t in texts(batch.column("text"))]
            yield batch.append_column(column, pa.array([{"score": s, "predicted": int(s >= threshold)} for s in scores], kind))

    return map_arrow(docs, run, T.StructType([*docs.schema.fields]).add(column, T.StructType.fromDDL("score double, predicted int")))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic."""
    name = free_name(docs, "toxicity")
    return score_toxicity(docs, fit(docs, labels), column=name).filter(F.col(name).predicted == 0).select(docs.columns)
