"""Tokenizing whole texts with the public tokenizers, each distinct word once.

A byte-level BPE never merges across the white space that starts a word, nor a word BPE across any
white space, so a text's ids are the ids of its pieces one after another. Arrow cuts the texts of a
batch and finds the distinct pieces; only those are looked up, and the ids are gathered for all
pieces at once. Workers keep the ids of the pieces met lately, in two generations: when the younger
is full it becomes the older, and what is asked for again comes back, so memory is bounded.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Stands where a text is cut; texts that hold it are encoded whole.
CUT = "\0"
#: A space or line end that no white space follows, which is always the start of a token.
LED = r"([ \n])([^\s\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}])"
#: Signs that may follow a word's letters.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Ids of texts as the tokenizer gives them with add_special_tokens=False.

    As in that call, the string of a special token in a text is that token. ``kind`` is "byte" (a word
    keeps the white space before it) or "word" (white space only separates).
    """

    def __init__(self, path: str, kind: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind, self.limit = kind, limit
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.letters = _byte_letters()
        self.space, self.line = (self.letters[0x20], self.letters[0x0A]) if kind == "byte" else ("", "")
        starts = [i for t, i in self.tokenizer.get_vocab().items() if t[0] in (self.space, self.line)]
        self.starts = np.zeros(max(starts, default=0) + 1, bool)
        self.starts[starts] = True
        self.tails: dict[str, bytes] = {"": b""}  # ids of signs after letters, which always end a token

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def inner(self, text: str) -> str:
        return text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)

    def words(self, keys: list[str]) -> list[bytes]:
        """Ids of words of letters only, which the pre-tokenizer leaves whole: led by their space or line end, or bare."""
        if self.kind == "word":
            return [array("I", [t.id for t in self.model.tokenize(self.inner(k))]).tobytes() for k in keys]
        out = []
        for i in range(0, len(keys), 64):  # no token reaches over the start of a led word, so some are merged in one call
            ids = np.array([t.id for t in self.model.tokenize("".join(keys[i : i + 64]))], "<u4")
            at = (4 * np.flatnonzero(self.starts[np.minimum(ids, len(self.starts) - 1)])).tolist()
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)], strict=True)]
        return out

    def learn(self, pieces: Iterable[str]) -> None:
        """Gets the ids of pieces that aren't known."""
        keys: dict[str, int] = {}
        made: list[tuple[str, int, str, int]] = []
        older, known, space, line, byte = self.older.get, self.known, self.space, self.line, self.kind == "byte"
        for piece in pieces:
            if (ids := older(piece)) is not None:
                known[piece] = ids
                continue
            lead, body, skip = "", piece, 0
            if byte:
                if piece[:1] == " ":
                    lead, body = space, piece[1:]
                elif piece[:1] == "\n":
                    lead, body = line, piece[1:]
                else:  # what starts a text has the ids that it has after a line end
                    lead, skip = line, 4
            core = body.rstrip(SIGNS)
            if core.isalpha():
                if byte:
                    key = lead + (core if core.isascii() else self.inner(core))
                else:
                    key = core.lower() if core.isascii() else self.tokenizer.normalizer.normalize_str(core)
                if byte or key.isalpha():
                    made.append((piece, keys.setdefault(key, len(keys)), body[len(core) :], skip))
                    continue
            known[piece] = self.plain(piece).tobytes()
        of = self.words(list(keys))
        for piece, key, tail, skip in made:
            if tail not in self.tails:
                self.tails[tail] = self.plain(tail).tobytes()
            known[piece] = of[key][skip:] + self.tails[tail]

    def encode(self, texts: pa.Array, size: int = 4 << 20) -> list[np.ndarray]:
        """The ids of each text; a null is empty. About ``size`` bytes of text are worked on at once."""
        texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_string()).fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        out, begin = [], 0
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + size)))
            out += self._encode(texts.slice(begin, end - begin))
            begin = end
        return out

    def _encode(self, texts: pa.Array) -> list[np.ndarray]:
        if 2 * len(self.known) > self.limit:
            self.older, self.known = self.known, {}
        odd = pc.match_substring(texts, CUT)
        for content in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, content))
        odd = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        whole = {k: self.plain(texts[k].as_py()) for k in odd.tolist()}
        if whole:
            plain = np.ones(len(texts), bool)
            plain[odd] = False
            texts = pc.if_else(pa.array(plain), texts, "")
        cut = pc.replace_substring(texts, "\n", " ") if self.kind == "word" else pc.replace_substring_regex(texts, LED, CUT + r"\1\2")
        pieces = pc.split_pattern(cut, " " if self.kind == "word" else CUT)
        coded = pieces.flatten().dictionary_encode()
        distinct, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        ids = list(map(self.known.get, distinct))
        new = [k for k, x in enumerate(ids) if x is None]
        self.learn([distinct[k] for k in new])
        for k in new:
            ids[k] = self.known[distinct[k]]
        lengths = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        flat, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(lengths, dtype=np.int32) - lengths
        n = lengths[at]
        stops = np.cumsum(n, dtype=np.int32 if len(texts) > 1 else np.int64)
        places = np.repeat(starts[at] - (stops - n), n)
        places += np.arange(len(places), dtype=places.dtype)
        flat = flat[places]
        # A text's pieces are a list, never empty, of the flattened ones.
        last = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
        bounds = np.concatenate([[0], stops])[last].tolist()
        out = [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        for k, found in whole.items():
            out[k] = found
        return out


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """The worker's encoder for ``path``, made once."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]
