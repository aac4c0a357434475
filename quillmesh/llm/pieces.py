"""Splitting texts into the pieces that a word-end BPE vocabulary encodes one by one, and a cache over distinct pieces.

``split`` reproduces the normaliser and pre-tokeniser declared in the vocabulary file: NFC, white space runs as
separators, lower case, then contractions, letter runs, single digits and runs of anything else. Texts of ASCII
and U+00C0-U+00FF letters without apostrophes are split with NumPy over bytes, the others with a regular
expression; both give the same pieces. Special tokens named by the file are cut out of the raw text first.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex

from . import kernels as K

_SPACE = r"\t-\r \x85\xa0  -     　"
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + _SPACE + r"\p{L}\p{N}]+")
#: Distinct pieces held by a worker; beyond it the cache starts anew (only speed depends on it).
CACHE = 400_000

_CLASS = np.full(256, 3, np.uint8)
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[48:58] = 2


def default_vocabulary() -> str:
    """The file of the installed public tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: bytes that print in
    Latin-1 stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class Vocabulary:
    """Token ids, merge ranks and special tokens of a vocabulary file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        letters = byte_letters()
        self.inner = [self.ids[c] for c in letters]
        self.final = [self.ids[c + self.suffix] for c in letters]
        self.bytes_of = {c: b for b, c in enumerate(letters)}
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(self.ids[a] << 20 | self.ids[b], rank)
            self.merged.append(self.ids[a + b])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def lower(text: str) -> str:
    """Lower case one character at a time, that is without the context rule for a final sigma."""
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


def split_text(text: str, vocab: Vocabulary) -> list[bytes | int]:
    """Pieces of one text in order, special tokens as their ids."""
    out: list[bytes | int] = []
    for part in vocab.cut.split(text) if vocab.cut else [text]:
        if part in vocab.special:
            out.append(vocab.special[part])
        else:
            out.extend(x.encode() for x in _PIECE.findall(lower(unicodedata.normalize("NFC", part))))
    return out


class Pieces:
    """Numbers distinct pieces and keeps, for each, what ``encode`` gave for it."""

    def __init__(self, vocab: Vocabulary, encode: Callable[[list[bytes]], list]):
        self.vocab, self.encode = vocab, encode
        self.reset()

    def reset(self) -> None:
        self.number: dict[bytes | int, int] = {}
        self.values: list = []

    def lookup(self, keys: list[bytes | int]) -> list[int]:
        number = self.number
        found = [number.get(k, -1) for k in keys]
        new = [k for k in dict.fromkeys(k for k, i in zip(keys, found) if i < 0)]
        if new:
            plain = [k for k in new if not isinstance(k, int)]
            made = iter(self.encode(plain))
            for k in new:
                number[k] = len(self.values)
                self.values.append([k] if isinstance(k, int) else next(made))
            found = [number[k] for k in keys]
        return found

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of all texts of a slice, text after text, and each text's first (len + 1)."""
        if len(self.values) > CACHE:
            self.reset()
        n = len(offsets) - 1
        plain = self._plain(data, offsets)
        if plain.all():
            return self._fast(data, offsets)
        parts: list[np.ndarray] = [None] * n  # type: ignore[list-item]
        at = np.flatnonzero(plain)
        if len(at):
            sizes = (offsets[1:] - offsets[:-1])[at]
            own = data[K.ragged(offsets[:-1][at], sizes)]
            numbers, first = self._fast(own, np.concatenate([[0], np.cumsum(sizes)]))
            for j, i in enumerate(at.tolist()):
                parts[i] = numbers[first[j] : first[j + 1]]
        raw = data.tobytes()
        for i in np.flatnonzero(~plain).tolist():
            keys = split_text(raw[offsets[i] : offsets[i + 1]].decode(), self.vocab)
            parts[i] = np.array(self.lookup(keys), np.int64)
        counts = np.fromiter(map(len, parts), np.int64, n)
        return np.concatenate(parts) if n else np.zeros(0, np.int64), np.concatenate([[0], np.cumsum(counts)])

    @staticmethod
    def _plain(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts whose every byte is ASCII or part of a letter of U+00C0-U+00FF, without ' and without <|."""
        odd = data >= 128
        lead = data == 0xC3
        tail = np.zeros(len(data), bool)
        tail[1:] = lead[:-1]
        odd &= ~lead & ~tail
        odd |= tail & ((data == 0x97) | (data == 0xB7))
        odd |= data == 39
        bar = np.zeros(len(data), bool)
        bar[1:] = (data[1:] == 124) & (data[:-1] == 60)
        return K.row_sums(odd | bar, offsets) == 0

    def _fast(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = K.LOWER[data]
        capital = (data >= 0x80) & (data <= 0x9E)
        capital[1:] &= data[:-1] == 0xC3
        capital[:1] = False
        low[capital] += 0x20
        kind = _CLASS[low]
        n = len(low)
        change = np.ones(n + 1, bool)
        change[1:n] = kind[1:] != kind[:-1]
        change[:n] |= kind == 2
        change[1:] |= np.append(kind[1:] == 2, True) if n else True
        change[offsets] = True
        edges = np.flatnonzero(change)
        starts, ends = edges[:-1], edges[1:]
        inside = kind[starts] != 0 if n else np.zeros(0, bool)
        starts, ends = starts[inside], ends[inside]
        first = np.searchsorted(starts, offsets)
        if not len(starts):
            return np.zeros(0, np.int64), first
        h = K.span_hashes(low, starts, ends)
        _, where, back = np.unique(h, return_index=True, return_inverse=True)
        raw = low.tobytes()
        keys = [raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist())]
        return np.array(self.lookup(keys), np.int64)[back], first


_held: dict[tuple, Pieces] = {}


def pieces_of(path: str, kind: str, make: Callable[[Vocabulary], Callable[[list[bytes]], list]]) -> Pieces:
    """The worker's cache for a vocabulary file and a use."""
    if (path, kind) not in _held:
        vocab = vocabulary(path)
        _held[path, kind] = Pieces(vocab, make(vocab))
    return _held[path, kind]
