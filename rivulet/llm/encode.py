"""Token ids of whole texts, with each distinct word encoded once per worker.

The word-level BPE of this vocabulary never merges across white space, letters,
digits and other signs.  So a chunk of texts is cut by whole-array operations
into those units, the distinct units are looked up by hash, and only units that
the worker has not met are passed to the tokenizer.  A run of text in which the
cut could differ from the tokenizer's own (apostrophes, special-token marks,
characters beyond Latin-1 letters) is passed to it whole.
"""

from __future__ import annotations

import os

import numpy as np

from rivulet.llm import textkit as tk

CACHE_UNITS = 1_500_000
_SPACE, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3

_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[list(tk.ASCII_SPACE)] = _SPACE
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[48:58] = _DIGIT
# Bytes that make a run of text one unit: control signs, the apostrophe, all non-ASCII (Latin-1 letters are let off).
_WHOLE = np.zeros(256, bool)
_WHOLE[:32] = True
_WHOLE[list(tk.ASCII_SPACE)] = False
_WHOLE[[0x27, 0x7F]] = True
_WHOLE[0x80:] = True


def _byte_characters() -> str:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in set(plain) else chr(next(spare)) for b in range(256))


class UnitEncoder:
    """Encodes chunks of texts with the tokenizer file at ``path`` (word-level BPE with byte characters)."""

    def __init__(self, path: str, cache_units: int = CACHE_UNITS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.characters = dict(enumerate(_byte_characters()))
        self.limit = cache_units
        self._forget()

    def _forget(self) -> None:
        self.key = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def units(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes to look up (lower case where that is safe), and starts, ends and whole-run marks of the units."""
        n = len(buf)
        cls = _CLASS[buf]
        whole = _WHOLE[buf]
        lead = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)) if n > 1 else np.zeros(0, np.int64)
        cls[lead] = cls[lead + 1] = _LETTER
        whole[lead] = whole[lead + 1] = False
        if n > 1:
            whole[:-1] |= (buf[:-1] == 0x3C) & (buf[1:] == 0x7C)
        rs, re, _ = tk.words((cls != _SPACE).view(np.uint8), off)
        count = np.zeros(n + 1, np.int64)
        np.cumsum(whole, out=count[1:])
        odd = count[re] > count[rs]
        low = tk.lower_table(b"")[buf]
        upper = lead[buf[lead + 1] < 0x9F] + 1
        low[upper] = buf[upper] + 0x20
        if odd.any():
            inside = np.zeros(n + 1, np.int32)
            inside[rs[odd]] += 1
            inside[re[odd]] -= 1
            inside = np.cumsum(inside[:-1]) > 0
            low[inside] = buf[inside]
            cls[inside] = 4
        start = np.zeros(n + 1, bool)
        if n:
            start[:-1] = cls == _DIGIT
            start[1:-1] |= cls[1:] != cls[:-1]
            start[rs] = True
            start[:-1] &= cls != _SPACE
        starts = np.flatnonzero(start)
        stop = start.copy()
        stop[re] = True
        ends = np.flatnonzero(stop)
        ends = ends[np.searchsorted(ends, starts, side="right")] if len(starts) else starts
        return low, starts, ends, cls[starts] == 4 if len(starts) else np.zeros(0, bool)

    def _encode(self, raw: list[bytes], whole: list[bool]) -> list[list[int]]:
        tokenize, characters = self.model.tokenize, self.characters
        out = [[] if w else [t.id for t in tokenize(b.decode("latin-1").translate(characters))]
               for b, w in zip(raw, whole, strict=True)]
        odd = [i for i, w in enumerate(whole) if w]
        if odd:
            got = self.tokenizer.encode_batch([raw[i].decode("utf-8", "replace") for i in odd], add_special_tokens=False)
            for i, e in zip(odd, got, strict=True):
                out[i] = e.ids
        return out

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunk, and where each document's ids begin (n + 1 entries)."""
        low, s, e, whole = self.units(buf, off)
        h, first, inverse = np.unique(tk.hash_spans(low, s, e), return_index=True, return_inverse=True)
        at = np.searchsorted(self.key, h)
        known = np.zeros(len(h), bool)
        if len(self.key):
            known = self.key[np.minimum(at, len(self.key) - 1)] == h
        if len(self.key) + (~known).sum() > self.limit:
            self._forget()
            known[:] = False
        new = np.flatnonzero(~known)
        if len(new):
            f = first[new]
            got = self._encode(tk.pieces(low, s[f], e[f]), whole[f].tolist())
            size = np.array([len(x) for x in got], np.int32)
            where = len(self.ids) + np.cumsum(size) - size
            self.ids = np.concatenate([self.ids, np.array([t for x in got for t in x], np.uint32)])
            key = np.concatenate([self.key, h[new]])
            order = np.argsort(key, kind="stable")
            self.key = key[order]
            self.at = np.concatenate([self.at, where])[order]
            self.size = np.concatenate([self.size, size])[order]
        slot = np.searchsorted(self.key, h)[inverse.ravel()]
        size = self.size[slot].astype(np.int64)
        end = np.cumsum(size)
        pick = np.repeat(self.at[slot] - (end - size), size) + np.arange(end[-1] if len(end) else 0)
        bound = np.concatenate([[0], end])
        return self.ids[pick], bound[np.searchsorted(s, off)]


_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """The worker's encoder for a tokenizer file, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    """Path of the word-level BPE vocabulary."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")
