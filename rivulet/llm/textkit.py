"""Vectorised text helpers for code that runs inside Arrow tasks.

A chunk of documents is handled as one byte buffer with document offsets:
words, hashes and shingles of all its documents are computed by whole-array
operations, so the cost per word is a few array elements, not Python objects.
All hashes are fixed functions of the bytes: every task, executor and run
gives the same value for the same word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

ASCII_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"

_MASK = (1 << 64) - 1
_ODD = 0x9E3779B97F4A7C15


def _splitmix(seed: int, n: int) -> np.ndarray:
    x = (np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_ODD))
    return mix64(x)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODE = _splitmix(11, 256)
_PLACE = _splitmix(29, 64) | np.uint64(1)
_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        step = np.full(size, np.uint64(_BASE if kind == "up" else _INVERSE))
        step[0] = 1
        have = _powers[kind] = np.cumprod(step)
    return have


def lower_table(separators: bytes) -> np.ndarray:
    """Byte map that lower-cases A-Z; separator bytes become 0, and so does NUL if it is listed."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[0] = 1 if b"\0" not in separators else 0  # NUL is an ordinary word byte unless listed
    for b in separators:
        t[b] = 0
    return t


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20,
           rows: int = 60_000) -> Iterator[pa.Table]:
    """Regroup record batches into tables of about ``limit`` text bytes (one document at least)."""
    held: list[pa.RecordBatch] = []
    size = n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_buffer(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            room = max(1, limit - size)
            to = int(np.searchsorted(off, off[at] + room, side="right")) - 1
            to = min(max(to, at if held else at + 1), at + rows - n, batch.num_rows)
            if to > at:
                held.append(batch.slice(at, to - at))
                size += int(off[to] - off[at])
                n += to - at
            if to < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size, n = [], 0, 0
            at = to
    if held:
        yield pa.Table.from_batches(held)


def text_buffer(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its document offsets; null is an empty document."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0]: off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def words(norm: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-zero bytes, and the first word of each document (n + 1 entries)."""
    inside = norm != 0
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    before[cut] = False
    after[cut - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def hash_spans(norm: np.ndarray, starts: np.ndarray, ends: np.ndarray, stretch: int = 1 << 20) -> np.ndarray:
    """64-bit hash of each byte span, by differences of a running polynomial; ``starts`` ascend.

    The bytes are taken a stretch at a time, so the working arrays stay small.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = int(np.searchsorted(starts, a + stretch))
        s, e = starts[i:j] - a, ends[i:j] - a
        run = np.zeros(int(e.max()) + 1, np.uint64)
        n = len(run) - 1
        np.cumsum(_BYTE_CODE[norm[a:a + n]] * _power("up", n)[:n], out=run[1:])
        out[i:j] = (run[e] - run[s]) * _power("down", n + 1)[s]
        i = j
    return mix64(out ^ ((ends - starts).astype(np.uint64) * np.uint64(_ODD)))


def sequence_hash(word_hash: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words that begin at each index of ``first``."""
    h = np.full(len(first), np.uint64((length * 0xA24BAED4963EE407) & _MASK))
    for j in range(length):
        h += mix64(word_hash[first + j] + _PLACE[j]) * _PLACE[j + 32]
    return mix64(h)


def doc_of(ptr: np.ndarray) -> np.ndarray:
    """Document index of every item, given the first item of each document."""
    return np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))


def windows(ptr: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and document of every run of ``length`` consecutive words inside one document."""
    counts = np.maximum(np.diff(ptr) - length + 1, 0)
    docs = np.repeat(np.arange(len(ptr) - 1), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(ptr[:-1], counts) + inside, docs


def shingles(word_hash: np.ndarray, ptr: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and documents of all ``length``-word shingles; a shorter document is one shingle, an empty one has none."""
    first, docs = windows(ptr, length)
    out, of = [sequence_hash(word_hash, first, length)], [docs]
    n = np.diff(ptr)
    for k in range(1, length):
        short = np.flatnonzero(n == k)
        if len(short):
            out.append(sequence_hash(word_hash, ptr[short], k))
            of.append(short)
    return np.concatenate(out), np.concatenate(of)


def pieces(norm: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The byte strings of a few spans."""
    raw = norm.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal ``key``, from rows sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in key]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            now = tuple(c[a] for c in cols)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)
