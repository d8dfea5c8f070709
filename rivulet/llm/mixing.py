"""Language-model scoring by logistic context mixing over the bits of words.

A text is its lower-cased words and one end.  Each word is spelt in bytes with
a closing byte, and each byte in the bits of a fixed prefix code made from the
training bytes.  Several predictors, each a hashed table of bit counts under
another context (the last one to six bytes, the beginning of the word, once by
words and once by occurrences), give a probability for every bit.  Their logits
are mixed by weights that a gate chooses (how many contexts are known), learned
online; a second table refines the mixed probability by what was seen at that
probability.  The product over bits is the probability of spelling the word.
Training sees each word without itself, as a word that is new.

On top, a mixture of three ways to write the next word is adapted along each
text: repeat a word of this text, take a word of the training vocabulary, or
spell one.  Its shares start from what the corpus says of new words (the share
of words seen once) and follow the text by online Bayesian updates.

Two more predictors look at the one and the two words before, and give a word
its count there, less a discount, over the count of the context.  At every
word of every text they are mixed with the ways above by logistic gates over
the logits of both contexts.  The weights of the gates start from what the
training texts say of contexts seen so often (each word without itself, by the
counts of its block) and learn online along the text.  Every part is a
distribution or less, so the score of a text is a proper probability.

Spelling depends on the word alone, so it is worked out once per distinct word
of the corpus.  Each block of documents asks for the counts of its distinct
words and words in context by keys (hashes), packed and shuffled by the keys'
first bits; the sums over the whole corpus, and the spellings, return to the
blocks in the order of the keys.  A word's key is its 64-bit hash; keys in
context grow with the corpus so that few share one (``_CHECK_BITS``).  What is
gathered grows with the corpus; only the bit tables are of fixed size
(``2 ** table_bits`` slots each) and are broadcast.
"""

from __future__ import annotations

import heapq
import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import textkit as tk
from rivulet.llm.catalog import query
from rivulet.llm.common import crc_part, partitions, prepare, stored, table

TABLE_BITS = 18
BLOCK_BYTES = 8 << 20
ORDERS = (1, 2, 3, 4, 6)
_N = len(ORDERS) + 2  # predictors: byte orders and beginning, both by distinct words; beginning by occurrences
_CLOSE, _END = 0x20, 0x0A
_GATES = 12
_STEPS = 24  # quantised logits of the refining table
_LOWER = tk.lower_table(tk.ASCII_SPACE)
_PLACES = 16  # places in a text, by powers of two, that have shares of their own
_REPEAT = 0.4  # share of repeating that texts approach as they get long
_TRUSTS = 16  # gates of a context of words, by powers of two of how often it was seen
_RATIOS = 40
_MISSES = 32.0  # words that every gate has predicted wrongly before it has seen any
_SPELL_BYTES = 160_000  # bytes whose bits are worked on at a time
_STRIDE = 16  # words between two steps of a text's weights
_RATE = 0.02
_PART_BITS, _PART_SHIFT = 5, 23  # parts of the keys: 32 at least, and one for every 8 to 16 MB of text
_CHECK_BITS = 10  # bits that a key has more than the number of bytes of text
_SHARE_PRIOR = 32.0  # words that the corpus shares of the three ways count for at the start of a text


def byte_code(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A Huffman code over bytes: code length, path of inner nodes and bits for each byte (rows padded with -1)."""
    heap = [(int(c) + 1, b, None) for b, c in enumerate(count)]
    heapq.heapify(heap)
    number = 256
    children = {}
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        children[number] = (a[1], b[1])
        heapq.heappush(heap, (a[0] + b[0], number, None))
        number += 1
    paths: dict[int, list] = {}
    todo = [(heap[0][1], [])]
    while todo:
        node, path = todo.pop()
        if node < 256:
            paths[node] = path
            continue
        for bit, child in enumerate(children[node]):
            todo.append((child, [*path, (node - 256, bit)]))
    size = np.array([len(paths[b]) for b in range(256)], np.int64)
    nodes = np.full((256, size.max()), -1, np.int64)
    bits = np.zeros((256, size.max()), np.int64)
    for b, path in paths.items():
        for i, (node, bit) in enumerate(path):
            nodes[b, i], bits[b, i] = node, bit
    return size, nodes, bits


@dataclass
class Bits:
    """All bits of a list of words: the word of each, its value, and a table slot for every predictor."""

    word: np.ndarray
    value: np.ndarray
    slots: np.ndarray


class Speller:
    """Turns words into bits and contexts."""

    def __init__(self, count: np.ndarray, table_bits: int):
        self.size, self.nodes, self.bits = byte_code(count)
        self.table_bits = table_bits

    def __call__(self, words: list[bytes]) -> Bits:
        buf = np.frombuffer(b"".join(words), np.uint8)
        n = np.array([len(w) for w in words], np.int64)
        start = np.cumsum(n) - n
        word = np.repeat(np.arange(len(words)), n)
        place = np.arange(len(buf)) - start[word]
        codes = buf.astype(np.uint64) + np.uint64(1)
        contexts = []
        h = np.zeros(len(buf), np.uint64)
        for k in range(1, max(ORDERS) + 1):
            before = np.zeros(len(buf), np.uint64)
            before[k:] = np.where(place[k:] >= k, codes[:-k] if k < len(buf) else 0, 0)
            h = h * np.uint64(0x9E3779B97F4A7C15) + before + np.uint64(k)
            if k in ORDERS:
                contexts.append(tk.mix64(h))
        begin = tk.hash_spans(buf, start[word], np.arange(len(buf)))
        contexts.append(tk.mix64(begin + np.uint64(101)))
        times = self.size[buf]
        at = np.repeat(np.arange(len(buf)), times)
        step = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        node = self.nodes[buf[at], step].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        slots = np.empty((_N, len(at)), np.int64)
        for i, c in enumerate(contexts):  # contexts are mixed already, so a product is enough to spread their nodes
            slot = c[at]
            slot ^= node
            slot *= np.uint64(0x9E3779B97F4A7C15)
            slot >>= np.uint64(64 - self.table_bits)
            slots[i] = slot.view(np.int64)
        slots[_N - 1] = slots[_N - 2]
        return Bits(word[at], self.bits[buf[at], step], slots)


@dataclass
class Model:
    """Bit counts, gate weights, refining table and the corpus shares of the three ways."""

    speller: Speller
    counts: np.ndarray  # (predictors, slots times two bit values)
    weights: np.ndarray  # (gates, predictors + 1)
    refine: np.ndarray  # (gates, steps, 2)

    def predictions(self, bits: Bits, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logit of a one for every predictor (with a constant), and the gate; ``own`` is taken off the counts."""
        n = len(bits.value)
        x = np.empty((_N + 1, n), np.float32)
        gate = np.zeros(n, np.int64)
        less = np.zeros((2, n, 2), np.float32) if own.any() else None
        if less is not None:
            less[0, np.arange(n), bits.value] = np.minimum(own, 1)
            less[1, np.arange(n), bits.value] = own
        for i in range(_N):
            c = self.counts[i].reshape(-1, 2).take(bits.slots[i], axis=0)
            if less is not None:
                c -= less[int(i == _N - 1)]
                np.maximum(c, 0, out=c)
            c0, c1 = c[:, 0], c[:, 1]
            x[i] = np.log((c1 + np.float32(0.2)) / (c0 + np.float32(0.2)))
            if i < _N - 1:
                gate += (c0 + c1 > 1) * (1 if i < len(ORDERS) else 6)
        x[_N] = 0.3
        return x, np.minimum(gate, _GATES - 1)

    def probability(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        z = np.einsum("ij,ji->i", self.weights.astype(np.float32)[gate], x).astype(float)
        return 1 / (1 + np.exp(-np.clip(z, -12, 12)))

    def refined(self, p: np.ndarray, gate: np.ndarray) -> np.ndarray:
        c = self.refine[gate, _step(p)]
        return np.clip(0.5 * p + 0.5 * (c[:, 1] + 4 * p) / (c.sum(1) + 4), 1e-6, 1 - 1e-6)

    def spell(self, words: list[bytes], own: np.ndarray) -> np.ndarray:
        """Natural-log probability of spelling each word; ``own``: how often training saw it (0 for held-out scoring)."""
        bits = self.speller(words)
        x, gate = self.predictions(bits, own[bits.word])
        p = self.refined(self.probability(x, gate), gate)
        return np.bincount(bits.word, np.log(np.where(bits.value == 1, p, 1 - p)), len(words))


def _step(p: np.ndarray) -> np.ndarray:
    z = np.log(p / (1 - p))
    return np.clip((z + 12) * (_STEPS / 24), 0, _STEPS - 1).astype(np.int64)


def _sorted(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of keys of ``bits`` bits, and the keys in it."""
    n = len(key).bit_length()
    if bits + n > 64:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    both = np.sort(key.astype(np.uint64) << np.uint64(n) | np.arange(len(key), dtype=np.uint64))  # several times faster
    return (both & np.uint64((1 << n) - 1)).astype(np.int64), both >> np.uint64(n)


def _begins(ordered: np.ndarray) -> np.ndarray:
    """Whether a row is the first with its key."""
    out = np.ones(len(ordered), bool)
    out[1:] = ordered[1:] != ordered[:-1]
    return out


def _zip(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unzip(body: bytes) -> bytes:
    return pa.decompress(body[8:], int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True)


def _narrow(x: np.ndarray) -> bytes:
    """Unsigned integers in as many bytes as the largest needs, all first bytes before all second ones."""
    x = x.astype("<u8")
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _widen(body: bytes) -> np.ndarray:
    width = body[0]
    raw = np.frombuffer(body, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.view("<u8").reshape(-1)


def _blocks(id_type):
    """Each block of documents as a row of its words, texts (as word numbers) and sizes, and a row per document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task = TaskContext.get().partitionId() << 24
        for number, chunk in enumerate(tk.chunks(batches, "text", BLOCK_BYTES)):
            buf, off = tk.text_buffer(chunk["text"])
            norm = _LOWER[buf]
            s, e, ptr = tk.words(norm, off)
            sort, ordered = _sorted(tk.hash_spans(norm, s, e), 64)
            begin = _begins(ordered)
            first = sort[begin]
            inverse = np.empty(len(sort), np.int64)
            inverse[sort] = np.cumsum(begin) - 1
            rank = np.argsort(-np.bincount(inverse, minlength=len(first)), kind="stable")  # frequent words have small numbers
            place = np.empty(len(rank), np.int64)
            place[rank] = np.arange(len(rank))
            first = first[rank]
            held = chunk["held"].to_numpy(zero_copy_only=False)
            d = len(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([task + number]), pa.array([None], pa.int64()), pa.array([_zip(_narrow(place[inverse]))], pa.binary()),
                 pa.array([_zip(b" ".join(tk.pieces(norm, s[first], e[first])))], pa.binary()),
                 pa.array([_zip(_narrow(np.diff(ptr) * 2 + held))], pa.binary()), pa.nulls(1, id_type), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.int64())], _NAMES)
            none, size = pa.nulls(d, pa.binary()), pa.array(np.diff(off))
            rows = pa.RecordBatch.from_arrays([pa.array(np.full(d, task + number)), pa.array(np.arange(d)), none, none, none,
                                               chunk["doc_id"].combine_chunks(), pa.array(held), size], _NAMES)
            yield from (rows.slice(a, 2000) for a in range(0, d, 2000))
    return run


_NAMES = ["block", "number", "body", "words", "docs", "doc_id", "held", "size"]


def _hashes(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buffer, starts, ends and hashes of words joined by spaces."""
    buf = np.frombuffer(joined, np.uint8)
    norm = np.where(buf == _CLOSE, np.uint8(0), buf)
    s, e, _ = tk.words(norm, np.array([0, len(norm)]))
    return norm, s, e, tk.hash_spans(norm, s, e)


class Texts:
    """The texts of a block as one run of word numbers."""

    def __init__(self, body: bytes, words: bytes, docs: bytes):
        self.norm, self.start, self.end, self.hashes = _hashes(_unzip(words))
        self.word = _widen(_unzip(body)).astype(np.int64)
        size = _widen(_unzip(docs)).astype(np.int64)  # twice the number of words, and one if held out
        self.held, size = size % 2 == 1, size // 2
        self.ptr = np.concatenate([[0], np.cumsum(size)])
        self.doc = tk.doc_of(self.ptr)
        self.place = np.arange(len(self.word)) - self.ptr[self.doc]
        self.train = ~self.held[self.doc]

    def grams(self, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words with one and with two words before them: where they are, and a key of ``bits`` bits for word and context."""
        h = self.hashes[self.word]
        for order in (1, 2):
            at = np.flatnonzero(self.place >= order)
            key = h[at - order]
            for back in range(order - 1, -1, -1):
                key = tk.mix64(key * np.uint64(0x9E3779B97F4A7C15) + h[at - back])
            yield at, key >> np.uint64(64 - bits)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Texts]]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.column("block")[i].as_py(), Texts(*(b.column(c)[i].as_py() for c in ("body", "words", "docs")))


def _parts(keys: np.ndarray, bits: int, part_bits: int) -> Iterator[tuple[int, slice]]:
    """Ascending keys, cut by their first bits."""
    part = (keys >> np.uint64(bits - part_bits)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, np.int64)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield int(part[a]), slice(a, b)


def _gaps(keys: np.ndarray, base: int) -> bytes:
    return _narrow(np.diff(keys, prepend=np.uint64(base)))


def _ungaps(body: bytes, base: int) -> np.ndarray:
    return np.cumsum(_widen(body), dtype=np.uint64) + np.uint64(base)


def _word_parts(part_bits: int):
    """The distinct words of each block with their counts in training, by the first bits of their hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in _read(batches):
            train = np.bincount(t.word[t.train], minlength=len(t.hashes))
            order = np.argsort(t.hashes)
            words = tk.pieces(t.norm, t.start[order], t.end[order])
            rows: list[tuple] = []
            for part, at in _parts(t.hashes[order], 64, part_bits):
                rows.append((part, _zip(b" ".join(words[at])), _narrow(train[order[at]])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)],
                                                 ["part", "words", "train"])
    return run


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in tk.groups(batches, ["part"]):
        norm, s, e, h = _hashes(b" ".join(_unzip(w.as_py()) for w in group["words"]))
        train = np.concatenate([_widen(c.as_py()) for c in group["train"]])
        _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        total = np.bincount(inverse.ravel(), train, len(first)).astype(np.int64)
        for a in range(0, len(first), 50_000):
            at = first[a:a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(tk.pieces(norm, s[at], e[at]), pa.binary()), pa.array(total[a:a + 50_000])], ["word", "train"])


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256, np.int64)
    for b in batches:
        c = b.column("train").to_numpy()
        buf, off = tk.text_buffer(b.column("word"))
        total += np.bincount(buf, np.repeat(c, np.diff(off)), 256).astype(np.int64)
        total[_CLOSE] += c.sum()
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], ["byte", "n"])


def _spelt(words: list[bytes]) -> list[bytes]:
    return [w + bytes([_CLOSE]) for w in words]


def _batches(batches: Iterator[pa.RecordBatch], limit: int = 16_000) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words to spell and their counts, ``limit`` words or ``_SPELL_BYTES`` at a time (one word at least)."""
    held: list[pa.RecordBatch] = []
    for b in itertools.chain(batches, [None]):
        if b is not None:
            held.append(b)
            if sum(x.num_rows for x in held) < limit:
                continue
        if not held:
            continue
        words = _spelt([w for x in held for w in x.column("word").to_pylist()])
        count = np.concatenate([x.column("train").to_numpy() for x in held])
        held = []
        size = np.cumsum([0, *map(len, words)])
        a = 0
        while a < len(words):
            to = min(a + limit, max(a + 1, int(np.searchsorted(size, size[a] + _SPELL_BYTES, side="right")) - 1))
            yield words[a:to], count[a:to]
            a = to


def _count_bits(speller):
    """Bit counts of every slot that a task's training words touch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = 1 << speller.value.table_bits
        total = np.zeros((_N, slots * 2))
        for words, c in _batches(batches):
            bits = speller.value(words)
            for i in range(_N):
                total[i] += np.bincount(bits.slots[i] * 2 + bits.value, c[bits.word] if i == _N - 1 else None, slots * 2)
        flat = total.ravel().astype("<u4")
        parts = np.split(flat, _N * 8)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())],
                                         ["part", "body"])
    return run


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in tk.groups(batches, ["part"]):
        total: np.ndarray | float = 0.0
        for body in group["body"]:
            total = total + np.frombuffer(zlib.decompress(body.as_py()), "<u4").astype(float)
        yield pa.RecordBatch.from_arrays([group["part"].combine_chunks()[:1], pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["part", "body"])


def _train(model):
    """Online Newton steps of the gate weights over a task's training words, each seen without itself.

    What the weights predicted before each step also fills the refining table.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        w, seen = m.weights.copy(), np.zeros(_GATES)
        curve = np.tile(np.eye(_N + 1) * 5.0, (_GATES, 1, 1))
        total = np.zeros(_GATES * _STEPS * 2)
        for words, c in _batches(batches, 512):
            bits = m.speller(words)
            x, gate = m.predictions(bits, c[bits.word])
            order = np.argsort(gate.astype(np.int8), kind="stable")
            cut = np.searchsorted(gate[order], np.arange(_GATES + 1))
            for g in range(_GATES):
                at = order[cut[g]:cut[g + 1]]
                if not len(at):
                    continue
                xs, value = x[:, at].astype(float), bits.value[at]
                p = 1 / (1 + np.exp(-np.clip(w[g] @ xs, -12, 12)))
                if seen[g] > 1000:
                    total += np.bincount((g * _STEPS + _step(p)) * 2 + value, minlength=len(total))
                curve[g] += (xs * (p * (1 - p))) @ xs.T
                w[g] += np.linalg.solve(curve[g], xs @ (value - p))
                seen[g] += len(at)
        k = _GATES * (_N + 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k + len(total))), pa.array(np.concatenate([(w * seen[:, None]).ravel(), total])),
             pa.array(np.concatenate([np.repeat(seen, _N + 1), np.zeros(len(total))]))], ["at", "n", "seen"])
    return run


def _summed(df: DataFrame, key: list[str], value: list[str]) -> pa.Table:
    return df.groupBy(*key).agg(*(F.sum(v).alias(v) for v in value)).toArrow()


def fit(vocabulary: DataFrame, table_bits: int = TABLE_BITS) -> Model:
    """Learn the bit model from all training words: ``vocabulary`` has ``word`` and ``train``, how often training saw it."""
    spark = vocabulary.sparkSession
    seen = vocabulary.where("train > 0").select("word", "train")
    rows = _summed(seen.mapInArrow(_bytes, "byte long, n long"), ["byte"], ["n"])
    count = np.zeros(256, np.int64)
    count[rows["byte"].to_numpy()] = rows["n"].to_numpy()
    speller = Speller(count, table_bits)
    packed = seen.mapInArrow(_count_bits(spark.sparkContext.broadcast(speller)), "part long, body binary")
    rows = packed.repartition("part").sortWithinPartitions("part").mapInArrow(_add_counts, "part long, body binary").toArrow()
    counts = np.zeros((_N * 8, (2 << table_bits) // 8), np.float32)
    for part, body in zip(rows["part"].to_pylist(), rows["body"], strict=True):
        counts[part] = np.frombuffer(body.as_py(), np.float32)
    weights = np.full((_GATES, _N + 1), 0.25)
    weights[:, _N] = 0
    model = Model(speller, counts.reshape(_N, 2 << table_bits), weights, np.zeros((_GATES, _STEPS, 2)))
    rows = _summed(seen.mapInArrow(_train(spark.sparkContext.broadcast(model)), "at long, n double, seen double"), ["at"], ["n", "seen"])
    k = model.weights.size
    flat, weight = np.zeros(k + model.refine.size), np.zeros(k + model.refine.size)
    flat[rows["at"].to_numpy()], weight[rows["at"].to_numpy()] = rows["n"].to_numpy(), rows["seen"].to_numpy()
    model.weights = np.where(weight[:k] > 0, flat[:k] / np.maximum(weight[:k], 1), weights.ravel()).reshape(weights.shape)
    model.refine = flat[k:].reshape(model.refine.shape)
    return model


def _known(key: np.ndarray, bits: int, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often training has the key of each row, and these counts by distinct key."""
    order, ordered = _sorted(key, bits)
    first = _begins(ordered)
    which = np.cumsum(first) - 1
    total = np.bincount(which, train[order], int(first.sum())).astype(np.int64)
    out = np.empty(len(key), np.int64)
    out[order] = total[which]
    return out, total


def _gate(n: np.ndarray) -> np.ndarray:
    """Number of the gate of a context that was seen ``n`` times."""
    return np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64), _TRUSTS - 1)


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task's texts say of the predictors by one and by two words before.

    Each training word is predicted by the rest of its block.  Rows count how
    many times likelier the context made it than the model below (powers of
    two, none first), by gate, and the distinct contexts seen once and twice.
    """
    ratios = np.zeros((2, _TRUSTS, _RATIOS))
    rare = np.zeros((2, 2))
    for _, t in _read(batches):
        tokens = max(int(t.train.sum()), 1)
        count = np.bincount(t.word[t.train], minlength=len(t.hashes))[t.word]
        below = np.maximum(count - 1, 0.5) / tokens
        bits = 64 - len(t.word).bit_length()
        for k, (at, key) in enumerate(t.grams(bits)):
            seen = np.zeros(len(t.word), np.int64)
            seen[at], total = _known(key, bits, t.train[at])
            rare[k] += (total == 1).sum(), (total == 2).sum()
            use = at[t.train[at]]
            n = count[use - 1] - 1
            use, n = use[n > 0], n[n > 0]
            c = seen[use] - 1
            ratio = np.maximum(c - 0.5, 0) / n / below[use]
            bin_ = np.where(c > 0, np.clip(np.log2(np.maximum(ratio, 1e-9)).astype(np.int64) + 8, 1, _RATIOS - 1), 0)
            ratios[k] += np.bincount(_gate(n) * _RATIOS + bin_, minlength=_TRUSTS * _RATIOS).reshape(_TRUSTS, _RATIOS)
            both = np.zeros(len(t.word))
            both[use] = np.maximum(c - 0.5, 0) / n
            below, count = (below + both) / 2, seen
    flat = np.concatenate([ratios.ravel(), rare.ravel()])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["at", "n"])


@dataclass
class Contexts:
    """How far the predictors by one and by two words before are trusted at the start of a text, and what is off their counts."""

    trust: np.ndarray  # (2, gates), logits
    off: np.ndarray  # of each count, by order


def contexts(blocks: DataFrame) -> Contexts:
    """The trusts under which the training words of all blocks are likeliest, each seen without itself."""
    rows = _summed(blocks.mapInArrow(_evidence, "at long, n double"), ["at"], ["n"])
    flat = np.zeros(2 * _TRUSTS * _RATIOS + 4)
    flat[rows["at"].to_numpy()] = rows["n"].to_numpy()
    ratios, rare = flat[:-4].reshape(2, _TRUSTS, _RATIOS), flat[-4:].reshape(2, 2)
    ratios[:, :, 0] += _MISSES
    r = np.concatenate([[0.0], 2.0 ** (np.arange(1, _RATIOS) - 7.5)])
    low, high = np.full((2, _TRUSTS, 1), 0.001), np.full((2, _TRUSTS, 1), 0.999)
    for _ in range(40):
        mid = (low + high) / 2
        up = (ratios * (r - 1) / (1 - mid + mid * r)).sum(2, keepdims=True) > 0
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    share = low[:, :, 0]
    off = rare[:, 0] / np.maximum(rare[:, 0] + 2 * rare[:, 1], 1)
    return Contexts(np.log(share / (1 - share)), np.clip(off, 0.1, 0.95))


def _ask(bits: int, part_bits: int):
    """Keys of each block's words, and of words with one and two words before, with their counts in it, by their first bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, t in _read(batches):
            yield _asked(block, 1, np.sort(t.hashes), None, 64, part_bits)
            for order, (at, key) in enumerate(t.grams(bits), 2):
                both = np.sort(key << np.uint64(1) | t.train[at].astype(np.uint64))
                key = both >> np.uint64(1)
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                count = np.add.reduceat(both & np.uint64(1), first) if len(key) else key
                yield _asked(block, order, key[first], count, bits, part_bits)
    return run


def _asked(block: int, order: int, keys: np.ndarray, count: np.ndarray | None, bits: int, part_bits: int, spelt: np.ndarray | None = None) -> pa.RecordBatch:
    part, body, n, s = [], [], [], []
    for p, at in _parts(keys, bits, part_bits):
        part.append(p)
        body.append(_gaps(keys[at], p << (bits - part_bits)))
        n.append(None if count is None else _narrow(count[at]))
        s.append(None if spelt is None else spelt[at].astype("<f4").tobytes())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(part), order)), pa.array(part, pa.int64()), pa.array(np.full(len(part), block)),
                                       pa.array(body, pa.binary()), pa.array(n, pa.binary()), pa.array(s, pa.binary())], _ASKED)


_ASKED = ["order", "part", "block", "keys", "n", "spelt"]
_ASK_TYPE = "order long, part long, block long, keys binary, n binary, spelt binary"


def _spell_all(model, part_bits: int):
    """Counts and spellings of the vocabulary, packed by the first bits of the words' hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for words, c in _batches(batches):
            held.append((_hashes(b"".join(words))[3], c, model.value.spell(words, np.zeros(len(words), np.int64))))
            if sum(len(h[1]) for h in held) > 400_000:
                yield _vocabulary(held, part_bits)
                held = []
        if held:
            yield _vocabulary(held, part_bits)
    return run


def _vocabulary(held: list[tuple], part_bits: int) -> pa.RecordBatch:
    key, c, spelt = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(key)
    return _asked(-1, 1, key[order], c[order], 64, part_bits, spelt[order])


def _answer(bits: int, part_bits: int):
    """Counts of the whole corpus, and spellings of words, for the keys that each block asked for, in their order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in tk.groups(batches, ["order", "part"]):
            order, part = group["order"][0].as_py(), group["part"][0].as_py()
            base = part << ((64 if order == 1 else bits) - part_bits)
            block = group["block"].to_numpy()
            keys = [_ungaps(b.as_py(), base) for b in group["keys"]]
            asked = np.flatnonzero(block >= 0)
            cut = np.cumsum([0, *(len(keys[i]) for i in asked)])
            key = np.concatenate([np.zeros(0, np.uint64), *(keys[i] for i in asked)])
            spelt = None
            if order == 1:
                known = np.flatnonzero(block < 0)
                vocabulary = np.concatenate([keys[i] for i in known])
                sort = np.argsort(vocabulary)
                to = sort[np.searchsorted(vocabulary[sort], key)]
                count = np.concatenate([_widen(group["n"][i].as_py()) for i in known.tolist()])[to]
                spelt = np.concatenate([np.frombuffer(group["spelt"][i].as_py(), "<f4") for i in known.tolist()])[to]
            else:
                count, _ = _known(key - np.uint64(base), bits - part_bits, np.concatenate([_widen(group["n"][i].as_py()) for i in asked.tolist()]))
            body = [_narrow(count[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            more = [None if spelt is None else spelt[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            k = len(asked)
            yield pa.RecordBatch.from_arrays([pa.array(block[asked]), pa.array(np.full(k, order)), pa.array(np.full(k, part)),
                                              pa.array(body, pa.binary()), pa.array(more, pa.binary())], ["block", "order", "part", "body", "words"])
    return run


class Block(Texts):
    """The texts of a block, with what each predictor says of every word."""

    def __init__(self, group: pa.Table, bits: int):
        order = group["order"].to_numpy()
        first = int(np.flatnonzero(order == 0)[0])
        super().__init__(*(group[c][first].as_py() for c in ("body", "words", "docs")))
        docs = group.filter(pa.array(order == 4))
        self.docs = docs.take(pa.array(np.argsort(docs["number"].to_numpy())))
        rows = [np.flatnonzero(order == k).tolist() for k in (1, 2, 3)]
        sort = np.argsort(self.hashes)
        self.count, self.spelt = np.zeros(len(sort)), np.zeros(len(sort))
        if rows[0]:
            self.count[sort] = np.concatenate([_widen(group["body"][i].as_py()) for i in rows[0]])
            self.spelt[sort] = np.concatenate([np.frombuffer(group["words"][i].as_py(), "<f4") for i in rows[0]])
        self.seen = [self.count[self.word]]  # how often training has each word, with one word before it, and with two
        for k, (at, key) in zip(rows[1:], self.grams(bits), strict=True):
            seen = np.zeros(len(self.word))
            if k:
                sort, ordered = _sorted(key, bits)
                seen[at[sort]] = np.concatenate([_widen(group["body"][i].as_py()) for i in k])[np.cumsum(_begins(ordered)) - 1]
            self.seen.append(seen)
        numbers = max(1, len(self.count))
        sort, ordered = _sorted(self.doc * numbers + self.word, (len(self.ptr) * numbers).bit_length())
        first = np.flatnonzero(_begins(ordered))
        self.before = np.empty(len(sort))
        self.before[sort] = np.arange(len(sort)) - np.repeat(first, np.diff(np.append(first, len(sort))))
        self.bucket = np.minimum(np.log2(self.place + 1).astype(np.int64), _PLACES - 1)

    def ways(self, count: np.ndarray, tokens: int) -> np.ndarray:
        """Natural-log probability of each word by repeating, by vocabulary and by spelling."""
        with np.errstate(divide="ignore"):
            return np.stack([np.log(self.before / np.maximum(self.place, 1)), np.log(count / max(tokens, 1))[self.word], self.spelt[self.word]])

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Sum over each document of a value per word."""
        return np.bincount(self.doc, x, len(self.ptr) - 1)

    def adapted(self, p: np.ndarray, shares: np.ndarray) -> np.ndarray:
        """Natural-log probability of each word by the mixture, whose shares follow the words of the text so far.

        ``p`` holds logs, and stays in logs: the spelling of a long word is far below the least float.
        """
        top = p.max(0)  # spelling is never impossible, so this is finite
        start = shares.T.take(self.bucket, axis=1)
        p = np.exp(p - top)
        r = p * start
        r /= np.maximum(r.sum(0), 1e-300)
        run = np.zeros((3, r.shape[1] + 1))
        np.cumsum(r, axis=1, out=run[:, 1:])
        now = run[:, :-1] - run.take(self.ptr[self.doc], axis=1)
        start *= _SHARE_PRIOR
        now += start
        return top + np.log((p * now).sum(0) / now.sum(0))

    def mixed(self, below: np.ndarray, known: Contexts) -> np.ndarray:
        """Natural-log probability of each word when the predictors by one and two words before are mixed with ``below``.

        Each predictor is trusted by a logistic gate over the logits of both
        contexts.  Its weights start from what the corpus says of contexts seen
        so often and follow the text: after every ``_STRIDE`` words a step up
        the gradient of their probability.
        """
        n = np.zeros((2, len(below)))
        for k in (0, 1):
            n[k, k + 1:] = np.where(self.place[k + 1:] > k, self.seen[k][k:-1], 0)
        there = n > 0
        p = np.maximum(np.stack(self.seen[1:]) - known.off[:, None], 0) / np.maximum(n, 1)
        trust = np.where(there, np.stack([known.trust[k][_gate(n[k])] for k in (0, 1)]), 0)
        with np.errstate(divide="ignore"):
            logs = np.concatenate([np.log(p), below[None]])
        top = logs.max(0)
        scaled = np.exp(logs - top)
        size = np.diff(self.ptr)
        order = np.argsort(-size, kind="stable")
        weights = np.zeros((len(size), 2, 3))
        weights[:, 0, 0] = weights[:, 1, 1] = 1
        out = np.zeros(len(below))
        ends = np.sort(size)
        step = np.arange(_STRIDE)
        for a in range(0, int(size.max(initial=0)), _STRIDE):
            d = order[:len(size) - int(np.searchsorted(ends, a, side="right"))]
            inside = a + step < size[d][:, None]
            at = np.where(inside, self.ptr[d][:, None] + a + step, 0)
            x = np.stack([trust[0][at], trust[1][at], np.ones(at.shape)])
            s = 1 / (1 + np.exp(-np.clip(np.einsum("dki,idw->kdw", weights[d], x), -12, 12))) * there[:, at]
            one, two, none = scaled[:, at]
            lower = s[0] * one + (1 - s[0]) * none
            total = s[1] * two + (1 - s[1]) * lower
            out[at[inside]] = np.log(total[inside])
            slope = np.stack([(1 - s[1]) * s[0] * (1 - s[0]) * (one - none), s[1] * (1 - s[1]) * (two - lower)]) / total * inside
            weights[d] += _RATE * np.einsum("kdw,idw->dki", slope, x)
        return top + out


def _score(tokens: int, distinct: int, ends: int, shares: np.ndarray, known: Contexts, bits: int):
    """Documents of each block, scored with the counts and spellings of its words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = min((ends + 1) / (tokens + 2), 0.5)  # before each word, a text ends or goes on
        end_base = np.log10((ends + 1) / (tokens + distinct + 1))
        for group in tk.groups(batches, ["block"]):
            b = Block(group, bits)
            n = np.diff(b.ptr)
            base = np.log10((b.count + 1) / (tokens + distinct + 1))[b.word]
            mixed = b.mixed(b.adapted(b.ways(b.count, tokens), shares), known) / np.log(10)
            seen = b.sums((b.count > 0)[b.word].astype(float)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.docs["doc_id"].combine_chunks(), pa.array(b.held), pa.array(n + 1), pa.array(seen + int(ends > 0)),
                 pa.array(np.full(len(n), tokens)), pa.array(b.sums(base) + end_base),
                 pa.array(b.sums(mixed) + n * np.log10(1 - end) + np.log10(end)), b.docs["size"].combine_chunks()],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"])
    return run


def _shares(new: float) -> np.ndarray:
    """Starting shares of repeating, vocabulary and spelling by place: ``new`` words are spelt, later words repeat more."""
    new = min(max(new, 1e-3), 0.9)
    place = np.arange(_PLACES)
    repeat = _REPEAT * place / (place + 4)
    return np.stack([repeat, (1 - new) * (1 - repeat), new * (1 - repeat)], 1)


def lm_scores(docs: DataFrame, held: F.Column, id_col: str = "doc_id", text_col: str = "text", table_bits: int = TABLE_BITS) -> DataFrame:
    """Score every document by a model of those where ``held`` is not true.

    Columns: the id, ``held_out``, ``n_tokens`` (words and the end),
    ``n_known``, ``train_tokens``, ``base_score`` (add-one unigrams),
    ``score`` (both log10) and ``bits_per_byte``.  A null or empty text is the
    end alone.  Repeated rows are scored each (and count as often in training);
    a null ``held`` means training.  An empty table gives an empty result; with
    no training rows every word is spelt by the untrained code.  Other input
    columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    stores = stored(rows.mapInArrow(_blocks(id_type), f"block long, number long, body binary, words binary, docs binary, doc_id {kind}, held boolean, size long"))
    blocks = stores.where("number is null").select("block", "body", "words", "docs")
    seen = stores.agg(F.sum("size").alias("bytes"), F.count_if(~F.col("held")).alias("train")).first()
    sizes, texts = seen["bytes"] or 0, seen["train"]
    part_bits = max(_PART_BITS, (sizes >> _PART_SHIFT).bit_length())
    packed = blocks.mapInArrow(_word_parts(part_bits), "part long, words binary, train binary")
    vocabulary = stored(packed.repartition(partitions(spark), "part").sortWithinPartitions("part").mapInArrow(_distinct_words, "word binary, train long"))
    size = vocabulary.agg(F.sum("train").alias("n"), F.count_if(F.col("train") > 0).alias("v"),
                          F.count_if(F.col("train") == 1).alias("once")).first()
    tokens, distinct = (size["n"] or 0) + texts, size["v"] + (texts > 0)
    bits = min(sizes.bit_length() + _CHECK_BITS, 62)
    model = fit(vocabulary, table_bits)
    known = contexts(blocks)
    spelt = vocabulary.mapInArrow(_spell_all(spark.sparkContext.broadcast(model), part_bits), _ASK_TYPE)
    asked = blocks.mapInArrow(_ask(bits, part_bits), _ASK_TYPE).union(spelt)
    answers = asked.repartition(partitions(spark), "order", "part").sortWithinPartitions("order", "part").mapInArrow(
        _answer(bits, part_bits), "block long, order long, part long, body binary, words binary")
    order = F.when(F.col("number").isNull(), 0).otherwise(4).cast("long").alias("order")
    parts = stores.select("block", order, F.lit(0).cast("long").alias("part"), "body", "words", "docs", "number", "doc_id", "size").unionByName(
        answers, allowMissingColumns=True)
    ordered = parts.repartition(partitions(spark), "block").sortWithinPartitions("block", "order", "part")
    out = ordered.mapInArrow(_score(tokens, distinct, texts, _shares(size["once"] / max(1, tokens)), known, bits),
                             f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long")
    return out.select(F.col("doc_id").alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score",
                      (-F.col("score") * np.log2(10.0) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))


@query("op8_mixing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document under a model of those whose id's remainder is not 2."""
    return lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), crc_part("doc_id", 7) == 2)
