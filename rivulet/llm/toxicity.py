"""Toxicity by a subsequence string-kernel support vector machine with Nystrom landmarks.

The kernel of two words counts their common subsequences of three characters,
each weighted down for every character it skips, and is normalised; so an
insult keeps most of its similarity when characters are inserted, left out or
swapped for digits.  A sentence is described by its best similarity to each of
a set of landmark words.  The Nystrom map turns this into coordinates in which
a linear support vector machine separates labelled sentences; a document's
score is its most toxic sentence, calibrated to the labels.

Landmarks come from word counts over all labelled rows (grouped in Spark, only
the top words reach the driver).  The machine itself is fitted on at most
``max_documents`` labelled documents of each class, those with the smallest
hash of their id; the calibration counts each as often as its class was
thinned, so that scores follow the share of the whole table.  Scoring is row-local: no shuffle, one broadcast model of
fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm import textkit as tk
from rivulet.llm.catalog import query
from rivulet.llm.common import crc_part, prepare, stored, table

THRESHOLD = 0.7
LANDMARKS = 128
MAX_DOCUMENTS = 1500
_DECAY = 0.6  # weight of a subsequence for each skipped character
_SPAN = 6  # greatest distance of its first and last character
_FLOOR = 0.35  # similarity that counts as none
_SYMBOLS = 33
_BLOCK_WORDS = 2_000  # compared with the landmarks at once; each word's similarities are its own
_START = 32
_GAPPED = 0.1  # weight of made-up sentences with one character put into a toxic word, as a part of all toxic sentences
_STEPS = [(a, b) for a in range(1, _SPAN) for b in range(1, _SPAN + 1 - a)]


def _fold() -> np.ndarray:
    """Byte to symbol: letters 1-26 in either case, look-alike digits as letters, other characters 27-31, 0 dropped."""
    t = np.zeros(256, np.uint8)
    for i in range(26):
        t[65 + i] = t[97 + i] = i + 1
    for digit, letter in zip(b"013457@$", b"oieastas", strict=True):
        t[digit] = letter - 96
    for b in range(0x80, 0xC0):
        t[b] = 27 + b % 5
    return t


_FOLD = _fold()
_SOLID = np.ones(256, np.uint8)
_SOLID[list(tk.ASCII_SPACE)] = 0


def _spell(symbols: np.ndarray) -> str:
    """A string that folds to these symbols."""
    return "".join(chr(96 + c) if c < 27 else "àáâãä"[c - 27] for c in symbols.tolist())


@dataclass
class Words:
    """Folded words of a chunk: symbols with a start mark, and the sentence and document of each word."""

    symbols: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    sentence: np.ndarray
    document: np.ndarray


def fold(buf: np.ndarray, off: np.ndarray) -> Words:
    """Words with signs inside them dropped; runs of single characters are read as one word."""
    solid = _SOLID[buf]
    s, e, ptr = tk.words(solid, off)
    code = _FOLD[buf]
    count = np.zeros(len(buf) + 1, np.int32)  # one number per byte: narrow ones, since workers share an executor's memory
    np.cumsum(code > 0, dtype=np.int32, out=count[1:])
    size = (count[e] - count[s]).astype(np.int64)
    del count
    doc = tk.doc_of(ptr)
    line = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(buf == 10, dtype=np.int32, out=line[1:])
    closes = np.isin(buf[e - 1], np.frombuffer(b".!?", np.uint8)) if len(e) else np.zeros(0, bool)
    cut = np.ones(len(s), bool)
    if len(s):
        cut[1:] = (doc[1:] != doc[:-1]) | (line[s[1:]] != line[s[:-1]]) | (closes[:-1] & (size[:-1] != 1))
    del line
    sentence = np.cumsum(cut) - 1
    keep = size > 0
    s, size, doc, sentence = s[keep], size[keep], doc[keep], sentence[keep]
    joins = np.zeros(len(s), bool)
    if len(s):
        joins[1:] = (size[1:] == 1) & (size[:-1] == 1) & (sentence[1:] == sentence[:-1])
    first = np.flatnonzero(~joins)
    total = np.add.reduceat(size, first) if len(first) else size
    # One start mark in front of each word.
    begin = np.cumsum(total + 1) - (total + 1)
    symbols = np.empty(int((total + 1).sum()), np.uint8)
    mark = np.zeros(len(symbols), bool)
    mark[begin] = True
    symbols[mark] = _START
    symbols[~mark] = code[code > 0]
    return Words(symbols, begin, begin + total + 1, sentence[first], doc[first])


def _entries(symbols: np.ndarray, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For every pair of steps: where the subsequences begin, their codes, and their weight."""
    c = symbols.astype(np.int64)
    for a, b in _STEPS:
        if len(c) <= a + b:
            continue
        at = np.flatnonzero(word[:-(a + b)] == word[a + b:])
        yield at, (c[at] * _SYMBOLS + c[at + a]) * _SYMBOLS + c[at + a + b], _DECAY ** (a + b - 2)


def _grouped(symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ks, ws = [np.zeros(0, np.int64)], [np.zeros(0)]
    for at, code, weight in _entries(symbols, word):
        ks.append(word[at] * _SYMBOLS ** 3 + code)
        ws.append(np.full(len(at), weight))
    key, w = np.concatenate(ks), np.concatenate(ws)
    order = np.argsort(key)
    key, w = key[order], w[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    w = np.add.reduceat(w, first) if len(first) else w
    return key[first] // _SYMBOLS ** 3, key[first] % _SYMBOLS ** 3, w


def features(symbols: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, code and unit-length weight of every distinct subsequence of n words."""
    of, code, w = _grouped(symbols, word)
    return of, code, w / np.sqrt(np.bincount(of, w * w, n))[of] if len(of) else w


def _norms(symbols: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    of, _, w = _grouped(symbols, word)
    return np.sqrt(np.maximum(np.bincount(of, w * w, n), 1e-9))


def _symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.concatenate([[_START], x[x > 0]]) for x in (_FOLD[np.frombuffer(w.encode(), np.uint8)] for w in words)]
    return (np.concatenate(parts).astype(np.uint8) if parts else np.zeros(0, np.uint8),
            np.repeat(np.arange(len(parts)), [len(p) for p in parts]))


def similarity(words: list[str], others: list[str]) -> np.ndarray:
    """Kernel matrix of two lists of words."""
    rows = np.zeros((len(others), _SYMBOLS ** 3), np.float32)
    of, code, w = features(*_symbols(others), len(others))
    rows[of, code] = w
    out = np.zeros((len(words), len(others)), np.float32)
    of, code, w = features(*_symbols(words), len(words))
    np.add.at(out, of, (rows[:, code] * w.astype(np.float32)).T)
    return out


class Landmarks:
    """Similarity of words to landmark words.

    Landmarks are kept as an inverted table from subsequence to landmark, so a
    word meets only the landmarks that share one with it.
    """

    def __init__(self, words: list[str]):
        self.words = words
        of, code, w = features(*_symbols(words), len(words))
        order = np.argsort(code, kind="stable")
        self.mark, self.weight = of[order], w[order]
        self.count = np.bincount(code, minlength=_SYMBOLS ** 3)
        self.first = np.cumsum(self.count) - self.count

    def __call__(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = _BLOCK_WORDS) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words that resemble a landmark, and their similarities above the floor (0 to 1)."""
        parts = [self._block(symbols, starts[a:a + block], ends[a:a + block]) for a in range(0, len(starts), block)]
        near = [n + i * block for i, (n, _) in enumerate(parts)]
        if not parts:
            return np.zeros(0, np.int64), np.zeros((0, len(self.words)), np.float32)
        return np.concatenate(near), np.concatenate([s for _, s in parts])

    def _block(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, m = len(starts), len(self.words)
        size = ends - starts
        word = np.repeat(np.arange(n), size)
        flat = symbols[np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(len(word))]
        cells, values, least = [], [], np.zeros(n)
        for at, code, weight in _entries(flat, word):
            least += np.bincount(word[at], minlength=n) * weight ** 2
            times = self.count[code]
            some = times > 0
            at, code, times = at[some], code[some], times[some]
            end = np.cumsum(times)
            pick = np.repeat(self.first[code] - (end - times), times) + np.arange(end[-1] if len(end) else 0)
            cells.append(np.repeat(word[at], times) * m + self.mark[pick])
            values.append(self.weight[pick] * weight)
        dot = np.bincount(np.concatenate(cells), np.concatenate(values), n * m).reshape(n, m) if cells else np.zeros((n, m))
        # The norm is at least the root of ``least``; it is worked out for words that could pass the floor.
        pick = dot.max(1) >= _FLOOR * np.sqrt(np.maximum(least, 1e-9))
        near = np.flatnonzero(pick)
        held = pick[word]
        out = dot[near] / _norms(flat[held], (np.cumsum(pick) - 1)[word[held]], len(near))[:, None]
        out = np.maximum(out - _FLOOR, 0) / (1 - _FLOOR)
        some = out.max(1) > 0 if len(near) else np.zeros(0, bool)
        return near[some], out[some].astype(np.float32)


def sentence_features(words: Words, marks: Landmarks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, and best similarity to each landmark, of every sentence with a word that resembles one."""
    h = tk.hash_spans(words.symbols, words.starts, words.ends)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    near, sim = marks(words.symbols, words.starts[first], words.ends[first])
    slot = np.full(len(first), -1)
    slot[near] = np.arange(len(near))
    slot = slot[inverse.ravel()] if len(first) else slot
    at = np.flatnonzero(slot >= 0)
    sentence, start = np.unique(words.sentence[at], return_index=True)
    out = np.maximum.reduceat(sim[slot[at]], start, axis=0) if len(at) else np.zeros((0, len(marks.words)), np.float32)
    return words.document[at][start], out, sentence


@dataclass
class Model:
    """A fitted machine; ``margin`` is linear in the Nystrom coordinates."""

    landmarks: list[str]
    nystrom: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return x @ (self.nystrom @ self.weight) + self.bias

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * margin + self.shift)))


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-5, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Linear machine of squared hinge loss, by Newton steps over the rows inside the margin."""
    weight = weight / weight.sum()
    n = x.shape[1]
    ridge = np.full(n + 1, penalty)
    ridge[-1] = 1e-9
    w = np.zeros(n + 1)
    inside = np.ones(len(x), bool)
    for _ in range(rounds):
        gram, target = np.diag(ridge), np.zeros(n + 1)
        for a in range(0, len(x), 10_000):  # small pieces in double precision
            at = a + np.flatnonzero(inside[a:a + 10_000])
            rows = np.hstack([x[at].astype(float), np.ones((len(at), 1))])
            held = rows * weight[at, None]
            gram += held.T @ rows
            target += held.T @ y[at]
        w = np.linalg.solve(gram, target)
        now = y * (x @ w[:-1].astype(x.dtype) + w[-1]) < 1
        if (now == inside).all():
            break
        inside = now
    return w[:-1], float(w[-1])


def _calibrate(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic slope and shift for document labels, with smoothed targets; ``weight``: how many documents of the table each stands for."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        r, h = weight * (p * (1 - p) + 1e-9), weight * (p - target)
        g = np.array([(h * margin).sum() + 1e-3 * a, h.sum()])
        m = np.array([[(r * margin * margin).sum() + 1e-3, (r * margin).sum()], [(r * margin).sum(), r.sum()]])
        da, db = np.linalg.solve(m, g)
        a, b = a - float(np.clip(da, -2, 2)), b - float(np.clip(db, -2, 2))
    return a, b


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folded words of each chunk with the numbers of toxic and other documents that hold them."""
    for chunk in tk.chunks(batches, "text"):
        words = fold(*tk.text_buffer(chunk["text"]))
        h = tk.hash_spans(words.symbols, words.starts, words.ends)
        label = chunk["label"].to_numpy()
        _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        pair = np.unique(inverse.ravel() * np.int64(len(label) + 1) + words.document)
        w, d = pair // (len(label) + 1), pair % (len(label) + 1)
        toxic = np.bincount(w, label[d], len(first)).astype(np.int64)
        n = np.bincount(w, minlength=len(first))
        out = [_spell(words.symbols[a + 1:b]) for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(toxic), pa.array(n - toxic)], ["word", "toxic", "clean"])


def _choose(rows: list, usual: list, number: int) -> list[str]:
    """Landmarks: the words most tied to the label, unlike each other, and a few usual words."""
    out: list[str] = []
    for w in [r["word"] for r in rows]:
        if len(out) >= number * 3 // 4:
            break
        if not out or similarity([w], out).max() < 0.85:
            out.append(w)
    return out + [r["word"] for r in usual if r["word"] not in out][:number - len(out)]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        landmarks: int = LANDMARKS, max_documents: int = MAX_DOCUMENTS) -> Model:
    """Learn from all rows of ``docs`` that ``labels`` marks 0 or 1; other labels and null ids are ignored.

    At most ``max_documents`` documents of each class are fitted; the choice
    of landmarks covers all.  Without both classes the model scores every text
    with the share of toxic labels.
    """
    prepare(docs.sparkSession)
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)").dropDuplicates(["id"])
    # Labels grow with the documents, so neither side is broadcast at any size.
    known = stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).hint("merge").join(marked, "id"))
    tally = {r["label"]: r for r in known.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")).collect()}
    n1, n0 = (tally[label]["n"] if label in tally else 0 for label in (1, 0))
    if not n1 or not n0:
        share = (n1 + 1) / (n1 + n0 + 2)
        return Model([], np.zeros((0, 0)), np.zeros(0), 0.0, 1.0, float(np.log(share / (1 - share))))
    counts = known.select("text", "label").mapInArrow(_vocabulary, "word string, toxic long, clean long").where(
        F.length("word") > 2).groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    lift = F.log((F.col("toxic") + 0.5) / n1) - F.log((F.col("clean") + 0.5) / n0)
    tied = counts.where(F.col("toxic") >= 2).withColumn("tie", F.col("toxic") * lift).where(lift > 1).orderBy(
        F.desc("tie"), "word").limit(6 * landmarks).collect()
    usual = counts.orderBy(F.desc("clean"), "word").limit(2 * landmarks).collect()
    words = _choose(tied, usual, landmarks)
    marks = docs.sparkSession.sparkContext.broadcast(Landmarks(words))
    ids = [known.where(F.col("label") == label).select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(max_documents)
           for label in (0, 1)]
    sample = known.join(F.broadcast(ids[0].union(ids[1])), "id", "left_semi")  # twice max_documents ids at most

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tk.chunks(batches, "text", 2 << 20):
            doc, x, _ = sentence_features(fold(*tk.text_buffer(chunk["text"])), marks.value)
            blank = np.setdiff1d(np.arange(chunk.num_rows), doc)  # one empty sentence for the others
            doc = np.concatenate([doc, blank])
            body = [r.tobytes() for r in x] + [b""] * len(blank)
            ids = chunk["id"].combine_chunks().cast(pa.string()).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([ids, chunk["label"].combine_chunks().take(pa.array(doc)), pa.array(body, pa.binary())],
                                             ["id", "label", "x"])

    rows = sample.mapInArrow(describe, "id string, label int, x binary").toArrow().sort_by([("id", "ascending"), ("x", "ascending")])
    y = rows["label"].to_numpy()
    body, off = tk.text_buffer(rows["x"])
    doc = pa.compute.rank(rows["id"], tiebreaker="dense").to_numpy().astype(np.int64) - 1
    x = np.zeros((len(y), len(words)), np.float32)
    x[np.diff(off) > 0] = body.view(np.float32).reshape(-1, len(words))
    del rows, body
    k = np.maximum(similarity(words, words) - _FLOOR, 0) / (1 - _FLOOR)
    value, vector = np.linalg.eigh((k + k.T) / 2)
    keep = value > 1e-3
    nystrom = (vector[:, keep] / np.sqrt(value[keep])).astype(np.float32)
    near = [t for t in words[:landmarks * 3 // 4] if 5 <= len(t)][:landmarks // 4]
    gapped = np.maximum(similarity([t[:i] + "x" + t[i:] for t in near for i in range(1, len(t))], words) - _FLOOR, 0) / (1 - _FLOOR) @ nystrom
    z = np.empty((len(x) + len(gapped) + 1, nystrom.shape[1]), np.float32)  # made-up sentences follow; the last has no sign
    for a in range(0, len(x), 10_000):
        z[a:min(a + 10_000, len(x))] = x[a:a + 10_000] @ nystrom
    z[len(x):-1], z[-1] = gapped, 0
    del x
    target = np.concatenate([np.where(y == 1, 1.0, -1.0), np.ones(len(gapped)), [-1.0]])
    weight = np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
    active = np.ones(len(y))
    for _ in range(2):  # the second time, only those sentences of toxic documents that the machine itself finds toxic
        now = weight * active
        made = np.append(np.full(len(gapped), _GAPPED * now[y == 1].sum() / max(1, len(gapped))), _GAPPED * now[y == 0].sum())
        w, b = _machine(z, target, np.concatenate([now, made]))
        margin = z[:len(y)] @ w.astype(np.float32) + b
        active = ((y == 0) | (margin > 0)).astype(float)
    best = np.full(doc.max() + 1, b)
    np.maximum.at(best, doc, margin)
    label = np.zeros(len(best), int)
    label[doc] = y
    stands = np.array([tally[c]["ids"] / max(1, (label == c).sum()) for c in (0, 1)])  # the sample's classes are thinned unequally
    return Model(words, nystrom, w, b, *_calibrate(best, label, stands[label]))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add ``score``, 0 to 1.  Null and empty texts get the score of a text without any sign of toxicity.

    Rows are independent: repeated rows repeat their score, an empty table
    gives an empty result, and an input column of that name is replaced.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.select([c for c in docs.columns if c.lower() != score_col.lower()])
    held = spark.sparkContext.broadcast((model, Landmarks(model.landmarks)))
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, marks = held.value
        for chunk in tk.chunks(batches, text_col, 2 << 20):
            margin = np.full(chunk.num_rows, model.bias)
            if marks.words:
                doc, x, _ = sentence_features(fold(*tk.text_buffer(chunk[text_col])), marks)
                np.maximum.at(margin, doc, model.margin(x))
            chunk = chunk.combine_chunks()
            cols = [c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) for c in chunk.columns]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(model.probability(margin))], schema.names)

    return docs.mapInArrow(run, schema)


def fold_model(spark: SparkSession, sf_dir: str) -> Model:
    """The model of the labelled rows outside the held-out third."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where(crc_part("doc_id", 3) != 1)
    return fit(docs, table(spark, sf_dir, "labels"))


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels of the held-out third are not seen."""
    model = fold_model(spark, sf_dir)
    scored = score(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(crc_part("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
