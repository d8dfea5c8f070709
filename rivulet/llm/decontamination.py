"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of consecutive benchmark words.  Patterns of one length
share three tables: a shift table by word block (how far the search may jump
without missing a pattern that ends later), a bucket of patterns for each
suffix block, and the patterns' own words for the direct comparison.  Each
task scans its documents with many search positions at once, every position
jumping by its own shift.

The scan needs no shuffle: documents stay where they were read.  The tables
are broadcast in shards of at most ``shard_bytes`` of benchmark text; a larger
benchmark is searched shard after shard in the same pass over the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm import textkit as tk
from rivulet.llm.catalog import query
from rivulet.llm.common import prepare, spare, sql_words, table

# A word is a run of ASCII digits, ASCII letters (lower-cased) and all non-ASCII characters.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
WINDOW = 10
SHARD_BYTES = 32 << 20
_STRIDE = 256  # positions of one search lane
_TABLE_BITS = 20


class Patterns:
    """Wu-Manber tables of all windows of one length."""

    def __init__(self, length: int, codes: np.ndarray, items: np.ndarray):
        """codes: (k, length) word hashes; items: (k,) index of the benchmark item."""
        self.length = length
        self.block = min(2, length)
        key = tk.sequence_hash(codes.ravel(), np.arange(len(codes)) * length, length)
        order = np.lexsort((items, key))
        self.key, self.items = key[order], items[order]
        self.unique, first = np.unique(self.key, return_index=True)
        self.first = np.append(first, len(self.key))
        self.codes = codes[order][first]
        self.shift = np.full(1 << _TABLE_BITS, length - self.block + 1, np.uint8)
        for end in range(self.block, length + 1):
            slot = self._slot(self.codes[:, end - self.block: end])
            np.minimum.at(self.shift, slot, np.uint8(length - end))
        suffix = self._slot(self.codes[:, length - self.block:])
        self.bucket_order = np.argsort(suffix, kind="stable")
        self.bucket_slot = suffix[self.bucket_order]

    def _slot(self, block: np.ndarray) -> np.ndarray:
        h = block[:, -1].copy()
        if self.block == 2:
            h += block[:, 0] * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def search(self, word: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word of every occurrence and the index of its pattern."""
        m, n = self.length, np.diff(ptr)
        lanes = np.maximum(-(-(n - m + 1) // _STRIDE), 0)
        doc = np.repeat(np.arange(len(n)), lanes)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        pos = ptr[doc] + k * _STRIDE + m - 1  # last word of the window under test
        end = np.minimum(ptr[doc] + (k + 1) * _STRIDE + m - 1, ptr[doc + 1])
        found = []
        while len(pos):
            h = word[pos].copy()
            if self.block == 2:
                h += word[pos - 1] * np.uint64(0x9E3779B97F4A7C15)
            jump = self.shift[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)].astype(np.int64)
            if (stop := jump == 0).any():
                found.append(pos[stop])
            pos = pos + np.maximum(jump, 1)
            live = pos < end
            pos, end = pos[live], end[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return self._confirm(word, np.sort(np.concatenate(found)))

    def _confirm(self, word: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Compare each stop with every pattern in the bucket of its suffix block, word by word."""
        m = self.length
        slot = self._slot(np.stack([word[last - self.block + 1 + j] for j in range(self.block)], 1))
        lo = np.searchsorted(self.bucket_slot, slot, "left")
        size = np.searchsorted(self.bucket_slot, slot, "right") - lo
        where = np.repeat(np.arange(len(last)), size)
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        pattern = self.bucket_order[lo[where] + inside]
        for j in range(m):  # words left to right; most candidates fall at the first
            same = word[last[where] - m + 1 + j] == self.codes[pattern, j]
            where, pattern = where[same], pattern[same]
        return last[where] - m + 1, pattern

    def items_of(self, pattern: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, item) of each occurrence; one window may come from several items."""
        pair = np.unique(np.stack([doc, pattern], 1), axis=0) if len(doc) else np.zeros((0, 2), np.int64)
        size = self.first[pair[:, 1] + 1] - self.first[pair[:, 1]]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.repeat(pair[:, 0], size), self.items[np.repeat(self.first[pair[:, 1]], size) + inside]


def compile_patterns(texts: list[str | None], window: int) -> list[Patterns]:
    """Tables for the windows of ``texts``, one per window length."""
    buf, off = tk.text_buffer(pa.array(texts, pa.string()))
    norm = tk.lower_table(SEPARATORS)[buf]
    s, e, ptr = tk.words(norm, off)
    h = tk.hash_spans(norm, s, e)
    out = []
    n = np.diff(ptr)
    for k in range(1, window + 1):
        if k == window:
            first, item = tk.windows(ptr, window)
        else:
            item = np.flatnonzero(n == k)
            first = ptr[item]
        if len(first):
            out.append(Patterns(k, h[first[:, None] + np.arange(k)], item))
    return out


def _digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def _shards(bench: DataFrame, item_col: str, text_col: str, shard_bytes: int) -> Iterator[tuple[bool, list]]:
    """Benchmark rows in lists of about ``shard_bytes`` of text, one list in memory at a time; whether it is the last."""
    size = bench.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(1, -(-size // shard_bytes))
    part = F.pmod(F.xxhash64(F.col(item_col).cast("string"), F.col(text_col)), F.lit(n))
    for k in range(n):
        yield k == n - 1, bench.select(F.col(item_col).cast("string"), text_col).where(part == k).collect()


def decontaminate(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  bench_text: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES,
                  keep: list[str] | None = None) -> DataFrame:
    """Mark document words that lie inside an occurrence of a benchmark window.

    Adds ``n_words``, ``n_hit``, ``n_items``, ``items`` (sorted item ids as
    text), ``spans`` (hit word ranges, end exclusive) and ``contaminated``.
    Null and empty texts have no words; benchmark rows with null or wordless
    text have no window; a null item id counts as the text ``null``.  Rows are
    independent, so repeated rows repeat their result; an empty table gives an
    empty result.  Input columns with the added names are replaced; ``keep``
    names the input columns to return (all by default).
    """
    spark = prepare(docs.sparkSession)
    added = {"n_words": "long", "n_hit": "long", "n_items": "long", "items": "array<string>",
             "spans": "array<struct<first:long,end:long>>", "contaminated": "boolean"}
    docs = docs.select([c for c in docs.columns if c.lower() not in added])
    out = docs.withColumns({k: F.lit(None).cast(v) for k, v in added.items()})
    whole, wanted = out.schema, [*(docs.columns if keep is None else keep), *added]
    for last, rows in _shards(bench, item_col, bench_text, shard_bytes):
        schema = T.StructType([whole[c] for c in wanted]) if last else whole
        names = [r[0] if r[0] is not None else "null" for r in rows]
        tables = spark.sparkContext.broadcast((names, compile_patterns([r[1] for r in rows], window)))

        def scan(batches, tables=tables, schema=schema):
            names, patterns = tables.value
            lower = tk.lower_table(SEPARATORS)
            for chunk in tk.chunks(batches, text_col):
                buf, off = tk.text_buffer(chunk[text_col])
                norm = lower[buf]
                s, e, ptr = tk.words(norm, off)
                h = tk.hash_spans(norm, s, e)
                step = np.zeros(len(s) + 1, np.int32)
                before_items = chunk["items"].to_pylist()
                pairs = [(d, x) for d, xs in enumerate(before_items) for x in xs or ()]
                for d, xs in enumerate(chunk["spans"].to_pylist()):
                    for x in xs or ():
                        step[ptr[d] + x["first"]] += 1
                        step[ptr[d] + x["end"]] -= 1
                for p in patterns:
                    first, which = p.search(h, ptr)
                    np.add.at(step, first, 1)
                    np.add.at(step, first + p.length, -1)
                    d, item = p.items_of(which, np.searchsorted(ptr, first, side="right") - 1)
                    pairs += [(a, names[b]) for a, b in zip(d.tolist(), item.tolist(), strict=True)]
                yield _result(chunk, schema, ptr, step, pairs)

        out = out.mapInArrow(scan, schema)
    return out


def _result(chunk: pa.Table, schema: T.StructType, ptr: np.ndarray, step: np.ndarray,
            pairs: list[tuple[int, str]]) -> pa.RecordBatch:
    n = len(ptr) - 1
    hit = np.cumsum(step)[:-1] > 0
    run = np.zeros(len(hit) + 1, np.int64)
    np.cumsum(hit, out=run[1:])
    items: list[list[str]] = [[] for _ in range(n)]
    for d, x in sorted(set(pairs)):
        items[d].append(x)
    edge = np.zeros(len(hit) + 1, bool)
    if len(hit):
        edge[:-1] = hit
    before = np.zeros(len(hit) + 1, bool)
    before[1:] = hit
    cut = np.zeros(len(hit) + 1, bool)
    cut[ptr[1:-1]] = True
    starts = np.flatnonzero(edge & (~before | cut))
    after = np.zeros(len(hit) + 1, bool)
    after[:-1] = hit
    stops = np.flatnonzero(before & (~after | cut))
    spans: list[list[dict]] = [[] for _ in range(n)]
    for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
        d = int(np.searchsorted(ptr, a, side="right")) - 1
        spans[d].append({"first": a - int(ptr[d]), "end": b - int(ptr[d])})
    n_hit = run[ptr[1:]] - run[ptr[:-1]]
    new = {"n_words": pa.array(np.diff(ptr)), "n_hit": pa.array(n_hit), "n_items": pa.array([len(x) for x in items], pa.int64()),
           "items": pa.array(items, pa.list_(pa.string())),
           "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
           "contaminated": pa.array(n_hit > 0)}
    chunk = chunk.combine_chunks()
    arrays = [new[f] if f in new else _one(chunk[f]) for f in schema.names]
    return pa.RecordBatch.from_arrays(arrays, schema.names)


def _one(col: pa.ChunkedArray) -> pa.Array:
    return col.chunk(0) if col.num_chunks == 1 else pa.concat_arrays(col.chunks)


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
_SQL = f"""
WITH d AS (SELECT doc_id, {sql_words('text', _WORD)} AS w FROM documents),
b AS (SELECT item_id, {sql_words('text', _WORD)} AS w FROM benchmark),
win AS (SELECT item_id, w, least(len(w), {WINDOW}) AS k, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM win),
sizes AS (SELECT DISTINCT k FROM p),
spots AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k),
hit AS (SELECT a.doc_id, a.i, a.k, p.item_id FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM spots) a
  JOIN p ON a.k = p.k AND a.g = p.g),
cov AS (SELECT doc_id, count(DISTINCT i + x) AS n FROM hit, (SELECT unnest(range(0, {WINDOW})) AS x) WHERE x < k GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS s FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(cov.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
  sha256(coalesce(its.s, '')) AS items_sha256, coalesce(cov.n, 0) > 0 AS contaminated
FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN its ON d.doc_id = its.doc_id"""


@query("op10_decontamination", _SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of every document, with a digest of the items found."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    (joined,) = spare(docs, "joined")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.withColumn(joined, F.array_join(F.array_sort("items"), ",")).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.col(joined), 256).alias("items_sha256"), "contaminated")
