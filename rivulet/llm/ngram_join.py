"""N-gram Jaccard join by T-occurrence search (DivideSkip).

Two documents link when their sets of word shingles have a Jaccard similarity
of at least ``percent`` / 100.  A set of n shingles can only link with a set no
smaller than itself if both share T = ceil(n * 2p / (100 + p)) shingles.
DivideSkip takes a query's inverted lists, merges the short ones and counts how
often each document occurs there, and probes the long ones by binary search for
the few documents that can still reach T.

The work is spread as follows.

1. Each task turns its documents into sets, collapses equal sets, and deals
   packed postings out by shingle range.  A shingle that many documents of the
   task share is sent once, with a count.
2. Each range counts its shingles and returns only those of two or more sets,
   with their frequency class; the others can never match.  This leaves a small
   part of the postings, which from here on stand for the sets.
3. With shingles ordered by frequency, two sets that link share one within the
   first n - ceil(n p / 100) + 1 of both (the DivideSkip split with T - 1 long
   lists).  Sets that share such a shingle and whose sizes permit a link are
   chained, and the components of these chains bound where links can be.
4. Each bounded component is searched by DivideSkip in one task; a component
   beyond ``group_postings`` is cut into tiles and every pair of tiles is a
   task.  A pair that is already connected need not be counted again, so a task
   returns a spanning forest instead of all links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import textkit as tk
from rivulet.llm.catalog import query
from rivulet.llm.common import partitions, prepare, sql_words, stored, table
from rivulet.llm.components import components

SHINGLE = 5
PERCENT = 80
GROUP_POSTINGS = 4_000_000
_LOWER = tk.lower_table(tk.ASCII_SPACE)
_SHARED = 0xFFFF  # document index of a posting that stands for several documents of its chunk
_SPREAD = 8  # documents of a chunk from which a shingle is sent once with a count
_HIT, _LOCAL, _META = 0, 1, 2

_POSTINGS = "part long, chunk long, kind int, body binary"
_SETS = "ids array<long>, fp binary, n long, k long, shingle binary, class binary"


def _pack(*arrays: np.ndarray) -> bytes:
    return len(arrays[0]).to_bytes(8, "little") + b"".join(a.tobytes() for a in arrays)


def _unpack(body: bytes, *types) -> list[np.ndarray]:
    n, at, out = int.from_bytes(body[:8], "little"), 8, []
    for t in types:
        out.append(np.frombuffer(body, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def _set_sizes(h: np.ndarray, d: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and 128-bit fingerprint of each document's set, from its distinct shingles."""
    order = np.argsort(d.astype(np.uint16), kind="stable")
    n = np.bincount(d, minlength=n_docs)
    run = np.zeros((2, len(h) + 1), np.uint64)
    np.cumsum(tk.mix64(h[order]), out=run[0, 1:])
    np.cumsum(tk.mix64(h[order] ^ np.uint64(0x5851F42D4C957F2D)), out=run[1, 1:])
    at = np.concatenate([[0], np.cumsum(n)])
    return n, run[0, at[1:]] - run[0, at[:-1]], run[1, at[1:]] - run[1, at[:-1]]


def _extract(bits: int, length: int):
    """Postings of each chunk of documents by shingle range, and the chunk's sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task = TaskContext.get().partitionId() << 32
        for number, chunk in enumerate(tk.chunks(batches, "text")):
            name = task + number
            buf, off = tk.text_buffer(chunk["text"])
            norm = _LOWER[buf]
            s, e, ptr = tk.words(norm, off)
            h, d = tk.shingles(tk.hash_spans(norm, s, e), ptr, length)
            h &= np.uint64(((1 << bits) - 1) << (64 - bits) | ((1 << 48) - 1))  # the range number and six bytes are sent
            order = np.argsort(h, kind="stable")
            h, d = h[order], d[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            h, d = h[new], d[new]
            n, f1, f2 = _set_sizes(h, d, len(off) - 1)
            key = np.stack([f1, f2, n.astype(np.uint64)], 1)
            _, first, same = np.unique(key, axis=0, return_index=True, return_inverse=True)
            first[same.ravel()[n == 0]] = -1  # empty documents are never the same set
            own = first[same.ravel()]
            own = np.where(own < 0, np.arange(len(n)), own)
            keep = own[d] == d  # one document stands for its copies
            h, d = h[keep], d[keep].astype(np.uint16)
            edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]])) if len(h) else np.zeros(1, np.int64)
            size = np.diff(edge)
            many = np.repeat(size >= _SPREAD, size)
            lh, ld = h[many], d[many]
            one = ~many
            one[edge[:-1][size >= _SPREAD]] = True
            count = np.ones(len(h), np.uint16)
            count[edge[:-1]] = np.where(size >= _SPREAD, size, 1)
            d = np.where(many, _SHARED, d).astype(np.uint16)
            h, d, count = h[one], d[one], count[one]
            part = (h >> np.uint64(64 - bits)).astype(np.int64)
            cut = np.searchsorted(part, np.arange((1 << bits) + 1))
            ids = chunk["doc_id"].combine_chunks().cast(pa.int64())
            valid = np.asarray(ids.is_valid())
            rows = [(p, _HIT, h[a:b], d[a:b], count[a:b])
                    for p, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if b > a]
            parts = [r[0] for r in rows]
            bodies = [len(x).to_bytes(8, "little") + np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
                      + y.tobytes() + _sparse(c) for _, _, x, y, c in rows]
            home = hash((name, 1)) % (1 << bits)
            meta = _pack(np.asarray(ids.fill_null(0)), valid, own.astype(np.int64), n.astype(np.int64), f1, f2)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*parts, home, home], pa.int64()), pa.array([name] * (len(parts) + 2), pa.int64()),
                 pa.array([_HIT] * len(parts) + [_LOCAL, _META], pa.int32()), pa.array([*bodies, _pack(lh, ld), meta], pa.binary())],
                ["part", "chunk", "kind", "body"])
    return run


def _sparse(count: np.ndarray) -> bytes:
    at = np.flatnonzero(count > 1)
    return _pack(at.astype(np.int64), count[at])


def _frequent(bits: int):
    """Of each shingle range, the postings of shingles that two or more sets have, with their frequency class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in tk.groups(batches, ["part"]):
            part = group["part"][0].as_py()
            names, kinds, bodies = group["chunk"].to_pylist(), group["kind"].to_pylist(), group["body"]
            out = [(c, k, b.as_py()) for c, k, b in zip(names, kinds, bodies, strict=True) if k != _HIT]
            hs, ds, ws, cs = [], [], [], []
            for c, k, b in zip(names, kinds, bodies, strict=True):
                if k == _HIT:
                    body = b.as_py()
                    n = int.from_bytes(body[:8], "little")
                    wide = np.zeros((n, 8), np.uint8)
                    wide[:, :6] = np.frombuffer(body, np.uint8, 6 * n, 8).reshape(n, 6)
                    w = np.ones(n, np.int64)
                    at, count = _unpack(body[8 + 8 * n:], np.int64, np.uint16)
                    w[at] = count
                    hs.append(wide.reshape(-1).view(np.uint64))
                    ds.append(np.frombuffer(body, np.uint16, n, 8 + 6 * n))
                    ws.append(w)
                    cs.append(np.full(n, c))
            if hs:
                h, d, w, c = map(np.concatenate, (hs, ds, ws, cs))
                del hs, ds, ws, cs
                order = np.argsort(h, kind="stable")
                h, d, w, c = h[order], d[order], w[order], c[order]
                edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
                df = np.add.reduceat(w, edge[:-1])
                df = np.repeat(df, np.diff(edge))
                h, d, c, df = (x[df > 1] for x in (h, d, c, df))
                rank = np.minimum(255, 8 * np.log2(df)).astype(np.uint8)
                order = np.argsort(c, kind="stable")
                h, d, c, rank = h[order], d[order], c[order], rank[order]
                cut = [0, *(np.flatnonzero(c[1:] != c[:-1]) + 1).tolist(), len(c)] if len(c) else []
                top = np.uint64(part << (64 - bits))
                for a, b in zip(cut, cut[1:], strict=False):
                    out.append((int(c[a]), _HIT, _pack(h[a:b] | top, d[a:b], rank[a:b])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(out), pa.int64()), pa.array([x[0] for x in out], pa.int64()),
                 pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())],
                ["part", "chunk", "kind", "body"])
    return run


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk, its distinct sets: ids of the documents, size, and shared shingles by class and value."""
    for group in tk.groups(batches, ["chunk"]):
        hs, ds, rs, local = [], [], [], None
        for k, b in zip(group["kind"].to_pylist(), group["body"], strict=True):
            if k == _HIT:
                h, d, r = _unpack(b.as_py(), np.uint64, np.uint16, np.uint8)
                hs.append(h), ds.append(d), rs.append(r)
            elif k == _LOCAL:
                local = _unpack(b.as_py(), np.uint64, np.uint16)
            else:
                ids, valid, own, n, f1, f2 = _unpack(b.as_py(), np.int64, bool, np.int64, np.int64, np.uint64, np.uint64)
        h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
        d = np.concatenate(ds) if ds else np.zeros(0, np.uint16)
        r = np.concatenate(rs) if rs else np.zeros(0, np.uint8)
        stand = d == _SHARED
        if stand.any():  # give each shared posting back to its documents
            sh, sr = h[stand], r[stand]
            order = np.argsort(sh)
            sh, sr = sh[order], sr[order]
            where = np.searchsorted(sh, local[0])
            h, d, r = (np.concatenate([x[~stand], y]) for x, y in ((h, local[0]), (d, local[1]), (r, sr[where])))
        order = np.lexsort((h, r, d))
        h, d, r = h[order], d[order], r[order]
        at = np.searchsorted(d, np.arange(len(n) + 1))
        members: dict[int, list[int]] = {}
        for i, o in enumerate(own.tolist()):
            members.setdefault(o, []).append(i)
        cols: list[list] = [[], [], [], [], [], []]
        for o, docs in members.items():
            a, b = int(at[o]), int(at[o + 1])
            row = ([int(ids[i]) if valid[i] else None for i in docs], f1[o].tobytes() + f2[o].tobytes(), int(n[o]), b - a,
                   h[a:b].tobytes(), r[a:b].tobytes())
            for col, x in zip(cols, row, strict=True):
                col.append(x)
        for a in range(0, len(cols[0]), 500):
            part = [c[a:a + 500] for c in cols]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[0], pa.list_(pa.int64())), pa.array(part[1], pa.binary()), pa.array(part[2], pa.int64()),
                 pa.array(part[3], pa.int64()), pa.array(part[4], pa.binary()), pa.array(part[5], pa.binary())],
                ["ids", "fp", "n", "k", "shingle", "class"])


def _prefixes(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_h, out_f, out_n = [], [], []
            for fp, n, k, body in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist()
                                        for c in ("fp", "n", "k", "shingle")), strict=True):
                take = n - -(-n * percent // 100) + 1 - (n - k)  # shingles that no other set has come first
                if take > 0:
                    h = np.frombuffer(body, np.int64, min(take, k))
                    out_h.append(h)
                    out_f += [fp] * len(h)
                    out_n.append(np.full(len(h), n))
            if out_f:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out_h)), pa.array(out_f, pa.binary()), pa.array(np.concatenate(out_n))],
                    ["h", "fp", "n"])
    return run


def _chains(percent: int):
    """From (h, n, fp) sorted: each set and the next larger one with the same shingle, if their sizes permit a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            h, n, fp = batch["h"].to_numpy(), batch["n"].to_numpy(), batch["fp"].to_pylist()
            if not len(h):
                continue
            if last is not None:
                h, n, fp = np.append(last[0], h), np.append(last[1], n), [last[2], *fp]
            ok = np.flatnonzero((h[1:] == h[:-1]) & (100 * n[:-1] >= percent * n[1:]))
            pairs = {(fp[i], fp[i + 1]) for i in ok.tolist()}
            last = (h[-1], n[-1], fp[-1])
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()),
                                              pa.array([p[1] for p in pairs], pa.binary())], ["a", "b"])
    return run


class DivideSkip:
    """T-occurrence search among the sets of one group."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, percent: int):
        """sets: distinct shingle codes in frequency order, unshared ones left out; sizes: full sizes."""
        self.percent = percent
        order = np.argsort(sizes, kind="stable")  # a query searches among sets that are not smaller
        self.order = order
        self.sets = [sets[i] for i in order]
        self.n = sizes[order]
        codes, inverse = np.unique(np.concatenate(self.sets), return_inverse=True)
        owner = np.repeat(np.arange(len(self.sets)), [len(s) for s in self.sets])
        by = np.argsort(inverse, kind="stable")  # lists of ascending set numbers
        self.lists = owner[by]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(codes)))])
        at = np.cumsum([0, *(len(s) for s in self.sets)])
        self.codes = [inverse[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        self.sorted = [np.sort(c) for c in self.codes]

    def need(self, n: int, m: np.ndarray) -> np.ndarray:
        """Shared shingles that sets of n and m need: 100 I >= p (n + m - I)."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def forest(self) -> list[tuple[int, int]]:
        """Linked pairs (numbers in the given order) that span the components of all links."""
        label = np.arange(len(self.sets))
        out = []
        for q in range(len(self.sets) - 2, -1, -1):
            for c in self.links(q, label):
                if label[q] != label[c]:
                    label[label == label[c]] = label[q]
                    out.append((int(self.order[q]), int(self.order[c])))
        return out

    def links(self, q: int, label: np.ndarray | None = None) -> Iterator[int]:
        """Sets after ``q`` that link with it; with ``label``, those that already have its label may be left out."""
        codes, n = self.codes[q], int(self.n[q])
        t = int(self.need(n, np.int64(n)))
        if len(codes) < t:
            return
        size = self.start[codes + 1] - self.start[codes]
        by = np.argsort(size, kind="stable")
        longest = max(0, min(t - 1, int(t / (0.05 * math.log2(len(self.sets) + 1) + 1))))  # DivideSkip's choice of L
        short, long = codes[by[:len(by) - longest]], codes[by[len(by) - longest:]]
        merged = np.concatenate([self.lists[self.start[c]:self.start[c + 1]] for c in short.tolist()])
        merged = merged[merged > q]
        if not len(merged):
            return
        if len(merged) > len(self.sets):
            count = np.bincount(merged, minlength=len(self.sets))
            found = np.flatnonzero(count)
            count = count[found]
        else:
            found, count = np.unique(merged, return_counts=True)
        target = self.need(n, self.n[found])
        live = (count >= target - longest) & (100 * n >= self.percent * self.n[found])
        if label is not None:
            live &= label[found] != label[q]
        found, count, target = found[live], count[live], target[live]
        if len(found) <= 8:  # probe the long lists through the few candidates
            for c, have, goal in zip(found.tolist(), count.tolist(), target.tolist(), strict=True):
                if label is not None and label[c] == label[q]:
                    continue
                own = self.sorted[c]
                where = np.minimum(np.searchsorted(own, long), len(own) - 1)
                if have + int((own[where] == long).sum()) >= goal:
                    yield c
            return
        for i, code in enumerate(long.tolist()):
            part = self.lists[self.start[code]:self.start[code + 1]]
            where = np.minimum(np.searchsorted(part, found), len(part) - 1)
            count = count + (part[where] == found)
            live = count + (len(long) - i - 1) >= target
            if not live.all():
                found, count, target = found[live], count[live], target[live]
                if not len(found):
                    return
        yield from found[count >= target].tolist()


def _search(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in tk.groups(batches, ["root", "tile"]):
            if group.num_rows < 2:
                continue
            fp = group["fp"].to_pylist()
            sets = [np.frombuffer(b.as_py(), np.int64) for b in group["shingle"]]
            pairs = DivideSkip(sets, group["n"].to_numpy(), percent).forest()
            yield pa.RecordBatch.from_arrays([pa.array([fp[a] for a, _ in pairs], pa.binary()),
                                              pa.array([fp[b] for _, b in pairs], pa.binary())], ["a", "b"])
    return run


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = SHINGLE) -> DataFrame:
    """Distinct sets of each chunk of documents: ids, fingerprint, size, and the shingles that other sets share."""
    spark = docs.sparkSession
    bits = max(8, min(16, math.ceil(math.log2(2 * partitions(spark)))))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    postings = rows.mapInArrow(_extract(bits, length), _POSTINGS)
    shared = postings.repartition("part").sortWithinPartitions("part").mapInArrow(_frequent(bits), _POSTINGS)
    return shared.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_assemble, _SETS)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = SHINGLE,
                       percent: int = PERCENT, group_postings: int = GROUP_POSTINGS) -> DataFrame:
    """One row per document: id, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    Words are maximal runs of non-blank characters with A-Z lower-cased; fewer
    than ``length`` words are one shingle; a document without words links with
    nothing and is its own component.  Repeated rows are equal documents and
    each gets its row.  A row with a null id takes part as any other, its
    component is the smallest id that is not null, or null if there is none.
    Ids are read as long; text that is no number ends with Spark's cast error.
    Other input columns are ignored.  An empty table gives an empty result.
    """
    spark = prepare(docs.sparkSession)
    sets = stored(shingle_sets(docs, id_col, text_col, length))
    prefix = sets.where("n > 0").select("fp", "n", "k", "shingle").mapInArrow(_prefixes(percent), "h long, fp binary, n long")
    chains = prefix.distinct().repartition("h").sortWithinPartitions("h", "n", "fp").mapInArrow(
        _chains(percent), "a binary, b binary")
    groups = stored(components(chains.distinct()))
    weight = sets.where("n > 0").groupBy("fp").agg(F.first("k").alias("k")).join(groups, F.col("fp") == F.col("node"))
    tiles = weight.groupBy("root").agg(F.sum("k").alias("w")).select(
        "root", F.ceil(F.col("w") * 2 / group_postings).alias("tiles"), (F.col("w") <= group_postings).alias("whole"))
    members = groups.join(tiles.withColumnRenamed("root", "r"), F.col("root") == F.col("r")).select("node", "root", "tiles", "whole")
    distinct = sets.where("n > 0").join(members, F.col("fp") == F.col("node")).dropDuplicates(["fp"])
    mine = F.pmod(F.xxhash64("fp"), F.col("tiles"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda j: F.concat_ws(
        "-", F.least(j, mine).cast("string"), F.greatest(j, mine).cast("string")))
    dealt = distinct.withColumn("tile", F.explode(F.when(F.col("whole"), F.array(F.lit("0"))).otherwise(pairs)))
    links = dealt.select("root", "tile", "fp", "n", "shingle").repartition("root", "tile").sortWithinPartitions(
        "root", "tile").mapInArrow(_search(percent), "a binary, b binary")
    linked = components(links)
    small = sets.select("fp", "n", F.col("ids"), F.array_min("ids").alias("low"))
    named = small.where("n > 0").join(linked, F.col("fp") == F.col("node"), "left").select(
        F.coalesce("root", "fp").alias("root"), "n", "ids", "low")
    named = stored(named)
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id")).withColumnRenamed("root", "r")
    full = named.join(lowest, F.col("root") == F.col("r")).select(F.explode("ids").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    empty = sets.where("n = 0").select(F.explode("ids").alias(id_col), F.col("n").alias("n_shingles")).withColumn("component_id", F.col(id_col))
    return full.union(empty)


_WORD = r"[^\x20\x09-\x0D]"
_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {sql_words('text', _WORD)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pairs JOIN n AS nx ON x = nx.doc_id JOIN n AS ny ON y = ny.doc_id WHERE 100 * i >= {PERCENT} * (nx.n + ny.n - i)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.c FROM reach r JOIN both_ways e ON e.x = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c) AS component_id
FROM reach r LEFT JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id"""


@query("op7_ngram_join", _SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of each document under 5-word shingle similarity of 0.8 or more."""
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
