"""Dense search without a question in the driver, exact and by inverted cells.

* ``scored_tiles``: the corpus lies in tiles and the questions in blocks, both
  of bounded size; a task scores one block against one tile in steps, and a group
  limit per question merges the winners.  Only the tiles a question asks for meet it.
* ``all_products``: the same for sparse rows, by their dot product.  Counts are whole
  numbers: near cosines in single precision tell which pairs are worked out exactly
  (``Counted``), and products are bounded by the lengths of both sides (``Counts``).
* ``build_cells``: k-means cells over unit vectors.  Centroids are fitted on a
  bounded sample, every row is assigned, and a cell keeps its radius: the
  largest distance of a row from the centroid.  A large cell is cut into tiles.
* ``cells_topk``: a question probes the cells nearest to it; how many a wanted
  recall takes is measured by ``probes_for``.  In exact mode it
  then visits every further cell that could still hold one of its best rows:
  for unit vectors, question . row <= question . centroid + radius.

Scores are cosines, 0 where a vector is null, empty or all zeros; ties go to the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.session import cut_lineage

TILE_ROWS = 65_536
BLOCK_ROWS = 16_384
STEP_ROWS = 8192       # of a tile, scored at once
STEP_QUESTIONS = 512   # of a block, scored at once
STEP_PRODUCTS = 2_000_000
TASK_SHARE = 12        # partitions a core, at most three a group, so that groups fall into different ones
FIRST_ROWS = 1024      # longest rows of a tile, which give the first floors
PAIR_PRODUCTS = 400    # cells of a matrix product in the time of one product by itself
COLUMN_PAIRS = 0.1     # products by themselves, a row, in the time that a matrix column takes besides
MATRIX_BUCKETS = 512   # buckets of the questions that are scored as a matrix
MAX_CELLS = 1024
SAMPLE_ROWS = 16_384
MARGIN = 1e-9        # rounding of a bound; too wide only means that a cell more is read
CANDIDATES = "query_id long, chunk_id long, score double"


def as_matrix(col: pd.Series, dim: int | None) -> np.ndarray:
    """Rows of a vector column as a matrix; ``dim`` set: the column holds bucket indexes, which are counted."""
    if dim is None:
        width = max((len(x) for x in col if x is not None), default=0)
        m = np.zeros((len(col), width))
        for i, x in enumerate(col):
            if x is not None and len(x):
                m[i, :len(x)] = x
        return m
    lists = [np.asarray(x if x is not None else [], dtype=np.int64) for x in col]
    m = np.zeros((len(lists), dim))
    if lists:
        np.add.at(m, (np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists)), 1.0)
    return m


def unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` best scores of every row, ties by id: a selection first, then a sort of what it keeps."""
    n = scores.shape[1]
    if n > k:
        rows, cols = np.nonzero(scores >= np.partition(scores, n - k, axis=1)[:, n - k:n - k + 1])
    else:
        rows, cols = (x.ravel() for x in np.indices(scores.shape))
    order = np.lexsort((ids[cols], -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], cols[place < k]


def lists_of(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column in a row, and the length of every list (0 for null)."""
    whole = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    return whole.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(whole), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def matrix_of(values: np.ndarray, row: np.ndarray, lengths: np.ndarray, rows: int, dim: int | None) -> np.ndarray:
    """Lists as rows of a matrix, ``row`` being the row of every value; ``dim`` set: bucket indexes, which are counted."""
    if dim is not None:
        return np.bincount(row * dim + values.astype(np.int64), minlength=rows * dim).reshape(rows, dim).astype(float)
    m = np.zeros((rows, int(lengths.max(initial=0))))
    m[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return m


def places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the few places that are set, by one pass along the whole mask."""
    return np.divmod(np.flatnonzero(mask), max(1, mask.shape[1]))


class Winners:
    """The ``k`` best rows of every question so far; of equal scores the smaller ids."""

    def __init__(self, questions: int, k: int):
        self.k, self.floor, self.n = k, np.full(questions, -np.inf), np.zeros(questions, np.int64)
        self.id, self.score = np.zeros((questions, k), np.int64), np.zeros((questions, k))

    def offer(self, first: int, ids: np.ndarray, scores: np.ndarray, valid: np.ndarray | None = None) -> None:
        """``scores`` of the questions from ``first`` on (rows) for these ids (columns), in the order of their ids; only ``valid`` ones count.

        An equal score comes too late.
        """
        floor = self.floor[first:first + len(scores)]
        if scores.shape[1] > self.k and np.isneginf(floor).any():
            shown = scores if valid is None else np.where(valid, scores, -np.inf)
            at_least = np.partition(shown, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            keep = (scores > floor[:, None]) & (scores >= at_least[:, None])
        else:
            keep = scores > floor[:, None]
        row, col = places(keep if valid is None else keep & valid)
        self.add(row + first, ids[col], scores[row, col])

    def add(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """(question, id, score) rows in any order; only the questions named are sorted again."""
        if not len(row):
            return
        touched = np.unique(row)
        old = np.repeat(touched, self.n[touched])
        place = np.arange(len(old)) - np.searchsorted(old, old)
        rows, at, score = (np.concatenate(x) for x in ((old, row), (self.id[old, place], ids), (self.score[old, place], score)))
        order = np.lexsort((at, -score, rows))
        rows = rows[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        order, rows, place = order[place < self.k], rows[place < self.k], place[place < self.k]
        self.id[rows, place], self.score[rows, place] = at[order], score[order]
        self.n[touched] = np.bincount(np.searchsorted(touched, rows), minlength=len(touched))
        last = place == self.k - 1
        self.floor[rows[last]] = score[order][last]

    def table(self, query_ids: np.ndarray) -> pa.Table:
        row, place = np.nonzero(np.arange(self.k) < self.n[:, None])
        return pa.table({"query_id": pa.array(query_ids[row], pa.int64()), "chunk_id": pa.array(self.id[row, place], pa.int64()),
                         "score": pa.array(self.score[row, place], pa.float64())})


class Counted:
    """Cosines of count vectors: near values in single precision tell which pairs may be among the best, and these are worked out exactly.

    Components are whole numbers, so the products worked out pair by pair are those of a matrix product.
    """

    def __init__(self, asked: np.ndarray):
        self.asked, self.norm = asked, np.sqrt((asked * asked).sum(axis=1))
        self.unit = unit(asked).astype(np.float32)
        # rounding of the sum of the products of two unit vectors, and of the values and limits themselves
        self.slack = (asked.shape[1] + 8) * float(np.finfo(np.float32).eps)

    def offer(self, best: Winners, ids: np.ndarray, m: np.ndarray, one: np.ndarray) -> None:
        """Rows with these ids, in their order; ``one`` is the row of ``m`` that each of them has."""
        norm, rows = np.sqrt((m * m).sum(axis=1)), unit(m).astype(np.float32)
        held = np.empty((STEP_QUESTIONS, len(rows)), np.float32)
        for first in range(0, len(self.asked), STEP_QUESTIONS):
            floor = best.floor[first:first + STEP_QUESTIONS]
            near = np.matmul(self.unit[first:first + STEP_QUESTIONS], rows.T, out=held[:len(floor)])
            if len(rows) < len(ids):
                near = near[:, one]
            limit = floor - self.slack
            if len(ids) > best.k and np.isneginf(floor).any():
                at_least = np.partition(near, len(ids) - best.k, axis=1)[:, len(ids) - best.k]
                limit = np.maximum(limit, at_least - 2 * self.slack)
            limit[(self.norm[first:first + STEP_QUESTIONS] == 0) & (floor >= 0)] = np.inf  # all scores of theirs are 0
            row, col = places(near >= limit.astype(np.float32)[:, None])
            for a in range(0, len(row), STEP_ROWS):
                r, c = row[a:a + STEP_ROWS], col[a:a + STEP_ROWS]
                both = self.norm[first + r] * norm[one[c]]
                dots = np.einsum("ij,ij->i", self.asked[first + r], m[one[c]])
                score = np.divide(dots, both, out=np.zeros(len(r)), where=both > 0)
                better = score > floor[r]
                best.add(first + r[better], ids[c[better]], score[better])


def _score_tile(k: int, dim: int | None, asked_dim: int | None, merged: bool):
    def run(tile: pa.Table, block: pa.Table) -> pa.Table:
        ids, qids = tile["chunk_id"].to_numpy(), block["query_id"].to_numpy()
        best = Winners(len(qids), k)
        if not len(ids) or not len(qids):
            return best.table(qids)
        values, lengths = lists_of(block["vec"])
        asked = matrix_of(values, np.repeat(np.arange(len(qids)), lengths), lengths, len(qids), asked_dim)
        counted = Counted(asked) if dim is not None and dim == asked_dim and merged else None
        values, lengths = lists_of(tile["vec"])
        end = np.cumsum(lengths)
        order = np.argsort(ids, kind="stable")
        sorted_ids = ids[order]
        a = 0
        while a < len(ids):  # bounded steps through the tile; copies of an id stay in one step
            b = min(a + STEP_ROWS, len(ids))
            b = int(np.searchsorted(sorted_ids, sorted_ids[b - 1], side="right")) if merged else b
            take = order[a:b]
            n = lengths[take]
            at = np.repeat(end[take] - n, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            one = np.arange(b - a)
            if merged:
                distinct, one = np.unique(sorted_ids[a:b], return_inverse=True)
                m = matrix_of(values[at], np.repeat(one, n), n, len(distinct), dim)
                if counted:
                    counted.offer(best, sorted_ids[a:b], m, one)
                    a = b
                    continue
            else:
                m = matrix_of(values[at], np.repeat(one, n), n, b - a, dim)
            width = max(m.shape[1], asked.shape[1])
            m, q = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (m, asked))
            m_norm, q_norm = np.sqrt((m * m).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
            for first in range(0, len(qids), STEP_QUESTIONS):
                to = slice(first, first + STEP_QUESTIONS)
                norms = q_norm[to, None] * m_norm[None, :]
                scores = np.divide(q[to] @ m.T, norms, out=np.zeros_like(norms), where=norms > 0)
                best.offer(first, sorted_ids[a:b], scores[:, one] if merged and len(distinct) < b - a else scores)
            a = b
        return best.table(qids)

    return run


class Products:
    """Dot products of some sparse questions with sparse rows: buckets that many questions name by a matrix, the others one by one."""

    def __init__(self, idx: np.ndarray, row: np.ndarray, weight: np.ndarray, questions: int):
        self.idx, self.many = np.unique(idx, return_counts=True)
        self.start = np.cumsum(self.many) - self.many
        order = np.argsort(idx, kind="stable")
        self.row, self.weight, self.questions = row[order], weight[order], questions
        named = np.argsort(-self.many, kind="stable")[:MATRIX_BUCKETS]
        named = named[self.many[named] > max(4, questions // 32)]
        self.column = np.full(len(self.idx), -1)
        self.column[named] = np.arange(len(named))
        at = np.repeat(self.column, self.many)
        self.matrix, self.ones = np.zeros((questions, len(named))), np.zeros((questions, len(named)))
        np.add.at(self.matrix, (self.row[at >= 0], at[at >= 0]), self.weight[at >= 0])
        np.add.at(self.ones, (self.row[at >= 0], at[at >= 0]), 1.0)

    def place(self, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these postings meet a question, and at what place of the bucket list."""
        at = np.minimum(np.searchsorted(self.idx, idx), max(len(self.idx) - 1, 0))
        meets = np.flatnonzero(self.idx[at] == idx) if len(self.idx) else np.zeros(0, np.int64)
        return meets, at[meets]

    def __call__(self, row: np.ndarray, place: np.ndarray, weight: np.ndarray, rows: int, counted: bool = False) -> np.ndarray:
        column = self.column[place]
        m, asked = column >= 0, self.ones if counted else self.matrix
        width = asked.shape[1]
        dense = np.bincount(column[m] * rows + row[m], None if counted else weight[m], width * rows).reshape(width, rows)
        scores = asked @ dense.astype(float)
        few = np.flatnonzero(~m)
        c = self.many[place[few]]
        if len(few) and c.sum():
            post = np.repeat(few, c)
            pair = np.arange(len(post)) + np.repeat(self.start[place[few]] - (np.cumsum(c) - c), c)
            cell = self.row[pair] * rows + row[post]
            scores += np.bincount(cell, None if counted else weight[post] * self.weight[pair], self.questions * rows).reshape(self.questions, rows)
        return scores


class Counts:
    """Dot products of whole-number questions with counted rows, longest rows first.

    A product is at most that of both lengths (Cauchy-Schwarz), so a question
    takes part only as long as the rows still to come may reach its ``k``-th
    score.  Buckets that many questions and many rows of a step share are
    summed as a matrix, the others one by one, by what either costs.
    """

    def __init__(self, idx: np.ndarray, row: np.ndarray, weight: np.ndarray, questions: int):
        self.idx, place = np.unique(idx, return_inverse=True)
        order = np.argsort(row, kind="stable")
        self.row, self.place, self.weight = row[order], place[order], weight[order]
        self.n = np.bincount(row, minlength=questions)
        self.start = np.cumsum(self.n) - self.n
        # weights of a bucket that a question names more than once add up
        named, at = np.unique(self.row * max(1, len(self.idx)) + self.place, return_inverse=True)
        total = np.bincount(at, self.weight, len(named))
        self.norm = np.sqrt(np.bincount(named // max(1, len(self.idx)), total * total, questions))
        self.local = np.full(len(self.idx), -1)

    def rows(self, ids: np.ndarray, idx: np.ndarray, row: np.ndarray) -> None:
        """The rows that share a bucket with a question, by falling length of what they share; a row's postings lie together."""
        at = np.minimum(np.searchsorted(self.idx, idx), max(len(self.idx) - 1, 0))
        meets = self.idx[at] == idx if len(self.idx) else np.zeros(len(idx), bool)
        key, count = np.unique(row[meets] * max(1, len(self.idx)) + at[meets], return_counts=True)
        row, place = np.divmod(key, max(1, len(self.idx)))
        square = np.bincount(row, count * count.astype(float), len(ids))
        order = np.argsort(-square, kind="stable")[:np.count_nonzero(square)]
        n = np.bincount(row, minlength=len(ids))
        take, self.length = (np.cumsum(n) - n)[order], n[order]
        self.end = np.cumsum(self.length)
        take = np.repeat(take - (self.end - self.length), self.length) + np.arange(self.end[-1] if len(order) else 0)
        self.ids, self.size = ids[order], np.sqrt(square[order])
        self.post_row, self.post_place, self.count = np.repeat(np.arange(len(order)), self.length), place[take], count[take]
        # whole numbers below 2**24 are exact in single precision
        highest = self.norm.max(initial=0) * self.size.max(initial=0)
        self.kind = np.float32 if highest < 1 << 24 else np.float64

    def best(self, best: Winners) -> None:
        reach = self.norm * (1 + MARGIN)
        a, wide = 0, FIRST_ROWS
        while a < len(self.ids):
            active = np.flatnonzero((self.norm > 0) & (reach * self.size[a] >= best.floor))
            if not len(active):
                return  # no later row is longer
            b = min(a + wide, len(self.ids))
            for first in range(0, len(active), STEP_QUESTIONS):
                questions = active[first:first + STEP_QUESTIONS]
                self._offer(best, questions, self._scores(questions, a, b), a, b)
            a, wide = b, STEP_ROWS

    def _offer(self, best: Winners, questions: np.ndarray, scores: np.ndarray, a: int, b: int) -> None:
        limit = np.maximum(best.floor[questions], np.finfo(self.kind).tiny)
        few = np.flatnonzero(best.n[questions] < best.k)
        if b - a > best.k and len(few):
            limit[few] = np.maximum(limit[few], np.partition(scores[few], b - a - best.k, axis=1)[:, b - a - best.k])
        # rows come in any order of ids: an equal score may count
        row, col = places(scores >= limit.astype(self.kind)[:, None])
        score, ids, q = scores[row, col].astype(float), self.ids[a:b][col], questions[row]
        new = (score > best.floor[q]) | (ids < best.id[q, -1])
        best.add(q[new], ids[new], score[new])

    def _scores(self, questions: np.ndarray, a: int, b: int) -> np.ndarray:
        n, rows = self.n[questions], b - a
        own = np.repeat(np.arange(len(questions)), n)
        take = np.repeat(self.start[questions] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        named, which, many = np.unique(self.place[take], return_inverse=True, return_counts=True)
        weight = self.weight[take]
        self.local[named] = np.arange(len(named))
        of = slice(self.end[a] - self.length[a], self.end[b - 1])
        place = self.local[self.post_place[of]]
        self.local[named] = -1
        met = place >= 0
        place, row, count = place[met], self.post_row[of][met] - a, self.count[of][met]
        held = np.bincount(place, minlength=len(named))
        # in products worked out one by one: a bucket's pairs against its share of a matrix product and its column
        column = np.full(len(named), -1)
        dense = np.flatnonzero(many * held > rows * (len(questions) / PAIR_PRODUCTS + COLUMN_PAIRS))
        dense = dense[np.argsort(-many[dense] * held[dense], kind="stable")[:MATRIX_BUCKETS]]
        column[dense] = np.arange(len(dense))
        asked, given = np.zeros((len(questions), len(dense)), self.kind), np.zeros((len(dense), rows), self.kind)
        m = column[which] >= 0
        np.add.at(asked, (own[m], column[which[m]]), weight[m].astype(self.kind))
        m = column[place] >= 0
        given[column[place[m]], row[m]] = count[m]
        scores = asked @ given
        place, row, count = place[~m], row[~m], count[~m]
        by = np.argsort(which, kind="stable")
        first, each = (np.cumsum(many) - many)[place], many[place]
        total, cells = np.cumsum(each), scores.ravel()
        done = 0
        while done < len(place):  # a bounded number of pairs at once
            to = max(int(np.searchsorted(total, (total[done - 1] if done else 0) + STEP_PRODUCTS, side="right")), done + 1)
            c = each[done:to]
            pair = by[np.repeat(first[done:to] - (np.cumsum(c) - c), c) + np.arange(c.sum())]
            np.add.at(cells, own[pair] * rows + np.repeat(row[done:to], c), (weight[pair] * np.repeat(count[done:to], c)).astype(self.kind))
            done = to
        return scores


def _score_postings(k: int):
    """Dot products of sparse rows: chunks (lists ``idx``, weights or counted) against questions (lists ``idx`` and ``weight``)."""
    def run(tile: pa.Table, block: pa.Table) -> pa.Table:
        qids = block["query_id"].to_numpy()
        best = Winners(len(qids), k)
        ids, row_of = np.unique(tile["chunk_id"].to_numpy(), return_inverse=True)
        idx, n = lists_of(tile["idx"])
        row, weight = np.repeat(row_of, n), np.ones(len(idx))
        if "weight" in tile.column_names:
            weight = lists_of(tile["weight"])[0].astype(float)
        asked, qn = lists_of(block["idx"])
        asked_weight, asked_row = lists_of(block["weight"])[0].astype(float), np.repeat(np.arange(len(qids)), qn)
        if "weight" not in tile.column_names and bool(((asked_weight > 0) & (asked_weight == np.floor(asked_weight))).all()):
            counts = Counts(asked, asked_row, asked_weight, len(qids))
            counts.rows(ids, idx, row)
            counts.best(best)
            return best.table(qids)
        signed = bool((weight <= 0).any() or (asked_weight <= 0).any())
        order = np.argsort(row, kind="stable")
        idx, row, weight = idx[order], row[order], weight[order]
        for first in range(0, len(qids), STEP_QUESTIONS):
            mine = (asked_row >= first) & (asked_row < first + STEP_QUESTIONS)
            product = Products(asked[mine], asked_row[mine] - first, asked_weight[mine], min(STEP_QUESTIONS, len(qids) - first))
            meets, place = product.place(idx)
            r, w = row[meets], weight[meets]
            many = np.where(product.column[place] >= 0, 0, product.many[place])
            total = np.cumsum(np.bincount(r, many, len(ids)))
            a = 0
            while a < len(ids):  # rows whose products, and whose cells, are of a bounded number
                b = int(np.searchsorted(total, (total[a - 1] if a else 0) + STEP_PRODUCTS, side="right"))
                b = min(max(b, a + 1), a + STEP_ROWS, len(ids))
                of = slice(*np.searchsorted(r, [a, b]))
                scores = product(r[of] - a, place[of], w[of], b - a)
                hit = product(r[of] - a, place[of], w[of], b - a, counted=True) if signed else scores
                best.offer(first, ids[a:b], scores, hit > 0)
                a = b
        return best.table(qids)

    return run


def met_tiles(tiles: DataFrame, asked: DataFrame, n_blocks: int, score, n_tiles: int | None = None) -> DataFrame:
    """``score`` of every tile and every block of the questions that ask for it; ``n_tiles`` set: all ask for all tiles."""
    a = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)))
    if n_tiles is not None:  # no join, and so one shuffle, of the corpus
        blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))
        # the work is that of the products, not of the bytes by which partitions would be put together
        spark = tiles.sparkSession
        busy = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASK_SHARE * spark.sparkContext.defaultParallelism)
        parts = max(1, min(3 * n_tiles * n_blocks, busy))
        t, a = (x.repartition(parts, "tile", "block") for x in (tiles.withColumn("block", blocks), a))
        return t.groupBy("tile", "block").cogroup(a.groupBy("tile", "block")).applyInArrow(score, CANDIDATES)
    met = a.select("tile", F.col("block").alias("_block")).distinct()
    # every column under a new name, so that rows which ask themselves are told apart from those asked
    rest = [c for c in tiles.columns if c != "tile"]
    t = tiles.join(met, "tile").select(F.col("tile").alias("tile"), F.col("_block").alias("block"), *(F.col(c).alias(c) for c in rest))
    return t.groupBy("tile", "block").cogroup(a.groupBy("tile", "block")).applyInArrow(score, CANDIDATES)


def scored_tiles(tiles: DataFrame, asked: DataFrame, n_blocks: int, k: int, dim: int | None,
                 asked_dim: int | None = None, merged: bool = False, n_tiles: int | None = None) -> DataFrame:
    """The ``k`` best rows per question and tile; ``tiles`` (tile, chunk_id, vec), ``asked`` (tile, query_id, vec).

    ``merged``: rows that share an id are scored by the sum of their vectors.
    """
    return met_tiles(tiles, asked, n_blocks, _score_tile(k, dim, asked_dim, merged), n_tiles)


def ranked(candidates: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("chunk_id").asc())
    return candidates.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


def blocks_for(rows: int, size: int) -> int:
    return max(1, -(-rows // max(1, size)))


def tiles_for(corpus: DataFrame, tile_rows: int) -> int:
    """As few tiles as their size allows, since questions are copied once per tile, but enough to keep every core busy."""
    rows = corpus.count()
    return max(blocks_for(rows, tile_rows), min(blocks_for(rows, STEP_ROWS), 4 * corpus.sparkSession.sparkContext.defaultParallelism))


def dealt(corpus: DataFrame, questions: DataFrame, n_tiles: int) -> tuple[DataFrame, DataFrame]:
    """The corpus in tiles, all rows of an id in one of them, and the questions once per tile."""
    tiles = corpus.withColumn("tile", F.pmod(F.xxhash64("chunk_id"), F.lit(n_tiles)))
    return tiles, questions.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_tiles - 1).cast("long"))))


def all_topk(corpus: DataFrame, questions: DataFrame, k: int, dim: int | None = None,
             tile_rows: int = TILE_ROWS, block_rows: int = BLOCK_ROWS, asked_dim: int | None = None, merged: bool = False) -> DataFrame:
    """Every question against every row: (query_id, chunk_id, score, rank).

    ``corpus`` (chunk_id, vec), ``questions`` (query_id, vec).  Questions are
    copied once per tile, the corpus once per block of questions.  ``dim`` or
    ``asked_dim`` set: vectors of that side are lists of bucket indexes.
    """
    n_tiles = tiles_for(corpus, tile_rows)
    tiles, asked = dealt(corpus, questions, n_tiles)
    return ranked(scored_tiles(tiles, asked, blocks_for(questions.count(), block_rows), k, dim, asked_dim, merged, n_tiles), k)


def all_products(corpus: DataFrame, questions: DataFrame, k: int, tile_rows: int = TILE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` largest dot products per question over rows that share an ``idx`` with it: (query_id, chunk_id, score, rank).

    ``corpus`` (chunk_id, idx) with every list counted, or (chunk_id, idx,
    weight); ``questions`` (query_id, idx, weight).  Rows that share an id add up.
    """
    n_tiles = tiles_for(corpus, tile_rows)
    tiles, asked = dealt(corpus, questions, n_tiles)
    return ranked(met_tiles(tiles, asked, blocks_for(questions.count(), block_rows), _score_postings(k), n_tiles), k)


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Lloyd's rounds over unit rows, from evenly spaced sample rows; an empty cell keeps its centroid."""
    rows = np.unique(sample, axis=0)
    c = rows[np.linspace(0, len(rows) - 1, min(cells, len(rows))).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(sample, c)[0]
        sums, counts = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, sample)
        moved = np.divide(sums, counts[:, None], out=c.copy(), where=counts[:, None] > 0)
        if np.array_equal(moved, c):
            break
        c = moved
    return c


def nearest(m: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of every row and the distance from it."""
    gap = (centroids * centroids).sum(axis=1)[None, :] - 2.0 * (m @ centroids.T)
    near = gap.argmin(axis=1)
    return near, np.sqrt(((m - centroids[near]) ** 2).sum(axis=1))


def build_cells(corpus: DataFrame, dim: int, bucketed: bool = False, cells: int | None = None,
                sample_rows: int = SAMPLE_ROWS, tile_rows: int = STEP_ROWS) -> dict:
    """Cells over (chunk_id, vec) with vectors of ``dim`` components, or lists of bucket indexes if ``bucketed``.

    By default the number of cells is the root of the number of rows, at most
    ``MAX_CELLS``.  The fit sees at most ``sample_rows`` rows, those of smallest
    id hash; the assignment sees all.  Ids are distinct.
    """
    n = corpus.count()
    how = dim if bucketed else None
    wanted = min(MAX_CELLS, cells or max(1, math.isqrt(n)))
    sample = corpus.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample_rows).select("vec").toArrow().column("vec")
    rows = _to_width(as_matrix(pd.Series(sample.to_pylist(), dtype=object), how), dim)
    centroids = fit_centroids(unit(rows), wanted) if n else np.zeros((1, dim))
    known = corpus.sparkSession.sparkContext.broadcast(centroids)  # at most MAX_CELLS rows

    def assign(batches):
        for pdf in batches:
            near, far = nearest(unit(_to_width(as_matrix(pdf["vec"], how), dim)), known.value)
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "vec": pdf["vec"], "cell": near, "far": far})

    vec_type = corpus.schema["vec"].dataType.simpleString()
    placed = cut_lineage(corpus.select("chunk_id", "vec").mapInPandas(assign, f"chunk_id long, vec {vec_type}, cell long, far double"))
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    cell_list = cut_lineage(sizes.withColumn("tiles", F.ceil(F.col("n") / F.lit(tile_rows))))
    tiles = cut_lineage(placed.join(F.broadcast(cell_list.select("cell", "tiles")), "cell")
                        .withColumn("tile", tile_of(F.col("cell"), F.pmod(F.xxhash64("chunk_id"), F.col("tiles"))))
                        .select("tile", "chunk_id", "vec"))
    return {"tiles": tiles, "cells": cell_list, "centroids": centroids, "dim": dim, "bucketed": bucketed}


def tile_of(cell, part):
    return F.shiftleft(cell.cast("long"), 40) + part


def _to_width(m: np.ndarray, dim: int) -> np.ndarray:
    if m.shape[1] > dim:
        raise ValueError(f"vector of {m.shape[1]} components in an index of {dim}")
    return np.pad(m, ((0, 0), (0, dim - m.shape[1])))


def cell_bounds(index: dict, questions: DataFrame) -> DataFrame:
    """Per question and cell in use: (query_id, vec, cell, tiles, near, bound); ``near`` 1 is the nearest cell."""
    used = index["cells"].orderBy("cell").toArrow()  # at most MAX_CELLS rows
    cells = np.asarray(used.column("cell"), dtype=np.int64)
    state = (cells, np.asarray(used.column("tiles"), dtype=np.int64), np.asarray(used.column("radius"), dtype=float),
             index["centroids"][cells], index["dim"])
    known = questions.sparkSession.sparkContext.broadcast(state)

    def run(batches):
        cells, tiles, radius, centroids, dim = known.value
        for pdf in batches:
            q = unit(_to_width(as_matrix(pdf["vec"], None), dim))
            dots = q @ centroids.T
            place = np.argsort(np.argsort(-dots, axis=1, kind="stable"), axis=1) + 1
            # rows without a direction score 0 and lie at any distance: their bound is 0 and no less
            bound = np.where((q * q).sum(axis=1)[:, None] > 0, np.maximum(dots + radius, 0.0), 0.0)
            for i, (qid, vec) in enumerate(zip(pdf["query_id"], pdf["vec"])) if len(cells) else ():
                yield pd.DataFrame({"query_id": qid, "vec": [vec] * len(cells), "cell": cells, "tiles": tiles,
                                    "near": place[i], "bound": bound[i]})

    kind = questions.schema["vec"].dataType.simpleString()
    return questions.select("query_id", "vec").mapInPandas(
        run, f"query_id long, vec {kind}, cell long, tiles long, near long, bound double")


def probes_for(index: dict, questions: DataFrame, k: int, recall: float = 0.95) -> int:
    """Fewest probes that find the share ``recall`` of the true ``k`` best rows of these questions.

    A true one is found as soon as its cell is visited, so the recall of a
    number of probes is the share of true ones whose cell is that near.
    """
    truth = cells_topk(index, questions, k, exact=True).select("query_id", "chunk_id")
    homes = index["tiles"].select("chunk_id", F.shiftright("tile", 40).alias("cell"))
    near = cell_bounds(index, questions.select(F.col("query_id").cast("bigint").alias("query_id"), "vec")).select("query_id", "cell", "near")
    counts = (truth.join(homes, "chunk_id").join(near, ["query_id", "cell"]).groupBy("near").count()
              .orderBy("near").collect())  # at most MAX_CELLS rows
    total, seen = sum(r["count"] for r in counts), 0
    for r in counts:
        seen += r["count"]
        if seen >= recall * total:
            return r["near"]
    return 1


def cells_topk(index: dict, questions: DataFrame, k: int, probes: int = 8, exact: bool = False,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` best rows per question: (query_id, chunk_id, score, rank).

    Looks into the ``probes`` nearest cells; ``exact`` also into every other
    cell whose bound reaches the ``k``-th score found there, which gives the
    result of ``all_topk``.
    """
    dim = index["dim"] if index["bucketed"] else None
    q = cut_lineage(questions.select(F.col("query_id").cast("bigint").alias("query_id"), "vec"))
    n_blocks = blocks_for(q.count(), block_rows)
    bounds = cell_bounds(index, q)
    if exact:
        bounds = cut_lineage(bounds)

    def look(cells: DataFrame) -> DataFrame:
        part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
        asked = cells.withColumn("_part", part).select(tile_of(F.col("cell"), F.col("_part")).alias("tile"), "query_id", "vec")
        return scored_tiles(index["tiles"], asked, n_blocks, k, dim)

    first = ranked(look(bounds.filter(F.col("near") <= probes)), k)
    if not exact:
        return first
    first = cut_lineage(first)
    reached = first.filter(F.col("rank") == k).select("query_id", F.col("score").alias("_kth"))
    rest = (bounds.filter(F.col("near") > probes).join(reached, "query_id", "left")
            .filter(F.col("_kth").isNull() | (F.col("bound") >= F.col("_kth") - F.lit(MARGIN))).drop("_kth"))
    return ranked(first.drop("rank").unionByName(look(rest)), k)
