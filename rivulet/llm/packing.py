"""Best-fit packing of token sequences by a configuration linear program.

A configuration is a multiset of piece lengths that fits one sequence; the
program asks for the fewest sequences whose configurations cover the histogram
of lengths.  It is solved by multiplicative weights: a length's price falls by a
constant factor per unit of its coverage and is nothing once it is covered; a
knapsack dynamic program prices the rooms, and each length that is still short
gets configurations of nearly the best price.  The fractional solution is
rounded (whole parts, then the largest fractions that still fit) and the program
is solved again for what is left, until rounding places nothing more.  The few
pieces left then are placed by exact subset sums, largest length first.

Only the histogram reaches the driver: at most one count per length up to the
capacity.  Pieces are numbered within (task, length); prefix sums over tasks
turn that into a rank among all pieces of the length, and the rank picks the
sequence and the place from the rounded solution.  So no group of equal lengths
is ever gathered, however common the length is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm import encode
from rivulet.llm import textkit as tk
from rivulet.llm.catalog import query
from rivulet.llm.common import prepare, stored, table

CAPACITY = 2048
END_ID = 0
ROUNDS = 400  # pricings in one solution of the program, at most
PHASES = 6  # solutions: the program, then what rounding left of it
_RATE = 1.0  # of the weights, per unit of coverage
_SLACK = 1e-4  # coverage beyond the whole that a length may get
_LOSS = 2e-4  # share of the best price that a configuration may miss
_NEAR = 0.99  # fill of a sequence that rounding accepts
_TRIES = 20  # configurations for one length under the same prices
_DONE = 1e-9


def _knapsack(lengths: np.ndarray, price: np.ndarray, capacity: int) -> np.ndarray:
    """Greatest price for each room up to ``capacity``."""
    best = np.zeros(capacity + 1)
    ends = np.searchsorted(lengths, np.arange(capacity + 1), side="right").tolist()
    for room in range(1, capacity + 1):
        k = ends[room]
        best[room] = max(best[room - 1], (best[room - lengths[:k]] + price[:k]).max()) if k else 0.0
    return best


def _configuration(lengths: np.ndarray, price: np.ndarray, best: np.ndarray, room: int, short: np.ndarray,
                   loss: float) -> dict[int, int]:
    """Places of the lengths that fill ``room`` for its best price but ``loss``: at each step the largest, short ones first."""
    taken: dict[int, int] = {}
    while room > 0:
        k = int(np.searchsorted(lengths, room, side="right"))
        if not k:
            break
        value = price[:k] + best[room - lengths[:k]]
        fits = np.flatnonzero(value >= best[room] - loss)
        if not len(fits):
            room -= 1
            continue
        wanted = fits[short[fits]]
        i = int(wanted[-1] if len(wanted) else fits[-1])
        loss -= best[room] - value[i]
        taken[i] = taken.get(i, 0) + 1
        room -= int(lengths[i])
    return taken


def fractional(count: dict[int, int], capacity: int, rounds: int = ROUNDS) -> dict[tuple, float]:
    """Configurations and how often each is used, from multiplicative weights over the lengths.

    Every length is covered, by at most ``_SLACK`` too much, unless ``rounds``
    pricings do not suffice.
    """
    every = np.array(sorted(count), np.int64)
    numbers = np.array([count[x] for x in every.tolist()], float)
    coverage = np.zeros(len(every))
    used: dict[tuple, float] = {}
    for _ in range(rounds):
        live = np.flatnonzero(coverage < 1 + _SLACK - _DONE)
        lengths, n, covered = every[live], numbers[live], coverage[live]
        price = lengths / capacity * np.exp(-_RATE * covered)
        best = _knapsack(lengths, price, capacity)
        moved = False
        for i in np.flatnonzero(covered < 1 - _DONE)[::-1].tolist():
            for _ in range(_TRIES):
                if covered[i] >= 1 - _DONE:
                    break
                taken = _configuration(lengths, price, best, capacity - int(lengths[i]), covered < 1 + _SLACK - _DONE,
                                       _LOSS * best[capacity])
                taken[i] = taken.get(i, 0) + 1
                at, times = np.array(list(taken)), np.array(list(taken.values()), float)
                amount = min(float(((1 + _SLACK - covered[at]) * n[at] / times).min()), (1 - covered[i]) * n[i] / taken[i])
                if amount <= _DONE:
                    break
                key = tuple(sorted(((int(lengths[a]), k) for a, k in taken.items()), reverse=True))
                used[key] = used.get(key, 0.0) + amount
                covered[at] += amount * times / n[at]
                moved = True
        coverage[live] = covered
        if not moved or coverage.min() >= 1 - _DONE:
            break
    return used


def rounded(plan: dict[tuple, float], left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole numbers of the plan's well-filled configurations, taken off ``left``: whole parts, then large fractions."""
    fill = {k: sum(x * n for x, n in k) for k in plan}
    whole = {k: int(v + 1e-6) for k, v in plan.items()}
    first = [(k, whole[k]) for k in sorted(plan, key=lambda k: (-fill[k], -plan[k], k))]
    then = [(k, 1) for k in sorted(plan, key=lambda k: (whole[k] - plan[k], -fill[k], k)) if plan[k] - whole[k] > 0.2]
    out = []
    for k, wish in first + then:
        times = min([wish, *(left[x] // n for x, n in k)])
        if times > 0 and fill[k] >= capacity * _NEAR:
            out.append((dict(k), times))
            for x, n in k:
                left[x] -= n * times
    return out


def _best_fill(left: dict[int, int], capacity: int) -> dict[int, int]:
    """The largest length left, and the fullest set of others with it; large lengths are preferred."""
    lengths = sorted((x for x, n in left.items() if n), reverse=True)
    room = capacity - lengths[0]
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for x in lengths:
        have = left[x] - (x == lengths[0])
        if x > room or not have:
            continue
        for _ in range(min(have, room // x)):
            wider = (reach | reach << x) & mask
            if wider == reach:
                break
            steps.append((x, reach))
            reach = wider
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    taken = {lengths[0]: 1}
    for x, before in reversed(steps):
        if not before >> total & 1:
            taken[x] = taken.get(x, 0) + 1
            total -= x
    return taken


def configurations(count: dict[int, int], capacity: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """Whole configurations with their numbers of sequences, which use up ``count`` exactly."""
    left = {x: n for x, n in count.items() if n}
    out = []
    if capacity in left:
        out.append(({capacity: 1}, left.pop(capacity)))
    for _ in range(PHASES):
        left = {x: n for x, n in left.items() if n}
        found = rounded(fractional(left, capacity, rounds), left, capacity) if left else []
        if not found:
            break
        out += found
    while any(left.values()):
        taken = _best_fill(left, capacity)
        times = min(left[x] // n for x, n in taken.items())
        out.append((taken, times))
        for x, n in taken.items():
            left[x] -= n * times
    return out


def placement(found: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, runs of ranks: first rank, first sequence, pieces a sequence, first offset."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for taken, times in found:
        offset = 0
        for x, n in sorted(taken.items(), reverse=True):
            runs.setdefault(x, []).append((ranks.get(x, 0), sequence, n, offset))
            ranks[x] = ranks.get(x, 0) + n * times
            offset += x * n
        sequence += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for x, r in runs.items()}


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                 tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document, with the end id behind its last.

    Columns: the id, ``piece``, ``start``, ``length``, ``ids_crc32``, the
    ``task`` and the ``rank`` among its pieces of that length, and with
    ``keep_ids`` the ids as little-endian 32-bit ``ids``.  A null or empty
    text has the end id alone.
    """
    path = tokenizer or encode.default_tokenizer()
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()),
              *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "task", "rank")),
              *([T.StructField("ids", T.BinaryType())] if keep_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        coder = encode.encoder(path)
        for chunk in tk.chunks(batches, "text"):
            ids, ptr = coder.encode(*tk.text_buffer(chunk["text"]))
            rows, starts, sizes, crcs, bodies = [], [], [], [], []
            for d, (a, b) in enumerate(zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)):
                own = np.append(ids[a:b], END_ID).astype("<u4")
                for s in range(0, len(own), capacity):
                    part = own[s:s + capacity].tobytes()
                    rows.append(d), starts.append(s), sizes.append(len(part) // 4), crcs.append(zlib.crc32(part))
                    if keep_ids:
                        bodies.append(part)
            size = np.array(sizes, np.int64)
            order = np.argsort(size, kind="stable")
            first = np.searchsorted(size[order], size[order])
            rank = np.empty(len(size), np.int64)
            rank[order] = np.arange(len(size)) - first + seen[size[order]]
            seen += np.bincount(size, minlength=capacity + 1)
            start = np.array(starts, np.int64)
            cols = [chunk["doc_id"].combine_chunks().take(pa.array(rows, pa.int64())),
                    pa.array((start // capacity).astype(np.int32)), pa.array(start), pa.array(size),
                    pa.array(crcs, pa.int64()), pa.array(np.full(len(size), task)), pa.array(rank)]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(bodies, pa.binary())] if keep_ids else [])],
                                             [f.name for f in fields])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, T.StructType(fields))


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` (a written table of ``token_pieces``) with ``sequence_id`` and ``offset`` instead of task and rank."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    count = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.sparkContext.broadcast(placement(configurations(count, capacity, rounds)))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("task").alias("t"), F.col("length").alias("l"),
                         F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(base, (F.col("task") == F.col("t")) & (F.col("length") == F.col("l"))).withColumn(
        "rank", F.col("rank") + F.col("before")).drop("task", "t", "l", "before")
    kept = [f for f in ranked.schema.fields if f.name != "rank"]
    schema = T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = runs.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cut = [0, *(np.flatnonzero(np.diff(length[order])) + 1).tolist(), len(order)]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                at = order[i:j]
                if not len(at):
                    continue
                x = int(length[at[0]])
                first, start, n, place = table[x]
                k = np.searchsorted(first, rank[at], side="right") - 1
                inside = rank[at] - first[k]
                sequence[at] = start[k] + inside // n[k]
                offset[at] = place[k] + inside % n[k] * x
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(sequence), pa.array(offset)],
                                             schema.names)

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                   tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and offset.

    Nulls: a null text is empty, a null id is kept.  Repeated rows are packed
    each; equal lengths are told apart by their rank, in table order.  Other
    input columns are ignored.  An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    return pack(stored(token_pieces(docs, id_col, text_col, capacity, tokenizer, keep_ids)), capacity)


@query("op1_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
