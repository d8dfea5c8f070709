"""Training-order materialisation of token sequences in fixed-stride shards.

Every sequence gets a slot of a global order by a keyed Feistel permutation of
its number: four rounds over the smallest even number of bits that holds the
count, with cycle-walking back into range.  The permutation is a function of
key and number alone: no sort decides the order, any slot can be computed or
inverted at any time, and another key gives another epoch.  Rows are then
range-partitioned by slot, and each shard is written as one binary record of
fixed-stride slots, so slot s is at byte (s mod per_shard) * stride of shard
s // per_shard; a reader can resume anywhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import encode
from rivulet.llm import textkit as tk
from rivulet.llm.catalog import query
from rivulet.llm.common import prepare, scratch, stored, table

LENGTH = 512
PER_SHARD = 1024
KEY = 0x5EED
END_ID = 49407
ROUNDS = 4
WIDTH = 2  # bytes of an id; the default vocabulary has 49,408


def _round(x: np.ndarray, key: int, number: int, mask: int) -> np.ndarray:
    salt = np.uint64((key * 0x9E3779B97F4A7C15 + (number + 1) * 0xD1342543DE82EF95) & ((1 << 64) - 1))
    return tk.mix64(x + salt) & np.uint64(mask)


def _half(n: int) -> int:
    return max(1, -(-max(1, (n - 1).bit_length()) // 2))


def permute(x: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Slot of each number below ``n`` (or, inverted, the number of each slot)."""
    half = _half(n)
    mask = (1 << half) - 1
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        v = out[todo]
        left, right = v >> np.uint64(half), v & np.uint64(mask)
        for r in range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS):
            if inverse:
                left, right = right ^ _round(left, key, r, mask), left
            else:
                left, right = right, left ^ _round(right, key, r, mask)
        out[todo] = v = left << np.uint64(half) | right
        todo = todo[v >= np.uint64(n)]
    return out.astype(np.int64)


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
              tokenizer: str | None = None, width: int = WIDTH) -> DataFrame:
    """Fixed-length pieces of each document (ids and an end id; the last piece is shorter), numbered within their task.

    Ids take ``width`` bytes (2 or 4); an id that needs more ends the job with an error.
    """
    path = tokenizer or encode.default_tokenizer()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task, seen = TaskContext.get().partitionId(), 0
        coder = encode.encoder(path)
        for chunk in tk.chunks(batches, "text", 2 << 20):
            ids, ptr = coder.encode(*tk.text_buffer(chunk["text"]))
            rows, pieces, bodies = [], [], []
            for d, (a, b) in enumerate(zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)):
                whole = np.append(ids[a:b], END_ID)
                if int(whole.max()) >> 8 * width:
                    raise ValueError(f"id {int(whole.max())} does not fit {width} bytes; a larger width is needed")
                own = whole.astype(f"<u{width}")
                for i, s in enumerate(range(0, len(own), length)):
                    rows.append(d), pieces.append(i), bodies.append(own[s:s + length].tobytes())
            number = np.arange(seen, seen + len(rows))
            seen += len(rows)
            yield pa.RecordBatch.from_arrays(
                [chunk["doc_id"].combine_chunks().take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()),
                 pa.array(bodies, pa.binary()), pa.array(np.full(len(rows), task)), pa.array(number)],
                ["doc_id", "piece", "ids", "task", "number"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, piece int, ids binary, task long, number long")


def slots(pieces: DataFrame, key: int = KEY) -> DataFrame:
    """``pieces`` (a written table of ``sequences``) with ``slot``, a permutation of 0 to n - 1."""
    spark = pieces.sparkSession
    tasks = {r["task"]: r["n"] for r in pieces.groupBy("task").agg(F.count("*").alias("n")).collect()}  # one number a task
    first, n = {}, 0
    for t in sorted(tasks):
        first[t], n = n, n + tasks[t]
    begin = spark.sparkContext.broadcast((first, n))
    kept = [f for f in pieces.schema.fields if f.name not in ("task", "number")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n = begin.value
        for b in batches:
            base = np.array([first[t] for t in b.column("task").to_pylist()], np.int64)
            slot = permute(base + b.column("number").to_numpy(), n, key)
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(slot)], [*(f.name for f in kept), "slot"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "slot long"])
    return pieces.mapInArrow(run, schema)


def write_shards(placed: DataFrame, path: str, length: int = LENGTH, per_shard: int = PER_SHARD, width: int = WIDTH) -> DataFrame:
    """Write fixed-stride shards to ``path``; returns where each sequence lies: its slot, ``shard`` and byte ``offset``.

    A slot is the number of ids (one word of ``width`` bytes) and ``length``
    ids, padded with zeros.  A shard is a row (``shard``, ``first_slot``, ``n``,
    ``body``) of the table; no shard is split between tasks, and each has a row
    group of its own, so that readers leave out the others by its first slot.
    """
    if length >> 8 * width:
        raise ValueError(f"a length of {length} does not fit {width} bytes")
    stride = width * (length + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in tk.groups(batches, ["shard"]):
            slot = group["slot"].to_numpy()
            body = bytearray(stride * group.num_rows)
            for i, ids in enumerate(group["ids"]):
                raw = ids.as_py()
                body[i * stride:i * stride + width] = (len(raw) // width).to_bytes(width, "little")
                body[i * stride + width:i * stride + width + len(raw)] = raw
            yield pa.RecordBatch.from_arrays([group["shard"].combine_chunks()[:1], pa.array(slot[:1]), pa.array([len(slot)], pa.int64()),
                                              pa.array([bytes(body)], pa.binary())], ["shard", "first_slot", "n", "body"])

    sharded = placed.withColumn("shard", F.floor(F.col("slot") / per_shard))
    ordered = sharded.select("shard", "slot", "ids").repartitionByRange("shard").sortWithinPartitions("shard", "slot")
    rows = ordered.mapInArrow(run, "shard long, first_slot long, n long, body binary")
    rows.write.option("parquet.block.row.count.limit", 1).parquet(path)
    return sharded.drop("ids").withColumn("offset", F.pmod("slot", F.lit(per_shard)) * stride)


def read_shards(spark: SparkSession, path: str, first: int = 0, length: int = LENGTH, per_shard: int = PER_SHARD,
                width: int = WIDTH) -> DataFrame:
    """(slot, ids) of all slots from ``first``; the row groups of earlier shards are not read."""
    stride = width * (length + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, n, body in zip(b.column("first_slot").to_pylist(), b.column("n").to_pylist(), b.column("body"), strict=True):
                raw = body.as_py()
                at = range(max(0, first - start), n)
                sizes = [int.from_bytes(raw[i * stride:i * stride + width], "little") for i in at]
                ids = [raw[i * stride + width:i * stride + width * (1 + k)] for i, k in zip(at, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([start + i for i in at], pa.int64()), pa.array(ids, pa.binary())], ["slot", "ids"])

    table = spark.read.schema("shard long, first_slot long, n long, body binary").parquet(path)
    return table.where(F.col("first_slot") > first - per_shard).select("first_slot", "n", "body").mapInArrow(run, "slot long, ids binary")


def materialise(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", key: int = KEY,
                length: int = LENGTH, per_shard: int = PER_SHARD, tokenizer: str | None = None, width: int = WIDTH) -> DataFrame:
    """Encode, order and write all documents; one row per sequence: id, ``piece``, ``slot``, ``shard``, ``offset``.

    A null or empty text is its end id alone; null ids are kept; repeated rows
    get slots of their own.  Other input columns are ignored.  An empty table
    writes no shard and gives an empty result.
    """
    prepare(docs.sparkSession)
    placed = slots(stored(sequences(docs, id_col, text_col, length, tokenizer, width)), key)
    return write_shards(placed, path, length, per_shard, width)


@query("op6_shards")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence read back from its shard: slot, shard, length and checksum of its ids, with its document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch(spark, "shards")
    where = materialise(docs, path)
    back = read_shards(spark, path).select(F.col("slot").alias("s"), (F.length("ids") / WIDTH).cast("long").alias("length"),
                                           F.crc32("ids").alias("ids_crc32"))
    return where.join(back, F.col("slot") == F.col("s")).select("doc_id", "piece", "slot", "shard", "offset", "length", "ids_crc32")


def checksum(ids: np.ndarray) -> int:
    """The checksum that the query reports for a sequence of ids."""
    return zlib.crc32(ids.astype("<u2").tobytes())
