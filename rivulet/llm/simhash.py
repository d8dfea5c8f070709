"""Near duplicates by SimHash fingerprints, found by meet-in-the-middle ball hashing.

A fingerprint is the bitwise majority of the hashes of a document's word
shingles.  Two fingerprints within ``radius`` bits of each other have a word in
common that is within half the radius of both.  So every distinct fingerprint
emits all words within half the radius of itself (one and its 64 neighbours for
radius 2), the words are shuffled, and those that meet are candidate pairs.

All fingerprints that meet at one word lie in a ball around it, hence within
the radius of each other, and there are no more of them than the ball has
words (65 for radius 2), however many documents there are.  Copies share a
fingerprint and are one row before anything is emitted.  Each fingerprint at a
word is paired with the smallest one there, which is a link itself and keeps
all of them connected; pairs are made distinct and verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.llm import textkit as tk
from rivulet.llm.catalog import query
from rivulet.llm.common import prepare, spare, stored, table
from rivulet.llm.components import components

SHINGLE = 3
SEED = 42
RADIUS = 2
BITS = 64
_STRETCH = 1 << 17  # shingles whose bits are counted at a time


def shingle_hashes(text: bytes, length: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of every run of ``length`` words joined by one space, in order, a stretch at a time.

    Fewer words are one shingle; no words, none.  ``bytes.lower`` and
    ``bytes.split`` know ASCII letters and the six ASCII blanks only.
    """
    words = text.lower().split()
    if not words:
        return
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(sizes + 1) - 1
    start = end - sizes
    k = min(length, len(words))
    n = len(words) - k + 1
    for a in range(0, n, _STRETCH):
        b = min(n, a + _STRETCH)
        cuts = map(slice, start[a:b].tolist(), end[a + k - 1:b + k - 1].tolist())
        yield np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(SEED)), np.uint64, b - a)


def majority(hashes: Iterator[np.ndarray]) -> int:
    """The word whose bits are those set in over half of the hashes, as a signed 64-bit number; 0 without hashes."""
    ones, n = np.zeros(BITS, np.int64), 0
    for h in hashes:
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(length: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = tk.text_buffer(batch.column(1))
            raw = buf.tobytes()
            found = [majority(shingle_hashes(raw[a:b], length)) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], schema.names)
    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = SHINGLE) -> DataFrame:
    """(id, fp): the 64-bit fingerprint of each row's whole text, 0 for a text without words."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = f"id {docs.schema[id_col].dataType.simpleString()}, fp long"
    return rows.mapInArrow(_fingerprints(length, pa.schema([("id", pa.null()), ("fp", pa.int64())])), out)


def variants(fp: str, radius: int):
    """Array of all words within ``radius`` bits of a 64-bit column, the column itself included."""
    one = [1 << i if i < 63 else -(1 << 63) for i in range(BITS)]
    masks = [reduce(lambda a, b: a ^ b, c, 0) for k in range(radius + 1) for c in combinations(one, k)]
    if len(masks) <= 1 + BITS:
        return F.array(*[F.col(fp).bitwiseXOR(F.lit(m).cast("long")) for m in masks])
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: F.col(fp).bitwiseXOR(m))


def near_pairs(fps: DataFrame, fp_col: str = "fp", radius: int = RADIUS) -> DataFrame:
    """Distinct, verified pairs (a, b) of fingerprints within an even ``radius``, enough of them to connect all that are.

    Two fingerprints within the radius are connected by at most two of these
    pairs: both are paired with the smallest that meets them at the word between.
    """
    if radius % 2:
        raise ValueError("the radius must be even: words are met half way")
    own = fps.select(F.col(fp_col).alias("fp")).where("fp is not null").distinct()
    met = own.select("fp", F.explode(variants("fp", radius // 2)).alias("word"))
    met = met.select("fp", F.min("fp").over(Window.partitionBy("word")).alias("low")).where("fp <> low")
    pairs = met.select(F.col("low").alias("a"), F.col("fp").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = SHINGLE,
                       radius: int = RADIUS) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable by links.

    Null and empty texts and texts of blanks have fingerprint zero and link as
    any other.  Repeated rows are equal documents and each gets its row.  A row
    with a null id takes part; its component is the smallest id that is not
    null, or null if there is none.  A very long text is hashed a stretch at a
    time; it costs time in proportion and a few times its bytes in memory.
    Ids may have any type that orders.  Other columns are ignored, whatever
    their names.  An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    marked = stored(fingerprints(docs, id_col, text_col, length))
    classes = stored(marked.groupBy("fp").agg(F.min("id").alias("low")))
    groups = stored(components(near_pairs(classes, "fp", radius)))
    rooted = classes.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted)
    lowest = rooted.groupBy("root").agg(F.min("low").alias("least")).withColumnRenamed("root", "r")
    named = rooted.join(lowest, F.col("root") == F.col("r")).select(F.col("fp").alias("of"), "least")
    (mark,) = spare(docs.select(id_col), "fingerprint")
    return marked.join(named, F.col("fp") == F.col("of")).select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias(mark), F.col("least").alias("component_id"))


@query("op11_simhash")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document under fingerprints that differ in 2 bits or fewer."""
    return simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
