"""Compression of vectors to product codes by exact integer arithmetic on float64 BLAS.

Components become integers, and every vector is cut into equal parts.  A part
is coded by the nearest entry of its codebook, under squared distance in exact
arithmetic, so codes do not depend on the order or grouping of the sums.

The dot products come from floating-point matrix products: integers are
written as limbs of few bits, so that every partial sum of products of limbs
stays below 2**53, where float64 is exact.  The products of limbs are then put
together in int64.  Limb size and number follow from the width of a part and
the bound on the integers; they are the same for all rows of a table.

Only codebooks and one row of sums per codebook entry pass through the driver:
both are bounded by entries x dimension, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.catalog import query
from rivulet.llm.common import prepare, stored, table

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
_ROWS = 2048  # vectors whose distances are held at a time


@dataclass(frozen=True)
class Limbs:
    """How integers of at most ``bound`` in size are split for dot products of ``width`` terms.

    ``bits`` is the size of a limb, ``count`` the number of limbs.  A matrix
    product that gathers all pairs of limbs of one weight has up to
    ``count * width`` terms below ``2**(2 * bits)`` each, together below 2**53.
    """

    width: int
    bound: int
    bits: int
    count: int

    @classmethod
    def plan(cls, width: int) -> Limbs:
        bound = 1 << int((62 - math.log2(width)) // 2 - 1)  # squared distances of parts fit in int64
        bits, count = 0, 1
        while True:  # more limbs make longer sums, and so smaller limbs
            bits = int((53 - math.log2(count * width)) // 2)
            need = math.ceil((bound.bit_length() + 1) / bits)
            if need <= count:
                return cls(width, bound, bits, count)
            count = need

    def split(self, x: np.ndarray) -> list[np.ndarray]:
        """Limbs of int64 values, lowest first: all but the last are not negative."""
        out = []
        for _ in range(self.count - 1):
            out.append((x & ((1 << self.bits) - 1)).astype(np.float64))
            x = x >> self.bits
        return [*out, x.astype(np.float64)]

    def dot(self, x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
        """Exact int64 products (rows of x by rows of y) of values given by their limbs."""
        total = None
        for weight in range(2 * self.count - 1):
            of = [(i, weight - i) for i in range(self.count) if 0 <= weight - i < self.count]
            made = np.concatenate([x[i] for i, _ in of], 1) @ np.concatenate([y[j] for _, j in of], 1).T
            term = made.astype(np.int64) << (weight * self.bits)
            total = term if total is None else total + term
        return total


def to_integers(values: np.ndarray, bound: int) -> np.ndarray:
    """``floor(SCALE * x)``, held at plus or minus ``bound``."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values.astype(np.float64) * SCALE), -bound, bound).astype(np.int64)


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    """Vectors of a list column as rows, shorter ones filled up with zeros."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n = np.diff(col.offsets.to_numpy())
    if len(n) and (n == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(n), width))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def nearest(x: np.ndarray, book: np.ndarray, limbs: Limbs) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the first of equals) and squared distance, for int64 rows."""
    cross = limbs.dot(limbs.split(x), limbs.split(book))
    part = (book * book).sum(1) - 2 * cross
    at = part.argmin(1)
    return at, (x * x).sum(1) + part[np.arange(len(x)), at]


def _assigned(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple]:
    """Blocks of rows as (batch slice, integers by part, indexes, distances)."""
    parts, _, width = books.shape
    limbs = Limbs.plan(width)
    for batch in batches:
        for a in range(0, batch.num_rows, _ROWS):
            rows = batch.slice(a, _ROWS)
            x = to_integers(_matrix(rows.column(0), parts * width), limbs.bound).reshape(-1, parts, width)
            found = [nearest(x[:, p], books[p], limbs) for p in range(parts)]
            yield rows, x, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _sums(books: np.ndarray):
    """Per task, one row for every entry: how many parts it has and their sum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.shape
        total = np.zeros((parts * entries, width), np.int64)
        count = np.zeros(parts * entries, np.int64)
        for _, x, at, _ in _assigned(batches, books):
            cell = at + np.arange(parts) * entries
            count += np.bincount(cell.ravel(), minlength=len(count))
            np.add.at(total, cell.ravel(), x.reshape(-1, width))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))],
                                         ["cell", "n", "total"])
    return run


def _codes(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, at, far in _assigned(batches, books):
            code = [row.tobytes().hex() for row in at.astype(np.uint8)]
            error = [e if e < 1 << 63 else None for e in map(sum, far.tolist())]
            yield pa.RecordBatch.from_arrays([*rows.columns[1:], pa.array(code, pa.string()), pa.array(error, pa.int64())],
                                             [*rows.schema.names[1:], "code", "error"])
    return run


def usable(col: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return col.isNotNull() & ~bad


def train_codebooks(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS,
                    entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x width, int64) from all usable vectors.

    Entries start as the vectors of the smallest ids (null ids last, equal ids
    by their components); fewer vectors make fewer entries.  Each round assigns
    all vectors and takes the rounded-down mean of each entry's parts; unused
    entries stay.  Vectors are filled up with zeros to the length of the
    longest, rounded up to a multiple of ``parts``.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(usable(F.col("v")))
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return np.zeros((parts, 0, 1), np.int64)
    width = max(1, math.ceil(longest / parts))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = _matrix(pa.array([r["v"] for r in first], pa.list_(pa.float64())), parts * width)
    books = to_integers(start, Limbs.plan(width).bound).reshape(len(first), parts, width).transpose(1, 0, 2)
    for _ in range(rounds):
        made = rows.select("v").mapInArrow(_sums(books), "cell long, n long, total array<long>")
        means = made.groupBy("cell").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)])
        books = books.copy()
        for cell, n, *total in means.collect():
            books[cell // books.shape[1], cell % books.shape[1]] = [t // n for t in total]
    return books


def compress(vectors: DataFrame, books: np.ndarray, vector_col: str = "embedding") -> DataFrame:
    """The usable rows with all their other columns, ``code`` (hex index per part) and ``error`` (squared distance).

    Integers are held at ``Limbs.plan(width).bound`` (2**29 for parts of four);
    an error that no long holds is null.  Columns named ``code`` or ``error``
    in the input are left out.
    """
    keep = [c for c in vectors.columns if c != vector_col and c.lower() not in ("code", "error")]
    rows = vectors.select(F.col(vector_col).cast("array<double>").alias("v"), *[F.col(c) for c in keep]).where(usable(F.col("v")))
    if not books.shape[1]:
        return rows.select(*keep, F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0)
    out = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(_codes(books), f"{out}, code string, error long" if keep else "code string, error long")


def expand(codes: list[str], books: np.ndarray) -> np.ndarray:
    """The integer vectors that codes stand for."""
    at = np.array([list(bytes.fromhex(c)) for c in codes], np.int64).reshape(-1, books.shape[0])
    return books[np.arange(books.shape[0]), at].reshape(len(codes), -1)


def checksum(books: np.ndarray) -> str:
    """SHA-256 of all components in order, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def product_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Id, ``code``, ``error``, ``label_error`` (error over equal labels, nulls together) and ``codebooks_sha256`` of all usable rows.

    Rows whose vector is null or has null or non-finite components are left
    out.  Rows with equal ids are vectors of their own.  Empty vectors count as
    zeros.  A label's total that no long holds is null.  Other columns are
    ignored.  An empty table gives an empty result.
    """
    prepare(vectors.sparkSession)
    own = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    books = train_codebooks(own, "id", "vector")
    done = stored(compress(own, books, "vector"))
    # Read back from a table, the totals have a known size: they are broadcast if small, else the join splits hot labels.
    totals = stored(done.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum")))
    sums = totals.select(F.col("label").alias("of"), F.expr("try_cast(sum as long)").alias("label_error"))
    return done.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(checksum(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """Rounds of assignment as common table expressions over (vec_id, part, position, value)."""
    w = f"(SELECT any_value(len(v)) // {PARTS} FROM kept)"
    steps = [f"""kept AS (SELECT vec_id, label, embedding AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS (SELECT vec_id, label, p, list_transform(v[p * {w} + 1:(p + 1) * {w}], lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x
  FROM kept, range({PARTS}) AS r(p)),
first_ids AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {ENTRIES}),
book0 AS (SELECT p, e, x AS c FROM part JOIN first_ids USING (vec_id))"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""near{r} AS (SELECT vec_id, label, p, x, min(struct_pack(d := d, e := e)) AS m FROM (
  SELECT vec_id, label, part.p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM part JOIN book{r} ON part.p = book{r}.p) GROUP BY vec_id, label, p, x)""")
        if r < ROUNDS:
            steps.append(f"""mean{r} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
  SELECT p, m.e AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM near{r}, range(1, {w} + 1) AS q(i) GROUP BY p, m.e, i) GROUP BY p, e),
book{r + 1} AS (SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM book{r} AS b LEFT JOIN mean{r} AS n ON b.p = n.p AND b.e = n.e)""")
    last = f"""coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code,
  sum(m.d)::BIGINT AS error FROM near{ROUNDS} GROUP BY vec_id),
sha AS (SELECT sha256(string_agg(c[i]::VARCHAR, ',' ORDER BY p, e, i)) AS h FROM book{ROUNDS}, range(1, {w} + 1) AS q(i))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM coded, sha"""
    return "WITH " + ",\n".join([*steps, last])


@query("op12_vector_codes", _sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all embeddings, their errors, and a checksum of the codebooks."""
    return product_codes(table(spark, sf_dir, "embeddings"))
