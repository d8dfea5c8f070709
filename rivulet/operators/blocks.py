"""Halo blocks: trailing-row windows without one task per key.

A window ``partitionBy(symbol)`` puts every row of a symbol into one task; with a
hot symbol holding a third of the data that task is the whole job.  Here rows
are sorted by (key, order) into ranges, so many rows of one key, even of one
instant, spread over tasks.  The number of rows of a key in each range (a small
table) gives every row its position in its key by a prefix sum.  A block is a
fixed number of positions, and the rows that precede a block (the halo) are
known from positions alone: a row also goes to the blocks that begin within
``halo`` positions after it.  Windows partition by ``(key, block)``; a block's
own rows get exactly the frames they would get in the unblocked window.

The sorted rows are written once to the shared folder: positions refer to the
ranges as they were written, whatever is computed again later.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.session import cut_lineage

BLOCK_ROWS = 2_048


@dataclass
class Blocked:
    rows: DataFrame      # block rows + halo rows; columns _blk, _pos, _total, _halo added
    own: DataFrame       # each row once, with _blk, _pos, _total
    blocks: DataFrame    # key..., _blk
    key: list
    window: Window       # partitionBy(key, _blk).orderBy(_pos)
    block_rows: int


def positions(df: DataFrame, key: list, order: list) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_pos`` (from 0 within the key) and ``_total``, and the totals (key..., _total)."""
    ranged = df.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
    placed = cut_lineage(ranged.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i")))
    ranges = placed.groupBy(*key, "_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    before = Window.partitionBy(*key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # one row per key and range: read back with a known size, it is broadcast where it is small
    ranges = cut_lineage(ranges.select(
        *key, "_p", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("bigint").alias("_start"),
        F.sum("_n").over(Window.partitionBy(*key)).cast("bigint").alias("_total")))
    rows = placed.join(ranges, [*key, "_p"]).withColumn("_pos", F.col("_start") + F.col("_i") - F.col("_first"))
    return rows.drop("_p", "_i", "_first", "_start"), ranges.filter("_start = 0").select(*key, "_total")


def with_halo(df: DataFrame, key: list, order: list, halo: int, block_rows: int = BLOCK_ROWS) -> Blocked:
    """Rows of every block plus the ``halo`` rows preceding it (flagged ``_halo``)."""
    rows, totals = positions(df, key, order)
    block = lambda c: F.floor(c / F.lit(block_rows)).cast("bigint")
    own = block(F.col("_pos"))
    last = block(F.col("_total") - 1)
    spread = rows.withColumn("_blk", F.explode(F.sequence(own, F.least(block(F.col("_pos") + F.lit(halo)), last))))
    spread = spread.withColumn("_halo", F.col("_blk") != own)
    blocks = totals.select(*key, F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_blk"))
    w = Window.partitionBy(*key, "_blk").orderBy("_pos")
    return Blocked(rows=spread, own=rows.withColumn("_blk", own), blocks=blocks, key=list(key), window=w, block_rows=block_rows)
