"""Exact exponential moving averages over whole series, block by block.

One step of (fast, slow, signal) is an affine map of the three values, and so is
a whole block: its linear part depends on the number of rows alone, its
constant part is a weighted sum of prices, hence a plain aggregate.  Composing
the maps along a symbol's blocks gives the values that enter each block, and
from these every row follows by running sums inside its block.

Running sums weigh row k of a block with c**-k, which stays within float64 for
blocks of up to ``MAX_ROWS`` rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions import fixed as X
from rivulet.operators.blocks import Blocked
from rivulet.session import cut_lineage

MAX_ROWS = 2_048


def alpha(span: int) -> float:
    return 2.0 / (span + 1.0)


AF, AS, AG = alpha(X.EMA_FAST), alpha(X.EMA_SLOW), alpha(X.EMA_SIGNAL)
CF, CS, CG = 1.0 - AF, 1.0 - AS, 1.0 - AG


def _passed(c: float, m):
    """Sum of ``c**i * CG**(m - i)`` for i = 0..m: how a value that decays by c reaches the signal."""
    power = F.pow if isinstance(m, Column) else pow
    lit = F.lit if isinstance(m, Column) else float
    return (power(lit(c), m + 1) - power(lit(CG), m + 1)) / (c - CG)


def block_maps(b: Blocked) -> DataFrame:
    """(symbol, _blk, n, x0, f, s, g): rows, the symbol's first price (in its first block), and the constant parts."""
    n = F.least(F.lit(b.block_rows).cast("bigint"), F.col("_total") - F.col("_blk") * b.block_rows)
    left = n - 1 - F.col("_pos") % b.block_rows  # rows that follow in the block
    x = F.col("price")
    signal = AG * (AF * _passed(CF, left) - AS * _passed(CS, left))
    return b.own.groupBy("symbol", "_blk").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("_pos") == 0, x)).alias("x0"),
        F.sum(AF * F.pow(F.lit(CF), left) * x).alias("f"), F.sum(AS * F.pow(F.lit(CS), left) * x).alias("s"), F.sum(signal * x).alias("g"))


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The values that enter each block, from maps sorted by (symbol, block)."""
    f = s = g = 0.0
    for batch in batches:
        enter = []
        for n, x0, df, ds, dg in zip(*(batch.column(i).to_pylist() for i in range(2, 7)), strict=True):
            if x0 is not None:  # a new symbol: the averages start at its first price, the signal at 0
                f = s = x0
                g = 0.0
            enter.append((f, s, g))
            g = CG ** n * g + AG * (CF * _passed(CF, n - 1) * f - CS * _passed(CS, n - 1) * s) + dg
            f, s = CF ** n * f + df, CS ** n * s + ds
        cols = list(zip(*enter, strict=True)) if enter else [[], [], []]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.float64()) for c in cols)],
                                         ["symbol", "_blk", "_f0", "_s0", "_g0"])


def with_ema(rows: DataFrame, b: Blocked) -> DataFrame:
    """``rows`` (of ``b.rows``) with EMA_12, EMA_26, MACD and MACD_Signal over the whole series."""
    if b.block_rows > MAX_ROWS:
        raise ValueError(f"blocks of more than {MAX_ROWS} rows: the weights of running sums would overflow")
    maps = block_maps(b).repartition("symbol").sortWithinPartitions("symbol", "_blk")
    enter = cut_lineage(maps.mapInArrow(_along, "symbol string, _blk bigint, _f0 double, _s0 double, _g0 double"))
    k = (F.col("_pos") % b.block_rows + 1).cast("double")
    run = b.window.rowsBetween(Window.unboundedPreceding, 0)

    def running(a: float, c: float, x: Column, start: str) -> Column:
        part = F.when(F.col("_halo"), 0.0).otherwise(F.lit(a) * F.pow(F.lit(c), -k) * x)
        return F.pow(F.lit(c), k) * (F.col(start) + F.sum(part).over(run))

    first = F.col("_pos") == 0
    r = rows.join(enter, ["symbol", "_blk"])
    r = r.withColumn("EMA_12", F.when(first, F.col("price")).otherwise(running(AF, CF, F.col("price"), "_f0")))
    r = r.withColumn("EMA_26", F.when(first, F.col("price")).otherwise(running(AS, CS, F.col("price"), "_s0")))
    r = r.withColumn("MACD", F.col("EMA_12") - F.col("EMA_26"))
    return r.withColumn("MACD_Signal", F.when(first, 0.0).otherwise(running(AG, CG, F.col("MACD"), "_g0"))).drop("_f0", "_s0", "_g0")
