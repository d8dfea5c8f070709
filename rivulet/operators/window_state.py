"""Per-symbol trailing window state across micro-batches.

The stored state is a snapshot table holding at most ``WINDOW_ROWS`` newest
ticks per symbol.  A batch is merged by union + keep-first dedup on
(symbol, timestamp) + newest-30 per symbol; indicator rows for a batch are
computed over state + batch and only the batch's own rows are emitted
(every new row is emitted, late ones included).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions import fixed as X
from rivulet.operators import indicators as ind

TICK_COLS = ["symbol", "timestamp", "price", "volume", "seq"]


def initial_state(history: DataFrame, n: int = X.WINDOW_ROWS) -> DataFrame:
    """Cold start: newest ``n`` rows per symbol of the stored history."""
    w = Window.partitionBy("symbol").orderBy(F.col("timestamp").desc(), F.col("seq").desc())
    return (history.select(*TICK_COLS).withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= n).drop("_rn"))


def merge_window(state: DataFrame, batch: DataFrame, n: int = X.WINDOW_ROWS, keep: str = "first") -> DataFrame:
    """New state: stored rows of the touched symbols + batch, deduplicated by timestamp, newest ``n`` kept.

    ``keep='first'`` keeps the stored row on a timestamp collision (the
    in-memory rule); ``keep='last'`` keeps the newest arrival.
    """
    touched = batch.select("symbol").distinct()
    old = state.select(*TICK_COLS).join(touched, "symbol", "left_semi").withColumn("_src", F.lit(0))
    new = batch.select(*TICK_COLS).withColumn("_src", F.lit(1))
    both = old.unionByName(new)
    tie = [F.col("_src").asc(), F.col("seq").asc()] if keep == "first" else [F.col("_src").desc(), F.col("seq").desc()]
    dedup = (both.withColumn("_d", F.row_number().over(Window.partitionBy("symbol", "timestamp").orderBy(*tie)))
             .filter(F.col("_d") == 1))
    w = Window.partitionBy("symbol").orderBy(F.col("timestamp").desc(), F.col("seq").desc())
    merged = dedup.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    untouched = state.select(*TICK_COLS).join(touched, "symbol", "left_anti").withColumn("_src", F.lit(0))
    return merged.select(*TICK_COLS, "_src").unionByName(untouched).withColumnRenamed("_src", "from_batch")


def enriched_ticks(state: DataFrame, batch: DataFrame, block_rows: int = ind.BLOCK_ROWS,
                   reemit: bool = False) -> DataFrame:
    """Per-row indicators for every batch row, using the stored tail as look-back (W8, fixes Q2).

    ``reemit=True`` also returns stored rows later than a symbol's earliest new
    row: a late tick inside the window changes their frames, and the gold
    table keeps the latest emission.
    """
    touched = batch.select("symbol").distinct()
    old = state.select(*TICK_COLS).join(touched, "symbol", "left_semi").withColumn("is_new", F.lit(False))
    new = batch.select(*TICK_COLS).withColumn("is_new", F.lit(True))
    both = old.unionByName(new)
    # a stored row whose timestamp reappears in the batch is replaced by the batch row
    both = (both.withColumn("_d", F.row_number().over(
        Window.partitionBy("symbol", "timestamp").orderBy(F.col("is_new").desc(), F.col("seq").desc())))
            .filter(F.col("_d") == 1).drop("_d"))
    out = ind.indicators(both, mode="per_row", block_rows=block_rows)
    if not reemit:
        return out.filter(F.col("is_new")).drop("is_new")
    first_new = batch.groupBy("symbol").agg(F.min("timestamp").alias("_first_new"))
    return (out.join(first_new, "symbol")
            .filter(F.col("is_new") | (F.col("timestamp") > F.col("_first_new")))
            .drop("is_new", "_first_new"))


def changed_ticks(history: DataFrame, new: DataFrame, block_rows: int = ind.BLOCK_ROWS) -> DataFrame:
    """Per-row indicators of the new ticks and of all later ones of their symbols, one row per (symbol, timestamp).

    ``history`` holds at least the 29 ticks before a symbol's first new one, or
    all there are.  A new tick replaces a stored one of the same time.  Both
    sides have one row per (symbol, timestamp); other columns are carried along.
    """
    first = new.groupBy("symbol").agg(F.min("timestamp").alias("_first"))
    old = history.join(new.select("symbol", "timestamp"), ["symbol", "timestamp"], "left_anti").join(first.select("symbol"), "symbol", "left_semi")
    out = ind.indicators(old.unionByName(new), mode="per_row", block_rows=block_rows, fill=False)
    return out.join(first, "symbol").filter(F.col("timestamp") >= F.col("_first")).drop("_first")
