"""Technical indicators over trailing per-symbol windows.

Two modes:

* ``per_row`` - each row's indicators are computed over the 30 rows ending at
  it (what a consumer that sees ticks one at a time stores).  RSI is 50 while
  fewer than 14 rows exist; EMAs restart at the first row of the 30-row frame
  and come from one ``aggregate`` fold over the frame's prices.
* ``series`` - the whole history of a symbol, as a direct call on a full frame
  would give.  RSI is 50 for symbols with fewer than 14 rows.  EMAs reach back
  to the symbol's first row: blocks are affine maps that are composed along
  the symbol (``operators.ema``).

Both modes use halo blocks (``rivulet.operators.blocks``), so no task ever
holds a whole symbol, and built-in window aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rivulet.functions import fixed as X
from rivulet.operators.blocks import BLOCK_ROWS, with_halo
from rivulet.operators.ema import alpha, with_ema

OUT_COLS = ["SMA_5", "SMA_20", "RSI", "MACD", "MACD_Signal"]


def clean_ticks(df: DataFrame, subset=("timestamp", "symbol", "price")) -> DataFrame:
    """Coerce price to double (NaN -> null) and timestamp to TIMESTAMP, then drop incomplete rows."""
    types = dict(df.dtypes)
    price = F.col("price").try_cast("double") if types.get("price") != "double" else F.col("price")
    ts = F.col("timestamp")
    if isinstance(df.schema["timestamp"].dataType, StringType):
        ts = F.coalesce(F.try_to_timestamp(ts, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")),
                        F.try_to_timestamp(ts, F.lit("yyyy-MM-dd HH:mm:ss")),
                        F.try_to_timestamp(ts, F.lit("yyyy-MM-dd")))
    elif types.get("timestamp") != "timestamp":
        ts = ts.cast("timestamp")
    out = df.withColumn("price", F.nanvl(price, F.lit(None).cast("double"))).withColumn("timestamp", ts)
    return out.na.drop(subset=list(subset))


def ema_fold(prices: Column) -> Column:
    """Fold (EMA12, EMA26, signal of their difference) over an array of prices.

    Starting state (x0, x0, 0) reproduces the ``adjust=False`` start y0 = x0 and
    a zero first MACD signal.
    """
    af, as_, ag = alpha(X.EMA_FAST), alpha(X.EMA_SLOW), alpha(X.EMA_SIGNAL)
    x0 = F.element_at(prices, 1)
    init = F.struct(x0.alias("f"), x0.alias("s"), F.lit(0.0).alias("g"))

    def step(acc, x):
        f = acc["f"] * (1.0 - af) + x * af
        s = acc["s"] * (1.0 - as_) + x * as_
        g = acc["g"] * (1.0 - ag) + (f - s) * ag
        return F.struct(f.alias("f"), s.alias("s"), g.alias("g"))

    return F.aggregate(prices, init, step)


def _blocked(clean: DataFrame, look: int, block_rows: int):
    return with_halo(clean, ["symbol"], ["timestamp", "seq"], look, block_rows)


def _ensure_seq(df: DataFrame) -> DataFrame:
    if "seq" in df.columns:
        return df
    return df.withColumn("seq", F.lit(0).cast("bigint"))


def _fill_columns(rows: DataFrame, blocks: DataFrame, w: Window, col: str) -> Column:
    """Backward then forward fill of ``col`` within the symbol, block-parallel."""
    edges = (rows.filter(~F.col("_halo") & F.col(col).isNotNull())
             .groupBy("symbol", "_blk")
             .agg(F.min_by(col, "_pos").alias("_first_nn"), F.max_by(col, "_pos").alias("_last_nn")))
    # "next non-null at or after" is a running last() over the reversed order: a
    # frame ending at unbounded following would be re-aggregated for every row.
    wb = Window.partitionBy("symbol").orderBy("_blk")
    wb_rev = Window.partitionBy("symbol").orderBy(F.col("_blk").desc())
    nb = (blocks.select("symbol", "_blk").join(edges, ["symbol", "_blk"], "left")
          .select("symbol", "_blk",
                  F.last("_first_nn", True).over(wb_rev.rowsBetween(Window.unboundedPreceding, -1)).alias("_next_nn"),
                  F.last("_last_nn", True).over(wb.rowsBetween(Window.unboundedPreceding, -1)).alias("_prev_nn")))
    w_rev = Window.partitionBy("symbol", "_blk").orderBy(F.col("_pos").desc())
    return nb, F.coalesce(
        F.col(col),
        F.last(col, True).over(w_rev.rowsBetween(Window.unboundedPreceding, 0)),
        F.col("_next_nn"),
        F.last(col, True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        F.col("_prev_nn"),
    )


def indicators(ticks: DataFrame, mode: str = "per_row", strict: bool = False, fill: bool = True, extra: bool = False,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """SMA-5, SMA-20, RSI-14, MACD and MACD signal per (symbol, timestamp).

    ``strict`` gives the warm-up variant (SMA null until its window is full,
    RSI null before row 14, no short-series rule).  ``extra`` adds EMA_12,
    EMA_26 and the per-row gain/loss averages.
    """
    if mode not in ("per_row", "series"):
        raise ValueError("mode must be 'per_row' or 'series'")
    # columns of an earlier run, in any case, give way to the new ones
    stale = {c.lower() for c in (*OUT_COLS, "EMA_12", "EMA_26", "avg_gain", "avg_loss")}
    ticks = ticks.select([c for c in ticks.columns if c.lower() not in stale])
    clean = _ensure_seq(clean_ticks(ticks))
    frame = X.WINDOW_ROWS if mode == "per_row" else X.SMA_SLOW
    b = _blocked(clean, frame - 1, block_rows)
    w, r = b.window, b.rows
    price = F.col("price")

    if fill and "volume" in r.columns:
        nb, filled = _fill_columns(r, b.blocks, w, "volume")
        r = r.join(nb, ["symbol", "_blk"], "left").withColumn("volume", filled).drop("_next_nn", "_prev_nn")

    if mode == "series":
        r = with_ema(r, b)

    diff = F.coalesce(price - F.lag(price).over(w), F.lit(0.0))
    r = r.withColumn("_gain", F.greatest(diff, F.lit(0.0))).withColumn("_loss", F.greatest(-diff, F.lit(0.0)))
    avg_gain = F.avg("_gain").over(w.rowsBetween(-(X.RSI_PERIOD - 1), 0))
    avg_loss = F.avg("_loss").over(w.rowsBetween(-(X.RSI_PERIOD - 1), 0))
    rsi_raw = F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + avg_gain / (avg_loss + F.lit(X.RSI_EPS)))
    pos = F.col("_pos")
    if strict:
        rsi = F.when(pos < X.RSI_PERIOD - 1, F.lit(None).cast("double")).otherwise(rsi_raw)
    elif mode == "per_row":
        rsi = F.when(pos < X.RSI_PERIOD - 1, F.lit(50.0)).otherwise(rsi_raw)
    else:
        rsi = F.when(F.col("_total") < X.RSI_PERIOD, F.lit(50.0)).otherwise(rsi_raw)

    def sma(n: int) -> Column:
        frame_w = w.rowsBetween(-(n - 1), 0)
        avg = F.avg(price).over(frame_w)
        if strict:
            return F.when(F.count(price).over(frame_w) == n, avg)
        return avg

    if mode == "per_row":
        r = r.withColumn("_ema", ema_fold(F.collect_list(price).over(w.rowsBetween(-(frame - 1), 0))))
        fast, slow, signal = F.col("_ema.f"), F.col("_ema.s"), F.col("_ema.g")
    else:
        fast, slow, signal = F.col("EMA_12"), F.col("EMA_26"), F.col("MACD_Signal")
    r = r.select(*clean.columns, "_halo", sma(X.SMA_FAST).alias("SMA_5"), sma(X.SMA_SLOW).alias("SMA_20"), rsi.alias("RSI"),
                 (fast - slow).alias("MACD"), signal.alias("MACD_Signal"), fast.alias("EMA_12"), slow.alias("EMA_26"),
                 avg_gain.alias("avg_gain"), avg_loss.alias("avg_loss"))
    return r.filter(~F.col("_halo")).select(*clean.columns, *OUT_COLS, *(["EMA_12", "EMA_26", "avg_gain", "avg_loss"] if extra else []))


def round_for_storage(df: DataFrame) -> DataFrame:
    """Half-even rounding used when persisting: prices/volume/SMA/MACD 2 dp, RSI 1 dp."""
    spec = {"price": 2, "volume": 2, "SMA_5": 2, "SMA_20": 2, "RSI": 1, "MACD": 2, "MACD_Signal": 2}
    # numpy's rounding: half-even on the scaled binary value, then unscale.
    return df.withColumns({c: F.bround(F.col(c) * float(10 ** n), 0) / float(10 ** n)
                           for c, n in spec.items() if c in df.columns})


def strict_indicators(ticks: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Warm-up-strict series indicators, rounded for storage (the sample-loader variant)."""
    return round_for_storage(indicators(ticks, mode="series", strict=True, fill=False, block_rows=block_rows))


def last_n(df: DataFrame, n: int, key="symbol", order="timestamp") -> DataFrame:
    """Newest ``n`` rows per key (planned as a per-partition group limit before the shuffle)."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc(), F.col("seq").desc() if "seq" in df.columns else F.lit(0))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def fill_volume(ticks: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Backward-then-forward fill of missing volume per symbol (W9), block-parallel."""
    clean = _ensure_seq(clean_ticks(ticks))
    b = _blocked(clean, 0, block_rows)
    nb, filled = _fill_columns(b.rows, b.blocks, b.window, "volume")
    r = b.rows.join(nb, ["symbol", "_blk"], "left")
    return r.select(*[c for c in clean.columns if c != "volume"], filled.alias("volume"))
