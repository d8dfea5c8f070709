"""Gold table semantics and reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions import fixed as X

GOLD_COLS = ["timestamp", "symbol", "price", "volume", "SMA_5", "SMA_20", "RSI", "MACD", "MACD_Signal"]
GOLD_RENAME = {"sma_5": "SMA_5", "sma_20": "SMA_20", "rsi": "RSI", "macd": "MACD", "macd_signal": "MACD_Signal"}


def to_gold_schema(df: DataFrame) -> DataFrame:
    """Lower-case all names, map them to the gold names, parse the timestamp."""
    lowered = df.toDF(*[c.lower() for c in df.columns])
    renamed = lowered.withColumnsRenamed({k: v for k, v in GOLD_RENAME.items() if k in lowered.columns})
    if "timestamp" in renamed.columns and dict(renamed.dtypes)["timestamp"] == "string":
        renamed = renamed.withColumn("timestamp", F.try_to_timestamp("timestamp"))
    return renamed


def gold_latest(df: DataFrame, seq_col: str = "seq") -> DataFrame:
    """One row per (symbol, second): the last inserted wins (S9, replace-on-merge).

    An aggregate with ``max_by`` rather than a window: partial aggregation runs
    before the shuffle, so a hot (symbol, second) never ships all its rows.
    """
    sec = F.date_trunc("second", F.col("timestamp"))
    payload = [c for c in df.columns if c not in ("symbol", "timestamp")]
    values = F.struct(*[F.col(c) for c in payload])
    # equal arrivals are settled by time and values, so that every run gives the same row
    latest = F.max_by(values, F.struct(F.col(seq_col), F.col("timestamp"), values))
    out = df.groupBy(F.col("symbol"), sec.alias("timestamp")).agg(latest.alias("_r"))
    return out.select("timestamp", "symbol", *[F.col(f"_r.{c}").alias(c) for c in payload])


def clamp_requests(req: DataFrame, target: Column | None = None) -> DataFrame:
    """Limit outside 1..30 -> 30; action normalised; ticker upper-cased with fallback to the target."""
    lim = F.col("limit")
    tgt = target if target is not None else F.lit(None).cast("string")
    ticker = F.upper(F.coalesce(F.nullif(F.col("ticker"), F.lit("")), tgt, F.lit("")))
    return req.select(
        "*",
        ticker.alias("ticker_norm"),
        F.when(lim.between(1, X.MAX_LIMIT), lim).otherwise(F.lit(X.MAX_LIMIT)).alias("limit_norm"),
        F.when(F.col("action") == "get_indicators", F.lit("get_indicators"))
         .otherwise(F.lit("get_prices")).alias("action_norm"),
    )


def resolve_tickers(req_tickers: DataFrame, symbols: DataFrame, ticker_col: str = "ticker") -> DataFrame:
    """Pairs (ticker, symbol) where symbol equals or starts with the ticker.

    A prefix predicate between two tables would plan a nested-loop join; here
    each distinct symbol is expanded to its prefixes (bounded by symbol length)
    and matched by equality, so it stays a hash join.  The empty ticker
    matches every symbol.  ``%`` and ``_`` in tickers are taken literally.
    """
    prefixes = symbols.select(
        "symbol",
        F.explode(F.transform(F.sequence(F.lit(0), F.length("symbol")),
                              lambda n: F.substring(F.col("symbol"), 1, n))).alias("_prefix"))
    prefixes = prefixes.withColumn("_prefix", F.when(F.col("_prefix").isNull(), F.lit("")).otherwise(F.col("_prefix")))
    return req_tickers.join(prefixes, req_tickers[ticker_col] == prefixes["_prefix"]).drop("_prefix")


def newest_per_key(df: DataFrame, n: int, key: str, order: list) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)


def latest_rows(gold: DataFrame, requests: DataFrame, columns: list, oldest: bool = False,
                key: str = "ticker") -> DataFrame:
    """Newest (or oldest) N rows per request across the symbols its ticker matches.

    ``key`` identifies a request (the ticker itself when tickers are unique).

    Every request takes at most 30 rows, so each symbol is first cut to its own
    30 newest (oldest) rows - a per-partition group limit before any shuffle -
    and only those meet the requests.
    """
    direction = (lambda c: F.col(c).asc()) if oldest else (lambda c: F.col(c).desc())
    order = [direction("timestamp"), F.col("symbol").asc()]
    pre = newest_per_key(gold, X.MAX_LIMIT, "symbol", order).drop("_rn")
    symbols = pre.select("symbol").distinct()
    req = clamp_requests(requests)
    ids = [key] if key == "ticker" else [key, "ticker"]
    pairs = resolve_tickers(req.select(*ids, "ticker_norm", "limit_norm"), symbols, "ticker_norm")
    joined = pairs.join(pre, "symbol")
    w = Window.partitionBy(key).orderBy(*order)
    # the literal bound lets Spark keep 30 rows a request in each partition before the shuffle
    ranked = (joined.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= X.MAX_LIMIT)
              .filter(F.col("rank") <= F.col("limit_norm")))
    return ranked.select(*ids, "rank", *columns)


def render_seconds(df: DataFrame, col: str = "timestamp") -> DataFrame:
    """Timestamp rendered as ``yyyy-MM-dd HH:mm:ss``."""
    return df.withColumn(col, F.date_format(col, "yyyy-MM-dd HH:mm:ss"))


PRICE_COLS = ["timestamp", "symbol", "price", "volume"]
INDICATOR_COLS = GOLD_COLS


def latest_prices(gold: DataFrame, requests: DataFrame, key: str = "ticker") -> DataFrame:
    return render_seconds(latest_rows(gold, requests, PRICE_COLS, key=key))


def latest_indicators(gold: DataFrame, requests: DataFrame, key: str = "ticker") -> DataFrame:
    return render_seconds(latest_rows(gold, requests, INDICATOR_COLS, key=key))


def chart_requests(requests: DataFrame) -> DataFrame:
    """Chart mode per request; empty / UNKNOWN / NONE tickers rejected."""
    modes = F.array(*[F.lit(m) for m in X.CHART_MODES])
    r = requests.select("ticker", F.element_at(modes, (F.pmod(F.ascii("ticker"), F.lit(5)) + 1).cast("int"))
                        .alias("chart_mode"))
    return r.filter(~F.upper(F.col("ticker")).isin("", "UNKNOWN", "NONE"))


def chart_panel(gold: DataFrame, chart_reqs: DataFrame, oldest: bool = False) -> DataFrame:
    """Plot data per chart request as long rows (ticker, chart_mode, timestamp, panel, series, value).

    Series: price in the price panel for every mode; rsi -> RSI with 30/70 bands;
    macd -> MACD, signal, histogram; volume -> volume; price_sma -> SMA-5/20 in
    the price panel; comprehensive -> SMAs in the price panel and RSI (with
    bands) below, or volume when RSI is null on every row.  SMA lines are
    drawn only when not null on every row.
    """
    req = chart_reqs.select("ticker", "chart_mode", F.lit(30).alias("limit"), F.lit("get_indicators").alias("action"))
    rows = latest_rows(gold, req, INDICATOR_COLS, oldest=oldest).join(chart_reqs, "ticker")
    w = Window.partitionBy("ticker")
    rows = rows.withColumns({f"_has_{c}": F.max(F.col(c).isNotNull().cast("int")).over(w) == 1
                             for c in ("SMA_5", "SMA_20", "RSI")})
    has = {c: F.col(f"_has_{c}") for c in ("SMA_5", "SMA_20", "RSI")}
    mode = F.col("chart_mode")
    hist = F.col("MACD") - F.col("MACD_Signal")
    sma_mode = mode.isin("price_sma", "comprehensive")
    rsi_mode = (mode == "rsi") | ((mode == "comprehensive") & has["RSI"])
    vol_mode = (mode == "volume") | ((mode == "comprehensive") & ~has["RSI"])
    lower = F.when(mode == "comprehensive", F.lit("lower")).otherwise(mode)
    entries = [
        (F.lit(True), F.lit("price"), "price", F.col("price")),
        (sma_mode & has["SMA_5"], F.lit("price"), "SMA_5", F.col("SMA_5")),
        (sma_mode & has["SMA_20"], F.lit("price"), "SMA_20", F.col("SMA_20")),
        (rsi_mode, lower, "RSI", F.col("RSI")),
        (rsi_mode, lower, "overbought", F.lit(70.0)),
        (rsi_mode, lower, "oversold", F.lit(30.0)),
        (mode == "macd", lower, "MACD", F.col("MACD")),
        (mode == "macd", lower, "MACD_Signal", F.col("MACD_Signal")),
        (mode == "macd", lower, "MACD_Hist", hist),
        (vol_mode, lower, "volume", F.col("volume")),
    ]
    arr = F.array(*[F.when(cond, F.struct(panel.alias("panel"), F.lit(name).alias("series"),
                                          val.cast("double").alias("value")))
                    for cond, panel, name, val in entries])
    out = rows.select("ticker", "chart_mode", "timestamp", F.explode(F.filter(arr, lambda x: x.isNotNull())).alias("e"))
    return out.select("ticker", "chart_mode", "timestamp", "e.panel", "e.series", "e.value")
