"""Market queries: indicators, gold table, reads, charts, window state."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.functions import fixed as X
from rivulet.operators import indicators as ind
from rivulet.plans.catalog import register
from rivulet.plans.duck_views import rep_d, rep_ts, with_views
from rivulet.sources import views as V

# ---------------------------------------------------------------------------
# DuckDB twins of the indicator operator
# ---------------------------------------------------------------------------


def _lit(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _fold_sql(lst: str) -> str:
    af, as_, ag = ind.alpha(X.EMA_FAST), ind.alpha(X.EMA_SLOW), ind.alpha(X.EMA_SIGNAL)
    f = f"(acc.f * {_lit(1.0 - af)} + x * {_lit(af)})"
    s = f"(acc.s * {_lit(1.0 - as_)} + x * {_lit(as_)})"
    g = f"(acc.g * {_lit(1.0 - ag)} + ({f} - {s}) * {_lit(ag)})"
    return (f"list_reduce({lst}, lambda acc, x: {{'f': {f}, 's': {s}, 'g': {g}}}, "
            f"{{'f': {lst}[1], 's': {lst}[1], 'g': CAST(0.0 AS DOUBLE)}})")


def indicator_ctes(source: str = "ticks", mode: str = "per_row", strict: bool = False, fill: bool = True):
    """CTEs ``ind_clean .. ind`` computing the indicator columns over ``source``."""
    frame = f"{X.WINDOW_ROWS - 1} PRECEDING" if mode == "per_row" else "UNBOUNDED PRECEDING"
    vol = ("COALESCE(volume, first_value(volume IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY timestamp, seq "
           "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(volume IGNORE NULLS) OVER "
           "(PARTITION BY symbol ORDER BY timestamp, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
           if fill else "volume")
    rsi_raw = "(100.0 - 100.0 / (1.0 + ag / (al + 1e-9)))"
    if strict:
        rsi = f"CASE WHEN pos < {X.RSI_PERIOD - 1} THEN NULL ELSE {rsi_raw} END"
        # in-order sums, as Spark's sliding frame adds them (rounding ties depend on it)
        sma5 = "CASE WHEN n5 = 5 THEN list_reduce(l5, lambda a, x: a + x) / n5 END"
        sma20 = "CASE WHEN n20 = 20 THEN list_reduce(l20, lambda a, x: a + x) / n20 END"
    elif mode == "per_row":
        rsi = f"CASE WHEN pos < {X.RSI_PERIOD - 1} THEN 50.0 ELSE {rsi_raw} END"
        sma5, sma20 = "sma5", "sma20"
    else:
        rsi = f"CASE WHEN total < {X.RSI_PERIOD} THEN 50.0 ELSE {rsi_raw} END"
        sma5, sma20 = "sma5", "sma20"
    return [
        ("ind_clean", f"SELECT symbol, timestamp, price, seq, {vol} AS volume FROM {source} "
                      "WHERE timestamp IS NOT NULL AND symbol IS NOT NULL AND price IS NOT NULL"),
        ("ind_pos", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp, seq) - 1 AS pos, "
                    "count(*) OVER (PARTITION BY symbol) AS total, "
                    "COALESCE(price - lag(price) OVER (PARTITION BY symbol ORDER BY timestamp, seq), 0.0) AS d "
                    "FROM ind_clean"),
        ("ind_win", f"""SELECT *,
              avg(price) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS sma5,
              count(price) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS n5,
              avg(price) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS sma20,
              count(price) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS n20,
              avg(greatest(d, 0.0)) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS ag,
              avg(greatest(-d, 0.0)) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS al,
              list(price) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS l5,
              list(price) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS l20,
              list(price) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN {frame} AND CURRENT ROW) AS pl
            FROM ind_pos"""),
        ("ind", f"""SELECT symbol, timestamp, price, volume, seq, pos, total,
              {sma5} AS SMA_5, {sma20} AS SMA_20, {rsi} AS RSI,
              e.f AS EMA_12, e.s AS EMA_26, e.f - e.s AS MACD, e.g AS MACD_Signal, ag AS avg_gain, al AS avg_loss
            FROM (SELECT *, {_fold_sql('pl')} AS e FROM ind_win)"""),
    ]


def _ind_select(cols: list[str], rnd=None) -> str:
    rnd = rnd or {}
    out = []
    for c in cols:
        if c == "timestamp":
            out.append(f"{rep_ts('timestamp')} AS timestamp")
        elif c in ("symbol", "seq"):
            out.append(c)
        elif c in rnd:
            k = float(10 ** rnd[c])
            out.append(f"{rep_d(f'round_even({c} * {k!r}, 0) / {k!r}')} AS {c}")
        else:
            out.append(f"{rep_d(c)} AS {c}")
    return ", ".join(out)


IND_COLS = ["symbol", "timestamp", "price", "volume", "seq", "SMA_5", "SMA_20", "RSI", "MACD", "MACD_Signal"]


def _ind_sql(cols, mode="per_row", strict=False, fill=True, source="ticks", rnd=None, tail=""):
    return with_views([source], f"SELECT {_ind_select(cols, rnd)} FROM ind {tail}",
                      extra=indicator_ctes(source, mode, strict, fill))


@register("indicators", _ind_sql(IND_COLS))
def q_indicators(spark, sf_dir):
    """Flagship: SMA-5/20, RSI-14, MACD, signal per tick over the trailing 30-row window (per_row)."""
    return ind.indicators(V.ticks(spark, sf_dir)).select(*IND_COLS)


@register("indicators_series", _ind_sql(IND_COLS, mode="series"))
def q_indicators_series(spark, sf_dir):
    """Indicators over each symbol's whole history (series mode)."""
    return ind.indicators(V.ticks(spark, sf_dir), mode="series").select(*IND_COLS)


@register("indicators_by_user", _ind_sql(IND_COLS, source="ticks_by_user"))
def q_indicators_by_user(spark, sf_dir):
    """Per-row indicators over 150+ small symbols (user ids)."""
    return ind.indicators(V.ticks(spark, sf_dir, by="user")).select(*IND_COLS)


SMA_COLS = ["symbol", "timestamp", "seq", "SMA_5", "SMA_20"]


@register("sma", _ind_sql(SMA_COLS))
def q_sma(spark, sf_dir):
    """Simple moving averages over 5 and 20 trailing rows (partial windows average what exists)."""
    return ind.indicators(V.ticks(spark, sf_dir)).select(*SMA_COLS)


RSI_COLS = ["symbol", "timestamp", "seq", "RSI", "avg_gain", "avg_loss"]


@register("rsi", _ind_sql(RSI_COLS))
def q_rsi(spark, sf_dir):
    """RSI-14 with simple means of gains and losses; 50 before the 14th row."""
    return ind.indicators(V.ticks(spark, sf_dir), extra=True).select(*RSI_COLS)


EMA_COLS = ["symbol", "timestamp", "seq", "EMA_12", "EMA_26"]


@register("ema", _ind_sql(EMA_COLS))
def q_ema(spark, sf_dir):
    """EMA-12 and EMA-26 (adjust=False) over the trailing 30-row frame."""
    return ind.indicators(V.ticks(spark, sf_dir), extra=True).select(*EMA_COLS)


@register("macd", with_views(["ticks"], f"""SELECT {_ind_select(["symbol", "timestamp", "seq", "MACD", "MACD_Signal"])},
        {rep_d('MACD - MACD_Signal')} AS MACD_Hist,
        CASE WHEN MACD - MACD_Signal >= 0 THEN 'up' ELSE 'down' END AS hist_sign FROM ind""",
                                  extra=indicator_ctes("ticks")))
def q_macd(spark, sf_dir):
    """MACD = EMA12 - EMA26, its EMA-9 signal, histogram and histogram sign."""
    d = ind.indicators(V.ticks(spark, sf_dir))
    hist = F.col("MACD") - F.col("MACD_Signal")
    return d.select("symbol", "timestamp", "seq", "MACD", "MACD_Signal", hist.alias("MACD_Hist"),
                    F.when(hist >= 0, "up").otherwise("down").alias("hist_sign"))


STRICT_ROUND = {"price": 2, "volume": 2, "SMA_5": 2, "SMA_20": 2, "RSI": 1, "MACD": 2, "MACD_Signal": 2}


@register("strict_indicators", _ind_sql(IND_COLS, mode="series", strict=True, fill=False, rnd=STRICT_ROUND))
def q_strict_indicators(spark, sf_dir):
    """Warm-up-strict indicators (null until the window is full), half-even rounded for storage."""
    return ind.strict_indicators(V.ticks(spark, sf_dir)).select(*IND_COLS)


@register("last_n", with_views(["ticks"], f"""SELECT {_ind_select(IND_COLS, STRICT_ROUND)} FROM (
        SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC, seq DESC) AS rn FROM ind)
        WHERE rn <= 15""", extra=indicator_ctes("ticks", "series", True, False)))
def q_last_n(spark, sf_dir):
    """Newest 15 strict indicator rows per symbol."""
    return ind.last_n(ind.strict_indicators(V.ticks(spark, sf_dir)), 15).select(*IND_COLS)


@register("fill_volume", with_views(["ticks"], f"""SELECT symbol, {rep_ts('timestamp')} AS timestamp, seq,
        {rep_d('price')} AS price, {rep_d('volume')} AS volume FROM ind_clean""",
                                     extra=indicator_ctes("ticks")[:1]))
def q_fill_volume(spark, sf_dir):
    """Backward-then-forward fill of volume within each symbol."""
    return ind.fill_volume(V.ticks(spark, sf_dir)).select("symbol", "timestamp", "seq", "price", "volume")


# ---------------------------------------------------------------------------
# Gold table, reads and charts
# ---------------------------------------------------------------------------

from rivulet.operators import gold as G  # noqa: E402
from rivulet.operators import window_state as WS  # noqa: E402

GOLD_OUT = ["timestamp", "symbol", "price", "volume", "seq", "SMA_5", "SMA_20", "RSI", "MACD", "MACD_Signal"]


def _gold_ctes(source: str):
    return indicator_ctes(source) + [
        ("gold", """SELECT date_trunc('second', timestamp) AS timestamp, symbol, price, volume, seq,
                      SMA_5, SMA_20, RSI, MACD, MACD_Signal
                    FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date_trunc('second', timestamp)
                                                       ORDER BY seq DESC) AS rn FROM ind) WHERE rn = 1""")]


def _gold(spark, sf_dir, by="event"):
    return G.gold_latest(ind.indicators(V.ticks(spark, sf_dir, by=by)))


@register("gold_latest", with_views(["ticks"], f"SELECT {_ind_select(GOLD_OUT)} FROM gold", extra=_gold_ctes("ticks")))
def q_gold_latest(spark, sf_dir):
    """Gold table keyed (symbol, second): the last inserted tick of each second wins."""
    return _gold(spark, sf_dir).select(*GOLD_OUT)


_REQ = """SELECT ticker, upper(COALESCE(NULLIF(ticker, ''), '')) AS ticker_norm,
            CASE WHEN "limit" BETWEEN 1 AND 30 THEN "limit" ELSE 30 END AS limit_norm,
            CASE WHEN action = 'get_indicators' THEN 'get_indicators' ELSE 'get_prices' END AS action_norm,
            "limit", action
          FROM requests"""


def _latest_sql(cols_sql: str) -> str:
    return with_views(["ticks_by_user", "requests"], f"""
        SELECT ticker, rank, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, {cols_sql}
        FROM (SELECT r.ticker, r.limit_norm, g.*,
                     row_number() OVER (PARTITION BY r.ticker ORDER BY g.timestamp DESC, g.symbol) AS rank
              FROM req r JOIN gold g ON starts_with(g.symbol, r.ticker_norm))
        WHERE rank <= limit_norm""", extra=_gold_ctes("ticks_by_user") + [("req", _REQ)])


@register("clamp_requests", with_views(["ticks_by_user", "requests"],
                                        "SELECT ticker, \"limit\", action, ticker_norm, limit_norm, action_norm FROM req",
                                        extra=[("req", _REQ)]))
def q_clamp_requests(spark, sf_dir):
    """Request parameters clamped: limit outside 1..30 -> 30, action normalised, ticker upper-cased."""
    return G.clamp_requests(V.requests(spark, sf_dir)).select(
        "ticker", "limit", "action", "ticker_norm", "limit_norm", "action_norm")


@register("latest_prices", _latest_sql("symbol, " + ", ".join(rep_d(c) + f" AS {c}" for c in ("price", "volume"))))
def q_latest_prices(spark, sf_dir):
    """Newest N price rows per request, symbol = ticker or ticker prefix, newest first."""
    return G.latest_prices(_gold(spark, sf_dir, "user"), V.requests(spark, sf_dir))


_IND9 = ["price", "volume", "SMA_5", "SMA_20", "RSI", "MACD", "MACD_Signal"]


@register("latest_indicators", _latest_sql("symbol, " + ", ".join(rep_d(c) + f" AS {c}" for c in _IND9)))
def q_latest_indicators(spark, sf_dir):
    """Newest N indicator rows per request (9 gold columns)."""
    return G.latest_indicators(_gold(spark, sf_dir, "user"), V.requests(spark, sf_dir))


def _chart_sql() -> str:
    modes = "['comprehensive', 'price_sma', 'rsi', 'macd', 'volume']"
    series = [
        ("TRUE", "'price'", "price", "price"),
        ("mode IN ('price_sma', 'comprehensive') AND h5", "'price'", "SMA_5", "SMA_5"),
        ("mode IN ('price_sma', 'comprehensive') AND h20", "'price'", "SMA_20", "SMA_20"),
        ("(mode = 'rsi' OR (mode = 'comprehensive' AND hr))", "lower", "RSI", "RSI"),
        ("(mode = 'rsi' OR (mode = 'comprehensive' AND hr))", "lower", "overbought", "70.0"),
        ("(mode = 'rsi' OR (mode = 'comprehensive' AND hr))", "lower", "oversold", "30.0"),
        ("mode = 'macd'", "lower", "MACD", "MACD"),
        ("mode = 'macd'", "lower", "MACD_Signal", "MACD_Signal"),
        ("mode = 'macd'", "lower", "MACD_Hist", "MACD - MACD_Signal"),
        ("(mode = 'volume' OR (mode = 'comprehensive' AND NOT hr))", "lower", "volume", "volume"),
    ]
    parts = [f"""SELECT ticker, mode AS chart_mode, {rep_ts('timestamp')} AS timestamp, {panel} AS panel,
                   '{name}' AS series, {rep_d(val)} AS value FROM rows WHERE {cond}"""
             for cond, panel, name, val in series]
    rows = f"""SELECT *, max(CASE WHEN SMA_5 IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY ticker) = 1 AS h5,
                 max(CASE WHEN SMA_20 IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY ticker) = 1 AS h20,
                 max(CASE WHEN RSI IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY ticker) = 1 AS hr,
                 CASE WHEN mode = 'comprehensive' THEN 'lower' ELSE mode END AS lower
          FROM (SELECT r.ticker, r.mode, g.*,
                       row_number() OVER (PARTITION BY r.ticker ORDER BY g.timestamp DESC, g.symbol) AS rank
                FROM creq r JOIN gold g ON starts_with(g.symbol, upper(r.ticker)))
          WHERE rank <= 30"""
    creq = f"""SELECT ticker, list_extract({modes}, (ascii(ticker) % 5) + 1) AS mode FROM requests
               WHERE upper(ticker) NOT IN ('', 'UNKNOWN', 'NONE')"""
    return with_views(["ticks_by_user", "requests"], "\nUNION ALL\n".join(parts),
                      extra=_gold_ctes("ticks_by_user") + [("creq", creq), ("rows", rows)])


@register("chart_panel", _chart_sql())
def q_chart_panel(spark, sf_dir):
    """Chart data per request and mode as long (panel, series, value) rows over the newest 30 rows."""
    reqs = G.chart_requests(V.requests(spark, sf_dir))
    return G.chart_panel(_gold(spark, sf_dir, "user"), reqs)


# ---------------------------------------------------------------------------
# Window state across batches
# ---------------------------------------------------------------------------

CUT = "2024-01-29 00:00:00"


def _split(spark, sf_dir):
    t = ind.clean_ticks(V.ticks(spark, sf_dir))
    cut = F.lit(CUT).cast("timestamp")
    return t.filter(F.col("timestamp") < cut), t.filter(F.col("timestamp") >= cut)


_STATE = [
    ("hist", f"SELECT * FROM ticks WHERE price IS NOT NULL AND timestamp < TIMESTAMP '{CUT}'"),
    ("batch", f"SELECT * FROM ticks WHERE price IS NOT NULL AND timestamp >= TIMESTAMP '{CUT}'"),
    ("state", """SELECT symbol, timestamp, price, volume, seq FROM (SELECT *, row_number() OVER
                   (PARTITION BY symbol ORDER BY timestamp DESC, seq DESC) AS rn FROM hist) WHERE rn <= 30"""),
    ("touched", "SELECT DISTINCT symbol FROM batch"),
    ("both_rows", """SELECT symbol, timestamp, price, volume, seq, 0 AS src FROM state
                  WHERE symbol IN (SELECT symbol FROM touched)
                UNION ALL SELECT symbol, timestamp, price, volume, seq, 1 AS src FROM batch"""),
    ("dedup", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, timestamp ORDER BY src, seq) AS d
                 FROM both_rows) WHERE d = 1"""),
    ("merged", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC, seq DESC)
                  AS rn FROM dedup) WHERE rn <= 30"""),
]


@register("merge_window", with_views(["ticks"], f"""
    SELECT symbol, {rep_ts('timestamp')} AS timestamp, {rep_d('price')} AS price, {rep_d('volume')} AS volume, seq,
           CAST(src AS BIGINT) AS from_batch FROM merged
    UNION ALL
    SELECT symbol, {rep_ts('timestamp')}, {rep_d('price')}, {rep_d('volume')}, seq, CAST(0 AS BIGINT) FROM state
    WHERE symbol NOT IN (SELECT symbol FROM touched)""", extra=_STATE))
def q_merge_window(spark, sf_dir):
    """Stored 30-row tail per symbol merged with a new batch: union, keep-first dedup by timestamp, newest 30."""
    hist, batch = _split(spark, sf_dir)
    return WS.merge_window(WS.initial_state(hist), batch)


@register("enriched_ticks", _ind_sql(IND_COLS, tail=f"WHERE timestamp >= TIMESTAMP '{CUT}'"))
def q_enriched_ticks(spark, sf_dir):
    """Indicators for every row of a new batch, looking back through the stored tail only."""
    hist, batch = _split(spark, sf_dir)
    return WS.enriched_ticks(WS.initial_state(hist), batch).select(*IND_COLS)
