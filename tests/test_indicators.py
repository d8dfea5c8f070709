import datetime as dt

import numpy as np
import pytest

from rivulet.operators import indicators as ind


def frame(spark, prices, symbol="BTC", start=dt.datetime(2026, 1, 1), step=dt.timedelta(days=1), volume=None):
    rows = [(symbol, start + i * step, float(p), None if volume is None else volume[i], i) for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, "symbol string, timestamp timestamp, price double, volume double, seq long")


def collect(df):
    return df.orderBy("symbol", "timestamp").toPandas()


def recurrence(prices):
    """Indicator rows by plain recurrences over a price list."""
    rows, ema, k = [], {}, {12: 2 / 13, 26: 2 / 27, 9: 2 / 10}

    def smooth(n, x):
        ema[n] = x if n not in ema else ema[n] + k[n] * (x - ema[n])
        return ema[n]

    moves = [0.0, *(b - a for a, b in zip(prices, prices[1:]))]
    for t, p in enumerate(prices):
        macd = smooth(12, p) - smooth(26, p)
        last = moves[max(0, t - 13):t + 1]
        up, down = sum(m for m in last if m > 0) / len(last), -sum(m for m in last if m < 0) / len(last)
        rows.append({"SMA_5": float(np.mean(prices[max(0, t - 4):t + 1])), "SMA_20": float(np.mean(prices[max(0, t - 19):t + 1])),
                     "RSI": 50.0 if len(prices) < 14 else 100 - 100 / (1 + up / (down + 1e-9)), "MACD": macd, "MACD_Signal": smooth(9, macd)})
    return rows


def test_thirty_rising_rows_have_all_columns(spark):
    out = collect(ind.indicators(frame(spark, [100 + 2 * i for i in range(30)])))
    assert len(out) == 30
    for c in ("SMA_5", "SMA_20", "RSI", "MACD", "MACD_Signal"):
        assert c in out.columns
    assert not out["SMA_5"].isna().any()


def test_sma5_rows_1_and_6(spark):
    out = collect(ind.indicators(frame(spark, [100 + 2 * i for i in range(10)])))
    assert out["SMA_5"][0] == 100.0 and out["SMA_5"][5] == 106.0


@pytest.mark.parametrize("mode,row0", [("series", 0.0), ("per_row", 50.0)])
def test_rsi_first_row(spark, mode, row0):
    out = collect(ind.indicators(frame(spark, np.linspace(10, 20, 20)), mode=mode))
    assert out["RSI"][0] == row0


def test_rsi_short_series_is_50(spark):
    for mode in ("series", "per_row"):
        out = collect(ind.indicators(frame(spark, np.linspace(10, 20, 13)), mode=mode))
        assert (out["RSI"] == 50.0).all()


def test_rsi_constant_prices_is_zero(spark):
    out = collect(ind.indicators(frame(spark, [100.0] * 20), mode="series"))
    assert (out["RSI"] == 0.0).all()


def test_macd_first_row_and_constant(spark):
    out = collect(ind.indicators(frame(spark, [5.0, 7.0, 6.0, 9.0])))
    assert out["MACD"][0] == 0.0 and out["MACD_Signal"][0] == 0.0
    const = collect(ind.indicators(frame(spark, [42.0] * 40)))
    assert np.allclose(const["MACD"], 0.0, atol=1e-12) and np.allclose(const["MACD_Signal"], 0.0, atol=1e-12)


def test_series_mode_matches_recurrence(spark):
    rng = np.random.default_rng(7)
    prices = np.round(100 + np.cumsum(rng.normal(0, 1, 700)), 2)
    out = collect(ind.indicators(frame(spark, prices, step=dt.timedelta(hours=1)), mode="series", block_rows=50))
    ref = recurrence(prices.tolist())
    for c in ("SMA_5", "SMA_20", "RSI", "MACD", "MACD_Signal"):
        assert np.allclose(out[c].to_numpy(), [r[c] for r in ref], rtol=0, atol=1e-9), c


def test_per_row_mode_matches_recurrence_on_30_row_windows(spark):
    rng = np.random.default_rng(3)
    prices = np.round(50 + np.cumsum(rng.normal(0, 1, 120)), 2)
    out = collect(ind.indicators(frame(spark, prices, step=dt.timedelta(minutes=7)), block_rows=5))
    for t in range(len(prices)):
        window = prices[max(0, t - 29): t + 1]
        ref = recurrence(window.tolist())[-1]
        for c in ("SMA_5", "SMA_20", "MACD", "MACD_Signal"):
            assert abs(out[c][t] - ref[c]) < 1e-9, (t, c)
        rsi = 50.0 if t < 13 else ref["RSI"]
        assert abs(out["RSI"][t] - rsi) < 1e-9


def test_halo_blocks_equal_unblocked(spark, sf):
    from rivulet.sources.views import ticks
    t = ticks(spark, sf, by="event")
    cols = ["symbol", "seq", "SMA_5", "SMA_20", "RSI", "MACD", "MACD_Signal"]
    a = ind.indicators(t).select(*cols).toPandas().sort_values(["symbol", "seq"])
    b = ind.indicators(t, block_rows=7).select(*cols).toPandas().sort_values(["symbol", "seq"])
    assert len(a) == len(b)
    for c in cols[2:]:
        assert np.allclose(a[c].to_numpy(), b[c].to_numpy(), atol=1e-12), c


def test_fill_volume_backward_then_forward(spark):
    df = frame(spark, [1, 2, 3, 4, 5, 6], volume=[None, 10.0, None, None, 20.0, None],
               step=dt.timedelta(hours=9))
    out = collect(ind.fill_volume(df, block_rows=2))
    assert out["volume"].tolist() == [10.0, 10.0, 20.0, 20.0, 20.0, 20.0]


def test_strict_variant_nulls_until_full_and_rounds(spark):
    out = collect(ind.strict_indicators(frame(spark, [100 + i * 1.005 for i in range(25)])))
    assert out["SMA_5"][:4].isna().all() and out["SMA_5"][4:].notna().all()
    assert out["SMA_20"][:19].isna().all()
    assert out["RSI"][:13].isna().all() and out["RSI"][13:].notna().all()
    assert (np.round(out["MACD"], 2) == out["MACD"]).all()


def test_last_n_keeps_newest(spark):
    out = ind.last_n(frame(spark, range(40)), 15).toPandas()
    assert len(out) == 15 and out["seq"].min() == 25


def test_stale_columns_in_any_case_are_replaced(spark):
    df = frame(spark, [100 + 2 * i for i in range(30)])
    again = ind.indicators(ind.indicators(df).withColumnRenamed("RSI", "rsi").withColumnRenamed("MACD", "Macd"))
    a, b = collect(ind.indicators(df)), collect(again)
    assert list(a.columns) == list(b.columns) and np.allclose(a["RSI"], b["RSI"]) and np.allclose(a["MACD"], b["MACD"])


def test_series_mode_is_exact_over_many_blocks(spark):
    """10,000 rows of one symbol in one second, and one short symbol, against the recurrence over all rows."""
    rng = np.random.default_rng(11)
    prices = np.round(1000 + np.cumsum(rng.normal(0, 3, 10_000)), 2)
    at = dt.datetime(2026, 1, 1)
    rows = [("HOT", at, float(p), 1.0, i) for i, p in enumerate(prices)] + [("LOW", at, 5.0 + i, 1.0, 20_000 + i) for i in range(5)]
    df = spark.createDataFrame(rows, "symbol string, timestamp timestamp, price double, volume double, seq long").repartition(8)
    got = ind.indicators(df, mode="series", extra=True).orderBy("symbol", "seq").toPandas()
    for symbol, own in (("HOT", prices.tolist()), ("LOW", [5.0 + i for i in range(5)])):
        mine = got[got["symbol"] == symbol]
        ref = recurrence(own)
        for c in ("SMA_5", "SMA_20", "RSI", "MACD", "MACD_Signal"):
            assert np.allclose(mine[c].to_numpy(), [r[c] for r in ref], rtol=0, atol=1e-9), (symbol, c)
    assert np.allclose((got["EMA_12"] - got["EMA_26"]).to_numpy(), got["MACD"].to_numpy(), atol=1e-12)


def test_one_instant_spreads_over_tasks_and_blocks(spark):
    from rivulet.operators.blocks import with_halo
    df = spark.range(40_000).selectExpr("'S' as symbol", "timestamp'2026-01-01 00:00:00' as timestamp", "id as seq")
    b = with_halo(df, ["symbol"], ["timestamp", "seq"], 29, block_rows=1_000)
    rows = b.rows.groupBy("_blk").count().collect()
    assert len(rows) == 40 and {r["count"] for r in rows} == {1_000, 1_029}
    assert b.own.filter("_pos <> seq").count() == 0 and b.own.filter("_total <> 40000").count() == 0
