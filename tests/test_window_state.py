import datetime as dt

from rivulet.operators import gold as G
from rivulet.operators import window_state as WS

T0 = dt.datetime(2026, 7, 18, 10, 0)
SCHEMA = "symbol string, timestamp timestamp, price double, volume double, seq long"


def ticks(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_merge_one_stored_two_new_then_one_more(spark):
    state = ticks(spark, [("ETH", T0, 3000.0, 10.0, 1)])
    batch = ticks(spark, [("ETH", T0 + dt.timedelta(minutes=1), 3010.0, 5.0, 2),
                          ("ETH", T0 + dt.timedelta(minutes=2), 3020.0, 8.0, 3)])
    s1 = WS.merge_window(state, batch)
    prices = [r["price"] for r in s1.orderBy("timestamp").collect()]
    assert prices == [3000.0, 3010.0, 3020.0]
    s2 = WS.merge_window(s1.drop("from_batch"), ticks(spark, [("ETH", T0 + dt.timedelta(minutes=3), 3030.0, 2.0, 4)]))
    rows = s2.orderBy("timestamp").collect()
    assert len(rows) == 4 and rows[-1]["price"] == 3030.0


def test_merge_keeps_newest_30_and_first_on_equal_timestamp(spark):
    state = ticks(spark, [("A", T0, 1.0, 1.0, 1)])
    batch = ticks(spark, [("A", T0 + dt.timedelta(seconds=i), float(i), 1.0, 100 + i) for i in range(35)])
    out = WS.merge_window(state, batch).collect()
    assert len(out) == 30 and min(r["price"] for r in out) == 5.0
    st = WS.merge_window(state, ticks(spark, [("A", T0, 9.0, 1.0, 2)])).collect()
    assert len(st) == 1 and st[0]["price"] == 1.0


def test_gold_latest_two_ticks_in_one_second(spark):
    df = ticks(spark, [("HPG", T0, 1.0, 1.0, 1), ("HPG", T0 + dt.timedelta(milliseconds=400), 2.0, 1.0, 2)])
    out = G.gold_latest(df).collect()
    assert len(out) == 1 and out[0]["seq"] == 2 and out[0]["price"] == 2.0


def test_enriched_ticks_equal_full_history(spark):
    from rivulet.operators import indicators as ind
    rows = [("S", T0 + dt.timedelta(minutes=i), 100.0 + (i % 7) - i * 0.3, 1.0, i) for i in range(80)]
    full = ind.indicators(ticks(spark, rows)).filter("seq >= 60").orderBy("seq").toPandas()
    state = WS.initial_state(ticks(spark, rows[:60]))
    inc = WS.enriched_ticks(state, ticks(spark, rows[60:])).orderBy("seq").toPandas()
    assert len(inc) == 20
    for c in ("SMA_5", "SMA_20", "RSI", "MACD", "MACD_Signal"):
        assert (abs(full[c] - inc[c]) < 1e-12).all(), c


def test_clamp_and_prefix_reads(spark):
    gold = ticks(spark, [("BTCUSDT", T0 + dt.timedelta(seconds=i), float(i), 1.0, i) for i in range(40)] +
                 [("ETH", T0, 5.0, 1.0, 99)])
    req = spark.createDataFrame([(1, "btc", 0, "x"), (2, "BTC", 31, "get_indicators"), (3, "BTC", 5, "x"),
                                 (4, "", 3, "x")], "request_id long, ticker string, limit int, action string")
    c = {r["limit"]: r for r in G.clamp_requests(req).collect()}
    assert c[0]["limit_norm"] == 30 and c[31]["limit_norm"] == 30 and c[5]["limit_norm"] == 5
    assert c[31]["action_norm"] == "get_indicators" and c[0]["ticker_norm"] == "BTC"
    out = G.latest_prices(gold, req, key="request_id").collect()
    by = {}
    for r in out:
        by.setdefault(r["request_id"], []).append(r)
    assert len(by[1]) == 30 and len(by[2]) == 30 and len(by[3]) == 5 and len(by[4]) == 3
    assert max(r["price"] for r in by[1]) == 39.0 and min(r["price"] for r in by[3]) == 35.0
