import json

from rivulet.operators import bronze as B


def records(spark, values):
    rows = [("bronze_market", 0, 10 + i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "topic string, partition int, offset long, value string")


def env(ts="2026-07-18 11:00:00.000", price=60000.0, volume=1.5, drop=None):
    payload = {"symbol": "BTCUSDT", "price": price, "volume": volume}
    if drop:
        payload.pop(drop)
    body = {"payload": payload}
    if ts is not None:
        body["ingest_timestamp"] = ts
    return json.dumps(body)


def test_valid_message_is_stored_not_dead_lettered(spark):
    p = B.parse_market(records(spark, [env()]))
    assert B.market_valid(p).count() == 1 and B.dead_letters(p).count() == 0


def test_malformed_goes_to_dlq_with_offset_topic_payload(spark):
    p = B.parse_market(spark.createDataFrame([("bronze_market", 0, 13, "invalid-json")],
                                             "topic string, partition int, offset long, value string"))
    d = B.dead_letters(p).collect()
    assert len(d) == 1 and d[0]["offset"] == 13 and d[0]["original_topic"] == "bronze_market"
    assert "invalid-json" in d[0]["raw_payload"] and B.market_valid(p).count() == 0


def test_timestamp_canonicalisation(spark):
    vals = [env("2026-07-18 11:00:00"), env("yesterday"), env(None), env("2026-07-18 11:00:00.123456")]
    p = B.parse_market(records(spark, vals), as_of="2030-01-01 00:00:00.000000").orderBy("offset").collect()
    assert p[0]["ts_str"] == "2026-07-18 11:00:00.000000"
    assert p[1]["ts_str"] == "2030-01-01 00:00:00.000000" and p[1]["error_message"] is None
    assert p[2]["error_message"] == "missing_timestamp"
    assert p[3]["ts_str"] == "2026-07-18 11:00:00.123456"


def test_price_coercion(spark):
    vals = [env(price="12.5"), env(price="abc"), env(drop="price"), '{"payload": {"symbol": "X", "price": NaN, "volume": 1}, "ingest_timestamp": "2026-07-18 11:00:00"}']
    p = B.parse_market(records(spark, vals)).orderBy("offset").collect()
    assert p[0]["error_message"] is None and p[0]["price"] == 12.5
    assert p[1]["error_message"] == "bad_price"
    assert p[2]["error_message"] == "missing_fields"
    assert p[3]["error_message"] is not None


def test_news_contract_allows_null_values(spark):
    v = [json.dumps({"ingest_timestamp": None, "payload": {"title": None, "summary": "s", "link": "l"}}),
         json.dumps({"payload": {"title": "t", "summary": "s"}})]
    p = B.parse_news(spark.createDataFrame([("n", 0, i, x) for i, x in enumerate(v)],
                                           "topic string, partition int, offset long, value string"))
    assert B.news_valid(p).count() == 1 and B.dead_letters(p).count() == 1


def test_feed_normalisation_fallbacks(spark):
    rows = [("f", 1, None, "http://a", "t1", None, "d1", None),
            ("f", 2, "g2", "http://b", "t2", "s2", "d2", "2024-01-02"),
            ("f", 3, None, None, "t3", "s3", "d3", None),
            ("f", 4, "g4", "http://d", "t4", "s4", "d4", None),
            ("h", 1, "g2", "http://e", "t5", "s5", "d5", None)]
    e = spark.createDataFrame(rows, "feed string, pos long, id string, link string, title string, summary string, "
                                    "description string, published string")
    out = {r["guid"]: r for r in B.normalize_feed(e, as_of_date="2026-01-01").collect()}
    assert set(out) == {"http://a", "g2"}            # first 3 per feed, empty guid skipped, g2 kept once
    assert out["http://a"]["summary"] == "d1" and out["http://a"]["published"] == "2026-01-01"
    assert out["g2"]["feed"] == "f"
