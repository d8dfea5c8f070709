"""Bronze queries: envelope normalisation, contract checks, dead letters, feeds."""

from __future__ import annotations

from rivulet.operators import bronze as B
from rivulet.plans.catalog import register
from rivulet.plans.duck_views import rep_d, rep_ts, with_views
from rivulet.sources import views as V

AS_OF = B.DEFAULT_AS_OF


def _canon(raw: str) -> str:
    return f"""CASE WHEN {raw} IS NULL THEN NULL
        WHEN try_strptime({raw}, '%Y-%m-%d %H:%M:%S.%f') IS NOT NULL THEN {raw}
        WHEN try_strptime({raw}, '%Y-%m-%d %H:%M:%S') IS NOT NULL
             THEN strftime(try_strptime({raw}, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') || '.000000'
        ELSE '{AS_OF}' END"""


_MARKET = [
    ("mp", """SELECT topic, partition, "offset", value,
                CASE WHEN json_valid(value) THEN CAST(value AS JSON) END AS j FROM raw_market"""),
    ("mf", """SELECT *, json_extract_string(j, '$.ingest_timestamp') AS ts_raw,
                TRY_CAST(json_extract_string(j, '$.payload.price') AS DOUBLE) AS price,
                TRY_CAST(json_extract_string(j, '$.payload.volume') AS DOUBLE) AS volume,
                json_extract_string(j, '$.payload.symbol') AS symbol,
                (json_extract(j, '$.payload') IS NOT NULL AND json_extract(j, '$.payload.symbol') IS NOT NULL
                 AND json_extract(j, '$.payload.price') IS NOT NULL
                 AND json_extract(j, '$.payload.volume') IS NOT NULL) AS has_all
              FROM mp"""),
    ("me", f"""SELECT *, CASE WHEN j IS NULL THEN 'invalid_json' WHEN NOT has_all THEN 'missing_fields'
                 WHEN ts_raw IS NULL THEN 'missing_timestamp'
                 WHEN price IS NULL OR isnan(price) THEN 'bad_price'
                 WHEN volume IS NULL OR isnan(volume) THEN 'bad_volume' END AS error_message,
                 {_canon('ts_raw')} AS ts_str
               FROM mf"""),
]


@register("market_valid", with_views(["raw_market"], f"""
    SELECT "offset", ts_str, {rep_ts("try_strptime(ts_str, '%Y-%m-%d %H:%M:%S.%f')")} AS timestamp, symbol,
           {rep_d('price')} AS price, {rep_d('volume')} AS volume
    FROM me WHERE error_message IS NULL""", extra=_MARKET))
def q_market_valid(spark, sf_dir):
    """Market envelopes that pass the contract, with canonical timestamps."""
    return B.market_valid(B.parse_market(V.raw_market(spark, sf_dir)))


@register("market_dlq", with_views(["raw_market"], f"""
    SELECT error_message, '{AS_OF}' AS fail_timestamp, topic AS original_topic, CAST(partition AS BIGINT) AS partition,
           "offset", value AS raw_payload
    FROM me WHERE error_message IS NOT NULL""", extra=_MARKET))
def q_market_dlq(spark, sf_dir):
    """Dead letters of the market topic with reason, topic, partition, offset and raw payload."""
    return B.dead_letters(B.parse_market(V.raw_market(spark, sf_dir)))


@register("canonical_ts", with_views(["raw_market"], """
    SELECT "offset", ts_raw, ts_str FROM me WHERE j IS NOT NULL""", extra=_MARKET))
def q_canonical_ts(spark, sf_dir):
    """Timestamp canonicalisation of every parseable market envelope."""
    from pyspark.sql import functions as F
    p = B.parse_market(V.raw_market(spark, sf_dir)).filter(F.col("error_message").isNull() |
                                                            (F.col("error_message") != "invalid_json"))
    raw = F.try_variant_get(F.try_parse_json("value"), "$.ingest_timestamp", "string")
    return p.select("offset", raw.alias("ts_raw"), "ts_str")


_NEWS = [
    ("np", """SELECT topic, partition, "offset", value,
                CASE WHEN json_valid(value) THEN CAST(value AS JSON) END AS j FROM raw_news"""),
    ("ne", """SELECT *, CASE WHEN j IS NULL THEN 'invalid_json'
                 WHEN NOT (json_extract(j, '$.payload') IS NOT NULL AND json_extract(j, '$.payload.title') IS NOT NULL
                           AND json_extract(j, '$.payload.summary') IS NOT NULL
                           AND json_extract(j, '$.payload.link') IS NOT NULL) THEN 'missing_fields' END AS error_message,
                json_extract_string(j, '$.ingest_timestamp') AS ingest_timestamp,
                json_extract_string(j, '$.payload.title') AS title,
                json_extract_string(j, '$.payload.summary') AS summary,
                json_extract_string(j, '$.payload.link') AS link
              FROM np"""),
]


@register("news_valid", with_views(["raw_news"], """
    SELECT "offset", ingest_timestamp, title, summary, link FROM ne WHERE error_message IS NULL""", extra=_NEWS))
def q_news_valid(spark, sf_dir):
    """News envelopes carrying title, summary and link keys."""
    return B.news_valid(B.parse_news(V.raw_news(spark, sf_dir)))


@register("news_dlq", with_views(["raw_news"], f"""
    SELECT error_message, '{AS_OF}' AS fail_timestamp, topic AS original_topic, CAST(partition AS BIGINT) AS partition,
           "offset", value AS raw_payload FROM ne WHERE error_message IS NOT NULL""", extra=_NEWS))
def q_news_dlq(spark, sf_dir):
    """Dead letters of the news topic."""
    return B.dead_letters(B.parse_news(V.raw_news(spark, sf_dir)))


@register("normalize_trades", with_views(["raw_trades"], f"""
    SELECT seq, {rep_ts('timestamp')} AS ingest_timestamp, 'exchange_trades' AS data_source, 'CRYPTO' AS asset_class,
           symbol, {rep_d('price')} AS price, {rep_d('volume')} AS volume
    FROM (SELECT seq, timestamp, json_extract_string(d, '$.s') AS symbol,
                 TRY_CAST(json_extract_string(d, '$.p') AS DOUBLE) AS price,
                 TRY_CAST(json_extract_string(d, '$.q') AS DOUBLE) AS volume
          FROM (SELECT seq, timestamp, COALESCE(json_extract(value, '$.data'), CAST(value AS JSON)) AS d FROM raw_trades))
    WHERE symbol IS NOT NULL AND price IS NOT NULL AND volume IS NOT NULL"""))
def q_normalize_trades(spark, sf_dir):
    """Exchange trade messages (optionally wrapped in ``data``) mapped to market envelopes."""
    return B.normalize_trades(V.raw_trades(spark, sf_dir))


@register("latest_quote", with_views(["ticks_by_user"], f"""
    SELECT symbol, {rep_ts('timestamp')} AS timestamp, {rep_d('price')} AS price, {rep_d('volume')} AS volume, seq
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC, seq DESC) AS rn FROM ticks_by_user)
    WHERE rn = 1"""))
def q_latest_quote(spark, sf_dir):
    """Latest quote (price, volume) per symbol."""
    return B.latest_quote(V.ticks(spark, sf_dir, by="user"))


_FEED = [
    ("ff", """SELECT feed, pos, COALESCE(id, link, '') AS guid, COALESCE(title, '') AS title,
                COALESCE(summary, description, '') AS summary, COALESCE(link, '') AS link,
                COALESCE(published, '2026-01-01') AS published
              FROM (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY pos) AS rn FROM feed_entries)
              WHERE rn <= 3"""),
    ("fn", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY guid ORDER BY feed, pos) AS g FROM ff
              WHERE guid <> '') WHERE g = 1"""),
]


@register("normalize_feed", with_views(["feed_entries"], f"""
    SELECT feed, pos, guid, title, summary, link, published, '{AS_OF}' AS ingest_timestamp FROM fn""", extra=_FEED))
def q_normalize_feed(spark, sf_dir):
    """First 3 entries per feed with guid, summary and published fallbacks, each guid once."""
    return B.normalize_feed(V.feed_entries(spark, sf_dir))


@register("new_articles", with_views(["feed_entries"], """
    SELECT feed, pos, guid, title, link FROM (
      SELECT *, row_number() OVER (PARTITION BY guid ORDER BY feed, pos) AS g FROM (
        SELECT feed, pos, COALESCE(id, link, '') AS guid, title, link FROM feed_entries) e
      WHERE guid <> '' AND guid NOT IN (SELECT guid FROM fn)) WHERE g = 1""", extra=_FEED))
def q_new_articles(spark, sf_dir):
    """Feed entries not seen in the first poll (first 3 per feed), each guid once."""
    entries = V.feed_entries(spark, sf_dir)
    return B.new_articles(entries, B.normalize_feed(entries))


@register("clean_ticks", with_views(["raw_market"], f"""
    SELECT "offset", {rep_ts('ts')} AS timestamp, symbol, {rep_d('price')} AS price, {rep_d('volume')} AS volume
    FROM (SELECT "offset",
            COALESCE(try_strptime(t, '%Y-%m-%d %H:%M:%S.%f'), try_strptime(t, '%Y-%m-%d %H:%M:%S'),
                     try_strptime(t, '%Y-%m-%d')) AS ts,
            json_extract_string(j, '$.payload.symbol') AS symbol,
            CASE WHEN isnan(TRY_CAST(json_extract_string(j, '$.payload.price') AS DOUBLE)) THEN NULL
                 ELSE TRY_CAST(json_extract_string(j, '$.payload.price') AS DOUBLE) END AS price,
            TRY_CAST(json_extract_string(j, '$.payload.volume') AS DOUBLE) AS volume
          FROM (SELECT "offset", j, json_extract_string(j, '$.ingest_timestamp') AS t
                FROM (SELECT "offset", CASE WHEN json_valid(value) THEN CAST(value AS JSON) END AS j FROM raw_market)))
    WHERE ts IS NOT NULL AND symbol IS NOT NULL AND price IS NOT NULL"""))
def q_clean_ticks(spark, sf_dir):
    """Loose tick coercion without the contract: price to double, timestamp parsed, incomplete rows dropped."""
    from pyspark.sql import functions as F

    from rivulet.operators.indicators import clean_ticks
    v = F.try_parse_json("value")
    loose = B.fence(V.raw_market(spark, sf_dir).select(
        "offset", F.try_variant_get(v, "$.ingest_timestamp", "string").alias("timestamp"),
        F.try_variant_get(v, "$.payload.symbol", "string").alias("symbol"),
        F.try_variant_get(v, "$.payload.price", "string").alias("price"),
        F.try_variant_get(v, "$.payload.volume", "double").alias("volume")))
    return clean_ticks(loose).select("offset", "timestamp", "symbol", "price", "volume")
