"""Bronze layer: envelope normalisation, contract checks, dead letters.

Each raw record is parsed once (``try_parse_json`` to a VARIANT) and gets an
``error_message`` column; valid rows and dead letters are two filters of the
same parsed frame, so a streaming ``foreachBatch`` persists the batch once and
writes both sinks from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TS_MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"
DEFAULT_AS_OF = "2026-01-01 00:00:00.000000"


def fence(df: DataFrame) -> DataFrame:
    """Evaluate every column once per row before any later filter.

    Filters on the valid / dead-letter split would otherwise be pushed below
    the projection with the JSON parse substituted into the predicate once per
    reference.  A one-element ``inline`` is a generator, which predicates on its
    output cannot cross.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))


def _get(v: Column, path: str, typ: str) -> Column:
    return F.try_variant_get(v, path, typ)


def _has(v: Column, path: str) -> Column:
    # JSON null counts as present; a missing key gives SQL NULL
    return _get(v, path, "variant").isNotNull()


def canonical_ts(raw: Column, as_of: str = DEFAULT_AS_OF) -> Column:
    """Microsecond form kept as is; second form padded with ``.000000``; other strings -> ``as_of``."""
    with_frac = F.try_to_timestamp(raw, F.lit(TS_MICROS))
    seconds = F.try_to_timestamp(raw, F.lit("yyyy-MM-dd HH:mm:ss"))
    return (F.when(raw.isNull(), F.lit(None).cast("string"))
            .when(with_frac.isNotNull(), raw)
            .when(seconds.isNotNull(), F.concat(F.date_format(seconds, "yyyy-MM-dd HH:mm:ss"), F.lit(".000000")))
            .otherwise(F.lit(as_of)))


def parse_market(raw: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """Parse market envelopes and attach ``error_message`` (null when the record is valid)."""
    v = F.try_parse_json(F.col("value"))
    p = raw.select("topic", "partition", "offset", "value", v.alias("_v"))
    vv = F.col("_v")
    ts_raw = _get(vv, "$.ingest_timestamp", "string")
    price = _get(vv, "$.payload.price", "double")
    volume = _get(vv, "$.payload.volume", "double")
    has_all = _has(vv, "$.payload") & _has(vv, "$.payload.symbol") & _has(vv, "$.payload.price") & \
        _has(vv, "$.payload.volume")
    err = (F.when(vv.isNull(), F.lit("invalid_json"))
           .when(~has_all, F.lit("missing_fields"))
           .when(ts_raw.isNull(), F.lit("missing_timestamp"))
           .when(price.isNull() | F.isnan(price), F.lit("bad_price"))
           .when(volume.isNull() | F.isnan(volume), F.lit("bad_volume")))
    ts_str = canonical_ts(ts_raw, as_of)
    return fence(p.select(
        "topic", "partition", "offset", "value", err.alias("error_message"),
        ts_str.alias("ts_str"),
        F.try_to_timestamp(ts_str, F.lit(TS_MICROS)).alias("timestamp"),
        _get(vv, "$.payload.symbol", "string").alias("symbol"),
        price.alias("price"), volume.alias("volume"),
    ))


def dead_letters(parsed: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """Dead-letter records of a parsed frame."""
    return parsed.filter(F.col("error_message").isNotNull()).select(
        "error_message", F.lit(as_of).alias("fail_timestamp"), F.col("topic").alias("original_topic"),
        "partition", "offset", F.col("value").alias("raw_payload"))


def market_valid(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("error_message").isNull()).select(
        "offset", "ts_str", "timestamp", "symbol", "price", "volume")


def parse_news(raw: DataFrame) -> DataFrame:
    """News contract: payload with title, summary and link keys; values unchecked."""
    v = F.try_parse_json(F.col("value"))
    p = raw.select("topic", "partition", "offset", "value", v.alias("_v"))
    vv = F.col("_v")
    has_all = _has(vv, "$.payload") & _has(vv, "$.payload.title") & _has(vv, "$.payload.summary") & \
        _has(vv, "$.payload.link")
    err = F.when(vv.isNull(), F.lit("invalid_json")).when(~has_all, F.lit("missing_fields"))
    return fence(p.select(
        "topic", "partition", "offset", "value", err.alias("error_message"),
        _get(vv, "$.ingest_timestamp", "string").alias("ingest_timestamp"),
        _get(vv, "$.payload.title", "string").alias("title"),
        _get(vv, "$.payload.summary", "string").alias("summary"),
        _get(vv, "$.payload.link", "string").alias("link"),
    ))


def news_valid(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("error_message").isNull()).select(
        "offset", "ingest_timestamp", "title", "summary", "link")


def normalize_trades(raw_trades: DataFrame) -> DataFrame:
    """Exchange trade message -> market envelope fields (S3); ``data`` wrapper optional."""
    v = F.try_parse_json(F.col("value"))
    d = F.coalesce(F.try_variant_get(v, "$.data", "variant"), v)
    out = fence(raw_trades.select(
        "seq",
        F.date_format("timestamp", TS_MICROS).alias("ingest_timestamp"),
        F.lit("exchange_trades").alias("data_source"),
        F.lit("CRYPTO").alias("asset_class"),
        F.try_variant_get(d, "$.s", "string").alias("symbol"),
        F.try_variant_get(d, "$.p", "double").alias("price"),
        F.try_variant_get(d, "$.q", "double").alias("volume"),
    ))
    return out.filter(F.col("symbol").isNotNull() & F.col("price").isNotNull() & F.col("volume").isNotNull())


def envelope_json(df: DataFrame) -> DataFrame:
    """Serialise envelopes as JSON text for a topic or text sink."""
    payload = F.struct("symbol", "price", "volume")
    return df.select(F.to_json(F.struct("ingest_timestamp", "data_source", "asset_class",
                                        payload.alias("payload"))).alias("value"))


def latest_quote(ticks: DataFrame) -> DataFrame:
    """Latest (price, volume) per symbol by time (S4); one aggregate, partial before the shuffle."""
    latest = F.max_by(F.struct("timestamp", "price", "volume", "seq"), F.struct("timestamp", "seq"))
    return ticks.groupBy("symbol").agg(latest.alias("q")).select(
        "symbol", "q.timestamp", "q.price", "q.volume", "q.seq")


def normalize_feed(entries: DataFrame, per_feed: int = 3, as_of_date: str = "2026-01-01",
                   as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """First entries per feed with guid/summary/published fallbacks; empty guids skipped,
    repeated guids kept once (first by feed, position) (S5, T7, D1)."""
    w = Window.partitionBy("feed").orderBy("pos")
    first = entries.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= per_feed)
    guid = F.coalesce(F.col("id"), F.col("link"), F.lit(""))
    out = first.select(
        "feed", "pos", guid.alias("guid"), F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("summary", "description", F.lit("")).alias("summary"),
        F.coalesce("link", F.lit("")).alias("link"),
        F.coalesce("published", F.lit(as_of_date)).alias("published"),
        F.lit(as_of).alias("ingest_timestamp"),
    ).filter(F.col("guid") != "")
    return first_per_guid(out)


def first_per_guid(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("guid").orderBy("feed", "pos")
    return df.withColumn("_g", F.row_number().over(w)).filter(F.col("_g") == 1).drop("_g")


def new_articles(entries: DataFrame, seen: DataFrame) -> DataFrame:
    """Entries whose guid has not been seen before, each guid once."""
    guid = F.coalesce(F.col("id"), F.col("link"), F.lit(""))
    e = entries.withColumn("guid", guid).filter(F.col("guid") != "")
    fresh = e.join(seen.select("guid").distinct(), "guid", "left_anti")
    return first_per_guid(fresh.select("feed", "pos", "guid", "title", "link"))
