"""Views over the supplied tables in the shapes the operators consume.

Each view is a lazy projection of one supplied table (plus, for the bronze
envelopes, deterministic fault injection keyed on the row id so that the
dead-letter paths have input).  The DuckDB twins of these views live in
``rivulet.plans.duck_views`` and must stay in step with this file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions.fixed import TICKERS
from rivulet.sources.tables import read_table

TS_MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"
TS_SECONDS = "yyyy-MM-dd HH:mm:ss"

MARKET_TOPIC = "bronze_market"
NEWS_TOPIC = "bronze_news"
MARKET_PARTITIONS = 4


def _null_nan(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def ticks(spark: SparkSession, sf_dir: str, by: str = "event", spread: bool = False) -> DataFrame:
    """``events`` as a tick stream: (symbol, timestamp, price, volume, seq).

    ``by='event'`` keys ticks by event type (few, large symbols); ``by='user'``
    keys them by user id (many small symbols).
    """
    ev = read_table(spark, sf_dir, "events", spread=spread)
    sym = F.col("event_type") if by == "event" else F.col("user_id").cast("string")
    return ev.select(
        sym.alias("symbol"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        _null_nan(F.col("value")).alias("price"),
        F.expr("try_cast(get_json_object(props, '$.k') AS DOUBLE)").alias("volume"),
        F.col("event_id").alias("seq"),
    )


def _json_str(c: Column) -> Column:
    """Escape a string for embedding in a JSON document (quote, backslash, controls)."""
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for raw, esc in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(esc))
    return F.concat(F.lit('"'), out, F.lit('"'))


def raw_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze market envelopes (topic, partition, offset, value) built from ``ticks``.

    Faults by rule on ``seq`` (first rule that applies):
    17 -> not JSON; 19 -> payload without price; 31 -> no ingest_timestamp;
    37 -> price "abc"; 41 -> price as a quoted number (valid);
    23 -> timestamp "yesterday"; 29 -> timestamp without fraction.
    """
    t = ticks(spark, sf_dir, spread=True)   # envelope building and parsing are row-local work
    seq = F.col("seq")
    # first fault rule that applies (0 = none); the parts below depend on it
    kind = F.lit(0)
    for m in (29, 23, 41, 37, 31, 19, 17):
        kind = F.when(seq % m == 0, F.lit(m)).otherwise(kind)
    t = t.withColumn("_k", kind)
    k = F.col("_k")
    price = F.col("price").cast("string")
    ts_value = (F.when(k == 23, F.lit("yesterday"))
                .when(k == 29, F.date_format("timestamp", TS_SECONDS))
                .otherwise(F.date_format("timestamp", TS_MICROS)))
    ts_part = F.when(k == 31, F.lit("")).otherwise(
        F.concat(F.lit('"ingest_timestamp": '), _json_str(ts_value), F.lit(", ")))
    price_part = (F.when(k == 19, F.lit(""))
                  .when(k == 37, F.lit(', "price": "abc"'))
                  .when(k == 41, F.concat(F.lit(', "price": '), _json_str(price)))
                  .otherwise(F.concat(F.lit(', "price": '), price)))
    envelope = F.concat(F.lit("{"), ts_part,
                        F.lit('"data_source": "events", "asset_class": "STOCK", "payload": {"symbol": '),
                        _json_str(F.col("symbol")), price_part,
                        F.lit(', "volume": '), F.col("volume").cast("string"), F.lit("}}"))
    value = F.when(k == 17, F.concat(F.lit("not-json-"), seq.cast("string"))).otherwise(envelope)
    return t.select(
        F.lit(MARKET_TOPIC).alias("topic"),
        F.pmod(seq, F.lit(MARKET_PARTITIONS)).cast("int").alias("partition"),
        seq.alias("offset"),
        value.alias("value"),
    )


def raw_news(spark: SparkSession, sf_dir: str, faults: bool = True, since: str = "2024-02-01") -> DataFrame:
    """Bronze news envelopes built from ``documents``.

    title = first line, summary = whole text, link = ``doc://{doc_id}``.
    Faults by rule on ``doc_id``: 11 -> truncated (invalid) JSON;
    13 -> payload without link; 7 -> JSON null timestamp (still valid).
    ``faults=False`` gives every document's whole envelope.
    """
    d = read_table(spark, sf_dir, "documents")
    did = F.col("doc_id")
    ts = F.date_format(F.expr(f"timestamp_ntz'{since} 00:00:00' + make_dt_interval(0, 0, doc_id, 0)"), TS_MICROS)
    ts_part = F.when(did % 7 == 0, F.lit("null")).otherwise(_json_str(ts))
    title = F.substring_index(F.col("text"), "\n", 1)
    link = F.concat(F.lit("doc://"), did.cast("string"))
    head = F.concat(F.lit('{"ingest_timestamp": '), ts_part,
                    F.lit(', "data_source": "documents", "payload": {"title": '), _json_str(title),
                    F.lit(', "summary": '), _json_str(F.col("text")))
    full = F.concat(head, F.lit(', "link": '), _json_str(link), F.lit("}}"))
    no_link = F.concat(head, F.lit("}}"))
    value = (F.when(did % 11 == 0, F.substring(full, 1, 40))
             .when(did % 13 == 0, no_link)
             .otherwise(full)) if faults else full
    return d.select(
        F.lit(NEWS_TOPIC).alias("topic"),
        F.lit(0).cast("int").alias("partition"),
        did.alias("offset"),
        value.alias("value"),
    )


def raw_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchange trade messages (short keys s/p/q), wrapped in ``data`` on even seq."""
    t = ticks(spark, sf_dir, spread=True)
    inner = F.concat(F.lit('{"s": '), _json_str(F.col("symbol")),
                     F.lit(', "p": '), _json_str(F.col("price").cast("string")),
                     F.lit(', "q": '), _json_str(F.col("volume").cast("string")), F.lit("}"))
    value = F.when(F.col("seq") % 2 == 0, F.concat(F.lit('{"stream": "trades", "data": '), inner, F.lit("}"))) \
        .otherwise(inner)
    return t.select(F.col("seq"), F.col("timestamp"), value.alias("value"))


def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed entries from ``pages``: feed = host of the url, pos = page id.

    id is missing on page_id % 3 == 0 (guid falls back to the link), summary on
    page_id % 4 == 0 (falls back to description), published on page_id % 5 == 0.
    """
    p = read_table(spark, sf_dir, "pages")
    pid = F.col("page_id")
    title = F.regexp_extract("html", r"<title>(.*?)</title>", 1)
    return p.select(
        F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1).alias("feed"),
        pid.alias("pos"),
        F.when(pid % 3 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("urn:"), F.lower(title))).alias("id"),
        F.col("url").alias("link"),
        title.alias("title"),
        F.when(pid % 4 == 0, F.lit(None).cast("string"))
         .otherwise(F.regexp_extract("html", r"<p>([^<]*)</p>", 1)).alias("summary"),
        F.regexp_extract("html", r'<div class="ad">([^<]*)</div>', 1).alias("description"),
        F.when(pid % 5 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("2024-01-"), F.lpad((F.pmod(pid, F.lit(28)) + 1).cast("string"), 2, "0")))
         .alias("published"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"),
                    F.transform("embedding", lambda x: x.cast("double")).alias("embedding"),
                    F.col("label"))


FIRST_SENTENCE = r"^([\s\S]*?[.!?])(\s|$)"


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation questions from ``benchmark``: subject = first sentence, facts = its distinct tokens."""
    from rivulet.functions.text import tokens

    b = read_table(spark, sf_dir, "benchmark")
    first = F.regexp_extract("text", FIRST_SENTENCE, 1)
    subject = F.when(first == "", F.col("text")).otherwise(first)
    return b.select(
        F.col("item_id").alias("query_id"),
        F.col("text").alias("query"),
        subject.alias("expected_subject"),
        F.array_sort(F.array_distinct(tokens(subject))).alias("expected_facts"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", "role", "text")


# What users of a trading desk might write, in our own words; {s} stands for a symbol.
DESK_MESSAGES = [
    "giá giao dịch {s} hôm nay",
    "tín hiệu kỹ thuật rsi macd của {s}",
    "báo cáo tài chính doanh nghiệp mới nhất",
    "vẽ đồ thị rsi của {s}",
    "xin chào bạn nhé, cảm ơn bạn",
    "chỗ này bán bánh mì không",
    "giá cổ phiếu {s} hôm nay bao nhiêu và tin tức kinh tế vĩ mô mới nhất về lãi suất",
    "vẽ biểu đồ kỹ thuật của {s}",
    "vẽ biểu đồ phân tích thị trường",
    "tin tức kinh tế vĩ mô mới nhất về lãi suất đồng thời chào bot",
]


def desk_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` with the wording of user messages replaced by the desk's, chosen by their ids; every seventh is kept."""
    k = F.col("conv_id") * 3 + F.col("turn")
    wording = F.element_at(F.array(*[F.lit(m) for m in DESK_MESSAGES]), (F.pmod(k, F.lit(len(DESK_MESSAGES))) + 1).cast("int"))
    symbol = F.element_at(F.array(*[F.lit(t) for t in TICKERS]), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(TICKERS))) + 1).cast("int"))
    asked = (F.col("role") == "user") & (F.pmod(k, F.lit(7)) != 0)
    return messages(spark, sf_dir).withColumn("text", F.when(asked, F.replace(wording, F.lit("{s}"), symbol)).otherwise(F.col("text")))


def desk_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as ticks of the listed symbols, by user."""
    t = ticks(spark, sf_dir, by="user")
    at = (F.pmod(F.col("symbol").cast("long"), F.lit(len(TICKERS))) + 1).cast("int")
    return t.withColumn("symbol", F.element_at(F.array(*[F.lit(x) for x in TICKERS]), at))


def requests(spark: SparkSession, sf_dir: str, by: str = "user") -> DataFrame:
    """Price/indicator requests derived from the symbols present.

    One request per distinct symbol prefix of length 1..4, plus the empty
    ticker (matches all) and ``UNKNOWN`` (matches none).  ``limit`` spans
    0..34 by rule so that clamping is exercised; ``action`` alternates.
    """
    syms = ticks(spark, sf_dir, by=by).select("symbol").distinct()
    prefixes = syms.select(F.explode(F.array(*[F.left(F.col("symbol"), F.lit(n)) for n in (1, 2, 3, 4)]))
                           .alias("ticker"))
    extra = syms.sparkSession.createDataFrame([("",), ("UNKNOWN",)], "ticker string")
    t = prefixes.unionByName(extra).distinct()
    tk = F.col("ticker")
    return t.select(
        tk,
        ((F.length(tk) * 7 + F.ascii(tk)) % 35).cast("int").alias("limit"),
        F.when(F.length(tk) % 2 == 0, F.lit("get_indicators")).otherwise(F.lit("get_prices")).alias("action"),
    )


REPORT_ID_BASE = 1_000_000_000


def order_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report document per order: a sentence, a Markdown table of its line items, a closing sentence.

    Gives the table-preserving chunker real tables; built from ``orders`` and
    ``lineitem`` (lines are grouped per order, at most a handful each).
    """
    li = read_table(spark, sf_dir, "lineitem")
    o = read_table(spark, sf_dir, "orders")
    row = lambda r: F.concat(F.lit("| "), r["l_linenumber"].cast("string"), F.lit(" | "), r["l_partkey"].cast("string"),
                             F.lit(" | "), r["l_quantity"].cast("string"), F.lit(" | "),
                             r["l_extendedprice"].cast("string"), F.lit(" |"))
    # plain columns are shuffled once, and the lines of an order meet in one aggregate after it;
    # line numbers repeat within an order in the supplied data: sort on the whole line
    cols = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    lines = (li.select("l_orderkey", *cols).repartition("l_orderkey").groupBy("l_orderkey")
             .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*cols))), row), "\n").alias("rows")))
    text = F.concat(
        F.lit("Order report "), F.col("o_orderkey").cast("string"), F.lit(". Status "), F.col("o_orderstatus"),
        F.lit(", priority "), F.col("o_orderpriority"),
        F.lit(".\n\n| line | part | quantity | price |\n|---|---|---|---|\n"), F.col("rows"),
        F.lit("\n\nTotal price "), F.col("o_totalprice").cast("string"), F.lit(". Placed on "),
        F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("."))
    j = o.join(lines, o["o_orderkey"] == lines["l_orderkey"])
    return j.select((F.col("o_orderkey") + F.lit(REPORT_ID_BASE)).alias("doc_id"), text.alias("text"),
                    F.lit("en").alias("lang"), F.lit("orders").alias("source"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplied documents plus order reports: (doc_id, text, lang, source)."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return d.unionByName(order_reports(spark, sf_dir))
