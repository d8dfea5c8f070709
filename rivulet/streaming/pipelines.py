"""Structured Streaming pipelines for the market and news topics (S1, S2, S11, section 2.10).

Both call batch operators inside ``foreachBatch``:

* outputs of a batch carry the run (the checkpoint's query id) and the batch
  number; a replay after the loss of an executor or the driver replaces them,
  and a new checkpoint over existing tables adds to them;
* gold is a table of file sets with a list that is swapped at commit
  (``sources.gold_table``), so readers never see half a batch;
* the newest ticks per symbol are keyed state (``streaming.tick_state``).

Sources: Kafka (``format='kafka'``, needs the connector on the classpath) or a
landing folder of JSON-lines broker records ``{topic, partition, offset, value}``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.functions import fixed as X
from rivulet.operators import bronze as B
from rivulet.operators import chunking as C
from rivulet.operators import window_state as WS
from rivulet.operators.store import points
from rivulet.session import scratch_tables
from rivulet.sources.gold_table import GoldTable
from rivulet.sources.sinks import read_points, write_dead_letters, write_points
from rivulet.streaming import tick_state as TS
from rivulet.streaming.guid_memory import GuidMemory

RECORD_SCHEMA = "topic string, partition int, offset long, value string"


def read_records(spark: SparkSession, path: str | None = None, fmt: str = "json", topic: str | None = None,
                 bootstrap: str | None = None, max_per_trigger: int | None = None) -> DataFrame:
    """Streaming broker records as (topic, partition, offset, value string)."""
    if fmt == "kafka":
        r = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap)
             .option("subscribe", topic).option("startingOffsets", "earliest"))
        if max_per_trigger:
            r = r.option("maxOffsetsPerTrigger", max_per_trigger)
        df = r.load()
        # invalid UTF-8 is replaced, never fatal
        return df.select("topic", "partition", "offset", F.expr("make_valid_utf8(value)").cast("string").alias("value"))
    r = spark.readStream.schema(RECORD_SCHEMA)
    if max_per_trigger:
        r = r.option("maxFilesPerTrigger", max_per_trigger)
    return r.json(path)


def run_of(batch: DataFrame) -> str:
    """Names the checkpoint that a batch belongs to: a new checkpoint is a new run, a restart is not."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"


# The keyed state needs this store.  A query with timers asks for another batch
# whenever one is over, so one that runs until its input is read would never end:
# only input makes batches, and idle state is dropped along with one.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class MarketPipeline:
    """Bronze market records -> dead letters + enriched gold ticks, with the newest ticks per symbol as keyed state.

    Gold after any sequence of batches, restarts, replays and new checkpoints
    equals the indicators of all ticks together, one per (symbol, timestamp);
    of two ticks of one time the later arrival counts (batch, then partition,
    then offset).  A tick that is older than stored ones changes the rows after
    it, and those are written again: from the state where it reaches back far
    enough, else from gold.
    """

    KEEP = 2 * X.WINDOW_ROWS  # so that the newer half has full frames

    def __init__(self, root: str, as_of: str = B.DEFAULT_AS_OF, salts: int = 4, idle_ms: int | None = None):
        self.root = root
        self.gold = f"{root}/gold"
        self.dlq = f"{root}/dlq_market"
        self.as_of = as_of
        self.salts = salts
        self.idle_ms = idle_ms

    def table(self, spark: SparkSession) -> GoldTable:
        return GoldTable(spark, self.gold)

    def read_gold(self, spark: SparkSession) -> DataFrame:
        """Gold rows, one per (symbol, second): the last arrival."""
        return self.table(spark).read()

    def ticks_with_state(self, records: DataFrame) -> DataFrame:
        """Valid ticks of a record stream with the stored ticks of their symbols."""
        spark = records.sparkSession
        for key, value in STATE_CONF.items():
            spark.conf.set(key, value)
        valid = B.parse_market(records, self.as_of).filter("error_message is null").select(
            "symbol", "timestamp", "price", "volume", "partition", F.col("offset").alias("seq"))
        keys = ["symbol", TS.salt_of(F.unix_micros("timestamp"), self.salts)]
        history = self.table(spark).newest(self.KEEP, keys)
        return TS.with_state(valid, history, self.KEEP, self.salts, self.idle_ms)

    def write_dead_letters(self, batch: DataFrame, batch_id: int) -> None:
        """Dead letters of a batch of raw records, in a folder that a replay overwrites."""
        write_dead_letters(B.dead_letters(B.parse_market(batch, self.as_of), self.as_of), self.dlq, run_of(batch), batch_id)

    def process_batch(self, batch: DataFrame, batch_id: int) -> None:
        """New ticks of a batch, and the stored rows they change, to gold as one set."""
        run, table = run_of(batch), self.table(batch.sparkSession)
        batch = batch.persist()
        with scratch_tables(batch.sparkSession):
            try:
                self._to_gold(batch, table, run, batch_id)
            finally:
                batch.unpersist()

    def _to_gold(self, batch: DataFrame, table: GoldTable, run: str, batch_id: int) -> None:
        new = latest_arrival(batch.filter("kind = 'new'").select(*TICK)).persist()
        if new.isEmpty():
            return
        old = latest_arrival(batch.filter("kind = 'old'").select(*TICK))
        w = Window.partitionBy("symbol").orderBy(F.col("timestamp").desc())
        tail = old.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= self.KEEP)
        # a whole list may end here: rows that have fewer than a window before them in it need older ones
        full = tail.groupBy("symbol").agg(F.count("*").alias("_n"), F.min(F.when(
            F.col("_r") <= self.KEEP - X.WINDOW_ROWS + 1, F.col("timestamp"))).alias("_reach")).filter(F.col("_n") >= self.KEEP)
        beyond = new.join(full, "symbol").filter(F.col("timestamp") < F.col("_reach")).select("symbol")
        partial = batch.filter("partial").select("symbol")
        far = beyond.union(partial).distinct().persist()
        parts = [WS.changed_ticks(tail.drop("_r").join(far, "symbol", "left_anti"), new.join(far, "symbol", "left_anti"))]
        if not far.isEmpty():
            late = new.join(far, "symbol", "left_semi")
            first = late.groupBy("symbol").agg(F.min("timestamp").alias("_first"))
            stored = table.ticks(without=(run, batch_id)).select(*TICK).join(F.broadcast(first) if far.count() <= 10_000 else first, "symbol")
            before = stored.filter("timestamp < _first").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") < X.WINDOW_ROWS)
            history = before.drop("_r", "_first").unionByName(stored.filter("timestamp >= _first").drop("_first"))
            parts.append(WS.changed_ticks(history, late))
        table.append(reduce(DataFrame.unionByName, parts), run, batch_id)
        far.unpersist()
        new.unpersist()

    def queries(self, records: DataFrame, checkpoint: str, **trigger) -> list:
        """Starters of the gold query and the dead-letter query, each with a checkpoint below ``checkpoint``."""
        return [lambda: start(self.process_batch, self.ticks_with_state(records), f"{checkpoint}/gold", **trigger),
                lambda: start(self.write_dead_letters, records, f"{checkpoint}/dlq", **trigger)]


TICK = ["symbol", "timestamp", "price", "volume", "epoch", "partition", "seq"]


def latest_arrival(ticks: DataFrame) -> DataFrame:
    """One tick per (symbol, timestamp): the one that arrived last."""
    best = F.max_by(F.struct("price", "volume", "epoch", "partition", "seq"), F.struct("epoch", "partition", "seq", "price", "volume"))
    return ticks.groupBy("symbol", "timestamp").agg(best.alias("b")).select("symbol", "timestamp", "b.*")


class NewsPipeline:
    """Bronze news records -> dead letters + parent/child chunk points (upserted by id on read)."""

    def __init__(self, root: str):
        self.root = root
        self.dlq = f"{root}/dlq_news"
        self.points = f"{root}/points"

    def process_batch(self, batch: DataFrame, batch_id: int) -> None:
        run = run_of(batch)
        parsed = B.parse_news(batch).persist()
        try:
            write_dead_letters(B.dead_letters(parsed), self.dlq, run, batch_id)
            write_points(points(C.chunk_articles(B.news_valid(parsed))), self.points, run, batch_id)
        finally:
            parsed.unpersist()

    def read_points(self, spark: SparkSession) -> DataFrame:
        """Point store: for every id the version written last (upsert semantics, S10)."""
        return read_points(spark, self.points)

    def queries(self, records: DataFrame, checkpoint: str, **trigger) -> list:
        """Starter of the pipeline's query."""
        return [lambda: start(self.process_batch, records, checkpoint, **trigger)]


def start(process, rows: DataFrame, checkpoint: str, available_now: bool = True, interval: str | None = None):
    """Call ``process(batch, batch_id)`` for a stream with a checkpoint in the shared store."""
    w = rows.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval or "1 second")
    return w.start()


def dedup_feed_stream(entries: DataFrame, watermark: str = "1 day", event_col: str = "ingest_ts") -> DataFrame:
    """Streaming guid de-duplication bounded by event time rather than by count."""
    guid = F.coalesce(F.col("id"), F.col("link"), F.lit(""))
    e = entries.withColumn("guid", guid).filter(F.col("guid") != "")
    return e.withWatermark(event_col, watermark).dropDuplicatesWithinWatermark(["guid"])


def dedup_feed_recent(entries: DataFrame, order_col: str, feed_col: str, keep: int = 5000) -> DataFrame:
    """Streaming guid de-duplication bounded by count: each feed remembers its newest ``keep`` guids.

    Entries of a feed are taken by ``order_col``, ties by guid.  Entries without
    a guid are dropped; a null feed is a feed of its own.
    """
    for key, value in STATE_CONF.items():
        entries.sparkSession.conf.set(key, value)
    guid = F.coalesce(F.col("id"), F.col("link"), F.lit(""))
    e = entries.withColumn("guid", guid).filter(F.col("guid") != "")
    return e.groupBy(feed_col).transformWithStateInPandas(GuidMemory(keep, order_col), e.schema, "append", "none")
