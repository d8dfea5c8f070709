import datetime as dt
import json
import os
import random
import tempfile

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from rivulet.operators import bronze as B
from rivulet.operators import gold as G
from rivulet.operators import indicators as ind
from rivulet.sources import views as V
from rivulet.streaming import pipelines as P
from rivulet.streaming.pipelines import MarketPipeline, NewsPipeline, read_records
from rivulet.streaming.supervise import supervise

T0 = dt.datetime(2024, 3, 1, 10, 0)
RECORDS = "topic string, partition int, offset long, value string"
VALUES = ["price", "volume", "SMA_5", "SMA_20", "RSI", "MACD", "MACD_Signal"]


def rec(symbol, second, price, offset, partition=0, volume=1.0):
    ts = (T0 + dt.timedelta(seconds=second)).strftime("%Y-%m-%d %H:%M:%S.%f")
    value = {"ingest_timestamp": ts, "payload": {"symbol": symbol, "price": price, "volume": volume}}
    return {"topic": "m", "partition": partition, "offset": offset, "value": json.dumps(value)}


def land(files, folder, first=0):
    """One file per batch, in order."""
    os.makedirs(folder, exist_ok=True)
    for i, records in enumerate(files, first):
        path = os.path.join(folder, f"part-{i:03d}.json")
        with open(path, "w") as fh:
            fh.writelines(json.dumps(r) + "\n" for r in records)
        os.utime(path, (1_000_000 + i, 1_000_000 + i))


def run(spark, pipe, folder, checkpoint):
    for start in pipe.queries(read_records(spark, folder, max_per_trigger=1), checkpoint):
        start().awaitTermination()


def expected(spark, files):
    """Indicators of all ticks together; of one time the tick of the latest batch, partition and offset."""
    rows = [(i, r["partition"], r["offset"], r["topic"], r["value"]) for i, f in enumerate(files) for r in f]
    raw = spark.createDataFrame(rows, "epoch long, partition int, offset long, topic string, value string")
    parsed = B.parse_market(raw.withColumn("topic", F.col("epoch").cast("string"))).filter("error_message is null")
    ticks = parsed.select("symbol", "timestamp", "price", "volume", F.col("topic").cast("long").alias("epoch"), "partition", F.col("offset").alias("seq"))
    return ind.indicators(P.latest_arrival(ticks), fill=False)


def same(got, want, keys=("symbol", "timestamp")):
    a = {tuple(r[k] for k in keys): r for r in got.collect()}
    b = {tuple(r[k] for k in keys): r for r in want.collect()}
    assert set(a) == set(b) and len(b) > 0
    for k, r in b.items():
        for c in VALUES:
            assert a[k][c] == pytest.approx(r[c], abs=1e-9), (k, c)


def stream_of(seed, batches=2, symbols=("AA", "BB", "CC")):
    """Ticks of several partitions, mostly in order: equal times across batches, late ticks near and far, a young symbol."""
    rnd = random.Random(seed)
    files, offset = [], [0, 0]
    for b in range(batches):
        rows = []
        for s in symbols:
            for i in range(50 if s != "CC" else 2):
                late = rnd.random()
                second = 100 * b + 2 * i
                if b and late < 0.06:
                    second -= rnd.choice([20, 60, 150, 300])  # inside the window, at its edge, far behind it
                p = rnd.randrange(2)
                offset[p] += 1 + rnd.randrange(3)
                rows.append(rec(s, second + 0.25 * rnd.randrange(4), 100 + rnd.random(), offset[p], p))
        rows.append({"topic": "m", "partition": 0, "offset": -b, "value": "no json"})
        files.append(rows)
    return files


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="rivulet-stream-")


def test_stream_equals_batch(spark, root):
    files = stream_of(1, batches=3)
    land(files, f"{root}/in")
    pipe = MarketPipeline(f"{root}/out")
    run(spark, pipe, f"{root}/in", f"{root}/ck")
    want = expected(spark, files)
    same(pipe.table(spark).ticks(), want)
    order = F.struct("epoch", "partition", "seq", "timestamp")
    same(pipe.read_gold(spark), G.gold_latest(want.withColumn("o", order), seq_col="o"))
    dlq = spark.read.parquet(pipe.dlq)
    assert sorted(r["offset"] for r in dlq.collect()) == [-2, -1, 0]


def test_given_records_equal_batch(spark, sf, root):
    raw = V.raw_market(spark, sf).filter(~F.col("value").contains("yesterday"))
    recs = [r.asDict() for r in raw.orderBy("offset").collect()]
    files = [recs[i::2] for i in range(2)]  # every batch reaches back over the one before
    land(files, f"{root}/in")
    pipe = MarketPipeline(f"{root}/out")
    run(spark, pipe, f"{root}/in", f"{root}/ck")
    same(pipe.table(spark).ticks(), expected(spark, files))
    assert spark.read.parquet(pipe.dlq).count() == B.dead_letters(B.parse_market(raw)).count()


def test_new_checkpoint_goes_on_from_gold(spark, root):
    files = stream_of(2)
    pipe = MarketPipeline(f"{root}/out", salts=1)
    land(files[:1], f"{root}/in1")
    run(spark, pipe, f"{root}/in1", f"{root}/ck1")
    before = pipe.table(spark).ticks().count()
    land(files[1:], f"{root}/in2")
    run(spark, pipe, f"{root}/in2", f"{root}/ck2")
    assert pipe.table(spark).ticks().count() > before
    same(pipe.table(spark).ticks(), expected(spark, files))
    # the same files again under a third checkpoint change nothing
    run(spark, pipe, f"{root}/in2", f"{root}/ck3")
    same(pipe.table(spark).ticks(), expected(spark, files))
    assert spark.read.parquet(pipe.dlq).count() == 3  # one of each run


def test_batch_that_fails_after_its_write_is_replayed(spark, root):
    files = stream_of(3)
    land(files, f"{root}/in")
    pipe = MarketPipeline(f"{root}/out", salts=2)
    plain, failing = pipe.process_batch, {0, 1}

    def fails_once(batch, batch_id):
        plain(batch, batch_id)
        if batch_id in failing:
            failing.remove(batch_id)
            raise RuntimeError("lost after the write")

    pipe.process_batch = fails_once
    pauses = []
    restarts = supervise(spark, pipe.queries(read_records(spark, f"{root}/in", max_per_trigger=1), f"{root}/ck"), backoff=0.1, sleep=pauses.append)
    assert restarts == 2 and pauses == [0.1, 0.1] and not failing
    same(pipe.table(spark).ticks(), expected(spark, files))
    assert len([s for s in pipe.table(spark).listing()["sets"]]) == len(files)


def test_sink_that_keeps_failing_ends_the_run(spark, root):
    land(stream_of(4, batches=1), f"{root}/in")
    pipe = MarketPipeline(f"{root}/out")

    def fails(batch, batch_id):
        raise RuntimeError("no store")

    pipe.process_batch = fails
    pauses = []
    with pytest.raises(StreamingQueryException):
        supervise(spark, pipe.queries(read_records(spark, f"{root}/in"), f"{root}/ck"), max_restarts=2, backoff=1.0, sleep=pauses.append)
    assert pauses == [1.0, 2.0]


def test_idle_state_is_dropped_and_history_comes_from_gold(spark, root):
    files = [[rec("A", i, 100 + i % 7, i) for i in range(70)], [rec("B", 500 + i, 5.0 + i, 100 + i) for i in range(3)],
             [rec("A", 600 + i, 90 + i, 200 + i) for i in range(4)], [rec("A", 700, 1.0, 300), rec("A", 650, 2.0, 301)]]
    land(files, f"{root}/in")
    pipe = MarketPipeline(f"{root}/out", idle_ms=1, salts=1)
    run(spark, pipe, f"{root}/in", f"{root}/ck")
    same(pipe.table(spark).ticks(), expected(spark, files))


def test_a_batch_touches_its_own_symbols_only(spark, root):
    files = [[rec(s, i, 10.0 + i, 100 * k + i) for k, s in enumerate("ABCDEFGH") for i in range(40)], [rec("C", 100, 7.0, 9000)]]
    land(files, f"{root}/in")
    pipe = MarketPipeline(f"{root}/out")
    query = pipe.queries(read_records(spark, f"{root}/in", max_per_trigger=1), f"{root}/ck")[0]()
    query.awaitTermination()
    state = [p["stateOperators"][0] for p in query.recentProgress if p["numInputRows"]]
    assert state[-1]["numRowsUpdated"] < state[0]["numRowsUpdated"] / 4  # one symbol of eight
    last = pipe.table(spark).listing()["sets"][-1]
    assert [r["symbol"] for r in pipe.table(spark)._rows([last]).collect()] == ["C"]


def test_news_stream_points_upsert(spark, sf, root):
    recs = [r.asDict() for r in V.raw_news(spark, sf).orderBy("offset").collect()]
    half = len(recs) // 2
    land([recs[:half], recs[half:]], f"{root}/in")
    pipe = NewsPipeline(f"{root}/out")
    run(spark, pipe, f"{root}/in", f"{root}/ck")
    n = pipe.read_points(spark).count()
    dead = spark.read.parquet(pipe.dlq).count()
    # the same articles under a new checkpoint overwrite points, and add their dead letters
    land([recs[:half]], f"{root}/again")
    run(spark, pipe, f"{root}/again", f"{root}/ck2")
    assert pipe.read_points(spark).count() == n > 0
    assert spark.read.parquet(pipe.dlq).count() > dead > 0
