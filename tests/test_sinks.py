import json
import tempfile

from pyspark.sql import functions as F

from rivulet.operators import bronze as B
from rivulet.operators import embedding as E
from rivulet.sources import sinks as S
from rivulet.sources import views as V


def test_envelopes_written_to_a_topic_parse_back(spark, sf):
    trades = B.normalize_trades(V.raw_trades(spark, sf))
    path = tempfile.mkdtemp(prefix="rivulet-topic-") + "/topic"
    S.write_topic(B.envelope_json(trades), path)
    raw = spark.read.text(path).select(F.lit("m").alias("topic"), F.lit(0).alias("partition"), F.lit(0).cast("long").alias("offset"), "value")
    keys = ["symbol", "price", "volume"]
    back = sorted(tuple(r) for r in B.market_valid(B.parse_market(raw)).select("ts_str", *keys).collect())
    assert back == sorted(tuple(r) for r in trades.select("ingest_timestamp", *keys).collect()) and len(back) > 100
    first = json.loads(raw.first()["value"])
    assert set(first) == {"ingest_timestamp", "data_source", "asset_class", "payload"} and set(first["payload"]) == set(keys)


def test_table_is_made_once(spark):
    path = tempfile.mkdtemp(prefix="rivulet-table-") + "/t"
    assert S.ensure_table(spark, path, "a int, b string").count() == 0
    spark.createDataFrame([(1, "x")], "a int, b string").write.mode("append").parquet(path)
    assert [tuple(r) for r in S.ensure_table(spark, path, "a int, b string").collect()] == [(1, "x")]


def test_points_written_last_win_in_any_run(spark):
    path = tempfile.mkdtemp(prefix="rivulet-points-") + "/p"
    point = lambda *rows: spark.createDataFrame(list(rows), "id string, text string")
    S.write_points(point(("a", "1"), ("b", "1")), path, "first", 0)
    S.write_points(point(("a", "2")), path, "first", 1)
    S.write_points(point(("b", "3"), ("c", "3")), path, "second", 0)
    assert {r["id"]: r["text"] for r in S.read_points(spark, path).collect()} == {"a": "2", "b": "3", "c": "3"}
    S.write_points(point(("c", "4")), path, "second", 0)  # a replay replaces its own batch
    assert {r["id"]: r["text"] for r in S.read_points(spark, path).collect()} == {"a": "2", "b": "1", "c": "4"}


def test_map_form_holds_the_postings(spark):
    df = spark.createDataFrame([(1, "apple orange apple"), (2, "pear")], "id long, text string")
    postings = E.sparse_postings(df)
    want = {}
    for r in postings.collect():
        want.setdefault(r["id"], {})[r["idx"]] = r["weight"]
    assert {r["id"]: r["sparse"] for r in E.sparse_vectors(postings).collect()} == want and sorted(want[1].values()) == [1.0, 2.0]


def test_streamed_guids_are_kept_once(spark):
    from rivulet.streaming.pipelines import dedup_feed_stream
    root = tempfile.mkdtemp(prefix="rivulet-guids-")
    rows = [[("u1", "l1", "2024-01-01 00:00:00"), (None, "l2", "2024-01-01 00:01:00")],
            [("u1", "l9", "2024-01-01 00:02:00"), (None, "l2", "2024-01-01 00:03:00"), ("u3", None, "2024-01-01 00:04:00"), (None, None, "2024-01-01 00:05:00")]]
    for i, part in enumerate(rows):
        spark.createDataFrame(part, "id string, link string, ts string").withColumn("ingest_ts", F.to_timestamp("ts")).coalesce(1).write.json(f"{root}/in/{i}")
    stream = spark.readStream.schema("id string, link string, ingest_ts timestamp").option("maxFilesPerTrigger", 1).json(f"{root}/in/*")
    q = (dedup_feed_stream(stream).writeStream.format("parquet").option("checkpointLocation", f"{root}/ck").option("path", f"{root}/out")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(r["guid"] for r in spark.read.parquet(f"{root}/out").collect()) == ["l2", "u1", "u3"]
