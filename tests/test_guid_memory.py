import random

from rivulet.streaming.pipelines import dedup_feed_recent

SCHEMA = "feed string, seq long, id string, link string"


def by_hand(rows, keep):
    memory, out = {}, []
    for feed, seq, i, link in sorted(rows, key=lambda r: r[1]):
        guid = i if i is not None else link or ""
        seen = memory.setdefault(feed, [])
        if guid and guid not in seen:
            out.append((feed, seq, guid))
            seen.append(guid)
            del seen[:-keep]
    return sorted(out, key=lambda r: r[1])


def stream(spark, root, batches, keep):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(f"{root}/in")
        entries = spark.readStream.schema(SCHEMA).json(f"{root}/in")
        q = (dedup_feed_recent(entries, "seq", "feed", keep).writeStream.format("parquet")
             .option("checkpointLocation", f"{root}/ck").option("path", f"{root}/out").trigger(availableNow=True).start())
        q.awaitTermination()
    got = spark.read.parquet(f"{root}/out").collect()
    return sorted(((r["feed"], r["seq"], r["guid"]) for r in got), key=lambda r: r[1])


def test_equals_memory_by_hand_over_restarts(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(rnd.choice("ab"), n, rnd.choice([None, f"g{rnd.randint(0, 12)}"]), rnd.choice([None, f"l{rnd.randint(0, 3)}"])) for n in range(150)]
    batches = [rows[:60], rows[60:70], rows[70:]]
    assert stream(spark, f"{tmp_path}/r", batches, 5) == by_hand(rows, 5)


def test_one_guid_too_many_forgets_the_first(spark, tmp_path):
    rows = [("a", n, f"g{n}", None) for n in range(5001)]
    again = [("a", 5001, "g1", None), ("a", 5002, "g0", None), ("a", 5003, "g5000", None)]
    got = stream(spark, f"{tmp_path}/m", [rows, again], 5000)
    assert len(got) == 5002 and got[-1] == ("a", 5002, "g0")
