import datetime as dt
import tempfile

import pytest

from rivulet.sources.gold_table import GoldTable
from rivulet.sources.sinks import write_gold

T0 = dt.datetime(2024, 3, 1, 10, 0)
SCHEMA = "symbol string, timestamp timestamp, price double, epoch long, partition int, seq long"


@pytest.fixture
def table(spark):
    return GoldTable(spark, tempfile.mkdtemp(prefix="rivulet-gold-") + "/gold")


def rows(spark, *items):
    """(symbol, seconds, price, epoch, seq) as ticks."""
    return spark.createDataFrame([(s, T0 + dt.timedelta(seconds=t), p, e, 0, q) for s, t, p, e, q in items], SCHEMA)


def prices(df):
    return sorted((r["symbol"], (r["timestamp"] - T0).total_seconds(), r["price"]) for r in df.collect())


def test_later_arrivals_win_and_seconds_keep_the_last(spark, table):
    assert prices(table.read()) == []
    table.append(rows(spark, ("A", 1.0, 1.0, 5, 1), ("A", 1.25, 2.0, 5, 2), ("B", 7, 9.0, 5, 3)), "r", 0)
    # the tick at 1.0 is written again with new values: it stays the earlier arrival of its second
    table.append(rows(spark, ("A", 1.0, 1.5, 5, 1), ("B", 7, 8.0, 4, 9)), "r", 1)
    assert prices(table.ticks()) == [("A", 1.0, 1.5), ("A", 1.25, 2.0), ("B", 7.0, 9.0)]
    assert prices(table.read()) == [("A", 1.0, 2.0), ("B", 7.0, 9.0)]
    # equal arrivals are settled by their values, whatever the order of rows
    table.append(rows(spark, ("C", 1, 3.0, 6, 1), ("C", 1, 4.0, 6, 1)), "r", 2)
    assert ("C", 1.0, 4.0) in prices(table.read())


def test_replay_replaces_and_other_runs_add(spark, table):
    table.append(rows(spark, ("A", 1, 1.0, 1, 1)), "r", 0)
    table.append(rows(spark, ("A", 2, 2.0, 1, 2)), "r", 0)
    table.append(rows(spark, ("A", 3, 3.0, 2, 3)), "s", 0)
    assert prices(table.read()) == [("A", 2.0, 2.0), ("A", 3.0, 3.0)]
    assert prices(table.ticks(without=("s", 0))) == [("A", 2.0, 2.0)]


def test_a_write_without_commit_is_not_seen(spark, table):
    table.append(rows(spark, ("A", 1, 1.0, 1, 1)), "r", 0)
    table._write(rows(spark, ("A", 9, 9.0, 9, 9)), "000000000009-lost")
    assert prices(table.read()) == [("A", 1.0, 1.0)]
    # a list that its writer did not finish is passed over, and the next one goes on behind it
    at = table._fs_path(f"{table.path}/_versions/{table.listing()['version'] + 1:012d}.json")
    table._fs.create(at, False).close()
    assert prices(table.read()) == [("A", 1.0, 1.0)]
    table.append(rows(spark, ("A", 2, 2.0, 2, 2)), "r", 1)
    assert prices(table.read()) == [("A", 1.0, 1.0), ("A", 2.0, 2.0)]


def test_reads_before_during_and_after_compaction(spark, table, monkeypatch):
    for b in range(5):
        table.append(rows(spark, *[("A", t, 10.0 * b + t, b, 100 * b + t) for t in range(b, b + 4)], ("Z", b, 1.0, b, 900 + b)), "r", b)
    before, version = prices(table.read()), table.listing()["version"]
    reader = table.read()  # planned on the old list
    seen = []
    write = table._write

    def writes(df, name):
        out = write(df, name)
        seen.append(prices(table.read()))
        GoldTable(spark, table.path).append(rows(spark, ("N", 1, 1.0, 50, 1)), "r", 5)  # a batch comes meanwhile
        return out

    monkeypatch.setattr(table, "_write", writes)
    assert table.compact() == 4  # the last batch may be replayed and stays
    assert seen == [before]
    after = sorted([*before, ("N", 1.0, 1.0)])
    assert prices(table.read()) == after and prices(reader) == before
    assert prices(table.read(version)) == before
    assert len(table.listing()["sets"]) == 3
    monkeypatch.undo()
    assert table.compact() == 2 and prices(table.read()) == after
    assert table.compact() == 0
    assert table.vacuum(1) > 0
    assert prices(table.read()) == after and len(table.versions()) == 1


def test_two_compactions_do_not_both_commit(spark, table, monkeypatch):
    for b in range(4):
        table.append(rows(spark, ("A", b, float(b), b, b)), "r", b)
    write = table._write

    def writes(df, name):
        out = write(df, name)
        monkeypatch.undo()
        GoldTable(spark, table.path).compact()
        return out

    monkeypatch.setattr(table, "_write", writes)
    with pytest.raises(RuntimeError):
        table.compact()
    assert len(prices(table.read())) == 4


def test_compacted_files_are_sorted(spark, table):
    for b in range(4):
        table.append(rows(spark, *[(s, 10 * b + t, 1.0, b, t) for s in "CAB" for t in range(5, 0, -1)]), "r", b)
    table.compact()
    (first, _) = table.listing()["sets"]
    import glob
    import pyarrow.parquet as pq
    files = glob.glob(f"{table.path}/{first['path']}/date=*/*.parquet")
    assert files
    for f in files:
        keys = [(r["symbol"], r["timestamp"]) for r in pq.read_table(f, partitioning=None).to_pylist()]
        assert keys == sorted(keys)


def test_sink_writes_replaces_and_takes_over_plain_tables(spark, table):
    indicators = rows(spark, ("A", 1, 1.0, 1, 1)).selectExpr(
        "symbol", "date_format(timestamp, 'yyyy-MM-dd HH:mm:ss.SSS') as TIMESTAMP", "price as Price", "2.0 as volume", "3.0 as sma_5", "4.0 as rsi")
    write_gold(indicators, table.path)
    write_gold(rows(spark, ("B", 2, 2.0, 1, 1)), table.path)
    got = {r["symbol"]: r for r in table.read().collect()}
    assert got["A"]["SMA_5"] == 3.0 and got["A"]["RSI"] == 4.0 and got["A"]["MACD"] is None and got["B"]["price"] == 2.0
    write_gold(rows(spark, ("C", 3, 3.0, 1, 1)), table.path, mode="replace")
    assert prices(table.read()) == [("C", 3.0, 3.0)]
    plain = GoldTable(spark, table.path + "-plain")
    rows(spark, ("A", 1, 1.0, 1, 1), ("A", 2, 2.0, 1, 2)).drop("epoch", "partition").selectExpr("*", "to_date(timestamp) as date").write.partitionBy(
        "date").parquet(plain.path)
    plain.append(rows(spark, ("A", 2, 5.0, 9, 3)), "r", 0)
    assert prices(plain.read()) == [("A", 1.0, 1.0), ("A", 2.0, 5.0)]
    plain.append(rows(spark, ("A", 3, 6.0, 10, 4)), "r", 1)
    assert plain.compact() == 2
    assert prices(plain.read()) == [("A", 1.0, 1.0), ("A", 2.0, 5.0), ("A", 3.0, 6.0)]
