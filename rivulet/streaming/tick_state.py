"""Newest ticks per symbol as keyed streaming state (J1, S12, W7; section 2.10 State).

The state of a key is the list of its newest ticks, kept by Spark's state store
and checkpointed with the offsets, so a replayed batch starts from the state
before it.  Only keys that a batch touches are read or written.

A key is (symbol, salt): the ticks of a symbol are dealt over ``salts`` lists by
their time, so a symbol that holds most of a batch is not one task's work.  A
batch also sends a row without a tick to every salt of its symbols, which makes
them all report their lists; the newest ticks of a symbol are the newest of
what its salts report.

State that is idle for ``idle_ms`` is dropped and only a mark remains; a later
tick then finds its symbol marked ``partial``, and the history comes from gold.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "micros long, price double, volume double, epoch long, partition int, seq long"
COLS = [f.split()[0] for f in STATE.split(", ")]
OUT = f"symbol string, salt int, {STATE}, kind string, partial boolean"
KEY = ["symbol", "salt"]

# Spark asks a Python worker of the driver, which has no files added with
# addPyFile, for the state's schema: the processor travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def salt_of(micros, salts: int):
    return F.pmod(F.xxhash64(micros), F.lit(salts)).cast("int")


def keyed(ticks: DataFrame, salts: int) -> DataFrame:
    """Ticks (symbol, timestamp, price, volume, partition, seq) by (symbol, salt), with one row without a tick for every other salt."""
    rows = ticks.select("symbol", F.unix_micros("timestamp").alias("micros"), "price", "volume", "partition", "seq")
    rows = rows.withColumn("salt", salt_of(F.col("micros"), salts))
    if salts == 1:
        return rows

    def with_calls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        called = set()  # per task and batch: as many as there are symbols in it
        for b in batches:
            yield b
            fresh = [s for s in b["symbol"].unique() if s not in called]
            called.update(fresh)
            if fresh:
                calls = pd.DataFrame([(s, k) for s in fresh for k in range(salts)], columns=KEY)
                yield calls.reindex(columns=b.columns)

    return rows.mapInPandas(with_calls, rows.schema)


def merged(stored: pd.DataFrame, new: pd.DataFrame, keep: int) -> pd.DataFrame:
    """Newest ``keep`` ticks; of one time the one that arrived last."""
    both = pd.concat([stored, new], ignore_index=True) if len(stored) else new
    both = both.sort_values(["micros", "epoch", "partition", "seq"], kind="stable")
    return both.drop_duplicates("micros", keep="last").tail(keep)


class TickState(StatefulProcessor):
    """Reports the stored ticks of every touched key and the new ones, and stores the newest ``keep``."""

    def __init__(self, keep: int, idle_ms: int | None):
        self.keep, self.idle_ms = keep, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.list = handle.getListState("newest", STATE)
        self.dropped = handle.getValueState("dropped", "yes boolean")

    def _stored(self) -> pd.DataFrame:
        rows = list(self.list.get()) if self.list.exists() else []
        return pd.DataFrame(rows, columns=COLS)

    def handleInputRows(self, key, rows, timerValues):
        now = timerValues.getCurrentProcessingTimeInMs()
        stored = self._stored()
        partial = self.dropped.exists()
        new = pd.concat(list(rows), ignore_index=True)
        new = new[new["micros"].notna()].assign(epoch=now)[COLS].astype(
            {"micros": "int64", "price": "float64", "volume": "float64", "epoch": "int64", "partition": "int32", "seq": "int64"})
        if len(new):
            newest = merged(stored, new, self.keep)
            self.list.put([tuple(r) for r in newest.itertuples(index=False)])
            if partial and len(newest) >= self.keep:
                self.dropped.clear()  # the list is whole again; what it held before was reported as partial
        if self.idle_ms is not None and (len(new) or self.list.exists()):
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(now + self.idle_ms)
        out = pd.concat([stored.assign(kind="old"), new.assign(kind="new")], ignore_index=True) if len(stored) else new.assign(kind="new")
        if partial and not len(out):
            out = pd.DataFrame([[None] * len(COLS)], columns=COLS).assign(kind="mark")
        if len(out):
            yield out.assign(symbol=key[0], salt=key[1], partial=partial)[[*KEY, *COLS, "kind", "partial"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.list.clear()
        self.dropped.update((True,))
        yield pd.DataFrame(columns=[*KEY, *COLS, "kind", "partial"])

    def handleInitialState(self, key, initialState, timerValues):
        self.list.appendList([tuple(r) for r in initialState[COLS].itertuples(index=False)])
        if self.idle_ms is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def close(self) -> None:
        pass


def with_state(ticks: DataFrame, history: DataFrame, keep: int, salts: int, idle_ms: int | None = None) -> DataFrame:
    """Streaming ticks with the stored ones of their symbols before this batch (``kind`` old or new).

    ``history`` (symbol, timestamp, price, volume, epoch, partition, seq) fills
    the state of a new checkpoint; later starts do not read it.
    """
    first = history.select("symbol", F.unix_micros("timestamp").alias("micros"), "price", "volume",
                           F.coalesce("epoch", F.lit(-1).cast("long")).alias("epoch"), F.coalesce("partition", F.lit(-1)).alias("partition"),
                           F.coalesce("seq", F.lit(-1).cast("long")).alias("seq"))
    first = first.withColumn("salt", salt_of(F.col("micros"), salts))
    out = keyed(ticks, salts).groupBy(*KEY).transformWithStateInPandas(
        TickState(keep, idle_ms), OUT, "append", "processingTime", first.groupBy(*KEY))
    return out.withColumn("timestamp", F.timestamp_micros("micros")).drop("micros", "salt")
