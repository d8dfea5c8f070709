"""Gold table: immutable sets of Parquet files and a versioned list of the sets that are valid.

Every write makes a folder of its own; a new version of the list, written last,
makes it visible.  Readers take the newest list and read exactly the folders it
names, so a write that fails leaves nothing to see, a batch that is replayed
replaces its own set, and compaction rewrites sets into one sorted set while
readers of an older list go on with the old files until ``vacuum``.

A row is one tick with its indicators.  ``epoch`` (time of the batch that
brought the tick), ``partition`` and ``seq`` say which of two ticks arrived
later; a later set's row of the same tick replaces an earlier one, as after a
late tick changed its indicators.  A plain table partitioned by date, without a
list, is taken over as the oldest set.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rivulet.operators.gold import GOLD_COLS, gold_latest, to_gold_schema

ARRIVAL = ["epoch", "partition", "seq"]
SCHEMA = ("timestamp timestamp, symbol string, price double, volume double, SMA_5 double, SMA_20 double, RSI double, "
          "MACD double, MACD_Signal double, epoch long, partition int, seq long")
_WAIT, _TRIES = 0.2, 25


class GoldTable:
    """A gold table at ``path``, which driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- the list of sets ----------------------------------------------------------------

    def _names(self, folder: str) -> list[str]:
        at = self._fs_path(f"{self.path}/{folder}".rstrip("/"))
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _load(self, number: int) -> dict | None:
        stream = self._fs.open(self._fs_path(f"{self.path}/_versions/{number:012d}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:
            return None  # being written, or left behind by a writer that died

    def _numbers(self) -> list[int]:
        return sorted(int(n[:12]) for n in self._names("_versions") if n.endswith(".json") and n[:12].isdigit())

    def versions(self) -> list[int]:
        """Numbers of the complete lists, oldest first."""
        return [n for n in self._numbers() if self._load(n) is not None]

    def listing(self, version: int | None = None) -> dict:
        """The sets of a version (default: the newest), each with name, path, run and batch."""
        if version is not None:
            return self._load(version)
        for n in reversed(self._numbers()):
            found = self._load(n)
            if found is not None:
                return found
        plain = any(n.startswith("date=") for n in self._names(""))
        return {"version": -1, "sets": [{"name": "000000000000-plain", "path": "", "run": None, "batch": None}] if plain else []}

    def _commit(self, change) -> dict:
        """Write ``change(sets)`` as the next version; made again on the newer list where another writer was first."""
        while True:
            numbers = self._numbers()
            for _ in range(_TRIES):  # a list without an end is being written, or its writer died
                if not numbers or self._load(numbers[-1]) is not None:
                    break
                time.sleep(_WAIT)
            old = self.listing()
            new = {"version": (numbers[-1] if numbers else -1) + 1, "sets": change(old["sets"])}
            at = self._fs_path(f"{self.path}/_versions/{new['version']:012d}.json")
            try:
                stream = self._fs.create(at, False)  # fails if it is there
            except Exception as e:
                if self._fs.exists(at):
                    continue
                raise e
            try:
                stream.write(json.dumps(new).encode())
            finally:
                stream.close()
            return new

    # -- writing -------------------------------------------------------------------------

    def _write(self, rows: DataFrame, name: str) -> str:
        types = {f.name: f.dataType for f in _schema().fields}
        rows = to_gold_schema(rows)
        have = {c.lower(): c for c in rows.columns}
        cols = [(F.col(have[c.lower()]) if c.lower() in have else F.lit(None)).cast(t).alias(c) for c, t in types.items()]
        # dates alone would put a busy day into one task: symbols and times split it
        out = rows.select(*cols).withColumn("date", F.to_date("timestamp")).repartitionByRange("date", "symbol", "timestamp")
        out.sortWithinPartitions("date", "symbol", "timestamp").write.partitionBy("date").parquet(f"{self.path}/_sets/set={name}")
        return f"_sets/set={name}"

    def _next(self) -> int:
        return max([-1, *(int(s["name"][:12]) for s in self.listing()["sets"])]) + 1

    def append(self, rows: DataFrame, run: str | None = None, batch: int | None = None) -> None:
        """Add a set of rows.  A set of the same run and batch, from an attempt that failed later, is replaced."""
        name = f"{self._next():012d}-{uuid.uuid4().hex}"
        entry = {"name": name, "path": self._write(rows, name), "run": run, "batch": batch}
        self._commit(lambda sets: [s for s in sets if run is None or (s["run"], s["batch"]) != (run, batch)] + [entry])

    def replace(self, rows: DataFrame) -> None:
        """Make ``rows`` the whole table."""
        name = f"{self._next():012d}-{uuid.uuid4().hex}"
        entry = {"name": name, "path": self._write(rows, name), "run": None, "batch": None}
        self._commit(lambda sets: [entry])

    def compact(self) -> int:
        """Rewrite settled sets into one, a row per tick, sorted by date, symbol and time; how many sets were rewritten.

        The last batch of each run stays by itself, since a restart may replay
        it.  Sets that come meanwhile are kept: they are newer than all that
        were rewritten.
        """
        sets = self.listing()["sets"]
        last = {}
        for s in sets:
            if s["run"] is not None:
                last[s["run"]] = max(last.get(s["run"], -1), s["batch"])
        open_ = [s["name"] for s in sets if s["run"] is not None and s["batch"] == last[s["run"]]]
        settled = [s for s in sets if s["name"] not in open_ and (not open_ or s["name"] < min(open_))]
        if len(settled) < 2:
            return 0
        name = f"{max(s['name'] for s in settled)[:12]}-{uuid.uuid4().hex}"
        entry = {"name": name, "path": self._write(self._ticks(self._rows(settled)), name), "run": None, "batch": None}
        gone = {s["name"] for s in settled}

        def change(now: list[dict]) -> list[dict]:
            if not gone <= {s["name"] for s in now}:
                raise RuntimeError("the sets were rewritten by another compaction; nothing was changed")
            return [entry] + [s for s in now if s["name"] not in gone]

        self._commit(change)
        return len(settled)

    def vacuum(self, keep_versions: int = 2) -> int:
        """Delete old lists, and files that no kept list names; how many sets were deleted.

        Readers of the kept versions are safe.  Call it when no write is under way.
        """
        numbers = self.versions()
        kept = numbers[-keep_versions:]
        named = {s["path"] for n in kept for s in self._load(n)["sets"]}
        for n in numbers[:-keep_versions]:
            self._fs.delete(self._fs_path(f"{self.path}/_versions/{n:012d}.json"), False)
        gone = [n for n in self._names("_sets") if f"_sets/{n}" not in named]
        for n in gone:
            self._fs.delete(self._fs_path(f"{self.path}/_sets/{n}"), True)
        return len(gone)

    # -- reading -------------------------------------------------------------------------

    def _rows(self, sets: list[dict]) -> DataFrame:
        """All rows of some sets, with the name of the set."""
        own = [s for s in sets if s["path"]]
        out = None
        if own:
            base = f"{self.path}/_sets"
            out = (self.spark.read.schema(f"{SCHEMA}, date date, `set` string").option("basePath", base)
                   .parquet(*[f"{self.path}/{s['path']}" for s in own]))
        for s in sets:
            if not s["path"]:
                plain = self.spark.read.option("basePath", self.path).parquet(
                    *[f"{self.path}/{n}" for n in self._names("") if n.startswith("date=")])
                have = {c.lower(): c for c in plain.columns}
                cols = [(F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name)
                        for f in _schema().fields]
                plain = plain.select(*cols, F.col("date").cast("date").alias("date"), F.lit(s["name"]).alias("set"))
                out = plain if out is None else out.unionByName(plain)
        if out is None:
            out = self.spark.createDataFrame([], f"{SCHEMA}, date date, `set` string")
        return out

    def _ticks(self, rows: DataFrame) -> DataFrame:
        """One row per (symbol, timestamp): the latest arrival, as the latest set has it; equal ones by their values."""
        payload = [c for c in GOLD_COLS if c not in ("symbol", "timestamp")]
        order = F.struct(*[F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(c) for c in ARRIVAL], F.col("set"), *payload)
        best = F.max_by(F.struct(*payload, *ARRIVAL), order)
        return rows.groupBy("symbol", "timestamp").agg(best.alias("b")).select(
            "timestamp", "symbol", *[F.col(f"b.{c}").alias(c) for c in [*payload, *ARRIVAL]])

    def ticks(self, version: int | None = None, without: tuple[str, int] | None = None) -> DataFrame:
        """One row per (symbol, timestamp).  ``without=(run, batch)`` leaves out what that batch and later ones of its run wrote."""
        sets = self.listing(version)["sets"]
        if without:
            sets = [s for s in sets if s["run"] != without[0] or s["batch"] < without[1]]
        return self._ticks(self._rows(sets))

    def read(self, version: int | None = None) -> DataFrame:
        """One row per (symbol, second): the tick that arrived last."""
        t = self.ticks(version).withColumn("_order", F.struct(
            *[F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(c) for c in ARRIVAL], F.col("timestamp")))
        return gold_latest(t, seq_col="_order").drop("_order")

    def newest(self, n: int, keys: list[str], **which) -> DataFrame:
        """Newest ``n`` ticks per key (S12): a group limit in each partition comes before the shuffle."""
        w = Window.partitionBy(*keys).orderBy(F.col("timestamp").desc())
        return self.ticks(**which).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def _schema() -> StructType:
    return StructType.fromDDL(SCHEMA)
