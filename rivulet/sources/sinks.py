"""Sinks: gold table, dead letters, point store, topics.

Writes are idempotent by key or by batch id so that a replayed micro-batch
(after an executor or driver loss) converges to the same table.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.sources.gold_table import GoldTable


def path_exists(spark, path: str) -> bool:
    """Whether ``path`` exists; any other trouble with the store is raised."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def write_gold(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append enriched ticks to the gold table, or replace it."""
    table = GoldTable(df.sparkSession, path)
    (table.replace if mode == "replace" else table.append)(df)


def write_dead_letters(dlq: DataFrame, path: str, run: str, batch_id: int) -> None:
    """Dead letters of one batch; a replay overwrites its own folder, another run never does."""
    dlq.write.mode("overwrite").parquet(f"{path}/run={run}/batch_id={batch_id}")


def write_points(points: DataFrame, path: str, run: str, batch_id: int) -> None:
    """Points of one batch with the time of writing, which orders runs; a replay overwrites its own folder."""
    stamped = points.withColumn("written", F.lit(time.time_ns() // 1000))
    stamped.write.mode("overwrite").parquet(f"{path}/run={run}/batch_id={batch_id}")


def read_points(spark, path: str) -> DataFrame:
    """For every id the version written last; of one batch the greatest, so that ties are settled."""
    p = spark.read.parquet(path)
    cols = [c for c in p.columns if c not in ("id", "written", "run", "batch_id")]
    latest = F.max_by(F.struct(*cols), F.struct("written", *cols))
    return p.groupBy("id").agg(latest.alias("_p")).select("id", *[F.col(f"_p.{c}").alias(c) for c in cols])


def write_topic(df: DataFrame, path: str, value_col: str = "value") -> None:
    """Envelopes as text lines (stands in for a topic where no broker exists)."""
    df.select(F.col(value_col).cast("string")).write.mode("append").text(path)


def ensure_table(spark, path: str, schema: str) -> DataFrame:
    """Create an empty parquet table with ``schema`` if none exists at ``path``."""
    if not path_exists(spark, path):
        spark.createDataFrame([], schema).write.parquet(path)
    return spark.read.parquet(path)
