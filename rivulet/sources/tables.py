"""Readers for the supplied parquet tables.

Scans are plain ``spark.read.parquet``: Catalyst prunes columns and pushes
filters into the reader, so callers only ``select``/``filter`` and never read
more than they use.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

DEFAULT_SF_DIR = "/root/testdata/sf0.01"

# Tables whose scans are followed by heavy row-local work (text processing).
# Tick paths shuffle right after the scan, so spreading them only adds an exchange.
SPREAD_BY_DEFAULT = {"documents", "pages", "conversations", "benchmark"}


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, spread: bool | None = None) -> DataFrame:
    """Read a supplied table.

    A file with a single row group scans as one task whatever its size, and
    all row-local work after the scan (chunking, tokenizing, JSON building)
    would stay in that task.  When the scan has fewer partitions than the
    cluster's default parallelism, rows are spread round-robin over that many
    partitions; large inputs already have more splits and are left alone.
    """
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(table_path(sf_dir, name))
    if spread is None:
        spread = name in SPREAD_BY_DEFAULT
    if spread:
        target = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < target:
            df = df.repartition(target)
    return df
