"""Session settings and small frame helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.session import checkpoint_dir

# Rows and bytes of one Arrow batch: documents may be long, so batches are kept
# to a few megabytes and regrouped inside the task.
ARROW_ROWS = 2000
ARROW_BYTES = 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the size of Arrow batches, so that a Python worker never holds more than a few megabytes of input."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: computed once, safe against lost executors."""
    path = scratch(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_part(col: str, modulus: int) -> Column:
    """``crc32`` of a column as text, modulo ``modulus``; null where the column is null."""
    return F.crc32(F.encode(F.col(col).cast("string"), "UTF-8")) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spare(df: DataFrame, *wanted: str) -> list[str]:
    """Names not used by ``df`` (case-insensitively), made from ``wanted`` by a prefix: for temporary columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        name = w
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder exists in whatever store holds ``path``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def sql_words(text: str, word: str) -> str:
    """DuckDB list of the runs of ``word`` (a character class) in a text with A-Z lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{upper}', '{upper.lower()}'), '{word}+')"
