"""Point store semantics (S10, S13, Q8): deterministic ids and idempotent upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.functions.hashing import uuid5_dns

POINT_COLS = ["id", "text", "parent_text", "source", "timestamp", "hierarchy"]


def points(chunks: DataFrame) -> DataFrame:
    """Chunks -> points: id = UUIDv5(DNS, '{source}_{hierarchy}_{text}'), parent_text defaults to text.

    The batch position is not part of the name, so re-ingesting a chunk in
    another batch gives the same id (an overwrite, not a duplicate).
    """
    name = F.concat_ws("_", F.col("source"), F.col("chunk_hierarchy"), F.col("text"))
    ts = F.col("timestamp") if "timestamp" in chunks.columns else F.lit("")
    return chunks.select(uuid5_dns(name).alias("id"), "text",
                         F.coalesce(F.col("parent_text"), F.col("text")).alias("parent_text"),
                         "source", ts.alias("timestamp"), F.col("chunk_hierarchy").alias("hierarchy"))


def upsert(stored: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Stored points replaced by new points of the same id; one aggregate, partial before the shuffle.

    Of several points of one id on the same side the greatest is taken.
    """
    cols = [c for c in stored.columns if c != key]
    both = (stored.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1))))
    latest = F.max_by(F.struct(*cols), F.struct("_batch", *cols))
    return both.groupBy(key).agg(latest.alias("_p")).select(key, *[F.col(f"_p.{c}").alias(c) for c in cols])
