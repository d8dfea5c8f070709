"""Corpus pipeline: the stages that turn raw documents into packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns the columns of ``documents`` again; the last returns the packing.
Between stages the documents are written as Parquet below
``spark.checkpoint.dir`` and read back, so a lost executor repeats one stage at
most and no plan spans two stages.

Rows with a null id go through all stages; they are never dropped as copies of
each other.  Repeated rows are one document after the second stage; different
texts with equal ids stay different documents.
Null and empty texts are clean.  Extra columns are carried along up to the
packing.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import scratch, spare, table
from rivulet.llm.decontamination import decontaminate
from rivulet.llm.ngram_join import jaccard_components
from rivulet.llm.packing import pack_documents
from rivulet.llm.secrets import redact, scan_ledger
from rivulet.llm.toxicity import THRESHOLD, fold_model, score


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    (mark,) = spare(docs, "toxicity")
    return score(docs, fold_model(spark, sf_dir), score_col=mark).where(F.col(mark) < THRESHOLD).drop(mark)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component under shingle similarity: the first of those with the smallest id.

    Rows are told apart by their place in the table, not by their id: texts
    that share an id but not their content are documents of their own.  The
    places hold because ``docs`` is a written table, whose files are split alike
    by every scan.
    """
    row, own, kept = spare(docs, "row", "own", "kept")
    placed = docs.withColumn(row, F.monotonically_increasing_id())
    found = jaccard_components(placed.select(row, "text"), id_col=row).select(F.col(row).alias(own), "component_id")
    named = found.join(placed.where("doc_id is not null").select(row, "doc_id"), F.col(own) == F.col(row))
    first = named.groupBy("component_id").agg(F.min(F.struct("doc_id", row)).alias("first")).select(F.col(f"first.{row}").alias(kept))
    rows = placed.where("doc_id is not null").join(first, F.col(row) == F.col(kept), "left_semi")
    return rows.union(placed.where("doc_id is null")).drop(row)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any occurrence of a benchmark window."""
    own = docs.select([F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    text = f"c{docs.columns.index('text')}"
    clean = decontaminate(own, table(spark, sf_dir, "benchmark"), text_col=text).where(~F.col("contaminated"))
    return clean.select([F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the spans of secrets masked and ``n_chars`` counted anew where that happened."""
    own = docs.select([F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    text = f"c{docs.columns.index('text')}"
    done = redact(scan_ledger(own, scratch(spark, "blob-ledger"), text_col=text), text)
    if "n_chars" in docs.columns:
        n = f"c{docs.columns.index('n_chars')}"
        done = done.withColumn(n, F.when(F.size("spans") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return done.select([F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

# No stage but the last two steps of the third can be said in SQL: the first
# needs a trained model and the last a packing.  tests/llm checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
