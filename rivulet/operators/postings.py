"""Exact pruned sparse search: common words are read only in part.

Postings of a hash bucket lie in blocks by weight (quarter octaves), and large
blocks are cut by chunk, so no bucket is one task's work.  A directory keeps
count, smallest and largest weight of every (bucket, level).

* From the directory alone a question gets a floor: if the upper levels of one
  of its buckets hold ``k`` chunks, its ``k``-th score is at least their
  smallest weight times the question's weight.
* Its ceiling is the sum of its buckets' largest products.  A chunk that
  reaches the floor has, in at least one bucket, a product of at least
  floor / ceiling of that bucket's largest one (if all were smaller, their sum
  would be below the floor).  So only the levels that reach this share are read.
* Chunks found that way are scored in full from their own postings, in tiles: no
  (question, chunk) pair is a row before the best of a tile are known.

Weights are positive; the result is that of ``retrieval.sparse_topk``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators.retrieval import sparse_topk
from rivulet.session import cut_lineage

BLOCK_POSTINGS = 65_536
MARGIN = 1e-9     # rounding of a share; too wide only means that a level more is read


def build_blocks(postings: DataFrame, block_postings: int = BLOCK_POSTINGS) -> dict:
    """Blocks of (chunk_id, idx, weight) and their directory; ``forward`` are the postings as given.

    One posting per (chunk_id, idx).  A table bucketed by ``chunk_id`` is not shuffled by a search.
    """
    p = postings.select("chunk_id", "idx", "weight").withColumn("level", F.floor(F.log2("weight") * 4))
    listed = p.groupBy("idx", "level").agg(F.count("*").alias("n"), F.min("weight").alias("low"), F.max("weight").alias("high"))
    directory = cut_lineage(listed.withColumn("parts", F.ceil(F.col("n") / F.lit(block_postings))))
    large = directory.filter(F.col("parts") > 1).select("idx", "level", "parts")
    part = F.coalesce(F.pmod(F.xxhash64("chunk_id"), F.col("parts")), F.lit(0).cast("long"))
    blocks = p.join(large, ["idx", "level"], "left").select("idx", "level", part.alias("part"), "chunk_id")
    return {"blocks": cut_lineage(blocks), "directory": directory, "forward": postings}


def levels_to_read(directory: DataFrame, question_postings: DataFrame, k: int) -> DataFrame:
    """(query_id, idx, level, parts, n): the levels that may hold one of a question's ``k`` best chunks."""
    q = question_postings.select("query_id", "idx", F.col("weight").alias("qw"))
    d = directory.join(q, "idx")
    above = Window.partitionBy("query_id", "idx").orderBy(F.col("level").desc())
    one = Window.partitionBy("query_id", "idx")
    d = d.withColumn("_reach", F.sum("n").over(above)).withColumn("_top", F.max("high").over(one))
    limits = d.groupBy("query_id").agg(
        F.coalesce(F.max(F.when(F.col("_reach") >= k, F.col("qw") * F.col("low"))), F.lit(0.0)).alias("_floor"),
        F.sum(F.when(F.col("high") == F.col("_top"), F.col("qw") * F.col("high"))).alias("_ceiling"))
    share = F.col("_floor") / F.col("_ceiling") * F.lit(1 - MARGIN)
    return (d.join(limits, "query_id").filter(F.col("high") >= share * F.col("_top"))
            .select("query_id", "idx", "level", "parts", "n"))


def pruned_topk(index: dict, question_postings: DataFrame, k: int) -> DataFrame:
    """The ``k`` best chunks per question by dot product: (query_id, chunk_id, score, rank).

    Chunks found for any question are one row each, whatever number of
    questions found them; they meet the questions in tiles, where the products
    are summed in place.  Scoring a chunk for a question that did not find it
    cannot change that question's best ones.
    """
    q = cut_lineage(question_postings.select("query_id", "idx", "weight"))
    wanted = levels_to_read(index["directory"], q, k).select("idx", "level").distinct()
    found = index["blocks"].join(wanted, ["idx", "level"], "left_semi").select("chunk_id").distinct()
    # postings of buckets that no question names add nothing to a product
    named = index["forward"].join(q.select("idx").distinct(), "idx", "left_semi")
    return sparse_topk(cut_lineage(named.join(found, "chunk_id", "left_semi")), q, k)
