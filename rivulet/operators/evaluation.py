"""Retrieval evaluation over a table of questions.

Every question runs through the same hybrid retrieval as production with the
evaluation sizes (6 dense, 6 sparse, 6 fused), reranked.  Relevance is the
expected subject appearing in a candidate's parent context; recall counts the
expected facts found in the two first distinct parents.  All per-question
work is bounded by the 4 candidates looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.operators.retrieval import distinct_contexts, hybrid_search
from rivulet.session import cut_lineage

EVAL_K = 6
LOOK = 4
GATE = {"hit_2": 0.80, "mrr": 0.70, "fact_recall": 0.80}


def eval_ranked(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    # three metric consumers read the ranked candidates: materialise them once
    return cut_lineage(hybrid_search(chunks, questions, prefetch=EVAL_K, fused_k=EVAL_K)["ranked"])


def ir_metrics(ranked: DataFrame, questions: DataFrame) -> DataFrame:
    """Per question: first relevant rank among the first 4 (0 = none), Hit@1, Hit@2, reciprocal rank."""
    rel = ranked.join(questions.select("query_id", "expected_subject"), "query_id").filter(
        (F.col("rerank_pos") <= LOOK) &
        F.contains(F.lower(F.col("parent_text")), F.lower(F.col("expected_subject"))))
    first = rel.groupBy("query_id").agg(F.min("rerank_pos").alias("first_relevant_rank"))
    q = questions.select("query_id").join(first, "query_id", "left")
    r = F.col("first_relevant_rank")
    return q.select("query_id", F.coalesce(r, F.lit(0)).alias("first_relevant_rank"),
                    F.when(r == 1, 1).otherwise(0).cast("bigint").alias("hit_1"),
                    F.when(r <= 2, 1).otherwise(0).cast("bigint").alias("hit_2"),
                    F.coalesce(F.lit(1.0) / r, F.lit(0.0)).alias("reciprocal_rank"))


def fact_recall(ranked: DataFrame, questions: DataFrame) -> DataFrame:
    """Per question: share of expected facts found in the first 2 distinct parents among the first 4."""
    top = distinct_contexts(ranked, top=LOOK, prefix=100, limit=2, min_score=None)
    ctx = top.groupBy("query_id").agg(F.lower(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("context_rank", "parent_text"))), lambda x: x["parent_text"]), " "))
        .alias("combined"))
    q = questions.select("query_id", "expected_facts").join(ctx, "query_id", "left")
    facts = F.col("expected_facts")
    found = F.size(F.filter(facts, lambda f: F.contains(F.coalesce(F.col("combined"), F.lit("")), F.lower(f))))
    return q.select("query_id", F.size(facts).cast("bigint").alias("n_facts"), found.cast("bigint").alias("facts_found"),
                    F.when(F.size(facts) > 0, found / F.size(facts)).otherwise(F.lit(1.0)).alias("fact_recall"))


def quality_gate(ir: DataFrame, recall: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row: mean Hit@1, Hit@2, MRR, fact recall, empty-result violations and the pass flag."""
    hits = ranked.select("query_id").distinct().withColumn("_has", F.lit(1))
    per = ir.join(recall, "query_id").join(hits, "query_id", "left")
    agg = per.agg(F.count(F.lit(1)).alias("n_questions"), F.avg("hit_1").alias("hit_1"),
                  F.avg("hit_2").alias("hit_2"), F.avg("reciprocal_rank").alias("mrr"),
                  F.avg("fact_recall").alias("fact_recall"),
                  F.sum(F.when(F.col("_has").isNull(), 1).otherwise(0)).cast("bigint").alias("violations"))
    passed = ((F.col("hit_2") >= GATE["hit_2"]) & (F.col("mrr") >= GATE["mrr"]) &
              (F.col("fact_recall") >= GATE["fact_recall"]) & (F.col("violations") == 0))
    return agg.withColumn("passed", passed)
