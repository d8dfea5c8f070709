"""Distributed dense search, inverted cells and pruned sparse search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.operators import cells, postings
from rivulet.operators import retrieval as R
from rivulet.sources.tables import read_table

VECTORS = "chunk_id long, vec array<double>"
QUESTIONS = "query_id long, vec array<double>"


def frame(spark, rows, schema):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], schema)


def brute(corpus, questions, k):
    """Cosine 0 for a vector without a direction, ties by id."""
    out = {}
    for qid, q in questions:
        q = np.zeros(1) if q is None else np.asarray(q, float)
        scored = []
        for cid, v in corpus:
            v = np.zeros(1) if v is None else np.asarray(v, float)
            norm = np.linalg.norm(q) * np.linalg.norm(v)
            scored.append((-(q @ v) / norm if norm else 0.0, cid))
        out[qid] = [cid for _, cid in sorted((round(s, 12), c) for s, c in scored)[:k]]
    return out


def lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["chunk_id"])
    return out


def clustered(n, dim, seed, groups=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim)) * 4
    return centres[rng.integers(0, groups, n)] + rng.normal(size=(n, dim))


@pytest.fixture(scope="module")
def made(spark):
    corpus = list(enumerate(clustered(600, 8, 1)))
    corpus += [(600, [0.0] * 8), (601, None), (602, corpus[5][1]), (603, corpus[5][1])]
    questions = list(enumerate(clustered(20, 8, 2))) + [(20, corpus[5][1]), (21, [0.0] * 8)]
    return corpus, questions


def test_every_question_meets_every_row(spark, made):
    corpus, questions = made
    got = cells.all_topk(frame(spark, corpus, VECTORS), frame(spark, questions, QUESTIONS), 7, tile_rows=90, block_rows=4)
    assert lists(got) == brute(corpus, questions, 7)


def test_exact_cells_equal_brute_force_and_leave_cells_out(spark, made):
    corpus, questions = made
    index = cells.build_cells(frame(spark, corpus, VECTORS), 8, cells=20, tile_rows=25)
    q = frame(spark, questions, QUESTIONS)
    assert lists(cells.cells_topk(index, q, 7, probes=1, exact=True, block_rows=6)) == brute(corpus, questions, 7)
    kth = cells.cells_topk(index, q, 7, probes=1).filter("rank = 7").select("query_id", "score")
    visited = cells.cell_bounds(index, q).join(kth, "query_id", "left").filter("near = 1 or score is null or bound >= score")
    assert visited.count() < 0.8 * len(questions) * index["cells"].count()


def test_a_cell_with_a_third_of_the_rows_is_cut(spark):
    corpus = [(i, [1.0, 0.0]) for i in range(300)] + [(300 + i, v) for i, v in enumerate(clustered(500, 2, 3))]
    index = cells.build_cells(frame(spark, corpus, VECTORS), 2, cells=10, tile_rows=40)
    assert index["tiles"].groupBy("tile").count().agg(F.max("count")).first()[0] < 80
    assert index["tiles"].count() == 800
    questions = [(1, [1.0, 0.1]), (2, [-1.0, 0.3])]
    got = cells.cells_topk(index, frame(spark, questions, QUESTIONS), 5, exact=True)
    assert lists(got) == brute(corpus, questions, 5)


def test_recall_of_probing_on_the_supplied_vectors(spark):
    """Every row whose id is divisible by 20 asks the whole table; probes are measured on one half and held on the other."""
    vec = read_table(spark, "/root/testdata/sf0.01", "embeddings").select(
        F.col("vec_id").cast("long").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("vec"))
    dim = vec.select(F.max(F.size("vec"))).first()[0]
    asked = vec.filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    truth = lists(cells.all_topk(vec, asked, 10))
    index = cells.build_cells(vec, dim)
    assert lists(cells.cells_topk(index, asked, 10, exact=True)) == truth
    probes = cells.probes_for(index, asked.filter("query_id % 40 = 0"), 10)
    near = lists(cells.cells_topk(index, asked.filter("query_id % 40 = 20"), 10, probes=probes))
    recall = np.mean([len(set(near[q]) & set(truth[q])) / len(truth[q]) for q in near])
    print("recall at 10", recall, "probes", probes, "cells", index["cells"].count())
    assert recall >= 0.9


def test_probes_on_clustered_vectors_are_few(spark, made):
    corpus, questions = made
    index = cells.build_cells(frame(spark, corpus, VECTORS), 8, cells=20)
    q = frame(spark, questions[:20], QUESTIONS)
    probes = cells.probes_for(index, q, 7)
    assert probes <= 5
    near, truth = lists(cells.cells_topk(index, q, 7, probes=probes)), brute(corpus, questions[:20], 7)
    assert sum(len(set(near[i]) & set(truth[i])) for i in truth) >= 0.95 * 7 * 20


def test_empty_sides(spark, made):
    corpus, questions = made
    none, q = frame(spark, [], VECTORS), frame(spark, questions, QUESTIONS)
    assert cells.all_topk(none, q, 3).count() == 0
    assert cells.cells_topk(cells.build_cells(none, 8), q, 3, exact=True).count() == 0
    index = cells.build_cells(frame(spark, corpus, VECTORS), 8)
    assert cells.cells_topk(index, frame(spark, [], QUESTIONS), 3, exact=True).count() == 0


def test_a_vector_too_wide_for_the_index_is_an_error(spark, made):
    index = cells.build_cells(frame(spark, made[0], VECTORS), 8)
    with pytest.raises(Exception, match="9 components"):
        cells.cells_topk(index, frame(spark, [(1, range(9))], QUESTIONS), 3).collect()


def skewed_postings(spark, chunks=2000, seed=4):
    """Bucket 0 is in every chunk, mostly with weight 1; others are rarer the higher their number."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(chunks):
        rows.append((c, 0, float(rng.geometric(0.6))))
        rows += [(c, int(i), float(rng.geometric(0.7))) for i in range(1, 30) if rng.random() < 0.5 / i]
    return spark.createDataFrame(rows, "chunk_id long, idx long, weight double")


def test_pruned_search_equals_the_whole_one(spark):
    p = skewed_postings(spark)
    rng = np.random.default_rng(5)
    asked = spark.createDataFrame([(q, int(i), float(rng.integers(1, 4))) for q in range(25)
                                   for i in {0, *rng.integers(1, 32, 3).tolist()}], "query_id long, idx long, weight double")
    index = postings.build_blocks(p, block_postings=100)
    rows = lambda d: [tuple(r) for r in d.select("query_id", "chunk_id", "rank", "score").orderBy("query_id", "rank").collect()]
    assert rows(postings.pruned_topk(index, asked, 10)) == rows(R.sparse_topk(p, asked, 10))
    assert index["blocks"].groupBy("idx", "level", "part").count().agg(F.max("count")).first()[0] < 200


def test_common_buckets_are_read_in_part(spark):
    p = skewed_postings(spark)
    asked = spark.createDataFrame([(1, 0, 1.0), (1, 2, 1.0)], "query_id long, idx long, weight double")
    index = postings.build_blocks(p)
    read = postings.levels_to_read(index["directory"], asked, 10).agg(F.sum("n")).first()[0]
    whole = p.filter("idx in (0, 2)").count()
    assert 0 < read < 0.5 * whole


def test_pruned_search_without_hits_or_input(spark):
    p = skewed_postings(spark, 50)
    asked = spark.createDataFrame([(1, 999, 1.0)], "query_id long, idx long, weight double")
    assert postings.pruned_topk(postings.build_blocks(p), asked, 5).count() == 0
    assert postings.pruned_topk(postings.build_blocks(p.limit(0)), asked, 5).count() == 0
    few = postings.pruned_topk(postings.build_blocks(p), asked.withColumn("idx", F.lit(0).cast("long")), 100)
    assert few.count() == 50  # fewer chunks than asked for: no floor, everything is read


def test_pruned_search_makes_no_row_per_question_and_chunk(spark):
    """Chunks found by many questions are one row each until the best of a tile are known."""
    p = skewed_postings(spark, 300)
    asked = spark.createDataFrame([(q, 0, 1.0) for q in range(40)], "query_id long, idx long, weight double")
    plan = postings.pruned_topk(postings.build_blocks(p), asked, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
    assert not [line for line in plan.splitlines() if "Aggregate [query_id" in line and "chunk_id" in line]
