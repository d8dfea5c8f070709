import numpy as np

from rivulet.functions import fixed as X
from rivulet.operators import retrieval as R


def test_rrf_fixture(spark):
    dense = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "query_id long, chunk_id long, rank long")
    sparse = spark.createDataFrame([(1, 20, 1), (1, 30, 2)], "query_id long, chunk_id long, rank long")
    out = R.rrf_fuse(dense, sparse).orderBy("rank").collect()
    assert [r["chunk_id"] for r in out] == [20, 10, 30]
    assert abs(out[0]["score"] - (1 / 62 + 1 / 61)) < 1e-15 and abs(out[1]["score"] - 1 / 61) < 1e-15


def test_dense_topk_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    corpus = rng.integers(0, 4, size=(300, 16)).astype(float)
    queries = rng.integers(0, 4, size=(7, 16)).astype(float)
    cdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "chunk_id long, embedding array<double>")
    qdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, embedding array<double>")
    got = R.dense_topk(cdf.repartition(5), qdf, k=5, tile_rows=70, block_rows=3).collect()
    for q in range(7):
        sc = corpus @ queries[q] / (np.linalg.norm(corpus, axis=1) * np.linalg.norm(queries[q]))
        want = sorted(range(300), key=lambda i: (-sc[i], i))[:5]
        have = [r["chunk_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        assert have == want


def test_distinct_contexts_keep_better_duplicate(spark):
    p = "x" * 150
    ranked = spark.createDataFrame([(1, 1, 0.9, p + "a", "s1"), (1, 2, 0.8, p + "b", "s2"), (1, 3, 0.5, "other", "s3")],
                                   "query_id long, rerank_pos long, rerank_score double, parent_text string, source string")
    out = R.distinct_contexts(ranked).orderBy("context_rank").collect()
    assert [r["source"] for r in out] == ["s1", "s3"]


def test_min_score_and_no_hits(spark):
    chunks = spark.createDataFrame([(1, "alpha beta", "alpha beta", "s")], "chunk_id long, text string, parent_text string, source string")
    qs = spark.createDataFrame([(1, "gamma delta"), (2, "alpha")], "query_id long, query string")
    ans = {r["query_id"]: r["context"] for r in R.hybrid_search(chunks, qs)["answers"].collect()}
    assert ans[1] == ""                              # retrieved by dense, filtered by the 0.1 floor
    assert ans[2] == "Context: alpha beta (Source: s | Score: 1.00)"
    empty = chunks.limit(0)
    ans2 = R.hybrid_search(empty, qs)["answers"].collect()
    assert all(r["context"] == X.NO_HITS_MESSAGE for r in ans2)


def test_a_search_works_out_only_what_is_asked_for(spark, monkeypatch):
    chunks = spark.createDataFrame([(1, "alpha beta", "alpha beta", "s")], "chunk_id long, text string, parent_text string, source string")
    qs = spark.createDataFrame([(2, "alpha")], "query_id long, query string")

    def unwanted(*_, **__):
        raise AssertionError("not asked for")

    monkeypatch.setattr(R, "rerank", unwanted)
    monkeypatch.setattr(R, "dense_topk", unwanted)
    assert [r["chunk_id"] for r in R.hybrid_search(chunks, qs)["sparse"].collect()] == [1]


def test_parents_are_made_for_documents_of_candidates_only(spark):
    chunks = spark.createDataFrame([(1, 10, 0, "alpha", "s"), (2, 20, 0, "beta", "s"), (3, None, 0, "alpha", "s")],
                                   "chunk_id long, doc_id long, p_idx long, text string, source string")
    parents = spark.createDataFrame([(10, 0, "A"), (20, 0, "B")], "doc_id long, p_idx long, parent_text string")
    qs = spark.createDataFrame([(7, "alpha")], "query_id long, query string")
    fused = spark.createDataFrame([(7, 1, 1), (7, 3, 2)], "query_id long, chunk_id long, rank long")
    asked = []

    def of(wanted):
        asked.extend(r["doc_id"] for r in wanted.collect())
        return parents.join(wanted, "doc_id", "left_semi")

    rows = lambda p: [tuple(r) for r in R.rerank(fused, qs, chunks, parents=p).select("chunk_id", "parent_text", "rerank_pos").collect()]
    assert rows(of) == rows(parents) == [(1, "A", 1)]
    assert set(asked) == {10, None}
