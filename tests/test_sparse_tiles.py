"""Sparse search by tiles, counting along sorted texts, slices of long texts: on rows built here."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from rivulet.operators import cells, chunking, embedding, retrieval

POSTINGS = "chunk_id long, idx array<int>, weight array<double>"
ASKED = "query_id long, idx array<int>, weight array<double>"


def brute(corpus, asked, k):
    whole = defaultdict(lambda: defaultdict(float))
    for c, idx, w in corpus:
        for i, x in zip(idx, w, strict=True):
            whole[c][i] += x
    out = set()
    for q, idx, w in asked:
        found = [(-sum(x * whole[c][i] for i, x in zip(idx, w, strict=True) if i in whole[c]), c)
                 for c in whole if set(idx) & set(whole[c])]
        out |= {(q, c, r, round(-s, 9)) for r, (s, c) in enumerate(sorted(found)[:k], 1)}
    return out


def test_products_equal_brute_force_for_any_weights_and_repeated_ids(spark):
    rnd = random.Random(5)

    def row(i, n, least):
        idx = rnd.sample(range(3), 2) + rnd.sample(range(3, 60), n)  # three buckets that nearly all rows share
        return i, idx, [float(rnd.choice([least, 1, 2, 3])) for _ in idx]

    for least in (1, -2):
        corpus = [row(i % 280, 5, least) for i in range(300)]
        asked = [row(i, 4, 1) for i in range(40)] + [(99, [], [])]
        got = cells.all_products(spark.createDataFrame(corpus, POSTINGS), spark.createDataFrame(asked, ASKED), 6, tile_rows=70, block_rows=15)
        assert {(r.query_id, r.chunk_id, r.rank, round(r.score, 9)) for r in got.collect()} == brute(corpus, asked, 6)


def test_sparse_search_makes_no_row_per_question_and_chunk(spark):
    chunks = spark.createDataFrame([(i, f"word w{i % 7} w{i % 5}", "s", "p") for i in range(50)], "chunk_id long, text string, source string, parent_text string")
    index = retrieval.build_index(chunks)
    asked = embedding.sparse_postings(spark.createDataFrame([(1, "word w3"), (2, None)], "query_id long, text string"), "query_id")
    found = retrieval.sparse_topk(index["postings"], asked, 3)
    assert [(r.query_id, r.chunk_id, r.score) for r in found.orderBy("rank").collect()] == [(1, 3, 3.0), (1, 38, 3.0), (1, 8, 2.0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "idx" not in "".join(line for line in plan.splitlines() if "Join" in line)


def test_terms_are_counted_without_a_shuffle_of_terms(spark):
    texts = [(1, "a b a"), (2, None), (1, "a c"), (None, "b b"), (None, "b"), (3, "")] + [(i, "x y x") for i in range(4, 400)]
    df = spark.createDataFrame(texts, "id long, text string")
    tf = embedding.term_freq(df)
    want = Counter((i, w) for i, t in texts for w in (t or "").split())
    assert {(r.id, r.token): r.tf for r in tf.collect()} == dict(want) and tf.count() == len(want)
    weights = embedding.sparse_postings(df)
    assert sum(r.weight for r in weights.collect()) == sum(want.values())
    for out in (tf, weights):
        lines = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Aggregate" in x]
        assert not lines


def test_slices_of_one_long_text(spark):
    text = "".join(chr(c) for c in (97, 10, 0x1F600, 0xE9, 13)) * 50_001
    got = chunking.fixed_chunks(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "abc")], "doc_id long, text string"), 500)
    rows = {(r.doc_id, r.c_idx): r.text for r in got.collect()}
    assert rows == {(1, i): text[i * 500:i * 500 + 500] for i in range(-(-len(text) // 500))} | {(4, 0): "abc"}
    assert "substring" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_counted_searches_equal_brute_force_on_repeated_ids_ties_and_long_texts(spark, monkeypatch):
    """Small steps: many floors, many bounds; the rows are those of the plain matrix products."""
    for name, value in (("STEP_ROWS", 16), ("STEP_QUESTIONS", 5), ("FIRST_ROWS", 4), ("STEP_PRODUCTS", 30), ("COLUMN_PAIRS", 0.01)):
        monkeypatch.setattr(cells, name, value)
    rnd = random.Random(11)
    words = lambda n: [min(int(rnd.expovariate(0.15)), 31) for _ in range(n)]
    corpus = [(i % 90, words(rnd.choice([0, 1, 3, 9, 60]))) for i in range(100)] + [(200 + i, [1, 1, 2]) for i in range(12)] + [(300, None)]
    asked = [(i, words(rnd.choice([1, 4, 12]))) for i in range(14)] + [(50, []), (51, [1, 2]), (52, [31])]
    whole, wanted = defaultdict(Counter), {q: Counter(w) for q, w in asked}
    for c, w in corpus:
        whole[c].update(w or [])
    dot = lambda a, b: sum(n * b[x] for x, n in a.items())
    tile = {"chunk_id": pa.array([c for c, _ in corpus], pa.int64())}
    block = {"query_id": pa.array(list(wanted), pa.int64())}

    lists = pa.array([w for _, w in corpus], pa.list_(pa.int32()))
    found = cells._score_postings(7)(pa.table(tile | {"idx": lists}), pa.table(block | {
        "idx": pa.array([list(w) for w in wanted.values()], pa.list_(pa.int32())),
        "weight": pa.array([[float(n) for n in w.values()] for w in wanted.values()], pa.list_(pa.float64()))})).to_pylist()
    for q, w in wanted.items():
        best = sorted((-dot(w, t), c) for c, t in whole.items() if dot(w, t))[:7]
        assert [(-r["score"], r["chunk_id"]) for r in found if r["query_id"] == q] == best

    found = cells._score_tile(7, 32, 32, True)(pa.table(tile | {"vec": lists}), pa.table(block | {
        "vec": pa.array([w for _, w in asked], pa.list_(pa.int32()))})).to_pylist()
    for q, w in wanted.items():
        norm = lambda t: math.sqrt(dot(t, t))
        cosine = lambda t: dot(w, t) / (norm(w) * norm(t)) if w and t else 0.0  # noqa: E731, B023
        best = sorted((-cosine(whole[c]), c) for c, _ in corpus)[:7]  # a row of a repeated id is offered with the sum of all of them
        assert [(-r["score"], r["chunk_id"]) for r in found if r["query_id"] == q] == best


def test_short_rows_are_left_out_once_a_question_has_its_best(monkeypatch):
    """The work no longer grows with questions times chunks where long texts have the largest products."""
    monkeypatch.setattr(cells, "FIRST_ROWS", 8)
    monkeypatch.setattr(cells, "STEP_ROWS", 8)
    scored = []
    plain = cells.Counts._scores
    monkeypatch.setattr(cells.Counts, "_scores", lambda self, q, a, b: scored.append(len(q) * (b - a)) or plain(self, q, a, b))
    tile = pa.table({"chunk_id": pa.array(range(400), pa.int64()), "idx": pa.array([[1, 2, 3] * (20 if i % 40 == 0 else 1) for i in range(400)], pa.list_(pa.int32()))})
    block = pa.table({"query_id": pa.array(range(30), pa.int64()), "idx": pa.array([[1, 2]] * 30, pa.list_(pa.int32())),
                      "weight": pa.array([[1.0, 1.0]] * 30, pa.list_(pa.float64()))})
    found = cells._score_postings(5)(tile, block)
    assert [r["chunk_id"] for r in found.to_pylist()[:5]] == [0, 40, 80, 120, 160]
    assert sum(scored) <= 30 * 16  # of 30 * 400


def test_reranking_takes_the_words_of_a_chunk_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(retrieval, "cut_lineage", lambda df, cut=retrieval.cut_lineage: made.append(cut(df)) or made[-1])
    chunks = spark.createDataFrame([(1, "a b c", "s", 0, 0), (1, "a d", "t", 0, 1), (2, "x y", "u", 1, 0), (3, "no one", "v", 1, 1)],
                                   "chunk_id long, text string, source string, doc_id long, p_idx long")
    parents = spark.createDataFrame([(0, 0, "p00"), (0, 1, "p01"), (1, 0, "p10"), (1, 1, "p11")], "doc_id long, p_idx long, parent_text string")
    fused = spark.createDataFrame([(q, c, r) for q in range(20) for r, c in ((1, 1), (2, 2))], "query_id long, chunk_id long, rank long")
    queries = spark.createDataFrame([(q, "a b a x" if q else "") for q in range(20)], "query_id long, query string")
    ranked = retrieval.rerank(fused, queries, chunks, parents=parents)
    rows = {(r.query_id, r.source, r.parent_text, round(r.rerank_score, 3)) for r in ranked.collect()}
    assert rows == {(q, s, p, x if q else 0.0) for q in range(20) for s, p, x in (("s", "p00", 0.667), ("t", "p01", 0.333), ("u", "p10", 0.333))}
    assert "_words" not in ranked.columns and "_asked" not in ranked.columns
    assert sorted(df.count() for df in made if "text" in df.columns) == [3, 3]  # a row a chunk, whatever the number of questions
