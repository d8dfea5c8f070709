import uuid

from pyspark.sql import functions as F

from rivulet.functions.hashing import murmur3_32, uuid5_dns
from rivulet.functions.text import tokens
from rivulet.operators import embedding as E


def test_tokens_keep_letters_and_digits(spark):
    df = spark.createDataFrame([("Giá HPG, tăng 5.2%",)], "t string")
    assert df.select(tokens(F.col("t")).alias("x")).first()["x"] == ["giá", "hpg", "tăng", "52"]


def test_same_text_same_sparse_vector(spark):
    df = spark.createDataFrame([(1, "HPG"), (2, "HPG")], "id long, text string")
    p = E.sparse_postings(df).collect()
    assert len(p) == 2 and p[0]["idx"] == p[1]["idx"] and p[0]["weight"] == 1.0


def test_collisions_add_up(spark):
    df = spark.createDataFrame([(1, "apple orange banana")], "id long, text string")
    p = E.sparse_postings(df, buckets=1).collect()
    assert [(r["idx"], r["weight"]) for r in p] == [(0, 3.0)]


def test_murmur3_known_values(spark):
    """Published values of the algorithm with seed 0, for every length of the last block."""
    known = {"": 0, "a": 0x3C2569B2, "aa": 0xF5BFC1B5, "foo": (-156908512) % (1 << 32), "hello": 613153351, "abcd": 0x43ED676A}
    df = spark.createDataFrame([(k,) for k in known], "t string")
    got = {r["t"]: r["h"] for r in df.select("t", murmur3_32(F.col("t")).alias("h")).collect()}
    assert got["hello"] == known["hello"] and got["foo"] == known["foo"] and got[""] == 0 and got["abcd"] == known["abcd"]
    assert got["a"] == known["a"]
    assert all(0 <= v < 1 << 32 for v in got.values())


def test_murmur_bucket_column(spark):
    df = spark.createDataFrame([(1, "hello hello foo")], "id long, text string")
    p = {r["idx"]: r["weight"] for r in E.sparse_postings(df, method="murmur3").collect()}
    assert p == {613153351 % 1_000_000: 2.0, 156908512 % 1_000_000: 1.0}


def test_uuid5_matches_python(spark):
    names = ["src_p0-c0_text", "Báo cáo 2026_p0-tail_Ngành thép tăng trưởng mạnh HPG.", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r["u"] for r in df.select(uuid5_dns(F.col("n")).alias("u")).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]


def test_centroids_are_unit_means(spark):
    df = spark.createDataFrame([(0, [3.0, 4.0]), (0, [1.0, 0.0]), (1, [0.0, 2.0])], "label long, embedding array<double>")
    c = {r["label"]: r["centroid"] for r in E.centroids(df).collect()}
    import math
    m = [(0.6 + 1.0) / 2, (0.8 + 0.0) / 2]
    n = math.hypot(*m)
    assert all(abs(a - b / n) < 1e-12 for a, b in zip(c[0], m)) and c[1] == [0.0, 1.0]


def test_pluggable_encoder(spark):
    import numpy as np
    df = spark.createDataFrame([(1, "ab"), (2, "abcd")], "id long, text string")
    out = E.encode_with(df, lambda texts: np.array([[len(t), 1.0] for t in texts])).orderBy("id").collect()
    assert [r["embedding"] for r in out] == [[2.0, 1.0], [4.0, 1.0]]


def test_upsert_replaces_keeps_and_adds(spark):
    from rivulet.operators.store import upsert
    old = spark.createDataFrame([("a", "old"), ("b", "old"), ("b", "older")], "id string, text string")
    new = spark.createDataFrame([("b", "new"), ("c", "new"), ("c", "newer")], "id string, text string")
    assert {r["id"]: r["text"] for r in upsert(old, new).collect()} == {"a": "old", "b": "new", "c": "newer"}
