import glob

import numpy as np
import pyarrow.parquet as pq
import pytest

from rivulet.llm import encode, shards


def test_permutation_and_inverse():
    for n in (1, 2, 3, 17, 1000, 4097):
        x = np.arange(n)
        for key in (1, 2):
            y = shards.permute(x, n, key)
            assert sorted(y.tolist()) == x.tolist()
            assert shards.permute(y, n, key, inverse=True).tolist() == x.tolist()
    assert (shards.permute(np.arange(1000), 1000, 1) != shards.permute(np.arange(1000), 1000, 2)).mean() > 0.9
    assert len(shards.permute(np.arange(0), 0, 1)) == 0


def tokens(text):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(encode.default_tokenizer())
    return [*t.encode(text or "", add_special_tokens=False).ids, shards.END_ID]


def test_round_trip_and_cases(llm, tmp_path):
    rows = [(1, "a b c d e f g", 1), (1, "a b c d e f g", 2), (2, None, 3), (None, "", 4), (3, "x " * 50, 5)]
    df = llm.createDataFrame(rows, "doc_id long, text string, slot int")
    path = f"{tmp_path}/s"
    where = shards.materialise(df, path, length=8, per_shard=3).collect()
    back = {r["slot"]: np.frombuffer(r["ids"], "<u2").tolist() for r in shards.read_shards(llm, path, length=8).collect()}
    n = len(where)
    assert sorted(back) == list(range(n)) == sorted(r["slot"] for r in where)
    assert all(r["shard"] == r["slot"] // 3 and r["offset"] == r["slot"] % 3 * 18 for r in where)
    got = sorted((str(r["doc_id"]), r["piece"], back[r["slot"]]) for r in where)
    want = sorted((str(i), k // 8, ids[k:k + 8]) for i, t, _ in rows for ids in [tokens(t)] for k in range(0, len(ids), 8))
    assert got == want
    for first in (0, 2, 3, 5, n - 1, n, n + 9):
        later = shards.read_shards(llm, path, first=first, length=8, per_shard=3)
        assert sorted(r["slot"] for r in later.collect()) == list(range(first, n))
    assert shards.materialise(df.limit(0), f"{tmp_path}/e").count() == 0


def test_later_shards_alone_are_read(llm, tmp_path):
    df = llm.createDataFrame([(i, "a b c " * (i % 7)) for i in range(200)], "doc_id long, text string").coalesce(1)
    path = f"{tmp_path}/s"
    shards.materialise(df, path, length=8, per_shard=10)
    plan = shards.read_shards(llm, path, first=100, length=8, per_shard=10)._jdf.queryExecution().toString()
    assert "GreaterThan(first_slot,90)" in plan
    groups = []
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        groups += [meta.row_group(i).num_rows for i in range(meta.num_row_groups)]
    assert sum(groups) > 20 and set(groups) == {1}


def test_wide_ids(llm, tmp_path):
    df = llm.createDataFrame([(1, "a b c")], "doc_id long, text string")
    path = f"{tmp_path}/w"
    where = shards.materialise(df, path, length=8, per_shard=3, width=4).collect()
    back = shards.read_shards(llm, path, length=8, per_shard=3, width=4).collect()
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in back] == [tokens("a b c")] and where[0]["offset"] == 0
    with pytest.raises(Exception, match="does not fit 1 bytes"):
        shards.sequences(df, length=8, width=1).collect()


def test_query(llm, sf):
    docs = {r["doc_id"]: r["text"] for r in llm.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = shards.op6(llm, sf).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    got = {(r["doc_id"], r["piece"]): (r["length"], r["ids_crc32"]) for r in rows}
    want = {}
    for i, t in docs.items():
        ids = np.array(tokens(t))
        for k in range(0, len(ids), shards.LENGTH):
            part = ids[k:k + shards.LENGTH]
            want[i, k // shards.LENGTH] = (len(part), shards.checksum(part))
    assert got == want
