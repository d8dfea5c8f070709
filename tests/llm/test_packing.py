import random
import zlib

import numpy as np
import pytest

from rivulet.llm import encode, packing
from rivulet.llm import textkit as tk

ODD = ["don't we'll", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "ÀÉÎ ×3÷ ß ÿ", "“quoted”, …x", "é á!", "x\x01y \x1cz",
       "a b c", "中文 текст ΣΑΣ", "1234 5.6e7", "##a--b,,", "", "   ", "\x00", "İstanbul ǅ", "A" * 3000, "é" * 2000, "'s 'S x's", "≠ ,́"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(encode.default_tokenizer())


def test_encoder_equals_tokenizer(tokenizer, llm, sf):
    import pyarrow as pa
    texts = [r["text"] for r in llm.read.parquet(f"{sf}/documents.parquet").collect()] + ODD + [None]
    small = encode.UnitEncoder(encode.default_tokenizer(), cache_units=300)
    for coder in (encode.UnitEncoder(encode.default_tokenizer()), small):
        for k in range(0, len(texts), 50):
            part = texts[k:k + 50]
            ids, ptr = coder.encode(*tk.text_buffer(pa.array(part, pa.string())))
            for i, t in enumerate(part):
                assert ids[ptr[i]:ptr[i + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t


def test_configurations_use_up_counts():
    rnd = random.Random(1)
    for capacity, n in ((50, 400), (2048, 3000), (10, 0)):
        count: dict[int, int] = {}
        for _ in range(n):
            x = rnd.randint(1, capacity)
            count[x] = count.get(x, 0) + 1
        found = packing.configurations(count, capacity)
        used: dict[int, int] = {}
        for taken, times in found:
            assert times > 0 and sum(x * k for x, k in taken.items()) <= capacity
            for x, k in taken.items():
                used[x] = used.get(x, 0) + k * times
        assert used == count
        if n:
            best = -(-sum(x * k for x, k in count.items()) // capacity)
            assert sum(t for _, t in found) <= best * 1.06 + 1


def histogram(llm, sf):
    pieces = packing.token_pieces(llm.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    return {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}


def by_fill(count, capacity):
    """Sequences that exact subset sums alone need."""
    left, n = dict(count), 0
    while any(left.values()):
        taken = packing._best_fill(left, capacity)
        times = min(left[x] // k for x, k in taken.items())
        n += times
        for x, k in taken.items():
            left[x] -= k * times
    return n


def test_program_is_near_the_bound_and_places_most(llm, sf):
    count = histogram(llm, sf)
    rest = {x: n for x, n in count.items() if x != 2048}
    plan = packing.fractional(rest, 2048)
    covered = {x: sum(v * dict(k).get(x, 0) for k, v in plan.items()) / n for x, n in rest.items()}
    assert min(covered.values()) > 1 - 1e-6 and max(covered.values()) < 1.001
    assert sum(plan.values()) <= 1.01 * sum(x * n for x, n in rest.items()) / 2048
    for times in (1, 100):
        many = {x: n * times for x, n in count.items()}
        found = sum(n for _, n in packing.configurations(many, 2048))
        left = {x: n * times for x, n in rest.items()}
        placed = 0
        for _ in range(packing.PHASES):
            left = {x: n for x, n in left.items() if n}
            got = packing.rounded(packing.fractional(left, 2048), left, 2048) if left else []
            placed += sum(n for _, n in got)
            if not got:
                break
        assert placed >= 0.9 * (found - many[2048])
        assert found <= by_fill(many, 2048) * 1.0005


def test_program_on_odd_histograms():
    for count in ({5: 1}, {1: 7}, {6: 100}, {6: 3, 4: 1}, {9: 50, 2: 1000}, {x: 1 for x in range(1, 11)}, {6: 10**12, 4: 10**12}):
        found = packing.configurations(count, 10)
        used = {x: sum(t.get(x, 0) * n for t, n in found) for x in count}
        assert used == count and all(sum(x * k for x, k in t.items()) <= 10 for t, _ in found)
        assert sum(n for _, n in found) <= by_fill(count, 10) * 1.001 + 1


def check(rows, capacity):
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= capacity
    return len(by)


def test_query(llm, sf, tokenizer):
    rows = packing.op1(llm, sf).collect()
    n = check(rows, 2048)
    docs = {r["doc_id"]: r["text"] for r in llm.read.parquet(f"{sf}/documents.parquet").collect()}
    got: dict = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    assert set(got) == set(docs)
    total = 0
    for i, t in docs.items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        want = [(k // 2048, k, len(ids[k:k + 2048]), zlib.crc32(ids[k:k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
        assert sorted(got[i]) == want
    assert n <= -(-total // 2048) * 1.02 + 1


def test_cases(llm):
    text = "a b c " * 5
    df = llm.createDataFrame([(1, text, 5), (1, text, 6), (None, None, 7), (2, "", 8), (3, "x " * 40, 9)], "doc_id long, text string, length int")
    out = packing.pack_documents(df, capacity=16, keep_ids=True).collect()
    check(out, 16)
    assert sorted(r["length"] for r in out if r["doc_id"] == 1) == [16, 16]
    assert [r["length"] for r in out if r["doc_id"] is None] == [1]
    assert sum(r["length"] for r in out if r["doc_id"] == 3) == 41
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in out)
    assert packing.pack_documents(df.limit(0)).count() == 0
