import itertools
import random
import tracemalloc

import numpy as np
import pytest

from rivulet.llm import textkit as tk
from rivulet.llm import toxicity as tx


def kernel(a, b):
    """Brute-force normalised kernel of two words."""
    def phi(w):
        s = [tx._START, *tx._FOLD[np.frombuffer(w.encode(), np.uint8)]]
        s = [c for c in s if c]
        out = {}
        for i, j, k in itertools.combinations(range(len(s)), 3):
            if k - i <= tx._SPAN:
                u = (s[i], s[j], s[k])
                out[u] = out.get(u, 0) + tx._DECAY ** (k - i - 2)
        return out
    x, y = phi(a), phi(b)
    dot = sum(v * y.get(u, 0) for u, v in x.items())
    return dot / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5


WORDS = ["idiot", "idxiot", "1d1ot", "the", "réeuxpa", "banana", "disgusting", "disgusstting", "aaaaaa", "worthless"]


def test_kernel_matches_brute_force():
    got = tx.similarity(WORDS, WORDS)
    want = np.array([[kernel(a, b) for b in WORDS] for a in WORDS])
    assert np.allclose(got, want, atol=1e-4)


def test_landmarks_match_kernel():
    import pyarrow as pa
    words = tx.fold(*tk.text_buffer(pa.array([" ".join(WORDS)])))
    near, sim = tx.Landmarks(["idiot", "worthless"])(words.symbols, words.starts, words.ends, block=3)
    full = np.zeros((len(WORDS), 2))
    full[near] = sim
    want = np.array([[max(0, kernel(w, m) - tx._FLOOR) / (1 - tx._FLOOR) for m in ("idiot", "worthless")] for w in WORDS])
    assert np.allclose(full, want, atol=1e-4)


def test_fold_joins_single_characters():
    import pyarrow as pa
    w = tx.fold(*tk.text_buffer(pa.array(["You i d i o t. Ab!", None, "i.d.i.o.t", "…"])))
    parts = [tx._spell(w.symbols[a + 1:b]) for a, b in zip(w.starts, w.ends, strict=True)]
    assert parts[:2] == ["you", "idiot"] and "idiot" in parts[3:] and w.document.tolist()[-1] >= 2


def made(llm):
    rnd = random.Random(2)
    usual = ["garden", "window", "river", "summer", "music", "letter", "kitchen", "mountain"]
    rows = []
    for i in range(400):
        w = [rnd.choice(usual) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            w[rnd.randrange(30)] = rnd.choice(["moron", "numbskull", "stinker"])
        rows.append((i, " ".join(w) + ".", int(toxic)))
    return llm.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_learns_and_tolerates_gaps(llm):
    df = made(llm)
    model = tx.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    texts = ["The moron sat.", "a numb-skull", "stinxker music", "n u m b s k u l l", "river music garden.", None, ""]
    got = [r["score"] for r in sorted(tx.score(llm.createDataFrame(list(enumerate(texts)), "id long, text string"), model).collect())]
    assert min(got[:4]) > 0.7 and max(got[4:]) < 0.3 and all(0 <= x <= 1 for x in got)
    rows = tx.score(df.drop("toxic"), model).join(df.select("doc_id", "toxic"), "doc_id").collect()
    assert sum((r["score"] >= 0.7) == bool(r["toxic"]) for r in rows) >= 396


def test_scores_do_not_depend_on_thinning(llm):
    """A word that is toxic in one of three texts scores so, however many documents of each class are fitted."""
    rnd = random.Random(3)
    usual = ["garden", "window", "river", "summer", "music", "letter", "kitchen", "mountain"]
    rows = []
    for i in range(1200):
        w = [rnd.choice(usual) for _ in range(12)]
        if i < 300:
            w[rnd.randrange(12)] = "numbskull"
        rows.append((i, " ".join(w) + ".", int(i < 100)))
    df = llm.createDataFrame(rows, "doc_id long, text string, toxic int")
    probe = df.where("doc_id < 300").select("doc_id", "text")
    whole, thin = (tx.score(probe, tx.fit(df, df, max_documents=m)).agg({"score": "avg"}).first()[0] for m in (2000, 60))
    assert abs(whole - 1 / 3) < 0.1 and abs(thin - 1 / 3) < 0.15


def test_cases(llm):
    df = made(llm).limit(20)
    empty = tx.fit(df.limit(0), df)
    assert tx.score(df.limit(0), empty).count() == 0
    clash = df.withColumnRenamed("toxic", "score")
    assert tx.score(clash.union(clash), empty).columns == ["doc_id", "text", "score"]
    assert tx.score(clash, empty).first()["score"] == pytest.approx(0.5)


def test_query_held_out(llm):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in tx.op5(llm, sf).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in llm.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(r["predicted"] == int(r["score"] >= 0.7) for r in rows.values())
    held = [(rows[i]["score"], y) for i, y in labels.items() if rows[i]["held_out"]]
    pairs = [(a > b) + (a == b) / 2 for a, x in held for b, y in held if x == 1 and y == 0]
    assert sum(pairs) / len(pairs) > 0.8


def test_a_chunk_takes_little_memory():
    """Two megabytes of short words: what folding and comparing hold at once, beyond the text."""
    rnd = np.random.default_rng(3)
    stems = ["".join(chr(97 + c) for c in rnd.integers(0, 12, n)) for n in rnd.integers(3, 9, 40_000)]
    text = " ".join(stems[i] for i in rnd.integers(0, len(stems), 300_000))
    buf, off = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
    marks = tx.Landmarks(stems[:128])
    tx.sentence_features(tx.fold(buf[:1000], np.array([0, 1000])), marks)  # tables made once
    peaks = []
    for step in (lambda: tx.fold(buf, off), lambda w=tx.fold(buf, off): tx.sentence_features(w, marks)):
        tracemalloc.start()
        step()
        peaks.append(tracemalloc.get_traced_memory()[1] / len(buf))
        tracemalloc.stop()
    assert peaks[0] < 26 and peaks[1] < 34  # bytes per byte of text
