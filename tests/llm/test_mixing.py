import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from rivulet.llm import mixing as mx


def tokens(t):
    return re.findall("[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, held):
    c, ends = Counter(), 0
    for i, t in docs:
        if not held(i):
            c.update(tokens(t))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    out = {}
    for i, t in docs:
        w = tokens(t)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        out[i] = (len(w) + 1, sum(x in c for x in w) + (ends > 0), n, base)
    return out


def test_code_is_complete():
    size, nodes, bits = mx.byte_code(np.random.default_rng(1).integers(0, 1000, 256))
    assert abs(sum(2.0 ** -size) - 1) < 1e-12
    assert len({(tuple(nodes[b]), tuple(bits[b])) for b in range(256)}) == 256


def model(llm, words):
    return mx.fit(llm.createDataFrame([(bytearray(w), n) for w, n in words], "word binary, train long"), table_bits=12)


def test_spelling_is_a_distribution(llm):
    """All continuations of a beginning by one byte add up to the beginning."""
    m = model(llm, [(b"banana", 3), (b"bandana", 2), (b"cabana", 1), ("été".encode(), 4)])
    zero = np.zeros(256, np.int64)
    step = m.spell([b"ban" + bytes([b]) for b in range(256)], zero)
    assert np.exp(step - m.spell([b"ban"], zero[:1])[0]).sum() == np.float64(1.0) or abs(np.exp(step - m.spell([b"ban"], zero[:1])[0]).sum() - 1) < 1e-6
    known, odd = m.spell([b"banana ", b"xqzwvk "], zero[:2])
    assert known > odd


def test_query_base_and_gain(llm):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in mx.op8(llm, sf).collect()}
    docs = [(r["doc_id"], r["text"]) for r in llm.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(docs, lambda i: zlib.crc32(str(i).encode()) % 7 == 2)
    for i, (n, known, total, base) in want.items():
        r = rows[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) + 1e-9
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2) and r["score"] < 0
    seen = [r for r in rows.values() if not r["held_out"]]
    assert sum(r["score"] for r in seen) > sum(r["base_score"] for r in seen)


def test_cases(llm):
    df = llm.createDataFrame([(1, "a b a b", 0), (1, "a b a b", 0), (2, None, 1), (3, "", 1), (None, "zz " * 5000, 1)],
                             "doc_id long, text string, number int")
    rows = mx.lm_scores(df, F.col("number") == 1, table_bits=10).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(by[1]) == 2 and by[1][0]["score"] == by[1][1]["score"] and by[1][0]["n_known"] == 5
    assert by[2][0]["n_tokens"] == by[3][0]["n_tokens"] == 1 and by[2][0]["score"] == by[3][0]["score"]
    assert by[None][0]["n_tokens"] == 5001 and by[None][0]["n_known"] == 1 and by[None][0]["score"] > by[None][0]["base_score"]
    assert mx.lm_scores(df.limit(0), F.lit(False), table_bits=10).count() == 0
    assert mx.lm_scores(df.where("number = 1"), F.lit(True), table_bits=10).where("score < 0").count() == 3


def test_long_unseen_words_keep_their_score(llm, monkeypatch):
    """Spellings far below the least float, alone and repeated, against the mixture worked out word by word in logs."""
    models = []
    fit = mx.fit
    monkeypatch.setattr(mx, "fit", lambda *a, **k: models.append(fit(*a, **k)) or models[-1])
    rnd = np.random.default_rng(5)
    long, longer = ("".join(chr(97 + c) for c in rnd.integers(0, 26, n)) for n in (2000, 10_000))
    train = ["banana bandana cabana banana", "cabana banana"]
    texts = [*train, longer, f"banana {long} {longer} {long} banana"]
    df = llm.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in mx.lm_scores(df, F.col("doc_id") >= 2, table_bits=10).collect()}
    count = Counter(w for t in train for w in t.split())
    tokens, end = sum(count.values()) + 2, 3 / (sum(count.values()) + 4)
    shares = mx._shares(sum(c == 1 for c in count.values()) / tokens)
    for i in (2, 3):
        score, words, past = math.log10(end), texts[i].split(), np.zeros(3)
        for k, w in enumerate(words):
            start = shares[int(math.log2(k + 1))]
            spelt = models[0].spell([w.encode() + b" "], np.zeros(1, np.int64))[0]
            ways = [math.log(q) if q else -math.inf for q in (words[:k].count(w) / max(k, 1), count[w] / tokens)] + [spelt]
            now = (past + start * mx._SHARE_PRIOR) / (past + start * mx._SHARE_PRIOR).sum()
            with np.errstate(divide="ignore"):
                score += (np.logaddexp.reduce(np.log(now) + ways) + math.log(1 - end)) / math.log(10)
                ways = np.log(start) + ways
            past += np.exp(ways - np.logaddexp.reduce(ways))
        assert abs(got[i]["score"] - score) < 1e-6 * abs(score)
    assert got[2]["score"] < -3000 and got[2]["bits_per_byte"] > 1


def three_ways(words, count, tokens, shares, m):
    """Natural-log probability of each word by repeating, vocabulary and spelling, one after another."""
    out, past = [], np.zeros(3)
    for k, w in enumerate(words):
        start = shares[int(math.log2(k + 1))]
        ways = [math.log(q) if q else -math.inf for q in (words[:k].count(w) / max(k, 1), count[w] / tokens)]
        ways.append(m.spell([w.encode() + b" "], np.zeros(1, np.int64))[0])
        now = past + start * mx._SHARE_PRIOR
        with np.errstate(divide="ignore"):
            out.append(np.logaddexp.reduce(np.log(now / now.sum()) + ways))
            ways = np.log(start) + ways
        past = past + np.exp(ways - np.logaddexp.reduce(ways))
    return out


def test_words_before_are_mixed_along_the_text(llm, monkeypatch):
    """Counts of one and two words before, from all blocks, under weights that follow the text: word by word."""
    known = mx.Contexts(np.stack([np.linspace(-1, 2, mx._TRUSTS), np.linspace(0, 3, mx._TRUSTS)]), np.array([0.4, 0.7]))
    models = []
    fit = mx.fit
    monkeypatch.setattr(mx, "fit", lambda *a, **k: models.append(fit(*a, **k)) or models[-1])
    monkeypatch.setattr(mx, "contexts", lambda blocks: known)
    rnd = np.random.default_rng(3)
    line = [f"w{i}" for i in rnd.integers(0, 12, 60)]
    texts = [" ".join(line[a:a + n]) for a, n in zip(rnd.integers(0, 20, 12), rnd.integers(1, 41, 12), strict=True)] + ["", "new w1 w2", " ".join(line)]
    df = llm.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["score"] for r in mx.lm_scores(df, F.col("doc_id") % 3 == 2, table_bits=10).collect()}
    train = [t.split() for i, t in enumerate(texts) if i % 3 != 2]
    grams = [Counter(tuple(w[i:i + k]) for w in train for i in range(len(w) - k + 1)) for k in (1, 2, 3)]
    count = Counter({w: c for (w,), c in grams[0].items()})
    tokens = sum(count.values()) + len(train)
    end = (len(train) + 1) / (tokens + 2)
    shares = mx._shares(sum(c == 1 for c in count.values()) / tokens)
    for i, text in enumerate(texts):
        words = text.split()
        score, weights, slope = math.log(end), np.eye(2, 3), np.zeros((2, 3))
        for k, (w, below) in enumerate(zip(words, three_ways(words, count, tokens, shares, models[0]), strict=True)):
            if k % mx._STRIDE == 0:
                weights, slope = weights + mx._RATE * slope, np.zeros((2, 3))
            p, n = np.zeros(2), np.zeros(2)
            for j in (0, 1):
                if k > j:
                    n[j] = grams[j][tuple(words[k - j - 1:k])]
                    p[j] = max(grams[j + 1][tuple(words[k - j - 1:k + 1])] - known.off[j], 0) / max(n[j], 1)
            x = np.array([*(known.trust[j][int(math.log2(n[j]))] if n[j] else 0 for j in (0, 1)), 1])
            s = (n > 0) / (1 + np.exp(-weights @ x))
            low = math.exp(below)
            lower = s[0] * p[0] + (1 - s[0]) * low
            total = s[1] * p[1] + (1 - s[1]) * lower
            slope += np.outer([(1 - s[1]) * s[0] * (1 - s[0]) * (p[0] - low), s[1] * (1 - s[1]) * (p[1] - lower)], x) / total
            score += math.log(total) + math.log(1 - end)
        assert abs(got[i] - score / math.log(10)) < 1e-5 * max(1, abs(got[i]))


def test_order_of_words_and_copies_count(llm):
    """Phrases of the training texts score above the same words in another order, and a text seen twice above one seen once."""
    rnd = np.random.default_rng(8)
    word = [f"{'aeiou'[i % 5]}{'bcdfglmnprst'[i % 12]}{i}" for i in range(400)]
    text = lambda n: " ".join(word[min(int(z), 399)] for z in rnd.zipf(1.3, n))
    phrases = [text(6).split() for _ in range(30)]
    spoken = lambda n: " ".join(" ".join(phrases[i]) for i in rnd.integers(0, 30, n))
    alone = [text(60) for _ in range(150)]
    train = [*(spoken(10) for _ in range(100)), *alone, *alone[:50]]
    held = [spoken(10) for _ in range(20)]
    mixed = [" ".join(rnd.permutation(t.split())) for t in held]
    df = llm.createDataFrame(list(enumerate([*train, *held, *mixed])), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in mx.lm_scores(df, F.col("doc_id") >= len(train), table_bits=12).collect()}
    n = len(train)
    for i in range(20):
        assert got[n + i]["score"] > got[n + 20 + i]["score"] + 10
    assert sum(got[n + i]["score"] - got[n + i]["base_score"] for i in range(20)) > 20 * 30
    bits = [got[100 + i]["bits_per_byte"] for i in range(150)]
    assert np.mean(bits[:50]) < 0.9 * np.mean(bits[50:])
    assert np.mean(np.array(bits[:50]) < np.quantile(bits[50:], 0.1)) > 0.5
    assert all(abs(got[100 + i]["score"] - got[250 + i]["score"]) < 1e-6 for i in range(50))
