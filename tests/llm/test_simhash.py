import random
import re

import pytest
import xxhash

from rivulet.llm import simhash as sh


def fingerprint(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(docs, radius=2):
    fps = [fingerprint(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                parent[root(a)] = root(b)
    low = {}
    for a, (i, _) in enumerate(docs):
        if i is not None:
            low[root(a)] = min(low.get(root(a), i), i)
    return sorted(((i, f"{f:016x}", low.get(root(a))) for a, ((i, _), f) in enumerate(zip(docs, fps, strict=True))), key=str)


def fixture(seed, n=40):
    rnd = random.Random(seed)
    vocab = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(300)]
    docs, i = [], 0
    for _ in range(n):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([0, 1, 2, 3, 4, 30, 200]))]
        for _ in range(rnd.choice([1, 1, 2, 5])):
            w = list(base)
            if len(w) > 20 and rnd.random() < 0.6:
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            docs.append((i, rnd.choice([" ", "\n", "\t\x0b "]).join(w)))
            i += 1
    docs += [(i, None), (i + 1, ""), (i + 2, " \n"), (None, docs[3][1]), (i, None), (None, "only here"), (i + 3, " x y")]
    rnd.shuffle(docs)
    return docs


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(llm, seed):
    docs = fixture(seed)
    assert result(sh.simhash_components(llm.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_links_at_every_distance(llm):
    rnd = random.Random(4)
    centre = rnd.getrandbits(64)
    flips = [0, 1, 1 << 63, 3, 1 << 63 | 1, 7, 15, 1 << 40 | 1 << 41 | 1 << 42]
    words = [centre ^ f for f in flips] + [rnd.getrandbits(64) for _ in range(30)]
    signed = [w - (1 << 64) if w >> 63 else w for w in words]
    df = llm.createDataFrame([(w,) for w in signed + signed[:3]] + [(None,)], "fp long")
    for radius in (0, 2, 4):
        got = {frozenset(((a, b))) for a, b in sh.near_pairs(df, radius=radius).collect()}
        near = {frozenset((a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= radius}
        assert got <= near

        def classes(pairs):
            of = {w: {w} for w in signed}
            for p in pairs:
                a, b = p
                whole = of[a] | of[b]
                for w in whole:
                    of[w] = whole
            return {frozenset(c) for c in of.values()}

        assert classes(got) == classes(near)
    with pytest.raises(ValueError):
        sh.near_pairs(df, radius=3)


def test_a_ball_of_fingerprints_makes_rows_in_proportion(llm):
    """2,017 words within two bits of one: pairs grow with the words, not with their square."""
    near = [0] + [1 << i for i in range(62)] + [1 << i | 1 << j for i in range(62) for j in range(i)]
    pairs = sh.near_pairs(llm.createDataFrame([(w,) for w in near], "fp long")).count()
    assert len(near) - 1 <= pairs <= 65 * len(near)


def test_long_texts_are_hashed_in_stretches(llm, monkeypatch):
    text = " ".join(f"w{i % 1000}" for i in range(20_000))
    want = fingerprint(text)
    for stretch in (1, 7, 1 << 17):
        if stretch > 1:
            monkeypatch.setattr(sh, "_STRETCH", stretch * 100)
        got = sh.majority(sh.shingle_hashes(text.encode())) & (1 << 64) - 1
        assert got == want


def test_odd_tables(llm):
    empty = llm.createDataFrame([], "doc_id long, text string")
    assert result(sh.simhash_components(empty)) == []
    df = llm.createDataFrame([("b", "x y z", 1, 2, "f"), ("a", "X Y  Z", 3, 4, "f")], "doc_id string, text string, fp int, root int, FINGERPRINT string")
    got = result(sh.simhash_components(df))
    assert got == [(i, f"{fingerprint('x y z'):016x}", "a") for i in "ab"]


def test_query_on_the_whole_table(llm, sf):
    docs = [tuple(r) for r in llm.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert result(sh.op11(llm, sf)) == brute(docs)
