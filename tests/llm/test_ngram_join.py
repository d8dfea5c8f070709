import random
import re

import numpy as np

from rivulet.llm import ngram_join as nj


def shingles(t, k=5):
    w = re.findall("[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(docs, percent=80):
    sets = [(i, shingles(t)) for i, t in docs]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[root(a)] = root(b)
    low = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            low[root(a)] = min(low.get(root(a), i), i)
    return sorted(((i, len(s), low.get(root(a))) for a, (i, s) in enumerate(sets)), key=str)


def fixture(seed, n=60):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    docs, i = [], 0
    passage = [rnd.choice(vocab) for _ in range(30)]
    for _ in range(n):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([0, 1, 3, 4, 5, 6, 20, 60, 150]))]
        if rnd.random() < 0.4:
            base = base + passage
        for _ in range(rnd.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                if w:
                    w[rnd.randrange(len(w))] = rnd.choice(vocab)
            docs.append((i, rnd.choice([" ", "\n", "\t "]).join(w).upper() if rnd.random() < 0.3 else " ".join(w)))
            i += 1
    docs += [(i, None), (i + 1, ""), (i + 2, " \n"), (i + 3, "É é"), (i + 4, "é é"), (None, docs[5][1]), (i, None)]
    rnd.shuffle(docs)
    return docs


def result(df):
    return sorted(((r[0], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def test_matches_brute_force(llm, monkeypatch):
    for seed, group in ((1, nj.GROUP_POSTINGS), (2, 40)):  # one task a group; many tiles
        docs = fixture(seed)
        df = llm.createDataFrame(docs, "doc_id long, text string").repartition(3)
        assert result(nj.jaccard_components(df, group_postings=group)) == brute(docs)


def test_counted_postings(llm):
    """Shingles that many documents of a chunk share travel once, with a count."""
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    docs = []
    for i in range(40):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 3])):
            w[rnd.randrange(80)] = f"x{rnd.random()}"
        docs.append((i, " ".join(w)))
    df = llm.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    assert result(nj.jaccard_components(df)) == brute(docs)


def test_empty_table_and_clashing_names(llm):
    df = llm.createDataFrame([(1, "a", 3, 4)], "doc_id long, text string, root int, n_shingles int")
    assert result(nj.jaccard_components(df)) == [(1, 1, 1)]
    assert nj.jaccard_components(df.limit(0)).count() == 0


def test_divide_skip_finds_all_links():
    rnd = np.random.default_rng(4)
    sets = [rnd.choice(60, size=rnd.integers(1, 50), replace=False) for _ in range(50)]
    sets += [np.unique(np.append(s[:-1], rnd.integers(60, 70))) for s in sets[:25]]
    for percent in (50, 80):
        d = nj.DivideSkip(sets, np.array([len(s) for s in sets]), percent)
        got = {tuple(sorted((int(d.order[q]), int(d.order[c])))) for q in range(len(sets)) for c in d.links(q)}
        want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets))
                if 100 * len(set(sets[a]) & set(sets[b])) >= percent * len(set(sets[a]) | set(sets[b]))}
        assert got == want


def test_query(llm, sf):
    docs = [(r["doc_id"], r["text"]) for r in llm.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(nj.op7(llm, sf)) == brute(docs)
