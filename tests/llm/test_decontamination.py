import hashlib
import random
import re

from rivulet.llm.decontamination import decontaminate

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, bench, k):
    pats = {}
    for i, t in bench:
        w = words(t)
        for j in range(max(1, len(w) - k + 1) if w else 0):
            pats.setdefault(tuple(w[j:j + k]), set()).add(str(i))
    sizes = {len(p) for p in pats}
    out = {}
    for i, t in docs:
        w, hit, items = words(t), set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if (found := pats.get(tuple(w[j:j + n]))):
                    hit |= set(range(j, j + n))
                    items |= found
        out[i] = (len(w), len(hit), sorted(items))
    return out


def rows(df):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in df.collect()}


def fixture(seed=3):
    rnd = random.Random(seed)
    vocab = ["a", "b", "C", "dé", "über", "x1", "42"]
    text = lambda n: rnd.choice([" ", ", ", "\n"]).join(rnd.choice(vocab) for _ in range(n))
    bench = [(i, text(rnd.randint(0, 9))) for i in range(12)] + [(12, None), (13, "!!"), (14, text(3)), (15, text(40))]
    docs = [(i, text(rnd.randint(0, 60))) for i in range(60)] + [(60, None), (61, ""), (62, text(3000)), (63, bench[15][1])]
    return docs, bench


def test_matches_brute_force(llm):
    docs, bench = fixture()
    d = llm.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = llm.createDataFrame(bench, "item_id long, text string")
    for k in (4, 10):
        got = rows(decontaminate(d, b, window=k))
        assert got == brute(docs, bench, k)
        assert rows(decontaminate(d, b, window=k, shard_bytes=40)) == got  # several shards


def test_spans_cover_hits(llm):
    docs, bench = fixture(5)
    d = llm.createDataFrame(docs, "doc_id long, text string")
    for r in decontaminate(d, llm.createDataFrame(bench, "item_id long, text string"), window=4).collect():
        assert sum(s["end"] - s["first"] for s in r["spans"]) == r["n_hit"]
        assert r["contaminated"] == (r["n_hit"] > 0)


def test_empty_tables_and_clashing_names(llm):
    d = llm.createDataFrame([(1, "a b c", 7, "z")], "doc_id long, text string, n_hit int, items string")
    b = llm.createDataFrame([], "item_id long, text string")
    r = decontaminate(d, b).collect()
    assert [(x["n_words"], x["n_hit"], x["items"], x["contaminated"]) for x in r] == [(3, 0, [], False)]
    assert decontaminate(d.limit(0), b).count() == 0
    twice = d.union(d)
    assert decontaminate(twice, llm.createDataFrame([(1, "b c")], "item_id long, text string")).where("n_hit = 2").count() == 2


def test_query_digest(llm, sf):
    from rivulet.llm.decontamination import op10
    got = op10(llm, sf).collect()
    docs = [(r["doc_id"], r["text"]) for r in llm.read.parquet(f"{sf}/documents.parquet").collect()]
    bench = [(r["item_id"], r["text"]) for r in llm.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = brute(docs, bench, 10)
    assert len(got) == len(docs) and any(r["contaminated"] for r in got)
    for r in got:
        n, hit, items = want[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, len(items))
        assert r["items_sha256"] == hashlib.sha256(",".join(items).encode()).hexdigest()
