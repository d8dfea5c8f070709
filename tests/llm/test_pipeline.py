import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[2]))
sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline as cp  # noqa: E402
import test_decontamination as td  # noqa: E402
import test_ngram_join as tn  # noqa: E402
import test_packing as tp  # noqa: E402

from rivulet.llm import toxicity as tx  # noqa: E402


def test_stages_take_effect(llm, sf, tmp_path):
    """Each stage on its predecessor's rows, held against brute force over the same rows."""
    docs = llm.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    out = {}
    for i, (name, stage) in enumerate(cp.STAGES):
        stage(llm, docs, sf).write.parquet(f"{tmp_path}/{i}")
        before, docs = docs, llm.read.parquet(f"{tmp_path}/{i}")
        out[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    before, after = out["toxicity"]
    model = tx.fold_model(llm, sf)
    assert ids(after) == ids(tx.score(before, model).where(F.col("score") < tx.THRESHOLD))
    before, after = out["ngram_join"]
    found = tn.brute([(r["doc_id"], r["text"]) for r in before.collect()])
    assert ids(after) == {i for i, _, c in found if i == c}
    before, after = out["decontamination"]
    bench = [(r["item_id"], r["text"]) for r in llm.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hits = td.brute([(r["doc_id"], r["text"]) for r in before.collect()], bench, 10)
    assert ids(after) == {i for i, x in hits.items() if not x[1]} < ids(before)
    before, after = out["secrets"]
    old = {r["doc_id"]: r for r in before.collect()}
    new = {r["doc_id"]: r for r in after.collect()}
    assert set(old) == set(new)
    changed = [i for i in old if old[i]["text"] != new[i]["text"]]
    assert all("[SECRET]" in new[i]["text"] and new[i]["n_chars"] == len(new[i]["text"]) for i in changed)
    assert all(old[i] == new[i] for i in old if i not in changed)
    before, after = out["packing"]
    assert ids(after) == ids(before)
    tp.check(after.collect(), 2048)


def test_cases(llm, sf):
    rows = [(1, "a b c d e f", "en", "s", 11, "x"), (1, "a b c d e f", "en", "s", 11, "x"), (2, None, None, None, None, "y"),
            (None, "", "en", "s", 0, "z"), (None, "", "en", "s", 0, "z"), (3, "see token=0123456789abcdef01 " + "w " * 20000, "en", "s", 9, "q")]
    docs = llm.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    model = tx.Model([], __import__("numpy").zeros((0, 0)), __import__("numpy").zeros(0), 0.0, 1.0, -2.0)
    kept, cp.fold_model = cp.fold_model, lambda *_: model
    try:
        for name, stage in cp.STAGES[:4]:
            docs = stage(llm, docs, sf)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept"], name
            assert docs.count() == (6 if name == "toxicity" else 5)
        assert "[SECRET]" in docs.where("doc_id = 3").first()["text"]
        empty = docs.limit(0)
        for _, stage in cp.STAGES:
            empty = stage(llm, empty, sf)
        assert empty.count() == 0
    finally:
        cp.fold_model = kept


def test_texts_that_share_an_id_are_documents_of_their_own(llm, sf):
    copy, alone = "one two three four five six", "nothing like the others at all here"
    rows = [(5, copy, "second"), (5, alone, "unique"), (3, copy, "first"), (3, copy, "first again"), (None, copy, "no id")]
    docs = llm.createDataFrame(rows, "doc_id long, text string, own string")
    kept = sorted((r["doc_id"], r["text"]) for r in cp.drop_near_duplicates(llm, docs, sf).where("doc_id is not null").collect())
    assert kept == [(3, copy), (5, alone)]
    assert cp.drop_near_duplicates(llm, docs, sf).where("doc_id is null").count() == 1
