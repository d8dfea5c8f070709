import re

from rivulet.llm.quality import Rule, op3, quality


def brute(text):
    w = re.findall("[^\x20\x09-\x0D]+", text or "")
    wins = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    twice = {g for g in wins if wins.count(g) > 1}
    hit = {i + k for i, g in enumerate(wins) if g in twice for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.strip("\x20\t\n\x0b\x0c\r")]
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed)


def got(r):
    return (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])


CASES = [None, "", " \n\t ", "a b c d", "a b c d e", "a a a a a a", "a b c d e a b c d e", "x\ny\nx\n \n\nx ", "é#ü<b>|😀 z\x1fz\x85q\xa0w",
         "a b c d e f a b c d e g h i j k l m n o p q r s t u v w", "lorem " * 3000, " ".join(map(str, range(9000)))]


def test_matches_brute_force(llm):
    df = llm.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in quality(df).collect()}
    for i, t in enumerate(CASES):
        want = brute(t) if len(t or "") < 10000 else None
        assert want is None or got(rows[i]) == want, t
    assert rows[10]["n_repeat_words"] == 3000 and rows[11]["n_repeat_words"] == 0 and not any(rows[i]["kept"] for i in range(11))


def test_rules_and_cases(llm):
    clean = "The cat sat on the mat and the dog was in the garden with a ball ."
    df = llm.createDataFrame([(1, clean, 1, 2), (2, clean.replace(" ", " ### "), 3, 4), (1, clean, 1, 2)], "doc_id long, text string, kept int, words int")
    rows = sorted((r["doc_id"], r["kept"], r["words"]) for r in quality(df).collect())
    assert rows == [(1, True, 2), (1, True, 2), (2, False, 4)]
    strict = quality(df, rules=(Rule("few", "n_words", None, None, 3),))
    assert not any(r["kept"] for r in strict.collect())
    assert quality(df.limit(0)).count() == 0


def test_query_has_no_python(llm, sf, capsys):
    df = op3(llm, sf)
    df.explain()
    assert "Python" not in capsys.readouterr().out
    docs = {r["doc_id"]: r["text"] for r in llm.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in df.collect():
        if len(docs[r["doc_id"]]) < 8000:
            assert got(r) == brute(docs[r["doc_id"]])
