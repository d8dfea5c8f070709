import pytest

from rivulet.llm import attribution as at


def spans(text):
    """Character spans of the tokens, by decoding ever longer beginnings of the bytes."""
    coder, size = at.encoding(at.default_ranks())
    raw, out, a = text.encode(), [], 0
    for t in coder.encode_ordinary(text):
        b = a + int(size[t])
        first = len(raw[:a].decode("utf-8", "ignore"))
        out.append((first, len(raw[:b].decode("utf-8", "ignore")) if b == len(raw) or raw[b] & 0xC0 != 0x80
                    else len(raw[:b].decode("utf-8", "ignore")) + 1))
        a = b
    return out


def brute(text, sections, rule):
    n, over, outside = [0] * len(sections), [0] * len(sections), 0
    for a, b in spans(text):
        home = [next((k for k, (s, e) in enumerate(sections) if s <= c < e), None) for c in range(a, max(b, a + 1))]
        known = [k for k in home if k is not None]
        pick = {"start": home[0], "end": home[-1]}.get(rule)
        if rule == "most":
            pick = home[0] if len(set(home)) == 1 else max(sorted(set(known)), key=lambda k: (known.count(k), -k), default=None)
        if pick is None:
            outside += 1
        else:
            n[pick] += 1
            over[pick] += a < sections[pick][0] or b > sections[pick][1]
    return n, over, outside


TEXTS = ["one two\n\nthree\n", "", "\n", "naïve 日本語 😀😀\nüber\n\n\n   x", "no end", "a\n\n\n\nb\r\nc  \n  d"]


def lines(text):
    out, a = [], 0
    for part in text.splitlines(keepends=True) if False else [x + "\n" for x in text.split("\n")]:
        out.append((a, min(len(text), a + len(part))))
        a += len(part)
    return [s for i, s in enumerate(out) if i == 0 or s[0] < len(text)]


@pytest.mark.parametrize("rule", at.RULES)
def test_lines_and_rules(llm, rule):
    df = llm.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = {}
    for r in at.attribute_tokens(df, rule=rule).collect():
        rows.setdefault(r["doc_id"], []).append((r["section"], r["start"], r["end"], r["n_tokens"], r["n_crossing"]))
    for i, t in enumerate(TEXTS):
        secs = lines(t)
        n, over, _ = brute(t, secs, rule)
        assert sorted(rows[i]) == [(k, a, b, n[k], over[k]) for k, (a, b) in enumerate(secs)], t


@pytest.mark.parametrize("rule", at.RULES)
def test_given_sections(llm, rule):
    secs = [(0, 3), (3, 5), (9, 14), (14, 40)]
    df = llm.createDataFrame([(i, t, [{"start": a, "end": b} for a, b in secs]) for i, t in enumerate(TEXTS)],
                             "doc_id long, text string, parts array<struct<start:int,end:int>>")
    for r in at.attribute_tokens(df, sections_col="parts", rule=rule).collect():
        n, over, outside = brute(TEXTS[r["doc_id"]], secs, rule)
        if r["section"] == at.OUTSIDE:
            assert r["n_tokens"] == outside and r["start"] is None
        else:
            assert (r["n_tokens"], r["n_crossing"]) == (n[r["section"]], over[r["section"]])


def test_cases_and_query(llm, sf):
    df = llm.createDataFrame([(1, None, 0), (1, None, 0), (None, "a b", 0)], "doc_id long, text string, section int")
    got = sorted(str((r["doc_id"], r["section"], r["n_tokens"])) for r in at.attribute_tokens(df).collect())
    assert got == ["(1, 0, 0)", "(1, 0, 0)", "(None, 0, 2)"]
    assert at.attribute_tokens(df.limit(0)).count() == 0
    docs = {r["doc_id"]: r["text"] for r in llm.read.parquet(f"{sf}/documents.parquet").collect()}
    total: dict = {}
    for r in at.op9(llm, sf).collect():
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
    coder, _ = at.encoding(at.default_ranks())
    assert total == {i: len(coder.encode_ordinary(t or "")) for i, t in docs.items()}
