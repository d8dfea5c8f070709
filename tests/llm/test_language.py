import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from rivulet.llm import language as la
from rivulet.llm import textkit as tk

DOCS = [("the cat and the dog with the ball", "en"), ("der hund und die katze mit dem ball", "de"), ("le chat et le chien avec la balle", "fr"),
        ("odd", None), (None, "en")]
PAGES = [(1, "http://a.x.de/1", '<html lang="de"><p>der hund und die katze</p></html>'), (2, "http://a.x.de/2", "<p>the hund</p>"),
         (3, "http://b.x.de", '<html lang="fr-FR"><script>the the the</script><!-- der -->le chat et le chien'), (4, None, None), (5, "odd", ""),
         (6, "https://u@b.x.de:80/q?x", "<html lang='de'>dem ball"), (6, "https://u@b.x.de:80/q?x", "<html lang='de'>dem ball"), (None, "http://c.org", "the dog")]


def brute(pages, names, model):
    rows = []
    for i, url, html in pages:
        h = html or ""
        m = re.search(r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", h)
        text = re.sub(r"<[^>]*>", " ", re.sub(r"(?s)<!--.*?-->", " ", re.sub(r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ", h)))
        u = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
        host = u[1].lower() if u else ""
        b, _ = la.trigrams(*tk.text_buffer(pa.array([text])))
        ll = np.array([x[b].sum() for x in model]) * la.TEMPER
        p = np.exp(ll - ll.max())
        rows.append([i, host, m[1].lower() if m else "", ll, p / p.sum()])
    k = len(names)
    total = sum(r[4] for r in rows)
    share = (total + la.SMOOTH) / (total + la.SMOOTH).sum()
    out = []
    for i, host, d, ll, p in rows:
        dom = lambda h: ".".join(h.split(".")[-2:])
        score = ll.copy()
        for value, f in ((d, lambda r: r[2]), (host.rsplit(".")[-1], lambda r: r[1].rsplit(".")[-1])):
            groups = defaultdict(float)
            for r in rows:
                groups[f(r)] = groups[f(r)] + r[4]
            if value:
                score = score + np.log((groups[value] + la.SMOOTH / k) / (total + la.SMOOTH * len(groups) / k))
        same = [r[4] for r in rows if r[1] == host]
        wide = [r[4] for r in rows if dom(r[1]) == dom(host)]
        domain = (sum(wide) - p + la.KAPPA * share) / (len(wide) - 1 + la.KAPPA)
        score = score + np.log((sum(same) - p + la.KAPPA * domain) / (len(same) - 1 + la.KAPPA))
        q = np.exp(score - score.max())
        out.append((str(i), names[int(q.argmax())], float((q / q.sum()).max())))
    return sorted(out)


def test_matches_brute_force(llm):
    names, model = la.text_models(llm.createDataFrame(DOCS, "text string, lang string"))
    assert names == ["de", "en", "fr"] and np.allclose(np.exp(model).sum(1), 1)
    df = llm.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    got = sorted((str(r["page_id"]), r["lang"], r["probability"]) for r in la.identify(df, names, model).collect())
    want = brute(PAGES, names, model)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], rel=1e-9)


def test_cases(llm):
    df = llm.createDataFrame(PAGES, "page_id long, url string, html string")
    names, model = la.text_models(llm.createDataFrame(DOCS, "text string, lang string"))
    assert la.identify(df.limit(0), names, model).count() == 0
    none = la.identify(df, *la.text_models(llm.createDataFrame([], "text string, lang string"))).collect()
    assert len(none) == len(PAGES) and all(r["lang"] is None for r in none)
    clash = df.selectExpr("*", "1 as host", "2 as p", "3 as lang")
    assert la.identify(clash, names, model).count() == len(PAGES)


def test_query_agrees_with_markup(llm, sf):
    rows = la.op4(llm, sf).collect()
    assert len(rows) == llm.read.parquet(f"{sf}/pages.parquet").count()
    told = [r for r in rows if r["declared"]]
    assert sum(r["lang"] == r["declared"] for r in told) > 0.9 * len(told) and all(0 <= r["probability"] <= 1 + 1e-9 for r in rows)
    assert not any(math.isnan(r["probability"]) for r in rows)
