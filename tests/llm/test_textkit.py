import re

import numpy as np
import pyarrow as pa

from rivulet.llm import textkit as tk

TEXTS = ["Ab c\td", None, "", "x" * 50, "é\x00É  z", " ", "ab"]


def test_words_and_hashes():
    buf, off = tk.text_buffer(pa.array(TEXTS))
    norm = tk.lower_table(tk.ASCII_SPACE)[buf]
    s, e, ptr = tk.words(norm, off)
    want = [re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()) for t in TEXTS]
    raw = buf.tobytes().lower()
    assert [[raw[a:b] for a, b in zip(s[i:j], e[i:j], strict=True)] for i, j in zip(ptr, ptr[1:], strict=False)] == want
    h = tk.hash_spans(norm, s, e)
    assert (h == tk.hash_spans(norm, s, e, stretch=3)).all()
    by: dict = {}
    for w, x in zip([w for ws in want for w in ws], h.tolist(), strict=True):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)


def test_chunks_keep_rows_and_bounds():
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(TEXTS)], ["n", "text"])
    parts = list(tk.chunks(iter([batch, batch]), "text", limit=8, rows=3))
    assert [n for p in parts for n in p["n"].to_pylist()] == [*range(7), *range(7)]
    assert all(p.num_rows <= 3 for p in parts)
    for p in parts:
        sizes = [len((t or "").encode()) for t in p["text"].to_pylist()]
        assert sum(sizes) <= 8 or len([x for x in sizes if x]) == 1


def test_windows_and_groups():
    first, doc = tk.windows(np.array([0, 3, 3, 4]), 2)
    assert first.tolist() == [0, 1] and doc.tolist() == [0, 0]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 1, 2]), pa.array([5, 6, 7])], ["k", "v"])
    assert [g["v"].to_pylist() for g in tk.groups(iter([batch, batch.slice(2)]), ["k"])] == [[5, 6], [7, 7]]
