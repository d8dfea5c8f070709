"""Token counts by section, from one encoding of the whole document.

Encoding sections one by one changes the tokens at their edges, so the whole
text is encoded once.  Token lengths in bytes add up to the tokens' places, the
places are turned into character spans, and an interval join against the
sorted sections of the same document (two binary searches per token, all
documents of a chunk at once) finds where each token begins and ends.  A token
that crosses a boundary is allocated by an explicit rule, so that the counts of
all sections add up to the tokens of the document.  Nothing is shuffled.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import textkit as tk
from rivulet.llm.catalog import query
from rivulet.llm.common import prepare, table

RULES = ("start", "end", "most")
OUTSIDE = -1

_encodings: dict[str, tuple] = {}


def encoding(path: str) -> tuple:
    """The byte-level encoding of a rank file, and the length in bytes of every token; kept by the worker."""
    if path not in _encodings:
        import public_tokenizers
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            size[rank] = len(token)
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), size
    return _encodings[path]


def default_ranks() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def line_sections(buf: np.ndarray, off: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines with their line ends as sections: first and last character (exclusive) and document of each."""
    cut = np.flatnonzero(buf == 10) + 1
    inner = cut[~np.isin(cut, off)]
    begin = np.sort(np.concatenate([off[:-1], inner]))
    doc = np.sort(np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, inner, side="right") - 1]))
    end = np.append(begin[1:], off[-1])
    return char[begin] - char[off[doc]], char[end] - char[off[doc]], doc


def allocate(start: np.ndarray, end: np.ndarray, doc: np.ndarray, s_start: np.ndarray, s_end: np.ndarray, s_doc: np.ndarray,
             width: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section (row number, or OUTSIDE) of each token, and whether the token reaches beyond that section.

    Spans are characters; sections are sorted and do not overlap.  Rules:
    ``start`` and ``end`` take the section of the token's first or last
    character, ``most`` the one with most of its characters (the first of
    equals).  A token whose deciding character is in no section is outside.
    """
    key = s_doc * np.int64(width) + s_start

    def at(place: np.ndarray) -> np.ndarray:
        i = np.searchsorted(key, doc * np.int64(width) + place, side="right") - 1
        ok = i >= 0
        i = np.maximum(i, 0)
        if len(key):
            ok &= (s_doc[i] == doc) & (place < s_end[i]) & (place >= s_start[i])
        else:
            ok[:] = False
        return np.where(ok, i, OUTSIDE)

    last = np.maximum(end - 1, start)
    chosen = at(last if rule == "end" else start)
    if rule == "most":
        cross = np.flatnonzero(at(last) != chosen)
        for t in cross.tolist():  # the few tokens over a boundary
            places = at_all = np.arange(start[t], last[t] + 1)
            i = np.searchsorted(key, doc[t] * np.int64(width) + places, side="right") - 1
            at_all = [int(k) for k, c in zip(i, places, strict=True) if k >= 0 and s_doc[k] == doc[t] and s_start[k] <= c < s_end[k]]
            chosen[t] = max(sorted(set(at_all)), key=lambda k: (at_all.count(k), -k), default=OUTSIDE)
    inside = np.maximum(chosen, 0)
    crossing = (chosen != OUTSIDE) & ((start < s_start[inside]) | (end > s_end[inside])) if len(key) else np.zeros(len(start), bool)
    return chosen, crossing


def attribute_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None,
                     rule: str = "start", ranks: str | None = None) -> DataFrame:
    """One row per document and section: ``section``, ``start``, ``end``, ``n_tokens``, ``n_crossing``.

    ``sections_col`` holds an array of (start, end) in characters, sorted and
    without overlap; without it the lines of the text are its sections.
    Tokens in no section are reported as section -1 (start and end null).  A
    null or empty text is one empty line and has no tokens; null ids are
    kept; repeated rows are counted each; other input columns are ignored; an
    empty table gives an empty result.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    prepare(docs.sparkSession)
    path = ranks or default_ranks()
    kind = docs.schema[id_col].dataType.simpleString()
    cols = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")]
    if sections_col:
        cols.append(F.transform(sections_col, lambda s: F.array(s["start"].cast("long"), s["end"].cast("long"))).alias("sections"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, size = encoding(path)
        for chunk in tk.chunks(batches, "text"):
            buf, off = tk.text_buffer(chunk["text"])
            n = len(off) - 1
            char = np.zeros(len(buf) + 1, np.int64)  # characters that begin before each byte
            np.cumsum((buf & 0xC0) != 0x80, out=char[1:])
            ids = [np.array(coder.encode_ordinary(t or ""), np.int64) for t in chunk["text"].to_pylist()]
            doc = np.repeat(np.arange(n), [len(x) for x in ids])
            length = size[np.concatenate(ids)] if len(doc) else np.zeros(0, np.int64)
            stop = np.cumsum(length)  # the texts lie one after another, and so do their tokens
            begin = stop - length
            part = (buf[np.minimum(begin, len(buf) - 1)] & 0xC0) == 0x80 if len(doc) else np.zeros(0, bool)
            origin = char[off[doc]]
            start, end = char[begin] - part - origin, char[stop] - origin
            if sections_col:
                lists = chunk["sections"].to_pylist()
                s_doc = np.repeat(np.arange(n), [len(x or ()) for x in lists])
                flat = np.array([p for x in lists for p in x or ()], np.int64).reshape(-1, 2)
                s_start, s_end = flat[:, 0], flat[:, 1]
            else:
                s_start, s_end, s_doc = line_sections(buf, off, char)
            width = int(max(len(buf), s_end.max() if len(s_end) else 0)) + 2
            chosen, crossing = allocate(start, end, doc, s_start, s_end, s_doc, width, rule)
            inside = chosen >= 0
            tokens = np.bincount(chosen[inside], minlength=len(s_doc))
            over = np.bincount(chosen[crossing], minlength=len(s_doc))
            number = np.arange(len(s_doc)) - np.searchsorted(s_doc, s_doc)
            outside = np.bincount(doc[~inside], minlength=n)
            lost = np.flatnonzero(outside)
            rows = np.concatenate([s_doc, lost])
            blank = np.zeros(len(rows), bool)
            blank[len(s_doc):] = True
            pad = np.zeros(len(lost), np.int64)
            yield pa.RecordBatch.from_arrays(
                [chunk["doc_id"].combine_chunks().take(pa.array(rows)), pa.array(np.concatenate([number, pad + OUTSIDE])),
                 pa.array(np.concatenate([s_start, pad]), mask=blank), pa.array(np.concatenate([s_end, pad]), mask=blank),
                 pa.array(np.concatenate([tokens, outside[lost]])), pa.array(np.concatenate([over, pad]))],
                ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    return docs.select(*cols).mapInArrow(run, f"doc_id {kind}, section long, start long, end long, n_tokens long, n_crossing long").withColumnRenamed(
        "doc_id", id_col)


@query("op9_attribution")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a token over a line end belongs to the line of its first character."""
    return attribute_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
