"""Document chunking (R1-R8): tables kept whole, parent/child hierarchy, baselines.

All chunkers are row-local: each document is turned into an array of chunks
with higher-order functions (``split``, ``transform``, ``aggregate``) and then
exploded, so chunking never shuffles and scales with the number of documents.
The greedy "append until the running length reaches the size" grouping is a
fold over slices of the paragraph (or sentence) array of one document, near
linear in its length.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions import fixed as X
from rivulet.functions.text import sentences

# the characters that the pattern (?U)\s matches
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _empty() -> Column:
    return F.array().cast("array<string>")


def strip(c: Column) -> Column:
    """Python-style ``str.strip()``: remove leading and trailing Unicode white space, reading only the ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def placeholder(i: Column) -> Column:
    return F.concat(F.lit("__TABLE_PLACEHOLDER_"), i.cast("string"), F.lit("__"))


def tables_of(text: Column) -> Column:
    """Markdown tables of a text, in order (R1); a table has bars, so a text without one is not searched."""
    return F.when(~F.contains(text, F.lit("|")), _empty()).otherwise(F.regexp_extract_all(text, F.lit(X.TABLE_PATTERN), 0))


def with_placeholders(text: Column, tables: Column) -> Column:
    """Text with the k-th table replaced by ``__TABLE_PLACEHOLDER_k__``.

    The text is cut around the table matches and re-joined, which gives the
    same result as replacing the first remaining occurrence of each table in
    turn, identical tables included.
    """
    n = F.size(tables)
    pieces = F.split(text, X.TABLE_PATTERN)
    return F.when(n == 0, text).otherwise(F.array_join(F.transform(pieces, lambda p, i: F.concat(
        p, F.when(i < n, placeholder(i)).otherwise(F.lit("")))), ""))


def restore(s: Column, tables: Column) -> Column:
    n = F.size(tables)
    put_back = F.aggregate(F.sequence(F.lit(0), n - 1), s,
                           lambda acc, k: F.replace(acc, placeholder(k), F.element_at(tables, k + 1)))
    return F.when(n > 0, put_back).otherwise(s)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def fold_groups(items: Column, size: int, emit, out_type: str) -> Column:
    """Append items until their summed length reaches ``size`` and emit the group; the rest is a last group.

    ``emit(group, tail)`` gives the array of results of one group.  The fold
    runs over slices of about the root of the number of items: appending to a
    slice's own results costs its length, and results of slices are put
    together once a slice, so the cost of one long text stays near linear.
    """
    none = F.array().cast(out_type)

    def state(out, cur, n):
        return F.struct(out.alias("out"), cur.alias("cur"), n.alias("n"))

    def step(acc, x):
        def close(cur):
            n = acc["n"] + F.length(x)
            return F.when(n >= size, state(F.concat(acc["out"], emit(cur, False)), _empty(), F.lit(0))).otherwise(
                state(acc["out"], cur, n))

        return let(F.concat(acc["cur"], F.array(x)), close)

    def fold(xs):
        n = F.size(xs)
        width = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))

        def one_slice(acc, first):
            inner = F.aggregate(F.slice(xs, first + 1, width), state(none, acc["cur"], acc["n"]), step)
            return let(inner, lambda r: state(F.concat(acc["out"], r["out"]), r["cur"], r["n"]))

        return F.aggregate(
            F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), width), state(none, _empty(), F.lit(0)), one_slice,
            lambda acc: F.when(F.size(acc["cur"]) > 0, F.concat(acc["out"], emit(acc["cur"], True))).otherwise(acc["out"]))

    return let(items, lambda xs: F.when(xs.isNotNull(), fold(xs)))


def greedy_join(items: Column, size: int, joiner: str) -> Column:
    """Append items until their summed length reaches ``size``, emit the group joined; the rest is a last group."""
    return fold_groups(items, size, lambda group, tail: F.array(F.array_join(group, joiner)), "array<string>")


_KID = "array<struct<text:string,tail:boolean>>"


def child_groups(sents: Column, size: int) -> Column:
    """Sentences appended until their summed length reaches ``size``; joined by a space and stripped.

    Empty groups are dropped; the leftover group is flagged ``tail``.
    """
    def emit(group, tail: bool):
        kid = lambda raw: F.array(F.struct(raw.alias("text"), F.lit(tail).alias("tail")))
        return let(strip(F.array_join(group, " ")), lambda raw: F.when(raw != "", kid(raw)).otherwise(F.array().cast(_KID)))

    return fold_groups(sents, size, emit, _KID)


def paragraphs(processed: Column, sep: str) -> Column:
    parts = F.transform(F.split(processed, re.escape(sep) if sep else r"\n\n"), strip)
    return F.filter(parts, lambda p: p != "")


def parent_chunks(df: DataFrame, text_col: str = "text", parent_size: int = X.PARENT_SIZE,
                  sep: str = X.PARAGRAPH_SEP, keep=("doc_id",)) -> DataFrame:
    """Parent blocks per document (R2): (keep..., p_idx, parent_text) with tables restored."""
    d = df.select(*keep, F.col(text_col).alias("_t")).withColumn("_tables", tables_of(F.col("_t")))
    d = d.withColumn("_parents", greedy_join(paragraphs(with_placeholders(F.col("_t"), F.col("_tables")), sep),
                                             parent_size, sep))
    d = d.select(*keep, "_tables", F.posexplode("_parents").alias("p_idx", "_p"))
    return d.select(*keep, F.col("p_idx").cast("bigint").alias("p_idx"),
                    restore(F.col("_p"), F.col("_tables")).alias("parent_text"))


def parent_child_chunks(df: DataFrame, text_col: str = "text", parent_size: int = X.PARENT_SIZE,
                        child_size: int = X.CHILD_SIZE, sep: str = X.PARAGRAPH_SEP,
                        keep=("doc_id",), with_parent: bool = True) -> DataFrame:
    """Child chunks with their parent text and hierarchy label ``p{i}-c{j}`` / ``p{i}-tail``.

    ``j`` numbers all chunks of the document emitted so far, across parents.
    ``with_parent=False`` leaves the parent text out (store parents once with
    ``parent_chunks`` and join them by (doc, p_idx) where needed).
    """
    d = df.select(*keep, F.col(text_col).alias("_t")).withColumn("_tables", tables_of(F.col("_t")))
    d = d.withColumn("_parents", greedy_join(paragraphs(with_placeholders(F.col("_t"), F.col("_tables")), sep),
                                             parent_size, sep))
    d = d.withColumn("_kids", F.transform("_parents", lambda p: child_groups(sentences(p), child_size)))
    # the place in the flat list of a document's chunks is their running number
    flat = F.flatten(F.transform("_kids", lambda kids, i: F.transform(kids, lambda k: F.struct(
        i.alias("p_idx"), k["text"].alias("text"), k["tail"].alias("tail"),
        *([F.element_at(F.col("_parents"), i + 1).alias("parent")] if with_parent else [])))))
    d = d.select(*keep, "_tables", F.posexplode(flat).alias("_no", "_c"))
    label = F.concat(F.lit("p"), F.col("_c.p_idx").cast("string"),
                     F.when(F.col("_c.tail"), F.lit("-tail")).otherwise(F.concat(F.lit("-c"), F.col("_no").cast("string"))))
    cols = [*keep, F.col("_c.p_idx").cast("bigint").alias("p_idx"), label.alias("chunk_hierarchy"),
            F.col("_no").cast("bigint").alias("chunk_no"), restore(F.col("_c.text"), F.col("_tables")).alias("text")]
    if with_parent:
        cols.append(restore(F.col("_c.parent"), F.col("_tables")).alias("parent_text"))
    return d.select(*cols)


def article_text(title: Column, summary: Column) -> Column:
    """``Title: ...\\nSummary: ...``."""
    return F.concat(F.lit("Title: "), F.coalesce(title, F.lit("")), F.lit("\nSummary: "), F.coalesce(summary, F.lit("")))


def chunk_articles(articles: DataFrame, parent_size: int = X.PARENT_SIZE, child_size: int = X.CHILD_SIZE) -> DataFrame:
    """News path: article text -> parent/child chunks with source link and ingest timestamp."""
    a = articles.select(F.col("link").alias("source"), F.col("ingest_timestamp").alias("timestamp"),
                        article_text(F.col("title"), F.col("summary")).alias("text"))
    return parent_child_chunks(a, "text", parent_size, child_size, keep=("source", "timestamp"))


def fixed_chunks(df: DataFrame, size: int = 500, text_col: str = "text", keep=("doc_id",)) -> DataFrame:
    """Fixed-size character slices (R5), taken in one pass along the text."""
    slices = F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{size}}}"), 0)
    d = df.select(*keep, F.posexplode(slices).alias("c_idx", "text"))
    return d.select(*keep, F.col("c_idx").cast("bigint").alias("c_idx"), "text")


def recursive_chunks(df: DataFrame, size: int = 1000, overlap: int = 150, text_col: str = "text",
                     keep=("doc_id",)) -> DataFrame:
    """Paragraph packing with an overlap tail carried into the next chunk."""
    paras = F.split(F.col(text_col), r"\n\n")
    init = F.struct(_empty().alias("out"), _empty().alias("cur"), F.lit(0).alias("n"))

    def step(acc, p):
        cur = F.concat(acc["cur"], F.array(p))
        n = acc["n"] + F.length(p)
        full = n >= size
        carry = F.when(F.length(p) > overlap, F.array(F.substring(p, -overlap, overlap))).otherwise(_empty())
        return F.struct(
            F.when(full, F.concat(acc["out"], F.array(F.array_join(cur, "\n\n")))).otherwise(acc["out"]).alias("out"),
            F.when(full, carry).otherwise(cur).alias("cur"),
            F.when(full, F.when(F.length(p) > overlap, F.lit(overlap)).otherwise(F.lit(0))).otherwise(n).alias("n"))

    def finish(acc):
        return F.when(F.size(acc["cur"]) > 0,
                      F.concat(acc["out"], F.array(F.array_join(acc["cur"], "\n\n")))).otherwise(acc["out"])

    # paragraphs of a text below the size never fill a chunk, and joined again they are the text
    packed = F.when(F.length(F.col(text_col)) < size, F.array(F.col(text_col))).otherwise(F.aggregate(paras, init, step, finish))
    d = df.select(*keep, F.posexplode(packed).alias("c_idx", "text"))
    return d.select(*keep, F.col("c_idx").cast("bigint").alias("c_idx"), "text")


def document_tables(df: DataFrame, text_col: str = "text", keep=("doc_id",)) -> DataFrame:
    """(doc, table_idx, table) for every Markdown table."""
    d = df.select(*keep, F.posexplode(tables_of(F.col(text_col))).alias("table_idx", "table"))
    return d.select(*keep, F.col("table_idx").cast("bigint").alias("table_idx"), "table")
