"""Vectors: term frequencies, hashed sparse vectors, dense encoders, centroids.

The default dense encoder is model-free: token counts hashed into ``dim``
buckets (a hashing vectorizer).  Its vectors hold small integers, so dot
products and norms are exact and cosine scores are reproducible bit for bit.
A model encoder plugs in through ``encode_with`` (Arrow-batched pandas UDF).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from rivulet.functions import fixed as X
from rivulet.functions.hashing import bucket, md5_prefix
from rivulet.functions.text import tokens

DENSE_DIM = 256


def _count_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the values of (id, list) rows sorted by id; the last id of a batch may go on in the next and waits."""
    held = None
    for batch in batches:
        ids, lists = batch.column(0), batch.column(1)
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        rows = pa.table({"id": ids.take(pa.array(np.repeat(np.arange(len(ids)), lengths))), "value": lists.flatten(),
                         "n": pa.array(np.ones(lengths.sum(), np.int64))})
        counted = _summed(rows if held is None else pa.concat_tables([held, rows]))
        if not counted.num_rows:
            continue
        code = counted["id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        first = int(np.flatnonzero(code == code[-1])[0])
        held = counted.slice(first)
        yield from counted.slice(0, first).to_batches()
    if held is not None:
        yield from held.to_batches()


def _summed(rows: pa.Table) -> pa.Table:
    """One row per (id, value) with the sum of ``n``; ids stay in the order of their first rows."""
    if not rows.num_rows:
        return rows
    id_code, value = (rows[c].combine_chunks().dictionary_encode(null_encoding="encode") for c in ("id", "value"))
    key = id_code.indices.to_numpy().astype(np.int64) * len(value.dictionary) + value.indices.to_numpy()
    found, at = np.unique(key, return_inverse=True)
    n = np.bincount(at, rows["n"].to_numpy(), len(found)).astype(np.int64)
    each, which = np.divmod(found, len(value.dictionary))
    return pa.table({"id": id_code.dictionary.take(pa.array(each)), "value": value.dictionary.take(pa.array(which)), "n": pa.array(n)})


def list_counts(df: DataFrame, id_col: str, lists: Column, value_type: str) -> DataFrame:
    """(id, value, n): how often each value occurs in the lists of an id.

    Texts are shuffled, not their words: rows of an id are brought together and
    sorted, then counted as they pass, so nothing is held but one batch.
    """
    together = df.select(F.col(id_col).alias("id"), *(F.col(c).alias(c) for c in df.columns if c != id_col))
    together = together.repartition("id").sortWithinPartitions("id").select("id", lists.alias("_l"))
    kind = df.schema[id_col].dataType.simpleString()
    return together.mapInArrow(_count_lists, f"id {kind}, value {value_type}, n long").withColumnRenamed("id", id_col)


def term_freq(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, token, tf): raw term frequency per text (A2); the texts of an id are counted where they meet."""
    words = list_counts(df.select(id_col, F.col(text_col).alias("_t")), id_col, tokens(F.col("_t")), "string")
    return words.withColumnsRenamed({"value": "token", "n": "tf"})


def sparse_postings(df: DataFrame, id_col: str = "id", text_col: str = "text",
                    buckets: int = X.SPARSE_BUCKETS, method: str = "md5") -> DataFrame:
    """(id, idx, weight): term counts summed per hash bucket, collisions add up."""
    if method == "murmur3":  # the hash costs more than a word's count: each word of a text once
        t = term_freq(df, id_col, text_col).withColumn("idx", bucket(F.col("token"), buckets, method))
        return t.groupBy(id_col, "idx").agg(F.sum("tf").cast("double").alias("weight"))
    hashed = F.transform(tokens(F.col("_t")), lambda t: bucket(t, buckets, method))
    found = list_counts(df.select(id_col, F.col(text_col).alias("_t")), id_col, hashed, "long")
    return found.select(id_col, F.col("value").alias("idx"), F.col("n").cast("double").alias("weight"))


def sparse_vectors(postings: DataFrame, id_col: str = "id") -> DataFrame:
    """Postings folded to one map per id: (id, sparse MAP<BIGINT, DOUBLE>) - bounded by the text length."""
    return postings.groupBy(id_col).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("idx", "weight")))).alias("sparse"))


def token_buckets(text: Column, dim: int) -> Column:
    """md5 bucket of every token (JVM-side)."""
    return F.transform(tokens(text), lambda t: F.pmod(md5_prefix(t), F.lit(dim)))


def _bincount_udf(dim: int):
    @F.pandas_udf(ArrayType(DoubleType()))
    def _counts(b: pd.Series) -> pd.Series:
        return pd.Series([np.bincount(np.asarray(x, dtype=np.int64), minlength=dim).astype(np.float64)
                          if x is not None else np.zeros(dim) for x in b])

    return _counts


def hashed_counts(text: Column, dim: int = DENSE_DIM) -> Column:
    """Dense vector of token counts per md5 bucket (model-free encoder), as array<double>.

    Buckets are computed in the JVM; the count vector is built per Arrow batch.
    """
    return _bincount_udf(dim)(token_buckets(text, dim))


def l2_normalize(vec: Column) -> Column:
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(vec, lambda x: x / norm)).otherwise(vec)


def encode(df: DataFrame, text_col: str = "text", out_col: str = "embedding", dim: int = DENSE_DIM) -> DataFrame:
    """Model-free dense encoding (R9 default): buckets in the JVM, count vectors in Arrow batches."""
    return df.withColumn(out_col, hashed_counts(F.col(text_col), dim))


def encode_with(df: DataFrame, encoder: Callable[[list[str]], np.ndarray], text_col: str = "text",
                out_col: str = "embedding") -> DataFrame:
    """Plug-in dense encoder applied on Arrow batches (``spark.sql.execution.arrow.maxRecordsPerBatch``).

    ``encoder`` maps a list of texts to a 2-D array, one row per text - the
    batch form of a sentence-embedding model.
    """
    @F.pandas_udf(ArrayType(DoubleType()))
    def _enc(texts: pd.Series) -> pd.Series:
        m = np.asarray(encoder(texts.fillna("").tolist()), dtype=np.float64)
        return pd.Series(list(m))

    return df.withColumn(out_col, _enc(F.col(text_col)))


NGRAM_DIM = 1024


def grams(text: Column) -> Column:
    """Words and their character pairs, word ends marked: texts that share parts of words share grams."""
    def of(w: Column) -> Column:
        marked = F.concat(F.lit("^"), w, F.lit("$"))
        pairs = F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(marked, i, F.lit(2)))
        return F.concat(F.array(F.concat(F.lit("w:"), w)), pairs)
    return F.flatten(F.transform(tokens(text), of))


def gram_counts(df: DataFrame, keys: list[str], text_col: str, dim: int = NGRAM_DIM) -> DataFrame:
    """(keys, d, c): hashed gram counts of each text; built-in functions only."""
    t = df.select(*keys, F.explode(grams(F.col(text_col))).alias("_g"))
    return t.groupBy(*keys, F.pmod(md5_prefix(F.col("_g")), F.lit(dim)).alias("d")).agg(F.count(F.lit(1)).cast("double").alias("c"))


def rarity(counts: list[DataFrame], texts: Column | int) -> DataFrame:
    """(d, idf): smoothed inverse document frequency of every bucket over several sets of texts; at most ``dim`` rows."""
    df = counts[0].select("d")
    for c in counts[1:]:
        df = df.union(c.select("d"))
    n = texts if isinstance(texts, Column) else F.lit(texts)
    return df.groupBy("d").agg(F.count(F.lit(1)).alias("_df")).select(
        "d", (F.log((n + F.lit(1.0)) / (F.col("_df") + F.lit(1.0))) + F.lit(1.0)).alias("idf"))


def unit_weights(counts: DataFrame, idf: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, d, v): counts times rarity, at unit length per text."""
    w = counts.join(F.broadcast(idf), "d").withColumn("v", F.col("c") * F.col("idf"))
    norm = w.groupBy(*keys).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("_n"))
    return w.join(norm, keys).select(*keys, "d", (F.col("v") / F.col("_n")).alias("v"))


def centroids(vectors: DataFrame, label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """Per label: element-wise mean of unit vectors, then L2-normalised (A4).

    Dimensions are exploded and averaged with a partial aggregate; each label's
    vector is rebuilt from at most ``dim`` values.
    """
    unit = vectors.select(label_col, l2_normalize(F.col(vec_col)).alias("_u"))
    per_dim = (unit.select(label_col, F.posexplode("_u").alias("pos", "v"))
               .groupBy(label_col, "pos").agg(F.avg("v").alias("v")))
    rebuilt = per_dim.groupBy(label_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("_m"))
    return rebuilt.select(label_col, l2_normalize(F.col("_m")).alias("centroid"))
