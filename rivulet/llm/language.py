"""Language identification by Bayesian evidence fusion.

Four kinds of evidence about a page are multiplied: how likely its text is
under trigram models of each language, which language its markup declares,
which suffix its address has, and which languages its host has shown.  The
trigram models come from labelled documents.  The other three are learned from
the pages themselves by grouped aggregation of the text's own verdicts: a
confusion table for declared languages, one for suffixes, and host priors that
are smoothed towards the host's domain and the domain's towards all pages.  A
page's own verdict is taken out of its host's prior.

Tables by language, suffix and trigram bucket are of bounded size; hosts and
domains are not and are joined, after being aggregated where the pages are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import textkit as tk
from rivulet.llm.catalog import query
from rivulet.llm.common import prepare, stored, table

BUCKET_BITS = 15
KAPPA = 4.0  # pages that the level above counts for in a prior
TEMPER = 0.2  # of the text's log likelihood, since neighbouring trigrams depend on each other
SMOOTH = 1.0


def trigrams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram bucket and document of every three neighbouring letters; a gap between words is one blank."""
    t = np.zeros(256, np.uint8)
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    c = t[buf].astype(np.uint64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    keep = np.ones(len(c), bool)
    if len(c):
        keep[1:] = (c[1:] != 0) | (c[:-1] != 0) | (doc[1:] != doc[:-1])
    c, doc = c[keep], doc[keep]
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = doc[2:] == doc[:-2]
    h = tk.mix64(c[:-2] << np.uint64(16) | c[1:-1] << np.uint64(8) | c[2:])
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)[same], doc[2:][same]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for chunk in tk.chunks(batches, "text"):
        bucket, doc = trigrams(*tk.text_buffer(chunk["text"]))
        names = np.array(chunk["lang"].to_pylist(), object)
        for name in set(names.tolist()):
            now = np.bincount(bucket[(names == name)[doc]], minlength=1 << BUCKET_BITS)
            total[name] = total.get(name, 0) + now
    for name, n in sorted(total.items()):
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])


def text_models(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their add-half trigram log probabilities, from all labelled documents; null labels are left out."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null")
    counts = rows.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    names = sorted({r["lang"] for r in counts})
    place = {x: i for i, x in enumerate(names)}
    n = np.full((len(names), 1 << BUCKET_BITS), 0.5)
    for r in counts:
        n[place[r["lang"]], r["bucket"]] += r["n"]
    return names, np.log(n / n.sum(1, keepdims=True))


def page_text(html: Column) -> Column:
    """Visible text: scripts, styles, comments and tags become blanks."""
    html = F.coalesce(html, F.lit(""))
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")


def declared(html: Column) -> Column:
    """Primary tag of the markup's language attribute, lower-cased; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def text_verdicts(pages: DataFrame, names: list[str], model: np.ndarray, text_col: str) -> DataFrame:
    """Tempered log likelihoods of the languages, as an array column ``ll``, from column ``text_col`` (which is dropped)."""
    held = pages.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in pages.schema.fields if f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tk.chunks(batches, text_col):
            bucket, doc = trigrams(*tk.text_buffer(chunk[text_col]))
            ll = np.stack([np.bincount(doc, m[bucket], chunk.num_rows) for m in held.value], 1) * TEMPER
            yield pa.RecordBatch.from_arrays([*(chunk[f.name].combine_chunks() for f in kept), pa.array(list(ll), pa.list_(pa.float64()))],
                                             [*(f.name for f in kept), "ll"])

    return pages.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "ll array<double>"]))


def _posterior(score: Column) -> Column:
    top = F.array_max(score)
    raised = F.transform(score, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, y: a + y))


def _sums(p: str, k: int) -> list[Column]:
    return [F.sum(F.col(p)[i]).alias(f"s{i}") for i in range(k)]


def _logs(k: int, f) -> Column:
    return F.array(*(F.log(f(i)) for i in range(k)))


def identify(pages: DataFrame, names: list[str], model: np.ndarray, id_col: str = "page_id", url_col: str = "url",
             html_col: str = "html") -> DataFrame:
    """One row per page: id, ``host``, ``declared``, ``text_lang``, ``lang``, ``probability`` (of ``lang``).

    Null or empty markup has no text evidence and declares nothing; a null or
    unreadable address is the empty host, which has a prior like any other.
    Ties go to the first language in alphabetical order.  Repeated rows are
    pages of their own.  Other input columns are ignored; an empty table
    gives an empty result.  Without labelled languages, ``lang`` is null.
    """
    spark = prepare(pages.sparkSession)
    html, url, k = F.col(html_col), F.col(url_col), len(names)
    base = pages.select(F.col(id_col).alias("page"), host_of(url).alias("host"), declared(html).alias("declared"), page_text(html).alias("body"))
    if not k:
        null = F.lit(None).cast("string")
        return base.select(F.col("page").alias(id_col), "host", "declared", null.alias("text_lang"), null.alias("lang"),
                           F.lit(None).cast("double").alias("probability"))
    seen = text_verdicts(base, names, model, "body").withColumn("p", _posterior(F.col("ll"))).withColumn(
        "domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1))
    seen = stored(seen)
    whole = seen.agg(F.count("*").alias("n"), *_sums("p", k)).first()
    share = np.array([(whole[f"s{i}"] or 0) + SMOOTH for i in range(k)])
    share /= share.sum()
    tables = {}
    for name in ("declared", "suffix"):
        t = seen.groupBy(name).agg(*_sums("p", k))
        kinds = t.count()
        like = _logs(k, lambda i, kinds=kinds: (F.col(f"s{i}") + SMOOTH / k) / (float(whole[f"s{i}"] or 0) + SMOOTH * max(1, kinds) / k))
        tables[name] = t.select(name, F.when(F.col(name) == "", F.array_repeat(F.lit(0.0), k)).otherwise(like).alias(f"{name}_like"))
    domains = seen.groupBy("domain").agg(F.count("*").alias("dn"), F.array(*(F.sum(F.col("p")[i]) for i in range(k))).alias("ds"))
    hosts = seen.groupBy("host", "domain").agg(F.count("*").alias("hn"), F.array(*(F.sum(F.col("p")[i]) for i in range(k))).alias("hs"))
    priors = hosts.join(domains, "domain").drop("domain")
    df = seen.drop("domain").join(priors, "host")
    for name, t in tables.items():
        df = df.join(t, name)

    def prior(i: int) -> Column:
        own = F.col("p")[i]
        domain = (F.greatest(F.col("ds")[i] - own, F.lit(0.0)) + KAPPA * float(share[i])) / (F.col("dn") - 1 + KAPPA)
        return (F.greatest(F.col("hs")[i] - own, F.lit(0.0)) + KAPPA * domain) / (F.col("hn") - 1 + KAPPA)

    score = F.array(*(F.col("ll")[i] + F.col("declared_like")[i] + F.col("suffix_like")[i] + F.log(prior(i)) for i in range(k)))
    langs = F.array(*map(F.lit, names))
    out = df.withColumn("q", _posterior(score))
    best = lambda c: F.element_at(langs, F.array_position(c, F.array_max(c)).cast("int"))
    return out.select(F.col("page").alias(id_col), "host", "declared", best(F.col("p")).alias("text_lang"), best(F.col("q")).alias("lang"),
                      F.array_max("q").alias("probability"))


@query("op4_language")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page, with text models from all labelled documents."""
    names, model = text_models(table(spark, sf_dir, "documents"))
    return identify(table(spark, sf_dir, "pages"), names, model)
