"""Quality rules: a threshold table compiled into one Spark projection.

A rule is a ratio of two measures with bounds.  The measures are built-in
expressions over the text and its word and line arrays (lengths, symbols,
stop words, repeated lines and windows), so the verdict is one projection
without user functions and without a shuffle: documents are judged where they
are read, whatever their number or size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.catalog import query
from rivulet.llm.common import prepare, spare, table

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in a is that for it as was with on be by at an this from are or "
    "der die das und in zu den mit von für auf ist im dem nicht ein eine als auch es "
    "le la les de des et un une du en que qui est pour dans sur pas au par plus "
    "el la los de las y en que un una por con para no se su al lo como es del").split()


@dataclass(frozen=True)
class Rule:
    """Bounds of ``part`` per ``whole``; documents with fewer than ``words`` words are not held to it."""

    name: str
    part: str
    whole: str | None
    low: float | None = None
    high: float | None = None
    words: int = 0


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2, 20),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.1),
    Rule("exclamations_per_word", "n_marks", "n_words", None, 0.5),
    Rule("capitals_per_char", "n_capitals", "word_chars", None, 0.6),
    Rule("letter_words", "n_letter_words", "n_words", 0.6, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("echoed_words", "n_echo_words", "n_words", None, 0.2),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.3),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 0.9),
    Rule("stop_words", "n_stop_words", None, 1, None, words=40),
)


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _measures(df: DataFrame, text: str, words: str, lines: str) -> dict[str, Column]:
    t, w, ln = F.coalesce(F.col(text), F.lit("")), F.col(words), F.col(lines)
    solid = _without(t, BLANKS)
    return {
        "n_words": F.size(w),
        "word_chars": F.length(solid),
        "n_symbols": F.length(t) - F.length(_without(t, SYMBOLS)),
        "n_marks": F.length(t) - F.length(_without(t, "!")),
        "n_capitals": F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", "")),
        "n_letter_words": F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))),
        "n_echo_words": F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))),
        "n_lines": F.size(ln),
        "n_dup_lines": F.size(ln) - F.size(F.array_distinct(ln)),
        "n_ellipsis_lines": F.size(F.filter(ln, lambda x: x.rlike(r"(\.\.\.|…)\s*$"))),
        "n_bullet_lines": F.size(F.filter(ln, lambda x: x.rlike(r"^\s*[-*•]\s"))),
        "n_stop_words": F.size(F.array_intersect(F.transform(w, F.lower), F.array(*map(F.lit, sorted(set(STOP_WORDS)))))),
    }


def verdict(rules: tuple[Rule, ...]) -> Column:
    """Whether all rules hold, as one expression over the measure columns."""
    out = F.lit(True)
    for r in rules:
        whole = F.lit(1) if r.whole is None else F.col(r.whole)
        ok = F.lit(True)
        if r.low is not None:
            ok = ok & (F.col(r.part) >= F.lit(float(r.low)) * whole)
        if r.high is not None:
            ok = ok & (F.col(r.part) <= F.lit(float(r.high)) * whole)
        out = out & (ok | (F.col("n_words") < r.words))
    return out


def quality(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, window: int = 5) -> DataFrame:
    """Add the measures, ``n_repeat_words``, ``base_failed`` and ``kept``.

    Words are maximal runs of non-blank characters.  ``n_repeat_words`` counts
    words inside windows of ``window`` words that occur twice or more in the
    text.  A null or empty text has no words and fails.  Rows are independent,
    so repeated rows repeat their verdict and an empty table gives an empty
    result; input columns with the added names are replaced.
    """
    prepare(docs.sparkSession)
    added = {*_measures(docs, text_col, text_col, text_col), "n_repeat_words", "base_failed", "kept"}
    docs = docs.select([c for c in docs.columns if c.lower() not in added])
    words, lines, hashes, ordered, at = spare(docs, "words", "lines", "hashes", "ordered", "at")
    t = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumns({
        words: F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), ""),
        lines: F.filter(F.split(t, "\n"), lambda x: _without(x, BLANKS) != "")})
    df = df.withColumns(_measures(df, text_col, words, lines))
    starts = F.sequence(F.lit(1), F.size(words) - (window - 1))
    # Windows that differ in hash are different; only texts in which two agree are compared word by word.
    df = df.withColumn(hashes, F.when(F.size(words) > window, F.transform(
        starts, lambda i: F.xxhash64(*(F.get(F.col(words), i + (j - 1)) for j in range(window))))))
    df = df.withColumn(ordered, F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(F.transform(
        starts, lambda i: F.struct(F.concat_ws(" ", F.slice(F.col(words), i, window)).alias("w"), i.alias("i"))))))
    df = df.withColumn(at, F.sort_array(F.transform(F.filter(F.arrays_zip(
        F.col(ordered).alias("own"),
        F.concat(F.array(F.lit(None).cast("struct<w:string,i:int>")), F.slice(ordered, 1, F.size(ordered) - 1)).alias("before"),
        F.slice(ordered, 2, F.size(ordered)).alias("after")),
        lambda x: (x["own"]["w"] == F.coalesce(x["before"]["w"], F.lit(""))) | (x["own"]["w"] == F.coalesce(x["after"]["w"], F.lit("")))),
        lambda x: x["own"]["i"])))
    repeated = F.aggregate(at, F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n")), lambda a, i: F.struct(
        i.alias("last"), (a["n"] + F.least(i - a["last"], F.lit(window))).alias("n")), lambda a: a["n"])
    df = df.withColumn("n_repeat_words", F.coalesce(repeated, F.lit(0)))
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    df = df.withColumn("kept", ~F.col("base_failed") & verdict(rules))
    return df.drop(words, lines, hashes, ordered, at)


def _sql() -> str:
    """The same rules for DuckDB, from the same table."""
    held = []
    for r in RULES:
        whole = "1" if r.whole is None else r.whole
        parts = ([f"{r.part} >= {float(r.low)} * {whole}"] if r.low is not None else []) + (
            [f"{r.part} <= {float(r.high)} * {whole}"] if r.high is not None else [])
        held.append(f"(({' AND '.join(parts)}) OR n_words < {r.words})")
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    blank = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: translate(x, {blank}, '') <> '') AS l FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM a WHERE len(w) > 4)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
m AS (SELECT a.doc_id, len(w) AS n_words, length(translate(t, {blank}, '')) AS word_chars,
  length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, length(t) - length(replace(t, '!', '')) AS n_marks,
  length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_capitals,
  len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words, len(l) AS n_lines,
  len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_echo_words,
  len(l) - len(list_distinct(l)) AS n_dup_lines,
  len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipsis_lines,
  len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*•]\s'))) AS n_bullet_lines,
  len(list_intersect(list_transform(w, lambda x: lower(x)), [{stops}])) AS n_stop_words, coalesce(rep.n, 0) AS n_repeat_words
  FROM a LEFT JOIN rep ON a.doc_id = rep.doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  (NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND {' AND '.join(held)}) AS kept FROM m"""


@query("op3_quality", _sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs).select("doc_id", *(F.col(c).cast("long").alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept")
