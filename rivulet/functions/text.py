"""Column expressions over text.  All JVM-side (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rivulet.functions import fixed


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text) -> Column:
    """Lower-case, split on whitespace runs, keep only Unicode letters and digits, drop empties.

    Removing every character that is neither a letter, a digit nor whitespace
    before the split gives the same words as cleaning each word after it, and
    keeps the work in whole-stage codegen (no per-token lambda).
    """
    kept = F.regexp_replace(F.lower(_c(text)), r"(?U)[^\p{L}\p{N}\s]", "")
    return F.array_remove(F.split(kept, r"(?U)\s+"), "")


def sentences(text) -> Column:
    """Split after ``.!?`` + whitespace, except after the fixed abbreviations."""
    return F.split(_c(text), fixed.SENTENCE_END_PATTERN)


# word boundaries with Python's meaning of a word character: Unicode letter, digit or underscore
NOT_WORD_BEFORE = r"(?<![\p{L}\p{N}_])"
NOT_WORD_AFTER = r"(?![\p{L}\p{N}_])"
TICKER_PATTERN = r"(?i)" + NOT_WORD_BEFORE + "(" + "|".join(fixed.TICKERS) + ")" + NOT_WORD_AFTER


def extract_ticker(text) -> Column:
    """First listed symbol on word boundaries, upper-cased; ``UNKNOWN`` if none."""
    hit = F.regexp_extract(_c(text), TICKER_PATTERN, 1)
    return F.when(hit == "", F.lit(fixed.UNKNOWN_TICKER)).otherwise(F.upper(hit))


def contains_any(lowered: Column, words) -> Column:
    """True when any keyword occurs as a substring of an already lower-cased text."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(lowered, F.lit(w))
    return out


def chart_mode(text) -> Column:
    lowered = F.lower(_c(text))
    expr = None
    for mode, words in fixed.CHART_MODE_KEYWORDS:
        cond = contains_any(lowered, words)
        expr = F.when(cond, F.lit(mode)) if expr is None else expr.when(cond, F.lit(mode))
    return expr.otherwise(F.lit(fixed.DEFAULT_CHART_MODE))


def connector_pattern(word_boundaries: bool = True) -> str:
    alt = "|".join(fixed.CONNECTORS)
    if word_boundaries:
        return r"(?iuU)\s*" + NOT_WORD_BEFORE + "(?:" + alt + ")" + NOT_WORD_AFTER + r"\s*"
    return r"(?iuU)\s*(?:" + alt + r")\s*"


def split_clauses(text, word_boundaries: bool = True) -> Column:
    """Split on connector words, trim, keep pieces longer than 2 chars; else the whole trimmed text."""
    parts = F.transform(F.split(_c(text), connector_pattern(word_boundaries)), strip)
    kept = F.filter(parts, lambda p: F.length(p) > 2)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(strip(_c(text))))


def strip(c: Column) -> Column:
    """Python-style ``str.strip()``: remove leading and trailing whitespace."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def guard_status(text) -> Column:
    """``MALICIOUS`` when a guard pattern matches, ``SAFE`` otherwise (empty text is safe)."""
    t = F.coalesce(_c(text), F.lit(""))
    bad = t.rlike("(?i)" + fixed.SQL_INJECTION_PATTERN) | t.rlike("(?i)" + fixed.PROMPT_INJECTION_PATTERN)
    return F.when((t != "") & bad, F.lit("MALICIOUS")).otherwise(F.lit("SAFE"))


def wants_chart(text) -> Column:
    return contains_any(F.lower(_c(text)), fixed.CHART_WORDS)
