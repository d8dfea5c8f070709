"""Secret scans over an incremental ledger of text blobs.

Every version of every text is addressed by the SHA-256 of its content.  The
ledger is a table of blobs with the rule versions that have scanned them and
the spans they found.  A scan looks only at pairs of blob and rule version that
the ledger lacks, appends what it finds, and joins the findings of the current
rules back to all paths with that blob.  A text that thousands of paths share
is moved once per task and scanned once ever.

Everything is DataFrame expressions: no Python code runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.catalog import query
from rivulet.llm.common import path_exists, prepare, scratch, spare, table


@dataclass(frozen=True)
class Rule:
    """One kind of secret: matches of ``pattern``, leftmost and non-overlapping, that are long enough."""

    kind: str
    pattern: str
    shortest: int  # code points of the match, or of the group ``value``
    value: int = 0  # group of the pattern (0: the match)
    guard: str | None = None  # a cheaper test that every text with a match passes
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The three base kinds in their order, then well-known token formats.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16, guard=r"[0-9a-f]{16}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 30),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 20),
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]{36,}", 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15),
)
BASE = ("assign", "access", "hex")

_SPAN = "array<struct<start:int,kind:int,end:int,rule:string>>"
_LEDGER = f"blob string, rules array<string>, spans {_SPAN}"


def _spans(text: Column, rule: Rule, kind: int) -> Column:
    """Spans of one rule in code points.

    The text is cut into consecutive pairs of gap and match (each attempt
    starts where the last match ended, so a pass is linear); the lengths of
    the cuts add up to the positions.
    """
    cuts = rf"(?s)\G(.*?)({rule.pattern})"
    whole, gap = (F.regexp_extract_all(text, F.lit(cuts), F.lit(i)) for i in (0, 1))
    value = F.regexp_extract_all(text, F.lit(cuts), F.lit(2 + rule.value))
    zipped = F.arrays_zip(F.transform(whole, lambda x: F.length(x)).alias("w"), F.transform(gap, lambda x: F.length(x)).alias("g"),
                          F.transform(value, lambda x: F.length(x)).alias("v"))
    done = F.aggregate(
        zipped, F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["w"]).alias("at"),
            F.when(x["v"] >= rule.shortest, F.concat(a["out"], F.array(F.struct(
                (a["at"] + x["g"]).alias("start"), F.lit(kind).alias("kind"), (a["at"] + x["w"]).alias("end"),
                F.lit(rule.key).alias("rule"))))).otherwise(a["out"]).alias("out")),
        lambda a: a["out"])
    return F.when(text.rlike(rule.guard or rule.pattern), done).otherwise(F.array().cast(_SPAN))


def scan_ledger(versions: DataFrame, ledger: str, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what ``ledger`` (a folder, created if missing) lacks; return ``versions`` with ``blob`` and ``spans``.

    ``spans`` holds (start, kind, end, rule) by start, then by order of the
    rules; positions count code points, ends are exclusive.  Null and empty
    texts are the empty blob and have no spans; repeated rows and rows that
    share a text get the same spans; an empty table returns none.  Input
    columns named ``blob`` or ``spans`` are replaced.  Bump a rule's
    ``version`` when its pattern changes: its pairs are then new, and findings
    of older versions are no longer returned.
    """
    spark = prepare(versions.sparkSession)
    versions = versions.select([c for c in versions.columns if c.lower() not in ("blob", "spans")])
    content = F.coalesce(F.col(text_col), F.lit(""))
    keyed = versions.withColumn("blob", F.sha2(content, 256))
    blobs = keyed.select("blob", content.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    current = [r.key for r in rules]
    wanted = F.array(*map(F.lit, current))
    if path_exists(spark, ledger):
        seen = spark.read.schema(_LEDGER).parquet(ledger).groupBy("blob").agg(
            F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen"))
        todo = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(
            wanted, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("todo") > 0)
    else:
        todo = blobs.withColumn("todo", wanted)
    found = F.concat(*(F.when(F.array_contains("todo", r.key), _spans(F.col("text"), r, i)).otherwise(F.array().cast(_SPAN))
                       for i, r in enumerate(rules)))
    todo.select("blob", F.col("todo").alias("rules"), found.alias("spans")).write.mode("append").parquet(ledger)
    findings = spark.read.schema(_LEDGER).parquet(ledger).where(F.size("spans") > 0).select(
        "blob", F.filter("spans", lambda s: s["rule"].isin(current)).alias("spans")).groupBy("blob").agg(
        F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))
    return keyed.join(findings, "blob", "left").select(
        *versions.columns, "blob", F.coalesce("spans", F.array().cast(_SPAN)).alias("spans"))


def span_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text_col: str = "text", spans_col: str = "spans", mask: str = "[SECRET]") -> DataFrame:
    """``text_col`` with every run of overlapping spans replaced by ``mask``; other texts stay as they are."""
    text = F.col(text_col)
    cut = F.aggregate(
        F.col(spans_col), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mask)))
            .otherwise(a["out"]).alias("out")),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return df.withColumn(text_col, F.when(F.size(spans_col) > 0, cut).otherwise(text))


def _number(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@query("op2_secrets")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document, through a new ledger."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scan_ledger(docs, scratch(spark, "blob-ledger"))
    (base,) = spare(out, "base")
    out = out.withColumn(base, F.filter("spans", lambda s: s["kind"] < len(BASE)))
    return out.select(
        "doc_id", *(_number(F.col(base), i).alias(f"n_{k}") for i, k in enumerate(BASE)),
        F.sha2(span_text(F.col(base)), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
