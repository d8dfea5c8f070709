"""Document queries: tables, parent/child chunks, baseline chunkers and their statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.functions import fixed as X
from rivulet.operators import bronze as B
from rivulet.operators import chunking as C
from rivulet.plans.catalog import register
from rivulet.plans.duck_views import WHOLE_NEWS, rep_d, with_views
from rivulet.session import cut_lineage
from rivulet.sources import views as V

# ---------------------------------------------------------------------------
# DuckDB twin of the parent/child chunker
# ---------------------------------------------------------------------------

TABLE_RE = X.TABLE_PATTERN
ABBR = "|".join(X.SENTENCE_ABBREVIATIONS) + r"|U\.S|Corp|vs"
PROTECT, CUT = "chr(57344)", "chr(57345)"


def strip_sql(e: str) -> str:
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


def sentences_sql(e: str) -> str:
    # RE2 has no look-behind: protect abbreviation dots, mark boundaries, split, unprotect
    s1 = f"regexp_replace({e}, '(^|[^\\p{{L}}\\p{{N}}_])({ABBR})\\.', '\\1\\2' || {PROTECT}, 'g')"
    s2 = f"regexp_replace({s1}, '([.!?])\\s+', '\\1' || {CUT}, 'g')"
    return f"list_transform(string_split({s2}, {CUT}), lambda x: replace(x, {PROTECT}, '.'))"


def greedy_sql(items: str, size: int, joiner: str) -> str:
    j = "chr(10) || chr(10)" if joiner == "\n\n" else ("chr(10)" if joiner == "\n" else f"'{joiner}'")
    r = (f"list_reduce({items}, lambda acc, x: CASE WHEN acc.n + length(x) >= {size} "
         f"THEN {{'out': list_append(acc.out, array_to_string(list_append(acc.cur, x), {j})), "
         f"'cur': []::VARCHAR[], 'n': CAST(0 AS BIGINT)}} "
         f"ELSE {{'out': acc.out, 'cur': list_append(acc.cur, x), 'n': acc.n + length(x)}} END, "
         f"{{'out': []::VARCHAR[], 'cur': []::VARCHAR[], 'n': CAST(0 AS BIGINT)}})")
    return f"(SELECT CASE WHEN len(g.cur) > 0 THEN list_append(g.out, array_to_string(g.cur, {j})) ELSE g.out END " \
           f"FROM (SELECT {r} AS g))"


def children_sql(sents: str, size: int) -> str:
    kid = "STRUCT(text VARCHAR, tail BOOLEAN)"
    joined = "array_to_string(list_append(acc.cur, x), ' ')"
    r = (f"list_reduce({sents}, lambda acc, x: CASE WHEN acc.n + length(x) >= {size} "
         f"THEN {{'out': CASE WHEN {strip_sql(joined)} <> '' "
         f"THEN list_append(acc.out, {{'text': {strip_sql(joined)}, 'tail': false}}) ELSE acc.out END, "
         f"'cur': []::VARCHAR[], 'n': CAST(0 AS BIGINT)}} "
         f"ELSE {{'out': acc.out, 'cur': list_append(acc.cur, x), 'n': acc.n + length(x)}} END, "
         f"{{'out': []::{kid}[], 'cur': []::VARCHAR[], 'n': CAST(0 AS BIGINT)}})")
    last = strip_sql("array_to_string(g.cur, ' ')")
    return (f"(SELECT CASE WHEN len(g.cur) > 0 AND {last} <> '' "
            f"THEN list_append(g.out, {{'text': {last}, 'tail': true}}) ELSE g.out END FROM (SELECT {r} AS g))")


def restore_sql(e: str) -> str:
    return (f"list_reduce(range(len(tables)), lambda acc, k: replace(acc, '__TABLE_PLACEHOLDER_' || k || '__', "
            f"tables[k + 1]), {e})")


def pc_ctes(source: str, keep: list[str], parent_size: int, child_size: int, sep: str, tag: str = "pc"):
    """CTEs ``{tag}_chunks`` = (keep..., p_idx, chunk_hierarchy, text, parent_text)."""
    k = ", ".join(keep)
    sep_sql = "chr(10) || chr(10)" if sep == "\n\n" else "chr(10)"
    processed = ("array_to_string(list_transform(regexp_split_to_array(t, '" + TABLE_RE + "'), lambda p, i: p || "
                 "CASE WHEN i - 1 < len(tables) THEN '__TABLE_PLACEHOLDER_' || (i - 1) || '__' ELSE '' END), '')")
    paras = f"list_filter(list_transform(string_split({processed}, {sep_sql}), lambda p: {strip_sql('p')}), lambda p: p <> '')"
    return [
        (f"{tag}_0", f"SELECT {k}, text AS t, regexp_extract_all(text, '{TABLE_RE}') AS tables FROM {source}"),
        (f"{tag}_1", f"SELECT {k}, tables, {greedy_sql(paras, parent_size, sep)} AS parents FROM {tag}_0"),
        (f"{tag}_2", f"""SELECT {k}, tables, unnest(parents) AS parent, generate_subscripts(parents, 1) - 1 AS p_idx
                        FROM {tag}_1"""),
        (f"{tag}_3", f"SELECT *, {children_sql(sentences_sql('parent'), child_size)} AS kids FROM {tag}_2"),
        (f"{tag}_4", f"""SELECT *, COALESCE(sum(len(kids)) OVER (PARTITION BY {k} ORDER BY p_idx
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM {tag}_3"""),
        (f"{tag}_5", f"""SELECT {k}, tables, p_idx, off, parent, unnest(kids) AS kid,
                           generate_subscripts(kids, 1) - 1 AS j FROM {tag}_4"""),
        (f"{tag}_chunks", f"""SELECT {k}, p_idx,
              CASE WHEN kid.tail THEN 'p' || p_idx || '-tail' ELSE 'p' || p_idx || '-c' || (off + j) END
                AS chunk_hierarchy, CAST(off + j AS BIGINT) AS chunk_no,
              {restore_sql('kid.text')} AS text, {restore_sql('parent')} AS parent_text
            FROM {tag}_5"""),
    ]


def parents_ctes(source: str, keep: list[str], parent_size: int, sep: str):
    ctes = pc_ctes(source, keep, parent_size, X.CHILD_SIZE, sep, "pp")[:3]
    k = ", ".join(keep)
    return ctes + [("pp_parents", f"SELECT {k}, p_idx, {restore_sql('parent')} AS parent_text FROM pp_2")]


# ---------------------------------------------------------------------------
# Queries
# ---------------------------------------------------------------------------


@register("extract_tables", with_views(["corpus"], f"""
    SELECT doc_id, CAST(generate_subscripts(tb, 1) - 1 AS BIGINT) AS table_idx, unnest(tb) AS "table"
    FROM (SELECT doc_id, regexp_extract_all(text, '{TABLE_RE}') AS tb FROM corpus)"""))
def q_extract_tables(spark, sf_dir):
    """Markdown tables isolated from every document (kept whole)."""
    return C.document_tables(V.corpus(spark, sf_dir))


@register("parent_chunks", with_views(["corpus"], "SELECT doc_id, CAST(p_idx AS BIGINT) AS p_idx, parent_text FROM pp_parents",
                                      extra=parents_ctes("corpus", ["doc_id"], X.PARENT_SIZE, "\n")))
def q_parent_chunks(spark, sf_dir):
    """Parent blocks: line paragraphs packed until 1200 characters, tables kept whole."""
    return C.parent_chunks(V.corpus(spark, sf_dir), sep="\n")


_ARTICLES = ("articles", """SELECT link AS source, ingest_timestamp AS timestamp,
        'Title: ' || COALESCE(title, '') || chr(10) || 'Summary: ' || COALESCE(summary, '') AS text
      FROM ne WHERE error_message IS NULL""")


def _news_ctes():
    from rivulet.plans.q_bronze import _NEWS
    return _NEWS


@register("chunk_documents", with_views([], """
    SELECT source, timestamp, CAST(p_idx AS BIGINT) AS p_idx, chunk_hierarchy, text, parent_text FROM pc_chunks""",
                                        extra=[("raw_news", WHOLE_NEWS)] + _news_ctes() + [_ARTICLES] +
                                        pc_ctes("articles", ["source", "timestamp"], X.PARENT_SIZE, X.CHILD_SIZE,
                                                X.PARAGRAPH_SEP)))
def q_chunk_documents(spark, sf_dir):
    """News path: valid articles -> 'Title/Summary' text -> parent (1200) / child (250) chunks."""
    return C.chunk_articles(B.news_valid(B.parse_news(V.raw_news(spark, sf_dir, faults=False)))).drop("chunk_no")


@register("chunk_lines", with_views(["corpus"], """
    SELECT doc_id, CAST(p_idx AS BIGINT) AS p_idx, chunk_hierarchy, text, parent_text FROM pc_chunks""",
                                    extra=pc_ctes("corpus", ["doc_id"], X.PARENT_SIZE, X.CHILD_SIZE, "\n")))
def q_chunk_lines(spark, sf_dir):
    """Parent/child chunks of all documents with single newlines as paragraph breaks."""
    return C.parent_child_chunks(V.corpus(spark, sf_dir), sep="\n").drop("chunk_no")


_FIXED = ("fx", """SELECT doc_id, CAST(i AS BIGINT) AS c_idx, substring(text, i * 500 + 1, 500) AS text
    FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 500.0) AS BIGINT))) AS i FROM corpus)""")


@register("chunk_fixed", with_views(["corpus"], "SELECT doc_id, c_idx, text FROM fx", extra=[_FIXED]))
def q_chunk_fixed(spark, sf_dir):
    """Fixed 500-character slices."""
    return C.fixed_chunks(V.corpus(spark, sf_dir), 500)


def _recursive_sql(size=1000, overlap=150) -> str:
    paras = "string_split(text, chr(10) || chr(10))"
    j = "chr(10) || chr(10)"
    r = (f"list_reduce({paras}, lambda acc, p: CASE WHEN acc.n + length(p) >= {size} "
         f"THEN {{'out': list_append(acc.out, array_to_string(list_append(acc.cur, p), {j})), "
         f"'cur': CASE WHEN length(p) > {overlap} THEN [substring(p, -{overlap}, {overlap})] ELSE []::VARCHAR[] END, "
         f"'n': CASE WHEN length(p) > {overlap} THEN CAST({overlap} AS BIGINT) ELSE CAST(0 AS BIGINT) END}} "
         f"ELSE {{'out': acc.out, 'cur': list_append(acc.cur, p), 'n': acc.n + length(p)}} END, "
         f"{{'out': []::VARCHAR[], 'cur': []::VARCHAR[], 'n': CAST(0 AS BIGINT)}})")
    return (f"SELECT doc_id, unnest(ch) AS text, CAST(generate_subscripts(ch, 1) - 1 AS BIGINT) AS c_idx FROM ("
            f"SELECT doc_id, CASE WHEN len(g.cur) > 0 THEN list_append(g.out, array_to_string(g.cur, {j})) "
            f"ELSE g.out END AS ch FROM (SELECT doc_id, {r} AS g FROM corpus))")


@register("chunk_recursive", with_views(["corpus"], "SELECT doc_id, c_idx, text FROM rc", extra=[("rc", _recursive_sql())]))
def q_chunk_recursive(spark, sf_dir):
    """Paragraph packing to 1000 characters with a 150-character overlap tail."""
    return C.recursive_chunks(V.corpus(spark, sf_dir), 1000, 150)


def strategy_chunks(spark, sf_dir):
    # three chunkers and the tables read the documents and reports: put together once
    corpus = cut_lineage(V.corpus(spark, sf_dir).select("doc_id", "text"))
    fixed = C.fixed_chunks(corpus, 500).select("doc_id", "text", F.lit("fixed_500").alias("strategy"))
    rec = C.recursive_chunks(corpus, 1000, 150).select("doc_id", "text", F.lit("recursive_1000_150").alias("strategy"))
    pc = C.parent_child_chunks(corpus).select("doc_id", "text", F.lit("parent_child_1200_250").alias("strategy"))
    return corpus, fixed.unionByName(rec).unionByName(pc)


@register("chunk_strategy_stats", with_views(["corpus"], """
    SELECT s.strategy, s.n_chunks, s.avg_chunk_len, t.n_tables, COALESCE(i.intact, 0) AS tables_intact,
           round(100.0 * COALESCE(i.intact, 0) / t.n_tables, 6) + 0.0 AS table_integrity_pct
    FROM (SELECT strategy, count(*) AS n_chunks, round(avg(length(text)), 6) + 0.0 AS avg_chunk_len
          FROM allc GROUP BY strategy) s
    CROSS JOIN (SELECT count(*) AS n_tables FROM tb) t
    LEFT JOIN (SELECT strategy, count(DISTINCT (tb.doc_id, tb.table_idx)) AS intact FROM tb JOIN allc
               ON tb.doc_id = allc.doc_id AND contains(allc.text, tb."table") GROUP BY strategy) i
      ON s.strategy = i.strategy""",
                                             extra=[_FIXED, ("rc", _recursive_sql())] +
                                             pc_ctes("corpus", ["doc_id"], X.PARENT_SIZE, X.CHILD_SIZE, "\n\n") + [
        ("allc", """SELECT doc_id, text, 'fixed_500' AS strategy FROM fx
                    UNION ALL SELECT doc_id, text, 'recursive_1000_150' FROM rc
                    UNION ALL SELECT doc_id, text, 'parent_child_1200_250' FROM pc_chunks"""),
        ("tb", f"""SELECT doc_id, generate_subscripts(x, 1) AS table_idx, unnest(x) AS "table"
                  FROM (SELECT doc_id, regexp_extract_all(text, '{TABLE_RE}') AS x FROM corpus)""")]))
def q_chunk_strategy_stats(spark, sf_dir):
    """Per chunking strategy: chunk count, mean length and the measured share of tables kept whole."""
    corpus, chunks = strategy_chunks(spark, sf_dir)
    tables = C.document_tables(corpus)
    n_tables = tables.agg(F.count(F.lit(1)).alias("n_tables"))
    intact = (tables.join(chunks, "doc_id").filter(F.contains(F.col("text"), F.col("table")))
              .select("strategy", "doc_id", "table_idx").distinct()
              .groupBy("strategy").agg(F.count(F.lit(1)).alias("tables_intact")))
    stats = chunks.groupBy("strategy").agg(F.count(F.lit(1)).alias("n_chunks"),
                                           F.avg(F.length("text")).alias("avg_chunk_len"))
    out = stats.join(intact, "strategy", "left").join(n_tables.hint("broadcast"), how="inner", on=F.lit(True))
    tables_intact = F.coalesce(F.col("tables_intact"), F.lit(0))
    return out.select("strategy", "n_chunks", "avg_chunk_len", "n_tables", tables_intact.alias("tables_intact"),
                      (F.lit(100.0) * tables_intact / F.col("n_tables")).alias("table_integrity_pct"))


GRID = [(100, 500), (600, 2500), (250, 1200)]


def _grid_sql() -> str:
    ctes, parts = [], []
    for child, parent in GRID:
        tag = f"g{child}_{parent}"
        ctes += pc_ctes("corpus", ["doc_id"], parent, child, "\n\n", tag)
        parts.append(f"""SELECT {child} AS child_size, {parent} AS parent_size, count(*) AS n_chunks,
              {rep_d('avg(length(text))')} AS avg_child_len, max(length(text)) AS max_child_len,
              {rep_d('avg(length(parent_text))')} AS avg_parent_len,
              {rep_d('sum(length(parent_text)) / sum(length(text))')} AS context_overhead
            FROM {tag}_chunks""")
    return with_views(["corpus"], "\nUNION ALL\n".join(parts), extra=ctes)


@register("chunk_size_grid", _grid_sql())
def q_chunk_size_grid(spark, sf_dir):
    """Parent/child chunking at three size pairs: chunk counts, lengths and parent-context overhead."""
    corpus = cut_lineage(V.corpus(spark, sf_dir).select("doc_id", "text"))
    out = None
    for child, parent in GRID:
        ch = C.parent_child_chunks(corpus, parent_size=parent, child_size=child)
        s = ch.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg(F.length("text")).alias("avg_child_len"),
                   F.max(F.length("text")).alias("max_child_len"),
                   F.avg(F.length("parent_text")).alias("avg_parent_len"),
                   (F.sum(F.length("parent_text")) / F.sum(F.length("text"))).alias("context_overhead"))
        s = s.select(F.lit(child).alias("child_size"), F.lit(parent).alias("parent_size"), "*")
        out = s if out is None else out.unionByName(s)
    return out
