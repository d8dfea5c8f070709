"""DuckDB twins of ``rivulet.sources.views`` for the oracle SQL.

Each entry is the body of a CTE; ``with_views(names, body)`` prefixes a query
with the CTEs it needs (dependencies first).  Conventions match
``rivulet.plans.report``: timestamps formatted with microseconds, doubles
rounded to 6 decimals, integers as BIGINT.
"""

from __future__ import annotations

from rivulet.functions.fixed import TICKERS
from rivulet.sources.views import DESK_MESSAGES


def json_str(expr: str) -> str:
    e = expr
    e = f"replace({e}, '\\', '\\\\')"
    e = f"replace({e}, '\"', '\\\"')"
    e = f"replace({e}, chr(10), '\\n')"
    e = f"replace({e}, chr(13), '\\r')"
    e = f"replace({e}, chr(9), '\\t')"
    return f"('\"' || {e} || '\"')"


TS = "'%Y-%m-%d %H:%M:%S.%f'"


def rep_ts(expr: str) -> str:
    return f"strftime({expr}, {TS})"


def rep_d(expr: str, digits: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def _ticks(sym: str) -> str:
    return f"""
    SELECT {sym} AS symbol, CAST(ts AS TIMESTAMP) AS timestamp,
           CASE WHEN isnan(value) THEN NULL ELSE value END AS price,
           TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume,
           event_id AS seq
    FROM events"""


def _envelope(ts_part: str, price_part: str | None) -> str:
    fields = f"'\"symbol\": ' || {json_str('symbol')}"
    if price_part is not None:
        fields += f" || ', \"price\": ' || {price_part}"
    fields += " || ', \"volume\": ' || CAST(volume AS VARCHAR)"
    return (f"('{{' || {ts_part} || '\"data_source\": \"events\", \"asset_class\": \"STOCK\", \"payload\": {{' || "
            f"{fields} || '}}}}')")


def _with_ts(s: str) -> str:
    return f"('\"ingest_timestamp\": ' || {json_str(s)} || ', ')"


_P = "CAST(price AS VARCHAR)"
_TSM = "strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f')"
_TSS = "strftime(timestamp, '%Y-%m-%d %H:%M:%S')"

RAW_MARKET = f"""
    SELECT 'bronze_market' AS topic, CAST(seq % 4 AS INTEGER) AS partition, seq AS "offset",
      CASE
        WHEN seq % 17 = 0 THEN 'not-json-' || CAST(seq AS VARCHAR)
        WHEN seq % 19 = 0 THEN {_envelope(_with_ts(_TSM), None)}
        WHEN seq % 31 = 0 THEN {_envelope("''", _P)}
        WHEN seq % 37 = 0 THEN {_envelope(_with_ts(_TSM), "'\"abc\"'")}
        WHEN seq % 41 = 0 THEN {_envelope(_with_ts(_TSM), json_str(_P))}
        WHEN seq % 23 = 0 THEN {_envelope(_with_ts("'yesterday'"), _P)}
        WHEN seq % 29 = 0 THEN {_envelope(_with_ts(_TSS), _P)}
        ELSE {_envelope(_with_ts(_TSM), _P)}
      END AS value
    FROM ticks"""

_NEWS_TS = "strftime(TIMESTAMP '2024-02-01 00:00:00' + to_minutes(doc_id), '%Y-%m-%d %H:%M:%S.%f')"
_NEWS_HEAD = (f"'{{\"ingest_timestamp\": ' || (CASE WHEN doc_id % 7 = 0 THEN 'null' ELSE {json_str(_NEWS_TS)} END)"
              f" || ', \"data_source\": \"documents\", \"payload\": {{\"title\": ' || {json_str('split_part(text, chr(10), 1)')}"
              f" || ', \"summary\": ' || {json_str('text')}")
_NEWS_FULL = f"({_NEWS_HEAD} || ', \"link\": ' || {json_str(chr(39) + 'doc://' + chr(39) + ' || CAST(doc_id AS VARCHAR)')} || '}}}}')"

RAW_NEWS = f"""
    SELECT 'bronze_news' AS topic, CAST(0 AS INTEGER) AS partition, doc_id AS "offset",
      CASE WHEN doc_id % 11 = 0 THEN substring({_NEWS_FULL}, 1, 40)
           WHEN doc_id % 13 = 0 THEN ({_NEWS_HEAD} || '}}}}')
           ELSE {_NEWS_FULL} END AS value
    FROM documents"""

WHOLE_NEWS = f"""
    SELECT 'bronze_news' AS topic, CAST(0 AS INTEGER) AS partition, doc_id AS "offset", {_NEWS_FULL} AS value FROM documents"""

RAW_TRADES = f"""
    SELECT seq, timestamp,
      CASE WHEN seq % 2 = 0 THEN '{{"stream": "trades", "data": ' || inner_json || '}}' ELSE inner_json END AS value
    FROM (SELECT seq, timestamp,
            '{{"s": ' || {json_str('symbol')} || ', "p": ' || {json_str(_P)} || ', "q": ' ||
            {json_str('CAST(volume AS VARCHAR)')} || '}}' AS inner_json
          FROM ticks)"""

FEED_ENTRIES = r"""
    SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS feed, page_id AS pos,
      CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'urn:' || lower(regexp_extract(html, '<title>(.*?)</title>', 1)) END AS id,
      url AS link,
      regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
      CASE WHEN page_id % 4 = 0 THEN NULL ELSE regexp_extract(html, '<p>([^<]*)</p>', 1) END AS summary,
      regexp_extract(html, '<div class="ad">([^<]*)</div>', 1) AS description,
      CASE WHEN page_id % 5 = 0 THEN NULL ELSE '2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') END AS published
    FROM pages"""

VECTORS = """
    SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings"""


def tokens_sql(expr: str) -> str:
    """DuckDB twin of ``rivulet.functions.text.tokens``."""
    return (f"list_filter(list_transform(regexp_split_to_array(lower({expr}), '\\s+'), "
            f"lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda w: w <> '')")


_FIRST = r"regexp_extract(text, '^([\s\S]*?[.!?])(\s|$)', 1)"
QUERIES_VIEW = f"""
    SELECT item_id AS query_id, text AS query,
           CASE WHEN {_FIRST} = '' THEN text ELSE {_FIRST} END AS expected_subject,
           list_sort(list_distinct({tokens_sql(f"CASE WHEN {_FIRST} = '' THEN text ELSE {_FIRST} END")})) AS expected_facts
    FROM benchmark"""

MESSAGES = "SELECT conv_id, turn, role, text FROM conversations"

_LISTED = "[" + ", ".join(f"'{t}'" for t in TICKERS) + "]"
_WORDINGS = "[" + ", ".join(f"'{m}'" for m in DESK_MESSAGES) + "]"
DESK = f"""
    SELECT conv_id, turn, role, CASE WHEN role = 'user' AND (conv_id * 3 + turn) % 7 <> 0
             THEN replace({_WORDINGS}[(conv_id * 3 + turn) % {len(DESK_MESSAGES)} + 1], '{{s}}', {_LISTED}[(conv_id + turn) % {len(TICKERS)} + 1])
             ELSE text END AS text FROM conversations"""

REQUESTS = """
    SELECT ticker, CAST((length(ticker) * 7 + ascii(ticker)) % 35 AS INTEGER) AS "limit",
           CASE WHEN length(ticker) % 2 = 0 THEN 'get_indicators' ELSE 'get_prices' END AS action
    FROM (SELECT DISTINCT ticker FROM (
            SELECT left(symbol, n) AS ticker FROM (SELECT DISTINCT symbol FROM ticks_by_user),
                   (VALUES (1), (2), (3), (4)) AS t(n)
            UNION ALL SELECT '' UNION ALL SELECT 'UNKNOWN'))"""

ORDER_REPORTS = """
    SELECT o_orderkey + 1000000000 AS doc_id,
           'Order report ' || CAST(o_orderkey AS VARCHAR) || '. Status ' || o_orderstatus || ', priority ' ||
           o_orderpriority || '.' || chr(10) || chr(10) || '| line | part | quantity | price |' || chr(10) ||
           '|---|---|---|---|' || chr(10) || rows || chr(10) || chr(10) || 'Total price ' ||
           CAST(o_totalprice AS VARCHAR) || '. Placed on ' || strftime(o_orderdate, '%Y-%m-%d') || '.' AS text,
           'en' AS lang, 'orders' AS source
    FROM orders JOIN (
      SELECT l_orderkey, string_agg('| ' || CAST(l_linenumber AS VARCHAR) || ' | ' || CAST(l_partkey AS VARCHAR) ||
                                    ' | ' || CAST(l_quantity AS VARCHAR) || ' | ' || CAST(l_extendedprice AS VARCHAR) ||
                                    ' |', chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rows
      FROM lineitem GROUP BY l_orderkey) li ON o_orderkey = li.l_orderkey"""

CORPUS = """
    SELECT doc_id, text, lang, source FROM documents
    UNION ALL SELECT doc_id, text, lang, source FROM order_reports"""

VIEWS = {
    "order_reports": ([], ORDER_REPORTS),
    "corpus": (["order_reports"], CORPUS),
    "ticks": ([], _ticks("event_type")),
    "ticks_by_user": ([], _ticks("CAST(user_id AS VARCHAR)")),
    "raw_market": (["ticks"], RAW_MARKET),
    "raw_news": ([], RAW_NEWS),
    "raw_trades": (["ticks"], RAW_TRADES),
    "feed_entries": ([], FEED_ENTRIES),
    "vectors": ([], VECTORS),
    "queries": ([], QUERIES_VIEW),
    "messages": ([], MESSAGES),
    "desk_messages": ([], DESK),
    "desk_ticks": ([], _ticks(f"{_LISTED}[user_id % {len(TICKERS)} + 1]")),
    "requests": (["ticks_by_user"], REQUESTS),
}


def with_views(names, body: str, extra: list | None = None) -> str:
    """``WITH`` clause holding the named views (and their dependencies), then ``extra`` CTEs, then body."""
    order: list[str] = []

    def add(n):
        if n in order:
            return
        for dep in VIEWS[n][0]:
            add(dep)
        order.append(n)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({VIEWS[n][1]}\n)" for n in order]
    for name, sql in (extra or []):
        ctes.append(f"{name} AS ({sql}\n)")
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body
