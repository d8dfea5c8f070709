import duckdb

from rivulet.sources.tables import TABLES, table_path


def test_entry_runs(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.count() > 0 and "MACD_Signal" in df.columns


def test_contract_keys():
    from __spark_entry__ import oracle_sql, queries
    q, s = queries(), oracle_sql()
    assert set(s) <= set(q) and len(q) >= 50


def test_some_queries_match_oracle_at_small_scale(spark, sf):
    import os
    import sys
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(__file__)), "tools"))
    from check_oracle import norm
    from __spark_entry__ import oracle_sql, queries
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf, t)}')")
    for name in ("indicators", "gold_latest", "market_dlq", "chunk_documents", "sparse_topk", "trim_history"):
        a = norm(queries()[name](spark, sf).toPandas())
        b = norm(con.execute(oracle_sql()[name]).fetchdf())
        assert a == b, name
