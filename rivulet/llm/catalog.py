"""Queries of this subpackage, by name, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

MODULES = ["packing", "secrets", "quality", "language", "toxicity", "mixing", "shards", "attribution", "ngram_join", "decontamination",
           "simhash", "vectorcodes", "repair"]


def query(name: str, sql: str | None = None):
    """Register a query function ``(spark, sf_dir) -> DataFrame``."""
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return deco


def load() -> tuple[dict, dict]:
    """Import every operator module, which registers its query, and the pipeline."""
    for m in MODULES:
        importlib.import_module(f"rivulet.llm.{m}")
    return QUERIES, SQL
