"""Query catalog: every implemented operator as ``(spark, sf_dir) -> DataFrame``.

Each entry reads the supplied tables (through ``rivulet.sources.views``), runs
the operator over the whole input and returns the report form
(``rivulet.plans.report``).  Where the semantics are expressible in SQL, the
entry also carries a DuckDB oracle over the same parquet tables; both sides
use the same column names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from rivulet.plans.report import report


@dataclass
class Entry:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return report(fn(spark, sf_dir))

        run.__name__ = f"q_{name}"
        run.__doc__ = fn.__doc__
        REGISTRY[name] = Entry(name, run, sql, (fn.__doc__ or "").strip())
        return fn

    return deco


def load_all() -> dict[str, Entry]:
    # Importing the modules fills REGISTRY.
    from rivulet.plans import q_bronze, q_context, q_documents, q_market, q_retrieval  # noqa: F401
    return REGISTRY
