"""All queries of the package and their SQL, by name.

A query is a function of ``Tables``; ``@query(sql=...)`` registers it with the SQL that gives the
same rows on the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.relational import spread

TEXTS = ("documents", "pages")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one folder as attributes; each is read when it is asked for.

    Tables of texts that are too small to fill the slots by themselves are dealt to all of them:
    a small file of one row group would be one task's work.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(table) if name in TEXTS else table


def query(sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        name = fn.__name__
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return fn

    return register


from . import audit, changes, documents, facets, graph, hydrate, insight, knowledge, knowledge_rows, lexicon, olap, planning, ranking, retrieval, services, shelves, streams, texts, walks  # noqa: E402, F401
