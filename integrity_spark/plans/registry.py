"""Every registered query and the SQL that checks it. Each query reads whole tables, or views of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.ranges import CO_PARTITION
from ..sources.fixtures import with_views

Query = Callable[[SparkSession, str], DataFrame]
#: The JVM doesn't compile methods beyond 8000 bytes of bytecode. Wide assessments fuse into larger ones, which then
#: run interpreted; with this limit Spark generates them in parts instead.
JIT_LIMIT = "8000"
#: Settings of ``lean`` queries, which move many times their input: shuffle files go as soon as the table is written that they were made
#: for, and a join takes rows as they are dealt already, if that is by some of its keys. The other queries get the session's own.
LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", CO_PARTITION: "false"}
USUAL: dict[str, str] = {}
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: tuple[str, ...] = (), name: str | None = None, lean: bool = False) -> Callable[[Query], Query]:
    """Registers a query under its own name, with DuckDB text over those views if SQL can express it."""

    def add(f: Query) -> Query:
        key = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.codegen.hugeMethodLimit", JIT_LIMIT)
            for setting, value in LEAN.items():
                usual = USUAL.setdefault(setting, spark.conf.get(setting))
                spark.conf.set(setting, value if lean else usual)
            return f(spark, sf_dir)

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = with_views(sql, *views) if views else sql
        return f

    return add


from . import assess_queries, detail_queries, dig_queries, ingest_queries, map_queries, matrix_queries, reading_queries, tml_queries  # noqa: E402, F401
