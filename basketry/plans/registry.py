"""Every query of the library by name, and the SQL that its result is held against. Names start with the ids of the operator inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "l7_ranked_plans"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers f(catalogue) under its own name, with the SQL of its result if there is one."""
    from .views import Catalogue

    def add(f: Callable[[Catalogue], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Catalogue(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


from . import queries_catalogue, queries_functions, queries_guards, queries_lines, queries_pricing, queries_relational, queries_search, queries_sources, queries_streams, queries_vocabulary  # noqa: E402, F401
