"""Registry of named queries over the test tables, each paired with a DuckDB oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs an operator over the ledger views of
``sf_dir``; ``ORACLES[name]`` is ANSI SQL computing the same result on DuckDB, with the
ledger views supplied as a ``WITH`` prefix. Output columns are aliased identically on
both sides and doubles are rounded on both sides (summation order differs).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.testdata import VIEWS, oracle_prefix, register_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RAW_SQL: dict[str, str] = {}   # oracle bodies without the view prefix (for composition)


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, views) -> DataFrame`` under ``name`` with an optional oracle.

    ``views`` is a callable returning the named ledger view or base table of the
    current ``sf_dir`` as a DataFrame.
    """
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            register_views(spark, sf_dir)
            return dates_as_text(fn(spark, spark.table))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            RAW_SQL[name] = sql
            ORACLES[name] = with_views(sql)
        return fn
    return deco


def dates_as_text(df: DataFrame) -> DataFrame:
    """Render DATE/TIMESTAMP output columns as ISO text so both engines compare equal."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import DateType, TimestampNTZType, TimestampType
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DateType, TimestampType, TimestampNTZType)):
            cols.append(F.col(f.name).cast("string").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the ledger view definitions it refers to (as CTEs).

    A query that starts with its own ``WITH`` gets the views merged into one clause."""
    body = sql.strip()
    prefix = oracle_prefix().rstrip()
    if body[:5].upper() == "WITH ":
        return prefix + ",\n" + body[5:]
    return prefix + "\n" + body


def load_all() -> None:
    """Import every module that registers queries."""
    from . import (queries_analytics, queries_core, queries_dedup, queries_enrich, queries_extra,  # noqa: F401
                   queries_risk,
                   queries_rules, queries_scalar)


__all__ = ["QUERIES", "ORACLES", "query", "with_views", "load_all", "VIEWS"]
