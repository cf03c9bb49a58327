"""Collects the registered queries; each has a Spark plan and, where SQL can say it, an oracle."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspan.plans.oracle import sql as _sql
from barspan.sources.adapter import MarketTables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODULES = ("ingest", "technical", "sequence", "market", "serving", "quality", "learning", "backtests", "accounts", "streams", "values")


def query(name: str, sql: str | None = None, **extra: str):
    """Register ``fn(tables)`` under ``name``; ``sql`` may use the shared CTEs."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, root: fn(MarketTables(spark, root))
        if sql is not None:
            ORACLES[name] = _sql(sql, **extra)
        return fn

    return add


def rounded(df: DataFrame, dp: int = 6, **special: int) -> DataFrame:
    """Round every DOUBLE (engines add in different orders); no negative zero."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "double":
            out.append((F.round(f.name, special.get(f.name, dp)) + F.lit(0.0)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def load_all():
    for m in MODULES:
        importlib.import_module(f"barspan.plans.{m}")
    return QUERIES, ORACLES
