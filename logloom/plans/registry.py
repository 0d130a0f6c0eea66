"""The registered queries: a function of the derived tables, and its oracle statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .tables import Tables, with_sql

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(tables: str = "", sql: str | None = None, same_as: str | None = None):
    """Registers a query under its function's name; ``tables`` are the derived ones ``sql`` uses.
    ``same_as`` names a query before it that must give the same rows."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = with_sql(tables, sql)
        if same_as is not None:
            ORACLES[fn.__name__] = ORACLES[same_as]
        return fn

    return add


def us(c: str, name: str | None = None) -> Column:
    """A timestamp as microseconds, which compare exactly between engines."""
    return F.unix_micros(c).alias(name or f"{c}_us")


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES[name](Tables(spark, sf_dir))
