"""Registered queries: a name, a function ``(spark, sf_dir) -> DataFrame``, and its SQL if it has one."""

from __future__ import annotations

from casemill.sources.files import spread

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        fn.__name__ = name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark, sf_dir: str, *columns: str):
    """Columns of the documents for steps that work hard on every text."""
    return spread(table(spark, sf_dir, "documents").select(*columns))


def pages(spark, sf_dir: str, *columns: str):
    """Columns of the web pages, likewise."""
    return spread(table(spark, sf_dir, "pages").select(*columns))
