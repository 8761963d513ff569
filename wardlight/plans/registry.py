"""Named queries over the driver tables, each with its ANSI SQL twin where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from ..session import spread, tune


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


class Tables:
    """Column-pruned access to the Parquet tables of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune(spark)
        self.dir = sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.dir}/{name}.parquet"

    def __call__(self, name: str, *cols) -> DataFrame:
        df = self.spark.read.parquet(self.path(name))
        return df.select(*cols) if cols else df

    def heavy(self, name: str, *cols) -> DataFrame:
        """Like a plain scan, for work that is heavy per row."""
        return spread(self(name, *cols))


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under an operator id."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(lambda spark, sf_dir: fn(Tables(spark, sf_dir)), sql.strip() if sql else None)
        return fn

    return register
