"""A collection of named queries over the tables of a folder, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def r6(c: str | Column) -> Column:
    """Six digits as SQL rounds a double: the double times 10^6 to a whole number. F.round takes the shortest decimal instead, so 0.0634375 ends higher."""
    return F.round((F.col(c) if isinstance(c, str) else c) * 1e6) / 1e6


class Tables:
    """The tables of one folder, read on demand: t.documents is <folder>/documents.parquet."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable:
        """Register a function of Tables under its own name."""

        def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            self.queries[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return add
