"""The registry of queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strongroom.operators.running import block_of, borders

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its key, with its oracle when SQL can say the same."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def moment(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


@lru_cache(maxsize=8)
def _moments(spark: SparkSession, directory: str) -> tuple[int, ...]:
    return tuple(borders(table(spark, directory, "events"), moment()))


def by_moment(spark: SparkSession, directory: str, ts: str = "ts") -> Column:
    """A block of the events that follows their time and holds about as many of them as any other."""
    return block_of(list(_moments(spark, directory)), moment(ts))
