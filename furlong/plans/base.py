"""The registry of queries that the modules of plans fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["race_id", "post_no"]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def out(df: DataFrame, *cols: str, keys: list[str] = KEY, digits: int = 6, settled: tuple[str, ...] = ()) -> DataFrame:
    """Keys and columns, doubles rounded, whole numbers as long. settled: those that ``settle`` rounds."""
    kinds = dict(df.dtypes)
    made = [settle(F.col(c)).alias(c) if c in settled else F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c).cast("long").alias(c) if kinds[c] in ("int", "bigint") else F.col(c) for c in cols]
    return df.select(*keys, *made)


def settle(c: Column) -> Column:
    """c to six digits. Means of few short fractions often stand on the middle between two of them, where the order of adding
    and the way of rounding would tell; here the middle, and what is up to 1e-10 below it, goes up."""
    return F.floor(c * 1e6 + 0.5001) / 1e6


def settle_sql(c: str) -> str:
    return f"floor(({c}) * 1e6 + 0.5001) / 1e6"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add
