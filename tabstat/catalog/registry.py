"""Registered queries: name -> callable, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without ``sql`` only its rows are checked by the driver."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


class Tables:
    """The given tables of one directory, as attributes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round doubles for comparison and clear negative zero."""
    fix = {f.name: F.round(f.name, special.get(f.name, digits)) + F.lit(0.0)
           for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    return df.withColumns(fix) if fix else df


# events with missing values, the same expression on both sides
HOLES_SQL = """SELECT event_id, ts, user_id,
 CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS value,
 CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS event_type FROM events"""


def with_holes(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", "ts", "user_id",
        F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("event_type"))
