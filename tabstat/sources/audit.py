"""Operation log as an append-only table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ts timestamp, stage string, op string, params map<string,string>"


def empty_log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def log_step(log: DataFrame, stage: str, op: str, params: Mapping[str, object] | None = None) -> DataFrame:
    """The log with one more timestamped record."""
    entry = log.sparkSession.createDataFrame(
        [(stage, op, {k: str(v) for k, v in (params or {}).items()})],
        "stage string, op string, params map<string,string>")
    return log.unionByName(entry.select(F.current_timestamp().alias("ts"), "stage", "op", "params"))


def append_step(spark: SparkSession, path: str, stage: str, op: str,
                params: Mapping[str, object] | None = None) -> None:
    """Append one record to a stored log without rewriting it."""
    log_step(empty_log(spark), stage, op, params).coalesce(1).write.mode("append").parquet(path)


def read_log(log: DataFrame, newest_first: bool = False, without: str | None = None) -> DataFrame:
    """Steps in order, optionally dropping those whose text contains ``without``."""
    out = log if without is None else log.where(~F.col("op").contains(without))
    return out.orderBy(F.col("ts").desc() if newest_first else F.col("ts").asc())
