"""One-row statistics that later expressions can refer to."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scalar_stats(df: DataFrame, aggs: Iterable[Column]) -> Column:
    """All ``aggs`` over ``df`` as one struct column, usable in any expression.

    The aggregate becomes a scalar subquery: it runs once, yields exactly one
    row by construction, and needs neither a join nor a collect.
    """
    return df.agg(F.struct(*aggs).alias("stats")).scalar()


def one_row(df: DataFrame) -> Column:
    """The single row of ``df`` (a global aggregate) as a struct column."""
    return df.select(F.struct("*").alias("stats")).scalar()


def local_table(spark, rows: Sequence[tuple | Row], schema: str | T.StructType) -> DataFrame:
    """A result table whose size depends on columns or levels, never on rows.

    Built from an Arrow table, it stays a local relation without a Python stage.
    """
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    data = pa.table({f.name: pa.array([r[i] for r in rows]) for i, f in enumerate(fields)})
    df = spark.createDataFrame(data)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def bounded_rows(df: DataFrame, limit: int, what: str) -> list[Row]:
    """Collect at most ``limit`` rows; raise instead of truncating."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows; raise the limit explicitly if intended")
    return rows


BROADCAST_ROWS = 100_000


def settle(table: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame | None:
    """A small result as a broadcast local table, or None when it has more than ``limit`` rows.

    The size is checked before anything is broadcast; the caller has another way beyond it.
    """
    rows = table.limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    return F.broadcast(local_table(table.sparkSession, rows, table.schema))


def as_double(name: str) -> Column:
    return F.col(name).cast("double")


def complete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Complete cases over exactly the columns a model uses."""
    return df.select(*dict.fromkeys(cols)).na.drop()


def unpivot_doubles(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (),
                    variable: str = "variable", value: str = "value") -> DataFrame:
    """Long form (keep..., variable, value) without nulls, all columns in one pass."""
    cells = F.array(*[F.struct(F.lit(c).alias(variable), as_double(c).alias(value)) for c in cols])
    return df.select(*keep, F.inline(cells)).where(F.col(value).isNotNull())


#: Rows that one task of an iterative fit reads at most, whatever the number of cores.
TASK_ROWS = 500_000


def spread_out(df: DataFrame) -> DataFrame:
    """Give every core a fair share of rows that an iterative fit will read many times, and no task more than ``TASK_ROWS``.

    Only where the source has fewer files than that takes: some 20,000 rows per task, so that
    a short table is not cut into many tasks either. A table of many files is left as it is.
    """
    cores, files = df.sparkSession.sparkContext.defaultParallelism, len(df.inputFiles())
    rows = df.count()
    least = -(-rows // TASK_ROWS)
    if files >= max(cores, least):
        return df
    parts = max(min(cores, -(-rows // 20_000) or 1), least)
    return df.coalesce(1) if parts == 1 else df.repartition(parts)
