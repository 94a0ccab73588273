"""Writing tables and named bundles of result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from tabstat.operators.describe import describe, frequencies


def write_table(df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite") -> str:
    """Distributed write; CSV gets a header."""
    writer = df.write.mode(mode)
    if format == "csv":
        writer = writer.option("header", True)
    writer.format(format).save(path)
    return path


def write_tables(tables: Mapping[str, DataFrame], path: str, format: str = "parquet") -> dict[str, str]:
    """One sub-directory per named table: model tables, comparison tables, scores."""
    return {name: write_table(df, f"{path.rstrip('/')}/{name}", format) for name, df in tables.items()}


def exploratory_tables(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> dict[str, DataFrame]:
    """The numeric summary and one frequency table per categorical column."""
    tables = {"numeric_summary": describe(df, numeric)} if numeric else {}
    return tables | {f"frequencies_{c}": frequencies(df, c) for c in categorical}


def export_exploratory(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                       path: str, format: str = "csv") -> dict[str, str]:
    return write_tables(exploratory_tables(df, numeric, categorical), path, format)
