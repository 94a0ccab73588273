"""Row-wise operators on a stream.

Operators that need no statistic of the table are stateless, so a streaming DataFrame
goes through them unchanged. Statistics come from a table at rest, frozen as numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tabstat.operators import cleaning, columns, derive

ROWWISE = {
    "select": columns.select_columns,
    "drop": columns.drop_columns,
    "flag": columns.flag,
    "keep_if": columns.keep_if,
    "drop_missing": columns.drop_missing,
    "boolean": columns.cast_boolean,
    "duplicate": columns.duplicate_column,
    "recode": columns.recode,
    "winsorize": cleaning.winsorize,
    "log": cleaning.log1p_clip,
    "row_sum": derive.row_sum,
    "row_mean": derive.row_mean,
    "reverse": derive.reverse_scale,
    "interaction": derive.interaction,
    "date_parts": derive.date_parts,
}


def apply_rowwise(df: DataFrame, steps: Sequence[tuple]) -> DataFrame:
    """Apply (step, argument, ...) tuples in order; works on batch and streaming input."""
    for name, *args in steps:
        df = ROWWISE[name](df, *args)
    return df


def frozen_fences(df: DataFrame, cols: Sequence[str], factor: float = 1.5) -> dict[str, tuple[float, float]]:
    """Quartile fences of a table at rest as plain numbers, for ``winsorize`` on a stream."""
    return {r["variable"]: (r["lower"], r["upper"]) for r in cleaning.iqr_bounds(df, cols, factor).collect()}
