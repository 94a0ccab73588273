"""Comparison predicates with the workbench's missing-value rule."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OPS = {"==": operator.eq, "!=": operator.ne, ">": operator.gt,
        "<": operator.lt, ">=": operator.ge, "<=": operator.le}


def compare(col: Column, op: str, value) -> Column:
    """``col op value``; a missing value satisfies only ``!=``; unknown op means ``==``."""
    test = _OPS.get(op, operator.eq)(col, value)
    return F.coalesce(test, F.lit(op == "!="))


def literal_for(df: DataFrame, col: str, text):
    """Coerce a text literal to the type of ``col``: number, boolean or text."""
    kind = df.schema[col].dataType
    if isinstance(kind, T.NumericType):
        try:
            number = float(text)
        except (TypeError, ValueError):
            return text
        return int(number) if number.is_integer() else number
    if isinstance(kind, T.BooleanType):
        return str(text).lower() == "true"
    return str(text)


def all_of(df: DataFrame, conditions: Sequence[tuple]) -> Column:
    """AND of any number of (column, op, literal) conditions."""
    tests = [compare(F.col(c), op, literal_for(df, c, v)) for c, op, v in conditions]
    return reduce(operator.and_, tests)
