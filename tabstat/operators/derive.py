"""Derived columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabstat.operators.columns import levels_of, recode, refuse_existing
from tabstat.plans.moments import moment_matrix
from tabstat.plans.order_stats import quantile_row
from tabstat.plans.stats import as_double, local_table


def sum_of(cols: Sequence[str]) -> Column:
    return reduce(add, [F.coalesce(as_double(c), F.lit(0.0)) for c in cols])


def mean_of(cols: Sequence[str]) -> Column:
    present = reduce(add, [F.col(c).isNotNull().cast("int") for c in cols])
    return F.try_divide(sum_of(cols), present)


def row_sum(df: DataFrame, cols: Sequence[str], new: str) -> DataFrame:
    """Null-skipping sum, 0 when all are null."""
    return df.withColumn(new, sum_of(cols))


def row_mean(df: DataFrame, cols: Sequence[str], new: str) -> DataFrame:
    """Null-skipping mean, null when all are null."""
    return df.withColumn(new, mean_of(cols))


def dummies(df: DataFrame, col: str, drop_first: bool = True, max_levels: int = 100) -> DataFrame:
    """``<col>_<level>`` 0/1 columns in level order; a null row is 0 everywhere."""
    levels = levels_of(df, col, max_levels)[1 if drop_first else 0:]
    names = {f"{col}_{v}": v for v in levels}
    refuse_existing(df, *names)
    return df.withColumns({n: F.coalesce(F.col(col) == F.lit(v), F.lit(False)).cast("int")
                           for n, v in names.items()})


def transform(df: DataFrame, col: str, kind: str, new: str | None = None) -> DataFrame:
    """``log`` (log1p), ``square``, ``sqrt`` or ``zscore`` of one column."""
    x = as_double(col)
    if kind in ("log", "sqrt") and df.where(x < 0).limit(1).count():
        raise ValueError(f"{kind} needs non-negative values in {col}")
    if kind == "zscore":
        from tabstat.operators.cleaning import zscore
        return zscore(df, [col])
    value = {"log": F.log1p(x), "square": x * x, "sqrt": F.sqrt(x)}[kind]
    return df.withColumn(new or f"{col}_{kind}", value)


def reverse_scale(df: DataFrame, col: str, top: int, new: str | None = None) -> DataFrame:
    """``top + 1 - x`` as ``<col>_inv``."""
    return df.withColumn(new or f"{col}_inv", F.lit(top + 1) - F.col(col))


def interaction(df: DataFrame, a: str, b: str) -> DataFrame:
    """Product column ``<a>_x_<b>``."""
    refuse_existing(df, f"{a}_x_{b}")
    return df.withColumn(f"{a}_x_{b}", F.col(a) * F.col(b))


def quantile_bins(df: DataFrame, col: str, q: int, new: str) -> DataFrame:
    """Equal-frequency bins: right-closed, lowest edge included, repeated edges dropped.

    Adds ``<new>`` (bin number from 0), ``<new>_lo`` and ``<new>_hi``.
    """
    refuse_existing(df, new)
    row = quantile_row(df, [col], [i / q for i in range(q + 1)]).first()
    edges = sorted({row[f"q_0_{i}"] for i in range(q + 1)} - {None})
    x = as_double(col)
    number = lo = hi = F.lit(None)
    for i in range(len(edges) - 1, 0, -1):
        inside = x <= edges[i]
        number = F.when(inside, i - 1).otherwise(number)
        lo = F.when(inside, edges[i - 1]).otherwise(lo)
        hi = F.when(inside, edges[i]).otherwise(hi)
    return df.withColumns({new: number.cast("int"), f"{new}_lo": lo.cast("double"), f"{new}_hi": hi.cast("double")})


def named_levels(df: DataFrame, col: str, mapping: Mapping, new: str | None = None,
                 drop_source: bool = False) -> DataFrame:
    """Map every distinct value to a named level in ``<col>_cat``."""
    return recode(df, col, mapping, new or f"{col}_cat", require_all=True, drop_source=drop_source)


# date part -> (column suffix, function); suffixes are fixed values
DATE_PARTS = {
    "year": ("ano", F.year),
    "month": ("mes", F.month),
    "day": ("dia", F.dayofmonth),
    "weekday": ("semana", F.weekday),
    "hour": ("hora", F.hour),
    "minute": ("minuto", F.minute),
}


def date_parts(df: DataFrame, col: str, parts: Sequence[str] = tuple(DATE_PARTS)) -> DataFrame:
    """Calendar parts; Monday is weekday 0."""
    return df.withColumns({f"{col}_{DATE_PARTS[p][0]}": DATE_PARTS[p][1](F.col(col)) for p in parts})


def composite_key(cols: Sequence[str]) -> Column:
    """Several factors as one text key; null if any is null."""
    return F.when(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]),
                  F.concat_ws("_", *[F.col(c).cast("string") for c in cols]))


def principal_axes(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Top ``k`` eigenvalues and unit axes, largest-magnitude loading made positive."""
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(values)[::-1][:k]
    axes = vectors[:, order].T
    for axis in axes:
        big = np.argmax(np.round(np.abs(axis), 9))
        if axis[big] < 0:
            axis *= -1
    return values[order], axes


def linear_score(cols: Sequence[str], center: Sequence[float], weights: Sequence[float]) -> Column:
    """sum(w * (x - center)); null when any input is null."""
    return reduce(add, [(as_double(c) - float(m)) * float(w) for c, m, w in zip(cols, center, weights)])


def components(df: DataFrame, cols: Sequence[str], k: int, base: str = "pc",
               scale: bool = True) -> tuple[DataFrame, DataFrame]:
    """Principal-component columns ``<base>_comp1..k`` and their explained ratios.

    The moment matrix takes one pass; scores are plain expressions computed in place,
    null where a row is incomplete, so no write-back join is needed.
    """
    refuse_existing(df, *[f"{base}_comp{i + 1}" for i in range(k)])
    m = moment_matrix(df, cols)
    sd = np.sqrt(np.diag(m.cross) / m.n)
    sd = np.where(sd > 0, sd, 1.0) if scale else np.ones(len(cols))
    matrix = m.cross / np.outer(sd, sd)
    values, axes = principal_axes(matrix, k)
    scored = df.withColumns({f"{base}_comp{i + 1}": linear_score(cols, m.mean, axes[i] / sd) for i in range(k)})
    ratio = local_table(df.sparkSession, [(i + 1, float(v / np.trace(matrix))) for i, v in enumerate(values)],
                        "component int, ratio double")
    return scored, ratio
