"""Grouped sufficient statistics: counts, means and centred cross products.

Every closed-form test and model starts here. One aggregation with map-side
partial sums gives all statistics; a hot group costs no more than a cold one
because each task ships a single partial row per group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabstat.plans.stats import as_double, complete


def moment_aggs(cols: Sequence[str]) -> list[Column]:
    """n, m_<i>, s_<i>_<j> (sum of centred products) for i <= j."""
    c = [as_double(x) for x in cols]
    n = F.count(F.lit(1)).cast("double")
    out = [F.count(F.lit(1)).alias("n")]
    out += [F.avg(c[i]).alias(f"m_{i}") for i in range(len(c))]
    for i in range(len(c)):
        for j in range(i, len(c)):
            s = F.var_pop(c[i]) if i == j else F.covar_pop(c[i], c[j])
            out.append((s * n).alias(f"s_{i}_{j}"))
    return out


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation on rows where both are present; null when either is constant."""
    r = F.try_divide(F.covar_pop(x, y) * F.regr_count(x, y), F.sqrt(F.regr_sxx(y, x) * F.regr_sxx(x, y)))
    return F.when(r > 1, 1.0).when(r < -1, -1.0).otherwise(r)


def moments(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Moment table over complete cases of ``cols`` (and ``by``)."""
    data = complete(df, [*by, *cols])
    return data.groupBy(*by).agg(*moment_aggs(cols))


@dataclass(frozen=True)
class Moments:
    """Moment matrix of a column list, small enough for the driver (p x p)."""

    cols: tuple[str, ...]
    n: int
    mean: np.ndarray
    cross: np.ndarray  # sums of centred products

    @property
    def cov(self) -> np.ndarray:
        return self.cross / max(self.n - 1, 1)

    def minus(self, other: "Moments") -> "Moments":
        """Moments of the rows of ``self`` that are not in ``other``."""
        n = self.n - other.n
        mean = (self.n * self.mean - other.n * other.mean) / n
        d = other.mean - mean
        cross = self.cross - other.cross - np.outer(d, d) * other.n * n / self.n
        return Moments(self.cols, n, mean, cross)


def combine(parts: Sequence[Moments]) -> Moments:
    """Moments of the union of disjoint parts."""
    n = sum(m.n for m in parts)
    mean = sum(m.n * m.mean for m in parts) / n
    cross = sum(m.cross + m.n * np.outer(m.mean - mean, m.mean - mean) for m in parts)
    return Moments(parts[0].cols, n, mean, cross)


def from_row(row, cols: Sequence[str], prefix: str = "") -> Moments:
    p = len(cols)
    n = int(row[prefix + "n"])
    mean = np.array([np.nan if row[f"{prefix}m_{i}"] is None else row[f"{prefix}m_{i}"] for i in range(p)])
    cross = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            v = row[f"{prefix}s_{i}_{j}"]
            cross[i, j] = cross[j, i] = np.nan if v is None else v
    return Moments(tuple(cols), n, mean, cross)


def pair_sums(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy) of every column pair i <= j on its complete rows.

    For many columns: thousands of aggregate expressions no longer compile into one
    stage, so each partition multiplies its Arrow batches and sends one small matrix.
    Columns are centred on their means first, which keeps the sums stable.
    """
    x = [as_double(c) for c in cols]
    centre = df.agg(*[F.avg(c) for c in x]).first()
    data = df.select(*[(c - F.lit(float(m or 0.0))).alias(f"x{i}") for i, (c, m) in enumerate(zip(x, centre))])
    p = len(cols)
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, p, p))
        for pdf in batches:
            v = pdf.to_numpy(dtype=float)
            m = (~np.isnan(v)).astype(float)
            v = np.where(m > 0, v, 0.0)
            sx, sxx = v.T @ m, (v * v).T @ m
            total += np.stack([m.T @ m, sx, sx.T, sxx, sxx.T, v.T @ v])
        i, j = np.triu_indices(p)
        yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32")} | {k: total[t, i, j] for t, k in enumerate(names)})

    parts = data.mapInPandas(run, "i int, j int, " + ", ".join(f"{k} double" for k in names))
    return parts.groupBy("i", "j").agg(*[F.sum(k).alias(k) for k in names])


WIDE = 24  # columns from which the batch products take over


def moment_matrix(df: DataFrame, cols: Sequence[str]) -> Moments:
    """One pass, one row (or one small matrix) to the driver."""
    if len(set(cols)) < WIDE:
        return from_row(moments(df, cols).first(), cols)
    data = complete(df, cols)
    mean0 = data.agg(*[F.avg(as_double(c)) for c in cols]).first()
    p = len(cols)
    shift, cross, n = np.zeros(p), np.zeros((p, p)), 0
    for r in pair_sums(data, cols).collect():  # p (p + 1) / 2 lines
        n = int(r["n"])
        if r["i"] == r["j"]:
            shift[r["i"]] = r["sx"]
        cross[r["i"], r["j"]] = cross[r["j"], r["i"]] = r["sxy"]
    shift /= max(n, 1)
    return Moments(tuple(cols), n, np.array([m or 0.0 for m in mean0]) + shift, cross - n * np.outer(shift, shift))


def moment_matrices(df: DataFrame, sets: Sequence[Sequence[str]]) -> list[Moments]:
    """Moment matrices of several column lists, each on its own complete rows, in one pass."""
    aggs = []
    for k, cols in enumerate(sets):
        full = reduce(and_, [F.col(c).isNotNull() for c in cols])
        c = [F.when(full, as_double(x)) for x in cols]
        n = F.count(c[0])
        aggs.append(n.alias(f"{k}_n"))
        aggs += [F.avg(x).alias(f"{k}_m_{i}") for i, x in enumerate(c)]
        for i in range(len(c)):
            for j in range(i, len(c)):
                s = F.var_pop(c[i]) if i == j else F.covar_pop(c[i], c[j])
                aggs.append((s * n).alias(f"{k}_s_{i}_{j}"))
    row = df.agg(*aggs).first()
    return [from_row(row, cols, f"{k}_") for k, cols in enumerate(sets)]
