"""Correlations: by pair, by group, partial, and compared between groups."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstat.functions.labels import significance_label
from tabstat.functions.tails import normal_two_sided, t_two_sided
from tabstat.plans.moments import WIDE, correlation, moment_matrix, pair_sums
from tabstat.plans.order_stats import attach_by_value, average_rank, running_counts, sketch_ranges
from tabstat.plans.stats import as_double, local_table


def _pearson_wide(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    s = {k: F.col(k) for k in ("n", "sx", "sy", "sxx", "syy", "sxy")}
    vx, vy = s["sxx"] - s["sx"] * s["sx"] / s["n"], s["syy"] - s["sy"] * s["sy"] / s["n"]
    r = F.try_divide(s["sxy"] - s["sx"] * s["sy"] / s["n"], F.sqrt(vx * vy))
    r = F.when((vx > 0) & (vy > 0), F.when(r > 1, 1.0).when(r < -1, -1.0).otherwise(r))
    names = F.array(*[F.lit(c) for c in cols])
    return pair_sums(df, cols).where("i < j AND n > 0").select(
        F.get(names, "i").alias("var1"), F.get(names, "j").alias("var2"), F.col("n").cast("bigint").alias("n"), r.alias("r"))


def _pearson(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    if len(cols) >= WIDE and not by:
        return _pearson_wide(df, cols)
    aggs, cells = [], []
    for i, (a, b) in enumerate(combinations(cols, 2)):
        x, y = as_double(a), as_double(b)
        aggs.append(F.struct(F.regr_count(x, y).alias("n"), correlation(x, y).alias("r")).alias(f"p_{i}"))
        cells.append(F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"),
                              F.col(f"p_{i}.n").alias("n"), F.col(f"p_{i}.r").alias("r")))
    return df.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*cells)))


def _centred_ranks(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, <value>, c_<value>, d_<value>): rows at a value and its average rank minus the mean rank."""
    placed = running_counts(counts, keys)
    return placed.select(*keys, F.col("value").alias(value), F.col("cnt").alias("c_" + value),
                         (average_rank() - (F.col("n") + 1) / F.lit(2.0)).alias("d_" + value))


def _rank_r(w, dx, dy):
    return F.try_divide(F.sum(w * dx * dy), F.sqrt(F.sum(w * dx * dx) * F.sum(w * dy * dy)))


def _spearman(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Pearson on average ranks, each pair on its own complete rows."""
    data = df.select(*by, *[as_double(c).alias(c) for c in cols])
    data = data.na.drop(subset=list(by)) if by else data
    ranges = sketch_ranges(data, cols)
    data = ranges.apply(data)
    total = ranges.rows if ranges.tied else None
    if ranges.complete:
        return _spearman_complete(data, cols, by, total)
    pairs = list(combinations(cols, 2))
    cells = F.array(*[
        F.struct(F.lit(i).alias("pair"), F.col(a).alias("x"), F.col(a + "__range").alias("xr"),
                 F.col(b).alias("y"), F.col(b + "__range").alias("yr"))
        for i, (a, b) in enumerate(pairs)])
    keys = [*by, "pair"]
    long = data.select(*by, F.inline(cells)).na.drop(subset=["x", "y", *by])
    points = long.groupBy(*keys, "x", "xr", "y", "yr").agg(F.count(F.lit(1)).alias("cnt"))

    def ranks(value: str) -> DataFrame:
        counts = points.groupBy(*keys, F.col(value + "r").alias("range"), F.col(value).alias("value")) \
                       .agg(F.sum("cnt").alias("cnt"))
        return _centred_ranks(counts, keys, value)

    step = attach_by_value(points, ranks("x"), "x", "c_x", keys, spread="y", total=total)
    step = attach_by_value(step, ranks("y"), "y", "c_y", keys, spread="x", total=total)
    out = step.groupBy(*keys).agg(F.sum("cnt").alias("n"), _rank_r(F.col("cnt"), F.col("d_x"), F.col("d_y")).alias("r"))
    first, second = (F.array(*[F.lit(p[i]) for p in pairs]) for i in (0, 1))
    return out.select(*by, F.get(first, "pair").alias("var1"), F.get(second, "pair").alias("var2"), "n", "r")


def _spearman_complete(data: DataFrame, cols: Sequence[str], by: Sequence[str], total: int | None) -> DataFrame:
    """Without nulls a column has one rank for all its pairs: rank p columns, not p(p-1)/2 pairs."""
    rows = data.select(*by, *cols)
    for i, c in enumerate(cols):
        counts = data.groupBy(*by, F.col(c + "__range").alias("range"), F.col(c).alias("value")) \
                     .agg(F.count(F.lit(1)).alias("cnt"))
        rows = attach_by_value(rows, _centred_ranks(counts, list(by), c), c, "c_" + c, list(by),
                               spread=cols[i - 1], total=total).drop("c_" + c)
    aggs, out = [], []
    for i, (a, b) in enumerate(combinations(cols, 2)):
        aggs.append(F.struct(F.count(F.lit(1)).alias("n"),
                             _rank_r(F.lit(1.0), F.col("d_" + a), F.col("d_" + b)).alias("r")).alias(f"p_{i}"))
        out.append(F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"),
                            F.col(f"p_{i}.n").alias("n"), F.col(f"p_{i}.r").alias("r")))
    return rows.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*out)))


def correlate(df: DataFrame, cols: Sequence[str], method: str = "pearson", by: Sequence[str] = ()) -> DataFrame:
    """(by..., var1, var2, n, r) for every pair, on pairwise complete rows."""
    return {"pearson": _pearson, "spearman": _spearman}[method](df, cols, list(by))


def pair_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(var1, var2, pearson, spearman)."""
    p = correlate(df, cols, "pearson").select("var1", "var2", F.col("r").alias("pearson"))
    s = correlate(df, cols, "spearman").select("var1", "var2", F.col("r").alias("spearman"))
    return p.join(s, ["var1", "var2"], "inner")


def correlate_wide(df: DataFrame, cols: Sequence[str], group: str, groups: Sequence | None = None) -> DataFrame:
    """(var1, var2, r_<group>...): one column per group, absent pairs null."""
    long = correlate(df.na.drop(subset=[group]), cols, by=[group])
    out = long.groupBy("var1", "var2").pivot(group, list(groups) if groups else None).agg(F.first("r"))
    return out.select("var1", "var2", *[F.col(f"`{c}`").alias(f"r_{c}") for c in out.columns[2:]])


def with_correlation_p(df: DataFrame, r: str = "r", n: str = "n", lost: int = 2) -> DataFrame:
    """Add ``t`` and ``p_value`` of a correlation with ``n - lost`` degrees of freedom; needs n >= 3."""
    dof = F.col(n) - lost
    t = F.when((F.col(n) >= 3) & (dof > 0),
               F.try_divide(F.col(r) * F.sqrt(dof.cast("double")), F.sqrt(1 - F.col(r) * F.col(r))))
    return df.withColumn("t", t).withColumn("p_value", t_two_sided(F.col("t"), dof))


def total_correlation(df: DataFrame, x: str, y: str, covars: Sequence[str]) -> DataFrame:
    """Plain correlation of x and y on the rows complete in the covariates too."""
    return with_correlation_p(correlate(df.na.drop(subset=[x, y, *covars]), [x, y]))


def partial_correlation(df: DataFrame, x: str, y: str, covars: Sequence[str]) -> DataFrame:
    """Correlation of x and y given the covariates, from the inverse moment matrix."""
    m = moment_matrix(df, [x, y, *covars])
    sd = np.sqrt(np.diag(m.cross))
    inv = np.linalg.pinv(m.cross / np.outer(sd, sd))
    r = float(-inv[0, 1] / np.sqrt(inv[0, 0] * inv[1, 1]))
    out = local_table(df.sparkSession, [(x, y, ",".join(covars), m.n, r)],
                      "var1 string, var2 string, given string, n bigint, r double")
    return with_correlation_p(out, lost=2 + len(covars))


def compare_correlations(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """Fisher z test of every pair of variables between every pair of groups.

    Sizes are the pairwise complete ones; groups with fewer than 4 rows are skipped.
    """
    long = correlate(df.na.drop(subset=[group]), cols, by=[group]).where("n >= 4 AND r IS NOT NULL")
    a = long.select("var1", "var2", F.col(group).alias("group1"), F.col("n").alias("n1"), F.col("r").alias("r1"))
    b = long.select("var1", "var2", F.col(group).alias("group2"), F.col("n").alias("n2"), F.col("r").alias("r2"))
    pairs = a.join(b, ["var1", "var2"]).where(F.col("group1") < F.col("group2"))
    return fisher_z(pairs)


def fisher_z(pairs: DataFrame) -> DataFrame:
    """Add ``z``, ``p_value`` and a verdict to rows with r1, n1, r2, n2; null when either n < 4."""
    se = F.sqrt(F.lit(1.0) / (F.col("n1") - 3) + F.lit(1.0) / (F.col("n2") - 3))
    z = F.when((F.col("n1") >= 4) & (F.col("n2") >= 4), (F.atanh("r1") - F.atanh("r2")) / se)
    out = pairs.withColumn("z", z).withColumn("p_value", normal_two_sided(F.col("z")))
    return out.withColumn("verdict", significance_label(F.col("p_value")))


def rank_correlates(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """(variable, r) with the target, strongest first, on complete rows; empty when it is constant."""
    data = df.select(*[as_double(c).alias(c) for c in dict.fromkeys([target, *cols])]).na.drop()
    row = data.agg(F.var_samp(target).alias("v"), *[correlation(F.col(c), F.col(target)).alias(f"r_{i}") for i, c in enumerate(cols)])
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"r_{i}").alias("r")) for i, c in enumerate(cols)])
    return row.where("v > 0").select(F.inline(cells)).where("r IS NOT NULL AND NOT isnan(r)") \
              .orderBy(F.abs("r").desc(), "variable")
