"""Descriptive tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabstat.functions.labels import category_label
from tabstat.plans.order_stats import quantile_table
from tabstat.plans.stats import as_double, scalar_stats, settle, unpivot_doubles


def per_column(df: DataFrame, cols: Sequence[str], aggs, by: Sequence[str] = ()) -> DataFrame:
    """(by..., variable, stats...) where ``aggs(c)`` lists the statistics of one column.

    All columns share one aggregation; the result is turned long afterwards.
    """
    row = df.groupBy(*by).agg(*[F.struct(*aggs(c)).alias(f"s_{i}") for i, c in enumerate(cols)])
    names = row.schema["s_0"].dataType.fieldNames()
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), *[F.col(f"s_{i}.{x}").alias(x) for x in names])
                      for i, c in enumerate(cols)])
    return row.select(*by, F.inline(cells))


def bias_corrected_skew(c: Column) -> Column:
    n = F.count(c).cast("double")
    return F.when(F.count(c) > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def bias_corrected_kurtosis(c: Column) -> Column:
    n = F.count(c).cast("double")
    return F.when(F.count(c) > 3, F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def describe(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, quartiles, max, cv, range, skewness and excess kurtosis."""
    def aggs(name: str):
        c = as_double(name)
        return [F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                F.min(c).alias("min"), F.max(c).alias("max"),
                F.try_divide(F.stddev_samp(c), F.avg(c)).alias("cv"),
                (F.max(c) - F.min(c)).alias("range"),
                bias_corrected_skew(c).alias("skewness"), bias_corrected_kurtosis(c).alias("kurtosis")]

    data = df.na.drop(subset=list(by)) if by else df
    basic = per_column(data, cols, aggs, by)
    quart = quantile_table(data, cols, [0.25, 0.5, 0.75], by).select(
        *by, "variable", F.col("q_0").alias("q25"), F.col("q_1").alias("median"), F.col("q_2").alias("q75"))
    return basic.join(quart, [*by, "variable"], "left")


def frequencies(df: DataFrame, col: str, null_label: str | None = None) -> DataFrame:
    """(level, n, pct) with null as a level; sort by ``n`` descending to print."""
    level = F.col(col).cast("string")
    if null_label is not None:
        level = F.coalesce(level, F.lit(null_label))
    counts = df.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"))
    total = scalar_stats(counts, [F.sum("n").alias("n")])["n"]  # from the counts, not from the rows again
    return counts.withColumn("pct", F.try_divide(F.col("n") * 100.0, total))


def frequencies_of(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(variable, level, n) of several columns in one pass."""
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in cols])
    return df.select(F.inline(cells)).groupBy("variable", "level").agg(F.count(F.lit(1)).alias("n"))


def categorical_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Levels (null counted), mode, dominant level and share, verdict."""
    counts = frequencies_of(df, cols)
    top = F.struct((-F.col("n")).alias("neg"), F.col("level").isNull().alias("absent"), F.col("level").alias("level"))
    known = F.when(F.col("level").isNotNull(), F.struct((-F.col("n")).alias("neg"), F.col("level").alias("level")))
    out = counts.groupBy("variable").agg(
        F.count(F.lit(1)).alias("n_levels"), F.sum("n").alias("n_rows"),
        F.min(known).alias("m"), F.min(top).alias("t"))
    out = out.select("variable", "n_levels", "n_rows", F.col("m.level").alias("mode"),
                     F.col("t.level").alias("dominant"),
                     (F.lit(-100.0) * F.col("t.neg") / F.col("n_rows")).alias("dominant_pct"))
    return out.withColumn("verdict", category_label(F.col("n_levels"), F.col("dominant_pct")))


def group_means(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(as_double(c)).alias(f"mean_{c}") for c in cols])


def group_variances(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.var_samp(as_double(c)).alias(f"var_{c}") for c in cols])


def group_sizes(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def mean_and_error(df: DataFrame, y: str, by: Sequence[str]) -> DataFrame:
    """Mean with its standard error per group."""
    c = as_double(y)
    return df.groupBy(*by).agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"),
        (F.stddev_samp(c) / F.sqrt(F.count(c).cast("double"))).alias("se"))


def cell_means(df: DataFrame, y: str, factors: Sequence[str]) -> DataFrame:
    """Interaction table of two or more factors."""
    return mean_and_error(df.na.drop(subset=[y, *factors]), y, factors)


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 30) -> DataFrame:
    """(variable, bin, lower, upper, n): equal-width bins, the top edge in the last one."""
    row = scalar_stats(df, [a for i, c in enumerate(cols)
                            for a in (F.min(as_double(c)).alias(f"lo_{i}"), F.max(as_double(c)).alias(f"hi_{i}"))])
    cells = []
    for i, c in enumerate(cols):
        lo, hi = row[f"lo_{i}"], row[f"hi_{i}"]
        place = F.coalesce(F.floor(F.try_divide(as_double(c) - lo, hi - lo) * bins), F.lit(0))
        cells.append(F.struct(
            F.lit(c).alias("variable"), F.when(F.col(c).isNotNull(), F.least(place, F.lit(bins - 1))).cast("int").alias("bin")))
    counts = df.select(F.inline(F.array(*cells))).where(F.col("bin").isNotNull()) \
               .groupBy("variable", "bin").agg(F.count(F.lit(1)).alias("n"))
    lo = hi = F.lit(None).cast("double")
    for i, c in enumerate(cols):
        lo = F.when(F.col("variable") == c, row[f"lo_{i}"]).otherwise(lo)
        hi = F.when(F.col("variable") == c, row[f"hi_{i}"]).otherwise(hi)
    width = (hi - lo) / bins
    return counts.select("variable", "bin", (lo + F.col("bin") * width).alias("lower"),
                         (lo + (F.col("bin") + 1) * width).alias("upper"), "n")


def box_summary(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), factor: float = 1.5) -> DataFrame:
    """Quartiles, fences, whisker ends and outlier count per column (and group)."""
    q = quantile_table(df, cols, [0.25, 0.5, 0.75], by)
    width = F.col("q_2") - F.col("q_0")
    q = q.select(*by, "variable", "n", F.col("q_0").alias("q25"), F.col("q_1").alias("median"),
                 F.col("q_2").alias("q75"), (F.col("q_0") - factor * width).alias("lower_fence"),
                 (F.col("q_2") + factor * width).alias("upper_fence"))
    data = df.na.drop(subset=list(by)) if by else df
    x = F.col("value")
    outside = (x < F.col("lower_fence")) | (x > F.col("upper_fence"))
    if by:
        fences = settle(q)
        fences = q if fences is None else fences
    else:
        fences = F.broadcast(q)  # one line per column
    stats = unpivot_doubles(data, cols, by).join(fences, [*by, "variable"]).groupBy(*by, "variable").agg(
        F.min(F.when(~outside, x)).alias("whisker_low"), F.max(F.when(~outside, x)).alias("whisker_high"),
        F.sum(outside.cast("bigint")).alias("n_outliers"))
    return q.join(stats, [*by, "variable"])


def trend_lines(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """(by..., x, y, n, slope, intercept) of the least-squares line of each pair."""
    aggs, cells = [], []
    for i, (x, y) in enumerate(pairs):
        a, b = as_double(x), as_double(y)
        aggs.append(F.struct(F.regr_count(b, a).alias("n"), F.regr_slope(b, a).alias("slope"),
                             F.regr_intercept(b, a).alias("intercept")).alias(f"p_{i}"))
        cells.append(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"p_{i}.n").alias("n"),
                              F.col(f"p_{i}.slope").alias("slope"), F.col(f"p_{i}.intercept").alias("intercept")))
    return df.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*cells)))


def profile_signs(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Arrow per cluster and column: up where the cluster mean exceeds the overall mean.

    The overall mean includes rows without a cluster.
    """
    row = scalar_stats(df, [F.avg(as_double(c)).alias(f"m_{i}") for i, c in enumerate(cols)])
    means = group_means(df.na.drop(subset=[label]), cols, [label])
    return means.select(label, *[F.when(F.col(f"mean_{c}") > row[f"m_{i}"], "↑").otherwise("↓").alias(f"sign_{c}")
                                 for i, c in enumerate(cols)])


def within_variance(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Mean within-group variance (groups of more than one row) over total variance, in percent."""
    def aggs(name: str):
        c = as_double(name)
        return [F.count(c).alias("n"), F.avg(c).alias("m"), F.var_samp(c).alias("v"),
                (F.var_pop(c) * F.count(c)).alias("css")]

    groups = per_column(df.na.drop(subset=[label]), cols, aggs, [label]).where(F.col("n") > 0)
    centre = groups.groupBy("variable").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"))
    d = F.col("m") - F.col("grand")
    out = groups.join(F.broadcast(centre), "variable").groupBy("variable").agg(  # one line per column
        F.avg(F.when(F.col("n") > 1, F.col("v"))).alias("mean_group_variance"),
        F.try_divide(F.sum("css") + F.sum(F.col("n") * d * d), F.sum("n") - 1).alias("total_variance"))
    return out.withColumn(
        "within_variance_pct", F.try_divide(F.col("mean_group_variance") * 100, F.col("total_variance")))
