"""Shapiro-Wilk test on the exact order of all rows, without a single-task sort."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabstat.functions.normal_scores import normal_quantile
from tabstat.functions.tails import normal_cdf
from tabstat.plans.order_stats import running_counts, value_counts
from tabstat.plans.stats import as_double, settle

#: Positions that one row of the middle step expands to at most, so that a value many rows share is spread over tasks.
PIECE = 1 << 16

# Royston (1995), powers from the highest down.
LAST = [-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0]  # of 1 / sqrt(n)
LAST_BUT_ONE = [-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0]
SMALL_SHIFT = [0.459, -2.273]  # of n, for 4 to 11 rows
SMALL_MEAN = [-0.0006714, 0.025054, -0.39978, 0.5440]
SMALL_LOG_SD = [-0.0020322, 0.062767, -0.77857, 1.3822]
LARGE_MEAN = [0.0038915, -0.083751, -0.31082, -1.5861]  # of ln n, from 12 rows on
LARGE_LOG_SD = [0.0030302, -0.082676, -0.4803]


def _polynomial(coefficients: Sequence[float], x: Column) -> Column:
    return reduce(lambda a, c: a * x + c, coefficients[1:], F.lit(float(coefficients[0])))


def order_scores(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., variable, i, n, value, score): every value at its place in ascending order with its expected normal score (Blom)."""
    placed = running_counts(value_counts(df, cols, by), [*by, "variable"])
    pieces = placed.select(*by, "variable", "value", "n", (F.col("below") + F.col("ties")).alias("end"),
                           F.explode(F.sequence(F.col("below") + 1, F.col("below") + F.col("ties"), F.lit(PIECE).cast("long"))).alias("start"))
    pieces = pieces.repartition(*by, "variable", "start")
    i = F.explode(F.sequence("start", F.least("end", F.col("start") + PIECE - 1)))
    return pieces.select(*by, "variable", "value", "n", i.alias("i")) \
        .withColumn("p", (F.col("i") - 0.375) / (F.col("n") + 0.25)).withColumn("score", normal_quantile("p")).drop("p")


def shapiro_wilk(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., variable, n, w, p_value) of the test that a column is normal; nulls are left out.

    W needs three rows and two distinct values, else it is null. The p-value is Royston's approximation, made for up to 5,000
    rows; beyond that W is exact in the same sense and the p-value is an extrapolation.
    """
    scored = order_scores(df, cols, by)
    keys = [*by, "variable"]
    centre = df.groupBy(*by).agg(*[F.avg(as_double(c)).alias(f"m_{i}") for i, c in enumerate(cols)])
    centre = centre.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"m_{i}").alias("centre")) for i, c in enumerate(cols)])))
    few = settle(centre)
    scored = scored.join(few if few is not None else centre, keys).withColumn("x", F.col("value") - F.col("centre"))

    def at(place: Column) -> Column:
        return F.max(F.when(F.col("i") == place, F.col("x")))

    def score_at(place: Column) -> Column:
        return F.max(F.when(F.col("i") == place, F.col("score")))

    n = F.col("n")
    inner = (F.col("i") > 2) & (F.col("i") < n - 1)
    sums = scored.groupBy(*keys).agg(
        F.max("n").alias("n"), F.sum(F.col("x") * F.col("x")).alias("spread"), F.sum(F.col("score") * F.col("score")).alias("mm"),
        F.sum(F.when(inner, F.col("score") * F.col("x")).otherwise(0.0)).alias("inner"),
        (at(n) - at(F.lit(1))).alias("outer"), (at(n - 1) - at(F.lit(2))).alias("next"), score_at(n).alias("m1"), score_at(n - 1).alias("m2"))
    u = 1 / F.sqrt(n.cast("double"))
    a1 = _polynomial(LAST, u) + F.col("m1") / F.sqrt("mm")
    a2 = _polynomial(LAST_BUT_ONE, u) + F.col("m2") / F.sqrt("mm")
    m1, m2 = F.col("m1") * F.col("m1"), F.col("m2") * F.col("m2")
    wide = F.sqrt((F.col("mm") - 2 * m1 - 2 * m2) / (1 - 2 * F.col("a1") * F.col("a1") - 2 * F.col("a2") * F.col("a2")))
    short = F.sqrt((F.col("mm") - 2 * m1) / (1 - 2 * F.col("a1") * F.col("a1")))
    linear = F.when(n > 5, F.col("a1") * F.col("outer") + F.col("a2") * F.col("next") + F.try_divide(F.col("inner"), wide)) \
        .when(n > 3, F.col("a1") * F.col("outer") + F.try_divide(F.col("m2") * F.col("next") + F.col("inner"), short)) \
        .when(n == 3, math.sqrt(0.5) * F.col("outer"))
    w = F.least(F.lit(1.0), F.try_divide(linear * linear, F.col("spread")))
    done = sums.withColumn("a1", a1).withColumn("a2", a2).withColumn("w", F.when(F.col("outer") > 0, w))
    return done.select(*keys, "n", "w", shapiro_p(F.col("w"), n).alias("p_value"))


def shapiro_p(w: Column, n: Column) -> Column:
    """The probability of a W this small under normality."""
    size = n.cast("double")
    log_n, left = F.ln(size), F.ln(F.greatest(1 - w, F.lit(1e-300)))
    small = (-F.ln(_polynomial(SMALL_SHIFT, size) - left) - _polynomial(SMALL_MEAN, size)) / F.exp(_polynomial(SMALL_LOG_SD, size))
    large = (left - _polynomial(LARGE_MEAN, log_n)) / F.exp(_polynomial(LARGE_LOG_SD, log_n))
    three = F.greatest(F.lit(0.0), F.lit(6 / math.pi) * (F.asin(F.sqrt(w)) - math.asin(math.sqrt(0.75))))
    return F.when(w.isNull(), F.lit(None).cast("double")).when(n == 3, three).when(n < 12, normal_cdf(-small)).otherwise(normal_cdf(-large))
