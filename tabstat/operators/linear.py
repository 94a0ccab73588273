"""Least squares from moments, with diagnostics as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabstat.functions.quantile_points import t_quantile
from tabstat.functions.tails import f_upper, t_two_sided
from tabstat.plans.moments import Moments, combine, correlation, from_row, moment_matrix, moments
from tabstat.plans.stats import as_double, bounded_rows, local_table


@dataclass(frozen=True)
class Solved:
    """Coefficients of one equation whose moments are ordered (xs..., y)."""

    intercept: float
    beta: np.ndarray
    ssr: float
    inverse: np.ndarray  # generalized inverse of the centred cross products
    rank: int


def solve(m: Moments) -> Solved:
    p = len(m.cols) - 1
    sxx, sxy = m.cross[:p, :p], m.cross[:p, p]
    scale = np.sqrt(np.where(np.diag(sxx) > 0, np.diag(sxx), 1.0))
    corr = sxx / np.outer(scale, scale)
    inverse = np.linalg.pinv(corr, rcond=1e-12) / np.outer(scale, scale) if p else np.zeros((0, 0))
    beta = inverse @ sxy
    ssr = max(float(m.cross[p, p] - beta @ sxy), 0.0)
    rank = int(np.linalg.matrix_rank(corr, tol=1e-10)) if p else 0
    return Solved(float(m.mean[p] - beta @ m.mean[:p]), beta, ssr, inverse, rank)


def linear_prediction(xs: Sequence[str], intercept: float, beta: Sequence[float]) -> Column:
    """Scoring expression; null when any input is null."""
    return reduce(add, [as_double(x) * float(b) for x, b in zip(xs, beta)], F.lit(float(intercept)))


@dataclass(frozen=True)
class OlsResult:
    y: str
    xs: tuple[str, ...]
    moments: Moments
    solved: Solved
    table: DataFrame  # variable, coef, se, t, p_value, lower, upper
    fit: DataFrame    # one row of fit statistics

    def score(self, df: DataFrame, prediction: str = "prediction", residual: str = "residual") -> DataFrame:
        fitted = linear_prediction(self.xs, self.solved.intercept, self.solved.beta)
        return df.withColumn(prediction, fitted).withColumn(residual, as_double(self.y) - F.col(prediction))


def ols(df: DataFrame, y: str, xs: Sequence[str], level: float = 0.95) -> OlsResult:
    """Ordinary least squares on complete cases: one pass, then a p x p solve."""
    m = moment_matrix(df, [*xs, y])
    s = solve(m)
    p, n = len(xs), m.n
    dof = n - s.rank - 1
    if dof <= 0:
        raise ValueError("too few rows for the number of predictors")
    sigma2 = s.ssr / dof
    mx = m.mean[:p]
    var = np.concatenate([[1 / n + mx @ s.inverse @ mx], np.diag(s.inverse)]) * sigma2
    coef = np.concatenate([[s.intercept], s.beta])
    se = np.sqrt(var)
    point = t_quantile(0.5 + level / 2, dof)
    spark = df.sparkSession
    rows = [(v, float(c), float(e), float(c / e) if e > 0 else None, dof, float(c - point * e), float(c + point * e))
            for v, c, e in zip(["const", *xs], coef, se)]
    table = local_table(spark, rows, "variable string, coef double, se double, t double, dof bigint, lower double, upper double")
    table = table.withColumn("p_value", t_two_sided(F.col("t"), F.col("dof")))
    sst = float(m.cross[p, p])
    r2 = 1 - s.ssr / sst if sst > 0 else float("nan")
    loglik = -n / 2 * (math.log(2 * math.pi) + math.log(s.ssr / n) + 1) if s.ssr > 0 else float("nan")
    f = (sst - s.ssr) / s.rank / sigma2 if s.rank and sigma2 > 0 else None
    fit = local_table(spark, [(n, s.rank, dof, r2, 1 - (1 - r2) * (n - 1) / dof, f, loglik,
                               -2 * loglik + 2 * (s.rank + 1), -2 * loglik + math.log(n) * (s.rank + 1), sigma2)],
                      "n bigint, df_model bigint, df_resid bigint, r2 double, adj_r2 double, f double, loglik double, "
                      "aic double, bic double, sigma2 double")
    fit = fit.withColumn("p_value", f_upper(F.col("f"), F.col("df_model"), F.col("df_resid")))
    return OlsResult(y, tuple(xs), m, s, table, fit)


def standardized_betas(result: OlsResult) -> DataFrame:
    """Coefficients on the z-scored scale, rescaled from the fitted ones."""
    sd = np.sqrt(np.diag(result.moments.cross))
    rows = [(x, float(b * sd[i] / sd[-1])) for i, (x, b) in enumerate(zip(result.xs, result.solved.beta))]
    return local_table(result.table.sparkSession, rows, "variable string, beta double")


def fit_metrics(df: DataFrame, y: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """n, r2, mse (n denominator), rmse and mae of a scored table."""
    data = df.select(*by, as_double(y).alias("y"), as_double(prediction).alias("p")).na.drop()
    e = F.col("y") - F.col("p")
    out = data.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
                                F.var_pop("y").alias("vy"))
    return out.select(*by, "n", (1 - F.try_divide(F.col("mse"), F.col("vy"))).alias("r2"), "mse",
                      F.sqrt("mse").alias("rmse"), "mae")


def vif(df: DataFrame, xs: Sequence[str]) -> DataFrame:
    """Variance inflation of every design column, the constant included."""
    m = moment_matrix(df, list(xs))
    sd = np.sqrt(np.diag(m.cross))
    inv = np.linalg.pinv(m.cross / np.outer(sd, sd)) / np.outer(sd, sd)
    rows = [("const", float(1 + m.n * m.mean @ inv @ m.mean))]
    rows += [(x, float(m.cross[i, i] * inv[i, i])) for i, x in enumerate(xs)]
    return local_table(df.sparkSession, rows, "variable string, vif double")


def influence(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """Complete rows with ``leverage``, ``cooks_distance`` and a flag at 4/n."""
    result = ols(df, y, xs)
    m, s = result.moments, result.solved
    c = [as_double(x) - float(m.mean[i]) for i, x in enumerate(xs)]
    h = reduce(add, [c[i] * c[j] * float(s.inverse[i, j]) for i in range(len(xs)) for j in range(len(xs))],
               F.lit(1.0 / m.n))
    sigma2 = s.ssr / (m.n - s.rank - 1)
    out = result.score(df.na.drop(subset=[y, *xs])).withColumn("leverage", h)
    d = F.col("residual") * F.col("residual") / ((s.rank + 1) * sigma2) * F.col("leverage") \
        / ((1 - F.col("leverage")) * (1 - F.col("leverage")))
    return out.withColumn("cooks_distance", d).withColumn("influential", F.col("cooks_distance") > 4.0 / m.n)


def simple_regressions(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """(variable, n, slope, intercept, r, note) of y on each x alone, all in one pass."""
    aggs, cells = [], []
    for i, x in enumerate(xs):
        a, b = as_double(x), as_double(y)
        aggs.append(F.struct(F.regr_count(b, a).alias("n"), F.regr_slope(b, a).alias("slope"),
                             F.regr_intercept(b, a).alias("intercept"), correlation(a, b).alias("r"),
                             F.regr_sxx(b, a).alias("sxx")).alias(f"p_{i}"))
        s = F.col(f"p_{i}")
        usable = (s["n"] > 1) & (s["sxx"] > 0)
        note = F.when(s["n"] < 2, "too few rows").when(s["sxx"] <= 0, "zero variance")
        cells.append(F.struct(F.lit(x).alias("variable"), s["n"].alias("n"),
                              *[F.when(usable, s[k]).alias(k) for k in ("slope", "intercept", "r")], note.alias("note")))
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def fold_of(key: str, k: int, seed: int | None = None) -> Column:
    """Fold number from the key itself, or from its seeded hash."""
    value = F.col(key) if seed is None else F.xxhash64(F.col(key), F.lit(seed))
    return F.pmod(value, F.lit(k)).cast("int")


def kfold_ols(df: DataFrame, y: str, xs: Sequence[str], k: int, key: str, seed: int | None = None) -> DataFrame:
    """(fold, n, r2, mse, mae) of held-out folds.

    One pass gives the moments of every fold; the training moments of a fold are the
    total minus that fold, so no model is refitted on rows. A second pass scores.
    """
    data = df.select(fold_of(key, k, seed).alias("fold"), *[as_double(c).alias(c) for c in [*xs, y]]).na.drop()
    rows = bounded_rows(moments(data, [*xs, y], ["fold"]), k, "folds")
    parts = {r["fold"]: from_row(r, [*xs, y]) for r in rows}
    total = combine(list(parts.values()))
    fitted = F.lit(None).cast("double")
    for number, part in parts.items():
        s = solve(total.minus(part))
        fitted = F.when(F.col("fold") == number, linear_prediction(xs, s.intercept, s.beta)).otherwise(fitted)
    return fit_metrics(data.withColumn("prediction", fitted), y, "prediction", ["fold"]) \
        .select("fold", "n", "r2", "mse", "mae")


def validation_summary(folds: DataFrame, score: str = "r2") -> DataFrame:
    """Mean and population deviation of the fold scores."""
    return folds.agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("sd"), F.count(F.lit(1)).alias("folds"))
