"""Explanations of fitted models."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabstat.operators.describe import per_column
from tabstat.operators.linear import OlsResult, fit_metrics
from tabstat.operators.supervised import Trained, class_metrics
from tabstat.plans.stats import as_double


def shap_linear(model: OlsResult, df: DataFrame, prefix: str = "phi_") -> DataFrame:
    """``phi_<x>`` = coef * (x - background mean) and ``base``; they add up to the prediction.

    The background is every training row, through the means the fit already has.
    """
    m, s = model.moments, model.solved
    phi = {f"{prefix}{x}": (as_double(x) - float(m.mean[i])) * float(s.beta[i]) for i, x in enumerate(model.xs)}
    return df.withColumns(phi).withColumn("base", F.lit(float(m.mean[-1])))


def global_importance(shap: DataFrame, xs: Sequence[str], prefix: str = "phi_") -> DataFrame:
    """(feature, importance): mean absolute contribution, largest first."""
    row = shap.agg(*[F.avg(F.abs(prefix + x)).alias(f"v_{i}") for i, x in enumerate(xs)])
    cells = F.array(*[F.struct(F.lit(x).alias("feature"), F.col(f"v_{i}").alias("importance")) for i, x in enumerate(xs)])
    return row.select(F.inline(cells)).orderBy(F.col("importance").desc())


def explain_row(shap: DataFrame, key: str, value, xs: Sequence[str], prefix: str = "phi_") -> DataFrame:
    """(feature, contribution, base, prediction) of one row, largest contribution first."""
    row = shap.where(F.col(key) == value)
    total = reduce(add, [F.col(prefix + x) for x in xs], F.col("base"))
    cells = F.array(*[F.struct(F.lit(x).alias("feature"), F.col(prefix + x).alias("contribution")) for x in xs])
    return row.select(F.col("base"), total.alias("prediction"), F.inline(cells)).orderBy(F.abs("contribution").desc())


def contribution_table(shap: DataFrame, key: str, x: str, xs: Sequence[str], prefix: str = "phi_") -> DataFrame:
    """(key, value, contribution, output) of one feature for every row."""
    total = reduce(add, [F.col(prefix + c) for c in xs], F.col("base"))
    return shap.select(key, as_double(x).alias("value"), F.col(prefix + x).alias("contribution"), total.alias("output"))


def shuffle_column(df: DataFrame, col: str, key: str, seed: int, block: int = 50_000, rows: int | None = None) -> DataFrame:
    """``df`` with the values of ``col`` permuted.

    Rows fall into hash blocks of bounded size; inside a block each row takes the value
    of its neighbour in a random order, which is a permutation without a self join.
    """
    n = rows if rows is not None else df.count()
    blocks = max(1, -(-n // block))
    w = Window.partitionBy("block__").orderBy("order__")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    data = df.withColumn("block__", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(blocks))) \
             .withColumn("order__", F.xxhash64(F.lit(seed + 1), F.col(key)))
    last = F.row_number().over(w) == F.count(F.lit(1)).over(whole)
    moved = F.when(last, F.first(col).over(whole)).otherwise(F.lead(col).over(w))
    return data.withColumn(col, moved).drop("block__", "order__")


def permutation_importance(model: Trained, df: DataFrame, y: str, xs: Sequence[str], key: str, seed: int = 42) -> DataFrame:
    """(feature, baseline, permuted, importance): loss of R2 or accuracy when one feature is shuffled.

    Values move inside hash blocks of at most some 50,000 rows, which are random rows of the table (``shuffle_column``).
    """
    def score(data: DataFrame) -> DataFrame:
        scored = model.predict(data)
        if model.task == "regression":
            return fit_metrics(scored, y, "prediction").select(F.col("r2").alias("s"))
        return class_metrics(scored, y, "prediction").select(F.col("accuracy").alias("s"))

    n = df.count()
    base = score(df).scalar()
    out = None
    for i, x in enumerate(xs):
        row = score(shuffle_column(df, x, key, seed + 2 * i, rows=n)).select(F.lit(x).alias("feature"), F.col("s").alias("permuted"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("baseline", base).withColumn("importance", F.col("baseline") - F.col("permuted"))


def shap_summary(shap: DataFrame, xs: Sequence[str], prefix: str = "phi_") -> DataFrame:
    """(feature, mean, mean_abs, min, max) of the contributions."""
    def aggs(c: str):
        return [F.avg(c).alias("mean"), F.avg(F.abs(c)).alias("mean_abs"), F.min(c).alias("min"), F.max(c).alias("max")]

    table = per_column(shap, [prefix + x for x in xs], aggs)
    return table.withColumn("feature", F.substring("variable", len(prefix) + 1, 1000)).drop("variable")
