"""Joins, pair generation and set operations used across the workbench."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstat.plans.stats import local_table

# label of rows that were left out of a clustering, fixed value
NOT_CLUSTERED = "Não_Clusterizado"

# the four dimensions of the composite page in their order, fixed values
DIMENSIONS = ("Trocas materiais", "Subjetividades", "Estrutura/Instituições", "Relações interpessoais")


def join_pairs(a: DataFrame, b: DataFrame, on: Sequence[str] = ("var1", "var2"), how: str = "inner") -> DataFrame:
    """Equi-join of two result tables on the pair of variables (``inner`` or ``full``)."""
    return a.join(b, list(on), how)


def spread_groups(long: DataFrame, on: Sequence[str], group: str, value: str, prefix: str = "r_") -> DataFrame:
    """One ``<prefix><group>`` column per group: the outcome of full joins folded over groups, in one pivot."""
    out = long.groupBy(*on).pivot(group).agg(F.first(value))
    return out.select(*on, *[F.col(f"`{c}`").alias(prefix + c) for c in out.columns[len(on):]])


def write_back(df: DataFrame, result: DataFrame, key: Sequence[str], fill: dict | None = None) -> DataFrame:
    """Attach a result computed on complete rows; rows without one get null or a default."""
    out = df.join(result, list(key), "left")
    return out.na.fill(fill) if fill else out


def label_or_default(df: DataFrame, label: str, default: str = NOT_CLUSTERED) -> DataFrame:
    """Label as text, with the default for rows that have none."""
    return df.withColumn(label, F.coalesce(F.col(label).cast("string"), F.lit(default)))


def value_pairs(levels: DataFrame, col: str, max_levels: int = 1000) -> DataFrame:
    """All unordered pairs (a < b) of a level table, from one array of checked length."""
    row = levels.select(col).na.drop().distinct().limit(max_levels + 1).agg(F.sort_array(F.collect_list(col)).alias("v"))
    v = F.when(F.size("v") > max_levels, F.raise_error(F.lit(f"more than {max_levels} levels"))).otherwise(F.col("v"))
    first = row.select("v", F.posexplode(v).alias("i", "a"))
    return first.select("a", F.explode(F.slice("v", F.col("i") + 2, F.size("v"))).alias("b"))


def dimension_table(metrics: DataFrame, dims: Sequence[str] = DIMENSIONS, name: str = "Grupo", metric: str = "metrica") -> DataFrame:
    """Every dimension in its fixed order with its first metric, null where there is none."""
    order = local_table(metrics.sparkSession, list(enumerate(dims)), f"ord int, {name} string")
    first = metrics.groupBy(name).agg(F.first(metric).alias(metric))
    return order.join(first, name, "left").orderBy("ord")


def keep_groups(df: DataFrame, group: str, min_rows: int = 2) -> DataFrame:
    """Rows of groups with at least ``min_rows`` rows; groups are counted first, then semi-joined."""
    big = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows).select(group)
    return df.join(big, group, "left_semi")


def append_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Result rows of several models in one table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def top_rows(df: DataFrame, col: str, n: int, by_abs: bool = False) -> DataFrame:
    """Largest (absolute) values first, first ``n``."""
    c = F.abs(col) if by_abs else F.col(col)
    return df.orderBy(c.desc()).limit(n)
