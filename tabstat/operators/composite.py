"""Composite scores per dimension."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstat.operators.columns import present_groups
from tabstat.operators.derive import linear_score, mean_of, principal_axes
from tabstat.operators.reshape import dimension_table
from tabstat.plans.moments import moment_matrices
from tabstat.plans.stats import as_double


def scores(df: DataFrame, dims: Mapping[str, Sequence[str]], method: str = "mean") -> DataFrame:
    """One score column per dimension.

    ``mean`` skips nulls; ``pca`` is the first component of the centred, unscaled
    variables on complete rows (one variable is returned as it is). The moments of all
    dimensions come from one pass.
    """
    groups = present_groups(df, dims)
    empty = [d for d, vs in groups.items() if not vs]
    if empty:
        raise ValueError(f"dimensions without variables: {empty}")
    if method == "mean":
        return df.withColumns({d: mean_of(vs) for d, vs in groups.items()})
    if method != "pca":
        raise ValueError(f"unknown method {method!r}")
    many = {d: vs for d, vs in groups.items() if len(vs) > 1}
    out = {d: as_double(vs[0]) for d, vs in groups.items() if len(vs) == 1}
    if many:
        for (d, vs), m in zip(many.items(), moment_matrices(df, list(many.values()))):
            _, axes = principal_axes(m.cross, 1)
            out[d] = linear_score(vs, m.mean, axes[0])
    return df.withColumns({d: out[d] for d in groups})


def dimension_means(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """(ord, Grupo, metrica): mean score of every dimension in fixed order."""
    row = df.agg(*[F.avg(as_double(d)).alias(f"v_{i}") for i, d in enumerate(dims)])
    cells = F.array(*[F.struct(F.lit(d).alias("Grupo"), F.col(f"v_{i}").alias("metrica")) for i, d in enumerate(dims)])
    return dimension_table(row.select(F.inline(cells)), dims)
