"""Path models on a structured edge list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstat.functions.tails import t_two_sided
from tabstat.operators.linear import solve
from tabstat.plans.moments import moment_matrices
from tabstat.plans.stats import local_table


def edge_table(spark, edges: Sequence[tuple[str, str]]) -> DataFrame:
    return local_table(spark, list(edges), "src string, dst string")


def path_model(df: DataFrame, edges: Sequence[tuple[str, str]]) -> DataFrame:
    """(src, dst, n, beta, se, t, p_value): one least squares per dependent variable.

    Each equation uses its own complete rows and is skipped when rows do not exceed
    predictors. The moments of all equations come from one pass.
    """
    equations: dict[str, list[str]] = {}
    for src, dst in edges:
        equations.setdefault(dst, []).append(src)
    sets = [[*srcs, dst] for dst, srcs in equations.items()]
    rows = []
    for (dst, srcs), m in zip(equations.items(), moment_matrices(df, sets)):
        dof = m.n - len(srcs) - 1
        if m.n <= len(srcs) or dof <= 0:
            continue
        s = solve(m)
        for i, src in enumerate(srcs):
            se = float((s.inverse[i, i] * s.ssr / dof) ** 0.5)
            rows.append((src, dst, m.n, float(s.beta[i]), se, float(s.beta[i] / se) if se > 0 else None, dof))
    out = local_table(df.sparkSession, rows,
                      "src string, dst string, n bigint, beta double, se double, t double, dof bigint")
    return out.withColumn("p_value", t_two_sided(F.col("t"), F.col("dof")))


def mediations(edges: DataFrame) -> DataFrame:
    """(src, mediator, dst): an edge followed by an edge, ends different."""
    a = edges.select(F.col("src"), F.col("dst").alias("mediator"))
    b = edges.select(F.col("src").alias("mediator"), F.col("dst"))
    return a.join(b, "mediator").where(F.col("src") != F.col("dst")).select("src", "mediator", "dst")


def path_effects(direct: DataFrame) -> DataFrame:
    """(src, mediator, dst, indirect, direct, total) along every mediated path; an absent direct edge is 0."""
    a = direct.select("src", F.col("dst").alias("mediator"), F.col("beta").alias("b1"))
    b = direct.select(F.col("src").alias("mediator"), "dst", F.col("beta").alias("b2"))
    d = direct.select("src", "dst", F.col("beta").alias("direct"))
    out = a.join(b, "mediator").where(F.col("src") != F.col("dst")).join(d, ["src", "dst"], "left")
    indirect = F.col("b1") * F.col("b2")
    plain = F.coalesce(F.col("direct"), F.lit(0.0))
    return out.select("src", "mediator", "dst", indirect.alias("indirect"), plain.alias("direct"),
                      (indirect + plain).alias("total"))


def variable_roles(edges: DataFrame) -> DataFrame:
    """(variable, role): exogenous, mediator or endogenous."""
    src = edges.select(F.col("src").alias("variable")).distinct()
    dst = edges.select(F.col("dst").alias("variable")).distinct()
    parts = {"exogenous": src.exceptAll(dst), "mediator": src.intersect(dst), "endogenous": dst.exceptAll(src)}
    out = None
    for role, part in parts.items():
        part = part.withColumn("role", F.lit(role))
        out = part if out is None else out.unionByName(part)
    return out
