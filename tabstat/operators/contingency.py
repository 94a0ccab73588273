"""Cross tables and what is computed from them.

The table is scanned once (``cube`` gives cells and both margins); everything else
works on levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabstat.functions.labels import concentration_label
from tabstat.functions.tails import chi2_upper

# label of the level that stands for missing values, fixed value
MISSING_LEVEL = "Valor_Ausente"


def crosstab(df: DataFrame, a: str, b: str, max_levels: int = 1000) -> DataFrame:
    """(a, b, observed, expected, row_total, col_total, n, n_rows, n_cols): all level pairs, 0 filled."""
    data = df.select(F.coalesce(F.col(a).cast("string"), F.lit(MISSING_LEVEL)).alias("a"),
                     F.coalesce(F.col(b).cast("string"), F.lit(MISSING_LEVEL)).alias("b"))
    counts = data.groupBy("a", "b").agg(F.count(F.lit(1)).alias("cnt"))
    cube = counts.cube("a", "b").agg(F.sum("cnt").alias("cnt"), F.grouping_id().alias("gid"))
    # one more than allowed is enough to refuse, so the array never outgrows its limit
    cols = cube.where("gid = 2").limit(max_levels + 1).agg(
        F.collect_list(F.struct(F.col("b").alias("b"), F.col("cnt").alias("col_total"))).alias("levels"),
        F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("n_cols"))
    side = cols.select(F.struct(
        F.when(F.col("n_cols") > max_levels, F.raise_error(F.lit(f"more than {max_levels} levels")))
         .otherwise(F.col("levels")).alias("levels"), "n", "n_cols").alias("s")).scalar()
    rows = cube.where("gid = 1").select("a", F.col("cnt").alias("row_total"))
    n_rows = rows.agg(F.struct(F.count(F.lit(1)).alias("k")).alias("s")).scalar()["k"]
    grid = rows.withColumn("n", side["n"]).withColumn("n_rows", n_rows).withColumn("n_cols", side["n_cols"]) \
               .select("*", F.inline(side["levels"]))
    out = grid.join(counts, ["a", "b"], "left")
    observed = F.coalesce(F.col("cnt"), F.lit(0)).alias("observed")
    expected = (F.col("row_total") * F.col("col_total").cast("double") / F.col("n")).alias("expected")
    return out.select("a", "b", observed, expected, "row_total", "col_total", "n", "n_rows", "n_cols")


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """(statistic, dof, p_value); continuity correction when dof is 1."""
    cells = crosstab(df, a, b)
    dof = (F.col("n_rows") - 1) * (F.col("n_cols") - 1)
    gap = F.abs(F.col("observed") - F.col("expected"))
    gap = F.when(dof == 1, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    out = cells.agg(F.sum(F.try_divide(gap * gap, F.col("expected"))).alias("statistic"), F.max(dof).alias("dof"))
    return out.withColumn("p_value", chi2_upper(F.col("statistic"), F.col("dof")))


def standardized_residuals(df: DataFrame, a: str, b: str) -> DataFrame:
    """The cross table with ``residual``; 0.5 is added to every cell first if any is 0."""
    cells = crosstab(df, a, b)
    empty = cells.agg(F.struct((F.min("observed") == 0).alias("z")).alias("s")).scalar()["z"]
    shift = F.when(empty, 0.5).otherwise(0.0)
    row = F.col("row_total") + shift * F.col("n_cols")
    col = F.col("col_total") + shift * F.col("n_rows")
    n = F.col("n") + shift * F.col("n_rows") * F.col("n_cols")
    e = row * col / n
    resid = F.try_divide(F.col("observed") + shift - e, F.sqrt(e * (1 - row / n) * (1 - col / n)))
    return cells.select("a", "b", "observed", "expected", resid.alias("residual"))


def combined_table(df: DataFrame, a: str, b: str) -> DataFrame:
    """One sorted long table (b, measure, a, value) of observed, expected and residual."""
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value"))
                      for m in ("observed", "expected", "residual")])
    return standardized_residuals(df, a, b).select("a", "b", F.inline(cells)).orderBy("b", "measure", "a")


def row_shares(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, share): percent within each row, nulls dropped."""
    counts = df.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).na.drop() \
               .groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("a")))


def dominance(df: DataFrame, a: str, b: str) -> DataFrame:
    """Largest row share and its verdict."""
    out = row_shares(df, a, b).agg(F.max("share").alias("max_row_share"))
    return out.withColumn("verdict", concentration_label(F.col("max_row_share")))
