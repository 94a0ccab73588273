"""Hypothesis tests from grouped moments."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.ml.stat import KolmogorovSmirnovTest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstat.functions.labels import SIGNIFICANCE
from tabstat.functions.quantile_points import range_point, range_tail
from tabstat.functions.tails import chi2_upper, f_upper, t_two_sided
from tabstat.operators.derive import composite_key
from tabstat.operators.describe import per_column
from tabstat.plans.order_stats import attach_by_value, average_rank, quantile_table, running_counts, value_counts
from tabstat.plans.stats import as_double, bounded_rows, local_table, settle


def _one_sample(df: DataFrame, x, shift) -> DataFrame:
    return df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd")) \
             .withColumn("effect", F.col("mean") - shift)


def t_one(df: DataFrame, col: str, mu0: float) -> DataFrame:
    """One-sample t test with its standardized effect."""
    out = _one_sample(df, as_double(col), F.lit(float(mu0)))
    out = out.select("n", "mean", "sd",
                     F.try_divide(F.col("effect") * F.sqrt(F.col("n").cast("double")), F.col("sd")).alias("t"),
                     (F.col("n") - 1).alias("dof"), F.try_divide(F.col("effect"), F.col("sd")).alias("cohens_d"))
    return out.withColumn("p_value", t_two_sided(F.col("t"), F.col("dof")))


def t_paired(df: DataFrame, pre: str, post: str) -> DataFrame:
    """Paired t of pre - post; the effect size is of post - pre, so the signs differ."""
    data = df.na.drop(subset=[pre, post])
    out = _one_sample(data, as_double(pre) - as_double(post), F.lit(0.0))
    out = out.select("n", F.col("mean").alias("mean_difference"), F.col("sd"),
                     F.try_divide(F.col("mean") * F.sqrt(F.col("n").cast("double")), F.col("sd")).alias("t"),
                     (F.col("n") - 1).alias("dof"), F.try_divide(-F.col("mean"), F.col("sd")).alias("cohens_d"))
    return out.withColumn("p_value", t_two_sided(F.col("t"), F.col("dof")))


def _group_moments(df: DataFrame, measures: Sequence[str], group: str) -> DataFrame:
    """(variable, g, n, m, v, css) per measure and group, complete cases per measure."""
    def aggs(name: str):
        c = as_double(name)
        return [F.count(c).alias("n"), F.avg(c).alias("m"), F.var_samp(c).alias("v"),
                (F.var_pop(c) * F.count(c)).alias("css")]

    data = df.na.drop(subset=[group]).select(F.col(group).alias("g"), *measures)
    return per_column(data, measures, aggs, ["g"]).where(F.col("n") > 0)


def t_two(df: DataFrame, y: str, group: str, equal_var: bool | None = None) -> DataFrame:
    """Two-sample t, pooled or Welch; by default the Levene test decides at 0.05.

    Groups are taken in level order; anything but exactly two groups raises at run time.
    """
    one = F.struct("g", "n", "m", "v")
    row = _group_moments(df, [y], group).agg(
        F.count(F.lit(1)).alias("k"), F.min(one).alias("a"), F.max(one).alias("b"))
    row = row.select(F.when(F.col("k") == 2, F.col("a")).otherwise(
        F.raise_error(F.lit("exactly two groups are needed"))).alias("a"), "b")
    if equal_var is None:
        pooled = F.coalesce(levene(df, y, [group]).select("p_value").scalar() >= SIGNIFICANCE, F.lit(True))
    else:
        pooled = F.lit(equal_var)
    n1, n2 = F.col("a.n").cast("double"), F.col("b.n").cast("double")
    v1, v2 = F.col("a.v"), F.col("b.v")
    dof_pooled = n1 + n2 - 2
    var_pooled = F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, dof_pooled)
    w1, w2 = v1 / n1, v2 / n2
    diff = F.col("a.m") - F.col("b.m")
    out = row.withColumn("equal_var", pooled).select(
        F.col("a.g").cast("string").alias("group1"), F.col("b.g").cast("string").alias("group2"),
        F.col("a.n").alias("n1"), F.col("b.n").alias("n2"), F.col("a.m").alias("mean1"), F.col("b.m").alias("mean2"),
        "equal_var",
        F.try_divide(diff, F.sqrt(F.when(F.col("equal_var"), var_pooled * (1 / n1 + 1 / n2)).otherwise(w1 + w2))).alias("t"),
        F.when(F.col("equal_var"), dof_pooled).otherwise(
            F.try_divide((w1 + w2) * (w1 + w2), w1 * w1 / (n1 - 1) + w2 * w2 / (n2 - 1))).alias("dof"),
        F.try_divide(diff, F.sqrt(var_pooled)).alias("cohens_d"))
    return out.withColumn("p_value", t_two_sided(F.col("t"), F.col("dof")))


def _f_table(groups: DataFrame) -> DataFrame:
    """(variable, n, k, ss_between, df_between, ss_within, df_within, f, eta_squared) of group moments."""
    centre = groups.groupBy("variable").agg(
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.sum("n").alias("total"))
    joined = groups.join(F.broadcast(centre), "variable")  # one row per measure
    d = F.col("m") - F.col("grand")
    out = joined.groupBy("variable").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("n") * d * d).alias("ss_between"), F.sum("css").alias("ss_within"))
    dfb, dfw = F.col("k") - 1, F.col("n") - F.col("k")
    out = out.select("variable", "n", "k", "ss_between", dfb.alias("df_between"), "ss_within", dfw.alias("df_within"))
    f = F.try_divide(F.try_divide(F.col("ss_between"), F.col("df_between")),
                     F.try_divide(F.col("ss_within"), F.col("df_within")))
    return out.withColumn("f", f).withColumn(
        "eta_squared", partial_eta(F.col("ss_between"), F.col("ss_within")))


def partial_eta(ss, ss_error):
    """SS / (SS + SSE), 0 when both are 0."""
    return F.when(ss + ss_error == 0, F.lit(0.0)).otherwise(F.try_divide(ss, ss + ss_error))


def one_way(df: DataFrame, measures: Sequence[str], group: str) -> DataFrame:
    """One-way analysis of variance, one row per measure."""
    out = _f_table(_group_moments(df, measures, group))
    return out.withColumn("p_value", f_upper(F.col("f"), F.col("df_between"), F.col("df_within")))


def levene(df: DataFrame, y: str, factors: Sequence[str]) -> DataFrame:
    """Median-centred Levene test over the groups of one or more factors; p is 1 below two groups."""
    key = F.col(factors[0]) if len(factors) == 1 else composite_key(factors)
    data = df.select(key.alias("g"), as_double(y).alias("y")).na.drop()
    medians = quantile_table(data, ["y"], [0.5], ["g"]).select("g", "n", F.col("q_0").alias("med"))
    few = settle(medians)
    joined = data.join(few, "g") if few is not None else \
        attach_by_value(data, medians, "g", "n", [], spread="y", total=data.count())
    spread = joined.select("g", F.abs(F.col("y") - F.col("med")).alias("z"))
    out = _f_table(_group_moments(spread, ["z"], "g"))
    p = f_upper(F.col("f"), F.col("df_between"), F.col("df_within"))
    few = F.col("k") < 2
    return out.select("n", "k", F.when(~few, F.col("f")).alias("statistic"), "df_between", "df_within",
                      F.when(few, F.lit(1.0)).otherwise(p).alias("p_value"))


def _design(terms: Sequence[tuple[str, ...]], codes: dict[str, np.ndarray]) -> np.ndarray:
    """Intercept plus indicator products for every term (redundant columns are handled by rank)."""
    n = len(next(iter(codes.values())))
    blocks = [np.ones((n, 1))]
    for term in terms:
        label = np.zeros(n, dtype=np.int64)
        for f in term:
            label = label * (codes[f].max() + 1) + codes[f]
        _, inverse = np.unique(label, return_inverse=True)
        blocks.append(np.eye(inverse.max() + 1)[inverse])
    return np.hstack(blocks)


def _lack_of_fit(x: np.ndarray, mean: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Weighted residual sum of squares of the cell means, and the rank of the design."""
    w = np.sqrt(n)
    beta, _, rank, _ = np.linalg.lstsq(x * w[:, None], mean * w, rcond=1e-10)
    resid = mean - x @ beta
    return float(np.sum(n * resid * resid)), int(rank)


def anova(df: DataFrame, y: str, factors: Sequence[str], max_cells: int = 5000) -> DataFrame:
    """Type II table (term, sum_sq, df, f, p_value, partial_eta) with all interactions.

    The rows are reduced to one line per factor cell; the least squares run on those
    cells, whose number is checked against ``max_cells``.
    """
    data = df.na.drop(subset=[y, *factors])
    cells = data.groupBy(*factors).agg(
        F.count(F.lit(1)).alias("n"), F.avg(as_double(y)).alias("m"),
        (F.var_pop(as_double(y)) * F.count(F.lit(1))).alias("css"))
    rows = bounded_rows(cells, max_cells, "factor cells")
    n = np.array([r["n"] for r in rows], dtype=float)
    mean = np.array([r["m"] for r in rows])
    within = float(sum(r["css"] for r in rows))
    mean = mean - np.sum(n * mean) / n.sum()
    codes = {f: np.unique([str(r[f]) for r in rows], return_inverse=True)[1] for f in factors}
    terms = [t for k in range(1, len(factors) + 1) for t in combinations(factors, k)]
    full_ss, full_rank = _lack_of_fit(_design(terms, codes), mean, n)
    sse, df_error = within + full_ss, int(n.sum()) - full_rank
    table = []
    for term in terms:
        others = [t for t in terms if not set(term) <= set(t)]
        ss0, rank0 = _lack_of_fit(_design(others, codes), mean, n)
        ss1, rank1 = _lack_of_fit(_design([*others, term], codes), mean, n)
        table.append((":".join(term), max(ss0 - ss1, 0.0), rank1 - rank0, sse, df_error))
    table.append(("Residual", sse, df_error, None, None))
    out = local_table(df.sparkSession, table, "term string, sum_sq double, df bigint, sse double, dfe bigint")
    f = F.try_divide(F.try_divide(F.col("sum_sq"), F.col("df")), F.try_divide(F.col("sse"), F.col("dfe")))
    out = out.withColumn("f", f).withColumn("p_value", f_upper(F.col("f"), F.col("df"), F.col("dfe")))
    return out.select("term", "sum_sq", "df", "f", "p_value",
                      F.when(F.col("sse").isNotNull(), partial_eta(F.col("sum_sq"), F.col("sse"))).alias("partial_eta"))


def kruskal(df: DataFrame, measures: Sequence[str], group: str) -> DataFrame:
    """Tie-corrected Kruskal-Wallis test, one row per measure.

    Rows are counted by (value, group) before ranking, so ties and large groups shrink first.
    """
    counts = value_counts(df, measures, [group])
    placed = running_counts(counts, ["variable"], shared=True)
    rank = average_rank()
    groups = placed.groupBy("variable", group).agg(
        F.sum("cnt").alias("n_g"), F.sum(F.col("cnt") * rank).alias("rank_sum"), F.max("n").alias("n"),
        F.sum(F.col("cnt") * (F.col("ties").cast("double") * F.col("ties") - 1)).alias("tie_sum"))
    n = F.col("n").cast("double")
    gap = F.col("rank_sum") / F.col("n_g") - (n + 1) / 2
    out = groups.groupBy("variable").agg(
        F.max("n").alias("n"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("n_g") * gap * gap).alias("spread"), F.sum("tie_sum").alias("tie_sum"))
    h = F.try_divide(F.col("spread") * 12 / (n * (n + 1)), 1 - F.try_divide(F.col("tie_sum"), n * n * n - n))
    out = out.select("variable", "n", "k", h.alias("h"), (F.col("k") - 1).alias("dof"))
    return out.withColumn("p_value", chi2_upper(F.col("h"), F.col("dof")))


def level_pairs(groups: DataFrame, fields: Sequence[str], by: Sequence[str] = (), max_levels: int = 2000) -> DataFrame:
    """All pairs a < b of the level rows, per ``by``, with k, total n and within sum of squares.

    The number of level rows is checked first; the pairs come from one array, not from a self join.
    """
    rows = bounded_rows(groups, max_levels, "group levels")
    groups = local_table(groups.sparkSession, rows, groups.schema)
    row = groups.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("levels"), F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("total"), F.sum("css").alias("ss_within"))
    first = row.select("*", F.posexplode("levels").alias("i", "a"))
    rest = F.slice("levels", F.col("i") + 2, F.greatest(F.col("k").cast("int") - F.col("i") - 1, F.lit(0)))
    return first.select(*by, "k", "total", "ss_within", "a", F.explode(rest).alias("b"))


def tukey(df: DataFrame, measures: Sequence[str], group: str, alpha: float = 0.05) -> DataFrame:
    """Tukey comparisons of every pair of groups: mean difference is second minus first level."""
    groups = _group_moments(df, measures, group)
    pairs = level_pairs(groups, ["g", "n", "m"], ["variable"])
    dof = (F.col("total") - F.col("k")).cast("double")
    se = F.sqrt(F.try_divide(F.col("ss_within"), dof) / 2 * (F.lit(1.0) / F.col("a.n") + F.lit(1.0) / F.col("b.n")))
    out = pairs.select("variable", F.col("a.g").cast("string").alias("group1"), F.col("b.g").cast("string").alias("group2"),
                       (F.col("b.m") - F.col("a.m")).alias("mean_difference"), se.alias("se"),
                       F.col("k").cast("int").alias("k"), dof.alias("dof"))
    out = out.withColumn("q", F.try_divide(F.abs("mean_difference"), F.col("se")))
    point = range_point(F.lit(1 - alpha), F.col("k"), F.col("dof"))
    out = out.withColumn("p_value", range_tail(F.col("q"), F.col("k"), F.col("dof"))).withColumn("half", point * F.col("se"))
    return out.select("variable", "group1", "group2", "mean_difference", "se", "dof", "q", "p_value",
                      (F.col("mean_difference") - F.col("half")).alias("lower"),
                      (F.col("mean_difference") + F.col("half")).alias("upper"),
                      (F.col("p_value") < alpha).alias("reject"))


def games_howell(df: DataFrame, measures: Sequence[str], group: str) -> DataFrame:
    """Unequal-variance comparisons: difference (first minus second), se, t, Welch dof, p."""
    groups = _group_moments(df, measures, group)
    pairs = level_pairs(groups, ["g", "n", "m", "v"], ["variable"])
    w1, w2 = F.col("a.v") / F.col("a.n"), F.col("b.v") / F.col("b.n")
    out = pairs.select(
        "variable", F.col("a.g").cast("string").alias("group1"), F.col("b.g").cast("string").alias("group2"),
        (F.col("a.m") - F.col("b.m")).alias("mean_difference"), F.sqrt(w1 + w2).alias("se"),
        F.try_divide((w1 + w2) * (w1 + w2), w1 * w1 / (F.col("a.n") - 1) + w2 * w2 / (F.col("b.n") - 1)).alias("dof"),
        F.col("k").cast("int").alias("k"))
    out = out.withColumn("t", F.try_divide(F.col("mean_difference"), F.col("se")))
    return out.withColumn("p_value", range_tail(F.abs("t") * F.sqrt(F.lit(2.0)), F.col("k"), F.col("dof"))).drop("k")


def group_tests(df: DataFrame, measures: Sequence[str], group: str, method: str = "anova") -> DataFrame:
    """(variable, statistic, p_value) of ANOVA or Kruskal-Wallis for several measures."""
    if method == "anova":
        return one_way(df, measures, group).select("variable", F.col("f").alias("statistic"), "p_value")
    return kruskal(df, measures, group).select("variable", F.col("h").alias("statistic"), "p_value")


def post_hoc(df: DataFrame, measures: Sequence[str], group: str, alpha: float = SIGNIFICANCE) -> DataFrame:
    """Tukey comparisons of the measures whose ANOVA is significant."""
    hit = group_tests(df, measures, group).where(F.col("p_value") < alpha).select("variable")
    return tukey(df, measures, group, alpha).join(hit, "variable", "left_semi")


def normality(df: DataFrame, col: str) -> DataFrame:
    """Jarque-Bera test from the third and fourth moments."""
    x = as_double(col)
    row = df.agg(F.count(x).alias("n"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"))
    jb = F.col("n") / 6 * (F.col("skewness") * F.col("skewness") + F.col("kurtosis") * F.col("kurtosis") / 4)
    return row.withColumn("jarque_bera", jb).withColumn("p_value", F.exp(-F.col("jarque_bera") / 2))


def ks_normal(df: DataFrame, col: str) -> DataFrame:
    """Kolmogorov-Smirnov distance to the normal law fitted to the column."""
    data = df.select(as_double(col).alias("x")).na.drop()
    fit = data.agg(F.avg("x"), F.stddev_samp("x")).first()
    out = KolmogorovSmirnovTest.test(data, "x", "norm", fit[0], fit[1])
    return out.select(F.col("statistic").alias("distance"), F.col("pValue").alias("p_value"))
