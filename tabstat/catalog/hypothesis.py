"""Hypothesis tests (H rows). P-values are checked in the unit tests: DuckDB has no such functions."""

from pyspark.sql import functions as F

from tabstat.catalog.registry import Tables, query, rounded
from tabstat.operators import hypothesis as hy


@query("t_one", "SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round((avg(value) - 48) * sqrt(count(value)) / stddev_samp(value), 6) AS t, count(value) - 1 AS dof, round((avg(value) - 48) / stddev_samp(value), 8) AS cohens_d FROM events")
def t_one_q(spark, sf):
    return rounded(hy.t_one(Tables(spark, sf).events, "value", 48.0).drop("p_value"), cohens_d=8)


TWO = """g AS (SELECT min(l_linestatus) AS g, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY l_linestatus),
 p AS (SELECT a.g AS group1, b.g AS group2, a.n AS n1, b.n AS n2, a.m AS m1, b.m AS m2, a.v AS v1, b.v AS v2, ((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) AS vp FROM g a JOIN g b ON a.g < b.g)"""
TWO_COLS = "group1, group2, n1, n2, round(m1, 6) AS mean1, round(m2, 6) AS mean2"


@query("t_two_pooled", f"WITH {TWO} SELECT {TWO_COLS}, true AS equal_var, round((m1 - m2) / sqrt(vp * (1 / n1 + 1 / n2)), 6) AS t, round((n1 + n2 - 2)::DOUBLE, 4) AS dof, round((m1 - m2) / sqrt(vp), 8) AS cohens_d FROM p")
def t_two_pooled_q(spark, sf):
    return rounded(hy.t_two(Tables(spark, sf).lineitem, "l_quantity", "l_linestatus", True).drop("p_value"), dof=4, cohens_d=8)


@query("t_two_welch", f"""WITH {TWO} SELECT {TWO_COLS}, false AS equal_var, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t,
 round((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 4) AS dof, round((m1 - m2) / sqrt(vp), 8) AS cohens_d FROM p""")
def t_two_welch_q(spark, sf):
    return rounded(hy.t_two(Tables(spark, sf).lineitem, "l_quantity", "l_linestatus", False).drop("p_value"), dof=4, cohens_d=8)


@query("t_two_auto")
def t_two_auto_q(spark, sf):
    return hy.t_two(Tables(spark, sf).lineitem, "l_quantity", "l_linestatus")


@query("t_paired", """SELECT count(d) AS n, round(avg(d), 6) AS mean_difference, round(stddev_samp(d), 6) AS sd, round(avg(d) * sqrt(count(d)) / stddev_samp(d), 5) AS t, count(d) - 1 AS dof,
 round(-avg(d) / stddev_samp(d), 8) AS cohens_d FROM (SELECT l_discount * 100 - l_quantity AS d FROM lineitem)""")
def t_paired_q(spark, sf):
    df = Tables(spark, sf).lineitem.withColumn("pre", F.col("l_discount") * 100)
    return rounded(hy.t_paired(df, "pre", "l_quantity").drop("p_value"), t=5, cohens_d=8)


def f_sql(source: str, variable: str | None) -> str:
    """One-way F parts of (g, y) rows."""
    name = f"'{variable}' AS variable, " if variable else ""
    return f"""SELECT {name}max(n)::BIGINT AS n, count(*) AS k, sum(ng * (m - gm) ** 2) AS ssb, sum(ss) AS ssw FROM
 (SELECT g, count(*) AS ng, avg(y) AS m, var_pop(y) * count(*) AS ss FROM {source} GROUP BY 1), (SELECT count(*) AS n, avg(y) AS gm FROM {source})"""


@query("levene", f"""WITH d AS (SELECT o_orderpriority AS g, o_totalprice AS y0 FROM orders), m AS (SELECT g, median(y0) AS med FROM d GROUP BY 1), z AS (SELECT g, abs(y0 - med) AS y FROM d JOIN m USING (g)),
 f AS ({f_sql('z', None)}) SELECT n, k, round((ssb / (k - 1)) / (ssw / (n - k)), 6) AS statistic, k - 1 AS df_between, n - k AS df_within FROM f""")
def levene_q(spark, sf):
    return rounded(hy.levene(Tables(spark, sf).orders, "o_totalprice", ["o_orderpriority"]).drop("p_value"))


@query("levene_factors", f"""WITH d AS (SELECT l_returnflag || '_' || l_linestatus AS g, l_quantity AS y0 FROM lineitem), m AS (SELECT g, median(y0) AS med FROM d GROUP BY 1), z AS (SELECT g, abs(y0 - med) AS y FROM d JOIN m USING (g)),
 f AS ({f_sql('z', None)}) SELECT n, k, round((ssb / (k - 1)) / (ssw / (n - k)), 6) AS statistic, k - 1 AS df_between, n - k AS df_within FROM f""")
def levene_factors_q(spark, sf):
    return rounded(hy.levene(Tables(spark, sf).lineitem, "l_quantity", ["l_returnflag", "l_linestatus"]).drop("p_value"))


ONE_WAY_COLS = "variable, n, k, round(ssb, 4) AS ss_between, k - 1 AS df_between, round(ssw, 3) AS ss_within, n - k AS df_within, round((ssb / (k - 1)) / (ssw / (n - k)), 6) AS f, round(ssb / (ssb + ssw), 8) AS eta_squared"


@query("anova1", f"WITH d AS (SELECT event_type AS g, value AS y FROM events), f AS ({f_sql('d', 'value')}) SELECT {ONE_WAY_COLS} FROM f")
def anova1_q(spark, sf):
    return rounded(hy.one_way(Tables(spark, sf).events, ["value"], "event_type").drop("p_value"), 6, ss_between=4, ss_within=3, eta_squared=8)


@query("anova2", """WITH r AS (SELECT l_linestatus AS a, l_returnflag AS b, l_quantity AS y FROM lineitem), c AS (SELECT a, b, count(*) AS n, avg(y) AS m, var_pop(y) * count(*) AS css FROM r GROUP BY 1, 2),
 g AS (SELECT avg(y) AS gm, count(*) AS n FROM r), w AS (SELECT sum(css) AS sse FROM c),
 d AS (SELECT b, max(m) FILTER (a = 'F') - max(m) FILTER (a = 'O') AS d, (max(n) FILTER (a = 'F') * max(n) FILTER (a = 'O'))::DOUBLE / sum(n) AS w FROM c GROUP BY 1),
 sa AS (SELECT sum(n * (m - gm) ** 2) AS ss FROM (SELECT a, count(*) AS n, avg(y) AS m FROM r GROUP BY 1), (SELECT gm FROM g)),
 sb AS (SELECT sum(n * (m - gm) ** 2) AS ss FROM (SELECT b, count(*) AS n, avg(y) AS m FROM r GROUP BY 1), (SELECT gm FROM g)),
 ab AS (SELECT sum(w * d) ** 2 / sum(w) AS ss FROM d), i AS (SELECT sum(w * (d - db) ** 2) AS ss FROM d, (SELECT sum(w * d) / sum(w) AS db FROM d)),
 t AS (SELECT 'l_linestatus' AS term, (SELECT ss FROM ab) AS ss, 1 AS df UNION ALL SELECT 'l_returnflag', (SELECT ss FROM sb) + (SELECT ss FROM ab) - (SELECT ss FROM sa), 2
  UNION ALL SELECT 'l_linestatus:l_returnflag', (SELECT ss FROM i), 2)
SELECT term, round(ss, 3) AS sum_sq, df::BIGINT AS df, round((ss / df) / (sse / (n - 6)), 6) AS f, round(ss / (ss + sse), 8) AS partial_eta FROM t, w, g
UNION ALL SELECT 'Residual', round(sse, 3), n - 6, NULL, NULL FROM w, g""")
def anova2_q(spark, sf):
    return rounded(hy.anova(Tables(spark, sf).lineitem, "l_quantity", ["l_linestatus", "l_returnflag"]).drop("p_value"), 6, sum_sq=3, partial_eta=8)


KW = """WITH r AS (SELECT l_returnflag AS g, {c} AS y, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS rk FROM lineitem),
 t AS (SELECT sum(c::DOUBLE ** 3 - c) AS ts FROM (SELECT count(*) AS c FROM r GROUP BY y)), n AS (SELECT count(*) AS n FROM r),
 s AS (SELECT count(*) AS k, sum(c * (mr - (n + 1) / 2) ** 2) AS s FROM (SELECT g, count(*) AS c, avg(rk) AS mr FROM r GROUP BY 1), n)
SELECT '{c}' AS variable, n, k, round(12 * s / (n::DOUBLE * (n + 1)) / (1 - ts / (n::DOUBLE ** 3 - n)), 6) AS h, k - 1 AS dof FROM s, t, n"""


@query("kruskal", "SELECT * FROM (" + KW.format(c="l_quantity") + ") UNION ALL SELECT * FROM (" + KW.format(c="l_discount") + ")")
def kruskal_q(spark, sf):
    return rounded(hy.kruskal(Tables(spark, sf).lineitem, ["l_quantity", "l_discount"], "l_returnflag").drop("p_value"))


@query("tukey", """WITH g AS (SELECT event_type AS g, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS css FROM events GROUP BY 1), w AS (SELECT sum(css) / (sum(n) - count(*)) AS mse, (sum(n) - count(*))::DOUBLE AS dof FROM g)
SELECT 'value' AS variable, a.g AS group1, b.g AS group2, round(b.m - a.m, 6) AS mean_difference, round(sqrt(mse / 2 * (1 / a.n + 1 / b.n)), 6) AS se, dof,
 round(abs(b.m - a.m) / sqrt(mse / 2 * (1 / a.n + 1 / b.n)), 6) AS q FROM g a JOIN g b ON a.g < b.g, w""")
def tukey_q(spark, sf):
    return rounded(hy.tukey(Tables(spark, sf).events, ["value"], "event_type").drop("p_value", "lower", "upper", "reject"))


@query("games_howell", """WITH g AS (SELECT event_type AS g, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1)
SELECT 'value' AS variable, a.g AS group1, b.g AS group2, round(a.m - b.m, 6) AS mean_difference, round(sqrt(a.v / a.n + b.v / b.n), 6) AS se,
 round((a.v / a.n + b.v / b.n) ** 2 / ((a.v / a.n) ** 2 / (a.n - 1) + (b.v / b.n) ** 2 / (b.n - 1)), 4) AS dof, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t FROM g a JOIN g b ON a.g < b.g""")
def games_howell_q(spark, sf):
    return rounded(hy.games_howell(Tables(spark, sf).events, ["value"], "event_type").drop("p_value"), dof=4)


@query("group_tests", "WITH a AS (SELECT l_returnflag AS g, l_quantity AS y FROM lineitem), b AS (SELECT l_returnflag AS g, l_extendedprice AS y FROM lineitem), c AS (SELECT l_returnflag AS g, l_tax AS y FROM lineitem), f AS ("
       + f_sql("a", "l_quantity") + " UNION ALL " + f_sql("b", "l_extendedprice") + " UNION ALL " + f_sql("c", "l_tax")
       + ") SELECT variable, round((ssb / (k - 1)) / (ssw / (n - k)), 6) AS statistic FROM f")
def group_tests_q(spark, sf):
    return rounded(hy.group_tests(Tables(spark, sf).lineitem, ["l_quantity", "l_extendedprice", "l_tax"], "l_returnflag").drop("p_value"))


@query("post_hoc", """WITH r AS (SELECT l_linenumber AS g, l_linenumber * 2.0::DOUBLE + l_quantity AS y FROM lineitem), g AS (SELECT g, avg(y) AS m FROM r GROUP BY 1)
SELECT 'steep' AS variable, a.g::VARCHAR AS group1, b.g::VARCHAR AS group2, round(b.m - a.m, 6) AS mean_difference FROM g a JOIN g b ON a.g < b.g""")
def post_hoc_q(spark, sf):
    df = Tables(spark, sf).lineitem.withColumn("steep", F.col("l_linenumber") * 2.0 + F.col("l_quantity")) \
        .withColumn("flat", F.pmod(F.col("l_orderkey") * 31 + F.col("l_partkey"), F.lit(2)))
    return rounded(hy.post_hoc(df, ["steep"], "l_linenumber").select("variable", "group1", "group2", "mean_difference"))


@query("normality", """SELECT n, round(g1, 6) AS skewness, round(g2, 5) AS kurtosis, round(n / 6 * (g1 ** 2 + g2 ** 2 / 4), 3) AS jarque_bera FROM (SELECT count(*) AS n,
 sum((value - m) ** 3) / count(*) / (sum((value - m) ** 2) / count(*)) ** 1.5 AS g1, sum((value - m) ** 4) / count(*) / (sum((value - m) ** 2) / count(*)) ** 2 - 3 AS g2 FROM events, (SELECT avg(value) AS m FROM events))""")
def normality_q(spark, sf):
    return rounded(hy.normality(Tables(spark, sf).events, "value").drop("p_value"), 6, kurtosis=5, jarque_bera=3)


@query("ks_normal")
def ks_normal_q(spark, sf):
    return hy.ks_normal(Tables(spark, sf).events, "value")
