"""Descriptive tables, contingency, joins and ordering (A, T, J, O rows)."""

from pyspark.sql import functions as F

from tabstat.catalog.registry import HOLES_SQL, Tables, query, rounded, with_holes
from tabstat.operators import contingency as ct
from tabstat.operators import describe as ds
from tabstat.operators import reshape as rs
from tabstat.plans.moments import moments

H = f"WITH h AS ({HOLES_SQL}) "


@query("moment_table", """SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS m_0, round(avg(l_discount), 8) AS m_1, round(var_pop(l_quantity) * count(*), 3) AS s_0_0,
 round(covar_pop(l_quantity, l_discount) * count(*), 5) AS s_0_1, round(var_pop(l_discount) * count(*), 6) AS s_1_1 FROM lineitem GROUP BY 1""")
def moment_table_q(spark, sf):
    return rounded(moments(Tables(spark, sf).lineitem, ["l_quantity", "l_discount"], ["l_returnflag"]), m_1=8, s_0_0=3, s_0_1=5)


def describe_sql(c, t):
    return f"""SELECT '{c}' AS variable, count({c}) AS count, round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS std, round(min({c})::DOUBLE, 5) AS min,
 round(max({c})::DOUBLE, 5) AS max, round(stddev_samp({c}) / avg({c}), 5) AS cv, round((max({c}) - min({c}))::DOUBLE, 5) AS range, round(skewness({c}), 5) + 0.0 AS skewness,
 round(kurtosis({c}), 5) + 0.0 AS kurtosis, round(quantile_cont({c}::DOUBLE, 0.25), 5) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 5) AS median, round(quantile_cont({c}::DOUBLE, 0.75), 5) AS q75 FROM {t}"""


@query("describe", H + describe_sql("value", "h") + " UNION ALL " + describe_sql("user_id", "h"))
def describe_q(spark, sf):
    return rounded(ds.describe(with_holes(Tables(spark, sf).events), ["value", "user_id"]), 5)


@query("describe_by", """SELECT event_type, 'value' AS variable, count(value) AS count, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS std, round(quantile_cont(value, 0.25), 5) AS q25,
 round(quantile_cont(value, 0.5), 5) AS median, round(quantile_cont(value, 0.75), 5) AS q75, round(skewness(value), 5) AS skewness, round(kurtosis(value), 5) AS kurtosis FROM events GROUP BY 1""")
def describe_by_q(spark, sf):
    return rounded(ds.describe(Tables(spark, sf).events, ["value"], ["event_type"]).drop("min", "max", "cv", "range"), 5)


@query("freq", H + "SELECT event_type AS level, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM h), 6) AS pct FROM h GROUP BY 1")
def freq_q(spark, sf):
    return rounded(ds.frequencies(with_holes(Tables(spark, sf).events), "event_type"))


@query("cat_profile", H + """, c AS (SELECT event_type AS level, count(*) AS n FROM h GROUP BY 1)
SELECT 'event_type' AS variable, count(*) AS n_levels, sum(n)::BIGINT AS n_rows, (SELECT level FROM c WHERE level IS NOT NULL ORDER BY n DESC, level LIMIT 1) AS mode,
 (SELECT level FROM c ORDER BY n DESC, level LIMIT 1) AS dominant, round(100.0::DOUBLE * max(n) / sum(n), 6) AS dominant_pct, 'balanced' AS verdict FROM c""")
def cat_profile_q(spark, sf):
    return rounded(ds.categorical_profile(with_holes(Tables(spark, sf).events), ["event_type"]))


@query("grouped_mean", "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean_l_quantity, round(avg(l_tax), 8) AS mean_l_tax FROM lineitem GROUP BY 1")
def grouped_mean_q(spark, sf):
    return rounded(ds.group_means(Tables(spark, sf).lineitem, ["l_quantity", "l_tax"], ["l_returnflag"]), mean_l_tax=8)


@query("grouped_variance", "SELECT l_suppkey, round(var_samp(l_quantity), 5) AS var_l_quantity FROM lineitem GROUP BY 1")
def grouped_variance_q(spark, sf):
    return rounded(ds.group_variances(Tables(spark, sf).lineitem, ["l_quantity"], ["l_suppkey"]), 5)


@query("group_sizes", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def group_sizes_q(spark, sf):
    return ds.group_sizes(Tables(spark, sf).orders, ["o_custkey"])


@query("profile_signs", """SELECT l_linenumber, CASE WHEN avg(l_quantity) > (SELECT avg(l_quantity) FROM lineitem) THEN '↑' ELSE '↓' END AS sign_l_quantity,
 CASE WHEN avg(l_tax) > (SELECT avg(l_tax) FROM lineitem) THEN '↑' ELSE '↓' END AS sign_l_tax FROM lineitem GROUP BY 1""")
def profile_signs_q(spark, sf):
    return ds.profile_signs(Tables(spark, sf).lineitem, ["l_quantity", "l_tax"], "l_linenumber")


@query("within_var", """WITH g AS (SELECT o_custkey, count(*) AS n, var_samp(o_totalprice) AS v FROM orders GROUP BY 1)
SELECT 'o_totalprice' AS variable, round(w / 1e6, 3) AS mean_group_variance, round(t / 1e6, 3) AS total_variance, round(100 * w / t, 6) AS within_variance_pct FROM
 (SELECT avg(v) AS w FROM g WHERE n > 1), (SELECT var_samp(o_totalprice) AS t FROM orders)""")
def within_var_q(spark, sf):
    df = ds.within_variance(Tables(spark, sf).orders, ["o_totalprice"], "o_custkey")
    df = df.withColumns({c: F.col(c) / 1e6 for c in ("mean_group_variance", "total_variance")})
    return rounded(df, mean_group_variance=3, total_variance=3)


@query("hist30", """WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (SELECT least(floor((value - lo) / (hi - lo) * 30), 29)::INT AS bin, lo, hi FROM events, r)
SELECT 'value' AS variable, bin, round(lo + bin * (hi - lo) / 30, 6) AS lower, round(lo + (bin + 1) * (hi - lo) / 30, 6) AS upper, count(*) AS n FROM b GROUP BY bin, lo, hi""")
def hist30_q(spark, sf):
    return rounded(ds.histogram(Tables(spark, sf).events, ["value"]))


@query("box", """WITH q AS (SELECT event_type, count(*) AS n, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q75 FROM events GROUP BY 1),
 f AS (SELECT *, q25 - 1.5::DOUBLE * (q75 - q25) AS lf, q75 + 1.5::DOUBLE * (q75 - q25) AS uf FROM q)
SELECT event_type, 'value' AS variable, max(n) AS n, round(max(q25), 6) AS q25, round(max(median), 6) AS median, round(max(q75), 6) AS q75, round(max(lf), 6) AS lower_fence, round(max(uf), 6) AS upper_fence,
 min(value) FILTER (value BETWEEN lf AND uf) AS whisker_low, max(value) FILTER (value BETWEEN lf AND uf) AS whisker_high, count(*) FILTER (value < lf OR value > uf) AS n_outliers
FROM events JOIN f USING (event_type) GROUP BY event_type""")
def box_q(spark, sf):
    return rounded(ds.box_summary(Tables(spark, sf).events, ["value"], ["event_type"]))


@query("mean_se", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value) / sqrt(count(value)), 6) AS se FROM events GROUP BY 1")
def mean_se_q(spark, sf):
    return rounded(ds.mean_and_error(Tables(spark, sf).events, "value", ["event_type"]))


@query("cell_means", """SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity) / sqrt(count(*)), 6) AS se FROM lineitem GROUP BY 1, 2""")
def cell_means_q(spark, sf):
    return rounded(ds.cell_means(Tables(spark, sf).lineitem, "l_quantity", ["l_returnflag", "l_linestatus"]))


@query("trend_lines", """SELECT l_returnflag, 'l_quantity' AS x, 'l_extendedprice' AS y, regr_count(l_extendedprice, l_quantity)::BIGINT AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
 round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem GROUP BY 1""")
def trend_lines_q(spark, sf):
    return rounded(ds.trend_lines(Tables(spark, sf).lineitem, [("l_quantity", "l_extendedprice")], ["l_returnflag"]), 4)


# --- contingency ----------------------------------------------------------------

CELLS = """h AS (SELECT coalesce(CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END, 'Valor_Ausente') AS a, CASE WHEN user_id < 50 THEN 'low' WHEN user_id < 100 THEN 'mid' ELSE 'high' END AS b FROM events),
 c AS (SELECT a.a, b.b, (SELECT count(*) FROM h WHERE h.a = a.a AND h.b = b.b) AS o, a.n AS ra, b.n AS cb, (SELECT count(*) FROM h) AS n
  FROM (SELECT a, count(*) AS n FROM h GROUP BY 1) a, (SELECT b, count(*) AS n FROM h GROUP BY 1) b)"""


def two_way(spark, sf):
    u = F.col("user_id")
    return with_holes(Tables(spark, sf).events).select(
        F.col("event_type").alias("kind"), F.when(u < 50, "low").when(u < 100, "mid").otherwise("high").alias("band"))


@query("crosstab", f"WITH {CELLS} SELECT a, b, o AS observed, round(ra * cb::DOUBLE / n, 6) AS expected, ra AS row_total, cb AS col_total, n FROM c")
def crosstab_q(spark, sf):
    return rounded(ct.crosstab(two_way(spark, sf), "kind", "band").drop("n_rows", "n_cols"))


@query("chi2", f"WITH {CELLS} SELECT round(sum((o - ra * cb::DOUBLE / n) ** 2 / (ra * cb::DOUBLE / n)), 6) AS statistic, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof FROM c")
def chi2_q(spark, sf):
    return rounded(ct.chi_square(two_way(spark, sf), "kind", "band").drop("p_value"))


@query("chi2_yates", """WITH c AS (SELECT l_linestatus AS a, l_shipdate < TIMESTAMP '1998-01-01' AS b, count(*) AS o FROM lineitem GROUP BY 1, 2),
 e AS (SELECT *, sum(o) OVER (PARTITION BY a) * sum(o) OVER (PARTITION BY b)::DOUBLE / sum(o) OVER () AS e FROM c)
SELECT round(sum((abs(o - e) - least(0.5, abs(o - e))) ** 2 / e), 6) AS statistic, 1::BIGINT AS dof FROM e""")
def chi2_yates_q(spark, sf):
    df = Tables(spark, sf).lineitem.select("l_linestatus", (F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp")).alias("early"))
    return rounded(ct.chi_square(df, "l_linestatus", "early").drop("p_value"))


@query("std_resid", f"WITH {CELLS} SELECT a, b, o AS observed, round(ra * cb::DOUBLE / n, 6) AS expected, round((o - ra * cb::DOUBLE / n) / sqrt(ra * cb::DOUBLE / n * (1 - ra / n::DOUBLE) * (1 - cb / n::DOUBLE)), 6) + 0.0 AS residual FROM c")
def std_resid_q(spark, sf):
    return rounded(ct.standardized_residuals(two_way(spark, sf), "kind", "band"))


@query("combined_table", f"""WITH {CELLS}, r AS (SELECT a, b, o, ra * cb::DOUBLE / n AS e, (o - ra * cb::DOUBLE / n) / sqrt(ra * cb::DOUBLE / n * (1 - ra / n::DOUBLE) * (1 - cb / n::DOUBLE)) AS z FROM c)
SELECT a, b, 'observed' AS measure, o::DOUBLE AS value FROM r UNION ALL SELECT a, b, 'expected', round(e, 6) FROM r UNION ALL SELECT a, b, 'residual', round(z, 6) + 0.0 FROM r""")
def combined_table_q(spark, sf):
    return rounded(ct.combined_table(two_way(spark, sf), "kind", "band"))


@query("row_pct", H + """SELECT event_type AS a, user_id % 3 || '' AS b, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY event_type), 6) AS share FROM h WHERE event_type IS NOT NULL GROUP BY 1, 2""")
def row_pct_q(spark, sf):
    df = with_holes(Tables(spark, sf).events).select("event_type", (F.col("user_id") % 3).alias("m"))
    return rounded(ct.row_shares(df, "event_type", "m"))


@query("dominance", """WITH s AS (SELECT count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY o_orderpriority) AS share FROM orders GROUP BY o_orderpriority, o_orderstatus)
SELECT round(max(share), 6) AS max_row_share, CASE WHEN max(share) >= 90 THEN 'concentrated' WHEN max(share) < 50 THEN 'balanced' ELSE 'moderate' END AS verdict FROM s""")
def dominance_q(spark, sf):
    return rounded(ct.dominance(Tables(spark, sf).orders, "o_orderpriority", "o_orderstatus"))


# --- joins, ordering, sets ----------------------------------------------------------

@query("write_back", """WITH m AS (SELECT user_id, avg(value) AS m FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT event_id, coalesce(CASE WHEN m.m > 50 THEN 'high' WHEN m.m IS NOT NULL THEN 'low' END, 'Não_Clusterizado') AS label FROM events e LEFT JOIN m ON e.user_id = m.user_id AND e.event_type = 'click'""")
def write_back_q(spark, sf):
    ev = Tables(spark, sf).events
    clicks = ev.where("event_type = 'click'").groupBy("user_id").agg(F.avg("value").alias("m"))
    labels = clicks.select("user_id", F.lit("click").alias("event_type"), F.when(F.col("m") > 50, "high").otherwise("low").alias("label"))
    out = rs.write_back(ev, labels, ["user_id", "event_type"], {"label": rs.NOT_CLUSTERED})
    return out.select("event_id", "label")


@query("level_pairs", "SELECT a.r_name AS a, b.r_name AS b FROM region a JOIN region b ON a.r_name < b.r_name")
def level_pairs_q(spark, sf):
    return rs.value_pairs(Tables(spark, sf).region, "r_name")


@query("dim_table", """WITH d(ord, "Grupo") AS (VALUES (0, 'AUTOMOBILE'), (1, 'MACHINERY'), (2, 'NOT THERE')),
 m AS (SELECT c_mktsegment AS "Grupo", avg(c_acctbal) AS metrica FROM customer GROUP BY 1) SELECT ord, d."Grupo", round(metrica, 6) AS metrica FROM d LEFT JOIN m ON d."Grupo" = m."Grupo" """)
def dim_table_q(spark, sf):
    m = Tables(spark, sf).customer.groupBy(F.col("c_mktsegment").alias("Grupo")).agg(F.avg("c_acctbal").alias("metrica"))
    return rounded(rs.dimension_table(m, ["AUTOMOBILE", "MACHINERY", "NOT THERE"]))


@query("keep_groups", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 12)")
def keep_groups_q(spark, sf):
    return rs.keep_groups(Tables(spark, sf).orders.select("o_orderkey", "o_custkey"), "o_custkey", 12)


@query("stats_join", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) + 1.5::DOUBLE * stddev_samp(o_totalprice) FROM orders)")
def stats_join_q(spark, sf):
    from tabstat.plans.stats import scalar_stats
    df = Tables(spark, sf).orders
    s = scalar_stats(df, [F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("sd")])
    return df.where(F.col("o_totalprice") > s["m"] + 1.5 * s["sd"]).select("o_orderkey")


@query("full_join_groups", """SELECT l_linenumber, max(m) FILTER (l_returnflag = 'A') AS "r_A", max(m) FILTER (l_returnflag = 'N') AS "r_N", max(m) FILTER (l_returnflag = 'R') AS "r_R" FROM
 (SELECT l_linenumber, l_returnflag, max(l_extendedprice) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def full_join_groups_q(spark, sf):
    long = Tables(spark, sf).lineitem.groupBy("l_linenumber", "l_returnflag").agg(F.max("l_extendedprice").alias("m"))
    return rs.spread_groups(long, ["l_linenumber"], "l_returnflag", "m")


@query("full_join", """SELECT user_id, a.n AS clicks, b.n AS errors FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' AND value > 60 GROUP BY 1) a
 FULL JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' AND value > 60 GROUP BY 1) b USING (user_id)""")
def full_join_q(spark, sf):
    ev = Tables(spark, sf).events.where("value > 60")
    a = ev.where("event_type = 'click'").groupBy("user_id").agg(F.count(F.lit(1)).alias("clicks"))
    b = ev.where("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("errors"))
    return rs.join_pairs(a, b, ["user_id"], "full")


@query("top_abs", "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 20")
def top_abs_q(spark, sf):
    return rs.top_rows(Tables(spark, sf).customer.select("c_custkey", "c_acctbal"), "c_acctbal", 20, by_abs=True)


@query("sorted_counts", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand")
def sorted_counts_q(spark, sf):
    return ds.group_sizes(Tables(spark, sf).part, ["p_brand"]).orderBy(F.col("n").desc(), "p_brand")


@query("argmax", "SELECT arg_max(p_type, n) AS p_type, max(n) AS n FROM (SELECT p_type, count(*) AS n FROM part GROUP BY 1)")
def argmax_q(spark, sf):
    return ds.group_sizes(Tables(spark, sf).part, ["p_type"]).agg(F.max_by("p_type", "n").alias("p_type"), F.max("n").alias("n"))


@query("append_tables", "SELECT 'orders' AS source, count(*) AS n, NULL::DOUBLE AS mean FROM orders UNION ALL SELECT 'parts', count(*), round(avg(p_size), 6) FROM part")
def append_tables_q(spark, sf):
    t = Tables(spark, sf)
    a = t.orders.agg(F.lit("orders").alias("source"), F.count(F.lit(1)).alias("n"))
    b = t.part.agg(F.lit("parts").alias("source"), F.count(F.lit(1)).alias("n"), F.avg("p_size").alias("mean"))
    return rounded(rs.append_tables([a, b]))


@query("set_operations", """SELECT k, 'both' AS part FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)
 UNION ALL SELECT k, 'customers only' FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey > 5)""")
def set_operations_q(spark, sf):
    t = Tables(spark, sf)
    c, s = t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))
    both = c.intersect(s).withColumn("part", F.lit("both"))
    return both.unionByName(c.distinct().exceptAll(s.where("k > 5").distinct()).withColumn("part", F.lit("customers only")))
