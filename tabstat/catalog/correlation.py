"""Correlations (R rows)."""

from pyspark.sql import functions as F

from tabstat.catalog.registry import HOLES_SQL, Tables, query, rounded, with_holes
from tabstat.operators import correlation as cr

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PAIRS = [(a, b) for i, a in enumerate(NUM) for b in NUM[i + 1:]]
H = f"WITH h AS ({HOLES_SQL}) "


def each_pair(body: str) -> str:
    return " UNION ALL ".join(body.format(a=a, b=b) for a, b in PAIRS)


@query("pearson_pairs", each_pair("SELECT '{a}' AS var1, '{b}' AS var2, regr_count({a}, {b})::BIGINT AS n, round(corr({a}, {b}), 8) + 0.0 AS r FROM lineitem"))
def pearson_pairs_q(spark, sf):
    return rounded(cr.correlate(Tables(spark, sf).lineitem, NUM), 8)


@query("pearson_pairwise", H + """SELECT 'value' AS var1, 'other' AS var2, regr_count(value, other)::BIGINT AS n, round(corr(value, other), 8) + 0.0 AS r FROM
 (SELECT value, CASE WHEN event_id % 4 <> 0 THEN user_id::DOUBLE END AS other FROM h)""")
def pearson_pairwise_q(spark, sf):
    df = with_holes(Tables(spark, sf).events).withColumn("other", F.when(F.col("event_id") % 4 != 0, F.col("user_id").cast("double")))
    return rounded(cr.correlate(df, ["value", "other"]), 8)


AVG_RANK = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE"


@query("spearman_pairs", each_pair(
    "SELECT '{a}' AS var1, '{b}' AS var2, count(*) AS n, round(corr(x, y), 8) + 0.0 AS r FROM (SELECT "
    + AVG_RANK.format(c="{a}") + " AS x, " + AVG_RANK.format(c="{b}") + " AS y FROM lineitem)"))
def spearman_pairs_q(spark, sf):
    return rounded(cr.correlate(Tables(spark, sf).lineitem, NUM, "spearman"), 8)


@query("spearman_pairwise", H + ", p AS (SELECT value, user_id AS other FROM h WHERE value IS NOT NULL AND event_id % 4 <> 0) SELECT 'value' AS var1, 'other' AS var2, count(*) AS n, round(corr(x, y), 8) + 0.0 AS r FROM (SELECT "
       + AVG_RANK.format(c="value") + " AS x, " + AVG_RANK.format(c="other") + " AS y FROM p)")
def spearman_pairwise_q(spark, sf):
    df = with_holes(Tables(spark, sf).events).withColumn("other", F.when(F.col("event_id") % 4 != 0, F.col("user_id").cast("double")))
    return rounded(cr.correlate(df, ["value", "other"], "spearman"), 8)


@query("pair_table", each_pair(
    "SELECT '{a}' AS var1, '{b}' AS var2, round(corr({a}, {b}), 8) + 0.0 AS pearson, round(corr(x, y), 8) + 0.0 AS spearman FROM (SELECT {a}, {b}, "
    + AVG_RANK.format(c="{a}") + " AS x, " + AVG_RANK.format(c="{b}") + " AS y FROM lineitem)"))
def pair_table_q(spark, sf):
    return rounded(cr.pair_table(Tables(spark, sf).lineitem, NUM), 8)


@query("total_corr", "SELECT 'l_quantity' AS var1, 'l_extendedprice' AS var2, n, round(r, 8) AS r, round(r * sqrt(n - 2) / sqrt(1 - r * r), 4) AS t FROM (SELECT count(*) AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem)")
def total_corr_q(spark, sf):
    return rounded(cr.total_correlation(Tables(spark, sf).lineitem, "l_quantity", "l_extendedprice", ["l_tax"]).drop("p_value"), 8, t=4)


@query("partial_corr", """SELECT 'l_quantity' AS var1, 'l_tax' AS var2, 'l_extendedprice' AS given, n, round(p, 8) + 0.0 AS r, round(p * sqrt(n - 3) / sqrt(1 - p * p), 5) + 0.0 AS t FROM
 (SELECT n, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS p FROM (SELECT count(*) AS n, corr(l_quantity, l_tax) AS xy, corr(l_quantity, l_extendedprice) AS xz, corr(l_tax, l_extendedprice) AS yz FROM lineitem))""")
def partial_corr_q(spark, sf):
    return rounded(cr.partial_correlation(Tables(spark, sf).lineitem, "l_quantity", "l_tax", ["l_extendedprice"]).drop("p_value"), 8, t=5)


@query("group_corr", "SELECT l_returnflag, 'l_quantity' AS var1, 'l_extendedprice' AS var2, count(*) AS n, round(corr(l_quantity, l_extendedprice), 8) AS r FROM lineitem GROUP BY 1")
def group_corr_q(spark, sf):
    return rounded(cr.correlate(Tables(spark, sf).lineitem, ["l_quantity", "l_extendedprice"], by=["l_returnflag"]), 8)


@query("group_corr_wide", """SELECT 'l_quantity' AS var1, 'l_tax' AS var2, round(corr(l_quantity, l_tax) FILTER (l_returnflag = 'A'), 8) + 0.0 AS "r_A",
 round(corr(l_quantity, l_tax) FILTER (l_returnflag = 'N'), 8) + 0.0 AS "r_N", round(corr(l_quantity, l_tax) FILTER (l_returnflag = 'R'), 8) + 0.0 AS "r_R" FROM lineitem""")
def group_corr_wide_q(spark, sf):
    return rounded(cr.correlate_wide(Tables(spark, sf).lineitem, ["l_quantity", "l_tax"], "l_returnflag"), 8)


@query("group_spearman", "WITH r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0::DOUBLE AS x, "
       "rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2.0::DOUBLE AS y FROM events) "
       "SELECT event_type, 'value' AS var1, 'user_id' AS var2, count(*) AS n, round(corr(x, y), 8) + 0.0 AS r FROM r GROUP BY 1")
def group_spearman_q(spark, sf):
    return rounded(cr.correlate(Tables(spark, sf).events, ["value", "user_id"], "spearman", ["event_type"]), 8)


@query("fisher_z", """WITH g AS (SELECT l_returnflag AS g, count(*) AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem GROUP BY 1)
SELECT 'l_quantity' AS var1, 'l_extendedprice' AS var2, a.g AS group1, b.g AS group2, a.n AS n1, b.n AS n2, round(a.r, 8) AS r1, round(b.r, 8) AS r2,
 round((atanh(a.r) - atanh(b.r)) / sqrt(1 / (a.n - 3) + 1 / (b.n - 3)), 6) + 0.0 AS z FROM g a JOIN g b ON a.g < b.g""")
def fisher_z_q(spark, sf):
    df = cr.compare_correlations(Tables(spark, sf).lineitem, "l_returnflag", ["l_quantity", "l_extendedprice"])
    return rounded(df.drop("p_value", "verdict"), z=6, r1=8, r2=8)


@query("rank_correlates", """SELECT * FROM (SELECT 'l_quantity' AS variable, round(corr(l_quantity, l_extendedprice), 8) + 0.0 AS r FROM lineitem UNION ALL SELECT 'l_discount', round(corr(l_discount, l_extendedprice), 8) + 0.0 FROM lineitem
 UNION ALL SELECT 'l_tax', round(corr(l_tax, l_extendedprice), 8) + 0.0 FROM lineitem) ORDER BY abs(r) DESC""")
def rank_correlates_q(spark, sf):
    return rounded(cr.rank_correlates(Tables(spark, sf).lineitem, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]), 8)


WIDE = [f"d{i}" for i in range(30)]
WIDE_SQL = "WITH v AS (SELECT " + ", ".join(f"CASE WHEN (vec_id + {i}) % 11 = 0 THEN NULL ELSE embedding[{i + 1}]::DOUBLE END AS d{i}" for i in range(30)) + " FROM embeddings) " + \
    " UNION ALL ".join(f"SELECT 'd{i}' AS var1, 'd{j}' AS var2, regr_count(d{i}, d{j})::BIGINT AS n, round(corr(d{i}, d{j}), 8) + 0.0 AS r FROM v" for i in range(30) for j in range(i + 1, 30))


@query("pearson_wide", WIDE_SQL)
def pearson_wide_q(spark, sf):
    e = Tables(spark, sf).embeddings
    df = e.select(*[F.when((F.col("vec_id") + i) % 11 != 0, F.get("embedding", i).cast("double")).alias(f"d{i}") for i in range(30)])
    return rounded(cr.correlate(df, WIDE), 8)
