"""Multilevel and Bayesian models (V and B rows)."""

from pyspark.sql import functions as F

from tabstat.catalog.registry import Tables, query, rounded
from tabstat.operators import bayes as by
from tabstat.operators import multilevel as ml
from tabstat.operators.reshape import DIMENSIONS

DIMS = {DIMENSIONS[0]: ["o_totalprice", "o_month"], DIMENSIONS[1]: ["o_status"]}


def nested_orders(spark, sf):
    """Orders in customers in nations, with an outcome that has effects at both levels."""
    t = Tables(spark, sf)
    c = t.customer.select("c_custkey", "c_nationkey", "c_acctbal")
    o = t.orders.select("o_orderkey", "o_custkey", (F.col("o_totalprice") / 1e5).alias("price"), F.month("o_orderdate").alias("month"))
    df = o.join(c, o.o_custkey == c.c_custkey)
    y = F.col("price") + F.col("c_acctbal") / 4000 + F.sin(F.col("c_nationkey").cast("double")) * 1.5 + F.col("month") * 0.1 * (1 + F.col("c_acctbal") / 9000)
    return df.select("o_orderkey", "o_custkey", "c_nationkey", "month", y.alias("y"))


@query("mlm_checks", """WITH g AS (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS my, var_samp(month(o_orderdate)) AS v, avg(month(o_orderdate)) AS m FROM orders GROUP BY 1)
SELECT 'groups' AS "check", NULL AS variable, count(*)::DOUBLE AS value, count(*) >= 5 AS ok FROM g UNION ALL SELECT 'smallest group', NULL, min(n)::DOUBLE, min(n) >= 5 FROM g
UNION ALL SELECT 'within variance', 'month', round(min(v), 6), min(v) >= 1e-5 FROM g UNION ALL SELECT 'mean correlation', 'month', round(corr(my, m), 6), abs(corr(my, m)) <= 0.9 FROM g""")
def mlm_checks_q(spark, sf):
    df = Tables(spark, sf).orders.withColumn("month", F.month("o_orderdate"))
    return rounded(ml.multilevel_checks(df, "o_totalprice", "o_custkey", ["month"]))


@query("mlm_ri")
def mlm_ri_q(spark, sf):
    return ml.mixed(nested_orders(spark, sf), "y", ["month"], "o_custkey").components


# the same likelihood on a fine grid of ratios; the fit is compared to three digits
RI = """WITH d AS (SELECT o_custkey AS g, o_totalprice / 1e5 + c_acctbal / 4000 AS y, month(o_orderdate)::DOUBLE AS x FROM orders JOIN customer ON o_custkey = c_custkey),
 c AS (SELECT g, y - (SELECT avg(y) FROM d) AS y, x - (SELECT avg(x) FROM d) AS x FROM d),
 m AS (SELECT g, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS sxx, covar_pop(x, y) * count(*) AS sxy, var_pop(y) * count(*) AS syy FROM c GROUP BY 1),
 l AS (SELECT 0.2::DOUBLE + i * 0.0004::DOUBLE AS l FROM range(5000) t(i)),
 a AS (SELECT l, sum(n) AS n, sum(ln(1 + n * l)) AS ld, sum(n / (1 + n * l)) AS w, sum(n / (1 + n * l) * mx) AS wx, sum(n / (1 + n * l) * my) AS wy, sum(sxx + n / (1 + n * l) * mx * mx) AS xx,
  sum(sxy + n / (1 + n * l) * mx * my) AS xy, sum(syy + n / (1 + n * l) * my * my) AS yy FROM m, l GROUP BY 1),
 b AS (SELECT *, w * xx - wx * wx AS det, (xx * wy - wx * xy) / (w * xx - wx * wx) AS b0, (w * xy - wx * wy) / (w * xx - wx * wx) AS b1 FROM a),
 r AS (SELECT *, yy - b0 * wy - b1 * xy AS rss FROM b), s AS (SELECT *, -0.5 * ((n - 2) * ln(rss / (n - 2)) + ld + ln(det)) AS reml FROM r), t AS (SELECT * FROM s ORDER BY reml DESC LIMIT 1)
SELECT 'group' AS component, round(l * rss / (n - 2), 2) AS variance, round(l / (1 + l), 3) AS icc FROM t UNION ALL SELECT 'residual', round(rss / (n - 2), 2), round(1 / (1 + l), 3) FROM t"""


@query("mlm_ri_exact", RI)
def mlm_ri_exact_q(spark, sf):
    t = Tables(spark, sf)
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    df = o.select("o_custkey", (F.col("o_totalprice") / 1e5 + F.col("c_acctbal") / 4000).alias("y"), F.month("o_orderdate").alias("x"))
    return rounded(ml.mixed(df, "y", ["x"], "o_custkey").components, 2, icc=3)


@query("mlm_fixed")
def mlm_fixed_q(spark, sf):
    return ml.mixed(nested_orders(spark, sf), "y", ["month"], "o_custkey").fixed


@query("mlm_random_effects")
def mlm_random_q(spark, sf):
    return ml.mixed(nested_orders(spark, sf), "y", ["month"], "c_nationkey").random()


@query("mlm_slopes")
def mlm_slopes_q(spark, sf):
    return ml.mixed_slopes(nested_orders(spark, sf), "y", ["month"], "o_custkey", ["month"]).components


@query("mlm_nested")
def mlm_nested_q(spark, sf):
    return ml.nested(nested_orders(spark, sf), "y", ["month"], "o_custkey", "c_nationkey").components


@query("two_factor")
def two_factor_q(spark, sf):
    return ml.two_factor_components(nested_orders(spark, sf), "y", ["month"], "c_nationkey", "month").components


@query("mlm_compare")
def mlm_compare_q(spark, sf):
    df = nested_orders(spark, sf)
    return ml.compare_levels(ml.mixed(df, "y", ["month"], "o_custkey"), ml.nested(df, "y", ["month"], "o_custkey", "c_nationkey"))


@query("icc_table")
def icc_table_q(spark, sf):
    return ml.icc_table(ml.mixed(nested_orders(spark, sf), "y", ["month"], "o_custkey"), DIMS)


@query("pseudo_r2", """SELECT d AS "Grupo", v AS "Variável", round(r, 8) AS metrica FROM (VALUES ('Trocas materiais', 'o_totalprice'), ('Trocas materiais', 'o_month'), ('Subjetividades', 'o_status')) t(d, v),
 (SELECT 1 - sum((l_extendedprice - l_quantity * 1400) ** 2) / (var_pop(l_extendedprice) * count(*)) AS r FROM lineitem)""")
def pseudo_r2_q(spark, sf):
    df = Tables(spark, sf).lineitem.withColumn("p", F.col("l_quantity") * 1400)
    return rounded(ml.pseudo_r2_table(df, "l_extendedprice", "p", DIMS), 8)


@query("mlm_predict")
def mlm_predict_q(spark, sf):
    df = nested_orders(spark, sf)
    return ml.mixed(df, "y", ["month"], "o_custkey").score(df).select("o_orderkey", "prediction")


# --- Bayesian ---------------------------------------------------------------------

@query("bayes_two_group", """WITH g AS (SELECT row_number() OVER (ORDER BY l_linestatus) AS j, count(*) AS n, avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem GROUP BY l_linestatus),
 u AS (SELECT i, -1 + 2 * i / 400.0::DOUBLE AS u FROM range(401) t(i)), x AS (SELECT j, n, m, s, s * exp(u * 8.0::DOUBLE / sqrt(2.0::DOUBLE * n) * (1 + 6.0::DOUBLE / n)) AS sg FROM g, u),
 v AS (SELECT *, 1 / (n / (sg * sg) + 1 / (4 * s * s)) AS v FROM x), l AS (SELECT *, -n * ln(sg) - n * s * s / (2 * sg * sg) + 0.5 * ln(v) - sg * sg / (8 * s * s) + ln(sg) AS l FROM v),
 w AS (SELECT *, exp(l - max(l) OVER (PARTITION BY j)) AS w FROM l), p AS (SELECT j, max(m) AS m, sum(w * v) / sum(w) AS vm, sum(w * sg) / sum(w) AS sm, sqrt(sum(w * sg * sg) / sum(w) - (sum(w * sg) / sum(w)) ** 2) AS ss FROM w GROUP BY 1)
SELECT 'mu' || j AS param, round(m, 6) AS mean, round(sqrt(vm), 6) AS sd FROM p UNION ALL SELECT 'sigma' || j, round(sm, 6), round(ss, 5) FROM p
UNION ALL SELECT 'diff', round(a.m - b.m, 6), round(sqrt(a.vm + b.vm), 6) FROM p a JOIN p b ON a.j = 1 AND b.j = 2""")
def bayes_two_group_q(spark, sf):
    out = by.bayes_two_group(Tables(spark, sf).lineitem, "l_quantity", "l_linestatus").select("param", "mean", "sd")
    return rounded(out).withColumn("sd", F.when(F.col("param").startswith("sigma"), F.round("sd", 5)).otherwise(F.col("sd")))


@query("bayes_linear_one", """WITH m AS (SELECT count(*) AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem), u AS (SELECT -1 + 2 * i / 400.0::DOUBLE AS u FROM range(401) t(i)),
 x AS (SELECT n, r, sqrt(1 - r * r) * exp(u * 8.0::DOUBLE / sqrt(2.0::DOUBLE * (n - 1)) * (1 + 6.0::DOUBLE / (n - 1))) AS s FROM m, u), a AS (SELECT *, n / (s * s) + 1 AS a, n * r / (s * s) AS b FROM x),
 l AS (SELECT *, -n * ln(s) - n / (2 * s * s) + 0.5 * b * b / a - 0.5 * ln(a) - 0.5 * ln(n / (s * s) + 1) - ln(1 + s * s) + ln(s) AS l FROM a), w AS (SELECT *, exp(l - max(l) OVER ()) AS w FROM l),
 p AS (SELECT sum(w * b / a) / sum(w) AS bm, sum(w * (1 / a + (b / a) ** 2)) / sum(w) AS b2, sum(w / (n / (s * s) + 1)) / sum(w) AS iv, sum(w * s) / sum(w) AS sm, sum(w * s * s) / sum(w) AS s2 FROM w)
SELECT 'beta[l_quantity]' AS param, round(bm, 6) AS mean, round(sqrt(b2 - bm * bm), 6) AS sd FROM p UNION ALL SELECT 'intercept', 0.0::DOUBLE, round(sqrt(iv), 6) FROM p
UNION ALL SELECT 'sigma', round(sm, 6), round(sqrt(s2 - sm * sm), 6) FROM p""")
def bayes_linear_one_q(spark, sf):
    return rounded(by.bayes_linear(Tables(spark, sf).lineitem, "l_extendedprice", ["l_quantity"]).select("param", "mean", "sd"))


@query("bayes_linear")
def bayes_linear_q(spark, sf):
    return by.bayes_linear(Tables(spark, sf).lineitem, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])


@query("bayes_one_way")
def bayes_one_way_q(spark, sf):
    return by.bayes_one_way(Tables(spark, sf).lineitem, "l_quantity", "l_returnflag")


@query("bayes_two_factor")
def bayes_two_factor_q(spark, sf):
    return by.bayes_two_factor(Tables(spark, sf).lineitem, "l_quantity", "l_returnflag", "l_linestatus")


# a draws table made of event values: three parameters, four chains
DRAWS = """d AS (SELECT (event_id // 3) % 4 AS chain, (event_id // 3) // 4 AS draw, 'p' || event_id % 3 AS param, value - 50 + 4 * (event_id % 3) AS value FROM events)"""


def draws(spark, sf):
    i = F.floor(F.col("event_id") / 3)
    return Tables(spark, sf).events.select(
        (i % 4).alias("chain"), F.floor(i / 4).alias("draw"), F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string")).alias("param"),
        (F.col("value") - 50 + 4 * (F.col("event_id") % 3)).alias("value"))


@query("post_summary", f"""WITH {DRAWS}, r AS (SELECT param, value, row_number() OVER (PARTITION BY param ORDER BY value) AS i, count(*) OVER (PARTITION BY param) AS n FROM d),
 w AS (SELECT a.param, a.value AS lo, b.value AS hi FROM r a JOIN r b ON a.param = b.param AND b.i = a.i + floor(0.94::DOUBLE * a.n)), h AS (SELECT param, lo, hi, row_number() OVER (PARTITION BY param ORDER BY hi - lo, lo) AS k FROM w)
SELECT d.param, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(max(lo), 6) AS hdi_low, round(max(hi), 6) AS hdi_high FROM d JOIN h ON d.param = h.param AND k = 1 GROUP BY 1""")
def post_summary_q(spark, sf):
    return rounded(by.posterior_summary(draws(spark, sf)))


@query("direction_odds", f"WITH {DRAWS} SELECT param, round((avg((value > 0)::INT) + 1e-6) / (avg((value < 0)::INT) + 1e-6), 8) AS odds FROM d GROUP BY 1")
def direction_odds_q(spark, sf):
    return rounded(by.direction_odds(draws(spark, sf)), 8)


@query("rope", f"""WITH {DRAWS}, s AS (SELECT 0.1::DOUBLE * stddev_samp(value) AS s FROM events)
SELECT param, round(avg((value BETWEEN -s AND s)::INT), 8) AS inside, CASE WHEN avg((value BETWEEN -s AND s)::INT) > 0.95 THEN 'irrelevant' WHEN avg((value BETWEEN -s AND s)::INT) < 0.05 THEN 'relevant' ELSE 'uncertain' END AS verdict FROM d, s GROUP BY 1""")
def rope_q(spark, sf):
    return rounded(by.rope_of_column(draws(spark, sf), Tables(spark, sf).events, "value"), 8)


@query("pair_diff", f"""WITH {DRAWS}, x AS (SELECT a.param AS param1, b.param AS param2, a.value - b.value AS v FROM d a JOIN d b ON a.chain = b.chain AND a.draw = b.draw AND a.param < b.param),
 s AS (SELECT param1, param2, avg(v) AS mean, stddev_pop(v) AS sd, (avg((v > 0)::INT) + 1e-6) / (avg((v < 0)::INT) + 1e-6) AS odds FROM x GROUP BY 1, 2)
SELECT param1, param2, round(max(mean), 6) + 0.0 AS mean, round(max(sd), 6) AS sd, round(max(odds), 8) AS odds, round(avg((abs(v) <= 0.1::DOUBLE * sd)::INT), 8) AS inside,
 CASE WHEN avg((abs(v) <= 0.1::DOUBLE * sd)::INT) > 0.95 THEN 'irrelevant' WHEN avg((abs(v) <= 0.1::DOUBLE * sd)::INT) < 0.05 THEN 'relevant' ELSE 'uncertain' END AS verdict FROM x JOIN s USING (param1, param2) GROUP BY 1, 2""")
def pair_diff_q(spark, sf):
    return rounded(by.pair_differences(draws(spark, sf)), odds=8, inside=8)
