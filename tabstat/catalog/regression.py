"""Regression and path models (L rows)."""

from pyspark.sql import functions as F

from tabstat.catalog.registry import Tables, query, rounded
from tabstat.operators import linear as ln
from tabstat.operators import paths as pa

Y, XS = "l_extendedprice", ["l_quantity", "l_discount"]
# closed form for two predictors
TWO_X = """m AS (SELECT count(*) AS n, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my, regr_sxx(l_quantity, l_quantity) AS s11, regr_sxx(l_discount, l_discount) AS s22,
 covar_pop(l_quantity, l_discount) * count(*) AS s12, covar_pop(l_quantity, l_extendedprice) * count(*) AS s1y, covar_pop(l_discount, l_extendedprice) * count(*) AS s2y, var_pop(l_extendedprice) * count(*) AS syy FROM lineitem),
 b AS (SELECT *, s11 * s22 - s12 * s12 AS det, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM m),
 e AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, syy - b1 * s1y - b2 * s2y AS ssr, (syy - b1 * s1y - b2 * s2y) / (n - 3) AS s2 FROM b)"""


@query("ols", f"""WITH {TWO_X} SELECT 'const' AS variable, round(b0, 4) AS coef, round(sqrt(s2 * (1 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / det)), 5) AS se, n - 3 AS dof FROM e
UNION ALL SELECT 'l_quantity', round(b1, 4), round(sqrt(s2 * s22 / det), 5), n - 3 FROM e UNION ALL SELECT 'l_discount', round(b2, 4), round(sqrt(s2 * s11 / det), 5), n - 3 FROM e""")
def ols_q(spark, sf):
    return rounded(ln.ols(Tables(spark, sf).lineitem, Y, XS).table.select("variable", "coef", "se", "dof"), se=5, coef=4)


@query("ols_fit", f"""WITH {TWO_X} SELECT n, 2::BIGINT AS df_model, n - 3 AS df_resid, round(1 - ssr / syy, 8) AS r2, round(1 - ssr / syy * (n - 1) / (n - 3), 8) AS adj_r2, round((syy - ssr) / 2 / s2, 3) AS f,
 round(-n / 2 * (ln(2 * pi()) + ln(ssr / n) + 1), 3) AS loglik, round(n * (ln(2 * pi()) + ln(ssr / n) + 1) + 6, 3) AS aic, round(n * (ln(2 * pi()) + ln(ssr / n) + 1) + 3 * ln(n), 3) AS bic FROM e""")
def ols_fit_q(spark, sf):
    return rounded(ln.ols(Tables(spark, sf).lineitem, Y, XS).fit.drop("p_value", "sigma2"), 8, f=3, loglik=3, aic=3, bic=3)


@query("std_beta", f"WITH {TWO_X} SELECT 'l_quantity' AS variable, round(b1 * sqrt(s11 / syy), 8) AS beta FROM e UNION ALL SELECT 'l_discount', round(b2 * sqrt(s22 / syy), 8) + 0.0 FROM e")
def std_beta_q(spark, sf):
    return rounded(ln.standardized_betas(ln.ols(Tables(spark, sf).lineitem, Y, XS)), 8)


@query("fitted_residuals", f"WITH {TWO_X} SELECT l_linenumber, count(*) AS n, round(avg(b0 + b1 * l_quantity + b2 * l_discount), 3) AS prediction, round(avg(l_extendedprice - b0 - b1 * l_quantity - b2 * l_discount), 3) + 0.0 AS residual FROM lineitem, e GROUP BY 1")
def fitted_q(spark, sf):
    df = Tables(spark, sf).lineitem
    out = ln.ols(df, Y, XS).score(df).groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("prediction"), F.avg("residual").alias("residual"))
    return rounded(out, 3)


@query("fit_metrics", """SELECT count(*) AS n, round(1 - avg((y - p) ** 2) / var_pop(y), 8) AS r2, round(avg((y - p) ** 2), 2) AS mse, round(sqrt(avg((y - p) ** 2)), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae
 FROM (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)""")
def fit_metrics_q(spark, sf):
    df = Tables(spark, sf).lineitem.withColumn("p", F.col("l_quantity") * 1500)
    return rounded(ln.fit_metrics(df, Y, "p"), 4, r2=8, mse=2)


@query("vif", f"""WITH {TWO_X} SELECT 'const' AS variable, round(1 + n * (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / det, 6) AS vif FROM e
UNION ALL SELECT 'l_quantity', round(s11 * s22 / det, 6) FROM e UNION ALL SELECT 'l_discount', round(s11 * s22 / det, 6) FROM e""")
def vif_q(spark, sf):
    return rounded(ln.vif(Tables(spark, sf).lineitem, XS))


COOK = """WITH s AS (SELECT count(*) AS n, avg(p_size) AS mx, regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a, regr_sxx(p_retailprice, p_size) AS sxx FROM part),
 r AS (SELECT p_partkey, p_retailprice - a - b * p_size AS e, 1 / n + (p_size - mx) ** 2 / sxx AS h, n FROM part, s), v AS (SELECT sum(e * e) / (max(n) - 2) AS s2 FROM r)"""


@query("cooks", COOK + " SELECT p_partkey, round(h, 8) AS leverage, round(e * e / (2 * s2) * h / (1 - h) ** 2, 8) AS cooks_distance, e * e / (2 * s2) * h / (1 - h) ** 2 > 4 / n AS influential FROM r, v")
def cooks_q(spark, sf):
    df = ln.influence(Tables(spark, sf).part, "p_retailprice", ["p_size"])
    return rounded(df.select("p_partkey", "leverage", "cooks_distance", "influential"), 8)


@query("simple_reg", """SELECT 'l_quantity' AS variable, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(corr(l_extendedprice, l_quantity), 8) AS r, NULL::VARCHAR AS note FROM lineitem
UNION ALL SELECT 'l_tax', count(*), round(regr_slope(l_extendedprice, l_tax), 4), round(regr_intercept(l_extendedprice, l_tax), 4), round(corr(l_extendedprice, l_tax), 8) + 0.0, NULL FROM lineitem
UNION ALL SELECT 'flat', count(*), NULL, NULL, NULL, 'zero variance' FROM lineitem""")
def simple_reg_q(spark, sf):
    df = Tables(spark, sf).lineitem.withColumn("flat", F.lit(1.0))
    return rounded(ln.simple_regressions(df, Y, ["l_quantity", "l_tax", "flat"]), 4, r=8)


KF = """WITH d AS (SELECT o_orderkey % 5 AS fold, o_custkey::DOUBLE AS x, o_totalprice AS y FROM orders),
 c AS (SELECT f.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM d, (SELECT DISTINCT fold FROM d) f WHERE d.fold <> f.fold GROUP BY 1)
SELECT d.fold::INT AS fold, count(*) AS n, round(1 - avg((y - a - b * x) ** 2) / var_pop(y), 8) + 0.0 AS r2, round(avg((y - a - b * x) ** 2) / 1e6, 3) AS mse, round(avg(abs(y - a - b * x)), 3) AS mae FROM d JOIN c USING (fold) GROUP BY 1"""


@query("kfold_ols", KF)
def kfold_q(spark, sf):
    df = ln.kfold_ols(Tables(spark, sf).orders, "o_totalprice", ["o_custkey"], 5, "o_orderkey")
    return rounded(df.withColumn("mse", F.col("mse") / 1e6), 3, r2=8)


@query("kfold_summary", f"SELECT round(avg(r2), 7) + 0.0 AS mean, round(stddev_pop(r2), 7) AS sd, count(*) AS folds FROM ({KF})")
def kfold_summary_q(spark, sf):
    return rounded(ln.validation_summary(ln.kfold_ols(Tables(spark, sf).orders, "o_totalprice", ["o_custkey"], 5, "o_orderkey")), 7)


EDGES = [("l_quantity", "l_extendedprice"), ("l_quantity", "charge"), ("l_extendedprice", "charge"), ("l_discount", "charge")]
CHARGE = "(SELECT *, l_extendedprice * (1 + l_tax) AS charge FROM lineitem)"


def with_charge(spark, sf):
    return Tables(spark, sf).lineitem.withColumn("charge", F.col("l_extendedprice") * (1 + F.col("l_tax")))


PATHS = f"""d AS {CHARGE}, m AS (SELECT count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS qp, regr_slope(l_tax, l_quantity) AS z FROM d),
 k AS (SELECT avg(l_quantity) AS ma, avg(l_extendedprice) AS mb, avg(l_discount) AS mc, avg(charge) AS my FROM d),
 s AS (SELECT covar_pop(l_quantity, l_quantity) AS aa, covar_pop(l_quantity, l_extendedprice) AS ab, covar_pop(l_quantity, l_discount) AS ac, covar_pop(l_extendedprice, l_extendedprice) AS bb,
  covar_pop(l_extendedprice, l_discount) AS bc, covar_pop(l_discount, l_discount) AS cc, covar_pop(l_quantity, charge) AS ay, covar_pop(l_extendedprice, charge) AS by_, covar_pop(l_discount, charge) AS cy FROM d),
 t AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM s),
 p AS (SELECT 'l_quantity' AS src, 'l_extendedprice' AS dst, qp AS beta FROM m
  UNION ALL SELECT 'l_quantity', 'charge', (ay * (bb * cc - bc * bc) - ab * (by_ * cc - bc * cy) + ac * (by_ * bc - bb * cy)) / det FROM t
  UNION ALL SELECT 'l_extendedprice', 'charge', (aa * (by_ * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - by_ * ac)) / det FROM t
  UNION ALL SELECT 'l_discount', 'charge', (aa * (bb * cy - by_ * bc) - ab * (ab * cy - by_ * ac) + ay * (ab * bc - bb * ac)) / det FROM t)"""


@query("paths", f"WITH {PATHS} SELECT src, dst, (SELECT n FROM m) AS n, round(beta, 4) + 0.0 AS beta FROM p")
def paths_q(spark, sf):
    return rounded(pa.path_model(with_charge(spark, sf), EDGES).select("src", "dst", "n", "beta"), 4)


@query("mediation", f"""WITH {PATHS} SELECT a.src, a.dst AS mediator, b.dst, round(a.beta * b.beta, 3) AS indirect, round(coalesce(d.beta, 0), 3) + 0.0 AS direct, round(a.beta * b.beta + coalesce(d.beta, 0), 3) AS total
 FROM p a JOIN p b ON a.dst = b.src LEFT JOIN p d ON d.src = a.src AND d.dst = b.dst WHERE a.src <> b.dst""")
def mediation_q(spark, sf):
    return rounded(pa.path_effects(pa.path_model(with_charge(spark, sf), EDGES)), 3)


# routes between nations: customers of one nation buying from suppliers of another
ROUTES = """r AS (SELECT DISTINCT c.c_nationkey AS src, s.s_nationkey AS dst FROM lineitem JOIN orders o ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier s ON l_suppkey = s_suppkey
 WHERE l_quantity > 49 AND l_discount > 0.095 AND l_tax > 0.07)"""


def routes(spark, sf):
    t = Tables(spark, sf)
    li = t.lineitem.where("l_quantity > 49 AND l_discount > 0.095 AND l_tax > 0.07")
    return (li.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .select(F.col("c_nationkey").cast("string").alias("src"), F.col("s_nationkey").cast("string").alias("dst")).distinct())


@query("mediations", f"WITH {ROUTES} SELECT a.src::VARCHAR AS src, a.dst::VARCHAR AS mediator, b.dst::VARCHAR AS dst FROM r a JOIN r b ON a.dst = b.src WHERE a.src <> b.dst")
def mediations_q(spark, sf):
    return pa.mediations(routes(spark, sf))


@query("variable_roles", f"""WITH {ROUTES}, s AS (SELECT DISTINCT src AS v FROM r), d AS (SELECT DISTINCT dst AS v FROM r)
SELECT v::VARCHAR AS variable, 'exogenous' AS role FROM (SELECT v FROM s EXCEPT SELECT v FROM d) UNION ALL SELECT v::VARCHAR, 'mediator' FROM (SELECT v FROM s INTERSECT SELECT v FROM d)
 UNION ALL SELECT v::VARCHAR, 'endogenous' FROM (SELECT v FROM d EXCEPT SELECT v FROM s)""")
def variable_roles_q(spark, sf):
    return pa.variable_roles(routes(spark, sf))
