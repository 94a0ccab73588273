"""Chain diagnostics, tree attributions, Ward linkage, crossed effects and Shapiro-Wilk."""

from pyspark.sql import functions as F

from tabstat.catalog.models import DRAWS, draws
from tabstat.catalog.registry import Tables, query, rounded
from tabstat.functions.normal_scores import normal_quantile_sql
from tabstat.operators import chains as ch
from tabstat.operators import crossed as cr
from tabstat.operators import linear as ln
from tabstat.operators import linkage as lk
from tabstat.operators import normality as nm
from tabstat.operators import supervised as sv
from tabstat.operators import trees as tr

# halves of chains, average ranks, normal scores
HALVES = f"""{DRAWS}, l AS (SELECT param, chain, min(draw) AS start, count(*) AS n FROM d GROUP BY 1, 2), ln AS (SELECT param, min(n) AS n FROM l GROUP BY 1),
 c AS (SELECT param, chain, draw - start AS t, value, ln.n AS n FROM d JOIN l USING (param, chain) JOIN ln USING (param)),
 s AS (SELECT param, chain || '/' || (t >= n - n // 2) AS ch, CASE WHEN t >= n - n // 2 THEN t - (n - n // 2) ELSE t END AS t, value FROM c WHERE t < n AND (t < n // 2 OR t >= n - n // 2)),
 q AS (SELECT param, quantile_cont(value, 0.5) AS md, quantile_cont(value, 0.05) AS q1, quantile_cont(value, 0.95) AS q2 FROM s GROUP BY 1),
 f AS (SELECT param, ch, t, value, abs(value - md) AS dist, (value <= q1)::INT::DOUBLE AS low, (value <= q2)::INT::DOUBLE AS high FROM s JOIN q USING (param)),
 r AS (SELECT *, (rank() OVER (PARTITION BY param ORDER BY value) + (count(*) OVER (PARTITION BY param, value) - 1) / 2.0::DOUBLE - 0.375::DOUBLE) / (count(*) OVER (PARTITION BY param) + 0.25::DOUBLE) AS p1,
  (rank() OVER (PARTITION BY param ORDER BY dist) + (count(*) OVER (PARTITION BY param, dist) - 1) / 2.0::DOUBLE - 0.375::DOUBLE) / (count(*) OVER (PARTITION BY param) + 0.25::DOUBLE) AS p2 FROM f),
 z AS (SELECT *, {normal_quantile_sql("p1")} AS bulk, {normal_quantile_sql("p2")} AS folded FROM r),
 k AS (SELECT param, ch, t, 'bulk' AS kind, bulk AS x FROM z UNION ALL SELECT param, ch, t, 'folded', folded FROM z UNION ALL SELECT param, ch, t, 'plain', value FROM z
  UNION ALL SELECT param, ch, t, 'low', low FROM z UNION ALL SELECT param, ch, t, 'high', high FROM z),
 m AS (SELECT param, kind, ch, avg(x) AS m, var_samp(x) AS v, count(*) AS n FROM k GROUP BY ALL),
 h AS (SELECT param, kind, sqrt(((max(n) - 1) / max(n) * avg(v) + var_samp(m)) / avg(v)) AS r, var_samp(m) AS b, count(*) AS chains, max(n) AS n FROM m GROUP BY ALL)"""


@query("r_hat", f"""WITH {HALVES} SELECT param, (max(chains) // 2)::BIGINT AS chains, (2 * max(n))::BIGINT AS draws, round(max(r) FILTER (kind IN ('bulk', 'folded')), 8) AS r_hat,
 round(max(r) FILTER (kind = 'plain'), 8) AS r_hat_plain FROM h GROUP BY 1""")
def r_hat_q(spark, sf):
    return rounded(ch.r_hat(draws(spark, sf)), 8)


@query("chain_diagnostics", f"""WITH {HALVES}, a AS (SELECT k.param, k.kind, lag, sum((k.x - m.m) * (y.x - m.m)) / max(h.n) / max(h.chains) AS cov FROM k JOIN m USING (param, kind, ch) JOIN h USING (param, kind), range(64) g(lag),
  k y WHERE y.param = k.param AND y.kind = k.kind AND y.ch = k.ch AND y.t = k.t + lag GROUP BY ALL),
 o AS (SELECT param, kind, lag, n * chains AS size, CASE WHEN lag = 0 THEN 1.0::DOUBLE ELSE 1 - (c0 * n / (n - 1) - cov) / (c0 + b) END AS rho FROM a JOIN (SELECT param, kind, cov AS c0 FROM a WHERE lag = 0) USING (param, kind) JOIN h USING (param, kind)),
 p AS (SELECT param, kind, lag // 2 AS k, max(size) AS size, sum(rho) AS s, sum(rho) FILTER (lag % 2 = 0) AS even FROM o GROUP BY ALL),
 e AS (SELECT param, kind, min(k) AS last FROM p WHERE s < 0 GROUP BY ALL), w AS (SELECT *, min(s) OVER (PARTITION BY param, kind ORDER BY k) AS low FROM p JOIN e USING (param, kind)),
 t AS (SELECT param, kind, max(size) AS size, -1 + 2 * sum(low) FILTER (k < last) + max(greatest(0, even)) FILTER (k = last) AS time FROM w GROUP BY ALL), i AS (SELECT param, kind, size / greatest(time, 1 / log10(size)) AS ess FROM t),
 g AS (SELECT param, stddev_samp(value) AS sd FROM s GROUP BY 1)
SELECT param, (max(chains) // 2)::BIGINT AS chains, (2 * max(n))::BIGINT AS draws, round(max(r) FILTER (kind IN ('bulk', 'folded')), 8) AS r_hat, round(max(ess) FILTER (kind = 'bulk'), 4) AS ess_bulk,
 round(min(ess) FILTER (kind IN ('low', 'high')), 4) AS ess_tail, round(max(sd) / sqrt(max(ess) FILTER (kind = 'plain')), 6) AS mcse_mean FROM h LEFT JOIN i USING (param, kind) JOIN g USING (param) GROUP BY 1""")
def chain_diagnostics_q(spark, sf):
    return rounded(ch.chain_diagnostics(draws(spark, sf)), 4, r_hat=8, mcse_mean=6)


# --- Shapiro-Wilk ----------------------------------------------------------------

def _w_sql(column: str, table: str, name: str) -> str:
    """W of a column; for more than five rows."""
    last = " + ".join(f"({c!r}::DOUBLE) * power(u, {5 - i})" for i, c in enumerate(nm.LAST) if c)
    next_ = " + ".join(f"({c!r}::DOUBLE) * power(u, {5 - i})" for i, c in enumerate(nm.LAST_BUT_ONE) if c)
    return f"""(WITH x AS (SELECT {column}::DOUBLE AS v, row_number() OVER (ORDER BY {column}) AS i, count(*) OVER () AS n FROM {table} WHERE {column} IS NOT NULL),
 p AS (SELECT v - avg(v) OVER () AS v, i, n, (i - 0.375::DOUBLE) / (n + 0.25::DOUBLE) AS p FROM x), m AS (SELECT v, i, n, {normal_quantile_sql("p")} AS m FROM p),
 s AS (SELECT max(n) AS n, sum(v * v) AS ss, sum(m * m) AS mm, sum(m * v) FILTER (i > 2 AND i < n - 1) AS inside, max(v) FILTER (i = n) - max(v) FILTER (i = 1) AS o, max(v) FILTER (i = n - 1) - max(v) FILTER (i = 2) AS o2,
  max(m) FILTER (i = n) AS m1, max(m) FILTER (i = n - 1) AS m2, 1 / sqrt(max(n)) AS u FROM m), a AS (SELECT *, {last} + m1 / sqrt(mm) AS a1, {next_} + m2 / sqrt(mm) AS a2 FROM s)
SELECT '{name}' AS variable, n, round(power(a1 * o + a2 * o2 + inside / sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)), 2) / ss, 8) AS w FROM a)"""


@query("shapiro_wilk", f"{_w_sql('o_totalprice', 'orders', 'o_totalprice')} UNION ALL {_w_sql('o_custkey', 'orders', 'o_custkey')}")
def shapiro_wilk_q(spark, sf):
    return rounded(nm.shapiro_wilk(Tables(spark, sf).orders, ["o_totalprice", "o_custkey"]).drop("p_value"), 8)


@query("shapiro_residuals", f"""WITH f AS (SELECT regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a FROM part), e AS (SELECT p_retailprice - a - b * p_size AS residual FROM part, f)
SELECT * FROM {_w_sql('residual', 'e', 'residual')}""")
def shapiro_residuals_q(spark, sf):
    df = Tables(spark, sf).part
    residuals = ln.ols(df, "p_retailprice", ["p_size"]).score(df).select("residual")
    return rounded(nm.shapiro_wilk(residuals, ["residual"]).drop("p_value"), 8)


# --- attributions of trees -------------------------------------------------------

BOXES = """x AS (SELECT l_orderkey, l_linenumber, (l_quantity > 25)::INT AS a, (l_returnflag = 'N')::INT AS b, l_extendedprice + 2000 * l_quantity AS y FROM lineitem),
 c AS (SELECT a, b, count(*)::DOUBLE AS n, avg(y) AS v FROM x GROUP BY 1, 2), t AS (SELECT sum(n) AS n, sum(n * v) / sum(n) AS v FROM c),
 va AS (SELECT a, sum(n * v) / sum(n) AS v, sum(n) AS n FROM c GROUP BY 1), vb AS (SELECT c.b, sum(va.n * c.v) / max(t.n) AS v FROM c JOIN va USING (a), t GROUP BY 1)"""


def _boxes(spark, sf):
    return Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", (F.col("l_quantity") > 25).cast("int").alias("a"), (F.col("l_returnflag") == "N").cast("int").alias("b"),
                                             (F.col("l_extendedprice") + 2000 * F.col("l_quantity")).alias("y"))


@query("shap_tree", f"""WITH {BOXES} SELECT l_orderkey, l_linenumber, x.a, x.b, round(0.5::DOUBLE * ((va.v - t.v) + (c.v - vb.v)), 3) + 0.0 AS phi_a, round(0.5::DOUBLE * ((vb.v - t.v) + (c.v - va.v)), 3) + 0.0 AS phi_b,
 round(t.v, 3) AS base, round(c.v, 3) AS output FROM x JOIN c USING (a, b) JOIN va USING (a) JOIN vb USING (b), t""")
def shap_tree_q(spark, sf):
    """A tree of two splits, whose contributions have a closed form."""
    df = _boxes(spark, sf)
    model = sv.train(df, "y", ["a", "b"], "tree", params={"maxDepth": 2})
    return rounded(tr.shap_trees(model, df).drop("y"), 3)


TREE_XS = ["l_quantity", "l_discount", "l_tax", "l_returnflag"]


def _additive(spark, sf, kind: str, params: dict):
    """Rows, and the largest gap between the sum of contributions and the prediction."""
    df = Tables(spark, sf).lineitem
    model = sv.train(df, "l_extendedprice", TREE_XS, kind, params=params)
    out = tr.shap_trees(model, model.predict(df), by_input=True)
    total = sum((F.col("phi_" + x) for x in TREE_XS), F.col("base"))
    return rounded(out.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(total - F.col("prediction"))).alias("gap")), 5)


GAP = "SELECT count(*) AS n, 0.0::DOUBLE AS gap FROM lineitem"


@query("shap_forest_gap", GAP)
def shap_forest_gap_q(spark, sf):
    return _additive(spark, sf, "forest", {"numTrees": 10, "maxDepth": 6})


@query("shap_boosting_gap", GAP)
def shap_boosting_gap_q(spark, sf):
    return _additive(spark, sf, "boosting", {"maxIter": 10, "maxDepth": 4})


# --- Ward linkage ------------------------------------------------------------------

def _regions(spark, sf):
    """Customers around the place of their region, far apart."""
    t = Tables(spark, sf)
    df = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return df.select("c_custkey", "n_regionkey", (F.col("n_regionkey") * 100 + F.col("c_acctbal") / 1000).alias("x"), (F.pow(F.col("n_regionkey"), F.lit(2)) * 40 + F.col("c_nationkey") / 10).alias("y"))


@query("ward_counts", """SELECT (row_number() OVER (ORDER BY n DESC, n_regionkey) - 1)::INT AS cluster, n FROM (SELECT n_regionkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)""")
def ward_counts_q(spark, sf):
    df = _regions(spark, sf)
    return lk.ward(df, ["x", "y"], leaves=500).label(df, 5).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("ward_top", """WITH r AS (SELECT n_regionkey, count(*)::DOUBLE AS n, avg(n_regionkey * 100 + c_acctbal / 1000) AS x, avg(n_regionkey * n_regionkey * 40 + c_nationkey / 10) AS y FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT round(min(sqrt(2 * a.n * b.n / (a.n + b.n) * ((a.x - b.x) ** 2 + (a.y - b.y) ** 2))), 3) AS height, (SELECT count(*) FROM customer) AS rows FROM r a JOIN r b ON a.n_regionkey < b.n_regionkey""")
def ward_top_q(spark, sf):
    """The first merge of two whole regions: its height follows from their sizes and means."""
    fit = lk.ward(_regions(spark, sf), ["x", "y"], leaves=500, scale=False)
    steps = fit.table(spark)
    last = steps.agg(F.max("step")).scalar()
    return rounded(steps.where(F.col("step") == last - 3).select("height").withColumn("rows", steps.agg(F.max("rows")).scalar()), 3)


# --- crossed effects ---------------------------------------------------------------

CROSSED = """WITH d AS (SELECT o_custkey, month(o_orderdate) AS month, day(o_orderdate) AS day, o_totalprice / 1e5 + c_acctbal / 4000 + month(o_orderdate) * 0.2::DOUBLE AS y FROM orders JOIN customer ON o_custkey = c_custkey),
 f AS (SELECT regr_slope(y, day) AS k, regr_intercept(y, day) AS c FROM d), e AS (SELECT o_custkey AS a, month AS b, y - c - k * day AS r FROM d, f),
 ab AS (SELECT a, b, count(*)::DOUBLE AS n, sum(r) AS r, sum(r * r) AS rr FROM e GROUP BY 1, 2), pa AS (SELECT a, sum(n) AS n, sum(r) AS r, sum(rr) AS rr, sum(n * n) AS nn FROM ab GROUP BY 1), pb AS (SELECT b, sum(n) AS n, sum(r) AS r, sum(rr) AS rr, sum(n * n) AS nn FROM ab GROUP BY 1),
 ua AS (SELECT sum(rr - r * r / n) AS u, sum(n - nn / n) AS o, sum(n - 1) AS w, sum(n * n) AS q FROM pa), ub AS (SELECT sum(rr - r * r / n) AS u, sum(n - nn / n) AS o, sum(n - 1) AS w, sum(n * n) AS q FROM pb),
 ut AS (SELECT sum(n) AS n, sum(rr) - sum(r) ** 2 / sum(n) AS u FROM ab), z AS (SELECT ua.u AS u1, ua.o AS o1, ua.w AS w1, ub.u AS u2, ub.o AS o2, ub.w AS w2, ut.u AS u3, ut.n - ua.q / ut.n AS k1, ut.n - ub.q / ut.n AS k2, ut.n - 1 AS w3 FROM ua, ub, ut),
 s AS (SELECT *, (u3 - k1 * u2 / o2 - k2 * u1 / o1) / (w3 - k1 * w2 / o2 - k2 * w1 / o1) AS ve FROM z), v AS (SELECT (u2 - w2 * ve) / o2 AS va, (u1 - w1 * ve) / o1 AS vb, ve FROM s)"""


def _customer_months(spark, sf):
    """Orders by customer and month, each with an effect."""
    t = Tables(spark, sf)
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).withColumn("month", F.month("o_orderdate"))
    return o.select("o_custkey", "month", F.dayofmonth("o_orderdate").alias("day"), (F.col("o_totalprice") / 1e5 + F.col("c_acctbal") / 4000 + F.col("month") * 0.2).alias("y"))


@query("crossed_components", CROSSED + """ SELECT component, round(variance, 7) AS variance, round(variance / (va + vb + ve), 7) AS icc FROM v,
 LATERAL (VALUES ('o_custkey', va), ('month', vb), ('residual', ve)) t(component, variance)""")
def crossed_components_q(spark, sf):
    return rounded(cr.crossed_components(_customer_months(spark, sf), "y", ["day"], "o_custkey", "month"), 7)


@query("crossed_fit")
def crossed_fit_q(spark, sf):
    return cr.crossed(_customer_months(spark, sf), "y", ["day"], "o_custkey", "month").components
