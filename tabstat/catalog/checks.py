"""Deterministic sides of fitted models, against SQL: the chosen test, score equations, likelihoods, predicted effects."""

from pyspark.sql import functions as F

from tabstat.catalog.models import DIMS, RI
from tabstat.catalog.registry import Tables, query, rounded
from tabstat.catalog.supervised import scored_documents
from tabstat.operators import hypothesis as hy
from tabstat.operators import multilevel as ml
from tabstat.operators import supervised as sv


# the limit of F for one and very many degrees of freedom; the query's F is far from it
@query("t_two_chosen", """WITH x AS (SELECT l_quantity AS y, l_linestatus AS g FROM lineitem), c AS (SELECT g, median(y) AS c FROM x GROUP BY 1), z AS (SELECT g, abs(y - c) AS z FROM x JOIN c USING (g)),
 a AS (SELECT g, count(*)::DOUBLE AS n, avg(z) AS m, var_pop(z) * count(*) AS s FROM z GROUP BY 1), t AS (SELECT sum(n) AS n, sum(n * m) / sum(n) AS m, sum(s) AS s FROM a), f AS (SELECT sum(a.n * (a.m - t.m) ** 2) / (max(t.s) / (max(t.n) - 2)) AS f FROM a, t),
 p AS (SELECT g, count(*)::DOUBLE AS n, avg(y) AS m, var_samp(y) AS v FROM x GROUP BY 1), q AS (SELECT a.n AS n1, b.n AS n2, a.m - b.m AS d, a.v AS v1, b.v AS v2, f < 3.8415 AS eq FROM p a JOIN p b ON a.g < b.g, f)
SELECT n1::BIGINT AS n1, n2::BIGINT AS n2, eq AS equal_var, round(CASE WHEN eq THEN d / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)) ELSE d / sqrt(v1 / n1 + v2 / n2) END, 6) AS t,
 round(CASE WHEN eq THEN n1 + n2 - 2 ELSE (v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)) END, 4) AS dof FROM q""")
def t_two_chosen_q(spark, sf):
    return rounded(hy.t_two(Tables(spark, sf).lineitem, "l_quantity", "l_linestatus").select("n1", "n2", "equal_var", "t", "dof"), 6, dof=4)


@query("logistic_equations", """SELECT variable, 0.0::DOUBLE AS slope FROM (SELECT unnest(['const', 'n_chars', 'toxic']) AS variable
 UNION ALL SELECT 'lang_' || lang FROM (SELECT DISTINCT lang FROM documents JOIN labels USING (doc_id)) WHERE lang > (SELECT min(lang) FROM documents JOIN labels USING (doc_id)))""")
def logistic_equations_q(spark, sf):
    """The slopes of the penalised likelihood per row, which are zero at the fit."""
    fit = sv.logistic(scored_documents(spark, sf), "quality", ["n_chars", "toxic", "lang"])
    coef = {r.variable: r.coef for r in fit.table.collect()}
    left, n = F.col("label") - F.col("score"), F.count(F.lit(1))
    mean, sd = fit.scored.agg(*[F.avg(v) for v in coef]).first(), fit.scored.agg(*[F.stddev_pop(v) for v in coef]).first()
    z = {v: (F.col(v) - float(m)) / float(s) for v, m, s in zip(coef, mean, sd)}
    row = fit.scored.agg((F.sum(left) / n).alias("const"), *[((F.sum(left * z[v]) - c) / n).alias(v) for v, c in coef.items()])
    return rounded(row.select(F.inline(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).alias("slope")) for v in ["const", *coef]]))), 5)


RI_PARTS = RI.split("\nSELECT 'group'")[0]


def _ri(spark, sf):
    t = Tables(spark, sf)
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    df = o.select("o_orderkey", "o_custkey", (F.col("o_totalprice") / 1e5 + F.col("c_acctbal") / 4000).alias("y"), F.month("o_orderdate").alias("x"))
    return df, ml.mixed(df, "y", ["x"], "o_custkey")


@query("mlm_loglik", RI_PARTS + " SELECT n::BIGINT AS n, (SELECT count(*) FROM m) AS groups, round(reml - 0.5::DOUBLE * (n - 2) * (ln(2 * pi()) + 1), 2) AS loglik_reml FROM t")
def mlm_loglik_q(spark, sf):
    return rounded(_ri(spark, sf)[1].fit.select("n", "groups", "loglik_reml"), 2)


@query("mlm_icc_table", RI_PARTS + """ SELECT d AS "Grupo", v AS "Variável", round(l / (1 + l), 3) AS metrica FROM t, (VALUES ('Trocas materiais', 'o_totalprice'), ('Trocas materiais', 'o_month'), ('Subjetividades', 'o_status')) z(d, v)""")
def mlm_icc_table_q(spark, sf):
    return rounded(ml.icc_table(_ri(spark, sf)[1], DIMS), 3)


@query("mlm_effects", RI_PARTS + """, u AS (SELECT l * m.n / (1 + l * m.n) * (my - b0 - b1 * mx) AS effect FROM m, t) SELECT count(*) AS n, round(avg(effect * effect), 2) AS mean_square, round(max(effect), 2) AS largest, round(min(effect), 2) AS smallest FROM u""")
def mlm_effects_q(spark, sf):
    """Predicted effects of all groups, in sums that a ratio read from a grid does not change."""
    e = F.col("effect")
    out = _ri(spark, sf)[1].random().agg(F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mean_square"), F.max(e).alias("largest"), F.min(e).alias("smallest"))
    return rounded(out, 2)


@query("mlm_scores", RI_PARTS + """ SELECT count(*) AS n, round(avg(p), 4) AS mean, round(stddev_pop(p), 4) AS sd FROM (SELECT (SELECT avg(y) FROM d) + b0 + b1 * (x - (SELECT avg(x) FROM d)) AS p FROM d, t)""")
def mlm_scores_q(spark, sf):
    df, fit = _ri(spark, sf)
    return rounded(fit.score(df).agg(F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("mean"), F.stddev_pop("prediction").alias("sd")), 4)
