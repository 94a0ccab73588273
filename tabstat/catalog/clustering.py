"""Clusters and composite scores (K and D rows)."""

from pyspark.sql import functions as F

from tabstat.catalog.registry import HOLES_SQL, Tables, query, rounded, with_holes
from tabstat.operators import clustering as ks
from tabstat.operators import composite as cs
from tabstat.operators import density as dn
from tabstat.operators import reshape as rs

H = f"WITH h AS ({HOLES_SQL}) "
LI = ["l_quantity", "l_extendedprice", "l_discount"]


def vectors(spark, sf, dims=4):
    """The embeddings table as columns."""
    e = Tables(spark, sf).embeddings
    return e.select("vec_id", "label", *[F.get("embedding", i).cast("double").alias(f"d{i}") for i in range(dims)])


@query("kmeans")
def kmeans_q(spark, sf):
    df = Tables(spark, sf).lineitem
    out = ks.kmeans(df, LI, 4).label(df)
    return out.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("l_quantity"))


@query("kmeans_centres")
def kmeans_centres_q(spark, sf):
    return ks.kmeans(Tables(spark, sf).lineitem, LI, 3).table(spark)


@query("elbow")
def elbow_q(spark, sf):
    return ks.elbow(Tables(spark, sf).lineitem, LI, 6)


@query("mixture")
def mixture_q(spark, sf):
    return ks.gaussian_mixture(vectors(spark, sf), ["d0", "d1", "d2", "d3"], 3).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("divisive")
def divisive_q(spark, sf):
    return ks.divisive(Tables(spark, sf).lineitem, LI, 4).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("projection")
def projection_q(spark, sf):
    df = Tables(spark, sf).lineitem
    return ks.projection(ks.kmeans(df, LI, 3).label(df), LI, "cluster").groupBy("cluster").agg(
        F.avg("pc_comp1").alias("comp1"), F.avg("pc_comp2").alias("comp2"))


@query("profiles", "SELECT l_linenumber, round(avg(l_quantity), 6) AS mean_l_quantity, round(avg(l_discount), 8) AS mean_l_discount FROM lineitem GROUP BY 1")
def profiles_q(spark, sf):
    return rounded(ks.profiles(Tables(spark, sf).lineitem, ["l_quantity", "l_discount"], "l_linenumber"), mean_l_discount=8)


@query("label_default", H + "SELECT event_id, CASE WHEN value IS NULL THEN 'Não_Clusterizado' WHEN value < 50 THEN '0' ELSE '1' END AS cluster FROM h")
def label_default_q(spark, sf):
    df = with_holes(Tables(spark, sf).events).withColumn("cluster", F.when(F.col("value") < 50, 0).when(F.col("value").isNotNull(), 1))
    return rs.label_or_default(df, "cluster").select("event_id", "cluster")


# clusters of customers by market segment: plain distances and their squares, all pairs in the check
PAIRS = """c AS (SELECT c_custkey AS id, c_acctbal / 1000 AS x, c_nationkey::DOUBLE AS y, c_mktsegment AS c FROM customer),
 p AS (SELECT a.id, a.c, b.c AS o, sum({d}) AS t, count(*) AS n FROM c a, c b GROUP BY 1, 2, 3),
 s AS (SELECT id, max(t / (n - 1)) FILTER (c = o) AS a, min(t / n) FILTER (c <> o) AS b FROM p GROUP BY 1)
SELECT count(*) AS n, round(avg((b - a) / greatest(a, b)), 8) + 0.0 AS silhouette FROM s"""
SQUARE = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"


def segments(spark, sf):
    return Tables(spark, sf).customer.select("c_custkey", (F.col("c_acctbal") / 1000).alias("x"), F.col("c_nationkey").alias("y"), "c_mktsegment")


@query("silhouette", "WITH " + PAIRS.format(d=SQUARE))
def silhouette_q(spark, sf):
    return rounded(ks.silhouette(segments(spark, sf), ["x", "y"], "c_mktsegment"), 8)


@query("silhouette_euclidean", "WITH " + PAIRS.format(d=f"sqrt({SQUARE})"))
def silhouette_euclidean_q(spark, sf):
    return rounded(ks.silhouette_euclidean(segments(spark, sf), ["x", "y"], "c_mktsegment", "c_custkey"), 8)


NEAR = """c AS (SELECT c_custkey AS id, c_acctbal / 1000 AS x, c_nationkey::DOUBLE AS y FROM customer),
 near AS (SELECT a.id AS a, b.id AS b FROM c a, c b WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1.05::DOUBLE * 1.05::DOUBLE),
 k AS (SELECT a AS id, count(*) >= 22 AS core FROM near GROUP BY 1)"""


@query("dbscan_core", f"WITH {NEAR} SELECT id AS c_custkey, core FROM k")
def dbscan_core_q(spark, sf):
    return dn.core_flags(segments(spark, sf), ["x", "y"], "c_custkey", 1.05, 22)


@query("dbscan", f"""WITH RECURSIVE {NEAR}, e AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM k WHERE core) AND b IN (SELECT id FROM k WHERE core)),
 r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), m AS (SELECT a AS id, min(b) AS cluster FROM r GROUP BY 1),
 t AS (SELECT n.a AS id, min(m.cluster) AS cluster FROM near n JOIN m ON n.b = m.id GROUP BY 1)
SELECT k.id AS c_custkey, core, CASE WHEN core THEN m.cluster ELSE coalesce(t.cluster, -1) END AS cluster FROM k LEFT JOIN m USING (id) LEFT JOIN t USING (id)""")
def dbscan_q(spark, sf):
    return dn.density_clusters(segments(spark, sf), ["x", "y"], "c_custkey", 1.05, 22)


# --- composite scores -------------------------------------------------------------

@query("score_mean", H + """SELECT event_id, round((coalesce(value, 0) + user_id) / ((value IS NOT NULL)::INT + 1), 6) AS activity, value AS amount FROM h""")
def score_mean_q(spark, sf):
    df = with_holes(Tables(spark, sf).events)
    return rounded(cs.scores(df, {"activity": ["value", "user_id"], "amount": ["value"]}).select("event_id", "activity", "amount"))


@query("score_pca2", H + """, s AS (SELECT avg(value) AS mx, avg(user_id) AS my, covar_pop(value, value) AS a, covar_pop(user_id, user_id) AS d, covar_pop(value, user_id) AS b FROM h WHERE value IS NOT NULL),
 l AS (SELECT *, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) AS v FROM s), u AS (SELECT *, b AS ux, v - a AS uy FROM l),
 w AS (SELECT *, ux / sqrt(ux * ux + uy * uy) AS wx, uy / sqrt(ux * ux + uy * uy) AS wy FROM u), g AS (SELECT *, CASE WHEN (CASE WHEN abs(wx) >= abs(wy) THEN wx ELSE wy END) < 0 THEN -1 ELSE 1 END AS sg FROM w)
SELECT event_id, round(sg * (wx * (value - mx) + wy * (user_id - my)), 5) + 0.0 AS load, user_id::DOUBLE AS one FROM h, g""")
def score_pca2_q(spark, sf):
    df = with_holes(Tables(spark, sf).events)
    return rounded(cs.scores(df, {"load": ["value", "user_id"], "one": ["user_id"]}, "pca").select("event_id", "load", "one"), 5)


@query("dimension_means", """SELECT 0 AS ord, 'size' AS "Grupo", round(avg((l_quantity + l_linenumber) / 2), 6) AS metrica FROM lineitem UNION ALL SELECT 1, 'rates', round(avg((l_discount + l_tax) / 2), 6) FROM lineitem""")
def dimension_means_q(spark, sf):
    df = cs.scores(Tables(spark, sf).lineitem, {"size": ["l_quantity", "l_linenumber"], "rates": ["l_discount", "l_tax"]})
    return rounded(cs.dimension_means(df, ["size", "rates"]))
