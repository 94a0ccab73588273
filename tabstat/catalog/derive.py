"""Derived columns (F rows)."""

from pyspark.sql import functions as F

from tabstat.catalog.registry import HOLES_SQL, Tables, query, rounded, with_holes
from tabstat.functions import labels
from tabstat.operators import derive as dv

H = f"WITH h AS ({HOLES_SQL}) "


@query("row_sum_mean", H + """SELECT event_id, round(coalesce(value, 0) + coalesce(other, 0), 6) AS total,
 round((coalesce(value, 0) + coalesce(other, 0)) / nullif((value IS NOT NULL)::INT + (other IS NOT NULL)::INT, 0), 6) AS mean
 FROM (SELECT event_id, value, CASE WHEN event_id % 4 <> 0 THEN user_id::DOUBLE END AS other FROM h)""")
def row_sum_mean_q(spark, sf):
    df = with_holes(Tables(spark, sf).events).withColumn("other", F.when(F.col("event_id") % 4 != 0, F.col("user_id").cast("double")))
    df = dv.row_mean(dv.row_sum(df, ["value", "other"], "total"), ["value", "other"], "mean")
    return rounded(df.select("event_id", "total", "mean"))


@query("dummies", H + """SELECT event_id, coalesce((event_type = 'error')::INT, 0) AS event_type_error, coalesce((event_type = 'purchase')::INT, 0) AS event_type_purchase,
 coalesce((event_type = 'signup')::INT, 0) AS event_type_signup, coalesce((event_type = 'view')::INT, 0) AS event_type_view FROM h""")
def dummies_q(spark, sf):
    return dv.dummies(with_holes(Tables(spark, sf).events), "event_type").drop("ts", "user_id", "value", "event_type")


@query("transforms", """SELECT p_partkey, round(ln(1 + p_retailprice), 6) AS p_retailprice_log, round(p_retailprice * p_retailprice, 3) AS p_retailprice_square,
 round(sqrt(p_retailprice), 6) AS p_retailprice_sqrt FROM part""")
def transforms_q(spark, sf):
    df = Tables(spark, sf).part.select("p_partkey", "p_retailprice")
    for kind in ("log", "square", "sqrt"):
        df = dv.transform(df, "p_retailprice", kind)
    return rounded(df.drop("p_retailprice"), p_retailprice_square=3)


@query("likert", "SELECT p_partkey, 51 - p_size AS p_size_inv FROM part")
def likert_q(spark, sf):
    return dv.reverse_scale(Tables(spark, sf).part, "p_size", 50).select("p_partkey", "p_size_inv")


@query("interaction", "SELECT p_partkey, round(p_size * p_retailprice, 4) AS p_size_x_p_retailprice FROM part")
def interaction_q(spark, sf):
    return rounded(dv.interaction(Tables(spark, sf).part, "p_size", "p_retailprice").select("p_partkey", "p_size_x_p_retailprice"), 4)


@query("qbins", """WITH e AS (SELECT unnest(quantile_cont(p_size::DOUBLE, [0.0, 0.25, 0.5, 0.75, 1.0])) AS x FROM part), d AS (SELECT DISTINCT x FROM e),
 i AS (SELECT row_number() OVER (ORDER BY x) - 2 AS bin, lag(x) OVER (ORDER BY x) AS lo, x AS hi FROM d),
 m AS (SELECT min(x) AS mn FROM d)
SELECT p_partkey, bin::INT AS bin, lo AS bin_lo, hi AS bin_hi FROM part, i, m WHERE bin >= 0 AND ((p_size > lo AND p_size <= hi) OR (p_size = mn AND bin = 0))""")
def qbins_q(spark, sf):
    return dv.quantile_bins(Tables(spark, sf).part, "p_size", 4, "bin").select("p_partkey", "bin", "bin_lo", "bin_hi")


@query("qbins_tied", """WITH e AS (SELECT unnest(quantile_cont(l_discount, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS x FROM lineitem), d AS (SELECT DISTINCT x FROM e),
 i AS (SELECT row_number() OVER (ORDER BY x) - 2 AS bin, lag(x) OVER (ORDER BY x) AS lo, x AS hi FROM d), m AS (SELECT min(x) AS mn FROM d)
SELECT bin::INT AS bin, count(*) AS n FROM lineitem, i, m WHERE bin >= 0 AND ((l_discount > lo AND l_discount <= hi) OR (l_discount = mn AND bin = 0)) GROUP BY 1""")
def qbins_tied_q(spark, sf):
    df = dv.quantile_bins(Tables(spark, sf).lineitem, "l_discount", 5, "bin")
    return df.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("named_levels", "SELECT l_linestatus_cat, count(*) AS n FROM (SELECT CASE l_linestatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'final' END AS l_linestatus_cat FROM lineitem) GROUP BY 1")
def named_levels_q(spark, sf):
    df = dv.named_levels(Tables(spark, sf).lineitem, "l_linestatus", {"O": "open", "F": "final"}, drop_source=True)
    return df.groupBy("l_linestatus_cat").agg(F.count(F.lit(1)).alias("n"))


@query("date_parts", """SELECT event_id, year(ts)::INT AS ts_ano, month(ts)::INT AS ts_mes, day(ts)::INT AS ts_dia, (isodow(ts) - 1)::INT AS ts_semana,
 hour(ts)::INT AS ts_hora, minute(ts)::INT AS ts_minuto FROM events""")
def date_parts_q(spark, sf):
    return dv.date_parts(Tables(spark, sf).events, "ts").drop("ts", "user_id", "event_type", "value", "props")


COMPONENTS_SQL = """WITH s AS (SELECT avg(l_quantity) AS mx, stddev_pop(l_quantity) AS sx, avg(l_extendedprice) AS my, stddev_pop(l_extendedprice) AS sy,
 corr(l_quantity, l_extendedprice) AS r FROM lineitem)
SELECT l_linenumber, count(*) AS n, round(max(c1), 5) AS max1, round(min(c1), 5) AS min1, round(sum(c2 * c2), 3) AS ss2, round(max(ratio), 6) AS ratio1 FROM (
SELECT l_linenumber, ((l_quantity - mx) / sx + sign(r) * (l_extendedprice - my) / sy) / sqrt(2) AS c1,
 ((l_quantity - mx) / sx - sign(r) * (l_extendedprice - my) / sy) / sqrt(2) AS c2, (1 + abs(r)) / 2 AS ratio FROM lineitem, s) GROUP BY 1"""


@query("components", COMPONENTS_SQL)
def components_q(spark, sf):
    df, ratio = dv.components(Tables(spark, sf).lineitem, ["l_quantity", "l_extendedprice"], 2)
    top = ratio.where("component = 1").select("ratio").scalar()
    out = df.groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.max("pc_comp1").alias("max1"), F.min("pc_comp1").alias("min1"),
        F.sum(F.col("pc_comp2") * F.col("pc_comp2")).alias("ss2"))
    return rounded(out.withColumn("ratio1", top), max1=5, min1=5, ss2=3)


@query("components_rows")
def components_rows_q(spark, sf):
    df = with_holes(Tables(spark, sf).events)
    return dv.components(df, ["value", "user_id", "event_id"], 2, "ev")[0].select("event_id", "ev_comp1", "ev_comp2")


@query("composite_key", H + "SELECT event_id, CASE WHEN event_type IS NOT NULL THEN event_type || '_' || user_id::VARCHAR END AS key FROM h")
def composite_key_q(spark, sf):
    return with_holes(Tables(spark, sf).events).select("event_id", dv.composite_key(["event_type", "user_id"]).alias("key"))


@query("threshold_labels", """SELECT event_id, CASE WHEN abs(x) < 0.5 THEN 'symmetric' WHEN x >= 0.5 THEN 'right-skewed' ELSE 'left-skewed' END AS skew,
 CASE WHEN x < -1 THEN 'platykurtic' WHEN x <= 1 THEN 'mesokurtic' ELSE 'leptokurtic' END AS kurtosis,
 CASE WHEN value < 0.05 THEN 'significant' ELSE 'not significant' END AS p,
 CASE WHEN value < 0.01 THEN 'extreme for null' WHEN value < 1/30 THEN 'very strong for null' WHEN value < 0.1 THEN 'strong for null' WHEN value < 1/3 THEN 'moderate for null'
  WHEN value < 1 THEN 'weak for null' WHEN value = 1 THEN 'none' WHEN value <= 3 THEN 'weak for alternative' WHEN value <= 10 THEN 'moderate for alternative'
  WHEN value <= 30 THEN 'strong for alternative' WHEN value <= 100 THEN 'very strong for alternative' ELSE 'extreme for alternative' END AS bf,
 CASE WHEN value > 0.95 THEN 'irrelevant' WHEN value < 0.05 THEN 'relevant' ELSE 'uncertain' END AS rope FROM (SELECT event_id, value, value / 50 - 1 AS x FROM events)""")
def threshold_labels_q(spark, sf):
    x = F.col("value") / 50 - 1
    return Tables(spark, sf).events.select(
        "event_id", labels.skew_label(x).alias("skew"), labels.kurtosis_label(x).alias("kurtosis"),
        labels.significance_label(F.col("value")).alias("p"), labels.bayes_factor_label(F.col("value")).alias("bf"),
        labels.rope_label(F.col("value")).alias("rope"))
