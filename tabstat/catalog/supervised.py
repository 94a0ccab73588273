"""Training, validation, explanation (G rows and L8)."""

from pyspark.sql import functions as F

from tabstat.catalog.registry import HOLES_SQL, Tables, query, rounded, with_holes
from tabstat.catalog.regression import TWO_X, XS, Y
from tabstat.operators import explain as ex
from tabstat.operators import linear as ln
from tabstat.operators import neighbours as nb
from tabstat.operators import supervised as sv

H = f"WITH h AS ({HOLES_SQL}) "


def scored_documents(spark, sf):
    """Labelled documents with a length score and a prediction from it."""
    t = Tables(spark, sf)
    d = t.documents.select("doc_id", "lang", "source", "n_chars")
    return t.labels.join(d, "doc_id").withColumn("pred", (F.col("n_chars") > 1500).cast("int"))


DOCS = "d AS (SELECT l.doc_id, l.quality, l.toxic, n_chars, (n_chars > 1500)::INT AS pred FROM labels l JOIN documents USING (doc_id))"


def order_features(spark, sf):
    t = Tables(spark, sf)
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment")
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", F.month("o_orderdate").alias("month"))
    return o.join(c, "o_custkey")


@query("split_shares")
def split_shares_q(spark, sf):
    train, test = sv.split(Tables(spark, sf).orders, 0.25, 42, "o_orderkey")
    parts = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("split_stratified")
def split_stratified_q(spark, sf):
    train, test = sv.split(Tables(spark, sf).orders, 0.2, 42, "o_orderkey", "o_orderpriority")
    parts = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return parts.groupBy("part", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("target_fill", H + "SELECT event_id, round(coalesce(value, avg(value) OVER ()), 6) AS value FROM h")
def target_fill_q(spark, sf):
    return rounded(sv.fill_target(with_holes(Tables(spark, sf).events), "value").select("event_id", "value"))


@query("target_encode", H + "SELECT event_type, dense_rank() OVER (ORDER BY event_type) - 1.0::DOUBLE AS label, count(*) AS n FROM h WHERE event_type IS NOT NULL GROUP BY 1")
def target_encode_q(spark, sf):
    df, _ = sv.encode_target(with_holes(Tables(spark, sf).events), "event_type")
    return df.groupBy("event_type", "label").agg(F.count(F.lit(1)).alias("n"))


FEATURES = ["c_acctbal", "month", "o_orderstatus", "c_mktsegment"]


def _regression(spark, sf, model, grid=None):
    train, test = sv.split(order_features(spark, sf), 0.3, 42, "o_orderkey")
    return sv.train(train, "o_totalprice", FEATURES, model, grid=grid), test


def _classification(spark, sf, model, y="quality", xs=("n_chars", "lang", "source"), grid=None):
    train, test = sv.split(scored_documents(spark, sf), 0.3, 42, "doc_id")
    return sv.train(train, y, list(xs), model, "classification", grid), test


@query("linear_model", """WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem WHERE l_orderkey % 4 <> 0)
SELECT count(*) AS n, round(1 - avg((l_extendedprice - a - b * l_quantity) ** 2) / var_pop(l_extendedprice), 8) + 0.0 AS r2, round(avg((l_extendedprice - a - b * l_quantity) ** 2) / 1e6, 3) AS mse,
 round(sqrt(avg((l_extendedprice - a - b * l_quantity) ** 2)), 3) AS rmse, round(avg(abs(l_extendedprice - a - b * l_quantity)), 3) AS mae FROM lineitem, f WHERE l_orderkey % 4 = 0""")
def linear_model_q(spark, sf):
    df = Tables(spark, sf).lineitem
    m = sv.train(df.where("l_orderkey % 4 <> 0"), Y, ["l_quantity"], "linear")
    out = ln.fit_metrics(m.predict(df.where("l_orderkey % 4 = 0")), Y, "prediction")
    return rounded(out.withColumn("mse", F.col("mse") / 1e6), 3, r2=8)


@query("linear_model_mixed")
def linear_model_mixed_q(spark, sf):
    m, test = _regression(spark, sf, "linear")
    return ln.fit_metrics(m.predict(test), "o_totalprice", "prediction")


@query("forest_regression")
def forest_regression_q(spark, sf):
    m, _ = _regression(spark, sf, "forest")
    return sv.importances(spark, m)


@query("forest_classes")
def forest_classes_q(spark, sf):
    m, test = _classification(spark, sf, "forest")
    return sv.class_metrics(m.predict(test), "quality", "prediction")


@query("logistic_classes")
def logistic_classes_q(spark, sf):
    m, _ = _classification(spark, sf, "logistic", "lang", ("n_chars", "quality", "toxic"))
    return sv.importances(spark, m)


@query("boosting_regression")
def boosting_regression_q(spark, sf):
    m, test = _regression(spark, sf, "boosting")
    return ln.fit_metrics(m.predict(test), "o_totalprice", "prediction")


@query("boosting_classes")
def boosting_classes_q(spark, sf):
    m, test = _classification(spark, sf, "boosting")
    return sv.class_metrics(m.predict(test), "quality", "prediction")


@query("svm_classes")
def svm_classes_q(spark, sf):
    m, test = _classification(spark, sf, "svm")
    return sv.class_metrics(m.predict(test), "quality", "prediction")


@query("grid_search")
def grid_search_q(spark, sf):
    m, test = _classification(spark, sf, "logistic", grid=sv.GRIDS["logistic"])
    out = sv.class_metrics(m.predict(test), "quality", "prediction")
    return out.withColumn("best_penalty", F.lit(float(m.best["regParam"]))).withColumn("cv_accuracy", F.lit(float(m.best["score"])))


@query("model_comparison")
def model_comparison_q(spark, sf):
    rows = {}
    for name in ("logistic", "svm"):
        m, test = _classification(spark, sf, name)
        rows[name] = sv.class_metrics(m.predict(test), "quality", "prediction")
    return sv.comparison(rows)


@query("kfold_model")
def kfold_model_q(spark, sf):
    return sv.kfold(scored_documents(spark, sf), "quality", ["n_chars", "lang"], "logistic", "classification", 3, "doc_id", stratify="quality")


@query("logistic_penalized")
def logistic_penalized_q(spark, sf):
    return sv.logistic(scored_documents(spark, sf), "quality", ["n_chars", "toxic", "lang"]).table


@query("logistic_scored")
def logistic_scored_q(spark, sf):
    fit = sv.logistic(scored_documents(spark, sf), "quality", ["n_chars", "toxic", "lang"])
    return sv.auc(fit.scored, "label", "score", 1.0)


CUST = """c AS (SELECT c_custkey, c_acctbal / 1000 AS a, c_nationkey::DOUBLE AS b, c_mktsegment, length(c_mktsegment)::DOUBLE AS y FROM customer),
 n AS (SELECT t.c_custkey, s.y, s.c_mktsegment AS seg, row_number() OVER (PARTITION BY t.c_custkey ORDER BY sqrt((t.a - s.a) * (t.a - s.a) + (t.b - s.b) * (t.b - s.b)), s.c_custkey) AS rn
  FROM c t, c s WHERE t.c_custkey % 5 = 0 AND s.c_custkey % 5 <> 0)"""


def customers(spark, sf):
    return Tables(spark, sf).customer.select("c_custkey", (F.col("c_acctbal") / 1000).alias("a"), F.col("c_nationkey").cast("double").alias("b"),
                                             "c_mktsegment", F.length("c_mktsegment").cast("double").alias("y"))


@query("knn_regression", f"WITH {CUST} SELECT c_custkey, round(avg(y), 6) AS prediction FROM n WHERE rn <= 5 GROUP BY 1")
def knn_regression_q(spark, sf):
    df = customers(spark, sf)
    test, train = df.where("c_custkey % 5 = 0"), df.where("c_custkey % 5 <> 0")
    return rounded(nb.knn(train, test, ["a", "b"], "y", "c_custkey", 5))


@query("knn_classes", f"""WITH {CUST}, v AS (SELECT c_custkey, seg, count(*) AS k FROM n WHERE rn <= 7 GROUP BY 1, 2)
SELECT c_custkey, prediction FROM (SELECT c_custkey, seg AS prediction, row_number() OVER (PARTITION BY c_custkey ORDER BY k DESC, seg) AS p FROM v) WHERE p = 1""")
def knn_classes_q(spark, sf):
    df = customers(spark, sf)
    test, train = df.where("c_custkey % 5 = 0"), df.where("c_custkey % 5 <> 0")
    return nb.knn(train, test, ["a", "b"], "c_mktsegment", "c_custkey", 7, "classification")


@query("confusion", f"WITH {DOCS} SELECT quality::VARCHAR AS label, pred::VARCHAR AS prediction, count(*) AS n FROM d GROUP BY 1, 2")
def confusion_q(spark, sf):
    return sv.confusion(scored_documents(spark, sf), "quality", "pred")


@query("confusion_matrix", f"""WITH {DOCS} SELECT quality::VARCHAR AS label, count(*) FILTER (pred = 0) AS "0", count(*) FILTER (pred = 1) AS "1" FROM d GROUP BY 1""")
def confusion_matrix_q(spark, sf):
    return sv.confusion_matrix(scored_documents(spark, sf), "quality", "pred")


REPORT = f"""{DOCS}, k AS (SELECT DISTINCT quality AS c FROM d UNION SELECT DISTINCT pred FROM d),
 r AS (SELECT c::VARCHAR AS class, (SELECT count(*) FROM d WHERE quality = c) AS support, (SELECT count(*) FROM d WHERE pred = c) AS given, (SELECT count(*) FROM d WHERE pred = c AND quality = c) AS hit FROM k),
 p AS (SELECT class, coalesce(hit / nullif(given, 0), 0)::DOUBLE AS precision, coalesce(hit / nullif(support, 0), 0)::DOUBLE AS recall, coalesce(2 * hit / nullif(given + support, 0), 0)::DOUBLE AS f1, support FROM r)"""


@query("clf_report", f"""WITH {REPORT} SELECT class, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1, support FROM p
UNION ALL SELECT 'macro avg', round(avg(precision), 8), round(avg(recall), 8), round(avg(f1), 8), sum(support)::BIGINT FROM p
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 8), round(sum(recall * support) / sum(support), 8), round(sum(f1 * support) / sum(support), 8), sum(support)::BIGINT FROM p""")
def clf_report_q(spark, sf):
    return rounded(sv.class_report(scored_documents(spark, sf), "quality", "pred"), 8)


@query("clf_metrics", f"WITH {REPORT} SELECT round(sum(recall * support) / sum(support), 8) AS accuracy, round(sum(precision * support) / sum(support), 8) AS precision, round(sum(recall * support) / sum(support), 8) AS recall, round(sum(f1 * support) / sum(support), 8) AS f1, sum(support)::BIGINT AS n FROM p")
def clf_metrics_q(spark, sf):
    return rounded(sv.class_metrics(scored_documents(spark, sf), "quality", "pred"), 8)


ROC = f"""{DOCS}, s AS (SELECT n_chars::DOUBLE AS v, count(*) FILTER (quality = 1) AS pos, count(*) FILTER (quality = 0) AS neg FROM d GROUP BY 1),
 t AS (SELECT v, pos, neg, sum(pos) OVER (ORDER BY v DESC) AS tp, sum(neg) OVER (ORDER BY v DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM s)"""


@query("roc", f"WITH {ROC} SELECT v AS threshold, round((fp / n)::DOUBLE, 8) AS fpr, round((tp / p)::DOUBLE, 8) AS tpr FROM t")
def roc_q(spark, sf):
    return rounded(sv.roc(scored_documents(spark, sf), "quality", "n_chars", 1), 8)


@query("auc", f"WITH {ROC} SELECT max(p)::BIGINT AS p, max(n)::BIGINT AS n, round((sum(neg * (tp - pos + pos / 2)) / (max(p) * max(n)))::DOUBLE, 8) AS auc FROM t")
def auc_q(spark, sf):
    return rounded(sv.auc(scored_documents(spark, sf), "quality", "n_chars", 1), 8)


# --- explanation ----------------------------------------------------------------

SHAP = f"""{TWO_X}, x AS (SELECT o_orderkey, l_quantity, l_discount, b1 * (l_quantity - m1) AS p1, b2 * (l_discount - m2) AS p2, my FROM (SELECT l_orderkey AS o_orderkey, l_quantity, l_discount FROM lineitem), e)"""


def _shap(spark, sf):
    df = Tables(spark, sf).lineitem
    return ex.shap_linear(ln.ols(df, Y, XS), df.select("l_orderkey", *XS))


@query("shap_linear", f"WITH {SHAP} SELECT l_quantity, l_discount, round(p1, 3) + 0.0 AS phi_l_quantity, round(p2, 3) + 0.0 AS phi_l_discount, round(my, 3) AS base FROM x")
def shap_linear_q(spark, sf):
    return rounded(_shap(spark, sf).drop("l_orderkey"), 3, l_discount=9, l_quantity=9)


@query("shap_global", f"WITH {SHAP} SELECT 'l_quantity' AS feature, round(avg(abs(p1)), 3) AS importance FROM x UNION ALL SELECT 'l_discount', round(avg(abs(p2)), 3) FROM x")
def shap_global_q(spark, sf):
    return rounded(ex.global_importance(_shap(spark, sf), XS), 3)


@query("shap_summary", f"WITH {SHAP} SELECT 'l_quantity' AS feature, round(avg(p1), 3) + 0.0 AS mean, round(avg(abs(p1)), 3) AS mean_abs, round(min(p1), 3) AS min, round(max(p1), 3) AS max FROM x UNION ALL SELECT 'l_discount', round(avg(p2), 3) + 0.0, round(avg(abs(p2)), 3), round(min(p2), 3), round(max(p2), 3) FROM x")
def shap_summary_q(spark, sf):
    return rounded(ex.shap_summary(_shap(spark, sf), XS), 3)


PART = """WITH s AS (SELECT regr_slope(p_retailprice, p_size) AS b, avg(p_size) AS mx, avg(p_retailprice) AS my FROM part)"""


def _part_shap(spark, sf):
    df = Tables(spark, sf).part
    return ex.shap_linear(ln.ols(df, "p_retailprice", ["p_size"]), df.select("p_partkey", "p_size"))


@query("shap_row", PART + " SELECT round(my, 5) AS base, round(my + b * (p_size - mx), 5) AS prediction, 'p_size' AS feature, round(b * (p_size - mx), 5) + 0.0 AS contribution FROM part, s WHERE p_partkey = 77")
def shap_row_q(spark, sf):
    return rounded(ex.explain_row(_part_shap(spark, sf), "p_partkey", 77, ["p_size"]), 5)


@query("shap_dependence", PART + " SELECT p_partkey, p_size::DOUBLE AS value, round(b * (p_size - mx), 5) + 0.0 AS contribution, round(my + b * (p_size - mx), 5) AS output FROM part, s")
def shap_dependence_q(spark, sf):
    return rounded(ex.contribution_table(_part_shap(spark, sf), "p_partkey", "p_size", ["p_size"]), 5)


@query("permutation_importance")
def permutation_importance_q(spark, sf):
    df = Tables(spark, sf).lineitem.withColumn("row", F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"))
    m = sv.train(df, Y, XS, "linear")
    return ex.permutation_importance(m, df, Y, XS, "row")


GRID = f"""WITH c AS (SELECT c_custkey, c_custkey % 3 AS fold, c_acctbal / 1000 AS a, c_nationkey::DOUBLE AS b, length(c_mktsegment)::DOUBLE AS y FROM customer),
 n AS (SELECT t.c_custkey, t.fold, t.y, s.y AS ny, row_number() OVER (PARTITION BY t.c_custkey ORDER BY sqrt((t.a - s.a) * (t.a - s.a) + (t.b - s.b) * (t.b - s.b)), s.c_custkey) AS rn FROM c t JOIN c s ON t.fold <> s.fold),
 p AS (SELECT k, fold, c_custkey, max(y) AS y, avg(ny) AS p FROM n, (VALUES (3), (5), (7)) g(k) WHERE rn <= k GROUP BY 1, 2, 3),
 f AS (SELECT k, fold, 1 - avg((y - p) ** 2) / var_pop(y) AS r2 FROM p GROUP BY 1, 2)
SELECT k::INT AS k, round(avg(r2), 8) AS score FROM f GROUP BY 1"""


@query("knn_grid", GRID)
def knn_grid_q(spark, sf):
    return rounded(nb.knn_grid(customers(spark, sf), ["a", "b"], "y", "c_custkey", sv.GRIDS["knn"]["k"], 3), 8)
