"""Kernel machines, attributions of any model, predictive comparison."""

from pyspark.sql import functions as F

from tabstat.catalog.models import nested_orders
from tabstat.catalog.registry import Tables, query, rounded
from tabstat.catalog.regression import XS, Y
from tabstat.catalog.supervised import SHAP
from tabstat.operators import coalitions as co
from tabstat.operators import kernel as kn
from tabstat.operators import leafwise as lw
from tabstat.operators import linear as ln
from tabstat.operators import predictive as pr
from tabstat.operators import supervised as sv


def _ring(spark, sf):
    """Parts by size and price; the label says whether both together are near their means."""
    p = Tables(spark, sf).part
    s = p.agg(F.struct(F.avg("p_size").alias("a"), F.stddev_pop("p_size").alias("b"), F.avg("p_retailprice").alias("c"), F.stddev_pop("p_retailprice").alias("d"))).scalar()
    u, v = (F.col("p_size") - s["a"]) / s["b"], (F.col("p_retailprice") - s["c"]) / s["d"]
    return p.select("p_partkey", "p_size", "p_retailprice", F.when(u * u + v * v < 1.5, "in").otherwise("out").alias("place"), (10 * F.sin(F.col("p_size") / 5.0)).alias("wave"))


@query("svm_kernel", "SELECT count(*) AS n, true AS kernel_solves, false AS linear_solves FROM part")
def svm_kernel_q(spark, sf):
    """A ring, which the kernel separates and a line does not."""
    df = _ring(spark, sf)
    hits = [F.avg((F.col("place") == F.col("prediction")).cast("double")) > 0.9]
    models = [kn.kernel_machine(df, "place", ["p_size", "p_retailprice"], "classification", kernel) for kernel in ("rbf", "linear")]
    a, b = (m.predict(df).agg(F.count(F.lit(1)).alias("n"), hits[0].alias("hit")) for m in models)
    return a.select("n", F.col("hit").alias("kernel_solves"), b.select("hit").scalar().alias("linear_solves"))


@query("svm_regression", "SELECT count(*) AS n, true AS kernel_solves, false AS linear_solves FROM part")
def svm_regression_q(spark, sf):
    df = _ring(spark, sf)
    models = [kn.kernel_machine(df, "wave", ["p_size"], "regression", kernel, c=10.0) for kernel in ("rbf", "linear")]
    a, b = (ln.fit_metrics(m.predict(df), "wave", "prediction") for m in models)
    return a.select("n", (F.col("r2") > 0.9).alias("kernel_solves"), (b.select("r2").scalar() > 0.9).alias("linear_solves"))


@query("svm_kernel_classes")
def svm_kernel_classes_q(spark, sf):
    t = Tables(spark, sf)
    docs = t.labels.join(t.documents.select("doc_id", "lang", "source", "n_chars"), "doc_id")
    train, test = sv.split(docs, 0.3, 42, "doc_id")
    return sv.class_metrics(kn.kernel_machine(train, "quality", ["n_chars", "lang", "source"], "classification").predict(test), "quality", "prediction")


@query("shap_any_linear", f"WITH {SHAP} SELECT l_quantity, l_discount, round(p1, 3) + 0.0 AS phi_l_quantity, round(p2, 3) + 0.0 AS phi_l_discount, round(my, 3) AS base, round(my + p1 + p2, 3) AS output FROM x")
def shap_any_linear_q(spark, sf):
    """Asking a linear model about replaced rows gives what its coefficients say."""
    df = Tables(spark, sf).lineitem.select("l_orderkey", *XS, Y)
    model = sv.train(df, Y, XS, "linear")
    rows = df.select(F.monotonically_increasing_id().alias("row"), *XS).persist()
    out = co.shap_any(model.predict, rows, df.agg(*[F.avg(x).alias(x) for x in XS]), XS, "row")
    return rounded(out.drop("row"), 3, l_quantity=9, l_discount=9)


@query("shap_any_forest")
def shap_any_forest_q(spark, sf):
    """All parts, explained against three average parts."""
    df = _ring(spark, sf)
    model = sv.train(df, "wave", ["p_size", "p_retailprice"], "forest", params={"numTrees": 10, "maxDepth": 5})
    back = df.groupBy((F.col("p_partkey") % 3).alias("g")).agg(F.round(F.avg("p_size")).cast("int").alias("p_size"), F.avg("p_retailprice").alias("p_retailprice")).drop("g")
    return co.shap_any(model.predict, df.select("p_partkey", "p_size", "p_retailprice"), back, ["p_size", "p_retailprice"], "p_partkey")


def _loo(spark, sf):
    df = nested_orders(spark, sf)
    t = Tables(spark, sf)
    df = df.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey")
    return {name: pr.pointwise(df, pr.linear_draws(df, "y", xs), "o_orderkey") for name, xs in (("full", ["month", "c_acctbal"]), ("reduced", ["month"]))}


@query("loo_compare")
def loo_compare_q(spark, sf):
    return pr.compare_models(_loo(spark, sf))


@query("loo_points", "SELECT count(*) AS n, true AS all_reliable FROM orders JOIN customer ON o_custkey = c_custkey")
def loo_points_q(spark, sf):
    return pr.loo_table(_loo(spark, sf)["reduced"]).select("n", (F.col("unreliable") == 0).alias("all_reliable"))


@query("boosting_leafwise", "SELECT count(*) AS n, true AS losses_fall, true AS fits FROM part")
def boosting_leafwise_q(spark, sf):
    """Losses fall round by round, and the fit follows the wave."""
    df = _ring(spark, sf)
    model = lw.boost(df, "wave", ["p_size", "p_retailprice"], rounds=10, rate=0.3, least_rows=5)
    falls = all(b < a for a, b in zip(model.losses[0], model.losses[0][1:]))
    return ln.fit_metrics(model.predict(df), "wave", "prediction").select("n", F.lit(falls).alias("losses_fall"), (F.col("r2") > 0.9).alias("fits"))


@query("boosting_levelwise")
def boosting_levelwise_q(spark, sf):
    """Whole levels with a penalty, on labelled documents."""
    t = Tables(spark, sf)
    docs = t.labels.join(t.documents.select("doc_id", "lang", "source", "n_chars"), "doc_id")
    train, test = sv.split(docs, 0.3, 42, "doc_id")
    model = lw.boost(train, "quality", ["n_chars", "lang", "source"], "classification", rounds=5, rate=0.3, leaves=64, depth=6, penalty=1.0, least_rows=1, least_curve=1.0)
    return sv.class_metrics(model.predict(test), "quality", "prediction")
