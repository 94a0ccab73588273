"""Models against dense numpy computations on small tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabstat.operators import bayes as by
from tabstat.operators import clustering as ks
from tabstat.operators import correlation as cr
from tabstat.operators import explain as ex
from tabstat.operators import hypothesis as hy
from tabstat.operators import linear as ln
from tabstat.operators import multilevel as ml
from tabstat.operators import paths as pa
from tabstat.operators import supervised as sv


@pytest.fixture(scope="module")
def demo(spark):
    """Known structure: slopes 2 and 1.5, groups with own level, a mediator."""
    rng = np.random.default_rng(42)
    n = 400
    a, b, g = rng.normal(10, 2, n), rng.uniform(0, 5, n), rng.integers(0, 10, n)
    x = rng.normal(10, 2, n)
    m = 5 + 0.6 * x + rng.normal(0, 1, n)
    pdf = pd.DataFrame({
        "id": np.arange(n), "a": a, "b": b, "g": [f"G{v}" for v in g], "c": rng.choice(["X", "Y", "Z"], n), "d": rng.choice(["p", "q"], n),
        "y": 50 + 2 * a + 1.5 * b + rng.normal(0, 3, n),
        "ml": 100 + rng.normal(0, 5, 10)[g] + 3 * a + rng.normal(0, 2, n),
        "x": x, "m": m, "o": 20 + 0.3 * x + 0.5 * m + rng.normal(0, 1, n)})
    pdf["bin"] = (0.8 * (pdf.a - 10) + rng.normal(0, 1, n) > 0).astype(int)
    return spark.createDataFrame(pdf).persist(), pdf


def dense_ols(x, y):
    x = np.column_stack([np.ones(len(x)), x])
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    r = y - x @ beta
    s2 = r @ r / (len(y) - x.shape[1])
    inv = np.linalg.inv(x.T @ x)
    return x, beta, r, s2, inv


def test_ols_against_lstsq(demo):
    df, pdf = demo
    fit = ln.ols(df, "y", ["a", "b"])
    x, beta, r, s2, inv = dense_ols(pdf[["a", "b"]].to_numpy(), pdf.y.to_numpy())
    t = fit.table.toPandas().set_index("variable")
    assert np.allclose(t.coef, beta) and np.allclose(t.se, np.sqrt(np.diag(inv) * s2))
    assert abs(t.coef["a"] - 2) < 4 * t.se["a"] and t.p_value["a"] < 1e-10
    assert np.allclose(t.upper - t.coef, 1.965957 * t.se, rtol=1e-4)
    h = np.einsum("ij,jk,ik->i", x, inv, x)
    inf = ln.influence(df, "y", ["a", "b"]).orderBy("id").toPandas()
    assert np.allclose(inf.leverage, h) and np.allclose(inf.cooks_distance, r ** 2 / (3 * s2) * h / (1 - h) ** 2)
    xs = np.column_stack([np.ones(len(pdf)), pdf[["a", "b"]]])
    v = ln.vif(df, ["a", "b"]).toPandas().set_index("variable").vif
    for i, name in enumerate(["const", "a", "b"]):
        others = np.delete(xs, i, axis=1)
        res = xs[:, i] - others @ np.linalg.lstsq(others, xs[:, i], rcond=None)[0]
        total = (xs[:, i] ** 2).sum() if name == "const" else ((xs[:, i] - xs[:, i].mean()) ** 2).sum()
        assert v[name] == pytest.approx(total / (res @ res))


def test_collinear_columns_and_too_few_rows(spark):
    df = spark.range(20).select(F.col("id").cast("double").alias("x1"), (F.col("id") * 2.0).alias("x2"), (F.col("id") * 3.0 + F.col("id") % 3).alias("y"))
    fit = ln.ols(df, "y", ["x1", "x2"])
    assert fit.solved.rank == 1
    worst = fit.score(df).agg(F.max(F.abs("residual"))).first()[0]
    assert worst < 2
    with pytest.raises(ValueError):
        ln.ols(df.limit(2), "y", ["x1"])


def test_fold_models_equal_direct_fits(demo):
    df, pdf = demo
    got = ln.kfold_ols(df, "y", ["a", "b"], 4, "id").orderBy("fold").toPandas()
    for f in range(4):
        tr, te = pdf[pdf.id % 4 != f], pdf[pdf.id % 4 == f]
        _, beta, *_ = dense_ols(tr[["a", "b"]].to_numpy(), tr.y.to_numpy())
        e = te.y - beta[0] - te[["a", "b"]].to_numpy() @ beta[1:]
        assert got.r2[f] == pytest.approx(1 - (e @ e) / ((te.y - te.y.mean()) ** 2).sum())
        assert got.mae[f] == pytest.approx(np.abs(e).mean())


def test_type_two_table_against_row_level_fits(demo):
    df, pdf = demo
    keep = (pdf.id % 3 > 0) | (pdf.c != "Z")
    got = hy.anova(df.where("id % 3 > 0 OR c <> 'Z'"), "y", ["c", "d"]).toPandas().set_index("term")
    pdf = pdf[keep]

    def rss(*terms):
        x = np.column_stack([np.ones(len(pdf)), *[pd.get_dummies(t).to_numpy(float) for t in terms]])
        r = pdf.y - x @ np.linalg.lstsq(x, pdf.y, rcond=None)[0]
        return float(r @ r)
    cd = pdf.c + pdf.d
    assert got.sum_sq["c"] == pytest.approx(rss(pdf.d) - rss(pdf.c, pdf.d))
    assert got.sum_sq["d"] == pytest.approx(rss(pdf.c) - rss(pdf.c, pdf.d))
    assert got.sum_sq["c:d"] == pytest.approx(rss(pdf.c, pdf.d) - rss(pdf.c, pdf.d, cd))
    assert got.sum_sq["Residual"] == pytest.approx(rss(cd))
    assert list(got.df) == [2, 1, 2, len(pdf) - 6]


def test_empty_factor_cell_reduces_the_rank(demo):
    df, _ = demo
    got = hy.anova(df.where("NOT (c = 'X' AND d = 'p')"), "y", ["c", "d"]).toPandas().set_index("term")
    assert got.df["c:d"] == 1


def test_tukey_and_games_howell_agree_with_two_group_t(demo):
    df, _ = demo
    tk = hy.tukey(df, ["y"], "d").first()
    t = hy.t_two(df, "y", "d", True).first()
    assert tk["p_value"] == pytest.approx(t["p_value"], abs=1e-6) and tk["q"] == pytest.approx(abs(t["t"]) * math.sqrt(2))
    assert tk["lower"] < tk["mean_difference"] < tk["upper"] and tk["reject"] == (tk["p_value"] < 0.05)
    gh, w = hy.games_howell(df, ["y"], "d").first(), hy.t_two(df, "y", "d", False).first()
    assert gh["p_value"] == pytest.approx(w["p_value"], abs=1e-6) and gh["t"] == pytest.approx(w["t"])


def test_rank_tests_against_pandas(demo):
    df, pdf = demo
    pdf = pdf.assign(r=pdf.y.round(0))
    df = df.withColumn("r", F.round("y", 0))
    rk = pdf.r.rank()
    n = len(pdf)
    ties = pdf.r.value_counts()
    h = 12 / (n * (n + 1)) * sum(len(v) * (v.mean() - (n + 1) / 2) ** 2 for _, v in rk.groupby(pdf.c)) / (1 - (ties ** 3 - ties).sum() / (n ** 3 - n))
    got = hy.kruskal(df, ["r"], "c").first()
    assert got["h"] == pytest.approx(h) and got["p_value"] == pytest.approx(math.exp(-h / 2), rel=1e-6)
    s = cr.correlate(df, ["r", "a"], "spearman").first()["r"]
    assert s == pytest.approx(np.corrcoef(pdf.r.rank(), pdf.a.rank())[0, 1])


def test_partial_correlation_of_residuals(demo):
    df, pdf = demo
    got = cr.partial_correlation(df, "x", "o", ["m", "a"]).first()
    _, _, rx, *_ = dense_ols(pdf[["m", "a"]].to_numpy(), pdf.x.to_numpy())
    _, _, ro, *_ = dense_ols(pdf[["m", "a"]].to_numpy(), pdf.o.to_numpy())
    assert got["r"] == pytest.approx(np.corrcoef(rx, ro)[0, 1])


def test_perfect_and_constant_correlations(spark):
    df = spark.range(10).select(F.col("id").alias("x"), (F.col("id") * 2).alias("y"), F.lit(1).alias("k"))
    got = {(r["var1"], r["var2"]): r["r"] for r in cr.correlate(df, ["x", "y", "k"]).collect()}
    assert got[("x", "y")] == 1.0 and got[("x", "k")] is None
    assert cr.total_correlation(df, "x", "y", []).first()["t"] is None
    assert cr.compare_correlations(df.withColumn("g", (F.col("x") < 3).cast("string")), "g", ["x", "y"]).count() == 0


def test_many_columns_take_the_batch_products(spark):
    from tabstat.plans.moments import from_row, moment_matrix, moments
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.normal(1e4, 1, (500, 26)), columns=[f"v{i}" for i in range(26)])
    df = spark.createDataFrame(pdf).repartition(5).withColumn("v3", F.when(F.col("v5") > 1e4 - 2, F.col("v3")))
    cols = list(pdf.columns)
    wide, want = moment_matrix(df, cols), from_row(moments(df, cols).first(), cols)
    assert wide.n == want.n and np.allclose(wide.mean, want.mean) and np.allclose(wide.cross, want.cross, atol=1e-6)


def test_path_model_recovers_and_skips(demo):
    df, pdf = demo
    got = {(r["src"], r["dst"]): r for r in pa.path_model(df.withColumn("empty", F.when(F.col("id") < 2, 1.0)), [
        ("x", "m"), ("x", "o"), ("m", "o"), ("x", "empty")]).collect()}
    assert ("x", "empty") not in got
    _, beta, *_ = dense_ols(pdf[["x", "m"]].to_numpy(), pdf.o.to_numpy())
    assert got[("x", "o")]["beta"] == pytest.approx(beta[1]) and got[("m", "o")]["beta"] == pytest.approx(beta[2])


def test_shap_adds_up(demo):
    df, _ = demo
    fit = ln.ols(df, "y", ["a", "b"])
    gap = ex.shap_linear(fit, fit.score(df)).agg(F.max(F.abs(F.col("phi_a") + F.col("phi_b") + F.col("base") - F.col("prediction")))).first()[0]
    assert gap < 1e-9


def test_shuffled_column_is_a_permutation(demo):
    df, pdf = demo
    out = ex.shuffle_column(df, "a", "id", 1, block=50).toPandas()
    assert np.allclose(np.sort(out.a), np.sort(pdf.a)) and len(out) == len(pdf)
    assert abs(np.corrcoef(out.sort_values("id").a, pdf.a)[0, 1]) < 0.2


def test_penalized_logistic_is_at_its_optimum(demo):
    df, pdf = demo
    fit = sv.logistic(df, "bin", ["a", "b", "c"])
    t = fit.table.toPandas()
    assert list(t.variable) == ["a", "b", "c_Y", "c_Z"]
    x = np.column_stack([pdf.a, pdf.b, pdf.c == "Y", pdf.c == "Z"]).astype(float)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    p = 1 / (1 + np.exp(-(z @ t.coef.to_numpy() + fit.model.intercept)))
    gradient = z.T @ (p - pdf.bin) + t.coef.to_numpy()
    assert np.abs(gradient).max() < 0.05 and abs((p - pdf.bin).sum()) < 0.05


def test_classes_names_and_unseen_levels(demo):
    df, pdf = demo
    cut = df.withColumn("band", F.when(F.col("a") < 9, "low").when(F.col("a") < 11, "mid").otherwise("top"))
    m = sv.train(cut.where("c <> 'Z'"), "band", ["a", "b", "c"], "svm", "classification")
    assert m.labels == ["low", "mid", "top"]
    scored = m.predict(cut)
    assert scored.count() == len(pdf) and set(scored.select("prediction").distinct().toPandas().prediction) <= set(m.labels)
    report = sv.class_report(scored, "band", "prediction").toPandas().set_index("class")
    assert report.support["macro avg"] == len(pdf) and report.recall["low"] > 0.7
    forest = sv.train(cut, "y", ["a", "b", "c"], "forest", grid={"numTrees": [5, 10], "maxDepth": [2, 4]}, folds=2)
    names = sv.feature_names(forest)
    assert names == ["a", "b", "c_X", "c_Y", "c_Z", "c_unknown"]
    assert len(names) == forest.model.transform(cut).first()["features"].size and forest.best["maxDepth"] in (2, 4)
    top = sv.importances(df.sparkSession, forest).toPandas()
    assert top.importance.sum() == pytest.approx(1) and top.feature[0] == "a"


def test_nulls_in_features_and_target(demo):
    df, pdf = demo
    holes = df.withColumn("a", F.when(F.col("id") % 5 > 0, F.col("a"))).withColumn("c", F.when(F.col("id") % 7 > 0, F.col("c")))
    m = sv.train(holes.withColumn("y", F.when(F.col("id") % 9 > 0, F.col("y"))), "y", ["a", "b", "c"], "linear")
    assert m.predict(holes).where("prediction IS NULL").count() == 0
    k = sv.train(holes.withColumn("d", F.when(F.col("id") % 9 > 0, F.col("d"))), "d", ["a", "b"], "logistic", "classification")
    assert k.labels == ["p", "q"] and k.predict(holes).where("score NOT BETWEEN 0 AND 1").count() == 0
    folds = sv.kfold(holes, "y", ["a", "c"], "linear", "regression", 3, "id").toPandas()
    assert folds.n.sum() == len(pdf) and sorted(folds.fold) == [0, 1, 2]


# --- multilevel ---------------------------------------------------------------------

def dense_reml(y, x, v):
    """Restricted log likelihood with the residual variance profiled out."""
    n, p = x.shape
    vi = np.linalg.inv(v)
    xx = x.T @ vi @ x
    beta = np.linalg.solve(xx, x.T @ vi @ y)
    r = y - x @ beta
    rss = r @ vi @ r
    s2 = rss / (n - p)
    l = -0.5 * ((n - p) * (math.log(2 * math.pi * s2) + 1) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(xx)[1])
    return l, beta, s2


def test_random_intercepts_maximize_the_dense_likelihood(demo):
    df, pdf = demo
    fit = ml.mixed(df, "ml", ["a"], "g")
    x = np.column_stack([np.ones(len(pdf)), pdf.a])
    same = (pdf.g.to_numpy()[:, None] == pdf.g.to_numpy()[None, :]).astype(float)
    ratio = fit.variances["group"] / fit.variances["residual"]
    l, beta, s2 = dense_reml(pdf.ml.to_numpy(), x, np.eye(len(pdf)) + ratio * same)
    assert fit.profile.reml == pytest.approx(l, abs=1e-6) and np.allclose(fit.profile.beta, beta, rtol=1e-7)
    for f in (0.97, 1.03):
        assert dense_reml(pdf.ml.to_numpy(), x, np.eye(len(pdf)) + f * ratio * same)[0] < l
    u = fit.random().toPandas().set_index("g").effect
    r = pdf.ml - x @ beta
    n, m = r.groupby(pdf.g).size(), r.groupby(pdf.g).mean()
    assert np.allclose(u.sort_index(), (ratio * n / (1 + ratio * n) * m).sort_index(), rtol=1e-5)
    assert 0 < fit.icc < 1 and fit.components.agg(F.sum("icc")).first()[0] == pytest.approx(1)


def test_balanced_groups_give_the_variance_analysis_estimator(spark):
    rng = np.random.default_rng(1)
    g = np.repeat(np.arange(40), 8)
    y = rng.normal(0, 2, 40)[g] + rng.normal(0, 3, 320)
    df = spark.createDataFrame(pd.DataFrame({"g": g, "y": y}))
    m = y.reshape(40, 8)
    msb, msw = 8 * m.mean(axis=1).var(ddof=1), m.var(axis=1, ddof=1).mean()
    fit = ml.mixed(df, "y", [], "g")
    assert fit.variances["residual"] == pytest.approx(msw, rel=1e-3) and fit.variances["group"] == pytest.approx((msb - msw) / 8, rel=1e-3)


def test_no_group_effect_gives_zero(spark):
    df = spark.range(200).select((F.col("id") % 10).alias("g"), F.floor(F.col("id") / 10).cast("double").alias("y"))
    assert ml.mixed(df, "y", [], "g").variances["group"] == 0.0


def test_nested_model_against_the_dense_likelihood(spark):
    rng = np.random.default_rng(3)
    g3, g2 = rng.integers(0, 6, 240), rng.integers(0, 5, 240)
    x = rng.normal(0, 1, 240)
    cell = g3 * 5 + g2
    y = 1 + 0.5 * x + rng.normal(0, 1.5, 6)[g3] + rng.normal(0, 1, 30)[cell] + rng.normal(0, 1, 240)
    df = spark.createDataFrame(pd.DataFrame({"g3": g3, "g2": g2, "x": x, "y": y}))
    fit = ml.nested(df, "y", ["x"], "g2", "g3")
    s2 = fit.variances["residual"]
    l3, l2 = fit.variances["level3"] / s2, fit.variances["level2"] / s2
    a, b = (g3[:, None] == g3[None, :]).astype(float), (cell[:, None] == cell[None, :]).astype(float)
    xx = np.column_stack([np.ones(240), x])
    l, beta, dense_s2 = dense_reml(y, xx, np.eye(240) + l3 * a + l2 * b)
    assert fit.profile.reml == pytest.approx(l, abs=1e-6) and s2 == pytest.approx(dense_s2)
    for f3, f2 in ((0.9, 1), (1.1, 1), (1, 0.9), (1, 1.1)):
        assert dense_reml(y, xx, np.eye(240) + f3 * l3 * a + f2 * l2 * b)[0] <= l + 1e-6
    cmp = ml.compare_levels(ml.mixed(df.withColumn("c", F.concat_ws("_", "g3", "g2")), "y", ["x"], "c"), fit).first()
    assert cmp["lrt"] > 0 and 0 <= cmp["p_value"] <= 1
    with pytest.raises(ValueError):
        ml.nested(df, "y", ["x"], "g2", "g2")


def test_random_slopes_against_the_dense_likelihood(spark):
    rng = np.random.default_rng(5)
    g = np.repeat(np.arange(30), 10)
    x = rng.uniform(2, 8, 300)
    y = 3 + 1.2 * x + rng.normal(0, 2, 30)[g] + rng.normal(0, 0.8, 30)[g] * x + rng.normal(0, 1, 300)
    df = spark.createDataFrame(pd.DataFrame({"g": g, "x": x, "y": y}))
    fit = ml.mixed_slopes(df, "y", ["x"], "g", ["x"])
    assert fit.fit.first()["settled"]
    c = {(r["term1"], r["term2"]): r["covariance"] for r in fit.components.collect()}
    d = np.array([[c[("intercept", "intercept")], c[("x", "intercept")]], [c[("x", "intercept")], c[("x", "x")]]]) / c[("residual", "residual")]
    z = np.column_stack([np.ones(300), x])
    same = (g[:, None] == g[None, :]).astype(float)
    l, beta, s2 = dense_reml(y, z, np.eye(300) + same * (z @ d @ z.T))
    assert fit.profile.reml == pytest.approx(l, abs=1e-5) and s2 == pytest.approx(c[("residual", "residual")], rel=1e-5)
    assert np.allclose(fit.profile.beta, beta, rtol=1e-4)
    for f in (0.93, 1.07):
        for i, j in ((0, 0), (1, 1)):
            e = d.copy()
            e[i, j] *= f
            assert dense_reml(y, z, np.eye(300) + same * (z @ e @ z.T))[0] < l + 1e-3
    assert fit.random().count() == 30


# --- Bayesian -------------------------------------------------------------------------

def test_bayesian_regression_recovers_the_slopes(demo):
    df, pdf = demo
    t = by.bayes_linear(df, "y", ["a", "b"]).toPandas().set_index("param")
    z = (pdf[["a", "b", "y"]] - pdf[["a", "b", "y"]].mean()) / pdf[["a", "b", "y"]].std(ddof=0)
    _, beta, *_ = dense_ols(z[["a", "b"]].to_numpy(), z.y.to_numpy())
    assert np.allclose(t["mean"][["beta[a]", "beta[b]"]], beta[1:], atol=0.01)
    assert t.hdi_low["beta[a]"] < beta[1] < t.hdi_high["beta[a]"] and t.odds["beta[a]"] > 1e5


def test_bayesian_groups(demo):
    df, pdf = demo
    t = by.bayes_two_group(df, "y", "d").toPandas().set_index("param")
    m = pdf.groupby("d").y.mean()
    assert t["mean"]["diff"] == pytest.approx(m["p"] - m["q"]) and t.p_pos["diff"] + t.p_neg["diff"] == pytest.approx(1)
    se = math.sqrt(sum(v.var() / len(v) for _, v in pdf.groupby("d").y))
    assert t.sd["diff"] == pytest.approx(se, rel=0.02)
    one = by.bayes_one_way(df, "ml", "g").toPandas().set_index("param")
    means = pdf.groupby("g").ml.mean()
    assert np.abs(one["mean"][[f"mu[{g}]" for g in means.index]].to_numpy() - means.to_numpy()).max() < 1.5
    two = by.bayes_two_factor(df, "y", "c", "d").toPandas().set_index("param")
    assert two["mean"][["alpha[X]", "alpha[Y]", "alpha[Z]"]].sum() == pytest.approx(0, abs=1e-9)
    with pytest.raises(ValueError):
        by.bayes_two_group(df, "y", "c")


def test_interval_mass_and_bucket_edges(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"chain": 0, "draw": np.arange(3000), "param": np.where(np.arange(3000) % 3 == 0, "p", "q"),
                        "value": np.round(rng.gamma(2, 1, 3000), 2)})
    df = spark.createDataFrame(pdf)
    for bucket in (7, 100, 65_536):
        got = {r["param"]: (r["hdi_low"], r["hdi_high"]) for r in by.highest_density(df, 0.9, bucket).collect()}
        for p, v in pdf.groupby("param").value:
            x = np.sort(v.to_numpy())
            k = int(0.9 * len(x))
            w = x[k:] - x[:-k]
            lo, hi = got[p]
            assert hi - lo == pytest.approx(w.min()) and ((x >= lo) & (x <= hi)).mean() >= 0.9


# --- clusters ---------------------------------------------------------------------------

def test_rows_sit_at_their_nearest_centre(demo):
    df, pdf = demo
    df = df.withColumn("a2", F.when(F.col("id") != 3, F.col("a")))
    model = ks.kmeans(df, ["a2", "b"], 3)
    got = model.label(df).orderBy("id").toPandas()
    assert pd.isna(got.cluster[3]) and got.cluster.notna().sum() == len(pdf) - 1
    z = (got[["a2", "b"]].to_numpy(float) - model.mean) / model.sd
    d = ((z[:, None, :] - model.centers[None]) ** 2).sum(axis=2)
    keep = np.arange(len(pdf)) != 3
    assert (d[keep].argmin(axis=1) == got.cluster[keep]).all()
    assert model.cost == pytest.approx(d[keep].min(axis=1).sum(), rel=1e-3)
    el = ks.elbow(df, ["a2", "b"], 4).toPandas()
    assert el.inertia[0] == pytest.approx(2 * (len(pdf) - 1)) and (np.diff(el.inertia) < 0).all()


def test_labels_of_all_rows_survive(demo):
    df, pdf = demo
    df = df.withColumn("a2", F.when(F.col("id") > 5, F.col("a")))
    for out in (ks.gaussian_mixture(df, ["a2", "b"], 2), ks.divisive(df, ["a2", "b"], 3)):
        assert out.count() == len(pdf) and out.where("cluster IS NULL").count() == 6


def test_a_task_of_a_fit_reads_a_bounded_number_of_rows(spark, monkeypatch):
    """More rows make more tasks, not longer ones, on any number of cores."""
    from tabstat.plans import stats
    monkeypatch.setattr(stats, "TASK_ROWS", 1000, raising=False)
    df = spark.range(0, 40_000, 1, 1).withColumn("x", F.col("id") % 97)
    assert stats.spread_out(df).rdd.getNumPartitions() == 40
    assert stats.spread_out(df.where("id < 500")).rdd.getNumPartitions() == 1
    assert stats.spread_out(df).agg(F.sum("id")).first()[0] == 40_000 * 39_999 // 2


def test_elbow_keeps_numbers_and_multiplies_blocks(demo, monkeypatch):
    """No vector is kept for the rows, and the costs are those of the centres found."""
    df, _ = demo
    solvers = []
    real = ks.KMeans
    monkeypatch.setattr(ks, "KMeans", lambda **own: solvers.append(own.get("solver")) or real(**own))
    el = {r.k: r.inertia for r in ks.elbow(df, ["a", "b"], 4).collect()}
    assert solvers == ["block"] * 3
    assert el[3] == pytest.approx(ks.kmeans(df, ["a", "b"], 3).cost)


def test_plain_silhouette_forms_each_distance_once(spark, monkeypatch):
    """Blocks in one order only, against all pairs."""
    rng = np.random.default_rng(5)
    x, c = rng.normal(size=(300, 3)), rng.choice(["a", "b", "c", "d"], 300)
    c[0] = "alone"
    df = spark.createDataFrame([(i, str(k), *map(float, v)) for i, (k, v) in enumerate(zip(c, x))] + [(300, None, 1.0, 1.0, 1.0)], "id long, c string, x double, y double, z double")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    s = []
    for i in range(300):
        means = {k: d[i, c == k].sum() / max((c == k).sum() - (k == c[i]), 1) for k in set(c)}
        b = min(v for k, v in means.items() if k != c[i])
        s.append(0.0 if (c == c[i]).sum() == 1 else (b - means[c[i]]) / max(b, means[c[i]]))
    for block in (None, 40, 299):
        got = ks.silhouette_euclidean(df, ["x", "y", "z"], "c", "id", block).first()
        assert got.n == 300 and got.silhouette == pytest.approx(np.mean(s), rel=1e-12)
    order = np.argsort(c, kind="stable")
    levels, code = np.unique(c[order], return_inverse=True)
    monkeypatch.setattr(ks, "TILE", (7, 31))
    to_q, to_p = ks.distance_sums(x[order], code, x[order], code, (len(levels),) * 2)
    assert np.allclose(to_q, to_p) and np.allclose(to_q, d[order][:, order] @ np.eye(len(levels))[code])
