"""Kernel machines, attributions of any model and predictive comparison against plain versions."""

import math
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabstat.operators import coalitions as co
from tabstat.operators import kernel as kn
from tabstat.operators import linear as ln
from tabstat.operators import predictive as pr
from tabstat.operators import supervised as sv


# --- kernel machines -----------------------------------------------------------------

def ring(spark, n=600):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=n), rng.normal(size=n)
    r = np.hypot(x, y)
    rows = [(i, float(a), float(b), "in" if d < 0.8 else "mid" if d < 1.5 else "out", "a" if d < 1.1 else "b", float(math.sin(2 * a) + b)) for i, (a, b, d) in enumerate(zip(x, y, r))]
    return spark.createDataFrame(rows, "id long, x double, z double, three string, two string, y double").repartition(3)


def test_the_kernel_solves_what_a_line_cannot(spark):
    df = ring(spark)
    share = {}
    for label in ("two", "three"):
        for kernel in ("rbf", "linear"):
            out = kn.kernel_machine(df, label, ["x", "z"], "classification", kernel).predict(df)
            assert out.columns == [*df.columns, "prediction", *(["score"] if label == "two" else [])]
            share[label, kernel] = out.agg(F.avg((F.col(label) == F.col("prediction")).cast("double"))).first()[0]
    assert share["two", "rbf"] > 0.95 > 0.75 > share["two", "linear"]
    assert share["three", "rbf"] > 0.9 > 0.7 > share["three", "linear"]
    r2 = {k: ln.fit_metrics(kn.kernel_machine(df, "y", ["x", "z"], kernel=k, c=10).predict(df), "y", "prediction").first().r2 for k in ("rbf", "linear")}
    assert r2["rbf"] > 0.95 > 0.8 > r2["linear"]


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_weights_are_a_minimum(spark, task):
    """The slope of the objective is zero at the weights found."""
    df = ring(spark, 200)
    model = kn.kernel_machine(df, "two" if task == "classification" else "y", ["x", "z"], task, c=0.7, features=20)
    rows = model.stages.transform(df).select("features", "two", "y").collect()
    z = model.map(np.array([r.features.toArray() for r in rows]))
    w = model.weights[0]
    if task == "classification":
        y = np.array([1.0 if r.two == "b" else -1.0 for r in rows])
        push = np.where(y * (z @ w) < 1, z @ w - y, 0.0)
    else:
        gap = np.array([r.y for r in rows]) - z @ w
        push = np.where(np.abs(gap) > 0.1, -(gap - 0.1 * np.sign(gap)), 0.0)
    slope = np.append(w[:-1], 0.0) + 2 * 0.7 * z.T @ push
    assert np.abs(slope).max() < 1e-4


def test_kernel_error():
    """Products of features against the kernel: the deviation is below 1 / sqrt(features / 2)."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    true = np.exp(-0.4 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    for features in (256, 4096):
        z = kn.fourier(3, 0.4, features)(x)[:, :-1]
        assert np.sqrt(((z @ z.T - true) ** 2).mean()) < 1 / math.sqrt(features / 2)


def test_cosines_of_many_angles():
    """The series agrees with one cosine after the other, also across blocks and many turns."""
    turns = np.random.default_rng(3).uniform(-60, 60, (kn.COSINE_ROWS, 7))
    turns[0] = [0.0, 0.25, 0.5, 0.75, 1.0, -0.5, 1e-300]
    got = np.empty_like(turns)
    kn.cosines(turns.copy(), 0.3, got)
    assert np.abs(got - 0.3 * np.cos(2 * np.pi * (turns - np.rint(turns)))).max() < 1e-15
    for rows in (0, 1, 2 * kn.COSINE_ROWS + 5):
        x, z = np.random.default_rng(4).normal(size=(rows, 3)), kn.fourier(3, 0.4, 20)
        assert z(x) == pytest.approx(np.column_stack([np.sqrt(0.1) * np.cos(x @ z.frequencies + z.phases), np.ones(rows)]), abs=1e-13)


def test_kernel_grid(spark):
    out = kn.kernel_grid(ring(spark, 300), "two", ["x", "z"], "id", "classification", {"c": [1.0], "kernel": ["linear", "rbf"]}, folds=3)
    assert list(out["kernel"]) == ["rbf", "linear"] and out["score"].iloc[0] > 0.85


# --- attributions of any model ---------------------------------------------------------

def test_any_linear_model_has_its_coefficients(spark):
    df = ring(spark, 300)
    model = sv.train(df, "y", ["x", "z"], "linear")
    means = df.agg(F.avg("x").alias("x"), F.avg("z").alias("z"))
    got = co.shap_any(model.predict, df.select("id", "x", "z"), means, ["x", "z"], "id").orderBy("id").collect()
    from tabstat.operators import explain as ex
    want = ex.shap_linear(ln.ols(df, "y", ["x", "z"]), df).orderBy("id").collect()
    assert np.allclose([[r.phi_x, r.phi_z, r.base] for r in got], [[r.phi_x, r.phi_z, r.base] for r in want], atol=1e-8)


def scored(names):
    """A model with interactions, as columns."""
    a, b, c = (F.col(n) for n in names[:3])
    rest = sum((F.col(n) * (i + 1) / 10 for i, n in enumerate(names[3:])), F.lit(0.0))
    return lambda d: d.withColumn("prediction", a * b + F.when(c > 0, a).otherwise(1.0) + rest)


def plain(line):
    a, b, c, *rest = line
    return a * b + (a if c > 0 else 1.0) + sum(v * (i + 1) / 10 for i, v in enumerate(rest))


def test_all_coalitions_are_exact(spark):
    rng = np.random.default_rng(4)
    names = ["a", "key", "mask", "d"]
    rows = [(i, *map(float, v)) for i, v in enumerate(rng.normal(size=(6, 4)))]
    back = rng.normal(size=(3, 4))
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names))
    other = spark.createDataFrame([tuple(map(float, v)) for v in back], ", ".join(f"{n} double" for n in names))
    got = {r.id: r for r in co.shap_any(scored(names), df, other, names, "id").collect()}
    for i, *x in rows:
        want = np.zeros(4)
        for order in permutations(range(4)):
            for b in back:
                now = list(b)
                for f in order:
                    before = plain(now)
                    now[f] = x[f]
                    want[f] += (plain(now) - before) / 24 / 3
        assert [got[i]["phi_" + n] for n in names] == pytest.approx(want, abs=1e-9)
        assert got[i].base == pytest.approx(np.mean([plain(b) for b in back])) and got[i].output == pytest.approx(plain(x))


def test_sampled_coalitions(spark):
    """Twelve features: additive parts come out exactly, interactions nearly, and the sum always."""
    rng = np.random.default_rng(5)
    names = [f"x{i}" for i in range(12)]
    rows = [(i, *map(float, v)) for i, v in enumerate(rng.normal(size=(4, 12)))]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names))
    zero = spark.createDataFrame([tuple([0.0] * 12)], ", ".join(f"{n} double" for n in names))
    got = {r.id: r for r in co.shap_any(scored(names), df, zero, names, "id", coalitions=400).collect()}
    for i, *x in rows:
        phi = [got[i]["phi_" + n] for n in names]
        assert sum(phi) + got[i].base == pytest.approx(plain(x)) == pytest.approx(got[i].output)
        assert phi[3:] == pytest.approx([v * (k + 1) / 10 for k, v in enumerate(x[3:])], abs=0.15)


def test_background_is_bounded(spark):
    df = ring(spark, 200)
    with pytest.raises(ValueError, match="background"):
        co.shap_any(scored(["x", "z", "y"]), df, df, ["x", "z", "y"], "id")


# --- predictive comparison -------------------------------------------------------------

def test_pareto_fit_recovers_the_shape():
    rng = np.random.default_rng(6)
    for k in (0.1, 0.5, 0.9):
        tail = np.sort(2 * np.expm1(-k * np.log1p(-rng.random((40, 400)))) / k, axis=1)
        shape, scale = pr.pareto_fit(tail)
        assert shape.mean() == pytest.approx(k, abs=0.06) and scale.mean() == pytest.approx(2, rel=0.1)


def test_smoothing_touches_the_tail_only():
    rng = np.random.default_rng(7)
    ratios = rng.standard_t(3, size=(5, 1000)) * 2
    ratios[4] = 1.0
    out, shape = pr.smoothed(ratios)
    size = math.ceil(min(200, 3 * math.sqrt(1000)))
    for line, new in zip(ratios[:4], out[:4]):
        order = np.argsort(line)
        assert np.allclose(new[order[:-size]], line[order[:-size]] - line.max())
        assert (np.diff(new[order[-size:]]) >= 0).all() and new.max() <= 0
    assert (out[4] == 0).all() and shape[4] == -np.inf and np.isfinite(shape[:4]).all()


def regression(spark, n=60):
    rng = np.random.default_rng(8)
    x, z = rng.normal(size=n), rng.normal(size=n)
    y = 1 + 2 * x + rng.normal(size=n)
    y[0] += 6  # an outlier
    return spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, z, y))] + [(n, None, 1.0, 1.0)], "id long, x double, z double, y double")


def test_leave_one_out_against_refits(spark):
    """The estimate without refitting against posteriors that never saw the row."""
    df = regression(spark, 30)
    points = {r.key: r for r in pr.pointwise(df, pr.linear_draws(df, "y", ["x"], 4, 2000), "id").collect()}
    assert len(points) == 30 and {i for i, r in points.items() if r.shape > 0.7} <= {0}  # the outlier says that it can't be trusted
    full = pr.linear_draws(df, "y", ["x"])
    for i in (3, 11, 20):
        rest = pr.linear_draws(df.where(F.col("id") != i), "y", ["x"], 4, 2000, seed=i)
        own = df.where(F.col("id") == i).first()
        fitted = rest.values[:, 0] + rest.values[:, 1] * (own.x - rest.mean[0]) / rest.sd[0]
        density = -0.5 * (((own.y - rest.mean[1]) / rest.sd[1] - fitted) / rest.values[:, 2]) ** 2 - np.log(rest.values[:, 2]) - 0.5 * math.log(2 * math.pi) - math.log(rest.sd[1])
        # the standardisation of the refit is its own, as the prior's scale is
        assert points[i].elpd == pytest.approx(np.logaddexp.reduce(density) - math.log(len(density)), abs=0.06)
    assert full.table(spark).count() == 4 * 500 * 3


def test_model_weights(spark):
    df = regression(spark)
    models = {name: pr.pointwise(df, pr.linear_draws(df, "y", xs), "id") for name, xs in (("noise", ["z"]), ("true", ["x"]), ("both", ["x", "z"]))}
    out = pr.compare_models(models).collect()
    assert [r["rank"] for r in out] == [0, 1, 2] and out[2].model == "noise" and out[0].difference == 0
    assert sum(r.weight for r in out) == pytest.approx(1) and out[2].weight < 0.01
    tables = {r.model: r for r in out}
    alone = pr.loo_table(models["true"]).first()
    assert alone.elpd == pytest.approx(tables["true"].elpd) and alone.se == pytest.approx(tables["true"].se)
    assert 1 < tables["true"].parameters < 7
    again = pr.compare_models({k: v.repartition(5) for k, v in models.items()}).collect()
    assert [r.weight for r in again] == pytest.approx([r.weight for r in out], rel=1e-9)


def test_draws_follow_the_posterior(spark):
    from tabstat.operators import bayes as by
    from tabstat.operators import chains as ch
    df = regression(spark)
    want = {r.param: r for r in by.bayes_linear(df, "y", ["x", "z"]).collect()}
    own = pr.linear_draws(df, "y", ["x", "z"], 4, 2000)
    got = {r.param: r for r in ch.posterior_report(own.table(spark)).collect()}
    for name, r in want.items():
        assert got[name].mean == pytest.approx(r.mean, abs=0.02) and got[name].sd == pytest.approx(r.sd, rel=0.06)
        assert got[name].r_hat < 1.01 and got[name].ess_bulk > 6000


def test_log_means_cost_one_exponential_a_number():
    """As exact as the pairwise form, and far from its time; infinite values stay what they are."""
    import time
    rng = np.random.default_rng(9)
    values, weights = rng.normal(size=(400, 2000)) - 800, rng.normal(size=(400, 2000))

    def seconds(run):
        took = []
        for _ in range(3):
            start = time.perf_counter()
            found = run()
            took.append(time.perf_counter() - start)
        return found, min(took)

    got, own = seconds(lambda: pr._log_mean(values, weights))
    want, plain = seconds(lambda: np.logaddexp.reduce(values + weights, axis=1) - np.logaddexp.reduce(weights, axis=1))
    assert np.allclose(got, want, rtol=1e-12, atol=1e-10) and own < plain / 3
    assert pr._log_mean(np.array([[-np.inf, -np.inf], [0.0, -np.inf]]), np.zeros((2, 2))).tolist() == [-np.inf, -math.log(2)]


def test_few_coalitions_shuffle_one_line_per_key(spark):
    """The answers of a row meet inside its task; keys that repeat share their answers, missing answers are left out, rows without a key go."""
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 3.0, 5.0), (2, 4.0, 1.0), (3, None, 1.0), (None, 1.0, 1.0)], "id long, x double, z double")
    back = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "x double, z double")

    def predict(rows):
        return rows.withColumn("prediction", F.col("x") * 2 + F.col("z") * F.col("x"))

    out = co.shap_any(predict, df, back, ["x", "z"], "id")
    assert "mask__" not in "".join(line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line)
    got = {(r.id, r.z): (r.phi_x, r.phi_z, r.base, r.output) for r in out.collect()}
    many = {(r.id, r.z): (r.phi_x, r.phi_z, r.base, r.output) for r in _narrow(df, back, predict).collect()}
    assert sorted(got) == sorted(many) == [(1, 2.0), (1, 5.0), (2, 1.0), (3, 1.0)]
    for k, line in many.items():
        assert got[k] == pytest.approx(line) if None not in line else [v is None for v in got[k]] == [v is None for v in line]
    assert got[1, 2.0][3] == pytest.approx(sum(got[1, 2.0][:3])) and got[1, 2.0] == got[1, 5.0]


def _narrow(df, back, predict):
    """One line per key and coalition, as for many coalitions."""
    wide, co.WIDE = co.WIDE, 0
    try:
        return co.shap_any(predict, df, back, ["x", "z"], "id")
    finally:
        co.WIDE = wide
