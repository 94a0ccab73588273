"""Chain diagnostics, normal scores, Shapiro-Wilk, Ward linkage and crossed effects against plain versions."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabstat.functions.normal_scores import normal_quantile
from tabstat.operators import chains as ch
from tabstat.operators import crossed as cr
from tabstat.operators import linkage as lk
from tabstat.operators import normality as nm


def test_normal_quantile(spark):
    p = [1e-300, 1e-30, 1e-9, 0.001, 0.0749, 0.0751, 0.3, 0.5, 0.7, 0.9249, 0.9251, 0.999, 1 - 1e-12]
    got = spark.createDataFrame([(x,) for x in [*p, 0.0, 1.0, None]], "p double").withColumn("z", normal_quantile("p")).collect()
    for r in got[:len(p)]:
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-13, abs=1e-13)
    assert [r.z for r in got[len(p):]] == [None] * 3


# --- chains ------------------------------------------------------------------------

def autoregressive(rng, n, phi):
    x = np.zeros(n)
    for t in range(1, n):
        x[t] = phi * x[t - 1] + rng.normal()
    return x


def draws_table(spark, chains):
    """{param: [values of each chain]} as a draws table that starts at draw 5."""
    rows = [(c, t + 5, p, float(v)) for p, many in chains.items() for c, values in enumerate(many) for t, v in enumerate(values)]
    return spark.createDataFrame(rows, "chain long, draw long, param string, value double").repartition(5)


def plain_sizes(chains):
    """Effective size of equally long series, all lags at once."""
    x = np.array(chains)
    m, n = x.shape
    dev = x - x.mean(axis=1, keepdims=True)
    cov = np.array([(dev[:, :n - k] * dev[:, k:]).sum(axis=1).mean() / n for k in range(n)])
    rho = 1 - (cov[0] * n / (n - 1) - cov) / (cov[0] + x.mean(axis=1).var(ddof=1))
    rho[0] = 1
    total, least, k = 0.0, np.inf, 0
    while 2 * k + 1 < n and rho[2 * k] + rho[2 * k + 1] >= 0:
        least = min(least, rho[2 * k] + rho[2 * k + 1])
        total, k = total + least, k + 1
    time = -1 + 2 * total + (max(0.0, rho[2 * k]) if 2 * k + 1 < n else 0.0)
    return m * n / max(time, 1 / math.log10(m * n))


def halves(chains):
    n = min(map(len, chains))
    return [part for c in chains for part in (c[:n // 2], c[n - n // 2:n])]


def scores(chains):
    x = np.array(chains)
    flat = x.ravel()
    rank = np.array([(flat < v).sum() + ((flat == v).sum() + 1) / 2 for v in flat])
    return np.array([NormalDist().inv_cdf(p) for p in (rank - 0.375) / (len(flat) + 0.25)]).reshape(x.shape)


def plain_r_hat(chains):
    x = np.array(chains)
    n, within = x.shape[1], x.var(axis=1, ddof=1).mean()
    return math.sqrt(((n - 1) / n * within + x.mean(axis=1).var(ddof=1)) / within)


def test_chain_diagnostics_against_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(ch.autocovariances, "__defaults__", (100,))
    monkeypatch.setattr(ch.effective_sizes, "__defaults__", (8,))
    rng = np.random.default_rng(2)
    table = {"white": [rng.normal(size=701) for _ in range(4)], "slow": [autoregressive(rng, 700, 0.9) for _ in range(3)],
             "apart": [rng.normal(loc=c, size=300) for c in range(3)], "ties": [rng.integers(0, 3, 400).astype(float) for _ in range(2)],
             "wide": [rng.normal(scale=1 + 3 * c, size=500) for c in range(2)], "constant": [np.ones(50)] * 2}
    got = {r.param: r for r in ch.chain_diagnostics(draws_table(spark, table)).collect()}
    assert set(got) == set(table)
    for name, chains in table.items():
        r, parts = got[name], halves([c.tolist() for c in chains])
        assert (r.chains, r.draws) == (len(chains), 2 * len(parts[0]))
        if name == "constant":
            assert r.r_hat is None and r.ess_bulk is None
            continue
        x = np.array(parts)
        folded = np.abs(x - np.median(x))
        assert r.r_hat == pytest.approx(max(plain_r_hat(scores(parts)), plain_r_hat(scores(folded))), rel=1e-9)
        assert r.ess_bulk == pytest.approx(plain_sizes(scores(parts)), rel=1e-6)
        tail = [plain_sizes((x <= np.quantile(x, q)).astype(float)) for q in (0.05, 0.95)]
        if name != "ties":
            assert r.ess_tail == pytest.approx(min(tail), rel=1e-6)
        assert r.mcse_mean == pytest.approx(x.std(ddof=1) / math.sqrt(plain_sizes(x)), rel=1e-6)
    assert got["white"].r_hat < 1.02 and got["apart"].r_hat > 1.2 and got["wide"].r_hat > 1.1
    n = 2100  # an autoregression of 0.9 is worth (1 - 0.9) / (1 + 0.9) of its draws
    assert 0.5 < got["slow"].ess_bulk / (n * 0.1 / 1.9) < 2


def test_gaps_in_draws_are_refused(spark):
    bad = spark.createDataFrame([(0, t, "a", float(t)) for t in (1, 2, 4, 5, 6, 7)], "chain long, draw long, param string, value double")
    with pytest.raises(Exception, match="without gaps"):
        ch.r_hat(bad).collect()


def test_report_joins_summary_and_diagnostics(spark):
    rng = np.random.default_rng(3)
    out = ch.posterior_report(draws_table(spark, {"a": [rng.normal(size=200) for _ in range(2)]})).collect()
    assert len(out) == 1 and {"mean", "sd", "hdi_low", "hdi_high", "r_hat", "ess_bulk", "ess_tail", "mcse_mean"} <= set(out[0].asDict())


# --- Shapiro-Wilk ------------------------------------------------------------------

def plain_w(values):
    x = sorted(values)
    n = len(x)
    if n == 3:
        a = [-math.sqrt(0.5), 0, math.sqrt(0.5)]
    else:
        m = [NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
        mm, u = sum(v * v for v in m), 1 / math.sqrt(n)
        last = sum(c * u ** (5 - i) for i, c in enumerate(nm.LAST)) + m[-1] / math.sqrt(mm)
        if n > 5:
            second = sum(c * u ** (5 - i) for i, c in enumerate(nm.LAST_BUT_ONE)) + m[-2] / math.sqrt(mm)
            eps = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last ** 2 - 2 * second ** 2)
            a = [-last, -second, *[v / math.sqrt(eps) for v in m[2:-2]], second, last]
        else:
            eps = (mm - 2 * m[-1] ** 2) / (1 - 2 * last ** 2)
            a = [-last, *[v / math.sqrt(eps) for v in m[1:-1]], last]
    centre = sum(x) / n
    return sum(p * q for p, q in zip(a, x)) ** 2 / sum((v - centre) ** 2 for v in x)


@pytest.mark.parametrize("n", [3, 4, 5, 6, 11, 12, 50, 400])
def test_shapiro_wilk_against_weights(spark, n, monkeypatch):
    monkeypatch.setattr(nm, "PIECE", 7)
    rng = np.random.default_rng(n)
    a, b = rng.normal(size=n), np.round(rng.exponential(size=n) * 3) + np.arange(n) * 1e-3 * (n < 12)
    b[:n // 3] = b[0]  # a value that a third of the rows share
    df = spark.createDataFrame([(float(x), float(y), None) for x, y in zip(a, b)] + [(None, None, None)], "a double, b double, c double").repartition(3)
    got = {r.variable: r for r in nm.shapiro_wilk(df, ["a", "b", "c"]).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"].w == pytest.approx(plain_w(a), rel=1e-9)
    assert got["b"].w == pytest.approx(plain_w(b), rel=1e-9)
    assert all(r.n == n and 0 <= r.p_value <= 1 for r in got.values())
    if n == 400:
        assert got["a"].p_value > 0.01 > got["b"].p_value


def test_shapiro_published_example(spark):
    """The weights of eleven men of the 1965 paper: W = 0.79, p below 0.01."""
    men = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    df = spark.createDataFrame([("men", float(x)) for x in men] + [("flat", 1.0)] * 4, "g string, x double")
    got = {r.g: r for r in nm.shapiro_wilk(df, ["x"], ["g"]).collect()}
    assert round(got["men"].w, 2) == 0.79 and 0.005 < got["men"].p_value < 0.01
    assert got["flat"].w is None and got["flat"].p_value is None


def test_shapiro_p_values_are_uniform_for_normal_rows(spark):
    """Share of small p-values among normal samples."""
    rng = np.random.default_rng(11)
    rows = [(g, float(x)) for g in range(300) for x in rng.normal(size=40)]
    p = [r.p_value for r in nm.shapiro_wilk(spark.createDataFrame(rows, "g long, x double"), ["x"], ["g"]).collect()]
    assert 0.01 < np.mean(np.array(p) < 0.05) < 0.1 and 0.4 < np.mean(p) < 0.6


# --- Ward --------------------------------------------------------------------------

def plain_ward(points, sizes):
    groups = {i: (np.array(p, float), float(n)) for i, (p, n) in enumerate(zip(points, sizes))}
    steps, name = [], len(points)
    while len(groups) > 1:
        best = min((math.sqrt(2 * na * nb / (na + nb) * ((ca - cb) ** 2).sum()), i, j)
                   for i, (ca, na) in groups.items() for j, (cb, nb) in groups.items() if i < j)
        (ca, na), (cb, nb) = groups.pop(best[1]), groups.pop(best[2])
        groups[name] = ((na * ca + nb * cb) / (na + nb), na + nb)
        steps.append((best[1], best[2], best[0], na + nb))
        name += 1
    return np.array(steps)


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 25), st.integers(1, 3), st.integers(0, 1000))
def test_ward_steps_equal_full_linkage(n, width, seed):
    rng = np.random.default_rng(seed)
    points, sizes = rng.normal(size=(n, width)), rng.integers(1, 5, n)
    got, want = lk.ward_steps(points, sizes), plain_ward(points, sizes)
    assert np.allclose(got, want)


def test_ward_of_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(60, 2)))]
    rows += [(60 + i, rows[i][1], rows[i][2]) for i in range(10)] + [(100, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double").repartition(4)
    fit = lk.ward(df, ["x", "y"], scale=False)
    assert fit.exact and fit.sizes.sum() == 70 and len(fit.sizes) == 60
    assert np.allclose(fit.steps[:, 2], plain_ward(fit.centres, fit.sizes)[:, 2])
    labels = {r.id: r.cluster for r in fit.label(df, 7).collect()}
    assert labels[100] is None and all(labels[i] == labels[60 + i] for i in range(10))
    counts = np.bincount([c for c in labels.values() if c is not None])
    assert len(counts) == 7 and list(counts) == sorted(counts, reverse=True)
    assert fit.table(spark).count() == 59


def test_ward_of_more_rows_than_leaves(spark):
    """Groups that lie apart stay whole when rows are summarised first."""
    rng = np.random.default_rng(7)
    rows = [(i % 6, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(3000, 2)) + [[20 * (k % 3), 25 * (k // 3)] for k in np.arange(3000) % 6])]
    df = spark.createDataFrame(rows, "g long, x double, y double").repartition(4)
    fit = lk.ward(df, ["x", "y"], leaves=60)
    assert not fit.exact and fit.sizes.sum() == 3000
    pairs = fit.label(df, 6).groupBy("g", "cluster").count().collect()
    assert len(pairs) == 6 and {r["count"] for r in pairs} == {500}


# --- crossed -----------------------------------------------------------------------

def crossed_rows(seed=1, na=60, nb=45, n=4000, sa=2.0, sb=1.0, se=0.5):
    rng = np.random.default_rng(seed)
    u, v = rng.normal(0, sa, na), rng.normal(0, sb, nb)
    a, b = rng.integers(0, na, n), (nb * rng.random(n) ** 1.5).astype(int)
    x = rng.normal(size=n)
    return [(f"a{i:02d}", int(j), float(z), float(3 + 1.5 * z + u[i] + v[j] + rng.normal(0, se))) for i, j, z in zip(a, b, x)], u, v


def test_crossed_recovers_planted_variances(spark):
    rows, u, v = crossed_rows()
    df = spark.createDataFrame([*rows, (None, 1, 1.0, 1.0)], "a string, b long, x double, y double")
    fit = cr.crossed(df, "y", ["x"], "a", "b")
    got = fit.variances
    assert got["residual"] == pytest.approx(0.25, rel=0.1)
    assert got["a"] == pytest.approx(u.var(ddof=1), rel=0.15) and got["b"] == pytest.approx(v.var(ddof=1), rel=0.15)
    assert {r.variable: r.coef for r in fit.fixed.collect()}["x"] == pytest.approx(1.5, abs=0.03)
    effects = {(r.factor, r.level): r.effect for r in fit.effects.collect()}
    assert np.corrcoef([effects["a", f"a{i:02d}"] for i in range(60)], u)[0, 1] > 0.99
    assert np.corrcoef([effects["b", str(j)] for j in range(45)], v)[0, 1] > 0.98
    scored = fit.score(df.na.drop()).agg(F.avg(F.pow(F.col("y") - F.col("prediction"), 2))).first()[0]
    assert scored == pytest.approx(0.25, rel=0.1)


def test_crossed_solves_the_mixed_model_equations(spark):
    """Fixed and predicted effects against the dense equations with the same variances."""
    rows, _, _ = crossed_rows(seed=4, na=8, nb=6, n=150)
    df = spark.createDataFrame(rows, "a string, b long, x double, y double")
    fit = cr.crossed(df, "y", ["x"], "a", "b", tol=1e-14)
    names_a, names_b = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    x = np.array([[1.0, r[2]] for r in rows])
    z = np.hstack([np.array([[r[0] == n for n in names_a] for r in rows]), np.array([[r[1] == n for n in names_b] for r in rows])]).astype(float)
    y = np.array([r[3] for r in rows])
    w = np.hstack([x, z])
    penalty = np.diag([0.0, 0.0, *[fit.variances["residual"] / fit.variances["a"]] * len(names_a), *[fit.variances["residual"] / fit.variances["b"]] * len(names_b)])
    want = np.linalg.solve(w.T @ w + penalty, w.T @ y)
    assert [fit.intercept, *fit.beta] == pytest.approx(want[:2], abs=1e-5)
    effects = {(r.factor, r.level): r.effect for r in fit.effects.collect()}
    assert [effects["a", n] for n in names_a] + [effects["b", str(n)] for n in names_b] == pytest.approx(want[2:], abs=1e-5)


def test_crossed_sweeps_leave_the_cells_alone(spark, monkeypatch):
    """With few levels of one factor, the first or the second, jobs don't grow with the sweeps; both ways solve the same equations."""
    monkeypatch.setattr(cr, "FEW_LEVELS", 50, raising=False)
    rows, _, _ = crossed_rows(seed=5, na=90, nb=7, n=1500, sa=1.0)
    df = spark.createDataFrame(rows, "a string, b long, x double, y double")
    found = []
    for a, b in (("a", "b"), ("b", "a")):
        spark.sparkContext.setJobGroup(f"sweeps {a}", "")
        fit = cr.crossed(df, "y", ["x"], a, b, tol=1e-14)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"sweeps {a}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert fit.sweeps > 4 and jobs < 45
        found.append((fit, {(r.factor, r.level): (r.rows, r.effect) for r in fit.effects.collect()}))
    (one, effects), (two, others) = found
    assert one.variances == pytest.approx(two.variances, rel=1e-5) and one.beta == pytest.approx(two.beta, rel=1e-5)
    assert effects.keys() == others.keys() and len(effects) == 97
    assert all(effects[k] == pytest.approx(others[k], abs=1e-4) for k in effects)


def test_crossed_components_without_an_effect(spark):
    rows, _, _ = crossed_rows(seed=9, sb=0.0)
    df = spark.createDataFrame(rows, "a string, b long, x double, y double")
    got = {r.component: r.variance for r in cr.crossed_components(df, "y", ["x"], "a", "b").collect()}
    assert 0 <= got["b"] < 0.02 and got["residual"] == pytest.approx(0.25, rel=0.1)
    fit = cr.crossed(df, "y", [], "a", "b")
    assert len(fit.fixed.collect()) == 1
