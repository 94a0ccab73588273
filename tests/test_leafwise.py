"""Boosted trees against a plain best-first version that looks at every cut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabstat.operators import leafwise as lw
from tabstat.operators import linear as ln
from tabstat.operators import trees


def table(spark, n=250):
    rng = np.random.default_rng(3)
    a, b, c = rng.integers(0, 12, n).astype(float), rng.integers(0, 9, n).astype(float), rng.choice(["u", "v", "w"], n)
    y = np.where(a > 5, 3.0, 0.0) * (b > 3) + np.where(c == "v", 1.0, -1.0) + 0.3 * a + rng.normal(0, 0.3, n)
    k = np.where(y > 2.5, "hi", np.where(y < 0, "lo", "mid"))
    rows = [(i, float(p), float(q), str(r), float(v), str(w), str(w == "hi")) for i, (p, q, r, v, w) in enumerate(zip(a, b, c, y, k))]
    return spark.createDataFrame(rows, "id long, a double, b double, c string, y double, k string, two string").repartition(4)


def plain(x, y, task, rounds, rate, leaves, penalty, least_rows):
    """Predictions after some rounds; every leaf is split at its best cut, the one with the largest gain first."""
    start = y.mean() if task == "regression" else np.log(y.mean() / (1 - y.mean()))
    margin = np.full(len(y), start)
    for _ in range(rounds):
        g, h = lw.slopes(margin, y, task)

        def best(rows):
            top = (0.0, None, None)
            for j in range(x.shape[1]):
                for v in np.unique(x[rows, j])[:-1]:
                    left, right = rows[x[rows, j] <= v], rows[x[rows, j] > v]
                    if min(len(left), len(right)) < least_rows:
                        continue
                    gain = 0.5 * sum(g[s].sum()**2 / (h[s].sum() + penalty) for s in (left, right)) - 0.5 * g[rows].sum()**2 / (h[rows].sum() + penalty)
                    if gain > top[0] + 1e-9:
                        top = (gain, left, right)
            return top

        groups = [np.arange(len(y))]
        options = [best(groups[0])]
        while len(groups) < leaves:
            i = max(range(len(groups)), key=lambda k: options[k][0])
            if options[i][0] <= 0:
                break
            _, left, right = options.pop(i)
            groups.pop(i)
            groups += [left, right]
            options += [best(left), best(right)]
        for rows in groups:
            margin[rows] -= rate * g[rows].sum() / (h[rows].sum() + penalty)
    return margin


@pytest.mark.parametrize("task, leaves, penalty", [("regression", 6, 0.0), ("regression", 64, 1.0), ("classification", 5, 1.0)])
def test_boosting_equals_plain_best_first(spark, task, leaves, penalty, monkeypatch):
    monkeypatch.setattr(lw, "WRITTEN_EVERY", 2)
    df = table(spark)
    target = "y" if task == "regression" else "two"
    model = lw.boost(df, target, ["a", "b", "c"], task, rounds=3, rate=0.3, leaves=leaves, depth=6 if leaves < 64 else 3, penalty=penalty, least_rows=5, least_curve=0.0)
    rows = model.stages.transform(df).select("features", "y", "two").collect()
    x = np.array([r.features.toArray() for r in rows])
    y = np.array([r.y if task == "regression" else float(r.two == "True") for r in rows])
    if leaves < 64:
        assert np.allclose(model.margins(x)[:, 0], plain(x, y, task, 3, 0.3, leaves, penalty, 5), atol=1e-9)
    assert all(len([f for f in t.feature if f < 0]) >= 2 for t in model.trees[0])
    for losses in model.losses:
        assert len(losses) == 4 and all(b < a for a, b in zip(losses, losses[1:]))
    margin = model.margins(x)[:, 0]
    loss = ((margin - y)**2 / 2).mean() if task == "regression" else np.logaddexp(0, np.where(y > 0, -margin, margin)).mean()
    assert model.losses[0][-1] == pytest.approx(loss)


def test_fit_prediction_and_contributions(spark):
    df = table(spark, 400)
    model = lw.boost(df, "y", ["a", "b", "c"], rounds=20, rate=0.3, least_rows=5)
    out = model.predict(df)
    assert out.columns == [*df.columns, "prediction"] and ln.fit_metrics(out, "y", "prediction").first().r2 > 0.9
    leaves = model.leaves()
    x = np.array([r.features.toArray() for r in model.stages.transform(df).select("features").collect()])
    phi = trees.contributions(x, leaves, 0)
    assert np.allclose(phi.sum(axis=1) + leaves.base[0] + model.start[0], model.margins(x)[:, 0], atol=1e-9)


def test_classes(spark):
    df = table(spark, 400)
    model = lw.boost(df, "k", ["a", "b", "c"], "classification", rounds=12, rate=0.3, least_rows=5)
    hit = model.predict(df).agg(F.avg((F.col("k") == F.col("prediction")).cast("double"))).first()[0]
    assert hit > 0.9 and len(model.trees) == 3


def test_many_values_are_cut_at_quantiles(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=2000)
    df = spark.createDataFrame([(float(v), float(np.sin(2 * v))) for v in x], "x double, y double").repartition(3)
    model = lw.boost(df, "y", ["x"], rounds=25, rate=0.3, bins=32)
    assert len(model.edges[0]) == 31
    counts = np.bincount(model.bins(((x - x.mean()) / x.std(ddof=1))[:, None])[:, 0], minlength=32)
    assert counts.min() > 50 and ln.fit_metrics(model.predict(df), "y", "prediction").first().r2 > 0.98
