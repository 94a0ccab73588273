"""Contributions of features to tree predictions against the enumeration of all subsets."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabstat.operators import explain as ex
from tabstat.operators import supervised as sv
from tabstat.operators import trees


def table(spark, n=400):
    rng = np.random.default_rng(3)
    a, b, c = rng.normal(size=n), rng.integers(0, 5, n).astype(float), rng.choice(["u", "v", "w"], n)
    y = a * (b > 2) + np.where(c == "v", 2.0, 0.0) * a + rng.normal(0, 0.1, n)
    k = np.where(y > 0.5, "hi", np.where(y < -0.5, "lo", "mid"))
    rows = [(i, None if i % 37 == 0 else float(a[i]), float(b[i]), str(c[i]) if i % 41 else None, float(y[i]), str(k[i]), str(k[i] == "hi")) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, c string, y double, k string, two string")


def by_subsets(row, nodes, output):
    """Shapley values of one tree: branches of known features are followed, others averaged by cover."""
    def value(known, at=0):
        node = nodes[at]
        if node.leftChild < 0:
            return np.array(node.value)[output]
        left, right, f = nodes[node.leftChild], nodes[node.rightChild], node.split.featureIndex
        if f in known:
            s = node.split
            goes = row[f] <= s.leftCategoriesOrThreshold[0] if s.numCategories < 0 else row[f] in s.leftCategoriesOrThreshold
            return value(known, node.leftChild if goes else node.rightChild)
        return (left.cover * value(known, node.leftChild) + right.cover * value(known, node.rightChild)) / node.cover

    used = sorted({n.split.featureIndex for n in nodes.values() if n.leftChild >= 0})
    out, d = np.zeros(len(row)), len(used)
    for f in used:
        others = [g for g in used if g != f]
        for k in range(d):
            for s in itertools.combinations(others, k):
                weight = math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d)
                out[f] += weight * (value({*s, f}) - value(set(s)))
    return out, value(set())


@pytest.mark.parametrize("kind, task", [("tree", "regression"), ("forest", "regression"), ("boosting", "regression"), ("forest", "classification"), ("boosting", "classification")])
def test_contributions_add_up_and_equal_subsets(spark, kind, task):
    df = table(spark)
    y = "y" if task == "regression" else ("k" if kind == "forest" else "two")
    params = {"tree": {"maxDepth": 3}, "forest": {"numTrees": 4, "maxDepth": 3}, "boosting": {"maxIter": 3, "maxDepth": 3}}[kind]
    model = sv.train(df, y, ["a", "b", "c"], kind, task, params=params)
    *prepared, last = model.model.stages
    names = sv.feature_names(model)
    out = trees.shap_trees(model, df).orderBy("id")
    assert out.columns == [*df.columns, *["phi_" + n for n in names], "base", "output"]
    vectors = df
    for stage in prepared:
        vectors = stage.transform(vectors)
    scored = last.transform(vectors).orderBy("id")
    if task == "regression":
        want = scored.select("prediction")
    else:
        want = scored.select(F.get(vector_to_array("probability" if kind == "forest" else "rawPrediction"), -1 + (3 if kind == "forest" else 2)))
    rows = out.collect()
    assert np.allclose([r.output for r in rows], [r[0] for r in want.collect()], atol=1e-9)

    nodes = {}
    for n in trees._nodes_of(spark, last).collect():
        nodes.setdefault(n.tree, {})[n.id] = n
    weights = list(getattr(last, "treeWeights", [1.0]))
    weights = [w / sum(weights) for w in weights] if kind == "forest" else weights
    output = len(next(iter(nodes.values()))[0].value) - 1
    x = [list(r[0]) for r in scored.select("features").limit(25).collect()]
    for i, row in enumerate(x):
        parts = [by_subsets(row, nodes[t], output) for t in sorted(nodes)]
        phi = sum(w * p for w, (p, _) in zip(weights, parts))
        assert np.allclose([rows[i]["phi_" + n] for n in names], phi, atol=1e-9)
        assert rows[i].base == pytest.approx(sum(w * b for w, (_, b) in zip(weights, parts)), abs=1e-9)


def test_classes_inputs_and_tables_of_contributions(spark):
    df = table(spark, 300)
    model = sv.train(df, "k", ["a", "b", "c"], "forest", "classification", params={"numTrees": 5, "maxDepth": 9})
    classes = [trees.shap_trees(model, df, of=c, by_input=True) for c in model.labels]
    assert classes[0].columns[-5:] == ["phi_a", "phi_b", "phi_c", "base", "output"]
    parts = [c.orderBy("id").collect() for c in classes]
    for rows in zip(*parts):  # probabilities add to one, and what moves one class moves the others
        assert sum(r.output for r in rows) == pytest.approx(1, abs=1e-9)
        assert sum(r.phi_a for r in rows) == pytest.approx(0, abs=1e-9)
    assert {r.feature for r in ex.global_importance(classes[1], ["a", "b", "c"]).collect()} == {"a", "b", "c"}
    one = ex.explain_row(classes[1], "id", 7, ["a", "b", "c"]).collect()
    assert one[0].prediction == pytest.approx(parts[1][7].output, abs=1e-9)


def test_boosting_of_many_classes_has_a_margin_for_each(spark):
    df = table(spark, 200)
    model = sv.train(df, "k", ["a", "b"], "boosting", "classification", params={"maxIter": 2, "maxDepth": 2})
    for i, label in enumerate(model.labels):
        *prepared, last = model.model.stages
        data = df
        for stage in prepared:
            data = stage.transform(data)
        raw = last.models[i].transform(data).orderBy("id").select(F.get(vector_to_array("rawPrediction"), F.lit(1))).collect()
        got = trees.shap_trees(model, df, of=label).orderBy("id").collect()
        assert np.allclose([r.output for r in got], [r[0] for r in raw], atol=1e-9)


def test_deep_paths_use_the_same_values():
    """Rows directly and patterns by table are the same numbers."""
    rng = np.random.default_rng(1)
    share = rng.uniform(0.05, 1, 12)
    holds = (rng.random((50, 12)) < 0.5).astype(float)
    phi = trees.leaf_contributions(holds, share)
    assert np.allclose(phi.sum(axis=1), holds.prod(axis=1) - share.prod())
    few = trees.leaf_contributions(holds[:, :3], share[:3])
    for row, got in zip(holds[:, :3], few):
        def value(known):
            return math.prod(row[j] if j in known else share[j] for j in range(3))
        for f in range(3):
            want = sum((math.factorial(len(s)) * math.factorial(2 - len(s)) / 6) * (value({*s, f}) - value(set(s)))
                       for k in range(3) for s in itertools.combinations([j for j in range(3) if j != f], k))
            assert got[f] == pytest.approx(want)


def test_rows_of_one_place_are_explained_once(monkeypatch):
    """Leaves see of a row only between which limits it lies; many rows cost no more than their places."""
    rng = np.random.default_rng(12)
    some = []
    for _ in range(30):
        f = np.sort(rng.choice(4, 3, replace=False))
        allowed = np.where(f == 3, 5, -1)
        low, high = (np.where(f == 3, end, rng.choice(cuts, 3)) for end, cuts in ((-np.inf, [-np.inf, -0.5]), (np.inf, [0.5, np.inf])))
        some.append(trees.Leaf(f, low, high, allowed, rng.random(3), rng.normal(size=1)))
    leaves = trees.Leaves(some, 1, 4)
    rows = np.column_stack([rng.normal(size=(4000, 3)), rng.integers(0, 4, 4000)])
    rows[7, 0], rows[8, 1], rows[9, 2] = np.nan, 0.5, -0.5
    one_by_one = np.vstack([trees.contributions(r[None], leaves, 0) for r in rows[:300]])
    assert np.allclose(trees.contributions(rows, leaves, 0)[:300], one_by_one, atol=1e-12)
    sizes = []
    real = trees.leaf_contributions
    monkeypatch.setattr(trees, "leaf_contributions", lambda holds, share: sizes.append(len(holds)) or real(holds, share))
    places, codes = trees._places(np.where(np.isnan(rows), np.inf, rows), leaves)
    assert len(places) <= 3**3 * 4 and len(codes) == 4000
    assert np.allclose(trees.contributions(rows, leaves, 0), trees.contributions(places, leaves, 0)[codes], atol=1e-12)
    assert max(sizes) <= 8
