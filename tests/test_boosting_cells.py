"""Boosted trees of long tables: grown on cells they are the trees of the rows."""

import numpy as np
import pytest
from pyspark.ml import Pipeline

from tabstat.operators import forest, supervised as sv, trees


def table(spark, n=6000):
    rng = np.random.default_rng(4)
    a, b, c = rng.integers(0, 9, n), rng.integers(0, 5, n), rng.integers(0, 3, n)
    y = a * 2.0 + (b > 2) * 7 * (c == 1) + rng.normal(size=n)
    rows = [(float(x) if x else None, int(z), "uvw"[k] if k else None, float(v)) for x, z, k, v in zip(a, b, c, y)]
    return spark.createDataFrame(rows, "a double, b int, c string, y double")


@pytest.mark.parametrize("params", [{"maxIter": 6, "maxDepth": 3}, {"maxIter": 3, "maxDepth": 4, "minInfoGain": 0.05}])
def test_boosting_on_cells_is_boosting_on_rows(spark, monkeypatch, params):
    df = table(spark)
    rows = sv.train(df, "y", ["a", "b", "c"], "boosting", params=params)
    monkeypatch.setattr(forest, "LEAST_ROWS", 100)
    monkeypatch.setattr(forest, "ROWS_OF_CELL", 8)
    cells = sv.train(df, "y", ["a", "b", "c"], "boosting", params=params)
    assert cells.model.stages[-1].getNumTrees == rows.model.stages[-1].getNumTrees
    assert ["Bucketizer" in {type(s).__name__ for s in m.model.stages} for m in (cells, rows)] == [True, False]
    names = ["a", "b", "c", "y"]
    got, want = (np.array(sorted(tuple(map(str, r[:4])) + (r[4],) for r in m.predict(df).select(*names, "prediction").collect()), object)[:, 4].astype(float) for m in (cells, rows))
    assert np.abs(got - want).max() < 1e-8
    out = trees.shap_trees(cells, cells.predict(df), by_input=True).select("phi_a", "phi_b", "phi_c", "base", "prediction", "output").toPandas().to_numpy()
    assert np.abs(out[:, :4].sum(axis=1) - out[:, 4]).max() < 1e-8 and np.abs(out[:, 4] - out[:, 5]).max() < 1e-8


def test_unusual_boosting_stays_on_the_rows(spark, monkeypatch):
    monkeypatch.setattr(forest, "LEAST_ROWS", 100)
    df = table(spark, 500).withColumnRenamed("y", "label")
    prepared = Pipeline(stages=sv.preprocessor(df, ["a", "b"])).fit(df)
    for name, value in (("subsamplingRate", 0.5), ("lossType", "absolute"), ("minInstancesPerNode", 5)):
        est = sv.estimator("boosting", "regression")
        assert forest.on_cells(est.copy({est.getParam(name): value}), prepared, df) is None
