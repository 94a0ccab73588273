"""Forests that are grown on the sums of alike rows against Spark's forest on the rows."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from tabstat.operators import forest
from tabstat.operators import supervised as sv
from tabstat.operators import trees


def table(spark, n=6000):
    rng = np.random.default_rng(5)
    a, b, c = rng.normal(size=n), rng.integers(0, 4, n), rng.choice(["u", "v", "w"], n)
    y = a * (b > 1) + np.where(c == "v", 2.0, 0.0) + rng.normal(0, 0.3, n)
    rows = [(i, None if i % 997 == 0 else float(a[i]), int(b[i]), str(c[i]) if i % 499 else None, float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b int, c string, y double")


@pytest.fixture
def short(monkeypatch):
    """Cells are used for short tables too."""
    monkeypatch.setattr(forest, "LEAST_ROWS", 100)
    monkeypatch.setattr(forest, "ROWS_OF_CELL", 4)


def r2(model, df):
    return model.predict(df).agg(1 - F.avg((F.col("y") - F.col("prediction")) ** 2) / F.var_pop("y")).first()[0]


def test_trees_read_cells_and_not_rows(spark, short, monkeypatch, tmp_path):
    df, read, fit = table(spark), [], RandomForestRegressor._fit
    monkeypatch.setattr(RandomForestRegressor, "_fit", lambda self, data: read.append(data.count()) or fit(self, data))
    model = sv.train(df, "y", ["a", "b", "c"], "forest", params={"numTrees": 12, "maxDepth": 6})
    assert len(read) == 12 and max(read) <= 2 * 32 * 4 * 3  # two points a cell
    assert model.model.stages[-1].getNumTrees == 12 and model.model.stages[-1].getMaxDepth() == 6
    model.model.save(str(tmp_path / "model"))
    again = sv.Trained("forest", "regression", PipelineModel.load(str(tmp_path / "model")))
    assert r2(again, df) == pytest.approx(r2(model, df), abs=1e-12)


def test_forest_on_cells_is_as_good_as_on_rows(spark, monkeypatch):
    df, params = table(spark), {"numTrees": 30, "maxDepth": 6}
    train, test = df.where("id % 3 > 0"), df.where("id % 3 = 0")
    rows = sv.train(train, "y", ["a", "b", "c"], "forest", params=params)
    monkeypatch.setattr(forest, "LEAST_ROWS", 100)
    monkeypatch.setattr(forest, "ROWS_OF_CELL", 4)
    cells = sv.train(train, "y", ["a", "b", "c"], "forest", params=params)
    assert sv.feature_names(cells) == sv.feature_names(rows)
    of = [{r.feature: r.importance for r in sv.importances(spark, m).collect()} for m in (rows, cells)]
    assert of[0].keys() == of[1].keys() and all(abs(of[0][k] - of[1][k]) < 0.06 for k in of[0])
    assert r2(rows, test) > 0.75 and abs(r2(rows, test) - r2(cells, test)) < 0.03
    assert {type(s).__name__ for s in cells.model.stages} != {type(s).__name__ for s in rows.model.stages}
    again = sv.train(train, "y", ["a", "b", "c"], "forest", params=params)
    assert abs(r2(again, test) - r2(cells, test)) < 1e-9


def test_contributions_of_a_forest_on_cells_add_up(spark, short):
    df = table(spark)
    model = sv.train(df, "y", ["a", "b", "c"], "forest", params={"numTrees": 4, "maxDepth": 4})
    assert "Bucketizer" in {type(s).__name__ for s in model.model.stages}
    out = trees.shap_trees(model, model.predict(df))
    assert out.agg(F.max(F.abs(F.col("output") - F.col("prediction")))).first()[0] < 1e-9


def test_tree_of_cell_sums_is_the_tree_of_the_rows(spark):
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 8, 3000), rng.integers(0, 5, 3000)
    df = spark.createDataFrame([(float(x), float(z), float(x * z % 7 + e)) for x, z, e in zip(a, b, rng.normal(size=3000))], "a double, b double, label double")
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    want = DecisionTreeRegressor(maxDepth=4).fit(df)
    sums = df.groupBy((F.col("a") * 5 + F.col("b")).cast("long").alias("code"), "features").agg(
        F.count(F.lit(1)).cast("double").alias("w"), F.sum("label").alias("wy"), F.sum(F.col("label") ** 2).alias("wyy"))
    bags = forest.two_points(sums.withColumn("tree", F.explode(F.array(F.lit(0), F.lit(1)))))
    got = forest.grown(RandomForestRegressor(numTrees=2, maxDepth=4, featureSubsetStrategy="all", seed=1), bags, 2)
    pairs = got.transform(df).withColumnRenamed("prediction", "got").drop("rawPrediction")
    assert want.transform(pairs).agg(F.max(F.abs(F.col("got") - F.col("prediction")))).first()[0] < 1e-9
    assert np.allclose(got.featureImportances.toArray(), want.featureImportances.toArray())


def test_bags_hold_every_row_as_often_as_drawn(spark):
    df = spark.range(20_000).select((F.col("id") % 7 * 3).alias("code"), F.col("id").cast("double").alias("label"))
    sums = forest.bag_sums(df, np.arange(7) * 3, 20, 3).groupBy("tree").agg(F.sum("w").alias("w"), F.sum("wy").alias("wy"), F.count(F.lit(1)).alias("n")).collect()
    assert len(sums) == 20 and {r.n for r in sums} == {7} and len({r.w for r in sums}) > 10
    w = np.array([r.w for r in sums])
    assert abs(w.mean() - 20_000) < 150 and 60 < w.std() < 260  # about the root of 20,000
    assert abs(sum(r.wy for r in sums) / w.sum() - 9999.5) < 50


def test_many_cells_or_frequent_values_keep_the_rows(spark, short):
    wide = spark.range(4000).select(*[F.rand(i).alias(f"x{i}") for i in range(4)], F.rand(9).alias("y"))
    heavy = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.rand(1)).alias("x"), F.rand(9).alias("y"))
    for df, xs in ((wide, ["x0", "x1", "x2", "x3"]), (heavy, ["x"])):
        model = sv.train(df, "y", xs, "forest", params={"numTrees": 3, "maxDepth": 2})
        assert "Bucketizer" not in {type(s).__name__ for s in model.model.stages}
