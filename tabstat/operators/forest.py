"""Regression forests and boosted trees of long tables, grown by Spark on the sums of alike rows.

Spark's forest sees of a row only the bins of its inputs, and of the rows of one bin in each input (a cell) only the sums of their weights, labels and
squared labels. One pass draws how often each row is in the bag of each tree, as Spark does, and adds these sums up by tree and cell; every tree is then
grown by Spark's estimator on the cells of its bag. Boosting takes the rows and the mean label of each cell: its gradients are linear in the label, and
the spread inside a cell, which all splits share, is in no gain. Where rows are few, or cells are not much fewer than rows, there is nothing to gain and the caller
grows the forest on the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer, OneHotEncoderModel, StandardScalerModel, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstat.plans.stats import spread_out

#: Below so many rows the forest is grown on the rows.
LEAST_ROWS = 1_000_000
#: Rows that a cell stands for, on average at least, and cells times trees at most (24 bytes each in a task).
ROWS_OF_CELL, MOST_SUMS = 64, 2_000_000
#: Cells of a task of boosting, about.
CELLS_OF_TASK = 100_000


def limits_of(df: DataFrame, names: Sequence[str], bins: int) -> dict[str, list[float]] | None:
    """Of each column the limits between its bins, from all rows: between all values where they are few, else quantiles. None where these do not tell ``bins`` apart."""
    if not names:
        return {}
    shares = [k / bins for k in range(1, bins)]
    row = df.agg(*[f for i, c in enumerate(names) for f in (F.approx_count_distinct(c).alias(f"n_{i}"), F.percentile_approx(c, shares, 10_000).alias(f"q_{i}"))]).first()
    few = [c for i, c in enumerate(names) if row[f"n_{i}"] <= 2 * bins]
    values = df.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in few]).first() if few else {}
    found = {}
    for i, c in enumerate(names):
        if c in few and len(values[c]) <= bins:
            v = values[c]
            found[c] = sorted({(a + b) / 2 for a, b in zip(v, v[1:])}) or list(v)
        else:
            found[c] = list(row[f"q_{i}"] or [])
            if len(set(found[c])) < bins - 1:  # a frequent value takes several quantiles
                return None
        if not found[c] or not np.isfinite(found[c]).all():
            return None
    return found


def bag_sums(df: DataFrame, codes: np.ndarray, trees: int, seed: int) -> DataFrame:
    """(tree, code, w, wy, wyy) of ``df`` (code, label): each row is in each tree's bag as often as a Poisson number of mean 1 says. ``codes`` are all codes, ascending."""
    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed % (1 << 63), TaskContext.get().partitionId()])
        sums = np.zeros((3, len(codes), trees))
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.searchsorted(codes, batch.column(0).to_numpy())
            order = np.argsort(cell, kind="stable")
            found, first = np.unique(cell[order], return_index=True)
            y = batch.column(1).to_numpy()[order, None]
            w = rng.poisson(1.0, (len(order), trees)).astype(float)
            for k in range(3):
                sums[k, found] += np.add.reduceat(w, first, axis=0)
                w *= y
        for tree in range(trees):
            some = np.flatnonzero(sums[0, :, tree])
            columns = [np.full(len(some), tree, np.int32), codes[some], *sums[:, some, tree]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["tree", "code", "w", "wy", "wyy"])

    parts = df.select("code", "label").mapInArrow(drawn, "tree int, code long, w double, wy double, wyy double")
    return parts.groupBy("tree", "code").agg(*[F.sum(c).alias(c) for c in ("w", "wy", "wyy")])


def two_points(sums: DataFrame) -> DataFrame:
    """``sums`` with two lines (label, weight) in place of each (w, wy, wyy); they have the same sums."""
    mean = F.col("wy") / F.col("w")
    spread = F.sqrt(F.greatest(F.col("wyy") / F.col("w") - mean * mean, F.lit(0.0)))
    points = sums.withColumns({"label": F.explode(F.array(mean - spread, mean + spread)), "weight": F.col("w") / 2})
    return points.drop("w", "wy", "wyy")


def on_cells(est: RandomForestRegressor | GBTRegressor, prepared: PipelineModel, data: DataFrame, parallelism: int = 4) -> PipelineModel | None:
    """The fitted stages with trees on binned inputs, or None where the trees are to be grown on the rows of ``data`` (with ``label``)."""
    boosting = isinstance(est, GBTRegressor)
    trees = 1 if boosting else est.getNumTrees()
    usual = est.getSubsamplingRate() == 1.0 and est.getMinInstancesPerNode() == 1 and not est.isSet(est.weightCol)
    if boosting:
        usual = usual and est.getLossType() == "squared" and not est.isSet(est.validationIndicatorCol)
    else:
        usual = usual and est.getBootstrap() and trees > 1
    if not usual or data.count() < LEAST_ROWS:
        return None
    numbers = [c for s in prepared.stages if isinstance(s, VectorAssembler) and s.getOutputCol() == "numbers__" for c in s.getInputCols()]
    indexes = {c: len(levels) + 1 for s in prepared.stages if isinstance(s, StringIndexerModel) for c, levels in zip(s.getOutputCols(), s.labelsArray)}
    encoders = [s for s in prepared.stages if isinstance(s, OneHotEncoderModel)]
    rows = spread_out(prepared.transform(data).select("label", *numbers, *indexes)).persist()
    try:
        limits = limits_of(rows, numbers, est.getMaxBins())
        if limits is None:
            return None
        binned = [c[:-3] + "__b" for c in numbers]
        sizes = {b: len(limits[c]) + 2 for b, c in zip(binned, numbers)} | indexes  # a bin more for what is not a number
        if np.prod([float(n) for n in sizes.values()]) >= 2.0 ** 62:
            return None
        bins, inputs = [], []
        if numbers:
            cuts = [[-np.inf, *limits[c], np.inf] for c in numbers]
            bins = [Bucketizer(inputCols=numbers, outputCols=binned, splitsArray=cuts, handleInvalid="keep")]
            inputs = [VectorAssembler(inputCols=binned, outputCol="numbers__")]
        joined = VectorAssembler(inputCols=[*[s.getOutputCol() for s in inputs], *[c for s in encoders for c in s.getOutputCols()]], outputCol="features")
        code = F.lit(0).cast("long")
        for c, n in sizes.items():
            code = code * n + F.col(c).cast("long")
        coded = PipelineModel(stages=bins).transform(rows).withColumn("code", code)
        most = min(rows.count() // ROWS_OF_CELL, MOST_SUMS // trees)
        if coded.agg(F.approx_count_distinct("code")).first()[0] > 1.2 * most:
            return None
        cells = coded.groupBy("code").agg(*[F.first(c).alias(c) for c in sizes])
        codes = np.sort(np.array([r[0] for r in cells.select("code").limit(most + 1).collect()], np.int64))
        if len(codes) > most:
            return None
        vectors = PipelineModel(stages=[*inputs, *encoders, joined]).transform(cells).select("code", "features")
        if boosting:
            forest = boosted(est, coded, vectors)
        else:
            bags = two_points(bag_sums(coded, codes, trees, est.getSeed()).join(vectors, "code"))
            forest = grown(est, bags, trees, parallelism)
    finally:
        rows.unpersist()
    stages: list = []
    for stage in prepared.stages:
        if isinstance(stage, VectorAssembler):
            stages += [*bins, *inputs] if stage.getOutputCol() == "numbers__" else [joined]
        elif not isinstance(stage, StandardScalerModel):
            stages.append(stage)
    return PipelineModel(stages=[*stages, forest])


def boosted(est: GBTRegressor, coded: DataFrame, vectors: DataFrame) -> GBTRegressionModel:
    """The boosted trees that Spark grows on the cells of ``coded`` (code, label), each with its rows and its mean label; ``vectors`` are (code, features)."""
    sums = coded.groupBy("code").agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    cells = sums.join(vectors, "code").select("code", "features", "label", "weight").persist()
    try:
        dealt = cells.repartitionByRange(max(1, cells.count() // CELLS_OF_TASK), "code").sortWithinPartitions("code")
        return est.copy({est.weightCol: "weight"}).fit(dealt.select("features", "label", "weight"))
    finally:
        cells.unpersist()


def grown(est: RandomForestRegressor, bags: DataFrame, trees: int, parallelism: int = 4) -> RandomForestRegressionModel:
    """One forest of the trees that Spark grows on each bag of ``bags`` (tree, code, features, label, weight)."""
    strategy = est.getFeatureSubsetStrategy()
    one = est.copy({est.numTrees: 1, est.bootstrap: False, est.weightCol: "weight", est.featureSubsetStrategy: "onethird" if strategy == "auto" else strategy})
    dealt = bags.repartition(trees, "tree").sortWithinPartitions("tree", "code", "label").persist()

    def tree(k: int) -> RandomForestRegressionModel:
        return one.copy({one.seed: est.getSeed() + k}).fit(dealt.where(F.col("tree") == k).select("features", "label", "weight").coalesce(1))

    pool = ThreadPool(max(1, min(parallelism, trees)))
    try:
        dealt.count()
        models = pool.map(inheritable_thread_target(bags.sparkSession)(tree), range(trees))
    finally:
        pool.close()
        dealt.unpersist()
    sc = bags.sparkSession.sparkContext
    kind = sc._jvm.org.apache.spark.ml.regression
    parts = sc._gateway.new_array(kind.DecisionTreeRegressionModel, trees)
    for k, model in enumerate(models):
        parts[k] = model._java_obj.trees()[0]
    forest = est._copyValues(est._create_model(kind.RandomForestRegressionModel(est.uid, parts, models[0].numFeatures)), {est.numTrees: trees})
    forest._transfer_params_to_java()
    return forest
