"""Training, validation and scoring on Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import (Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer,
                                VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabstat.operators.cleaning import modes, zscore
from tabstat.operators.columns import columns_of
from tabstat.operators.derive import dummies
from tabstat.operators.forest import on_cells
from tabstat.plans.order_stats import quantile_table, with_ranges
from tabstat.plans.stats import as_double, bounded_rows, local_table, scalar_stats, spread_out


# --- splits and targets ----------------------------------------------------------

def hash_share(key: str, seed: int) -> Column:
    """Uniform number in [0, 1) that depends on the key and the seed only."""
    return (F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30))


def split(df: DataFrame, share: float, seed: int = 42, key: str | None = None,
          stratify: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test) with ``share`` in the test part.

    With a ``key`` the split is a function of the row, so lost and recomputed tasks
    give the same parts. ``stratify`` cuts each class at its own exact quantile.
    """
    if key is None:
        test, train = df.randomSplit([share, 1 - share], seed=seed)
        return train, test
    marked = df.withColumn("u__", hash_share(key, seed))
    limit = F.lit(share)
    if stratify is not None:
        cuts = bounded_rows(quantile_table(marked, ["u__"], [share], [stratify]), 1000, "classes")
        limit = F.lit(0.0)
        for r in cuts:
            limit = F.when(F.col(stratify) == r[stratify], r["q_0"]).otherwise(limit)
    inside = F.col("u__") < limit
    return marked.where(~inside).drop("u__"), marked.where(inside).drop("u__")


def fill_target(df: DataFrame, y: str) -> DataFrame:
    """Regression target: nulls become the mean."""
    m = scalar_stats(df, [F.avg(as_double(y)).alias("m")])["m"]
    return df.withColumn(y, F.coalesce(as_double(y), m))


def encode_target(df: DataFrame, y: str, new: str = "label", max_levels: int = 1000) -> tuple[DataFrame, list[str]]:
    """Classification target: null rows dropped, labels numbered in alphabetical order."""
    check_levels(df, [y], max_levels)
    data = df.where(F.col(y).isNotNull()).withColumn(y, F.col(y).cast("string"))
    model = StringIndexer(inputCol=y, outputCol=new, stringOrderType="alphabetAsc").fit(data)
    return model.transform(data), list(model.labels)


def check_levels(df: DataFrame, cols: Sequence[str], max_levels: int) -> None:
    """Refuse columns whose level table would not fit the driver (counted by a sketch)."""
    if not cols:
        return
    row = df.agg(*[F.approx_count_distinct(c).alias(f"d_{i}") for i, c in enumerate(cols)]).first()
    wide = [c for c, d in zip(cols, row) if d > 1.2 * max_levels]
    if wide:
        raise ValueError(f"more than {max_levels} levels in {wide}; raise the limit or recode first")


# --- preprocessing and models ----------------------------------------------------

def preprocessor(train: DataFrame, xs: Sequence[str], max_levels: int = 1000) -> list:
    """Stages fitted on the training part only: mean or mode filling, scaling, one-hot."""
    numeric = [x for x in xs if x in columns_of(train, ("numeric",))]
    text = [x for x in xs if x in columns_of(train, ("categorical",))]
    check_levels(train, text, max_levels)
    stages, inputs = [], []
    if numeric:
        casts = ", ".join(f"CAST(`{c}` AS DOUBLE) AS `{c}__n`" for c in numeric)
        stages.append(SQLTransformer(statement=f"SELECT *, {casts} FROM __THIS__"))
        stages.append(Imputer(strategy="mean", inputCols=[c + "__n" for c in numeric], outputCols=[c + "__i" for c in numeric]))
        stages.append(VectorAssembler(inputCols=[c + "__i" for c in numeric], outputCol="numbers__"))
        stages.append(StandardScaler(inputCol="numbers__", outputCol="scaled__", withMean=True, withStd=True))
        inputs.append("scaled__")
    if text:
        row = modes(train, text).first()
        fills = []
        for i, c in enumerate(text):
            mode = str(row[i] if row[i] is not None else "").replace("\\", "\\\\").replace("'", "\\'")
            fills.append(f"COALESCE(CAST(`{c}` AS STRING), '{mode}') AS `{c}__t`")
        stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(fills)} FROM __THIS__"))
        stages.append(StringIndexer(inputCols=[c + "__t" for c in text], outputCols=[c + "__x" for c in text],
                                    handleInvalid="keep", stringOrderType="alphabetAsc"))
        # a level not seen in training has its own slot, which is 0 in every training row and so adds nothing
        stages.append(OneHotEncoder(inputCols=[c + "__x" for c in text], outputCols=[c + "__o" for c in text], dropLast=False))
        inputs += [c + "__o" for c in text]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return stages


REGRESSORS = ("linear", "tree", "forest", "boosting")
CLASSIFIERS = ("logistic", "tree", "forest", "boosting", "svm")


def estimator(model: str, task: str, classes: int = 2, seed: int = 42):
    if task == "regression":
        return {"linear": lambda: LinearRegression(solver="normal"),
                "tree": lambda: DecisionTreeRegressor(maxDepth=5, seed=seed),
                "forest": lambda: RandomForestRegressor(numTrees=100, maxDepth=10, seed=seed),
                "boosting": lambda: GBTRegressor(maxIter=100, stepSize=0.1, maxDepth=5, seed=seed)}[model]()
    base = {"logistic": lambda: LogisticRegression(maxIter=1000, regParam=0.0, family="auto"),
            "tree": lambda: DecisionTreeClassifier(maxDepth=5, seed=seed),
            "forest": lambda: RandomForestClassifier(numTrees=100, maxDepth=10, seed=seed),
            "boosting": lambda: GBTClassifier(maxIter=100, stepSize=0.1, maxDepth=5, seed=seed),
            "svm": lambda: LinearSVC(maxIter=100, regParam=0.01, tol=1e-4)}[model]()
    return OneVsRest(classifier=base) if classes > 2 and model in ("boosting", "svm") else base


# grids of the workbench, fixed values; an unlimited depth is the deepest Spark allows
GRIDS = {
    "forest": {"numTrees": [100, 200], "maxDepth": [30, 10, 20]},
    "boosting": {"maxIter": [100, 200], "stepSize": [0.01, 0.1, 0.2]},
    "logistic": {"C": [0.01, 0.1, 1, 10]},
    "svm": {"C": [0.1, 1, 10]},
    "knn": {"k": [3, 5, 7]},
}


def param_grid(est, grid: Mapping[str, Sequence], n: int) -> list:
    """Grid for Spark ML; a penalty ``C`` becomes ``1 / (C * n)``."""
    inner = est.getClassifier() if isinstance(est, OneVsRest) else est
    builder = ParamGridBuilder()
    for name, values in grid.items():
        if name == "C":
            builder.addGrid(inner.regParam, [1.0 / (c * n) for c in values])
        else:
            builder.addGrid(inner.getParam(name), list(values))
    return builder.build()


@dataclass
class Trained:
    name: str
    task: str
    model: PipelineModel
    labels: list[str] = field(default_factory=list)
    best: dict = field(default_factory=dict)

    def predict(self, df: DataFrame) -> DataFrame:
        """Rows with ``prediction`` (label text for classifiers) and ``score`` of the last class if binary."""
        names = df.columns
        out = self.model.transform(df)
        if self.task == "regression":
            return out.select(*names, "prediction")
        table = F.array(*[F.lit(x) for x in self.labels])
        label = F.get(table, F.col("prediction").cast("int"))
        extra = []
        if len(self.labels) == 2:
            source = "probability" if "probability" in out.columns else "rawPrediction"
            extra = [F.get(vector_to_array(source), 1).alias("score")]
        return out.select(*names, label.alias("prediction"), *extra)


def train(df: DataFrame, y: str, xs: Sequence[str], model: str, task: str = "regression",
          grid: Mapping[str, Sequence] | None = None, folds: int = 5, seed: int = 42, parallelism: int = 4,
          params: Mapping[str, object] | None = None) -> Trained:
    """Fit one model on ``df``; with a grid, cross-validated on R2 or accuracy. ``params`` are set on the estimator first."""
    labels: list[str] = []
    if task == "regression":
        data = fill_target(df, y).withColumn("label", as_double(y))
    else:
        data, labels = encode_target(df, y)
    stages = preprocessor(data, xs)
    est = estimator(model, task, len(labels), seed)
    inner = est.getClassifier() if isinstance(est, OneVsRest) else est
    for name, value in (params or {}).items():
        inner.set(inner.getParam(name), value)
    prepared = Pipeline(stages=stages).fit(data)
    if isinstance(est, (RandomForestRegressor, GBTRegressor)) and not grid:
        fitted = on_cells(est, prepared, data, parallelism)
        if fitted is not None:
            return Trained(model, task, fitted, labels)
    features = spread_out(prepared.transform(data).select("features", "label")).persist()
    try:
        best = {}
        if grid:
            n = features.count()
            scorer = RegressionEvaluator(metricName="r2") if task == "regression" \
                else MulticlassClassificationEvaluator(metricName="accuracy")
            cv = CrossValidator(estimator=est, estimatorParamMaps=param_grid(est, grid, n), evaluator=scorer,
                                numFolds=folds, seed=seed, parallelism=parallelism)
            fitted = cv.fit(features)
            at = max(range(len(fitted.avgMetrics)), key=lambda i: fitted.avgMetrics[i])
            best = {p.name: v for p, v in cv.getEstimatorParamMaps()[at].items()} | {"score": fitted.avgMetrics[at]}
            fitted = fitted.bestModel
        else:
            fitted = est.fit(features)
    finally:
        features.unpersist()
    return Trained(model, task, PipelineModel(stages=[*prepared.stages, fitted]), labels, best)


def feature_names(trained: Trained) -> list[str]:
    """Input name of every slot of the feature vector."""
    names: list[str] = []
    for stage in trained.model.stages:
        if isinstance(stage, VectorAssembler) and stage.getOutputCol() == "numbers__":
            names += [c[:-3] for c in stage.getInputCols()]
        if hasattr(stage, "labelsArray"):
            for c, levels in zip(stage.getInputCols(), stage.labelsArray):
                names += [f"{c[:-3]}_{v}" for v in levels] + [f"{c[:-3]}_unknown"]
    return names


def importances(spark, trained: Trained) -> DataFrame:
    """(class, feature, importance), strongest first: tree importances or coefficients per class."""
    last, names = trained.model.stages[-1], feature_names(trained)

    def name(i: int) -> str:
        return names[i] if i < len(names) else f"slot_{i}"

    rows = []
    if hasattr(last, "featureImportances"):
        rows = [(None, name(i), float(v)) for i, v in enumerate(last.featureImportances.toArray())]
    elif hasattr(last, "coefficientMatrix"):
        matrix = last.coefficientMatrix.toArray()
        classes = trained.labels if len(matrix) == len(trained.labels) else trained.labels[-1:]
        rows = [(c, name(i), float(v)) for c, line in zip(classes, matrix) for i, v in enumerate(line)]
    elif hasattr(last, "coefficients"):
        rows = [(None, name(i), float(v)) for i, v in enumerate(last.coefficients.toArray())]
    out = local_table(spark, rows, "class string, feature string, importance double")
    return out.orderBy("class", F.abs("importance").desc())


# --- penalized logistic regression on the standardized scale -----------------------

@dataclass
class Logistic:
    table: DataFrame  # variable, coef, odds_ratio
    model: object
    scored: DataFrame


def logistic(df: DataFrame, y: str, xs: Sequence[str], c: float = 1.0) -> Logistic:
    """Binary logistic regression: dummies without the first level, z-scores (ddof 0), L2 penalty C.

    Fitted and scored on the same rows, as the workbench does.
    """
    data, names = df.select(*dict.fromkeys([y, *xs])).na.drop(), []
    for x in xs:
        if isinstance(df.schema[x].dataType, (T.StringType, T.BooleanType)):
            before = set(data.columns)
            data = dummies(data, x, drop_first=True)
            names += [n for n in data.columns if n not in before]
        else:
            names.append(x)
    data = zscore(data, names, ddof=0)
    data = VectorAssembler(inputCols=[n + "_z" for n in names], outputCol="features").transform(data)
    data = data.withColumn("label", as_double(y))
    fit_on = spread_out(data.select("features", "label")).persist()
    try:
        model = LogisticRegression(regParam=1.0 / (c * fit_on.count()), elasticNetParam=0.0, standardization=False,
                                   maxIter=1000, tol=1e-9).fit(fit_on)
    finally:
        fit_on.unpersist()
    coef = [float(v) for v in model.coefficients.toArray()]
    table = local_table(df.sparkSession, list(zip(names, coef)), "variable string, coef double") \
        .withColumn("odds_ratio", F.exp("coef"))
    scored = model.transform(data).withColumn("score", F.get(vector_to_array("probability"), 1)) \
        .drop("features", "rawPrediction", "probability", *[n + "_z" for n in names])
    return Logistic(table, model, scored)


# --- scores of predictions ---------------------------------------------------------

def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    """(label, prediction, n) counts of complete rows."""
    return df.select(F.col(label).cast("string").alias("label"), F.col(pred).cast("string").alias("prediction")) \
             .na.drop().groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, label: str, pred: str) -> DataFrame:
    """One row per label, one column per prediction, 0 filled."""
    return confusion(df, label, pred).groupBy("label").pivot("prediction").agg(F.sum("n")).na.fill(0)


def class_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """(class, precision, recall, f1, support) per class, plus macro and weighted averages; 0 for 0/0."""
    cells = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("given"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("given"),
                 F.lit(0).cast("bigint").alias("hit")))
    per = confusion(df, label, pred).select(F.inline(cells)).groupBy("class").agg(
        F.sum("actual").alias("support"), F.sum("given").alias("given"), F.sum("hit").alias("hit"))
    zero = F.lit(0.0)
    per = per.select("class",
                     F.coalesce(F.try_divide(F.col("hit"), F.col("given")), zero).alias("precision"),
                     F.coalesce(F.try_divide(F.col("hit"), F.col("support")), zero).alias("recall"),
                     F.coalesce(F.try_divide(2 * F.col("hit"), F.col("given") + F.col("support")), zero).alias("f1"),
                     "support")
    parts = ("precision", "recall", "f1")
    macro = per.agg(*[F.avg(c).alias(c) for c in parts], F.sum("support").alias("support"))
    weighted = per.agg(*[F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in parts],
                       F.sum("support").alias("support"))
    return per.unionByName(macro.withColumn("class", F.lit("macro avg"))) \
              .unionByName(weighted.withColumn("class", F.lit("weighted avg")))


def class_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """One row: accuracy and support-weighted precision, recall and F1."""
    report = class_report(df, label, pred)
    row = report.where(F.col("class") == "weighted avg")
    return row.select(F.col("recall").alias("accuracy"), "precision", "recall", "f1", F.col("support").alias("n"))


def _score_counts(df: DataFrame, label: str, score: str, positive) -> DataFrame:
    """(range, value, pos, neg, and those scored higher) per distinct score."""
    data = df.select((F.col(label) == F.lit(positive)).alias("hit"), as_double(score).alias("value")).na.drop()
    data = with_ranges(data, ["value"])
    counts = data.groupBy(F.col("value__range").alias("range"), "value").agg(
        F.sum(F.col("hit").cast("bigint")).alias("pos"), F.sum((~F.col("hit")).cast("bigint")).alias("neg"))
    per_range = counts.groupBy("range").agg(F.sum("pos").alias("rp"), F.sum("neg").alias("rn"))
    # one row per range, a few hundred in all
    down = Window.partitionBy(F.lit(0)).orderBy(F.col("range").desc())
    per_range = per_range.select("range", (F.sum("rp").over(down) - F.col("rp")).alias("bp"),
                                 (F.sum("rn").over(down) - F.col("rn")).alias("bn"),
                                 F.sum("rp").over(Window.partitionBy(F.lit(0))).alias("p_total"),
                                 F.sum("rn").over(Window.partitionBy(F.lit(0))).alias("n_total"))
    inside = Window.partitionBy("range").orderBy(F.col("value").desc())
    out = counts.withColumn("up", F.sum("pos").over(inside)).withColumn("un", F.sum("neg").over(inside))
    out = out.join(F.broadcast(per_range), "range")
    return out.select("value", "pos", "neg", (F.col("bp") + F.col("up")).alias("tp"),
                      (F.col("bn") + F.col("un")).alias("fp"), "p_total", "n_total")


def roc(df: DataFrame, label: str, score: str, positive) -> DataFrame:
    """(threshold, fpr, tpr): one point per distinct score, highest first."""
    c = _score_counts(df, label, score, positive)
    return c.select(F.col("value").alias("threshold"), F.try_divide(F.col("fp"), F.col("n_total")).alias("fpr"),
                    F.try_divide(F.col("tp"), F.col("p_total")).alias("tpr")).orderBy(F.col("threshold").desc())


def auc(df: DataFrame, label: str, score: str, positive) -> DataFrame:
    """Area under the curve by the trapezoid rule, from score counts."""
    c = _score_counts(df, label, score, positive)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / F.lit(2.0)))
    return c.agg(area.alias("area"), F.max("p_total").alias("p"), F.max("n_total").alias("n")) \
            .select("p", "n", F.try_divide(F.col("area"), F.col("p").cast("double") * F.col("n")).alias("auc"))


def comparison(results: Mapping[str, DataFrame]) -> DataFrame:
    """Metrics of several models in one table with a ``model`` column."""
    out = None
    for name, row in results.items():
        row = row.withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    return out


def kfold(df: DataFrame, y: str, xs: Sequence[str], model: str, task: str, k: int, key: str, seed: int = 42,
          stratify: str | None = None) -> DataFrame:
    """(fold, metric columns) of shuffled folds fixed by the key; one fit per fold.

    Folds come from a hash of the key, so every class is spread evenly over them and
    the ``stratify`` form only removes the remaining imbalance.
    """
    from tabstat.operators.linear import fit_metrics, fold_of
    fold = fold_of(key, k, seed)
    if stratify is not None:
        cuts = bounded_rows(quantile_table(df.withColumn("u__", hash_share(key, seed)), ["u__"],
                                           [i / k for i in range(1, k)], [stratify]), 1000, "classes")
        u, fold = hash_share(key, seed), F.lit(0)
        for r in cuts:
            place = sum(((u >= r[f"q_{i}"]).cast("int") for i in range(k - 1)), F.lit(0))
            fold = F.when(F.col(stratify) == r[stratify], place).otherwise(fold)
    data = df.withColumn("fold__", fold).persist()
    rows = []
    try:
        for i in range(k):
            fitted = train(data.where(F.col("fold__") != i), y, xs, model, task, seed=seed)
            scored = fitted.predict(data.where(F.col("fold__") == i))
            row = fit_metrics(scored, y, "prediction") if task == "regression" else class_metrics(scored, y, "prediction")
            row = row.withColumn("fold", F.lit(i))
            rows.append(row.first())  # one line of metrics per fold
    finally:
        data.unpersist()
    return local_table(df.sparkSession, rows, row.schema)
