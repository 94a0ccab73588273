"""Support vector machines with a Gaussian kernel, for tables of any length.

The kernel matrix of n rows is never formed. Seeded random Fourier features (Rahimi and Recht 2007) stand for the kernel:
products of two rows' features are unbiased for exp(-gamma * squared distance), with a deviation of at most 1 / sqrt(features / 2). In these
features the machines are linear, with squared hinge or squared epsilon-insensitive losses, whose minimum Newton steps reach in a
few passes: a pass sums the cross products of the rows beyond the margin, one small matrix per task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabstat.operators.linear import fit_metrics
from tabstat.operators.supervised import class_metrics, encode_target, fill_target, hash_share, preprocessor
from tabstat.plans.stats import as_double, spread_out

FEATURES = 256
#: Passes of Newton's method at most.
STEPS = 30
#: Rows whose cross products are formed at once, and rows whose cosines are, which stay in a core's cache.
BLOCK_ROWS, COSINE_ROWS = 4096, 128
#: Coefficients of cos(pi t) in the square of t, highest first, for t of 1/2 at most.
SERIES = [(-1) ** k * math.pi ** (2 * k) / math.factorial(2 * k) for k in range(10, -1, -1)]


def cosines(turns: np.ndarray, scale: float, out: np.ndarray) -> None:
    """``scale`` * cos(2 pi ``turns``) to the last digits, some times faster than one by one; ``turns`` is overwritten.

    The cosine of half the angle comes from its series, after whole turns are taken off; that of the angle is 2 cos**2 - 1.
    """
    turns -= np.rint(turns)
    turns *= turns
    c = turns * SERIES[0]
    for more in SERIES[1:-1]:
        c += more
        c *= turns
    c += SERIES[-1]
    c *= c
    c *= 2 * scale
    np.subtract(c, scale, out=out)


@dataclass(frozen=True)
class Fourier:
    """cos(x @ frequencies + phases), scaled; without frequencies the inputs themselves. The last column is 1."""

    frequencies: np.ndarray | None
    phases: np.ndarray | None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.frequencies is None:
            return np.column_stack([x, np.ones(len(x))])
        out, scale = np.ones((len(x), len(self.phases) + 1)), np.sqrt(2 / len(self.phases))
        frequencies, phases = self.frequencies / (2 * np.pi), self.phases / (2 * np.pi)
        for at in range(0, len(x), COSINE_ROWS):
            turns = x[at:at + COSINE_ROWS] @ frequencies
            turns += phases
            cosines(turns, scale, out[at:at + COSINE_ROWS, :-1])
        return out


def fourier(inputs: int, gamma: float, features: int = FEATURES, seed: int = 42) -> Fourier:
    """Features whose products approximate the Gaussian kernel exp(-gamma * squared distance)."""
    rng = np.random.default_rng(seed)
    return Fourier(rng.normal(0, np.sqrt(2 * gamma), (inputs, features)), rng.uniform(0, 2 * np.pi, features))


@dataclass
class KernelMachine:
    task: str
    labels: list[str]
    stages: PipelineModel
    map: Fourier
    weights: np.ndarray  # one line per machine: one for regression or two classes, else one per class
    passes: int

    def predict(self, df: DataFrame) -> DataFrame:
        """Rows with ``prediction`` (label text for classifiers) and, for two classes, the margin of the last as ``score``."""
        rows = self.stages.transform(df).select(F.struct(*df.columns).alias("row"), vector_to_array("features").alias("x"))
        two, machine = len(self.weights) == 1, replace(self, stages=None)  # the stages stay on the driver
        kind = T.DoubleType() if self.task == "regression" else T.StringType()
        schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("prediction", kind), T.StructField("score", T.DoubleType())])

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK_ROWS):
                    part = batch.slice(at, BLOCK_ROWS)
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    margin = machine.map(x) @ machine.weights.T
                    if machine.task == "regression":
                        found = pa.array(margin[:, 0])
                    else:
                        best = (margin[:, 0] >= 0).astype(int) if two else margin.argmax(axis=1)
                        found = pa.array([machine.labels[k] for k in best], pa.string())
                    yield pa.RecordBatch.from_arrays([part.column(0), found, pa.array(margin[:, 0])], ["row", "prediction", "score"])

        keep = ["prediction", "score"] if self.task == "classification" and two else ["prediction"]
        return rows.mapInArrow(scored, schema).select("row.*", *keep)


def _pass(rows: DataFrame, mapped: Fourier, weights: np.ndarray, wanted: str, epsilon: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Cross products and right-hand side of the rows beyond the margin, and the loss, at the given weights."""
    size = len(weights)
    upper = np.triu_indices(size)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right, loss = np.zeros((size, size)), np.zeros(size), 0.0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                y = part.column(1).to_numpy(zero_copy_only=False)
                z = mapped(part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
                gap = y - z @ weights
                if wanted == "hinge":
                    active, goal = y * gap > 0, y  # y (y - f) = 1 - y f
                else:
                    active, goal = np.abs(gap) > epsilon, y - epsilon * np.sign(gap)
                z, goal = z[active], goal[active]
                gram += z.T @ z
                right += z.T @ goal
                loss += float(((goal - z @ weights) ** 2).sum())
        values = np.concatenate([gram[upper], right, [loss]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["k", "v"])

    table = rows.mapInArrow(sums, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    values = np.zeros(len(upper[0]) + size + 1)
    values[table["k"].to_numpy()] = table["v"].to_numpy()
    gram = np.zeros((size, size))
    gram[upper] = values[:len(upper[0])]
    gram = gram + np.triu(gram, 1).T
    return gram, values[len(upper[0]):-1], values[-1]


def _solve(rows: DataFrame, mapped: Fourier, size: int, c: float, wanted: str, epsilon: float) -> tuple[np.ndarray, int]:
    """Minimum of half the squared weights plus ``c`` times the losses; the last weight, the intercept, is free."""
    ridge = np.append(np.ones(size - 1), 0.0)
    weights, best, tried = np.zeros(size), None, 0
    at, step = weights, np.zeros(size)
    for tried in range(1, STEPS + 1):
        gram, right, loss = _pass(rows, mapped, at, wanted, epsilon)
        value = 0.5 * float(ridge @ at**2) + c * loss
        if best is not None and value > best * (1 + 1e-12):  # too far: half the step
            step = step / 2
            at = weights + step
            if np.abs(step).max() < 1e-10:
                break
            continue
        if best is not None and best - value <= 1e-9 * max(best, 1e-300):
            weights = at
            break
        weights, best = at, value
        step = np.linalg.solve(np.diag(ridge + 1e-10) + 2 * c * gram, 2 * c * right) - weights
        at = weights + step
    return weights, tried


def kernel_machine(df: DataFrame, y: str, xs: Sequence[str], task: str = "regression", kernel: str = "rbf", c: float = 1.0, gamma: float | None = None,
                   epsilon: float = 0.1, features: int = FEATURES, seed: int = 42) -> KernelMachine:
    """A support vector machine on scaled numbers and one-hot levels; ``gamma`` defaults to 1 / (inputs * their variance).

    ``kernel`` is rbf or linear. Losses are squared. More than two classes get one machine each, and the largest margin wins.
    """
    if kernel not in ("rbf", "linear"):
        raise ValueError("kernel is rbf or linear")
    labels: list[str] = []
    if task == "regression":
        data = fill_target(df, y).withColumn("label", as_double(y))
    else:
        data, labels = encode_target(df, y)
        if len(labels) < 2:
            raise ValueError("two classes at least")
    stages = Pipeline(stages=preprocessor(data, xs)).fit(data)
    rows = spread_out(stages.transform(data).select(vector_to_array("features").alias("x"), "label")).persist()
    try:
        inputs = len(rows.first()["x"])
        if gamma is None:
            total = F.aggregate("x", F.lit(0.0), lambda s, v: s + v)
            square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
            mean, mean_square = rows.agg(F.avg(total) / inputs, F.avg(square) / inputs).first()
            gamma = 1 / (inputs * max(mean_square - mean**2, 1e-12))
        mapped = fourier(inputs, gamma, features, seed) if kernel == "rbf" else Fourier(None, None)
        size = (features if kernel == "rbf" else inputs) + 1
        if task == "regression":
            found = [_solve(rows.select("x", "label"), mapped, size, c, "insensitive", epsilon)]
        else:
            sides = range(1, 2) if len(labels) == 2 else range(len(labels))
            found = [_solve(rows.select("x", F.when(F.col("label") == k, 1.0).otherwise(-1.0).alias("label")), mapped, size, c, "hinge", epsilon) for k in sides]
    finally:
        rows.unpersist()
    return KernelMachine(task, labels, stages, mapped, np.array([w for w, _ in found]), max(n for _, n in found))


#: The workbench's grid, fixed values.
GRID = {"c": [0.1, 1.0, 10.0], "kernel": ["linear", "rbf"]}


def kernel_grid(df: DataFrame, y: str, xs: Sequence[str], key: str, task: str = "regression", grid: Mapping[str, Sequence] | None = None, folds: int = 5, seed: int = 42) -> pd.DataFrame:
    """(c, kernel, score) of every setting: mean R2 or accuracy over folds that follow from the key, best first."""
    grid = grid or GRID
    fold = F.floor(hash_share(key, seed) * folds)
    out = []
    for kernel in grid["kernel"]:
        for c in grid["c"]:
            scores = []
            for k in range(folds):
                model = kernel_machine(df.where(fold != k), y, xs, task, kernel, c, seed=seed)
                scored = model.predict(df.where(fold == k))
                metrics = fit_metrics(scored, y, "prediction") if task == "regression" else class_metrics(scored, y, "prediction")
                scores.append(metrics.first()["r2" if task == "regression" else "accuracy"])
            out.append((c, kernel, float(np.mean(scores))))
    return pd.DataFrame(out, columns=["c", "kernel", "score"]).sort_values("score", ascending=False, kind="stable")
