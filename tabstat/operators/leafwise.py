"""Boosted trees by gradients and curvatures, grown where the gain is largest.

Features are cut into bins once. A level of a tree is one pass: every task sums gradients and curvatures per node, feature and bin,
and one line per occupied cell leaves it. All splits of a tree are known after its levels, so the splits that best-first growth
would make, and only those, are kept up to the wanted number of leaves. Margins are written down every few rounds; in
between a pass applies the trees since then.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabstat.operators.supervised import encode_target, fill_target, preprocessor
from tabstat.operators.trees import Leaf, Leaves
from tabstat.plans.order_stats import quantile_table
from tabstat.plans.stats import as_double, spread_out
from tabstat.session import need_checkpoint_dir

#: Bins of a feature at most.
BINS = 64
#: Rounds between two writings of the margins.
WRITTEN_EVERY = 8


@dataclass
class Tree:
    """Nodes in order of making; a leaf has feature -1. A row goes left if its bin is ``cut`` at most."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    rows: list[float] = field(default_factory=list)

    def add(self, value: float, rows: float) -> int:
        for column, x in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.right, -1), (self.value, value), (self.rows, rows)):
            column.append(x)
        return len(self.value) - 1

    def reached(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        at = np.zeros(len(bins), int)
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.cut, self.left, self.right))
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                return at
            f = feature[at[inner]]
            at[inner] = np.where(bins[inner, f] <= cut[at[inner]], left[at[inner]], right[at[inner]])


def slopes(margin: np.ndarray, label: np.ndarray, task: str) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss: squared error, or log loss of labels 0 and 1."""
    if task == "regression":
        return margin - label, np.ones(len(label))
    p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
    return p - label, np.maximum(p * (1 - p), 1e-16)


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, penalty: float, least_rows: int, least_curve: float) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best cut of one node from its histograms (features x bins); gain 0 if there is none.

    The gain of a cut is half of the sum over both sides of G^2 / (H + penalty), less that of the node.
    """
    left_g, left_h, left_n = (np.cumsum(x, axis=1)[:, :-1] for x in (g, h, n))
    all_g, all_h, all_n = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True), n.sum(axis=1, keepdims=True)
    fits = (left_n >= least_rows) & (all_n - left_n >= least_rows) & (left_h >= least_curve) & (all_h - left_h >= least_curve)
    gain = 0.5 * (left_g**2 / (left_h + penalty + 1e-300) + (all_g - left_g)**2 / (all_h - left_h + penalty + 1e-300) - all_g**2 / (all_h + penalty + 1e-300))
    gain = np.where(fits, gain, 0.0)
    at = int(gain.argmax())
    return float(gain.flat[at]), at // gain.shape[1], at % gain.shape[1]


@dataclass
class Boosted:
    """A fitted ensemble; ``losses`` are the mean training losses before each round and after the last."""

    task: str
    labels: list[str]
    stages: PipelineModel
    edges: list[np.ndarray]
    start: list[float]
    trees: list[list[Tree]]  # per machine: one for regression and two classes, else one per class
    rate: float
    losses: list[list[float]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)]).astype(np.uint8)

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        return np.column_stack([start + sum((self.rate * np.array(t.value)[t.reached(bins)] for t in trees), np.zeros(len(x))) for start, trees in zip(self.start, self.trees)])

    def predict(self, df: DataFrame) -> DataFrame:
        """Rows with ``prediction`` (label text for classifiers) and, for two classes, the probability of the last as ``score``."""
        rows = self.stages.transform(df).select(F.struct(*df.columns).alias("row"), vector_to_array("features").alias("x"))
        model, two = replace(self, stages=None), len(self.trees) == 1  # the stages stay on the driver
        kind = T.DoubleType() if self.task == "regression" else T.StringType()
        schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("prediction", kind), T.StructField("score", T.DoubleType())])

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                margin = model.margins(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                if model.task == "regression":
                    found = pa.array(margin[:, 0])
                else:
                    best = (margin[:, 0] >= 0).astype(int) if two else margin.argmax(axis=1)
                    found = pa.array([model.labels[k] for k in best], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), found, pa.array(1 / (1 + np.exp(-np.clip(margin[:, 0], -30, 30))))], ["row", "prediction", "score"])

        keep = ["prediction", "score"] if self.task == "classification" and two else ["prediction"]
        return rows.mapInArrow(scored, schema).select("row.*", *keep)

    def leaves(self, machine: int = 0) -> Leaves:
        """The leaves as boxes of feature values, for ``trees.contributions``; its base needs ``start`` added."""
        out = []
        for tree in self.trees[machine]:
            todo: list[tuple[int, dict]] = [(0, {})]
            while todo:
                at, path = todo.pop()
                f = tree.feature[at]
                if f < 0:
                    some = sorted(path)
                    low, high, share = (np.array([path[k][i] for k in some], float) for i in range(3))
                    out.append(Leaf(np.array(some, np.int64), low, high, np.full(len(some), -1), share, np.array([self.rate * tree.value[at]])))
                    continue
                low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
                cut = float(self.edges[f][tree.cut[at]])
                for child, sides in ((tree.left[at], (low, min(high, cut))), (tree.right[at], (max(low, cut), high))):
                    todo.append((child, path | {f: (*sides, share * tree.rows[child] / tree.rows[at])}))
        return Leaves(out, 1, len(self.edges))


def _edges(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Cuts of every feature: its values if they are few, else exact quantiles."""
    names = [f"x{i}" for i in range(width)]
    wide = rows.select(*[F.get("x", F.lit(i)).alias(n) for i, n in enumerate(names)])
    count = wide.agg(*[F.approx_count_distinct(n, 0.01).alias(n) for n in names]).first()
    few = [n for n in names if count[n] <= bins // 2]
    many = [n for n in names if n not in few]
    found = {}
    if few:
        row = wide.agg(*[F.collect_set(n).alias(n) for n in few]).first()
        found |= {n: np.array(sorted(row[n]))[:-1] for n in few}
    if many:
        for r in quantile_table(wide, many, [k / bins for k in range(1, bins)]).collect():
            found[r.variable] = np.unique([r[f"q_{k}"] for k in range(bins - 1)])
    return [found[n] for n in names]


def _state(rows: DataFrame, edges: list[np.ndarray], start: float) -> DataFrame:
    """(bins, label, margin) of every row."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(edges))
            found = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)]).astype(np.uint8) if len(x) else np.zeros((0, len(edges)), np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in found], pa.binary()), batch.column(1), pa.array(np.full(len(found), start))], ["bins", "label", "margin"])

    return rows.mapInArrow(cut, "bins binary, label double, margin double")


def _opened(batch: pa.RecordBatch, width: int, trees: list[Tree], rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins, label, margin) of a batch after the trees since the margins were written."""
    bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, width)
    margin = batch.column(2).to_numpy().copy()
    for tree in trees:
        margin += rate * np.array(tree.value)[tree.reached(bins)]
    return bins, batch.column(1).to_numpy(zero_copy_only=False), margin


def _histograms(state: DataFrame, width: int, bins: int, pending: list[Tree], rate: float, tree: Tree, level: list[int], task: str) -> tuple[np.ndarray, float]:
    """Sums (3, nodes, features, bins) of gradient, curvature and rows for the nodes of a level, and the loss of all rows."""
    place = {node: i for i, node in enumerate(level)}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss = np.zeros((3, len(level) * width * bins)), 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            x, label, margin = _opened(batch, width, pending, rate)
            g, h = slopes(margin, label, task)
            loss += float(((margin - label)**2 / 2).sum() if task == "regression" else np.logaddexp(0, np.where(label > 0, -margin, margin)).sum())
            node = np.array([place.get(k, -1) for k in range(len(tree.value))])[tree.reached(x)]
            some = node >= 0
            x, g, h, node = x[some], g[some], h[some], node[some]
            for j in range(width):
                cell = (node * width + j) * bins + x[:, j]
                for k, w in enumerate((g, h, None)):
                    total[k] += np.bincount(cell, w, total.shape[1])
        used = np.flatnonzero(total[2])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), *[pa.array(np.append(t[used], loss)) for t in total]], ["cell", "g", "h", "n"])

    found = state.mapInArrow(sums, "cell long, g double, h double, n double").groupBy("cell").agg(*[F.sum(c).alias(c) for c in "ghn"]).toPandas()
    out = np.zeros((3, len(level) * width * bins))
    cells = found[found["cell"] >= 0]
    out[:, cells["cell"].to_numpy()] = cells[["g", "h", "n"]].to_numpy().T
    return out.reshape(3, len(level), width, bins), float(found.loc[found["cell"] < 0, "g"].sum())


def _grown(state: DataFrame, width: int, bins: int, pending: list[Tree], rate: float, task: str, leaves: int, depth: int, penalty: float, least_rows: int,
           least_curve: float, least_gain: float) -> tuple[Tree, float]:
    """One tree, and the loss before it."""
    tree, level, splits, loss = Tree(), [0], {}, 0.0
    tree.add(0.0, 0.0)
    for d in range(depth + 1):
        sums, all_loss = _histograms(state, width, bins, pending, rate, tree, level, task)
        loss = all_loss if d == 0 else loss
        below = []
        for i, node in enumerate(level):
            g, h, n = sums[:, i]
            tree.value[node] = -float(g[0].sum()) / (float(h[0].sum()) + penalty + 1e-300)
            tree.rows[node] = float(n[0].sum())
            gain, f, cut = best_split(g, h, n, penalty, least_rows, least_curve) if d < depth else (0.0, 0, 0)
            if gain > least_gain:
                tree.feature[node], tree.cut[node] = f, cut
                tree.left[node], tree.right[node] = tree.add(0.0, 0.0), tree.add(0.0, 0.0)
                splits[node] = gain
                below += [tree.left[node], tree.right[node]]
        if not below:
            break
        level = below
    # best first: of the splits whose parents were made, the one with the largest gain is next
    kept, queue = set(), [(-splits[0], 0)] if 0 in splits else []
    while queue and len(kept) < leaves - 1:
        _, node = heapq.heappop(queue)
        kept.add(node)
        for child in (tree.left[node], tree.right[node]):
            if child in splits:
                heapq.heappush(queue, (-splits[child], child))
    for node in splits:
        if node not in kept:
            tree.feature[node] = -1
    return tree, loss


def boost(df: DataFrame, y: str, xs: Sequence[str], task: str = "regression", rounds: int = 100, rate: float = 0.1, leaves: int = 31, depth: int = 8, penalty: float = 0.0,
          least_rows: int = 20, least_curve: float = 1e-3, least_gain: float = 0.0, bins: int = BINS) -> Boosted:
    """Boosted trees on scaled numbers and one-hot levels.

    The defaults grow by leaves. ``leaves=2**depth`` grows whole levels (``depth=6, rate=0.3, penalty=1.0, least_rows=1, least_curve=1.0`` are the other common
    setting). ``depth`` bounds the passes of a tree. More than two classes get one machine each; the largest margin wins.
    """
    if not 2 <= bins <= 256:
        raise ValueError("2 to 256 bins")
    need_checkpoint_dir(df.sparkSession)
    labels: list[str] = []
    if task == "regression":
        data = fill_target(df, y).withColumn("label", as_double(y))
    else:
        data, labels = encode_target(df, y)
        if len(labels) < 2:
            raise ValueError("two classes at least")
    stages = Pipeline(stages=preprocessor(data, xs)).fit(data)
    rows = spread_out(stages.transform(data).select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"))).persist()
    machines, losses, starts = [], [], []
    try:
        width = len(rows.first()["x"])
        edges = _edges(rows, width, bins)
        for k in range(1) if task == "regression" else (range(1, 2) if len(labels) == 2 else range(len(labels))):
            own = rows if task == "regression" else rows.withColumn("label", (F.col("label") == k).cast("double"))
            mean, n = own.agg(F.avg("label"), F.count(F.lit(1))).first()
            start = float(mean) if task == "regression" else float(np.log(mean / (1 - mean)))
            state, pending, made, lost = _state(own, edges, start).checkpoint(), [], [], []
            for r in range(rounds):
                tree, loss = _grown(state, width, bins, pending, rate, task, leaves, depth, penalty, least_rows, least_curve, least_gain)
                lost.append(loss / n)
                made.append(tree)
                pending.append(tree)
                if len(pending) == WRITTEN_EVERY and r + 1 < rounds:
                    state, pending = _written(state, width, pending, rate).checkpoint(), []
            _, loss = _histograms(state, width, bins, pending, rate, Tree([-1], [0], [-1], [-1], [0.0], [0.0]), [], task)
            machines.append(made)
            losses.append([*lost, loss / n])
            starts.append(start)
    finally:
        rows.unpersist()
    return Boosted(task, labels, stages, edges, starts, machines, rate, losses)


def _written(state: DataFrame, width: int, trees: list[Tree], rate: float) -> DataFrame:
    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_opened(batch, width, trees, rate)[2])], ["bins", "label", "margin"])

    return state.mapInArrow(moved, "bins binary, label double, margin double")
