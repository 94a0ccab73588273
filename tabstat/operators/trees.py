"""Contributions of single features to the predictions of trees, forests and boosted trees, for every row.

The value of a set of features is the prediction that follows the branches of known features and averages the two sides of the others
by the training rows that went there. For one leaf that value is a product over the features of its path: 1 or 0 for a known
feature (the row fits the path's interval or not), a fixed share for an unknown one. The Shapley value of a product is an
integral over a polynomial, which Gauss-Legendre nodes give exactly, so a leaf costs the number of its features and not
the number of their subsets. Leaves are a table of bounded size that goes to every task; rows are never shuffled.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import OneVsRestModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabstat.operators.supervised import Trained, feature_names
from tabstat.session import need_checkpoint_dir

#: Categories that a split's set can hold (Spark's default is 32 bins).
MOST_CATEGORIES = 63
#: Rows that are explained at once.
BATCH_ROWS = 1 << 15


@dataclass(frozen=True)
class Leaf:
    """One leaf as a box: for each feature of its path the interval (low, high], the allowed categories as bits, and the share of the rows that pass when it is unknown."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    allowed: np.ndarray
    share: np.ndarray
    value: np.ndarray  # one number per output, with the tree's weight


@dataclass(frozen=True)
class Leaves:
    leaves: list[Leaf]
    outputs: int
    slots: int

    @cached_property
    def limits(self) -> list[np.ndarray | None]:
        """Of each slot the limits of all intervals, ascending; None where categories are told apart."""
        found: list[set | None] = [set() for _ in range(self.slots)]
        for leaf in self.leaves:
            for f, low, high, allowed in zip(leaf.features, leaf.low, leaf.high, leaf.allowed):
                if allowed != -1:
                    found[f] = None
                elif found[f] is not None:
                    found[f] |= {v for v in (low, high) if np.isfinite(v)}
        return [None if v is None else np.array(sorted(v)) for v in found]

    @property
    def base(self) -> np.ndarray:
        """The prediction when nothing is known."""
        return np.sum([leaf.value * leaf.share.prod() for leaf in self.leaves], axis=0)


def _grown(nodes: dict, outputs: int, weight: float, output: int | None) -> list[Leaf]:
    """The leaves of one tree from its node rows by id."""
    found, todo = [], [(0, {})]
    while todo:
        at, path = todo.pop()
        node = nodes[at]
        if node.leftChild < 0:
            own = np.array(node.value, float) * weight
            value = own if output is None else np.zeros(outputs)
            if output is not None:
                value[output] = own[0]
            some = sorted(path)
            low, high, allowed, share = (np.array([path[f][k] for f in some], dtype) for k, dtype in enumerate((float, float, np.int64, float)))
            found.append(Leaf(np.array(some, np.int64), low, high, allowed, share, value))
            continue
        split, sides = node.split, (nodes[node.leftChild], nodes[node.rightChild])
        low, high, allowed, share = path.get(split.featureIndex, (-np.inf, np.inf, -1, 1.0))
        if split.numCategories < 0:
            cut = split.leftCategoriesOrThreshold[0]
            limits = (low, min(high, cut), allowed), (max(low, cut), high, allowed)
        else:
            if split.numCategories > MOST_CATEGORIES:
                raise ValueError(f"a split has {split.numCategories} categories; at most {MOST_CATEGORIES} can be explained")
            left = sum(1 << int(c) for c in split.leftCategoriesOrThreshold)
            limits = (low, high, allowed & left), (low, high, allowed & ~left)
        for child, limit, go in zip((node.leftChild, node.rightChild), limits, sides):
            todo.append((child, path | {split.featureIndex: (*limit, share * go.cover / node.cover)}))
    return found


def _nodes_of(spark: SparkSession, model) -> DataFrame:
    """(tree, id, leftChild, rightChild, split, cover, value) from the model's saved form."""
    need_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/trees-{uuid.uuid4().hex}"
    model.save(path)
    rows = spark.read.parquet(f"{path}/data")
    rows = rows.select(F.col("treeID").alias("tree"), "nodeData.*") if "treeID" in rows.columns else rows.withColumn("tree", F.lit(0))
    variance = "impurity" not in [p.name for p in model.params] or model.getOrDefault("impurity") == "variance"
    total = F.aggregate("impurityStats", F.lit(0.0), lambda s, x: s + x)
    cover = F.get("impurityStats", F.lit(0)) if variance else total
    value = F.array("prediction") if variance else F.transform("impurityStats", lambda x: x / total)
    return rows.select("tree", "id", "leftChild", "rightChild", "split", cover.alias("cover"), value.alias("value"))


def leaves_of(spark: SparkSession, model, slots: int) -> Leaves:
    """The leaves of a fitted Spark tree model; as many lines as the model has nodes come to the driver.

    Outputs are the prediction (regression), the margin of the last class (boosting), or the probability of each class.
    """
    parts = list(enumerate(model.models)) if isinstance(model, OneVsRestModel) else [(None, model)]
    leaves, outputs = [], 1
    for output, part in parts:
        trees: dict[int, dict] = {}
        for node in _nodes_of(spark, part).collect():
            trees.setdefault(node.tree, {})[node.id] = node
        weights = list(getattr(part, "treeWeights", [1.0]))
        if "Forest" in type(part).__name__:
            weights = [w / sum(weights) for w in weights]
        outputs = len(parts) if output is not None else len(trees[0][0].value)
        for k in sorted(trees):
            leaves += _grown(trees[k], outputs, weights[k], output)
    return Leaves(leaves, outputs, slots)


def leaf_contributions(holds: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley values of the product over features of 1 or 0 (known, by ``holds``) and ``share`` (unknown), one line per line of ``holds``."""
    nodes, weights = np.polynomial.legendre.leggauss(max(1, (len(share) + 1) // 2))
    out = np.zeros(holds.shape)
    for t, w in zip((nodes + 1) / 2, weights / 2):
        factors = t * holds + (1 - t) * share
        out += w * factors.prod(axis=1, keepdims=True) / factors
    return out * (holds - share)


def contributions(rows: np.ndarray, leaves: Leaves, output: int) -> np.ndarray:
    """One line per row, one column per slot: what each adds to the output beyond ``base``."""
    rows = np.where(np.isnan(rows), np.inf, rows)  # not a number goes right, as in Spark
    places, codes = _places(rows, leaves)
    cells = [np.ascontiguousarray(places[:, f]) for f in range(leaves.slots)]
    category = np.clip(places, 0, MOST_CATEGORIES).astype(np.int64)
    columns = np.zeros((leaves.slots, len(places)))
    for leaf in leaves.leaves:
        f, value = leaf.features, leaf.value[output]
        if not len(f) or value == 0:
            continue
        sides = []
        for k, slot in enumerate(f):
            own = (cells[slot] > leaf.low[k]) & (cells[slot] <= leaf.high[k])
            if leaf.allowed[k] != -1:
                own &= (leaf.allowed[k] >> category[:, slot] & 1).astype(bool)
            sides.append(own)
        if 1 << len(f) < len(places):  # fewer patterns than rows
            pattern = np.zeros(len(places), np.int64)
            for k, own in enumerate(sides):
                pattern += own.astype(np.int64) << k
            every = (np.arange(1 << len(f))[:, None] >> np.arange(len(f)) & 1).astype(float)
            found = value * leaf_contributions(every, leaf.share)
            for k, slot in enumerate(f):
                columns[slot] += found[:, k][pattern]
        else:
            columns[f] += value * leaf_contributions(np.column_stack(sides).astype(float), leaf.share).T
    return columns.T if codes is None else columns.T[codes]


def _places(rows: np.ndarray, leaves: Leaves) -> tuple[np.ndarray, np.ndarray | None]:
    """Rows that differ for some leaf, and which of them each row is like (None: itself).

    Leaves see of a row only between which of their limits it lies, so rows of one place have the same contributions.
    """
    place, several = np.zeros(len(rows), np.int64), 1
    for f, limits in enumerate(leaves.limits):
        if limits is None:  # categories are their own places
            found, own = np.unique(rows[:, f], return_inverse=True)
            size = len(found)
        else:
            own, size = np.searchsorted(limits, rows[:, f], side="left"), len(limits) + 1
        if several * size >= 1 << 62:
            place = np.unique(place, return_inverse=True)[1]
            several = len(rows)
        place = place * size + own
        several *= size
    first, codes = np.unique(place, return_index=True, return_inverse=True)[1:]
    if 2 * len(first) > len(rows):
        return rows, None
    return rows[first], codes


def shap_trees(trained: Trained, df: DataFrame, of: str | None = None, by_input: bool = False, prefix: str = "phi_") -> DataFrame:
    """``df`` with ``phi_<feature>`` for every feature slot, ``base`` and ``output``, which is their sum.

    ``output`` is the prediction of a regression, the probability of class ``of`` (default: the last) of a tree or forest, and the margin
    of a boosted classifier. Features are the slots of the prepared vector (levels of text columns are slots of their own);
    with ``by_input`` the slots of one input column are added up. Missing inputs are filled as in training.
    """
    *prepared, model = trained.model.stages
    names = feature_names(trained)
    leaves = leaves_of(df.sparkSession, model, len(names))
    output = leaves.outputs - 1 if of is None or leaves.outputs == 1 else trained.labels.index(of)
    data = df
    for stage in prepared:
        data = stage.transform(data)
    inputs: dict[str, list[int]] = {}
    for i, name in enumerate(names):
        inputs.setdefault(_input_of(name, df.columns) if by_input else name, []).append(i)
    base = float(leaves.base[output])

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def explained(x: pa.Array) -> pa.Array:
        """Only the features go to Python, whatever else is in a row."""
        parts = [np.zeros((0, len(inputs)))]
        for at in range(0, len(x), BATCH_ROWS):
            part = x.slice(at, BATCH_ROWS)
            phi = contributions(part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1), leaves, output)
            parts.append(np.column_stack([phi[:, slots].sum(axis=1) for slots in inputs.values()]))
        phi = np.concatenate(parts)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, phi.size + 1, phi.shape[1], dtype=np.int32)), pa.array(phi.ravel()))

    out = data.select(F.struct(*df.columns).alias("row"), explained(vector_to_array("features")).alias("phi"))
    total = F.aggregate("phi", F.lit(base), lambda s, x: s + x)
    return out.select("row.*", *[F.get("phi", F.lit(i)).alias(prefix + name) for i, name in enumerate(inputs)], F.lit(base).alias("base"), total.alias("output"))


def _input_of(slot: str, columns: list[str]) -> str:
    """The input column of a slot: the column itself, or the longest one that the slot's name continues."""
    return slot if slot in columns else max((c for c in columns if slot.startswith(c + "_")), key=len, default=slot)
