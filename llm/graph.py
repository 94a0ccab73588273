"""Connected groups: inside one task with numpy, and of a whole edge table with Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstat.plans.graph import connected_components


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges (a, b): the smallest node of each one's group."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if np.array_equal(label, before):
            break
    while not np.array_equal(label[label], label):
        label = label[label]
    return label


def groups_of(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id of the group of every node that has an edge (a, b)."""
    return connected_components(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))) \
        .select(F.col("u").alias("id"), F.col("component").alias("label"))
