"""Bottom-up grouping by Ward's criterion, for tables of any length.

Full linkage needs all pairs of rows. Here rows become at most ``leaves`` summaries first (number of rows, mean), which add up over
tasks; the linkage of the summaries then is Ward's own, with their sizes as weights, by nearest-neighbour chains. A table with
no more distinct rows than leaves is linked exactly. Only summaries reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabstat.operators.clustering import scaled, scaling, to_numbers
from tabstat.plans.stats import local_table

#: Summaries that are linked: their distances are one matrix on the driver.
LEAVES = 1500
#: Rows whose distances to all leaves are computed at once.
BLOCK_ROWS = 2000


def ward_steps(centres: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(left, right, height, size) of every merge, by height; leaves are 0..n-1, step k makes group n + k.

    The height of two groups is sqrt(2 a b / (a + b)) times the distance of their means, which for single rows is
    their distance. A chain follows nearest neighbours until two are each other's; merging those first changes no result.
    """
    n = len(centres)
    size = sizes.astype(float)
    square = (centres ** 2).sum(axis=1)
    apart = np.maximum(square[:, None] + square[None, :] - 2 * centres @ centres.T, 0) * (2 * size[:, None] * size[None, :] / (size[:, None] + size[None, :]))
    np.fill_diagonal(apart, np.inf)
    alive, chain, merges = np.ones(n, bool), [], []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            at = chain[-1]
            near = int(apart[at].argmin())
            if len(chain) > 1 and apart[at, chain[-2]] <= apart[at, near]:  # ties go back along the chain
                near = chain[-2]
                break
            chain.append(near)
        a, b = sorted((chain.pop(), chain.pop()))
        merges.append((a, b, apart[a, b]))
        rest = alive.copy()
        rest[[a, b]] = False
        total = size[a] + size[b] + size[rest]
        new = ((size[a] + size[rest]) * apart[a, rest] + (size[b] + size[rest]) * apart[b, rest] - size[rest] * apart[a, b]) / total
        apart[a, rest] = apart[rest, a] = np.maximum(new, 0)
        apart[b, :] = apart[:, b] = np.inf
        size[a] += size[b]
        alive[b] = False
    steps, name, count = np.zeros((n - 1, 4)), np.arange(n), sizes.astype(float)
    root = np.arange(n)
    for k, (a, b, height) in enumerate(sorted(merges, key=lambda m: m[2])):
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        low, high = sorted((name[a], name[b]))
        steps[k] = low, high, np.sqrt(height), count[a] + count[b]
        root[b], name[a] = a, n + k
        count[a] += count[b]
    return steps


def cut(steps: np.ndarray, leaves: int, k: int) -> np.ndarray:
    """The group of each leaf when the last ``k`` - 1 merges are undone; the group with most rows is 0, ties by first leaf."""
    group = np.arange(leaves + len(steps))
    for i in range(len(steps) - 1, -1, -1):
        if i < leaves - k:
            group[int(steps[i, 0])] = group[int(steps[i, 1])] = group[leaves + i]
    return group[:leaves]


@dataclass(frozen=True)
class Ward:
    """A linkage of summaries; rows follow the leaf with the nearest mean."""

    cols: tuple[str, ...]
    mean: np.ndarray
    sd: np.ndarray
    centres: np.ndarray  # of the leaves, on the scaled axes
    sizes: np.ndarray
    steps: np.ndarray
    exact: bool

    def table(self, spark: SparkSession) -> DataFrame:
        """(step, left, right, height, rows) of every merge."""
        rows = [(i, int(a), int(b), float(h), int(n)) for i, (a, b, h, n) in enumerate(self.steps)]
        return local_table(spark, rows, "step int, left int, right int, height double, rows long")

    def groups(self, k: int) -> np.ndarray:
        """The group number of each leaf; groups are numbered by falling size."""
        if not 1 <= k <= len(self.sizes):
            raise ValueError(f"1 to {len(self.sizes)} groups can be told apart")
        raw = cut(self.steps, len(self.sizes), k)
        names, first = np.unique(raw, return_index=True)
        rows = np.array([self.sizes[raw == g].sum() for g in names])
        order = names[np.lexsort((first, -rows))]
        number = {g: i for i, g in enumerate(order.tolist())}
        return np.array([number[g] for g in raw.tolist()])

    def label(self, df: DataFrame, k: int, new: str = "cluster") -> DataFrame:
        """``df`` with the group of every row (null for incomplete rows)."""
        group = self.groups(k)
        data = to_numbers(df, self.cols)
        x = F.array(*scaled(self.cols, self.mean, self.sd))
        rows = data.select(F.struct(*df.columns).alias("row"), x.alias("x"))
        schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField(new, T.IntegerType())])
        centres = self.centres

        def nearest(batches: Iterator) -> Iterator:
            for batch in batches:
                found = _nearest(_matrix(batch.column(1), len(centres[0])), centres)
                label = pa.array([int(group[i]) if i >= 0 else None for i in found], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), label], ["row", new])

        return rows.mapInArrow(nearest, schema).select("row.*", new)


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of every row, -1 for rows with missing numbers."""
    out, square = np.full(len(rows), -1), (centres ** 2).sum(axis=1)
    full = np.flatnonzero(~np.isnan(rows).any(axis=1))
    for at in range(0, len(full), BLOCK_ROWS):
        some = full[at:at + BLOCK_ROWS]
        out[some] = (square[None, :] - 2 * rows[some] @ centres.T).argmin(axis=1)
    return out


def _summaries(points: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and sizes of the rows nearest to each centre; empty ones are left out."""
    n, width = centres.shape

    def sums(batches: Iterator) -> Iterator:
        size, total = np.zeros(n), np.zeros((n, width))
        for batch in batches:
            rows = batch.to_numpy(dtype=float)
            near = _nearest(rows, centres)
            size += np.bincount(near, minlength=n)
            for j in range(width):
                total[:, j] += np.bincount(near, rows[:, j] - centres[near, j], n)
        used = np.flatnonzero(size)
        yield pd.DataFrame({"leaf": used, "size": size[used]} | {f"s{j}": total[used, j] for j in range(width)})

    fields = [f"s{j}" for j in range(width)]
    parts = points.mapInPandas(sums, "leaf long, size double, " + ", ".join(f"{f} double" for f in fields))
    found = parts.groupBy("leaf").agg(F.sum("size").alias("size"), *[F.sum(f).alias(f) for f in fields]).orderBy("leaf").collect()
    leaf, size = np.array([r["leaf"] for r in found], int), np.array([r["size"] for r in found])
    return centres[leaf] + np.array([[r[f] for f in fields] for r in found]).reshape(len(found), width) / size[:, None], size


def ward(df: DataFrame, cols: Sequence[str], leaves: int = LEAVES, scale: bool = True, seed: int = 42, rounds: int = 2) -> Ward:
    """Ward's linkage of the complete rows.

    With more than ``leaves`` distinct rows, as many of them (those with the smallest hashes) are the first centres of the summaries;
    all rows then move to their nearest centre and the centres to their means, ``rounds`` times.
    """
    data = to_numbers(df, cols)
    mean, sd = scaling(data, cols, scale)
    names = [f"x{i}" for i in range(len(cols))]
    points = data.na.drop(subset=list(cols)).select(*[(x + 0.0).alias(n) for n, x in zip(names, scaled(cols, mean, sd))])
    counted = points.groupBy(*names).agg(F.count(F.lit(1)).alias("size"))
    first = counted.orderBy(F.xxhash64(F.lit(seed), *names), *names).limit(leaves + 1).collect()
    if not first:
        raise ValueError("no complete rows to link")
    exact = len(first) <= leaves
    first = sorted(tuple(r) for r in first[:leaves])
    centres, sizes = np.array([r[:-1] for r in first], float), np.array([r[-1] for r in first], float)
    for _ in range(0 if exact else rounds):
        centres, sizes = _summaries(points, centres)
    if not exact:
        centres, sizes = _summaries(points, centres)
    return Ward(tuple(cols), mean, sd, centres, sizes, ward_steps(centres, sizes), exact)
