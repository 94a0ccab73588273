"""Exact k-nearest-neighbour prediction as a partitioned join.

Both sides are assigned to the nearest of a few hundred pivot rows. For a test row,
the distance to its k-th nearest pivot bounds the distance to its k-th neighbour
(pivots are training rows), so by the triangle inequality only some cells can hold a
neighbour, and in a large cell only the rings at a fitting distance from its pivot.
Rings are cut into blocks of bounded size on both sides, so neither a crowded cell nor
many copies of one point end up in one task; each block pair keeps the best k per test
row and a small window merges them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabstat.operators.linear import fold_of
from tabstat.plans.stats import as_double, local_table


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, |a| x |b|, from plain differences."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        d = a[:, j][:, None] - b[:, j][None, :]
        out += d * d
    return np.sqrt(out)


RINGS = 32  # distance rings of a cell that is larger than a block


def _assigner(pivots: np.ndarray, cols: Sequence[str], k: int, edges: np.ndarray | None,
              gaps: np.ndarray | None = None, radius: np.ndarray | None = None):
    """Partition function adding ``cell`` and ``ring``; on the test side one row per ring that may hold neighbours.

    ``edges`` are the inner ring limits of every cell (cells x rings - 1).
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), 512):
                part = pdf.iloc[start:start + 512]
                if part.empty:
                    continue
                d = _distances(part[list(cols)].to_numpy(float), pivots)
                own = d.argmin(axis=1)
                if radius is None:
                    dist = d[np.arange(len(d)), own]
                    ring = (dist[:, None] >= edges[own]).sum(axis=1) if edges is not None else np.zeros(len(d))
                    yield part.assign(cell=own.astype("int32"), ring=ring.astype("int32"), dist=dist)
                    continue
                bound = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(d), np.inf)
                slack = 1e-9 * (1 + bound)
                near = d - radius[None, :] <= (bound + slack)[:, None]
                # a cell further away than the bisecting plane allows holds no neighbour either
                gap = gaps[own]
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = (d ** 2 - d[np.arange(len(d)), own][:, None] ** 2) / (2 * gap)
                near &= ~((gap > 0) & (plane > (bound + slack)[:, None]))
                row, cell = np.nonzero(near)
                away, reach = d[row, cell], (bound + slack)[row]
                first = (edges[cell] <= (away - reach)[:, None]).sum(axis=1)
                last = (edges[cell] <= (away + reach)[:, None]).sum(axis=1)
                times = last - first + 1
                at = np.repeat(np.arange(len(row)), times)
                ring = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times) + first[at]
                yield part.iloc[row[at]].assign(cell=cell[at].astype("int32"), ring=ring.astype("int32"))
    return run


def nearest(train: DataFrame, test: DataFrame, xs: Sequence[str], key: str, k: int = 5, payload: Sequence[str] = (),
            pivots: int | None = None, block: int = 20_000) -> DataFrame:
    """(key, neighbour, distance, position, payload...): the k nearest training rows of each test row.

    Ties are broken by the smaller neighbour key.
    """
    xs = list(xs)
    left = train.select(F.col(key).alias("neighbour"), *[as_double(x).alias(x) for x in xs], *payload).na.drop(subset=xs)
    right = test.select(F.col(key), *[as_double(x).alias(x) for x in xs]).na.drop(subset=xs)
    n = left.count()
    m = pivots or int(min(1024, max(16, n ** 0.5)))
    chosen = left.orderBy(F.xxhash64("neighbour"), "neighbour").limit(m).select(*xs).toPandas().to_numpy(float)

    placed = left.select("*", F.lit(0).alias("cell"), F.lit(0).alias("ring"), F.lit(0.0).alias("dist")).schema
    ranks = F.array(*[F.lit(i / RINGS) for i in range(1, RINGS)])
    cells = left.mapInPandas(_assigner(chosen, xs, k, None), placed).groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("dist").alias("r"),
        F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double("dist", 400), ranks).alias("e")).collect()  # one row per pivot
    rings = RINGS if max((r["n"] for r in cells), default=0) > block else 1
    radius, edges = np.full(len(chosen), -np.inf), np.zeros((len(chosen), rings - 1))
    for r in cells:
        radius[r["cell"]] = r["r"]
        if rings > 1:
            edges[r["cell"]] = sorted(r["e"])
    assigned = left.mapInPandas(_assigner(chosen, xs, k, edges), placed)
    probes = right.mapInPandas(_assigner(chosen, xs, k, edges, _distances(chosen, chosen), radius),
                               right.select("*", F.lit(0).alias("cell"), F.lit(0).alias("ring")).schema)

    # blocks only bound the work, so the share of a ring may come from its edges (equal edges: many copies)
    blocks = {}
    for r in cells:
        for g in range(rings):
            below = int(np.searchsorted(edges[r["cell"]], edges[r["cell"]][g - 1])) if g else 0
            share = min(1.0, (g - below + 1) / rings)
            blocks[r["cell"], g] = int(-(-r["n"] * share // block)) or 1
    loads = probes.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("n")).collect()  # pivots x rings lines at most
    turns = {(r["cell"], r["ring"]): -(-r["n"] // block) for r in loads}
    plan = local_table(train.sparkSession, [(c, g, b, turns[c, g]) for (c, g), b in blocks.items() if (c, g) in turns],
                       "cell int, ring int, blocks int, turns int")
    assigned = assigned.join(F.broadcast(plan), ["cell", "ring"]) \
        .withColumn("part", F.pmod(F.xxhash64("neighbour"), F.col("blocks")).cast("int")) \
        .withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).drop("dist", "blocks", "turns")
    probes = probes.join(F.broadcast(plan), ["cell", "ring"]) \
        .withColumn("turn", F.pmod(F.xxhash64(key), F.col("turns")).cast("int")) \
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "turns")
    extra = list(payload)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = [key, "neighbour", "distance", *extra]
        if a.empty or b.empty:
            return pd.DataFrame({c: pd.Series(dtype="float64") for c in names})
        a = a.sort_values("neighbour", kind="stable")
        ref = a[xs].to_numpy(float)
        kk, step = min(k, len(a)), max(1, 2_000_000 // len(a))
        rows, hits, dists = [], [], []
        for start in range(0, len(b), step):
            d = _distances(b[xs].iloc[start:start + step].to_numpy(float), ref)
            cut = np.partition(d, kk - 1, axis=1)[:, kk - 1]
            for i in range(len(d)):
                hit = np.nonzero(d[i] <= cut[i])[0]
                hit = hit[np.argsort(d[i][hit], kind="stable")][:kk]
                rows.append(np.full(len(hit), start + i))
                hits.append(hit)
                dists.append(d[i][hit])
        at = np.concatenate(hits)
        out = {key: b[key].to_numpy()[np.concatenate(rows)], "neighbour": a["neighbour"].to_numpy()[at],
               "distance": np.concatenate(dists)}
        return pd.DataFrame(out | {c: a[c].to_numpy()[at] for c in extra})[names]

    schema = right.select(F.col(key)).schema
    schema = schema.add("neighbour", left.schema["neighbour"].dataType).add("distance", "double")
    for c in extra:
        schema = schema.add(c, left.schema[c].dataType)
    on = ["cell", "ring", "part", "turn"]
    found = assigned.groupBy(*on).cogroup(probes.groupBy(*on)).applyInPandas(best, schema)
    place = F.row_number().over(Window.partitionBy(key).orderBy("distance", "neighbour"))
    return found.withColumn("position", place).where(F.col("position") <= k)


def knn(train: DataFrame, test: DataFrame, xs: Sequence[str], y: str, key: str, k: int = 5,
        task: str = "regression") -> DataFrame:
    """(key, prediction): mean of the neighbours, or their majority label (smallest on ties)."""
    near = nearest(train.where(F.col(y).isNotNull()), test, xs, key, k, [y])
    if task == "regression":
        return near.groupBy(key).agg(F.avg(as_double(y)).alias("prediction"))
    votes = near.groupBy(key, y).agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col(y).alias("label"))).alias("b")) \
                .select(key, F.col("b.label").alias("prediction"))


def knn_grid(df: DataFrame, xs: Sequence[str], y: str, key: str, ks: Sequence[int], folds: int = 5,
             task: str = "regression", seed: int | None = None) -> DataFrame:
    """(k, score): mean fold R2 or accuracy of every k; one neighbour search per fold serves all k."""
    data = df.na.drop(subset=[y, *xs]).withColumn("fold__", fold_of(key, folds, seed))
    out = None
    for f in range(folds):
        near = nearest(data.where(F.col("fold__") != f), data.where(F.col("fold__") == f), xs, key, max(ks), [y])
        every = near.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("position <= k")
        if task == "regression":
            guess = every.groupBy("k", key).agg(F.avg(as_double(y)).alias("prediction"))
        else:
            votes = every.groupBy("k", key, y).agg(F.count(F.lit(1)).alias("n"))
            guess = votes.groupBy("k", key).agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col(y).alias("label")))["label"].alias("prediction"))
        guess = guess.withColumn("fold__", F.lit(f))
        out = guess if out is None else out.unionByName(guess)
    scored = out.join(data.select(key, F.col(y).alias("actual")), key)
    if task == "regression":
        e = F.col("actual") - F.col("prediction")
        score = 1 - F.try_divide(F.avg(e * e), F.var_pop(F.col("actual").cast("double")))
    else:
        score = F.avg(F.when(F.col("actual") == F.col("prediction"), 1.0).otherwise(0.0))
    return scored.groupBy("k", "fold__").agg(score.alias("s")).groupBy("k").agg(F.avg("s").alias("score"))
