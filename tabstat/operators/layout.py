"""Rows as points of a plane that keep their neighbours: a layout of the exact neighbour graph.

Edges carry weights that fall with the distance, on each row's own scale. From the plane of the first two components, every epoch
is one pass over the edges, which pull their ends together, and one over the rows, which a fresh seeded sample of other rows
pushes apart. Positions are written to the checkpoint folder after each epoch; they are joined to the edges by a broadcast
while they are few and by a shuffle beyond.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstat.operators.clustering import scaled, scaling, to_numbers
from tabstat.operators.derive import components
from tabstat.operators.neighbours import nearest
from tabstat.plans.stats import settle
from tabstat.session import need_checkpoint_dir

#: Rows of the sample that pushes all others apart in an epoch.
SAMPLE = 400
#: Pushes for one pull.
PUSHES = 5.0
#: A coordinate moves no further in an epoch, before cooling.
STEP = 4.0


def edge_weights(df: DataFrame, cols: Sequence[str], key: str, k: int = 15) -> DataFrame:
    """(a, b, w), both directions of every edge: 1 for the nearest neighbour, falling with the distance beyond it.

    A row's scale makes its weights add up to log2(k + 1), by bisection. Weights of the two directions are joined as the chance that either holds.
    """
    near = nearest(df, df, cols, key, k + 1).where(F.col(key) != F.col("neighbour"))
    kind = df.schema[key].dataType.simpleString()

    def weighed(rows: pd.DataFrame) -> pd.DataFrame:
        d = rows["distance"].to_numpy()
        beyond = np.maximum(d - d.min(), 0)
        low, high, wanted = 0.0, 1e-3 + 1e3 * max(beyond.max(), 1e-12), min(math.log2(k + 1), 0.99 * len(d))
        for _ in range(60):
            scale = (low + high) / 2
            low, high = (scale, high) if np.exp(-beyond / max(scale, 1e-300)).sum() < wanted else (low, scale)
        return pd.DataFrame({"a": rows[key], "b": rows["neighbour"], "w": np.exp(-beyond / max(high, 1e-300))})

    one = near.groupBy(key).applyInPandas(weighed, f"a {kind}, b {kind}, w double")
    pair = one.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")
    either = pair.groupBy("a", "b").agg((1 - F.product(1 - F.col("w"))).alias("w"))
    return either.unionByName(either.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def neighbour_layout(df: DataFrame, cols: Sequence[str], key: str, k: int = 15, epochs: int = 40, seed: int = 42, scale: bool = True) -> DataFrame:
    """(key, u, v) of every complete row; ``key`` must be unique.

    Reruns over the same rows agree up to the order in which sums are formed.
    """
    need_checkpoint_dir(df.sparkSession)
    data = to_numbers(df, cols).na.drop(subset=list(cols))
    mean, sd = scaling(data, cols, scale)
    names = [f"x{i}__" for i in range(len(cols))]
    data = data.select(F.col(key).alias("id__"), *[x.alias(n) for n, x in zip(names, scaled(cols, mean, sd))]).checkpoint()
    edges = edge_weights(data, names, "id__", k).checkpoint()
    scored, _ = components(data, names, min(2, len(cols)), "pc__", scale=False)
    second = F.col("pc___comp2") if len(cols) > 1 else F.lit(0.0)
    far = scored.agg(F.greatest(F.max(F.abs("pc___comp1")), F.max(F.abs(second)))).first()[0] or 1.0
    jitter = [(F.pmod(F.xxhash64(F.lit(seed + i), "id__"), F.lit(1 << 20)) / float(1 << 20) - 0.5) * 1e-3 for i in (1, 2)]  # copies part
    place = scored.select("id__", (F.col("pc___comp1") * (10 / far) + jitter[0]).alias("u"), (second * (10 / far) + jitter[1]).alias("v")).checkpoint()
    sums = edges.groupBy("a").agg(F.sum("w").alias("pull__"))
    place = place.join(sums.withColumnRenamed("a", "id__"), "id__", "left").na.fill(0.0, ["pull__"]).checkpoint()
    for epoch in range(epochs):
        few = settle(place.select("id__", "u", "v"))
        known = few if few is not None else place.select("id__", "u", "v")
        joined = edges.join(known.selectExpr("id__ AS a", "u AS au", "v AS av"), "a").join(known.selectExpr("id__ AS b", "u AS bu", "v AS bv"), "b")
        du, dv = F.col("au") - F.col("bu"), F.col("av") - F.col("bv")
        force = -2 * F.col("w") / (1 + du * du + dv * dv)
        pulls = joined.groupBy(F.col("a").alias("id__")).agg(F.sum(force * du).alias("fu"), F.sum(force * dv).alias("fv"))
        others = np.array([[r.u, r.v] for r in place.orderBy(F.xxhash64(F.lit(seed + 100 + epoch), "id__"), "id__").select("u", "v").limit(SAMPLE).collect()])
        rate = 1 - epoch / epochs
        place = _pushed(place.join(pulls, "id__", "left"), others, rate).checkpoint()
    return place.select(F.col("id__").alias(key), "u", "v")


def _pushed(rows: DataFrame, others: np.ndarray, rate: float) -> DataFrame:
    """Positions after the pulls of the edges and the pushes of the sample, as many as the pulls."""
    def moved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            u, v = pdf["u"].to_numpy(), pdf["v"].to_numpy()
            du, dv = u[:, None] - others[None, :, 0], v[:, None] - others[None, :, 1]
            square = du * du + dv * dv
            force = np.where(square > 1e-18, 2 / ((0.01 + square) * (1 + square)), 0.0)
            push = PUSHES * pdf["pull__"].to_numpy() / max(1, len(others))
            for name, at, d in (("u", u, du), ("v", v, dv)):
                pull = pdf["f" + name].fillna(0.0).to_numpy()
                pdf[name] = at + rate * np.clip(0.1 * pull + 0.1 * push * (force * d).sum(axis=1), -STEP, STEP)
            yield pdf[["id__", "u", "v", "pull__"]]

    kind = rows.schema["id__"].dataType.simpleString()
    return rows.mapInPandas(moved, f"id__ {kind}, u double, v double, pull__ double")


def neighbour_overlap(points: DataFrame, plane: DataFrame, cols: Sequence[str], flat: Sequence[str], key: str, k: int = 10) -> DataFrame:
    """(n, overlap): the mean share of the ``k`` nearest rows in all columns that are among the ``k`` nearest in the plane."""
    def pairs(df: DataFrame, xs: Sequence[str]) -> DataFrame:
        near = nearest(df, df, xs, key, k + 1).where(F.col(key) != F.col("neighbour"))
        return near.where(F.col("position") <= k + 1).select(F.col(key).alias("a"), F.col("neighbour").alias("b"))

    n = plane.count()
    both = pairs(points, cols).join(pairs(plane, flat), ["a", "b"]).agg(F.count(F.lit(1)).alias("hits"))
    return both.select(F.lit(n).alias("n"), (F.col("hits") / float(max(1, n * k))).alias("overlap"))
