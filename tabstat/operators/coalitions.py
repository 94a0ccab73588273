"""Contributions of features to the predictions of any model, by asking it about rows with some features replaced.

The least squares problem that Shapley values solve has the same design for every row, so its solution is a fixed
combination of the answers: rows are multiplied by coalitions and background rows, scored once by the model, and summed up
with coefficients from a small table. Where coalitions are few, a row's answers are summed up before they leave their task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from itertools import combinations
from operator import add

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstat.plans.stats import bounded_rows, local_table

#: Coalitions that are asked about at most; with no more than these in all, the values are exact.
COALITIONS = 512
BACKGROUND_ROWS = 100
#: Up to so many coalitions, the answers of a row meet in one line of as many columns.
WIDE = 32


def coalition_table(features: int, most: int = COALITIONS, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(members, weight) of all coalitions but the empty and the whole one, or of a seeded sample of them in pairs of opposites.

    A coalition of k of p features weighs (p - 1) / (C(p, k) k (p - k)). In a sample, sizes are drawn by their total weight and drawn
    coalitions weigh alike.
    """
    p = features
    if p < 2:
        return np.zeros((0, p)), np.zeros(0)
    if 2**p - 2 <= most:
        sets = [s for k in range(1, p) for s in combinations(range(p), k)]
        members = np.array([[j in s for j in range(p)] for s in sets], float)
        size = members.sum(axis=1).astype(int)
        return members, np.array([(p - 1) / (math.comb(p, k) * k * (p - k)) for k in size.tolist()])
    rng = np.random.default_rng(seed)
    share = np.array([1 / (k * (p - k)) for k in range(1, p)])
    seen: dict[tuple, int] = {}
    for k in rng.choice(np.arange(1, p), size=most // 2, p=share / share.sum()):
        one = np.zeros(p, int)
        one[rng.choice(p, k, replace=False)] = 1
        for members in (one, 1 - one):
            seen[tuple(members.tolist())] = seen.get(tuple(members.tolist()), 0) + 1
    return np.array(list(seen), float), np.array(list(seen.values()), float)


def solution(members: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(B, c): contributions are B @ (answers - base) + c * (prediction - base), and add up to prediction - base."""
    p = members.shape[1]
    if p == 1:
        return np.zeros((1, 0)), np.ones(1)
    inverse = np.linalg.pinv((members * weight[:, None]).T @ members)
    free = inverse @ (members * weight[:, None]).T
    pull = inverse.sum(axis=1) / inverse.sum()  # moves a solution onto the plane of the right sum
    return free - np.outer(pull, free.sum(axis=0)), pull


def shap_any(predict: Callable[[DataFrame], DataFrame], rows: DataFrame, background: DataFrame, xs: Sequence[str], key: str, output: str = "prediction",
             coalitions: int = COALITIONS, seed: int = 42, prefix: str = "phi_") -> DataFrame:
    """``rows`` with ``phi_<x>``, ``base`` and ``output``, which is their sum.

    ``predict`` adds the numeric column ``output`` to a DataFrame with the columns of ``rows``. Features outside a coalition take the values of the
    ``background`` rows (at most ``BACKGROUND_ROWS``, else an error: choose or average them first), and answers are averaged over
    them. Every row is scored coalitions times background rows times, so explain the rows that are asked about. ``key`` tells rows apart.
    """
    spark = rows.sparkSession
    back = bounded_rows(background.select(*xs), BACKGROUND_ROWS, "background rows")
    if not back:
        raise ValueError("background rows are needed")
    members, weight = coalition_table(len(xs), coalitions, seed)
    b, c = solution(members, weight)
    # answers: every coalition against each background row; the empty coalition gives the base, the whole one the prediction
    masks = np.vstack([members, np.zeros(len(xs)), np.ones(len(xs))])
    base_row, p = len(members), len(xs)
    factor = np.column_stack([b, -b.sum(axis=1) - c, c]).T  # per coalition: one coefficient per feature
    coefficients = local_table(spark, [(m, *map(float, line)) for m, line in enumerate(factor)], "mask__ int, " + ", ".join(f"c{i}__ double" for i in range(p)))
    kinds = [rows.schema[x].dataType for x in xs]
    line = F.array(*[F.struct(F.lit(m).alias("mask__"), *[F.lit(bool(v)).alias(f"m{i}__") for i, v in enumerate(mask)]) for m, mask in enumerate(masks)])
    other = F.array(*[F.struct(*[F.lit(v).cast(kind).alias(f"b{i}__") for i, (v, kind) in enumerate(zip(r, kinds))]) for r in back])
    asked = rows.select("*", F.inline(line)).select("*", F.inline(other))  # a bounded number of lines per row
    ids, names = [f"m{i}__" for i in range(p)], [f"b{i}__" for i in range(p)]
    asked = asked.withColumns({x: F.when(F.col(i), F.col(x)).otherwise(F.col(n)) for x, i, n in zip(xs, ids, names)}).drop(*ids, *names)
    if len(masks) <= WIDE:  # a line per key leaves a task, not one per coalition
        told = predict(asked).groupBy(key).agg(*[F.avg(F.when(F.col("mask__") == m, F.col(output))).alias(f"v{m}__") for m in range(len(masks))])
        some = F.coalesce(*[F.col(f"v{m}__") for m in range(len(masks))]).isNotNull()
        terms = [[F.coalesce(F.col(f"v{m}__") * float(line[i]), F.lit(0.0)) for m, line in enumerate(factor)] for i in range(p)]
        phi = told.select(key, *[F.when(some, reduce(add, t)).alias(prefix + x) for x, t in zip(xs, terms)], F.col(f"v{base_row}__").alias("base"), F.col(f"v{base_row + 1}__").alias("output"))
        return rows.join(phi, key)
    answers = predict(asked).groupBy(key, "mask__").agg(F.avg(output).alias("v__"))
    joined = answers.join(F.broadcast(coefficients), "mask__")
    phi = joined.groupBy(key).agg(*[F.sum(F.col("v__") * F.col(f"c{i}__")).alias(prefix + x) for i, x in enumerate(xs)],
                                  F.max(F.when(F.col("mask__") == base_row, F.col("v__"))).alias("base"), F.max(F.when(F.col("mask__") == base_row + 1, F.col("v__"))).alias("output"))
    return rows.join(phi, key)
