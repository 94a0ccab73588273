"""Which of several models predicts new rows best? Leave-one-out by importance sampling, and weights of the models.

Draws of a posterior (a bounded matrix) go to every task; a row's log likelihoods under all draws stay in its task, where the
largest importance ratios are replaced by quantiles of a generalised Pareto law (Vehtari, Gelman and Gabry 2017; law fitted
as by Zhang and Stephens 2009). One line per row leaves: what the row adds, and the shape that says how far to trust it.
Model weights average over Bayesian bootstraps of those lines, whose random weights follow from the row's key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabstat.operators.bayes import _weights, scale_grid
from tabstat.plans.moments import moment_matrix
from tabstat.plans.stats import as_double, local_table

CHAINS, DRAWS = 4, 500
#: Numbers of one block of rows times draws; its few arrays stay in a core's cache.
BLOCK = 1 << 16
#: A shape above it makes a row's value unreliable.
SHAPE_LIMIT = 0.7
BOOTSTRAPS = 1000


@dataclass(frozen=True)
class Posterior:
    """Draws of a standardised regression: one line per draw with intercept, slopes and sigma."""

    y: str
    xs: tuple[str, ...]
    mean: np.ndarray  # of xs and y
    sd: np.ndarray
    values: np.ndarray
    chains: int

    def table(self, spark) -> DataFrame:
        """(chain, draw, param, value)."""
        names = ["intercept", *[f"beta[{x}]" for x in self.xs], "sigma"]
        per = len(self.values) // self.chains
        rows = [(i // per, i % per, name, float(v)) for i, line in enumerate(self.values) for name, v in zip(names, line)]
        return local_table(spark, rows, "chain int, draw int, param string, value double")


def linear_draws(df: DataFrame, y: str, xs: Sequence[str], chains: int = CHAINS, draws: int = DRAWS, seed: int = 42) -> Posterior:
    """Independent draws of the posterior of ``bayes_linear``: standardised variables, slopes and intercept ~ N(0, 1), sigma ~ HalfCauchy(1).

    The data enter through their moments. sigma is drawn from its marginal on a fine grid, evenly inside a step; the rest is normal given sigma.
    """
    m = moment_matrix(df, [*xs, y])
    n, p = m.n, len(xs)
    spread = np.sqrt(np.diag(m.cross))
    if not (spread > 0).all():
        raise ValueError("a constant column can't be standardised")
    r = m.cross / np.outer(spread, spread)
    zz, zy = r[:p, :p] * n, r[:p, p] * n
    resid = max(1 - float(r[:p, p] @ np.linalg.pinv(r[:p, :p]) @ r[:p, p]), 1e-12) if p else 1.0
    sigma = scale_grid(math.sqrt(resid), n - p, 2001)
    values, axes = np.linalg.eigh(zz) if p else (np.zeros(0), np.zeros((0, 0)))
    proj = axes.T @ zy
    a, b = values[None, :] / sigma[:, None]**2 + 1, proj[None, :] / sigma[:, None]**2
    logw = (-n * np.log(sigma) - n / (2 * sigma**2) + 0.5 * (b * b / a).sum(axis=1) - 0.5 * np.log(a).sum(axis=1)
            - 0.5 * np.log(n / sigma**2 + 1) - np.log(1 + sigma**2) + np.log(sigma))
    rng = np.random.default_rng(seed)
    at = rng.choice(len(sigma), size=chains * draws, p=_weights(logw))
    step = math.log(sigma[1] / sigma[0])
    s = sigma[at] * np.exp(step * (rng.random(len(at)) - 0.5))
    a, b = values[None, :] / s[:, None]**2 + 1, proj[None, :] / s[:, None]**2
    slopes = (b / a + rng.normal(size=a.shape) / np.sqrt(a)) @ axes.T
    intercept = rng.normal(size=len(s)) / np.sqrt(n / s**2 + 1)
    return Posterior(y, tuple(xs), m.mean, spread / math.sqrt(n), np.column_stack([intercept, slopes, s]), chains)


def pareto_fit(tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shape, scale) of generalised Pareto laws fitted to each line of ascending excesses; the shape is drawn a little towards 0.5."""
    n = tail.shape[1]
    points = 30 + int(math.sqrt(n))
    j = np.arange(1, points + 1)
    quartile = tail[:, int(n / 4 + 0.5) - 1]
    theta = (1 - np.sqrt(points / (j - 0.5)))[None, :] / (3 * quartile[:, None]) + 1 / tail[:, -1:]
    shape = np.stack([np.log1p(-theta[:, k, None] * tail).mean(axis=1) for k in range(points)], axis=1)
    fit = n * (np.log(-theta / shape) - shape - 1)
    weight = np.exp(fit - fit.max(axis=1, keepdims=True))
    best = (theta * weight).sum(axis=1) / weight.sum(axis=1)
    k = np.log1p(-best[:, None] * tail).mean(axis=1)
    scale = -k / best
    return (n * k + 5) / (n + 10), scale


def smoothed(ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log weights, shape) of log importance ratios, one line per row: the largest are replaced by expected order statistics of the fitted law.

    The tail holds min(draws / 5, 3 sqrt(draws)) ratios. Equal ratios have nothing to smooth and a shape of minus infinity.
    """
    rows, draws = ratios.shape
    size = int(math.ceil(min(0.2 * draws, 3 * math.sqrt(draws))))
    out = ratios - ratios.max(axis=1, keepdims=True)
    shape = np.full(rows, -np.inf if draws > 1 else np.nan)
    if size < 5:
        return out, np.full(rows, np.inf)
    order = np.argpartition(out, draws - size - 1, axis=1)
    top = order[:, draws - size:]
    top = np.take_along_axis(top, np.argsort(np.take_along_axis(out, top, 1), axis=1, kind="stable"), 1)
    level = np.take_along_axis(out, order[:, draws - size - 1:draws - size], 1)
    excess = np.exp(np.take_along_axis(out, top, 1)) - np.exp(level)
    some = np.flatnonzero((excess[:, 0] > 0) & (excess[:, -1] > excess[:, 0] * (1 + 1e-10)))
    for at in range(0, len(some), 256):
        own = some[at:at + 256]
        k, scale = pareto_fit(excess[own])
        p = (np.arange(size) + 0.5) / size
        grown = scale[:, None] * np.expm1(-k[:, None] * np.log1p(-p)) / k[:, None]
        new = np.minimum(np.log(grown + np.exp(level[own])), 0)
        out[own[:, None], top[own]], shape[own] = new, k
    return out, shape


def _log_mean(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """log of the mean of exp(values) under log weights."""
    return _log_sum(values + weights) - _log_sum(weights)


def _log_sum(values: np.ndarray) -> np.ndarray:
    """log of the sum of exp(values) of each line; one exponential a number, which ``np.logaddexp.reduce`` takes forty times as long for."""
    top = values.max(axis=1, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(values - top).sum(axis=1)) + top[:, 0]


def pointwise(df: DataFrame, posterior: Posterior, key: str) -> DataFrame:
    """(key, elpd, parameters, shape) of every complete row: log density of the row as predicted by all others, how much it
    loses against its own fit, and the shape of its importance ratios (above 0.7: don't trust). Densities are on the scale of y."""
    cols = [*posterior.xs, posterior.y]
    rows = df.select(F.col(key).alias("key"), *[as_double(c).alias(f"v{i}") for i, c in enumerate(cols)]).na.drop(subset=[f"v{i}" for i in range(len(cols))])
    own, p = posterior, len(posterior.xs)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beta, sigma = own.values[:, :p + 1], own.values[:, p + 1]
        block = max(1, BLOCK // len(sigma))
        line = np.column_stack([-beta, np.ones(len(sigma))]).T / sigma  # a standardised residual is a row's (1, xs, y) times a column
        level = -np.log(sigma) - 0.5 * math.log(2 * math.pi) - math.log(own.sd[p])
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                z = (np.column_stack([part.column(1 + i).to_numpy(zero_copy_only=False) for i in range(p + 1)]) - own.mean) / own.sd
                density = np.column_stack([np.ones(len(z)), z]) @ line
                density *= density
                density *= -0.5
                density += level
                weights, shape = smoothed(-density)
                elpd = _log_mean(density, weights)
                fit = _log_sum(density) - math.log(len(sigma))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(elpd), pa.array(fit - elpd), pa.array(shape)], ["key", "elpd", "parameters", "shape"])

    schema = T.StructType([T.StructField("key", df.schema[key].dataType), *[T.StructField(c, T.DoubleType()) for c in ("elpd", "parameters", "shape")]])
    return rows.mapInArrow(scored, schema)


def loo_table(points: DataFrame) -> DataFrame:
    """(n, elpd, se, parameters, unreliable) of one model's rows."""
    n = F.count(F.lit(1))
    return points.agg(n.alias("n"), F.sum("elpd").alias("elpd"), (F.sqrt(n.cast("double")) * F.stddev_pop("elpd")).alias("se"), F.sum("parameters").alias("parameters"),
                      F.sum((F.col("shape") > SHAPE_LIMIT).cast("long")).alias("unreliable"))


def compare_models(models: Mapping[str, DataFrame], bootstraps: int = BOOTSTRAPS, seed: int = 42) -> DataFrame:
    """(model, rank, elpd, se, parameters, difference, difference_se, weight, unreliable), the best predicting first.

    ``models`` are ``pointwise`` tables over the same rows, whose keys must be unique. ``weight`` is the mean over Bayesian bootstraps of
    exp(elpd) shares (pseudo-BMA+).
    """
    names = list(models)
    joined = None
    for i, name in enumerate(names):
        own = models[name].select("key", F.col("elpd").alias(f"e{i}"), F.col("parameters").alias(f"p{i}"), F.col("shape").alias(f"s{i}"))
        joined = own if joined is None else joined.join(own, "key")
    joined = joined.persist()
    try:
        n = F.count(F.lit(1))
        aggs = [n.alias("n")]
        for i in range(len(names)):
            aggs += [F.sum(f"e{i}").alias(f"e{i}"), F.stddev_pop(f"e{i}").alias(f"se{i}"), F.sum(f"p{i}").alias(f"p{i}"), F.sum((F.col(f"s{i}") > SHAPE_LIMIT).cast("long")).alias(f"u{i}")]
            aggs += [F.stddev_pop(F.col(f"e{i}") - F.col(f"e{j}")).alias(f"d{i}_{j}") for j in range(len(names))]
        row = joined.agg(*aggs).first()
        rows = joined.select(F.xxhash64(F.lit(seed), "key").alias("h"), *[f"e{i}" for i in range(len(names))])

        def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, all_weights = np.zeros((bootstraps, len(names))), np.zeros(bootstraps)
            rounds = _spread(np.arange(bootstraps, dtype=np.uint64) + np.uint64(17))
            for batch in batches:
                for at in range(0, batch.num_rows, max(1, BLOCK // bootstraps)):
                    part = batch.slice(at, max(1, BLOCK // bootstraps))
                    h = part.column(0).to_numpy().view(np.uint64)
                    uniform = ((_spread(h[:, None] ^ rounds[None, :]) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
                    weight = -np.log(uniform)
                    values = np.column_stack([part.column(1 + i).to_numpy() for i in range(len(names))])
                    total += weight.T @ values
                    all_weights += weight.sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(bootstraps)), pa.array(all_weights), *[pa.array(total[:, i]) for i in range(len(names))]],
                                             ["b", "w", *[f"e{i}" for i in range(len(names))]])

        schema = "b long, w double, " + ", ".join(f"e{i} double" for i in range(len(names)))
        found = rows.mapInArrow(drawn, schema).groupBy("b").agg(F.sum("w").alias("w"), *[F.sum(f"e{i}").alias(f"e{i}") for i in range(len(names))]).toPandas()
    finally:
        joined.unpersist()
    sums = found[[f"e{i}" for i in range(len(names))]].to_numpy() / found[["w"]].to_numpy() * row["n"]
    shares = np.exp(sums - sums.max(axis=1, keepdims=True))
    weight = (shares / shares.sum(axis=1, keepdims=True)).mean(axis=0)
    order = sorted(range(len(names)), key=lambda i: -row[f"e{i}"])
    best, root = order[0], math.sqrt(row["n"])
    out = [(names[i], rank, float(row[f"e{i}"]), root * row[f"se{i}"], float(row[f"p{i}"]), float(row[f"e{best}"] - row[f"e{i}"]), root * row[f"d{best}_{i}"], float(weight[i]), int(row[f"u{i}"]))
           for rank, i in enumerate(order)]
    return local_table(models[names[0]].sparkSession, out,
                       "model string, rank int, elpd double, se double, parameters double, difference double, difference_se double, weight double, unreliable long")


def _spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
