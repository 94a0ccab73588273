"""Do sampling chains agree, and how many independent draws are they worth?

Rank-normalised split R-hat and effective sample sizes (Vehtari and others 2021) of draws tables (chain, draw, param, value).
Every chain is cut in halves. Ranks come from the distributed counts of ``order_stats``. Autocovariances are sums over blocks of
draws: a block carries the draws that follow it as far as the largest lag, so no chain is held in one task. Lags are added
until the sum of every quantity has turned negative.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabstat.functions.normal_scores import normal_quantile
from tabstat.operators.bayes import MASS, posterior_summary
from tabstat.plans.order_stats import attach_by_value, quantile_table, running_counts, value_counts
from tabstat.plans.stats import as_double, settle
from tabstat.session import need_checkpoint_dir

#: Draws of a block; also the first number of lags and how it grows.
BLOCK = 8192
FIRST_LAGS = 64
MORE = 8
#: Quantiles whose effective sizes make up the tail size.
TAIL = (0.05, 0.95)


def attach(rows: DataFrame, table: DataFrame, on: Sequence[str], cnt: str) -> DataFrame:
    """Left join one line per ``on``: a broadcast if the lines are few, else a shuffle in which hot keys are told apart."""
    few = settle(table)
    if few is not None:
        return rows.join(few, list(on), "left")
    return attach_by_value(rows, table, on[-1], cnt, list(on[:-1]), spread="t", total=rows.count())


def split_chains(draws: DataFrame) -> DataFrame:
    """(param, chain, t, value, half): the first and second halves of every chain as chains of their own, drawn at t = 0, 1, ...

    ``draw`` counts without gaps inside a chain (an error is raised otherwise). All chains of a parameter are cut to the length
    of its shortest; the middle draw of an odd length is left out.
    """
    data = draws.select("param", "chain", F.col("draw").cast("long").alias("draw"), as_double("value").alias("value"))
    own = data.groupBy("param", "chain").agg(F.min("draw").alias("start"), F.max("draw").alias("end"), F.count(F.lit(1)).alias("size"), F.count_distinct("draw").alias("draws"))
    whole = (F.col("size") == F.col("draws")) & (F.col("end") - F.col("start") + 1 == F.col("size"))
    own = own.withColumn("size", F.when(whole, F.col("size")).otherwise(F.raise_error(F.lit("draws of a chain must be numbered without gaps")).cast("long")))
    least = own.groupBy("param").agg(F.min("size").alias("n"))
    lines = own.join(least, "param").select("param", "chain", "start", "n", "size")
    t = F.col("draw") - F.col("start")
    cut = attach(data.withColumn("t", F.col("draw")), lines, ["param", "chain"], "size").withColumn("t", t).withColumn("half", F.floor(F.col("n") / 2))
    second = F.col("t") >= F.col("n") - F.col("half")
    kept = cut.where((F.col("t") < F.col("n")) & ((F.col("t") < F.col("half")) | second))
    return kept.select("param", F.concat_ws("/", F.col("chain").cast("string"), F.when(second, "2").otherwise("1")).alias("chain"), F.when(second, F.col("t") - (F.col("n") - F.col("half"))).otherwise(F.col("t")).alias("t"),
                       "value", "half")


def _scores(halves: DataFrame, value: str, name: str) -> DataFrame:
    """``halves`` with ``name``: normal scores of the average ranks of a column among all draws of the parameter."""
    counts = value_counts(halves, [value], ["param"])
    placed = running_counts(counts, ["param"])
    p = (F.col("below") + (F.col("ties") + 1) / F.lit(2.0) - 0.375) / (F.col("n") + 0.25)
    table = placed.select("param", F.col("value").alias(value), "ties", p.alias("p")).withColumn(name, normal_quantile("p")).drop("p")
    return attach_by_value(halves, table, value, "ties", ["param"], spread="t", total=halves.count()).drop("ties")


def _r_hat(per_chain: DataFrame, mean: str, var: str) -> Column:
    """From one line per chain: the root of pooled over within variance."""
    n = F.first("size")
    within = F.avg(var)
    return F.sqrt(F.try_divide((n - 1) / n * within + F.var_samp(mean), within))


def _scored(draws: DataFrame) -> DataFrame:
    """Halves of chains with ``bulk`` (normal scores), ``folded`` (normal scores of distances from the median) and tail marks."""
    halves = split_chains(draws)
    points = quantile_table(halves, ["value"], [0.5, *TAIL], ["param"]).select("param", F.col("q_0").alias("median"), F.col("q_1").alias("low"), F.col("q_2").alias("high"), "n")
    halves = attach(halves, points, ["param"], "n").drop("n").withColumn("distance", F.abs(F.col("value") - F.col("median")))
    return _scores(_scores(halves, "value", "bulk"), "distance", "folded")


def r_hat(draws: DataFrame) -> DataFrame:
    """(param, chains, draws, r_hat, r_hat_plain): values near 1 say that chains agree, above about 1.01 that they don't.

    ``r_hat`` is the larger one of the rank-normalised draws and of their distances from the median; ``r_hat_plain`` is the
    split statistic of the values themselves. Constant draws and chains of fewer than four give null.
    """
    return _r_hat_table(_scored(draws))


def _r_hat_table(scored: DataFrame) -> DataFrame:
    kinds = ("value", "bulk", "folded")
    aggs = [f(c).alias(f"{k}_{c}") for c in kinds for k, f in (("m", F.avg), ("v", F.var_samp))]
    per_chain = scored.groupBy("param", "chain").agg(F.count(F.lit(1)).alias("size"), *aggs)
    out = per_chain.groupBy("param").agg(
        (F.count(F.lit(1)) / 2).cast("long").alias("chains"), F.max("size").alias("draws"),
        *[_r_hat(per_chain, f"m_{c}", f"v_{c}").alias(f"r_{c}") for c in kinds])
    return out.select("param", "chains", (2 * F.col("draws")).alias("draws"), F.greatest("r_bulk", "r_folded").alias("r_hat"), F.col("r_value").alias("r_hat_plain"))


# --- effective sample sizes --------------------------------------------------------

def autocovariances(series: DataFrame, keys: Sequence[str], lags: int, block: int = BLOCK) -> DataFrame:
    """(keys..., lag, cross): sums of x_t x_(t + lag) of every series (keys, t, x) for lags from 0 to ``lags``.

    A row goes to its block and, if the lags of the block before reach it, to that one too.
    """
    size = max(block, lags)
    own = F.floor(F.col("t") / size)
    reached = (F.col("t") - own * size < lags) & (own > 0)
    rows = series.withColumn("block", F.explode(F.when(reached, F.array(own, own - 1)).otherwise(F.array(own))))

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        start = int(pdf["block"].iloc[0]) * size
        x, inside = pdf["x"].to_numpy(), pdf["t"].to_numpy() < start + size
        width = 1 << int(np.ceil(np.log2(len(x) + lags + 1)))
        ahead, here = np.fft.rfft(x, width), np.fft.rfft(np.where(inside, x, 0.0), width)
        cross = np.fft.irfft(ahead * np.conj(here), width)[:lags + 1]
        first = {k: [pdf[k].iloc[0]] * (lags + 1) for k in keys}
        return pd.DataFrame(first | {"lag": np.arange(lags + 1), "cross": cross})

    schema = ", ".join(f"`{k}` {series.schema[k].dataType.simpleString()}" for k in keys)
    parts = rows.groupBy(*keys, "block").applyInPandas(sums, f"{schema}, lag long, cross double")
    return parts.groupBy(*keys, "lag").agg(F.sum("cross").alias("cross"))


def independent_draws(rho: Sequence[float], size: int) -> float | None:
    """The effective size of ``size`` draws with autocorrelations ``rho`` from lag 0 on; None if more lags are needed.

    Sums of neighbouring pairs of lags (0 and 1, 2 and 3, ...) are positive and fall for a reversible chain: pairs count until the first
    sum below zero, none more than the one before it. Of that last pair the even lag still counts if it is positive.
    """
    rho = np.asarray(rho, float)
    pairs = rho[:len(rho) // 2 * 2].reshape(-1, 2).sum(axis=1)
    ended = np.flatnonzero(pairs < 0)
    if not len(ended):
        return None
    kept = np.minimum.accumulate(pairs[:ended[0]]).sum()
    time = -1 + 2 * kept + max(0.0, rho[2 * ended[0]])
    return size / max(time, 1 / np.log10(size))


def effective_sizes(series: DataFrame, lags: int = FIRST_LAGS) -> DataFrame:
    """(param, kind, size): effective sizes of every kind of series (param, kind, chain, t, x); null for constant ones.

    Lags grow until each quantity has what it needs; only the unfinished ones are looked at again.
    """
    need_checkpoint_dir(series.sparkSession)
    keys = ["param", "kind", "chain"]
    means = series.groupBy(*keys).agg(F.avg("x").alias("mean"), F.count(F.lit(1)).alias("n"))
    centred = attach(series, means, keys, "n").withColumn("x", F.col("x") - F.col("mean")).select(*keys, "t", "x")
    between = means.groupBy("param", "kind").agg(F.var_samp("mean").alias("between"), F.count(F.lit(1)).alias("chains"), F.max("n").alias("n"))
    longest = between.agg(F.max("n")).first()[0] or 0
    done, rest = None, centred
    while True:
        lags = min(lags, max(1, longest - 1))
        last = lags >= longest - 1

        def size(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("lag")
            n, chains, b = int(rows["n"].iloc[0]), int(rows["chains"].iloc[0]), rows["between"].iloc[0]
            cov = rows["cross"].to_numpy()[:n] / n  # the mean over chains
            pooled = cov[0] + (b if chains > 1 else 0.0)
            found = None
            if n > 3 and cov[0] > 1e-14 * max(1.0, abs(b)):
                rho = 1 - (cov[0] * n / (n - 1) - cov) / pooled
                rho[0] = 1.0
                found = independent_draws(rho, n * chains)
                if found is None and last:
                    found = independent_draws(np.append(rho[:len(rho) // 2 * 2], [-1.0, 0.0]), n * chains)
            else:
                return pd.DataFrame({"param": rows["param"].iloc[:1], "kind": rows["kind"].iloc[:1], "size": [None], "open": [False]})
            return pd.DataFrame({"param": rows["param"].iloc[:1], "kind": rows["kind"].iloc[:1], "size": [found], "open": [found is None]})

        mean = autocovariances(rest, keys, lags).groupBy("param", "kind", "lag").agg(F.avg("cross").alias("cross")).join(between, ["param", "kind"])
        param = series.schema["param"].dataType.simpleString()
        found = mean.groupBy("param", "kind").applyInPandas(size, f"param {param}, kind string, size double, open boolean").checkpoint()
        done = found if done is None else done.where("NOT open").unionByName(found)
        unfinished = found.where("open").select("param", "kind")
        if last or not unfinished.count():
            return done.drop("open")
        few = settle(unfinished)
        rest = centred.join(few if few is not None else unfinished, ["param", "kind"], "left_semi")
        lags *= MORE


def chain_diagnostics(draws: DataFrame) -> DataFrame:
    """(param, chains, draws, r_hat, ess_bulk, ess_tail, mcse_mean) of every parameter.

    ``ess_bulk`` is the effective size of the rank-normalised draws, ``ess_tail`` the smaller one for the 5 and 95 percent quantiles, and
    ``mcse_mean`` the standard error of the mean that the draws' own effective size gives.
    """
    need_checkpoint_dir(draws.sparkSession)
    scored = _scored(draws).checkpoint()
    kinds = {"bulk": F.col("bulk"), "plain": F.col("value"), "low": (F.col("value") <= F.col("low")).cast("double"), "high": (F.col("value") <= F.col("high")).cast("double")}
    cells = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("x")) for k, c in kinds.items()])
    sizes = effective_sizes(scored.select("param", "chain", "t", F.inline(cells)))
    wide = sizes.groupBy("param").agg(*[F.max(F.when(F.col("kind") == k, F.col("size"))).alias(k) for k in kinds])
    spread = scored.groupBy("param").agg(F.stddev_samp("value").alias("sd"))
    return _r_hat_table(scored).join(wide, "param").join(spread, "param").select(
        "param", "chains", "draws", "r_hat", F.col("bulk").alias("ess_bulk"), F.least("low", "high").alias("ess_tail"), (F.col("sd") / F.sqrt("plain")).alias("mcse_mean"))


def posterior_report(draws: DataFrame, mass: float = MASS) -> DataFrame:
    """The posterior summary with the diagnostics of its chains."""
    return posterior_summary(draws, mass).join(chain_diagnostics(draws).drop("draws"), "param")
