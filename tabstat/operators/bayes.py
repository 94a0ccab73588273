"""Bayesian models with the workbench's priors, integrated instead of sampled.

Given its scale parameters every model here is linear and Gaussian, so the location part
is exact and only the scales are put on a grid. The data enter through moments: one pass
over the rows, then work whose size depends on columns or factor levels.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabstat.functions.labels import rope_label
from tabstat.plans.moments import moment_matrix
from tabstat.plans.order_stats import running_counts, value_counts
from tabstat.plans.stats import as_double, bounded_rows, local_table

MASS = 0.94          # probability of the highest-density interval
ROPE_SD = 0.1        # half width of the equivalence region in standard deviations
ODDS_GUARD = 1e-6    # keeps the direction odds finite

_erf = np.vectorize(math.erf, otypes=[float])
_TABLE_X = np.linspace(-6, 6, 24001)
_TABLE_Y = (1 + _erf(_TABLE_X / math.sqrt(2))) / 2


def _normal_cdf(z: np.ndarray) -> np.ndarray:
    """Interpolated, good to 1e-8: enough for intervals."""
    return np.interp(z, _TABLE_X, _TABLE_Y)


def _weights(logw: np.ndarray) -> np.ndarray:
    w = np.exp(logw - logw.max())
    return w / w.sum()


def _mixture(w: np.ndarray, m: np.ndarray, s: np.ndarray, mass: float = MASS) -> tuple[float, float, float, float, float, float]:
    """mean, sd, interval ends, P(>0), P(<0) of a mixture of normals."""
    keep = w > w.max() * 1e-10
    w, m, s = w[keep] / w[keep].sum(), m[keep], np.maximum(s[keep], 1e-300)
    mean = float(np.sum(w * m))
    sd = float(math.sqrt(np.sum(w * (s * s + (m - mean) ** 2))))
    x = np.linspace(mean - 8 * sd, mean + 8 * sd, 2001)
    cdf = np.zeros_like(x)
    for i in range(0, len(w), 256):
        cdf += w[i:i + 256] @ _normal_cdf((x[None, :] - m[i:i + 256, None]) / s[i:i + 256, None])
    lo, hi = _interval(x, cdf, mass)
    neg = float(np.sum(w * (1 + _erf(-m / (s * math.sqrt(2)))) / 2))
    return mean, sd, lo, hi, 1 - neg, neg


def _interval(x: np.ndarray, cdf: np.ndarray, mass: float) -> tuple[float, float]:
    """Shortest interval holding ``mass``."""
    start = np.linspace(0, 1 - mass, 2001)
    keep = np.concatenate([[True], np.diff(cdf) > 0])
    a, b = np.interp(start, cdf[keep], x[keep]), np.interp(start + mass, cdf[keep], x[keep])
    i = int(np.argmin(b - a))
    return float(a[i]), float(b[i])


def _on_grid(w: np.ndarray, x: np.ndarray, mass: float = MASS):
    """mean, sd and interval of a parameter that lives on the grid itself."""
    mean = float(np.sum(w * x))
    sd = float(math.sqrt(np.sum(w * (x - mean) ** 2)))
    order = np.argsort(x)
    lo, hi = _interval(x[order], np.cumsum(w[order]), mass)
    return mean, sd, lo, hi, 1.0, 0.0


def scale_grid(centre: float, dof: float, points: int = 401) -> np.ndarray:
    """Log-spaced scales around ``centre``, eight posterior deviations to each side (widened for few rows)."""
    half = 8.0 / math.sqrt(2.0 * max(dof, 1.0)) * (1 + 6.0 / max(dof, 1.0))
    return centre * np.exp(np.linspace(-half, half, points))


def _table(spark, rows) -> DataFrame:
    out = local_table(spark, rows, "param string, mean double, sd double, hdi_low double, hdi_high double, p_pos double, p_neg double")
    return out.withColumn("odds", (F.col("p_pos") + ODDS_GUARD) / (F.col("p_neg") + ODDS_GUARD))


def bayes_linear(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """Standardized regression: beta and intercept ~ N(0, 1), sigma ~ HalfCauchy(1)."""
    m = moment_matrix(df, [*xs, y])
    n, p = m.n, len(xs)
    sd = np.sqrt(np.diag(m.cross))
    r = m.cross / np.outer(sd, sd)
    zz, zy = r[:p, :p] * n, r[:p, p] * n
    resid = max(1 - float(r[:p, p] @ np.linalg.pinv(r[:p, :p]) @ r[:p, p]), 1e-12)
    sigma = scale_grid(math.sqrt(resid), n - p)
    values, axes = np.linalg.eigh(zz)
    proj = axes.T @ zy
    logw, means, var = np.zeros(len(sigma)), np.zeros((len(sigma), p)), np.zeros((len(sigma), p))
    for i, s in enumerate(sigma):
        a = values / s ** 2 + 1
        b = proj / s ** 2
        means[i] = axes @ (b / a)
        var[i] = (axes ** 2) @ (1 / a)
        logw[i] = (-n * math.log(s) - n / (2 * s * s) + 0.5 * np.sum(b * b / a) - 0.5 * np.sum(np.log(a))
                   - 0.5 * math.log(n / s ** 2 + 1) - math.log(1 + s * s) + math.log(s))
    w = _weights(logw)
    rows = [("intercept", *_mixture(w, np.zeros(len(sigma)), np.sqrt(1 / (n / sigma ** 2 + 1))))]
    rows += [(f"beta[{x}]", *_mixture(w, means[:, j], np.sqrt(var[:, j]))) for j, x in enumerate(xs)]
    rows.append(("sigma", *_on_grid(w, sigma)))
    return _table(df.sparkSession, rows)


def _group_rows(df: DataFrame, y: str, factors: Sequence[str], limit: int):
    """n, mean and population deviation per level (combination), sorted; size checked."""
    cells = df.na.drop(subset=[y, *factors]).groupBy(*factors).agg(
        F.count(F.lit(1)).alias("n"), F.avg(as_double(y)).alias("m"), F.stddev_pop(as_double(y)).alias("s"))
    return sorted(bounded_rows(cells, limit, "factor levels"), key=lambda r: tuple(str(r[f]) for f in factors))


def bayes_two_group(df: DataFrame, y: str, group: str, points: int = 401) -> DataFrame:
    """mu_j ~ N(mean_j, 2 sd_j), sigma_j ~ HalfNormal(2 sd_j), diff = mu1 - mu2; levels in order."""
    rows = _group_rows(df, y, [group], 2)
    if len(rows) != 2:
        raise ValueError("exactly two groups are needed")
    out, parts = [], []
    for j, r in enumerate(rows, 1):
        n, m, s = r["n"], r["m"], max(r["s"], 1e-300)
        sigma = scale_grid(s, n, points)
        v = 1 / (n / sigma ** 2 + 1 / (4 * s * s))
        w = _weights(-n * np.log(sigma) - n * s * s / (2 * sigma ** 2) + 0.5 * np.log(v) - sigma ** 2 / (8 * s * s) + np.log(sigma))
        out.append((f"mu{j}", *_mixture(w, np.full(points, m), np.sqrt(v))))
        out.append((f"sigma{j}", *_on_grid(w, sigma)))
        parts.append((m, w, v))
    (m1, w1, v1), (m2, w2, v2) = parts
    # mean and deviation are exact; the interval and the odds use every fourth grid point of both scales
    a, b = slice(None, None, 4), slice(None, None, 4)
    w = np.outer(w1[a], w2[b]).ravel()
    spread = np.sqrt(np.add.outer(v1[a], v2[b])).ravel()
    _, _, lo, hi, pos, neg = _mixture(w / w.sum(), np.full(len(w), m1 - m2), spread)
    out.append(("diff", m1 - m2, math.sqrt(float(np.sum(w1 * v1) + np.sum(w2 * v2))), lo, hi, pos, neg))
    return _table(df.sparkSession, out)


def bayes_one_way(df: DataFrame, y: str, group: str, max_levels: int = 500) -> DataFrame:
    """mu_g = mu + sigma_group z_g; mu ~ N(mean, 2 sd), sigma_group ~ HalfNormal(1), residual ~ HalfNormal(2 sd)."""
    rows = _group_rows(df, y, [group], max_levels)
    n, m = np.array([r["n"] for r in rows], float), np.array([r["m"] for r in rows])
    ssw = float(np.sum(n * np.array([r["s"] for r in rows]) ** 2))
    total, grand = n.sum(), float(np.sum(n * m) / n.sum())
    s_all = math.sqrt((ssw + np.sum(n * (m - grand) ** 2)) / total)
    dof = total - len(n)
    resid = scale_grid(math.sqrt(max(ssw / max(dof, 1), 1e-12)), dof, 61)
    between = np.concatenate([np.geomspace(1e-3, 0.3, 20)[:-1], np.linspace(0.3, 5.0, 60)])
    edge = np.gradient(between)
    prior = 4 * s_all ** 2
    logw, mu, mu_var = [], [], []
    g_mean, g_var, pairs = [], [], []
    for s in resid:
        for t, width in zip(between, edge):
            v = t * t + s * s / n
            a = np.sum(1 / v) + 1 / prior
            d = m - grand
            b = np.sum(d / v)
            lw = (-(total - len(n)) * math.log(s) - ssw / (2 * s * s) - 0.5 * np.sum(np.log(v)) - 0.5 * np.sum(d * d / v)
                  + 0.5 * b * b / a - 0.5 * math.log(a) - t * t / 2 - s * s / (8 * s_all ** 2) + math.log(s) + math.log(width))
            shrink = t * t / v
            centre = b / a
            logw.append(lw)
            mu.append(grand + centre)
            mu_var.append(1 / a)
            g_mean.append(grand + centre + shrink * (d - centre))
            g_var.append(shrink * s * s / n + (1 - shrink) ** 2 / a)
            pairs.append((s, t))
    w = _weights(np.array(logw))
    pairs, g_mean, g_var = np.array(pairs), np.array(g_mean), np.array(g_var)
    out = [("mu_global", *_mixture(w, np.array(mu), np.sqrt(np.array(mu_var))))]
    out += [(f"mu[{r[group]}]", *_mixture(w, g_mean[:, i], np.sqrt(g_var[:, i]))) for i, r in enumerate(rows)]
    for name, col, axis in (("sigma_residual", 0, resid), ("sigma_group", 1, between)):
        margin = np.array([w[pairs[:, col] == v].sum() for v in axis])
        out.append((name, *_on_grid(margin, axis)))
    return _table(df.sparkSession, out)


def bayes_two_factor(df: DataFrame, y: str, a: str, b: str, max_cells: int = 400) -> DataFrame:
    """Sum-to-zero main effects and interaction, N(0, 1) on the free effects, sigma ~ HalfNormal(2 sd)."""
    rows = _group_rows(df, y, [a, b], max_cells)
    la, lb = sorted({str(r[a]) for r in rows}), sorted({str(r[b]) for r in rows})
    ca = np.vstack([np.eye(len(la) - 1), -np.ones(len(la) - 1)])
    cb = np.vstack([np.eye(len(lb) - 1), -np.ones(len(lb) - 1)])
    n, m = np.array([r["n"] for r in rows], float), np.array([r["m"] for r in rows])
    ss = float(np.sum(n * np.array([r["s"] for r in rows]) ** 2))
    grand = float(np.sum(n * m) / n.sum())
    s_all = math.sqrt((ss + np.sum(n * (m - grand) ** 2)) / n.sum())
    ia, ib = [la.index(str(r[a])) for r in rows], [lb.index(str(r[b])) for r in rows]

    def design(i: int, j: int) -> np.ndarray:
        return np.concatenate([[1.0], ca[i], cb[j], np.outer(ca[i], cb[j]).ravel()])

    x = np.array([design(i, j) for i, j in zip(ia, ib)])
    prior = np.concatenate([[1 / (4 * s_all ** 2)], np.ones(x.shape[1] - 1)])
    d = m - grand
    xx, xy, yy = x.T @ (n[:, None] * x), x.T @ (n * d), float(np.sum(n * d * d)) + ss
    dof = n.sum() - len(rows)
    sigma = scale_grid(math.sqrt(max(ss / max(dof, 1), 1e-12)), dof, 201)
    effects = [("mu_global", np.eye(x.shape[1])[0])]
    ka, kb = len(la) - 1, len(lb) - 1
    for i, v in enumerate(la):
        effects.append((f"alpha[{v}]", np.concatenate([[0.0], ca[i], np.zeros(kb + ka * kb)])))
    for j, v in enumerate(lb):
        effects.append((f"beta[{v}]", np.concatenate([np.zeros(1 + ka), cb[j], np.zeros(ka * kb)])))
    for i, u in enumerate(la):
        for j, v in enumerate(lb):
            effects.append((f"interaction[{u},{v}]", np.concatenate([np.zeros(1 + ka + kb), np.outer(ca[i], cb[j]).ravel()])))
    basis = np.array([e for _, e in effects])
    logw, means, var = np.zeros(len(sigma)), np.zeros((len(sigma), len(effects))), np.zeros((len(sigma), len(effects)))
    for i, s in enumerate(sigma):
        prec = xx / s ** 2 + np.diag(prior)
        cov = np.linalg.inv(prec)
        mean = cov @ (xy / s ** 2)
        means[i], var[i] = basis @ mean, np.einsum("ki,ij,kj->k", basis, cov, basis)
        logw[i] = (-n.sum() * math.log(s) - yy / (2 * s * s) + 0.5 * mean @ prec @ mean - 0.5 * np.linalg.slogdet(prec)[1]
                   - s * s / (8 * s_all ** 2) + math.log(s))
    w = _weights(logw)
    means[:, 0] += grand
    out = [(name, *_mixture(w, means[:, i], np.sqrt(np.maximum(var[:, i], 0)))) for i, (name, _) in enumerate(effects)]
    out.append(("sigma", *_on_grid(w, sigma)))
    return _table(df.sparkSession, out)


# --- draws tables (chain, draw, param, value) -------------------------------------------

def highest_density(draws: DataFrame, mass: float = MASS, bucket: int = 65_536) -> DataFrame:
    """(param, hdi_low, hdi_high): shortest interval holding ``mass`` of the draws.

    Positions in the sorted draws come from running counts; the value that lies a fixed
    number of positions further is looked up inside position buckets, so a parameter with
    very many draws is not sorted in one task.
    """
    wide = draws.select("param", as_double("value").alias("value"))
    counts = value_counts(wide, ["value"], ["param"])
    placed = running_counts(counts, ["param"]).select("param", "value", "below", "ties", "n")
    gap = F.floor(F.col("n") * F.lit(mass))
    first = F.floor(F.col("below") / bucket)
    last = F.floor((F.col("below") + F.col("ties") - 1) / bucket)
    known = placed.withColumn("bucket", F.explode(F.sequence(first, last))).select(
        "param", "bucket", F.greatest("below", F.col("bucket") * bucket).alias("pos"), F.lit(0).alias("kind"),
        "value", F.lit(None).cast("double").alias("start"))
    asked = placed.select("param", (F.col("below") + gap).alias("pos"), "value", "n").where("pos < n").select(
        "param", F.floor(F.col("pos") / bucket).alias("bucket"), "pos", F.lit(1).alias("kind"),
        F.lit(None).cast("double").alias("value"), F.col("value").alias("start"))
    w = Window.partitionBy("param", "bucket").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    ends = known.unionByName(asked).withColumn("end", F.last("value", ignorenulls=True).over(w)).where("kind = 1")
    best = ends.groupBy("param").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("width"), "start", "end")).alias("b"))
    return best.select("param", F.col("b.start").alias("hdi_low"), F.col("b.end").alias("hdi_high"))


def posterior_summary(draws: DataFrame, mass: float = MASS) -> DataFrame:
    """(param, n, mean, sd, hdi_low, hdi_high) of a draws table."""
    basic = draws.groupBy("param").agg(F.count("value").alias("n"), F.avg("value").alias("mean"),
                                       F.stddev_samp("value").alias("sd"))
    return basic.join(highest_density(draws, mass), "param")


def _odds(value):
    pos = F.avg(F.when(value > 0, 1.0).otherwise(0.0))
    neg = F.avg(F.when(value < 0, 1.0).otherwise(0.0))
    return (pos + ODDS_GUARD) / (neg + ODDS_GUARD)


def direction_odds(draws: DataFrame) -> DataFrame:
    """(param, odds): (P(>0) + 1e-6) / (P(<0) + 1e-6)."""
    return draws.groupBy("param").agg(_odds(F.col("value")).alias("odds"))


def rope(draws: DataFrame, low, high) -> DataFrame:
    """(param, inside, verdict): share of draws in [low, high]; limits are numbers or columns."""
    inside = F.avg(F.when((F.col("value") >= low) & (F.col("value") <= high), 1.0).otherwise(0.0))
    return draws.groupBy("param").agg(inside.alias("inside")).withColumn("verdict", rope_label(F.col("inside")))


def rope_of_column(draws: DataFrame, df: DataFrame, y: str) -> DataFrame:
    """Equivalence region of +-0.1 sample deviations of a data column."""
    sd = df.agg(F.stddev_samp(as_double(y)).alias("s")).scalar()
    return rope(draws, -ROPE_SD * sd, ROPE_SD * sd)


def pair_differences(draws: DataFrame) -> DataFrame:
    """(param1, param2, mean, sd, odds, inside, verdict) for every pair of parameters.

    Differences are taken within (chain, draw); the region is +-0.1 deviations of the
    difference itself.
    """
    a = draws.select("chain", "draw", F.col("param").alias("param1"), F.col("value").alias("v1"))
    b = draws.select("chain", "draw", F.col("param").alias("param2"), F.col("value").alias("v2"))
    d = a.join(b, ["chain", "draw"]).where(F.col("param1") < F.col("param2")) \
         .select("param1", "param2", (F.col("v1") - F.col("v2")).alias("value"))
    stats = d.groupBy("param1", "param2").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"),
                                              _odds(F.col("value")).alias("odds"))
    limit = F.lit(ROPE_SD) * F.col("sd")
    inside = d.join(stats.select("param1", "param2", "sd"), ["param1", "param2"]).groupBy("param1", "param2").agg(
        F.avg(F.when(F.abs("value") <= limit, 1.0).otherwise(0.0)).alias("inside"))
    out = stats.join(inside, ["param1", "param2"])
    return out.withColumn("verdict", rope_label(F.col("inside")))
