"""Multilevel linear models on group tables.

Rows are read once and reduced to one line per group; all likelihood work happens on
those lines, and for random intercepts on one line per distinct group size. The profile
likelihood is evaluated for a whole grid of variance ratios in one aggregation and the
grid is narrowed a few times.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstat.functions.tails import chi2_upper, normal_two_sided
from tabstat.operators.linear import linear_prediction
from tabstat.plans.moments import correlation, moments
from tabstat.plans.stats import as_double, local_table

# limits of the pre-checks, fixed values
MIN_GROUPS = 5
MIN_GROUP_ROWS = 5
MIN_WITHIN_VARIANCE = 1e-5
MAX_MEAN_CORRELATION = 0.9


def multilevel_checks(df: DataFrame, y: str, group: str, xs: Sequence[str]) -> DataFrame:
    """(check, variable, value, ok): group count, smallest group, within variance, mean correlation."""
    groups = df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(as_double(y)).alias("my"),
        *[F.var_samp(as_double(x)).alias(f"v_{i}") for i, x in enumerate(xs)],
        *[F.avg(as_double(x)).alias(f"m_{i}") for i, x in enumerate(xs)])
    row = groups.agg(F.count(F.lit(1)).cast("double").alias("groups"), F.min("n").cast("double").alias("smallest"),
                     *[F.min(f"v_{i}").alias(f"v_{i}") for i in range(len(xs))],
                     *[correlation(F.col("my"), F.col(f"m_{i}")).alias(f"r_{i}") for i in range(len(xs))])

    def cell(check, variable, value, ok):
        return F.struct(F.lit(check).alias("check"), F.lit(variable).cast("string").alias("variable"),
                        F.col(value).alias("value"), ok.alias("ok"))

    cells = [cell("groups", None, "groups", F.col("groups") >= MIN_GROUPS),
             cell("smallest group", None, "smallest", F.col("smallest") >= MIN_GROUP_ROWS)]
    for i, x in enumerate(xs):
        cells.append(cell("within variance", x, f"v_{i}", F.col(f"v_{i}") >= MIN_WITHIN_VARIANCE))
        cells.append(cell("mean correlation", x, f"r_{i}", F.abs(f"r_{i}") <= MAX_MEAN_CORRELATION))
    return row.select(F.inline(F.array(*cells)))


# --- profile likelihood ------------------------------------------------------------

@dataclass(frozen=True)
class Profile:
    """Fixed effects and likelihoods for given variance ratios."""

    beta: np.ndarray
    cov: np.ndarray
    sigma2: float
    reml: float
    ml: float


def profile(full: np.ndarray, logdet: float, n: int, p: int) -> Profile:
    """From A'V^-1A of A = [1, x, y] and log|V| (V in units of the residual variance)."""
    xx, xy, yy = full[:p, :p], full[:p, p], full[p, p]
    scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
    inv = np.linalg.pinv(xx / np.outer(scale, scale)) / np.outer(scale, scale)
    beta = inv @ xy
    rss = max(float(yy - xy @ beta), 1e-300)
    _, logdet_x = np.linalg.slogdet(xx)
    s2 = rss / (n - p)
    reml = -0.5 * ((n - p) * (math.log(2 * math.pi * s2) + 1) + logdet + logdet_x)
    ml = -0.5 * (n * (math.log(2 * math.pi * rss / n) + 1) + logdet)
    return Profile(beta, inv * s2, s2, reml, ml)


def _matrix(row, p: int) -> np.ndarray:
    a = np.zeros((p + 1, p + 1))
    for i in range(p + 1):
        for j in range(i, p + 1):
            a[i, j] = a[j, i] = row[f"a_{i}_{j}"]
    return a


def _narrow(evaluate: Callable[[list[tuple]], dict], dims: int, score: Callable, rounds: int = 6, points: int = 13):
    """Maximize over ratios in [0, 1e8] by narrowing a log grid around the best point.

    ``evaluate`` takes a list of grid points and answers all of them in one job.
    """
    axes = [[0.0, *np.logspace(-6, 6, 25 if dims == 1 else 13)] for _ in range(dims)]
    best, seen = None, {}
    for _ in range(rounds):
        grid = [tuple(g) for g in np.array(np.meshgrid(*axes)).T.reshape(-1, dims)]
        new = evaluate([g for g in grid if g not in seen])
        seen.update(new)
        best = max(seen, key=lambda g: score(seen[g]))
        nxt = []
        for d in range(dims):
            values = sorted(set(axes[d]))
            i = values.index(best[d]) if best[d] in values else int(np.argmin(np.abs(np.array(values) - best[d])))
            lo, hi = values[max(i - 1, 0)], values[min(i + 1, len(values) - 1)]
            if best[d] == 0.0:
                nxt.append([0.0, *np.linspace(0, hi, points)[1:]])
            else:
                nxt.append(list(np.linspace(lo, hi, points)) + [best[d]])
        axes = nxt
    return best, seen[best]


@dataclass
class MixedResult:
    y: str
    xs: tuple[str, ...]
    fixed: DataFrame       # variable, coef, se, z, p_value
    components: DataFrame  # component, variance, icc
    fit: DataFrame         # n, groups, loglik_reml, loglik_ml, aic, bic, parameters
    profile: Profile
    variances: dict[str, float]
    random: Callable[[], DataFrame]

    @property
    def icc(self) -> float | None:
        return guarded_icc(self.variances)

    def score(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        """Fixed-part prediction, null where an input is missing."""
        b = self.profile.beta
        return df.withColumn(prediction, linear_prediction(self.xs, b[0], b[1:]))


def guarded_icc(variances: Mapping[str, float]) -> float | None:
    """Share of the non-residual variance; null when it is outside [0, 1]."""
    total = sum(variances.values())
    if not total > 0:
        return None
    icc = (total - variances["residual"]) / total
    return icc if 0 <= icc <= 1 else None


def _result(spark, y, xs, prof: Profile, variances: dict, n: int, groups: int, shift: np.ndarray, random) -> MixedResult:
    """Tables of a fitted model; the fit used centred columns, so the intercept is shifted back."""
    p = len(xs) + 1
    back = np.eye(p)
    back[0, 1:] = -shift[:-1]
    beta = back @ prof.beta
    beta[0] += shift[-1]
    cov = back @ prof.cov @ back.T
    prof = Profile(beta, cov, prof.sigma2, prof.reml, prof.ml)
    rows = [(v, float(b), float(math.sqrt(max(c, 0)))) for v, b, c in zip(["const", *xs], beta, np.diag(cov))]
    fixed = local_table(spark, rows, "variable string, coef double, se double")
    fixed = fixed.withColumn("z", F.try_divide("coef", "se")).withColumn("p_value", normal_two_sided(F.col("z")))
    total = sum(variances.values())
    comp = local_table(spark, [(k, float(v), float(v / total) if total > 0 else None) for k, v in variances.items()],
                       "component string, variance double, icc double")
    k = p + len(variances)
    fit = local_table(spark, [(n, groups, prof.reml, prof.ml, -2 * prof.ml + 2 * k, -2 * prof.ml + math.log(n) * k, k)],
                      "n bigint, groups bigint, loglik_reml double, loglik_ml double, aic double, bic double, parameters int")
    return MixedResult(y, tuple(xs), fixed, comp, fit, prof, variances, random)


def _centred(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str]):
    """Complete rows with centred columns ``c0..cp``, their means and count."""
    cols = [*xs, y]
    data = df.select(*keys, *[as_double(c).alias(f"v{i}") for i, c in enumerate(cols)]).na.drop()
    row = data.agg(F.count(F.lit(1)), *[F.avg(f"v{i}") for i in range(len(cols))]).first()
    mean = np.array(row[1:], dtype=float)
    data = data.select(*keys, *[(F.col(f"v{i}") - float(m)).alias(f"c{i}") for i, m in enumerate(mean)])
    return data, mean, int(row[0])


def _within(groups: DataFrame, p: int):
    """Summed within-group cross products of [x, y] and the number of groups."""
    row = groups.agg(F.count(F.lit(1)).alias("g"), *[F.sum(f"s_{i}_{j}").alias(f"s_{i}_{j}")
                                                       for i in range(p) for j in range(i, p)]).first()
    a = np.zeros((p + 1, p + 1))
    for i in range(p):
        for j in range(i, p):
            a[i + 1, j + 1] = a[j + 1, i + 1] = row[f"s_{i}_{j}"]
    return a, int(row["g"])


def _mean(i: int):
    """Entry i of the group mean of [1, x, y]."""
    return F.lit(1.0) if i == 0 else F.col(f"m_{i - 1}")


def mixed(df: DataFrame, y: str, xs: Sequence[str], group: str) -> MixedResult:
    """Random-intercept model by restricted maximum likelihood."""
    p = len(xs) + 1
    data, mean, n = _centred(df, y, xs, [group])
    groups = moments(data, [f"c{i}" for i in range(p)], [group]).persist()
    within, g = _within(groups, p)
    # groups of one size enter the likelihood only through these sums
    sizes = groups.groupBy("n").agg(F.count(F.lit(1)).alias("k"), *[
        F.sum(_mean(i) * _mean(j)).alias(f"b_{i}_{j}") for i in range(p + 1) for j in range(i, p + 1)]).persist()

    def evaluate(points):
        table = sizes.withColumn("l", F.explode(F.array(*[F.lit(float(x[0])) for x in points])))
        w = F.col("n") / (1 + F.col("n") * F.col("l"))
        rows = table.groupBy("l").agg(
            F.sum(F.col("k") * F.log1p(F.col("n") * F.col("l"))).alias("logdet"),
            *[F.sum(w * F.col(f"b_{i}_{j}")).alias(f"a_{i}_{j}") for i in range(p + 1) for j in range(i, p + 1)]).collect()
        return {(r["l"],): profile(within + _matrix(r, p), r["logdet"], n, p) for r in rows}

    (ratio,), prof = _narrow(evaluate, 1, lambda q: q.reml)
    variances = {"group": ratio * prof.sigma2, "residual": prof.sigma2}
    sizes.unpersist()
    groups.unpersist()

    def random() -> DataFrame:
        fitted = linear_prediction([f"m_{i}" for i in range(p - 1)], prof.beta[0], prof.beta[1:])
        shrink = F.lit(ratio) * F.col("n") / (1 + F.lit(ratio) * F.col("n"))
        table = moments(data, [f"c{i}" for i in range(p)], [group])
        return table.select(group, "n", (shrink * (F.col(f"m_{p - 1}") - fitted)).alias("effect"))

    return _result(df.sparkSession, y, xs, prof, variances, n, g, mean, random)


def nested(df: DataFrame, y: str, xs: Sequence[str], level2: str, level3: str) -> MixedResult:
    """Three levels: rows in level-2 units inside level-3 groups, restricted maximum likelihood."""
    if level2 == level3:
        raise ValueError("the two levels must differ")
    p = len(xs) + 1
    data, mean, n = _centred(df, y, xs, [level3, level2])
    cells = moments(data, [f"c{i}" for i in range(p)], [level3, level2]).persist()
    within, _ = _within(cells, p)
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    sizes = cells.groupBy(level3, "n").agg(
        F.count(F.lit(1)).alias("k"), *[F.sum(_mean(i)).alias(f"t_{i}") for i in range(p + 1)],
        *[F.sum(_mean(i) * _mean(j)).alias(f"b_{i}_{j}") for i, j in pairs]).persist()
    g = sizes.select(level3).distinct().count()

    def evaluate(points):
        first = sorted({x[0] for x in points})
        second = sorted({x[1] for x in points})
        t = sizes.withColumn("l2", F.explode(F.array(*[F.lit(float(v)) for v in first])))
        w = F.col("n") / (1 + F.col("n") * F.col("l2"))
        groups = t.groupBy(level3, "l2").agg(
            F.sum(F.col("k") * F.log1p(F.col("n") * F.col("l2"))).alias("logdet"),
            *[F.sum(w * F.col(f"t_{i}")).alias(f"t_{i}") for i in range(p + 1)],
            *[F.sum(w * F.col(f"b_{i}_{j}")).alias(f"b_{i}_{j}") for i, j in pairs])
        u = groups.withColumn("l3", F.explode(F.array(*[F.lit(float(v)) for v in second])))
        cut = F.col("l3") / (1 + F.col("l3") * F.col("t_0"))
        rows = u.groupBy("l2", "l3").agg(
            F.sum(F.col("logdet") + F.log1p(F.col("l3") * F.col("t_0"))).alias("logdet"),
            *[F.sum(F.col(f"b_{i}_{j}") - cut * F.col(f"t_{i}") * F.col(f"t_{j}")).alias(f"a_{i}_{j}") for i, j in pairs]).collect()
        return {(r["l2"], r["l3"]): profile(within + _matrix(r, p), r["logdet"], n, p) for r in rows}

    (l2, l3), prof = _narrow(evaluate, 2, lambda q: q.reml, rounds=7, points=9)
    sizes.unpersist()
    cells.unpersist()
    variances = {"level3": l3 * prof.sigma2, "level2": l2 * prof.sigma2, "residual": prof.sigma2}

    def random() -> DataFrame:
        """Predicted effect of every level-3 group."""
        table = moments(data, [f"c{i}" for i in range(p)], [level3, level2])
        fitted = linear_prediction([f"m_{i}" for i in range(p - 1)], prof.beta[0], prof.beta[1:])
        w = F.col("n") / (1 + F.lit(l2) * F.col("n"))
        sums = table.groupBy(level3).agg(F.sum(w).alias("w"), F.sum(w * (F.col(f"m_{p - 1}") - fitted)).alias("r"))
        return sums.select(level3, (F.lit(l3) * F.col("r") / (1 + F.lit(l3) * F.col("w"))).alias("effect"))

    return _result(df.sparkSession, y, xs, prof, variances, n, g, mean, random)


def two_factor_components(df: DataFrame, y: str, xs: Sequence[str], factor1: str, factor2: str) -> MixedResult:
    """The workbench's "cross-classified" model.

    As it is specified there, the second factor varies inside groups of the first, which
    is the nested form and not a crossed model.
    """
    return nested(df, y, xs, level2=factor2, level3=factor1)


# --- random slopes ---------------------------------------------------------------------

def _slope_terms(pdf: pd.DataFrame, dim: int) -> np.ndarray:
    """Raw cross products of [1, columns] per group, groups x (dim+1) x (dim+1)."""
    g = len(pdf)
    a = np.zeros((g, dim + 1, dim + 1))
    n = pdf["n"].to_numpy(float)
    m = np.column_stack([np.ones(g), *[pdf[f"m_{i}"].to_numpy(float) for i in range(dim)]])
    a += n[:, None, None] * m[:, :, None] * m[:, None, :]
    for i in range(dim):
        for j in range(i, dim):
            s = pdf[f"s_{i}_{j}"].to_numpy(float)
            a[:, i + 1, j + 1] += s
            if i != j:
                a[:, j + 1, i + 1] += s
    return a


def _cholesky(theta: np.ndarray, q: int) -> np.ndarray:
    """Lower factor of the relative covariance; the diagonal is stored as a logarithm."""
    low = np.zeros((q, q))
    at = np.tril_indices(q)
    low[at] = theta
    low[np.diag_indices(q)] = np.exp(np.diag(low))
    return low


def mixed_slopes(df: DataFrame, y: str, xs: Sequence[str], group: str, slopes: Sequence[str],
                 intercept: bool = True, rounds: int = 60, tol: float = 2e-3) -> MixedResult:
    """Random intercept and slopes with a full covariance matrix, restricted maximum likelihood.

    Groups are reduced to raw cross products once. Each round scores a star of candidate
    covariance factors in one pass over the group table (Arrow batches of groups, summed
    per candidate), moves to the best and narrows. ``fit`` says whether it settled.
    """
    cols = [*xs, *[s for s in slopes if s not in xs], y]
    dim, p = len(cols), len(xs) + 1
    data, mean, n = _centred(df, y, cols[:-1], [group])
    table = moments(data, [f"c{i}" for i in range(dim)], [group]).persist()
    g = table.count()
    x_at = list(range(p)) + [dim]
    z_at = ([0] if intercept else []) + [1 + cols.index(s) for s in slopes]
    # centred slopes span the same effects only together with an intercept
    shift = np.array([0.0] + [mean[cols.index(s)] for s in slopes]) if intercept else None
    raw = mean if not intercept else None
    q = len(z_at)
    names = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    schema = "c int, logdet double, " + ", ".join(f"a_{i}_{j} double" for i, j in names)

    def products(pdf: pd.DataFrame) -> np.ndarray:
        a = _slope_terms(pdf, dim)
        if raw is not None:  # undo the centring of the slopes when there is no random intercept
            t = np.eye(dim + 1)
            t[0, 1:dim] = raw[:dim - 1]
            a = np.einsum("ki,gkl,lj->gij", t, a, t)
        return a

    def evaluate(thetas: list[np.ndarray]) -> list[Profile]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                a = products(pdf)
                full, zz, za = a[:, x_at][:, :, x_at], a[:, z_at][:, :, z_at], a[:, z_at][:, :, x_at]
                out = []
                for c, theta in enumerate(thetas):
                    low = _cholesky(theta, q)
                    inner = np.eye(q) + low.T @ zz @ low
                    right = low.T @ za
                    part = full - np.einsum("gki,gkj->gij", right, np.linalg.solve(inner, right))
                    total = part.sum(axis=0)
                    out.append((c, float(np.linalg.slogdet(inner)[1].sum()), *[float(total[i, j]) for i, j in names]))
                yield pd.DataFrame(out, columns=["c", "logdet", *[f"a_{i}_{j}" for i, j in names]])

        rows = table.mapInPandas(run, schema).groupBy("c").agg(
            F.sum("logdet").alias("logdet"), *[F.sum(f"a_{i}_{j}").alias(f"a_{i}_{j}") for i, j in names]).collect()
        got = {r["c"]: profile(_matrix(r, p), r["logdet"], n, p) for r in rows}
        return [got[c] for c in range(len(thetas))]

    count = q * (q + 1) // 2
    lower = np.tril_indices(q)
    diag = lower[0] == lower[1]
    theta = np.zeros(count)
    # start from slopes in units of their own spread
    sd = [1.0] + [1.0] * (q - 1)
    row = data.agg(*[F.stddev_pop(f"c{cols.index(s)}") for s in slopes]).first()
    for i, s in enumerate(slopes):
        sd[i + (1 if intercept else 0)] = row[i] or 1.0
    unit = np.array([1.0 if d else 1.0 / sd[r] for (r, d) in zip(lower[0], diag)])
    theta[diag] = [math.log(0.5 / sd[i]) for i in range(q)]
    step, best, settled, last_move = 1.0, evaluate([theta])[0], False, np.zeros(count)
    for _ in range(rounds):
        moves = [s * step * np.eye(count)[i] * unit for i in range(count) for s in (1, -1)]
        moves += [s * step * (np.eye(count)[i] * unit + t * np.eye(count)[j] * unit)
                  for i in range(count) for j in range(i) for s in (1, -1) for t in (1, -1)]
        if last_move.any():
            moves += [last_move, 2 * last_move]
        scored = evaluate([theta + m for m in moves])
        top = max(range(len(moves)), key=lambda i: scored[i].reml)
        if scored[top].reml > best.reml + 1e-9:
            theta, best, last_move = theta + moves[top], scored[top], moves[top]
        else:
            last_move = np.zeros(count)
            step /= 2
            if step < tol:
                settled = True
                break
    low = _cholesky(theta, q)
    cov = low @ low.T * best.sigma2
    if shift is not None:
        # intercept effect at zero of the uncentred slopes
        t = np.eye(q)
        t[0, 1:] = -shift[1:]
        cov_raw = t @ cov @ t.T
    else:
        cov_raw = cov
    labels = (["intercept"] if intercept else []) + list(slopes)
    variances = {labels[i]: float(cov_raw[i, i]) for i in range(q)} | {"residual": best.sigma2}
    beta, spark = best.beta.copy(), df.sparkSession
    if raw is not None:
        used_mean = np.concatenate([np.zeros(len(xs)), mean[-1:]])
    else:
        used_mean = np.concatenate([mean[:len(xs)], mean[-1:]])

    def random() -> DataFrame:
        """Predicted intercept and slopes of every group (slopes on centred columns)."""
        source = moments(data, [f"c{i}" for i in range(dim)], [group])
        out = source.select(group).schema
        for name in labels:
            out = out.add(name, "double")

        def run(batches):
            for pdf in batches:
                a = products(pdf)
                zz, za = a[:, z_at][:, :, z_at], a[:, z_at][:, :, x_at]
                resid = za[:, :, p] - za[:, :, :p] @ beta
                inner = np.eye(q) + low.T @ zz @ low
                u = low @ np.linalg.solve(inner, (low.T @ resid[:, :, None]))
                yield pd.DataFrame({group: pdf[group]} | {name: u[:, i, 0] for i, name in enumerate(labels)})
        return source.mapInPandas(run, out)

    result = _result(spark, y, xs, best, variances, n, g, used_mean, random)
    covariance = [(labels[i], labels[j], float(cov_raw[i, j])) for i in range(q) for j in range(i + 1)]
    result.components = local_table(spark, covariance + [("residual", "residual", best.sigma2)],
                                    "term1 string, term2 string, covariance double")
    result.fit = result.fit.withColumn("settled", F.lit(settled))
    table.unpersist()
    return result


# --- comparisons and metrics ---------------------------------------------------------

def compare_levels(two: MixedResult, three: MixedResult) -> DataFrame:
    """(loglik, AIC, BIC of both, lrt, p_value): likelihood-ratio test of the third level."""
    a = two.fit.select(F.col("loglik_reml").alias("loglik2"), F.col("aic").alias("aic2"), F.col("bic").alias("bic2"))
    b = three.fit.select(F.struct(F.col("loglik_reml").alias("l"), F.col("aic").alias("a"), F.col("bic").alias("b")).alias("s")).scalar()
    out = a.withColumns({"loglik3": b["l"], "aic3": b["a"], "bic3": b["b"]})
    out = out.withColumn("lrt", 2 * (F.col("loglik3") - F.col("loglik2")))
    return out.withColumn("p_value", chi2_upper(F.greatest("lrt", F.lit(0.0)), F.lit(1)))


def _per_variable(spark, dims: Mapping[str, Sequence[str]], value) -> DataFrame:
    rows = [(d, v) for d, vs in dims.items() for v in vs]
    return local_table(spark, rows, "Grupo string, `Variável` string").withColumn("metrica", value)


def icc_table(result: MixedResult, dims: Mapping[str, Sequence[str]]) -> DataFrame:
    """The model's ICC repeated for every (dimension, variable); null outside [0, 1]."""
    return _per_variable(result.fixed.sparkSession, dims, F.lit(result.icc).cast("double"))


def pseudo_r2(df: DataFrame, y: str, prediction: str) -> DataFrame:
    """(pseudo_r2): 1 - SSR/SST over rows that have the parts, null outside [-1, 1]."""
    yv, e = as_double(y), as_double(y) - as_double(prediction)
    row = df.agg(F.coalesce(F.sum(e * e), F.lit(0.0)).alias("ssr"), (F.var_pop(yv) * F.count(yv)).alias("sst"))
    r2 = F.when(F.col("sst") > 0, 1 - F.try_divide(F.col("ssr"), F.col("sst")))
    return row.select(r2.alias("r2")).select(F.when(F.col("r2").between(-1, 1), F.col("r2")).alias("pseudo_r2"))


def pseudo_r2_table(df: DataFrame, y: str, prediction: str, dims: Mapping[str, Sequence[str]]) -> DataFrame:
    """The pseudo R2 repeated for every (dimension, variable)."""
    return _per_variable(df.sparkSession, dims, pseudo_r2(df, y, prediction).scalar())
