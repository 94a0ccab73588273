"""Crossed random effects: two grouping factors, neither of them inside the other.

Rows are reduced to one line per occupied cell of the two factors. Variances follow from sums of squares (inside the levels of
either factor, in all, and of what two fixed factors leave) whose expectations are linear in them for any unbalanced design
(Henderson 1953, Gao and Owen 2017). Fixed effects and the predicted effects of all levels solve the mixed model equations by
alternating over the two factors; the intercept moves together with the first one, which keeps the number of sweeps small. Where one factor
has few levels, the other's effects are linear in its, so cross products from one pass over the cells stand for the cells in every sweep.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tabstat.operators.linear import linear_prediction, solve
from tabstat.plans.graph import connected_components
from tabstat.plans.moments import moment_matrix
from tabstat.plans.order_stats import attach_by_value
from tabstat.plans.stats import as_double, local_table, settle
from tabstat.session import need_checkpoint_dir


#: Levels of one factor up to which sweeps run on the cross products of the other one's levels instead of on the cells.
FEW_LEVELS = 256
#: Levels whose cells are multiplied at once.
BLOCK_LEVELS = 4096


@dataclass
class Crossed:
    y: str
    xs: tuple[str, ...]
    factors: tuple[str, str]
    fixed: DataFrame       # variable, coef
    components: DataFrame  # component, variance, icc
    effects: DataFrame     # factor, level, rows, effect
    variances: dict[str, float]
    sweeps: int
    intercept: float
    beta: np.ndarray
    tables: tuple[DataFrame, DataFrame]

    def score(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        """Fixed part plus the effects of both levels; a level not seen in the fit has none."""
        out = df.withColumn(prediction, linear_prediction(self.xs, self.intercept, self.beta))
        for name, table in zip(self.factors, self.tables):
            renamed = table.select(F.col("level").alias(name), F.col("effect").alias("effect__"), F.col("n").alias("n__"))
            few = settle(renamed)
            joined = out.join(few, name, "left") if few is not None else attach_by_value(out, renamed, name, "n__", [], spread=self.y, total=out.count())
            out = joined.withColumn(prediction, F.col(prediction) + F.coalesce("effect__", F.lit(0.0))).drop("effect__", "n__")
        return out.select(*df.columns, prediction)


def _cells(df: DataFrame, residual: Column, centred: Sequence[Column], a: str, b: str) -> DataFrame:
    """(a, b, n, r, rr, x0...): count and sums of every occupied cell."""
    rows = df.select(F.col(a).alias("a"), F.col(b).alias("b"), residual.alias("r"), *[c.alias(f"x{i}") for i, c in enumerate(centred)])
    return rows.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("r").alias("r"), F.sum(F.col("r") * F.col("r")).alias("rr"),
                                      *[F.sum(f"x{i}").alias(f"x{i}") for i in range(len(centred))])


def _inside(cells: DataFrame, factor: str) -> dict[str, float]:
    """The sum of squares inside the levels of a factor, and what its expectation has of the other factor and of the residual."""
    per = cells.groupBy(factor).agg(F.sum("n").alias("n"), F.sum("r").alias("r"), F.sum("rr").alias("rr"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    return per.agg(F.sum(F.col("rr") - F.col("r") * F.col("r") / F.col("n")).alias("squares"), F.sum(F.col("n") - F.col("nn") / F.col("n")).alias("other"),
                   F.sum(F.col("n") - 1).alias("own"), F.sum(F.col("n") * F.col("n")).alias("sizes")).first().asDict()


def crossed_components(df: DataFrame, y: str, xs: Sequence[str], a: str, b: str) -> DataFrame:
    """(component, variance, icc) of both factors and the residual in two passes, from the residuals of least squares.

    Unbiased for any design, but rough where the factors' variances are far above the residual's or bias the slopes: ``crossed`` is better
    there. A negative estimate is 0. The residuals' lost degrees of freedom are not made up for, which matters for few rows only.
    """
    data = df.select(*dict.fromkeys([a, b, y, *xs])).na.drop()
    s = solve(moment_matrix(data, [*xs, y]))
    residual = as_double(y) - linear_prediction(xs, s.intercept, s.beta)
    return _component_table(df.sparkSession, _solved(_cells(data, residual, [], a, b)), a, b)


def _solved(cells: DataFrame, residual: float | None = None) -> np.ndarray:
    """Variances of a, b and the residual; the residual's may be given."""
    in_a, in_b = _inside(cells, "a"), _inside(cells, "b")
    if residual is not None:
        other = [(x["squares"] - x["own"] * residual) / x["other"] if x["other"] > 0 else 0.0 for x in (in_b, in_a)]
        return np.maximum([*other, residual], 0.0)
    n, r, rr = cells.agg(F.sum("n"), F.sum("r"), F.sum("rr")).first()
    left = np.array([[0.0, in_a["other"], in_a["own"]], [in_b["other"], 0.0, in_b["own"]], [n - in_a["sizes"] / n, n - in_b["sizes"] / n, n - 1]])
    right = np.array([in_a["squares"], in_b["squares"], rr - r * r / n])
    keep = [0, 1, 2]
    while True:  # what comes out negative is set to 0, the rest is solved without it
        found = np.zeros(3)
        found[keep] = np.linalg.lstsq(left[:, keep] / np.maximum(left[:, 2:], 1), right / np.maximum(left[:, 2], 1), rcond=None)[0]
        bad = [k for k in keep[:-1] if found[k] < 0]
        if not bad:
            return np.maximum(found, 0.0)
        keep.remove(min(bad, key=lambda k: found[k]))


def _component_table(spark, variances: np.ndarray, a: str, b: str) -> DataFrame:
    total = variances.sum() or 1.0
    return local_table(spark, [(name, float(v), float(v / total)) for name, v in zip((a, b, "residual"), variances)], "component string, variance double, icc double")


@dataclass
class _Fit:
    shift: float
    delta: np.ndarray
    u: DataFrame
    v: DataFrame
    squares: float  # what is left of the responses
    sweeps: int


def _alternate(cells: DataFrame, inverse: np.ndarray, xr: np.ndarray, penalty: Sequence[float | None], sweeps: int, tol: float) -> _Fit:
    """The mixed model equations of r = shift + x delta + u + v with ``penalty`` on the squares of u and v.

    A penalty of 0 makes fixed effects (there is no shift then), None leaves the factor out. ``inverse`` is that of the centred cross products
    of x, ``xr`` their products with r. Sweeps end when the sum of squares changes by less than ``tol`` of it.
    """
    for few, many in ("ba", "ab"):
        sums = [F.sum(c).alias(c) for c in ("n", "r", *[f"x{i}" for i in range(len(xr))], "rr")]
        levels = cells.groupBy(F.col(few).alias("level")).agg(*sums).limit(FEW_LEVELS + 1).collect()
        if len(levels) <= FEW_LEVELS:
            return _alternate_few(cells, levels, few, many, inverse, xr, dict(zip("ab", penalty)), sweeps, tol)
    return _alternate_cells(cells, inverse, xr, penalty, sweeps, tol)


def _cross_products(cells: DataFrame, levels: DataFrame, few: str, many: str, p: int, q: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Cross products of (r, x, n per level of ``few``, n, 1) over the levels of ``many``, times h = 1 / (n + penalty) and times n h h."""
    size, names = p + q + 3, ["r", *[f"x{i}" for i in range(p)]]
    upper = np.triu_indices(size)
    lines = cells.join(levels.select(F.col("level").alias(few), "k"), few).groupBy(many).agg(F.collect_list(F.struct("k", "n", *names)).alias("cells"))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, size, size))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_LEVELS):
                part = batch.column(0).slice(at, BLOCK_LEVELS)
                line, cell = np.repeat(np.arange(len(part)), pc.list_value_length(part).to_numpy(zero_copy_only=False)), part.flatten()
                k, n, *rest = (cell.field(i).to_numpy(zero_copy_only=False) for i in range(2 + len(names)))
                z = np.zeros((len(part), size))
                for i, values in enumerate(rest):
                    z[:, i] = np.bincount(line, values, len(part))
                z[line, p + 1 + k] = n
                z[:, -2], z[:, -1] = np.bincount(line, n, len(part)), 1
                h = 1 / (z[:, -2] + penalty)
                found[0] += (z * h[:, None]).T @ z
                found[1] += (z * (z[:, -2] * h * h)[:, None]).T @ z
        values = np.concatenate([found[0][upper], found[1][upper]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["k", "v"])

    table = lines.select("cells").mapInArrow(products, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    values = np.zeros(2 * len(upper[0]))
    values[table["k"].to_numpy()] = table["v"].to_numpy()
    out = np.zeros((2, size, size))
    out[:, upper[0], upper[1]] = values.reshape(2, -1)
    out[:, upper[1], upper[0]] = values.reshape(2, -1)
    return out[0], out[1]


def _alternate_few(cells: DataFrame, levels: Sequence[Row], few: str, many: str, inverse: np.ndarray, xr: np.ndarray,
                   penalty: Mapping[str, float | None], sweeps: int, tol: float) -> _Fit:
    """``_alternate`` where the levels of one factor are known with their sums: the effects of ``many`` are h (r - x delta - n f - n shift) of each level."""
    spark, p, q = cells.sparkSession, len(xr), len(levels)
    sums = np.array([[float(v) for v in row[1:]] for row in levels])
    n, r, x, rr = sums[:, 0], sums[:, 1], sums[:, 2:2 + p], float(sums[:, -1].sum())
    kind = cells.schema[few].dataType.simpleString()
    named = local_table(spark, [(row["level"], k) for k, row in enumerate(levels)], f"level {kind}, k int")
    size = p + q + 3
    products, squared = np.zeros((2, size, size)) if penalty[many] is None else _cross_products(cells, F.broadcast(named), few, many, p, q, penalty[many])
    hs = slice(p + 1, p + 1 + q)
    shift, delta, f, last = 0.0, np.zeros(p), np.zeros(q), None
    state, g = np.zeros(size), np.zeros(size)  # what the effects of ``many`` were made from, and their sums with r, x, n per level and n

    def many_step() -> None:
        nonlocal shift, state, g
        state = np.concatenate([[1.0], -delta, -f, [0.0, 0.0]])
        if penalty[many] is None:
            shift = float((r.sum() - x.sum(axis=0) @ delta - n @ f) / n.sum())
        elif penalty[many] != 0:
            shift = float(products[-1] @ state / products[-1, -2])
        state[-2] = -shift
        g = products @ state

    def few_step() -> None:
        nonlocal shift, f
        s = r - x @ delta - g[hs]
        if penalty[few] is None or penalty[few] != 0:
            w = np.ones(q) if penalty[few] is None else 1 / (1 + n / penalty[few])
            shift = float(s @ w / (n @ w))
        f = np.zeros(q) if penalty[few] is None else (s - n * shift) / (n + penalty[few])

    for sweep in range(1, sweeps + 1):
        for step in ((many_step, few_step) if many == "a" else (few_step, many_step)):
            step()
        c = shift + f
        explained = float(r @ c + g[0])
        squares = rr - 2 * explained + float(n @ c**2 + 2 * c @ g[hs] + state @ squared @ state)
        left = xr - (x.T @ c + g[1:p + 1])
        delta = inverse @ left if p else delta
        squares = max(squares - float(delta @ left), 0.0)
        if last is not None and abs(squares - last) <= tol * max(squares, 1e-300):
            break
        last = squares

    small = F.broadcast(local_table(spark, [(row["level"], float(a), float(e)) for row, a, e in zip(levels, n, f)], f"level {kind}, n double, effect double"))
    used = local_table(spark, [(row["level"], float(-e)) for row, e in zip(levels, state[hs])], f"level {kind}, effect double")
    rest = cells.withColumn("rest", reduce(add, [F.col(f"x{i}") * float(d) for i, d in enumerate(state[1:p + 1])], F.col("r")))
    per = _minus(rest, F.broadcast(used), few).groupBy(F.col(many).alias("level")).agg(F.sum("n").alias("n"), F.sum("rest").alias("s"))
    effect = F.lit(0.0) if penalty[many] is None else (F.col("s") + F.col("n") * F.lit(float(state[-2]))) / (F.col("n") + float(penalty[many]))
    large = per.select("level", "n", effect.alias("effect"))
    u, v = (large, small) if many == "a" else (small, large)
    return _Fit(shift, delta, u, v, squares, sweep)


def _alternate_cells(cells: DataFrame, inverse: np.ndarray, xr: np.ndarray, penalty: Sequence[float | None], sweeps: int, tol: float) -> _Fit:
    """``_alternate`` over the cells, for two factors with many levels."""
    p, shift, v, last = len(xr), 0.0, None, None
    delta = np.zeros(p)

    def step(rest: DataFrame, factor: str, k: int) -> DataFrame:
        """The effects of a factor, and the shift that goes best with them, given all else."""
        nonlocal shift
        per = rest.groupBy(F.col(factor).alias("level")).agg(F.sum("n").alias("n"), F.sum("rest").alias("s"))
        if penalty[k] == 0:
            return _settled(per.withColumn("effect", F.col("s") / F.col("n") - F.lit(shift)))
        per = _settled(per)
        w = F.lit(1.0) if penalty[k] is None else 1 / (1 + F.col("n") / float(penalty[k]))
        one = per.agg(F.sum(F.col("s") * w).alias("s"), F.sum(F.col("n") * w).alias("n")).first()
        shift = float(one["s"] / one["n"])
        return per.withColumn("effect", F.lit(0.0) if penalty[k] is None else (F.col("s") - F.col("n") * F.lit(shift)) / (F.col("n") + float(penalty[k])))

    for sweep in range(1, sweeps + 1):
        slope = reduce(add, [F.col(f"x{i}") * float(d) for i, d in enumerate(delta)], F.lit(0.0))
        rest = cells.withColumn("rest", F.col("r") - slope)
        u = step(_minus(rest, v, "b"), "a", 0)
        v = step(_minus(rest, u, "a"), "b", 1)
        both = _minus(_minus(cells.withColumn("rest", -F.col("n") * F.lit(float(shift))), u, "a"), v, "b")  # minus what is explained, without x
        each = F.col("rest") / F.col("n")
        row = both.agg(F.sum(F.col("rr") + 2 * F.col("r") * each + F.col("rest") * each).alias("ss"), *[F.sum(F.col(f"x{i}") * each).alias(f"x{i}") for i in range(p)]).first()
        left = xr + np.array([row[f"x{i}"] for i in range(p)])
        delta = inverse @ left if p else delta
        squares = max(row["ss"] - float(delta @ left), 0.0)
        if last is not None and abs(squares - last) <= tol * max(squares, 1e-300):
            break
        last = squares
    return _Fit(float(shift), delta, u, v, squares, sweep)


def _lost(cells: DataFrame) -> int:
    """Degrees of freedom of both factors as fixed effects: their levels, less one for each part of the design that hangs together."""
    (levels_a, most_a), (levels_b, most_b) = (cells.groupBy(f).agg(F.count(F.lit(1)).alias("k")).agg(F.count(F.lit(1)), F.max("k")).first() for f in ("a", "b"))
    parts = 1
    if most_a < levels_b and most_b < levels_a:  # no level meets all of the other factor's
        edges = cells.select(F.xxhash64(F.lit(1), "a").alias("u"), F.xxhash64(F.lit(2), "b").alias("v"))
        parts = connected_components(edges).select("component").distinct().count()
    return levels_a + levels_b - parts


def crossed(df: DataFrame, y: str, xs: Sequence[str], a: str, b: str, sweeps: int = 200, tol: float = 1e-8) -> Crossed:
    """Fixed effects, variances and predicted effects of both factors' levels, on complete cases.

    First both factors are fixed effects: that gives the residual variance and slopes that the factors don't bias. The sums of squares inside the
    levels then give each factor's variance. With these the mixed model equations are solved for the fixed and predicted effects. Where
    fixed effects leave no degrees of freedom, the residual variance comes from the sums of squares as well.
    """
    need_checkpoint_dir(df.sparkSession)
    data = df.select(*dict.fromkeys([a, b, y, *xs])).na.drop()
    m = moment_matrix(data, [*xs, y])
    s, p = solve(m), len(xs)
    centred = [as_double(x) - F.lit(float(mean)) for x, mean in zip(xs, m.mean)]

    def cells_of(beta: np.ndarray) -> DataFrame:
        return _cells(data, as_double(y) - float(m.mean[p]) - reduce(add, [c * float(k) for c, k in zip(centred, beta)], F.lit(0.0)), centred, a, b).checkpoint()

    cells = cells_of(s.beta)
    own = _alternate(cells, s.inverse, np.zeros(p), (0.0, 0.0), sweeps, tol)
    dof = m.n - _lost(cells) - s.rank
    within = s.beta + own.delta
    cells = cells_of(within)
    variances = _solved(cells, own.squares / dof if dof > 0 else None)
    ratio = [float(variances[2] / v) if v > 0 else None for v in variances[:2]]
    xr = m.cross[:p, p] - m.cross[:p, :p] @ within
    fit = _alternate(cells, s.inverse, xr, ratio, sweeps, tol)
    beta = within + fit.delta
    intercept = float(m.mean[p] + fit.shift - beta @ m.mean[:p])
    spark = df.sparkSession
    fixed = local_table(spark, [(name, float(c)) for name, c in zip(["const", *xs], [intercept, *beta])], "variable string, coef double")
    effects = [t.select(F.lit(name).alias("factor"), F.col("level").cast("string").alias("level"), F.col("n").cast("long").alias("rows"), "effect") for name, t in ((a, fit.u), (b, fit.v))]
    named = dict(zip((a, b, "residual"), map(float, variances)))
    return Crossed(y, tuple(xs), (a, b), fixed, _component_table(spark, variances, a, b), effects[0].unionByName(effects[1]), named, fit.sweeps, intercept, beta, (fit.u, fit.v))


def _settled(table: DataFrame) -> DataFrame:
    """A table of levels computed once: local if it is small, else written to the checkpoint folder."""
    few = settle(table)
    return few if few is not None else table.checkpoint()


def _minus(cells: DataFrame, effects: DataFrame | None, factor: str) -> DataFrame:
    """``rest`` less the effects of a factor's levels times the rows of the cell."""
    if effects is None:
        return cells
    joined = cells.join(effects.select(F.col("level").alias(factor), F.col("effect").alias("e__")), factor)
    return joined.withColumn("rest", F.col("rest") - F.col("n") * F.col("e__")).drop("e__")
