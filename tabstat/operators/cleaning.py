"""Missing values, outliers and scaling.

Statistics enter as scalar subqueries: one aggregation for all columns of a call,
then a map-only projection over the table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabstat.operators.columns import columns_of, drop_missing
from tabstat.plans.order_stats import quantile_row, with_ranges
from tabstat.plans.stats import as_double, one_row, scalar_stats
from tabstat.sources.tables import overview


def _numeric(df: DataFrame, cols: Sequence[str]) -> list[str]:
    have = set(columns_of(df, ("numeric",)))
    return [c for c in cols if c in have]


def modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row ``mode_<i>``: most frequent non-null value, smallest on ties.

    Values are counted by a distributed group-by, not in one task's hash map.
    """
    numeric = set(columns_of(df, ("numeric",)))
    cells = F.array(*[
        F.struct(F.lit(i).alias("i"),
                 (as_double(c) if c in numeric else F.lit(None).cast("double")).alias("num"),
                 (F.lit(None) if c in numeric else F.col(c)).cast("string").alias("txt"))
        for i, c in enumerate(cols)])
    long = df.select(F.inline(cells)).where(F.col("num").isNotNull() | F.col("txt").isNotNull())
    counts = long.groupBy("i", "num", "txt").agg(F.count(F.lit(1)).alias("cnt"))
    best = counts.groupBy("i").agg(F.min(F.struct((-F.col("cnt")).alias("neg"), "num", "txt")).alias("b"))
    return best.agg(*[
        F.max(F.when(F.col("i") == i, F.col("b.num" if c in numeric else "b.txt"))).alias(f"mode_{i}")
        for i, c in enumerate(cols)])


def impute(df: DataFrame, cols: Sequence[str], strategy: str, constant=None) -> DataFrame:
    """Fill nulls by ``mean``, ``median``, ``mode`` or ``constant``."""
    if strategy == "constant":
        return df.na.fill({c: constant for c in cols if c in df.columns})
    if strategy == "mode":
        cols = [c for c in cols if c in df.columns]
        if not cols:
            return df
        row = one_row(modes(df, cols))
        kinds = dict(df.dtypes)
        return df.withColumns({c: F.coalesce(F.col(c), row[f"mode_{i}"].cast(kinds[c]))
                               for i, c in enumerate(cols)})
    cols = _numeric(df, cols)
    if not cols:
        return df
    if strategy == "mean":
        row = scalar_stats(df, [F.avg(as_double(c)).alias(f"v_{i}") for i, c in enumerate(cols)])
        value = {c: row[f"v_{i}"] for i, c in enumerate(cols)}
    elif strategy == "median":
        row = one_row(quantile_row(df, cols, [0.5]))
        value = {c: row[f"q_{i}_0"] for i, c in enumerate(cols)}
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return df.withColumns({c: F.coalesce(as_double(c), value[c]) for c in cols})


def impute_all(df: DataFrame) -> DataFrame:
    """Mean for numeric columns, mode for the others."""
    numeric = columns_of(df, ("numeric",))
    rest = [c for c in columns_of(df, ("categorical", "date"))]
    out = impute(df, numeric, "mean")
    return impute(out, rest, "mode") if rest else out


def interpolate(df: DataFrame, cols: Sequence[str], order_by: str,
                partition_by: Sequence[str] = ()) -> DataFrame:
    """Linear by row position within each series, ends filled with the nearest value.

    ``order_by`` must be unique inside a series. A series is cut into ranges of the
    order column, so a series holding a third of all rows is still spread: positions
    and neighbours are found inside each range, then carried across ranges through a
    table with one row per (series, range).
    """
    cols = _numeric(df, cols)
    keys = list(partition_by)
    data = df.withColumn("pos__", as_double(order_by) if order_by in columns_of(df, ("numeric",))
                         else F.unix_micros(F.col(order_by).cast("timestamp")).cast("double"))
    data = with_ranges(data, ["pos__"])
    # one struct key: equal also where a series key is null, and shared by window, sum and join
    data = data.withColumn("chunk__", F.struct(*keys, "pos____range"))
    chunk = Window.partitionBy("chunk__").orderBy(order_by)
    # the next value is the last one of the reversed order: a frame that only grows costs one step per row
    reverse = Window.partitionBy("chunk__").orderBy(F.col(order_by).desc())
    back = chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = reverse.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    data = data.withColumn("rn__", F.row_number().over(chunk))

    def seen(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.col("rn__").cast("double").alias("at"),
                                                     as_double(c).alias("v")))

    summary = data.groupBy("chunk__").agg(
        F.count(F.lit(1)).alias("len__"),
        *[F.max(seen(c)).alias(f"last_{i}") for i, c in enumerate(cols)],
        *[F.min(seen(c)).alias(f"first_{i}") for i, c in enumerate(cols)])
    series, spot = Window.partitionBy(*[F.col("chunk__")[k] for k in keys]), F.col("chunk__")["pos____range"]
    before = series.orderBy(spot).rowsBetween(Window.unboundedPreceding, -1)
    after = series.orderBy(spot.desc()).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("len__").over(before), F.lit(0)).cast("double")
    summary = summary.withColumn("start__", start)

    def shifted(name: str) -> Column:
        return F.when(F.col(name).isNotNull(),
                      F.struct((F.col(f"{name}.at") + F.col("start__")).alias("at"), F.col(f"{name}.v").alias("v")))

    for i in range(len(cols)):
        summary = summary.withColumns({f"last_{i}": shifted(f"last_{i}"), f"first_{i}": shifted(f"first_{i}")})
    carry = summary.select(
        "chunk__", "start__",
        *[F.last(f"last_{i}", ignorenulls=True).over(before).alias(f"prev_{i}") for i in range(len(cols))],
        *[F.last(f"first_{i}", ignorenulls=True).over(after).alias(f"next_{i}") for i in range(len(cols))])

    local = {}
    for i, c in enumerate(cols):
        local[f"lo_{i}"] = F.last(seen(c), ignorenulls=True).over(back)
        local[f"hi_{i}"] = F.last(seen(c), ignorenulls=True).over(ahead)
    data = data.withColumns(local)
    joined = data.join(carry, "chunk__", "left")
    filled = {}
    for i, c in enumerate(cols):
        at = F.col("rn__") + F.col("start__")
        lo_at = F.coalesce(F.col(f"lo_{i}.at") + F.col("start__"), F.col(f"prev_{i}.at"))
        lo_v = F.coalesce(F.col(f"lo_{i}.v"), F.col(f"prev_{i}.v"))
        hi_at = F.coalesce(F.col(f"hi_{i}.at") + F.col("start__"), F.col(f"next_{i}.at"))
        hi_v = F.coalesce(F.col(f"hi_{i}.v"), F.col(f"next_{i}.v"))
        line = lo_v + (hi_v - lo_v) * F.try_divide(at - lo_at, hi_at - lo_at)
        filled[c] = F.coalesce(as_double(c), line, lo_v, hi_v)
    return joined.withColumns(filled).select(*df.columns)


def iqr_bounds(df: DataFrame, cols: Sequence[str], factor: float = 1.5) -> DataFrame:
    """(variable, lower, upper): quartile fences of every numeric column."""
    from tabstat.plans.order_stats import quantile_table
    q = quantile_table(df, _numeric(df, cols), [0.25, 0.75])
    width = F.col("q_1") - F.col("q_0")
    return q.select("variable", (F.col("q_0") - factor * width).alias("lower"),
                    (F.col("q_1") + factor * width).alias("upper"))


def _fences(df: DataFrame, cols: Sequence[str], factor: float, with_median: bool = False):
    probs = [0.25, 0.75, 0.5] if with_median else [0.25, 0.75]
    row = one_row(quantile_row(df, cols, probs))
    out = {}
    for i, c in enumerate(cols):
        width = row[f"q_{i}_1"] - row[f"q_{i}_0"]
        out[c] = (row[f"q_{i}_0"] - factor * width, row[f"q_{i}_1"] + factor * width,
                  row[f"q_{i}_2"] if with_median else None)
    return out


def detect_outliers(df: DataFrame, col: str, factor: float = 1.5) -> DataFrame:
    """Rows outside the fences of ``col``; empty when it is not numeric."""
    if not _numeric(df, [col]):
        return df.limit(0)
    lo, hi, _ = _fences(df, [col], factor)[col]
    return df.where((F.col(col) < lo) | (F.col(col) > hi))


def winsorize(df: DataFrame, bounds: Mapping[str, tuple]) -> DataFrame:
    """Clip to given bounds, nulls stay (row-wise, so it also accepts a stream)."""
    def clip(c: str) -> Column:
        lo, hi = bounds[c]
        x = as_double(c)
        return F.when(x < lo, lo).when(x > hi, hi).otherwise(x)
    return df.withColumns({c: clip(c) for c in bounds})


def handle_outliers(df: DataFrame, cols: Sequence[str], method: str, factor: float = 1.5) -> DataFrame:
    """``remove`` rows, ``winsorize``, or replace by the ``median``; bounds come from the input."""
    cols = _numeric(df, cols)
    if not cols:
        return df
    fences = _fences(df, cols, factor, with_median=method == "median")
    if method == "winsorize":
        return winsorize(df, {c: fences[c][:2] for c in cols})
    outside = {c: F.coalesce((F.col(c) < fences[c][0]) | (F.col(c) > fences[c][1]), F.lit(False)) for c in cols}
    if method == "remove":
        return df.where(~reduce(or_, outside.values()))
    if method == "median":
        return df.withColumns({c: F.when(outside[c], fences[c][2]).otherwise(as_double(c)) for c in cols})
    raise ValueError(f"unknown method {method!r}")


def zscore(df: DataFrame, cols: Sequence[str], ddof: int = 1) -> DataFrame:
    """``<c>_z``; a constant column gives 0."""
    cols = _numeric(df, cols)
    sd = F.stddev_samp if ddof == 1 else F.stddev_pop
    row = scalar_stats(df, [a for i, c in enumerate(cols)
                            for a in (F.avg(as_double(c)).alias(f"m_{i}"), sd(as_double(c)).alias(f"s_{i}"))])
    return df.withColumns({
        f"{c}_z": F.when(row[f"s_{i}"] == 0, F.lit(0.0)).otherwise(
            F.try_divide(as_double(c) - row[f"m_{i}"], row[f"s_{i}"]))
        for i, c in enumerate(cols)})


def minmax(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``<c>_minmax`` in [0, 1]; a constant column gives 0."""
    cols = _numeric(df, cols)
    row = scalar_stats(df, [a for i, c in enumerate(cols)
                            for a in (F.min(as_double(c)).alias(f"lo_{i}"), F.max(as_double(c)).alias(f"hi_{i}"))])
    return df.withColumns({
        f"{c}_minmax": F.when(row[f"lo_{i}"] == row[f"hi_{i}"], F.lit(0.0)).otherwise(
            F.try_divide(as_double(c) - row[f"lo_{i}"], row[f"hi_{i}"] - row[f"lo_{i}"]))
        for i, c in enumerate(cols)})


def log1p_clip(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``<c>_log`` = log(1 + max(c, 0))."""
    return df.withColumns({f"{c}_log": F.log1p(F.when(F.col(c) < 0, 0.0).otherwise(as_double(c)))
                           for c in _numeric(df, cols)})


def change_report(before: DataFrame, after: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, rows_before, rows_after, nulls_before, nulls_after): what a recipe changed, one pass per side."""
    def counts(df: DataFrame, suffix: str) -> DataFrame:
        return overview(df.select(*cols)).select("column", F.col("n_rows").alias(f"rows_{suffix}"),
                                                 (F.col("n_rows") - F.col("n_non_null")).alias(f"nulls_{suffix}"))
    return counts(before, "before").join(F.broadcast(counts(after, "after")), "column")  # one line per column


# recipe step name -> operator; every entry takes (df, cols, **options)
STEPS: dict[str, Callable[..., DataFrame]] = {
    "drop_missing": drop_missing,
    "impute": impute,
    "interpolate": interpolate,
    "outliers": handle_outliers,
    "zscore": zscore,
    "minmax": minmax,
    "log": log1p_clip,
}


def clean(df: DataFrame, steps: Sequence[tuple]) -> DataFrame:
    """Ordered recipe of (step, columns, options)."""
    for name, cols, *options in steps:
        df = df.transform(STEPS[name], cols, **(options[0] if options else {}))
    return df
