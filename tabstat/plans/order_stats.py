"""Exact quantiles and ranks without a single-task sort.

``percentile``, ``median`` and an unpartitioned rank window keep one group's
values in one task. Here every column is cut into value ranges (edges from a
mergeable sketch, a few hundred numbers), equal values are counted before the
shuffle, and running counts are taken inside each range; the offsets of the
ranges are a table with one row per range. The sketch only balances the work,
results are exact whatever its error.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabstat.plans.stats import as_double, settle


def range_count(df: DataFrame) -> int:
    """Ranges per column: a few per shuffle partition, so that one range fits a task."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return min(max(32, 4 * parts), 1024)


@dataclass(frozen=True)
class Ranges:
    """Edges per column from one sketch pass, with the row count and what the sketch says about ties."""

    cols: tuple[str, ...]
    splits: list[list[float]]
    rows: int
    tied: bool  # some value holds more than about one range
    complete: bool  # no column has a null

    def apply(self, df: DataFrame, suffix: str = "__range") -> DataFrame:
        """Add ``<col>__range``: a range number that grows with the (double) column, null for null."""
        raw = [c + suffix for c in self.cols]
        out = Bucketizer(splitsArray=self.splits, inputCols=list(self.cols), handleInvalid="keep",
                         outputCols=raw).transform(df)
        return out.withColumns({r: F.col(r).cast("int") for r in raw})


SKETCH_SIZE = 2000  # rank error about a tenth of a percent in some 45 KB per task


def sketch_ranges(df: DataFrame, cols: Sequence[str]) -> Ranges:
    """One pass without a shuffle of rows: each task sends one small mergeable sketch per column."""
    k = range_count(df)
    ranks = F.array(*[F.lit(i / k) for i in range(1, k)])
    sketch = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"n_{i}") for i, c in enumerate(cols)], *[
        F.when(F.count(c) > 0, F.kll_sketch_agg_double(as_double(c), SKETCH_SIZE)).alias(f"e_{i}")
        for i, c in enumerate(cols)])
    row = sketch.select("rows", *[f"n_{i}" for i in range(len(cols))], *[F.kll_sketch_get_quantile_double(f"e_{i}", ranks).alias(f"e_{i}")
                                  for i in range(len(cols))]).first()
    splits, tied = [], False
    for i in range(len(cols)):
        edges = [float(e) for e in (row[f"e_{i}"] or [0.0])]
        tied = tied or len(set(edges)) < len(edges)
        splits.append([float("-inf"), *sorted(set(edges)), float("inf")])
    return Ranges(tuple(cols), splits, row["rows"], tied, all(row[f"n_{i}"] == row["rows"] for i in range(len(cols))))


def with_ranges(df: DataFrame, cols: Sequence[str], suffix: str = "__range") -> DataFrame:
    return sketch_ranges(df, cols).apply(df, suffix)


def ranged_values(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., variable, value, range): non-null values of all columns, long, not shuffled."""
    data = df.select(*by, *[as_double(c).alias(c) for c in cols])
    data = data.na.drop(subset=list(by)) if by else data
    data = with_ranges(data, cols)
    cells = F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).alias("value"), F.col(c + "__range").alias("range"))
        for c in cols])
    return data.select(*by, F.inline(cells)).where(F.col("value").isNotNull())


def value_counts(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., variable, range, value, cnt): ties collapse before the shuffle."""
    return ranged_values(df, cols, by).groupBy(*by, "variable", "range", "value").agg(F.count(F.lit(1)).alias("cnt"))


def range_offsets(in_ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, range, in_range) -> with ``before`` (rows in lower ranges) and ``n``; one line per range."""
    per_key = Window.partitionBy(*keys)
    return in_ranges.select(
        *keys, "range", "in_range",
        (F.sum("in_range").over(per_key.orderBy("range")) - F.col("in_range")).alias("before"),
        F.sum("in_range").over(per_key).alias("n"))


def running_counts(counts: DataFrame, keys: Sequence[str], cnt: str = "cnt", shared: bool = False) -> DataFrame:
    """Add ``below`` (rows with a smaller value) and ``n`` per key group.

    ``counts`` holds ``keys``, ``range``, ``value`` and a count column. ``ties`` is the
    number of rows at the value; ``shared`` says that several lines may carry one value.
    """
    offsets = range_offsets(counts.groupBy(*keys, "range").agg(F.sum(cnt).alias("in_range")), keys).drop("in_range")
    in_range = Window.partitionBy(*keys, "range")
    through = F.sum(cnt).over(in_range.orderBy("value"))  # RANGE frame: peers included
    ties = F.sum(cnt).over(Window.partitionBy(*keys, "range", "value")) if shared else F.col(cnt)
    placed = counts.withColumn("ties", ties).withColumn("through", through)
    placed = placed.join(offsets, [*keys, "range"])
    return placed.withColumn("below", F.col("before") + F.col("through") - F.col("ties")) \
                 .drop("before", "through")


def average_rank():
    """Average rank of a value from ``below`` and ``ties``."""
    return F.col("below") + (F.col("ties") + 1) / F.lit(2.0)


ACCURACY = 10_000  # rank error of the sketch is at most 1 / ACCURACY


def quantile_table(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                   by: Sequence[str] = (), accuracy: int = ACCURACY) -> DataFrame:
    """(by..., variable, n, q_0..q_k): exact quantiles, linear interpolation.

    ``percentile_approx`` has a proven rank error, so it gives for every probability an
    interval that must hold the exact value. A second pass keeps the values inside those
    intervals (a few rows in ten thousand) and only counts the rows between them; the
    exact positions follow from the counts. Neither pass shuffles the table.
    """
    keys, margin = [*by, "variable"], 3.0 / accuracy
    data = df.select(*by, *[as_double(c).alias(c) for c in cols])
    data = data.na.drop(subset=list(by)) if by else data
    ends = [e for p in probs for e in (max(p - margin, 0.0), min(p + margin, 1.0))]
    sketch = data.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows__"), *[F.count(c).alias(f"n__{i}") for i, c in enumerate(cols)],
        *[F.percentile_approx(c, ends, accuracy).alias(f"e__{i}") for i, c in enumerate(cols)])
    sketch = sketch.select(*by, "rows__", *[f"n__{i}" for i in range(len(cols))], *[F.get(f"e__{i}", j).alias(f"e__{i}_{j}")
                                            for i in range(len(cols)) for j in range(len(ends))])
    if by:
        few = settle(sketch)
        data = data.join(few, list(by)) if few is not None else \
            attach_by_value(data, sketch, by[-1], "rows__", by[:-1], spread=cols[0], total=data.count())
        limits = [[F.col(f"e__{i}_{j}") for j in range(len(ends))] for i in range(len(cols))]
        sizes = [F.col(f"n__{i}") for i in range(len(cols))]
    else:
        row = sketch.first()
        limits = [[F.lit(row[f"e__{i}_{j}"]) for j in range(len(ends))] for i in range(len(cols))]
        sizes = [F.lit(row[f"n__{i}"]) for i in range(len(cols))]

    cells = []
    for i, c in enumerate(cols):
        short = sizes[i] <= 2 * accuracy  # too few rows for the margin to span a rank: keep them all
        inside, slot = short, F.lit(0)
        for j, p in enumerate(probs):
            above = F.lit(True) if p - margin <= 0 else F.col(c) >= limits[i][2 * j]
            below = F.lit(True) if p + margin >= 1 else F.col(c) <= limits[i][2 * j + 1]
            inside = inside | (above & below)
            slot = slot + above.cast("int") + (~below).cast("int")  # grows with the value
        slot = F.when(short, 0).otherwise(slot)
        cells.append(F.struct(F.lit(c).alias("variable"), F.when(F.col(c).isNotNull(), slot).alias("range"),
                              F.when(inside, F.col(c)).alias("value")))
    counts = data.select(*by, F.inline(F.array(*cells))).where(F.col("range").isNotNull()) \
                 .groupBy(*keys, "range", "value").agg(F.count(F.lit(1)).alias("cnt"))
    placed = running_counts(counts, keys)

    aggs = [F.first("n").alias("n")]
    for i, p in enumerate(probs):
        for name, round_off in (("lo", F.floor), ("hi", F.ceil)):
            spot = round_off((F.col("n") - 1) * F.lit(float(p)))
            here = (F.col("below") <= spot) & (spot < F.col("below") + F.col("ties"))
            aggs.append(F.max(F.when(here, F.col("value"))).alias(f"{name}_{i}"))
    out = placed.groupBy(*keys).agg(*aggs)
    cols_out = []
    for i, p in enumerate(probs):
        pos = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = (F.coalesce(f"{x}_{i}", F.raise_error(F.lit("quantile outside its interval")).cast("double")) for x in ("lo", "hi"))
        cols_out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(f"q_{i}"))
    return out.select(*keys, "n", *cols_out)


def quantile_row(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """One row with ``q_<column index>_<probability index>`` for every column."""
    long = quantile_table(df, cols, probs)
    return long.agg(*[
        F.max(F.when(F.col("variable") == c, F.col(f"q_{j}"))).alias(f"q_{i}_{j}")
        for i, c in enumerate(cols) for j in range(len(probs))])


def attach_by_value(rows: DataFrame, table: DataFrame, key: str, cnt: str, keys: Sequence[str],
                    spread: str, total: int | None) -> DataFrame:
    """Left join ``table`` (one row per keys+key) onto ``rows`` when a key may be hot.

    Entries holding more than 1/200 of the ``total`` rows number fewer than 200 (per
    pair of columns), so that part is broadcast; the rest goes through a shuffle join in
    which rows that are already matched are spread by a hash of ``spread``. Without a
    ``total`` no key is hot and a plain join does.
    """
    on = [*keys, key]
    if total is None:
        return rows.join(table, on, "left")
    payload = [c for c in table.columns if c not in on]
    hot = table.where(F.col(cnt) * 200 > F.lit(total))
    hot = hot.select(*on, *[F.col(c).alias("hot_" + c) for c in payload])
    step = rows.join(F.broadcast(hot), on, "left")
    salt = F.when(F.col("hot_" + cnt).isNull(), F.lit(0)) \
            .otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(4096)).cast("int"))
    step = step.withColumn("salt__", salt)
    cold = table.withColumn("salt__", F.lit(0))
    step = step.join(cold, [*on, "salt__"], "left")
    fixed = {c: F.coalesce(F.col("hot_" + c), F.col(c)) for c in payload}
    return step.withColumns(fixed).drop("salt__", *["hot_" + c for c in payload])
