"""Clusterings, their quality and their profiles."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from operator import add, and_

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabstat.operators import far
from tabstat.operators.derive import components
from tabstat.operators.describe import group_means
from tabstat.plans.stats import as_double, bounded_rows, local_table, spread_out


def to_numbers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Coerce the clustering columns to double; what cannot be read becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in cols})


def scaling(df: DataFrame, cols: Sequence[str], scale: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Means and population deviations of the complete rows (0 and 1 when not scaling)."""
    if not scale:
        return np.zeros(len(cols)), np.ones(len(cols))
    row = df.select(*cols).na.drop().agg(*[F.avg(c) for c in cols], *[F.stddev_pop(c) for c in cols]).first()
    sd = np.array([v if v else 1.0 for v in row[len(cols):]], dtype=float)
    return np.array(row[:len(cols)], dtype=float), sd


def scaled(cols: Sequence[str], mean: Sequence[float], sd: Sequence[float]) -> list[Column]:
    return [(as_double(c) - float(m)) / float(s) for c, m, s in zip(cols, mean, sd)]


def _features(df: DataFrame, cols: Sequence[str], mean, sd) -> DataFrame:
    """Complete rows with a ``features`` vector."""
    names = [f"f__{i}" for i in range(len(cols))]
    data = df.na.drop(subset=list(cols)).withColumns(dict(zip(names, scaled(cols, mean, sd))))
    return VectorAssembler(inputCols=names, outputCol="features").transform(data).drop(*names)


@contextmanager
def _kept(df: DataFrame, cols: Sequence[str], mean, sd) -> Iterator[tuple[DataFrame, DataFrame]]:
    """The scaled columns of complete rows, kept as plain numbers, and the vectors made from them for the time of a fit.

    A kept vector takes some four times the bytes of its numbers, and all of them are read in every pass.
    """
    names, x = [f"f__{i}" for i in range(len(cols))], vector_to_array("features")
    dealt = spread_out(_features(df, cols, mean, sd).select("features"))
    numbers = dealt.select(*[x[i].alias(n) for i, n in enumerate(names)]).persist()
    try:
        yield numbers, VectorAssembler(inputCols=names, outputCol="features").transform(numbers).select("features")
    finally:
        numbers.unpersist()


def _means(k: int, seed: int, variance: float = 1.0) -> KMeans:
    """Blocks of rows are multiplied with all centres at once; row by row, every pass would read the vectors anew."""
    return KMeans(k=k, seed=seed, maxIter=300, tol=stopping_distance(k, variance), initMode="k-means||", solver="block")


@dataclass(frozen=True)
class Centres:
    """Cluster centres; rows are labelled by a plain expression, so no join and no Python is involved."""

    cols: tuple[str, ...]
    mean: np.ndarray
    sd: np.ndarray
    centers: np.ndarray  # on the scaled axes
    cost: float

    def label(self, df: DataFrame, new: str = "cluster") -> DataFrame:
        """Number of the nearest centre; null for incomplete rows."""
        x = scaled(self.cols, self.mean, self.sd)
        options = F.array(*[
            F.struct(reduce(add, [(xi - float(ci)) * (xi - float(ci)) for xi, ci in zip(x, c)]).alias("d"), F.lit(i).alias("i"))
            for i, c in enumerate(self.centers)])
        full = reduce(and_, [F.col(c).isNotNull() for c in self.cols])
        return df.withColumn(new, F.when(full, F.array_min(options)["i"]))

    def table(self, spark) -> DataFrame:
        """Centres in original units."""
        rows = [(i, *[float(v) for v in c * self.sd + self.mean]) for i, c in enumerate(self.centers)]
        return local_table(spark, rows, "cluster int, " + ", ".join(f"`{c}` double" for c in self.cols))


def stopping_distance(k: int, mean_variance: float = 1.0) -> float:
    """Per-centre move below which the summed squared moves fall under 1e-4 of the mean variance."""
    return (1e-4 * mean_variance / k) ** 0.5


def kmeans(df: DataFrame, cols: Sequence[str], k: int, seed: int = 42, scale: bool = True) -> Centres:
    data = to_numbers(df, cols)
    mean, sd = scaling(data, cols, scale)
    variance = 1.0
    if not scale:
        row = data.select(*cols).na.drop().agg(*[F.var_pop(c) for c in cols]).first()
        variance = float(np.mean(list(row))) or 1.0
    with _kept(data, cols, mean, sd) as (_, feats):
        model = _means(k, seed, variance).fit(feats)
        return Centres(tuple(cols), mean, sd, np.array(model.clusterCenters()), float(model.summary.trainingCost))


def divisive(df: DataFrame, cols: Sequence[str], k: int, seed: int = 42, scale: bool = True) -> DataFrame:
    """Hierarchical grouping by repeated bisection.

    A different algorithm from bottom-up linkage, which needs all pairs of rows.
    """
    data = to_numbers(df, cols)
    mean, sd = scaling(data, cols, scale)
    return _fit_and_label(data, cols, mean, sd, BisectingKMeans(k=k, seed=seed))


def gaussian_mixture(df: DataFrame, cols: Sequence[str], k: int, seed: int = 42, scale: bool = True) -> DataFrame:
    """Full-covariance mixture; the label is the most likely component."""
    data = to_numbers(df, cols)
    mean, sd = scaling(data, cols, scale)
    return _fit_and_label(data, cols, mean, sd, GaussianMixture(k=k, seed=seed, maxIter=100))


def _fit_and_label(data: DataFrame, cols, mean, sd, algorithm) -> DataFrame:
    feats = _features(data, cols, mean, sd)
    fit_on = spread_out(feats.select("features")).persist()
    try:
        model = algorithm.fit(fit_on)
    finally:
        fit_on.unpersist()
    done = model.transform(feats).select(*data.columns, F.col("prediction").cast("int").alias("cluster"))
    rest = data.where(~reduce(and_, [F.col(c).isNotNull() for c in cols]))
    return done.unionByName(rest.withColumn("cluster", F.lit(None).cast("int")))


def elbow(df: DataFrame, cols: Sequence[str], k_max: int = 15, seed: int = 42) -> DataFrame:
    """(k, inertia) for k = 1..min(k_max, n - 1); the features are prepared once."""
    data = to_numbers(df, cols)
    mean, sd = scaling(data, cols)
    with _kept(data, cols, mean, sd) as (numbers, feats):
        n = numbers.count()
        one = numbers.agg(*[F.var_pop(c) for c in numbers.columns]).first()
        rows = [(1, float(sum(one) * n))]
        for k in range(2, min(k_max, n - 1) + 1):
            rows.append((k, float(_means(k, seed).fit(feats).summary.trainingCost)))
    return local_table(df.sparkSession, rows, "k int, inertia double")


def silhouette(df: DataFrame, cols: Sequence[str], label: str, max_clusters: int = 500) -> DataFrame:
    """(n, silhouette) with squared Euclidean distance, exact for every row in two passes.

    The mean squared distance from a row to a cluster follows from the cluster's mean
    and mean squared norm, so no pairs are formed. ``silhouette_euclidean`` gives the
    plain-distance value.
    """
    data = df.select(F.col(label).alias("c"), *[as_double(c).alias(c) for c in cols]).na.drop()
    centre = data.agg(*[F.avg(c) for c in cols]).first()
    x = [F.col(c) - float(m) for c, m in zip(cols, centre)]
    norm = reduce(add, [v * v for v in x])
    stats = bounded_rows(data.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.avg(norm).alias("q"),
                                               *[F.avg(v).alias(f"m_{i}") for i, v in enumerate(x)]),
                         max_clusters, "clusters")
    own, other = F.lit(None).cast("double"), []
    size = F.lit(None).cast("bigint")
    for r in stats:
        d = norm + float(r["q"]) - 2 * reduce(add, [v * float(r[f"m_{i}"]) for i, v in enumerate(x)])
        mine = F.col("c") == r["c"]
        own = F.when(mine, d * (r["n"] / (r["n"] - 1.0)) if r["n"] > 1 else F.lit(0.0)).otherwise(own)
        size = F.when(mine, r["n"]).otherwise(size)
        other.append(F.when(~mine, d))
    if len(stats) < 2:
        raise ValueError("silhouette needs at least two clusters")
    b = F.array_min(F.array_compact(F.array(*other)))
    s = F.when(size == 1, 0.0).otherwise(F.coalesce(F.try_divide(b - own, F.greatest(own, b)), F.lit(0.0)))
    return data.agg(F.count(F.lit(1)).alias("n"), F.avg(s).alias("silhouette"))


#: Rows of a block of the plain silhouette at least and at most, and sums that a block holds.
BLOCK_ROWS, BLOCK_SUMS = (4_000, 50_000), 4_000_000
#: Tasks that pairs of blocks are dealt to at most.
PIECES = 2_000
#: Rows from which cells that lie far apart are summed by weights, in so many columns and clusters at most.
FAR_ROWS, FAR_COLUMNS, FAR_LEVELS = 100_000, 2, 64
#: Rows of a cell and of a block of cells, about; sampled rows of a cell, about; weights of all cells at most (8 bytes each).
CELL_ROWS, CELL_BLOCK, SAMPLED, MOST_MOMENTS = 1_000, 30_000, 50, 8_000_000
#: Distances that are formed at once; they stay in a core's cache.
TILE = (64, 1024)


def distance_sums(p: np.ndarray, p_code: np.ndarray, q: np.ndarray, q_code: np.ndarray, levels: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Summed distances of each line of ``p`` to the clusters of ``q``, and of each line of ``q`` to those of ``p``; each distance is formed once.

    Lines come sorted by the number of their cluster.
    """
    to_q, to_p = np.zeros((len(p), levels[1])), np.zeros((len(q), levels[0]))
    p, q = np.ascontiguousarray(p.T), np.ascontiguousarray(q.T)
    (high, wide), d, g = TILE, np.empty(TILE), np.empty(TILE)

    def hot(code: np.ndarray) -> tuple[slice, np.ndarray]:
        return slice(code[0], code[-1] + 1), np.eye(code[-1] + 1 - code[0])[code - code[0]]

    tiles = [(t, *hot(q_code[t:t + wide])) for t in range(0, q.shape[1], wide)]
    for s in range(0, p.shape[1], high):
        own, mine = hot(p_code[s:s + high])
        for t, other, theirs in tiles:
            e, h = d[:len(mine), :len(theirs)], g[:len(mine), :len(theirs)]
            for k in range(len(p)):
                to = h if k else e
                np.subtract(p[k, s:s + high, None], q[k, None, t:t + wide], out=to)
                np.multiply(to, to, out=to)
                if k:
                    np.add(e, h, out=e)
            np.sqrt(e, out=e)
            to_q[s:s + high, other] += e @ theirs
            to_p[t:t + wide, own] += e.T @ mine
    return to_q, to_p


def silhouette_euclidean(df: DataFrame, cols: Sequence[str], label: str, key: str, block: int | None = None) -> DataFrame:
    """(n, silhouette) with plain Euclidean distance, exact.

    The measure itself needs every distance. Rows are cut into blocks of bounded size
    and each pair of blocks, in one order only, returns sums per row and cluster, so memory stays
    bounded while the arithmetic remains quadratic; ``silhouette`` scales linearly. From FAR_ROWS rows
    on, in FAR_COLUMNS columns and FAR_LEVELS clusters at most, cells of rows that lie far apart are summed by
    their weights (``far``), to the rounding of the sums, and only rows of near cells in pairs.
    """
    xs = [f"x{i}" for i in range(len(cols))]
    data = df.select(F.col(key).alias("id"), F.col(label).cast("string").alias("c"),
                     *[as_double(c).alias(x) for c, x in zip(cols, xs)]).na.drop()
    n, some = data.agg(F.count(F.lit(1)), F.approx_count_distinct("c")).first()
    if block is None and n >= FAR_ROWS and len(xs) <= FAR_COLUMNS and some <= FAR_LEVELS:
        hits = {r["c"]: r["count"] for r in data.groupBy("c").count().collect()}
        if len(hits) > 1:
            return _silhouette_by_cells(data, xs, n, dict(sorted(hits.items())))
    if block is None:
        block = max(BLOCK_ROWS[0], min(BLOCK_ROWS[1], n // 16, BLOCK_SUMS // max(some, 1)))
    blocks = max(1, -(-n // block))
    data = data.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    left = data.withColumnRenamed("b", "i").withColumn("j", F.explode(F.sequence("i", F.lit(blocks - 1))))
    right = data.withColumnRenamed("b", "j").withColumn("i", F.explode(F.sequence(F.lit(0), "j")))

    def lines(a: pd.DataFrame, levels: np.ndarray, hits: np.ndarray, total: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"id": np.repeat(a["id"].to_numpy(), len(levels)), "c": np.repeat(a["c"].to_numpy(), len(levels)),
                             "other": np.tile(levels, len(a)), "total": total.ravel(),
                             "cnt": np.tile(hits.astype("int64"), len(a))})

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "c": pd.Series(dtype="object"),
                                 "other": pd.Series(dtype="object"), "total": pd.Series(dtype="float64"),
                                 "cnt": pd.Series(dtype="int64")})
        sides = []
        for side in (a, b):
            side = side.sort_values("c", kind="stable")
            sides.append((side, *np.unique(side["c"].to_numpy(), return_inverse=True, return_counts=True)))
        (a, a_levels, a_code, a_hits), (b, b_levels, b_code, b_hits) = sides
        to_b, to_a = distance_sums(a[xs].to_numpy(float), a_code, b[xs].to_numpy(float), b_code, (len(a_levels), len(b_levels)))
        found = lines(a, b_levels, b_hits, to_b)
        if a["i"].iloc[0] == a["j"].iloc[0]:  # a block with itself: both sides are the same rows
            return found
        return pd.concat([found, lines(b, a_levels, a_hits, to_a)])

    kind = data.schema["id"].dataType.simpleString()
    pieces = min(blocks * (blocks + 1) // 2, PIECES)  # of much work and few bytes: small ones are not to be put together
    left, right = left.repartition(pieces, "i", "j"), right.repartition(pieces, "i", "j")
    parts = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(
        sums, f"id {kind}, c string, other string, total double, cnt bigint")
    per = parts.groupBy("id", "c", "other").agg(F.sum("total").alias("total"), F.sum("cnt").alias("cnt"))
    same = F.col("c") == F.col("other")
    rows = per.groupBy("id").agg(
        F.max(F.when(same, F.try_divide(F.col("total"), F.col("cnt") - 1))).alias("a"),
        F.max(F.when(same, F.col("cnt"))).alias("size"),
        F.min(F.when(~same, F.col("total") / F.col("cnt"))).alias("b"))
    s = F.when(F.col("size") == 1, 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(s).alias("silhouette"))


def _silhouette_by_cells(data: DataFrame, xs: list[str], n: int, hits: dict[str, int]) -> DataFrame:
    """``silhouette_euclidean`` of ``data`` (id, c, *xs), ``n`` rows with the clusters ``hits``: far cells by weights, near ones row by row."""
    spark, levels = data.sparkSession, list(hits)
    code = F.lit(-1)
    for i, level in enumerate(levels):
        code = F.when(F.col("c") == level, i).otherwise(code)
    data = data.select("id", code.alias("c"), F.xxhash64("id", "c", *xs).alias("hash"), *xs)
    moments = sum(p ** len(xs) for _, p in far.ORDERS) * len(levels)
    cells = int(max(1, min(n // CELL_ROWS, MOST_MOMENTS // moments)))
    share = max(1, n // max(1, SAMPLED * cells))
    sample = data.where(F.pmod(F.xxhash64("hash"), F.lit(share)) == 0).select(*xs).toPandas().to_numpy(float).reshape(-1, len(xs))
    tree = far.grown(sample, max(1, len(sample) // cells))
    of_block = max(1, CELL_BLOCK * tree.cells // n)

    def celled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cell = tree.cell_of(f[xs].to_numpy(float), f["hash"].to_numpy(np.int64))
            yield f.drop(columns="hash").assign(cell=cell.astype("int32"), i=(cell // of_block).astype("int32"))

    lead = f"id {data.schema['id'].dataType.simpleString()}, c int, {', '.join(x + ' double' for x in xs)}, cell int"

    def weighed(block: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for cell, f in block.groupby("cell"):
            low, high, weights = far.weights_of(f[xs].to_numpy(float), f["c"].to_numpy(), len(levels))
            rows.append((cell, len(f), low.tobytes(), high.tobytes(), *[w.tobytes() for w in weights]))
        return pd.DataFrame(rows, columns=["cell", "n", "low", "high", *[f"w{k}" for k in range(len(far.ORDERS))]])

    found = data.mapInPandas(celled, lead + ", i int").groupBy("i").applyInPandas(
        weighed, "cell int, n bigint, low binary, high binary" + "".join(f", w{k} binary" for k in range(len(far.ORDERS)))).collect()
    low, high, rows = np.zeros((tree.cells, len(xs))), np.zeros((tree.cells, len(xs))), np.zeros(tree.cells, np.int64)
    found.sort(key=lambda r: r["cell"])
    for r in found:
        low[r["cell"]], high[r["cell"]], rows[r["cell"]] = np.frombuffer(r["low"]), np.frombuffer(r["high"]), r["n"]
    nodes = [np.concatenate([far.nodes_of(low[r["cell"]], high[r["cell"]], p) for r in found]) for _, p in far.ORDERS]
    weights = [np.concatenate([np.frombuffer(r[f"w{k}"]).reshape(-1, len(levels)) for r in found]) for k in range(len(far.ORDERS))]
    known = far.Cells(low, high, rows, nodes, weights)
    # the blocks that each cell is to meet: its own, and those with a near cell
    first = np.arange(0, tree.cells, of_block)
    meets = [np.flatnonzero(np.add.reduceat((known.order_of(a) < 0) & (rows > 0), first) | (first // of_block == a // of_block)) for a in range(tree.cells)]
    plan = spark.sparkContext.broadcast((known, meets))

    def sent(left: bool):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in celled(frames):
                meet = [plan.value[1][a] for a in f["cell"]]
                other = np.concatenate([np.zeros(0, int), *meet])
                f = f.loc[f.index.repeat([len(m) for m in meet])]
                own = f["i"].to_numpy()
                some = other >= own if left else other < own  # a block meets itself from the left only
                yield f.assign(i=np.minimum(own, other).astype("int32"), j=np.maximum(own, other).astype("int32"))[some]
        return data.mapInPandas(run, lead + ", i int, j int")

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        known, sides, out = plan.value[0], [], []
        same = len(a) > 0 and a["i"].iloc[0] == a["j"].iloc[0]
        for f in (a, a if same else b):
            f = f.sort_values(["cell", "c"], kind="stable")
            own, start = np.unique(f["cell"].to_numpy(), return_index=True)
            sides.append((f, f[xs].to_numpy(float), f["c"].to_numpy(), dict(zip(own.tolist(), zip(start.tolist(), np.append(start[1:], len(f)).tolist())))))
        (a, p, p_code, p_cells), (b, q, q_code, q_cells) = sides
        to_p, to_q = np.zeros((len(p), len(levels))), np.zeros((len(q), len(levels)))
        for u, (s, e) in p_cells.items():
            if same:
                to_p[s:e] += known.far_sums(u, p[s:e])
            near = known.order_of(u) < 0
            for v, (t, g) in q_cells.items():
                if not near[v] or same and v < u:
                    continue
                x, y = distance_sums(p[s:e], p_code[s:e], q[t:g], q_code[t:g], (len(levels),) * 2)
                to_p[s:e] += x
                if not (same and u == v):
                    to_q[t:g] += y
        if same:
            to_p += to_q
        for f, total in ((a, to_p),) if same else ((a, to_p), (b, to_q)):
            out.append(pd.DataFrame({"id": f["id"].to_numpy(), "c": f["c"].to_numpy(), "own": np.full(len(f), int(same))} | {f"t{k}": total[:, k] for k in range(len(levels))}))
        return pd.concat(out)

    pairs = {(a // of_block, int(b)) for a, found in enumerate(meets) for b in found if b >= a // of_block}
    left, right = (sent(x).repartition(min(len(pairs), PIECES), "i", "j") for x in (True, False))
    totals = [f"t{k}" for k in range(len(levels))]
    parts = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(
        sums, f"id {data.schema['id'].dataType.simpleString()}, c int, own bigint, " + ", ".join(t + " double" for t in totals))
    per = parts.groupBy("id", "c").agg(F.sum("own").alias("k"), *[F.sum(t).alias(t) for t in totals])
    mine = [F.when(F.col("c") == k, F.try_divide(F.col(t), F.col("k") * hits[level] - 1)) for k, (t, level) in enumerate(zip(totals, levels))]
    size = [F.when(F.col("c") == k, F.col("k") * hits[level]) for k, level in enumerate(levels)]
    others = [F.when(F.col("c") != k, F.col(t) / (F.col("k") * hits[level])) for k, (t, level) in enumerate(zip(totals, levels))]
    rows = per.groupBy("id").agg(F.max(F.coalesce(*mine)).alias("a"), F.max(F.coalesce(*size)).alias("size"), F.min(F.least(*others)).alias("b"))
    s = F.when(F.col("size") == 1, 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(s).alias("silhouette"))


def profiles(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Means per cluster in original units."""
    return group_means(df.na.drop(subset=[label]), cols, [label])


def projection(df: DataFrame, cols: Sequence[str], label: str, base: str = "pc") -> DataFrame:
    """Two component scores beside the cluster label, complete rows only."""
    scored, _ = components(df, cols, 2, base)
    return scored.na.drop(subset=list(cols)).select(*[f"{base}_comp{i}" for i in (1, 2)], label)
