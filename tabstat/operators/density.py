"""Density clustering on a grid, without forming all pairs.

The cell side is eps / sqrt(d), so rows of one cell are neighbours of each other: a cell
with ``min_samples`` rows is core as a whole whatever its size. Only rows of thinner
cells (fewer than ``min_samples`` each) are compared with the rows of nearby cells, so
each row meets a bounded number of them. Clusters are components of cells, not of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import product
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabstat.plans.graph import connected_components
from tabstat.plans.order_stats import attach_by_value
from tabstat.plans.stats import as_double

NOISE = -1  # label of rows in no cluster, fixed value


def _boxes(points: DataFrame, by: Sequence[str], d: int) -> DataFrame:
    return points.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min(f"x{i}").alias(f"lo{i}") for i in range(d)], *[F.max(f"x{i}").alias(f"hi{i}") for i in range(d)])


def _gap2(a: str, b: str, d: int) -> Column:
    """Squared distance between two boxes."""
    def side(i):
        return F.greatest(F.col(f"{a}lo{i}") - F.col(f"{b}hi{i}"), F.col(f"{b}lo{i}") - F.col(f"{a}hi{i}"), F.lit(0.0))
    return reduce(add, [side(i) * side(i) for i in range(d)])


def _span2(a: str, b: str, d: int) -> Column:
    """Largest squared distance between rows of two boxes."""
    def side(i):
        return F.greatest(F.abs(F.col(f"{a}hi{i}") - F.col(f"{b}lo{i}")), F.abs(F.col(f"{b}hi{i}") - F.col(f"{a}lo{i}")))
    return reduce(add, [side(i) * side(i) for i in range(d)])


def _near_boxes(left: DataFrame, right: DataFrame, d: int, eps: float, reach: int) -> DataFrame:
    """(a, b and both boxes): pairs of different cells whose boxes come within eps.

    An equi-join on the first grid coordinates, shifted by every offset in reach.
    """
    g = min(d, 3)
    shifts = F.array(*[F.struct(*[F.lit(o).alias(f"o{i}") for i, o in enumerate(s)])
                       for s in product(range(-reach, reach + 1), repeat=g)])
    a = left.select(*[F.col(c).alias("a_" + c) for c in left.columns], F.explode(shifts).alias("o"))
    a = a.withColumns({f"j{i}": F.col(f"a_g{i}") + F.col(f"o.o{i}") for i in range(g)}).drop("o")
    b = right.select(*[F.col(c).alias("b_" + c) for c in right.columns])
    b = b.withColumns({f"j{i}": F.col(f"b_g{i}") for i in range(g)})
    out = a.join(b, [f"j{i}" for i in range(g)]).where(F.col("a_cell") != F.col("b_cell"))
    return out.where(_gap2("a_", "b_", d) <= eps * eps)


def _probe(points: DataFrame, cells: DataFrame, targets: DataFrame, d: int, eps: float, reach: int, keep: Sequence[str],
           total: int) -> DataFrame:
    """(id, keep...): one row per (target, point) within eps, the point's own cell included.

    ``targets`` come from thin cells only. They are packed per cell that has to look at
    them, and that bounded array is attached to the rows of the cell.
    """
    packed = targets.groupBy("cell").agg(F.collect_list(F.struct("id", *[f"x{i}" for i in range(d)])).alias("pts"))
    thin = _boxes(targets, ["cell", *[f"g{i}" for i in range(d)]], d)
    around = _near_boxes(cells, thin, d, eps, reach).select(F.col("a_cell").alias("cell"), F.col("b_cell").alias("other"))
    around = around.unionByName(thin.select("cell", F.col("cell").alias("other")))
    lists = around.join(packed.withColumnRenamed("cell", "other"), "other").groupBy("cell").agg(
        F.flatten(F.collect_list("pts")).alias("pts"))
    lists = lists.join(cells.select("cell", "n"), "cell")
    rows = attach_by_value(points, lists, "cell", "n", [], spread="id", total=total).where(F.col("pts").isNotNull())
    pairs = rows.select(*keep, *[F.col(f"x{i}").alias(f"p{i}") for i in range(d)], F.explode("pts").alias("t"))
    dist2 = reduce(add, [(F.col(f"p{i}") - F.col(f"t.x{i}")) * (F.col(f"p{i}") - F.col(f"t.x{i}")) for i in range(d)])
    return pairs.where(dist2 <= eps * eps).select(F.col("t.id").alias("id"), *keep)


def grid_points(df: DataFrame, cols: Sequence[str], key: str, eps: float) -> DataFrame:
    """Complete rows as (id, x0.., g0.., cell)."""
    d = len(cols)
    side = eps / math.sqrt(d)
    pts = df.select(F.col(key).alias("id"), *[as_double(c).alias(f"x{i}") for i, c in enumerate(cols)]).na.drop()
    pts = pts.withColumns({f"g{i}": F.floor(F.col(f"x{i}") / side).cast("bigint") for i in range(d)})
    return pts.withColumn("cell", F.concat_ws(",", *[F.col(f"g{i}").cast("string") for i in range(d)]))


def core_rows(points: DataFrame, d: int, eps: float, min_samples: int) -> DataFrame:
    """``points`` with ``n`` (rows in the cell) and ``core``."""
    reach = math.ceil(math.sqrt(d))
    cells = _boxes(points, ["cell", *[f"g{i}" for i in range(d)]], d)
    total = points.count()
    sized = attach_by_value(points, cells.select("cell", "n"), "cell", "n", [], spread="id", total=total)
    thin = sized.where(F.col("n") < min_samples).drop("n")
    counts = _probe(points, cells, thin, d, eps, reach, [], total).groupBy("id").agg(F.count(F.lit(1)).alias("around"))
    return sized.join(counts, "id", "left").withColumn(
        "core", (F.col("n") >= min_samples) | (F.coalesce(F.col("around"), F.lit(0)) >= min_samples)).drop("around")


def core_flags(df: DataFrame, cols: Sequence[str], key: str, eps: float, min_samples: int) -> DataFrame:
    """(key, core): rows with at least ``min_samples`` rows, themselves included, within eps."""
    pts = core_rows(grid_points(df, cols, key, eps), len(cols), eps, min_samples)
    return pts.select(F.col("id").alias(key), "core")


def _links(core: DataFrame, d: int, eps: float, reach: int, fine: int = 8) -> DataFrame:
    """(u, v): cells holding core rows within eps of each other.

    Boxes settle most pairs. Open pairs are compared again through sub-cells with tight
    boxes, and only rows of still open sub-cell pairs that reach the other box are compared.
    """
    e2 = eps * eps
    side = eps / math.sqrt(d)
    cells = _boxes(core, ["cell", *[f"g{i}" for i in range(d)]], d)
    near = _near_boxes(cells, cells, d, eps, reach).where(F.col("a_cell") < F.col("b_cell")) \
        .withColumn("sure", _span2("a_", "b_", d) <= e2)
    sure = near.where("sure").select(F.col("a_cell").alias("u"), F.col("b_cell").alias("v"))
    unsure = near.where("NOT sure").select(F.col("a_cell").alias("u"), F.col("b_cell").alias("v"))
    part = F.concat_ws(",", *[F.floor(F.col(f"x{i}") / (side / fine)).cast("string") for i in range(d)])
    core = core.withColumn("sub", part)
    subs = _boxes(core, ["cell", "sub"], d).drop("n")
    a = subs.select(F.col("cell").alias("u"), *[F.col(c).alias("a_" + c) for c in subs.columns if c != "cell"])
    b = subs.select(F.col("cell").alias("v"), *[F.col(c).alias("b_" + c) for c in subs.columns if c != "cell"])
    pairs = unsure.join(a, "u").join(b, "v").where(_gap2("a_", "b_", d) <= e2) \
        .withColumn("sure", _span2("a_", "b_", d) <= e2)
    done = pairs.where("sure").select("u", "v").distinct()
    left = pairs.where("NOT sure").drop("sure").join(done, ["u", "v"], "left_anti")
    p = core.select(F.col("cell").alias("u"), F.col("sub").alias("a_sub"), *[F.col(f"x{i}").alias(f"p{i}") for i in range(d)]).distinct()
    q = core.select(F.col("cell").alias("v"), F.col("sub").alias("b_sub"), *[F.col(f"x{i}").alias(f"q{i}") for i in range(d)]).distinct()
    dist2 = reduce(add, [(F.col(f"p{i}") - F.col(f"q{i}")) * (F.col(f"p{i}") - F.col(f"q{i}")) for i in range(d)])

    def reaches(row: str, box: str) -> Column:
        """The row is within eps of the other box; the others cannot take part in a link."""
        out = [F.greatest(F.col(f"{box}lo{i}") - F.col(f"{row}{i}"), F.col(f"{row}{i}") - F.col(f"{box}hi{i}"), F.lit(0.0)) for i in range(d)]
        return reduce(add, [x * x for x in out]) <= e2

    close = left.join(p, ["u", "a_sub"]).where(reaches("p", "b_")).join(q, ["v", "b_sub"]).where(reaches("q", "a_")) \
        .where(dist2 <= e2).select("u", "v").distinct()
    return sure.unionByName(done).unionByName(close)


def density_clusters(df: DataFrame, cols: Sequence[str], key: str, eps: float, min_samples: int) -> DataFrame:
    """(key, core, cluster) for complete rows.

    ``cluster`` is the smallest key among the cluster's core rows, -1 for noise. A row
    that is not core joins the lowest of the clusters it touches.
    """
    d = len(cols)
    reach = math.ceil(math.sqrt(d))
    pts = core_rows(grid_points(df, cols, key, eps), d, eps, min_samples).checkpoint()
    core, total = pts.where("core").drop("n"), pts.count()
    comp = connected_components(_links(core, d, eps, reach))
    cells = core.groupBy("cell").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    cells = cells.join(comp.withColumnRenamed("u", "cell"), "cell", "left") \
                 .withColumn("component", F.coalesce("component", "cell"))
    names = cells.groupBy("component").agg(F.min("first").alias("cluster"))
    cells = cells.join(names, "component").select("cell", "n", "cluster").checkpoint()
    named = attach_by_value(core, cells, "cell", "n", [], spread="id", total=total).drop("n")
    edge = pts.where("NOT core").drop("n", "core")
    boxes = _boxes(core, ["cell", *[f"g{i}" for i in range(d)]], d)
    touched = _probe(named, boxes, edge, d, eps, reach, ["cluster"], total).groupBy("id").agg(F.min("cluster").alias("cluster"))
    border = edge.select("id", F.lit(False).alias("core")).join(touched, "id", "left")
    out = named.select("id", F.lit(True).alias("core"), "cluster").unionByName(border)
    return out.select(F.col("id").alias(key), "core", F.coalesce("cluster", F.lit(NOISE)).alias("cluster"))
