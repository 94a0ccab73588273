"""Connected components of a large undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstat.plans.order_stats import attach_by_value
from tabstat.session import need_checkpoint_dir


def _with_minimum(edges: DataFrame, total: int) -> DataFrame:
    """Edges (u, v) with the smallest neighbour (or itself) of u; hubs are joined by broadcast."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("deg"))
    low = low.withColumn("m", F.least("m", "u"))
    return attach_by_value(edges, low, "u", "deg", [], spread="v", total=total)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, component): the smallest node of every component, for nodes that have an edge.

    Alternates two star operations on the edge list until it stops changing, which takes
    a number of rounds logarithmic in the graph size. Each round is written to the
    checkpoint folder, so a lost executor costs one round at most.
    """
    need_checkpoint_dir(edges.sparkSession)
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    state, size = None, e.count()
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_minimum(both, 2 * size).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = _with_minimum(large, size)
        small = down.select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = small.checkpoint()
        new = tuple(e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())
        if new == state:
            break
        state, size = new, new[0]
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    roots = e.select(F.col("v").alias("u"), F.col("v").alias("component")).distinct()
    return e.select("u", F.col("v").alias("component")).unionByName(roots)
