"""Mixing sources to target weights by subset-sum budget fitting.

Sizes are counted exactly. Every source gets a target. Whole passes over the source come first; the rest of the target
is a subset of its documents, found on the histogram of document sizes: the same share of every size,
then a bounded-knapsack dynamic programme for the words that are still missing. Which documents of a size are taken follows
from a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from llm.session import ready, stored

#: Words that the dynamic programme fits at most, and distinct sizes it uses at most.
FIT_WORDS = 1 << 16
FIT_SIZES = 512
#: Documents of one source and size that one task orders, about.
GROUP_ROWS = 10_000
#: Size histograms up to this number of rows are sent to every task.
BROADCAST_ROWS = 200_000


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """The words of each source: ``share`` of all by weight, at most ``most`` times its size; the excess is shared anew by weight."""
    fixed: dict[int, float] = {}
    while True:
        rest = share * sum(sizes) - sum(fixed.values())
        total = sum(w for i, w in enumerate(weights) if i not in fixed)
        wanted = {i: rest * w / total for i, w in enumerate(weights) if i not in fixed}
        over = {i: most * sizes[i] for i, x in wanted.items() if x > most * sizes[i]}
        if not over:
            return [fixed.get(i, wanted.get(i, 0.0)) for i in range(len(sizes))]
        fixed |= over


def fit(sizes: np.ndarray, counts: np.ndarray, goal: int) -> np.ndarray:
    """How many documents of each size to take: their words come as near to ``goal`` as the programme reaches, or one document above if that is nearer."""
    total = int((sizes * counts).sum())
    if goal >= total:
        return counts.copy()
    exact = [int(n) * goal for n in counts]
    taken = np.array([x // total for x in exact], np.int64)
    rest = goal - int((taken * sizes).sum())
    for i in np.argsort([-(x % total) / total for x in exact], kind="stable"):  # largest remainders first
        if taken[i] < counts[i] and sizes[i] <= rest - FIT_WORDS // 2:
            taken[i] += 1
            rest -= int(sizes[i])
    for i in np.argsort(-sizes, kind="stable"):
        more = min(int(counts[i] - taken[i]), max(0, rest - FIT_WORDS // 2) // int(sizes[i]))
        taken[i] += more
        rest -= more * int(sizes[i])
    left = [(int(s), int(min(c, rest // s)), i) for i, (s, c) in enumerate(zip(sizes, counts - taken)) if s <= rest and c > 0]
    left = sorted(left)[:FIT_SIZES]
    mask, reach, before = (1 << rest + 1) - 1, 1, []
    for size, count, _ in left:  # bit w is set if w words can be reached; counts go in powers of two
        before.append(reach)
        step = 1
        while count > 0:
            step = min(step, count)
            reach |= reach << step * size & mask
            count -= step
            step *= 2
    at = reach.bit_length() - 1
    for (size, count, i), earlier in zip(reversed(left), reversed(before)):
        n = next(n for n in range(count + 1) if at >= n * size and earlier >> at - n * size & 1)
        taken[i] += n
        at -= n * size
    rest = goal - int((taken * sizes).sum())
    above = [(int(s), i) for i, (s, c) in enumerate(zip(sizes, counts - taken)) if c > 0 and rest < s < 2 * rest]
    if above:  # one document more comes nearer than none
        taken[min(above)[1]] += 1
    return taken


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = (3, 1, 2),
        share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """(key, size, source_size, target, taken): how many words of each document the mix takes, repeats counted.

    A size is the number of words (null text: 0). Sources in code point order, null last, weigh ``weights`` in turn. A
    document is taken a whole number of times, ``most`` times at most; documents without words are taken 0
    words. Null keys are kept; rows with equal key and text are interchangeable. Reruns agree. An empty table gives an
    empty result. Other columns are not used.
    """
    spark = ready(docs.sparkSession)
    sized = docs.select(
        F.col(key).alias("key"), F.col(source).alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(key), F.xxhash64(text)).alias("draw"))
    sized = stored(sized)
    totals = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()  # a line per source
    totals.sort(key=lambda r: (r.source is None, r.source if r.source is not None else ""))
    wanted = targets([r["size"] for r in totals], [float(weights[i % len(weights)]) for i in range(len(totals))], share, most)
    schema = T.StructType([T.StructField("sid", T.LongType()), T.StructField("source", docs.schema[source].dataType),
                           T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    named = spark.createDataFrame([Row(i, r.source, r["size"], float(t)) for i, (r, t) in enumerate(zip(totals, wanted))], schema)
    sized = sized.join(F.broadcast(named), sized["source"].eqNullSafe(named["source"])).select("sid", "key", "size", "draw", "source_size", "target")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        total, goal = int(pdf["source_size"].iloc[0]), int(round(pdf["target"].iloc[0]))
        whole, rest = divmod(min(goal, int(most * total)), total)
        pdf = pdf.sort_values("size")
        return pdf[["sid", "size", "n"]].assign(whole=whole, extra=fit(pdf["size"].to_numpy(), pdf["n"].to_numpy(), rest))

    histogram = sized.where("size > 0").groupBy("sid", "size", "source_size", "target").agg(F.count(F.lit(1)).alias("n"))
    chosen = stored(histogram.groupBy("sid").applyInPandas(plan, "sid long, size long, n long, whole long, extra long"))
    small = chosen.count() <= BROADCAST_ROWS
    here = F.broadcast(chosen) if small else chosen
    # a size that many documents share is ordered in groups of bounded rows
    rows = sized.join(here, ["sid", "size"], "left")\
        .withColumn("part", F.coalesce(F.pmod(F.xxhash64("draw"), F.ceil(F.col("n") / GROUP_ROWS)), "draw"))
    ordered = Window.partitionBy("sid", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.where("extra > 0").groupBy("sid", "size", "part", "extra").agg(F.count(F.lit(1)).alias("in_part")) \
        .withColumn("before", F.coalesce(F.sum("in_part").over(ordered), F.lit(0))) \
        .select("sid", "size", "part", (F.col("extra") - F.col("before")).alias("quota")).where("quota > 0")
    drawn = Window.partitionBy("sid", "size", "part").orderBy("draw", "key")
    rows = rows.withColumn("rank", F.row_number().over(drawn)).join(parts, ["sid", "size", "part"], "left")
    times = F.coalesce("whole", F.lit(0)) + F.when(F.col("rank") <= F.col("quota"), 1).otherwise(0)
    return rows.select(F.col("key").alias(key), "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"))
