"""Similarity joins without all pairs: meet in key buckets, then confirm inside candidate families.

1. ``meet``: every item goes to buckets by its keys. Two items that share a key become candidates: pairs
   in short runs of a key, a star to one member in long runs. Rows grow with the items, not with the square
   of a run.
2. Candidates are joined to families (connected groups of candidates).
3. ``confirm``: the payload of each member is sent to its family once and all links of the family are
   decided there exactly. A family too large for a task is cut into blocks; every pair of blocks is a task.
   Only labels leave a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.graph import groups_of, local_labels
from llm.session import stored

#: Entries of one bucket of keys, about.
BUCKET_ENTRIES = 1 << 19
#: A run of a key with more members is joined by a star instead of by pairs.
LONG_RUN = 48


def bucket_bits(entries: int, per_bucket: int = BUCKET_ENTRIES, least: int = 4) -> int:
    """The number of leading hash bits that name a bucket, so that buckets keep their size as data grow."""
    return max(least, int(np.ceil(np.log2(max(1, entries / per_bucket)))))


#: In an id: the member stands for a long run of its key that a sender has joined by a star.
STANDS = np.uint64(1 << 63)
#: Bucket of the stars that senders make.
STARS = -1


def thinned(keys: np.ndarray, ids: np.ndarray, long_run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys and ids in which one member stands for each run longer than ``long_run``; the stars (hub, spoke) of those runs.

    So a key that a large part of all items share is sent a bounded number of times by each task.
    """
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order].astype(np.uint64)
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(keys)))
    long = np.repeat(size > long_run, size)
    first = np.zeros(len(keys), bool)
    first[start] = True
    hubs = np.repeat(ids[start], size)
    spokes = long & ~first
    stars = hubs[spokes], ids[spokes]
    sent = np.where(long, ids | STANDS, ids)
    return keys[~spokes], sent[~spokes], *stars


def by_bucket(keys: np.ndarray, ids: np.ndarray, bits: int, long_run: int = LONG_RUN) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed keys and ids) for the buckets that the leading bits of the keys name, and stars of long runs."""
    keys, ids, hubs, spokes = thinned(keys, ids, long_run)
    cuts = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    for k in np.flatnonzero(np.diff(cuts)):
        part = slice(cuts[k], cuts[k + 1])
        yield int(k), np.concatenate([keys[part], ids[part]]).tobytes()
    if len(hubs):
        hubs, spokes = distinct_pairs(hubs, spokes)
        yield STARS, np.concatenate([hubs, spokes]).tobytes()


def unpacked(parts: list[bytes], columns: int = 2) -> tuple[np.ndarray, ...]:
    arrays = [np.frombuffer(p, np.uint64).reshape(columns, -1) for p in parts]
    return tuple(np.concatenate(arrays, axis=1) if arrays else np.zeros((columns, 0), np.uint64))


def pairs_of_runs(cuts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of all members of the runs that start at ``cuts``."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for g in np.unique(sizes):
        at = cuts[sizes == g]
        i, j = np.triu_indices(int(g), 1)
        left.append((at[:, None] + i).ravel())
        right.append((at[:, None] + j).ravel())
    return np.concatenate(left), np.concatenate(right)


def distinct_pairs(a: np.ndarray, b: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each pair once; ``more`` are columns whose first value in their own order is kept."""
    order = np.lexsort((*more[::-1], b, a))
    a, b = a[order], b[order]
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[keep], b[keep], *(m[order][keep] for m in more)


def meet(entries: DataFrame, long_run: int = LONG_RUN) -> DataFrame:
    """(a, b, star): candidates among entries (bucket, part) that share a key; a < b.

    A pair whose members meet in a long run of the same bucket is left to that run's star.
    """
    def met(name: tuple, table: pa.Table) -> pa.Table:
        keys, ids = unpacked(table["part"].to_pylist())
        if name[0].as_py() == STARS:
            return pa.table({"a": keys.astype(np.int64), "b": ids.astype(np.int64), "star": np.ones(len(keys), bool)})
        stands = ids >= STANDS
        keys, ids, plain = distinct_pairs(keys, ids & ~STANDS, ~stands)
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(keys)))
        nodes, node = np.unique(ids, return_inverse=True)
        long = (size > long_run) | np.logical_or.reduceat(~plain, start) if len(start) else size > long_run
        hub = np.repeat(start[long], size[long] - 1)
        spoke = np.concatenate([np.arange(s + 1, s + n) for s, n in zip(start[long], size[long])]) if long.any() else hub
        label = local_labels(len(nodes), node[hub], node[spoke])
        short = (size > 1) & ~long
        i, j = pairs_of_runs(start[short], size[short])
        apart = label[node[i]] != label[node[j]]
        a = np.concatenate([ids[hub], ids[i[apart]]]).astype(np.int64)
        b = np.concatenate([ids[spoke], ids[j[apart]]]).astype(np.int64)
        star = np.concatenate([np.zeros(len(hub), np.int8), np.ones(int(apart.sum()), np.int8)])
        a, b, star = distinct_pairs(np.minimum(a, b), np.maximum(a, b), star)
        return pa.table({"a": a, "b": b, "star": star == 0})

    # a sender's stars go to tasks of their own
    spread = F.when(F.col("bucket") == STARS, F.xxhash64("part")).otherwise(F.lit(0))
    found = entries.withColumn("spread", spread).groupBy("bucket", "spread").applyInArrow(met, "a long, b long, star boolean")
    return found.groupBy("a", "b").agg(F.max("star").alias("star"))


def confirm(weights: DataFrame, members: DataFrame, payload: list[str], links: Callable[..., tuple[np.ndarray, np.ndarray]], limit: int, across: bool = False,
            several: bool = False) -> DataFrame:
    """(id, label): groups of the members that ``links`` connects.

    ``weights`` has family and weight of each member, ``members`` id, family and the payload columns.
    ``links(table)`` takes rows of one family and returns index pairs that connect all linked rows (a spanning
    set is enough). ``limit`` bounds the weight of the rows that a task compares at once. With ``across``, ``links(table, cut)`` compares
    the rows before ``cut`` with the others only: two blocks of a family meet without looking inside either again. ``members`` is a
    written table then, as two plans read it. With ``several``, a member may be in more than one family, and groups that share a member are one.
    """
    size = weights.groupBy("family").agg(F.sum("weight").alias("total"))
    size = stored(size.withColumn("blocks", F.ceil(F.col("total") / limit).cast("long")))
    whole, large = size.agg(F.sum(F.when(F.col("blocks") == 1, F.col("total"))), F.max("blocks")).first()
    tasks = max(1, int(np.ceil((whole or 0) / limit)))

    def labelled(table: pa.Table) -> pa.Table:
        family = np.column_stack([table[c].to_numpy() for c in ("family", "i", "j", "own")])
        order = np.lexsort(family.T[::-1])
        family, table = family[order], table.take(pa.array(order))
        cut = np.flatnonzero(np.concatenate([[True], (family[1:, :3] != family[:-1, :3]).any(1), [True]]))
        ids, out_id, out_label = table["id"].to_numpy(), [], []
        for s, e in zip(cut[:-1], cut[1:]):
            part, (_, i, j, _) = table.slice(s, e - s).select(["id", *payload]), family[s]
            a, b = links(part, int(np.searchsorted(family[s:e, 3], j))) if across and i != j else links(part)
            label = local_labels(e - s, a, b)
            own = ids[s:e]
            low = np.full(e - s, np.iinfo(np.int64).max)
            np.minimum.at(low, label, own)
            out_id.append(own)
            out_label.append(low[label])
        return pa.table({"id": np.concatenate(out_id).astype(np.int64), "label": np.concatenate(out_label).astype(np.int64)})

    if (large or 1) > 1 and not across:
        members = stored(members)
    with_size = members.join(size.select("family", "blocks"), "family")
    columns = ["id", "family", *payload]
    small = with_size.where("blocks = 1").select(*columns, F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("own"), F.pmod(F.xxhash64("family"), F.lit(tasks)).alias("task"))
    done = small.groupBy("task").applyInArrow(labelled, "id long, label long")
    def joined(edges: DataFrame) -> DataFrame:
        return groups_of(stored(edges.where("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b")).distinct()))

    if (large or 1) == 1:
        return joined(done) if several else done.distinct()
    block = F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks"))
    tiles = with_size.where("blocks > 1").withColumn("own", block) \
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where(F.lit(across) | (F.col("other") != F.col("own"))) \
        .select(*columns, F.least("own", "other").cast("int").alias("i"), F.greatest("own", "other").cast("int").alias("j"), F.col("own").cast("int").alias("own")) \
        .withColumn("task", F.xxhash64("family", "i", "j"))
    edges = tiles.groupBy("task").applyInArrow(labelled, "id long, label long")
    return joined(done.unionByName(edges)) if several else done.unionByName(joined(edges)).distinct()
