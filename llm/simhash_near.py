"""SimHash near-dedup: fingerprints of word shingles, joined where blocks agree, verified by Hamming distance.

A fingerprint of 64 bits is cut into five blocks. Two that differ in three bits at most agree in two whole blocks at least, so with
one table per pair of blocks every such pair meets under one key of 25 or 26 bits. Equal fingerprints are one class before the
join, whatever the number of their rows. A task holds many keys; a key with more classes than ``KEY_CLASSES`` is dealt in blocks,
and every pair of its blocks is a piece of work of its own. Inside a key only links that join its classes are written down, not
all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import words
from llm.graph import groups_of, local_labels
from llm.line_dedup import simhash
from llm.session import ready, stored
from llm.similar import pairs_of_runs
from tabstat.plans.order_stats import attach_by_value

#: Differing bits up to which fingerprints are linked.
DISTANCE = 3
BLOCKS = 5
#: Fixed value: the seed of the shingle hash.
SEED = 42
#: Classes of one key that are compared at once.
KEY_CLASSES = 4096
#: Entries of a task, about (a task of one large key has up to two blocks of it).
TASK_ENTRIES = 1 << 15
#: Runs of a key up to this length are compared pair by pair in one array.
SHORT_RUN = 64
#: Large keys up to this number are sent to every task.
BROADCAST_KEYS = 200_000

_U = np.uint64
_EDGES = np.linspace(0, 64, BLOCKS + 1).astype(int)
#: One mask per set of BLOCKS - DISTANCE blocks that a pair within the distance may agree on.
MASKS = [sum((1 << int(_EDGES[b + 1])) - (1 << int(_EDGES[b])) for b in kept) for kept in combinations(range(BLOCKS), BLOCKS - DISTANCE)]


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words one after the other with one space behind each, and where each begins (one more entry than words)."""
    size = ends - starts
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(int(begin[-1]), 0x20, np.uint8)
    step = np.arange(int(size.sum())) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(size) else np.zeros(0, np.int64)
    out[np.repeat(begin[:-1], size) + step] = data[np.repeat(starts, size) + step]
    return out, begin


def text_fingerprints(data: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
    """The SimHash of the lower-cased shingles of each text, repeats included; a text with fewer words is one shingle, one without words is zero."""
    data = words.lowered(data)
    starts, ends, first = words.find_words(data, bounds)
    joined, begin = joined_words(data, starts, ends)
    start, owner = words.whole_windows(first, width)
    counts = np.diff(first)
    few = np.flatnonzero((counts > 0) & (counts < width))
    low, high = np.concatenate([start, first[few]]), np.concatenate([start + width, first[few + 1]])
    owner = np.concatenate([owner, few])
    order = np.argsort(owner, kind="stable")
    low, high, owner = begin[low[order]], begin[high[order]] - 1, owner[order]
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[s:e], SEED) for s, e in zip(low.tolist(), high.tolist())), _U, len(low))
    return simhash(hashes, np.searchsorted(owner, np.arange(len(bounds))))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, fingerprint) of every row; the 64 bits as a signed long."""
    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, bounds in words.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, end - at), pa.array(text_fingerprints(data, bounds, width).view(np.int64))], ["key", "fingerprint"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(marked, f"key {docs.schema[key].dataType.simpleString()}, fingerprint long")


def linked_run(prints: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``distance`` that connect all fingerprints that are linked through others.

    What is found leaves the rest, so a group of near copies costs about one look per member.
    """
    rest, left, right = np.arange(len(prints)), [], []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(prints[rest] ^ prints[at]) <= distance
            found, rest = rest[near], rest[~near]
            left.append(np.full(len(found), at))
            right.append(found)
            queue.extend(found.tolist())
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def links(classes: DataFrame, total: int) -> DataFrame:
    """(a, b): edges that connect all of ``total`` distinct fingerprints within the distance, by way of true links only."""
    def signed(mask: int) -> int:
        return mask - (1 << 64) if mask >> 63 else mask

    keys = F.array(*[F.col("fingerprint").bitwiseAND(F.lit(signed(m)).cast("long")) for m in MASKS])
    entries = classes.select("fingerprint", F.posexplode(keys).alias("t", "key"))
    large = stored(entries.groupBy("t", "key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > KEY_CLASSES)
                   .withColumn("blocks", F.ceil(F.col("size") / KEY_CLASSES).cast("int")))
    if large.count() <= BROADCAST_KEYS:
        entries = entries.join(F.broadcast(large), ["t", "key"], "left")
    else:
        entries = attach_by_value(entries, large, "key", "size", ["t"], spread="fingerprint", total=len(MASKS) * total)
    tasks = max(1, -(-len(MASKS) * total // TASK_ENTRIES))
    cold = entries.where("blocks IS NULL").select("fingerprint", "t", "key", F.pmod(F.xxhash64("t", "key"), F.lit(tasks)).alias("task"))
    own = F.pmod(F.xxhash64("fingerprint", F.lit(7)), F.col("blocks")).cast("int")
    hot = entries.where("blocks IS NOT NULL").withColumn("own", own) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> own") \
        .select("fingerprint", "t", "key", (F.lit(tasks) + F.shiftrightunsigned(F.xxhash64("t", "key", F.least("own", "other"), F.greatest("own", "other")), 2)).alias("task"))

    def compared(table: pa.Table) -> pa.Table:
        prints, t, key, task = (table[c].to_numpy() for c in ("fingerprint", "t", "key", "task"))
        order = np.lexsort((prints, key, t, task))
        prints, t, key, task = prints[order].view(_U), t[order], key[order], task[order]
        start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (t[1:] != t[:-1]) | (task[1:] != task[:-1])]))
        size = np.diff(np.append(start, len(prints)))
        i, j = pairs_of_runs(start[(size > 1) & (size <= SHORT_RUN)], size[(size > 1) & (size <= SHORT_RUN)])
        near = np.bitwise_count(prints[i] ^ prints[j]) <= DISTANCE
        left, right = [i[near]], [j[near]]
        for s, n in zip(start[size > SHORT_RUN], size[size > SHORT_RUN]):
            a, b = linked_run(prints[s:s + n])
            left.append(a + s)
            right.append(b + s)
        nodes, node = np.unique(prints.view(np.int64), return_inverse=True)
        label = local_labels(len(nodes), node[np.concatenate(left)], node[np.concatenate(right)])
        rest = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.table({"a": nodes[label[rest]], "b": nodes[rest]})

    return cold.unionByName(hot).groupBy("task").applyInArrow(compared, "a long, b long").distinct()


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, fingerprint, component_id): groups of texts whose fingerprints are linked by steps of ``DISTANCE`` bits at most.

    The fingerprint comes as 16 hex digits. Null, empty and blank texts have fingerprint zero and are linked like any other. ``component_id``
    is the smallest key reachable, the row's own included. Rows without a key link others but are no component's name; a component
    of such rows only has a null one. Repeated rows share their result. An empty table gives an empty result. Other columns
    are not used.
    """
    ready(docs.sparkSession)
    prints = stored(fingerprints(docs, key, text, width))
    classes = stored(prints.groupBy("fingerprint").agg(F.min("key").alias("low"), F.count(F.lit(1)).alias("rows")))
    total, rows = classes.agg(F.count(F.lit(1)), F.sum("rows")).first()
    groups = groups_of(stored(links(classes, total))).withColumnRenamed("id", "fingerprint")
    named = stored(classes.join(groups, "fingerprint", "left").withColumn("group", F.coalesce("label", "fingerprint")).drop("label"))
    lowest = named.groupBy("group").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("members"))
    of_class = attach_by_value(named, lowest, "group", "members", [], spread="fingerprint", total=total).select("fingerprint", "component_id", "rows")
    out = attach_by_value(prints, stored(of_class), "fingerprint", "rows", [], spread="key", total=rows or 0)
    return out.select(F.col("key").alias(key), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
