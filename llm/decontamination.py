"""Benchmark decontamination: MinHash containment search in size partitions, verified on exact shingles.

A document contains an item if it holds ``percent`` / 100 of the item's distinct word shingles. Such a document misses
at most n - ceil(percent n / 100) of an item's n shingles, so it holds one at least of the item's
n - ceil(percent n / 100) + 1 smallest shingle hashes. Items are partitioned by size (powers of two). Each partition
knows the largest of those hashes, and a document's sketch for the partition is all of its hashes up to that bound, so
short items are found inside documents of any length, and no pair is lost. Documents smaller than a partition's items
allow are passed over. Candidates are counted on all shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm import words
from llm.session import ready, stored

#: Item shingles up to this number are sent to every task; more are joined by a shuffle.
BROADCAST_SHINGLES = 2_000_000

_U = np.uint64


def _shingles(column: pa.Array, width: int, short: list[int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, distinct values, their text, shingles per text) of ``width`` words, and of the ``short`` widths."""
    for at, end, data, bounds in words.slices(column):
        low = words.lowered(data)
        starts, ends, first = words.find_words(low, bounds)
        hashes = words.hash_spans(low, starts, ends)
        values, owner, size = [], [], None
        for w in [width, *short]:
            start, text = words.whole_windows(first, w)
            v, t = words.distinct_per_text((words.hash_windows(hashes, w)[start] if len(start) else np.zeros(0, _U)) + _U(w), text)
            size = np.bincount(t, minlength=end - at) if size is None else size
            values.append(v)
            owner.append(t)
        yield at, end, np.concatenate(values), np.concatenate(owner), size


def item_shingles(items: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(item, n, part, low, rank, hash): the distinct shingles of each item, ranked by hash; an item of fewer words has one."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, _, data, bounds in words.slices(batch.column(1)):
                low = words.lowered(data)
                starts, ends, first = words.find_words(low, bounds)
                hashes = words.hash_spans(low, starts, ends)
                values, owner = [], []
                for i, (s, e) in enumerate(zip(first[:-1], first[1:])):
                    w = min(width, int(e - s))
                    if w:
                        own = np.unique(words.hash_windows(hashes[s:e], w) + _U(w))
                        values.append(own)
                        owner.append(np.full((len(own), 2), (i + at, w)))
                owner = np.concatenate(owner) if owner else np.zeros((0, 2), int)
                values = np.concatenate(values) if values else np.zeros(0, _U)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[:, 0])), pa.array(owner[:, 1]), pa.array((values ^ _U(1 << 63)).view(np.int64))], ["item", "width", "hash"])

    schema = T.StructType([T.StructField("item", items.schema[key].dataType), T.StructField("width", T.LongType()), T.StructField("hash", T.LongType())])
    return items.where(F.col(key).isNotNull()).select(F.col(key).alias("item"), F.col(text).alias("text")).mapInArrow(sets, schema).distinct()


def contained(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
              width: int = 5, percent: int = 80, broadcast_limit: int = BROADCAST_SHINGLES) -> DataFrame:
    """(key, item key, n_item, n_shared): items of which a document holds ``percent`` / 100 of the shingles or more.

    Shingles are runs of ``width`` words, lower-cased (A-Z); an item of fewer words is one shingle of its words. Items
    and documents that are null or blank match nothing; rows without a key are not reported. Repeated keys: a pair is
    reported once if any of its rows match, with the largest n_shared over the rows of both and n_item of that item row. Empty tables give an empty result. Other columns
    are not used.
    """
    ready(docs.sparkSession)
    # rows of one item key with other texts are items of their own
    own = items.where(F.col(item_key).isNotNull()).select(F.struct(F.col(item_key).alias("key"), F.xxhash64(item_text).alias("mark")).alias("item"), F.col(item_text).alias("text"))
    shingles = stored(item_shingles(own, "item", "text", width))
    sizes = shingles.groupBy("item").agg(F.count(F.lit(1)).alias("n_item"))
    sizes = sizes.withColumn("part", F.floor(F.log2(F.col("n_item").cast("double"))).cast("int")) \
        .withColumn("needed", F.ceil(F.col("n_item") * percent / 100).cast("long"))
    # hashes ascend within an item; an item's number of rows is its size, which bounds the array
    sets = shingles.groupBy("item", "width").agg(F.sort_array(F.collect_list("hash")).alias("hashes")).join(sizes, "item")
    sets = stored(sets.withColumn("sketch", F.slice("hashes", F.lit(1), (F.col("n_item") - F.col("needed") + 1).cast("int"))))
    parts = [(r.part, r.bound, r.needed) for r in sets.groupBy("part").agg(F.max(F.element_at("sketch", -1)).alias("bound"), F.min("needed").alias("needed")).collect()]
    short = sorted(r.width for r in sets.select("width").distinct().where(F.col("width") < width).collect())
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    key_field, item_field = T.StructField("key", docs.schema[key].dataType), T.StructField("item", own.schema["item"].dataType)
    long = lambda name: T.StructField(name, T.LongType())

    if shingles.count() <= broadcast_limit:
        items_here = sets.select("item", "n_item", "needed", "part", "hashes", "sketch").toArrow()
        model = docs.sparkSession.sparkContext.broadcast(_index(items_here, parts))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, n_item, needed, sketches, every = model.value
            for batch in batches:
                for at, _, values, owner, size in _shingles(batch.column(1), width, short):
                    values = (values ^ _U(1 << 63)).view(np.int64)
                    found = []
                    for bound, least, index in sketches:
                        near = (values <= bound) & ((size[owner] >= least) | (least <= 1))
                        found.append(_matches(values[near], owner[near], index, len(names)))
                    candidates = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
                    mine = np.isin(owner, candidates // max(1, len(names)))
                    pair, shared = np.unique(_matches(values[mine], owner[mine], every, len(names)), return_counts=True)
                    full = np.isin(pair, candidates) & (shared >= needed[pair % max(1, len(names))])
                    pair, shared = pair[full], shared[full].astype(np.int64)
                    item = pair % max(1, len(names))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pair // max(1, len(names)) + at)), names.take(pa.array(item)), pa.array(n_item[item]), pa.array(shared)],
                                                     ["key", "item", "n_item", "n_shared"])

        pairs = rows.mapInArrow(search, T.StructType([key_field, item_field, long("n_item"), long("n_shared")]))
    else:
        def emitted(bounds: list[tuple] | None):
            def values_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for at, _, values, owner, size in _shingles(batch.column(1), width, short):
                        values = (values ^ _U(1 << 63)).view(np.int64)
                        for part, bound, least in bounds or [(0, np.iinfo(np.int64).max, 0)]:
                            near = (values <= bound) & ((size[owner] >= least) | (least <= 1))
                            text_rows = pa.array(owner[near] + at)
                            yield pa.RecordBatch.from_arrays([batch.column(0).take(text_rows), batch.column(2).take(text_rows), pa.array(values[near]), pa.array(np.full(int(near.sum()), part))],
                                                             ["key", "mark", "hash", "part"])
            return marked.mapInArrow(values_of, T.StructType([key_field, long("mark"), long("hash"), long("part")]))

        marked = rows.withColumn("mark", F.xxhash64("text"))
        index = sets.select("item", F.col("part").cast("long").alias("part"), F.explode("sketch").alias("hash"))
        candidates = stored(emitted(parts).join(index, ["part", "hash"]).select("key", "mark", "item").distinct())
        texts = candidates.select("key", "mark").distinct()
        counts = emitted(None).drop("part").distinct().join(texts, ["key", "mark"], "left_semi").join(candidates, ["key", "mark"]) \
            .join(sets.select("item", F.explode("hashes").alias("hash")), ["item", "hash"]) \
            .groupBy("key", "mark", "item").agg(F.count(F.lit(1)).alias("n_shared"))
        pairs = counts.join(sets.select("item", "n_item", "needed"), "item").where("n_shared >= needed")
    most = F.max(F.struct("n_shared", (-F.col("n_item")).alias("n"))).alias("most")
    return pairs.groupBy(F.col("key").alias(key), F.col("item.key").alias(item_key)).agg(most) \
        .select(key, item_key, (-F.col("most.n")).alias("n_item"), F.col("most.n_shared").alias("n_shared"))


def _index(sets: pa.Table, parts: list[tuple]) -> tuple:
    """Item names, sizes and needs; for each partition its bound, its least document size and its sketch index; the index of all shingles."""
    def flat(column: str, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = [np.array(x, np.int64) for x in sets[column].take(pa.array(rows)).to_pylist()]
        hashes = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        owner = np.repeat(rows, [len(x) for x in lists]).astype(np.int64)
        order = np.argsort(hashes, kind="stable")
        return hashes[order], owner[order]

    part = sets["part"].to_numpy()
    sketches = [(bound, least, flat("sketch", np.flatnonzero(part == p))) for p, bound, least in parts]
    names = pa.concat_arrays(sets["item"].chunks) if sets.num_rows else pa.array([], sets["item"].type)
    return names, sets["n_item"].to_numpy(), sets["needed"].to_numpy(), sketches, flat("hashes", np.arange(sets.num_rows))


def _matches(values: np.ndarray, owner: np.ndarray, index: tuple[np.ndarray, np.ndarray], n_items: int) -> np.ndarray:
    """owner * n_items + item for every value that an item of the index has."""
    hashes, items = index
    low, high = np.searchsorted(hashes, values), np.searchsorted(hashes, values, "right")
    count = high - low
    some = np.flatnonzero(count)
    count = count[some]
    at = np.repeat(low[some] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(some) else np.zeros(0, np.int64)
    return np.repeat(owner[some], count) * n_items + items[at]
