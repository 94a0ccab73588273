"""Near duplicates: MinHash signatures, a multi-index Hamming join, and confirmation on full shingle sets.

A signature has 64 symbols of 16 bits. At the wanted similarity the number of differing symbols follows a
binomial law; ``allowed`` is the distance that a pair at the threshold exceeds with a chance below
``MISS`` (pairs above the threshold: less). The signature is cut into (allowed + 1) / 2 chunks. Of a pair
within the distance, one chunk at least has no more than one differing symbol, so with one key per chunk and
left-out symbol every such pair shares a key: the join loses no pair within the distance. Pairs within the
distance are then joined to families, and inside a family the full sets decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import words
from llm.graph import groups_of
from llm.session import ready, stored
from llm.similar import bucket_bits, by_bucket, confirm, meet

SYMBOLS = 64
#: Chance that the signatures of a pair at the threshold differ in more symbols than the join allows.
MISS = 1e-6
#: Shingles of the rows that one task compares at once.
TASK_SHINGLES = 1_500_000
#: A member weighs as many shingles at least, which bounds the members of a task.
LEAST_WEIGHT = 750

_U = np.uint64
_XOR = words.mix(np.arange(SYMBOLS, dtype=_U) + _U(4242))
_ODD = words.mix(np.arange(SYMBOLS, dtype=_U) + _U(777)) | _U(1)


def allowed_distance(percent: int, miss: float = MISS, symbols: int = SYMBOLS) -> int:
    """The smallest odd distance that a pair at the threshold exceeds with a chance below ``miss``."""
    p, tail = 1 - percent / 100, 1.0
    for d in range(symbols):
        tail -= math.comb(symbols, d) * p**d * (1 - p)**(symbols - d)
        if d % 2 and tail < miss:
            return d
    return symbols - 1


def signatures(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """One row of 16-bit symbols for each non-empty set values[cut[i]:cut[i + 1]]."""
    out = np.empty((len(cut) - 1, SYMBOLS), np.uint16)
    for k in range(SYMBOLS):
        low = np.minimum.reduceat((values ^ _XOR[k]) * _ODD[k], cut[:-1])
        out[:, k] = words.mix(low) & _U(0xFFFF)
    return out


def set_table(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, n_shingles, s1, s2, mark, signature): the shingle set of every row, as a 128-bit digest and a signature."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, bounds in words.slices(batch.column(1)):
                n = end - at
                values, owner = words.shingle_sets(data, bounds, width)
                cut = np.searchsorted(owner, np.arange(n + 1))
                size = np.diff(cut)
                some = np.flatnonzero(size)
                s1, s2, marks = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, None, object)
                if len(some):
                    starts = np.append(cut[:-1][some], len(values))
                    s1[some] = np.add.reduceat(words.mix(values), starts[:-1]).astype(np.int64)
                    s2[some] = np.add.reduceat(words.mix(values ^ _XOR[1]), starts[:-1]).astype(np.int64)
                    packed = signatures(values, starts).view(np.int64)
                    for i, row in zip(some, packed):
                        marks[i] = row
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), pa.array(size.astype(np.int64)), pa.array(s1), pa.array(s2),
                     batch.column(2).slice(at, n), pa.array(marks.tolist(), pa.list_(pa.int64()))],
                    ["key", "n_shingles", "s1", "s2", "mark", "signature"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))
    return rows.mapInArrow(sets, "key long, n_shingles long, s1 long, s2 long, mark long, signature array<long>")


def _keyed(classes: DataFrame, allowed: int, bits: int) -> DataFrame:
    chunks = np.array_split(np.arange(SYMBOLS), (allowed + 1) // 2)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids = batch.column(0).to_numpy()
            symbols = batch.column(1).flatten().to_numpy().view(np.uint16).reshape(n, SYMBOLS).astype(_U)
            out = []
            for c, chunk in enumerate(chunks):
                # the sum over a chunk, less one symbol, is the key that leaves that symbol out
                parts = words.mix((symbols[:, chunk] << _U(8)) | np.arange(len(chunk), dtype=_U)[None, :])
                whole = parts.sum(axis=1, dtype=_U)
                for left_out in range(len(chunk)):
                    out.append(words.mix((whole - parts[:, left_out]) ^ words.mix(np.array([c * SYMBOLS + left_out], _U))))
            found = list(by_bucket(np.concatenate(out), np.tile(ids, len(out)), bits))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([p for _, p in found], pa.binary())], ["bucket", "part"])

    return classes.select("id", "signature").mapInArrow(keys, "bucket int, part binary")


def _distance(a: str, b: str):
    """Differing 16-bit symbols of two signatures."""
    def lanes(x, y):
        d = x.bitwiseXOR(y)
        for shift in (8, 4, 2, 1):
            d = d.bitwiseOR(F.shiftrightunsigned(d, shift))
        return F.bit_count(d.bitwiseAND(F.lit(0x0001000100010001)))
    return F.aggregate(F.zip_with(a, b, lanes), F.lit(0), lambda s, x: s + x)


def _linked(width: int, percent: int):
    """Index pairs that connect all rows of a family whose full sets reach the threshold."""
    def links(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        n = table.num_rows
        sets = []
        for at, end, data, bounds in words.slices(table["text"].combine_chunks()):
            values, owner = words.shingle_sets(data, bounds, width)
            sets.append((values, owner + at))
        values, owner = (np.concatenate(x) for x in zip(*sets))
        size = np.bincount(owner, minlength=n)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        start = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        count = np.diff(np.append(start, len(values)))
        if n == 2:
            common = int((count == 2).sum())
            hit = np.array([0] if 100 * common >= percent * (int(size.sum()) - common) else [], int)
            return hit, hit + 1
        owner, column = owner[np.repeat(count > 1, count)], np.repeat(np.arange((count > 1).sum()), count[count > 1])
        common, step = np.zeros((n, n), np.float32), max(256, (8 << 20) // n)
        for low in range(0, int((count > 1).sum()), step):  # columns in blocks: one dense product each
            s, e = np.searchsorted(column, [low, low + step])
            m = np.zeros((n, min(step, int(column[e - 1]) - low + 1)), np.float32)
            m[owner[s:e], column[s:e] - low] = 1
            common += m @ m.T
        union = size[:, None] + size[None, :] - common
        i, j = np.nonzero(np.triu(100 * common.astype(np.float64) >= percent * union, 1))
        return i, j
    return links


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, kept): groups of texts linked by the Jaccard similarity of their shingles.

    Shingles are runs of ``width`` words, lower-cased (A-Z). A text with fewer words counts as one shingle; null,
    empty and blank texts have none, are linked with nothing and stay. Rows with equal sets form one
    class whatever their number, so copies cost one row each. ``component_id`` is the smallest key reachable,
    ``kept`` marks the row with that key. Rows without a key come back with a null component, kept;
    repeated rows share their result. An empty table gives an empty result. Other columns are not used.
    """
    spark = ready(docs.sparkSession)
    allowed = allowed_distance(percent)
    sets = stored(set_table(docs, key, text, width))
    keyed = sets.where("key IS NOT NULL AND n_shingles > 0")
    classes = stored(
        keyed.groupBy("s1", "s2", "n_shingles")
        .agg(F.min(F.struct("key", "mark")).alias("first"), F.min("signature").alias("signature"))
        .select(F.monotonically_increasing_id().alias("id"), "s1", "s2", "n_shingles", "first.key", "first.mark", "signature"))

    candidates = stored(meet(_keyed(classes, allowed, bucket_bits(SYMBOLS * classes.count()))))
    marks = classes.select("id", "signature")
    near = candidates.where("NOT star") \
        .join(marks.withColumnsRenamed({"id": "a", "signature": "sa"}), "a") \
        .join(marks.withColumnsRenamed({"id": "b", "signature": "sb"}), "b") \
        .where(_distance("sa", "sb") <= allowed).select("a", "b")
    families = groups_of(near.unionByName(candidates.where("star").select("a", "b")))

    members = stored(classes.join(families, "id").select(
        "id", F.col("label").alias("family"), "key", "mark", F.greatest("n_shingles", F.lit(LEAST_WEIGHT)).alias("weight")))
    texts = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))
    # the same join at every size: the members of all families have no bound
    with_text = texts.join(members.drop("weight").hint("merge"), ["key", "mark"]).select("id", "family", "text")
    groups = stored(confirm(members, with_text, ["text"], _linked(width, percent), TASK_SHINGLES))

    named = classes.join(groups, "id", "left").withColumn("group", F.coalesce("label", "id"))
    lowest = named.groupBy("group").agg(F.min("key").alias("component_id"))
    named = named.join(lowest, "group").select("s1", "s2", "n_shingles", "component_id")
    out = sets.select("key", "n_shingles", "s1", "s2").join(named, ["s1", "s2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("key"))
    return out.select(F.col("key").alias(key), "n_shingles", component.alias("component_id")) \
        .withColumn("component_id", F.when(F.col(key).isNotNull(), F.col("component_id"))) \
        .withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
