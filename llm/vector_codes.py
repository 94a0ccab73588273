"""Vector code compression: part codebooks trained by integer means, assigned through per-dimension value dictionaries.

Components are integers floor(256 x). In a batch of vectors each dimension has a dictionary of its distinct integers; the squared
differences of every one of them to all entries of that dimension are tabulated once, and the distance of a part to
an entry is then a sum of table rows gathered by dictionary code. All sums are integers, so neither partitioning nor
reruns change a result. A round leaves each task as one line per entry and dimension at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.session import ready, stored
from tabstat.plans.order_stats import attach_by_value

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Integers beyond are taken as this: squared distances of some thousand dimensions then fit 64 bits.
MOST = 1 << 25
#: Vectors that are compared at once.
BATCH_ROWS = 4096


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, length, values) of the vectors without null or non-finite components; values are all their integers in a row. Empty vectors are left out."""
    length = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # a null component is nan
    owner = np.repeat(np.arange(len(length)), length)
    good = (length > 0) & (np.bincount(owner, ~np.isfinite(x), len(length)) == 0)
    with np.errstate(over="ignore"):
        values = np.clip(np.floor(SCALE * x[np.repeat(good, length)]), -MOST, MOST).astype(np.int64)
    return np.flatnonzero(good), length[good], values


def part_distances(vectors: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances (vector, entry) of one part, from the value dictionary of each dimension."""
    out = np.zeros((len(vectors), len(entries)), np.int64)
    for j in range(vectors.shape[1]):
        values, code = np.unique(vectors[:, j], return_inverse=True)
        out += ((values[:, None] - entries[None, :, j]) ** 2)[code]
    return out


def assigned(vectors: np.ndarray, codebook: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part (ties to the lower one), and the squared distances summed over parts."""
    codes, error = np.empty((len(vectors), parts), np.int64), np.zeros(len(vectors), np.int64)
    for p, dims in enumerate(np.array_split(np.arange(codebook.shape[1]), parts)):
        apart = part_distances(vectors[:, dims], codebook[:, dims])
        codes[:, p] = apart.argmin(axis=1)
        error += apart[np.arange(len(vectors)), codes[:, p]]
    return codes, error


def _vectors(batch: pa.RecordBatch, column: int, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) of the usable vectors with ``dims`` components."""
    for at in range(0, batch.num_rows, BATCH_ROWS):
        rows, length, values = integers(batch.column(column).slice(at, BATCH_ROWS))
        fits = length == dims
        yield rows[fits] + at, values[np.repeat(fits, length)].reshape(-1, dims)


def first_entries(vectors: DataFrame, key: str, vector: str, entries: int) -> np.ndarray:
    """The integers of the usable vectors with the smallest keys (null last, then by components): at most ``entries`` lines reach the driver.

    The vector with the smallest key gives the number of dimensions; vectors of another length are not usable.
    """
    key_type = vectors.schema[key].dataType.simpleString()

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, length, values = integers(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), lists], ["key", "ints"])

    kept = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector")).mapInArrow(usable, f"key {key_type}, ints array<long>")
    kept = kept.orderBy(F.col("key").asc_nulls_last(), "ints")
    found = kept.limit(entries).collect()
    if found and any(len(r.ints) != len(found[0].ints) for r in found):
        found = kept.where(F.size("ints") == len(found[0].ints)).limit(entries).collect()
    return np.array([r.ints for r in found], np.int64).reshape(len(found), len(found[0].ints) if found else 0)


def next_entries(vectors: DataFrame, vector: str, codebook: np.ndarray, parts: int) -> np.ndarray:
    """The floor of the mean of the parts that each entry is nearest to; unused entries stay. The driver sees entries times dimensions lines."""
    entries, dims = codebook.shape
    part = np.repeat(np.arange(parts), [len(x) for x in np.array_split(np.arange(dims), parts)])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, used = np.zeros((entries, dims), np.int64), np.zeros((entries, parts), np.int64)
        for batch in batches:
            for _, found in _vectors(batch, 0, dims):
                codes, _ = assigned(found, codebook, parts)
                for j in range(dims):  # sums below 2**53 are exact
                    total[:, j] += np.bincount(codes[:, part[j]], found[:, j], entries).astype(np.int64)
                for p in range(parts):
                    used[:, p] += np.bincount(codes[:, p], minlength=entries)
        some = np.argwhere(used[:, part] > 0)
        yield pa.RecordBatch.from_arrays([pa.array(some[:, 0]), pa.array(some[:, 1]), pa.array(total[some[:, 0], some[:, 1]]), pa.array(used[some[:, 0], part[some[:, 1]]])],
                                         ["entry", "dim", "total", "used"])

    counted = vectors.select(F.col(vector).cast("array<double>").alias("vector")).mapInArrow(sums, "entry long, dim long, total long, used long") \
        .groupBy("entry", "dim").agg(F.sum("total").alias("total"), F.sum("used").alias("used"))
    out = codebook.copy()
    for r in counted.collect():
        out[r.entry, r.dim] = r.total // r.used
    return out


def fit(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks of all parts side by side: one line per entry, one column per dimension (no lines if no vector is usable)."""
    ready(vectors.sparkSession)
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    codebook = first_entries(vectors, key, vector, entries)
    for _ in range(rounds if len(codebook) else 0):
        codebook = next_entries(vectors, vector, codebook, parts)
    return codebook


def codebook_digest(codebook: np.ndarray, parts: int = PARTS) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, comma-joined."""
    parted = np.array_split(np.arange(codebook.shape[1]), parts)
    return hashlib.sha256(",".join(str(x) for dims in parted for x in codebook[:, dims].ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, codebook: np.ndarray, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS) -> DataFrame:
    """(key, label, code, error) of every usable vector, by ``codebook``.

    Vectors that are null, empty, of another length than the codebook's or with null or non-finite components are left out.
    ``code`` has two hex digits per part. Repeated rows stay and share their result.
    """
    key_type, label_type = (vectors.schema[c].dataType.simpleString() for c in (key, label))
    dims = codebook.shape[1]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, found in _vectors(batch, 2, dims) if len(codebook) else ():
                codes, error = assigned(found, codebook, parts)
                digits, at = codes.astype(np.uint8).tobytes().hex(), pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array([digits[i:i + 2 * parts] for i in range(0, len(digits), 2 * parts)], pa.string()), pa.array(error)],
                    ["key", "label", "code", "error"])

    return vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector")) \
        .mapInArrow(coded, f"key {key_type}, label {label_type}, code string, error long")


def decode(codes: DataFrame, codebook: np.ndarray, code: str = "code", parts: int = PARTS) -> DataFrame:
    """``codes`` with ``decoded``: the vector that each code stands for (doubles, in the scale of the input)."""
    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parted = np.array_split(np.arange(codebook.shape[1]), parts)
        for batch in batches:
            number = np.frombuffer(bytes.fromhex("".join(batch.column(0).to_pylist())), np.uint8).reshape(-1, parts)
            found = np.concatenate([codebook[np.ix_(number[:, p], dims)] for p, dims in enumerate(parted)], axis=1) / SCALE
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(found), pa.list_(pa.float64()))], ["code", "decoded"])

    return codes.select(F.col(code).alias("code")).mapInArrow(values, "code string, decoded array<double>")


def vector_codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every usable vector, with codebooks learned from all of them.

    Usable are vectors without null or non-finite components, as long as the one with the smallest key and not empty. They are cut into ``parts``
    consecutive parts, equal or, if the length doesn't divide, one component apart. ``label_error`` sums the errors of
    equal labels, nulls together. Repeated rows count and stay; ties of the key are ordered by components. A table without
    usable vectors gives an empty result. Components beyond ``MOST`` / ``SCALE`` are taken as that. Other columns are not used.
    """
    codebook = fit(vectors, key, vector, parts, entries, rounds)
    # a label and its absence as one text that differs for each
    coded = stored(encode(vectors, codebook, key, vector, label, parts).withColumn("label", F.to_json(F.struct("label"))))
    per_label = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows")))
    total = per_label.agg(F.sum("rows")).first()[0] or 0
    out = attach_by_value(coded, per_label, "label", "rows", [], spread="key", total=total)
    return out.select(F.col("key").alias(key), "code", "error", "label_error", F.lit(codebook_digest(codebook, parts)).alias("codebooks_sha256"))
