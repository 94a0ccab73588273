"""Exact removal of long repeated passages, by fixed-block anchors.

Every text is cut into non-overlapping reference blocks of ``block`` words, block = (width + 1) / 2, so that each
window of ``width`` words holds one whole reference block. The blocks are indexed by hash and probed with
the rolling windows of all texts. A block whose words also start elsewhere is an anchor. Anchors are extended: the
``width``-word windows around them are compared across texts, and the union of the windows that occur more than
once is the union of the maximal exact repeats of at least ``width`` words.

Nothing is compared pair by pair, so a passage in a third of all texts costs its own length per chunk of texts:
texts are dealt into chunks of bounded bytes, a chunk sends each distinct hash once, and gets back one bit
per hash. Hash order makes the bits independent of row order and of recomputation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import words
from llm.session import ready
from llm.similar import bucket_bits

#: Text bytes of a chunk, about.
CHUNK_BYTES = 5 << 20
#: Hashes of a bucket, about.
BUCKET_HASHES = 1 << 21
#: Bits of a block hash that are sent besides those that name the bucket. A false match only adds a candidate.
BLOCK_BITS = 46

_U = np.uint64


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value, one plane per byte: sorted values compress well in this form."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(part: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(part, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


class _Chunk:
    """The words of a chunk of texts."""

    def __init__(self, column: pa.ChunkedArray, width: int):
        self.width, self.block = width, (width + 1) // 2
        hashes, starts, ends, first, data, at = [], [], [], [np.zeros(1, np.int64)], [], 0
        total = 0
        for part in column.chunks:
            for _, _, raw, bounds in words.slices(part):
                s, e, f = words.find_words(raw, bounds)
                hashes.append(words.hash_spans(raw, s, e))
                starts.append(s + at)
                ends.append(e + at)
                first.append(f[1:] + total)
                data.append(raw)
                at += len(raw)
                total += len(s)
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.words, self.starts, self.ends = join(hashes, _U), join(starts, np.int64), join(ends, np.int64)
        self.first, self.data = np.concatenate(first), join(data, np.uint8)

    def blocks(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct block hashes in order with (repeated here, is a reference block); positions and hashes of reference blocks."""
        at, text = words.whole_windows(self.first, self.block)
        hashes = words.hash_windows(self.words, self.block)[at] >> _U(64 - BLOCK_BITS - bits) if len(at) else np.zeros(0, _U)
        reference = (at - self.first[text]) % self.block == 0
        tagged = np.sort(hashes << _U(1) | reference.astype(_U)) if BLOCK_BITS + bits < 64 else np.sort(hashes & ~_U(1) | reference.astype(_U))
        value = tagged >> _U(1)
        start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
        end = np.append(start[1:], len(value))
        return value[start], end - start > 1, (tagged[end - 1] & _U(1)).astype(bool) if len(start) else np.zeros(0, bool), at[reference], hashes[reference]

    def candidates(self, bits: int, replies: dict[int, np.ndarray]) -> np.ndarray:
        """First words of the windows whose reference block is an anchor."""
        value, _, is_reference, at, hashes = self.blocks(bits)
        value = value[is_reference]
        hit = _read(value >> _U(BLOCK_BITS), replies)
        anchored = np.zeros(len(self.words) + self.width, bool)
        anchored[at[hit[np.searchsorted(value, hashes)]]] = True
        window, text = words.whole_windows(self.first, self.width)
        return window[anchored[window + (self.first[text] - window) % self.block]]

    def windows(self, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (bucket, hash) of the windows in order, whether each occurs twice here, and the place of each window."""
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, bool), np.zeros(0, np.int64)
        hashes = words.hash_windows(self.words, self.width, 5)[at] & ~_U(1)
        bucket = words.hash_windows(self.words, self.width, 6)[at] >> _U(64 - bits)
        order = np.lexsort((hashes, bucket))
        h, b = hashes[order], bucket[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (b[1:] != b[:-1])])
        place = np.empty(len(at), np.int64)
        place[order] = np.cumsum(new) - 1
        start = np.flatnonzero(new)
        return b[start].astype(np.int64), h[start], np.diff(np.append(start, len(h))) > 1, place


def _read(bucket: np.ndarray, replies: dict[int, np.ndarray]) -> np.ndarray:
    """The bits of the replies, in the order of the hashes that were sent."""
    names, counts = np.unique(bucket, return_counts=True)
    parts = [np.unpackbits(replies[int(b)], count=int(n)) for b, n in zip(names, counts)]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def _sent(bucket: np.ndarray, packed: np.ndarray, width: int) -> Iterator[tuple[int, bytes]]:
    names, start = np.unique(bucket, return_index=True)
    for b, s, e in zip(names, start, np.append(start[1:], len(bucket))):
        yield int(b), _planes(packed[s:e], width)


def _table(chunk: int, kind: int, found: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"chunk": pa.array([chunk] * len(found), pa.int64()), "kind": pa.array([kind] * len(found), pa.int32()),
                     "bucket": pa.array([b for b, _ in found], pa.int64()), "part": pa.array([p for _, p in found], pa.binary())})


_PARTS = "chunk long, kind int, bucket long, part binary"


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 35) -> DataFrame:
    """(key, n_words, n_removed, text): each text without the words of windows that also start elsewhere.

    A window is ``width`` consecutive words of one text, compared as they are; it is removed if its words
    also start at any other place of the input, the same text included. The kept words are joined by one
    space. Null and blank texts have no words and come back empty; a text of fewer than ``width`` words stays;
    repeated rows are texts of their own and remove each other; a null key is kept as it is. An empty table
    gives an empty result. Other columns are not used.
    """
    ready(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks = max(1, -(-total // CHUNK_BYTES))
    bits = bucket_bits(total // 6, BUCKET_HASHES)
    dealt = docs.select(F.col(key).alias("key"), F.col(text).alias("text"),
                        F.pmod(F.xxhash64(key, text), F.lit(chunks)).alias("chunk"))

    def send_blocks(name: tuple, table: pa.Table) -> pa.Table:
        value, here, reference, _, _ = _Chunk(table["text"], width).blocks(bits)
        packed = (value & _U((1 << BLOCK_BITS) - 1)) << _U(2) | here.astype(_U) << _U(1) | reference.astype(_U)
        return _table(name[0].as_py(), 1, list(_sent(value >> _U(BLOCK_BITS), packed, 6)))

    def send_windows(name: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        chunk = _Chunk(table["text"], width)
        bucket, hashes, here, _ = chunk.windows(chunk.candidates(bits, _replies(replies, 1)), bits)
        return _table(name[0].as_py(), 2, list(_sent(bucket, hashes | here.astype(_U), 8)))

    def answer(name: tuple, table: pa.Table) -> pa.Table:
        kind, bucket = name[0].as_py(), name[1].as_py()
        parts = [_from_planes(p, 6 if kind == 1 else 8) for p in table["part"].to_pylist()]
        sizes = [len(p) for p in parts]
        every = np.concatenate(parts)
        flags = 2 if kind == 1 else 1
        value = every >> _U(flags)
        order = np.argsort(value, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], value[order][1:] != value[order][:-1]]))
        tags = np.bitwise_or.reduceat((every & _U((1 << flags) - 1))[order], start)
        length = np.diff(np.append(start, len(order)))
        repeated = (length > 1) | ((tags >> _U(flags - 1)) & _U(1) == 1)
        if kind == 1:
            repeated &= (tags & _U(1)) == 1
        hit = np.empty(len(every), bool)
        hit[order] = np.repeat(repeated, length)
        out, at = [], 0
        for n in sizes:
            own = hit[at:at + n]
            out.append(np.packbits(own[(every[at:at + n] & _U(1)) == 1] if kind == 1 else own).tobytes())
            at += n
        return pa.table({"chunk": table["chunk"], "kind": table["kind"], "bucket": pa.array([bucket] * len(sizes), pa.int64()), "part": pa.array(out, pa.binary())})

    def cut(name: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        chunk = _Chunk(table["text"], width)
        at = chunk.candidates(bits, _replies(replies, 1))
        bucket, _, _, place = chunk.windows(at, bits)
        at = at[_read(bucket, _replies(replies, 2))[place]]
        n = len(chunk.words)
        step = np.bincount(at, minlength=n + 1)[:n + 1] - np.bincount(at + width, minlength=n + 1)[:n + 1]
        removed = np.cumsum(step)[:n] > 0
        kept_text = _kept(chunk, ~removed)
        gone = np.concatenate([[0], np.cumsum(removed)])
        return pa.table({"key": table["key"], "n_words": np.diff(chunk.first), "n_removed": np.diff(gone[chunk.first]), "text": kept_text})

    by_chunk = dealt.groupBy("chunk")
    anchors = by_chunk.applyInArrow(send_blocks, _PARTS).groupBy("kind", "bucket").applyInArrow(answer, _PARTS)
    repeats = by_chunk.cogroup(anchors.groupBy("chunk")).applyInArrow(send_windows, _PARTS) \
        .groupBy("kind", "bucket").applyInArrow(answer, _PARTS)
    key_type = docs.schema[key].dataType.simpleString()
    return by_chunk.cogroup(anchors.unionByName(repeats).groupBy("chunk")) \
        .applyInArrow(cut, f"key {key_type}, n_words long, n_removed long, text string").withColumnRenamed("key", key)


def _replies(table: pa.Table, kind: int) -> dict[int, np.ndarray]:
    rows = zip(table["kind"].to_pylist(), table["bucket"].to_pylist(), table["part"].to_pylist())
    return {b: np.frombuffer(p, np.uint8) for k, b, p in rows if k == kind}


def _kept(chunk: _Chunk, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    n_texts = len(chunk.first) - 1
    text = np.repeat(np.arange(n_texts), np.diff(chunk.first))[keep]
    starts, ends = chunk.starts[keep], chunk.ends[keep]
    last = np.ones(len(text), bool)
    last[:-1] = text[1:] != text[:-1]
    size = ends - starts + ~last
    stop = np.cumsum(size)
    source = np.repeat(starts - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)
    out = np.append(chunk.data, np.uint8(32))[source]
    out[stop[~last] - 1] = 32
    bounds = np.concatenate([[0], np.cumsum(np.bincount(text, weights=size, minlength=n_texts).astype(np.int64))])
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n_texts, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)])
    return array.cast(pa.large_string()).cast(pa.string())
