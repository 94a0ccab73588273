"""Words, word hashes and window hashes of text columns, vectorised over Arrow batches.

A word is a run of ``[^\\x20\\x09-\\x0D]``. Those separators are single bytes in UTF-8 and no other
character contains them, so words are found on the encoded bytes and never decoded.
Hashes are 64 bits wide. ``seed`` chooses independent families: two of them make 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Most text bytes handled at once; only a single longer text exceeds it.
SLICE_BYTES = 2 << 20

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: White space and ASCII punctuation.
PUNCTUATION = _SPACE.copy()
PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix finaliser)."""
    x = np.asarray(x).astype(_U)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class _Family:
    """Random byte values and an odd multiplier with its powers and inverse powers modulo 2**64."""

    def __init__(self, seed: int):
        with np.errstate(over="ignore"):
            base = _U((seed * 0x9E3779B97F4A7C15 + 0x1234567) & (2**64 - 1))
            self.byte = mix(np.arange(256, dtype=_U) + base)
            r = int(mix(np.array([base + _U(999)], _U))[0])
        self.r = (r & ~7) | 5
        self.inverse = pow(self.r, -1, 2**64)
        self._up = self._down = np.ones(1, _U)

    def _grown(self, table: np.ndarray, n: int, factor: int) -> np.ndarray:
        while len(table) < n:
            table = np.concatenate([table, table * _U(pow(factor, len(table), 2**64))])
        return table

    def up(self, n: int) -> np.ndarray:
        self._up = self._grown(self._up, n, self.r)
        return self._up[:n]

    def down(self, n: int) -> np.ndarray:
        self._down = self._grown(self._down, n, self.inverse)
        return self._down


_families: dict[int, _Family] = {}


def family(seed: int) -> _Family:
    if seed not in _families:
        _families[seed] = _Family(seed)
    return _families[seed]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over a string column; nulls are empty texts."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return
    raw = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(raw, raw[at] + most, "right")) - 1)
        yield at, end, data[raw[at]:raw[end]], raw[at:end + 1] - raw[at]
        at = end


def find_words(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each text (one more entry than texts).

    ``separators`` marks the byte values between words.
    """
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(separators[data], out=inside[1:-1])
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] |= inside[1:-1][cuts]
    last[cuts - 1] |= inside[1:-1][cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    return _LOWER[data]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and don't overlap."""
    f, out = family(seed), np.zeros(len(starts), _U)
    at = 0
    while at < len(starts):  # prefix sums over blocks of whole spans
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + block, "right")))
        low, high = starts[at], ends[end - 1]
        sums = np.zeros(high - low + 1, _U)
        np.cumsum(f.byte[data[low:high]] * f.up(high - low), out=sums[1:])
        s, e = starts[at:end] - low, ends[at:end] - low
        out[at:end] = (sums[e] - sums[s]) * f.down(high - low + 1)[s]
        at = end
    return mix(out ^ (ends - starts).astype(_U) * _U(0x9E3779B97F4A7C15))


def hash_windows(words: np.ndarray, width: int, seed: int = 2) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` words, by the index of its first word (none if too few)."""
    n = len(words)
    if n < width:
        return np.zeros(0, _U)
    f = family(seed)
    out = words[:n - width + 1].copy()
    for k in range(1, width) if width <= 5 else ():
        out += words[k:n - width + 1 + k] * _U(pow(f.r, k, 2**64))
    if width > 5:
        sums = np.zeros(n + 1, _U)
        np.cumsum(words * f.up(n), out=sums[1:])
        out = (sums[width:] - sums[:-width]) * f.down(n + 1)[:n - width + 1]
    return mix(out)


def hash_runs(words: np.ndarray, first: np.ndarray, seed: int = 3) -> np.ndarray:
    """A 64-bit hash of each run words[first[i]:first[i + 1]]."""
    f, n = family(seed), len(words)
    sums = np.zeros(n + 1, _U)
    np.cumsum(words * f.up(n), out=sums[1:])
    runs = (sums[first[1:]] - sums[first[:-1]]) * f.down(n + 1)[first[:-1]]
    return mix(runs ^ np.diff(first).astype(_U) * _U(0x9E3779B97F4A7C15))


def whole_windows(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, text) of every window that lies inside one text."""
    counts = np.diff(first)
    n = np.maximum(counts - width + 1, 0)
    text = np.repeat(np.arange(len(counts)), n)
    start = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(text))
    return start, text


def distinct_per_text(values: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, value) pairs, ordered by text, then value."""
    if not len(values):
        return values, text
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    keep = np.empty(len(values), bool)
    keep[0] = True
    keep[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return values[keep], text[keep]


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (value, text) of lower-cased words; a shorter text counts as one shingle."""
    data = lowered(data)
    starts, ends, first = find_words(data, bounds)
    words = hash_spans(data, starts, ends, seed)
    start, text = whole_windows(first, width)
    values = hash_windows(words, width, seed + 1)[start] if len(start) else np.zeros(0, _U)
    counts = np.diff(first)
    for n in range(1, width):
        few = np.flatnonzero(counts == n)
        if len(few):
            short = hash_windows(words, n, seed + 1)[first[few]] + _U(n)
            values, text = np.concatenate([values, short]), np.concatenate([text, few])
    return distinct_per_text(values, text)
