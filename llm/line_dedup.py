"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, one line per group.

A line is normalised to its words: A-Z in lower case, white space and ASCII punctuation dropped. Lines with equal
words are one class. A SimHash of 64 bits over the words is cut into five blocks; signatures that differ in three bits
at most agree in two blocks at least, so ten tables, one per pair of blocks, bring every such pair together. They also bring
together most pairs that differ in a few bits more; a second SimHash tells those from chance. Pairs are
compared where they meet, and only the links of a spanning set leave a bucket. Families of candidates are
then confirmed on the edit similarity of the normalised lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm import words
from llm.graph import groups_of, local_labels
from llm.session import ready, stored
from llm.similar import STANDS, STARS, bucket_bits, confirm, pairs_of_runs, thinned

#: Differing signature bits up to which every pair meets in a table, and up to which it is a candidate whatever the second signature.
DISTANCE = 4
SURE_DISTANCE = 0
BLOCKS = 6
#: A pair that agrees in BLOCKS - DISTANCE blocks is a candidate up to this number of differing bits of both signatures (64 and 48 bits).
BOTH_DISTANCE = 21
#: Low bits of the second signature's word hold the logarithm of the line's length, in steps of 1 / LENGTH_STEPS octaves.
LENGTH_BITS = 16
LENGTH_STEPS = 2048
#: How often the search for an edit distance looks whether it can still end below the limit.
LOOKS = 12
#: Characters of the pieces that the quick bound of the edit distance looks for.
PIECE = 10
#: Longest run of a block pair whose pairs are formed at once; in a longer one each signature is compared with the rest.
TABLE_RUN = 512
#: Longest run of a block pair in which all signatures are compared; a longer one gets a star.
COMPARED_RUN = 20_000
#: Longest run of a block pair that one batch of lines sends whole; of a longer one it makes a star.
SENT_RUN = 1_000
#: Characters of the lines that one task compares at once; a line weighs LEAST_WEIGHT at least. A larger family is compared block by block.
TASK_CHARS = 3_000_000
LEAST_WEIGHT = 200
#: A family of more blocks comes apart into the groups of single runs: each block would be sent as often as there are blocks, and a line is in few of those groups.
LARGE_BLOCKS = 8
#: Text bytes of a chunk, about.
CHUNK_BYTES = 8 << 20
#: Bits of the bitmap of wanted lines at most, as a power of two (32 MB); with more lines than it tells apart, more lines are sent than are wanted.
MOST_BITS = 28
#: Bytes whose prefix sums are formed at once, so that they stay in a core's cache.
HASH_BLOCK = 1 << 16
#: Largest family whose pairs of signatures are compared in one go.
PAIRS_AT_ONCE = 128

_U = np.uint64
_EDGES = np.linspace(0, 64, BLOCKS + 1).astype(int)
_MASKS = [_U((1 << int(b)) - (1 << int(a))) for a, b in zip(_EDGES[:-1], _EDGES[1:])]
#: Spreads the lines of one text over the bitmap.
_LINE_FACTOR = 0x9E3779B1
#: One table per kept set of blocks.
TABLES = list(combinations(range(BLOCKS), BLOCKS - DISTANCE))


#: Bytes of words, and those of them that begin a character.
_WORD = ~words.PUNCTUATION
_POINT = _WORD & ((np.arange(256) & 0xC0) != 0x80)
#: White space and punctuation as spaces, A-Z in lower case.
_NORMAL = words.lowered(np.where(words.PUNCTUATION, 32, np.arange(256)).astype(np.uint8)).tobytes()


def normal_line(line: bytes) -> str:
    """The normalised line: its words, joined by one space."""
    return b" ".join(line.translate(_NORMAL).split()).decode()


class Lines:
    """The lines of a slice of texts and their places."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        ends = np.flatnonzero(data == 0x0A) + 1
        starts = np.concatenate([bounds[:-1], ends])  # a text without bytes has one line
        owner = np.concatenate([np.arange(len(bounds) - 1), np.searchsorted(bounds, ends - 1, "right") - 1])
        order = np.lexsort((starts, owner))
        self.owner, starts = owner[order], starts[order]
        self.first = np.searchsorted(self.owner, np.arange(len(bounds)))
        self.number = np.arange(len(starts)) - self.first[self.owner]
        self.data, self.edge = data, np.append(starts, len(data))

    def with_words(self) -> np.ndarray:
        """Whether each line has words."""
        seen = np.concatenate([[0], np.cumsum(_WORD[self.data], dtype=np.int32)])
        return seen[self.edge[1:]] > seen[self.edge[:-1]]


class HashedLines(Lines):
    """Lines with two 64-bit hashes and two SimHashes: of all words, and of the distinct ones with the length of the normalised line."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        super().__init__(data, bounds)
        low = words.lowered(data)
        self.word_start, self.word_end, self.word = words.find_words(low, self.edge, words.PUNCTUATION)
        self.n_words = np.diff(self.word)
        own = words.hash_spans(low, self.word_start, self.word_end, block=HASH_BLOCK)
        self.h1, self.h2 = words.hash_runs(own, self.word, 11), words.hash_runs(own, self.word, 12)
        self.sign = simhash(words.mix(own + _U(99)), self.word)
        points = np.concatenate([[0], np.cumsum(_POINT[data], dtype=np.int32)])[self.edge]
        length = np.rint(LENGTH_STEPS * np.log2(np.maximum(1, np.diff(points) + self.n_words - 1))).astype(_U)
        self.sign2 = simhash(*distinct_words(own, self.n_words)) >> _U(LENGTH_BITS) << _U(LENGTH_BITS) | length


def distinct_words(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A second hash of the distinct words of each line, and the first of each line and the end; words are told apart by 40 bits of their first."""
    line, value = np.repeat(np.arange(len(counts), dtype=_U), counts), hashes >> _U(24)
    if len(counts) < 1 << 24:  # one sort of both together
        both = np.sort(line << _U(40) | value)
        line, value = both >> _U(40), both & _U((1 << 40) - 1)
    else:
        order = np.lexsort((value, line))
        line, value = line[order], value[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (line[1:] != line[:-1])
    return words.mix(value[keep] + _U(1_234_567)), np.searchsorted(line[keep], np.arange(len(counts) + 1, dtype=_U))


def simhash(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each run hashes[first[i]:first[i + 1]]: the bits that more than half of its hashes have set.

    Bit k of all eight bytes of a hash is counted at once, in byte counters of 64-bit sums over 255 hashes at most.
    """
    n = np.diff(first)
    out, full = np.zeros(len(n), _U), np.flatnonzero(n)
    if not len(full):
        return out
    pieces = -(-n[full] // 255)
    piece = np.concatenate([[0], np.cumsum(pieces)])[:-1]
    start = np.repeat(first[full] - 255 * piece, pieces) + 255 * np.arange(pieces.sum())
    for k in range(8):
        counts = np.add.reduceat(hashes >> _U(k) & _U(0x0101010101010101), start).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(counts, piece, axis=0, dtype=np.int64) if len(counts) > len(full) else counts.astype(np.int64)
        most = 2 * ones > n[full, None]
        out[full] |= np.ascontiguousarray(most).view(_U).ravel() << _U(k)
    return out


def _rotations(signs: np.ndarray, table: int) -> np.ndarray:
    """The bits of each signature with the kept blocks of the table in front."""
    kept = TABLES[table]
    out = np.zeros_like(signs)
    for block in [*kept, *(b for b in range(BLOCKS) if b not in kept)]:
        width = int(_EDGES[block + 1] - _EDGES[block])
        out = out << _U(width) | signs >> _U(_EDGES[block]) & _U((1 << width) - 1)
    return out


def _kept_bits(table: int) -> int:
    return int(sum(_EDGES[b + 1] - _EDGES[b] for b in TABLES[table]))


def close(apart: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs that agree in enough blocks are candidates: by the differing bits of their first signatures, and their second words.

    Pairs whose lengths alone rule out an edit similarity of ``percent`` / 100 are none.
    """
    first, mask = np.bitwise_count(apart), _U((1 << LENGTH_BITS) - 1)
    near = np.atleast_1d((first + np.bitwise_count((a ^ b) >> _U(LENGTH_BITS)) <= BOTH_DISTANCE) | (first <= SURE_DISTANCE))
    some = np.flatnonzero(near)  # few are
    a, b = ((x if np.ndim(x) == 0 else x[some]) & mask for x in (a, b))
    near[some] = np.abs(a.astype(np.int32) - b.astype(np.int32)) <= LENGTH_STEPS * np.log2(100 / max(percent, 1)) + 1
    return near


def candidate(apart: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs meet in a table and are candidates."""
    apart, near = np.atleast_1d(apart), close(apart, a, b, percent)
    some = np.flatnonzero(near)
    equal = sum((apart[some] & mask == 0).astype(np.int8) for mask in _MASKS)
    near[some] = equal >= BLOCKS - DISTANCE
    return near


def _rotated_masks(table: int) -> list[np.uint64]:
    """The masks of the blocks where the kept blocks of the table are in front."""
    kept, masks, at = TABLES[table], {}, 64
    for block in [*kept, *(b for b in range(BLOCKS) if b not in kept)]:
        at -= int(_EDGES[block + 1] - _EDGES[block])
        masks[block] = _U((1 << int(_EDGES[block + 1] - _EDGES[block])) - 1 << at)
    return [masks[b] for b in range(BLOCKS)]


def _sooner(apart: np.ndarray, table: int, masks: list[np.uint64]) -> np.ndarray:
    """Whether pairs, by the differing bits of their signatures, meet in a table before this one."""
    return np.logical_or.reduce([np.zeros(len(apart), bool), *(apart & np.bitwise_or.reduce([masks[b] for b in t]) == 0 for t in TABLES[:table])])


def _packed(*columns: np.ndarray) -> bytes:
    """The columns byte by byte: the leading bytes of sorted keys and of ids are alike, and shuffles compress them."""
    return np.ascontiguousarray(np.stack(columns).view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1)).tobytes()


def _opened(parts: list[bytes], columns: int) -> list[np.ndarray]:
    """The columns of packed parts."""
    arrays = [np.frombuffer(p, np.uint8).reshape(columns, 8, -1).transpose(0, 2, 1) for p in parts]
    return list(np.ascontiguousarray(np.concatenate(arrays, axis=1)).view(_U)[:, :, 0])


def _candidates(classes: DataFrame, lines: int, percent: int, local: bool = False) -> DataFrame:
    """(a, b): edges that connect all pairs of classes that are candidates.

    With ``local`` (id, family, turn) instead: a family is a group that candidates connect inside one run of the table ``turn``, where each pair counts
    in the first table in which it meets. Every pair of candidates is in a family of that table, and no family reaches beyond its run; a class may be in several.
    """
    bits = min(bucket_bits(lines, least=1), min(map(_kept_bits, range(len(TABLES)))))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, signs, signs2 = batch.column(0).to_numpy().astype(_U), batch.column(1).to_numpy().view(_U), batch.column(2).to_numpy().view(_U)
            buckets, parts = [], []
            for t in range(len(TABLES) if len(ids) else 0):
                keys = _rotations(signs, t)
                order = np.argsort(keys)
                keys, own, second = keys[order], ids[order], signs2[order]
                kept, sent, hubs, spokes = thinned(keys >> _U(64 - _kept_bits(t)), np.arange(len(keys)), SENT_RUN)
                if len(hubs):  # a block pair that many lines of this batch share
                    buckets.append(STARS)
                    hubs, spokes = hubs.astype(np.int64), spokes.astype(np.int64)
                    if local:  # all of the run, by its name
                        spokes = np.concatenate([np.unique(hubs), spokes])
                        parts.append(_packed(words.mix(keys[spokes] >> _U(64 - _kept_bits(t)) << _U(8) | _U(t)), own[spokes], np.full(len(spokes), t, _U)))
                    else:
                        parts.append(_packed(own[hubs], own[spokes]))
                at = (sent & ~STANDS).astype(np.int64)
                keys, own, second = keys[at], own[at] | sent & STANDS, second[at]
                names, start = np.unique(keys >> _U(64 - bits), return_index=True)
                for b, s, e in zip(names, start, np.append(start[1:], len(keys))):
                    buckets.append(t << bits | int(b))
                    parts.append(_packed(keys[s:e], own[s:e], second[s:e]))
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(parts, pa.binary())], ["bucket", "part"])

    def compared(name: tuple, table: pa.Table) -> pa.Table:
        if name[0].as_py() == STARS:
            a, b, *turn = (x.view(np.int64) for x in _opened(table["part"].to_pylist(), 3 if local else 2))
            return pa.table({"id": b, "family": a, "turn": turn[0].astype(np.int32)} if local else {"a": np.minimum(a, b), "b": np.maximum(a, b)})
        keys, ids, second = _opened(table["part"].to_pylist(), 3)
        t = name[0].as_py() >> bits
        masks = _rotated_masks(t)
        order = np.argsort(keys)
        keys, ids, second = keys[order], ids[order], second[order]
        stands, ids = ids >= STANDS, ids & ~STANDS
        top = keys >> _U(64 - _kept_bits(t))
        start = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))
        size = np.diff(np.append(start, len(keys)))
        star = (size > COMPARED_RUN) | (np.logical_or.reduceat(stands, start) & (size > 1))

        def met(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            apart = keys[i] ^ keys[j]
            near = close(apart, second[i], second[j], percent)
            i, j = i[near], j[near]
            some = ~_sooner(apart[near], t, masks) if local else slice(None)
            return i[some], j[some]

        short = (size > 1) & (size <= 64) & ~star
        i, j = met(*pairs_of_runs(start[short], size[short]))
        left, right = [i], [j]
        rest = star | (size > 64)
        for s, n, whole in zip(start[rest], size[rest], star[rest]):
            if whole:
                left.append(np.full(n - 1, s))
                right.append(np.arange(s + 1, s + n))
                continue
            if n <= TABLE_RUN:
                i, j = met(*pairs_of_runs(np.array([s]), np.array([n])))
                left.append(i)
                right.append(j)
                continue
            for k in range(s, s + n - 1):
                apart = keys[k + 1:s + n] ^ keys[k]
                hit = np.flatnonzero(close(apart, second[k + 1:s + n], second[k], percent))
                if local:
                    hit = hit[~_sooner(apart[hit], t, masks)]
                left.append(np.full(len(hit), k))
                right.append(hit + k + 1)
        label = local_labels(len(keys), np.concatenate(left), np.concatenate(right))
        if local:
            run, rest = words.mix(top << _U(8) | _U(t)), np.flatnonzero(np.bincount(label, minlength=len(keys))[label] > 1)
            family = np.where(np.repeat(star, size), run, words.mix(run + ids[label]))
            return pa.table({"id": ids[rest].astype(np.int64), "family": family[rest].view(np.int64), "turn": np.full(len(rest), t, np.int32)})
        rest = np.flatnonzero(label != np.arange(len(keys)))
        a, b = ids[label[rest]].astype(np.int64), ids[rest].astype(np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    met = classes.select("id", "sign", "sign2").mapInArrow(spread, "bucket long, part binary")
    # stars are spread over tasks of their own
    spread_out = F.when(F.col("bucket") == STARS, F.xxhash64("part")).otherwise(F.lit(0))
    return met.withColumn("spread", spread_out).groupBy("bucket", "spread").applyInArrow(compared, "id long, family long, turn int" if local else "a long, b long").distinct()


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance; a column of the table is the bits of two integers, where it rises and where it falls."""
    if len(a) < len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    full, wide = (1 << len(b)) - 1, (2 << len(b)) - 1
    up, down = full, 0
    for c in a:
        same = where.get(c, 0)
        flat = (same & up) + up ^ up | same | down
        plus = (((flat | up) ^ wide | down) << 1 | 1) & full
        up, down = ((up & flat) << 1 | (flat | plus) ^ wide) & full, plus & flat
    return len(a) + up.bit_count() - down.bit_count()


def common_within(a: str, where: dict[str, int], m: int, most: int) -> int:
    """Length of the longest common subsequence of ``a`` and a text of ``m`` characters whose places are in ``where``, of characters that
    are at most ``most`` places apart: no alignment of a distance up to ``most`` keeps more. Too short for that distance, it is only bounded.

    ``left`` is a row of the table: the bits that are not set count the characters kept so far.
    """
    n, at, full = len(a), 0, (1 << m) - 1
    step, get, left = max(32, n // 8), where.get, full
    while at < n:
        end = min(n, at + step)
        near = (1 << end + most) - 1 >> max(0, at - most) << max(0, at - most)
        for c in a[at:end]:
            met = left & get(c, 0) & near
            left = left + met | left - met
        at, left = end, left & full
        if at - m + left.bit_count() > most:
            return n - at + m - left.bit_count()
    return m - left.bit_count()


def within_distance(a: str, b: str, most: int) -> bool:
    """Whether the Levenshtein distance is no more than ``most``.

    The longest common subsequence, which takes a third of the work for a character, decides most pairs. For the rest as ``edit_distance``, but some columns of the table are unfolded on the way: no path through a column costs less than its entry there and
    the difference of the lengths that are left, so a column without an entry low enough ends the search.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return False
    where: dict[str, int] = {}
    bit = 1
    for c in b:
        where[c] = where.get(c, 0) | bit
        bit <<= 1
    n, m, size = len(a), len(b), (len(b) + 7) // 8
    common = common_within(a, where, m, most)
    if n - common > most:
        return False
    if n + m - 2 * common <= most:
        return True
    full, wide = (1 << m) - 1, (2 << m) - 1
    up, down, at = full, 0, 0
    step = max(24, n // LOOKS)
    left = m - np.arange(m + 1)
    while at < n:
        for c in a[at:at + step]:
            same = where.get(c, 0)
            flat = (same & up) + up ^ up | same | down
            plus = (((flat | up) ^ wide | down) << 1 | 1) & full
            up, down = ((up & flat) << 1 | (flat | plus) ^ wide) & full, plus & flat
        at = min(n, at + step)
        if at < n and at > most // 2:
            rise, fall = (np.unpackbits(np.frombuffer(x.to_bytes(size, "little"), np.uint8), count=m, bitorder="little").view(np.int8) for x in (up, down))
            entry = np.concatenate([[0], np.cumsum(rise - fall, dtype=np.int32)])
            if at + int((entry + np.abs(left - (n - at))).min()) > most:
                return False
    return n + up.bit_count() - down.bit_count() <= most


def _shared(a: str, b: str) -> int:
    """Characters of the common start."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _core(a: str, b: str) -> tuple[str, str]:
    """The strings without their common start and end."""
    low = _shared(a, b)
    a, b = a[low:], b[low:]
    high = _shared(a[::-1], b[::-1])
    return a[:len(a) - high], b[:len(b) - high]


def distance_bound(a: str, b: str, slack: int) -> int:
    """No less than the edit distance: starts, ends and pieces that both have (at most ``slack`` apart) stay, the rest is exchanged."""
    a, b = _core(a, b)
    for at in (len(a) // 2, len(a) // 4, 3 * len(a) // 4):
        if at + PIECE <= len(a):
            there = b.find(a[at:at + PIECE], max(0, at - slack), at + PIECE + slack)
            if there >= 0:
                return distance_bound(a[:at], b[:there], slack) + distance_bound(a[at + PIECE:], b[there + PIECE:], slack)
    return max(len(a), len(b))


def similar_lines(a: str, b: str, percent: int) -> bool:
    """Whether the edit similarity, 1 - distance / longer length, is percent / 100 at least."""
    longest = max(len(a), len(b))
    allowed = (100 - percent) * longest // 100
    if abs(len(a) - len(b)) > allowed:
        return False
    a, b = _core(a, b)
    return distance_bound(a, b, allowed) <= allowed or within_distance(a, b, allowed)


def _linked(percent: int):
    def links(table: pa.Table, cut: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """With ``cut``, rows before it are compared with the others only."""
        texts, signs, signs2 = table["line"].to_pylist(), table["sign"].to_numpy().view(_U), table["sign2"].to_numpy().view(_U)
        group, left, right, turn = list(range(len(texts))), [], [], table["turn"][0].as_py()

        def near(s: np.ndarray, t: np.ndarray, s2: np.ndarray, t2: np.ndarray) -> np.ndarray:
            """The candidates; in a family of a run those that did not meet before, as an earlier table has them."""
            found = np.flatnonzero(candidate(s ^ t, s2, t2, percent))
            return found[~_sooner((s ^ t)[found], turn, _MASKS)] if turn > 0 and len(found) else found

        def pairs() -> Iterator[tuple[int, int]]:
            if cut is None and len(texts) <= PAIRS_AT_ONCE:
                i, j = np.triu_indices(len(texts), 1)
                some = near(signs[i], signs[j], signs2[i], signs2[j])
                yield from zip(i[some].tolist(), j[some].tolist())
                return
            for i in range(len(texts) - 1 if cut is None else cut):
                s = i + 1 if cut is None else cut
                for j in (near(signs[s:], signs[i], signs2[s:], signs2[i]) + s).tolist():
                    yield i, j

        def root(x: int) -> int:
            while group[x] != x:
                group[x] = x = group[group[x]]
            return x

        for i, j in pairs():
            if root(i) != root(j) and similar_lines(texts[i], texts[j], percent):
                group[root(j)] = root(i)
                left.append(i)
                right.append(j)
        return np.array(left, int), np.array(right, int)
    return links


def _bitmap(members: DataFrame) -> np.ndarray:
    """The bits of all (mark, line_no): lines whose bit is not set are not wanted, and few others have a bit that is set."""
    size = 1 << min(MOST_BITS, max(15, (16 * members.count()).bit_length()))
    slot = F.col("mark").bitwiseXOR(F.col("line_no").cast("long") * _LINE_FACTOR).bitwiseAND(F.lit(size - 1))
    parts = members.select(slot.alias("slot")).groupBy(F.shiftright("slot", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(F.lit(0x7FFF))).alias("bits"))
    out = np.zeros((size >> 15, 1 << 12), np.uint8)
    for row in parts.collect():
        out[row.part] = np.frombuffer(row.bits, np.uint8)
    return out.ravel()


def _in_bitmap(bits: np.ndarray, marks: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    slot = (marks ^ numbers.astype(np.int64) * _LINE_FACTOR) & (8 * len(bits) - 1)
    return (bits[slot >> 3] >> (slot & 7) & 1).astype(bool)


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, plus n_lines and n_removed (lines with words).

    Lines end at \\n. Two lines are linked if their words are equal, or if they are candidates by their signatures (``candidate``)
    and the edit similarity of the normalised lines is ``percent`` / 100 at least. Of each connected
    group the first line stays, by key (null last), then by a hash of the text, then by line number; the others go with
    their line end. Lines without words (blank, punctuation only) stay. A null text stays null with 0 lines. Rows
    with equal key and text are one document and share their result. All columns of ``docs`` come
    back; columns that clash with names used inside are safe, columns named n_lines or n_removed are replaced. An empty table gives an empty result.
    """
    ready(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    mark = F.xxhash64(F.col(key), F.col(text))
    chunk = F.pmod(mark, F.lit(max(1, -(-total // CHUNK_BYTES))))
    key_type = docs.schema[key].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, bounds in words.slices(batch.column(1)):
                lines = HashedLines(data, bounds)
                some = np.flatnonzero(lines.n_words)
                rows = pa.array(lines.owner[some] + at)
                size = (lines.word_end[lines.word[some + 1] - 1] - lines.word_start[lines.word[some]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[some].view(np.int64)) for x in (lines.h1, lines.h2, lines.sign, lines.sign2)]
                    + [batch.column(0).take(rows), batch.column(2).take(rows), batch.column(3).take(rows),
                       pa.array(lines.number[some].astype(np.int32)), pa.array(size)],
                    ["h1", "h2", "sign", "sign2", "key", "mark", "chunk", "line", "size"])

    occurrences = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), mark.alias("mark"), chunk.alias("chunk")) \
        .mapInArrow(describe, f"h1 long, h2 long, sign long, sign2 long, key {key_type}, mark long, chunk long, line int, size long")
    place = F.struct(F.col("key").isNull().alias("last"), "key", "mark", "line", "chunk")
    classes = stored(
        occurrences.groupBy("h1", "h2", "sign").agg(F.min(place).alias("first"), F.max("sign2").alias("sign2"), F.max("size").alias("size"))
        .withColumn("id", F.monotonically_increasing_id()))
    families = groups_of(stored(_candidates(classes, classes.count(), percent)))

    members = stored(classes.join(families.withColumnRenamed("label", "family"), "id").select(
        "id", "family", F.lit(-1).alias("turn"), "sign", "sign2", F.col("first.mark").alias("mark"), F.col("first.line").alias("line_no"), F.col("first.chunk").alias("chunk"),
        F.greatest("size", F.lit(LEAST_WEIGHT)).alias("weight")))
    large = members.groupBy("family").agg(F.sum("weight").alias("total")).where(F.col("total") > LARGE_BLOCKS * TASK_CHARS).select("family").collect()
    if large:  # few of their pairs are candidates: they come apart into the groups of single runs
        large = F.broadcast(docs.sparkSession.createDataFrame(large, "family long"))
        apart = members.join(large, "family", "left_semi")
        runs = _candidates(apart, apart.count(), percent, local=True)
        members = stored(members.join(large, "family", "left_anti").unionByName(apart.drop("family", "turn").join(runs, "id").select(members.columns)))
    back = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    others = [c for c in back if c not in (key, text)]
    rows = docs.select(F.struct(F.lit(0).alias("0"), *others).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"), mark.alias("mark"), chunk.alias("chunk"))
    by_chunk = rows.groupBy("chunk")

    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(members))

    def wanted_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, chunks = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for at, end, data, bounds in words.slices(batch.column(0)):
                lines = Lines(data, bounds)
                owner = lines.owner + at
                some = np.flatnonzero(_in_bitmap(bits.value, marks[owner], lines.number))
                found = [normal_line(data[s:e].tobytes()) for s, e in zip(lines.edge[some].tolist(), lines.edge[some + 1].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(marks[owner[some]]), pa.array(lines.number[some].astype(np.int32)), pa.array(chunks[owner[some]]), pa.array(found, pa.string())],
                                                 ["mark", "line_no", "chunk", "line"])

    def fetch(table: pa.Table, wanted: pa.Table) -> pa.Table:
        lines = dict(zip(zip(table["mark"].to_pylist(), table["line_no"].to_pylist()), table["line"].to_pylist()))
        wanted = wanted.take(pa.array(np.lexsort((wanted["line_no"].to_numpy(), wanted["mark"].to_numpy()))))
        found = [lines[x] for x in zip(wanted["mark"].to_pylist(), wanted["line_no"].to_pylist())]
        return wanted.select(["id", "family", "turn", "sign", "sign2"]).append_column("line", pa.array(found, pa.string()))

    texts = docs.select(F.col(text).alias("text"), mark.alias("mark"), chunk.alias("chunk")).mapInArrow(wanted_lines, "mark long, line_no int, chunk long, line string")
    # written at every size: the plans that read it would else fetch the lines again
    with_line = stored(texts.groupBy("chunk").cogroup(members.groupBy("chunk")).applyInArrow(fetch, "id long, family long, turn int, sign long, sign2 long, line string"))
    groups = confirm(members, with_line, ["turn", "sign", "sign2", "line"], _linked(percent), TASK_CHARS, across=True, several=bool(large))
    group = F.coalesce("label", "id")
    kept = classes.join(groups, "id", "left").groupBy(group.alias("group")).agg(F.min("first").alias("first")) \
        .select("first.key", "first.mark", "first.line", F.col("first.chunk").alias("chunk"))

    def rewrite(table: pa.Table, stay: pa.Table) -> pa.Table:
        stays: dict[tuple, set[int]] = {}
        for k, m, line in zip(stay["key"].to_pylist(), stay["mark"].to_pylist(), stay["line"].to_pylist()):
            stays.setdefault((k, m), set()).add(line)
        texts, n_lines, n_removed = [], [], []
        keys, marks, at = table["key"].to_pylist(), table["mark"].to_pylist(), 0
        for part in table["text"].chunks:
            for s, e, data, bounds in words.slices(part):
                lines = Lines(data, bounds)
                some, new = lines.with_words(), []
                gone = some.copy()
                for row in range(e - s):
                    gone[[lines.first[row] + k for k in stays.get((keys[at + row], marks[at + row]), ())]] = False
                total, lost = (np.concatenate([[0], np.cumsum(x)])[lines.first] for x in (some, gone))
                for row in np.flatnonzero(np.diff(lost)).tolist():
                    drop = gone[lines.first[row]:lines.first[row + 1]]
                    rest = [x for x, g in zip(part[s + row].as_py().split("\n"), drop) if not g]
                    new.append("\n".join(rest))
                texts.append(pc.replace_with_mask(part.slice(s, e - s), pa.array(np.diff(lost) > 0), pa.array(new, pa.string())))
                n_lines.append(np.diff(total))
                n_removed.append(np.diff(lost))
                at += e - s
        out = {"key": table["key"], "row": table["row"], "text": pa.chunked_array(texts, pa.string())}
        return pa.table(out | {"n_lines": np.concatenate([np.zeros(0, np.int64), *n_lines]), "n_removed": np.concatenate([np.zeros(0, np.int64), *n_removed])})

    result = T.StructType([T.StructField("key", docs.schema[key].dataType), rows.schema["row"], T.StructField("text", T.StringType()),
                           T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    done = by_chunk.cogroup(kept.groupBy("chunk")).applyInArrow(rewrite, result)
    names = [F.col("key" if c == key else "text").alias(c) if c in (key, text) else F.col("row").getField(c).alias(c) for c in back]
    return done.select(*names, "n_lines", "n_removed")
