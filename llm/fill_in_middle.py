"""Fill-in-middle transformation: texts cut at token boundaries and rearranged as prefix, suffix, middle.

A token is a run of ASCII letters, or any other single code point. The boundaries of all texts of a slice go into a
learned rank index (``rank_index``): a cut, given as a number of tokens, is predicted by its segment's line and corrected
by the stored residual, so a cut costs a search over segments and the tokens themselves are never kept.
Every row is treated alone; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm import words
from llm.rank_index import RankIndex
from llm.session import ready

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of the texts that are cut, and of those the percent with the suffix in front.
CUT_PERCENT = 90
SPM_PERCENT = 20
#: Bytes whose boundaries are found and fitted at once.
BLOCK_BYTES = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def boundaries(data: np.ndarray, bounds: np.ndarray, block: int = BLOCK_BYTES) -> tuple[RankIndex, np.ndarray]:
    """The index of the first bytes of all tokens and the end of the data, and the rank of each text's first token (one more entry than texts)."""
    index, base = RankIndex(), np.zeros(len(bounds), np.int64)
    for at in range(0, len(data), block):
        part = data[at:at + block]
        letter = _LETTER[part]
        goes_on = np.empty(len(part), bool)
        goes_on[0] = at > 0 and letter[0] and _LETTER[data[at - 1]]
        np.logical_and(letter[1:], letter[:-1], out=goes_on[1:])
        goes_on |= (part & 0xC0) == 0x80
        firsts = bounds[(bounds >= at) & (bounds < at + len(part))] - at
        goes_on[firsts] = False
        starts = np.flatnonzero(~goes_on) + at
        index.extend(starts)
        base += np.searchsorted(starts, bounds)
    index.extend(np.array([len(data)]))
    return index.closed(), base


def random_numbers(key: Column, seed: int = 1) -> list[Column]:
    """Four numbers of 32 bits, the first hex digits of the SHA-256 of ``seed:key``; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def _code_points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) of every row.

    ``n`` is the number of tokens. Two random ranks from 0 to n cut the text into prefix, middle and suffix, each of which may
    be empty. ``form`` is psm, spm or plain; a plain text is its own output and has no cuts (null). Plain are empty texts, texts that
    contain a mark, and 100 - ``CUT_PERCENT`` percent of the others. The random numbers follow from ``seed`` and the key, so
    reruns agree and repeated rows share their result. A null text is empty; an empty table gives an empty result. Other
    columns are not used.
    """
    ready(docs.sparkSession)
    key_type = docs.schema[key].dataType.simpleString()
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, bounds in words.slices(batch.column(1)):
                h = [batch.column(2 + k).slice(at, end - at).to_numpy() for k in range(4)]
                index, base = boundaries(data, bounds)
                n = np.diff(base)
                one, two = h[0] % (n + 1), h[1] % (n + 1)
                low = index.offsets(base[:-1] + np.minimum(one, two))
                high = index.offsets(base[:-1] + np.maximum(one, two))
                forms, outputs, prefix_chars, middle_chars = [], [], [], []
                for row, (a, b, start, stop) in enumerate(zip(low.tolist(), high.tolist(), bounds[:-1].tolist(), bounds[1:].tolist())):
                    whole = data[start:stop].tobytes()
                    if not whole or h[2][row] % 100 >= CUT_PERCENT or any(x in whole for x in marks):
                        forms.append("plain")
                        outputs.append(whole)
                        prefix_chars.append(None)
                        middle_chars.append(None)
                        continue
                    prefix, middle, suffix = whole[:a - start], whole[a - start:b - start], whole[b - start:]
                    spm = h[3][row] % 100 < SPM_PERCENT
                    forms.append("spm" if spm else "psm")
                    outputs.append(b"".join([s, suffix, p, prefix, m, middle] if spm else [p, prefix, s, suffix, m, middle]))
                    prefix_chars.append(_code_points(data[start:a]))
                    middle_chars.append(_code_points(data[a:b]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, end - at), pa.array(n), pa.array(forms, pa.string()), pa.array(prefix_chars, pa.int64()),
                     pa.array(middle_chars, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string())],
                    ["key", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *random_numbers(F.col(key), seed))
    return rows.mapInArrow(transform, f"key {key_type}, n long, form string, prefix_chars long, middle_chars long, output string") \
        .withColumnRenamed("key", key)


def restored(output: Column, form: Column) -> Column:
    """The text before the transformation, from its output and form alone.

    No part of a text that was cut contains a mark, and no mark ends as another begins, so the first mark found is the one put in.
    """
    def between(first: str, second: str) -> Column:
        start = F.length(F.lit(first)) + 1
        return F.substring(output, start, F.locate(second, output) - start)

    second, third = F.locate(SUFFIX, output), F.locate(MIDDLE, output)
    middle = F.substring(output, third + len(MIDDLE), F.length(output))
    psm = F.concat(between(PREFIX, SUFFIX), middle, F.substring(output, second + len(SUFFIX), third - second - len(SUFFIX)))
    second = F.locate(PREFIX, output)
    spm = F.concat(F.substring(output, second + len(PREFIX), third - second - len(PREFIX)), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
