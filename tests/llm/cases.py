"""Small fixtures with the odd cases, and plain Python versions of the rules."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: Names that the operators use inside, as extra columns.
CLASHES = ("key", "mark", "id", "label", "chunk", "bucket", "part", "row", "family", "size", "n", "hash", "line", "group", "score", "task")

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in CLASHES]])


def lower(text: str) -> str:
    return text.translate(_LOWER)


def split(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def rows_of(texts: list[tuple[int | None, str | None]], sources=("a", "b", None)) -> list[tuple]:
    return [(k, t, "en", sources[i % len(sources)], len(t) if t is not None else None, *(["x"] * len(CLASHES))) for i, (k, t) in enumerate(texts)]


def odd_texts(seed: int = 3) -> list[tuple[int | None, str | None]]:
    """Copies, near copies, shared passages, hot groups, nulls, blanks, tiny and long texts, non-ASCII and repeated rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgilmnorstuéß") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]

    def text(n: int) -> str:
        words = some(n)
        for i in range(9, n, 10):
            words[i] += ".\n"
        return " ".join(words).replace("\n ", "\n")

    out: list[tuple[int | None, str | None]] = []
    base = text(120)
    passage = " ".join(some(60))
    for i in range(40):
        out.append((i, text(rng.randint(1, 150))))
    for i in range(40, 60):
        out.append((i, base))  # a group of copies
    for i in range(60, 90):  # near copies, some of them too far
        words = base.split(" ")
        for _ in range(i - 60):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append((i, " ".join(words)))
    for i in range(90, 105):
        out.append((i, text(20) + "\n" + passage + " " + text(15)))
    out += [(105, None), (106, ""), (107, " \t\n\r\x0b\x0c "), (108, "one"), (109, "one two"), (110, "One  TWO\tthree"), (111, "one two three"),
            (112, "\n\n...\n!!\n"), (113, "😀 é ß " * 30), (114, "x" * 5000), (115, text(12_000)), (116, text(5) * 40), (None, base), (None, text(30)), (117, base), (117, base),
            (118, "A-b, c!\nA b c\na B  C\n"), (119, "  nbsp words")]
    return out


def odd_documents(spark, seed: int = 3):
    return spark.createDataFrame(rows_of(odd_texts(seed)), SCHEMA).repartition(5)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


class Groups:
    """Union by smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = sorted((self.root(i), self.root(j)))
        self.up[b] = a


def shingles(text: str | None, width: int) -> set[tuple]:
    words = split(lower(text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}
