"""Codes, errors and codebooks against plain integer loops."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from llm import vector_codes as vc

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
                       *[T.StructField(c, T.StringType()) for c in ("key", "code", "error", "rows", "vector")]])


def odd_vectors(dims, n=150, seed=4):
    rng = random.Random(seed)
    near = [[rng.gauss(0, 0.3) for _ in range(dims)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in near[i % 9]], rng.choice([1, 2, 3, None])) for i in range(n)]
    rows += [(n + i, list(near[0]), 1) for i in range(60)]  # copies: ties
    good = [0.25] * dims
    rows += [(-1, None, 1), (-2, good[:-1] + [None], 2), (-3, good[:-1] + [float("nan")], None), (-4, good[:-1] + [float("inf")], 1), (-5, [], 1),
             (900, good + [1.0], 1), (901, [-0.5] * dims, None), (None, good, 3), (5, good, 7), (5, good, 7), (902, [1e30] * dims, 8)]
    rng.shuffle(rows)
    return [(k, [np.float32(x).item() if x is not None else None for x in v] if v is not None else None, m) for k, v, m in rows]


def expected(rows, parts=16, entries=64, rounds=2):
    kept = [(k, [max(-vc.MOST, min(vc.MOST, math.floor(256 * x))) for x in v], m) for k, v, m in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    dims = len(kept[0][1]) if kept else 0
    parted = [x.tolist() for x in np.array_split(np.arange(dims), parts)]
    books = [[[r[1][j] for j in p] for r in kept[:entries]] for p in parted]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p, dims_of in enumerate(parted):
            members = defaultdict(list)
            for _, v, _ in kept:
                part = [v[j] for j in dims_of]
                members[nearest(part, books[p])[1]].append(part)
            books[p] = [[sum(c) // len(members[i]) for c in zip(*members[i])] if members[i] else e for i, e in enumerate(books[p])]
    found, of_label = [], Counter()
    for k, v, m in kept:
        hits = [nearest([v[j] for j in p], books[i]) for i, p in enumerate(parted)]
        found.append((k, "".join(f"{i:02x}" for _, i in hits), sum(d for d, _ in hits), m))
        of_label[m] += found[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((k, c, e, of_label[m], digest) for k, c, e, m in found)


@pytest.mark.parametrize("dims, entries", [(32, 64), (19, 7), (5, 64)])
def test_against_loops(spark, dims, entries, monkeypatch):
    monkeypatch.setattr(vc, "BATCH_ROWS", 17)
    rows = odd_vectors(dims)
    table = spark.createDataFrame([(*r, *["x"] * 5) for r in rows], SCHEMA).repartition(5)
    got = Counter(map(tuple, vc.vector_codes(table, entries=entries).collect()))
    assert got == expected(rows, entries=entries)


def test_tables_without_usable_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert vc.vector_codes(none).collect() == []
    assert vc.vector_codes(none).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    bad = spark.createDataFrame([(1, None, 1, *["x"] * 5), (2, [float("nan")] * 16, 1, *["x"] * 5)], SCHEMA)
    assert vc.vector_codes(bad).count() == 0


def test_decoded_vectors_have_the_error(spark):
    """The squared distance of the integers to what the code stands for is the error."""
    rows = odd_vectors(32)
    table = spark.createDataFrame([(*r, *["x"] * 5) for r in rows], SCHEMA)
    book = vc.fit(table)
    coded = vc.encode(table, book).where("key IS NOT NULL AND key <> 5").collect()
    decoded = {r.code: np.array(r.decoded) for r in vc.decode(vc.encode(table, book), book).collect()}
    ints = {k: np.clip(np.floor(256 * np.array(v)), -vc.MOST, vc.MOST) for k, v, _ in rows if v and None not in v}
    for r in coded:
        assert ((ints[r.key] - 256 * decoded[r.code]) ** 2).sum() == r.error


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(-300, 300), min_size=3, max_size=3), min_size=1, max_size=20), st.lists(st.lists(st.integers(-300, 300), min_size=3, max_size=3), min_size=1, max_size=8))
def test_dictionary_distances(vectors, entries):
    got = vc.part_distances(np.array(vectors), np.array(entries))
    assert got.tolist() == [[sum((a - b) ** 2 for a, b in zip(v, e)) for e in entries] for v in vectors]
