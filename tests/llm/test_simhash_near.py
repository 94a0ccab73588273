"""Fingerprints and groups against plain loops over all pairs."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from cases import SCHEMA, Groups, lower, no_documents, odd_documents, odd_texts, rows_of, split
from hypothesis import given, settings
from hypothesis import strategies as st

from llm import simhash_near as near


def plain_print(text, width=3):
    words = split(lower(text or ""))
    shingles = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def expected(texts):
    prints = [plain_print(t) for _, t in texts]
    groups = Groups(len(texts))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                groups.join(i, j)
    low = {}
    for i, (k, _) in enumerate(texts):
        if k is not None:
            low[groups.root(i)] = min(low.get(groups.root(i), k), k)
    return Counter((k, f"{p:016x}", low.get(groups.root(i))) for i, ((k, _), p) in enumerate(zip(texts, prints)))


def near_texts():
    """Long texts with a few words changed, whose fingerprints lie within a few bits of each other."""
    rng = random.Random(8)
    some = lambda n: ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n)]
    base, out = some(900), []
    for i in range(200, 320):
        words = list(base)
        for _ in range(i % 12):
            words[rng.randrange(len(words))] = some(1)[0]
        out.append((i, " ".join(words)))
    return out + [(k, "  ".join(some(k % 7))) for k in range(400, 440)]


@pytest.mark.parametrize("tiles", [False, True])
def test_groups_against_all_pairs(spark, tiles, monkeypatch):
    if tiles:  # keys in blocks, small tasks, no broadcast
        monkeypatch.setattr(near, "KEY_CLASSES", 3)
        monkeypatch.setattr(near, "TASK_ENTRIES", 100)
        monkeypatch.setattr(near, "SHORT_RUN", 2)
        monkeypatch.setattr(near, "BROADCAST_KEYS", 0)
    texts = odd_texts() + near_texts()
    docs = odd_documents(spark).union(spark.createDataFrame(rows_of(near_texts()), SCHEMA))
    got = Counter(map(tuple, near.simhash_groups(docs).collect()))
    assert got == expected(texts)
    groups = Counter(r[2] for r in got)
    assert max(groups.values()) > 20 and any(len({r[1] for r in got if r[2] == g}) > 5 for g in groups)


def test_empty_table_and_rows_without_keys(spark):
    assert near.simhash_groups(no_documents(spark)).count() == 0
    docs = spark.createDataFrame([(None, "a b c d"), (None, "x"), ("k", "X"), ("j", None), ("i", " ")], "fingerprint string, rows string")
    got = near.simhash_groups(docs, "fingerprint", "rows").toDF("k", "p", "c").collect()
    assert Counter((r.k, r.c) for r in got) == Counter([(None, None), (None, "k"), ("k", "k"), ("j", "i"), ("i", "i")])
    assert {r.p for r in got if r.c == "i"} == {"0" * 16}


def test_every_close_pair_shares_a_key():
    rng = random.Random(2)
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), rng.randint(0, 3)):
            b ^= 1 << k
        assert any(a & m == b & m for m in near.MASKS)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 255), max_size=60, unique=True), st.integers(0, 2))
def test_linked_run(prints, distance):
    a, b = near.linked_run(np.array(prints, np.uint64), distance)
    assert all((prints[i] ^ prints[j]).bit_count() <= distance for i, j in zip(a.tolist(), b.tolist()))
    got, want = Groups(len(prints)), Groups(len(prints))
    for i, j in zip(a.tolist(), b.tolist()):
        got.join(i, j)
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                want.join(i, j)
    assert [got.root(i) for i in range(len(prints))] == [want.root(i) for i in range(len(prints))]
