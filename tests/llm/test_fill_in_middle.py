"""Cuts by the learned rank index against plain token lists, and the exact way back."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from cases import SCHEMA, no_documents, odd_documents, odd_texts, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from llm import fill_in_middle as fim
from llm.rank_index import RankIndex, fitted

TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]")


def expected(key, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k:8 * k + 8], 16) for k in range(4))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return key, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 20:
        return key, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return key, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def marked():
    return [(1000, "<P>"), (1001, "a <S> b"), (1002, "text <M"), (1003, "<<P"), (1004, "P> and S> <"), (1005, "x" * 70_000 + " 1"), (1006, "\0\r\n\n"),
            (1007, "é" * 3000 + "ab" * 3000), *[(k, f"<{'P' * (k % 3)} S>M> <<S {k}") for k in range(1008, 1060)]]


@pytest.mark.parametrize("block", [1 << 20, 64])
def test_against_token_lists(spark, monkeypatch, block):
    monkeypatch.setattr(fim.boundaries, "__defaults__", (block,))
    docs = odd_documents(spark).union(spark.createDataFrame(rows_of(marked()), SCHEMA))
    out = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    texts = odd_texts() + marked()
    assert Counter(tuple(r)[:6] for r in out) == Counter(expected(k, t) for k, t in texts)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert Counter((r.doc_id, r.back) for r in out) == Counter((k, t or "") for k, t in texts)


def test_empty_table_and_other_key_types(spark):
    assert fim.fill_in_middle(no_documents(spark)).count() == 0
    docs = spark.createDataFrame([("k1", "one two"), ("k2", None)], "output string, n string")
    got = {r[0]: tuple(r) for r in fim.fill_in_middle(docs, key="output", text="n").toDF("k", "n", "form", "p", "m", "o").collect()}
    assert got == {k: expected(k, t) for k, t in (("k1", "one two"), ("k2", None))}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=400), st.integers(1, 127), st.integers(2, 64), st.integers(1, 100))
def test_rank_index(steps, error, segment, block):
    offsets = np.cumsum(np.array(steps, np.int64))
    first, start, slope, residual = fitted(offsets, error, segment)
    assert np.abs(residual.astype(int)).max(initial=0) <= error
    assert list(first) == sorted(set(first.tolist())) and (not len(offsets) or first[0] == 0)
    index = RankIndex(error)
    for at in range(0, len(offsets), block):
        index.extend(offsets[at:at + block])
    index.closed()
    ranks = np.arange(len(offsets))
    if len(ranks):
        assert np.array_equal(index.offsets(ranks), offsets)
        assert np.abs(index.predicted(ranks) - offsets).max() <= error


def test_few_segments_hold_a_text():
    """Words of ordinary text need few segments: that is what makes the index small."""
    rng = np.random.default_rng(5)
    offsets = np.cumsum(rng.integers(1, 12, 100_000))
    first, _, _, _ = fitted(offsets)
    assert len(first) < len(offsets) / 500
