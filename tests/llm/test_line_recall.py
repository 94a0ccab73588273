"""Alike lines that the candidate rule of the line dedup must not lose."""

import random

import numpy as np
import pytest
from cases import SCHEMA, rows_of

from llm import line_dedup, words


def changed_lines(n_words, changes, n=200):
    """Lines of random words, and the same with some words replaced."""
    rng = np.random.default_rng(n_words)
    vocabulary = ["".join(map(chr, rng.integers(97, 123, rng.integers(3, 10)))) for _ in range(4000)]
    lines = [[vocabulary[k] for k in rng.integers(0, 4000, n_words)] for _ in range(n)]
    others = [list(x) for x in lines]
    for x in others:
        for k in rng.choice(n_words, changes, replace=False):
            x[k] = vocabulary[rng.integers(4000)]
    return [" ".join(x) for x in lines], [" ".join(x) for x in others]


@pytest.mark.parametrize("n_words, changes", [(9, 1), (26, 1), (26, 2), (40, 2)])
def test_candidates_within_twelve_of_128_bits(n_words, changes):
    """No pair of alike lines that agrees in two blocks and differs in 12 bits of two whole signatures is lost."""
    lines, others = changed_lines(n_words, changes)
    data = np.frombuffer("\n".join(lines + others).encode(), np.uint8)
    found = line_dedup.HashedLines(data, np.array([0, len(data)]))
    hashes = words.hash_spans(words.lowered(data), found.word_start, found.word_end)
    second = line_dedup.simhash(words.mix(hashes + np.uint64(1_234_567)), found.word)
    n, met = len(lines), 0
    for i, (a, b) in enumerate(zip(lines, others)):
        apart = found.sign[i] ^ found.sign[n + i]
        blocks = sum(int(apart & mask == 0) for mask in line_dedup._MASKS)
        if line_dedup.similar_lines(a, b, 80) and blocks >= 2 and int(apart).bit_count() + int(second[i] ^ second[n + i]).bit_count() <= 12:
            met += 1
            assert line_dedup.candidate(apart, found.sign2[n + i], found.sign2[i], 80)
    assert met


def test_recall_of_alike_lines(spark):
    """Of pairs with an edit similarity of 0.8 or more, one word of 26 replaced, more than half are linked; chance links none."""
    lines, others = changed_lines(26, 1)
    assert all(line_dedup.similar_lines(a, b, 80) for a, b in zip(lines, others))
    docs = spark.createDataFrame(rows_of(list(enumerate(lines + others))), SCHEMA)
    removed = {r.doc_id for r in line_dedup.dedup_lines(docs).collect() if r.n_removed}
    assert removed <= set(range(len(lines), 2 * len(lines))) and len(removed) > len(lines) // 2


@pytest.mark.parametrize("n_words, least", [(9, 0.28), (15, 0.5), (26, 0.7), (41, 0.83)])
def test_share_of_alike_lines_that_are_candidates(n_words, least):
    """Of all pairs with an edit similarity of 0.8 or more, one word replaced: what the signatures find, by length."""
    lines, others = changed_lines(n_words, 1, 500)
    found = line_dedup.HashedLines(*(lambda x: (x, np.array([0, len(x)])))(np.frombuffer("\n".join(lines + others).encode(), np.uint8)))
    n, alike = len(lines), [line_dedup.similar_lines(a, b, 80) for a, b in zip(lines, others)]
    hits = [line_dedup.candidate(found.sign[i] ^ found.sign[n + i], found.sign2[[n + i]], found.sign2[i], 80)[0] for i in range(n)]
    assert sum(h for h, a in zip(hits, alike) if a) > least * sum(alike)


def _kept(a, b, most):
    """Longest common subsequence of characters at most ``most`` places apart, cell by cell."""
    row = [0] * (len(b) + 1)
    for i, c in enumerate(a):
        last, row = row, [0]
        for j, d in enumerate(b):
            row.append(max(last[j + 1], row[-1], last[j] + 1 if c == d and abs(i - j) <= most else 0))
    return row[-1]


def test_common_subsequence_decides_unrelated_lines(monkeypatch):
    rng = random.Random(5)
    for _ in range(300):
        a = "".join(rng.choice("abcd ") for _ in range(rng.randrange(60)))
        b = "".join(x for x in a if rng.random() < 0.9) if rng.random() < 0.5 else "".join(rng.choice("abcd ") for _ in range(rng.randrange(60)))
        a, b = max(a, b, key=len), min(a, b, key=len)
        most, distance = rng.randrange(20), line_dedup.edit_distance(a, b)
        where = {c: sum(1 << k for k, x in enumerate(b) if x == c) for c in b}
        found, kept = line_dedup.common_within(a, where, len(b), most), _kept(a, b, most)
        assert found >= kept if len(a) - found > most else found == kept
        assert line_dedup.within_distance(a, b, most) == (distance <= most)
    # unrelated lines are told apart before any column of the table is unfolded
    monkeypatch.setattr(line_dedup.np, "unpackbits", None)
    a, b = (" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(80)) for _ in range(2))
    assert not line_dedup.within_distance(a, b, 96)
