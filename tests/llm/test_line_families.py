"""Families of the line dedup that grow with the table: they come apart into groups of single runs, and texts are fetched by line."""

from itertools import combinations

import numpy as np
import pytest
from cases import SCHEMA, rows_of
from test_line_recall import changed_lines

from llm import line_dedup, similar

U = np.uint64


def signatures(n=400, seed=3):
    """First signatures a few bits apart from one of ten, so that many meet in several tables; equal second ones."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 10, dtype=np.uint64)[rng.integers(0, 10, n)]
    for _ in range(6):
        base ^= U(1) << rng.integers(0, 64, n, dtype=np.uint64)
    return np.unique(base)


@pytest.mark.parametrize("sent, compared", [(1_000, 20_000), (2, 20_000), (1_000, 3)])
def test_every_pair_of_candidates_is_in_a_family_of_one_run(spark, monkeypatch, sent, compared):
    monkeypatch.setattr(line_dedup, "SENT_RUN", sent)
    monkeypatch.setattr(line_dedup, "COMPARED_RUN", compared)
    sign, second = signatures(), U(1000)
    classes = spark.createDataFrame([(i, int(s), int(second)) for i, s in enumerate(sign.view(np.int64))], "id long, sign long, sign2 long").repartition(3)
    families = {}
    for row in line_dedup._candidates(classes, len(sign), 80, local=True).collect():
        families.setdefault(row.family, []).append(row.id)
    assert all(len(set(x)) == len(x) > 1 for x in families.values())
    for ids in families.values():  # all members agree in two blocks
        apart = np.bitwise_or.reduce(sign[ids] ^ sign[ids[0]])
        assert sum(int(apart & mask == 0) for mask in line_dedup._MASKS) >= 2
    together = {p for ids in families.values() for p in combinations(sorted(ids), 2)}
    wanted = {(i, j) for i in range(len(sign)) for j in range(i + 1, len(sign)) if line_dedup.candidate(sign[i] ^ sign[j], second, second, 80)[0]}
    assert wanted and wanted <= together


def test_a_large_family_is_not_sent_to_every_block(spark, monkeypatch):
    """Lines that candidates join to one long chain: the lines that are compared grow with the lines, not with lines times blocks."""
    lines, others = changed_lines(40, 1, 60)
    for _ in range(5):  # a word more is replaced each time
        lines, others = lines + others, [" ".join(f"word{len(lines)}" if k == 7 * len(lines) % 40 else w for k, w in enumerate(x.split())) for x in others]
    docs = spark.createDataFrame(rows_of(list(enumerate(lines))), SCHEMA)
    whole = sorted(tuple(r) for r in line_dedup.dedup_lines(docs).collect())
    seen, confirm = [], line_dedup.confirm

    def spied(weights, members, *rest, **more):
        size = weights.groupBy("family").sum("weight").collect()
        seen.append((members.count(), max(-(-r[1] // line_dedup.TASK_CHARS) for r in size)))
        return confirm(weights, members, *rest, **more)

    monkeypatch.setattr(line_dedup, "confirm", spied)
    monkeypatch.setattr(line_dedup, "TASK_CHARS", 400)
    monkeypatch.setattr(line_dedup, "_candidates", chained(line_dedup._candidates))
    assert sorted(tuple(r) for r in line_dedup.dedup_lines(docs).collect()) == whole
    (rows, blocks), = seen
    assert rows <= len(line_dedup.TABLES) * len(lines) and blocks <= 20  # one family of all lines has over 100 blocks


def chained(candidates):
    """The search, and edges that join all lines as chance candidates do in a large table."""
    def run(classes, lines, percent, local=False):
        found = candidates(classes, lines, percent, local)
        if local:
            return found
        ids = sorted(r.id for r in classes.select("id").collect())
        return found.unionByName(classes.sparkSession.createDataFrame(list(zip(ids[:-1], ids[1:])), "a long, b long")).distinct()
    return run


def test_members_of_several_families_join_their_groups(spark):
    rows = [(1, 10, "x"), (2, 10, "x"), (2, 11, "x"), (3, 11, "x"), (4, 12, "y"), (5, 12, "z")]
    members = similar.stored(spark.createDataFrame(rows, "id long, family long, line string"))

    def links(table, cut=None):
        text = table["line"].to_pylist()
        i, j = np.array([(i, j) for i in range(len(text)) for j in range(i) if text[i] == text[j]], int).reshape(-1, 2).T
        return i, j

    for limit in (1, 100):
        weights = members.selectExpr("id", "family", "1L AS weight")
        groups = {r.id: r.label for r in similar.confirm(weights, members, ["line"], links, limit, across=limit > 1, several=True).collect()}
        assert {groups[1], groups[2], groups[3]} == {1} and groups.get(4, 4) != groups.get(5, 5)


@pytest.mark.parametrize("most", [28, 15])
def test_bitmap_of_wanted_lines(spark, monkeypatch, most):
    """Every wanted line has its bit, whatever the size; others seldom have one."""
    monkeypatch.setattr(line_dedup, "MOST_BITS", most)
    rng = np.random.default_rng(5)
    marks, numbers = rng.integers(-1 << 62, 1 << 62, 3000), rng.integers(0, 5000, 3000).astype(np.int32)
    members = spark.createDataFrame([(int(m), int(k)) for m, k in zip(marks, numbers)], "mark long, line_no int")
    bits = line_dedup._bitmap(members)
    assert line_dedup._in_bitmap(bits, marks, numbers).all()
    others = line_dedup._in_bitmap(bits, rng.integers(-1 << 62, 1 << 62, 3000), numbers)
    assert others.mean() < (0.1 if most == 28 else 0.2)


def test_packed_columns_come_back():
    rng = np.random.default_rng(1)
    columns = rng.integers(0, 1 << 63, (3, 50), dtype=np.uint64)
    back = line_dedup._opened([line_dedup._packed(*columns[:, :20]), line_dedup._packed(*columns[:, 20:])], 3)
    assert (np.array(back) == columns).all()
