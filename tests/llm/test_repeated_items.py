"""Item rows that share a key but differ in text."""

import pytest

from llm.decontamination import contained


@pytest.mark.parametrize("limit", [2_000_000, -1])
def test_two_texts_under_one_item(spark, limit):
    a, b = (" ".join(f"{x}{k}" for k in range(n)) for x, n in (("a", 20), ("b", 30)))
    items = spark.createDataFrame([(7, a), (7, b), (7, a), (8, "other words of an item"), (None, b)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {a} y"), (2, f"x {b} y"), (3, f"{a} z {b}"), (4, "none"), (5, None)], "doc_id long, text string")
    got = sorted(map(tuple, contained(docs, items, broadcast_limit=limit).collect()))
    assert got == [(1, 7, 16, 16), (2, 7, 26, 26), (3, 7, 26, 26)]
