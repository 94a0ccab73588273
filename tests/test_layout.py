"""The layout keeps more neighbours than two components do."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabstat.operators import layout as ly
from tabstat.operators.derive import components


def clusters(spark, n=240, width=8):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 4, (12, width))
    rows = [(f"k{i}", *map(float, centres[i % 12] + rng.normal(0, 0.5, width))) for i in range(n)] + [("hole", *[None] * width)]
    return spark.createDataFrame(rows, "id string, " + ", ".join(f"d{j} double" for j in range(width))).repartition(3)


def test_weights_are_symmetric_and_sized(spark):
    df = clusters(spark, 60).na.drop()
    cols = [f"d{j}" for j in range(8)]
    rows = ly.edge_weights(df, cols, "id", 5).collect()
    w = {(r.a, r.b): r.w for r in rows}
    assert len(w) == len(rows) and all(w[b, a] == v and -1e-12 <= v <= 1 + 1e-12 for (a, b), v in w.items())
    for a in {a for a, _ in w}:
        assert max(v for (x, _), v in w.items() if x == a) == pytest.approx(1)  # the nearest neighbour


@pytest.mark.parametrize("few", [True, False])
def test_neighbours_are_kept(spark, few, monkeypatch):
    if not few:
        monkeypatch.setattr(ly, "settle", lambda table: None)  # positions by a shuffle
    df, cols = clusters(spark), [f"d{j}" for j in range(8)]
    plane = ly.neighbour_layout(df, cols, "id", k=10, epochs=20 if few else 2)
    assert plane.count() == 240 and plane.columns == ["id", "u", "v"]
    if few:
        whole = df.na.drop()
        flat, _ = components(whole, cols, 2)
        got = ly.neighbour_overlap(whole, plane, cols, ["u", "v"], "id").first()
        two = ly.neighbour_overlap(whole, flat, cols, ["pc_comp1", "pc_comp2"], "id").first()
        assert got.n == 240 and got.overlap > two.overlap
