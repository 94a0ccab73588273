"""The plain silhouette of long tables: far cells by weights, near ones in pairs."""

import numpy as np
import pytest

from tabstat.operators import clustering as ks, far

SHAPES = {
    "round": lambda rng, n: rng.normal(size=(n, 2)),
    "lines": lambda rng, n: np.column_stack([rng.uniform(-1, 10, n), rng.integers(0, 5, n)]),
    "heavy": lambda rng, n: rng.standard_cauchy((n, 2)),
    "equal": lambda rng, n: np.where(rng.random((n, 1)) < 0.6, 3.0, rng.normal(size=(n, 2))),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_sums_of_far_cells_are_those_of_their_rows(shape):
    rng = np.random.default_rng(2)
    x = SHAPES[shape](rng, 6000)
    code, tree = rng.integers(0, 3, len(x)), far.grown(x[::3], 100)
    cell = tree.cell_of(x, rng.integers(-1 << 62, 1 << 62, len(x)))
    assert cell.min() >= 0 and cell.max() < tree.cells
    own = [np.flatnonzero(cell == k) for k in range(tree.cells)]
    found = [far.weights_of(x[k], code[k], 3) if len(k) else (np.zeros(2), np.zeros(2), []) for k in own]
    low, high, rows = np.array([f[0] for f in found]), np.array([f[1] for f in found]), np.array([1000 * len(k) for k in own])
    nodes = [np.concatenate([far.nodes_of(f[0], f[1], p) for f in found if f[2]]) for _, p in far.ORDERS]
    cells = far.Cells(low, high, rows, nodes, [np.concatenate([f[2][k] for f in found if f[2]]) for k in range(2)])  # as if cells had many rows
    order, some = np.array([cells.order_of(a) for a in range(tree.cells)]), 0
    assert (order == order.T).all()
    for a in range(tree.cells):
        if len(own[a]) and (there := (order[a] >= 0)[cell]).any():
            want = np.sqrt(((x[own[a], None] - x[None, there]) ** 2).sum(axis=2)) @ np.eye(3)[code[there]]
            assert np.abs(cells.far_sums(a, x[own[a]]) / want - 1).max() < 1e-12
            some += 1
    assert some or shape == "heavy"  # outer cells are larger than their gaps


@pytest.mark.parametrize("shape", ["lines", "equal", "heavy"])
def test_silhouette_by_cells_is_that_of_all_pairs(spark, monkeypatch, shape):
    """With repeated ids, a cluster of one row and missing values."""
    rng = np.random.default_rng(3)
    x, c = SHAPES[shape](rng, 3000), rng.choice(["a", "b", "c"], 3000)
    c[5] = "alone"
    ids = np.where(np.arange(3000) % 50 == 1, np.arange(3000) - 1, np.arange(3000))
    df = spark.createDataFrame([(int(i), str(k), float(u), float(v)) for i, k, (u, v) in zip(ids, c, x)] + [(9000, None, 1.0, 1.0), (9001, "a", None, 1.0)], "id long, c string, x double, y double")
    want = ks.silhouette_euclidean(df, ["x", "y"], "c", "id").first()
    formed = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(ks, "FAR_ROWS", 100)
    monkeypatch.setattr(ks, "CELL_ROWS", 60)
    monkeypatch.setattr(ks, "CELL_BLOCK", 500)
    plain = ks.distance_sums

    def counted(p, p_code, q, q_code, levels):
        formed.add(len(p) * len(q))
        return plain(p, p_code, q, q_code, levels)

    monkeypatch.setattr(ks, "distance_sums", counted)
    monkeypatch.setattr(far, "ORDERS", ((6.0, 9), (1.5, 17)))
    got = ks.silhouette_euclidean(df, ["x", "y"], "c", "id").first()
    assert got.n == want.n == 2940 and got.silhouette == pytest.approx(want.silhouette, abs=1e-11)
