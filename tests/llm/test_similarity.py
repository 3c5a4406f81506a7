import math

import numpy as np
import pytest
from voltlake.llm import similarity

LIKE = similarity.Likeness("g", "key", "angle", ("a", "r"))
SCHEMA = "g long, key long, angle double, a double, r double, cell string"


def alike(x, y):
    turn = abs(x[2] - y[2]) % 360
    if min(turn, 360 - turn) > 25:
        return False
    return all(max(x[i], y[i]) / min(x[i], y[i]) <= 1.4 for i in (3, 4))


def good(r):
    return all(v is not None and math.isfinite(v) for v in r[2:5]) and r[3] > 0 and r[4] > 0


def brute(rows, least):
    rows = [r for r in rows if good(r)]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, x in enumerate(rows):
        for j in range(i):
            if x[0] == rows[j][0] and alike(x, rows[j]):
                parent[root(i)] = root(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root(i), []).append(r[1])
    return {(min(k), m) for k in groups.values() if len(k) >= least for m in k}


def make(seed, spread, n=260):
    rng = np.random.default_rng(seed)
    rows = []
    for key in range(n):
        g = int(rng.integers(2))
        centre = rng.integers(4)
        rows.append(
            (g, key, float((centre * 90 + rng.normal(0, 20 * spread)) % 360), float(np.exp(rng.normal(centre * 0.6, 0.3 * spread))), float(np.exp(rng.normal(0, 0.4 * spread))), "x")
        )
    rows += [(0, 1000 + i, 5.0, 2.0, 3.0, "copy") for i in range(12)]
    rows += [(0, 2000, None, 1.0, 1.0, "x"), (0, 2001, 1.0, math.nan, 1.0, "x"), (0, 2002, 1.0, 0.0, 1.0, "x"), (1, 2003, 1.0, 1.0, math.inf, "x")]
    return rows


def grid_of(spark, rows):
    return similarity.on_grid(spark.createDataFrame(rows, SCHEMA), LIKE)


@pytest.mark.parametrize(("seed", "spread"), [(1, 1.0), (2, 2.0), (5, 3.0)])
def test_connected_groups_against_all_pairs(spark, seed, spread):
    rows = make(seed, spread)
    got = {tuple(r) for r in similarity.connected_groups(grid_of(spark, rows), 5).collect()}
    assert got == brute(rows, 5)


def cells_by_rows(grid, rows):
    cells = {}
    for r in grid.points.collect():
        cells.setdefault(r["cell"], []).append(rows[r["_key"]])
    return cells


@pytest.mark.parametrize(("seed", "spread"), [(3, 1.5), (4, 1.0)])
def test_links_are_all_alike_pairs_of_cells(spark, seed, spread):
    rows = {r[1]: r for r in make(seed, spread)}
    grid = grid_of(spark, list(rows.values()))
    cells = cells_by_rows(grid, rows)
    for members in cells.values():
        assert all(alike(x, y) for x in members for y in members)
    placed = [(c, r) for c, rs in cells.items() for r in rs]
    want = {frozenset((a, b)) for a, x in placed for b, y in placed if a != b and x[0] == y[0] and alike(x, y)}
    got = [frozenset((r["u"], r["v"])) for r in similarity.all_links(grid).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want


@pytest.mark.parametrize(("seed", "spread"), [(3, 1.5), (6, 0.7)])
def test_pivots_are_apart_and_members_alike_to_them(spark, seed, spread):
    rows = {r[1]: r for r in make(seed, spread)}
    grid = grid_of(spark, list(rows.values()))
    links = similarity.all_links(grid)
    linked = {frozenset((r["u"], r["v"])) for r in links.collect()}
    hashes = {r["cell"]: (r["hash"], r["cell"]) for r in grid.cells.collect()}
    absorbed = {r["cell"]: r["pivot"] for r in similarity.pivot_clusters(grid.cells, links).collect()}
    assert set(absorbed) == set(hashes)
    pivots = set(absorbed.values())
    assert not any(frozenset((a, b)) in linked for a in pivots for b in pivots if a != b)
    # the greedy walk in the order of the hashes gives the same pivots
    taken, want = set(), set()
    for cell in sorted(hashes, key=hashes.get):
        if cell not in taken:
            want.add(cell)
            taken |= {cell} | {c for c in hashes if frozenset((c, cell)) in linked}
    assert pivots == want
    mark = {r["cell"]: rows[k] for r in grid.cells.collect() for k in rows if abs(rows[k][2] or 0) == abs(r["p0"]) and rows[k][3] == r["p1"] and rows[k][4] == r["p2"]}

    def far(x, y):
        turn = abs(x[2] - y[2]) % 360
        return math.sqrt((min(turn, 360 - turn) / 25) ** 2 + sum((math.log(x[i] / y[i]) / math.log(1.4)) ** 2 for i in (3, 4)))

    members = similarity.pivot_members(grid, links).collect()
    assert sorted(m["_key"] for m in members) == sorted(k for k, r in rows.items() if good(r))
    for m in members:
        options = [p for p in pivots if p == m["cell"] or frozenset((p, m["cell"])) in linked]
        assert m["pivot"] in options
        assert far(rows[m["_key"]], mark[m["pivot"]]) <= min(far(rows[m["_key"]], mark[p]) for p in options) + 1e-6


def test_clusters_are_described(spark):
    rows = [(1, i, 10.0 + i % 3, 1.0 + 0.01 * (i % 5), 2.0, "x") for i in range(30)]
    grid = grid_of(spark, rows)
    facts = similarity.described(grid, similarity.pivot_members(grid, similarity.all_links(grid))).collect()
    assert sum(r["size"] for r in facts) == 30
    big = max(facts, key=lambda r: r["size"])
    assert big["a"] == pytest.approx(1.02, rel=0.02)
    assert len(big["typical"]) == 3


def test_chain_longer_than_a_round(spark):
    rows = [(1, i, 0.0, 1.35**i, 1.0, "x") for i in range(40)]
    assert {tuple(r) for r in similarity.connected_groups(grid_of(spark, rows)).collect()} == {(0, i) for i in range(40)}


def test_empty(spark):
    grid = grid_of(spark, [])
    assert similarity.connected_groups(grid).count() == 0
    assert similarity.described(grid, similarity.pivot_members(grid, similarity.all_links(grid))).count() == 0


def test_components_of_a_path_and_a_ring(spark):
    path = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100)]
    labels = {r["node"]: r["label"] for r in similarity.components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert {labels[i] for i in range(61)} == {0}
    assert {labels[i] for i in (100, 101, 102)} == {100}
