import random

import numpy as np
import pytest

import echofold.llm.components as m
from echofold.llm.components import connected_groups, grouped, local_components


def brute(vertices, edges):
    parent = {v: v for v in vertices}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in parent}


@pytest.mark.parametrize("seed", range(3))
def test_local(seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)]
    v, root = local_components(np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    assert dict(zip(v.tolist(), root.tolist(), strict=True)) == brute([], edges)


@pytest.mark.parametrize("cell", [5, 40, 10_000])
def test_grid_equals_union_find(spark, cell):
    rng = random.Random(cell)
    edges = [(i, i + 1) for i in range(0, 60)] + [(500, rng.randint(500, 700)) for _ in range(80)] + [(rng.randint(1000, 1400), rng.randint(1000, 1400)) for _ in range(150)]
    edges += [(b, a) for a, b in edges[:30]] + edges[:10]
    rng.shuffle(edges)
    df = spark.createDataFrame([(a, b, 0.5) for a, b in edges], "a long, b long, label double")
    got = {r.v: r.label for r in connected_groups(df, cell_edges=cell).collect()}
    want = {v: g for v, g in brute([], edges).items() if any((a == v) != (b == v) for a, b in edges)}
    assert got == want


def test_members_nulls_selfpairs(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (None, 4), (5, None), (2, 7), (None, None)], "a long, b long")
    members = spark.createDataFrame([(1, "x"), (1, "x"), (4, "y"), (None, "z"), (9, None)], "func long, a string")
    got = {r.func: r.group_id for r in grouped(members, pairs, vertex="func").collect()}
    assert got == {1: 1, 2: 1, 7: 1, 3: 3, 4: 4, 9: 9}


def test_empty(spark):
    pairs, members = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "func long")
    assert grouped(members, pairs, vertex="func").collect() == []
    assert m.connected_groups(pairs).columns == ["v", "label"]


def test_grid_grows_with_edges():
    assert m.grid(100, 8, 1_000_000, 10_000) == (1, 1) and m.grid(60_000, 8, 1_000_000, 10_000) == (3, 6)
    for edges in (10**7, 10**9, 10**11, 10**13):
        side, tasks = m.grid(edges, 400, 1_000_000, 10_000)
        assert edges / 3 / side <= 1_000_000 and edges / tasks <= 1_000_000


def test_a_hub_and_a_path_over_many_cells(spark):
    edges = [(i, i + 1) for i in range(40)] + [(5000, 5001 + i) for i in range(40)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.v: r.label for r in connected_groups(df, cell_edges=10, least_edges=1).collect()}
    assert got == brute([], edges)
