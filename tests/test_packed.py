"""Packed trees in arrays, and the join that builds them in heavy cells."""

import random

import numpy as np
import pytest
from gridloom.functions.predicates import distance_squared, intersects, valid
from gridloom.operators import packed, partition
from gridloom.operators.join import spatial_join
from pyspark.sql import functions as F
from tests.test_joins import boxes, brute, closed, near, opened, pairs, some


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 16, 17, 64, 65, 400])
@pytest.mark.parametrize("fan", [2, 4, 16])
def test_probes_find_all_pairs_in_parts(n, fan):
    rows, others = some(n, n, 9), some(n + 1, 70, 30) + [(0, -9.0, 200.0, -9.0, 200.0)]
    flat = lambda t: np.array([r[1:] for r in t], float).reshape(-1, 4).T
    tree = packed.packed(flat(rows), fan)
    assert sorted(tree.order) == list(range(n)) and (not n or tree.levels[-1].shape[1] == 1)
    parts = list(packed.probed(tree, flat(others), fan=fan, step=7))
    assert all(0 < len(i) == len(j) <= 7 for i, j in parts)
    assert sorted((others[x][0], rows[y][0]) for i, j in parts for x, y in zip(i, j, strict=True)) == brute(others, rows, closed)


def test_a_probe_looks_at_few_nodes(monkeypatch):
    r = np.random.default_rng(1)
    low = r.uniform(0, 1000, (2, 20_000))
    all_boxes = np.stack([low[0], low[0] + 1, low[1], low[1] + 1])
    tree, seen = packed.packed(all_boxes), []
    plain = packed._meeting
    monkeypatch.setattr(packed, "_meeting", lambda nodes, boxes, i, k: seen.append(len(i)) or plain(nodes, boxes, i, k))
    found = sum(len(i) for i, _ in packed.probed(tree, all_boxes[:, :1000]))
    assert found >= 1000 and sum(seen) < 0.01 * 1000 * 20_000


def crowd(seed, n):
    """Half of the objects lie in a corner, some on each other, one covers the map."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = (r.choice([r.uniform(0, 4), r.uniform(0, 100)]) for _ in "xy")
        rows.append((i, x, x + r.choice([0.0, 0.5]), y, y + 0.5) if i % 5 else (i, 1.0, 2.0, 1.0, 2.0))
    return [*rows, (n, 0.0, 100.0, 0.0, 100.0), rows[1]]


@pytest.mark.parametrize(("compared", "held"), [(50, 10_000), (50, 15), (10**9, 10_000)])
def test_heavy_cells_give_the_rows_of_brute_force(spark, compared, held):
    a, b = crowd(1, 150), crowd(2, 200)
    x, y = valid(boxes(spark, a)), valid(boxes(spark, b))
    grid = partition.sized_grid(x, y, n0=4, n1=4, extent=(0.0, 100.0, 0.0, 100.0) if held > 15 else (2.0, 3.0, 2.0, 3.0))
    assert pairs(packed.packed_join(x, y, grid, intersects("open"), compared=compared, held=held).select("id_a", "id_b")) == brute(a, b, opened)
    assert pairs(packed.packed_join(x, y, grid, distance_squared() <= 49.0, 7.0, compared=compared, held=held).select("id_a", "id_b")) == brute(a, b, near)


def test_groups_are_bounded_where_objects_lie_on_each_other(spark, monkeypatch):
    a, b = [(i, 1.0, 2.0, 1.0, 2.0) for i in range(90)], [(i, 2.0, 3.0, 2.0, 3.0) for i in range(70)] + crowd(3, 60)
    x, y = valid(boxes(spark, a)), valid(boxes(spark, b))
    sizes = []
    plain = packed._through_trees

    def measured(left, right, by):
        for t in (left, right):
            sizes.extend(r["n"] for r in t.groupBy(*packed.CELL, *packed.TILE, "block_a", "block_b").agg(F.count("*").alias("n")).collect())
        return plain(left, right, by)

    monkeypatch.setattr(packed, "_through_trees", measured)
    grid = partition.sized_grid(x, y, n0=1, n1=1)
    assert pairs(packed.packed_join(x, y, grid, intersects(), compared=10, held=20).select("id_a", "id_b")) == brute(a, b, closed)
    assert len(sizes) > 10 and max(sizes) <= 40  # blocks are dealt by hash: about `held` of each side


def test_light_tables_need_no_tree(spark):
    a, b = some(1, 60), some(2, 90)
    plan = spatial_join(boxes(spark, a), boxes(spark, b), algorithm="packed")
    assert pairs(plan) == brute(a, b, closed)
    assert "Arrow" not in plan._jdf.queryExecution().executedPlan().toString()


def test_equal_boxes_are_one_row_of_a_tree(spark):
    flat = np.array([[1, 0, 1, 1], [2, 5, 2, 2], [0, 0, 0, 0], [1, 1, 1, 2]], float)
    order, starts = packed._equal(flat)
    assert sorted(np.diff(starts).tolist()) == [1, 1, 2] and packed._lists(np.array([7, 8, 9, 10])[order], starts, np.array([2, 0])).flatten().to_pylist() != []
    assert {frozenset(x) for x in packed._lists(np.array([7, 8, 9, 10])[order], starts, np.arange(3)).to_pylist()} == {frozenset({7, 9}), frozenset({8}), frozenset({10})}
    a, b = ([(20 * i + k, float(i), i + 1.5, 0.0, 1.0) for i in range(4) for k in range(n)] for n in (12, 15))
    x, y = valid(boxes(spark, a)), valid(boxes(spark, b))
    found = packed.packed_join(x, y, partition.sized_grid(x, y, n0=1, n1=1), intersects() & (F.col("id_a") != F.col("id_b")), compared=10)
    assert pairs(found.select("id_a", "id_b")) == [p for p in brute(a, b, closed) if p[0] != p[1]]
    assert "Generate explode(id_a" in found._jdf.queryExecution().optimizedPlan().toString()
