"""Quadtree covers, and points in polygons by them, against lattice sets."""

import random

import pytest
from gridloom.operators import shapes as exact
from gridloom.operators.cover import cover, points_in_shapes
from pyspark.sql import functions as F
from tests.test_joins import pairs
from tests.test_shapes import shapes, some_cells, text, where

POINTS = "id long, x double, y double, row string, depth int"


@pytest.mark.parametrize(("turned", "seed"), [(False, 4), (True, 5)])
def test_points_in_lattice_polygons(spark, turned, seed):
    r = random.Random(seed)
    made = [some_cells(r) for _ in range(60)]
    polygons = shapes(spark, [*((i, text(s[0], s[2], turned, r)) for i, s in enumerate(made)), (100, None), (101, "LINESTRING(0 0, 5 5)"), (102, "POINT(1 1)")])
    at = lambda x, y: (3.0 * x + 2 * y, 7.0 * y - x) if turned else (float(x), float(y))
    corners = [(x, y) for x in range(-1, 7) for y in range(-1, 7)]
    middles = [(x + 0.5, y + 0.25) for x, y in corners]
    rows = [(i, *at(*c), "x", 1) for i, c in enumerate([*corners, *middles])] + [(900, None, 1.0, "x", 1), (901, float("nan"), 1.0, "x", 1), (902, 1.0, float("inf"), "x", 1), (9, *at(*corners[9]), "again", 1)]
    points = spark.createDataFrame(rows, POINTS)
    want = {"closed": [], "open": []}
    for i, c in [*enumerate(corners), (9, corners[9])]:
        for j, s in enumerate(made):
            found = where(c, s)
            want["open"] += [(i, j)] * (found == "inside")
            want["closed"] += [(i, j)] * (found != "outside")
    for i, c in enumerate(corners):
        both = [(len(corners) + i, j) for j, s in enumerate(made) if c in s[1]]
        want["open"] += both
        want["closed"] += both
    for boundary, rows in want.items():
        assert pairs(points_in_shapes(points, polygons, boundary=boundary)) == sorted(rows), boundary
    assert pairs(points_in_shapes(points.limit(0), polygons)) == [] and pairs(points_in_shapes(points, polygons.limit(0))) == []
    with pytest.raises(ValueError, match="boundary"):
        points_in_shapes(points, polygons, boundary="half")


def test_cells_are_disjoint_and_cover_the_polygon(spark):
    ring = "POLYGON((1 1, 99 3, 97 98, 2 95, 1 1), (40 40, 41 70, 60 60, 40 40))"
    held = exact.prepared(shapes(spark, [(1, ring), (2, "POLYGON((-7.25 -3, -7 -3, -7 -2.75, -7.25 -3))"), (3, "POLYGON((0 0, 0 0, 0 0))")]))
    number = {r["row"]: r["id"] for r in held.collect()}
    cells = [(number[r["row"]], r["depth"], r["cx"], r["cy"], r["inner"]) for r in cover(held).collect()]
    area = lambda i, kinds: sum(4.0 ** -d for j, d, _, _, inner in cells if i == j and inner in kinds)
    # by the corners: the shell less its hole
    assert area(1, [True]) < 9113 - 285 < area(1, [True, False]) and area(1, [True]) > 0.6 * (9113 - 285)
    assert area(2, [True]) < 0.03125 < area(2, [True, False]) and area(3, [True]) == 0
    deepest = max(d for i, d, *_ in cells if i == 1)
    small = [(cx * 2 ** (deepest - d) + x, cy * 2 ** (deepest - d) + y) for i, d, cx, cy, _ in cells if i == 1 for x in range(2 ** (deepest - d)) for y in range(2 ** (deepest - d))]
    assert len(small) == len(set(small))


def test_points_in_inner_cells_skip_the_rings(spark, monkeypatch):
    r = random.Random(1)
    points = spark.createDataFrame([(i, r.uniform(0, 100), r.uniform(0, 100), "x", 1) for i in range(3000)], POINTS)
    compared, asked = exact.compared, []

    def counted(left, right, pairs, **options):
        asked.append(pairs.count())
        return compared(left, right, pairs, **options)

    monkeypatch.setattr(exact, "compared", counted)
    got = points_in_shapes(points, shapes(spark, [(1, "POLYGON((10 10, 90 10, 90 90, 10 90))")])).count()
    assert got == points.where(F.col("x").between(10, 90) & F.col("y").between(10, 90)).count()
    # the border's cells, of side 8, alone
    within = lambda low, high: points.where((F.col("x") >= low) & (F.col("x") < high) & (F.col("y") >= low) & (F.col("y") < high)).count()
    assert asked == [within(8, 96) - within(16, 88)] and within(16, 88) > 0.75 * got
