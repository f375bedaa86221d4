"""Exact polygon tests, saved and random trees, levels of large objects, the sweep, writers and fixtures."""

import math
import random

import numpy as np
from gridloom.functions import geometry
from gridloom.operators import index, partition
from gridloom.operators.shapes import relations
from gridloom.operators.join import matched, spatial_join, tile_join
from gridloom.functions.predicates import intersects, predicate, valid
from gridloom.sources import generators, readers
from pyspark.sql import functions as F
from tests.test_joins import boxes, brute, closed, pairs, some


def shapes(spark, rows):
    return spark.createDataFrame(rows, "id long, wkt string").select("id", geometry.rings(F.col("wkt")).alias("rings"))


SQUARE = "POLYGON((0 0, 10 0, 10 10, 0 10, 0 0))"
RING = "POLYGON((0 0, 10 0, 10 10, 0 10, 0 0), (3 3, 7 3, 7 7, 3 7, 3 3))"


def test_polygons_with_holes_and_parts(spark):
    a = shapes(spark, [(1, SQUARE), (2, RING), (3, "MULTIPOLYGON(((0 0, 2 0, 2 2, 0 2, 0 0)), ((20 20, 22 20, 22 22, 20 22, 20 20)))"), (4, None), (5, "POINT(1 1)")])
    b = shapes(spark, [(1, "POLYGON((4 4, 6 4, 6 6, 4 6, 4 4))"), (2, "POLYGON((1 1, 2 1, 2 2, 1 2, 1 1))"), (3, "POLYGON((10 5, 15 5, 15 6, 10 6, 10 5))"), (4, "POLYGON((21 21, 30 21, 30 30, 21 21))"), (5, "POLYGON((2 2, 8 2, 8 8, 2 8, 2 2))")])
    got = {n: set(pairs(geometry.polygon_join(a, b, predicate_name=n))) for n in ("intersects", "contains", "within")}
    assert got["intersects"] == {(1, 1), (1, 2), (1, 3), (1, 5), (2, 2), (2, 3), (2, 5), (3, 2), (3, 4), (3, 5)}
    assert got["contains"] == {(1, 1), (1, 2), (1, 5), (2, 2), (3, 2)} and got["within"] == set()
    assert set(pairs(geometry.polygon_join(b, a, predicate_name="within"))) == {(y, x) for x, y in got["contains"]}
    near = set(pairs(geometry.polygon_join(a, b, predicate_name="distance", distance=1.0)))
    assert near == got["intersects"] | {(2, 1)}
    assert pairs(geometry.polygon_join(a.limit(0), b)) == []


def test_distance_of_random_triangles(spark):
    rng = random.Random(4)
    tri = lambda: [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(3)]
    a, b = [tri() for _ in range(20)], [tri() for _ in range(20)]
    text = lambda t: "POLYGON((" + ", ".join(f"{x!r} {y!r}" for x, y in [*t, t[0]]) + "))"

    def points_of(t, n=60):
        for (x0, y0), (x1, y1) in zip(t, [*t[1:], t[0]], strict=True):
            for k in range(n):
                yield x0 + (x1 - x0) * k / n, y0 + (y1 - y0) * k / n

    named = lambda rows: spark.createDataFrame([(i, text(t)) for i, t in enumerate(rows)], "id long, wkt string").select("id", geometry.shape(F.col("wkt")).alias("shape"))
    far = relations(named(a), named(b), test=predicate("distance", distance=200.0), by=200.0, deep=False, distance=True)
    got = {(r["id_a"], r["id_b"]): r["distance"] for r in far.collect()}
    for i, s in enumerate(a):
        p = np.array(list(points_of(s)))
        for j, t in enumerate(b):
            q = np.array(list(points_of(t)))
            near = np.sqrt(((p[:, None] - q[None]) ** 2).sum(2)).min()
            assert got[i, j] <= near + 1e-9 and (got[i, j] == 0 or near - got[i, j] < 4.0)


def test_points_in_polygons_with_holes(spark):
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 1.0, 5.0), (3, 11.0, 5.0), (4, None, 1.0)], "id long, x double, y double")
    assert pairs(geometry.points_in_polygons(points, shapes(spark, [(7, RING), (8, SQUARE)]))) == [(1, 8), (2, 7), (2, 8)]


def test_saved_trees_and_early_stop(spark, tmp_path):
    a, b = some(1, 120), some(2, 150)
    tree = index.build(valid(boxes(spark, b)), 4)
    index.save(tree, f"{tmp_path}/t")
    loaded = index.load(spark, f"{tmp_path}/t")
    assert len(loaded.levels) == len(tree.levels) > 2
    assert pairs(index.joined(boxes(spark, a), loaded)) == brute(a, b, closed)
    other = index.build(valid(boxes(spark, a)), 4)
    assert pairs(index.joined(other, loaded, node_size=4)) == brute(a, b, closed)
    small, index.SMALL_LEVEL = index.SMALL_LEVEL, 0
    try:
        for most in (0, 10**9):
            got = index.traversed(other, loaded, intersects(), node_size=4, frontier=most).select("id_a", "id_b")
            assert pairs(got) == brute(a, b, closed)
    finally:
        index.SMALL_LEVEL = small


def test_random_trees_join_as_their_objects(spark):
    a, b = generators.random_tree(spark, 3, 4, map_edge=100.0, seed=1), generators.random_tree(spark, 2, 5, map_edge=100.0, seed=9)
    one, two = ([tuple(r) for r in t.objects.select("id", "low0", "high0", "low1", "high1").collect()] for t in (a, b))
    assert len(one) == 64 and len(two) == 25
    assert pairs(index.joined(a, b)) == brute(one, two, closed)


def test_large_objects_are_few_rows(spark):
    a = some(3, 300, 2) + [(1000, 0.0, 100.0, 0.0, 100.0), (1001, 10.0, 90.0, 50.0, 50.5)]
    b = some(4, 300, 2) + [(2000, 0.0, 100.0, 40.0, 60.0)]
    x, y = valid(boxes(spark, a)), valid(boxes(spark, b))
    assert pairs(spatial_join(x, y, n=16)) == brute(a, b, closed)
    grid = partition.sized_grid(x, y, n0=16, n1=16)
    assert grid.spread > 2
    widest = partition.assign(x.where("id = 1000"), grid, level=-grid.level_of())
    assert widest.count() <= 4 and partition.assign(x.where("id = 1000"), grid).count() == 256
    assert pairs(spatial_join(x, y, predicate_name="distance", distance=3.0, n=16)) == brute(a, b, lambda p, q: max(0, p[1] - q[2], q[1] - p[2]) ** 2 + max(0, p[3] - q[4], q[3] - p[4]) ** 2 <= 9)


def test_sweep_gives_the_same_pairs_in_both_orientations(spark):
    a, b = some(5, 200), some(6, 200)
    turned = lambda rows: [(i, y0, y1, x0, x1) for i, x0, x1, y0, y1 in rows]
    want = brute(a, b, closed)
    assert pairs(spatial_join(boxes(spark, a), boxes(spark, b), algorithm="sweep", n=4)) == want
    assert pairs(spatial_join(boxes(spark, turned(a)), boxes(spark, turned(b)), algorithm="sweep", n=4)) == want


def test_quadtree_leaves_hold_all_points(spark):
    rng = random.Random(7)
    points = [(i, rng.gauss(50, 5), rng.gauss(50, 5)) for i in range(500)] + [(i, 50.0, 50.0) for i in range(500, 560)]
    rows = partition.quadtree(spark.createDataFrame(points, "id long, x double, y double"), partition.Grid(0.0, 100.0, 0.0, 100.0, 1, 1), most=16, depth=8).collect()
    assert sum(r["n"] for r in rows) == 560 and all(r["n"] <= 16 or r["level"] == 8 for r in rows)
    assert sum(4.0 ** -r["level"] for r in rows) <= 1


def test_upper_median_and_depth(spark):
    rows = [(1, 0.0, 1.0, 0.0, 2.0), (2, 0.0, 4.0, 0.0, 8.0)]
    assert tuple(partition.median_extent(boxes(spark, rows)).first()) == (4.0, 8.0)
    assert partition.median_extent(boxes(spark, [])).count() == 0 and partition.sampled_extent(boxes(spark, [])) == (0.0, 0.0)
    assert partition.depth_for(boxes(spark, rows), partition.Grid(0.0, 64.0, 0.0, 128.0, 2, 2)) == 2


def test_binary_files_read_back(spark, tmp_path):
    rows = some(8, 25)
    readers.write_binary(boxes(spark, rows), f"file://{tmp_path}/bin", per_file=10)
    assert sorted(map(tuple, readers.rects_binary(spark, f"{tmp_path}/bin/*.bin").collect())) == rows
    assert len(list((tmp_path / "bin").glob("*.bin"))) == 3


def test_pairs_as_text(spark, tmp_path):
    readers.write_pairs(spark.createDataFrame([(1, 2), (3, 4)], "id_a long, id_b long"), f"{tmp_path}/p", files=1)
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/p").collect()) == ["1\t2", "3\t4"]


def test_tiles(spark):
    a, b = generators.tiles(spark, 5, 20, edge=20.0, seed=1), generators.tiles(spark, 5, 20, edge=20.0, seed=5)
    one, two = ([tuple(r) for r in t.collect()] for t in (a, b))
    want = sorted((p[0], p[1], q[1]) for p in one for q in two if p[0] == q[0] and closed(p[1:], q[1:]))
    assert sorted(map(tuple, tile_join(a, b).collect())) == want and len(want) > 20


def test_generators_follow_their_distributions(spark):
    one = lambda t, c: [r[0] for r in t.select(c).collect()]
    x = one(generators.uniform(spark, 4000, map_edge=100.0, edge=0.0, seed=2), "low0")
    assert 0 <= min(x) and max(x) <= 100 and abs(np.mean(x) - 50) < 2 and abs(np.var(x) - 100**2 / 12) < 60
    g = one(generators.gaussian(spark, 4000, mean=500.0, sd=50.0, map_edge=1000.0, seed=2), "low0")
    assert abs(np.mean(g) - 500) < 4 and abs(np.std(g) - 50) < 3
    e = one(generators.exponential(spark, 4000, scale=40.0, map_edge=1000.0, seed=2), "low0")
    assert abs(np.mean(e) - 40) < 3 and abs(np.median(e) - 40 * math.log(2)) < 3
    assert generators.uniform(spark, 50, seed=3).collect() == generators.uniform(spark, 50, seed=3).collect()


def test_payloads_travel_with_their_side(spark):
    a = boxes(spark, some(1, 20)).withColumn("name", F.concat(F.lit("n"), "id"))
    got = matched(valid(a, keep=("name",)), valid(boxes(spark, some(2, 20))), test=intersects(), payload_a="name")
    assert all(r["a_name"] == f"n{r['id_a']}" for r in got.collect())
