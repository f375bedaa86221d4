"""Joins whose work must follow their tables: candidates of cells, copies that are not broadcast, shapes that travel once for each cell."""

import random

import pytest
from gridloom.functions import geometry
from gridloom.functions.predicates import valid
from gridloom.operators import grouped, join, partition
from gridloom.operators.cover import points_in_shapes
from gridloom.operators.join import matched, nearest, spatial_join, tile_join
from gridloom.operators.shapes import nearest_shapes, shape_join
from gridloom.plans import catalog
from pyspark.sql import functions as F

from .test_joins import boxes, brute, closed, near, pairs, some


def small(seed, n):
    """Squares of side 1 over 1000 x 1000."""
    r = random.Random(seed)
    return [(i, x, x + 1.0, y, y + 1.0) for i, x, y in ((i, r.random() * 1000, r.random() * 1000) for i in range(n))]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("algorithm", ["stripes_x", "stripes_y"])
def test_stripes_are_cut_along_their_axis(spark, algorithm):
    a, b = (valid(boxes(spark, small(k, 2000))) for k in (1, 2))
    # a stripe alone would compare a million
    assert matched(a, b, test=F.lit(True), algorithm=algorithm, n=4).count() < 300_000


def test_tiles_are_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(join, "predicate", lambda *_: F.lit(True))
    a, b = (boxes(spark, small(k, 2000)).withColumn("tile", F.lit(1)) for k in (1, 2))
    assert tile_join(a, b).count() < 500_000


def test_long_and_flat_objects_meet_in_long_and_flat_cells(spark):
    flat = [(i, 0.0, 1000.0, 5.0 * i, 5.0 * i + 1) for i in range(200)]
    b = small(2, 3000)
    x, y = boxes(spark, flat), boxes(spark, b)
    candidates = matched(valid(x), valid(y), test=F.lit(True), n=32).count()
    assert candidates < 100_000  # of 600,000
    assert pairs(spatial_join(x, y, n=32)) == brute(flat, b, closed)


def test_full_cells_are_dealt_in_blocks(spark):
    t = valid(boxes(spark, some(3, 100))).select("*", F.lit(0).alias("k"))
    left, right = partition.blocked(t, t.limit(10), ["k"], held=20)
    sizes = [r["n"] for r in left.groupBy("block_a", "block_b").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 100 and len(sizes) == 5 and max(sizes) < 50 and right.count() == 50


@pytest.mark.parametrize("options", [{}, {"predicate_name": "distance", "distance": 7.0}, {"algorithm": "stripes_x", "n": 3}])
def test_copies_are_not_broadcast(spark, options):
    joined = spatial_join(boxes(spark, some(1, 60)), boxes(spark, some(2, 90)), **options)
    assert "SortMergeJoin" in plan(joined) and joined.count() > 0


def test_prefixes_of_points_are_not_broadcast(spark):
    points = spark.createDataFrame([(1, 2.0, 2.0), (2, 9.0, 9.0)], "id long, x double, y double")
    ring = spark.createDataFrame([(7, "POLYGON((0 0, 4 0, 4 4, 0 4))")], "id long, wkt string").select("id", geometry.shape(F.col("wkt")).alias("shape"))
    found = points_in_shapes(points, ring)
    assert pairs(found) == [(1, 7)]
    text = plan(found)
    keyed = [line for line in text.splitlines() if "Join" in line and "depth" in line]
    assert keyed and all("SortMergeJoin" in line for line in keyed)


def squares(spark, rows):
    wkt = [(i, f"POLYGON(({x0} {y0}, {x1} {y0}, {x1} {y1}, {x0} {y1}))") for i, x0, x1, y0, y1 in rows]
    return spark.createDataFrame(wkt, "id long, wkt string").select("id", geometry.shape(F.col("wkt")).alias("shape"))


def test_pairs_of_shapes_are_not_shuffled_and_equal_ones_compared_once(spark, monkeypatch):
    monkeypatch.setattr(grouped, "OUT", 50)
    a = [(i, float(x), float(x + 2), 0.0, 2.0) for i, x in enumerate([0, 0, 0, 5, 5] * 8)]
    b = [(100 + i, float(x), float(x + 1), 1.0, 3.0) for i, x in enumerate([1, 1, 6, 9] * 10)]
    found = shape_join(squares(spark, a), squares(spark, b))
    assert pairs(found) == brute(a, b, closed)
    assert "FlatMapGroupsInArrow" in plan(found) and "id_a" not in "".join(line for line in plan(found).splitlines() if "Exchange" in line)


@pytest.mark.parametrize("held", [3, 1000])
def test_grouped_predicates_agree_with_pairs_of_rows(spark, held, monkeypatch):
    monkeypatch.setattr(grouped, "AT_ONCE", 40)
    a, b = some(5, 40, most=30), some(6, 50, most=30)
    a, b = ([r for r in t if r[1] < r[2] and r[3] < r[4]] for t in (a, b))
    x, y = squares(spark, a), squares(spark, b)
    for name in ("intersects", "contains", "within", "overlaps"):
        assert pairs(shape_join(x, y, predicate_name=name)) == pairs(shape_join(x, y, predicate_name=name, algorithm="nested"))
    p, q = (valid(boxes(spark, t)) for t in (a, b))
    found = grouped.grouped_join(p, q, name="boxes", by=7.0, per_group=5, held=held)
    assert pairs(found) == brute(a, b, near)


def test_nearest_gives_a_row_for_each_object_and_cell(spark):
    a, b = some(7, 80, most=4), [*some(8, 60, most=4), *((i + 100, *r[1:]) for i, r in enumerate(some(8, 60, most=4)))]
    x, y = boxes(spark, a), boxes(spark, b)
    assert pairs(nearest(x, y, 7.0)) == pairs(nearest(x, y, 7.0, algorithm="nested"))
    assert "FlatMapGroupsInArrow" in plan(nearest(x, y, 7.0))
    p, q = (squares(spark, [r for r in t if r[1] < r[2] and r[3] < r[4]]) for t in (a, b))
    assert pairs(nearest_shapes(p, q, 7.0)) == pairs(nearest_shapes(p, q, 7.0, algorithm="nested"))


def test_semi_and_anti_stop_at_the_first_match(spark):
    a, b = some(9, 80), some(10, 40)
    x, y = boxes(spark, a), boxes(spark, b)
    hit = {i for i, _ in brute(a, b, closed)}
    semi = spatial_join(x, y, how="semi")
    assert pairs(semi) == sorted((i,) for i in hit)
    assert pairs(spatial_join(x, y, how="anti")) == sorted((r[0],) for r in a if r[0] not in hit)
    assert "SortMergeJoin" in plan(semi) and "Inner" not in "".join(line for line in plan(semi).splitlines() if "low0" in line and "Join" in line)


def test_counts_in_sql_compare_equal_rectangles_once(spark):
    a, b = some(11, 40) * 3, some(12, 50) * 2
    counted = catalog.count_join(boxes(spark, [*a, (1, None, 1.0, 0.0, 1.0)]), boxes(spark, b))
    assert counted.collect()[0]["n"] == len(brute(a, b, closed))
    assert "NestedLoop" not in plan(counted) and "Cartesian" not in plan(counted)
    assert catalog.count_join(boxes(spark, []), boxes(spark, b)).collect()[0]["n"] == 0


def test_swept_ranges_give_their_pairs_in_parts(spark):
    a, b = some(13, 60), some(14, 60)
    found = spatial_join(boxes(spark, a), boxes(spark, b), algorithm="sweep")
    assert pairs(found) == brute(a, b, closed)
    # a cogroup would have to give one table for a range
    assert "CoGroups" not in plan(found)


def test_objects_that_descend_a_tree_are_dealt_to_all_tasks(spark):
    a, b = some(15, 60), some(16, 400)
    found = spatial_join(boxes(spark, a).coalesce(1), boxes(spark, b), algorithm="inlj", node_size=4)
    assert pairs(found) == brute(a, b, closed)
    assert "RoundRobinPartitioning(4)" in plan(found)
