"""Tiles of bounded counts, full ranges of the sweep, and medians of tied values."""

import random
import statistics

import pytest
from gridloom.functions.predicates import intersects, valid
from gridloom.operators import join, partition
from gridloom.operators.join import spatial_join, swept, tiled
from pyspark.sql import functions as F
from tests.test_joins import boxes, brute, closed, pairs, some


def clustered(n):
    r = random.Random(1)
    rows = [(i, *(v for c in (r.gauss(50, 0.01), r.gauss(20, 0.01)) for v in (c, c))) for i in range(n)]
    return rows + [(n + i, x, x, 7.0, 7.0) for i, x in enumerate(r.uniform(0, 100) for _ in range(n // 4))]


@pytest.mark.parametrize("method", ["sort_tile", "binary_split"])
@pytest.mark.parametrize("first", [0, 1])
def test_tiles_of_clustered_points_are_bounded_and_fill_the_plane(spark, method, first):
    rows = clustered(2000)
    df = valid(boxes(spark, rows))
    tiles = partition.directory(df, method=method, capacity=40, first=first)
    dealt = tiles.deal(df).collect()
    assert sorted(r["id"] for r in dealt) == [r[0] for r in rows]  # a point lies in one tile
    assert all(r["x0"] <= r["low0"] < r["x1"] and r["y0"] <= r["low1"] < r["y1"] for r in dealt)
    held = {}
    for r in dealt:
        held.setdefault((r["depth"], r["at"]), []).append(r)
    assert max(map(len, held.values())) <= 80 and len(held) > 40
    assert all(len({(r["x0"], r["x1"], r["y0"], r["y1"]) for r in t}) == 1 for t in held.values())
    other = some(3, 120, 30)
    got = tiled(valid(boxes(spark, other)), df, tiles, intersects()).select("id_a", "id_b")
    assert pairs(got) == brute(other, rows, closed)
    # tiles grow with the table, and a rectangle over all of it meets each once
    fewer = partition.directory(df.where("id < 500"), method=method, capacity=40, first=first)
    count = lambda t: t.deal(boxes(spark, [(1, -1e9, 1e9, -1e9, 1e9)])).select("depth", "at")
    assert count(tiles).count() == count(tiles).distinct().count() > 2 * count(fewer).count()


@pytest.mark.parametrize("method", ["sort_tile", "binary_split"])
def test_tied_centres_share_a_tile_and_others_do_not(spark, method):
    rows = [(i, 5.0, 5.0, 5.0, 5.0) for i in range(300)] + [(300 + i, 5.0 + i / 100, 5.0 + i / 100, 5.0, 5.0) for i in range(1, 60)]
    df = valid(boxes(spark, rows))
    sizes = [r["n"] for r in partition.directory(df, method=method, capacity=10).deal(df).groupBy("depth", "at").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 359 and max(sizes) < 325 and sorted(sizes)[-2] <= 20
    empty = partition.directory(df.limit(0), method=method)
    assert empty.levels == [] and empty.deal(df).select("depth", "at").distinct().count() == 1
    with pytest.raises(ValueError, match="method"):
        partition.directory(df, method="other")


def test_a_hot_stripe_is_swept_in_bounded_groups(spark):
    r = random.Random(2)
    a = [(i, x, x + 1.5, 5.0, 5.5) for i, x in enumerate(r.uniform(0, 300) for _ in range(300))] + [(900, 0.0, 300.0, 5.2, 5.3)]
    b = [(i, x, x + 1.0, 5.0, 5.4) for i, x in enumerate(r.uniform(0, 300) for _ in range(300))]
    x, y = valid(boxes(spark, a)), valid(boxes(spark, b))
    tiles = partition.directory(y, capacity=20, first=1)
    sizes = [r["n"] for r in tiles.deal(x).unionByName(tiles.deal(y)).groupBy("depth", "at").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 120 and len(sizes) > 8
    assert pairs(swept(x, y, tiles, 0.0).select("id_a", "id_b")) == brute(a, b, closed)


def test_objects_on_each_other_are_swept_in_blocks(spark, monkeypatch):
    a, b = [(i, 1.0, 2.0, 1.0, 2.0) for i in range(70)], [(i, 2.0, 3.0, 2.0, 3.0) for i in range(50)] + [(99, 50.0, 51.0, 50.0, 51.0)]
    x, y = valid(boxes(spark, a)), valid(boxes(spark, b))
    tiles = partition.directory(y, capacity=10, first=1)
    plan = swept(x, y, tiles, 0.0, most=20)
    assert pairs(plan.select("id_a", "id_b")) == brute(a, b, closed)
    monkeypatch.setattr(join, "PER_RANGE", 20)
    assert pairs(spatial_join(boxes(spark, a), boxes(spark, b), algorithm="sweep")) == brute(a, b, closed)


@pytest.mark.parametrize("tied", [0, 1, 30, 400])
def test_medians_of_tied_extents(spark, tied):
    r = random.Random(tied)
    rows = [(i, 0.0, 1.0, 0.0, 1.0) for i in range(tied)] + [(i, 0.0, r.choice([0.5, 1.0, r.uniform(0, 9)]), 2.0, 2.0 + r.randint(0, 5)) for i in range(31)]
    upper = lambda v: sorted(v)[len(v) // 2]
    assert tuple(partition.median_extent(boxes(spark, rows)).first()) == (upper([x[2] - x[1] for x in rows]), upper([x[4] - x[3] for x in rows]))
    assert upper([1.0, 2.0, 3.0]) == statistics.median_high([1.0, 2.0, 3.0])


def test_tied_extents_are_one_row_of_a_range(spark):
    rows = spark.range(5000).select("id", F.lit(0.0).alias("low0"), F.lit(1.0).alias("high0"), F.lit(0.0).alias("low1"), F.lit(2.0).alias("high1"))
    counts = rows.groupBy((F.col("high0") - F.col("low0")).alias("width")).agg(F.count("*").alias("n"))
    assert counts.count() == 1 and partition._of_rank(counts, "width", 2500).first()[0] == 1.0
    assert tuple(partition.median_extent(rows).first()) == (1.0, 2.0)
