import collections
import random
from types import SimpleNamespace

import pytest
from gridloom.functions import geometry
from gridloom.operators import index, partition
from gridloom.operators.join import ALGORITHMS, as_rects, nearest, spatial_join
from pyspark.sql import functions as F

RECT = "id long, low0 double, high0 double, low1 double, high1 double"


def boxes(spark, rows):
    return spark.createDataFrame(rows, RECT)


def some(seed, n, most=20):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y = r.randint(0, 100), r.randint(0, 100)
        out.append((i, float(x), float(x + r.randint(0, most)), float(y), float(y + r.randint(0, most))))
    return out


def brute(a, b, op):
    return sorted((p[0], q[0]) for p in a for q in b if op(p, q))


def closed(p, q):
    return p[1] <= q[2] and p[2] >= q[1] and p[3] <= q[4] and p[4] >= q[3]


def opened(p, q):
    return p[1] < q[2] and p[2] > q[1] and p[3] < q[4] and p[4] > q[3]


def near(p, q, r=7.0):
    return max(0, p[1] - q[2], q[1] - p[2]) ** 2 + max(0, p[3] - q[4], q[3] - p[4]) ** 2 <= r * r


def pairs(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("algorithm", ALGORITHMS)
def test_all_strategies_agree_with_brute_force(spark, algorithm):
    a, b = some(1, 60), some(2, 90)
    x, y = boxes(spark, a), boxes(spark, b)
    n = {"n": 5} if algorithm in ("grid", "stripes_x", "stripes_y", "sort_tile", "binary_split") else {"max_comparisons": 20, "node_size": 4}
    assert pairs(spatial_join(x, y, algorithm=algorithm, **n)) == brute(a, b, closed)
    assert pairs(spatial_join(x, y, algorithm=algorithm, boundary="open", **n)) == brute(a, b, opened)
    assert pairs(spatial_join(x, y, predicate_name="distance", distance=7.0, algorithm=algorithm, **n)) == brute(a, b, near)


@pytest.mark.parametrize("algorithm", ALGORITHMS)
def test_edges_nulls_duplicates_and_empty_tables(spark, algorithm):
    a = [(1, 0.0, 1.0, 0.0, 1.0), (2, 5.0, 6.0, 5.0, 6.0), (3, 10.0, 10.0, 10.0, 10.0), (3, 10.0, 10.0, 10.0, 10.0), (4, None, 1.0, 0.0, 1.0), (5, float("nan"), 1.0, 0.0, 1.0)]
    b = [(1, 1.0, 2.0, 1.0, 2.0), (2, 5.0, 7.0, 5.0, 7.0), (3, 9.0, 10.0, 9.0, 10.0), (9, 0.0, 10.0, 0.0, 10.0)]
    want = sorted([(1, 1), (2, 2), (3, 3), (3, 3), (1, 9), (2, 9), (3, 9), (3, 9)])
    assert pairs(spatial_join(boxes(spark, a), boxes(spark, b), algorithm=algorithm)) == want
    assert pairs(spatial_join(boxes(spark, []), boxes(spark, b), algorithm=algorithm)) == []
    assert pairs(spatial_join(boxes(spark, []), boxes(spark, []), algorithm=algorithm)) == []


def test_no_extent_in_one_dimension(spark):
    a = [(i, 3.0, 3.0, float(i), float(i + 1)) for i in range(30)]
    assert pairs(spatial_join(boxes(spark, a), boxes(spark, a))) == brute(a, a, closed)


def test_trees_of_unequal_depth(spark):
    a, b = some(3, 70), some(4, 3)
    for x, y in ((a, b), (b, a)):
        assert pairs(spatial_join(boxes(spark, x), boxes(spark, y), algorithm="rtree", node_size=3)) == brute(x, y, closed)


@pytest.mark.parametrize("n", [1, 3, 4, 15, 16, 17, 33])
def test_each_object_is_in_one_leaf(spark, n):
    rows = index.leaves(boxes(spark, some(5, n)), 4).collect()
    assert sorted(r["id"] for r in rows) == list(range(n))
    sizes = {}
    for r in rows:
        sizes[r["leaf"]] = sizes.get(r["leaf"], 0) + 1
    assert max(sizes.values()) <= 4 and set(sizes) == set(range(len(sizes)))


def test_nearest_takes_the_smallest_id_of_a_tie(spark):
    a = boxes(spark, [(1, 0.0, 0.0, 0.0, 0.0), (2, 90.0, 90.0, 0.0, 0.0)])
    b = boxes(spark, [(7, 3.0, 3.0, 0.0, 0.0), (5, 0.0, 0.0, 3.0, 3.0), (1, 4.0, 4.0, 0.0, 0.0)])
    assert pairs(nearest(a, b, 10.0)) == [(1, 5, 3.0)]


def test_semi_anti_self(spark):
    a, b = some(6, 40), some(7, 20, 5)
    hit = {x for x, _ in brute(a, b, closed)}
    assert {r[0] for r in spatial_join(boxes(spark, a), boxes(spark, b), how="semi").collect()} == hit
    assert {r[0] for r in spatial_join(boxes(spark, a), boxes(spark, b), how="anti").collect()} == set(range(40)) - hit
    assert pairs(spatial_join(boxes(spark, a), boxes(spark, a), exclude_self=True)) == [p for p in brute(a, a, closed) if p[0] != p[1]]


def test_refined_cells_keep_within_limits(spark):
    a = [(i, 1.0 + i / 1000, 1.0 + i / 1000, 1.0, 1.0) for i in range(200)]
    grid = partition.Grid(0.0, 64.0, 0.0, 64.0, 2, 2)
    cells = partition.refined_cells(boxes(spark, a), boxes(spark, a), grid, max_comparisons=100, depth=3).collect()
    assert max(r["level"] for r in cells) == 3


def test_wkt_and_rings(spark):
    rows = spark.createDataFrame([(1, "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))"), (2, "POLYGON((0 0, 1 1), (2 2, 3 3))"), (3, "POINT(1.5 -2e1)"), (4, None), (5, "POLYGON((a b))")], "id long, wkt string")
    out = {r["id"]: r for r in rows.select("id", geometry.point(F.col("wkt")).alias("p"), geometry.ring(F.col("wkt")).alias("r")).collect()}
    assert tuple(out[3]["p"]) == (1.5, -20.0) and len(out[1]["r"]) == 5
    assert [out[i]["r"] for i in (2, 3, 4, 5)] == [None] * 4
    polys = rows.select("id", geometry.ring(F.col("wkt")).alias("ring"))
    points = spark.createDataFrame([(1, 2.0, 2.0), (2, 5.0, 2.0)], "id long, x double, y double")
    assert pairs(geometry.points_in_polygons(points, polys)) == [(1, 1)]
    assert as_rects(points).count() == 2


def test_duplicates_grow_with_the_table(spark):
    from gridloom.plans import catalog

    got = [{(r["id"], r["n"]) for r in catalog.queries()["duplicate_customers"](spark, f"/root/testdata/{d}").collect()} for d in ("sf0.001", "sf0.01")]
    for d, rows in zip(("sf0.001", "sf0.01"), got, strict=True):
        count = collections.Counter(r["o_custkey"] for r in spark.read.parquet(f"/root/testdata/{d}/orders.parquet").select("o_custkey").collect())
        assert rows == {(k, n) for k, n in count.items() if n > 1}
    assert len(got[1]) > 5 * len(got[0]) > 0


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda *_: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local-cluster[2,1,512]", getConf=lambda: conf))
    with pytest.raises(ValueError, match="checkpoint"):
        partition.shared_folder(cluster)
