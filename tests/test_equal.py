"""Equal objects are merged before they are joined: what is dealt to cells follows the distinct ones."""

import pyarrow as pa
import pytest
from gridloom.operators import equal, grouped, join, shapes
from gridloom.operators.cover import points_in_shapes
from gridloom.operators.join import spatial_join
from gridloom.operators.shapes import nearest_shapes, shape_join
from pyspark.sql import functions as F

from .test_growth import squares
from .test_joins import boxes, brute, closed, near, pairs, some


def counted(monkeypatch, module, name, counts):
    """The rows of both tables that a join gets."""
    whole = getattr(module, name)

    def join(a, b, *args, **options):
        counts.extend((a.count(), b.count()))
        return whole(a, b, *args, **options)

    monkeypatch.setattr(module, name, join)


A = [(i, float(x), float(x + 2), 0.0, 2.0) for i, x in enumerate([0, 0, 0, 5, 5] * 8)]
B = [(100 + i, float(x), float(x + 1), 1.0, 3.0) for i, x in enumerate([1, 1, 6, 9] * 10)]


@pytest.mark.parametrize("text", [False, True])
@pytest.mark.parametrize(("name", "by", "test"), [("distance", 7.0, near), ("intersects", None, closed)])
def test_equal_shapes_are_joined_as_one(spark, monkeypatch, text, name, by, test):
    def made(rows):
        wkt = [(i, f"POLYGON(({x0} {y0}, {x1} {y0}, {x1} {y1}, {x0} {y1}))") for i, x0, x1, y0, y1 in rows]
        return spark.createDataFrame([*wkt, (-1, None), (-2, "EMPTY")], "id long, wkt string") if text else squares(spark, rows)

    counts = []
    counted(monkeypatch, shapes, "grouped_join", counts)
    assert pairs(shape_join(made(A), made(B), predicate_name=name, distance=by)) == brute(A, B, test)
    assert counts == [2, 3]
    if text:
        assert pairs(shape_join(made(A), made(B), predicate_name=name, distance=by, algorithm="nested")) == brute(A, B, test)


def test_nearest_of_equal_shapes(spark, monkeypatch):
    counts = []
    counted(monkeypatch, shapes, "grouped_join", counts)
    x, y = squares(spark, A), squares(spark, B)
    again = x.unionByName(squares(spark, [(0, 9.0, 10.0, 1.0, 2.0)]))  # an id of two shapes
    for a, b in ((x, y), (again, y), (x, y.withColumn("id", F.when(F.col("id") != 101, F.col("id"))))):
        assert sorted(pairs(nearest_shapes(a, b, 4.0)), key=str) == sorted(pairs(nearest_shapes(a, b, 4.0, algorithm="nested")), key=str)
    assert counts == [2, 3, 3, 3, 2, 3]


def test_parts_and_lists_are_bounded():
    rows = [(i, float(i % 3), 1.0) for i in range(100)] + [(None, 0.0, 1.0)]
    batches = pa.Table.from_pylist([dict(zip(("id", "x", "y"), r, strict=True)) for r in rows], schema=pa.schema([("id", pa.int64()), ("x", pa.float64()), ("y", pa.float64())])).to_batches(max_chunksize=10)
    found = [r for b in equal.merger(equal.equal_numbers, 20, 4)(iter(batches)) for r in b.to_pylist()]
    assert max(len(r["ids"]) for r in found) == 4 and len(found) < 60
    assert sorted(((i, r["x"], r["y"]) for r in found for i in r["ids"]), key=str) == sorted(rows, key=str)


def test_long_lists_of_ids_meet_in_pieces(monkeypatch):
    monkeypatch.setattr(grouped, "LISTED", 3)
    monkeypatch.setattr(grouped, "OUT", 20)
    sides = []
    for n, k in ((40, 2), (25, 3)):
        table = pa.table({"id": list(range(k)), "ids": [[i for i in range(n) if i % k == m] for m in range(k)], **{c: [float(m) for m in range(k)] for c in ("low0", "high0", "low1", "high1")}, "_own": [0] * k, "begins0": [True] * k, "begins1": [True] * k})
        sides.append(grouped.objects(table))
    i, j = pa.array([0, 1, 1]).to_numpy(), pa.array([2, 0, 1]).to_numpy()
    batches = list(grouped._multiplied(*sides, i, j))
    assert all(max(b.column(c).value_lengths().to_pylist()) <= 3 for b in batches for c in ("ids_a", "ids_b"))
    got = sorted((x, y) for b in batches for r in b.to_pylist() for x in r["ids_a"] for y in r["ids_b"])
    assert got == sorted((x, y) for m, o in zip(i, j, strict=True) for x in range(40) if x % 2 == m for y in range(25) if y % 3 == o)


@pytest.mark.parametrize("boundary", ["closed", "open"])
def test_equal_points_and_polygons_are_compared_once(spark, monkeypatch, boundary):
    asked, whole = [], shapes.compared

    def compared(left, right, near, **options):
        asked.append(near.count())
        return whole(left, right, near, **options)

    monkeypatch.setattr(shapes, "compared", compared)
    spots = [(i, float(i % 4), 1.0) for i in range(40)] + [(None, 1.0, 1.0)]
    ring = squares(spark, [(i, 0.0, 2.0, 0.0, 2.0) for i in range(30)])
    inside = lambda x: 0 <= x <= 2 if boundary == "closed" else 0 < x < 2
    found = pairs(points_in_shapes(spark.createDataFrame(spots, "id long, x double, y double"), ring, boundary=boundary).na.fill(-1))
    assert found == sorted((-1 if i is None else i, j) for i, x, _ in spots if inside(x) for j in range(30))
    assert asked[0] <= 4


@pytest.mark.parametrize("name", ["intersects", "distance"])
def test_equal_rectangles_of_unlike_extents_are_joined_as_one(spark, monkeypatch, name):
    distinct, whole = [], join.leveled

    def leveled(x, y, *rest):
        distinct.append((x.count(), y.count()))
        return whole(x, y, *rest)

    monkeypatch.setattr(join, "leveled", leveled)
    a = [(i, 0.0, 900.0, 5.0 * (i % 2), 5.0 * (i % 2) + 1) for i in range(20)] + [(100 + i, *r[1:]) for k in range(3) for i, r in enumerate(some(3, 40))]
    b = [(i, *r[1:]) for k in range(4) for i, r in enumerate(some(4, 50))]
    x, y = boxes(spark, [*a, (7, None, 1.0, 0.0, 1.0)]), boxes(spark, b)
    options = {"predicate_name": name, "distance": 7.0, "n": 32}
    test = closed if name == "intersects" else near
    assert pairs(spatial_join(x, y, **options)) == brute(a, b, test)
    assert pairs(spatial_join(x, y, exclude_self=True, **options)) == [(i, j) for i, j in brute(a, b, test) if i != j]
    assert distinct == [(len({r[1:] for r in a}), len({r[1:] for r in b}))] * 2
