"""Exact joins of shapes against sets of lattice cells, edges and corners, whose relations are plain set operations."""

import random
from fractions import Fraction

import numpy as np
import pytest
from gridloom.functions import geometry, relate
from gridloom.operators.shapes import nearest_shapes, shape_join
from pyspark.sql import functions as F
from tests.test_joins import pairs

NAMES = ("intersects", "contains", "within", "overlaps")


def shapes(spark, rows):
    return spark.createDataFrame(rows, "id long, wkt string").select("id", geometry.shape(F.col("wkt")).alias("shape"), F.lit(1).alias("row"), F.lit("x").alias("segs"))


def text(kind, parts, turned, r):
    """Lattice corners under a shear of integers, so that no edge but those of `turned` = False is parallel to an axis."""
    at = lambda x, y: f"{3 * x + 2 * y} {7 * y - x}" if turned else f"{x} {y}"
    path = lambda p: "(" + r.choice([", ", ","]).join(at(*c) for c in p) + ")"
    if kind == "POINT":
        return f"MULTIPOINT({', '.join(path(p) for p in parts)})" if len(parts) > 1 else f"point {path(parts[0])}"
    if kind == "LINESTRING":
        return f"MULTILINESTRING({','.join(map(path, parts))})" if len(parts) > 1 else f"LINESTRING {path(parts[0])}"
    return f"POLYGON({', '.join(map(path, parts))})"


def straightened(path, r):
    """Some of the corners within straight runs go."""
    out = [path[0]]
    for p, c, q in zip(path, path[1:], path[2:], strict=False):
        straight = (c[0] - p[0], c[1] - p[1]) == (q[0] - c[0], q[1] - c[1])
        if not straight or r.random() < 0.4:
            out.append(c)
    return [*out, path[-1]]


def some_cells(r):
    """Cells without a contact in a corner alone, with rings of their border."""
    while True:
        cells = {(r.randint(0, 4), r.randint(0, 4)) for _ in range(r.randint(1, 16))}
        if all(((x, y) in cells) + ((x - 1, y - 1) in cells) != 2 or (x - 1, y) in cells or (x, y - 1) in cells for x in range(6) for y in range(6)) and all(
            ((x - 1, y) in cells) + ((x, y - 1) in cells) != 2 or (x, y) in cells or (x - 1, y - 1) in cells for x in range(6) for y in range(6)
        ):
            break
    after = {}
    for x, y in cells:
        for (dx, dy), a, b in (((0, -1), (x, y), (x + 1, y)), ((1, 0), (x + 1, y), (x + 1, y + 1)), ((0, 1), (x + 1, y + 1), (x, y + 1)), ((-1, 0), (x, y + 1), (x, y))):
            if (x + dx, y + dy) not in cells:
                after[a] = b
    rings = []
    while after:
        ring = [next(iter(after))]
        while ring[-1] in after:
            ring.append(after.pop(ring[-1]))
        ring = straightened(ring, r)
        rings.append(ring if r.random() < 0.5 else ring[::-1])
    return ("POLYGON", frozenset(cells), rings)


def some_line(r):
    """A walk that repeats no edge; sometimes two of them."""
    edges, parts = set(), []
    for _ in range(r.choice([1, 1, 2])):
        at = (r.randint(0, 5), r.randint(0, 5))
        path = [at]
        for _ in range(r.randint(1, 8)):
            x, y = path[-1]
            ways = [c for c in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)) if 0 <= min(c) and max(c) <= 5 and frozenset((path[-1], c)) not in edges]
            if ways:
                path.append(r.choice(ways))
                edges.add(frozenset(path[-2:]))
        if len(path) > 1:
            parts.append(path)
    return ("LINESTRING", frozenset(edges), parts) if parts else some_line(r)


def some_points(r):
    corners = {(r.randint(0, 5), r.randint(0, 5)) for _ in range(r.randint(1, 3))}
    return ("POINT", frozenset(corners), [[c] for c in corners])


DIM = {"POINT": 0, "LINESTRING": 1, "POLYGON": 2}


def corners(s):
    kind, what, _ = s
    if kind == "POINT":
        return what
    return {c for e in what for c in e} if kind == "LINESTRING" else {(x + i, y + j) for x, y in what for i in (0, 1) for j in (0, 1)}


def where(piece, s):
    """Is a unit edge (two corners) or a corner inside, on the border or outside of s?"""
    kind, what, parts = s
    edge = isinstance(piece, frozenset)
    if kind == "POINT":
        return "inside" if piece in what else "outside"
    if kind == "LINESTRING":
        if edge or piece not in corners(s):
            return "inside" if piece in what else "outside"
        return "border" if sum((p[0] == piece) + (p[-1] == piece) for p in parts) % 2 else "inside"
    if edge:
        (x0, y0), (x1, y1) = sorted(piece)
        around = [(x0, y0), (x0, y0 - 1)] if y0 == y1 else [(x0, y0), (x0 - 1, y0)]
    else:
        around = [(piece[0] - i, piece[1] - j) for i in (0, 1) for j in (0, 1)]
    held = sum(c in what for c in around)
    return "inside" if held == len(around) else "border" if held else "outside"


def plain(name, a, b):
    da, db = DIM[a[0]], DIM[b[0]]
    if name == "within":
        return plain("contains", b, a)
    if name == "intersects":
        return bool(set(corners(a)) & set(corners(b)))
    if name == "overlaps":
        return da == db and bool(a[1] & b[1]) and not a[1] <= b[1] and not b[1] <= a[1]
    if da < db:
        return False
    if da == db == 2:
        return b[1] <= a[1]
    found = {where(piece, a) for piece in b[1]}
    return "outside" not in found and "inside" in found


@pytest.mark.parametrize(("turned", "seed"), [(False, 1), (True, 2)])
def test_mixed_shapes_relate_as_their_lattice_sets(spark, turned, seed):
    r = random.Random(seed)
    made = [[r.choice([some_cells, some_cells, some_line, some_points])(r) for _ in range(90)] for _ in range(2)]
    left, right = (shapes(spark, [(i, text(s[0], s[2], turned, r)) for i, s in enumerate(side)]) for side in made)
    for name in NAMES:
        want = [(i, j) for i, a in enumerate(made[0]) for j, b in enumerate(made[1]) if plain(name, a, b)]
        assert pairs(shape_join(left, right, predicate_name=name)) == want, name
        kinds = {(made[0][i][0], made[1][j][0]) for i, j in want}
        assert len(kinds) >= {"intersects": 9, "contains": 5, "within": 5, "overlaps": 2}[name], kinds


def test_a_strip_over_a_hole_is_not_contained(spark):
    square = "POLYGON((0 0, 20 0, 20 20, 0 20, 0 0), (2 10, 4 10, 4 11, 2 11, 2 10))"
    a = shapes(spark, [(1, square), (2, "POLYGON((0 0, 20 0, 20 20, 0 20, 0 0))"), (3, "POLYGON((2 10, 4 10, 4 11, 2 11, 2 10))")])
    b = shapes(spark, [(1, "POLYGON((1 10, 15 10, 15 11, 1 11, 1 10))"), (2, "POLYGON((2 10, 4 10, 4 11, 2 11, 2 10))"), (3, square), (4, "POLYGON((4 10, 5 10, 5 11, 4 11))")])
    assert pairs(shape_join(a, b, predicate_name="contains")) == [(1, 3), (1, 4), (2, 1), (2, 2), (2, 3), (2, 4), (3, 2)]
    assert pairs(shape_join(a, b, predicate_name="overlaps")) == [(1, 1)]
    # (1, 2): the hole's own border alone
    assert (1, 2) in pairs(shape_join(a, b)) and (3, 4) in pairs(shape_join(a, b))


def test_lines_and_points_are_not_dropped(spark):
    a = shapes(spark, [(1, "POLYGON((0 0, 10 0, 10 10, 0 10, 0 0))"), (2, "LINESTRING(0 0, 10 10)"), (3, "POINT(5 5)"), (4, None), (5, "GEOMETRYCOLLECTION(POINT(1 1))"), (6, "POINT(1e999 1)"), (7, "POINT(1 2, 3 4)"), (1, "MULTIPOINT(5 5, 50 50)"), (8, "LINESTRING(5 5, 5 5)")])
    b = shapes(spark, [(1, "LINESTRING(-5 5, 15 5)"), (2, "MULTILINESTRING((0 10, 10 0), (90 90, 91 91))"), (3, "LINESTRING(0 0, 10 0)")])
    assert pairs(shape_join(a, b)) == [(1, 1), (1, 1), (1, 2), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2), (8, 1), (8, 2)]
    assert pairs(shape_join(a, b, predicate_name="contains")) == []  # (1, 3) lies on the border alone
    assert pairs(shape_join(b, a, predicate_name="contains")) == [(1, 3), (1, 8), (2, 3), (2, 8)]
    for x, y in ((a.limit(0), b), (a, b.limit(0)), (a.limit(0), b.limit(0))):
        assert pairs(shape_join(x, y)) == [] and pairs(shape_join(x, y, predicate_name="distance", distance=3.0)) == []
    for options in ({"predicate_name": "near"}, {"predicate_name": "distance"}, {"predicate_name": "distance", "distance": -1.0}):
        with pytest.raises(ValueError, match="predicate|distance"):
            shape_join(a, b, **options)


def test_nearest_shapes_by_brute_force(spark):
    r = random.Random(5)
    spot = lambda: (r.randint(0, 60), r.randint(0, 60))
    line = lambda: [spot() for _ in range(r.randint(2, 4))]
    a, b = [[spot()] for _ in range(40)] + [line() for _ in range(20)], [line() for _ in range(40)]
    wkt = lambda p: ("POINT(" if len(p) == 1 else "LINESTRING(") + ", ".join(f"{x} {y}" for x, y in p) + ")"

    def to_point(p, u, v):
        d = (v[0] - u[0], v[1] - u[1])
        size = d[0] ** 2 + d[1] ** 2
        t = min(Fraction(1), max(Fraction(0), Fraction((p[0] - u[0]) * d[0] + (p[1] - u[1]) * d[1], size))) if size else 0
        return (p[0] - u[0] - t * d[0]) ** 2 + (p[1] - u[1] - t * d[1]) ** 2

    turn = lambda u, v, p: (v[0] - u[0]) * (p[1] - u[1]) - (v[1] - u[1]) * (p[0] - u[0])

    def apart(p, q):
        best = None
        for u, v in zip(p, p[1:] or p, strict=False):
            for s, t in zip(q, q[1:] or q, strict=False):
                if turn(u, v, s) * turn(u, v, t) < 0 and turn(s, t, u) * turn(s, t, v) < 0:
                    return 0
                best = min(x for x in (best, to_point(u, s, t), to_point(v, s, t), to_point(s, u, v), to_point(t, u, v)) if x is not None)
        return best

    want = {}
    for i, p in enumerate(a):
        d, j = min((apart(p, q), j) for j, q in enumerate(b))
        if d <= 64:
            want[i] = (j, float(d) ** 0.5)
    got = {r["id_a"]: (r["id_b"], r["distance"]) for r in nearest_shapes(shapes(spark, list(enumerate(map(wkt, a)))), shapes(spark, list(enumerate(map(wkt, b)))), 8.0).collect()}
    assert {i: j for i, (j, _) in got.items()} == {i: j for i, (j, _) in want.items()} and len(got) > 30
    assert all(abs(got[i][1] - d) < 1e-9 for i, (_, d) in want.items())


def test_signs_are_exact_where_doubles_are_not():
    r = random.Random(9)
    seg, p = [], []
    for _ in range(300):
        x0, y0, dx, dy = (r.uniform(-1, 1) for _ in range(4))
        k = r.choice([2, 4, 8])
        seg.append((x0, y0, x0 + dx, y0 + dy))
        p.append((x0 + dx / k + r.choice([0, 0, 1e-17, -1e-17]), y0 + dy / k))
    s, q = np.array(seg).T, np.array(p).T
    exact = lambda e, c: (e[2] - e[0]) * (c[1] - e[1]) - (e[3] - e[1]) * (c[0] - e[0])
    want = [exact([Fraction(v) for v in e], [Fraction(v) for v in c]) for e, c in zip(seg, p, strict=True)]
    assert relate.signs(s, q).tolist() == [(w > 0) - (w < 0) for w in want]
    other = q[:, ::-1].copy()
    both = [w + exact([Fraction(v) for v in e], [Fraction(v) for v in c]) for w, e, c in zip(want, seg, p[::-1], strict=True)]
    assert relate.signs(s, q, other).tolist() == [(w > 0) - (w < 0) for w in both]
    y = np.array([0.1, 0.3, 0.2, 1.0])
    assert relate.above_middle(y, np.array([0.1, 0.1, 0.1, 2.0]), np.array([0.1, 0.2, 0.3, 2**-60])).tolist() == [False, True, Fraction(0.2) * 2 > Fraction(0.1) + Fraction(0.3), False]
