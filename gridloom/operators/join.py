"""spatial_join: pairs (id_a, id_b) of rectangles by interchangeable strategies, all of which give the same rows."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.predicates import SIDES, predicate, side, valid
from . import index
from .equal import WEIGHT, merged
from .packed import CELL, coarser, leveled, packed_join
from .partition import Directory, Grid, assign, blocked, checkpointed, dealt, directory, met, refined, sized_grid

#: Bytes of a row (id and four doubles, with Spark's own), and the largest side that is broadcast.
ROW_BYTES, BROADCAST_BYTES = 64, 64 << 20
#: Rows of the smaller side that a nested loop takes when the larger side is no broadcast; beyond that the grid joins.
NESTED_ROWS = 10_000
#: Objects of a tile of the strategies by a directory of tiles, and of one of the sweep, both sides together.
PER_TILE, PER_RANGE = 2000, 100_000
ALGORITHMS = ("grid", "stripes_x", "stripes_y", "sweep", "adaptive", "sort_tile", "binary_split", "packed", "rtree", "inlj", "broadcast", "nested")


def _once(grid: Grid, by: float, level: Column | int = 0) -> Column:
    """True in the one cell that holds the corner of largest lows: of b's rectangle and a's, widened by `by`.

    Both sides are assigned to that cell, if they meet: it is the cell of one of the lows, and not after either high's.
    """
    corner = [F.greatest(F.col(f"a_low{d}") - F.lit(by), F.col(f"b_low{d}")) for d in (0, 1)]
    return (grid.cell(0, corner[0], level) == F.col("cx")) & (grid.cell(1, corner[1], level) == F.col("cy"))


def begins(x: str) -> list[Column]:
    """The marks of assign() for side x of a join."""
    return [F.col(f"begins{d}").alias(f"{x}_begins{d}") for d in (0, 1)]


def begun() -> Column:
    """True in the one cell that keeps a pair, by the marks of both sides."""
    return (F.col("a_begins0") | F.col("b_begins0")) & (F.col("a_begins1") | F.col("b_begins1"))


def _cells(a: DataFrame, b: DataFrame, grid: Grid, test: Column, by: float, more_a: tuple[str, ...], more_b: tuple[str, ...]) -> DataFrame:
    left, right = side(assign(a, grid, by=by), "a", "cx", "cy", *begins("a"), *more_a), side(assign(b, grid), "b", "cx", "cy", *begins("b"), *more_b)
    return met(left, right, ["cx", "cy"]).where(begun() & test)


def _levels(a: DataFrame, b: DataFrame, grid: Grid, test: Column, by: float, more_a: tuple[str, ...], more_b: tuple[str, ...], key: tuple[str, ...] = ()) -> DataFrame:
    """Join of objects of very different extents: each lives on the levels where it spans two cells a way at most.

    A pair meets on the coarser of its two levels, in each dimension. Objects go to their own levels and to the coarser
    ones that the other side makes of them, nine cells each at most, so a map-wide object is a few rows and not one for
    each cell. Cells that hold too many objects are dealt in blocks. Objects also agree in `key`.
    """
    by_key = [*key, *CELL, "block_a", "block_b"]
    rows = blocked(*leveled(a, b, grid, by), [*key, *CELL])
    left, right = (side(t, x, *by_key, F.col("_own").alias(f"_own_{x}"), *begins(x), *more) for x, t, more in zip("ab", rows, (more_a, more_b), strict=True))
    return met(left, right, by_key).where(begun() & (F.col("_at") == coarser(F.col("_own_a"), F.col("_own_b"))) & test)


def _merged_levels(a: DataFrame, b: DataFrame, grid_of: Callable[[DataFrame, DataFrame], Grid | None], test: Column, by: float) -> DataFrame:
    """_levels() of distinct rectangles with the lists of their ids, which are taken apart after the last shuffle: copies and blocks follow the distinct ones."""
    left, right = merged(a, *SIDES), merged(b, *SIDES)
    grid = grid_of(left, right)
    if grid is None:  # a table without rows
        return side(a, "a").join(side(b, "b"), F.lit(False))
    key = [*CELL, "block_a", "block_b"]
    rows = blocked(*leveled(left, right, grid, by), CELL, weight=F.ceil(F.size("ids") / WEIGHT))
    left, right = (side(t, x, *key, F.col("_own").alias(f"_own_{x}"), *begins(x), F.col("ids").alias(f"ids_{x}")) for x, t in zip("ab", rows, strict=True))
    found = met(left, right, key).where(begun() & (F.col("_at") == coarser(F.col("_own_a"), F.col("_own_b"))) & test)
    names = [[f"{x}_{c}" for c in SIDES] for x in "ab"]
    return found.select(F.explode("ids_a").alias("id_a"), *names[0], "ids_b", *names[1]).select("id_a", *names[0], F.explode("ids_b").alias("id_b"), *names[1])


def _any(a: DataFrame, b: DataFrame, grid: Grid, test: Column, by: float) -> DataFrame:
    """Rows (id_a, ...) of a that match any of b, at most once for each cell and block of a row: a row leaves its cell at its first match."""
    key = [*CELL, "block_a", "block_b"]
    left, right = blocked(*leveled(a, b, grid, by), CELL)
    left, right = dealt(side(left, "a", *key), *key), dealt(side(right, "b", *(F.col(c).alias(f"{c}_of") for c in key)), *(f"{c}_of" for c in key))
    same = F.lit(True)
    for c in key:
        same = same & (F.col(c) == F.col(f"{c}_of"))
    return left.join(right.hint("merge"), same & test, "left_semi")


def swept(a: DataFrame, b: DataFrame, tiles: Directory, by: float, *, most: int = PER_RANGE) -> DataFrame:
    """Pairs whose rectangles, a's widened by `by`, meet (closed): stripes of dimension 1, cut along dimension 0 and swept.

    The directory cuts the swept axis where a stripe is full; objects that are open at a cut go on into the next range. A
    range that still has more than `most` objects, which can't be cut where they lie on each other, is dealt in blocks of
    both sides, so no group is larger than two blocks. In a range both sides are sorted by their lows. The objects that
    begin while one is open are a run of the other side's order, found by binary search; each pair shows in the run of
    whichever begins first. Runs are compared in blocks and leave in parts, so that memory follows the range and not its pairs.
    """
    names = [f"{x}_{c}" for x in "ab" for c in SIDES]
    key, bounds = ["depth", "at"], ["x0", "x1", "y0", "y1"]
    # written with a number, by which a full range is dealt: the same if a task runs again
    rows = {x: checkpointed(t.withColumn("number", F.monotonically_increasing_id())) for x, t in (("a", tiles.deal(a, by=by)), ("b", tiles.deal(b)))}
    half = max(1, most // 2)
    held = [t.groupBy(*key).agg(F.count("*").alias(f"n_{x}")) for x, t in rows.items()]
    parts = [F.ceil(F.col(f"n_{x}") / half).cast("int").alias(f"parts_{x}") for x in "ab"]
    # ranges of one side alone go; full ones are few, a row for each `half` objects at most
    full = held[0].join(held[1], key).select(*key, *parts).where("parts_a > 1 OR parts_b > 1")

    def blocks(x: str) -> DataFrame:
        other = "b" if x == "a" else "a"
        own = F.pmod(F.xxhash64("number"), F.coalesce(f"parts_{x}", F.lit(1))).cast("int").alias(f"block_{x}")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(f"parts_{other}", F.lit(1)) - 1)).alias(f"block_{other}")
        return rows[x].join(full, key, "left").select(*key, own, every, "id", *SIDES, *(bounds if x == "a" else []))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(batches)
        left, right = both.filter(both.column("of_a")), both.filter(pc.invert(both.column("of_a")))
        if not len(left) or not len(right):
            return
        x, y = ({c: t.column(c).to_numpy() for c in ("id", *SIDES)} for t in (left, right))
        x = {c: v - by if c.startswith("low") else v + by if c.startswith("high") else v for c, v in x.items()}
        (x, left), (y, right) = ((({c: v[o] for c, v in s.items()}), t.take(pa.array(o))) for s, t in ((x, left), (y, right)) for o in (np.argsort(s["low0"], kind="stable"),))
        x0, x1, y0, y1 = (left.column(c)[0].as_py() for c in bounds)
        for first, second, after in ((x, y, "left"), (y, x, "right")):
            # of equal lows a's object counts as the first
            begin = np.searchsorted(second["low0"], first["low0"], side=after)
            count = np.maximum(np.searchsorted(second["low0"], first["high0"], side="right") - begin, 0)
            block = np.cumsum(count) // 2_000_000
            for rows in np.split(np.arange(len(count)), np.flatnonzero(np.diff(block)) + 1):
                i = np.repeat(rows, count[rows])
                ends = np.cumsum(count[rows])
                j = np.arange(len(i)) - np.repeat(ends - count[rows] - begin[rows], count[rows])
                meet = (first["low1"][i] <= second["high1"][j]) & (second["low1"][j] <= first["high1"][i])
                i, j = (i[meet], j[meet]) if after == "left" else (j[meet], i[meet])
                # the corner of largest lows lies in one range alone
                low0, low1 = (np.maximum(x[c][i], y[c][j]) for c in ("low0", "low1"))
                own = (low0 >= x0) & (low0 < x1) & (low1 >= y0) & (low1 < y1)
                one, two = left.take(pa.array(i[own])), right.take(pa.array(j[own]))
                out = pa.table([*(one.column(c) for c in ("id", *SIDES)), *(two.column(c) for c in ("id", *SIDES))], names=["id_a", *names[:4], "id_b", *names[4:]])
                yield from out.to_batches(max_chunksize=1 << 16)

    ddl = "id_a long, " + ", ".join(f"{n} double" for n in names[:4]) + ", id_b long, " + ", ".join(f"{n} double" for n in names[4:])
    by_key = [*key, "block_a", "block_b"]
    mark = lambda x: blocks(x).select(*by_key, "id", *SIDES, *((c if x == "a" else F.lit(None).cast("double").alias(c)) for c in bounds), F.lit(x == "a").alias("of_a"))
    return dealt(mark("a").unionByName(mark("b")), *by_key).groupBy(*by_key).applyInArrow(sweep, ddl)


def tile_join(a: DataFrame, b: DataFrame, *, boundary: str = "closed") -> DataFrame:
    """Rows (tile, id_a, id_b) of rectangles (tile, id, SIDES) that meet inside equal tiles: pairs of every cell of a tile are compared."""
    left, right = (valid(t, keep=("tile",)) for t in (a, b))
    grid = sized_grid(left, right) or Grid(0.0, 0.0, 0.0, 0.0, 1, 1)
    return _levels(left, right, grid, predicate("intersects", boundary), 0.0, (), (), ("tile",)).select("tile", "id_a", "id_b")


def tiled(a: DataFrame, b: DataFrame, tiles: Directory, test: Column, by: float = 0.0) -> DataFrame:
    """Join of valid tables by the tiles of a directory; a rectangle goes to every tile that it meets.

    The pair's corner of largest lows tells the one tile that keeps it: tiles fill the plane and are half-open.
    """
    key, bounds = ["depth", "at"], ["x0", "x1", "y0", "y1"]
    x, y = (F.greatest(F.col(f"a_low{d}") - F.lit(by), F.col(f"b_low{d}")) for d in (0, 1))
    owner = (x >= F.col("x0")) & (x < F.col("x1")) & (y >= F.col("y0")) & (y < F.col("y1"))
    return met(side(tiles.deal(a, by=by), "a", *key), side(tiles.deal(b), "b", *key, *bounds), key).where(test & owner).drop(*key, *bounds)


def matched(a: DataFrame, b: DataFrame, *, test: Column, by: float = 0.0, algorithm: str = "grid", n: int | None = None,
            extent: tuple[float, float, float, float] | None = None, max_comparisons: int = 1000, node_size: int = 16,
            payload_a: str | None = None, payload_b: str | None = None) -> DataFrame:
    """Joined rows (id_a, a_low0, ..., id_b, b_low0, ...) of valid tables a and b for which test holds.

    test asks of the boxes alone, and may only hold where a, widened by `by`, and b intersect (closed). A payload column comes back as a_ and b_ with
    its name; the strategies by cells alone carry them.
    """
    more_a, more_b = ((F.col(c).alias(f"{x}_{c}"),) if c else () for x, c in (("a", payload_a), ("b", payload_b)))
    if algorithm == "nested" and max(a.count(), b.count()) * ROW_BYTES > BROADCAST_BYTES and min(a.count(), b.count()) > NESTED_ROWS:
        warnings.warn("nested: too many rows to compare all pairs; joined by the grid", stacklevel=2)
        algorithm = "grid"
    if algorithm == "nested":
        return side(dealt(a), "a", *more_a).join(side(dealt(b), "b", *more_b), test)
    if algorithm == "broadcast":
        if b.count() * ROW_BYTES <= BROADCAST_BYTES and not payload_b:
            grid = sized_grid(b)
            if grid is None or grid.spread > 2:
                return side(dealt(a), "a", *more_a).join(F.broadcast(side(b, "b")), test)
            # a's rows meet those of their cells alone; cells are as fine as b's copies, (1 + fine / 2)**2 of each, stay small
            fine = next((k for k in (4, 2) if b.count() * ROW_BYTES * (1 + k / 2) ** 2 <= BROADCAST_BYTES), 1)
            grid = replace(grid, n0=grid.n0 * fine, n1=grid.n1 * fine)
            left, right = side(assign(dealt(a), grid, by=by), "a", "cx", "cy", *begins("a"), *more_a), side(assign(b, grid), "b", "cx", "cy", *begins("b"))
            return left.join(F.broadcast(right), ["cx", "cy"]).where(begun() & test)
        warnings.warn("broadcast: b is too large or carries further columns; joined by the grid", stacklevel=2)
        algorithm = "grid"
    if (more_a or more_b) and algorithm != "grid" and not (n and algorithm in ("stripes_x", "stripes_y")):
        raise ValueError(f"algorithm {algorithm} carries no further columns")
    if algorithm in ("rtree", "inlj"):
        return index.traversed(a, b, test, by=by, node_size=node_size, whole_a=algorithm == "inlj")
    if algorithm in ("sort_tile", "binary_split"):
        capacity = max(1, math.ceil(b.count() / n**2)) if n else PER_TILE
        return tiled(a, b, directory(b, method=algorithm, capacity=capacity), test, by)
    if algorithm not in ALGORITHMS:
        raise ValueError(f"algorithm: {algorithm}")
    if algorithm == "sweep":
        capacity = max(1, math.ceil(b.count() / n**2)) if n else PER_RANGE // 2
        return swept(a, b, directory(b, capacity=capacity, first=1), by).where(test)
    if algorithm.startswith("stripes") and not n:
        # by counts, and cut along the other axis where a stripe is full
        return tiled(a, b, directory(b, capacity=PER_TILE, first=int(algorithm == "stripes_y")), test, by)
    # a stripe is cut along its own axis by the number of objects
    n0, n1 = (None if algorithm == other else n for other in ("stripes_y", "stripes_x"))
    grid = sized_grid(a, b, n0=n0, n1=n1, extent=extent)
    if grid is None:
        return side(a, "a", *more_a).join(side(b, "b", *more_b), F.lit(False))
    if algorithm == "packed":
        return packed_join(a, b, grid, test, by)
    if algorithm != "adaptive":
        wide = algorithm == "grid" and grid.spread > 2
        if wide and not (more_a or more_b):
            return _merged_levels(a, b, lambda p, q: sized_grid(p, q, n0=n0, n1=n1, extent=extent), test, by)
        return (_levels if wide else _cells)(a, b, grid, test, by, more_a, more_b)
    wide = a.select("id", *((F.col(c) + (-by if c.startswith("low") else by)).alias(c) for c in SIDES), *(F.col(c).alias(f"_{c}") for c in SIDES))
    left, right = refined(wide, b, grid, max_comparisons=max_comparisons)
    left = left.select("id", *(F.col(f"_{c}").alias(c) for c in SIDES), "level", "cx", "cy")
    both = met(side(left, "a", "level", "cx", "cy"), side(right, "b", "level", "cx", "cy"), ["level", "cx", "cy"])
    return both.where(test & _once(grid, by, F.col("level")))


def spatial_join(a: DataFrame, b: DataFrame, *, predicate_name: str = "intersects", algorithm: str = "grid", boundary: str = "closed", distance: float | None = None, n: int | None = None, max_comparisons: int = 1000, extent: tuple[float, float, float, float] | None = None, exclude_self: bool = False, precision: str = "double", node_size: int = 16, how: str = "inner") -> DataFrame:
    """Rows (id_a, id_b), one for each pair of rows of a and b (id, low0, high0, low1, high1) that fits; for how = semi or anti rows (id_a).

    predicate_name: intersects, contains, within, overlaps or distance. Null and NaN coordinates never match. Rows that
    repeat give pairs each. Empty tables give no pairs. Rectangles need low <= high. Further columns are not read.
    semi and anti: rows of a that match any or no row of b; ids are taken as keys of a.
    """
    left, right = valid(a, precision=precision), valid(b, precision=precision)
    by = float(distance or 0.0) if predicate_name == "distance" else 0.0
    test = predicate(predicate_name, boundary, distance)
    others = F.col("id_a") != F.col("id_b") if exclude_self else F.lit(True)
    if how != "inner" and algorithm == "grid":
        found = _any(left, right, sized_grid(left, right, n0=n, n1=n, extent=extent) or Grid(0.0, 0.0, 0.0, 0.0, 1, 1), test & others, by)
    else:
        found = matched(left, right, test=test, by=by, algorithm=algorithm, n=n, extent=extent, max_comparisons=max_comparisons, node_size=node_size).where(others).select("id_a", "id_b")
    if how == "inner":
        return found
    every = a.select(F.col("id").cast("long").alias("id_a"))
    return dealt(every, "id_a").join(dealt(found.select("id_a").distinct(), "id_a").hint("merge"), "id_a", {"semi": "left_semi", "anti": "left_anti"}[how])


def nearest(a: DataFrame, b: DataFrame, distance: float, **options) -> DataFrame:
    """Rows (id_a, id_b, distance): of each id of a the nearest of b within `distance`; ties go to the smallest id_b."""
    from ..functions.predicates import distance_squared

    if options.get("algorithm", "grid") == "grid":
        from .grouped import grouped_join

        found = grouped_join(valid(a), valid(b), name="boxes", by=float(distance), nearest=True)
        best = found.groupBy("id_a").agg(F.min(F.struct("far", "id_b")).alias("m"))
        return best.select("id_a", F.col("m.id_b").alias("id_b"), F.sqrt("m.far").alias("distance"))
    d2 = distance_squared()
    pairs = matched(valid(a), valid(b), test=d2 <= F.lit(float(distance) ** 2), by=float(distance), **options)
    best = pairs.groupBy("id_a").agg(F.min(F.struct(d2.alias("d2"), "id_b")).alias("m"))
    return best.select("id_a", F.col("m.id_b").alias("id_b"), F.sqrt("m.d2").alias("distance"))


def as_rects(points: DataFrame) -> DataFrame:
    """Points (id, x, y) as rectangles without area."""
    return points.select("id", F.col("x").alias("low0"), F.col("x").alias("high0"), F.col("y").alias("low1"), F.col("y").alias("high1"))
