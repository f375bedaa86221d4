"""Points in polygons by quadtree covers.

A polygon is covered by cells of a quadtree over the whole plane: inner ones, which lie wholly inside it, and ones that
its border meets. Cells are sides of powers of two from the origin, so that a point's cell is exact at every depth and
the cells above it are its prefixes. Points meet the cells of their prefixes by equality: in an inner cell they are in
the polygon, and only those in a border cell are compared with its rings. Equal points and equal polygons are one each
until their ids are put in for the numbers of the pairs found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import geometry, relate, wkt
from ..functions.predicates import SIDES
from . import shapes
from .equal import merged, taken_apart
from .partition import checkpointed, dealt, met

#: Times that a border cell is quartered, from cells about as large as the polygon; segments of polygons compared in one call.
DEPTH, AT_ONCE = 4, 200_000
#: Depths of cells: a side is 2 ** -depth, and cell numbers stay below 2 ** 52.
LEAST, MOST = -1000, 1000


def _first(box: np.ndarray) -> np.ndarray:
    """The depth at which a cell is at least as large as each box (low0, high0, low1, high1), and its numbers are exact."""
    size = np.maximum(box[1] - box[0], box[3] - box[2])
    fits = -np.ceil(np.log2(np.where(size > 0, size, 1.0)))
    far = np.abs(box).max(axis=0)
    exact = 51 - DEPTH - np.ceil(np.log2(np.maximum(far, 1e-300)))
    return np.clip(np.minimum(fits, exact), LEAST, MOST).astype(np.int64)


def _squares(depth: np.ndarray, cx: np.ndarray, cy: np.ndarray) -> relate.Side:
    """Cells as polygons, one for each pair."""
    side = np.ldexp(1.0, -depth)
    x0, x1, y0, y1 = cx * side, (cx + 1) * side, cy * side, (cy + 1) * side
    seg = np.stack([np.stack(c, axis=1).ravel() for c in ((x0, x1, x1, x0), (y0, y0, y1, y1), (x1, x1, x0, x0), (y0, y1, y1, y0))])
    return relate.Side(seg, np.repeat(np.arange(len(depth)), 4), np.zeros(4 * len(depth), np.int64), np.full(len(depth), 2))


def _classed(seg: np.ndarray, part: np.ndarray, start: np.ndarray, size: np.ndarray, of: np.ndarray, depth: np.ndarray, cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
    """Of cells of polygons `of`: 2 inside, 1 on the border, 0 outside."""
    out = np.empty(len(of), np.int64)
    total = np.cumsum(size[of])
    for k in np.split(np.arange(len(of)), np.flatnonzero(np.diff(total // AT_ONCE)) + 1):
        at = np.repeat(start[of[k]] - np.cumsum(size[of[k]]) + size[of[k]], size[of[k]]) + np.arange(int(size[of[k]].sum()))
        polygon = relate.Side(seg[:, at], np.repeat(np.arange(len(k)), size[of[k]]), part[at], np.full(len(k), 2))
        found = relate.related(_squares(depth[k], cx[k], cy[k]), polygon, deep=False)
        out[k] = np.where(found["touches"] | found["b_inside"], 1, np.where(found["a_inside"], 2, 0))
    return out


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seg, geom, part = wkt.flattened(batch.column("segs"))
        size = np.bincount(geom, minlength=batch.num_rows)
        start = np.cumsum(size) - size
        box = np.stack([batch.column(c).to_numpy() for c in SIDES])
        depth = _first(box)
        x0, x1, y0, y1 = (np.floor(np.ldexp(b, depth)).astype(np.int64) for b in box)
        wide = x1 - x0 + 1
        many = wide * (y1 - y0 + 1)
        of = np.repeat(np.arange(batch.num_rows), many)
        k = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        depth, cx, cy = depth[of], x0[of] + k % wide[of], y0[of] + k // wide[of]
        for step in range(DEPTH + 1):
            if not len(of):
                break
            kind = _classed(seg, part, start, size, of, depth, cx, cy)
            done = (kind == 2) | ((kind == 1) & (step == DEPTH))
            row = batch.column("row").take(pa.array(of[done]))
            yield pa.RecordBatch.from_arrays([row, *(pa.array(v[done]) for v in (depth, cx, cy)), pa.array(kind[done] == 2)], ["row", "depth", "cx", "cy", "inner"])
            of, depth, cx, cy = (np.repeat(v[kind == 1], 4) for v in (of, depth, cx, cy))
            depth, cx, cy = depth + 1, 2 * cx + np.arange(len(of)) % 2, 2 * cy + np.arange(len(of)) // 2 % 2


def cover(polygons: DataFrame) -> DataFrame:
    """Rows (row, depth, cx, cy, inner): disjoint cells of side 2 ** -depth that cover each of prepared() polygons."""
    return dealt(polygons.where("dim = 2").select("row", "segs", *SIDES)).mapInArrow(_covered, "row long, depth long, cx long, cy long, inner boolean")


def points_in_shapes(points: DataFrame, polygons: DataFrame, *, boundary: str = "closed") -> DataFrame:
    """Rows (id_a, id_b): points (id, x, y) in polygons (id, shape), or texts (id, wkt), borders included if closed; holes by the even-odd rule.

    Null, NaN and infinite coordinates match nothing, nor do null shapes, points or lines among them. Rows that repeat give
    pairs each; empty tables give none; further columns are not read.
    """
    if boundary not in ("closed", "open"):
        raise ValueError(f"boundary: {boundary}")
    held = shapes.merged(polygons).withColumnRenamed("id", "row")
    cells = checkpointed(cover(held))
    depths = [r["depth"] for r in cells.select("depth").distinct().collect()]  # one for each doubling of size at most
    finite = "abs(x) < double('infinity') AND abs(y) < double('infinity')"
    spots = merged(points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(finite), "x", "y").withColumnRenamed("id", "row")
    at = lambda c: F.floor(F.col(c) * F.pow(F.lit(2.0), F.col("depth"))).alias(f"c{c}")
    prefixes = spots.withColumn("depth", F.explode(F.array(*(F.lit(d) for d in depths)) if depths else F.array().cast("array<bigint>"))).select(F.col("row").alias("row_a"), "depth", at("x"), at("y"))
    found = met(prefixes, cells.withColumnRenamed("row", "row_b"), ["depth", "cx", "cy"])
    corner = F.struct(*(F.col(c).alias(n) for n, c in zip(wkt.XY, "xyxy", strict=True)), F.lit(0).alias("part"))
    # distinct points and polygons are compared by their numbers; their ids come last
    left = spots.select("row", F.col("row").alias("id"), F.lit(0).alias("dim"), F.array(corner).cast(geometry.SEGMENTS).alias("segs"))
    near = shapes.compared(left, held.withColumn("id", F.col("row")), found.where("NOT inner").select("row_a", "row_b"), deep=boundary == "open")
    test = shapes.intersects() if boundary == "closed" else F.col("a_inside")
    pairs = found.where("inner").select("row_a", "row_b").unionByName(near.where(test).select(F.col("id_a").alias("row_a"), F.col("id_b").alias("row_b")))
    for t, x in ((spots, "a"), (held, "b")):
        pairs = met(pairs, t.select(F.col("row").alias(f"row_{x}"), F.col("ids").alias(f"ids_{x}")), [f"row_{x}"])
    return taken_apart(pairs.select("ids_a", "ids_b"))
