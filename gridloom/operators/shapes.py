"""Joins of points, lines and polygons by their exact shapes.

Equal shapes are merged first, with the list of their ids; what is left is joined in groups of cells (grouped.py). With options of the rectangle join envelopes propose pairs by it, as
row numbers only; the segments of both sides are then fetched by equi-joins, once for each pair, and functions.relate
compares them in Arrow batches. Predicates are columns over what it finds, by the dimensions of the two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry, relate, wkt
from ..functions.predicates import SIDES, predicate, valid
from .equal import equal_shapes, equal_texts, merger
from .grouped import grouped_join
from .join import matched
from .partition import checkpointed, dealt

#: Segments, both sides together, that are compared in one call; one pair where it has more.
AT_ONCE = 200_000


def _oriented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shapes of rows (id, shape), or (ids, shape), with their envelopes; rings are turned so that the inside is on the left; null shapes go."""
    for batch in batches:
        name = batch.schema.names[0]
        batch = batch.filter(batch.column("shape").is_valid())
        dim, lists = (batch.column("shape").field(c) for c in ("dim", "segs"))
        seg, geom, part = wkt.flattened(lists)
        ring = dim.to_numpy(zero_copy_only=False)[geom] == 2
        seg[:, ring] = relate.oriented(seg[:, ring], geom[ring], part[ring])
        full = np.unique(geom)
        start = np.searchsorted(geom, full)
        sides = [f.reduceat(np.stack([seg[k], seg[k + 2]]).T.ravel(), 2 * start) if len(start) else np.empty(0) for k in (0, 1) for f in (np.minimum, np.maximum)]
        keep = pa.array(full)
        columns = [batch.column(name).take(keep), dim.take(keep), wkt.listed(seg, geom, part, len(dim)).take(keep), *map(pa.array, sides)]
        yield pa.RecordBatch.from_arrays(columns, [name, "dim", "segs", *SIDES])


def prepared(table: DataFrame) -> DataFrame:
    """Rows (row, id, dim, segs, SIDES) of shapes (id, shape) or texts (id, wkt), written once; null shapes go. row is a number of the row's own."""
    shape = F.col("shape") if "shape" in table.columns else geometry.shape(F.col("wkt")).alias("shape")
    once = table.select(F.col("id").cast("long").alias("id"), shape)
    flat = dealt(once).mapInArrow(_oriented, f"id long, dim int, segs {geometry.SEGMENTS}, " + ", ".join(f"{c} double" for c in SIDES))
    return checkpointed(flat.withColumn("row", F.monotonically_increasing_id()))


def merged(table: DataFrame) -> DataFrame:
    """Rows (id, ids, dim, segs, SIDES) of shapes (id, shape) or texts (id, wkt), written once: equal ones are one row with the list of their ids, and equal texts are read once; id is a number of the row's own."""
    kind = "shape" if "shape" in table.columns else "wkt"
    once = dealt(table.select(F.col("id").cast("long").alias("id"), kind).where(F.col(kind).isNotNull()), kind)
    merge = merger(equal_shapes if kind == "shape" else equal_texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = merge(batches)
        if kind == "wkt":
            found = (pa.RecordBatch.from_arrays([b.column("ids"), wkt.shapes_of(b.column("wkt"))], ["ids", "shape"]) for b in found)
        yield from _oriented(found)

    flat = once.mapInArrow(run, f"ids array<long>, dim int, segs {geometry.SEGMENTS}, " + ", ".join(f"{c} double" for c in SIDES))
    return checkpointed(flat.withColumn("id", F.monotonically_increasing_id()))


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    size = sum(batch.column(c).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("segs_a", "segs_b"))
    group = (np.cumsum(size) - size) // AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(size)]
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        if y > x:
            yield batch.slice(x, y - x)


def relations(a: DataFrame, b: DataFrame, *, test: Column, by: float = 0.0, deep: bool = True, distance: bool = False, **options) -> DataFrame:
    """Rows (id_a, id_b, dim_a, dim_b, *relate.FLAGS) of shapes (id, shape) for whose envelopes test holds; with distance also that, up to `by`.

    Each pair of rows gives one. Without deep, pairs in contact have `touches` and `crosses` alone filled in.
    """
    left, right = prepared(a), prepared(b)
    boxes = [valid(t.select(F.col("row").alias("id"), *SIDES)) for t in (left, right)]
    pairs = matched(*boxes, test=test, by=by, **options).select(F.col("id_a").alias("row_a"), F.col("id_b").alias("row_b"))
    return compared(left, right, pairs, by=by, deep=deep, distance=distance)


def compared(left: DataFrame, right: DataFrame, pairs: DataFrame, *, by: float = 0.0, deep: bool = True, distance: bool = False) -> DataFrame:
    """relations() of the given pairs (row_a, row_b) of prepared() tables."""
    # dealt evenly: few numbers, but each stands for much to compare
    pairs = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row_a", "row_b")
    for t, x in ((left, "a"), (right, "b")):
        pairs = pairs.join(t.select(F.col("row").alias(f"row_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in ("id", "dim", "segs"))), f"row_{x}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                one, two = (relate.Side(seg, pair, ring, part.column(f"dim_{x}").to_numpy(zero_copy_only=False)) for x in "ab" for seg, pair, ring in (wkt.flattened(part.column(f"segs_{x}")),))
                found = relate.related(one, two, deep=deep)
                columns = [part.column(c) for c in ("id_a", "id_b", "dim_a", "dim_b")] + [pa.array(found[f]) for f in relate.FLAGS]
                names = ["id_a", "id_b", "dim_a", "dim_b", *relate.FLAGS]
                if distance:
                    apart = ~(found["touches"] | found["a_inside"] | found["b_inside"])
                    columns, names = [*columns, pa.array(relate.distances(one, two, apart, by))], [*names, "distance"]
                yield pa.RecordBatch.from_arrays(columns, names)

    ddl = "id_a long, id_b long, dim_a int, dim_b int, " + ", ".join(f"{f} boolean" for f in relate.FLAGS) + ", distance double" * distance
    return pairs.select("id_a", "id_b", "dim_a", "dim_b", "segs_a", "segs_b").mapInArrow(run, ddl)


def intersects() -> Column:
    """The shapes share a point, borders included."""
    return F.col("touches") | F.col("a_inside") | F.col("b_inside")


def contains(a: str = "a", b: str = "b") -> Column:
    """No point of b is outside a, and their interiors meet: a line along the border of a polygon is not in it."""
    areas = ~F.col("crosses") & ~F.col("opposite") & ~F.col(f"{a}_inside")
    held = F.when(F.col(f"dim_{b}") == 2, areas).otherwise(F.col(f"{b}_inside"))
    return (F.col(f"dim_{a}") >= F.col(f"dim_{b}")) & ~F.col(f"{b}_outside") & held


def overlaps() -> Column:
    """Shapes of one dimension whose interiors meet in it, neither of which contains the other."""
    areas = F.col("crosses") | F.col("a_inside") | F.col("b_inside") | F.col("same")
    meet = F.when(F.col("dim_a") == 2, areas).otherwise(F.col("b_inside"))
    return (F.col("dim_a") == F.col("dim_b")) & meet & ~contains("a", "b") & ~contains("b", "a")


def shape_join(a: DataFrame, b: DataFrame, *, predicate_name: str = "intersects", distance: float | None = None, **options) -> DataFrame:
    """Rows (id_a, id_b) of shapes (id, shape), or of their texts (id, wkt), for which predicate_name holds: intersects, contains, within, overlaps or distance.

    Points, lines and polygons in any mix. Null shapes match nothing; rows that repeat give pairs each; empty tables give
    none; further columns are not read. Polygons must be valid: rings meet each other in single points at most, and don't
    cross themselves. The tests are exact, distances are doubles.
    """
    if predicate_name == "distance":
        if distance is None or distance < 0:
            raise ValueError(f"distance: {distance}")
        if not options:
            return grouped_join(merged(a), merged(b), name="distance", by=float(distance))
        return _near(a, b, distance, **options).select("id_a", "id_b")
    tests = {"intersects": intersects(), "contains": contains("a", "b"), "within": contains("b", "a"), "overlaps": overlaps()}
    if predicate_name not in tests:
        raise ValueError(f"predicate: {predicate_name}")
    if not options:
        return grouped_join(merged(a), merged(b), name=predicate_name)
    boxes = "intersects" if predicate_name == "overlaps" else predicate_name
    return relations(a, b, test=predicate(boxes), deep=predicate_name != "intersects", **options).where(tests[predicate_name]).select("id_a", "id_b")


def _near(a: DataFrame, b: DataFrame, distance: float, **options) -> DataFrame:
    found = relations(a, b, test=predicate("distance", distance=distance), by=float(distance), deep=False, distance=True, **options)
    return found.where(F.col("distance") <= F.lit(float(distance)))


def nearest_shapes(a: DataFrame, b: DataFrame, distance: float, **options) -> DataFrame:
    """Rows (id_a, id_b, distance): of each id of a the nearest shape of b within `distance`; ties go to the smallest id_b."""
    if not options:
        # of equal shapes of b the smallest id is the nearest, a null one first; those of a are asked for once, by their number
        held = merged(a)
        least = merged(b).withColumn("id", F.get(F.sort_array("ids"), F.lit(0))).drop("ids")
        found = grouped_join(held.drop("ids"), least, name="distance", by=float(distance), nearest=True)
        of = found.groupBy("id_a").agg(F.min(F.struct(F.col("far").alias("distance"), "id_b")).alias("m"))
        found = held.select(F.col("id").alias("id_a"), "ids").join(of, "id_a").select(F.explode("ids").alias("id_a"), "m.distance", "m.id_b")
    else:
        found = _near(a, b, distance, **options)
    best = found.groupBy("id_a").agg(F.min(F.struct("distance", "id_b")).alias("m"))
    return best.select("id_a", F.col("m.id_b").alias("id_b"), F.col("m.distance").alias("distance"))
