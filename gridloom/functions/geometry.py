"""Well-known text and rings as columns: parsing, envelopes and point-in-ring tests."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import wkt

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
POINT = rf"(?i)^\s*POINT\s*\(\s*({NUMBER})\s+({NUMBER})\s*\)\s*$"
POLYGON = r"(?i)^\s*POLYGON\s*\(\s*\(([^()]*)\)\s*\)\s*$"


def point(wkt: Column) -> Column:
    """struct(x, y) of a POINT; null for anything else."""
    x, y = (F.regexp_extract(wkt, POINT, i).try_cast("double") for i in (1, 2))
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def ring(wkt: Column) -> Column:
    """array of struct(x, y) of a POLYGON of one ring; null for holes, other kinds or coordinates that are no numbers."""
    inner = F.regexp_extract(wkt, POLYGON, 1)

    def corner(s: Column) -> Column:
        xy = F.split(F.trim(s), r"\s+")
        return F.when(F.size(xy) == 2, F.struct(F.get(xy, F.lit(0)).try_cast("double").alias("x"), F.get(xy, F.lit(1)).try_cast("double").alias("y")))

    out = F.transform(F.split(inner, ","), corner)
    broken = F.exists(out, lambda p: p.isNull() | p["x"].isNull() | p["y"].isNull())
    return F.when((inner != "") & ~broken, out)


def well_formed(wkt: Column) -> Column:
    """Is it a LINESTRING, POLYGON or MULTI kind of planar coordinates? Lists are folded step by step, as one pattern would recurse."""
    t = F.regexp_replace(F.upper(F.trim(wkt)), rf"(?i)(?<![A-Z0-9.]){NUMBER}\s+{NUMBER}(?![0-9.])", "c")
    t = F.regexp_replace(t, r"\s+", "")
    for part in (r",c(?=[,)])", r",\(c\)", r",\(\(c\)\)"):
        t = F.regexp_replace(t, part, "")
    return t.rlike(r"^((LINESTRING|MULTIPOINT)\(c\)|(POLYGON|MULTILINESTRING|MULTIPOINT)\(\(c\)\)|MULTIPOLYGON\(\(\(c\)\)\))$")


def envelope(corners: Column) -> list[Column]:
    """low0, high0, low1, high1 of an array of corners."""
    return [f(corners.getField(c)).alias(n) for n, f, c in (("low0", F.array_min, "x"), ("high0", F.array_max, "x"), ("low1", F.array_min, "y"), ("high1", F.array_max, "y"))]


def rings(wkt: Column) -> Column:
    """All rings of a POLYGON or MULTIPOLYGON, holes included, as array<array<struct(x, y)>>; null for anything else."""
    t = F.upper(F.trim(wkt))
    body = F.regexp_extract(t, r"^(?:MULTI)?POLYGON\s*\((.*)\)$", 1)
    lists = F.regexp_extract_all(body, F.lit(r"\(([^()]+)\)"), 1)
    return F.when(well_formed(wkt) & t.rlike("^(MULTI)?POLYGON") & (F.size(lists) > 0), F.transform(lists, _corners))


def _corners(inner: Column) -> Column:
    def corner(s: Column) -> Column:
        xy = F.split(F.trim(s), r"\s+")
        return F.struct(F.get(xy, F.lit(0)).try_cast("double").alias("x"), F.get(xy, F.lit(1)).try_cast("double").alias("y"))

    return F.transform(F.split(inner, ","), corner)


#: Segments of a shape; points are segments of no length.
SEGMENTS = "array<struct<x0:double,y0:double,x1:double,y1:double,part:int>>"


def shape(text: Column) -> Column:
    """struct(dim, segs) of the well-known text of a POINT, LINESTRING, POLYGON or MULTI kind; null for anything else.

    dim is 0, 1 or 2; segs has the segments of all parts, SEGMENTS, with the number of the part: points, paths, or rings
    with holes by the even-odd rule. Coordinates are planar and finite.
    """

    @F.arrow_udf(f"dim int, segs {SEGMENTS}")
    def of(texts: pa.Array) -> pa.Array:
        return wkt.shapes_of(texts)

    return of(text)


def of_rings(rings: Column) -> Column:
    """The shape() of a polygon's rings; null for none."""
    sides = lambda ring, i: F.transform(edges(F.array(ring)), lambda e: F.struct(*(e[c].alias(c) for c in wkt.XY), i.alias("part")))
    return F.when(F.size(rings) > 0, F.struct(F.lit(2).alias("dim"), F.flatten(F.transform(rings, sides)).alias("segs")))


def edges(parts: Column) -> Column:
    """The edges of all rings as array<struct(x0, y0, x1, y1)>; a ring that is not closed is closed, empty edges go."""

    def of(ring: Column) -> Column:
        after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
        out = F.zip_with(ring, after, lambda p, q: F.struct(p["x"].alias("x0"), p["y"].alias("y0"), q["x"].alias("x1"), q["y"].alias("y1")))
        return F.filter(out, lambda e: (e["x0"] != e["x1"]) | (e["y0"] != e["y1"]))

    return F.flatten(F.transform(parts, of))


def inside(x: Column, y: Column, sides: Column) -> Column:
    """Ray casting over edges (even-odd, so holes count): is (x, y) inside? Borders are half-open."""

    def crosses(e: Column) -> Column:
        at = e["x0"] + (y - e["y0"]) * (e["x1"] - e["x0"]) / F.nullif(e["y1"] - e["y0"], F.lit(0.0))
        return ((e["y0"] > y) != (e["y1"] > y)) & (x < at)

    return F.size(F.filter(sides, crosses)) % 2 == 1


def _boxed(polygons: DataFrame) -> DataFrame:
    """Rows (id, SIDES, sides) of polygons (id, rings): envelopes with the edges as payload; null rings go.

    The explodes of one element keep Spark from parsing the rings anew for every column that reads them; the rows are
    written once, as the join reads them twice.
    """
    from ..operators.partition import checkpointed

    once = polygons.select("id", F.explode(F.array("rings")).alias("rings")).where("rings IS NOT NULL")
    flat = once.select("id", F.explode(F.array(edges(F.col("rings")))).alias("sides"))
    low, high = (lambda c: F.array_min(F.concat(f"sides.{c}0", f"sides.{c}1"))), (lambda c: F.array_max(F.concat(f"sides.{c}0", f"sides.{c}1")))
    return checkpointed(flat.select("id", low("x").alias("low0"), high("x").alias("high0"), low("y").alias("low1"), high("y").alias("high1"), "sides"))


def points_in_polygons(points: DataFrame, polygons: DataFrame, **options) -> DataFrame:
    """Rows (id_a, id_b): points (id, x, y) in polygons (id, ring) or (id, rings), rings with holes by the even-odd rule.

    Envelopes carry the edges through their join, and only its pairs are tested. Null rings hold nothing. Rows that repeat
    give pairs each.
    """
    from ..operators.join import as_rects, matched
    from .predicates import intersects, valid

    if "rings" not in polygons.columns:
        polygons = polygons.select("id", F.when(F.col("ring").isNotNull(), F.array("ring")).alias("rings"))
    pairs = matched(valid(as_rects(points)), valid(_boxed(polygons), keep=("sides",)), test=intersects(), payload_b="sides", **options)
    return pairs.where(inside(F.col("a_low0"), F.col("a_low1"), F.col("b_sides"))).select("id_a", "id_b")


def polygon_join(a: DataFrame, b: DataFrame, **options) -> DataFrame:
    """operators.shapes.shape_join of polygons (id, rings), rings with holes by the even-odd rule; null rings match nothing."""
    from ..operators.shapes import shape_join

    return shape_join(*(t.select("id", of_rings(F.col("rings")).alias("shape")) for t in (a, b)), **options)
