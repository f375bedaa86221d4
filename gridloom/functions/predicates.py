"""Rectangle predicates as Columns over the sides a_low0 .. b_high1, and the same as SQL functions.

Nulls make a predicate null, so such rows never match; valid() also keeps NaN, which Spark orders last, from matching.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SIDES = ("low0", "high0", "low1", "high1")


def valid(df: DataFrame, *, precision: str = "double", drop_zero_rows: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows (id, SIDES, *keep) whose coordinates are numbers, as double; precision float32 rounds them to 32 bits first."""
    if precision not in ("double", "float32"):
        raise ValueError(f"precision: {precision}")
    cast = (lambda c: F.col(c).cast("float").cast("double")) if precision == "float32" else (lambda c: F.col(c).cast("double"))
    out = df.select(F.col("id").cast("long").alias("id"), *(cast(c).alias(c) for c in SIDES), *keep)
    for c in SIDES:
        out = out.where(F.col(c).isNotNull() & ~F.isnan(c))
    if drop_zero_rows:
        out = out.where(~((F.col("id") == 0) & (F.col("low0") == 0) & (F.col("high0") == 0) & (F.col("low1") == 0) & (F.col("high1") == 0)))
    return out


def side(df: DataFrame, name: str, *more: str) -> DataFrame:
    """df with its columns renamed for one side of a join: id_a, a_low0, ..."""
    return df.select(F.col("id").alias(f"id_{name}"), *(F.col(c).alias(f"{name}_{c}") for c in SIDES), *more)


def intersects(boundary: str = "closed") -> Column:
    a, b = ({c: F.col(f"{x}_{c}") for c in SIDES} for x in "ab")
    if boundary == "closed":
        return (a["low0"] <= b["high0"]) & (a["high0"] >= b["low0"]) & (a["low1"] <= b["high1"]) & (a["high1"] >= b["low1"])
    if boundary == "open":
        return (a["low0"] < b["high0"]) & (a["high0"] > b["low0"]) & (a["low1"] < b["high1"]) & (a["high1"] > b["low1"])
    raise ValueError(f"boundary: {boundary}")


def contains(outer: str = "a", inner: str = "b") -> Column:
    """inner lies in outer, borders included (also where it only touches the border from inside)."""
    o, i = ({c: F.col(f"{x}_{c}") for c in SIDES} for x in (outer, inner))
    return (o["low0"] <= i["low0"]) & (i["high0"] <= o["high0"]) & (o["low1"] <= i["low1"]) & (i["high1"] <= o["high1"])


def overlaps() -> Column:
    """The interiors meet, and neither covers the other."""
    return intersects("open") & ~contains("a", "b") & ~contains("b", "a")


def distance_squared() -> Column:
    gap = [F.greatest(F.lit(0.0), F.col(f"a_low{d}") - F.col(f"b_high{d}"), F.col(f"b_low{d}") - F.col(f"a_high{d}")) for d in (0, 1)]
    return gap[0] * gap[0] + gap[1] * gap[1]


def predicate(name: str, boundary: str = "closed", distance: float | None = None) -> Column:
    """The join condition of `name`: intersects, contains, within, overlaps or distance."""
    if name == "intersects":
        return intersects(boundary)
    if name == "contains":
        return contains("a", "b")
    if name == "within":
        return contains("b", "a")
    if name == "overlaps":
        return overlaps()
    if name == "distance" and distance is not None and distance >= 0:
        return distance_squared() <= F.lit(float(distance) ** 2)
    raise ValueError(f"predicate: {name}, distance: {distance}")


def register(spark: SparkSession) -> None:
    """SQL functions mbr_intersects, mbr_intersects_open, mbr_contains and mbr_distance: inlined by Catalyst."""
    args = ", ".join(f"{x}_{c} DOUBLE" for x in "ab" for c in SIDES)
    for name, kind, body in (
        ("mbr_intersects", "BOOLEAN", "a_low0 <= b_high0 AND a_high0 >= b_low0 AND a_low1 <= b_high1 AND a_high1 >= b_low1"),
        ("mbr_intersects_open", "BOOLEAN", "a_low0 < b_high0 AND a_high0 > b_low0 AND a_low1 < b_high1 AND a_high1 > b_low1"),
        ("mbr_contains", "BOOLEAN", "a_low0 <= b_low0 AND b_high0 <= a_high0 AND a_low1 <= b_low1 AND b_high1 <= a_high1"),
        ("mbr_distance", "DOUBLE", "sqrt(pow(greatest(0D, a_low0 - b_high0, b_low0 - a_high0), 2) + pow(greatest(0D, a_low1 - b_high1, b_low1 - a_high1), 2))"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")


def register_cells(spark: SparkSession, grid) -> None:
    """SQL functions of a grid, by which a spatial join in SQL text is an equi-join on cells (also register()ed: the predicates).

    mbr_cells(low0, high0, low1, high1) is a table function, rows (cx, cy) of each cell that a rectangle meets, for
    LATERAL; none for null or NaN coordinates and for low > high. mbr_owns(cx, cy, a_low0, a_low1, b_low0, b_low1): is it the
    one cell that keeps the pair? The functions hold for the session and this grid.
    """
    register(spark)

    def cell(d: int, x: str) -> str:
        low, high, n = (grid.low0, grid.high0, grid.n0) if d == 0 else (grid.low1, grid.high1, grid.n1)
        return f"CAST(least({n - 1}, greatest(0, floor(({x} - ({low!r}D)) / ({high - low!r}D) * {n}))) AS BIGINT)" if high > low else "0L"

    across, up = (f"sequence({cell(d, f'low{d}')}, {cell(d, f'high{d}')})" for d in (0, 1))
    cells = f"explode(flatten(transform({across}, i -> transform({up}, j -> struct(i AS cx, j AS cy)))))"
    sides = ", ".join(f"{c} DOUBLE" for c in SIDES)
    # NaN is above all numbers here, so that high < NaN tells it
    numbers = "low0 <= high0 AND low1 <= high1 AND high0 < double('NaN') AND high1 < double('NaN')"
    array = cells.replace("explode(", f"explode(CASE WHEN {numbers} THEN ", 1)[:-1] + " END)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION mbr_cells({sides}) RETURNS TABLE (cx BIGINT, cy BIGINT) RETURN SELECT t.cx, t.cy FROM (SELECT {array} AS t)")
    corner = [cell(d, f"greatest(a_low{d}, b_low{d})") for d in (0, 1)]
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION mbr_owns(cx BIGINT, cy BIGINT, a_low0 DOUBLE, a_low1 DOUBLE, b_low0 DOUBLE, b_low1 DOUBLE) RETURNS BOOLEAN RETURN cx = {corner[0]} AND cy = {corner[1]}")
