"""Driver queries of the spatial operators and their SQL: plain theta joins over the same derived rectangles."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geometry
from ..functions.predicates import register_cells, valid
from ..operators import index, partition
from ..operators.cover import points_in_shapes
from ..operators.shapes import nearest_shapes, shape_join
from ..operators.join import as_rects, nearest, spatial_join, tile_join as tiles
from ..sources.readers import wkt_of

Query = Callable[[SparkSession, str], DataFrame]

RECTS_A = """SELECT p_partkey AS id, CAST(p_partkey*7919%10000 AS DOUBLE) AS low0, CAST(p_partkey*7919%10000 + p_size AS DOUBLE) AS high0,
 CAST(p_partkey*6151%10000 AS DOUBLE) AS low1, CAST(p_partkey*6151%10000 + p_size AS DOUBLE) AS high1 FROM {part}"""
RECTS_B = """SELECT o_orderkey AS id, CAST(o_orderkey*3571%10000 AS DOUBLE) AS low0, CAST(o_orderkey*3571%10000 + 1 + o_orderkey%40 AS DOUBLE) AS high0,
 CAST(o_custkey*4813%10000 AS DOUBLE) AS low1, CAST(o_custkey*4813%10000 + 1 + o_custkey%40 AS DOUBLE) AS high1 FROM {orders}"""
POINTS = """SELECT event_id AS id, CAST(event_id*2969%10000 AS DOUBLE) AS x, CAST(user_id*1543%10000 + event_id%100 AS DOUBLE) AS y FROM {events}"""
#: A grid over the whole map for the statistics queries, whose rows depend on it.
MAP = partition.Grid(0.0, 10064.0, 0.0, 10128.0, 16, 16)
REACH = 25.0
#: Small squares at cubes of even places, so that they crowd in a corner of the map.
CROWDED = """SELECT id, x*x*x/1e8 AS low0, x*x*x/1e8 + w AS high0, y*y*y/1e8 AS low1, y*y*y/1e8 + w AS high1 FROM
 (SELECT {id} AS id, CAST({id}*{m0}%10000 AS DOUBLE) AS x, CAST({of}*{m1}%10000 AS DOUBLE) AS y, CAST(1 + {of}%4 AS DOUBLE) AS w FROM {table}) AS places"""
CROWDS = {"part": {"id": "p_partkey", "of": "p_partkey", "m0": 7919, "m1": 6151}, "orders": {"id": "o_orderkey", "of": "o_custkey", "m0": 3571, "m1": 4813}}
#: What keys are multiplied with for the centres of diamonds.
BALLS = {"part": (7919, 6151), "orders": (3571, 4813)}


def rects_a(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(RECTS_A.format(part="{part}"), part=spark.read.parquet(f"{d}/part.parquet"))


def rects_b(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(RECTS_B.format(orders="{orders}"), orders=spark.read.parquet(f"{d}/orders.parquet"))


def points(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(POINTS.format(events="{events}"), events=spark.read.parquet(f"{d}/events.parquet"))


def few(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as rectangles: the small side of the strategies that compare all pairs."""
    s = spark.read.parquet(f"{d}/supplier.parquet")
    at = lambda c, m, w: (F.col(c) * m % 10000 + w).cast("double")
    return s.select(F.col("s_suppkey").alias("id"), at("s_suppkey", 7919, 0).alias("low0"), at("s_suppkey", 7919, 300).alias("high0"), at("s_suppkey", 6151, 0).alias("low1"), at("s_suppkey", 6151, 300).alias("high1"))


FEW = """SELECT s_suppkey AS id, CAST(s_suppkey*7919%10000 AS DOUBLE) AS low0, CAST(s_suppkey*7919%10000 + 300 AS DOUBLE) AS high0,
 CAST(s_suppkey*6151%10000 AS DOUBLE) AS low1, CAST(s_suppkey*6151%10000 + 300 AS DOUBLE) AS high1 FROM supplier"""


def crowded(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.sql(CROWDED.format(table="{t}", **CROWDS[table]), t=spark.read.parquet(f"{d}/{table}.parquet"))


def _join(spark: SparkSession, d: str, right: Callable = rects_b, left: Callable = rects_a, **options) -> DataFrame:
    return spatial_join(left(spark, d), right(spark, d), **options)


def pip(spark: SparkSession, d: str, **options) -> DataFrame:
    return spatial_join(as_rects(points(spark, d)), rects_a(spark, d), **options)


def diamonds(spark: SparkSession, d: str) -> DataFrame:
    """Polygons: the diamonds inside rects_a, parsed from text."""
    a = rects_a(spark, d)
    mx, my = (F.col("low0") + F.col("high0")) / 2, (F.col("low1") + F.col("high1")) / 2
    wkt = F.format_string("POLYGON((%s %s, %s %s, %s %s, %s %s, %s %s))", *(c.cast("string") for c in (F.col("low0"), my, mx, F.col("low1"), F.col("high0"), my, mx, F.col("high1"), F.col("low0"), my)))
    return a.select("id", geometry.ring(wkt).alias("ring"))


def pip_polygon(spark: SparkSession, d: str) -> DataFrame:
    return geometry.points_in_polygons(points(spark, d).withColumn("x", F.col("x") + 0.25).withColumn("y", F.col("y") + 0.125), diamonds(spark, d))


#: Equal rectangles are compared once, as a row with their number; the cells make it an equi-join.
COUNT_JOIN = """
WITH few AS (SELECT low0, high0, low1, high1, count(*) AS n FROM {a} GROUP BY ALL), many AS (SELECT low0, high0, low1, high1, count(*) AS n FROM {b} GROUP BY ALL)
SELECT /*+ MERGE(b) */ coalesce(sum(a.n * b.n), 0L) AS n
FROM (SELECT * FROM few r, LATERAL mbr_cells(r.low0, r.high0, r.low1, r.high1)) a
JOIN (SELECT * FROM many r, LATERAL mbr_cells(r.low0, r.high0, r.low1, r.high1)) b
  ON a.cx = b.cx AND a.cy = b.cy AND mbr_owns(a.cx, a.cy, a.low0, a.low1, b.low0, b.low1)
  AND mbr_intersects(a.low0, a.high0, a.low1, a.high1, b.low0, b.high0, b.low1, b.high1)
"""


def count_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (n): how many pairs of rectangles meet, in SQL text."""
    register_cells(a.sparkSession, partition.sized_grid(valid(a), valid(b)) or MAP)
    return a.sparkSession.sql(COUNT_JOIN, a=a, b=b)


def sql_join(spark: SparkSession, d: str) -> DataFrame:
    return count_join(few(spark, d), rects_b(spark, d))


#: A spatial join of two large tables in SQL text: the cells make it an equi-join.
LATERAL_JOIN = """
SELECT /*+ MERGE(b) */ a.id AS id_a, b.id AS id_b
FROM (SELECT * FROM {a} r, LATERAL mbr_cells(r.low0, r.high0, r.low1, r.high1)) a
JOIN (SELECT * FROM {b} r, LATERAL mbr_cells(r.low0, r.high0, r.low1, r.high1)) b
  ON a.cx = b.cx AND a.cy = b.cy AND mbr_owns(a.cx, a.cy, a.low0, a.low1, b.low0, b.low1)
  AND mbr_intersects(a.low0, a.high0, a.low1, a.high1, b.low0, b.high0, b.low1, b.high1)
"""


def lateral_join(a: DataFrame, b: DataFrame) -> DataFrame:
    register_cells(a.sparkSession, partition.sized_grid(valid(a), valid(b)) or MAP)
    return a.sparkSession.sql(LATERAL_JOIN, a=a, b=b)


def map_bounds(spark: SparkSession, d: str) -> DataFrame:
    return partition.bounds(valid(rects_a(spark, d)), valid(rects_b(spark, d))).select("low0", "high0", "low1", "high1", "n")


def str_leaves(spark: SparkSession, d: str) -> DataFrame:
    return index.leaves(valid(rects_b(spark, d)), 16).select("id", "leaf")


def str_node_mbrs(spark: SparkSession, d: str) -> DataFrame:
    return index.nodes(index.build(valid(rects_b(spark, d)), 16))


def refine_cells(spark: SparkSession, d: str) -> DataFrame:
    return partition.refined_cells(valid(rects_a(spark, d)), valid(rects_b(spark, d)), partition.Grid(0.0, 10064.0, 0.0, 10128.0, 8, 8), max_comparisons=1000, depth=3)


def balls(spark: SparkSession, d: str, table: str, key: str, half: str) -> DataFrame:
    """Polygons: diamonds whose half diagonals are equal, as text."""
    at = spark.read.parquet(f"{d}/{table}.parquet").select(F.col(key).alias("id"), *(F.expr(f"{key} * {m} % 10000").alias(c) for m, c in zip(BALLS[table], "xy", strict=True)), F.expr(half).alias("h"))
    wkt = F.format_string("POLYGON((%s %s, %s %s, %s %s, %s %s))", *(F.expr(e).cast("string") for e in ("x - h", "y", "x", "y - h", "x + h", "y", "x", "y + h")))
    return at.select("id", wkt.alias("wkt"))


def ball_join(spark: SparkSession, d: str, name: str) -> DataFrame:
    return shape_join(balls(spark, d, "part", "p_partkey", "p_size"), balls(spark, d, "orders", "o_orderkey", "1 + o_orderkey % 40"), predicate_name=name)


def polygon_distance(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles as polygons of two kinds: rings and texts of several parts."""
    some = lambda rects: wkt_of(rects(spark, d)).select("id", F.regexp_replace("wkt", r"POLYGON\(\((.*)\)\)", "MULTIPOLYGON((($1)))").alias("wkt"))
    return shape_join(some(rects_a), some(rects_b), predicate_name="distance", distance=REACH)


def lines(spark: SparkSession, d: str, rects: Callable, across: bool) -> DataFrame:
    """The lower sides of rectangles (across) or their left sides, as text: paths of two segments."""
    ends = ("low0", "low1", "high0", "low1") if across else ("low0", "low1", "low0", "high1")
    middle = ("(low0 + high0) / 2", "low1") if across else ("low0", "(low1 + high1) / 2")
    wkt = F.format_string("LINESTRING(%s %s, %s %s, %s %s)", *(F.expr(e).cast("string") for e in (*ends[:2], *middle, *ends[2:])))
    return rects(spark, d).select("id", wkt.alias("wkt"))


def spots(spark: SparkSession, d: str) -> DataFrame:
    wkt = F.format_string("POINT(%s %s)", F.col("x").cast("string"), F.col("y").cast("string"))
    return points(spark, d).select("id", wkt.alias("wkt"))


def mixed_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Points, lines and polygons in one table, told apart by their ids modulo 3."""
    numbered = lambda t, k: t.withColumn("id", 3 * F.col("id") + k)
    return numbered(spots(spark, d), 0).unionByName(numbered(lines(spark, d, rects_b, True), 1)).unionByName(numbered(balls(spark, d, "orders", "o_orderkey", "1 + o_orderkey % 40"), 2))


def pip_holes(spark: SparkSession, d: str) -> DataFrame:
    """Points in squares with a square hole of half their side."""
    a = rects_a(spark, d).withColumn("q", (F.col("high0") - F.col("low0")) / 4)
    box = lambda q: [e for x, y in (("low0", "low1"), ("high0", "low1"), ("high0", "high1"), ("low0", "high1")) for e in (F.col(x) + (q if x == "low0" else -q), F.col(y) + (q if y == "low1" else -q))]
    pair = ", ".join(["%s %s"] * 4)
    wkt = F.format_string(f"POLYGON(({pair}), ({pair}))", *(c.cast("string") for c in [*box(F.lit(0.0)), *box(F.col("q"))]))
    moved = points(spark, d).withColumn("x", F.col("x") + 0.3).withColumn("y", F.col("y") + 0.3)
    return geometry.points_in_polygons(moved, a.select("id", geometry.rings(wkt).alias("rings")))


def saved_tree(spark: SparkSession, d: str) -> DataFrame:
    """A tree that is saved, loaded and joined with rectangles that have none."""
    path = f"{partition.shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    index.save(index.build(valid(rects_b(spark, d))), path)
    return index.joined(rects_a(spark, d), index.load(spark, path))


WINDOW = (1000.0, 3000.0, 2500.0, 4000.0)


def window_select(spark: SparkSession, d: str) -> DataFrame:
    """A window over a saved tree."""
    path = f"{partition.shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    index.save(index.build(valid(rects_b(spark, d))), path)
    return index.selected(index.load(spark, path), WINDOW)


def mixed_a(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles of very different extents."""
    return rects_a(spark, d).unionByName(few(spark, d).withColumn("id", -F.col("id")).withColumn("high0", F.col("high0") + 5000))


def quadtree(spark: SparkSession, d: str) -> DataFrame:
    return partition.quadtree(points(spark, d), partition.Grid(0.0, 10240.0, 0.0, 10240.0, 1, 1), most=40, depth=6)


def tile_join(spark: SparkSession, d: str) -> DataFrame:
    return tiles(rects_a(spark, d).withColumn("tile", F.col("id") % 64), rects_b(spark, d).withColumn("tile", F.col("id") % 64))


def queries() -> dict[str, Query]:
    joins = {f"mbr_join_{n}": partial(_join, algorithm=n) for n in ("grid", "adaptive", "sort_tile", "binary_split", "rtree", "inlj", "sweep")}
    return joins | {
        "mbr_join_stripe_x": partial(_join, algorithm="stripes_x", n=128),
        "mbr_join_stripe_y": partial(_join, algorithm="stripes_y", n=128),
        "mbr_join_nested": partial(_join, left=few, algorithm="nested"),
        "mbr_join_broadcast": partial(_join, left=rects_b, right=few, algorithm="broadcast"),
        "mbr_join_packed": lambda s, d: spatial_join(crowded(s, d, "part"), crowded(s, d, "orders"), algorithm="packed"),
        "mbr_join_open": partial(_join, boundary="open"),
        "mbr_join_float32": partial(_join, precision="float32"),
        "mbr_join_saved": saved_tree,
        "window_select": window_select,
        "mbr_join_mixed": partial(_join, left=mixed_a),
        "tile_join": tile_join,
        "quadtree": quadtree,
        "polygon_intersects": partial(ball_join, name="intersects"),
        "polygon_contains": partial(ball_join, name="contains"),
        "polygon_within": partial(ball_join, name="within"),
        "polygon_overlaps": partial(ball_join, name="overlaps"),
        "polygon_distance": polygon_distance,
        "line_line_join": lambda s, d: shape_join(lines(s, d, rects_a, False), lines(s, d, rects_b, True)),
        "point_line_join": lambda s, d: shape_join(spots(s, d), lines(s, d, rects_b, True), predicate_name="within"),
        "line_polygon_join": lambda s, d: shape_join(lines(s, d, rects_b, True), balls(s, d, "part", "p_partkey", "p_size")),
        "polygon_contains_line": lambda s, d: shape_join(balls(s, d, "part", "p_partkey", "p_size"), lines(s, d, rects_b, True), predicate_name="contains"),
        "mixed_shapes_join": lambda s, d: shape_join(balls(s, d, "part", "p_partkey", "p_size"), mixed_shapes(s, d)),
        "pip_quadtree": lambda s, d: points_in_shapes(points(s, d), balls(s, d, "part", "p_partkey", "p_size")),
        "pip_quadtree_open": lambda s, d: points_in_shapes(points(s, d), balls(s, d, "part", "p_partkey", "p_size"), boundary="open"),
        "nearest_line": lambda s, d: nearest_shapes(spots(s, d), lines(s, d, rects_b, True), REACH),
        "pip_holes": pip_holes,
        "pip_join": pip,
        "pip_join_open": partial(pip, boundary="open"),
        "pip_polygon_join": pip_polygon,
        "self_join": partial(_join, right=rects_a),
        "self_join_no_identity": partial(_join, right=rects_a, exclude_self=True),
        "contains_join": partial(_join, predicate_name="contains"),
        "within_join": partial(_join, predicate_name="within"),
        "overlaps_join": partial(_join, predicate_name="overlaps"),
        "distance_join": partial(_join, predicate_name="distance", distance=REACH),
        "nearest_join": lambda s, d: nearest(rects_a(s, d), rects_b(s, d), REACH),
        "semi_join": partial(_join, how="semi"),
        "anti_join": partial(_join, how="anti"),
        "join_count": lambda s, d: _join(s, d).agg(F.count("*").alias("n")),
        "sql_join_count": sql_join,
        "sql_lateral_join": lambda s, d: lateral_join(*(t(s, d).withColumn("id", F.col("id").cast("long")) for t in (rects_a, rects_b))),
        "map_bounds": map_bounds,
        "grid_histogram": lambda s, d: partition.histogram(valid(rects_b(s, d)), MAP),
        "partition_stats": lambda s, d: partition.statistics(valid(rects_a(s, d)), valid(rects_b(s, d)), MAP),
        "heatmap": lambda s, d: partition.heatmap(valid(rects_b(s, d)), MAP),
        "median_extent": lambda s, d: partition.median_extent(valid(rects_b(s, d))),
        "refine_cells": refine_cells,
        "str_leaves": str_leaves,
        "str_node_mbrs": str_node_mbrs,
        "duplicate_customers": lambda s, d: index.duplicate_ids(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("id"))),
    }


def ball(table: str, key: str, half: str) -> str:
    return f"SELECT {key}::BIGINT AS id, {key} * {BALLS[table][0]} % 10000 AS x, {key} * {BALLS[table][1]} % 10000 AS y, {half} AS h FROM {table}"


def balls_sql(on: str) -> str:
    """Diamonds are balls of the city-block distance d of their centres."""
    on = on.replace("d ", "abs(a.x - b.x) + abs(a.y - b.y) ", 1)
    return f"WITH a AS ({ball('part', 'p_partkey', 'p_size')}), b AS ({ball('orders', 'o_orderkey', '1 + o_orderkey % 40')}) SELECT a.id::BIGINT AS id_a, b.id::BIGINT AS id_b FROM a JOIN b ON {on}"


def quadtree_sql(p: str, most: int = 40, depth: int = 6) -> str:
    """Counts of every level; a leaf has few points or is deepest, and its parent has many."""
    cell = lambda c, k: f"least({2**k - 1}, greatest(0, floor({c} / 10240.0::DOUBLE * {2**k})))::BIGINT"
    counts = ", ".join(f"n{k} AS (SELECT {cell('x', k)} AS cx, {cell('y', k)} AS cy, count(*) AS n FROM p GROUP BY ALL)" for k in range(depth + 1))
    leaf = lambda k: f"SELECT {k}::INTEGER AS level, c.cx, c.cy, c.n FROM n{k} c" + (f" JOIN n{k - 1} u ON u.cx = c.cx // 2 AND u.cy = c.cy // 2 AND u.n > {most}" if k else "") + (f" WHERE c.n <= {most}" if k < depth else "")
    return f"WITH p AS ({p}), {counts} " + " UNION ALL ".join(leaf(k) for k in range(depth + 1))


def refine_sql(a: str, b: str, most: int = 1000, most_b: int = 100, depth: int = 3) -> str:
    """Cells of both sides, level by level; those below heavy ones only."""
    cell = lambda c, w, k: f"least({8 * 2**k - 1}, greatest(0, floor({c} / {w}::DOUBLE * {8 * 2**k})))::BIGINT"
    at = lambda c, w, k: f"unnest(range({cell('low' + c, w, k)}, {cell('high' + c, w, k)} + 1))"
    count = lambda t, k: f"SELECT cx, {at('1', '10128.0', k)} AS cy, 1 AS one FROM (SELECT *, {at('0', '10064.0', k)} AS cx FROM {t})"
    ctes = [f"a AS ({a})", f"b AS ({b})"]
    for k in range(depth + 1):
        both = " JOIN ".join(f"(SELECT cx, cy, count(*) AS n_{t} FROM ({count(t, k)}) GROUP BY cx, cy)" for t in "ab")
        up = f" JOIN (SELECT cx AS ux, cy AS uy FROM c{k - 1} WHERE heavy) ON ux = cx // 2 AND uy = cy // 2" if k else ""
        ctes.append(f"c{k} AS (SELECT {k}::INTEGER AS level, cx, cy, n_a, n_b, {'(n_a * n_b > %d OR n_b > %d)' % (most, most_b) if k < depth else 'false'} AS heavy FROM {both} USING (cx, cy){up})")
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(f"SELECT level, cx, cy, n_a, n_b FROM c{k} WHERE NOT heavy" for k in range(depth + 1))


def oracle_sql() -> dict[str, str]:
    a, b, p = RECTS_A.format(part="part"), RECTS_B.format(orders="orders"), POINTS.format(events="events")
    closed = "a.low0 <= b.high0 AND a.high0 >= b.low0 AND a.low1 <= b.high1 AND a.high1 >= b.low1"
    opened = "a.low0 < b.high0 AND a.high0 > b.low0 AND a.low1 < b.high1 AND a.high1 > b.low1"
    inside = "{o}.low0 <= {i}.low0 AND {i}.high0 <= {o}.high0 AND {o}.low1 <= {i}.low1 AND {i}.high1 <= {o}.high1"
    a_in_b, b_in_a = inside.format(o="b", i="a"), inside.format(o="a", i="b")
    d2 = "(pow(greatest(0.0::DOUBLE, a.low0 - b.high0, b.low0 - a.high0), 2) + pow(greatest(0.0::DOUBLE, a.low1 - b.high1, b.low1 - a.high1), 2))"
    pts = f"SELECT id, x AS low0, x AS high0, y AS low1, y AS high1 FROM ({p})"

    def join(on: str, left: str = a, right: str = b, what: str = "a.id::BIGINT AS id_a, b.id::BIGINT AS id_b") -> str:
        return f"WITH a AS ({left}), b AS ({right}) SELECT {what} FROM a JOIN b ON {on}"

    cells = "least(15, greatest(0, floor(({x} - 0.0) / {w} * 16)))::BIGINT"
    cx, cy = (lambda x: cells.format(x=x, w="10064.0::DOUBLE")), (lambda y: cells.format(x=y, w="10128.0::DOUBLE"))
    spread = lambda t: f"SELECT cx, unnest(range({cy('low1')}, {cy('high1')} + 1)) AS cy FROM (SELECT *, unnest(range({cx('low0')}, {cx('high0')} + 1)) AS cx FROM ({t}))"
    hist = lambda t: f"SELECT cx, cy, count(*) AS n FROM ({spread(t)}) GROUP BY cx, cy"
    leaf = f"""WITH b AS ({b}), c AS (SELECT count(*) AS n FROM b), s AS (SELECT greatest(1, floor(sqrt(ceil(n / 16.0))))::BIGINT AS s FROM c),
        r AS (SELECT *, (row_number() OVER (ORDER BY low0, id) - 1) // (s * 16) AS slice, s FROM b, s),
        leaves AS (SELECT id::BIGINT AS id, low0, high0, low1, high1, (slice * s + (row_number() OVER (PARTITION BY slice ORDER BY low1, id) - 1) // 16)::BIGINT AS leaf FROM r)"""
    levels, parts = "", []
    for k in range(6):  # 16**6 leaves at most
        source = "(SELECT leaf AS node, low0, high0, low1, high1 FROM leaves)" if k == 0 else f"(SELECT node // 16 AS node, low0, high0, low1, high1 FROM l{k - 1} WHERE (SELECT count(*) FROM l{k - 1}) > 1)"
        levels += f", l{k} AS (SELECT node, count(*) AS n, min(low0) AS low0, max(high0) AS high0, min(low1) AS low1, max(high1) AS high1 FROM {source} GROUP BY node)"
        parts.append(f"SELECT {k}::INTEGER AS level, node, n, low0, high0, low1, high1 FROM l{k}")
    on_line = "a.low1 = b.low1 AND a.low0 BETWEEN b.low0 AND b.high0"
    to_line = "(pow(greatest(0.0::DOUBLE, b.low0 - a.low0, a.low0 - b.high0), 2) + pow(a.low1 - b.low1, 2))"

    def in_ball(less: str) -> str:
        return f"WITH a AS ({ball('part', 'p_partkey', 'p_size')}), b AS ({p}) SELECT b.id::BIGINT AS id_a, a.id AS id_b FROM a JOIN b ON abs(a.x - b.x) + abs(a.y - b.y) {less} a.h"

    def line_ball(on: str, what: str) -> str:
        """The lower sides of rects_b as a, the diamonds of parts as b."""
        return f"WITH a AS ({b}), b AS ({ball('part', 'p_partkey', 'p_size')}) SELECT {what} FROM a JOIN b ON {on.format(dy='abs(a.low1 - b.y)')}"

    diamond = "abs(p.x + 0.25 - (a.low0 + a.high0) / 2) / ((a.high0 - a.low0) / 2) + abs(p.y + 0.125 - (a.low1 + a.high1) / 2) / ((a.high1 - a.low1) / 2) < 1"
    return {f"mbr_join_{n}": join(closed) for n in ("grid", "adaptive", "sort_tile", "binary_split", "rtree", "inlj", "sweep", "saved", "stripe_x", "stripe_y", "float32")} | {
        "mbr_join_mixed": join(closed, left=f"{a} UNION ALL SELECT -id, low0, high0 + 5000, low1, high1 FROM ({FEW})"),
        "tile_join": join(f"{closed} AND a.id % 64 = b.id % 64", what="(a.id % 64)::BIGINT AS tile, a.id::BIGINT AS id_a, b.id::BIGINT AS id_b"),
        "quadtree": quadtree_sql(p),
        "refine_cells": refine_sql(a, b),
        "polygon_intersects": balls_sql("d <= a.h + b.h"),
        "polygon_contains": balls_sql("d + b.h <= a.h"),
        "polygon_within": balls_sql("d + a.h <= b.h"),
        "polygon_overlaps": balls_sql("d < a.h + b.h AND abs(a.x - b.x) + abs(a.y - b.y) > abs(a.h - b.h)"),
        "line_line_join": join("a.low0 BETWEEN b.low0 AND b.high0 AND b.low1 BETWEEN a.low1 AND a.high1"),
        "point_line_join": join(f"{on_line} AND a.low0 > b.low0 AND a.low0 < b.high0", left=pts),
        "line_polygon_join": line_ball("b.h >= {dy} AND a.low0 <= b.x + (b.h - {dy}) AND a.high0 >= b.x - (b.h - {dy})", "a.id AS id_a, b.id AS id_b"),
        "polygon_contains_line": line_ball("b.h >= {dy} + abs(a.low0 - b.x) AND b.h >= {dy} + abs(a.high0 - b.x)", "b.id AS id_a, a.id AS id_b"),
        "mixed_shapes_join": f"""SELECT id_a, 3 * id_b AS id_b FROM (WITH a AS ({ball("part", "p_partkey", "p_size")}), b AS ({p}) SELECT a.id::BIGINT AS id_a, b.id::BIGINT AS id_b FROM a JOIN b ON abs(a.x - b.x) + abs(a.y - b.y) <= a.h)
            UNION ALL SELECT id_b, 3 * id_a + 1 FROM ({line_ball("b.h >= {dy} AND a.low0 <= b.x + (b.h - {dy}) AND a.high0 >= b.x - (b.h - {dy})", "a.id::BIGINT AS id_a, b.id::BIGINT AS id_b")})
            UNION ALL SELECT id_a, 3 * id_b + 2 FROM ({balls_sql("d <= a.h + b.h")})""",
        "pip_quadtree": in_ball("<="),
        "pip_quadtree_open": in_ball("<"),
        "nearest_line": f"""SELECT id_a, id_b, sqrt(d2) AS distance FROM ({join(f"{to_line} <= {REACH} * {REACH}", left=pts, what=f"a.id::BIGINT AS id_a, b.id::BIGINT AS id_b, {to_line} AS d2")})
            QUALIFY row_number() OVER (PARTITION BY id_a ORDER BY d2, id_b) = 1""",
        "polygon_distance": join(f"{d2} <= {REACH} * {REACH}"),
        "pip_holes": f"""WITH p AS ({p}), a AS (SELECT *, (high0 - low0) / 4 AS q FROM ({a})) SELECT p.id::BIGINT AS id_a, a.id::BIGINT AS id_b
            FROM p JOIN a ON p.x + 0.3 BETWEEN low0 AND high0 AND p.y + 0.3 BETWEEN low1 AND high1
            WHERE NOT (p.x + 0.3 BETWEEN low0 + q AND high0 - q AND p.y + 0.3 BETWEEN low1 + q AND high1 - q)""",
        "mbr_join_nested": join(closed, left=FEW),
        "mbr_join_broadcast": join(closed, left=b, right=FEW),
        "mbr_join_packed": join(closed, *(CROWDED.format(table=t, **c) for t, c in CROWDS.items())),
        "mbr_join_open": join(opened),
        "pip_join": join(closed, left=pts, right=a),
        "pip_join_open": join(opened, left=pts, right=a),
        "pip_polygon_join": f"WITH p AS ({p}), a AS ({a}) SELECT p.id::BIGINT AS id_a, a.id::BIGINT AS id_b FROM p JOIN a ON {diamond}",
        "self_join": join(closed, right=a),
        "self_join_no_identity": join(f"{closed} AND a.id <> b.id", right=a),
        "contains_join": join(b_in_a),
        "within_join": join(a_in_b),
        "overlaps_join": join(f"{opened} AND NOT ({a_in_b}) AND NOT ({b_in_a})"),
        "distance_join": join(f"{d2} <= {REACH} * {REACH}"),
        "nearest_join": f"SELECT id_a, id_b, sqrt(d2) AS distance FROM ({join(f'{d2} <= {REACH} * {REACH}', what=f'a.id::BIGINT AS id_a, b.id::BIGINT AS id_b, {d2} AS d2')}) QUALIFY row_number() OVER (PARTITION BY id_a ORDER BY d2, id_b) = 1",
        "semi_join": f"WITH a AS ({a}), b AS ({b}) SELECT id::BIGINT AS id_a FROM a WHERE EXISTS (SELECT 1 FROM b WHERE {closed})",
        "anti_join": f"WITH a AS ({a}), b AS ({b}) SELECT id::BIGINT AS id_a FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {closed})",
        "join_count": join(closed, what="count(*) AS n"),
        "sql_join_count": join(closed, left=FEW, what="count(*) AS n"),
        "sql_lateral_join": join(closed),
        "window_select": f"SELECT id::BIGINT AS id, low0, high0, low1, high1 FROM ({b}) WHERE low0 <= {WINDOW[1]} AND high0 >= {WINDOW[0]} AND low1 <= {WINDOW[3]} AND high1 >= {WINDOW[2]}",
        "map_bounds": f"SELECT min(low0) AS low0, max(high0) AS high0, min(low1) AS low1, max(high1) AS high1, count(*) AS n FROM ({a} UNION ALL {b})",
        "grid_histogram": hist(b),
        "partition_stats": f"SELECT count(*) AS n_partitions, sum(a.n + b.n)::BIGINT AS total, avg(a.n + b.n) AS average, max(a.n + b.n) AS most FROM ({hist(a)}) a JOIN ({hist(b)}) b USING (cx, cy)",
        "heatmap": f"SELECT {cx('(low0 + high0) / 2')} AS cx, {cy('(low1 + high1) / 2')} AS cy, count(*) AS n FROM ({b}) GROUP BY ALL",
        "median_extent": f"""WITH b AS (SELECT high0 - low0 AS w, high1 - low1 AS h FROM ({b})),
            r AS (SELECT w, h, row_number() OVER (ORDER BY w) - 1 AS i, row_number() OVER (ORDER BY h) - 1 AS j, count(*) OVER () AS n FROM b)
            SELECT max(w) FILTER (i = n // 2) AS width, max(h) FILTER (j = n // 2) AS height FROM r""",
        "str_leaves": f"{leaf} SELECT id, leaf FROM leaves",
        "str_node_mbrs": f"{leaf}{levels} " + " UNION ALL ".join(parts),
        "duplicate_customers": "SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1",
    }
