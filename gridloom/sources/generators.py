"""Seeded synthetic rectangles and points from spark.range."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _boxes(rows: DataFrame, edge: float) -> DataFrame:
    return rows.select("id", F.col("x").alias("low0"), (F.col("x") + edge).alias("high0"), F.col("y").alias("low1"), (F.col("y") + edge).alias("high1"))


def uniform(spark: SparkSession, n: int, *, map_edge: float = 10000.0, edge: float = 1.0, seed: int = 1) -> DataFrame:
    """Squares of side `edge` (0: points) with corners uniform over the map, two decimals."""
    return _boxes(spark.range(n).select("id", F.round(F.rand(seed) * map_edge, 2).alias("x"), F.round(F.rand(seed + 1) * map_edge, 2).alias("y")), edge)


def _spread(spark: SparkSession, n: int, x: Column, y: Column, map_edge: float, edge: float, angle: float) -> DataFrame:
    clip = lambda c: F.least(F.lit(map_edge), F.greatest(F.lit(0.0), c))
    boxes = _boxes(spark.range(n).select("id", F.round(clip(x), 2).alias("x"), F.round(clip(y), 2).alias("y")), edge)
    if not angle:
        return boxes
    c, s = math.cos(angle), math.sin(angle)
    corners = F.array(*(F.struct((F.col(a) * c - F.col(b) * s).alias("x"), (F.col(a) * s + F.col(b) * c).alias("y")) for a in ("low0", "high0") for b in ("low1", "high1")))
    from ..functions.geometry import envelope

    return boxes.select("id", corners.alias("ring")).select("id", *envelope(F.col("ring")))


def gaussian(spark: SparkSession, n: int, *, mean: float = 5000.0, sd: float = 1000.0, map_edge: float = 10000.0, edge: float = 1.0, angle: float = 0.0, seed: int = 1) -> DataFrame:
    """Normal corners, clipped to the map; boxes around the squares turned by `angle`."""
    return _spread(spark, n, F.randn(seed) * sd + mean, F.randn(seed + 1) * sd + mean, map_edge, edge, angle)


def exponential(spark: SparkSession, n: int, *, scale: float = 1000.0, shift: float = 0.0, map_edge: float = 10000.0, edge: float = 1.0, angle: float = 0.0, seed: int = 1) -> DataFrame:
    """Exponential corners, clipped to the map; boxes around the squares turned by `angle`."""
    draw = lambda s: -F.log(1 - F.rand(s)) * scale + shift
    return _spread(spark, n, draw(seed), draw(seed + 1), map_edge, edge, angle)


def selective(spark: SparkSession, n: int, share: float) -> tuple[DataFrame, DataFrame]:
    """Two sides of n boxes: the first share * n of a meet all of b, the others none."""
    four = lambda *v: [F.lit(x).alias(c) for x, c in zip(v, ("low0", "high0", "low1", "high1"), strict=True)]
    hit = F.col("id") < int(n * share)
    a = spark.range(n).select("id", *(F.when(hit, h).otherwise(m).alias(c) for c, h, m in (("low0", 0.0, 0.0), ("high0", 1.0, 0.5), ("low1", 0.0, 0.0), ("high1", 1.0, 0.5))))
    return a, spark.range(n).select("id", *four(0.6, 1.0, 0.6, 1.0))


def tiles(spark: SparkSession, n_tiles: int, per_tile: int, *, edge: float = 1.0, span: float = 100.0, seed: int = 1) -> DataFrame:
    """Rows (tile, id, low0, high0, low1, high1): per_tile squares in each of n_tiles equal maps of side span."""
    ids = spark.range(n_tiles * per_tile)
    at = lambda s: F.round(F.rand(s) * (span - edge), 2)
    return _boxes(ids.select("id", at(seed).alias("x"), at(seed + 1).alias("y")), edge).select(F.floor(F.col("id") / per_tile).alias("tile"), "id", "low0", "high0", "low1", "high1")


def random_tree(spark: SparkSession, depth: int, fanout: int, *, map_edge: float = 10000.0, seed: int = 1):
    """A tree of `depth` levels whose nodes have `fanout` children each, at random inside their parent: a fixture for joins.

    Node k's children are k * fanout and on. Objects are the children of the lowest level.
    """
    from ..operators.index import Tree
    from ..operators.partition import checkpointed

    level = _boxes(spark.range(1).select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), map_edge)
    levels = []
    for k in range(depth):
        here = checkpointed(level.withColumn("parent", F.floor(F.col("id") / fanout).cast("long")))
        levels.insert(0, here.select(F.col("id").alias("node"), F.lit(fanout).cast("long").alias("n"), "low0", "high0", "low1", "high1", "parent"))
        child = here.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(fanout - 1)))).withColumn("id", F.col("id") * fanout + F.col("c"))
        cut = lambda d, s: F.col(f"low{d}") + (F.col(f"high{d}") - F.col(f"low{d}")) * F.rand(s)
        four = [cut(d, seed + 4 * k + 2 * d + i) for d in (0, 1) for i in (0, 1)]
        drawn = checkpointed(child.select("id", *(c.alias(n) for c, n in zip(four, "abcd", strict=True))))
        level = drawn.select("id", F.least("a", "b").alias("low0"), F.greatest("a", "b").alias("high0"), F.least("c", "d").alias("low1"), F.greatest("c", "d").alias("high1"))
    return Tree(level.withColumn("leaf", F.floor(F.col("id") / fanout).cast("long")), levels)
