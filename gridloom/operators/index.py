"""Sort-tile-recursive trees as tables, and joins that descend them level by level.

A node is (level, node); the objects of leaf k and the children of node k are those whose parent number is k.
"""

from __future__ import annotations

import math
import warnings
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.predicates import SIDES, predicate, side, valid
from .partition import checkpointed, dealt, met, ranked

BOX = [F.min, F.max, F.min, F.max]


@dataclass
class Tree:
    objects: DataFrame  #: (id, SIDES, leaf)
    levels: list[DataFrame]  #: from the leaves, level 0, to the root: (node, parent, n, SIDES)
    sizes: list[int] | None = None  #: nodes of each level, where known

    def size(self, level: int) -> int:
        return self.sizes[level] if self.sizes else self.levels[level].count()


def leaves(df: DataFrame, node_size: int = 16) -> DataFrame:
    """df with `leaf`: by low0 into slices of S * node_size objects, in each by low1 into leaves of node_size; ties by id."""
    return _placed(df, node_size)[0]


def _placed(df: DataFrame, node_size: int) -> tuple[DataFrame, int | None]:
    """df with `leaf`, and the number of the last leaf; None if there are no rows."""
    rows, count = ranked(df, "low0", "id", "low1", "high0", "high1")
    across = max(1, math.isqrt(math.ceil(count / node_size)))
    per_slice = across * node_size
    pos = F.row_number().over(Window.partitionBy("_slice").orderBy("low1", "id", "rn")) - 1
    placed = rows.withColumn("_slice", F.floor(F.col("rn") / per_slice))
    placed = placed.withColumn("leaf", (F.col("_slice") * across + F.floor(pos / node_size)).cast("long")).drop("rn", "_slice")
    full, rest = divmod(count - 1, per_slice)
    return placed, full * across + rest // node_size if count else None


def build(df: DataFrame, node_size: int = 16) -> Tree:
    """The tree of valid rectangles; no levels if there are none.

    Leaves are written once; every level above is an aggregation of the leaf level, not of the one below, so no level
    waits for another.
    """
    placed, last = _placed(df, node_size)
    objects = checkpointed(placed)
    box = [F.sum("n").alias("n") if i < 0 else BOX[i](SIDES[i]).alias(SIDES[i]) for i in (-1, 0, 1, 2, 3)]
    lowest = checkpointed(objects.withColumn("n", F.lit(1).cast("long")).groupBy(F.col("leaf").alias("node")).agg(*box))
    if last is None:
        return Tree(objects, [])
    levels = _levels(lowest, last, node_size)
    return Tree(objects, levels, [last // node_size**k + 1 for k in range(len(levels))])


def _levels(lowest: DataFrame, last: int, node_size: int) -> list[DataFrame]:
    levels, k = [], 0
    while True:
        up = node_size**k
        if k:
            group = lowest.groupBy(F.floor(F.col("node") / up).cast("long").alias("node"))
            t = group.agg(F.countDistinct(F.floor(F.col("node") / (up // node_size))).alias("n"), *(f(c).alias(c) for f, c in zip(BOX, SIDES, strict=True)))
        else:
            t = lowest.select("node", "n", *SIDES)
        levels.append(t.withColumn("parent", F.floor(F.col("node") / node_size).cast("long")))
        if last // up == 0:
            return levels
        k += 1


def nodes(tree: Tree) -> DataFrame | None:
    """All nodes (level, node, n, SIDES)."""
    out = None
    for i, t in enumerate(tree.levels):
        t = t.select(F.lit(i).alias("level"), "node", "n", *SIDES)
        out = t if out is None else out.unionByName(t)
    return out


def duplicate_ids(df: DataFrame) -> DataFrame:
    """Rows (id, n) of ids that occur more than once."""
    return df.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def save(tree: Tree, path: str) -> None:
    """Writes the tables of the tree; objects lie in leaf order, so that row groups can be skipped by coordinates."""
    tree.objects.repartitionByRange("leaf").sortWithinPartitions("leaf").write.mode("overwrite").parquet(f"{path}/objects")
    for i, t in enumerate(tree.levels):
        t.write.mode("overwrite").parquet(f"{path}/level={i}")


#: Nodes of a level, at most, whose leaves a selection pushes into the scan as ranges.
RANGES = 64


def selected(tree: Tree, window: tuple[float, float, float, float], *, boundary: str = "closed") -> DataFrame:
    """Objects (id, SIDES) of a tree that meet the window (low0, high0, low1, high1): upper levels choose leaves, and only row groups with those are read.

    The levels are descended from the root while RANGES nodes at most meet the window; the leaves below them are ranges of
    numbers, a filter of bounded size that is pushed down to the objects, which save() sorted by leaf. What is read is then
    tested against the window itself. A window with low > high or NaN selects nothing.
    """
    low0, high0, low1, high1 = map(float, window)
    inside = (lambda x, y: x <= y) if boundary == "closed" else (lambda x, y: x < y)
    meets = inside(F.col("low0"), F.lit(high0)) & inside(F.lit(low0), F.col("high0")) & inside(F.col("low1"), F.lit(high1)) & inside(F.lit(low1), F.col("high1"))
    out = tree.objects.where(meets).select("id", *SIDES)
    if not (low0 <= high0 and low1 <= high1) or not tree.levels:
        return out.where(F.lit(False))
    at, chosen = len(tree.levels) - 1, [0]
    while at > 0:
        below = tree.levels[at - 1].where(F.col("parent").isin(chosen)).where(meets).select("node").limit(RANGES + 1).collect()
        if len(below) > RANGES:
            break
        at, chosen = at - 1, [r["node"] for r in below]
    # the first leaf of the second node above leaves tells how many leaves a node has; without one the root has all
    wide = tree.levels[0].where("parent = 1").agg(F.min("node")).first()[0] if len(tree.levels) > 1 else None
    if wide is None and at > 0:
        return out
    ranges: list[list[int]] = []
    for node in sorted(chosen):
        first, end = node * (wide or 1) ** at, (node + 1) * (wide or 1) ** at - 1
        if ranges and ranges[-1][1] + 1 == first:
            ranges[-1][1] = end
        else:
            ranges.append([first, end])
    among = F.lit(False)
    for first, end in ranges:
        among = among | F.col("leaf").between(first, end)
    return tree.objects.where(among).where(meets).select("id", *SIDES)


def load(spark, path: str) -> Tree:
    """A saved tree; its depth is the number of its level folders."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    depth = sum(f.getPath().getName().startswith("level=") for f in found)
    return Tree(spark.read.parquet(f"{path}/objects"), [spark.read.parquet(f"{path}/level={i}") for i in range(depth)])


def joined(a: DataFrame | Tree, b: Tree, *, predicate_name: str = "intersects", boundary: str = "closed", distance: float | None = None, node_size: int = 16) -> DataFrame:
    """Rows (id_a, id_b) of rectangles a, or of a tree of them, against a tree that was built or loaded before."""
    by = float(distance or 0.0) if predicate_name == "distance" else 0.0
    test = predicate(predicate_name, boundary, distance)
    left = a if isinstance(a, Tree) else valid(a)
    return traversed(left, b, test, by=by, node_size=node_size, whole_a=not isinstance(a, Tree)).select("id_a", "id_b")


def _meets(by: float) -> Column:
    a, b = ({c: F.col(f"{x}_{c}") for c in SIDES} for x in "ab")
    r = F.lit(by)
    return (a["low0"] - r <= b["high0"]) & (a["high0"] + r >= b["low0"]) & (a["low1"] - r <= b["high1"]) & (a["high1"] + r >= b["low1"])


def _as(t: DataFrame, name: str, key: str, up: str) -> DataFrame:
    return t.select(F.col(key).alias(f"node_{name}"), F.col(up).alias(f"up_{name}"), *(F.col(c).alias(f"{name}_{c}") for c in SIDES))


#: Nodes of a level that are broadcast in the descent, and pairs of a frontier beyond which it stops: the leaves below
#: are then paired by the grid, whose work does not grow with the overlap of upper nodes.
SMALL_LEVEL, FRONTIER = 100_000, 20_000_000
#: Nodes of the level that a descent of two trees begins with, at most, and of one by objects: levels above would be
#: steps of a few rows.
TOP, TOP_OBJECTS = 256, 32


def _top(tree: Tree, most: int) -> int:
    """The lowest level of at most `most` nodes, or the root's."""
    level = len(tree.levels) - 1
    while level > 0 and tree.size(level - 1) <= most:
        level -= 1
    return level


def traversed(a: DataFrame | Tree, b: DataFrame | Tree, test: Column, *, by: float = 0.0, node_size: int = 16, whole_a: bool = False, frontier: int = FRONTIER) -> DataFrame:
    """Pairs for which test holds, by breadth-first descent of both trees; whole_a: each object of a descends the tree of b.

    The descent begins at the lowest level of few nodes. Levels of unequal depth: the deeper tree descends first. Children
    meet their parents by equality. Levels of bounded size are broadcast and their steps chained in one plan; below, each
    frontier is written. A frontier of more than `frontier` pairs ends the descent early.
    """
    spark = (b.objects if isinstance(b, Tree) else b).sparkSession
    made = inheritable_thread_target(spark)(lambda t, whole: t if isinstance(t, Tree) else Tree(t, []) if whole else build(t, node_size))
    with ThreadPoolExecutor(2) as pool:  # the jobs of both trees run side by side
        ta, tb = pool.map(made, (a, b), (whole_a, False))
    if not tb.levels or not (whole_a or ta.levels):
        return side(ta.objects, "a").join(side(tb.objects, "b"), F.lit(False))
    lb = _top(tb, TOP_OBJECTS if whole_a else TOP)
    root_b = tb.levels[lb].select(F.col("node").alias("node_b"), *(F.col(c).alias(f"b_{c}") for c in SIDES))
    meets = _meets(by)
    box_a, box_b = ([f"{x}_{c}" for c in SIDES] for x in "ab")
    if whole_a:
        la, front = -1, dealt(side(ta.objects, "a")).join(F.broadcast(root_b), meets)  # a few rows
    else:
        la = _top(ta, TOP)
        root_a = ta.levels[la].select(F.col("node").alias("node_a"), *(F.col(c).alias(f"a_{c}") for c in SIDES))
        front = root_a.join(F.broadcast(root_b), meets)
    while la > 0 or lb > 0:
        deepest, written = max(la, lb), False
        for name, tree, level, box in (("a", ta, la, box_a), ("b", tb, lb, box_b)):
            if level != deepest:
                continue
            down = _as(tree.levels[level - 1], name, "node", "parent")
            small = tree.size(level - 1) <= SMALL_LEVEL
            written |= not small
            front = front.drop(*box).withColumnRenamed(f"node_{name}", f"up_{name}").join(F.broadcast(down) if small else down, f"up_{name}").drop(f"up_{name}").where(meets)
        la, lb = la - (la == deepest), lb - (lb == deepest)
        if written and (la > 0 or lb > 0):
            front = checkpointed(front)
            if not whole_a and front.count() > frontier:
                warnings.warn(f"rtree: more than {frontier} pairs of nodes on a level; leaves are paired by the grid", stacklevel=2)
                front = _leaf_pairs(ta, tb, meets, by)
                break
    end_b = side(tb.objects.withColumnRenamed("leaf", "node_b"), "b", "node_b")
    if whole_a:
        return met(front.drop(*box_b), end_b, ["node_b"]).where(test)
    end_a = side(ta.objects.withColumnRenamed("leaf", "node_a"), "a", "node_a")
    return front.select("node_a", "node_b").join(end_a, "node_a").join(end_b, "node_b").where(test)


def _leaf_pairs(ta: Tree, tb: Tree, meets: Column, by: float) -> DataFrame:
    """Pairs of leaves that meet, by the grid join."""
    from .join import matched

    boxes = [t.levels[0].select(F.col("node").alias("id"), *SIDES) for t in (ta, tb)]
    return matched(*boxes, test=meets, by=by).select(F.col("id_a").alias("node_a"), F.col("id_b").alias("node_b"))
