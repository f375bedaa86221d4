"""Space partitions: bounds, uniform grids, stripes, refined cells, sort-tile and binary-split cuts, and their statistics.

One cell function serves assignment and the test that keeps each pair once: cells are half-open, clamped at both ends.
"""

from __future__ import annotations

import itertools
import math
import os
import re
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Objects that a cell should hold on average, and the largest number of cells of a grid in one dimension.
PER_CELL, MOST_CELLS = 64, 1 << 20
#: The largest number of times that cells are quartered.
MOST_DEPTH = 20


@dataclass(frozen=True)
class Grid:
    """n0 x n1 cells over an extent. A width of 0 gives one column of cells."""

    low0: float
    high0: float
    low1: float
    high1: float
    n0: int
    n1: int
    spread: float = 1.0  #: cells that the largest object spans in a dimension, where known

    def level_of(self, by: float = 0.0, dims: tuple[int, ...] = (0, 1)) -> Column:
        """How often cells must double so that an object, widened by `by`, is at most one of them wide and high."""
        sizes = [((high - low) / n, F.col(f"high{d}") - F.col(f"low{d}") + 2 * by) for d, (low, high, n) in enumerate(((self.low0, self.high0, self.n0), (self.low1, self.high1, self.n1))) if d in dims]
        spans = [F.greatest(F.lit(1.0), extent / F.lit(cell)) for cell, extent in sizes if cell > 0]
        return F.ceil(F.log2(F.greatest(*spans) if len(spans) > 1 else spans[0])).cast("int") if spans else F.lit(0)

    def cell(self, dim: int, x: Column, level: Column | int = 0) -> Column:
        """The cell number of coordinate x; each further level halves the cells, a negative one doubles them."""
        low, high, n = (self.low0, self.high0, self.n0) if dim == 0 else (self.low1, self.high1, self.n1)
        if not high > low:
            return F.lit(0).cast("long")
        many = F.lit(n) * F.pow(F.lit(2.0), level) if isinstance(level, Column) else F.lit(float(n * 2**level))
        at = F.floor((x - F.lit(low)) / F.lit(high - low) * many)
        return F.least(F.ceil(many) - 1, F.greatest(F.lit(0).cast("long"), at))


def bounds(*tables: DataFrame) -> DataFrame:
    """One row: the extent of all tables, the number of objects, their mean width, height and area, the largest width and height."""
    sides = ("low0", "high0", "low1", "high1")
    both = tables[0].select(*sides)
    for t in tables[1:]:
        both = both.unionByName(t.select(*sides))
    w, h = F.col("high0") - F.col("low0"), F.col("high1") - F.col("low1")
    return both.agg(F.min("low0").alias("low0"), F.max("high0").alias("high0"), F.min("low1").alias("low1"), F.max("high1").alias("high1"),
                    F.count("*").alias("n"), F.avg(w).alias("w"), F.avg(h).alias("h"), F.avg(w * h).alias("area"), F.max(w).alias("most_w"), F.max(h).alias("most_h"))


def sized_grid(*tables: DataFrame, n0: int | None = None, n1: int | None = None, extent: tuple[float, float, float, float] | None = None, per_cell: int = PER_CELL) -> Grid | None:
    """A grid for the tables; None if they are empty.

    Unless given, n0 and n1 aim at per_cell objects a cell, but cells stay at least twice as wide and high as the mean
    object and four times its mean area: then all copies that assignment makes are at most 2.25 for each object on average.
    """
    if extent and n0 and n1:
        return Grid(*extent, n0, n1)
    s = bounds(*tables).first()
    if not s["n"]:
        return None
    low0, high0, low1, high1 = extent or (s["low0"], s["high0"], s["low1"], s["high1"])
    across, up = high0 - low0, high1 - low1
    n = min(MOST_CELLS, max(1, math.isqrt(s["n"] // per_cell)))
    fit = lambda length, mean: MOST_CELLS if mean <= 0 else max(1, int(length / (2 * mean)))
    k0, k1 = min(n, fit(across, s["w"])), min(n, fit(up, s["h"]))
    if s["area"] > 0 and across > 0 and up > 0:
        too = k0 * k1 * 4 * s["area"] / (across * up)
        if too > 1:
            k0, k1 = max(1, int(k0 / math.sqrt(too))), max(1, int(k1 / math.sqrt(too)))
    if n0 and not n1:
        k1 = min(MOST_CELLS, max(1, s["n"] // (per_cell * n0)), fit(up, s["h"]))
    elif n1 and not n0:
        k0 = min(MOST_CELLS, max(1, s["n"] // (per_cell * n1)), fit(across, s["w"]))
    k0, k1 = n0 or k0, n1 or k1
    spread = max(s["most_w"] / across * k0 if across > 0 else 1.0, s["most_h"] / up * k1 if up > 0 else 1.0)
    return Grid(low0, high0, low1, high1, k0, k1, spread)


def assign(df: DataFrame, grid: Grid, *, by: float = 0.0, level: Column | int | tuple[Column, Column] = 0) -> DataFrame:
    """df once for each cell (cx, cy) of a level, or of a level of each dimension, that the rectangle, widened by `by`, meets; begins0, begins1: does its low lie in the cell?

    A pair's corner of largest lows lies in a cell that both meet if in each dimension one of the two begins there.
    """
    first, second = level if isinstance(level, tuple) else (level, level)
    lo0, hi0 = grid.cell(0, F.col("low0") - by, first), grid.cell(0, F.col("high0") + by, first)
    lo1, hi1 = grid.cell(1, F.col("low1") - by, second), grid.cell(1, F.col("high1") + by, second)
    df = df.withColumn("cx", F.explode(F.sequence(lo0, hi0))).withColumn("cy", F.explode(F.sequence(lo1, hi1)))
    return df.withColumn("begins0", F.col("cx") == lo0).withColumn("begins1", F.col("cy") == lo1)


#: Rows of a side that a group of a join holds: beyond it a group is dealt in blocks.
HELD = 20_000


def dealt(df: DataFrame, *key: str) -> DataFrame:
    """df dealt by key, or evenly without one, over as many tasks as a shuffle has, however small the table is: its pairs may be many."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def met(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """The equi-join of tables of copies. Sizes estimated from files don't know of copies, by which even large tables would be broadcast."""
    return dealt(left, *key).join(dealt(right, *key).hint("merge"), key)


def blocked(a: DataFrame, b: DataFrame, key: list[str], held: int = HELD, weight: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables (id, SIDES, *key, ...) with (block_a, block_b): a group of more than `held` rows of a side is dealt in blocks, and each block meets each of the other side's. Rows count as their weight where one is given."""
    rows = {"a": a, "b": b}
    n = [t.groupBy(*key).agg((F.count("*") if weight is None else F.sum(weight)).alias(f"n_{x}")) for x, t in rows.items()]
    parts = [F.ceil(F.col(f"n_{x}") / held).cast("int").alias(f"parts_{x}") for x in "ab"]
    # a row for `held` copies at least
    full = n[0].join(n[1].hint("merge"), key).where((F.col("n_a") > held) | (F.col("n_b") > held)).select(*key, *parts)

    def blocks(x: str, other: str) -> DataFrame:
        own = F.pmod(F.xxhash64("id", "low0", "high0", "low1", "high1"), F.coalesce(f"parts_{x}", F.lit(1))).cast("int").alias(f"block_{x}")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(f"parts_{other}", F.lit(1)) - 1)).alias(f"block_{other}")
        return rows[x].join(F.broadcast(full), key, "left").select(*(F.col(c) for c in rows[x].columns), own, every)

    return blocks("a", "b"), blocks("b", "a")


def histogram(df: DataFrame, grid: Grid) -> DataFrame:
    """Rows (cx, cy, n): objects for each cell that has any."""
    return assign(df, grid).groupBy("cx", "cy").agg(F.count("*").alias("n"))


def heatmap(df: DataFrame, grid: Grid) -> DataFrame:
    """Rows (cx, cy, n): centres of objects for each bin."""
    cx = grid.cell(0, (F.col("low0") + F.col("high0")) / 2).alias("cx")
    return df.groupBy(cx, grid.cell(1, (F.col("low1") + F.col("high1")) / 2).alias("cy")).agg(F.count("*").alias("n"))


def statistics(a: DataFrame, b: DataFrame, grid: Grid) -> DataFrame:
    """One row over the cells that both sides reach: their number, and total, average and largest number of objects."""
    both = histogram(a, grid).withColumnRenamed("n", "n_a").join(histogram(b, grid).withColumnRenamed("n", "n_b"), ["cx", "cy"])
    n = F.col("n_a") + F.col("n_b")
    return both.agg(F.count("*").alias("n_partitions"), F.sum(n).alias("total"), F.avg(n).alias("average"), F.max(n).alias("most"))


def median_extent(df: DataFrame) -> DataFrame:
    """One row: the upper median (element n // 2 from 0) of widths and heights over all objects; none for an empty table.

    Objects are counted by value first, so that no task holds more than a range of distinct values, and ties are one row.
    """
    n = df.count()
    at = lambda d, name: _of_rank(df.groupBy((F.col(f"high{d}") - F.col(f"low{d}")).alias(name)).agg(F.count("*").alias("n")), name, n // 2)
    return at(0, "width").crossJoin(at(1, "height"))  # one row each


def _of_rank(counts: DataFrame, value: str, rank: int) -> DataFrame:
    """The value at a 0-based rank of counted values (value, n): running sums of ranges say which one holds it, and are taken within that one."""
    dealt = checkpointed(counts.repartitionByRange(value).withColumn("_p", F.spark_partition_id()))
    sizes = dealt.groupBy("_p").agg(F.sum("n").alias("_n"))  # one row for each range
    sizes = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n"))
    one = sizes.where((F.col("_before") <= rank) & (F.col("_before") + F.col("_n") > rank)).select("_p", "_before")
    upto = F.col("_before") + F.sum("n").over(Window.partitionBy("_p").orderBy(value))
    held = dealt.join(F.broadcast(one), "_p").withColumn("_upto", upto)
    return held.where((F.col("_upto") > rank) & (F.col("_upto") - F.col("n") <= rank)).select(value)


def sampled_extent(df: DataFrame, *, most: int = 1000, seed: int = 7) -> tuple[float, float]:
    """The upper median of widths and heights of a seeded sample of about `most` objects; 0 for an empty table."""
    n = df.count()
    rows = df.sample(min(1.0, 2 * most / max(n, 1)), seed).limit(most).select((F.col("high0") - F.col("low0")).alias("w"), (F.col("high1") - F.col("low1")).alias("h")).collect()
    middle = lambda v: sorted(v)[len(v) // 2] if v else 0.0
    return middle([r["w"] for r in rows]), middle([r["h"] for r in rows])


def depth_for(b: DataFrame, grid: Grid) -> int:
    """How often cells can be quartered before they are smaller than twice b's sampled median object."""
    w, h = sampled_extent(b)
    fits = [math.log2((high - low) / n / (2 * size)) for low, high, n, size in ((grid.low0, grid.high0, grid.n0, w), (grid.low1, grid.high1, grid.n1, h)) if high > low and size > 0]
    return max(0, min([MOST_DEPTH, *(math.floor(f) for f in fits)]))


def quadtree(points: DataFrame, grid: Grid, *, most: int = 32, depth: int = 12) -> DataFrame:
    """Rows (level, cx, cy, n): leaves of the quadtree over points (id, x, y) in the grid's extent.

    A cell of more than `most` points is quartered, up to `depth` times. Points are counted once, at the deepest level;
    the levels above are sums of those counts. Leaves are the cells that are not quartered and whose parent is.
    """
    cells = points.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    one = Grid(grid.low0, grid.high0, grid.low1, grid.high1, 1, 1)
    fine = checkpointed(cells.groupBy(one.cell(0, F.col("x"), depth).alias("cx"), one.cell(1, F.col("y"), depth).alias("cy")).agg(F.count("*").alias("n")))
    at = lambda k: fine.groupBy(F.floor(F.col("cx") / 2 ** (depth - k)).alias("cx"), F.floor(F.col("cy") / 2 ** (depth - k)).alias("cy")).agg(F.sum("n").alias("n"))
    out = None
    for k in range(depth + 1):
        leaf = at(k) if k == depth else at(k).where(F.col("n") <= most)
        if k:
            heavy = at(k - 1).where(F.col("n") > most).select(F.col("cx").alias("px"), F.col("cy").alias("py"))
            leaf = leaf.join(heavy, (F.floor(F.col("cx") / 2) == F.col("px")) & (F.floor(F.col("cy") / 2) == F.col("py"))).select("cx", "cy", "n")
        leaf = leaf.select(F.lit(k).alias("level"), "cx", "cy", "n")
        out = leaf if out is None else out.unionByName(leaf)
    return out


def _split(df: DataFrame, grid: Grid, level: int) -> DataFrame:
    """Rows of cells at level - 1 once for each of the quarters at `level` that they meet."""
    for dim, c in ((0, "cx"), (1, "cy")):
        lo = F.greatest(F.col(c) * 2, grid.cell(dim, F.col(f"low{dim}"), level))
        hi = F.least(F.col(c) * 2 + 1, grid.cell(dim, F.col(f"high{dim}"), level))
        df = df.withColumn(c, F.explode(F.sequence(lo, hi)))
    return df


def refined(a: DataFrame, b: DataFrame, grid: Grid, *, max_comparisons: int = 1000, most_b: int = 100, depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with (level, cx, cy): cells with too many comparisons or objects of b are quartered, up to `depth` times.

    Without depth, cells are quartered while they stay twice as wide and high as b's sampled median object.
    Cells that only one side reaches go. Each level is cut off by a checkpoint; only counts of cells move besides rows.
    """
    depth = depth_for(b, grid) if depth is None else depth
    key = ["cx", "cy"]
    rows = {x: assign(t, grid).withColumn("level", F.lit(0)) for x, t in (("a", a), ("b", b))}
    done: dict[str, DataFrame] = {}
    for level in range(depth + 1):
        rows = {x: checkpointed(t) for x, t in rows.items()}
        n = [t.groupBy(*key).agg(F.count("*").alias(f"n_{x}")) for x, t in rows.items()]
        heavy = (F.col("n_a") * F.col("n_b") > max_comparisons) | (F.col("n_b") > most_b)
        cells = checkpointed(n[0].join(n[1], key).select(*key, (heavy & F.lit(level < depth)).alias("heavy")))
        for x, t in rows.items():
            t = t.join(cells, key)
            rest = t.where(~F.col("heavy")).drop("heavy")
            done[x] = done[x].unionByName(rest) if x in done else rest
            rows[x] = _split(t.where("heavy").drop("heavy"), grid, level + 1).withColumn("level", F.lit(level + 1))
        if cells.where("heavy").isEmpty():
            break
    return done["a"], done["b"]


def refined_cells(a: DataFrame, b: DataFrame, grid: Grid, **limits: int) -> DataFrame:
    """Rows (level, cx, cy, n_a, n_b) of the refined cells."""
    n = [t.groupBy("level", "cx", "cy").agg(F.count("*").alias(f"n_{x}")) for x, t in zip("ab", refined(a, b, grid, **limits), strict=True)]
    return n[0].join(n[1], ["level", "cx", "cy"])


def shared_folder(spark: SparkSession) -> str:
    """A folder in that of spark.checkpoint.dir; one of our own where a local session lacks the setting (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    named = named or "file://" + os.path.join(tempfile.gettempdir(), f"gridloom-{spark.sparkContext.applicationId}")
    return f"{named.rstrip('/')}/gridloom"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: later plans start from the files."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/spatial-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Sampled centres of a tile while a directory is learned, and nodes of a level that are broadcast.
SAMPLED, SMALL_LEVEL = 64, 50_000


@dataclass(frozen=True)
class Level:
    """The nodes of one depth that are split: (at, dim, cuts), children numbered at * fan + 0, 1, ..."""

    nodes: DataFrame
    fan: int
    count: int


@dataclass(frozen=True)
class Directory:
    """Tiles of bounded counts over the whole plane: a k-d tree of many children, as one table for each depth.

    Any table can be dealt to its tiles. A tile is (depth, at): the number of splits above it and its number at that depth.
    """

    levels: list[Level]

    def deal(self, df: DataFrame, *, by: float = 0.0) -> DataFrame:
        """df once for each tile that its rectangle, widened by `by`, meets, with (depth, at) and the tile's half-open bounds x0, x1, y0, y1."""
        inf = F.lit(math.inf)
        out = df.select("*", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("at"), (-inf).alias("x0"), inf.alias("x1"), (-inf).alias("y0"), inf.alias("y1"))
        for k, level in enumerate(self.levels):
            nodes = level.nodes.withColumn("depth", F.lit(k))
            out = out.join(F.broadcast(nodes) if level.count <= SMALL_LEVEL else nodes, ["depth", "at"], "left")
            low, high = (F.when(F.col("dim") == 0, F.col(f"{s}0")).otherwise(F.col(f"{s}1")) for s in ("low", "high"))
            out = bisected(bisected(out, "_from", low - by, level.fan), "_to", high + by, level.fan)
            none = F.col("cuts").isNull()
            out = out.withColumn("_k", F.explode(F.sequence(F.when(none, -1).otherwise(F.col("_from")), F.when(none, -1).otherwise(F.col("_to")))))
            split, cut = F.col("_k") >= 0, lambda i: F.get("cuts", i)
            side = lambda c, d, i: F.when(split & (F.col("dim") == d), F.coalesce(cut(i), F.col(c))).otherwise(F.col(c)).alias(c)
            kept = [c for c in out.columns if c not in ("depth", "at", "x0", "x1", "y0", "y1", "dim", "cuts", "_k", "_from", "_to")]
            deeper = F.when(split, F.col("at") * level.fan + F.col("_k")).otherwise(F.col("at")).alias("at")
            before, here = F.when(F.col("_k") > 0, F.col("_k") - 1).otherwise(F.lit(None).cast("int")), F.col("_k")
            out = out.select(*kept, F.when(split, k + 1).otherwise(F.col("depth")).alias("depth"), deeper, side("x0", 0, before), side("x1", 0, here), side("y0", 1, before), side("y1", 1, here))
        return out


def bisected(df: DataFrame, name: str, x: Column, fan: int) -> DataFrame:
    """df with `name`: how many of the sorted `cuts`, fan - 1 at most, are not above x. Halving steps, each a column of generated code."""
    df = df.withColumn(name, F.lit(0))
    for k in reversed(range(max(1, (fan - 1).bit_length()))):
        df = df.withColumn(name, F.col(name) + F.when(F.get("cuts", F.col(name) + F.lit((1 << k) - 1)) <= x, 1 << k).otherwise(0))
    return df


def directory(df: DataFrame, *, method: str = "sort_tile", capacity: int = 2000, first: int = 0, seed: int = 7) -> Directory:
    """A directory of tiles of about `capacity` centres of rectangles df, and twice that at most but for equal centres.

    sort_tile: slices of dimension `first` by counts, tiles of the other one in each; binary_split: halves at medians, in
    turn. It is learned from a sample of SAMPLED rows for each tile; then all rows are counted, and tiles that hold more
    than twice `capacity` are split by their own quantiles until none does. Tiles grow with the table: nothing of it is
    held by the driver. A tile whose centres are all equal stays whole.
    """
    if method not in ("sort_tile", "binary_split"):
        raise ValueError(f"method: {method}")
    middle = [(F.col(f"low{d}") + F.col(f"high{d}")) / 2 for d in (0, 1)]
    share = min(1.0, SAMPLED / capacity)
    centres = df.select(*(m.alias(f"v{d}") for d, m in enumerate(middle)), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("at"))
    sample = checkpointed(centres if share == 1.0 else centres.sample(share, seed))
    leaves = max(2, math.ceil(sample.count() / (capacity * share)))
    slices = math.ceil(math.sqrt(leaves))
    fans, later = ([slices, slices], 16) if method == "sort_tile" else ([2] * math.ceil(math.log2(leaves)), 2)
    levels = _divided([], sample, capacity * share, fans, later, first, rounds=len(fans))
    points = df.select(*(m.alias(f"{s}{d}") for d, m in enumerate(middle) for s in ("low", "high")))
    dealt = Directory(levels).deal(points).select(F.col("low0").alias("v0"), F.col("low1").alias("v1"), "depth", "at")
    full = checkpointed(dealt.groupBy("depth", "at").agg(F.count("*").alias("n")).where(F.col("n") > 2 * capacity).drop("n"))
    if full.isEmpty():
        return Directory(levels)
    return Directory(_divided(levels, checkpointed(dealt.join(full, ["depth", "at"])), 2 * capacity, fans, later, first))


def _divided(levels: list[Level], points: DataFrame, most: float, fans: list[int], later: int, first: int, rounds: int = 62) -> list[Level]:
    """levels with the tiles of points (v0, v1, depth, at) split while they hold more than `most`; numbers of tiles fit 62 bits."""
    levels, k, bits = list(levels), 0, 0.0
    while k < rounds:
        fan = levels[k].fan if k < len(levels) else fans[k] if k < len(fans) else later
        bits += math.log2(fan)
        if bits >= 62:
            return levels
        here = points.where(F.col("depth") == k)
        nodes = checkpointed(_cuts(here, most, fan, (k + first) % 2))
        count = nodes.count()
        if count:
            value = F.when(F.col("dim") == 0, F.col("v0")).otherwise(F.col("v1"))
            moved = bisected(here.join(F.broadcast(nodes) if count <= SMALL_LEVEL else nodes, "at"), "_k", value, fan)
            moved = moved.select("v0", "v1", F.lit(k + 1).alias("depth"), (F.col("at") * fan + F.col("_k")).alias("at"))
            points = moved.unionByName(points.where(F.col("depth") > k))
            # a few joins are done again rather than written; more would grow with the square of the depth
            points = checkpointed(points) if k % 4 == 3 else points
            if k < len(levels):
                levels[k] = Level(levels[k].nodes.unionByName(nodes), fan, levels[k].count + count)
            else:
                levels.append(Level(nodes, fan, count))
        elif k >= len(levels):
            break
        k += 1
    return levels


def _cuts(points: DataFrame, most: float, fan: int, dim: int) -> DataFrame:
    """Rows (at, dim, cuts) of tiles with more than `most` points: quantiles of one dimension, of the other where it has no extent."""
    quantiles, accuracy = [i / fan for i in range(1, fan)], max(1000, 20 * fan)  # ranks within a twentieth of a child
    sums = [f(f"v{d}").alias(f"{name}{d}") for d in (0, 1) for f, name in ((F.min, "least"), (F.max, "last"))]
    of = points.groupBy("at").agg(F.count("*").alias("n"), *sums, *(F.percentile_approx(f"v{d}", quantiles, accuracy).alias(f"q{d}") for d in (0, 1)))
    wide = [F.col(f"least{d}") < F.col(f"last{d}") for d in (0, 1)]
    of = of.where((F.col("n") > most) & (wide[0] | wide[1])).withColumn("dim", F.when(wide[dim], dim).otherwise(1 - dim))
    least, last, found = (F.when(F.col("dim") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1")) for c in ("least", "last", "q"))
    cuts = F.filter(F.array_distinct(found), lambda c: c > least)
    # where most centres tie with the least: half of the width, or the greatest where that is no number between
    half = least / 2 + last / 2
    return of.select("at", "dim", F.when(F.size(cuts) > 0, cuts).otherwise(F.array(F.when(half > least, half).otherwise(last))).alias("cuts"))


def ranked(df: DataFrame, *order: str, name: str = "rn") -> tuple[DataFrame, int]:
    """df with its 0-based place in a total order, dealt by ranges, and how many rows it has: no task sees more than its range."""
    dealt = checkpointed(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = {r["_p"]: r["n"] for r in dealt.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # one row for each partition
    *before, count = itertools.accumulate((sizes.get(p, 0) for p in range(max(sizes, default=-1) + 1)), initial=0)
    # one literal, read by the partition's number
    starts = F.split(F.lit(",".join(map(str, before)) or "0"), ",").cast("array<bigint>")
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return dealt.withColumn(name, (within + F.get(starts, F.col("_p"))).cast("long")).drop("_p"), count
