"""Local packed trees: cells of a grid that hold many objects of both sides are joined through a tree of flat arrays.

Counts of the cells, taken before any row moves, say how each is joined. A light cell is an equi-join whose pairs are
compared in generated code. The objects of side b in a heavy cell become a sort-tile-recursive tree in numpy arrays, which
the objects of side a descend level by level, many at once. A cell with more objects of a side than one task should hold
is divided by a directory of tiles, and what even that can't divide, because objects lie on each other, in blocks. Equal
boxes of a group are one box in the tree and in its pairs, with the list of their ids, which generated code takes apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.predicates import SIDES, side
from .partition import SMALL_LEVEL, Grid, assign, checkpointed, dealt as spread, directory, met

#: Children of a node, and pairs of an object and a node that a step of the descent holds.
FAN, STEP = 16, 1 << 18
#: Comparisons of a cell beyond which it gets a tree, and objects of a side beyond which it is divided.
COMPARED, HELD = 1 << 18, 20_000
#: Ids in the lists of a batch of pairs of boxes, or one pair's.
LISTED = 1 << 20

CELL, TILE = ["_at", "cx", "cy"], ["depth", "at"]
BOUNDS = ["x0", "x1", "y0", "y1"]


@dataclass(frozen=True)
class Packed:
    """Boxes in leaf order and the boxes of each level above, as arrays (low0, high0, low1, high1) x n; order: their rows."""

    order: np.ndarray
    levels: list[np.ndarray]


def packed(boxes: np.ndarray, fan: int = FAN) -> Packed:
    """The tree over boxes (4 x n): slices of equal counts by the centre of dimension 0, in each by that of dimension 1.

    The children of node k are the boxes k * fan to k * fan + fan - 1 of the level below, so no pointers are kept.
    """
    n = boxes.shape[1]
    middle = boxes[0] / 2 + boxes[1] / 2, boxes[2] / 2 + boxes[3] / 2
    slices = max(1, int(np.ceil(np.sqrt(np.ceil(n / fan)))))
    wide = max(1, -(-n // slices))
    place = np.empty(n, np.int64)
    place[np.argsort(middle[0], kind="stable")] = np.arange(n) // wide
    order = np.lexsort((middle[1], place))
    levels = [boxes[:, order]]
    while levels[-1].shape[1] > 1:
        below = levels[-1]
        starts = np.arange(0, below.shape[1], fan)
        levels.append(np.stack([(np.minimum, np.maximum)[d % 2].reduceat(below[d], starts) for d in range(4)]))
    return Packed(order, levels)


def probed(tree: Packed, boxes: np.ndarray, *, fan: int = FAN, step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of boxes, row of the tree's) that meet (closed), in parts of at most `step` pairs.

    The frontier is a stack of parts; one that is too large is halved before its children are looked at, so memory
    follows the depth of the tree and not the number of pairs.
    """
    if not boxes.shape[1] or not len(tree.order):
        return
    top = len(tree.levels) - 1
    every = np.arange(boxes.shape[1])
    stack = [(top, *_meeting(tree.levels[top], boxes, every, np.zeros_like(every)))]
    while stack:
        level, i, k = stack.pop()
        if len(i) > step:
            half = len(i) // 2
            stack += [(level, i[half:], k[half:]), (level, i[:half], k[:half])]
        elif level == 0:
            if len(i):
                yield i, tree.order[k]
        elif len(i):
            below = tree.levels[level - 1]
            child = (k[:, None] * fan + np.arange(fan)).ravel()
            there = child < below.shape[1]
            stack.append((level - 1, *_meeting(below, boxes, np.repeat(i, fan)[there], child[there])))


def _meeting(nodes: np.ndarray, boxes: np.ndarray, i: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    for d in (0, 2):
        meet = (boxes[d][i] <= nodes[d + 1][k]) & (nodes[d][k] <= boxes[d + 1][i])
        i, k = i[meet], k[meet]
    return i, k


def packed_join(a: DataFrame, b: DataFrame, grid: Grid, test: Column, by: float = 0.0, *, compared: int = COMPARED, held: int = HELD) -> DataFrame:
    """Joined rows (id_a, a_low0, ..., id_b, b_low0, ...) of valid tables for which test holds.

    test may only hold where a, widened by `by`, and b intersect (closed). Objects live on the level of the grid where
    they span two cells at most. A cell has a tree if both sides' counts multiply to more than `compared`; a group holds
    `held` objects of each side at most, in any cell. Repeated rows give pairs each; empty tables give none.
    """
    rows = dict(zip("ab", leveled(a, b, grid, by), strict=True))
    n = [t.groupBy(*CELL).agg(F.count("*").alias(f"n_{x}")) for x, t in rows.items()]
    over = ((F.col("n_a") > held) | (F.col("n_b") > held)).alias("over")
    # a row for `compared` comparisons at least
    heavy = checkpointed(n[0].join(n[1], CELL).where(F.col("n_a") * F.col("n_b") > compared).select(*CELL, over))
    count, divided = heavy.agg(F.count("*"), F.coalesce(F.max("over"), F.lit(False))).first()
    sent = F.broadcast(heavy) if count <= SMALL_LEVEL else heavy
    light = {x: t.join(sent, CELL, "left_anti") if count else t for x, t in rows.items()}
    more = {"a": [F.col("_own").alias("_own_a")], "b": [F.col("_own").alias("_own_b")]}
    both = met(side(light["a"], "a", *CELL, *more["a"]), side(light["b"], "b", *CELL, *more["b"]), CELL)
    at_owner = owned(grid, by)
    out = both.where(test & at_owner).drop(*CELL, "_own_a", "_own_b")
    if not count:
        return out
    inf = F.lit(np.inf)
    whole = [F.lit(-1).alias("depth"), F.lit(0).cast("long").alias("at"), (-inf).alias("x0"), inf.alias("x1"), (-inf).alias("y0"), inf.alias("y1"), F.lit(0).alias("block_a"), F.lit(0).alias("block_b")]
    rich = {x: t.join(sent, CELL) for x, t in rows.items()}
    groups = {x: t.where("NOT over").select(*CELL, "id", *SIDES, "_own", *whole) for x, t in rich.items()}
    if divided:
        parts = _divided({x: t.where("over").drop("over") for x, t in rich.items()}, by, held)
        groups = {x: t.unionByName(parts[x]) for x, t in groups.items()}
    joined = _through_trees(groups["a"], groups["b"], by)
    return out.unionByName(joined.where(test & at_owner).drop(*CELL, "_own_a", "_own_b"))


#: The levels of both dimensions are one number, TWO of the first and one of the second; levels that a side may live on before both go together.
TWO, MOST_LEVELS = 4096, 24


def coarser(p: Column, q: Column) -> Column:
    """The coarser of two pairs of levels, in each dimension."""
    first = F.greatest(F.shiftright(p, 12), F.shiftright(q, 12))
    return first * TWO + F.greatest(p.bitwiseAND(TWO - 1), q.bitwiseAND(TWO - 1))


def _at(level: Column) -> tuple[Column, Column]:
    return -F.shiftright(level, 12), -level.bitwiseAND(TWO - 1)


def leveled(a: DataFrame, b: DataFrame, grid: Grid, by: float) -> tuple[DataFrame, DataFrame]:
    """Both tables once for each cell (_at, cx, cy): on the coarser of an object's own levels (_own) and each of the other side's.

    Each dimension has a level, so that cells of long and flat objects are long and flat too.
    """
    if grid.spread <= 2 and by == 0:
        zero = [F.lit(0).alias(c) for c in ("_own", "_at")]
        return assign(a.select("*", *zero), grid), assign(b.select("*", *zero), grid)
    number = lambda first, second: (first * TWO + second).cast("int")
    for two in (True, False):
        levels = (lambda w: [grid.level_of(w, (d,)) for d in (0, 1)]) if two else (lambda w: [grid.level_of(w)] * 2)
        own = [t.withColumn("_own", number(*levels(w))) for t, w in ((a, by), (b, 0.0))]
        lives = [sorted(r["_own"] for r in t.select("_own").distinct().collect()) for t in own]  # a level or so for each halving
        if max(map(len, lives)) <= MOST_LEVELS:
            break

    def deal(t: DataFrame, other: list[int], wide: float) -> DataFrame:
        shared = F.transform(F.array(*(F.lit(k) for k in other)).cast("array<int>"), lambda k: coarser(F.col("_own"), k))
        return assign(t.withColumn("_at", F.explode(F.array_distinct(shared))), grid, by=wide, level=_at(F.col("_at")))

    return deal(own[0], lives[1], by), deal(own[1], lives[0], 0.0)


def owned(grid: Grid, by: float) -> Column:
    """True in the one cell that keeps a pair: on the coarser levels of the two, where the corner of largest lows lies."""
    x, y = (F.greatest(F.col(f"a_low{d}") - F.lit(by), F.col(f"b_low{d}")) for d in (0, 1))
    first, second = _at(F.col("_at"))
    return (F.col("_at") == coarser(F.col("_own_a"), F.col("_own_b"))) & (grid.cell(0, x, first) == F.col("cx")) & (grid.cell(1, y, second) == F.col("cy"))


def _divided(rows: dict[str, DataFrame], by: float, held: int) -> dict[str, DataFrame]:
    """Rows of cells that hold too much, once for each tile of a directory that they meet and each block of the other side.

    The directory is learned from side b; tiles that stay full of either side are dealt in blocks by a number that is
    written with the rows, so that a task that runs again deals them alike.
    """
    key = [*CELL, *TILE]
    written = {x: checkpointed(t) for x, t in rows.items()}
    # of both sides, so that a full side divides whichever it is
    tiles = directory(written["a"].select(*SIDES).unionByName(written["b"].select(*SIDES)), capacity=max(1, held // 2))
    dealt = {x: checkpointed(tiles.deal(t, by=by if x == "a" else 0.0).withColumn("number", F.monotonically_increasing_id())) for x, t in written.items()}
    n = [t.groupBy(*key).agg(F.count("*").alias(f"n_{x}")) for x, t in dealt.items()]
    parts = [F.ceil(F.col(f"n_{x}") / held).cast("int").alias(f"parts_{x}") for x in "ab"]
    met = n[0].join(n[1], key).select(*key, *parts)  # tiles that one side alone reaches go

    def blocks(x: str, other: str) -> DataFrame:
        own = F.pmod(F.xxhash64("number"), f"parts_{x}").cast("int").alias(f"block_{x}")
        every = F.explode(F.sequence(F.lit(0), F.col(f"parts_{other}") - 1)).alias(f"block_{other}")
        return dealt[x].join(met, key).select(*key, "id", *SIDES, "_own", *BOUNDS, own, every)

    return {"a": blocks("a", "b"), "b": blocks("b", "a")}


NAMES = [f"{x}_{c}" for x in "ab" for c in SIDES]
SCHEMA = pa.schema([("id_a", pa.list_(pa.int64())), *((c, pa.float64()) for c in NAMES[:4]), ("id_b", pa.list_(pa.int64())), *((c, pa.float64()) for c in NAMES[4:]),
                    ("_at", pa.int32()), ("cx", pa.int64()), ("cy", pa.int64()), ("_own_a", pa.int32()), ("_own_b", pa.int32())])
DDL = "id_a array<long>, {}, id_b array<long>, {}, _at int, cx long, cy long, _own_a int, _own_b int".format(*(", ".join(f"{c} double" for c in cs) for cs in (NAMES[:4], NAMES[4:])))


def _equal(boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows with those of equal boxes (4 x n) side by side, where each box's begin and the last one's end)."""
    order = np.lexsort(boxes)
    x = boxes[:, order]
    new = np.flatnonzero((x[:, 1:] != x[:, :-1]).any(0)) + 1
    return order, np.concatenate(([0], new, [len(order)]))


def _lists(ids: np.ndarray, starts: np.ndarray, at: np.ndarray) -> pa.Array:
    """The ids of each box in `at` as a list."""
    size = (starts[1:] - starts[:-1])[at]
    ends = np.cumsum(size)
    rows = np.arange(ends[-1]) + np.repeat(starts[at] - (ends - size), size)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids[rows]))


def _through_trees(left: DataFrame, right: DataFrame, by: float) -> DataFrame:
    """Pairs of each group (cell, tile, blocks) that meet in the tile: b's objects are packed, a's descend; pairs leave in parts."""
    key = [*CELL, *TILE, "block_a", "block_b"]
    mark = lambda t, first: t.select(*(F.col(c).cast("int" if c in ("_at", "depth") else "long").alias(c) for c in key), "id", *SIDES, F.col("_own").cast("int").alias("_own"), *BOUNDS, F.lit(first).alias("first"))

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        first = rows.column("first").to_numpy()
        x, y = rows.filter(pa.array(first)), rows.filter(pa.array(~first))
        if not len(x) or not len(y):
            return
        boxes, others = (np.stack([t.column(c).to_numpy() for c in SIDES]) for t in (x, y))
        ids, owns = ([t.column(c).to_numpy() for t in (x, y)] for c in ("id", "_own"))
        (order, starts), (order_b, starts_b) = _equal(boxes), _equal(others)
        ids = [ids[0][order], ids[1][order_b]]
        one, two = order[starts[:-1]], order_b[starts_b[:-1]]
        boxes, others, owns = boxes[:, one], others[:, two], [owns[0][one], owns[1][two]]  # equal boxes live on equal levels
        count, count_b = np.diff(starts), np.diff(starts_b)
        wide = boxes + np.array([[-by], [by], [-by], [by]])
        x0, x1, y0, y1 = (x.column(c)[0].as_py() for c in BOUNDS)
        cell = [x.column(c)[0].as_py() for c in CELL]
        for i, j in probed(packed(others), wide):
            low0, low1 = np.maximum(wide[0][i], others[0][j]), np.maximum(wide[2][i], others[2][j])
            own = (low0 >= x0) & (low0 < x1) & (low1 >= y0) & (low1 < y1)
            every_i, every_j = i[own], j[own]
            part = np.cumsum(count[every_i] + count_b[every_j]) // LISTED
            for rows in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1):
                if not len(rows):
                    continue
                i, j = every_i[rows], every_j[rows]
                columns = [_lists(ids[0], starts, i), *boxes[:, i], _lists(ids[1], starts_b, j), *others[:, j], *(np.full(len(i), c) for c in cell), owns[0][i], owns[1][j]]
                yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)

    # what a test asks of the boxes alone is asked before the lists are taken apart
    found = spread(mark(left, True).unionByName(mark(right, False)), *key).groupBy(*key).applyInArrow(descend, DDL)
    return found.withColumn("id_a", F.explode("id_a")).withColumn("id_b", F.explode("id_b"))
