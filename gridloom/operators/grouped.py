"""Joins of shapes, or of rectangles for the nearest, by cells of a grid whose groups are compared in Arrow.

Shapes travel once for each cell that their envelopes meet, with the list of ids of all rows that have them, so what is
shuffled grows with the tables and not with their pairs. Within a group equal shapes are compared once: envelopes descend
a packed tree, functions.relate compares the segments of those that meet, and pairs leave as lists of ids, which generated
code takes apart. For the nearest each group gives one row for each of a's objects. Groups hold a bounded number of rows
of each side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions import relate, wkt
from ..functions.predicates import SIDES
from .equal import LISTED, WEIGHT, taken_apart
from .packed import CELL, TWO, leveled, packed, probed
from .partition import HELD, blocked, dealt, sized_grid

#: Objects of a cell on average, segments compared in one call, and ids in the lists of one batch that leaves.
PER_GROUP, AT_ONCE, OUT = 2000, 200_000, 1 << 17
NULL = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Objects:
    """One side of a group: the distinct objects, and the ids that have each one."""

    ids: pa.Array
    box: np.ndarray  #: low0, high0, low1, high1 of each distinct object
    own: np.ndarray
    begins: np.ndarray  #: does its low lie in the cell, in both dimensions?
    dim: np.ndarray
    seg: np.ndarray
    part: np.ndarray
    start: np.ndarray  #: of its segments
    size: np.ndarray
    of: np.ndarray  #: the object of each id
    order: np.ndarray  #: ids by object
    first: np.ndarray  #: place of each object's first id in order
    count: np.ndarray

    def side(self, k: np.ndarray) -> relate.Side:
        """Objects k as a side of relate, one a pair."""
        size = self.size[k]
        at = np.repeat(self.start[k] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        return relate.Side(self.seg[:, at], np.repeat(np.arange(len(k)), size), self.part[at], self.dim[k])


def objects(rows: pa.Table) -> Objects:
    n = len(rows)
    value = lambda c: rows.column(c).to_numpy()
    box = np.stack([value(c) for c in SIDES])
    if "segs" in rows.column_names:
        seg, geom, part = wkt.flattened(rows.column("segs").combine_chunks())
        size, dim = np.bincount(geom, minlength=n), value("dim")
        held, wide = np.vstack([seg, part]).T, 5
    else:
        seg, part, size, dim = np.empty((4, 0)), np.empty(0, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        held, wide = None, 4
    start = np.cumsum(size) - size
    raw = np.ascontiguousarray(box.T if held is None else held).tobytes()
    cuts = (8 * wide * (np.arange(n + 1) if held is None else np.append(start, len(part)))).tolist()
    seen: dict[tuple[int, bytes], int] = {}
    of = np.fromiter((seen.setdefault((d, raw[p:q]), len(seen)) for d, p, q in zip(dim.tolist(), cuts, cuts[1:])), np.int64, n)
    rep = np.unique(of, return_index=True)[1]
    if "ids" in rows.column_names:
        lists = rows.column("ids").combine_chunks()
        ids, of = lists.flatten(), np.repeat(of, lists.value_lengths().to_numpy())
    else:
        ids = rows.column("id").combine_chunks()
    order = np.argsort(of, kind="stable")
    count = np.bincount(of, minlength=len(seen))
    first = np.cumsum(count) - count
    begins = np.stack([value(c) for c in ("begins0", "begins1")])[:, rep]
    return Objects(ids, box[:, rep], value("_own")[rep], begins, dim[rep], seg, part, start[rep], size[rep], of, order, first, count)


def met_boxes(a: Objects, b: Objects, at: int, boxes: str, by: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j) of distinct objects that this cell keeps and whose envelopes fit, with the square of the envelopes' distance."""
    wide = a.box + np.array([[-by], [by], [-by], [by]])
    for i, j in probed(packed(b.box), wide):
        keep = (a.begins[:, i] | b.begins[:, j]).all(axis=0)
        first, second = np.maximum(a.own[i] // TWO, b.own[j] // TWO), np.maximum(a.own[i] % TWO, b.own[j] % TWO)
        keep &= first * TWO + second == at
        i, j = i[keep], j[keep]
        p, q = a.box[:, i], b.box[:, j]
        if boxes == "contains":
            keep = (p[0] <= q[0]) & (q[1] <= p[1]) & (p[2] <= q[2]) & (q[3] <= p[3])
        elif boxes == "within":
            keep = (q[0] <= p[0]) & (p[1] <= q[1]) & (q[2] <= p[2]) & (p[3] <= q[3])
        gap = [np.maximum(np.maximum(0.0, p[d] - q[d + 1]), q[d] - p[d + 1]) for d in (0, 2)]
        square = gap[0] * gap[0] + gap[1] * gap[1]
        if boxes not in ("contains", "within"):
            keep = square <= by * by
        if keep.any():
            yield i[keep], j[keep], square[keep]


def _chunks(size: np.ndarray) -> Iterator[slice]:
    group = (np.cumsum(size) - size) // AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(size)]
    yield from (slice(x, y) for x, y in zip(cuts[:-1], cuts[1:], strict=True) if y > x)


def _contains(found: dict[str, np.ndarray], dim: dict[str, np.ndarray], a: str, b: str) -> np.ndarray:
    """shapes.contains of arrays."""
    areas = ~found["crosses"] & ~found["opposite"] & ~found[f"{a}_inside"]
    return (dim[a] >= dim[b]) & ~found[f"{b}_outside"] & np.where(dim[b] == 2, areas, found[f"{b}_inside"])


def _holds(name: str, found: dict[str, np.ndarray], dim: dict[str, np.ndarray]) -> np.ndarray:
    """The predicates of shapes of arrays."""
    if name == "intersects":
        return found["touches"] | found["a_inside"] | found["b_inside"]
    if name in ("contains", "within"):
        return _contains(found, dim, *("ab" if name == "contains" else "ba"))
    meet = np.where(dim["a"] == 2, found["crosses"] | found["a_inside"] | found["b_inside"] | found["same"], found["b_inside"])
    return (dim["a"] == dim["b"]) & meet & ~_contains(found, dim, "a", "b") & ~_contains(found, dim, "b", "a")


def _fit(a: Objects, b: Objects, at: int, name: str, by: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of distinct objects for which `name` holds, with their distance where it is asked for: of rectangles its square."""
    for i, j, square in met_boxes(a, b, at, "intersects" if name == "overlaps" else name, by):
        if name == "boxes":
            yield i, j, square
            continue
        for k in _chunks(a.size[i] + b.size[j]):
            one, two = a.side(i[k]), b.side(j[k])
            found = relate.related(one, two, deep=name not in ("intersects", "distance"))
            if name == "distance":
                apart = ~(found["touches"] | found["a_inside"] | found["b_inside"])
                far = relate.distances(one, two, apart, by)
                keep = far <= by
            else:
                far = square[k]
                keep = _holds(name, found, {"a": one.dim, "b": two.dim})
            if keep.any():
                yield i[k][keep], j[k][keep], far[keep]


def _listed(t: Objects, start: np.ndarray, size: np.ndarray) -> pa.ListArray:
    """Runs of t's ids by object as lists."""
    ends = np.cumsum(size)
    at = np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), t.ids.take(pa.array(t.order[at])))


def _multiplied(a: Objects, b: Objects, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The ids of both objects of each pair, as lists of LISTED at most that meet all of the other's, in parts of OUT ids or one pair of lists."""
    across = -(-b.count[j] // LISTED)
    many = -(-a.count[i] // LISTED) * across
    ends = np.cumsum(many)
    for p in range(0, int(ends[-1]), OUT):
        at = np.arange(p, min(p + OUT, int(ends[-1])))
        k = np.searchsorted(ends, at, side="right")
        runs = []
        for t, which, piece in zip((a, b), (i[k], j[k]), np.divmod(at - ends[k] + many[k], across[k]), strict=True):
            runs.append((t, t.first[which] + piece * LISTED, np.minimum(LISTED, t.count[which] - piece * LISTED)))
        part = np.cumsum(runs[0][2] + runs[1][2]) // OUT
        for rows in np.split(np.arange(len(at)), np.flatnonzero(np.diff(part)) + 1):
            yield pa.RecordBatch.from_arrays([_listed(t, start[rows], size[rows]) for t, start, size in runs], ["ids_a", "ids_b"])


def _nearest(a: Objects, b: Objects, fit: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """For each row of a the least distance, and the smallest id at that."""
    best, which = np.full(len(a.count), np.inf), np.full(len(a.count), NULL)
    ids = pc.fill_null(b.ids, int(NULL)).to_numpy()
    least = np.minimum.reduceat(ids[b.order], b.first)
    for i, j, far in fit:
        order = np.lexsort((least[j], far, i))
        i, name, far = i[order], least[j][order], far[order]
        first = np.append(True, i[1:] != i[:-1])
        i, name, far = i[first], name[first], far[first]
        better = (far < best[i]) | ((far == best[i]) & (name < which[i]))
        best[i[better]], which[i[better]] = far[better], name[better]
    rows = np.flatnonzero(np.isfinite(best[a.of]))
    of = a.of[rows]
    yield pa.RecordBatch.from_arrays([a.ids.take(pa.array(rows)), pa.array(which[of], mask=which[of] == NULL), pa.array(best[of])], ["id_a", "id_b", "far"])


def grouped_join(a: DataFrame, b: DataFrame, *, name: str, by: float = 0.0, nearest: bool = False, per_group: int = PER_GROUP, held: int = HELD) -> DataFrame:
    """Rows (id_a, id_b) of tables (id, ids, SIDES, dim, segs), merged() by shapes, for which `name` holds: intersects, contains, within, overlaps, or distance up to `by`.

    id is a number of the row's own; without ids it is the row's only one. name = boxes: tables (id, SIDES), whose
    rectangles are at most `by` apart. With nearest rows (id_a, id_b, far): for each
    row of a and cell the nearest of b there, ties to the smallest id; far is the distance, of boxes its square.
    """
    grid = sized_grid(a, b, per_cell=per_group)
    if grid is None:
        return a.sparkSession.createDataFrame([], "id_a long, id_b long" + ", far double" * nearest)
    lists = "ids" in a.columns
    more = ["ids"] * lists + ([] if name == "boxes" else ["dim", "segs"])
    key = [*CELL, "block_a", "block_b"]
    weight = F.ceil(F.size("ids") / WEIGHT) if lists else None
    rows = blocked(*leveled(*(t.select("id", *SIDES, *more) for t in (a, b)), grid, by), CELL, held, weight)
    mark = lambda t, first: t.select(*key, "id", *SIDES, *more, "_own", "begins0", "begins1", F.lit(first).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = pa.Table.from_batches(batches)
        left, right = every.filter(every.column("first")), every.filter(pc.invert(every.column("first")))
        if not len(left) or not len(right):
            return
        at, x, y = left.column("_at")[0].as_py(), objects(left), objects(right)
        fit = _fit(x, y, at, name, by)
        if nearest:
            yield from _nearest(x, y, fit)
        else:
            for i, j, _ in fit:
                yield from _multiplied(x, y, i, j)

    both = mark(rows[0], True).unionByName(mark(rows[1], False))
    groups = dealt(both, *key).groupBy(*key)
    if nearest:
        return groups.applyInArrow(run, "id_a long, id_b long, far double")
    return taken_apart(groups.applyInArrow(run, "ids_a array<long>, ids_b array<long>"))
