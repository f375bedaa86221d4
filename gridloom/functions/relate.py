"""How two geometries lie to each other, for a batch of pairs at once, from their segments.

Each side is noded: a segment is cut where a corner of the other side lies on it. Every piece is then inside, outside or
along the other side, and along a polygon's border it has the other interior on the same hand or on the opposite one.
Segments that properly cross are not cut there: a crossing of a polygon's border puts a piece on either side of it at
once. So all nodes are corners of the input, and each test is the sign of a determinant of input numbers: taken from
doubles where its error bound allows, else from fractions. Points are segments of no length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np

#: Relative error of the sum of two determinants of three corners in doubles (rounded up), and pairs of segments compared at once.
ERROR, BLOCK = 8e-16, 1 << 19
FLAGS = ("touches", "crosses", "a_inside", "a_outside", "b_inside", "b_outside", "same", "opposite")


@dataclass
class Side:
    """Segments of one side of all pairs: `seg` has rows x0, y0, x1, y1; `pair` ascends; polygons keep their inside on the left."""

    seg: np.ndarray
    pair: np.ndarray
    part: np.ndarray
    dim: np.ndarray  #: of each pair's geometry

    def __post_init__(self):
        self.low = np.minimum(self.seg[:2], self.seg[2:])
        self.high = np.maximum(self.seg[:2], self.seg[2:])
        self.flat = (self.seg[0] == self.seg[2]) & (self.seg[1] == self.seg[3])
        self.first = np.append(True, (self.pair[1:] != self.pair[:-1]) | (self.part[1:] != self.part[:-1]))[: len(self.pair)]


def signs(seg: np.ndarray, p: np.ndarray, q: np.ndarray | None = None) -> np.ndarray:
    """On which side of each segment a point lies (1 left, 0 in line, -1 right), or the middle of two points.

    Exact but for products of differences that fall below the smallest double, which count as 0.
    """
    total, bound = 0.0, 0.0
    for x, y in (p,) if q is None else (p, q):
        left, right = (seg[2] - seg[0]) * (y - seg[1]), (seg[3] - seg[1]) * (x - seg[0])
        total, bound = total + (left - right), bound + ERROR * (np.abs(left) + np.abs(right))
    out = np.sign(total).astype(np.int8)
    # a determinant without products is 0 for certain: differences of doubles are 0 of equal ones only
    unsure = np.flatnonzero(~(np.abs(total) > bound) & (bound > 0))
    # multiples of 2**-10 up to 2**14: no product or sum is rounded
    fixed = 1024 * np.concatenate([x[:, unsure] for x in (seg, p, q) if x is not None])
    for k in unsure[~((fixed == np.rint(fixed)) & (np.abs(fixed) <= 1 << 24)).all(axis=0)]:
        x0, y0, x1, y1 = map(Fraction, seg[:, k].tolist())
        det = sum((x1 - x0) * (Fraction(float(t[1, k])) - y0) - (y1 - y0) * (Fraction(float(t[0, k])) - x0) for t in ((p,) if q is None else (p, q)))
        out[k] = (det > 0) - (det < 0)
    return out


def above_middle(y: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Is y > (p + q) / 2? The rounding of the sum decides where its rounded value ties."""
    s = p + q
    back = s - p
    rest = (p - (s - back)) + (q - back)
    return (2 * y > s) | ((2 * y == s) & (rest < 0))


def boxed(s: Side, at: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Do the points lie in the boxes of segments `at`?"""
    return ((p >= s.low[:, at]) & (p <= s.high[:, at])).all(axis=0)


def runs(pair_a: np.ndarray, low_a: np.ndarray, high_a: np.ndarray, pair_b: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of the same pair of geometries whose closed intervals meet, in blocks: each side sorted by its lows, the other searched."""
    values = np.unique(np.concatenate((low_a, high_a, low_b, high_b)))
    place = lambda pair, x: pair * (len(values) + 1) + np.searchsorted(values, x)
    for (pair, low, high), (other, start), turned in (((pair_a, low_a, high_a), (pair_b, low_b), False), ((pair_b, low_b, high_b), (pair_a, low_a), True)):
        order = np.argsort(place(other, start), kind="stable")
        keys = place(other, start)[order]
        begin = np.searchsorted(keys, place(pair, low), "right" if turned else "left")  # of equal lows a's is the first
        count = np.maximum(np.searchsorted(keys, place(pair, high), "right") - begin, 0)
        for rows in np.split(np.arange(len(count)), np.flatnonzero(np.diff(np.cumsum(count) // BLOCK)) + 1):
            size = count[rows]
            i = np.repeat(rows, size)
            j = order[np.arange(len(i)) - np.repeat(np.cumsum(size) - size - begin[rows], size)]
            yield (j, i) if turned else (i, j)


def contacts(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments (i, j) that share a point, whether they cross inside both, and the signs of j's ends to i and of i's ends to j."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool), np.empty((4, 0), np.int8))]
    for i, j in runs(a.pair, a.low[1], a.high[1], b.pair, b.low[1], b.high[1]):
        meet = (a.low[0, i] <= b.high[0, j]) & (b.low[0, j] <= a.high[0, i])
        i, j = i[meet], j[meet]
        s = np.stack([signs(a.seg[:, i], b.seg[:2, j]), signs(a.seg[:, i], b.seg[2:, j]), signs(b.seg[:, j], a.seg[:2, i]), signs(b.seg[:, j], a.seg[2:, i])])
        crosses = (s[0] * s[1] < 0) & (s[2] * s[3] < 0)
        ends = [(s[k] == 0) & boxed(own, at, p) for k, (own, at, p) in enumerate(((a, i, b.seg[:2, j]), (a, i, b.seg[2:, j]), (b, j, a.seg[:2, i]), (b, j, a.seg[2:, i])))]
        hit = crosses | np.any(ends, axis=0)
        found.append((i[hit], j[hit], crosses[hit], s[:, hit]))
    return tuple(np.concatenate([f[k] for f in found], axis=-1) for k in range(4))


def inside(pair: np.ndarray, p: np.ndarray, q: np.ndarray, t: Side) -> np.ndarray:
    """Are the middles of p and q inside the polygon of their pair? Even-odd rays to the right; middles lie on no border."""
    odd = np.zeros(len(pair), np.int64)
    for i, j in runs(pair, np.minimum(p[1], q[1]), np.maximum(p[1], q[1]), t.pair, t.low[1], t.high[1]):
        ahead = (t.high[0, j] >= np.minimum(p[0, i], q[0, i])) & (t.seg[1, j] != t.seg[3, j])
        i, j = i[ahead], j[ahead]
        up, down = above_middle(t.seg[3, j], p[1, i], q[1, i]), above_middle(t.seg[1, j], p[1, i], q[1, i])
        i, j, up = i[up != down], j[up != down], up[up != down]
        side = signs(t.seg[:, j], p[:, i], q[:, i])
        odd += np.bincount(i[np.where(up, side > 0, side < 0)], minlength=len(pair))
    return odd % 2 == 1


def ends_of_lines(t: Side) -> np.ndarray:
    """Rows (pair, x, y) of the boundary of lines: points at which an odd number of paths end."""
    last = np.append(t.first[1:], True)[: len(t.first)]
    at = np.concatenate([np.stack([t.pair[k], *t.seg[rows, :][:, k]]) for k, rows in ((t.first, [0, 1]), (last, [2, 3]))], axis=1)
    at = at[:, t.dim[at[0].astype(np.int64)] == 1]
    rows, count = np.unique(at, axis=1, return_counts=True)
    return rows[:, count % 2 == 1]


def pieces(s: Side, at: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of s cut at nodes (on segments `at`): each piece's segment and its two ends. Segments of no length stay."""
    own = np.concatenate([np.arange(s.seg.shape[1]), at, np.arange(s.seg.shape[1])])
    p = np.concatenate([s.seg[:2], node, s.seg[2:]], axis=1)
    along = (np.abs(s.seg[2] - s.seg[0]) >= np.abs(s.seg[3] - s.seg[1]))[own]
    back = np.where(along, s.seg[2, own] < s.seg[0, own], s.seg[3, own] < s.seg[1, own])
    t = np.where(along, p[0], p[1]) * np.where(back, -1.0, 1.0)
    order = np.lexsort((t, own))
    own, p = own[order], p[:, order]
    next_own, q = own[1:], p[:, 1:]
    keep = (own[:-1] == next_own) & ((p[:, :-1] != q).any(axis=0))
    single = np.flatnonzero(s.flat)
    return np.concatenate([own[:-1][keep], single]), np.concatenate([p[:, :-1][:, keep], s.seg[:2, single]], axis=1), np.concatenate([q[:, keep], s.seg[2:, single]], axis=1)


def classed(s: Side, t: Side, i: np.ndarray, j: np.ndarray, s_to_t: np.ndarray, t_to_s: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """For each pair of geometries: are there pieces of s inside t, outside of it, and along t's border on the same or the opposite hand?

    Segments i of s and j of t are in contact; s_to_t has the signs of i's ends to j, t_to_s those of j's ends to i.
    Inside is t's interior: of lines all but their boundary, of points the points.
    """
    nodes = [(i[k], t.seg[rows, :][:, j[k]]) for rows, sign in (([0, 1], t_to_s[0]), ([2, 3], t_to_s[1])) for k in (np.flatnonzero((sign == 0) & ~s.flat[i]),)]
    nodes = [(a[b], p[:, b]) for a, p in nodes for b in (boxed(s, a, p),)]
    own, p, q = pieces(s, np.concatenate([x[0] for x in nodes]), np.concatenate([x[1] for x in nodes], axis=1))
    order = np.argsort(own, kind="stable")
    own, p, q = own[order], p[:, order], q[:, order]
    pair = s.pair[own]
    # pieces along segments of t: those of segments in line with one in contact
    line = (s_to_t == 0).all(axis=0)
    i, j = i[line], j[line]
    begin, end = np.searchsorted(own, i), np.searchsorted(own, i, "right")
    k = np.repeat(begin - np.cumsum(end - begin) + (end - begin), end - begin) + np.arange(int((end - begin).sum()))
    j = np.repeat(j, end - begin)
    on = boxed(t, j, p[:, k]) & boxed(t, j, q[:, k])
    k, j = k[on], j[on]
    along, same = np.zeros(len(own), bool), np.zeros(len(own), bool)
    along[k] = True
    wide = np.abs(t.seg[2, j] - t.seg[0, j]) >= np.abs(t.seg[3, j] - t.seg[1, j])
    ahead = np.where(wide, (q[0, k] > p[0, k]) == (t.seg[2, j] > t.seg[0, j]), (q[1, k] > p[1, k]) == (t.seg[3, j] > t.seg[1, j]))
    same[k[ahead]] = True
    dim = t.dim[pair]
    within = along & (dim < 2)
    single = np.flatnonzero(within & (dim == 1) & (s.dim[pair] == 0))
    if len(single):
        ends = {tuple(c) for c in ends_of_lines(t).T.tolist()}
        within[single] = [(float(a), *c) not in ends for a, c in zip(pair[single], p[:, single].T.tolist(), strict=True)]
    open_ = np.flatnonzero(~along & (dim == 2))
    within[open_] = inside(pair[open_], p[:, open_], q[:, open_], t)
    any_of = lambda which: np.bincount(pair[which], minlength=n) > 0
    return {"inside": any_of(within), "outside": any_of(~along & ~within), "same": any_of(along & (dim == 2) & same), "opposite": any_of(along & (dim == 2) & ~same)}


def related(a: Side, b: Side, *, deep: bool = True) -> dict[str, np.ndarray]:
    """FLAGS of each pair. Without deep, of pairs in contact only `touches` and `crosses` are filled in."""
    n = len(a.dim)
    i, j, crosses, s = contacts(a, b)
    marked = lambda pairs: np.bincount(pairs, minlength=n) > 0
    out = {"touches": marked(a.pair[i]), "crosses": marked(a.pair[i[crosses]])}
    if not deep:
        i, j, s = i[:0], j[:0], s[:, :0]
    # pairs that share no point of their segments have each part on one side: its first segment tells which
    for name, own, other, x, y, to_other, to_own in (("a", a, b, i, j, s[2:], s[:2]), ("b", b, a, j, i, s[:2], s[2:])):
        if deep:
            keep = out["touches"][own.pair] | own.first
        else:
            keep = own.first & ~out["touches"][own.pair]
        few = Side(own.seg[:, keep], own.pair[keep], own.part[keep], own.dim)
        found = classed(few, other, (np.cumsum(keep) - 1)[x], y, to_other, to_own, n)
        through = out["crosses"] & (other.dim == 2)
        out[f"{name}_inside"], out[f"{name}_outside"] = found["inside"] | through, found["outside"] | through
        if name == "b":
            out["same"], out["opposite"] = found["same"], found["opposite"]
    return out


def oriented(seg: np.ndarray, geom: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Segments of the rings of polygons, turned so that the inside is on the left: shells against the clock, holes with it.

    geom and part ascend. A ring is a hole if most of its edges' middles are inside an odd number of its polygon's rings.
    """
    if not len(geom):
        return seg
    start = np.flatnonzero(np.append(True, (geom[1:] != geom[:-1]) | (part[1:] != part[:-1])))
    ring = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(geom))))
    x, y = seg[:2] - seg[:2, start][:, ring]
    x1, y1 = seg[2:] - seg[:2, start][:, ring]
    area = np.add.reduceat(x * y1 - x1 * y, start)
    several = np.flatnonzero((np.bincount(geom[start])[geom] > 1))
    hole = np.zeros(len(start), bool)
    if len(several):
        t = Side(seg[:, several], geom[several], part[several], np.full(int(geom[-1]) + 1, 2))
        odd = np.zeros(len(several), np.int64)
        own = ring[several]
        for i, j in runs(t.pair, t.low[1], t.high[1], t.pair, t.low[1], t.high[1]):
            k = (own[i] != own[j]) & (t.high[0, j] >= t.low[0, i]) & (t.seg[1, j] != t.seg[3, j])
            i, j = i[k], j[k]
            up, down = (above_middle(t.seg[r, j], t.seg[1, i], t.seg[3, i]) for r in (3, 1))
            i, j, up = i[up != down], j[up != down], up[up != down]
            side = signs(t.seg[:, j], t.seg[:2, i], t.seg[2:, i])
            odd += np.bincount(i[np.where(up, side > 0, side < 0)], minlength=len(several))
        votes = np.bincount(own, weights=odd % 2, minlength=len(start))
        hole = 2 * votes > np.bincount(ring, minlength=len(start))
    turn = ((area > 0) == hole) & (area != 0)
    return np.where(turn[ring], seg[[2, 3, 0, 1]], seg)


def distances(a: Side, b: Side, apart: np.ndarray, most: float) -> np.ndarray:
    """The distance of each pair that is `apart`, if at most about `most`; 0 for the others, infinity beyond."""
    out = np.where(apart, np.inf, 0.0)
    ka, kb = np.flatnonzero(apart[a.pair]), np.flatnonzero(apart[b.pair])
    for i, j in runs(a.pair[ka], a.low[1, ka] - most, a.high[1, ka] + most, b.pair[kb], b.low[1, kb], b.high[1, kb]):
        i, j = ka[i], kb[j]
        near = (a.low[0, i] - most <= b.high[0, j]) & (b.low[0, j] <= a.high[0, i] + most)
        i, j = i[near], j[near]
        for seg, points in ((a.seg[:, i], b.seg[:, j]), (b.seg[:, j], a.seg[:, i])):
            d = seg[2:] - seg[:2]
            size = (d * d).sum(axis=0)
            for p in (points[:2], points[2:]):
                t = np.clip(((p - seg[:2]) * d).sum(axis=0) / np.where(size > 0, size, 1.0), 0.0, 1.0)
                np.minimum.at(out, a.pair[i], np.sqrt(((p - seg[:2] - t * d) ** 2).sum(axis=0)))
    return out
