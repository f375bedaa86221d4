"""Well-known text as segments, a batch of texts at a time in numpy."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

XY = ("x0", "y0", "x1", "y1")
_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_CORNER = rf"\s*{_NUMBER}\s+{_NUMBER}\s*"


def _list_of(item: str) -> str:
    # possessive: what is no geometry is refused in one pass
    return rf"\s*\({item}(?:,{item})*+\)\s*"


_PATH = _list_of(_CORNER)
_FORMS = {
    "POINT": rf"\s*\({_CORNER}\)\s*",
    "LINESTRING": _PATH,
    "POLYGON": _list_of(_PATH),
    "MULTIPOINT": rf"(?:{_PATH}|{_list_of(rf'\s*\({_CORNER}\)\s*')})",
    "MULTILINESTRING": _list_of(_PATH),
    "MULTIPOLYGON": _list_of(_list_of(_PATH)),
}
_VALID = re.compile(r"\s*(?:" + "|".join(f"({kind}){form}" for kind, form in _FORMS.items()) + ")", re.IGNORECASE)
_PARTS = re.compile(r"\(([^()]+)\)")
_DIMS = [0, 1, 2] * 2


def parsed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The dimension of each text's geometry (-1: none), and all segments: their ends as rows, their text and their part of it.

    Geometries are a POINT, LINESTRING, POLYGON or a MULTI kind of planar, finite coordinates. Rings are closed; segments
    without length go, but a part that has no other keeps one.
    """
    dim, parts, owner = np.full(len(texts), -1, np.int32), [], []
    for i, text in enumerate(texts):
        if text and (m := _VALID.fullmatch(text)):
            dim[i] = _DIMS[m.lastindex - 1]
            found = _PARTS.findall(text)
            parts += found
            owner += [i] * len(found)
    size = np.fromiter((p.count(",") + 1 for p in parts), np.int64, len(parts))
    at = np.array(" ".join(parts).replace(",", " ").split(), np.float64).reshape(-1, 2).T
    geom = np.repeat(np.array(owner, np.int64), size)
    dim[geom[~np.isfinite(at).all(axis=0)]] = -1
    ends = np.cumsum(size)
    part = np.repeat(np.arange(len(size)), size)
    first = np.repeat(ends - size, size)
    last = np.zeros(len(part), bool)
    last[ends - 1] = True
    kind = dim[geom]
    after = np.where(kind == 0, np.arange(len(part)), np.where(last & (kind == 2), first, np.where(last, np.arange(len(part)), np.arange(len(part)) + 1)))
    seg = np.concatenate([at, at[:, after]])
    flat = (seg[:2] == seg[2:]).all(axis=0)
    lone = np.bincount(part, weights=~flat, minlength=len(size))[part] == 0
    keep = (kind >= 0) & (~flat | (kind == 0) | (lone & (np.arange(len(part)) == first)))
    number = np.where(kind == 0, np.arange(len(part)), part)
    geom, seg, number = geom[keep], seg[:, keep], number[keep]
    base = np.concatenate(([0], np.flatnonzero(np.diff(geom)) + 1)) if len(geom) else np.empty(0, np.int64)
    return dim, seg, geom, number - np.repeat(number[base], np.diff(np.append(base, len(geom)))) if len(geom) else number


def listed(seg: np.ndarray, geom: np.ndarray, part: np.ndarray, n: int) -> pa.ListArray:
    """Segments as n lists of struct(x0, y0, x1, y1, part)."""
    fields = pa.StructArray.from_arrays([pa.array(c) for c in seg] + [pa.array(part.astype(np.int32))], [*XY, "part"])
    offsets = np.concatenate(([0], np.cumsum(np.bincount(geom, minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), fields)


def flattened(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ends of all segments of an array of lists as rows, the number of each one's list, and its part."""
    of = lists.flatten()
    seg = np.stack([of.field(c).to_numpy(zero_copy_only=False) for c in XY]) if len(of) else np.empty((4, 0))
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return seg, np.repeat(np.arange(len(lists)), size), of.field("part").to_numpy(zero_copy_only=False)


def shapes_of(texts: pa.Array) -> pa.StructArray:
    """struct(dim, segs) of each text; null for what is no geometry."""
    dim, seg, geom, part = parsed(texts.to_pylist())
    return pa.StructArray.from_arrays([pa.array(dim), listed(seg, geom, part, len(dim))], ["dim", "segs"], mask=pa.array(dim < 0))
