"""Tables in which equal objects are one row with the list of their ids, so that later steps follow distinct objects.

Equal rows are dealt to one task and merged there in Arrow, a bounded part at a time: what a part holds leaves before the
next one, so an object that very many rows share is a few rows of bounded lists. Pairs of objects become pairs of ids
where generated code takes the lists apart, after the last shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import wkt
from .partition import checkpointed, dealt

#: Rows and segments that are merged at once, and ids of a list.
MERGED, LISTED = 1 << 20, 4096
#: Ids of a list that count as one more row of a group.
WEIGHT = 256


def grouped_ids(ids: pa.Array, of: np.ndarray, count: np.ndarray, listed: int) -> tuple[np.ndarray, pa.ListArray]:
    """(the object of each list, lists of `listed` ids at most) for ids whose objects `of` have `count` each."""
    order, first = np.argsort(of, kind="stable"), np.cumsum(count) - count
    pieces = -(-count // listed)
    owner = np.repeat(np.arange(len(count)), pieces)
    piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.append(first[owner] + piece * listed, len(order))
    return owner, pa.ListArray.from_arrays(pa.array(starts, pa.int32()), ids.take(pa.array(order)))


def equal_numbers(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(the object of each row, the first row of each object) by the columns after the first."""
    values = np.stack([rows.column(c).to_numpy() for c in rows.column_names[1:]])
    order = np.lexsort(values)
    x = values[:, order]
    new = np.append(True, (x[:, 1:] != x[:, :-1]).any(axis=0))
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return of, order[new]


def equal_shapes(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(the object of each row, the first row of each object) by shapes: dimension and segments, in their order."""
    shape = rows.column("shape").combine_chunks()
    dim = shape.field("dim").to_numpy(zero_copy_only=False)
    seg, geom, part = wkt.flattened(shape.field("segs"))
    raw = np.ascontiguousarray(np.vstack([seg, part]).T).tobytes()
    cuts = (40 * np.append(0, np.cumsum(np.bincount(geom, minlength=len(rows))))).tolist()
    seen: dict[tuple[int, bytes], int] = {}
    of = np.fromiter((seen.setdefault((d, raw[p:q]), len(seen)) for d, p, q in zip(dim.tolist(), cuts, cuts[1:])), np.int64, len(rows))
    return of, np.unique(of, return_index=True)[1]


def equal_texts(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(the object of each row, the first row of each object) by the texts of the second column."""
    of = rows.column(1).combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    return of, np.unique(of, return_index=True)[1]


def _size(batch: pa.RecordBatch) -> int:
    if "shape" not in batch.schema.names:
        return batch.num_rows
    return batch.num_rows + len(batch.column("shape").field("segs").flatten())


def merger(equal: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], most: int = MERGED, listed: int = LISTED) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches (id, ...) that gives batches (ids, ...) in which the equal rows of a part are one."""

    def part(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        of, first = equal(rows)
        owner, lists = grouped_ids(rows.column("id").combine_chunks(), of, np.bincount(of, minlength=len(first)), listed)
        at = pa.array(first[owner])
        once = pa.Table.from_arrays([lists, *(rows.column(c).take(at) for c in rows.column_names[1:])], names=["ids", *rows.column_names[1:]])
        # smaller batches than the part: each is held as a whole on the way to Spark
        yield from once.combine_chunks().to_batches(max_chunksize=1 << 14)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += _size(batch)
            if size >= most:
                yield from part(held)
                held, size = [], 0
        if held:
            yield from part(held)

    return run


def merged(df: DataFrame, *key: str) -> DataFrame:
    """Rows (id, ids, *key), written once, of rows (id, *key) of numbers: equal keys are one row with the list of their ids; id is a number of the row's own."""
    rows = dealt(df.select(F.col("id").cast("long").alias("id"), *(F.col(c).cast("double").alias(c) for c in key)), *key)
    once = rows.mapInArrow(merger(equal_numbers), "ids array<long>, " + ", ".join(f"{c} double" for c in key))
    return checkpointed(once.select(F.monotonically_increasing_id().alias("id"), "ids", *key))


def taken_apart(pairs: DataFrame) -> DataFrame:
    """Rows (id_a, id_b) of all pairs of ids of two lists (ids_a, ids_b)."""
    return pairs.select(F.explode("ids_a").alias("id_a"), "ids_b").select("id_a", F.explode("ids_b").alias("id_b"))
