"""A stream of rectangles joined with a static table: the grid join, whose keys need no state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.predicates import predicate, side, valid
from ..operators.join import _once
from ..operators.partition import Grid, assign


def stream_join(stream: DataFrame, static: DataFrame, grid: Grid, *, boundary: str = "closed") -> DataFrame:
    """Rows (id_a, id_b) for each rectangle of the stream as it comes; the grid is fixed beforehand (sized_grid of the static side).

    Rectangles beyond the grid's extent belong to its border cells.
    """
    a, b = side(assign(valid(stream), grid), "a", "cx", "cy"), side(assign(valid(static), grid), "b", "cx", "cy")
    return a.join(b, ["cx", "cy"]).where(predicate("intersects", boundary) & _once(grid, 0.0)).select("id_a", "id_b")
