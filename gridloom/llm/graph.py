"""Connected components of links that only the cluster holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import dropped, stored


#: Nodes with more than one HUBth of all links are hubs: there are at most twice as many of them as that.
HUB = 256
#: Links that a task holds at once while it contracts them (16 bytes each).
HELD = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as links (a, b) have, as one link from every node to the smallest node it reaches."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        high = np.maximum(root[x], root[y])
        open_ = low != high
        if not open_.any():
            break
        x, y = x[open_], y[open_]
        np.minimum.at(root, high[open_], low[open_])
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(root)))
    return nodes[moved], nodes[root[moved]]


def contracted(links: DataFrame) -> DataFrame:
    """Rows (u, v), v < u: links (a, b) without loops and nulls, those of HELD at a time that a task reads made stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def cut() -> pa.RecordBatch:
            a, b = (np.concatenate([h.column(i).to_numpy() for h in held]) for i in (0, 1))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(a, b)], ["u", "v"])

        for batch in batches:
            held.append(batch)
            if sum(h.num_rows for h in held) >= HELD:
                yield cut()
        if held:
            yield cut()

    return links.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(run, "u bigint, v bigint")


def both_ways(edges: DataFrame) -> DataFrame:
    """Rows (u, v) of edges and of edges turned round, in one scan."""
    ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return edges.select(F.explode(ways).alias("e")).select("e.u", "e.v")


def with_minimum(links: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """Rows (u, v) of links with `m`, the smallest v of each u as the stored table least (u, m, n) has it.

    Minima are aggregated before the shuffle. Those of hubs, 2 * HUB rows at most, are broadcast, so that no task gets all
    links of a hub; the rest meet by a shuffle.
    """
    hubs = least.where(F.col("n") * HUB > total)
    hub = F.broadcast(hubs.select(F.col("u").alias("h"), F.col("m").alias("hm")))
    marked = links.join(hub, links["u"] == F.col("h"), "left")
    most = marked.where("h IS NOT NULL").select("u", "v", F.col("hm").alias("m"))
    rest = marked.where("h IS NULL").select("u", "v").join(least.where(F.col("n") * HUB <= total).select("u", "m"), "u")
    return most.unionByName(rest.select("u", "v", "m"))


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root), long: of every node in links (a, b) the smallest node that is reachable, for nodes that have links.

    Every task first contracts the links it reads. Then large stars and small stars alternate over distributed tables,
    each step written to the shared folder: a round links every node to the smallest neighbour known, first those above
    it, then those below, until the minima show stars alone: no node has two smaller neighbours, nor both a smaller and
    a larger one. Loops and nulls are no links; repeated ones count once.
    """
    edges = stored(contracted(links).distinct(), "links")
    while True:
        both = both_ways(edges)
        below = F.count(F.when(F.col("v") < F.col("u"), 1))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"), below.alias("below")), "minima")
        total, amiss = least.agg(F.sum("n"), F.count_if(F.expr("below > 1 OR below = 1 AND n > 1"))).first()
        if not amiss:
            dropped(least)
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        # every neighbour above u goes to the smallest of u and its neighbours
        whole = with_minimum(both, least, total)
        large = stored(whole.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "large")
        dropped(least)
        # then of the smaller neighbours of each node the smallest takes the others and the node itself
        least = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "minima")
        whole = with_minimum(large, least, total)
        small = whole.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = stored(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
        for t in (edges, large, least):
            dropped(t)
        edges = after
