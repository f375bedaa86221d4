"""Exact top-k inner products: exhaustive term-at-a-time accumulation over blocks of candidates.

A term is a component's place, a posting a candidate's place in its block and its weight there. For a block of
candidates a task builds the lists of all terms once; for each query it goes through the query's terms and scatters
weighted postings into a dense array of scores, one place for each candidate. numpy's partition selects the largest of
the block, and a window merges the selections of all blocks. Every query meets every candidate: blocks of both sides
are of bounded size, each pair of blocks is one group, and only k rows for each query and block leave it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import deal, stored

#: Rows of a block at most, and the bytes of the score arrays that a task fills at once.
CANDIDATES, QUERIES, SCORES = 1 << 16, 1 << 14, 8 << 20
#: Candidates of a block at least: smaller blocks pay more for their queries than for the scores.
LEAST = 1 << 10


def weights(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component in double precision; null for a null vector or one with a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")))


def postings(lists: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of weights: for each term the rows that have it and their weights there; and all (row, term, weight) by row."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), size)
    term = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    row, term, flat = (x[flat != 0] for x in (row, term, flat))
    order = np.argsort(term, kind="stable")
    ends = np.cumsum(np.bincount(term, minlength=int(size.max(initial=0))))
    return list(zip(np.split(row[order], ends[:-1]), np.split(flat[order], ends[:-1]), strict=True)) if len(ends) else [], row, term, flat


def accumulate(terms: list[tuple[np.ndarray, np.ndarray]], n: int, rows: int, row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Scores of `rows` sparse queries (row, term, weight) against n candidates, term after term."""
    scores = np.zeros((rows, n), np.int64)
    order = np.argsort(term, kind="stable")
    row, term, weight = row[order], term[order], weight[order]
    for own in np.split(np.arange(len(term)), np.flatnonzero(np.diff(term)) + 1) if len(term) else []:
        if (t := term[own[0]]) < len(terms):
            at, values = terms[t]
            if len(at) == n:
                scores[row[own]] += weight[own, None] * values
            else:
                scores[np.ix_(row[own], at)] += weight[own, None] * values
    return scores


def largest(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores of a row; of equal ones those of the smallest ids."""
    if len(scores) > k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= bar)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def search(vectors: DataFrame, *, queries: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", candidates: int = CANDIDATES, block: int = QUERIES) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for every row of vectors for which `queries` holds, the k best of all other rows.

    The score is the inner product of weights() as 64-bit integers; ties go to smaller ids. Components beyond those of
    the other vector count as 0. Vectors that are null, hold a null or non-finite component or have a null id take no
    part; empty ones score 0. A row is no candidate of a query of its own id; rows that repeat are candidates each and
    queries each, with ranks of their own. Fewer rows than k give all. Weights beyond 64 bits end at the largest long;
    sums wrap around. Empty tables give no rows. Further columns are not read. `candidates` and `block` bound the rows
    of a pair of blocks.
    """
    spark = vectors.sparkSession
    rows = stored(vectors.select(vectors[id_col].cast("long").alias("id"), weights(vectors[vector_col], scale).alias("w"), F.coalesce(queries, F.lit(False)).alias("query")).where("id IS NOT NULL AND w IS NOT NULL"), "vectors")
    count, asked = rows.agg(F.count("*"), F.count_if("query")).first()
    across = max(math.ceil(count / candidates), min(deal(spark), math.ceil(count / LEAST)), 1)
    down = max(math.ceil(asked / block), 1)
    # numbers of the written rows: the same if a task runs again, and even where one id or vector is most of the table
    numbered = rows.withColumn("n", F.monotonically_increasing_id())
    dealt = lambda parts, salt: F.pmod(F.xxhash64("n", F.lit(salt)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    right = numbered.select(F.col("id").alias("candidate"), F.col("w").alias("has"), dealt(across, 0).alias("c"), every(down).alias("q"))
    left = numbered.where("query").select(F.col("n").alias("number"), F.col("id").alias("own"), F.col("w").alias("asks"), every(across).alias("of_c"), dealt(down, 1).alias("of_q"))

    def best(one: pa.Table, two: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if one.num_rows and two.num_rows:
            ids, own, number = (t.column(c).to_numpy() for t, c in ((two, "candidate"), (one, "own"), (one, "number")))
            by_id = np.sort(ids)
            terms = postings(two.column("has").combine_chunks())[0]
            _, row, term, weight = postings(one.column("asks").combine_chunks())
            step = max(1, SCORES // (8 * len(ids)))
            for a in range(0, len(own), step):
                part = own[a : a + step]
                mine = slice(*np.searchsorted(row, (a, a + step)))
                scores = accumulate(terms, len(ids), len(part), row[mine] - a, term[mine], weight[mine])
                # its own rows can be among the best: as many more are taken
                same = np.searchsorted(by_id, part, "right") - np.searchsorted(by_id, part)
                for i, s in enumerate(scores):
                    at = largest(s, ids, k + same[i])
                    at = at[ids[at] != part[i]][:k]
                    for x, values in zip(out, (np.full(len(at), number[a + i]), np.full(len(at), part[i]), ids[at], s[at]), strict=True):
                        x.append(values)
        return pa.table([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out], names=["n", "query_id", "vec_id", "score"])

    found = left.groupBy("of_c", "of_q").cogroup(right.groupBy("c", "q")).applyInArrow(best, "n long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
