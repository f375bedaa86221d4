"""Embedding near-dedup: Euclidean p-stable hashing, then exact cosines.

Unit vectors at cosine c are sqrt(2 - 2c) apart. Each hash table projects a vector on Gaussian directions, shifts them and
cuts them into cells of WIDTH; equal cells of one label are a bucket. Two vectors at the threshold share no bucket with a
chance of MISS, closer ones with less (threshold 0.98: at 0.99 with 1e-6).

Directions and tables follow the threshold and the largest label (`sizes`): 8 and 28 for 0.98 and labels of up to some
10,000 vectors, then one direction more for each 3 to 4 times as many, and the tables that keep MISS. So a vector meets
fewer others at right angles to it than there are tables, however large its label; tables grow with about its 0.155th power.

Equal vectors of one label are one class. Buckets travel as (key, class) alone; those with two classes or more fetch
their vectors. A bucket is compared in blocks of BLOCK classes, block pair by block pair, and tells only sums: how many
vectors each class links to, and a spanning forest of the links. A pair that meets in several tables counts in the first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from .graph import components
from .minhash import runs_of
from .shared import bounded_batches, deal, dropped, stored
from .text import mixed

WIDTH, MISS = 1.0, 3.5e-4
#: What a pair of unrelated vectors costs, in rows of a table.
PAIR = 1.0
#: At most so many directions for small labels, and cells that a task computes at a time (8 bytes each).
DIRECTIONS, CELLS = 32, 1 << 21
BLOCK = 1024


def same_cell(apart: float) -> float:
    """The chance that two vectors so far apart fall into one cell of a direction."""
    r = WIDTH / apart
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def sizes(largest: int, threshold: float) -> tuple[int, int]:
    """(tables, directions of each) for labels of at most `largest` vectors.

    The least directions let vectors at the threshold meet in a table with a chance near 1/4. More are taken while the
    tables and the vectors at right angles that are met there cost less for it.
    """
    if not 0.9 <= threshold <= 1:
        raise ValueError("threshold must lie between 0.9 and 1: below, tables are too many")
    near, far = same_cell(math.sqrt(max(2 - 2 * threshold, 1e-6))), same_cell(math.sqrt(2))
    least = max(1, min(DIRECTIONS, round(math.log(0.25) / math.log(near))))
    shapes = [(math.ceil(math.log(MISS) / math.log1p(-(near**k))), k) for k in range(least, least + 2 * DIRECTIONS)]
    return min(shapes, key=lambda s: s[0] * (1 + PAIR * largest * far ** s[1]))


@lru_cache(4)
def hash_functions(dims: int, tables: int, directions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    random, n = np.random.default_rng((1_729, dims)), tables * directions
    odd = np.uint64(1)
    return random.standard_normal((dims, n)), random.uniform(0, WIDTH, n), random.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + odd


def bucket_keys(unit: np.ndarray, label: np.ndarray, tables: int, directions: int) -> np.ndarray:
    """A 64-bit key for each vector (rows) and table; label: 64-bit hashes."""
    lines, shift, odd = hash_functions(unit.shape[1], tables, directions)
    own = mixed(np.arange(tables, dtype=np.uint64) + np.uint64(unit.shape[1] << 16))
    out = np.empty((len(unit), tables), np.int64)
    step = max(1, CELLS // (tables * directions))
    for a in range(0, len(unit), step):
        cells = np.floor((unit[a : a + step] @ lines + shift) / WIDTH).astype(np.int64).view(np.uint64)
        key = mixed((cells * odd).reshape(-1, tables, directions).sum(2, dtype=np.uint64))
        out[a : a + step] = mixed(key ^ own[None, :] ^ mixed(label[a : a + step])[:, None]).view(np.int64)
    return out


def marked(vectors: DataFrame, kind: str) -> DataFrame:
    """Rows (vec_id, d1, d2, label, vec); all but vec_id null for vectors that link with nothing. vec: components of `kind`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = batch.column(0), batch.column(2).to_pylist()
            out = {c: [None] * batch.num_rows for c in ("d1", "d2", "label", "vec")}
            for i, (v, label, none) in enumerate(zip(batch.column(1), labels, ids.is_null().to_pylist(), strict=True)):
                if none or label is None or not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(kind)
                if len(x) and np.isfinite(x).all() and x.any():
                    digest = xxhash.xxh3_128_digest(x.tobytes(), seed=label & 0xFFFFFFFFFFFFFFFF)
                    out["d1"][i], out["d2"][i] = np.frombuffer(digest, np.int64).tolist()
                    out["label"][i], out["vec"][i] = label, x.tobytes()
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, t) for x, t in zip(out.values(), types, strict=True))], ["vec_id", *out])

    label = F.col("label") if vectors.schema["label"].dataType.typeName() in ("byte", "short", "integer", "long") else F.when(F.col("label").isNotNull(), F.xxhash64("label"))
    ddl = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, d1 bigint, d2 bigint, label bigint, vec binary"
    return vectors.select("vec_id", "embedding", label.cast("long").alias("label")).mapInArrow(run, ddl)


def hashed_classes(classes: DataFrame, kind: str, tables: int, directions: int) -> DataFrame:
    """classes (with vec and label) and their keys, one for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.binary_length(batch.column("vec")).to_numpy()
            for k in np.unique(size):
                part = batch.take(pa.array(np.flatnonzero(size == k)))
                x = np.frombuffer(b"".join(part.column("vec").to_pylist()), kind).reshape(part.num_rows, -1)
                keys = bucket_keys(normal(x), part.column("label").to_numpy().view(np.uint64), tables, directions)
                ends = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * tables)
                yield part.append_column("keys", pa.ListArray.from_arrays(ends, pa.array(keys.ravel())))

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    return classes.mapInArrow(run, f"{ddl}, keys array<bigint>")


def normal(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; first over their largest component, so that squares neither vanish nor overflow."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def part_of(linked: np.ndarray) -> np.ndarray:
    """The first member of its part for each row of a symmetric matrix of links."""
    root = np.arange(len(linked))
    while True:
        low = np.minimum(root, np.where(linked, root[None, :], len(root)).min(1))
        low = low[low]
        if (low == root).all():
            return root
        root = low


def compared(members: DataFrame, threshold: float, kind: str = "<f8") -> DataFrame:
    """Rows (a, b, links) from members (key, pair, side, tab, rep, label, n, vec, keys) of bucket blocks, sorted by (key, pair).

    keys: those of the tables before tab, at least.
    With b: a link of the spanning forest. Without: a links to so many vectors of other classes in this block pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs_of(batches, ["key", "pair"]):
            col = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "pair", "side", "tab", "rep", "label", "n")}
            vec, lists = batch.column("vec"), batch.column("keys")
            start, keys = lists.offsets.to_numpy(), lists.values.to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero((col["key"][1:] != col["key"][:-1]) | (col["pair"][1:] != col["pair"][:-1])) + 1, [batch.num_rows]))
            a, b, count_of, count = [], [], [], []
            # lengths or tables can share a bucket's key by chance: each is compared by itself
            size = (pc.binary_length(vec).to_numpy(zero_copy_only=False).astype(np.int64) << 32) + col["tab"]
            groups = [x + np.flatnonzero(size[x:y] == k) for x, y in zip(cuts[:-1], cuts[1:], strict=True) if y - x > 1 for k in np.unique(size[x:y])]
            for at in groups:
                if len(at) < 2:
                    continue
                unit = normal(np.frombuffer(b"".join([vec[i].as_buffer() for i in at.tolist()]), kind).reshape(len(at), -1))
                linked = (unit @ unit.T >= threshold) & (col["label"][at, None] == col["label"][None, at])
                np.fill_diagonal(linked, False)
                side = col["side"][at]
                if side[0] >= 0:
                    linked &= side[:, None] != side[None, :]
                if not linked.any():
                    continue
                for t in range(col["tab"][at[0]]):
                    earlier = keys[start[at] + t]
                    linked &= earlier[:, None] != earlier[None, :]
                rep = col["rep"][at]
                links = linked @ col["n"][at]
                some = np.flatnonzero(links)
                root = part_of(linked)
                moved = np.flatnonzero(root != np.arange(len(root)))
                a.append(rep[moved])
                b.append(rep[root[moved]])
                count_of.append(rep[some])
                count.append(links[some])
            if a:
                a, b, count_of, count = (np.concatenate(v) for v in (a, b, count_of, count))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((a, count_of))), pa.concat_arrays([pa.array(b), pa.nulls(len(count), pa.int64())]), pa.array(np.concatenate((np.zeros(len(a), np.int64), count)))], ["a", "b", "links"])

    return members.mapInArrow(run, "a bigint, b bigint, links bigint")


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.98, block: int = BLOCK) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of vectors (vec_id, embedding, label).

    Vectors link at a cosine of threshold or more in double precision if their labels are equal. Null, empty or zero
    vectors, those with null or non-finite components, and those without label or id link with nothing; a row without id
    has no component and is kept. Rows that share a vec_id are vectors of their own; those that are the smallest of
    their class are one node of the component. Very long vectors are compared whole. An empty table gives none; further
    columns are not read. A threshold outside 0.9 to 1 is refused.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    marks = stored(marked(vectors, kind), "vectors")
    largest = marks.where("d1 IS NOT NULL").groupBy("label").count().agg(F.max("count")).first()[0] or 0
    tables, directions = sizes(largest, threshold)
    same = ["d1", "d2"]
    first = [F.min(F.col("vec_id").cast("long")).alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("vec").alias("vec")]
    grouped = marks.where("d1 IS NOT NULL").groupBy(*same).agg(*first)
    classes = stored(hashed_classes(grouped, kind, tables, directions), "classes")
    keyed = classes.select("rep", *same, F.posexplode("keys").alias("tab", "key"))
    shared = stored(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    width = F.ceil(F.col("size") / block).cast("int")
    placed = keyed.join(shared, "key").withColumn("width", width).withColumn("side", F.pmod(F.xxhash64(*same), F.col("width")).cast("int"))
    # a bucket of one block: pair 0, side -1. Of more: each block with itself, and each two
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    pair = F.least("side", "other") * F.col("width") + F.greatest("side", "other")
    rows = other.select("key", pair.alias("pair"), F.when(F.col("side") == F.col("other"), -1).otherwise(F.col("side")).alias("side"), "tab", *same)
    earlier = F.slice("keys", F.lit(1), F.col("tab")).alias("keys")
    members = rows.join(classes, same).select("key", "pair", "side", "tab", "rep", "label", "n", "vec", earlier)
    found = stored(compared(members.repartition(deal(spark), "key", "pair").sortWithinPartitions("key", "pair", "rep"), threshold, kind), "cosines")
    dropped(shared)
    counts = found.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    told = classes.select(*same, "rep", "n").join(counts, F.col("rep") == counts["a"], "left").join(roots, F.col("rep") == roots["node"], "left")
    told = told.select(*same, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("root", "rep").alias("component"))
    out = marks.select("vec_id", *same).join(told, same, "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", F.col("vec_id").cast("long")))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
