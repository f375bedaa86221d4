"""MinHash near-dedup with b-bit signatures.

1. Every text becomes the set of its hashed word shingles and PERMUTATIONS minima. Bands of the full minima give bucket
   keys; of each minimum only BITS low bits stay, packed. Texts with equal sets form one class, told by a 128-bit digest
   of the set; from here on only the classes' smallest documents count.
2. Buckets propose candidates: signatures are compared by bit counts, the estimate corrected for chance agreement. A
   bucket emits a spanning forest of its candidate graph, never all pairs: members are compared with leaders, and only a
   member that no leader resembles closely (COVER) becomes one. Candidates (LOOSE) reach so far below the threshold that
   a link between two members shows as a chain over their leaders. A bucket of more than HOT members is cut into salted
   groups whose leaders then meet group pair by group pair.
3. Candidates that hang together are verified on full sets of shingles, recomputed from the texts. Inside such a family
   links that join what is already joined need no test; all other pairs that the signatures do not rule out get one.
   Families of more than FAMILY classes are cut into blocks and verified block pair by block pair.
4. Connected components of the verified links.
A pair at the threshold of 0.8 shares no bucket with a chance of (1 - 0.8**5)**24 = 7e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .graph import components
from .shared import bounded_batches, deal, stored
from .text import PART, coded, hashed, mixed, ragged, slices, windows, words_of

PERMUTATIONS, BANDS, ROWS, BITS = 128, 24, 5, 2
LOOSE, COVER, TESTED = 0.4, 0.92, 0.55
HOT, FAMILY = 20_000, 2_000
#: Rows up to which the members of families are broadcast to the texts (about 100 bytes each).
BROADCAST_ROWS = 300_000
FIELDS = np.uint64(0x5555555555555555)

_random = np.random.default_rng(20_240_229)
MULTIPLY = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
BAND_MULTIPLY = _random.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(text: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text in one flat array, and where each text's begin.

    A-Z are lower-cased; a text of fewer than n words is one shingle; one without words has none.
    """
    words, offsets = words_of(pc.ascii_lower(pc.fill_null(text, "")))
    codes, distinct = coded(words)
    values = hashed(distinct)[codes]
    shingles, _, of = windows(values, offsets, n)
    size = np.diff(offsets)
    for short in range(1, n):
        own = np.flatnonzero(size == short)
        if len(own):
            at = offsets[:-1][own]
            x = np.full(len(own), np.uint64(short))
            for j in range(short):
                x = mixed(x * np.uint64(3) + values[at + j])
            shingles, of = np.concatenate((shingles, x)), np.concatenate((of, own))
    order = np.argsort(shingles)
    order = order[np.argsort(of[order].astype(np.uint16) if len(size) < 1 << 16 else of[order], kind="stable")]
    shingles, of = shingles[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (of[1:] != of[:-1])
    shingles, of = shingles[new], of[new]
    return shingles, np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(size)))))


def set_digest(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """128 bits of each set as two columns of int64: sums of two independent mixes of its members."""
    out = [np.add.reduceat(mixed(shingles ^ np.uint64(s)), starts) for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    return np.stack(out, 1).view(np.int64)


def signatures(shingles: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket key of each band as int64, packed low bits of all minima as uint64) of each nonempty set."""
    minima = np.empty((len(starts), PERMUTATIONS), np.uint64)
    for i in range(PERMUTATIONS):
        minima[:, i] = np.minimum.reduceat(shingles * MULTIPLY[i] + ADD[i], starts)
    bands = np.stack([mixed((minima[:, b * ROWS : (b + 1) * ROWS] * BAND_MULTIPLY[b]).sum(1, dtype=np.uint64)) for b in range(BANDS)], 1)
    low = mixed(minima) & np.uint64((1 << BITS) - 1)
    per = 64 // BITS
    shift = (np.arange(per, dtype=np.uint64) * np.uint64(BITS))[None, None, :]
    return bands.view(np.int64), (low.reshape(len(starts), -1, per) << shift).sum(2, dtype=np.uint64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity by packed signatures (rows): agreement of BITS-bit fields, less what chance gives."""
    x = a ^ b
    differ = np.bitwise_count((x | (x >> np.uint64(1))) & FIELDS).sum(-1, dtype=np.int64)
    chance = 0.5**BITS
    return (1 - differ / PERMUTATIONS - chance) / (1 - chance)


def signed(docs: DataFrame, n: int) -> DataFrame:
    """Rows (doc_id, n_shingles, fp1, fp2, sig, bands); sig and bands are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", PART):
                shingles, ends = shingle_sets(part.column(1), n)
                size = np.diff(ends)
                own = np.flatnonzero(size)
                fp = np.zeros((len(size), 2), np.int64)
                sig, bands = [None] * len(size), [None] * len(size)
                if len(own):
                    starts = ends[:-1][own]
                    fp[own] = set_digest(shingles, starts)
                    keys, low = signatures(shingles, starts)
                    for i, k, s in zip(own.tolist(), keys, low, strict=True):
                        sig[i], bands[i] = s.tobytes(), k
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(fp[:, 0].copy()), pa.array(fp[:, 1].copy()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "fp1", "fp2", "sig", "bands"])

    return docs.select("doc_id", F.col("text").alias("_text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles bigint, fp1 bigint, fp2 bigint, sig binary, bands array<bigint>")


def runs_of(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Sorted batches cut anew so that rows that agree in `columns` stay together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            last, same = held[-1], pa.array(np.ones(batch.num_rows, bool))
            for c in columns:
                same = pc.and_(same, pc.equal(batch.column(c), last.column(c)[last.num_rows - 1]))
            count = int(pc.index(same, pa.scalar(False)).as_py())
            if count < 0:
                held.append(batch)
                continue
            held.append(batch.slice(0, count))
            batch = batch.slice(count)
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            x = batch.column(c).to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
        cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
        whole = [*held, batch.slice(0, cut)]
        if sum(b.num_rows for b in whole):
            yield pa.Table.from_batches(whole).combine_chunks().to_batches()[0]
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def forest(group: np.ndarray, sig: np.ndarray, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(edges as pairs of row numbers, rows that became leaders) of many buckets at once.

    group: sorted bucket numbers. In each step every bucket's first row left is its leader, which all others left are
    compared with; those it covers leave. An edge is emitted where it joins two parts. side: if given, rows of the same
    side were compared before and are not compared again.
    """
    at = np.arange(len(group))
    part = at.copy()
    edges, leaders = [], []
    while len(at):
        g = group[at]
        first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        count = np.diff(np.append(first, len(g)))
        leader = np.repeat(at[first], count)
        leaders.append(at[first])
        est = estimate(sig[at], sig[leader])
        own = at == leader
        near = (est >= LOOSE) & ~own
        if side is not None:
            near &= side[at] != side[leader]
        join = np.flatnonzero(near & (part[at] != part[leader]))
        if len(join):
            # of the rows of one part one edge is enough
            _, one = np.unique(part[at[join]], return_index=True)
            join = join[one]
            edges.append(np.stack((at[join], leader[join]), 1))
            to = np.arange(len(group))
            to[part[at[join]]] = part[leader[join]]
            part = to[part]
        stay = ~own & ((est < COVER) | (False if side is None else side[at] == side[leader]))
        at = at[stay]
        g = group[at]
        if side is None:  # one row left alone is a leader without anybody to meet
            alone = np.ones(len(g), bool)
            alone[1:] &= g[1:] != g[:-1]
            alone[:-1] &= g[1:] != g[:-1]
            leaders.append(at[alone])
            at = at[~alone]
    return (np.concatenate(edges) if edges else np.empty((0, 2), np.int64)), (np.concatenate(leaders) if leaders else at)


def candidates(reps: DataFrame, *, hot: int = HOT) -> DataFrame:
    """Rows (a, b), some more than once: for each bucket a spanning forest of the pairs whose estimate is LOOSE or more."""
    spark = reps.sparkSession
    keyed = reps.select(F.explode("bands").alias("key"), "rep", "sig")
    many = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot), "hot-buckets")
    salted = keyed.join(many, "key", "left").select("key", F.when(F.col("n").isNull(), -1).otherwise(F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") * 2 / hot))).cast("int").alias("salt"), "rep", "sig")

    def run(batches: Iterator[pa.RecordBatch], pairs: bool = False) -> Iterator[pa.RecordBatch]:
        for batch in runs_of(batches, ["key", "salt"]):
            key, salt, rep = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "salt", "rep"))
            side = batch.column("side").to_numpy(zero_copy_only=False) if pairs else None
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])))
            group = np.cumsum(new)
            some = np.bincount(group)[group] > 1
            if not pairs:
                some |= salt >= 0
            rows = np.flatnonzero(some)
            if not len(rows):
                continue
            raw = batch.column("sig").take(pa.array(rows))
            sig = np.frombuffer(b"".join(raw.to_pylist()), np.uint64).reshape(len(rows), -1)
            found, leaders = forest(group[rows], sig, None if side is None else side[rows])
            out = rep[rows]
            yield pa.RecordBatch.from_arrays([pa.array(out[found[:, 0]]), pa.array(out[found[:, 1]]), pa.nulls(len(found), pa.int64()), pa.nulls(len(found), pa.int32()), pa.nulls(len(found), pa.binary())], FOUND)
            lead = leaders[salt[rows][leaders] >= 0] if not pairs else leaders[:0]
            yield pa.RecordBatch.from_arrays([pa.array(out[lead]), pa.nulls(len(lead), pa.int64()), pa.array(key[rows][lead]), pa.array(salt[rows][lead]), raw.take(pa.array(lead, pa.int64()))], FOUND)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches, True)

    ddl = "a bigint, b bigint, key bigint, salt int, sig binary"
    found = stored(salted.repartition(deal(spark), "key", "salt").sortWithinPartitions("key", "salt", "rep").mapInArrow(run, ddl), "candidates")
    pairs = found.where("b IS NOT NULL").select("a", "b")
    if many.isEmpty():
        return pairs
    # groups of hot buckets: the leaders of each two meet, numbered lower * width + higher
    leaders = found.where("b IS NULL").join(many, "key").withColumn("width", F.ceil(F.col("n") * 2 / hot).cast("int"))
    other = leaders.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("width") - 1))).where("other <> salt")
    both = other.select("key", (F.least("salt", "other") * F.col("width") + F.greatest("salt", "other")).alias("pair"), F.col("a").alias("rep"), "sig", F.col("salt").alias("side"))
    crossed = both.select("key", F.col("pair").cast("int").alias("salt"), "rep", "sig", "side").repartition(deal(spark), "key", "salt").sortWithinPartitions("key", "salt", "rep").mapInArrow(meet, ddl)
    return pairs.unionByName(stored(crossed.select("a", "b"), "crossed"))


FOUND = ["a", "b", "key", "salt", "sig"]


def verified(shingles: np.ndarray, ends: np.ndarray, sig: np.ndarray, threshold: int, old: np.ndarray | None = None) -> np.ndarray:
    """The number of the first member of its part for each set: parts are joined by 100 * common >= threshold * union.

    Every pair that is not joined anyway and that neither sizes nor signatures (TESTED) rule out is tested. old: if
    given, pairs of equal old are not tested again.
    """
    n = len(ends) - 1
    size = np.diff(ends)
    root = np.arange(n)
    code = np.unique(shingles, return_inverse=True)[1]
    mark = np.zeros(int(code.max()) + 1 if len(code) else 0, bool)
    for i in range(1, n):
        est = estimate(sig[:i], sig[i])
        small, large = np.minimum(size[:i], size[i]), np.maximum(size[:i], size[i])
        may = (est >= TESTED) & (100 * small >= threshold * large)
        if old is not None:
            may &= old[:i] != old[i]
        left = np.flatnonzero(may & (root[:i] != root[i]))
        if not len(left):
            continue
        own = code[ends[i] : ends[i + 1]]
        mark[own] = True
        left = left[np.argsort(-est[left], kind="stable")]
        step = 1
        while len(left):
            now, left = left[:step], left[step:]
            inside = mark[code[ragged(ends[now], size[now])]]
            common = np.add.reduceat(inside, np.cumsum(size[now]) - size[now], dtype=np.int64)
            for j in now[100 * common >= threshold * (size[now] + size[i] - common)]:
                a, b = sorted((root[j], root[i]))
                root[root == b] = a
            left = left[root[left] != root[i]]
            step = 256
        mark[own] = False
    return root


def links(docs: DataFrame, members: DataFrame, n: int, threshold: int) -> DataFrame:
    """Rows (a, b) of verified links that join whatever is linked inside each family.

    members: (rep, fp1, sig, root) of classes in families.
    """
    spark = docs.sparkSession
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / FAMILY).cast("int").alias("width"))
    own = F.pmod(F.xxhash64(F.lit(3), F.col("rep")), F.col("width")).cast("int")
    blocked = members.join(sizes, "root").withColumn("side", own)
    other = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("width") - 1))).where("width = 1 OR other <> side")
    placed = stored(other.select("rep", "fp1", "sig", "root", (F.least("side", "other") * F.col("width") + F.greatest("side", "other")).alias("pair"), "side"), "families")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").where("rep IS NOT NULL")
    side = F.broadcast(placed) if placed.count() <= BROADCAST_ROWS else placed
    grouped = texts.join(side, "rep").select("root", "pair", "rep", "fp1", "sig", "side", "text").repartition(deal(spark), "root", "pair").sortWithinPartitions("root", "pair", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs_of((p for b in batches for p in slices(b, "text", 2 << 20)), ["root", "pair"]):
            shingles, ends = shingle_sets(batch.column("text"), n)
            root, pair, rep, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("root", "pair", "rep", "fp1"))
            full = np.flatnonzero(np.diff(ends))
            right = np.zeros(len(fp), bool)
            right[full] = set_digest(shingles, ends[:-1][full])[:, 0] == fp[full]  # rows of the same id with other texts are not meant
            right[1:] &= ~(right[:-1] & (rep[1:] == rep[:-1]) & (root[1:] == root[:-1]) & (pair[1:] == pair[:-1]) & (fp[1:] == fp[:-1]))
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint64).reshape(len(fp), -1)
            cuts = np.concatenate(([0], np.flatnonzero((root[1:] != root[:-1]) | (pair[1:] != pair[:-1])) + 1, [len(root)]))
            a, b = [], []
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                rows = x + np.flatnonzero(right[x:y])
                if len(rows) < 2:
                    continue
                size = np.diff(ends)[rows]
                part = verified(shingles[ragged(ends[rows], size)], np.concatenate(([0], np.cumsum(size))), sig[rows], threshold)
                moved = np.flatnonzero(part != np.arange(len(part)))
                a.append(rep[rows[moved]])
                b.append(rep[rows[part[moved]]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return grouped.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, n: int = 5, threshold: int = 80, hot: int = HOT) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of docs (doc_id, text).

    Two texts are linked if 100 * common shingles >= threshold * all shingles of both, threshold 80 or more;
    component_id is the smallest doc_id that links reach. Null or empty texts have no shingles and are linked with
    nothing. A null doc_id has no component and is kept. Rows that share a doc_id are judged each by its own text;
    texts whose smallest doc_id is the same are one node. Further columns of docs are not read.
    """
    bounded_batches(docs.sparkSession)
    marks = stored(signed(docs.select("doc_id", "text"), n), "signed")
    full = marks.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["fp1", "fp2", "n_shingles"]
    reps = stored(full.groupBy(*same).agg(F.min(F.col("doc_id").cast("long")).alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "classes")
    families = components(candidates(reps, hot=hot))
    roots = families.select(F.col("root").alias("node"), "root").distinct().unionByName(families)
    members = reps.select("rep", "fp1", "sig").join(roots, reps["rep"] == roots["node"]).select("rep", "fp1", "sig", "root")
    # written, so that no task runs the verification's worker and that of the contraction side by side: idle workers keep their memory
    joined = components(stored(links(docs.select("doc_id", "text"), members, n, threshold), "verified"))
    classes = reps.select(*same, "rep").join(joined, reps["rep"] == joined["node"], "left").select(*same, F.coalesce("root", "rep").alias("component"))
    out = marks.select("doc_id", *same).join(classes, same, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", F.col("doc_id").cast("long")))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
