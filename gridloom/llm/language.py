"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

P(token | history) = P(class | history) * P(sub | class, history) * P(part | class, sub, history) * P(token | part). Classes
are bands of training frequency; the end of text is one of its own, and so are the tokens seen once, with the unknown
token. Subs are hashes of a word's last two bytes, parts are hashes of the word: 4096 parts in all, so that most frequent
words have one of their own. Each softmax adds the weights of three hashed features of the history to the log share of
the class, sub or part: the word before, the two words before, and the word before that one (skip). Rare words of a
history count by their sub. Inside a part a token has its share of the counts. Of the last class's mass the unknown token
gets what Good and Turing's estimate gives it, so that all tokens and the unknown one sum to 1 after every history.

1. Texts become chunks of codes into their distinct tokens, written once. Packed blobs of token hashes and counts, one for
   each chunk and shuffle partition, are summed there and answered: a token that fills a third of all texts is one entry
   a chunk. Tokens are told apart by 60 bits of a hash.
2. Each round sums, over all training tokens, how often each class (sub, part) followed each feature, and how often the
   model expects it: O and E. The sums are integers (probabilities in units of 1 / UNIT), so they are the same for any
   layout of the input, order of tasks or lost executor. Tasks send packed sums for ranges of rows, merged in Spark.
   The step along the gradient O - E is scaled as in iterative scaling: STEP * log((O + DAMP q) / (E + DAMP q)), q the
   expected share, mixed with even ones. The first round's E of classes and subs follows from counts, as weights are 0.
3. All documents are scored in batches of sparse rows.

The weights' rows grow with the vocabulary, up to MOST_ROWS: workers hold them all, at most 96 MB.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from .shared import bounded_batches, deal, dropped, stored
from .text import coded, from_planes, hashed, mixed, planes, ragged, slices, words_of

#: The token that ends a text: no word has white space.
END = "\n"
CLASSES, SUBS, PARTS, RARE = 16, 16, 16, 15
WIDTHS = (CLASSES, SUBS, PARTS)
LEAVES = CLASSES * SUBS * PARTS
#: Rows of weights for each softmax: a power of two near the vocabulary over WORDS_PER_ROW.
LEAST_ROWS, MOST_ROWS, WORDS_PER_ROW = 1 << 12, 1 << 19, 32
ROUNDS, STEP, DAMP, UNIT = 2, 0.5, 60.0, 4096
#: Positions whose chances are computed at a time (they fit a cache) and whose expectations are summed at a time; ranges
#: of rows that are merged together; training tokens for each task.
BATCH, GROUP, SHARDS, TASK = 1 << 13, 1 << 18, 64, 5_000_000
CHUNK = 4 << 20
GOLD = 0x9E3779B97F4A7C15


def is_held(doc_id: int | None) -> bool:
    """Null ids are never learned from."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 == 2


def token_keys(distinct: pa.Array) -> np.ndarray:
    """A hash of each token whose low bits are its sub."""
    raw = distinct.cast(pa.binary())
    n = pc.binary_length(raw).to_numpy(zero_copy_only=False)
    last = pc.binary_slice(raw, -2).to_pylist()
    ends = np.frombuffer(b"".join(x.rjust(2, b" ") for x in last), "<u2").astype(np.uint64) if len(n) else np.empty(0, np.uint64)
    sub = mixed(ends + np.uint64(1)) & np.uint64(SUBS - 1)
    return (hashed(distinct) & ~np.uint64(SUBS - 1)) | sub


END_KEY = int(token_keys(pa.array([END]))[0])

CHUNKS = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("train", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("codes", "keys", "counts"))])
CHUNKS_DDL = "chunk bigint, part int, train bigint, ids array<bigint>, held array<boolean>, sizes array<bigint>, codes binary, keys binary, counts binary"


def packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(planes(x))


def unpacked(raw: bytes, kind: str) -> np.ndarray:
    return from_planes(zstandard.decompress(raw), kind)


def delta(sorted_keys: np.ndarray) -> bytes:
    return packed(np.diff(sorted_keys, prepend=np.uint64(0)))


def undelta(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw, "<u8"), dtype=np.uint64)


def chunks(docs: DataFrame, parts: int) -> DataFrame:
    """Of each chunk of texts a row (part -1) of codes into its sorted keys, and for each part a blob of keys with counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                words, offsets = words_of(pc.ascii_lower(part.column("text")))
                code, distinct = coded(words)
                n = np.diff(offsets)
                codes = np.full(len(code) + len(n), len(distinct), np.int64)
                codes[np.arange(len(code)) + np.repeat(np.arange(len(n)), n)] = code
                ids = part.column("doc_id").to_pylist()
                held = np.array([is_held(i) for i in ids])
                keys = np.append(token_keys(distinct), np.uint64(END_KEY))
                keys, place = np.unique(keys, return_inverse=True)
                codes = place[codes]
                train = np.bincount(codes[np.repeat(~held, n + 1)], minlength=len(keys))
                rows = [{"chunk": number, "part": -1, "train": int(train.sum()), "ids": ids, "held": held.tolist(), "sizes": (n + 1).tolist(), "codes": packed(codes.astype("<u4"))}]
                of = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                cuts = np.concatenate(([0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]))
                rows += [{"chunk": number, "part": int(of[a]), "keys": delta(keys[a:b]), "counts": packed(train[a:b].astype("<u4"))} for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_pylist(rows, CHUNKS)
                number += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, CHUNKS_DDL)


def class_of(count: np.ndarray, total: int) -> np.ndarray:
    """1 + the band of a token's frequency; RARE for tokens seen once or never. The end has class 0."""
    top = RARE - 1
    band = np.floor((1 - np.log2(np.maximum(count, 1.0)) / max(np.log2(total + 2.0), 1.0)) * top)
    return np.where(count > 1, 1 + np.clip(band, 0, top - 1), RARE).astype(np.int64)


def class_of_keys(keys: np.ndarray, count: np.ndarray, total: int) -> np.ndarray:
    return np.where(keys == np.uint64(END_KEY), 0, class_of(count, total))


ANSWER = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("cells", pa.list_(pa.int64())), ("mass", pa.list_(pa.int64()))])
ANSWER_DDL = "chunk bigint, part int, keys binary, counts binary, cells array<bigint>, mass array<bigint>"
#: Cells beside the LEAVES masses: the vocabulary, tokens seen once, tokens seen twice.
VOCABULARY, ONCE, TWICE = (LEAVES + i for i in range(3))


def short_of(keys: np.ndarray) -> np.ndarray:
    """32 bits of each key; the lowest ones are its sub, the next its part."""
    low = np.uint64(SUBS - 1)
    return ((keys >> np.uint64(32)) & ~low) | (keys & low)


def part_of(short: np.ndarray) -> np.ndarray:
    return (short // SUBS & (PARTS - 1)).astype(np.uint8)


def answered(blobs: DataFrame, total: int) -> DataFrame:
    """Blobs with the counts of all training texts; and of each partition the masses of classes and subs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        if not rows:
            return
        keys = [undelta(r["keys"]) for r in rows]
        flat, place = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(place, np.concatenate([unpacked(r["counts"], "<u4") for r in rows])).astype(np.int64)
        at = np.cumsum([len(k) for k in keys])
        for r, own in zip(rows, np.split(count[place], at[:-1]), strict=True):
            yield pa.RecordBatch.from_pylist([{"chunk": r["chunk"], "part": r["part"], "keys": r["keys"], "counts": packed(own)}], ANSWER)
        cell = (class_of_keys(flat, count, total) * SUBS + (flat & np.uint64(SUBS - 1)).astype(np.int64)) * PARTS + part_of(short_of(flat))
        mass = np.bincount(cell, count, minlength=TWICE + 1).astype(np.int64)
        mass[[VOCABULARY, ONCE, TWICE]] = (count > 0).sum(), (count == 1).sum(), (count == 2).sum()
        some = np.flatnonzero(mass)
        yield pa.RecordBatch.from_pylist([{"chunk": -1, "cells": some.tolist(), "mass": mass[some].tolist()}], ANSWER)

    return blobs.mapInArrow(run, ANSWER_DDL)


KNOWN = pa.schema([("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("codes", "keys", "counts"))])
KNOWN_DDL = "ids array<bigint>, held array<boolean>, sizes array<bigint>, codes binary, keys binary, counts binary"


def known_chunks(docs: DataFrame) -> tuple[DataFrame, Counts]:
    """(one row for each chunk with the counts of its keys, what the vocabulary sums to)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = 4 * deal(spark)
    made = stored(chunks(docs, parts), "chunks")
    total = int(made.where("part < 0").agg(F.sum("train")).first()[0] or 0)
    blobs = made.where("part >= 0").select("chunk", "part", "keys", "counts").repartitionById(parts, F.col("part"))
    answers = stored(answered(blobs, total), "counts")
    cells = answers.where("chunk < 0").select(F.explode(F.arrays_zip("cells", "mass")).alias("c")).groupBy(F.col("c.cells").alias("cell")).agg(F.sum("c.mass").alias("mass")).collect()  # TWICE + 1 rows
    mass = np.zeros(TWICE + 1, np.int64)
    for r in cells:
        mass[r["cell"]] = r["mass"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                own = sorted(r["own"], key=lambda b: b["part"])
                keys = np.concatenate([undelta(b["keys"]) for b in own])
                short = short_of(keys)
                counts = np.concatenate([unpacked(b["counts"], "<i8") for b in own])
                end = keys == np.uint64(END_KEY)
                counts[end] = -1 - counts[end]  # marks the end, which has a class of its own
                yield pa.RecordBatch.from_pylist([{n: r[n] for n in ("ids", "held", "sizes", "codes")} | {"keys": short.astype("<u4").tobytes(), "counts": packed(counts)}], KNOWN)

    own = answers.where("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("part", "keys", "counts")).alias("own"))
    known = stored(made.where("part < 0").select("chunk", "ids", "held", "sizes", "codes").join(own, "chunk").drop("chunk").mapInArrow(run, KNOWN_DDL), "known")
    dropped(made)
    dropped(answers)
    return known, Counts(total, mass)


class Counts:
    """What the vocabulary sums to: total (training tokens), vocabulary (distinct ones), log shares and the rare class's parts."""

    def __init__(self, total: int, cells: np.ndarray):
        self.total, self.vocabulary = total, int(cells[VOCABULARY])
        once, twice = int(cells[ONCE]), int(cells[TWICE])
        parts = cells[:LEAVES].reshape(CLASSES, SUBS, PARTS).astype(np.float64)
        leaf = parts.sum(2)
        leaf[0, END_KEY % SUBS] = max(leaf[0].sum(), 1)
        mass = leaf.sum(1)
        mass[RARE] = max(mass[RARE], 1)
        self.parts = parts
        # empty classes and subs have no token: their share is so small that it is lost in any sum
        share = lambda x: np.log(np.maximum(x, 1e-26)).astype(np.float32)
        inner = parts.reshape(-1, PARTS)
        self.prior = (share(mass / mass.sum())[None, :], share(leaf / np.maximum(leaf.sum(1, keepdims=True), 1)), share(inner / np.maximum(inner.sum(1, keepdims=True), 1)))
        self.unknown = (once + 1) / (once + 2 * twice + 2) if once else 1.0
        self.single = (1 - self.unknown) / max(once, 1)

    def rows(self) -> int:
        return int(min(MOST_ROWS, max(LEAST_ROWS, 1 << max(0, self.vocabulary // WORDS_PER_ROW).bit_length())))

    def inside(self, kind: np.ndarray, sub: np.ndarray, part: np.ndarray, count: np.ndarray) -> np.ndarray:
        """log10 P(token | class, sub, part)."""
        p = np.where(kind == RARE, np.where(count > 0, self.single, self.unknown), count / np.maximum(self.parts[kind, sub, part], 1))
        return np.log10(np.where(kind == 0, 1.0, p))


class Chunk:
    """Positions of one chunk: class, sub, part and count of each token, and hashes of the features of its history."""

    def __init__(self, batch: pa.RecordBatch, i: int, total: int, *, train_only: bool = False):
        row = {name: batch.column(name)[i] for name in KNOWN.names}
        plain = lambda x: x.values.to_numpy(zero_copy_only=False)
        self.ids, self.held, self.sizes = row["ids"].values, plain(row["held"]), plain(row["sizes"])
        code = unpacked(row["codes"].as_buffer(), "<u4")
        keys = np.frombuffer(row["keys"].as_buffer(), "<u4")
        counts = unpacked(row["counts"].as_buffer(), "<i8")
        end = counts < 0
        counts = np.where(end, -1 - counts, counts)
        kind = np.where(end, 0, class_of(counts, total)).astype(np.uint8)
        sub = (keys & np.uint32(SUBS - 1)).astype(np.uint8)
        history = np.where(kind == RARE, sub.astype(np.uint64), keys.astype(np.uint64) + np.uint64(1 << 33))
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        place = ragged(np.zeros(len(self.sizes), np.int64), self.sizes)
        h = history[code]
        near, far = (np.where(place >= k, np.concatenate((np.zeros(min(k, len(h)), np.uint64), h[: max(0, len(h) - k)])), np.uint64(1 << 40)) for k in (1, 2))
        if train_only:
            keep = ~self.held[self.doc]
            code, near, far = code[keep], near[keep], far[keep]
        self.kind, self.sub, self.part, self.count = kind[code], sub[code], part_of(keys)[code], counts[code]
        self.features = [mixed(near + np.uint64(GOLD)), mixed(near * np.uint64(GOLD) + far), mixed(far ^ np.uint64(0x51ED270B1F))]

    def target(self, level: int) -> np.ndarray:
        return (self.kind, self.sub, self.part)[level]

    def places(self, level: int) -> np.ndarray:
        """Positions that the softmax of this level tells: subs and parts are of the classes between the end and the rare one."""
        return np.flatnonzero((self.kind > 0) & (self.kind < RARE)) if level else np.arange(len(self.kind))

    def nodes(self, level: int, some: slice | np.ndarray) -> np.ndarray:
        """What is known of a position before this level: nothing, its class, its class and sub."""
        if level == 2:
            return self.kind[some].astype(np.uint16) * SUBS + self.sub[some]
        return self.kind[some] if level else np.zeros(len(self.kind[some]), np.uint8)

    def rows(self, level: int, some: slice | np.ndarray, mask: int) -> list[np.ndarray]:
        """Rows of the weights of each feature; those of subs and parts depend on the node as well."""
        out = [f[some] for f in self.features]
        if level:
            node = self.nodes(level, some).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            out = [mixed(f ^ node) for f in out]
        return [(f & np.uint64(mask)).astype(np.int64) for f in out]


def chances(w: np.ndarray | None, prior: np.ndarray, node: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Probabilities for each position: of classes (prior of one row, node 0), or of the subs or parts of node."""
    z = prior.take(node, axis=0)
    for r in rows if w is not None else ():
        z += w.take(r, axis=0)
    np.exp(z, out=z)
    part = z
    while part.shape[1] > 1:  # sums in one order wherever a position stands
        half = part.shape[1] // 2
        part = part[:, :half] + part[:, half:]
    z /= part
    return z


SUMS = pa.schema([("shard", pa.int32()), ("level", pa.int32()), ("what", pa.string()), ("data", pa.binary())])
SUMS_DDL = "shard int, level int, what string, data binary"


def sums(known: DataFrame, counts: Counts, weights, size: int) -> DataFrame:
    """Packed sums over the training tokens of each task, by ranges of rows.

    Without weights: `o` (how often each class, sub or part followed), for subs `n` (how often a row was met in each
    class), from which the expectation follows, and for parts `e`. With weights: `e`, the expectation, alone.
    """
    total, prior = counts.total, counts.prior
    mask, per = size - 1, size // SHARDS

    def rows_of(level: int, what: str, table: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"shard": s, "level": level, "what": what, "data": packed(table[s * per : (s + 1) * per].ravel())} for s in range(SHARDS)], SUMS)

    def expected(c: Chunk, level: int, w: np.ndarray | None, acc: np.ndarray) -> None:
        places = c.places(level)
        for a in range(0, len(places), GROUP):
            some = places[a : a + GROUP]
            rows, node = c.rows(level, some, mask), c.nodes(level, some)
            p = np.empty((WIDTHS[level], len(some)))
            for b in range(0, len(some), BATCH):
                cut = slice(b, b + BATCH)
                own = chances(w, prior[level], node[cut], [r[cut] for r in rows])
                own *= np.float32(UNIT)
                p[:, cut] = np.rint(own, out=own).T
            for k in range(WIDTHS[level]):
                for r in rows:
                    acc[k] += np.bincount(r, p[k], minlength=size)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(size * w, np.int64) for w in WIDTHS]
        met, inner = np.zeros(size * CLASSES, np.int64), np.zeros((PARTS, size))
        for batch in batches:
            for i in range(batch.num_rows):
                c = Chunk(batch, i, total, train_only=True)
                for level, width in enumerate(WIDTHS):
                    some = c.places(level)
                    rows = c.rows(level, some, mask)
                    for table, own, target in ((seen[level], width, c.target(level)), *([(met, CLASSES, c.kind)] if level == 1 else [])):
                        for r in rows:
                            table += np.bincount(r * own + target[some], minlength=len(table))
                expected(c, 2, None, inner)
        for level, table in enumerate(seen):
            yield rows_of(level, "o", table.reshape(size, -1))
        yield rows_of(1, "n", met.reshape(size, -1))
        yield rows_of(2, "e", inner.T.astype(np.int64))

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = [np.zeros((width, size)) for width in WIDTHS]
        for batch in batches:
            for i in range(batch.num_rows):
                c = Chunk(batch, i, total, train_only=True)
                for level, table in enumerate(acc):
                    expected(c, level, weights.value[level], table)
        for level, table in enumerate(acc):
            yield rows_of(level, "e", table.T.astype(np.int64))

    return known.coalesce(max(1, round(total / TASK))).mapInArrow(first if weights is None else later, SUMS_DDL)


def merged(parts: DataFrame, prior: tuple[np.ndarray, ...]) -> DataFrame:
    """The sums of all tasks and the step `d` of each range of rows. One array for each is held, whatever the number of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[tuple[int, int, str], np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                x = unpacked(r["data"], "<i8")
                key = (r["shard"], r["level"], r["what"])
                acc[key] = acc[key] + x if key in acc else x
        share = [np.exp(p.astype(np.float64)) for p in prior[:2]]
        for shard, level in sorted({k[:2] for k in acc}):
            seen = acc[shard, level, "o"].reshape(-1, WIDTHS[level])
            if (shard, level, "e") in acc:
                expected = acc[shard, level, "e"].reshape(seen.shape) / UNIT
            elif level:
                expected = acc[shard, level, "n"].reshape(-1, CLASSES) @ share[1]
            else:
                expected = seen.sum(1, keepdims=True) * share[0]
            # smoothed by the expected shares and a little by even ones
            q = 0.9 * expected / np.maximum(seen.sum(1, keepdims=True), 1) + 0.1 / WIDTHS[level]
            step = STEP * np.log((seen + DAMP * q) / (expected + DAMP * q))
            yield pa.RecordBatch.from_pylist([{"shard": shard, "level": level, "what": "o", "data": packed(seen.ravel())}, {"shard": shard, "level": level, "what": "d", "data": step.astype("<f4").tobytes()}], SUMS)

    return parts.repartition(min(SHARDS, deal(parts.sparkSession)), "shard").mapInArrow(run, SUMS_DDL)


def trained(known: DataFrame, counts: Counts, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The weights, rows x CLASSES, rows x SUBS and rows x PARTS."""
    spark, size = known.sparkSession, counts.rows()
    w = [np.zeros((size, width), np.float32) for width in WIDTHS]
    before = shared = None
    for _ in range(rounds if counts.total else 0):
        parts = sums(known, counts, shared, size)
        if before is not None:
            parts = parts.unionByName(before.where("what = 'o'"))
        after = stored(merged(parts, counts.prior), "model")
        for r in after.where("what = 'd'").toLocalIterator():  # 3 * SHARDS rows, one model
            step = np.frombuffer(r["data"], "<f4").reshape(-1, WIDTHS[r["level"]])
            w[r["level"]][r["shard"] * len(step) : (r["shard"] + 1) * len(step)] += step
        if before is not None:
            dropped(before)
        if shared is not None:
            shared.destroy()
        before, shared = after, spark.sparkContext.broadcast(w)
    if before is not None:
        dropped(before)
        shared.destroy()
    return w


def score(docs: DataFrame, *, rounds: int = ROUNDS) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row of docs (doc_id, text).

    Null or empty text is the end token alone. A null doc_id is held out. Repeated rows are learned and scored each. Very
    long texts are scored whole. Without training tokens base scores are 0 and all tokens but the end are the unknown one.
    An empty table gives no rows. Further columns are not read.
    """
    known, counts = known_chunks(docs)
    total, vocabulary, mask = counts.total, counts.vocabulary, counts.rows() - 1
    weights = docs.sparkSession.sparkContext.broadcast(trained(known, counts, rounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = Chunk(batch, i, total)
                n = len(c.sizes)
                p = np.empty(len(c.kind))
                for a in range(0, len(p), BATCH):
                    cut = np.arange(a, min(a + BATCH, len(p)))
                    inner = cut[(c.kind[cut] > 0) & (c.kind[cut] < RARE)]
                    for level, w in enumerate(weights.value):
                        some = inner if level else cut
                        own = chances(w, counts.prior[level], c.nodes(level, some), c.rows(level, some, mask))
                        told = np.log10(np.maximum(own[np.arange(len(some)), c.target(level)[some]], 1e-30))
                        p[some] = p[some] + told if level else told
                p += counts.inside(c.kind, c.sub, c.part, c.count)
                base = np.log10((c.count + 1) / (total + vocabulary + 1))
                by_doc = lambda v: np.bincount(c.doc, v, minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [c.ids, pa.array(c.held), pa.array(c.sizes), pa.array(by_doc(c.count > 0).astype(np.int64)), pa.array([total] * n, pa.int64()), pa.array(by_doc(base)), pa.array(by_doc(p))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return known.mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
