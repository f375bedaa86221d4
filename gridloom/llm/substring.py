"""Substring dedup: Rabin-Karp hashes of every window of `k` words, counted over the corpus.

A word goes if some window of k consecutive words that covers it also begins in a document with a smaller id.

1. Map tasks hash all windows of a block of texts. Of a hash that stands in several documents of the block, only the
   smallest one's entries travel; the others' windows go anyway and are answered at once. The sorted entries go to the
   shuffle partition that the hash's high bits name: one packed blob for each (block, partition), about seven bytes a
   window.
2. Each shuffle partition sorts its hashes, takes the smallest document of each, and answers with the windows that
   begin in a larger one: one row for each document, of packed word positions.
3. Answers meet the texts by a key of the document's id and text; runs of windows merge into maximal intervals, which
   are cut out.
A passage that a third of all documents share is one document's entries for each block of 3 MB of text. Hashes have
64 bits: two different windows share one with a chance of 5e-20.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from .shared import bounded_batches, deal, own_names, stored
from .text import coded, covered, from_planes, hashed, planes, ragged, slices, windows, words_of

WINDOW = 13
#: Bytes of text of the blocks whose windows are packed together.
BLOCK = 3 << 20


def row_keys(ids: pa.Array, bodies: list[bytes]) -> np.ndarray:
    """A 64-bit key of (id, text): rows that share both also share their answers."""
    names = ids.cast(pa.string()).to_pylist()
    return np.fromiter((xxhash.xxh3_64_intdigest(b, seed=xxhash.xxh3_64_intdigest(n or "\0")) for n, b in zip(names, bodies, strict=True)), np.uint64, len(bodies)).view(np.int64)


#: block: digest of the keys of a block's rows. Blobs have hashes (sorted, as deltas), at (each entry's first word in the
#: block), and ids and starts of the documents that have entries; a block's one table has part -1, ids, starts and
#: keys, and the places answered at once as at.
BLOB = pa.schema([("part", pa.int32()), ("deal", pa.int32()), ("block", pa.int64()), *((n, pa.binary()) for n in ("hashes", "at", "ids", "starts", "keys"))])
BLOB_DDL = "part int, deal int, block bigint, hashes binary, at binary, ids binary, starts binary, keys binary"


def thinned(window: np.ndarray, first: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted windows and their places without those that a smaller document of the block holds too, and the latter's places."""
    new = np.concatenate(([True], window[1:] != window[:-1]))
    some = np.flatnonzero(~(new & np.concatenate((new[1:], [True]))))
    if not len(some):
        return window, first, first[:0]
    own = ids[np.searchsorted(offsets, first[some], side="right") - 1]
    group = np.flatnonzero(new[some])
    later = some[own > np.repeat(np.minimum.reduceat(own, group), np.diff(np.append(group, len(some))))]
    keep = np.ones(len(window), bool)
    keep[later] = False
    return window[keep], first[keep], first[later]


def window_blobs(docs: DataFrame, k: int, parts: int) -> DataFrame:
    """Blobs of all windows of each block of texts, one for each partition, and the block's table.

    Rows without id are left out. Ids go as differences: those of neighbours in a file are mostly small.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        flat = lambda x: pack(planes(np.diff(x, prepend=x.dtype.type(0))))
        for batch in batches:
            for block in slices(batch, "_text", BLOCK):
                block = block.filter(pc.is_valid(block.column(0)))
                words, offsets = words_of(block.column(1))
                codes, distinct = coded(words)
                window, first, _ = windows(hashed(distinct)[codes], offsets, k)
                del words, codes, distinct
                if not len(window):
                    continue
                keys = row_keys(block.column(0), pc.fill_null(block.column(1), "").cast(pa.binary()).to_pylist())
                name = int(np.uint64(xxhash.xxh3_64_intdigest(keys.tobytes())).view(np.int64))
                ids = block.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                order = np.argsort(window)
                window, first = window[order], first[order].astype(np.uint32)
                window, first, gone = thinned(window, first, ids, offsets)
                part = ((window >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # in the order of the hashes
                cuts = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]))
                rows = [(-1, name % parts, name, None, np.sort(gone).tobytes() or None, flat(ids), flat(offsets[:-1]), pack(planes(keys)))]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    present = np.unique(np.searchsorted(offsets, first[a:b], side="right") - 1)
                    rows.append((int(part[a]), int(part[a]), name, flat(window[a:b]), pack(planes(first[a:b])), flat(ids[present]), flat(offsets[present]), None))
                yield pa.RecordBatch.from_pylist([dict(zip(BLOB.names, r, strict=True)) for r in rows], BLOB)

    return docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text")).mapInArrow(run, BLOB_DDL)


def summed(raw: bytes, kind: str, unpack) -> np.ndarray:
    return np.cumsum(from_planes(unpack(raw), kind), dtype=kind)


ANSWER = pa.schema([("block", pa.int64()), *((n, pa.binary()) for n in ("at", "ids", "starts", "keys"))])


def repeated(blobs: DataFrame) -> DataFrame:
    """Rows (block, at, ids, starts, keys): packed places of the windows that also begin in a smaller document.

    All entries of a hash are in one partition, which holds its entries together: a quarter of all windows over the
    number of shuffle partitions. Tables of blocks pass through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        hashes, ats, ids, names = [], [], [], []
        for batch in batches:
            is_table = pc.is_null(batch.column("hashes"))
            if tables := batch.filter(is_table).to_pylist():
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in ANSWER.names} for r in tables], ANSWER)
            for r in batch.filter(pc.invert(is_table)).to_pylist():
                hashes.append(summed(r["hashes"], "<u8", unpack))
                ats.append(from_planes(unpack(r["at"]), "<u4"))
                starts = summed(r["starts"], "<i8", unpack)
                ids.append(summed(r["ids"], "<i8", unpack)[np.searchsorted(starts, ats[-1], side="right") - 1])
                names.append(r["block"])
        if not hashes:
            return
        owner = np.repeat(np.arange(len(names), dtype=np.uint32), [len(x) for x in hashes])
        hash_, id_, at = np.concatenate(hashes), np.concatenate(ids), np.concatenate(ats)
        del hashes, ids, ats
        order = np.argsort(hash_)
        hash_ = hash_[order]
        new = np.concatenate(([True], hash_[1:] != hash_[:-1]))
        alone = new & np.concatenate((new[1:], [True]))  # most are: they go here
        order, new = order[~alone], new[~alone]
        del hash_
        if not len(order):
            return
        id_, group = id_[order], np.flatnonzero(new)
        hit = order[id_ > np.repeat(np.minimum.reduceat(id_, group), np.diff(np.append(group, len(id_))))]
        owner, at = owner[hit], at[hit]
        order = np.lexsort((at, owner))
        owner, at = owner[order], at[order]
        for run_of in np.split(np.arange(len(owner)), np.flatnonzero(owner[1:] != owner[:-1]) + 1):
            if len(run_of):
                yield pa.RecordBatch.from_pylist([{"block": names[owner[run_of[0]]], "at": at[run_of].tobytes()}], ANSWER)

    return blobs.mapInArrow(run, "block bigint, at binary, ids binary, starts binary, keys binary")


def by_document(answers: DataFrame) -> DataFrame:
    """Rows (key, _id, first): packed first words of each document's windows that go, from answers and tables of blocks."""
    blocks = answers.groupBy("block").agg(F.collect_list("at").alias("at"), *(F.first(c, ignorenulls=True).alias(c) for c in ("ids", "starts", "keys")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for r in batch.to_pylist():
                if not r["at"]:
                    continue
                at = np.unique(np.frombuffer(b"".join(r["at"]), "<u4")).astype(np.int64)
                ids, starts, keys = summed(r["ids"], "<i8", unpack), summed(r["starts"], "<i8", unpack), from_planes(unpack(r["keys"]), "<i8")
                doc = np.searchsorted(starts, at, side="right") - 1
                at -= starts[doc]
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]))
                own = doc[cuts[:-1]]
                yield pa.RecordBatch.from_arrays([pa.array(keys[own]), pa.array(ids[own]), pa.array([packed(at[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["key", "_id", "first"])

    return blocks.mapInArrow(run, "key bigint, _id bigint, first binary")


def packed(first: np.ndarray) -> bytes:
    """Sorted positions in as few bytes as the largest asks for; the first byte tells how many."""
    kind = np.uint16 if first[-1] < 1 << 16 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + first.astype(kind).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def intervals(first: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Maximal runs [begin, end) of words that windows of k words from `first` cover."""
    if not len(first):
        return []
    first = np.unique(first)
    breaks = np.flatnonzero(np.diff(first) > k)
    return list(zip(first[np.concatenate(([0], breaks + 1))].tolist(), (first[np.concatenate((breaks, [len(first) - 1]))] + k).tolist(), strict=True))


def dedup(docs: DataFrame, *, k: int = WINDOW, keep: tuple[str, ...] = (), verbatim: bool = False) -> DataFrame:
    """Rows (doc_id, *keep, n_words, n_removed, removed, text), one for each row of docs.

    removed: maximal intervals of words (begin, end), judged on the input; text: the words left, joined by one space;
    if verbatim, texts that lose nothing stay as they are.
    Null text has no words and gives an empty text (null if verbatim). Texts of fewer than k words lose nothing; very long
    ones are judged whole. An empty table gives no rows. Columns not in keep are not read; a kept column that has the name
    of an output comes back with a leading _. A null doc_id is smaller
    than none and larger than none: such rows lose nothing and take nothing. Rows that share a doc_id take nothing from
    each other.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = 4 * deal(spark)
    found = stored(repeated(window_blobs(docs, k, parts).repartitionById(parts, F.col("deal"))), "repeats")
    kept = [f"_k{i}" for i in range(len(keep))]
    names = own_names(keep, ["doc_id", "n_words", "n_removed", "removed", "text"])

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part in slices(batch, "_text"):
                raw = pc.fill_null(part.column("_text"), "").cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(row_keys(part.column("_id"), raw)), part.column("_id"), *(part.column(c) for c in kept), part.column("_text").is_null(), pa.array([pack(x) for x in raw], pa.binary())], ["key", "_id", *kept, "_none", "body"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            size = pc.binary_length(batch.column("body")).to_numpy(zero_copy_only=False)
            group = (np.cumsum(size) - size) // (1 << 20)
            ends = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows])) if batch.num_rows else [0]
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                part = batch.slice(a, b - a)
                count, gone, runs, texts = [], [], [], []
                for body, none, first in zip(part.column("body"), part.column("_none").to_pylist(), part.column("first").to_pylist(), strict=True):
                    raw = unpack(body.as_buffer())
                    words = raw.split()
                    found = intervals(unpacked(first), k) if first else []
                    count.append(len(words))
                    gone.append(sum(y - x for x, y in found))
                    runs.append([{"begin": x, "end": y} for x, y in found])
                    at, left = 0, []
                    for x, y in found:
                        left += words[at:x]
                        at = y
                    texts.append((None if none else raw.decode()) if verbatim and not found else b" ".join(left + words[at:]).decode())
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), *(part.column(c) for c in kept), pa.array(count, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), pa.array(texts, pa.string())],
                    ["doc_id", *names, "n_words", "n_removed", "removed", "text"],
                )

    own = "".join(f", {k} {docs.schema[c].dataType.simpleString()}" for k, c in zip(kept, keep, strict=True))
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), *(F.col(c).alias(k) for c, k in zip(keep, kept, strict=True))).mapInArrow(bodies, f"key bigint, _id {id_kind}{own}, _none boolean, body binary")
    answers = by_document(found).groupBy("key", "_id").agg(F.first("first").alias("first"))
    named = "".join(f", `{n}` {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True))
    return texts.join(answers, ["key", "_id"], "left").mapInArrow(cut, f"doc_id {id_kind}{named}, n_words bigint, n_removed bigint, removed array<struct<begin:int,end:int>>, text string")
