"""Packing of token sequences: shortest-pack-first over the length histogram.

Documents are tokenised once, cut into pieces of `capacity` ids and a rest. The histogram of piece lengths (at most
`capacity` rows, whatever the corpus) is packed on the driver: lengths are placed longest first, each into the pack
pattern that is shortest among those with room, and only the counts of patterns change. Every (pattern, length) then owns an interval
of ranks among the pieces of that length; pieces are ranked in Spark in two steps (within small groups of one length,
then by the groups' sizes), so a length that a third of all pieces share is no task of its own.
"""

from __future__ import annotations

import functools
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .shared import bounded_batches, deal, dropped, stored
from .text import coded, ragged, slices

CAPACITY = 4096
END_ID = 2
#: Parts of words whose ids a worker remembers; beyond that it starts anew. How many are encoded in one string.
REMEMBERED, JOINED = 600_000, 2000
#: Bytes of text that are encoded at a time.
PART = 16 << 20

#: Kinds of bytes: white space, letters, digits, others, and those whose words are left whole: apostrophes (which begin
#: pre-tokens with letters), < (which may begin a special token) and characters beyond Latin-1 letters (which NFC or
#: lower-casing could change).
SPACE, LETTER, DIGIT, OTHER, WHOLE = range(5)


def kinds_of() -> np.ndarray:
    kind = np.full(256, OTHER, np.uint8)
    kind[np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)] = SPACE
    kind[ord("A") : ord("Z") + 1] = kind[ord("a") : ord("z") + 1] = LETTER
    kind[ord("0") : ord("9") + 1] = DIGIT
    kind[[ord("'"), ord("<")]] = WHOLE
    kind[128:] = WHOLE
    return kind


KINDS, SMALL = kinds_of(), np.arange(256, dtype=np.uint8)
SMALL[ord("A") : ord("Z") + 1] += 32
#: First byte of the letters U+00C0 to U+00FF, and the second bytes of the two signs among them.
LATIN, SIGNS = 0xC3, (0x97, 0xB7)


def pieces_of_text(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Parts of all texts that the vocabulary encodes each on its own, in one array, and where each text's begin.

    The vocabulary lower-cases; a run of letters, a digit and a run of other signs are pre-tokens. Words of white space's
    making are cut there unless they hold a byte of kind WHOLE. A-Z are lower-cased in words without <.
    """
    text = pc.fill_null(text, "")
    size = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    # one more white space after each text, so that words end there
    flat = np.frombuffer(b"\n".join([*text.cast(pa.binary()).to_pylist(), b""]), np.uint8)
    if not len(flat):
        return pa.array([], pa.binary()), np.zeros(len(text) + 1, np.int64)
    kind = KINDS[flat]
    lead = np.flatnonzero(flat[:-1] == LATIN)
    lead = lead[(flat[lead + 1] != SIGNS[0]) & (flat[lead + 1] != SIGNS[1])]
    kind[lead] = kind[lead + 1] = LETTER
    begins = np.empty(len(flat), bool)
    begins[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins |= kind == DIGIT
    begins &= kind != SPACE
    at = np.flatnonzero(begins)
    low = SMALL[flat]
    whole = np.flatnonzero(kind == WHOLE)
    if len(whole):
        space = np.flatnonzero(kind == SPACE)
        word = np.unique(np.searchsorted(space, whole))
        first, last = np.where(word > 0, space[word - 1] + 1, 0), space[word]
        inside = np.searchsorted(first, at, side="right") - 1
        at = at[(inside < 0) | (at <= first[inside]) | (at >= last[inside])]
        special = np.unique(np.searchsorted(space, np.flatnonzero(flat == ord("<"))))
        if len(special):
            first, last = np.where(special > 0, space[special - 1] + 1, 0), space[special]
            own = ragged(first, last - first)
            low[own] = flat[own]
    filled = kind != SPACE
    ends = np.concatenate(([0], np.cumsum(size + 1)))
    offsets = np.searchsorted(at, ends)
    before = np.cumsum(filled, dtype=np.int32)  # bytes up to and with each
    starts = np.append(before[at] - 1, before[-1]).astype(np.int32)
    data = low[filled]
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(starts), pa.py_buffer(data)]), offsets


class WordIds:
    """Ids of a tokenizers vocabulary whose pre-tokens never reach over white space: parts of words are encoded once.

    What was encoded lies in flat arrays: the parts, and of each where its ids begin.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.is_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.is_end[i] = token.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        self.known, self.ids, self.ends = pa.array([], pa.binary()), np.empty(0, np.uint32), np.zeros(1, np.int64)

    def learn(self, parts: pa.Array) -> np.ndarray:
        """Encodes parts that are not known yet; their places among the known ones.

        A run of letters is one pre-token, whose last token is its only one with the word-end mark: such parts are
        encoded many at a time, joined by spaces.
        """
        # A-Z stand only in words with <, which are none of these
        letters = pc.match_substring_regex(parts.cast(pa.string()), "^[a-zÀ-ÖØ-öø-ÿ]+$").to_numpy(zero_copy_only=False)
        order = np.argsort(letters, kind="stable")
        parts, signs = parts.take(pa.array(order)), len(parts) - int(letters.sum())
        other, plain = parts.slice(0, signs), parts.slice(signs)
        found = self.tokenizer.encode_batch_fast(other.cast(pa.string()).to_pylist(), add_special_tokens=False)
        ids, ends = [self.ids, *(np.array(e.ids, np.uint32) for e in found)], [self.ends, self.ends[-1] + np.cumsum([len(e) for e in found], dtype=np.int64)]
        if len(plain):
            cuts = np.append(np.arange(0, len(plain), JOINED), len(plain))
            lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), plain.cast(pa.string())), " ").to_pylist()
            own = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
            ids.append(own)
            ends.append((self.ends[-1] + sum(map(len, found))) + np.flatnonzero(self.is_end[own]) + 1)
        places = np.empty(len(parts), np.int64)
        places[order] = len(self.known) + np.arange(len(parts))
        self.known, self.ids, self.ends = pa.concat_arrays([self.known, parts]), np.concatenate(ids), np.concatenate(ends)
        return places

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one flat array, and where each text's begin."""
        parts, offsets = pieces_of_text(text)
        codes, distinct = coded(parts)
        if len(self.known) > REMEMBERED:
            self.forget()
        found = pc.index_in(distinct, value_set=self.known)
        at = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if found.null_count:
            at[at < 0] = self.learn(distinct.filter(found.is_null()))
        at = at[codes]
        begin = self.ends[at]
        size = self.ends[at + 1] - begin
        return self.ids[ragged(begin, size)], np.concatenate(([0], np.cumsum(size)))[offsets]


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> WordIds:
    return WordIds(path)


def pieces_of(docs: DataFrame, path: str, *, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens): each text's ids and end_id, cut at multiples of capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = loaded(path)
        for batch in batches:
            for part in slices(batch, "_text", PART):
                ids, ends = encode(part.column(1))
                total = np.diff(ends) + 1
                # end_id after each document's ids
                flat = np.full(int(total.sum()), end_id, "<u4")
                flat[np.arange(len(ids)) + np.repeat(np.arange(part.num_rows), np.diff(ends))] = ids
                count = -(-total // capacity)
                row = np.repeat(np.arange(part.num_rows), count)
                start = ragged(np.zeros(len(count), np.int64), count) * capacity
                length = np.minimum(total[row] - start, capacity)
                first = (np.cumsum(total) - total)[row] + start
                raw = memoryview(flat).cast("B")
                crc = [zlib.crc32(raw[a:b]) for a, b in zip((4 * first).tolist(), (4 * (first + length)).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(total[row])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").alias("_text")).mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(number of packs, lengths in each pack): lengths longest first, each into the shortest packs with room.

    A pattern's packs all hold the same lengths. Those of one room lie on one heap, roomiest (shortest pack) first. The
    number of patterns follows the number of different lengths, not the number of documents.
    """
    heap: list[tuple[int, int, tuple[int, ...]]] = []  # (-room, packs, lengths)
    full: list[tuple[int, tuple[int, ...]]] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if heap and -heap[0][0] >= length:
                room, packs, own = heapq.heappop(heap)
                used = min(packs, left)
                if used < packs:
                    heapq.heappush(heap, (room, packs - used, own))
                left -= used
                if -room == length:
                    full.append((used, (*own, length)))
                else:
                    heapq.heappush(heap, (room + length, used, (*own, length)))
            else:
                if capacity == length:
                    full.append((left, (length,)))
                else:
                    heapq.heappush(heap, (length - capacity, left, (length,)))
                left = 0
    return full + [(packs, own) for _, packs, own in heap]


def slots(plan: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """Intervals of ranks for each length, sorted by (length, first rank): where they go.

    A pattern with `packs` packs numbered from `base` that holds a length `many` times at offset `offset` takes
    packs * many ranks: rank r of them goes to pack base + r // many, offset + (r % many) * length.
    """
    rows, base, taken = [], 0, {}
    for packs, own in plan:
        offset, i = 0, 0
        while i < len(own):
            j = i
            while j < len(own) and own[j] == own[i]:
                j += 1
            at = taken.get(own[i], 0)
            rows.append((own[i], at, base, offset, j - i))
            taken[own[i]] = at + packs * (j - i)
            offset += (j - i) * own[i]
            i = j
        base += packs
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "base", "offset", "many"), table.T.copy(), strict=True))


def ranked(pieces: DataFrame) -> DataFrame:
    """pieces with `rank` from 0 among those of the same length, gapless; ties are in no particular order."""
    group = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(4 * deal(pieces.sparkSession)))
    grouped = pieces.withColumn("_group", group)
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    sizes = grouped.groupBy("length", "_group").agg(F.count("*").alias("_n"))
    first = sizes.select("length", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = F.row_number().over(Window.partitionBy("length", "_group").orderBy("doc_id", "start", "ids_crc32")) - 1
    return grouped.withColumn("_own", own).join(first, ["length", "_group"]).select(*pieces.columns, (F.col("_first") + F.col("_own")).alias("rank"))


def pack(docs: DataFrame, path: str, *, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one for each piece.

    Null or empty text is the end id alone. Repeated or null doc_ids are packed like any other row. An empty table has
    no pieces. Further columns of docs are not read.
    """
    pieces = stored(pieces_of(docs, path, capacity=capacity, end_id=end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    place = slots(patterns(histogram, capacity))
    width = int(max(histogram.values(), default=0)) + 1
    keys = place["length"] * width + place["first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            at = np.searchsorted(keys, length * width + rank, side="right") - 1
            nth = rank - place["first"][at]
            sequence = place["base"][at] + nth // place["many"][at]
            offset = place["offset"][at] + nth % place["many"][at] * length
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked(pieces).mapInArrow(run, pieces._jdf.schema().toDDL() + ", sequence_id bigint, offset bigint")
