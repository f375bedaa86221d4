"""Alignment of two tokenizers by the byte ends of their tokens.

Both tokenizations of a text cover the same bytes. In mapInPandas two pointers, one for each side, go through the
cumulative token ends in one merge: at each end of either side the two current tokens overlap, which is a link, and
the pointers whose token ends there move on; where both move, a group ends. The merge is one pass over a chunk of
texts in numpy: the pointers are running counts of the ends passed.

Spark then counts the documents that hold each linked pair of ids, takes the largest count of each id on either side,
and joins both back. A worker sends each pair once for its chunk, with the chunk's number of documents, and keeps what
its documents hold as positions in that list: rows between the steps follow the distinct pairs of chunks and not the
tokens of documents, and no key is more than one row for each chunk.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .bpe import loaded
from .shared import bounded_batches, stored
from .text import from_planes, planes, ragged

#: Bytes of text that are merged at once, or one text where that is longer.
CHUNK = 2 << 20
#: Pre-tokens that a worker remembers; beyond that it starts anew.
REMEMBERED = 400_000
A_END, B_END = 1, 2


class ByteLevel:
    """A byte-level vocabulary of the tokenizers library; special tokens inside texts are plain text."""

    def __init__(self, path: str):
        self.bpe = loaded(path)
        self.bytes = self.bpe.token_bytes
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.first, self.count = (np.empty(0, np.int64) for _ in range(3))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one flat array, and the number of each text's."""
        if len(self.number) > REMEMBERED:
            self.forget()
        words = [self.bpe.pattern.findall(t) for t in texts]
        if new := list(set().union(*words).difference(self.number)):
            ids, count = self.bpe.merge([w.encode() for w in new])
            self.number.update(zip(new, range(len(self.count), len(self.count) + len(new))))
            self.first = np.concatenate((self.first, len(self.ids) + np.cumsum(count) - count))
            self.count, self.ids = np.concatenate((self.count, count)), np.concatenate((self.ids, ids))
        size = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter(map(self.number.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(size.sum()))
        ends = np.concatenate(([0], np.cumsum(self.count[at])))[np.concatenate(([0], np.cumsum(size)))]
        return self.ids[ragged(self.first[at], self.count[at])], np.diff(ends)


class Pieces:
    """A vocabulary of the sentencepiece library, which puts a space before each text; U+2581 stands for a space, <0xHH> for a byte."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        piece = self.model.id_to_piece
        self.bytes = [bytes([int(piece(i)[1:-1], 16)]) if self.model.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.model.get_piece_size())]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(self.model.encode(t), np.int64) for t in texts]
        return np.concatenate([np.empty(0, np.int64), *ids]), np.fromiter(map(len, ids), np.int64, len(ids))


@functools.lru_cache(maxsize=2)
def sides(a_path: str, b_path: str) -> tuple:
    """Both tokenizers, the byte length of each token, and a table of its id's decimals with room for one more byte."""
    out = []
    for t in (ByteLevel(a_path), Pieces(b_path)):
        digits = np.array([str(i).ljust(7) for i in range(len(t.bytes))], "S7").view(np.uint8).reshape(-1, 7)
        out.append((t, np.fromiter(map(len, t.bytes), np.int64, len(t.bytes)), digits, np.fromiter((len(str(i)) for i in range(len(t.bytes))), np.int64, len(t.bytes))))
    return tuple(out)


def covering(ids: np.ndarray, count: np.ndarray, token_bytes: list[bytes], want: list[bytes]) -> np.ndarray:
    """For which texts do the joined bytes of the tokens equal the wanted ones?"""
    flat, ends = ids.tolist(), np.cumsum(count).tolist()
    return np.fromiter((b"".join(map(token_bytes.__getitem__, flat[a:b])) == w for a, b, w in zip([0, *ends], ends, want)), bool, len(want))


def merged(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two-pointer merge: for each end of either side the token of A and that of B that hold the byte before it, and whether both end there."""
    mark = np.zeros(int(ends_a[-1]) + 1 if len(ends_a) else 0, np.uint8)
    mark[ends_a] |= A_END
    mark[ends_b] |= B_END
    mark = mark[mark > 0]
    passed = [np.cumsum(ends) - ends for ends in ((mark & A_END).astype(np.int64), (mark >> 1).astype(np.int64))]
    return passed[0], passed[1], mark == A_END | B_END


def turns(x: np.ndarray) -> np.ndarray:
    """Which places are the last of a run of equal values?"""
    return np.append(x[1:] != x[:-1], True)


def written(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n_groups: int, group_doc: np.ndarray, tables: tuple) -> tuple[bytes, np.ndarray]:
    """The groups of all texts as `a1,a2|b1;a3|b2,b3`, one after the other, and where each group's text begins and the last ends.

    group_doc: each group's text. A token's byte after its decimals is a comma, or what ends its side of the group; that
    of a text's last group is left out.
    """
    (digits_a, length_a), (digits_b, length_b) = tables
    n_a, n_b = (np.bincount(g, minlength=n_groups) for g in (group_a, group_b))
    before_a, before_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    place_a = np.arange(len(a)) + before_b[group_a]
    place_b = np.arange(len(b)) + (before_a + n_a)[group_b]
    rows, length = np.empty((len(a) + len(b), 7), np.uint8), np.empty(len(a) + len(b), np.int64)
    rows[place_a], rows[place_b], length[place_a], length[place_b] = digits_a[a], digits_b[b], length_a[a], length_b[b]
    stop = np.full(len(rows), ord(","), np.uint8)
    stop[before_a + n_a + before_b - 1] = ord("|")
    last = before_a + n_a + before_b + n_b - 1
    stop[last] = ord(";")
    rows[np.arange(len(rows)), length] = stop
    length += 1
    length[last[turns(group_doc)]] -= 1
    ends = np.concatenate(([0], np.cumsum(length)))
    return rows[np.arange(7) < length[:, None]].tobytes(), np.append(ends[before_a + before_b], ends[-1])


def packed(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(planes(x.astype(np.int32)) for x in arrays), 1)


def unpacked(raw: bytes, parts: int) -> list[np.ndarray]:
    data = zstandard.decompress(raw)
    size = len(data) // parts
    return [from_planes(data[i * size : (i + 1) * size], "i4").astype(np.int64) for i in range(parts)]


def aligned_chunk(texts: list[str | None], tools: tuple, digest: bool) -> dict[str, list]:
    """The columns of a chunk's texts; the first row also has the chunk's distinct pairs and their numbers of documents."""
    import hashlib

    (ta, bytes_a, *table_a), (tb, bytes_b, *table_b) = tools
    n = len(texts)
    full = np.flatnonzero(np.fromiter((bool(t) for t in texts), bool, n))
    spaced = [" " + texts[i] for i in full]
    want = [t.encode() for t in spaced]
    a, n_a = ta.encode(spaced)
    good = covering(a, n_a, ta.bytes, want)
    b, n_b = tb.encode([texts[i] for i in full])
    good &= covering(b, n_b, tb.bytes, want)
    a, b, full, n_a, n_b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)], full[good], n_a[good], n_b[good]
    out = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
    rest = [None] * (n - 1)
    if not len(full):
        return out | {"groups": [""] * n, "held": [None] * n, "keys": [[], *rest], "docs": [[], *rest]}
    at_a, at_b, both = merged(np.cumsum(bytes_a[a]), np.cumsum(bytes_b[b]))
    doc = np.repeat(np.arange(len(full)), n_a)[at_a]  # of each link
    group = np.cumsum(both) - both
    n_groups = np.bincount(doc[both], minlength=len(full))
    text, starts = written(a, b, group[turns(at_a)], group[turns(at_b)], int(both.sum()), doc[both], (table_a, table_b))
    cut = starts[np.concatenate(([0], np.cumsum(n_groups)))]
    keys, code = np.unique(a[at_a] << 32 | b[at_b], return_inverse=True)
    held, times = np.unique(doc * len(keys) + code, return_counts=True)
    ends = np.concatenate(([0], np.cumsum(np.bincount(held // len(keys)))))
    held = held % len(keys)
    step = np.diff(held, prepend=0)
    step[ends[:-1]] = held[ends[:-1]]
    for c, v in (("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups), ("n_links", np.bincount(doc, minlength=len(full)))):
        out[c][full] = v
    groups, held_by = [""] * n, [None] * n
    for i, x, y, p, q in zip(full.tolist(), cut[:-1].tolist(), cut[1:].tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        groups[i] = hashlib.sha256(text[x:y]).hexdigest() if digest else text[x:y].decode()
        held_by[i] = packed(step[p:q], times[p:q])
    return out | {"groups": groups, "held": held_by, "keys": [keys, *rest], "docs": [np.bincount(held, minlength=len(keys)), *rest]}


STORED = "chunk long, n_a long, n_b long, n_groups long, n_links long, groups string, held binary, keys array<long>, docs array<long>"


def align(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Rows of documents (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups), and of linked pairs (a, b, count, most_a, most_b).

    A: `space + text` by the byte-level vocabulary of a_path; B: text by the sentencepiece model of b_path. groups has
    the ids of every group (`a1,a2|b1;a3|b2,b3`), or with digest its hex SHA-256. count: the documents that hold the pair
    linked; most_a, most_b: the largest count of a pair of that id. n_best: the document's links whose count is most_a;
    count_sum: the counts over its links. Null and empty texts, and those whose tokens of either side do not join to
    `space + text`, have no tokens: zeros, and groups ''. Rows that repeat, with null ids too, are documents each. Very
    long texts are merged whole; an empty table gives none; further columns are not read.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tools, number = sides(a_path, b_path), itertools.count(TaskContext.get().partitionId() << 32)
        for frame in frames:
            size = np.fromiter((len(t or "") for t in frame["_text"]), np.int64, len(frame))
            group = (np.cumsum(size) - size) // chunk
            for part in np.split(np.arange(len(frame)), np.flatnonzero(np.diff(group)) + 1):
                if len(part):
                    texts = frame["_text"].iloc[part].tolist()
                    yield pd.DataFrame({id_col: frame["_id"].iloc[part].to_numpy(), "chunk": next(number), **aligned_chunk(texts, tools, digest)})

    rows = stored(docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")).mapInPandas(run, f"`{id_col}` {kind}, {STORED}"), "aligned")
    pairs = rows.where("keys IS NOT NULL").select("chunk", F.posexplode(F.arrays_zip("keys", "docs")).alias("pos", "p")).select("chunk", "pos", F.col("p.keys").alias("key"), F.col("p.docs").alias("docs"))
    counts = stored(pairs.groupBy("key").agg(F.sum("docs").alias("count")).select("key", F.shiftright("key", 32).alias("a"), F.col("key").bitwiseAND(0xFFFFFFFF).alias("b"), "count"), "pairs")
    # as many rows as a vocabulary has ids at most
    for x in "ab":
        counts = counts.join(F.broadcast(counts.groupBy(x).agg(F.max("count").alias(f"most_{x}"))), x)
    answers = pairs.select("chunk", "pos", "key").join(counts.select("key", "count", (F.col("count") == F.col("most_a")).alias("best")), "key").select(F.col("chunk").alias("of"), "pos", "count", "best")

    def summed(one: pa.Table, two: pa.Table) -> pa.Table:
        count, best = np.zeros(two.num_rows, np.int64), np.zeros(two.num_rows, np.int64)
        pos = two.column("pos").to_numpy()
        count[pos], best[pos] = two.column("count").to_numpy(), two.column("best").to_numpy()
        n_best, total = [], []
        for raw in one.column("held").to_pylist():
            step, times = unpacked(raw, 2) if raw is not None else (np.empty(0, np.int64),) * 2
            at = np.cumsum(step)
            n_best.append(int((best[at] * times).sum()))
            total.append(int((count[at] * times).sum()))
        return one.select([id_col, "n_a", "n_b", "n_groups", "n_links"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64())).append_column("groups", one.column("groups"))

    left = rows.select("chunk", id_col, "n_a", "n_b", "n_groups", "n_links", "groups", "held")
    ddl = f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    return left.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(summed, ddl), counts.select("a", "b", "count", "most_a", "most_b")
