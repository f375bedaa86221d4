"""BPE encoding and decoding in batched numpy merge rounds.

The vocabulary is a byte-level one of the tokenizers library (its JSON file is a parameter and is read on each worker).
Texts are cut into pre-tokens by the byte-level pattern; the symbols of all pre-tokens that a worker has not met yet lie
in one flat array. A round looks every adjacent pair up by binary search over the sorted pair keys and merges, from left
to right, those whose rank is the lowest within reach: no token is longer than REACH bytes, so a pair that far away can't
touch this one before it merges. In pre-tokens of up to REACH symbols that is the lowest rank of the whole; longer ones
merge at many places in one round, so that rounds do not grow with their length.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .shared import bounded_batches
from .text import slices

#: The byte-level pre-token pattern: a fixed value of this vocabulary family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int64(1) << 40
#: Pre-tokens that a worker remembers; beyond that it starts anew.
REMEMBERED = 250_000


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, and the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def chosen(rank: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Of overlapping hits (a a a: pairs of one rank in a row) every second one from the row's start.

    A row's hits after a place that is none are left for a later round, which knows where they begin. Rows never reach
    over pre-tokens, whose last place has no pair.
    """
    at = np.arange(len(rank))
    begins = np.concatenate(([True], rank[1:] != rank[:-1]))
    start = np.maximum.accumulate(np.where(begins, at, 0))
    missed = np.maximum.accumulate(np.where(hit, -1, at))
    return hit & (missed < start) & ((at - start) % 2 == 0)


class Bpe:
    """One byte-level vocabulary: encode(texts), decode(ids)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        chars = byte_chars()
        self.symbol = np.zeros(256, np.int64)
        for c, b in chars.items():
            self.symbol[b] = vocab[c]
        self.token_bytes = [b""] * self.size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(chars[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        left = np.fromiter((vocab[a] for a, _ in merges), np.int64, len(merges))
        right = np.fromiter((vocab[b] for _, b in merges), np.int64, len(merges))
        made = np.fromiter((vocab[a + b] for a, b in merges), np.int64, len(merges))
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.reach = max(map(len, self.token_bytes))
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.known: dict[str, tuple[str, int, bytes]] = {}

    def look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each pair among the sorted keys, -1 without a merge."""
        key = a * self.size + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, at, -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in one flat array, and the number of each word's."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.symbol[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        out_word, out_sym = [], []
        while len(sym):
            pair = np.full(len(sym), -1)
            same = word[1:] == word[:-1]
            pair[:-1][same] = self.look(sym[:-1][same], sym[1:][same])
            rank = np.where(pair >= 0, self.rank[pair], NONE)
            first = np.flatnonzero(np.concatenate(([True], ~same)))
            count = np.diff(np.append(first, len(sym)))
            lowest = np.minimum.reduceat(rank, first)
            live = lowest < NONE
            if not live.all():
                keep = np.repeat(live, count)
                out_word.append(word[~keep])
                out_sym.append(sym[~keep])
                sym, word, rank, pair = sym[keep], word[keep], rank[keep], pair[keep]
                count, lowest = count[live], lowest[live]
            bar = np.repeat(lowest, count)
            if (count > self.reach).any():
                far = np.repeat(count > self.reach, count)
                bar[far] = self.lowest_near(rank[far], count[count > self.reach])
            at = np.flatnonzero(chosen(rank, (rank == bar) & (rank < NONE)))
            sym[at] = self.made[pair[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, word = sym[keep], word[keep]
        ids, owner = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_sym, out_word))
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def lowest_near(self, rank: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The lowest rank within reach on either side, inside runs of `count`; by minima over blocks of one width."""
        reach = self.reach
        # reach places without a pair between runs, and around all
        place = np.arange(len(rank)) + reach * (1 + np.repeat(np.arange(len(count)), count))
        width = 2 * reach + 1
        size = -(-(len(rank) + reach * (len(count) + 1)) // width) * width
        row = np.full(size + width, NONE)
        row[place] = rank
        blocks = row.reshape(-1, width)
        before = np.minimum.accumulate(blocks, axis=1).ravel()
        after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        return np.minimum(after[place - reach], before[place + reach])

    def learn(self, words: list[str]) -> None:
        """Puts ids (as joined decimals), their number and their bytes of new words into `known`."""
        ids, size = self.merge([w.encode() for w in words])
        ends = np.cumsum(size)
        flat, token_bytes = ids.tolist(), self.token_bytes
        for w, a, b in zip(words, (ends - size).tolist(), ends.tolist(), strict=True):
            own = flat[a:b]
            self.known[w] = (",".join(map(str, own)), b - a, b"".join([token_bytes[i] for i in own]))

    def split(self, text: str) -> list[str]:
        """Pre-tokens, with the special tokens that stand in the text as elements of their own."""
        if self.cut is None or not self.cut.search(text):
            return self.pattern.findall(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [*self.pattern.findall(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.pattern.findall(text[at:])

    def prepare(self, texts: list[str]) -> list[list[str]]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for s, i in self.special.items():
            self.known[s] = (str(i), 1, self.token_bytes[i])
        parts = [self.split(t) for t in texts]
        new = set().union(*parts).difference(self.known)
        if new:
            self.learn(list(new))
        return parts

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[int(x) for w in p for x in self.known[w][0].split(",")] for p in self.prepare(texts)]

    def decode(self, ids: list[int]) -> str:
        """Bytes of all tokens, special ones included; what is no UTF-8 becomes U+FFFD."""
        return b"".join([self.token_bytes[i] for i in ids]).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids array<int>): every whole text encoded; null text as the empty one, which has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for part in slices(batch, "_text", 2 << 20):
                ids = bpe.encode(pc.fill_null(part.column("_text"), "").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, text): ids turned back into text; null ids as no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            text = [bpe.decode(x or []) for x in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(text, pa.string())], [id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(encoded[id_col].alias("_id"), encoded[ids_col].alias("_ids")).mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256) of every text, in one pass.

    Null text counts as the empty one (no tokens, digests of empty strings). Rows are independent: repeated or null ids
    each give their row; very long texts are encoded whole; an empty table gives none; further columns are not read.
    """

    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        sha = hashlib.sha256
        for batch in batches:
            for part in slices(batch, "_text", 2 << 20):
                count, ids_sha, text_sha = [], [], []
                for words in bpe.prepare(pc.fill_null(part.column("_text"), "").to_pylist()):
                    own = [bpe.known[w] for w in words]
                    count.append(sum([x[1] for x in own]))
                    ids_sha.append(sha(",".join([x[0] for x in own]).encode()).hexdigest())
                    text_sha.append(sha(b"".join([x[2] for x in own]).decode("utf-8", "replace").encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
