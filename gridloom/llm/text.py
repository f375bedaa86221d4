"""Arrow and numpy helpers on columns of whole texts.

A word is a maximal run of anything but the six ASCII white-space bytes 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WORD_RE = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a step with many arrays for each word takes at once: they hold some 30 times that, and workers keep what they held.
PART = 1 << 20
#: Odd multiplier of the Rabin-Karp polynomial modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Zero-copy cuts of batch with about `limit` bytes of text each, or one row where that is longer."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(size) - size) // limit
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def words_of(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in one flat array, and where each text's words begin (one more entry than texts)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(text, ""))
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)))
    offsets = np.concatenate(([0], np.cumsum(full, dtype=np.int64)))[ends]
    return (flat if full.all() else flat.filter(pa.array(full))), offsets


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words as codes into the array of distinct words."""
    d = words.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def hashed(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each distinct string, the same on every machine."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter(map(h, distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct))


def windows(values: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of all runs of k values that stay within one text.

    values: a 64-bit hash for each word; offsets: where texts begin. Returns the hashes, the position of each
    window's first word in values, and its text's number. The prefix sums of values times powers of BASE give each
    window in O(1); arithmetic is modulo 2**64.
    """
    n = len(values)
    sizes = np.diff(offsets)
    count = np.maximum(sizes - k + 1, 0)
    total = int(count.sum())
    if not total:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    text = np.repeat(np.arange(len(sizes)), count)
    first = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + offsets[:-1][text]
    power = np.full(n, BASE, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    inverse = np.full(n, UNBASE, np.uint64)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values * power, out=prefix[1:])
    return mixed((prefix[first + k] - prefix[first]) * inverse[first]), first, text


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over the others (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of `length` each, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def covered(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of k words that begins at one of `first`."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, first + k, -1)
    return np.cumsum(step[:-1]) > 0


def planes(values: np.ndarray) -> bytes:
    """Integers with their first, second, ... bytes together, so that the quiet high ones compress away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def from_planes(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)
