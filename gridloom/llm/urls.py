"""URL rules by Bloom filter cascades: exact membership over the corpus's whole key universe, without joins.

A key is the end of a host (whole labels) followed by the beginning of a path. Rules have few shapes (labels, path
length), and a url has at most one key of each shape; these keys of all urls are the universe. Level 1 of a cascade
holds the listed keys; level 2 the unlisted keys of the universe that pass level 1; level 3 the listed keys that pass
level 2, and so on until no key passes wrongly. Level 1's false positives are set to about the number of listed keys
(its bits grow with the logarithm of the universe), so all levels together stay a small multiple of the list and are
constants of the plan; their size is checked. Only keys that pass level 1 are ever shuffled, distinct ones of a task
once. All of it is DataFrame functions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .shared import dropped, own_names, stored

#: Bytes that the levels of one cascade may take.
MOST_BYTES = 32 << 20
#: Bytes of a filter that come to the driver as one row.
PIECE = 64 << 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    block: bool

    @property
    def key(self) -> str:
        return self.host + self.path

    @property
    def shape(self) -> tuple[int, int]:
        return self.host.count(".") + 1, len(self.path)


@dataclass
class Filter:
    """A Bloom filter: `hashes` bits of `bits` for each key, seeds from `seed` on."""

    bits: int
    hashes: int
    seed: int
    data: bytes = b""

    def places(self, key: Column) -> Column:
        return F.array(*(F.pmod(F.xxhash64(key, F.lit(self.seed + i)), F.lit(self.bits)) for i in range(self.hashes)))

    def passes(self, key: Column) -> Column:
        held = F.lit(bytearray(self.data))
        out = F.lit(True)
        for i in range(self.hashes):
            at = F.pmod(F.xxhash64(key, F.lit(self.seed + i)), F.lit(self.bits))
            byte = F.conv(F.hex(F.substring(held, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            out = out & (F.getbit(byte, (at % 8).cast("int")) == 1)
        return out

    def filled(self, keys: DataFrame) -> Filter:
        """Bits are put together in Spark, first as longs and then as pieces of PIECE bytes: the driver gets one row a piece."""
        at = keys.select(F.explode(self.places(F.col("key"))).alias("at"))
        words = at.groupBy(F.floor(F.col("at") / 64).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("b"))
        # each long as 16 hexadecimal digits, so that the words of a piece join into one string
        one = F.struct("i", F.lpad(F.hex("b"), 16, "0").alias("h"))
        rows = words.groupBy(F.floor(F.col("i") * 8 / PIECE).alias("piece")).agg(F.array_sort(F.collect_list(one)).alias("w")).select("piece", F.col("w.i").alias("i"), F.array_join("w.h", "").alias("h"))
        data = bytearray(8 * ((self.bits + 63) // 64))
        held = np.frombuffer(data, "<u8")
        for r in rows.collect():  # MOST_BYTES / PIECE rows at most
            held[r["i"]] = np.frombuffer(bytes.fromhex(r["h"]), ">u8")
        return Filter(self.bits, self.hashes, self.seed, bytes(data))


def sized(n: int, rate: float, seed: int) -> Filter:
    bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    if bits > 8 * MOST_BYTES:
        raise ValueError(f"a filter of {n} keys at {rate} takes more than {MOST_BYTES} bytes")
    return Filter(bits, max(1, round(bits / max(n, 1) * math.log(2))) if n > 8 else 4, seed)


@dataclass
class Cascade:
    levels: list[Filter] = field(default_factory=list)

    def holds(self, key: Column) -> Column:
        """Is the key listed? Exact for keys of the universe; null for null."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(self.levels[i].passes(key), out).otherwise(F.lit(i % 2 == 1))
        return F.when(key.isNotNull(), out)


def cascade(listed: DataFrame, universe: DataFrame, *, total: int) -> Cascade:
    """The cascade of listed (key) over universe (key, repeats and nulls allowed) of about `total` keys."""
    n = listed.count()
    if not n:
        return Cascade()
    first = sized(n, min(0.5, max(1e-6, 0.7 * n / max(total, 1))), 0).filled(listed)
    marked = universe.where(first.passes(F.col("key"))).select("key").distinct().withColumn("listed", F.lit(False)).unionByName(listed.select("key", F.lit(True).alias("listed")))
    keys = stored(marked.groupBy("key").agg(F.bool_or("listed").alias("listed")), "cascade")
    levels, rest = [first], keys
    while True:
        wanted = len(levels) % 2 == 0  # even levels so far: the next one holds listed keys
        inside = rest.where(F.col("listed") == wanted)
        n = inside.count()
        if not n:
            break
        levels.append(sized(n, 0.5, 1000 * len(levels)).filled(inside))
        # keys of the other kind that pass stay, and so do those just encoded
        rest = rest.where((F.col("listed") == wanted) | levels[-1].passes(F.col("key")))
        if rest.where(F.col("listed") != wanted).isEmpty():
            break
    dropped(keys)
    return Cascade(levels)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url, both empty if it is null or has no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: Sequence[Rule], *, keep: Sequence[str] = ("page_id",), url_col: str = "url") -> DataFrame:
    """Rows (*keep, host, path, rule, verdict), one for each row of pages.

    A rule fits its host and all subdomains, if the path starts with the rule's; the longest wins; block or allow. Urls
    that no rule fits are not listed: allow. Null urls and urls without :// have empty hosts and paths. Repeated rows
    give a row each. A key in both lists is blocked. Without rules all is allowed. An empty table gives no rows; very long
    urls are judged whole. Columns not in keep are not read; a kept one of the name of an output gets a leading _.
    """
    spark = pages.sparkSession
    host, path = parts(pages[url_col])
    kept = [f"_k{i}" for i in range(len(keep))]
    rows = pages.select(*(pages[c].alias(k) for c, k in zip(keep, kept, strict=True)), host.alias("host"), path.alias("path"))
    labels = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1
    shapes = sorted({r.shape for r in rules})
    fits = [F.when((labels >= k) & (F.length("path") >= n), F.concat(F.substring_index("host", ".", -k), F.substring("path", 1, n))) for k, n in shapes]
    out = [F.col(k).alias(c) for k, c in zip(kept, own_names(keep, ["host", "path", "rule", "verdict"]), strict=True)]
    if not rules:
        return rows.select(*out, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    keyed = rows.withColumn("_keys", F.array_compact(F.array(*fits)))
    universe = keyed.select(F.explode("_keys").alias("key"))
    total = universe.count()
    lists = {b: cascade(spark.createDataFrame([(r.key,) for r in rules if r.block == b], "key string").distinct(), universe, total=total) for b in (True, False)}
    hit = F.filter("_keys", lambda k: lists[True].holds(k) | lists[False].holds(k))
    best = F.array_max(F.transform(hit, lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))))["k"]
    ruled = keyed.withColumn("rule", best)
    blocked = F.coalesce(lists[True].holds(F.col("rule")), F.lit(False))
    return ruled.select(*out, "host", "path", "rule", F.when(blocked, "block").otherwise("allow").alias("verdict"))
