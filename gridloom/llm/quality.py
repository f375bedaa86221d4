"""Quality rules: text statistics, and decision lists learned from labelled ones.

A decision list is an ordered list of conjunctions of thresholds, each with a class. Sequential covering finds the
rules one by one: a conjunction grows, threshold by threshold, on two thirds of the labelled rows while its FOIL gain
lasts, loses conditions from its end while that raises its worth on the other third, and is kept if it is precise enough there;
the rows that it covers leave, and the search starts again. The list becomes one Spark CASE expression.

Labelled rows are few and fit the driver: the sample is the MAX_LABELLED rows with the smallest hashes of their ids.
Statistics are computed for every document from its whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .shared import bounded_batches, dropped, own_names, stored
from .text import PART, coded, covered, hashed, slices, windows, words_of

MAX_LABELLED = 50_000
WINDOW = 8
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_digits", "n_upper", "n_stops")
#: Characters counted by n_symbols, and those that can end a sentence.
SYMBOLS, STOPS = b"#*$%&|<>", b".!?"


def table(of: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(of, np.uint8))


#: For each byte: does it begin a code point of a word; is it a symbol, a digit, a capital, a stop.
SPACE = table(b" \t\n\x0b\x0c\r")
BEGINS = ~SPACE & ((np.arange(256) & 0xC0) != 0x80)
BYTE_STATS = (("word_chars", BEGINS), ("n_symbols", table(SYMBOLS)), ("n_digits", table(b"0123456789")), ("n_upper", table(bytes(range(65, 91)))), ("n_stops", table(STOPS)))


def statistics_of(text: pa.Array) -> dict[str, np.ndarray]:
    """STATS of each text; null counts as the empty text."""
    text = pc.fill_null(text, "")
    n = len(text)
    size = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(size)))
    flat = np.frombuffer(b"".join(text.cast(pa.binary()).to_pylist()), np.uint8)
    out = {}
    for name, marks in BYTE_STATS:
        out[name] = np.concatenate(([0], np.cumsum(marks[flat], dtype=np.int64)))[ends]
        out[name] = np.diff(out[name])

    words, offsets = words_of(text)
    codes, distinct = coded(words)
    out["n_words"] = np.diff(offsets)
    owner = np.repeat(np.arange(n), out["n_words"])
    pair = np.sort(owner * max(1, len(distinct)) + codes)
    fresh = np.concatenate(([True], pair[1:] != pair[:-1]))[: len(pair)]
    out["n_distinct_words"] = np.bincount(pair[fresh] // max(1, len(distinct)), minlength=n)

    window, first, of = windows(hashed(distinct)[codes], offsets, WINDOW)
    order = np.lexsort((window, of))
    same = (window[order][1:] == window[order][:-1]) & (of[order][1:] == of[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = covered(first[order[twice]], WINDOW, len(codes))
    out["n_repeat_words"] = np.bincount(owner[hit], minlength=n)

    lists = pc.split_pattern(text, "\n")
    line_owner = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    lines = lists.flatten()
    filled = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0)
    line_owner = line_owner[filled.to_numpy(zero_copy_only=False)]
    code, kinds = coded(lines.filter(filled))
    out["n_lines"] = np.bincount(line_owner, minlength=n)
    unique = np.unique(line_owner * max(1, len(kinds)) + code)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(unique // max(1, len(kinds)), minlength=n)
    return out


def statistics(docs: DataFrame, *, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Rows of `keep` columns and STATS (bigint), one for each row of docs. A text that is kept travels once."""
    bounded_batches(docs.sparkSession)
    kept = ["_text" if c == text_col else f"_k{i}" for i, c in enumerate(keep)]
    names = own_names(keep, [*STATS, "base_failed", "rule", "kept"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", PART):
                stats = statistics_of(part.column("_text"))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), *(pa.array(stats[s], pa.int64()) for s in STATS)], [*names, *STATS])

    schema = ", ".join([*(f"`{n}` {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True)), *(f"{s} bigint" for s in STATS)])
    return docs.select(*(docs[c].alias(k) for c, k in zip(keep, kept, strict=True) if c != text_col), docs[text_col].alias("_text")).mapInArrow(run, schema)


#: What rules may ask for: ratios of the statistics, each over a divisor that is 1 at least, and plain counts.
RATIOS = {
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "digit_share": ("n_digits", "word_chars"),
    "upper_share": ("n_upper", "word_chars"),
    "stop_share": ("n_stops", "n_words"),
    "word_length": ("word_chars", "n_words"),
    "line_words": ("n_words", "n_lines"),
    "n_words": ("n_words", None),
}


@dataclass(frozen=True)
class Test:
    """One threshold: feature >= value or feature < value."""

    feature: str
    at_least: bool
    value: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.value if self.at_least else x[self.feature] < self.value

    def column(self) -> Column:
        x, y = RATIOS[self.feature]
        ratio = F.col(x).cast("double") / (F.greatest(F.col(y), F.lit(1)).cast("double") if y else F.lit(1.0))
        return ratio >= F.lit(self.value) if self.at_least else ratio < F.lit(self.value)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.value:.6g}"


Rule = tuple[Test, ...]


def features(stats: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: stats[x] / (np.maximum(stats[y], 1) if y else 1.0) for k, (x, y) in RATIOS.items()}


def covers(rule: Sequence[Test], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for t in rule:
        out &= t.holds(x)
    return out


def best_test(x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, Test | None]:
    """The threshold of the largest FOIL gain over the rows of x; bad marks the class to be covered."""
    p0, n0 = bad.sum(), len(bad)
    best: tuple[float, Test | None] = (0.0, None)
    if not p0 or p0 == n0:
        return best
    before = np.log2(p0 / n0)
    for name, v in x.items():
        order = np.argsort(v, kind="stable")
        s, hits = v[order], np.cumsum(bad[order])
        cut = np.flatnonzero(s[1:] > s[:-1]) + 1  # rows before the cut are below it
        if not len(cut):
            continue
        value = (s[cut] + s[cut - 1]) / 2
        for at_least in (False, True):
            p = p0 - hits[cut - 1] if at_least else hits[cut - 1]
            n = n0 - cut if at_least else cut
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / n) - before), 0)
            i = int(np.argmax(gain))
            if gain[i] > best[0] + 1e-9:
                best = (float(gain[i]), Test(name, at_least, float(value[i])))
    return best


def grown(x: dict[str, np.ndarray], bad: np.ndarray, longest: int) -> list[Test]:
    rule: list[Test] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < longest and not bad[inside].all():
        _, test = best_test({k: v[inside] for k, v in x.items()}, bad[inside])
        if test is None:
            break
        rule.append(test)
        inside &= test.holds(x)
    return rule


def pruned(rule: list[Test], x: dict[str, np.ndarray], bad: np.ndarray) -> list[Test]:
    """The beginning of rule of the largest (p - n) / (p + n) on rows that it was not grown on; ties: the shortest."""
    worth = []
    for k in range(1, len(rule) + 1):
        c = covers(rule[:k], x, len(bad))
        worth.append((2 * bad[c].sum() - c.sum()) / max(1, c.sum()))
    return rule[: int(np.argmax(worth)) + 1] if worth else rule


def learn(stats: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray, *, precision: float = 0.97, least: int = 5, longest: int = 4, most_rules: int = 32) -> list[Rule]:
    """Rules that reject, in order. fold: 0 to 2, of which 2 prunes. Rules below `precision` on either part end the search."""
    x = features(stats)
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < most_rules:
        grow, prune = left & (fold != 2), left & (fold == 2)
        if bad[grow].sum() < least:
            break
        rule = grown({k: v[grow] for k, v in x.items()}, bad[grow], longest)
        if not rule:
            break
        rule = pruned(rule, {k: v[prune] for k, v in x.items()}, bad[prune]) if bad[prune].any() else rule
        c = covers(rule, x, len(bad)) & left
        sure = all(bad[c & part].sum() >= precision * (c & part).sum() for part in (grow, prune))
        if not sure or (c & grow).sum() < least:
            break
        rules.append(tuple(rule))
        left &= ~c
    return rules


def rejects(rules: Sequence[Rule]) -> Column:
    """The list as a CASE over the STATS columns: the number of the first rule that fires, null if none does."""
    out = None
    for i, rule in enumerate(rules):
        test = rule[0].column()
        for t in rule[1:]:
            test = test & t.column()
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return F.lit(None).cast("int") if out is None else out


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def labelled(stats: DataFrame, labels: DataFrame, *, most: int = MAX_LABELLED) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Statistics, class (quality 0) and fold of a bounded sample of labelled rows, the same whenever it is drawn.

    Rows without id or quality are no examples. An id with both qualities is one row for each.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select("doc_id", "quality").distinct()
    order = F.xxhash64(F.lit(7), F.col("doc_id"))
    some = stored(stats.select("doc_id", *STATS).join(known, "doc_id").withColumn("_order", order), "labelled")
    total = some.count()
    if total > most:
        # hashes below a cut that leaves `most` rows and a margin of eight deviations: only those come to the driver
        share = min(1.0, (most + 8 * math.sqrt(most) + 64) / total)
        few = some.where(F.col("_order") < int(-(2**63) + share * (2**64 - 1))) if share < 1 else some
    else:
        few = some
    rows = few.orderBy("_order", "quality", *STATS).limit(most).toPandas()
    dropped(some)
    return {s: rows[s].to_numpy(np.int64) for s in STATS}, rows["quality"].to_numpy() == 0, rows["_order"].to_numpy(np.int64) % 3


def judge(docs: DataFrame, labels: DataFrame, *, keep: Sequence[str] = ("doc_id",), most: int = MAX_LABELLED) -> tuple[DataFrame, list[Rule]]:
    """(rows of `keep` and STATS with base_failed, rule and kept, one for each row of docs; the rules learned).

    keep must hold doc_id. Null or empty texts have no words and fail the base; very long texts are judged whole. An empty
    table gives no rows. Columns not in keep are not read; a kept one of the name of an output comes back with a leading _. Without labels there are no rules. Rows
    with the same or no doc_id are judged each by its own text.
    """
    stats = stored(statistics(docs, keep=keep), "quality")
    rules = learn(*labelled(stats, labels, most=most))
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", rejects(rules).cast("int"))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), rules
