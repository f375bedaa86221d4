"""Fill-in-middle transformation by a streaming matcher in two passes.

A text is a run of units (lines unless another pattern is given). The first pass counts them; two hashed ranks among
the count say where the prefix and the middle end. The second pass advances one lazy match iterator to the lower rank
and on to the higher, and the text is cut at the ends of those two matches. No list of units exists in either pass:
beyond the text and its output a worker holds one match.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import bounded_batches, own_names
from .text import slices

#: A line with its end, or the rest of the text.
LINES = r"[^\n]*\n|[^\n]+"
MARKS = ("<P>", "<S>", "<M>")
OUTPUTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def checked(marks: Sequence[str]) -> None:
    """Raises unless marks can be told from any text around them: no end of one begins another, none holds another."""
    for i, s in enumerate(marks):
        for j, t in enumerate(marks):
            if not s or (i != j and s in t) or any(t.startswith(s[k:]) for k in range(1, len(s))):
                raise ValueError(f"marks that overlap: {s!r} and {t!r}")


def draws(seed: int, key: int | None) -> list[int]:
    """Four 32-bit integers of a row: the first 8-digit groups of the hex SHA-256 of `seed:key`, of `seed:` for a null key."""
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def advanced(matches: Iterator[re.Match], count: int, at: int) -> int:
    """The end of the count-th next match; `at` where count is 0."""
    for m in itertools.islice(matches, count):
        at = m.end()
    return at


def cuts(text: str, unit: re.Pattern, first: int, second: int) -> tuple[int, int, int]:
    """The number n of units, and the ends of the prefix and of the middle: after `first` and `second` modulo n + 1 units, in order."""
    n = sum(1 for _ in unit.finditer(text))
    low, high = sorted((first % (n + 1), second % (n + 1)))
    matches = unit.finditer(text)
    a = advanced(matches, low, 0)
    return n, a, advanced(matches, high - low, a)


def transform(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm_rate: int = 50, unit: str = LINES, marks: Sequence[str] = MARKS, keep: Sequence[str] = ()) -> DataFrame:
    """Rows (id, n, form, prefix_chars, middle_chars, output, *keep), one for each of docs.

    form is psm (`<P>`prefix`<S>`suffix`<M>`middle), spm (`<S>`suffix`<P>`prefix`<M>`middle) or plain, where output is
    the text itself: for `100 - rate` of a hundred rows, empty texts and texts that hold a mark. Lengths count code
    points and are null in plain rows. The draws follow from seed and id alone, so rows that repeat come out alike and
    ids that are null share theirs. Null text counts as empty; very long texts are cut whole; an empty table gives no
    rows; a kept column of the name of an output comes back with a leading _.
    """
    bounded_batches(docs.sparkSession)
    checked(marks)
    prefix_mark, suffix_mark, middle_mark = marks
    pattern = re.compile(unit)
    names = own_names(keep, (id_col, *OUTPUTS))

    def one(key: int | None, text: str) -> tuple:
        h1, h2, h3, h4 = draws(seed, key)
        n, a, b = cuts(text, pattern, h1, h2)
        if not text or h3 % 100 >= rate or any(m in text for m in marks):
            return n, "plain", None, None, text
        if h4 % 100 < spm_rate:
            return n, "spm", a, b - a, "".join((suffix_mark, text[b:], prefix_mark, text[:a], middle_mark, text[a:b]))
        return n, "psm", a, b - a, "".join((prefix_mark, text[:a], suffix_mark, text[b:], middle_mark, text[a:b]))

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                rows = [one(key, text or "") for key, text in zip(part.column("_id").to_pylist(), part.column("_text").to_pylist(), strict=True)]
                made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("_id"), *made, *(part.column(f"_keep{i}") for i in range(len(keep)))], [id_col, *OUTPUTS, *names])

    ddl = ", ".join([f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}", "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string", *(f"`{n}` {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True))])
    return docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"), *(docs[c].alias(f"_keep{i}") for i, c in enumerate(keep))).mapInArrow(run, ddl)


def restore(rows: DataFrame, *, marks: Sequence[str] = MARKS, into: str = "restored") -> DataFrame:
    """rows (form, output, ...) with `into`: the text that transform() was given, from form and output alone."""
    checked(marks)
    parts = F.split("output", "|".join(map(re.escape, marks)), -1)
    at = lambda i: F.get(parts, F.lit(i))
    whole = F.when(F.col("form") == "psm", F.concat(at(1), at(3), at(2))).when(F.col("form") == "spm", F.concat(at(2), at(3), at(1)))
    return rows.withColumn(into, F.coalesce(whole, "output"))
