"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

Texts and templates are words of a-z and 0-9, and shingles of five words. A template of L shingles, T of them distinct,
is sought in windows of L + stride - 1 shingles, stride = max(1, T // 4), so that a whole occurrence lies in one window.
A window retrieves a template if one of its bands' minima (one row a band) is the same. A window that holds 0.8 of the
template's distinct shingles has a Jaccard similarity of at least 0.8 T / (L + 0.45 T); the template has as many bands
as keep the chance to miss it below MISS. Without repeats (L = T) that is 0.8 / 1.45 and 14 bands; an exact copy is
missed at 2e-10. The window matches if it holds 0.8 or more of the template's distinct shingles.
A minimum can only be the same where the window holds the shingle that is the template's own minimum: windows without
any such shingle, most of all, are passed over before minima are taken, which changes no result. All of it is column
expressions over one document; nothing is shuffled. The templates are a parameter of at most MOST_SHINGLES shingles; one
name can have several. The default ones are whole texts, standard headers and short notices of common licenses, to which
the names in SPDX lines are added.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Mapping
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import own_names

SHINGLE, SHARE, MOST_SHINGLES = 5, 80, 20_000
#: The chance to miss a matching window, and the bands that a template may take for it.
MISS, MOST_BANDS = 1.5e-5, 256
#: Whole texts in license_texts/NAME.txt, without the appendix that says how to apply them.
TEXTS = ("Apache-2.0", "BSL-1.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "Zlib")
PUBLISHED = "under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or"
ONLY = "under the terms of the GNU {} as published by the Free Software Foundation; version {} of the License"
BINARY = "in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {}"
BSD_WARRANTY = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES", "THIS SOFTWARE IS PROVIDED BY THE AUTHOR AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES", "THIS SOFTWARE IS PROVIDED BY THE AUTHOR AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES")
#: Standard headers, short notices and, of texts that hold most of each other (BSD), the passages that tell them apart.
#: Where versions or names differ in one word, a notice is so short that SHARE allows for no other.
NOTICES = {
    "AGPL-3.0": (PUBLISHED.format("Affero General Public License", "3"), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "under the GNU Affero General Public License v3"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Licensed under the Apache License 2.0",
        "under the Apache 2.0 License",
        "under the terms of the Apache License, Version 2.0",
    ),
    "BSD-2-Clause": (*(BINARY.format(w) for w in BSD_WARRANTY), "under the BSD 2-Clause License"),
    "BSD-3-Clause": (*(f"nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {w}" for w in BSD_WARRANTY), "under the BSD 3-Clause License"),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0.", "licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0-1.0": ("has waived all copyright and related or neighboring rights to",),
    "GPL-2.0": (PUBLISHED.format("General Public License", "2"), ONLY.format("General Public License", "2"), "under the GNU General Public License version 2", "of the GNU General Public License version 2", "under the GNU GPL v2"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", PUBLISHED.format("General Public License", "3"), ONLY.format("General Public License", "3"), "under the GNU General Public License version 3", "of the GNU General Public License version 3", "under the GNU GPL v3"),
    "ISC": ("Licensed under the ISC License", "under the terms of the ISC License"),
    "LGPL-2.1": (PUBLISHED.format("Lesser General Public License", "2.1"), ONLY.format("Lesser General Public License", "2.1"), "under the GNU Lesser General Public License v2.1"),
    "LGPL-3.0": (PUBLISHED.format("Lesser General Public License", "3"), "GNU Lesser General Public License version 3", "under the GNU Lesser General Public License v3"),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License", "Distributed under the MIT License", "Available under the MIT License", "under the terms of the MIT License", "The MIT License (MIT) Copyright"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Licensed under the Mozilla Public License, Version 2.0", "Licensed under the Mozilla Public License 2.0"),
}
#: Line by which files name their license; most are too short for a shingle, so it is read by pattern.
TAG = "SPDX-License-Identifier"
NAMED = rf"{TAG}:[ \t]*([A-Za-z0-9.+() \t-]+)"


@functools.cache
def defaults() -> dict[str, tuple[str, ...]]:
    """All templates of each name."""
    here = resources.files(__package__) / "license_texts"
    whole = {n: (here / f"{n}.txt").read_text(encoding="utf-8") for n in TEXTS}
    return {n: NOTICES.get(n, ()) + ((whole[n],) if n in whole else ()) for n in sorted({*NOTICES, *TEXTS})}


def tagged(text: Column, names: Iterable[str]) -> Column:
    """The names in SPDX lines; -only, -or-later and + are dropped."""
    ids = F.split(F.lower(F.array_join(F.regexp_extract_all(text, F.lit(NAMED), 1), " ")), r"[() \t]+")
    plain = F.transform(ids, lambda i: F.regexp_replace(i, r"(-only|-or-later|\+)$", ""))
    known = F.create_map(*(F.lit(x) for n in names for x in (n.lower(), n)))
    return F.when(F.contains(text, F.lit(TAG)), F.array_compact(F.transform(plain, lambda i: F.try_element_at(known, i)))).otherwise(F.array().cast("array<string>"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(plain, "[^a-z0-9]+"), lambda w: w != "")


def shingles_of(words: Column) -> Column:
    """Hashes of all runs of five words, in order."""
    last = F.size(words) - (SHINGLE - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))).otherwise(F.array().cast("array<bigint>"))


def minimum(shingles: Column, band: Column) -> Column:
    return F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, band)))


def longs(values: list[int]) -> Column:
    """A constant; one literal, because templates have thousands of values."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def keyed(band: Column):
    return lambda h: F.struct(F.xxhash64(h, band).alias("v"), h.alias("h"))


def prepared(spark: SparkSession, templates: Mapping[str, str | tuple[str, ...]]) -> list[dict]:
    """Of each template its name, distinct shingles, minima and the shingles that are minima."""
    each = [(n, t) for n, ts in templates.items() for t in ((ts,) if isinstance(ts, str) else ts)]
    # explodes of one element: what they hold is computed once, not again wherever a later column reads it
    once = lambda value, name: F.explode(F.array(value)).alias(name)
    rows = spark.createDataFrame(each, "name string, text string").select("name", once(words_of(F.col("text")), "words")).select("name", once(shingles_of(F.col("words")), "all"))
    rows = rows.select("name", F.size("all").alias("length"), once(F.array_distinct("all"), "shingles"))
    similar = 0.8 * F.size("shingles") / (F.col("length") + 0.45 * F.size("shingles"))
    rows = rows.withColumn("bands", F.when(F.size("shingles") > 0, F.ceil(F.lit(math.log(MISS)) / F.log(1 - similar))).otherwise(1).cast("int"))
    rows = rows.select("name", "length", "shingles", once(F.col("bands"), "bands"))
    band = lambda value: F.transform(F.sequence(F.lit(0), F.col("bands") - 1), lambda p: value(p))
    rows = rows.select("*", band(lambda p: minimum(F.col("shingles"), p)).alias("minima"))
    rows = rows.select("*", F.array_distinct(band(lambda p: F.array_min(F.transform("shingles", keyed(p)))["h"])).alias("marks"))
    out = [r.asDict() for r in rows.orderBy("name").collect()]
    repeats = [r["name"] for r in out if r["bands"] > MOST_BANDS]
    if repeats:
        raise ValueError(f"templates that repeat themselves so often that they need more than {MOST_BANDS} bands: {repeats}")
    if sum(len(r["shingles"]) for r in out) > MOST_SHINGLES:
        raise ValueError(f"templates of more than {MOST_SHINGLES} shingles")
    short = [r["name"] for r in out if not r["shingles"]]
    if short:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
    return out


def holds(shingles: Column, template: dict) -> Column:
    """Does a window of `shingles` retrieve and match the template?"""
    n = len(template["shingles"])
    stride, most = max(1, n // 4), template["length"]
    mine, marks, minima = (longs(template[c]) for c in ("shingles", "marks", "minima"))

    def window(start: Column) -> Column:
        return F.slice(shingles, start, most + stride - 1)

    def same(start: Column) -> Column:
        return F.exists(F.sequence(F.lit(0), F.lit(template["bands"] - 1)), lambda p: F.array_min(F.transform(window(start), lambda h: F.xxhash64(h, p))) == F.get(minima, p))

    def matches(start: Column) -> Column:
        return same(start) & (100 * F.size(F.array_intersect(window(start), mine)) >= SHARE * n)

    starts = F.sequence(F.lit(1), F.greatest(F.size(shingles), F.lit(1)), F.lit(stride))
    return F.arrays_overlap(shingles, marks) & F.exists(F.filter(starts, lambda i: F.arrays_overlap(window(i), marks)), matches)


def scan(docs: DataFrame, templates: Mapping[str, str | tuple[str, ...]] | None = None, *, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Rows (*keep, licenses), one for each row of docs: the names found, in order, an empty array if there are none.

    Null, empty and short texts hold no license; very long ones are scanned whole. Repeated rows give a row each; an empty
    table gives none. Columns not in keep are not read; a kept one named licenses comes back as _licenses.
    """
    known = prepared(docs.sparkSession, defaults() if templates is None else templates)
    kept = [f"_k{i}" for i in range(len(keep))]
    none = F.array().cast("array<string>")
    tags = tagged(F.coalesce(docs[text_col], F.lit("")), defaults()) if templates is None else none
    rows = docs.select(*(docs[c].alias(k) for c, k in zip(keep, kept, strict=True)), tags.alias("_t"), words_of(docs[text_col]).alias("_w")).select(*kept, "_t", shingles_of(F.col("_w")).alias("_h"))
    marks = sorted({m for t in known for m in t["marks"]})
    rows = rows.withColumn("_any", F.arrays_overlap("_h", longs(marks)) if marks else F.lit(False))
    found = [F.when(holds(F.col("_h"), t), F.lit(t["name"])) for t in known]
    names = F.array_compact(F.array(*found)) if found else none
    names = F.array_sort(F.array_union("_t", F.when(F.col("_any"), names).otherwise(none)))
    return rows.select(*(F.col(k).alias(c) for k, c in zip(kept, own_names(keep, ["licenses"]), strict=True)), names.alias("licenses"))
