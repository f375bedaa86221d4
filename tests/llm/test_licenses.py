"""License scans against a plain scan of all windows of all templates."""

import random
import re

from gridloom.llm import licenses


def shingles(text):
    words = [w for w in re.split("[^a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    return [tuple(words[i : i + licenses.SHINGLE]) for i in range(len(words) - licenses.SHINGLE + 1)]


def plain(text, templates):
    """Names whose templates some window holds to the share asked for: no bands, no marks."""
    found, every = set(), shingles(text)
    for name, template in templates:
        of = set(template)
        stride = max(1, len(of) // 4)
        for start in range(0, max(1, len(every)), stride):
            window = set(every[start : start + len(template) + stride - 1])
            if 100 * len(window & of) >= licenses.SHARE * len(of):
                found.add(name)
                break
    return sorted(found)


def test_every_template_whole_worn_and_cut_as_a_plain_scan_finds_it(spark):
    rng = random.Random(8)
    known = [(n, t) for n, ts in licenses.defaults().items() for t in ts]
    prose = lambda n: " ".join(rng.choices(("river", "stone", "of", "the", "license", "and", "software", "without"), k=n))

    def worn(text, share):
        return " ".join(w if rng.random() >= share else "altered" for w in text.split(" "))

    texts = {}
    for i, (_, template) in enumerate(known):
        words = template.split(" ")
        texts[10 * i] = f"{prose(rng.randint(0, 90))} {template.upper()} {prose(40)}"
        texts[10 * i + 1] = f"{prose(30)} {worn(template, 0.03)} {prose(7)}"
        texts[10 * i + 2] = " ".join(words[: int(len(words) * rng.uniform(0.7, 0.95))])
        texts[10 * i + 3] = f"{' '.join(words[: len(words) // 2])} {prose(60)} {' '.join(words[len(words) // 2 :])}"
    texts |= {-1: "", -2: None, -3: prose(400), -4: " ".join(t for _, t in rng.sample(known, 12))}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    cut = [(n, shingles(t)) for n, t in known]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(docs).collect()}
    assert got.keys() == texts.keys()
    assert {i: g for i, g in got.items() if g != plain(texts[i] or "", cut)} == {}
    assert all(name in got[10 * i] for i, (name, _) in enumerate(known))
    # the cases are no easy ones: some of the worn and cut texts hold too little
    assert 10 < sum(not got[10 * i + k] for i in range(len(known)) for k in (1, 2, 3)) < 3 * len(known) - 10


def test_names_in_tag_lines(spark):
    cases = {"// SPDX-License-Identifier: MIT\ncode": ["MIT"], "SPDX-License-Identifier:\tgpl-2.0-or-later": ["GPL-2.0"], "SPDX-License-Identifier: (Apache-2.0 OR LGPL-3.0+)": ["Apache-2.0", "LGPL-3.0"],
             "SPDX-License-Identifier: Unknown-1.0": [], "License: MIT": []}
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert {t: r["licenses"] for t, r in zip(cases, licenses.scan(docs).orderBy("doc_id").collect(), strict=True)} == cases
