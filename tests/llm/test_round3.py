"""Alignment of tokenizers, top-k search and fill-in-middle against plain versions."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.test_operators import LONG, PASSAGE, by_id

TEXTS = [
    None, "", " ", "\n", "a", "  two  spaces ", PASSAGE, PASSAGE, PASSAGE + "\nmore\n\n", LONG, "x" * 5000, "line\n" * 2000, "no end\nof line", "\r\n   ",
    "café 中文 \U0001f600́ naïve", "<s> </s> <unk> <|endoftext|> <0x0A>", "under▁score", "�\u0000\u0001", "<P>", "a<S>b", "<M", "<P\n<S\n<M\n", "\n\n<\n",
]
TEXTS = [t for t in TEXTS if t is None or "\u0000" not in t] + ["".join(random.Random(i).choices("ab \né中\U0001f600.'", k=200)) for i in range(20)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "f", 1, "k") for i, t in enumerate(TEXTS)] + [(None, PASSAGE, None, None, None), (6, PASSAGE, "again", 2, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, form string, n_a long, chunk string").repartition(3)


def plain_alignment(texts):
    """Tokens, groups and links of each text by two pointers, one token at a time; counts over all texts."""
    import sentencepiece
    from gridloom.llm.queries import tokenizer
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    t.no_truncation()
    t.no_padding()
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    chars = {}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    for b in range(256):
        chars[chr(b) if b in plain else chr(256 + sum(x not in plain for x in range(b)))] = b
    out = []
    for text in texts:
        want = (" " + (text or "")).encode()
        a = t.encode(" " + (text or ""), add_special_tokens=False)
        a = [(i, len(bytes(chars[c] for c in s)), bytes(chars[c] for c in s)) for i, s in zip(a.ids, a.tokens, strict=True)]
        b = []
        for i in sp.encode(text or ""):
            s = sp.id_to_piece(i)
            raw = bytes([int(s[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", s) else s.replace("▁", " ").encode()
            b.append((i, len(raw), raw))
        if not text or any(b"".join(x[2] for x in side) != want for side in (a, b)):
            out.append((0, 0, "", []))
            continue
        groups, links, i, j, end_a, end_b, one, two = [], [], 0, 0, a[0][1], b[0][1], [a[0][0]], [b[0][0]]
        while True:
            links.append((a[i][0], b[j][0]))
            if end_a == end_b:
                groups.append(f"{','.join(map(str, one))}|{','.join(map(str, two))}")
                if (i := i + 1) == len(a):
                    break
                j, one, two = j + 1, [a[i][0]], [b[j + 1][0]]
                end_a, end_b = end_a + a[i][1], end_b + b[j][1]
            elif end_a < end_b:
                i += 1
                end_a += a[i][1]
                one.append(a[i][0])
            else:
                j += 1
                end_b += b[j][1]
                two.append(b[j][0])
        out.append((len(a), len(b), ";".join(groups), links))
    return out


def test_alignment_by_two_pointers(docs):
    from gridloom.llm import align
    from gridloom.llm.queries import tokenizer

    texts = [*TEXTS, PASSAGE, PASSAGE]
    plain = plain_alignment(texts)
    count = collections.Counter(p for *_, links in plain for p in set(links))
    most = [collections.Counter(), collections.Counter()]
    for p, n in count.items():
        for side, m in enumerate(most):
            m[p[side]] = max(m[p[side]], n)
    paths = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
    for chunk in (align.CHUNK, 50):
        rows, pairs = align.align(docs, *paths, chunk=chunk)
        got = by_id(rows)
        assert {(r["a"], r["b"]): (r["count"], r["most_a"], r["most_b"]) for r in pairs.collect()} == {p: (n, most[0][p[0]], most[1][p[1]]) for p, n in count.items()}
        for i, (n_a, n_b, groups, links) in zip([*range(len(TEXTS)), None, 6], plain, strict=True):
            for r in got[i]:
                best = sum(count[p] == most[0][p[0]] for p in links)
                want = (n_a, n_b, groups.count(";") + 1 if groups else 0, len(links), best, sum(count[p] for p in links), groups)
                assert tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")) == want, i
        assert len(got[6]) == 2
    digest = by_id(align.align(docs, *paths, digest=True)[0])
    assert all(digest[i][0]["groups"] == (hashlib.sha256(p[2].encode()).hexdigest() if p[2] else "") for i, p in enumerate(plain[: len(TEXTS)]))
    assert plain[TEXTS.index("under▁score")][:2] == (0, 0)
    none, no_pairs = align.align(docs.limit(0), *paths)
    assert none.count() == 0 and no_pairs.count() == 0
    assert [tuple(r) for r in align.align(docs.where("doc_id < 2"), *paths)[0].select("n_a", "n_links", "count_sum", "groups").collect()] == [(0, 0, 0, "")] * 2


VECTORS = "vec_id long, embedding array<float>, query_id string, rank int"


def plain_search(rows, k):
    floor = lambda v: [int(np.floor(1024 * np.float64(np.float32(x)))) for x in v]
    usable = [(i, floor(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, w in usable:
        if q % 4 == 0:
            scored = sorted((-sum(x * y for x, y in zip(w, u)), i) for i, u in usable if i != q)  # noqa: B905
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize(("candidates", "block"), [(1 << 16, 1 << 14), (7, 3)])
def test_search_finds_the_same_as_all_pairs(spark, candidates, block):
    from gridloom.llm import topk

    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.9]) for _ in range(6)]) for i in range(60)]
    rows += [(i, [0.5] * 6) for i in range(60, 80)]  # ties
    rows += [(80, None), (84, [None] * 6), (88, [float("nan")] * 6), (92, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (96, []), (97, [1.0, -1.0]), (98, [0.0] * 6), (100, [3.0] * 9), (4, rows[4][1]), (7, rows[7][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], VECTORS).repartition(3)
    for k in (1, 5, 200):
        got = topk.search(df, queries=F.col("vec_id") % 4 == 0, k=k, candidates=candidates, block=block)
        assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == sorted(plain_search(rows, k))
    assert topk.search(df.limit(0), queries=F.col("vec_id") % 4 == 0).count() == 0
    assert topk.search(df, queries=F.lit(None).cast("boolean")).count() == 0
    huge = spark.createDataFrame([(0, [1e30], None, None), (1, [1.0], None, None)], VECTORS)
    assert topk.search(huge, queries=F.col("vec_id") == 1).count() == 1


def test_fill_in_middle_round_trip(docs):
    from gridloom.llm import fim

    got = by_id(fim.restore(fim.transform(docs, keep=("form", "n_a"))))
    forms = collections.Counter()
    for i, text in [*enumerate(TEXTS), (None, PASSAGE)]:
        text = text or ""
        h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
        h1, h2, _, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        p, m, s = ("".join(u) for u in (units[:low], units[low:high], units[high:]))
        form = "plain" if not text or any(x in text for x in fim.MARKS) else "spm" if h4 % 100 < 50 else "psm"
        output = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        forms[form] += 1
        r = got[i][0]
        assert (r["n"], r["form"], r["output"], r["restored"]) == (len(units), form, output, text)
        assert (r["prefix_chars"], r["middle_chars"]) == ((None, None) if form == "plain" else (len(p), len(m)))
        assert {x["_form"] for x in got[i]} == {6: {"f", "again"}, None: {None}}.get(i, {"f"})
    assert min(forms.values()) > 2 and len(got[6]) == 2
    assert fim.transform(docs.limit(0)).count() == 0


def test_fill_in_middle_rates_units_and_marks(spark, docs):
    from gridloom.llm import fim

    assert {r["form"] for r in fim.transform(docs, rate=0).collect()} == {"plain"}
    assert "psm" not in {r["form"] for r in fim.transform(docs, spm_rate=100).collect()}
    texts = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two  three "), "id").alias("text"))
    rows = fim.restore(fim.transform(texts, unit=r"\S+\s*", marks=("[a]", "[b]", "[c]"), rate=50, keep=("text",)), marks=("[a]", "[b]", "[c]")).collect()
    assert all(r["restored"] == r["text"] and r["n"] == 4 for r in rows) and 120 < sum(r["form"] == "plain" for r in rows) < 280
    for marks in (("<P>", "<S>", "<S>x"), ("aba", "<S>", "<M>"), ("<P>", "", "<M>"), ("ab", "bc", "x"), ("<P>", "<P>", "<M>")):
        with pytest.raises(ValueError, match="marks"):
            fim.transform(texts, marks=marks)


def closure(n, links):
    root = list(range(n))
    for _ in range(n):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_embedding_buckets_in_blocks_lose_no_link(spark):
    from gridloom.llm import embeddings

    rng = np.random.default_rng(4)
    rows = []
    for f in range(6):
        centre = rng.standard_normal(24)
        rows += [(centre + 0.06 * rng.standard_normal(24) * (i % 4)).astype(np.float32) for i in range(12)]
    labels = ["a", "b", "b"]
    df = spark.createDataFrame([(i, v.tolist(), labels[i % 3]) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, label string")
    x = np.array(rows, np.float64)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    cosine = unit @ unit.T
    links = [(i, j) for i in range(len(rows)) for j in range(i) if labels[i % 3] == labels[j % 3] and cosine[i, j] >= 0.98]
    count = collections.Counter(i for pair in links for i in pair)
    for block in (3, 1024):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df, block=block).collect()}
        assert got == {i: (count[i], root) for i, root in enumerate(closure(len(rows), links))} and len(links) > 50


def test_more_directions_and_tables_for_large_labels_lose_no_link(spark, monkeypatch):
    """With PAIR made large, a label of a few hundred vectors is hashed as one of millions is."""
    from gridloom.llm import embeddings

    rng = np.random.default_rng(11)
    rows = []
    for _ in range(40):
        centre = rng.standard_normal(32)
        rows += [(centre + 0.05 * rng.standard_normal(32) * (i % 5)).tolist() for i in range(10)]
    x = np.array(rows)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    cosine = unit @ unit.T
    links = [(i, j) for i in range(len(rows)) for j in range(i) if cosine[i, j] >= 0.98]
    count = collections.Counter(i for pair in links for i in pair)
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(embeddings, "PAIR", 1e4)
    monkeypatch.setattr(embeddings, "CELLS", 3_000)
    assert embeddings.sizes(len(rows), 0.98)[1] > 11
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df).collect()}
    assert got == {i: (count[i], root) for i, root in enumerate(closure(len(rows), links))} and len(links) > 500
    with pytest.raises(ValueError):
        embeddings.near_duplicates(df, threshold=0.3)


def test_candidates_level_off_and_recall_stays(monkeypatch):
    from gridloom.llm import embeddings

    assert embeddings.sizes(1_000, 0.98) == (28, 8)
    for n in (10**5, 10**7, 10**9, 10**11):
        tables, directions = embeddings.sizes(n, 0.98)
        near, far = embeddings.same_cell(0.2), embeddings.same_cell(2**0.5)
        assert n * far**directions < 0.4 and (1 - near**directions) ** tables <= embeddings.MISS
        assert tables < 28 * (n / 10_000) ** 0.155 / near  # one direction of rounding
    monkeypatch.setattr(embeddings, "PAIR", 20.0)
    rng = np.random.default_rng(2)
    met, recall = [], []
    for n in (4_000, 16_000):
        shape = embeddings.sizes(n, 0.98)
        unit = embeddings.normal(rng.standard_normal((n, 64)))
        keys = embeddings.bucket_keys(unit, np.zeros(n, np.uint64), *shape)
        met.append(1 / shape[0] * sum(int((np.unique(keys[:, t], return_counts=True)[1] ** 2).sum()) - n for t in range(shape[0])) / n)
        side = rng.standard_normal((n, 64))
        side = embeddings.normal(side - (side * unit).sum(1, keepdims=True) * unit)
        other = 0.98 * unit + (1 - 0.98**2) ** 0.5 * side
        recall.append((keys == embeddings.bucket_keys(other, np.zeros(n, np.uint64), *shape)).any(1).mean())
    assert max(met) < 0.05 and min(recall) > 0.995, (met, recall)  # of each table


def test_vectors_of_two_lengths_in_one_bucket(spark):
    from gridloom.llm import embeddings

    vec = lambda *x: np.array(x, np.float64).tobytes()
    rows = [(7, 0, -1, 0, i, 1, 1, v, [0] * 28) for i, v in enumerate([vec(1, 0), vec(1, 0, 0), vec(1, 0.01), vec(1, 0.01, 0), vec(1)])]
    members = spark.createDataFrame(rows, "key long, pair long, side int, tab int, rep long, label long, n long, vec binary, keys array<long>").repartition(1)
    found = embeddings.compared(members, 0.98).collect()
    assert sorted((r["a"], r["b"]) for r in found if r["b"] is not None) == [(2, 0), (3, 1)]
    assert sorted((r["a"], r["links"]) for r in found if r["b"] is None) == [(0, 1), (1, 1), (2, 1), (3, 1)]


def test_minhash_hot_buckets_and_families_in_blocks(spark, monkeypatch):
    from gridloom.llm import minhash

    r = random.Random(8)
    texts = []
    for f in range(5):
        words = [f"f{f}w{k}" for k in range(80)]
        for i in range(14):
            own = list(words)
            for _ in range(i % 5):
                own[r.randrange(80)] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(own))
    sets = [{tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    monkeypatch.setattr(minhash, "FAMILY", 3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = dict(enumerate(closure(len(texts), links)))
    for hot in (6, 20_000):
        assert {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(df, n=4, hot=hot).collect()} == want
    assert 5 < len(set(want.values())) < len(texts)


def test_history_tells_words_of_one_class_and_ending_apart(spark):
    """Words of equal counts and endings follow one another in a fixed order: only parts can learn it."""
    from gridloom.llm import language

    words = [f"{x}{y}ing" for x in "bdfgklmn" for y in "aeio"]
    r = random.Random(3)
    after = dict(zip(words, words[1:] + words[:1], strict=True))
    rows = []
    for i in range(400):
        w = r.choice(words)
        text = [w]
        for _ in range(39):
            w = after[w]
            text.append(w)
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = language.score(df).where("held_out AND n_known = n_tokens").collect()
    n = sum(x["n_tokens"] for x in got)
    assert n > 1_000
    mean, base = (sum(x[c] for x in got) / n for c in ("score", "base_score"))
    flat = {x["doc_id"]: x["score"] for x in language.score(df, rounds=0).collect()}
    assert mean > base + 0.4 and mean > sum(flat[x["doc_id"]] for x in got) / n + 0.4, (mean, base)
