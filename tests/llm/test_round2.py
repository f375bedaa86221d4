"""Clashing names, learned verdicts, the language model's properties, long pre-tokens, repeats in templates, padding."""

import collections
import math
import random
import time
import zlib
from types import SimpleNamespace

import pytest

NAMES = ("n_words", "n_removed", "removed", "spans", "_spans", "_blob", "blob", "salt", "row", "kept", "rule", "host", "path", "verdict", "licenses", "key", "body", "sequence_id", "offset", "rank", "quality", "component_id", "n_links", "score", "label2", "chunk", "keys")
WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "su") for b in ("ren", "tal", "vo", "dis", "pem") for c in ("a", "os", "in", "et")]


def prose(rng, n, words=WORDS):
    return " ".join(rng.choices(words, k=n))


@pytest.fixture(scope="module")
def clashing(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    passage = prose(rng, 30)
    rows = [(i, f"{prose(rng, 30)} {passage if i % 2 else ''} password = hunter2hunter2", "en", "s", 1) for i in range(8)] + [(8, None, None, None, None), (9, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *(F.lit(f"own {n}").alias(n) for n in NAMES))


def test_no_operator_fails_on_clashing_columns(spark, clashing, tmp_path):
    from gridloom.llm import bpe, embeddings, language, licenses, minhash, packing, quality, secrets, substring, urls
    from gridloom.llm.queries import tokenizer
    from pyspark.sql import functions as F

    n = clashing.count()
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    found = substring.dedup(clashing, keep=NAMES)
    assert len(set(found.columns)) == len(found.columns) and {r["_n_words"] for r in found.collect()} == {"own n_words"}
    judged, _ = quality.judge(clashing, labels, keep=("doc_id", *NAMES))
    assert len(set(judged.columns)) == len(judged.columns) and {r["_kept"] for r in judged.collect()} == {"own kept"}
    ledger = secrets.scan(clashing)
    marked = secrets.findings(clashing, ledger).collect()
    assert {r["_blob"] for r in marked} == {"own _blob"} and max(len(r["spans"]) for r in marked) == 1
    hidden = secrets.masked(clashing, ledger)
    assert hidden.columns == clashing.columns and all("hunter2" not in (r["text"] or "") for r in hidden.collect())
    assert licenses.scan(clashing, keep=("doc_id", *NAMES)).count() == n
    pages = clashing.withColumn("page_id", F.col("doc_id")).withColumn("url", F.lit("http://a.com/en/"))
    assert {r["_host"] for r in urls.judge(pages, [urls.Rule("com", "/en/", True)], keep=("page_id", *NAMES)).collect()} == {"own host"}
    assert minhash.near_duplicates(clashing).count() == language.score(clashing).count() == n
    assert bpe.round_trip(clashing, tokenizer("byte_bpe_50k.json")).count() == n
    assert packing.pack(clashing, tokenizer("word_bpe_49k.json")).count() == n
    vectors = clashing.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"), F.lit(1).alias("label"), *(c for c in NAMES if c not in ("label",)))
    assert embeddings.near_duplicates(vectors).where("n_links = 9").count() == n

    import corpus_pipeline

    labels.withColumn("toxic", F.lit(0)).write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing, str(tmp_path))
        assert out.dtypes == clashing.dtypes
        out.collect()


def test_verdict_of_rules_equals_plain_rules(spark):
    from gridloom.llm import quality

    rng = random.Random(9)
    good = [(i, prose(rng, rng.randint(25, 90))) for i in range(120)]
    bad = [(i, " ".join(w if rng.random() < 0.4 else rng.choice(("#$%", "12 34", "LOUD")) for w in prose(rng, 60).split())) for i in range(120, 220)]
    docs = spark.createDataFrame(good + bad + [(220, None), (221, "few words")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(220)], "doc_id long, quality int")
    judged, rules = quality.judge(docs, labels)
    assert rules
    for r in judged.collect():
        value = {k: r[x] / (max(r[y], 1) if y else 1.0) for k, (x, y) in quality.RATIOS.items()}
        fires = [i for i, rule in enumerate(rules) if all((value[t.feature] >= t.value) == t.at_least for t in rule)]
        assert r["rule"] == (fires[0] if fires else None)
        assert r["kept"] == (not r["base_failed"] and not fires)
    assert {r["doc_id"] for r in judged.where("NOT kept").collect()} >= set(range(120, 222))


def test_a_bound_on_labelled_rows_draws_the_same_rows(spark):
    from gridloom.llm import quality
    from pyspark.sql import functions as F

    stats = spark.range(3000).select(F.col("id").alias("doc_id"), *((F.col("id") * 7 + k).alias(s) for k, s in enumerate(quality.STATS)))
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    got = quality.labelled(stats.repartition(7), labels, most=200)
    order = stats.select("doc_id", F.xxhash64(F.lit(7), F.col("doc_id")).alias("h")).orderBy("h").limit(200)
    assert sorted(got[0]["n_words"].tolist()) == sorted(7 * r["doc_id"] for r in order.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    """Two languages whose words follow one another in pairs; a third of the ids are held out or so."""
    rng = random.Random(5)
    one, two = [f"a{i}xe" for i in range(60)], [f"b{i}un" for i in range(60)]
    rows = []
    for i in range(400):
        words = one if i % 2 else two
        text, at = [], rng.randrange(60)
        for _ in range(rng.randint(20, 60)):
            text.append(words[at])
            at = (at * 7 + 3) % 60 if rng.random() < 0.8 else rng.randrange(60)
        rows.append((i, " ".join(text + ([f"new{i}"] if i % 5 == 0 else []))))
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def test_language_model_learns_contexts_and_not_the_layout(corpus):
    from gridloom.llm import language

    docs, rows = corpus
    got = {r["doc_id"]: r for r in language.score(docs.repartition(2)).collect()}
    again = {r["doc_id"]: r["score"] for r in language.score(docs.repartition(5, "text")).collect()}
    assert all(math.isclose(r["score"], again[i], rel_tol=1e-6) for i, r in got.items())
    # held-out texts of known tokens alone: better than the same counts without contexts
    known = [r for r in got.values() if r["held_out"] and r["n_known"] == r["n_tokens"]]
    assert len(known) > 20
    assert sum(r["score"] for r in known) > sum(r["base_score"] for r in known) + 0.2 * sum(r["n_tokens"] for r in known)
    # a text whose words are shuffled is less likely
    rng = random.Random(1)
    shuffled = [(1000 + i, " ".join(rng.sample(t.split(), len(t.split())))) for i, t in rows if zlib.crc32(str(i).encode()) % 7 == 2 and zlib.crc32(str(1000 + i).encode()) % 7 == 2]
    assert shuffled
    more = {r["doc_id"]: r["score"] for r in language.score(docs.unionByName(docs.sparkSession.createDataFrame(shuffled, docs.schema))).collect()}
    assert sum(more[i] for i, _ in shuffled) < sum(more[i - 1000] for i, _ in shuffled)


def test_probabilities_sum_to_one(corpus):
    """After several histories: over the vocabulary, the end and the unknown token."""
    import numpy as np
    import pyarrow as pa
    from gridloom.llm import language

    docs, rows = corpus
    vocabulary = sorted({w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in t.split()})
    known, counts = language.known_chunks(docs)
    w = language.trained(known, counts)
    mask = counts.rows() - 1
    words = [*vocabulary, "unheard", "\n"]
    keys = language.token_keys(pa.array(words))
    total = collections.Counter(x for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for x in [*t.split(), "\n"])
    count = np.array([total[x] for x in words])
    kind = language.class_of_keys(keys, count, counts.total)
    sub = (keys & np.uint64(language.SUBS - 1)).astype(int)
    part = language.part_of(language.short_of(keys)).astype(int)
    for seed in range(5):
        feature = [np.array([h], np.uint64) for h in np.random.default_rng(seed).integers(0, 1 << 62, 3)]

        class One(language.Chunk):
            def __init__(self, k, s=0):
                self.kind, self.sub, self.features = np.array([k], np.uint8), np.array([s], np.uint8), feature

            def chances(self, level):
                return language.chances(w[level], counts.prior[level], self.nodes(level, slice(None)), self.rows(level, slice(None), mask))[0]

        first = One(0).chances(0)
        p = 0.0
        for k, s, q, c in zip(kind, sub, part, count, strict=True):
            inner = One(k).chances(1)[s] * One(k, s).chances(2)[q] if 0 < k < language.RARE else 1.0
            p += first[k] * inner * 10 ** counts.inside(*(np.array([x]) for x in (k, s, q, c)))[0]
        assert math.isclose(p, 1, rel_tol=1e-4)


def test_long_pretokens_merge_as_the_library_does():
    from gridloom.llm.bpe import Bpe
    from gridloom.llm.queries import tokenizer
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    ours, t = Bpe(path), Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    rng = random.Random(1)
    texts = ["a" * n for n in (127, 128, 129, 130, 300, 1001)] + [" " * 700, "=" * 900 + "-" * 333]
    texts += ["".join(rng.choices(letters, k=n)) for n in (129, 257, 600, 3000) for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "aeinrst", "中文") for _ in range(4)]
    texts += ["".join(rng.choices(["the", "tion", "ing", "er", "aaa"], k=900)) for _ in range(4)]
    assert ours.encode(texts) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_template_that_repeats_itself_is_found(spark):
    from gridloom.llm import licenses

    a, b, z = (" ".join(f"{x}{i}" for i in range(40)) for x in "abz")
    template = " ".join([a, *[b] * 6, z])
    docs = spark.createDataFrame([(1, f"{a[:50]} {template} {z}"), (2, f"{a} {b} {b}"), (3, template.upper())], "doc_id long, text string")
    assert {r["doc_id"]: r["licenses"] for r in licenses.scan(docs, {"t": template}).collect()} == {1: ["t"], 2: [], 3: ["t"]}
    with pytest.raises(ValueError):
        licenses.prepared(spark, {"t": "w1 w2 w3 w4 w5 " * 3000})


def test_tokens_in_three_parts():
    from gridloom.llm.secrets import jwt_spans, spans_of

    cases = {"eyJa.eyJb.c": [(0, 11)], "x.eyJb.eyJc.d": [(2, 13)], "eyJ.eyJb.c": [], "zeyJa.eyJb.eyJc.d eyJq.eyJ1.2": [(1, 15), (18, 29)], "eyJa.eyJb. c": [], "eyJa eyJb.eyJc.d": [(5, 16)]}
    assert {t: list(jwt_spans(t)) for t in cases} == cases
    began = time.time()
    spans_of("eyJ" * 300_000)
    spans_of(".eyJa" * 200_000)
    assert time.time() - began < 20


def test_ledger_rows_that_repeat_and_older_versions(spark, tmp_path):
    from gridloom.llm import secrets
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "token = abcdefgh1"), (2, "token = abcdefgh1"), (3, "clean")], "doc_id long, text string")
    path = f"file://{tmp_path}/ledger"
    ledger, first = secrets.update(spark, docs, path)
    ledger.withColumn("rule_version", F.lit("0")).write.parquet(f"{tmp_path}/old")
    both = ledger.unionByName(ledger).unionByName(spark.read.parquet(f"{tmp_path}/old"))
    assert secrets.findings(docs, both).count() == 3 and secrets.scan(docs, both).count() == 0
    assert secrets.scan(docs, spark.read.parquet(f"{tmp_path}/old")).count() == first == 2
    assert secrets.digest(docs, path).where("n_assign = 1").count() == 2


def test_packing_leaves_little_padding(spark):
    from gridloom.llm import packing
    from gridloom.llm.queries import tokenizer

    rng = random.Random(2)
    rows = [(i, prose(rng, int(rng.paretovariate(1.1) * 30) % 6000 + 1)) for i in range(800)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer("word_bpe_49k.json")).collect()
    tokens, sequences = sum(r["length"] for r in got), len({r["sequence_id"] for r in got})
    assert sequences <= math.ceil(tokens / packing.CAPACITY) * 1.03 + 1


def test_components_of_hubs(spark):
    from gridloom.llm.graph import components

    rng = random.Random(8)
    links = [(0, i) for i in range(1, 400)] + [(5000 + i, 5001 + i) for i in range(40)] + [(rng.randrange(6000, 6100), rng.randrange(6000, 6100)) for _ in range(60)] + [(7, 7), (None, 3), (0, 1)]
    root = {x: x for p in links for x in p if x is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a is not None and a != b for x in (a, b)}
    assert {x: got.get(x, x) for x in linked} == {x: find(x) for x in linked}


def test_hot_windows_are_one_documents_in_a_block(spark):
    from gridloom.llm import substring

    shared = " ".join(f"p{i}" for i in range(20))
    docs = spark.createDataFrame([(i, f"{shared} own{i}") for i in range(300)], "doc_id long, text string").coalesce(1)
    blobs = substring.window_blobs(docs, 13, 1).where("hashes IS NOT NULL").collect()
    import zstandard

    held = sum(len(substring.summed(r["hashes"], "<u8", zstandard.ZstdDecompressor().decompress)) for r in blobs)
    assert held < 300 + 20
    assert [r["n_removed"] for r in substring.dedup(docs).orderBy("doc_id").collect()] == [0] + [20] * 299


def test_a_cluster_needs_a_shared_folder():
    from gridloom.llm import shared

    conf = SimpleNamespace(get=lambda *_: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://master:7077", getConf=lambda: conf))
    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(cluster)


def test_stars_keep_components():
    import numpy as np

    from gridloom.llm.graph import stars

    rng = np.random.default_rng(1)
    for _ in range(100):
        n, m = rng.integers(1, 60), rng.integers(0, 80)
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        root = np.arange(n)
        for x, y in zip(a, b, strict=True):
            root[root == max(root[x], root[y])] = min(root[x], root[y])
        u, v = stars(a, b)
        assert dict(zip(u.tolist(), v.tolist(), strict=True)) == {i: r for i, r in enumerate(root.tolist()) if i != r}
