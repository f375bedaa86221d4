"""Driver queries of the thirteen operators, with production parameters over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import embeddings

    return embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(node, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM reach r JOIN link l ON l.a = r.node),
comp AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN comp ON node = vec_id LEFT JOIN n ON a = vec_id
"""


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import urls

    rules = [urls.Rule("com", "/en/", True), urls.Rule("example.com", "/en/7", False), urls.Rule("net", "/de/", False), urls.Rule("example.net", "/de/8", True), urls.Rule("org", "/es/", True)]
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


OP2_SQL = r"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(h, p, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
best AS (SELECT r, arg_max(h || rules.p, len(h || rules.p)) AS rule, arg_max(verdict, len(h || rules.p)) AS verdict FROM p JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, rules.p) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (r)
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer("word_bpe_49k.json"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    judged, _ = quality.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", *quality.STATS[:5], "base_failed", "kept", "rule")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring

    left = substring.dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
least AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
bad AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, unnest(range(0, 13)) AS j FROM win JOIN least USING (h) WHERE m < doc_id)),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN bad USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language

    return language.score(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    return bpe.round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer("byte_bpe_50k.json"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licenses

    found = licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"))


OP8_SQL = r"""
WITH t(name, text) AS (VALUES ('Apache-2.0', 'Licensed under the Apache License, Version 2.0.'), ('CC-BY-NC-4.0', 'Licensed under CC BY-NC 4.0.'),
  ('GPL-3.0', 'This work is licensed under the GNU General Public License, version 3.'), ('MIT', 'Released under the MIT License.')),
tw AS (SELECT name, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS ws FROM t),
ts AS (SELECT DISTINCT name, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT name, ws, unnest(range(1, len(ws) - 3)) AS i FROM tw)),
tn AS (SELECT name, count(*) AS n, any_value(len(ws)) - 4 AS l, greatest(1, count(*) // 4) AS stride FROM ts JOIN tw USING (name) GROUP BY name),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS ws FROM documents),
ds AS (SELECT doc_id, i - 1 AS i, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
hit AS (SELECT doc_id, name, n, l, stride, i, s FROM ds JOIN ts USING (s) JOIN tn USING (name)),
win AS (SELECT doc_id, name, n, l, s, unnest(range(greatest(0, (i - l - stride) // stride), i // stride + 1)) AS k, i, stride FROM hit),
found AS (SELECT doc_id, name FROM win WHERE i < k * stride + l + stride - 1 GROUP BY doc_id, name, n, k HAVING 100 * count(DISTINCT s) >= 80 * n),
one AS (SELECT doc_id, count(DISTINCT name) AS c, string_agg(DISTINCT name, ',' ORDER BY name) AS l FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(c, 0)::BIGINT AS n_licenses, coalesce(l, '') AS licenses FROM documents LEFT JOIN one USING (doc_id)
"""


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minhash

    return minhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=4)


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM reach r JOIN edge e ON e.a = r.node),
comp AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN comp ON node = doc_id LEFT JOIN size USING (doc_id)
"""


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    return secrets.digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import align

    docs, _ = align.align(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"), digest=True)
    return docs.withColumnRenamed("groups", "groups_sha256")


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import topk

    return topk.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), queries=F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE) for x in embedding] AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.w, c.w)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import fim

    rows = fim.restore(fim.transform(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || doc_id) AS h FROM documents),
r AS (SELECT doc_id, text, units, len(units)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high FROM r),
p AS (SELECT doc_id, text, n, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle, array_to_string(units[high + 1:], '') AS suffix,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""


def queries() -> dict[str, Query]:
    return {"op1_embeddings": op1_embeddings, "op2_urls": op2_urls, "op3_packing": op3_packing, "op4_quality": op4_quality, "op5_substring": op5_substring, "op6_language": op6_language, "op7_bpe": op7_bpe, "op8_licenses": op8_licenses, "op9_minhash": op9_minhash, "op10_secrets": op10_secrets, "op11_align": op11_align, "op12_topk": op12_topk, "op13_fim": op13_fim}


def oracle_sql() -> dict[str, str]:
    return {"op1_embeddings": OP1_SQL, "op2_urls": OP2_SQL, "op5_substring": OP5_SQL, "op8_licenses": OP8_SQL, "op9_minhash": OP9_SQL, "op12_topk": OP12_SQL, "op13_fim": OP13_SQL}
