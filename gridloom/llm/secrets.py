"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every text is addressed by the SHA-256 of its bytes. The ledger holds one row for each (blob, rule
version) that was ever scanned, with the spans found. A run scans only pairs that the ledger lacks, appends them, and
joins the findings back to all paths that hold the blob.

Copies are dropped inside each map task before the blobs are shuffled by their address, so a text that a third of all
rows share crosses the network once a task; blobs travel compressed.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import bounded_batches, deal, dropped, own_names, shared_dir, stored
from .text import slices

#: A private key from its BEGIN line to the next END line, if no other BEGIN comes first; else over header fields and
#: base64: long runs wherever they are, short ones if padded or alone in a line. Newlines may be escaped, lines quoted.
PEM = re.compile(
    r"""-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----
    (?:
        [^-]*+(?:-(?!----(?:BEGIN|END)\x20)[^-]*+)*+-----END\x20[A-Z\x20]*PRIVATE\x20KEY-----
    |
        (?:(?:\s|\\[rn])*+[A-Za-z][A-Za-z0-9-]*+:[^\n\\]*+)*+
        (?:(?:[\s"'>#*|,;]|\\[rnt])*+[A-Za-z0-9+/]{16,}+={0,2}|(?:\r?\n|\\n)[ \t]*+[A-Za-z0-9+/]++={0,2}(?=[ \t\r"',;]*+(?:\n|\\n|\Z))|\s++[A-Za-z0-9+/]++={1,2})++
    )?+""",
    re.VERBOSE,
)
#: Kinds in the order in which spans with one start are listed; the pattern, and what a match must satisfy.
RULES = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), lambda m: len(m[2]) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), None),  # the same as runs of any length of which the shorter are dropped
    ("pem", PEM, None),
)
#: The middle part of a signed token, before its last; the first is sought backwards from there, so that each letter is
#: read a bounded number of times.
JWT_MIDDLE, JWT_LETTERS = re.compile(r"\.eyJ[A-Za-z0-9_-]++(?=\.[A-Za-z0-9_-])"), re.compile(r"[A-Za-z0-9_-]*+")
KINDS = ("assign", "access", "hex", "jwt", "pem")
BASE_KINDS = ("assign", "access", "hex")
#: Changes whenever RULES does: pairs of a blob and an older version are scanned anew.
RULE_VERSION = "3"
LEDGER = "blob string, rule_version string, spans array<struct<start:int,end:int,kind:string>>"
#: Texts gathered at a time by the task that scans, and bytes of compressed blobs by the one that reads.
HELD = 4 << 20
#: Keys over which the copies of a blob are dealt.
SALTS = 16


def jwt_spans(text: str) -> Iterator[tuple[int, int]]:
    """eyJ and letters, a dot, eyJ and letters, a dot, letters: from the first eyJ of the first part."""
    at = 0
    for m in JWT_MIDDLE.finditer(text):
        if m.start() < at:
            continue
        # token letters back to a sign or to the end of the last span; stretches between dots never overlap
        head = text[max(at, text.rfind(".", at, m.start()) + 1) : m.start()]
        head = JWT_LETTERS.match(head[::-1])[0][::-1]
        start = head.find("eyJ")
        if 0 <= start < len(head) - 3:
            at = JWT_LETTERS.match(text, m.end() + 1).end()
            yield m.start() - len(head) + start, at


def spans_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each finding, in code points, by start and then kind as listed."""
    found = []
    for kind, pattern, holds in RULES:
        order = KINDS.index(kind)
        found += [(m.start(), order, m.end(), kind) for m in pattern.finditer(text) if holds is None or holds(m)]
    found += [(a, KINDS.index("jwt"), b, "jwt") for a, b in jwt_spans(text)]
    return [(a, b, kind) for a, _, b, kind in sorted(found)]


def blobs_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (blob, body): the address and the compressed bytes of each text, once for each map task at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part in slices(batch, "_text", HELD):
                names, bodies = [], []
                for body in pc.fill_null(part.column(0), "").cast(pa.binary()).to_pylist():
                    name = hashlib.sha256(body)
                    if name.digest() not in seen:
                        seen.add(name.digest())
                        names.append(name.hexdigest())
                        bodies.append(pack(body))
                if len(seen) > 1_000_000:  # bounded; the scanning side drops what comes twice
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.binary())], ["blob", "body"])

    return docs.select(docs[text_col].alias("_text")).mapInArrow(run, "blob string, body binary")


def scanned(blobs: DataFrame) -> DataFrame:
    """Ledger rows of blobs that are dealt by their address: each blob is scanned once."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()  # addresses of one shuffle partition
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            names, spans = [], []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if name not in seen:
                    seen.add(name)
                    names.append(name)
                    spans.append([{"start": a, "end": b, "kind": k} for a, b, k in spans_of(unpack(body.as_buffer()).decode())])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([RULE_VERSION] * len(names), pa.string()), pa.array(spans, span)], ["blob", "rule_version", "spans"])

    return blobs.mapInArrow(run, LEDGER)


#: Unseen addresses that are broadcast, of 64 characters each; beyond that their join is a shuffle.
MOST_ADDRESSES = 100_000


def address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan(docs: DataFrame, ledger: DataFrame | None = None, *, text_col: str = "text") -> DataFrame:
    """New ledger rows: of all blobs in docs of which `ledger` has no row with the present rule version.

    docs: one row for each version of each path. Null text counts as the empty one. Written once in the shared folder.
    With a ledger, addresses alone are compared first; only bodies of unseen blobs go on.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(docs[text_col].alias("text"))
    unseen = None
    if ledger is not None:
        keyed = docs.withColumn("_blob", address(F.col("text")))
        seen = ledger.where(F.col("rule_version") == RULE_VERSION).select(F.col("blob").alias("_blob"))
        unseen = stored(keyed.select("_blob").distinct().join(seen, "_blob", "left_anti"), "unseen")
        side = F.broadcast(unseen) if unseen.count() <= MOST_ADDRESSES else unseen
        docs = keyed.join(side, "_blob", "left_semi")
    new = stored(scanned(blobs_of(docs).repartition(deal(spark), "blob")), "ledger")
    if unseen is not None:
        dropped(unseen)
    return new


def update(spark: SparkSession, docs: DataFrame, path: str | None = None, *, text_col: str = "text") -> tuple[DataFrame, int]:
    """Brings the ledger at `path` (a Parquet folder, made if absent) up to date; the whole ledger and the number of new rows."""
    path = path or f"{shared_dir(spark)}/gridloom/secret-ledger"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    new = scan(docs, spark.read.schema(LEDGER).parquet(path) if exists else None, text_col=text_col)
    count = new.count()
    new.write.mode("append").parquet(path)
    dropped(new)
    return spark.read.schema(LEDGER).parquet(path), count


def fresh_ledger(spark: SparkSession) -> str:
    """The path of a ledger that nobody has written yet, in the shared folder."""
    return f"{shared_dir(spark)}/gridloom/secret-ledger-{uuid.uuid4().hex}"


def found_in(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """rows (row, text) with `spans`, an array of (start, end, kind); empty where nothing was found.

    Only blobs with findings are joined, each once: that side is small, while copies of one blob can be many. Copies of a
    blob are dealt over SALTS keys, and its findings go to each.
    """
    empty = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    found = ledger.where((F.col("rule_version") == RULE_VERSION) & (F.size("spans") > 0)).groupBy("blob").agg(F.first("spans").alias("spans"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    found = found.select("blob", "spans", salts.alias("salt"))
    keyed = rows.withColumn("blob", address(F.col("text"))).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return keyed.join(found, ["blob", "salt"], "left").select("row", "text", F.coalesce("spans", empty).alias("spans"))


def findings(docs: DataFrame, ledger: DataFrame, *, text_col: str = "text") -> DataFrame:
    """All rows and columns of docs with `spans`, an array of (start, end, kind); empty where nothing was found.

    A column of docs that is named spans comes back as _spans. An empty table gives no rows.
    """
    rows = docs.select(F.struct(*(docs[c].alias(n) for c, n in zip(docs.columns, own_names(docs.columns, ["spans"]), strict=True))).alias("row"), docs[text_col].alias("text"))
    return found_in(rows, ledger).select("row.*", "spans")


def listed(spans, kinds: tuple[str, ...] | None = None):
    """kind:start:end of spans (of some kinds), comma-joined, as a Column."""
    some = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each row of docs (doc_id, text).

    The ledger at the path `ledger` is brought up to date and joined back; without a path it is a new one. Null or empty
    text: no findings. Very long texts are scanned whole. Repeated rows give a row each; an empty table gives none; further
    columns are not read.
    """
    spark = docs.sparkSession
    known, _ = update(spark, docs.select("text"), ledger or fresh_ledger(spark))
    found = found_in(docs.select(F.struct("doc_id").alias("row"), "text"), known)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("row.doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(listed(F.col("spans"), BASE_KINDS).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def masked(docs: DataFrame, ledger: DataFrame, *, mask: str = "[secret]") -> DataFrame:
    """docs with every finding in `text` replaced by mask; overlapping findings are replaced together.

    Null texts stay null. Columns may have any names; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    others = [c for c in docs.columns if c != "text"]
    found = found_in(docs.select(F.struct(*(docs[c].alias(f"c{i}") for i, c in enumerate(others))).alias("row") if others else F.struct(F.lit(0)).alias("row"), "text"), ledger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            if pc.sum(pc.list_value_length(batch.column("spans"))).as_py():
                texts = pa.array([cut(t, s) for t, s in zip(texts.to_pylist(), batch.column("spans").to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row"), texts], ["row", "text"])

    def cut(text: str | None, spans: list[dict]) -> str | None:
        out, at = [], 0
        for s in spans or []:
            if s["start"] >= at:
                out += [text[at : s["start"]], mask]
            at = max(at, s["end"])
        return text if not spans else "".join(out) + text[at:]

    done = found.mapInArrow(run, f"row {found.schema['row'].dataType.simpleString()}, text string")
    return done.select(*(F.col("text") if c == "text" else F.col(f"row.c{others.index(c)}").alias(c) for c in docs.columns))
