"""Secret scans over an incremental ledger of blobs.

Each version of each path is addressed by the SHA-256 of its text. A ledger holds, for every pair of
blob and rule version that was ever scanned, the spans found. A scan reads all versions, leaves out the
pairs that the ledger has, scans each remaining blob once, and joins the findings back to all paths that
hold the blob. Copies of a blob are first dropped within each task, so that however often a text occurs,
one copy a task at most is shuffled; in the join back, findings are unique by blob and adaptive
execution splits the paths of a hot blob over several tasks.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, written

RULES_VERSION = "base-1"
BROADCAST_ROWS = 500_000
KINDS = ("assign", "access", "hex")
# Fixed patterns; letters of the keyword in either case, ASCII only.
_KEY = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = re.compile(rf"""(?:{_KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_SPANS = "array<struct<kind:int,start:int,end:int>>"
_HINTS = ("passw", "secret", "token", "api")


def scan(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every secret, by start, then kind; code points, end exclusive.

    Runs of hex digits are maximal, so that those of 16 and more are the leftmost non-overlapping matches
    that pass. A match of the other kinds that is too short still takes its text.
    """
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(0, *m.span()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        found += [(1, *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(2, *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], x[0]))


def _once(batches):
    """Keeps the first row of each blob in this task."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for k, blob in enumerate(batch.column(0).to_pylist()):
            b = bytes.fromhex(blob)
            if b not in seen:
                if len(seen) < 2_000_000:
                    seen.add(b)
                keep.append(k)
        yield batch.take(pa.array(keep, pa.int32()))


def _scan(batches):
    """Rows sorted by blob: scans the first of each."""
    last = None
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part, blobs, spans = batch.slice(at, 512), [], []
            for blob, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if blob != last:
                    blobs.append(blob)
                    spans.append([{"kind": k, "start": a, "end": b} for k, a, b in scan(text)])
                    last = blob
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.string()), pa.array(spans, pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])))], ["blob", "spans"])


def unseen(versions: DataFrame, ledger: DataFrame | None, rules: str = RULES_VERSION) -> DataFrame:
    """New ledger rows (blob, rules, spans) for all blobs of ``versions`` (text) that ``ledger`` lacks under these rules; blobs without findings have rows too."""
    blobs = versions.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_once, "blob string, text string")
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rules") == rules).select("blob"), "blob", "left_anti")
    return blobs.repartition("blob").sortWithinPartitions("blob").mapInArrow(_scan, f"blob string, spans {_SPANS}").select("blob", F.lit(rules).alias("rules"), "spans")


def findings(versions: DataFrame, ledger: DataFrame | None = None, rules: str = RULES_VERSION) -> DataFrame:
    """(blob, spans) of all blobs of ``versions`` in which something was found now or, by the ledger, before.

    Written to the shared folder, so its size is known: up to ``BROADCAST_ROWS`` rows it is marked for a
    broadcast, beyond that it is joined by a shuffle whose hot blobs adaptive execution splits.
    """
    new = unseen(versions, ledger, rules).where(F.size("spans") > 0).select("blob", "spans")
    if ledger is not None:
        new = new.unionByName(ledger.where((F.col("rules") == rules) & (F.size("spans") > 0)).select("blob", "spans"))
    new = written(new, "findings")
    return F.broadcast(new) if new.count() <= BROADCAST_ROWS else new


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules: str = RULES_VERSION) -> DataFrame:
    """``versions`` (any columns, with text) with ``blob`` and ``spans`` of every row, null texts taken as empty.

    ledger: what earlier scans returned through `unseen`; None for the first scan. Columns named blob or
    spans are replaced. Repeated rows each get the findings; texts of any length are scanned whole; no rows
    give no rows.
    """
    paths = versions.drop("spans").withColumn("blob", F.sha2(F.coalesce("text", F.lit("")), 256))
    return paths.join(findings(versions, ledger, rules), "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(_SPANS)))


def scan_increment(versions: DataFrame, ledger_path: str, rules: str = RULES_VERSION) -> DataFrame:
    """`scan_versions` against the ledger at ``ledger_path``, a folder of Parquet that is made by the first call.

    Blobs of ``versions`` that the ledger lacks under these rules are scanned once; their rows, with or without
    findings, are added to it, and all paths are joined with what it then holds. A call that fails has added all
    of its rows or none; calls at the same time may add a blob twice, which changes no result.
    """
    spark = versions.sparkSession
    schema = f"blob string, rules string, spans {_SPANS}"
    known = spark.read.schema(schema).parquet(ledger_path) if _there(spark, ledger_path) else None
    unseen(versions, known, rules).write.mode("append").parquet(ledger_path)
    return scan_known(versions, spark.read.schema(schema).parquet(ledger_path), rules)


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def scan_known(versions: DataFrame, ledger: DataFrame, rules: str = RULES_VERSION) -> DataFrame:
    """``versions`` with ``blob`` and ``spans``, all from a ledger that holds every blob of theirs; nothing is scanned."""
    paths = versions.drop("blob", "spans").withColumn("blob", F.sha2(F.coalesce("text", F.lit("")), 256))
    found = ledger.where((F.col("rules") == rules) & (F.size("spans") > 0)).groupBy("blob").agg(F.first("spans").alias("spans"))
    return paths.join(found, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(_SPANS)))


def digest(spans) -> object:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _redact(batches):
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            if spans:
                out, at = [], 0
                for s in spans:
                    if s["start"] >= at:
                        out += [text[at : s["start"]], f"<{KINDS[s['kind']]}>"]
                    at = max(at, s["end"])
                text = "".join([*out, text[at:]])
            texts.append(text)
        k = batch.schema.get_field_index("text")
        yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))


def redact(scanned: DataFrame) -> DataFrame:
    """Rows of `scan_versions` with each run of overlapping spans replaced by the name of its first kind."""
    return scanned.mapInArrow(_redact, scanned.schema)


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, from an empty ledger."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    blob = F.sha2(F.coalesce("text", F.lit("")), 256)
    # only ids and addresses take part in the join; the texts stay behind
    found = docs.select("doc_id", blob.alias("blob")).join(findings(docs), "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(_SPANS)))
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    text = digest(F.col("spans"))
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))
