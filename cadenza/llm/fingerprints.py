"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the ``K`` smallest distinct 48-bit hashes of a set of shingles. Sketches of parts merge to
the sketch of the whole, and from two sketches follow estimates of resemblance and containment of
their sets and of the number of distinct shingles. Sets smaller than ``K`` are held whole and all
estimates are then exact.

Neighbours in the order of a key are found without a global sort in one task: the key's range is cut at
quantiles that are keys of the table, each part is sorted on its own, and the first row of a part is
also sent, marked, to the part before it.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, documents, word_shingles

K = 256
WIDTH = 5
#: Words of a part; a longer text's sketch is merged from those of its parts.
PART_WORDS = 4096
_BITS = np.uint64(48)
_SPACE = float(1 << 48)


def sketch(words: list[str], hashes: WordHashes, k: int = K, width: int = WIDTH) -> np.ndarray:
    """The k smallest distinct shingle hashes of a list of words, ascending; a long list is worked off in parts that overlap by a shingle."""
    if len(words) > PART_WORDS + width:
        out = np.zeros(0, np.uint64)
        for at in range(0, len(words) - width + 1, PART_WORDS):
            out = merge(out, sketch(words[at : at + PART_WORDS + width - 1], hashes, k, width), k)
        return out
    h = word_shingles(words, hashes, width) >> (np.uint64(64) - _BITS)
    return np.unique(h[: 2 * k])[:k] if len(h) > 2 * k else np.unique(h)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of two sets from their sketches."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """How many distinct shingles the set has; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * _SPACE / float(a[k - 1] + np.uint64(1))


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; two empty sets are alike, an empty set is unlike all others."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k)
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(union))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the first set that is in the second; an empty first set is in every other."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def to_string(a: np.ndarray) -> str:
    """Eight characters a hash; texts with equal sets have equal strings."""
    return base64.b64encode(np.ascontiguousarray(a.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_string(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (2, 0))).view(">u8").ravel().astype(np.uint64)


def _above(key: Column, cuts: list) -> Column:
    """How many of the ascending ``cuts`` are at or below ``key``, by binary search; 0 for null."""
    if not cuts:
        return F.lit(0)
    table, steps = F.array(*map(F.lit, cuts)), []
    step = 1 << (len(cuts).bit_length() - 1)
    while step:
        steps.append(step)
        step //= 2
    found = F.lit(0)
    return F.aggregate(F.array(*map(F.lit, steps)), found, lambda at, s: F.when((at + s <= len(cuts)) & (F.try_element_at(table, at + s) <= key), at + s).otherwise(at))


def with_next_in_part(df: DataFrame, key: str, parts: int) -> DataFrame:
    """``df`` sorted by (``_part``, key, ``_ahead``...) within partitions; rows with ``_ahead`` are the first ones of the part that follows.

    The part that follows the last one is the first. Null keys come first. Ties of the key are sorted
    by the row's other columns by the caller.
    """
    known = df.where(F.col(key).isNotNull()).agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 100_000).alias("q"), F.min(key).alias("low"), F.count(F.when(F.col(key).isNull(), 1)).alias("nulls")).first() if parts > 1 else None
    cuts = sorted(set(known["q"] or [])) if known else []
    nulls = df.where(F.col(key).isNull()).limit(1).count()
    low = None if nulls else (known["low"] if known else df.agg(F.min(key)).first()[0])
    cuts = [c for c in cuts if c != low] if low is not None else cuts
    part = _above(F.col(key), cuts)
    heads = {**{c: i for i, c in enumerate(cuts)}}
    is_head = F.col(key).isin(*heads) if heads else F.lit(False)
    is_low = F.col(key).isNull() if low is None else F.col(key) == F.lit(low)
    at = F.struct(part.cast("int").alias("_part"), F.lit(0).alias("_ahead"))
    copies = F.concat(
        F.array(at),
        F.when(F.coalesce(is_head, F.lit(False)), F.array(F.struct((part - 1).cast("int").alias("_part"), F.lit(1).alias("_ahead")))).otherwise(F.array().cast("array<struct<_part:int,_ahead:int>>")),
        F.when(F.coalesce(is_low, F.lit(False)), F.array(F.struct(F.lit(len(cuts)).alias("_part"), F.lit(2).alias("_ahead")))).otherwise(F.array().cast("array<struct<_part:int,_ahead:int>>")),
    )
    return df.withColumn("_at", F.explode(copies)).select("*", "_at.*").drop("_at")


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by the first as many of ``following``, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _fingerprint(k: int, width: int):
    def one(text, hashes):
        return sketch(text.lower().split(), hashes, k, width)

    def out(rows):
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "in_edited", "n_distinct"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches):
        hashes, last, rows = WordHashes(), None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                for part, ahead, key, text in zip(*(piece.column(c).to_pylist() for c in ("_part", "_ahead", "doc_id", "text")), strict=True):
                    text = text or ""
                    now = one(text, hashes)
                    if last and last[0] == part:
                        _, key0, text0, mine = last
                        new = edited(text0, text)
                        theirs = one(new, hashes)
                        rows.append((key0, len(text0), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), to_string(mine), to_string(theirs), resemblance(mine, theirs, k), resemblance(mine, now, k), containment(mine, theirs, k), distinct(mine, k)))
                    last = None if ahead else (part, key, text, now)
                    if len(rows) >= 500:
                        yield out(rows)
                        rows = []
        if rows:
            yield out(rows)

    return run


def fingerprints(docs: DataFrame, parts: int | None = None, k: int = K, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, in_edited, n_distinct) of every row.

    near_edited and near_next are estimated resemblances, in_edited the estimated share of the text's shingles
    that its edited text has, n_distinct the estimated number of distinct shingles. The next row is that of the next larger (doc_id, text); after the last comes the first, and a single
    row follows itself. Words are lower-cased and split at white space. Null texts are empty; two empty
    sets of shingles are alike (1), an empty one is unlike any other (0) and contained in all (1). Texts of any
    length are sketched whole; other columns are not read; no rows give no rows.
    """
    spark = docs.sparkSession
    parts = parts or 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = with_next_in_part(rows, "doc_id", parts)
    # of rows ahead only the first in order is used, and nothing after it
    return keyed.repartition("_part").sortWithinPartitions("_part", "_ahead", "doc_id", "text").mapInArrow(_fingerprint(k, width), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, in_edited double, n_distinct double")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(documents(spark, sf_dir))
