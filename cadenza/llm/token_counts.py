"""Token counts without ids: each distinct pre-token is counted once and joined to per-document frequencies.

A pre-token here is what stands between safe cuts of a text: single spaces with no white space beside
them. The pre-tokenizer of a byte-level BPE file always cuts there too, so no piece crosses such a cut
and the pieces of a text are those of its pre-tokens. Pre-tokens that are entries of the vocabulary (a
list of fixed size) are looked up at once; for all others, each block of documents sends, to the bucket
of its hash, every distinct pre-token once with the documents and frequencies it has there. A bucket
counts each distinct pre-token once, joins the counts to the frequencies and returns one sum for
each document of each block; a block adds up what its buckets return.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
import zlib
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, documents

LIMIT = 512
#: About so many documents' rare pre-tokens make a bucket.
DOCS_A_BUCKET = 4096
_ODD = re.compile(r"\s | \s|^ | $|^\s|\s$")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_SCHEMA = "bucket long, block long, n int, doc_id array<long>, n_bytes array<long>, base binary, posts binary"


@lru_cache(2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    for text in ("two words", "x1 ,y", "it's a - b", "Zwei  W\u00f6rter\n mehr"):
        whole = t.encode(text, add_special_tokens=False).ids
        if whole != [i for p in pre_tokens(text) for i in t.encode(p, add_special_tokens=False).ids]:
            raise ValueError(f"{path} does not cut at single spaces")
    return t


def pre_tokens(text: str) -> list[str]:
    """The parts of ``text`` between safe cuts; all but the first begin with their space."""
    parts = _CUT.split(text) if _ODD.search(text) else text.split(" ")
    return [parts[0], *map(" ".__add__, parts[1:])]


def pieces(path: str, parts: list[str]) -> np.ndarray:
    """How many ids each part has, counted by the library, a bounded batch at a time."""
    t, out = tokenizer(path), np.zeros(len(parts), np.int64)
    for at in range(0, len(parts), 4096):
        got = t.encode_batch(parts[at : at + 4096], add_special_tokens=False)
        out[at : at + len(got)] = [len(x) for x in got]
    return out


@lru_cache(2)
def known(path: str) -> dict[str, int]:
    """Pieces of the vocabulary's own entries that decode to text; as large as the vocabulary."""
    t = tokenizer(path)
    words = sorted({w for i in range(t.get_vocab_size()) if "�" not in (w := t.decode([i], skip_special_tokens=False)) and w})
    return dict(zip(words, pieces(path, words).tolist(), strict=True))


def _pack(parts: list[str], n_posts, idx, freq) -> bytes:
    raw = [p.encode() for p in parts]
    head = np.array([len(raw), len(idx)], np.uint32)
    body = b"".join([head.tobytes(), np.array([len(r) for r in raw], np.uint32).tobytes(), np.asarray(n_posts, np.uint32).tobytes(), np.asarray(idx, np.uint16).tobytes(), np.asarray(freq, np.uint32).tobytes(), *raw])
    return zstandard.ZstdCompressor(level=1).compress(body)


def _unpack(data: bytes) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(data)
    n, m = (int(x) for x in np.frombuffer(body, np.uint32, 2))
    size = np.frombuffer(body, np.uint32, n, 8)
    posts = np.frombuffer(body, np.uint32, n, 8 + 4 * n)
    idx = np.frombuffer(body, np.uint16, m, 8 + 8 * n)
    freq = np.frombuffer(body, np.uint32, m, 8 + 8 * n + 2 * m)
    ends = (8 + 8 * n + 6 * m + np.cumsum(size, dtype=np.int64)).tolist()
    starts = [8 + 8 * n + 6 * m, *ends[:-1]]
    return [body[a:b].decode() for a, b in zip(starts, ends, strict=True)], posts, idx, freq


def _spread(path: str, n_buckets: int):
    def run(batches):
        from pyspark import TaskContext

        table, block = known(path), TaskContext.get().partitionId() << 32
        for texts, ids in blocks(batches, 2):
            base, held = np.zeros(len(texts), np.int64), {}
            for k, text in enumerate(texts):
                if not text:
                    continue
                for part, n in Counter(pre_tokens(text)).items():
                    if (c := table.get(part)) is not None:
                        base[k] += c * n
                    else:
                        held.setdefault(part, []).append((k, n))
            yield _rows([(-1 - block, block, len(texts), ids, [len((t or "").encode()) for t in texts], base.tobytes(), None)])
            by: dict[int, list[str]] = {}
            for part in held:
                by.setdefault(zlib.crc32(part.encode()) % n_buckets, []).append(part)
            for bucket, parts in by.items():
                posts = [held[p] for p in parts]
                flat = np.array([x for p in posts for x in p], np.int64).reshape(-1, 2)
                yield _rows([(bucket, block, len(texts), None, None, None, _pack(parts, [len(p) for p in posts], flat[:, 0], flat[:, 1]))])
            block += 1

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "block", "n", "doc_id", "n_bytes", "base", "posts"])


def _join(path: str):
    """Rows sorted by bucket: counts each distinct pre-token of a bucket once and gives each block's sums."""

    def flush(held):
        seen: dict[str, int] = {}
        for _, _, data in held:
            for p in _unpack(data)[0]:
                seen.setdefault(p, len(seen))
        count = pieces(path, list(seen))
        for block, n, data in held:
            parts, posts, idx, freq = _unpack(data)
            each = count[np.fromiter(map(seen.__getitem__, parts), np.int64, len(parts))]
            sums = np.bincount(idx, np.repeat(each, posts) * freq.astype(np.float64), n).astype(np.int64)
            yield _rows([(0, block, n, None, None, sums.astype(np.uint32).tobytes() if sums.max(initial=0) < 1 << 31 else sums.tobytes(), None)])

    def run(batches):
        held, bucket = [], None
        for batch in batches:
            for r in batch.to_pylist():
                if r["bucket"] < 0:
                    yield _rows([tuple(r.values())])
                    continue
                if r["bucket"] != bucket:
                    yield from flush(held)
                    held, bucket = [], r["bucket"]
                held.append((r["block"], r["n"], r["posts"]))
        yield from flush(held)

    return run


def _total(limit: int):
    """Rows sorted by block: adds up the sums of a block's buckets."""

    def done(ids, sizes, sums):
        sums = sums if ids else sums[:0]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums), pa.array(sums > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    def run(batches):
        block, ids, sizes, sums = None, [], [], None
        for batch in batches:
            for r in batch.to_pylist():
                if r["block"] != block:
                    if block is not None:
                        yield done(ids, sizes, sums)
                    block, ids, sizes, sums = r["block"], [], [], np.zeros(r["n"], np.int64)
                wide = len(r["base"]) == 8 * r["n"]
                sums += np.frombuffer(r["base"], np.int64 if wide else np.uint32)
                if r["doc_id"] is not None:
                    ids, sizes = r["doc_id"], r["n_bytes"]
        if block is not None:
            yield done(ids, sizes, sums)

    return run


def token_counts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, as the library's ``encode`` counts them.

    path: a byte-level BPE file of the tokenizers library that cuts before single spaces, on every executor; any
    other fails. Null texts are empty and have no tokens; texts of any length are counted whole; repeated rows
    are counted each; other columns are not read; no rows give no rows.
    """
    n = docs.count()
    n_buckets = max(16, -(-n // DOCS_A_BUCKET))
    spread = docs.select(F.col(text_col), F.col(id_col).cast("long")).mapInArrow(_spread(path, n_buckets), _SCHEMA)
    joined = spread.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_join(path), _SCHEMA)
    return joined.repartition("block").sortWithinPartitions("block").mapInArrow(_total(limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Token counts of all documents under one public vocabulary file."""
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path(vocabulary))
