"""Suffix-array dedup: repeated byte strings of a least length, found by interval expansion on a Burrows-Wheeler transform.

A byte is removed if a string of ``MIN_LEN`` bytes that covers it also starts earlier. The table is too
large for one suffix array, so equal strings are first brought together without moving texts: every
window of MIN_LEN bytes is named by the smallest hash of its K-byte strings, and consecutive windows of
one name form a run. Equal windows have equal names, wherever they are. Runs travel as packed numbers
to the bucket of their name; runs that are equal as a whole (by 128 bits of hash over all bytes of their
windows) are copies of one context, of which the earliest stays. Only where a name has runs that
differ, or may repeat within itself, are their bytes fetched, by one shuffle of the texts that the result
uses again; whole names are then gathered to blocks, and each block gets a suffix order and its BWT.
Breadth-first backward extension of intervals finds the common prefixes of neighbours by increasing
value and stops at MIN_LEN: the boundaries that it has not reached by then separate suffixes with
MIN_LEN or more bytes in common. A name with more than ``HOT`` runs, as at the edges of a passage that many
documents share, is split by hashes of its windows over many tasks, where equal bytes are told by comparison.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, documents, fresh, mixed, written

MIN_LEN, K = 100, 32
DOCS_A_BUCKET = 4096
#: Bytes of contexts in a block, and runs of a name, of 168 bytes at most, that one task gathers.
BLOCK_BYTES, HOT = 1_000_000, 2048
_LETTERS = np.random.default_rng(20240229).integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, j: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base j and of its inverse modulo 2**64."""
    if j not in _POWERS or len(_POWERS[j][0]) < n:
        m = max(1 << 17, 1 << n.bit_length())
        _POWERS[j] = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m - 1, x, np.uint64)])) for x in (_BASES[j], pow(_BASES[j], -1, 1 << 64)))
    return _POWERS[j]


def prefix_hashes(b: np.ndarray, j: int = 0) -> np.ndarray:
    """S with (S[j] - S[i]) * base**-i the polynomial hash of b[i:j] modulo 2**64, under one of two bases."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[j][b] * _powers(len(b) + 1, j)[0][: len(b)])])


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        x = f(x[:-done], x[done:])
        done *= 2
    if done < width:
        x = f(x[: len(x) - (width - done)], x[width - done :])
    return x


def runs(texts: list[bytes], min_len: int = MIN_LEN, k: int = K):
    """(doc, lo, windows, name, whole, other, again) of all runs of consecutive windows with one name, as arrays.

    doc: index in ``texts``; lo: first window's start; windows: how many, at most min_len - k + 1; name:
    the smallest hash of k bytes; whole, other: two hashes of all bytes of the windows; again: whether a
    window might occur twice in the run.
    """
    w = min_len - k + 1
    size = np.array([len(t) for t in texts], np.int64)
    b = np.frombuffer(b"".join(texts), np.uint8)
    n = len(b)
    empty = [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64, bool)]
    if n < min_len or size.max() < min_len:
        return empty
    begin = np.cumsum(size) - size
    doc = np.repeat(np.arange(len(texts)), size)
    sums, inverse = prefix_hashes(b), _powers(n + 1)[1]
    h = mixed((sums[k:] - sums[:-k]) * inverse[: n - k + 1])
    m = _sliding(h, w, np.minimum)
    ok = doc[: n - min_len + 1] == doc[min_len - 1 :]
    first = ok & np.r_[True, ~ok[:-1] | (m[1:] != m[:-1])]
    lo = np.flatnonzero(first)
    last = np.flatnonzero(ok & np.r_[first[1:] | ~ok[1:], True])
    count = last - lo + 1
    # how often its name occurs in a run: names' places are those whose hash is the largest of the names of the windows around
    named = np.where(ok, m, np.uint64(0))
    near = _sliding(np.concatenate([np.zeros(w - 1, np.uint64), named, np.zeros(w - 1, np.uint64)]), w, np.maximum)
    places = np.flatnonzero((h == near) & (near > 0))
    change = np.r_[True, (h[places][1:] != h[places][:-1]) | (doc[places][1:] != doc[places][:-1])]
    times = np.diff(np.r_[np.flatnonzero(change), len(places)])
    joint = np.r_[True, (m[lo][1:] != m[lo][:-1]) | (doc[lo][1:] != doc[lo][:-1])]
    again = (times > 1)[np.cumsum(joint) - 1] if len(times) == joint.sum() else np.ones(len(lo), bool)
    # longer runs only occur where a text repeats itself
    parts = -(-count // w)
    if (parts > 1).any():
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        again = np.repeat(again | (parts > 1), parts)
        left = np.repeat(count, parts) - inner * w
        lo = np.repeat(lo, parts) + inner * w
        count = np.minimum(left, w)
    end = lo + count - 1 + min_len
    salt = count.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    more = prefix_hashes(b, 1)
    whole, other = (mixed((x[end] - x[lo]) * y[lo] + salt) for x, y in ((sums, inverse), (more, _powers(n + 1, 1)[1])))
    return [doc[lo], lo - begin[doc[lo]], count, m[lo], whole, other, again]


def suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """Rotations of ``t`` by their first ``depth`` bytes or more, by prefix doubling; only ties are sorted again."""
    n = len(t)
    ext = np.concatenate([t, np.resize(t, 8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | ext[k : k + n]
    order = np.argsort(key)
    key = key[order]
    head = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    h = 8
    while h < depth:
        tied = np.r_[head[1:] == head[:-1], False]
        tied[1:] |= tied[:-1].copy()
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        sub = order[slots]
        key = (rank[sub] << 32) | rank[(sub + h) % n]
        by = np.argsort(key)
        key, sub = key[by], sub[by]
        order[slots] = sub
        new = np.r_[True, key[1:] != key[:-1]]
        head[slots] = np.maximum.accumulate(np.where(new, slots, 0))
        rank[sub] = head[slots]
        h *= 2
    return order


def boundaries(t: np.ndarray, order: np.ndarray, min_len: int) -> np.ndarray:
    """For each place in ``order``: whether the suffix there and the one before have fewer than ``min_len`` bytes in common.

    Intervals of suffixes that begin with a common string are extended backward by one byte at a time, all
    strings of a length before the next length. An interval that ends where no boundary was known sets
    it, and only such intervals are extended further; so each boundary is reached once, by the
    shortest string that ends there.
    """
    n = len(t)
    bwt = t[(order - 1) % n]
    by = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int64)
    step[by] = np.arange(n)
    letter = t[order]
    counts = np.bincount(bwt, minlength=256)
    base = np.cumsum(counts) - counts
    rows_of = {int(c): by[base[c] : base[c] + counts[c]] for c in np.flatnonzero(counts)}
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    lb, re = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(min_len):
        size = re - lb
        one, large = size == 1, size > 256
        got = [(step[lb[one]], step[lb[one]] + 1)]
        if large.any():
            low, high = lb[large], re[large]
            for c, rows in rows_of.items():
                a, z = np.searchsorted(rows, low), np.searchsorted(rows, high)
                has = z > a
                got.append((base[c] + a[has], base[c] + z[has]))
        some = ~one & ~large
        if some.any():
            s, k = size[some], np.arange(some.sum())
            rows = np.repeat(lb[some] - (np.cumsum(s) - s), s) + np.arange(s.sum())
            key = np.sort((np.repeat(k, s) << 32) | step[rows])
            to = key & 0xFFFFFFFF
            new = np.flatnonzero(np.r_[True, (key[1:] >> 32 != key[:-1] >> 32) | (letter[to[1:]] != letter[to[:-1]])])
            got.append((to[new], to[np.r_[new[1:], len(to)] - 1] + 1))
        lb, re = (np.concatenate(x) for x in zip(*got, strict=True))
        fresh = ~known[re]
        lb, re = lb[fresh], re[fresh]
        if not len(lb):
            break
        known[re] = True
    return known[:n]


def repeated(contexts: list[bytes], order_of: np.ndarray, lo: np.ndarray, windows: np.ndarray, min_len: int = MIN_LEN) -> tuple[np.ndarray, np.ndarray]:
    """(context, window) of each window whose string also starts earlier in some context.

    order_of and lo: the place of each context, its document's order and its start there.
    """
    size = np.array([len(c) + 1 for c in contexts], np.int64)
    t = np.frombuffer(b"".join(c + b"\xff" for c in contexts), np.uint8)  # 255 is in no UTF-8 text
    order = suffix_order(t, min_len)
    group = np.cumsum(boundaries(t, order, min_len))
    which = np.repeat(np.arange(len(contexts)), size)
    inner = np.arange(len(t)) - np.repeat(np.cumsum(size) - size, size)
    ctx, at = which[order], inner[order]
    valid = at < windows[ctx]
    ctx, at, group = ctx[valid], at[valid], group[valid]
    return _later(group, ctx, at, order_of, lo)


def _later(group, ctx, at, order_of, lo):
    by = np.lexsort((lo[ctx] + at, order_of[ctx], group))
    later = by[np.r_[False, group[by][1:] == group[by][:-1]]]
    return ctx[later], at[later]


_RUN = "kind int, bucket long, name long, ord long, lo int, windows int, n int, payload binary"
_RUN_NAMES = ["kind", "bucket", "name", "ord", "lo", "windows", "n", "payload"]
_RUN_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]


def _batch(rows: int, /, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(rows, k) for c, k in zip(_RUN_NAMES, _RUN_KINDS, strict=True)], _RUN_NAMES)


def _joined(first, doc, lo, windows):
    """Rows of kind 1, each a stretch of removed windows; runs that follow each other become one."""
    if not len(doc):
        return None
    by = np.lexsort((lo, doc))
    doc, lo, windows = doc[by], lo[by], windows[by]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (lo[1:] != lo[:-1] + windows[:-1])])
    total = np.add.reduceat(windows, new)
    return _batch(len(new), kind=np.ones(len(new), np.int32), bucket=-1 - doc[new] % 1024, ord=doc[new], lo=lo[new].astype(np.int32), windows=total.astype(np.int32))


def _spread(n_buckets: int, min_len: int, k: int):
    """Kind 1: windows that also occur earlier in this block. Kind 2: packed runs of one bucket."""

    def run(batches):
        for texts, ords in blocks(batches, 2):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
            got, at = [], 0
            while at < len(raw):  # a few texts at a time fit the caches
                end, held = at, 0
                while end < len(raw) and (held == 0 or held + len(raw[end]) <= 60_000):
                    held += len(raw[end])
                    end += 1
                part = runs(raw[at:end], min_len, k)
                part[0] += at
                got.append(part)
                at = end
            doc, lo, windows, name, whole, other, again = (np.concatenate(x) for x in zip(*got, strict=True))
            if not len(doc):
                continue
            doc = np.array(ords, np.int64)[doc]
            by = np.lexsort((lo, doc, other, whole, name))
            same = np.r_[False, (name[by][1:] == name[by][:-1]) & (whole[by][1:] == whole[by][:-1]) & (other[by][1:] == other[by][:-1])]
            later = by[same]
            if (b := _joined(None, doc[later], lo[later], windows[later])) is not None:
                yield b
            by = by[~same]
            bucket = (name[by] % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            by, bucket = by[order], bucket[order]
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            ends = np.r_[starts[1:], len(bucket)]
            name, whole, other, doc, lo, flags = name[by], whole[by], other[by], doc[by], lo[by].astype(np.uint32), (windows[by] << 1 | again[by]).astype(np.uint16)
            payload = [b"".join(x[a:b].tobytes() for x in (name, whole, other, doc, lo, flags)) for a, b in zip(starts, ends, strict=True)]
            yield _batch(len(starts), kind=np.full(len(starts), 2, np.int32), bucket=bucket[starts], n=(ends - starts).astype(np.int32), payload=payload)

    return run


def _meet(batches):
    """Rows sorted by bucket: kind 1 as above, kind 3: runs whose bytes must be compared."""

    def flush(held):
        if not held:
            return
        cols = [[] for _ in range(6)]
        for n, p in held:
            at = 0
            for c, t in zip(cols, (np.uint64, np.uint64, np.uint64, np.int64, np.uint32, np.uint16), strict=True):
                c.append(np.frombuffer(p, t, n, at))
                at += n * np.dtype(t).itemsize
        name, whole, other, doc, lo, flags = map(np.concatenate, cols)
        by = np.lexsort((lo, doc, other, whole, name))
        name, whole, other, doc, lo, flags = name[by], whole[by], other[by], doc[by], lo[by].astype(np.int64), flags[by].astype(np.int64)
        same = np.r_[False, (name[1:] == name[:-1]) & (whole[1:] == whole[:-1]) & (other[1:] == other[:-1])]
        if (b := _joined(None, doc[same], lo[same], flags[same] >> 1)) is not None:
            yield b
        name, doc, lo, flags = name[~same], doc[~same], lo[~same], flags[~same]
        alike = name[1:] == name[:-1]
        look = np.r_[False, alike] | np.r_[alike, False] | (flags & 1 == 1)
        n = int(look.sum())
        if n:
            yield _batch(n, kind=np.full(n, 3, np.int32), name=name[look].view(np.int64), ord=doc[look], lo=lo[look].astype(np.int32), windows=(flags[look] >> 1).astype(np.int32))

    held, last = [], None
    for batch in batches:
        if batch.num_rows and batch.column(1)[batch.num_rows - 1].as_py() < 0:
            yield batch
            continue
        for r in batch.to_pylist():
            if r["kind"] == 1:
                yield _batch(1, kind=[1], bucket=[r["bucket"]], ord=[r["ord"]], lo=[r["lo"]], windows=[r["windows"]])
                continue
            if r["bucket"] != last:
                yield from flush(held)
                held, last = [], r["bucket"]
            held.append((r["n"], r["payload"]))
    yield from flush(held)


_CONTEXT = pa.schema([("name", pa.int64()), ("ord", pa.int64()), ("lo", pa.int32()), ("windows", pa.int32()), ("context", pa.binary())])


def _split(name: int, windows: int, context: bytes, min_len: int):
    """(name of its own, place, bytes) of each window of a run."""
    s = prefix_hashes(np.frombuffer(context, np.uint8))
    own = mixed((s[min_len : min_len + windows] - s[:windows]) * _powers(windows)[1][:windows] + np.uint64(name & (1 << 64) - 1))
    return [(h, k, context[k : k + min_len]) for k, h in enumerate(own.view(np.int64).tolist())]


def _contexts(text_at: int, min_len: int):
    """Rows of documents, the last columns their number and the runs asked for, to (name, ord, lo, windows, context).

    The windows of hot runs are rows of their own; of those with equal bytes in a batch only the earliest has
    its bytes, and the others, which are removed, have none.
    """

    def run(batches):
        for batch in batches:
            rows, hot = [], {}
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n = part.num_columns
                for text, ord_, asked in zip(*(part.column(c).to_pylist() for c in (text_at, n - 2, n - 1)), strict=True):
                    if not asked:
                        continue
                    raw = text.encode("utf-8", "surrogatepass")
                    for a in asked:
                        lo, w = a["lo"], a["windows"]
                        context = raw[lo : lo + w - 1 + min_len]
                        if not a["hot"]:
                            rows.append((a["name"], ord_, lo, w, context))
                            continue
                        for name, k, window in _split(a["name"], w, context, min_len):
                            place = (ord_, lo + k)
                            first = hot.get((name, window))
                            if first is None or place < first:
                                hot[name, window], place = place, first
                            if place is not None:
                                rows.append((place[0], *place, 1, None))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _CONTEXT.types, strict=True)], schema=_CONTEXT)
                    rows = []
            rows += [(name, *place, 1, window) for (name, window), place in hot.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _CONTEXT.types, strict=True)], schema=_CONTEXT)

    return run


def _compare(min_len: int, block: int):
    """Rows sorted by name, ord and lo: whole names make a block; gives the windows that also start earlier."""

    def out(b):
        return pa.RecordBatch.from_arrays([b.column(c) for c in (3, 4, 5)], ["ord", "lo", "windows"])

    def flush(rows, gone):
        # a context that has its name to itself and one window can't repeat anything
        names = Counter(r[0] for r in rows)
        rows = [r for r in rows if r[3] > 1 or names[r[0]] > 1]
        ords, los, windows = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
        ctx, at = repeated([r[4] for r in rows], ords, los, windows, min_len) if rows else (np.zeros(0, np.int64),) * 2
        more = np.array([r[1:4] for r in gone], np.int64).reshape(-1, 3)
        if (b := _joined(None, np.r_[ords[ctx], more[:, 0]], np.r_[los[ctx] + at, more[:, 1]], np.r_[np.ones(len(ctx), np.int64), more[:, 2]])) is not None:
            yield out(b)

    def run(batches):
        rows, gone, size, last = [], [], 0, None
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[4] is None or rows and r[0] == rows[-1][0] and r[4] == rows[-1][4]:  # equal to an earlier one as a whole
                    gone.append(r)
                    if len(gone) >= 100_000:
                        yield from flush([], gone)
                        gone = []
                    continue
                if r[0] != last:
                    if size >= block:
                        yield from flush(rows, gone)
                        rows, gone, size = [], [], 0
                    last = r[0]
                rows.append(r)
                size += len(r[4])
        if rows or gone:
            yield from flush(rows, gone)

    return run


def _merge(min_len: int):
    """Rows sorted by ord and lo: the maximal removed runs of each document."""

    def out(doc, lo, windows):
        end = lo + windows - 1 + min_len
        change = np.r_[True, doc[1:] != doc[:-1]]
        base = (np.cumsum(change) - 1) << 40
        top = np.maximum.accumulate(base + end)
        new = np.flatnonzero(np.r_[True, (base + lo)[1:] > top[:-1]])
        stop = (top - base)[np.r_[new[1:], len(doc)] - 1]
        at = np.flatnonzero(np.r_[True, doc[new][1:] != doc[new][:-1]])
        offsets = pa.array(np.r_[at, len(new)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (lo[new], stop)]
        return pa.RecordBatch.from_arrays([pa.array(doc[new][at]), *lists], ["ord", "starts", "ends"])

    def run(batches):
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.concatenate([h, c.to_numpy().astype(np.int64)]) for h, c in zip(held, batch.columns, strict=True)]
            cut = np.searchsorted(cols[0], cols[0][-1])
            held = [c[cut:] for c in cols]
            if cut:
                yield out(*(c[:cut] for c in cols))
        if len(held[0]):
            yield out(*held)

    return run


def _removed(rows: DataFrame, text_at: int, min_len: int, k: int, hot: int) -> DataFrame:
    """(ord, starts, ends) of the removed runs, in bytes, of the documents that lose any; the last column of ``rows`` is ord."""
    ord_ = rows.columns[-1]
    n_buckets = max(16, math.ceil(rows.count() / DOCS_A_BUCKET))
    texts = rows.select(F.col(rows.columns[text_at]).alias("text"), F.col(ord_).alias("ord"))
    met = texts.mapInArrow(_spread(n_buckets, min_len, k), _RUN).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meet, _RUN)
    met = written(met.drop("bucket", "n", "payload"), "runs")
    differ = met.where("kind = 3").select("name", F.col("ord"), "lo", "windows")
    crowded = written(differ.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select(F.col("name").alias("crowd")), "hot")
    differ = differ.join(crowded, F.col("name") == F.col("crowd"), "left")
    asked_ord, asked = fresh(rows.columns, "asked_ord", "asked")
    wanted = differ.groupBy(F.col("ord").alias(asked_ord)).agg(F.collect_list(F.struct("name", "lo", "windows", F.col("crowd").isNotNull().alias("hot"))).alias(asked))
    # the same columns, hashed by the same number, as `with_spans` joins: one shuffle of the texts serves both
    some = rows.join(wanted, F.col(ord_) == F.col(asked_ord), "left").select(*[c for c in rows.columns if c != ord_], ord_, asked)
    found = some.mapInArrow(_contexts(text_at, min_len), "name long, ord long, lo int, windows int, context binary")
    more = found.repartition("name").sortWithinPartitions("name", "ord", "lo").mapInArrow(_compare(min_len, BLOCK_BYTES), "ord long, lo int, windows int")
    all_ = met.where("kind = 1").select("ord", "lo", "windows").unionAll(more)
    return all_.repartition("ord").sortWithinPartitions("ord", "lo").mapInArrow(_merge(min_len), "ord long, starts array<int>, ends array<int>")


def ordered(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with a long as its last column: the id, if it is there and unique; else a number in the order of (id, hash of the text).

    The column is named ord, with underscores where that name is taken. Null ids come first; rows equal
    in id and text get the same number and count as one document.
    """
    ord_, id_, th, th0 = fresh(docs.columns, "ord", "id", "th", "th0")
    ids = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("_rows"))
    if not ids.where(F.col(id_col).isNull() | (F.col("_rows") > 1)).limit(1).count():
        return docs.withColumn(ord_, F.col(id_col).cast("long"))
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    keys = docs.select(F.col(id_col).alias(id_), text.alias(th)).distinct().orderBy(id_, th)
    keys = written(keys.withColumn(ord_, F.monotonically_increasing_id()), "order")
    return docs.withColumn(th0, text).join(keys, F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(th0) == F.col(th))).select(*docs.columns, ord_)


def _joined_spans(docs: DataFrame, names: list[str], min_len: int, hot: int) -> DataFrame:
    rows = ordered(docs)
    ord_ = rows.columns[-1]
    own, *names = fresh(rows.columns, "own", *names)
    spans = _removed(rows, docs.columns.index("text"), min_len, K, hot).toDF(own, *names)
    return rows.join(spans, F.col(ord_) == F.col(own), "left").select(*docs.columns, *names)


def with_spans(docs: DataFrame, min_len: int = MIN_LEN, hot: int = HOT) -> DataFrame:
    """``docs`` with ``starts`` and ``ends`` of what is removed, in bytes of the text; null where nothing is.

    Columns of those names are replaced, all others stay. Null and empty texts lose nothing; rows equal in
    id and text count as one document and lose the same; a text may be of any length; no rows give no rows.
    """
    return _joined_spans(docs.drop("starts", "ends"), ["starts", "ends"], min_len, hot)


def kept(text: str | None, starts, ends) -> tuple[bytes, int, bytes]:
    """(all bytes, how many are removed, the bytes left) of a text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not starts:
        return raw, 0, raw
    left = b"".join(raw[a:b] for a, b in zip([0, *ends], [*starts, len(raw)], strict=True))
    return raw, len(raw) - len(left), left


def _digest(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            rows = []
            for doc, text, starts, ends in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns), strict=True):
                raw, gone, left = kept(text, starts, ends)
                rows.append((doc, len(raw), gone, len(starts or ()), hashlib.sha256(left).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _strip(text_at: int, schema):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n = part.num_columns
                texts = []
                for text, starts, ends in zip(part.column(text_at).to_pylist(), part.column(n - 2).to_pylist(), part.column(n - 1).to_pylist(), strict=True):
                    texts.append(kept(text, starts, ends)[2].decode("utf-8", "ignore") if starts else text)
                cols = [pa.array(texts, pa.string()) if k == text_at else part.column(k) for k in range(n - 2)]
                yield pa.RecordBatch.from_arrays(cols, part.schema.names[: n - 2])

    return run


def without_repeats(docs: DataFrame, min_len: int = MIN_LEN) -> DataFrame:
    """``docs`` with the repeated bytes of every text removed, and parts of characters at the cuts; other columns, whatever their names, stay.

    Null texts stay null; else as `with_spans`.
    """
    spans = _joined_spans(docs, ["starts", "ends"], min_len, HOT)
    return spans.mapInArrow(_strip(docs.columns.index("text"), docs.schema), docs.schema)


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without strings of 100 bytes that start earlier."""
    rows = with_spans(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "text", "starts", "ends")
    return rows.mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
