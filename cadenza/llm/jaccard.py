"""N-gram Jaccard join by prefix filters under several global token orders.

A document's tokens are the hashes of its distinct 5-word shingles. Two sets with similarity t or more
share a token among the first |x| - ceil(t |x|) + 1 of each, under any global order of the tokens. Each
order here puts tokens by how many documents hold them, rare ones first, and by a hash of its own among
those that are about equally rare, so each order is a filter of its own. How common tokens are is counted
over the whole table, in slots that many rare tokens may share. Under every order a pair must share
enough prefix tokens to reach the overlap it needs even if all tokens behind the prefixes were shared;
only pairs that pass this filter under all orders, with sizes within the ratio, are candidates.

Pairs within a group of many copies are never spelt out: a token with more than ``SPELT`` holders
connects them in a chain by size instead, broken where neighbours are too unlike in size. A similar pair
either shares such a token under some order, and its chain connects it, or shares none, and then its
counts are whole and pass. Components of these links are verified with the exact sets, each on its own;
a document is expanded against all others only while it may still join components. A component too
large for one task is dealt to blocks which all get its largest set: what that set links needs nothing
more, and only documents it leaves loose meet the other blocks. Copies within a block of documents count
as one. What is shuffled: prefixes as packed numbers, forests, and the sets of documents that have a
candidate partner.
"""

from __future__ import annotations

import math
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, blocks, documents, mixed, word_shingles, written
from .components import components, forest

WIDTH, PERCENT, ORDERS = 5, 75, 3
#: The commonest slots of tokens, put by their counts; all other slots have a level. Any choice gives the same results.
FREQUENT = 1 << 18
#: Most bits of a slot, and holders above the slots' mean (and what chance adds to it) that make a slot common.
MOST_BITS, COMMON = 29, 8
#: Lists of up to so many holders are spelt out as pairs, longer ones as chains; results are the same.
SPELT = 64
DOCS_A_BUCKET = 4096
#: Tokens that one verification holds at a time.
GROUP_TOKENS = 2_000_000
#: Up to so many candidate keys, of five numbers each, are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 250_000
_SALTS = [np.uint64(s) for s in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)]


class ByteHashes(WordHashes):
    """As `WordHashes`, for words as bytes."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, hashes: ByteHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes; A-Z in lower case, words split at ASCII white space, as bytes.lower and bytes.split do it."""
    return word_shingles((text or "").encode("utf-8", "surrogatepass").lower().split(), hashes, width)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def linked(common, n_a, n_b, percent: int = PERCENT):
    """Whether two sets are similar enough, in whole numbers."""
    return 100 * common >= percent * (n_a + n_b - common)


def _distinct_sets(texts, hashes, width):
    """The sets of a block, with the place of the first equal set for each."""
    sets, first, at = [], {}, []
    for k, text in enumerate(texts):
        s = shingle_set(text, hashes, width)
        sets.append(s)
        at.append(first.setdefault(xxhash.xxh3_128_digest(s), k))
    return sets, at


def _posted_slots(width: int, bits: int, n_ranges: int):
    """(range, n, deltas): how far apart the sorted slots of a block's tokens are, in bytes, for each range of slots."""
    span = (1 << bits) // n_ranges

    def run(batches):
        hashes = ByteHashes()
        for (texts,) in blocks(batches, 1, 16_000_000):
            sets, at = _distinct_sets(texts, hashes, width)
            slots = np.sort((np.concatenate([s for k, s in enumerate(sets) if at[k] == k]) >> np.uint64(64 - bits)).astype(np.uint32))
            cuts = np.searchsorted(slots, np.arange(n_ranges + 1, dtype=np.int64) * span)
            some = [(r, a, b) for r, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if a < b]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in some], pa.int32()), pa.array([b - a for _, a, b in some], pa.int64()), pa.array([deltas(slots[a:b] - np.uint32(r * span)) for r, a, b in some], pa.binary())], ["range", "n", "deltas"])

    return run


def deltas(ascending: np.ndarray) -> bytes:
    """Ascending whole numbers as bytes: a byte of 255 moves on by as much, any other one moves on and gives a number."""
    step = np.diff(ascending, prepend=ascending.dtype.type(0))
    far = (step // 255).astype(np.int64)
    out = np.full(len(step) + int(far.sum()), 255, np.uint8)
    out[np.cumsum(far + 1) - 1] = step % 255
    return out.tobytes()


def undone(packed: bytes) -> np.ndarray:
    """The numbers that `deltas` packed."""
    x = np.frombuffer(packed, np.uint8)
    return np.cumsum(x, dtype=np.int64)[x != 255]


def levels(counts: np.ndarray) -> np.ndarray:
    """0 for counts that chance gives a slot, then 1 to 3 for ever higher ones; four of them to a byte."""
    mean = counts.mean()
    least = mean + 5 * math.sqrt(mean) + COMMON
    level = (counts >= least).astype(np.uint8) + (counts >= mean + 4 * (least - mean)) + (counts >= mean + 16 * (least - mean))
    return level[0::4] | level[1::4] << 2 | level[2::4] << 4 | level[3::4] << 6


def _counted(span: int, most: int):
    """Rows sorted by range to (range, levels, top, n): the levels of its slots, compressed, and its ``most`` commonest ones with their counts."""

    def done(r, counts):
        top = np.argpartition(-counts, most)[:most] if most < span else np.arange(span)
        top = np.sort(top[counts[top] > 1])
        columns = [pa.array([r], pa.int32()), *(pa.array([x], pa.binary()) for x in (zlib.compress(levels(counts).tobytes(), 1), (top + r * span).astype(np.int64).tobytes(), counts[top].astype(np.int64).tobytes()))]
        return pa.RecordBatch.from_arrays(columns, ["range", "levels", "top", "n"])

    def run(batches):
        last, counts, held, size = None, None, [], 0

        def add():
            if held:
                counts[:] += np.bincount(np.concatenate([undone(x) for x in held]), minlength=span)
                held.clear()

        for batch in batches:
            for r, n, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r != last:
                    if last is not None:
                        add()
                        yield done(last, counts)
                    last, counts, size = r, np.zeros(span, np.int64), 0
                held.append(packed)
                size += n
                if size >= 4 * span:
                    add()
                    size = 0
        if last is not None:
            add()
            yield done(last, counts)

    return run


def token_levels(docs: DataFrame, n_docs: int, width: int = WIDTH) -> tuple[int, int, dict[int, bytes], np.ndarray, np.ndarray]:
    """(bits, slots of a range, ranges' levels, commonest slots ascending, their ranks): how common the tokens of each slot are.

    A token's slot is its first bits; there are 64 slots a document or more, up to ``MOST_BITS``. All tokens of all
    documents are counted, so that a passage of a few dozen holders is told from rare tokens in a table of any size.
    Any order of the tokens is right for the join; this one keeps shared passages out of prefixes.
    """
    bits = min(MOST_BITS, max(16, math.ceil(math.log2(64 * max(n_docs, 1)))))
    n_ranges = max(16, (1 << bits) >> 20)
    span = (1 << bits) // n_ranges
    posted = docs.select("text").mapInArrow(_posted_slots(width, bits, n_ranges), "range int, n long, deltas binary")
    got = posted.repartition("range").sortWithinPartitions("range").mapInArrow(_counted(span, FREQUENT // n_ranges), "range int, levels binary, top binary, n binary").collect()
    top, n = (np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r[c], np.int64) for r in got)]) for c in ("top", "n"))
    by = np.lexsort((top, -n))
    rank = np.empty(len(top), np.uint64)
    rank[by] = len(top) - np.arange(len(top), dtype=np.uint64)
    order = np.argsort(top)
    return bits, span, {r["range"]: bytes(r["levels"]) for r in got}, top[order].astype(np.uint64), rank[order]


class Order:
    """The orders of tokens that `token_levels` gives."""

    def __init__(self, bits: int, span: int, packed: dict[int, bytes], heavy: np.ndarray, rank: np.ndarray):
        self.shift, self.heavy, self.rank = np.uint64(64 - bits), heavy, rank
        self.levels = np.zeros((1 << bits) // 4, np.uint8)
        for r, x in packed.items():
            self.levels[r * span // 4 : (r + 1) * span // 4] = np.frombuffer(zlib.decompress(x), np.uint8)

    def heads(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What comes first in the keys of the tokens, and which of them have a rank, and their keys."""
        slots = tokens >> self.shift
        level = self.levels[slots >> np.uint64(2)] >> ((slots & np.uint64(3)) << np.uint64(1)).astype(np.uint8) & np.uint8(3)
        common = np.flatnonzero(level)
        at = np.minimum(np.searchsorted(self.heavy, slots[common]), max(len(self.heavy) - 1, 0))
        hit = self.heavy[at] == slots[common] if len(self.heavy) else np.zeros(len(common), bool)
        return level.astype(np.uint64) << np.uint64(61), common[hit], (np.uint64(1) << np.uint64(63)) | self.rank[at[hit]]

    @staticmethod
    def keys(tokens: np.ndarray, heads, j: int) -> np.ndarray:
        """The keys by which order j puts tokens."""
        head, hit, known = heads
        keys = mixed(tokens ^ _SALTS[j]) >> np.uint64(3) | head
        keys[hit] = known
        return keys


@lru_cache(1)
def _shared_order(key: str, shared) -> Order:
    """One for the tasks of a worker."""
    return Order(*shared.value)


_R = "kind int, bucket long, u long, v long, doc_id long, th long, n int, payload binary"
_NAMES = ["kind", "bucket", "u", "v", "doc_id", "th", "n", "payload"]
_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]


def _batch(columns: list, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)


def _prefixes(key: str, shared, n_buckets: int, orders: int, width: int, percent: int):
    """Kind 0: a document, with its node u. Kind 1 and up: prefix tokens of one bucket and block under an order."""

    def run(batches):
        from pyspark import TaskContext

        order_, hashes, block = _shared_order(key, shared), ByteHashes(), TaskContext.get().partitionId() << 38
        for texts, ids, ths in blocks(batches, 3):
            sets, at = _distinct_sets(texts, hashes, width)
            n = len(sets)
            yield _batch([[0] * n, [-1 - (block >> 16)] * n, [block + k for k in at], [int(k == a) for k, a in enumerate(at)], ids, ths, [len(s) for s in sets], None], n)
            own = [k for k in range(n) if at[k] == k and len(sets[k])]
            sizes = np.array([len(s) for s in sets], np.uint32)
            if own:
                all_ = np.concatenate([sets[k] for k in own])
                heads = order_.heads(all_)
                ends = np.cumsum(sizes[own], dtype=np.int64)
                lengths = [prefix_length(len(sets[k]), percent) for k in own]
            for j in range(orders if own else 0):
                keys = order_.keys(all_, heads, j)
                tokens = np.concatenate([sets[k][np.argpartition(keys[b - len(sets[k]) : b], p - 1)[:p]] if p < len(sets[k]) else sets[k] for k, b, p in zip(own, ends.tolist(), lengths, strict=True)])
                who = np.repeat(np.array(own, np.uint16), lengths)
                bucket = (tokens % np.uint64(n_buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                tokens, who, bucket = tokens[order], who[order], bucket[order]
                starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                stops = np.r_[starts[1:], len(bucket)]
                yield _batch([[1 + j] * len(starts), bucket[starts] * orders + j, [block] * len(starts), None, None, None, (stops - starts).astype(np.int32), [tokens[a:b].tobytes() + who[a:b].tobytes() + sizes[who[a:b]].tobytes() for a, b in zip(starts, stops, strict=True)]], len(starts))
            block += 1 << 16

    return run


def _meet(batches):
    """Rows sorted by bucket: each distinct list of nodes that hold a prefix token, with their sizes and the number of such tokens (n), by its first node (u); rows of documents pass through."""

    def flush(kind, held):
        tokens = np.concatenate([np.frombuffer(p, np.uint64, n) for _, n, p in held])
        nodes = np.concatenate([np.frombuffer(p, np.uint16, n, 8 * n).astype(np.int64) + b for b, n, p in held])
        sizes = np.concatenate([np.frombuffer(p, np.uint32, n, 10 * n) for _, n, p in held])
        order = np.lexsort((nodes, tokens))
        tokens, nodes, sizes = tokens[order], nodes[order], sizes[order]
        begin = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        count = np.diff(np.r_[begin, len(tokens)])
        begin, count = begin[count > 1], count[count > 1]
        if not len(begin):
            return
        # lists are told apart by the sum of their nodes' hashes
        ends = np.cumsum(np.r_[np.zeros(1, np.uint64), mixed(nodes.astype(np.uint64))])
        _, first, times = np.unique(ends[begin + count] - ends[begin], return_index=True, return_counts=True)
        begin, count = begin[first], count[first]
        for at in range(0, len(begin), 20_000):
            some = list(zip(begin[at : at + 20_000].tolist(), count[at : at + 20_000].tolist(), strict=True))
            yield _batch([[kind] * len(some), None, nodes[begin[at : at + 20_000]], count[at : at + 20_000], None, None, times[at : at + 20_000].astype(np.int32), [nodes[i : i + n].tobytes() + sizes[i : i + n].tobytes() for i, n in some]], len(some))

    held, last = [], None
    for batch in batches:
        if batch.num_rows and batch.column(0)[0].as_py() == 0 and batch.column(0)[batch.num_rows - 1].as_py() == 0:
            yield batch
            continue
        for r in batch.to_pylist():
            if r["kind"] == 0:
                yield _batch([[x] for x in r.values()], 1)
                continue
            if last != (r["kind"], r["bucket"]):
                if held:
                    yield from flush(last[0], held)
                held, last = [], (r["kind"], r["bucket"])
            held.append((r["u"], r["n"], r["payload"]))
    if held:
        yield from flush(last[0], held)


def _pairs(spelt: int, percent: int):
    """Rows sorted by first node: pairs (u, v) with the number of prefix tokens (n) that they share under an order (kind) and their sizes; of longer lists, links with n 0."""

    def out(kind, u, v, n, a, b):
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (kind, u, v, n, a, b)], ["kind", "u", "v", "n", "a", "b"])

    def flush(held, chains):
        parts = []
        for m in {m for _, m, _, _ in held}:
            rows = [(k, w, p) for k, n, w, p in held if n == m]
            nodes = np.array([np.frombuffer(p, np.int64, m) for _, _, p in rows])
            sizes = np.array([np.frombuffer(p, np.uint32, m, 8 * m) for _, _, p in rows]).astype(np.int64)
            if m > spelt:
                by = np.argsort(sizes, axis=1, kind="stable")
                nodes, sizes = np.take_along_axis(nodes, by, 1), np.take_along_axis(sizes, by, 1)
                near = 100 * sizes[:, :-1] >= percent * sizes[:, 1:]
                chains.append((nodes[:, :-1][near], nodes[:, 1:][near]))
                continue
            i, j = np.triu_indices(m, 1)
            a, b = sizes[:, i].ravel(), sizes[:, j].ravel()
            fits = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
            kind, w = (np.repeat(np.array(x), len(i)) for x in list(zip(*rows, strict=True))[:2])
            parts.append([x[fits] for x in (kind, nodes[:, i].ravel(), nodes[:, j].ravel(), w, a, b)])
        if chains:  # a forest of the task's nodes
            chains[:] = [forest(*(np.concatenate(x) for x in zip(*chains, strict=True)))]
        if parts:
            kind, u, v, w, a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((v, u, kind))
            kind, u, v, w, a, b = (x[order] for x in (kind, u, v, w, a, b))
            new = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (u[1:] != u[:-1]) | (v[1:] != v[:-1])][: len(u)])
            if len(new):
                yield out(kind[new], u[new], v[new], np.add.reduceat(w, new), a[new], b[new])

    def run(batches):
        held, pairs, chains = [], 0, []
        for batch in batches:
            for k, m, w, p in zip(*(batch.column(c).to_pylist() for c in ("kind", "v", "n", "payload")), strict=True):
                held.append((k, m, w, p))
                pairs += m * m // 2 if m <= spelt else m
                if pairs >= 1_000_000:
                    yield from flush(held, chains)
                    held, pairs = [], 0
        if held:
            yield from flush(held, chains)
        for u, v in chains:
            none = np.zeros(len(u), np.int64)
            yield out(none, u, v, none, none, none)

    return run


def candidate_links(lists: DataFrame, percent: int = PERCENT, spelt: int = SPELT, orders: int = ORDERS) -> DataFrame:
    """(u, v) of nodes that pass the filters of all orders or follow each other in a chain.

    A pair needs an overlap of percent (a + b) / (100 + percent). All shared tokens up to the nearer end of
    the two prefixes are seen; behind it lie at most as many as that set has behind its prefix.
    """
    found = lists.select("kind", "u", "v", "n", "payload").repartition("u").sortWithinPartitions("u").mapInArrow(_pairs(spelt, percent), "kind long, u long, v long, n long, a long, b long")
    counts = [F.sum(F.when(F.col("kind") == 1 + j, F.col("n")).otherwise(0)).alias(f"n{j}") for j in range(orders)]
    summed = found.groupBy("u", "v").agg(*counts, F.min("n").alias("low"), F.max("a").alias("a"), F.max("b").alias("b"))
    behind = lambda n: F.floor((percent * n + 99) / 100) - 1
    enough = F.ceil(percent * (F.col("a") + F.col("b")) / (100 + percent)) - F.greatest(behind(F.col("a")), behind(F.col("b")))
    least = F.least(*[F.col(f"n{j}") for j in range(orders)], F.lit(1 << 40), F.lit(1 << 40))
    return summed.where((F.col("low") == 0) | (least >= F.greatest(enough, F.lit(1)))).select("u", "v")


def verified(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """The root of each set, an index, over all links between the sets.

    A set is expanded against all others at most once, by the lists of holders of its tokens. Sets of the
    largest component stay unexpanded: copies that one expansion has linked cost nothing more.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    tokens, who = np.concatenate(sets), np.repeat(np.arange(n), size)
    _, code = np.unique(tokens, return_inverse=True)
    order = np.argsort(code, kind="stable")
    holders = who[order]
    ends = np.cumsum(np.bincount(code))
    begins = ends - np.bincount(code)
    places = np.split(code, np.cumsum(size)[:-1])
    root = np.arange(n)
    expanded = np.zeros(n, bool)
    x = int(np.argmax(size))
    while True:
        expanded[x] = True
        spans = places[x]
        if len(spans):
            counts = np.bincount(np.concatenate([holders[a:b] for a, b in zip(begins[spans].tolist(), ends[spans].tolist(), strict=True)]), minlength=n)
            hit = np.flatnonzero(linked(counts, size[x], size, percent) & (counts > 0))
            root[np.isin(root, root[hit])] = root[hit].min()
        # once all sets outside one component are expanded, every link between components has been seen
        main = np.bincount(root, minlength=n).argmax()
        open_ = np.flatnonzero(~expanded & (root != main))
        if not len(open_):
            break
        x = int(open_[0])
    return root


def _verify(percent: int):
    """Of the sets of a group: (u, v, loose) of nodes, v the root of u; loose if there is a pivot that u isn't connected with."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["node"], kind="stable").drop_duplicates("node")
        nodes, pivot = pdf["node"].to_numpy(), np.flatnonzero(pdf["pivot"].to_numpy())
        root = verified([np.frombuffer(x, np.uint64) for x in pdf["tokens"]], percent=percent)
        loose = root != root[pivot[0]] if len(pivot) else np.zeros(len(nodes), bool)
        return pd.DataFrame({"u": nodes, "v": nodes[root], "loose": loose})[(nodes != nodes[root]) | loose]

    return run


def _sets(width: int):
    """(g, parts, pivot, node, text) with the tokens in place of the text."""

    def run(batches):
        hashes = ByteHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t, hashes, width).tobytes() for t in part.column(4).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(sets, pa.binary())], ["g", "parts", "pivot", "node", "tokens"])

    return run


_LINK = "u long, v long, loose boolean"


def _verified_links(sets: DataFrame, large: bool, percent: int) -> DataFrame:
    """(u, v) that connect what is similar within the groups of ``sets`` (g, parts, pivot, node, tokens); large: some group has several parts."""
    if not large:
        keyed = sets.select(F.struct("g").alias("group"), "node", F.lit(False).alias("pivot"), "tokens")
        return written(keyed.groupBy("group").applyInPandas(_verify(percent), _LINK), "forest").select("u", "v")
    sets = written(sets, "sets")
    block = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # the largest set of a group of several parts goes to all of them
    at = F.explode(F.when(F.col("pivot"), every("parts")).otherwise(F.array(block))).alias("at")
    first = sets.select("g", at, "node", (F.col("pivot") & (F.col("parts") > 1)).alias("pivot"), "tokens")
    links = written(first.select(F.struct("g", "at").alias("group"), "node", "pivot", "tokens").groupBy("group").applyInPandas(_verify(percent), _LINK), "forest")
    loose = sets.join(links.where("loose").select(F.col("u").alias("node")).distinct(), "node", "left_semi").where("NOT pivot")
    shares = loose.groupBy("g").agg(F.ceil(F.sum(F.length("tokens") / 8) / GROUP_TOKENS).cast("int").alias("shares"))
    both = sets.join(shares, "g")
    mine = F.pmod(F.xxhash64("node", F.lit(1)), F.col("shares")).cast("int")
    members = both.select("g", block.alias("at"), F.explode(every("shares")).alias("share"), "node", "tokens")
    others = loose.join(shares, "g").select("g", F.explode(every("parts")).alias("at"), mine.alias("share"), "node", "tokens")
    met = members.unionByName(others).select(F.struct("g", "at", "share").alias("group"), "node", F.lit(False).alias("pivot"), "tokens")
    more = written(met.groupBy("group").applyInPandas(_verify(percent), _LINK), "forest")
    return links.unionByName(more).where("u != v").select("u", "v")


def link_components(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, orders: int = ORDERS) -> DataFrame:
    """(doc_id, th, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    th is the hash of the text. Null texts are empty. A document without words has n_shingles 0 and is a
    component by itself. component_id is the smallest doc_id of the component; rows without an id link like
    others and their component is null only where no row of it has an id. Repeated rows link with each
    other like any equal texts; other columns are not read; no rows give no rows.
    """
    spark = docs.sparkSession
    keyed = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    n_docs = docs.count()
    n_buckets = max(16, math.ceil(n_docs / DOCS_A_BUCKET))
    shared = spark.sparkContext.broadcast(token_levels(docs, n_docs, width))  # two bits a slot, compressed, and two arrays of at most FREQUENT numbers
    met = keyed.mapInArrow(_prefixes(uuid.uuid4().hex, shared, n_buckets, orders, width, percent), _R).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meet, _R)
    met = written(met.drop("bucket"), "prefixes")
    nodes = met.where("kind = 0").select("doc_id", "th", "n", F.col("u").alias("node"), (F.col("v") == 1).alias("first"))
    group = components(candidate_links(met.where("kind > 0"), percent, orders=orders))
    sized = group.join(nodes.where("first").select("node", "n", "doc_id", "th"), "node")
    totals = sized.groupBy("root").agg(F.sum("n").alias("tokens"), F.max(F.struct("n", "node"))["node"].alias("largest"))
    parts = F.ceil(F.col("tokens") / GROUP_TOKENS).cast("int")
    wanted = written(sized.join(totals, "root").select("node", "doc_id", "th", F.col("root").alias("g"), parts.alias("parts"), (F.col("node") == F.col("largest")).alias("pivot")), "candidates")
    n_wanted, most = wanted.agg(F.count(F.lit(1)), F.coalesce(F.max("parts"), F.lit(1))).first()
    side = F.broadcast(wanted) if n_wanted <= BROADCAST_ROWS else wanted
    side = side.withColumnsRenamed({"doc_id": "node_id", "th": "node_th"})
    some = keyed.join(side, keyed["doc_id"].eqNullSafe(side["node_id"]) & (keyed["th"] == side["node_th"]))
    sets = some.select("g", "parts", "pivot", "node", "text").mapInArrow(_sets(width), "g long, parts int, pivot boolean, node long, tokens binary")
    links = _verified_links(sets, most > 1, percent)
    found = components(links) if most > 1 else links.where("u != v").select(F.col("u").alias("node"), F.col("v").alias("root"))
    # equal sets of different blocks are nodes of their own but share all tokens, so they are linked like others
    rooted = nodes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    low = rooted.where("n > 0").groupBy(F.col("root").alias("key")).agg(F.min("doc_id").alias("low"))
    out = rooted.withColumn("key", F.when(F.col("n") > 0, F.col("root"))).join(low, "key", "left")
    return out.select("doc_id", "th", F.col("n").cast("long").alias("n_shingles"), F.coalesce("low", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id; rows without words stay, equal rows of one id too."""
    gone = written(link_components(docs.select("doc_id", "text")).where("NOT (doc_id <=> component_id)").select("doc_id", "th").distinct(), "copies")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    th = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]) & (th == gone["th"]), "left_anti")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under shingle similarity of 0.75 or more."""
    return link_components(documents(spark, sf_dir).select("doc_id", "text")).drop("th")
