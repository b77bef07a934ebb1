"""SentencePiece encoding and decoding with seeded merge-dropout.

A text is cut where no piece of the vocabulary can reach across (before a space mark that follows
another character, and around line ends), and each part is segmented by its own agenda: candidate
merges leave it by score, then from the left. A candidate is skipped when the hash of (seed, document,
place of the part in the text, how manieth candidate of the part) falls below the dropout: every
occurrence of a word draws its own skips, a segmentation can be repeated anywhere, and without
dropout it is the library's own. What is remembered of a part is its segmentation without a skip,
which no draw enters. Symbols that are no piece become bytes. Decoding joins pieces
and bytes again and gives back every text, whatever was skipped.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from array import array
from collections import defaultdict
from functools import lru_cache
from itertools import chain, count, islice, repeat
from operator import add
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, documents, mixed

SPACE = "▁"
DROPOUT = 0.1
#: A part of n characters has fewer than DRAWS * n candidates: n - 1 at first, and each merge adds two at most.
DRAWS = 3
#: Characters up to which segmentations of a part are remembered, and characters of all parts that are.
SHORT, REMEMBERED = 32, 4_000_000
#: Parts of one length that are segmented together.
TOGETHER = 1 << 13
#: Spans that are gathered at a time.
GATHERED = 1 << 16
_SHUT = 1 << 62
_NEVER = float("inf")
_PARTS = re.compile(rf"{SPACE}+[^{SPACE}\n]*|\n+|[^{SPACE}\n]+")


class Vocabulary:
    """Pieces, scores and byte ids of a BPE model file with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = m.id_to_piece(list(range(m.get_piece_size())))
        self.bytes = {i: int(p[3:5], 16) for i, p in enumerate(self.pieces) if m.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        self.ids = {p: i for i, p in enumerate(self.pieces) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))}
        self.scores = m.get_score(list(range(m.get_piece_size())))
        self.costs = {p: -self.scores[i] for p, i in self.ids.items()}
        raw = [bytes([self.bytes[i]]) if i in self.bytes else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.raw, self.raw_lengths = np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw))
        self.raw_starts = np.cumsum(self.raw_lengths) - self.raw_lengths
        self.merges = Merges(self)
        self.known = Known(self)
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces of this file reach across the cuts")

    def spelt(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for, one after the other."""
        return _gathered(self.raw, self.raw_starts[ids], self.raw_lengths[ids])


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def segment(v: Vocabulary, part: str, skipped=frozenset()) -> tuple[list[int], int]:
    """The ids of one part, with space marks for spaces, and its count of candidates, of which those numbered in ``skipped`` are left out."""
    symbols, n = (_by_scan if len(part) <= SHORT else _by_agenda)(v, part, skipped)
    try:
        return [v.ids[s] for s in symbols], n
    except KeyError:
        out: list[int] = []
    for s in symbols:
        k = v.ids.get(s)
        out += [k] if k is not None else [v.byte_ids[b] for b in s.encode("utf-8", "surrogatepass")]
    return out, n


def _by_agenda(v: Vocabulary, part: str, skipped) -> tuple[list[str], int]:
    """The symbols that are left, and the count of candidates; the agenda is a heap, so that a part may be of any length."""
    symbols = list(part)
    after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
    agenda: list[tuple[float, int, str]] = []

    def propose(i: int) -> None:
        if i >= 0 and after[i] < len(symbols):
            piece = symbols[i] + symbols[after[i]]
            if (cost := v.costs.get(piece)) is not None:
                heapq.heappush(agenda, (cost, i, piece))

    for i in range(len(symbols) - 1):
        propose(i)
    n = 0
    while agenda:
        _, i, piece = heapq.heappop(agenda)
        j = after[i]
        if not symbols[i] or j >= len(symbols) or symbols[i] + symbols[j] != piece:
            continue
        n += 1
        if n - 1 in skipped:
            continue
        symbols[i], symbols[j] = piece, ""
        after[i] = after[j]
        if after[j] < len(symbols):
            before[after[j]] = i
        propose(before[i])
        propose(i)
    return [s for s in symbols if s], n


def _by_scan(v: Vocabulary, part: str, skipped) -> tuple[list[str], int]:
    """The same, where the agenda of a short part is a list of its neighbours' costs, searched whole for each candidate.

    A neighbourhood that was skipped costs infinitely much until one of its two symbols grows.
    """
    symbols, cost = list(part), v.costs.get
    agenda = list(map(cost, map(add, symbols, symbols[1:]), repeat(_NEVER)))
    n = 0
    while agenda and (least := min(agenda)) < _NEVER:
        i = agenda.index(least)
        n += 1
        if n - 1 in skipped:
            agenda[i] = _NEVER
            continue
        symbols[i] += symbols.pop(i + 1)
        del agenda[i]
        if i:
            agenda[i - 1] = cost(symbols[i - 1] + symbols[i], _NEVER)
        if i < len(agenda):
            agenda[i] = cost(symbols[i] + symbols[i + 1], _NEVER)
    return symbols, n


class Merges:
    """What two symbols merge to, for many short parts at a time: a symbol is the number of a piece, or one beyond them for a character that is none.

    The merges of a left symbol stand in one array, from its own offset on by right symbol, where they fit between those of others. An entry
    holds, from its highest bits on, the left symbol, the rank of the cost, room for a place, and the piece.
    """

    def __init__(self, v: Vocabulary):
        self.v, self.pieces = v, len(v.pieces)
        symbols = dict(v.ids)
        for c in sorted({c for p in v.ids for c in p}):
            symbols.setdefault(c, self.pieces + len(symbols))
        most = max(symbols.values(), default=0) + 3
        self.characters = np.full(0x110000, most - 2, np.int32)  # one symbol stands for all characters of no piece
        self.end = most - 1  # stands before and behind each part, and merges with nothing
        for c, k in symbols.items():
            if len(c) == 1:
                self.characters[ord(c)] = k
        costs = sorted(set(v.costs.values()))
        rank = {c: k for k, c in enumerate(costs)}
        self.bits, place = most.bit_length(), (SHORT + 1).bit_length()
        self.left = self.bits + place + len(costs).bit_length()
        if self.left + self.bits > 63:
            raise ValueError("this file has too many pieces")
        rows: dict[int, list[tuple[int, int]]] = {}
        for p, i in v.ids.items():
            for k in range(1, len(p)):
                left, right = symbols.get(p[:k]), symbols.get(p[k:])
                if left is not None and right is not None:
                    rows.setdefault(left, []).append((right, left << self.left | rank[v.costs[p]] << self.bits + place | i))
        room = 8 * sum(map(len, rows.values())) + 2 * most
        self.offset, self.table = np.zeros(most, np.int64), np.full(room + most, -1, np.int64)
        rng = np.random.default_rng(3)
        for left, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
            right, entry = np.array(row).T
            tried = 0
            while (self.table[(at := int(rng.integers(0, room)) + right)] >= 0).any():
                tried += 1
                if tried > 10_000:
                    raise ValueError("the merges of this file do not fit")
            self.offset[left] = at[0] - right[0]
            self.table[at] = entry

    def met(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Rank of the cost of two symbols, place of the left one and piece, in one number; `_SHUT` or more where they are no piece."""
        entry = self.table[self.offset[left] + right]
        return np.where(entry >> self.left == left, entry & (1 << self.left) - 1, _SHUT) | place << self.bits

    def segmented(self, parts: list[str], skipped: list) -> list[tuple[bytes, int]]:
        """As `segment` of each part of up to SHORT characters with those of its candidates left out, as 32-bit numbers."""
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        met = np.fromiter(map(len, skipped), np.int64, len(parts))
        draws = np.fromiter(chain.from_iterable(skipped), np.int64, int(met.sum()))
        made = self.run(parts.__getitem__, self.symbols(parts), np.cumsum(sizes) - sizes, sizes, draws, np.cumsum(met) - met, met)
        return [(made.ids[lo : lo + n].tobytes(), k) for lo, n, k in zip(*(x.tolist() for x in made[1:]), strict=True)]

    def symbols(self, parts: list[str]) -> np.ndarray:
        """The symbols of the characters of all parts."""
        return self.characters[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)]

    def run(self, part, symbols: np.ndarray, begins: np.ndarray, sizes: np.ndarray, draws: np.ndarray, first: np.ndarray, met: np.ndarray) -> Segments:
        """The segments of parts of up to SHORT characters, each given by where its symbols begin and their count, and by where its skips begin and their count.

        part: the text of a part by its place in this call.
        """
        order = np.argsort(sizes.astype(np.uint8), kind="stable")
        ends = np.cumsum(np.bincount(sizes, minlength=SHORT + 1))
        made, held = [], 0
        starts, lengths, counts = np.zeros((3, len(sizes)), np.int64)
        for n in range(1, SHORT + 1):
            for lo in range(int(ends[n - 1]), int(ends[n]), TOGETHER):
                own = order[lo : min(lo + TOGETHER, int(ends[n]))]
                skip = None
                if len(draws):
                    skip = np.zeros((DRAWS * n + 1, len(own)), bool)
                    skip[draws[_spans(first[own], met[own])], np.repeat(np.arange(len(own)), met[own])] = True
                ids, lengths[own], counts[own], odd = self._same_size(symbols[begins[own] + np.arange(n)[:, None]], skip)
                starts[own] = held + np.cumsum(lengths[own]) - lengths[own]
                made.append(ids)
                held += len(ids)
                for k in own[odd].tolist():  # symbols that are no piece become bytes
                    ids, _ = segment(self.v, part(k), frozenset(draws[first[k] : first[k] + met[k]].tolist()))
                    made.append(np.array(ids, np.uint32))
                    starts[k], lengths[k] = held, len(ids)
                    held += len(ids)
        return Segments(np.concatenate([np.zeros(0, np.uint32), *made]), starts, lengths, counts)

    def _same_size(self, symbols: np.ndarray, skip: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pieces one part after the other, their count and the count of candidates by part, and which parts have symbols that are no piece.

        symbols: a column a part; skip: a row a candidate. All else is one number for a symbol of a part, at its place times a power of two plus the part's.
        """
        n, parts = symbols.shape
        shift = max(parts - 1, 1).bit_length()
        wide = 1 << shift
        symbol = np.full((n + 2, wide), self.end, np.int32)
        symbol[1:-1, :parts] = symbols
        cost = np.full((n + 2, wide), _SHUT, np.int64)  # of each symbol with the next
        cost[1:n] = self.met(symbol[1:n], symbol[2:-1], np.arange(1, n)[:, None])
        after = np.arange(wide, (n + 3) * wide)
        before = after - 2 * wide
        counts, tried, merged, all_costs, place = np.zeros(parts, np.int64), 0, symbol.reshape(-1), cost.reshape(-1), (1 << (SHORT + 1).bit_length()) - 1
        while True:
            least = cost.min(0)
            own = np.flatnonzero(least < _SHUT)
            if not len(own):
                break
            counts[own] = tried + 1
            least = least[own]
            at = least >> self.bits & place
            x = (at << shift) + own
            if skip is not None:
                left_out = skip[tried, own]
                all_costs[x[left_out]] = _SHUT  # until one of the two symbols grows
                kept = ~left_out
                x, at, least = x[kept], at[kept], least[kept]
            tried += 1
            piece = least & (1 << self.bits) - 1
            y, w = after[x], before[x]
            z = after[y]
            after[x], before[z] = z, x
            merged[x], merged[y] = piece, -1
            all_costs[y] = _SHUT
            all_costs[x] = self.met(piece, merged[z], at)
            all_costs[w] = self.met(merged[w], piece, w >> shift)
        done = np.ascontiguousarray(symbol[1:-1, :parts].T)
        left = done >= 0
        return done[left].astype(np.uint32), left.sum(1), counts, (done >= self.pieces).any(1)


class Segments(NamedTuple):
    """Ids of many parts: all of them, and by part where its own begin, their count, and the count of its candidates."""

    ids: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    counts: np.ndarray


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length says, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def _gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The values at `_spans`, gathered in bounded pieces."""
    return np.concatenate([values[:0], *(values[_spans(starts[lo : lo + GATHERED], lengths[lo : lo + GATHERED])] for lo in range(0, len(starts), GATHERED))])


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class Known:
    """Segmentations of parts without a skip, by the part's number. Parts of more than SHORT characters have a number, but no segmentation."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.clear()

    def clear(self) -> None:
        self.at = defaultdict(count(1).__next__, {"": 0})
        mark = [self.v.byte_ids[b] for b in SPACE.encode()]
        self.parts, self.sizes, self.held = [""], np.zeros(1, np.int64), 0
        self.symbols, self.begins = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.plain = Segments(np.array(mark, np.uint32), np.zeros(1, np.int64), np.full(1, len(mark)), np.zeros(1, np.int64))

    def numbers(self, parts: list[str]) -> np.ndarray:
        """The number of each part; new ones are segmented together."""
        out = np.fromiter(map(self.at.__getitem__, parts), np.int64, len(parts))
        if len(self.at) > len(self.parts):
            new = list(islice(self.at, len(self.parts), None))
            sizes = np.fromiter(map(len, new), np.int64, len(new))
            short = np.where(sizes <= SHORT, sizes, 0)
            symbols = self.v.merges.symbols([p for p in new if len(p) <= SHORT])
            begins, none = np.cumsum(short) - short, np.zeros(len(new), np.int64)
            made = self.v.merges.run(new.__getitem__, symbols, begins, short, none[:0], none, none)
            old = self.plain
            self.plain = Segments(*map(np.concatenate, ((old.ids, made.ids), (old.starts, made.starts + len(old.ids)), (old.lengths, made.lengths), (old.counts, made.counts))))
            self.begins = np.concatenate((self.begins, begins + len(self.symbols)))
            self.symbols, self.sizes = np.concatenate((self.symbols, symbols)), np.concatenate((self.sizes, sizes))
            self.held += int(sizes.sum())
            self.parts += new
        return out

    def skipping(self, numbers: np.ndarray, draws: np.ndarray, first: np.ndarray, met: np.ndarray) -> Segments:
        """The segments of parts with skips, of which those of each part begin somewhere in ``draws`` and have a count."""
        return self.v.merges.run(lambda k: self.parts[numbers[k]], self.symbols, self.begins[numbers], self.sizes[numbers], draws, first, met)


def skips(key: bytes, n: int, dropout: float) -> np.ndarray:
    """Which of range(n) are skipped under this key, sorted: those whose hash falls below the dropout."""
    digest = xxhash.xxh3_128_intdigest(key)
    base, step, limit = np.uint64(digest >> 64), np.uint64(digest & (1 << 64) - 1 | 1), np.uint64(int(dropout * (1 << 53)))
    out = [np.zeros(0, np.int64)]
    for lo in range(0, n, 1 << 15):
        x = mixed(base + np.arange(lo, min(n, lo + (1 << 15)), dtype=np.uint64) * step)
        out.append(np.flatnonzero(x >> np.uint64(11) < limit) + lo)
    return np.concatenate(out)


def _parts(text: str) -> list[str]:
    """The parts of a text, with space marks for spaces; '' for a mark that the text itself holds."""
    if SPACE not in text:
        return _PARTS.findall(SPACE + text.replace(" ", SPACE))
    parts: list[str] = []
    for k, piece in enumerate(text.split(SPACE)):
        marked = piece.replace(" ", SPACE)
        parts += ["", *_PARTS.findall(marked)] if k else _PARTS.findall(SPACE + marked)
    return parts


def encode_together(v: Vocabulary, texts: list[str], dropout: float = 0.0, keys: list[bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, one after the other, and where those of each begin and end.

    A part in which no candidate is skipped has its plain ids. Occurrences of a part that skip the same one candidate are segmented
    once for all of them, those that skip more each on its own.
    """
    known = v.known
    if known.held > REMEMBERED:
        known.clear()
    all_parts = [_parts(text) if text else [] for text in texts]
    ends = np.cumsum([0, *map(len, all_parts)])
    numbers = known.numbers(list(chain.from_iterable(all_parts)))
    del all_parts
    sizes, ids = known.sizes[numbers], [known.plain.ids]
    starts, lengths = known.plain.starts[numbers], known.plain.lengths[numbers]
    held = len(ids[0])
    begins = np.concatenate(([0], np.cumsum(sizes)))
    draws = first = met = np.zeros(0, np.int64)
    if dropout and len(numbers):
        bounds = begins[ends].tolist()
        draws = np.concatenate([skips(key, DRAWS * (hi - lo), dropout) + DRAWS * lo for key, lo, hi in zip(keys, bounds[:-1], bounds[1:], strict=True) if hi > lo] or [draws])
        where = np.searchsorted(begins[1:], draws // DRAWS, side="right")
        draws -= DRAWS * begins[where]  # numbered within each part
        first = np.flatnonzero(np.diff(where, prepend=-1))
        met = np.diff(first, append=len(where))
        hit = where[first]
    long = np.flatnonzero(sizes > SHORT)
    for k in long.tolist():
        own = np.searchsorted(hit, k) if len(first) else 0
        skipped = draws[first[own] : first[own] + met[own]].tolist() if own < len(first) and hit[own] == k else ()
        ids.append(np.array(segment(v, known.parts[numbers[k]], frozenset(skipped))[0], np.uint32))
        starts[k], lengths[k] = held, len(ids[-1])
        held += len(ids[-1])
    if len(first):
        counts = known.plain.counts
        good = draws[first] < counts[numbers[hit]]  # a part none of whose first candidates is skipped has no other; long parts have no count
        hit, first, met = hit[good], first[good], met[good]
        slot = (np.cumsum(counts) - counts)[numbers[hit]] + draws[first]  # the candidate among those of all parts
        one = np.full(int(counts.sum()), -1)
        one[slot] = np.arange(len(slot))
        shared = one[one >= 0]  # one occurrence of each
        one[slot[shared]] = np.arange(len(shared))
        made = known.skipping(numbers[hit[shared]], draws, first[shared], np.ones(len(shared), np.int64))
        as_one = one[slot]
        starts[hit], lengths[hit] = held + made.starts[as_one], made.lengths[as_one]
        ids.append(made.ids)
        held += len(made.ids)
        more = np.flatnonzero(met > 1)
        more = more[draws[first[more] + 1] < made.counts[as_one[more]]]
        made = known.skipping(numbers[hit[more]], draws, first[more], met[more])
        starts[hit[more]], lengths[hit[more]] = held + made.starts, made.lengths
        ids.append(made.ids)
    return _gathered(np.concatenate(ids), starts, lengths), np.concatenate(([0], np.cumsum(lengths)))[ends]


def encode_packed(v: Vocabulary, texts: list[str], dropout: float = 0.0, keys: list[bytes] | None = None) -> list[bytes]:
    """The ids of each text as 32-bit numbers, all made together."""
    ids, ends = encode_together(v, texts, dropout, keys)
    return [ids[lo:hi].tobytes() for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def encode(v: Vocabulary, text: str, dropout: float = 0.0, key: bytes = b"") -> list[int]:
    """The ids of a text."""
    return array("I", encode_packed(v, [text], dropout, [key])[0]).tolist()


def decode(v: Vocabulary, ids) -> str:
    """The text of ids that `encode` gave."""
    return _text(v.spelt(np.asarray(ids, np.int64)).tobytes())


def _text(spelt: bytes) -> str:
    return spelt.decode("utf-8", "surrogatepass")[1:]  # without the space that every text is given in front


def _encoded(path: str, dropout: float, seed: int):
    def run(batches):
        v = vocabulary(path)
        for texts, docs in blocks(batches, 2):
            texts = [text or "" for text in texts]
            raws = [text.encode("utf-8", "surrogatepass") for text in texts]
            # with the text, so that documents of null or repeated ids draw on their own
            ids, ends = encode_together(v, texts, dropout, [f"{seed}/{doc}/".encode() + raw for raw, doc in zip(raws, docs, strict=True)])
            spelt, packed = v.spelt(ids), ids.astype("<u4", copy=False)
            places = np.concatenate(([0], np.cumsum(v.raw_lengths[ids])))[ends]
            rows = []
            for doc, raw, lo, hi, begin, end in zip(docs, raws, ends[:-1].tolist(), ends[1:].tolist(), places[:-1].tolist(), places[1:].tolist(), strict=True):
                back = _text(spelt[begin:end].tobytes())
                rows.append((doc, len(raw), hi - lo, zlib.crc32(packed[lo:hi]), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_tokens", "ids_crc32", "decoded_sha256"])

    return run


def encode_documents(docs: DataFrame, path: str, *, dropout: float = DROPOUT, seed: int = 0) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, ids_crc32, decoded_sha256) of every row, the last over the decoded text.

    path: a SentencePiece BPE file with byte fallback, on every executor. seed: another one gives other
    segmentations; so does another document or another place in it. Null texts are empty and
    have no ids; texts of any length are encoded whole; equal rows have equal results; other columns are not
    read; no rows give no rows.
    """
    return docs.select("text", F.col("doc_id").cast("long")).mapInArrow(_encoded(path, dropout, seed), "doc_id long, n_bytes long, n_tokens long, ids_crc32 long, decoded_sha256 string")


def op3_merge_dropout(spark: SparkSession, sf_dir: str, model: str = "piece_bpe_32k.model") -> DataFrame:
    """All documents encoded with dropout and decoded again."""
    import public_tokenizers

    return encode_documents(documents(spark, sf_dir), public_tokenizers.path(model))
