"""Best-fit packing by a grouping genetic algorithm on islands.

A document's ids, with an end id, are cut into pieces of the sequence length; only the last piece may be
shorter. Pieces are dealt by hash to demes of a few thousand, the unit in which bins are formed. In each
deme several islands evolve packings of all its pieces: a crossover injects whole well-filled bins of a
second parent, drops the bins that held any of their pieces, and puts the displaced pieces back by
best fit, largest first. After each epoch the elite of an island migrates to the next one of its deme;
at the end the elites meet once more and the best packing counts. Demes and islands are separate tasks
and rows carry lengths and checksums only. Bins that a deme could not fill well are then opened, and
their pieces packed once more together with those of other demes.
"""

from __future__ import annotations

import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, documents

LENGTH = 2048
DEME = 4096
ISLANDS = 2
#: Crossovers in a row that may bring nothing.
PATIENCE = 6
#: Demes whose poorly filled bins are packed anew together, and the fill below which a bin is opened.
JOINED, WELL = 16, 0.98
_END = b"\0\0\0\0"
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_ROW = f"deme long, island int, bin int, {_PIECE}"


@lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    for text, want in _PROBES:
        ids = t.encode(text, add_special_tokens=False).ids
        if ids != [i for w in want for i in t.encode(w, add_special_tokens=False).ids] or len(t.pre_tokenizer.pre_tokenize_str(text)) != len(want):
            raise ValueError(f"{path} has other pre-tokens")
    return t


#: Texts and the pre-tokens that they must have: white space is dropped, letters, single digits and signs are told apart.
_PROBES = [("it's 12,ab", ["it", "'s", "1", "2", ",", "ab"]), ("a  b\n(c", ["a", "b", "(", "c"])]


def parts_of(text: str) -> list[str]:
    """The text between spaces and line ends. The vocabulary drops white space and its normaliser works within such parts, so that the ids of a text are those of its parts."""
    return text.replace("\n", " ").split(" ")


#: The pre-tokens of the vocabulary file: a fixed pattern.
_PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it is printable, else one from 256 on."""
    out, more = [""] * 256, 256
    for b in range(256):
        out[b] = chr(b) if b in _PLAIN else chr(more)
        more += b not in _PLAIN
    return out


_LETTERS = _byte_letters()


def _simple(part: str) -> bool:
    """Whether normalising is lower case alone: printable Latin without combining marks or special tokens."""
    return (part.isascii() or max(part) < "\u0180" and "\u0130" not in part) and "<|" not in part and part.isprintable()


def _word_ids(model, word: str) -> bytes:
    """The ids of a pre-token in lower case."""
    piece = word if word.isascii() else "".join(map(_LETTERS.__getitem__, word.encode()))
    return array("I", [x.id for x in model.tokenize(piece)]).tobytes()


def encode_part(t, model, part: str, words: dict[str, bytes]) -> bytes:
    """The ids of a part; simple ones skip the library's normaliser and ask its model for each new pre-token only."""
    if not part:
        return b""
    if not _simple(part):
        return array("I", t.encode(part, add_special_tokens=False).ids).tobytes()
    part = part.lower()
    if part.isalpha():  # one pre-token; `known` remembers it
        return words.get(part) or words.setdefault(part, _word_ids(model, part))
    if len(part) > 2 and part[-1] in ".," and (head := part[:-1]).isalpha():
        found = (head, part[-1])
    else:
        found = _PRE_TOKEN.findall(part)
    return b"".join([words.get(w) or words.setdefault(w, _word_ids(model, w)) for w in found])


def encode_texts(path: str, texts: list[str], known: dict[str, bytes], words: dict[str, bytes], most: int = 400_000) -> list[bytes]:
    """The ids of each text as little-endian 32-bit numbers; ``known`` remembers at most about ``most`` parts, ``words`` pre-tokens."""
    parts = [parts_of(t) for t in texts]
    for memory in (known, words):
        if len(memory) > most:
            memory.clear()
    t = _tokenizer(path)
    model = t.model
    for p in set().union(*parts).difference(known):
        known[p] = encode_part(t, model, p, words)
    return [b"".join(map(known.__getitem__, ps)) for ps in parts]


def _pieces(path: str, length: int):
    def run(batches):
        known: dict[str, bytes] = {}
        words: dict[str, bytes] = {}
        for texts, ids in blocks(batches, 2):
            out = []
            for doc, raw in zip(ids, encode_texts(path, [t or "" for t in texts], known, words), strict=True):
                raw += _END
                for k, at in enumerate(range(0, len(raw), 4 * length)):
                    part = raw[at : at + 4 * length]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


class Packing:
    """Bins of pieces, all of them placed; bins[k] lists piece numbers and room[k] is what they leave."""

    def __init__(self, sizes: list[int], length: int):
        self.sizes, self.length, self.bins, self.room = sizes, length, [], []

    def best_fit(self, items: list[int]) -> Packing:
        """Puts items, in their order, each into the fullest bin that has room, or a new one."""
        sizes, bins, room = self.sizes, self.bins, self.room
        by: list[list[int]] = [[] for _ in range(self.length + 1)]
        mask = 0
        for k, r in enumerate(room):
            by[r].append(k)
            mask |= 1 << r
        for i in items:
            s = sizes[i]
            fits = mask >> s
            if fits:
                r = s + (fits & -fits).bit_length() - 1
                k = by[r].pop()
                if not by[r]:
                    mask ^= 1 << r
                bins[k].append(i)
            else:
                r, k = self.length, len(bins)
                bins.append([i])
                room.append(r)
            room[k] = r - s
            by[r - s].append(k)
            mask |= 1 << (r - s)
        return self

    def fitness(self) -> tuple[int, float]:
        """Fewer bins are better; of as many, those whose fill is less even."""
        return -len(self.bins), float(sum((self.length - r) ** 2 for r in self.room))

    def numbers(self) -> np.ndarray:
        out = np.zeros(len(self.sizes), np.int64)
        for k, items in enumerate(self.bins):
            out[items] = k
        return out


def from_numbers(sizes: list[int], length: int, numbers: np.ndarray) -> Packing:
    p = Packing(sizes, length)
    at: dict[int, int] = {}
    for i, b in enumerate(numbers.tolist()):
        k = at.setdefault(b, len(at))
        if k == len(p.bins):
            p.bins.append([])
            p.room.append(length)
        p.bins[k].append(i)
        p.room[k] -= sizes[i]
    return p


def crossover(a: Packing, b: Packing, random: np.random.Generator) -> Packing:
    """A child of ``a`` into which whole bins of ``b``, the best filled of a random share, are injected."""
    chosen = [k for k in np.flatnonzero(random.random(len(b.bins)) < 0.5) if b.room[k] <= a.length // 200]
    taken = {i for k in chosen for i in b.bins[k]}
    child = Packing(a.sizes, a.length)
    child.bins, child.room = [list(b.bins[k]) for k in chosen], [b.room[k] for k in chosen]
    displaced = []
    for items, r in zip(a.bins, a.room, strict=True):
        if taken.isdisjoint(items):
            child.bins.append(list(items))
            child.room.append(r)
        else:
            displaced += [i for i in items if i not in taken]
    # open the emptiest bins too, so that their pieces may fill gaps elsewhere
    order = sorted(range(len(child.bins)), key=lambda k: -child.room[k])[: max(1, len(child.bins) // 50)]
    for k in order:
        displaced += child.bins[k]
    gone = set(order)
    child.bins, child.room = [x for k, x in enumerate(child.bins) if k not in gone], [x for k, x in enumerate(child.room) if k not in gone]
    displaced.sort(key=lambda i: (-a.sizes[i], i))
    return child.best_fit(displaced)


def first_packing(sizes: list[int], length: int, random: np.random.Generator | None) -> Packing:
    """Best fit, largest first; with a generator, in an order that is shaken a little."""
    keys = np.array(sizes, np.float64) * (1 if random is None else random.uniform(0.9, 1.1, len(sizes)))
    return Packing(sizes, length).best_fit(np.lexsort((np.arange(len(sizes)), -keys)).tolist())


def evolve(people: list[Packing], patience: int, random: np.random.Generator, floor: int) -> Packing:
    """The fittest once it has no more bins than the bound, or so many crossovers in a row have made none fitter; each child takes the place of the least fit."""
    people = sorted(people, key=Packing.fitness, reverse=True)
    still, best = 0, people[0].fitness()
    while len(people[0].bins) > floor and still < patience:
        still += 1
        if people[0].fitness() > best:
            still, best = 0, people[0].fitness()
        i, j = random.permutation(len(people))[:2] if len(people) > 1 else (0, 0)
        people.append(crossover(people[min(i, j)], people[max(i, j)], random))
        people = sorted(people, key=Packing.fitness, reverse=True)[: max(2, len(people) - 1)]
    return people[0]


_KEYS = ["doc_id", "piece", "start", "length", "ids_crc32"]


def _epoch(length: int, patience: int, final: bool):
    """Rows of one island, or in the end of one deme; ``island`` tells whose elite a bin number is of, -1 none yet."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["from", *_KEYS], kind="stable")
        groups = [g for _, g in pdf.groupby("from", sort=True)]
        items = groups[0].reset_index(drop=True)
        sizes = items["length"].astype("int64").tolist()
        floor = -(-sum(sizes) // length)
        seed = [int(x) & 0xFFFFFFFF for x in key]
        random = np.random.default_rng([11, len(groups), *seed])
        if int(items["bin"].iloc[0]) < 0:
            people = [first_packing(sizes, length, None if k == 0 and not seed[-1] else random) for k in range(2)]
        else:
            people = [from_numbers(sizes, length, g["bin"].to_numpy()) for g in groups]
        best = evolve(people, patience, random, floor)
        items["bin"] = best.numbers()
        if final:
            room = np.array(best.room, np.int64)[items["bin"]]
            items["fill"] = 1 - room / length
            items["offset"] = items.groupby("bin")["length"].cumsum() - items["length"]
            items["island"] = 0
        return items.drop(columns=["from"])

    return run


def _elites(pieces: DataFrame, length: int, islands: int, patience: int, epochs: int) -> DataFrame:
    """(deme, bin, fill, offset and the piece) of the best packing of each deme."""
    row = _ROW
    at = pieces.withColumn("bin", F.lit(-1)).withColumn("island", F.explode(F.array(*map(F.lit, range(islands))))).withColumn("from", F.lit(0))
    for epoch in range(epochs):
        at = at.groupBy("deme", "island").applyInPandas(_epoch(length, patience, False), row)
        if epoch < epochs - 1:  # each elite stays and goes to the next island
            to = F.explode(F.array(*[F.struct(((F.col("island") + k) % islands).cast("int").alias("island"), F.lit(k).alias("from")) for k in range(min(2, islands))]))
            at = at.withColumn("_to", to).select("deme", "_to.island", "bin", *_KEYS, "_to.from")
    return at.withColumn("from", F.col("island")).groupBy("deme").applyInPandas(_epoch(length, patience, True), f"{row}, fill double, offset long")


def pack(docs: DataFrame, path: str, *, length: int = LENGTH, deme: int = DEME, islands: int = ISLANDS, patience: int = PATIENCE, epochs: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row.

    path: a vocabulary of the tokenizers library with the pre-tokens of `_PRE_TOKEN`, on every executor; any other
    fails. patience: crossovers in a row without a fitter packing that end an island's epoch. Null texts are empty
    and have the end id alone; texts of any length are cut, not shortened; repeated rows are packed each; ties of
    length are broken by the piece; other columns are not read; no rows give no rows.
    """
    n = docs.count()
    demes = max(1, n // deme)
    pieces = docs.select("text", F.col("doc_id").cast("long")).mapInArrow(_pieces(path, length), _PIECE)
    pieces = pieces.withColumn("deme", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(demes)))
    # a piece of full length is a sequence by itself
    dealt = pieces.withColumn("deme", F.when(F.col("length") == length, -1 - F.col("deme")).otherwise(F.col("deme")))
    first = _elites(dealt, length, islands, patience, epochs)
    if demes > 1:
        opened = F.col("fill") < WELL
        again = first.withColumn("deme", F.when(opened, demes + F.floor(F.col("deme") / JOINED)).otherwise(F.col("deme"))).withColumn("from", F.when(opened, -1).otherwise(0)).withColumn("bin", F.when(opened, -1).otherwise(F.col("bin")))
        first = again.select("deme", "island", "bin", *_KEYS, "from").groupBy("deme").applyInPandas(_epoch(length, patience, True), f"{_ROW}, fill double, offset long")
    sequence = F.shiftleft(F.col("deme") + demes + 1, 32) + F.col("bin")
    return first.select(*_KEYS, sequence.alias("sequence_id"), "offset")


def op9_packing(spark: SparkSession, sf_dir: str, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path(vocabulary))
