"""Shared pieces of the training-data operators: reading, scratch tables, text hashing.

Nothing outside this subpackage imports it.
"""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

from cadenza.functions.lineage import shared_folder

#: Rows that a generator holds as Python objects at a time.
ROWS_AT_ONCE = 512
#: Characters of documents that a block gathers before it is worked off.
BLOCK_CHARS = 4_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share. Where it is unset a local session gets one of its own; a cluster gets an error."""
    return shared_folder(spark)


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends here, and lost executors lose nothing."""
    path = f"{scratch(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def blocks(batches, cols: int, chars: int = BLOCK_CHARS, rows: int = 60_000):
    """From Arrow batches whose column 0 is a text: lists of columns, each over about ``chars`` characters.

    A text longer than that is a block of its own; nothing is cut.
    """
    held: list[list] = [[] for _ in range(cols)]
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            got = [part.column(k).to_pylist() for k in range(cols)]
            for row in zip(*got, strict=True):
                for k in range(cols):
                    held[k].append(row[k])
                size += len(row[0] or "")
                if size >= chars or len(held[0]) >= rows:
                    yield held
                    held, size = [[] for _ in range(cols)], 0
    if held[0]:
        yield held


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with underscores at its end until no column of ``taken`` is called so, in either case."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


class WordHashes(dict):
    """Word to 64-bit hash, remembered for at most ``most`` words."""

    def __init__(self, most: int = 400_000):
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every bit of the input moves every bit of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_shingles(words: list[str], hashes: WordHashes, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the ``width``-word shingles; fewer words make one shingle, none make none."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(h) < width:
        acc = np.full(1, len(h), np.uint64)
        for x in h:
            acc = mixed(acc * _STEP + x)
        return acc
    n = len(h) - width + 1
    acc = h[:n].copy()
    for k in range(1, width):
        acc = acc * _STEP + h[k : k + n]
    return np.unique(mixed(acc))
