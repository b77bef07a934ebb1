"""Pluggable embedders: anything that turns samples or texts into vectors, run over Arrow batches of segments."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import Protocol, runtime_checkable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.errors import MissingBackend
from cadenza.functions.vectors import l2, mean_vectors


@runtime_checkable
class Embedder(Protocol):
    """``dim`` numbers for one segment of samples at ``sr``."""

    name: str
    dim: int
    sr: int

    def embed_audio(self, samples: np.ndarray) -> np.ndarray: ...


@runtime_checkable
class EmbedsText(Protocol):
    """Vectors of texts in the space of the audio ones."""

    def embed_text(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Needs no model: band energies of the spectrum for samples, signed hashes of words for texts, in one space of ``dim`` numbers."""

    name = "hashing"

    def __init__(self, dim: int = 64, sr: int = 24_000):
        self.dim, self.sr = dim, sr

    def embed_audio(self, samples: np.ndarray) -> np.ndarray:
        x = np.asarray(samples, float)
        power = np.abs(np.fft.rfft(x * np.hanning(len(x)))) ** 2 if len(x) > 1 else np.zeros(1)
        edges = np.unique(np.round(np.geomspace(1, max(len(power), 2), self.dim + 1)).astype(int))
        bands = np.zeros(self.dim)
        each = np.add.reduceat(np.append(power, 0.0), np.minimum(edges[:-1], len(power)))
        bands[: len(each)] = np.log1p(each)
        return bands - bands.mean()

    def embed_text(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts, strict=True):
            for word in (text or "").lower().split():
                h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
                row[h % self.dim] += 1 if h >> 16 & 1 else -1
        return out


_MADE: dict[str, Callable[[], Embedder]] = {"hashing": HashingEmbedder}


def register(name: str, make: Callable[[], Embedder]) -> None:
    """Makes an embedder known; ``make`` is called once in each task, so that weights load where they are used."""
    _MADE[name] = make


def get_embedder(name: str) -> Embedder:
    if name not in _MADE:
        raise MissingBackend(f"no embedder {name}; its library may be missing. Known: {', '.join(sorted(_MADE))}")
    return _MADE[name]()


def segment_embeddings(waves: DataFrame, segments: DataFrame, make: Callable[[], Embedder]) -> DataFrame:
    """(id, seg, v, error) for ``waves`` (id, sr, samples) and ``segments`` (id, seg, start, end) in seconds.

    A segment that can't be embedded has an error in place of a vector and fails nothing else. Only the slices
    that a segment needs travel to Python.
    """
    at = lambda c: F.floor(F.col(c) * F.col("sr") + 0.5).cast("int")
    cut = F.slice("samples", at("start") + 1, F.greatest(at("end") - at("start"), F.lit(0)))
    rows = waves.join(segments, "id").select("id", "seg", cut.alias("samples"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = make()
        for pdf in batches:
            out = []
            for x in pdf["samples"]:
                try:
                    v = np.asarray(e.embed_audio(np.asarray(x, np.float32)), float)
                    out.append((v.tolist(), None) if np.isfinite(v).all() else (None, "not finite"))
                except Exception as error:  # whatever a model raises belongs to its row
                    out.append((None, str(error) or type(error).__name__))
            yield pd.DataFrame({"id": pdf["id"], "seg": pdf["seg"], "v": [o[0] for o in out], "error": [o[1] for o in out]})

    return rows.mapInPandas(run, "id long, seg int, v array<double>, error string")


def track_embeddings(segments: DataFrame) -> DataFrame:
    """(id, v): the unit mean of the vectors of each track that has any."""
    return mean_vectors(segments.where("v IS NOT NULL"), ["id"], "v").select("id", l2(F.col("v")).alias("v"))


def text_matrix(spark, embedder: EmbedsText, prompts: dict[str, list[str]]) -> DataFrame:
    """(label, name, v): the unit mean of the unit vectors of each name's prompts, labels in the order given."""
    rows = []
    for label, (name, texts) in enumerate(prompts.items()):
        x = np.asarray(embedder.embed_text(texts), float)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
        rows.append((label, name, x.mean(0).tolist()))
    return spark.createDataFrame(rows, "label int, name string, v array<double>").withColumn("v", l2(F.col("v")))
