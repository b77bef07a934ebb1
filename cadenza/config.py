"""Settings of an analysis, as plain values."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class Segments:
    seconds: float = 10.0
    overlap: float = 0.0
    least: float = 1.0
    cap: int = 12


@dataclass(frozen=True)
class Config:
    """Values that decide what an analysis computes; `tag` names all that change vectors."""

    model: str = "hashing"
    segments: Segments = field(default_factory=Segments)
    layer_mode: str = "mean"
    layers: tuple[int, ...] | None = None
    layer_weights: tuple[float, ...] | None = None
    pool: str = "mean"
    fusion: tuple[float, float] = (0.5, 0.5)
    method: str = "kmeans"
    k: int | None = None
    neighbours: int = 15
    resolution: float = 1.0
    temperature: float = 0.05
    top_labels: int = 3
    replicates: int = 50
    seed: int = 0

    def __post_init__(self):
        if self.method not in ("kmeans", "spherical", "communities"):
            raise ValueError(f"no clustering method {self.method}")
        if self.pool not in ("mean", "mean_std"):
            raise ValueError("pool must be mean or mean_std")
        if self.segments.seconds <= 0 or self.segments.overlap < 0:
            raise ValueError("segments need a positive length and no negative overlap")

    def tag(self) -> str:
        """'' for default settings, else cfg- and ten digits of a hash of every setting that vectors depend on."""
        keys = ("segments", "layer_mode", "layers", "layer_weights", "pool")
        mine, plain = ({k: asdict(c)[k] for k in keys} for c in (self, Config()))
        if mine == plain:
            return ""
        return "cfg-" + hashlib.sha1(json.dumps(mine, sort_keys=True, default=list).encode()).hexdigest()[:10]
