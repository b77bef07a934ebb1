"""Scalar rules on tempo, keys and play events, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wheel numbers of the twelve pitch classes in major.
CAMELOT_MAJOR = [8, 3, 10, 5, 12, 7, 2, 9, 4, 11, 6, 1]


def tempo_compat(a: Column, b: Column, sigma: float = 0.05) -> Column:
    """Gaussian of the smallest octave distance over ratios 1, 2 and 1/2; 0 for tempos that are not positive."""
    d = F.least(*[F.abs(F.log2(a * r / b)) for r in (1.0, 2.0, 0.5)])
    return F.when((a > 0) & (b > 0) & ~F.isnan(a) & ~F.isnan(b), F.exp(-F.pow(d / sigma, 2) / 2)).otherwise(0.0)


def fold_octave(bpm: Column, low: float = 70.0, high: float = 180.0) -> Column:
    """Doubled or halved into [low, high); null where that means nothing."""
    up = bpm * F.pow(F.lit(2.0), F.ceil(F.log2(low / bpm)))
    down = bpm / F.pow(F.lit(2.0), F.floor(F.log2(bpm / high)) + 1)
    return F.when((bpm > 0) & (bpm < float("inf")), F.when(bpm < low, up).when(bpm >= high, down).otherwise(bpm))


def to_camelot(pitch: Column, minor: Column) -> Column:
    table = F.array(*map(F.lit, CAMELOT_MAJOR))
    at = F.pmod(pitch + F.when(minor, 3).otherwise(0), F.lit(12))
    return F.concat(F.element_at(table, (at + 1).cast("int")).cast("string"), F.when(minor, "A").otherwise("B"))


def camelot_neighbours(code: Column) -> Column:
    n, letter = F.regexp_extract(code, r"^(\d+)[AB]$", 1).cast("int"), F.substring(code, -1, 1)
    text = lambda k: (F.pmod(k - 1, F.lit(12)) + 1).cast("string")
    other = F.when(letter == "A", "B").otherwise("A")
    return F.array(F.concat(text(n - 1), letter), F.concat(text(n + 1), letter), F.concat(n.cast("string"), other))


def camelot_harmony(a: Column, b: Column) -> Column:
    formed = a.rlike(r"^\d+[AB]$") & b.rlike(r"^\d+[AB]$")
    return F.when(a == b, 1.0).when(formed & F.array_contains(camelot_neighbours(F.when(formed, b).otherwise(F.lit("1A"))), a), 0.5).otherwise(0.0)


def implicit_weight(event: Column, position: Column) -> Column:
    """complete and replay 1, skip from -1 to 0 by how late it comes, anything else 0."""
    pos = F.least(F.greatest(position, F.lit(0.0)), F.lit(1.0))
    skip = F.when(pos < 0.2, -1.0).otherwise(-F.greatest(F.lit(0.0), 1 - (pos - 0.2) / 0.8))
    return F.when(event.isin("complete", "replay"), 1.0).when(event == "skip", skip).otherwise(0.0)


def structure_verdict(silhouette: Column) -> Column:
    return F.when(silhouette.isNull() | F.isnan(silhouette), None).when(silhouette <= 0.05, "none_detected").when(silhouette <= 0.25, "weak").otherwise("clustered")
