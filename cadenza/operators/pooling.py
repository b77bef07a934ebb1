"""Pooling of frames over layers, segments and tracks, prototypes, and fusion of two spaces."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.vectors import doubles, l2, mean_vectors

LAYER_MODES = ("mean", "last", "subset", "weighted")


def layer_weights(weights: list[float], n_layers: int) -> list[float]:
    """Softmax of one weight for each layer."""
    if len(weights) != n_layers:
        raise ValueError(f"{len(weights)} weights for {n_layers} layers")
    top = max(weights)
    mass = [math.exp(w - top) for w in weights]
    return [m / sum(mass) for m in mass]


def subset_layers(n_layers: int, layers: list[int] | None = None) -> list[int]:
    """The layers asked for that there are, negative ones from the end; by default the middle third, both ends included."""
    asked = range(n_layers // 3, 2 * n_layers // 3 + 1) if layers is None else [k + n_layers if k < 0 else k for k in layers]
    found = sorted({k for k in asked if 0 <= k < n_layers})
    if not found:
        raise ValueError("none of the layers asked for is there")
    return found


def weight_layers(frames: DataFrame, mode: str = "mean", layers: list[int] | None = None, weights: list[float] | None = None) -> DataFrame:
    """``frames`` (track, seg, layer, frame, v) without layers: (track, seg, frame, v).

    mode: the mean of all layers, the last one, the mean of a subset, or a mean weighted by a softmax of
    ``weights``. Layers are numbered from 0; only their number reaches the driver. No frames give no rows.
    """
    if mode not in LAYER_MODES:
        raise ValueError(f"mode must be one of {LAYER_MODES}")
    keys = ["track", "seg", "frame"]
    if mode == "mean":
        return mean_vectors(frames, keys, "v")
    n = (frames.agg(F.max("layer").alias("n")).first()["n"] or 0) + 1
    if mode == "last":
        return frames.where(F.col("layer") == n - 1).select(*keys, doubles(F.col("v")).alias("v"))
    if mode == "subset":
        return mean_vectors(frames.where(F.col("layer").isin(subset_layers(n, layers))), keys, "v")
    share = F.element_at(F.array(*map(F.lit, layer_weights(weights or [], n))), (F.col("layer") + 1).cast("int"))
    return mean_vectors(frames.withColumn("v", F.transform(doubles(F.col("v")), lambda x: x * share * n)), keys, "v")


def pool_frames(df: DataFrame, keys: list[str], mode: str = "mean") -> DataFrame:
    """(keys, v): the mean vector of each group, or with ``mean_std`` the means and population deviations behind each other."""
    if mode == "mean":
        return mean_vectors(df, keys, "v")
    if mode != "mean_std":
        raise ValueError("mode must be mean or mean_std")
    long = df.select(*keys, F.posexplode(doubles(F.col("v"))).alias("_p", "_x"))
    each = long.groupBy(*keys, "_p").agg(F.avg("_x").alias("_m"), F.stddev_pop("_x").alias("_s"))
    rows = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_p", "_m", "_s"))).alias("_r"))
    both = F.concat(F.transform("_r", lambda r: r["_m"]), F.transform("_r", lambda r: r["_s"]))
    return rows.select(*keys, both.alias("v"))


def pool_layered(frames: DataFrame, mode: str = "mean", pool: str = "mean", **layers) -> DataFrame:
    """(track, v) of unit length: layers collapsed in each segment, then all frames of a track pooled, each counting the same."""
    return pool_frames(weight_layers(frames, mode, **layers), ["track"], pool).select("track", l2(F.col("v")).alias("v"))


def prototypes(examples: DataFrame, key: str = "label") -> DataFrame:
    """(key, v): unit mean of the example vectors of each key; a key without examples has no row."""
    return mean_vectors(examples, [key], "v").select(key, l2(F.col("v")).alias("v"))


def fused(a: DataFrame, b: DataFrame, weights: tuple[float, float] = (0.5, 0.5), key: str = "path") -> DataFrame:
    """(key, v) of rows that both spaces (key, v) have: unit vectors, scaled by their weights, behind each other."""
    left, right = (df.select(key, l2(F.col("v")).alias(f"_{n}")) for n, df in (("a", a), ("b", b)))
    scaled = lambda name, w: F.transform(name, lambda x: x * float(w))
    return left.join(right, key).select(key, F.concat(scaled("_a", weights[0]), scaled("_b", weights[1])).alias("v"))
