"""Play events to affinities, in batch and as a stream that shares the expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions.music import implicit_weight


def weighted(events: DataFrame) -> DataFrame:
    """``events`` (track, event, position) with their weights, without those that only expose a track."""
    return events.withColumn("weight", implicit_weight(F.col("event"), F.col("position"))).where("weight <> 0")


def aggregate_implicit(events: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(track, affinity): tanh of alpha times the sum of weights. For a stream, run it in update or complete mode."""
    return weighted(events).groupBy("track").agg(F.tanh(alpha * F.sum("weight")).alias("affinity"))


def sessions(events: DataFrame, gap_minutes: int) -> DataFrame:
    """(key, session, n): runs of events (key, ts) without a gap of more than so many minutes."""
    w = Window.partitionBy("key").orderBy("ts")
    new = F.coalesce((F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)) > gap_minutes * 60_000_000).cast("int"), F.lit(1))
    numbered = events.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("key", "session").agg(F.count(F.lit(1)).alias("n"))


def session_stream(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """The same for a stream: session windows closed by a watermark."""
    return events.withWatermark("ts", late).groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
