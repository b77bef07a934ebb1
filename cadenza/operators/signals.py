"""Segments of a waveform by sample counts, tempo from beats, keys from chroma."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Tonal profiles of major and minor keys, from the tonic upward.
MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]


RUN_SEGMENTS = 1024


def segment_bounds(df: DataFrame, sr: int, seconds: float, overlap: float = 0.0, least: float = 1.0) -> DataFrame:
    """(id, seg, start, end) in seconds for ``df`` (id, n_samples): full windows, then the rest if it is long enough; a short whole is kept.

    Segments are counted first and dealt out in runs of a bounded number, so that neither a small file nor a long wave is left to one task.
    """
    size, low = round(seconds * sr), round(least * sr)
    step = max(1, size - min(round(overlap * sr), size - 1))
    n, full, run = F.col("n"), F.col("full"), F.lit(RUN_SEGMENTS)
    windows = F.when(n >= size, F.floor((n - size) / F.lit(float(step))) + 1).otherwise(F.lit(0)).cast("long")
    left = n - full * step
    kept = full + F.when((left > 0) & ((left >= low) | (full == 0)), 1).otherwise(0)
    counted = df.where(F.col("n_samples") > 0).select("id", F.col("n_samples").cast("long").alias("n")).withColumn("full", windows).select("id", "n", kept.alias("kept")).where("kept > 0")
    runs = counted.select("id", "n", "kept", F.explode(F.sequence(F.lit(0).cast("long"), F.col("kept") - 1, run.cast("long"))).alias("first"))
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    segs = runs.repartition(parts, "id", "first").select("id", "n", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + run, F.col("kept")) - 1)).alias("seg"))
    at = F.col("seg") * step
    return segs.select("id", F.col("seg").cast("int").alias("seg"), (at / F.lit(float(sr))).alias("start"), (F.least(at + size, n) / F.lit(float(sr))).alias("end"))


def capped(count: Column, cap: int) -> Column:
    """Indices of ``count`` windows that an even cap keeps: rounded half to even, without repeats; all if cap <= 0."""
    every = F.sequence(F.lit(0), count - 1)
    if cap <= 0:
        return every
    even = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda i: F.rint(i * (count - 1) / F.lit(float(max(cap - 1, 1)))).cast("int"))
    return F.when(count <= cap, every).otherwise(F.array_distinct(even))


def tempo(df: DataFrame) -> DataFrame:
    """(key, bpm, cv, beats) of beat times (key, t) in seconds: 60 over the mean interval, and the relative spread of intervals."""
    w = Window.partitionBy("key").orderBy("t")
    i = df.withColumn("d", F.col("t") - F.lag("t").over(w)).where("d > 0")
    return i.groupBy("key").agg((60 / F.avg("d")).alias("bpm"), (F.stddev_pop("d") / F.avg("d")).alias("cv"), F.count(F.lit(1)).alias("beats"))


def estimate_key(df: DataFrame) -> DataFrame:
    """(id, pitch, minor, r, confidence) of ``df`` (id, chroma of 12): best correlation with 24 turned profiles; ties by pitch, then major."""
    profiles = [(p, m, [base[(k - p) % 12] for k in range(12)]) for p in range(12) for m, base in ((False, MAJOR), (True, MINOR))]
    c = F.transform("chroma", lambda x: x.cast("double"))

    def corr(profile):
        mean = sum(profile) / 12
        dev = [x - mean for x in profile]
        size = sum(x * x for x in dev) ** 0.5
        avg = F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / 12
        cov = F.aggregate(F.zip_with(c, F.array(*map(F.lit, dev)), lambda x, y: (x - avg) * y), F.lit(0.0), lambda s, x: s + x)
        var = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + (x - avg) * (x - avg)))
        return F.coalesce(cov / F.nullif(var * size, F.lit(0.0)), F.lit(0.0))

    each = F.array_sort(F.array(*[F.struct((-corr(v)).alias("neg"), F.lit(p).alias("pitch"), F.lit(m).alias("minor")) for p, m, v in profiles]))
    r = df.select("id", each.alias("k"))
    return r.select("id", F.col("k")[0]["pitch"].alias("pitch"), F.col("k")[0]["minor"].alias("minor"), (-F.col("k")[0]["neg"]).alias("r"), F.least(F.greatest(F.col("k")[1]["neg"] - F.col("k")[0]["neg"], F.lit(0.0)), F.lit(1.0)).alias("confidence"))
