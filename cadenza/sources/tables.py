"""Sources and sinks: gold labels, model tables, a cache of vectors, wave files, playlists and reports."""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOLD = "map<string,struct<moods:array<string>,energy:double,valence:double>>"


def load_gold(spark: SparkSession, path: str) -> DataFrame:
    """(filename, moods, energy, valence) from a JSON object by file name; what cannot be parsed gives no rows."""
    m = spark.read.text(path, wholetext=True).select(F.from_json("value", GOLD).alias("m"))
    return m.select(F.explode("m").alias("filename", "g")).select("filename", "g.*")


def fingerprint(content: str = "content"):
    return F.substring(F.sha1(content), 1, 16)


def cache_key(model: str, print_, extra: str = ""):
    return F.concat_ws("__", F.lit(model.replace("/", "_")), print_, *([F.lit(extra)] if extra else []))


def discover(spark: SparkSession, path: str, pattern: str = "*.wav", recursive: bool = True) -> DataFrame:
    """(path, content, key) of files below a folder, in order of paths."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", "content", fingerprint().alias("key")).orderBy("path")


def decode_wave(files: DataFrame) -> DataFrame:
    """(path, sr, samples, error): 16-bit waves as mono floats; a file that is no wave gives an error, not a failure."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels()).mean(axis=1) / 32768
                        rows.append((path, w.getframerate(), x.astype(np.float32), None))
                except (wave.Error, EOFError, ValueError) as e:
                    rows.append((path, None, None, str(e) or type(e).__name__))
            kinds = [pa.string(), pa.int32(), pa.list_(pa.float32()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "sr", "samples", "error"])

    return files.mapInArrow(run, "path string, sr int, samples array<float>, error string")


def missing(inputs: DataFrame, cache: DataFrame) -> DataFrame:
    """Inputs (key, ...) whose key the cache lacks."""
    return inputs.join(cache.select("key"), "key", "left_anti")


def save_model(spark: SparkSession, path: str, model: str, arrays: dict[str, np.ndarray]) -> None:
    """A model as a table: one row for each named array, with its shape."""
    rows = [(model, k, list(map(int, a.shape)), a.ravel().astype(float).tolist()) for k, a in arrays.items()]
    spark.createDataFrame(rows, "model string, name string, shape array<int>, data array<double>").write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str, model: str) -> dict[str, np.ndarray]:
    rows = spark.read.parquet(path).where(F.col("model") == model).collect()
    if not rows:
        raise ValueError(f"no model {model} in {path}")
    out = {}
    for r in rows:
        if int(np.prod(r["shape"])) != len(r["data"]):
            raise ValueError(f"array {r['name']} does not fit its shape")
        out[r["name"]] = np.array(r["data"]).reshape(r["shape"])
    return out


def write_playlists(assigned: DataFrame, path: str) -> None:
    """One text folder for each cluster of (cluster, pos, path), its paths in order."""
    assigned.select("cluster", "path").repartition("cluster").sortWithinPartitions("cluster", "path").write.mode("overwrite").partitionBy("cluster").text(path)


def cluster_report(assigned: DataFrame) -> DataFrame:
    """(cluster, n, energy, valence, examples): report rows, noise last by its key; NaN does not count in means."""
    num = lambda c: F.avg(F.when(~F.isnan(c), F.col(c)))
    return assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), num("energy").alias("energy"), num("valence").alias("valence"), F.concat_ws(",", F.transform(F.slice(F.array_sort(F.collect_list(F.struct("id"))), 1, 6), lambda s: s["id"].cast("string"))).alias("examples"))


def hover_text(columns: list[str]):
    """``filename``, moods with their percentages, energy and valence of a row, on lines of their own; what is not there is left out."""
    parts = [F.col("filename")]
    if "mood_topk" in columns and "mood_topk_scores" in columns:
        each = F.zip_with("mood_topk", "mood_topk_scores", lambda m, s: F.concat(m, F.lit(" "), F.round(100 * s).cast("int").cast("string"), F.lit("%")))
        parts.append(F.when(F.size("mood_topk") > 0, F.concat(F.lit("moods: "), F.array_join(each, ", "))))
    if "energy" in columns and "valence" in columns:
        known = ~F.isnan("energy") & ~F.isnan("valence")
        parts.append(F.when(known, F.format_string("energy %.2f \u00b7 valence %.2f", F.col("energy"), F.col("valence"))))
    return F.concat_ws("<br>", *parts)
