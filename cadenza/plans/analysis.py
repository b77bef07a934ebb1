"""A whole analysis: vectors to clusters, layout, labels, diagnostics and written results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.config import Config
from cadenza.errors import EmptyCollection
from cadenza.functions.lineage import cut
from cadenza.functions.music import structure_verdict
from cadenza.operators import clusters, labelling, similarity, structure



@dataclass(frozen=True)
class Clustering:
    labels: DataFrame
    metrics: dict


@dataclass(frozen=True)
class Analysis:
    assignments: DataFrame
    metrics: dict


def cluster_with(df: DataFrame, config: Config) -> DataFrame:
    """(id, cluster) of ``df`` (id, v) by the method of the settings; k is chosen by silhouette where it isn't set."""
    if config.method == "communities":
        found = structure.communities(similarity.knn_edges(df, config.neighbours), config.resolution)
        names = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cluster").collect()  # a few communities
        table = df.sparkSession.createDataFrame([(r["cluster"], k) for k, r in enumerate(names)], "old long, cluster int")
        return found.withColumnRenamed("cluster", "old").join(F.broadcast(table), "old").select("id", "cluster")
    k = config.k or structure.select_k(df, seed=config.seed)[0]
    if config.method == "spherical":
        return structure.fit_spherical_kmeans(df, k, seed=config.seed)
    return clusters.kmeans(df, k, config.seed)


def run_clustering(df: DataFrame, config: Config) -> Clustering:
    """Labels of ``df`` (id, v) and their metrics: counts, noise, silhouette of the vectors and what it says."""
    labels = cut(cluster_with(df, config), "labels")
    joined = df.select("id", "v").join(labels, "id")
    m = clusters.cluster_metrics(joined).first().asDict()
    s = clusters.silhouettes(joined).agg(F.avg("s").alias("s")) if m["n_clusters"] > 1 else df.sparkSession.createDataFrame([(None,)], "s double")
    row = s.select("s", structure_verdict(F.col("s")).alias("verdict")).first()
    return Clustering(labels, m | {"silhouette": row["s"], "verdict": row["verdict"]})


def attach_labels(tracks: DataFrame, vectors: DataFrame, matrix: DataFrame, poles: tuple[DataFrame, DataFrame] | None, config: Config) -> DataFrame:
    """``tracks`` (id, ...) with top_mood, top_score, mood_topk, mood_topk_scores, energy and valence.

    ``vectors`` (id, v) may lack tracks: those get '' and NaN and empty lists. ``matrix`` is (label, name, v).
    Similarities are recentred only where enough rows have vectors.
    """
    scored = labelling.top_labels(labelling.score_moods(vectors.select("id", "v"), matrix.select("label", "v"), temperature=config.temperature), config.top_labels)
    names = matrix.agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "name"))), lambda s: s["name"]).alias("names"))
    named = scored.select("id", "top").crossJoin(F.broadcast(names))
    moods = F.transform("top", lambda s: F.element_at(F.col("names"), s["label"] + 1))
    found = named.select("id", moods[0].alias("top_mood"), F.col("top")[0]["score"].alias("top_score"), moods.alias("mood_topk"), F.transform("top", lambda s: s["score"]).alias("mood_topk_scores"))
    nan = F.lit(float("nan"))
    axes = labelling.attribute_scores(vectors, *poles, temperature=config.temperature) if poles else vectors.select("id", nan.alias("energy"), nan.alias("valence"))
    out = tracks.join(found, "id", "left").join(axes, "id", "left")
    blanks = {"top_mood": F.lit(""), "top_score": nan, "mood_topk": F.array().cast("array<string>"), "mood_topk_scores": F.array().cast("array<double>"), "energy": nan, "valence": nan}
    return out.withColumns({c: F.coalesce(c, b) for c, b in blanks.items()})


def run_analysis(tracks: DataFrame, matrix: DataFrame, poles=None, config: Config | None = None, vectors: DataFrame | None = None) -> Analysis:
    """Assignments of ``tracks`` (id, path, v): cluster, layout in two dimensions, labels; ``vectors`` are those of the label space, the same by default."""
    config = config or Config()
    if not tracks.limit(1).count():
        raise EmptyCollection("there are no tracks")
    made = run_clustering(tracks, config)
    layout = clusters.pca(tracks).select("id", F.col("coords")[0].alias("x"), F.col("coords")[1].alias("y"))
    name = F.element_at(F.split("path", "/"), -1)
    base = tracks.select("id", "path", name.alias("filename")).join(made.labels, "id").join(layout, "id")
    return Analysis(attach_labels(base, vectors if vectors is not None else tracks, matrix, poles, config), made.metrics)


def compare_spaces(spaces: dict[str, DataFrame], config: Config, replicates: int = 5) -> DataFrame:
    """(space, n_clusters, noise_ratio, silhouette, verdict, mean_ari): how the same settings cluster several spaces (id, v)."""
    rows, spark = [], None
    for name, df in spaces.items():
        spark, made = df.sparkSession, run_clustering(df, config)
        stable = structure.bootstrap_stability(df, lambda d: cluster_with(d, config), replicates, seed=config.seed).first()
        m = made.metrics
        rows.append((name, int(m["n_clusters"]), float(m["noise_ratio"]), m["silhouette"], m["verdict"], stable["mean_ari"]))
    if spark is None:
        raise EmptyCollection("there are no spaces")
    return spark.createDataFrame(rows, "space string, n_clusters int, noise_ratio double, silhouette double, verdict string, mean_ari double")
