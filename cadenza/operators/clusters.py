"""Cluster diagnostics from per-cluster vector sums, and cosine k-means.

Silhouettes, medoids and outlier scores need no pairs: the mean distance of a unit vector to a cluster is
one minus its product with the cluster's mean, so one aggregate and one join by cluster (of which there
are few) give exact values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions.vectors import dot, l2, mean_vectors, total


def cluster_sums(df: DataFrame) -> DataFrame:
    """(cluster, n, mean) of ``df`` (id, cluster, v) with unit vectors, noise (-1) left out."""
    u = df.where("cluster <> -1").select("cluster", l2(F.col("v")).alias("v"))
    return mean_vectors(u, ["cluster"], "v", "mean").join(u.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")), "cluster")


def silhouettes(df: DataFrame) -> DataFrame:
    """(id, cluster, s): exact cosine silhouette of every row that is not noise; 0 in a cluster of one."""
    c = cluster_sums(df).agg(F.collect_list(F.struct("cluster", "n", "mean")).alias("c"))
    rows = df.where("cluster <> -1").select("id", "cluster", l2(F.col("v")).alias("u")).crossJoin(F.broadcast(c))
    far = F.transform("c", lambda s: F.struct(s["cluster"].alias("cluster"), s["n"].alias("n"), (1 - dot(s["mean"], F.col("u"))).alias("d")))
    own = F.filter(F.col("far"), lambda s: s["cluster"] == F.col("cluster"))[0]
    rows = rows.withColumn("far", far).withColumn("own", own)
    a = F.col("own.d") * F.col("own.n") / F.nullif(F.col("own.n") - 1, F.lit(0))
    b = F.array_min(F.transform(F.filter("far", lambda s: s["cluster"] != F.col("cluster")), lambda s: s["d"]))
    return rows.select("id", "cluster", F.when(F.col("own.n") == 1, 0.0).otherwise((b - a) / F.greatest(a, b)).alias("s"))


def medoids(df: DataFrame) -> DataFrame:
    """(cluster, id): the row with the largest mean cosine to the others of its cluster, ties to the smaller id."""
    s = cluster_sums(df)
    rows = df.select("id", "cluster", l2(F.col("v")).alias("u")).join(F.broadcast(s), "cluster")
    ms = (dot(F.col("u"), F.col("mean")) * F.col("n") - dot(F.col("u"), F.col("u"))) / F.greatest(F.col("n") - 1, F.lit(1))
    best = rows.select("cluster", "id", ms.alias("ms")).groupBy("cluster").agg(F.max(F.struct("ms", (-F.col("id")).alias("neg"))).alias("m"))
    return best.select("cluster", (-F.col("m.neg")).alias("id"))


def outlier_scores(df: DataFrame) -> DataFrame:
    """(id, score): 1 minus the cosine to the centre of the cluster; noise scores 1."""
    c = cluster_sums(df).select("cluster", l2(F.col("mean")).alias("centre"))
    rows = df.join(F.broadcast(c), "cluster", "left")
    return rows.select("id", F.when(F.col("cluster") == -1, 1.0).otherwise(1 - dot(l2(F.col("v")), F.col("centre"))).alias("score"))


def coverage_entropy(df: DataFrame, base: float = 2.0) -> DataFrame:
    """Shannon entropy of cluster shares with noise as a share; normalised, 0 for one share; perplexity."""
    n = df.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    p = n.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("all")))).select((F.col("n") / F.col("all")).alias("p"))
    h = p.agg(F.sum(-F.col("p") * F.log(base, F.col("p"))).alias("entropy"), F.count(F.lit(1)).alias("bins"))
    share = F.when(F.col("bins") > 1, F.least(F.greatest(F.col("entropy") / F.log(base, F.col("bins").cast("double")), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return h.select("bins", "entropy", share.alias("normalised"), F.pow(F.lit(base), F.col("entropy")).alias("perplexity"))


def cluster_metrics(df: DataFrame) -> DataFrame:
    return df.agg(F.count_distinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("n_clusters"), F.avg((F.col("cluster") == -1).cast("double")).alias("noise_ratio"), F.count(F.lit(1)).alias("n"))


def mean_pairwise_cosine(df: DataFrame) -> DataFrame:
    """Squared length of the mean unit vector."""
    return mean_vectors(df.select(F.lit(0).alias("k"), l2(F.col("v")).alias("v")), ["k"], "v").select(total(F.transform("v", lambda x: x * x)).alias("mean_cosine"))


def spherical_step(df: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, cluster, v) with the cluster of the most similar centre; centres (cluster, c) are few and broadcast."""
    c = centres.agg(F.collect_list(F.struct("cluster", "c")).alias("cs"))
    scored = df.select("id", l2(F.col("v")).alias("v")).crossJoin(F.broadcast(c))
    best = F.array_min(F.transform("cs", lambda s: F.struct((-dot(s["c"], F.col("v"))).alias("neg"), s["cluster"].alias("cluster"))))
    return scored.select("id", best["cluster"].alias("cluster"), "v")


def spherical_kmeans(df: DataFrame, centres: DataFrame, steps: int) -> DataFrame:
    """Assignments after so many Lloyd steps from given centres; an empty cluster keeps its centre."""
    for _ in range(steps):
        moved = mean_vectors(spherical_step(df, centres), ["cluster"], "v").select("cluster", l2(F.col("v")).alias("m"))
        centres = centres.join(moved, "cluster", "left").select("cluster", F.coalesce("m", "c").alias("c"))
    return spherical_step(df, centres).select("id", "cluster")


def kmeans(df: DataFrame, k: int, seed: int = 0, starts: int = 10) -> DataFrame:
    """(id, cluster) by Euclidean k-means of the machine-learning library, the best of several seeds."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = df.select("id", array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    models = [KMeans(k=k, seed=seed + s).fit(x) for s in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(x).select("id", F.col("prediction").alias("cluster"))


def pca(df: DataFrame, k: int = 2) -> DataFrame:
    """(id, coords): projection on the first principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = df.select("id", array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    return PCA(k=k, inputCol="features", outputCol="p").fit(x).transform(x).select("id", vector_to_array("p").alias("coords"))


def agreement(df: DataFrame) -> DataFrame:
    """Adjusted Rand index and normalised mutual information of two labellings (a, b), from their contingency table."""
    t = df.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("n"))
    ra, rb, all_ = F.sum("n").over(Window.partitionBy("a")), F.sum("n").over(Window.partitionBy("b")), df.agg(F.count(F.lit(1)).cast("double").alias("all"))
    t = t.withColumn("ra", ra).withColumn("rb", rb).crossJoin(F.broadcast(all_))
    two = lambda x: x * (x - 1) / 2
    # a row of marginal a is met once for each b: dividing by what it shares spreads its term over them
    s = t.agg(F.first("all").alias("all"), F.sum(two(F.col("n"))).alias("i"), F.sum(two(F.col("ra")) * F.col("n") / F.col("ra")).alias("A"), F.sum(two(F.col("rb")) * F.col("n") / F.col("rb")).alias("B"), F.sum(F.col("n") / F.col("all") * F.ln(F.col("n") * F.col("all") / (F.col("ra") * F.col("rb")))).alias("mi"), F.sum(-F.col("n") / F.col("all") * F.ln(F.col("ra") / F.col("all"))).alias("ha"), F.sum(-F.col("n") / F.col("all") * F.ln(F.col("rb") / F.col("all"))).alias("hb"))
    e = F.col("A") * F.col("B") / two(F.col("all"))
    return s.select(((F.col("i") - e) / F.nullif(0.5 * (F.col("A") + F.col("B")) - e, F.lit(0.0))).alias("ari"), F.coalesce(F.col("mi") / F.nullif((F.col("ha") + F.col("hb")) / 2, F.lit(0.0)), F.lit(1.0)).alias("nmi"))
