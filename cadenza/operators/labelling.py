"""Zero-shot labelling: similarities to a small label matrix, recentred, as probabilities.

The label matrix has a few dozen rows and is broadcast as one row of arrays; similarities and
probabilities of a track stay in one row, so nothing but the column means needs an aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions.vectors import bound, dot, l2, mean_vectors, softmax

TEMPERATURE, RECENTRE_FROM = 0.05, 5


def label_matrix(prompts: DataFrame) -> DataFrame:
    """(label, v): unit mean of the vectors of each label of ``prompts`` (label, v)."""
    return mean_vectors(prompts, ["label"], "v").select("label", l2(F.col("v")).alias("v"))


def similarities(df: DataFrame, matrix: DataFrame) -> DataFrame:
    """``df`` (id, v) with ``sims``, one number for each label in the order of labels."""
    m = matrix.agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "v"))), lambda s: s["v"]).alias("m"))
    return df.crossJoin(F.broadcast(m)).withColumn("sims", bound(l2(F.col("v")), lambda u: F.transform("m", lambda x: dot(x, u)))).drop("m")


def label_prior(sims: DataFrame) -> DataFrame:
    """(label, prior): mean similarity of each label."""
    return sims.select(F.posexplode("sims").alias("label", "s")).groupBy("label").agg(F.avg("s").alias("prior"))


def recentred(sims: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """With ``rec``: similarities less the prior, or less their own means from five rows on."""
    own = prior is None
    p = (label_prior(sims) if own else prior).agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "prior"))), lambda s: s["prior"]).alias("p"))
    if own:
        p = p.crossJoin(sims.agg(F.count(F.lit(1)).alias("n"))).select(F.when(F.col("n") >= RECENTRE_FROM, F.col("p")).otherwise(F.transform("p", lambda x: F.lit(0.0))).alias("p"))
    return sims.crossJoin(F.broadcast(p)).withColumn("rec", F.zip_with("sims", "p", lambda s, x: s - x)).drop("p")


def score_moods(df: DataFrame, matrix: DataFrame, prior: DataFrame | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """``df`` with sims, rec and probs."""
    return recentred(similarities(df, matrix), prior).withColumn("probs", softmax(F.col("rec"), temperature))


def top_labels(scored: DataFrame, k: int = 3) -> DataFrame:
    """``scored`` with ``top``: the k best (score, label) by score, ties to the lower label."""
    pairs = F.transform("probs", lambda p, i: F.struct((-p).alias("neg"), i.alias("label")))
    return scored.withColumn("top", F.transform(F.slice(F.array_sort(pairs), 1, k), lambda s: F.struct((-s["neg"]).alias("score"), s["label"].alias("label"))))


def score_axis(df: DataFrame, poles: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """(id, value): probability of pole 1 of two, recentred."""
    return score_moods(df, poles, temperature=temperature).select("id", F.col("probs")[1].alias("value"))


def cluster_profiles(scored: DataFrame, k: int = 3) -> DataFrame:
    """(cluster, rank, label, mean): the labels with the largest mean recentred similarity of each cluster."""
    mean = scored.select("cluster", F.posexplode("rec").alias("label", "r")).groupBy("cluster", "label").agg(F.avg("r").alias("mean"))
    return mean.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("mean"), "label"))).where(F.col("rank") <= k)


def name_clusters(labelled: DataFrame) -> DataFrame:
    """(cluster, label): the commonest top label, ties to the one seen first; ``labelled`` is (id, cluster, label)."""
    n = labelled.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "first"))).where("r = 1").select("cluster", "label", "n")


def compose(matrix: DataFrame, terms: dict[int, float]) -> DataFrame:
    """(v): unit weighted sum of label directions; unknown labels are left out."""
    weights = F.coalesce(*[F.when(F.col("label") == k, F.lit(float(w))) for k, w in terms.items()])
    long = matrix.withColumn("w", weights).where("w IS NOT NULL").select("w", F.posexplode("v").alias("p", "x")).groupBy("p").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    return long.agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("v")).select(l2(F.col("v")).alias("v"))


def redundancy(matrix: DataFrame) -> DataFrame:
    """(a, b, cos) of all pairs a < b of label directions; a few dozen rows, joined by a range."""
    a, b = (matrix.select(F.col("label").alias(n), F.col("v").alias(f"v{n}")) for n in "ab")
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", dot(F.col("va"), F.col("vb")).alias("cos"))


def redundancy_summary(matrix: DataFrame) -> DataFrame:
    """(mean, largest, pairs) of `redundancy`; zeros for fewer than two labels."""
    zero = F.lit(0.0)
    return redundancy(matrix).agg(F.coalesce(F.avg("cos"), zero).alias("mean"), F.coalesce(F.max("cos"), zero).alias("largest"), F.count(F.lit(1)).alias("pairs"))


def quality_metrics(tops: DataFrame) -> DataFrame:
    """(n_distinct, max_share, mean_margin, mean_top) of ``tops`` (top); rows with one label have a margin of 0."""
    t = tops.select(F.col("top")[0]["label"].alias("label"), F.col("top")[0]["score"].alias("a"), F.when(F.size("top") > 1, F.col("top")[1]["score"]).alias("b"))
    h = t.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n_distinct"), (F.max("n") / F.sum("n")).alias("max_share"))
    m = t.agg(F.avg(F.coalesce(F.col("a") - F.col("b"), F.lit(0.0))).alias("mean_margin"), F.avg("a").alias("mean_top"))
    return h.crossJoin(F.broadcast(m))


def prompt_table(spark, descriptors: list[str], templates: list[str]) -> DataFrame:
    """(label, prompt_no, descriptor, prompt): every descriptor in every template, each of which has one pair of braces."""
    if any(t.count("{}") != 1 for t in templates):
        raise ValueError("a template needs one {}")
    d = spark.createDataFrame(list(enumerate(descriptors)), "label int, descriptor string")
    t = spark.createDataFrame(list(enumerate(templates)), "prompt_no int, template string")
    return d.crossJoin(F.broadcast(t)).select("label", "prompt_no", "descriptor", F.expr("replace(template, '{}', descriptor)").alias("prompt"))


def attribute_priors(df: DataFrame, energy: DataFrame, valence: DataFrame) -> DataFrame:
    """(axis, label, prior): the mean similarity of each pole of both axes, to be kept and given to `attribute_scores`."""
    each = [label_prior(similarities(df, p)).select(F.lit(n).alias("axis"), "label", "prior") for n, p in (("energy", energy), ("valence", valence))]
    return each[0].unionByName(each[1])


def attribute_scores(df: DataFrame, energy: DataFrame, valence: DataFrame, priors: DataFrame | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """(id, energy, valence): probability of the upper pole of each axis, recentred by own means or given priors."""
    out = []
    for name, poles in (("energy", energy), ("valence", valence)):
        prior = None if priors is None else priors.where(F.col("axis") == name).select("label", "prior")
        out.append(score_moods(df.select("id", "v"), poles, prior, temperature).select("id", F.col("probs")[1].alias(name)))
    return out[0].join(out[1], "id")


def segment_arc(segments: DataFrame, matrix: DataFrame, prior: DataFrame | None = None, recentre: bool = True, temperature: float = TEMPERATURE, k: int = 3) -> DataFrame:
    """(track, seg, top) of ``segments`` (track, seg, v): the k best labels of each segment along a track.

    Similarities are recentred by the prior, or by the means of the track's own segments from five on.
    """
    s = similarities(segments, matrix)
    if not recentre:
        s = s.withColumn("rec", F.col("sims"))
    elif prior is not None:
        s = recentred(s, prior)
    else:
        own = mean_vectors(s, ["track"], "sims", "own").join(s.groupBy("track").agg(F.count(F.lit(1)).alias("_n")), "track")
        low = F.when(F.col("_n") >= RECENTRE_FROM, F.zip_with("sims", "own", lambda x, m: x - m)).otherwise(F.col("sims"))
        s = s.join(own, "track").withColumn("rec", low)
    return top_labels(s.withColumn("probs", softmax(F.col("rec"), temperature)), k).select("track", "seg", "top")
