"""Ranking, agreement and calibration metrics as aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions.lineage import cut


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """``df`` with ranks from 1, ties sharing their mean: counts of distinct values, accumulated, joined back.

    Values are dealt out by range and accumulated within each part, to which the sum of the parts before is
    added; only those sums, one a part, are brought together.
    """
    n = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n")).repartitionByRange(F.col(value))
    n = cut(n.withColumn("_part", F.spark_partition_id()), "counts")  # written, so that ranges are drawn once
    parts = n.groupBy("_part").agg(F.sum("_n").alias("_sum"))
    before = parts.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))
    upto = n.join(F.broadcast(before), "_part").withColumn("_upto", F.col("_before") + F.sum("_n").over(Window.partitionBy("_part").orderBy(value)))
    return df.join(upto.select(value, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(out)), value)


def roc_auc(df: DataFrame) -> DataFrame:
    """(auc, n) of ``df`` (score, positive boolean) with ties; 0.5 if a class is missing."""
    r = average_ranks(df, "score", "rank").agg(F.sum(F.when(F.col("positive"), F.col("rank"))).alias("s"), F.sum(F.col("positive").cast("double")).alias("p"), F.count(F.lit(1)).alias("n"))
    auc = (F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * (F.col("n") - F.col("p")), F.lit(0.0))
    return r.select(F.coalesce(auc, F.lit(0.5)).alias("auc"), "n")


def ranking_metrics(ranked: DataFrame, k: int) -> DataFrame:
    """P@k, recall@k, average precision and nDCG@k of each query; ``ranked`` is (query, rank, relevant boolean), ranks from 1."""
    rel = F.col("relevant").cast("double")
    hits = F.sum(rel).over(Window.partitionBy("query").orderBy("rank"))
    r = ranked.withColumn("rel", rel).withColumn("hits", hits)
    g = r.groupBy("query").agg(F.sum("rel").alias("n"), F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0.0)).alias("at"), F.sum(F.when(F.col("rel") > 0, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("ap"), F.sum(F.when(F.col("rank") <= k, F.col("rel") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("n"), F.lit(float(k))), F.lit(1.0)).cast("int")), F.lit(0.0), lambda s, x: s + 1 / F.log2(x.cast("double") + 1))
    by = lambda x: F.coalesce(x / F.nullif(F.col("n"), F.lit(0.0)), F.lit(0.0))
    return g.select("query", (F.col("at") / k).alias("precision"), by(F.col("at")).alias("recall"), by(F.col("ap")).alias("average_precision"), F.when(F.col("n") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"))


def concordance(df: DataFrame) -> DataFrame:
    """(ccc, pearson, bias) of pairs (a, b), population moments; null where a series is constant."""
    m = df.agg(F.covar_pop("a", "b").alias("c"), F.var_pop("a").alias("va"), F.var_pop("b").alias("vb"), F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.corr("a", "b").alias("pearson"))
    v = F.sqrt(F.col("va") / F.nullif(F.col("vb"), F.lit(0.0)))
    u = (F.col("ma") - F.col("mb")) / F.nullif(F.sqrt(F.sqrt(F.col("va")) * F.sqrt(F.col("vb"))), F.lit(0.0))
    return m.select((2 * F.col("c") / F.nullif(F.col("va") + F.col("vb") + F.pow(F.col("ma") - F.col("mb"), 2), F.lit(0.0))).alias("ccc"), "pearson", (2 / (v + 1 / v + u * u)).alias("bias"))


def spearman(df: DataFrame) -> DataFrame:
    return average_ranks(average_ranks(df, "a", "ra"), "b", "rb").agg(F.corr("ra", "rb").alias("spearman"))


def macro_f1(df: DataFrame) -> DataFrame:
    """(macro_f1, n) of (truth, predicted) over all labels of either side; a label without any counts 0."""
    n = df.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    each = n.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("x"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"), "n")
    f = each.groupBy("x.label").agg((F.sum("hit") / F.sum("n")).alias("f"))  # hits count on both sides, as the sums of truths and predictions do
    return f.agg(F.avg("f").alias("macro_f1"))


def binned(conf: Column, bins: int) -> Column:
    return F.least(F.floor(conf * bins), F.lit(bins - 1)).cast("int")


def reliability(df: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy) of (conf, correct) in bins of equal width, the last one closed."""
    return df.groupBy(binned(F.col("conf"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def expected_calibration_error(df: DataFrame, bins: int = 10) -> DataFrame:
    r = reliability(df, bins)
    return r.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))


def negative_log_likelihood(df: DataFrame) -> DataFrame:
    """(nll) of (probs, label)."""
    p = F.element_at("probs", (F.col("label") + 1).cast("int"))
    return df.agg(F.avg(-F.ln(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-12)))).alias("nll"))


def aps_scores(df: DataFrame) -> DataFrame:
    """``df`` (probs, label) with ``score``: mass of labels ranked at or above the true one, ties to the lower label."""
    p = F.element_at("probs", (F.col("label") + 1).cast("int"))
    up = F.aggregate(F.transform("probs", lambda x, i: F.when((x > p) | ((x == p) & (i <= F.col("label"))), x).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn("score", up)


def aps_threshold(scored: DataFrame, coverage: float) -> DataFrame:
    """(q_hat): the ceil((n + 1) coverage)-th smallest score; 1 beyond the last, 0 before the first."""
    from cadenza.operators.calibration import conformal_threshold

    return scored.sparkSession.createDataFrame([(conformal_threshold(scored, coverage),)], "q_hat double")


def prediction_sets(df: DataFrame, q_hat: float) -> DataFrame:
    """``df`` with ``labels``: the shortest run of best labels whose mass reaches q_hat, one at least."""
    order = F.array_sort(F.transform("probs", lambda p, i: F.struct((-p).alias("neg"), i.alias("label"))))
    walked = F.aggregate("order", F.struct(F.lit(0.0).alias("mass"), F.array().cast("array<int>").alias("labels")), lambda s, x: F.when((F.size(s["labels"]) == 0) | (s["mass"] < q_hat), F.struct((s["mass"] - x["neg"]).alias("mass"), F.concat(s["labels"], F.array(x["label"])).alias("labels"))).otherwise(s))
    return df.withColumn("order", order).withColumn("labels", walked["labels"]).drop("order")


def fit_temperature(df: DataFrame, grid: list[float]) -> DataFrame:
    """(temperature, nll) of the best of a grid for (logits, label): one pass, one sum for each temperature."""
    y = F.element_at("logits", (F.col("label") + 1).cast("int"))
    top = F.array_max("logits")

    def loss(t: float):
        mass = F.aggregate(F.transform("logits", lambda x: F.exp((x - top) / t)), F.lit(0.0), lambda s, x: s + x)
        return F.avg(F.least(F.ln(mass) - (y - top) / t, F.lit(27.631021115928547)))  # the loss of a probability of 1e-12

    each = [loss(t) for t in grid]
    rows = df.agg(F.array(*[F.struct(e.alias("nll"), F.lit(t).alias("temperature")) for e, t in zip(each, grid, strict=True)]).alias("r"))
    return rows.select(F.array_min("r").alias("b")).select("b.temperature", "b.nll")
