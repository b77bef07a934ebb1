"""Learned heads on frozen vectors: projections, probes, what to label next, and their fitting."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions.vectors import dot, doubles, entropy, l2, margin

#: Logit of a label that all or none of the rows have.
SATURATED = 6.0
C_GRID = [10.0 ** (4 - k / 2) for k in range(17)]


def _rows(weights, bias=None) -> Column:
    """A small matrix as an array of rows, each with its bias."""
    weights = np.asarray(weights, float)
    bias = np.zeros(len(weights)) if bias is None else np.asarray(bias, float)
    if weights.ndim != 2 or len(bias) != len(weights):
        raise ValueError("a bias for each row of a matrix is needed")
    row = lambda w, b: F.struct(F.array(*map(F.lit, w)).alias("w"), F.lit(b).alias("b"))
    return F.array(*[row(w, b) for w, b in zip(weights.tolist(), bias.tolist(), strict=True)])


def _affine(v: Column, weights, bias=None) -> Column:
    return F.transform(_rows(weights, bias), lambda r: dot(r["w"], v) + r["b"])


def _guarded(df: DataFrame, width: int) -> DataFrame:
    """Fails in the task that meets a vector of another width."""
    wrong = F.concat(F.lit(f"a vector of width {width} is needed, not "), F.size("v").cast("string"))
    return df.withColumn("v", F.when(F.size("v") == width, doubles(F.col("v"))).otherwise(F.raise_error(wrong)))


def apply_projection(df: DataFrame, weights) -> DataFrame:
    """``df`` (id, v) with ``v`` replaced by the unit vector of weights times v."""
    return _guarded(df, np.shape(weights)[1]).withColumn("v", l2(_affine(F.col("v"), weights)))


@dataclass(frozen=True)
class ProbeHead:
    """Logits are w v + b, or with a hidden layer w relu(w0 v + b0) + b; one row for each name."""

    names: list[str]
    w: np.ndarray
    b: np.ndarray
    w0: np.ndarray | None = None
    b0: np.ndarray | None = None
    cv_score: float = float("nan")


def predict_probe(df: DataFrame, head: ProbeHead) -> DataFrame:
    """``df`` (id, v) with ``logits``, one for each name of the head."""
    first = head.w if head.w0 is None else head.w0
    hidden = F.col("v") if head.w0 is None else F.transform(_affine(F.col("v"), head.w0, head.b0), lambda x: F.greatest(x, F.lit(0.0)))
    return _guarded(df, np.shape(first)[1]).withColumn("logits", _affine(hidden, head.w, head.b))


def acquisition_score(probs: Column, strategy: str = "entropy") -> Column:
    """What to label next: entropy, or with ``margin`` one minus the lead of the best; 0 for a single class. Any other strategy is entropy."""
    score = 1 - margin(probs) if strategy == "margin" else entropy(probs)
    return F.when(F.size(probs) <= 1, 0.0).otherwise(score)


def diverse_subset(df: DataFrame, n: int, gamma: float = 1.0) -> DataFrame:
    """(step, id, score) of n rows of ``df`` (id, v, score), picked by score and distance to what is picked.

    Each step is one pass that adds gamma times one minus the largest cosine to the rows chosen so far;
    only the winner reaches the driver. Ties go to the smaller id. gamma 0 is the plain top n.
    """
    spark = df.sparkSession
    if gamma == 0:
        top = df.select("id", "score").orderBy(F.desc("score"), "id").limit(n)
        return top.withColumn("step", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).select("step", "id", "score")
    rows, chosen = df.select("id", "score", l2(F.col("v")).alias("v")), []
    while len(chosen) < n:
        value = F.col("score")
        if chosen:
            near = F.greatest(*[dot(F.col("v"), F.array(*map(F.lit, c["v"]))) for c in chosen], F.lit(-2.0))
            value = value + gamma * (1 - near)
        left = rows.where(~F.col("id").isin([c["id"] for c in chosen])) if chosen else rows
        got = left.withColumn("value", value).orderBy(F.desc("value"), "id").limit(1).collect()
        if not got:
            break
        chosen += got
    return spark.createDataFrame([(k + 1, c["id"], float(c["score"])) for k, c in enumerate(chosen)], "step int, id long, score double")


def average_precision(df: DataFrame) -> float | None:
    """Mean precision at the positives of (score, positive boolean), ties of scores taken together; None without positives."""
    n = df.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("positive").cast("long")).alias("p"))
    w = Window.orderBy(F.desc("score"))
    run = n.select("p", F.sum("n").over(w).alias("seen"), F.sum("p").over(w).alias("hits"))
    got = run.agg(F.sum(F.col("p") * F.col("hits") / F.col("seen")).alias("s"), F.sum("p").alias("p")).first()
    return got["s"] / got["p"] if got["p"] else None


def fit_linear_probe(df: DataFrame, names: list[str], c: float | None = None, grid: list[float] | None = None, folds: int = 3) -> ProbeHead:
    """One logistic model for each name over ``df`` (id, v, ys array of 0 and 1), classes weighted evenly.

    The strength c is the one of the grid, largest first, with the best mean average precision on folds dealt
    by a hash of the id within classes; a label of one class only gets a saturated constant.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    x = df.select("id", array_to_vector(doubles(F.col("v"))).alias("features"), "ys").persist()
    counts = x.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("ys")[k]).alias(f"p{k}") for k in range(len(names))]).first()
    n, width = counts["n"], len(df.select("v").first()["v"])

    def fit(rows: DataFrame, k: int, strength: float):
        y = F.col("ys")[k].cast("double")
        c_ = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("p")).first()
        if not c_["p"] or c_["p"] == c_["n"]:
            return None
        weight = F.when(y == 1, c_["n"] / (2 * c_["p"])).otherwise(c_["n"] / (2 * (c_["n"] - c_["p"])))
        lr = LogisticRegression(labelCol="y", weightCol="w", regParam=1 / (strength * c_["n"]), elasticNetParam=0.0, standardization=False)
        return lr.fit(rows.withColumn("y", y).withColumn("w", weight))

    def score(strength: float) -> float:
        found = []
        for k in range(len(names)):
            order = Window.partitionBy(F.col("ys")[k]).orderBy(F.xxhash64("id"), "id")
            dealt = x.withColumn("fold", F.row_number().over(order) % folds)
            for f in range(folds):
                m, held = fit(dealt.where(F.col("fold") != f), k, strength), dealt.where(F.col("fold") == f)
                if m is not None:
                    w = F.array(*map(F.lit, m.coefficients.toArray().tolist()))
                    vs = df.select("id", "v").join(held.select("id", "ys"), "id")
                    found.append(average_precision(vs.select(dot(w, F.col("v")).alias("score"), (F.col("ys")[k] == 1).alias("positive"))))
        found = [s for s in found if s is not None]
        return float(np.mean(found)) if found else float("nan")

    best, cv = c, float("nan")
    if c is None:
        scores = [(score(s), s) for s in sorted(grid or C_GRID, reverse=True)]
        known = [s for s in scores if s[0] == s[0]]
        cv, best = max(known, key=lambda s: s[0]) if known else (float("nan"), 1.0)
    w, b = np.zeros((len(names), width)), np.zeros(len(names))
    for k in range(len(names)):
        m = fit(x, k, best)
        if m is None:
            b[k] = SATURATED if counts[f"p{k}"] == n else -SATURATED
        else:
            w[k], b[k] = m.coefficients.toArray(), m.intercept
    x.unpersist()
    return ProbeHead(list(names), w, b, cv_score=cv)
