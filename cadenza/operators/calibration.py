"""Calibration of confidences and conformal sets with a rank penalty."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.lineage import cut
from cadenza.functions.vectors import total
from cadenza.operators.metrics import fit_temperature

BOUNDS = (1e-3, 100.0)


def search_temperature(df: DataFrame, bounds: tuple[float, float] = BOUNDS, tolerance: float = 1e-6, points: int = 17) -> DataFrame:
    """(temperature, nll) that is least over a range for (logits, label).

    Each pass looks at ``points`` temperatures, evenly spread on a logarithmic scale, in one aggregate and goes on
    between the neighbours of the best one. One row reaches the driver in each pass.
    """
    low, high = map(math.log, bounds)
    df = cut(df.select("logits", "label"), "logits")
    while True:
        grid = [math.exp(low + (high - low) * k / (points - 1)) for k in range(points)]
        best = fit_temperature(df, grid)
        row = best.first()
        if row is None or row["temperature"] is None or math.exp(high) - math.exp(low) < tolerance:
            return best
        at = min(range(points), key=lambda k: abs(grid[k] - row["temperature"]))
        low, high = math.log(grid[max(at - 1, 0)]), math.log(grid[min(at + 1, points - 1)])


def platt(df: DataFrame, steps: int = 50, tolerance: float = 1e-10) -> tuple[float, float]:
    """(a, b) of the logistic curve 1 / (1 + exp(-(a conf + b))) over (conf, correct); (0, 0) for one class or one value.

    Newton steps, each one aggregate of five sums; a step is halved until the loss falls. The rows are written once.
    """
    x, y = F.col("conf").cast("double"), F.col("correct").cast("double")
    rows = cut(df.select(x.alias("x"), y.alias("y")).where(x.isNotNull() & y.isNotNull()), "outcomes")
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"), F.min("x").alias("low"), F.max("x").alias("high")).first()
    if not s["n"] or s["p"] in (0, s["n"]) or s["low"] == s["high"]:
        return 0.0, 0.0

    def at(a: float, b: float):
        z = F.col("x") * a + b
        p = 1 / (1 + F.exp(-z))
        w = p * (1 - p)
        softplus = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
        sums = {"loss": softplus - F.col("y") * z, "ga": (p - F.col("y")) * F.col("x"), "gb": p - F.col("y"), "haa": w * F.col("x") * F.col("x"), "hab": w * F.col("x"), "hbb": w}
        return rows.agg(*[F.sum(c).alias(k) for k, c in sums.items()]).first()

    a, b = 0.0, 0.0
    now = at(a, b)
    for _ in range(steps):
        det = now["haa"] * now["hbb"] - now["hab"] ** 2
        if det <= 0:
            break
        da, db = (now["hbb"] * now["ga"] - now["hab"] * now["gb"]) / det, (now["haa"] * now["gb"] - now["hab"] * now["ga"]) / det
        step = 1.0
        while (new := at(a - step * da, b - step * db))["loss"] > now["loss"] and step > 1e-6:
            step /= 2
        a, b, moved, now = a - step * da, b - step * db, abs(step * da) + abs(step * db), new
        if moved < tolerance:
            break
    return a, b


def isotonic(df: DataFrame) -> DataFrame:
    """(conf, calibrated) of each distinct confidence of (conf, correct): the closest rising curve, by the library's parallel pooling."""
    from pyspark.ml.regression import IsotonicRegression

    rows = df.groupBy(F.col("conf").cast("double").alias("conf")).agg(F.avg(F.col("correct").cast("double")).alias("y"), F.count(F.lit(1)).cast("double").alias("w"))
    if not rows.limit(1).count():
        return rows.select("conf", F.col("y").alias("calibrated"))
    model = IsotonicRegression(featuresCol="conf", labelCol="y", weightCol="w").fit(rows)
    return model.transform(rows).select("conf", F.col("prediction").alias("calibrated"))


def conformal_scores(df: DataFrame, k_reg: int = 0, lam_reg: float = 0.0) -> DataFrame:
    """``df`` (probs, label) with ``score``: mass ranked at or above the true label, ties to the lower label, and a penalty for each rank beyond k_reg.

    A label outside the row's classes or a probability that is not finite fails the query.
    """
    p = F.element_at("probs", (F.col("label") + 1).cast("int"))
    above = F.filter(F.transform("probs", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: (s["x"] > p) | ((s["x"] == p) & (s["i"] <= F.col("label"))))
    mass = total(F.transform(above, lambda s: s["x"]))
    score = mass + lam_reg * F.greatest(F.size(above) - k_reg, F.lit(0)) if lam_reg > 0 else mass
    bad = (F.col("label") < 0) | (F.col("label") >= F.size("probs")) | F.exists("probs", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return df.withColumn("score", F.when(bad, F.raise_error(F.lit("a label without a class, or a probability that is not finite")).cast("double")).otherwise(score))


def conformal_threshold(scored: DataFrame, coverage: float, lam_reg: float = 0.0) -> float:
    """The ceil((n + 1) coverage)-th smallest score: 0 before the first, beyond the last 1, or infinite with a penalty.

    Scores are written once. Only counts travel: a histogram of equal bins narrows the range that holds the rank until one value is left
    or so few that they are fetched.
    """
    bins, few = 1024, 10_000
    rows, below = cut(scored.select(F.col("score").cast("double").alias("s")), "scores"), 0
    low, high, n = rows.agg(F.min("s"), F.max("s"), F.count(F.lit(1))).first()
    k, inside = math.ceil((n + 1) * coverage), n
    if k < 1:
        return 0.0
    if k > n:
        return 1.0 if lam_reg <= 0 else float("inf")
    while inside > few and high > low:
        width = (high - low) / bins
        span = rows.where(F.col("s").between(low, high)).select("s", F.least(F.floor((F.col("s") - low) / width), F.lit(bins - 1)).alias("b"))
        seen = below
        for r in sorted(span.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).collect()):
            if seen + r["n"] >= k:
                below, low, high, inside = seen, r["low"], r["high"], r["n"]
                break
            seen += r["n"]
    if high <= low:
        q = low
    else:
        q = sorted(r["s"] for r in rows.where(F.col("s").between(low, high)).collect())[k - below - 1]
    return max(q, 0.0) if lam_reg > 0 else min(max(q, 0.0), 1.0)


def conformal_sets(df: DataFrame, q_hat: float, k_reg: int = 0, lam_reg: float = 0.0) -> DataFrame:
    """``df`` (probs) with ``labels``: the shortest run of best labels whose mass, with the penalty, reaches q_hat; one at least."""
    order = F.array_sort(F.transform("probs", lambda p, i: F.struct((-p).alias("neg"), i.alias("label"))))
    start = F.struct(F.lit(0.0).alias("mass"), F.lit(False).alias("done"), F.array().cast("array<int>").alias("labels"))

    def step(s, x):
        mass = s["mass"] - x["neg"]
        rank = F.size(s["labels"]) + 1
        reached = mass + lam_reg * F.greatest(rank - k_reg, F.lit(0)) >= q_hat
        return F.when(s["done"], s).otherwise(F.struct(mass.alias("mass"), reached.alias("done"), F.concat(s["labels"], F.array(x["label"])).alias("labels")))

    return df.withColumn("_order", order).withColumn("labels", F.aggregate("_order", start, step)["labels"]).drop("_order")
