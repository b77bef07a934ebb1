"""Evaluation against people's labels, of next-item models, and of labels against continuous axes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions.vectors import EPS, is_constant, l2, norm
from cadenza.operators.metrics import concordance, spearman
from cadenza.operators.similarity import BLOCK_ROWS, against

AFFECT_TOLERANCE = 0.35


def evaluate_against_gold(df: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: how ``df`` (filename, top_mood, energy, valence) agrees with ``gold`` (filename, moods, energy, valence).

    Correlations are over the rows where both values are numbers, and null where they can't be measured; no
    common file gives no row.
    """
    g = gold.select("filename", "moods", *[F.col(a).try_cast("double").alias(f"gold_{a}") for a in ("energy", "valence")])
    both = df.select("filename", "top_mood", *[F.col(a).try_cast("double").alias(a) for a in ("energy", "valence")]).join(g, "filename")
    out = both.agg(F.count(F.lit(1)).alias("n_overlap"), F.avg(F.coalesce(F.array_contains("moods", F.col("top_mood")), F.lit(False)).cast("double")).alias("top_mood_accuracy")).where("n_overlap > 0")
    for axis in ("energy", "valence"):
        pairs = both.select(F.col(axis).alias("a"), F.col(f"gold_{axis}").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
        flat = pairs.agg((is_constant(F.col("a")) | is_constant(F.col("b"))).alias("flat"), F.count(F.lit(1)).alias("n"))
        c, s = concordance(pairs).select("ccc", "pearson"), spearman(pairs)
        known = lambda x: F.when(~F.col("flat"), F.col(x))
        one = flat.crossJoin(c).crossJoin(s).select(known("pearson").alias(f"{axis}_pearson"), known("spearman").alias(f"{axis}_spearman"), F.when(F.col("n") >= 2, F.col("ccc")).alias(f"{axis}_ccc"))
        out = out.crossJoin(F.broadcast(one))
    return out


def affect_consistency(labelled: DataFrame, affect: DataFrame, tolerance: float = AFFECT_TOLERANCE) -> DataFrame:
    """One row: whether top labels agree with the axes. ``labelled``: (id, label, energy, valence); ``affect``: (label, valence, arousal, kind).

    (arousal_pearson, valence_pearson, incoherent_share, n_scored, n_affect, n_texture). Rows with an unknown label or an
    axis that is not finite are left out.
    """
    j = _paired(labelled, affect)
    flat = lambda a, b: is_constant(F.col(a)) | is_constant(F.col(b))
    corr = lambda a, b: F.when(~flat(a, b), F.corr(a, b))
    return j.agg(
        corr("expected_a", "energy").alias("arousal_pearson"),
        corr("expected_v", "valence").alias("valence_pearson"),
        F.coalesce(F.avg((F.col("gap") > tolerance).cast("double")), F.lit(0.0)).alias("incoherent_share"),
        F.count(F.lit(1)).alias("n_scored"),
        F.count(F.when(F.col("kind") == "affect", 1)).alias("n_affect"),
        F.count(F.when(F.col("kind") == "texture", 1)).alias("n_texture"),
    )


def _paired(labelled: DataFrame, affect: DataFrame) -> DataFrame:
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    a = affect.select("label", F.col("valence").alias("expected_v"), F.col("arousal").alias("expected_a"), "kind")
    j = labelled.where(finite("energy") & finite("valence")).join(a, "label")
    return j.withColumn("gap", F.greatest(F.abs(F.col("expected_a") - F.col("energy")), F.abs(F.col("expected_v") - F.col("valence"))))


def worst_labels(labelled: DataFrame, affect: DataFrame, k: int = 5) -> DataFrame:
    """(rank, label, gap): the labels with the largest mean gap between expected and measured axes, ties to the one seen first."""
    g = _paired(labelled, affect).groupBy("label").agg(F.avg("gap").alias("gap"), F.min("id").alias("first"))
    top = g.orderBy(F.desc("gap"), "first").limit(k)
    return top.select(F.row_number().over(Window.orderBy(F.desc("gap"), "first")).alias("rank"), "label", "gap")


def held_out_last(plays: DataFrame) -> DataFrame:
    """(session, prefix, target) of ``plays`` (session, pos, item): the last item, and those before it in order; sessions of one item are left out."""
    order = F.array_sort(F.collect_list(F.struct("pos", "item")))
    s = plays.groupBy("session").agg(F.transform(order, lambda x: x["item"]).alias("items")).where(F.size("items") > 1)
    return s.select("session", F.slice("items", F.lit(1), F.size("items") - 1).alias("prefix"), F.element_at("items", -1).alias("target"))


def last_item_context(held: DataFrame, items: DataFrame) -> DataFrame:
    """``held`` with ``context``: the vector of the last item of the prefix, the baseline of any next-item model."""
    v = items.select(F.col("id").alias("last"), F.col("v").alias("context"))
    return held.withColumn("last", F.element_at("prefix", -1)).join(v, "last").drop("last")


def next_item_ranks(held: DataFrame, items: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(session, rank) of the target among ``items`` (id, v) by cosine to the session's context; ``held`` is (session, prefix, target, context).

    Items played before, other than the target, are out of the running; ties count in favour of the target;
    a context without length is skipped. Sessions meet items in pairs of bounded blocks.
    """
    unit = items.select("id", l2(F.col("v")).alias("v"))
    c = held.where(norm(F.col("context")) >= EPS).withColumn("v", l2(F.col("context")))
    aim = unit.select(F.col("id").alias("target"), F.col("v").alias("aim"))
    left = c.join(aim, "target").select(F.col("session").alias("id"), "v", "aim", F.array_compact(F.array_distinct(F.array_except("prefix", F.array("target")))).alias("played"))

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"session": [], "better": []})
        x, y = (np.array(d["v"].tolist(), float).reshape(len(d), -1) for d in (a, b))
        sims, goal = x @ y.T, (x * np.array(a["aim"].tolist(), float)).sum(1)
        # the target's own similarity is summed in another order than its column of the product
        ahead = sims > goal[:, None] + 1e-12
        ids, played = b["id"].to_numpy(), a["played"].tolist()
        who, items_ = np.repeat(np.arange(len(a)), [len(p) for p in played]), np.concatenate(played).astype(np.int64)
        low, high = np.searchsorted(ids, items_), np.searchsorted(ids, items_, "right")
        while (met := low < high).any():
            ahead[who[met], low[met]] = False
            who, low, high = who[met], low[met] + 1, high[met]
        return pd.DataFrame({"session": a["id"].to_numpy(), "better": ahead.sum(1)})

    found = against(left, unit, work, "session long, better long", block_rows, lambda out: out.groupby("session", as_index=False)["better"].sum())
    return found.groupBy("session").agg((F.sum("better") + 1).alias("rank"))


def hit_and_mrr(ranks: DataFrame, k: int = 10) -> DataFrame:
    """(hit_at_k, mrr, n_eval) of (rank)."""
    return ranks.agg(F.avg((F.col("rank") <= k).cast("double")).alias("hit_at_k"), F.avg(1 / F.col("rank")).alias("mrr"), F.count(F.lit(1)).alias("n_eval"))


def macro_row(per_query: DataFrame, measures: list[str]) -> DataFrame:
    """One row: the mean of each measure over all queries, and their number."""
    return per_query.agg(F.count(F.lit(1)).alias("queries"), *[F.avg(m).alias(m) for m in measures])
