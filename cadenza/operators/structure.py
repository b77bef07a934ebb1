"""Structure of clusterings: choice of k, seeding, stability, hierarchy, communities, layouts, distances to a whole."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.lineage import cut
from cadenza.functions.vectors import dot, doubles, l2, total
from cadenza.operators.clusters import medoids, spherical_kmeans

#: Rows that a sampled silhouette looks at.
SAMPLE = 2000


def _uniform(*keys):
    """A number in (0, 1) from the hash of keys."""
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def seeded_centres(unit: DataFrame, k: int, starts: int = 1, seed: int = 0) -> np.ndarray:
    """(starts, k, width): for each start k rows of ``unit`` (id, v), the first drawn evenly, each next one in proportion to one minus its largest cosine.

    Each step is one pass for all starts, in which a task keeps its row of the least exponential variate; the
    least of all reaches the driver.
    """
    chosen: list[np.ndarray] = []
    for step in range(k):
        near_to = np.stack(chosen, axis=1) if chosen else None

        def run(batches, step=step, near_to=near_to):
            best: dict[int, tuple] = {}
            for pdf in batches:
                x, ids = np.array(pdf["v"].tolist(), float).reshape(len(pdf), -1), pdf["id"].to_numpy(np.int64)
                for s in range(starts if len(x) else 0):
                    with np.errstate(over="ignore"):
                        h = (ids.astype(np.uint64) + np.uint64(1 + seed + s)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step + 1) * np.uint64(0xD6E8FEB86659FD93)
                        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
                        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                    draw = -np.log(((h >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53))
                    if near_to is not None:
                        weight = np.maximum(1 - (x @ near_to[s].T).max(1), 0.0)
                        draw = np.where(weight > 1e-12, draw / np.maximum(weight, 1e-12), np.inf)
                    at = int(np.lexsort((ids, draw))[0])
                    best[s] = min(best.get(s, (np.inf, np.iinfo(np.int64).max, [])), (float(draw[at]), int(ids[at]), x[at].tolist()))
            rows = [(s, *b) for s, b in best.items() if b[2]]
            yield pd.DataFrame(rows, columns=["start", "draw", "id", "v"])

        drawn = unit.mapInPandas(run, "start int, draw double, id long, v array<double>")
        got = {r["start"]: r["b"]["v"] for r in drawn.groupBy("start").agg(F.min(F.struct("draw", "id", "v")).alias("b")).collect()}
        if not got:
            return np.zeros((starts, 0, 0))
        chosen.append(np.array([got[s] for s in range(starts)]))
    return np.stack(chosen, axis=1)


def fit_spherical_kmeans(df: DataFrame, k: int, starts: int = 10, seed: int = 0, steps: int = 100) -> DataFrame:
    """(id, cluster) of the best of several seeded starts by the sum of cosines; each start stops when that no longer grows.

    All starts take a step in the same pass: a task multiplies its rows with all centres and adds up its clusters, of
    which only the sums by position are shuffled. No rows give no rows.
    """
    spark, unit = df.sparkSession, cut(df.select("id", l2(F.col("v")).alias("v")), "unit")
    centres = seeded_centres(unit, k, starts, seed)
    if not centres.size:
        return unit.select("id", F.lit(0).alias("cluster"))
    value, live = np.full(starts, -np.inf), np.ones(starts, bool)
    for _ in range(steps):
        if not live.any():
            break
        at, width = np.flatnonzero(live), centres.shape[2]

        def run(batches, c=centres[at]):
            sums, seen = np.zeros(c.shape), False
            for pdf in batches:
                x = np.array(pdf["v"].tolist(), float).reshape(len(pdf), -1)
                for s in range(len(c) if len(x) else 0):
                    own, seen = (x @ c[s].T).argmax(1), True
                    sums[s] += (own == np.arange(k)[:, None]).astype(float) @ x
            if seen:
                yield pd.DataFrame({"at": np.arange(sums.size), "x": sums.ravel()})

        rows = unit.mapInPandas(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
        sums = np.zeros(len(at) * k * width)
        for r in rows:
            sums[r["at"]] = r["x"]
        sums = sums.reshape(len(at), k, width)
        size = np.linalg.norm(sums, axis=2)
        new = size.sum(1)  # a unit centre's sum of cosines is the length of its vectors' sum
        centres[at] = np.where(size[:, :, None] > 1e-8, sums / np.maximum(size, 1e-8)[:, :, None], centres[at])
        live[at[new <= value[at] + 1e-9]] = False
        value[at] = np.maximum(value[at], new)
    kept = centres[int(np.argmax(value))]
    table = spark.createDataFrame([(j, c) for j, c in enumerate(kept.tolist())], "cluster int, c array<double>")
    return spherical_kmeans(unit, table, 0)


def sampled_silhouette(assigned: DataFrame, sample: int = SAMPLE, seed: int = 0) -> float | None:
    """Mean Euclidean silhouette of ``assigned`` (id, cluster, v) without noise, over at most ``sample`` rows by a hash; None for one cluster."""
    rows = assigned.where("cluster <> -1").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select("cluster", doubles(F.col("v")).alias("v")).collect()
    c, x = np.array([r["cluster"] for r in rows]), np.array([r["v"] for r in rows], float)
    names, at = np.unique(c, return_inverse=True)
    if len(names) < 2:
        return None
    sums, n = np.zeros((len(rows), len(names))), np.bincount(at)
    for lo in range(0, len(rows), 256):
        part = x[lo : lo + 256]
        d = np.sqrt(np.maximum((part**2).sum(1)[:, None] + (x**2).sum(1) - 2 * part @ x.T, 0))
        d[np.arange(len(part)), lo + np.arange(len(part))] = 0
        for k in range(len(names)):
            sums[lo : lo + 256, k] = d[:, at == k].sum(1)
    own = np.arange(len(rows)), at
    a = sums[own] / np.maximum(n[at] - 1, 1)
    mean = sums / n
    mean[own] = np.inf
    b = mean.min(1)
    s = np.where(n[at] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
    return float(s.mean())


def select_k(df: DataFrame, low: int = 2, high: int = 12, seed: int = 0) -> tuple[int, dict[int, float]]:
    """(k, silhouettes by k): k-means for each k below the number of rows; the best sampled silhouette, ties to the smaller k."""
    from cadenza.operators.clusters import kmeans

    n = df.limit(high + 1).count()
    scores = {}
    for k in range(low, min(high, n - 1) + 1):
        s = sampled_silhouette(kmeans(df, k, seed, 1).join(df.select("id", "v"), "id"), seed=seed)
        if s is not None:
            scores[k] = s
    return (max(scores, key=lambda k: (scores[k], -k)) if scores else min(low, max(n, 1))), scores


def sub_cluster(df: DataFrame, low: int = 2, high: int = 6, seed: int = 0) -> DataFrame:
    """(id, cluster): the rows of one cluster split anew by the best k; fewer than three rows stay one group."""
    from cadenza.operators.clusters import kmeans

    if df.limit(3).count() < 3:
        return df.select("id", F.lit(0).alias("cluster"))
    return kmeans(df, select_k(df, low, high, seed)[0], seed, 1)


def replicate_agreement(labels: DataFrame) -> DataFrame:
    """(a, b, ari, nmi) of each pair of replicates of ``labels`` (rep, id, cluster) over the rows both have and neither calls noise."""
    rows = labels.where("cluster <> -1")
    x, y = (rows.select("id", F.col("rep").alias(f"rep_{n}"), F.col("cluster").alias(n)) for n in "ab")
    both = x.join(y, "id").where("rep_a < rep_b")
    t = both.groupBy("rep_a", "rep_b", "a", "b").agg(F.count(F.lit(1)).cast("double").alias("n"))
    pair, two = ["rep_a", "rep_b"], lambda c: c * (c - 1) / 2
    sides = [t.groupBy(*pair, s).agg(F.sum("n").alias("n")).groupBy(*pair).agg(F.sum(two(F.col("n"))).alias(f"pairs_{s}")) for s in "ab"]
    whole = t.groupBy(*pair).agg(F.sum("n").alias("n"), F.sum(two(F.col("n"))).alias("same"))
    j = whole.join(sides[0], pair).join(sides[1], pair)
    e = F.col("pairs_a") * F.col("pairs_b") / F.nullif(two(F.col("n")), F.lit(0.0))
    mean = (F.col("pairs_a") + F.col("pairs_b")) / 2
    # both labellings without structure agree wholly
    ari = F.coalesce((F.col("same") - e) / F.nullif(mean - e, F.lit(0.0)), F.lit(1.0))
    return j.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"), ari.alias("ari"), F.col("n").cast("long").alias("shared"))


def subsamples(df: DataFrame, replicates: int = 50, share: float = 0.8, seed: int = 0) -> DataFrame:
    """(rep, id, v): seeded subsamples without replacement, each row in or out by its own hash."""
    rep = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))
    return df.select("id", "v").withColumn("rep", rep).where(_uniform("id", "rep", F.lit(seed)) < share).select("rep", "id", "v")


def bootstrap_stability(df: DataFrame, cluster, replicates: int = 50, share: float = 0.8, seed: int = 0) -> DataFrame:
    """(mean_ari, least_ari, pairs): how far clusterings of subsamples agree; ``cluster`` maps a table (id, v) to (id, cluster)."""
    drawn, out = subsamples(df, replicates, share, seed), None
    for r in range(replicates):
        one = cluster(drawn.where(F.col("rep") == r).select("id", "v")).select(F.lit(r).alias("rep"), "id", "cluster")
        out = one if out is None else out.unionByName(one)
    return replicate_agreement(out).agg(F.avg("ari").alias("mean_ari"), F.min("ari").alias("least_ari"), F.count(F.lit(1)).alias("pairs"))


def average_linkage(x: np.ndarray) -> list[tuple[int, int, float, int]]:
    """(left, right, distance, size) of each merge of unit rows by mean cosine distance; new groups are numbered from the number of rows on."""
    n = len(x)
    d = 1 - x @ x.T
    size, live = {k: 1 for k in range(n)}, list(range(n))
    dist = {(i, j): float(d[i, j]) for i in range(n) for j in range(i + 1, n)}
    out = []
    for new in range(n, 2 * n - 1):
        i, j = min(dist, key=lambda p: (dist[p], p))
        out.append((i, j, max(dist[i, j], 0.0), size[i] + size[j]))
        live = [k for k in live if k not in (i, j)]
        size[new] = size[i] + size[j]
        for k in live:
            a, b = dist.pop((min(i, k), max(i, k))), dist.pop((min(j, k), max(j, k)))
            dist[k, new] = (size[i] * a + size[j] * b) / size[new]
        dist.pop((i, j))
        live.append(new)
    return out


def groups_of(merges: list[tuple[int, int, float, int]], groups: int) -> list[int]:
    """The group of each row when merging stops at so many groups, numbered by their first rows."""
    n = len(merges) + 1
    members = {k: [k] for k in range(n)}
    for new, (i, j, _, _) in enumerate(merges[: max(0, n - groups)], start=n):
        members[new] = members.pop(i) + members.pop(j)
    out = [0] * n
    for g, rows in enumerate(sorted(members.values(), key=min)):
        for r in rows:
            out[r] = g
    return out


def cluster_hierarchy(df: DataFrame, groups: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((left, right, distance, size), (cluster, group)) of the clusters of ``df`` (id, cluster, v), by mean linkage of their medoids.

    Medoids are as few as clusters; those alone are gathered. Without ``groups``: the root of their number, two at least.
    """
    spark = df.sparkSession
    rows = sorted(medoids(df).select("cluster", "id").join(df.select("id", l2(F.col("v")).alias("v")), "id").select("cluster", "v").collect())
    merges = average_linkage(np.array([r["v"] for r in rows]).reshape(len(rows), -1)) if len(rows) > 1 else []
    at = groups_of(merges, groups or max(2, round(len(rows) ** 0.5))) if rows else []
    tree = spark.createDataFrame(merges, "left int, right int, distance double, size int")
    return tree, spark.createDataFrame([(r["cluster"], g) for r, g in zip(rows, at, strict=True)], "cluster int, group int")


def communities(edges: DataFrame, resolution: float = 1.0, rounds: int = 20) -> DataFrame:
    """(id, cluster) of undirected weighted ``edges`` (src, dst, weight): nodes move to the neighbouring community of the largest gain in modularity.

    Every round is a few joins: gains of all moves at once, of which only moves to a smaller label happen in even and
    to a larger label in odd rounds, so that neighbours don't swap. Rounds end when modularity has not grown twice;
    the best labels are returned.
    A distributed stand-in for Leiden: it has no refinement step and finds coarser optima.
    """
    both = edges.select(F.explode(F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v")))).alias("e"), "weight")
    both = cut(both.select("e.u", "e.v", "weight"), "edges")
    degree = cut(both.groupBy("u").agg(F.sum("weight").alias("k")), "degrees")
    twice = degree.agg(F.sum("k")).first()[0] or 1.0
    at, best, kept = degree.select(F.col("u").alias("id"), F.col("u").alias("cluster")), -float("inf"), None
    for r in range(rounds):
        own = at.select(F.col("id").alias("u"), F.col("cluster").alias("own"))
        links = both.join(own.withColumnsRenamed({"u": "v", "own": "c"}), "v").groupBy("u", "c").agg(F.sum("weight").alias("w"))
        sums = own.join(degree, "u").groupBy(F.col("own").alias("c")).agg(F.sum("k").alias("total"))
        rest = F.col("total") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)
        gain = F.col("w") - resolution * F.col("k") * rest / twice
        scored = cut(links.join(own, "u").join(sums, "c").join(degree, "u").select("u", "c", "own", "w", gain.alias("gain")), "gains")
        inside = scored.where("c = own").agg(F.sum("w")).first()[0] or 0.0
        value = inside / twice - resolution * sums.agg(F.sum(F.pow(F.col("total") / twice, 2))).first()[0]
        if value > best + 1e-9:
            best, kept, still = value, at, 0
        else:
            still += 1
        if still > 1:
            break
        stay = scored.where("c = own").select("u", F.col("gain").alias("stays"))
        open_ = scored.where(F.col("c") < F.col("own") if r % 2 == 0 else F.col("c") > F.col("own")).join(stay, "u", "left")
        top = F.max(F.struct("gain", (-F.col("c")).alias("neg")))["neg"]
        to = open_.where(F.col("gain") > F.coalesce("stays", F.lit(0.0)) + 1e-12).groupBy(F.col("u").alias("id")).agg((-top).alias("to"))
        at = cut(at.join(to, "id", "left").select("id", F.coalesce("to", "cluster").alias("cluster")), "communities")
    return kept


def procrustes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(disparity, n) of two layouts (id, x, y) of the same rows, from 0 to 1; null where one of them is a single place.

    With both layouts centred and of unit size, 1 - (s1 + s2)^2 of the singular values of their 2 x 2 product, in closed form.
    """
    j = a.select("id", F.col("x").alias("ax"), F.col("y").alias("ay")).join(b.select("id", F.col("x").alias("bx"), F.col("y").alias("by")), "id")
    names = ("ax", "ay", "bx", "by")
    m = j.agg(F.count(F.lit(1)).alias("n"), *[F.var_pop(c).alias(f"v_{c}") for c in names], *[F.covar_pop(p, q).alias(f"c_{p}_{q}") for p in names[:2] for q in names[2:]])
    size = F.sqrt((F.col("v_ax") + F.col("v_ay")) * (F.col("v_bx") + F.col("v_by")))
    c = {k: F.col(f"c_{k[:2]}_{k[2:]}") / F.nullif(size, F.lit(0.0)) for k in ("axbx", "axby", "aybx", "ayby")}
    det = F.abs(c["axbx"] * c["ayby"] - c["axby"] * c["aybx"])
    square = sum((x * x for x in c.values()), F.lit(0.0)) + 2 * det
    return m.select(F.when(square.isNotNull(), F.greatest(1 - square, F.lit(0.0))).alias("disparity"), "n")


def covariance(df: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, sample covariance) of the vectors of ``df`` (v), from sums over blocks that tasks keep to themselves."""

    def sums(batches):
        n, s, q = 0, 0.0, 0.0
        for pdf in batches:
            x = np.array(pdf["v"].tolist(), float)
            if len(x):
                n, s, q = n + len(x), s + x.sum(0), q + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "q": [q.ravel().tolist()]})

    rows = df.select(doubles(F.col("v")).alias("v")).mapInPandas(sums, "n long, s array<double>, q array<double>")
    parts = rows.collect()  # one small row a task
    n = sum(r["n"] for r in parts)
    if not n:
        return 0, np.zeros(0), np.zeros((0, 0))
    s = np.sum([r["s"] for r in parts], axis=0)
    q = np.sum([r["q"] for r in parts], axis=0).reshape(len(s), len(s))
    mean = s / n
    return n, mean, (q - n * np.outer(mean, mean)) / max(n - 1, 1)


def mahalanobis(df: DataFrame, ref: DataFrame | None = None, shrinkage: float = 0.1) -> DataFrame:
    """(id, score): distance of ``df`` (id, v) to the whole of ``ref``, whose covariance is shrunk to a multiple of the identity; zeros where that has no spread."""
    n, mean, s = covariance(df if ref is None else ref)
    d = len(mean)
    shrunk = (1 - shrinkage) * s + shrinkage * (np.trace(s) / max(d, 1)) * np.eye(d)
    if n < 2 or np.trace(s) <= 0:
        return df.select("id", F.lit(0.0).alias("score"))
    # rows of the factor turn a centred vector into one whose length is the distance
    factor = np.linalg.inv(np.linalg.cholesky(shrunk))
    rows = F.array(*[F.array(*map(F.lit, r)) for r in factor.tolist()])
    centred = F.zip_with(doubles(F.col("v")), F.array(*map(F.lit, mean.tolist())), lambda x, m: x - m)
    white = df.select("id", centred.alias("c")).select("id", F.transform(rows, lambda r: dot(r, F.col("c"))).alias("w"))
    return white.select("id", F.sqrt(total(F.transform("w", lambda x: x * x))).alias("score"))


