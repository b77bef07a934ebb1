"""Cosine search: top-k, near-copy pairs, neighbour graphs and late interaction.

All-pairs work runs in blocks: rows are dealt to blocks of a bounded number of rows, each pair of blocks is
one task that multiplies two matrices, and only what passes (a threshold, a block's top k) leaves it.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions.vectors import cosine, dot, l2

BLOCK_ROWS = 2048
#: Rows are dealt to at most so many blocks as long as a block has no more than so many numbers: copies sent then grow with the rows alone.
GRID, BLOCK_NUMBERS = 8, 1 << 23
#: Rows of either side that are multiplied at once, and pairs whose cosines are summed at once in double precision.
TILE, SUMMED = 2048, 1 << 16
#: The same for either side of a search by other rows; so many results of tiles are held before they are merged.
SIDE, MERGED = 6, 8


def _blocks(df: DataFrame, block_rows: int, grid: int = GRID) -> int:
    """The number of blocks of ``df`` (v): some ``block_rows`` a block up to ``grid`` blocks, then as many as keep a block bounded."""
    rows, width = df.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    return max(1, min(grid, -(-rows // block_rows)), -(-rows * max(width or 0, 0) // BLOCK_NUMBERS))


def _paired(df: DataFrame, block_rows: int, work, schema: str) -> DataFrame:
    """``work(same, ids, x, others, y)`` over every unordered pair of blocks of ``df`` (id, v), rows by id: each pair is one task, which returns Arrow batches."""
    n = _blocks(df, block_rows)
    low, high = F.least("b", "o"), F.greatest("b", "o")
    rows = df.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("b"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("id", "v", "b", (high * (high + 1) / 2 + low).cast("int").alias("task"))

    def met(batches):
        tasks = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, vectors, blocks, task = (batch.column(c) for c in ("id", "v", "b", "task"))
            width = len(vectors[0])
            if vectors.null_count or pc.any(pc.not_equal(pc.list_value_length(vectors), width)).as_py():
                raise ValueError("vectors of different widths")
            x, at = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width), task.to_numpy()
            for t in np.unique(at):
                mine = at == t
                tasks.setdefault(int(t), []).append((ids.to_numpy()[mine], blocks.to_numpy()[mine], x[mine]))
        for t in list(tasks):
            ids, blocks, x = (np.concatenate(c) for c in zip(*tasks.pop(t), strict=True))
            high = int(((8 * t + 1) ** 0.5 - 1) / 2)
            low = t - high * (high + 1) // 2
            sides = []
            for b in (low, high)[: 1 + (low != high)]:
                order = np.flatnonzero(blocks == b)
                order = order[np.argsort(ids[order], kind="stable")]
                sides.append((ids[order], x[order]))
            if all(len(side[0]) for side in sides):
                yield from work(low == high, *sides[0], *sides[-1])

    return rows.repartitionById(n * (n + 1) // 2, "task").mapInArrow(met, schema)


def _margin(width: int) -> float:
    """More than twice what a product of two unit vectors in single precision can be off."""
    return (width + 4) * 2.0**-22


def _summed(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of rows in double precision, summed alike wherever a pair is met, so that copies tie."""
    parts = [np.einsum("ij,ij->i", x[i[k : k + SUMMED]], y[j[k : k + SUMMED]]) for k in range(0, len(i), SUMMED)]
    return np.concatenate(parts) if parts else np.zeros(0)


class _Best:
    """The k best (cos, id) of each row, best first and ties to the smaller id; ``floor`` is what a product in single precision has to pass."""

    def __init__(self, rows: int, k: int, margin: float):
        self.k, self.margin = k, margin
        self.cos, self.ids, self.floor = np.full((rows, k), -np.inf), np.zeros((rows, k), np.int64), np.full(rows, -np.inf, np.float32)

    def first(self, rows: slice, s: np.ndarray) -> np.ndarray:
        """The floors of these rows, from the k-th best of ``s`` where none is known yet."""
        floor = self.floor[rows]
        new = np.flatnonzero(floor == -np.inf)
        if len(new) and s.shape[1] > self.k:
            least = -np.partition(-s[new], self.k - 1, axis=1)[:, self.k - 1] - self.margin
            floor[new] = np.where(np.isnan(least), -np.inf, least)
        return floor

    def add(self, rows: np.ndarray, ids: np.ndarray, cos: np.ndarray) -> None:
        last = self.cos[rows, -1]
        better = (cos > last) | ((cos == last) & (ids < self.ids[rows, -1]))
        hit, at = np.unique(rows[better], return_inverse=True)
        at = np.r_[at, np.repeat(np.arange(len(hit)), self.k)]
        cos, ids = np.r_[cos[better], self.cos[hit].ravel()], np.r_[ids[better], self.ids[hit].ravel()]
        order = np.lexsort((ids, -cos, at))
        at = at[order]
        keep = order[np.arange(len(at)) - np.searchsorted(at, at) < self.k]
        self.cos[hit], self.ids[hit] = cos[keep].reshape(-1, self.k), ids[keep].reshape(-1, self.k)
        self.floor[hit] = self.cos[hit, -1] - self.margin

    def rows(self, ids: np.ndarray, step: int = TILE):
        for k in range(0, len(ids), step):
            cos = self.cos[k : k + step]
            i, j = np.nonzero(cos > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(ids[k + i]), pa.array(self.ids[k + i, j]), pa.array(cos[i, j])], ["id", "other", "cos"])


def against(left: DataFrame, right: DataFrame, work, schema: str, block_rows: int = BLOCK_ROWS, merge=None) -> DataFrame:
    """``work`` over every pair of a tile of ``left`` and a tile of ``right`` (id, v, ...), of some ``block_rows`` rows, those of one id together.

    Both sides are dealt to few large blocks and each pair of blocks is one task. ``merge`` makes one of what a tile of
    ``left`` got from tiles of ``right``, so that a task returns a single result for it.
    """
    na, nb = (_blocks(df, block_rows, SIDE) for df in (left, right))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.withColumn("_i", block(na)).withColumn("_j", every(nb))
    b = right.withColumn("_j", block(nb)).withColumn("_i", every(na))

    def tiles(pdf: pd.DataFrame) -> list[pd.DataFrame]:
        pdf = pdf.sort_values("id", kind="stable")
        at = _starts(pdf["id"].to_numpy())
        at = at[np.searchsorted(at, np.arange(0, max(len(pdf), 1), block_rows), "right") - 1] if len(at) else np.zeros(1, int)
        at = np.unique(at)
        return [pdf.iloc[i:j] for i, j in zip(at, [*at[1:], len(pdf)], strict=True)]

    def both(_key, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        ys, out = tiles(y), []
        for mine in tiles(x):
            got = []
            for theirs in ys:
                got.append(work(mine, theirs))
                if merge and len(got) >= MERGED:
                    got = [merge(pd.concat(got))]
            out.append(merge(pd.concat(got)) if merge and len(got) > 1 else pd.concat(got))
        return pd.concat(out)

    return a.groupBy("_i", "_j").cogroup(b.groupBy("_i", "_j")).applyInPandas(both, schema)


def _top(key: str, order: list[str], k: int):
    """For `against`: the k best rows of each key, by the first column downward and the next upward."""

    def merge(out: pd.DataFrame) -> pd.DataFrame:
        return out.sort_values([key, *order], ascending=[True, False, *[True] * (len(order) - 1)]).groupby(key).head(k)

    return merge


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.array(pdf["v"].tolist(), np.float64).reshape(len(pdf), -1)


def top_neighbours(df: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, other, cos, rank): the k most similar other rows of each row; ties go to the smaller id.

    Products are made in single precision; what may be among the k best is summed in double precision and alone decides.
    """

    def work(same: bool, ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray):
        margin = _margin(x.shape[1])
        mine, theirs = _Best(len(ids), k, margin), _Best(0 if same else len(others), k, margin)
        a, b = x.astype(np.float32), y.astype(np.float32)
        for i0 in range(0, len(a), TILE):
            for j0 in range(0, len(b), TILE):
                rows, columns = slice(i0, i0 + TILE), slice(j0, j0 + TILE)
                s = a[rows] @ b[columns].T
                if same:
                    s[ids[rows, None] == others[None, columns]] = -np.inf
                hit = s > mine.first(rows, s)[:, None]
                if not same:
                    hit |= s > theirs.first(columns, s.T)
                i, j = np.divmod(np.flatnonzero(hit), s.shape[1])
                i, j = i + i0, j + j0
                if same:
                    other = ids[i] != others[j]
                    i, j = i[other], j[other]
                cos = _summed(x, y, i, j)
                mine.add(i, others[j], cos)
                if not same:
                    theirs.add(j, ids[i], cos)
        yield from mine.rows(ids)
        if not same:
            yield from theirs.rows(others)

    part = _paired(df.select(F.col("id").cast("long").alias("id"), l2(F.col("v")).alias("v")), block_rows, work, "id long, other long, cos double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cos"), "other"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k)


def near_pairs(df: DataFrame, threshold: float = 0.98, block_rows: int = BLOCK_ROWS, top: int | None = None) -> DataFrame:
    """(a, b, cos) of all pairs a < b at or above the threshold; what is reported is kept within [-1, 1].

    With ``top``, tasks may leave out what is not among their so many best by cosine and then ids.
    """

    def work(same: bool, ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray):
        margin, floor, held = _margin(x.shape[1]), threshold, []
        repeated = len(np.unique(ids)) < len(ids) or len(np.unique(others)) < len(others)
        a, b = x.astype(np.float32), y.astype(np.float32)

        def best():
            out = pd.concat(held)
            out = out.drop_duplicates(["a", "b"]) if repeated else out
            return out if top is None else out.sort_values(["cos", "a", "b"], ascending=[False, True, True]).head(top)

        for i0 in range(0, len(a), TILE):
            for j0 in range(i0 if same else 0, len(b), TILE):
                s = a[i0 : i0 + TILE] @ b[j0 : j0 + TILE].T
                i, j = np.divmod(np.flatnonzero(s >= np.float32(floor - margin)), s.shape[1])
                i, j = i + i0, j + j0
                if same:
                    once = (i < j) & (ids[i] != others[j])
                    i, j = i[once], j[once]
                cos = _summed(x, y, i, j)
                near = cos >= threshold
                p, q = ids[i[near]], others[j[near]]
                out = pd.DataFrame({"a": np.minimum(p, q), "b": np.maximum(p, q), "cos": np.clip(cos[near], -1, 1)})
                if top is None and not repeated:
                    yield pa.RecordBatch.from_pandas(out, preserve_index=False)
                    continue
                held.append(out[out["cos"] >= floor] if top is not None else out)
                if top is not None and sum(map(len, held)) > 4 * top:
                    held = [best()]
                    floor = max(threshold, held[0]["cos"].iloc[-1]) if top and len(held[0]) == top else floor
        if held:
            yield pa.RecordBatch.from_pandas(best(), preserve_index=False)

    return _paired(df.select(F.col("id").cast("long").alias("id"), l2(F.col("v")).alias("v")), block_rows, work, "a long, b long, cos double")


def search(df: DataFrame, query: Column, k: int) -> DataFrame:
    """(id, cos, rank) of the k rows most similar to one vector; nothing but the top is sorted."""
    top = df.select("id", cosine(F.col("v"), query).alias("cos")).orderBy(F.desc("cos"), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cos"), "id")))


def find_similar(df: DataFrame, query_id: int, k: int) -> DataFrame:
    """`search` by a row of the table, without itself."""
    q = df.where(F.col("id") == query_id).select(F.col("v").alias("q")).limit(1)
    rows = df.where(F.col("id") != query_id).crossJoin(F.broadcast(q))
    top = rows.select("id", cosine(F.col("v"), F.col("q")).alias("cos")).orderBy(F.desc("cos"), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cos"), "id")))


def similar_to(queries: DataFrame, df: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, id, cos, rank): the k rows of ``df`` most similar to each row of ``queries``, both (id, v), without the row of its own id.

    Queries and rows meet in pairs of blocks, of which each returns its k best; ties go to the smaller id.
    """

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "id": [], "cos": []})
        s = _matrix(a) @ _matrix(b).T
        ids, others = a["id"].to_numpy(), b["id"].to_numpy()
        s[ids[:, None] == others[None, :]] = -np.inf
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        out = pd.DataFrame({"query_id": np.repeat(ids, top.shape[1]), "id": others[top].ravel(), "cos": np.take_along_axis(s, top, 1).ravel()})
        return out[out["cos"] > -np.inf]

    unit = [d.select("id", l2(F.col("v")).alias("v")) for d in (queries, df)]
    part = against(*unit, work, "query_id long, id long, cos double", block_rows, _top("query_id", ["cos", "id"], k))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cos"), "id"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k)


def spread_to(queries: DataFrame, df: DataFrame, k: int, spread: int) -> DataFrame:
    """Of the k * spread rows most similar to each query, every spread-th."""
    return similar_to(queries, df, k * spread).where((F.col("rank") - 1) % spread == 0)


def spread_neighbours(df: DataFrame, query_id: int, k: int, spread: int) -> DataFrame:
    """Of the k * spread most similar rows, every spread-th."""
    return find_similar(df, query_id, k * spread).where((F.col("rank") - 1) % spread == 0)


def knn_novelty(df: DataFrame, k: int = 10) -> DataFrame:
    """1 minus the mean cosine of the k nearest other rows, that mean kept within [-1, 1]."""
    mean = F.least(F.greatest(F.avg("cos"), F.lit(-1.0)), F.lit(1.0))
    return top_neighbours(df, k).groupBy("id").agg((1 - mean).alias("novelty"))


def novelty_against(df: DataFrame, ref: DataFrame, k: int = 10) -> DataFrame:
    """(id, novelty) of ``df`` by its k nearest rows of another set, fewer if that has fewer; each task returns its best k."""

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "cos": []})
        s = -np.sort(-(_matrix(a) @ _matrix(b).T), axis=1)[:, :k]
        return pd.DataFrame({"id": np.repeat(a["id"].to_numpy(), s.shape[1]), "cos": s.ravel()})

    unit = [d.select("id", l2(F.col("v")).alias("v")) for d in (df, ref)]
    near = against(*unit, work, "id long, cos double", merge=_top("id", ["cos"], k))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cos")))).where(F.col("r") <= k)
    return near.groupBy("id").agg((1 - F.least(F.greatest(F.avg("cos"), F.lit(-1.0)), F.lit(1.0))).alias("novelty"))


def near_duplicates(df: DataFrame, threshold: float = 0.98, max_pairs: int = 500) -> DataFrame:
    """The pairs of `near_pairs` with the largest cosines, at most so many, with their rank; ties go to smaller ids."""
    top = near_pairs(df, threshold, top=max_pairs).orderBy(F.desc("cos"), "a", "b").limit(max_pairs)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cos"), "a", "b")))


def playlist(df: DataFrame, query: Column, k: int = 20, name: str = "path") -> DataFrame:
    """(rank, name): only the names of the k rows of ``df`` (id, v, name) most similar to a vector, best first."""
    return search(df, query, k).join(df.select("id", name), "id").select("rank", name)


def radio(df: DataFrame, query_id: int, k: int = 20, lam: float = 0.7, pool_mult: int = 5, harmonic_weight: float = 0.0, tempo_weight: float = 0.0, sigma: float = 0.05, exclude: list[int] | None = None) -> DataFrame:
    """(step, id, cos): `mmr` over ``df`` (id, v, code, bpm) with bonuses for a key and a tempo that follow the pick before.

    The first pick is held against the seed. A row without a key or tempo gets no bonus and stays in the
    running; excluded ids are out before the pool is drawn. The pool, of k * pool_mult rows, is picked from in one task.
    """
    gone = [query_id, *(exclude or [])]
    pool = find_similar(df.where(~F.col("id").isin(gone[1:])) if exclude else df, query_id, k * max(1, pool_mult))
    seed = df.where(F.col("id") == query_id).select(F.lit(0).alias("rank"), "id", F.lit(1.0).alias("cos"))
    rows = pool.select("rank", "id", "cos").unionByName(seed).join(df, "id").select("rank", "id", "cos", l2(F.col("v")).alias("v"), "code", F.col("bpm").cast("double").alias("bpm"))
    formed = re.compile(r"(\d+)([AB])")

    def harmony(a, b) -> float:
        if a is None or b is None:
            return 0.0
        if a == b:
            return 1.0
        x, y = formed.fullmatch(a), formed.fullmatch(b)
        if not x or not y:
            return 0.0
        apart = (int(x[1]) - int(y[1])) % 12
        return 0.5 if (x[2] == y[2] and apart in (1, 11)) or (x[2] != y[2] and apart == 0) else 0.0

    def tempo(bpm: np.ndarray, ref: float) -> np.ndarray:
        if not ref > 0 or not np.isfinite(ref):
            return np.zeros(len(bpm))
        ok = np.isfinite(bpm) & (bpm > 0)
        away = np.abs(np.log2(np.where(ok, bpm, 1.0)[:, None] * np.array([1.0, 2.0, 0.5]) / ref)).min(1)
        return np.where(ok, np.exp(-((away / sigma) ** 2) / 2), 0.0)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        x, rel, ids, codes, bpm = _matrix(pdf), pdf["cos"].to_numpy(), pdf["id"].to_numpy(), pdf["code"].tolist(), pdf["bpm"].to_numpy(float)
        left, near, ref, out = np.ones(len(ids), bool), np.full(len(ids), -np.inf), 0, []
        left[0] = False  # the seed
        for step in range(min(k, len(ids) - 1)):
            score = lam * rel - (0.0 if step == 0 else (1 - lam) * near)
            if harmonic_weight:
                score = score + harmonic_weight * np.array([harmony(c, codes[ref]) for c in codes])
            if tempo_weight:
                score = score + tempo_weight * tempo(bpm, bpm[ref])
            ref = int(np.argmax(np.where(left, score, -np.inf)))
            left[ref] = False
            near = np.maximum(near, x @ x[ref])
            out.append((step + 1, ids[ref], rel[ref]))
        return pd.DataFrame(out, columns=["step", "id", "cos"])

    return rows.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(lambda pdf: pick(pdf), "step int, id long, cos double")


def knn_edges(df: DataFrame, k: int = 15) -> DataFrame:
    """(src, dst, weight), src < dst: neighbour links of either side, the larger weight, floored at 1e-6."""
    e = top_neighbours(df, k).select(F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst"), F.greatest("cos", F.lit(1e-6)).alias("weight"))
    return e.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Weighted modularity of ``labels`` (id, label) on undirected ``edges``."""
    a, b = labels.select(F.col("id").alias("src"), F.col("label").alias("ls")), labels.select(F.col("id").alias("dst"), F.col("label").alias("ld"))
    e = edges.join(a, "src").join(b, "dst")
    ends = e.select(F.explode(F.array("ls", "ld")).alias("label"), "weight").groupBy("label").agg(F.sum("weight").alias("degree"))
    inner = e.groupBy().agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("ls") == F.col("ld"), F.col("weight")).otherwise(0.0)).alias("within"))
    return ends.crossJoin(F.broadcast(inner)).groupBy("m", "within").agg(F.sum(F.pow(F.col("degree") / (2 * F.col("m")), 2)).alias("e")).select((F.col("within") / F.col("m") - F.col("e")).alias("modularity"))


def _starts(ids: np.ndarray) -> np.ndarray:
    """Where each run of equal ids begins."""
    return np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]][: len(ids)])


def late_interaction(query: DataFrame, candidates: DataFrame, k: int = 20, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query, track, score, rank): for each segment of a query track the best cosine with a segment of the other track, summed.

    query, candidates: (track, v), one row a segment; segments of a track meet in one block, so that a task sees
    whole tracks and returns the k best for each query. A track is no candidate for itself; ties go to the smaller one.
    """

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query": [], "track": [], "score": []})
        i, j = a["id"].to_numpy(), b["id"].to_numpy()
        at, to = _starts(i), _starts(j)
        s = np.add.reduceat(np.maximum.reduceat(_matrix(a) @ _matrix(b).T, to, axis=1), at, axis=0)
        queries, tracks = i[at], j[to]
        s[queries[:, None] == tracks[None, :]] = -np.inf
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        out = pd.DataFrame({"query": np.repeat(queries, top.shape[1]), "track": tracks[top].ravel(), "score": np.take_along_axis(s, top, 1).ravel()})
        return out[out["score"] > -np.inf]

    unit = [d.select(F.col("track").alias("id"), l2(F.col("v")).alias("v")) for d in (query, candidates)]
    part = against(*unit, work, "query long, track long, score double", block_rows, _top("query", ["score", "track"], k))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "track"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k)


def mmr(df: DataFrame, query_id: int, k: int, lam: float = 0.7, pool_mult: int = 5) -> DataFrame:
    """(step, id, cos): `mmr_to` for one row of the table."""
    return mmr_to(df.where(F.col("id") == query_id), df, k, lam, pool_mult).select("step", "id", "cos")


def mmr_to(queries: DataFrame, df: DataFrame, k: int, lam: float = 0.7, pool_mult: int = 5) -> DataFrame:
    """(query_id, step, id, cos): for each row of ``queries`` greedy picks from a bounded pool, relevance against likeness to what is picked."""
    pool = similar_to(queries, df, k * pool_mult).join(df, "id").select("query_id", "id", "cos", l2(F.col("v")).alias("v"))

    def pick(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cos", "id"], ascending=[False, True])
        x, rel, ids = _matrix(pdf), pdf["cos"].to_numpy(), pdf["id"].to_numpy()
        near, left, out = np.full(len(ids), -np.inf), np.ones(len(ids), bool), []
        for step in range(min(k, len(ids))):
            score = np.where(left, lam * rel - (0.0 if step == 0 else (1 - lam) * near), -np.inf)
            best = int(np.argmax(score))
            left[best] = False
            near = np.maximum(near, x @ x[best])
            out.append((key[0], step + 1, ids[best], rel[best]))
        return pd.DataFrame(out, columns=["query_id", "step", "id", "cos"])

    return pool.groupBy("query_id").applyInPandas(lambda key, pdf: pick(key, pdf), "query_id long, step int, id long, cos double")


def tip_adapter(df: DataFrame, cache: DataFrame, beta: float = 5.0) -> DataFrame:
    """(id, label, affinity): sum of exp(-beta (1 - cos)) over a small cache (v, label) for each label of it."""
    c = cache.agg(F.collect_list(F.struct("label", l2(F.col("v")).alias("v"))).alias("c"))
    rows = df.select("id", l2(F.col("v")).alias("v")).crossJoin(F.broadcast(c)).select("id", F.explode(F.transform("c", lambda s: F.struct(s["label"].alias("label"), F.exp(-beta * (1 - dot(s["v"], F.col("v")))).alias("a")))).alias("s"))
    return rows.groupBy("id", "s.label").agg(F.sum("s.a").alias("affinity"))
