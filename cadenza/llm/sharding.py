"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of cells. Each shard owns ``vnodes`` points on it, and each key starts at
its own cell and goes to the shard of the next point clockwise. A shard takes keys up to its bound;
those beyond it go on clockwise to the next shard that has room. As all keys of a cell meet the same
shards in the same order, the walk is planned on the counts of the cells alone (their number is a
constant, whatever the size of the table), and each row then finds its place by its rank in its cell.
The rows take one shuffle, on the cell, of a few numbers each; the texts never move.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, fresh

#: Cells of the ring; a power of two. Keys of a cell always travel together until a shard is full.
RING_BITS = 16
VNODES = 128


def ring(n_shards: int, vnodes: int = VNODES, bits: int = RING_BITS) -> list[tuple[int, int]]:
    """The points of the ring in clockwise order: (cell, shard)."""
    points = []
    for shard in range(n_shards):
        for v in range(vnodes):
            h = int.from_bytes(hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest(), "big")
            points.append((h, shard))
    return [(h >> (64 - bits), shard) for h, shard in sorted(points)]


def bounds(n: int, n_shards: int, epsilon: float) -> list[int]:
    """The most rows of each shard: with epsilon 0 they sum to n and differ by one at most."""
    if epsilon > 0:
        return [-int(-(1 + epsilon) * n // n_shards)] * n_shards
    return [n // n_shards + (s < n % n_shards) for s in range(n_shards)]


def walk(counts: dict[int, int], points: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Plan where the keys of each cell go: (cell, rank from, rank to, shard, first slot), ranks from 0, end exclusive.

    In each round the keys that have no place yet go, cell by cell in ring order, to the next point
    clockwise whose shard had room when the round began. Each round fills a shard or places all.
    """
    room, slot = list(room), [0] * len(room)
    at = [p for p, _ in points]
    pending = {c: (0, n) for c, n in sorted(counts.items()) if n}
    plan = []
    while pending:
        free, nxt = -1, [0] * len(points)
        for k in range(2 * len(points) - 1, -1, -1):
            if room[points[k % len(points)][1]] > 0:
                free = points[k % len(points)][1]
            if k < len(points):
                nxt[k] = free
        if free < 0:
            raise ValueError("the bounds hold fewer rows than there are")
        left = {}
        for cell, (start, n) in pending.items():
            shard = nxt[bisect_left(at, cell) % len(points)]
            take = min(n - start, room[shard])
            if take:
                plan.append((cell, start, start + take, shard, slot[shard]))
                slot[shard] += take
                room[shard] -= take
            if start + take < n:
                left[cell] = (start + take, n)
        pending = left
    return plan


def cell_of(key: Column, bits: int = RING_BITS) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits).cast("int")


def shard_ring(df: DataFrame, key: str, n_shards: int, *, tie: list[Column] | None = None, vnodes: int = VNODES, epsilon: float = 0.0, bits: int = RING_BITS) -> DataFrame:
    """``df`` with ``shard`` int and ``slot`` long, gapless from 0 in each shard.

    key: the column whose hash places a row; null is a key like any other. tie: orders rows of one key.
    epsilon: a shard takes at most (1 + epsilon) times the mean; 0 makes counts differ by one at most.
    No rows give no rows. Columns named like the two new ones are replaced, all others stay, whatever their
    names. Rows that are equal in key and tie are interchangeable: any of them may have any of their places.
    """
    df = df.drop("shard", "slot")
    cell, hash_, rank, at, from_, to, owner, first = fresh([*df.columns, "shard", "slot"], "cell", "hash", "rank", "at", "from", "to", "owner", "first")
    hashed = df.withColumn(cell, cell_of(F.col(key), bits)).withColumn(hash_, F.xxhash64(F.col(key)))
    counts = {r[0]: r["n"] for r in hashed.groupBy(cell).agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = walk(counts, ring(n_shards, vnodes, bits), bounds(sum(counts.values()), n_shards, epsilon))
    steps = df.sparkSession.createDataFrame(plan, f"`{at}` int, `{from_}` long, `{to}` long, `{owner}` int, `{first}` long")
    ranked = hashed.withColumn(rank, F.row_number().over(Window.partitionBy(cell).orderBy(hash_, key, *(tie or []))).cast("long") - 1)
    # the steps are at most as many as cells and, for each shard that fills up, one more
    placed = ranked.join(F.broadcast(steps), (F.col(cell) == F.col(at)) & (F.col(rank) >= F.col(from_)) & (F.col(rank) < F.col(to)))
    return placed.select(*df.columns, F.col(owner).alias("shard"), (F.col(first) + F.col(rank) - F.col(from_)).alias("slot"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards whose counts differ by one at most (law ``rows``)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents(spark, sf_dir).select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    out = shard_ring(rows, "doc_id", 8, tie=[F.col("text_crc32"), F.col("size")])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
