"""Orders of tracks: waypoints between two vectors, nearest unused tracks, transport to a fade, and short open tours.

The inputs of a tour are one playlist; each is worked off in one task of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.vectors import dot, l2

EXACT = 12


def slerp(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """n unit waypoints on the great circle from a to b; straight steps where it is not defined."""
    a, b = (x / max(float(np.linalg.norm(x)), 1e-8) for x in (np.asarray(a, float), np.asarray(b, float)))
    if n <= 0:
        return np.zeros((0, len(a)))
    if n == 1:
        return a[None]
    t = np.arange(n)[:, None] / (n - 1)
    angle = np.arccos(np.clip(a @ b, -1, 1))
    if np.sin(angle) < 1e-8:
        x = (1 - t) * a + t * b
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
    return (np.sin((1 - t) * angle) * a + np.sin(t * angle) * b) / np.sin(angle)


def journey(df: DataFrame, a: list[float], b: list[float], n: int, near: int = 64) -> DataFrame:
    """(step, id, cos): for each waypoint the most similar track that no earlier one took.

    Each waypoint keeps its n + near best tracks, more than earlier waypoints can take, so the choice is exact.
    """
    points = slerp(np.array(a), np.array(b), n)
    keep = n + near
    unit = F.transform(F.col("v").cast("array<double>"), lambda x: x)
    rows = df.select("id", unit.alias("v"))
    best = None
    for step, p in enumerate(points.tolist()):
        norm = F.greatest(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-8))
        cos = F.aggregate(F.zip_with("v", F.array(*map(F.lit, p)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / norm
        top = rows.select(F.lit(step).alias("step"), "id", cos.alias("cos")).orderBy(F.desc("cos"), "id").limit(keep)
        best = top if best is None else best.unionAll(top)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for step, g in pdf.sort_values(["step", "cos", "id"], ascending=[True, False, True]).groupby("step"):
            for i, c in zip(g["id"], g["cos"], strict=True):
                if i not in used:
                    used.add(i)
                    out.append((step, i, c))
                    break
        return pd.DataFrame(out, columns=["step", "id", "cos"])

    return best.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(lambda pdf: pick(pdf), "step int, id long, cos double")


def held_karp(cost: np.ndarray, start: int | None = None) -> list[int]:
    """The cheapest open path over all nodes, exact; ties go to the first found in order of nodes."""
    n = len(cost)
    best = np.full((1 << n, n), np.inf)
    came = np.full((1 << n, n), -1)
    for s in range(n) if start is None else [start]:
        best[1 << s, s] = 0
    for mask in range(1, 1 << n):
        row = best[mask]
        live = np.flatnonzero(np.isfinite(row))
        if not len(live):
            continue
        through = row[live, None] + cost[live]
        low, arg = through.min(axis=0), live[through.argmin(axis=0)]
        for j in range(n):
            if not mask >> j & 1 and low[j] < best[mask | 1 << j, j]:
                best[mask | 1 << j, j] = low[j]
                came[mask | 1 << j, j] = arg[j]
    mask, at = (1 << n) - 1, int(np.argmin(best[-1]))
    path = []
    while at >= 0:
        path.append(at)
        mask, at = mask ^ 1 << at, int(came[mask, at])
    return path[::-1]


#: Entries of cost that the tours of a block of starts look at in one step.
_LOOKED_AT = 1 << 22


def nearest_tours(cost: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One tour a row, each going on to the nearest node it has not visited, ties to the lower number; all grow at once."""
    n, rows = len(cost), np.arange(len(starts))
    tours, open_ = np.empty((len(starts), n), np.int64), np.ones((len(starts), n), bool)
    at = starts
    for step in range(n):
        tours[:, step] = at
        open_[rows, at] = False
        if step < n - 1:
            at = np.where(open_, cost[at], np.inf).argmin(1)
    return tours


def _reversal(cost: np.ndarray, path: np.ndarray, i: int, low: int) -> int:
    """The first place from ``low`` on up to which turning the path round from i makes it shorter; -1 if there is none."""
    last, behind = path[low:], np.append(path[low + 1 :], -1)
    change = cost[path[i - 1], last] - cost[path[i - 1], path[i]]
    change += np.where(behind < 0, 0.0, cost[path[i], behind] - cost[last, behind])
    found = np.flatnonzero(change < -1e-12)
    return low + int(found[0]) if len(found) else -1


def two_opt(cost: np.ndarray, start: int | None = None) -> list[int]:
    """Nearest-neighbour tour, the shortest of all starts or that of a given one, improved by reversals until none gains; the first node stays first."""
    n = len(cost)
    starts, best = np.arange(n) if start is None else np.array([start]), (np.inf, np.zeros(0, np.int64))
    for lo in range(0, len(starts), step := max(1, _LOOKED_AT // n)):
        tours = nearest_tours(cost, starts[lo : lo + step])
        length = cost[tours[:, :-1], tours[:, 1:]].sum(1)
        k = int(length.argmin())
        if length[k] < best[0]:
            best = (length[k], tours[k])
    path, moved = best[1].copy(), True
    while moved:
        moved = False
        for i in range(1, n - 1):
            j = i
            while j + 1 < n and (j := _reversal(cost, path, i, j + 1)) > 0:
                path[i : j + 1] = path[i : j + 1][::-1].copy()
                moved = True
    return path.tolist()


def smooth_order(df: DataFrame, pinned: str | None = None) -> DataFrame:
    """(playlist, pos, id): a smooth order of each playlist of ``df`` (playlist, id, v) by cosine distance.

    Exact up to a dozen rows, else by reversals from the best nearest-neighbour tour. pinned: a boolean column; the
    row of the smallest id for which it is true opens its playlist.
    """

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = np.array(pdf["v"].tolist(), np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
        cost = np.clip(1 - x @ x.T, 0, None)
        first = np.flatnonzero(pdf["pinned"].to_numpy())
        start = int(first[0]) if len(first) else None
        path = held_karp(cost, start) if len(x) <= EXACT else two_opt(cost, start)
        return pd.DataFrame({"playlist": pdf["playlist"].to_numpy()[path], "pos": np.arange(len(path)), "id": pdf["id"].to_numpy()[path]})

    rows = df.select("playlist", "id", "v", F.coalesce(F.col(pinned), F.lit(False)).alias("pinned") if pinned else F.lit(False).alias("pinned"))
    return rows.groupBy("playlist").applyInPandas(lambda pdf: order(pdf), "playlist long, pos int, id long")


def sinkhorn(cost: np.ndarray, mass_a: np.ndarray, mass_b: np.ndarray, reg: float = 0.05, rounds: int = 1000) -> np.ndarray:
    """Entropic transport plan between two distributions."""
    k = np.exp(-cost / reg)
    u = np.ones(len(mass_a))
    for _ in range(rounds):
        v = mass_b / np.maximum(k.T @ u, 1e-300)
        new = mass_a / np.maximum(k @ v, 1e-300)
        if np.abs(new - u).max() < 1e-9 * max(1.0, np.abs(u).max()):
            u = new
            break
        u = new
    return u[:, None] * k * v[None, :]


def ot_morph(df: DataFrame, a: list[float], b: list[float], n: int = 8, reg: float = 0.05) -> DataFrame:
    """(pos, id): up to n different rows of ``df`` (id, v) that lead from a to b, chosen by entropic transport, most like b last.

    The pool is the max(4 n, 32) rows most like a, as many most like b and as many most like both; what is
    transported to it is n slots whose ideal likenesses fade from a to b, and each slot takes the unused row that
    receives most of it. Ends of one direction give the rows most like both; no rows give none. Ties go to the smaller id.
    """
    unit = [np.array(q, np.float64) / max(np.linalg.norm(q), 1e-8) for q in (a, b)]
    to_a, to_b = (dot(l2(F.col("v")), F.array(*map(F.lit, q.tolist()))) for q in unit)
    rows, most, n = df.select("id", to_a.alias("a"), to_b.alias("b")), max(4 * n, 32), max(1, n)
    tops = [rows.orderBy(F.desc(by), "id").limit(most) for by in (F.col("a"), F.col("b"), F.col("a") + F.col("b"))]
    same = float(np.linalg.norm(unit[1] - unit[0])) < 1e-6

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids, at = pdf["id"].to_numpy(), pdf[["a", "b"]].to_numpy(np.float64)
        both = at.sum(1)
        if same or n == 1 or len(ids) == 1:
            chosen = np.argsort(-both, kind="stable")[:n]
        else:
            slots = min(n, len(ids))
            fade = ((np.arange(slots) + 0.5) / slots)[:, None]
            low, high = np.quantile(at, (0.05, 0.95), axis=0)
            ideal = (1 - fade) * [high[0], low[1]] + fade * [low[0], high[1]]
            cost = np.square(ideal[:, None] - at[None]).sum(2)
            cost /= cost.max() or 1.0
            mass = np.exp((both - both.max()) / 0.1)
            plan = sinkhorn(cost, np.full(slots, 1 / slots), mass / mass.sum(), reg)
            if not np.isfinite(plan).all():
                plan = -cost
            chosen = np.zeros(slots, np.int64)
            for k, row in enumerate(plan):
                chosen[k] = row.argmax()
                plan[:, chosen[k]] = -np.inf
            chosen = chosen[np.lexsort((ids[chosen], at[chosen, 1]))]
        return pd.DataFrame({"pos": np.arange(len(chosen)), "id": ids[chosen]})

    pool = tops[0].unionAll(tops[1]).unionAll(tops[2]).dropDuplicates(["id"])
    return pool.groupBy(F.lit(0).alias("g")).applyInPandas(lambda pdf: pick(pdf), "pos int, id long")
