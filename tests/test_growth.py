"""What travels or meets in one task does not grow faster than the input; results on odd inputs stay those of one-by-one versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import calibration, evaluation, signals, similarity


@pytest.mark.parametrize(("overlap", "least"), [(0.0, 1.0), (2.5, 1.0), (9.99, 0.0), (2.5, 12.0)])
def test_segments_of_all_lengths(spark, overlap, least):
    """Against one by one, with more than one run of segments."""
    size, step, low = 1000, 1000 - round(overlap * 100), round(least * 100)
    lengths = [-1, 0, 1, 99, 100, 999, 1000, 1001, 1750, 1751, 2000, 2499, 2500, 2600, 12_345]
    want = set()
    for k, n in enumerate(lengths):
        starts = list(range(0, n, step))
        cut = next((i for i, at in enumerate(starts) if at + size > n), None)
        want |= {(k, i, at / 100, min(at + size, n) / 100) for i, at in enumerate(starts) if at + size <= n or (i == cut and (n - at >= low or i == 0))}
    df = spark.createDataFrame(list(enumerate(lengths)), "id long, n_samples long")
    got = [tuple(r) for r in signals.segment_bounds(df, 100, 10.0, overlap, least).collect()]
    assert len(got) == len(want) and set(got) == want


def test_segments_of_one_wave_are_dealt_out(spark):
    """One row of a single file does not leave all its segments to one task."""
    df = spark.createDataFrame([(1, 750 * 50_000)], "id long, n_samples long").coalesce(1)
    tasks = signals.segment_bounds(df, 100, 10.0, 2.5, 1.0).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == 50_000 and max(r["count"] for r in tasks) < 25_000


@pytest.fixture
def tracks(spark):
    """300 vectors, of which 40 are copies of one, 5 are zero and one is no number."""
    x = np.random.default_rng(3).normal(size=(300, 24))
    x[50:90], x[100:105], x[200, 3] = x[7], 0, np.nan
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
    ids = np.random.default_rng(4).permutation(300)
    return spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, x, strict=True)], "id long, v array<double>"), {(int(a), int(b)): float(np.round(s, 9)) for a, row in zip(ids, u @ u.T, strict=True) for b, s in zip(ids, row, strict=True) if a != b and not np.isnan(s)}


@pytest.mark.parametrize("numbers", [1 << 23, 600])
def test_all_pairs_in_tiles(monkeypatch, tracks, numbers):
    """Neighbours and pairs with copies, over several tiles and blocks, against all pairs one by one."""
    for name, value in {"TILE": 16, "BLOCK_NUMBERS": numbers}.items():
        monkeypatch.setattr(similarity, name, value)
    df, cos = tracks
    want = {}
    for (a, b), c in cos.items():
        want.setdefault(a, []).append((-c, b))
    want = {(a, k + 1): b for a, near in want.items() for k, (_, b) in enumerate(sorted(near)[:6])}
    assert {(r["id"], r["rank"]): r["other"] for r in similarity.top_neighbours(df, 6, block_rows=60).collect()} == want
    pairs = sorted((-c, a, b) for (a, b), c in cos.items() if a < b and c >= 0.4)
    got = similarity.near_pairs(df, 0.4, block_rows=60).collect()
    assert len(got) == len(pairs) and {(r["a"], r["b"]) for r in got} == {p[1:] for p in pairs}
    best = similarity.near_duplicates(df, 0.4, 850).orderBy("rank").collect()
    assert {(r["a"], r["b"]) for r in best[:820]} == {p[1:] for p in pairs[:820]} and [r["cos"] for r in best] == pytest.approx([-p[0] for p in pairs[:850]], abs=1e-8)


def test_copies_of_a_row_do_not_grow_with_the_rows(monkeypatch, spark):
    """While blocks are small, a row is sent to as many tasks whatever the number of rows."""
    sent, f = [], type(spark.range(0)).mapInArrow
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, *a, **b: (sent.append(self.count()), f(self, *a, **b))[1])
    for n in (100, 400):
        df = spark.range(n).select("id", F.array(F.rand(1), F.rand(2)).alias("v"))
        assert similarity.top_neighbours(df, 2, block_rows=10).count() == 2 * n
        assert similarity.near_pairs(df, -1.0, block_rows=10).count() == n * (n - 1) // 2
    assert sent == [100 * similarity.GRID] * 2 + [400 * similarity.GRID] * 2


def test_searches_send_as_many_copies_whatever_the_rows(monkeypatch, spark):
    """Queries meet rows in few blocks, worked off in tiles; what each query returns is its best, as of all rows one by one."""
    monkeypatch.setattr(similarity, "MERGED", 3)
    sent, group = [], type(spark.range(0)).groupBy
    monkeypatch.setattr(type(spark.range(0)), "groupBy", lambda self, *a: (sent.append(self.count()) if a == ("_i", "_j") else 0, group(self, *a))[1])
    x = np.random.default_rng(5).normal(size=(120, 6))
    x[30:50] = x[3]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    got = {(r["query_id"], r["rank"]): r["cos"] for r in similarity.similar_to(df.where("id < 60"), df, 5, block_rows=5).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = -np.sort(-s[:60], axis=1)[:, :5]
    assert len(got) == 300 and all(got[i, k + 1] == pytest.approx(want[i, k]) for i in range(60) for k in range(5))
    assert sent == [60 * similarity.SIDE, 120 * similarity.SIDE]


def test_next_item_ranks_leave_out_what_was_played(monkeypatch, spark):
    """Against one by one, over several blocks and tiles."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 5))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    items = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    plays = [(s, k, int(i)) for s in range(70) for k, i in enumerate(rng.integers(0, 90, 2 + s % 9))]
    held = evaluation.last_item_context(evaluation.held_out_last(spark.createDataFrame(plays, "session long, pos int, item long")), items)
    got = {r["session"]: r["rank"] for r in evaluation.next_item_ranks(held, items, block_rows=8).collect()}
    for s in range(70):
        *before, target = [i for t, _, i in plays if t == s]
        sims = u @ u[before[-1]]
        assert got[s] == 1 + sum(sims[i] > sims[target] + 1e-12 for i in range(90) if i != target and i not in before)


def test_platt_works_out_its_rows_once(spark):
    """Newton steps read a table, so that a join is not repeated in each."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    rows = [(k / 40, k % 3 == 0) for k in range(40)]
    df = spark.createDataFrame(rows, "conf double, correct boolean")
    assert calibration.platt(df.mapInPandas(seen, df.schema)) == pytest.approx(calibration.platt(df))
    assert read.value == len(rows)
