"""Operators on small made-up inputs: planted structure, edges and exact small cases."""

import itertools
import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import music
from cadenza.functions import vectors as V
from cadenza.operators import attribution, clusters, metrics, paths, signals, similarity
from cadenza.sources import tables
from cadenza.streaming import feedback


def one(df, column):
    return df.select(column.alias("x")).first()["x"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    assert one(df, V.l2(F.col("a"))) == pytest.approx([0.6, 0.8])
    assert one(df, V.l2(F.col("z"))) == [0.0, 0.0]
    assert sum(one(df, V.softmax(F.col("a")))) == pytest.approx(1)
    assert one(df, V.margin(F.array(F.lit(0.7)))) == 0.7
    assert V.bad_vectors(df, "a", 3).count() == 1 and V.bad_vectors(df, "a", 2).count() == 0


def test_music(spark):
    df = spark.range(1)
    assert one(df, music.to_camelot(F.lit(9), F.lit(True))) == "8A"
    assert one(df, music.camelot_harmony(F.lit("12A"), F.lit("1A"))) == 0.5
    assert one(df, music.camelot_harmony(F.lit("x"), F.lit("x"))) == 1.0
    assert one(df, music.camelot_harmony(F.lit("x"), F.lit("1A"))) == 0.0
    assert one(df, music.fold_octave(F.lit(35.0))) == 70.0 and one(df, music.fold_octave(F.lit(180.0))) == 90.0
    assert one(df, music.implicit_weight(F.lit("skip"), F.lit(0.6))) == pytest.approx(-0.5)
    assert one(df, music.tempo_compat(F.lit(0.0), F.lit(90.0))) == 0.0


def test_near_pairs_over_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 8))
    x[7] = x[3]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    got = {(r["a"], r["b"]) for r in similarity.near_pairs(df, 0.98, block_rows=9).collect()}
    assert (3, 7) in got
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == {(i, j) for i, j in itertools.combinations(range(40), 2) if u[i] @ u[j] >= 0.98}
    top = {(r["id"], r["rank"]): r["other"] for r in similarity.top_neighbours(df, 3, block_rows=9).collect()}
    s = u @ u.T
    np.fill_diagonal(s, -9)
    assert all(top[i, 1] == int(np.argmax(s[i])) for i in range(40) if i not in (3, 7))


def test_empty_inputs(spark):
    df = spark.createDataFrame([], "id long, v array<double>")
    assert similarity.near_pairs(df, 0.9).count() == 0
    assert similarity.top_neighbours(df, 3).count() == 0
    assert similarity.find_similar(df, 0, 3).count() == 0


def test_silhouette_of_blobs_and_single(spark):
    rows = [(i, 0, [1.0, 0.01 * i]) for i in range(4)] + [(9 + i, 1, [0.01 * i, 1.0]) for i in range(4)] + [(20, 2, [-1.0, -1.0]), (30, -1, [0.5, 0.5])]
    got = {r["id"]: r["s"] for r in clusters.silhouettes(spark.createDataFrame(rows, "id long, cluster int, v array<double>")).collect()}
    assert got[20] == 0.0 and 30 not in got and all(got[i] > 0.9 for i in (0, 1, 9, 10))


def test_agreement(spark):
    same = spark.createDataFrame([(i % 3, (i % 3) + 5) for i in range(30)], "a int, b int")
    r = clusters.agreement(same).first()
    assert r["ari"] == pytest.approx(1) and r["nmi"] == pytest.approx(1)


def test_metrics_edges(spark):
    one_class = spark.createDataFrame([(0.1, True), (0.2, True)], "score double, positive boolean")
    assert metrics.roc_auc(one_class).first()["auc"] == 0.5
    sets = metrics.prediction_sets(spark.createDataFrame([([0.5, 0.3, 0.2],)], "probs array<double>"), 0.0)
    assert sets.first()["labels"] == [0]


def test_segments(spark):
    df = spark.createDataFrame([(1, 50), (2, 2500), (3, 2050)], "id long, n_samples long")
    got = [(r["id"], r["seg"], r["end"]) for r in signals.segment_bounds(df, 100, 10.0, 0.0, 1.0).orderBy("id", "seg").collect()]
    assert got == [(1, 0, 0.5), (2, 0, 10.0), (2, 1, 20.0), (2, 2, 25.0), (3, 0, 10.0), (3, 1, 20.0)]


def test_key(spark):
    turned = [signals.MAJOR[(k - 7) % 12] for k in range(12)]
    r = signals.estimate_key(spark.createDataFrame([(1, turned)], "id long, chroma array<double>")).first()
    assert (r["pitch"], r["minor"]) == (7, False) and r["r"] == pytest.approx(1)


def test_paths():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(7, 3))
    cost = np.linalg.norm(x[:, None] - x[None], axis=2)
    length = lambda p: cost[list(p)[:-1], list(p)[1:]].sum()
    best = min(map(length, itertools.permutations(range(7))))
    assert length(paths.held_karp(cost)) == pytest.approx(best)
    assert sorted(paths.two_opt(cost)) == list(range(7)) and length(paths.two_opt(cost)) <= 1.2 * best
    assert paths.held_karp(cost, 4)[0] == 4
    w = paths.slerp(np.array([1.0, 0]), np.array([0, 1.0]), 3)
    assert w[1] == pytest.approx([0.5**0.5] * 2) and len(paths.slerp(x[0], x[1], 0)) == 0
    plan = paths.sinkhorn(cost / cost.max(), np.full(7, 1 / 7), np.full(7, 1 / 7))
    assert plan.sum() == pytest.approx(1, abs=1e-3)


def test_shapley_cap(spark):
    with pytest.raises(ValueError):
        attribution.shapley(spark.range(1), 9)


def test_sources(spark, tmp_path):
    (tmp_path / "gold.json").write_text(json.dumps({"a.wav": {"moods": ["calm"], "energy": 0.2, "valence": 0.5}}))
    assert tables.load_gold(spark, str(tmp_path / "gold.json")).first()["moods"] == ["calm"]
    (tmp_path / "bad.json").write_text("{")
    assert tables.load_gold(spark, str(tmp_path / "bad.json")).count() == 0
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(100)
        w.writeframes(np.array([0, 16384], "<i2").tobytes())
    (tmp_path / "b.wav").write_bytes(b"no wave")
    got = {r["path"][-5:]: r for r in tables.decode_wave(tables.discover(spark, str(tmp_path))).collect()}
    assert got["a.wav"]["samples"] == pytest.approx([0, 0.5]) and got["b.wav"]["error"]
    tables.save_model(spark, str(tmp_path / "m"), "probe", {"w": np.eye(2)})
    assert (tables.load_model(spark, str(tmp_path / "m"), "probe")["w"] == np.eye(2)).all()
    with pytest.raises(ValueError):
        tables.load_model(spark, str(tmp_path / "m"), "other")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, "complete", 0.0), (1, "skip", 0.1), (2, "play", 0.5), (3, "skip", 0.6)]
    df = spark.createDataFrame(rows, "track int, event string, position double")
    df.write.parquet(str(tmp_path / "in"))
    q = feedback.aggregate_implicit(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("affinity").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("affinity").collect())) == sorted(map(tuple, feedback.aggregate_implicit(df).collect()))
