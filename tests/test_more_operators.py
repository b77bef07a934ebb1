"""Operators whose results SQL can't express, on planted structure and odd rows."""

import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza import errors
from cadenza.config import Config, Segments
from cadenza.functions import lineage, vectors
from cadenza.operators import calibration, embedders, evaluation, metrics, paths, pooling, probes, signals, similarity, structure
from cadenza.plans import analysis
from cadenza.sources import artifacts, tables


def table(spark, x, extra=None):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")


@pytest.fixture(scope="module")
def blobs():
    """Twelve rows around each of three far centres."""
    rng = np.random.default_rng(0)
    centres = np.array([[10.0, 0, 0, 0, 0, 0, 0, 1], [-10.0, 1, 0, 0, 0, 0, 0, 0], [0, 0, 0, 0, 0, 0, 0, 10.0]])
    return np.repeat(centres, 12, 0) + rng.normal(0, 0.25, (36, 8)), np.repeat(np.arange(3), 12)


def same_groups(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def test_clusterings_find_blobs(spark, blobs):
    x, truth = blobs
    df = table(spark, x)
    for got in (structure.fit_spherical_kmeans(df, 3, starts=3), structure.communities(similarity.knn_edges(df, 6)), analysis.cluster_with(df, Config(method="communities", neighbours=6))):
        labels = {r["id"]: r["cluster"] for r in got.collect()}
        assert same_groups([labels[k] for k in range(36)], truth)
    k, scores = structure.select_k(df, 2, 5)
    assert k == 3 and set(scores) == {2, 3, 4, 5} and scores[3] > 0.9
    assert structure.select_k(df.limit(1))[0] == 1
    assert structure.sub_cluster(df.limit(2)).select("cluster").distinct().count() == 1
    assert structure.fit_spherical_kmeans(df.limit(0), 3, starts=2).count() == 0


def test_sampled_silhouette_against_pairs(spark, blobs):
    x, truth = blobs
    rng = np.random.default_rng(1)
    labels = np.where(rng.random(36) < 0.2, rng.integers(0, 3, 36), truth)
    d = np.linalg.norm(x[:, None] - x, axis=2)
    want = []
    for i in range(36):
        mean = {c: d[i, (labels == c) & (np.arange(36) != i)].mean() for c in set(labels)}
        a, b = mean[labels[i]], min(v for c, v in mean.items() if c != labels[i])
        want.append((b - a) / max(a, b))
    df = spark.createDataFrame([(k, int(labels[k]), x[k].tolist()) for k in range(36)], "id long, cluster int, v array<double>")
    assert structure.sampled_silhouette(df) == pytest.approx(np.mean(want))
    assert structure.sampled_silhouette(df.withColumn("cluster", F.lit(1))) is None


def test_hierarchy_and_stability(spark, blobs):
    x, truth = blobs
    df = spark.createDataFrame([(k, int(k // 6), x[k].tolist()) for k in range(36)], "id long, cluster int, v array<double>")
    tree, groups = structure.cluster_hierarchy(df, 3)
    assert tree.count() == 5 and [r["group"] for r in groups.orderBy("cluster").collect()] == [0, 0, 1, 1, 2, 2]
    assert [m[2] for m in structure.average_linkage(np.eye(3))] == [1.0, 1.0]
    stable = structure.bootstrap_stability(table(spark, x), lambda d: structure.fit_spherical_kmeans(d, 3, starts=2), 3).first()
    assert stable["pairs"] == 3 and stable["mean_ari"] == pytest.approx(1.0)


def test_distances_to_a_whole(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, [1, 2, 3, 4], (200, 4))
    s = np.cov(x.T)
    inverse = np.linalg.inv(0.9 * s + 0.1 * np.trace(s) / 4 * np.eye(4))
    got = {r["id"]: r["score"] for r in structure.mahalanobis(table(spark, x)).collect()}
    want = [float(np.sqrt(v @ inverse @ v)) for v in x - x.mean(0)]
    assert all(got[k] == pytest.approx(w) for k, w in enumerate(want))
    flat = structure.mahalanobis(table(spark, np.ones((3, 4)))).collect()
    assert {r["score"] for r in flat} == {0.0}
    a = spark.createDataFrame([(k, float(p), float(q)) for k, (p, q) in enumerate(x[:, :2])], "id long, x double, y double")
    turned = a.select("id", (3 - 2 * F.col("y")).alias("x"), (2 * F.col("x")).alias("y"))
    assert structure.procrustes(a, turned).first()["disparity"] == pytest.approx(0, abs=1e-9)
    assert structure.procrustes(a, a.select("id", F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))).first()["disparity"] is None


def test_temperature_platt_isotonic(spark):
    rng = np.random.default_rng(3)
    logits = rng.normal(0, 1, (200, 4)) * 6
    labels = np.where(rng.random(200) < 0.7, logits.argmax(1), rng.integers(0, 4, 200))
    df = spark.createDataFrame([(z.tolist(), int(y)) for z, y in zip(logits, labels, strict=True)], "logits array<double>, label int")
    got = calibration.search_temperature(df).first()
    nll = lambda t: np.mean([min(np.log(np.exp((z - z.max()) / t).sum()) - (z[y] - z.max()) / t, -np.log(1e-12)) for z, y in zip(logits, labels, strict=True)])
    best = min(nll(t) for t in np.geomspace(1e-3, 100, 4000))
    assert got["nll"] <= best + 1e-6 and got["nll"] == pytest.approx(nll(got["temperature"]))
    conf = rng.random(500)
    right = rng.random(500) < 1 / (1 + np.exp(-(4 * conf - 1.5)))
    d = spark.createDataFrame(list(zip(conf.tolist(), right.tolist(), strict=True)), "conf double, correct boolean")
    a, b = calibration.platt(d)
    p = 1 / (1 + np.exp(-(a * conf + b)))
    assert abs((p - right).sum()) < 1e-6 and abs(((p - right) * conf).sum()) < 1e-6 and a == pytest.approx(4, abs=1.2)
    assert calibration.platt(d.where("correct")) == (0.0, 0.0)
    iso = [r["calibrated"] for r in calibration.isotonic(d).orderBy("conf").collect()]
    assert iso == sorted(iso) and calibration.isotonic(d.limit(0)).count() == 0


def test_conformal_with_penalty(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet(np.ones(6), 30_000)
    y = np.array([rng.choice(6, p=row) for row in p[:3000]])
    df = spark.createDataFrame([(row.tolist(), int(c)) for row, c in zip(p[:3000], y, strict=True)], "probs array<double>, label int")
    scored = calibration.conformal_scores(df, 2, 0.05)
    each = sorted(r["score"] for r in scored.collect())
    for coverage in (0.1, 0.8, 0.95):
        assert calibration.conformal_threshold(scored, coverage, 0.05) == pytest.approx(each[int(np.ceil(3001 * coverage)) - 1])
    assert calibration.conformal_threshold(scored, 1.0, 0.05) == float("inf") and calibration.conformal_threshold(scored, 1.0) == 1.0
    big = spark.createDataFrame([(float(v),) for v in p[:, 0]], "score double")
    assert calibration.conformal_threshold(big, 0.5) == pytest.approx(np.sort(p[:, 0])[15_000])
    assert calibration.conformal_threshold(scored, -1.0) == 0.0
    sets = calibration.conformal_sets(df, 0.0).select(F.size("labels").alias("n")).distinct().collect()
    assert [r["n"] for r in sets] == [1]
    with pytest.raises(Exception, match="without a class"):
        calibration.conformal_scores(df.withColumn("label", F.lit(6))).collect()


def test_probe_on_separable_rows(spark):
    rng = np.random.default_rng(5)
    centres = np.eye(3, 8)
    at = np.arange(90) % 3
    x = centres[at] + rng.normal(0, 0.05, (90, 8))
    df = spark.createDataFrame([(k, x[k].tolist(), [int(at[k] == 0), int(at[k] == 1), 1]) for k in range(90)], "id long, v array<double>, ys array<int>")
    head = probes.fit_linear_probe(df, ["a", "b", "all"], grid=[1.0])
    assert head.b[2] == probes.SATURATED and head.cv_score == pytest.approx(1.0)
    logits = {r["id"]: r["logits"] for r in probes.predict_probe(df, head).collect()}
    assert all((logits[k][0] > 0) == (at[k] == 0) and (logits[k][1] > 0) == (at[k] == 1) for k in range(90))
    with pytest.raises(Exception, match="width 8"):
        probes.predict_probe(df.withColumn("v", F.slice("v", 1, 5)), head).collect()
    picks = probes.diverse_subset(df.withColumn("score", F.lit(1.0)), 3, 1.0).orderBy("step").collect()
    assert picks[0]["id"] == 0 and {at[r["id"]] for r in picks} == {0, 1, 2}
    assert [r["id"] for r in probes.diverse_subset(df.withColumn("score", -F.col("id").cast("double")), 2, 0).orderBy("step").collect()] == [0, 1]


def test_pooling_rules(spark):
    frames = spark.createDataFrame([(0, 0, layer, f, [float(layer), float(f)]) for layer in range(4) for f in range(2)], "track long, seg int, layer int, frame int, v array<double>")
    first = lambda **a: pooling.weight_layers(frames, **a).where("frame = 0").first()["v"][0]
    assert (first(), first(mode="last"), first(mode="subset"), first(mode="subset", layers=[0, -1])) == (1.5, 3.0, 1.5, 1.5)
    assert first(mode="weighted", weights=[0, 0, 0, 50]) == pytest.approx(3.0)
    for bad in ({"mode": "weighted", "weights": [1.0]}, {"mode": "subset", "layers": [9]}, {"mode": "none"}):
        with pytest.raises(ValueError):
            pooling.weight_layers(frames, **bad)
    assert pooling.weight_layers(frames.limit(0)).count() == 0
    with pytest.raises(ValueError, match="id .0."):
        vectors.ensure_finite(spark.createDataFrame([(0, [1.0, None])], "id long, v array<double>"), "v", 2)


def test_radio_is_mmr_without_weights(spark):
    rng = np.random.default_rng(6)
    df = table(spark, rng.normal(0, 1, (40, 8))).withColumn("code", F.when(F.col("id") % 5 > 0, "8A")).withColumn("bpm", F.when(F.col("id") % 7 > 0, 120.0))
    plain = [r["id"] for r in similarity.mmr(df, 0, 6).orderBy("step").collect()]
    assert plain == [r["id"] for r in similarity.radio(df, 0, 6).orderBy("step").collect()]
    some = [r["id"] for r in similarity.radio(df, 1, 6, harmonic_weight=2.0, tempo_weight=2.0, exclude=plain[:1]).orderBy("step").collect()]
    assert len(some) == 6 and plain[0] not in some and 1 not in some and all(k % 5 and k % 7 for k in some)


def test_next_item_masks_what_was_played(spark):
    items = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.99, 0.1]), (2, [0.7, 0.7]), (3, [0.0, 1.0])], "id long, v array<double>")
    plays = spark.createDataFrame([(7, 0, 1), (7, 1, 0), (7, 2, 2), (8, 0, 3), (9, 0, 3), (9, 1, 3)], "session long, pos int, item long")
    held = evaluation.last_item_context(evaluation.held_out_last(plays), items)
    ranks = {r["session"]: r["rank"] for r in evaluation.next_item_ranks(held, items).collect()}
    assert ranks == {7: 1, 9: 1}
    assert evaluation.hit_and_mrr(spark.createDataFrame([(1,), (20,)], "rank long")).first()["hit_at_k"] == 0.5


def test_embedders_and_an_analysis(spark, tmp_path):
    sr = 8000
    files = []
    for k in range(9):
        t = np.arange(sr) / sr
        x = np.sin(2 * np.pi * (200, 800, 2000)[k % 3] * t) * 0.5 + np.random.default_rng(k).normal(0, 0.01, sr)
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(sr)
            w.writeframes((x * 32767).astype("<i2").tobytes())
        (tmp_path / f"{k:02}.wav").write_bytes(out.getvalue())
        files.append(f"{k:02}.wav")
    found = tables.decode_wave(tables.discover(spark, str(tmp_path))).select(F.regexp_extract("path", r"(\d+)\.wav", 1).cast("long").alias("id"), "path", "sr", "samples")
    s = Segments(0.5, 0.0, 0.25)
    bounds = signals.segment_bounds(found.select("id", F.size("samples").cast("long").alias("n_samples")), sr, s.seconds, s.overlap, s.least)
    segments = embedders.segment_embeddings(found, bounds, embedders.HashingEmbedder)
    assert segments.count() == 18 and segments.where("error IS NOT NULL").count() == 0
    tracks = embedders.track_embeddings(segments).join(found.select("id", "path"), "id")
    e = embedders.get_embedder("hashing")
    assert isinstance(e, embedders.Embedder) and isinstance(e, embedders.EmbedsText)
    with pytest.raises(errors.MissingBackend):
        embedders.get_embedder("none")
    matrix = embedders.text_matrix(spark, e, {"calm": ["a calm song", "quiet"], "loud": ["a loud song"], "dark": ["dark tones"]})
    pole = lambda a, b: embedders.text_matrix(spark, e, {"low": [a], "high": [b]}).select("label", "v")
    poles = (pole("low energy", "high energy"), pole("sad", "happy"))
    done = analysis.run_analysis(tracks, matrix, poles, Config(method="spherical", k=3))
    got = {r["id"]: r for r in done.assignments.collect()}
    assert same_groups([got[k]["cluster"] for k in range(9)], [k % 3 for k in range(9)]) and done.metrics["verdict"] == "clustered"
    assert all(r["top_mood"] in ("calm", "loud", "dark") and 0 <= r["energy"] <= 1 for r in got.values())
    assert set(artifacts.empty_assignments(spark).columns) <= set(done.assignments.columns)
    some = analysis.attach_labels(tracks.select("id", "path"), tracks.where("id < 6"), matrix, None, Config())
    assert {(r["top_mood"], len(r["mood_topk"])) for r in some.where("id >= 6").collect()} == {("", 0)}
    made = artifacts.write_artifacts(done.assignments, str(tmp_path / "out"))
    assert {"assignments.parquet", "clusters.html", "mood_space.html", "cluster_report.md", "dashboard.html", "playlists"} == set(made)
    lines = [r["value"] for r in spark.read.text(made["cluster_report.md"]).collect()]
    assert lines[0] == "# Clusters" and len(lines) == 9
    lists = artifacts.playlists(done.assignments).orderBy("name", "line_no").collect()
    assert len(lists) == 3 + 18 and lists[0]["line"] == "#EXTM3U" and lists[1]["line"].startswith("#EXTINF:-1,0")
    with pytest.raises(errors.EmptyCollection):
        analysis.run_analysis(tracks.limit(0), matrix)
    spaces = analysis.compare_spaces({"a": tracks, "b": tracks.withColumn("v", F.transform("v", lambda x: -x))}, Config(method="spherical", k=3), 2).collect()
    assert [r["n_clusters"] for r in spaces] == [3, 3] and all(r["mean_ari"] > 0.9 for r in spaces)
    assert "<select" in artifacts.labelling_page(done.assignments.withColumn("score", F.col("top_score")), ["calm"])


def test_cache_and_settings(spark, tmp_path):
    inputs = spark.createDataFrame([("a", "k1"), ("b", "k2")], "path string, key string")
    path = str(tmp_path / "cache")
    assert artifacts.load_cached(spark, path, "t", inputs).where("v IS NULL").count() == 2
    artifacts.save_cached(inputs.limit(1).withColumn("v", F.array(F.lit(1.0))), path, "t")
    got = {r["path"]: r["v"] for r in artifacts.load_cached(spark, path, "t", inputs).collect()}
    assert sorted(got.values(), key=str) == [None, [1.0]]
    assert artifacts.load_cached(spark, path, "other", inputs).where("v IS NULL").count() == 2
    assert Config().tag() == "" and Config(pool="mean_std").tag().startswith("cfg-") and Config(k=3).tag() == ""
    with pytest.raises(ValueError):
        Config(method="none")
    names = spark.createDataFrame([("Été & Co!",), ("--",), (None,)], "n string").select(artifacts.slug(F.col("n")).alias("s")).collect()
    assert [r["s"] for r in names] == ["été_co", "unknown", "unknown"]
    assert lineage.shared_folder(spark).startswith("file:")
    assert metrics.macro_f1(spark.createDataFrame([(1, 1)], "truth int, predicted int")).first()["macro_f1"] == 1.0


def test_tours_against_one_reversal_at_a_time(spark):
    """The same path as plain loops over all reversals, from the shortest greedy tour."""
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (40, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cost = np.clip(1 - x @ x.T, 0, None)
    length = lambda p: sum(cost[a, b] for a, b in zip(p, p[1:], strict=False))

    def greedy(s):
        p = [s]
        while len(p) < 40:
            p.append(min((j for j in range(40) if j not in p), key=lambda j: (cost[p[-1], j], j)))
        return p

    def improved(p):
        again = True
        while again:
            again = False
            for i in range(1, 39):
                for j in range(i + 1, 40):
                    new = p[:i] + p[i : j + 1][::-1] + p[j + 1 :]
                    if length(new) < length(p) - 1e-12:
                        p, again = new, True
        return p

    assert paths.two_opt(cost) == improved(min(map(greedy, range(40)), key=length))
    assert paths.two_opt(cost, 5) == improved(greedy(5))
    df = spark.createDataFrame([(k // 30, k, x[k].tolist(), k in (3, 35)) for k in range(40)], "playlist long, id long, v array<double>, first boolean")
    got = paths.smooth_order(df, "first").collect()
    assert {r["id"] for r in got if r["pos"] == 0} == {3, 35} and sorted(r["id"] for r in got) == list(range(40))


def test_ot_morph_against_one_by_one(spark):
    """The picks of a plan worked out in logarithms, over a pool found by full sorts."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    a, b, n = x[3] * 2, x[90] * 3, 9
    sa, sb = x @ x[3], x @ x[90]
    m = max(4 * n, 32)
    pool = sorted({i for s in (sa, sb, sa + sb) for i in sorted(range(150), key=lambda i: (-s[i], i))[:m]})
    qa, qb = sa[pool], sb[pool]
    cost = np.zeros((n, len(pool)))
    for k in range(n):
        t = (k + 0.5) / n
        ia = (1 - t) * np.percentile(qa, 95) + t * np.percentile(qa, 5)
        ib = (1 - t) * np.percentile(qb, 5) + t * np.percentile(qb, 95)
        cost[k] = (ia - qa) ** 2 + (ib - qb) ** 2
    cost /= cost.max()
    want = (qa + qb) / 0.1
    want -= np.log(np.exp(want - want.max()).sum()) + want.max()
    f, g = np.zeros(n), np.zeros(len(pool))
    for _ in range(3000):
        g = want - np.logaddexp.reduce(f[:, None] - cost / 0.05, axis=0)
        f = -np.log(n) - np.logaddexp.reduce(g[None, :] - cost / 0.05, axis=1)
    plan, used = f[:, None] + g[None, :] - cost / 0.05, []
    for k in range(n):
        used.append(max((j for j in range(len(pool)) if j not in used), key=lambda j: (plan[k, j], -j)))
    want = sorted((pool[j] for j in used), key=lambda i: (sb[i], i))
    rows = paths.ot_morph(df, a.tolist(), b.tolist(), n).orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(n)) and [r["id"] for r in rows] == want
    one = paths.ot_morph(df, a.tolist(), b.tolist(), 1).collect()
    assert [r["id"] for r in one] == [int(np.argmax(sa + sb))]
    alike = paths.ot_morph(df, a.tolist(), (a * 5).tolist(), 4).orderBy("pos").collect()
    assert [r["id"] for r in alike] == np.argsort(-sa, kind="stable")[:4].tolist()
    assert paths.ot_morph(df.where("false"), a.tolist(), b.tolist()).count() == 0
    assert paths.ot_morph(df.limit(5), a.tolist(), b.tolist()).count() == 5
