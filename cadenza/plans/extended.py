"""Queries of pooling, probes, radio, evaluation, calibration and structure, with their SQL; roles of tables as in `catalogue`."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import music
from cadenza.functions import vectors as V
from cadenza.operators import calibration, evaluation, labelling, metrics, pooling, probes, signals, similarity, structure
from cadenza.plans.catalogue import _C, _E, _EV, _M, _S, _X, _confidence, _events, _matrix, _probs, _read, _top, _tracks, query
from cadenza.sources import tables


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _long(df, keys):
    return df.select(*keys, F.posexplode("v").alias("pos", "val")).withColumn("val", F.round("val", 6))


# ---- pooling and fusion: a track has 24 vectors in a row, 2 segments of 3 layers of 4 frames

_FRAMES = f"{_X}, fr AS (SELECT id // 24 track, (id // 12) % 2 seg, (id // 4) % 3 layer, id % 4 frame, p, a FROM x)"


def _frames(spark, sf_dir):
    at = lambda step, n: (F.floor(F.col("id") / step) % n).cast("int")
    t = _tracks(spark, sf_dir)
    return t.select(F.floor(F.col("id") / 24).alias("track"), at(12, 2).alias("seg"), at(4, 3).alias("layer"), at(1, 4).alias("frame"), "v")


@query(f"""
WITH {_FRAMES}, w AS (SELECT layer, exp(l) / sum(exp(l)) OVER () w FROM (VALUES (0, 0.1::DOUBLE), (1, 0.7::DOUBLE), (2, 0.2::DOUBLE)) t(layer, l))
SELECT track, seg::INT AS seg, frame::INT AS frame, (p - 1)::INT AS pos, round(sum(w * a) / count(*) * 3, 6) AS val
FROM fr JOIN w USING (layer) GROUP BY 1, 2, 3, 4""")
def weight_layers(spark, sf_dir):
    """Layers weighted by a softmax; what a cut-off last track lacks counts as its mean."""
    got = pooling.weight_layers(_frames(spark, sf_dir), "weighted", weights=[0.1, 0.7, 0.2])
    return _long(got, ["track", "seg", "frame"])


@query(f"""
WITH {_FRAMES}, f AS (SELECT track, seg, frame, p, avg(a) a FROM fr WHERE layer BETWEEN 1 AND 2 GROUP BY ALL),
m AS (SELECT track, p, avg(a) m, stddev_pop(a) s FROM f GROUP BY 1, 2),
c AS (SELECT track, p - 1 AS pos, m AS x FROM m UNION ALL SELECT track, p + 63, s FROM m),
n AS (SELECT track, greatest(sqrt(sum(x * x)), 1e-8) n FROM c GROUP BY 1)
SELECT track, pos::INT AS pos, round(x / n, 6) AS val FROM c JOIN n USING (track)""")
def pool_layered(spark, sf_dir):
    return _long(pooling.pool_layered(_frames(spark, sf_dir), "subset", "mean_std"), ["track"])


@query(f"""
WITH {_X}, m AS (SELECT label, p, avg(a) a FROM x WHERE id % 3 = 0 GROUP BY 1, 2),
n AS (SELECT label, greatest(sqrt(sum(a * a)), 1e-8) n FROM m GROUP BY 1)
SELECT label, (p - 1)::INT AS pos, round(a / n, 6) AS val FROM m JOIN n USING (label)""")
def prototype_vectors(spark, sf_dir):
    return _long(pooling.prototypes(_tracks(spark, sf_dir).where("id % 3 = 0").select("label", "v")), ["label"])


@query(f"""
WITH {_E}, j AS (SELECT a.id, a.v l, b.v r FROM e a JOIN e b ON b.id = a.id + 1 WHERE a.id % 2 = 0),
x AS (SELECT id, g, CASE WHEN g <= 64 THEN 0.3 * l[g] ELSE 0.7 * r[g - 64] END val FROM j, generate_series(1, 128) t(g))
SELECT id AS path, (g - 1)::INT AS pos, round(val, 6) AS val FROM x""")
def fused_spaces(spark, sf_dir):
    """Even vectors are one space, the odd ones behind them another."""
    t = _tracks(spark, sf_dir)
    a, b = t.where("id % 2 = 0").select(F.col("id").alias("path"), "v"), t.select((F.col("id") - 1).alias("path"), "v")
    return _long(pooling.fused(a, b, (0.3, 0.7)), ["path"])


# ---- heads: weights that both sides can write down

_W = [[((3 * o + 7 * i) % 11 - 5) / 10 for i in range(64)] for o in range(8)]
_WSQL = "w AS (SELECT o, list(((3 * o + 7 * i) % 11 - 5) / 10::DOUBLE ORDER BY i) w FROM generate_series(0, 7) a(o), generate_series(0, 63) b(i) GROUP BY o)"


@query(f"""
WITH {_E}, {_WSQL}, y AS (SELECT id, o, list_dot_product(v, w) y FROM e, w), n AS (SELECT id, greatest(sqrt(sum(y * y)), 1e-8) n FROM y GROUP BY 1)
SELECT id, o::INT AS pos, round(y / n, 6) AS val FROM y JOIN n USING (id)""")
def apply_projection(spark, sf_dir):
    return _long(probes.apply_projection(_tracks(spark, sf_dir).select("id", "v"), _W), ["id"])


@query(f"""
WITH {_E}, {_WSQL}, h AS (SELECT id, o, greatest(list_dot_product(v, w) + o / 100.0::DOUBLE, 0) h FROM e, w)
SELECT id, c::INT AS label, round(sum(h * (((o + 2 * c) % 5 - 2) / 4.0::DOUBLE)) + c / 10.0::DOUBLE, 6) AS logit FROM h, generate_series(0, 2) t(c) GROUP BY 1, c""")
def predict_probe(spark, sf_dir):
    """A hidden layer of eight, three labels."""
    import numpy as np

    w = np.array([[((o + 2 * c) % 5 - 2) / 4 for o in range(8)] for c in range(3)])
    head = probes.ProbeHead(["a", "b", "c"], w, np.arange(3) / 10, np.array(_W), np.arange(8) / 100)
    got = probes.predict_probe(_tracks(spark, sf_dir).select("id", "v"), head)
    return got.select("id", F.posexplode("logits").alias("label", "logit")).withColumn("logit", F.round("logit", 6))


@query(f"""
WITH {_S}, k AS (SELECT id, prob, row_number() OVER (PARTITION BY id ORDER BY prob DESC) k FROM pr)
SELECT id, round(-sum(CASE WHEN prob > 0 THEN prob * ln(prob) ELSE 0 END), 6) AS entropy,
round(1 - (max(CASE WHEN k = 1 THEN prob END) - max(CASE WHEN k = 2 THEN prob END)), 6) AS margin FROM k GROUP BY 1""")
def acquisition_scores(spark, sf_dir):
    p = _probs(spark, sf_dir)
    return p.select("id", *[F.round(probes.acquisition_score(F.col("probs"), s), 6).alias(s) for s in ("entropy", "margin")])


_SCORE = "(id * 37 % 101) / 101.0::DOUBLE"


@query(f"""
WITH RECURSIVE {_E}, c AS MATERIALIZED (SELECT id, v, {_SCORE} score FROM e),
d(step, id, chosen) AS ((SELECT 1, id, [id] FROM c ORDER BY score DESC, id LIMIT 1) UNION ALL
(SELECT d.step + 1, c.id, list_append(d.chosen, c.id) FROM d, c WHERE d.step < 4 AND NOT list_contains(d.chosen, c.id)
ORDER BY c.score + 0.5 * (1 - (SELECT max(list_dot_product(c.v, s.v)) FROM c s WHERE list_contains(d.chosen, s.id))) DESC, c.id LIMIT 1))
SELECT step::INT AS step, id, round({_SCORE}, 6) AS score FROM d""")
def diverse_subset(spark, sf_dir):
    t = _tracks(spark, sf_dir).select("id", "v", (F.col("id") * 37 % 101 / F.lit(101.0)).alias("score"))
    return _rounded(probes.diverse_subset(t, 4, 0.5), "score")


# ---- search

_CODE = "(SELECT id, v, [8, 3, 10, 5, 12, 7, 2, 9, 4, 11, 6, 1][((id % 12 + CASE WHEN (id // 12) % 2 = 1 THEN 3 ELSE 0 END) % 12 + 1)::INT] num, (id // 12) % 2 mi, 70 + (id * 7) % 110 bpm FROM e)"
_HARM = "CASE WHEN {a}.num = {b}.num AND {a}.mi = {b}.mi THEN 1.0 WHEN {a}.num = {b}.num OR ({a}.mi = {b}.mi AND ({a}.num - {b}.num + 12) % 12 IN (1, 11)) THEN 0.5 ELSE 0.0 END"
_TEMPO = "exp(-pow(least(abs(log2({a}.bpm / {b}.bpm)), abs(log2(2 * {a}.bpm / {b}.bpm)), abs(log2({a}.bpm / {b}.bpm / 2))) / 0.05, 2) / 2)"


def _step(a: str, b: str) -> str:
    return f"0.3 * {_HARM.format(a=a, b=b)} + 0.2 * {_TEMPO.format(a=a, b=b)}"


@query(f"""
WITH RECURSIVE {_E}, c AS MATERIALIZED {_CODE},
pool AS MATERIALIZED (SELECT b.*, list_dot_product(a.v, b.v) rel FROM c a, c b WHERE a.id = 0 AND b.id NOT IN (0, 3, 4) ORDER BY rel DESC, b.id LIMIT 25),
r(step, id, chosen) AS ((SELECT 1, p.id, [p.id] FROM pool p, c s WHERE s.id = 0 ORDER BY 0.7 * p.rel + {_step('p', 's')} DESC, p.rel DESC, p.id LIMIT 1) UNION ALL
(SELECT r.step + 1, p.id, list_append(r.chosen, p.id) FROM r JOIN c s ON s.id = r.id, pool p WHERE r.step < 5 AND NOT list_contains(r.chosen, p.id)
ORDER BY 0.7 * p.rel - 0.3 * (SELECT max(list_dot_product(p.v, q.v)) FROM pool q WHERE list_contains(r.chosen, q.id)) + {_step('p', 's')} DESC, p.rel DESC, p.id LIMIT 1))
SELECT step::INT AS step, id FROM r""")
def harmonic_radio(spark, sf_dir):
    minor = F.floor(F.col("id") / 12) % 2 == 1
    t = _tracks(spark, sf_dir).select("id", "v", music.to_camelot(F.col("id") % 12, minor).alias("code"), (70 + F.col("id") * 7 % 110).cast("double").alias("bpm"))
    return similarity.radio(t, 0, 5, harmonic_weight=0.3, tempo_weight=0.2, exclude=[3, 4]).select("step", "id")


@query(f"""
WITH {_M}, q AS (SELECT v FROM m WHERE j = 4), r AS (SELECT id, row_number() OVER (ORDER BY list_dot_product(e.v, q.v) DESC, id) rank FROM e, q)
SELECT rank::INT AS rank, 'track ' || id AS path FROM r WHERE rank <= 20""")
def playlist_from_text(spark, sf_dir):
    """The names nearest to the direction of a label, which stands for an embedded text."""
    q = F.array(*map(F.lit, _matrix(spark, sf_dir).where("label = 4").first()["v"]))
    t = _tracks(spark, sf_dir).select("id", "v", F.concat(F.lit("track "), F.col("id").cast("string")).alias("path"))
    return similarity.playlist(t, q, 20)


@query(f"""
WITH {_E}, p AS (SELECT a.id, list_dot_product(a.v, b.v) c FROM e a, e b WHERE a.id % 4 = 0 AND b.id % 4 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC) k FROM p)
SELECT id, round(1 - least(greatest(avg(c), -1), 1), 6) AS novelty FROM r WHERE k <= 7 GROUP BY 1""")
def novelty_against(spark, sf_dir):
    t = _tracks(spark, sf_dir)
    return _rounded(similarity.novelty_against(t.where("id % 4 = 0"), t.where("id % 4 = 1"), 7), "novelty")


@query(f"""
WITH {_E}, p AS (SELECT a.id a, b.id b, list_dot_product(a.v, b.v) c FROM e a, e b WHERE a.id < b.id), k AS (SELECT *, row_number() OVER (ORDER BY c DESC, a, b) r FROM p WHERE c >= 0.35)
SELECT a, b, round(least(greatest(c, -1), 1), 6) AS cos, r::INT AS rank FROM k WHERE r <= 50""")
def near_duplicates_top(spark, sf_dir):
    return _rounded(similarity.near_duplicates(_tracks(spark, sf_dir), 0.35, 50), "cos")


# ---- labels

@query("""
WITH d AS (SELECT i - 1 AS label, w FROM (SELECT unnest(['warm', 'cold', 'bright']) w, generate_subscripts([1, 2, 3], 1) i)),
t AS (SELECT i - 1 AS prompt_no, w FROM (SELECT unnest(['a {} song', 'music that sounds {}']) w, generate_subscripts([1, 2], 1) i))
SELECT label::INT AS label, prompt_no::INT AS prompt_no, d.w AS descriptor, replace(t.w, '{}', d.w) AS prompt FROM d, t""")
def prompt_table(spark, sf_dir):
    return labelling.prompt_table(spark, ["warm", "cold", "bright"], ["a {} song", "music that sounds {}"])


def _poles(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return [m.where(F.col("label").isin(a, a + 1)).withColumn("label", F.col("label") - a) for a in (0, 2)]


@query(f"""
WITH {_S} SELECT CASE WHEN j < 2 THEN 'energy' ELSE 'valence' END AS axis, (j % 2)::INT AS label, round(avg(s), 6) AS prior FROM s WHERE j < 4 GROUP BY ALL""")
def attribute_priors(spark, sf_dir):
    return _rounded(labelling.attribute_priors(_tracks(spark, sf_dir), *_poles(spark, sf_dir)), "prior")


@query(f"""
WITH {_S}, p AS (SELECT j, avg(s) p FROM s WHERE id % 2 = 0 GROUP BY 1), d AS (SELECT id, s.j, s - p d FROM s JOIN p USING (j)),
w AS (SELECT id, max(CASE WHEN j = 1 THEN d END) - max(CASE WHEN j = 0 THEN d END) e, max(CASE WHEN j = 3 THEN d END) - max(CASE WHEN j = 2 THEN d END) v FROM d GROUP BY 1)
SELECT id, round(1 / (1 + exp(-e / 0.05)), 6) AS energy, round(1 / (1 + exp(-v / 0.05)), 6) AS valence FROM w""")
def attribute_scores(spark, sf_dir):
    """Both axes, recentred by priors of the even rows."""
    t, poles = _tracks(spark, sf_dir), _poles(spark, sf_dir)
    priors = labelling.attribute_priors(t.where("id % 2 = 0"), *poles)
    return _rounded(labelling.attribute_scores(t, *poles, priors), "energy", "valence")


@query(f"""
WITH {_M}, s AS (SELECT e.id // 5 track, e.id % 5 seg, m.j, list_dot_product(e.v, m.v) s FROM e, m WHERE e.id // 5 < (SELECT max(id) // 5 FROM e) OR (SELECT max(id) % 5 FROM e) = 4),
r AS (SELECT *, s - avg(s) OVER (PARTITION BY track, j) rec FROM s), q AS (SELECT *, exp((rec - max(rec) OVER (PARTITION BY track, seg)) / 0.05) w FROM r),
p AS (SELECT *, w / sum(w) OVER (PARTITION BY track, seg) prob FROM q), k AS (SELECT *, row_number() OVER (PARTITION BY track, seg ORDER BY prob DESC, j) r FROM p)
SELECT track, seg::INT AS seg, r::INT AS rank, j::INT AS label, round(prob, 6) AS score FROM k WHERE r <= 3""")
def segment_arc(spark, sf_dir):
    t = _tracks(spark, sf_dir)
    full = F.col("last") % 5 == 4
    s = t.crossJoin(t.agg(F.max("id").alias("last"))).where(full | (F.floor(F.col("id") / 5) < F.floor(F.col("last") / 5)))
    s = s.select(F.floor(F.col("id") / 5).alias("track"), (F.col("id") % 5).cast("int").alias("seg"), "v")
    got = labelling.segment_arc(s, _matrix(spark, sf_dir)).select("track", "seg", F.posexplode("top").alias("p", "t"))
    return got.select("track", "seg", (F.col("p") + 1).alias("rank"), F.col("t.label").alias("label"), F.round("t.score", 6).alias("score"))


_AXES = f"{_S}, t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY prob DESC, j) r FROM pr), ax AS (SELECT id, max(CASE WHEN r = 1 THEN j END) AS label, max(CASE WHEN j = 0 THEN 1 / (1 + exp(-s * 20)) END) energy, max(CASE WHEN j = 1 THEN 1 / (1 + exp(-s * 10)) END) valence FROM t GROUP BY 1)"
_AFFECT = "af AS (SELECT g AS label, (g % 5) / 4.0::DOUBLE ev, (g % 7) / 6.0::DOUBLE ea, CASE WHEN g % 3 = 0 THEN 'texture' ELSE 'affect' END kind FROM generate_series(0, 16) t(g)), gp AS (SELECT *, greatest(abs(ea - energy), abs(ev - valence)) gap FROM ax JOIN af USING (label))"


def _axes(spark, sf_dir):
    squash = lambda k, by: 1 / (1 + F.exp(-F.col("sims")[k] * by))
    return _top(spark, sf_dir, 1).select("id", F.col("top")[0]["label"].alias("label"), squash(0, 20).alias("energy"), squash(1, 10).alias("valence"))


def _affect(spark):
    g = spark.range(17).select(F.col("id").cast("int").alias("label"))
    kind = F.when(F.col("label") % 3 == 0, "texture").otherwise("affect")
    return g.select("label", (F.col("label") % 5 / 4).alias("valence"), (F.col("label") % 7 / 6).alias("arousal"), kind.alias("kind"))


@query(f"""
WITH {_AXES}, {_AFFECT} SELECT round(corr(ea, energy), 6) AS arousal_pearson, round(corr(ev, valence), 6) AS valence_pearson, round(avg((gap > 0.35)::INT), 6) AS incoherent_share,
count(*) AS n_scored, count(*) FILTER (kind = 'affect') AS n_affect, count(*) FILTER (kind = 'texture') AS n_texture FROM gp""")
def affect_consistency(spark, sf_dir):
    got = evaluation.affect_consistency(_axes(spark, sf_dir), _affect(spark))
    return _rounded(got, "arousal_pearson", "valence_pearson", "incoherent_share")


@query(f"""
WITH {_AXES}, {_AFFECT}, w AS (SELECT label, avg(gap) gap, min(id) f FROM gp GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY gap DESC, f) k FROM w)
SELECT k::INT AS rank, label::INT AS label, round(gap, 6) AS gap FROM o WHERE k <= 5""")
def worst_labels(spark, sf_dir):
    return _rounded(evaluation.worst_labels(_axes(spark, sf_dir), _affect(spark)), "gap")


@query(f"WITH {_M}, r AS (SELECT list_dot_product(a.v, b.v) c FROM m a, m b WHERE a.j < b.j) SELECT round(avg(c), 6) AS mean, round(max(c), 6) AS largest, count(*) AS pairs FROM r")
def redundancy_summary(spark, sf_dir):
    return _rounded(labelling.redundancy_summary(_matrix(spark, sf_dir)), "mean", "largest")


# ---- evaluation

_RANKS = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2"


def _axis_sql(axis: str, gold: str) -> str:
    pick = f"SELECT {axis} a, {gold} b FROM ax WHERE id % 3 <> 1"
    c = f"(SELECT 2 * covar_pop(a, b) / (var_pop(a) + var_pop(b) + pow(avg(a) - avg(b), 2)) FROM ({pick}))"
    s = f"(SELECT corr(ra, rb) FROM (SELECT {_RANKS.format('a')} ra, {_RANKS.format('b')} rb FROM ({pick})))"
    return f"round((SELECT corr(a, b) FROM ({pick})), 6) AS {axis}_pearson, round({s}, 6) AS {axis}_spearman, round({c}, 6) AS {axis}_ccc"


@query(f"""
WITH {_AXES} SELECT count(*) AS n_overlap, round(avg((label IN (id % 18, (id + 1) % 18))::INT), 6) AS top_mood_accuracy,
{_axis_sql('energy', '(id * 13 % 29) / 29.0::DOUBLE')}, {_axis_sql('valence', '(id * 5 % 31) / 31.0::DOUBLE')} FROM ax WHERE id % 3 <> 1""")
def gold_evaluation(spark, sf_dir):
    """Gold labels of two tracks in three, from their ids."""
    name = F.concat(F.lit("t"), F.col("id").cast("string")).alias("filename")
    a = _axes(spark, sf_dir)
    moods = F.array((F.col("id") % 18).cast("string"), ((F.col("id") + 1) % 18).cast("string")).alias("moods")
    gold = a.where("id % 3 <> 1").select(name, moods, (F.col("id") * 13 % 29 / F.lit(29.0)).alias("energy"), (F.col("id") * 5 % 31 / F.lit(31.0)).alias("valence"))
    got = evaluation.evaluate_against_gold(a.select(name, F.col("label").cast("string").alias("top_mood"), "energy", "valence"), gold)
    return _rounded(got, *[c for c in got.columns if c != "n_overlap"])


@query(f"""
WITH {_E}, {_EV}, o AS (SELECT user_id, track, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) r, count(*) OVER (PARTITION BY user_id) n FROM ev),
h AS (SELECT user_id, max(CASE WHEN r = n THEN track END) t, max(CASE WHEN r = n - 1 THEN track END) l FROM o WHERE n > 1 GROUP BY 1),
s AS (SELECT h.user_id, h.t, e.id, list_dot_product(c.v, e.v) s FROM h JOIN e c ON c.id = h.l, e),
g AS (SELECT s.user_id, 1 + count(*) FILTER (s.s > a.s + 1e-12 AND s.id <> s.t AND NOT EXISTS (SELECT 1 FROM o WHERE o.user_id = s.user_id AND o.r < o.n AND o.track = s.id)) rank
FROM s JOIN s a ON a.user_id = s.user_id AND a.id = s.t GROUP BY 1)
SELECT round(avg((rank <= 10)::INT), 6) AS hit_at_k, round(avg(1 / rank), 6) AS mrr, count(*) AS n_eval FROM g""")
def next_item_baseline(spark, sf_dir):
    """The last track of each listener held out; the one before it is the context."""
    e = _events(spark, sf_dir).select(F.col("user_id").alias("session"), F.struct("ts", "event_id").alias("pos"), F.col("track").cast("long").alias("item"))
    t = _tracks(spark, sf_dir).select("id", "v")
    held = evaluation.last_item_context(evaluation.held_out_last(e), t)
    return _rounded(evaluation.hit_and_mrr(evaluation.next_item_ranks(held, t)), "hit_at_k", "mrr")


@query(f"""
WITH {_S}, k AS (SELECT j, id, row_number() OVER (PARTITION BY j ORDER BY s DESC, id) rank, (cluster = j % 9)::INT rel FROM s),
h AS (SELECT *, sum(rel) OVER (PARTITION BY j ORDER BY rank) hits FROM k),
g AS (SELECT j, sum(rel) n, sum(CASE WHEN rank <= 10 THEN rel ELSE 0 END) top, sum(CASE WHEN rel = 1 THEN hits / rank ELSE 0 END) ap FROM h GROUP BY 1)
SELECT count(*) AS queries, round(avg(top / 10), 6) AS precision, round(avg(ap / n), 6) AS average_precision FROM g""")
def text_query_macro(spark, sf_dir):
    from cadenza.plans.catalogue import text_query_ranks

    m = metrics.ranking_metrics(text_query_ranks(spark, sf_dir), 10)
    return _rounded(evaluation.macro_row(m, ["precision", "average_precision"]), "precision", "average_precision")


# ---- calibration

@query(f"""
WITH {_S}, c AS (SELECT pr.id, pr.j, pr.prob, y.prob yp, e.label FROM pr JOIN e USING (id) JOIN pr y ON y.id = pr.id AND y.j = e.label),
a AS (SELECT id, sum(CASE WHEN prob > yp OR (prob = yp AND j <= label) THEN prob ELSE 0 END) + 0.02 * greatest(0, count(*) FILTER (prob > yp OR (prob = yp AND j <= label)) - 3) sc FROM c GROUP BY 1),
k AS (SELECT sc, row_number() OVER (ORDER BY sc) r, count(*) OVER () n FROM a) SELECT round(sc, 6) AS q_hat FROM k WHERE r = ceil((n + 1) * 0.8)""")
def conformal_threshold(spark, sf_dir):
    scored = calibration.conformal_scores(_probs(spark, sf_dir), 3, 0.02)
    return spark.createDataFrame([(round(calibration.conformal_threshold(scored, 0.8, 0.02), 6),)], "q_hat double")


@query(f"""
WITH {_S}, c AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY prob DESC, j) k FROM pr),
d AS (SELECT *, sum(prob) OVER (PARTITION BY id ORDER BY k) + 0.02 * greatest(0, k - 3) m FROM c), f AS (SELECT id, min(CASE WHEN m >= 0.8 THEN k END) k FROM d GROUP BY 1)
SELECT id, coalesce(k, 18)::INT AS size FROM f""")
def conformal_sets(spark, sf_dir):
    return calibration.conformal_sets(_probs(spark, sf_dir), 0.8, 3, 0.02).select("id", F.size("labels").alias("size"))


@query("""
WITH d AS (SELECT floor(100 * n_chars / (n_chars + 1001.5::DOUBLE)) / 100 c, (quality = 1)::INT y FROM documents JOIN labels USING (doc_id)),
g AS (SELECT c, sum(y) s, count(*) n FROM d GROUP BY 1), u AS (SELECT *, sum(s) OVER (ORDER BY c) cs, sum(n) OVER (ORDER BY c) cn FROM g),
w AS (SELECT a.c low, b.c high, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) m FROM u a JOIN u b ON a.c <= b.c),
i AS (SELECT g.c, w.low, min(w.m) m FROM g JOIN w ON w.low <= g.c AND w.high >= g.c GROUP BY 1, 2)
SELECT c AS conf, round(max(m), 6) AS calibrated FROM i GROUP BY 1""")
def isotonic(spark, sf_dir):
    d = _confidence(spark, sf_dir).withColumn("conf", F.floor(100 * F.col("conf")) / 100)
    return _rounded(calibration.isotonic(d), "calibrated")


@query("""
WITH d AS (SELECT n_chars / (n_chars + 1001.5::DOUBLE) c, (quality = 1)::INT y FROM documents JOIN labels USING (doc_id))
SELECT round(sum(y)::DOUBLE, 4) AS mass, round(sum(y * c), 4) AS first_moment FROM d""")
def platt_moments(spark, sf_dir):
    """At the fitted curve, the sums of probabilities and of probability times confidence are those of the outcomes."""
    d = _confidence(spark, sf_dir)
    a, b = calibration.platt(d)
    p = 1 / (1 + F.exp(-(F.col("conf") * a + b)))
    return d.agg(F.round(F.sum(p), 4).alias("mass"), F.round(F.sum(p * F.col("conf")), 4).alias("first_moment"))


@query()
def temperature_search(spark, sf_dir):
    return _rounded(calibration.search_temperature(_probs(spark, sf_dir)), "nll")


# ---- structure

_REP = "(id * 7919 + r * 104729) % 100 < 80"
_REPS = f"""{_E}, rp AS (SELECT r, e.id, e.v FROM e, generate_series(0, 3) t(r) WHERE {_REP}),
lb AS (SELECT r, id, c FROM (SELECT rp.r, rp.id, s.id c, row_number() OVER (PARTITION BY rp.r, rp.id ORDER BY list_dot_product(rp.v, s.v) DESC, s.id) k FROM rp JOIN e s ON s.id BETWEEN 6 * rp.r AND 6 * rp.r + 5) WHERE k = 1)"""


@query(f"""
WITH {_REPS}, t AS (SELECT a.r ra, b.r rb, a.c ca, b.c cb, count(*)::DOUBLE n FROM lb a JOIN lb b ON a.id = b.id AND a.r < b.r GROUP BY ALL),
w AS (SELECT ra, rb, sum(n) n, sum(n * (n - 1) / 2) s FROM t GROUP BY 1, 2),
x AS (SELECT ra, rb, sum(m * (m - 1) / 2) p FROM (SELECT ra, rb, ca, sum(n) m FROM t GROUP BY 1, 2, 3) GROUP BY 1, 2),
y AS (SELECT ra, rb, sum(m * (m - 1) / 2) q FROM (SELECT ra, rb, cb, sum(n) m FROM t GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT ra::INT AS a, rb::INT AS b, round((s - p * q / (n * (n - 1) / 2)) / ((p + q) / 2 - p * q / (n * (n - 1) / 2)), 6) AS ari, n::BIGINT AS shared FROM w JOIN x USING (ra, rb) JOIN y USING (ra, rb)""")
def replicate_agreement(spark, sf_dir):
    """Four subsamples, each assigned to six of its own centres."""
    from cadenza.operators.clusters import spherical_kmeans

    t, out = _tracks(spark, sf_dir).select("id", "v"), None
    for r in range(4):
        own = t.where((F.col("id") * 7919 + r * 104729) % 100 < 80)
        centres = t.where(F.col("id").between(6 * r, 6 * r + 5)).select(F.col("id").cast("int").alias("cluster"), V.l2(F.col("v")).alias("c"))
        one = spherical_kmeans(own, centres, 0).select(F.lit(r).alias("rep"), "id", "cluster")
        out = one if out is None else out.unionByName(one)
    return _rounded(structure.replicate_agreement(out), "ari")


@query()
def bootstrap_stability(spark, sf_dir):
    """A step of spherical k-means from the first rows on each of four subsamples."""
    from cadenza.operators.clusters import spherical_kmeans

    def cluster(df):
        centres = t.where("id < 6").select(F.col("id").cast("int").alias("cluster"), V.l2(F.col("v")).alias("c"))
        return spherical_kmeans(df, centres, 1)

    t = _tracks(spark, sf_dir)
    return structure.bootstrap_stability(t, cluster, 4)


@query()
def cluster_hierarchy(spark, sf_dir):
    return structure.cluster_hierarchy(_tracks(spark, sf_dir))[1]


@query()
def communities(spark, sf_dir):
    return structure.communities(similarity.knn_edges(_tracks(spark, sf_dir), 15))


@query()
def spherical_kmeans_fit(spark, sf_dir):
    return structure.fit_spherical_kmeans(_tracks(spark, sf_dir), 6)


@query(f"""
WITH {_E}, d AS (SELECT v[1] ax, v[2] ay, v[3] bx, v[1] + v[4] b2 FROM e),
m AS (SELECT count(*) n, sqrt((var_pop(ax) + var_pop(ay)) * (var_pop(bx) + var_pop(b2))) s, covar_pop(ax, bx) a, covar_pop(ax, b2) b, covar_pop(ay, bx) c, covar_pop(ay, b2) d FROM d)
SELECT round(1 - (a * a + b * b + c * c + d * d + 2 * abs(a * d - b * c)) / (s * s), 6) AS disparity, n FROM m""")
def procrustes(spark, sf_dir):
    t = _tracks(spark, sf_dir)
    a = t.select("id", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))
    return _rounded(structure.procrustes(a, t.select("id", F.col("v")[2].alias("x"), (F.col("v")[0] + F.col("v")[3]).alias("y"))), "disparity")


@query(f"""
WITH {_E}, d AS (SELECT id, v[1] x, v[2] y FROM e), m AS (SELECT avg(x) mx, avg(y) my, var_samp(x) a, var_samp(y) b, covar_samp(x, y) c FROM d),
s AS (SELECT mx, my, 0.9 * a + 0.05 * (a + b) a, 0.9 * b + 0.05 * (a + b) b, 0.9 * c c FROM m)
SELECT id, round(sqrt((b * (x - mx) * (x - mx) - 2 * c * (x - mx) * (y - my) + a * (y - my) * (y - my)) / (a * b - c * c)), 6) AS score FROM d, s""")
def mahalanobis(spark, sf_dir):
    return _rounded(structure.mahalanobis(_tracks(spark, sf_dir).select("id", F.slice("v", 1, 2).alias("v"))), "score")


# ---- rules and sources

_WHEEL = "SELECT p_partkey k, [8, 3, 10, 5, 12, 7, 2, 9, 4, 11, 6, 1][((p_partkey % 12 + CASE WHEN p_size % 2 = 0 THEN 3 ELSE 0 END) % 12 + 1)::INT] n, p_size % 2 = 0 mi FROM part"


@query(f"""
WITH p AS ({_WHEEL}) SELECT k, ((n + 10) % 12 + 1)::VARCHAR || CASE WHEN mi THEN 'A' ELSE 'B' END AS below, (n % 12 + 1)::VARCHAR || CASE WHEN mi THEN 'A' ELSE 'B' END AS above,
n::VARCHAR || CASE WHEN mi THEN 'B' ELSE 'A' END AS across FROM p""")
def camelot_neighbours(spark, sf_dir):
    code = music.camelot_neighbours(music.to_camelot(F.col("p_partkey") % 12, F.col("p_size") % 2 == 0))
    p = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), code.alias("n"))
    return p.select("k", F.col("n")[0].alias("below"), F.col("n")[1].alias("above"), F.col("n")[2].alias("across"))


@query(f"""
WITH p AS ({_WHEEL}) SELECT a.k, (CASE WHEN a.n = b.n AND a.mi = b.mi THEN 1.0 WHEN a.n = b.n OR (a.mi = b.mi AND (a.n - b.n + 12) % 12 IN (1, 11)) THEN 0.5 ELSE 0.0 END)::DOUBLE AS harmony
FROM p a JOIN p b ON b.k = a.k + 1""")
def camelot_harmony(spark, sf_dir):
    p = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), music.to_camelot(F.col("p_partkey") % 12, F.col("p_size") % 2 == 0).alias("code"))
    q = p.select((F.col("k") - 1).alias("k"), F.col("code").alias("other"))
    return p.join(q, "k").select("k", music.camelot_harmony(F.col("code"), F.col("other")).alias("harmony"))


@query("""
SELECT p_partkey AS k, CASE WHEN p_size % 10 = 0 THEN NULL WHEN (p_size - 10) / 100.0 <= 0.05 THEN 'none_detected' WHEN (p_size - 10) / 100.0 <= 0.25 THEN 'weak' ELSE 'clustered' END AS verdict FROM part""")
def structure_verdict(spark, sf_dir):
    s = F.when(F.col("p_size") % 10 != 0, (F.col("p_size") - 10) / 100.0)
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), music.structure_verdict(s).alias("verdict"))


@query("SELECT p_size AS k, count(x) < 2 OR stddev_pop(x) <= 1e-12 * max(abs(x)) AS constant FROM (SELECT p_size, CASE WHEN p_size % 2 = 0 THEN p_retailprice ELSE p_size END x FROM part) GROUP BY 1")
def constant_series(spark, sf_dir):
    x = F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice")).otherwise(F.col("p_size").cast("double"))
    return _read(spark, sf_dir, "part").select("p_size", x.alias("x")).groupBy(F.col("p_size").alias("k")).agg(V.is_constant(F.col("x")).alias("constant"))


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id % 50 IN (7, 8)")
def bad_vectors(spark, sf_dir):
    """One row in 50 cut short, one with a number that is not finite."""
    r = F.col("vec_id") % 50
    v = F.when(r == 7, F.slice("embedding", 1, 60)).when(r == 8, F.transform("embedding", lambda x, i: F.when(i == 5, float("nan")).otherwise(x))).otherwise(F.col("embedding"))
    return V.bad_vectors(_read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), v.alias("v")), "v", 64).select("id")


_PROFILES = " UNION ALL ".join(f"SELECT {m} m, unnest({p}::DOUBLE[]) pv, generate_subscripts({p}, 1) - 1 i" for m, p in ((0, signals.MAJOR), (1, signals.MINOR)))


@query(f"""
WITH {_X}, c AS (SELECT id, p - 1 k, abs(a) c FROM x WHERE p <= 12), f AS ({_PROFILES}),
r AS (SELECT id, t, m, corr(c, pv) r FROM c, generate_series(0, 11) g(t), f WHERE i = (k - t + 12) % 12 GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r DESC, t, m) n FROM r)
SELECT id, max(CASE WHEN n = 1 THEN t END)::INT AS pitch, max(CASE WHEN n = 1 THEN m END) = 1 AS minor, round(max(CASE WHEN n = 1 THEN r END), 6) AS r,
round(least(greatest(max(CASE WHEN n = 1 THEN r END) - max(CASE WHEN n = 2 THEN r END), 0), 1), 6) AS confidence FROM o GROUP BY 1""")
def estimate_key(spark, sf_dir):
    t = _tracks(spark, sf_dir).select("id", F.transform(F.slice("v", 1, 12), lambda x: F.abs(x)).alias("chroma"))
    return _rounded(signals.estimate_key(t), "r", "confidence")


@query("SELECT p_partkey AS k, 'org_model__' || substr(sha1(p_name), 1, 16) || '__cfg' AS key FROM part")
def cache_keys(spark, sf_dir):
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), tables.cache_key("org/model", tables.fingerprint("p_name"), "cfg").alias("key"))


@query("SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def uncached_inputs(spark, sf_dir):
    """Customers without such an order stand for inputs that a cache lacks."""
    cached = _read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key"))
    return tables.missing(_read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), cached)


@query(f"""
WITH {_S}, t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY prob DESC, j) r FROM pr), l AS (SELECT id, string_agg('m' || j || ' ' || round(100 * prob)::INT || '%', ', ' ORDER BY r) m FROM t WHERE r <= 3 GROUP BY 1)
SELECT id, 'track ' || id || '<br>moods: ' || m AS hover FROM l""")
def hover_text(spark, sf_dir):
    t = _top(spark, sf_dir, 3).select("id", F.concat(F.lit("track "), F.col("id").cast("string")).alias("filename"), F.transform("top", lambda s: F.concat(F.lit("m"), s["label"].cast("string"))).alias("mood_topk"), F.transform("top", lambda s: s["score"]).alias("mood_topk_scores"))
    return t.select("id", tables.hover_text(t.columns).alias("hover"))
