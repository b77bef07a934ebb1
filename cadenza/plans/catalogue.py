"""One query for each operator over the driver's tables, and the same results in SQL for DuckDB.

Tracks are the rows of ``embeddings``; the label matrix is the unit mean of vectors 3j, 3j+1, 3j+2 for
j below 18; clusters are labels with 9 as noise; segments of a track are five vectors in a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions import music
from cadenza.functions import vectors as V
from cadenza.operators import attribution, clusters, labelling, metrics, paths, signals, similarity
from cadenza.sources import tables
from cadenza.streaming import feedback

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tracks(spark, sf_dir):
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), V.l2(F.col("embedding")).alias("v"), "label", F.when(F.col("label") == 9, -1).otherwise(F.col("label")).alias("cluster"))


def _asked(t, by="id"):
    """The queries of a search: every row whose id is divisible by 50."""
    return t.where(F.col(by) % 50 == 0)


def _matrix(spark, sf_dir):
    t = _tracks(spark, sf_dir).where("id < 54").select(F.floor(F.col("id") / 3).cast("int").alias("label"), "v")
    return labelling.label_matrix(t)


def _events(spark, sf_dir):
    kinds = F.create_map(*map(F.lit, ["purchase", "complete", "signup", "replay", "view", "play", "click", "seek", "error", "skip"]))
    k = F.get_json_object("props", "$.k").cast("int")
    return _read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", k.alias("track"), F.element_at(kinds, F.col("event_type")).alias("event"), (k / 100).alias("position"), "value")


_E = "e0 AS (SELECT vec_id id, label, embedding::DOUBLE[] v0 FROM embeddings), e AS (SELECT id, label, CASE WHEN label = 9 THEN -1 ELSE label END cluster, list_transform(v0, lambda x: x / greatest(sqrt(list_dot_product(v0, v0)), 1e-8)) v FROM e0)"
_X = f"{_E}, x AS (SELECT id, label, cluster, unnest(v) a, generate_subscripts(v, 1) p FROM e)"
_M = f"{_X}, m0 AS (SELECT id // 3 j, p, avg(a) a FROM x WHERE id < 54 GROUP BY 1, 2), mn AS (SELECT j, greatest(sqrt(sum(a * a)), 1e-8) n FROM m0 GROUP BY 1), m AS (SELECT j, list(a / n ORDER BY p) v FROM m0 JOIN mn USING (j) GROUP BY j)"
_S = f"{_M}, s AS (SELECT e.id, e.cluster, m.j, list_dot_product(e.v, m.v) s FROM e, m), r AS (SELECT id, cluster, j, s, s - avg(s) OVER (PARTITION BY j) rec FROM s), q AS (SELECT *, exp((rec - max(rec) OVER (PARTITION BY id)) / 0.05) w FROM r), pr AS (SELECT id, cluster, j, s, rec, w / sum(w) OVER (PARTITION BY id) prob FROM q)"
_P = f"{_E}, pairs AS (SELECT a.id, b.id other, list_dot_product(a.v, b.v) cos FROM e a, e b WHERE a.id <> b.id), ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cos DESC, other) rank FROM pairs)"
# searches take as queries every row whose id is divisible by 50
_Q = f"""{_E}, asked AS (SELECT a.id query_id, b.id, b.v, list_dot_product(a.v, b.v) cos FROM e a, e b WHERE a.id % 50 = 0 AND a.id <> b.id),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, id) rank FROM asked)"""
_C = f"{_X}, cs AS (SELECT cluster, p, avg(a) a, count(*) n FROM x WHERE cluster <> -1 GROUP BY 1, 2), c AS (SELECT cluster, max(n) n, list(a ORDER BY p) mean FROM cs GROUP BY 1)"
_EV = "ev AS (SELECT event_id, ts, user_id, CAST(json_extract_string(props, '$.k') AS INT) track, CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'signup' THEN 'replay' WHEN 'view' THEN 'play' WHEN 'click' THEN 'seek' WHEN 'error' THEN 'skip' END event, CAST(json_extract_string(props, '$.k') AS INT) / 100 AS pos, value FROM events)"
_W = f"{_EV}, w AS (SELECT *, CASE WHEN event IN ('complete', 'replay') THEN 1.0::DOUBLE WHEN event = 'skip' THEN CASE WHEN pos < 0.2 THEN -1.0::DOUBLE ELSE -greatest(0.0::DOUBLE, 1 - (pos - 0.2) / 0.8) END ELSE 0.0::DOUBLE END weight FROM ev)"


@query(f"WITH {_X}, n AS (SELECT id, greatest(sqrt(sum(a * a)), 1e-8) n FROM x GROUP BY 1) SELECT x.id, (p - 1)::INT AS pos, round(a / n, 6) AS val FROM x JOIN n USING (id)")
def l2_normalize(spark, sf_dir):
    return _tracks(spark, sf_dir).select("id", F.posexplode(V.l2(F.col("v"))).alias("pos", "val")).select("id", "pos", F.round("val", 6).alias("val"))


@query(f"WITH {_Q} SELECT query_id, id, round(cos, 6) AS cos, rank::INT AS rank FROM near WHERE rank <= 10")
def find_similar(spark, sf_dir):
    t = _tracks(spark, sf_dir)
    return similarity.similar_to(_asked(t), t, 10).withColumn("cos", F.round("cos", 6))


@query(f"WITH {_Q} SELECT query_id, id, round(cos, 6) AS cos, rank::INT AS rank FROM near WHERE rank <= 30 AND (rank - 1) % 3 = 0")
def find_neighbours_spread(spark, sf_dir):
    t = _tracks(spark, sf_dir)
    return similarity.spread_to(_asked(t), t, 10, 3).withColumn("cos", F.round("cos", 6))


@query(f"WITH {_P} SELECT id AS a, other AS b, round(least(greatest(cos, -1), 1), 6) AS cos FROM pairs WHERE id < other AND cos >= 0.4")
def near_duplicate_pairs(spark, sf_dir):
    return similarity.near_pairs(_tracks(spark, sf_dir), 0.4).withColumn("cos", F.round("cos", 6))


@query(f"WITH {_P} SELECT id, other, rank::INT AS rank, round(cos, 6) AS cos FROM ranked WHERE rank <= 10")
def similarity_topk(spark, sf_dir):
    return similarity.top_neighbours(_tracks(spark, sf_dir), 10).withColumn("cos", F.round("cos", 6))


@query(f"WITH {_P} SELECT id, round(1 - least(greatest(avg(cos), -1), 1), 6) AS novelty FROM ranked WHERE rank <= 10 GROUP BY 1")
def knn_novelty(spark, sf_dir):
    return similarity.knn_novelty(_tracks(spark, sf_dir), 10).withColumn("novelty", F.round("novelty", 6))


@query(f"WITH {_P} SELECT least(id, other) AS src, greatest(id, other) AS dst, round(max(greatest(cos, 1e-6)), 6) AS weight FROM ranked WHERE rank <= 15 GROUP BY 1, 2")
def knn_graph_edges(spark, sf_dir):
    return similarity.knn_edges(_tracks(spark, sf_dir), 15).withColumn("weight", F.round("weight", 6))


@query(f"WITH {_P}, g AS (SELECT least(id, other) src, greatest(id, other) dst, max(greatest(cos, 1e-6)) w FROM ranked WHERE rank <= 15 GROUP BY 1, 2), l AS (SELECT g.w, a.label la, b.label lb FROM g JOIN e a ON a.id = src JOIN e b ON b.id = dst), t AS (SELECT sum(w) m, sum(CASE WHEN la = lb THEN w ELSE 0 END) i FROM l), d AS (SELECT label, sum(w) d FROM (SELECT la label, w FROM l UNION ALL SELECT lb, w FROM l) GROUP BY 1) SELECT round(any_value(i) / any_value(m) - sum(pow(d / (2 * m), 2)), 6) AS modularity FROM d, t")
def graph_modularity(spark, sf_dir):
    t = _tracks(spark, sf_dir)
    return similarity.modularity(similarity.knn_edges(t, 15), t).withColumn("modularity", F.round("modularity", 6))


@query(f"""WITH {_E}, s AS (SELECT id // 5 track, id % 5 seg, v FROM e),
b AS (SELECT q.track query, c.track, q.seg, max(list_dot_product(q.v, c.v)) s FROM s q, s c WHERE q.track % 50 = 0 AND c.track <> q.track GROUP BY 1, 2, 3),
t AS (SELECT query, track, sum(s) score FROM b GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, track) rank FROM t)
SELECT query, track, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 20""")
def late_interaction(spark, sf_dir):
    s = _tracks(spark, sf_dir).select(F.floor(F.col("id") / 5).alias("track"), "v")
    return similarity.late_interaction(_asked(s, "track"), s, 20).withColumn("score", F.round("score", 6))


@query(f"WITH {_E}, c AS (SELECT id // 4 label, v FROM e WHERE id < 20) SELECT e.id, c.label::INT AS label, round(sum(exp(-5.0 * (1 - list_dot_product(e.v, c.v)))), 6) AS affinity FROM e, c GROUP BY 1, 2")
def tip_adapter(spark, sf_dir):
    t = _tracks(spark, sf_dir)
    c = t.where("id < 20").select(F.floor(F.col("id") / 4).cast("int").alias("label"), "v")
    return similarity.tip_adapter(t, c).withColumn("affinity", F.round("affinity", 6))


@query(f"""WITH RECURSIVE {_Q}, pool AS MATERIALIZED (SELECT query_id, id, v, cos rel FROM near WHERE rank <= 25),
mmr(query_id, step, id, chosen, vs) AS (SELECT query_id, 1, id, [id], [v] FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, id) k FROM pool) WHERE k = 1 UNION ALL
SELECT query_id, step, id, chosen, vs FROM (SELECT query_id, m.step + 1 AS step, p.id, list_append(m.chosen, p.id) chosen, list_append(m.vs, p.v) vs,
row_number() OVER (PARTITION BY query_id ORDER BY 0.7 * p.rel - 0.3 * list_max(list_transform(m.vs, lambda x: list_dot_product(p.v, x))) DESC, p.rel DESC, p.id) k
FROM mmr m JOIN pool p USING (query_id) WHERE m.step < 5 AND NOT list_contains(m.chosen, p.id)) WHERE k = 1)
SELECT query_id, step::INT AS step, id FROM mmr""")
def mmr(spark, sf_dir):
    t = _tracks(spark, sf_dir)
    return similarity.mmr_to(_asked(t), t, 5).select("query_id", "step", "id")


@query(f"WITH {_X}, t AS (SELECT id // 5 track, p, avg(a) a FROM x GROUP BY 1, 2), n AS (SELECT track, greatest(sqrt(sum(a * a)), 1e-8) n FROM t GROUP BY 1) SELECT track, (p - 1)::INT AS pos, round(a / n, 6) AS val FROM t JOIN n USING (track)")
def pool_clap(spark, sf_dir):
    s = _tracks(spark, sf_dir).select(F.floor(F.col("id") / 5).alias("track"), "v")
    return V.mean_vectors(s, ["track"], "v").select("track", F.posexplode(V.l2(F.col("v"))).alias("pos", "val")).withColumn("val", F.round("val", 6))


@query(f"WITH {_X} SELECT id // 5 AS track, (p - 1)::INT AS pos, round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS std FROM x GROUP BY 1, 2")
def pool_mean_std(spark, sf_dir):
    long = _tracks(spark, sf_dir).select(F.floor(F.col("id") / 5).alias("track"), F.posexplode("v").alias("pos", "a"))
    return long.groupBy("track", "pos").agg(F.round(F.avg("a"), 6).alias("mean"), F.round(F.stddev_pop("a"), 6).alias("std"))


@query(f"WITH {_M} SELECT m.j::INT AS label, (g - 1)::INT AS pos, round(m.v[g], 6) AS val FROM m, generate_series(1, 64) t(g)")
def label_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir).select("label", F.posexplode("v").alias("pos", "val")).withColumn("val", F.round("val", 6))


@query(f"WITH {_M} SELECT a.j::INT AS a, b.j::INT AS b, round(list_dot_product(a.v, b.v), 6) AS cos FROM m a, m b WHERE a.j < b.j")
def label_redundancy(spark, sf_dir):
    return labelling.redundancy(_matrix(spark, sf_dir)).withColumn("cos", F.round("cos", 6))


@query(f"WITH {_S} SELECT j::INT AS label, round(avg(s), 6) AS prior FROM s GROUP BY 1")
def label_prior(spark, sf_dir):
    return labelling.label_prior(labelling.similarities(_tracks(spark, sf_dir), _matrix(spark, sf_dir))).withColumn("prior", F.round("prior", 6))


@query(f"WITH {_S} SELECT id, j::INT AS label, round(s, 6) AS sim, round(rec, 6) AS rec, round(prob, 6) AS prob FROM pr")
def score_moods(spark, sf_dir):
    s = labelling.score_moods(_tracks(spark, sf_dir), _matrix(spark, sf_dir))
    return s.select("id", F.posexplode(F.arrays_zip("sims", "rec", "probs")).alias("label", "z")).select("id", "label", F.round("z.sims", 6).alias("sim"), F.round("z.rec", 6).alias("rec"), F.round("z.probs", 6).alias("prob"))


def _top(spark, sf_dir, k=3):
    return labelling.top_labels(labelling.score_moods(_tracks(spark, sf_dir), _matrix(spark, sf_dir)), k)


@query(f"WITH {_S}, t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY prob DESC, j) r FROM pr) SELECT id, r::INT AS rank, j::INT AS label, round(prob, 6) AS score FROM t WHERE r <= 3")
def label_tracks_top3(spark, sf_dir):
    return _top(spark, sf_dir).select("id", F.posexplode("top").alias("p", "t")).select("id", (F.col("p") + 1).alias("rank"), F.col("t.label").alias("label"), F.round("t.score", 6).alias("score"))


@query(f"WITH {_S}, a AS (SELECT id, max(CASE WHEN j = 1 THEN s END) - max(CASE WHEN j = 0 THEN s END) d FROM s GROUP BY 1) SELECT id, round(1 / (1 + exp(-(d - avg(d) OVER ()) / 0.05)), 6) AS value FROM a")
def attribute_axis(spark, sf_dir):
    return labelling.score_axis(_tracks(spark, sf_dir), _matrix(spark, sf_dir).where("label < 2")).withColumn("value", F.round("value", 6))


@query(f"WITH {_S}, a AS (SELECT cluster, j, avg(rec) m FROM r GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY m DESC, j) k FROM a) SELECT cluster, k::INT AS rank, j::INT AS label, round(m, 6) AS mean FROM t WHERE k <= 3")
def cluster_profiles(spark, sf_dir):
    s = labelling.score_moods(_tracks(spark, sf_dir), _matrix(spark, sf_dir))
    return labelling.cluster_profiles(s).withColumn("mean", F.round("mean", 6))


@query(f"WITH {_S}, t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY prob DESC, j) r FROM pr), n AS (SELECT cluster, j, count(*) n, min(id) f FROM t WHERE r = 1 GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, f) r FROM n) SELECT cluster, j::INT AS label, n FROM k WHERE r = 1")
def name_clusters(spark, sf_dir):
    return labelling.name_clusters(_top(spark, sf_dir, 1).select("id", "cluster", F.col("top")[0]["label"].alias("label")))


@query(f"WITH {_S}, t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY prob DESC, j) r FROM pr), u AS (SELECT id, max(CASE WHEN r = 1 THEN j END) top, max(CASE WHEN r = 1 THEN prob END) a, max(CASE WHEN r = 2 THEN prob END) b FROM t GROUP BY 1), h AS (SELECT top, count(*) n FROM u GROUP BY 1) SELECT (SELECT count(*) FROM h) AS n_distinct, round((SELECT max(n) / sum(n) FROM h), 6) AS max_share, round(avg(a - b), 6) AS mean_margin, round(avg(a), 6) AS mean_top FROM u")
def labeling_quality(spark, sf_dir):
    q = labelling.quality_metrics(_top(spark, sf_dir, 2))
    return q.withColumns({c: F.round(c, 6) for c in ("max_share", "mean_margin", "mean_top")})


@query(f"WITH {_M}, w AS (SELECT p.g, 0.5 * a.v[g] + 2.0 * b.v[g] x FROM m a, m b, generate_series(1, 64) p(g) WHERE a.j = 2 AND b.j = 7), n AS (SELECT greatest(sqrt(sum(x * x)), 1e-8) n FROM w) SELECT (g - 1)::INT AS pos, round(x / n, 6) AS val FROM w, n")
def compose_mood_vector(spark, sf_dir):
    return labelling.compose(_matrix(spark, sf_dir), {2: 0.5, 7: 2.0, 99: 1.0}).select(F.posexplode("v").alias("pos", "val")).withColumn("val", F.round("val", 6))


@query(f"WITH {_S} SELECT id, round(-sum(prob * ln(prob)), 6) AS entropy, round(max(prob) - max(CASE WHEN k = 2 THEN prob END), 6) AS margin FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY prob DESC) k FROM pr WHERE prob > 0) GROUP BY 1")
def entropy_margin(spark, sf_dir):
    s = labelling.score_moods(_tracks(spark, sf_dir), _matrix(spark, sf_dir))
    return s.select("id", F.round(V.entropy(F.col("probs")), 6).alias("entropy"), F.round(V.margin(F.col("probs")), 6).alias("margin"))


@query(f"WITH {_E} SELECT count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS n_clusters, round(avg(CASE WHEN cluster = -1 THEN 1.0 ELSE 0.0 END), 6) AS noise_ratio, count(*) AS n FROM e")
def cluster_metrics(spark, sf_dir):
    return clusters.cluster_metrics(_tracks(spark, sf_dir)).withColumn("noise_ratio", F.round("noise_ratio", 6))


@query(f"WITH {_E}, n AS (SELECT count(*) n FROM e GROUP BY cluster), p AS (SELECT n / sum(n) OVER () p FROM n), h AS (SELECT count(*) bins, sum(-p * log2(p)) h FROM p) SELECT bins, round(h, 6) AS entropy, round(h / log2(bins), 6) AS normalised, round(pow(2, h), 6) AS perplexity FROM h")
def coverage_entropy(spark, sf_dir):
    c = clusters.coverage_entropy(_tracks(spark, sf_dir))
    return c.select("bins", *[F.round(x, 6).alias(x) for x in ("entropy", "normalised", "perplexity")])


@query(f"WITH {_C}, d AS (SELECT e.id, e.cluster own, c.cluster, c.n, 1 - list_dot_product(e.v, c.mean) d FROM e, c WHERE e.cluster <> -1), ab AS (SELECT id, own, max(CASE WHEN own = cluster THEN d * n / (n - 1) END) a, min(CASE WHEN own <> cluster THEN d END) b FROM d GROUP BY 1, 2) SELECT own AS cluster, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM ab GROUP BY 1")
def per_cluster_silhouette(spark, sf_dir):
    return clusters.silhouettes(_tracks(spark, sf_dir)).groupBy("cluster").agg(F.round(F.avg("s"), 6).alias("silhouette"))


@query(f"WITH {_C}, s AS (SELECT e.id, e.cluster, (list_dot_product(e.v, c.mean) * c.n - list_dot_product(e.v, e.v)) / (c.n - 1) ms FROM e JOIN c USING (cluster)), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY ms DESC, id) k FROM s) SELECT cluster, id FROM r WHERE k = 1")
def medoids(spark, sf_dir):
    return clusters.medoids(_tracks(spark, sf_dir))


@query(f"WITH {_C} SELECT e.id, round(CASE WHEN e.cluster = -1 THEN 1.0 ELSE 1 - list_dot_product(e.v, c.mean) / sqrt(list_dot_product(c.mean, c.mean)) END, 6) AS score FROM e LEFT JOIN c USING (cluster)")
def outlier_scores(spark, sf_dir):
    return clusters.outlier_scores(_tracks(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"WITH {_X}, a AS (SELECT p, avg(a) a FROM x GROUP BY 1) SELECT round(sum(a * a), 6) AS mean_cosine FROM a")
def mean_pairwise_cosine(spark, sf_dir):
    return clusters.mean_pairwise_cosine(_tracks(spark, sf_dir)).withColumn("mean_cosine", F.round("mean_cosine", 6))


def _step_sql(n: int, source: str) -> str:
    """Assignment by centres ``source`` (cluster, c) and the next centres."""
    return f"a{n} AS (SELECT id, cluster FROM (SELECT e.id, c.cluster, row_number() OVER (PARTITION BY e.id ORDER BY list_dot_product(e.v, c.c) DESC, c.cluster) k FROM e, {source} c) WHERE k = 1), u{n} AS (SELECT a.cluster, x.p, avg(x.a) a FROM a{n} a JOIN x USING (id) GROUP BY 1, 2), c{n} AS (SELECT cluster, list(a / n ORDER BY p) c FROM u{n} JOIN (SELECT cluster, sqrt(sum(a * a)) n FROM u{n} GROUP BY 1) USING (cluster) GROUP BY cluster)"


@query(f"WITH {_E}, x AS (SELECT id, unnest(v) a, generate_subscripts(v, 1) p FROM e), c0 AS (SELECT id cluster, v c FROM e WHERE id < 8), {_step_sql(1, 'c0')}, {_step_sql(2, 'c1')}, {_step_sql(3, 'c2')} SELECT id, cluster::INT AS cluster FROM a3")
def spherical_kmeans_2iter(spark, sf_dir):
    t = _tracks(spark, sf_dir)
    c = t.where("id < 8").select(F.col("id").cast("int").alias("cluster"), V.l2(F.col("v")).alias("c"))
    return clusters.spherical_kmeans(t.select("id", "v"), c, 2)


@query()
def kmeans(spark, sf_dir):
    return clusters.kmeans(_tracks(spark, sf_dir), 8)


@query()
def pca_2d(spark, sf_dir):
    return clusters.pca(_tracks(spark, sf_dir))


@query("WITH d AS (SELECT n_chars::DOUBLE score, quality = 1 positive FROM documents JOIN labels USING (doc_id)), r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 rk FROM d) SELECT round((sum(CASE WHEN positive THEN rk END) - sum(positive::INT) * (sum(positive::INT) + 1) / 2) / (sum(positive::INT) * (count(*) - sum(positive::INT))), 6) AS auc, count(*) AS n FROM r")
def axis_auc(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", "n_chars").join(_read(spark, sf_dir, "labels"), "doc_id")
    return metrics.roc_auc(d.select(F.col("n_chars").cast("double").alias("score"), (F.col("quality") == 1).alias("positive"))).withColumn("auc", F.round("auc", 6))


@query(f"WITH {_S}, k AS (SELECT j, id, row_number() OVER (PARTITION BY j ORDER BY s DESC, id) rank, (cluster = j % 9)::INT rel FROM s), h AS (SELECT *, sum(rel) OVER (PARTITION BY j ORDER BY rank) hits FROM k), g AS (SELECT j, sum(rel) n, sum(CASE WHEN rank <= 10 THEN rel ELSE 0 END) top, sum(CASE WHEN rel = 1 THEN hits / rank ELSE 0 END) ap, sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) ELSE 0 END) dcg FROM h GROUP BY 1) SELECT j::INT AS query, round(top / 10, 6) AS precision, round(top / n, 6) AS recall, round(ap / n, 6) AS average_precision, round(dcg / (SELECT sum(1 / log2(i + 1)) FROM generate_series(1, 10) t(i) WHERE i <= n), 6) AS ndcg FROM g")
def text_query_eval(spark, sf_dir):
    m = metrics.ranking_metrics(text_query_ranks(spark, sf_dir), 10)
    return m.select("query", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "average_precision", "ndcg")])


def text_query_ranks(spark, sf_dir):
    """(query, rank, relevant): tracks by their similarity to each label."""
    s = labelling.similarities(_tracks(spark, sf_dir), _matrix(spark, sf_dir)).select("id", "cluster", F.posexplode("sims").alias("query", "s"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("s"), "id"))
    return s.select("query", rank.alias("rank"), (F.col("cluster") == F.col("query") % 9).alias("relevant"))


@query("WITH d AS (SELECT l_quantity a, l_extendedprice / 1000 b FROM lineitem), m AS (SELECT covar_pop(a, b) c, var_pop(a) va, var_pop(b) vb, avg(a) ma, avg(b) mb, corr(a, b) r FROM d) SELECT round(2 * c / (va + vb + pow(ma - mb, 2)), 6) AS ccc, round(r, 6) AS pearson, round(2 / (sqrt(va / vb) + 1 / sqrt(va / vb) + pow((ma - mb) / sqrt(sqrt(va) * sqrt(vb)), 2)), 6) AS bias FROM m")
def ccc(spark, sf_dir):
    d = _read(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"))
    return metrics.concordance(d).select(*[F.round(c, 6).alias(c) for c in ("ccc", "pearson", "bias")])


@query("WITH d AS (SELECT p_size::DOUBLE a, p_retailprice b FROM part), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 rb FROM d) SELECT round(corr(ra, rb), 6) AS spearman FROM r")
def spearman(spark, sf_dir):
    d = _read(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    return metrics.spearman(d).withColumn("spearman", F.round("spearman", 6))


@query("WITH d AS (SELECT quality t, CASE WHEN n_chars > 800 THEN 1 ELSE 0 END p FROM documents JOIN labels USING (doc_id)), l AS (SELECT unnest([0, 1]) l), f AS (SELECT l, 2 * sum((t = l AND p = l)::INT) / (sum((t = l)::INT) + sum((p = l)::INT)) f FROM d, l GROUP BY 1) SELECT round(avg(f), 6) AS macro_f1 FROM f")
def macro_f1(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", "n_chars").join(_read(spark, sf_dir, "labels"), "doc_id")
    return metrics.macro_f1(d.select(F.col("quality").alias("truth"), F.when(F.col("n_chars") > 800, 1).otherwise(0).alias("predicted"))).withColumn("macro_f1", F.round("macro_f1", 6))


@query("WITH d AS (SELECT l_returnflag a, l_linestatus b FROM lineitem), t AS (SELECT a, b, count(*)::DOUBLE n FROM d GROUP BY 1, 2), k AS (SELECT *, sum(n) OVER (PARTITION BY a) ra, sum(n) OVER (PARTITION BY b) rb, sum(n) OVER () al FROM t), s AS (SELECT any_value(al) al, sum(n * (n - 1) / 2) i, sum(n / al * ln(n * al / (ra * rb))) mi FROM k), ha AS (SELECT sum(n * (n - 1) / 2) c, sum(-n / al * ln(n / al)) h FROM (SELECT a, sum(n) n, any_value(al) al FROM k GROUP BY 1)), hb AS (SELECT sum(n * (n - 1) / 2) c, sum(-n / al * ln(n / al)) h FROM (SELECT b, sum(n) n, any_value(al) al FROM k GROUP BY 1)) SELECT round((i - ha.c * hb.c / (al * (al - 1) / 2)) / (0.5 * (ha.c + hb.c) - ha.c * hb.c / (al * (al - 1) / 2)), 6) AS ari, round(mi / ((ha.h + hb.h) / 2), 6) AS nmi FROM s, ha, hb")
def agreement(spark, sf_dir):
    d = _read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"))
    return clusters.agreement(d).select(F.round("ari", 6).alias("ari"), F.round("nmi", 6).alias("nmi"))


def _confidence(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", "n_chars").join(_read(spark, sf_dir, "labels"), "doc_id")
    return d.select((F.col("n_chars") / (F.col("n_chars") + 1001.5)).alias("conf"), (F.col("quality") == 1).alias("correct"))


_CONF = "d AS (SELECT n_chars / (n_chars + 1001.5::DOUBLE) conf, quality = 1 correct FROM documents JOIN labels USING (doc_id)), b AS (SELECT least(floor(conf * 10), 9)::INT bin, count(*) n, avg(conf) confidence, avg(correct::INT) accuracy FROM d GROUP BY 1)"


@query(f"WITH {_CONF} SELECT bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM b")
def reliability_diagram(spark, sf_dir):
    return metrics.reliability(_confidence(spark, sf_dir)).select("bin", "n", F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy"))


@query(f"WITH {_CONF} SELECT round(sum(n * abs(accuracy - confidence)) / sum(n), 6) AS ece FROM b")
def ece(spark, sf_dir):
    return metrics.expected_calibration_error(_confidence(spark, sf_dir)).withColumn("ece", F.round("ece", 6))


def _probs(spark, sf_dir):
    return labelling.score_moods(_tracks(spark, sf_dir), _matrix(spark, sf_dir)).select("id", "probs", F.col("rec").alias("logits"), F.col("label").alias("label"))


@query(f"WITH {_S} SELECT round(avg(-ln(greatest(least(prob, 1), 1e-12))), 6) AS nll FROM pr JOIN e USING (id) WHERE j = label")
def nll(spark, sf_dir):
    return metrics.negative_log_likelihood(_probs(spark, sf_dir)).withColumn("nll", F.round("nll", 6))


@query(f"WITH {_S}, y AS (SELECT pr.id, prob, label FROM pr JOIN e USING (id) WHERE j = label), a AS (SELECT pr.id, sum(CASE WHEN pr.prob > y.prob OR (pr.prob = y.prob AND j <= y.label) THEN pr.prob ELSE 0 END) sc FROM pr JOIN y USING (id) GROUP BY 1), k AS (SELECT sc, row_number() OVER (ORDER BY sc) r, count(*) OVER () n FROM a) SELECT round(sc, 6) AS q_hat FROM k WHERE r = ceil((n + 1) * 0.9)")
def aps_threshold(spark, sf_dir):
    return metrics.aps_threshold(metrics.aps_scores(_probs(spark, sf_dir)), 0.9).withColumn("q_hat", F.round("q_hat", 6))


@query(f"WITH {_S}, c AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY prob DESC, j) k FROM pr), d AS (SELECT *, sum(prob) OVER (PARTITION BY id ORDER BY k) - prob before FROM c) SELECT id, count(*)::INT AS size FROM d WHERE k = 1 OR before < 0.9 GROUP BY 1")
def prediction_set(spark, sf_dir):
    return metrics.prediction_sets(_probs(spark, sf_dir), 0.9).select("id", F.size("labels").alias("size"))


@query(f"WITH {_S}, g AS (SELECT unnest([0.01, 0.02, 0.05, 0.1, 0.2, 0.5])::DOUBLE t), z AS (SELECT id, max(rec) mx FROM r GROUP BY 1), y AS (SELECT r.id, rec FROM r JOIN e USING (id) WHERE j = label), l AS (SELECT t, r.id, ln(sum(exp((r.rec - mx) / t))) - (any_value(y.rec) - any_value(mx)) / t v FROM g, r JOIN z USING (id) JOIN y USING (id) GROUP BY 1, 2), n AS (SELECT t, avg(least(v, 27.631021115928547)) nll FROM l GROUP BY 1) SELECT t AS temperature, round(nll, 6) AS nll FROM n ORDER BY n.nll, t LIMIT 1")
def temperature_grid(spark, sf_dir):
    return metrics.fit_temperature(_probs(spark, sf_dir), [0.01, 0.02, 0.05, 0.1, 0.2, 0.5]).withColumn("nll", F.round("nll", 6))


@query(f"WITH {_W} SELECT event_id, round(weight, 6) AS weight FROM w")
def implicit_weight(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.round(music.implicit_weight(F.col("event"), F.col("position")), 6).alias("weight"))


@query(f"WITH {_W} SELECT track, round(tanh(0.5 * sum(weight)), 6) AS affinity FROM w WHERE weight <> 0 GROUP BY 1")
def aggregate_implicit(spark, sf_dir):
    return feedback.aggregate_implicit(_events(spark, sf_dir)).withColumn("affinity", F.round("affinity", 6))


@query(f"WITH {_EV}, g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000 THEN 1 ELSE 0 END n FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) s FROM g) SELECT user_id AS key, s::BIGINT AS session, count(*) AS n FROM s GROUP BY 1, 2")
def sessions(spark, sf_dir):
    return feedback.sessions(_events(spark, sf_dir).select(F.col("user_id").alias("key"), "ts"), 360)


@query(f"WITH {_EV}, d AS (SELECT user_id k, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts) d FROM ev) SELECT k AS key, round(60 / avg(d), 6) AS bpm, round(stddev_pop(d) / avg(d), 6) AS cv, count(*) AS beats FROM d WHERE d > 0 GROUP BY 1")
def bpm_from_beats(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("user_id").alias("key"), (F.unix_micros("ts") / 1e6).alias("t"))
    return signals.tempo(e).select("key", F.round("bpm", 6).alias("bpm"), F.round("cv", 6).alias("cv"), "beats")


@query("WITH p AS (SELECT p_partkey k, p_retailprice / 10 b FROM part) SELECT k, round(CASE WHEN b <= 0 THEN NULL WHEN b < 70 THEN b * pow(2, ceil(log2(70 / b))) WHEN b >= 180 THEN b / pow(2, floor(log2(b / 180)) + 1) ELSE b END, 6) AS bpm FROM p")
def fold_octave(spark, sf_dir):
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.round(music.fold_octave(F.col("p_retailprice") / 10), 6).alias("bpm"))


@query("WITH p AS (SELECT p_partkey k, p_size + 60 a, p_retailprice / 10 b FROM part) SELECT k, round(exp(-pow(least(abs(log2(a / b)), abs(log2(2 * a / b)), abs(log2(a / b / 2))) / 0.05, 2) / 2), 6) AS compat FROM p")
def tempo_compat(spark, sf_dir):
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.round(music.tempo_compat((F.col("p_size") + 60).cast("double"), F.col("p_retailprice") / 10), 6).alias("compat"))


@query("WITH p AS (SELECT p_partkey k, p_partkey % 12 pc, p_size % 2 = 0 mi FROM part) SELECT k, [8, 3, 10, 5, 12, 7, 2, 9, 4, 11, 6, 1][((pc + CASE WHEN mi THEN 3 ELSE 0 END) % 12 + 1)::INT]::VARCHAR || CASE WHEN mi THEN 'A' ELSE 'B' END AS code FROM p")
def camelot_code(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("k"), music.to_camelot(F.col("p_partkey") % 12, F.col("p_size") % 2 == 0).alias("code"))


@query('WITH p AS (SELECT p_partkey k, p_size * 100 + p_partkey n FROM part), s AS (SELECT k, n, unnest(generate_series(0, n - 1, 750)) b FROM p) SELECT k AS id, (b // 750)::INT AS seg, b / 100.0 AS start, least(b + 1000, n) / 100.0 AS "end" FROM s WHERE b + 1000 <= n OR (b = 750 * greatest(0, ceil((n - 999) / 750)) AND (n - b >= 100 OR b = 0))')
def segment_bounds(spark, sf_dir):
    p = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 100 + F.col("p_partkey")).cast("long").alias("n_samples"))
    return signals.segment_bounds(p, 100, 10.0, 2.5, 1.0)


@query("WITH p AS (SELECT p_partkey k, p_size n FROM part), i AS (SELECT DISTINCT k, CASE WHEN n <= 12 THEN i ELSE round_even(i * (n - 1) / 11, 0)::INT END w FROM p, generate_series(0, 11) t(i) WHERE n > 12 OR i < n) SELECT k AS id, count(*)::INT AS kept, sum(w)::BIGINT AS total FROM i GROUP BY 1")
def segment_cap_uniform(spark, sf_dir):
    p = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(signals.capped(F.col("p_size"), 12)).alias("w"))
    return p.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("kept"), F.sum("w").alias("total"))


@query("SELECT p_partkey AS id, player::INT AS player, round(CASE player WHEN 0 THEN p_size WHEN 1 THEN p_retailprice / 100 ELSE 1.5 END + CASE WHEN player < 2 THEN p_size * 0.5 ELSE 0 END, 6) AS phi FROM part, generate_series(0, 2) t(player)")
def shapley_exact(spark, sf_dir):
    """Worth of a coalition: its own terms, and p_size more if players 0 and 1 are both in it."""
    bit = lambda k: F.col("mask").bitwiseAND(1 << k) != 0
    term = lambda c, x: F.when(c, x).otherwise(0.0)
    size = F.col("p_size").cast("double")
    value = term(bit(0), size) + term(bit(1), F.col("p_retailprice") / 100) + term(bit(2), F.lit(1.5)) + term(bit(0) & bit(1), size)
    v = _read(spark, sf_dir, "part").withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(7)))).select(F.col("p_partkey").alias("id"), "mask", value.alias("value"))
    return attribution.shapley(v, 3).withColumn("phi", F.round("phi", 6))


@query(f"WITH {_S}, t AS (SELECT id, cluster, 1 / (1 + exp(-s * 20)) en, 1 / (1 + exp(s * 10)) va FROM s WHERE j = 0) SELECT cluster, count(*) AS n, round(avg(en), 6) AS energy, round(avg(va), 6) AS valence, array_to_string(list(id ORDER BY id)[1:6], ',') AS examples FROM t GROUP BY 1")
def cluster_report_rows(spark, sf_dir):
    s = labelling.similarities(_tracks(spark, sf_dir), _matrix(spark, sf_dir))
    x = F.col("sims")[0]
    r = tables.cluster_report(s.select("id", "cluster", (1 / (1 + F.exp(-x * 20))).alias("energy"), (1 / (1 + F.exp(x * 10))).alias("valence")))
    return r.select("cluster", "n", F.round("energy", 6).alias("energy"), F.round("valence", 6).alias("valence"), "examples")


@query()
def journey_slerp(spark, sf_dir):
    t = _tracks(spark, sf_dir)
    ends = {r["id"]: r["v"] for r in t.where("id IN (0, 1)").collect()}
    return paths.journey(t, ends[0], ends[1], 8)


@query()
def journey_transport(spark, sf_dir):
    t = _tracks(spark, sf_dir)
    ends = {r["id"]: r["v"] for r in t.where("id IN (0, 1)").collect()}
    return paths.ot_morph(t, ends[0], ends[1], 8)


@query()
def smooth_order(spark, sf_dir):
    return paths.smooth_order(_tracks(spark, sf_dir).select(F.floor(F.col("id") / 10).alias("playlist"), "id", "v"))
