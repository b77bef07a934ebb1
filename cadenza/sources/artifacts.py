"""Written results: cached vectors, assignments, playlists, reports and pages."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.sources.tables import cluster_report, hover_text

#: Columns that every written assignment has, also without rows.
ASSIGNMENTS = "path string, filename string, cluster int, x double, y double, top_mood string, top_score double, mood_topk array<string>, mood_topk_scores array<double>, energy double, valence double"


def save_cached(vectors: DataFrame, path: str, key: str) -> None:
    """Adds ``vectors`` (path, key, v) to a cache under the tag of the settings; commits of the writer make it whole or nothing."""
    vectors.withColumn("tag", F.lit(key)).write.mode("append").partitionBy("tag").parquet(path)


def load_cached(spark: SparkSession, path: str, key: str, inputs: DataFrame) -> DataFrame:
    """``inputs`` (path, key) with ``v``, null where the cache lacks them; of repeated entries any one counts."""
    try:
        cache = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return inputs.withColumn("v", F.lit(None).cast("array<double>"))
    mine = cache.where(F.col("tag") == key).groupBy("key").agg(F.first("v").alias("v"))
    return inputs.join(mine, "key", "left")


def empty_assignments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ASSIGNMENTS)


def slug(name):
    """Lower case, anything but letters and digits as one underscore, none at the ends; 'unknown' for nothing."""
    s = F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "_"), F.lit("_"))
    return F.when(F.coalesce(s, F.lit("")) == "", "unknown").otherwise(s)


def playlists(assigned: DataFrame) -> DataFrame:
    """(name, line_no, line) of one extended M3U file for each cluster of ``assigned`` (id, cluster, path, top_mood), tracks in order of ids.

    A file is named by its cluster and the commonest mood of it, ties to the one seen first; noise by noise.
    """
    n = assigned.groupBy("cluster", "top_mood").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    top = n.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "first"))).where("r = 1")
    suffix = F.when(F.col("cluster") == -1, "noise").when(F.coalesce("top_mood", F.lit("")) != "", slug(F.col("top_mood")))
    named = top.select("cluster", F.concat_ws("_", F.lit("cluster"), F.col("cluster").cast("string"), suffix).alias("name"))
    title = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    rows = assigned.join(F.broadcast(named), "cluster").withColumn("at", F.row_number().over(Window.partitionBy("cluster").orderBy("id")))
    lines = F.array(F.concat(F.lit("#EXTINF:-1,"), title), F.col("path"))
    body = rows.select("name", "at", F.posexplode(lines).alias("p", "line")).select("name", (F.col("at") * 2 + F.col("p") - 1).alias("line_no"), "line")
    return named.select("name", F.lit(0).alias("line_no"), F.lit("#EXTM3U").alias("line")).unionByName(body)


def export_playlists(assigned: DataFrame, path: str) -> None:
    """`playlists` as text, one folder for each; what was there before is replaced."""
    p = playlists(assigned).repartition("name").sortWithinPartitions("name", "line_no")
    p.select("name", F.col("line").alias("value")).write.mode("overwrite").partitionBy("name").text(path)


def report_lines(assigned: DataFrame, title: str = "Clusters") -> list[str]:
    """A Markdown report with a row for each cluster, of which there are few; noise comes last."""
    rows = cluster_report(assigned).orderBy(F.col("cluster") == -1, "cluster").collect()
    number = lambda x: "" if x is None else f"{x:.2f}"
    out = [f"# {title}", "", f"{sum(r['n'] for r in rows)} tracks in {sum(r['cluster'] != -1 for r in rows)} clusters", "", "| cluster | tracks | energy | valence | examples |", "|-|-|-|-|-|"]
    for r in rows:
        name = "noise" if r["cluster"] == -1 else str(r["cluster"])
        out.append(f"| {name} | {r['n']} | {number(r['energy'])} | {number(r['valence'])} | {r['examples']} |")
    return out


def scatter_page(assigned: DataFrame, x: str, y: str, title: str, most: int = 5000) -> str:
    """An HTML page with a point for each row, at most ``most`` by a hash of the id, which shows its text when pointed at."""
    text = hover_text(assigned.columns).alias("text")
    rows = assigned.where(F.col(x).isNotNull() & F.col(y).isNotNull()).orderBy(F.xxhash64("id"), "id").limit(most).select("cluster", x, y, text).collect()
    xs, ys = [r[1] for r in rows], [r[2] for r in rows]
    place = lambda v, all_: 20 + 560 * (v - min(all_)) / ((max(all_) - min(all_)) or 1)
    hue = lambda c: "#999" if c == -1 else f"hsl({c * 137 % 360},65%,45%)"
    dots = [f'<circle cx="{place(r[1], xs):.1f}" cy="{600 - place(r[2], ys):.1f}" r="4" fill="{hue(r["cluster"])}"><title>{html.escape(r["text"].replace("<br>", chr(10)))}</title></circle>' for r in rows]
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><svg width="600" height="600">{"".join(dots)}</svg>'


def dashboard_page(title: str, lines: list[str], pages: dict[str, str]) -> str:
    """One HTML page of a report's lines with links to other pages."""
    links = "".join(f'<li><a href="{html.escape(href)}">{html.escape(name)}</a></li>' for name, href in pages.items())
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><ul>{links}</ul><pre>{html.escape(chr(10).join(lines))}</pre>'


def labelling_page(tracks: DataFrame, labels: list[str], most: int = 500) -> str:
    """A form for the rows of ``tracks`` (id, filename, score) that are most worth a label, best first."""
    rows = tracks.orderBy(F.desc("score"), "id").limit(most).select("id", "filename").collect()
    options = "".join(f"<option>{html.escape(x)}</option>" for x in ["", *labels])
    items = "".join(f'<li>{html.escape(r["filename"])} <select name="{r["id"]}">{options}</select></li>' for r in rows)
    return f'<!doctype html><meta charset="utf-8"><form><ol>{items}</ol></form>'


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small text file, through the session's own file system."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_artifacts(assigned: DataFrame, path: str) -> dict[str, str]:
    """Writes assignments, playlists, report and pages below ``path``; name to place of each. The mood page needs energy and valence."""
    spark, out = assigned.sparkSession, {}

    def text(name: str, content: str) -> None:
        out[name] = f"{path}/{name}"
        write_text(spark, out[name], content)

    out["assignments.parquet"] = f"{path}/assignments.parquet"
    assigned.write.mode("overwrite").parquet(out["assignments.parquet"])
    kept = spark.read.parquet(out["assignments.parquet"])
    text("clusters.html", scatter_page(kept, "x", "y", "Clusters"))
    if kept.where(F.col("energy").isNotNull() & ~F.isnan("energy")).limit(1).count():
        text("mood_space.html", scatter_page(kept.where(~F.isnan("energy") & ~F.isnan("valence")), "valence", "energy", "Moods"))
    lines = report_lines(kept)
    text("cluster_report.md", "\n".join(lines))
    text("dashboard.html", dashboard_page("Collection", lines, {n: n for n in out if n.endswith(".html")}))
    out["playlists"] = f"{path}/playlists"
    export_playlists(kept, out["playlists"])
    return out
