"""The corpus pipeline: documents through five operators, each stage written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import common, jaccard, packing, quality, secrets, suffixes


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score of 0.5 or more).

    Null and empty texts are scored as empty; without labels of both classes the share of class 1 decides. Repeated
    rows are kept or dropped together; all columns stay; no documents give none.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).where("score >= 0.5").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id.

    Null and empty texts have no copies and stay. Rows that are equal in id and text stay together; rows without an
    id stay only where their group has no other. All columns stay; no documents give none.
    """
    return jaccard.one_of_each(docs)


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without byte strings of 100 and more that start earlier.

    Every document stays, if with an empty text; null texts stay null. Rows equal in id and text count as one. All
    columns stay, whatever their names; no documents give none.
    """
    return _measured(suffixes.without_repeats(docs))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with the name of its kind in place of each secret.

    Null texts stay null; where spans overlap the first names them; repeated rows are treated alike; all columns but
    helpers named blob and spans stay; no documents give none.
    """
    return _measured(secrets.redact(secrets.scan_versions(docs))).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: a row for each piece of each row.

    Null texts are empty and have the end id alone; repeated rows are packed each; no documents give no pieces.
    """
    import public_tokenizers

    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality_filter), ("near_duplicates", near_duplicates), ("repeats", repeats), ("secrets", secret_redaction), ("packing", best_fit_packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read as the documents of the next."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        path = f"{common.scratch(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
