"""A corpus pipeline: language, boilerplate lines, near copies, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all its predecessor kept; its result is written as Parquet and read
again as the next one's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import jaccard, langid, line_dedup, packing, pii
from geoloom.llm.marks import with_mark
from geoloom.session import checkpoint_folder
from geoloom.shipping import ship

LEAST_LANGUAGE_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those whose language the model can't tell."""
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    marked = langid.identify(docs, model)
    return marked.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that a large share of a source's documents repeat; documents stay."""
    cleaned = line_dedup.drop_site_lines(docs)
    return cleaned.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(
        F.col("n_chars"))).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group of near copies; rows without id stay."""
    groups = jaccard.jaccard_components(docs, words=5, percent=80)
    copies = groups.where("doc_id <> component_id").select("doc_id").distinct()
    # only documents that may be copies are shuffled with their texts
    marked = with_mark(docs, copies, "_copy")
    return marked.where("not _copy").unionByName(marked.where("_copy").join(copies, "doc_id", "left_anti")).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    clean = pii.redact(docs, pii.train(docs))
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def packed_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into training windows."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def _stage(fn):
    @functools.wraps(fn)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, docs, sf_dir)
    return fn.__name__, stage


STAGES = [_stage(f) for f in (language, boilerplate_lines, near_copies, personal_data, packed_windows)]
ORACLE_SQL = None            # language, personal data and packing have no SQL counterpart


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
