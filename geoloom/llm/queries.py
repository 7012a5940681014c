"""One query per operator over its whole table, with production parameters, and SQL counterparts where SQL can say it."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import ann, byte_bpe, chat, jaccard, langid, line_dedup, manifest, near_vectors, packing, pii, repair, token_orc, warc
from geoloom.llm.arrow import table
from geoloom.session import checkpoint_folder


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(pii.find(docs, pii.train(docs)))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90)


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_site_lines(docs)


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.link_vectors(table(spark, sf_dir, "embeddings"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "warc")
    warc.write_archives(warc.plan_captures(table(spark, sf_dir, "pages")), path)
    return warc.capture_table(warc.assemble(warc.read_records(spark, path)))


def op9_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "ids")
    token_orc.write_token_orc(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_orc.token_index(spark, path)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.identify(docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))
    return manifest.manifest(docs, shown={"text": tampered})


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair.repair(repair.damage(rows), rows)


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.canonical(table(spark, sf_dir, "conversations"))
    trap = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(chat.TRAP).alias("prompt"), F.lit(chat.TRAP).alias("response"))
    path = _folder(spark, "chats")
    chat.format_chats(rows.unionByName(chat.canonical(trap))).write.parquet(path)
    return chat.digest(chat.read_back(spark.read.parquet(path)))


QUERIES = {f.__name__: f for f in (op1_pii, op2_ngram_jaccard, op3_nearest, op4_packing, op5_line_dedup, op6_near_vectors, op7_byte_bpe,
                                   op8_warc, op9_token_orc, op10_language, op11_manifest, op12_repair, op13_chat)}
ORACLES = {"op2_ngram_jaccard": jaccard.sql(3, 90), "op5_line_dedup": line_dedup.SQL, "op8_warc": warc.SQL, "op11_manifest": manifest.sql(), "op12_repair": repair.sql(),
           "op13_chat": chat.SQL}
