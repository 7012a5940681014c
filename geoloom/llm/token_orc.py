"""Token ids in ORC files, in ascending order of the document id.

ORC keeps the ids run-length encoded in stripes, with row indexes and a Bloom filter on the document id: a reader takes
stripes in parallel and skips, by metadata alone, those that cannot hold a wanted document.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.llm.arrow import append
from geoloom.llm.byte_bpe import list_values
from geoloom.llm.subword import encoder

STRIPE_BYTES = 64 << 20
ROWS_PER_FILE = 50_000


def write_token_orc(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, key: str = "doc_id", text: str = "text",
                    stripe_bytes: int = STRIPE_BYTES, rows_per_file: int = ROWS_PER_FILE, kind: str = "byte_json") -> None:
    """Writes ``(doc_id, n_tokens, ids)``, every document closed by ``end_id``, null or empty texts by that alone.

    Texts are dealt by ranges of the key (equal keys by a hash of the text, so that one key may span tasks), then encoded
    where they lie. ``rows_per_file`` splits files, which bounds what a task gathers when the files are numbered. Null
    keys come first.
    """
    def one(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        ids, rows = encoder(kind, tokenizer_path).encode(batch.column("text"))
        n = len(rows) - 1
        out = np.full(len(ids) + n, end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(rows))] = ids
        return {"n_tokens": pa.array(np.diff(rows) + 1),
                "ids": pa.ListArray.from_arrays((rows + np.arange(n + 1)).astype(np.int32), pa.array(out.astype(np.int32)))}
    texts = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text")]
    ranged = texts.repartitionByRange(*order).sortWithinPartitions(*order)
    append(ranged, one, "n_tokens long, ids array<int>").drop("text").write.option("orc.stripe.size", stripe_bytes).option(
        "orc.create.index", "true").option("orc.bloom.filter.columns", "doc_id").option("compression", "zstd").option(
        "maxRecordsPerFile", rows_per_file).orc(path)


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, n_tokens long, ids array<int>").orc(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` from the files: ids of all documents before, length, checksum.

    Ids are summed per file first; a window over the files' sums (one row each) gives every file its base, and a window
    inside each file, which ``rows_per_file`` bounds, the rest. Rows with equal keys follow each other in file order.
    """
    def one(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        flat, rows = list_values(batch.column("ids"))
        raw = flat.astype("<u4")
        return {"ids_crc32": pa.array([zlib.crc32(raw[a:b]) for a, b in zip(rows[:-1], rows[1:])], pa.int64()),
                "counted": pa.array(np.diff(rows))}
    # part files are numbered in key order, and so are the files that one task split its rows into
    part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long").alias("part")
    split = F.regexp_extract("_metadata.file_name", r"-c(\d+)", 1).cast("long").alias("split")
    files = read_token_orc(spark, path)
    sums = files.select("n_tokens", part, split).groupBy("part", "split").agg(F.sum("n_tokens").alias("held"))
    base = sums.select("part", "split", (F.sum("held").over(Window.orderBy("part", "split")) - F.col("held")).alias("base"))
    rows = append(files.select("doc_id", "ids", part, split, F.col("_metadata.file_block_start").alias("block"),
                               F.monotonically_increasing_id().alias("at")), one, "ids_crc32 long, counted long").drop("ids")
    inside = Window.partitionBy("part", "split").orderBy("block", "at")
    return rows.withColumn("upto", F.sum("counted").over(inside)).join(base, ["part", "split"]).select(
        "doc_id", (F.col("base") + F.col("upto") - F.col("counted")).alias("start"), F.col("counted").alias("n_tokens"), "ids_crc32")
