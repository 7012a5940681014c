"""Vector columns as matrices, k-means, and the dealing of hot cells over several tasks; shared by the vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.arrow import append


def matrix(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that can be compared, and their vectors as doubles: ``length`` finite components, not all of them zero."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)      # null components become NaN
    starts = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])[:-1]
    rows = np.flatnonzero(sizes == length)
    x = flat[starts[rows][:, None] + np.arange(length)] if len(rows) else np.empty((0, length))
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return rows[good], x[good]


def common_length(df: DataFrame, vector: str) -> int:
    """The length most vectors have, 0 without any; ties go to the shorter."""
    top = df.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "d").first()
    return int(top["d"]) if top else 0


def packed(df: DataFrame, vector: str, length: int) -> DataFrame:
    """Adds ``x binary``: the vector as doubles where it can be compared, else null."""
    def one(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        rows, x = matrix(batch.column(vector), length)
        out: list[bytes | None] = [None] * batch.num_rows
        for r, v in zip(rows.tolist(), x):
            out[r] = v.tobytes()
        return {"x": pa.array(out, pa.binary())}
    return append(df, one, "x binary").drop(vector)


def unpack(column: pa.Array | pa.ChunkedArray, length: int) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, np.float64).reshape(-1, length)


def nearest_center(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (x @ centers.T - (centers * centers).sum(1) / 2).argmax(1)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """At most ``k`` centers; empty ones start again at the rows farthest from their center."""
    x = x[np.sort(np.unique(x, axis=0, return_index=True)[1])]
    k = min(k, len(x))
    centers = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        of = nearest_center(x, centers)
        n = np.bincount(of, minlength=k)
        total = np.zeros_like(centers)
        np.add.at(total, of, x)
        centers = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centers)
        if (n == 0).any():
            centers[n == 0] = x[np.argsort(-((x - centers[of]) ** 2).sum(1))[:(n == 0).sum()]]
    return centers


def dealt(members: DataFrame, visitors: DataFrame, cell: list[str], key: str, block: int) -> DataFrame:
    """Members and visitors of each cell, dealt so that each pair meets in exactly one (cell, block, chunk).

    A cell of more than ``block`` members is split into blocks, one of more than ``block`` visitors into chunks, both by the
    hash of ``key``; members go to every chunk and visitors to every block of their cell. So no group grows with the data.
    Adds ``visits boolean``, ``block`` and ``chunk``.
    """
    sizes = members.groupBy(*cell).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).join(
        visitors.groupBy(*cell).agg(F.ceil(F.count("*") / block).cast("int").alias("chunks")), cell)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    m = members.join(sizes, cell).withColumn("block", part("blocks")).withColumn("chunk", every("chunks"))
    v = visitors.join(sizes, cell).withColumn("chunk", part("chunks")).withColumn("block", every("blocks"))
    return m.withColumn("visits", F.lit(False)).unionByName(v.withColumn("visits", F.lit(True)), allowMissingColumns=True).drop("blocks", "chunks")
