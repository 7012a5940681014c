"""Skew-proof building blocks used by every operator that joins on a key with an unknown distribution."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key gets one salt per this many probe rows; at most MAX_HOT keys are salted (the broadcast stays small),
# all other keys join unsalted, so the result does not depend on either number.
ROWS_PER_SALT = 500_000
MAX_HOT = 10_000
ROWS_PER_TASK = 25_000


def spread(df: DataFrame, *keys: str, rows: int = ROWS_PER_TASK) -> DataFrame:
    """``df`` dealt by ``keys`` to tasks of about ``rows`` rows each.

    Spark cuts its work by bytes. A table of few bytes a row comes in one or two pieces, however much is worked out per
    row afterwards, so what is costly per row is dealt by rows first. The count is for tables: from Parquet it is read off the footers.
    """
    return df.repartition(max(1, math.ceil(df.count() / rows)), *keys)


def salted_join(probe: DataFrame, build: DataFrame, keys: list[str], salt_by: list[str], how: str = "inner",
                rows_per_salt: int = ROWS_PER_SALT, total: int | None = None) -> DataFrame:
    """Equi-join in which hot keys of ``probe`` are spread over several tasks.

    Hot keys come from one map-side-combined count; their ``build`` rows are repeated once per salt. ``how`` may be
    ``inner``, ``left``, ``left_semi`` or ``left_anti`` (the probe side is never repeated, so all of them stay exact).
    ``salt_by`` names probe columns whose hash picks the salt, which keeps retried tasks deterministic. Where the caller
    knows the probe's row count, ``total`` saves the count of hot keys: below ``rows_per_salt`` rows no key can be hot.
    """
    if total is not None and total <= rows_per_salt:
        return probe.join(build, keys, how)
    hot = F.broadcast(
        probe.groupBy(*keys).count().where(F.col("count") > rows_per_salt)
        .orderBy(F.desc("count")).limit(MAX_HOT)
        .select(*keys, F.ceil(F.col("count") / rows_per_salt).cast("int").alias("_salts")))
    n = F.coalesce(F.col("_salts"), F.lit(1))
    p = probe.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*salt_by), n).cast("int")).drop("_salts")
    b = build.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("_salts")
    return p.join(b, [*keys, "_salt"], how).drop("_salt")
