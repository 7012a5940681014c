"""A bounded filter in front of joins of long rows with many ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.arrow import fresh

MARKS = 1 << 24              # bits, so 262,144 words of 64 at most are broadcast, whatever the input


def with_mark(df: DataFrame, ids: DataFrame, name: str, key: str = "doc_id") -> DataFrame:
    """``df`` with a flag that is true in every row whose key is in ``ids`` and in few others, without a shuffle of ``df``.

    The flag is looked up in a bitmap of hashed keys. It only spares rows a shuffle; the exact join has to follow.
    """
    word, bits = fresh(df, "_word", "_bits")
    place = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(MARKS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    marks = ids.groupBy(F.shiftright(place, 6).alias(word)).agg(F.bit_or(bit).alias(bits))
    found = df.withColumn(word, F.shiftright(place, 6)).join(F.broadcast(marks), word, "left")
    return found.withColumn(name, F.coalesce(bit.bitwiseAND(F.col(bits)) != 0, F.lit(False))).select(*df.columns, name)
