"""Run history and message traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_model(history: DataFrame) -> DataFrame:
    """Runs, passes and means per model; each mean counts only the runs that carry the value."""
    return history.groupBy(F.coalesce("model", F.lit("?")).alias("model")).agg(
        F.count("*").alias("runs"), F.count_if(F.coalesce("passed", F.lit(False))).alias("passed"),
        (F.count_if(F.coalesce("passed", F.lit(False))) / F.count("*")).alias("pass_rate"),
        F.avg("tool_coverage").alias("avg_coverage"), F.avg("duration_s").alias("avg_duration"),
        F.count("duration_s").alias("timed"), F.avg("tool_calls").alias("avg_calls"), F.count("tool_calls").alias("counted"))


def latest_per_test(history: DataFrame, order: list[str], test: str = "test_id") -> DataFrame:
    """Last record per test, by ``order``; a maximum per key, so no test's records are sorted or gathered."""
    rest = [c for c in history.columns if c not in order]
    best = history.groupBy(F.coalesce(F.col(test), F.lit("?")).alias("_t") if dict(history.dtypes)[test] == "string"
                           else F.col(test).alias("_t")).agg(F.max_by(F.struct(*history.columns), F.struct(*order)).alias("b"))
    return best.select(*[F.col(f"b.{c}").alias(c) for c in [*order, *rest]])


def message_gaps(messages: DataFrame, run: str, order: str, at: str) -> DataFrame:
    """Seconds waited before each message; messages without a time neither get a gap nor reset the clock.

    A run is one conversation: its messages are ordered by nature, and a run is a small group however many runs exist.
    """
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("gap", F.col(at) - F.last(at, ignorenulls=True).over(w))


def context_changes(messages: DataFrame, run: str, order: str, text: str, separator: str = "\n## ") -> DataFrame:
    """Instruction blocks that changed: ``sections`` and the ``changed`` section headings, repeats folded away.

    A blob counts as sent again when it differs from the last non-empty one of its run.
    """
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blob = F.nullif(F.col(text), F.lit(""))
    m = messages.withColumn("_blob", blob).withColumn("_was", F.last(blob, ignorenulls=True).over(w))
    sec = lambda c: F.filter(F.split(F.col(c), separator), lambda s: F.trim(s) != "")
    head = lambda s: F.trim(F.substring_index(s, "\n", 1))
    out = m.where("_blob is not null and (_was is null or _blob <> _was)")
    changed = F.when(F.col("_was").isNotNull(), F.transform(F.array_except(sec("_blob"), sec("_was")), head))
    return out.select(run, order, F.size(sec("_blob")).alias("sections"), changed.alias("changed"),
                      F.col("_was").isNotNull().alias("resent"))


def shard(tests: DataFrame, order: str, n: int, slices: int = 256) -> DataFrame:
    """``shard`` 1..n: contiguous, balanced slices in ``order``; the first ones get one more.

    Positions come from range slices (see :func:`geoloom.operators.measures.with_running_total`), not from one global sort
    window; ``order`` must be numeric and unique.
    """
    from geoloom.operators.measures import with_running_total
    pos = with_running_total(tests.withColumn("_one", F.lit(1)), order, "_one", slices).withColumn("_i", F.col("cum") - 1)
    total = tests.agg(F.count("*")).scalar()
    t = pos.withColumn("_n", total)
    k, m = F.floor(F.col("_n") / n), F.col("_n") % n
    first = m * (k + 1)
    return t.withColumn("shard", F.when(F.col("_i") < first, F.floor(F.col("_i") / (k + 1))).otherwise(
        m + F.floor((F.col("_i") - first) / F.greatest(k, F.lit(1)))).cast("int") + 1).drop("_one", "_i", "_n", "cum")


def stalest(bank: DataFrame, uses: list[DataFrame], key: str = "test_id", order: str = "position") -> DataFrame:
    """Tests with their last use over all sources, the most overdue first: never used, then longest idle, then bank order."""
    seen = None
    for u in uses:
        d = u.groupBy(key).agg(F.max("at").alias("at"))
        seen = d if seen is None else seen.unionByName(d)
    last = seen.groupBy(key).agg(F.max("at").alias("last_used"))
    return bank.join(last, key, "left").orderBy(F.col("last_used").asc_nulls_first(), order)
