"""Streams give what their batch twins give."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.streaming import streams as ST


def replay(spark, df, folder, name):
    """``df`` as a file stream in two ordered pieces."""
    path = os.path.join(folder, name)
    df.where("part = 0").coalesce(1).write.mode("append").parquet(path)
    df.where("part = 1").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def events(spark):
    rows = [(i, f"2024-01-01 0{h}:{m:02d}:00", i % 3, float(i), 0 if h < 3 else 1) for i, (h, m) in enumerate(
        (h, m) for h in range(1, 6) for m in (0, 4, 9, 40))]
    far = [(900 + k, "2024-01-03 00:00:00", 99, 0.0, 1) for k in range(2)]        # moves the watermark past everything
    return spark.createDataFrame(rows + far, "event_id bigint, t string, user_id int, value double, part int").select(
        "event_id", F.to_timestamp("t").alias("ts"), "user_id", "value", "part")


def test_sessions(spark, folder):
    e = events(spark)
    drain(ST.run_sessions(replay(spark, e, folder, "s"), delay="1 hour"), "sessions")
    got = sorted(map(str, spark.table("sessions").collect()))
    want = sorted(map(str, ST.run_sessions(e.where("user_id < 99")).collect()))
    assert got == want and len(got) > 5


def test_departure_board(spark, folder):
    e = events(spark).withColumnRenamed("user_id", "stop_id")
    drain(ST.departure_board(replay(spark, e, folder, "d"), delay="1 hour"), "board")
    got = sorted(map(str, spark.table("board").collect()))
    want = sorted(map(str, ST.departure_board(e.where("stop_id < 99")).collect()))
    assert got == want and len(got) > 20


def test_gate_stream(spark, folder):
    d = spark.range(10).select(
        "id", F.when(F.col("id") % 2 == 0, G.box(F.col("id"), F.lit(0), F.col("id") + 1, F.lit(1), 25832)).alias("geom"),
        (F.col("id") % 2).cast("int").alias("part"))
    q = ST.gate_stream(replay(spark, d, folder, "g"), f"{folder}/good", f"{folder}/bad", f"{folder}/cp", "id")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{folder}/good").count() == 5
    assert {r.message for r in spark.read.parquet(f"{folder}/bad").collect()} == {"null_shape"}


def test_touch_ttl(spark, folder):
    rows = [("a", "2024-01-01 00:00:00", 2, 0), ("b", "2024-01-01 00:00:00", 30, 0), ("a", "2024-01-02 00:00:00", None, 0), ("c", "2024-02-10 00:00:00", None, 1)]
    d = spark.createDataFrame(rows, "dataset string, t string, ttl_days int, part int").select(
        "dataset", F.to_timestamp("t").alias("ts"), "ttl_days", "part")
    drain(ST.touch_ttl_stream(replay(spark, d, folder, "t")), "touches")
    gone = {r.dataset: r.last_used_ms for r in spark.table("touches").where("event = 'expired'").collect()}
    assert set(gone) == {"a", "b"} and gone["a"] == 1704153600000
    drain(ST.last_use_stream(replay(spark, d, folder, "u")), "uses", "update")
    assert spark.table("uses").where("dataset = 'a'").count() >= 1
