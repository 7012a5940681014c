"""Session helpers: defaults for a new session and lineage cutting through shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from geoloom.shipping import ship

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # call-site capture for every column expression costs more than planning the query
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(name: str = "geoloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; keyword options override them (dots written as ``__``)."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(key, value)
    spark = b.getOrCreate()
    ship(spark)
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own; on a cluster a missing setting is an
    error, because a machine-local folder would not survive the loss of an executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and read it back.

    A written table survives lost executors, is worked out once, and has a known size, so Spark can still choose
    between shuffling and broadcasting it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/geoloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
