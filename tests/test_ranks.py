"""Exact quantiles against numpy's linear ones."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators.ranks import exact_median, exact_quantiles

PROBS = [0.0, 0.02, 0.25, 0.5, 0.98, 1.0]


@pytest.mark.parametrize("limit", [50, 100_000])
def test_quantiles_of_groups(spark, limit):
    rnd = random.Random(1)
    groups = {"even": [rnd.random() for _ in range(3_000)], "tail": [10.0 ** rnd.uniform(-200, 200) for _ in range(2_000)], "one": [4.0], "two": [1.0, 2.0],
              "same": [7.0] * 2_500, "split": [0.0] * 1_000 + [1.0] * 1_000, None: [float(i % 7) for i in range(900)], "gap": [-1e9] * 600 + [1e-9, 2e-9] + [1e9] * 600}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("even", None), ("nothing", None)]
    df = spark.createDataFrame(rows, "name string, x double").repartition(5)
    got = {r["name"]: r["quantiles"] for r in exact_quantiles(df, "x", PROBS, "name", limit=limit).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        assert np.allclose(got[g], np.quantile(vs, PROBS), rtol=1e-12, atol=0), g


def test_median_of_nothing_and_of_all(spark):
    df = spark.createDataFrame([(1.0,), (4.0,), (None,), (2.0,)], "x double")
    assert df.agg(F.count("*").alias("n")).withColumn("m", exact_median(df, "x")).first()["m"] == 2.0
    assert df.agg(F.count("*").alias("n")).withColumn("m", exact_median(df.where("false"), "x")).first()["m"] is None
