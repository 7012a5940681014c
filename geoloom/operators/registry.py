"""Operators by name, and user code over layers."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators import (catalog, city, filters, joins, measures, network, overlay, polygonize, quality, raster, spatial,
                               statistics, telemetry, transit)

_MODULES = (filters, spatial, joins, measures, transit, statistics, raster, polygonize, network, overlay, quality, city, catalog, telemetry)


def operators() -> dict[str, Callable]:
    """Public operator functions by name."""
    out: dict[str, Callable] = {}
    for m in _MODULES:
        for name, fn in inspect.getmembers(m, inspect.isfunction):
            if fn.__module__ == m.__name__ and not name.startswith("_"):
                out[name] = fn
    return out


def describe(name: str) -> dict:
    """Signature and purpose of an operator."""
    fn = _find(name)
    return {"name": name, "module": fn.__module__.rsplit(".", 1)[-1], "purpose": inspect.getdoc(fn) or "",
            "parameters": {p.name: None if p.default is p.empty else p.default for p in inspect.signature(fn).parameters.values()}}


def run(name: str, *layers, **params):
    """Call an operator by name."""
    return _find(name)(*layers, **params)


def _find(name: str) -> Callable:
    ops = operators()
    if name not in ops:
        near = sorted(n for n in ops if name.lower() in n.lower())[:10]
        raise KeyError(f"unknown operator {name!r}" + (f"; did you mean one of {near}" if near else ""))
    return ops[name]


def map_features(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """User code over batches of features (Arrow transfer, a batch at a time)."""
    def batches(it: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in it:
            yield fn(pdf)
    return df.mapInPandas(batches, schema)


def aggregate_features(df: DataFrame, by: list[str], partial: Callable[[pd.DataFrame], pd.DataFrame], merge: Callable[[pd.DataFrame], pd.DataFrame],
                       partial_schema: str, schema: str) -> DataFrame:
    """User aggregate in two steps: ``partial`` reduces each batch before the shuffle, ``merge`` finishes a group.

    A group of any size reaches ``merge`` as its partial rows only.
    """
    def reduce(it: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in it:
            for _, part in pdf.groupby(by, sort=False, dropna=False):
                yield partial(part)
    return df.mapInPandas(reduce, partial_schema).groupBy(*by).applyInPandas(lambda pdf: merge(pdf), schema)


class GridTiles:
    """Table function: the lower-left corners (km) of the grid tiles covering a metric window."""

    def eval(self, xmin: float, ymin: float, xmax: float, ymax: float, step_km: int):
        size = step_km * 1000
        for e in range(int(xmin // size) * step_km, int(xmax // size) * step_km + 1, step_km):
            for n in range(int(ymin // size) * step_km, int(ymax // size) * step_km + 1, step_km):
                yield e, n


def register_sql_functions(spark: SparkSession) -> None:
    """Make ``grid_tiles(xmin, ymin, xmax, ymax, step_km)`` callable in SQL."""
    spark.udtf.register("grid_tiles", F.udtf(GridTiles, returnType="e int, n int"))
