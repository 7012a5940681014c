"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType, _parse_datatype_string


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until ``df`` has no such column, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


SLICE_BYTES = 32 << 20       # of a batch that is worked on at once; a longer row stands alone
_caches: list = []


def emptied_after_tasks(cache):
    """Registers a cache (with ``clear``) of this worker process, to be emptied at the end of each task."""
    _caches.append(cache)
    return cache


def give_back() -> None:
    """Empties the caches and hands free memory back to the system, so that idle workers hold little."""
    for cache in _caches:
        cache.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):      # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``SLICE_BYTES``; memory goes back when the last one is done."""
    try:
        for batch in batches:
            if batch.num_rows:
                rows = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1))
                for a in range(0, batch.num_rows, rows):
                    yield batch.slice(a, rows)
    finally:
        give_back()


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one batch; ``None`` and empty batches are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if (out := fn(batch)) is not None:
                yield out
    return df.mapInArrow(run, schema)


def append(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, pa.Array]], new: str) -> DataFrame:
    """All columns of ``df`` and the new ones that ``fn`` works out; a column of the same name is replaced."""
    added = _parse_datatype_string(new)
    kept = df.drop(*added.names)
    names, schema = kept.columns, StructType([*kept.schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = fn(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(names)], *[got[c] for c in added.names]], names=[*names, *added.names])
    return kept.mapInArrow(run, schema)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without copying, and where each row starts and ends in them; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def pieces(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each; a longer row stands alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, end
        start = end
