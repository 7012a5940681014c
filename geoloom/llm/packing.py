"""Packs token sequences into windows: best-fit decreasing with a segment tree over remaining capacities.

Overlong documents are first cut into full windows; what remains of them and all shorter documents are pieces. Pieces are
dealt into shards by hash, each shard is packed by one task, longest piece first, always into the tightest open window.
The number of shards follows the number of pieces, so a shard never grows; each leaves at most a few windows part-filled.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.arrow import map_batches
from geoloom.llm.subword import encoder
from geoloom.session import cut_lineage

WINDOW = 4096
PIECES_PER_SHARD = 100_000


class TightestFit:
    """A segment tree with one leaf for each capacity; a node counts the open windows below it."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, window: int, capacity: int) -> None:
        if capacity:
            self.open[capacity].append(window)
            self._add(capacity, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """An open window of the least capacity that holds ``length``, and that capacity."""
        i = length + self.leaves
        if not self.count[i]:
            # climb until a sibling to the right has windows, then go down to its least capacity
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        self._add(capacity, -1)
        return self.open[capacity].pop(), capacity


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset for each length; ``lengths`` must fall."""
    tree, fresh = TightestFit(window), 0
    number, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, n in enumerate(lengths.tolist()):
        found = tree.take(n)
        if found is None:
            found, fresh = (fresh, window), fresh + 1
        number[k], offset[k] = found[0], window - found[1]
        tree.put(found[0], found[1] - n)
    return number, offset


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 2, key: str = "doc_id", text: str = "text",
               window: int = WINDOW, kind: str = "word_json") -> DataFrame:
    """One row per piece: document, ids before it, length, checksum of its ids, ids of the document with the end id.

    Null and empty texts are one piece with only the end id. A null key stays null; repeated rows are packed each.
    """
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, rows = encoder(kind, tokenizer_path).encode(batch.column(1))
        end = np.array([end_id], "<u4")
        who, start, length, crc, total = [], [], [], [], []
        for d, a, b in zip(batch.column(0).to_pylist(), rows[:-1].tolist(), rows[1:].tolist()):
            own = np.concatenate([ids[a:b], end]).astype("<u4", copy=False)
            for s in range(0, len(own), window):
                piece = own[s:s + window]
                who.append(d)
                start.append(s)
                length.append(len(piece))
                crc.append(zlib.crc32(piece))
                total.append(len(own))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (who, start, length, crc, total)],
                                          names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    return map_batches(docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")), one, PIECE)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, key: str = "doc_id", text: str = "text",
         window: int = WINDOW, pieces_per_shard: int = PIECES_PER_SHARD, kind: str = "word_json") -> DataFrame:
    """``PIECE`` columns with ``sequence_id`` and ``offset``: where each piece lies.

    Pieces are written to the shared folder before they are dealt, so a shard that is packed again after a loss sees the
    same rows in the same order (length, then key, start and checksum) and gives the same windows. Ties in length go by
    key. An empty table gives no rows. Sequence ids are unique, not consecutive: the shard is their upper half.
    """
    cut = cut_lineage(cut_pieces(docs, tokenizer_path, end_id, key, text, window, kind))
    shards = max(1, math.ceil(cut.count() / pieces_per_shard))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards)))
    ordered = dealt.repartition(shards, "shard").sortWithinPartitions(
        "shard", F.desc("length"), "doc_id", "start", "ids_crc32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        def done() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held).combine_chunks()
                number, offset = best_fit_decreasing(t.column("length").to_numpy(), window)
                yield from t.drop_columns(["shard"]).append_column("sequence_id", pa.array(number + (at << 32))).append_column(
                    "offset", pa.array(offset)).to_batches(10_000)
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a < b:
                    if at != int(shard[a]):
                        yield from done()
                        held, at = [], int(shard[a])
                    held.append(batch.slice(a, b - a))
        yield from done()
    return ordered.mapInArrow(run, PIECE + ", sequence_id long, offset long")
