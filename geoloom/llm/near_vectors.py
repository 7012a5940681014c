"""Near-duplicate vectors by an inverted multi-index.

Each half of the normalised vectors has its own codebook; the two together form a grid of cells. A vector visits the
cells nearest to it, in the order the multi-sequence traversal gives, as many as a calibration asks for, and is compared
with the vectors filed there under the same label. Equal vectors are one class from the start.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.arrow import map_batches
from geoloom.llm.vectors import common_length, dealt, kmeans, nearest_center, packed, unpack
from geoloom.operators.graph import connected_components
from geoloom.session import cut_lineage

COSINE = 0.93
SAMPLE_ROWS = 20_000         # bound of the codebooks' sample
ROWS_PER_CELL = 512          # over all labels; sets the size of the codebooks
CODES = 128                  # at most, for each half
RECALL = 0.995               # of one direction, for partners exactly at the threshold
BLOCK = 1_024


def multi_sequence(first: np.ndarray, second: np.ndarray, visits: int) -> list[int]:
    """The ``visits`` cells of least ``first[i] + second[j]``, nearest first, as ``i * len(second) + j``."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    queue, out, seen = [(first[a[0]] + second[b[0]], 0, 0)], [], {(0, 0)}
    while queue and len(out) < visits:
        _, i, j = heapq.heappop(queue)
        out.append(int(a[i]) * len(second) + int(b[j]))
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(queue, (first[a[p]] + second[b[q]], p, q))
    return out


@dataclass
class MultiIndex:
    first: np.ndarray
    second: np.ndarray
    visits: int = 1

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of normalised rows to the codewords, less what is the same for all of them."""
        h = self.first.shape[1]
        return ((self.first ** 2).sum(1) - 2 * x[:, :h] @ self.first.T, (self.second ** 2).sum(1) - 2 * x[:, h:] @ self.second.T)

    def cell(self, x: np.ndarray) -> np.ndarray:
        h = self.first.shape[1]
        return nearest_center(x[:, :h], self.first) * len(self.second) + nearest_center(x[:, h:], self.second)

    def visited(self, x: np.ndarray) -> np.ndarray:
        """Which cells each row visits, as a table of rows by cells."""
        out = np.zeros((len(x), len(self.first) * len(self.second)), bool)
        for r, (a, b) in enumerate(zip(*self.distances(x))):
            out[r, multi_sequence(a, b, self.visits)] = True
        return out


def normalised(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(1, keepdims=True)          # no overflow in the squares
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def fit(sample: np.ndarray, rows: int, cosine: float = COSINE, recall: float = RECALL) -> MultiIndex:
    """Codebooks from a bounded sample, and the visits that find ``recall`` of partners exactly at the threshold.

    The calibration turns sample vectors by the threshold's angle in random directions, the hardest partners to find, and
    adds the true partners inside the sample. A pair is found if either side visits the other, so the recall of a pair is higher.
    """
    codes = int(min(CODES, max(2, math.ceil(math.sqrt(rows / ROWS_PER_CELL)))))
    half = sample.shape[1] // 2
    index = MultiIndex(kmeans(sample[:, :half], codes, seed=1), kmeans(sample[:, half:], codes, seed=2))
    rng = np.random.default_rng(3)
    base = sample[rng.choice(len(sample), min(1_000, len(sample)), replace=False)]
    turn = rng.standard_normal((len(base), sample.shape[1]))
    turn -= (turn * base).sum(1, keepdims=True) * base
    size = np.sqrt((turn * turn).sum(1, keepdims=True))
    partners = [np.arange(len(base)), cosine * base + math.sqrt(max(0.0, 1 - cosine ** 2)) * turn / np.maximum(size, 1e-12)]
    i, j = np.nonzero(base @ sample.T >= cosine)
    order = [np.concatenate([partners[0], i]), index.cell(np.concatenate([partners[1], sample[j]]))]
    cells = len(index.first) * len(index.second)
    ranks = np.empty((len(base), cells), np.int64)
    for r, (a, b) in enumerate(zip(*index.distances(base))):
        ranks[r, multi_sequence(a, b, cells)] = np.arange(cells)
    synthetic, real = ranks[order[0][:len(base)], order[1][:len(base)]], ranks[order[0][len(base):], order[1][len(base):]]
    enough = lambda r: int(np.sort(r)[math.ceil(recall * len(r)) - 1]) + 1 if len(r) else 1
    index.visits = max(enough(synthetic), enough(real))
    return index


def _spread(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column of a link table the least row number it is connected with inside the table."""
    n = len(linked)
    rows, cols = np.arange(n), np.full(linked.shape[1], n)
    while True:
        new_cols = np.where(linked, rows[:, None], n).min(0, initial=n)
        new_rows = np.minimum(rows, np.where(linked, new_cols[None, :], n).min(1, initial=n))
        if (new_rows == rows).all() and (new_cols == cols).all():
            return rows, cols
        rows, cols = new_rows, new_cols


def link_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE,
                 recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row.

    Rows without id, label or comparable vector (null, zero, null or non-finite components, or another length than most
    vectors have) link with nothing. A row without id has no component and is not kept. Repeated rows are one class: each links with the others. Extra columns are ignored. An empty table gives no rows.
    Groups of thousands of near copies are compared in blocks of ``block`` by ``block`` rows that give counts and a few connecting
    edges, never pairs, so the output of a task follows its rows.
    """
    length = common_length(vectors, vector)
    own = packed(vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("v")),
                 "v", length)
    own = cut_lineage(own.withColumn("x", F.when(F.col("vec_id").isNotNull() & F.col("label").isNotNull(), F.col("x"))))
    classes = cut_lineage(own.where("x is not null").groupBy("label", "x").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    alone = own.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    n = classes.count()
    if n == 0:
        return alone.withColumn("kept", F.col("vec_id").isNotNull())
    sample = classes.select("x", F.xxhash64("x").alias("draw")).orderBy("draw", "x").limit(SAMPLE_ROWS).toArrow()
    index = fit(normalised(unpack(sample.column("x"), length)), n, cosine, recall) if length > 1 else MultiIndex(
        np.zeros((1, 0)), np.zeros((1, length)))
    shared = own.sparkSession.sparkContext.broadcast(index)      # bounded by CODES

    def filed(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = normalised(unpack(batch.column("x"), length))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.cell(x), pa.int32())], names=[*batch.schema.names, "cell"])

    def visiting(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, cell = np.nonzero(shared.value.visited(normalised(unpack(batch.column("x"), length))))
        t = batch.take(pa.array(row))
        return pa.RecordBatch.from_arrays([*t.columns, pa.array(cell, pa.int32())], names=[*batch.schema.names, "cell"])
    schema = "label string, x binary, rep long, copies long, cell int"
    groups = dealt(map_batches(classes, filed, schema), map_batches(classes, visiting, schema), ["label", "cell"], "rep", block)

    def compare(t: pa.Table) -> pa.Table:
        visits = t.column("visits").to_numpy()
        x, rep, copies = unpack(t.column("x"), length), t.column("rep").to_numpy(), t.column("copies").to_numpy()
        u = normalised(x)
        a, b = np.flatnonzero(visits), np.flatnonzero(~visits)
        near = u[a] @ u[b].T
        linked = near >= cosine
        for i, j in zip(*np.nonzero(np.abs(near - cosine) < 1e-12)):      # decided as a sum in one fixed order
            linked[i, j] = math.fsum(u[a[i]] * u[b[j]]) >= cosine
        linked &= rep[a][:, None] != rep[b][None, :]
        if linked.any():
            # where each of two visits the other's cell, the pair counts when the smaller id visits
            i, j = np.nonzero(linked)
            home, goes = shared.value.cell(u[a[np.unique(i)]]), shared.value.visited(u[b[np.unique(j)]])
            both = goes[np.searchsorted(np.unique(j), j), home[np.searchsorted(np.unique(i), i)]]
            drop = both & (rep[a[i]] > rep[b[j]])
            linked[i[drop], j[drop]] = False
        rows, cols = _spread(linked)
        mine, theirs = linked @ copies[b], copies[a] @ linked
        keep, hit = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
        return pa.table({"rep": np.concatenate([rep[a[keep]], rep[b[hit]]]), "links": np.concatenate([mine[keep], theirs[hit]]).astype(np.int64),
                         "other": rep[a[np.concatenate([rows[keep], cols[hit]]).astype(int)]]})
    found = cut_lineage(groups.groupBy("label", "cell", "block", "chunk").applyInArrow(compare, "rep long, links long, other long"))
    # a vector that two labels share has two classes of one rep only if ids repeat; then both count
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    edges = found.where("rep <> other").select("rep", "other").distinct()
    parts = connected_components(edges, "rep", "other").withColumnRenamed("node", "rep")
    known = cut_lineage(classes.join(links, "rep", "left").join(parts, "rep", "left").select(
        "label", "x", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component")))
    return own.join(known, ["label", "x"], "left").select(
        "vec_id", F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id")).withColumn(
            "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
