"""Approximate nearest neighbours: a hierarchical k-means tree, walked best bin first.

The tree is fitted on a bounded sample; every row is filed in a leaf. A query walks the tree with a priority queue and
visits leaves in the order the queue gives them. How many is calibrated: visits are widened until a set of queries
reaches the wanted recall against brute force over all rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.arrow import map_batches
from geoloom.llm.vectors import common_length, dealt, kmeans, nearest_center, packed, unpack
from geoloom.llm.workspace import Workspace

NEAREST = 20
SAMPLE_ROWS = 16_384         # bound of the tree's sample
BRANCHES = 8
ROWS_PER_LEAF = 128          # aimed at; a leaf keeps at least LEAST_SAMPLE rows of the sample
LEAST_SAMPLE = 16
CALIBRATION_QUERIES = 256
RECALL = 0.95
BIN_BYTES = 32 << 20         # of vectors in a bin, and of queries that meet them at once
LEAST_BINS = 16              # so that small tables are searched by several tasks too
QUERIES_PER_TASK = 1_024     # that walk the tree
SCORES_AT_ONCE = 1 << 21


@dataclass
class KMeansTree:
    """Nodes as lists: the centers of a node's children and their numbers; a leaf has none and a number of its own."""

    centers: list[np.ndarray | None] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def grow(self, x: np.ndarray, most: int) -> int:
        node = len(self.leaf)
        self.centers.append(None)
        self.children.append([])
        self.leaf.append(-1)
        if len(x) > most:
            centers = kmeans(x, BRANCHES, seed=node)
            of = nearest_center(x, centers)
            used = np.unique(of)
            if len(used) > 1:
                self.centers[node] = centers[used]
                self.children[node] = [self.grow(x[of == k], most) for k in used]
                return node
        self.leaf[node], self.leaves = self.leaves, self.leaves + 1
        return node

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out, todo = np.empty(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.centers[node] is None:
                out[rows] = self.leaf[node]
            else:
                of = nearest_center(x[rows], self.centers[node])
                todo += [(child, rows[of == k]) for k, child in enumerate(self.children[node])]
        return out

    def best_bins(self, query: np.ndarray) -> Iterator[int]:
        """Leaves by falling inner product of their center with the query, as the queue meets them."""
        queue = [(-np.inf, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.centers[node] is None:
                yield self.leaf[node]
            else:
                for s, child in zip((self.centers[node] @ query).tolist(), self.children[node]):
                    heapq.heappush(queue, (-s, child))


def top_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` largest scores of each row and all that may tie with the last of them."""
    if scores.shape[1] > k:
        last = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    else:
        last = np.full(len(scores), -np.inf)
    return np.nonzero((scores >= last[:, None] - 1e-9 * np.maximum(1, np.abs(last[:, None]))) & (scores > -np.inf))


def ranked(query: np.ndarray, candidate: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's first ``k`` by falling score and rising candidate."""
    order = np.lexsort((candidate, -score, query))
    q = query[order]
    first = np.concatenate([[0], np.flatnonzero(np.diff(q)) + 1]) if len(q) else np.empty(0, int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < k]


def bins_of(held: np.ndarray, most: int) -> np.ndarray:
    """The bin of each leaf: leaves next to each other in the tree share one until it holds ``most`` rows."""
    out, bin_, rows = np.empty(len(held), np.int64), 0, 0
    for leaf, n in enumerate(held.tolist()):
        if rows and rows + n > most:
            bin_, rows = bin_ + 1, 0
        out[leaf], rows = bin_, rows + n
    return out


def nearest(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = NEAREST,
            recall: float = RECALL, bin_bytes: int = BIN_BYTES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` nearest rows found, by inner product, other ids only.

    Ties go to the smaller id. Rows and queries without id or comparable vector (null, zero, null or non-finite components,
    or another length than most vectors have) take no part. A repeated query id is asked once; repeated rows are
    all candidates. With fewer than ``k`` candidates all are returned. Neighbouring leaves lie in one bin; a query is sent once to each bin that
    has leaves for it, with the list of them. Bins are bounded by bytes, and a leaf beyond that is split into blocks.
    """
    space = Workspace(vectors.sparkSession, "nearest")
    length = common_length(vectors, vector)
    pick = lambda df: packed(df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v")), "v", length).where(
        "vec_id is not null and x is not null")
    rows = space.cut(pick(vectors))
    asked = space.cut(pick(queries).groupBy("vec_id").agg(F.min("x").alias("x")))
    n = rows.count()
    if n == 0:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    drawn = lambda df, most: df.select("vec_id", "x", F.xxhash64("vec_id", "x").alias("draw")).orderBy(
        "draw", "vec_id", "x").limit(most).toArrow()
    sample = unpack(drawn(rows, SAMPLE_ROWS).column("x"), length)
    tree = KMeansTree()
    tree.grow(sample, max(LEAST_SAMPLE, int(len(sample) * ROWS_PER_LEAF / n)))
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(tree)                             # bounded by the sample

    def filed(batch: pa.RecordBatch) -> pa.RecordBatch:
        leaf = shared.value.file(unpack(batch.column("x"), length))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], names=["vec_id", "x", "leaf"])
    members = space.cut(map_batches(rows, filed, "vec_id long, x binary, leaf int"))
    held = np.zeros(tree.leaves, np.int64)
    for r in members.groupBy("leaf").count().collect():          # one row a leaf
        held[r["leaf"]] = r["count"]
    trial = drawn(asked, CALIBRATION_QUERIES)
    visits = calibrate(members, tree, trial.column("vec_id").to_numpy(), unpack(trial.column("x"), length), k, recall) if trial.num_rows else 1
    block = max(1, bin_bytes // (8 * length))
    bins = bins_of(held, min(block, max(1, -(-n // LEAST_BINS))))

    def visiting(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, to, leaves = [], [], []
        for r, q in enumerate(unpack(batch.column("x"), length)):
            seen, here = 0, {}
            for step, at in enumerate(shared.value.best_bins(q)):
                if step >= visits and seen > k:                  # one of the rows seen may be the query's own
                    break
                seen += held[at]
                if held[at]:
                    here.setdefault(int(bins[at]), []).append(at)
            row += [r] * len(here)
            to += here
            leaves += here.values()
        t = batch.take(pa.array(row, pa.int64()))
        return pa.RecordBatch.from_arrays([*t.columns, pa.array(to, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))], names=["vec_id", "x", "bin", "leaves"])
    spread = asked.repartition(max(1, -(-asked.count() // QUERIES_PER_TASK)), "vec_id")
    visitors = space.cut(map_batches(spread, visiting, "vec_id long, x binary, bin int, leaves array<int>"))
    in_bin = F.element_at(F.lit(bins.tolist()), F.col("leaf") + 1).cast("int")
    groups = dealt(members.withColumn("bin", in_bin), visitors, ["bin"], "vec_id", block)

    def search(t: pa.Table) -> pa.Table:
        visits_, ids, x = t.column("visits").to_numpy(), t.column("vec_id").to_numpy(), unpack(t.column("x"), length)
        q, m = np.flatnonzero(visits_), np.flatnonzero(~visits_)
        lists = t.column("leaves").take(pa.array(q)).combine_chunks()
        by_leaf = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy(zero_copy_only=False)
        leaf = t.column("leaf").take(pa.array(m)).to_numpy()
        best_q, best_m, best_s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for at in np.unique(by_leaf[1]).tolist():
            own, here = by_leaf[0][by_leaf[1] == at], m[leaf == at]
            for a in range(0, len(own) if len(here) else 0, max(1, SCORES_AT_ONCE // len(here)) if len(here) else 1):
                asks = q[own[a:a + max(1, SCORES_AT_ONCE // len(here))]]
                scores = x[asks] @ x[here].T
                scores[ids[asks][:, None] == ids[here][None, :]] = -np.inf
                i, j = top_rows(scores, ids[here], k)
                best_q, best_m = np.concatenate([best_q, asks[i]]), np.concatenate([best_m, here[j]])
                best_s = np.concatenate([best_s, (x[asks[i]] * x[here[j]]).sum(1)])     # one fixed order of summing, so equal vectors tie
            if len(best_q) > 4 * k * len(q):
                keep = ranked(ids[best_q], ids[best_m], best_s, k)
                best_q, best_m, best_s = best_q[keep], best_m[keep], best_s[keep]
        keep = ranked(ids[best_q], ids[best_m], best_s, k)
        return pa.table({"query_id": ids[best_q[keep]], "vec_id": ids[best_m[keep]], "score": best_s[keep]})
    found = groups.groupBy("bin", "block", "chunk").applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return space.close(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def calibrate(members: DataFrame, tree: KMeansTree, ids: np.ndarray, queries: np.ndarray, k: int, recall: float) -> int:
    """The least number of leaves at which the given queries find ``recall`` of their true neighbours among all rows.

    One pass: each task keeps the best rows of its own part for the bounded set of queries, with their leaves.
    """
    length = queries.shape[1]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, c, s, leaf = (np.empty(0, d) for d in (np.int64, np.int64, np.float64, np.int64))
        for batch in batches:
            own, at = batch.column("vec_id").to_numpy(), batch.column("leaf").to_numpy()
            x = unpack(batch.column("x"), length)
            for a in range(0, len(x), 2_048):
                scores = queries @ x[a:a + 2_048].T
                scores[ids[:, None] == own[a:a + 2_048][None, :]] = -np.inf
                i, j = top_rows(scores, own[a:a + 2_048], k)
                q, c, s, leaf = (np.concatenate(p) for p in ((q, i), (c, own[a + j]), (s, scores[i, j]), (leaf, at[a + j])))
                keep = ranked(q, c, s, k)
                q, c, s, leaf = q[keep], c[keep], s[keep], leaf[keep]
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(c), pa.array(s), pa.array(leaf)], names=["q", "c", "s", "leaf"])
    order = Window.partitionBy("q").orderBy(F.desc("s"), "c")
    true = members.mapInArrow(best, "q long, c long, s double, leaf long").withColumn(
        "rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "leaf").toArrow()
    place = np.empty((len(queries), tree.leaves), np.int64)
    for r, v in enumerate(queries):
        place[r, list(tree.best_bins(v))] = np.arange(tree.leaves)
    needed = place[true.column("q").to_numpy(), true.column("leaf").to_numpy()]
    visits = 1
    while visits < tree.leaves and (needed < visits).mean() < recall:
        visits += 1
    return visits
