"""Exact similarity join of word-shingle sets that skips by set relations.

Shingles are ordered by hash, and this order is cut into blocks of positions. For sets of one size range there are so
many blocks that two linked sets must agree on some block as a whole, however their differences are spread. The index has
one list for each (size range, block, content of the block); wherever a set differs inside a block, that whole block of
lists is skipped. A set that shares fewer lists with others than any linked set must is out before its text is fetched.

Answers come from highly similar sets. Equal sets share one node. In every list the set that shares most lists is the pivot; the other sets
are compared with it once and keep their difference to it. Linked sets share more lists than they need to meet, so a set
leaves out the pivots it shares least with. A set linked with its pivot takes over the pivot's
component. What is left, sets of one list in different components, is decided from the differences to the common pivot
alone, block by block, and gives only connecting links, never pairs. A pivot whose sets are one block is done with where its
differences are worked out; only those of larger ones are written and dealt to blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.arrow import append, emptied_after_tasks, give_back, map_batches, slices
from geoloom.llm.marks import with_mark
from geoloom.llm.shingles import mix, shingle_sets
from geoloom.llm.workspace import Workspace
from geoloom.operators.graph import connected_components

WORDS, PERCENT = 5, 80
SPARE = 4                    # for so many blocks that may differ there is one more, and two at least
GROWTH = 1.5                 # of the size ranges
BLOCK = 256                  # sets of one pivot that are compared at once with as many others, or fewer if they
BLOCK_SHINGLES = 32_768      # differ from it by more than so many shingles together


def _ranges(n: int, percent: int) -> list[tuple[int, int]]:
    """The size ranges in which a set of ``n`` shingles looks for partners, as ``(number, largest size)``.

    Its own range, and the next one if a partner of it can be that large.
    """
    k = max(0, math.ceil(math.log(max(n, 1)) / math.log(GROWTH) - 1e-12))
    while _largest(k) < n:
        k += 1
    while k and _largest(k - 1) >= n:
        k -= 1
    out = [(k, _largest(k))]
    while 100 * n >= percent * (out[-1][1] + 1):
        k = out[-1][0] + 1
        out.append((k, _largest(k)))
    return out


def _largest(k: int) -> int:
    return int(math.floor(GROWTH ** k + 1e-9))


def most_differences(a: int, b: int, percent: int) -> int:
    """How many shingles at most are in one of two linked sets of ``a`` and ``b`` shingles only."""
    return (a + b) * (100 - percent) // (100 + percent)


def list_keys(s: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """Keys of the lists that a set stands in, and how many of them at least it shares with any set linked with it.

    With ``k`` differences at most there are ``k + 1 + spare`` blocks, so linked sets agree on more than ``spare`` of them. Blocks
    empty in a set are left out unless there are more than ``spare``: then agreement on empty blocks alone could be what two sets
    share, and they are listed too.
    """
    keys, needs = [], []
    for number, largest in _ranges(len(s), percent) if len(s) else ():
        k = most_differences(largest, largest, percent)      # of the range, never of the set: both sides must cut alike
        if k == 0:
            continue                       # only equal sets link, and they are one node
        spare = max(2, k // SPARE)
        blocks = k + 1 + spare
        at = np.searchsorted(s, _block_edges(blocks))
        size = np.diff(np.append(at, len(s)))
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
        content = total[at + size] - total[at]
        tag = mix(np.arange(blocks, dtype=np.uint64) * np.uint64(0x100000001B3) + np.uint64(number + 1))
        key = mix(content ^ tag) + size.astype(np.uint64)
        empty = int((size == 0).sum())
        keys.append(key if empty > spare else key[size > 0])
        needs.append(spare + 1 - min(empty, spare))
    return (np.concatenate(keys) if keys else np.empty(0, np.uint64)), min(needs, default=1)


_edges: dict[int, np.ndarray] = {}


def _block_edges(blocks: int) -> np.ndarray:
    if blocks not in _edges:
        _edges[blocks] = np.array([(i << 64) // blocks for i in range(blocks)], dtype=np.uint64)
    return _edges[blocks]


def _node(s: np.ndarray) -> int:
    """A set's number: 63 bits that only equal sets share."""
    if not len(s):
        return -1
    return int(mix(mix(s + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64, keepdims=True) ^ np.uint64(len(s)))[0] >> np.uint64(1))


SEEN_SETS = 1_000_000
_seen: set = emptied_after_tasks(set())


def _sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Size, number, list keys and needed lists of each text's set; of equal sets in a task only the first carries its keys."""
    def one(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        seen = _seen
        if len(seen) > SEEN_SETS:            # keys that come twice do no harm
            seen.clear()
        n, node, needs, keys, ends = [], [], [], [], [0]
        for d, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"), words)):
            number = _node(s) if len(s) else None
            own, need = list_keys(s, percent) if number not in seen and d is not None else (np.empty(0, np.uint64), 0)
            if d is not None:
                seen.add(number)
            n.append(len(s))
            node.append(number)
            needs.append(need)
            keys.append(own)
            ends.append(ends[-1] + len(own))
        flat = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
        return {"n": pa.array(n, pa.int64()), "node": pa.array(node, pa.int64()), "need": pa.array(needs, pa.int32()),
                "keys": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))}
    return append(docs, one, "n long, node long, need int, keys array<long>").drop("text")


def _wanted_sets(docs: DataFrame, words: int) -> DataFrame:
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = list(shingle_sets(batch.column("text"), words))
        ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                                          names=["node", "s"])
    return map_batches(docs, one, "node long, s array<long>")


def _sets_of(base: DataFrame, ids: DataFrame, words: int, space: Workspace) -> DataFrame:
    """The sets of the texts of ``ids``, each once. Only those of ids with several texts can come twice and are shuffled for it."""
    def of(some: DataFrame) -> DataFrame:
        return _wanted_sets(with_mark(base, some, "wanted").where("wanted").join(some.select("doc_id"), "doc_id").select("text"), words)
    several = ids.where("texts > 1")
    sets = of(ids.where("texts = 1"))
    return space.cut(sets if several.isEmpty() else sets.unionByName(of(several)).dropDuplicates(["node"]))


def _pairs(kept: DataFrame) -> DataFrame:
    """``(node, pivot)`` for every pivot that a set has to be compared with, of ``(key, node, need, pivot)``.

    Two linked sets share ``need`` lists at least. If each leaves out pivots that lead fewer than half as many of its lists in all,
    one list is left whose pivot both keep. The pivots that lead fewest go.
    """
    led = kept.where("node <> pivot").groupBy("node", "pivot").agg(F.count("*").alias("lists"), F.max("need").alias("need"))
    fewest = Window.partitionBy("node").orderBy("lists", "pivot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return led.withColumn("so_far", F.sum("lists").over(fewest)).where("2 * so_far >= need").select("node", "pivot")


class _Star:
    """The sets of one pivot as they come, as long as they are one block."""

    def __init__(self, pivot: int, others: int, block: int, percent: int):
        self.pivot, self.others, self.percent, self.block = pivot, others, percent, block
        self.rows, self.held, self.large = [], 0, others + 1 > block

    def add(self, node: int, s: np.ndarray, ps: np.ndarray) -> list[tuple]:
        """Takes in a set; gives the rows to be written at once, which are all of a pivot of more than one block."""
        lacks, extra = np.setdiff1d(ps, s, assume_unique=True), np.setdiff1d(s, ps, assume_unique=True)
        common = len(ps) - len(lacks)
        self.rows.append((node, self.pivot, len(s), len(ps), lacks, extra, 100 * common >= self.percent * (len(s) + len(ps) - common)))
        self.held += len(lacks) + len(extra)
        self.large |= self.held > BLOCK_SHINGLES
        return self._all() if self.large else []

    def _all(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows

    def close(self) -> list[tuple]:
        """Links alone if all sets of the pivot came here, else what came, to be dealt to blocks."""
        if self.large or len(self.rows) < self.others:
            return self._all()
        out = [(r[0], self.pivot, None, None, None, None, True) for r in self.rows if r[6]]
        if len(out) < len(self.rows) > 1:
            node, _, n, pn, lacks, extra, linked = zip(*self.rows)
            side = pa.StructArray.from_arrays(
                [pa.array(node, pa.int64()), pa.array([self.pivot if x else y for x, y in zip(linked, node)], pa.int64()), pa.array(n, pa.int64()),
                 pa.array(pn, pa.int64()), pa.array(lacks, pa.list_(pa.int64())), pa.array(extra, pa.list_(pa.int64()))],
                names=["node", "component", "n", "pn", "lacks", "extra"])
            out += [(a, b, None, None, None, None, True) for a, b in _forest(connecting_links(side, side, self.percent))]
        return out


def _forest(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """As many of the links as connect what all of them connect."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x
    out = []
    for a, b in links:
        if (x := root(a)) != (y := root(b)):
            up[x] = y
            out.append((a, b))
    return out


STAR = "node long, pivot long, n long, pn long, lacks array<long>, extra array<long>, linked boolean"


def _stars(pairs: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Of pivots of one block the links around them, as ``(node, pivot, linked)``. Of others a row per set: sizes, what it lacks of its
    pivot, what it has beyond it, and whether they are linked."""
    counted = pairs.join(pairs.groupBy("pivot").agg(F.count("*").alias("others")), "pivot").select("node", "pivot", "others")
    # neither side is renamed before its shuffle, so one shuffle of the sets does for both; merging brings the sets of a pivot one after the other
    a, m, p = counted.alias("a"), sets.alias("m"), sets.alias("p")
    both = a.join(m, F.col("a.node") == F.col("m.node")).join(p.hint("merge"), F.col("a.pivot") == F.col("p.node")).select(
        "a.node", "a.pivot", "a.others", "m.s", F.col("p.s").alias("ps"))

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2 + [pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["node", "pivot", "n", "pn", "lacks", "extra", "linked"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star = None
        for batch in slices(batches):
            out = []
            node, pivot, others = (batch.column(c).to_pylist() for c in ("node", "pivot", "others"))
            for i, (s, ps) in enumerate(zip(batch.column("s"), batch.column("ps"))):
                if star is None or star.pivot != pivot[i]:
                    out += star.close() if star else []
                    star = _Star(pivot[i], others[i], block, percent)
                out += star.add(node[i], s.values.to_numpy(), ps.values.to_numpy())
            if out:
                yield table(out)
        if star and (out := star.close()):
            yield table(out)
        star = batch = out = s = ps = None
        give_back()
    return both.mapInArrow(run, STAR)


def _shared(left: pa.ListArray, right: pa.ListArray) -> np.ndarray:
    """How many elements each array of one side shares with each of the other."""
    (a, rows_a), (b, rows_b) = _flat(left), _flat(right)
    words = np.intersect1d(a, b)

    def table(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        t = np.zeros((len(sizes), len(words)), np.float32)
        if len(words):
            at = np.minimum(np.searchsorted(words, flat), len(words) - 1)
            hit = words[at] == flat
            t[np.repeat(np.arange(len(sizes)), sizes)[hit], at[hit]] = 1
        return t
    return table(a, rows_a) @ table(b, rows_b).T


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)


def connecting_links(left: pa.StructArray, right: pa.StructArray, percent: int) -> list[tuple[int, int]]:
    """Links between sets of different components, enough to connect all that such links connect.

    Sizes of overlaps follow from the differences to the common pivot: what both have of the pivot, and what both have beyond it.
    """
    number = lambda side, c: side.field(c).to_numpy(zero_copy_only=False)
    ca, cb, na, nb = number(left, "component"), number(right, "component"), number(left, "n"), number(right, "n")
    if (ca == ca[0]).all() and (cb == ca[0]).all():
        return []
    la, lb = left.field("lacks"), right.field("lacks")
    lost = _flat(la)[1][:, None] + _flat(lb)[1][None, :] - _shared(la, lb)
    common = number(left, "pn")[0] - lost + _shared(left.field("extra"), right.field("extra"))
    linked = 100 * common >= percent * (na[:, None] + nb[None, :] - common)
    i, j = np.nonzero(linked & (ca[:, None] != cb[None, :]))
    _, first = np.unique(np.stack([np.minimum(ca[i], cb[j]), np.maximum(ca[i], cb[j])]), axis=1, return_index=True)
    return list(zip(number(left, "node")[i[first]].tolist(), number(right, "node")[j[first]].tolist()))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT,
                       block: int = BLOCK) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row: set size, and the least id reachable by links, itself included.

    Two documents link when ``100 * intersection >= percent * union``. Null texts and texts without words have no shingles and link
    with nothing. A row without id takes no part and has no component. Rows of one id are one document with several texts.
    Shingles and sets are told apart by 64- and 63-bit hashes. Extra columns are ignored; an empty table gives no rows.
    """
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    space = Workspace(docs.sparkSession, "jaccard")
    full = space.cut(_sets(base, words, percent))
    rows = space.cut(full.select("doc_id", "n", "node", "need"))
    known = rows.where("doc_id is not null and node is not null")
    # lists of one set are most of all; the others' rows go on
    each = full.where("doc_id is not null").select("node", F.explode("keys").alias("key"))
    whole = Window.partitionBy("key")
    several = space.cut(each.select("key", "node", F.min("node").over(whole).alias("a"), F.max("node").over(whole).alias("z")).where(
        "a <> z").select("key", "node").distinct())
    space.drop(full)
    needs = known.groupBy("node").agg(F.max("need").alias("need"))
    enough = several.groupBy("node").agg(F.count("*").alias("shared")).join(needs, "node").where("shared >= need").select("node", "shared", "need")
    # the set that stands in most lists leads each of its lists, so a set meets few pivots however large its group is
    central = F.min(F.struct((-F.col("shared")).alias("lists"), F.col("node").alias("node"))).over(whole)
    kept = several.join(enough, "node").select("key", "node", "need", central["node"].alias("pivot"))
    pairs = space.cut(_pairs(kept))
    space.drop(several)
    involved = pairs.select("node").union(pairs.select("pivot")).distinct()
    # a set is worked out again from the text of the least id that has it
    firsts = known.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(involved, "node").select("doc_id").distinct()
    first_ids = space.cut(firsts.join(known.groupBy("doc_id").agg(F.count("*").alias("texts")), "doc_id"))
    sets = _sets_of(base, first_ids, words, space)
    stars = space.cut(_stars(pairs, sets, percent, block))
    space.drop(sets)
    links = stars.where("linked").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    every = space.cut(connected_components(links.unionByName(_same_id(known)), "a", "b"))
    more = space.cut(_rest(stars.where("lacks is not null"), every, percent, block, space))
    if not more.isEmpty():
        ties = every.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b")
        every = connected_components(more.unionByName(ties), "a", "b")
    group = known.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(every, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    least = group.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of = group.join(least, "component").select("node", "component_id")
    own = rows.select("doc_id", F.col("n").alias("n_shingles"), "node").join(of, "node", "left").withColumn(
        "component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return space.close(own.select("doc_id", "n_shingles", "component_id"))


def _same_id(known: DataFrame) -> DataFrame:
    """Sets of different rows of one id, tied together."""
    ids = known.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc_id", "a")
    return known.select("doc_id", F.col("node").alias("b")).join(ids, "doc_id").where("a <> b").select("a", "b").distinct()


def _rest(stars: DataFrame, components: DataFrame, percent: int, block: int, space: Workspace) -> DataFrame:
    """Links around one pivot between sets that are still in several components, as ``(a, b)``.

    Every two sets of a list are compared with the list's pivot, so all its pairs meet here, once however many lists the
    pivot leads. A pivot with one other set has nothing left to decide.
    """
    own = stars.groupBy("pivot").agg(F.min("pn").alias("pn"), F.count("*").alias("others")).where("others > 1")
    others = stars.select("pivot", "node", "n", "pn", (F.size("lacks") + F.size("extra")).alias("held")).join(own.select("pivot"), "pivot", "left_semi")
    pivots = own.select("pivot", F.col("pivot").alias("node"), F.col("pn").alias("n"), "pn", F.lit(0).alias("held"))
    full = others.unionByName(pivots).join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    still_open = full.groupBy("pivot").agg(
        F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size"), F.sum("held").alias("held")).where(
        "x <> y").select("pivot", F.ceil(F.greatest(F.col("size") / block, F.col("held") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    # differences are long: they are joined with short rows only, and shuffled once, to their block
    none = F.array().cast("array<long>")
    long = stars.select("pivot", "node", "n", "pn", "lacks", "extra").join(still_open, "pivot").unionByName(
        pivots.drop("held").withColumn("lacks", none).withColumn("extra", none).join(still_open, "pivot"))
    dealt = long.join(components, "node", "left").withColumn("component", F.coalesce("component", "node")).withColumn(
        "part", F.pmod(F.xxhash64("node"), F.col("parts")))
    blocks = space.cut(dealt.groupBy(F.col("pivot").alias("key"), "parts", "part").agg(F.collect_list(F.struct("node", "component", "n", "pn", "lacks", "extra")).alias("m")))
    alone, several = blocks.where("parts = 1"), blocks.where("parts > 1")
    left, right = several.select("key", F.col("m").alias("l"), F.col("part").alias("lp")), several.select("key", F.col("m").alias("r"), F.col("part").alias("rp"))
    met = left.join(right, "key").where("lp <= rp").select("l", "r").unionByName(alone.select(F.col("m").alias("l"), F.col("m").alias("r")))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        got = set()
        for a, b in zip(batch.column("l"), batch.column("r")):
            got.update(connecting_links(a.values, b.values, percent))
        x, y = zip(*got) if got else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])
    return map_batches(met, one, "a long, b long").distinct()


def sql(words: int, percent: int) -> str:
    """The same by comparing every two documents that share a shingle; for small tables."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    gram = " || ' ' || ".join(f"ws[i + {k}]" for k in range(words))
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[^ \\x09-\\x0D]+') AS ws FROM documents WHERE text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= {words} THEN list_transform(range(1, len(ws) - {words - 2}), lambda i: {gram})
        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.k >= {percent} * (x.n + y.n - c.k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""
