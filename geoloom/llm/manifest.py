"""Merkle manifest of a dataset: a digest per row, a tree per group, one root over all groups, and a proof per row.

Where a leaf stands in its group's tree is a rank query on bitmaps of the ids. Ids are filed in words of 64 bits, empty words
are left out, and the bitmaps of all tasks are merged by ``bit_or`` before the shuffle. Running popcounts, by word inside a container of
512 words and by container above it, say how many ids stand before a word; the bits below a row's own say the rest. So no
group is ever sorted or numbered as a whole.

Nodes are then keyed by their coordinates. A block of 512 consecutive nodes of a group is one array of slots, which
takes three levels of the tree at once; proofs come back down the same blocks.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.workspace import Workspace
from geoloom.operators.skew import salted_join

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 8
LEVELS = 3                   # of the tree that one block of slots takes
SLOTS = FANOUT ** LEVELS
WORD, CONTAINER, DIRECTORY = 6, 15, 12       # bits of an id that name its bit, its word and bit; bits that each directory level takes off
NO_ID = -(1 << 48) - 1       # the container before all others, for rows without id
PATH = "array<struct<before string, after string>>"


def digest(parts: list[Column]) -> Column:
    """Lower-case hex SHA-256 of the fields: ``-`` for null, else the UTF-8 byte count, a colon and the value."""
    def one(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return F.sha2(F.concat(*map(one, parts)), 256)


def ranks(rows: DataFrame, group: list[str], keys: list[str], total: int, space: Workspace) -> DataFrame:
    """Adds ``rank`` (from 0, by the long columns ``keys``, nulls first) and ``total``, the size of the row's group.

    The first key decides; rows that share it are ranked among themselves by the next one in the same way, and the last key must
    be unique. ``group`` columns must not be null. ``total`` is the number of rows, known to the caller.
    """
    key, names = F.col(keys[0]), rows.columns
    at = rows.withColumn("_c", F.coalesce(F.shiftright(key, CONTAINER), F.lit(NO_ID))).withColumn(
        "_w", F.coalesce(F.shiftright(key, WORD).bitwiseAND(511).cast("int"), F.lit(0))).withColumn(
        "_bit", F.coalesce(key.bitwiseAND(63).cast("int"), F.lit(0)))
    word = [*group, "_c", "_w"]
    words = space.cut(at.groupBy(*word).agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"), F.count("*").alias("_n")))
    inside = Window.partitionBy(*group, "_c").orderBy("_w").rowsBetween(Window.unboundedPreceding, -1)
    base = _container_bases(words, group)
    sizes = words.groupBy(*group).agg(F.sum("_n").alias("total"))
    place = words.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(base, [*group, "_c"]).join(sizes, group).select(
        *word, "_bits", "total", (F.col("_base") + F.col("_before")).alias("_start"))
    repeated = words.where(F.col("_n") > F.bit_count("_bits")).select(*word)
    twice = None
    if len(keys) > 1 and not repeated.isEmpty():
        twice = at.join(repeated, word, "left_semi").groupBy(*word, "_bit").count().where("count > 1")
        more = twice.groupBy(*word).agg(F.collect_list(F.struct("_bit", (F.col("count") - 1).alias("more"))).alias("_more"))      # 64 at most
        place = place.join(more, word, "left")
    else:
        place = place.withColumn("_more", F.lit(None).cast("array<struct<_bit int, more bigint>>"))
    lower = F.bit_count(F.col("_bits").bitwiseAND(F.expr("~shiftleft(-1L, _bit)")))
    extra = F.coalesce(F.aggregate(F.filter("_more", lambda m: m["_bit"] < F.col("_bit")), F.lit(0).cast("long"),
                                   lambda s, m: s + m["more"]), F.lit(0))
    out = salted_join(at, place, word, [keys[-1]], total=total).withColumn("rank", (F.col("_start") + lower + extra).cast("long"))
    if twice is None:
        return out.select(*names, "rank", "total")
    own = F.coalesce(F.exists("_more", lambda m: m["_bit"] == F.col("_bit")), F.lit(False))
    first, size, ident = (f"{c}{len(keys)}" for c in ("_first", "_total", "_id"))
    same = out.where(own).select(*names, F.col("rank").alias(first), F.col("total").alias(size), F.struct("_c", "_w", "_bit").alias(ident))
    among = ranks(space.cut(same), [*group, ident], keys[1:], total, space)
    return out.where(~own).select(*names, "rank", "total").unionByName(among.select(
        *names, (F.col(first) + F.col("rank")).alias("rank"), F.col(size).alias("total")))


def _container_bases(words: DataFrame, group: list[str]) -> DataFrame:
    """How many rows of its group stand before each container: a directory of popcounts with 4,096 entries a node at most."""
    level = words.groupBy(*group, "_c").agg(F.sum("_n").alias("_n"))
    ends = level.agg(F.min("_c"), F.max("_c")).first()
    lo, hi = ends[0] or 0, ends[1] or 0
    up = [level]
    while hi - lo >= 1 << DIRECTORY:
        lo, hi = lo >> DIRECTORY, hi >> DIRECTORY
        up.append(up[-1].groupBy(*group, F.shiftright("_c", DIRECTORY).alias("_c")).agg(F.sum("_n").alias("_n")))
    before = lambda by: F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_c").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    base = up.pop().withColumn("_base", before(group)).drop("_n")
    while up:
        own = up.pop().withColumn("_up", F.shiftright("_c", DIRECTORY)).withColumn("_own", before([*group, "_up"])).drop("_n")
        base = own.join(base.withColumnsRenamed({"_c": "_up"}), [*group, "_up"]).select(
            *group, "_c", (F.col("_base") + F.col("_own")).alias("_base"))
    return base


def _hash(texts: list[str]) -> str:
    return sha256("".join(texts).encode()).hexdigest()


def slot_levels(slots: list[str], total: int) -> list[list[str]]:
    """The slots of a block and the levels above them, as far as the block reaches; ``total`` nodes stand on the level in all."""
    out = [slots]
    while total > 1 and len(out) <= LEVELS:
        below = out[-1]
        out.append([_hash(below[i:i + FANOUT]) for i in range(0, len(below), FANOUT)])
        total = -(-total // FANOUT)
    return out


def _slots(t: pa.Table) -> tuple[list[int], list[str]]:
    """Each row's slot, and the digests by slot; blocks have no gaps."""
    at = [n % SLOTS for n in t.column("node").to_pylist()]
    slots = [""] * len(at)
    for i, d in zip(at, t.column("digest").to_pylist()):
        slots[i] = d
    return at, slots


def _siblings(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """The other nodes of the run on each level of the block, before and after the path."""
    out = []
    for level in levels[:-1]:
        run = at - at % FANOUT
        out.append(("".join(level[run:at]), "".join(level[at + 1:run + FANOUT])))
        at //= FANOUT
    return out


def _parents(nodes: DataFrame) -> DataFrame:
    def one(t: pa.Table) -> pa.Table:
        total = t.column("total")[0].as_py()
        top = slot_levels(_slots(t)[1], total)[-1]
        return pa.table({"g": [t.column("g")[0].as_py()], "node": [t.column("node")[0].as_py() // SLOTS], "digest": top,
                         "total": [-(-total // SLOTS)]})
    return nodes.groupBy("g", F.expr(f"node div {SLOTS}")).applyInArrow(one, "g string, node long, digest string, total long")


def _with_paths(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """Adds ``path`` and ``subroot`` to nodes, whose blocks are the nodes of ``parents``."""
    kept = nodes.columns
    schema = nodes.select(*kept, F.lit(None).cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot")).schema

    def one(t: pa.Table, up: pa.Table) -> pa.Table:
        at, slots = _slots(t)
        levels = slot_levels(slots, t.column("total")[0].as_py())
        rest = [(p["before"], p["after"]) for p in up.column("path")[0].as_py()]
        paths = [[{"before": b, "after": a} for b, a in _siblings(levels, i) + rest] for i in at]
        return pa.table([*(t.column(c) for c in kept), pa.array(paths, pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))),
                         pa.array([up.column("subroot")[0].as_py()] * len(at), pa.string())], names=[*kept, "path", "subroot"])
    return nodes.groupBy("g", F.expr(f"node div {SLOTS}")).cogroup(parents.groupBy("g", "node")).applyInArrow(one, schema)


def _fold(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """The leaves' proofs, hashed and folded: ``(doc_id, leaf, subroot, proof_sha256, folded_root)``."""
    def one(t: pa.Table, up: pa.Table) -> pa.Table:
        at, slots = _slots(t)
        levels = slot_levels(slots, t.column("total")[0].as_py())
        rest = [(p["before"], p["after"]) for p in up.column("path")[0].as_py()]
        above = "".join(b + a for b, a in rest)
        proof, folded = [], []
        for i, h in zip(at, t.column("shown").to_pylist()):
            own = _siblings(levels, i)
            proof.append(_hash([*(b + a for b, a in own), above]))
            for b, a in own + rest:
                h = _hash([b, h, a])
            folded.append(h)
        return pa.table({"doc_id": t.column("doc_id"), "leaf": t.column("digest"), "subroot": pa.array([up.column("subroot")[0].as_py()] * len(at), pa.string()),
                         "proof_sha256": proof, "folded_root": folded})
    return nodes.groupBy("g", F.expr(f"node div {SLOTS}")).cogroup(parents.groupBy("g", "node")).applyInArrow(
        one, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")


def _tree(nodes: DataFrame, largest: int, space: Workspace) -> list[DataFrame]:
    """The nodes after each round, down to one node a group."""
    out = [nodes]
    while largest > 1:
        out.append(space.cut(_parents(out[-1].select("g", "node", "digest", "total"))))
        largest = -(-largest // SLOTS)
    return out


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS,
             shown: dict[str, Column] | None = None) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` for every row.

    A leaf is the digest of a row's ``fields``. In each group the leaves ascend by id; while several nodes remain, every eight
    consecutive ones become their digest, the last run however short it is. A group of one row has its leaf as subroot. Subroots,
    ordered by group (null first, then bytewise), make up the root in the same way. ``shown`` replaces fields by what a holder of the rows
    shows for them: its leaf, folded along the untouched siblings, gives ``folded_root``, and ``verified`` says whether that is the root.

    A null field counts as ``-``, an empty one as ``0:``. Rows without id come before all others; rows that share an id ascend by
    their leaf, and equal rows are told apart by a row number, so each of them has a place and proof of its own. An empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    space = Workspace(docs.sparkSession, "manifest")
    at = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))        # '-' sorts before '='
    own = [F.col(f) for f in fields]
    claimed = [(shown or {}).get(f, F.col(f)) for f in fields]
    leaves = space.cut(docs.select(at.alias("g"), F.col(key).cast("long").alias("doc_id"), digest(own).alias("digest"), digest(claimed).alias("shown"),
                                   F.monotonically_increasing_id().alias("row")))
    n = leaves.count()
    result = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if n == 0:
        return docs.sparkSession.createDataFrame([], result)
    by_leaf = leaves.withColumn("lead", F.conv(F.substring("digest", 1, 15), 16, 10).cast("long"))
    placed = space.cut(ranks(by_leaf, ["g"], ["doc_id", "lead", "row"], n, space).select(
        "g", F.col("rank").alias("node"), "digest", "total", "doc_id", "shown"))
    trees = _tree(placed, placed.agg(F.max("total")).first()[0], space)
    tops = space.cut(trees[-1].select("g", "digest").orderBy("g").withColumn("row", F.monotonically_increasing_id()))
    groups = tops.count()
    numbered = space.cut(ranks(tops.withColumn("all", F.lit("")), ["all"], ["row"], groups, space).select(
        F.col("all").alias("g"), F.col("rank").alias("node"), "digest", "total", F.col("g").alias("of")))
    over = _tree(numbered, groups, space)
    root = over[-1].first()["digest"]
    none = F.array().cast(PATH)
    paths = over[-1].select("g", "node", "digest", none.alias("path"), F.lit(None).cast("string").alias("subroot"),
                            *([F.col("of")] if len(over) == 1 else []))
    for nodes in reversed(over[:-1]):
        paths = _with_paths(nodes, paths)
    paths = space.cut(paths.select(F.col("of").alias("g"), F.lit(0).cast("long").alias("node"), "path", F.col("digest").alias("subroot")))
    for nodes in reversed(trees[1:-1]):
        paths = space.cut(_with_paths(nodes, paths).select("g", "node", "path", "subroot"))
    if len(trees) == 1:                                    # every group has one row, which is its own top
        trees.append(placed)
    return space.close(_fold(placed, paths).select(
        "doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified")))


def sql(levels: int = 8, top: int = 4) -> str:
    """The same for groups of up to ``8 ** levels`` rows and ``8 ** top`` groups, level by level; ids must be distinct.

    Every row whose id has a checksum divisible by three shows its text in lower case.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    part = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(part, FIELDS[:-1]), part(text)]) + ")"
    out = [f"""WITH RECURSIVE bits AS (SELECT range AS i, range AS v, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
sums AS (SELECT doc_id, xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
  lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS crc FROM documents, crc),
x0 AS (SELECT doc_id, lang AS g, {leaf('text')} AS leaf, {leaf(f"CASE WHEN crc % 3 = 0 THEN translate(text, '{upper}', '{upper.lower()}') ELSE text END")} AS h,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, '' AS proof, CAST(NULL AS VARCHAR) AS subroot FROM documents JOIN sums USING (doc_id)),
n0 AS (SELECT g, i, leaf AS d, count(*) OVER (PARTITION BY g) AS n FROM x0)"""]
    total = levels + top

    def climb(k: int) -> None:
        run = "PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN"
        out.append(f"""s{k} AS (SELECT g, i, n, coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
  coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM n{k}),
n{k + 1} AS (SELECT g, i // 8 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END AS d,
  (any_value(n) + 7) // 8 AS n FROM n{k} GROUP BY g, i // 8),
x{k + 1} AS (SELECT doc_id, x.g, leaf, CASE WHEN s.n > 1 THEN sha256(b || h || a) ELSE h END AS h, x.i // 8 AS i, proof || b || a AS proof, subroot
  FROM x{k} x JOIN s{k} s ON x.g IS NOT DISTINCT FROM s.g AND x.i = s.i)""")
    for k in range(levels):
        climb(k)
    out.append(f"""o AS (SELECT g, d, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM n{levels}),
n{levels + 1} AS (SELECT CAST(NULL AS VARCHAR) AS g, i, d, n FROM o),
x{levels + 1} AS (SELECT doc_id, CAST(NULL AS VARCHAR) AS g, leaf, h, o.i AS i, proof, o.d AS subroot FROM x{levels} x JOIN o ON x.g IS NOT DISTINCT FROM o.g)""")
    for k in range(levels + 1, total + 1):
        climb(k)
    return ",\n".join(out) + f"""
SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = d AS verified FROM x{total + 1}, n{total + 1}"""
