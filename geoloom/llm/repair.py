"""Conversation structure repair at least cost, by a rank-convergence parallel Viterbi.

What has been written so far is one of four states, and a repair is a path through them: keep, rerole or delete each row, insert turns
anywhere. Backward costs say for each row and state what the rest costs at least. Rows are sorted over ranges, so a long
conversation lies in many chunks, and each chunk is worked out at once from a speculative cost vector at its end. Fix-up passes
then bring the next chunk's vector in and rerun from the end until vectors differ from the old ones only by a constant; what
lies before stays as it is. When no chunk has to be rerun, constants are added up over the chunks and every chunk is traced forward from each state it
can be entered in, always with the first letter in ASCII order that keeps to the least cost.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.arrow import map_batches
from geoloom.llm.workspace import Workspace
from geoloom.operators.skew import salted_join

CHUNK_BITS = 13                          # a chunk has at most 8,192 rows
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NOTHING, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
OK, BLANK, DUPLICATE, CUT = range(4)     # faults of a row
SPACES = " \t\n\x0b\f\r"
CELLS = "0123456789:;<=>?"               # a row in one character: four times its initial (s, u, a, other), plus its fault
INITIALS = "sua"

Vector = tuple[int, int, int, int]


def turn_after(state: int) -> int:
    """The state after the one of user and assistant that may follow ``state``."""
    return AFTER_ASSISTANT if state == AFTER_USER else AFTER_USER


def kept_state(initial: int, state: int) -> int | None:
    """The state after a row is kept, None where it may not be."""
    to = (AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT, None)[initial]
    if to == AFTER_SYSTEM:
        return to if state == NOTHING else None
    return to if to == turn_after(state) else None


def _closed(v: list[int]) -> list[int]:
    """Costs with turns inserted first where that is cheaper."""
    u, a = min(v[AFTER_USER], INSERT + v[AFTER_ASSISTANT]), min(v[AFTER_ASSISTANT], INSERT + v[AFTER_USER])
    return [min(v[NOTHING], INSERT + u), min(v[AFTER_SYSTEM], INSERT + u), u, a]


END: Vector = tuple(_closed([0, 1 << 20, 1 << 20, 0]))


@functools.lru_cache(maxsize=65_536)
def before(cell: str, after: Vector) -> tuple[Vector, int]:
    """The cost vector before a row from the one after it, less its least cost, and that cost."""
    initial, fault = divmod(CELLS.index(cell), 4)
    v = [DELETE + c for c in after]
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT else 0
        for q in range(4):
            v[q] = min(v[q], REROLE + more + after[turn_after(q)])
            to = kept_state(initial, q)
            if to is not None:
                v[q] = min(v[q], KEEP + more + after[to])
    v = _closed(v)
    low = min(v)
    return tuple(c - low for c in v), low


@functools.lru_cache(maxsize=65_536)
def steps(cell: str, after: Vector, state: int) -> tuple[str, int]:
    """The first letters in ASCII order of a least-cost repair from before a row to after it, and the state there."""
    initial, fault = divmod(CELLS.index(cell), 4)
    here, low = before(cell, after)
    letters = ""
    while True:
        left = here[state] + low
        if DELETE + after[state] == left:
            return letters + "D", state
        if INSERT + here[turn_after(state)] + low == left:
            letters, state = letters + "I", turn_after(state)
            continue
        more = TRUNCATED if fault == CUT else 0
        to = kept_state(initial, state)
        if to is not None and KEEP + more + after[to] == left:
            return letters + "K", to
        return letters + "R", turn_after(state)


def pack(v: Vector) -> bytes:
    return bytes(v)


def speculate(cells: str, right: Vector = END) -> tuple[bytes, int]:
    """Vectors at all places of a chunk from a vector at its end, and the constant between its start and end."""
    out, off, v = [right], 0, right
    for c in reversed(cells):
        v, low = before(c, v)
        out.append(v)
        off += low
    return b"".join(map(pack, reversed(out))), off


def fix_up(cells: str, vectors: bytes, off: int, right: Vector) -> tuple[bytes, int]:
    """The same with another vector at the end, rerun only until it differs from the old one by a constant."""
    out, v = [right], right
    i = len(cells)
    while i:
        i -= 1
        v, low = before(cells[i], v)
        off += low - before(cells[i], tuple(vectors[4 * i + 4:4 * i + 8]))[1]
        if pack(v) == vectors[4 * i:4 * i + 4]:
            return vectors[:4 * i + 4] + b"".join(map(pack, reversed(out))), off
        out.append(v)
    return b"".join(map(pack, reversed(out))), off


def trace(cells: str, vectors: bytes, state: int, last: bool) -> tuple[str, int]:
    letters = []
    for i, c in enumerate(cells):
        more, state = steps(c, tuple(vectors[4 * i + 4:4 * i + 8]), state)
        letters.append(more)
    while last and state in (AFTER_SYSTEM, AFTER_USER):
        letters.append("I")
        state = turn_after(state)
    return "".join(letters), state


def _counts(cells: str) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows, and neighbours that may not follow each other."""
    faults = [sum(cells.count(CELLS[4 * i + f]) for i in range(4)) for f in (BLANK, DUPLICATE, CUT)]
    return *faults, sum(_illegal(a, b) for a, b in zip(cells, cells[1:]))


@functools.lru_cache(maxsize=None)
def _illegal(a: str, b: str) -> bool:
    pair = tuple((INITIALS + "-")[CELLS.index(c) // 4] for c in (a, b))
    return pair not in {("s", "u"), ("u", "a"), ("a", "u")}


def _first_pass(chunks: DataFrame) -> DataFrame:
    """Vectors and counts of every chunk; conversations of one chunk are traced at once."""
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = {c: [] for c in ("vectors", "off", "audit", "blank", "duplicate", "truncated", "illegal")}
        for cells, n in zip(batch.column("cells").to_pylist(), batch.column("chunks").to_pylist()):
            vectors, off = speculate(cells)
            alone = n == 1
            for c, x in zip(out, (None if alone else vectors, off + (vectors[0] if alone else 0), trace(cells, vectors, NOTHING, True)[0] if alone else None,
                                  *_counts(cells))):
                out[c].append(x)
        types = [pa.binary(), pa.int64(), pa.string(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, t) for x, t in zip(out.values(), types))], names=[*batch.schema.names, *out])
    return map_batches(chunks, one, "conv_id long, at int, chunks int, cells string, vectors binary, off long, audit string, blank long, duplicate long, "
                                    "truncated long, illegal long")


def _fix_up_pass(chunks: DataFrame) -> DataFrame:
    """One pass: every chunk takes in the vector with which the next one of its conversation starts; ``changed`` where it had another."""
    starts = chunks.select(F.col("conv_id").alias("next_id"), (F.col("at") - 1).alias("next_at"), F.substring("vectors", 1, 4).alias("next"))
    both = chunks.join(starts, F.col("conv_id").eqNullSafe(F.col("next_id")) & (F.col("at") == F.col("next_at")), "left").select(
        "conv_id", "at", "chunks", "cells", "vectors", "off", "next")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors, off, changed = [], [], []
        for cells, v, o, right in zip(*(batch.column(c).to_pylist() for c in ("cells", "vectors", "off", "next"))):
            stale = right is not None and v[-4:] != right
            if stale:
                v, o = fix_up(cells, v, o, tuple(right))
            vectors.append(v)
            off.append(o)
            changed.append(stale)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "at", "chunks", "cells")), pa.array(vectors, pa.binary()), pa.array(off, pa.int64()),
                                           pa.array(changed, pa.bool_())], names=["conv_id", "at", "chunks", "cells", "vectors", "off", "changed"])
    return map_batches(both, one, "conv_id long, at int, chunks int, cells string, vectors binary, off long, changed boolean")


def _traced(chunks: DataFrame) -> DataFrame:
    """Each chunk's letters and exit from each state in which it may be entered."""
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        exits, letters = [], []
        for at, n, cells, v in zip(*(batch.column(c).to_pylist() for c in ("at", "chunks", "cells", "vectors"))):
            ways = [trace(cells, v, q, at == n) for q in (range(4) if at > 1 else (NOTHING,))]
            letters.append([w for w, _ in ways])
            exits.append([q for _, q in ways])
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "at", "off")),
                                           pa.array([v[0] for v in batch.column("vectors").to_pylist()], pa.int64()), pa.array([c[0] for c in batch.column("cells").to_pylist()]),
                                           pa.array([c[-1] for c in batch.column("cells").to_pylist()]), pa.array(exits, pa.list_(pa.int32())), pa.array(letters, pa.list_(pa.string()))],
                                          names=["conv_id", "at", "off", "start", "first", "last", "exits", "letters"])
    return map_batches(chunks, one, "conv_id long, at int, off long, start long, first string, last string, exits array<int>, letters array<string>")


def _stitched(traced: DataFrame) -> DataFrame:
    """Audit, cost and neighbours across chunks of the conversations that lie in several chunks."""
    parts = traced.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "off", "start", "first", "last", "exits", "letters"))).alias("parts"))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        audit, cost, across = [], [], []
        for chunks in batch.column("parts").to_pylist():
            state, letters = NOTHING, []
            for c in chunks:
                letters.append(c["letters"][state])
                state = c["exits"][state]
            audit.append("".join(letters))
            cost.append(chunks[0]["start"] + sum(c["off"] for c in chunks))
            across.append(sum(_illegal(a["last"], b["first"]) for a, b in zip(chunks, chunks[1:])))
        return pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(audit), pa.array(cost, pa.int64()), pa.array(across, pa.int64())],
                                          names=["conv_id", "audit", "cost", "across"])
    return map_batches(parts, one, "conv_id long, audit string, cost long, across long")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _written(report: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds the digest of the repaired text. Each conversation's rows pass by in order, none is held."""
    body = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "h1", "h2", "text")
    heads = report.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(0).cast("long").alias("h1"),
                          F.lit(0).cast("long").alias("h2"), F.lit("").alias("text"), *COUNTS, "audit")
    order = ["conv_id", "kind", "turn", "role", "h1", "h2"]
    both = heads.unionByName(body, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions(*order)
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, writer = None, None
        for batch in batches:
            done = []
            numbers = list(zip(*(batch.column(c).to_pylist() for c in ("conv_id", *COUNTS, "audit"))))
            for kind, role, text, own in zip(*(batch.column(c).to_pylist() for c in ("kind", "role", "text")), numbers):
                if kind == 0:
                    if head is not None:
                        done.append((*head, writer.close()))
                    head, writer = own, _Writer(own[-1])
                else:
                    writer.row(role, text)
            if done:
                yield _report(done, names)
        if head is not None:
            yield _report([(*head, writer.close())], names)
    return both.select("conv_id", *COUNTS, "audit", "kind", "role", "text").mapInArrow(
        run, ", ".join(["conv_id long", *(f"{c} long" for c in COUNTS), "audit string, repaired_sha256 string"]))


def _report(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [*[pa.int64()] * (len(names) - 2), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


class _Writer:
    """Follows an audit row by row and hashes what is written."""

    def __init__(self, audit: str):
        self.letters, self.state, self.hash, self.any = iter(audit), NOTHING, sha256(), False

    def _write(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def _turn(self, text: str) -> None:
        self.state = turn_after(self.state)
        self._write("assistant" if self.state == AFTER_ASSISTANT else "user", text)

    def row(self, role: str, text: str) -> None:
        for letter in self.letters:
            if letter == "I":
                self._turn("")
                continue
            if letter == "K":
                self.state = kept_state(INITIALS.index(role[0]), self.state)
                self._write(role, text)
            elif letter == "R":
                self._turn(text)
            return

    def close(self) -> str:
        for _ in self.letters:
            self._turn("")
        return self.hash.hexdigest()


def damage(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with faults put in by the checksum of ``conv_id:turn``; nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(space("role"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.where(kind != 0).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
                                        copies.alias("copy")).drop("copy")


def _cell(blank: Column, duplicate: Column, truncated: Column) -> Column:
    initial = F.when(F.col("initial") == "", 3).otherwise(F.coalesce(F.nullif(F.instr(F.lit(INITIALS), F.col("initial")), F.lit(0)) - 1, F.lit(3)))
    fault = F.when(blank, BLANK).when(duplicate, DUPLICATE).when(truncated, CUT).otherwise(OK)
    return F.substring(F.lit(CELLS), initial * 4 + fault + 1, F.lit(1))


def repair(rows: DataFrame, ids: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` for each distinct id of ``ids``.

    ``rows`` are ``(conv_id, turn, role, text)``, taken by turn (nulls first); rows of one turn by role, then by a hash of the text, so
    that equal rows stand together. Null roles and texts are one space. A null id is a conversation of its own. A role counts by its first
    character; an empty role can't be kept. Ids without rows have zeros, an empty audit and the digest of nothing. Duplicates are told by
    128 bits of hash. Extra columns are ignored. A conversation's audit is one value and its digest runs over all its
    text in order, so that last step streams one conversation through one task, without holding it.
    """
    space = Workspace(rows.sparkSession, "repair")
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    marked = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).withColumn(
        "h1", F.xxhash64("conv_id", "role", "text")).withColumn("h2", F.xxhash64(F.lit(17), "conv_id", "role", "text"))
    trimmed = F.rtrim("text", F.lit(SPACES))
    order = ["conv_id", "turn", "role", "h1", "h2", "row"]
    slim = marked.select("conv_id", "turn", "role", "h1", "h2", F.substring("role", 1, 1).alias("initial"), (trimmed == "").alias("blank"),
                         (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("truncated"), F.monotonically_increasing_id().alias("row"))
    placed = space.cut(slim.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", "turn", "h1", "h2", "initial", "blank", "truncated", F.monotonically_increasing_id().alias("pos")))
    first = placed.where("not blank").groupBy("h1", "h2").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    known = salted_join(placed, first, ["h1", "h2"], ["pos"], "left")
    cell = _cell(F.col("blank"), F.coalesce(F.col("first") < F.col("pos"), F.lit(False)), F.col("truncated"))
    of = Window.partitionBy("conv_id")
    chunks = space.cut(known.select("conv_id", F.shiftright("pos", chunk_bits).alias("chunk"), F.struct("pos", cell.alias("cell")).alias("x")).groupBy("conv_id", "chunk").agg(
        F.sort_array(F.collect_list("x")).alias("x")).select(
        "conv_id", F.row_number().over(of.orderBy("chunk")).alias("at"), F.count("*").over(of).cast("int").alias("chunks"),
        F.array_join(F.transform("x", lambda x: x["cell"]), "").alias("cells")))
    passed = space.cut(_first_pass(chunks))
    counts = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    found = passed.groupBy("conv_id").agg(*counts, F.max("audit").alias("audit"), F.max(F.when(F.col("chunks") == 1, F.col("off"))).alias("cost"))
    several = passed.where("chunks > 1").select("conv_id", "at", "chunks", "cells", "vectors", "off")
    if not several.isEmpty():
        while True:
            several = space.cut(_fix_up_pass(several))
            if several.where("changed").isEmpty():
                break
            several = several.drop("changed")
        more = _stitched(_traced(several)).withColumnsRenamed({"conv_id": "other", "audit": "whole", "cost": "sum"})
        found = found.join(more, F.col("conv_id").eqNullSafe(F.col("other")), "left").select(
            "conv_id", "blank", "duplicate", "truncated", (F.col("illegal") + F.coalesce("across", F.lit(0))).alias("illegal"),
            F.coalesce("audit", "whole").alias("audit"), F.coalesce("cost", "sum").alias("cost"))
    turns = placed.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
    all_ids = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    report = all_ids.join(found.withColumnRenamed("conv_id", "a"), F.col("conv_id").eqNullSafe(F.col("a")), "left").join(
        turns.withColumnRenamed("conv_id", "b"), F.col("conv_id").eqNullSafe(F.col("b")), "left").select(
        "conv_id", *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"))
    return space.close(_written(report, marked))


def sql() -> str:
    """The same over damaged ``conversations``, forward row by row: a state is its cost in eight digits followed by its audit, so the least text wins."""
    none = "'99999999'"
    add = lambda s, k, letter: f"CASE WHEN {s} >= {none} THEN {none} ELSE printf('%08d', CAST(left({s}, 8) AS INTEGER) + {k}) || substr({s}, 9) || '{letter}' END"
    may = lambda test, s: f"CASE WHEN {test} THEN {s} ELSE {none} END"
    free = "fault NOT IN ('b', 'd')"
    before_user = "least(s0, s1, s3)"
    return f"""
WITH RECURSIVE bits AS (SELECT range AS i, range AS v, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (SELECT *, xor(list_reduce(list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT)),
  lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS kind FROM named, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM damaged),
rows AS (SELECT *, left(role, 1) AS ini, CASE WHEN said = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
  WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'k' END AS fault FROM placed),
ids AS (SELECT DISTINCT conv_id FROM conversations),
walk AS (SELECT conv_id, 0 AS i, '00000000' AS s0, {none} AS s1, '00000005I' AS s2, '00000010II' AS s3 FROM ids
  UNION ALL SELECT conv_id, i, n0, n1, least(n2, {add('least(n0, n1, n3)', 5, 'I')}),
    least(n3, {add(f"least(n2, {add('least(n0, n1, n3)', 5, 'I')})", 5, 'I')}) FROM (
    SELECT w.conv_id, r.i, {add('s0', 2, 'D')} AS n0,
      least({add('s1', 2, 'D')}, {may(f"{free} AND ini = 's'", add('s0', "CASE fault WHEN 't' THEN 5 ELSE 0 END", 'K'))}) AS n1,
      least({add('s2', 2, 'D')}, {may(f"{free} AND ini = 'u'", add(before_user, "CASE fault WHEN 't' THEN 5 ELSE 0 END", 'K'))},
            {may(free, add(before_user, "CASE fault WHEN 't' THEN 6 ELSE 1 END", 'R'))}) AS n2,
      least({add('s3', 2, 'D')}, {may(f"{free} AND ini = 'a'", add('s2', "CASE fault WHEN 't' THEN 5 ELSE 0 END", 'K'))},
            {may(free, add('s2', "CASE fault WHEN 't' THEN 6 ELSE 1 END", 'R'))}) AS n3
    FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1)),
ends AS (SELECT conv_id, arg_max(least(s0, s3), i) AS best FROM walk GROUP BY conv_id),
letters AS (SELECT conv_id, substr(best, 8 + p, 1) AS letter, p FROM ends, LATERAL (SELECT unnest(range(1, length(best) - 7)) AS p)),
steps AS (SELECT *, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS o FROM letters
  WINDOW w AS (PARTITION BY conv_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
written AS (SELECT s.conv_id, s.p, s.letter, s.o, r.role, r.text, r.ini FROM steps s LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i AND s.letter <> 'I'
  WHERE s.letter <> 'D'),
shifted AS (SELECT *, o - max(CASE WHEN o = 1 AND letter = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS n FROM written),
texts AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN n % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS body
  FROM shifted GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
  count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (bad) AS illegal FROM (
    SELECT *, ini_before || ini NOT IN ('su', 'ua', 'au') AS bad FROM (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS ini_before FROM rows)) GROUP BY conv_id)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(left(best, 8) AS BIGINT) AS cost, substr(best, 9) AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM ids d JOIN ends e ON d.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN counts c ON d.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN texts t ON d.conv_id IS NOT DISTINCT FROM t.conv_id"""
