"""Iterative graph work as joins: components, cheapest paths from many origins, ring stitching.

Every round is written to reliable checkpoint storage, so lost executors cost one round, not the whole loop, and the
only thing the driver sees is a count.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.skew import MAX_HOT, ROWS_PER_SALT, salted_join
from geoloom.session import cut_lineage


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an undirected edge list; the component is its least node.

    Alternates large-star and small-star steps: each node points its neighbours at the least node it knows. A hub's
    neighbours are many rows under one key, so the step's join is salted; the minimum itself combines map-side.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    e = cut_lineage(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def mark(df):
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    last = mark(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = salted_join(both.where("v > u"), least, ["u"], ["v"], total=last[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # every row now points from a node to a smaller one
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(down, low, ["u"], ["v"], total=last[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v")))
        e = cut_lineage(small.where("u <> v").distinct())
        now = mark(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    return nodes.join(e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"))


def service_area(edges: DataFrame, origins: DataFrame, max_cost: float, src: str = "src", dst: str = "dst",
                 cost: str = "cost", origin: str = "origin", node: str = "node", max_rounds: int = 10_000) -> DataFrame:
    """Least cost from each origin to every node within ``max_cost``, for all origins at once.

    ``edges`` are directed (see :func:`geoloom.operators.network.undirected`); costs are non-negative. Each round
    joins only the nodes improved in the round before. Streets leaving a hub node are salted once, up front.
    """
    e = edges.where(F.col(cost) <= max_cost).groupBy(F.col(src).alias("node"), F.col(dst).alias("to")).agg(
        F.min(cost).alias("c"))
    hot = e.groupBy("node").count().where(F.col("count") > ROWS_PER_SALT).orderBy(F.desc("count")).limit(MAX_HOT).select(
        "node", F.ceil(F.col("count") / ROWS_PER_SALT).cast("int").alias("salts"))
    hot = F.broadcast(cut_lineage(hot))
    e = e.join(hot, "node", "left").withColumn(
        "salt", F.pmod(F.xxhash64("to"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    e = cut_lineage(e.repartition("node", "salt"))
    start = origins.select(F.col(origin).alias("origin"), F.col(node).alias("node"), F.lit(0.0).alias("best")).distinct()
    dist = cut_lineage(start.withColumn("fresh", F.lit(True)))
    for _ in range(max_rounds):
        front = dist.where("fresh").join(hot, "node", "left").withColumn(
            "salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
        step = front.join(e, ["node", "salt"]).select(
            "origin", F.col("to").alias("node"), (F.col("best") + F.col("c")).alias("new")).where(F.col("new") <= max_cost)
        merged = dist.select("origin", "node", F.col("best").alias("old"), F.lit(None).cast("double").alias("new")).unionByName(
            step.select("origin", "node", F.lit(None).cast("double").alias("old"), F.col("new").cast("double")))
        dist = cut_lineage(merged.groupBy("origin", "node").agg(F.min("old").alias("old"), F.min("new").alias("new")).select(
            "origin", "node", F.least("old", "new").alias("best"),
            F.coalesce(F.col("new") < F.col("old"), F.col("old").isNull()).alias("fresh")))
        if dist.where("fresh").isEmpty():
            return dist.select(F.col("origin").alias(origin), F.col("node").alias(node), F.col("best").alias("cost"))
    raise RuntimeError("service area did not settle; raise max_rounds")


def _cycles(edges: DataFrame, group: list[str], left_first: bool, max_rounds: int) -> DataFrame:
    """``(group, id, nxt, least)``: each directed edge, the edge that follows it, and the least edge of its cycle."""
    g = [F.col(c) for c in group]
    e = edges.select(*g, "x2", "y2", F.struct("x1", "y1", "x2", "y2").alias("id"),
                     F.atan2(F.col("y1") - F.col("y2"), F.col("x1") - F.col("x2")).alias("back"))
    nxt = edges.select(*g, F.col("x1").alias("x2"), F.col("y1").alias("y2"),
                       F.struct("x1", "y1", "x2", "y2").alias("nid"),
                       F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")).alias("out"))
    two_pi = 2.0 * F.pi()
    turn = F.pmod(F.col("out") - F.col("back") + two_pi, two_pi)
    choose = F.max if left_first else F.min
    step = cut_lineage(e.join(nxt, [*group, "x2", "y2"]).withColumn("turn", turn).groupBy(*group, "id").agg(
        choose(F.struct("turn", "nid"))["nid"].alias("nxt")))
    s = step.withColumn("least", F.least("id", "nxt"))
    for _ in range(max_rounds):
        ahead = s.select(*group, F.col("id").alias("nxt"), F.col("nxt").alias("nn"), F.col("least").alias("nl"))
        s = cut_lineage(s.join(ahead, [*group, "nxt"]).select(
            *group, "id", F.col("nn").alias("nxt"), F.least("least", "nl").alias("least"),
            (F.col("nl") < F.col("least")).alias("moved")))
        if s.where("moved").isEmpty():
            return step.join(s.select(*group, "id", "least"), [*group, "id"])
    raise RuntimeError("rings did not settle; raise max_rounds")


WALK_EDGES = 50_000


def stitch_rings(edges: DataFrame, group: list[str], max_rounds: int = 64, walk_edges: int = WALK_EDGES) -> DataFrame:
    """Directed boundary edges ``(group, x1, y1, x2, y2)`` to closed rings ``(group, ring, seq, x, y)``.

    The interior lies to the left of each edge, so shells run counter-clockwise and holes clockwise. Where rings share
    a corner the walk turns left for shells and right for holes, which keeps rings from touching themselves.
    Rings are found by pointer doubling: after n rounds every edge knows the least edge among the 2^n that follow, and
    then its distance to that edge, so a ring of a million corners takes twenty rounds and no task holds it whole.
    Groups of up to ``WALK_EDGES`` edges - nearly all polygons - are walked edge by edge, one group to a task; the
    doubling is for the outlines of whole coastlines. Both give the same rings and refuse an open boundary.
    """
    e = cut_lineage(edges.select(*group, "x1", "y1", "x2", "y2").distinct())
    sizes = cut_lineage(e.groupBy(*group).agg(F.count("*").alias("_n")))
    small, large = sizes.where(F.col("_n") <= walk_edges), sizes.where(F.col("_n") > walk_edges)
    out = None
    if not small.isEmpty():
        out = _walk_rings(e.join(small.select(*group), group, "left_semi"), group)
    if not large.isEmpty():
        far = _double_rings(cut_lineage(e.join(large.select(*group), group, "left_semi")), group, max_rounds)
        out = far if out is None else out.unionByName(far)
    return out if out is not None else _walk_rings(e, group)


def _walk_rings(edges: DataFrame, group: list[str]) -> DataFrame:
    types = dict(edges.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in group) + ", r1 double, r2 double, r3 double, r4 double, seq int, x double, y double"

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        out_of: dict = {}
        for x1, y1, x2, y2 in pdf[["x1", "y1", "x2", "y2"]].itertuples(index=False):
            out_of.setdefault((x1, y1), []).append((x2, y2))
        rows: list = []
        for start in sorted(out_of):
            while out_of[start]:
                ring, here = [start], out_of[start].pop()
                while here != start or out_of[start] and _keeps_left(ring, here, out_of[start]):
                    ring.append(here)
                    ways = out_of.get(here)
                    if not ways:
                        raise ValueError(f"boundary is open at {here}")
                    here = ways.pop(_leftmost(ring[-2], here, ways))
                rows += _simple_loops(ring)
        keys = [pdf[c].iloc[0] for c in group]
        flat = [(*keys, *r, k, *p) for r, pts in rows for k, p in enumerate(pts)]
        return pd.DataFrame(flat, columns=[*group, "r1", "r2", "r3", "r4", "seq", "x", "y"])

    got = edges.groupBy(*group).applyInPandas(lambda pdf: walk(pdf), schema)
    ring = F.struct(*[F.col(a).alias(b) for a, b in zip(("r1", "r2", "r3", "r4"), ("x1", "y1", "x2", "y2"))])
    return got.select(*group, ring.alias("ring"), "seq", "x", "y")


def _leftmost(came: tuple, here: tuple, ways: list) -> int:
    """Index of the way out that turns farthest left."""
    if len(ways) == 1:
        return 0
    back = math.atan2(came[1] - here[1], came[0] - here[0])
    return max(range(len(ways)), key=lambda i: (math.atan2(ways[i][1] - here[1], ways[i][0] - here[0]) - back) % (2 * math.pi))


def _keeps_left(ring: list, start: tuple, ways: list) -> bool:
    """Back at the start: does an unused way out turn farther left than the ring's own first edge?"""
    return _leftmost(ring[-1], start, [*ways, ring[1]]) != len(ways)


def _simple_loops(ring: list) -> list:
    """``(least edge, corners)`` of a ring; a hole that touches itself falls into its simple loops."""
    turn = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))
    loops, path, seen = [], [], {}
    if turn >= 0 or len(set(ring)) == len(ring):
        loops.append(ring)
    else:
        for p in [*ring, ring[0]]:
            if p in seen:
                cut = seen[p]
                loops.append(path[cut:])
                for q in path[cut + 1:]:
                    del seen[q]
                path = path[:cut + 1]
            else:
                seen[p] = len(path)
                path.append(p)
    out = []
    for loop in loops:
        k = min(range(len(loop)), key=lambda i: (*loop[i], *loop[(i + 1) % len(loop)]))
        loop = loop[k:] + loop[:k]
        out.append(((*loop[0], *loop[1]), loop))
    return out


def _double_rings(e: DataFrame, group: list[str], max_rounds: int) -> DataFrame:
    ends = [e.select(*group, F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y"), F.lit(d).alias("d")) for i, d in ((1, 1), (2, -1))]
    # as many edges leave each corner as reach it, or the walk of a small group would find no way on
    odd = ends[0].unionByName(ends[1]).groupBy(*group, "x", "y").agg(F.sum("d").alias("d")).where("d <> 0").select("x", "y").first()
    if odd is not None:
        raise ValueError(f"boundary is open at {tuple(odd)}")
    cyc = _cycles(e, group, True, max_rounds)
    area = cyc.groupBy(*group, "least").agg(F.sum(
        (F.col("id.x1") - F.col("least.x1")) * (F.col("id.y2") - F.col("least.y1"))
        - (F.col("id.x2") - F.col("least.x1")) * (F.col("id.y1") - F.col("least.y1"))).alias("a"))
    holes = cut_lineage(salted_join(cyc, area.where("a < 0").select(*group, "least"), [*group, "least"], ["id"]))
    twice = holes.groupBy(*group, "id.x1", "id.y1").count().where("count > 1")
    if not twice.isEmpty():
        shells = salted_join(cyc, area.where("a >= 0").select(*group, "least"), [*group, "least"], ["id"])
        again = _cycles(holes.select(*group, "id.*"), group, False, max_rounds)
        cyc = cut_lineage(shells.select(*group, "id", "nxt", "least").unionByName(again.select(*group, "id", "nxt", "least")))
    d = cut_lineage(cyc.select(*group, "id", "least", F.when(F.col("nxt") != F.col("least"), F.col("nxt")).alias("nxt")).withColumn(
        "dist", F.when(F.col("nxt").isNotNull(), 1).otherwise(0)))
    for _ in range(max_rounds):
        if d.where("nxt is not null").isEmpty():
            break
        ahead = d.select(*group, F.col("id").alias("nxt"), F.col("nxt").alias("nn"), F.col("dist").alias("nd"))
        d = cut_lineage(d.join(ahead, [*group, "nxt"], "left").select(
            *group, "id", "least", F.col("nn").alias("nxt"), (F.col("dist") + F.coalesce("nd", F.lit(0))).alias("dist")))
    size = d.groupBy(*group, "least").agg(F.max("dist").alias("top"))
    seq = salted_join(d, size, [*group, "least"], ["id"]).withColumn("seq", F.col("top") - F.col("dist"))
    return seq.select(*group, F.col("least").alias("ring"), "seq", F.col("id.x1").alias("x"), F.col("id.y1").alias("y"))


def rings_to_table(rings: DataFrame, group: list[str]) -> DataFrame:
    """One row per ring: ``(group, ring, vertices, signed_area)`` with straight-through corners dropped.

    This is the only step that gathers a ring into one row, because a ring is one value of the result. Areas need no
    gathering, see :func:`ring_areas`.
    """
    from geoloom.functions.geometry import _ring_area2
    by_ring = rings.groupBy(*group, "ring").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("v"))
    n = F.size("v")
    at = lambda i: F.element_at(F.col("v"), F.pmod(i + n, n).cast("int") + 1)
    corner = F.filter(F.col("v"), lambda p, i: F.abs(
        (p["x"] - at(i - 1)["x"]) * (at(i + 1)["y"] - p["y"]) - (p["y"] - at(i - 1)["y"]) * (at(i + 1)["x"] - p["x"])) > 1e-9)
    pts = by_ring.withColumn("p", F.transform(corner, lambda p: F.array(p["x"].cast("double"), p["y"].cast("double"))))
    closed = pts.select(*group, "ring", F.concat(F.col("p"), F.slice("p", 1, 1)).alias("vertices"))
    return closed.withColumn("signed_area", _ring_area2(F.col("vertices")) / 2.0)


def ring_areas(edges: DataFrame, group: list[str]) -> DataFrame:
    """Area per group straight from directed boundary edges (holes run the other way and subtract themselves)."""
    return edges.groupBy(*group).agg(
        (F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2.0).alias("area"))
