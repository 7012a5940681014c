"""Attribute joins and reconciliations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.projection import bbox_area_km2
from geoloom.functions.scalars import normalise_key
from geoloom.operators.ranks import exact_median
from geoloom.operators.skew import salted_join


def join_attributes(units: DataFrame, table: DataFrame, key: str, table_key: str | None = None,
                    width: int | None = None) -> DataFrame:
    """Statistics joined onto units; every unit is kept. Keys compare as trimmed, zero-padded text."""
    t = table.withColumn("_k", normalise_key(F.col(table_key or key), width)).drop(table_key or key)
    return units.withColumn("_k", normalise_key(F.col(key), width)).join(t, "_k", "left").drop("_k")


def match_report(units: DataFrame, table: DataFrame, key: str, table_key: str | None = None,
                 width: int | None = None) -> DataFrame:
    """One row: keys on both sides, only in ``units``, only in ``table``. Keys are reduced before they meet."""
    u = units.select(normalise_key(F.col(key), width).alias("k"), F.lit(1).alias("u"))
    t = table.select(normalise_key(F.col(table_key or key), width).alias("k"), F.lit(0).alias("u"))
    sides = u.unionByName(t).where("k is not null").groupBy("k").agg(F.min("u").alias("lo"), F.max("u").alias("hi"))
    return sides.agg(F.count_if(F.col("lo") != F.col("hi")).alias("matched"),
                     F.count_if(F.col("lo") == 1).alias("units_only"), F.count_if(F.col("hi") == 0).alias("table_only"))


def compare_layers(a: DataFrame, b: DataFrame, key: str, field_a: str, field_b: str) -> DataFrame:
    """Two-method comparison on ``key``: row ``key, a, b, diff, rel``.

    ``rel`` is relative to ``b`` and NULL where ``b`` is 0. One row without key on each side match each other; where a side has several of
    them nothing says which belong together, so none is matched (pairing all with all would make their product).
    """
    num = lambda c: F.nullif(F.col(c).try_cast("double"), F.lit(float("nan")))
    left = a.select(F.col(key).alias("_k"), num(field_a).alias("a"))
    right = b.select(F.col(key).alias("_kb"), num(field_b).alias("b"))
    lone = lambda df, k: df.where(F.col(k).isNotNull()).unionByName(
        df.where(F.col(k).isNull()).groupBy(k).agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in df.columns if c != k]).where("n = 1").drop("n"))
    j = lone(left, "_k").join(lone(right, "_kb"), F.col("_k").eqNullSafe(F.col("_kb")))
    diff = F.abs(F.col("a") - F.col("b"))
    return j.select(F.col("_k").alias(key), "a", "b", diff.alias("diff"),
                    (diff / F.nullif(F.abs("b"), F.lit(0.0))).alias("rel"))


def difference_stats(pairs: DataFrame) -> DataFrame:
    stats = pairs.agg(
        F.count("*").alias("matched"), F.count("diff").alias("compared"), F.avg("diff").alias("mean_abs_diff"),
        F.max("diff").alias("max_abs_diff"),
        F.avg("rel").alias("mean_rel_diff"), F.max("rel").alias("max_rel_diff"))
    return stats.select("matched", "compared", "mean_abs_diff", exact_median(pairs, "diff").alias("median_abs_diff"), "max_abs_diff", "mean_rel_diff", "max_rel_diff")


def drop_aggregates(rows: DataFrame, aggregates: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not one of the aggregate groups (World, EU, income classes …)."""
    return rows.join(aggregates.select(key).distinct(), key, "left_anti")


def join_on_prefix(units: DataFrame, scopes: DataFrame, code: str, scope: str,
                   lengths: tuple[int, ...] = (2, 3, 5)) -> DataFrame:
    """Units paired with every scope code that is a prefix of theirs: one equi-join, no range test.

    A scope may hold any share of the units, so the unit side is salted.
    """
    keyed = units.withColumn("_p", F.explode(F.array_distinct(F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(F.col(code))),
        lambda n: F.substring(F.col(code), F.lit(1), n)))))
    return salted_join(keyed, scopes.withColumnRenamed(scope, "_p"), ["_p"], [code]).withColumnRenamed("_p", scope)


def escalate(units: DataFrame, values: DataFrame, code: str, value_code: str,
             lengths: tuple[int, ...] = (5, 3, 2, 0)) -> DataFrame:
    """Narrowest wider scope whose published set holds each unit; NULL scope where none does.

    ``values`` has one row per published scope; the unit itself keeps its granularity, only the scope widens.
    """
    ranked = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(n).alias("n")) for i, n in enumerate(lengths)])
    keyed = units.select(code).distinct().withColumn("_s", F.explode(F.filter(
        ranked, lambda s: s["n"] < F.length(F.col(code))))).select(
        code, F.col("_s.rank").alias("_rank"), F.substring(F.col(code), F.lit(1), F.col("_s.n")).alias("_p"))
    published = values.select(F.col(value_code).alias("_p")).distinct()
    hit = salted_join(keyed, published, ["_p"], [code]).groupBy(code).agg(
        F.min(F.struct("_rank", "_p"))["_p"].alias("scope"))
    return units.join(hit, code, "left")


def inventory_diff(disk: DataFrame, remembered: DataFrame, key: str) -> DataFrame:
    """``added``, ``refreshed`` or ``dropped`` per dataset key."""
    d = disk.select(key).distinct().withColumn("_d", F.lit(True))
    r = remembered.select(key).distinct().withColumn("_r", F.lit(True))
    return d.join(r, key, "full_outer").select(key, F.when(F.col("_r").isNull(), "added").when(
        F.col("_d").isNull(), "dropped").otherwise("refreshed").alias("state"))


def resolve_ttl(datasets: DataFrame, rules: DataFrame, source: str = "source", pinned: str = "pinned_ttl",
                recorded: str | None = None, default_days: int = 30) -> DataFrame:
    """Retention days per dataset: pin, then recorded value, then exact source rule, then longest ``prefix*`` rule.

    Rules are matched once per distinct source, so the work grows with sources, not with datasets. A prefix rule is an
    equi-join on the source cut to each rule length.
    """
    s = datasets.select(F.col(source).alias("_s")).where("_s is not null").distinct()
    exact = rules.where(~F.col("pattern").endswith("*")).select(F.col("pattern").alias("_s"), F.col("days").alias("_exact"))
    pre = rules.where(F.col("pattern").endswith("*")).select(
        F.expr("left(pattern, length(pattern) - 1)").alias("_p"), F.col("days").alias("_d"))
    cut = s.withColumn("_p", F.explode(F.transform(
        F.sequence(F.lit(0), F.length("_s")), lambda n: F.substring(F.col("_s"), F.lit(1), n))))
    family = cut.join(pre, "_p").groupBy("_s").agg(F.max_by("_d", F.length("_p")).alias("_family"))
    days = s.join(exact, "_s", "left").join(family, "_s", "left").select(
        "_s", F.coalesce("_exact", "_family").alias("_rule"))
    order = [F.col(pinned)] + ([F.col(recorded)] if recorded else []) + [F.col("_rule"), F.lit(default_days)]
    return datasets.join(days, F.col(source) == F.col("_s"), "left").withColumn(
        "ttl_days", F.coalesce(*order).cast("int")).drop("_s", "_rule")


def expires(source: Column, last_used: Column, ttl: Column) -> Column:
    """Expiry date; NULL (never) for the user's own data."""
    return F.when(source != "user", F.date_add(last_used, ttl))


def expired_files(datasets: DataFrame, today: Column, path: str = "path") -> DataFrame:
    """Files all of whose layers are past their expiry."""
    gone = F.coalesce(today > expires(F.col("source"), F.col("last_used"), F.col("ttl_days")), F.lit(False))
    return datasets.groupBy(path).agg(F.every(gone).alias("all_gone"), F.count("*").alias("layers")).where(
        "all_gone").select(path, "layers")


def merge_touch(inventory: DataFrame, touches: DataFrame) -> DataFrame:
    """Inventory with use dates, notes and pins merged in.

    ``touches(target, day, note, ttl_days)`` names ``path`` (all its layers) or ``path::layer``. Touches are reduced
    to one row per target before the join.
    """
    t = touches.groupBy("target").agg(
        F.max("day").alias("_day"), F.max_by("note", F.when(F.col("note").isNotNull(), F.col("day"))).alias("_note"),
        F.max_by("ttl_days", F.when(F.col("ttl_days").isNotNull(), F.col("day"))).alias("_ttl"))
    by_file = t.select(F.col("target").alias("path"), F.col("_day").alias("_d1"), F.col("_note").alias("_n1"),
                       F.col("_ttl").alias("_t1"))
    by_layer = t.select(F.col("target").alias("_key"), F.col("_day").alias("_d2"), F.col("_note").alias("_n2"),
                        F.col("_ttl").alias("_t2"))
    inv = inventory.withColumn("_key", F.concat_ws("::", "path", "layer"))
    out = inv.join(by_file, "path", "left").join(by_layer, "_key", "left")
    cols = [c for c in inventory.columns if c not in ("last_used", "note", "pinned_ttl")]
    old = lambda c: F.col(c) if c in inventory.columns else F.lit(None)
    return out.select(*cols, F.greatest("last_used", "_d1", "_d2").alias("last_used"),
                      F.coalesce("_n2", "_n1", old("note")).alias("note"),
                      F.coalesce("_t2", "_t1", old("pinned_ttl")).alias("pinned_ttl"))


def match_dataset(wanted: DataFrame, datasets: DataFrame) -> DataFrame:
    """Dataset key for each wanted name: exact key, then whole path, then base name; smallest key on ties.

    Three equi-joins on the same name instead of one OR-join; all datasets are first reduced to one key per name, and each
    name is asked once. Spark's size estimates don't count exploded rows, so both joins are asked to shuffle: neither side
    is bounded, and a broadcast would pass it through the driver.
    """
    d = datasets.select("path", F.concat_ws("::", "path", "layer").alias("key"))
    names = d.select(F.col("key").alias("n"), F.lit(0).alias("rank"), "key").unionByName(
        d.select(F.col("path").alias("n"), F.lit(1).alias("rank"), "key")).unionByName(
        d.select(F.substring_index("path", "/", -1).alias("n"), F.lit(2).alias("rank"), "key"))
    best = names.groupBy("n", "rank").agg(F.min("key").alias("key"))
    asked = wanted.select("name").distinct().select("name", F.explode(F.array(
        F.struct(F.col("name").alias("n"), F.lit(0).alias("rank")),
        F.struct(F.col("name").alias("n"), F.lit(1).alias("rank")),
        F.struct(F.substring_index("name", "/", -1).alias("n"), F.lit(2).alias("rank")))).alias("a")).select(
        "name", F.col("a.n").alias("n"), F.col("a.rank").alias("rank"))
    hit = asked.join(best.hint("merge"), ["n", "rank"]).groupBy("name").agg(F.min(F.struct("rank", "key")).alias("b"))
    return wanted.join(hit.hint("merge"), "name", "left").select(*wanted.columns, F.col("b.key").alias("dataset"))


def match_gazetteer(names: DataFrame, places: DataFrame, top: int = 5) -> DataFrame:
    """Best place per name (by importance, then id), how many places share the name, an ``ambiguous`` flag, and ``options``.

    ``places(place_id, name, importance[, bbox])``, the box of the places as a struct in degrees where there is one.
    ``options`` holds the first ``top`` places of the name, best first, as ``(place_id, name, importance, bbox, area_km2)``; it
    is empty where none matches. ``candidates`` counts all of them. Places are ranked per name before the join, so a name
    asked for many times carries one row, and a name shared by very many places never gathers them in one task: Spark
    keeps the first ``top`` of a name per partition before they meet.
    """
    norm = lambda c: F.lower(F.trim(F.regexp_replace(F.col(c), r"\s+", " ")))
    box = F.col("bbox") if "bbox" in places.columns else F.lit(None)
    box = box.cast("struct<xmin: double, ymin: double, xmax: double, ymax: double>")
    area = bbox_area_km2(*[box[c] for c in ("xmin", "ymin", "xmax", "ymax")])
    p = places.select(norm("name").alias("_n"), F.struct("place_id", "name", "importance", box.alias("bbox"), area.alias("area_km2")).alias("o"))
    order = Window.partitionBy("_n").orderBy(F.col("o.importance").desc_nulls_last(), "o.place_id")
    first = p.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top)
    options = first.groupBy("_n").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "o"))), lambda x: x["o"]).alias("options"))
    best = p.groupBy("_n").agg(
        F.count("*").alias("candidates"),
        F.max(F.struct(F.col("o.importance").alias("importance"), (-F.col("o.place_id")).alias("neg"))).alias("b"))
    none = F.array().cast(options.schema["options"].dataType)
    return names.withColumn("_n", norm("name")).join(best.join(options, "_n", "left"), "_n", "left").select(
        *names.columns, (-F.col("b.neg")).alias("place_id"), F.col("b.importance").alias("importance"),
        F.coalesce("candidates", F.lit(0)).alias("candidates"), (F.coalesce("candidates", F.lit(0)) > 1).alias("ambiguous"),
        F.coalesce("options", none).alias("options"))


def overlap_share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def select_tiles(index: DataFrame, window: tuple, url_field: str) -> DataFrame:
    """URLs of tile-index rows whose box meets the window (boxes are plain columns, so the scan prunes)."""
    w, s, e, n = (float(v) for v in window)
    return index.where((F.col("xmax") >= w) & (F.col("xmin") <= e) & (F.col("ymax") >= s) & (F.col("ymin") <= n)
                       & F.col(url_field).isNotNull() & (F.col(url_field) != "")).select(F.col(url_field).alias("url"))


def url_shares(index: DataFrame, columns: list[str]) -> DataFrame:
    """Per text column: share of values that look like URLs and like point-cloud archives; one pass for all columns."""
    share = lambda c, pattern: F.avg(F.col(c).rlike(pattern).cast("double"))
    stats = index.agg(*[x for c in columns for x in (
        share(c, r"(?i)https?://").alias(f"{c}__url"), share(c, r"(?i)\.(?:la[sz]|zip)\b").alias(f"{c}__laz"))])
    return stats.select(F.explode(F.array(*[F.struct(
        F.lit(i).alias("pos"), F.lit(c).alias("column"), F.col(f"{c}__url").alias("url_share"),
        F.col(f"{c}__laz").alias("archive_share")) for i, c in enumerate(columns)])).alias("s")).select("s.*")


def find_url_field(index: DataFrame, columns: list[str]) -> DataFrame:
    """First column with mostly URLs and at least some point-cloud archives, as one row (none if there is none)."""
    ok = url_shares(index, columns).where("url_share > 0.5 and archive_share > 0.3")
    return ok.agg(F.min_by("column", "pos").alias("column")).where("column is not null")
