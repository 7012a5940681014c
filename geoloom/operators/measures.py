"""Layer facts, attribute profiles, plausibility and class breaks: aggregates over one layer."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.operators.joins import compare_layers, difference_stats
from geoloom.operators.ranks import exact_median, exact_quantiles

# ---- fixed values -------------------------------------------------------------------------------------------

PLACEHOLDER_TEXT = ("", "null", "none", "nan", "n/a", "#n/a")
STRICT_PLACEHOLDER_TEXT = ("null", "none", "nan", "n/a", "#n/a")
PLACEHOLDER_NUMBERS = (-9999.0, -99999.0)

# magnitude -> (least, greatest, unit)
BANDS = {
    "building_height": (1.0, 200.0, "m"),
    "building_area": (4.0, 200_000.0, "m2"),
    "population": (0.0, 40_000_000.0, "count"),
    "population_density": (0.0, 50_000.0, "per_km2"),
    "slope": (0.0, 90.0, "degree"),
    "elevation": (-500.0, 9_000.0, "m"),
    "area_m2": (0.0, 1e12, "m2"),
    "length_m": (0.0, 1e8, "m"),
}

# stored measure columns, in the order they are looked for
AREA_COLUMNS = ("area", "area_m2", "area_sqm", "shape_area", "st_area", "flaeche", "fläche")
LENGTH_COLUMNS = ("length", "length_m", "shape_leng", "shape_length", "st_length", "laenge", "länge", "len",
                  "perimeter")

AREA_CONSISTENCY_TOLERANCE = 0.10

# -------------------------------------------------------------------------------------------------------------


def number(c: Column) -> Column:
    """Text or number as double; what does not parse, and NaN, gives NULL."""
    v = c.try_cast("double")
    return F.when(~F.isnan(v), v)


def measure(df: DataFrame, what: str, geom: str = "geom", by: list[str] | None = None) -> DataFrame:
    """``sum, count, mean, min, max`` of a numeric field or of ``$area`` / ``$length`` / ``$perimeter``.

    Areas and lengths need metres: the first geometry in degrees or without a reference system fails the job.
    """
    from geoloom.operators.filters import require_metric
    key = what.strip().lower()
    df = require_metric(df, geom) if key in ("$area", "$length", "$perimeter") else df
    v = {"$area": lambda: G.area(F.col(geom)), "$length": lambda: G.length(F.col(geom)),
         "$perimeter": lambda: G.length(F.col(geom))}.get(key, lambda: number(F.col(f"`{what}`")))()
    g = df.withColumn("_v", v).groupBy(*(by or []))
    return g.agg(F.coalesce(F.sum("_v"), F.lit(0.0)).alias("sum"), F.count("_v").alias("count"),
                 F.avg("_v").alias("mean"), F.min("_v").alias("min"), F.max("_v").alias("max"))


def layer_facts(df: DataFrame, geom: str = "geom") -> DataFrame:
    """Feature count, geometry kinds, bounds, populated columns and broken-geometry counts in one aggregate."""
    g = F.col(geom)
    d = df.withColumn("_b", G.bbox(g))
    attrs = [c for c in df.columns if c != geom]
    filled = [F.max(_populated(F.col(f"`{c}`"))).alias(f"f{i}") for i, c in enumerate(attrs)]
    a = d.agg(
        F.count("*").alias("feature_count"), F.array_sort(F.collect_set(g["kind"])).alias("geometry_types"),
        F.array_sort(F.collect_set(g["srid"])).alias("srids"),
        F.min("_b.xmin").alias("xmin"), F.min("_b.ymin").alias("ymin"), F.max("_b.xmax").alias("xmax"),
        F.max("_b.ymax").alias("ymax"), F.count_if(g.isNull()).alias("geom_null"),
        F.count_if(G.is_empty(g)).alias("geom_empty"),
        F.count_if(~F.coalesce(G.is_valid(g), F.lit(True))).alias("geom_invalid"), *filled)
    names = F.filter(F.array(*[F.when(F.col(f"f{i}"), F.lit(c)) for i, c in enumerate(attrs)]), lambda x: x.isNotNull())
    return a.withColumn("columns", names).withColumn("columns_total", F.lit(len(attrs))).withColumn(
        "columns_empty", F.lit(len(attrs)) - F.size("columns")).drop(*[f"f{i}" for i in range(len(attrs))])


def _populated(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")) != "", F.lit(False))


def populated_columns(df: DataFrame, geom: str = "geom") -> DataFrame:
    """One row per attribute column: does it hold any non-null, non-blank value."""
    attrs = [c for c in df.columns if c != geom]
    a = df.agg(*[F.max(_populated(F.col(f"`{c}`"))).alias(f"f{i}") for i, c in enumerate(attrs)])
    return a.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"f{i}"), F.lit(False)).alias("populated"))
                                        for i, c in enumerate(attrs)])).alias("s")).select("s.*")


def is_placeholder(c: Column, texts=PLACEHOLDER_TEXT, numbers=PLACEHOLDER_NUMBERS) -> Column:
    t = F.lower(F.trim(c.cast("string")))
    hit = t.isin(*texts)
    if numbers:
        hit = hit | F.coalesce(number(c).isin(*numbers), F.lit(False))
    return c.isNotNull() & hit


def attribute_profile(df: DataFrame, required: tuple = (), ranges: dict | None = None, texts=PLACEHOLDER_TEXT,
                      numbers=PLACEHOLDER_NUMBERS, geom: str = "geom") -> DataFrame:
    """Per field: null, placeholder, populated and out-of-range counts, all-placeholder and missing-required flags.

    One aggregate over the table, turned to rows afterwards, so a wide layer is read once and nothing is unpivoted.
    Real missing values are NULL or a floating NaN.
    """
    ranges = ranges or {}
    types = dict(df.dtypes)
    fields = [c for c in df.columns if c != geom]

    def one(c: str) -> Column:
        col = F.col(f"`{c}`")
        absent = col.isNull() | (F.isnan(col) if types[c] in ("double", "float") else F.lit(False))
        seen = F.when(~absent, col)
        out = F.lit(0).cast("long")
        if c in ranges:
            v = number(seen)
            out = F.count_if((v < ranges[c][0]) | (v > ranges[c][1]))
        return F.struct(F.lit(c).alias("field"), F.count_if(absent).alias("null"),
                        F.count_if(is_placeholder(seen, texts, numbers)).alias("placeholder"),
                        F.count(seen).alias("populated"), out.alias("out_of_range"))

    present = df.agg(F.array(*[one(c) for c in fields]).alias("a")).select(F.explode("a").alias("s")).select("s.*")
    absent = [c for c in required if c not in fields]
    if absent:
        none = F.lit(0).cast("long")
        extra = df.agg(F.array(*[F.struct(F.lit(c).alias("field"), none.alias("null"), none.alias("placeholder"),
                                          none.alias("populated"), none.alias("out_of_range")) for c in absent]).alias("a"))
        present = present.unionByName(extra.select(F.explode("a").alias("s")).select("s.*"))
    all_ph = (F.col("populated") > 0) & (F.col("placeholder") >= F.col("populated"))
    return present.withColumn("all_placeholder", all_ph).withColumn(
        "missing_required", F.col("field").isin(*required) & ((F.col("populated") == 0) | F.col("all_placeholder"))
        if required else F.lit(False))


def column_values(df: DataFrame, column: str, order: str, limit: int = 50) -> DataFrame:
    """Distinct values in first-seen order (``order`` gives the layer order) with total and a truncation flag."""
    v = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(
        F.min(order).alias("first_seen"))
    total = v.agg(F.count("*").alias("n")).scalar()
    return v.orderBy("first_seen", "value").limit(limit).withColumn("distinct", total).withColumn(
        "truncated", F.col("distinct") > limit)


def plausibility(df: DataFrame, column: str, magnitude: str) -> DataFrame:
    """How many values fall outside the band of a magnitude; values that are no numbers are not counted."""
    lo, hi, unit = BANDS[magnitude]
    v = number(F.col(column))
    return df.agg(
        F.lit(magnitude).alias("magnitude"), F.lit(unit).alias("unit"), F.lit(lo).alias("min"), F.lit(hi).alias("max"),
        F.count(v).alias("checked"), F.count_if(v < lo).alias("below"), F.count_if(v > hi).alias("above"),
        F.count_if((v < lo) | (v > hi)).alias("out_of_band"))


def stored_measure_column(columns: list[str]) -> tuple[str, str] | None:
    """``(kind, column)`` of the stored area or length column, area first, in the listed order."""
    lower = {c.lower(): c for c in columns}
    for kind, names in (("area", AREA_COLUMNS), ("length", LENGTH_COLUMNS)):
        for n in names:
            if n in lower:
                return kind, lower[n]
    return None


def area_length_consistency(df: DataFrame, geom: str = "geom") -> DataFrame | None:
    """Median relative gap between a stored area/length column and the geometry; None without such a column.

    Features in degrees or without a reference system are not compared.
    """
    found = stored_measure_column([c for c in df.columns if c != geom])
    if found is None:
        return None
    kind, column = found
    g = F.col(geom)
    from geoloom.operators.filters import is_geographic
    metric = df.where(g["srid"].isNotNull() & ~is_geographic(g["srid"]))
    both = metric.select(number(F.col(f"`{column}`")).alias("s"), (G.area(g) if kind == "area" else G.length(g)).alias("c"))
    both = both.where("s is not null and c > 0")
    middle = exact_median(both, F.abs(F.col("s") - F.col("c")) / F.col("c"))
    return both.agg(F.lit(kind).alias("kind"), F.lit(column).alias("column"), F.count("*").alias("n")).select(
        "kind", "column", middle.alias("median_rel_diff"), "n")


def relative_gap(value: Column, expected: Column) -> Column:
    dev = F.abs(value - expected)
    return F.when(expected == 0, F.lit(float("inf"))).otherwise(dev / F.nullif(F.abs(expected), F.lit(0.0)))


def cross_check_aggregate(df: DataFrame, what: str, expected_total: float, tolerance: float = 0.05) -> DataFrame:
    m = measure(df, what)
    rel = relative_gap(F.col("sum"), F.lit(float(expected_total)))
    return m.select(F.col("sum"), F.lit(float(expected_total)).alias("expected_total"),
                    F.abs(F.col("sum") - expected_total).alias("deviation"), rel.alias("relative"),
                    F.col("count").alias("n"), (rel <= tolerance).alias("ok"))


def cross_check_value(df: DataFrame, value: str, expected: str, tolerance: float = 0.05) -> DataFrame:
    rel = relative_gap(F.col(value), F.col(expected))
    return df.withColumn("deviation", F.abs(F.col(value) - F.col(expected))).withColumn("relative", rel).withColumn(
        "ok", rel <= tolerance)


def cross_check_two_method(a: DataFrame, b: DataFrame, key: str, field_a: str, field_b: str,
                           tolerance: float = 0.05) -> DataFrame:
    s = difference_stats(compare_layers(a, b, key, field_a, field_b))
    return s.withColumn("ok", (F.col("compared") > 0) & F.coalesce(F.col("mean_rel_diff") <= tolerance, F.lit(False)))


def height_summary(df: DataFrame, column: str = "measured_height") -> DataFrame:
    v = number(F.col(column))
    return df.agg(F.count("*").alias("buildings"), F.count(v).alias("with_height"), F.round(F.min(v), 2).alias("min"),
                  F.round(F.max(v), 2).alias("max"), F.round(F.avg(v), 2).alias("mean")).withColumn("median", F.round(exact_median(df, v), 2))


def gini(df: DataFrame, column: str) -> DataFrame:
    """Gini coefficient of the non-negative values.

    Equal values share a rank block, so the data is reduced to (value, count) first. Block positions come from
    per-range totals plus a running sum inside each range: no window without partitions, however many values there are.
    """
    v = df.select(number(F.col(column)).alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("k"))
    ranged = with_running_total(v, "v", "k")
    # the ranks of a block of k equal values ending at cumulative count c sum to k*c - k*(k-1)/2
    s = ranged.agg(F.sum("k").alias("n"), F.sum(F.col("v") * F.col("k")).alias("total"),
                   F.sum(F.col("v") * (F.col("k") * F.col("cum") - F.col("k") * (F.col("k") - 1) / 2)).alias("w"))
    return s.select("n", (2.0 * F.col("w") / (F.col("n") * F.col("total")) - (F.col("n") + 1) / F.col("n")).alias("gini"))


def with_running_total(df: DataFrame, order: str, amount: str, buckets: int = 256) -> DataFrame:
    """``df`` with ``cum``, the running total of ``amount`` over distinct, ordered values of ``order``.

    Values are cut into ranges at approximate quantiles; each range is summed in its own task and shifted by the total
    of the ranges before it (at most ``buckets`` + 1 numbers, held in an array).
    """
    cuts = df.agg(F.array_distinct(F.percentile_approx(
        order, F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), 10_000))).scalar()
    cut = df.withColumn("_cuts", cuts)
    with_range = cut.withColumn("_r", F.size(F.filter("_cuts", lambda c: c < F.col(order)))).drop("_cuts")
    totals = with_range.groupBy("_r").agg(F.sum(amount).alias("t"))
    # at most `buckets` + 1 rows by construction
    shift = totals.withColumn("_before", F.coalesce(F.sum("t").over(
        Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_r", "_before")
    inside = F.sum(amount).over(Window.partitionBy("_r").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return with_range.withColumn("_in", inside).join(F.broadcast(shift), "_r").withColumn(
        "cum", F.col("_in") + F.col("_before")).drop("_r", "_in", "_before")


def streets_affected(df: DataFrame, above: float, height: str = "height", street: str = "street") -> DataFrame:
    return df.where(F.col(height) > above).groupBy(street).agg(
        F.count("*").alias("buildings"), F.max(height).alias("tallest"))


def duplicate_geometries(df: DataFrame, geom: str = "geom") -> DataFrame:
    """Repeats beyond the first, by exact coordinates: 256 bits of hash stand for the geometry, so only they are shuffled."""
    g = df.where(F.col(geom).isNotNull()).groupBy(F.col(geom)["kind"].alias("kind"), F.unhex(F.sha2(F.to_json(geom), 256)).alias("_j")).agg(
        F.count("*").alias("n"))
    return g.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.coalesce(F.sum("n"), F.lit(0)).alias("features"))


def geometry_type_counts(df: DataFrame, geom: str = "geom") -> DataFrame:
    return df.where(F.col(geom).isNotNull()).groupBy(F.col(geom)["kind"].alias("kind")).agg(F.count("*").alias("n"))


def lost_geometry_types(before: DataFrame, after: DataFrame, geom: str = "geom") -> DataFrame:
    """Kinds present before and absent after; nothing when the input has one kind or the output brings a new one."""
    b, a = geometry_type_counts(before, geom), geometry_type_counts(after, geom)
    kinds_before = b.agg(F.collect_set("kind")).scalar()
    kinds_after = a.agg(F.collect_set("kind")).scalar()
    speak = (F.size(kinds_before) > 1) & (F.size(F.array_except(kinds_after, kinds_before)) == 0)
    return b.join(a.select("kind"), "kind", "left_anti").where(speak)


def explode_parts(df: DataFrame, geom: str = "geom") -> DataFrame:
    return df.withColumn(geom, F.explode(G.parts(F.col(geom))))


def promote_multi(df: DataFrame, geom: str = "geom") -> dict[str, DataFrame]:
    """One DataFrame per geometry kind (the struct already holds multi-part geometries)."""
    return {k: df.where(F.col(geom)["kind"] == k) for k in ("POINT", "LINE", "POLYGON")}


# ---------------------------------------------------------------- class breaks

def class_breaks(df: DataFrame, column: str, scheme: str = "Quantiles", k: int = 5) -> DataFrame:
    """One row ``k, breaks`` (upper bounds, ascending); ``k`` is clamped to the number of distinct values."""
    v = df.select(number(F.col(column)).alias("v")).where("v is not null")
    d = v.agg(F.count_distinct("v").alias("d"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    use = F.greatest(F.lit(1), F.least(F.lit(k), F.col("d").cast("int")))
    if scheme == "EqualInterval":
        return d.select(use.alias("k"), F.transform(F.sequence(F.lit(1), use), lambda i: F.when(i == use, F.col("hi")).otherwise(
            F.col("lo") + (F.col("hi") - F.col("lo")) * i / use)).alias("breaks"))
    if scheme == "Quantiles":
        # all candidate class counts share one search: k is small
        fr = {n: [i / n for i in range(1, n + 1)] for n in range(1, k + 1)}
        flat = sorted({f for fs in fr.values() for f in fs})
        q = d.withColumn("q", exact_quantiles(v, "v", flat).select("quantiles").scalar())
        pick = reduce(lambda acc, n: acc.when(use == n, F.array(*[F.get(F.col("q"), flat.index(f)) for f in fr[n]])),
                      range(2, k + 1), F.when(use == 1, F.array(F.get(F.col("q"), flat.index(1.0)))))
        return q.select(use.alias("k"), pick.alias("breaks"))
    if scheme == "NaturalBreaks":
        return natural_breaks(v, k)
    raise ValueError("scheme must be Quantiles, EqualInterval or NaturalBreaks")


BINS = 4096


def natural_breaks(values: DataFrame, k: int, n_bins: int = BINS) -> DataFrame:
    """Least-squares class breaks over ``n_bins`` bins of equal width, each of which stands for the mean of its values.

    The same at every size: values closer than a bin's width may share a class, values farther apart are told apart.
    """
    counted = values.groupBy("v").agg(F.count("*").alias("w"))
    stats = counted.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"))).scalar()
    bin_no = F.least(F.floor((F.col("v") - stats["lo"]) / F.nullif(stats["hi"] - stats["lo"], F.lit(0.0)) * n_bins), F.lit(n_bins - 1))
    bins = counted.groupBy(F.coalesce(bin_no, F.lit(0)).alias("bin")).agg(
        F.sum("w").alias("w"), (F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("m"), F.max("v").alias("hi"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np
        pdf = pdf.sort_values("m")
        m, w, hi = (pdf[c].to_numpy(float) for c in ("m", "w", "hi"))
        n, kk = len(m), max(1, min(k, len(m)))
        if n == 0:
            return pd.DataFrame({"k": [], "breaks": []})
        base = m.mean()
        sw, s1, s2 = (np.concatenate([[0.0], np.cumsum(x)]) for x in (w, w * (m - base), w * (m - base) ** 2))
        cost = s2[1:] - s1[1:] ** 2 / sw[1:]                     # one class for bins 0..j
        back = []
        for _ in range(1, kk):
            nxt, arg = np.full(n, np.inf), np.zeros(n, int)
            for j in range(1, n):
                i = np.arange(1, j + 1)                          # last class is bins i..j
                dw, d1, d2 = sw[j + 1] - sw[i], s1[j + 1] - s1[i], s2[j + 1] - s2[i]
                c = cost[i - 1] + d2 - d1 ** 2 / dw
                arg[j] = i[c.argmin()]
                nxt[j] = c.min()
            nxt[0] = np.inf
            cost = nxt
            back.append(arg)
        ends, j = [n - 1], n - 1
        for arg in reversed(back):
            j = arg[j] - 1
            ends.append(j)
        return pd.DataFrame({"k": [kk], "breaks": [[float(hi[e]) for e in reversed(ends)]]})

    # at most n_bins rows reach the single group
    return bins.groupBy(F.lit(1).alias("one")).applyInPandas(lambda pdf: solve(pdf), "k int, breaks array<double>")


def classify(df: DataFrame, column: str, breaks: DataFrame, name: str = "class") -> DataFrame:
    """Class index 0..k-1 of each value: the first break that is not below it."""
    b = breaks.select("breaks").scalar()
    v = number(F.col(column))
    t = df.withColumn("_b", b)
    return t.withColumn(name, F.when(v.isNotNull(), F.least(F.size(F.filter("_b", lambda x: x < v)), F.size("_b") - 1))).drop("_b")
