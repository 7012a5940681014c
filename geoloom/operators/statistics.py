"""Official statistics: cubes, roll-ups over coded regions, indicator tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.session import cut_lineage


def flatten_cube(cubes: DataFrame, dims: list[str], cube: str = "cube") -> DataFrame:
    """Tidy rows of a parsed statistical cube (:data:`geoloom.types.JSONSTAT`): one column per dimension with its code,
    ``<dim>_label`` where the label differs from the code, and ``value``.

    Cells are exploded first and decoded row by row from their flat position, so a cube spreads over all tasks.
    """
    c = F.col(cube)
    sparse = F.from_json(c["value"], "map<string,double>")
    dense = F.from_json(c["value"], "array<double>")
    is_map = F.ltrim(c["value"]).startswith("{")
    cells = F.when(is_map, F.transform(F.map_entries(sparse), lambda e: F.struct(
        e["key"].cast("long").alias("flat"), e["value"].alias("value")))).otherwise(F.transform(
            dense, lambda v, i: F.struct(i.cast("long").alias("flat"), v.alias("value"))))

    def codes(cat: Column) -> Column:
        text = F.ltrim(cat["index"])
        m = F.from_json(text, "map<string,int>")
        ordered = F.transform(F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(
            e["value"].alias("pos"), e["key"].alias("code")))), lambda s: s["code"])
        return F.when(text.startswith("{"), ordered).otherwise(F.from_json(text, "array<string>"))

    keep = [x for x in cubes.columns if x != cube]
    head = cubes.select(
        *keep, c["size"].alias("_size"), F.filter(cells, lambda s: s["value"].isNotNull()).alias("_cells"),
        *[F.array_position(c["id"], F.lit(d)).cast("int").alias(f"_p{i}") for i, d in enumerate(dims)],
        *[codes(c["dimension"][d]["category"]).alias(f"_c{i}") for i, d in enumerate(dims)],
        *[c["dimension"][d]["category"]["label"].alias(f"_l{i}") for i, d in enumerate(dims)])
    # row-major strides: the product of the later sizes
    for i in range(len(dims)):
        head = head.withColumn(f"_s{i}", F.aggregate(F.slice("_size", F.col(f"_p{i}") + 1, F.size("_size")),
                                                     F.lit(1).cast("long"), lambda a, n: a * n))
        head = head.withColumn(f"_n{i}", F.element_at("_size", F.col(f"_p{i}")))
    rows = head.withColumn("_x", F.explode("_cells"))
    out = rows
    for i, d in enumerate(dims):
        pos = F.floor(F.col("_x.flat") / F.col(f"_s{i}")) % F.col(f"_n{i}")
        out = out.withColumn(d, F.element_at(F.col(f"_c{i}"), pos.cast("int") + 1))
        label = F.try_element_at(F.col(f"_l{i}"), F.col(d))
        out = out.withColumn(f"{d}_label", F.when(label != F.col(d), label))
    return out.select(*keep, *[x for d in dims for x in (d, f"{d}_label")], F.col("_x.value").alias("value"))


def sample_per_key(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One value per key and column (the least, so the choice is stable)."""
    return df.groupBy(key).agg(*[F.min(c).alias(c) for c in columns])


def rollup_by_prefix(df: DataFrame, code: str, amount: str, lengths: tuple = (8, 5, 3, 2, 0)) -> DataFrame:
    """Sums per coded level: ``(level, code, units, total)`` for each prefix length, 0 being everything.

    Unit totals come first; the levels are then grouping sets over those, so no level rereads the data.
    """
    levels = sorted((n for n in lengths), reverse=True)
    unit = df.groupBy(F.col(code).alias("_code")).agg(F.sum(amount).alias("_t"), F.count("*").alias("_k"))
    cut = unit
    for n in levels:
        # NULL where the code is too short for the level, so such units count from their own level upwards only
        cut = cut.withColumn(f"_p{n}", F.when(F.length("_code") >= n, F.substring("_code", 1, n)) if n else F.lit(""))
    cols = [f"_p{n}" for n in levels]
    g = cut.groupingSets([[F.col(c)] for c in cols], *[F.col(c) for c in cols]).agg(
        F.sum("_t").alias("total"), F.sum("_k").alias("units"),
        *[F.grouping(c).alias(f"_g{n}") for c, n in zip(cols, levels)])
    level = F.coalesce(*[F.when(F.col(f"_g{n}") == 0, F.lit(n)) for n in levels])
    value = F.coalesce(*[F.when(F.col(f"_g{n}") == 0, F.col(f"_p{n}")) for n in levels])
    return g.select(level.alias("level"), value.alias("code"), "units", "total").where("code is not null")


def most_recent_nonempty(df: DataFrame, key: str, year: str = "year", value: str = "value",
                         fixed_year: str | None = None) -> DataFrame:
    """Latest non-empty value per key, or the value of one year."""
    d = df.where(F.col(value).isNotNull())
    if fixed_year is not None:
        return d.where(F.col(year) == fixed_year).select(key, year, value)
    return d.groupBy(key).agg(F.max(F.struct(year, value)).alias("b")).select(
        key, F.col(f"b.{year}").alias(year), F.col(f"b.{value}").alias(value))


def newest_release_per_tile(files: DataFrame, name: str = "name", tile: str = r"_(\d{4}-\d{2})_2056_",
                            year: str = r"_3_0_(\d{4})") -> DataFrame:
    """Newest file of each tile id; files without a tile id (national bulk releases) are skipped."""
    t = files.select(F.regexp_extract(name, tile, 1).alias("tile"), F.regexp_extract(name, year, 1).try_cast("int").alias("year"),
                     F.col(name).alias("name")).where("tile <> ''")
    return t.groupBy("tile").agg(F.max(F.struct("year", "name")).alias("b")).select(
        "tile", F.col("b.year").alias("year"), F.col("b.name").alias("name"))


def preview(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"))


def unique_names(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Names made unique: the first row in ``order`` keeps its name, later ones get ``_2``, ``_3`` … after it.

    A new name that some row already has is put off to a further round, in which the separator is one underscore longer.
    Rows are dealt by ranges of (name, order), so a name that very many rows share spans several ranges: rows are ranked
    inside each and shifted by the ranges before. Ranges follow the number of shuffle partitions, so they never grow.
    """
    t = cut_lineage(df.repartitionByRange(name, *order).withColumn("_s", F.spark_partition_id()))
    t = t.withColumn("_i", F.row_number().over(Window.partitionBy(name, "_s").orderBy(*order)))
    sizes = t.groupBy(name, "_s").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy(name).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.withColumn("_b", before).select(F.col(name).alias("_n"), F.col("_s").alias("_t"), "_b")
    t = t.join(shift, F.col(name).eqNullSafe(F.col("_n")) & (F.col("_s") == F.col("_t"))).withColumn("_i", F.col("_i") + F.col("_b"))
    t = cut_lineage(t.select(*df.columns, "_i"))
    done, left = t.where(F.col("_i") == 1), t.where(F.col("_i") > 1)
    given = t.select(F.col(name).alias("_new")).distinct()
    sign = "_"
    while not left.isEmpty():
        new = left.withColumn("_new", F.concat(F.coalesce(F.col(name), F.lit("")), F.lit(sign), F.col("_i").cast("string")))
        free = cut_lineage(new.join(given, "_new", "left_anti"))
        left = cut_lineage(new.join(given, "_new", "left_semi").drop("_new"))
        done = done.unionByName(free.withColumn(name, F.col("_new")).select(*df.columns, "_i"))
        given = given.unionByName(free.select("_new"))
        sign += "_"
    return done.select(*df.columns)


def merge_layers(layers: list[DataFrame]) -> DataFrame:
    """Rows of all layers under the union of their columns."""
    out = layers[0]
    for d in layers[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def within_tile_cap(tiles: DataFrame, max_tiles: int) -> DataFrame:
    """Tiles passed through; the job fails with a clear message when there are more than ``max_tiles``."""
    n = tiles.agg(F.count("*")).scalar()
    return tiles.withColumn("_n", n).where(F.when(F.col("_n") <= max_tiles, F.lit(True)).otherwise(F.raise_error(F.concat(
        F.col("_n").cast("string"), F.lit(f" tiles needed, at most {max_tiles} allowed; narrow the area"))))).drop("_n")
