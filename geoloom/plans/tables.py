"""Layer facts, statistics, inventory, catalogue and telemetry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import scalars as X
from geoloom.operators import catalog as K
from geoloom.operators import joins as J
from geoloom.operators import measures as M
from geoloom.operators import quality as Q
from geoloom.operators import statistics as ST
from geoloom.operators import telemetry as TL
from geoloom.operators import filters as FI
from geoloom.plans.registry import query
from geoloom.plans.views import footprint_layer, home_layer, site_layer, street_layer, view, zone_layer

r = lambda n, *cols: [F.round(c, n).alias(c) for c in cols]

# ---------------------------------------------------------------- measures and facts


@query("measure", """SELECT 'area' AS what, CAST(sum(side * side) AS DOUBLE) AS sum, count(*) AS count, round(avg(side * side), 6) AS mean, CAST(min(side * side) AS DOUBLE) AS min, CAST(max(side * side) AS DOUBLE) AS max FROM footprints
UNION ALL SELECT 'perimeter', CAST(sum(side * 4) AS DOUBLE), count(*), round(avg(side * 4), 6), CAST(min(side * 4) AS DOUBLE), CAST(max(side * 4) AS DOUBLE) FROM footprints
UNION ALL SELECT 'side', CAST(sum(side) AS DOUBLE), count(*), round(avg(side), 6), CAST(min(side) AS DOUBLE), CAST(max(side) AS DOUBLE) FROM footprints
UNION ALL SELECT 'text', 0.0, 0, NULL, NULL, NULL""")
def measure(spark, sf):
    f = footprint_layer(spark, sf)
    out = None
    for what, field in (("area", "$area"), ("perimeter", "$perimeter"), ("side", "side"), ("text", "street")):
        m = M.measure(f, field).select(F.lit(what).alias("what"), "sum", "count", *r(6, "mean"), "min", "max")
        out = m if out is None else out.unionByName(m)
    return out


@query("layer_facts", """SELECT count(*) AS feature_count, 'POLYGON' AS kinds, CAST(min(x0) AS DOUBLE) AS xmin, CAST(min(y0) AS DOUBLE) AS ymin,
 CAST(max(x0 + side) AS DOUBLE) AS xmax, CAST(max(y0 + side) AS DOUBLE) AS ymax, 0 AS geom_null, 0 AS geom_empty, 0 AS geom_invalid,
 'bldg_id,side,height,street,use,x0,y0' AS cols, 8 AS columns_total, 1 AS columns_empty FROM footprints""")
def layer_facts(spark, sf):
    f = footprint_layer(spark, sf).withColumn("blank", F.lit("  "))
    a = M.layer_facts(f)
    return a.select("feature_count", F.array_join("geometry_types", ",").alias("kinds"), "xmin", "ymin", "xmax", "ymax",
                    "geom_null", "geom_empty", "geom_invalid", F.array_join("columns", ",").alias("cols"), "columns_total", "columns_empty")


@query("populated_columns", """SELECT 'text' AS "column", true AS populated UNION ALL SELECT 'doc_id', true UNION ALL SELECT 'lang', true
 UNION ALL SELECT 'source', bool_or(trim(source) <> '') FROM documents UNION ALL SELECT 'n_chars', true UNION ALL SELECT 'blank', false UNION ALL SELECT 'none', false""")
def populated_columns(spark, sf):
    d = view(spark, sf, "documents").withColumn("blank", F.lit(" ")).withColumn("none", F.lit(None).cast("string"))
    return M.populated_columns(d)


@query("attribute_profile", """WITH t AS (SELECT CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN -9999.0 ELSE l_quantity END AS h,
  CASE WHEN l_linenumber = 3 THEN ' NULL ' WHEN l_linenumber = 4 THEN NULL WHEN l_linenumber = 5 THEN '' ELSE l_returnflag END AS name, '#N/A' AS bad FROM lineitem)
SELECT 'h' AS field, count(*) FILTER (WHERE h IS NULL) AS "null", count(*) FILTER (WHERE h = -9999) AS placeholder, count(h) AS populated,
  count(*) FILTER (WHERE h < 0 OR h > 40) AS out_of_range, false AS all_placeholder, false AS missing_required FROM t
UNION ALL SELECT 'name', count(*) FILTER (WHERE name IS NULL), count(*) FILTER (WHERE lower(trim(name)) IN ('', 'null')), count(name), 0, false, false FROM t
UNION ALL SELECT 'bad', 0, count(*), count(*), 0, true, true FROM t UNION ALL SELECT 'gone', 0, 0, 0, 0, false, true""")
def attribute_profile(spark, sf):
    n = F.col("l_linenumber")
    t = view(spark, sf, "lineitem").select(
        F.when(n == 2, -9999.0).when(n != 1, F.col("l_quantity")).alias("h"),
        F.when(n == 3, " NULL ").when(n == 5, "").when(n != 4, F.col("l_returnflag")).alias("name"), F.lit("#N/A").alias("bad"))
    return M.attribute_profile(t, required=("h", "bad", "gone"), ranges={"h": (0, 40)})


@query("column_values", """WITH v AS (SELECT p_type AS value, min(p_partkey) AS first_seen FROM part GROUP BY p_type)
SELECT value, first_seen, (SELECT count(*) FROM v) AS "distinct", (SELECT count(*) FROM v) > 5 AS truncated FROM v ORDER BY first_seen LIMIT 5""")
def column_values(spark, sf):
    return M.column_values(view(spark, sf, "part"), "p_type", "p_partkey", 5)


@query("plausibility", """SELECT 'building_height' AS magnitude, 'm' AS unit, 1.0::DOUBLE AS min, 200.0::DOUBLE AS max, count(*) AS checked, count(*) FILTER (WHERE l_extendedprice / 100 < 1) AS below,
 count(*) FILTER (WHERE l_extendedprice / 100 > 200) AS above, count(*) FILTER (WHERE l_extendedprice / 100 NOT BETWEEN 1 AND 200) AS out_of_band FROM lineitem""")
def plausibility(spark, sf):
    t = view(spark, sf, "lineitem").select((F.col("l_extendedprice") / 100).alias("h"))
    return M.plausibility(t, "h", "building_height")


_TWO = """a AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders GROUP BY o_custkey), b AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer),
d AS (SELECT a.k, abs(a.v - b.v) AS diff, abs(a.v - b.v) / nullif(abs(b.v), 0) AS rel FROM a JOIN b ON a.k = b.k)"""


def _two(spark, sf):
    a = view(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    return a, view(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))


@query("difference_stats", f"""WITH {_TWO} SELECT count(*) AS matched, count(diff) AS compared, round(avg(diff), 4) AS mean_abs_diff, round(median(diff), 4) AS median_abs_diff,
 round(max(diff), 4) AS max_abs_diff, round(avg(rel), 4) AS mean_rel_diff, round(max(rel), 4) AS max_rel_diff FROM d""")
def difference_stats(spark, sf):
    a, b = _two(spark, sf)
    s = J.difference_stats(J.compare_layers(a, b, "k", "v", "v"))
    return s.select("matched", "compared", *r(4, *[c for c in s.columns if c.endswith("diff")]))


@query("cross_check", f"""WITH {_TWO}, s AS (SELECT CAST(sum(side * side) AS DOUBLE) AS t FROM footprints)
SELECT 'two_method' AS mode, round(avg(rel), 4) AS relative, count(*) > 0 AND avg(rel) <= 0.05 AS ok FROM d
UNION ALL SELECT 'aggregate', round(abs(t - 2000000.0) / 2000000.0, 6), abs(t - 2000000.0) / 2000000.0 <= 0.05 FROM s""")
def cross_check(spark, sf):
    a, b = _two(spark, sf)
    two = M.cross_check_two_method(a, b, "k", "v", "v").select(
        F.lit("two_method").alias("mode"), F.round("mean_rel_diff", 4).alias("relative"), "ok")
    agg = M.cross_check_aggregate(footprint_layer(spark, sf), "$area", 2_000_000.0)
    return two.unionByName(agg.select(F.lit("aggregate").alias("mode"), F.round("relative", 6).alias("relative"), "ok"))


@query("area_consistency", """SELECT 'area' AS kind, 'area_m2' AS "column", round(median(abs(side * side + bldg_id % 7 - side * side) / CAST(side * side AS DOUBLE)), 8) AS median_rel_diff,
 count(*) AS n FROM footprints""")
def area_consistency(spark, sf):
    f = footprint_layer(spark, sf).withColumn("area_m2", F.col("side") * F.col("side") + F.col("bldg_id") % 7)
    return M.area_length_consistency(f).withColumn("median_rel_diff", F.round("median_rel_diff", 8))


@query("height_summary", """SELECT count(*) AS buildings, count(h) AS with_height, round(min(h), 2) AS min, round(max(h), 2) AS max, round(avg(h), 2) AS mean, round(median(h), 2) AS median
FROM (SELECT CASE WHEN side > 5 THEN height END AS h FROM footprints)""")
def height_summary(spark, sf):
    f = view(spark, sf, "footprints").select(F.when(F.col("side") > 5, F.col("height")).alias("measured_height"))
    return M.height_summary(f)


@query("gini", """WITH o AS (SELECT p_retailprice AS v, row_number() OVER (ORDER BY p_retailprice) AS i, count(*) OVER () AS n FROM part)
SELECT max(n) AS n, round(2 * sum(i * v) / (max(n) * sum(v)) - (max(n) + 1.0) / max(n), 6) AS gini FROM o""")
def gini(spark, sf):
    return M.gini(view(spark, sf, "part"), "p_retailprice").withColumn("gini", F.round("gini", 6))


@query("streets_affected", "SELECT street, count(*) AS buildings, max(height) AS tallest FROM footprints WHERE height > 12 GROUP BY street")
def streets_affected(spark, sf):
    return M.streets_affected(view(spark, sf, "footprints"), 12)


@query("duplicate_geometries", """WITH g AS (SELECT p_size, p_brand, count(*) AS n FROM part GROUP BY p_size, p_brand)
SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates, CAST(sum(n) AS BIGINT) AS features FROM g""")
def duplicate_geometries(spark, sf):
    from geoloom.functions import geometry as G
    f = view(spark, sf, "footprints").withColumn("b", F.substring_index("street", "#", -1).cast("int"))
    return M.duplicate_geometries(f.select(G.box(F.col("b"), 0, F.col("b") + F.col("side"), 1, 25832).alias("geom")))


@query("geometry_types", """SELECT 'POINT' AS kind, count(*) AS n, false AS lost FROM supplier UNION ALL SELECT 'POLYGON', count(*), true FROM part""")
def geometry_types(spark, sf):
    before = site_layer(spark, sf).select("geom").unionByName(footprint_layer(spark, sf).select("geom"))
    lost = M.lost_geometry_types(before, before.where("geom.kind = 'POINT'"))
    return M.geometry_type_counts(before).join(lost.select("kind", F.lit(True).alias("lost")), "kind", "left").select(
        "kind", "n", F.coalesce("lost", F.lit(False)).alias("lost"))


@query("class_breaks", """WITH q AS (SELECT quantile_cont(p_retailprice, [0.2, 0.4, 0.6, 0.8, 1.0]) AS b, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part),
c AS (SELECT p_partkey, len(list_filter(b, lambda x: x < p_retailprice)) AS quantile, least(4, CASE WHEN p_retailprice <= lo + (hi - lo) * 1 / 5 THEN 0 WHEN p_retailprice <= lo + (hi - lo) * 2 / 5 THEN 1
  WHEN p_retailprice <= lo + (hi - lo) * 3 / 5 THEN 2 WHEN p_retailprice <= lo + (hi - lo) * 4 / 5 THEN 3 ELSE 4 END) AS equal_interval FROM part, q)
SELECT quantile, equal_interval, count(*) AS n FROM c GROUP BY ALL""")
def class_breaks(spark, sf):
    p = view(spark, sf, "part").select("p_partkey", "p_retailprice")
    c = M.classify(p, "p_retailprice", M.class_breaks(p, "p_retailprice", "Quantiles", 5), "quantile")
    c = M.classify(c, "p_retailprice", M.class_breaks(p, "p_retailprice", "EqualInterval", 5), "equal_interval")
    return c.groupBy(F.col("quantile").cast("long").alias("quantile"), "equal_interval").agg(F.count("*").alias("n"))


# classes of bins i..j cost the squares around their mean; each step adds the last class
_BREAK_STEP = "d{k} AS (SELECT c.j, min(d.cost + c.cost) AS cost, arg_min(list_append(d.ends, c.j), d.cost + c.cost) AS ends FROM d{p} d JOIN c ON c.i = d.j + 1 GROUP BY c.j)"


@query("natural_breaks", """WITH v AS (SELECT CAST(p_retailprice AS DOUBLE) AS v, count(*) AS w FROM part GROUP BY 1), s AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
b AS (SELECT least(floor((v - lo) / (hi - lo) * 4096), 4095) AS bin, sum(w) AS w, sum(v * w) / sum(w) AS m, max(v) AS hi FROM v, s GROUP BY 1),
n AS (SELECT row_number() OVER (ORDER BY bin) AS j, hi, sum(w) OVER o AS sw, sum(w * (m - z)) OVER o AS s1, sum(w * (m - z) * (m - z)) OVER o AS s2
  FROM b, (SELECT avg(m) AS z FROM b) WINDOW o AS (ORDER BY bin)),
f AS (SELECT j, sw, s1, s2 FROM n UNION ALL SELECT 0, 0, 0, 0),
c AS (SELECT f.j + 1 AS i, n.j, n.s2 - f.s2 - (n.s1 - f.s1) * (n.s1 - f.s1) / (n.sw - f.sw) AS cost FROM n JOIN f ON f.j < n.j),
d1 AS (SELECT j, cost, [j] AS ends FROM c WHERE i = 1), """ + ", ".join(_BREAK_STEP.format(k=k, p=k - 1) for k in range(2, 6)) + """,
e AS (SELECT unnest(ends) AS j, generate_subscripts(ends, 1) AS class FROM d5 WHERE j = (SELECT max(j) FROM n))
SELECT CAST(class AS INTEGER) AS class, n.hi AS upper FROM e JOIN n ON n.j = e.j""")
def natural_breaks(spark, sf):
    p = view(spark, sf, "part").select("p_retailprice")
    b = M.class_breaks(p, "p_retailprice", "NaturalBreaks", 5)
    return b.select(F.posexplode("breaks").alias("class", "upper")).select((F.col("class") + 1).alias("class"), "upper")


@query("sanity_check", """SELECT 'too_many' AS code, CAST(NULL AS VARCHAR) AS field, CAST(count(*) AS VARCHAR) AS value FROM part UNION ALL SELECT 'other_kind', NULL, 'POLYGON'
UNION ALL SELECT 'out_of_range', 'height', CAST(count(*) AS VARCHAR) FROM footprints WHERE height < 0 OR height > 12
UNION ALL SELECT 'missing_field', 'owner', NULL UNION ALL SELECT 'implausible_building_area', 'side', CAST(count(*) AS VARCHAR) FROM footprints WHERE side < 4""")
def sanity_check(spark, sf):
    return Q.sanity_check(footprint_layer(spark, sf), max_features=10, geometry="line", required=("owner",), ranges={"height": (0, 12)},
                          magnitude_field="side", magnitude="building_area")


@query("quality_gate", """SELECT 'stale' AS layer, 3 AS level, 'advisory' AS severity, 'stored_measure' AS code, 'area 100' AS value
UNION ALL SELECT 'sentinel', 1, 'hard', 'sentinel_column', unnest(['s1', 's2', 's3', 's4', 'status']) UNION ALL SELECT 'loose', 1, 'hard', 'no_srid', NULL
UNION ALL SELECT 'loose', 1, 'hard', 'null_shape', CAST(count(*) AS VARCHAR) FROM footprints WHERE side <= 5
UNION ALL SELECT 'single', 1, 'advisory', 'other_area', 'Landshut' FROM (SELECT min(bldg_id) FROM footprints)""")
def quality_gate(spark, sf):
    f = footprint_layer(spark, sf)
    g = F.col("geom")
    layers = {
        "good": f.drop("side"),
        "stale": f.withColumn("area", F.col("side") * F.col("side") * 2),
        "sentinel": f.withColumns({c: F.lit(" NULL ") for c in ("status", "s1", "s2", "s3", "s4")}),
        "loose": f.withColumn("geom", F.when(F.col("side") > 5, g.withField("srid", F.lit(None).cast("int")))),
        "single": f.groupBy(F.lit("Landshut").alias("place")).agg(F.min_by("geom", "bldg_id").alias("geom"))}
    return Q.quality_gate(layers, 3, files={"single": "out/passau_outline.gpkg"}, name_column="place")


# ---------------------------------------------------------------- joins and statistics


@query("join_attributes", """SELECT n_nationkey AS unit, n_name AS name, s.balance FROM nation LEFT JOIN (SELECT s_nationkey, round(sum(s_acctbal), 2) AS balance FROM supplier
 GROUP BY s_nationkey) s ON s_nationkey = n_nationkey""")
def join_attributes(spark, sf):
    u = view(spark, sf, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("ags"), F.col("n_nationkey").alias("unit"),
                                         F.col("n_name").alias("name"))
    t = view(spark, sf, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("key")).agg(F.round(F.sum("s_acctbal"), 2).alias("balance"))
    return J.join_attributes(u, t, "ags", "key", width=5).select("unit", "name", "balance")


@query("match_report", """WITH u AS (SELECT DISTINCT o_custkey AS k FROM orders), t AS (SELECT c_custkey + 100 AS k FROM customer)
SELECT count(*) FILTER (WHERE u.k IS NOT NULL AND t.k IS NOT NULL) AS matched, count(*) FILTER (WHERE t.k IS NULL) AS units_only,
 count(*) FILTER (WHERE u.k IS NULL) AS table_only FROM u FULL JOIN t ON u.k = t.k""")
def match_report(spark, sf):
    u = view(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    t = view(spark, sf, "customer").select((F.col("c_custkey") + 100).alias("k"))
    return J.match_report(u, t, "k")


_CODE = """lpad(CAST(c_nationkey % 5 + 1 AS VARCHAR), 2, '0') || CAST(c_nationkey % 3 AS VARCHAR) || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0')"""


def _coded(spark, sf):
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    p = lambda c, w: F.lpad(c.cast("string"), w, "0")
    return view(spark, sf, "customer").select(
        "c_custkey", F.concat(p(n % 5 + 1, 2), p(n % 3, 1), p(n, 2), p(k % 1000, 3)).alias("ags"),
        F.col("c_acctbal"), (F.col("c_acctbal") * 100).cast("decimal(18,0)").cast("long").alias("cents"))


@query("rollup_by_prefix", f"""WITH t AS (SELECT {_CODE} AS ags, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer)
SELECT n AS level, left(ags, n) AS code, count(*) AS units, CAST(sum(cents) AS BIGINT) AS total FROM t, (VALUES (8), (5), (3), (2), (0)) l(n) GROUP BY n, left(ags, n)""")
def rollup_by_prefix(spark, sf):
    return ST.rollup_by_prefix(_coded(spark, sf), "ags", "cents")


@query("join_on_prefix", f"""WITH t AS (SELECT c_custkey, {_CODE} AS ags FROM customer), s AS (SELECT DISTINCT left(ags, 3) AS scope FROM t UNION SELECT DISTINCT left(ags, 2) FROM t WHERE left(ags, 2) < '04')
SELECT c_custkey, scope FROM t JOIN s ON starts_with(ags, scope)""")
def join_on_prefix(spark, sf):
    t = _coded(spark, sf)
    s = t.select(F.substring("ags", 1, 3).alias("scope")).unionByName(
        t.select(F.substring("ags", 1, 2).alias("scope")).where("scope < '04'")).distinct()
    return J.join_on_prefix(t.select("c_custkey", "ags"), s, "ags", "scope").select("c_custkey", "scope")


@query("escalate", f"""WITH t AS (SELECT c_custkey, {_CODE} AS ags FROM customer), v AS (SELECT DISTINCT left(ags, 5) AS p FROM t WHERE substr(ags, 3, 1) = '1'
  UNION SELECT DISTINCT left(ags, 2) FROM t WHERE left(ags, 2) = '02')
SELECT c_custkey, CASE WHEN left(ags, 5) IN (SELECT p FROM v) THEN left(ags, 5) WHEN left(ags, 2) IN (SELECT p FROM v) THEN left(ags, 2) END AS scope FROM t""")
def escalate(spark, sf):
    t = _coded(spark, sf)
    v = t.where("substring(ags, 3, 1) = '1'").select(F.substring("ags", 1, 5).alias("p")).unionByName(
        t.where("substring(ags, 1, 2) = '02'").select(F.substring("ags", 1, 2).alias("p")))
    return J.escalate(t.select("c_custkey", "ags"), v, "ags", "p").select("c_custkey", "scope")


@query("region_hierarchy", f"""WITH t AS (SELECT DISTINCT {_CODE} AS code FROM customer)
SELECT code, 'ags' AS key, 'Gemeinde' AS level, left(code, 5) || '/' || left(code, 3) || '/' || left(code, 2) || '/' AS chain,
 'Kreis/Regierungsbezirk/Land/Bund' AS scopes FROM t UNION ALL SELECT 'DE' || r_regionkey || '1', 'nuts', 'NUTS2 (Regierungsbezirk)', 'DE' || r_regionkey || '/DE',
 'NUTS1 (Bundesland)/country (NUTS0)' FROM region UNION ALL SELECT r_name, CASE WHEN length(r_name) = 4 THEN 'nuts' END, CASE WHEN length(r_name) = 4 THEN 'NUTS2 (Regierungsbezirk)' END, CASE WHEN length(r_name) = 4 THEN left(r_name, 3) || '/' || left(r_name, 2) END,
 CASE WHEN length(r_name) = 4 THEN 'NUTS1 (Bundesland)/country (NUTS0)' END FROM region""")
def region_hierarchy(spark, sf):
    reg = view(spark, sf, "region")
    codes = _coded(spark, sf).select(F.col("ags").alias("code")).distinct().unionByName(
        reg.select(F.concat(F.lit("DE"), F.col("r_regionkey").cast("string"), F.lit("1")).alias("code"))).unionByName(
        reg.select(F.col("r_name").alias("code")))
    h = codes.withColumn("h", X.region_hierarchy(F.col("code")))
    return h.select("code", "h.key", "h.level", F.array_join("h.escalation.code", "/").alias("chain"), F.array_join("h.escalation.scope", "/").alias("scopes"))


@query("drop_aggregates", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')")
def drop_aggregates(spark, sf):
    n = view(spark, sf, "nation").withColumnRenamed("n_regionkey", "k")
    return J.drop_aggregates(n, view(spark, sf, "region").where("r_name like 'A%'").select(F.col("r_regionkey").alias("k")), "k").select("n_nationkey", "n_name")


@query("most_recent_nonempty", """WITH t AS (SELECT o_custkey AS iso3, CAST(year(o_orderdate) AS VARCHAR) AS year, max(CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END) AS value FROM orders GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY iso3 ORDER BY year DESC) AS rn FROM t WHERE value IS NOT NULL) SELECT iso3, year, value FROM q WHERE rn = 1""")
def most_recent_nonempty(spark, sf):
    t = view(spark, sf, "orders").groupBy(F.col("o_custkey").alias("iso3"), F.year("o_orderdate").cast("string").alias("year")).agg(
        F.max(F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice"))).alias("value"))
    return ST.most_recent_nonempty(t, "iso3")


@query("sample_per_key", "SELECT c_nationkey AS ags, min(c_name) AS name, min(c_acctbal) AS population FROM customer GROUP BY c_nationkey")
def sample_per_key(spark, sf):
    c = view(spark, sf, "customer").select(F.col("c_nationkey").alias("ags"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("population"))
    return ST.sample_per_key(c, "ags", ["name", "population"])


@query("flatten_cube", """SELECT vec_id, 'r' || (pos // 8) AS geo, CASE WHEN pos // 8 > 0 THEN 'row ' || (pos // 8) END AS geo_label, 'c' || (pos % 8) AS time, CAST(NULL AS VARCHAR) AS time_label,
 CAST(round(CAST(v AS DOUBLE) * 1000) AS DOUBLE) AS value FROM embedding_values WHERE NOT (vec_id % 2 = 0 AND pos % 3 = 0)""")
def flatten_cube(spark, sf):
    from geoloom.types import JSONSTAT
    # even ids carry a sparse value map, odd ids a dense list
    val = F.transform("embedding", lambda v: F.round(v.cast("double") * 1000))
    ent = F.transform(val, lambda v, i: F.struct(i.cast("string").alias("key"), v.alias("value")))
    sparse = F.map_from_entries(F.filter(ent, lambda e: e["key"].cast("int") % 3 != 0))
    idx = lambda p: ", ".join(f'"{p}{i}": {i}' for i in range(8))
    lab = ", ".join(f'"r{i}": "{"row " + str(i) if i else "r0"}"' for i in range(8))
    dims = F.lit(f'"id": ["geo", "time"], "size": [8, 8], "dimension": {{"geo": {{"category": {{"index": {{{idx("r")}}}, "label": {{{lab}}}}}}}, "time": {{"category": {{"index": {{{idx("c")}}}}}}}}}')
    text = F.concat(F.lit("{"), dims, F.lit(', "value": '), F.when(F.col("vec_id") % 2 == 0, F.to_json(sparse)).otherwise(F.to_json(val)), F.lit("}"))
    c = view(spark, sf, "embeddings").select("vec_id", F.from_json(text, JSONSTAT).alias("cube"))
    return ST.flatten_cube(c, ["geo", "time"])


@query("newest_release", """WITH f AS (SELECT 'x_3_0_' || (2015 + o_orderkey % 9) || CASE WHEN o_custkey % 4 = 0 THEN '_national.zip' ELSE '_' || lpad(CAST(o_custkey % 700 AS VARCHAR), 4, '0') || '-' || lpad(CAST(o_orderkey % 3 AS VARCHAR), 2, '0') || '_2056_5728.gdb.zip' END AS name FROM orders),
t AS (SELECT regexp_extract(name, '_(\\d{4}-\\d{2})_2056_', 1) AS tile, CAST(regexp_extract(name, '_3_0_(\\d{4})', 1) AS INT) AS year, name FROM f)
SELECT tile, max(year) AS year, max(name) AS name FROM t WHERE tile <> '' AND (tile, year) IN (SELECT (tile, max(year)) FROM t GROUP BY tile) GROUP BY tile""")
def newest_release(spark, sf):
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    s = lambda c: c.cast("string")
    name = F.concat(F.lit("x_3_0_"), s(2015 + o % 9), F.when(k % 4 == 0, "_national.zip").otherwise(F.concat(
        F.lit("_"), F.lpad(s(k % 700), 4, "0"), F.lit("-"), F.lpad(s(o % 3), 2, "0"), F.lit("_2056_5728.gdb.zip"))))
    return ST.newest_release_per_tile(view(spark, sf, "orders").select(name.alias("name")))


@query("merge_layers", """SELECT 'home' AS layer, home_id AS id, segment, CAST(NULL AS DOUBLE) AS height FROM homes UNION ALL SELECT 'building', bldg_id, NULL, height FROM footprints""")
def merge_layers(spark, sf):
    h = view(spark, sf, "homes").select(F.lit("home").alias("layer"), F.col("home_id").alias("id"), "segment")
    b = view(spark, sf, "footprints").select(F.lit("building").alias("layer"), F.col("bldg_id").alias("id"), "height")
    return ST.merge_layers([h, b])


@query("preview", """(SELECT 'row' AS part, o_orderkey AS a, o_custkey AS b FROM orders ORDER BY o_orderkey LIMIT 5) UNION ALL SELECT 'shape', count(*), 6 FROM orders""")
def preview(spark, sf):
    o = view(spark, sf, "orders")
    p = ST.preview(o, ["o_orderkey"]).select(F.lit("row").alias("part"), F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b"))
    return p.unionByName(ST.shape(o).select(F.lit("shape").alias("part"), F.col("rows").alias("a"), F.col("columns").cast("long").alias("b")))


# ---------------------------------------------------------------- inventory

TODAY = "2001-09-01"
RULES = (("connector/osm", 20), ("connector/*", 40), ("connector/stac*", 900), ("con*", 5))


def _inv(spark, sf):
    rules = spark.createDataFrame(list(RULES), "pattern string, days int")
    return J.resolve_ttl(view(spark, sf, "inventory"), rules)


TTL = "coalesce(pinned_ttl, CASE source WHEN 'connector/osm' THEN 20 WHEN 'connector/gtfs' THEN 40 WHEN 'connector/stac-cog' THEN 900 ELSE 30 END)"


@query("resolve_ttl", f"SELECT ds_id, source, {TTL} AS ttl_days FROM inventory")
def resolve_ttl(spark, sf):
    return _inv(spark, sf).select("ds_id", "source", "ttl_days")


@query("expiry", f"""WITH i AS (SELECT path, source, last_used + CAST({TTL} AS INTEGER) AS ends FROM inventory)
SELECT path, count(*) AS layers FROM i GROUP BY path HAVING bool_and(source <> 'user' AND DATE '{TODAY}' > ends)""")
def expiry(spark, sf):
    return J.expired_files(_inv(spark, sf), F.to_date(F.lit(TODAY)))


@query("inventory_diff", """WITH d AS (SELECT DISTINCT o_custkey AS k FROM orders), m AS (SELECT c_custkey + 100 AS k FROM customer)
SELECT coalesce(d.k, m.k) AS k, CASE WHEN m.k IS NULL THEN 'added' WHEN d.k IS NULL THEN 'dropped' ELSE 'refreshed' END AS state FROM d FULL JOIN m ON d.k = m.k""")
def inventory_diff(spark, sf):
    return J.inventory_diff(view(spark, sf, "orders").select(F.col("o_custkey").alias("k")),
                            view(spark, sf, "customer").select((F.col("c_custkey") + 100).alias("k")), "k")


@query("merge_touch", """WITH t AS (SELECT 'dir' || (c_custkey % 50) || '/file' || c_custkey || '.gpkg' AS path, DATE '1998-01-01' + CAST(c_custkey % 900 AS INTEGER) AS day FROM customer),
u AS (SELECT concat(path, '::', layer) AS k, DATE '1999-06-01' AS day FROM inventory WHERE source = 'local')
SELECT i.ds_id, strftime(greatest(i.last_used, t.day, u.day), '%Y-%m-%d') AS last_used, CASE WHEN u.day IS NOT NULL THEN 'kept' WHEN t.day IS NOT NULL THEN 'seen' END AS note
FROM inventory i LEFT JOIN t ON t.path = i.path LEFT JOIN u ON u.k = concat(i.path, '::', i.layer)""")
def merge_touch(spark, sf):
    i = view(spark, sf, "inventory")
    c, s = F.col("c_custkey"), lambda x: x.cast("string")
    t = view(spark, sf, "customer").select(
        F.concat(F.lit("dir"), s(c % 50), F.lit("/file"), s(c), F.lit(".gpkg")).alias("target"),
        F.date_add(F.lit("1998-01-01").cast("date"), (c % 900).cast("int")).alias("day"), F.lit("seen").alias("note"), F.lit(None).cast("int").alias("ttl_days"))
    u = i.where("source = 'local'").select(F.concat_ws("::", "path", "layer").alias("target"), F.lit("1999-06-01").cast("date").alias("day"),
                                           F.lit("kept").alias("note"), F.lit(None).cast("int").alias("ttl_days"))
    m = J.merge_touch(i, t.unionByName(u))
    return m.select("ds_id", F.date_format("last_used", "yyyy-MM-dd").alias("last_used"), "note")


@query("match_dataset", """WITH d AS (SELECT path, concat(path, '::', layer) AS k FROM inventory), w AS (SELECT 'other/file' || c_custkey || '.gpkg' AS name FROM customer
 UNION ALL SELECT path FROM d UNION ALL SELECT k FROM d)
SELECT w.name, CASE WHEN w.name IN (SELECT k FROM d) THEN w.name ELSE (SELECT min(k) FROM d WHERE d.path = w.name OR regexp_extract(d.path, '[^/]+$') = regexp_extract(w.name, '[^/]+$')) END AS dataset FROM w""")
def match_dataset(spark, sf):
    i = view(spark, sf, "inventory")
    w = view(spark, sf, "customer").select(F.concat(F.lit("other/file"), F.col("c_custkey").cast("string"), F.lit(".gpkg")).alias("name")).unionByName(
        i.select(F.col("path").alias("name"))).unionByName(i.select(F.concat_ws("::", "path", "layer").alias("name")))
    return J.match_dataset(w, i).select("name", "dataset")


@query("recent_datasets", "SELECT ds_id, path, strftime(last_used, '%Y-%m-%d') AS last_used FROM inventory ORDER BY inventory.last_used DESC, ds_id LIMIT 12")
def recent_datasets(spark, sf):
    return K.recent_first(view(spark, sf, "inventory")).select("ds_id", "path", F.date_format("last_used", "yyyy-MM-dd").alias("last_used"))


@query("formats", f"""SELECT ds_id, CASE WHEN size_bytes < 1024 THEN size_bytes || ' B' WHEN size_bytes < 1048576 THEN printf('%.1f KB', size_bytes / 1024.0) ELSE printf('%.1f MB', size_bytes / 1048576.0) END AS size,
 datediff('day', last_used, DATE '{TODAY}') AS age, CASE WHEN size_bytes % 4000 / 7.3 < 90 THEN printf('%.0fs', size_bytes % 4000 / 7.3) ELSE printf('%.1fmin', size_bytes % 4000 / 7.3 / 60.0) END AS took FROM inventory""")
def formats(spark, sf):
    i = view(spark, sf, "inventory")
    return i.select("ds_id", X.human_size(F.col("size_bytes")).alias("size"), F.datediff(F.lit(TODAY), "last_used").cast("long").alias("age"),
                    X.fmt_duration(F.col("size_bytes") % 4000 / 7.3).alias("took"))


# ---------------------------------------------------------------- catalogue


@query("keyword_search", """WITH s AS (SELECT doc_id, CASE WHEN contains(lower(text), 'that') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'zwischen') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'pour') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'der') THEN 1 ELSE 0 END AS score,
 contains(lower(text), 'that zwischen pour der') AS phrase FROM documents)
SELECT doc_id, score, phrase FROM s WHERE score > 0 AND score = (SELECT max(score) FROM s) ORDER BY phrase DESC, doc_id LIMIT 25""")
def keyword_search(spark, sf):
    d = K.tiered_search(view(spark, sf, "documents").select("doc_id", "text"), "That zwischen pour der", ["text"], "doc_id", ["text"])
    return d.select("doc_id", F.col("score").cast("int").alias("score"), "phrase")


@query("substring_search", "SELECT page_id, url FROM pages WHERE (contains(lower(url), 'page=2') OR contains(lower(html), 'page=2')) AND NOT contains(url, '/en/') ORDER BY page_id LIMIT 15")
def substring_search(spark, sf):
    p = view(spark, sf, "pages")
    return K.substring_search(p, "PAGE=2", ["url", "html"], "page_id", 15, p["url"].contains("/en/")).select("page_id", "url")


@query("rank_candidates", """WITH c AS (SELECT doc_id, lang IN ('de', 'fr') AS is_geo FROM documents) SELECT doc_id, is_geo FROM c ORDER BY is_geo DESC, doc_id LIMIT 20""")
def rank_candidates(spark, sf):
    d = view(spark, sf, "documents").select("doc_id", F.array(F.when(F.col("lang").isin("de", "fr"), "WFS").otherwise("CSV")).alias("kinds"))
    return K.rank_candidates(d, "kinds", "doc_id", 20).select("doc_id", "is_geo")


_EXT = "lower(regexp_extract(regexp_extract(regexp_replace(regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '[^/]*$'), '.(\\.[^.]*)$', 1))"
_RES = """SELECT page_id, url || CASE page_id % 6 WHEN 0 THEN CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'SERVICE=WFS&REQUEST=GetFeature&TYPENAME=a%3Ab' || page_id WHEN 1 THEN '&service=wms' WHEN 2 THEN '' ELSE '' END AS u0,
 CASE page_id % 6 WHEN 3 THEN '.geojson' WHEN 4 THEN '.csv' ELSE '' END AS ext, CASE page_id % 3 WHEN 0 THEN 'CSV' WHEN 1 THEN 'Shapefile (zip)' ELSE 'pdf' END AS fmt FROM pages"""


def _resources(spark, sf):
    i = F.col("page_id")
    tail = F.when(i % 6 == 0, F.concat(F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("SERVICE=WFS&REQUEST=GetFeature&TYPENAME=a%3Ab"), i.cast("string"))).when(
        i % 6 == 1, "&service=wms").otherwise("")
    u = F.concat(F.col("url"), tail)
    u = F.when(i % 6 == 3, F.concat(F.regexp_replace(u, r"\?.*$", ""), F.lit(".geojson"))).when(
        i % 6 == 4, F.concat(F.regexp_replace(u, r"\?.*$", ""), F.lit(".csv"))).otherwise(u)
    fmt = F.when(i % 3 == 0, "CSV").when(i % 3 == 1, "Shapefile (zip)").otherwise("pdf")
    return view(spark, sf, "pages").select("page_id", u.alias("u"), fmt.alias("fmt"))


_RESU = f"r AS (SELECT page_id, CASE WHEN ext <> '' THEN regexp_replace(u0, '\\?.*$', '') || ext ELSE u0 END AS u, fmt FROM ({_RES})), e AS (SELECT *, {_EXT} AS ext FROM r)"


@query("classify_resources", f"""WITH {_RESU} SELECT page_id, CASE WHEN contains(lower(u), 'service=wfs') THEN 'WFS' WHEN contains(lower(u), 'service=wms') THEN 'WMS'
 WHEN ext IN ('.geojson', '.json') THEN 'GeoJSON' WHEN ext = '.gml' THEN 'GML' WHEN ext IN ('.zip', '.shp') THEN 'Shapefile' WHEN ext = '.gpkg' THEN 'GeoPackage' WHEN ext = '.kml' THEN 'KML' WHEN ext = '.csv' THEN 'CSV'
 WHEN fmt LIKE 'Shape%' THEN 'Shapefile' ELSE fmt END AS service,
 CASE WHEN ext = '.json' THEN '.geojson' WHEN ext IN ('.geojson', '.gml', '.zip', '.gpkg', '.kml', '.gpx') THEN ext WHEN contains(lower(fmt), 'zip') THEN '.zip' ELSE '.geojson' END AS suffix FROM e""")
def classify_resources(spark, sf):
    x = _resources(spark, sf)
    return x.select("page_id", X.classify_resource(F.col("u"), F.col("fmt")).alias("service"), X.vector_suffix(F.col("u"), F.col("fmt")).alias("suffix"))


@query("wfs_split", f"""WITH {_RESU}, q AS (SELECT page_id, regexp_replace(u, '[?#].*$', '') AS b, list_filter(string_split(regexp_extract(u, '\\?([^#]*)', 1), '&'), lambda x: x <> '') AS ps, u FROM e WHERE contains(u, 'SERVICE=WFS')),
k AS (SELECT *, list_filter(ps, lambda x: lower(split_part(x, '=', 1)) NOT IN ('service', 'request', 'typename')) AS keep FROM q)
SELECT page_id, CASE WHEN len(keep) > 0 THEN b || '?' || array_to_string(keep, '&') ELSE b END AS base, 'a:b' || page_id AS typename FROM k""")
def wfs_split(spark, sf):
    x = _resources(spark, sf).where(F.col("u").contains("SERVICE=WFS")).withColumn("w", X.wfs_split(F.col("u")))
    return x.select("page_id", "w.base", "w.typename")


@query("absent_claims", """WITH a AS (SELECT conv_id, turn, text || ' saved to /tmp/out_' || (conv_id % 300) || '.gpkg and map_' || turn || '.html, see https://x.org/data.tif' AS t FROM conversations),
c AS (SELECT DISTINCT conv_id, turn, 'out_' || (conv_id % 300) || '.gpkg' AS name FROM a UNION SELECT conv_id, turn, 'map_' || turn || '.html' FROM a)
SELECT conv_id, turn, name FROM c WHERE name NOT IN (SELECT 'out_' || s_suppkey || '.gpkg' FROM supplier)""")
def absent_claims(spark, sf):
    c = view(spark, sf, "conversations")
    s = lambda x: x.cast("string")
    t = c.select(F.struct("conv_id", "turn").alias("k"), F.concat(
        F.col("text"), F.lit(" saved to /tmp/out_"), s(F.col("conv_id") % 300), F.lit(".gpkg and map_"), s(F.col("turn")), F.lit(".html, see https://x.org/data.tif")).alias("t"))
    files = view(spark, sf, "supplier").select(F.concat(F.lit("ws/out_"), s(F.col("s_suppkey")), F.lit(".gpkg")).alias("f"))
    return K.absent_claims(t, files, "k", "t", "f").select("k.conv_id", "k.turn", "name")


@query("mentioned", """SELECT page_id, contains(html, 'the') OR contains(html, 'abc.tif') AS long_stem, contains(html, 'the.x') AS short_stem FROM (SELECT page_id, replace(html, 'thx', '') AS html FROM pages)
""".replace("contains(html, 'the') OR contains(html, 'abc.tif')", "contains(html, 'article') "))
def mentioned(spark, sf):
    h = view(spark, sf, "pages").select("page_id", F.replace("html", F.lit("thx"), F.lit("")).alias("html"))
    return h.select("page_id", X.mentioned(F.lit("ws/article.gpkg"), F.col("html")).alias("long_stem"),
                    X.mentioned(F.lit("ws/the.x"), F.col("html")).alias("short_stem"))


@query("area_identity", """WITH t AS (SELECT p_partkey, 'ws/' || replace(p_name, ' ', '_') || '_boundary.gpkg' AS path, p_type AS name, p_name FROM part),
k AS (SELECT *, list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: length(x) >= 4) AS a, list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda x: length(x) >= 4) AS b FROM t)
SELECT p_partkey, len(a) > 0 AND len(b) > 0 AND NOT list_has_any(a, b) AS conflict FROM k""")
def area_identity(spark, sf):
    p = view(spark, sf, "part")
    path = F.concat(F.lit("ws/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_boundary.gpkg"))
    return p.select("p_partkey", X.area_identity_conflict(path, F.col("p_type")).alias("conflict"))


@query("acquisition_years", """WITH n AS (SELECT o_custkey, 'dop_32_' || o_orderkey || '_1_nw_' || (CASE WHEN o_orderkey % 5 = 0 THEN 1800 ELSE 2000 END + o_orderkey % 23) || '.jp2' AS name FROM orders),
y AS (SELECT o_custkey, y FROM n LEFT JOIN LATERAL (SELECT unnest(regexp_extract_all(name, '_((?:19|20)\\d{2})[._]', 1)) AS y) ON true)
SELECT o_custkey, string_agg(DISTINCT y, ',' ORDER BY y) AS years FROM y GROUP BY o_custkey""")
def acquisition_years(spark, sf):
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    name = F.concat(F.lit("dop_32_"), s(k), F.lit("_1_nw_"), s(F.when(k % 5 == 0, 1800).otherwise(2000) + k % 23), F.lit(".jp2"))
    # names are reduced to distinct years per tile first, so a group holds a few years, never all its names
    n = view(spark, sf, "orders").select("o_custkey", F.explode_outer(X.acquisition_years(F.array(name))).alias("y"))
    y = n.groupBy("o_custkey").agg(F.array_sort(F.collect_set("y")).alias("y"))
    return y.select("o_custkey", F.nullif(F.array_join("y", ","), F.lit("")).alias("years"))


@query("epsg_codes", """WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'urn:adv:crs:ETRS89_UTM32*DE' WHEN 1 THEN 'EPSG::25833' WHEN 2 THEN 'http://www.opengis.net/def/crs/EPSG/0/' || (2000 + p_size) ELSE p_name END AS s, p_size FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 25832 WHEN 1 THEN 25833 WHEN 2 THEN 2000 + p_size END AS epsg FROM t""")
def epsg_codes(spark, sf):
    k = F.col("p_partkey") % 4
    s = F.when(k == 0, "urn:adv:crs:ETRS89_UTM32*DE").when(k == 1, "EPSG::25833").when(
        k == 2, F.concat(F.lit("http://www.opengis.net/def/crs/EPSG/0/"), (F.col("p_size") + 2000).cast("string"))).otherwise(F.col("p_name"))
    return view(spark, sf, "part").select("p_partkey", X.epsg_from_srs(s).alias("epsg"))


@query("select_tiles", """SELECT 'https://tiles.example.org/t' || site_id || '.laz' AS url FROM sites WHERE x - 500 <= 510000 AND x + 500 >= 503000 AND y - 500 <= 5409000 AND y + 500 >= 5402000""")
def select_tiles(spark, sf):
    s = view(spark, sf, "sites")
    t = s.select((F.col("x") - 500).alias("xmin"), (F.col("y") - 500).alias("ymin"), (F.col("x") + 500).alias("xmax"), (F.col("y") + 500).alias("ymax"),
                 F.concat(F.lit("https://tiles.example.org/t"), F.col("site_id").cast("string"), F.lit(".laz")).alias("link"))
    return J.select_tiles(t, (503000, 5402000, 510000, 5409000), "link")


@query("find_url_field", """SELECT 'link' AS "column" """)
def find_url_field(spark, sf):
    p = view(spark, sf, "pages").select("html", "url", F.concat("url", F.lit("/a.laz")).alias("link"))
    return J.find_url_field(p, ["html", "url", "link"])


@query("match_gazetteer", """WITH p AS (SELECT p_partkey AS id, p_name AS name, p_retailprice AS imp FROM part), b AS (SELECT name, count(*) AS n, first(id ORDER BY imp DESC, id) AS id, max(imp) AS imp, array_to_string(list(id ORDER BY imp DESC, id)[:5], '/') AS options,
  round(CAST(list(imp ORDER BY imp DESC, id)[1] AS DOUBLE), 2) AS first_importance FROM p GROUP BY name),
w AS (SELECT DISTINCT upper(p_name) || ' ' AS q, p_name FROM part UNION ALL SELECT 'nowhere', NULL)
SELECT w.q AS name, b.id AS place_id, b.imp AS importance, coalesce(n, 0) AS candidates, coalesce(n, 0) > 1 AS ambiguous, coalesce(options, '') AS options, first_importance FROM w LEFT JOIN b ON b.name = w.p_name""")
def match_gazetteer(spark, sf):
    p = view(spark, sf, "part").select(F.col("p_partkey").alias("place_id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("importance"))
    names = p.select(F.concat(F.upper("name"), F.lit(" ")).alias("name")).distinct()
    names = names.unionByName(names.agg(F.lit("nowhere").alias("name")))
    m = J.match_gazetteer(names, p)
    return m.withColumn("first_importance", F.round(F.get(F.col("options"), 0)["importance"].cast("double"), 2)).withColumn(
        "options", F.array_join(F.transform("options", lambda o: o["place_id"].cast("string")), "/"))


@query("scene_filter", """WITH s AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS d, value AS cloud, (event_id * 37 % 3600) / 100.0 AS w, 40 + (event_id * 53 % 1500) / 100.0 AS s FROM events)
SELECT event_id AS id, d AS datetime, cloud AS cloud_cover FROM s WHERE w <= 14 AND w + 1 >= 12 AND s <= 50 AND s + 1 >= 48.5 AND d >= '2024-01-03' AND cloud < 20 ORDER BY d DESC, id LIMIT 20""")
def scene_filter(spark, sf):
    k = F.col("event_id")
    w, s = k * 37 % 3600 / 100.0, 40 + k * 53 % 1500 / 100.0
    e = view(spark, sf, "events").select(k.alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("datetime"), F.col("value").alias("cloud_cover"),
                                         F.array(w, s, w + 1, s + 1).alias("bbox"))
    return FI.scene_filter(e, (12.0, 48.5, 14.0, 50.0), "2024-01-03", None, 20.0, 20).drop("bbox")


# ---------------------------------------------------------------- telemetry


@query("per_model", """SELECT model, count(*) AS runs, count(*) FILTER (WHERE passed) AS passed, round(count(*) FILTER (WHERE passed) / count(*)::DOUBLE, 6) AS pass_rate, round(avg(tool_coverage), 6) AS avg_coverage,
 round(avg(duration_s), 6) AS avg_duration, count(duration_s) AS timed, round(avg(tool_calls), 6) AS avg_calls, count(tool_calls) AS counted FROM history GROUP BY model""")
def per_model(spark, sf):
    m = TL.per_model(view(spark, sf, "history"))
    return m.select("model", "runs", "passed", *r(6, "pass_rate", "avg_coverage", "avg_duration", "avg_calls"), "timed", "counted")


@query("latest_per_test", """SELECT test_id, event_id, model, duration_s FROM (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY ts DESC, event_id DESC) AS rn FROM history) WHERE rn = 1""")
def latest_per_test(spark, sf):
    return TL.latest_per_test(view(spark, sf, "history"), ["ts", "event_id"]).select("test_id", "event_id", "model", "duration_s")


@query("message_gaps", """SELECT conv_id, turn, sent - last_value(sent IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM messages""")
def message_gaps(spark, sf):
    return TL.message_gaps(view(spark, sf, "messages"), "conv_id", "turn", "sent").select("conv_id", "turn", "gap")


@query("context_changes", """WITH m AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS was FROM conversations WHERE text <> ''),
s AS (SELECT conv_id, turn, list_filter(string_split(text, '. '), lambda x: trim(x) <> '') AS now, list_filter(string_split(was, '. '), lambda x: trim(x) <> '') AS old, text, was FROM m)
SELECT conv_id, turn, len(now) AS sections, CASE WHEN was IS NOT NULL THEN len(list_filter(list_distinct(now), lambda x: NOT list_contains(old, x))) END AS changed, was IS NOT NULL AS resent
FROM s WHERE was IS NULL OR text <> was""")
def context_changes(spark, sf):
    c = TL.context_changes(view(spark, sf, "conversations"), "conv_id", "turn", "text", r"\. ")
    return c.select("conv_id", "turn", F.col("sections").cast("long").alias("sections"), F.when(F.col("changed").isNotNull(), F.size("changed")).cast("long").alias("changed"), "resent")


@query("shard", "SELECT o_orderkey, ntile(7) OVER (ORDER BY o_orderkey) AS shard FROM orders")
def shard(spark, sf):
    return TL.shard(view(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 7).select("o_orderkey", F.col("shard").cast("long").alias("shard"))


@query("stalest", """WITH u AS (SELECT o_custkey AS k, max(CAST(o_orderdate AS TIMESTAMP)) AS t FROM orders GROUP BY 1 UNION ALL SELECT user_id, max(ts) FROM events GROUP BY 1), l AS (SELECT k, max(t) AS t FROM u GROUP BY k)
SELECT c_custkey AS test_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS last_used FROM customer LEFT JOIN l ON l.k = c_custkey """)
def stalest(spark, sf):
    bank = view(spark, sf, "customer").select(F.col("c_custkey").alias("test_id"), F.col("c_custkey").alias("position"))
    o = view(spark, sf, "orders").select(F.col("o_custkey").alias("test_id"), F.col("o_orderdate").cast("timestamp").alias("at"))
    e = view(spark, sf, "events").select(F.col("user_id").alias("test_id"), F.col("ts").cast("timestamp").alias("at"))
    return TL.stalest(bank, [o, e]).select("test_id", F.date_format("last_used", "yyyy-MM-dd HH:mm:ss").alias("last_used"))


_TOOLS = ("list_value(" + ", ".join(f"CASE WHEN event_id % {m} = 0 THEN '{t}' END" for t, m in (("geocode", 2), ("osm", 3), ("clip", 5))) + ", event_type)")


@query("tool_coverage", f"""WITH t AS (SELECT event_id, list_filter({_TOOLS}, lambda x: x IS NOT NULL) AS called FROM events),
m AS (SELECT event_id, called, list_filter(['geocode', 'osm | clip', 'click'], lambda e: NOT list_has_any(called, list_transform(string_split(e, '|'), lambda a: trim(a)))) AS missing FROM t)
SELECT event_id, round((3 - len(missing)) / 3.0::DOUBLE, 6) AS coverage, array_to_string(missing, ';') AS missing, len(called) AS calls, round(len(called) / 3.0, 1)::DOUBLE AS per_step,
 len(list_filter(called, lambda x: x NOT IN ('geocode', 'osm', 'clip', 'click'))) AS offplan FROM m""")
def tool_coverage(spark, sf):
    k = F.col("event_id")
    called = F.array_compact(F.array(F.when(k % 2 == 0, "geocode"), F.when(k % 3 == 0, "osm"), F.when(k % 5 == 0, "clip"), F.col("event_type")))
    want = F.array(F.lit("geocode"), F.lit("osm | clip"), F.lit("click"))
    t = view(spark, sf, "events").select("event_id", called.alias("called"), want.alias("want"))
    e = t.withColumn("e", X.tool_effort(F.col("want"), F.col("called")))
    return e.select("event_id", F.round(X.tool_coverage(F.col("want"), F.col("called")), 6).alias("coverage"),
                    F.array_join(X.missing_tools(F.col("want"), F.col("called")), ";").alias("missing"),
                    F.col("e.calls").cast("long").alias("calls"), "e.per_step", F.size("e.offplan").cast("long").alias("offplan"))


@query("trace_parse", """SELECT conv_id, string_agg(CASE WHEN role = 'assistant' THEN 'tool' || turn END, ',' ORDER BY turn) AS tools, coalesce(md5(trim(string_agg(CASE WHEN role <> 'assistant' AND text <> '' THEN text END, chr(10) ORDER BY turn), ' ')), md5('')) AS answer
FROM conversations GROUP BY conv_id""")
def trace_parse(spark, sf):
    c = view(spark, sf, "conversations")
    part = F.when(F.col("role") == "assistant", F.struct(F.lit("tool-call").alias("part_kind"), F.concat(F.lit("tool"), F.col("turn").cast("string")).alias("tool_name"), F.lit(None).cast("string").alias("content"))).otherwise(
        F.struct(F.lit("text").alias("part_kind"), F.lit(None).cast("string").alias("tool_name"), F.col("text").alias("content")))
    m = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.array(part).alias("parts")))), lambda x: F.struct(x["parts"].alias("parts"))).alias("m"))
    return m.select("conv_id", F.nullif(F.array_join(X.trace_tools(F.col("m")), ","), F.lit("")).alias("tools"), F.md5(X.trace_text(F.col("m"))).alias("answer"))


@query("protocol_parse", """SELECT conv_id, turn, role || ',' || 'save_' || turn AS tools, CASE WHEN turn % 2 = 0 THEN 'boom ' || turn ELSE '' END AS errors FROM conversations""")
def protocol_parse(spark, sf):
    t = F.col("turn").cast("string")
    p = F.concat(F.lit("08:00:00 +1.2s │ → "), F.col("role"), F.lit("(x=1)\n08:00:01 +0.3s │ "), F.col("text"), F.lit("\n08:00:02 │ → save_"), t, F.lit("()\n"),
                 F.when(F.col("turn") % 2 == 0, F.concat(F.lit("[run error: boom "), t, F.lit("]"))).otherwise(""))
    c = view(spark, sf, "conversations").select("conv_id", "turn", p.alias("p"))
    return c.select("conv_id", "turn", F.array_join(X.protocol_tools(F.col("p")), ",").alias("tools"), F.array_join(X.protocol_errors(F.col("p")), ";").alias("errors"))


@query("set_differences", """WITH c AS (SELECT conv_id, turn, string_split(text, ' ') AS a FROM conversations),
b AS (SELECT conv_id, turn, list_distinct(string_split(text, ' ')) AS b FROM conversations)
SELECT c.conv_id, c.turn, len(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x))) AS only_a, len(list_filter(list_distinct(a), lambda x: list_contains(b, x))) AS both
FROM c JOIN b ON b.conv_id = c.conv_id AND b.turn = c.turn - 1""")
def set_differences(spark, sf):
    """Words of each turn that the turn before has, and has not."""
    c = view(spark, sf, "conversations").select("conv_id", "turn", F.split("text", " ").alias("a"))
    b = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("a").alias("b"))
    return c.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.size(F.array_except("a", "b")).cast("long").alias("only_a"), F.size(F.array_intersect("a", "b")).cast("long").alias("both"))


@query("unique_names", """SELECT p_partkey, CASE WHEN rn = 1 THEN p_name ELSE p_name || '_' || rn END AS p_name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part)""")
def unique_names(spark, sf):
    p = view(spark, sf, "part").select("p_partkey", "p_name")
    return ST.unique_names(p, "p_name", ["p_partkey"])


@query("unique_names_taken", """SELECT count(*) AS n, count(*) AS names, CAST(count(DISTINCT 'n' || p_partkey % 40) + count(DISTINCT CASE WHEN p_partkey % 7 = 0 THEN p_partkey % 40 END) AS BIGINT) AS kept
FROM part""")
def unique_names_taken(spark, sf):
    """Some rows already have the name that another row would get."""
    old = F.concat(F.lit("n"), F.col("p_partkey") % 40, F.when(F.col("p_partkey") % 7 == 0, "_2").otherwise(""))
    p = view(spark, sf, "part").select("p_partkey", old.alias("name"), old.alias("old"))
    u = ST.unique_names(p, "name", ["p_partkey"])
    return u.agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"), F.count_if(F.col("name") == F.col("old")).alias("kept"))
