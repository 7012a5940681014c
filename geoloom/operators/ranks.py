"""Exact order statistics by refining value ranges on counts, for columns of any length.

A round cuts the values that are still in question at approximate quantiles, keeps the few ranges around the wanted rank, and counts
exactly what lies below and inside them. When what is inside fits one task it is ranked; the counts make the answer exact
whatever the cuts were. No task ever holds more than ``LIMIT`` values of a group, and a value that is repeated without end is found
as a range of one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.session import cut_lineage

LIMIT = 100_000
CUTS = 256


def exact_quantiles(df: DataFrame, value: str | Column, probs: list[float], by: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``(by, quantiles)``: linearly interpolated quantiles of the values that are not null, per value of ``by`` (null is one).

    A group without values has no row; without ``by`` there is one row at most.
    """
    col = F.col(value) if isinstance(value, str) else value
    group = F.struct((F.col(by) if by else F.lit(1)).alias("g"))          # structs compare nulls as equal
    key = F.to_json(group)                                                # and as text they can be joined
    v = cut_lineage(df.select(key.alias("g"), *([F.col(by).alias("by")] if by else []), col.cast("double").alias("v")).where("v is not null"))
    sizes = v.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = lambda p: F.struct(F.lit(p).alias("p"), (F.lit(p) * (F.col("n") - 1)).alias("at"))
    want = cut_lineage(sizes.select("g", "n", "lo", "hi", F.posexplode(F.array(*map(place, probs))).alias("t", "w")).select(
        "g", "t", F.col("w.at").alias("at"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), (F.col("lo") == F.col("hi")).alias("known")))
    # known: the values at both ranks are lo and hi
    while not want.where((F.col("inside") > limit) & ~F.col("known")).isEmpty():
        want = cut_lineage(_narrowed(v, want, limit))
    one = want.where("known").select("g", "t", "at", F.col("lo").alias("a"), F.col("hi").alias("b"))
    few = v.select("g", "v").join(want.where("not known"), "g").where("v between lo and hi")
    rank = F.row_number().over(Window.partitionBy("g", "t").orderBy("v")) - 1 + F.col("below")
    near = few.withColumn("r", rank).where((F.col("r") >= F.floor("at")) & (F.col("r") <= F.ceil("at")))
    both = near.groupBy("g", "t").agg(F.first("at").alias("at"), F.min("v").alias("a"), F.max("v").alias("b")).unionByName(one)
    up = F.col("at") - F.floor("at")
    value_ = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.ceil("at") - F.col("at")) * F.col("a") + up * F.col("b"))
    out = both.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("t", value_.alias("q")))).alias("q")).select(
        "g", F.transform("q", lambda x: x["q"]).alias("quantiles"))
    if not by:
        return out.select("quantiles")
    return out.join(v.groupBy("g").agg(F.first("by").alias(by)), "g").select(by, "quantiles")


def _narrowed(v: DataFrame, want: DataFrame, limit: int) -> DataFrame:
    """Tighter ranges for the targets that need them, checked by counting; the others as they are."""
    wide = want.where((F.col("inside") > limit) & ~F.col("known"))
    held = v.select("g", "v").join(wide, "g").where("v between lo and hi")
    cuts = F.percentile_approx("v", F.array(*[F.lit(i / CUTS) for i in range(CUTS + 1)]), 10_000)
    # the rank among what is inside, as a number of cuts; two more to each side, since cuts are not exact
    share = (F.col("at") - F.col("below")) / F.greatest(F.col("inside") - 1, F.lit(1)) * CUTS
    pick = lambda i: F.element_at("cuts", F.greatest(F.lit(1), F.least(F.lit(CUTS + 1), i + 1)).cast("int"))
    tried = held.groupBy("g", "t").agg(cuts.alias("cuts")).join(wide, ["g", "t"]).select(
        "g", "t", pick(F.floor(share) - 2).alias("a"), pick(F.ceil(share) + 2).alias("b"))
    # a range that is no tighter is halved by value, so every round gets on
    tried = tried.join(wide.select("g", "t", "lo", "hi"), ["g", "t"]).select("g", "t", "a", "b", ((F.col("lo") + F.col("hi")) / 2).alias("m"), ((F.col("a") <= F.col("lo")) & (
        F.col("b") >= F.col("hi"))).alias("same"))
    seen = held.join(tried, ["g", "t"]).groupBy("g", "t").agg(
        F.count_if(F.col("v") < F.col("a")).alias("under"), F.count_if(F.col("v").between(F.col("a"), F.col("b"))).alias("mid"),
        F.count_if(F.col("v") <= F.col("m")).alias("low"), F.first("a").alias("a"), F.first("b").alias("b"), F.first("m").alias("m"), F.first("same").alias("same"),
        F.max(F.when(F.col("v") <= F.col("m"), F.col("v"))).alias("low_end"), F.min(F.when(F.col("v") > F.col("m"), F.col("v"))).alias("high_start"))
    first, last = F.floor("at") - F.col("below"), F.ceil("at") - F.col("below")
    part = lambda lo, hi, below, inside, known=None: F.struct(
        lo.alias("lo"), hi.alias("hi"), below.alias("below"), inside.alias("inside"), (lo == hi if known is None else F.lit(known)).alias("known"))
    c = F.col
    whole = part(c("lo"), c("hi"), c("below"), c("inside"))
    halved = F.when(last < c("low"), part(c("lo"), c("low_end"), c("below"), c("low"))).when(
        first >= c("low"), part(c("high_start"), c("hi"), c("below") + c("low"), c("inside") - c("low"))).otherwise(
        # the two ranks lie on either side of the middle
        part(c("low_end"), c("high_start"), c("below"), c("inside"), True))
    cut = F.when((first >= c("under")) & (last < c("under") + c("mid")), part(c("a"), c("b"), c("below") + c("under"), c("mid"))).otherwise(whole)
    new = seen.join(want, ["g", "t"]).select("g", "t", "at", F.when(c("same") | (cut["inside"] == c("inside")), halved).otherwise(cut).alias("w")).select("g", "t", "at", "w.*")
    return want.join(wide.select("g", "t"), ["g", "t"], "left_anti").unionByName(new.select(want.columns))


def exact_median(df: DataFrame, value: str | Column) -> Column:
    """The median as one value inside another query, null without values."""
    return exact_quantiles(df, value, [0.5]).select(F.col("quantiles")[0]).scalar()
