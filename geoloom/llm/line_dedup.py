"""Drops lines that a large share of one site's pages repeat (site-relative frequency). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.workspace import Workspace
from geoloom.operators.skew import salted_join

# Prose that several authors write doesn't agree on whole lines, so a line on one in fifty of a site's pages is the site's own; the floor
# keeps small sites, where one page in fifty is no pattern, from losing lines.
RATIO = 0.02
LEAST_PAGES = 5


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _mark(line: Column) -> Column:
    """128 bits that stand for a line; spaces around it don't count."""
    return F.struct(F.xxhash64(F.trim(line)).alias("a"), F.xxhash64(F.lit(17), F.trim(line)).alias("b"))


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO,
                least_pages: int = LEAST_PAGES) -> DataFrame:
    """``(host, a, b)``: lines on more than ``ratio`` of their host's pages, and on ``least_pages`` pages at least.

    Pages with equal text are one page, so that a document with many copies is not taken for boilerplate as a whole; a page
    counts once per line however often it repeats it. Counting combines before the shuffles, first by page and then by line, so neither a
    host with a third of all pages nor a line on all of them gathers anywhere.
    """
    own = pages.select(F.col(host).alias("host"), F.col(text).alias("text")).where("host is not null")
    page = F.xxhash64("text")
    total = own.groupBy("host").agg(F.countDistinct(page).alias("pages"))
    marks = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), _mark))
    seen = own.select("host", page.alias("page"), F.explode(marks).alias("m")).groupBy("host", "m.a", "m.b").agg(F.countDistinct("page").alias("n"))
    common = seen.where(F.col("n") >= least_pages)
    return common.join(total, "host").where(F.col("n") > F.lit(ratio) * F.col("pages")).select("host", "a", "b")


def drop_site_lines(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO,
                    least_pages: int = LEAST_PAGES) -> DataFrame:
    """All columns with ``text`` cleaned, plus ``n_lines`` and ``n_dropped``.

    Blank lines are never counted or dropped. Pages without host and null texts stay as they are (``n_lines`` null for a
    null text). An empty text has one blank line. Columns named like the added ones are replaced, all others stay whatever their names.
    The lines to drop are few: a host has at most ``lines per page / ratio`` of them. They are written once and joined to
    the pages by host; Spark broadcasts them where their size on disk allows it, and beyond that pages of large hosts are salted by row.
    """
    kept = pages.drop("n_lines", "n_dropped")
    space = Workspace(pages.sparkSession, "lines")
    found = space.cut(boilerplate(kept, host, text, ratio, least_pages))
    # structs that hold every line of a host are bounded as said above
    lists = space.cut(found.groupBy("host").agg(F.collect_set(F.struct("a", "b")).alias("marks")))
    # a page is one struct here, so that none of its columns can clash with those of the join
    whole = kept.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("page"), F.col(host).alias("host"), F.monotonically_increasing_id().alias("row"))
    there = salted_join(whole, lists, ["host"], ["row"], "left")
    old = F.col("page")[text]
    lines = _lines(old)
    stay = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains("marks", _mark(x)))
    cleaned = there.select("page", F.when(F.col("marks").isNotNull(), stay).alias("stay"), F.size(lines).cast("long").alias("n"))
    dropped = F.when(F.col("stay").isNull(), F.lit(0)).otherwise(F.col("n") - F.size("stay")).cast("long")
    return cleaned.select(*[F.when(dropped > 0, F.array_join("stay", "\n")).otherwise(old).alias(c) if c == text else F.col("page")[c].alias(c) for c in kept.columns],
                          F.when(old.isNotNull(), F.col("n")).alias("n_lines"), dropped.alias("n_dropped"))


SQL = f"""
WITH pages AS (SELECT source AS host, count(DISTINCT text) AS pages FROM documents WHERE source IS NOT NULL GROUP BY source),
lines AS (SELECT doc_id, source AS host, text, unnest(list_distinct(list_filter(list_transform(string_split(text, chr(10)),
            lambda x: trim(x)), lambda x: x <> ''))) AS line FROM documents WHERE source IS NOT NULL),
counts AS (SELECT host, line, count(DISTINCT text) AS n FROM lines GROUP BY host, line),
bad AS (SELECT c.host, c.line FROM counts c JOIN pages p USING (host) WHERE c.n >= {LEAST_PAGES} AND c.n > {RATIO} * p.pages),
lists AS (SELECT host, list(line) AS marks FROM bad GROUP BY host),
cut AS (SELECT d.*, string_split(text, chr(10)) AS ls,
          list_filter(string_split(text, chr(10)), lambda x: trim(x) = '' OR NOT coalesce(list_contains(l.marks, trim(x)), false)) AS stay
        FROM documents d LEFT JOIN lists l ON d.source = l.host)
SELECT doc_id, source, array_to_string(stay, chr(10)) AS text, CAST(len(ls) AS BIGINT) AS n_lines,
       CAST(len(ls) - len(stay) AS BIGINT) AS n_dropped FROM cut
"""
