"""Catalogue search and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.scalars import GEO_KINDS, claimed_files


def query_tokens(text: str) -> list[str]:
    return text.lower().split()


def tiered_search(df: DataFrame, query: str, columns: list[str], key: str, phrase_columns: list[str] | None = None,
                  limit: int = 25) -> DataFrame:
    """Rows holding the most query tokens: only the best tier, whole-phrase hits in key or name first, then by key."""
    phrase, tokens = query.lower().strip(), query_tokens(query)
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    score = sum((F.when(hay.contains(t), 1).otherwise(0) for t in tokens), F.lit(0))
    hit = F.lit(False)
    for c in phrase_columns or [key]:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(phrase), F.lit(False))
    scored = df.withColumn("score", score).withColumn("phrase", hit).where("score > 0")
    best = scored.agg(F.max("score")).scalar()
    return scored.where(F.col("score") == best).orderBy(F.desc("phrase"), key).limit(limit)


def substring_search(df: DataFrame, term: str, columns: list[str], key: str, limit: int | None = 15,
                     skip: Column | None = None) -> DataFrame:
    """Rows with the term in any of the columns (case-blind), by key; ``skip`` marks rows left out (private, folders)."""
    t = term.lower()
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(t), F.lit(False))
    out = df.where(hit) if skip is None else df.where(hit & ~F.coalesce(skip, F.lit(False)))
    return out.orderBy(key).limit(limit) if limit else out


def rank_candidates(candidates: DataFrame, kinds: str, position: str, limit: int | None = None) -> DataFrame:
    """Candidates with a geospatial resource first, otherwise in catalogue order."""
    geo = F.exists(F.col(kinds), lambda k: k.isin(*GEO_KINDS))
    out = candidates.withColumn("is_geo", geo).orderBy(F.desc("is_geo"), position)
    return out.limit(limit) if limit else out


def recent_first(inventory: DataFrame, limit: int = 12, last_used: str = "last_used", key: str = "ds_id") -> DataFrame:
    return inventory.orderBy(F.desc(last_used), key).limit(limit)


def absent_claims(answers: DataFrame, files: DataFrame, key: str, text: str, file_name: str) -> DataFrame:
    """Output files that texts name and that do not exist: ``(key, name)``. Claims are reduced before the join."""
    claims = answers.select(key, F.explode(claimed_files(F.col(text))).alias("name"))
    return claims.join(files.select(F.substring_index(file_name, "/", -1).alias("name")).distinct(), "name", "left_anti").select(
        key, "name")
