"""Joins of offenses with the curated dimensions.

Dimensions are joined without hints: Spark broadcasts one only when its measured size is below the session threshold, and
otherwise shuffles, adaptive execution splitting the partitions of hot keys. Text work is done on distinct texts, which are
grouped with map-side combine first, so a description shared by most rows is resolved once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.functions.text import description_parts, fold, null_if_empty
from noticelake.schema import CELL_COLUMNS


def _canonical(locations: DataFrame) -> DataFrame:
    named = locations.withColumn("_canonical", null_if_empty("canonical_location"))
    return named.select(
        "db_id",
        "location",
        "_canonical",
        F.col("point").alias("_point"),
        *[F.col(c).alias(f"_{c}") for c in CELL_COLUMNS],
    )


def enrich_location(df: DataFrame, locations: DataFrame) -> DataFrame:
    """At load: rows whose location has a canonical name take that name, its point and its cells.

    The original text is kept in ``display_location``. ``locations`` is unique on (``db_id``, ``location``).
    """
    dims = _canonical(locations).where(F.col("_canonical").isNotNull()).withColumn("_hit", F.lit(True))
    joined = df.join(dims, ["db_id", "location"], "left")
    hit = F.col("_hit")
    filled = {c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("point", *CELL_COLUMNS)}
    return joined.withColumns(
        {
            "display_location": F.when(hit, F.col("location")).otherwise(F.col("display_location")),
            **filled,
        }
    ).withColumn("location", F.coalesce("_canonical", "location")).select(*df.columns)


def backfill_geocoding(df: DataFrame, locations: DataFrame) -> DataFrame:
    """Rename rows without ``display_location`` to their canonical name, then fill missing points and cells.

    The second step looks up the renamed location. Adds ``renamed`` and ``geocoded`` flags telling what changed.
    """
    names = _canonical(locations).where(F.col("_canonical").isNotNull()).select("db_id", "location", "_canonical")
    first = df.join(names, ["db_id", "location"], "left")
    rename = F.col("display_location").isNull() & F.col("_canonical").isNotNull()
    renamed = first.withColumn("renamed", rename).withColumns(
        {
            "display_location": F.when(F.col("renamed"), F.col("location")).otherwise(F.col("display_location")),
            "location": F.when(F.col("renamed"), F.col("_canonical")).otherwise(F.col("location")),
        }
    ).drop("_canonical")
    points = _canonical(locations).drop("_canonical").where(F.col("_point").isNotNull())
    second = renamed.join(points, ["db_id", "location"], "left")
    missing = F.col("point").isNull() & F.col("_point").isNotNull()
    filled = second.withColumn("geocoded", missing)
    return filled.withColumns(
        {c: F.when(F.col("geocoded"), F.col(f"_{c}")).otherwise(F.col(c)) for c in ("point", *CELL_COLUMNS)}
    ).select(*df.columns, "renamed", "geocoded")


def folded_descriptions(descriptions: DataFrame) -> DataFrame:
    """(key, article_ids, article_codes) with one row per folded text, the latest judgment winning."""
    judgment = F.struct("article_ids", "article_codes")
    latest = descriptions.groupBy(fold("description").alias("key")).agg(
        F.max_by(judgment, F.struct("updated_at", "description")).alias("_j")
    )
    return latest.select("key", "_j.article_ids", "_j.article_codes")


def classify_exact(df: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Articles of rows whose folded description is a known one."""
    known = folded_descriptions(descriptions).select(
        F.col("key").alias("_key"), F.col("article_ids").alias("_ids"), F.col("article_codes").alias("_codes")
    )
    joined = df.withColumn("_key", fold("description")).join(known, "_key", "left")
    return joined.withColumns({"article_ids": F.col("_ids"), "article_codes": F.col("_codes")}).select(
        *dict.fromkeys([*df.columns, "article_ids", "article_codes"])
    )


def resolve_parts(texts: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Distinct descriptions → (description, parts, all_found, article_ids, article_codes) by their comma parts.

    Ids and codes are concatenated in part order, repeats kept; they are NULL unless every part is known.
    """
    distinct = texts.select("description").where(F.col("description").isNotNull()).distinct()
    known = folded_descriptions(descriptions).withColumn("_found", F.lit(True))
    parts = distinct.select("description", F.posexplode(description_parts("description")).alias("pos", "part"))
    looked_up = parts.withColumn("key", fold("part")).join(known, "key", "left")
    return (
        looked_up.groupBy("description")
        .agg(
            F.count(F.lit(1)).alias("parts"),
            F.bool_and(F.coalesce("_found", F.lit(False))).alias("all_found"),
            # As many entries as the text has parts.
            F.array_sort(F.collect_list(F.struct("pos", "article_ids", "article_codes"))).alias("_found"),
        )
        .select(
            "description",
            "parts",
            "all_found",
            *[
                F.when(F.col("all_found"), F.flatten(F.col("_found")[name])).alias(name)
                for name in ("article_ids", "article_codes")
            ],
        )
    )


def classify_multipart(df: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Articles of every row: an exact match, else all comma parts resolved."""
    exact = classify_exact(df.select("description").distinct(), descriptions)
    rest = exact.where(F.col("article_ids").isNull() & F.col("description").isNotNull()).select("description")
    by_parts = resolve_parts(rest, descriptions).where("all_found")
    resolved = (
        exact.where(F.col("article_ids").isNotNull())
        .select("description", "article_ids", "article_codes")
        .unionByName(by_parts.select("description", "article_ids", "article_codes"))
        .select(
            "description", F.col("article_ids").alias("_ids"), F.col("article_codes").alias("_codes")
        )
    )
    joined = df.join(resolved, "description", "left")
    return joined.withColumns({"article_ids": F.col("_ids"), "article_codes": F.col("_codes")}).select(
        *dict.fromkeys([*df.columns, "article_ids", "article_codes"])
    )


def backport_articles(df: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Fill NULL ``article_ids``: unfolded exact match, then all comma parts. Adds ``backported`` ("exact", "parts").

    Rows that already have articles are left alone.
    """
    pending = df.where(F.col("article_ids").isNull() & F.col("description").isNotNull())
    exact = descriptions.select(
        "description", F.col("article_ids").alias("_ids"), F.col("article_codes").alias("_codes"), F.lit("exact").alias("_how")
    )
    texts = pending.select("description").distinct()
    rest = texts.join(exact.select("description"), "description", "left_anti").where(F.contains("description", F.lit(",")))
    parts = resolve_parts(rest, descriptions).where("all_found").select(
        "description",
        F.col("article_ids").alias("_ids"),
        F.col("article_codes").alias("_codes"),
        F.lit("parts").alias("_how"),
    )
    joined = df.join(exact.unionByName(parts), "description", "left")
    fill = F.col("article_ids").isNull() & F.col("_ids").isNotNull()
    return joined.withColumn("backported", F.when(fill, F.col("_how"))).withColumns(
        {
            "article_ids": F.coalesce("article_ids", "_ids"),
            "article_codes": F.when(F.col("backported").isNotNull(), F.col("_codes")).otherwise(F.col("article_codes")),
        }
    ).select(*df.columns, "backported")


def codes_for_ids(df: DataFrame, articles: DataFrame, key: str) -> DataFrame:
    """(key, article_codes, unknown_ids): distinct codes of ``article_ids`` in order of first appearance.

    ``key`` identifies a row of ``df``; ``unknown_ids`` lists ids that are no article.
    """
    ids = df.select(key, F.posexplode("article_ids").alias("pos", "id"))
    coded = ids.join(articles.select("id", "code"), "id", "left")
    listed = coded.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "id", "code"))).alias("_l"))
    known = F.filter("_l", lambda e: e["code"].isNotNull())
    unknown = F.filter("_l", lambda e: e["code"].isNull())
    return listed.select(
        key,
        F.array_distinct(known["code"]).alias("article_codes"),
        unknown["id"].alias("unknown_ids"),
    )


def upsert_descriptions(descriptions: DataFrame, incoming: DataFrame) -> DataFrame:
    """Descriptions with the incoming judgments inserted or replacing those of the same text."""
    return latest_wins(descriptions, incoming, ["description"])


def seed_articles(articles: DataFrame, incoming: DataFrame) -> DataFrame:
    """Articles with unseen ids added; known ones untouched."""
    rest = [c for c in articles.columns if c != "id"]
    once = incoming.groupBy("id").agg(F.min(F.struct(*rest)).alias("_a")).select(
        "id", *[F.col("_a")[c].alias(c) for c in rest]
    )
    unseen = once.join(articles.select("id"), "id", "left_anti")
    return articles.unionByName(unseen)


def upsert_articles(articles: DataFrame, incoming: DataFrame) -> DataFrame:
    """Articles with the incoming ones inserted or replacing those of the same id."""
    return latest_wins(articles, incoming, ["id"])


def latest_wins(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Union in which incoming rows replace stored rows of the same key.

    If a key arrives more than once its last row by ``updated_at`` wins, of equally late ones that with the larger hash.
    """
    rest = [c for c in stored.columns if c not in keys]
    recency = [c for c in ("updated_at",) if c in rest]
    once = (
        incoming.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*recency, F.xxhash64(*rest).alias("_h"))).alias("_v"))
        .select(*keys, *[F.col("_v")[c].alias(c) for c in rest])
    )
    kept = stored.join(once.select(*keys), keys, "left_anti")
    return kept.unionByName(once.select(*stored.columns))
