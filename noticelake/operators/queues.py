"""Curation queues, progress and listings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.operators.enrich import resolve_parts
from noticelake.operators.similarity import _is_multi, suggest_all, suggest_breakdown
from noticelake.storage import checkpoint

WINDOW_DAYS = {"window_7": 7, "window_30": 30}


def _located(df: DataFrame, db_id: int | None = None) -> DataFrame:
    rows = df.where(F.col("location").isNotNull() & (F.col("location") != ""))
    return rows if db_id is None else rows.where(F.col("db_id") == db_id)


def offense_counts(df: DataFrame) -> DataFrame:
    """(db_id, location, offense_count)."""
    return (
        df.where(F.col("location").isNotNull())
        .groupBy("db_id", "location")
        .agg(F.count(F.lit(1)).alias("offense_count"))
    )


def location_queue(
    df: DataFrame,
    locations: DataFrame,
    sort: str = "frequency",
    now: dt.datetime | Column | None = None,
    db_id: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Locations without judgment, the most urgent first; all of them unless ``limit`` asks for a page.

    Rows are counted per location before the anti-join, so a location holding most offenses is one row in it.
    """
    now = F.current_timestamp() if now is None else now if isinstance(now, Column) else F.lit(now)
    cutoff = now - F.make_dt_interval(F.lit(WINDOW_DAYS.get(sort, 0)))
    counted = _located(df, db_id).groupBy("db_id", "location").agg(
        F.count(F.lit(1)).alias("offense_count"),
        F.max("time").alias("newest_offense_date"),
        F.sum(F.when(F.col("time") >= cutoff, 1).otherwise(0)).alias("window_count"),
    )
    waiting = counted.join(locations.select("db_id", "location"), ["db_id", "location"], "left_anti")
    frequency, newest, window = (
        F.col("offense_count").desc(),
        F.col("newest_offense_date").desc_nulls_last(),
        F.col("window_count").desc(),
    )
    if sort == "newest":
        order = [newest, window, frequency]
    elif sort in WINDOW_DAYS:
        order = [window, frequency, newest]
    else:
        order = [frequency, newest]
    ordered = waiting.orderBy(*order, F.col("location").asc(), F.col("db_id").asc())
    return ordered if limit is None else ordered.limit(limit)


def geocoding_progress(df: DataFrame, locations: DataFrame, db_id: int | None = None) -> DataFrame:
    """One row of totals and percentages; :func:`geocoding_methods` breaks the judged locations down.

    Offenses are first counted per location; everything else works on those counts.
    """
    counts = offense_counts(_located(df, db_id))
    judged = locations if db_id is None else locations.where(F.col("db_id") == db_id)
    rows = counts.join(
        judged.select("db_id", "location", F.lit(1).alias("_judged")), ["db_id", "location"], "left"
    )
    totals = rows.agg(
        F.count(F.lit(1)).alias("total_locations"),
        F.coalesce(F.sum("_judged"), F.lit(0)).alias("geocoded_locations"),
        F.coalesce(F.sum("offense_count"), F.lit(0)).alias("total_offenses"),
        F.coalesce(F.sum(F.when(F.col("_judged") == 1, F.col("offense_count"))), F.lit(0)).alias("geocoded_offenses"),
    )
    return totals.withColumns(
        {
            "locations_percentage": _percent("geocoded_locations", "total_locations"),
            "offenses_percentage": _percent("geocoded_offenses", "total_offenses"),
        }
    )


def geocoding_methods(df: DataFrame, locations: DataFrame, db_id: int | None = None) -> DataFrame:
    """(geocoding_method, locations) over judged locations that occur in offenses."""
    present = offense_counts(_located(df, db_id)).select("db_id", "location")
    return (
        locations.join(present, ["db_id", "location"], "left_semi")
        .groupBy("geocoding_method")
        .agg(F.count(F.lit(1)).alias("locations"))
        .orderBy("geocoding_method")
    )


def _percent(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole) * 100).otherwise(F.lit(0.0))


def unclassified_descriptions(df: DataFrame, descriptions: DataFrame, limit: int | None = None) -> DataFrame:
    """(description, offense_count) of texts without judgment, commonest first."""
    counted = (
        df.where(F.col("description").isNotNull() & (F.col("description") != ""))
        .groupBy("description")
        .agg(F.count(F.lit(1)).alias("offense_count"))
    )
    waiting = counted.join(descriptions.select("description"), "description", "left_anti").orderBy(
        F.col("offense_count").desc(), F.col("description").asc()
    )
    return waiting if limit is None else waiting.limit(limit)


def parts_classified(df: DataFrame, descriptions: DataFrame) -> DataFrame:
    """(description, all_classified): whether every comma part of a text is known. Texts of blanks only are not."""
    texts = df.select("description").where(F.col("description").isNotNull()).distinct()
    resolved = resolve_parts(texts, descriptions)
    return texts.join(resolved.select("description", "all_found"), "description", "left").select(
        "description", F.coalesce("all_found", F.lit(False)).alias("all_classified")
    )


def description_progress(df: DataFrame, descriptions: DataFrame) -> DataFrame:
    """One row: distinct texts, judged texts, offenses with a text and with a judged text, percentages.

    Judged texts that occur in no offense count too, so the first percentage may pass 100.
    """
    counted = (
        df.where(F.col("description").isNotNull() & (F.col("description") != ""))
        .groupBy("description")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    judged = descriptions.select("description", F.lit(1).alias("_judged"))
    joined = counted.join(judged, "description", "full")
    return joined.agg(
        F.count("_n").alias("total_descriptions"),
        F.count("_judged").alias("classified_descriptions"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_offenses"),
        F.coalesce(F.sum(F.when(F.col("_judged") == 1, F.col("_n"))), F.lit(0)).alias("classified_offenses"),
    ).withColumns(
        {
            "descriptions_percentage": _percent("classified_descriptions", "total_descriptions"),
            "offenses_percentage": _percent("classified_offenses", "total_offenses"),
        }
    )


def pending_counts(df: DataFrame) -> DataFrame:
    """One row: offenses and distinct locations without point, offenses and distinct descriptions without articles."""
    no_point = F.col("point").isNull() & F.col("location").isNotNull() & (F.col("location") != "")
    no_articles = F.col("article_ids").isNull() & F.col("description").isNotNull() & (F.col("description") != "")
    return df.agg(
        F.count_if(no_point).alias("pending_geocoding_offenses"),
        F.countDistinct(F.when(no_point, F.col("location"))).alias("pending_geocoding_locations"),
        F.count_if(no_articles).alias("pending_offenses"),
        F.countDistinct(F.when(no_articles, F.col("description"))).alias("pending_descriptions"),
    )


def databases_with_locations(df: DataFrame, databases: DataFrame) -> DataFrame:
    """(id, name) of databases whose offenses have a location, by name."""
    present = _located(df).select(F.col("db_id").alias("id")).distinct()
    return databases.join(present, "id", "left_semi").select("id", "name").orderBy("name", "id")


def lookup_descriptions(keys: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Judgment of each given text, NULL when there is none."""
    return keys.select("description").join(
        descriptions.select("description", "article_ids", "article_codes", "updated_at"), "description", "left"
    )


def review_assignments(articles: DataFrame, descriptions: DataFrame, df: DataFrame) -> DataFrame:
    """(code, article_id, text, description, offense_count): articles with the texts judged as that article alone.

    Articles without text keep one row with NULLs. The list membership test is an equi-join on the single id.
    """
    single = descriptions.where(F.size("article_ids") == 1).select(
        F.element_at("article_ids", 1).alias("id"), "description"
    )
    counts = df.groupBy("description").agg(F.count(F.lit(1)).alias("offense_count"))
    return (
        articles.select("id", "code", "text")
        .join(single, "id", "left")
        .join(counts, "description", "left")
        .select(
            "code",
            F.col("id").alias("article_id"),
            "text",
            "description",
            F.when(F.col("description").isNotNull(), F.coalesce("offense_count", F.lit(0))).alias("offense_count"),
        )
        .orderBy("code", "article_id", F.col("description").asc_nulls_last())
    )


def review_tree(assignments: DataFrame) -> DataFrame:
    """One row per article with its texts nested: (code, article_id, text, descriptions)."""
    entry = F.when(F.col("description").isNotNull(), F.struct("description", "offense_count"))
    return (
        assignments.groupBy("code", "article_id", "text")
        .agg(F.array_sort(F.collect_list(entry)).alias("descriptions"))
        .orderBy("code", "article_id")
    )


def suggestion_report(
    df: DataFrame,
    descriptions: DataFrame,
    articles: DataFrame,
    threshold: float,
    multi_article: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Suggestions for the queue of unclassified texts: (description, pos, part, article_id, score).

    With ``multi_article`` only texts whose parts point to different articles, part by part, unless all parts are already
    classified; otherwise only the other texts, taken as a whole (``pos`` NULL) and with at least one suggestion.
    """
    # The queue and the verdicts feed several branches: store them once instead of deriving them in each.
    queue = checkpoint(unclassified_descriptions(df, descriptions, limit).select("description"))
    breakdown = checkpoint(suggest_breakdown(queue, articles, descriptions, threshold))
    multi = checkpoint(_is_multi(breakdown).where("is_multi").select("description"))
    if multi_article:
        done = parts_classified(queue, descriptions).where("all_classified").select("description")
        open_texts = multi.join(done, "description", "left_anti")
        return breakdown.join(open_texts, "description", "left_semi")
    single = checkpoint(queue.join(multi, "description", "left_anti"))
    return suggest_all(single, articles, descriptions, threshold).select(
        "description",
        F.lit(None).cast("int").alias("pos"),
        F.lit(None).cast("string").alias("part"),
        "article_id",
        "score",
    )
