"""Charts over time: records without error only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticelake.operators.predicates import Predicates, chart_filter
from noticelake.schema import WEEKDAY_LABELS


def _group(by: str | None) -> Column:
    if by is None:
        return F.lit("").alias("grp")
    if by != "year":
        raise ValueError("charts are grouped by year only")
    return F.date_format("time", "yyyy").alias("grp")


def by_day_of_year(df: DataFrame, preds: Predicates | None = None, group: str | None = None) -> DataFrame:
    """Running total per day of year as (grp, day_of_year, label, total), without gaps from first to last day.

    Labels come from a leap year. Ungrouped, day 366 is counted on day 59. Grouped with more than two groups, one day
    in seven is kept. At most 366 rows per group leave the first aggregation, so the window stays small.
    """
    days = chart_filter(df, preds).where(F.col("time").isNotNull())
    day = F.dayofyear("time")
    if group is None:
        day = F.when(day == 366, F.lit(59)).otherwise(day)
    counts = (
        days.select(_group(group), day.alias("day_of_year"))
        .groupBy("grp", "day_of_year")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    spans = counts.groupBy("grp").agg(F.min("day_of_year").alias("_first"), F.max("day_of_year").alias("_last"))
    dense = spans.select("grp", F.explode(F.sequence("_first", "_last")).alias("day_of_year"))
    running = Window.partitionBy("grp").orderBy("day_of_year").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = (
        dense.join(counts, ["grp", "day_of_year"], "left")
        .withColumn("total", F.sum(F.coalesce("n", F.lit(0))).over(running))
        .withColumn(
            "label",
            F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("day_of_year") - 1), "MM-dd"),
        )
    )
    if group is not None:
        groups = spans.agg(F.count(F.lit(1)).alias("_groups")).withColumn("_k", F.lit(1))
        totals = (
            totals.withColumn("_k", F.lit(1))
            .join(groups, "_k")
            .where((F.col("_groups") <= 2) | ((F.col("day_of_year") - 1) % 7 == 0))
        )
    return totals.select("grp", "day_of_year", "label", "total").orderBy("grp", "day_of_year")


def by_day_of_week(df: DataFrame, preds: Predicates | None = None, group: str | None = None) -> DataFrame:
    """Records per weekday as (grp, day_of_week, label, total); Sunday is 0."""
    day = F.dayofweek("time") - 1
    names = F.array(*[F.lit(n) for n in WEEKDAY_LABELS])
    return (
        chart_filter(df, preds)
        .where(F.col("time").isNotNull())
        .select(_group(group), day.alias("day_of_week"))
        .groupBy("grp", "day_of_week")
        .agg(F.count(F.lit(1)).alias("total"))
        .select("grp", "day_of_week", names[F.col("day_of_week")].alias("label"), "total")
        .orderBy("grp", "day_of_week")
    )


def by_time_of_day(df: DataFrame, preds: Predicates | None = None, group: str | None = None) -> DataFrame:
    """Records per hour as (grp, hour, total); exact midnight means an unknown time and is left out."""
    known = (F.hour("time") != 0) | (F.minute("time") != 0) | (F.second("time") != 0)
    return (
        chart_filter(df, preds)
        .where(F.col("time").isNotNull() & known)
        .select(_group(group), F.lpad(F.hour("time").cast("string"), 2, "0").alias("hour"))
        .groupBy("grp", "hour")
        .agg(F.count(F.lit(1)).alias("total"))
        .orderBy("grp", "hour")
    )


def pivot_series(series: DataFrame, key: str, groups: list[str] | None = None, value: str = "total") -> DataFrame:
    """One row per key and one column per group; NULL where a group has no value.

    Giving ``groups`` spares the job that would look them up.
    """
    grouped = series.groupBy(key)
    pivoted = grouped.pivot("grp", groups) if groups else grouped.pivot("grp")
    return pivoted.agg(F.sum(value)).orderBy(key)
