"""Facets: the commonest values of each dimension under the current selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial, reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticelake.functions.text import contains_any_case, literal_lookup
from noticelake.operators.predicates import Predicates, apply_predicates, dimension_column, feature_conditions, predicate
from noticelake.schema import ARRAY_DIMENSIONS, COUNTRY_LABELS, DIMENSION_COLUMNS, FEATURE_LABELS

# Values shown per dimension (fixed values).
FACET_LIMIT = 10
LONG_FACETS = {"vehicle": 30, "article_code": 30}
# End of fixed values.

# A record's document, as facets of documents count it.
DOCUMENT_KEY = ("db_id", "doc_id")

_SELECTED = T.StructType([T.StructField("dimension", T.StringType()), T.StructField("value", T.StringType())])


def _entries(dims: Sequence[str], counts_for: Mapping[str, Column], unnest: bool = True) -> Column:
    """array<struct(dimension, value)> holding the facet values of a record in each dimension that it counts for."""

    def entry(dim: str, value: Column) -> Column:
        return F.struct(F.lit(dim).alias("dimension"), value.cast("string").alias("value"))

    def present(entries: list[Column]) -> Column:
        return F.filter(F.array(*entries), lambda e: e.isNotNull())

    scalars = [d for d in dims if d != "features" and (d not in ARRAY_DIMENSIONS or not unnest)]
    arrays = [d for d in dims if d in ARRAY_DIMENSIONS and unnest]
    parts = []
    if scalars:
        parts.append(present([F.when(counts_for[d], entry(d, dimension_column(d))) for d in scalars]))
    for dim in arrays:
        values = F.when(counts_for[dim], dimension_column(dim))
        values = F.coalesce(values, F.array().cast(f"array<{'int' if dim == 'article_code' else 'string'}>"))
        parts.append(F.transform(values, partial(entry, dim)))
    if "features" in dims:
        flags = feature_conditions().items()
        parts.append(present([F.when(counts_for["features"] & c, entry("features", F.lit(n))) for n, c in flags]))
    return F.concat(*parts)


def _facet_entries(
    df: DataFrame, preds: Predicates | None, dims: Sequence[str], unnest: bool = True, carried: Sequence[str] = ()
) -> DataFrame:
    """``dimension, value`` and carried columns of every value a record counts for, from one scan.

    Each record carries a mask of the predicates it fails, among those whose own dimension is asked for. It counts for a
    dimension if the mask has no bit but that dimension's; with two bits it counts for none and is dropped ahead of the
    masks' use. Predicates of other dimensions hold for all, and reach the scan.
    """
    failing = {d: c for d in dict.fromkeys(dims) if (c := predicate(d, (preds or {}).get(d, ()))) is not None}
    always = apply_predicates(df, {d: v for d, v in (preds or {}).items() if d not in failing})
    # Never NULL: a join on it then adds no condition that would tell apart two uses of one aggregate.
    dimension = F.coalesce("e.dimension", F.lit("")).alias("dimension")
    if not failing:
        every = dict.fromkeys(dims, F.lit(True))
        return always.select(F.explode(_entries(dims, every, unnest)).alias("e"), *carried).select(dimension, "e.value", *carried)
    bits = {d: 1 << i for i, d in enumerate(failing)}
    mask = reduce(add, [F.when(F.coalesce(c, F.lit(False)), 0).otherwise(bits[d]) for d, c in failing.items()])
    masked = always.withColumn("_failed", mask).where(F.bit_count("_failed") <= 1)
    counts_for = {d: F.col("_failed").isin(0, bits[d]) if d in bits else F.col("_failed") == 0 for d in dims}
    return masked.select(F.explode(_entries(dims, counts_for, unnest)).alias("e"), *carried).select(dimension, "e.value", *carried)


def _search_condition(search: Mapping[str, str] | None, databases: Mapping[int, str]) -> Column:
    """Keep values that match the text searched for in their dimension; other dimensions pass."""
    keep = F.lit(True)
    for dim, text in (search or {}).items():
        if not text:
            continue
        value, needle = F.col("value"), text.lower()
        if dim == "database":
            ids = [str(i) for i, name in databases.items() if needle in name.lower()]
            match = value.isin(*ids) if ids else F.lit(False)
        elif dim == "country":
            codes = [c for c, n in COUNTRY_LABELS.items() if needle in n.lower() or needle in c.lower()]
            match = value.isin(*codes) if codes else F.lit(False)
        else:
            match = F.coalesce(contains_any_case(value, text), F.lit(False))
        keep = keep & ((F.col("dimension") != dim) | match)
    return keep


def facet_counts(
    df: DataFrame,
    preds: Predicates | None,
    dims: Sequence[str],
    search: Mapping[str, str] | None = None,
    databases: Mapping[int, str] | None = None,
    count: str = "records",
    unnest: bool = True,
) -> DataFrame:
    """(dimension, value, count) of all values; each dimension ignores its own predicate.

    ``count`` is "records" or "documents". All dimensions come from one scan. Counts are combined map-side, so a value
    held by most rows costs nothing extra.
    """
    for dim in dims:
        if dim not in DIMENSION_COLUMNS:
            raise ValueError(f"unknown dimension: {dim}")
    measure = F.count(F.lit(1)) if count == "records" else F.countDistinct(*DOCUMENT_KEY)
    carried = [] if count == "records" else list(DOCUMENT_KEY)
    values = _facet_entries(df, preds, list(dict.fromkeys(dims)), unnest, carried)
    values = values.where(_search_condition(search, databases or {}))
    return values.groupBy("dimension", "value").agg(measure.alias("count"))


def facet_totals(counts: DataFrame) -> DataFrame:
    """Distinct values per dimension, NULL and '' being one value (array elements: '' only if present)."""
    # Uses the counts, so that it needs the same rows and columns as the top values do and both read one aggregate.
    held = F.col("count") > 0
    is_null = F.max(F.when(F.col("value").isNull() & held, 1).otherwise(0))
    is_blank = F.max(F.when((F.col("value") == "") & held, 1).otherwise(0))
    return (
        counts.where(F.when(F.col("dimension") != "features", F.col("count")) > 0)
        .groupBy("dimension")
        .agg((F.count(F.lit(1)) - is_null * is_blank).alias("total_values"))
    )


def approximate_totals(df: DataFrame, preds: Predicates | None, dims: Sequence[str]) -> DataFrame:
    """Distinct values per dimension by sketch, for very wide dimensions."""
    values = _facet_entries(df, preds, [d for d in dict.fromkeys(dims) if d != "features"])
    return values.groupBy("dimension").agg(F.approx_count_distinct(F.coalesce("value", F.lit(""))).alias("total_values"))


def top_values(counts: DataFrame, limits: Mapping[str, int] | None = None, default: int = FACET_LIMIT) -> DataFrame:
    """Most frequent values per dimension, ties by value. The limit is applied before and after the shuffle."""
    limits = dict(limits or {})
    widest = max([default, *limits.values()])
    order = Window.partitionBy("dimension").orderBy(F.col("count").desc(), F.col("value").asc_nulls_last())
    allowed = F.lit(default)
    for dim, n in limits.items():
        allowed = F.when(F.col("dimension") == dim, F.lit(n)).otherwise(allowed)
    return (
        counts.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= widest)
        .where(F.col("rank") <= allowed)
    )


def with_labels(
    values: DataFrame, databases: DataFrame | None = None, articles: DataFrame | None = None
) -> DataFrame:
    """Add ``label``: database name, country, feature, "id - title" of an article; else the value itself."""
    value = F.col("value")
    fixed = (
        F.when(F.col("dimension") == "country", literal_lookup(value, COUNTRY_LABELS))
        .when(F.col("dimension") == "features", literal_lookup(value, FEATURE_LABELS))
    )
    labelled = values.withColumn("_fixed", fixed)
    names = None
    if databases is not None:
        names = databases.select(
            F.lit("database").alias("dimension"), F.col("id").cast("string").alias("value"), F.col("name").alias("_name")
        )
    if articles is not None:
        by_id = articles.select(
            F.lit("article_id").alias("dimension"), F.col("id").alias("value"), F.concat_ws(" - ", "id", "title").alias("_name")
        )
        # All articles of a code share its title; the last one wins when they do not.
        by_code = articles.groupBy("code").agg(F.max_by("title", "id").alias("title")).select(
            F.lit("article_code").alias("dimension"),
            F.col("code").cast("string").alias("value"),
            F.concat_ws(" - ", F.col("code").cast("string"), "title").alias("_name"),
        )
        names = by_id.unionByName(by_code) if names is None else names.unionByName(by_id).unionByName(by_code)
    if names is not None:
        labelled = labelled.join(names, ["dimension", "value"], "left")
        fixed = F.coalesce("_name", "_fixed")
    else:
        fixed = F.col("_fixed")
    unknown_db = F.when(
        (F.col("dimension") == "database") & value.isNotNull(), F.concat(F.lit("Unknown DB ("), value, F.lit(")"))
    )
    if databases is None:
        unknown_db = F.lit(None).cast("string")
    return labelled.withColumn("label", F.coalesce(fixed, unknown_db, value, F.lit(""))).drop("_fixed", "_name")


def facets(
    df: DataFrame,
    preds: Predicates | None,
    dims: Sequence[str],
    search: Mapping[str, str] | None = None,
    databases: DataFrame | None = None,
    articles: DataFrame | None = None,
    database_names: Mapping[int, str] | None = None,
    limits: Mapping[str, int] | None = None,
) -> DataFrame:
    """Top values per dimension with totals, labels and the selected ones pinned first.

    Rows: dimension, value ('' for NULL), label, count, selected, total_values, ordered as a sidebar shows them.
    ``limits`` says how many values a dimension shows, where not the usual number.
    """
    counts = facet_counts(df, preds, dims, search, database_names)
    return _present(counts, preds, dims, {**LONG_FACETS, **(limits or {})}, databases, articles)


def document_facets(
    df: DataFrame,
    preds: Predicates | None,
    dims: Sequence[str],
    databases: DataFrame | None = None,
    articles: DataFrame | None = None,
    limits: Mapping[str, int] | None = None,
) -> DataFrame:
    """As :func:`facets`, counting distinct documents instead of records."""
    counts = facet_counts(df, preds, dims, count="documents", unnest=False)
    return _present(counts, preds, dims, limits or {}, databases, articles)


def _present(counts, preds, dims, limits, databases, articles) -> DataFrame:
    spark = counts.sparkSession
    top = top_values(counts, limits).withColumn("value", F.coalesce("value", F.lit(""))).drop("rank")
    # NULL and '' may both be in the top: they stay two rows, as both print as ''.
    chosen = [(d, str(v)) for d in dims for v in (preds or {}).get(d, [])]
    selected = spark.createDataFrame(sorted(set(chosen)), _SELECTED).withColumn("selected", F.lit(True))
    pinned = top.join(selected, ["dimension", "value"], "full").select(
        "dimension",
        "value",
        F.coalesce("count", F.lit(0)).alias("count"),
        F.coalesce("selected", F.lit(False)).alias("selected"),
    )
    position = F.array_position(F.array(*[F.lit(d) for d in dims]), F.col("dimension"))
    return (
        with_labels(pinned, databases, articles)
        .join(facet_totals(counts), "dimension", "left")
        .withColumn("total_values", F.coalesce("total_values", F.lit(0)))
        .orderBy(position, F.col("selected").desc(), F.col("count").desc(), F.col("label").asc(), F.col("value").asc())
        .select("dimension", "value", "label", "count", "selected", "total_values")
    )


def suggest_values(
    df: DataFrame,
    dim: str,
    query: str,
    preds: Predicates | None = None,
    databases: DataFrame | None = None,
    articles: DataFrame | None = None,
    database_names: Mapping[int, str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Values of one dimension that contain the text typed so far, most frequent first."""
    limits = None if limit is None else {dim: limit}
    return facets(df, preds, [dim], {dim: query}, databases, articles, database_names, limits)


def location_breakdown(df: DataFrame, preds: Predicates | None = None, top: int = 5) -> DataFrame:
    """Per location, its ``top`` article codes (ids when already filtered by code), the rest as others, and shares.

    When articles are selected only those are listed. ``others`` is the location's records minus the listed counts.
    """
    dim = "article_id" if (preds or {}).get("article_code") else "article_code"
    chosen = (preds or {}).get(dim)
    own = predicate(dim, chosen or ())
    rows = apply_predicates(df, preds, exclude=dim).where(F.col("location").isNotNull())
    # One scan: a record gives its values and, if it passes the own predicate as well, one unit of the total.
    values = F.coalesce(dimension_column(dim).cast("array<string>"), F.array().cast("array<string>"))
    passes = F.lit(True) if own is None else F.coalesce(own, F.lit(False))
    unit = F.struct(F.lit(True).alias("whole"), F.lit(None).cast("string").alias("value"))
    entries = F.concat(
        F.transform(values, lambda v: F.struct(F.lit(False).alias("whole"), v.alias("value"))),
        F.when(passes, F.array(unit)).otherwise(F.array().cast("array<struct<whole:boolean,value:string>>")),
    )
    counts = rows.select("location", F.explode(entries).alias("e")).groupBy("location", "e.whole", "e.value").agg(
        F.count(F.lit(1)).alias("count")
    )
    # A location has as many rows here as different articles.
    place = Window.partitionBy("location")
    rank = F.row_number().over(Window.partitionBy("location", "whole").orderBy(F.col("count").desc(), F.col("value").asc()))
    listed = F.col("value").isin(*[str(v) for v in chosen]) if chosen else F.col("_rank") <= top
    ranked = counts.withColumn("_rank", rank).withColumn("_listed", ~F.col("whole") & F.coalesce(listed, F.lit(False)))
    summed = ranked.withColumns(
        {
            "total": F.max(F.when(F.col("whole"), F.col("count"))).over(place),
            "_shown": F.sum(F.when(F.col("_listed"), F.col("count")).otherwise(0)).over(place),
        }
    )
    out = summed.where(F.col("total").isNotNull()).select(
        "location",
        F.when(F.col("whole"), F.lit("Otros")).otherwise(F.col("value")).alias("value"),
        F.when(F.col("whole"), F.col("total") - F.col("_shown")).otherwise(F.col("count")).alias("count"),
        "total",
        F.when(F.col("whole"), F.col("total") > F.col("_shown")).otherwise(F.col("_listed")).alias("_kept"),
    )
    return out.where("_kept").drop("_kept").withColumn("percent", F.col("count") / F.col("total") * 100)
