"""Pages of records and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticelake.operators.predicates import Predicates, apply_predicates

PAGE_COLUMNS = (
    "db_id",
    "doc_source",
    "doc_id",
    "doc_date",
    "record_id",
    "offense_id",
    "time",
    "location",
    "display_location",
    "description",
    "vehicle",
    "vehicle_type",
    "vehicle_country",
    "ur",
    "error",
    "point",
    "article_ids",
)
# Page sizes (fixed values).
PAGE_SIZE, DOCUMENT_ORDER_PAGE_SIZE, DOCUMENTS_PAGE_SIZE = 20, 1500, 50
# End of fixed values.


def sort_mode(preds: Predicates | None) -> str:
    """"document" when the only predicate is one on ``doc_source``, else "vehicle"."""
    return "document" if preds and list(preds) == ["doc_source"] else "vehicle"


def page_size(sort: str, per_page: int | None = None) -> int:
    return per_page or (DOCUMENT_ORDER_PAGE_SIZE if sort == "document" else PAGE_SIZE)


def _order(sort: str, tables: bool = False) -> list[tuple[str, bool]]:
    """(column, ascending) pairs; ``doc_source``, and with ``tables`` the table's number, make the order total."""
    keys = [("doc_id", True), ("record_id", True), ("doc_source", True), *([("table_no", True)] if tables else [])]
    return keys if sort == "document" else [("time", False), *keys]


def _literal(value, kind: T.DataType) -> Column:
    """A collected value as a literal of its column's type; wall times must not pass through a zone."""
    return F.lit(str(value)).cast(kind) if isinstance(kind, T.TimestampNTZType) else F.lit(value)


def _after(df: DataFrame, keys: list[tuple[str, bool]], last: dict) -> Column:
    """Rows that sort after ``last``, NULLs sorting last."""
    later, equal = F.lit(False), F.lit(True)
    for name, ascending in keys:
        column, value = F.col(name), last[name]
        if value is None:
            beyond, same = F.lit(False), column.isNull()
        else:
            value = _literal(value, df.schema[name].dataType)
            beyond = column.isNull() | (column > value if ascending else column < value)
            same = F.coalesce(column == value, F.lit(False))
        later, equal = later | (equal & beyond), equal & same
    return later


def list_offenses(
    df: DataFrame,
    preds: Predicates | None = None,
    sort: str | None = None,
    page: int = 1,
    limit: int | None = None,
    after: dict | None = None,
) -> DataFrame:
    """One page of records.

    ``after`` (the last row of the previous page) replaces the offset by a range condition, so deep pages cost the same
    as the first: a per-partition top-k.
    """
    sort = sort or sort_mode(preds)
    limit = page_size(sort, limit)
    tables = "table_no" in df.columns
    keys = _order(sort, tables)
    rows = apply_predicates(df, preds)
    if after is not None:
        rows = rows.where(_after(rows, keys, after))
    ordered = rows.select(*PAGE_COLUMNS, *(["table_no"] if tables else [])).orderBy(
        *[F.col(n).asc_nulls_last() if asc else F.col(n).desc_nulls_last() for n, asc in keys]
    )
    if after is None and page > 1:
        ordered = ordered.offset((page - 1) * limit)
    return ordered.limit(limit)


def page_info(df: DataFrame, preds: Predicates | None = None, page: int = 1, limit: int = PAGE_SIZE) -> DataFrame:
    """Total rows and pages of a selection, as one row."""
    return apply_predicates(df, preds).agg(F.count(F.lit(1)).alias("total")).select(
        "total",
        F.lit(page).alias("current_page"),
        F.ceil(F.col("total") / F.lit(limit)).cast("long").alias("total_pages"),
    )


def document_rollup(df: DataFrame, preds: Predicates | None = None) -> DataFrame:
    """Records, sum of ``ur`` and errors per document."""
    return (
        apply_predicates(df, preds)
        .groupBy("db_id", "doc_id", "doc_date", "doc_source")
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.sum("ur").alias("ur"),
            F.count("error").alias("errors"),
        )
    )


def list_documents(
    df: DataFrame, preds: Predicates | None = None, page: int = 1, limit: int = DOCUMENTS_PAGE_SIZE
) -> DataFrame:
    """One page of documents, newest first."""
    ordered = document_rollup(df, preds).orderBy(
        F.col("doc_date").desc_nulls_last(),
        F.col("doc_id").desc_nulls_last(),
        F.col("db_id").asc_nulls_last(),
        F.col("doc_source").asc_nulls_last(),
    )
    return ordered.offset((page - 1) * limit).limit(limit)


def documents_info(
    df: DataFrame, preds: Predicates | None = None, page: int = 1, limit: int = DOCUMENTS_PAGE_SIZE
) -> DataFrame:
    """Total documents and pages."""
    return page_info(document_rollup(df, preds), None, page, limit)


def page_labels(page: DataFrame, databases: DataFrame, articles: DataFrame) -> DataFrame:
    """(kind, id, label) of every database and article named in a page; unknown ids keep their own text."""
    dbs = page.select(F.col("db_id").cast("string").alias("id")).distinct()
    arts = page.select(F.explode("article_ids").alias("id")).distinct()
    db_names = databases.select(F.col("id").cast("string").alias("id"), F.col("name").alias("label"))
    art_names = articles.select("id", F.concat_ws(" - ", "id", "title").alias("label"))
    return _labelled("database", dbs, db_names).unionByName(_labelled("article", arts, art_names))


def _labelled(kind: str, ids: DataFrame, names: DataFrame) -> DataFrame:
    return ids.join(names, "id", "left").select(
        F.lit(kind).alias("kind"), "id", F.coalesce("label", "id").alias("label")
    )


def dataset_version(df: DataFrame, locations: DataFrame, descriptions: DataFrame) -> DataFrame:
    """One row: ``v:<rows hex>:<latest curation time in ms, hex>``."""
    curated = locations.select("updated_at").unionByName(descriptions.select("updated_at"))
    latest = curated.agg(F.max("updated_at").alias("ts"))
    rows = df.agg(F.count(F.lit(1)).alias("n"))
    millis = F.coalesce(F.unix_millis(F.col("ts").cast("timestamp")), F.lit(0))
    return (
        rows.withColumn("_k", F.lit(1))
        .join(latest.withColumn("_k", F.lit(1)), "_k")
        .select(F.concat(F.lit("v:"), F.lower(F.hex("n")), F.lit(":"), F.lower(F.hex(millis))).alias("version"))
    )
