"""Records of published notices: from page texts to typed, validated rows."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.functions.amounts import parse_ur
from noticelake.functions.text import (
    clean_description,
    clean_text,
    clean_texts,
    country_iso,
    literal_lookup,
    normalize_header,
    normalize_plate,
    null_if_empty,
    trim_space,
)
from noticelake.functions.times import CIVIL_ZONE, civil_midnight, parse_offense_time
from noticelake.operators.html import notice_texts

# Column headers, after normalisation, and the property they hold (fixed values).
HEADERS = {
    "vehicle": ("Matrícula", "Matrícula y padrón", "ATRICULA", "MATRICLA", "MAT."),
    "time": ("Fecha y Hora", "Fecha-Hora", "Fecha-Hola", "Fecha", "Fecha Ingreso"),
    "location": ("Intersección", "ntersección", "Lugar", "Ubicación"),
    "id": ("Intervenido", "Serie-Boleta", "ID_BOLETA", "ID"),
    "description": ("Artículo", "INFRACCION", "Nom. Tributo", "Detalle", "Detalles", "Multa", "CONDUCTOR"),
    "ur": ("Valor en UR", "Valor UR", "Valor Total", "Valor", "UR", "Monto"),
    "locality": ("Localidad",),
    "hour": ("Hora",),
    "country": ("Pais", "País"),
    "ignore": ("Unidad", "Cantidad", "CI.", "Documento", "N° Documento", "Nombre o razón social", "Deuda (11/11)"),
}
# Body phrases that stand for a missing description column, and that description (fixed values).
DEFAULT_PHRASES = (
    "que se constató la contravención a lo dispuesto en el art. 9 del texto ordenado del sucive",
    "que el cuerpo inspectivo constató la contravención a lo dispuesto en el art 9 del texto ordenado del sucive",
    "que la intendencia de montevideo, constató la contravención a lo dispuesto en el artículo 9 del texto ordenado del sucive",
)
DEFAULT_DESCRIPTION = "Cobros por acciones, trámites o gestiones"
# Heading before the publication date, an unnumbered document, and titles of pages that are no notice (fixed values).
PUBLISHED = "fecha de publicación:"
UNNUMBERED = "s/n"
LOGIN_TITLES = ("Ingreso - IMPO",)
# Validation (fixed values).
PLATE = "(?i)^[A-Z0-9]{4,10}$"
EARLIEST = "2015-01-01"
INVALID_PLATE, MISSING_TIME, MISSING_DESCRIPTION = "matrícula inválida", "falta horario", "falta descripción"
NO_DESCRIPTION_COLUMN = "tabla sin columna descripción"
NO_DOCUMENT_ID = "document ID not found"
MAX_ERROR_PERCENT = 5.0
# End of fixed values.

_READ = ("vehicle", "time", "location", "id", "description", "ur", "locality", "hour", "country")


def header_map(headers: Mapping[str, Sequence[str]] = HEADERS) -> dict[str, str]:
    """Header as printed → property."""
    return {name: prop for prop, names in headers.items() for name in names}


def map_header(c: Column, headers: Mapping[str, Sequence[str]] = HEADERS) -> Column:
    """Property of a header text; NULL when it is unknown."""
    distinct = {}
    for name, prop in header_map(headers).items():
        distinct.setdefault(_plain_header(name), prop)
    return literal_lookup(normalize_header(c), distinct)


def _plain_header(name: str) -> str:
    """The driver-side twin of :func:`normalize_header`, for the fixed header list."""
    letters = "".join(ch for ch in name if ch.isalpha())
    return "".join(ch for ch in unicodedata.normalize("NFD", letters) if unicodedata.category(ch) != "Mn").lower()


def is_login(title: Column | str, titles: Sequence[str] = LOGIN_TITLES) -> Column:
    """True when the title says the page is a login form."""
    title = F.col(title) if isinstance(title, str) else title
    return F.coalesce(title.isin(*titles), F.lit(False))


def default_description(body: Column | str, phrases: Sequence[str] = DEFAULT_PHRASES) -> Column:
    """Fixed description when the body holds one of the phrases, else NULL."""
    text = F.regexp_replace(F.lower(body if isinstance(body, Column) else F.col(body)), r"[\s\p{Z}]+", " ")
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.contains(text, F.lit(phrase))
    return F.when(found, F.lit(DEFAULT_DESCRIPTION))


def _doc_id(title: Column, issuers: Column) -> Column:
    """Last word after the first known issuer that is followed by one."""

    def after(issuer: Column) -> Column:
        issuer = F.lower(issuer)
        rest = trim_space(F.substring(title, F.instr(title, issuer) + F.length(issuer), F.length(title)))
        word = F.when(F.contains(rest, F.lit(" ")), F.substring_index(rest, " ", -1)).when(rest == UNNUMBERED, rest)
        return F.when((issuer != "") & F.contains(title, issuer), word)

    return F.get(F.filter(F.transform(issuers, after), lambda w: w.isNotNull()), 0)


def _dates(headings: Column) -> Column:
    """array<struct(text, date)>: the publication dates of cleaned headings; an unreadable one has a NULL date."""
    lower = F.transform(headings, lambda h: F.lower(h["text"]))
    dated = F.filter(lower, lambda h: F.contains(h, F.lit(PUBLISHED)))
    return F.transform(
        F.transform(dated, lambda h: trim_space(F.substring_index(h, PUBLISHED, -1))),
        lambda x: F.struct(x.alias("text"), F.try_to_timestamp(x, F.lit("dd/MM/yyyy")).cast("date").alias("date")),
    )


def _first(texts: Column) -> Column:
    """First text of an array that is not NULL."""
    return F.get(F.filter(texts, lambda e: e.isNotNull()), 0)


def extract_documents(
    pages: DataFrame,
    issuers: DataFrame,
    keep: Sequence[str] = ("doc_source", "db_id"),
    titles: Sequence[str] = LOGIN_TITLES,
    phrases: Sequence[str] = DEFAULT_PHRASES,
) -> DataFrame:
    """(…keep, doc_id, doc_date, title, page_error, described_from, tables): one row per page, whatever its state.

    ``pages`` has ``doc_source``, ``db_id`` and ``html``; ``issuers`` is (db_id, issuers array<text>), one row per database.
    ``page_error`` says why a page is no notice: NULL html, a login form, a foreign character in its title or headings, or a
    publication date that is none. A page without a date heading has a NULL ``doc_date`` and no error. Tables numbered
    ``described_from`` or more (from 0) follow a phrase that stands for the missing description column.
    """
    texts = notice_texts(pages, keep)
    known = texts.join(issuers.select("db_id", "issuers"), "db_id", "left")
    cleaned = known.withColumns({"_title": clean_text("title"), "_headings": clean_texts(F.col("headings"))})
    dated = cleaned.withColumn("_dates", _dates(F.col("_headings")))
    bad_date = F.get(F.filter("_dates", lambda d: d["date"].isNull()), 0)["text"]
    page_error = (
        F.when(F.col("title").isNull(), "unreadable page")
        .when(is_login("title", titles), "login page")
        .otherwise(
            F.coalesce(
                F.col("_title")["error"],
                _first(F.transform("_headings", lambda h: h["error"])),
                F.concat(F.lit('invalid publication date "'), bad_date, F.lit('"')),
            )
        )
    )
    described = F.transform("body", lambda b: default_description(b, phrases).isNotNull())
    return dated.select(
        *keep,
        _doc_id(F.lower(F.col("_title")["text"]), F.col("issuers")).alias("doc_id"),
        F.try_element_at(F.filter("_dates", lambda d: d["date"].isNotNull()), F.lit(-1))["date"].alias("doc_date"),
        "title",
        page_error.alias("page_error"),
        F.nullif(F.array_position(described, True), F.lit(0)).cast("int").alias("_place"),
        F.when(~is_login("title", titles), F.col("tables")).alias("tables"),
    ).select(*keep, "doc_id", "doc_date", "title", "page_error", (F.col("_place") - 1).alias("described_from"), "tables")


def _positions(props: Column) -> dict[str, Column]:
    """0-based column of each property, the last one when it is repeated; NULL when absent."""
    found = {p: F.array_position(F.reverse(props), p) for p in _READ}
    return {f"_i_{p}": F.when(n > 0, (F.size(props) - n).cast("int")) for p, n in found.items()}


def extract_rows(
    documents: DataFrame,
    headers: Mapping[str, Sequence[str]] = HEADERS,
    overrides: DataFrame | None = None,
) -> DataFrame:
    """One row per table row below a header: (…document, doc_error, table_no, record_id, cells, column positions).

    Each table has its own header; tables and the records of each count from 1. A document without such rows has one row with
    NULL ``record_id`` and ``cells``. ``overrides`` (doc_source, properties array<text>) names the columns of documents
    whose tables have no header row. ``doc_error`` is the page's error or that of its first faulty header; its rows stay, marked.
    ``cells`` are cleaned: array<struct(text, error)>.
    """
    docs = documents
    if overrides is None:
        docs = docs.withColumn("_given", F.lit(None).cast("array<string>"))
    else:
        docs = docs.join(overrides.select("doc_source", F.col("properties").alias("_given")), "doc_source", "left")
    given = F.col("_given")

    def named(head: Column, original: Column) -> Column:
        """Property of each header cell, or "?" and the cell."""
        return F.transform(
            head, lambda c, i: F.coalesce(map_header(c["text"], headers), F.concat(F.lit("?"), F.get(original, i)))
        )

    def part(rows: Column, number: Column) -> Column:
        first = F.coalesce(F.get(rows, 0), F.array().cast("array<string>"))
        return F.struct(
            (number + 1).alias("table_no"),
            F.coalesce(given, named(clean_texts(first), first)).alias("props"),
            F.when(number >= F.col("described_from"), F.lit(DEFAULT_DESCRIPTION)).alias("default_description"),
            F.when(given.isNotNull(), rows).otherwise(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1)))).alias("body"),
            (F.size(rows) > 0).alias("filled"),
        )

    def fault(t: Column) -> Column:
        unknown = F.get(F.filter(t["props"], lambda p: p.startswith("?")), 0)
        lacks_text = ~F.array_contains(t["props"], "description") & t["default_description"].isNull()
        return F.when(given.isNull() & t["filled"], F.when(
            unknown.isNotNull(), F.concat(F.lit('unknown property for header "'), F.substring(unknown, 2, 1 << 30), F.lit('"'))
        ).when(lacks_text, NO_DESCRIPTION_COLUMN))

    parts = docs.withColumn("_parts", F.transform("tables", part))
    checked = parts.withColumn("doc_error", F.coalesce("page_error", _first(F.transform("_parts", fault))))
    names = [c for c in checked.columns if c not in ("tables", "_given", "_parts", "page_error", "described_from")]
    # Tables without rows below their header give none, but their document keeps a row.
    filled = F.filter("_parts", lambda t: F.size(t["body"]) > 0)
    tables = checked.select(*names, F.explode_outer(filled).alias("_t"))
    props = F.col("_t")["props"]
    placed = tables.select(
        *names,
        F.col("_t")["table_no"].cast("int").alias("table_no"),
        F.col("_t")["default_description"].alias("default_description"),
        F.size(props).alias("_columns"),
        *[c.alias(n) for n, c in _positions(props).items()],
        F.posexplode_outer(F.transform(F.col("_t")["body"], clean_texts)).alias("_pos", "cells"),
    )
    return placed.withColumn("record_id", F.col("_pos") + 1).drop("_pos")


def extract_notices(
    pages: DataFrame,
    issuers: DataFrame,
    headers: Mapping[str, Sequence[str]] = HEADERS,
    overrides: DataFrame | None = None,
    tz: str = CIVIL_ZONE,
    compare: str = "time",
) -> DataFrame:
    """:func:`extract_records`, and for each document without records one row with NULL ``record_id``.

    This is what verdicts and metrics are taken from: it holds every document of ``pages``.
    """
    rows = extract_rows(extract_documents(pages, issuers), headers, overrides)
    return records_of_rows(rows, tz, compare)


def extract_records(
    pages: DataFrame,
    issuers: DataFrame,
    headers: Mapping[str, Sequence[str]] = HEADERS,
    overrides: DataFrame | None = None,
    tz: str = CIVIL_ZONE,
    compare: str = "time",
) -> DataFrame:
    """Typed records of notice pages, with the first error of each.

    One narrow job: pages are cut in Arrow batches, everything after that is column expressions. Columns: db_id, doc_id,
    doc_date, doc_source, table_no, record_id, offense_id, vehicle, country_hint, time, time_year, location, description, ur, error,
    doc_error.
    """
    return extract_notices(pages, issuers, headers, overrides, tz, compare).where("record_id is not null")


def records_of_rows(rows: DataFrame, tz: str = CIVIL_ZONE, compare: str = "time") -> DataFrame:
    """Cells to typed columns."""
    texts = {f"_t_{p}": F.coalesce(F.get("cells", F.col(f"_i_{p}"))["text"], F.lit("")) for p in _READ}
    staged = rows.withColumns(texts)
    parsed = staged.withColumns(
        {
            "_date": parse_offense_time("_t_time", tz),
            "_ur": parse_ur("_t_ur"),
            "_country": country_iso("_t_country"),
            "_plate": normalize_plate("_t_vehicle"),
        }
    )
    full = parse_offense_time(F.concat_ws(" ", "_t_time", "_t_hour"), tz)
    has_time = F.col("_i_time").isNotNull()
    timed = parsed.withColumn(
        "time",
        F.when(~has_time, civil_midnight("doc_date", tz)).when(
            F.col("_date").isNotNull() & (F.col("_t_hour") != ""), F.coalesce(full, F.col("_date"))
        ).otherwise(F.col("_date")),
    )

    def quoted(prefix: str, c: str) -> Column:
        return F.concat(F.lit(prefix + ' "'), F.col(c), F.lit('"'))

    def problem(position: Column, message: Column) -> Column:
        return F.when(message.isNotNull(), F.struct(position.cast("int").alias("at"), message.alias("message")))

    cell_errors = F.transform(
        "cells",
        lambda c, i: problem(
            i,
            F.coalesce(c["error"], F.when(i >= F.col("_columns"), F.concat(F.lit("no property for index "), i.cast("string")))),
        ),
    )
    parse_errors = F.array(
        problem(
            F.col("_i_time"),
            F.when((F.col("_t_time") != "") & F.col("_date").isNull(), quoted("couldn't parse datetime:", "_t_time")),
        ),
        problem(F.col("_i_ur"), F.col("_ur")["error"]),
        problem(
            F.col("_i_country"),
            F.when(F.col("_i_country").isNotNull() & F.col("_country").isNull(), quoted("unknown country:", "_t_country")),
        ),
    )
    first = F.array_min(F.filter(F.concat(cell_errors, parse_errors), lambda e: e.isNotNull()))
    located = F.when(
        (F.col("_t_locality") != "") & (F.col("_t_location") != ""), F.concat_ws(", ", "_t_location", "_t_locality")
    ).otherwise(F.col("_t_location"))
    described = F.when(
        F.col("_i_description").isNotNull() & (F.size("cells") > F.col("_i_description")), clean_description("_t_description")
    ).otherwise(F.col("default_description"))
    typed = timed.select(
        "db_id",
        "doc_id",
        "doc_date",
        "doc_source",
        "table_no",
        "record_id",
        null_if_empty("_t_id").alias("offense_id"),
        null_if_empty("_plate").alias("vehicle"),
        null_if_empty("_country").alias("country_hint"),
        "time",
        null_if_empty(located).alias("location"),
        null_if_empty(described).alias("description"),
        F.col("_ur")["value"].alias("ur"),
        first["message"].alias("error"),
        "doc_error",
    )
    checked = validate_records(typed, tz, compare).withColumn("time_year", civil_year("time", tz))
    return checked.withColumn("error", F.when(F.col("record_id").isNotNull(), F.col("error")))


def civil_year(time: Column | str, tz: str = CIVIL_ZONE) -> Column:
    """Year of an instant on the civil calendar, whatever the session zone."""
    time = F.col(time) if isinstance(time, str) else time
    return F.year(_civil(time, tz))


def _civil(time: Column, tz: str) -> Column:
    """Civil wall time of an instant."""
    return F.convert_timezone(F.current_timezone(), F.lit(tz), time.cast("timestamp_ntz"))


def validate_records(df: DataFrame, tz: str = CIVIL_ZONE, compare: str = "time") -> DataFrame:
    """Fill ``error`` with the first broken rule of records that have none yet.

    A publication without a date is older than every record. ``compare`` "time" holds a record of the publication day with a clock time to be newer than the publication;
    "date" compares days.
    """
    if compare not in ("time", "date"):
        raise ValueError('compare is "time" or "date"')
    earliest = civil_midnight(F.lit(EARLIEST).cast("date"), tz)
    published = civil_midnight("doc_date", tz)
    shown = F.date_format(_civil(F.col("time"), tz), "yyyy-MM-dd HH:mm:ss")
    newer = F.col("time") > published if compare == "time" else _civil(F.col("time"), tz).cast("date") > F.col("doc_date")
    newer = F.col("doc_date").isNull() | newer
    broken = (
        F.when(~F.coalesce(F.col("vehicle").rlike(PLATE), F.lit(False)), INVALID_PLATE)
        .when(F.col("time").isNull(), MISSING_TIME)
        .when(
            F.col("time") < earliest,
            F.concat(F.lit("la fecha `"), shown, F.lit(f"' es anterior a {EARLIEST}")),
        )
        .when(F.coalesce(F.col("description"), F.lit("")) == "", MISSING_DESCRIPTION)
        .when(
            newer,
            F.concat(
                F.lit("la fecha `"),
                shown,
                F.lit("' es más nueva que la fecha de publicación `"),
                F.coalesce(F.date_format("doc_date", "yyyy-MM-dd"), F.lit("")),
                F.lit("'"),
            ),
        )
    )
    return df.withColumn("error", F.coalesce(null_if_empty("error"), broken))


def document_verdicts(
    records: DataFrame,
    max_pct: float = MAX_ERROR_PERCENT,
    reviewed: DataFrame | None = None,
    skip_any_error: bool = False,
) -> DataFrame:
    """(db_id, doc_source, successes, errors, rejected) per document; ``rejected`` names the reason, NULL when fine.

    ``records`` are those of :func:`extract_notices`, whose rows with NULL ``record_id`` stand for documents without records.
    A document with a ``doc_error`` counts no records. Errors are measured against successes. ``reviewed`` lists documents
    (doc_source) allowed to have more.
    """
    whole = F.col("doc_error").isNull() if "doc_error" in records.columns else F.lit(True)
    counted = F.col("record_id").isNotNull() & whole if "record_id" in records.columns else whole
    bad = F.col("error").isNotNull()
    docs = records.groupBy("db_id", "doc_source").agg(
        F.count_if(counted & ~bad).alias("successes"),
        F.count_if(counted & bad).alias("errors"),
        F.max("doc_id").alias("_doc_id"),
        F.max("doc_error").alias("_doc_error") if "doc_error" in records.columns else F.lit(None).cast("string").alias("_doc_error"),
    )
    if reviewed is None:
        docs = docs.withColumn("_reviewed", F.lit(False))
    else:
        listed = reviewed.select("doc_source").distinct().withColumn("_listed", F.lit(True))
        docs = docs.join(listed, "doc_source", "left").withColumn("_reviewed", F.coalesce("_listed", F.lit(False)))
    too_many = (F.col("successes") > 0) & (F.col("errors") / F.col("successes") * 100 > max_pct) & ~F.col("_reviewed")
    reason = (
        F.when(F.col("_doc_error").isNotNull(), F.col("_doc_error"))
        .when((F.coalesce("_doc_id", F.lit("")) == "") & (F.col("successes") + F.col("errors") > 0), NO_DOCUMENT_ID)
        .when(too_many, "too many errors")
    )
    if skip_any_error:
        reason = reason.when(F.col("errors") > 0, "has errors")
    return docs.select("db_id", "doc_source", "successes", "errors", reason.alias("rejected"))


def quality_gate(records: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Records of the documents that were not rejected; rows that stand for documents without records are left out."""
    rejected = verdicts.where(F.col("rejected").isNotNull()).select("doc_source")
    kept = records.where("record_id is not null") if "record_id" in records.columns else records
    return kept.join(rejected, "doc_source", "left_anti").select(*records.columns)


def extract_metrics(verdicts: DataFrame) -> DataFrame:
    """(db_id, new_records, new_errors, successful_docs, failed_docs) per database and, with NULL db_id, in total."""
    return verdicts.rollup("db_id").agg(
        F.coalesce(F.sum("successes"), F.lit(0)).alias("new_records"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("new_errors"),
        F.count_if(F.col("rejected").isNull()).alias("successful_docs"),
        F.count_if(F.col("rejected").isNotNull()).alias("failed_docs"),
    )
