"""From stored documents to enriched records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from noticelake.functions.plates import with_vehicle
from noticelake.operators.enrich import classify_multipart, enrich_location
from noticelake.operators.extract import document_verdicts, extract_metrics, extract_notices, quality_gate
from noticelake.schema import CELL_COLUMNS, OFFENSES
from noticelake.sources.documents import pending_documents
from noticelake.storage import checkpoint
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ingested:
    """Records to store, the verdict on each document, and counts per database."""

    records: DataFrame
    verdicts: DataFrame
    metrics: DataFrame


def enrich_records(records: DataFrame, locations: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Extracted records in the columns of the offense table, with vehicle, location and article facts."""
    types = {f.name: f.dataType for f in OFFENSES.fields}
    blank = {
        c: F.lit(None).cast(types[c]) for c in ("display_location", "point", *CELL_COLUMNS, "article_ids", "article_codes")
    }
    placed = enrich_location(with_vehicle(records, hint="country_hint").withColumns(blank), locations)
    return classify_multipart(placed, descriptions).select(*OFFENSES.fieldNames())


def ingest(
    documents: DataFrame,
    issuers: DataFrame,
    locations: DataFrame,
    descriptions: DataFrame,
    stored: DataFrame | None = None,
    full: bool = False,
    overrides: DataFrame | None = None,
    reviewed: DataFrame | None = None,
    skip_any_error: bool = False,
) -> Ingested:
    """Extract the pending documents, drop those failing the quality gate, enrich the rest.

    Extraction is stored once: the gate, the counts and the records all read it, and pages are parsed a single time.
    """
    pending = documents if stored is None else pending_documents(documents, stored, full)
    extracted = checkpoint(extract_notices(pending, issuers, overrides=overrides))
    verdicts = document_verdicts(extracted, reviewed=reviewed, skip_any_error=skip_any_error)
    passed = quality_gate(extracted, verdicts).drop("doc_error")
    return Ingested(enrich_records(passed, locations, descriptions), verdicts, extract_metrics(verdicts))
