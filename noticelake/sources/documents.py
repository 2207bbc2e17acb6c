"""Notice documents and their catalogue."""

from __future__ import annotations

import codecs
import re
import zlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.functions.text import _col

# Document addresses by database: the part that names the issuer, tried in order, and the kinds it publishes
# (fixed values).
ISSUER_PATHS: dict[int, tuple[str, ...]] = {
    65: ("policia-caminera",),
    40: ("transito-canelones",),
    48: ("transito-colonia",),
    26: ("transito-lavalleja",),
    45: ("transito-maldonado", "transito-movilidad-maldonado"),
    6: ("cgm",),
    43: ("transito-paysandu",),
    55: ("transito-rionegro",),
    49: ("transito-soriano",),
    56: ("transito-tacuarembo",),
    52: ("transito-treintaytres",),
    68: ("transito-mtop",),
}
NOTICES_ONLY = (56, 52)
# End of fixed values.

# Folder of stored documents: <database>/<kind>/<year>/<number>.html.gz
_PATH = r"/([^/]+)/([^/]+)/([0-9]+)/([^/]+?)\.html(?:\.gz)?$"


def read_documents(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(path, database, kind, year, number, html): one row per stored document, gzip decoded by the reader.

    The database is the folder name the documents were stored under.
    """
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.html*")
    source = F.input_file_name()
    if encoding.lower() != "utf-8":
        raise ValueError("whole documents are read as UTF-8; use read_stored_documents")
    return _keyed(rows.select(source.alias("path"), F.col("value").alias("html")))


def read_encoded_documents(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """As :func:`read_documents` for plain (not gzip) files in another encoding."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").load(path)
    return _keyed(files.select("path", F.decode("content", encoding).alias("html")))


# How pages state their charset, and in how many of their first bytes (fixed values).
_DECLARED = re.compile(rb"""charset\s*=\s*["']?\s*([A-Za-z0-9_.:\-]+)""", re.IGNORECASE)
_DECLARED_WITHIN = 1024
_MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
# Charsets that pages of this name really use (fixed values).
_MEANT = {"iso8859-1": "cp1252", "ascii": "cp1252"}
# End of fixed values.


def unpacked(content: bytes) -> bytes | None:
    """The content, decompressed when it is gzip of one or several members; NULL when it is cut short or damaged."""
    whole = []
    while content.startswith(b"\x1f\x8b"):
        member = zlib.decompressobj(wbits=31)
        try:
            whole.append(member.decompress(content))
        except zlib.error:
            return None
        if not member.eof:
            return None
        content = member.unused_data
        if not content.strip(b"\0"):
            return b"".join(whole)
    return content if not whole else None


def decoded(content: bytes, charset: str | None = None) -> tuple[str, str]:
    """Text and the charset it was read by: the given one, a byte order mark's, the page's own, UTF-8, or windows-1252.

    The first that fits every byte; bytes no charset has are kept as ISO-8859-1 reads them.
    """
    stated = _DECLARED.search(content[:_DECLARED_WITHIN])
    marked = next((name for mark, name in _MARKS if content.startswith(mark)), None)
    for name in (charset, marked, stated and stated[1].decode("ascii"), "utf-8", "cp1252"):
        try:
            known = codecs.lookup(name).name if name else None
            if known:
                known = _MEANT.get(known, known)
                return codecs.decode(content, known), known
        except (LookupError, UnicodeError):
            continue
    return content.decode("latin-1"), "iso8859-1"


def read_stored_documents(
    spark: SparkSession, path: str, charset: str | None = None, files: str = "*.html*"
) -> DataFrame:
    """As :func:`read_documents`, plain or gzip told by content, with ``charset``: each document in a charset of its own.

    ``charset`` given is tried first. A damaged gzip file is a row with NULL ``html`` and ``charset``; a file
    of no bytes is no row, as Spark passes over those.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, content in enumerate(batch.column("content")):  # one document in memory at a time
                raw = unpacked(content.as_py())
                html, name = (None, None) if raw is None else decoded(raw, charset)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("path").slice(at, 1), pa.array([html], pa.string()), pa.array([name], pa.string())],
                    names=["path", "html", "charset"],
                )

    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", files).load(path)
    rows = found.select("path", "content").mapInArrow(read, "path string, html string, charset string")
    return _keyed(rows, "charset")


def _keyed(files: DataFrame, *more: str) -> DataFrame:
    part = {n: F.regexp_extract("path", _PATH, i) for i, n in enumerate(("database", "kind", "year", "number"), 1)}
    return files.select(
        "path", part["database"].alias("database"), part["kind"].alias("kind"), part["year"].try_cast("int").alias("year"),
        part["number"].alias("number"), "html", *more,
    )


def document_key(
    c: Column | str, paths: Mapping[int, Sequence[str]] = ISSUER_PATHS, notices_only: Sequence[int] = NOTICES_ONLY
) -> Column:
    """struct(db_id, kind, year, number) of a document address; NULL when no pattern fits.

    The first fitting pattern wins; a suffix stays with the number, as in ``31_A``.
    """
    path = F.regexp_replace(_col(c), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*|[?#].*$", "")
    chain = None
    for db_id, issuers in paths.items():
        kinds = "notificaciones" if db_id in notices_only else "resoluciones|notificaciones"
        for issuer in issuers:
            pattern = rf"^/bases/({kinds})-{issuer}/([0-9A-Za-z]+)-([0-9]+)(?:_([A-Z]))?$"
            suffix = F.regexp_extract(path, pattern, 4)
            key = F.struct(
                F.lit(db_id).alias("db_id"),
                F.regexp_extract(path, pattern, 1).alias("kind"),
                F.regexp_extract(path, pattern, 3).try_cast("int").alias("year"),
                F.concat(
                    F.regexp_extract(path, pattern, 2), F.when(suffix != "", F.concat(F.lit("_"), suffix)).otherwise("")
                ).alias("number"),
            )
            fits = path.rlike(pattern)
            chain = F.when(fits, key) if chain is None else chain.when(fits, key)
    return chain


def merge_catalogue(existing: DataFrame, found: DataFrame) -> DataFrame:
    """Catalogue with the entries of unseen ``href`` added; known ones are never overwritten. ``is_new`` marks additions."""
    rest = [c for c in existing.columns if c != "href"]
    # Of several unseen entries of one address, one is kept; grouping combines them map-side.
    once = found.groupBy("href").agg(F.min(F.struct(*rest)).alias("_e")).select(
        "href", *[F.col("_e")[c].alias(c) for c in rest]
    )
    unseen = once.join(existing.select("href"), "href", "left_anti")
    return existing.withColumn("is_new", F.lit(False)).unionByName(unseen.withColumn("is_new", F.lit(True)))


def missing_documents(catalogue: DataFrame, stored: DataFrame) -> DataFrame:
    """Catalogue entries without stored document."""
    return catalogue.join(stored.select(F.col("doc_source").alias("href")), "href", "left_anti")


def existing_documents(catalogue: DataFrame, stored: DataFrame) -> DataFrame:
    """Catalogue entries with a stored document."""
    return catalogue.join(stored.select(F.col("doc_source").alias("href")), "href", "left_semi")


def pending_documents(stored: DataFrame, offenses: DataFrame, full: bool = False) -> DataFrame:
    """Stored documents not yet in the offense table of their database; all of them when ``full``."""
    if full:
        return stored
    # Distinct before the join: a document with very many records is one row in it.
    done = offenses.select("db_id", "doc_source").distinct()
    return stored.join(done, ["db_id", "doc_source"], "left_anti")
