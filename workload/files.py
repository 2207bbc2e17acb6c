"""Queries that read files of every kind, written out of the given tables first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.functions.cells import cell_hex
from noticelake.functions.text import country_iso, drop_facing_number, null_if_zero, sanitize_location
from noticelake.sources import curation, documents
from noticelake.sources import offenses as src
from noticelake.storage import shared_dir
from workload import tables as t
from workload.registry import query

# Rows of a written file: by blocks of keys, so that no file grows with the tables.
ORDERS_PER_FILE, SUPPLIERS_PER_FILE = 4000, 200


def _fresh(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _files(rows: DataFrame, path: str, compression: str = "none") -> None:
    """One file of each row's ``value``."""
    rows.select("value").write.option("maxRecordsPerFile", 1).text(path, compression=compression)


@query(
    "offense_seed_files",
    t.with_tables(t.RAW_SQL)
    + """SELECT db_id, doc_id, doc_source, record_id, vehicle, time, location, ur, error, time_year,
      round(lng, 6) AS lng, round(lat, 6) AS lat, array_to_string(['T.' || p_type], '|') AS article_ids FROM raw""",
)
def offense_seed_files(spark, sf) -> DataFrame:
    """Offenses as JSON arrays of records, some thousand to a file, read back."""
    path, raw = _fresh(spark, "seed"), t.raw_offenses(spark, sf)
    record = F.struct(
        F.col("db_id").alias("repo_id"),
        "doc_id",
        F.date_format("doc_date", "yyyy-MM-dd'T'00:00:00'Z'").alias("doc_date"),
        F.col("doc_source").alias("doc_src"),
        # What the file calls a record's number is an int; the derived one is carried by the offense's id.
        F.lit(1).alias("record_id"),
        F.col("record_id").cast("string").alias("id"),
        "vehicle",
        F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"),
        "location",
        F.coalesce("description", F.lit("")).alias("description"),
        "ur",
        F.coalesce("error", F.lit("")).alias("error"),
        F.when(F.col("point").isNotNull(), F.struct("point.lat", "point.lng")).alias("point"),
        F.array(F.concat(F.lit("T."), F.col("p_type"))).alias("article_id"),
    )
    block = F.floor(F.col("doc_id").cast("long") / ORDERS_PER_FILE)
    _files(raw.groupBy(block.alias("block")).agg(F.to_json(F.collect_list(record)).alias("value")), path, "gzip")
    got = src.read_offense_json(spark, path)
    return got.select(
        "db_id",
        "doc_id",
        "doc_source",
        F.col("offense_id").cast("long").alias("record_id"),
        "vehicle",
        F.col("time").cast("timestamp_ntz").alias("time"),
        "location",
        "ur",
        "error",
        "time_year",
        F.round("point.lng", 6).alias("lng"),
        F.round("point.lat", 6).alias("lat"),
        F.array_join("article_ids", "|").alias("article_ids"),
    )


def _block(key: str):
    return F.floor(F.col(key) / SUPPLIERS_PER_FILE).alias("block")


@query(
    "judgment_files",
    t.with_tables(t.LOCATIONS_SQL)
    + """SELECT db_id, location, geocoding_method, '1.' || (id // 200) AS version, printf('%x', h3_res8) AS cell FROM locations
      WHERE db_id < 20""",
)
def judgment_files(spark, sf) -> DataFrame:
    """Versioned judgment files, with flat coordinates or points, seeded into an empty table, and written as lines."""
    rows = t.locations(spark, sf)
    flat = F.col("id") % 2 == 0
    judged = F.struct(
        "db_id", "location", "geocoding_method", "confidence", "is_electronic", "created_at",
        F.when(flat, F.col("point.lat")).alias("latitude"), F.when(flat, F.col("point.lng")).alias("longitude"),
        F.when(~flat, F.col("point")).alias("point"),
    )
    held = rows.groupBy(_block("id")).agg(F.collect_list(judged).alias("judgments"))
    path, lines = _fresh(spark, "judgments"), _fresh(spark, "judgment-lines")
    version = F.concat(F.lit("1."), F.col("block").cast("string")).alias("version")
    stamp = F.lit("2024-01-01T00:00:00Z").alias("last_updated")
    _files(held.select(F.to_json(F.struct(version, stamp, "judgments")).alias("value")), path)
    seed = curation.read_judgments(spark, path)
    stored = curation.seed_judgments(seed.where("false"), seed.where("db_id < 20"))
    # One that is there already keeps the seed out.
    again = curation.seed_judgments(stored, seed)
    curation.write_judgments(again.withColumn("notes", F.col("version")), lines)
    got = curation.read_judgments(spark, lines)
    return got.select("db_id", "location", "geocoding_method", F.col("notes").alias("version"), cell_hex("h3_res8").alias("cell"))


@query(
    "bundle_files",
    t.with_tables(t.LOCATIONS_SQL, t.ARTICLES_SQL)
    + """SELECT 'article' AS kind, id AS key, text AS value FROM articles
    UNION ALL SELECT 'location', db_id || ' ' || location, printf('%x', h3_res8) FROM locations""",
)
def bundle_files(spark, sf) -> DataFrame:
    """Curation bundles of one JSON object a file: one of articles per title, and one of locations per block."""
    path = _fresh(spark, "bundles")
    articles = t.articles(spark, sf).groupBy("title").agg(F.collect_list(F.struct("id", "text", "code", "title")).alias("articles"))
    located = t.locations(spark, sf)
    locations = located.groupBy(_block("id")).agg(F.collect_list(F.struct("db_id", "location", "point")).alias("locations"))
    _files(
        articles.select(F.to_json(F.struct("articles")).alias("value")).unionByName(
            locations.select(F.to_json(F.struct("locations")).alias("value"))
        ),
        path,
    )
    articles, _, locations = curation.read_curation(spark, path)
    return articles.select(F.lit("article").alias("kind"), F.col("id").alias("key"), F.col("text").alias("value")).unionByName(
        locations.select(
            F.lit("location").alias("kind"),
            F.concat_ws(" ", F.col("db_id").cast("string"), "location").alias("key"),
            cell_hex("h3_res8").alias("value"),
        )
    )


@query(
    "radar_layers",
    f"""SELECT s_suppkey::INT AS ruta, (s_suppkey % 40) || 'k' || lpad((s_suppkey % 1000)::VARCHAR, 3, '0') AS progresiva,
      s_name AS descrip, round({t._LNG_SQL}, 6) AS lng, round({t._LAT_SQL}, 6) AS lat FROM supplier""",
)
def radar_layers(spark, sf) -> DataFrame:
    """GeoJSON layers in which each radar comes twice, first under its old name and in a longer spelling."""
    path, rows = _fresh(spark, "radars"), t.table(spark, sf, "supplier")

    def feature(name, marker):
        properties = F.struct(
            F.col("s_suppkey").cast("int").alias("ruta"), marker.alias("progresiva"), F.lit("MTOP").alias("gestion"), name.alias("descrip")
        )
        place = F.struct(F.array(F.expr(t.LNG), F.expr(t.LAT)).alias("coordinates"))
        return F.struct(place.alias("geometry"), properties.alias("properties"))

    metres = F.expr("lpad(cast(s_suppkey % 1000 as string), 3, '0')")
    old = feature(F.lit("old"), F.concat(F.expr("lpad(cast(s_suppkey % 40 as string), 3, '0')"), F.lit("K"), metres))
    new = feature(F.col("s_name"), F.concat(F.expr("cast(s_suppkey % 40 as string)"), F.lit("k"), metres))
    held = rows.groupBy(_block("s_suppkey")).agg(F.flatten(F.collect_list(F.array(old, new))).alias("features"))
    _files(held.select(F.to_json(F.struct("features")).alias("value")), path)
    got = curation.read_radars(spark, path)
    return got.select("ruta", "progresiva", "descrip", F.round("point.lng", 6).alias("lng"), F.round("point.lat", 6).alias("lat"))


_FORMS = {"utf-8": ("UTF-8", "none"), "utf-8 gzip": ("UTF-8", "gzip"), "cp1252": ("ISO-8859-1", "none"), "cp1252 gzip": ("ISO-8859-1", "gzip")}


@query(
    "encoded_documents",
    """SELECT s_suppkey // 200 AS number, f.form, split_part(f.form, ' ', 1) AS charset,
      string_agg('<tr><td>Ñandú n° ' || s_name || ' </td></tr>' || chr(10), '' ORDER BY s_suppkey) AS html
    FROM supplier, (VALUES ('utf-8'), ('utf-8 gzip'), ('cp1252'), ('cp1252 gzip')) f(form) GROUP BY ALL""",
)
def encoded_documents(spark, sf) -> DataFrame:
    """Pages of suppliers stored in two charsets, plain and compressed, read without being told which."""
    path, rows = _fresh(spark, "pages"), t.table(spark, sf, "supplier").withColumn("block", _block("s_suppkey"))
    lines = rows.select("block", "s_suppkey", F.concat(F.lit("<tr><td>Ñandú n° "), "s_name", F.lit(" </td></tr>")).alias("line"))
    plain = {"header": False, "sep": "\u0001", "quote": "", "ignoreTrailingWhiteSpace": False}
    for form, (charset, packed) in _FORMS.items():
        dealt = t.dealt(lines, "block").sortWithinPartitions("block", "s_suppkey")
        dealt.select("block", "line").write.partitionBy("block").options(**plain, encoding=charset, compression=packed).csv(f"{path}/{form.replace(' ', '_')}")
    got = documents.read_stored_documents(spark, path, files="part-*")
    return got.select(
        F.regexp_extract("path", "block=([0-9]+)", 1).cast("long").alias("number"),
        F.replace(F.regexp_extract("path", "/([a-z0-9_-]+)/block=", 1), F.lit("_"), F.lit(" ")).alias("form"),
        "charset",
        "html",
    )


@query(
    "folded_names",
    """SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'UY' WHEN 1 THEN 'AR' WHEN 2 THEN 'BR' WHEN 3 THEN 'PY' WHEN 4 THEN 'CL' WHEN 5 THEN '' END AS iso,
      c_name || ' 12' AS location, c_name || ' ' || c_custkey AS address, nullif(c_custkey % 3, 0) AS ur FROM customer""",
)
def folded_names(spark, sf) -> DataFrame:
    """Country names in several spellings, trimmed locations, rewritten addresses, zeros as NULL."""
    named = "element_at(array(' URUGUAY', 'Argentina ', 'brasil', 'ParaGuay', 'Chile', 'OTRO', 'Atlantis'), cast(c_custkey % 7 + 1 as int))"
    key = F.col("c_custkey").cast("string")
    return t.table(spark, sf, "customer").select(
        "c_custkey",
        country_iso(F.expr(named)).alias("iso"),
        sanitize_location(F.concat(F.lit(" \t"), "c_name", F.lit(" 12\n "))).alias("location"),
        drop_facing_number(F.concat("c_name", F.lit(" Frente  al N° "), key)).alias("address"),
        null_if_zero(F.col("c_custkey") % 3).alias("ur"),
    )
