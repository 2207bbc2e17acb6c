"""Curation queries: enrichment, classification, suggestions, queues, radars and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.functions import geo, plates, text
from noticelake.operators import clustering, enrich, geocoding, queues, similarity
from workload import tables as t
from workload.h3_sql import h3_sql
from workload.registry import query

W = t.with_tables
FOLD = "strip_accents(lower(trim({0})))"


def _list(name: str, alias: str | None = None):
    return F.array_join(F.col(name).cast("array<string>"), "|").alias(alias or name)


# --- plates and text -------------------------------------------------------------------------------------------------


@query(
    "plate_facts",
    W(t.OFFENSES_SQL)
    + f""", p AS (SELECT DISTINCT vehicle AS plate FROM offenses),
    i AS (SELECT plate, coalesce({t.PLATE_COUNTRY_SQL.format(v='plate')}, '') AS country,
      coalesce({t.PLATE_TYPE_SQL.format(v='plate')}, '') AS vehicle_type FROM p)
    SELECT plate, country,
      CASE WHEN country = 'UY' THEN CASE WHEN plate BETWEEN 'A' AND 'SZZZZZZ' THEN plate[1] ELSE 'S' END ELSE '' END AS adm_division,
      vehicle_type,
      CASE WHEN regexp_full_match(plate, '[A-Z]{{3}}[0-9]{{4}}') THEN coalesce(map {{'DI': 'Discapacidad', 'ME': 'Medico',
          'CC': 'Cuerpo Consular', 'CD': 'Cuerpo Diplomático', 'OI': 'Misión Especial',
          'AT': 'Admisión Temporaria - Administrativos y Técnicos', 'NG': 'Misión Especial', 'OF': 'Oficial',
          'PJ': 'Poder Judicial', 'AM': 'Ambulancia', 'RE': 'Remise', 'TX': 'Taxi'}}[plate[2:3]], '')
        WHEN country = 'CL' THEN coalesce(map {{'CC': 'Cuerpo Consular', 'CD': 'Cuerpo Diplomático', 'EE': 'Misión Especial'}}[plate[1:2]], '')
        ELSE '' END AS category,
      regexp_full_match(plate, '[A-Z]{{3}}[0-9]{{4}}|[A-Z]{{2}}[0-9]{{3}}[A-Z]{{2}}|[A-Z][0-9]{{3}}[A-Z]{{3}}|[A-Z]{{3}}[0-9][A-Z][0-9]{{2}}|[A-Z]{{4}}[0-9]{{3}}|[0-9]{{3}}[A-Z]{{4}}') AS mercosur_format,
      CASE WHEN country = '' THEN 'no info available' END AS error
    FROM i""",
)
def plate_facts(spark, sf) -> DataFrame:
    return plates.plate_report(t.offenses(spark, sf))


@query(
    "folded_texts",
    f"""SELECT doc_id, md5(trim(regexp_replace({FOLD.format('text')}, '\\s+', ' ', 'g'))) AS folded,
      length(regexp_replace({FOLD.format('text')}, '[^a-z0-9]', '', 'g')) AS letters FROM documents""",
)
def folded_texts(spark, sf) -> DataFrame:
    folded = text.fold("text")
    return t.table(spark, sf, "documents").select(
        "doc_id",
        F.md5(F.trim(F.regexp_replace(folded, r"\s+", " "))).alias("folded"),
        F.length(F.regexp_replace(folded, "[^a-z0-9]", "")).alias("letters"),
    )


@query(
    "plates_normalised",
    """SELECT c_custkey, upper(regexp_replace(c_mktsegment || '-' || c_custkey || ' (E)', '[\\s-]', '', 'g'))[:-4] AS plate,
      upper(replace(lower(c_name), ' ', '')) AS searched,
      regexp_replace(c_name, '[^A-Za-z]', '', 'g').lower() AS header FROM customer""",
)
def plates_normalised(spark, sf) -> DataFrame:
    marked = F.concat(F.lower("c_mktsegment"), F.lit("-"), F.col("c_custkey").cast("string"), F.lit(" (E)"))
    return t.table(spark, sf, "customer").select(
        "c_custkey",
        text.normalize_plate(marked).alias("plate"),
        text.normalize_plate_query(F.lower("c_name")).alias("searched"),
        text.normalize_header("c_name").alias("header"),
    )


# --- enrichment ------------------------------------------------------------------------------------------------------

_NAMED = "named AS (SELECT * FROM locations WHERE coalesce(canonical_location, '') <> '')"


@query(
    "enrich_location",
    W(t.OFFENSES_SQL, t.LOCATIONS_SQL, _NAMED)
    + """SELECT coalesce(n.canonical_location, o.location) AS location,
      CASE WHEN n.id IS NOT NULL THEN o.location END AS display_location,
      printf('%x', n.h3_res8) AS cell, count(*) AS records
    FROM offenses o LEFT JOIN named n ON n.db_id = o.db_id AND n.location = o.location GROUP BY ALL""",
)
def enrich_location(spark, sf) -> DataFrame:
    out = enrich.enrich_location(t.bare_offenses(spark, sf), t.locations(spark, sf))
    return out.groupBy("location", "display_location", F.lower(F.hex("h3_res8")).alias("cell")).agg(
        F.count(F.lit(1)).alias("records")
    )


@query(
    "backfill_geocoding",
    W(t.OFFENSES_SQL, t.LOCATIONS_SQL, _NAMED)
    + """, renamed AS (
      SELECT o.db_id, coalesce(n.canonical_location, o.location) AS location,
        CASE WHEN n.id IS NOT NULL THEN o.location END AS display_location, n.id IS NOT NULL AS renamed
      FROM offenses o LEFT JOIN named n ON n.db_id = o.db_id AND n.location = o.location)
    SELECT r.db_id, r.location, r.display_location, r.renamed, l.id IS NOT NULL AS geocoded,
      round(l.lng, 6) AS lng, round(l.lat, 6) AS lat, printf('%x', l.h3_res5) AS cell5, count(*) AS records
    FROM renamed r LEFT JOIN locations l ON l.db_id = r.db_id AND l.location = r.location GROUP BY ALL""",
)
def backfill_geocoding(spark, sf) -> DataFrame:
    out = enrich.backfill_geocoding(t.bare_offenses(spark, sf), t.locations(spark, sf))
    return out.groupBy(
        "db_id",
        "location",
        "display_location",
        "renamed",
        "geocoded",
        F.round("point.lng", 6).alias("lng"),
        F.round("point.lat", 6).alias("lat"),
        F.lower(F.hex("h3_res5")).alias("cell5"),
    ).agg(F.count(F.lit(1)).alias("records"))


_KNOWN = f"""known AS (
  SELECT {FOLD.format('description')} AS key, arg_max(article_ids, (updated_s, description)) AS ids,
    arg_max(article_codes, (updated_s, description)) AS codes FROM descriptions GROUP BY 1)"""


@query(
    "classify_exact",
    W(t.OFFENSES_SQL, t.DESCRIPTIONS_SQL, _KNOWN)
    + f"""SELECT doc_source, record_id, array_to_string(k.ids, '|') AS article_ids, array_to_string(k.codes, '|') AS article_codes
    FROM offenses o LEFT JOIN known k ON k.key = {FOLD.format('o.description')}""",
)
def classify_exact(spark, sf) -> DataFrame:
    out = enrich.classify_exact(t.bare_offenses(spark, sf), t.descriptions(spark, sf))
    return out.select("doc_source", "record_id", _list("article_ids"), _list("article_codes"))


_PARTS = f"""texts AS (SELECT DISTINCT description FROM offenses),
parts AS (SELECT description, generate_subscripts(p, 1) AS pos, trim(unnest(p)) AS part
  FROM (SELECT description, list_filter(string_split(description, ','), lambda x: trim(x) <> '') AS p FROM texts)),
looked AS (SELECT description, pos, part, k.ids, k.codes, k.key IS NOT NULL AS found
  FROM parts LEFT JOIN known k ON k.key = {FOLD.format('part')}),
resolved AS (SELECT description, count(*) AS parts, bool_and(found) AS all_found,
  flatten(list(ids ORDER BY pos)) AS ids, flatten(list(codes ORDER BY pos)) AS codes FROM looked GROUP BY description)"""


@query(
    "resolve_parts",
    W(t.OFFENSES_SQL, t.DESCRIPTIONS_SQL, _KNOWN, _PARTS)
    + """SELECT description, parts, all_found, CASE WHEN all_found THEN array_to_string(ids, '|') END AS article_ids,
      CASE WHEN all_found THEN array_to_string(codes, '|') END AS article_codes FROM resolved""",
)
def resolve_parts(spark, sf) -> DataFrame:
    out = enrich.resolve_parts(t.offenses(spark, sf), t.descriptions(spark, sf))
    return out.select("description", "parts", "all_found", _list("article_ids"), _list("article_codes"))


@query(
    "classify_multipart",
    W(t.OFFENSES_SQL, t.DESCRIPTIONS_SQL, _KNOWN, _PARTS)
    + f"""SELECT o.db_id, array_to_string(coalesce(k.ids, CASE WHEN r.all_found THEN r.ids END), '|') AS article_ids,
      array_to_string(coalesce(k.codes, CASE WHEN r.all_found THEN r.codes END), '|') AS article_codes, count(*) AS records
    FROM offenses o LEFT JOIN known k ON k.key = {FOLD.format('o.description')}
    LEFT JOIN resolved r ON r.description = o.description GROUP BY ALL""",
)
def classify_multipart(spark, sf) -> DataFrame:
    out = enrich.classify_multipart(t.bare_offenses(spark, sf), t.descriptions(spark, sf))
    return out.groupBy("db_id", _list("article_ids"), _list("article_codes")).agg(F.count(F.lit(1)).alias("records"))


@query(
    "backport_articles",
    W(t.OFFENSES_SQL, t.DESCRIPTIONS_SQL, _KNOWN, _PARTS)
    + """SELECT o.description, array_to_string(CASE WHEN o.article_ids IS NOT NULL THEN o.article_ids
        WHEN d.description IS NOT NULL THEN d.article_ids WHEN r.all_found AND contains(o.description, ',') THEN r.ids END, '|') AS article_ids,
      CASE WHEN o.article_ids IS NOT NULL THEN NULL WHEN d.description IS NOT NULL THEN 'exact'
        WHEN r.all_found AND contains(o.description, ',') THEN 'parts' END AS backported,
      count(*) AS records
    FROM offenses o LEFT JOIN descriptions d ON d.description = o.description
    LEFT JOIN resolved r ON r.description = o.description GROUP BY ALL""",
)
def backport_articles(spark, sf) -> DataFrame:
    out = enrich.backport_articles(t.offenses(spark, sf), t.descriptions(spark, sf))
    return out.groupBy("description", _list("article_ids"), "backported").agg(F.count(F.lit(1)).alias("records"))


@query(
    "codes_of_ids",
    W(t.OFFENSES_SQL, t.ARTICLES_SQL)
    + """, ids AS (SELECT p_partkey, generate_subscripts(x, 1) AS pos, unnest(x) AS id
      FROM (SELECT p_partkey, ['B.' || substr(p_brand, 7), 'T.' || p_type, 'X.' || p_size, 'B.' || (p_size % 25)] AS x FROM part)),
    coded AS (SELECT p_partkey, pos, ids.id, code FROM ids LEFT JOIN articles USING (id)),
    firsts AS (SELECT p_partkey, code, min(pos) AS pos FROM coded WHERE code IS NOT NULL GROUP BY ALL)
    SELECT p_partkey, (SELECT string_agg(code, '|' ORDER BY pos) FROM firsts f WHERE f.p_partkey = c.p_partkey) AS article_codes,
      coalesce(string_agg(id, '|' ORDER BY pos) FILTER (code IS NULL), '') AS unknown_ids
    FROM coded c GROUP BY p_partkey""",
)
def codes_of_ids(spark, sf) -> DataFrame:
    part = t.table(spark, sf, "part").select(
        "p_partkey",
        F.expr(
            """array(concat('B.', substring(p_brand, 7)), concat('T.', p_type), concat('X.', cast(p_size as string)),
                 concat('B.', cast(p_size % 25 as string)))"""
        ).alias("article_ids"),
    )
    out = enrich.codes_for_ids(part, t.articles(spark, sf), "p_partkey")
    return out.select("p_partkey", _list("article_codes"), _list("unknown_ids"))


@query(
    "upsert_descriptions",
    W(t.DESCRIPTIONS_SQL)
    + """, incoming AS (SELECT DISTINCT p_name AS description, ['N.1'] AS ids FROM part WHERE length(p_name) > 9)
    SELECT description, array_to_string(ids, '|') AS article_ids FROM incoming
    UNION ALL SELECT description, array_to_string(article_ids, '|') FROM descriptions
    WHERE description NOT IN (SELECT description FROM incoming)""",
)
def upsert_descriptions(spark, sf) -> DataFrame:
    incoming = t.table(spark, sf, "part").where("length(p_name) > 9").select(
        F.col("p_name").alias("description"),
        F.array(F.lit("N.1")).alias("article_ids"),
        F.array(F.lit(1)).alias("article_codes"),
        F.timestamp_seconds(F.lit(t.EPOCH)).alias("updated_at"),
    ).distinct()
    out = enrich.upsert_descriptions(t.descriptions(spark, sf), incoming)
    return out.select("description", _list("article_ids"))


@query(
    "article_seeding",
    W(t.ARTICLES_SQL)
    + """, incoming AS (SELECT 'B.' || n_nationkey AS id, n_name AS text, n_regionkey AS code, 'Nation' AS title FROM nation)
    SELECT 'seed' AS how, * FROM articles
    UNION ALL SELECT 'seed', * FROM incoming WHERE id NOT IN (SELECT id FROM articles)
    UNION ALL SELECT 'upsert', * FROM incoming
    UNION ALL SELECT 'upsert', * FROM articles WHERE id NOT IN (SELECT id FROM incoming)""",
)
def article_seeding(spark, sf) -> DataFrame:
    incoming = t.table(spark, sf, "nation").select(
        F.concat(F.lit("B."), F.col("n_nationkey").cast("string")).alias("id"),
        F.col("n_name").alias("text"),
        F.col("n_regionkey").alias("code"),
        F.lit("Nation").alias("title"),
    )
    stored = t.articles(spark, sf)
    seeded = enrich.seed_articles(stored, incoming).withColumn("how", F.lit("seed"))
    return seeded.unionByName(enrich.upsert_articles(stored, incoming).withColumn("how", F.lit("upsert")))


# --- suggestions -----------------------------------------------------------------------------------------------------


def _vector_sql(name: str, source: str, key: str, body: str) -> str:
    return f"""{name}_w AS (SELECT {key} AS k, unnest(regexp_split_to_array(
        regexp_replace({FOLD.format(body)}, '[^a-zA-Z0-9\\s]', '', 'g'), '\\s+')) AS w FROM {source}),
    {name}_c AS (SELECT k, w, count(*) AS c FROM {name}_w WHERE w <> '' GROUP BY ALL),
    {name} AS (SELECT k, w, c, sqrt(sum(c * c) OVER (PARTITION BY k)) AS n FROM {name}_c)"""


def _cosine_sql(a: str, b: str, threshold: float) -> str:
    return f"""(SELECT a.k AS a, b.k AS b, sum(a.c * b.c) / (a.n * b.n) AS score FROM {a} a JOIN {b} b USING (w)
      GROUP BY a.k, b.k, a.n, b.n HAVING sum(a.c * b.c) / (a.n * b.n) >= {threshold})"""


@query(
    "cosine_texts",
    "WITH "
    + _vector_sql("d", "documents", "doc_id", "text")
    + ", "
    + _vector_sql("b", "benchmark", "item_id", "text")
    + " SELECT a AS doc_id, b AS article_id, round(score, 6) AS score FROM "
    + _cosine_sql("d", "b", 0.5),
)
def cosine_texts(spark, sf) -> DataFrame:
    out = similarity.cosine_matches(
        t.dealt(t.table(spark, sf, "documents"), "doc_id"),
        t.table(spark, sf, "benchmark"),
        0.5,
        key="doc_id",
        text="text",
        article_key="item_id",
    )
    return out.withColumn("score", F.round("score", 6))


# Suggestions for a set of texts ``x(text)``: known texts first, cosine for the rest.
_SUGGEST = (
    f""", exact AS (SELECT x.text, d.article_ids AS ids FROM x JOIN descriptions d ON d.description = x.text),
    by_fold AS (SELECT x.text, f.ids FROM x JOIN (SELECT {FOLD.format('description')} AS key, arg_max(article_ids, description) AS ids
      FROM descriptions GROUP BY 1) f ON f.key = {FOLD.format('x.text')} WHERE x.text NOT IN (SELECT text FROM exact)),
    known_x AS (SELECT * FROM exact UNION ALL SELECT * FROM by_fold),
    rest AS (SELECT text FROM x WHERE text NOT IN (SELECT text FROM known_x)), """
    + _vector_sql("xv", "rest", "text", "text")
    + ", "
    + _vector_sql("av", "articles", "id", "text")
    + """, found AS (
      SELECT k.text, k.id AS article_id, 1.0::DOUBLE AS score FROM (SELECT text, unnest(ids) AS id FROM known_x) k JOIN articles a ON a.id = k.id
      UNION ALL SELECT a, b, score FROM """
    + _cosine_sql("xv", "av", 0.5)
    + ")"
)
_TEXTS = W(t.OFFENSES_SQL, t.ARTICLES_SQL, t.DESCRIPTIONS_SQL) + ", texts AS (SELECT DISTINCT description FROM offenses)"
_SPLIT = """, pieces AS (SELECT description, generate_subscripts(p, 1) AS pos, trim(unnest(p)) AS part
  FROM (SELECT description, list_filter(string_split(description, ','), lambda x: trim(x) <> '') AS p FROM texts))"""


@query(
    "suggest_articles",
    _TEXTS + ", x AS (SELECT description AS text FROM texts)" + _SUGGEST + " SELECT text, article_id, round(score, 6) AS score FROM found",
)
def suggest_articles(spark, sf) -> DataFrame:
    out = similarity.suggest(t.offenses(spark, sf), t.articles(spark, sf), t.descriptions(spark, sf), 0.5)
    return out.withColumn("score", F.round("score", 6))


@query(
    "suggest_composite",
    _TEXTS
    + _SPLIT
    + """, x AS (SELECT description AS text FROM texts UNION SELECT part FROM pieces)"""
    + _SUGGEST
    + """ SELECT description, article_id, round(max(score), 6) AS score FROM (
      SELECT description, description AS part FROM texts UNION ALL SELECT description, part FROM pieces) p
    JOIN found f ON f.text = p.part GROUP BY ALL""",
)
def suggest_composite(spark, sf) -> DataFrame:
    out = similarity.suggest_all(t.offenses(spark, sf), t.articles(spark, sf), t.descriptions(spark, sf), 0.5)
    return out.withColumn("score", F.round("score", 6))


@query(
    "suggest_by_part",
    _TEXTS
    + _SPLIT
    + ", x AS (SELECT DISTINCT part AS text FROM pieces)"
    + _SUGGEST
    + """ SELECT description, pos, part, article_id, round(score, 6) AS score FROM pieces LEFT JOIN found f ON f.text = part""",
)
def suggest_by_part(spark, sf) -> DataFrame:
    out = similarity.suggest_breakdown(t.offenses(spark, sf), t.articles(spark, sf), t.descriptions(spark, sf), 0.5)
    return out.withColumn("score", F.round("score", 6))


_MULTI = """, sets AS (SELECT description, pos, list(DISTINCT article_id ORDER BY article_id) AS ids FROM pieces JOIN found f ON f.text = part
      GROUP BY ALL),
    steps AS (SELECT description, ids <> lag(ids) OVER (PARTITION BY description ORDER BY pos) AS differs FROM sets),
    multi AS (SELECT description, coalesce(bool_or(differs), false) AS is_multi FROM steps GROUP BY description)"""


@query(
    "multi_article_texts",
    _TEXTS
    + _SPLIT
    + ", x AS (SELECT DISTINCT part AS text FROM pieces)"
    + _SUGGEST
    + _MULTI
    + " SELECT description, coalesce(is_multi, false) AS is_multi FROM texts LEFT JOIN multi USING (description)",
)
def multi_article_texts(spark, sf) -> DataFrame:
    return similarity.detect_multi_article(
        t.offenses(spark, sf), t.articles(spark, sf), t.descriptions(spark, sf), 0.5
    )


_QUEUE = """, queue AS (SELECT o.description, count(*) AS offense_count FROM offenses o
  WHERE o.description <> '' AND o.description NOT IN (SELECT description FROM descriptions) GROUP BY 1)"""
_REPORT = (
    W(t.OFFENSES_SQL, t.ARTICLES_SQL, t.DESCRIPTIONS_SQL)
    + _QUEUE
    + ", texts AS (SELECT description FROM queue)"
    + _SPLIT
    + ", x AS (SELECT description AS text FROM texts UNION SELECT part FROM pieces)"
    + _SUGGEST
    + _MULTI
)


@query(
    "suggestion_report_single",
    _REPORT
    + """ SELECT description, NULL::INT AS pos, NULL::VARCHAR AS part, article_id, round(max(score), 6) AS score FROM (
      SELECT description, description AS piece FROM texts UNION ALL SELECT description, part FROM pieces) p
    JOIN found f ON f.text = p.piece WHERE description NOT IN (SELECT description FROM multi WHERE is_multi)
    GROUP BY description, article_id""",
)
def suggestion_report_single(spark, sf) -> DataFrame:
    out = queues.suggestion_report(
        t.offenses(spark, sf), t.descriptions(spark, sf), t.articles(spark, sf), 0.5, limit=None
    )
    return out.withColumn("score", F.round("score", 6))


@query(
    "suggestion_report_multi",
    _REPORT
    + f""" SELECT description, pos, part, article_id, round(score, 6) AS score FROM pieces LEFT JOIN found f ON f.text = part
    WHERE description IN (SELECT description FROM multi WHERE is_multi)
      AND description NOT IN (SELECT description FROM pieces GROUP BY description
        HAVING bool_and({FOLD.format('part')} IN (SELECT {FOLD.format('description')} FROM descriptions)))""",
)
def suggestion_report_multi(spark, sf) -> DataFrame:
    out = queues.suggestion_report(
        t.offenses(spark, sf), t.descriptions(spark, sf), t.articles(spark, sf), 0.5, multi_article=True, limit=None
    )
    return out.withColumn("score", F.round("score", 6))


@query(
    "search_articles",
    W(t.ARTICLES_SQL)
    + """SELECT id, text, code, title, matched FROM (SELECT *, (contains(id, 'ring') OR contains(text, 'ring') OR contains(title, 'ring'))::INT
      + (contains(id, 'goods') OR contains(text, 'goods') OR contains(title, 'goods'))::INT
      + (contains(id, '3') OR contains(text, '3') OR contains(title, '3'))::INT AS matched FROM articles) WHERE matched > 0""",
)
def search_articles(spark, sf) -> DataFrame:
    return similarity.search_articles(t.articles(spark, sf), "ring goods :3")


@query("article_sections", W(t.ARTICLES_SQL) + "SELECT title, count(*) AS count FROM articles GROUP BY title")
def article_sections(spark, sf) -> DataFrame:
    return similarity.list_sections(t.articles(spark, sf))


# --- queues and progress ---------------------------------------------------------------------------------------------

_NOW = "2001-12-31 00:00:00"


def _queue_sql(days: int, extra: str = "") -> str:
    return (
        W(t.OFFENSES_SQL, t.LOCATIONS_SQL)
        + f"""SELECT o.db_id, o.location, count(*) AS offense_count, strftime(max(o.time), '%Y-%m-%d %H:%M') AS newest_offense_date,
      sum(CASE WHEN o.time >= TIMESTAMP '2001-12-31 00:00:00' - to_days({days}) THEN 1 ELSE 0 END)::BIGINT AS window_count
    FROM offenses o
    WHERE o.location <> '' {extra} AND NOT EXISTS (SELECT 1 FROM locations l WHERE l.db_id = o.db_id AND l.location = o.location)
    GROUP BY o.db_id, o.location"""
    )


def _queue(spark, sf, sort: str, db_id: int | None = None) -> DataFrame:
    out = queues.location_queue(t.offenses(spark, sf), t.locations(spark, sf), sort, F.lit(_NOW).cast("timestamp_ntz"), db_id)
    return out.withColumn("newest_offense_date", F.date_format("newest_offense_date", "yyyy-MM-dd HH:mm"))


@query("location_queue", _queue_sql(0))
def location_queue(spark, sf) -> DataFrame:
    return _queue(spark, sf, "frequency")


@query("location_queue_recent", _queue_sql(30))
def location_queue_recent(spark, sf) -> DataFrame:
    return _queue(spark, sf, "window_30")


@query("location_queue_newest", _queue_sql(0, "AND o.db_id IN (2)"))
def location_queue_newest(spark, sf) -> DataFrame:
    return _queue(spark, sf, "newest", 2)


@query(
    "geocoding_progress",
    W(t.OFFENSES_SQL, t.LOCATIONS_SQL)
    + """, p AS (SELECT DISTINCT db_id, location FROM offenses),
    c AS (SELECT (SELECT count(*) FROM p) AS total_locations,
      (SELECT count(*) FROM locations l WHERE EXISTS (SELECT 1 FROM p WHERE p.db_id = l.db_id AND p.location = l.location)) AS geocoded_locations,
      (SELECT count(*) FROM offenses) AS total_offenses,
      (SELECT count(*) FROM offenses o JOIN locations l ON l.db_id = o.db_id AND l.location = o.location) AS geocoded_offenses)
    SELECT *, round(geocoded_locations / total_locations * 100, 6) AS locations_percentage,
      round(geocoded_offenses / total_offenses * 100, 6) AS offenses_percentage FROM c""",
)
def geocoding_progress(spark, sf) -> DataFrame:
    out = queues.geocoding_progress(t.offenses(spark, sf), t.locations(spark, sf))
    return out.withColumns(
        {c: F.round(c, 6) for c in ("locations_percentage", "offenses_percentage")}
    )


@query(
    "geocoding_methods",
    W(t.OFFENSES_SQL, t.LOCATIONS_SQL)
    + """SELECT geocoding_method, count(*) AS locations FROM locations l
    WHERE EXISTS (SELECT 1 FROM offenses o WHERE o.db_id = l.db_id AND o.location = l.location) GROUP BY 1""",
)
def geocoding_methods(spark, sf) -> DataFrame:
    return queues.geocoding_methods(t.offenses(spark, sf), t.locations(spark, sf))


@query(
    "unclassified_descriptions",
    W(t.OFFENSES_SQL, t.DESCRIPTIONS_SQL) + _QUEUE + "SELECT * FROM queue ORDER BY offense_count DESC, description",
)
def unclassified_descriptions(spark, sf) -> DataFrame:
    return queues.unclassified_descriptions(t.offenses(spark, sf), t.descriptions(spark, sf))


@query(
    "parts_classified",
    W(t.OFFENSES_SQL, t.DESCRIPTIONS_SQL, _KNOWN, _PARTS)
    + "SELECT description, coalesce(all_found, false) AS all_classified FROM texts LEFT JOIN resolved USING (description)",
)
def parts_classified(spark, sf) -> DataFrame:
    return queues.parts_classified(t.offenses(spark, sf), t.descriptions(spark, sf))


@query(
    "description_progress",
    W(t.OFFENSES_SQL, t.DESCRIPTIONS_SQL)
    + """, c AS (SELECT count(DISTINCT description) AS total_descriptions, (SELECT count(*) FROM descriptions) AS classified_descriptions,
      count(*) AS total_offenses, (SELECT count(*) FROM offenses o JOIN descriptions d ON d.description = o.description) AS classified_offenses
      FROM offenses WHERE description <> '')
    SELECT *, round(classified_descriptions / total_descriptions * 100, 6) AS descriptions_percentage,
      round(classified_offenses / total_offenses * 100, 6) AS offenses_percentage FROM c""",
)
def description_progress(spark, sf) -> DataFrame:
    out = queues.description_progress(t.offenses(spark, sf), t.descriptions(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("descriptions_percentage", "offenses_percentage")})


@query("offense_counts", W(t.OFFENSES_SQL) + "SELECT db_id, location, count(*) AS offense_count FROM offenses GROUP BY ALL")
def offense_counts(spark, sf) -> DataFrame:
    return queues.offense_counts(t.offenses(spark, sf))


@query(
    "pending_counts",
    W(t.OFFENSES_SQL)
    + """SELECT count(*) FILTER (lng IS NULL) AS pending_geocoding_offenses,
      count(DISTINCT location) FILTER (lng IS NULL) AS pending_geocoding_locations,
      count(*) FILTER (article_ids IS NULL) AS pending_offenses,
      count(DISTINCT description) FILTER (article_ids IS NULL) AS pending_descriptions FROM offenses""",
)
def pending_counts(spark, sf) -> DataFrame:
    return queues.pending_counts(t.offenses(spark, sf))


@query(
    "databases_with_locations",
    W(t.OFFENSES_SQL) + "SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey IN (SELECT db_id FROM offenses)",
)
def databases_with_locations(spark, sf) -> DataFrame:
    return queues.databases_with_locations(t.offenses(spark, sf), t.databases(spark, sf))


@query(
    "lookup_descriptions",
    W(t.DESCRIPTIONS_SQL)
    + """SELECT n.description, array_to_string(d.article_ids, '|') AS article_ids, updated_s AS updated
    FROM (SELECT DISTINCT p_name AS description FROM part) n LEFT JOIN descriptions d USING (description)""",
)
def lookup_descriptions(spark, sf) -> DataFrame:
    keys = t.table(spark, sf, "part").select(F.col("p_name").alias("description")).distinct()
    out = queues.lookup_descriptions(keys, t.descriptions(spark, sf))
    return out.select("description", _list("article_ids"), F.unix_seconds("updated_at").alias("updated"))


@query(
    "review_assignments",
    W(t.OFFENSES_SQL, t.ARTICLES_SQL, t.DESCRIPTIONS_SQL)
    + """SELECT a.code, a.id AS article_id, a.text, d.description,
      CASE WHEN d.description IS NOT NULL THEN coalesce(n, 0) END AS offense_count
    FROM articles a LEFT JOIN descriptions d ON list_contains(d.article_ids, a.id) AND len(d.article_ids) = 1
    LEFT JOIN (SELECT description, count(*) AS n FROM offenses GROUP BY 1) c ON c.description = d.description""",
)
def review_assignments(spark, sf) -> DataFrame:
    return queues.review_assignments(t.articles(spark, sf), t.descriptions(spark, sf), t.offenses(spark, sf))


# --- radars and locations --------------------------------------------------------------------------------------------

_ROUTES = """parsed AS (
  SELECT DISTINCT location,
    CASE WHEN regexp_matches(location, '^Ruta') THEN regexp_extract(location, 'Ruta (\\d+)', 1)::INT
      WHEN regexp_matches(location, '^RUTA') THEN regexp_extract(location, 'NACIONAL (\\d+)', 1)::INT
      ELSE regexp_extract(location, '^(\\d+)', 1)::INT END AS route,
    CASE WHEN regexp_matches(location, '^RUTA') THEN regexp_extract(location, 'km (\\d+)', 1)::INT
      ELSE regexp_extract(location, ' y (\\d+)K', 1)::INT END AS km,
    CASE WHEN regexp_matches(location, '^RUTA') THEN 0 ELSE regexp_extract(location, 'K(\\d+)', 1)::INT END AS m,
    CASE WHEN location LIKE '%\\_D' ESCAPE '\\' THEN 'D' ELSE '' END AS direction
  FROM route_locations WHERE NOT regexp_matches(location, '^Calle'))"""
_MARKERS = """markers AS (
  SELECT ruta, progresiva, descrip, lng, lat, marker, split_part(marker, 'k', 1)::INT AS km, split_part(marker, 'k', 2)::INT AS m
  FROM (SELECT *, unnest(string_split(progresiva, '/')) AS marker FROM radars))"""
_MATCHED = """matched AS (
  SELECT location, route, km || 'k' || lpad(m::VARCHAR, 3, '0') AS marker, direction, progresiva, descrip, lng, lat,
    ['exact', 'listed', 'near'][rank + 1] AS match FROM (
      SELECT *, row_number() OVER (PARTITION BY location ORDER BY rank, gap, radar_marker, progresiva, descrip, lng, lat) AS r FROM (
        SELECT p.*, x.progresiva, x.descrip, x.lng, x.lat, x.marker AS radar_marker, abs(x.m - p.m) AS gap,
          CASE WHEN x.progresiva = p.km || 'k' || lpad(p.m::VARCHAR, 3, '0') THEN 0
            WHEN x.marker = p.km || 'k' || lpad(p.m::VARCHAR, 3, '0') THEN 1 ELSE 2 END AS rank
        FROM parsed p JOIN markers x ON x.ruta = p.route AND x.km = p.km) WHERE gap < 1000 OR rank < 2) WHERE r = 1)"""


@query(
    "match_radars",
    W(t.RADARS_SQL, t.ROUTE_LOCATIONS_SQL, _ROUTES, _MARKERS, _MATCHED)
    + "SELECT location, route, marker, direction, progresiva, descrip, round(lng, 6) AS lng, round(lat, 6) AS lat, match FROM matched",
)
def match_radars(spark, sf) -> DataFrame:
    out = geocoding.match_radars(t.route_locations(spark, sf), t.radars(spark, sf))
    return out.withColumns({"lng": F.round("point.lng", 6), "lat": F.round("point.lat", 6)}).drop("point")


@query(
    "suggest_coordinates",
    W(t.RADARS_SQL, t.ROUTE_LOCATIONS_SQL, _ROUTES, _MARKERS, _MATCHED)
    + f""", queue AS (SELECT DISTINCT db_id, location FROM route_locations),
    answers AS (SELECT DISTINCT (s_suppkey % 25)::INT AS db_id, 'Calle ' || s_suppkey AS location, {t._LNG_SQL} AS lng, {t._LAT_SQL} AS lat,
      CASE s_suppkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence FROM supplier)
    SELECT q.db_id, q.location, round(coalesce(m.lng, a.lng), 6) AS lng, round(coalesce(m.lat, a.lat), 6) AS lat,
      m.lng IS NOT NULL AS is_electronic, CASE WHEN m.lng IS NOT NULL THEN 'radares_rutas' WHEN a.lng IS NOT NULL THEN 'google_maps' END AS geocoding_method,
      CASE WHEN m.lng IS NOT NULL THEN 'high' ELSE a.confidence END AS confidence,
      CASE WHEN m.lng IS NOT NULL THEN m.descrip WHEN a.lng IS NOT NULL THEN 'Found ' || q.location END AS notes
    FROM queue q LEFT JOIN matched m ON m.location = q.location LEFT JOIN answers a ON a.db_id = q.db_id AND a.location = q.location""",
)
def suggest_coordinates(spark, sf) -> DataFrame:
    precision = F.expr("element_at(array('ROOFTOP', 'RANGE_INTERPOLATED', 'GEOMETRIC_CENTER', 'APPROXIMATE'), cast(s_suppkey % 4 + 1 as int))")
    answers = t.table(spark, sf, "supplier").select(
        (F.col("s_suppkey") % 25).cast("int").alias("db_id"),
        F.concat(F.lit("Calle "), F.col("s_suppkey").cast("string")).alias("location"),
        geo.point(F.expr(t.LNG), F.expr(t.LAT)).alias("point"),
        geo.geocode_confidence(precision).alias("confidence"),
        F.lit("google_maps").alias("provider"),
    ).withColumn("display_name", F.concat(F.lit("Found "), F.col("location")))
    out = geocoding.suggest_coordinates(t.route_locations(spark, sf), t.radars(spark, sf), answers)
    return out.withColumns({"lng": F.round("point.lng", 6), "lat": F.round("point.lat", 6)}).drop("point")


@query(
    "geocode_requests",
    W(t.ROUTE_LOCATIONS_SQL)
    + """SELECT DISTINCT db_id, location, n_name AS department, location || ', ' || n_name || ', Uruguay' AS query
    FROM route_locations JOIN nation ON n_nationkey = db_id""",
)
def geocode_requests(spark, sf) -> DataFrame:
    return geocoding.geocode_requests(t.route_locations(spark, sf).distinct(), t.databases(spark, sf))


@query(
    "distances",
    W(t.LOCATIONS_SQL)
    + """SELECT id, round(2 * 6371000 * atan2(sqrt(h), sqrt(1 - h)), 3) AS metres FROM (
      SELECT id, pow(sin(radians(-34.9 - lat) / 2), 2)
        + cos(radians(lat)) * cos(radians(-34.9)) * pow(sin(radians(-56.16 - lng) / 2), 2) AS h FROM locations)""",
)
def distances(spark, sf) -> DataFrame:
    capital = geo.point(F.lit(-56.16), F.lit(-34.9))
    return t.locations(spark, sf).withColumn("_capital", capital).select(
        "id", F.round(geo.haversine_m("point", "_capital"), 3).alias("metres")
    )


_JUDGMENTS_SQL = f"""judgments AS (
  SELECT (s_suppkey % 25)::INT AS db_id, CASE WHEN s_suppkey % 11 = 0 THEN '  ' ELSE s_name END AS location, 'New ' || s_name AS canonical_location,
    {t._LNG_SQL} + CASE WHEN s_suppkey % 7 = 0 THEN 5.0 ELSE 0.0 END AS lng, {t._LAT_SQL} - CASE WHEN s_suppkey % 13 = 0 THEN 3.0 ELSE 0.0 END AS lat,
    CASE s_suppkey % 5 WHEN 0 THEN 'guess' WHEN 1 THEN '' ELSE 'manual' END AS geocoding_method,
    CASE s_suppkey % 9 WHEN 0 THEN 'sure' ELSE 'low' END AS confidence, repeat('ñ', (s_suppkey % 6 * 101)::INT) AS notes, s_suppkey
  FROM supplier)"""


def _judgments(spark, sf) -> DataFrame:
    return t.table(spark, sf, "supplier").select(
        "s_suppkey",
        (F.col("s_suppkey") % 25).cast("int").alias("db_id"),
        F.expr("case when s_suppkey % 11 = 0 then '  ' else s_name end").alias("location"),
        F.expr("concat('New ', s_name)").alias("canonical_location"),
        geo.point(
            F.expr(f"{t.LNG} + case when s_suppkey % 7 = 0 then 5.0D else 0.0D end"),
            F.expr(f"{t.LAT} - case when s_suppkey % 13 = 0 then 3.0D else 0.0D end"),
        ).alias("point"),
        F.expr("s_suppkey % 3 = 0").alias("is_electronic"),
        F.expr("case s_suppkey % 5 when 0 then 'guess' when 1 then '' else 'manual' end").alias("geocoding_method"),
        F.expr("case s_suppkey % 9 when 0 then 'sure' else 'low' end").alias("confidence"),
        F.expr("repeat('ñ', cast(s_suppkey % 6 * 101 as int))").alias("notes"),
    )


@query(
    "validate_judgments",
    W(_JUDGMENTS_SQL)
    + """SELECT s_suppkey, CASE WHEN trim(location) = '' THEN 'location no puede estar vacío'
      WHEN lat < -36 OR lat > -29 THEN 'coordenadas inválidas: latitud fuera de los límites de Uruguay (-36.000000 a -29.000000): ' || printf('%.6f', lat)
      WHEN lng < -59 OR lng > -52 THEN 'coordenadas inválidas: longitud fuera de los límites de Uruguay (-59.000000 a -52.000000): ' || printf('%.6f', lng)
      WHEN geocoding_method = 'guess' THEN 'método de geocodificación inválido: guess'
      WHEN confidence = 'sure' THEN 'nivel de confianza inválido: sure'
      WHEN strlen(notes) > 1000 THEN 'notes demasiado largo (máximo 1000 caracteres)' END AS error
    FROM judgments""",
)
def validate_judgments(spark, sf) -> DataFrame:
    return geocoding.validate_judgments(_judgments(spark, sf)).select("s_suppkey", "error")


@query(
    "upsert_judgments",
    W(t.LOCATIONS_SQL, _JUDGMENTS_SQL)
    + f""", incoming AS (SELECT * FROM judgments WHERE trim(location) <> ''),
    merged AS (SELECT coalesce(l.id, -1) AS id, i.db_id, i.location, i.canonical_location, i.lng, i.lat, coalesce(l.created_s, 0) AS created, 0 AS updated
      FROM incoming i LEFT JOIN locations l ON l.db_id = i.db_id AND l.location = i.location),
    result AS (SELECT * FROM merged UNION ALL
      SELECT id, db_id, location, canonical_location, lng, lat, created_s, updated_s FROM locations
      WHERE (db_id, location) NOT IN (SELECT (db_id, location) FROM incoming)),{h3_sql("jh", "SELECT lng, lat FROM result")}
    SELECT a.* EXCLUDE (lng, lat), round(a.lng, 6) AS lng, round(a.lat, 6) AS lat, printf('%x', c.h3_res8) AS cell
    FROM result a LEFT JOIN jh_cells c ON c.lng = a.lng AND c.lat = a.lat""",
)
def upsert_judgments(spark, sf) -> DataFrame:
    stored = t.locations(spark, sf)
    incoming = _judgments(spark, sf).where(F.trim("location") != "").drop("s_suppkey")
    out = geocoding.upsert_judgments(stored, incoming, F.timestamp_seconds(F.lit(0)))
    known = stored.select("db_id", "location", F.lit(True).alias("_known"))
    return out.join(known, ["db_id", "location"], "left").select(
        F.when(F.col("_known"), F.col("id")).otherwise(F.lit(-1)).alias("id"),
        "db_id",
        "location",
        "canonical_location",
        F.round("point.lng", 6).alias("lng"),
        F.round("point.lat", 6).alias("lat"),
        F.unix_seconds("created_at").alias("created"),
        F.unix_seconds("updated_at").alias("updated"),
        F.lower(F.hex("h3_res8")).alias("cell"),
    )


@query(
    "merge_locations",
    W(t.LOCATIONS_SQL)
    + """, moves AS (SELECT a.db_id, a.location AS target, min(b.location) AS canonical FROM locations a
      JOIN locations b ON a.db_id = b.db_id AND b.location < a.location GROUP BY ALL)
    SELECT l.id, l.db_id, l.location, coalesce(c.location, l.canonical_location) AS canonical_location,
      round(coalesce(c.lng, l.lng), 6) AS lng, round(coalesce(c.lat, l.lat), 6) AS lat, printf('%x', coalesce(c.h3_res7, l.h3_res7)) AS cell7
    FROM locations l LEFT JOIN moves m ON m.db_id = l.db_id AND m.target = l.location
    LEFT JOIN locations c ON c.db_id = m.db_id AND c.location = m.canonical""",
)
def merge_locations(spark, sf) -> DataFrame:
    stored = t.locations(spark, sf)
    heads = stored.groupBy("db_id").agg(F.min("location").alias("canonical"))
    moves = stored.select("db_id", F.col("location").alias("target")).join(heads, "db_id").where("target <> canonical")
    out = geocoding.merge_locations(stored, moves)
    return out.select(
        "id",
        "db_id",
        "location",
        "canonical_location",
        F.round("point.lng", 6).alias("lng"),
        F.round("point.lat", 6).alias("lat"),
        F.lower(F.hex("h3_res7")).alias("cell7"),
    )


@query(
    "list_judgments",
    W(t.LOCATIONS_SQL)
    + "SELECT id, db_id, location, updated_s AS updated FROM locations ORDER BY updated_s DESC, db_id, location LIMIT 25 OFFSET 10",
)
def list_judgments(spark, sf) -> DataFrame:
    out = geocoding.list_judgments(t.locations(spark, sf), limit=25, offset=10)
    return out.select("id", "db_id", "location", F.unix_seconds("updated_at").alias("updated"))


_CLUSTERS = """near AS (SELECT a.id AS a, b.id AS b FROM locations a JOIN locations b ON abs(a.lat - b.lat) < 0.001 AND abs(a.lng - b.lng) < 0.001
  AND 2 * 6371000 * atan2(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)),
    sqrt(1 - (pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))) <= 10),
reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b),
member AS (SELECT a AS id, min(b) AS cluster FROM reach GROUP BY a)"""


@query("location_clusters", W(t.LOCATIONS_SQL, _CLUSTERS) + "SELECT id, cluster FROM member")
def location_clusters(spark, sf) -> DataFrame:
    # Clusters are named after a grid box; give each the least id it holds.
    out = clustering.cluster_locations(t.locations(spark, sf)).select("id", F.col("cluster").alias("box"))
    names = out.groupBy("box").agg(F.min("id").alias("cluster"))
    return out.join(names, "box").select("id", "cluster")


@query(
    "location_cluster_report",
    W(t.OFFENSES_SQL, t.LOCATIONS_SQL, _CLUSTERS)
    + """, n AS (SELECT l.*, m.cluster, (SELECT count(*) FROM offenses o WHERE o.db_id = l.db_id AND o.location = l.location) AS offense_count
      FROM locations l JOIN member m USING (id)),
    f AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS size, first(lng) OVER w AS flng, first(lat) OVER w AS flat FROM n
      WINDOW w AS (PARTITION BY cluster ORDER BY offense_count DESC, db_id, location)),
    g AS (SELECT * FROM f WHERE size > 1 AND NOT (coalesce(canonical_location, '') <> '' AND lng = flng AND lat = flat)),
    p AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS kept, sum(offense_count) OVER (PARTITION BY cluster) AS total,
      first(db_id) OVER w AS pdb, first(location) OVER w AS ploc, first(lng) OVER w AS plng, first(lat) OVER w AS plat FROM g
      WINDOW w AS (PARTITION BY cluster ORDER BY offense_count DESC, db_id, location)),
    h AS (SELECT *, pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lng - plng) / 2), 2) AS hv FROM p WHERE kept > 1)
    SELECT pdb AS cluster_db_id, ploc AS principal, total::BIGINT AS total_offenses, db_id, location, offense_count,
      (db_id = pdb AND location = ploc) AS is_principal, round(2 * 6371000 * atan2(sqrt(hv), sqrt(1 - hv)), 3) AS distance_from_principal FROM h""",
)
def location_cluster_report(spark, sf) -> DataFrame:
    out = clustering.location_cluster_report(t.locations(spark, sf), t.offenses(spark, sf))
    return out.withColumn("distance_from_principal", F.round("distance_from_principal", 3)).drop("cluster", "point")
