"""Documents to records, stored and replaced."""

import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from noticelake.operators import extract, html
from noticelake.plans.ingest import ingest
from noticelake.schema import DESCRIPTIONS, LOCATIONS
from noticelake.sources import curation, documents, offenses
from noticelake.streaming.ingest import PAGES, ingest_stream

MALDONADO = "Dirección General de Tránsito y Transporte Intendencia de Maldonado"
LAVALLEJA = "Dirección de Tránsito Intendencia de Lavalleja"


def page(title, published, rows, body=""):
    table = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows)
    return (
        f"<html><head><title>{title}</title></head><body><h5>Fecha de Publicación: {published}</h5>{body}"
        f'<table class="tabla_en_texto"><tbody>{table}</tbody></table></body></html>'
    )


FULL = ["Matricula", "Fecha y Hora", "Interseccion", "Intervenido", "Articulo", "Valor en UR"]


@pytest.fixture(scope="module")
def issuers(spark):
    return spark.createDataFrame([(45, [MALDONADO]), (26, [LAVALLEJA])], "db_id int, issuers array<string>")


def records(spark, issuers, html_text, db_id=45, source="d1", **options):
    pages = spark.createDataFrame([(db_id, source, html_text)], PAGES)
    return extract.extract_records(pages, issuers, **options).orderBy("record_id").collect()


def test_full_table(spark, issuers):
    text = page(
        f"Notificación {MALDONADO} N° 12/024",
        "15/03/2024",
        [
            FULL,
            ["KLM4821", "10/03/2024 00:00", "Av. del Mar", "S-11", ": Luces apagadas", "4"],
            ["#", "10/03/2024 21:15", "Rambla", "S-12", "Luces", "0,5"],
            ["KLM4822", "16/03/2024 08:30", "Rambla", "S-13", "Luces", "1"],
            ["KLM4823", "40/03/2024", "Rambla", "S-14", "Luces", "x"],
            ["KLM4824", "10/03/2013", "Rambla 中", "S-15", "Luces", "1"],
        ],
    )
    rows = records(spark, issuers, text)
    assert [r["record_id"] for r in rows] == [1, 2, 3, 4, 5]
    first = rows[0]
    assert (first["doc_id"], first["doc_date"]) == ("12/024", dt.date(2024, 3, 15))
    assert (first["vehicle"], first["ur"], first["description"], first["error"]) == ("KLM4821", 400, "Luces apagadas", None)
    assert first["time_year"] == 2024
    assert rows[1]["error"] == "matrícula inválida"
    assert "más nueva" in rows[2]["error"]
    assert rows[3]["error"].startswith("couldn't parse datetime")
    assert rows[4]["error"].startswith("invalid character")


def test_split_columns(spark, issuers):
    header = ["FECHA", "HORA", "MATRICULA", "LOCALIDAD", "UBICACIÓN", "INFRACCION", "VALOR"]
    row = ["09/08/2023", "6:05", " KLM 4821", "CENTRO", "PLAZA", "Luces", "2"]
    pages = spark.createDataFrame(
        [(26, "d", page(f"Notificación {LAVALLEJA} N° 3/024", "15/03/2024", [header, row]))], PAGES
    )
    got = extract.extract_records(pages, issuers).select(
        "*", F.unix_seconds("time").alias("seconds")
    ).first()
    assert got["vehicle"] == "KLM4821" and got["location"] == "PLAZA, CENTRO" and got["error"] is None
    assert got["seconds"] == int(dt.datetime(2023, 8, 9, 9, 5, tzinfo=dt.timezone.utc).timestamp())


def test_missing_date_and_description_columns(spark, issuers):
    body = "<p>que se constató la contravención a lo dispuesto en el\n Art. 9 del Texto Ordenado del SUCIVE</p>"
    rows = records(spark, issuers, page(f"x {LAVALLEJA} s/n", "02/05/2022", [["Matrícula", "UR"], ["ABC1234", "1"]], body), 26)
    assert rows[0]["doc_id"] == "s/n" and rows[0]["error"] is None
    assert rows[0]["description"] == "Cobros por acciones, trámites o gestiones"
    assert rows[0]["doc_error"] is None and rows[0]["time_year"] == 2022
    rows = records(spark, issuers, page(f"x {LAVALLEJA} N° 1/1", "02/05/2022", [["Matrícula", "UR"], ["ABC1234", "1"]]), 26)
    assert rows[0]["doc_error"] == "tabla sin columna descripción"


def test_unknown_header_and_missing_header(spark, issuers):
    rows = records(spark, issuers, page(f"x {LAVALLEJA} N° 1/1", "02/05/2022", [["Matrícula", "Color"], ["ABC1234", "1"]]), 26)
    assert rows[0]["doc_error"] == 'unknown property for header "Color"'
    overrides = spark.createDataFrame([("d1", ["vehicle", "description", "ur"])], "doc_source string, properties array<string>")
    rows = records(
        spark, issuers, page(f"x {LAVALLEJA} N° 1/1", "02/05/2022", [["SBF1234", "Exceso de velocidad", "5"]]), 26, overrides=overrides
    )
    assert [(r["record_id"], r["vehicle"], r["description"], r["ur"], r["error"]) for r in rows] == [
        (1, "SBF1234", "Exceso de velocidad", 500, None)
    ]


def verdicts(spark, issuers, pages, **options):
    df = spark.createDataFrame([(45, name, text) for name, text in pages.items()], PAGES)
    found = extract.extract_notices(df, issuers)
    return found, {r["doc_source"]: r for r in extract.document_verdicts(found, **options).collect()}


def test_every_document_has_a_verdict(spark, issuers):
    title, row = f"x {MALDONADO} N° 1/1", ["ABC1234", "01/02/2022", "Calle", "7", "Exceso", "1"]
    pages = {
        "good": page(title, "02/05/2022", [FULL, row]),
        "empty": page(title, "02/05/2022", []),
        "header only": page(title, "02/05/2022", [FULL]),
        "no number": page("x", "02/05/2022", [FULL, row]),
        "empty, no number": page("x", "02/05/2022", []),
        "login": page("Ingreso - IMPO", "02/05/2022", [FULL, row]),
        "bad header": page(title, "02/05/2022", [["Matricula", "Color"], ["ABC1234", "x"]]),
        "bad header only": page(title, "02/05/2022", [["Matricula", "Color"]]),
        "bad date": page(title, "31/02/2022", [FULL, row]),
        "foreign": page(title, "02/05/2022", [FULL, row]).replace("</h5>", " 中</h5>"),
        "no date": page(title, "02/05/2022", [FULL, row]).replace("h5>", "h6>"),
        "blank": "",
        "null": None,
    }
    found, got = verdicts(spark, issuers, pages)
    assert {n: r["rejected"] for n, r in got.items() if r["rejected"]} == {
        "no number": "document ID not found",
        "login": "login page",
        "bad header": 'unknown property for header "Color"',
        "bad header only": 'unknown property for header "Color"',
        "bad date": 'invalid publication date "31/02/2022"',
        "foreign": 'invalid character in "Fecha de Publicación: 02/05/2022 中"',
        "null": "unreadable page",
    }
    assert set(got) == set(pages)
    counts = {n: (r["successes"], r["errors"]) for n, r in got.items() if r["successes"] or r["errors"]}
    assert counts == {"good": (1, 0), "no number": (1, 0), "no date": (0, 1)}
    assert "más nueva" in found.where("doc_source = 'no date'").first()["error"]
    total = extract.extract_metrics(extract.document_verdicts(found)).where("db_id is null").first()
    assert (total["new_records"], total["new_errors"], total["successful_docs"], total["failed_docs"]) == (2, 1, 6, 7)
    assert extract.document_verdicts(found, skip_any_error=True).where("rejected = 'has errors'").count() == 1
    passed = extract.quality_gate(found, extract.document_verdicts(found))
    assert sorted(r["doc_source"] for r in passed.collect()) == ["good", "no date"]


def test_tables_of_a_page_are_apart(spark, issuers):
    text = page(f"x {MALDONADO} N° 1/1", "02/05/2022", [FULL, ["ABC1234", "01/02/2022", "Calle", "7", "Exceso", "1"]])
    more = '<table class="tabla_en_texto"><tr><td>Detalle</td><td>MAT.</td><td>Fecha</td></tr><tr><td>Freno</td><td>ABC1235</td><td>02/02/2022</td></tr></table>'
    rows = records(spark, issuers, text.replace("</body>", more + "</body>"))
    assert sorted((r["table_no"], r["record_id"], r["vehicle"], r["description"], r["location"], r["error"]) for r in rows) == [
        (1, 1, "ABC1234", "Exceso", "Calle", None),
        (2, 1, "ABC1235", "Freno", None, None),
    ]


def test_phrase_counts_before_its_table_only(spark, issuers):
    phrase = f"<p>Visto: {extract.DEFAULT_PHRASES[0]}</p>"
    bare = page(f"x {LAVALLEJA} N° 1/1", "02/05/2022", [["Matrícula"], ["ABC1234"]])
    behind = bare.replace("</body>", phrase + "</body>")
    around = bare.replace("<body>", "<body><div>").replace("</body>", phrase + "</div></body>")
    assert records(spark, issuers, behind, 26)[0]["doc_error"] == "tabla sin columna descripción"
    assert records(spark, issuers, around, 26)[0]["error"] is None


def test_same_day_clock_time(spark, issuers):
    text = page(f"x {MALDONADO} N° 1/1", "02/05/2022", [FULL, ["ABC1234", "02/05/2022 10:00", "", "", "x", "1"]])
    assert "más nueva" in records(spark, issuers, text)[0]["error"]
    assert records(spark, issuers, text, compare="date")[0]["error"] is None


def test_quality_gate(spark):
    rows = [("a", 1, None)] * 20 + [("a", 1, "bad")] + [("b", 1, None)] * 19 + [("b", 1, "bad")] + [("c", 1, "bad")]
    df = spark.createDataFrame([(s, d, e, "id") for s, d, e in rows], "doc_source string, db_id int, error string, doc_id string")
    verdicts = extract.document_verdicts(df)
    assert {r["doc_source"]: r["rejected"] for r in verdicts.collect()} == {"a": None, "b": "too many errors", "c": None}
    reviewed = spark.createDataFrame([("b",)], "doc_source string")
    assert extract.document_verdicts(df, reviewed=reviewed).where("rejected is not null").isEmpty()
    assert extract.quality_gate(df, verdicts).select("doc_source").distinct().count() == 2
    total = extract.extract_metrics(verdicts).where("db_id is null").first()
    assert (total["new_records"], total["new_errors"], total["successful_docs"], total["failed_docs"]) == (39, 3, 2, 1)


LISTING = """<table><tbody id="resultadoConsulta">
<tr><td><a href="/avisos/a-7"><strong> Aviso&nbsp;7 </strong></a></td></tr>
<tr><td>b</td><td><a href="https://other.example/b"><strong>Aviso 6</strong><font>(pdf)</font></a><font>Segundo<br>aviso</font></td></tr>
</tbody></table><a href="/elsewhere">x</a><a href="/find?from=3&amp;q=z" class="nextPage">more</a>"""


def test_listing(spark):
    pages = spark.createDataFrame([(1, LISTING), (2, None), (3, "")], "page int, html string")
    rows = html.extract_listing(pages, "https://example.org/", ["page"]).collect()
    assert [(r["title"], r["href"], r["subtitle"]) for r in rows] == [
        ("Aviso\xa07", "https://example.org/avisos/a-7", ""),
        ("Aviso 6", "https://other.example/b", "Segundo aviso"),
    ]
    assert {r["next_query"] for r in rows} == {"from=3&q=z"}


def test_stored_documents(spark, tmp_path):
    folder = tmp_path / "cgm" / "notificaciones" / "2022"
    folder.mkdir(parents=True)
    with gzip.open(folder / "31_A.html.gz", "wt", encoding="utf-8") as f:
        f.write("<html>\n<title>á</title></html>")
    row = documents.read_documents(spark, str(tmp_path)).first()
    assert (row["database"], row["kind"], row["year"], row["number"]) == ("cgm", "notificaciones", 2022, "31_A")
    assert row["html"] == "<html>\n<title>á</title></html>"


def empty_dims(spark):
    return spark.createDataFrame([], LOCATIONS), spark.createDataFrame([("Exceso", ["1"], [1], None)], DESCRIPTIONS)


def notices(spark, numbers, plate="ABC1234"):
    return spark.createDataFrame(
        [
            (45, f"doc{n}", page(f"x {MALDONADO} N° {n}/025", "01/02/2025", [FULL, [plate, f"01/01/{2023 + n % 2} 10:00", "C", "I", "EXCESO", "1"]]))
            for n in numbers
        ],
        PAGES,
    )


def test_ingest_and_replace(spark, issuers, tmp_path):
    locations, descriptions = empty_dims(spark)
    path = str(tmp_path / "offenses")
    first = ingest(notices(spark, range(4)), issuers, locations, descriptions)
    offenses.write_offenses(first.records, path)
    stored = offenses.read_offenses(spark, path)
    assert stored.count() == 4
    row = stored.first()
    assert (row["vehicle_country"], row["article_ids"], row["article_codes"]) == ("UY", ["1"], [1])
    pending = documents.pending_documents(notices(spark, range(6)), stored)
    assert sorted(r["doc_source"] for r in pending.collect()) == ["doc4", "doc5"]
    again = ingest(notices(spark, [1, 2], "XYZ9999"), issuers, locations, descriptions)
    offenses.replace_in_partitions(spark, path, again.records)
    got = {r["doc_source"]: r["vehicle"] for r in offenses.read_offenses(spark, path).collect()}
    assert got == {"doc0": "ABC1234", "doc1": "XYZ9999", "doc2": "XYZ9999", "doc3": "ABC1234"}
    # A document that moves to another year leaves its old partition, which empties.
    touched = offenses.replace_in_partitions(spark, path, again.records.where("doc_source = 'doc1'"), fixed=["db_id"])
    assert {db for db, _ in touched} == {45} and offenses.read_offenses(spark, path).count() == 4
    moved = again.records.where("doc_source = 'doc1'").withColumn("time_year", F.lit(2020))
    lone = again.records.where("doc_source = 'doc2'").withColumn("time_year", F.lit(2020))
    offenses.replace_in_partitions(spark, path, moved.unionByName(lone))
    assert offenses.read_offenses(spark, path).count() == 4


def test_partition_and_filter_pushdown(spark, issuers, tmp_path):
    locations, descriptions = empty_dims(spark)
    path = str(tmp_path / "offenses")
    offenses.write_offenses(ingest(notices(spark, range(4)), issuers, locations, descriptions).records, path)
    plan = (
        offenses.read_offenses(spark, path).where("db_id = 45 and time_year = 2023 and vehicle = 'ABC1234'").select("ur")
        ._jdf.queryExecution().executedPlan().toString()
    )
    assert "PartitionFilters: [isnotnull(db_id" in plan and "EqualTo(vehicle,ABC1234)" in plan
    assert "ReadSchema: struct<vehicle:string,ur:int>" in plan


def test_stream(spark, issuers, tmp_path):
    source, target, log = (str(tmp_path / n) for n in ("pages", "offenses", "log"))

    def run():
        locations, descriptions = empty_dims(spark)
        query = ingest_stream(spark, source, target, log, lambda: (issuers, locations, descriptions))
        query.awaitTermination(120)
        return offenses.read_offenses(spark, target).count()

    notices(spark, range(3)).write.parquet(source)
    assert run() == 3
    notices(spark, range(2, 5), "XYZ9999").write.mode("append").parquet(source)
    assert run() == 5


def test_curation_files(spark, tmp_path):
    bundle = {
        "articles": [{"id": "1", "text": "t", "code": 1, "title": "T"}],
        "descriptions": [{"description": "b", "article_ids": ["1"], "article_codes": [1]}, {"description": "a", "article_ids": [], "article_codes": []}],
        "locations": [{"id": 7, "db_id": 1, "location": "L", "point": {"lat": -34.9, "lng": -56.1}, "geocoding_method": "manual"}],
    }
    (tmp_path / "bundle.json").write_text(json.dumps(bundle))
    articles, descriptions, locations = curation.read_curation(spark, str(tmp_path / "bundle.json"))
    assert (articles.count(), descriptions.count(), locations.count()) == (1, 2, 1)
    assert locations.first()["point"]["lng"] == -56.1 and locations.first()["h3_res8"] is not None
    curation.write_curation(articles, descriptions, locations, str(tmp_path / "out"))
    again = curation.read_curation_lines(spark, str(tmp_path / "out"))
    assert [r["description"] for r in again[1].orderBy("description").collect()] == ["a", "b"]
    assert again[2].first()["h3_res8"] == locations.first()["h3_res8"]
    folder = curation.read_curation(spark, str(tmp_path / "out"))
    assert [df.count() for df in folder] == [1, 2, 1] and folder[2].first()["point"]["lng"] == -56.1
    (tmp_path / "other.json").write_text('{"something": "else"}')
    with pytest.raises(ValueError, match="none of"):
        curation.read_curation(spark, str(tmp_path / "other.json"))
    have = {"articles": articles, "descriptions": descriptions, "locations": locations}
    fewer = {**have, "descriptions": descriptions.limit(1)}
    assert curation.sync_dimension(have, have).first()["action"] == "keep"
    assert curation.sync_dimension(fewer, have).first()["action"] == "load"
    assert curation.sync_dimension(have, fewer).first()["action"] == "skip"


def test_judgment_files(spark, tmp_path):
    file = {"version": "1.0", "last_updated": "2024-01-01T00:00:00Z", "judgments": [{"id": 1, "db_id": 2, "location": "L", "latitude": -34.0, "longitude": -56.0}]}
    (tmp_path / "j.json").write_text(json.dumps(file))
    rows = curation.read_judgments(spark, str(tmp_path / "j.json"))
    assert (rows.first()["version"], rows.first()["point"]["lat"]) == ("1.0", -34.0)
    curation.write_judgments(rows.drop("version", "last_updated"), str(tmp_path / "lines"), "2.0")
    again = curation.read_judgments(spark, str(tmp_path / "lines")).collect()
    assert [(r["id"], r["version"], r["location"], r["point"]["lat"]) for r in again] == [(1, "2.0", "L", -34.0)]
    (tmp_path / "empty.json").write_text('{"version": "1.0", "judgments": []}')
    assert curation.read_judgments(spark, str(tmp_path / "empty.json")).isEmpty()
    with pytest.raises(ValueError, match="none of"):
        (tmp_path / "other.json").write_text('{"something": "else"}')
        curation.read_judgments(spark, str(tmp_path / "other.json"))
    none = spark.createDataFrame([], LOCATIONS)
    assert curation.seed_judgments(none, rows).count() == 1
    assert curation.seed_judgments(curation.seed_judgments(none, rows), rows).count() == 1


def test_offense_json(spark, tmp_path):
    rows = [{"doc_src": "s", "doc_id": "1/1", "doc_date": "2025-01-02T00:00:00-03:00", "country": "UY", "repo_id": 45, "record_id": 1,
             "vehicle": "MAK4129", "time": "2024-12-01T10:00:00-03:00", "location": "", "id": "X", "description": "d", "ur": 500}]
    (tmp_path / "o.json").write_text(json.dumps(rows))
    row = offenses.read_offense_json(spark, str(tmp_path / "o.json")).first()
    assert (row["db_id"], row["vehicle"], row["ur"], row["location"], row["doc_date"]) == (45, "MAK4129", 500, None, dt.date(2025, 1, 2))


def test_radar_layer(spark, tmp_path):
    def feature(marker, name):
        return {"geometry": {"coordinates": [-56.2, -34.5]}, "properties": {"ruta": 5, "progresiva": marker, "gestion": "g", "descrip": name}}

    (tmp_path / "r.json").write_text(json.dumps({"features": [feature("038K131", "old"), feature("38k131", "new")]}))
    rows = curation.read_radars(spark, str(tmp_path / "r.json")).collect()
    assert [(r["progresiva"], r["descrip"]) for r in rows] == [("38k131", "new")]




def test_references_are_read_as_asked(spark):
    pages = spark.createDataFrame([(1, "<title>a &lt;b&gt; &quot;c&amp;quot; d&amp</title>")], "page_id int, html string")
    read = lambda **kw: html.notice_texts(pages, ["page_id"], **kw).first()["title"]
    assert read() == 'a <b> "c&quot; d&'
    assert read(references=("lt", "gt", "amp")) == "a <b> &quot;c&quot; d&amp"
    assert read(references=()) == "a &lt;b&gt; &quot;c&amp;quot; d&amp"


def test_plain_pages_are_read_as_by_the_parser():
    import random

    random.seed(3)
    whole = page("Notificaci&oacute;n", "1/2/2020", [["Matr&iacute;cula", "Fecha"], ["ABC 1234 &amp", "1/2/2020"]], "<p class=\"a b\">x &lt; y<pre>z</pre>")
    assert html._plain_tags(whole)
    bits = ["<tr>", "<td >", "</td>", "</ tr>", "<TABLE CLASS=\"tabla_en_texto\">", "</table>", "<br/>", "<title>", "</title>", "<h5>", "</h5>",
            "<p>", "</p>", "<div id=x>", "<script>", "</script>", "<!-- a -->", "<!doctype html>", "a &amp; b", "&aacute", "<", ">", " ", "&", "<tbody>"]
    pages = [whole, "", "x", *("".join(random.choices(bits, k=random.randint(1, 12))) for _ in range(3000))]
    pages += [whole[:i] + random.choice(bits) + whole[i:] for i in range(len(whole))]
    plain = 0
    for text in pages:
        plain += html._plain_tags(text) is not None
        for kind in (html._NoticeParser, html._ListingParser):
            by_tags, fed = html._parse(kind(), text), kind()
            fed.feed(text)
            fed.close()
            names = ("title", "headings", "body", "tables") if kind is html._NoticeParser else ("entries", "next")
            assert [getattr(by_tags, n) for n in names] == [getattr(fed, n) for n in names], text
    assert plain > 200
