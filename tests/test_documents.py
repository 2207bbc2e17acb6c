import gzip

import pytest

from noticelake.sources import documents

PAGE = "<html><title>Notificación n° 31 – ñandú</title></html>"


def stored(tmp_path, name, content):
    folder = tmp_path / "cgm" / "notificaciones" / "2022"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(content)


def test_each_document_has_its_own_charset(spark, tmp_path):
    declared = '<html><meta http-equiv="Content-Type" content="text/html; charset=ISO-8859-1">ñ €</html>'
    wrong = '<html><meta charset="utf-8"/>ñ</html>'
    unknown = '<html><meta charset="no-such"/>ñ</html>'
    cases = {
        "1.html": (PAGE.encode(), PAGE, "utf-8"),
        "2.html.gz": (gzip.compress(PAGE.encode()), PAGE, "utf-8"),
        "3.html": (PAGE.encode("cp1252"), PAGE, "cp1252"),
        "4.html.gz": (gzip.compress(PAGE.encode("cp1252")), PAGE, "cp1252"),
        "5.html.gz": (gzip.compress(declared.encode("cp1252")), declared, "cp1252"),
        "6.html": (wrong.encode("latin-1"), wrong, "cp1252"),
        "7.html": (unknown.encode(), unknown, "utf-8"),
        "8.html": (PAGE.encode("utf-8-sig"), PAGE, "utf-8-sig"),
        "9.html": (PAGE.encode("utf-16"), PAGE, "utf-16"),
        # Plain under a name of gzip, gzip under a plain name, several members, zeros behind them.
        "10.html.gz": (PAGE.encode(), PAGE, "utf-8"),
        "11.html": (gzip.compress(PAGE[:20].encode()) + gzip.compress(PAGE[20:].encode()) + b"\0\0", PAGE, "utf-8"),
        "12.html.gz": (gzip.compress(b""), "", "utf-8"),
        "13.html": (b"\x81\xf1", "\x81ñ", "iso8859-1"),
        # Cut short, damaged, and followed by something else.
        "14.html.gz": (gzip.compress(PAGE.encode())[:-9], None, None),
        "15.html.gz": (b"\x1f\x8b" + b"x" * 40, None, None),
        "16.html.gz": (gzip.compress(PAGE.encode()) + b"rest", None, None),
        "17_A.html": (("ñ" * 3_000_000).encode("latin-1"), "ñ" * 3_000_000, "cp1252"),
    }
    for name, (content, _, _) in cases.items():
        stored(tmp_path, name, content)
    got = documents.read_stored_documents(spark, str(tmp_path)).collect()
    assert {r["number"]: (r["html"], r["charset"]) for r in got} == {n.split(".")[0]: c[1:] for n, c in cases.items()}
    assert {(r["database"], r["kind"], r["year"]) for r in got} == {("cgm", "notificaciones", 2022)}


def test_a_given_charset_comes_first(spark, tmp_path):
    stored(tmp_path, "1.html", "ł".encode("iso8859-2"))
    assert documents.read_stored_documents(spark, str(tmp_path), "iso-8859-2").first()["html"] == "ł"
    stored(tmp_path, "1.html", PAGE.encode())
    assert documents.read_stored_documents(spark, str(tmp_path), "ascii-not").first()["html"] == PAGE


@pytest.mark.parametrize("content", [b"", b"x"])
def test_plain_content_is_left(content):
    assert documents.unpacked(content) == content
