"""Text normalisation and small lookups as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_table() -> tuple[str, str]:
    """(from, to) strings for ``translate``: precomposed Latin letters to their base, combining marks dropped."""
    source, target = [], []
    for point in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        letter = chr(point)
        base = "".join(c for c in unicodedata.normalize("NFD", letter) if unicodedata.category(c) != "Mn")
        if base != letter and len(base) == 1:
            source.append(letter)
            target.append(base)
    marks = "".join(chr(p) for p in range(0x0300, 0x0370) if unicodedata.category(chr(p)) == "Mn")
    return "".join(source) + marks, "".join(target)


_ACCENTED, _PLAIN = _accent_table()

# White space as Unicode defines it, for Java regular expressions.
_SPACE = r"[\s\u0085\p{Z}]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_accents(c: Column | str) -> Column:
    """Drop diacritics from Latin letters."""
    return F.translate(_col(c), _ACCENTED, _PLAIN)


def trim_space(c: Column | str) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return F.regexp_replace(_col(c), f"^{_SPACE}+|{_SPACE}+$", "")


def fold(c: Column | str) -> Column:
    """Lower-case, trimmed, accent-free form: a plain string usable as a join key."""
    return strip_accents(trim_space(F.lower(_col(c))))


def normalize_header(c: Column | str) -> Column:
    """Letters only, accent-free, lower case."""
    return F.lower(strip_accents(F.regexp_replace(_col(c), r"[^\p{L}]", "")))


def normalize_plate(c: Column | str, reference_compat: bool = False) -> Column:
    """Plate without spaces and dashes, upper case, without the ``(E)`` foreign mark.

    ``reference_compat`` trims any trailing run of ``(``, ``E`` and ``)``, so a plate ending in E loses it.
    """
    plate = F.upper(F.regexp_replace(_col(c), r"[\s\u0085\p{Z}\-]", ""))
    return F.regexp_replace(plate, r"[(E)]+$" if reference_compat else r"(\(E\))+$", "")


def normalize_plate_query(c: Column | str) -> Column:
    """Plate as typed into a search box: no white space, upper case."""
    return F.upper(F.regexp_replace(_col(c), f"{_SPACE}+", ""))


def tokens(c: Column | str) -> Column:
    """Folded alphanumeric words, repeats kept."""
    words = F.split(F.regexp_replace(fold(c), r"[^a-zA-Z0-9\s]", ""), r"\s+")
    return F.filter(words, lambda w: w != "")


def description_parts(c: Column | str) -> Column:
    """Comma parts, trimmed, blanks dropped, order kept."""
    return F.filter(F.transform(F.split(_col(c), ","), trim_space), lambda p: p != "")


# Country names after header normalisation (fixed values); "otro" is a known name without a code.
COUNTRY_CODES = {
    "argentina": "AR",
    "uruguay": "UY",
    "brasil": "BR",
    "paraguay": "PY",
    "chile": "CL",
    "otro": "",
}
# End of fixed values.


def literal_lookup(key: Column, table: dict) -> Column:
    """Lookup in a small fixed table; NULL when absent."""
    mapping = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(mapping, key)


def country_iso(c: Column | str) -> Column:
    """ISO code of a country name; '' for "otro"; NULL when the name is unknown."""
    return literal_lookup(normalize_header(c), COUNTRY_CODES)


def clean_description(c: Column | str) -> Column:
    """Drop leading colons and blanks."""
    return F.ltrim(_col(c), F.lit(": "))


def sanitize_location(c: Column | str) -> Column:
    """Trim. The text is half of a key and stays whole; the validation of judgments reports what is too long."""
    return trim_space(c)


def drop_facing_number(c: Column | str) -> Column:
    """Rewrite "… frente al n° …" to a blank, as one database writes its addresses."""
    return F.regexp_replace(_col(c), r"(?iu)\s+frente\s+al\s+n°\s+", " ")


def normalize_marker(c: Column | str) -> Column:
    """Kilometre marker(s) ``038k131`` → ``38k131``; several markers are separated by '/'."""

    def one(part: Column) -> Column:
        part = trim_space(part)
        pieces = F.split(part, "k")
        km = F.ltrim(pieces[0], F.lit("0"))
        metres = F.coalesce(pieces[1].try_cast("int"), F.lit(0))
        formatted = F.concat(
            F.when(km == "", F.lit("0")).otherwise(km), F.lit("k"), F.format_string("%03d", metres)
        )
        return F.when(F.size(pieces) == 2, formatted).otherwise(part)

    return F.array_join(F.transform(F.split(F.lower(_col(c)), "/"), one), "/")


def null_if_empty(c: Column | str) -> Column:
    return F.nullif(_col(c), F.lit(""))


def null_if_zero(c: Column | str) -> Column:
    return F.nullif(_col(c), F.lit(0))


# Spellings that arrive from a wrong decoding (fixed values), applied in order.
MOJIBAKE = (
    ("Ã³", "ó"),
    ("Ã¡", "á"),
    ("Ãƒ?", "Ñ"),
    ("mÃnimo", "mínimo"),
    ("E´", "É"),
    ("X\nPERS", "XPERS"),
    ("\n", " "),
)
# Characters a clean text may hold (fixed value).
ALLOWED_TEXT = r"(?iu)^[ -\u007Fáéíóöúñº°ªq]*$"
# End of fixed values.


def repair_text(c: Column | str) -> Column:
    """Known bad spellings repaired."""
    text = _col(c)
    for bad, good in MOJIBAKE:
        text = F.replace(text, F.lit(bad), F.lit(good))
    return text


def check_text(text: Column) -> Column:
    """struct(text, error): error set, and no text, when a foreign character is left."""
    valid = text.rlike(ALLOWED_TEXT)
    return F.struct(
        F.when(valid, text).alias("text"),
        F.when(~valid, F.concat(F.lit('invalid character in "'), text, F.lit('"'))).alias("error"),
    )


def clean_texts(texts: Column) -> Column:
    """:func:`clean_text` of each text of an array; the repairs run once per text."""
    return F.transform(F.transform(texts, repair_text), check_text)


def clean_text(c: Column | str) -> Column:
    """struct(text, error): known bad spellings repaired, error set when a foreign character is left."""
    return check_text(repair_text(c))


def contains_any_case(c: Column, needle: str) -> Column:
    """Case-insensitive substring test; the needle is taken literally."""
    return F.contains(F.lower(c), F.lit(needle.lower()))
