"""Facts inferred from a licence plate, as one generated CASE chain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.functions.text import _col, literal_lookup, normalize_plate, null_if_empty


@dataclass(frozen=True)
class PlateRule:
    country: str
    pattern: str
    vehicle_type: str = ""
    mercosur: bool = False


# Plate patterns by country, in the order they are tried (fixed values).
PLATE_RULES = (
    PlateRule("UY", "^[A-Z]{3}[0-9]{4}$", "", True),
    PlateRule("UY", "^[A-S][A-Z]{2}[0-9]{3}$", "Moto"),
    PlateRule("UY", "^[0-9]{6}$"),
    PlateRule("UY", "^[A-Z][0-9]{3,6}$"),
    PlateRule("AR", "^[A-Z]{2}[0-9]{3}[A-Z]{2}$", "Auto", True),
    PlateRule("AR", "^[A-Z][0-9]{3}[A-Z]{3}$", "Moto", True),
    PlateRule("AR", "^[A-Z]{3}[0-9]{3}$", "Auto"),
    PlateRule("BR", "^[A-Z]{3}[0-9][A-Z][0-9]{2}$", "Auto", True),
    PlateRule("BR", "^[A-Z]{3}[0-9]{4}$", "Auto"),
    PlateRule("PY", "^[A-Z]{4}[0-9]{3}$", "Auto", True),
    PlateRule("PY", "^[0-9]{3}[A-Z]{4}$", "Moto", True),
    PlateRule("PY", "^[0-9]{6}$", "Auto"),
    PlateRule("CL", "^[A-Z]{2,4}[0-9]{2,4}$", "Auto"),
)
# Uruguayan letters 2-3 and Chilean letters 1-2 that mark a category (fixed values).
UY_CATEGORIES = {
    "DI": "Discapacidad",
    "ME": "Medico",
    "CC": "Cuerpo Consular",
    "CD": "Cuerpo Diplomático",
    "OI": "Misión Especial",
    "AT": "Admisión Temporaria - Administrativos y Técnicos",
    "NG": "Misión Especial",
    "OF": "Oficial",
    "PJ": "Poder Judicial",
    "AM": "Ambulancia",
    "RE": "Remise",
    "TX": "Taxi",
}
CL_CATEGORIES = {"CC": "Cuerpo Consular", "CD": "Cuerpo Diplomático", "EE": "Misión Especial"}
# Uruguayan prefixes that mark a motorcycle in the Mercosur format (fixed values).
UY_MOTO_PREFIXES = ("AV", "BFM", "BFN", "BFO", "BFP", "BFQ", "LS", "PAV")
# Department letters A to S; any other first letter, or none, means Montevideo (fixed values).
UY_DEPARTMENTS = "^[A-S]"
UY_DEFAULT_DEPARTMENT = "S"
CL_MOTO = "^[A-Z]{4}[0-9]{2}$"
# End of fixed values.

def _rule_number(text: Column, hint: Column | None) -> Column:
    """1-based number of the first rule that fits; 0 when none does."""
    chain = None
    for number, rule in enumerate(PLATE_RULES, 1):
        fits = text.rlike(rule.pattern)
        if hint is not None:
            fits = fits & ((hint == "") | (hint == rule.country))
        chain = F.when(fits, number) if chain is None else chain.when(fits, number)
    return chain.otherwise(0)


def _by_rule(rule: Column, values: list) -> Column:
    """Value of a rule's entry in ``values``; the first entry is for "no rule"."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), rule + 1)


def _fields(text: Column, rule: Column, hint: Column | None) -> dict[str, Column]:
    """Fields of the facts a plate gives, from its text and the rule it fits."""
    country = _by_rule(rule, ["", *[r.country for r in PLATE_RULES]])
    if hint is not None:
        known = sorted({r.country for r in PLATE_RULES})
        country = F.when((rule == 0) & hint.isin(*known), hint).otherwise(country)
    numbers = {c: [n for n, r in enumerate(PLATE_RULES, 1) if r.country == c] for c in ("UY", "CL")}
    is_uy, is_cl = rule.isin(*numbers["UY"]), rule.isin(*numbers["CL"])
    uy_mercosur = rule.isin(*[n for n in numbers["UY"] if PLATE_RULES[n - 1].mercosur])
    uy_moto = uy_mercosur & text.rlike("^(" + "|".join(UY_MOTO_PREFIXES) + ")")
    cl_special = text.rlike("^(" + "|".join(CL_CATEGORIES) + ")")
    cl_moto = is_cl & ~cl_special & text.rlike(CL_MOTO)
    return {
        "country": country,
        "adm_division": F.when(is_uy & text.rlike(UY_DEPARTMENTS), F.substring(text, 1, 1))
        .when(is_uy, UY_DEFAULT_DEPARTMENT)
        .otherwise(""),
        "vehicle_type": F.when(uy_moto | cl_moto, "Moto").otherwise(
            _by_rule(rule, ["", *[r.vehicle_type for r in PLATE_RULES]])
        ),
        "category": F.when(uy_mercosur, F.coalesce(literal_lookup(F.substring(text, 2, 2), UY_CATEGORIES), F.lit("")))
        .when(is_cl, F.coalesce(literal_lookup(F.substring(text, 1, 2), CL_CATEGORIES), F.lit("")))
        .otherwise(""),
        "mercosur_format": _by_rule(rule, [False, *[r.mercosur for r in PLATE_RULES]]),
    }


def infer_plate(plate: Column | str, hint: Column | str | None = None, reference_compat: bool = False) -> Column:
    """struct(country, adm_division, vehicle_type, category, mercosur_format) of the first fitting pattern.

    With a non-empty ``hint`` column only that country's patterns are tried; a miss keeps the hint country with
    empty fields. Without a match all fields are empty.
    """
    text = F.coalesce(normalize_plate(plate, reference_compat), F.lit(""))
    hint = None if hint is None else F.coalesce(_col(hint), F.lit(""))
    fields = _fields(text, _rule_number(text, hint), hint)
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _with_plate_fields(df: DataFrame, plate: str, hint: str | None) -> tuple[DataFrame, dict[str, Column]]:
    """Plate text and rule as columns, so that every field reads them instead of computing them again."""
    hint_col = None if hint is None else F.coalesce(F.col(hint), F.lit(""))
    staged = df.withColumn("_text", F.coalesce(normalize_plate(plate), F.lit("")))
    staged = staged.withColumn("_rule", _rule_number(F.col("_text"), hint_col))
    return staged, _fields(F.col("_text"), F.col("_rule"), hint_col)


def with_vehicle(df: DataFrame, plate: str = "vehicle", hint: str | None = None) -> DataFrame:
    """Set ``vehicle_country`` and ``vehicle_type`` from the plate; empty becomes NULL."""
    staged, fields = _with_plate_fields(df, plate, hint)
    return staged.withColumns(
        {
            "vehicle_country": null_if_empty(fields["country"]),
            "vehicle_type": null_if_empty(fields["vehicle_type"]),
        }
    ).drop("_text", "_rule")


def plate_report(df: DataFrame, column: str = "vehicle") -> DataFrame:
    """One row per distinct plate with the inferred fields, or an error when nothing is known."""
    plates = df.select(F.col(column).alias("plate")).where(F.col("plate").isNotNull()).distinct()
    staged, fields = _with_plate_fields(plates, "plate", None)
    return staged.select(
        "plate",
        *[c.alias(n) for n, c in fields.items()],
        F.when(F.col("_rule") == 0, "no info available").alias("error"),
    )
