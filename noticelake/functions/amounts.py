"""Fine amounts: fixed point with two decimals, stored as hundredths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticelake.functions.text import _col

# Trailing unit marks, each a set of characters trimmed from the right, in this order (fixed values).
UNIT_MARKS = ("XPERS", " X PERS", " X PERS.", " X PERS,", " X ASIEN", "UR")
# End of fixed values.

_AMOUNT = r"^([+-]?[0-9]+)(?:\.([0-9]{0,2}))?$"


def parse_ur(c: Column | str) -> Column:
    """struct(value int, error string): '' is 0, ',' is a decimal point, at most two decimals."""
    raw = _col(c)
    text = raw
    for marks in UNIT_MARKS:
        text = F.rtrim(text, F.lit(marks))
    text = F.replace(text, F.lit(","), F.lit("."))
    units = F.regexp_extract(text, _AMOUNT, 1).try_cast("long")
    cents = F.rpad(F.regexp_extract(text, _AMOUNT, 2), 2, "0").cast("int")
    value = F.when(raw == "", F.lit(0)).when(text.rlike(_AMOUNT), (units * 100 + cents).try_cast("int"))
    return F.struct(
        value.alias("value"),
        F.when(
            raw.isNotNull() & value.isNull(),
            F.concat(F.lit('can\'t convert "'), raw, F.lit('" to UR')),
        ).alias("error"),
    )


def format_ur(c: Column | str) -> Column:
    """Hundredths as shortest decimal text: 500 → "5", 50 → "0.5", 5 → "0.05"."""
    text = (_col(c).cast("decimal(12,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(12,2)").cast("string")
    return F.regexp_replace(text, r"\.?0+$", "")
