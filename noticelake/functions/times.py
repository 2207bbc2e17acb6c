"""Civil date-times written by hand, in several layouts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticelake.functions.text import _col

CIVIL_ZONE = "America/Montevideo"

# Layouts in the order they are tried (fixed values): pattern after blanks are removed, and the meaning of its
# groups (y4/y2 year, M month, d day, h hour, m minute).
LAYOUTS = (
    (r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})([0-9]{1,2}):([0-9]{2})$", ("d", "M", "y4", "h", "m")),
    (r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{2})([0-9]{1,2})\.([0-9]{2})$", ("d", "M", "y2", "h", "m")),
    (r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})([0-9]{1,2})\.([0-9]{2})$", ("d", "M", "y4", "h", "m")),
    (r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{2})([0-9]{1,2}):([0-9]{2})$", ("d", "M", "y2", "h", "m")),
    (r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})([0-9]{1,2}):([0-9]{1,2})$", ("d", "M", "y4", "h", "m")),
    (r"^([0-9]{4})-([0-9]{2})-([0-9]{2})([0-9]{1,2}):([0-9]{2})$", ("y4", "M", "d", "h", "m")),
    (r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$", ("d", "M", "y4")),
    (r"^([0-9]{1,2})/([0-9]{1,2})/0([0-9]{2})$", ("d", "M", "y2")),
    (r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{2})$", ("d", "M", "y2")),
    (r"^([0-9]{2})-([0-9]{2})-([0-9]{4})$", ("d", "M", "y4")),
    (r"^([0-9]{2})-([0-9]{2})-([0-9]{2})$", ("y2", "d", "M")),
    (r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$", ("M", "d", "y4")),
)
# End of fixed values.


def _layout_time(text: Column, pattern: str, groups: tuple[str, ...], tz: str) -> Column:
    part = {
        g: F.regexp_extract(text, pattern, i + 1).try_cast("int")
        for i, g in enumerate(groups)
    }
    # Two-digit years from 69 on belong to the 1900s.
    year = part.get("y4")
    if year is None:
        year = F.when(part["y2"] >= 69, part["y2"] + 1900).otherwise(part["y2"] + 2000)
    zero = F.lit(0)
    made = F.try_make_timestamp(
        year, part["M"], part["d"], part.get("h", zero), part.get("m", zero), F.lit(0).cast("decimal(8,6)"), F.lit(tz)
    )
    return F.when(text.rlike(pattern), made)


def parse_offense_time(c: Column | str, tz: str = CIVIL_ZONE) -> Column:
    """Instant of a civil date-time; NULL when no layout fits.

    Built from number groups, so the result does not depend on the session zone or parser policy.
    """
    text = F.ltrim(F.rtrim(F.replace(_col(c), F.lit(" "), F.lit("")), F.lit("HS")), F.lit("/"))
    return F.coalesce(*[_layout_time(text, pattern, groups, tz) for pattern, groups in LAYOUTS])


def civil_midnight(day: Column | str, tz: str = CIVIL_ZONE) -> Column:
    """Instant at which a civil day begins."""
    d = _col(day)
    return F.try_make_timestamp(
        F.year(d), F.month(d), F.dayofmonth(d), F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)"), F.lit(tz)
    )
