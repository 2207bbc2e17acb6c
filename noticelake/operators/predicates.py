"""Faceted filters: values are OR-ed inside a dimension, dimensions are AND-ed."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.schema import ARRAY_DIMENSIONS, DIMENSION_COLUMNS, FEATURES, INTEGER_DIMENSIONS

Predicates = Mapping[str, Sequence[str]]


def dimension_column(dim: str) -> Column:
    """Column of a dimension; arrays stay arrays."""
    if dim not in DIMENSION_COLUMNS or dim == "features":
        raise ValueError(f"unknown dimension: {dim}")
    column = F.col(DIMENSION_COLUMNS[dim])
    return column.cast("date") if dim == "date" else column


def feature_conditions() -> dict[str, Column]:
    """The four overlapping yes/no features of a record; never NULL."""
    has_ur = F.col("ur").isNotNull() & (F.col("ur") != 0)
    return {
        "with_error": F.col("error").isNotNull(),
        "no_error": F.col("error").isNull(),
        "with_ur": F.coalesce(has_ur, F.lit(False)),
        "no_ur": F.coalesce(~has_ur, F.lit(True)),
    }


def _integers(values: Iterable[str]) -> list[int]:
    """Values that are integers; others can match nothing."""
    parsed = []
    for v in values:
        try:
            parsed.append(int(str(v).strip()))
        except ValueError:
            continue
    return parsed


def _any(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def predicate(dim: str, values: Sequence[str]) -> Column | None:
    """Condition of one dimension; None when there is nothing to filter."""
    if not values:
        return None
    if dim == "features":
        conditions = feature_conditions()
        known = [conditions[v] for v in values if v in FEATURES]
        return _any(known) if known else None
    column = dimension_column(dim)
    typed = _integers(values) if dim in INTEGER_DIMENSIONS else [str(v) for v in values]
    if dim in ARRAY_DIMENSIONS:
        return _any(F.array_contains(column, F.lit(v)) for v in typed)
    if dim == "description":
        return _any(F.contains(column, F.lit(v)) for v in typed)
    if dim == "vehicle_type":
        named = [v for v in typed if v != ""]
        parts = [column.isNull()] if len(named) < len(typed) else []
        return _any(parts + ([column.isin(*named)] if named else []))
    if dim == "date":
        # Ranges of the stored column, which reach the files' statistics; a cast of it would not.
        days, stored = [F.lit(v).try_cast("date") for v in typed], F.col(DIMENSION_COLUMNS[dim])
        return _any((stored >= day) & (stored < F.date_add(day, 1)) for day in days)
    return column.isin(*typed) if typed else F.lit(False)


def condition(preds: Predicates | None, exclude: str | None = None) -> Column:
    """Conjunction of all predicates but that of ``exclude``."""
    parts = [
        c
        for dim, values in (preds or {}).items()
        if dim != exclude and (c := predicate(dim, values)) is not None
    ]
    return reduce(and_, parts) if parts else F.lit(True)


def apply_predicates(df: DataFrame, preds: Predicates | None, exclude: str | None = None) -> DataFrame:
    """Filter by the predicates, leaving out the one on ``exclude``."""
    return df.where(condition(preds, exclude)) if preds else df


def chart_filter(df: DataFrame, preds: Predicates | None) -> DataFrame:
    """Predicates, and records without error only."""
    return apply_predicates(df, preds).where(F.col("error").isNull())
