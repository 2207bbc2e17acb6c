"""Hierarchical cell ids.

Ids are 64-bit: mode in bits 59-62, resolution in bits 52-55, base cell in bits 45-51 and fifteen 3-bit digits,
unused digits being 7. H3 cells (mode 1, see ``h3``) have this layout, so :func:`cell_parent`, :func:`cell_resolution`
and :func:`cell_hex` work on them. :func:`with_grid_cells` encodes points by plain expressions into an exactly nested
lat/lng grid of the same layout under another mode and other column names, so the two are never taken for each other.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.functions.text import _col
from noticelake.schema import CELL_RESOLUTIONS

_RES_SHIFT = 52
_BASE_SHIFT = 45
_MODE_SHIFT = 59
_DIGITS = 15

GRID_MODE = 5
BASE_COLUMNS, BASE_ROWS = 12, 10  # 30° x 18° base cells


def _splits(res: int) -> tuple[int, int]:
    """How a cell of ``res - 1`` is cut into six: (columns, rows)."""
    return (3, 2) if res % 2 else (2, 3)


def _grid_size(res: int) -> tuple[int, int]:
    """Columns and rows a base cell holds at ``res``."""
    columns = rows = 1
    for r in range(1, res + 1):
        sx, sy = _splits(r)
        columns, rows = columns * sx, rows * sy
    return columns, rows


def grid_steps(res: int) -> tuple[float, float]:
    """Cell width and height in degrees."""
    columns, rows = _grid_size(res)
    return 30.0 / columns, 18.0 / rows


def _grid_index(lng: Column, lat: Column, res: int) -> tuple[Column, Column]:
    """Column and row of a point on the whole-world grid of ``res``."""
    columns, rows = _grid_size(res)

    def index(value: Column, per_base: int, bases: int) -> Column:
        i = F.floor(value * F.lit(float(per_base))).cast("long")
        last = F.lit(per_base * bases - 1).cast("long")
        return F.when(i < 0, F.lit(0).cast("long")).when(i > last, last).otherwise(i)

    x = index((lng + F.lit(180.0)) / F.lit(30.0), columns, BASE_COLUMNS)
    y = index((lat + F.lit(90.0)) / F.lit(18.0), rows, BASE_ROWS)
    return x, y


def _cell_of_index(x: Column, y: Column, res: int) -> Column:
    columns, rows = _grid_size(res)
    fixed = (GRID_MODE << _MODE_SHIFT) | (res << _RES_SHIFT)
    for unused in range(res + 1, _DIGITS + 1):
        fixed |= 7 << (3 * (_DIGITS - unused))

    def part(value: Column, size: int) -> Column:
        return F.floor(value / size).cast("long")

    cell = F.lit(fixed) + F.shiftleft(part(y, rows) * BASE_COLUMNS + part(x, columns), _BASE_SHIFT)
    for r in range(1, res + 1):
        sx, sy = _splits(r)
        per_x, per_y = columns // _grid_size(r)[0], rows // _grid_size(r)[1]
        digit = part(y, per_y) % sy * sx + part(x, per_x) % sx
        cell = cell + F.shiftleft(digit, 3 * (_DIGITS - r))
    return cell


def grid_cell(lng: Column | str, lat: Column | str, res: int) -> Column:
    """Grid cell id of a point at one resolution; NULL for a NULL point."""
    return _cell_of_index(*_grid_index(_col(lng), _col(lat), res), res)


def cell_resolution(cell: Column | str) -> Column:
    return F.shiftright(_col(cell), _RES_SHIFT).bitwiseAND(F.lit(15)).cast("int")


def cell_parent(cell: Column | str, res: int) -> Column:
    """Ancestor at ``res``: resolution field replaced, finer digits set to 7."""
    unused = 0
    for r in range(res + 1, _DIGITS + 1):
        unused |= 7 << (3 * (_DIGITS - r))
    keep = ~(15 << _RES_SHIFT)
    return _col(cell).bitwiseAND(F.lit(keep)).bitwiseOR(F.lit((res << _RES_SHIFT) | unused))


def cell_hex(cell: Column | str) -> Column:
    """Lower-case hexadecimal id."""
    return F.lower(F.hex(_col(cell)))


def cell_from_hex(text: str) -> int:
    """Numeric id of a hexadecimal cell."""
    return int(text, 16)


def resolution_of(cell: int | str) -> int:
    """Resolution of a cell given as a value."""
    value = cell_from_hex(cell) if isinstance(cell, str) else cell
    return (value >> _RES_SHIFT) & 15


def with_grid_cells(df: DataFrame, point: str = "point", resolutions: Iterable[int] = CELL_RESOLUTIONS) -> DataFrame:
    """Set ``grid_res1..8`` from a point column: the finest cell is encoded once, the rest are its bit parents."""
    levels = sorted(resolutions)
    finest = levels[-1]
    x, y = _grid_index(F.col(point)["lng"], F.col(point)["lat"], finest)
    indexed = df.withColumns({"_x": x, "_y": y})
    encoded = indexed.withColumn(f"grid_res{finest}", _cell_of_index(F.col("_x"), F.col("_y"), finest)).drop("_x", "_y")
    return encoded.withColumns({f"grid_res{r}": cell_parent(f"grid_res{finest}", r) for r in levels[:-1]})
