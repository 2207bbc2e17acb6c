"""H3 cells of points: aperture-7 hexagons on the faces of an icosahedron.

A point is projected from the centre of the sphere onto its nearest face. There, hexagon centres of a resolution are the
Eisenstein integers ``a + b w`` (``w`` a third of a turn), and the centres of the next coarser one are those divisible by
``2 - w`` (odd resolutions) or ``3 + w`` (even ones), both of norm 7. So a cell's digits are the remainders of repeated
division with rounding; what is left names one of ten base cells of the face. Digits are then turned from the face's axes
to those of the base cell's home face. Around the twelve pentagons only five faces meet and the digit 1 does not exist:
of the sectors on either side of it, the home face's and the next one, digits that would become 1 are turned past it.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.functions.text import _col
from noticelake.schema import CELL_RESOLUTIONS

# Fixed values of the H3 system. Centres of the first ten faces, latitude and longitude in radians; the others lie opposite.
_FACE_CENTERS = (
    (0.803582649718989942, 1.248397419617396099),
    (1.307747883455638156, 2.536945009877921159),
    (1.054751253523952054, -1.347517358900396623),
    (0.600191595538186799, -0.450603909469755746),
    (0.491715428198773866, 0.401988202911306943),
    (0.172745327415618701, 1.678146885280433686),
    (0.605929321571350690, 2.953923329812411617),
    (0.427370518328979641, -1.888876200336285401),
    (-0.079066118549212831, -0.733429513380867741),
    (-0.230961644455383637, 0.506495587332349035),
)
_OPPOSITE = (8, 9, 5, 6, 7, 3, 4, 0, 1, 2)  # of faces 10 to 19
# Azimuth of each face's first axis, towards one of its corners.
_FIRST_AXIS = (
    5.619958268523939882, 5.760339081714187279, 0.780213654393430055, 0.430469363979999913, 6.130269123335111400,
    2.692877706530642877, 2.982963003477243874, 3.532912002790141181, 3.494305004259568154, 3.003214169499538391,
    5.930472956509811562, 0.138378484090254847, 0.448714947059150361, 0.158629650112549365, 5.891865957979238535,
    2.711123289609793325, 3.294508837434268316, 3.804819692245439833, 3.664438879055192436, 2.361378999196363184,
)
# Home faces of the pentagons, in the order of their base cells.
_PENTAGON_HOMES = (0, 11, 10, 12, 14, 13, 6, 7, 5, 8, 9, 15)
# Base cells that lie on an edge belong to the face of which that edge has one of these places, by rows of five faces.
_EDGE_HOMES = (((1, 1), (-1, 0)), ((0, -1),), ((1, 1),), ((-1, 0), (0, -1)))

# Centres of base cells on a face: its middle, three around it, three on edges and three at corners.
_PLACES = ((0, 0), (1, 0), (0, 1), (-1, -1), (1, 1), (-1, 0), (0, -1), (2, 0), (0, 2), (-2, -2))
# Digits by the step they stand for, and in counterclockwise order from the first axis.
DIGITS = {(0, 0): 0, (-1, -1): 1, (0, 1): 2, (-1, 0): 3, (1, 0): 4, (0, -1): 5, (1, 1): 6}
TURNS = (4, 6, 2, 3, 1, 5)

SCALE = (3 - 5**0.5) / 2  # distance of neighbouring base cells on a face
MODE, MODE_SHIFT, RES_SHIFT, BASE_SHIFT, FINEST = 1, 59, 52, 45, 15


def _unit(lat, lng) -> np.ndarray:
    lat, lng = np.asarray(lat, float), np.asarray(lng, float)
    return np.stack((np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)), axis=-1)


@cache
def faces() -> np.ndarray:
    """Centre, first axis and the axis a quarter turn counterclockwise from it, as unit vectors, of each of the 20 faces."""
    lat, lng = map(np.array, zip(*_FACE_CENTERS, strict=True))
    lat, lng = np.concatenate((lat, -lat[list(_OPPOSITE)])), np.concatenate((lng, lng[list(_OPPOSITE)] + np.pi))
    center = _unit(lat, lng)
    north = np.stack((-np.sin(lat) * np.cos(lng), -np.sin(lat) * np.sin(lng), np.cos(lat)), axis=-1)
    east = np.stack((-np.sin(lng), np.cos(lng), np.zeros(20)), axis=-1)
    turn = np.array(_FIRST_AXIS)[:, None]
    first = np.cos(turn) * north + np.sin(turn) * east
    return np.stack((center, first, np.cross(center, first)), axis=1)


def _on_sphere(face: int, a: float, b: float) -> np.ndarray:
    """Point of the sphere above a place on a face, in base cell steps."""
    center, first, second = faces()[face]
    p = center + SCALE * ((a - b / 2) * first + b * 3**0.5 / 2 * second)
    return p / np.linalg.norm(p)


@cache
def base_cells() -> dict[tuple[int, int, int], tuple[int, int, int]]:
    """By face and place: base cell, sixths of a turn to its home's axes, and for pentagons the face's rank from home.

    Base cells are numbered from north to south. The rank counts faces counterclockwise around a pentagon; -1 for hexagons.
    """
    points = {(f, *p): _on_sphere(f, *p) for f in range(20) for p in _PLACES}
    centers: list[np.ndarray] = []
    for p in points.values():
        if not any(p @ c > 1 - 1e-9 for c in centers):
            centers.append(p)
    centers.sort(key=lambda c: -c[2])
    number = {k: int(np.argmax(np.array(centers) @ p)) for k, p in points.items()}
    # Places just over an edge: rounding may arrive at them from points on the edge.
    for f in range(20):
        for a in range(-2, 3):
            for b in range(-2, 3):
                p = _on_sphere(f, a, b)
                number.setdefault((f, a, b), int(np.argmax(np.array(centers) @ p)))
    pentagons = sorted({n for (_, a, b), n in number.items() if (a, b) in _PLACES[7:]})
    home: dict[int, tuple[int, int, int]] = {}
    for (f, a, b), n in number.items():
        if (a, b) in _PLACES[:4] or (a, b) in _EDGE_HOMES[f // 5]:
            home.setdefault(n, (f, a, b))
    home |= {n: (f, 2, 0) for n, f in zip(pentagons, _PENTAGON_HOMES, strict=True)}

    def angle(n: int, towards: np.ndarray) -> float:
        """Direction from a base cell's centre, counterclockwise from the first axis of its home."""
        f, a, b = home[n]
        ahead = _on_sphere(f, a + 1e-4, b) - centers[n]
        side = np.cross(centers[n], ahead)
        return float(np.arctan2(towards @ side, towards @ ahead))

    out = {}
    for (f, a, b), n in number.items():
        if n not in pentagons:
            turn = angle(n, _on_sphere(f, a + 1e-4, b) - _on_sphere(f, a, b))
            out[f, a, b] = (n, round(turn / (np.pi / 3)) % 6, -1)
        elif (a, b) in _PLACES[7:]:
            rank = round((angle(n, faces()[f][0] - centers[n]) - np.pi) / (2 * np.pi / 5)) % 5
            own = {(2, 0): 3, (0, 2): 5, (-2, -2): 1}[a, b]
            out[f, a, b] = (n, ((3, 5, 6, 7, 8)[rank] - own) % 6, rank)
    return out


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Base cell, turn and rank by face and place; digits by turn."""
    table = np.full((20, 5, 5, 3), -1, np.int64)
    for (f, a, b), found in base_cells().items():
        table[f, a + 2, b + 2] = found
    turned = np.zeros((6, 7), np.int64)
    for t in range(6):
        for i, d in enumerate(TURNS):
            turned[t, d] = TURNS[(i + t) % 6]
    return table, turned


def _nearest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Eisenstein integer nearest to a point: one of the corners of the rhombus around it."""
    low_a, low_b = np.floor(a), np.floor(b)
    best = np.full(a.shape, np.inf)
    out_a, out_b = low_a, low_b
    for i in (0, 1):
        for j in (0, 1):
            da, db = a - (low_a + i), b - (low_b + j)
            d = da * da + db * db - da * db
            nearer = d < best
            best = np.where(nearer, d, best)
            out_a, out_b = np.where(nearer, low_a + i, out_a), np.where(nearer, low_b + j, out_b)
    return out_a.astype(np.int64), out_b.astype(np.int64)


def cells_of(lng: np.ndarray, lat: np.ndarray, res: int) -> np.ndarray:
    """Cell ids of points in degrees, as signed 64-bit integers."""
    points = _unit(np.radians(lat), np.radians(lng))
    frames = faces()
    face = np.argmax(points @ frames[:, 0].T, axis=1)
    depth = np.einsum("ij,ij->i", points, frames[face, 0])
    x = np.einsum("ij,ij->i", points, frames[face, 1]) / depth
    y = np.einsum("ij,ij->i", points, frames[face, 2]) / depth
    z = (x + 1j * y) / SCALE * 7 ** (res // 2)
    if res % 2:
        z = z * (2.5 - 0.5j * 3**0.5)
    b = z.imag * 2 / 3**0.5
    a, b = _nearest(z.real + b / 2, b)
    digits = np.zeros((res + 1, len(a)), np.int64)
    step_digit = np.zeros((3, 3), np.int64)
    for (i, j), d in DIGITS.items():
        step_digit[i + 1, j + 1] = d
    for r in range(res, 0, -1):
        # Times the conjugate, over the norm, rounded; then what the product with the divisor leaves.
        if r % 2:
            up_a, up_b = np.rint((3 * a - b) / 7).astype(np.int64), np.rint((a + 2 * b) / 7).astype(np.int64)
            down_a, down_b = 2 * up_a + up_b, 3 * up_b - up_a
        else:
            up_a, up_b = np.rint((2 * a + b) / 7).astype(np.int64), np.rint((3 * b - a) / 7).astype(np.int64)
            down_a, down_b = 3 * up_a - up_b, up_a + 2 * up_b
        digits[r] = step_digit[a - down_a + 1, b - down_b + 1]
        a, b = up_a, up_b
    table, turned = _tables()
    base, turn, rank = table[face, a + 2, b + 2].T
    some = digits > 0
    lead = np.where(some.any(axis=0), digits[np.argmax(some, axis=0), np.arange(len(a))], 0)
    # Digit 1 of a pentagon: from home on to the next sector, from the next one back.
    missing = turned[turn, lead] == 1
    turn = (turn + (missing & (rank == 0)) - (missing & (rank == 1))) % 6
    out = np.full(len(a), MODE << MODE_SHIFT | res << RES_SHIFT, np.int64) + (base << BASE_SHIFT)
    for r in range(1, FINEST + 1):
        digit = turned[turn, digits[r]] if r <= res else np.int64(7)
        out += digit << 3 * (FINEST - r)
    return out


def _encoder(levels: list[int]):
    def encode(lng: pa.Array, lat: pa.Array) -> pa.Array:
        x, y = (v.cast(pa.float64()).to_numpy(zero_copy_only=False) for v in (lng, lat))
        known = np.isfinite(x) & np.isfinite(y)
        found = np.stack([cells_of(x[known], y[known], r) for r in levels], axis=1)
        ends = np.concatenate(([0], np.cumsum(known))) * len(levels)
        # A NULL offset makes a NULL list.
        offsets = pa.array(ends, pa.int32(), mask=np.concatenate((~known, [False])))
        return pa.ListArray.from_arrays(offsets, pa.array(found.ravel(), pa.int64()))

    encode.__annotations__ = {"lng": pa.Array, "lat": pa.Array, "return": pa.Array}
    return F.arrow_udf(encode, "array<long>")


def h3_cells(lng: Column | str, lat: Column | str, resolutions: Iterable[int] = CELL_RESOLUTIONS) -> Column:
    """Cells of a point in degrees at each resolution, in that order; NULL where a coordinate is NULL or not finite.

    Each resolution has its own cell: the parent of a point's fine cell need not hold the point.
    """
    return _encoder(list(resolutions))(_col(lng).cast("double"), _col(lat).cast("double"))


def h3_cell(lng: Column | str, lat: Column | str, res: int) -> Column:
    """Cell of a point at one resolution."""
    return h3_cells(lng, lat, [res])[0]


def with_h3_cells(df: DataFrame, point: str = "point", resolutions: Iterable[int] = CELL_RESOLUTIONS) -> DataFrame:
    """Set ``h3_res1..8`` from a point column, encoding each row once."""
    levels = sorted(resolutions)
    found = df.withColumn("_cells", h3_cells(F.col(point)["lng"], F.col(point)["lat"], levels))
    return found.withColumns({f"h3_res{r}": F.col("_cells")[i] for i, r in enumerate(levels)}).drop("_cells")
