"""H3 cells of points in SQL: the same division of Eisenstein integers, as a recursive query over distinct points."""

from __future__ import annotations

from noticelake.functions import h3


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"{v!r}::DOUBLE" if isinstance(v, float) else str(v) for v in row) + ")" for row in rows)


def _turned(digit: str, turn: str) -> str:
    turns = list(h3.TURNS)
    return f"(CASE WHEN {digit} = 0 THEN 0 ELSE {turns}[((list_position({turns}, {digit}) - 1 + {turn}) % 6)::INT + 1] END)"


def h3_sql(prefix: str, points: str) -> str:
    """Definitions that end in ``{prefix}_cells (lng, lat, h3_res1, ..., h3_res8)``, one row per point of a query."""
    faces = _values([(f, *map(float, axes.ravel())) for f, axes in enumerate(h3.faces())])
    bases = _values([(*place, *found) for place, found in sorted(h3.base_cells().items())])
    digit = [0] * 9
    for (i, j), d in h3.DIGITS.items():
        digit[3 * (i + 1) + j + 1] = d
    p = prefix
    return f"""
{p}_faces(f, cx, cy, cz, ux, uy, uz, vx, vy, vz) AS (VALUES {faces}),
{p}_bases(f, a, b, base, turn, place) AS (VALUES {bases}),
{p}_points AS (SELECT DISTINCT lng, lat, cos(radians(lat)) * cos(radians(lng)) AS px, cos(radians(lat)) * sin(radians(lng)) AS py,
  sin(radians(lat)) AS pz FROM ({points}) WHERE lng IS NOT NULL AND lat IS NOT NULL),
{p}_near AS (SELECT lng, lat, px, py, pz, arg_max(f, px * cx + py * cy + pz * cz) AS f FROM {p}_points, {p}_faces GROUP BY ALL),
{p}_plane AS (SELECT lng, lat, f, (px * ux + py * uy + pz * uz) / (px * cx + py * cy + pz * cz) / {h3.SCALE!r}::DOUBLE AS x,
  (px * vx + py * vy + pz * vz) / (px * cx + py * cy + pz * cz) / {h3.SCALE!r}::DOUBLE AS y FROM {p}_near JOIN {p}_faces USING (f)),
{p}_scaled AS (SELECT lng, lat, f, res, pow(7.0, res // 2) * CASE WHEN res % 2 = 1 THEN 2.5 * x + 0.5 * sqrt(3.0) * y ELSE x END AS x,
  pow(7.0, res // 2) * CASE WHEN res % 2 = 1 THEN 2.5 * y - 0.5 * sqrt(3.0) * x ELSE y END AS y
  FROM {p}_plane, (SELECT unnest(range(1, 9)) AS res)),
{p}_axial AS (SELECT lng, lat, f, res, x + y / sqrt(3.0) AS s, y * 2 / sqrt(3.0) AS t FROM {p}_scaled),
{p}_corners AS (SELECT lng, lat, f, res, floor(s)::BIGINT + i AS a, floor(t)::BIGINT + j AS b, s - floor(s) - i AS da, t - floor(t) - j AS db
  FROM {p}_axial, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(i, j)),
{p}_steps AS (
  SELECT lng, lat, f, res, res AS r, h.a, h.b, []::BIGINT[] AS digits FROM (
    SELECT lng, lat, f, res, arg_min({{'a': a, 'b': b}}, da * da + db * db - da * db) AS h FROM {p}_corners GROUP BY lng, lat, f, res)
  UNION ALL
  SELECT lng, lat, f, res, r - 1, ua, ub, list_prepend({digit}[((a - da + 1) * 3 + b - db + 2)::INT]::BIGINT, digits) FROM (
    SELECT *, CASE WHEN r % 2 = 1 THEN 2 * ua + ub ELSE 3 * ua - ub END AS da, CASE WHEN r % 2 = 1 THEN 3 * ub - ua ELSE ua + 2 * ub END AS db
    FROM (SELECT *, round(CASE WHEN r % 2 = 1 THEN 3 * a - b ELSE 2 * a + b END / 7.0)::BIGINT AS ua,
      round(CASE WHEN r % 2 = 1 THEN a + 2 * b ELSE 3 * b - a END / 7.0)::BIGINT AS ub FROM {p}_steps WHERE r > 0))),
{p}_based AS (SELECT s.lng, s.lat, s.res, s.digits, e.base, e.turn, e.place, coalesce([d FOR d IN s.digits IF d > 0][1], 0) AS lead
  FROM {p}_steps s JOIN {p}_bases e ON s.r = 0 AND e.f = s.f AND e.a = s.a AND e.b = s.b),
{p}_straight AS (SELECT *, (turn + CASE WHEN {_turned('lead', 'turn')} = 1 THEN CASE place WHEN 0 THEN 1 WHEN 1 THEN 5 ELSE 0 END ELSE 0 END) % 6 AS way
  FROM {p}_based),
{p}_ids AS (SELECT lng, lat, res, ((1::BIGINT << 59) + (res << 52) + (base::BIGINT << 45) + list_sum(
  [(CASE WHEN r <= res THEN {_turned('digits[r]', 'way')} ELSE 7 END)::BIGINT << (3 * (15 - r)) FOR r IN range(1, 16)])::BIGINT) AS cell FROM {p}_straight),
{p}_cells AS (SELECT lng, lat, {', '.join(f'max(cell) FILTER (res = {r}) AS h3_res{r}' for r in range(1, 9))} FROM {p}_ids GROUP BY lng, lat)"""
