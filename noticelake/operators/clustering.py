"""Locations that lie close together, and what to do about them.

A cluster is a connected component: two locations at most ``metres`` apart belong together, and so do chains of them.

Nothing is compared pair by pair inside a group. Points are put into square grid boxes whose diagonal is at most
``metres``, so all points of a box are linked without looking at them. What remains is which neighbouring boxes hold two
points near enough. That is answered from the boxes' tight bounds: their least possible distance is too far, or their
greatest possible distance is near enough. Undecided pairs, of boxes holding several points each, are cut into finer boxes
and asked again; bounds shrink to single points, for which both distances are exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.functions.geo import EARTH_RADIUS_M, chord_metres, haversine_m
from noticelake.operators.queues import offense_counts
from noticelake.storage import checkpoint

# Each refinement cuts a box into 8 x 8. Doubles resolve about 1e-14 degrees here, which eleven cuts reach.
_CUT = 8
_MAX_CUTS = 11
_METRES_PER_DEGREE = EARTH_RADIUS_M * math.pi / 180
_BOUNDS = ("lat_lo", "lat_hi", "lng_lo", "lng_hi")


def _boxed(points: DataFrame, metres: float) -> DataFrame:
    """Distinct (lat, lng) with box row ``y`` and column ``x``; column width follows the row's latitude."""
    side = metres / math.sqrt(2) * 0.999
    step = side / _METRES_PER_DEGREE
    rows = points.select("lat", "lng").distinct().withColumn("y", F.floor((F.col("lat") + 90) / step).cast("long"))
    return rows.withColumn("x", F.floor((F.col("lng") + 180) / _width(F.col("y"), step)).cast("long"))


def _width(y: Column, step: float) -> Column:
    """Column width in degrees of a box row: ``side`` metres at its edge nearest the equator."""
    south, north = y * step - 90, (y + 1) * step - 90
    nearest = F.least(F.abs(south), F.abs(north))
    return F.lit(step) / F.greatest(F.cos(F.radians(nearest)), F.lit(1e-9))


def _bounds() -> list[Column]:
    return [
        F.min("lat").alias("lat_lo"),
        F.max("lat").alias("lat_hi"),
        F.min("lng").alias("lng_lo"),
        F.max("lng").alias("lng_hi"),
    ]


def _neighbours(boxes: DataFrame, metres: float) -> DataFrame:
    """Pairs of different boxes, each once, close enough to matter; a fixed number of candidates per box."""
    step = metres / math.sqrt(2) * 0.999 / _METRES_PER_DEGREE
    reach_y = math.ceil(metres / _METRES_PER_DEGREE / step)
    rows = boxes.withColumn(
        "ny", F.explode(F.sequence(F.col("y"), F.col("y") + reach_y))
    )
    width = _width(F.col("ny"), step)
    # Longitudes a point of this row may have within reach of the box.
    farthest = F.least(F.greatest(F.abs(F.col("lat_lo")), F.abs(F.col("lat_hi"))) + metres / _METRES_PER_DEGREE, F.lit(89.9))
    slack = F.lit(1.001 * metres / _METRES_PER_DEGREE) / F.cos(F.radians(farthest))
    first = F.floor((F.col("lng_lo") - slack + 180) / width).cast("long")
    last = F.floor((F.col("lng_hi") + slack + 180) / width).cast("long")
    wanted = rows.withColumn("nx", F.explode(F.sequence(first, last))).where(
        (F.col("ny") > F.col("y")) | (F.col("nx") > F.col("x"))
    )
    other = boxes.select(
        F.col("y").alias("ny"), F.col("x").alias("nx"), *[F.col(b).alias(f"{b}2") for b in _BOUNDS]
    )
    return wanted.join(other, ["ny", "nx"])


def _distance_bounds(a: str = "", b: str = "2") -> tuple[Column, Column]:
    """(least, greatest) possible metres between a point of one bound box and a point of the other."""

    def col(name: str, side: str) -> Column:
        return F.col(name + side)

    def spread(lo: str, hi: str) -> tuple[Column, Column]:
        near = F.greatest(
            F.lit(0.0), col(lo, b) - col(hi, a), col(lo, a) - col(hi, b)
        )
        far = F.greatest(col(hi, b) - col(lo, a), col(hi, a) - col(lo, b))
        return near, far

    def cosines(side: str) -> tuple[Column, Column]:
        low, high = F.cos(F.radians(col("lat_lo", side))), F.cos(F.radians(col("lat_hi", side)))
        crosses = (col("lat_lo", side) < 0) & (col("lat_hi", side) > 0)
        return F.least(low, high), F.when(crosses, F.lit(1.0)).otherwise(F.greatest(low, high))

    def metres(dlat: Column, dlng: Column, cos_a: Column, cos_b: Column) -> Column:
        half_lat, half_lng = F.sin(F.radians(dlat) / 2), F.sin(F.radians(dlng) / 2)
        return chord_metres(half_lat * half_lat + cos_a * cos_b * half_lng * half_lng)

    near_lat, far_lat = spread("lat_lo", "lat_hi")
    near_lng, far_lng = spread("lng_lo", "lng_hi")
    least_a, greatest_a = cosines(a)
    least_b, greatest_b = cosines(b)
    return metres(near_lat, near_lng, least_a, least_b), metres(far_lat, far_lng, greatest_a, greatest_b)


def _linked_boxes(points: DataFrame, metres: float) -> tuple[DataFrame, DataFrame]:
    """(points with their ``box``, pairs (a, b) of linked boxes)."""
    boxed = checkpoint(
        _boxed(points, metres).withColumn("box", F.concat_ws(":", "y", "x"))
    )
    boxes = boxed.groupBy("y", "x").agg(*_bounds())
    least, greatest = _distance_bounds()
    asked = (
        _neighbours(boxes, metres)
        .withColumns({"_least": least, "_greatest": greatest})
        .where(F.col("_least") <= metres)
        .select(
            F.concat_ws(":", "y", "x").alias("a"),
            F.concat_ws(":", "ny", "nx").alias("b"),
            (F.col("_greatest") <= metres).alias("linked"),
        )
    )
    asked = checkpoint(asked)
    links = asked.where("linked").select("a", "b")
    open_pairs = asked.where(~F.col("linked")).select("a", "b", F.col("a").alias("part_a"), F.col("b").alias("part_b"))
    cut = 0
    while cut < _MAX_CUTS and not open_pairs.isEmpty():
        cut += 1
        parts = _parts(boxed, metres, cut)
        sides = {}
        for side in ("a", "b"):
            suffix = "" if side == "a" else "2"
            sides[side] = parts.select(
                F.col("parent").alias(f"part_{side}"),
                F.col("part").alias(f"next_{side}"),
                *[F.col(n).alias(n + suffix) for n in _BOUNDS],
            )
        finer = (
            open_pairs.join(sides["a"], "part_a")
            .join(sides["b"], "part_b")
            .withColumns({"_least": least, "_greatest": greatest})
            .where(F.col("_least") <= metres)
            .select(
                "a",
                "b",
                F.col("next_a").alias("part_a"),
                F.col("next_b").alias("part_b"),
                (F.col("_greatest") <= metres).alias("linked"),
            )
        )
        finer = checkpoint(finer)
        found = finer.where("linked").select("a", "b").distinct()
        links = links.unionByName(found)
        # A pair of boxes is settled by its first linked parts.
        open_pairs = finer.where(~F.col("linked")).drop("linked").join(found, ["a", "b"], "left_anti")
    if cut == _MAX_CUTS:
        links = links.unionByName(_linked_points(boxed, open_pairs, metres, cut))
    return boxed, links


def _linked_points(boxed: DataFrame, open_pairs: DataFrame, metres: float, cut: int) -> DataFrame:
    """Pairs settled point by point: the finest parts hold neighbouring doubles only."""
    sides = {}
    for side in ("a", "b"):
        sides[side] = boxed.select(
            _part_name(metres, cut).alias(f"part_{side}"), F.struct("lng", "lat").alias(f"point_{side}")
        )
    near = open_pairs.join(sides["a"], "part_a").join(sides["b"], "part_b")
    return near.where(haversine_m("point_a", "point_b") <= metres).select("a", "b").distinct()


def _part_name(metres: float, cut: int) -> Column:
    """Name of the ``cut`` times refined box of a point; cut 0 is the box itself."""
    if cut == 0:
        return F.col("box")
    step = metres / math.sqrt(2) * 0.999 / _METRES_PER_DEGREE
    pieces = float(_CUT**cut)
    v = F.floor(((F.col("lat") + 90) / step - F.col("y")) * pieces).cast("long")
    u = F.floor(((F.col("lng") + 180) / _width(F.col("y"), step) - F.col("x")) * pieces).cast("long")
    return F.concat_ws(":", "box", v, u)


def _parts(boxed: DataFrame, metres: float, cut: int) -> DataFrame:
    """(parent, part, bounds) of every refined box, under the box it was cut from."""
    named = boxed.withColumns({"parent": _part_name(metres, cut - 1), "part": _part_name(metres, cut)})
    return named.groupBy("parent", "part").agg(*_bounds())


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): least node reachable over undirected links (a, b). Nodes without link are not listed.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): the number of rounds grows with the logarithm of
    the component size, not with its diameter. Each round is a map-side combined minimum and an equi-join.
    """
    edges = checkpoint(_oriented(links.select("a", "b")))
    while True:
        large = _large_star(edges)
        small = checkpoint(_small_star(large))
        changed = _signature(edges) != _signature(small)
        edges = small
        if not changed:
            break
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return members.unionByName(roots).distinct()


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges from the greater node to the lesser."""
    return (
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every greater neighbour of a node to the least node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    # Only nodes that are not the least of their star move anything: a hub that is keeps its edges without a join.
    moving = least.where(F.col("m") < F.col("a"))
    joined = both.where(F.col("b") > F.col("a")).join(moving, "a", "left")
    stars = joined.select(F.col("b").alias("a"), F.coalesce("m", "a").alias("b"))
    own = moving.select("a", F.col("m").alias("b"))
    return stars.unionByName(own).where(F.col("a") != F.col("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link the lesser neighbours of a node, and the node, to the least of them."""
    oriented = _oriented(edges)
    least = oriented.groupBy("a").agg(F.min("b").alias("m"))
    moved = oriented.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return moved.unionByName(own).where(F.col("a") != F.col("b")).distinct()


def _signature(edges: DataFrame) -> tuple:
    """Order-free fingerprint of an edge set."""
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))
    ).first()
    return tuple(row)


def cluster_locations(locations: DataFrame, metres: float = 10.0) -> DataFrame:
    """Locations with ``cluster``, the same for all of a chain of points at most ``metres`` apart.

    Clusters do not depend on the order of rows. Locations without a point are left out.
    """
    placed = locations.where(F.col("point").isNotNull())
    points = placed.select(F.col("point.lat").alias("lat"), F.col("point.lng").alias("lng"))
    boxed, links = _linked_boxes(points, metres)
    components = connected_components(links)
    named = boxed.join(components, F.col("box") == F.col("node"), "left").select(
        "lat", "lng", F.coalesce("component", "box").alias("cluster")
    )
    keyed = placed.withColumns({"lat": F.col("point.lat"), "lng": F.col("point.lng")})
    return keyed.join(named, ["lat", "lng"]).drop("lat", "lng")


def location_cluster_report(locations: DataFrame, offenses: DataFrame, metres: float = 10.0) -> DataFrame:
    """One row per location of every cluster with at least two left.

    The principal has most offenses (ties: least db_id, location). Locations that already have a canonical name and lie
    exactly on the principal are dropped before it is chosen again among the rest. Rows carry the distance to it and the
    cluster's total, largest clusters first. Principals and totals are aggregates, so a huge cluster is never gathered.
    """
    clustered = cluster_locations(locations, metres).select(
        "db_id", "location", "canonical_location", "point", "cluster"
    )
    counted = clustered.join(offense_counts(offenses), ["db_id", "location"], "left").withColumn(
        "offense_count", F.coalesce("offense_count", F.lit(0).cast("long"))
    )
    counted = checkpoint(counted)

    def principal(rows: DataFrame) -> DataFrame:
        order = F.struct((-F.col("offense_count")).alias("n"), "db_id", "location", "point")
        return rows.groupBy("cluster").agg(
            F.min(order).alias("_p"), F.count(F.lit(1)).alias("_size"), F.sum("offense_count").alias("total_offenses")
        )

    first = principal(counted).where(F.col("_size") > 1).select("cluster", F.col("_p.point").alias("_first"))
    named = F.coalesce("canonical_location", F.lit("")) != ""
    left = (
        counted.join(first, "cluster")
        .where(~(named & (F.col("point.lat") == F.col("_first.lat")) & (F.col("point.lng") == F.col("_first.lng"))))
        .drop("_first")
    )
    chosen = principal(left).where(F.col("_size") > 1)
    return (
        left.join(chosen, "cluster")
        .select(
            "cluster",
            F.col("_p.db_id").alias("cluster_db_id"),
            F.col("_p.location").alias("principal"),
            "total_offenses",
            "db_id",
            "location",
            "point",
            "offense_count",
            ((F.col("db_id") == F.col("_p.db_id")) & (F.col("location") == F.col("_p.location"))).alias("is_principal"),
            haversine_m("_p.point", "point").alias("distance_from_principal"),
        )
        .orderBy(F.col("total_offenses").desc(), "cluster", F.col("offense_count").desc(), "db_id", "location")
    )
