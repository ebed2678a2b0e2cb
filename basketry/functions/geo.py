"""Distances on the earth, boxes, and places inside areas."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM, DEGREE_KM, SLACK = 6371.0, 111.0, 1.2
#: A store placed at its city's centre may stand this far off; one without a place ranks as if so far away.
CITY_KM, UNKNOWN_KM = 2.6, 50.0


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2)
    b = F.sin(F.radians(lng2 - lng1) / 2)
    h = a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b
    return F.asin(F.sqrt(F.least(F.lit(1.0), h))) * (2 * EARTH_KM)


def great_circle_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    inner = F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lng2) - F.radians(lng1)) + F.sin(F.radians(lat1)) * F.sin(F.radians(lat2))
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), inner))) * EARTH_KM


def in_box(lat: Column, lng: Column, origin: tuple[float, float], radius_km: float) -> Column:
    """A cheap test that no place within the radius fails; it can be pushed to the scan."""
    d_lat = radius_km * SLACK / DEGREE_KM
    d_lng = d_lat / max(0.2, math.cos(math.radians(origin[0])))
    return lat.between(origin[0] - d_lat, origin[0] + d_lat) & lng.between(origin[1] - d_lng, origin[1] + d_lng)


def valid_place(lat: Column, lng: Column) -> Column:
    """Both given, not zero, and inside the country."""
    return F.coalesce((lat != 0) & (lng != 0) & lat.between(29, 34) & lng.between(34, 36), F.lit(False))


def estimated_km(km: Column, accuracy: Column) -> Column:
    """The distance that can be defended, to ten metres."""
    off = F.when(accuracy == "city", F.sqrt(km * km + CITY_KM * CITY_KM)).otherwise(km)
    return F.floor(off * 100 + 0.5) / 100


def ranking_km(km: Column, accuracy: Column) -> Column:
    return F.when(km.isNull() | (accuracy == "unknown"), UNKNOWN_KM).otherwise(km)


def in_ring(lng: Column, lat: Column, ring: Column) -> Column:
    """Even-odd test of a point against a ring, an array of structs (lng, lat)."""
    size = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + size - 1) % size)
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        edge = (b["lng"] - a["lng"]) * (lat - a["lat"]) / F.when(b["lat"] != a["lat"], b["lat"] - a["lat"]) + a["lng"]
        return spans & F.coalesce(lng < edge, F.lit(False))

    count = F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), lambda n, i: n + F.when(crosses(i), 1).otherwise(0))
    return F.when(size > 2, count % 2 == 1).otherwise(False)


#: Degrees are told apart to 2 ** -48 of one, as doubles from 16 degrees on are; products of such whole numbers are exact as decimals.
DEGREE_PARTS = 2.0**48


def in_ring_exactly(lng: Column, lat: Column, ring: Column) -> Column:
    """Even-odd test without rounding of a point against a ring, an array of structs (lng, lat). Of a ring's line its eastern sides and level southern ones are inside."""
    size = F.size(ring)
    whole = lambda x: (x * DEGREE_PARTS).cast("long")
    times = lambda x, y: x.cast("decimal(19,0)") * y.cast("decimal(19,0)")
    x, y = whole(lng), whole(lat)
    corners = F.transform(ring, lambda p: F.struct(whole(p["lng"]).alias("x"), whole(p["lat"]).alias("y")))
    sides = F.transform(corners, lambda a, i: F.struct(a.alias("a"), F.get(corners, (i + size - 1) % size).alias("b")))

    def above(s: Column) -> Column:
        """Whether a side is met by the point's ray north, just west of the point."""
        a, b = s["a"], s["b"]
        east = F.when(b["x"] > a["x"], 1).otherwise(-1)
        turn = F.signum(times(b["x"] - a["x"], y - a["y"]) - times(x - a["x"], b["y"] - a["y"])) * east
        return ((a["x"] >= x) != (b["x"] >= x)) & ((turn < 0) | ((turn == 0) & ((b["y"] - a["y"]) * east < 0)))

    return F.when(size > 2, F.size(F.filter(sides, above)) % 2 == 1).otherwise(False)


#: An area is laid out on cells of the size 2 ** -level degrees at which its box is up to so many of them wide.
CELLS_WIDE = 16


def level_of(width: Column) -> Column:
    """The finest level at which a width in degrees is at most CELLS_WIDE cells."""
    return F.least(F.lit(20), F.greatest(F.lit(-4), F.floor(F.log2(F.lit(float(CELLS_WIDE)) / F.greatest(width, F.lit(1e-9)))))).cast("int")


def cell_of(x: Column, level: Column) -> Column:
    return F.floor(x * F.pow(F.lit(2.0), level)).cast("long")


def box_cells(level: Column, west: Column, east: Column, south: Column, north: Column) -> Column:
    """Array of (x, y) of the cells of a box, edges included."""
    xs, ys = F.sequence(cell_of(west, level), cell_of(east, level)), F.sequence(cell_of(south, level), cell_of(north, level))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def ring_cells(ring: Column, level: Column) -> Column:
    """Array of (x, y, whole) of the cells that a ring, an array of structs (lng, lat), reaches; `whole` cells lie inside it altogether.

    A cell that the box of no side touches lies on one side of the ring, so its middle tells which; all others need the exact test.
    """
    size = F.size(ring)
    low = lambda k: F.array_min(F.transform(ring, lambda p: p[k]))
    high = lambda k: F.array_max(F.transform(ring, lambda p: p[k]))
    step = F.pow(F.lit(2.0), -level)
    sides = F.transform(ring, lambda a, i: F.struct(a.alias("a"), F.get(ring, (i + 1) % size).alias("b")))

    def touched(c: Column) -> Column:
        west, south = c["x"] * step, c["y"] * step
        return F.exists(
            sides,
            lambda s: (F.least(s["a"]["lng"], s["b"]["lng"]) <= west + step) & (F.greatest(s["a"]["lng"], s["b"]["lng"]) >= west) & (F.least(s["a"]["lat"], s["b"]["lat"]) <= south + step) & (F.greatest(s["a"]["lat"], s["b"]["lat"]) >= south),
        )

    def judged(c: Column) -> Column:
        return F.struct(c["x"].alias("x"), c["y"].alias("y"), touched(c).alias("touched"), in_ring((c["x"] + 0.5) * step, (c["y"] + 0.5) * step, ring).alias("inside"))

    cells = F.transform(box_cells(level, low("lng"), high("lng"), low("lat"), high("lat")), judged)
    return F.transform(F.filter(cells, lambda c: c["touched"] | c["inside"]), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), (~c["touched"]).alias("whole")))


def haversine_sql(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    a, b = f"sin(radians({lat2} - {lat1}) / 2)", f"sin(radians({lng2} - {lng1}) / 2)"
    return f"asin(sqrt(least(1e0, {a} * {a} + cos(radians({lat1})) * cos(radians({lat2})) * {b} * {b}))) * 12742e0"
