"""Spherical geometry on columns (degrees in, metres out)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0  # fixed value


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    # Rounding may push h of antipodal points just above 1; ``least`` would turn null into 1.
    h = F.when(h > 1, F.lit(1.0)).otherwise(h)
    return F.atan2(F.sqrt(h), F.sqrt(1 - h)) * (2 * EARTH_RADIUS_M)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in [0, 360); coincident points give 0."""
    p1, p2, turn = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    east = F.sin(turn) * F.cos(p2)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(turn)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360, F.lit(360.0))


def cross_track(start: tuple[Column, Column], end: tuple[Column, Column],
                point: tuple[Column, Column]) -> Column:
    """Signed distance in metres of a point from the great circle start -> end."""
    arc = haversine(*start, *point) / EARTH_RADIUS_M
    angle = F.radians(bearing(*start, *end)) - F.radians(bearing(*start, *point))
    return F.asin(F.sin(arc) * F.sin(angle)) * EARTH_RADIUS_M


def path_length(points: Column) -> Column:
    """Metres along an array of (lat, lon) structs."""
    steps = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(points) - 1, F.lit(1))),
        lambda i: F.when(
            F.size(points) < 2, F.lit(0.0)
        ).otherwise(
            haversine(
                F.get(points, i - 1)["lat"], F.get(points, i - 1)["lon"],
                F.get(points, i)["lat"], F.get(points, i)["lon"],
            )
        ),
    )
    return F.aggregate(steps, F.lit(0.0), lambda total, step: total + step)


def flip(points: Column) -> Column:
    """(lat, lon) structs to [lon, lat] pairs, the order map layers take."""
    return F.transform(points, lambda p: F.array(p["lon"], p["lat"]))


# The thirty cluster colours as red, green, blue.
CLUSTER_COLORS = (
    (31, 119, 180), (255, 127, 14), (44, 160, 44), (214, 39, 40), (148, 103, 189),
    (140, 86, 75), (227, 119, 194), (127, 127, 127), (188, 189, 34), (23, 190, 207),
    (230, 25, 75), (60, 180, 75), (245, 130, 49), (145, 30, 180), (70, 240, 240),
    (240, 50, 230), (188, 246, 12), (250, 190, 190), (0, 128, 128), (230, 190, 255),
    (154, 99, 36), (255, 250, 200), (128, 0, 0), (170, 255, 195), (128, 128, 0),
    (255, 216, 177), (0, 0, 128), (169, 169, 169), (255, 255, 255), (0, 0, 0),
)
NOISE_COLOR = (255, 255, 255)  # fixed value


def color(label: Column) -> Column:
    """Colour of a cluster label: labels wrap around the palette, noise is white."""
    palette = F.array(*[F.array(*[F.lit(c) for c in rgb]) for rgb in CLUSTER_COLORS])
    return F.when(label == -1, F.array(*[F.lit(c) for c in NOISE_COLOR])).otherwise(
        F.get(palette, F.pmod(label, F.lit(len(CLUSTER_COLORS))).cast("int"))
    )


def metres_to_lat_degrees(metres: float) -> float:
    return math.degrees(metres / EARTH_RADIUS_M)
