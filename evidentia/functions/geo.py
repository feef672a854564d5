"""Distances, rings and sectors: ``Column -> Column``."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_LAT, KM_PER_LON = 110.574, 111.320


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def cell(lon: Column, lat: Column, km: float) -> Column:
    """The place's cube (x, y, z) of a grid through the globe. Places within km of each other are in the same or in adjoining cubes, at every latitude and across the 180th meridian."""
    size = max(km, 0.1) * 1.001 / EARTH_KM  # a chord is no longer than its arc
    x, y = F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon))
    return F.struct(F.floor(x / size).alias("x"), F.floor(y / size).alias("y"), F.floor(F.sin(F.radians(lat)) / size).alias("z"))


def around(own: Column) -> Column:
    """Array of a cube and its 26 neighbours."""
    return F.transform(F.sequence(F.lit(0), F.lit(26)), lambda i: F.struct((own["x"] + F.floor(i / 9) - 1).alias("x"), (own["y"] + F.floor(i / 3) % 3 - 1).alias("y"), (own["z"] + i % 3 - 1).alias("z")))


def ahead(own: Column) -> Column:
    """Array of a cube and the 13 of its neighbours that follow it in order: of two adjoining cubes one is ahead of the other."""
    return F.slice(around(own), 14, 14)


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """Mean of a ring's vertices (struct x, y)."""
    mean = lambda axis: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[axis]) / F.size(ring)
    return mean("x"), mean("y")


def ring_area_km2(ring: Column) -> Column:
    """Area of an exterior ring by the shoelace rule on a local scale."""
    n = F.size(ring)
    turn = F.aggregate(
        F.sequence(F.lit(0), n - 1),
        F.lit(0.0),
        lambda s, i: s + F.get(ring, i)["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * F.get(ring, i)["y"],
    )
    lat = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["y"]) / n
    return F.when(n < 3, 0.0).otherwise(F.abs(turn) / 2 * KM_PER_LAT * KM_PER_LON * F.cos(F.radians(lat)))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting; holes are not looked at."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + n - 1) % n)
        at = F.when((a["y"] > y) != (b["y"] > y), x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])
        return F.coalesce(at, F.lit(False))

    return F.size(F.filter(F.sequence(F.lit(0), n - 1), crosses)) % 2 == 1


def in_box(lon: Column, lat: Column) -> Column:
    """Inside the box in which locations are scored."""
    return F.coalesce(lon.between(103.55, 104.15) & lat.between(1.13, 1.50), F.lit(False))


def near_point(lon: Column, lat: Column, lon0: Column, lat0: Column, km: float = 1.5) -> Column:
    """Within km of a point, on a flat local scale."""
    dx = (lon - lon0) * KM_PER_LON * F.cos(F.radians(lat0))
    dy = (lat - lat0) * KM_PER_LAT
    return F.sqrt(dx * dx + dy * dy) <= km


def zoom_to_fit(lon_span: Column, lat_span: Column, width: int, height: int) -> Column:
    """Largest whole zoom at which a span fits a picture of tiles of 512 pixels."""
    by_x = F.log2(width * 360.0 / (F.greatest(lon_span, F.lit(1e-6)) * 512))
    by_y = F.log2(height * 180.0 / (F.greatest(lat_span, F.lit(1e-6)) * 512))
    return F.greatest(F.least(F.floor(F.least(by_x, by_y)), F.lit(18)), F.lit(0)).cast("int")


CIRCLE_KM2 = math.pi


def sector(asset_class: Column) -> Column:
    """Sector of an asset class: the first keyword wins, office by default."""
    a = F.lower(F.coalesce(asset_class, F.lit("")))
    return (
        F.when(a.rlike("logistic|industrial|warehouse"), "industrial").when(a.contains("data"), "data_centre").when(a.rlike("retail|mall|shop"), "retail")
        .when(a.rlike("hospitality|hotel"), "hospitality").when(a.contains("office"), "office").when(a.contains("mixed"), "mixed").otherwise("office")
    )


def pair_score(comp: Column, subject: Column, higher_better: bool, k: float | None) -> Column:
    """Score of one factor in -1..1, 0 where comp and subject agree."""
    if higher_better:
        return F.coalesce(F.try_divide(comp - subject, comp + subject + F.lit(10.0 if k is None else k)), F.lit(0.0))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (subject - comp) / 5.0))


def score_label(score: Column) -> Column:
    return F.when(score.isNull(), "").when(score > 0.3, "Superior").when(score < -0.3, "Inferior").otherwise("Comparable")
