"""Land-use parcels from GeoJSON features: buckets with centroid and area, and an index of rings with boxes.

A feature is a row (feature, geojson). Polygons and multi-polygons are read
into one shape, a list of polygons, each a list of rings whose first is the
exterior; holes are read and not looked at. Text that can't be read, other
geometries and empty ones give no parcel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.geo import KM_PER_LAT, KM_PER_LON

#: Land-use descriptions of each bucket; one description may be in several. Fixed values.
BUCKETS = {
    "residential": ("RESIDENTIAL", "RESIDENTIAL WITH COMMERCIAL AT 1ST STOREY", "RESIDENTIAL / INSTITUTION", "COMMERCIAL & RESIDENTIAL"),
    "commercial": ("COMMERCIAL", "COMMERCIAL & RESIDENTIAL", "COMMERCIAL / INSTITUTION", "RESIDENTIAL WITH COMMERCIAL AT 1ST STOREY"),
    "business": ("BUSINESS 1", "BUSINESS 2", "BUSINESS PARK", "BUSINESS 1 - WHITE", "BUSINESS 2 - WHITE", "BUSINESS PARK - WHITE"),
    "hotel": ("HOTEL",),
    "port_airport": ("PORT / AIRPORT",),
}
#: Ports and airports count inside these bounds only (west, east, south, north). Fixed values.
PORT_BOUNDS = (103.60, 104.05, 1.15, 1.48)
_POLYGON, _MULTI = "array<array<array<double>>>", "array<array<array<array<double>>>>"


def polygons(geojson: Column) -> Column:
    """array of polygons (array of rings, array of struct x, y); null where there is no such geometry."""
    kind, text = F.get_json_object(geojson, "$.geometry.type"), F.get_json_object(geojson, "$.geometry.coordinates")
    found = F.when(kind == "Polygon", F.array(F.from_json(text, _POLYGON))).when(kind == "MultiPolygon", F.from_json(text, _MULTI))
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    return F.transform(found, lambda rings: F.transform(rings, lambda ring: F.transform(ring, point)))


def exteriors(shape: Column) -> Column:
    return F.transform(shape, lambda rings: F.get(rings, F.lit(0)))


def _turn(ring: Column) -> Column:
    """Twice the signed area of a ring in square degrees; the last vertex is joined to the first."""
    n = F.size(ring)
    cross = lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + cross(F.get(ring, i), F.get(ring, (i + 1) % n)))


def shapes(features: DataFrame) -> DataFrame:
    """feature, description, rings (exteriors), lon, lat (vertex mean of the first ring) and area_km2 of all
    rings of three vertices and more, on a flat scale at that latitude."""
    read = features.select("feature", F.trim(F.coalesce(F.get_json_object("geojson", "$.properties.LU_DESC"), F.lit(""))).alias("description"), exteriors(polygons(F.col("geojson"))).alias("rings"))
    first = F.get("rings", F.lit(0))
    mean = lambda axis: F.aggregate(first, F.lit(0.0), lambda s, p: s + p[axis]) / F.size(first)
    placed = read.where(F.size(first) > 0).withColumn("lon", mean("x")).withColumn("lat", mean("y"))
    area = F.aggregate(F.filter("rings", lambda r: F.size(r) >= 3), F.lit(0.0), lambda s, r: s + F.abs(_turn(r)) / 2)
    return placed.withColumn("area_km2", area * KM_PER_LAT * KM_PER_LON * F.cos(F.radians("lat")))


def bucket_parcels(features: DataFrame) -> DataFrame:
    """parcel, bucket, lon, lat, area_km2: a row for each bucket that a feature's description is in."""
    upper = F.upper("description")
    buckets = F.array_compact(F.array(*[F.when(upper.isin(*names), F.lit(b)) for b, names in BUCKETS.items()]))
    west, east, south, north = PORT_BOUNDS
    inside = F.col("lon").between(west, east) & F.col("lat").between(south, north)
    rows = shapes(features).select(F.col("feature").alias("parcel"), F.explode(buckets).alias("bucket"), "lon", "lat", "area_km2")
    return rows.where((F.col("bucket") != "port_airport") | inside)


def ring_index(features: DataFrame) -> DataFrame:
    """ord, feature, part, land_use, x0, x1, y0, y1, ring: a row per exterior ring of a described
    feature, with its box; ``ord`` gives the order of features and their parts (for ``location.land_use_at``)."""
    rows = shapes(features).where("description <> ''").select("feature", F.col("description").alias("land_use"), F.posexplode("rings").alias("part", "ring")).where(F.size("ring") >= 3)
    axis = lambda a: F.transform("ring", lambda p: p[a])
    boxed = rows.select("*", F.array_min(axis("x")).alias("x0"), F.array_max(axis("x")).alias("x1"), F.array_min(axis("y")).alias("y0"), F.array_max(axis("y")).alias("y1"))
    return boxed.select(F.struct("feature", "part").alias("ord"), "feature", "part", "land_use", "x0", "x1", "y0", "y1", "ring")
