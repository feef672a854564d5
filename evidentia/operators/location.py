"""Location factors from parcels near a point: coverage, nearest, scores and labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions import geo

CENTRE = (103.85176, 1.28348)
SMOOTH_COVERAGE = 0.3
NOWHERE_KM = 99.0


def points(records: DataFrame) -> DataFrame:
    """Distinct places: factors are worked out once for each."""
    return records.where("lon IS NOT NULL AND lat IS NOT NULL").select(F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")).distinct()


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parcel, bucket, lon, lat, area_km2 from the supplier table."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return s.select(
        F.col("s_suppkey").alias("parcel"), F.expr("CASE s_nationkey % 5 WHEN 0 THEN 'business' WHEN 1 THEN 'commercial' WHEN 2 THEN 'residential' WHEN 3 THEN 'port_airport' ELSE 'park' END").alias("bucket"),
        F.expr("CAST(103600 + s_suppkey * 37 % 500 AS DOUBLE) / 1000").alias("lon"), F.expr("CAST(1200 + s_suppkey * 53 % 250 AS DOUBLE) / 1000").alias("lat"), (F.abs("s_acctbal") / 10000).alias("area_km2"),
    )


def _near(places: DataFrame, parcels_: DataFrame, km: float) -> DataFrame:
    """places joined to the parcels within km, by grid cells (see ``evidence.near_pairs``)."""
    p = parcels_.select(*[F.col(c).alias(f"p_{c}") for c in parcels_.columns]).withColumn("_pc", geo.cell(F.col("p_lon"), F.col("p_lat"), km))
    c = places.withColumn("_n", F.explode(geo.around(geo.cell(F.col("lon"), F.col("lat"), km))))
    on = (F.col("_n") == F.col("_pc")) & (geo.haversine_km(F.col("lon"), F.col("lat"), F.col("p_lon"), F.col("p_lat")) <= km)
    return c.join(p, on).drop("_n", "_pc")


def coverage(places: DataFrame, parcels_: DataFrame, km: float) -> DataFrame:
    """Parcels near a place, by bucket, and their area as a share of the circle's."""
    return _near(places, parcels_, km).groupBy("lon", "lat", F.col("p_bucket").alias("bucket")).agg(F.count("*").alias("parcels"), (F.sum("p_area_km2") / math.pi / (km * km)).alias("coverage"))


#: Sides of the cubes that cut the unit globe: each is cut into 64 at the next level, down to about 1.5 km.
LEVELS = 7


def _cube(lon: Column, lat: Column) -> Column:
    """Cube of the finest level that a place is in."""
    fine = 4 ** (LEVELS - 1)
    x, y, z = _unit(lon, lat)
    return F.struct(*[F.floor(c * fine).alias(a) for a, c in (("x", x), ("y", y), ("z", z))])


def _unit(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    return F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))


def nearest(places: DataFrame, parcels_: DataFrame) -> DataFrame:
    """Distance to the nearest parcel, 99 where there is none, for distinct places (lon, lat).

    Cubes that hold parcels are searched from coarse to fine: a place starts with
    the at most 27 coarsest ones and goes on, at each level, with the cubes inside those it
    has that may hold its nearest parcel, that is, whose least distance is no more
    than the smallest greatest distance. Both sides meet on the parent cube, and at
    last on the finest cube, so a place meets only the parcels around its nearest."""
    where = parcels_.where("lon IS NOT NULL AND lat IS NOT NULL").select(F.col("lon").alias("p_lon"), F.col("lat").alias("p_lat")).distinct().withColumn("fine", _cube(F.col("p_lon"), F.col("p_lat")))
    up = lambda cube, k: F.struct(*[F.floor(cube[a] / 4**k).alias(a) for a in "xyz"])
    open_ = places.select("lon", "lat").withColumn("cube", F.explode(F.transform(F.sequence(F.lit(0), F.lit(26)), lambda i: F.struct((F.floor(i / 9) - 1).alias("x"), (F.floor(i / 3) % 3 - 1).alias("y"), (i % 3 - 1).alias("z")))))
    x, y, z = _unit(F.col("lon"), F.col("lat"))
    for level in range(LEVELS):
        k, side = LEVELS - 1 - level, 1 / 4**level
        held = where.select(up(F.col("fine"), k).alias("inner")).distinct().withColumn("cube", up(F.col("inner"), 1) if level else F.col("inner"))
        centre = lambda a, s=side: (F.col("inner")[a] + 0.5) * s
        far = F.sqrt(F.pow(x - centre("x"), 2) + F.pow(y - centre("y"), 2) + F.pow(z - centre("z"), 2))
        half = side * math.sqrt(3) / 2 + 1e-9
        met = open_.join(held, "cube").select("lon", "lat", F.col("inner").alias("cube"), far.alias("far"))
        own = Window.partitionBy("lon", "lat")  # a place has a few dozen cubes at most
        open_ = met.withColumn("least", F.min("far").over(own)).where(F.col("far") <= F.col("least") + 2 * half).select("lon", "lat", "cube")
    km = F.min(geo.haversine_km(F.col("lon"), F.col("lat"), F.col("p_lon"), F.col("p_lat")))
    found = open_.join(where, F.col("cube") == F.col("fine")).groupBy("lon", "lat").agg(km.alias("km"))
    return places.select("lon", "lat").join(found, ["lon", "lat"], "left").withColumn("km", F.coalesce("km", F.lit(NOWHERE_KM)))


def office_scores(places: DataFrame, parcels_: DataFrame, lon0: float, lat0: float) -> DataFrame:
    """Score of a place against the subject for offices: distance to the centre and commercial land near by."""
    spark = places.sparkSession
    commercial = parcels_.where("bucket = 'commercial'")
    own = coverage(places, commercial, 1.0).select("lon", "lat", F.col("coverage").alias("v"))
    subject = spark.createDataFrame([(lon0, lat0)], "lon double, lat double")
    base = coverage(subject, commercial, 1.0).agg(F.coalesce(F.max("coverage"), F.lit(0.0)).alias("base"))  # one row
    joined = places.join(own, ["lon", "lat"], "left").withColumn("v", F.coalesce("v", F.lit(0.0))).crossJoin(F.broadcast(base))
    to_centre = lambda x, y: geo.haversine_km(x, y, F.lit(CENTRE[0]), F.lit(CENTRE[1]))
    near = geo.pair_score(to_centre(F.col("lon"), F.col("lat")), to_centre(F.lit(lon0), F.lit(lat0)), False, None)
    score = F.round((near + geo.pair_score(F.col("v"), F.col("base"), True, SMOOTH_COVERAGE)) / 2, 3)
    return joined.select("lon", "lat", score.alias("score"), geo.score_label(score).alias("label"))


def policy(provided: Column, comp_sector: Column, subject_sector: str, lon: Column, lat: Column, scored: Column) -> Column:
    """A label given in the input stays; otherwise blank for another sector, an unknown place or one outside the box."""
    given = F.initcap(F.trim(F.coalesce(provided, F.lit(""))))
    return (
        F.when(given.isin("Superior", "Comparable", "Inferior"), given)
        .when((F.lit(subject_sector) != "mixed") & (comp_sector != subject_sector), "")
        .when(lon.isNull() | lat.isNull(), "").when(~geo.in_box(lon, lat), "").otherwise(scored)
    )


def land_use_at(records: DataFrame, rings: DataFrame, cell: float = 0.05) -> DataFrame:
    """Land use of the first ring (by ord) that holds a record's point, else empty: boxes by grid cell, then ray casting, once for each place."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    r = rings.select("ord", F.col("land_use").alias("_use"), "ring", F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    r = r.withColumn("_rx", F.explode(span("x0", "x1"))).withColumn("_ry", F.explode(span("y0", "y1")))
    at = records.withColumn("_x", F.col("lon").cast("double")).withColumn("_y", F.col("lat").cast("double"))
    on = (F.floor(F.col("_x") / cell) == F.col("_rx")) & (F.floor(F.col("_y") / cell) == F.col("_ry")) & F.col("_x").between(F.col("x0"), F.col("x1")) & F.col("_y").between(F.col("y0"), F.col("y1"))
    places = at.select("_x", "_y").where("_x IS NOT NULL AND _y IS NOT NULL").distinct()
    hits = places.join(r, on).where(geo.in_ring(F.col("_x"), F.col("_y"), F.col("ring"))).groupBy("_x", "_y").agg(F.min_by("_use", "ord").alias("land_use"))
    return at.join(hits, ["_x", "_y"], "left").select(*records.columns, F.coalesce("land_use", F.lit("")).alias("land_use"))


def first_in_order(records: DataFrame, by: str) -> DataFrame:
    return records.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy("pos"))).where("_n = 1").drop("_n")
