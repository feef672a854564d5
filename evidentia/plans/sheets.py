"""Queries of workbooks with formulas, parcels from GeoJSON and layered search rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions.lease import FACTOR_SQL, factor_sql
from evidentia.operators import overlay, parcels, sheets
from evidentia.plans.register import query
from evidentia.sources.surrogate import COMPS_SQL, LAND_SQL, land_sales, sale_comps


def _deals(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("deal"))


def _params(records, years):
    """A deal's subject is its first record."""
    return records.groupBy("deal").agg(F.min_by(F.coalesce(years, F.lit(-1.0)), "pos").alias("y")).select("deal", F.when(F.col("y") >= 0, F.col("y")).alias("lease_yrs"))


def _workbook_sql(ctes: str, table: str, fields: str, years: str, layout: sheets.Layout, adjusted: tuple[str, str], formula: str) -> str:
    """The cells, sheet by sheet: values from the rule itself, formulas spelled by place."""
    key, value = adjusted
    body = []
    for i, (_, k, kind) in enumerate(layout.columns, 1):
        shown, number = (f"CASE WHEN {k} IS NULL THEN '—' END", f"{k}::DOUBLE") if kind == "number" else (f"coalesce(nullif({k}, ''), '—')", "NULL::DOUBLE")
        body.append(f"SELECT deal, '{layout.name}' AS sheet, CAST(marker AS INTEGER) + 1 AS row, {i} AS col, {shown} AS shown, {number} AS number, {formula if k == key else 'NULL'} AS formula FROM v")
    foot = []
    for i, (h, k, _) in enumerate(layout.columns, 1):
        foot.append(f"SELECT DISTINCT deal, '{layout.name}', 1, {i}, '{h}', NULL::DOUBLE, NULL FROM v")
        if k in layout.averaged:
            c = chr(64 + i)
            foot.append(f"SELECT deal, '{layout.name}', CAST(max(marker) AS INTEGER) + 2, {i}, CASE WHEN count(*) FILTER ({k} > 0) = 0 THEN '—' END, avg({k}) FILTER ({k} > 0), '=IFERROR(AVERAGEIF({c}2:{c}' || CAST(max(marker) + 1 AS INTEGER) || ',\">0\"),\"—\")' FROM v GROUP BY deal")
    foot.append(f"SELECT deal, '{layout.name}', CAST(max(marker) AS INTEGER) + 2, 2, 'Average', NULL, NULL FROM v GROUP BY deal")
    notes = [f"SELECT deal, 'Params', {4 + i}, 1, '{x.replace(chr(39), chr(39) * 2)}', NULL::DOUBLE, NULL FROM p" for i, x in enumerate(sheets.PARAM_NOTES)]
    return f"""WITH {ctes}, {FACTOR_SQL}, r AS (SELECT o_custkey AS deal, {fields} FROM {table} JOIN orders ON o_orderkey = pos),
p AS (SELECT deal, first(CAST({years} AS DOUBLE) ORDER BY pos) AS lease_yrs FROM r GROUP BY deal),
m AS (SELECT r.*, lease_yrs AS subject_yrs, row_number() OVER (PARTITION BY deal ORDER BY pos) AS marker FROM r JOIN p USING (deal)),
v AS (SELECT *, {value} AS {key} FROM m)
{" UNION ALL ".join([*body, *foot])}
UNION ALL SELECT deal, 'Params', 1, 1, 'Parameter', NULL, NULL FROM p UNION ALL SELECT deal, 'Params', 1, 2, 'Value', NULL, NULL FROM p
UNION ALL SELECT deal, 'Params', 2, 1, 'Subject Remaining Leasehold (yrs)', NULL, NULL FROM p UNION ALL SELECT deal, 'Params', 2, 2, CASE WHEN lease_yrs IS NULL THEN '—' END, lease_yrs, NULL FROM p
UNION ALL {" UNION ALL ".join(notes)}
UNION ALL SELECT deal, 'Lease Table', 1, 1, 'Years', NULL, NULL FROM p UNION ALL SELECT deal, 'Lease Table', 1, 2, 'Factor (decimal)', NULL, NULL FROM p
UNION ALL SELECT deal, 'Lease Table', years + 1, 1, NULL, years::DOUBLE, NULL FROM p, factors UNION ALL SELECT deal, 'Lease Table', years + 1, 2, NULL, round(factor, 5), NULL FROM p, factors
UNION ALL SELECT deal, 'Lease Table', 102, 1, '{sheets.LEASE_NOTE}', NULL, NULL FROM p"""


def _spelled(template: str) -> str:
    """A formula with # for this row's number, as a SQL text."""
    return "'" + template.replace("'", "''").replace("#", "' || CAST(marker + 1 AS INTEGER) || '") + "'"


_FACTOR_TEXT = "IF(ISNUMBER(@),IF(OR(@<=0,@>=999),1,IF(@>99,0.96+(@-99)*0.04/900,VLOOKUP(ROUND(@,0),'Lease Table'!$A$2:$B$100,2,FALSE))),1)"
_SALES_TEXT = f'=IFERROR(H#*{_FACTOR_TEXT.replace("@", "E#")}/{_FACTOR_TEXT.replace("@", "Params!$B$2")},"—")'
_LAND_TEXT = f'=IFERROR(G#*{_FACTOR_TEXT.replace("@", "Params!$B$2")}/{_FACTOR_TEXT.replace("@", "D#")},"—")'


@query(
    "q_row5_row6_formulas",
    _workbook_sql(
        COMPS_SQL, "comps", "pos, property_name, sale_date, gfa_sf, remaining_yrs, price_m, price_m * 1000000 / gfa_sf AS price_psf, npi_yield, reported_adj", "remaining_yrs", sheets.SALES,
        ("adj_yield", f"coalesce(reported_adj, npi_yield * {factor_sql('remaining_yrs')} / {factor_sql('subject_yrs')})"), f"CASE WHEN reported_adj IS NULL THEN {_spelled(_SALES_TEXT)} END",
    ),
)
def sales_workbook(spark, sf):
    records = sale_comps(spark, sf).join(_deals(spark, sf), "pos").withColumn("price_psf", F.try_divide(F.col("price_m") * 1_000_000, F.col("gfa_sf")))
    return sheets.workbook(records, _params(records, F.col("remaining_yrs")), sheets.SALES)


@query(
    "q_row6_sch3_land_workbook",
    _workbook_sql(
        LAND_SQL, "land", "pos, site_name, launch_date, tenure_yrs, max_gfa_sf, price_m, price_m * 1000000 / max_gfa_sf AS psf_ppr", "tenure_yrs", sheets.LAND,
        ("adj_psf_ppr", f"psf_ppr * {factor_sql('subject_yrs')} / {factor_sql('tenure_yrs')}"), _spelled(_LAND_TEXT),
    ),
)
def land_workbook(spark, sf):
    records = land_sales(spark, sf).join(_deals(spark, sf), "pos").withColumn("psf_ppr", F.try_divide(F.col("price_m") * 1_000_000, F.col("max_gfa_sf")))
    return sheets.workbook(records, _params(records, F.col("tenure_yrs")), sheets.LAND)


#: Vertices (part, ring, n, dx, dy) of four shapes: a closed square, a square with a hole, two triangles, a line of two points.
SHAPES = {
    0: [(0, 0, i, *v) for i, v in enumerate([(0, 0), (4, 0), (4, 3), (0, 3), (0, 0)])],
    1: [(0, 0, i, *v) for i, v in enumerate([(0, 0), (6, 0), (6, 5), (0, 5)])] + [(0, 1, i, *v) for i, v in enumerate([(1, 1), (2, 1), (2, 2)])],
    2: [(0, 0, i, *v) for i, v in enumerate([(0, 0), (3, 0), (0, 4)])] + [(1, 0, i, *v) for i, v in enumerate([(5, 5), (5, 9), (8, 5)])],
    3: [(0, 0, i, *v) for i, v in enumerate([(0, 0), (2, 2)])],
}
_USES = ("Residential", " commercial & residential ", "COMMERCIAL", "Business 1", "Business Park - White", "Hotel", "PORT / AIRPORT", "Park", "", "Residential with commercial at 1st storey")
_X, _Y, _W = "103500 + s_suppkey * 37 % 700", "1100 + s_suppkey * 53 % 450", "(1 + s_suppkey % 9)"


def features(spark, sf):
    """GeoJSON features made of suppliers: four shapes, some with null or foreign geometry, ten land uses."""
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    at = lambda base, d: F.expr(f"CAST({base} + {d} * {_W} AS DOUBLE) / 1000")
    coords = {}
    for k, vertices in SHAPES.items():
        parts = sorted({(p, r) for p, r, *_ in vertices})
        ring = lambda p, r, vs=vertices: F.array(*[F.array(at(_X, dx), at(_Y, dy)) for a, b, _, dx, dy in vs if (a, b) == (p, r)])
        shape = [F.array(*[ring(p, r) for p, r in parts if p == q]) for q in sorted({p for p, _ in parts})]
        coords[k] = F.to_json(F.array(*shape) if k == 2 else shape[0])
    kind = F.col("s_suppkey") % 4
    text = F.when(kind == 0, coords[0]).when(kind == 1, coords[1]).when(kind == 2, coords[2]).otherwise(coords[3])
    uses = F.array(*map(F.lit, _USES))
    geometry = F.concat(F.lit('{"type":"'), F.when(kind == 2, "MultiPolygon").otherwise("Polygon"), F.lit('","coordinates":'), text, F.lit("}"))
    geometry = F.when(F.col("s_suppkey") % 11 == 0, '{"type":"Point","coordinates":[103.8,1.3]}').when(F.col("s_suppkey") % 13 == 0, "null").otherwise(geometry)
    use = F.get(uses, (F.floor(F.col("s_suppkey") / 4) % len(_USES)).cast("int"))
    json = F.concat(F.lit('{"type":"Feature","properties":{"LU_DESC":"'), use, F.lit('"},"geometry":'), geometry, F.lit("}"))
    return s.select(F.col("s_suppkey").alias("feature"), F.when(F.col("s_suppkey") % 17 == 0, '{"type":').otherwise(json).alias("geojson"))


_VERTICES_SQL = f"""k AS (SELECT s_suppkey AS feature, s_suppkey % 4 AS kind, trim([{", ".join(f"'{u}'" for u in _USES)}][1 + CAST(s_suppkey // 4 % {len(_USES)} AS INTEGER)]) AS use, {_X} AS x, {_Y} AS y, {_W} AS w
  FROM supplier WHERE s_suppkey % 11 <> 0 AND s_suppkey % 13 <> 0 AND s_suppkey % 17 <> 0),
shape AS (SELECT * FROM (VALUES {", ".join(str((k, *v)) for k, vs in SHAPES.items() for v in vs if v[1] == 0)}) s(kind, part, ring, n, dx, dy)),
v AS (SELECT feature, use, part, n, (x + dx * w)::DOUBLE / 1000 AS vx, (y + dy * w)::DOUBLE / 1000 AS vy FROM k JOIN shape USING (kind)),
e AS (SELECT *, coalesce(lead(vx) OVER o, first(vx) OVER o) AS nx, coalesce(lead(vy) OVER o, first(vy) OVER o) AS ny, count(*) OVER (PARTITION BY feature, part) AS size FROM v WINDOW o AS (PARTITION BY feature, part ORDER BY n)),
rings AS (SELECT feature, use, part, avg(vx) AS cx, avg(vy) AS cy, CASE WHEN max(size) >= 3 THEN abs(sum(vx * ny - nx * vy)) / 2 ELSE 0 END AS deg2, min(vx) AS x0, max(vx) AS x1, min(vy) AS y0, max(vy) AS y1, max(size) AS size FROM e GROUP BY ALL)"""


@query(
    "q_src28_landuse_build",
    f"""WITH {_VERTICES_SQL}, f AS (SELECT feature, use, max(cx) FILTER (part = 0) AS lon, max(cy) FILTER (part = 0) AS lat, sum(deg2) AS deg2 FROM rings GROUP BY ALL),
b AS (SELECT * FROM (VALUES {", ".join(f"('{b}', '{u}')" for b, us in parcels.BUCKETS.items() for u in us)}) b(bucket, name))
SELECT feature AS parcel, bucket, round(lon, 9) AS lon, round(lat, 9) AS lat, round(deg2 * 110.574 * 111.32 * cos(radians(lat)), 6) AS area_km2 FROM f JOIN b ON upper(use) = name
WHERE bucket <> 'port_airport' OR (lon BETWEEN 103.6 AND 104.05 AND lat BETWEEN 1.15 AND 1.48)""",
)
def landuse_build(spark, sf):
    return parcels.bucket_parcels(features(spark, sf)).select("parcel", "bucket", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), F.round("area_km2", 6).alias("area_km2"))


@query("q_spa9_land_use_index", f"WITH {_VERTICES_SQL} SELECT feature, CAST(part AS INTEGER) AS part, use AS land_use, x0, x1, y0, y1, CAST(size AS INTEGER) AS vertices FROM rings WHERE size >= 3 AND use <> ''")
def land_use_index(spark, sf):
    return parcels.ring_index(features(spark, sf)).select("feature", "part", "land_use", "x0", "x1", "y0", "y1", F.size("ring").alias("vertices"))


@query(
    "q_spa9_land_use_at_comps",
    f"""WITH {COMPS_SQL}, {_VERTICES_SQL}, pts AS (SELECT pos, lon::DOUBLE + 0.0005 AS px, lat::DOUBLE + 0.0005 AS py FROM comps WHERE lon IS NOT NULL),
near AS (SELECT pos, feature, part, px, py FROM pts JOIN rings ON size >= 3 AND use <> '' AND px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1),
hit AS (SELECT pos, feature, part FROM near JOIN e USING (feature, part) WHERE (vy > py) <> (ny > py) AND px < (nx - vx) * (py - vy) / (ny - vy) + vx GROUP BY pos, feature, part HAVING count(*) % 2 = 1),
first_hit AS (SELECT pos, first(feature ORDER BY feature, part) AS feature FROM hit GROUP BY pos)
SELECT pos, coalesce(use, '') AS land_use FROM pts LEFT JOIN first_hit USING (pos) LEFT JOIN k USING (feature)""",
)
def land_use_at_comps(spark, sf):
    from evidentia.operators import location

    points = sale_comps(spark, sf).where("lon IS NOT NULL").select("pos", (F.col("lon").cast("double") + 0.0005).alias("lon"), (F.col("lat").cast("double") + 0.0005).alias("lat"))
    return location.land_use_at(points, parcels.ring_index(features(spark, sf)), cell=0.02).select("pos", "land_use")


_DEALS = ("CASE o_orderstatus WHEN 'F' THEN 'sales' WHEN 'O' THEN 'rent' ELSE 'land' END AS comp_type", "CASE o_custkey % 5 WHEN 0 THEN ' Logistics' WHEN 1 THEN 'industrial' WHEN 2 THEN 'Office' WHEN 3 THEN NULL ELSE 'Hotel' END AS asset_class")


@query(
    "q_cal19_rules",
    f"""WITH d AS (SELECT o_orderkey AS deal, {', '.join(_DEALS)}, CASE WHEN o_orderkey % 4 IN (1, 2) THEN 5 + o_orderkey % 10 END AS own_results, CASE WHEN o_orderkey % 4 = 2 THEN 2 + o_orderkey % 6 END AS own_back, CASE WHEN o_orderkey % 4 = 2 AND o_orderkey % 3 = 0 THEN 1.5 END AS own_near FROM orders),
r AS (SELECT comp_type, months FROM (VALUES ('sales', 60), ('rent', 36), ('land', 60)) r(comp_type, months)), c AS (SELECT * FROM (VALUES ('logistics', 5.0, 50.0), ('industrial', 5.0, 50.0)) c(class, near, city)),
x AS (SELECT deal, coalesce(own_results, 15)::DOUBLE AS max_results, coalesce(own_near, near, 3.0)::DOUBLE AS proximity_km, coalesce(city, 25.0)::DOUBLE AS city_km, months::DOUBLE AS recency_months, coalesce(own_back, 5)::DOUBLE AS years_back_max,
  CASE WHEN own_near IS NOT NULL THEN 'deal' WHEN near IS NOT NULL THEN 'asset class' ELSE 'house' END AS proximity_by, 3.0::DOUBLE AS max_level, CASE WHEN own_back IS NOT NULL THEN 1.0 END::DOUBLE AS own_rule FROM d JOIN r USING (comp_type) LEFT JOIN c ON class = lower(trim(asset_class)))
SELECT *, CASE WHEN years_back_max * 12 > recency_months THEN 'years_back_max ' || CAST(years_back_max AS INTEGER) || ' reaches past the ' || CAST(recency_months / 12 AS INTEGER) || ' years that are kept' END AS warning FROM x""",
)
def rules(spark, sf):
    block = """CASE o_orderkey % 4 WHEN 1 THEN map('max_results', CAST(5 + o_orderkey % 10 AS DOUBLE))
      WHEN 2 THEN map_concat(map('max_results', CAST(5 + o_orderkey % 10 AS DOUBLE), 'years_back_max', CAST(2 + o_orderkey % 6 AS DOUBLE), 'own_rule', 1.0D), CASE WHEN o_orderkey % 3 = 0 THEN map('proximity_km', 1.5D) ELSE CAST(map() AS MAP<STRING, DOUBLE>) END)
      WHEN 3 THEN CAST(map() AS MAP<STRING, DOUBLE>) END AS block"""
    deals = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey AS deal", *_DEALS, block)
    out = overlay.effective_rules(deals)
    pick = [F.element_at("rules", k).alias(k) for k in ("max_results", "proximity_km", "city_km", "recency_months", "years_back_max", "max_level", "own_rule")]
    return out.select("deal", *pick, F.element_at("set_by", "proximity_km").alias("proximity_by"), "warning")
