"""Queries of rule classes, column tiers, places, configurations, caches and read-back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.operators import rules
from evidentia.plans.evidence import km_sql
from evidentia.plans.grids import GRID_SQL, grid
from evidentia.plans.register import query
from evidentia.plans.retrieval import _FILES, _count_sql, _files
from evidentia.operators import retrieval as rt
from evidentia.sources.surrogate import COMPS_SQL, LAND_SQL, land_sales, sale_comps


def _docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# Classes

_ZONES = "CASE land_zoning WHEN 'Hotel' THEN 'Hospitality' ELSE land_zoning END"


@query(
    "q_cal14_row13_sale_class",
    f"""WITH {COMPS_SQL}, r AS (SELECT pos, trim(regexp_replace(sale_type, '\\s*\\(.*\\)', '')) AS base, {_ZONES} AS z, relevance_score FROM comps)
SELECT pos, CASE WHEN pos % 5 = 0 THEN 'Fund interest' WHEN base = '' THEN '' ELSE base || CASE WHEN contains(z, 'Residential') THEN ' (Mixed Use (Office + Retail))' WHEN contains(z, 'Hospitality') THEN ' (Mixed Use (Office + Hotel))' ELSE ' (Office)' END END AS asset_type,
  CASE WHEN pos % 5 = 0 THEN relevance_score ELSE 5 END AS relevance_score, CASE WHEN pos % 5 = 0 THEN 'model' ELSE 'rules' END AS method FROM r""",
)
def sale_class(spark, sf):
    """A model's verdict on every fifth record, the rules on the rest."""
    comps = sale_comps(spark, sf).withColumn("land_zoning", F.expr(_ZONES))
    verdicts = comps.where("pos % 5 = 0").select("pos", F.lit("Fund interest").alias("asset_type"), "relevance_score")
    return rules.classified(comps, verdicts, "office").select("pos", "asset_type", "relevance_score", "method")


@query("q_cal14_cal15_classify", f"""WITH {COMPS_SQL}, r AS (SELECT pos, trim(regexp_replace(sale_type, '\\s*\\(.*\\)', '')) AS base, land_zoning AS z FROM comps)
SELECT pos, CASE WHEN base = '' THEN '' ELSE base || CASE WHEN contains(z, 'Residential') THEN ' (Mixed Use (Retail + Retail))' ELSE ' (Retail)' END END AS kind FROM r""")
def sale_kinds(spark, sf):
    return sale_comps(spark, sf).select("pos", rules.sale_class(F.col("sale_type"), F.col("land_zoning"), "retail").alias("kind"))


_PLACES = ["Marina Bay", "Robinson Road", "Suntec City", "Somerset", "Cecil Street", "Jurong East", "Paya Lebar", "one-north", "Tampines", "Elsewhere"]
_PLACE = "concat(site_name, ' ', [" + ", ".join(f"'{p}'" for p in _PLACES) + f"][pos * 7 % {len(_PLACES)} + 1])"
_PLACE_LABELS = ["Prime Core CBD (Marina Bay)", "Core CBD (Raffles Place / Shenton)", "Core CBD (City Hall / Beach Rd)", "Orchard / City Fringe", "CBD Fringe (Tanjong Pagar)", "Decentralised / JLD", "Decentralised (Paya Lebar)", "one-north / Buona Vista", "Suburban", "Decentralised"]


@query(
    "q_cal15_land_class",
    f"""WITH {LAND_SQL}, l AS (SELECT pos, lower(land_zoning) AS z, [{', '.join(f"'{p}'" for p in _PLACE_LABELS)}][pos * 7 % {len(_PLACES)} + 1] AS location FROM land)
SELECT pos, location, CASE WHEN contains(z, 'business park') THEN 'Grade B (Business Park)' WHEN contains(z, 'commercial') THEN CASE WHEN contains(lower(location), 'core') THEN 'Prime (Core CBD)' ELSE 'Grade A (CBD Fringe)' END ELSE '' END AS quality FROM l""",
)
def land_class(spark, sf):
    place = F.concat("site_name", F.lit(" "), F.get(F.array(*map(F.lit, _PLACES)), (F.col("pos") * 7 % len(_PLACES)).cast("int")))
    return land_sales(spark, sf).select("pos", rules.land_class(place, F.lit(None).cast("string"), F.col("land_zoning")).alias("c")).select("pos", "c.location", "c.quality")


_KINDS = list(rt.MARKERS)


def _ordered(least: str) -> str:
    entries = ", ".join("{'s': -" + k + ", 'i': " + str(i) + ", 'n': " + k + "_n, 'k': '" + k + "'}" for i, k in enumerate(_KINDS))
    return f"list_transform(list_sort(list_filter([{entries}], lambda x: {least})), lambda x: x.k)"


@query(
    "q_prv10_file_types",
    f"""WITH {_FILES}, l AS (SELECT doc_id, lower(body) AS t, lower(name || ' ' || body) AS b FROM files),
s AS (SELECT doc_id, t, b, {', '.join(f"{_count_sql(x)} AS {k}_n, 3 * {_count_sql(x)} + {_count_sql(y)} AS {k}" for k, (x, y) in rt.MARKERS.items())} FROM l),
p AS (SELECT doc_id, {_ordered('x.n >= 1 OR x.s <= -5')} AS present, {_ordered('TRUE')}[1] AS guess, greatest(land, sales, rent) AS top, {_count_sql(rt.REPORT_MARKERS).replace('contains(t,', 'contains(b,')} >= 2 AS report,
  CASE WHEN doc_id % 4 = 0 THEN ['rent'] ELSE [] END AS told, doc_id % 12 = 1 AS told_report FROM s)
SELECT doc_id AS file, array_to_string(CASE WHEN len(present) > 0 THEN present WHEN len(told) > 0 OR told_report THEN told WHEN top >= 3 THEN [guess] ELSE [] END, ',') AS types,
  CASE WHEN len(present) = 0 AND told_report THEN TRUE ELSE report END AS is_report,
  CASE WHEN len(present) = 1 AND NOT report THEN 'high' WHEN len(present) > 0 OR len(told) > 0 OR told_report OR top >= 3 THEN 'low' ELSE 'none' END AS confidence,
  CASE WHEN len(present) > 0 THEN 'keywords' WHEN len(told) > 0 OR told_report THEN 'model' WHEN top >= 3 THEN 'keywords' WHEN report THEN 'report' ELSE 'none' END AS method FROM p""",
)
def file_types(spark, sf):
    """Types of files; a model has told of every fourth file, and of some that they are reports."""
    files = _files(spark, sf).withColumnRenamed("doc_id", "file")
    told = F.when(F.col("file") % 4 == 0, F.array(F.lit("rent"))).otherwise(F.array().cast("array<string>"))
    verdicts = files.where("file % 4 = 0 OR file % 12 = 1").select("file", told.alias("types"), (F.col("file") % 12 == 1).alias("is_report"))
    return rules.file_types(files, verdicts).withColumn("types", F.array_join("types", ","))


# Columns

_HEADERS = ["Property", "Type", "Sub-Market", "Price (S$M)", "Price (psf)", "Deal value", "Built area", "Sale Date", "Consideration per sqm", "Remarks"]
_PICK = "[" + ", ".join(f"'{h}'" for h in _HEADERS) + "][(table_id * 3 + c * (1 + table_id % 3)) % 10 + 1]"
_TABLE_HEADS = f"heads AS (SELECT table_id, CAST(c AS INTEGER) AS \"column\", {_PICK} AS header FROM (SELECT DISTINCT o_custkey AS table_id FROM orders), range(0, 6) r(c))"
_CELLS = """cells AS (SELECT o_custkey AS table_id, CAST(c AS INTEGER) AS "column", CASE (o_custkey + o_orderkey + c) % 4 WHEN 0 THEN 'Office tower' WHEN 1 THEN 'Strata' WHEN 2 THEN CASE WHEN o_custkey % 2 = 0 THEN 'En bloc' ELSE 'Retail' END ELSE '' END AS cell FROM orders, range(0, 6) r(c))"""


def _tables(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    columns = F.explode(F.sequence(F.lit(0), F.lit(5))).alias("column")
    pick = F.get(F.array(*map(F.lit, _HEADERS)), ((F.col("table_id") * 3 + F.col("column") * (1 + F.col("table_id") % 3)) % 10).cast("int"))
    heads = orders.select(F.col("o_custkey").alias("table_id")).distinct().select("table_id", columns).withColumn("header", pick)
    at = (F.col("o_custkey") + F.col("o_orderkey") + F.col("column")) % 4
    cell = F.when(at == 0, "Office tower").when(at == 1, "Strata").when(at == 2, F.when(F.col("o_custkey") % 2 == 0, "En bloc").otherwise("Retail")).otherwise("")
    return heads, orders.select("o_custkey", "o_orderkey", columns).select(F.col("o_custkey").alias("table_id"), "column", cell.alias("cell"))


@query(
    "q_map2_map3_map5_rules",
    f"""WITH {_TABLE_HEADS}, {_CELLS}, v AS (SELECT table_id, "column", count(*) AS n, count(*) FILTER (cell IN ('Office tower', 'Retail')) AS uses, count(*) FILTER (cell IN ('Strata', 'En bloc')) AS kinds FROM cells WHERE cell <> '' GROUP BY ALL)
SELECT h.table_id, h."column", CASE header WHEN 'Sub-Market' THEN '_submarket' WHEN 'Price (S$M)' THEN 'price_sgd_m' WHEN 'Price (psf)' THEN 'price_psf_gfa' WHEN 'Consideration per sqm' THEN 'price_psf_gfa'
  WHEN 'Type' THEN CASE WHEN uses >= greatest(1, (n + 1) // 2) AND uses >= kinds THEN 'land_zoning' WHEN kinds >= greatest(1, (n + 1) // 2) THEN 'sale_type' END END AS rule FROM heads h LEFT JOIN v USING (table_id, "column")""",
)
def header_rules(spark, sf):
    heads, cells = _tables(spark, sf)
    return rules.header_rules(heads, cells).select("table_id", "column", "rule")


FIELDS = {"property_name": ("property", "building"), "sale_date": ("sale date", "date"), "sale_type": ("sale type",), "land_zoning": ("zoning",), "price_sgd_m": ("deal price",), "price_psf_gfa": ("unit price",), "gfa_sf": ("gfa",)}


def _similar(spark, sf, heads):
    """Scores of headers and fields from their vectors: of a header one row of ``embeddings``, of a field the mean of its synonyms'."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 100").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    words = [(f, i * 10 + j) for i, (f, names) in enumerate(FIELDS.items()) for j in range(len(names))]
    f = spark.createDataFrame(words, "field string, vec_id long").join(F.broadcast(e), "vec_id").select("field", F.posexplode("v").alias("i", "x"))
    means = f.groupBy("field", "i").agg(F.avg("x").alias("x")).groupBy("field").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda y: y["x"]).alias("m"))
    h = heads.withColumn("vec_id", F.pmod(F.xxhash64("header"), F.lit(90))).join(F.broadcast(e), "vec_id")  # a hundred rows
    return h.crossJoin(F.broadcast(means)).select("table_id", "column", "field", text.cosine(F.col("v"), F.col("m")).alias("score"))  # seven fields


@query("q_map6_map9_embedding_tier")
def tiers(spark, sf):
    """All tiers on the tables of customers; tests hold it against a plain Python loop."""
    heads, cells = _tables(spark, sf)
    return rules.map_tiers(heads, cells, FIELDS, _similar(spark, sf, heads))


@query(
    "q_map7_verdict_tier",
    f"""WITH {_TABLE_HEADS}, m AS (SELECT table_id, 'property_name' AS field, min("column") AS "column" FROM heads WHERE header = 'Property' GROUP BY table_id),
v AS (SELECT table_id, CASE "column" WHEN 0 THEN 'property_name' WHEN 1 THEN 'gfa_sf' WHEN 2 THEN 'gfa_sf' ELSE 'buyer' END AS field, "column" FROM heads WHERE table_id % 3 <> 0),
f AS (SELECT v.* FROM v LEFT JOIN m a ON a.table_id = v.table_id AND a.field = v.field LEFT JOIN m b ON b.table_id = v.table_id AND b."column" = v."column" WHERE a.field IS NULL AND b.field IS NULL),
g AS (SELECT table_id, field, min("column") AS "column" FROM f GROUP BY ALL)
SELECT *, 'exact' AS method FROM m UNION ALL SELECT *, 'model' FROM g""",
)
def verdict_tier(spark, sf):
    heads, _ = _tables(spark, sf)
    exact = heads.where("header = 'Property'").groupBy("table_id").agg(F.min("column").alias("column")).select("table_id", F.lit("property_name").alias("field"), "column", F.lit("exact").alias("method"))
    c = F.col("column")
    told = heads.where("table_id % 3 <> 0").select("table_id", F.when(c == 0, "property_name").when(c.isin(1, 2), "gfa_sf").otherwise("buyer").alias("field"), "column")
    return rules.with_verdicts(exact, told)


@query(
    "q_snk6_mapping_tab",
    f"""WITH {_TABLE_HEADS}, m AS (SELECT table_id, f.field, min("column") AS "column" FROM heads JOIN (VALUES ('property_name', 'Property'), ('sale_date', 'Sale Date'), ('gfa_sf', 'Built area')) f(field, h) ON header = f.h GROUP BY ALL)
SELECT t.table_id, k.field, coalesce(h.header, '—') AS header FROM (SELECT DISTINCT table_id FROM heads) t, (VALUES ('property_name'), ('sale_date'), ('gfa_sf')) k(field) LEFT JOIN m ON m.table_id = t.table_id AND m.field = k.field LEFT JOIN heads h ON h.table_id = m.table_id AND h."column" = m."column\"""",
)
def mapping_tab(spark, sf):
    from evidentia.operators import grids

    heads, _ = _tables(spark, sf)
    fields = {"property_name": ("property",), "sale_date": ("sale date",), "gfa_sf": ("built area",)}
    return rules.mapping_tab(grids.map_columns(heads, fields), heads, list(fields))


@query("q_ded6_headers", f'WITH {_TABLE_HEADS} SELECT table_id, header, min("column") AS "column" FROM heads GROUP BY ALL')
def distinct_headers(spark, sf):
    return rules.distinct_headers(_tables(spark, sf)[0])


_FUZZY = {"price": ("consideration", "price"), "area": ("area",), "date": ("lease", "date"), "kind": ("type", "market")}


@query(
    "q_row9_fuzzy_columns",
    f"""WITH {_TABLE_HEADS}, h AS (SELECT table_id, f.field, "column", CASE WHEN contains(lower(header), f.a) THEN 0 ELSE 1 END AS i FROM heads JOIN (VALUES ('price', 'consideration', 'price'), ('area', 'area', 'area'), ('date', 'lease', 'date'), ('kind', 'type', 'market')) f(field, a, b) ON contains(lower(header), f.a) OR contains(lower(header), f.b))
SELECT table_id, field, arg_min("column", (i, "column")) AS "column" FROM h GROUP BY ALL""",
)
def fuzzy(spark, sf):
    return rules.fuzzy_columns(_tables(spark, sf)[0], _FUZZY)


# Tables that other programs extract

_METHODS = ["lattice", "lines", "ocr", "text"]


@query(
    "q_src9_preferred_tables",
    """WITH t AS (SELECT o_custkey AS page, o_orderkey AS table_no, CASE o_orderkey % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'ocr' WHEN 2 THEN 'lines' WHEN 3 THEN 'lattice' ELSE 'other' END AS method FROM orders WHERE o_orderkey % 3 <> 1),
r AS (SELECT *, list_position(['lattice', 'lines', 'ocr', 'text'], method) AS r FROM t) SELECT page, table_no, method FROM r WHERE r IS NOT NULL QUALIFY r = min(r) OVER (PARTITION BY page)""",
)
def preferred(spark, sf):
    k = F.col("o_orderkey") % 5
    method = F.when(k == 0, "text").when(k == 1, "ocr").when(k == 2, "lines").when(k == 3, "lattice").otherwise("other")
    t = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey % 3 <> 1").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("table_no"), method.alias("method"))
    return rules.preferred_tables(t, _METHODS)


@query(
    "q_src13_src15_page_records",
    f"""WITH {COMPS_SQL}, p AS (SELECT pos, pos // 20 AS page, pos % 4 = 0 AS in_table FROM comps WHERE pos // 20 % 7 <> 0 OR pos % 4 <> 0),
tables AS (SELECT page, pos FROM p WHERE in_table AND page % 2 = 0), prose AS (SELECT page, pos FROM p WHERE NOT in_table), tabular AS (SELECT DISTINCT page FROM comps c JOIN p USING (pos) GROUP BY page HAVING bool_or(price_m IS NULL))
SELECT page, pos, 'table' AS origin FROM tables UNION ALL SELECT page, pos, 'prose' FROM prose WHERE page IN (SELECT page FROM tabular) AND page NOT IN (SELECT page FROM tables)""",
)
def page_records(spark, sf):
    p = sale_comps(spark, sf).select("pos", F.expr("pos div 20").alias("page"), "price_m").where("page % 7 <> 0 OR pos % 4 <> 0")
    tabular = p.groupBy("page").agg(F.bool_or(F.col("price_m").isNull()).alias("ok")).where("ok").select("page")
    return rules.page_records(p.where("pos % 4 = 0 AND page % 2 = 0").select("page", "pos"), p.where("pos % 4 <> 0").select("page", "pos"), tabular)


@query("q_prv3_record_table", f"WITH {COMPS_SQL} SELECT pos, coalesce(CASE WHEN address IS NOT NULL THEN 'p' || CAST(pos % 40 AS VARCHAR) || '#1' END, CASE WHEN price_m IS NOT NULL THEN 'p' || CAST(pos % 40 AS VARCHAR) || '#2' END) AS \"table\" FROM comps")
def record_table(spark, sf):
    page = F.concat(F.lit("p"), (F.col("pos") % 40).cast("string"))
    source = lambda c, n: F.struct(F.when(F.col(c).isNotNull(), F.concat(page, F.lit(n))).alias("table"), F.lit("verbatim").alias("how"))
    prov = F.create_map(F.lit("address"), source("address", "#1"), F.lit("price_m"), source("price_m", "#2"))
    return sale_comps(spark, sf).select("pos", rules.record_table(prov).alias("table"))


_WRITTEN = """SELECT o_custkey AS table_id, CAST(n AS INT) AS row, CASE
  WHEN n = 1 THEN {l}('Title', '', '', ''){r} WHEN n = 2 OR n = 5 THEN {l}('Property', 'Map Marker', 'Source', 'Price'){r} WHEN n = 4 THEN {l}('', '', '', ''){r}
  WHEN n = last THEN {l}('Average', '', '', CAST(o_orderkey % 100 AS {s})){r} ELSE {l}(concat('Tower ', CAST(o_orderkey % 50 AS {s})), CAST(n AS {s}), 'pdf', CAST(o_orderkey % 900 AS {s})){r} END AS cells
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS last FROM {orders})"""


@query(
    "q_prv8_read_back",
    f"""WITH w AS ({_WRITTEN.format(l='list_value', r='', s='VARCHAR', orders='orders')}), l AS (SELECT *, max(row) OVER (PARTITION BY table_id) AS last FROM w)
SELECT table_id, row, CASE WHEN cells[1] = 'Average' THEN 'average' WHEN row = 3 THEN 'subject' ELSE 'comp' END AS role, cells[1] || '|' || cells[2] || '|' || cells[4] AS cells FROM l WHERE row >= 3 AND row NOT IN (4, 5) AND last >= 2""",
)
def read_back(spark, sf):
    w = spark.sql(_WRITTEN.format(l="array", r="", s="STRING", orders="{orders}"), orders=spark.read.parquet(f"{sf}/orders.parquet"))
    return rules.read_back(w).withColumn("cells", F.array_join("cells", "|"))


_MARK = "CASE WHEN pos % 50 = 0 THEN '★' WHEN price_m IS NULL THEN '—' WHEN gfa_sf IS NULL THEN '' ELSE CAST(pos AS {s}) END"


@query("q_snk9_map_inputs", f"WITH {COMPS_SQL} SELECT pos, property_name AS property, CAST(pos AS VARCHAR) AS marker FROM comps WHERE pos % 50 <> 0 AND price_m IS NOT NULL AND gfa_sf IS NOT NULL")
def map_inputs(spark, sf):
    return rules.map_inputs(sale_comps(spark, sf).select("pos", F.col("property_name").alias("property"), F.expr(_MARK.format(s="STRING")).alias("marker")))


# Places

_LOOKUP = f"""WITH {COMPS_SQL}, q AS (SELECT *, CASE WHEN lon IS NULL OR lat IS NULL THEN coalesce(address, property_name) END AS query FROM comps),
found AS (SELECT address AS query, 'onemap' AS provider, min(lon) AS lon, min(lat) AS lat FROM comps WHERE pos % 3 = 0 AND lon IS NOT NULL AND address IS NOT NULL GROUP BY address
  UNION ALL SELECT address, 'google', max(lon), max(lat) FROM comps WHERE pos % 2 = 0 AND lon IS NOT NULL AND address IS NOT NULL GROUP BY address
  UNION ALL SELECT property_name, 'google', max(lon), max(lat) FROM comps WHERE lon IS NOT NULL GROUP BY property_name),
b AS (SELECT query, arg_min(provider, CASE provider WHEN 'onemap' THEN 0 ELSE 1 END) AS p, arg_min(lon, CASE provider WHEN 'onemap' THEN 0 ELSE 1 END) AS x, arg_min(lat, CASE provider WHEN 'onemap' THEN 0 ELSE 1 END) AS y FROM found GROUP BY query),
r AS (SELECT pos, q.query, address, p, coalesce(lon, x) AS lon, coalesce(lat, y) AS lat FROM q LEFT JOIN b ON b.query = q.query)"""


@query(
    "q_spa6_spa7_spa10_geocode",
    f"""{_LOOKUP} SELECT pos, lon, lat, coalesce({km_sql('lon', 'lat', 103.85, 1.28)}, 9999.0) AS distance_km, CASE WHEN query IS NULL THEN 'cached' ELSE coalesce(p, 'failed') END AS provider, query IS NOT NULL AND address IS NULL AND p IS NOT NULL AS by_name,
  coalesce(query IS NOT NULL AND sqrt(pow((lon - 103.8) * 111.32 * cos(radians(1.35)), 2) + pow((lat - 1.35) * 110.574, 2)) <= 1.5, FALSE) AS suspect FROM r""",
)
def geocode(spark, sf):
    """Own coordinates, else looked up by address or name with two providers."""
    comps = sale_comps(spark, sf)
    known = comps.where("lon IS NOT NULL")
    look = lambda df, key, provider, f: df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("query")).agg(f("lon").alias("lon"), f("lat").alias("lat")).select("query", F.lit(provider).alias("provider"), "lon", "lat")
    found = look(known.where("pos % 3 = 0"), "address", "onemap", F.min).unionByName(look(known.where("pos % 2 = 0"), "address", "google", F.max)).unionByName(look(known, "property_name", "google", F.max))
    placed = rules.attach_places(comps, found, ["onemap", "google"], 103.85, 1.28, (103.8, 1.35))
    return placed.select("pos", "lon", "lat", "distance_km", "provider", "by_name", "suspect")


@query("q_row15_row16_attach", f"""WITH {COMPS_SQL}, a AS (SELECT address, max(lon) AS x, max(lat) AS y FROM comps WHERE pos % 4 = 1 AND lon IS NOT NULL AND address IS NOT NULL GROUP BY address)
SELECT pos, coalesce({km_sql('x', 'y', 103.85, 1.28)}, 9999.0) AS distance_km, CASE WHEN x IS NULL THEN 'failed' ELSE 'file' END AS provider FROM comps LEFT JOIN a USING (address)""")
def attach_by_address(spark, sf):
    """New records have no coordinates and no names to fall back on: only the address is looked up."""
    comps = sale_comps(spark, sf)
    found = comps.where("pos % 4 = 1 AND lon IS NOT NULL AND address IS NOT NULL").groupBy(F.col("address").alias("query")).agg(F.max("lon").alias("lon"), F.max("lat").alias("lat")).withColumn("provider", F.lit("file"))
    none = F.lit(None)
    bare = comps.withColumns({"lon": none.cast("double"), "lat": none.cast("double"), "property_name": none.cast("string")})
    return rules.attach_places(bare, found, ["file"], 103.85, 1.28, (103.8, 1.35)).select("pos", "distance_km", "provider")


@query("q_row11_addresses", f"WITH {COMPS_SQL} SELECT pos, CASE WHEN pos % 8 = 0 THEN '' WHEN pos % 4 = 0 THEN 'No. ' || address ELSE address END AS address FROM comps")
def addresses(spark, sf):
    """A model has cleaned the addresses of every fourth record, and rejected half of these."""
    comps = sale_comps(spark, sf).select("pos", "address")
    clean = comps.where("pos % 4 = 0 AND (address IS NOT NULL OR pos % 8 = 0)").select("pos", F.when(F.col("pos") % 8 != 0, F.concat(F.lit("No. "), "address")).alias("address"))
    return rules.overwritten(comps, clean, "address")


@query("q_cal16_market_fields", f"WITH {COMPS_SQL} SELECT pos, CASE WHEN address IS NULL AND pos % 3 = 0 THEN country WHEN pos % 3 = 0 THEN address WHEN address IS NULL THEN CASE WHEN pos % 3 = 1 THEN land_zoning ELSE country END ELSE CASE WHEN pos % 3 = 1 THEN address ELSE land_zoning END END AS place FROM comps")
def market_fields(spark, sf):
    """Addresses of one, two and three parts."""
    k = F.col("pos") % 3
    full = F.when(k == 0, F.coalesce("address", F.lit(""))).when(k == 1, F.concat_ws(" , ", "address", "land_zoning")).otherwise(F.concat_ws(",", "address", F.when(F.col("address").isNotNull(), F.col("land_zoning")), F.col("country"), F.lit(" ")))
    return sale_comps(spark, sf).select("pos", rules.market_place(full, F.col("country")).alias("place"))


_LINES = "list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"


@query(
    "q_ded7_address_candidates",
    f"""WITH d AS (SELECT doc_id, {_LINES} AS ls FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i, ls FROM d),
c AS (SELECT doc_id, i, line, ls[i + 1] AS below, contains(lower(line), 'license') OR contains(lower(line), 'para') AS label, (contains(lower(line), 'the') OR contains(lower(line), 'der')) AND regexp_matches(line, '[0-9]') AS street, contains(lower(line), 'version') OR contains(lower(line), 'tion') AS country FROM r),
n AS (SELECT doc_id, i, 0 AS j, line FROM c WHERE label UNION ALL SELECT doc_id, i, 1, below FROM c WHERE label AND below IS NOT NULL UNION ALL SELECT doc_id, i, 2, line FROM c WHERE street UNION ALL SELECT doc_id, i, 3, line FROM c WHERE country),
f AS (SELECT doc_id, lower(line) AS k, min(i) AS i, arg_min(j, (i, j)) AS j, arg_min(line, (i, j)) AS line FROM n WHERE length(line) > 4 GROUP BY ALL),
b AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS n, count(*) OVER (PARTITION BY doc_id ORDER BY i RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f)
SELECT doc_id, CAST(n AS INTEGER) AS n, line FROM b WHERE before < 10""",
)
def address_candidates(spark, sf):
    return rules.address_candidates(_docs(spark, sf), ["license", "para"], ["the", "der"], ["version", "tion"])


# Rows, configurations, caches


@query(
    "q_row4_snk4_global_rows",
    f"""WITH {COMPS_SQL}, g AS (SELECT pos, property_name AS property, round_even(coalesce(CASE WHEN pos % 5 = 0 THEN price_m * 1.5 END, price_m) / 1000, 4) AS price_raw, CAST(coalesce(CASE WHEN pos % 4 = 0 THEN 5000 + pos END, gfa_sf) AS BIGINT) AS site_area, CASE WHEN pos % 6 = 0 THEN 77.5 END AS unit FROM comps)
SELECT pos, property, price_raw, site_area, coalesce(unit, round(price_raw * 1e9 / site_area, 0))::DOUBLE AS unit_price FROM g""",
)
def global_rows(spark, sf):
    pos = F.col("pos")
    c = sale_comps(spark, sf).select("pos", "property_name", "price_m", F.col("gfa_sf"), F.when(pos % 5 == 0, F.col("price_m") * 1.5).alias("price_raw"), F.when(pos % 4 == 0, 5000 + pos).alias("site_area"), F.when(pos % 6 == 0, 77.5).otherwise(0.0).alias("unit_price"))
    return rules.global_rows(c, "B")


@query("q_sch4_global_schemas", "SELECT n_nationkey, concat('Price (', c, ' ', p, ')|GFA (', a, ')|Price (', CASE a WHEN 'SF' THEN 'psf' ELSE 'psm' END, ')') AS headers FROM (SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'KRW' WHEN 1 THEN 'USD' ELSE 'SGD' END AS c, CASE WHEN n_regionkey = 0 THEN 'B' ELSE 'M' END AS p, CASE WHEN n_nationkey % 2 = 0 THEN 'SF' ELSE 'SQM' END AS a FROM nation)")
def global_schemas(spark, sf):
    """Headers of an output table in every nation's currency and units."""
    from evidentia.operators import report

    units = [(r, odd, c, p, a) for r, (c, p) in enumerate([("KRW", "B"), ("USD", "M"), ("SGD", "M"), ("SGD", "M"), ("SGD", "M")]) for odd, a in ((0, "SF"), (1, "SQM"))]
    names = lambda c, p, a: "|".join(h for key in ("price_m", "gfa_sf", "price_psf") for h, k, _ in report.output_schema("sales", c, p, a) if k == key)
    dim = spark.createDataFrame([(r, odd, names(c, p, a)) for r, odd, c, p, a in units], "n_regionkey int, odd int, headers string")
    nations = spark.read.parquet(f"{sf}/nation.parquet").withColumn("odd", F.col("n_nationkey") % 2)
    return nations.join(F.broadcast(dim), ["n_regionkey", "odd"]).select("n_nationkey", "headers")  # ten rows


_FLOOR = "CAST(trunc(TRY_CAST(raw_number AS DOUBLE)) AS BIGINT)"


@query(
    "q_snk15_cfg1_deal_config",
    f"""WITH {COMPS_SQL}, k AS (SELECT *, CASE WHEN lower(land_zoning) IN ('hotel') THEN 'hotel' ELSE 'office' END AS kind FROM comps)
SELECT pos, coalesce(address, property_name) AS deal_name, property_name, coalesce({_FLOOR}, 0) AS gfa_sf, TRY_CAST(raw_number AS DOUBLE) AS price_m, kind AS asset_class, CASE WHEN sale_type = '' THEN 'Whole Block (' || upper(kind[1]) || kind[2:] || ')' ELSE sale_type END AS asset_type FROM k""",
)
def deal_config(spark, sf):
    c = sale_comps(spark, sf).select("pos", F.col("address").alias("deal_name"), "property_name", F.col("raw_number").alias("gfa_sf"), F.col("raw_number").alias("price_m"), F.col("land_zoning").alias("asset_class"), F.col("sale_type").alias("asset_type"))
    return rules.deal_config(c)


@query("q_row10_ranked_verdicts", f"""WITH {COMPS_SQL}, v AS (SELECT pos, country, CAST(pos * 13 % 11 AS INTEGER) AS relevance_score FROM comps WHERE pos % 3 = 0)
SELECT pos, country, relevance_score, CAST(row_number() OVER (PARTITION BY country ORDER BY relevance_score DESC, pos) AS INTEGER) AS marker FROM v QUALIFY marker <= 15""")
def ranked(spark, sf):
    comps = sale_comps(spark, sf)
    verdicts = comps.where("pos % 3 = 0").select("pos", (F.col("pos") * 13 % 11).cast("int").alias("relevance_score"))
    return rules.ranked_with_verdicts(comps, verdicts, "country", 15).select("pos", "country", "relevance_score", "marker")


@query("q_jon14_latest_output", "SELECT source, arg_max(path, (n_chars, path)) AS path FROM (SELECT source, n_chars, concat(CASE doc_id % 3 WHEN 0 THEN 'Online_' WHEN 1 THEN 'Input_' ELSE 'Draft_' END, CAST(doc_id AS VARCHAR), '.xlsx') AS path FROM documents) WHERE path LIKE 'Online%' OR path LIKE 'Input%' GROUP BY source")
def latest(spark, sf):
    k = F.col("doc_id") % 3
    path = F.concat(F.when(k == 0, "Online_").when(k == 1, "Input_").otherwise("Draft_"), F.col("doc_id").cast("string"), F.lit(".xlsx"))
    return rules.latest_file(_docs(spark, sf).select("source", path.alias("path"), F.col("n_chars").alias("mtime")), ["Online_", "Input_"], "source")


@query("q_src27_txt24_uncached", """WITH f AS (SELECT md5(concat_ws(':', lang, CAST(n_chars AS VARCHAR), CAST(doc_id % 5 AS VARCHAR))) AS key, doc_id FROM documents),
c AS (SELECT key FROM f WHERE doc_id % 7 = 0) SELECT DISTINCT key FROM f WHERE key NOT IN (SELECT key FROM c)""")
def uncached(spark, sf):
    files = _docs(spark, sf).select("doc_id", rules.cache_key(F.col("lang"), F.col("n_chars"), F.col("doc_id") % 5).alias("key"))
    return rules.uncached(files, files.where("doc_id % 7 = 0")).select("key")


@query("q_cal22_next_source", f"""WITH {COMPS_SQL}, t AS (SELECT country, list_filter(['pdf_1', 'pdf_2', 'pdf_3', 'online'], lambda s: NOT list_contains(list(DISTINCT CASE WHEN pos % 40 < 3 THEN source WHEN pos % 200 = 7 THEN 'online' END), s)) AS left_ FROM comps GROUP BY country)
SELECT country, CASE WHEN len(left_) = 0 THEN 'stop' WHEN list_contains(left_, 'online') THEN 'online' ELSE left_[1] END AS next FROM t""")
def next_source(spark, sf):
    tried = F.when(F.col("pos") % 40 < 3, F.col("source")).when(F.col("pos") % 200 == 7, "online")
    t = sale_comps(spark, sf).groupBy("country").agg(F.collect_set(tried).alias("tried"))  # four sources at most
    return t.select("country", rules.next_source(F.array_except(F.array(*map(F.lit, ("pdf_1", "pdf_2", "pdf_3", "online"))), "tried")).alias("next"))


@query("q_txt15_location_context")
def location_context(spark, sf):
    """Of the other turns of a conversation the sentence that best supports its last one; tests hold it against plain Python."""
    c = spark.read.parquet(f"{sf}/conversations.parquet").where("text IS NOT NULL")
    last = c.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text")))
    claims = last.where("n = 1").select(F.col("conv_id").alias("claim_id"), "conv_id", F.col("text").alias("claim"))
    spans = last.where("n > 1").select("conv_id", "n", F.when(F.col("role") == "user", F.concat(F.lit("https://example.org/"), F.col("turn").cast("string"))).otherwise("").alias("url"), "text", F.col("n").cast("int").alias("ord"))
    return rules.best_span(claims, spans, "conv_id")


@query("q_set4_common_words", f"WITH {COMPS_SQL} SELECT pos, array_to_string(list_sort(list_intersect(string_split(lower(property_name), ' '), string_split(lower(land_zoning || ' Tower Business Street'), ' '))), ',') AS common FROM comps")
def common_words(spark, sf):
    both = F.array_intersect(text.tokens(F.col("property_name")), text.tokens(F.concat("land_zoning", F.lit(" Tower Business Street"))))
    return sale_comps(spark, sf).select("pos", F.array_join(F.array_sort(both), ",").alias("common"))


@query("q_agg14_set5_price_sets", f"""WITH {GRID_SQL}, s AS (SELECT table_id, list(DISTINCT cells[3]) AS s, list(DISTINCT cells[3]) FILTER (row % 4 <> 0 OR cells[3] < '5') AS t FROM grid WHERE row % 6 > 1 GROUP BY table_id)
SELECT table_id, CAST(len(s) AS BIGINT) AS prices, len(list_filter(s, lambda x: NOT list_contains(coalesce(t, []), x))) = 0 AS subset FROM s""")
def price_sets(spark, sf):
    """The prices of a table, and whether those of its more reliable rows are all of them."""
    price = F.get("cells", F.lit(2))
    sets = grid(spark, sf).where("row % 6 > 1").groupBy("table_id").agg(F.collect_set(price).alias("s"), F.collect_set(F.when((F.col("row") % 4 != 0) | (price < "5"), price)).alias("t"))
    return sets.select("table_id", F.size("s").cast("long").alias("prices"), (F.size(F.array_except("s", "t")) == 0).alias("subset"))


_CODES = (("office", "C1"), ("hotel", "H1"), ("business", "B9"), ("commercial", "C2"))


@query("q_cfg2_type_codes", f"WITH {COMPS_SQL} SELECT pos, CASE WHEN contains(lower(land_zoning), 'hotel') THEN 'H1' WHEN contains(lower(land_zoning), 'business') THEN 'B9' WHEN contains(lower(land_zoning), 'commercial') THEN 'C2' ELSE 'X' END AS code FROM comps")
def type_codes(spark, sf):
    return sale_comps(spark, sf).select("pos", rules.first_named(F.col("land_zoning"), [((w,), c) for w, c in _CODES], "X").alias("code"))
