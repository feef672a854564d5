"""Queries of grid repair, column mapping and connectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import grids
from evidentia.plans.register import query

#: Rows of sheets made of orders: a sheet per customer, with headers, separators and gaps by key.
_GRID = """SELECT o_custkey AS table_id, o_orderkey AS row,
  CASE WHEN o_orderkey % 6 = 0 THEN array('Property', 'Sale Date', 'Price (S$M)', 'GFA')
    WHEN o_orderkey % 6 = 1 THEN array('', '', '', '')
    ELSE array(CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('Tower ', CAST(o_orderkey % 50 AS STRING)) END, o_orderpriority, CAST(o_orderkey % 900 AS STRING), CAST(o_orderkey AS STRING)) END AS cells FROM {orders}"""
GRID_SQL = "grid AS (" + _GRID.replace("STRING", "VARCHAR").replace("array(", "list_value(").replace("{orders}", "orders") + ")"
KEYWORDS = ["property", "price", "sale", "gfa"]
_FILLED = "len(list_filter(cells, lambda c: trim(c) <> ''))"
_TEXT = "len(list_filter(cells, lambda c: regexp_matches(c, '[A-Za-z]')))"
_HEAD = "row % 6 = 0"


def grid(spark, sf):
    return spark.sql(_GRID, orders=spark.read.parquet(f"{sf}/orders.parquet"))


@query("q_src5_header_row", f"WITH {GRID_SQL} SELECT table_id, coalesce(min(row) FILTER ({_TEXT} >= 3), 0) AS header FROM grid GROUP BY table_id")
def header_row(spark, sf):
    return grids.header_row(grid(spark, sf))


@query(
    "q_src4_best_sheet",
    f"""WITH {GRID_SQL}, p AS (SELECT table_id % 50 AS book, table_id, max(CASE WHEN {_HEAD} THEN 4 ELSE 0 END) AS hits, count(*) FILTER ({_FILLED} > 0) AS rows FROM grid GROUP BY 1, 2)
SELECT book, arg_max(table_id, (hits, rows, -table_id)) AS table_id FROM p GROUP BY book""",
)
def best_sheet(spark, sf):
    return grids.best_sheet(grid(spark, sf).withColumn("book", F.col("table_id") % 50), "book", KEYWORDS)


@query("q_src6_split_tables", f"WITH {GRID_SQL} SELECT table_id, row, CAST(sum(CASE WHEN {_HEAD} THEN 1 ELSE 0 END) OVER (PARTITION BY table_id ORDER BY row) AS BIGINT) AS block, {_HEAD} AS is_header FROM grid WHERE {_FILLED} > 1")
def split_tables(spark, sf):
    return grids.split_tables(grid(spark, sf), KEYWORDS).select("table_id", "row", "block", "is_header")


@query("q_src7_keywords", "SELECT DISTINCT unnest(list_filter(string_split(lower(p_name), ' '), lambda w: length(w) >= 3)) AS keyword FROM part")
def sheet_keywords(spark, sf):
    words = F.filter(F.split(F.lower("p_name"), " "), lambda w: F.length(w) >= 3)
    return spark.read.parquet(f"{sf}/part.parquet").select(F.explode(words).alias("keyword")).distinct()


@query("q_win2_fill_down", f"WITH {GRID_SQL}, n AS (SELECT table_id, row, cells[1] AS name FROM grid WHERE NOT {_HEAD}) SELECT table_id, row, last_value(CASE WHEN trim(name) <> '' THEN name END IGNORE NULLS) OVER (PARTITION BY table_id ORDER BY row) AS name FROM n")
def fill_down(spark, sf):
    named = grid(spark, sf).where("row % 6 <> 0").select("table_id", "row", F.get("cells", F.lit(0)).alias("name"))
    return grids.fill_down(named, "name")


@query(
    "q_win3_win4_stitch",
    f"""WITH {GRID_SQL}, r AS (SELECT table_id, row, 'part ' || CAST(row % 9 AS VARCHAR) AS name, CASE WHEN row % 3 = 0 THEN row % 900 END AS price FROM grid),
g AS (SELECT *, sum(CASE WHEN price IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY table_id ORDER BY row) AS g FROM r)
SELECT table_id, min(row) AS row, string_agg(name, ' ' ORDER BY row) AS name, max(price) AS price FROM g GROUP BY table_id, g""",
)
def stitch(spark, sf):
    rows = grid(spark, sf).select("table_id", "row", F.concat(F.lit("part "), (F.col("row") % 9).cast("string")).alias("name"), F.when(F.col("row") % 3 == 0, F.col("row") % 900).alias("price"))
    return grids.stitch_wrapped(rows, "name", "price")


@query("q_win8_collapsed_cell", f"WITH {GRID_SQL} SELECT table_id, row, CASE WHEN row % 2 = 0 THEN '1,133.00' ELSE '5' END AS a, CASE WHEN row % 2 = 0 THEN '3,757' ELSE '' END AS b FROM grid")
def collapsed(spark, sf):
    a, b = grids.split_collapsed(F.when(F.col("row") % 2 == 0, "1,133.00\n3,757").otherwise("5"), F.lit(""))
    return grid(spark, sf).select("table_id", "row", a.alias("a"), b.alias("b"))


@query(
    "q_win12_enumeration",
    f"""WITH {GRID_SQL}, r AS (SELECT table_id, row, row_number() OVER (PARTITION BY table_id ORDER BY row) AS p, table_id % 2 = 0 AS numbered FROM grid), c AS (SELECT *, count(*) OVER (PARTITION BY table_id) AS n FROM r)
SELECT table_id, row, CASE WHEN numbered AND n < 2 THEN CAST(p AS VARCHAR) || '. Name' ELSE 'Name' END AS name FROM c""",
)
def enumeration(spark, sf):
    from pyspark.sql import Window

    p = F.row_number().over(Window.partitionBy("table_id").orderBy("row"))
    rows = grid(spark, sf).select("table_id", "row", F.when(F.col("table_id") % 2 == 0, F.concat(p.cast("string"), F.lit(". Name"))).otherwise("Name").alias("name"))
    return grids.strip_enumeration(rows, "name")


SYNONYMS = {"property_name": ("property", "building", "asset"), "sale_date": ("sale date", "date"), "price_sgd_m": ("price s m", "price"), "gfa_sf": ("gfa", "area")}


@query("q_map4_columns", f"WITH {GRID_SQL} SELECT DISTINCT table_id, f.field, CAST(f.c AS INTEGER) AS \"column\" FROM grid, (VALUES ('property_name', 0), ('sale_date', 1), ('price_sgd_m', 2), ('gfa_sf', 3)) f(field, c) WHERE {_HEAD}")
def columns(spark, sf):
    heads = grid(spark, sf).where("row % 6 = 0").select("table_id", F.posexplode("cells").alias("column", "header")).distinct()
    return grids.map_columns(heads, SYNONYMS)


@query("q_map1_agg16_value_labels", f"WITH {GRID_SQL} SELECT table_id, avg(CASE WHEN regexp_matches(cells[2], 'URGENT|HIGH|LOW|MEDIUM') THEN 1.0 ELSE 0.0 END)::DOUBLE >= 0.5 AS labelled FROM grid WHERE row % 6 > 1 GROUP BY table_id")
def value_labels(spark, sf):
    hit = F.when(F.get("cells", F.lit(1)).rlike("URGENT|HIGH|LOW|MEDIUM"), 1.0).otherwise(0.0)
    return grid(spark, sf).where("row % 6 > 1").groupBy("table_id").agg((F.avg(hit) >= 0.5).alias("labelled"))


@query("q_src17_geojson", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN abs(s_acctbal) ELSE s_suppkey * 2.5::DOUBLE END AS area, CAST(s_suppkey % 100 AS DOUBLE) + 0.5 AS lon FROM supplier WHERE s_nationkey % 3 = 0")
def geojson(spark, sf):
    """Features of a registry: sector allow-list, centroid, area with a fallback of site area by plot ratio."""
    from evidentia.sources.connectors import registry_features

    s = spark.read.parquet(f"{sf}/supplier.parquet")
    x = F.col("s_suppkey") % 100
    ring = F.array(*[F.array((x + i).cast("double"), F.lit(float(j))) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))])
    props = F.struct(F.col("s_suppkey").alias("id"), F.when(F.col("s_nationkey") % 3 == 0, "Office").otherwise("Church").alias("sector"), F.when(x % 2 == 0, F.abs("s_acctbal")).alias("gfa"), F.col("s_suppkey").cast("double").alias("site_area"), F.lit(2.5).alias("plot_ratio"))
    payload = F.to_json(F.struct(F.array(F.struct(props.alias("properties"), F.struct(F.array(ring).alias("coordinates")).alias("geometry"))).alias("features")))
    found = registry_features(s.select(payload.alias("payload")), ["Office"])
    return found.select(F.col("id").alias("s_suppkey"), "area", "lon")


@query("q_src18_html_rows", "SELECT s_suppkey, s_name, round(abs(s_acctbal) / 1000000, 9) AS price_m FROM supplier")
def html_rows(spark, sf):
    from evidentia.sources.connectors import html_table

    s = spark.read.parquet(f"{sf}/supplier.parquet")
    cells = F.concat_ws("</td><td>", F.col("s_suppkey").cast("string"), "s_name", F.abs("s_acctbal").cast("decimal(18,2)").cast("string"))
    page = F.concat(F.lit("<table><tr><th>h</th></tr><tr><td>"), cells, F.lit("</td></tr></table>"))
    rows = html_table(s.select(page.alias("html")), 3)
    c = F.col("cells")
    return rows.select(F.get(c, F.lit(0)).cast("long").alias("s_suppkey"), F.get(c, F.lit(1)).alias("s_name"), F.round(F.get(c, F.lit(2)).cast("double") / 1_000_000, 9).alias("price_m"))


@query("q_src16_records_json", "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def records_json(spark, sf):
    from evidentia.sources.connectors import read_records

    e = spark.read.parquet(f"{sf}/events.parquet")
    return read_records(e.select(F.to_json(F.struct("event_id", "event_type", F.from_json("props", "k int").alias("props"))).alias("value")), "event_id long, event_type string, props struct<k:int>").select("event_id", "event_type", F.col("props.k").alias("k"))


_BLOCKS = f"b AS (SELECT *, CAST(sum(CASE WHEN {_HEAD} THEN 1 ELSE 0 END) OVER (PARTITION BY table_id ORDER BY row) AS BIGINT) AS block FROM grid WHERE {_FILLED} > 1)"


@query(
    "q_src1_src3_sheet_scan",
    f"""WITH {GRID_SQL}, {_BLOCKS} SELECT table_id, block, row, cells[1] AS property_name, cells[2] AS sale_date, CAST(cells[3] AS DOUBLE) AS price_m, CAST(cells[4] AS DOUBLE) AS gfa_sf
FROM b WHERE block > 0 AND NOT {_HEAD} AND trim(cells[1]) <> '' AND CASE WHEN {_HEAD} THEN 0 ELSE CAST(cells[3] AS DOUBLE) END <> 0""",
)
def sheet_scan(spark, sf):
    return grids.sale_rows(grids.scan(grid(spark, sf), SYNONYMS, KEYWORDS))


@query("q_src2_lease_scan", f"WITH {GRID_SQL}, {_BLOCKS} SELECT table_id, row, nullif(trim(cells[1]), '') AS property_name, CAST(cells[4] AS DOUBLE) AS nla_sf, CAST(cells[3] AS DOUBLE) AS asking_rent FROM b WHERE block > 0 AND NOT {_HEAD}")
def lease_scan(spark, sf):
    return grids.lease_rows(grids.scan(grid(spark, sf), SYNONYMS, KEYWORDS))
