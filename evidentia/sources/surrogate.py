"""Comparable records derived from the order tables, in Spark and in SQL.

The evidence domain's records (sales, leases, land sales) are not in the test
tables; these views give every field a value that depends on an order's key
alone, with all the spellings and gaps that parsers must cope with. ``pos`` is
the order key: unique, so every ordered operator has a total order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_BODY = """
  SELECT o_orderkey AS pos, concat('pdf_', CAST(o_orderkey % 3 + 1 AS {str})) AS source,
    concat(CASE o_custkey % 5 WHEN 0 THEN 'Harbour Tower' WHEN 1 THEN 'Orchid Plaza' WHEN 2 THEN 'Marina Business Park' WHEN 3 THEN 'Cedar Logistics Hub' ELSE 'Strata Court' END, ' ', CAST(o_custkey % 211 AS {str})) AS property_name,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat(CAST(o_custkey % 300 + 1 AS {str}), ' Main Street') END AS address,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice / 1000 END AS price_m,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(1000 + o_orderkey * 7919 % 90000 AS BIGINT) END AS gfa_sf,
    CASE o_orderkey % 6 WHEN 0 THEN 'Whole building' WHEN 1 THEN '49% stake' WHEN 2 THEN 'Part (1/3 stake)' WHEN 3 THEN 'Block sale' WHEN 4 THEN 'Strata' ELSE '' END AS sale_type,
    CASE o_orderkey % 8
      WHEN 0 THEN concat('Q', CAST(quarter(o_orderdate) AS {str}), ' ', CAST(year(o_orderdate) AS {str}))
      WHEN 1 THEN CAST(year(o_orderdate) AS {str})
      WHEN 2 THEN {mon_year}
      WHEN 3 THEN {iso}
      WHEN 4 THEN ''
      WHEN 5 THEN {dmy}
      WHEN 6 THEN 'soon'
      ELSE concat('~Q', CAST(quarter(o_orderdate) AS {str}), ' ', CAST(year(o_orderdate) AS {str})) END AS sale_date,
    CASE o_custkey % 10 WHEN 0 THEN 999.0 WHEN 1 THEN 0.0 WHEN 2 THEN CAST(100 + o_orderkey % 800 AS DOUBLE) WHEN 3 THEN NULL ELSE CAST(o_orderkey % 99 + 1 AS DOUBLE) END AS remaining_yrs,
    CASE o_orderkey % 4 WHEN 0 THEN NULL ELSE CAST(30 + o_orderkey % 20 AS DOUBLE) / 1000 END AS npi_yield,
    CASE WHEN o_orderkey % 17 = 0 THEN CAST(0.04 AS DOUBLE) END AS reported_adj,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'Commercial' WHEN 'AUTOMOBILE' THEN 'Business 1' WHEN 'MACHINERY' THEN 'Hotel' WHEN 'HOUSEHOLD' THEN 'Residential with commercial' ELSE 'Business Park' END AS land_zoning,
    CAST(o_orderkey % 10 AS INT) AS relevance_score,
    CASE WHEN o_custkey % 19 = 0 THEN NULL ELSE CAST(103600 + o_custkey * 37 % 500 AS DOUBLE) / 1000 END AS lon,
    CASE WHEN o_custkey % 19 = 0 THEN NULL ELSE CAST(1200 + o_custkey * 53 % 250 AS DOUBLE) / 1000 END AS lat,
    concat('N', CAST(c_nationkey AS {str})) AS country,
    CASE o_orderkey % 8
      WHEN 0 THEN concat('$', CAST({whole} AS {str})) WHEN 1 THEN concat(CAST({whole} AS {str}), '%')
      WHEN 2 THEN concat(CAST({whole} AS {str}), '-', CAST({whole} + 30 AS {str}), '*') WHEN 3 THEN concat('-', CAST({whole} AS {str}))
      WHEN 4 THEN concat('1.', CAST({whole} AS {str}), '.3') WHEN 5 THEN ''
      WHEN 6 THEN concat('12,', CAST(100 + o_orderkey % 900 AS {str}), '.50 million') ELSE concat('0.0', CAST(10 + o_orderkey % 90 AS {str})) END AS raw_number
  FROM orders JOIN customer ON o_custkey = c_custkey
"""

_WHOLE = "CAST(floor(o_totalprice) AS BIGINT)"
_SPARK = _BODY.format(str="STRING", whole=_WHOLE, mon_year="date_format(o_orderdate, 'MMM yyyy')", iso="date_format(o_orderdate, 'yyyy-MM-dd')", dmy="date_format(o_orderdate, 'dd/MM/yyyy')")
#: A common table expression ``comps`` for DuckDB.
COMPS_SQL = "comps AS (" + _BODY.format(str="VARCHAR", whole=_WHOLE, mon_year="strftime(o_orderdate, '%b %Y')", iso="strftime(o_orderdate, '%Y-%m-%d')", dmy="strftime(o_orderdate, '%d/%m/%Y')") + ")"

_LEASES = """
  SELECT pos, source, property_name, address, lon, lat, country, sale_date AS lease_date,
    CASE WHEN pos % 9 = 0 THEN NULL ELSE CAST(50 + pos % 80 AS DOUBLE) / 10 + 0.00137 END AS asking_rent,
    CASE WHEN pos % 5 = 0 THEN CAST(40 + pos % 60 AS DOUBLE) / 10 END AS eff_rent,
    CASE WHEN pos % 4 = 0 THEN NULL ELSE CAST(1 + pos % 7 AS DOUBLE) END AS term_yrs, CAST(pos % 10 AS DOUBLE) AS rent_free_mths,
    CASE WHEN gfa_sf IS NULL THEN NULL ELSE gfa_sf / 10 END AS nla_sf, concat('Tenant ', CAST(pos % 50 AS {str})) AS tenant
  FROM comps
"""
LEASES_SQL = COMPS_SQL + ", leases AS (" + _LEASES.format(str="VARCHAR") + ")"

_LAND = """
  SELECT pos, source, concat('Site ', CAST(pos % 400 AS {str})) AS site_name, sale_date AS launch_date, land_zoning, remaining_yrs AS tenure_yrs,
    gfa_sf AS site_area_sf, CASE WHEN pos % 6 = 0 THEN NULL ELSE gfa_sf * 3 END AS max_gfa_sf, price_m, lon, lat, country FROM comps
"""
LAND_SQL = COMPS_SQL + ", land AS (" + _LAND.format(str="VARCHAR") + ")"


def sale_comps(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer")}
    return spark.sql(_SPARK.replace("FROM orders JOIN customer", "FROM {orders} JOIN {customer}"), **tables)


def leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_LEASES.format(str="STRING").replace("FROM comps", "FROM {comps}"), comps=sale_comps(spark, sf_dir))


def land_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_LAND.format(str="STRING").replace("FROM comps", "FROM {comps}"), comps=sale_comps(spark, sf_dir))
