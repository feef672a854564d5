"""Queries of the refinement operators over the sale comps."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import refine
from evidentia.plans.register import query
from evidentia.plans.scalars import DATE_SQL
from evidentia.sources.surrogate import COMPS_SQL, sale_comps

#: rank and num of the unified key of sale_date in DuckDB.
_KEY = f"""k AS (SELECT *, try_cast(sale_date AS DOUBLE) AS n, epoch({DATE_SQL.format(c='sale_date')}::TIMESTAMP) AS s FROM comps),
key AS (SELECT *, CASE WHEN coalesce(sale_date, '') = '' THEN 3 WHEN n IS NOT NULL THEN 0 WHEN s IS NOT NULL THEN 1 ELSE 2 END AS rank,
  CASE WHEN coalesce(sale_date, '') = '' THEN 0 WHEN n IS NOT NULL THEN n WHEN s IS NOT NULL THEN s ELSE 0 END::DOUBLE AS num FROM k)"""
_WITH = f"WITH {COMPS_SQL}, {_KEY}"
_EPOCH = "epoch(TIMESTAMP '{}')"


@query("q_ref17_sort_key", f"{_WITH} SELECT pos, rank, num FROM key")
def sort_key(spark, sf):
    key = refine.sort_key(F.col("sale_date"))
    return sale_comps(spark, sf).select("pos", key["rank"].alias("rank"), key["num"].alias("num"))


@query("q_ref1_filter_range", f"{_WITH} SELECT pos, sale_date FROM key WHERE rank >= 2 OR (num >= {_EPOCH.format('1996-01-01')} AND num <= {_EPOCH.format('1999-06-30')})")
def filter_range(spark, sf):
    return refine.filter_range(sale_comps(spark, sf), "sale_date", "1996-01-01", "1999-06-30").select("pos", "sale_date")


@query("q_ref1_filter_range_number", f"WITH {COMPS_SQL} SELECT pos, price_m FROM comps WHERE price_m IS NULL OR price_m BETWEEN 50 AND 120.5")
def filter_range_number(spark, sf):
    return refine.filter_range(sale_comps(spark, sf), "price_m", 50, 120.5).select("pos", "price_m")


@query(
    "q_ref2_filter_category",
    f"WITH {COMPS_SQL} SELECT pos, sale_type FROM comps WHERE NOT (sale_type <> '' AND contains(lower(sale_type), 'strata')) AND (sale_type = '' OR contains(lower(sale_type), 'stake') OR contains(lower(sale_type), 'whole'))",
)
def filter_category(spark, sf):
    return refine.filter_category(sale_comps(spark, sf), "sale_type", keep=["Stake", "whole"], remove=["STRATA"]).select("pos", "sale_type")


@query("q_ref3_filter_presence", f"WITH {COMPS_SQL} SELECT pos, 'present' AS kind FROM comps WHERE gfa_sf IS NOT NULL AND gfa_sf <> 9999 UNION ALL SELECT pos, 'missing' FROM comps WHERE gfa_sf IS NULL OR gfa_sf = 9999")
def filter_presence(spark, sf):
    comps = sale_comps(spark, sf)
    keep = lambda kind: refine.filter_presence(comps, "gfa_sf", kind).select("pos", F.lit(kind).alias("kind"))
    return keep("present").unionByName(keep("missing"))


@query("q_ref4_keep_top_n", f"WITH {COMPS_SQL} SELECT pos, price_m FROM comps ORDER BY price_m IS NULL DESC, price_m DESC, pos LIMIT 1600")
def keep_top(spark, sf):
    return refine.keep_top_n(sale_comps(spark, sf), "price_m", 1600).select("pos", "price_m")


@query("q_ref5_select_by_name", f"WITH {COMPS_SQL} SELECT pos, property_name FROM comps WHERE contains(lower(property_name), 'harbour tower 1') OR contains(lower(property_name), 'cedar')")
def by_name(spark, sf):
    return refine.select_by_name(sale_comps(spark, sf), "keep", ["Harbour Tower 1", "CEDAR"]).select("pos", "property_name")


@query("q_ref5_unmatched_names", "SELECT 'Nowhere House' AS name")
def unmatched(spark, sf):
    return refine.unmatched_names(sale_comps(spark, sf), ["Orchid", "Nowhere House"])


@query("q_ref6_select_by_judgement", f"WITH {COMPS_SQL} SELECT pos, property_name FROM comps WHERE lower(property_name) IN (SELECT lower(property_name) FROM comps WHERE pos % 97 = 0)")
def judgement(spark, sf):
    comps = sale_comps(spark, sf)
    verdicts = comps.where("pos % 97 = 0").select(F.upper("property_name").alias("name"), F.lit("close to the subject").alias("reason"))
    return refine.select_by_judgement(comps, "keep", verdicts).select("pos", "property_name")


@query("q_ref7_sort_records", f"{_WITH} SELECT pos, source, row_number() OVER (PARTITION BY source ORDER BY rank, num, CASE WHEN rank = 2 THEN lower(sale_date) ELSE '' END, pos) AS place FROM key")
def sort_records(spark, sf):
    return refine.sort_rank(sale_comps(spark, sf), "sale_date", ["source"], descending=False).select("pos", "source", F.col("place").cast("long"))


@query("q_ref8_filter_criterion", f"{_WITH} SELECT pos FROM key WHERE NOT (rank = 1 AND num < {_EPOCH.format('1998-01-01')})")
def by_criterion(spark, sf):
    return refine.remove_by_criterion(sale_comps(spark, sf), "sale_date", "<", "1998-01-01").select("pos")


@query("q_ref9_remove_by_name", f"WITH {COMPS_SQL} SELECT pos FROM comps WHERE NOT contains(lower(property_name), 'strata')")
def remove_by_name(spark, sf):
    return refine.select_by_name(sale_comps(spark, sf), "remove", ["Strata"]).select("pos")


@query("q_ref10_filter_numeric", f"WITH {COMPS_SQL} SELECT pos FROM comps WHERE price_m >= 150")
def numeric(spark, sf):
    return refine.numeric_positions(sale_comps(spark, sf), "price_m", "op >= please", 150)


@query("q_ref11_field_value", f"WITH {COMPS_SQL} SELECT pos FROM comps WHERE contains(lower(land_zoning), 'business')")
def field_value(spark, sf):
    return refine.field_value_positions(sale_comps(spark, sf), "land_zoning", " Business ")


@query("q_ref12_by_marker", f"WITH {COMPS_SQL}, m AS (SELECT pos, row_number() OVER (PARTITION BY source ORDER BY relevance_score DESC, pos) AS marker FROM comps) SELECT pos FROM m WHERE marker IN (1, 5, 9)")
def by_marker(spark, sf):
    from evidentia.operators.evidence import with_markers

    return refine.marker_positions(with_markers(sale_comps(spark, sf), ["source"]), [1, 5, 9])


@query("q_ref13_by_name_positions", f"WITH {COMPS_SQL} SELECT pos FROM comps WHERE contains(lower(property_name), 'marina')")
def name_positions(spark, sf):
    return refine.select_by_name(sale_comps(spark, sf), "keep", ["marina"]).select("pos")


@query(
    "q_ref14_slices",
    f"WITH {COMPS_SQL}, r AS (SELECT pos, source, row_number() OVER (PARTITION BY source ORDER BY pos) AS u, row_number() OVER (PARTITION BY source ORDER BY pos DESC) AS d FROM comps) SELECT pos, source FROM r WHERE u <= 3 OR d <= 2",
)
def slices(spark, sf):
    return refine.slice_positions(sale_comps(spark, sf), "source", first=3, last=2).select("pos", "source")


@query(
    "q_ref15_compute_stats",
    f"""WITH {COMPS_SQL}, g AS (SELECT source, list_sort(list(price_m)) AS v, avg(price_m) AS m, stddev_pop(price_m) AS sd FROM comps WHERE price_m IS NOT NULL GROUP BY source)
SELECT source, len(v)::BIGINT AS count, round(m, 3) AS mean, round(sd, 3) AS std, round(v[1], 3) AS min, round(v[len(v) // 4 + 1], 3) AS p25, round(v[len(v) // 2 + 1], 3) AS median, round(v[3 * len(v) // 4 + 1], 3) AS p75, round(v[len(v)], 3) AS max FROM g""",
)
def stats(spark, sf):
    return refine.compute_stats(sale_comps(spark, sf), "price_m", ["source"])


@query("q_ref16_field_values", f"WITH {COMPS_SQL} SELECT pos, coalesce(property_name, '') AS name, gfa_sf AS value FROM comps")
def values(spark, sf):
    return sale_comps(spark, sf).select("pos", F.coalesce("property_name", F.lit("")).alias("name"), F.col("gfa_sf").alias("value"))


@query(
    "q_ref18_field_types",
    f"""{_WITH}, d AS (SELECT count(*) FILTER (rank < 3) AS seen, count(*) FILTER (rank = 0) AS nums, count(*) FILTER (rank = 1) AS dates FROM key)
SELECT 'sale_date' AS field, CASE WHEN seen = 0 THEN 'empty' WHEN nums >= greatest(1, seen // 2) THEN 'numeric' WHEN dates >= greatest(1, seen // 2) THEN 'date' ELSE 'text' END AS type FROM d
UNION ALL SELECT 'price_m', 'numeric' UNION ALL SELECT 'property_name', 'text'""",
)
def types(spark, sf):
    return refine.field_types(sale_comps(spark, sf), ["sale_date", "price_m", "property_name"])


@query("q_ref19_keep_ids", f"WITH {COMPS_SQL} SELECT pos, source FROM comps WHERE pos IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def ids(spark, sf):
    listed = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("pos"))
    return refine.keep_ids(sale_comps(spark, sf), listed).select("pos", "source")


@query(
    "q_ref20_call_sequence",
    f"{_WITH} SELECT pos FROM key WHERE (rank >= 2 OR num >= {_EPOCH.format('1996-01-01')}) AND (sale_type = '' OR contains(lower(sale_type), 'stake')) AND gfa_sf IS NOT NULL AND gfa_sf <> 9999",
)
def calls(spark, sf):
    plan = [
        ("filter_range", {"field": "sale_date", "keep_min": "1996-01-01"}),
        ("filter_category", {"field": "sale_type", "keep": ["stake"]}),
        ("filter_range", {"field": "no_such_field", "keep_min": 1}),
        ("filter_presence", {"field": "gfa_sf"}),
    ]
    return refine.apply_calls(sale_comps(spark, sf), plan).select("pos")
