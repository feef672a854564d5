"""Queries of output tables, verdicts, edits, ladders and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import evidence as ev
from evidentia.operators import report as rp
from evidentia.plans.register import query
from evidentia.sources.surrogate import COMPS_SQL, LAND_SQL, LEASES_SQL, land_sales, leases, sale_comps


@query("q_sch1_snk1_sales_output", f"WITH {COMPS_SQL} SELECT row_number() OVER (PARTITION BY source ORDER BY relevance_score DESC, pos) AS marker, property_name AS property, sale_date, gfa_sf, price_m, NULL::BIGINT AS price_psf, npi_yield, NULL::DOUBLE AS adj_yield FROM comps")
def sales_output(spark, sf):
    marked = ev.with_markers(sale_comps(spark, sf), ["source"]).withColumnRenamed("property_name", "property")
    return rp.to_output(marked, "sales", currency="USD", price_unit="B")


@query("q_sch2_snk2_rent_output", f"WITH {LEASES_SQL} SELECT pos AS marker, property_name AS property, lease_date, CAST(nla_sf AS DOUBLE) AS nla, asking_rent, eff_rent FROM leases")
def rent_output(spark, sf):
    out = leases(spark, sf).select(F.col("pos").alias("marker"), F.col("property_name").alias("property"), "lease_date", F.col("nla_sf").alias("nla"), "asking_rent", "eff_rent")
    return out.withColumn("nla", F.col("nla").cast("double"))


@query("q_sch3_snk3_land_output", f"WITH {LAND_SQL} SELECT pos AS marker, site_name AS property, launch_date, CAST(tenure_yrs AS BIGINT) AS tenure_yrs, max_gfa_sf, price_m, NULL::BIGINT AS psf_ppr FROM land")
def land_output(spark, sf):
    return rp.to_output(land_sales(spark, sf).withColumnsRenamed({"pos": "marker", "site_name": "property"}), "land", area_unit="SQM")


@query("q_row7_shown_cells", f"WITH {COMPS_SQL} SELECT pos, coalesce(nullif(address, ''), '—') AS address, coalesce(nullif(sale_type, ''), '—') AS sale_type FROM comps")
def cells(spark, sf):
    return sale_comps(spark, sf).select("pos", rp.shown(F.col("address")).alias("address"), rp.shown(F.col("sale_type")).alias("sale_type"))


@query("q_row1_sections", f"WITH {COMPS_SQL} SELECT 0 AS section_ord, 'subject' AS section, property_name, price_m FROM comps WHERE pos = (SELECT min(pos) FROM comps) UNION ALL SELECT 1, 'comp', property_name, price_m FROM comps WHERE price_m > 100 UNION ALL SELECT 2, 'average', NULL, avg(price_m) FILTER (price_m > 0) FROM comps WHERE price_m > 100")
def sections(spark, sf):
    comps = sale_comps(spark, sf).select("pos", "property_name", "price_m")
    first = comps.join(comps.agg(F.min("pos").alias("pos")), "pos", "left_semi").drop("pos")
    chosen = comps.where("price_m > 100").drop("pos")
    average = ev.positive_averages(chosen, ["price_m"]).withColumnRenamed("avg_price_m", "price_m")
    return rp.sections(first, chosen, average).select("section_ord", "section", "property_name", "price_m")


@query("q_jsn4_row12_verdicts", f"WITH {COMPS_SQL} SELECT pos, CASE WHEN pos % 3 = 0 THEN 'Office' ELSE '' END AS asset_type, CASE WHEN pos % 3 = 0 THEN 9 ELSE 5 END AS relevance FROM comps")
def verdicts(spark, sf):
    comps = sale_comps(spark, sf)
    v = comps.where("pos % 3 = 0").select("pos", F.lit("Office").alias("asset_type"), F.lit(9).alias("relevance"))
    return rp.attach_verdicts(comps, v, {"asset_type": "", "relevance": 5}).select("pos", "asset_type", "relevance")


@query(
    "q_cal18_edit_guard",
    f"""WITH {COMPS_SQL} SELECT pos, CASE pos % 5 WHEN 0 THEN 'property_name' WHEN 1 THEN 'colour' ELSE 'gfa_sf' END AS field,
  CASE pos % 5 WHEN 0 THEN 'locked' WHEN 1 THEN 'unknown field' WHEN 2 THEN 'swap' WHEN 3 THEN 'no evidence' ELSE 'applied' END AS verdict FROM comps WHERE gfa_sf IS NOT NULL""",
)
def edit_guard(spark, sf):
    comps = sale_comps(spark, sf).where("gfa_sf IS NOT NULL").select("pos", "property_name", "gfa_sf", F.lit(77).alias("floors"), F.concat(F.lit("area of 123,456 sf and 77 floors in "), "property_name").alias("source_text"))
    m = F.col("pos") % 5
    edits = comps.select(
        "pos", F.when(m == 0, "property_name").when(m == 1, "colour").otherwise("gfa_sf").alias("field"), F.when(m == 2, "77").when(m == 3, "4242").otherwise("123456").alias("new_value"),
        F.when(m == 3, "area of 4242 sf").otherwise("area of 123,456 sf").alias("evidence"),
    )
    return rp.guard_edits(comps, edits, ["gfa_sf", "floors"])


@query("q_prv2_tiers", f"WITH {COMPS_SQL} SELECT CASE pos % 3 WHEN 0 THEN 'cell' WHEN 1 THEN 'page' ELSE 'none' END AS tier, count(*) AS n FROM comps GROUP BY ALL")
def tiers(spark, sf):
    m = F.col("pos") % 3
    prov = F.when(m == 0, F.create_map(F.lit("gfa_sf"), F.lit("A1")))
    return sale_comps(spark, sf).groupBy(rp.provenance_tier(prov, F.when(m < 2, 1)).alias("tier")).agg(F.count("*").alias("n"))


@query("q_prv4_verbatim_fields", f"WITH {COMPS_SQL} SELECT pos, CASE WHEN pos % 2 = 0 THEN 'area' ELSE 'area,price' END AS fields FROM comps")
def verbatim(spark, sf):
    values = F.create_map(F.lit("area"), F.lit("1,200"), F.lit("price"), F.lit("55.5"))
    page = F.when(F.col("pos") % 2 == 0, "about 1200 sf").otherwise("about 1,200 sf for 55.5")
    return sale_comps(spark, sf).select("pos", F.array_join(F.array_sort(F.map_keys(rp.kept_verbatim(values, page))), ",").alias("fields"))


@query("q_prv9_delete_recolour", f"WITH {COMPS_SQL} SELECT pos, CASE WHEN relevance_score < 3 THEN 'grey' ELSE 'red' END AS colour FROM comps WHERE relevance_score <> 0")
def recolour(spark, sf):
    return sale_comps(spark, sf).where("relevance_score <> 0").select("pos", F.when(F.col("relevance_score") < 3, "grey").otherwise("red").alias("colour"))


@query("q_prv11_upload_cache", "SELECT source, n_chars, min(doc_id) AS doc_id FROM documents GROUP BY source, n_chars")
def upload_cache(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").groupBy("source", "n_chars").agg(F.min("doc_id").alias("doc_id"))


@query(
    "q_cal21_ladder",
    f"""WITH {COMPS_SQL}, c AS (SELECT pos, country, CAST(pos % 4 AS INTEGER) AS tier FROM comps), n AS (SELECT country, tier, count(*) AS n FROM c GROUP BY ALL),
o AS (SELECT country, tier, coalesce(sum(n) OVER (PARTITION BY country ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM n) SELECT pos, c.country, c.tier FROM c JOIN o ON c.country = o.country AND c.tier = o.tier WHERE b < 200""",
)
def ladder(spark, sf):
    c = sale_comps(spark, sf).select("pos", "country", (F.col("pos") % 4).cast("int").alias("tier"))
    return rp.ladder(c, 200, "country").select("pos", "country", "tier")


@query("q_cal20_query_text", f"WITH {COMPS_SQL} SELECT pos, CASE pos % 3 WHEN 0 THEN 'office transactions near ' || country || ' 2025 OR 2024' WHEN 1 THEN 'office transactions in ' || country || ' 2025 OR 2024' ELSE 'office transactions nationwide 2025 OR 2024' END AS q FROM comps")
def query_text(spark, sf):
    tier = F.when(F.col("pos") % 3 == 0, "proximity").when(F.col("pos") % 3 == 1, "city").otherwise("country")
    return sale_comps(spark, sf).select("pos", rp.query_text(F.lit("office"), F.col("country"), tier, F.lit("2025 OR 2024")).alias("q"))


@query("q_cal23_srt4_plan", f"WITH {COMPS_SQL}, f AS (SELECT pos AS file, country AS deal, CASE pos % 4 WHEN 0 THEN 'land' WHEN 1 THEN 'rent' WHEN 2 THEN 'sales' ELSE 'unknown' END AS type FROM comps) SELECT file, type, deal, CAST(row_number() OVER (PARTITION BY deal ORDER BY CASE type WHEN 'rent' THEN 1 WHEN 'sales' THEN 2 WHEN 'land' THEN 3 ELSE 99 END, file) AS INTEGER) AS step FROM f")
def plan(spark, sf):
    kind = F.when(F.col("pos") % 4 == 0, "land").when(F.col("pos") % 4 == 1, "rent").when(F.col("pos") % 4 == 2, "sales").otherwise("brochure")
    return rp.plan_steps(sale_comps(spark, sf).select(F.col("pos").alias("file"), F.col("country").alias("deal"), kind.alias("type")))


@query("q_jon13_cascade", f"WITH {COMPS_SQL} SELECT pos, CASE WHEN pos % 4 = 0 THEN 'pdf' WHEN pos % 3 = 0 THEN 'web' WHEN pos % 5 = 0 THEN 'deal' ELSE 'unverified' END AS citation FROM comps")
def cascade(spark, sf):
    hit = lambda n: F.when(F.col("pos") % n == 0, 1)
    return sale_comps(spark, sf).select("pos", rp.citation_cascade(hit(4), hit(3), hit(5)).alias("citation"))


@query("q_str5_str7_geocode_queries", f"WITH {COMPS_SQL} SELECT pos, CASE WHEN address IS NULL THEN property_name || ', ' || country || '|' || property_name ELSE address || '|' || address || ', ' || country || '|' || property_name || ', ' || country || '|' || property_name END AS queries FROM comps WHERE address IS NOT NULL")
def geocode_queries(spark, sf):
    q = rp.address_queries(F.col("property_name"), F.col("address"), F.col("country"))
    return sale_comps(spark, sf).where("address IS NOT NULL").select("pos", F.array_join(q, "|").alias("queries"))


@query("q_str6_real_address", f"WITH {COMPS_SQL} SELECT pos, address IS NOT NULL AS real FROM comps")
def real_address(spark, sf):
    return sale_comps(spark, sf).select("pos", F.coalesce(rp.looks_like_address(F.col("address")), F.lit(False)).alias("real"))


@query("q_snk12_snk13_preview_merge", f"WITH {COMPS_SQL}, e AS (SELECT pos, price_m * 2 AS price_m FROM comps WHERE pos % 5 = 0) SELECT coalesce(c.pos, e.pos) AS pos, coalesce(e.price_m, c.price_m) AS price_m FROM comps c FULL JOIN e ON c.pos = e.pos")
def preview_merge(spark, sf):
    comps = sale_comps(spark, sf).select("pos", "price_m")
    edits = comps.where("pos % 5 = 0").select(F.col("pos").alias("epos"), (F.col("price_m") * 2).alias("eprice"))
    return comps.join(edits, F.col("pos") == F.col("epos"), "full").select(F.coalesce("pos", "epos").alias("pos"), F.coalesce("eprice", "price_m").alias("price_m"))
