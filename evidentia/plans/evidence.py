"""Queries of the record operators: gates, metrics, merging, ranking, averages, location."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidentia.functions import geo, lease, num, text
from evidentia.operators import evidence as ev
from evidentia.operators import location as loc
from evidentia.plans.register import query
from evidentia.sources.surrogate import COMPS_SQL, LAND_SQL, LEASES_SQL, land_sales, leases, sale_comps

_STAKE = "CASE WHEN sale_type IN ('Whole building', 'Block sale') THEN 1.0 WHEN sale_type = '49% stake' THEN 0.49 WHEN sale_type LIKE '%1/3%' THEN 1.0::DOUBLE / 3 ELSE 1.0 END::DOUBLE"
SUBJECT = {"lon": 103.85, "lat": 1.285, "years": 60.0, "name": "Harbour Tower"}
HAVERSINE = "2 * 6371.0 * asin(sqrt(pow(sin((radians({b}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2)))"


def km_sql(lon1, lat1, lon2, lat2) -> str:
    return HAVERSINE.format(a=lat1, b=lat2, c=lon1, d=lon2)


_SUBJECT_KM = km_sql("lon", "lat", SUBJECT["lon"], SUBJECT["lat"])
_METRICS = f"""{lease.FACTOR_SQL}, staked AS (SELECT *, {_STAKE} AS stake, {lease.factor_sql('remaining_yrs')} AS own_factor, {lease.factor_sql('60.0')} AS subject_factor FROM comps),
metrics AS (SELECT *, round(price_m / stake * 1000000 / gfa_sf, 0) AS price_psf, coalesce(reported_adj::DOUBLE, npi_yield::DOUBLE * own_factor / subject_factor) AS adj_yield FROM staked)"""


@query(
    "q_sales_table",
    f"""WITH {COMPS_SQL}, {_METRICS}, placed AS (SELECT *, coalesce({_SUBJECT_KM}, 9999.0) AS distance_km FROM metrics WHERE coalesce(price_m, 0) <> 0 AND NOT contains(lower(property_name), 'harbour')),
top AS (SELECT * FROM placed ORDER BY relevance_score DESC, pos LIMIT 200), marked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY relevance_score DESC, pos) AS marker FROM top)
SELECT 'comp' AS section, source, CAST(marker AS INTEGER) AS marker, property_name, price_m, price_psf, adj_yield, distance_km FROM marked
UNION ALL SELECT 'average', source, NULL, 'Average', avg(price_m) FILTER (price_m > 0), avg(price_psf) FILTER (price_psf > 0), avg(adj_yield) FILTER (adj_yield > 0), NULL FROM marked GROUP BY source""",
)
def sales_table(spark, sf):
    """Gate, metrics, lease factor, distance, rank and trim, markers, average rows."""
    gated = ev.row_gate(sale_comps(spark, sf), SUBJECT["name"], share=0.5)
    placed = ev.with_distance(ev.sale_metrics(gated, SUBJECT["years"]), SUBJECT["lon"], SUBJECT["lat"])
    marked = ev.with_markers(ev.rank_and_trim(placed, 200), ["source"])
    shown = ["price_m", "price_psf", "adj_yield"]
    rows = marked.select(F.lit("comp").alias("section"), "source", "marker", "property_name", *shown, "distance_km")
    average = ev.positive_averages(marked, shown, ["source"]).select(
        F.lit("average").alias("section"), "source", F.lit(None).cast("int").alias("marker"), F.lit("Average").alias("property_name"), *[F.col(f"avg_{c}").alias(c) for c in shown], F.lit(None).cast("double").alias("distance_km")
    )
    return rows.unionByName(average)


@query("q_cal2_sale_metrics", f"WITH {COMPS_SQL}, {_METRICS} SELECT pos, price_psf, adj_yield FROM metrics")
def metrics(spark, sf):
    return ev.sale_metrics(sale_comps(spark, sf), SUBJECT["years"]).select("pos", "price_psf", "adj_yield")


@query("q_cal1_lease_factor", f"WITH {COMPS_SQL}, {lease.FACTOR_SQL} SELECT pos, {lease.factor_sql('remaining_yrs')} AS factor FROM comps")
def factor(spark, sf):
    return lease.with_factor(sale_comps(spark, sf), "remaining_yrs", "factor").select("pos", "factor")


@query("q_cal4_effective_rent", f"WITH {LEASES_SQL} SELECT pos, coalesce(eff_rent::DOUBLE, round(asking_rent * (term_yrs * 12 - rent_free_mths) / (term_yrs * 12), 2)) AS rent FROM leases")
def eff_rent(spark, sf):
    return leases(spark, sf).select("pos", ev.effective_rent(F.col("asking_rent").cast("double"), F.col("eff_rent").cast("double"), F.col("term_yrs"), F.col("rent_free_mths")).alias("rent"))


@query(
    "q_cal5_cal6_land_metrics",
    f"""WITH {LAND_SQL}, {lease.FACTOR_SQL}, m AS (SELECT pos, round(price_m * 1000000 / max_gfa_sf, 0) AS psf_ppr, {lease.factor_sql('tenure_yrs')} AS f, {lease.factor_sql('60.0')} AS g FROM land)
SELECT pos, psf_ppr, round(psf_ppr * g / f, 0) AS adj_psf FROM m""",
)
def land(spark, sf):
    return ev.land_metrics(land_sales(spark, sf), 60.0).select("pos", "psf_ppr", "adj_psf")


@query(
    "q_cal7_global_unit_price",
    f"WITH {LAND_SQL} SELECT pos, CASE WHEN pos % 10 = 0 THEN 77.0 ELSE price_m * CASE WHEN pos % 3 = 0 THEN 1e9 ELSE 1e6 END / coalesce(max_gfa_sf, site_area_sf) END::DOUBLE AS unit_price FROM land",
)
def unit_price(spark, sf):
    reported = F.when(F.col("pos") % 10 == 0, 77.0)
    area = F.coalesce("max_gfa_sf", "site_area_sf").cast("double")
    return land_sales(spark, sf).select("pos", ev.global_unit_price(F.col("price_m"), F.when(F.col("pos") % 3 == 0, "B").otherwise("M"), area, reported).alias("unit_price"))


@query("q_spa1_distance", f"WITH {COMPS_SQL} SELECT pos, coalesce({_SUBJECT_KM}, 9999.0) AS km FROM comps")
def distance(spark, sf):
    return ev.with_distance(sale_comps(spark, sf), SUBJECT["lon"], SUBJECT["lat"]).select("pos", F.col("distance_km").alias("km"))


@query("q_flt1_flt3_row_gate", f"WITH {COMPS_SQL} SELECT pos FROM comps WHERE coalesce(price_m, 0) <> 0 AND NOT contains(lower(property_name), 'orchid')")
def gate(spark, sf):
    return ev.row_gate(sale_comps(spark, sf), "Orchid Plaza").select("pos")


@query("q_flt4_real_candidate", f"WITH {COMPS_SQL} SELECT pos FROM comps WHERE gfa_sf IS NOT NULL OR price_m IS NOT NULL")
def candidate(spark, sf):
    return ev.real_candidate(sale_comps(spark, sf), ["gfa_sf", "price_m"]).select("pos")


_GUARD_SQL = "CASE " + " ".join(
    f"WHEN a = '{a}' THEN regexp_matches(d, '{'|'.join(ev.ACCEPT[a])}') OR NOT regexp_matches(d, '{'|'.join(ev.REJECT[a])}')" for a in ev.ACCEPT
) + " END"


@query(
    "q_flt7_asset_type",
    f"""WITH {COMPS_SQL}, t AS (SELECT pos, lower(concat_ws(' ', land_zoning, sale_type, property_name, address)) AS d FROM comps)
SELECT a AS asset, pos FROM t, (VALUES {', '.join(f"('{a}')" for a in ev.ACCEPT)}) k(a) WHERE {_GUARD_SQL}""",
)
def asset_type(spark, sf):
    comps = sale_comps(spark, sf)
    fields = [F.col(f) for f in ("land_zoning", "sale_type", "property_name", "address")]
    return comps.select("pos", F.explode(F.array_compact(F.array(*[F.when(ev.asset_type_matches(a, *fields), a) for a in ev.ACCEPT]))).alias("asset")).select("asset", "pos")


@query("q_flt8_flt9_country_strata", f"WITH {COMPS_SQL} SELECT pos FROM comps WHERE contains(country, 'N1') AND NOT contains(property_name, 'Strata')")
def country(spark, sf):
    wanted = F.array(F.lit("N1"), F.lit("N12"))
    return sale_comps(spark, sf).where(((F.coalesce("country", F.lit("")) == "") | F.exists(wanted, lambda t: F.col("country").contains(t))) & ~F.col("property_name").contains("Strata")).select("pos")


@query("q_flt10_recency", f"WITH {COMPS_SQL}, t AS (SELECT pos, CASE WHEN lower(sale_date) LIKE '%q%' THEN CAST(right(sale_date, 4) AS INTEGER) WHEN sale_date LIKE '%/%' THEN CAST(sale_date[7:10] AS INTEGER) WHEN regexp_matches(sale_date, '^[A-Z][a-z]{{2}} ') THEN CAST(sale_date[5:8] AS INTEGER) WHEN regexp_matches(sale_date, '^\\d{{4}}') THEN CAST(sale_date[1:4] AS INTEGER) END AS y FROM comps) SELECT pos FROM t WHERE y IS NULL OR y >= 1999")
def recency(spark, sf):
    from evidentia.functions.dates import months_ago

    return sale_comps(spark, sf).where(F.coalesce(months_ago(F.col("sale_date"), 2000, 1), F.lit(0)) <= 12).select("pos")


@query("q_flt11_radius", f"WITH {COMPS_SQL} SELECT pos FROM comps WHERE {_SUBJECT_KM} <= 10")
def radius(spark, sf):
    return sale_comps(spark, sf).where(geo.haversine_km(F.col("lon"), F.col("lat"), F.lit(SUBJECT["lon"]), F.lit(SUBJECT["lat"])) <= 10).select("pos")


@query("q_flt17_flt18_places", f"WITH {COMPS_SQL} SELECT pos, coalesce(lon BETWEEN 103.55 AND 104.15 AND lat BETWEEN 1.13 AND 1.5, false) AS in_box, sqrt(pow((lon - 103.8) * 111.32 * cos(radians(1.35)), 2) + pow((lat - 1.35) * 110.574, 2)) <= 1.5 AS near_centre FROM comps")
def places(spark, sf):
    return sale_comps(spark, sf).select("pos", geo.in_box(F.col("lon"), F.col("lat")).alias("in_box"), geo.near_point(F.col("lon"), F.col("lat"), F.lit(103.8), F.lit(1.35)).alias("near_centre"))


@query(
    "q_flt20_cal17_auto_flags",
    f"""WITH {COMPS_SQL}, r AS (SELECT pos, gfa_sf, price_m, npi_yield, price_m * 1000000 / (gfa_sf * 1000.0) AS ratio FROM comps)
SELECT pos, concat_ws('; ', CASE WHEN gfa_sf < 500 OR gfa_sf > 5000000 THEN 'area out of range' END, CASE WHEN price_m < 0.1 OR price_m > 10000 THEN 'price out of range' END,
  CASE WHEN npi_yield < 0.005 OR npi_yield > 0.2 THEN 'yield out of range' END, CASE WHEN ratio >= 3 OR ratio <= 1.0::DOUBLE / 3 THEN 'price does not fit area' END) AS flags FROM r""",
)
def flags(spark, sf):
    f = ev.auto_flags(F.col("gfa_sf").cast("double"), F.col("price_m"), F.lit(1000.0), F.col("npi_yield").cast("double"))
    return sale_comps(spark, sf).select("pos", F.array_join(f, "; ").alias("flags"))


_PAIR = f"a.pos < b.pos AND a.source <> b.source AND a.price_m > 0 AND b.price_m > 0 AND a.property_name = b.property_name AND {km_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= "


@query(
    "q_jon4_ded4_conflicts",
    f"""WITH {COMPS_SQL}, p AS (SELECT a.pos AS i, b.pos AS j, a.source AS si, b.source AS sj FROM comps a JOIN comps b ON {_PAIR} 0.1 AND abs(a.price_m - b.price_m) > 0.03 * greatest(a.price_m, b.price_m)),
e AS (SELECT i AS pos, j AS other, sj AS src, i, j FROM p UNION ALL SELECT j, i, si, i, j FROM p)
SELECT pos, arg_max(other, (i, j)) AS conflicts_with, arg_max(src, (i, j)) AS conflict_source FROM e GROUP BY pos""",
)
def conflicts(spark, sf):
    return ev.conflict_flags(sale_comps(spark, sf))


@query("q_ded3_cross_source_merge")
def merge(spark, sf):
    return ev.merge_cross_source(sale_comps(spark, sf), ["property_name", "address", "price_m", "gfa_sf", "npi_yield", "remaining_yrs"])


@query(
    "q_jon5_same_building",
    f"""WITH {COMPS_SQL} SELECT p.pos, min(r.pos) AS same_as FROM comps p JOIN comps r ON r.pos < p.pos AND r.price_m > 0 AND p.price_m > 0
  AND {km_sql('r.lon', 'r.lat', 'p.lon', 'p.lat')} <= 0.075 AND abs(r.price_m - p.price_m) <= 0.05 * greatest(r.price_m, p.price_m) WHERE p.pos % 5 = 0 GROUP BY p.pos""",
)
def same_building(spark, sf):
    comps = sale_comps(spark, sf)
    return ev.same_building(comps, comps.where("pos % 5 = 0"))


@query("q_ded1_first_by_key", f"WITH {COMPS_SQL} SELECT min(pos) AS pos FROM comps GROUP BY regexp_replace(lower(property_name), '\\W+', '', 'g')[1:24]")
def first_by_key(spark, sf):
    return ev.first_by_key(sale_comps(spark, sf), F.substring(F.regexp_replace(F.lower("property_name"), r"\W+", ""), 1, 24)).select("pos")


@query("q_jon1_jon2_write_back", f"WITH {COMPS_SQL}, g AS (SELECT lower(trim(property_name)) AS k, arg_max(price_m, pos) AS latest FROM comps WHERE price_m IS NOT NULL GROUP BY 1) SELECT pos, coalesce(latest, price_m) AS price_m FROM comps JOIN g ON lower(trim(property_name)) = k")
def write_back(spark, sf):
    comps = sale_comps(spark, sf).withColumn("k", F.lower(F.trim("property_name")))
    latest = comps.where("price_m IS NOT NULL").groupBy("k").agg(F.max_by("price_m", "pos").alias("latest"))
    return comps.join(latest, "k").select("pos", F.coalesce("latest", "price_m").alias("price_m"))


@query("q_jon15_dimension", "SELECT c_custkey, coalesce(n_name, 'USD') AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def dimension(spark, sf):
    customer, nation = spark.read.parquet(f"{sf}/customer.parquet"), spark.read.parquet(f"{sf}/nation.parquet")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_name", F.lit("USD")).alias("nation"))


@query("q_jon16_semi_anti", "SELECT c_custkey, 'with orders' AS kind FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'without' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def semi_anti(spark, sf):
    customer, orders = spark.read.parquet(f"{sf}/customer.parquet"), spark.read.parquet(f"{sf}/orders.parquet")
    on = F.col("c_custkey") == F.col("o_custkey")
    side = lambda how, name: customer.join(orders, on, how).select("c_custkey", F.lit(name).alias("kind"))
    return side("left_semi", "with orders").unionByName(side("left_anti", "without"))


@query(
    "q_jon17_gold_diff",
    f"""WITH {COMPS_SQL}, gold AS (SELECT pos, price_m FROM comps WHERE pos % 2 = 0), got AS (SELECT pos, price_m * CASE WHEN pos % 10 = 0 THEN 2 ELSE 1 END AS price_m FROM comps WHERE pos % 3 = 0)
SELECT coalesce(gold.pos, got.pos) AS pos, CASE WHEN got.pos IS NULL THEN 'missing' WHEN gold.pos IS NULL THEN 'extra' WHEN gold.price_m IS NOT DISTINCT FROM got.price_m THEN 'same' ELSE 'different' END AS verdict FROM gold FULL JOIN got ON gold.pos = got.pos""",
)
def gold_diff(spark, sf):
    comps = sale_comps(spark, sf)
    gold = comps.where("pos % 2 = 0").select(F.col("pos").alias("g"), F.col("price_m").alias("gp"))
    got = comps.where("pos % 3 = 0").select(F.col("pos").alias("t"), (F.col("price_m") * F.when(F.col("pos") % 10 == 0, 2).otherwise(1)).alias("tp"))
    verdict = F.when(F.col("t").isNull(), "missing").when(F.col("g").isNull(), "extra").when(F.col("gp").eqNullSafe(F.col("tp")), "same").otherwise("different")
    return gold.join(got, F.col("g") == F.col("t"), "full").select(F.coalesce("g", "t").alias("pos"), verdict.alias("verdict"))


@query("q_agg1_averages", f"WITH {COMPS_SQL} SELECT source, avg(price_m) FILTER (price_m > 0) AS avg_price_m, avg(npi_yield::DOUBLE) FILTER (npi_yield > 0) AS avg_npi_yield FROM comps GROUP BY source")
def averages(spark, sf):
    return ev.positive_averages(sale_comps(spark, sf).withColumn("npi_yield", F.col("npi_yield").cast("double")), ["price_m", "npi_yield"], ["source"])


@query("q_agg2_rent_averages", f"WITH {LEASES_SQL} SELECT source, avg(asking_rent::DOUBLE) FILTER (asking_rent > 0) AS avg_asking_rent, avg(eff_rent::DOUBLE) FILTER (eff_rent > 0) AS avg_eff_rent FROM leases GROUP BY source")
def rent_averages(spark, sf):
    rows = leases(spark, sf).withColumn("asking_rent", F.col("asking_rent").cast("double")).withColumn("eff_rent", F.col("eff_rent").cast("double"))
    return ev.positive_averages(rows, ["asking_rent", "eff_rent"], ["source"])


@query("q_agg3_agg4_land_averages", f"WITH {LAND_SQL} SELECT land_zoning, avg(tenure_yrs) FILTER (tenure_yrs > 0) AS avg_tenure_yrs, avg(price_m) FILTER (price_m > 0) AS avg_price_m, avg(max_gfa_sf) FILTER (max_gfa_sf > 0) AS avg_max_gfa_sf FROM land GROUP BY land_zoning")
def land_averages(spark, sf):
    return ev.positive_averages(land_sales(spark, sf), ["tenure_yrs", "price_m", "max_gfa_sf"], ["land_zoning"])


@query("q_agg5_preview_average", f"WITH {COMPS_SQL} SELECT source, avg(try_cast(replace(format('{{:,}}', gfa_sf), ',', '') AS DOUBLE)) AS avg_area FROM comps GROUP BY source")
def preview_average(spark, sf):
    shown = F.format_number(F.col("gfa_sf"), 0)
    return sale_comps(spark, sf).groupBy("source").agg(F.avg(num.grid_parse(shown)).alias("avg_area"))


@query(
    "q_agg6_scorecard",
    f"""WITH {COMPS_SQL}, a AS (SELECT source, count(*) AS n, count(*) FILTER (price_m IS NOT NULL) AS n_valid, count(*) FILTER (price_m IS NOT NULL AND gfa_sf IS NOT NULL) AS g, bool_or(price_m > 10000) AS hard FROM comps GROUP BY source),
b AS (SELECT *, n_valid::DOUBLE / n AS coverage, coalesce(g::DOUBLE / n_valid, 0) AS pct_grounded FROM a), c AS (SELECT *, round(greatest(0, 0.5::DOUBLE * coverage + 0.5::DOUBLE * pct_grounded - 0.2::DOUBLE * CASE WHEN hard THEN 1 ELSE 0 END), 3) AS confidence FROM b)
SELECT source, n_valid, coverage, pct_grounded, confidence, confidence >= 0.6 AS ok FROM c""",
)
def scorecard(spark, sf):
    rows = sale_comps(spark, sf).select("source", F.col("price_m").isNotNull().alias("valid"), F.col("gfa_sf").isNotNull().alias("grounded"), (F.col("price_m") > 10000).alias("hard"))
    return ev.scorecard(rows, ["source"])


@query("q_agg10_min_marker", f"WITH {LEASES_SQL} SELECT pos, min(pos) OVER (PARTITION BY property_name) AS group_marker, pos = min(pos) OVER (PARTITION BY property_name) AS is_primary FROM leases")
def min_marker(spark, sf):
    w = Window.partitionBy("property_name")
    return leases(spark, sf).select("pos", F.min("pos").over(w).alias("group_marker"), (F.col("pos") == F.min("pos").over(w)).alias("is_primary"))


@query("q_agg11_agg13_units_completeness", f"WITH {COMPS_SQL} SELECT source, CASE WHEN bool_or(price_m >= 400) THEN 'B' ELSE 'M' END AS unit, sum((CASE WHEN address IS NULL THEN 0 ELSE 1 END) + (CASE WHEN price_m IS NULL THEN 0 ELSE 1 END) + (CASE WHEN gfa_sf IS NULL THEN 0 ELSE 1 END))::BIGINT AS filled FROM comps GROUP BY source")
def units(spark, sf):
    return sale_comps(spark, sf).groupBy("source").agg(F.when(F.bool_or(F.col("price_m") >= 400), "B").otherwise("M").alias("unit"), F.sum(ev.completeness(["address", "price_m", "gfa_sf"])).alias("filled"))


@query("q_agg15_agg20_sources", f"WITH {COMPS_SQL} SELECT property_name, count(*) AS n, array_to_string(list_sort(list_distinct(list(source))), '+') AS sources FROM comps GROUP BY property_name")
def sources(spark, sf):
    return sale_comps(spark, sf).groupBy("property_name").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"))


@query("q_agg16_fill_rates", f"WITH {COMPS_SQL} SELECT 'address' AS field, avg(CASE WHEN address IS NULL THEN 0.0 ELSE 1.0 END)::DOUBLE AS fill, avg(CASE WHEN regexp_matches(coalesce(address, ''), '\\d') THEN 1.0 ELSE 0.0 END)::DOUBLE AS digits FROM comps UNION ALL SELECT 'sale_date', avg(CASE WHEN coalesce(sale_date, '') = '' THEN 0.0 ELSE 1.0 END)::DOUBLE, avg(CASE WHEN regexp_matches(coalesce(sale_date, ''), '\\d') THEN 1.0 ELSE 0.0 END)::DOUBLE FROM comps")
def fill_rates(spark, sf):
    melted = sale_comps(spark, sf).select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("")).alias("v")) for f in ("address", "sale_date")])).alias("m")).select("m.*")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return melted.groupBy("field").agg(share(F.col("v") != "").alias("fill"), share(F.col("v").rlike(r"\d")).alias("digits"))


@query(
    "q_agg17_accuracy_rollup",
    "SELECT source, lang, count(*) AS n, count(*) FILTER (toxic = 0) AS passed, grouping(source) + grouping(lang) AS level FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (source, lang)",
)
def accuracy(spark, sf):
    d, l = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang"), spark.read.parquet(f"{sf}/labels.parquet")
    rolled = d.join(l, "doc_id").rollup("source", "lang")
    return rolled.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 0).alias("passed"), (F.grouping("source").cast("long") + F.grouping("lang").cast("long")).alias("level"))


@query("q_agg17_accuracy_pivot", "SELECT source, count(*) FILTER (quality = 0) AS q0, count(*) FILTER (quality = 1) AS q1 FROM documents JOIN labels USING (doc_id) GROUP BY source")
def accuracy_pivot(spark, sf):
    d, l = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source"), spark.read.parquet(f"{sf}/labels.parquet")
    p = d.join(l, "doc_id").groupBy("source").pivot("quality", [0, 1]).count()
    return p.select("source", F.coalesce("0", F.lit(0)).alias("q0"), F.coalesce("1", F.lit(0)).alias("q1"))


@query("q_win1_srt1_markers", f"WITH {COMPS_SQL} SELECT pos, source, CAST(row_number() OVER (PARTITION BY source ORDER BY relevance_score DESC, pos) AS INTEGER) AS marker FROM comps")
def markers(spark, sf):
    return ev.with_markers(sale_comps(spark, sf), ["source"]).select("pos", "source", "marker")


@query("q_srt2_distance_sort", f"WITH {COMPS_SQL} SELECT pos, country, row_number() OVER (PARTITION BY country ORDER BY {_SUBJECT_KM}, pos) AS place FROM comps WHERE lon IS NOT NULL")
def distance_sort(spark, sf):
    placed = ev.with_distance(sale_comps(spark, sf), SUBJECT["lon"], SUBJECT["lat"]).where("lon IS NOT NULL")
    return ev.rank_within(placed, ["country"], [F.col("distance_km"), F.col("pos")], "place").select("pos", "country", F.col("place").cast("long"))


@query("q_srt3_trim", f"WITH {COMPS_SQL} SELECT pos FROM comps ORDER BY relevance_score DESC, pos LIMIT 15")
def trim(spark, sf):
    return ev.rank_and_trim(sale_comps(spark, sf), 15).select("pos")


@query("q_set1_set2_unions", f"WITH {LAND_SQL} SELECT pos, 'sale' AS kind, price_m FROM comps UNION ALL SELECT pos, 'land', price_m FROM land")
def unions(spark, sf):
    return sale_comps(spark, sf).select("pos", F.lit("sale").alias("kind"), "price_m").unionByName(land_sales(spark, sf).select("pos", F.lit("land").alias("kind"), "price_m"))


@query(
    "q_set3_set6_sets",
    f"""WITH {COMPS_SQL}, t AS (SELECT pos, list_distinct(string_split(lower(land_zoning), ' ')) AS a, ['business', 'park'] AS b FROM comps)
SELECT pos, len(list_intersect(a, b)) AS common, len(list_distinct(list_concat(a, b))) AS total, len(list_filter(b, lambda x: NOT list_contains(a, x))) AS missing, len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AS subset FROM t""",
)
def sets(spark, sf):
    a, b = text.tokens(F.col("land_zoning")), F.array(F.lit("business"), F.lit("park"))
    n = lambda c: F.size(c).cast("long")
    return sale_comps(spark, sf).select("pos", n(F.array_intersect(a, b)).alias("common"), n(F.array_union(a, b)).alias("total"), n(F.array_except(b, a)).alias("missing"), (n(F.array_except(b, a)) == 0).alias("subset"))


@query("q_cal13_zone_code", f"WITH {COMPS_SQL} SELECT pos, CASE WHEN contains(lower(land_zoning), 'commercial') AND contains(lower(land_zoning), 'residential') THEN 'CR' WHEN land_zoning = 'Commercial' THEN 'C' WHEN land_zoning = 'Hotel' THEN 'H' WHEN land_zoning = 'Business Park' THEN 'PK' END AS zone, CASE land_zoning WHEN 'Business Park' THEN 'BP' END AS fixed FROM comps")
def zone(spark, sf):
    z = F.col("land_zoning")
    return sale_comps(spark, sf).select("pos", ev.zone_code(z).alias("zone"), F.when(z == "Business Park", ev.zone_code(z, compatible=False)).alias("fixed"))


@query("q_cal12_sector", f"WITH {COMPS_SQL} SELECT pos, CASE WHEN contains(property_name, 'Logistics') THEN 'industrial' ELSE 'office' END AS sector FROM comps")
def sector(spark, sf):
    return sale_comps(spark, sf).select("pos", geo.sector(F.col("property_name")).alias("sector"))


_PARCELS = "parcels AS (SELECT s_suppkey AS parcel, CASE s_nationkey % 5 WHEN 0 THEN 'business' WHEN 1 THEN 'commercial' WHEN 2 THEN 'residential' WHEN 3 THEN 'port_airport' ELSE 'park' END AS bucket, CAST(103600 + s_suppkey * 37 % 500 AS DOUBLE) / 1000 AS lon, CAST(1200 + s_suppkey * 53 % 250 AS DOUBLE) / 1000 AS lat, abs(s_acctbal) / 10000 AS area_km2 FROM supplier)"
_NEAR = km_sql("c.lon::DOUBLE", "c.lat::DOUBLE", "p.lon::DOUBLE", "p.lat::DOUBLE")


@query(
    "q_jon9_agg7_coverage",
    f"""WITH {COMPS_SQL}, {_PARCELS}, points AS (SELECT DISTINCT lon, lat FROM comps WHERE lon IS NOT NULL)
SELECT c.lon::DOUBLE AS lon, c.lat::DOUBLE AS lat, p.bucket, count(*) AS parcels, sum(p.area_km2) / pi() / 4 AS coverage FROM points c JOIN parcels p ON {_NEAR} <= 2.0 GROUP BY ALL""",
)
def coverage(spark, sf):
    return loc.coverage(loc.points(sale_comps(spark, sf)), loc.parcels(spark, sf), 2.0)


@query(
    "q_jon10_nearest",
    f"WITH {COMPS_SQL}, {_PARCELS}, points AS (SELECT DISTINCT lon, lat FROM comps WHERE lon IS NOT NULL) SELECT c.lon::DOUBLE AS lon, c.lat::DOUBLE AS lat, coalesce(min({_NEAR}), 99.0) AS km FROM points c LEFT JOIN parcels p ON p.bucket = 'port_airport' GROUP BY ALL",
)
def nearest(spark, sf):
    return loc.nearest(loc.points(sale_comps(spark, sf)), loc.parcels(spark, sf).where("bucket = 'port_airport'"))


_S = f"(SELECT {km_sql(SUBJECT['lon'], SUBJECT['lat'], 103.85176, 1.28348)})"


@query(
    "q_cal8_cal10_location",
    f"""WITH {COMPS_SQL}, {_PARCELS}, points AS (SELECT DISTINCT lon, lat FROM comps WHERE lon IS NOT NULL),
cov AS (SELECT c.lon, c.lat, sum(p.area_km2) / pi() AS v FROM points c JOIN parcels p ON p.bucket = 'commercial' AND {_NEAR} <= 1.0 GROUP BY ALL),
sub AS (SELECT coalesce(sum(p.area_km2) / pi(), 0) AS v FROM parcels p WHERE p.bucket = 'commercial' AND {km_sql(SUBJECT['lon'], SUBJECT['lat'], 'p.lon::DOUBLE', 'p.lat::DOUBLE')} <= 1.0),
s AS (SELECT c.lon::DOUBLE AS lon, c.lat::DOUBLE AS lat, (greatest(-1.0, least(1.0, ({_S} - {km_sql('c.lon::DOUBLE', 'c.lat::DOUBLE', 103.85176, 1.28348)}) / 5.0)) + (coalesce(cov.v, 0) - sub.v) / (coalesce(cov.v, 0) + sub.v + 0.3)) / 2 AS raw FROM points c LEFT JOIN cov ON c.lon = cov.lon AND c.lat = cov.lat, sub)
SELECT lon, lat, round(raw, 3) AS score, CASE WHEN round(raw, 3) > 0.3 THEN 'Superior' WHEN round(raw, 3) < -0.3 THEN 'Inferior' ELSE 'Comparable' END AS label FROM s""",
)
def location(spark, sf):
    return loc.office_scores(loc.points(sale_comps(spark, sf)), loc.parcels(spark, sf), SUBJECT["lon"], SUBJECT["lat"])


@query(
    "q_cal11_location_policy",
    f"""WITH {COMPS_SQL} SELECT pos, CASE WHEN pos % 6 = 0 THEN 'Superior' WHEN contains(property_name, 'Logistics') THEN '' WHEN lon IS NULL THEN '' WHEN NOT (lon BETWEEN 103.55 AND 104.15 AND lat BETWEEN 1.13 AND 1.5) THEN '' ELSE 'scored' END AS location FROM comps""",
)
def policy(spark, sf):
    provided = F.when(F.col("pos") % 6 == 0, "superior")
    return sale_comps(spark, sf).select("pos", loc.policy(provided, geo.sector(F.col("property_name")), "office", F.col("lon"), F.col("lat"), F.lit("scored")).alias("location"))


@query("q_jon11_point_in_polygon", f"WITH {COMPS_SQL} SELECT pos, CASE WHEN lon > 103.7 AND lon < 103.9 AND lat > 1.25 AND lat < 1.35 THEN 'box' ELSE '' END AS land_use FROM comps WHERE lon IS NOT NULL AND lon NOT IN (103.7, 103.9) AND lat NOT IN (1.25, 1.35)")
def in_polygon(spark, sf):
    rings = spark.createDataFrame([(0, "box", [(103.7, 1.25), (103.9, 1.25), (103.9, 1.35), (103.7, 1.35)])], "ord int, land_use string, ring array<struct<x:double,y:double>>")
    comps = sale_comps(spark, sf).where("lon IS NOT NULL AND lon NOT IN (103.7, 103.9) AND lat NOT IN (1.25, 1.35)")
    return loc.land_use_at(comps, rings).select("pos", "land_use")


@query("q_spa2_spa3_rings", f"WITH {COMPS_SQL} SELECT pos, lon::DOUBLE + 0.005 AS cx, lat::DOUBLE + 0.005 AS cy, 0.01::DOUBLE * 0.01::DOUBLE * 110.574 * 111.32 * cos(radians(lat::DOUBLE + 0.005)) AS km2 FROM comps WHERE lon IS NOT NULL")
def rings(spark, sf):
    x, y = F.col("lon").cast("double"), F.col("lat").cast("double")
    at = lambda i, j: F.struct((x + i).alias("x"), (y + j).alias("y"))
    r = sale_comps(spark, sf).where("lon IS NOT NULL").select("pos", F.array(at(0, 0), at(0.01, 0), at(0.01, 0.01), at(0, 0.01)).alias("ring"))
    cx, cy = geo.ring_centroid(F.col("ring"))
    return r.select("pos", cx.alias("cx"), cy.alias("cy"), geo.ring_area_km2(F.col("ring")).alias("km2"))


@query("q_spa8_zoom_fit", f"WITH {COMPS_SQL}, b AS (SELECT country, max(lon)::DOUBLE - min(lon)::DOUBLE AS w, max(lat)::DOUBLE - min(lat)::DOUBLE AS h FROM comps WHERE lon IS NOT NULL GROUP BY country) SELECT country, CAST(greatest(least(floor(least(log2(1200 * 360.0 / (greatest(w, 1e-6) * 512)), log2(900 * 180.0 / (greatest(h, 1e-6) * 512)))), 18), 0) AS INTEGER) AS zoom FROM b")
def zoom(spark, sf):
    box = sale_comps(spark, sf).where("lon IS NOT NULL").groupBy("country").agg((F.max("lon").cast("double") - F.min("lon").cast("double")).alias("w"), (F.max("lat").cast("double") - F.min("lat").cast("double")).alias("h"))
    return box.select("country", geo.zoom_to_fit(F.col("w"), F.col("h"), 1200, 900).alias("zoom"))


@query("q_snk5_provenance_rows", f"WITH {COMPS_SQL} SELECT property_name, unnest(list_sort(list_distinct(list(source)))) AS source FROM comps GROUP BY property_name")
def provenance(spark, sf):
    return sale_comps(spark, sf).select("property_name", "source").distinct()


@query("q_snk7_geo_sidecar", f"WITH {COMPS_SQL} SELECT pos, '{{\"pos\":' || CAST(pos AS VARCHAR) || ',\"name\":\"' || property_name || '\"}}' AS sidecar FROM comps")
def sidecar(spark, sf):
    return sale_comps(spark, sf).select("pos", F.to_json(F.struct("pos", F.col("property_name").alias("name"))).alias("sidecar"))


@query("q_snk14_cache_key", "SELECT n_nationkey, md5(concat_ws(':', n_name, CAST(n_regionkey AS VARCHAR)))[1:12] AS key FROM nation")
def cache_key(spark, sf):
    return spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", F.substring(F.md5(F.concat_ws(":", "n_name", F.col("n_regionkey").cast("string"))), 1, 12).alias("key"))
