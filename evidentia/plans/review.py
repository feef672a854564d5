"""Queries of what a reviewer checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import evidence as ev
from evidentia.operators import review as rv
from evidentia.plans.register import query
from evidentia.sources.surrogate import COMPS_SQL, sale_comps


@query(
    "q_sch5_deal_units",
    f"""WITH m AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in rv.CURRENCIES.items())}) m(country, currency)), d AS (SELECT c_custkey AS deal, n_name, CASE c_custkey % 5 WHEN 0 THEN ' krw ' WHEN 1 THEN '' END AS stated, CASE WHEN c_custkey % 3 = 0 THEN 'b' END AS price, CASE WHEN c_custkey % 4 = 0 THEN 'SF' END AS area FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT deal, coalesce(nullif(trim(stated), ''), m.currency, 'USD') AS unit_currency, CASE WHEN price IS NULL THEN 'M' ELSE 'B' END AS unit_price, CASE WHEN area IS NULL THEN 'sqm' ELSE 'sf' END AS unit_area FROM d LEFT JOIN m ON m.country = lower(n_name)""",
)
def deal_units(spark, sf):
    key = F.col("c_custkey")
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit(" "), F.initcap("n_name")).alias("country_name"))
    d = spark.read.parquet(f"{sf}/customer.parquet").join(n, "c_nationkey").select(key.alias("deal"), "country_name", F.when(key % 5 == 0, " krw ").when(key % 5 == 1, "").alias("currency"), F.when(key % 3 == 0, "b").alias("price_unit"), F.when(key % 4 == 0, "SF").alias("area_unit"))
    return rv.deal_units(d).select("deal", "unit_currency", "unit_price", "unit_area")


@query(
    "q_agg18_flag_counts",
    f"""WITH {COMPS_SQL}, f AS (SELECT source, pos, gfa_sf / 40 AS a, price_m * 40 AS p, npi_yield * (1 + pos % 6) AS y, price_m * 400000 / gfa_sf * (1 + pos % 5) AS s FROM comps),
x AS (SELECT source, unnest(list_filter([CASE WHEN a < 500 OR a > 5000000 THEN 'area out of range' END, CASE WHEN p < 0.1 OR p > 10000 THEN 'price out of range' END, CASE WHEN y < 0.005 OR y > 0.2 THEN 'yield out of range' END,
  CASE WHEN p * 1000000 / (a * s) >= 3 OR p * 1000000 / (a * s) <= 1.0 / 3 THEN 'price does not fit area' END], lambda z: z IS NOT NULL)) AS flag FROM f), t AS (SELECT source, count(*) AS total FROM x GROUP BY source)
SELECT x.source, flag, count(*) AS records, max(total) AS total FROM x JOIN t ON t.source = x.source GROUP BY x.source, flag""",
)
def flag_counts(spark, sf):
    c = sale_comps(spark, sf)
    flags = ev.auto_flags(F.col("gfa_sf") / 40, F.col("price_m") * 40, F.try_divide(F.col("price_m") * 400_000, F.col("gfa_sf")) * (1 + F.col("pos") % 5), F.col("npi_yield") * (1 + F.col("pos") % 6))
    return rv.flag_counts(c.select("source", flags.alias("flags")), "source")


@query("q_agg19_page_tables", "SELECT user_id AS page, event_id AS nth, count(*) OVER (PARTITION BY user_id) AS on_page, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS ordinal, 'p' || user_id || '#' || row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS table_id FROM events WHERE event_type <> 'view'")
def page_tables(spark, sf):
    return rv.table_ordinals(spark.read.parquet(f"{sf}/events.parquet").where("event_type <> 'view'").select(F.col("user_id").alias("page"), F.col("event_id").alias("nth")))


@query(
    "q_flt13_flt14_pages_to_rescue",
    """WITH p AS (SELECT doc_id % 50 AS doc, doc_id AS page, contains(lower(text), 'the ') OR contains(lower(text), 'licensed') AS hit FROM documents), u AS (SELECT doc_id % 50 AS doc, doc_id AS page FROM labels WHERE quality = 1 AND doc_id % 3 <> 0), r AS (SELECT doc_id % 50 AS doc, doc_id AS page FROM labels WHERE toxic = 1)
SELECT doc, page FROM p ANTI JOIN u USING (doc, page) ANTI JOIN r USING (doc, page) WHERE hit""",
)
def rescue(spark, sf):
    """Pages are documents; a good one gave a useful record (one in three without a table to name), a toxic one was refused."""
    small = F.lower(F.coalesce("text", F.lit("")))
    words = F.array_compact(F.array(*[F.when(small.contains(w), F.lit(w)) for w in ("the ", "licensed")]))
    pages = spark.read.parquet(f"{sf}/documents.parquet").select((F.col("doc_id") % 50).alias("doc"), F.col("doc_id").alias("page"), words.alias("matched"))
    labels = spark.read.parquet(f"{sf}/labels.parquet").select((F.col("doc_id") % 50).alias("doc"), F.col("doc_id").alias("page"), "quality", "toxic")
    table = F.when(F.col("page") % 3 == 0, "text").otherwise(F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("#1")))
    return rv.pages_to_rescue(pages, labels.select("doc", table.alias("table_id"), (F.col("quality") == 1).alias("useful")), labels.where("toxic = 1")).select("doc", "page")


@query(
    "q_prv1_judgement_notes",
    f"""WITH {COMPS_SQL}, n AS (SELECT pos, property_name, list_filter([CASE WHEN pos % 6 = 0 THEN '{rv.PARSED_NOTE}' END, CASE WHEN gfa_sf IS NULL THEN 'Verification changed area' END, CASE WHEN gfa_sf IS NULL AND price_m IS NULL THEN 'Verification changed price' END, CASE WHEN sale_type = 'Strata' THEN 'Sources differ' END], lambda x: x IS NOT NULL) AS notes, address IS NULL AS noted FROM comps)
SELECT CAST(pos AS VARCHAR) AS marker, property_name AS name, array_to_string(CASE WHEN noted THEN list_append(notes, 'Note: no address') ELSE notes END, '|') AS notes FROM n WHERE len(notes) > 0""",
)
def notes(spark, sf):
    c = sale_comps(spark, sf)
    edits = F.when(F.col("gfa_sf").isNull(), F.when(F.col("price_m").isNull(), F.array(F.lit("area"), F.lit("price"))).otherwise(F.array(F.lit("area"))))
    records = c.select(F.concat(F.lit(" "), F.col("pos").cast("string")).alias("marker"), "property_name", (F.col("pos") % 6 == 0).alias("llm_parsed"), edits.alias("verify_edits"), F.when(F.col("sale_type") == "Strata", "Sources differ").alias("review_flag"), F.when(F.col("address").isNull(), "no address").alias("verify_flag"))
    return rv.judgement_notes(records).select("marker", "name", F.array_join("notes", "|").alias("notes"))


@query(
    "q_snk14_cached_searches",
    """SELECT c_custkey AS deal, CASE WHEN c_custkey % 4 IN (0, 1) THEN 'run 2 of ' || c_name END AS saved, c_custkey % 4 NOT IN (0, 1) AS fresh FROM customer""",
)
def cached_searches(spark, sf):
    """Deals whose configuration is as it was when its last search was stored (in another order of entries), has changed since, or was never searched."""
    key = F.col("c_custkey")
    c = spark.read.parquet(f"{sf}/customer.parquet")
    now = F.create_map(F.lit("radius"), (key % 7).cast("string"), F.lit("segment"), F.col("c_mktsegment"), F.lit("asset"), F.lit("office"))
    then = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("asset"), F.lit("office"), F.lit("radius"), F.when(key % 4 == 2, (key % 7 + 1).cast("string")).otherwise((key % 7).cast("string")))
    cache = c.where(key % 4 != 3).select(key.alias("deal"), rv.config_key(then).alias("key"), F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"), "c_name")
    cache = cache.select("deal", F.when((F.col("seq") == 1), "old").otherwise(F.col("key")).alias("key"), "seq", F.concat(F.lit("run "), F.col("seq").cast("string"), F.lit(" of "), "c_name").alias("saved"))
    return rv.cached_searches(c.select(key.alias("deal"), now.alias("config")), cache).select("deal", "saved", "fresh")


@query(
    "q_win14_shared_shingles",
    r"""WITH s AS (SELECT item_id AS claim_id, item_id % 20 AS src, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM benchmark), v AS (SELECT claim_id, src, CASE WHEN claim_id % 3 = 0 THEN list_reverse(w) WHEN claim_id % 5 = 0 THEN [] ELSE w END AS w FROM s),
x AS (SELECT claim_id, src, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i, w FROM v WHERE len(w) > 0), g AS (SELECT DISTINCT claim_id, src, array_to_string(w[i:i + 3], ' ') AS gram FROM x),
h AS (SELECT DISTINCT claim_id FROM g JOIN (SELECT doc_id % 20 AS src, lower(text) AS small FROM documents) d ON d.src = g.src AND contains(small, gram))
SELECT claim_id, CASE WHEN len(w) > 0 THEN h.claim_id IS NOT NULL END AS found FROM v LEFT JOIN h USING (claim_id)""",
)
def shingles(spark, sf):
    b = spark.read.parquet(f"{sf}/benchmark.parquet")
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    support = F.when(F.col("item_id") % 3 == 0, F.array_join(F.reverse(words), " ")).when(F.col("item_id") % 5 == 0, " ").otherwise(F.col("text"))
    extracts = spark.read.parquet(f"{sf}/documents.parquet").select((F.col("doc_id") % 20).alias("source"), F.col("doc_id").alias("part"), "text")
    return rv.shared_shingles(b.select(F.col("item_id").alias("claim_id"), (F.col("item_id") % 20).alias("source"), support.alias("support")), extracts)
