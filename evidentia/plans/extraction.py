"""Queries of extraction, classification and the remaining record operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidentia.functions import geo, num, text
from evidentia.operators import evidence as ev
from evidentia.operators import extraction as ex
from evidentia.operators import location as loc
from evidentia.plans.evidence import _NEAR, _PARCELS, km_sql
from evidentia.plans.grids import GRID_SQL, KEYWORDS, SYNONYMS, grid
from evidentia.plans.register import query
from evidentia.sources.surrogate import COMPS_SQL, LEASES_SQL, leases, sale_comps


def _docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@query("q_src8_src30_relevant_pages", "SELECT doc_id FROM documents WHERE contains(lower(text), 'licensed') OR contains(lower(text), 'version')")
def relevant(spark, sf):
    return ex.relevant_pages(_docs(spark, sf), ["Licensed", "version"]).select("doc_id")


@query("q_src19_median_to_psf", f"WITH {LEASES_SQL}, r AS (SELECT source, asking_rent, row_number() OVER (PARTITION BY source ORDER BY asking_rent, pos) AS k, count(*) OVER (PARTITION BY source) AS n FROM leases WHERE asking_rent IS NOT NULL) SELECT source, round(asking_rent / 10.7639, 4) AS median_psf FROM r WHERE k = n // 2 + 1")
def median_psf(spark, sf):
    w = Window.partitionBy("source")
    r = leases(spark, sf).where("asking_rent IS NOT NULL").withColumn("k", F.row_number().over(w.orderBy("asking_rent", "pos"))).withColumn("n", F.count("*").over(w))
    return r.where(F.col("k") == F.expr("n div 2 + 1")).select("source", F.round(F.col("asking_rent") / num.SF_PER_SQM, 4).alias("median_psf"))


@query("q_src25_src26_corpus", "SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS id, length(text[1:24000]) AS n FROM documents UNION ALL SELECT 'benchmark', CAST(item_id AS VARCHAR), length(text[1:24000]) FROM benchmark")
def corpus(spark, sf):
    take = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.length(F.substring("text", 1, 24000)).cast("long").alias("n"))
    return take(_docs(spark, sf), "document", "doc_id").unionByName(take(spark.read.parquet(f"{sf}/benchmark.parquet"), "benchmark", "item_id"))


@query("q_src28_parcel_buckets", f"WITH {_PARCELS} SELECT parcel, unnest(CASE WHEN bucket = 'commercial' THEN ['commercial', 'any'] ELSE [bucket, 'any'] END) AS bucket FROM parcels")
def buckets(spark, sf):
    return loc.parcels(spark, sf).select("parcel", F.explode(F.array("bucket", F.lit("any"))).alias("bucket"))


@query("q_str12_flt5_garbage", "SELECT doc_id, regexp_matches(s, '(?i)\\b(is|are|was|were|has|have|will|remained|recorded)\\b') OR regexp_matches(s, '(?i)\\b(and|or|of|the)$') OR (len(regexp_split_to_array(trim(s, ' '), '\\s+')) >= 4 AND trim(s, ' ') LIKE '%.') AS garbage FROM (SELECT doc_id, regexp_replace(text[1:60], '\\s+', ' ', 'g') AS s FROM documents)")
def garbage(spark, sf):
    s = F.regexp_replace(F.substring("text", 1, 60), ex.BLANKS, " ")
    return _docs(spark, sf).select("doc_id", F.when(F.col("text").isNotNull(), ex.garbage_row(s, F.lit("5"))).alias("garbage"))


@query("q_flt2_flt6_row_checks", f"WITH {COMPS_SQL} SELECT pos, pos % 9 = 0 AS totals, sale_date = '' OR regexp_matches(sale_date, '\\d{{4}}') AS date_ok FROM comps")
def row_checks(spark, sf):
    name = F.when(F.col("pos") % 9 == 0, F.concat(F.lit("Sub-Total "), "property_name")).otherwise(F.col("property_name"))
    return sale_comps(spark, sf).select("pos", name.rlike(ev.TOTALS).alias("totals"), ((F.col("sale_date") == "") | F.col("sale_date").rlike(r"\d{4}")).alias("date_ok"))


@query("q_flt13_flt14_rescue", "SELECT page_id FROM pages WHERE page_id % 3 <> 0 AND page_id % 5 <> 0")
def rescue(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id")
    return ex.rescue_pages(pages, pages.where("page_id % 3 = 0"), pages.where("page_id % 5 = 0"))


@query("q_flt21_label_respect", f"WITH {COMPS_SQL} SELECT pos, CASE pos % 3 WHEN 0 THEN 'Superior' WHEN 1 THEN 'Inferior' ELSE '' END AS label FROM comps")
def labels(spark, sf):
    given = F.when(F.col("pos") % 3 == 0, "SUPERIOR").when(F.col("pos") % 3 == 1, " inferior").otherwise("great")
    return sale_comps(spark, sf).select("pos", loc.policy(given, F.lit("x"), "office", F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit("")).alias("label"))


@query("q_flt12_grd1_grd3_headers", f"WITH {GRID_SQL} SELECT table_id, row, row % 6 = 0 AS header FROM grid")
def headers(spark, sf):
    return grid(spark, sf).select("table_id", "row", (ex.header_quality(F.col("cells"), KEYWORDS) >= 4).alias("header"))


@query("q_win5_collapse_headers", f"WITH {GRID_SQL}, l AS (SELECT *, min(CASE WHEN row % 6 IN (0, 1) THEN 1 ELSE 0 END) OVER (PARTITION BY table_id ORDER BY row) AS lead FROM grid) SELECT table_id, c AS col, string_agg(cells[c + 1], ' ' ORDER BY row) AS header FROM l, range(0, 4) r(c) WHERE lead = 1 AND trim(cells[c + 1]) <> '' GROUP BY table_id, c")
def collapse(spark, sf):
    return ex.collapse_headers(grid(spark, sf), F.col("row") % 6 <= 1).withColumn("col", F.col("col").cast("long"))


@query("q_win6_split_at_headers", f"WITH {GRID_SQL} SELECT table_id, row, CAST(sum(CASE WHEN row % 6 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY table_id ORDER BY row) AS BIGINT) AS part FROM grid")
def split_headers(spark, sf):
    return ex.split_at_headers(grid(spark, sf), F.col("row") % 6 == 0).select("table_id", "row", "part")


@query("q_win7_join_fragments", f"WITH {GRID_SQL}, n AS (SELECT table_id, CAST(row_number() OVER (PARTITION BY table_id ORDER BY row) AS INTEGER) AS n, cells FROM grid) SELECT table_id, n, array_to_string(list_concat(cells[1:2], cells[3:4]), '|') AS cells FROM n")
def fragments(spark, sf):
    g = grid(spark, sf)
    left, right = g.withColumn("cells", F.slice("cells", 1, 2)), g.withColumn("cells", F.slice("cells", 3, 2))
    return ex.join_fragments(left, right).withColumn("cells", F.array_join("cells", "|"))


@query("q_win13_unit_rows", f"WITH {GRID_SQL}, l AS (SELECT table_id, row, lead(row) OVER (PARTITION BY table_id ORDER BY row) AS nr FROM grid) SELECT table_id, row, 'Price (S$M)' AS header FROM l WHERE nr % 3 = 0")
def units(spark, sf):
    g = grid(spark, sf).select("table_id", "row", F.when(F.col("row") % 3 == 0, F.array(F.lit("(S$M)"))).otherwise(F.array(F.lit("Price"))).alias("cells"))
    found = ex.unit_rows(g).withColumn("header", F.lit("Price (S$M)"))
    return found.select("table_id", "row", "header")


@query("q_ded2_document_dedup")
def document_dedup(spark, sf):
    """A document of the test data is the orders of 64 keys in a row: several names, three tables, coarse prices."""
    c = sale_comps(spark, sf).select(F.expr("pos div 64").cast("string").alias("doc"), (F.col("pos") % 3).alias("table_id"), "pos", F.col("property_name").alias("name"), F.bround(F.col("price_m") / 50, 0).alias("price"), F.col("gfa_sf").cast("double").alias("area"))
    return ex.dedup_within_document(c)


@query("q_jon6_accumulate", f"WITH {COMPS_SQL}, f AS (SELECT property_name, source, min(pos) AS p FROM comps GROUP BY ALL) SELECT min(p) AS pos, string_agg(source, ',' ORDER BY p) AS sources FROM f GROUP BY property_name")
def accumulate(spark, sf):
    return ex.accumulate(sale_comps(spark, sf), F.col("property_name")).withColumn("sources", F.array_join("sources", ","))


@query("q_jon8_agg8_counts_near", f"WITH {COMPS_SQL}, {_PARCELS}, points AS (SELECT DISTINCT lon, lat FROM comps WHERE lon IS NOT NULL) SELECT c.lon, c.lat, count(*) AS n FROM points c JOIN parcels p ON {_NEAR} <= 1.5 GROUP BY ALL")
def counts_near(spark, sf):
    c = loc.coverage(loc.points(sale_comps(spark, sf)), loc.parcels(spark, sf), 1.5)
    return c.groupBy("lon", "lat").agg(F.sum("parcels").alias("n"))


_CENTRES = ((103.85176, 1.28348, 1.0), (103.8330, 1.3040, 1.0), (103.7420, 1.3330, 0.6), (103.9450, 1.3540, 0.6), (103.7860, 1.4370, 0.6), (103.8850, 1.4050, 0.6))


@query("q_agg9_retail_pull", f"WITH {COMPS_SQL} SELECT pos, greatest(0, " + ", ".join(f"{w} * (1 - {km_sql('lon', 'lat', x, y)} / 3.0)" for x, y, w in _CENTRES) + ")::DOUBLE AS pull FROM comps WHERE lon IS NOT NULL")
def retail(spark, sf):
    pulls = [F.lit(w) * (1 - geo.haversine_km(F.col("lon"), F.col("lat"), F.lit(x), F.lit(y)) / 3.0) for x, y, w in _CENTRES]
    return sale_comps(spark, sf).where("lon IS NOT NULL").select("pos", F.greatest(F.lit(0.0), *pulls).alias("pull"))


@query("q_agg18_agg19_counts", f"WITH {GRID_SQL} SELECT table_id, count(*) AS rows, CAST(sum(CASE WHEN row % 6 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS flags FROM grid GROUP BY table_id")
def counts(spark, sf):
    flags = F.when(F.col("row") % 6 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    return grid(spark, sf).groupBy("table_id").agg(F.count("*").alias("rows"), F.sum(F.size(flags)).alias("flags"))


@query("q_cal3_row5_row_price", f"WITH {COMPS_SQL} SELECT pos, CASE WHEN pos % 10 = 0 THEN 1234.0 ELSE round(price_m * 1000000 / gfa_sf, 0) END AS psf FROM comps")
def row_price(spark, sf):
    derived = F.round(F.try_divide(F.col("price_m") * 1_000_000, F.col("gfa_sf").cast("double")), 0)
    return sale_comps(spark, sf).select("pos", F.coalesce(F.when(F.col("pos") % 10 == 0, 1234.0), derived).alias("psf"))


@query("q_cal9_pair_score", f"WITH {COMPS_SQL} SELECT pos, (relevance_score - 5) / (relevance_score + 5 + 10.0)::DOUBLE AS counts, greatest(-1.0, least(1.0, (3.0 - relevance_score) / 5.0))::DOUBLE AS distance FROM comps")
def pair_score(spark, sf):
    v = F.col("relevance_score").cast("double")
    return sale_comps(spark, sf).select("pos", geo.pair_score(v, F.lit(5.0), True, None).alias("counts"), geo.pair_score(v, F.lit(3.0), False, None).alias("distance"))


@query("q_map8_verify", f"WITH {GRID_SQL}, t AS (SELECT DISTINCT table_id FROM grid WHERE row % 6 = 0), d AS (SELECT DISTINCT table_id FROM grid WHERE row % 6 > 1) SELECT t.table_id, f.field, CASE WHEN f.field = 'sale_date' THEN 'no dates' WHEN f.field = 'property_name' THEN NULL WHEN d.table_id IS NULL THEN 'no numbers' END AS flag FROM t LEFT JOIN d ON t.table_id = d.table_id, (VALUES ('property_name'), ('sale_date'), ('price_sgd_m'), ('gfa_sf')) f(field)")
def map_verify(spark, sf):
    from evidentia.operators import grids

    g = grid(spark, sf)
    heads = g.where("row % 6 = 0").select("table_id", F.posexplode("cells").alias("column", "header")).distinct()
    stats = ex.column_types(g.where("row % 6 > 1").select("table_id", F.posexplode("cells").alias("column", "cell")))
    return ex.verify_mapping(grids.map_columns(heads, SYNONYMS), stats).select("table_id", "field", "flag")


@query("q_txt14_txt20_value_in_context", "SELECT doc_id, contains(replace(text, ',', ''), '555') AS found FROM documents")
def in_context(spark, sf):
    return _docs(spark, sf).select("doc_id", F.replace(F.col("text"), F.lit(","), F.lit("")).contains("555").alias("found"))


@query("q_txt16_citation_spans", "SELECT page_id, url, 'seen at' AS span FROM pages")
def spans(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", ex.cite_urls(F.concat(F.lit("seen at ("), "url", F.lit(") today"))).alias("c"))
    return p.select("page_id", F.explode("c").alias("c")).select("page_id", "c.url", "c.span")


@query("q_txt18_clean_body", "SELECT doc_id, trim(text, chr(10) || ' ') AS text FROM documents WHERE NOT contains(text, '**') AND NOT contains(text, chr(10) || '#')")
def clean(spark, sf):
    d = _docs(spark, sf).where(~F.col("text").contains("**") & ~F.col("text").contains("\n#"))
    body = F.concat(F.lit("**Demand:** "), "text", F.lit("\n## Sources\n1. x"))
    return d.select("doc_id", ex.clean_body(body).alias("b")).select("doc_id", F.expr("trim(BOTH '\\n ' FROM b)").alias("text"))


@query("q_txt18_clean_body_all")
def clean_all(spark, sf):
    """The texts of all documents as they are, labels and headings too."""
    return _docs(spark, sf).select("doc_id", ex.clean_body(F.col("text")).alias("text"))


@query("q_txt23_txt27_prompts", "SELECT conv_id, string_agg('[' || role || '] ' || text[1:40], chr(10) ORDER BY turn, role, text) AS prompt FROM conversations GROUP BY conv_id")
def prompts(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.concat(F.lit("["), t["role"], F.lit("] "), F.substring(t["text"], 1, 40)))
    return c.groupBy("conv_id").agg(F.array_join(rows, "\n").alias("prompt"))


@query("q_txt25_txt26_summaries", "SELECT lang, string_agg(CAST(n_chars AS VARCHAR), '; ' ORDER BY n_chars DESC, doc_id) AS stats FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 3 GROUP BY lang")
def summaries(spark, sf):
    k = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))
    top = _docs(spark, sf).select("lang", "n_chars", k.alias("k")).where("k <= 3")
    return top.groupBy("lang").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "n_chars"))), lambda x: x["n_chars"].cast("string")), "; ").alias("stats"))


@query("q_spa12_row14_name_lines", f"WITH {COMPS_SQL} SELECT pos, property_name AS name, coalesce(address, '') AS place FROM comps")
def name_lines(spark, sf):
    lines = F.split(F.concat_ws("\n", "property_name", "address"), "\n")
    return sale_comps(spark, sf).select("pos", F.get(lines, F.lit(0)).alias("name"), F.coalesce(F.get(lines, F.lit(1)), F.lit("")).alias("place"))


@query("q_jsn2_json_arrays", "SELECT event_id AS id, '[' || CAST(json_extract_string(props, '$.k') AS VARCHAR) || ', \"]\"]' AS \"array\" FROM events UNION ALL SELECT event_id, '[[1], 2]' FROM events")
def json_arrays(spark, sf):
    t = F.concat(F.lit("first ["), F.get_json_object("props", "$.k"), F.lit(', "]"] then [[1], 2] end'))
    return ex.scan_json_arrays(spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("id"), t.alias("text")))


@query("q_prv5_name_fixes", f"WITH {COMPS_SQL} SELECT pos, CASE WHEN pos % 2 = 0 THEN 'B1ock 5' ELSE 'Block 5' END AS name FROM comps")
def fixes(spark, sf):
    rows = sale_comps(spark, sf).select("pos", F.lit("Block 5").alias("name"))
    return ex.name_fixes(rows, rows.select("pos", F.when(F.col("pos") % 2 == 0, "B1ock 5").otherwise("Tower 9").alias("name")))


@query("q_prv1_prv7_notes", f"WITH {COMPS_SQL} SELECT pos, concat_ws('; ', CASE WHEN pos % 4 = 0 THEN 'read by a model' END, CASE WHEN pos % 6 = 0 THEN 'edited' END) AS notes, coalesce(price_m, 0) <> 0 AS valid FROM comps WHERE pos % 4 = 0 OR pos % 6 = 0")
def notes(spark, sf):
    n = F.array_compact(F.array(F.when(F.col("pos") % 4 == 0, "read by a model"), F.when(F.col("pos") % 6 == 0, "edited")))
    return sale_comps(spark, sf).where(F.size(n) > 0).select("pos", F.array_join(n, "; ").alias("notes"), (F.coalesce("price_m", F.lit(0.0)) != 0).alias("valid"))


@query("q_row2_row4_row8_reshape", f"WITH {LEASES_SQL} SELECT pos, property_name AS property, coalesce(eff_rent, asking_rent) AS rate FROM leases WHERE nla_sf IS NOT NULL")
def reshape(spark, sf):
    return leases(spark, sf).where("nla_sf IS NOT NULL").select("pos", F.col("property_name").alias("property"), F.coalesce("eff_rent", "asking_rent").alias("rate"))


@query("q_sch5_snk10_audit", f"WITH {COMPS_SQL} SELECT pos, CASE WHEN country = 'N1' THEN 'SGD' ELSE 'USD' END AS currency, price_m IS NULL AS needs_review FROM comps")
def audit(spark, sf):
    return sale_comps(spark, sf).select("pos", F.when(F.col("country") == "N1", "SGD").otherwise("USD").alias("currency"), F.col("price_m").isNull().alias("needs_review"))
