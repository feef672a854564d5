"""Queries of briefs and of the registries that feed them."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions.lease import FACTOR_SQL, factor_rows
from evidentia.operators import briefs as br
from evidentia.plans.register import query
from evidentia.sources.surrogate import COMPS_SQL, sale_comps

# Insights: a document is a report of its source; its lines are the facts, by position, its words the statistics.

_LINES_SQL = r"d AS (SELECT coalesce(source, '') AS deal, doc_id AS ord, lang AS source, string_split(text, chr(10)) AS l, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[\x{1100}-\x{11ff}\x{3040}-\x{30ff}\x{3130}-\x{318f}\x{ac00}-\x{d7a3}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]'))"


def _reports(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").where(r"text IS NOT NULL AND NOT text RLIKE '[\\x{1100}-\\x{11ff}\\x{3040}-\\x{30ff}\\x{3130}-\\x{318f}\\x{ac00}-\\x{d7a3}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}]'")
    lines, words = F.split("text", "\n", -1), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    line = lambda i: F.coalesce(F.get(lines, F.lit(i)), F.lit(""))
    facts = F.create_map(*[c for i, k in enumerate(("market_overview", "rental_trends", "market_outlook", "other")) for c in (F.lit(k), line(i))])
    lists = F.when(F.col("doc_id") % 3 != 0, F.create_map(F.lit("named_submarkets"), words))
    return d.select(F.coalesce("source", F.lit("")).alias("deal"), F.col("doc_id").alias("ord"), F.col("lang").alias("source"), facts.alias("facts"), lists.alias("lists"), F.when(F.col("doc_id") % 4 != 0, words).alias("statistics"), F.array("lang", F.lit(None).cast("string"), F.lit("2024")).alias("meta"))


@query(
    "q_txt17_labelled_insights",
    f"""WITH {_LINES_SQL}, p AS (SELECT deal, ord, list_filter(['Research Report ' || (ord + 1), CASE WHEN coalesce(l[1], '') <> '' THEN 'Market Overview: ' || trim(l[1]) END, CASE WHEN coalesce(l[2], '') <> '' THEN 'Rental Trends: ' || trim(l[2]) END, CASE WHEN coalesce(l[3], '') <> '' THEN 'Market Outlook: ' || trim(l[3]) END,
  CASE WHEN ord % 3 <> 0 AND len(w) > 0 THEN 'Submarket Breakdown: ' || array_to_string(w[1:10], ' | ') END, CASE WHEN ord % 4 <> 0 AND len(w) > 0 THEN 'Key Data Points: ' || array_to_string(w[1:30], ' | ') END], lambda x: x IS NOT NULL) AS parts FROM d)
SELECT deal, ord, md5(array_to_string(parts, chr(10))) AS digest, CAST(len(parts) AS INTEGER) AS lines FROM p""",
)
def labelled_insights(spark, sf):
    out = br.merged_insights(_reports(spark, sf), anonymous=True)
    return out.select("deal", "ord", F.md5("part").alias("digest"), F.size(F.split("part", "\n", -1)).alias("lines"))


@query(
    "q_txt26_input_summary",
    f"""WITH {_LINES_SQL}, p AS (SELECT deal, ord, '### ' || source || '  ' || chr(10) || '_' || source || ' · 2024_' AS head, list_filter([nullif(trim(coalesce(l[1], '')), ''), CASE WHEN trim(coalesce(l[2], '')) <> '' THEN '- **Rents:** ' || trim(l[2]) END, CASE WHEN trim(coalesce(l[3], '')) <> '' THEN '- **Outlook & risks:** ' || trim(l[3]) END,
  CASE WHEN ord % 4 <> 0 AND len(w) > 0 THEN '- **Notable figures:** ' || array_to_string(w[1:3], '; ') END], lambda x: x IS NOT NULL) AS parts FROM d WHERE source IS NOT NULL)
SELECT deal, ord, md5(head || chr(10) || CASE WHEN len(parts) > 0 THEN array_to_string(parts, chr(10)) ELSE '- _No summary available. Verify the source._' END) AS digest FROM p""",
)
def input_summary(spark, sf):
    return br.input_summary(_reports(spark, sf)).select("deal", "ord", F.md5("part").alias("digest"))


@query(
    "q_txt21_txt25_comps_summary",
    f"""WITH {COMPS_SQL}, r AS (SELECT country || '/' || CAST(pos % 40 AS VARCHAR) AS deal, pos, trim(property_name) || CASE WHEN address IS NULL THEN '' ELSE ' | ' || address END || CASE WHEN sale_type = '' THEN '' ELSE ' | ' || sale_type END || CASE WHEN sale_date = '' THEN '' ELSE ' | ' || sale_date END AS line FROM comps),
n AS (SELECT *, row_number() OVER (PARTITION BY deal ORDER BY pos) AS nth, count(*) OVER (PARTITION BY deal) AS n FROM r)
SELECT deal, md5('### Asset Sales — ' || max(n) || ' comparable(s)' || chr(10) || string_agg(nth || '. ' || line, chr(10) ORDER BY nth) FILTER (nth <= 20)) AS digest FROM n GROUP BY deal""",
)
def comps_summary(spark, sf):
    deal = F.concat("country", F.lit("/"), (F.col("pos") % 40).cast("string"))
    cells = F.array(F.concat(F.lit(" "), "property_name"), F.lit("Source"), "address", F.lit("\n"), "sale_type", "sale_date")
    return br.comps_summary(sale_comps(spark, sf).select(deal.alias("deal"), F.col("pos").alias("ord"), cells.alias("cells")), "Asset Sales").select("deal", F.md5("block").alias("digest"))


_CATEGORIES = ", ".join(f"'{x}'" for x in br.CATEGORY_LABELS)


@query(
    "q_str12_flt5_names",
    rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents WHERE text IS NOT NULL AND regexp_full_match(text, '[\x00-\x7F]*')),
a AS (SELECT doc_id, k, CASE WHEN k % 5 = 0 THEN array_to_string(string_split(line, ' ')[1:5], ' ') WHEN k % 5 = 1 THEN ' Mixed /  Others ' WHEN k % 5 = 2 THEN array_to_string(string_split(line, ' ')[1:2], chr(10) || chr(10)) || chr(10) ELSE line END AS name, CASE WHEN k % 3 = 0 THEN 'about ten or so' ELSE '12.5' END AS price FROM l),
n AS (SELECT *, trim(regexp_replace(name, '\s+', ' ', 'g')) AS n, trim(regexp_replace(regexp_replace(lower(name), '[^\w/ ]', ' ', 'g'), '\s+', ' ', 'g')) AS label FROM a), w AS (SELECT *, len(string_split(n, ' ')) AS words FROM n)
SELECT doc_id, k, CASE WHEN label IN ({_CATEGORIES}) OR trim(regexp_replace(label, '/', ' ', 'g')) IN ({_CATEGORIES}) THEN 'category'
  WHEN words >= 3 AND ((n LIKE '%.' AND NOT regexp_matches(n, '{br.ABBREVIATED}')) OR regexp_matches(n, '{br.DANGLING}') OR (words >= 5 AND regexp_matches(n, '{br.PROSE_WORDS}'))) THEN 'prose'
  WHEN len(string_split(name, chr(10))) >= 4 THEN 'lines' WHEN price LIKE 'about%' THEN 'price' END AS reason FROM w""",
)
def names(spark, sf):
    """Whole lines of documents, their beginnings and labels as the names of records."""
    d = spark.read.parquet(f"{sf}/documents.parquet").where(r"text IS NOT NULL AND text RLIKE '^[\\x00-\\x7F]*\\z'").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("k", "line"))
    words = F.split("line", " ", -1)
    k = F.col("k")
    name = F.when(k % 5 == 0, F.array_join(F.slice(words, 1, 5), " ")).when(k % 5 == 1, " Mixed /  Others ").when(k % 5 == 2, F.concat(F.array_join(F.slice(words, 1, 2), "\n\n"), F.lit("\n"))).otherwise(F.col("line"))
    return d.select("doc_id", "k", br.not_a_name(name, F.when(k % 3 == 0, "about ten or so").otherwise("12.5")).alias("reason"))


# Registries.


@query(
    "q_src23_connectors",
    """WITH c AS (SELECT n_name AS name, n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'R' || CAST(n_regionkey AS VARCHAR) END AS market FROM nation),
d AS (SELECT o_orderkey AS deal, 'R' || CAST(o_custkey % 5 AS VARCHAR) AS market, o_orderstatus AS kind, [o_orderkey % 25, o_orderkey * 7 % 25, o_orderkey % 25, (o_orderkey + 3) % 25, 99] AS keys FROM orders),
e AS (SELECT deal, market, kind, unnest(keys) AS k, generate_subscripts(keys, 1) - 1 AS ord FROM d), f AS (SELECT deal, market, kind, k, min(ord) AS ord FROM e GROUP BY ALL)
SELECT deal, name, CAST(ord AS INTEGER) AS ord FROM f JOIN c USING (k) WHERE (c.market = '' OR c.market = f.market) AND (kind = 'F' OR (kind = 'O' AND k % 2 = 0))""",
)
def connectors(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    key = F.col("n_nationkey")
    c = n.select(F.col("n_name").alias("name"), F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))).alias("market"), F.when(key % 2 == 0, F.array(F.lit("sales"), F.lit("rent"))).otherwise(F.array(F.lit("sales"))).alias("comp_types"))
    o = F.col("o_orderkey")
    keys = F.array(o % 25, o * 7 % 25, o % 25, (o + 3) % 25, F.lit(99).cast("long"))
    d = spark.read.parquet(f"{sf}/orders.parquet").select(o.alias("deal"), F.concat(F.lit("R"), (F.col("o_custkey") % 5).cast("string")).alias("market"), F.when(F.col("o_orderstatus") == "F", "sales").when(F.col("o_orderstatus") == "O", "rent").otherwise("land").alias("comp_type"), keys.alias("keys"))
    # the nations are one row, a map of their names, and a deal's keys are named in its row
    known = n.where(key.isNotNull()).agg(F.map_from_entries(F.collect_set(F.struct(key.cast("long"), "n_name"))).alias("known"))
    named = d.crossJoin(F.broadcast(known)).select("deal", "market", "comp_type", F.transform("keys", lambda k: F.coalesce(F.try_element_at("known", k), F.lit("unknown"))).alias("enabled"))
    return br.available_connectors(named, c)


_READ = "CASE c_custkey % 6 WHEN 1 THEN years <> 60 WHEN 2 THEN years > 12 ELSE true END"


@query(
    "q_src29_lease_table_text",
    f"""WITH {FACTOR_SQL}, r AS (SELECT c_custkey AS report, years, CASE WHEN c_custkey % 6 = 3 AND years = 30 THEN 61.5 ELSE round(factor * 100, 4) END AS percent FROM customer, factors WHERE {_READ}),
v AS (SELECT report, count(*) AS rows, count(*) FILTER ((years = 30 AND percent = 60) OR (years = 60 AND percent = 80) OR (years = 99 AND percent = 96)) AS hits FROM r GROUP BY report)
SELECT r.report, CAST(years AS INTEGER) AS years, percent::DOUBLE AS percent FROM r JOIN v USING (report) WHERE rows >= 90 AND hits = 3""",
)
def lease_text(spark, sf):
    return br.lease_tables(_lease_texts(spark, sf))[0]


@query(
    "q_src29_lease_table_verdicts",
    "SELECT c_custkey AS report, CASE c_custkey % 6 WHEN 1 THEN 98 WHEN 2 THEN 87 ELSE 99 END AS rows, CASE c_custkey % 6 WHEN 1 THEN 'checkpoint' WHEN 2 THEN 'too few rows' WHEN 3 THEN 'checkpoint' ELSE 'ok' END AS verdict FROM customer",
)
def lease_verdicts(spark, sf):
    return br.lease_tables(_lease_texts(spark, sf))[1]


def _lease_texts(spark, sf):
    """A lease table's text for each customer: three columns of pairs; some lack a checkpoint or many rows, give a wrong percentage, or an earlier one that is corrected."""
    key = F.col("c_custkey") % 6
    entries = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(f"{f * 100:.4f}").alias("p")) for n, f in factor_rows()])
    kept = F.filter(entries, lambda e: F.when(key == 1, e["n"] != 60).when(key == 2, e["n"] > 12).otherwise(True))
    pairs = F.transform(kept, lambda e, i: F.concat(e["n"].cast("string"), F.lit("  "), F.when((key == 3) & (e["n"] == 30), "61.50").otherwise(e["p"]), F.when(i % 3 == 2, "\n").otherwise(" ")))
    before = F.when(key == 4, F.lit("Draft: 30 12.34 and 100 99.9\n")).otherwise("Years Percent\n")
    return spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("report"), F.concat(before, F.array_join(pairs, ""), F.lit("\nn above 99: 0 0.0")).alias("text"))


@query(
    "q_spa11_zone_lookup",
    f"""WITH {COMPS_SQL} SELECT pos, CASE WHEN pos % 7 = 0 THEN NULL WHEN pos % 7 = 1 THEN 'C' WHEN pos % 7 = 2 THEN 'W' WHEN pos % 7 = 3 THEN CASE land_zoning WHEN 'Commercial' THEN 'C' WHEN 'Business 1' THEN 'B1' WHEN 'Hotel' THEN 'H' WHEN 'Business Park' THEN 'BP' ELSE 'C' END
  WHEN pos % 7 = 4 THEN 'B1-W' ELSE 'OS' END AS zone FROM comps""",
)
def zone_lookup(spark, sf):
    """Answers by key: none, a part of a name, an unknown name before a known one, the record's own zoning, a whole name, a name that comes first in the list."""
    comps = sale_comps(spark, sf).select("pos", "land_zoning")
    m = F.col("pos") % 7
    first = F.when(m == 1, "a Commercial area").when(m == 2, "somewhere").when(m == 3, F.col("land_zoning")).when(m == 4, " Business 1 - White ").otherwise("Car park and open spaces")
    answers = comps.where(m != 0).select("pos", F.lit(0).alias("ord"), first.alias("name")).unionByName(comps.where(m.isin(2, 4)).select("pos", F.lit(1).alias("ord"), F.lit("WHITE").alias("name")))
    return br.zones_by_lookup(comps, answers)


@query("q_cfg3_deal_listing", "SELECT 'Deal ' || CAST(c_custkey // 3 AS VARCHAR) AS deal_name, max('configs/deal_config_' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '.json') AS path FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 GROUP BY c_custkey // 3")
def listing(spark, sf):
    key = F.col("c_custkey")
    name = F.concat(F.lit("Deal "), F.floor(key / 3).cast("string"))
    whole = F.to_json(F.struct(F.struct(name.alias("deal_name"), F.col("c_name").alias("address")).alias("subject_property")))
    json = F.when(key % 11 == 0, "{not json").when(key % 13 == 0, '{"subject_property": {}}').otherwise(whole)
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.concat(F.lit("configs/deal_config_"), F.lpad(key.cast("string"), 9, "0"), F.lit(".json")).alias("path"), json.alias("json"))
    return br.deal_listing(c)
