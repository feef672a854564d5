"""Queries of edits, change logs, lineage, page chunks, budgeted contexts, header folds and the claim cascade."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import context as cx
from evidentia.operators import edits as ed
from evidentia.operators import grids
from evidentia.operators import lineage as ln
from evidentia.operators import retrieval as rt
from evidentia.plans.register import query
from evidentia.sources.surrogate import COMPS_SQL, sale_comps


def _docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# Edits: each country is a deal, an order's key its marker; one table line in seven is gone, others are changed by key.

_FIELDS = {"gfa_sf": "whole", "price_m": "number", "npi_yield": "number", "sale_type": "text"}


@query(
    "q_snk13_table_edits",
    f"""WITH {COMPS_SQL}, r AS (SELECT country AS deal, pos, CAST(pos AS VARCHAR) AS marker, property_name, address, gfa_sf::DOUBLE AS gfa_sf, price_m::DOUBLE AS price_m, npi_yield, sale_type, lon::DOUBLE AS lon, lat::DOUBLE AS lat FROM comps),
o AS (SELECT deal, marker,
    CASE WHEN pos % 9 = 1 THEN 'Renamed ' || property_name ELSE property_name END AS property_name, CASE WHEN pos % 6 = 1 THEN '' ELSE coalesce(address, '') END AS address,
    CASE WHEN pos % 4 = 1 THEN 1000 + pos ELSE gfa_sf END AS gfa_sf, CASE WHEN pos % 10 = 5 THEN 12.5 WHEN pos % 5 = 2 THEN 1234.5 ELSE price_m END AS price_m, CASE WHEN pos % 3 = 1 THEN 4.25 / 100 ELSE npi_yield END AS npi_yield, sale_type,
    CASE WHEN pos % 9 = 1 OR (pos % 6 = 1 AND address IS NOT NULL) THEN NULL ELSE lon END AS lon, CASE WHEN pos % 9 = 1 OR (pos % 6 = 1 AND address IS NOT NULL) THEN NULL ELSE lat END AS lat, pos,
    gfa_sf AS old_gfa, price_m AS old_price, npi_yield AS old_yield, r.property_name AS old_name, r.address AS old_address FROM r),
c AS (SELECT *, CASE WHEN pos % 7 = 3 THEN 'removed' WHEN property_name <> old_name OR address <> coalesce(old_address, '') OR gfa_sf IS DISTINCT FROM old_gfa OR price_m IS DISTINCT FROM old_price OR npi_yield IS DISTINCT FROM old_yield THEN 'updated' ELSE 'kept' END AS change FROM o),
old AS (SELECT c.deal, c.marker, old_name AS property_name, r.address, old_gfa AS gfa_sf, old_price AS price_m, old_yield AS npi_yield, r.sale_type, r.lon, r.lat, c.change FROM c JOIN r USING (pos) WHERE c.change = 'removed')
SELECT deal, marker, property_name, address, gfa_sf, price_m, npi_yield, sale_type, lon, lat, change FROM c WHERE change <> 'removed' UNION ALL SELECT * FROM old
UNION ALL SELECT country, NULL, 'New ' || property_name, '', NULL, 77.5, NULL, NULL, NULL, NULL, 'added' FROM comps WHERE pos % 11 = 4""",
)
def table_edits(spark, sf):
    """Inserts, updates, deletes and conflicting lines at once: each shown as its table would show it."""
    r = sale_comps(spark, sf).select(F.col("country").alias("deal"), "pos", F.col("pos").cast("string").alias("marker"), "property_name", "address", F.col("gfa_sf").cast("double").alias("gfa_sf"), F.col("price_m").cast("double").alias("price_m"), "npi_yield", "sale_type", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    p = F.col("pos")
    shown = r.where("pos % 7 <> 3").select(
        "deal", p.alias("line"), "marker", F.when(p % 9 == 1, F.concat(F.lit("Renamed\n"), "property_name")).otherwise(F.col("property_name")).alias("property_name"), F.when(p % 6 == 1, "—").otherwise(F.coalesce("address", F.lit("nan"))).alias("address"),
        F.when(p % 4 == 1, F.format_number((1000 + p).cast("double") + 0.75, 2)).otherwise("—").alias("gfa_sf"), F.when(p % 5 == 2, "1,234.50").when(p % 10 == 5, "9.0").otherwise("n/a").alias("price_m"), F.when(p % 3 == 1, "4.25%").otherwise("").alias("npi_yield"), F.lit("None").alias("sale_type"),
    )
    # a second line of the same marker fills one cell only
    again = r.where("pos % 7 <> 3 AND pos % 10 = 5").select("deal", (p + 10_000_000).alias("line"), "marker", F.lit("").alias("property_name"), F.when(p % 6 == 1, "—").otherwise(F.coalesce("address", F.lit(""))).alias("address"), F.lit("").alias("gfa_sf"), F.lit(" 12.5 ").alias("price_m"), F.lit("—").alias("npi_yield"), F.lit("").alias("sale_type"))
    new = r.where("pos % 11 IN (4, 5)").select("deal", (p + 20_000_000).alias("line"), F.when(p % 2 == 0, "★").otherwise("no such").alias("marker"), F.concat(F.lit("New "), "property_name").alias("property_name"), F.lit("").alias("address"), F.lit("").alias("gfa_sf"), F.when(p % 11 == 4, "77.5").otherwise("0").alias("price_m"), F.lit("").alias("npi_yield"), F.lit("").alias("sale_type"))
    return ed.merge_edits(r.drop("pos"), shown.unionByName(again).unionByName(new), _FIELDS, "price_m").select("deal", "marker", "property_name", "address", "gfa_sf", "price_m", "npi_yield", "sale_type", "lon", "lat", "change")


@query(
    "q_snk12_metadata_sync",
    f"""WITH {COMPS_SQL}, p AS (SELECT property_name, first(CASE WHEN pos % 3 = 0 THEN NULL ELSE lon::DOUBLE + 0.001 END ORDER BY pos DESC) AS plon, first(CAST(pos % 100 AS INTEGER) ORDER BY pos DESC) AS pmarker FROM comps WHERE length(property_name) % 4 <> 0 AND pos % 2 = 1 GROUP BY property_name)
SELECT pos, c.property_name, coalesce(plon, lon::DOUBLE) AS lon, pmarker AS map_marker, coalesce(plon, lon::DOUBLE) IS DISTINCT FROM lon::DOUBLE OR pmarker IS DISTINCT FROM relevance_score AS touched FROM comps c JOIN p ON c.property_name = p.property_name""",
)
def metadata_sync(spark, sf):
    saved = sale_comps(spark, sf).select("pos", "property_name", F.col("lon").cast("double").alias("lon"), F.col("relevance_score").cast("int").alias("map_marker"))
    processed = saved.where("length(property_name) % 4 <> 0 AND pos % 2 = 1").select("pos", "property_name", F.when(F.col("pos") % 3 != 0, F.col("lon") + 0.001).alias("lon"), (F.col("pos") % 100).cast("int").alias("map_marker"))
    return ed.sync_metadata(saved, processed, ["lon", "map_marker"])


@query(
    "q_prv9_change_log",
    """WITH last AS (SELECT user_id AS marker, arg_max(event_type, event_id) FILTER (event_type IN ('error', 'signup')) AS life, arg_max(event_type, event_id) FILTER (event_type IN ('click', 'view')) AS sight, arg_max(CAST(floor(value) AS INTEGER) % 7, event_id) FILTER (event_type = 'purchase') AS paint FROM events GROUP BY user_id)
SELECT p_partkey AS marker, coalesce(sight = 'click', false) AS hidden, coalesce('shade ' || paint, CASE WHEN p_size < 10 THEN 'grey' ELSE 'red' END) AS colour FROM part LEFT JOIN last ON p_partkey = marker WHERE coalesce(life <> 'error', true)""",
)
def change_log(spark, sf):
    """Deletions (error), restorations (signup), hidings (click), showings (view) and colours (purchase) of parts, replayed in order."""
    kind = F.col("event_type")
    kind = F.when(kind == "error", "delete").when(kind == "signup", "restore").when(kind == "click", "hide").when(kind == "purchase", "recolour").otherwise("show")
    shade = F.concat(F.lit("shade "), (F.floor("value").cast("int") % 7).cast("string"))
    log = spark.read.parquet(f"{sf}/events.parquet").select((F.col("user_id") % 50).alias("deal"), F.col("user_id").alias("marker"), F.col("event_id").alias("seq"), kind.alias("kind"), shade.alias("value"))
    records = spark.read.parquet(f"{sf}/part.parquet").select((F.col("p_partkey") % 50).alias("deal"), F.col("p_partkey").alias("marker"), "p_size")
    return ed.apply_log(records, log, F.when(F.col("p_size") < 10, "grey").otherwise("red")).select("marker", "hidden", "colour")


@query(
    "q_prv11_cached_verdicts",
    """WITH u AS (SELECT doc_id AS upload, source AS name, n_chars AS bytes FROM documents), k AS (SELECT source AS name, n_chars AS bytes, first(lang ORDER BY doc_id) AS verdict FROM documents WHERE doc_id % 3 = 0 GROUP BY ALL)
SELECT upload, verdict, verdict IS NULL AND upload = min(upload) OVER (PARTITION BY u.name, u.bytes) AS todo FROM u LEFT JOIN k ON u.name IS NOT DISTINCT FROM k.name AND u.bytes = k.bytes""",
)
def cached(spark, sf):
    d = _docs(spark, sf)
    cache = d.where("doc_id % 3 = 0").select(F.col("source").alias("name"), F.col("n_chars").alias("bytes"), F.col("doc_id").alias("seq"), F.col("lang").alias("verdict"))
    return ed.cached_verdicts(d.select(F.col("doc_id").alias("upload"), F.col("source").alias("name"), F.col("n_chars").alias("bytes")), cache).select("upload", "verdict", "todo")


# Lineage: records read off pages; a page is a document, its fields are words drawn from it by position, some altered.

@query(
    "q_prv2_lineage_audit",
    f"""WITH {COMPS_SQL}, t AS (SELECT source, pos, gfa_sf IS NOT NULL AND pos % 4 < 2 AS g, price_m IS NOT NULL AND pos % 4 < 2 AS p, CASE WHEN pos % 4 = 2 THEN pos % 6 END AS page FROM comps),
x AS (SELECT *, CASE WHEN g OR p THEN 'cell' WHEN coalesce(page, 0) <> 0 THEN 'page' ELSE 'none' END AS tier FROM t), n AS (SELECT source, tier, count(*) AS records, count(*) FILTER (g) AS ng, count(*) FILTER (p) AS np FROM x GROUP BY ALL)
SELECT source, tier, NULL AS field, records, 0 AS known FROM n WHERE tier <> 'cell' UNION ALL SELECT source, tier, 'gfa_sf', records, ng FROM n WHERE tier = 'cell' AND ng > 0 UNION ALL SELECT source, tier, 'price_m', records, np FROM n WHERE tier = 'cell' AND np > 0""",
)
def lineage_audit(spark, sf):
    place = lambda i: F.struct((F.col("pos") % 30).cast("int").alias("page"), F.lit(0).alias("table"), (F.col("pos") % 50).cast("int").alias("line"), F.lit(i).alias("column"))
    entries = F.array_compact(F.array(*[F.when(F.col(f).isNotNull() & (F.col("pos") % 4 < 2), F.struct(F.lit(f).alias("key"), place(i).alias("value"))) for i, f in enumerate(("gfa_sf", "price_m"))]))
    page = F.when(F.col("pos") % 4 == 2, F.col("pos") % 6)
    return ln.audit(sale_comps(spark, sf).select("source", "pos", F.map_from_entries(entries).alias("prov"), page.alias("prov_page")))


_PAGE_WORDS = r"[^\x20\x09-\x0D]+"


@query(
    "q_prv4_bound_fields",
    rf"""WITH d AS (SELECT doc_id, regexp_extract_all(text, '{_PAGE_WORDS}') AS w, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS ctx FROM documents WHERE len(regexp_extract_all(text, '{_PAGE_WORDS}')) > 0),
f AS (SELECT doc_id, ctx, replace(ctx, ',', '') AS bare, '  ' || array_to_string(w[1:2], '   ') AS name, CASE WHEN doc_id % 3 = 0 THEN replace(w[1 + CAST(doc_id % len(w) AS INTEGER)], ',', '') || ',' ELSE w[len(w)] END AS price, CASE WHEN doc_id % 5 = 0 THEN 'zq' || w[1] ELSE w[1 + CAST(doc_id * 7 % len(w) AS INTEGER)] END AS gfa_sf FROM d),
k AS (SELECT doc_id, contains(ctx, lower(trim(regexp_replace(name, '\s+', ' ', 'g')))) AS kn, contains(ctx, lower(price)) OR contains(bare, replace(lower(price), ',', '')) AS kp, contains(ctx, lower(gfa_sf)) OR contains(bare, replace(lower(gfa_sf), ',', '')) AS kg, name, price, gfa_sf FROM f)
SELECT doc_id AS page, CASE WHEN kp THEN price END AS price, CASE WHEN kg THEN gfa_sf END AS gfa_sf, CAST(NOT kp AS INTEGER) + CAST(NOT kg AS INTEGER) AS dropped FROM k WHERE kn AND (kp OR kg)""",
)
def bound_fields(spark, sf):
    """A row is read off every page: a name in other spacing, a price and an area, some of which the page does not hold."""
    w = F.regexp_extract_all("text", F.lit(_PAGE_WORDS), F.lit(0))
    d = _docs(spark, sf).select("doc_id", w.alias("w")).where(F.size("w") > 0)
    at = lambda i: F.get("w", i.cast("int"))
    name = F.concat(F.lit("  "), F.array_join(F.slice("w", 1, 2), "   "))
    price = F.when(F.col("doc_id") % 3 == 0, F.concat(F.replace(at(F.col("doc_id") % F.size("w")), F.lit(","), F.lit("")), F.lit(","))).otherwise(F.element_at("w", -1))
    area = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("zq"), F.element_at("w", 1))).otherwise(at(F.col("doc_id") * 7 % F.size("w")))
    rows = d.select(F.col("doc_id").alias("row"), F.col("doc_id").alias("page"), F.create_map(F.lit("property_name"), name, F.lit("price"), price, F.lit("gfa_sf"), area).alias("fields"))
    out = ln.bind_to_pages(rows, _docs(spark, sf).select(F.col("doc_id").alias("page"), "text"), ["price", "gfa_sf"])
    return out.select("page", F.element_at("fields", "price").alias("price"), F.element_at("fields", "gfa_sf").alias("gfa_sf"), "dropped")


@query(
    "q_prv5_fixed_names",
    f"""WITH {COMPS_SQL}, v AS (SELECT pos, property_name, replace(replace(property_name, 'o', '0'), 'l', 'I') AS alike, pos % 4 AS m FROM comps)
SELECT pos, CASE WHEN m IN (0, 1) AND alike <> property_name THEN alike ELSE property_name END AS property_name, CASE WHEN m = 3 THEN NULL WHEN m IN (0, 1) AND alike <> property_name THEN 'fixed' ELSE 'blocked' END AS fix FROM v""",
)
def fixed_names(spark, sf):
    """Verdicts on names: look-alikes, a rewrite before a look-alike, a rewrite alone, none."""
    comps = sale_comps(spark, sf).select("pos", "property_name")
    alike = F.replace(F.replace(F.col("property_name"), F.lit("o"), F.lit("0")), F.lit("l"), F.lit("I"))
    m = F.col("pos") % 4
    verdicts = comps.where(m < 2).select("pos", F.lit(2).alias("seq"), alike.alias("corrected"))
    verdicts = verdicts.unionByName(comps.where(m.isin(1, 2)).select("pos", F.lit(1).alias("seq"), F.concat("property_name", F.lit(" Block")).alias("corrected"))).unionByName(comps.where(m == 0).select("pos", F.lit(0).alias("seq"), F.lit("").alias("corrected")))
    return ln.fix_names(comps, verdicts).select("pos", "property_name", "fix")


# Pages and contexts: every third line of a document begins a page; documents of a source share a budget.

_VERBS_SQL = "[" + ", ".join(f"'{v}'" for v in rt.FINITE_VERBS) + "]"


#: Lines (key, k, line) of a text to kinds, as the prose rules have it.
_KINDS_SQL = rf"""w AS (SELECT *, string_split_regex(line, '\s+') AS w FROM p),
t AS (SELECT * EXCLUDE (w), CASE WHEN line = '' THEN 'break' WHEN len(w) < 3 THEN 'drop' WHEN starts_with(line, '©') OR regexp_matches(lower(line), '^(source|note):') THEN 'drop' WHEN line = upper(line) THEN 'break'
  WHEN list_has_any(list_transform(w, lambda x: lower(trim(x, '.,;:()[]%$''"'))), list_concat({_VERBS_SQL}, ['the'])) THEN 'keep' WHEN len(w) >= 4 AND regexp_matches(line, '\d+\.\d+|\d+%|[1-9][\d,]{{4,}}') AND regexp_matches(line, '[A-Za-z]{{3,}}') THEN 'keep' ELSE 'drop' END AS kind FROM w)"""


@query(
    "q_flt19_prose_filter",
    f"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS k, trim(raw) AS line FROM documents WHERE text IS NOT NULL), {_KINDS_SQL},
b AS (SELECT doc_id, k, line, kind, count(*) FILTER (kind = 'break') OVER (PARTITION BY doc_id ORDER BY k) AS para FROM t), g AS (SELECT doc_id, para, string_agg(line, ' ' ORDER BY k) AS txt FROM b WHERE kind = 'keep' GROUP BY ALL),
c AS (SELECT doc_id, string_agg(txt, chr(10) || chr(10) ORDER BY para) AS txt FROM g GROUP BY doc_id), f AS (SELECT d.doc_id, CASE WHEN text IS NULL THEN NULL WHEN length(txt) >= 80 THEN txt ELSE '' END AS kept FROM documents d LEFT JOIN c USING (doc_id))
SELECT doc_id, length(kept) AS n_chars, md5(kept) AS digest FROM f""",
)
def prose(spark, sf):
    kept = _docs(spark, sf).select("doc_id", rt.prose_lines(F.col("text")).alias("kept"))
    return kept.select("doc_id", F.length("kept").cast("long").alias("n_chars"), F.md5("kept").alias("digest"))


@query(
    "q_src25_page_chunks",
    rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, k, CAST(1 + k // 3 AS INTEGER) AS page, trim(regexp_replace(line, '[\x{{3000}}-\x{{303f}}\x{{3400}}-\x{{9fff}}\x{{ff00}}-\x{{ffef}}]+', ' ', 'g')) AS line FROM l),
{_KINDS_SQL},
b AS (SELECT doc_id, page, k, line, kind, count(*) FILTER (kind = 'break') OVER (PARTITION BY doc_id, page ORDER BY k) AS para FROM t),
g AS (SELECT doc_id, page, para, string_agg(line, ' ' ORDER BY k) AS txt FROM b WHERE kind = 'keep' GROUP BY ALL), c AS (SELECT doc_id, page, string_agg(txt, chr(10) || chr(10) ORDER BY para) AS txt FROM g GROUP BY ALL)
SELECT doc_id, page, length(txt) AS n_chars, md5(txt) AS digest FROM c WHERE length(txt) >= 80""",
)
def page_chunks(spark, sf):
    """Documents whose every third line begins a page, chunked by their page marks."""
    marked = F.array_join(F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("[PAGE "), (F.floor(i / 3) + 1).cast("string"), F.lit("]\n"), x)).otherwise(x)), "\n")
    out = cx.page_chunks(_docs(spark, sf).select("doc_id", marked.alias("text")))
    return out.select("doc_id", "page", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query(
    "q_txt22_context",
    f"""WITH d AS (SELECT source, doc_id, lang, coalesce(text, '') AS text, coalesce(sum(length(coalesce(text, ''))) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
SELECT source, doc_id, CASE WHEN before >= 30000 THEN 'omitted' WHEN before + length(text) > 30000 THEN 'cut' ELSE 'whole' END AS state,
  md5(chr(10) || '[FILE: ' || coalesce(lang, '') || ']' || chr(10) || CASE WHEN before >= 30000 THEN '{cx.OMITTED}' ELSE substr(text, 1, CAST(30000 - before AS BIGINT)) END) AS digest FROM d""",
)
def stuffed(spark, sf):
    d = _docs(spark, sf).select(F.coalesce("source", F.lit("")).alias("source"), "doc_id", "lang", "text")
    return cx.stuffed(d, "source", "doc_id", "lang", 30_000, stretch=256).select("source", "doc_id", "state", F.md5("part").alias("digest"))


@query(
    "q_txt19_table_context",
    """WITH p AS (SELECT user_id AS owner, event_id AS page, '[Page ' || event_id || ' table]' || chr(10) || 'Kind | Props | Amount' || chr(10) || event_type || ' | ' || props || ' | ' || CAST(floor(value) AS BIGINT) || chr(10) || 'total |  | ' || event_id AS part FROM events),
b AS (SELECT *, coalesce(sum(length(part) + 2) OVER (PARTITION BY owner ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT owner, md5(substr(string_agg(part, chr(10) || chr(10) ORDER BY page), 1, 14000)) AS digest, least(14000, length(string_agg(part, chr(10) || chr(10) ORDER BY page))) AS n_chars FROM b WHERE before < 14000 GROUP BY owner""",
)
def table_context(spark, sf):
    rows = F.array(F.array("event_type", "props", F.floor("value").cast("string")), F.array(F.lit("total"), F.lit(None).cast("string"), F.col("event_id").cast("string")))
    t = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("owner"), F.col("event_id").alias("page"), F.array(*map(F.lit, ("Kind", "Props", "Amount"))).alias("headers"), rows.alias("rows"))
    return cx.table_context(t, "owner").select("owner", F.md5("context").alias("digest"), F.length("context").cast("long").alias("n_chars"))


# Header folds: a sheet per customer with none to three rows of units below its header, by key.

_UNITS = "CASE c_custkey % 3 WHEN 0 THEN 'SGD' WHEN 1 THEN 'S$' ELSE 'psf' END"
_HEADS_SQL = f"""WITH RECURSIVE none AS (SELECT 1), h AS (SELECT c_custkey AS table_id, c_custkey % 6 AS kind, {_UNITS} AS unit FROM customer)"""


@query(
    "q_win13_folded_headers",
    f"""{_HEADS_SQL} SELECT table_id, 0 AS row, CASE kind WHEN 0 THEN 'Property|Price|Unit|Buyer' WHEN 1 THEN 'Property|Price (' || unit || ' million)|Unit (' || unit || '/psf)|Buyer' WHEN 2 THEN 'Property|Price (SGD million)|Unit Price (' || unit || '/psf)|Buyer'
  WHEN 3 THEN 'Property|Price (' || unit || ')|Unit|Buyer (note 7)' WHEN 4 THEN 'Property|Price|Unit|Buyer' ELSE 'Property|Price (m) (sqm|Unit nla)|Buyer' END AS cells, CASE kind WHEN 0 THEN 0 WHEN 2 THEN 2 WHEN 4 THEN 0 WHEN 5 THEN 2 ELSE 1 END AS folded FROM h
UNION ALL SELECT table_id, 1, '|(' || unit || ' 5|Price|', 0 FROM h WHERE kind = 4
UNION ALL SELECT o_custkey, CAST(o_orderkey + 10 AS INTEGER), 'Tower ' || CAST(o_orderkey % 90 AS VARCHAR) || '|' || CAST(o_orderkey % 77 AS VARCHAR) || '|(SGD)|', 0 FROM orders""",
)
def folded_headers(spark, sf):
    """Kinds of rows below a header: none, one of units, two wrapped ones, a bracket with a digit, a tail with a digit (stays), units then a tail without one."""
    c = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey AS table_id", "c_custkey % 6 AS kind", f"{_UNITS} AS unit")
    row = lambda *cells: F.array(*[x if not isinstance(x, str) else F.lit(x) for x in cells])
    unit = lambda pattern: F.format_string(pattern, "unit")
    head = row("Property", "Price", " Unit ", "Buyer")
    below = {
        0: F.array(head), 1: F.array(head, row("", unit("(%s million)"), unit("(%s/psf)"), "")), 2: F.array(head, row("", "(SGD", "Price", ""), row("", "million)", unit("(%s/psf)"), "")),
        3: F.array(head, row("", unit("(%s)"), F.lit(None).cast("string"), "(note 7)")), 4: F.array(head, row("", unit("(%s 5"), "Price", "")), 5: F.array(head, row("", "(m)", "", ""), row("", "(sqm", "nla)", "")),
    }
    stack = below[0]
    for k in range(1, 6):
        stack = F.when(F.col("kind") == k, below[k]).otherwise(stack)
    top = c.select("table_id", F.posexplode(stack).alias("row", "cells"))
    o = spark.read.parquet(f"{sf}/orders.parquet")
    body = o.select(F.col("o_custkey").alias("table_id"), (F.col("o_orderkey") + 10).cast("int").alias("row"), F.array(F.concat(F.lit("Tower "), (F.col("o_orderkey") % 90).cast("string")), (F.col("o_orderkey") % 77).cast("string"), F.lit("(SGD)"), F.lit("")).alias("cells"))
    heads = c.select("table_id", F.lit(0).alias("header"))
    out = grids.fold_headers(top.unionByName(body), heads)
    return out.select("table_id", "row", F.array_join(F.transform("cells", lambda x: F.coalesce(x, F.lit(""))), "|").alias("cells"), "folded")


# The cascade: benchmark passages and sentences made of comparables, against documents, vectors and deals.

_CLAIMS_SQL = f"""{COMPS_SQL}, claims AS (SELECT item_id AS claim_id, text, 'N' || CAST(item_id % 25 AS VARCHAR) AS deal, embedding FROM benchmark LEFT JOIN (SELECT vec_id, first(embedding) AS embedding FROM embeddings GROUP BY vec_id) ON vec_id = item_id AND item_id % 2 = 0
  UNION ALL SELECT 1000000 + pos, 'Last year ' || CASE WHEN pos % 20 = 0 THEN property_name ELSE 'the tower' END || ' sold for about ' || CAST(pos % 40 AS VARCHAR) || '.0 million', country, NULL FROM comps WHERE pos % 10 = 0)"""


@query(
    "q_jon13_claim_cascade",
    f"""WITH {_CLAIMS_SQL}, held AS (SELECT claim_id, min(doc_id) AS source FROM claims JOIN documents d ON contains(d.text, claims.text) GROUP BY claim_id),
s AS (SELECT claim_id, e.vec_id, list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score FROM claims c JOIN embeddings e ON e.vec_id <> claim_id WHERE c.embedding IS NOT NULL AND claim_id NOT IN (SELECT claim_id FROM held)),
near AS (SELECT claim_id, arg_max(vec_id, (score, -vec_id)) AS source, max(score) AS score FROM s GROUP BY claim_id HAVING max(score) >= 0.3),
last AS (SELECT claim_id, c.text, n_nationkey AS k FROM claims c LEFT JOIN nation ON deal = 'N' || CAST(n_nationkey AS VARCHAR) WHERE claim_id NOT IN (SELECT claim_id FROM held) AND claim_id NOT IN (SELECT claim_id FROM near)),
f AS (SELECT claim_id, k, replace(text, ',', '') AS bare, lower(text) AS small, list_transform(regexp_extract_all(text, '\\d+(?:\\.\\d+)?'), lambda x: CAST(x AS DOUBLE)) AS found FROM last),
v AS (SELECT *, (k + 1)::DOUBLE AS price FROM f),
y AS (SELECT claim_id, coalesce(contains(small, 'tower ' || k) OR contains(bare, CAST(k + 1 AS VARCHAR)) OR contains(bare, printf('%.1f', price)) OR contains(bare, printf('%.1f', price * 100))
  OR len(list_filter(found, lambda t: t > 0 AND len(list_filter([price, price * 100], lambda a: len(list_filter([a, a * 1000, a / 1000, a * 1000000, a / 1000000], lambda z: abs(z - t) / t <= 0.03)) > 0)) > 0)) > 0, false) AS stated FROM v)
SELECT claim_id, 'contained' AS citation, source, NULL::DOUBLE AS score FROM held UNION ALL SELECT claim_id, 'similar', source, round(score, 6) FROM near UNION ALL SELECT claim_id, CASE WHEN stated THEN 'deal config' ELSE 'unverified' END, NULL, NULL FROM y""",
)
def claim_cascade(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    one = vectors.groupBy("vec_id").agg(F.first("embedding").alias("embedding"))
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("claim_id"), "text", F.concat(F.lit("N"), (F.col("item_id") % 25).cast("string")).alias("deal"))
    bench = bench.join(one, (F.col("vec_id") == F.col("claim_id")) & (F.col("claim_id") % 2 == 0), "left").drop("vec_id")
    p = F.col("pos")
    sentence = F.concat(F.lit("Last year "), F.when(p % 20 == 0, F.col("property_name")).otherwise("the tower"), F.lit(" sold for about "), (p % 40).cast("string"), F.lit(".0 million"))
    made = sale_comps(spark, sf).where("pos % 10 = 0").select((p + 1_000_000).alias("claim_id"), sentence.alias("text"), F.col("country").alias("deal"), F.lit(None).cast(bench.schema["embedding"].dataType).alias("embedding"))
    key = F.col("n_nationkey")
    configs = spark.read.parquet(f"{sf}/nation.parquet").select(F.concat(F.lit("N"), key.cast("string")).alias("deal"), F.struct((key + 1).cast("double").alias("price_sgd_m"), F.concat(F.lit("Tower "), key.cast("string")).alias("property_name")).alias("config"))
    out = rt.cascade(bench.unionByName(made), _docs(spark, sf), vectors, configs, 0.3, ("price_sgd_m",), ("property_name",))
    return out.withColumn("score", F.round("score", 6))
