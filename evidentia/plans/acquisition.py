"""Queries of cited clauses, composed acquisition, page discovery, registry quarters and rent reshape."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import acquisition as aq
from evidentia.plans.register import query
from evidentia.sources.surrogate import COMPS_SQL, LEASES_SQL, leases, sale_comps


def _docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@query(
    "q_txt16_cited_clauses",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[\[\]()#]')),
g AS (SELECT *, count(*) FILTER (k % 4 IN (0, 2)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS span FROM l),
c AS (SELECT doc_id, span, max(k) FILTER (k % 4 IN (0, 2)) AS cite_k, string_agg(CASE WHEN k % 4 = 1 THEN line || ' see here' ELSE line END, chr(10) ORDER BY k) AS body FROM g GROUP BY doc_id, span),
t AS (SELECT doc_id, span, cite_k, regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '') AS body FROM c WHERE cite_k IS NOT NULL)
SELECT doc_id, 'https://s.example/' || cite_k AS url, md5(body) AS digest FROM t WHERE body <> '' AND cite_k % 8 <> 4""",
)
def cited_clauses(spark, sf):
    """Lines of documents, every second one followed by its source (some without an address), one in four holding a link and one in four a heading mark."""
    i = lambda k: k.cast("string")
    cite = lambda k: F.concat(F.lit(" ([site "), i(k), F.lit("]("), F.when(k % 8 == 4, "").otherwise(F.concat(F.lit("https://s.example/"), i(k))), F.lit("))"))
    mark = lambda x, k: F.when(k % 4 == 0, F.concat(x, cite(k))).when(k % 4 == 1, F.concat(x, F.lit(" [see here](https://x.example)"))).when(k % 4 == 2, F.concat(F.lit("## "), x, cite(k))).otherwise(x)
    d = _docs(spark, sf).where(r"text IS NOT NULL AND NOT text RLIKE '[\\[\\]()#]'")
    body = F.array_join(F.transform(F.split("text", "\n", -1), mark), "\n")
    return d.select("doc_id", F.explode(aq.cited_clauses(body)).alias("s")).select("doc_id", "s.url", F.md5("s.text").alias("digest"))


_ACQ_SQL = f"""{COMPS_SQL}, links AS (SELECT page_id % 20 AS deal, url, min('Report ' || page_id) AS title FROM pages GROUP BY page_id % 20, url),
v AS (SELECT page_id % 20 AS deal, url, min(page_id % 7) AS ord FROM pages WHERE page_id % 4 <> 1 GROUP BY ALL), f AS (SELECT url, max(length(trim(text, ' '))) AS chars FROM pages JOIN documents ON doc_id = page_id WHERE page_id % 3 <> 0 GROUP BY url),
x AS (SELECT url, pos, property_name FROM pages JOIN comps ON pos % 400 = page_id WHERE page_id % 5 <> 0), n AS (SELECT url, count(*) AS records FROM x GROUP BY url),
p AS (SELECT l.*, ord, CASE WHEN ord IS NOT NULL THEN row_number() OVER (PARTITION BY l.deal ORDER BY ord, l.url) END AS place FROM links l LEFT JOIN v ON v.deal = l.deal AND v.url = l.url),
r AS (SELECT deal, p.url, title, coalesce(chars, 0) AS chars, coalesce(records, 0) AS records, CASE WHEN ord IS NULL THEN 'not picked' WHEN place > 4 THEN 'over the limit' WHEN coalesce(records, 0) > 0 THEN 'read' WHEN coalesce(chars, 0) < 200 THEN 'no text' ELSE 'no named deals' END AS status FROM p LEFT JOIN f ON f.url = p.url LEFT JOIN n ON n.url = p.url)"""


def _acquired(spark, sf):
    pages, docs, comps = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url"), _docs(spark, sf), sale_comps(spark, sf)
    deal, page = (F.col("page_id") % 20).alias("deal"), F.col("page_id")
    links = pages.select(deal, "url", F.concat(F.lit("Report "), page.cast("string")).alias("title"))
    verdicts = pages.select(deal, "url", F.when(page % 4 == 1, page % 8 == 0).otherwise(True).alias("keep"), (page % 7).alias("ord"))
    texts = pages.where("page_id % 3 <> 0").join(docs.select(F.col("doc_id").alias("page_id"), "text"), "page_id").select("url", "text")
    extracted = pages.where("page_id % 5 <> 0").join(comps.select("pos", "property_name").withColumn("page_id", F.col("pos") % 400), "page_id").select("url", F.col("pos").alias("nth"), "property_name")
    return aq.acquire(links, verdicts, texts, extracted)


@query("q_src20_acquired_records", f"WITH {_ACQ_SQL} SELECT deal, r.url, title, pos AS nth, property_name FROM r JOIN x ON x.url = r.url WHERE status = 'read'")
def acquired_records(spark, sf):
    return _acquired(spark, sf)[0].select("deal", "url", "title", "nth", "property_name")


@query("q_src14_src20_link_report", f"WITH {_ACQ_SQL} SELECT deal, url, title, chars, CASE WHEN status = 'read' THEN records ELSE 0 END AS records, status FROM r")
def link_report(spark, sf):
    return _acquired(spark, sf)[1]


_KEYS = ["Licensed", "VERSION", "all rights"]


@query(
    "q_src8_discovered_pages",
    """WITH d AS (SELECT doc_id AS page, text, lower(text) AS small FROM documents WHERE trim(coalesce(text, ''), ' ') <> ''), k AS (SELECT * FROM (VALUES (0, 'Licensed'), (1, 'VERSION'), (2, 'all rights')) k(o, kw)),
m AS (SELECT page, list(kw ORDER BY o) FILTER (contains(small, lower(kw))) AS hit FROM d, k GROUP BY page),
tb AS (SELECT doc_id AS page, CASE doc_id % 6 WHEN 1 THEN ['VERSION'] WHEN 2 THEN NULL WHEN 3 THEN ['Licensed', 'VERSION'] END AS cell, doc_id % 6 <> 4 AS has_table FROM documents WHERE doc_id % 6 <> 5),
b AS (SELECT d.page, text, coalesce(has_table, false) AS has_table, CASE WHEN len(hit) > 0 THEN hit ELSE coalesce(cell, []) END AS matched FROM d JOIN m USING (page) LEFT JOIN tb USING (page)),
ln AS (SELECT page, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM b),
h AS (SELECT page, trim(raw, ' ') AS line, i FROM ln WHERE length(trim(raw, ' ')) BETWEEN 4 AND 80 AND len(string_split_regex(trim(raw, ' '), '\\s+')) >= 2),
top AS (SELECT page, line, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN regexp_matches(line, '(?i)^\\s*(table|exhibit|schedule|section)\\b') THEN 0 ELSE 1 END, i) AS n FROM h),
s AS (SELECT page, line, n, (length(line) * 37 % 101)::DOUBLE / 100 AS score FROM top JOIN b USING (page) WHERE n <= 25 AND len(matched) = 0 AND has_table),
e AS (SELECT page, first(line ORDER BY score DESC, n) AS heading, max(score) AS score FROM s WHERE score >= 0.6 GROUP BY page),
sec AS (SELECT page, first(trim(raw, ' ') ORDER BY i) AS line FROM ln JOIN b USING (page) WHERE len(list_filter(matched, lambda x: contains(lower(raw), lower(x)))) > 0 GROUP BY page)
SELECT page, array_to_string(matched, '|') AS matched, has_table, score, substr(coalesce(heading, nullif(line, ''), matched[1]), 1, 120) AS section FROM b LEFT JOIN e USING (page) LEFT JOIN sec USING (page) WHERE len(matched) > 0 OR heading IS NOT NULL""",
)
def discovered_pages(spark, sf):
    """Documents as pages; tables by id: a keyword in a cell of the first rows, in a later row (not seen), in two cells, a table of one row, none."""
    d = _docs(spark, sf).select(F.col("doc_id").alias("page"), "text")
    row = lambda *cells: F.array(*[F.lit(c).cast("string") for c in cells])
    kind = F.col("page") % 6
    rows = (
        F.when(kind == 1, F.array(row("a", "b"), row(None, "The version 2"), row("licensed", "x"))).when(kind == 2, F.array(row("a", "b"), row("c", "d"), row("e", "f"), row("Licensed", "g")))
        .when(kind == 3, F.array(row("x", "licensed version"), row("all rights", "z"))).when(kind == 4, F.array(row("one", "row"))).otherwise(F.array(row("p", "q"), row("r", "s")))
    )
    tables = d.where(kind != 5).select("page", F.lit(0).alias("nth"), rows.alias("rows"))
    headings = d.select(F.explode(aq.heading_lines(F.col("text"))).alias("heading")).distinct()
    similarity = headings.withColumn("score", (F.length("heading") * 37 % 101).cast("double") / 100)
    out = aq.discovered_pages(d, tables, _KEYS, similarity)
    return out.select("page", F.array_join("matched", "|").alias("matched"), "has_table", "score", "section")


@query(
    "q_src19_latest_medians",
    """WITH r AS (SELECT o_custkey % 40 AS registry, o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN 'total' ELSE CAST(year(o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) END AS q, CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE 'street ' || CAST(o_orderkey % 70 AS VARCHAR) END AS street,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (20 + o_orderkey % 50)::DOUBLE END AS retail, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (1000 + o_orderkey % 500)::DOUBLE / 10 END AS office FROM orders WHERE o_orderkey % 10 <> 0),
l AS (SELECT registry, max(q) AS q FROM r WHERE q <> 'total' GROUP BY registry), m AS (SELECT r.*, CASE WHEN registry % 2 = 0 THEN retail ELSE office END AS median FROM r JOIN l USING (registry, q))
SELECT registry, upper(street[1]) || street[2:] AS property_name, street || ', Singapore' AS address, q AS lease_date, CASE WHEN registry % 3 = 0 THEN median ELSE round(median / 10.7639, 2) END AS asking_rent, CASE WHEN registry % 2 = 0 THEN 'median retail rent' ELSE 'median office rent' END AS lease_type FROM m WHERE street <> '' AND median IS NOT NULL""",
)
def latest_medians(spark, sf):
    k = F.col("o_orderkey")
    quarter = F.when(k % 9 == 0, "total").otherwise(F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string")))
    retail = F.when(k % 7 == 0, "-").otherwise((20 + k % 50).cast("string"))
    office = F.when(k % 5 == 0, "").otherwise(F.format_number((1000 + k % 500).cast("double") / 10, 2))
    cells = F.array(quarter, F.when(k % 8 == 0, "").otherwise(F.concat(F.lit("street "), (k % 70).cast("string"))), F.lit("1"), retail, F.lit("9"), F.lit("2"), office, F.lit("8"))
    rows = spark.read.parquet(f"{sf}/orders.parquet").select((F.col("o_custkey") % 40).alias("registry"), F.when(k % 10 == 0, F.slice(cells, 1, 5)).otherwise(cells).alias("cells"))
    return aq.latest_medians(rows, F.col("registry") % 2 == 0, F.col("registry") % 3 == 0)


@query(
    "q_row8_reshaped_leases",
    f"""WITH {LEASES_SQL} SELECT pos AS item, CASE WHEN address IS NULL THEN property_name ELSE property_name || chr(10) || address END AS raw_description, property_name, coalesce(address, '') AS address, 'D' || CAST(pos % 9 AS VARCHAR) AS location, '' AS quality, tenant, 'New' AS lease_type,
  CAST(floor(nla_sf) AS BIGINT) AS nla_sf, asking_rent, eff_rent, term_yrs AS lease_term_yrs, rent_free_mths, trim(lease_date, ' ') AS lease_date FROM leases
WHERE pos % 13 <> 5 AND coalesce(nla_sf, 0) <> 0 AND (lease_date = '' OR regexp_matches(lease_date, '\\b(19|20)\\d\\d\\b')) AND NOT (property_name LIKE 'Harbour Tower%' AND string_split(property_name, ' ')[3] = '10')""",
)
def reshaped_leases(spark, sf):
    text = lambda c: F.regexp_replace(F.format_string("%.6f", F.col(c).cast("double")), r"\.?0+$", "")
    shown = lambda c: F.when(F.col(c).isNotNull(), text(c))
    items = leases(spark, sf).select(
        F.col("pos").alias("item"), F.when(F.col("pos") % 13 == 5, " ").otherwise(F.concat(F.lit(" "), "property_name")).alias("building_name"), "address", F.concat(F.lit("D"), (F.col("pos") % 9).cast("string"), F.lit(" ")).alias("district"), F.lit(None).cast("string").alias("quality"), "tenant", F.lit("New").alias("lease_type"),
        shown("nla_sf").alias("nla_sf"), shown("asking_rent").alias("asking_rent"), shown("eff_rent").alias("eff_rent"), shown("term_yrs").alias("lease_term_yrs"), shown("rent_free_mths").alias("rent_free_mths"), "lease_date",
    )
    return aq.reshaped_leases(items, "Harbour Tower 10")
