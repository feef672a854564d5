"""From found links and pages to records: cited clauses, picked reports, page discovery, registry quarters, rent reshape.

Calls to models and to the web are input tables (verdicts, texts, extracted
rows); what happens between them is here, and what is left out is kept as a
reason, not dropped silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import num

#: An inline source: a labelled address in brackets.
CITE = r"\(\[[^\]]+\]\(([^)]*)\)\)"
#: Below so many characters a fetched text counts as none.
LEAST_CHARS = 200
MAX_REPORTS = 4


def plain_prose(body: Column) -> Column:
    """A searched text without inline sources, link marks, heading marks and spare blanks."""
    out = F.regexp_replace(F.regexp_replace(body, CITE, ""), r"\[([^\]]+)\]\([^)]*\)", "$1")
    out = F.regexp_replace(F.regexp_replace(out, r"(?m)^\s*#+\s*", ""), r"[ \t]{2,}", " ")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"\A\s+|\s+\z", "")


def cited_clauses(body: Column) -> Column:
    """array of (text, url): each inline source with the prose since the one before it; those without prose or address are left out."""
    parts, urls = F.split(body, CITE, -1), F.regexp_extract_all(body, F.lit(CITE), F.lit(1))
    spans = F.transform(urls, lambda u, i: F.struct(plain_prose(F.get(parts, i)).alias("text"), u.alias("url")))
    return F.filter(spans, lambda s: (s["text"] != "") & (s["url"] != ""))


def acquire(links: DataFrame, verdicts: DataFrame, texts: DataFrame, extracted: DataFrame, most: int = MAX_REPORTS) -> tuple[DataFrame, DataFrame]:
    """Records of picked reports, and what became of each link.

    ``links`` (deal, url, title), ``verdicts`` (deal, url, keep, ord): the picked ones in the order of ``ord``, of which
    ``most`` a deal are opened; ``texts`` (url, text): what was fetched; ``extracted`` (url, nth, ..): records read from a
    text. A record takes its link's title and address as its source. ``status`` of a link: not picked, over the limit, no
    text, no named deals, or read. Null ``keep`` counts as no."""
    one = links.groupBy("deal", "url").agg(F.min("title").alias("title"))
    picked = verdicts.where("keep").groupBy("deal", "url").agg(F.min("ord").alias("ord"))
    j = one.join(picked, ["deal", "url"], "left")
    place = F.row_number().over(Window.partitionBy("deal").orderBy("ord", "url"))  # of the picked links of one deal
    opened = j.where("ord IS NOT NULL").withColumn("place", place).unionByName(j.where("ord IS NULL").withColumn("place", F.lit(None).cast("int")))
    fetched = texts.groupBy("url").agg(F.max(F.length(F.btrim("text"))).alias("chars"))
    counts = extracted.groupBy("url").agg(F.count("*").alias("records"))
    state = opened.join(fetched, "url", "left").join(counts, "url", "left")
    chars, records = F.coalesce("chars", F.lit(0)), F.coalesce("records", F.lit(0))
    read = (F.col("place") <= most) & (records > 0)
    status = F.when(F.col("ord").isNull(), "not picked").when(F.col("place") > most, "over the limit").when(records > 0, "read").when(chars < LEAST_CHARS, "no text").otherwise("no named deals")
    report = state.select("deal", "url", "title", chars.cast("long").alias("chars"), F.when(read, records).otherwise(0).cast("long").alias("records"), status.alias("status"))
    found = report.where("status = 'read'").select("deal", "url", "title").join(extracted, "url")
    return found, report


#: Titles that name a table. Fixed values.
TITLE_WORDS = r"(?i)^\s*(?:table|exhibit|schedule|section)\b"
HEADINGS, SIMILAR = 25, 0.60


def heading_lines(body: Column) -> Column:
    """The most title-like lines of a page: of 4 to 80 characters and two words, named tables first, ``HEADINGS`` at most."""
    lines = F.transform(F.split(body, r"\r\n|[\n\r]"), lambda x: F.btrim(x))
    fit = F.filter(lines, lambda x: F.length(x).between(4, 80) & (F.size(F.split(x, r"\s+")) >= 2))
    ranked = F.transform(fit, lambda x, i: F.struct(F.when(x.rlike(TITLE_WORDS), 0).otherwise(1).alias("rank"), i.alias("i"), x.alias("line")))
    return F.transform(F.slice(F.array_sort(ranked), 1, HEADINGS), lambda x: x["line"])


def discovered_pages(pages: DataFrame, tables: DataFrame, keywords: list[str], similarity: DataFrame) -> DataFrame:
    """page, matched (keywords), score, section: pages that hold a keyword in their text; else in the first three rows of a
    table; else, if they have a table, a heading at least ``SIMILAR`` to a keyword.

    ``pages`` (page, text), ``tables`` (page, rows: array of rows of cells), ``similarity`` (heading, score): the best
    similarity of a heading to any keyword. ``section`` is the first line with a matched keyword, the heading, or the keyword."""
    words = F.array(*[F.lit(k) for k in keywords])
    held = lambda text: F.filter(words, lambda k: F.contains(F.lower(text), F.lower(k)))
    base = pages.where(F.btrim(F.coalesce("text", F.lit(""))) != "").select("page", "text", held(F.col("text")).alias("in_text"))
    # the first cell, in order of tables, rows and columns, that holds a keyword
    cells = tables.select("page", "nth", F.posexplode(F.slice("rows", 1, 3)).alias("r", "row"), (F.size("rows") > 1).alias("tall"), (F.size(F.get("rows", F.lit(0))) > 1).alias("wide"))
    per_row = cells.select("page", "tall", "wide", F.posexplode("row").alias("c", "cell"), "nth", "r").withColumn("hit", held(F.coalesce("cell", F.lit(""))))
    by_page = per_row.groupBy("page").agg(F.max(F.col("tall") & F.col("wide")).alias("has_table"), F.min(F.when(F.size("hit") > 0, F.struct("nth", "r", "c", "hit"))).alias("first"))
    j = base.join(by_page, "page", "left").withColumn("has_table", F.coalesce("has_table", F.lit(False)))
    j = j.withColumn("matched", F.when(F.size("in_text") > 0, F.col("in_text")).otherwise(F.coalesce("first.hit", F.array().cast("array<string>"))))
    open_ = j.where((F.size("matched") == 0) & F.col("has_table")).select("page", F.posexplode(heading_lines(F.col("text"))).alias("i", "heading"))
    near = open_.join(similarity, "heading").where(F.col("score") >= SIMILAR).groupBy("page").agg(F.max(F.struct("score", (-F.col("i")).alias("i"), "heading")).alias("m"))
    j = j.join(near, "page", "left").where((F.size("matched") > 0) | F.col("m").isNotNull())
    lines = F.split("text", r"\r\n|[\n\r]")
    line = F.get(F.filter(lines, lambda x: F.exists("matched", lambda k: F.contains(F.lower(x), F.lower(k)))), F.lit(0))
    section = F.coalesce(F.col("m.heading"), F.nullif(F.btrim(line), F.lit("")), F.get("matched", F.lit(0)))
    return j.select("page", "matched", "has_table", F.round("m.score", 6).alias("score"), F.substring(section, 1, 120).alias("section"))


QUARTER = r"^[0-9]{4}Q[0-9]"


def latest_medians(rows: DataFrame, retail: Column, sqm: Column) -> DataFrame:
    """Street medians of a registry's latest quarter: ``rows`` (registry, cells) of its result tables.

    Cells are quarter, street, then lower, median and upper rents of retail and of offices; ``retail`` chooses which,
    ``sqm`` keeps rents a square metre. Rows with less than eight cells, another first cell, or without street or median
    are left out; all rows of the registry's latest quarter among the others are given."""
    c = lambda i: F.get("cells", F.lit(i))
    r = rows.where((F.size("cells") >= 8) & c(0).rlike(QUARTER)).withColumn("quarter", F.substring(c(0), 1, 6))
    latest = r.groupBy("registry").agg(F.max("quarter").alias("quarter"))
    r = r.join(latest, ["registry", "quarter"]).withColumn("median", num.signed_num(F.when(retail, c(3)).otherwise(c(6))))
    rent = F.when(sqm, F.col("median")).otherwise(F.round(F.col("median") / num.SF_PER_SQM, 2))
    kept = r.where((c(1) != "") & F.col("median").isNotNull())
    return kept.select("registry", F.initcap(c(1)).alias("property_name"), F.concat(c(1), F.lit(", Singapore")).alias("address"), c(0).alias("lease_date"), rent.alias("asking_rent"), F.concat(F.lit("median "), F.when(retail, "retail").otherwise("office"), F.lit(" rent")).alias("lease_type"))


def reshaped_leases(items: DataFrame, subject: str = "") -> DataFrame:
    """Items read from lease pages as lease records; every field is text on the way in.

    Left out: items without a name; the subject (three quarters of its words, two at least); items without an area,
    which is the key field of a lease; dates without a year of four digits, which are pieces of sentences."""
    tidy = lambda f: F.btrim(F.coalesce(F.col(f), F.lit("")))
    name, area, date = tidy("building_name"), num.plain_num(F.col("nla_sf")), tidy("lease_date")
    tokens = F.lit([w for w in dict.fromkeys("".join(c if c.isalnum() or c == "_" else " " for c in subject.lower()).split())]) if subject else None
    own = F.array_distinct(F.split(F.btrim(F.regexp_replace(F.lower(name), r"\W+", " ")), " "))
    keep = (name != "") & (F.coalesce(area, F.lit(0.0)) != 0) & ((date == "") | date.rlike(r"\b(?:19|20)[0-9]{2}\b"))
    if tokens is not None:
        keep &= F.size(F.array_intersect(own, tokens)) < F.greatest(F.lit(2.0), F.size(tokens) * 0.75)
    described = F.when(tidy("address") != "", F.concat(name, F.lit("\n"), tidy("address"))).otherwise(name)
    numbers = {f: num.plain_num(F.col(f)) for f in ("asking_rent", "eff_rent", "lease_term_yrs", "rent_free_mths")}
    texts = {"address": "address", "location": "district", "quality": "quality", "tenant": "tenant", "lease_type": "lease_type"}
    return items.where(keep).select("item", described.alias("raw_description"), name.alias("property_name"), *[tidy(f).alias(k) for k, f in texts.items()], F.floor(area).cast("long").alias("nla_sf"), *[v.alias(k) for k, v in numbers.items()], date.alias("lease_date"))
