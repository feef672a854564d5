"""Rules that work without a model: classes, column tiers, places, configurations, caches and read-back of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import geo
from evidentia.operators.retrieval import marker_scores, present_types, report_like

# Classes


def sale_class(sale_type: Column, zoning: Column, asset_class: str) -> Column:
    """Asset type of a sale: its type without what stands in brackets, and its use by zoning; blank without a type."""
    base = F.trim(F.regexp_replace(F.coalesce(sale_type, F.lit("")), r"\s*\(.*\)", ""))
    z, own = F.coalesce(zoning, F.lit("")), asset_class.title()
    use = F.when(z.contains("Residential"), f"Mixed Use ({own} + Retail)").when(z.contains("Hospitality"), f"Mixed Use ({own} + Hotel)").otherwise(own)
    return F.when(base == "", "").otherwise(F.concat(base, F.lit(" ("), use, F.lit(")")))


def classified(records: DataFrame, verdicts: DataFrame, asset_class: str) -> DataFrame:
    """Records with asset_type, relevance_score and method: a verdict (pos, asset_type, relevance_score) where there is one, else the rules."""
    v = verdicts.select("pos", F.col("asset_type").alias("_type"), F.col("relevance_score").alias("_score"))
    joined = records.drop("relevance_score").join(v, "pos", "left")
    ruled = sale_class(F.col("sale_type"), F.col("land_zoning"), asset_class)
    given = F.col("_type").isNotNull()
    out = joined.withColumn("asset_type", F.when(given, F.col("_type")).otherwise(ruled)).withColumn("relevance_score", F.coalesce("_score", F.lit(5)))
    return out.withColumn("method", F.when(given, "model").otherwise("rules")).drop("_type", "_score")


#: Places in a land record's name or address, in order, and the location that they mean. Fixed values.
LAND_LOCATIONS = (
    (("marina bay",), "Prime Core CBD (Marina Bay)"),
    (("raffles", "robinson", "shenton"), "Core CBD (Raffles Place / Shenton)"),
    (("city hall", "beach rd", "suntec"), "Core CBD (City Hall / Beach Rd)"),
    (("orchard", "somerset"), "Orchard / City Fringe"),
    (("tanjong pagar", "cecil", "anson", "mccallum"), "CBD Fringe (Tanjong Pagar)"),
    (("jurong", "jld"), "Decentralised / JLD"),
    (("paya lebar",), "Decentralised (Paya Lebar)"),
    (("one-north", "fusionopolis", "buona vista"), "one-north / Buona Vista"),
    (("woodlands", "yishun", "tampines"), "Suburban"),
)


def first_named(text: Column, rules, otherwise: str) -> Column:
    """The value of the first rule (words, value) of which a word stands in the text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    named = [(reduce(Column.__or__, [low.contains(w) for w in words]), value) for words, value in rules]
    return reduce(lambda out, rule: out.when(*rule), named[1:], F.when(*named[0])).otherwise(otherwise)


def land_class(name: Column, address: Column, zoning: Column) -> Column:
    """struct(location, quality) of a land record: location by place names, quality by zoning and location."""
    location = first_named(F.concat_ws(" ", name, address), LAND_LOCATIONS, "Decentralised")
    z = F.lower(F.coalesce(zoning, F.lit("")))
    quality = (
        F.when(z.contains("white"), "Mixed-Use (White Site)").when(z.contains("business park"), "Grade B (Business Park)")
        .when(z.contains("commercial"), F.when(F.lower(location).contains("core"), "Prime (Core CBD)").otherwise("Grade A (CBD Fringe)")).otherwise("")
    )
    return F.struct(location.alias("location"), quality.alias("quality"))


def file_types(files: DataFrame, verdicts: DataFrame, least: int = 3) -> DataFrame:
    """file, types, is_report, confidence and method of files (file, name, body): by markers, else by a model's verdict (file, types, is_report), else by the best guess."""
    s = files.select("file", report_like(F.col("name"), F.col("body")).alias("report"), marker_scores(F.col("body")).alias("s"))  # texts stay where they are, scores meet the verdicts
    s = s.join(verdicts.select("file", F.col("types").alias("v_types"), F.col("is_report").alias("v_report")), "file", "left").withColumn("v_report", F.coalesce("v_report", F.lit(False)))
    s = s.withColumn("present", present_types(F.col("s"))).withColumn("any", present_types(F.col("s"), 0))
    guess = F.get("any", F.lit(0))
    clear = F.size("present") > 0
    told = (F.size(F.coalesce("v_types", F.array().cast("array<string>"))) > 0) | F.col("v_report")
    guessed = F.col("s")[guess]["score"] >= least
    none = F.array().cast("array<string>")
    return s.select(
        "file",
        F.when(clear, F.col("present")).when(told, F.coalesce("v_types", none)).when(guessed, F.array(guess)).otherwise(none).alias("types"),
        F.when(~clear & told, F.col("v_report") | F.col("report")).otherwise(F.col("report")).alias("is_report"),
        F.when(clear & (F.size("present") == 1) & ~F.col("report"), "high").when(clear | told | guessed, "low").otherwise("none").alias("confidence"),
        F.when(clear, "keywords").when(told, "model").when(guessed, "keywords").when(F.col("report"), "report").otherwise("none").alias("method"),
    )


# Columns of an input table

#: Headers that name a part of a market, values of a "type" column that mean a use or a kind of sale. Fixed values.
SUBMARKETS = ("submarket", "sub market", "micromarket", "micro market", "precinct", "locality", "subzone", "sub zone")
USES = ("office", "retail", "industrial", "residential", "hospitality", "hotel", "commercial", "logistics", "warehouse", "mixed", "data centre", "data center", "business park")
SALE_KINDS = ("strata", "whole bldg", "whole block", "en bloc", "block sale", "portfolio")
EXCLUDED = "_submarket"


def plain_header(header: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(header, F.lit(""))), r"[^\w\s]", " "), r"\s+", " "))


def _holds(text: Column, words) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: text.contains(w))


def header_rules(headers: DataFrame, samples: DataFrame) -> DataFrame:
    """table_id, column, key, rule: the field that a header and its values name by rule, or null.

    A part of a market is kept out; a bare "type" is a zoning or a kind of sale by
    at least half of its values; a price is one a unit if the header says so.
    ``samples`` (table_id, column, cell)."""
    cell = F.lower(F.trim("cell"))
    said = samples.where(F.coalesce("cell", F.lit("")) != "").groupBy("table_id", "column").agg(F.count("*").alias("n"), F.count_if(_holds(cell, USES)).alias("uses"), F.count_if(_holds(cell, SALE_KINDS)).alias("kinds"))
    rows = headers.withColumn("key", plain_header(F.col("header"))).join(said, ["table_id", "column"], "left")
    half = F.greatest(F.lit(1), F.floor((F.col("n") + 1) / 2))
    by_values = F.when((F.col("uses") >= half) & (F.col("uses") >= F.col("kinds")), "land_zoning").when(F.col("kinds") >= half, "sale_type")
    price = F.when(F.col("key").rlike(r"\b(psf|psm|ppr|per|unit|sqft|sqm)\b"), "price_psf_gfa").otherwise("price_sgd_m")
    rule = F.when(_holds(F.col("key"), SUBMARKETS), EXCLUDED).when(F.col("key") == "type", by_values).when(F.col("key").rlike(r"\b(price|consideration)\b"), price)
    return rows.select("table_id", "column", "key", rule.alias("rule"))


def map_tiers(headers: DataFrame, samples: DataFrame, fields: dict[str, tuple[str, ...]], similar: DataFrame, least: float = 0.30) -> DataFrame:
    """table_id, field, column, method: input columns of every table mapped to fields, tier after tier.

    Kept out or told by values; then synonyms, in order of fields and then columns;
    then the price rule, in order of columns; then, column by column, the most
    similar field that is still free (``similar``: table_id, column, field, score),
    if similar enough. A column serves one field, a field takes one column. The
    claims of a table are folded over its few columns; tables are independent."""
    names = list(fields)
    ruled = header_rules(headers, samples)
    best = similar.groupBy("table_id", "column").agg(F.array_sort(F.collect_list(F.struct("field", "score"))).alias("scores"))  # one entry a field
    per = ruled.join(best, ["table_id", "column"], "left").groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("column", "key", "rule", "scores"))).alias("c"))  # a table's columns
    claim = "struct<field:string,column:int,method:string>"
    no_claims = F.array().cast(f"array<{claim}>")
    taken = lambda acc, x: F.exists(acc, lambda y: y["column"] == x["column"])
    has = lambda acc, field: F.exists(acc, lambda y: y["field"] == field)
    add = lambda acc, when, field, x, method: F.when(when, F.concat(acc, F.array(F.struct(field.alias("field"), x["column"].cast("int").alias("column"), method.alias("method")).cast(claim)))).otherwise(acc)

    def by_value(acc: Column, x: Column) -> Column:
        named = x["rule"].isin("land_zoning", "sale_type") & x["rule"].isin(*names) & ~has(acc, x["rule"])
        return add(acc, (x["rule"] == EXCLUDED) | named, x["rule"], x, F.lit("value"))

    def by_price(acc: Column, x: Column) -> Column:
        ok = x["rule"].isin("price_psf_gfa", "price_sgd_m") & x["rule"].isin(*names) & ~taken(acc, x) & ~has(acc, x["rule"])
        return add(acc, ok, x["rule"], x, F.lit("price"))

    def by_similarity(acc: Column, x: Column) -> Column:
        free = F.filter(F.array(*[F.struct(F.coalesce(F.get(F.filter(x["scores"], lambda y: y["field"] == f), F.lit(0))["score"], F.lit(0.0)).alias("score"), F.lit(-i).alias("ord"), F.lit(f).alias("field")) for i, f in enumerate(names)]), lambda y: ~has(acc, y["field"]))
        top = F.array_max(free)
        return add(acc, ~taken(acc, x) & (x["key"] != "") & (top["score"] >= least), top["field"], x, F.lit("similar"))

    def by_name(field: str):
        known = F.array(*map(F.lit, fields[field]))
        return lambda acc, x: add(acc, F.array_contains(known, x["key"]) & ~taken(acc, x) & ~has(acc, F.lit(field)), F.lit(field), x, F.lit("exact"))

    out = F.aggregate("c", no_claims, by_value)
    for field in fields:
        out = F.aggregate("c", out, by_name(field))
    out = F.aggregate("c", out, by_price)
    out = F.aggregate("c", out, by_similarity)
    return per.select("table_id", F.explode(out).alias("m")).select("table_id", "m.field", "m.column", "m.method").where(F.col("field") != EXCLUDED)


def with_verdicts(mapped: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Mappings completed by a model's (table_id, field, column): only fields and columns that are still free; of several the smallest column, then field."""
    free = verdicts.join(mapped.select("table_id", "field"), ["table_id", "field"], "left_anti").join(mapped.select("table_id", "column"), ["table_id", "column"], "left_anti")
    first = lambda df, by, order: df.withColumn("_n", F.row_number().over(Window.partitionBy("table_id", by).orderBy(order))).where("_n = 1").drop("_n")
    one = first(first(free, "field", "column"), "column", "field")
    return mapped.unionByName(one.select("table_id", "field", "column", F.lit("model").alias("method")))


def mapping_tab(mapped: DataFrame, headers: DataFrame, fields: list[str]) -> DataFrame:
    """table_id, field, header: for every field of every table the input header that serves it, or a dash."""
    every = headers.select("table_id").distinct().withColumn("field", F.explode(F.array(*map(F.lit, fields))))
    joined = every.join(mapped.select("table_id", "field", "column"), ["table_id", "field"], "left").join(headers, ["table_id", "column"], "left")
    return joined.select("table_id", "field", F.coalesce("header", F.lit("—")).alias("header"))


def distinct_headers(headers: DataFrame) -> DataFrame:
    """The first column of each header of a table."""
    return headers.groupBy("table_id", "header").agg(F.min("column").alias("column"))


# Tables that other programs extract


def preferred_tables(tables: DataFrame, order: list[str]) -> DataFrame:
    """Tables (page, method, ...) of the first method, in order, that found any on the page."""
    rank = reduce(lambda out, m: out.when(F.col("method") == m[1], m[0]), list(enumerate(order))[1:], F.when(F.col("method") == order[0], 0))
    first = tables.where(rank.isNotNull()).groupBy("page").agg(F.min(rank).alias("_first"))
    return tables.withColumn("_rank", rank).join(first, "page").where("_rank = _first").drop("_rank", "_first")


def page_records(table_records: DataFrame, prose_records: DataFrame, tabular_pages: DataFrame) -> DataFrame:
    """Records of tables, and those read from prose on pages that look tabular and gave no table record."""
    prose = prose_records.join(tabular_pages, "page", "left_semi").join(table_records.select("page").distinct(), "page", "left_anti")
    return table_records.withColumn("origin", F.lit("table")).unionByName(prose.withColumn("origin", F.lit("prose")))


def record_table(provenance: Column) -> Column:
    """The first table named in a record's provenance (map of field to struct with ``table``)."""
    return F.get(F.filter(F.transform(F.map_values(provenance), lambda p: p["table"]), lambda t: F.coalesce(t, F.lit("")) != ""), F.lit(0))


def read_back(rows: DataFrame) -> DataFrame:
    """table_id, row, role, cells: a written table read again, without its Source column.

    It starts below the first row that names property and marker. Rows are the
    subject's up to a blank row after one of them, a repeated header or an average;
    the rest are comps. ``rows`` (table_id, row, cells)."""
    low = F.transform("cells", lambda c: F.lower(F.coalesce(c, F.lit(""))))
    names = lambda word: F.exists(low, lambda c: c.contains(word))
    kind = (
        F.when(F.exists(low, lambda c: F.trim(c) == "average"), "average").when(F.forall(low, lambda c: c == ""), "blank").when(names("property") & names("marker"), "header").otherwise("data")
    )
    head = (kind == "header") & (F.size(F.filter(low, lambda c: c != "")) >= 3)
    w = Window.partitionBy("table_id").orderBy("row")
    marked = rows.withColumn("_kind", kind).withColumn("_start", F.min(F.when(head, F.col("row"))).over(Window.partitionBy("table_id"))).where("row >= _start")
    header = F.first(F.when(F.col("row") == F.col("_start"), F.col("cells")), True).over(w)
    marked = marked.withColumn("_header", header).where("row > _start")
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(F.when(F.col("_kind") == "data", 1).otherwise(0)).over(so_far), F.lit(0))
    marked = marked.withColumn("_turn", F.col("_kind").isin("header", "average") | ((F.col("_kind") == "blank") & (seen == 1)))
    past = F.coalesce(F.max(F.col("_turn").cast("int")).over(so_far), F.lit(0)) == 1
    role = F.when(F.col("_kind") == "average", "average").when(past, "comp").otherwise("subject")
    kept = F.filter("cells", lambda c, i: F.lower(F.trim(F.coalesce(F.get("_header", i), F.lit("")))) != "source")
    return marked.withColumn("role", role).where("_kind IN ('data', 'average')").select("table_id", "row", "role", kept.alias("cells"))


def map_inputs(table: DataFrame) -> DataFrame:
    """Rows of a written table that a map shows: a name, and a marker that is neither the subject's nor a dash."""
    name, marker = F.trim(F.coalesce("property", F.lit(""))), F.trim(F.coalesce(F.col("marker").cast("string"), F.lit("")))
    return table.where((name != "") & ~marker.isin("", "★", "—"))


# Places


def attach_places(records: DataFrame, found: DataFrame, providers: list[str], lon0: float, lat0: float, centroid: tuple[float, float], far: float = 9999.0) -> DataFrame:
    """Records with lon, lat, distance_km, provider, by_name and suspect.

    Own coordinates stay ("cached"). Else the address, or without one the name, is
    looked up in ``found`` (query, provider, lon, lat); of several providers the
    first in order counts. What isn't found has the distance ``far`` and the
    provider "failed"; what lies at the country's centroid is suspect."""
    name, address = (F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[\r\n]+", " ")) for c in ("property_name", "address"))
    rank = F.array_position(F.array(*map(F.lit, providers)), F.col("provider"))
    first = found.where(rank > 0).groupBy("query").agg(F.min(F.struct(rank.alias("r"), F.col("provider").alias("p"), F.col("lon").alias("x"), F.col("lat").alias("y"))).alias("_f"))
    own = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    rows = records.withColumn("query", F.when(~own, F.coalesce(F.nullif(address, F.lit("")), F.nullif(name, F.lit(""))))).withColumn("_named", ~own & (address == ""))
    out = rows.join(first, "query", "left").withColumn("provider", F.when(own, "cached").otherwise(F.coalesce("_f.p", F.lit("failed")))).withColumn("by_name", F.col("_named") & F.col("_f").isNotNull())
    out = out.withColumn("lon", F.when(own, F.col("lon")).otherwise(F.col("_f.x"))).withColumn("lat", F.when(own, F.col("lat")).otherwise(F.col("_f.y")))
    near = geo.near_point(F.col("lon"), F.col("lat"), F.lit(centroid[0]), F.lit(centroid[1]))
    away = F.coalesce(geo.haversine_km(F.col("lon"), F.col("lat"), F.lit(lon0), F.lit(lat0)), F.lit(far))
    return out.withColumn("distance_km", away).withColumn("suspect", F.coalesce(near & (F.col("provider") != "cached"), F.lit(False))).drop("query", "_named", "_f")


def overwritten(records: DataFrame, verdicts: DataFrame, field: str) -> DataFrame:
    """A field replaced where there is a verdict (pos, field) for the record; a verdict of null blanks it."""
    v = verdicts.select("pos", F.col(field).alias("_new"), F.lit(True).alias("_has"))
    return records.join(v, "pos", "left").withColumn(field, F.when(F.col("_has"), F.coalesce("_new", F.lit(""))).otherwise(F.col(field))).drop("_new", "_has")


def market_place(address: Column, country: Column) -> Column:
    """The part of an address before its last one; of a single part itself; without address the country."""
    parts = F.filter(F.transform(F.split(F.coalesce(address, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(parts) >= 2, F.get(parts, F.size(parts) - 2)).when(F.size(parts) == 1, F.get(parts, F.lit(0))).otherwise(country)


def address_candidates(documents: DataFrame, labels: list[str], streets: list[str], countries: list[str], most: int = 10) -> DataFrame:
    """doc_id, n, line: lines that may hold an address, each once (without case), in order.

    A line with a label and the one below it; one with a street word and a digit;
    one with a country. No further line is read once there are ``most``."""
    lines = F.filter(F.transform(F.split(F.col("text"), r"\r\n|[\n\r]"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")
    rows = documents.select("doc_id", F.explode(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("line")))).alias("l")).select("doc_id", "l.i", "l.line")
    below = F.lead("line").over(Window.partitionBy("doc_id").orderBy("i"))
    low = F.lower("line")
    label, street, country = (_holds(low, words) for words in (labels, streets, countries))
    given = F.array_compact(F.array(F.when(label, F.col("line")), F.when(label, F.col("below")), F.when(street & low.rlike(r"\d"), F.col("line")), F.when(country, F.col("line"))))
    named = rows.withColumn("below", below).select("doc_id", "i", F.posexplode(given).alias("j", "line")).where(F.length("line") > 4)
    once = named.groupBy("doc_id", F.lower("line").alias("key")).agg(F.min(F.struct("i", "j", "line")).alias("m")).select("doc_id", "m.*")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("i", "j"))
    before = F.count("*").over(Window.partitionBy("doc_id").orderBy("i").rangeBetween(Window.unboundedPreceding, -1))
    return once.withColumn("n", n).withColumn("before", before).where(F.col("before") < most).select("doc_id", "n", "line")


# Rows, configurations, caches


def global_rows(records: DataFrame, price_unit: str = "M") -> DataFrame:
    """Output rows of a table in any currency: the first of each field's names that is filled; the price in the table's unit; a reported unit price as it is, else price by area."""
    have = set(records.columns)
    pick = lambda *names: F.coalesce(*[F.nullif(F.col(n).cast("double"), F.lit(0.0)) for n in names if n in have], F.lit(None).cast("double"))
    price = pick("price_raw", "price_sgd_m", "price_m")
    scaled = F.bround(price / 1000, 4) if price_unit == "B" else price
    area = pick("site_area", "site_area_raw", "gfa_sf").cast("long")
    factor = 1e9 if price_unit == "B" else 1e6
    return records.select("pos", F.col("property_name").alias("property"), scaled.alias("price_raw"), area.alias("site_area"), F.coalesce(pick("unit_price"), F.round(F.try_divide(scaled * factor, area), 0)).alias("unit_price"))


#: Asset classes that a deal may have; anything else counts as the first. Fixed values.
ASSET_CLASSES = ("office", "retail", "industrial", "logistics", "residential", "hotel", "land")


def deal_config(fields: DataFrame) -> DataFrame:
    """Typed configuration of deals from rows of strings: whole numbers default to 0, amounts to null, texts to their defaults."""
    given = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    number = lambda c: F.col(c).try_cast("double")
    kind = F.lower(F.coalesce(given("asset_class"), F.lit(ASSET_CLASSES[0])))
    kind = F.when(kind.isin(*ASSET_CLASSES), kind).otherwise(ASSET_CLASSES[0])
    deal = F.coalesce(given("deal_name"), given("property_name"), F.lit("New Deal"))
    return fields.select(
        "pos", deal.alias("deal_name"), F.coalesce(given("property_name"), deal).alias("property_name"), F.coalesce(number("gfa_sf").cast("long"), F.lit(0).cast("long")).alias("gfa_sf"),
        number("price_m").alias("price_m"), kind.alias("asset_class"), F.coalesce(given("asset_type"), F.concat(F.lit("Whole Block ("), F.initcap(kind), F.lit(")"))).alias("asset_type"),
    )


def ranked_with_verdicts(records: DataFrame, verdicts: DataFrame, by: str, most: int) -> DataFrame:
    """Records that have a verdict (pos, relevance_score), the most relevant first, at most so many a group, with markers from 1."""
    order = Window.partitionBy(by).orderBy(F.desc("relevance_score"), "pos")
    return records.drop("relevance_score").join(verdicts, "pos").withColumn("marker", F.row_number().over(order)).where(F.col("marker") <= most)


def fuzzy_columns(headers: DataFrame, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """table_id, field, column: for each field its first synonym that is part of a header, in the first such column."""
    low = F.lower(F.coalesce("header", F.lit("")))
    hits = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(i).alias("i"), F.lit(s).alias("s")) for f, names in fields.items() for i, s in enumerate(names)])
    found = headers.withColumn("h", F.explode(F.filter(hits, lambda x: low.contains(x["s"]))))
    return found.groupBy("table_id", "h.field").agg(F.min(F.struct("h.i", "column"))["column"].alias("column"))


def latest_file(files: DataFrame, prefixes: list[str], by: str) -> DataFrame:
    """Of each group's files (path, mtime) under one of the prefixes, the one written last; ties to the larger path."""
    mine = reduce(Column.__or__, [F.col("path").startswith(p) for p in prefixes])
    return files.where(mine).groupBy(by).agg(F.max_by("path", F.struct("mtime", "path")).alias("path"))


def cache_key(name: Column, size: Column, mtime: Column) -> Column:
    """Key of what has been worked out from a file as it is."""
    return F.md5(F.concat_ws(":", name, size.cast("string"), mtime.cast("string")))


def uncached(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files (with ``key``) that the cache doesn't hold, one a key."""
    return files.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])


def next_source(remaining: Column) -> Column:
    """The source to try next: online if it is left, else the first one left, else stop."""
    return F.when(F.size(remaining) == 0, "stop").when(F.array_contains(remaining, "online"), "online").otherwise(F.get(remaining, F.lit(0)))


def best_span(claims: DataFrame, spans: DataFrame, by: str, least: float = 0.34) -> DataFrame:
    """claim_id, sentence, url, overlap: of the spans (url, text) of a claim's group the sentence that holds most of its words, if enough; the first of equal ones."""
    from evidentia.functions import text

    s = spans.select(by, "ord", "url", F.posexplode(text.sentences(F.col("text"))).alias("i", "sentence"))
    scored = claims.select("claim_id", by, "claim").join(s, by).withColumn("overlap", text.keyword_overlap(F.col("claim"), F.col("sentence")))
    best = scored.groupBy("claim_id").agg(F.max(F.struct("overlap", (-F.col("ord")).alias("o"), (-F.col("i")).alias("i"), "sentence", "url")).alias("m"))
    return best.where(F.col("m.overlap") >= least).select("claim_id", "m.sentence", F.coalesce(F.nullif(F.col("m.url"), F.lit("")), F.lit("Web search")).alias("url"), F.col("m.overlap").alias("overlap"))
