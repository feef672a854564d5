"""Briefs for a reader: merged insights, input and comparable summaries; and the registries that feed them.

Every text is an expression over one report or one deal; lists are cut to the
number that the brief shows before they are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text

#: Parts of a report's insights with their labels, and how many entries of a list are shown. Fixed values.
FIELD_LABELS = (
    ("market_overview", "Market Overview"), ("supply_demand", "Supply & Demand"), ("rental_trends", "Rental Trends"), ("capital_values_transactions", "Capital Values & Transactions"),
    ("demand_drivers", "Demand Drivers"), ("supply_pipeline", "Supply Pipeline"), ("market_outlook", "Market Outlook"),
)
LIST_LABELS = (("named_policies", "Named Policies & Regulations"), ("named_submarkets", "Submarket Breakdown"), ("named_occupiers_sectors", "Named Occupiers & Sectors"), ("transaction_comparables", "Transaction Comparables"))
SUMMARY_LABELS = (("demand_drivers", "Demand drivers"), ("supply_demand", "Supply & demand"), ("rental_trends", "Rents"), ("capital_values_transactions", "Capital values / yields"), ("supply_pipeline", "Development pipeline"), ("market_outlook", "Outlook & risks"))
LISTED, STATISTICS, NOTABLE, ROWS = 10, 30, 3, 20


def _line(label: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), text.strip_cjk(value)))


def _joined(values: Column, most: int, by: str) -> Column:
    return F.array_join(F.transform(F.slice(values, 1, most), lambda x: text.strip_cjk(x)), by)


def insights_part(facts: Column, lists: Column, statistics: Column, label: Column) -> Column:
    """A report's insights as labelled lines; null where it has none. ``facts``: map of field to text, ``lists``: map of field to array."""
    lines = [_line(name, F.element_at(facts, key)) for key, name in FIELD_LABELS]
    listed = [F.when(F.size(F.element_at(lists, key)) > 0, F.concat(F.lit(f"{name}: "), _joined(F.element_at(lists, key), LISTED, " | "))) for key, name in LIST_LABELS]
    points = F.when(F.size(statistics) > 0, F.concat(F.lit("Key Data Points: "), _joined(statistics, STATISTICS, " | ")))
    some = (F.size(facts) > 0) | (F.size(lists) > 0) | (F.size(statistics) > 0)
    return F.when(some, F.array_join(F.array_compact(F.array(label, *lines, *listed, points)), "\n"))


def merged_insights(reports: DataFrame, anonymous: bool) -> DataFrame:
    """deal, ord, part: a report's labelled insights (``reports``: deal, ord from 0, source, facts, lists, statistics), named by its source or, if anonymous, by its number."""
    label = F.concat(F.lit("Research Report "), (F.col("ord") + 1).cast("string")) if anonymous else F.concat(F.lit("Source: "), F.coalesce("source", F.lit("Unknown")))
    return reports.select("deal", "ord", insights_part(F.col("facts"), F.col("lists"), F.col("statistics"), label).alias("part")).where("part IS NOT NULL")


def input_summary(reports: DataFrame) -> DataFrame:
    """deal, ord, part: a report's points in the summary of inputs; one without any says so. ``reports`` as above, with meta: array of texts."""
    fact = lambda key: F.btrim(F.coalesce(F.element_at("facts", key), F.lit("")))
    meta = F.array_join(F.filter("meta", lambda x: F.coalesce(x, F.lit("")) != ""), " · ")
    head = F.concat(F.lit("### "), F.col("source"), F.when(meta != "", F.concat(F.lit("  \n_"), meta, F.lit("_"))).otherwise(""))
    points = [F.when(fact(key) != "", F.concat(F.lit(f"- **{name}:** "), fact(key))) for key, name in SUMMARY_LABELS]
    figures = F.slice(F.filter(F.transform("statistics", lambda s: F.btrim(s)), lambda s: s != ""), 1, NOTABLE)
    body = F.array_compact(F.array(F.nullif(fact("market_overview"), F.lit("")), *points, F.when(F.size(figures) > 0, F.concat(F.lit("- **Notable figures:** "), F.array_join(figures, "; ")))))
    body = F.when(F.size(body) > 0, body).otherwise(F.array(F.lit("- _No summary available. Verify the source._")))
    return reports.where("source IS NOT NULL").select("deal", "ord", F.array_join(F.concat(F.array(head), body), "\n").alias("part"))


def comps_summary(rows: DataFrame, title: str, most: int = ROWS) -> DataFrame:
    """deal, block: a deal's comparables as numbered lines below a heading with their number (``rows``: deal, ord, cells:
    array of text). Cells that only say "source" and empty ones are left out; the first ``most`` rows are shown, all are counted."""
    cells = F.filter(F.transform("cells", lambda c: F.btrim(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))), lambda c: (c != "") & (F.lower(c) != "source"))
    filled = rows.select("deal", "ord", F.array_join(cells, " | ").alias("line")).where("line <> ''")
    counts = filled.groupBy("deal").agg(F.count("*").alias("n"))
    top = filled.withColumn("nth", F.row_number().over(Window.partitionBy("deal").orderBy("ord"))).where(F.col("nth") <= most)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("nth", "line"))), lambda x: F.concat(x["nth"].cast("string"), F.lit(". "), x["line"]))
    shown = top.groupBy("deal").agg(F.array_join(lines, "\n").alias("lines"))
    head = F.concat(F.lit(f"### {title} — "), F.col("n").cast("string"), F.lit(" comparable(s)\n"))
    return counts.join(shown, "deal").select("deal", F.concat(head, F.col("lines")).alias("block"))


#: Labels that name a class of assets, not a property; words of prose; words that no name ends with; ends that names may have. Fixed values.
CATEGORY_LABELS = ("residential", "commercial", "industrial", "hospitality", "retail", "office", "mixed", "mixed use", "mixed/others", "mixed others", "others", "logistics", "warehouse", "total", "subtotal", "grand total", "sector", "property type")
PROSE_WORDS = r"(?i)\b(was|were|is|are|has|have|had|will|would|could|should|may|might|remains?|continues?|expects?|expected|anticipated|according|driven|rose|fell|grew|declined|increased|decreased)\b"
DANGLING = r"(?i)\b(and|or|of|the|in|to|for|with|by|a|an|its|their|as|at|on|from|under|over|into|amid)[.,]?\z"
ABBREVIATED = r"(?i)\b(ltd|pte|inc|corp|co|jr|sr|st|rd|ave|blvd|no)\.\z"


def not_a_name(name: Column, price: Column) -> Column:
    """Why a record's name cannot be a property's: category, prose, lines (three ends of line and more) or price (of four words and more); else null."""
    raw = F.coalesce(name, F.lit(""))
    n = F.btrim(F.regexp_replace(raw, r"\s+", " "))
    label = F.btrim(F.regexp_replace(F.regexp_replace(F.lower(raw), r"[^\w/ ]", " "), r"\s+", " "))
    category = label.isin(*CATEGORY_LABELS) | F.btrim(F.replace(label, F.lit("/"), F.lit(" "))).isin(*CATEGORY_LABELS)
    words = F.size(F.split(n, " "))
    sentence = (n.endswith(".") & ~n.rlike(ABBREVIATED)) | n.rlike(DANGLING) | ((words >= 5) & n.rlike(PROSE_WORDS))
    ends = F.length(raw) - F.length(F.replace(raw, F.lit("\n"), F.lit("")))
    return F.when(category, "category").when((words >= 3) & sentence, "prose").when(ends >= 3, "lines").when(F.regexp_count(F.coalesce(price, F.lit("")), F.lit(r"\S+")) >= 4, "price")


def available_connectors(deals: DataFrame, connectors: DataFrame) -> DataFrame:
    """deal, name, ord: the connectors that serve a deal, in the order in which it enables them.

    ``deals`` (deal, market, comp_type, enabled: array of names), ``connectors`` (name, market, comp_types: array): one of
    no market serves all; a name that is enabled twice counts once, where it first stands."""
    once = F.transform(F.array_distinct("enabled"), lambda n: F.struct(n.alias("name"), (F.array_position(F.col("enabled"), n) - 1).cast("int").alias("ord")))
    named = deals.select("deal", F.col("market").alias("in_market"), "comp_type", F.explode(once).alias("e")).select("deal", "in_market", "comp_type", "e.*")
    fits = ((F.col("market") == "") | (F.col("market") == F.col("in_market"))) & F.array_contains("comp_types", F.col("comp_type"))
    # names are counted once in a deal's row, and over rows of one deal among those that fit only, which are few
    fit = named.join(connectors.withColumn("_id", F.monotonically_increasing_id()), "name").where(fits)
    return fit.groupBy("deal", "in_market", "comp_type", "name", "_id").agg(F.min("ord").alias("ord")).select("deal", "name", "ord")


#: Percentages that a lease table must give, and the least number of its rows. Fixed values.
CHECKPOINTS = {30: 60.0, 60: 80.0, 99: 96.0}
LEAST_ROWS = 90
#: Tasks among which reports are dealt before their texts are read: a table of a few columns is small as a file and large as texts.
SPREAD = 256


def lease_tables(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lease tables read from texts (report, text): rows (report, years, percent) of those that can be trusted, and a verdict on each.

    Pairs of a whole number of one or two digits and a decimal number are read; of a year's pairs the last counts;
    ``verdict`` is too few rows, checkpoint (one of ``CHECKPOINTS`` is missing or differs) or ok. A report's pairs stay one
    array of at most 99, so that neither result joins rows that the planner takes for few; a report's texts, if it has
    several, meet in one exchange."""
    pairs = F.regexp_extract_all("text", F.lit(r"\b([0-9]{1,2}\s+[0-9]+\.[0-9]+)\b"), F.lit(1))

    def entry(p: Column, i: Column) -> Column:
        parts = F.split(p, r"\s+")
        return F.struct(parts[0].cast("int").alias("years"), i.alias("i"), parts[1].cast("double").alias("percent"))

    def last_of_year(entries: Column) -> Column:
        return F.filter(entries, lambda e, i: F.coalesce(F.get(entries, i + 1)["years"] != e["years"], F.lit(True)))

    spread = texts.select("report", "text").repartition(SPREAD, "report")
    read = spread.withColumn("e", F.array_sort(F.filter(F.transform(pairs, entry), lambda e: e["years"].between(1, 99) & (e["percent"] > 0) & (e["percent"] < 100))))
    gathered = read.withColumn("e", last_of_year(F.col("e"))).groupBy("report").agg(F.array_sort(F.flatten(F.collect_list("e"))).alias("e"))
    per = gathered.withColumn("e", last_of_year(F.col("e"))).withColumn("rows", F.size("e").cast("long"))
    asked = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(p).alias("p")) for y, p in CHECKPOINTS.items()])
    right = F.forall(asked, lambda c: F.exists("e", lambda x: (x["years"] == c["y"]) & (x["percent"] == c["p"])))
    verdict = F.when(F.col("rows") < LEAST_ROWS, "too few rows").when(~right, "checkpoint").otherwise("ok")
    judged = per.select("report", "rows", verdict.alias("verdict"), "e")
    return judged.where("verdict = 'ok'").select("report", F.explode("e").alias("e")).select("report", "e.years", "e.percent"), judged.drop("e")


def deal_listing(configs: DataFrame) -> DataFrame:
    """deal_name, path: configurations (path, json) by the name of their deal; of one name the last path counts, texts that
    can't be read and those without a name are left out."""
    name = F.get_json_object("json", "$.subject_property.deal_name")
    return configs.select(name.alias("deal_name"), "path").where("deal_name IS NOT NULL").groupBy("deal_name").agg(F.max("path").alias("path"))


#: Zone codes by the names that a registry gives zones, in the order in which parts of a name are tried. Fixed values.
ZONES = (
    ("commercial", "C"), ("commercial/residential", "CR"), ("commercial & residential", "CR"), ("residential", "R"), ("residential with commercial at 1st storey", "RCO"), ("business 1", "B1"), ("business 1 - white", "B1-W"),
    ("business 2", "B2"), ("business 2 - white", "B2-W"), ("business park", "BP"), ("business park - white", "BP-W"), ("hotel", "H"), ("white", "W"), ("mixed use", "MU"), ("civic & community institution", "CI"),
    ("educational institution", "ED"), ("health & medical care", "HMC"), ("place of worship", "PW"), ("sports & recreation", "SR"), ("open space", "OS"), ("park", "PK"), ("transport facilities", "TP"), ("utility", "U"),
    ("agriculture", "AG"), ("cemetery", "CE"), ("reserve site", "RS"), ("special use", "SU"), ("port / airport", "PA"), ("beach area", "BA"),
)


def zones_by_lookup(records: DataFrame, answers: DataFrame) -> DataFrame:
    """pos, zone: the zone code of the first answer of a point lookup that has one (``answers``: pos, ord, name), by its whole
    name, else by the first known name within it; null where no answer helps. ``records`` needs pos only."""
    n = F.btrim(F.lower("name"))
    whole = F.element_at(F.create_map(*[F.lit(x) for pair in ZONES for x in pair]), n)
    part = F.get(F.filter(F.array(*[F.struct(F.lit(a).alias("n"), F.lit(c).alias("c")) for a, c in ZONES]), lambda z: n.contains(z["n"])), F.lit(0))["c"]
    read = answers.select("pos", "ord", F.coalesce(whole, part).alias("code")).where("code IS NOT NULL").groupBy("pos").agg(F.min_by("code", "ord").alias("zone"))
    return records.select("pos").join(read, "pos", "left")
