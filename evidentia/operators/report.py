"""Output tables: schemas by deal, rows for display, parameters, provenance, edits and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text

ABSENT = "—"


def output_schema(kind: str, currency: str = "SGD", price_unit: str = "M", area_unit: str = "SF") -> list[tuple[str, str, str]]:
    """(header, key, type) of an output table; price and area headers name the deal's units."""
    price, area = f"Price ({currency} {price_unit})", f"({area_unit})"
    per = "psf" if area_unit == "SF" else "psm"
    columns = {
        "sales": [("No.", "marker", "int"), ("Property", "property", "str"), ("Date", "sale_date", "str"), (f"GFA {area}", "gfa_sf", "int"), (price, "price_m", "float"), (f"Price ({per})", "price_psf", "int"), ("FTM yield", "npi_yield", "pct"), ("Adj. yield", "adj_yield", "pct")],
        "rent": [("No.", "marker", "int"), ("Property", "property", "str"), ("Date", "lease_date", "str"), (f"NLA {area}", "nla_sf", "int"), (f"Asking ({per})", "asking_rent", "float"), (f"Effective ({per})", "eff_rent", "float")],
        "land": [("No.", "marker", "int"), ("Site", "property", "str"), ("Date", "launch_date", "str"), ("Tenure", "tenure_yrs", "int"), (f"Max GFA {area}", "max_gfa_sf", "int"), (price, "price_m", "float"), (f"Price ({per} ppr)", "psf_ppr", "int")],
    }
    return columns[kind]


_TYPES = {"int": "long", "float": "double", "pct": "double", "str": "string"}


def to_output(records: DataFrame, kind: str, **units: str) -> DataFrame:
    """The records under an output schema's types, key by key, missing keys null."""
    have = set(records.columns)
    return records.select(*[(F.col(k) if k in have else F.lit(None)).cast(_TYPES[t]).alias(k) for _, k, t in output_schema(kind, **units)])


def shown(value: Column) -> Column:
    """A cell as text; nothing is shown as a dash."""
    return F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit(ABSENT))


def sections(subject: DataFrame, comps: DataFrame, averages: DataFrame) -> DataFrame:
    """Subject, comps and averages as one ordered table (section_ord, section)."""
    part = lambda df, i, name: df.withColumn("section_ord", F.lit(i)).withColumn("section", F.lit(name))
    return part(subject, 0, "subject").unionByName(part(comps, 1, "comp"), allowMissingColumns=True).unionByName(part(averages, 2, "average"), allowMissingColumns=True)


def attach_verdicts(records: DataFrame, verdicts: DataFrame, fields: dict[str, object]) -> DataFrame:
    """One row per record: verdict columns by pos, with defaults where there is none."""
    joined = records.join(verdicts.select("pos", *fields), "pos", "left")
    return joined.withColumns({f: F.coalesce(F.col(f), F.lit(d)) for f, d in fields.items()})


def guard_edits(records: DataFrame, edits: DataFrame, numeric: list[str], locked: tuple[str, ...] = ("property_name",)) -> DataFrame:
    """pos, field, verdict of proposed edits (pos, field, new_value, evidence) against the records' values and source text.

    Names are locked; a number may not be swapped for another that the record
    holds elsewhere; a value may be blanked only where the text does not hold it;
    a new value must stand in its evidence and the evidence in the source text."""
    melted = records.select("pos", "source_text", F.explode(F.map_from_arrays(F.array(*map(F.lit, numeric)), F.array(*[F.col(f).cast("string") for f in numeric]))).alias("field", "old"), F.array(*[F.col(f).cast("string") for f in numeric]).alias("all"))
    j = edits.join(melted, ["pos", "field"], "left")
    new, old = F.coalesce("new_value", F.lit("")), F.coalesce("old", F.lit(""))
    bare = lambda c: F.replace(c, F.lit(","), F.lit(""))
    verdict = (
        F.when(F.col("field").isin(*locked), "locked").when(~F.col("field").isin(*numeric), "unknown field")
        .when((new == "") & (old != "") & F.col("source_text").contains(old), "blanking a value that stands in the text")
        .when((new != "") & (new != old) & F.array_contains("all", new), "swap")
        .when((new != "") & ~(bare(F.coalesce("evidence", F.lit(""))).contains(bare(new)) & F.col("source_text").contains(F.coalesce("evidence", F.lit("")))), "no evidence").otherwise("applied")
    )
    return j.select("pos", "field", F.coalesce(verdict, F.lit("no evidence")).alias("verdict"))


def apply_edits(records: DataFrame, verdicts: DataFrame, edits: DataFrame, field: str) -> DataFrame:
    ok = verdicts.where("verdict = 'applied'").join(edits, ["pos", "field"]).where(F.col("field") == field).groupBy("pos").agg(F.max("new_value").alias("_new"), F.lit(True).alias("_set"))
    return records.join(ok, "pos", "left").withColumn(field, F.when(F.col("_set"), F.nullif("_new", F.lit("")).try_cast("double")).otherwise(F.col(field))).drop("_new", "_set")


def provenance_tier(prov: Column, page: Column) -> Column:
    """cell, page or none."""
    return F.when(F.coalesce(F.size(prov), F.lit(0)) > 0, "cell").when(page.isNotNull(), "page").otherwise("none")


def kept_verbatim(values: Column, page_text: Column) -> Column:
    """The entries of a map whose value stands in the page's text."""
    t = F.lower(F.replace(page_text, F.lit(","), F.lit("")))
    return F.map_filter(values, lambda k, v: t.contains(F.lower(F.replace(v, F.lit(","), F.lit("")))))


#: Search tiers, nearest first, and the years they reach back.
TIERS = (("proximity", 2), ("city", 2), ("city", 4), ("country", 5))


def ladder(candidates: DataFrame, min_results: int, by: str) -> DataFrame:
    """Candidates (tier: 0..) of the nearest tiers that together give enough, by running counts over tiers; a driver loop is not needed once candidates are in a table."""
    per = candidates.groupBy(by, "tier").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(by).orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = per.withColumn("before", before).where(F.col("before") < min_results).select(by, "tier")
    return candidates.join(open_, [by, "tier"], "left_semi")


def query_text(asset: Column, place: Column, tier: Column, years: Column) -> Column:
    where = F.when(tier == "proximity", F.concat(F.lit("near "), place)).when(tier == "city", F.concat(F.lit("in "), place)).otherwise(F.lit("nationwide"))
    return F.concat_ws(" ", asset, F.lit("transactions"), where, years)


#: Report types in the order in which they are worked on.
PLAN_ORDER = ("rent", "sales", "land")


def plan_steps(files: DataFrame) -> DataFrame:
    """file, step, type: a step for each classified file in working order, others to ``unknown``."""
    known = F.array(*map(F.lit, PLAN_ORDER))
    kind = F.when(F.array_contains(known, F.col("type")), F.col("type")).otherwise("unknown")
    return files.select("file", kind.alias("type"), F.row_number().over(Window.partitionBy("deal").orderBy(F.when(kind == "unknown", 99).otherwise(F.array_position(known, kind)), "file")).alias("step"), "deal")


def citation_cascade(pdf: Column, web: Column, deal: Column) -> Column:
    return F.when(pdf.isNotNull(), "pdf").when(web.isNotNull(), "web").when(deal.isNotNull(), "deal").otherwise("unverified")


def address_queries(name: Column, address: Column, hint: Column) -> Column:
    """Distinct query strings for a geocoder, the most exact first."""
    core = F.trim(F.regexp_replace(name, r"\(.*?\)", ""))
    return F.array_distinct(F.array_compact(F.array(address, F.concat_ws(", ", address, hint), F.concat_ws(", ", core, hint), core)))


def looks_like_address(address: Column) -> Column:
    return ~text.is_placeholder(address) & address.rlike(r"\d") & F.lower(address).rlike(r"\b(street|st|road|rd|avenue|ave|drive|lane|way|boulevard|quay|crescent|place)\b")
