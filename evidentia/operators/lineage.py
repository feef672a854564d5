"""Where a field comes from: cells, pages, and what a page must hold for a value to live.

Lineage is carried with the record as a map from field to the place that it was
read at; pages are a table of their own and are joined once per record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text

#: Type of a lineage map: field to place. A record without one knows at most its page.
PROVENANCE = "map<string,struct<page:int,table:int,line:int,column:int>>"


def tier(prov: Column, page: Column) -> Column:
    """cell: a value was read from a table cell; page: only the page is known (not null, not 0); none."""
    return F.when(F.coalesce(F.size(prov), F.lit(0)) > 0, "cell").when(F.coalesce(page, F.lit(0)) != 0, "page").otherwise("none")


def audit(records: DataFrame) -> DataFrame:
    """source, tier, field, records, fields_known: by source and tier how many records there are, and how many know each field's cell."""
    rows = records.withColumn("tier", tier(F.col("prov"), F.col("prov_page")))
    per = rows.groupBy("source", "tier").agg(F.count("*").alias("records"))
    known = rows.where("tier = 'cell'").select("source", "tier", F.explode(F.map_keys("prov")).alias("field")).groupBy("source", "tier", "field").agg(F.count("*").alias("known"))
    return per.join(known, ["source", "tier"], "left").select("source", "tier", "field", "records", F.coalesce("known", F.lit(0).cast("long")).alias("known"))


def normal(value: Column) -> Column:
    """Lower case, every run of blanks one blank, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"\s+", " "))


def stands_in(value: Column, context: Column, bare: Column) -> Column:
    """Whether a value stands in a context (``normal``), or without its commas in ``bare``, the context without commas."""
    v = normal(value)
    return (v != "") & (context.contains(v) | bare.contains(F.replace(v, F.lit(","), F.lit(""))))


def bind_to_pages(rows: DataFrame, pages: DataFrame, useful: list[str]) -> DataFrame:
    """Rows read off a page's picture (row, page, fields: map<string,string>) bound to what the page's text
    (page, text) holds: a field stays only if its value stands there, a row only if it keeps a name and one of ``useful``.

    ``dropped`` counts the fields that went. A row whose page has no text loses all its fields, and so goes."""
    context = pages.select("page", normal(F.col("text")).alias("context")).withColumn("bare", F.replace("context", F.lit(","), F.lit("")))
    j = rows.join(context, "page")
    bound = F.map_filter("fields", lambda k, v: F.coalesce(stands_in(v, F.col("context"), F.col("bare")), F.lit(False)))
    out = j.select("row", "page", bound.alias("fields"), (F.size("fields") - F.size(bound)).alias("dropped"))
    has = lambda k: F.coalesce(F.btrim(F.element_at("fields", k)) != "", F.lit(False))
    return out.where(has("property_name") & F.exists(F.array(*map(has, useful)), lambda x: x)).withColumn("prov_page", F.col("page"))


def fix_names(records: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``records`` (pos, property_name, ..) with names corrected by ``verdicts`` (pos, seq, corrected), in order of seq.

    A correction counts if it differs from the name as printed by look-alike characters
    only; the first that counts is taken. ``fix`` is fixed, blocked (none of the
    verdicts counts) or null (there is none)."""
    j = verdicts.where("coalesce(corrected, '') <> ''").join(records.select("pos", "property_name"), "pos")
    ok = text.confusable_only(F.col("property_name"), F.col("corrected"))
    per = j.groupBy("pos").agg(F.min(F.when(ok, F.struct("seq", "corrected"))).alias("best"))
    out = records.join(per.withColumn("asked", F.lit(True)), "pos", "left")
    fix = F.when(F.col("best").isNotNull(), "fixed").when(F.col("asked"), "blocked")
    return out.withColumn("fix", fix).withColumn("property_name", F.coalesce("best.corrected", "property_name")).drop("best", "asked")
