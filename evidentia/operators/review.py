"""What a reviewer checks: flags and their counts, pages to rescue, notes on judged values, deal units, cached searches, shared shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators.retrieval import contained_claims

#: Currencies by country, as configurations name it; others are in US dollars. Fixed values.
CURRENCIES = {"united states": "USD", "usa": "USD", "us": "USD", "united kingdom": "GBP", "uk": "GBP", "germany": "EUR", "france": "EUR", "india": "INR", "indonesia": "IDR", "malaysia": "MYR", "thailand": "THB", "vietnam": "VND", "philippines": "PHP"}
FALLBACK = "USD"


def deal_units(deals: DataFrame) -> DataFrame:
    """``deals`` (currency, country_name, price_unit, area_unit) with unit_currency, unit_price and unit_area: what is
    stated, else the country's currency, millions and square metres."""
    stated = F.nullif(F.btrim(F.coalesce("currency", F.lit(""))), F.lit(""))
    of_country = F.element_at(F.create_map(*[F.lit(x) for pair in CURRENCIES.items() for x in pair]), F.lower(F.btrim(F.coalesce("country_name", F.lit("")))))
    return deals.withColumns({"unit_currency": F.coalesce(stated, of_country, F.lit(FALLBACK)), "unit_price": F.upper(F.coalesce("price_unit", F.lit("M"))), "unit_area": F.lower(F.coalesce("area_unit", F.lit("sqm")))})


def flag_counts(records: DataFrame, by: str) -> DataFrame:
    """``by``, flag, records, total: how many records bear each flag (``flags``: array), and how many flags there are in all of the group."""
    total = records.groupBy(by).agg(F.sum(F.size("flags")).alias("total"))
    per = records.select(by, F.explode(F.array_distinct("flags")).alias("flag")).groupBy(by, "flag").agg(F.count("*").alias("records"))
    return per.join(total, by)


def table_ordinals(tables: DataFrame) -> DataFrame:
    """``tables`` (page, nth, ..) with on_page, how many tables the page has, ordinal, the place of this one on it (by nth), and table_id, ``p<page>#<ordinal>``."""
    page = Window.partitionBy("page")
    out = tables.withColumn("on_page", F.count("*").over(page)).withColumn("ordinal", F.row_number().over(page.orderBy("nth")))
    return out.withColumn("table_id", F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("#"), F.col("ordinal").cast("string")))


def pages_to_rescue(pages: DataFrame, records: DataFrame, refused: DataFrame) -> DataFrame:
    """Matched pages (doc, page, matched: array of keywords) that gave no useful record and have no refused table.

    ``records`` (doc, table_id, useful): a useful one counts for the page in its table_id, ``p<page>#<ordinal>``;
    ``refused`` (doc, page): pages whose tables were found to be of another kind."""
    page = F.regexp_extract("table_id", r"^p(\d+)#", 1).try_cast("long")
    served = records.where("useful").select("doc", page.alias("page")).where("page IS NOT NULL")
    open_ = pages.where(F.size("matched") > 0)
    return open_.join(served.distinct(), ["doc", "page"], "left_anti").join(refused.select("doc", "page").distinct(), ["doc", "page"], "left_anti")


#: Notes on a row that was judged rather than copied.
PARSED_NOTE = "The row was read from page text without a table: check its name and numbers."


def judgement_notes(records: DataFrame) -> DataFrame:
    """marker, name, notes: rows that hold judged values, with what was judged; rows without a note are left out.

    ``records`` has marker, property_name, llm_parsed, verify_edits (array), review_flag and verify_flag; the last is
    shown only where there is another note."""
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    edits = F.transform(F.coalesce("verify_edits", F.array().cast("array<string>")), lambda e: F.concat(F.lit("Verification changed "), e))
    first = F.array_compact(F.concat(F.array(F.when(F.col("llm_parsed"), PARSED_NOTE)), edits, F.array(F.when(some("review_flag"), F.col("review_flag")))))
    rows = records.select(F.btrim(F.coalesce("marker", F.lit(""))).alias("marker"), F.coalesce(F.nullif(F.btrim("property_name"), F.lit("")), F.lit("(unnamed)")).alias("name"), first.alias("first"), F.when(some("verify_flag"), F.array(F.concat(F.lit("Note: "), "verify_flag"))).alias("last"))
    return rows.where(F.size("first") > 0).select("marker", "name", F.when(F.col("last").isNotNull(), F.concat("first", "last")).otherwise(F.col("first")).alias("notes"))


def config_key(config: Column) -> Column:
    """Twelve characters that change with any key or value of a configuration (map<string,string>), whatever the order of its entries."""
    sized = lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)
    entries = F.transform(F.map_keys(config), lambda k: F.concat(sized(k), F.coalesce(sized(F.element_at(config, k)), F.lit("null"))))
    return F.substring(F.md5(F.array_join(F.sort_array(entries), "\n")), 1, 12)


def cached_searches(searches: DataFrame, cache: DataFrame) -> DataFrame:
    """``searches`` (deal, config: map) with key, saved (what was stored last for the deal under this key) and ``fresh``: whether to search anew.

    ``cache`` (deal, key, seq, saved): an entry of another key is out of date."""
    keyed = searches.withColumn("key", config_key(F.col("config")))
    last = cache.groupBy("deal").agg(F.max_by(F.struct("key", "saved"), "seq").alias("last"))
    j = keyed.join(last, "deal", "left")
    valid = F.coalesce(F.col("last.key") == F.col("key"), F.lit(False))
    return j.withColumn("saved", F.when(valid, F.col("last.saved"))).withColumn("fresh", ~valid).drop("last")


SHINGLE = 4


def shared_shingles(supports: DataFrame, extracts: DataFrame, k: int = SHINGLE) -> DataFrame:
    """claim_id, found: whether any window of k words of a claim's support stands in the text of the source that it names.

    ``supports`` (claim_id, source, support), ``extracts`` (source, part, text): a source's text in parts with numbers of
    their own, each looked at alone. A window is found as part of the text, so its first and last word may be pieces of longer ones; supports of
    fewer words are one window. Without a support found is null."""
    words = F.filter(F.split(F.lower("support"), r"\s+"), lambda w: w != "")
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - k + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, k), " "))
    asked = supports.select("claim_id", "source", words.alias("w")).where(F.size("w") > 0).select("claim_id", "source", F.explode(F.array_distinct(windows)).alias("text"))
    asked = asked.withColumn("item_id", F.xxhash64("text"))
    texts = extracts.where("text IS NOT NULL").select("source", F.col("part").alias("doc_id"), F.lower("text").alias("text"))
    held = contained_claims(asked.groupBy("item_id").agg(F.min("text").alias("text")), texts.select("doc_id", "text"))  # windows meet texts on grams, not on sources
    served = held.join(texts.select("doc_id", "source"), "doc_id").select("item_id", "source").distinct()
    found = asked.join(served, ["item_id", "source"]).select("claim_id").distinct().withColumn("hit", F.lit(True))
    blank = F.btrim(F.coalesce("support", F.lit(""))) == ""
    return supports.join(found, "claim_id", "left").select("claim_id", F.when(~blank, F.coalesce("hit", F.lit(False))).alias("found"))
