"""Search rules in layers: house rules, recency by kind of evidence, asset class, the deal's own.

Every layer is a map of rule to number; a later layer overrides an earlier one
key by key, and a deal's own block wins whatever it states, a null included.
Rules that only a deal knows are carried along.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: House rules, recency in months by kind of evidence, and overrides by asset class. Fixed values.
HOUSE = {"proximity_km": 3.0, "city_km": 25.0, "min_results": 3, "max_results": 15, "max_queries": 5, "years_back": 2, "years_back_max": 5, "years_back_step": 2, "max_level": 3}
RECENCY_MONTHS = {"sales": 60, "land": 60, "rent": 36}
RECENCY_DEFAULT = 60
BY_ASSET_CLASS = {"logistics": {"proximity_km": 5.0, "city_km": 50.0}, "industrial": {"proximity_km": 5.0, "city_km": 50.0}}


def rule_map(rules: dict) -> Column:
    if not rules:
        return F.from_json(F.lit("{}"), "map<string,double>")
    return F.create_map(*[c for k, v in rules.items() for c in (F.lit(k), F.lit(float(v)))])


def over(lower: Column, upper: Column) -> Column:
    """The entries of ``upper``, and those of ``lower`` whose keys it doesn't have."""
    keys = F.map_keys(upper)
    return F.map_concat(F.map_filter(lower, lambda k, v: ~F.array_contains(keys, k)), upper)


def layers(comp_type: Column, asset_class: Column, block: Column) -> list[Column]:
    """The four layers, lowest first; missing ones are empty."""
    recency = F.lit(float(RECENCY_DEFAULT))
    for kind, months in RECENCY_MONTHS.items():
        recency = F.when(comp_type == kind, float(months)).otherwise(recency)
    by_class, name = rule_map({}), F.lower(F.trim(F.coalesce(asset_class, F.lit(""))))
    for kind, rules in BY_ASSET_CLASS.items():
        by_class = F.when(name == kind, rule_map(rules)).otherwise(by_class)
    return [rule_map(HOUSE), F.create_map(F.lit("recency_months"), recency), by_class, F.coalesce(block, rule_map({}))]


def _labelled(rules: Column, layer: str) -> Column:
    return F.transform_values(rules, lambda k, v: F.lit(layer))


def effective_rules(deals: DataFrame) -> DataFrame:
    """``deals`` (comp_type, asset_class, block: map<string,double>) with ``rules``, the map in force, ``set_by``, the
    layer of each rule, and ``warning`` where queries reach further back than results are kept."""
    four = layers(F.col("comp_type"), F.col("asset_class"), F.col("block"))
    named = [_labelled(m, n) for m, n in zip(four, ("house", "recency", "asset class", "deal"), strict=True)]
    out = deals.withColumn("rules", functools.reduce(over, four)).withColumn("set_by", functools.reduce(over, named))
    years, kept = F.element_at("rules", "years_back_max"), F.element_at("rules", "recency_months") / 12
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.format_string("%.6f", c), "0+$", ""), r"\.$", "")
    return out.withColumn("warning", F.when(years > kept, F.concat(F.lit("years_back_max "), plain(years), F.lit(" reaches past the "), plain(kept), F.lit(" years that are kept"))))
