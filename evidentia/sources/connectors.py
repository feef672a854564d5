"""Readers of what registries and files deliver, once their bytes are in a column; and the connectors' registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURE = "features array<struct<properties:struct<id:long,sector:string,gfa:double,site_area:double,plot_ratio:double>,geometry:struct<coordinates:array<array<array<double>>>>>>"


def registry_features(payloads: DataFrame, sectors: list[str]) -> DataFrame:
    """id, sector, area, lon, lat of a registry's GeoJSON (column payload): floor area, else site area by plot ratio; the mean of the ring's vertices."""
    f = payloads.select(F.explode(F.from_json("payload", FEATURE)["features"]).alias("f")).select("f.properties.*", F.get("f.geometry.coordinates", F.lit(0)).alias("ring"))
    mean = lambda k: F.aggregate("ring", F.lit(0.0), lambda s, p: s + F.get(p, F.lit(k))) / F.size("ring")
    return f.where(F.col("sector").isin(*sectors)).select("id", "sector", F.coalesce("gfa", F.col("site_area") * F.col("plot_ratio")).alias("area"), mean(0).alias("lon"), mean(1).alias("lat"))


def html_table(pages: DataFrame, least_cells: int) -> DataFrame:
    """cells: the rows of a page's tables with enough cells."""
    rows = pages.select(F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("r"))
    cells = F.transform(F.regexp_extract_all("r", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, r"<[^>]+>|\s+", " ")))
    return rows.select(cells.alias("cells")).where(F.size("cells") >= least_cells)


def read_records(lines: DataFrame, schema: str) -> DataFrame:
    """Saved records (column value: a JSON object a row); a line that can't be read gives nulls."""
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")


def parse_lease_table(texts: DataFrame, least_rows: int = 90) -> DataFrame:
    """years, factor from a text of pairs ``N X.X``: years 1 to 99, nothing if there are too few."""
    pairs = F.regexp_extract_all("text", F.lit(r"\b(\d{1,3}) (\d{1,2}\.\d)\b"), F.lit(0))
    rows = texts.select(F.explode(F.when(F.size(pairs) >= least_rows, pairs)).alias("p"))
    years, percent = F.split("p", " ")[0].try_cast("int"), F.split("p", " ")[1].try_cast("double")
    return rows.select(years.alias("years"), (percent / 100).alias("factor")).where("years BETWEEN 1 AND 99")


@dataclass(frozen=True)
class Connector:
    name: str
    market: str
    comp_types: frozenset[str]
    read: Callable


_connectors: dict[str, Connector] = {}


def register(connector: Connector) -> None:
    _connectors[connector.name] = connector


def available(market: str, comp_type: str, enabled: list[str]) -> list[Connector]:
    """Connectors for a market and a type, in the order in which they are enabled."""
    return [c for n in enabled if (c := _connectors.get(n)) and c.market in ("", market) and comp_type in c.comp_types]
