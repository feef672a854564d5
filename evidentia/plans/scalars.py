"""Queries of the scalar parsers over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import dates, num, text
from evidentia.plans.register import query
from evidentia.sources.surrogate import COMPS_SQL, LAND_SQL, land_sales, sale_comps

AS_OF = (2026, 6)

#: parse_num in DuckDB, for a column.
_bare = lambda c: f"trim(regexp_replace({c}, '[,$%]', '', 'g'))"
_ends = r"^(\d+(?:\.\d+)?)\s*[-–]\s*(\d+(?:\.\d+)?)"


def num_sql(c: str) -> str:
    b = _bare(c)
    return (
        f"CASE WHEN regexp_matches({b}, '{_ends}') THEN (CAST(regexp_extract({b}, '{_ends}', 1) AS DOUBLE) + CAST(regexp_extract({b}, '{_ends}', 2) AS DOUBLE)) / 2 "
        f"ELSE try_cast(regexp_replace({b}, '[^0-9.]', '', 'g') AS DOUBLE) END"
    )


@query("q_num1_parse_num", f"WITH {COMPS_SQL} SELECT pos, {num_sql('raw_number')} AS value FROM comps")
def parse_num(spark, sf):
    return sale_comps(spark, sf).select("pos", num.parse_num(F.col("raw_number")).alias("value"))


@query("q_num2_cap_rate", f"WITH {COMPS_SQL}, v AS (SELECT pos, {num_sql('raw_number')} AS v FROM comps) SELECT pos, CASE WHEN v >= 1 THEN v / 100 ELSE v END AS cap_rate FROM v")
def cap_rate(spark, sf):
    return sale_comps(spark, sf).select("pos", num.parse_cap_rate(F.col("raw_number")).alias("cap_rate"))


@query("q_num3_signed_num", f"WITH {COMPS_SQL} SELECT pos, try_cast(regexp_replace(raw_number, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS value FROM comps")
def signed(spark, sf):
    return sale_comps(spark, sf).select("pos", num.signed_num(F.col("raw_number")).alias("value"))


@query("q_num4_plain_num", f"WITH {COMPS_SQL} SELECT pos, try_cast(trim(regexp_replace(raw_number, '[,$]', '', 'g')) AS DOUBLE) AS value FROM comps")
def plain(spark, sf):
    return sale_comps(spark, sf).select("pos", num.plain_num(F.col("raw_number")).alias("value"))


@query("q_num5_sqm_to_sf", f"WITH {COMPS_SQL} SELECT pos, round_even(price_m * 10.7639, 1) AS area_sf FROM comps")
def sqm(spark, sf):
    return sale_comps(spark, sf).select("pos", num.sqm_to_sf(F.col("price_m").cast("string")).alias("area_sf"))


_HEADERS = "CASE p_partkey % 9 WHEN 0 THEN 'GFA (sqm)' WHEN 1 THEN 'Area sq m' WHEN 2 THEN 'NLA (sq ft)' WHEN 3 THEN 'Price (S$''000)' WHEN 4 THEN 'Price S$ billion' WHEN 5 THEN 'Price (S$ M)' WHEN 6 THEN 'Rent (psm)' WHEN 7 THEN 'Rent per sq m' ELSE 'Rent psf' END"
_FIELDS = "CASE WHEN p_partkey % 9 < 3 THEN 'gfa_sf' WHEN p_partkey % 9 < 6 THEN 'price_sgd_m' WHEN p_partkey % 9 < 9 THEN 'asking_rent' END"


@query(
    "q_num6_unit_multiplier",
    f"""WITH h AS (SELECT p_partkey, lower({_HEADERS}) AS h, {_FIELDS} AS f FROM part)
SELECT p_partkey, f AS field, CASE f
  WHEN 'gfa_sf' THEN CASE WHEN regexp_matches(h, 'sqm|m²|m2|sq\\.?\\s*m(\\s|$|\\))') THEN 10.7639 ELSE 1.0 END
  WHEN 'price_sgd_m' THEN CASE WHEN regexp_matches(h, '\\b(billion|bn|bil|b)\\b') THEN 1000.0 WHEN regexp_matches(h, '[''‘’]000|thousand') THEN 0.001 ELSE 1.0 END
  ELSE CASE WHEN regexp_matches(h, '\\bpsm\\b|per\\s*sq\\.?\\s*m(\\s|$)|per\\s*sqm\\b') THEN 10.7639 ELSE 1.0 END END::DOUBLE AS multiplier FROM h""",
)
def units(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.expr(_HEADERS.replace("''000", "\\'000")).alias("h"), F.expr(_FIELDS).alias("field"))
    return part.select("p_partkey", "field", num.unit_multiplier(F.col("h"), F.col("field")).alias("multiplier"))


@query("q_num7_magnitude_guard", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN round_even(o_totalprice / 1000000, 3) ELSE o_totalprice END AS price_m FROM orders")
def magnitude(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", num.magnitude_guard(F.col("o_totalprice")).alias("price_m"))


@query(
    "q_num8_psf_split",
    f"WITH {COMPS_SQL} SELECT pos, CASE WHEN regexp_matches(raw_number, '(?i)\\b(million|mil|mn|billion|bn)\\b') THEN NULL ELSE {num_sql('raw_number')} END AS psf, "
    "CASE WHEN regexp_matches(raw_number, '(?i)\\b(million|mil|mn|billion|bn)\\b') THEN trim(raw_number) END AS display FROM comps",
)
def psf_split(spark, sf):
    r = F.col("raw_number")
    return sale_comps(spark, sf).select("pos", num.psf_value(r).alias("psf"), num.psf_display(r).alias("display"))


@query("q_num9_range_display", f"WITH {COMPS_SQL}, c AS (SELECT pos, trim(regexp_replace(raw_number, '[*†#]', '', 'g')) AS t FROM comps) SELECT pos, CASE WHEN regexp_matches(t, '^\\d[\\d,.]*\\s*[-–]\\s*\\d') THEN t END AS display FROM c")
def range_text(spark, sf):
    return sale_comps(spark, sf).select("pos", num.range_display(F.col("raw_number")).alias("display"))


@query(
    "q_num10_stake",
    f"""WITH {COMPS_SQL} SELECT pos, CASE WHEN regexp_matches(lower(sale_type), 'whole|block sale|en bloc') THEN 1.0
  WHEN regexp_matches(sale_type, '\\d+(?:\\.\\d+)?\\s*%') THEN CAST(regexp_extract(sale_type, '(\\d+(?:\\.\\d+)?)\\s*%', 1) AS DOUBLE) / 100
  WHEN regexp_matches(sale_type, '\\(\\d+\\s*/\\s*\\d+\\s*stake') THEN CAST(regexp_extract(sale_type, '\\((\\d+)\\s*/\\s*(\\d+)\\s*stake', 1) AS DOUBLE) / CAST(regexp_extract(sale_type, '\\((\\d+)\\s*/\\s*(\\d+)\\s*stake', 2) AS DOUBLE)
  ELSE 1.0 END::DOUBLE AS stake FROM comps""",
)
def stake(spark, sf):
    return sale_comps(spark, sf).select("pos", num.stake_fraction(F.col("sale_type"), F.lit("")).alias("stake"))


@query("q_num11_significant", f"WITH {COMPS_SQL} SELECT pos, try_cast(replace(regexp_extract(raw_number, '-?\\d[\\d,]*\\.?\\d*', 0), ',', '') AS DOUBLE) AS value FROM comps")
def significant(spark, sf):
    return sale_comps(spark, sf).select("pos", num.significant_number(F.col("raw_number")).alias("value"))


@query("q_num12_blank_if_absent", f"WITH {COMPS_SQL} SELECT pos, nullif(remaining_yrs, 0) AS years, nullif(npi_yield, 0) AS yield FROM comps")
def blank(spark, sf):
    return sale_comps(spark, sf).select("pos", num.blank_if_absent(F.col("remaining_yrs")).alias("years"), num.blank_if_absent(F.col("npi_yield")).alias("yield"))


@query("q_num13_millions_display", f"WITH {COMPS_SQL} SELECT pos, CASE WHEN pos % 2 = 0 THEN round_even(price_m / 1000, 4) ELSE price_m END AS shown FROM comps")
def millions(spark, sf):
    return sale_comps(spark, sf).select("pos", num.millions_display(F.col("price_m"), F.when(F.col("pos") % 2 == 0, "B").otherwise("M")).alias("shown"))


@query("q_num14_normal_price", f"WITH {COMPS_SQL} SELECT pos, regexp_replace(raw_number, '[*†‡\\s]', '', 'g') AS price FROM comps")
def normal_price(spark, sf):
    return sale_comps(spark, sf).select("pos", num.normal_price(F.col("raw_number")).alias("price"))


@query("q_num15_scale_variants", f"WITH {COMPS_SQL} SELECT pos, unnest([price_m, price_m * 1000, price_m / 1000, price_m * 1000000, price_m / 1000000]) AS variant FROM comps WHERE price_m IS NOT NULL")
def variants(spark, sf):
    return sale_comps(spark, sf).where("price_m IS NOT NULL").select("pos", F.explode(num.scale_variants(F.col("price_m"))).alias("variant"))


@query("q_num16_figure_spellings", f"WITH {COMPS_SQL} SELECT pos, CAST(gfa_sf AS VARCHAR) AS whole, format('{{:,}}', gfa_sf) AS grouped FROM comps WHERE gfa_sf IS NOT NULL")
def spellings(spark, sf):
    c = num.figure_candidates(F.col("gfa_sf").cast("double"))
    return sale_comps(spark, sf).where("gfa_sf IS NOT NULL").select("pos", F.get(c, F.lit(0)).alias("whole"), F.get(c, F.lit(1)).alias("grouped"))


@query("q_num17_grid_format", f"WITH {COMPS_SQL} SELECT pos, CASE WHEN pos % 3 = 0 THEN CAST(gfa_sf AS VARCHAR) ELSE format('{{:,}}', gfa_sf) || '.0' END AS shown FROM comps WHERE gfa_sf IS NOT NULL")
def grid_format(spark, sf):
    kind = F.when(F.col("pos") % 3 == 0, "marker").otherwise("number")
    return sale_comps(spark, sf).where("gfa_sf IS NOT NULL").select("pos", num.grid_value(F.col("gfa_sf").cast("double"), kind).alias("shown"))


@query("q_num18_grid_parse", f"WITH {COMPS_SQL} SELECT pos, CASE WHEN raw_number LIKE '%\\%' ESCAPE '\\' THEN try_cast(regexp_replace(raw_number, '[,%]', '', 'g') AS DOUBLE) / 100 ELSE try_cast(regexp_replace(raw_number, '[,%]', '', 'g') AS DOUBLE) END AS value FROM comps")
def grid_parse(spark, sf):
    return sale_comps(spark, sf).select("pos", num.grid_parse(F.col("raw_number")).alias("value"))


_MON = "list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower({}[1:3]))"


@query(
    "q_dat1_sale_date",
    f"""WITH {COMPS_SQL} SELECT pos, CASE
  WHEN sale_date = '' THEN '' WHEN regexp_matches(sale_date, '^Q[1-4]') THEN sale_date
  WHEN regexp_matches(sale_date, '^[A-Z][a-z]{{2}} \\d{{4}}$') THEN 'Q' || CAST(ceil({_MON.format('sale_date')} / 3) AS INTEGER) || ' ' || sale_date[5:8]
  WHEN regexp_matches(sale_date, '^\\d{{4}}-') THEN 'Q' || CAST(ceil(CAST(sale_date[6:7] AS INTEGER) / 3) AS INTEGER) || ' ' || sale_date[1:4]
  WHEN sale_date LIKE '%/%' THEN 'Q' || CAST(ceil(CASE WHEN CAST(sale_date[1:2] AS INTEGER) <= 12 THEN CAST(sale_date[1:2] AS INTEGER) ELSE CAST(sale_date[4:5] AS INTEGER) END / 3) AS INTEGER) || ' ' || sale_date[7:10]
  WHEN sale_date LIKE '~%' THEN sale_date[5:8] ELSE sale_date END AS sale_quarter FROM comps""",
)
def sale_date(spark, sf):
    return sale_comps(spark, sf).select("pos", dates.parse_sale_date(F.col("sale_date")).alias("sale_quarter"))


_TENURE = "CASE pos % 5 WHEN 0 THEN 'Freehold' WHEN 1 THEN concat('99 years from ', CAST(1950 + pos % 70 AS {s})) WHEN 2 THEN concat(CAST(pos % 99 + 1 AS {s}), ' yrs') WHEN 3 THEN '999 yrs' ELSE concat(CAST(pos % 60 AS {s}), '-yr lease') END"


@query(
    "q_dat2_remaining_years",
    f"""WITH {COMPS_SQL}, t AS (SELECT pos, {_TENURE.format(s='VARCHAR')} AS t FROM comps)
SELECT pos, CASE pos % 5 WHEN 0 THEN 999.0 WHEN 1 THEN greatest(99 - (2026 - (1950 + pos % 70)), 0) WHEN 2 THEN pos % 99 + 1 WHEN 3 THEN 999 ELSE pos % 60 END::DOUBLE AS years FROM t""",
)
def remaining(spark, sf):
    return sale_comps(spark, sf).select("pos", F.expr(_TENURE.format(s="STRING")).alias("t")).select("pos", dates.remaining_years(F.col("t"), AS_OF[0]).alias("years"))


@query(
    "q_dat3_dat4_tenures",
    f"""WITH {COMPS_SQL}, t AS (SELECT pos, {_TENURE.format(s='VARCHAR')} AS t, try_cast(regexp_extract({_TENURE.format(s='VARCHAR')}, '(\\d+)', 1) AS INTEGER) AS y FROM comps)
SELECT pos, CASE WHEN t = 'Freehold' OR y >= 999 THEN 0 ELSE coalesce(y, 0) END AS land_yrs, CASE WHEN t = 'Freehold' THEN NULL ELSE try_cast(regexp_extract(t, '(?i)(\\d+)\\s*yr', 1) AS INTEGER) END AS registry_yrs FROM t""",
)
def tenures(spark, sf):
    t = sale_comps(spark, sf).select("pos", F.expr(_TENURE.format(s="STRING")).alias("t"))
    return t.select("pos", dates.land_tenure(F.col("t")).alias("land_yrs"), dates.registry_tenure(F.col("t")).alias("registry_yrs"))


_AGO_YM = f"""CASE WHEN lower(sale_date) LIKE '%q%' THEN CAST(right(sale_date, 4) AS INTEGER) WHEN regexp_matches(sale_date, '^[A-Z][a-z]{{2}} ') THEN CAST(sale_date[5:8] AS INTEGER)
  WHEN regexp_matches(sale_date, '^\\d{{4}}') THEN CAST(sale_date[1:4] AS INTEGER) WHEN sale_date LIKE '%/%' THEN CAST(sale_date[7:10] AS INTEGER) END AS y,
  CASE WHEN lower(sale_date) LIKE '%q%' THEN (CAST(regexp_extract(sale_date, 'Q(\\d)', 1) AS INTEGER) - 1) * 3 + 2 WHEN regexp_matches(sale_date, '^[A-Z][a-z]{{2}} ') THEN {_MON.format('sale_date')} ELSE 6 END AS m"""


@query("q_dat5_months_ago", f"WITH {COMPS_SQL}, t AS (SELECT pos, {_AGO_YM} FROM comps) SELECT pos, CAST(greatest((2026 - y) * 12 + (6 - m), 0 * y) AS INTEGER) AS months FROM t")
def months(spark, sf):
    return sale_comps(spark, sf).select("pos", dates.months_ago(F.col("sale_date"), *AS_OF).alias("months"))


DATE_SQL = """CASE WHEN regexp_matches({c}, '^\\d{{4}}$') THEN make_date(CAST({c} AS INTEGER), 1, 1) WHEN regexp_matches({c}, '^~?Q[1-4]') THEN make_date(CAST(right({c}, 4) AS INTEGER), (CAST(regexp_extract({c}, 'Q(\\d)', 1) AS INTEGER) - 1) * 3 + 1, 1)
  ELSE coalesce(try_strptime({c}, '%Y-%m-%d'), try_strptime({c}, '%d/%m/%Y'), try_strptime({c}, '%b %Y'))::DATE END"""


@query("q_dat6_try_date", f"WITH {COMPS_SQL} SELECT pos, strftime({DATE_SQL.format(c='sale_date')}, '%Y-%m-%d') AS date FROM comps")
def try_date(spark, sf):
    return sale_comps(spark, sf).select("pos", F.date_format(dates.try_date(F.col("sale_date")), "yyyy-MM-dd").alias("date"))


_TITLE = "CASE pos % 8 WHEN 0 THEN concat('Market Beat Q', CAST(pos % 4 + 1 AS {s}), ' 2025') WHEN 1 THEN concat('office_', CAST(pos % 4 + 1 AS {s}), 'Q24') WHEN 2 THEN concat('Report ', CAST(pos % 2 + 1 AS {s}), 'H 2023') WHEN 3 THEN 'Outlook Mar 2024' WHEN 4 THEN 'review 2022' WHEN 5 THEN concat('2024 Q', CAST(pos % 4 + 1 AS {s})) WHEN 6 THEN 'Fund factsheet' ELSE 'Land Sept''23' END"
_COVER = "CASE WHEN pos % 3 = 0 THEN 'published in 2Q 2021' ELSE 'no period here 1999' END"
_PERIOD_SQL = """CASE pos % 8 WHEN 0 THEN 'Q' || CAST(pos % 4 + 1 AS VARCHAR) || ' 2025' WHEN 1 THEN 'Q' || CAST(pos % 4 + 1 AS VARCHAR) || ' 2024' WHEN 2 THEN CASE WHEN pos % 2 + 1 = 1 THEN 'Q2 2023' ELSE 'Q4 2023' END
  WHEN 3 THEN 'Mar 2024' WHEN 4 THEN '2022' WHEN 5 THEN 'Q' || CAST(pos % 4 + 1 AS VARCHAR) || ' 2024' WHEN 6 THEN CASE WHEN pos % 3 = 0 THEN 'Q2 2021' ELSE '' END ELSE 'Sep 2023' END"""


@query("q_dat7_dat8_report_period", f"WITH {COMPS_SQL} SELECT pos, {_PERIOD_SQL} AS period FROM comps")
def period(spark, sf):
    t = sale_comps(spark, sf).select("pos", F.expr(_TITLE.format(s="STRING").replace("Sept''23", "Sept\\'23")).alias("title"), F.expr(_COVER).alias("cover"))
    return t.select("pos", dates.report_period(F.col("title"), F.col("cover")).alias("period"))


@query(
    "q_dat9_backfill",
    f"""WITH {COMPS_SQL}, periods AS (SELECT * FROM (VALUES ('pdf_1', 'Q4 2023'), ('pdf_2', 'Mar 2024')) p(source, period))
SELECT pos, CASE WHEN trim(coalesce(sale_date, '')) <> '' THEN sale_date WHEN period IS NOT NULL THEN '~' || period ELSE sale_date END AS sale_date FROM comps LEFT JOIN periods USING (source)""",
)
def backfill(spark, sf):
    periods = spark.createDataFrame([("pdf_1", "Q4 2023"), ("pdf_2", "Mar 2024")], "source string, period string")
    from evidentia.operators.evidence import backfill_dates

    return backfill_dates(sale_comps(spark, sf), periods, "sale_date").select("pos", "sale_date")


@query("q_dat10_fallback_year", f"WITH {COMPS_SQL} SELECT pos, CASE WHEN pos % 2 = 0 THEN 'Q1 2025' ELSE 'Q' || CAST(pos % 4 + 1 AS VARCHAR) || ' 2025' END AS sale_quarter FROM comps")
def fallback(spark, sf):
    t = sale_comps(spark, sf).select("pos", F.expr("CASE WHEN pos % 2 = 0 THEN 'Jan' ELSE concat('Q', CAST(pos % 4 + 1 AS STRING)) END").alias("t"))
    return t.select("pos", dates.parse_sale_date(F.col("t"), F.lit("2025")).alias("sale_quarter"))


@query("q_dat11_dat12_windows", "SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) || ' OR ' || CAST(year(o_orderdate) - 1 AS VARCHAR) AS years, strftime(o_orderdate, '%b %Y') AS awarded FROM orders")
def windows(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select("o_orderkey", dates.year_window(F.year("o_orderdate"), 2).alias("years"), dates.award_date(F.date_format("o_orderdate", "yyyyMMdd")).alias("awarded"))


@query("q_dat13_date_like", f"WITH {COMPS_SQL} SELECT pos, NOT (sale_date IN ('', 'soon')) AS like_date FROM comps")
def date_like(spark, sf):
    return sale_comps(spark, sf).select("pos", dates.looks_like_date(F.regexp_replace("sale_date", "^~", "")).alias("like_date"))


@query("q_str1_header_key", "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_type || ' (' || p_brand || ')'), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM part")
def header_key(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", text.header_key(F.concat("p_type", F.lit(" ("), "p_brand", F.lit(")"))).alias("key"))


@query("q_str2_name_key", f"WITH {COMPS_SQL} SELECT pos, regexp_replace(lower(property_name), '\\W+', '', 'g')[1:24] || '_' || CAST(CAST(round_even(price_m, 0) AS BIGINT) AS VARCHAR) AS key FROM comps")
def name_key(spark, sf):
    return sale_comps(spark, sf).select("pos", text.name_key(F.col("property_name"), F.col("price_m")).alias("key"))


@query(
    "q_str3_name_overlap",
    """WITH t AS (SELECT s_suppkey, string_split(lower(s_name), '#') AS a, string_split('supplier#000000001', '#') AS b FROM supplier)
SELECT s_suppkey, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE AS overlap FROM t""",
)
def overlap(spark, sf):
    return spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", text.name_overlap(F.col("s_name"), F.lit("Supplier#000000001")).alias("overlap"))


@query("q_str4_str9_property_cell", f"WITH {COMPS_SQL} SELECT pos, property_name || CASE WHEN address IS NULL THEN '' ELSE ' ' || address END AS clean, property_name || CASE WHEN address IS NULL THEN '' ELSE chr(10) || address END AS cell FROM comps")
def property_cell(spark, sf):
    cell = F.concat_ws("\n", "property_name", "address")
    return sale_comps(spark, sf).select("pos", text.clean_property_name(cell).alias("clean"), cell.alias("cell"))


@query("q_str8_source_label", f"WITH {COMPS_SQL} SELECT pos, 'PDF ' || source[5:] AS label FROM comps")
def label(spark, sf):
    return sale_comps(spark, sf).select("pos", text.source_label(F.col("source")).alias("label"))


@query("q_str10_slug", "SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")
def slug(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", text.slug(F.col("p_type")).alias("slug"))


@query("q_str11_confusable", f"WITH {COMPS_SQL} SELECT pos, pos % 3 = 0 AS only_confusable FROM comps")
def confusable(spark, sf):
    other = F.when(F.col("pos") % 3 == 0, F.lit("B1ock O5")).when(F.col("pos") % 3 == 1, F.lit("Block 05")).otherwise(F.lit("Block X5"))
    return sale_comps(spark, sf).select("pos", text.confusable_only(F.lit("Block 05"), other).alias("only_confusable"))


@query("q_str13_str14_remarks", f"WITH {COMPS_SQL} SELECT pos, sale_type = '' AS placeholder, CASE WHEN sale_type = '' THEN coalesce(address, '') WHEN address IS NULL THEN sale_type ELSE sale_type || '; ' || address END AS remark FROM comps")
def remarks(spark, sf):
    return sale_comps(spark, sf).select("pos", text.is_placeholder(F.col("sale_type")).alias("placeholder"), text.concat_remarks(F.col("sale_type"), F.col("address")).alias("remark"))


@query("q_jsn1_fix_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def fix_json(spark, sf):
    noisy = F.concat(F.lit("```json\n"), F.regexp_replace("props", r"\}$", ", \"none\": None,}"), F.lit("\n```"))
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.get_json_object(text.fix_json(noisy), "$.k").cast("long").alias("k"))


@query("q_jsn3_first_object", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def first_object(spark, sf):
    noisy = F.concat(F.lit("Sure, here it is: "), "props", F.lit(" — done"))
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.get_json_object(text.first_json_object(noisy), "$.k").cast("long").alias("k"))


@query(
    "q_row14_land_schema",
    f"WITH {LAND_SQL} SELECT pos, coalesce(nullif(trim(site_name), ''), '—') AS name, CASE WHEN tenure_yrs >= 999 THEN 'FH' WHEN coalesce(tenure_yrs, 0) = 0 THEN '—' ELSE CAST(CAST(tenure_yrs AS BIGINT) AS VARCHAR) END AS tenure FROM land",
)
def land_schema(spark, sf):
    t = F.col("tenure_yrs")
    shown = F.when(t >= 999, "FH").when(F.coalesce(t, F.lit(0.0)) == 0, "—").otherwise(t.cast("long").cast("string"))
    return land_sales(spark, sf).select("pos", F.coalesce(F.nullif(F.trim("site_name"), F.lit("")), F.lit("—")).alias("name"), shown.alias("tenure"))
