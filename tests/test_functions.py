"""Parsers on hand-made cells: expected values follow from the rules of each parser."""

import pytest
from pyspark.sql import functions as F

from evidentia.functions import dates, geo, lease, num, text


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_parse_num(spark):
    cells = ["1,133.00", "4.5%", "0.045", "600-630*", "-5", "S$1.2.3", "", None]
    assert column(spark, cells, num.parse_num) == [1133.0, 4.5, 0.045, 615.0, 5.0, None, None, None]
    rates = column(spark, cells, num.parse_cap_rate)
    assert rates[:4] == pytest.approx([11.33, 0.045, 0.045, 6.15])
    assert column(spark, cells, num.signed_num) == [1133.0, 4.5, 0.045, None, -5.0, None, None, None]


def test_stake(spark):
    got = column(spark, ["Whole building", "49% stake", "x (1/4 stake)", "", "120%"], lambda c: num.stake_fraction(c, F.lit("")))
    assert got == pytest.approx([1.0, 0.49, 0.25, 1.0, 1.0])


def test_units(spark):
    headers = [("GFA (sqm)", "gfa_sf"), ("Area (sq mi)", "gfa_sf"), ("Price S$'000", "price_sgd_m"), ("Price (S$ bn)", "price_sgd_m"), ("Rent psm", "eff_rent"), ("Name", "other")]
    df = spark.createDataFrame(headers, "h string, f string")
    assert [r[0] for r in df.select(num.unit_multiplier(F.col("h"), F.col("f"))).collect()] == [10.7639, 1.0, 0.001, 1000.0, 10.7639, 1.0]


def test_sale_date(spark):
    cells = ["q1 2024", "March 2024", "2025-08-14", "soon", "", None, "2023", "14/08/2025"]
    assert column(spark, cells, dates.parse_sale_date) == ["Q1 2024", "Q1 2024", "Q3 2025", "soon", "", "", "2023", "Q3 2025"]
    assert column(spark, ["Jan"], lambda c: dates.parse_sale_date(c, F.lit("2025"))) == ["Q1 2025"]


def test_months_ago(spark):
    assert column(spark, ["Q2 2025", "2024", "soon", "Jun-26", "Jan 2030"], lambda c: dates.months_ago(c, 2026, 6)) == [13, 24, None, 0, 0]


def test_spellings_of_periods(spark):
    titles = ["q3'25", "Q1-2024", "4Q_23 review", "2024 Q2", "H1 2025", "1H24", "2023-H2", "Sept 2024", "Jan-23", "as of 2018", "q52024", "8Q24", "faq 1 24", "Mayor 5", None, "2H 2024, Q1 2023"]
    assert column(spark, titles, lambda c: dates.period_of(c, True)) == ["Q3 2025", "Q1 2024", "Q4 2023", "Q2 2024", "Q2 2025", "Q2 2024", "Q4 2023", "Sep 2024", "Jan 2023", "2018", "", "", "", "", "", "Q1 2023"]


def test_periods(spark):
    assert column(spark, ["Report 1H 2024", "office 2Q25", "Outlook Mar'24", "2019 review", "none"], lambda c: dates.report_period(c, F.lit(None).cast("string"))) == ["Q2 2024", "Q2 2025", "Mar 2024", "2019", ""]


def test_remaining_years(spark):
    assert column(spark, ["99 years from 2004", "Freehold", "77", "x"], lambda c: dates.remaining_years(c, 2026)) == [77.0, 999.0, 77.0, None]


def test_lease_factor(spark):
    df = spark.createDataFrame([(0.0,), (999.0,), (549.0,), (60.0,), (None,)], "y double")
    assert [r[0] for r in lease.with_factor(df, "y", "f").select("f").collect()] == pytest.approx([1, 1, 0.98, 0.8, 1])


def test_number_support(spark):
    page = F.lit("sold for 1,377.8 (S$ m), up 4%")
    claims = ["1.38", "4%", "5%", "9000"]
    assert column(spark, claims, lambda c: text.number_supported(c, page)) == [True, True, False, False]


def test_anchor(spark):
    assert column(spark, ["3% of 1,377,000 and 12.5", "50%", "no"], lambda c: text.anchor_number(text.claim_numbers(c))) == ["12.5", "50%", None]


def test_jaccard_symmetric(spark):
    df = spark.createDataFrame([("One Raffles Place", "raffles place one tower"), ("", "x"), (None, "x")], "a string, b string")
    for ab, ba in df.select(text.name_overlap(F.col("a"), F.col("b")), text.name_overlap(F.col("b"), F.col("a"))).collect():
        assert ab == ba and 0 <= ab <= 1


def test_geometry(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (2, 0), (2, 2), (0, 2))])
    row = spark.range(1).select(geo.in_ring(F.lit(1.0), F.lit(1.0), ring), geo.in_ring(F.lit(3.0), F.lit(1.0), ring), geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).first()
    assert row[0] and not row[1] and row[2] == pytest.approx(111.19, abs=0.01)


def test_json_repair(spark):
    got = column(spark, ['```json\n{"a": None, "b": [1, 2,],}\n```'], lambda c: F.get_json_object(text.fix_json(c), "$.b[1]"))
    assert got == ["2"]
