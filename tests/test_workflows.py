"""Operators of workbooks, parcels, edits, contexts, retrieval and briefs against plain Python on small tables."""

import math
import random

from pyspark.sql import functions as F

from evidentia.functions import dates, num
from evidentia.operators import acquisition as aq
from evidentia.operators import briefs as br
from evidentia.operators import context as cx
from evidentia.operators import edits as ed
from evidentia.operators import grids, lineage, location, overlay, parcels, sheets
from evidentia.operators import retrieval as rt


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_metres_however_spelled(spark):
    area = ["Area (sq mtr)", "GFA sqmt", "NLA (sq mts)", "GFA (sq. m)", "Area sqm", "Area m²", "size (m2)", "Area (sq mi)", "GFA (sq ft)", "Area (sqft)", "NLA sf", "Area sq mft"]
    got = column(spark, area, lambda h: num.unit_multiplier(h, F.lit("nla_sf")))
    assert [x != 1.0 for x in got] == [True] * 7 + [False] * 5
    rent = column(spark, ["Rent per sq mtr", "Rent psm", "Rent per sqm", "Rent psf", "Rent sq m"], lambda h: num.unit_multiplier(h, F.lit("asking_rent")))
    assert [x != 1.0 for x in rent] == [True, True, True, False, False]


def test_dates_by_tokens(spark):
    cells = ["Q1 2024", "q32025", "Q5 2024", "Sept. 2023", "Mar-2024", "2024-11-03", "03/2024", "25/12/2023", "sold in 2019", "12024", "ab 2020", "Q1", "", None, "None", "99/2024", "Mayfair 2021"]
    want = ["Q1 2024", "Q3 2025", "2024", "Q3 2023", "Q1 2024", "Q4 2024", "Q1 2024", "Q4 2023", "2019", "1202", "2020", "Q1", "", "", "", "2024", "Q2 2021"]
    assert column(spark, cells, dates.parse_sale_date) == want
    ago = ["Q2 2025", "sold q4, in 2024", "Jun-26", "Jan 2030", "June 26", "2024", "x", "", None, "Feb/2026", "12 Mar 2025", "sept 1 2025", "q12025"]
    assert column(spark, ago, lambda c: dates.months_ago(c, 2026, 6)) == [13, 19, 0, 0, None, 24, None, None, None, 4, 15, 12, 16]


def test_prose_at_all_line_ends(spark):
    page = "\tRents are\r\nVacancy was lower\tthan before, and the market   stayed calm all year.\r\n\r\nThe next part is here and it has enough words\x0bto be long. The end was near."
    got = column(spark, [page], rt.prose_lines)[0]
    assert got == "Vacancy was lower\tthan before, and the market   stayed calm all year.\n\nThe next part is here and it has enough words The end was near."


def test_claims_of_any_length_against_all_texts(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "äöü", "x", "日本"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))) for i in range(60)] + [(60, None), (61, ""), (62, "alphabet soup")]
    claims = [(i, t) for i, t in enumerate(["alpha", "pha be", "a", "ö", "x x", "日", "alpha beta", "beta gamma delta", "gamma delta äöü x alpha", "", None, " ", "zzz", "alphabet"])]
    claims += [(100 + k, " ".join((docs[k][1] or "").split()[:9])) for k in range(60)]
    got = rt.contained_claims(spark.createDataFrame(claims, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = {(c, d) for c, t in claims if t for d, body in docs if body is not None and t in body}
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want


def test_nearest_parcel_on_the_whole_globe(spark):
    rng = random.Random(2)
    spot = lambda: (rng.uniform(-180, 180), math.degrees(math.asin(rng.uniform(-1, 1))))
    places = [spot() for _ in range(60)] + [(180.0, 0.1), (-180.0, 0.0), (0.0, 90.0), (103.8, 1.3)]
    held = [spot() for _ in range(25)] + [(103.8 + rng.random() / 100, 1.3 + rng.random() / 100) for _ in range(200)] + [(179.9, 0.0)]

    def km(a, b):
        (x, p), (y, q) = (tuple(map(math.radians, t)) for t in (a, b))
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin((y - x) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(h))

    of = lambda rows: spark.createDataFrame(rows, "lon double, lat double")
    got = {(r.lon, r.lat): r.km for r in location.nearest(of(places), of(held)).collect()}
    assert len(got) == len(places) and all(abs(got[p] - min(km(p, h) for h in held)) < 1e-6 for p in places)
    assert {r.km for r in location.nearest(of(places), of([])).collect()} == {99.0}


def test_folded_headers_by_hand(spark):
    rows = [(1, 0, ["Name", "Price", None]), (1, 1, ["", "(S$)", "(psf)"]), (1, 2, ["", "m)", "(nla"]), (1, 3, ["A", "1", "2"]), (1, 4, ["", "(S$)", ""]), (2, 5, ["Name", "Price"]), (2, 6, ["", ""]), (2, 7, ["(x)", ""]), (3, 0, ["Only"])]
    heads = spark.createDataFrame([(1, 0), (2, 5), (3, 0)], "table_id int, header int")
    got = grids.fold_headers(spark.createDataFrame(rows, "table_id int, row int, cells array<string>"), heads).orderBy("table_id", "row").collect()
    assert [tuple(r) for r in got] == [
        (1, 0, ["Name", "Price (S$) m)", "(psf) (nla"], 2), (1, 3, ["A", "1", "2"], 0), (1, 4, ["", "(S$)", ""], 0), (2, 5, ["Name", "Price"], 0), (2, 6, ["", ""], 0), (2, 7, ["(x)", ""], 0), (3, 0, ["Only"], 0),
    ]


def test_contexts_against_a_running_sum(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), i, f"n{i}", rng.choice([None, "", "x" * rng.randrange(40)])) for i in range(200)]
    got = {(r.g, r.i): (r.state, r.part) for r in cx.stuffed(spark.createDataFrame(rows, "g string, i long, name string, text string"), "g", "i", "name", 300, stretch=16).collect()}
    used = {"a": 0, "b": 0}
    for g, i, name, text in rows:
        text = text or ""
        room = max(0, 300 - used[g])
        state = "omitted" if used[g] >= 300 else "cut" if len(text) > room else "whole"
        assert got[g, i] == (state, f"\n[FILE: {name}]\n" + (cx.OMITTED if state == "omitted" else text[:room]))
        used[g] += len(text)
    assert len(got) == 200


def test_pages_and_their_parts(spark):
    body = "The cover is short but it has a verb and enough words to be kept as a page of its own, it seems.\n[PAGE 2]\nno\n[PAGE 7]\n" + "The market was calm and the rents were stable. " * 4
    got = sorted(map(tuple, cx.page_chunks(spark.createDataFrame([(1, body), (2, None), (3, "")], "doc_id long, text string"), 100, 90).select("doc_id", "page", "part", F.length("text")).collect()))
    assert got == [(1, 1, 0, 96), (1, 7, 0, 100), (1, 7, 1, 97)]


def test_edits_by_hand(spark):
    records = spark.createDataFrame([("d", "1", "A", "x", 1.0, 1.0, 5.0), ("d", "2", "B", None, 2.0, 2.0, None), ("d", "3", "C", "z", 3.0, 3.0, 7.0), ("e", "1", "E", "", None, None, 9.0)], "deal string, marker string, property_name string, address string, lon double, lat double, price double")
    table = [("d", 1, "1", "A", "x", "6.5"), ("d", 2, "1", "", "x", "7,000.5"), ("d", 3, "2", "B2", "", "—"), ("d", 4, "★", "New", "", "3"), ("d", 5, "9", "Odd", "q", "4"), ("d", 6, "", "", "", "8"), ("d", 7, "", "Free", "", "0"), ("e", 1, "1", "nan", "", "9")]
    got = ed.merge_edits(records, spark.createDataFrame(table, "deal string, line int, marker string, property_name string, address string, price string"), {"price": "number"}, "price")
    assert sorted(map(tuple, got.select("deal", F.coalesce("marker", F.lit("")), "property_name", "address", "price", "lon", "change").collect())) == [
        ("d", "", "New", "", 3.0, None, "added"), ("d", "", "Odd", "q", 4.0, None, "added"), ("d", "1", "A", "x", 7000.5, 1.0, "updated"), ("d", "2", "B2", "", None, None, "updated"), ("d", "3", "C", "z", 7.0, 3.0, "removed"), ("e", "1", "E", "", 9.0, None, "kept"),
    ]


def test_log_is_replayed_in_order(spark):
    rng = random.Random(6)
    kinds = ["delete", "restore", "hide", "show", "recolour"]
    log = [("d", m, s, rng.choice(kinds), str(s % 5)) for m in range(12) for s in rng.sample(range(100), rng.randrange(1, 9))]
    state = {}
    for _, m, _, kind, value in sorted(log, key=lambda x: (x[1], x[2])):
        d, h, c = state.get(m, (False, False, None))
        state[m] = (kind == "delete" if kind in ("delete", "restore") else d, kind == "hide" if kind in ("hide", "show") else h, value if kind == "recolour" else c)
    rng.shuffle(log)
    got = {r.marker: (r.deleted, r.hidden, r.colour) for r in ed.replayed(spark.createDataFrame(log, "deal string, marker int, seq int, kind string, value string")).collect()}
    assert got == state


def test_fields_live_by_their_page(spark):
    rows = [(1, 1, {"property_name": "Orchid  PLAZA", "price": "1,133.00", "gfa": "55"}), (2, 1, {"property_name": "Nowhere", "price": "1133.00"}), (3, 2, {"property_name": "x", "price": "1"}), (4, 1, {"property_name": "plaza", "price": ""})]
    pages = spark.createDataFrame([(1, "the Orchid\nPlaza sold at 1133.00 or 2,250"), (2, None)], "page int, text string")
    got = lineage.bind_to_pages(spark.createDataFrame(rows, "row int, page int, fields map<string,string>"), pages, ["price", "gfa"]).collect()
    assert [(r.row, r.fields, r.dropped) for r in got] == [(1, {"property_name": "Orchid  PLAZA", "price": "1,133.00"}, 1)]


def test_rules_are_laid_over_each_other(spark):
    deals = spark.createDataFrame([("rent", " Logistics ", {"max_results": 9.0, "own": 1.0, "city_km": None}), ("sales", None, None), ("other", "office", {"years_back_max": 7.5})], "comp_type string, asset_class string, block map<string,double>")
    a, b, c = overlay.effective_rules(deals).collect()
    assert a.rules["proximity_km"] == 5.0 and a.rules["max_results"] == 9.0 and a.rules["own"] == 1.0 and a.rules["city_km"] is None and a.set_by["city_km"] == "deal" and a.set_by["proximity_km"] == "asset class"
    assert a.warning == "years_back_max 5 reaches past the 3 years that are kept" and b.warning is None and b.rules["recency_months"] == 60.0 and c.warning.startswith("years_back_max 7.5 ")


def test_parcels_of_odd_features(spark):
    ring = [[103.8, 1.3], [103.81, 1.3], [103.81, 1.31], [103.8, 1.31], [103.8, 1.3]]
    feature = lambda kind, c, use: f'{{"properties":{{"LU_DESC":"{use}"}},"geometry":{{"type":"{kind}","coordinates":{c}}}}}'
    rows = [feature("Polygon", [ring], "Commercial & Residential"), feature("MultiPolygon", [[ring], [ring]], "hotel"), feature("Polygon", [[]], "Hotel"), feature("Point", [1, 2], "Hotel"), "{", None, feature("Polygon", [[[90.0, 1.3], [90.1, 1.3], [90.1, 1.4]]], "Port / Airport")]
    df = spark.createDataFrame(list(enumerate(rows)), "feature int, geojson string")
    got = {(r.parcel, r.bucket): r for r in parcels.bucket_parcels(df).collect()}
    assert set(got) == {(0, "residential"), (0, "commercial"), (1, "hotel")}
    one = 0.01 * 0.01 * 110.574 * 111.32 * math.cos(math.radians(got[0, "commercial"].lat))
    assert abs(got[0, "commercial"].area_km2 - one) < 1e-6 and abs(got[1, "hotel"].area_km2 - 2 * one) < 1e-6
    assert [(r.feature, r.part) for r in parcels.ring_index(df).orderBy("ord").collect()] == [(0, 0), (1, 0), (1, 1), (6, 0)]


def test_workbook_of_one_deal(spark):
    schema = "deal int, pos int, property_name string, sale_date string, gfa_sf double, remaining_yrs double, price_m double, price_psf double, npi_yield double, reported_adj double"
    records = spark.createDataFrame([(1, 5, "A", "2024", 10.0, 60.0, 1.0, 100.0, 0.04, None), (1, 9, "", None, None, None, None, None, None, None), (1, 7, "B", "x", 1.0, 30.0, 2.0, 300.0, 0.05, 0.0123)], schema)
    cells = {(r.sheet, r.row, r.col): r for r in sheets.workbook(records, spark.createDataFrame([(1, 99.0)], "deal int, lease_yrs double"), sheets.SALES).collect()}
    adj = cells["Sales Comps", 2, 9]
    assert abs(adj.number - 0.04 * 0.8 / 0.96) < 1e-12 and adj.formula.startswith("=IFERROR(H2*IF(ISNUMBER(E2)") and "Params!$B$2" in adj.formula
    assert cells["Sales Comps", 3, 9].number == 0.0123 and cells["Sales Comps", 3, 9].formula is None and cells["Sales Comps", 4, 9].shown == "—" and cells["Sales Comps", 4, 2].shown == "—"
    assert cells["Sales Comps", 5, 7].number == 200.0 and cells["Sales Comps", 5, 7].formula == '=IFERROR(AVERAGEIF(G2:G4,">0"),"—")' and cells["Params", 2, 2].number == 99.0 and cells["Lease Table", 61, 2].number == 0.8
    assert sheets.letter(26) == "Z" and sheets.letter(27) == "AA" and sheets.letter(703) == "AAA"


def test_clauses_names_and_tables_by_hand(spark):
    raw = "## Head\nNear the station ([a.com](https://a.com/x)) and [a park](https://p)  too ([b](  )) ([c.com](https://c.com)) end ([d](https://d))"
    got = column(spark, [raw, None, ""], aq.cited_clauses)
    assert [tuple(x) for x in got[0]] == [("Head\nNear the station", "https://a.com/x"), ("and a park too", "  "), ("end", "https://d")] and not got[1] and got[2] == []
    names = ["Office", "Mixed/Others", "The sale of land.", "Acme Pte Ltd.", "it was a good year here", "one two", "data centres and", "A\nB\nC\nD", "Plain Tower Name"]
    assert column(spark, names, lambda n: br.not_a_name(n, F.lit("1"))) == ["category", "category", "prose", None, "prose", None, "prose", "lines", None]
    assert column(spark, ["Plain"], lambda n: br.not_a_name(n, F.lit("a b c d"))) == ["price"]
    items = spark.createDataFrame([(1, "Big Tower One", "10"), (2, "Other", "0"), (3, "big  tower", "5"), (4, None, "5")], "item int, building_name string, nla_sf string")
    for c in ("address", "district", "quality", "tenant", "lease_type", "asking_rent", "eff_rent", "lease_term_yrs", "rent_free_mths", "lease_date"):
        items = items.withColumn(c, F.lit(None).cast("string"))
    assert [r.item for r in aq.reshaped_leases(items, "Big Tower One").collect()] == [3]
    assert [r.item for r in aq.reshaped_leases(items).orderBy("item").collect()] == [1, 3]
