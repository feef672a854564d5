"""Plans and results of the operators that tables of a gigabyte were too large for."""

from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lease_tables_need_no_join(spark):
    from evidentia.operators import briefs as br

    pairs = [f"{y} {({30: 60.0, 60: 80.0, 99: 96.0}).get(y, 50.5)}" for y in range(1, 100)]
    good = " ".join(pairs)
    texts = spark.createDataFrame([(1, good), (2, "30 61.0 " + good), (3, good + " 60 80.5"), (4, " ".join(pairs[:40])), (4, " ".join(pairs[40:])), (5, "no pair"), (6, None)], "report long, text string")
    rows, verdicts = br.lease_tables(texts)
    assert "Join" not in plan(rows) and "Join" not in plan(verdicts)
    assert sorted(map(tuple, verdicts.collect())) == [(1, 99, "ok"), (2, 99, "ok"), (3, 99, "checkpoint"), (4, 99, "ok"), (5, 0, "too few rows"), (6, 0, "too few rows")]
    assert sorted(map(tuple, rows.groupBy("report").agg(F.count("*"), F.max(F.when(F.col("years") == 30, F.col("percent")))).collect())) == [(1, 99, 60.0), (2, 99, 60.0), (4, 99, 60.0)]


def crowd(spark, n=60):
    """Deals of three sources under two names at neighbouring places, with prices that lie close together."""
    rows = [(i, f"s{i * 7 % 3}", ("Alpha Tower One", "Beta Court")[i % 4 == 0], 100 * 1.03 ** (i * 11 % 9) * (1 + (i % 3) * 1e-16), 103.8 + (i % 2) * 1e-5, 1.3) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, "Alpha Tower One", 5.0, 103.8, 1.3)], "pos long, source string, property_name string, price_m double, lon double, lat double"), rows


def test_conflicts_and_merges_form_no_pairs_of_a_crowd(spark):
    from evidentia.operators import evidence as ev

    df, rows = crowd(spark)
    close = lambda a, b: abs(a[3] - b[3]) <= 0.03 * max(a[3], b[3])
    pairs = [(a, b) for a in rows for b in rows if a[1] != b[1] and a[2] == b[2]]
    want = {}
    for a, b in pairs:
        if not close(a, b):
            want[a[0]] = max(want.get(a[0], (-1, "")), (b[0], b[1]))
    found = ev.conflict_flags(df)
    assert {r.pos: (r.conflicts_with, r.conflict_source) for r in found.collect()} == want
    merged = ev.priced_alike(df, 0.1, 0.9, 0.03)
    assert sorted(map(tuple, merged.collect())) == sorted((a[0], b[0]) for a, b in pairs if a[0] < b[0] and close(a, b))
    # records meet links between classes only, and the pairs to be merged meet by price too
    joins = [line for line in plan(found).splitlines() if "Join" in line]
    assert all("pos#" not in line for line in joins) and "step#" in plan(merged)


def test_garbage_names_of_odd_texts(spark, tmp_path):
    import duckdb

    from evidentia.plans import catalog

    texts = [None, "", "éis x", "iſ x", "iſa x", "cut of ", "one of\u0085", "a\x0bb c. d.", "a b c d.", "wasé", "中has中", "x THE", "the", "x of\n", "a b c d.", " . . . ."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = {r.doc_id: r.garbage for r in catalog.queries()["q_str12_flt5_garbage"](spark, str(tmp_path)).collect()}
    assert got == dict(con.execute(catalog.oracle_sql()["q_str12_flt5_garbage"]).fetchall())


def test_same_building_forms_no_pairs_of_a_crowd(spark):
    from evidentia.operators import evidence as ev

    prices = [100 * 0.95 ** (k / 2) for k in range(-6, 7)] + [95.0, 100.0, 100 / 0.95]
    rows = [(i, 103.8 + (i % 2) * 1e-4, 1.3, prices[i * 7 % 16]) for i in range(100)]
    df = spark.createDataFrame([*rows, (200, None, 1.3, 5.0), (201, 103.8, 1.3, None)], "pos long, lon double, lat double, price_m double")
    want = {b[0]: min(a[0] for a in rows if abs(a[3] - b[3]) <= 0.05 * max(a[3], b[3])) for b in rows if b[0] % 3 == 0}
    found = ev.same_building(df, df.where("pos % 3 = 0"))
    assert {r.pos: r.same_as for r in found.collect()} == {p: r for p, r in want.items() if r < p}
    joins = [line for line in plan(found).splitlines() if "Join" in line]
    assert joins and all("price_m#" not in line and "pos#" not in line for line in joins)


def test_land_use_looks_at_a_place_once(spark):
    from evidentia.operators import location

    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    rings = spark.createDataFrame([(2, "b", ring), (1, "a", [(x / 2, y / 2) for x, y in ring])], "ord int, land_use string, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 0.25, 0.25), (2, 0.25, 0.25), (3, 0.75, 0.75), (4, 2.0, 2.0), (5, None, 0.25)], "pos int, lon double, lat double")
    found = location.land_use_at(points, rings)
    assert found.columns == ["pos", "lon", "lat", "land_use"] and {r.pos: r.land_use for r in found.collect()} == {1: "a", 2: "a", 3: "b", 4: "", 5: ""}
    assert not [line for line in plan(found).splitlines() if "Join" in line and "pos#" in line] and "Aggregate [_x#" in plan(found)


def test_connectors_of_a_deal_in_its_row(spark, tmp_path):
    from evidentia.operators import briefs as br
    from evidentia.plans import catalog
    from tests.conftest import SF

    deals = spark.createDataFrame([(1, "R1", "sales", ["b", "a", "b", None, "x"]), (1, "R1", "sales", ["a"]), (2, "R2", "rent", ["a", "b"]), (3, "R1", "sales", None)], "deal long, market string, comp_type string, enabled array<string>")
    known = spark.createDataFrame([("a", "R1", ["sales"]), ("b", "", ["sales", "rent"]), ("b", "", ["sales", "rent"])], "name string, market string, comp_types array<string>")
    assert sorted(map(tuple, br.available_connectors(deals, known).collect())) == [(1, "a", 0), (1, "b", 0), (1, "b", 0), (2, "b", 1), (2, "b", 1)]
    assert "collect_list" not in plan(catalog.queries()["q_src23_connectors"](spark, SF))


def test_lease_sheet_is_one_table(spark):
    from evidentia.operators import sheets

    found = sheets.lease_sheet(spark.createDataFrame([(7,), (8,)], "deal long"))
    assert "Generate" not in plan(found)
    assert found.count() == 2 * 201 and found.where("deal = 7 AND row = 102").first().shown == sheets.LEASE_NOTE


def test_prose_is_worked_out_once(spark):
    from evidentia.operators import context as cx
    from evidentia.operators import retrieval as rt

    lines = ["the weaKened market", "THE END IS", "a 'Is' (b)", "x ſhows thiſ now", "source: it is so", "theism was. not", "one　the\x1ftwo", "  ", "one is", "Area 12,345 sqm is7 big", "areas 1.5 per sqm"]
    text = "\n".join(lines)
    docs = spark.createDataFrame([(1, text), (2, None), (3, "[PAGE 4]" + text + "\n[PAGE 5]x\n[PAGE 6]" + text)], "doc_id long, text string")
    want = "the weaKened market\n\na 'Is' (b) theism was. not one　the\x1ftwo\n\nArea 12,345 sqm is7 big areas 1.5 per sqm"
    out = docs.select("doc_id", rt.prose_lines(F.col("text"), 20).alias("kept")).where("doc_id < 3")
    assert dict(map(tuple, out.collect())) == {1: want, 2: None}
    chunks = cx.page_chunks(docs)
    assert sorted((r.doc_id, r.page) for r in chunks.collect()) == [(1, 1), (3, 4), (3, 6)]
    judged = "(?![^"  # of the pattern of words that make a sentence
    assert plan(out).count(judged) == 1 and plan(chunks).count(judged) == 1


def test_markers_are_sought_in_texts_lowered_once(spark):
    from evidentia.operators import retrieval as rt
    from evidentia.operators import rules

    files = spark.createDataFrame([(1, "Outlook", "FORECAST of the Cap Rate, vendor"), (2, None, None)], "file long, name string, body string")
    scores = files.select("file", rt.marker_scores(F.col("body")).alias("s"))
    assert {r.file: (r.s["sales"].score, r.s["sales"].strong, r.s["land"].score) for r in scores.collect()} == {1: (6, 2, 0), 2: (0, 0, 0)}
    assert plan(scores).count("lower(") == 1
    verdicts = spark.createDataFrame([(2, ["rent"], True)], "file long, types array<string>, is_report boolean")
    found = rules.file_types(files, verdicts)
    assert sorted(tuple(r) for r in found.collect()) == [(1, ["sales"], True, "low", "keywords"), (2, ["rent"], True, "low", "model")]
    above = plan(found).split("Join")[0]
    assert "body#" not in above  # texts do not travel


def test_documents_are_folded_in_a_stream(spark):
    from evidentia.operators import extraction as ex

    rows = [("a", 1, 1, "Harbour Tower East 1", None, None), ("a", 1, 2, "harbour  tower east 1", 5.0, None), ("a", 2, 3, "Harbour Tower East 9", 5.0, 7.0), ("a", 1, 4, "Harbour Tower East 2", 5.0, 8.0), ("a", 2, 5, None, 5.0, 1.0), ("a", 2, 6, "", 5.0, 1.0), ("a", 2, 7, "Court", None, 1.0), ("a", 1, 8, "court", 3.0, None), (None, 1, 1, "Court", 3.0, float("nan")), (None, 1, 2, "COURT", 4.0, 2.0)]
    found = ex.dedup_within_document(spark.createDataFrame(rows, "doc string, table_id long, pos long, name string, price double, area double"))
    want = [("a", 1, 1, "Harbour Tower East 1", 5.0, 8.0), ("a", 2, 5, None, 5.0, 1.0), ("a", 2, 6, "", 5.0, 1.0), ("a", 1, 8, "court", 3.0, None), (None, 1, 1, "Court", 3.0, 2.0)]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    assert "FlatMapGroups" not in plan(found)


def test_header_folds_need_no_sorted_rows(spark):
    from evidentia.operators import grids

    grid = spark.createDataFrame([(1, 0, ["Price", "Unit"]), (1, 1, ["(m)", ""]), (1, 2, ["5", "(SGD)"]), (1, 3, ["(x)", ""]), (2, 0, ["no head"])], "table_id long, row int, cells array<string>")
    found = grids.fold_headers(grid, spark.createDataFrame([(1, 0)], "table_id long, header int"))
    assert sorted(map(tuple, found.collect())) == [(1, 0, ["Price (m)", "Unit"], 1), (1, 2, ["5", "(SGD)"], 0), (1, 3, ["(x)", ""], 0)]
    assert plan(found).count("shuffle_hash") >= 3
