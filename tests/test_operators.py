"""Ordered and iterative operators against plain Python."""

import random

from pyspark.sql import functions as F

from evidentia.operators import evidence as ev
from evidentia.operators import grids, location, refine, report, retrieval


def leaders_by_hand(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    leader = {}
    for n in sorted(near):
        if n in leader:
            continue
        for m in near[n]:
            if m > n:
                leader.setdefault(m, n)
        leader[n] = n
    return leader


def test_leader_groups(spark):
    rng = random.Random(3)
    edges = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(70)})
    got = {r.pos: r.leader for r in ev.leader_groups(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = leaders_by_hand(edges)
    groups = {n for n, l in want.items() if l != n} | set(want.values())
    assert got == {n: l for n, l in want.items() if n in groups and (n != l or any(m != n and k == n for m, k in want.items()))}


def test_chain_is_not_a_component(spark):
    got = {r.pos: r.leader for r in ev.leader_groups(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")).collect()}
    assert got == {1: 1, 2: 1}


def test_merge_fills_blanks(spark):
    rows = [
        (1, "pdf_1", "Alpha Tower", None, 100.0, 103.8, 1.3, None), (2, "pdf_2", "Alpha Tower", "1 Main", 101.0, 103.8, 1.3, 5.0),
        (3, "pdf_1", "Beta Tower", None, 50.0, 103.9, 1.3, None), (4, "pdf_1", "Alpha Tower", None, 100.0, 103.8, 1.3, None),
    ]
    df = spark.createDataFrame(rows, "pos long, source string, property_name string, address string, price_m double, lon double, lat double, gfa_sf double")
    got = {r.leader: r for r in ev.merge_cross_source(df, ["property_name", "address", "price_m", "gfa_sf"]).collect()}
    assert set(got) == {1, 3, 4} and got[1].n_merged == 2
    assert got[1].source == "pdf_1+pdf_2" and got[1].address == "1 Main" and got[1].price_m == 101.0


def test_top_n_puts_missing_first(spark):
    df = spark.createDataFrame([(1, "5"), (2, None), (3, "Q1 2024"), (4, "text"), (5, "70")], "pos long, v string")
    assert [r.pos for r in refine.keep_top_n(df, "v", 5).collect()] == [2, 4, 3, 5, 1]
    assert [r.pos for r in refine.filter_range(df, "v", 10, None).orderBy("pos").collect()] == [2, 3, 4, 5]


def test_stats(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "a", 3.0), (4, "a", 4.0)], "pos long, g string, v double")
    r = refine.compute_stats(df, "v", ["g"]).first()
    assert (r["count"], r.mean, r.std, r.p25, r.median, r.p75) == (4, 2.5, 1.118, 2.0, 3.0, 4.0)


def test_split_tables(spark):
    head = ["Property", "Sale date", "Price", ""]
    rows = [(0, 1, head), (0, 2, ["A", "2024", "5", ""]), (0, 3, ["", "", "", ""]), (0, 4, head), (0, 5, ["B", "2023", "7", "x"])]
    got = grids.split_tables(spark.createDataFrame(rows, "table_id long, row long, cells array<string>"), ["property", "price", "sale"])
    assert [(r.row, r.block) for r in got.orderBy("row").collect()] == [(1, 1), (2, 1), (4, 2), (5, 2)]


def test_filters_are_monotone(spark):
    df = spark.createDataFrame([(i, str(i % 7), float(i)) for i in range(50)], "pos long, c string, v double")
    kept = report.ladder(df.withColumn("tier", (F.col("pos") % 3).cast("int")), 5, "c")
    assert kept.count() <= 50 and kept.join(df, "pos", "left_anti").count() == 0


def test_short_claims_are_found(spark):
    docs = [(1, "xone two three four five six seven eight nine"), (2, "one  two three"), (3, "net 3.5% of it"), (4, None), (5, "a b c d e f g h i j k")]
    claims = [(1, "two three four"), (2, "one two"), (3, "3.5%"), (4, "ne two three four five six seven eight ni"), (5, "d e f g h"), (6, "z"), (7, None), (8, "e  f g"), (9, " d "), (10, "one two three four five six seven eight")]
    want = sorted((i, d) for i, c in claims for d, t in docs if c is not None and t is not None and c in t)
    frames = spark.createDataFrame(claims, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, retrieval.contained_claims(*frames).collect())) == want


def test_places_near_the_poles_and_the_date_line(spark):
    import math

    def km(a, b):
        (x, p), (y, q) = (map(math.radians, v) for v in (a, b))
        return 2 * 6371.0 * math.asin(min(1, math.sqrt(math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin((y - x) / 2) ** 2)))

    at = [(25.0, 78.0), (25.03, 78.0), (25.05, 78.001), (179.999, 10.0), (-179.999, 10.0), (-180.0, 10.003), (103.8, 1.3), (103.803, 1.3), (0.0, 89.999), (180.0, 89.999), (90.0, -90.0)]
    places = spark.createDataFrame([(i, *p, 5.0) for i, p in enumerate(at)], "pos long, lon double, lat double, price_m double")
    want = {(i, j) for i in range(len(at)) for j in range(i + 1, len(at)) if km(at[i], at[j]) <= 1}
    got = {tuple(r) for r in ev.near_pairs(places, 1.0).select("a.pos", "b.pos").collect()}
    assert got == want
    first = {}
    for i, j in sorted(want):
        first.setdefault(j, i)
    assert {r.pos: r.same_as for r in ev.same_building(places, places, 1.0).collect()} == first
    parcels = spark.createDataFrame([(1, "park", 25.5, 78.0, 1.0), (2, "park", 25.0, 77.88, 1.0), (3, "park", -179.99, 10.0, 1.0)], "parcel long, bucket string, lon double, lat double, area_km2 double")
    spots = [(25.0, 78.0), (179.99, 10.0)]
    got = {(r.lon, r.lat): r.km for r in location.nearest(spark.createDataFrame(spots, "lon double, lat double"), parcels).collect()}
    for p in spots:
        assert abs(got[p] - min(km(p, q) for q in ((25.5, 78.0), (25.0, 77.88), (-179.99, 10.0)))) < 1e-6
