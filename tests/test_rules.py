"""Rule operators against plain Python on small tables."""

import random
import re

import pytest

from evidentia.operators import evidence as ev
from evidentia.operators import extraction as ex
from evidentia.operators import retrieval as rt
from evidentia.operators import rules

FIELDS = {"property_name": ("property", "building"), "sale_date": ("sale date",), "sale_type": ("sale type",), "land_zoning": ("zoning",), "price_sgd_m": ("deal price",), "price_psf_gfa": ("unit price",), "gfa_sf": ("gfa",)}


def tiers_by_hand(headers, cells, similar):
    """The tiers as nested loops, for one table."""
    key = [re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", (h or "").lower())).strip() for h in headers]
    mapped, claimed = {}, set()

    def assign(field, i, method):
        mapped[field] = (i, method)
        claimed.add(i)

    for i, k in enumerate(key):
        if k and any(t in k for t in rules.SUBMARKETS):
            claimed.add(i)
    for i, k in enumerate(key):
        vals = [c.strip().lower() for c in cells[i] if c]
        if i in claimed or k != "type" or not vals:
            continue
        uses, kinds = (sum(any(w in v for w in words) for v in vals) for words in (rules.USES, rules.SALE_KINDS))
        half = max(1, (len(vals) + 1) // 2)
        field = "land_zoning" if uses >= half and uses >= kinds else "sale_type" if kinds >= half else None
        if field and field not in mapped:
            assign(field, i, "value")
    for field, names in FIELDS.items():
        for i, k in enumerate(key):
            if i not in claimed and k in names and field not in mapped:
                assign(field, i, "exact")
                break
    for i, k in enumerate(key):
        if i not in claimed and re.search(r"\b(price|consideration)\b", k):
            field = "price_psf_gfa" if re.search(r"\b(psf|psm|ppr|per|unit|sqft|sqm)\b", k) else "price_sgd_m"
            if field not in mapped:
                assign(field, i, "price")
    for i, k in enumerate(key):
        best, which = 0.0, None
        for field in FIELDS:
            if field not in mapped and similar[i, field] > best:
                best, which = similar[i, field], field
        if i not in claimed and k and which and best >= 0.30:
            assign(which, i, "similar")
    return {(f, *v) for f, v in mapped.items()}


def test_column_tiers(spark):
    rng = random.Random(3)
    names = ["Property", "Building", "Type", "Sub-Market", "Price (S$M)", "Price / unit", "Unit Price", "Consideration", "GFA", "Zoning", "Sale Date", "Notes", "", None, "Sale type"]
    values = ["Office", "Strata", "En bloc", "Retail", "", None, "other"]
    heads, samples, similar, want = [], [], [], {}
    for t in range(40):
        headers = [rng.choice(names) for _ in range(7)]
        cells = [[rng.choice(values) for _ in range(5)] for _ in headers]
        near = {(i, f): round(rng.random() * 0.6, 4) for i in range(7) for f in FIELDS}
        heads += [(t, i, h) for i, h in enumerate(headers)]
        samples += [(t, i, c) for i, col in enumerate(cells) for c in col]
        similar += [(t, i, f, s) for (i, f), s in near.items()]
        want[t] = tiers_by_hand(headers, cells, near)
    table = lambda rows, schema: spark.createDataFrame(rows, f"table_id int, column int, {schema}")
    got = {t: set() for t in want}
    for r in rules.map_tiers(table(heads, "header string"), table(samples, "cell string"), FIELDS, table(similar, "field string, score double")).collect():
        got[r.table_id].add((r.field, r.column, r.method))
    assert got == want


def test_best_span(spark):
    claims = [(1, "g", "rents rose sharply in Orchard"), (2, "g", "nothing like it"), (3, "h", "vacancy fell slightly")]
    spans = [("g", 1, "u1", "Rents rose in town. Rents rose sharply in Orchard road"), ("g", 2, "", "Rents rose sharply in Orchard too."), ("h", 1, "", "Vacancy fell. It fell."), ("z", 1, "u", "rents rose sharply in Orchard")]
    got = rules.best_span(spark.createDataFrame(claims, "claim_id int, k string, claim string"), spark.createDataFrame(spans, "k string, ord int, url string, text string"), "k").collect()
    assert {(r.claim_id, r.sentence, r.url, round(r.overlap, 3)) for r in got} == {(1, "Rents rose sharply in Orchard road", "u1", 1.0), (3, "Vacancy fell.", "Web search", 0.667)}


def test_read_back_of_a_written_table(spark):
    rows = [["t", "", ""], ["Property", "Marker", "Source"], ["", "", ""], ["S", "★", "x"], ["Property", "Marker", "Source"], ["A", "1", "y"], ["", "", ""], ["B", "2", None], ["Average", "", ""], ["C", "3", "z"]]
    got = rules.read_back(spark.createDataFrame([(1, i, c) for i, c in enumerate(rows)], "table_id int, row int, cells array<string>")).orderBy("row").collect()
    assert [(r.role, r.cells) for r in got] == [("subject", ["S", "★"]), ("comp", ["A", "1"]), ("comp", ["B", "2"]), ("average", ["Average", ""]), ("comp", ["C", "3"])]


def test_places_of_records(spark):
    rows = [(1, "N", "A", 1.0, 2.0), (2, "N", "A", None, None), (3, "N", None, None, None), (4, "Z", "", None, None), (5, None, None, None, None), (6, "N", "B\nC", None, 2.0)]
    found = [("A", "two", 3.0, 4.0), ("A", "one", 5.0, 6.0), ("N", "two", 103.8, 1.35), ("B C", "three", 9.0, 9.0)]
    got = rules.attach_places(spark.createDataFrame(rows, "pos int, property_name string, address string, lon double, lat double"), spark.createDataFrame(found, "query string, provider string, lon double, lat double"), ["one", "two"], 0.0, 0.0, (103.8, 1.35)).orderBy("pos").collect()
    assert [(r.lon, r.provider, r.by_name, r.suspect, r.distance_km == 9999.0) for r in got] == [(1.0, "cached", False, False, False), (5.0, "one", False, False, False), (103.8, "two", True, True, False), (None, "failed", False, False, True), (None, "failed", False, False, True), (None, "failed", False, False, True)]


def test_names_alike_against_all_pairs(spark):
    rng = random.Random(4)
    words = "harbour tower orchid plaza marina park cedar hub".split()
    rows = [(i, rng.choice("ab"), " ".join(rng.choice(words) for _ in range(rng.randrange(0, 6))), rng.choice([None, 0.0, 10.0, 10.2, 11.0]), 103.8 + rng.randrange(3) * 0.0005, 1.3) for i in range(150)]
    df = spark.createDataFrame(rows, "pos long, source string, property_name string, price_m double, lon double, lat double")
    for least in (0.5, 0.9):
        got = [tuple(r) for r in ev.named_alike(df, 0.1, least).selectExpr("a.pos", "b.pos").collect()]
        want = set()
        for i, s, n, p, x, _ in rows:
            for j, t, m, q, y, _ in rows:
                a, b = set(n.split()), set(m.split())
                if i < j and s != t and (p or 0) > 0 and (q or 0) > 0 and a and b and len(a & b) / len(a | b) >= least and abs(x - y) * 111.32 < 0.1:
                    want.add((i, j))
        assert len(got) == len(set(got)) and set(got) == want


def test_similar_vectors_against_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(200)] + [(200, None), (201, [0.0] * 6), (202, [1.0, 2.0])]
    rows += [(300 + i, rows[7][1]) for i in range(5)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    claims = v.where("vec_id % 20 = 0 OR vec_id = 302").withColumnRenamed("vec_id", "claim_id")
    got = {r.claim_id: (r.vec_id, r.score) for r in rt.best_by_similarity(claims, v, 0.2, 3).collect()}
    for q, a in rows:
        if (q % 20 == 0 or q == 302) and a:
            best = [(-round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9), i) for i, b in rows if b and i != q and len(b) == len(a) and any(b)]
            if -min(best)[0] >= 0.2:
                assert got[q][0] == min(best)[1] and got[q][1] == pytest.approx(-min(best)[0], abs=1e-8)
            else:
                assert q not in got


def test_dedup_within_a_document(spark):
    rng = random.Random(8)
    base = ["Harbour Tower East Wing", "Harbour Tower East", "Orchid Plaza", "Orchid Plaza Annex Building", "Marina"]
    rows = [(d, rng.randrange(3), i, rng.choice(base), rng.choice([None, 10.0, 20.0]), rng.choice([None, 5.0])) for d in range(6) for i in range(12)]
    df = spark.createDataFrame(rows, "doc int, table_id int, pos int, name string, price double, area double")
    kept = ex.dedup_within_document(df)
    assert set(kept.columns) >= {"doc", "pos"} and kept.count() <= len(rows)
    again = ex.dedup_within_document(kept.select(*df.columns))  # what is kept has no duplicates left
    assert {tuple(r) for r in again.select("doc", "pos").collect()} <= {tuple(r) for r in kept.select("doc", "pos").collect()}


def fold_by_hand(rows):
    """Records of one document in order of pos: what each one does to those kept before it."""
    key = lambda r: "".join((r["name"] or "").lower().split())
    kept = []
    for r in sorted((dict(x) for x in rows), key=lambda r: r["pos"]):
        def same(k, r=r):
            a, b = key(k), key(r)
            return b != "" and (a == b or (len(a) >= 8 and len(b) >= 8 and a[:15] == b[:15] and r["price"] is not None and k["price"] == r["price"]))

        at = next((i for i, k in enumerate(kept) if same(k)), None)
        if at is None:
            kept.append(r)
        elif kept[at]["table_id"] == r["table_id"]:
            kept[at] |= {f: r[f] for f in ("price", "area") if kept[at][f] is None}
        elif kept[at]["price"] is None and r["price"] is not None:
            kept[at] = r
    return kept


def test_duplicates_in_a_document_are_folded_in_order(spark):
    rng = random.Random(8)
    names = ["Harbour Tower One", "harbour  tower one", "Harbour Tower Onward", "Harbour Tower Online", "Short", "short ", "", None, "Orchid Plaza West", "Orchid Plaza Wes t"]
    rows = [{"doc": str(i // 40), "table_id": rng.randrange(3), "pos": i, "name": rng.choice(names), "price": rng.choice([None, 1.0, 2.0]), "area": rng.choice([None, 5.0, 6.0])} for i in rng.sample(range(400), 400)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "doc string, table_id int, pos long, name string, price double, area double")
    clean = lambda v: None if isinstance(v, float) and v != v else v
    got = sorted((tuple(map(clean, r)) for r in ex.dedup_within_document(df).collect()), key=lambda r: r[2])
    want = sorted((tuple(k.values()) for d in {r["doc"] for r in rows} for k in fold_by_hand([r for r in rows if r["doc"] == d])), key=lambda r: r[2])
    assert got == want
