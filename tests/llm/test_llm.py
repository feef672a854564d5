"""Operators on awkward rows: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import blocks, bpe, chat, components, langid, licences, mixing, neardup, neighbours, registry, sharding, topk, toxicity
from tests.conftest import SF, same_rows

SQL = registry.oracle_sql()
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None) for i, t, lang, s in rows], DOC)


AWKWARD = [(1, None, None, None), (2, "", "en", ""), (3, " \t\n", "en", "a"), (4, "one two three", None, "a"), (4, "one two three", None, "a"), (None, "x " * 5000, "en", "b"), (5, "Ünïcödé 日本語 😀 " * 50, "de", "b"), (6, "!!! 123", "fr", "c")]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    same_rows(registry.queries()[name](spark, SF), duck, SQL[name])


def clash(df):
    """The table with more columns, named like those that operators make."""
    for c in ("size", "shard", "slot", "rank", "score", "key", "kept", "ids", "fingerprint", "idx", "target", "sentences"):
        df = df.withColumn(c, F.lit(7))
    return df


@pytest.mark.parametrize("make", [licences.scan_licences, sharding.shard, bpe.digests, neardup.near_duplicates])
def test_awkward_rows(spark, make):
    df = docs(spark, AWKWARD)
    assert make(clash(df)).count() == len(AWKWARD)
    assert make(df.limit(0)).count() == 0


# 1 licences (more in test_licences)


def test_licences(spark):
    mit = "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and\nassociated documentation files. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = [(1, mit), (2, "Hello.\nLicensed under the Apache License, Version 2.0.\nYou may not use this file except in compliance with the License."), (3, "This licence is our own."), (4, "SPDX-License-Identifier: BSD-3-Clause"), (5, "Nothing here."), (6, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.")]
    got = {r.doc_id: r for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].licenses for i in range(1, 7)] == ["MIT", "Apache-2.0", "", "BSD-3-Clause", "", "CC-BY-NC-4.0,MIT"]
    assert got[3].n_unknown == 1 and got[5].n_unknown == 0 and got[1].sentence_ids == "MITTitle,MITGrant,MITNotice"


# 2 neighbours, 8 top-k


def vectors(spark, n=300, dim=8, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=dim).astype(np.float32)]) for i in range(n)]
    rows += [(n, None), (n + 1, [0.0] * dim), (n + 2, [float("nan")] * dim), (n + 3, [None] * dim), (n + 4, []), (None, [1.0] * dim), (0, rows[0][1]), (n + 5, [1.0, 2.0])]
    rows += [(n + 10 + i, rows[20][1]) for i in range(15)]  # one vector many times
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")


def usable(rows, zero):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            ok[i] = np.array(v, np.float32).astype(float)
    return ok


def test_nearest_is_exact(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 64)
    rows, df = vectors(spark)
    ok = usable(rows, False)
    got = defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 10 == 0, 6).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in (i for i in ok if i % 10 == 0):
        want = sorted((float(np.sqrt(((ok[q] - v) ** 2).sum())), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:6]
        assert [i for i, _ in got[q]] == [i for _, i in want]
        assert [s for _, s in got[q]] == pytest.approx([d for d, _ in want], abs=1e-12)


def test_top_scores_are_exact(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk, "BINS", 16)  # more rounds
    rows, df = vectors(spark)
    ok = {i: np.floor(256 * v).astype(int) for i, v in usable(rows, True).items()}
    got = defaultdict(list)
    for r in topk.top_scores(df, F.col("vec_id") % 10 == 0, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in (i for i in ok if i % 10 == 0):
        want = sorted((-int(ok[q] @ v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:5]
        assert got[q] == [(i, -s) for s, i in want]


def test_top_scores_with_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-3.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in topk.top_scores(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 131072), (2, -196608)]
    assert topk.top_scores(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert neighbours.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_large_products_stay_exact():
    a = np.array([[2.0**40, 3.0], [1.0, -1.0], [1e308, 0.5], [-1e308, 1e308]])
    whole = [[int(x) * 256 + int(256 * (x % 1)) if abs(x) > 1 else int(256 * x) for x in row] for row in a.tolist()]
    want = [[min(max(p[0] * q[0] + p[1] * q[1], -(1 << 63) + 1), (1 << 63) - 1) for q in whole] for p in whole]
    assert topk.products(a, a).tolist() == want
    small = np.array([[100, -7], [3, 127]], np.int8)
    assert topk.products(small, small).tolist() == (small.astype(int) @ small.astype(int).T).tolist()
    two = np.full((2, 700), 32_000, np.int16)
    assert topk.products(two, two).tolist() == [[700 * 32_000**2] * 2] * 2


EXTREME = [(0, [1e160, 0.0]), (1, [2e160, 1.0]), (2, [1.0, 2.0]), (3, [3.0, 4.0]), (4, [1e-300, 2e-300]), (5, [1e-300, 2.5e-300]), (6, [5e-324, 0.0]), (7, [-1e308, 1e308]), (8, [1e308, -1e308]), (9, [1e308, 3.0]), (100, [0.5, 0.5]), (200, [0.0, 1e-323])]


def test_extreme_vectors_are_near_or_far(spark):
    from decimal import Decimal, localcontext

    df = spark.createDataFrame(EXTREME, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") >= 0, 4).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    with localcontext() as c:
        c.prec = 700
        c.Emax, c.Emin = 10_000, -10_000
        exact = {(q, i): sum((Decimal(x) - Decimal(y)) ** 2 for x, y in zip(a, b)).sqrt() for q, a in EXTREME for i, b in EXTREME if i != q}
        for q, _ in EXTREME:
            want = sorted((float(exact[q, i]), i) for i, _ in EXTREME if i != q)[:4]
            assert [s for _, s in got[q]] == pytest.approx([d for d, _ in want], rel=1e-12)
            assert [i for i, _ in got[q]] == [i for _, i in sorted((round(d, 12) if d > 1e-100 else d, i) for d, i in want)]


def test_extreme_vectors_have_top_scores(spark):
    df = spark.createDataFrame(EXTREME, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in topk.top_scores(df, F.col("vec_id") >= 0, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ints = {i: [topk.whole(x) for x in v] for i, v in EXTREME}
    for q in ints:
        want = sorted((-min(max(sum(x * y for x, y in zip(ints[q], v)), -(1 << 63) + 1), (1 << 63) - 1), i) for i, v in ints.items() if i != q)[:5]
        assert got[q] == [(i, -s) for s, i in want]


def test_vectors_with_clashing_columns_and_a_common_vector(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else [float(x) for x in rng.normal(size=3)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for c in ("v", "class", "query_id", "score", "g", "nth", "asked", "c", "q"):
        df = df.withColumn(c, F.lit("x"))
    near, high = defaultdict(list), defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, 7).orderBy("query_id", "rank").collect():
        near[r.query_id].append(r.vec_id)
    for r in topk.top_scores(df, F.col("vec_id") % 20 == 0, 5).orderBy("query_id", "rank").collect():
        high[r.query_id].append(r.vec_id)
    m = np.array([v for _, v in rows])
    n = np.floor(256 * m).astype(int)
    for q in range(0, 300, 20):
        assert near[q] == [i for _, i in sorted((float(np.sqrt(((m[q] - m[i]) ** 2).sum())), i) for i in range(300) if i != q)[:7]]
        assert high[q] == [i for _, i in sorted((-int(n[q] @ n[i]), i) for i in range(300) if i != q)[:5]]


def test_quantisation_bounds():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(40, 64)), rng.normal(size=(50, 64)) * 10.0 ** rng.integers(-4, 4, (50, 1))
    low, high = neighbours.bounds(*neighbours.quantise(a), *neighbours.quantise(b))
    d = ((a[:, None] - b[None]) ** 2).sum(axis=2)
    assert (low <= d).all() and (d <= high).all()


# 3 toxicity, 6 language


def test_toxicity_learns(spark):
    import pandas as pd

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    text = lambda bad: " ".join([word() for _ in range(40)] + (["vilex" + rng.choice("abc")] if bad else []) + [word() for _ in range(10)])
    rows = pd.DataFrame([(text(i % 3 == 0), "en", int(i % 3 == 0)) for i in range(600)], columns=["text", "lang", "toxic"])
    model = toxicity.fit(rows[:450])
    scores = toxicity.Scorer(model).scores(list(rows["text"][450:]) + [None, "", "vilexa " * 400_000])
    assert (((scores[:150] >= 0.5).astype(int)) == rows["toxic"][450:].to_numpy()).mean() >= 0.97
    assert ((0 <= scores) & (scores <= 1)).all() and scores[150] == scores[151] < 0.5 and scores[152] >= 0.5


def test_toxicity_without_labels(spark):
    rows = docs(spark, AWKWARD)
    for labels, want in (([], 0.0), ([(4, 1)], 1.0)):
        model = toxicity.fit(toxicity.sample(rows, spark.createDataFrame(labels, "doc_id long, toxic int")))
        assert {r[0] for r in rows.select(toxicity.scorer(model)("text")).collect()} == {want}


def test_toxicity_query(spark):
    got = toxicity.op3_toxicity(spark, SF).collect()
    assert len(got) == 200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in got)


def test_toxicity_query_is_accurate(spark):
    sf = SF.replace("0.001", "0.01")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in toxicity.op3_toxicity(spark, sf).collect() if r.held_out and r.doc_id in truth]
    hits = sum(r.predicted and truth[r.doc_id] for r in held)
    assert hits / sum(truth[r.doc_id] for r in held) >= 0.8 and hits / sum(r.predicted for r in held) >= 0.8


def test_samples_are_bounded_in_bytes(spark):
    rows = [(i, "word " * 200, "en", "s") for i in range(400)] + [(1000, "x" * (toxicity.FIT_TEXT + 1), "en", "s")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(1000, 1)], "doc_id long, toxic int")
    for found in (toxicity.sample(docs(spark, rows), labels, max_bytes=100_000), langid.sample(docs(spark, rows), max_bytes=100_000)):
        assert 20_000 < found["text"].str.len().sum() < 200_000


def test_language_query_is_accurate(spark):
    got = {r.doc_id: r for r in langid.op6_language_id(spark, SF).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [i for i in got if got[i].held_out]
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == got[i].held_out for i in got)
    assert sum(got[i].lang_pred == truth[i] for i in held) / len(held) >= 0.95


def test_language_of_awkward_rows(spark):
    rows = docs(spark, AWKWARD)
    model = langid.train(rows)
    got = [tuple(r[0]) for r in rows.select(langid.predictor(model)("text")).collect()]
    assert [g[0] == "und" for g in got] == [True, True, True, False, False, False, False, True]
    none = langid.train(rows.limit(0))
    assert {tuple(r[0]) for r in rows.select(langid.predictor(none)("text")).collect()} == {("und", 0.0)}


def test_grams_count_alike_for_short_and_long():
    short, long_ = langid.grams("ab, c"), langid.grams("ab, c " * 20_000)
    assert set(short[0]) <= set(long_[0]) and langid.grams("12 !") is None


# 4 near duplicates


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    part = {i: i for i in sets}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                n = len(sets[i] & sets[j])
                if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                    a, b = sorted((find(i), find(j)))
                    part[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("region", [neardup.REGION, 8])
def test_near_duplicates_match_brute_force(spark, monkeypatch, region):
    monkeypatch.setattr(neardup, "REGION", region)  # 8: regions deepen
    rng = random.Random(4)
    base = [[f"w{rng.randrange(500)}" for _ in range(80)] for _ in range(40)]
    rows = []
    for i, words in enumerate(base):
        rows.append((i, " ".join(words)))
        for j in range(6):
            near = list(words)
            for _ in range(j % 4):
                near[rng.randrange(80)] = "new" + str(rng.random())
            rows.append((100 * i + 1000 + j, " ".join(near).upper() if j % 2 else " ".join(near)))
    crowd = base[0]
    rows += [(90_000 + j, " ".join(crowd[:40] + [f"n{j}"] + crowd[40:])) for j in range(60)]
    rows += [(7001, "one two"), (7002, "ONE  two"), (7003, None), (7004, ""), (7005, "one")]
    want = brute(rows, 3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == want


def test_near_duplicates_on_a_crowded_template(spark, monkeypatch):
    monkeypatch.setattr(neardup, "REGION", 32)  # the forest alone loses links here
    monkeypatch.setattr(neardup, "CROWD", 64)
    monkeypatch.setattr(neardup, "BLOCK", 128)
    rng = random.Random(5)
    edit = lambda words, n: [f"e{rng.random()}" if i in at else w for at in [set(rng.sample(range(len(words)), n))] for i, w in enumerate(words)]
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(600):
        rows.append((i, edit(base, rng.randrange(6, 11))))
        if i % 20 == 0:
            rows.append((10_000 + i, edit(rows[-1][1], 6)))
    rows = [(i, " ".join(words)) for i, words in rows]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == brute(rows, 3, 85)


def test_intersections_of_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(30)]
    want = [[len(np.intersect1d(a, b)) for b in sets[10:]] for a in sets[:10]]
    assert neardup.intersections(sets[:10], sets[10:]).tolist() == want


def test_near_duplicates_through_one_original(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 64)  # crowds are dealt out in several tiles
    monkeypatch.setattr(neardup, "CROWD", 32)
    rng = random.Random(12)
    base = [f"w{i}" for i in range(602)]
    rows = [(0, " ".join(base))]
    for c in range(1, 221):  # copies of one original, edited apart: 0.88 like it, 0.78 like each other
        words = list(base)
        for i in rng.sample(range(602), 13):
            words[i] = f"e{c}-{i}"
        rows.append((c, " ".join(words)))
    want = brute(rows, 3, 85)
    assert sum(component == 0 for _, component in want.values()) > 200
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == want


def test_one_row_of_each_group_stays(spark):
    rows = [(2, "a b c d e f", "en", "s"), (1, "a b c d e f", "en", "s"), (1, "a b c d e f", "en", "s"), (None, "q", None, None), (3, None, None, None)]
    assert sorted((r.doc_id or 0, r.text or "") for r in neardup.keep_one(docs(spark, rows)).collect()) == [(0, "q"), (1, "a b c d e f"), (3, "")]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)] + [(i, i + 1) for i in range(500, 700)]
    part = {n: n for e in edges for n in e}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        part[b] = a
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert got == {n: find(n) for n in part if find(n) != n}
    assert components.connected(spark.createDataFrame([], "u long, v long")).count() == 0


# 5 byte-level BPE


def test_bpe_round_trip(spark):
    import public_tokenizers

    c = bpe.codec(public_tokenizers.path(bpe.VOCABULARY))
    rng = random.Random(9)
    rows = [(1, None), (2, ""), (3, "a" * 50_000), (3, "a" * 50_000), (4, " " * 40_000 + "x"), (5, "don't " * 8_000), (6, "日本語\n\n  " * 7_000), (7, "<|endoftext|> 😀"), (8, "".join(rng.choice("ab'srevl  \n1.é😀") for _ in range(60_000))), (None, "x y  z\t\n" * 6_000)]
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = []
    for i, t in rows:
        ids = c._encoding.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_bpe_of_a_very_long_text(spark):
    import time

    import public_tokenizers

    c = bpe.codec(public_tokenizers.path(bpe.VOCABULARY))
    rng = random.Random(3)
    some = ["".join(rng.choice("abcdefghé") for _ in range(rng.randrange(2, 9))) for _ in range(5_000)]
    text = " ".join(rng.choice(some) for _ in range(3_000_000))  # about 20 MB
    start = time.time()
    got = bpe.digests(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert time.time() - start < 120
    ids = c._encoding.encode_ordinary(text)
    assert (got.n_tokens, got.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert got.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_tasks_hand_on_a_few_rows_at_a_time():
    """A batch of many long texts is worked off in slices: neither its strings nor its ids are in memory together."""
    import tracemalloc

    import public_tokenizers
    import pyarrow as pa

    path = public_tokenizers.path(bpe.VOCABULARY)
    texts = [f"{i} council on the new bridge over the river " * 360 for i in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(600), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "piece"])
    want = [bpe.codec(path).encode(t) for t in (texts[0], texts[599])]
    del texts
    rows, ends = [], []
    tracemalloc.start()
    for part in bpe._encode(path, "piece")(iter([batch])):
        assert part.schema.names == ["doc_id", "ids"]
        rows.append(part.num_rows)
        ends.append((part.column("ids")[0].as_py(), part.column("ids")[-1].as_py()) if len(rows) in (1, 10) else None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert max(rows) <= bpe.SLICES and sum(rows) == 600 and [ends[0][0], ends[-1][1]] == want
    assert peak < 8e6  # 600 texts have 10 MB, their ids as numbers 60 MB


# 7 sharding


def check_shards(got, rows, tolerance):
    """The law of near-equal bytes, gapless slots, and equal texts that stay together; returns the mean size."""
    texts = dict(rows)
    by, groups, sizes = defaultdict(list), defaultdict(set), defaultdict(int)
    for r in got:
        by[r.shard].append(r)
        groups[texts[r.doc_id] or ""].add(r.shard)
        sizes[texts[r.doc_id] or ""] += r.size
    mean = sum(r.size for r in got) / sharding.SHARDS
    assert len(got) == len(rows) and len(by) == sharding.SHARDS
    assert max(abs(sum(r.size for r in v) - mean) for v in by.values()) <= tolerance * mean
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 16 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in got)
    for text, where in groups.items():
        if sizes[text] <= mean:
            assert len(where) == 1
        else:  # whole shards, and what is left of it on one more
            assert len(where) <= sizes[text] / mean + 1
    return mean


def test_shards(spark):
    rng = random.Random(6)
    rows = [(i, "x" * rng.randrange(2_000)) for i in range(3_000)] + [(10_000 + i, "copy " * 400) for i in range(1_500)] + [(20_000, None), (20_001, "")]
    rows += [(30_000 + i, f"pair {i // 2} " + "y" * (i // 2)) for i in range(600)] + [(40_000 + i, f"twenty {i // 20} " * 20) for i in range(400)]
    rows += [(50_000, "long " * 20_000), (50_001, "long " * 20_000)]  # over half a shard each: a group larger than a shard
    rng.shuffle(rows)
    check_shards(sharding.shard(docs(spark, [(i, t, "en", "s") for i, t in rows])).collect(), rows, 0.05)


def test_shards_of_seated_groups_only(spark):
    rows = [(i, f"text {i // 30} " * 50) for i in range(1_800)]  # 60 groups for 40 shards: whole ones can't be even
    got = sharding.shard(docs(spark, [(i, t, None, None) for i, t in rows])).collect()
    check_shards(got, rows, 0.5)
    few = sharding.shard(docs(spark, [(1, "a", None, None), (2, "b", None, None)])).collect()
    assert sorted((r.doc_id, r.slot) for r in few) == [(1, 0), (2, 0)]


def test_shards_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sharding.op7_sharding(spark, SF).collect()
    largest = max(len(t.encode()) + 16 for _, t in rows)
    mean = check_shards(got, rows, 1.0 + largest)
    assert sum(r.size for r in got) == pytest.approx(40 * mean)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


# 9 mixing


def by_hand(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left = total - sum(fixed.values())
        free = [s for s in order if s not in fixed]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


def test_mix(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(1, 400), None, rng.choice(["a", "b", "b", "b", "c", "dé", None])) for i in range(900)] + [(5_000, None, None, "a"), (5_001, "", None, "zero"), (5_002, "tiny", None, "tiny")]
    narrow = mixing.scratch.stage(mixing.sized(docs(spark, rows)), "t")
    targets = mixing.scratch.stage(mixing.source_targets(narrow), "t")
    got = mixing.taken(narrow, targets).join(narrow.select("doc_id", "source"), "doc_id").collect()
    sizes = defaultdict(int)
    for r in got:
        sizes[r.source] += r["size"]
    want, taken = by_hand(sizes), defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r["size"]
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) < 1.001 for s in want)


def test_mix_of_nothing(spark):
    narrow = mixing.scratch.stage(mixing.sized(docs(spark, AWKWARD).limit(0)), "t")
    assert mixing.taken(narrow, mixing.scratch.stage(mixing.source_targets(narrow), "t")).count() == 0


def test_schedule_is_even(spark):
    rows = [(i, "w " * 100, None, s) for i, s in enumerate("abc" * 200)]
    narrow = mixing.scratch.stage(mixing.sized(docs(spark, rows)), "t")
    slots = mixing.schedule(mixing.scratch.stage(mixing.source_targets(narrow), "t"), 100).orderBy("slot").collect()
    first = [r.idx for r in slots[: len(slots) // 2]]
    assert first.count(0) / len(first) == pytest.approx(5 / 8, abs=0.02)
    for i in range(3):
        assert [r.rank for r in slots if r.idx == i] == list(range(sum(r.idx == i for r in slots)))


# 10 chat


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "\\", "<\\/s>", "<<TURN>>", "a <<TURN>> b", "<<SYS>>", "", None, "<s> <<s>>", "ends with <", "/s>", "\\\\[INST]", "日本😀\n"]
    rows = [(1, i, ("user", "assistant", "system", None, "tool [INST]")[i // 2 % 5], t) for i, t in enumerate(odd * 3)] + [(2, None, "user", "x"), (2, 1, "user", "x"), (2, 1, "user", "x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    out = chat.format_conversations(df)
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", "segments", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    want = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    for c, r in got.items():
        assert [tuple(t) for t in r.turns] == want[c]
        assert "".join(s.text for s in r.segments) == r.formatted
    assert chat.format_conversations(df.limit(0)).count() == 0
