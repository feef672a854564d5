"""Prefix tries, periodic runs and quality rules against brute force and on awkward rows."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from evidentia.llm import periodic, prefixes, quality

CONV = "conv_id long, turn long, role string, text string"
DOC = "doc_id long, text string, n_words long, kept boolean, runs string, lines int, name long, bytes long, h int"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_trie(rows):
    """Nodes of the trie of (conv_id, turn, role, text) rows, by the definition."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), (role, text)))
    paths = {c: tuple(t for _, _, t in sorted(ts)) for c, ts in convs.items()}
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    own = {n: (len(m) - 1) * (len(n[-1][1].encode()) if n else 0) for n, m in members.items()}
    out = []
    for n, m in members.items():
        below = [x for x in members if x[: len(n)] == n]
        children = [x for x in below if len(x) == len(n) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        ends = sorted(c for c in m if len(paths[c]) == len(n))
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children), len(leaves), sum(own[x] for x in below), sha(",".join(map(str, ends)))))
    return sorted(out, key=repr)


def got_trie(df):
    return sorted(map(tuple, df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


def conversations(seed, n):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-900, 900), n):
        rows += [(c, k, "user" if k % 2 == 0 else "assistant", rng.choice("ab")) for k in range(rng.choice([1, 2, 3, 7, 8, 9, 17, 33]))]
    rows += [(5, None, None, None), (5, None, None, None), (5, 2, "user", ""), (None, 0, "user", "x"), (6, 1, "é", "日本"), (6, 1, "a", "日本"), (6, None, "z", "😀")]
    rng.shuffle(rows)
    return rows


def test_trie_is_the_brute_force_one(spark):
    rows = conversations(3, 60)
    df = spark.createDataFrame(rows, CONV)
    for c in ("pos", "name", "depth", "owner", "bytes", "h", "part", "at", "turn_key", "base"):
        df = df.withColumn(c, F.lit(7))
    assert got_trie(prefixes.prefix_trie(df)) == brute_trie(rows)


def test_trie_keeps_conversations_without_turns_and_long_ones(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "STRETCH", 16)
    turns = spark.createDataFrame([(1, k + 1, f"t{k % 3}", 2) for k in range(70)] + [(2, k + 1, f"t{k % 3}", 2) for k in range(69)], "conv_id long, pos long, turn_key string, bytes long")
    lengths = spark.createDataFrame([(1, 70), (2, 69), (7, 0)], "conv_id long, n_turns long")
    nodes = {r.depth: r for r in prefixes.trie(turns, lengths).collect()}
    assert len(nodes) == 71
    assert nodes[0].n_convs == 3 and nodes[0].ends_sha256 == sha("7") and nodes[0].parent_conv_id is None
    assert nodes[0].saved_tokens == nodes[1].saved_tokens == 2 * 69 and nodes[60].saved_tokens == 2 * 10
    assert nodes[69].ends_sha256 == sha("2") and nodes[70].n_convs == 1 and nodes[5].n_leaves == 1


def test_trie_digests_many_ids_in_order(spark):
    ids = list(range(-3000, 3000, 2))
    df = spark.createDataFrame([(i, 0, "user", "same") for i in ids], CONV)
    root, leaf = sorted(prefixes.prefix_trie(df).collect(), key=lambda r: r.depth)
    assert leaf.ends_sha256 == sha(",".join(map(str, ids))) and root.ends_sha256 == sha("") and root.n_leaves == 1


def test_trie_of_nothing(spark):
    assert prefixes.prefix_trie(spark.createDataFrame([], CONV)).count() == 0
    assert prefixes.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], CONV)).count() == 0


def brute_runs(w, least, times):
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda x: (x[0], x[2]))


@pytest.mark.parametrize("least, times", [(6, 4), (4, 2), (8, 3), (1, 2)])
def test_runs_are_the_brute_force_ones(least, times):
    rng = random.Random(least)
    for _ in range(600):
        w = [rng.choice(b"abcde"[: rng.choice([1, 2, 3, 5])].decode()) for _ in range(rng.randrange(90))]
        if len(w) > 8 and rng.random() < 0.6:
            a = rng.randrange(len(w))
            p = 1 + (len(w) - a) // rng.randrange(3, 11)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs, kept = periodic.periodic(w, least, times)
        assert runs == brute_runs(w, least, times)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert kept == [x for i, x in enumerate(w) if i not in gone]


def test_words_outside_segments_join_no_run():
    assert periodic.least_overlap() == 5
    w = periodic.numbered(list("zzzyxabcabcabcabcwv"))
    lo, hi = periodic.segments(w, 5)[0]
    assert (lo, hi) == (5, 17) and periodic.periodic(list("zzzyxabcabcabcabcwv"))[0] == [(5, 12, 3)]


AWKWARD = [(1, None), (2, ""), (3, " \t\n"), (4, "one two three"), (4, "one two three"), (None, "x " * 5000), (5, "Ünïcödé 日本語 😀 " * 50), (6, "a b a b a b a b a b a b"), (7, "no run here at all, only words that differ"), (10, "w " * 7)]


def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("n_words", "kept", "runs", "lines", "base", "collapsed", "cleaned", "best", "start", "h"):
        df = df.withColumn(c, F.lit(7))
    return df


def test_runs_on_awkward_rows(spark):
    got = periodic.find_runs(docs(spark, AWKWARD)).collect()
    for r in got:
        text = next(t or "" for i, t in AWKWARD if i == r.doc_id)
        words = text.encode().split()
        runs, kept = periodic.periodic(words)
        assert [tuple(x) for x in r.runs] == brute_runs(words, 6, 4) == runs and r.collapsed == b" ".join(kept).decode() and r.n_words == len(words)
    assert len(got) == len(AWKWARD) and periodic.find_runs(docs(spark, AWKWARD).limit(0)).count() == 0
    assert next(r for r in got if r.doc_id is None).collapsed == "x" and next(r for r in got if r.doc_id == 6).n_words == 6


def brute_base(text):
    words = [w.decode() for w in (text or "").encode().split()]
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    fives = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + j for i in range(len(words) - 4) if fives[tuple(words[i : i + 5])] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_base_rules_are_the_brute_force_ones(spark):
    rng = random.Random(5)
    rows = AWKWARD + [(100 + i, "".join(rng.choice(["a", "b", "c ", " ", "\n", "é|", "# ", "d e f g h ", "\r\n"]) for _ in range(rng.randrange(120)))) for i in range(150)]
    got = quality.clean_lines(docs(spark, rows)).select("doc_id", "base.*", "base_failed").collect()
    want = Counter((i, *brute_base(t)) for i, t in rows)
    assert Counter(tuple(r)[:6] for r in got) == want
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in got)
    assert quality.clean_lines(docs(spark, rows).limit(0)).count() == 0


PROSE = "The harbour was quiet that morning, and the boats lay still at the quay."


def test_lines_and_verdicts(spark):
    rules = {
        PROSE: None, "": None, "Short but closed.": None, "Zu Ende (ganz).": None, "短い文。": None,
        "Home | News | Sports | Weather": "navigation", "Next  Page": "navigation", "BACK TO TOP": "navigation",
        "We use a Cookie to serve you.": "boilerplate", "© 2020 Acme. All rights reserved.": "boilerplate",
        "a fragment without an end": "punctuation", "BUY!! NOW!! ONLY!! TODAY!! AND!! NEVER!! AGAIN!! OR!! ELSE!! SO.": "punctuation",
        "a long line without a closing mark stays because it has ten words": None, PROSE + " It mentions no privacy policy, though a longer sentence that names a cookie is prose all the same.": None,
    }
    lines = list(rules)
    mixed = "\n".join([PROSE, "Home | News | Sports | Weather", "The second line is prose as well, and differs from the first one."])
    rows = [(1, "\n".join(lines)), (2, mixed), (3, "\n".join(f"Item {i} | Other {i} | Third {i}" for i in range(9)) + "\n" + PROSE), (4, PROSE)]
    got = {r.doc_id: r for r in quality.clean_lines(docs(spark, rows)).collect()}
    assert [(x.line, x.rule) for x in got[1].lines] == [(x, rules[x]) for x in lines]
    assert got[2].kept and got[2].lost_words == 7 and "Home" not in got[2].cleaned and got[2].cleaned.count("\n") == 1
    assert not got[3].kept and not got[3].base_failed and got[3].cleaned == PROSE and got[4].kept
