"""Periodic runs of words: maximal repetitions found behind a mask of repeated k-grams.

A run is a stretch of consecutive words with smallest period q, of at least
``LEAST`` words and ``TIMES`` periods, that no neighbouring word extends. Its
words match the words q further on over at least ``k`` words, k being the least
such overlap of any period (``least_overlap``; 5 here). So every word of a run
lies in a k-gram that the same text holds twice: a word outside such k-grams
joins no run, and a run lies within one stretch of the others (a segment).
Segments alone go to the search; most texts have none.

In a segment, runs are found as Main and Lorentz do: it is halved again and
again, and at each middle every period is tried with its longest extensions to
the left and to the right. The extensions come from names of power-of-two
blocks (equal blocks, equal names), which makes them exact and lets numpy try
all middles of one length and all periods at once.

Scale: a text is searched where it is read, without an exchange. Memory holds a
batch of texts and, for a segment of n words, its names: n words for each power
of two at which blocks still repeat.

Defined cases: null and empty texts have no words and no runs; words are divided
by blanks (x20, x09-x0D) only; texts of any length are searched whole; a null
doc_id is carried along; repeated rows give repeated results; an empty table
gives an empty result; further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
LEAST = 6
TIMES = 4
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
#: Period trials that are compared at once.
TRIALS = 1 << 20


def least_overlap(least: int = LEAST, times: int = TIMES) -> int:
    """The least number of words over which a run matches itself shifted by its period."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


def segments(w: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Maximal stretches (from, to) of ``w`` (hashes of words) covered by k-grams that occur twice or more.

    k-grams are compared by a 64-bit hash of their words' hashes: a chance match can only widen a segment."""
    n = len(w) - k + 1
    if n < 2:
        return []
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[j : j + n].astype(np.uint64) + np.uint64(1)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return []
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(w) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    inside = np.concatenate(([False], np.cumsum(edge)[:-1] > 0, [False]))
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))


class Extensions:
    """Longest common extensions between positions of one sequence, from names of power-of-two blocks."""

    def __init__(self, w: np.ndarray):
        self.n, self.names = len(w), [np.unique(w, return_inverse=True)[1].astype(np.int64)]
        while (size := 1 << len(self.names)) <= self.n:
            last = self.names[-1]
            pairs = last[: self.n - size + 1] * (self.n + 1) + last[size // 2 : self.n - size // 2 + 1]
            known, names = np.unique(pairs, return_inverse=True)
            if len(known) == len(pairs):  # no block of this size occurs twice
                break
            self.names.append(names)

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that match from positions a and b > a on."""
        a, b, found = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for j in range(len(self.names) - 1, -1, -1):
            names, size = self.names[j], 1 << j
            fits = np.flatnonzero(b + size <= self.n)
            hit = fits[names[a[fits]] == names[b[fits]]]
            a[hit] += size
            b[hit] += size
            found[hit] += size
        return found

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that match before positions a and b > a."""
        a, b, found = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for j in range(len(self.names) - 1, -1, -1):
            names, size = self.names[j], 1 << j
            fits = np.flatnonzero(a >= size)
            hit = fits[names[a[fits] - size] == names[b[fits] - size]]
            a[hit] -= size
            b[hit] -= size
            found[hit] += size
        return found


def runs_of(w: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``w``, by start and period."""
    n = len(w)
    if n < max(least, times):
        return []
    ext, found, waiting = Extensions(w), [], []

    def tried() -> None:
        a, q = np.divmod(np.unique(np.concatenate(waiting)), n)
        before = ext.left(a, a + q)
        length = before + q + ext.right(a, a + q)
        good = length >= np.maximum(least, times * q)
        found.append(np.stack([(a - before)[good], length[good], q[good]]))
        waiting.clear()

    block, last = n, n
    while last >= least:  # a run holds a middle of the largest blocks that are no longer than the run, which are more than half as long
        middles, most = np.arange(block // 2, n, block), min(2 * block, n) // times
        for q0 in range(1, most + 1, step := max(1, TRIALS // len(middles))):
            q = np.arange(q0, min(q0 + step, most + 1))
            a, q = np.repeat(middles, len(q)), np.tile(q, len(middles))
            for shift in (0, 1):  # a run around the middle matches from it on, or from a period before it
                at = a - shift * q
                ok = np.flatnonzero((at >= 0) & (at + q < n))
                at, of = at[ok], q[ok]
                waiting.append((at * n + of)[w[at] == w[at + of]])
            if sum(map(len, waiting)) > TRIALS:
                tried()
        block, last = -(-block // 2), block if block > 1 else 0
    if waiting:
        tried()
    every = np.concatenate(found, axis=1)
    # equal stretches of several periods: the smallest is the run's
    order = np.lexsort((every[2], every[1], every[0]))
    every = every[:, order]
    first = np.ones(every.shape[1], bool)
    first[1:] = (every[:2, 1:] != every[:2, :-1]).any(axis=0)
    out = every[:, first]
    return list(map(tuple, out[:, np.lexsort((out[2], out[0]))].T.tolist()))


def numbered(words: list) -> np.ndarray:
    """A number for each distinct word."""
    known: dict = {}
    return np.fromiter((known.setdefault(x, len(known)) for x in words), np.int64, len(words))


def periodic(words: list, least: int = LEAST, times: int = TIMES) -> tuple[list[tuple[int, int, int]], list]:
    """The runs of a list of words, and the words that stay when each run keeps its first period."""
    found = segments(np.fromiter(map(hash, words), np.int64, len(words)), least_overlap(least, times))
    runs = [(s + lo, length, q) for lo, hi in found for s, length, q in runs_of(numbered(words[lo:hi]), least, times)]
    if not runs:
        return [], words
    drop = np.zeros(len(words), bool)
    for s, length, q in runs:
        drop[s + q : s + length] = True
    return runs, [words[i] for i in np.flatnonzero(~drop).tolist()]


def _search(least: int, times: int) -> Callable:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()  # bytes are divided at these very blanks
                runs, kept = periodic(words, least, times)
                rows.append((None if pd.isna(doc_id) else int(doc_id), len(words), [{"start": s, "length": n, "period": q} for s, n, q in runs], b" ".join(kept).decode("utf-8", "surrogatepass")))
            out = pd.DataFrame(rows, columns=["doc_id", "n_words", "runs", "collapsed"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return run


def find_runs(documents: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed: the words outside all runs or in a run's first period, joined by one blank."""
    return documents.select(F.col("doc_id").cast("long"), "text").mapInPandas(_search(least, times), SCHEMA)


def planted(doc_id: Column, text: Column) -> Column:
    """``text``, or for one document in ten (by its id's checksum) a text whose words repeat with a period from some word on."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def repeated(w: Column) -> Column:
        g = F.floor(h / 10)
        a = g % F.size(w)
        p = 1 + F.floor((F.size(w) - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    chosen = F.get(F.transform(F.array(words), repeated), F.lit(0))
    return F.when((h % 10 == 0) & (F.regexp_count(text, F.lit(WORD)) > 0), chosen).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, strongest run and digests of every document; one in ten has runs put in."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    out = find_runs(rows)

    def stronger(a: Column, b: Column) -> Column:
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(a.isNull() | (right > left), b).otherwise(a)

    best = F.aggregate(F.col("runs"), F.get("runs", F.lit(0)), stronger)  # equal ones: the first by start, then period
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


#: Unsigned CRC-32 of an ASCII text in DuckDB, as a macro of the text.
CRC_SQL = """CAST(xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split({x}, ''), lambda c: CAST(ascii(c) AS UBIGINT))),
  lambda s, b: xor(s >> 8, list_reduce(list_prepend(xor(s, b) & 255, range(8)::UBIGINT[]), lambda t, k: CASE WHEN t & 1 = 1 THEN xor(t >> 1, CAST(3988292384 AS UBIGINT)) ELSE t >> 1 END)))) AS BIGINT)"""
SQL_RUNS = rf"""
WITH d0 AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w0, CASE WHEN doc_id IS NULL THEN 1 ELSE {CRC_SQL.format(x="CAST(doc_id AS VARCHAR)")} END AS h FROM documents
), d1 AS (
  SELECT *, len(w0) AS n, CASE WHEN len(w0) > 0 THEN (h // 10) % len(w0) END AS a FROM d0
), d2 AS (
  SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM d1
), d AS (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w0[i + 1] ELSE w0[a + (i - a) % p + 1] END) ELSE w0 END AS w FROM d2
), g AS (
  SELECT r, i, w[i + 1:i + 5] AS five FROM (SELECT r, w, unnest(range(n - 4)) AS i FROM d WHERE n >= {LEAST})
), pairs AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.r = y.r AND x.five = y.five AND x.i < y.i
), islands AS (
  SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs
), stretches AS (
  SELECT r, q, min(i) AS start, count(*) + 4 + q AS length FROM islands GROUP BY r, q, island HAVING count(*) + 4 + q >= greatest({LEAST}, {TIMES} * q)
), runs AS (
  SELECT r, start, length, min(q) AS period FROM stretches GROUP BY r, start, length
), best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length / period DESC, start, period) = 1
), per AS (
  SELECT r, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256 FROM runs GROUP BY r
), gone AS (
  SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs
), words AS (
  SELECT r, unnest(w) AS word, unnest(range(n)) AS i FROM d
), kept AS (
  SELECT r, sha256(string_agg(word, ' ' ORDER BY i)) AS collapsed_sha256 FROM words ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.start, best.length, best.period, CAST(1000 * best.length // best.period AS BIGINT) AS exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256
FROM d LEFT JOIN per USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""
