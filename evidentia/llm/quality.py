"""Quality rules: lines are cleaned first, documents judged by what they lose, natively.

Every line of a text (split at ``\\n``) is held against three rules, and the
first that it breaks is its verdict:

* navigation: at least one word in four is a mere separator (``SEPARATORS``),
  or the whole line is one of ``LABELS``;
* boilerplate: a line of less than ``BOILERPLATE_WORDS`` words holds one of
  ``PHRASES``;
* punctuation: a line of less than ``FRAGMENT`` words has no closing mark at
  its end, or three words in ten end in two or more of ``!?#$%&*``.

Failed lines are removed. A document is rejected if it loses more than
``LOSS_PERCENT`` of its words, or by the base rules: less than ``LEAST_WORDS``
words, or more than ``REPEAT_PERCENT`` of the words in windows of ``WINDOW``
words that the text has twice or more.

Everything is a Spark expression on one row: no exchange, no Python. Windows
are compared by 64-bit hashes of their words' 64-bit hashes (two different
windows of one text of n words meet with a chance of n * n / 2^65); they are
sorted only in texts where the number of distinct hashes shows a repeat.

Defined cases: null and empty texts have no words, no lines that fail, and
fail the base rules; lines without a word are kept as they are and count for
nothing; a null doc_id is carried along; repeated rows give repeated results;
an empty table gives an empty result; further columns, whatever their names,
are not looked at.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
SEPARATORS = "[|>»›•·]+"
LABELS = ("home", "menu", "next", "previous", "next page", "previous page", "back to top", "read more", "log in", "sign in", "sign up", "search", "share", "skip to content", "contact us", "about us")
LABEL_WORDS = max(len(x.split()) for x in LABELS)
PHRASES = ("cookie", "privacy policy", "terms of use", "terms of service", "all rights reserved", "enable javascript", "lorem ipsum", "subscribe to our newsletter", "click here", "powered by", "share on facebook")
CLOSED = r"""[.!?…。！？:;][)\]"'”’»]*[\x20\x09-\x0D]*\z"""
MARKED = "[!?#$%&*]{2,}"
BOILERPLATE_WORDS = 20
FRAGMENT = 10
LOSS_PERCENT = 50
LEAST_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _n(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def broken_rule(line: Column, n: Column) -> Column:
    """navigation, boilerplate, punctuation, or null for a line of n words that stays."""
    whole_word = rf"(?<![^\x20\x09-\x0D])(?:{SEPARATORS})(?![^\x20\x09-\x0D])"
    small = F.lower(line)
    label = F.btrim(F.regexp_replace(small, rf"{BLANK}+", " ")).isin(*LABELS)
    navigation = ((n <= LABEL_WORDS) & label) | (4 * _n(line, whole_word) >= n)
    boilerplate = (n < BOILERPLATE_WORDS) & functools.reduce(operator.or_, (F.contains(small, F.lit(x)) for x in PHRASES))
    fragment = (n < FRAGMENT) & ~line.rlike(CLOSED)
    shouted = 10 * _n(line, rf"{MARKED}(?![^\x20\x09-\x0D])") >= 3 * n
    return F.when(n == 0, F.lit(None)).when(navigation, "navigation").when(boilerplate, "boilerplate").when(fragment | shouted, "punctuation")


def judged_lines(text: Column) -> Column:
    """array of (line, words, rule): every line of ``text`` with its words and the rule it breaks, if any."""
    judged = lambda line: _let(_n(line, WORD), lambda n: F.struct(line.alias("line"), n.cast("long").alias("words"), broken_rule(line, n).alias("rule")))
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), judged)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many of ``words`` lie in windows of so many words that occur twice or more."""

    def covered(hashes: Column) -> Column:
        def starts(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
            return F.sort_array(F.transform(twice, lambda x: x["at"]))

        ordered = _let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at")))), starts)
        first = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
        step = lambda a, x: F.struct((a["n"] + F.least(x - a["last"], F.lit(window))).alias("n"), x.alias("last"))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(F.aggregate(ordered, first, step, lambda a: a["n"]))

    def by_hash(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - window)
        return _let(F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)])), covered)

    return F.when(F.size(words) < window, 0).otherwise(_let(F.transform(words, lambda w: F.xxhash64(w)), by_hash)).cast("long")


def base_rules(text: Column) -> Column:
    """struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    text = F.coalesce(text, F.lit(""))
    lines = lambda found: (F.size(found) - F.size(F.array_distinct(found))).cast("long")
    return _let(
        _words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            (F.length(text) - _n(text, BLANK)).cast("long").alias("word_chars"),
            _n(text, SYMBOL).cast("long").alias("n_symbols"),
            _let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lines).alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )


def clean_lines(documents: DataFrame) -> DataFrame:
    """doc_id, base (see ``base_rules``), lines (see ``judged_lines``), cleaned: the text without
    failed lines, lost_words, base_failed and kept."""
    judged = documents.select("doc_id", base_rules(F.col("text")).alias("base"), judged_lines(F.col("text")).alias("lines"))
    lost = F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + F.when(x["rule"].isNull(), 0).otherwise(x["words"]))
    n = F.col("base.n_words")
    bad = (n < LEAST_WORDS) | (100 * F.col("base.n_repeat_words") > REPEAT_PERCENT * n)
    cleaned = F.array_join(F.transform(F.filter("lines", lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n")
    return judged.select("doc_id", "base", "lines", cleaned.alias("cleaned"), lost.alias("lost_words"), bad.alias("base_failed"), (~bad & (100 * lost <= LOSS_PERCENT * n)).alias("kept"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict, lost words, digest of the cleaned text and verdict of every document."""
    out = clean_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "base.*", "base_failed", "kept", "lost_words", F.sha2("cleaned", 256).alias("cleaned_sha256"))


_LABELS_SQL = ", ".join(f"'{x}'" for x in LABELS)
_ENDS_SQL = CLOSED.replace("'", "''")
SQL_QUALITY = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), l AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d
), lw AS (
  SELECT r, k, line, regexp_extract_all(line, '{WORD}') AS w, lower(line) AS small FROM l
), judged AS (
  SELECT r, k, line, len(w) AS n, CASE WHEN len(w) = 0 THEN NULL
    WHEN 4 * len(list_filter(w, lambda x: regexp_full_match(x, '{SEPARATORS}'))) >= len(w) OR array_to_string(list_transform(w, lambda x: lower(x)), ' ') IN ({_LABELS_SQL}) THEN 'navigation'
    WHEN len(w) < {BOILERPLATE_WORDS} AND regexp_matches(small, '{"|".join(PHRASES)}') THEN 'boilerplate'
    WHEN (len(w) < {FRAGMENT} AND NOT regexp_matches(line, '{_ENDS_SQL}')) OR 10 * len(list_filter(w, lambda x: regexp_matches(x, '{MARKED}\z'))) >= 3 * len(w) THEN 'punctuation' END AS rule
  FROM lw
), per AS (
  SELECT r, CAST(coalesce(sum(n) FILTER (WHERE rule IS NOT NULL), 0) AS BIGINT) AS lost_words,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE rule IS NULL), '')) AS cleaned_sha256,
    CAST(count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS BIGINT) AS n_dup_lines
  FROM judged GROUP BY r
), g AS (
  SELECT r, i, w[i:i + {WINDOW - 1}] AS five FROM (SELECT r, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i FROM d WHERE len(w) >= {WINDOW})
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, five) AS c FROM g) WHERE c > 1
), rep AS (
  SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM twice, (SELECT unnest(range({WINDOW})) AS j) GROUP BY r
), b AS (
  SELECT d.r, d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '{SYMBOL}')) AS BIGINT) AS n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, lost_words, cleaned_sha256
  FROM d JOIN per USING (r) LEFT JOIN rep USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AND 100 * lost_words <= {LOSS_PERCENT} * n_words AS kept, lost_words, cleaned_sha256
FROM b
"""
