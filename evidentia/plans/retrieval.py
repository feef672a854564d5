"""Queries of the text and retrieval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.operators import retrieval as rt
from evidentia.plans.register import SQL, query


def _docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@query("q_txt1_smart_truncate", "SELECT doc_id, CASE WHEN length(text) > 1400 THEN text[1:1050] || chr(10) || '...[middle omitted]...' || chr(10) || right(text, 350) ELSE text END AS text FROM documents")
def truncate(spark, sf):
    return _docs(spark, sf).select("doc_id", text.smart_truncate(F.col("text"), 1400).alias("text"))


@query("q_txt2_strip_thinking", "SELECT doc_id, trim(text, ' ') AS text FROM documents")
def thinking(spark, sf):
    noisy = F.concat(F.lit("<THINK>so\nthen</think>"), "text", F.lit("<think></think>"))
    return _docs(spark, sf).select("doc_id", text.strip_thinking(noisy).alias("text"))


@query("q_txt3_strip_cjk", "SELECT doc_id, trim(text || '   tail', ' ') AS text FROM documents")
def cjk(spark, sf):
    return _docs(spark, sf).select("doc_id", text.strip_cjk(F.concat("text", F.lit(" 서울東京 tail"))).alias("text"))


@query("q_win9_chunks", "SELECT doc_id, CAST(i AS INTEGER) AS chunk, md5(text[i * 1800 + 1:i * 1800 + 2000]) AS digest FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 1800 + 1)) AS i FROM documents WHERE length(text) > 0)")
def chunks(spark, sf):
    return rt.overlapping_chunks(_docs(spark, sf)).select("doc_id", "chunk", F.md5("text").alias("digest"))


_SPLIT = r"string_split(regexp_replace(trim(text, ' '), '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1))"


@query("q_txt4_sentences", f"SELECT doc_id, len(list_filter({_SPLIT}, lambda s: trim(s, ' ') <> '')) AS n, list_max(list_transform({_SPLIT}, lambda s: length(trim(s, ' ')))) AS longest FROM documents WHERE doc_id % 3 >= 0 AND NOT regexp_matches(text, '[.!?]\\s+[A-Z0-9][.!?]\\s')")
def sentence_counts(spark, sf):
    docs = _docs(spark, sf).where(~F.col("text").rlike(r"[.!?]\s+[A-Z0-9][.!?]\s"))
    s = text.sentences(F.col("text"))
    return docs.select("doc_id", F.size(s).cast("long").alias("n"), F.array_max(F.transform(s, lambda x: F.length(x).cast("long"))).alias("longest"))


@query("q_txt4_sentences_all")
def sentence_counts_all(spark, sf):
    """All documents, those with adjoining split points and null texts too, where the SQL's one-pass replacement differs."""
    s = text.sentences(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.when(F.col("text").isNotNull(), F.size(s).cast("long")).alias("n"), F.array_max(F.transform(s, lambda x: F.length(x).cast("long"))).alias("longest"))


@query(
    "q_txt5_keyword_overlap",
    """WITH c AS (SELECT doc_id, text, ['thing', 'that', 'with', 'ations'] AS w FROM documents),
t AS (SELECT doc_id, list_filter(w, lambda x: x NOT IN ('that', 'with')) AS w, list_transform(regexp_split_to_array(text, '\\s+'), lambda x: lower(regexp_replace(regexp_replace(x, '^[.,;:()\\[\\]%$''"]+', ''), '[.,;:()\\[\\]%$''"]+$', ''))) AS s FROM c)
SELECT doc_id, len(list_intersect(w, s)) / 2.0::DOUBLE AS overlap FROM t""",
)
def overlap(spark, sf):
    return _docs(spark, sf).select("doc_id", text.keyword_overlap(F.lit("Thing that, with (ations) of"), F.col("text")).alias("overlap"))


_NUMS = r"regexp_extract_all(text, '\d+\.\d+%?|\d+%|[1-9][\d,]{4,}')"


@query("q_txt6_claim_numbers", f"SELECT doc_id, array_to_string({_NUMS}, '|') AS numbers FROM documents")
def numbers(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_join(text.claim_numbers(F.col("text")), "|").alias("numbers"))


@query(
    "q_txt7_anchor_number",
    f"""WITH n AS (SELECT doc_id, unnest({_NUMS}) AS n, generate_subscripts({_NUMS}, 1) AS i FROM documents)
SELECT doc_id, arg_max(n, (CASE WHEN contains(n, '.') THEN 1 ELSE 0 END, length(regexp_replace(n, '\\D', '', 'g')), -i)) AS anchor FROM n GROUP BY doc_id""",
)
def anchor(spark, sf):
    return _docs(spark, sf).select("doc_id", text.anchor_number(text.claim_numbers(F.col("text"))).alias("anchor")).where("anchor IS NOT NULL")


@query(
    "q_txt8_number_support",
    """WITH f AS (SELECT doc_id, text, replace(text, ',', '') AS bare, list_transform(regexp_extract_all(text, '\\d[\\d,]*\\.?\\d*'), lambda t: try_cast(replace(t, ',', '') AS DOUBLE)) AS found FROM documents)
SELECT doc_id, contains(bare, '743') OR coalesce(len(list_filter(found, lambda t: t > 0 AND (abs(743.0::DOUBLE - t) / t <= 0.03 OR abs(743000.0::DOUBLE - t) / t <= 0.03 OR abs(0.743::DOUBLE - t) / t <= 0.03 OR abs(743000000.0::DOUBLE - t) / t <= 0.03 OR abs(0.000743::DOUBLE - t) / t <= 0.03))) > 0, false) AS supported,
  contains(bare, '47%') AS percent FROM f""",
)
def support(spark, sf):
    return _docs(spark, sf).select("doc_id", text.number_supported(F.lit("743"), F.col("text")).alias("supported"), text.number_supported(F.lit("47%"), F.col("text")).alias("percent"))


@query(
    "q_txt10_txt11_similarity",
    """WITH p AS (SELECT q.vec_id AS claim_id, c.vec_id AS vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS score FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT claim_id, arg_max(vec_id, (score, -vec_id)) AS vec_id, round(max(score), 6) AS score FROM p GROUP BY claim_id HAVING max(score) >= 0.2""",
)
def similarity(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    claims = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("claim_id"), "embedding")
    return rt.best_by_similarity(claims, vectors).withColumn("score", F.round("score", 6))


@query(
    "q_win10_txt12_budget",
    "SELECT doc_id, source FROM (SELECT doc_id, source, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM documents) WHERE used < 20000",
)
def budget(spark, sf):
    return rt.within_budget(_docs(spark, sf).select("doc_id", "source", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")], "n_chars", 20000).select("doc_id", "source")


@query("q_jon12_jon18_contained_claims", "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def contained(spark, sf):
    return rt.contained_claims(spark.read.parquet(f"{sf}/benchmark.parquet"), _docs(spark, sf))


@query("q_txt9_win11_snippets")
def snippet(spark, sf):
    bench, docs = spark.read.parquet(f"{sf}/benchmark.parquet"), _docs(spark, sf)
    pairs = rt.contained_claims(bench, docs)
    return rt.snippets(pairs.join(bench.select("item_id", F.col("text").alias("claim")), "item_id").join(docs.select("doc_id", "text"), "doc_id"))


@query("q_txt13_statuses", "SELECT doc_id, CASE WHEN quality >= 0.5 THEN 'supported' WHEN quality >= 0.3 THEN 'moderate' ELSE 'low' END AS status FROM labels")
def statuses(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", rt.citation_status(F.col("quality")).alias("status"))


_MARKS = [w for pair in rt.MARKERS.values() for words in pair for w in words] + list(rt.REPORT_MARKERS)
_quoted = ", ".join("'" + w + "'" for w in _MARKS)
#: Texts of files: a document with three phrases of the trade, chosen by its id and length.
_FILES = f"""files AS (SELECT doc_id, concat(coalesce(text, ''), ' ', upper(m[doc_id % {len(_MARKS)} + 1]), ' ', m[n_chars % {len(_MARKS)} + 1], ' ', m[(doc_id * 7 + n_chars) % {len(_MARKS)} + 1]) AS body, source AS name FROM (SELECT *, [{_quoted}] AS m FROM documents))"""


def _files(spark, sf):
    m, n = F.array(*map(F.lit, _MARKS)), len(_MARKS)
    pick = lambda i: F.get(m, (i % n).cast("int"))
    body = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.upper(pick(F.col("doc_id"))), F.lit(" "), pick(F.col("n_chars")), F.lit(" "), pick(F.col("doc_id") * 7 + F.col("n_chars")))
    return _docs(spark, sf).select("doc_id", body.alias("body"), F.col("source").alias("name"))


def _count_sql(words) -> str:
    return "(" + " + ".join(f"contains(t, '{w}')::INT" for w in words) + ")"


@query(
    "q_agg12_flt15_keyword_scores",
    f"""WITH {_FILES}, l AS (SELECT doc_id, lower(body) AS t FROM files), s AS (SELECT doc_id, {', '.join(f"{_count_sql(a)} AS {k}_n, 3 * {_count_sql(a)} + {_count_sql(b)} AS {k}" for k, (a, b) in rt.MARKERS.items())} FROM l)
SELECT doc_id, CAST(land AS INTEGER) AS land, CAST(sales AS INTEGER) AS sales, CAST(rent AS INTEGER) AS rent,
  array_to_string(list_transform(list_sort(list_filter([{', '.join("{'s': -" + k + ", 'i': " + str(i) + ", 'n': " + k + "_n, 'k': '" + k + "'}" for i, k in enumerate(rt.MARKERS))}], lambda x: x.n >= 1 OR x.s <= -5)), lambda x: x.k), ',') AS types FROM s""",
)
def keywords(spark, sf):
    rows = _files(spark, sf).select("doc_id", rt.marker_scores(F.col("body")).alias("s"))
    return rows.select("doc_id", *[F.col("s")[k]["score"].alias(k) for k in rt.MARKERS], F.array_join(rt.present_types(F.col("s")), ",").alias("types"))


query("q_agg12_flt15_keyword_scores_all", SQL["q_agg12_flt15_keyword_scores"])(keywords)


@query("q_flt16_report_like", f"WITH {_FILES}, l AS (SELECT doc_id, lower(name || ' ' || body) AS t FROM files) SELECT doc_id, coalesce({_count_sql(rt.REPORT_MARKERS)}, 0) >= 2 AS report_like FROM l")
def report_like(spark, sf):
    return _files(spark, sf).select("doc_id", rt.report_like(F.col("name"), F.col("body")).alias("report_like"))


@query(
    "q_src22_html_text",
    "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages",
)
def html(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", text.html_text(F.col("html")).alias("text"))


_STRIP = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
_HINTS = ("/the", "tion", "/a", "en", "ch")


@query(
    "q_src21_ded5_links",
    f"""WITH p AS (SELECT page_id, url AS base, html, string_split(html, '<a ') AS parts FROM pages),
k AS (SELECT *, unnest(range(2, len(parts) + 1)) AS k FROM p),
a AS (SELECT page_id, base, html, k, parts[k] AS piece, CAST(list_sum(list_transform(parts[1:k - 1], lambda x: length(x))) AS BIGINT) + 3 * (k - 2) AS off FROM k),
t AS (SELECT page_id, k, regexp_extract('<a ' || piece, '(?is)^<a\\b[^>]*?href="[^"]+"[^>]*>.*?</a>') AS anchor, regexp_extract(base, '^[a-z]+://[^/?#]+') || regexp_extract('<a ' || piece, '(?is)^<a\\b[^>]*?href="([^"]+)"', 1) AS url, html, off FROM a),
g AS (SELECT page_id, k, url, {_STRIP.format('anchor')} AS title, {_STRIP.format('html[off + length(anchor) + 1:off + length(anchor) + 900]')} AS snippet FROM t WHERE anchor <> ''),
f AS (SELECT page_id, split_part(url, '?', 1) AS plain, min(k) AS k, arg_min(url, k) AS url, arg_min(title, k) AS title, arg_min(snippet, k) AS snippet FROM g
  WHERE length(title) >= 3 AND regexp_matches(lower(split_part(url, '?', 1)), '{'|'.join(_HINTS)}') GROUP BY ALL)
SELECT page_id, url, title[1:140] AS title, snippet[1:280] AS snippet FROM f QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY k) <= 40""",
)
def anchors(spark, sf):
    return rt.links(spark.read.parquet(f"{sf}/pages.parquet"), _HINTS, 3)


@query("q_txt19_txt21_render", "SELECT conv_id, string_agg(CAST(turn + 1 AS VARCHAR) || '. ' || role || ' (' || CAST(length(text) AS VARCHAR) || ')', chr(10) ORDER BY turn) AS summary FROM conversations GROUP BY conv_id")
def render(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    line = F.concat((F.col("turn") + 1).cast("string"), F.lit(". "), "role", F.lit(" ("), F.length("text").cast("string"), F.lit(")"))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("summary"))


@query("q_txt17_merge_insights", "SELECT source, array_to_string(list_slice(list_sort(list(CAST(n_chars AS VARCHAR) || ' ' || lang)), 1, 10), '; ') AS insights FROM documents GROUP BY source")
def insights(spark, sf):
    # a bounded list per source: ten rows by rank, not a collected group
    from pyspark.sql import Window

    d = _docs(spark, sf).select("source", F.concat(F.col("n_chars").cast("string"), F.lit(" "), "lang").alias("v"))
    top = d.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("v"))).where("n <= 10")
    return top.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("v")), "; ").alias("insights"))


@query("q_txt22_stuffing", "SELECT doc_id, source, CAST(greatest(least(n_chars, 30000 - used), 0) AS BIGINT) AS taken FROM (SELECT doc_id, source, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM documents)")
def stuffing(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum("n_chars").over(w), F.lit(0))
    return _docs(spark, sf).select("doc_id", "source", F.greatest(F.least(F.col("n_chars"), F.lit(30000) - used), F.lit(0)).alias("taken"))


@query("q_win14_shingle_match", "SELECT doc_id, len(list_filter(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ') = 'of the of the')) > 0 AS hit FROM (SELECT doc_id, string_split(regexp_replace(trim(text, ' '), '\\s+', ' ', 'g'), ' ') AS w FROM documents)")
def shingle(spark, sf):
    w = F.split(F.regexp_replace(F.trim("text"), r"\s+", " "), " ")
    d = _docs(spark, sf).select("doc_id", w.alias("w"))
    grams = F.when(F.size("w") >= 4, F.transform(F.sequence(F.lit(1), F.size("w") - 3), lambda i: F.array_join(F.slice("w", i, 4), " "))).otherwise(F.array().cast("array<string>"))
    return d.select("doc_id", F.array_contains(grams, "of the of the").alias("hit"))
