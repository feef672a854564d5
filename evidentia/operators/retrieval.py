"""From claims to passages: page chunks, gates, similarity, snippets and budgets."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.operators.staging import staged

SNIPPET_CHARS = 400
#: Finite verbs, one of which makes a line a sentence. Fixed values.
FINITE_VERBS = (
    "is", "are", "was", "were", "been", "has", "have", "had",
    "will", "would", "could", "should", "may", "might",
    "increase", "increased", "increases", "decrease", "decreased", "decreases", "rise", "rose", "rises", "fall", "fell", "falls", "grow", "grew", "grows", "decline", "declined", "declines",
    "remain", "remained", "remains", "continue", "continued", "continues", "expect", "expected", "expects", "project", "projected", "projects", "record", "recorded", "records",
    "reach", "reached", "reaches", "show", "showed", "shows", "indicate", "indicated", "indicates", "suggest", "suggested", "suggests", "reflect", "reflected", "reflects",
    "represent", "represented", "represents", "absorb", "absorbed", "absorbs", "lease", "leased", "leases", "complete", "completed", "completes", "deliver", "delivered", "delivers",
    "tighten", "tightened", "tightens", "ease", "eased", "eases", "expand", "expanded", "expands", "contract", "contracted", "contracts", "improve", "improved", "improves",
    "weaken", "weakened", "weakens", "exceed", "exceeded", "exceeds", "account", "accounted", "accounts", "underpin", "underpinned", "underpins",
    "constrain", "constrained", "constrains", "support", "supported", "supports", "drive", "driven", "drives", "total", "totalled", "totals",
)


def overlapping_chunks(documents: DataFrame, size: int = 2000, step: int = 1800) -> DataFrame:
    """doc_id, chunk, text: windows of ``size`` characters every ``step``, up to the one that reaches the end."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(step))
    rows = documents.where(F.length("text") > 0).select("doc_id", "text", F.posexplode(starts).alias("chunk", "at"))
    return rows.select("doc_id", "chunk", F.substring(F.col("text"), F.col("at") + 1, F.lit(size)).alias("text"))


#: Ends of lines, and runs of blanks, as text editors know them.
LINE_END = r"\r\n|[\n\r\x0b\f\x1c\x1d\x1e\x85\u2028\u2029]"
BLANKS = r"[\s\x1c-\x1f\x85\p{Z}]+"


def any_word(words: tuple[str, ...]) -> str:
    """A pattern for a word between blanks that is one of ``words`` once lowered and bare of punctuation at its ends.

    Words share their beginnings, so that a position is left at the first letter that none has. What lowers to an ASCII
    letter is its capital and, for k, the kelvin sign."""
    tree: dict = {}
    for word in words:
        node = tree
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ways = [f"[{x}{x.upper()}{KELVIN if x == 'k' else ''}]{pattern(rest)}" for x, rest in node.items() if x]
        return ("(?:" + "|".join(ways) + ")" + "?" * ("" in node)) if ways else ""

    marks, inside = r"""[.,;:()\[\]%$'"]*""", BLANKS[:-1].replace("[", "[^")
    return rf"(?<!{inside}){marks}{pattern(tree)}{marks}(?!{inside})"


KELVIN = "\u212a"


def prose_lines(body: Column, least: int = 80) -> Column:
    """Prose and table lines of a page, joined to paragraphs; a blank or all-capital line ends one. Short pages give an empty text, null ones null.

    Lines are trimmed before they are judged, and the text is joined before it is measured: inside a lambda each mention
    of an expression is worked out again."""
    sentence, blank, word = any_word((*FINITE_VERBS, "the")), BLANKS[:-1], BLANKS[:-1].replace("[", "[^") + "+"

    def kept(line: Column) -> Column:
        table = line.rlike(rf"{word}{blank}+{word}{blank}+{word}{blank}+{word}") & line.rlike(r"\d+\.\d+|\d+%|[1-9][\d,]{4,}") & line.rlike("[A-Za-z]{3,}")
        return (
            F.when(line == "", "\u0001").when(~line.rlike(rf"{word}{blank}+{word}{blank}+{word}"), F.lit(None).cast("string")).when(line.rlike(r"\A(?:©|[sS][oO][uU][rR][cC][eE]:|[nN][oO][tT][eE]:)"), F.lit(None).cast("string"))
            .when(line == F.upper(line), "\u0001").when(line.rlike(sentence) | table, line)
        )

    lines = F.transform(F.split(body, LINE_END), lambda raw: F.regexp_replace(raw, rf"\A{BLANKS}|{BLANKS}\z", ""))
    joined = F.array_join(F.array_compact(F.transform(lines, kept)), " ")
    parts = F.filter(F.transform(F.split(joined, "\u0001"), lambda p: F.trim(p)), lambda p: p != "")
    return F.get(F.transform(F.array(F.array_join(parts, "\n\n")), lambda out: F.when(F.length(out) < least, "").otherwise(out)), F.lit(0))


def best_by_similarity(claims: DataFrame, vectors: DataFrame, least: float = 0.20, block_rows: int = 1024) -> DataFrame:
    """claim_id, vec_id, score: the most similar vector of each claim (by cosine), if similar enough; ties to the smaller vec_id.

    Claims and vectors are packed into blocks of unit rows; blocks of claims meet
    slices of the vectors over an equi-join and are multiplied as matrices in
    single precision. What is within its rounding of a claim's best is computed
    again in double precision, and a claim leaves a task with one row."""
    n = max(1, -(-claims.count() // block_rows))
    slices = max(16, 2 * claims.sparkSession.sparkContext.defaultParallelism)
    packed = claims.select(F.pmod(F.xxhash64("claim_id"), F.lit(n)).alias("block"), "claim_id", "embedding").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    sliced = vectors.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int").alias("slice")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    ok = "embedding IS NOT NULL AND size(embedding) > 0"
    tiles = packed.where(ok).groupBy("block", "slice").cogroup(sliced.where(ok).groupBy("block", "slice"))
    best = tiles.applyInPandas(_best_in_tile, "claim_id long, vec_id long, score double").groupBy("claim_id").agg(F.max(F.struct("score", (-F.col("vec_id")).alias("neg"))).alias("m"))
    return best.select("claim_id", (-F.col("m.neg")).alias("vec_id"), F.col("m.score").alias("score")).where(F.col("score") >= least)


def _best_in_tile(claims: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
    found = []
    for size in set(claims["embedding"].map(len)) & set(vectors["embedding"].map(len)):
        c, v = (t[t["embedding"].map(len) == size] for t in (claims, vectors))
        a, b = (np.stack(t["embedding"]).astype(np.float64) for t in (c, v))
        na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
        unit = lambda m, norm: (m / np.where(norm > 0, norm, 1.0)[:, None]).astype(np.float32)
        ids, own = v["vec_id"].to_numpy(np.int64), c["claim_id"].to_numpy(np.int64)
        ub = unit(b, nb)
        for at in range(0, len(own), 256):
            near = unit(a[at : at + 256], na[at : at + 256]) @ ub.T
            near[own[at : at + 256, None] == ids[None, :]] = -np.inf
            row, col = np.nonzero((near >= near.max(axis=1, keepdims=True) - 1e-5) & np.isfinite(near))
            norm = na[at + row] * nb[col]
            score = np.where(norm > 0, (a[at + row] * b[col]).sum(axis=1) / np.where(norm > 0, norm, 1.0), 0.0)
            order = np.lexsort((ids[col], -score, row))
            row, col, score = row[order], col[order], score[order]
            first = np.concatenate(([True], row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
            found.append(pd.DataFrame({"claim_id": own[at + row[first]], "vec_id": ids[col[first]], "score": score[first]}))
    return pd.concat(found) if found else pd.DataFrame({"claim_id": [], "vec_id": [], "score": []}).astype({"claim_id": "int64", "vec_id": "int64", "score": "float64"})


def within_budget(chunks: DataFrame, by: list[str], order: list[Column], size: str, budget: int) -> DataFrame:
    """Chunks best first, as long as those taken before stay below the budget."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("used", F.coalesce(F.sum(size).over(w), F.lit(0))).where(F.col("used") < budget)


#: Claims up to this number are sent to the grams of documents as a whole (a few bytes each); beyond it both sides are exchanged.
FEW_CLAIMS = 200_000


def _at_grams(grams: DataFrame, heads: DataFrame, keys: list[str]) -> DataFrame:
    """``grams`` joined to ``heads`` on ``keys``; where heads are few, grams without one are not exchanged."""
    some = heads.select(*keys).distinct().limit(FEW_CLAIMS + 1)
    if some.count() <= FEW_CLAIMS:
        grams = grams.join(F.broadcast(some), keys, "left_semi")
    return grams.join(heads, keys)


def contained_claims(claims: DataFrame, documents: DataFrame, words: int = 8) -> DataFrame:
    """item_id, doc_id: documents that hold a claim's text verbatim.

    Candidates share the claim's first inner words, those that stand between others: ``words`` - 1 of them, or all that
    a shorter claim has, found by an equi-join on their number and hash. Claims without inner words (two words and
    fewer) may lie inside a word, so they meet documents on their first three characters (or all, if fewer). Grams that
    no claim has are left out before the exchange. A claim without a character is in every text, and is left out."""
    toks = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    # the second word on: the first may be joined to what stands before it, the last to what comes after
    inner = F.least(F.size("w") - 2, F.lit(words - 1))
    heads = claims.select("item_id", F.col("text").alias("claim"), toks(F.col("text")).alias("w")).where("length(text) > 0").withColumn("n", inner)
    hashed = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    long = heads.where("n > 0").select("item_id", "claim", "n", F.xxhash64(hashed(F.slice("w", F.lit(2), F.col("n")))).alias("h"))
    lengths = long.select("n").distinct()  # at most words - 1 rows
    d = documents.where("text IS NOT NULL").select("doc_id", hashed(toks(F.col("text"))).alias("w")).join(F.broadcast(lengths), F.size("w") >= F.col("n"))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.xxhash64(F.slice("w", i, F.col("n"))))
    grams = d.select("doc_id", "n", F.explode(F.array_distinct(grams)).alias("h"))
    pairs = _at_grams(grams, long, ["n", "h"]).select("item_id", "claim", "doc_id")

    short = heads.where("n <= 0").select("item_id", "claim", F.least(F.length("claim"), F.lit(3)).alias("n"))
    short = short.withColumn("h", F.substring(F.col("claim"), F.lit(1), F.col("n")))
    sizes = short.select("n").distinct()  # at most three rows
    c = documents.where("text IS NOT NULL").select("doc_id", F.split("text", "").alias("c")).join(F.broadcast(sizes), F.size("c") >= F.col("n"))
    parts = F.transform(F.sequence(F.lit(0), F.size("c") - F.col("n")), lambda i: F.concat(F.get("c", i), F.when(F.col("n") > 1, F.get("c", i + 1)).otherwise(""), F.when(F.col("n") > 2, F.get("c", i + 2)).otherwise("")))
    parts = c.select("doc_id", "n", F.explode(F.array_distinct(parts)).alias("h"))
    pairs = pairs.unionByName(_at_grams(parts, short, ["n", "h"]).select("item_id", "claim", "doc_id")).distinct()
    return pairs.join(documents.select("doc_id", "text"), "doc_id").where(F.col("text").contains(F.col("claim"))).select("item_id", "doc_id")


def citation_status(overlap: Column) -> Column:
    return F.when(overlap >= 0.5, "supported").when(overlap >= 0.3, "moderate").otherwise("low")


#: Markers of what a file holds: strong ones count three points, weak ones one. Fixed values.
MARKERS = {
    "land": (
        ("successful tenderer", "psf ppr", "per plot ratio", "psf per plot ratio", "date of award", "government land sales", "gls site", "provisional permission", "tendered price", "land rate", "plot ratio"),
        ("tenderer", "tender", "site area", "land parcel", "state land", "land tender", "gpr", "zoning", "land use", "gross floor area allowable"),
    ),
    "sales": (
        ("cap rate", "npi yield", "capitalisation rate", "capitalization rate", "ftm noi", "net property income", "en bloc", "vendor", "purchaser", "seller/buyer", "seller / buyer", "buyer/seller", "sales transaction"),
        ("buyer", "acquirer", "sale price", "transacted price", "investment sales", "net yield", "psf gfa", "psf on gfa", "acquisition", "seller", "capital markets", "key sales", "price (s$"),
    ),
    "rent": (
        ("asking rent", "gross rent", "face rent", "passing rent", "headline rent", "effective rent", "psf pm", "psf/month", "psf per month", "monthly rent", "rent-free", "rent free", "wale"),
        ("tenant", "occupier", "lessee", "lease term", "lease commencement", "vacancy", "occupancy", "leasing", "rental", "take-up", "net lettable", "lease transaction"),
    ),
}
#: Markers of a market report; two make one. Fixed values.
REPORT_MARKERS = (
    "outlook", "market report", "research report", "marketbeat", "market commentary", "executive summary", "forecast", "our view", "market overview", "market pulse",
    "research & forecast", "quarterly report", "market insights", "economic overview",
)
STRONG, WEAK, LEAST_WEAK, LEAST_REPORT = 3, 1, 5, 2


def _held(t: Column, words: tuple[str, ...]) -> Column:
    """How many of ``words`` a text holds."""
    return functools.reduce(operator.add, [t.contains(w).cast("int") for w in words])


def _lowered(body: Column, count: Callable[[Column], Column]) -> Column:
    """``count`` of a text in small letters; the text is lowered once, not for every word that is looked for."""
    return F.get(F.transform(F.array(F.lower(body)), count), F.lit(0))


def marker_scores(body: Column, markers: dict = MARKERS) -> Column:
    """map of type to struct(score, strong): points of the markers found, each counted once, and the number of strong ones."""
    counts = _lowered(F.coalesce(body, F.lit("")), lambda t: F.array(*[_held(t, words) for pair in markers.values() for words in pair]))
    points = lambda n, i: F.struct((STRONG * F.get(n, F.lit(2 * i)) + WEAK * F.get(n, F.lit(2 * i + 1))).alias("score"), F.get(n, F.lit(2 * i)).alias("strong"))
    return F.map_from_arrays(F.array(*map(F.lit, markers)), F.get(F.transform(F.array(counts), lambda n: F.array(*[points(n, i) for i in range(len(markers))])), F.lit(0)))


def present_types(scores: Column, least: int = LEAST_WEAK) -> Column:
    """Types with a strong marker or ``least`` points, most points first; equal ones in the order of the markers."""
    entries = F.transform(F.map_entries(scores), lambda e, i: F.struct((-e["value"]["score"]).alias("s"), i.alias("i"), e["value"]["strong"].alias("n"), e["key"].alias("k")))
    return F.transform(F.array_sort(F.filter(entries, lambda e: (e["n"] >= 1) | (e["s"] <= -least))), lambda e: e["k"])


def report_like(name: Column, body: Column) -> Column:
    """Whether name and body read like a market report."""
    return _lowered(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(body, F.lit(""))), lambda t: _held(t, REPORT_MARKERS)) >= LEAST_REPORT


#: Words in the address of a link to a report. Fixed values.
REPORT_HINTS = ("research", "insight", "marketbeat", "market-report", "/report", "outlook", "briefing")
#: How many characters of a title and of the text after a link are kept; how much page is read for the latter; links a page.
TITLE_CHARS, AFTER_CHARS, AFTER_HTML, LINKS = 140, 280, 900, 40


def absolute(base: Column, href: Column) -> Column:
    """An address seen from its page: as it is, below the same scheme, host or folder."""
    origin = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    folder = F.concat(origin, F.coalesce(F.nullif(F.regexp_extract(F.regexp_replace(F.substring(base, F.length(origin) + 1, F.length(base)), "[?#].*$", ""), r"^.*/", 0), F.lit("")), F.lit("/")))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^[^:]+:", 0), href))
        .when(href.startswith("/"), F.concat(origin, href)).when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href)).otherwise(F.concat(folder, href))
    )


def links(pages: DataFrame, hints: tuple[str, ...] = REPORT_HINTS, least_title: int = 6, cap: int = LINKS) -> DataFrame:
    """page_id, url, title, snippet: links of a page to reports, in order and one for each address without query.

    A link counts if its address ends in .pdf or holds a hint and its text is long
    enough; the snippet is the text that follows the link. At most ``cap`` a page."""
    cut = F.split(F.col("html"), r"(?i)(?=<a\b)", -1)
    rows = pages.select("page_id", F.col("url").alias("base"), "html", F.posexplode(cut).alias("i", "piece"))
    # where the piece starts in the page, so that what follows the link can be read beyond the piece
    at = F.sum(F.length("piece")).over(Window.partitionBy("page_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    anchor = r'(?is)^<a\b[^>]*?href="([^"]+)"[^>]*>(.*?)</a>'
    rows = rows.withColumn("at", F.coalesce(at, F.lit(0))).where(F.col("piece").rlike(anchor)).withColumn("href", F.regexp_extract("piece", anchor, 1))
    after = F.substring(F.col("html"), (F.col("at") + F.length(F.regexp_extract("piece", anchor, 0)) + 1).cast("int"), F.lit(AFTER_HTML))
    rows = rows.select("page_id", "i", absolute(F.col("base"), F.col("href")).alias("full"), text.html_text(F.regexp_extract("piece", anchor, 2)).alias("title"), text.html_text(after).alias("after"))
    rows = rows.withColumn("url", F.regexp_replace("full", r"\?.*$", ""))
    hinted = F.exists(F.array(*map(F.lit, hints)), lambda h: F.lower("url").contains(h)) | F.lower("url").endswith(".pdf")
    rows = rows.where(hinted & (F.length("title") >= least_title))
    firsts = rows.groupBy("page_id", "url").agg(F.min(F.struct("i", "full", "title", "after")).alias("m"))
    order = Window.partitionBy("page_id").orderBy("m.i")
    found = firsts.withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap)
    return found.select("page_id", F.col("m.full").alias("url"), F.substring("m.title", 1, TITLE_CHARS).alias("title"), F.substring("m.after", 1, AFTER_CHARS).alias("snippet"))


def snippets(pairs: DataFrame) -> DataFrame:
    """item_id, doc_id, snippet, low_confidence for claims (claim) and passages (text): the sentence with most of the claim's words, and its neighbour."""
    s = pairs.select("item_id", "doc_id", "claim", F.posexplode(text.sentences(F.col("text"))).alias("i", "sentence"))
    w = Window.partitionBy("item_id", "doc_id").orderBy("i")
    s = s.withColumn("next", F.coalesce(F.lead("sentence").over(w), F.lag("sentence").over(w)))
    s = s.withColumn("overlap", text.keyword_overlap(F.col("claim"), F.col("sentence")))
    best = s.groupBy("item_id", "doc_id").agg(F.max(F.struct("overlap", (-F.col("i")).alias("i"), "sentence", "next")).alias("m"))
    return best.select("item_id", "doc_id", F.substring(F.concat_ws(" ", "m.sentence", "m.next"), 1, SNIPPET_CHARS).alias("snippet"), (F.col("m.overlap") == 0).alias("low_confidence"))


#: Fields of a deal's configuration that a claim may state: numbers and texts. Fixed values.
CONFIG_NUMBERS = ("price_sgd_m", "ftm_noi_cap_rate", "remaining_leasehold_yrs", "gfa_sf")
CONFIG_TEXTS = ("land_zoning", "currency_symbol", "deal_name", "property_name", "address", "country_name")


def states_config(claim: Column, config: Column, numbers: tuple[str, ...] = CONFIG_NUMBERS, texts: tuple[str, ...] = CONFIG_TEXTS) -> Column:
    """Whether a claim holds a fact of ``config``, a struct with the fields in ``numbers`` and ``texts``: a number as it
    is, with one decimal, or as a percentage with one, in any unit; a text of three characters and more."""
    small = F.lower(claim)

    def figure(field: str) -> Column:
        v = config[field].cast("double")
        plain = F.regexp_replace(F.regexp_replace(F.format_string("%.9f", v), "0+$", ""), r"\.$", "")
        forms = F.array(plain, F.format_string("%.1f", v), F.format_string("%.1f", v * 100))
        return (F.coalesce(v, F.lit(0.0)) != 0) & F.exists(forms, lambda a: text.number_supported(a, claim))

    def word(field: str) -> Column:
        w = F.lower(F.trim(config[field]))
        return (F.length(w) >= 3) & small.contains(w)

    return F.exists(F.array(*[F.coalesce(c, F.lit(False)) for c in [*map(figure, numbers), *map(word, texts)]]), lambda x: x)


def cascade(claims: DataFrame, documents: DataFrame, vectors: DataFrame, configs: DataFrame, least: float, numbers: tuple[str, ...], texts: tuple[str, ...]) -> DataFrame:
    """claim_id, citation (contained, similar, deal config or unverified), source, score: where each claim comes from.

    ``claims`` has claim_id, text, deal and embedding (null where there is none). Each
    step is a join of its own and gets only what the steps before have left: documents
    that hold the claim (the smallest doc_id), the most similar vector if similar
    enough, the configuration of the claim's deal (``configs``: deal, config)."""
    held = contained_claims(claims.select(F.col("claim_id").alias("item_id"), "text"), documents)
    held = staged(held.groupBy(F.col("item_id").alias("claim_id")).agg(F.min("doc_id").alias("source")), "contained")
    rest = claims.join(held, "claim_id", "left_anti")
    near = staged(best_by_similarity(rest.where("embedding IS NOT NULL").select("claim_id", "embedding"), vectors, least), "similar")
    last = rest.join(near, "claim_id", "left_anti").join(configs, "deal", "left")
    stated = F.coalesce(states_config(F.col("text"), F.col("config"), numbers, texts), F.lit(False))
    none = F.lit(None)
    parts = [
        held.select("claim_id", F.lit("contained").alias("citation"), F.col("source").cast("long").alias("source"), none.cast("double").alias("score")),
        near.select("claim_id", F.lit("similar").alias("citation"), F.col("vec_id").cast("long").alias("source"), "score"),
        last.select("claim_id", F.when(stated, "deal config").otherwise("unverified").alias("citation"), none.cast("long").alias("source"), none.cast("double").alias("score")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
