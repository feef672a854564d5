"""Names, sentences and figures in text: ``Column -> Column``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that tell nothing about a claim. Fixed values.
STOPWORDS = (
    "the a an and or of to in on for with is are was were by at as this that it its from which will be has have had "
    "not but also than into over amid amidst"
).split()
CLAIM_NUMBER = r"\d+\.\d+%?|\d+%|[1-9][\d,]{4,}"
PAGE_NUMBER = r"\d[\d,]*\.?\d*"
#: Hangul, kana and han blocks. Fixed values.
CJK = "[ᄀ-ᇿ぀-ヿ㄰-㆏가-힣㐀-䶿一-鿿豈-﫿\\x{20000}-\\x{2A6DF}]+"


def header_key(text: Column) -> Column:
    """Lowered, punctuation to blanks, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9_\s]", " "), r"\s+", " "))


def name_key(name: Column, price: Column) -> Column:
    """Key of a deal: 24 word characters of the name and the whole price."""
    return F.concat(F.substring(F.regexp_replace(F.lower(name), r"\W+", ""), 1, 24), F.lit("_"), F.bround(price, 0).cast("long").cast("string"))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\W+", " "), " "), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token arrays; 0 if either is empty."""
    common, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common / union)


def name_overlap(a: Column, b: Column) -> Column:
    return jaccard(tokens(a), tokens(b))


def clean_property_name(text: Column) -> Column:
    """First line, and later lines that hold a digit or a parenthesis."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x, i: (x != "") & ((i == 0) | x.rlike(r"[\d()]")))
    return F.array_join(kept, " ")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9]+", "_"), "^_+|_+$", "")


def source_label(source: Column) -> Column:
    """``pdf_2`` as ``PDF 2``."""
    kind, number = F.regexp_extract(source, r"^([a-z]+)", 1), F.regexp_extract(source, r"_(\d+)$", 1)
    shown = F.when(kind == "pdf", "PDF").when(kind == "excel", "Excel").when(kind == "image", "Image").otherwise(F.initcap(kind))
    return F.when(number != "", F.concat_ws(" ", shown, number)).otherwise(shown)


#: Letters and digits that readers of scans take for each other. Fixed values.
CONFUSABLE = (("0", "O", "o"), ("1", "I", "l", "i"), ("5", "S", "s"), ("8", "B"), ("2", "Z", "z"))


def confusable_only(a: Column, b: Column) -> Column:
    """Whether two strings of one length differ only by characters that look alike."""
    group = lambda c: F.coalesce(*[F.when(c.isin(*g), F.lit(str(i))) for i, g in enumerate(CONFUSABLE)], c)
    same = F.forall(F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y")), lambda p: group(p["x"]) == group(p["y"]))
    return (F.length(a) == F.length(b)) & (a != b) & same


def is_placeholder(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit("")))).isin("", "-", "—", "n/a", "na", "nil", "none", "tbc", "unknown")


def concat_remarks(sale_type: Column, remarks: Column) -> Column:
    """Sale type and remarks, each once."""
    s, r = F.coalesce(sale_type, F.lit("")), F.coalesce(remarks, F.lit(""))
    return F.when(r == "", s).when(s == "", r).when(F.lower(r).contains(F.lower(s)), r).otherwise(F.concat_ws("; ", s, r))


def smart_truncate(text: Column, limit: int) -> Column:
    """First three quarters and last quarter of a text over the limit, with a mark between."""
    head = limit * 3 // 4
    tail = limit - head
    cut = F.concat(F.substring(text, 1, head), F.lit("\n...[middle omitted]...\n"), F.substring(text, -tail, tail))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def strip_thinking(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""))


def strip_cjk(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, CJK, " "))


def sentences(text: Column) -> Column:
    """Sentences: cut after . ! ? before a capital or digit."""
    return F.filter(F.transform(F.split(F.trim(text), r"(?<=[.!?])\s+(?=[A-Z0-9])"), lambda s: F.trim(s)), lambda s: s != "")


def significant_words(claim: Column) -> Column:
    words = F.filter(F.split(claim, r"\s+"), lambda w: F.length(w) >= 4)
    bare = F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"""^[.,;:()\[\]%$'"]+|[.,;:()\[\]%$'"]+$""", "")))
    return F.array_except(F.array_distinct(bare), F.array(*map(F.lit, STOPWORDS)))


def keyword_overlap(claim: Column, sentence: Column) -> Column:
    """Share of the claim's significant words that a sentence holds."""
    words = significant_words(claim)
    own = F.transform(F.split(sentence, r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"""^[.,;:()\[\]%$'"]+|[.,;:()\[\]%$'"]+$""", "")))
    return F.when(F.size(words) == 0, 0.0).otherwise(F.size(F.array_intersect(words, own)) / F.size(words))


def claim_numbers(claim: Column) -> Column:
    return F.regexp_extract_all(claim, F.lit(CLAIM_NUMBER), F.lit(0))


def anchor_number(numbers: Column) -> Column:
    """The most distinctive figure: a decimal first, then most digits, then the first."""
    ranked = F.transform(numbers, lambda n, i: F.struct(n.contains(".").alias("d"), F.length(F.regexp_replace(n, r"\D", "")).alias("k"), (-i).alias("i"), n.alias("n")))
    return F.array_max(ranked)["n"]


def number_supported(anchor: Column, text: Column, tolerance: float = 0.03) -> Column:
    """Whether a text holds the figure, as printed or in another unit within the tolerance; a percentage only as printed."""
    from evidentia.functions.num import scale_variants

    printed = F.replace(text, F.lit(","), F.lit("")).contains(F.replace(anchor, F.lit(","), F.lit("")))
    value = F.regexp_replace(anchor, "[,%]", "").try_cast("double")
    found = F.transform(F.regexp_extract_all(text, F.lit(PAGE_NUMBER), F.lit(0)), lambda t: F.replace(t, F.lit(","), F.lit("")).try_cast("double"))
    near = F.exists(found, lambda t: F.coalesce((t > 0) & F.exists(scale_variants(value), lambda v: F.abs(v - t) / t <= tolerance), F.lit(False)))
    return printed | (~anchor.contains("%") & (F.coalesce(value, F.lit(0.0)) != 0) & near)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def html_text(html: Column) -> Column:
    """Text of a page: scripts and styles dropped, tags to blanks, blanks collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def fix_json(text: Column) -> Column:
    """JSON as models write it, made readable: fences, comments, trailing commas and Python literals."""
    s = F.regexp_replace(text, r"```(?:json)?", "")
    s = F.regexp_replace(s, r"(?m)(^|\s)//[^\n]*$", "$1")
    s = F.regexp_replace(s, r",(\s*[}\]])", "$1")
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\bNone\b", "null"), r"\bTrue\b", "true"), r"\bFalse\b", "false")
    return F.trim(s)


def first_json_object(text: Column) -> Column:
    return F.nullif(F.regexp_extract(fix_json(text), r"(?s)\{.*\}", 0), F.lit(""))
