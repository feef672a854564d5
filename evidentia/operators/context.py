"""Contexts for a reader with a budget: page-tagged chunks and documents cut to what fits.

``within`` budget means a running sum over a group's documents. It is taken over
stretches of the order first, so that a group with very many documents is
spread over tasks: sums per stretch, sums before a stretch, then inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.operators.retrieval import prose_lines

PAGE_MARK = r"\[PAGE \d+\]"
OMITTED = "(omitted — context budget reached)"


def pages_of(body: Column) -> Column:
    """array of (page, text) of a text with ``[PAGE n]`` marks; what stands before the first mark has page 1."""
    pieces = F.filter(F.split(body, rf"(?={PAGE_MARK})", -1), lambda p: p != "")
    number = lambda p: F.coalesce(F.regexp_extract(p, r"^\[PAGE (\d+)\]", 1).try_cast("int"), F.lit(1))
    return F.transform(pieces, lambda p: F.struct(number(p).alias("page"), F.regexp_replace(p, rf"^{PAGE_MARK}", "").alias("text")))


def page_chunks(documents: DataFrame, size: int | None = None, step: int | None = None) -> DataFrame:
    """doc_id, page, part, text: the prose and table lines of each page of a report; a page that keeps none is left out.

    With ``size`` and ``step``, a page's text is cut into overlapping parts that carry its number."""
    pages = F.transform(pages_of(F.col("text")), lambda p: F.struct(p["page"].alias("page"), prose_lines(text.strip_cjk(p["text"])).alias("text")))
    # empty pages go inside the row: a condition on rows would read every page twice
    rows = documents.select("doc_id", F.explode(F.filter(pages, lambda p: p["text"] != "")).alias("p"))
    kept = rows.select("doc_id", "p.page", "p.text")
    if size is None:
        return kept.select("doc_id", "page", F.lit(0).alias("part"), "text")
    last = F.greatest(F.length("text") - size, F.lit(0))
    starts = F.transform(F.sequence(F.lit(0), F.ceil(last / step).cast("int")), lambda i: i * step)
    return kept.select("doc_id", "page", "text", F.posexplode(starts).alias("part", "at")).select("doc_id", "page", "part", F.substring(F.col("text"), F.col("at") + 1, F.lit(size)).alias("text"))


def running_before(rows: DataFrame, by: str, order: str, amount: str, stretch: int) -> DataFrame:
    """``rows`` with ``before``: the sum of ``amount`` over the rows of the same ``by`` that come earlier in ``order`` (a whole number, unique in its group).

    Sums per stretch of ``order`` are combined before the exchange; a task orders one stretch at a time, or one group's stretches."""
    bucket = F.floor(F.col(order) / stretch).alias("stretch")
    sums = rows.groupBy(by, bucket).agg(F.sum(amount).alias("in_stretch"))
    earlier = Window.partitionBy(by).orderBy("stretch").rowsBetween(Window.unboundedPreceding, 0)
    base = sums.select(by, "stretch", (F.sum("in_stretch").over(earlier) - F.col("in_stretch")).alias("base"))
    inside = Window.partitionBy(by, "stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("stretch", bucket).join(base, [by, "stretch"]).withColumn("before", F.col("base") + F.sum(amount).over(inside) - F.col(amount)).drop("stretch", "base")


def stuffed(documents: DataFrame, by: str, order: str, name: str, budget: int, stretch: int = 4096) -> DataFrame:
    """``by``, ``order``, ``state`` (whole, cut or omitted) and ``part``, each document as it enters its group's context.

    Documents follow one another until the budget in characters is used up; the one
    that crosses it is cut, later ones are named and marked as omitted. Texts are not
    moved by the running sum, only their lengths."""
    lengths = documents.select(by, order, F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))
    placed = running_before(lengths, by, order, "chars", stretch).select(by, order, "chars", "before")
    room = F.greatest(F.lit(budget) - F.col("before"), F.lit(0))
    j = documents.select(by, order, name, F.coalesce("text", F.lit("")).alias("text")).join(placed, [by, order])
    omitted = F.col("before") >= budget
    state = F.when(omitted, "omitted").when(F.col("chars") > room, "cut").otherwise("whole")
    shown = F.when(omitted, F.lit(OMITTED)).otherwise(F.substring(F.col("text"), F.lit(1), room.cast("int")))
    head = F.concat(F.lit("\n[FILE: "), F.coalesce(F.col(name).cast("string"), F.lit("")), F.lit("]\n"))
    return j.select(by, order, state.alias("state"), F.concat(head, shown).alias("part"))


def table_context(tables: DataFrame, by: str, limit: int = 14_000) -> DataFrame:
    """``by``, context: a group's tables (page, headers, rows: array of arrays of string) rendered in page order and cut at ``limit`` characters.

    Only tables that begin within the limit are gathered, so a context's parts are bounded by it."""
    cells = lambda row: F.array_join(F.transform(row, lambda c: F.coalesce(c, F.lit(""))), " | ")
    part = F.concat(F.lit("[Page "), F.col("page").cast("string"), F.lit(" table]\n"), cells(F.col("headers")), F.lit("\n"), F.array_join(F.transform("rows", cells), "\n"))
    parts = tables.select(by, "page", part.alias("part")).withColumn("chars", (F.length("part") + 2).cast("long"))
    near = running_before(parts, by, "page", "chars", 4096).where(F.col("before") < limit)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "part"))), lambda p: p["part"]), "\n\n")
    return near.groupBy(by).agg(F.substring(joined, 1, limit).alias("context"))
