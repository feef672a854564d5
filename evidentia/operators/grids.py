"""Cell grids: headers, stacked tables, fill-down, unit rows, column mapping.

A grid is a table of rows (table_id, row, cells: array of string); ``row`` gives
the order inside a table, and every operator is a window over one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import header_key


def _order():
    return Window.partitionBy("table_id").orderBy("row")


def _so_far():
    return _order().rowsBetween(Window.unboundedPreceding, 0)


def filled(cells: Column) -> Column:
    return F.size(F.filter(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))


def text_cells(cells: Column) -> Column:
    return F.size(F.filter(cells, lambda c: F.coalesce(c, F.lit("")).rlike("[A-Za-z]")))


def digit_cells(cells: Column) -> Column:
    return F.size(F.filter(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))).rlike(r"^[\d.,%$-]+$")))


def keyword_hits(cells: Column, keywords: list[str]) -> Column:
    words = F.array(*map(F.lit, keywords))
    return F.size(F.filter(cells, lambda c: F.exists(words, lambda k: F.lower(F.coalesce(c, F.lit(""))).contains(k))))


def header_row(grid: DataFrame) -> DataFrame:
    """table_id, header: the first row with three text cells, else 0."""
    return grid.groupBy("table_id").agg(F.coalesce(F.min(F.when(text_cells(F.col("cells")) >= 3, F.col("row"))), F.lit(0)).alias("header"))


def best_sheet(grid: DataFrame, book: str, keywords: list[str]) -> DataFrame:
    """The table of each book with most keyword hits in one row, then most filled rows."""
    per = grid.groupBy(book, "table_id").agg(F.max(keyword_hits(F.col("cells"), keywords)).alias("hits"), F.count_if(filled(F.col("cells")) > 0).alias("rows"))
    return per.groupBy(book).agg(F.max_by("table_id", F.struct("hits", "rows", (-F.col("table_id")).alias("t"))).alias("table_id"))


def split_tables(grid: DataFrame, keywords: list[str]) -> DataFrame:
    """Adds ``block``: a header row starts a new one; rows of at most one cell separate and are dropped."""
    c = F.col("cells")
    is_header = (text_cells(c) >= 3) & (digit_cells(c) <= 3) & (keyword_hits(c, keywords) >= 2) & (keyword_hits(c, keywords) >= 0.4 * filled(c))
    marked = grid.withColumn("is_header", is_header).where(filled(c) > 1)
    return marked.withColumn("block", F.sum(F.when(F.col("is_header"), 1).otherwise(0)).over(_so_far()))


def fill_down(grid: DataFrame, column: str) -> DataFrame:
    return grid.withColumn(column, F.last(F.when(F.trim(column) != "", F.col(column)), ignorenulls=True).over(_so_far()))


def split_collapsed(left: Column, right: Column) -> tuple[Column, Column]:
    """A cell of two lines beside an empty one is two cells."""
    lines = F.split(left, "\n")
    two = (F.size(lines) == 2) & (F.coalesce(right, F.lit("")) == "")
    return F.when(two, F.get(lines, F.lit(0))).otherwise(left), F.when(two, F.get(lines, F.lit(1))).otherwise(right)


def stitch_wrapped(rows: DataFrame, name: str, anchor: str) -> DataFrame:
    """Rows without the anchor value continue the row before them: names are joined, one row for each anchor."""
    g = rows.withColumn("_g", F.sum(F.when(F.col(anchor).isNotNull(), 1).otherwise(0)).over(_so_far()))
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", name))), lambda p: p[name]), " ")
    return g.groupBy("table_id", "_g").agg(F.min("row").alias("row"), parts.alias(name), F.max(anchor).alias(anchor)).drop("_g")


def strip_enumeration(rows: DataFrame, name: str) -> DataFrame:
    """Leading numbers equal to the row's place go, in tables where at least half of the rows (and two) are so numbered."""
    place = F.row_number().over(_order())
    own = F.regexp_extract(name, r"^(\d+)[.)]?\s", 1).try_cast("int") == place
    every = Window.partitionBy("table_id")
    hit = F.coalesce(own, F.lit(False))
    marked = rows.withColumn("_hit", hit)
    n = F.count_if(F.col("_hit")).over(every)
    return marked.withColumn(name, F.when(F.col("_hit") & (n >= 2) & (n * 2 >= F.count("*").over(every)), F.regexp_replace(name, r"^\d+[.)]?\s+", "")).otherwise(F.col(name))).drop("_hit")


def map_columns(headers: DataFrame, synonyms: dict[str, tuple[str, ...]]) -> DataFrame:
    """table_id, field, column: every field takes the first column, in order, whose header is one of its synonyms; a column serves one field, fields in order."""
    known = [(i, f, s) for i, (f, names) in enumerate(synonyms.items()) for s in names]
    dim = headers.sparkSession.createDataFrame(known, "ord int, field string, synonym string")
    hits = headers.withColumn("key", header_key(F.col("header"))).join(F.broadcast(dim), F.col("key") == F.col("synonym"))  # a fixed list
    by_field = hits.withColumn("n", F.row_number().over(Window.partitionBy("table_id", "column").orderBy("ord"))).where("n = 1")
    return by_field.groupBy("table_id", "field").agg(F.min("column").alias("column"))


def scan(grid: DataFrame, synonyms: dict[str, tuple[str, ...]], keywords: list[str]) -> DataFrame:
    """Records of a sheet: stacked tables are split, each block's header is mapped to fields, and rows become one column a field (strings, null where a block has no such column)."""
    blocks = split_tables(grid, keywords).where("block > 0")
    heads = blocks.where("is_header").select(F.struct("table_id", "block").alias("table_id"), F.posexplode("cells").alias("column", "header"))
    mapped = map_columns(heads, synonyms)
    at = mapped.groupBy("table_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "column"))).alias("at")).select("table_id.table_id", "table_id.block", "at")  # one entry a field
    rows = blocks.where("NOT is_header").join(at, ["table_id", "block"])
    return rows.select("table_id", "block", "row", *[F.nullif(F.trim(F.get("cells", F.element_at("at", f))), F.lit("")).alias(f) for f in synonyms])


def sale_rows(records: DataFrame) -> DataFrame:
    """Scanned rows as sale records: prices and areas read, rows without name or price and totals left out."""
    from evidentia.functions.num import magnitude_guard, parse_num
    from evidentia.operators.evidence import TOTALS

    price = magnitude_guard(parse_num(F.col("price_sgd_m")))
    out = records.select("table_id", "block", "row", "property_name", "sale_date", price.alias("price_m"), parse_num(F.col("gfa_sf")).alias("gfa_sf"))
    return out.where(F.col("property_name").isNotNull() & (F.coalesce("price_m", F.lit(0.0)) != 0) & ~F.col("property_name").rlike(TOTALS))


def lease_rows(records: DataFrame) -> DataFrame:
    """Scanned rows as leases: an area is needed, a rent is not."""
    from evidentia.functions.num import parse_num

    return records.select("table_id", "row", "property_name", parse_num(F.col("gfa_sf")).alias("nla_sf"), parse_num(F.col("price_sgd_m")).alias("asking_rent")).where(F.coalesce("nla_sf", F.lit(0.0)) != 0)


#: What names a unit in a header. Fixed values.
UNIT_WORDS = r"(?i)sgd|s\$|psf|per\s*sf|million|billion|/sf|/psf|ppr|sqm|sq\s?ft|nla|gfa|%"
TAIL_CHARS = 20


def _bare(cells: Column) -> Column:
    return F.filter(F.transform(cells, lambda c: F.btrim(F.coalesce(c, F.lit("")))), lambda c: c != "")


def unit_row(cells: Column) -> Column:
    """Whether every filled line of every cell is one bracket, as units under a header are."""
    lines = F.filter(F.flatten(F.transform(_bare(cells), lambda c: F.transform(F.split(c, "\n"), lambda x: F.btrim(x)))), lambda x: x != "")
    return (F.size(lines) > 0) & F.forall(lines, lambda x: x.rlike(r"\A\(.*\)\z"))


def header_tail(cells: Column) -> Column:
    """Whether a row continues a header: no digit, short cells, and a piece of a bracket with a unit."""
    c = _bare(cells)
    unit = lambda x: x.rlike(r"[()]") & x.rlike(UNIT_WORDS)
    return (F.size(c) > 0) & ~F.exists(c, lambda x: x.rlike(r"\p{Nd}")) & F.exists(c, unit) & F.forall(c, lambda x: F.length(x) <= TAIL_CHARS)


def fold_headers(grid: DataFrame, heads: DataFrame) -> DataFrame:
    """``grid`` with the unit and continuation rows right below each header (``heads``: table_id, header) merged into it,
    column by column, the words of a column joined by blanks; ``folded`` counts them on the header's row.

    The rows to fold end before the first row below the header that is neither, a grouped
    minimum; only they and the header are gathered. Rows meet their table's header and end by
    hash, so that a task holds a few numbers a table and need not sort the rows."""
    c = F.col("cells")
    ends = grid.where(~(unit_row(c) | header_tail(c))).select("table_id", "row").join(heads.hint("shuffle_hash"), "table_id")
    stop = ends.where(F.col("row") > F.col("header")).groupBy("table_id").agg(F.min("row").alias("stop"))
    bounds = heads.join(stop, "table_id", "left")
    marked = grid.join(bounds.hint("shuffle_hash"), "table_id").withColumn("below", F.col("row") > F.col("header"))
    top = (F.col("row") == F.col("header")) | (F.col("below") & (F.col("stop").isNull() | (F.col("row") < F.col("stop"))))
    band = marked.where(top).groupBy("table_id", F.col("header").alias("row")).agg(F.transform(F.sort_array(F.collect_list(F.struct("row", "cells"))), lambda x: x["cells"]).alias("band"))
    width = F.array_max(F.transform("band", lambda x: F.size(x)))
    column = lambda i: F.array_join(F.filter(F.transform("band", lambda x: F.btrim(F.coalesce(F.get(x, i), F.lit("")))), lambda x: x != ""), " ")
    merged = band.select("table_id", "row", F.transform(F.sequence(F.lit(0), width - 1), column).alias("cells"), (F.size("band") - 1).alias("folded"))
    return merged.unionByName(marked.where(~top).select("table_id", "row", "cells", F.lit(0).alias("folded")))
