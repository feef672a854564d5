"""Edits of saved records: merges by marker, write-back by name, replayed change logs, cached verdicts.

Every operator is an equi-join or a grouped maximum, combined before the
exchange; no log is gathered or sorted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.num import grid_parse

#: Texts of a table cell that say nothing. Fixed values.
SILENT = ("", "—", "None", "nan")
MARK_SILENT = (*SILENT, "★", "*")


def said(cell: Column, silent: tuple[str, ...] = SILENT) -> Column:
    """A cell's text, or null where it says nothing."""
    text = F.btrim(F.replace(F.coalesce(cell, F.lit("")), F.lit("\n"), F.lit(" ")))
    return F.when(~text.isin(*silent), text)


def cell_value(cell: Column, kind: str) -> Column:
    """A shown cell read back: ``number`` (thousands and percent signs allowed), ``whole`` or ``text``; null if it can't be."""
    text = said(cell)
    if kind == "text":
        return text
    number = grid_parse(text)
    return F.when(number.isNotNull(), F.floor(number).cast("double")) if kind == "whole" else number


def merge_edits(records: DataFrame, edited: DataFrame, fields: dict[str, str], required: str) -> DataFrame:
    """``records`` (deal, marker, property_name, address, lon, lat and ``fields``) after the edits of a table.

    ``edited`` (deal, line, marker, property_name, address and ``fields``, all shown as
    text) is the whole table as it was saved: a record whose marker it lacks is
    removed; a cell that can be read overwrites its field, others leave it (an emptied
    address empties the field); of two lines with one marker the later one counts for
    every cell that it fills. A line
    without a marker, or with one that no record has, is a new record if it has a
    name and the ``required`` field. A changed name or address voids the place.

    Returns the fields with ``change``: kept, updated, removed or added; removed
    ones stay as tombstones, so a reader can tell them from records never seen."""
    cells = {f: cell_value(F.col(f), kind) for f, kind in fields.items()} | {"property_name": said(F.col("property_name")), "address": F.coalesce(said(F.col("address")), F.lit(""))}
    lines = edited.select("deal", "line", said(F.col("marker"), MARK_SILENT).alias("marker"), *[c.alias(f) for f, c in cells.items()])
    known = lines.join(records.select("deal", "marker", F.lit(True).alias("known")), ["deal", "marker"], "left")
    last = known.where("known").groupBy("deal", "marker").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("line"))).alias(f"new_{f}") for f in cells], F.lit(True).alias("present"))
    old = lambda f: F.coalesce(f, F.lit("")) if f == "address" else F.col(f)
    differs = {f: F.col(f"new_{f}").isNotNull() & ~F.col(f"new_{f}").eqNullSafe(old(f)) for f in cells}
    either = lambda names: F.exists(F.array(*[differs[f] for f in names]), lambda x: x)
    moved = either(["property_name", "address"])
    change = F.when(F.col("present").isNull(), "removed").when(either(cells), "updated").otherwise("kept")
    place = [F.when(~moved, F.col(c)).alias(c) for c in ("lon", "lat")]
    merged = records.join(last, ["deal", "marker"], "left").select("deal", "marker", *[F.coalesce(f"new_{f}", f).alias(f) for f in cells], *place, change.alias("change"))
    nowhere = [F.lit(None).cast("double").alias(c) for c in ("lon", "lat")]
    fresh = known.where("known IS NULL").select("deal", F.lit(None).cast("string").alias("marker"), *cells, *nowhere, F.lit("added").alias("change"))
    return merged.unionByName(fresh.where(F.col("property_name").isNotNull() & (F.coalesce(required, F.lit(0.0)) != 0)))


def sync_metadata(saved: DataFrame, processed: DataFrame, fields: list[str]) -> DataFrame:
    """``saved`` (pos, property_name, fields) brought in line with ``processed`` (pos, property_name, fields) by name.

    Names that ``processed`` no longer has were merged away and are left out; of
    several processed records of a name the last one counts; a field is overwritten
    where the processed value is known and differs; ``touched`` says if any was."""
    per = processed.groupBy("property_name").agg(F.max_by(F.struct(*fields), "pos").alias("m"))
    new = lambda f: F.coalesce(F.col(f"m.{f}"), F.col(f))
    touched = F.exists(F.array(*[~new(f).eqNullSafe(F.col(f)) for f in fields]), lambda x: x)
    return saved.join(per, "property_name").select("pos", "property_name", *[new(f).alias(f) for f in fields], touched.alias("touched"))


def replayed(log: DataFrame) -> DataFrame:
    """The state of each marker after its changes (deal, marker, seq, kind, value): delete, restore, hide, show and
    recolour (to ``value``), the last of each sort in the order of ``seq``; ties by kind and value."""
    of = lambda *kinds: F.max(F.when(F.col("kind").isin(*kinds), F.struct("seq", "kind", "value")))
    per = log.groupBy("deal", "marker").agg(of("delete", "restore").alias("life"), of("hide", "show").alias("sight"), of("recolour").alias("paint"), F.count("*").alias("changes"))
    is_ = lambda c, kind: F.coalesce(F.col(f"{c}.kind") == kind, F.lit(False))
    return per.select("deal", "marker", is_("life", "delete").alias("deleted"), is_("sight", "hide").alias("hidden"), F.col("paint.value").alias("colour"), "changes")


def apply_log(records: DataFrame, log: DataFrame, colour: Column) -> DataFrame:
    """``records`` (deal, marker, ..) without deleted ones, with hidden and colour (its default where none was set)."""
    state = replayed(log).drop("changes")
    j = records.join(state, ["deal", "marker"], "left").where(~F.coalesce("deleted", F.lit(False)))
    return j.withColumn("hidden", F.coalesce("hidden", F.lit(False))).withColumn("colour", F.coalesce("colour", colour)).drop("deleted")


def cached_verdicts(uploads: DataFrame, cache: DataFrame) -> DataFrame:
    """``uploads`` (upload, name, bytes, ..) with the verdict first stored for a file of that name and size, if any, and
    ``todo``: whether this upload is the one to be worked on for its name and size (the first without a verdict)."""
    key = ["name", "bytes"]
    known = cache.groupBy(*key).agg(F.min_by("verdict", "seq").alias("verdict"))
    first = uploads.groupBy(*key).agg(F.min("upload").alias("first"))
    j = uploads.join(known, key, "left").join(first, key)
    return j.withColumn("todo", F.col("verdict").isNull() & (F.col("upload") == F.col("first"))).drop("first")
