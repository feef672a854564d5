"""Workbooks as one relation of cells, with formulas as expression trees.

A workbook has a comparables sheet (header, one row a record, averages), a
parameter sheet and a lease-table sheet; all of them are rows
(deal, sheet, row, col, shown, number, formula). A formula is a tree of the
nodes below. It compiles to two columns: its spelling in the cell, with
references to the cells of its row and of other sheets, and its value, worked
out from the record and the deal's parameters. Averages are aggregates of the
same columns, combined before the exchange; only the numbering of rows needs a
deal's records in order.

Null in a record shows as a dash; a formula over one is a dash, as the sheet
would show its error. A deal without parameters has an unknown lease (factor 1).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import lease
from evidentia.operators.report import ABSENT

PARAMS, LEASE_TABLE = "Params", "Lease Table"
#: First row of records: a header row, then the records.
FIRST = 2


def letter(col: int) -> str:
    """Name of a column, counted from 1."""
    name = ""
    while col:
        col, rest = divmod(col - 1, 26)
        name = chr(65 + rest) + name
    return name


@dataclass(frozen=True)
class Cell:
    """The cell of this row under a key."""

    key: str

    def text(self, keys: list[str], row: Column) -> Column:
        return F.concat(F.lit(letter(keys.index(self.key) + 1)), row.cast("string"))

    def value(self) -> Column:
        return F.col(self.key)


@dataclass(frozen=True)
class Param:
    """A deal's parameter, at a fixed place of the parameter sheet."""

    key: str

    def text(self, keys: list[str], row: Column) -> Column:
        return F.lit(f"{PARAMS}!$B${PARAM_ROWS.index(self.key) + FIRST}")

    def value(self) -> Column:
        return F.col(f"param_{self.key}")


@dataclass(frozen=True)
class Factor:
    """The lease factor of a number of years, looked up in the lease-table sheet."""

    years: Cell | Param

    def text(self, keys: list[str], row: Column) -> Column:
        y = self.years.text(keys, row)
        rest = f"VLOOKUP(ROUND(%s,0),'{LEASE_TABLE}'!$A$2:$B$100,2,FALSE)"
        return F.concat(F.lit("IF(ISNUMBER("), y, F.lit("),IF(OR("), y, F.lit("<=0,"), y, F.lit(">=999),1,IF("), y, F.lit(">99,0.96+("), y, F.lit("-99)*0.04/900,"), F.lit(rest.split("%s")[0]), y, F.lit(rest.split("%s")[1]), F.lit(")),1)"))

    def value(self) -> Column:
        return lease.literal_factor(self.years.value())


@dataclass(frozen=True)
class Op:
    """Product (``*``) or quotient (``/``) of two trees; a quotient by zero is an error, null here."""

    sign: str
    left: object
    right: object

    def text(self, keys: list[str], row: Column) -> Column:
        return F.concat(self.left.text(keys, row), F.lit(self.sign), self.right.text(keys, row))

    def value(self) -> Column:
        a, b = self.left.value(), self.right.value()
        return a * b if self.sign == "*" else F.try_divide(a, b)


@dataclass(frozen=True)
class OrDash:
    """A tree, or a dash where it is an error; the root of a formula."""

    tree: object

    def text(self, keys: list[str], row: Column) -> Column:
        return F.concat(F.lit("=IFERROR("), self.tree.text(keys, row), F.lit(f',"{ABSENT}")'))

    def value(self) -> Column:
        return self.tree.value()


#: Parameters in the order of their rows.
PARAM_ROWS = ("lease_yrs",)
PARAM_LABELS = {"lease_yrs": "Subject Remaining Leasehold (yrs)"}
PARAM_NOTES = (f"Lease factors: see '{LEASE_TABLE}'", "Adjusted = reported x factor of the record / factor of the subject, or the reverse for prices")
LEASE_NOTE = "Leasehold value as a share of freehold value"


@dataclass(frozen=True)
class Layout:
    """A comparables sheet: (header, key, kind), formulas and the keys that are averaged."""

    name: str
    columns: tuple[tuple[str, str, str], ...]
    formulas: dict[str, OrDash]
    averaged: tuple[str, ...]
    #: key -> field of a value that a source printed itself and that stands in place of the formula
    printed: dict[str, str]

    @property
    def keys(self) -> list[str]:
        return [k for _, k, _ in self.columns]


SALES = Layout(
    "Sales Comps",
    (("No.", "marker", "number"), ("Property", "property_name", "text"), ("Sale Date", "sale_date", "text"), ("GFA (SF)", "gfa_sf", "number"), ("Lease (yrs)", "remaining_yrs", "number"), ("Price (M)", "price_m", "number"), ("Price (psf)", "price_psf", "number"), ("FTM yield", "npi_yield", "number"), ("Adj. yield", "adj_yield", "number")),
    {"adj_yield": OrDash(Op("/", Op("*", Cell("npi_yield"), Factor(Cell("remaining_yrs"))), Factor(Param("lease_yrs"))))},
    ("price_psf", "npi_yield", "adj_yield"),
    {"adj_yield": "reported_adj"},
)
LAND = Layout(
    "Land Comps",
    (("No.", "marker", "number"), ("Site", "site_name", "text"), ("Launch", "launch_date", "text"), ("Tenure (yrs)", "tenure_yrs", "number"), ("Max GFA (SF)", "max_gfa_sf", "number"), ("Price (M)", "price_m", "number"), ("Price (psf ppr)", "psf_ppr", "number"), ("Adj. price (psf ppr)", "adj_psf_ppr", "number")),
    {"adj_psf_ppr": OrDash(Op("/", Op("*", Cell("psf_ppr"), Factor(Param("lease_yrs"))), Factor(Cell("tenure_yrs"))))},
    ("psf_ppr", "adj_psf_ppr"),
    {},
)


def evaluated(records: DataFrame, params: DataFrame, layout: Layout) -> DataFrame:
    """``records`` (deal, pos, fields) numbered within their deal (marker, row), with each formula's spelling (f_key) and value (key).

    ``params`` has deal and a column for each parameter, one row a deal."""
    given = params.select("deal", *[F.col(p).alias(f"param_{p}") for p in PARAM_ROWS])
    marker = F.row_number().over(Window.partitionBy("deal").orderBy("pos"))
    rows = records.join(given, "deal", "left").withColumn("marker", marker.cast("double")).withColumn("row", F.col("marker").cast("int") + FIRST - 1)
    for key, tree in layout.formulas.items():
        printed = F.col(layout.printed[key]) if key in layout.printed else F.lit(None).cast("double")
        spelled = F.when(printed.isNull(), tree.text(layout.keys, F.col("row")))
        rows = rows.withColumn(f"f_{key}", spelled).withColumn(key, F.coalesce(printed, tree.value()))
    return rows


def _cell(row: Column, col: int, shown: Column | None, number: Column | None = None, formula: Column | None = None) -> Column:
    none = lambda c, t: F.lit(None).cast(t) if c is None else c.cast(t)
    return F.struct(row.cast("int").alias("row"), F.lit(col).alias("col"), none(shown, "string").alias("shown"), none(number, "double").alias("number"), none(formula, "string").alias("formula"))


def _sheet(df: DataFrame, name: str, cells: list[Column]) -> DataFrame:
    return df.select("deal", F.lit(name).alias("sheet"), F.explode(F.array(*cells)).alias("c")).select("deal", "sheet", "c.*")


def comps_sheet(rows: DataFrame, layout: Layout) -> DataFrame:
    """Cells of the comparables sheet: header, records, averages of the positive values below them."""
    here, body = F.col("row"), []
    for i, (_, key, kind) in enumerate(layout.columns, 1):
        value = F.col(key)
        number = value if kind == "number" else None
        shown = F.when(value.isNull(), ABSENT) if kind == "number" else F.coalesce(F.nullif(value, F.lit("")), F.lit(ABSENT))
        body.append(_cell(here, i, shown, number, F.col(f"f_{key}") if key in layout.formulas else None))
    per = rows.groupBy("deal").agg(F.max("row").alias("last"), *[F.avg(F.when(F.col(k) > 0, F.col(k))).alias(k) for k in layout.averaged])
    foot = []
    for i, (_, key, kind) in enumerate(layout.columns, 1):
        if key in layout.averaged:
            area = F.concat(F.lit(f"{letter(i)}{FIRST}:{letter(i)}"), F.col("last").cast("string"))
            foot.append(_cell(F.col("last") + 1, i, F.when(F.col(key).isNull(), ABSENT), F.col(key), F.concat(F.lit("=IFERROR(AVERAGEIF("), area, F.lit(f',">0"),"{ABSENT}")'))))
        elif i == 2:
            foot.append(_cell(F.col("last") + 1, i, F.lit("Average")))
    head = [_cell(F.lit(1), i, F.lit(h)) for i, (h, _, _) in enumerate(layout.columns, 1)]
    return _sheet(rows, layout.name, body).unionByName(_sheet(per, layout.name, [*head, *foot]))


def params_sheet(params: DataFrame) -> DataFrame:
    """Cells of the parameter sheet of each deal: header, parameters, notes."""
    cells = [_cell(F.lit(1), 1, F.lit("Parameter")), _cell(F.lit(1), 2, F.lit("Value"))]
    for i, p in enumerate(PARAM_ROWS):
        cells += [_cell(F.lit(FIRST + i), 1, F.lit(PARAM_LABELS[p])), _cell(F.lit(FIRST + i), 2, F.when(F.col(p).isNull(), ABSENT), F.col(p))]
    cells += [_cell(F.lit(FIRST + len(PARAM_ROWS) + 1 + i), 1, F.lit(x)) for i, x in enumerate(PARAM_NOTES)]
    return _sheet(params, PARAMS, cells)


def lease_sheet(deals: DataFrame) -> DataFrame:
    """Cells of the lease-table sheet of each deal: header, 99 years with their factors, source note.

    The sheet is one small table for all deals, sent to them, not an array built again in each deal's row."""
    table = lease.factor_rows()
    cells = [(1, 1, "Years", None), (1, 2, "Factor (decimal)", None), (len(table) + 3, 1, LEASE_NOTE, None)]
    for y, f in table:
        cells += [(y + 1, 1, None, float(y)), (y + 1, 2, None, f)]
    sheet = deals.sparkSession.createDataFrame(cells, "row int, col int, shown string, number double")
    sheet = sheet.select("row", "col", "shown", F.when(F.col("col") == 2, F.round("number", 5)).otherwise(F.col("number")).alias("number"), F.lit(None).cast("string").alias("formula"))
    return deals.select("deal", F.lit(LEASE_TABLE).alias("sheet")).crossJoin(F.broadcast(sheet))


def workbook(records: DataFrame, params: DataFrame, layout: Layout) -> DataFrame:
    """All cells of each deal's workbook: deal, sheet, row, col, shown, number, formula."""
    rows = evaluated(records, params, layout)
    return comps_sheet(rows, layout).unionByName(params_sheet(params)).unionByName(lease_sheet(params.select("deal")))
