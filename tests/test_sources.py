"""Workbooks and connectors."""

import io
import zipfile

from evidentia.sources import connectors, xlsx


def workbook() -> bytes:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Sales" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Property</t></si><si><t>Alpha</t></si></sst>")
        rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Price</t></is></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3"><v>12.5</v></c></row>'
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")
    return out.getvalue()


def test_workbook(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook())
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    got = [(r.sheet, r.row, r.cells) for r in xlsx.read_workbooks(spark, str(tmp_path)).orderBy("row").collect()]
    assert got == [("Sales", 1, ["Property", "", "Price"]), ("Sales", 3, ["Alpha", "", "12.5"])]


def test_lease_table_needs_enough_rows(spark):
    few = spark.createDataFrame([("1 3.8 2 7.5",)], "text string")
    assert connectors.parse_lease_table(few).count() == 0
