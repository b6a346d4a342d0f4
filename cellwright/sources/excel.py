"""Excel workbooks (.xlsx), read and written with the standard library."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwright.config import SourceSpec
from cellwright.sources.delimited import unique_names

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Number formats of dates and times that need no definition of their own.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _moment(serial: float) -> str:
    at = dt.datetime(1899, 12, 30) + dt.timedelta(microseconds=round(serial * 86_400_000_000))
    if serial < 1:
        return at.time().isoformat(timespec="seconds")
    return at.date().isoformat() if at.time() == dt.time() else at.isoformat(" ", "seconds")


def number_text(value: str) -> str:
    """A stored number as people write it: no .0 behind integers."""
    f = float(value)
    return str(int(f)) if f == int(f) and abs(f) < 1e15 else repr(f)


class Workbook:
    def __init__(self, data: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        names = self.zip.namelist()
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        self.sheets = {s.get("name"): "xl/" + targets[s.get(_REL)].removeprefix("/xl/") for s in book.find("m:sheets", _NS)}
        self.strings = []
        if "xl/sharedStrings.xml" in names:
            self.strings = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(self.zip.read("xl/sharedStrings.xml"))]
        self.dates = []
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")) for f in styles.iterfind("m:numFmts/m:numFmt", _NS) if re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "").lower()))}
            self.dates = [int(x.get("numFmtId", 0)) in own | _DATE_FORMATS for x in styles.iterfind("m:cellXfs/m:xf", _NS)]

    def rows(self, sheet: str | int | None = None) -> Iterator[list[str | None]]:
        """The rows of a sheet (by name, by number from 0, or the first); rows that are blank are left out."""
        names = list(self.sheets)
        if isinstance(sheet, str) and sheet not in self.sheets:
            raise ValueError(f"no sheet {sheet}; there are {', '.join(names)}")
        path = self.sheets[sheet if isinstance(sheet, str) else names[sheet or 0]]
        for row in ElementTree.fromstring(self.zip.read(path)).iterfind("m:sheetData/m:row", _NS):
            out: list[str | None] = []
            for cell in row.iterfind("m:c", _NS):
                at = _column(cell.get("r")) if cell.get("r") else len(out)
                out += [None] * (at - len(out))
                out.append(self._text(cell))
            if any(x not in (None, "") for x in out):
                yield out

    def _text(self, cell: ElementTree.Element) -> str | None:
        kind, value = cell.get("t", "n"), cell.find("m:v", _NS)
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{{{_NS['m']}}}t"))
        if value is None or value.text is None:
            return None
        if kind == "s":
            return self.strings[int(value.text)]
        if kind == "b":
            return "TRUE" if value.text == "1" else "FALSE"
        if kind in ("str", "e", "d"):
            return value.text
        style = int(cell.get("s", 0))
        return _moment(float(value.text)) if style < len(self.dates) and self.dates[style] else number_text(value.text)


def read(spark: SparkSession, spec: SourceSpec, warnings: list[str], limit: int | None = None) -> DataFrame:
    """The sheets of all files that the path names, one under another by position. Workbooks are small (a million rows at most); the driver reads them."""
    if spec.path.lower().endswith(".xls"):
        raise ValueError(f"{spec.path}: the old .xls format can't be read; save it as .xlsx")
    rows: list[list[str | None]] = []
    names: list[str] = []
    for file in spark.read.format("binaryFile").load(spec.path).orderBy("path").select("content").toLocalIterator():
        found = list(Workbook(bytes(file["content"])).rows(spec.sheet))[spec.skip_rows :]
        if spec.header and found:
            top, found = found[0], found[1:]
            names = names or unique_names([x or "" for x in top], warnings)
        width = max([len(names), *(len(r) for r in found[:1])])
        names += [f"column{i}" for i in range(len(names), width)]
        rows += found
        if limit and len(rows) >= limit:
            rows = rows[:limit]
            break
    if not names:
        raise ValueError(f"{spec.path}: no columns; is the sheet empty?")
    fitted = [[*r[: len(names)], *[None] * (len(names) - len(r))] for r in rows]
    return spark.createDataFrame(fitted, T.StructType([T.StructField(n, T.StringType()) for n in names]))


_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def write(path: str, sheets: list[tuple[str, Iterable[list[object]]]], fills: tuple[str, ...] = ()) -> None:
    """Write sheets of rows, row by row. Numbers stay numbers; a (value, fill number) pair gets the fill, a sheet's first row is bold."""
    xml = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def cell(i: int, n: int, value: object) -> str:
        style = 1 if n == 1 else 0
        if isinstance(value, tuple):
            value, style = value[0], value[1] + 2
        if value is None:
            return ""
        at = f'r="{_letters(i)}{n}" s="{style}"'
        if isinstance(value, (int, float)) and not isinstance(value, bool) and value == value and abs(value) != float("inf"):
            return f"<c {at}><v>{value}</v></c>"
        return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(_BAD.sub("", str(value)))}</t></is></c>'

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for k, (_, rows) in enumerate(sheets, 1):
            with z.open(f"xl/worksheets/sheet{k}.xml", "w") as f:
                f.write(f"{xml}<worksheet {main}><sheetData>".encode())
                for n, row in enumerate(rows, 1):
                    f.write(f'<row r="{n}">{"".join(cell(i, n, v) for i, v in enumerate(row))}</row>'.encode())
                f.write(b"</sheetData></worksheet>")
        colours = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>' for c in fills)
        plain = '<xf numFmtId="0" fontId="0" fillId="0" borderId="0" xfId="0"/>'
        styles = f'<fonts count="2"><font/><font><b/></font></fonts><fills count="{2 + len(fills)}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{colours}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{2 + len(fills)}">{plain}<xf numFmtId="0" fontId="1" fillId="0" borderId="0" xfId="0" applyFont="1"/>{"".join(f"""<xf numFmtId="0" fontId="0" fillId="{i + 2}" borderId="0" xfId="0" applyFill="1"/>""" for i in range(len(fills)))}</cellXfs>'
        z.writestr("xl/styles.xml", f"{xml}<styleSheet {main}>{styles}</styleSheet>")
        listed = "".join(f'<sheet name="{escape(name[:31], {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, (name, _) in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'{xml}<workbook {main} xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
        package = "http://schemas.openxmlformats.org/package/2006"
        z.writestr("xl/_rels/workbook.xml.rels", f'{xml}<Relationships xmlns="{package}/relationships">{links}<Relationship Id="rId{len(sheets) + 1}" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("_rels/.rels", f'{xml}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'{xml}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{parts}</Types>')
