"""Spreadsheets: a data source that reads the first sheet of an .xlsx file, and a writer for bounded reports."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader

#: Rows that a sheet can hold, its header included.
MOST_ROWS = 1_048_576
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _read(path: str) -> bytes:
    fs, name = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    with fs.open_input_file(name) as f:
        return f.read()


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheet_rows(data: bytes) -> list[list[str | None]]:
    """Cells of the first sheet as text; empty ones are None, rows are as long as the header."""
    z = zipfile.ZipFile(io.BytesIO(data))
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_MAIN}t"))
    shared = [text(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    first = min((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    out = []
    for row in ElementTree.fromstring(z.read(first)).iter(f"{_MAIN}row"):
        cells: dict[int, str | None] = {}
        for k, c in enumerate(row.iter(f"{_MAIN}c")):
            value = c.find(f"{_MAIN}v")
            kind = c.get("t")
            got = text(c) if kind == "inlineStr" else None if value is None else shared[int(value.text)] if kind == "s" else value.text
            cells[_column(c.get("r")) if c.get("r") else k] = got
        out.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
    width = len(out[0]) if out else 0
    return [(r + [None] * width)[:width] for r in out]


class XlsxSource(DataSource):
    """spark.read.format("xlsx").load(path): all columns are text, named by the first row."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        rows = sheet_rows(_read(self.options["path"]))
        return ", ".join(f"`{c}` string" for c in (rows[0] if rows else [])) or "value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def read(self, partition) -> Iterator[tuple]:
        for row in sheet_rows(_read(self.path))[1:]:
            yield tuple(row)


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and value == value:
        return f"<c><v>{value!r}</v></c>"
    # control characters can't stand in XML
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(re.sub(r"[^\t\n\r\x20-\uD7FF\uE000-\uFFFD\U00010000-\U0010FFFF]", "", str(value)))}</t></is></c>'


def _sheet(df: DataFrame, most: int, widths: dict[str, int], widest: int) -> str:
    rows = df.limit(most + 1).collect()  # a report's rows, bounded
    if len(rows) > most:
        raise ValueError(f"a sheet holds {most} rows at most, and there are more")
    shown = [[None if v is None else v if isinstance(v, (bool, int, float)) else str(v) for v in r] for r in rows]
    size = [min(widths.get(c, widest), max([len(c), *(len(str(r[k])) for r in shown if r[k] is not None)]) + 2) for k, c in enumerate(df.columns)]
    cols = "".join(f'<col min="{k + 1}" max="{k + 1}" width="{w}" customWidth="1"/>' for k, w in enumerate(size))
    body = "".join("<row>" + "".join(map(_cell, r)) + "</row>" for r in [df.columns, *shown])
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN[1:-1]}"><cols>{cols}</cols><sheetData>{body}</sheetData></worksheet>'


def write_workbook(sheets: dict[str, DataFrame], path: str, most: int = MOST_ROWS - 1, widths: dict[str, int] | None = None, widest: int = 50) -> str:
    """An .xlsx file with a sheet per DataFrame, an error if one has more than `most` rows; columns are as wide as their text, up to `widest`."""
    main, rel = _MAIN[1:-1], "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    names = [re.sub(r"[\[\]:*?/\\]", " ", n)[:31] for n in sheets]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="r{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1)) + "</Relationships>")
        for k, df in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", _sheet(df, most, widths or {}, widest))
    fs, name = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    fs.create_dir(os.path.dirname(name), recursive=True)
    with fs.open_output_stream(name) as f:
        f.write(out.getvalue())
    return path
