"""Lines of text documents and cells of workbooks in zipped XML, and comma-separated files."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from xml.etree import ElementTree

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
P = "{http://schemas.openxmlformats.org/package/2006/relationships}"

Cells = list[tuple[int, str, int, int, str]]


def docx_lines(raw: bytes) -> list[str]:
    """The text of each paragraph; a table cell's paragraphs are lines of their own."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    lines = []
    for paragraph in root.iter(f"{W}p"):
        parts = []
        for node in paragraph.iter():
            if node.tag == f"{W}t":
                parts.append(node.text or "")
            elif node.tag == f"{W}tab":
                parts.append("\t")
            elif node.tag in (f"{W}br", f"{W}cr"):
                parts.append("\n")
        lines += "".join(parts).split("\n")
    return lines


def _column(reference: str) -> int:
    n = 0
    for letter in re.match("[A-Z]+", reference).group():
        n = n * 26 + ord(letter) - 64
    return n - 1


def xlsx_cells(raw: bytes) -> Cells:
    """(sheet_idx, sheet, r, c, value) of every cell that has a value, unformatted, in workbook order."""
    out: Cells = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter(f"{S}t")) for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{S}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(f"{P}Relationship")}
        for i, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{S}sheet")):
            path = targets[sheet.get(f"{R}id")].lstrip("/")
            root = ElementTree.fromstring(z.read(path if path.startswith("xl/") else f"xl/{path}"))
            for k, row in enumerate(root.iter(f"{S}row")):
                r = int(row.get("r", k + 1)) - 1
                for j, cell in enumerate(row.iter(f"{S}c")):
                    c = _column(cell.get("r")) if cell.get("r") else j
                    kind, value = cell.get("t"), cell.findtext(f"{S}v")
                    if kind == "s" and value is not None:
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = "".join(t.text or "" for t in cell.iter(f"{S}t"))
                    elif kind == "b":
                        value = "true" if value == "1" else "false"
                    if value:
                        out.append((i, sheet.get("name"), r, c, value))
    return out


def csv_cells(raw: bytes) -> Cells:
    """The same of a comma-separated file: one sheet, values as they are written."""
    text = raw.decode("utf-8-sig", "replace")
    return [(0, "Sheet1", r, c, value) for r, row in enumerate(csv.reader(io.StringIO(text))) for c, value in enumerate(row) if value]
