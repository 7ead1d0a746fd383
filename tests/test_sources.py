import io
import zipfile

from foliodiff.sources import files, office, rtf


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACK = "http://schemas.openxmlformats.org/package/2006/relationships"
DOCX = zipped({"word/document.xml": f'<w:document xmlns:w="{WORD}"><w:body><w:p><w:r><w:t>Account: </w:t><w:t>1000</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
XLSX = zipped(
    {
        "xl/workbook.xml": f'<workbook xmlns="{SHEET}" xmlns:r="{REL}"><sheets><sheet name="Ward" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACK}"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{SHEET}"><si><t>Goods</t></si></sst>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{SHEET}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="3"><c r="AB3"><v>31415</v></c><c r="AC3" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>',
    }
)
RTF = rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\*\generator x;}\b Hello world\b0\par Caf\'e9 \u8364?uro \{x\}\line Total:\tab 5\cell end\row}"


def test_rtf():
    assert rtf.to_text(RTF) == "Hello world\nCafé €uro {x}\nTotal:\t5\nend\n"
    assert rtf.to_text(b"plain text") == "plain text"
    assert rtf.to_text(b"{\\rtf1 \\b") == ""


def test_office():
    assert office.docx_lines(DOCX) == ["Account: 1000", "cell"]
    assert office.xlsx_cells(XLSX) == [(0, "Ward", 0, 0, "Goods"), (0, "Ward", 2, 27, "31415"), (0, "Ward", 2, 28, "in")]
    assert office.csv_cells(b'\xef\xbb\xbfa,"b\nc"\n,d\n') == [(0, "Sheet1", 0, 0, "a"), (0, "Sheet1", 0, 1, "b\nc"), (0, "Sheet1", 1, 1, "d")]


def test_scan(spark, tmp_path):
    made = {"a/r_v1.docx": DOCX, "a/r_v1.xlsx": XLSX, "a/r_v2.rtf": RTF, "a/misnamed.rtf": XLSX, "b/r.csv": b"x,y\n", "b/broken.docx": b"PK\x03\x04 no", "b/p.pdf": b"%PDF-1.4", "b/other.txt": b"x"}
    for name, raw in made.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    got = {r.path.rpartition("/")[2]: r for r in files.scan(spark, str(tmp_path)).collect()}
    assert set(got) == {"r_v1.docx", "r_v1.xlsx", "r_v2.rtf", "misnamed.rtf", "r.csv", "broken.docx", "p.pdf"}
    assert got["r_v1.docx"].lines == ["Account: 1000", "cell"] and got["r_v1.docx"].detected == "zip"
    assert got["misnamed.rtf"].content_type == "sheet" and len(got["r_v1.xlsx"].cells) == 3
    assert got["r_v2.rtf"].detected == "rtf" and got["r_v2.rtf"].lines[0] == "Hello world"
    assert "Magic bytes" in got["broken.docx"].error and "PDF" in got["p.pdf"].error and got["r.csv"].error is None
