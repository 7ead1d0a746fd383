"""Issue tables as workbooks and pages, made in tasks: one file for each account, or several for a large one."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliodiff.functions.text import escape_html

ROWS = 50_000
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACK = "http://schemas.openxmlformats.org/package/2006"


def _letters(c: int) -> str:
    return ("" if c < 26 else _letters(c // 26 - 1)) + chr(65 + c % 26)


def workbook(sheets: list[tuple[str, list[str], list[tuple]]]) -> bytes:
    """A workbook of (name, header, rows), values as text, header frozen and filtered."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(sheets)))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{_PACK}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{_PACK}/relationships"><Relationship Id="r" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="s{i + 1}"/>' for i, (n, _, _) in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="s{i + 1}" Type="{_REL}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACK}/relationships">{links}</Relationships>')
        for i, (_, header, rows) in enumerate(sheets):
            body = []
            for r, row in enumerate([tuple(header), *rows]):
                cells = "".join(f'<c r="{_letters(c)}{r + 1}" t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>' for c, v in enumerate(row))
                body.append(f'<row r="{r + 1}">{cells}</row>')
            view = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews>'
            span = f'<autoFilter ref="A1:{_letters(len(header) - 1)}{len(rows) + 1}"/>'
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'<worksheet xmlns="{_MAIN}">{view}<sheetData>{"".join(body)}</sheetData>{span}</worksheet>')
    return out.getvalue()


def workbooks(issues: DataFrame, rows: int = ROWS) -> DataFrame:
    """(account, part, n_issues, content): workbooks of summary and issues; about `rows` issues each, so no account fills one task."""
    columns = [c for c in issues.columns if c != "account"]
    parts = issues.groupBy("account").agg(F.ceil(F.count("*") / rows).cast("int").alias("parts"))
    dealt = issues.join(parts, "account").withColumn("part", F.pmod(F.xxhash64(*columns), F.col("parts")).cast("int"))

    def made(group: pa.Table) -> pa.Table:
        found = sorted(zip(*(group.column(c).to_pylist() for c in columns), strict=True), key=repr)
        account, part = group.column("account")[0].as_py(), group.column("part")[0].as_py()
        severities: dict[str, int] = {}
        for s in group.column("severity").to_pylist():
            severities[s] = severities.get(s, 0) + 1
        content = workbook([("Executive Summary", ["Severity", "Issues"], sorted(severities.items())), ("Reported Issues", columns, found)])
        return pa.table({"account": pa.array([account], pa.string()), "part": pa.array([part], pa.int32()), "n_issues": pa.array([len(found)], pa.int64()), "content": pa.array([content], pa.binary())})

    return dealt.groupBy("account", "part").applyInArrow(made, "account string, part int, n_issues long, content binary")


def page_rows(issues: DataFrame) -> DataFrame:
    """(account, html): a table row for each issue, to be written by account with df.write.partitionBy("account").text(path)."""
    cells = [F.concat(F.lit("<td>"), escape_html(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in ("report", "code", "severity", "location_label", "reference_text", "version_text", "description")]
    return issues.select("account", F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("html"))
