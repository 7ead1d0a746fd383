"""Lines of extracted texts, without what containers and markup left in them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\n\r\f\x0b"
#: Starts of paths inside office files.
CONTAINER_PATHS = (
    "word/document.xml",
    "word/styles.xml",
    "word/numbering.xml",
    "word/fontTable.xml",
    "word/settings.xml",
    "word/webSettings.xml",
    "word/theme/theme1.xml",
    "word/_rels/",
    "word/media/",
    "xl/workbook.xml",
    "xl/worksheets/sheet",
    "xl/sharedStrings.xml",
    "xl/styles.xml",
    "xl/theme/theme1.xml",
    "xl/_rels/",
    "xl/media/",
    "ppt/presentation.xml",
    "ppt/_rels/",
    "ppt/media/",
    "[Content_Types].xml",
    "_rels/.rels",
    "_rels/document.xml.rels",
    "_rels/workbook.xml.rels",
)
#: Binary and markup residue.
ARCHIVE = "^PK[\\x00-\\x03\\x05-\\x1f]"
CONTROL = "[\\x00-\\x08\\x0e-\\x1f]"
MARKUP = "^\\{?\\\\(rtf|ansi|deff|fonttbl|colortbl|stylesheet|info|pict|pard|par|tab|fs[0-9]|b|i|ul|cf[0-9]|highlight[0-9])"


def split_lines(text: Column) -> Column:
    """Lines without trailing white space; one empty line at the end is no line."""
    lines = F.transform(F.split(text, "\r?\n"), lambda x: F.rtrim(F.regexp_replace(x, "[ \t\r\f\\x0b]+$", "")))
    last = F.element_at(lines, -1) == ""
    return F.when(last, F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


#: All beginnings in one pass: nothing but white space, a path, an archive, markup.
ARTIFACT = f"^[{WHITE}]*+(?:\\z|{'|'.join(re.escape(p) for p in CONTAINER_PATHS)}|{ARCHIVE[1:]}|{MARKUP[1:]})"


def is_artifact(line: Column) -> Column:
    return line.rlike(ARTIFACT) | ((F.length(F.btrim(line, F.lit(WHITE))) < 8) & line.rlike(CONTROL))


def clean_lines(text: Column) -> Column:
    return F.filter(split_lines(text), lambda x: ~is_artifact(x))


def line_class(line: Column) -> Column:
    """separator, heading, list_item, pipe_row, field or paragraph."""
    t = F.btrim(line, F.lit(WHITE))
    return (
        F.when(t.rlike("^[|\\-+:]+$"), "separator")
        .when(t.rlike("^#{1,6} "), "heading")
        .when(t.rlike("^[-*\u2022] "), "list_item")
        .when(t.contains("|"), "pipe_row")
        .when(t.rlike("^[A-Za-z][^:|=]{0,79}[ \t]*[:=][ \t]*[^|]+$"), "field")
        .otherwise("paragraph")
    )
