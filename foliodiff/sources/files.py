"""Folders of reports as tables: one row a file with its lines or cells, or the error that stopped it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliodiff.functions import names
from foliodiff.functions.lines import is_artifact
from foliodiff.sources.office import csv_cells, docx_lines, xlsx_cells
from foliodiff.sources.rtf import to_text

CELL = pa.struct([("sheet_idx", pa.int32()), ("sheet", pa.string()), ("r", pa.int32()), ("c", pa.int32()), ("value", pa.string())])
SCHEMA = "path string, size long, detected string, content_type string, lines array<string>, cells array<struct<sheet_idx: int, sheet: string, r: int, c: int, value: string>>, error string"


def magic(content: Column) -> Column:
    """pdf, zip or rtf by the first bytes; null if none of them."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head == "25504446", "pdf").when(head.rlike("^504B(03|05|01)"), "zip").when(head == "7B5C7274", "rtf")


def parse(name: str, raw: bytes) -> tuple[str, list[str] | None, list | None]:
    """(content type, lines, cells) by the bytes first, then by the extension."""
    ext = name.rpartition(".")[2].lower()
    if raw[:4] == b"%PDF":
        raise ValueError("no reader for PDF page content; give its text items to operators.layout")
    if raw[:2] == b"PK":
        return ("text", docx_lines(raw), None) if b"word/" in raw[:4096] or ext == "docx" else ("sheet", None, xlsx_cells(raw))
    if ext == "docx" and raw[:4] == b"{\\rt":
        raise ValueError("the file is rich text; rename it to .rtf")
    if ext == "rtf":
        return "text", to_text(raw).split("\n"), None
    if ext == "csv":
        return "sheet", None, csv_cells(raw)
    raise ValueError(f"no reader for {ext}")


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):  # one file a batch: files may be large
            path, size, raw, detected = (batch.column(k)[i].as_py() for k in range(4))
            kind = lines = cells = error = None
            try:
                kind, lines, cells = parse(path, raw)
            except Exception as e:  # a file that cannot be read is a row with its error
                first = "".join(chr(x) if 32 <= x < 127 else "." for x in raw[:64])
                error = f"{type(e).__name__}: {e} | Size: {size} | Magic bytes: {raw[:16].hex(' ')} | First chars: {first}"
            found = None if cells is None else [dict(zip(("sheet_idx", "sheet", "r", "c", "value"), x, strict=True)) for x in cells]
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([size]), pa.array([detected], pa.string()), pa.array([kind], pa.string()), pa.array([lines], pa.list_(pa.string())), pa.array([found], pa.list_(CELL)), pa.array([error], pa.string())],
                ["path", "size", "detected", "content_type", "lines", "cells", "error"],
            )


def scan(spark: SparkSession, *paths: str) -> DataFrame:
    """Every supported file below the paths. Listing, reading and parsing are spread over tasks by Spark."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    some = found.filter(names.extension(F.col("path")).isin(*names.KINDS)).select("path", F.col("length").alias("size"), "content", magic(F.col("content")).alias("detected"))
    parsed = some.mapInArrow(_parsed, SCHEMA)
    return parsed.withColumn("lines", F.filter(F.transform("lines", lambda x: F.regexp_replace(x, "[ \t\r]+$", "")), lambda x: ~is_artifact(x)))
