"""Tables drawn with pipes in text: lines (doc, line_no, line) to blocks, headers and named values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliodiff.functions.text import is_numeric, normalize_key


def parts_of(line: Column) -> Column:
    """Non-empty cells of a line."""
    return F.filter(F.transform(F.split(line, "\\|"), lambda p: F.trim(p)), lambda p: p != "")


def pipe_blocks(lines: DataFrame) -> DataFrame:
    """(doc, block, r, cells): neighbouring lines of two cells or more, whose first cell has no colon; windows span one document.

    A block ends where the number of cells changes.
    """
    w = W.partitionBy("doc").orderBy("line_no")
    cells = lines.withColumn("cells", parts_of(F.col("line"))).filter((F.size("cells") >= 2) & ~F.get("cells", F.lit(0)).contains(":"))
    new = (F.col("line_no") != F.lag("line_no").over(w) + 1) | (F.size("cells") != F.lag(F.size("cells")).over(w))
    marked = cells.withColumn("_new", F.coalesce(new.cast("int"), F.lit(1)))
    block = marked.withColumn("block", F.sum("_new").over(w))
    return block.select("doc", "block", "line_no", (F.row_number().over(W.partitionBy("doc", "block").orderBy("line_no")) - 1).alias("r"), "cells")


def block_items(blocks: DataFrame) -> DataFrame:
    """(doc, block, r, c, key, value): under a header of words, cells by column; without one, the first cell names the second.

    A header is the first of several rows, all of whose cells start with a letter and hold no number, of at most 12
    characters in a table of two columns and 50 in a wider one.
    """
    first = blocks.filter("r = 0").select("doc", "block", F.col("cells").alias("head"))
    size = blocks.groupBy("doc", "block").agg(F.count("*").alias("n_rows"))
    most = F.when(F.size("head") == 2, 12).otherwise(50)
    worded = F.forall("head", lambda h: h.rlike("^[A-Za-z]") & ~is_numeric(h) & (F.length(h) <= most))
    known = first.join(size, ["doc", "block"]).withColumn("headed", worded & (F.col("n_rows") >= 2))
    rows = blocks.join(known, ["doc", "block"]).select("doc", "block", "r", "headed", "head", F.posexplode("cells").alias("c", "value"), F.col("cells"))
    headed = rows.filter("headed AND r > 0").select("doc", "block", "r", "c", normalize_key(F.get("head", F.col("c"))).alias("key"), "value")
    plain = rows.filter("NOT headed AND c % 2 = 1").select("doc", "block", "r", "c", normalize_key(F.get("cells", F.col("c") - 1)).alias("key"), "value")
    return headed.union(plain)
