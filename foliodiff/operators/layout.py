"""Page layout of text items (doc, ord, str, x, y): rows by gaps in y, columns by nearness in x."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Points between rows, from an item to its column, and for gaps within a row.
ROW_STEP, COLUMN_REACH, CHAR_WIDTH = 2.5, 20.0, 5.0
GAP_LOW, GAP_HIGH, GAP_DEFAULT, GAP_FACTOR = 20.0, 80.0, 30.0, 1.5


def rows_of(glyphs: DataFrame) -> DataFrame:
    """glyphs with row: a new one wherever y moves by more than ROW_STEP from the item before. Windows span one document."""
    w = W.partitionBy("doc").orderBy("ord")
    starts = F.coalesce((F.abs(F.col("y") - F.lag("y").over(w)) > ROW_STEP).cast("int"), F.lit(0))
    return glyphs.withColumn("_s", starts).withColumn("row", F.sum("_s").over(w).cast("int")).drop("_s")


def gap_threshold(rows: DataFrame) -> DataFrame:
    """(doc, threshold): 1.5 times the upper median of the positive gaps in rows, within 20 and 80; 30 without gaps."""
    w = W.partitionBy("doc", "row").orderBy("x", "ord")
    gap = F.col("x") - F.lag(F.col("x") + CHAR_WIDTH * F.length("str")).over(w)
    gaps = rows.withColumn("gap", gap).groupBy("doc").agg(F.array_sort(F.collect_list(F.when(F.col("gap") > 0, F.col("gap")))).alias("g"))
    middle = F.get("g", F.floor(F.size("g") / 2).cast("int"))
    return gaps.select("doc", F.coalesce(F.least(F.greatest(middle * GAP_FACTOR, F.lit(GAP_LOW)), F.lit(GAP_HIGH)), F.lit(GAP_DEFAULT)).alias("threshold"))


def nearest_column(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """rows with column: the nearest of columns (doc, column, x0) within COLUMN_REACH, else -1; first on ties."""
    list_ = columns.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("x0", "column"))).alias("cols"))
    best = F.array_min(F.transform("cols", lambda k: F.struct(F.abs(F.col("x") - k["x0"]).alias("far"), k["column"].alias("column"))))
    joined = rows.join(list_, "doc", "left")
    return joined.withColumn("column", F.when(best["far"] <= COLUMN_REACH, best["column"]).otherwise(-1)).drop("cols")


#: Points within which x positions are one column, and beyond which two lone items are two cells.
COLUMN_WIDTH, PAIR_GAP = 5, 15.0
BLANK = " \t\r\n\f\x0b"


def page_columns(rows: DataFrame) -> DataFrame:
    """(doc, columns): x positions, ascending, where items of two rows or more begin; at least one vote a row and position.

    Rounded positions are taken in order of rows, then x: each joins the first column within COLUMN_WIDTH of it, else it
    starts one. The order decides, so a page's positions are one array: a page bounds its size. Blank items have no vote.
    """
    votes = rows.filter(F.btrim("str", F.lit(BLANK)) != "").groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("row", F.floor(F.col("x") + 0.5).cast("long").alias("x")))).alias("votes"))

    def vote(found, v):
        hit = F.array_position(F.transform(found, lambda k: F.abs(k["at"] - v["x"]) <= COLUMN_WIDTH), True)
        counted = F.transform(found, lambda k, i: F.struct(k["at"].alias("at"), (k["n"] + (i + 1 == hit).cast("int")).alias("n")))
        return F.when(hit > 0, counted).otherwise(F.concat(found, F.array(F.struct(v["x"].alias("at"), F.lit(1).alias("n")))))

    found = F.aggregate("votes", F.array().cast("array<struct<at:bigint,n:int>>"), vote)
    return votes.select("doc", F.array_sort(F.transform(F.filter(found, lambda k: k["n"] >= 2), lambda k: k["at"])).alias("columns"))


def _in_columns(items, columns):
    """The items' texts by nearest column, columns in order; items too far from any come first, together."""
    best = lambda it: F.array_min(F.transform(columns, lambda k: F.struct(F.abs(it["x"] - k).alias("far"), k.alias("at"))))
    put = F.transform(items, lambda it: F.struct(F.when(best(it)["far"] <= COLUMN_REACH, best(it)["at"]).otherwise(-1).alias("at"), F.btrim(it["str"], F.lit(BLANK)).alias("text")))
    buckets = F.array_sort(F.array_distinct(F.transform(put, lambda p: p["at"])))
    texts = F.transform(buckets, lambda b: F.array_join(F.transform(F.filter(put, lambda p: p["at"] == b), lambda p: p["text"]), " "))
    return F.array_join(F.filter(texts, lambda t: t != ""), " | ")


def _by_gaps(items):
    """The items' texts, with a pipe at each gap beyond the row's threshold; two lone items also at a gap of PAIR_GAP."""
    gap = lambda i: F.get(items, i)["x"] - (F.get(items, i - 1)["x"] + CHAR_WIDTH * F.length(F.get(items, i - 1)["str"]))
    gaps = F.transform(F.sequence(F.lit(1), F.size(items) - 1), gap)
    wide = F.array_sort(F.filter(gaps, lambda g: g > 0))
    middle = F.get(wide, F.floor(F.size(wide) / 2).cast("int"))
    threshold = F.coalesce(F.least(F.greatest(middle * GAP_FACTOR, F.lit(GAP_LOW)), F.lit(GAP_HIGH)), F.lit(GAP_DEFAULT))
    line = F.array_join(F.transform(items, lambda it, i: F.when(i == 0, it["str"]).otherwise(F.concat(F.when(F.get(gaps, i - 1) > threshold, " | ").otherwise(" "), it["str"]))), "")
    a, b = F.btrim(F.get(items, F.lit(0))["str"], F.lit(BLANK)), F.btrim(F.get(items, F.lit(1))["str"], F.lit(BLANK))
    lone = (F.size(items) == 2) & ~line.contains("|") & (F.get(items, F.lit(1))["x"] - (F.get(items, F.lit(0))["x"] + CHAR_WIDTH * F.length(a)) > PAIR_GAP)
    return F.btrim(F.when(lone, F.concat(a, F.lit(" | "), b)).otherwise(line), F.lit(BLANK))


def page_lines(glyphs: DataFrame) -> DataFrame:
    """(doc, line_no, line) of pages of text items (doc, ord, str, x, y); doc names a page, line_no counts from 1.

    Items of a row go left to right. A page with two columns or more puts a pipe between columns, any other between items
    with wide gaps. A row of one item is its text. Rows without text are no lines; null texts are blank, empty pages give
    no lines. Two shuffles by page; what is gathered is a page's positions and a row's items.
    """
    rows = rows_of(glyphs.withColumn("str", F.coalesce("str", F.lit(""))))
    some = rows.filter(F.btrim("str", F.lit(BLANK)) != "")
    gathered = some.groupBy("doc", "row").agg(F.array_sort(F.collect_list(F.struct("x", "ord", "str"))).alias("items")).join(page_columns(rows), "doc")
    items = F.col("items")
    line = F.when(F.size(items) == 1, F.btrim(items[0]["str"], F.lit(BLANK))).when(F.size("columns") >= 2, _in_columns(items, F.col("columns"))).otherwise(_by_gaps(items))
    number = F.row_number().over(W.partitionBy("doc").orderBy("row"))
    return gathered.select("doc", "row", line.alias("line")).filter("line <> ''").select("doc", number.alias("line_no"), "line")
